"""Call sites from source text: a scan in Arrow batches over a table of nodes, then lookups and captures as columns.

``functions.lexing`` finds comments and literals by the modes of each language, ``functions.nodes`` numbers brackets and call
heads of many files at once. A row is a call, not the header of a function, a prototype, a macro's name or a pattern: path,
lang, callee (dotted, with ``new `` before a constructor), args (kind, name of a keyword, text, and the string or integer
value), line, offset (in characters), snippet (up to the line's end, SNIPPET bytes at most), owner (the callee of the call
around it), generic (type arguments), root (the first callee of its fluent chain), scope (offset of the outermost brace,
which tells functions apart) and frames: six brackets around it from the nearest on, and what stands beside it. Whole files
are scanned, and nothing is decided by a fixed number of characters around a place.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.nodes import Source

ARG = pa.struct([("kind", pa.string()), ("kw", pa.string()), ("text", pa.string()), ("s", pa.string()), ("i", pa.int64())])
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 95]] = True
ROW = pa.schema([("path", pa.string()), ("lang", pa.string()), ("callee", pa.string()), ("args", pa.list_(ARG)), ("line", pa.int32()), ("offset", pa.int32()), ("snippet", pa.string()), ("owner", pa.string()), ("generic", pa.string()), ("root", pa.string()), ("scope", pa.int32()), ("frames", pa.list_(pa.string()))])
SITES = "path string, lang string, callee string, args array<struct<kind: string, kw: string, text: string, s: string, i: bigint>>, line int, offset int, snippet string, owner string, generic string, root string, scope int, frames array<string>"

#: Bytes of source text of one language that are scanned at once, and of a line that a snippet shows.
SLICE, SNIPPET = 1 << 20, 512


def texts_by_language(paths: pa.Array, langs: pa.Array, contents: pa.Array):
    """(rows, Source) of slices of files of one language; a null text is empty."""
    groups: dict[str, list[int]] = {}
    for i, lang in enumerate(langs.to_pylist()):
        groups.setdefault(lang or "", []).append(i)
    contents = contents.cast(pa.large_binary())
    for lang, rows in groups.items():
        held, size = [], 0
        for i in rows:
            text = contents[i].as_py() or b""
            held.append((i, text.replace(b"\0", b" ") if b"\0" in text else text))
            size += len(text)
            if size >= SLICE:
                yield np.array([r for r, _ in held]), Source([t for _, t in held], lang)
                held, size = [], 0
        if held:
            yield np.array([r for r, _ in held]), Source([t for _, t in held], lang)


def cut_text(source: Source, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The pieces of the text as strings."""
    lens = np.maximum(last - first, 0)
    ends = np.cumsum(lens)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - lens), lens)
    edges = pa.array(np.append(0, ends), pa.int64())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, edges.buffers()[1], pa.py_buffer(source.raw_array[at].tobytes())]).cast(pa.large_string()).cast(pa.string())


def _first_outside(places: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """The first of the sorted places from ``at`` on."""
    k = np.searchsorted(places, at)
    return np.where(k < len(places), places[np.minimum(k, max(len(places) - 1, 0))] if len(places) else none, none)


def arguments(source: Source, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into nodes, first, last) of the elements of these brackets, trimmed; elements of blanks alone are none."""
    of = np.full(len(source.open), -1)
    of[nodes] = np.arange(len(nodes))
    own = np.where(source.comma_in >= 0, of[source.comma_in], -1) if len(of) else np.full(len(source.comma_in), -1)
    commas, at = own[own >= 0], source.comma_at[own >= 0]
    which, first = np.append(np.arange(len(nodes)), commas), np.append(source.open[nodes], at) + 1
    order = np.lexsort((first, which))
    which, first = which[order], first[order]
    last = np.append(first[1:] - 1, 0)
    ending = np.append(which[1:] != which[:-1], True)[: len(which)]
    last[ending] = source.close[nodes][which[ending]]
    first, last = source.after(first), source.before(last) + 1
    full = first < last
    return which[full], first[full], last[full]


def argument_structs(source: Source, first: np.ndarray, last: np.ndarray) -> pa.StructArray:
    """ARG of each element [first, last) of the text."""
    code, n = source.array, len(source.array)
    # A name and ``=`` or ``:`` before the value.
    named = _LETTER[code[first]] if len(first) else np.zeros(0, bool)
    stop = _first_outside(source.places("word"), first, n - 1)
    sign = source.after(stop)
    c, d = code[sign] if len(sign) else sign, code[np.minimum(sign + 1, n - 1)] if len(sign) else sign
    keyword = named & (sign < last - 1) & ((c == 61) & (d != 61) & (d != 62) | (c == 58) & (d != 58))
    value = np.where(keyword, source.after(sign + 1), first)
    keyword &= value < last
    value = np.where(keyword, value, first)
    k = np.minimum(np.searchsorted(source.strings[:, 0], value), max(len(source.strings) - 1, 0))
    literal = (source.strings[k, 0] == value) & (source.strings[k, 1] == last) if len(source.strings) else np.zeros(len(value), bool)
    body = (source.strings[k, 3], source.strings[k, 4]) if len(source.strings) else (value, value)
    signed = value + (code[value] == 45 if len(value) else 0)
    number = (signed < last) & (_first_outside(source.places("digit"), signed, n) >= last) & (last - signed <= 19)
    begin = value + (code[value] == 38 if len(value) else 0)
    name = (_LETTER[code[begin]] if len(begin) else np.zeros(0, bool)) & (_first_outside(source.places("path"), begin, n) >= last)
    open_ = _first_outside(source.places("callee"), value, n - 1)
    call = (open_ > value) & (open_ < last) & (code[open_] == 40 if len(open_) else False)
    call |= np.isin(value, source.start)
    texts = cut_text(source, value, last)
    whole = np.array([0 if not x else int(t) if abs(int(t)) < 2**63 else None for x, t in zip(number.tolist(), texts.to_pylist())], object) if number.any() else np.zeros(len(value), object)
    number &= np.array([x is not None for x in whole.tolist()], bool) & ~literal
    kind = np.select([literal, number, call, name], ["str", "int", "call", "name"], "other")
    nothing = pa.scalar(None, pa.string())
    values = pa.array([int(x) if ok else None for x, ok in zip(whole.tolist(), number.tolist())], pa.int64())
    strings = pc.if_else(pa.array(literal), cut_text(source, np.where(literal, body[0], value), np.where(literal, body[1], value)), nothing)
    words = pc.if_else(pa.array(keyword), cut_text(source, first, np.where(keyword, stop, first)), nothing)
    return pa.StructArray.from_arrays([pa.array(kind.astype(object), pa.string()), words, texts, strings, values], fields=list(ARG))


def _around(source: Source, sites: np.ndarray) -> list[list[str]]:
    """The frames of each call head."""
    node = source.node[sites]
    start, outer = source.start[sites], source.parent[node]
    chains = source.paths(outer)
    inside = outer >= 0
    paired = np.zeros(len(sites), bool)
    paired[inside] = source.pairs(outer[inside], start[inside])
    left, right = source.before(start), source.after(source.close[node] + 1)
    c, b = source.array, source.char(left - 1)
    compared = (source.char(left) == 61) & ((b == 61) | (b == 33)) & (left > 0)
    compared |= ((c[right] == 61) | (c[right] == 33)) & (c[np.minimum(right + 1, len(c) - 1)] == 61)
    assigned = (source.char(left) == 61) & ~compared
    out = []
    for i, k in enumerate(outer.tolist()):
        frames = list(chains.get(k, ()))
        if paired[i]:
            frames.insert(0, "pair")
        if compared[i]:
            frames.insert(0, "compare")
        if assigned[i] and source.declaring(int(left[i])):
            frames.append("declaration")
        out.append(frames)
    return out


def sites_of(source: Source) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The file of each call, and its columns."""
    sites = np.flatnonzero(source.called)
    node, start = source.node[sites], source.start[sites]
    callee = [source.callee[i].decode() for i in sites.tolist()]
    # The call around it, and the first call of its chain.
    head, owner = source.head.tolist(), source.headed().tolist()
    dot = source.before(source.start)
    chained = (source.char(dot) == 46) | (source.char(dot) == 58) & (source.char(dot - 1) == 58)
    joint = source.before(np.where(source.char(dot) == 46, dot - (source.char(dot - 1) == 63), dot - 1))
    chained &= source.char(joint) == 41
    closes, roots = source.closes, list(range(len(source.start)))
    for i in np.flatnonzero(chained).tolist():
        k = closes.get(int(joint[i]), -1)
        if k >= 0 and head[k] >= 0:
            roots[i] = roots[head[k]]
    scope = source.outermost("block")[node] if len(node) else node
    outside = scope < 0
    line_end = _first_outside(source.newlines, start, len(source.raw) - 1)
    file_end = np.append(source.file_at[1:], len(source.raw))[source.file_of(start)] - 1 if len(start) else start
    shown = np.minimum(np.minimum(line_end, file_end), start + SNIPPET)
    shown = _whole_characters(source, shown)
    which, first, last = arguments(source, node)
    counts = np.bincount(which, minlength=len(sites))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), argument_structs(source, first, last))
    name = lambda i: None if i < 0 else source.callee[head[i]].decode()
    generic = [None if not (g := source.generic[i]) else g[3:-1].decode() if g.startswith(b"::<") else g[1:-1].decode() for i in sites.tolist()]
    columns = {
        "callee": pa.array(callee, pa.string()), "args": lists.cast(pa.list_(ARG)), "line": pa.array(source.line_of(start), pa.int32()), "offset": pa.array(source.offset_of(start), pa.int32()),
        "snippet": pc.utf8_rtrim_whitespace(cut_text(source, start, shown)), "owner": pa.array([name(owner[k]) for k in node.tolist()], pa.string()), "generic": pa.array(generic, pa.string()),
        "root": pa.array([source.callee[roots[i]].decode() for i in sites.tolist()], pa.string()), "scope": pa.array(np.where(outside, -1, source.offset_of(np.where(outside, 0, source.open[scope]) if len(scope) else scope)), pa.int32()),
        "frames": pa.array(_around(source, sites), pa.list_(pa.string())),
    }
    return source.file_of(start), columns


def _whole_characters(source: Source, at: np.ndarray) -> np.ndarray:
    """Not inside a character: on to its end."""
    for _ in range(3):
        at = at + ((source.raw_array[np.minimum(at, len(source.raw) - 1)] & 0xC0) == 0x80)
    return at


def call_sites(files: DataFrame, imports: bool = False) -> DataFrame:
    """SITES of files (path, lang, content as text): calls only, not headers of functions, prototypes or patterns. With
    ``imports`` a bare callee that an import of its file explains stands under the imported name."""

    def run(batches):
        for batch in batches:
            for rows, source in texts_by_language(*batch.columns[:3]):
                file, columns = sites_of(source)
                own = pa.array(rows[file])
                if imports:
                    known = {int(r): dict(pairs) for r, pairs in zip(rows, batch.column(3).take(pa.array(rows)).to_pylist()) if pairs}
                    if known:
                        columns["callee"] = pa.array([known[r].get(c, c) if r in known else c for r, c in zip(rows[file].tolist(), columns["callee"].to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(columns[n] for n in ROW.names[2:])], schema=ROW)

    text = F.col("content").cast("string")
    more = [bindings(text, F.col("lang")).alias("names")] if imports else []
    return files.select("path", "lang", text.alias("content"), *more).mapInArrow(run, SITES)


def nth_string(args: Column, n: int) -> Column:
    a = F.try_element_at(args, F.lit(n + 1))
    return F.when(a["kind"] == "str", a["s"])


def nth_integer(args: Column, n: int) -> Column:
    a = F.try_element_at(args, F.lit(n + 1))
    return F.when(a["kind"] == "int", a["i"])


def nth_member(args: Column, n: int) -> Column:
    """Last segment of a dotted argument."""
    a = F.try_element_at(args, F.lit(n + 1))
    text = F.regexp_replace(a["text"], r"::<[^()]*>(?=\s*\()", "")
    return F.when(a["kind"].isin("name", "call"), F.regexp_extract(text, r"([A-Za-z_]\w*)\s*(?:\(.*)?$", 1))


def keyword(args: Column, name: str) -> Column:
    """The argument of that name (struct), else null."""
    return F.try_element_at(F.filter(args, lambda a: a["kw"] == name), F.lit(1))


def last_segments(callee: Column, n: int = 2) -> Column:
    """The last n segments of a ``::`` path."""
    parts = F.split(callee, "::")
    return F.array_join(F.slice(parts, -F.least(F.lit(n), F.size(parts)), n), "::")


def includes(content: Column) -> Column:
    """Targets of C and C++ #include lines."""
    return F.regexp_extract_all(content, F.lit(r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"]+)[>"]'), 1)


def with_api(sites: DataFrame, apis: DataFrame | None = None) -> DataFrame:
    """Sites whose callee the table (lang, kind, callee, api; by default the library's own) names, by key.

    A constructor is looked up among the kind ``new``, a method of a receiver ``subtle`` also among ``subtle``; a Rust path
    by its last two segments, else by its last.
    """
    apis = dims.callees(sites.sparkSession) if apis is None else apis
    apis = F.broadcast(apis.select("lang", "kind", F.col("callee").alias("key"), "api"))  # a fixed table
    new = F.col("callee").startswith("new ")
    rust = F.col("lang") == "rust"
    key = F.when(new, F.regexp_replace("callee", "^new ", "")).when(rust, last_segments(F.col("callee"))).otherwise(F.col("callee"))
    second = F.when(rust, last_segments(F.col("callee"), 1)).when(F.col("callee").rlike(r"(^|\.)subtle\.\w+$"), F.regexp_extract("callee", r"(\w+)$", 1))
    sites = sites.withColumns({"kind": F.when(new, "new").otherwise("call"), "key": key, "kind_2": F.when(rust, "call").otherwise("subtle"), "key_2": second})
    sites = sites.join(apis, ["lang", "kind", "key"], "left")
    sites = sites.join(apis.toDF("lang", "kind_2", "key_2", "api_2"), ["lang", "kind_2", "key_2"], "left")
    sites = sites.withColumn("api", F.coalesce("api", "api_2")).where("api IS NOT NULL")
    return sites.drop("kind", "key", "kind_2", "key_2", "api_2")


#: Go apis whose function's name says what is done, and those whose package's name is the parameter set.
GO_OPERATIONS = ["crypto/rsa.Op", "crypto/ecdsa.Op", "crypto/ed25519.Op", "crypto/dsa.Op", "crypto/mlkem.KeyOp", "crypto/mldsa.ParamSet", "circl/kem/xwing.Op", "crypto/x509.CertOp"]
GO_CURVES = ["X25519", "P256", "P384", "P521"]


def go_apis(sites: DataFrame) -> DataFrame:
    """Go sites with their api and what the callee says: pkg, fn and curve_fn (null where it says nothing)."""
    go = sites.where("lang = 'go'")
    owner, name = F.split_part("callee", F.lit("."), F.lit(1)), F.split_part("callee", F.lit("."), F.lit(2))
    curves = dims.local(sites.sparkSession, [("go", "call", f"ecdh.{c}", "crypto/ecdh.Curve") for c in GO_CURVES], "lang string, kind string, callee string, api string")
    both = with_api(go, dims.callees(sites.sparkSession).unionByName(curves))
    circl = F.col("api").startswith("circl/sign/mldsa") | F.col("api").startswith("circl/kem/mlkem")
    digest = F.col("callee").isin("md5.New", "md5.Sum", "sha1.New", "sha1.Sum")
    operation = F.col("api").isin(GO_OPERATIONS)
    return both.withColumns({"pkg": F.when(digest | circl, owner), "fn": F.when(circl | operation, name), "curve_fn": F.when(F.col("api") == "crypto/ecdh.Curve", name)})


#: Import paths of Go packages of post-quantum signatures, and the family each is of.
GO_PQ_FAMILIES = {"dilithium": "ML-DSA (circl dilithium)", "mldsa": "ML-DSA (circl mldsa)", "slhdsa": "SLH-DSA (circl slhdsa)"}


#: Fixed value: the sentence of a note, around the family and the line.
PQ_NOTE = (" This function also calls ", " at line ", " — the classical component alone is insufficient to forge a signature accepted by this code.")


def pq_notes(sites: DataFrame, files: DataFrame) -> DataFrame:
    """Classical signature operations among the sites (as of ``go_apis``) with ``pq_note``: what post-quantum signature the same function
    also makes or checks, empty where it does not. Joined by file and function; the first such call counts."""
    line = F.explode(F.regexp_extract_all("content", F.lit(r'(?m)^\s*(?:import\s+)?(?:\w+\s+)?"[^"]*circl/sign/(?:dilithium|mldsa|slhdsa)[^"]*"'), 0)).alias("text")
    imports = files.where("lang = 'go'").select("path", line)
    named, target = F.regexp_extract("text", r'^\s*(?:import\s+)?(\w+)\s+"', 1), F.regexp_extract("text", r'"([^"]+)"', 1)
    local = F.when((named != "") & (named != "import"), named).otherwise(F.element_at(F.split(target, "/"), -1))
    kind = F.regexp_extract(target, "circl/sign/(dilithium|mldsa|slhdsa)", 1)
    imports = imports.select("path", local.alias("local"), F.create_map(*[F.lit(x) for e in GO_PQ_FAMILIES.items() for x in e])[kind].alias("family"))
    calls = sites.where((F.col("lang") == "go") & F.col("callee").rlike(r"^\w+\.(Sign|Verify)\w*$") & (F.col("scope") >= 0)).withColumn("local", F.split_part("callee", F.lit("."), F.lit(1)))
    hits = calls.join(imports, ["path", "local"]).groupBy("path", "scope").agg(F.min_by(F.struct("family", "line"), "offset").alias("pq"))
    classical = go_apis(sites).where(F.col("api").isin("crypto/ed25519.Op", "crypto/ecdsa.Op"))
    note = F.concat(F.lit(PQ_NOTE[0]), "pq.family", F.lit(PQ_NOTE[1]), F.col("pq.line").cast("string"), F.lit(PQ_NOTE[2]))
    return classical.join(hits, ["path", "scope"], "left").withColumn("pq_note", F.coalesce(note, F.lit(""))).drop("pq")


#: JOSE algorithm names that a switch or a registration is looked for.
JOSE_NAMES = ["RS256", "RS384", "RS512", "PS256", "PS384", "PS512", "ES256", "ES384", "ES512", "EdDSA", "HS256", "HS384", "HS512", "none", "RSA-OAEP", "RSA-OAEP-256", "A256GCM", "A192GCM", "A128GCM"]


def kem_aliases(content: Column) -> Column:
    """Names under which a Python file imports ``KEM``."""
    lines = F.array_join(F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*from[ \t]+\S+[ \t]+import[ \t(]+[^\n]*"), 0), "\n")
    return F.regexp_extract_all(lines, F.lit(r"\bKEM\s+as\s+(\w+)"), 1)


def jar_signer_algorithms(files: DataFrame) -> DataFrame:
    """path, value, line: names given to ``signatureAlgorithm`` on a JarSigner.Builder: a fluent chain that begins with its
    constructor, or with a local variable that the file declares with this type."""
    sites = call_sites(files.where("lang = 'java'")).where(F.col("callee").rlike(r"(^|\.)signatureAlgorithm$"))
    declared = files.select("path", F.regexp_extract_all("content", F.lit(r"\bJarSigner\.Builder\s+(\w+)\s*[=;,]"), 1).alias("builders"))
    sites = sites.join(declared, "path").where((F.col("root") == "new JarSigner.Builder") | F.array_contains("builders", F.split_part("root", F.lit("."), F.lit(1))))
    return sites.select("path", nth_string(F.col("args"), 0).alias("value"), "line").where("value IS NOT NULL")


#: Callees that tell what a call among their arguments is there for, by kind.
MAP_INSERTS, COLLECTIONS, EQUALITY = ["put", "putAll", "putIfAbsent"], ["add", "addAll", "asList", "of", "contains", "containsAll", "remove"], ["equals", "equalsIgnoreCase"]
#: Test assertions by language.
ASSERTIONS = {
    "go": ["Equal", "Equals", "Equalf", "NotEqual", "True", "False", "Nil", "NotNil", "Empty", "NotEmpty", "Contains", "NotContains", "Error", "NoError", "ErrorIs", "ErrorContains", "EqualValues", "Same", "NotSame", "JSONEq", "ElementsMatch", "Len", "EqualError", "Regexp"],
    "java": ["assertEquals", "assertNotEquals", "assertTrue", "assertFalse", "assertNull", "assertNotNull", "assertThat", "assertSame", "assertArrayEquals"],
    "javascript": ["equal", "deepEqual", "strictEqual", "notEqual", "toBe", "toEqual", "toMatch", "toContain", "expect"],
    "python": ["assertEqual", "assertNotEqual", "assertTrue", "assertFalse", "assertIs", "assertIsNone", "assertIn", "assertRaises", "assertAlmostEqual"],
    "rust": ["assert_eq", "assert_ne", "assert", "debug_assert_eq", "debug_assert_ne"],
    "c": ["EXPECT_EQ", "ASSERT_EQ", "EXPECT_NE", "ASSERT_NE", "EXPECT_TRUE", "ASSERT_TRUE", "EXPECT_STREQ", "ASSERT_STREQ", "ExpectNull"],
    "csharp": ["Equal", "True", "False", "Same", "NotEqual", "AreEqual"],
}


def site_context(frames: Column, lang: Column, root: Column | None = None) -> Column:
    """What a site is there for, from the brackets around it: the first of map entry, test assertion, registry lookup,
    comparison, collection element, struct literal, call, constant, that any of them says; else Default."""
    head = lambda f: F.regexp_extract(f, r"([A-Za-z_]\w*)!?(?:<.*)?$", 1)
    is_call = lambda f: f.startswith("call:")
    around = lambda names: F.exists(frames, lambda f: is_call(f) & head(f).isin(names))
    asserted = F.lit(False)
    for own, names in ASSERTIONS.items():
        asserted = asserted | (lang.isin({"javascript": ["javascript", "typescript"], "c": ["c", "cpp"]}.get(own, [own])) & around(names))
    # A lookup whose result is itself an argument is not one.
    looked = F.exists(F.sequence(F.lit(1), F.greatest(F.size(frames), F.lit(1))), lambda i: F.coalesce(is_call(F.try_element_at(frames, i)) & F.lower(head(F.try_element_at(frames, i))).startswith("lookup") & ~F.coalesce(is_call(F.try_element_at(frames, i + 1)), F.lit(False)), F.lit(False)))
    has = lambda name: F.array_contains(frames, name)
    return (
        F.when(has("pair") | around(MAP_INSERTS), "MapEntry")
        .when(asserted, "TestAssertion")
        .when(looked, "RegistryLookup")
        .when(has("compare") | around(EQUALITY), "Comparison")
        .when(((lang == "java") & has("list")) | around(COLLECTIONS), "CollectionElement")
        .when(has("struct"), "StructLiteral")
        .when(F.exists(frames, is_call) & ~(F.try_element_at(frames, F.lit(1)) == "list"), "Call")
        .when(has("declaration") & ~has("list"), "StringConstant")
        .otherwise("Default")
    )


def with_context(sites: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``context`` (of ``site_context``, or TestAssertion where a test demands that the call fails)."""
    from .shapes import asserted_to_fail

    spans = asserted_to_fail(files).groupBy("path").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # of one file
    failing = F.coalesce(F.exists("spans", lambda x: (x["start"] <= F.col("offset")) & (F.col("offset") < x["stop"])), F.lit(False))
    context = F.when(failing, "TestAssertion").otherwise(site_context(F.col("frames"), F.col("lang")))
    return sites.join(spans, "path", "left").withColumn("context", context).drop("spans")


def bindings(content: Column, lang: Column) -> Column:
    """map<string, string>: names that a file imports on their own, and what they stand for (module.name)."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"#[^\n]*", ""), r"^\s+|\s+$", "")
    part = lambda text, sep: F.transform(F.split(F.regexp_replace(text, r"#[^\n]*", ""), ","), lambda x: F.split(bare(x), sep))

    def entries(lines, module, names, sep):
        def one(line):
            m = F.regexp_extract(line, module, 1)
            return F.transform(part(F.regexp_extract(line, names, 1), sep), lambda p: F.struct(F.element_at(p, -1).alias("key"), F.concat_ws(".", m, p[0]).alias("value")))

        return F.filter(F.flatten(F.transform(lines, one)), lambda e: e["key"] != "")

    line = entries(F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*from[ \t]+[\w.]+[ \t]+import[ \t]+[\w \t,]+"), 0), r"from\s+([\w.]+)", r"import\s+(.+)$", r"\s+as\s+")
    block = entries(F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*from[ \t]+[\w.]+[ \t]+import[ \t]*\([^)]*\)"), 0), r"from\s+([\w.]+)", r"(?s)import\s*\((.*)\)", r"\s+as\s+")
    python = F.concat(line, block)
    esm = entries(F.regexp_extract_all(content, F.lit(r"import\s*\{[^}]*\}\s*from\s*['\"][^'\"]+['\"]"), 0), r"from\s*['\"](?:node:)?([^'\"]+)", r"\{([^}]*)\}", r"\s+as\s+")
    cjs = entries(F.regexp_extract_all(content, F.lit(r"\{[^{}]*\}\s*=\s*require\(\s*['\"][^'\"]+['\"]"), 0), r"require\(\s*['\"](?:node:)?([^'\"]+)", r"\{([^}]*)\}", r"\s*:\s*")
    all_js = F.concat(esm, cjs)
    unique = lambda e: F.map_from_entries(F.filter(e, lambda x, i: ~F.exists(F.slice(e, 1, i), lambda y: y["key"] == x["key"])))
    return F.when(lang == "python", unique(python)).when(lang.isin("javascript", "typescript"), unique(all_js))


def resolved(sites: DataFrame, files: DataFrame) -> DataFrame:
    """Sites that were found without ``imports``, with those of their files: by a join."""
    names = files.select("path", bindings(F.col("content"), F.col("lang")).alias("names"))
    return sites.join(names, "path", "left").withColumn("callee", F.coalesce(F.col("names")[F.col("callee")], "callee")).drop("names")


#: Apis of sites that no callee names.
STRUCTURAL = [
    "crypto/ecdh.Curve", "crypto/tls.Config.CurvePreferences", "crypto/tls.Config.MinVersion", "crypto/tls.Certificate.SupportedSignatureAlgorithms", "crypto.MLDSAMu",
    "golang.org/x/crypto/ssh.Config.KeyExchanges", "javax.net.ssl.SSLParameters.setNamedGroups", "org.bouncycastle.tls.NamedGroup", "openssl.SSL_CTX_set1_groups_list",
    "rustls.CryptoProvider.kx_groups", "openmls.Ciphersuite", "rustls.SignatureScheme", "liboqs-go/oqs.KeyEncapsulation", "liboqs-go/oqs.Signature",
    "javax.crypto.KEM.newEncapsulator", "javax.crypto.KEM.newDecapsulator", "java.security.JarSigner.Builder.signatureAlgorithm",
]


def surface(spark: SparkSession) -> DataFrame:
    """Every api that can be emitted, once, in order: of the callee tables, of other shapes, and two a JOSE name."""
    rest = STRUCTURAL + [f"go.alg-{k}.{x}" for x in JOSE_NAMES for k in ("switch", "register")]
    return dims.callees(spark).select("api").unionByName(dims.local(spark, [(x,) for x in rest], "api string")).distinct().orderBy("api")


def nth_attribute(args: Column, n: int, objects: Column, within: str | None = None) -> Column:
    """Member of a dotted argument whose object is one of ``objects`` (array), or, one level down, named ``within``."""
    a = F.try_element_at(args, F.lit(n + 1))
    owner, member = F.regexp_extract(a["text"], r"^(.*)\.\w+$", 1), F.regexp_extract(a["text"], r"\.(\w+)$", 1)
    fits = F.array_contains(objects, owner) if within is None else F.array_contains(objects, owner) | (owner == within) | owner.rlike(rf"^\w+\.{within}$")
    return F.when((a["kind"] == "name") & fits, member)


def property_of(args: Column, n: int, key: str) -> Column:
    """A string property of an object argument; a nested object gives its ``name``."""
    text = F.try_element_at(args, F.lit(n + 1))["text"]
    plain = F.regexp_extract(text, rf"['\"]?\b{key}['\"]?\s*:\s*['\"]([^'\"]+)['\"]", 1)
    nested = F.regexp_extract(text, rf"['\"]?\b{key}['\"]?\s*:\s*\{{[^}}]*\bname['\"]?\s*:\s*['\"]([^'\"]+)['\"]", 1)
    return F.coalesce(F.nullif(plain, F.lit("")), F.nullif(nested, F.lit("")))


def literal_or_symbol(args: Column, n: int) -> Column:
    """struct(literal, symbol): the string literal, else the name of the variable; the other field is null."""
    a = F.try_element_at(args, F.lit(n + 1))
    return F.struct(F.when(a["kind"] == "str", a["s"]).alias("literal"), F.when(a["kind"] == "name", a["text"]).alias("symbol"))


def passes(args: Column, name: str) -> Column:
    """Whether any argument is that dotted name."""
    return F.exists(args, lambda a: a["text"] == name)


def captures(sites: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``captured`` (map of name to struct<i, s>) to sites with an api. The table (lang, api, slot, extractor, name;
    extractors string, integer, member, keyword) is small, is grouped by api and joined by key; a capture that an argument
    does not fit is left out."""
    rules = table.groupBy("lang", "api").agg(F.collect_list(F.struct("slot", "extractor", "name")).alias("rules"))  # a few an api

    def value(r):
        a = F.try_element_at(F.col("args"), r["slot"] + 1)
        k = F.try_element_at(F.filter("args", lambda x: x["kw"] == r["name"]), F.lit(1))
        text = F.when((r["extractor"] == "string") & (a["kind"] == "str"), a["s"])
        text = text.when((r["extractor"] == "member") & a["kind"].isin("name", "call"), F.regexp_extract(a["text"], r"([A-Za-z_]\w*)\s*(?:\(.*)?$", 1))
        text = text.when(r["extractor"] == "keyword", F.coalesce(k["s"], F.when(k["kind"] == "name", k["text"])))
        number = F.when((r["extractor"] == "integer") & (a["kind"] == "int"), a["i"]).when(r["extractor"] == "keyword", k["i"])
        return F.struct(r["name"].alias("key"), F.struct(number.alias("i"), text.alias("s")).alias("value"))

    entries = F.filter(F.transform("rules", value), lambda e: e["value"]["i"].isNotNull() | e["value"]["s"].isNotNull())
    return sites.join(rules, ["lang", "api"], "left").withColumn("captured", F.map_from_entries(F.coalesce(entries, F.array().cast("array<struct<key:string,value:struct<i:bigint,s:string>>>")))).drop("rules")
