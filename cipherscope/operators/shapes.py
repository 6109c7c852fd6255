"""What no callee names: settings that list algorithms, literals of switches and registrations, members, composite literals,
spans that a test wants to fail. All are read off the node table of ``functions.nodes``, so comments and other literals
count for nothing and no place is judged by a fixed number of characters around it."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nodes import Source
from .extract import JOSE_NAMES, arguments, texts_by_language


def _spread(files: DataFrame, langs: tuple, rows_of, schema: str) -> DataFrame:
    """path, lang and the columns of ``schema``: a row for each tuple (place, *values) that ``rows_of(source)`` yields, in
    files of these languages; the place becomes the file and its line."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for rows, source in texts_by_language(*batch.columns):
                found = list(rows_of(source))
                if not found:
                    continue
                at = np.array([f[0] for f in found], np.int64)
                own = pa.array(rows[source.file_of(at)])
                values = [pa.array([f[i + 1] for f in found], pa.string()) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *values, pa.array(source.line_of(at), pa.int32()), pa.array(source.offset_of(at), pa.int32())], ["path", "lang", *names, "line", "offset"])

    own = files.where(F.col("lang").isin(*langs)).select("path", "lang", F.col("content").cast("string").alias("content"))
    return own.mapInArrow(run, f"path string, lang string, {schema}, line int, offset int")


class _Reader:
    """Elements and literals of a source by place."""

    def __init__(self, source: Source):
        self.source, self.code = source, source.code
        self.string_at = {int(s[0]): s for s in source.strings}
        self.heads = {}
        for i in np.flatnonzero(source.called).tolist():
            self.heads.setdefault(source.callee[i].decode(), []).append(i)

    def elements(self, node: int) -> list[tuple[int, int]]:
        _, first, last = arguments(self.source, np.array([node]))
        return list(zip(first.tolist(), last.tolist()))

    def string(self, element: tuple[int, int]) -> str | None:
        s = self.string_at.get(element[0])
        return None if s is None or s[1] != element[1] else self.source.raw[s[3] : s[4]].decode()

    def node_at(self, place: int) -> int:
        k = int(np.searchsorted(self.source.open, place))
        return k if k < len(self.source.open) and self.source.open[k] == place else -1

    def calls(self, pattern: str):
        """(head, elements) of calls whose callee matches."""
        for callee, heads in self.heads.items():
            if re.fullmatch(pattern, callee):
                for i in heads:
                    yield i, self.elements(int(self.source.node[i]))

    def new_array(self, element: tuple[int, int]) -> list[tuple[int, int]] | None:
        """The elements of ``new T[] {...}``."""
        m = re.compile(rb"new\s+[\w.]+\s*\[\s*\]\s*\{").match(self.code, element[0])
        return self.elements(self.node_at(m.end() - 1)) if m else None


#: Constants of Go's ssh package and the names they stand for.
SSH_EXCHANGES = {"KeyExchangeMLKEM768X25519": "mlkem768x25519-sha256", "KeyExchangeCurve25519": "curve25519-sha256", "KeyExchangeECDHP256": "ecdh-sha2-nistp256", "KeyExchangeECDHP384": "ecdh-sha2-nistp384", "KeyExchangeECDHP521": "ecdh-sha2-nistp521"}
#: Keys of Go's composite literals, the list type of their value (none: a single constant) and their apis.
GO_KEYS = {
    "MinVersion": (None, "crypto/tls.Config.MinVersion"),
    "CurvePreferences": ("tls.CurveID", "crypto/tls.Config.CurvePreferences"),
    "SupportedSignatureAlgorithms": ("tls.SignatureScheme", "crypto/tls.Certificate.SupportedSignatureAlgorithms"),
    "KeyExchanges": ("string", "golang.org/x/crypto/ssh.Config.KeyExchanges"),
}
#: Apis of the settings of other languages.
NAMED_GROUPS, BC_GROUPS, SSL_GROUPS = "javax.net.ssl.SSLParameters.setNamedGroups", "org.bouncycastle.tls.NamedGroup", "openssl.SSL_CTX_set1_groups_list"
KX_GROUPS, SIGNATURE_SCHEME, CIPHERSUITE = "rustls.CryptoProvider.kx_groups", "rustls.SignatureScheme", "openmls.Ciphersuite"
KEM_OPERATIONS = {"newEncapsulator": "javax.crypto.KEM.newEncapsulator", "newDecapsulator": "javax.crypto.KEM.newDecapsulator"}

_GO_KEY = re.compile(rb"(?<![\w.])(" + "|".join(GO_KEYS).encode() + rb")\s*:(?![:=])\s*")
_GO_VALUE = re.compile(rb"tls\.(\w+)")
_GO_LIST = re.compile(rb"\[\s*\]\s*([\w.]+)\s*\{")
_KX_FIELD = re.compile(rb"(?<![\w.])kx_groups\s*:\s*(?:vec!)?\s*&?\s*\[|(?:const|static)\s+\w*KX_GROUPS\w*\s*:[^=;]*=\s*&?\s*\[")
_RUST_MEMBER = re.compile(rb"(?<!\w)(rustls_post_quantum::DEFAULT_PROVIDER|SignatureScheme::(ML_DSA_\d+)|Ciphersuite::(\w*(?:MLKEM|XWING)\w*))\b")


def _go_settings(r: _Reader):
    for m in _GO_KEY.finditer(r.code):
        element, api = GO_KEYS[m[1].decode()]
        if element is None:
            if v := _GO_VALUE.match(r.code, m.end()):
                yield v.start(), api, v[1].decode()
            continue
        v = _GO_LIST.match(r.code, m.end())
        if not v or v[1].decode() != element:
            continue
        for a, b in r.elements(r.node_at(v.end() - 1)):
            text = r.string((a, b))
            if element == "string" and text is None:
                name = re.fullmatch(rb"ssh\.(\w+)", r.code[a:b])
                text = name and SSH_EXCHANGES.get(name[1].decode(), None if name[1].startswith(b"KeyExchange") else name[1].decode())
            elif element != "string":
                name = _GO_VALUE.fullmatch(r.code, a, b)
                text = name and name[1].decode()
            if text:
                yield a, api, text


def _java_settings(r: _Reader):
    for i, args in r.calls(r"(?:.*\.)?setNamedGroups"):
        for e in (r.new_array(args[0]) or [] if args else []):
            if (text := r.string(e)) is not None:
                yield e[0], NAMED_GROUPS, text
    for i, args in r.calls(r"System\.setProperty"):
        if len(args) == 2 and r.string(args[0]) == "jdk.tls.namedGroups" and r.string(args[1]) is not None:
            for part in r.string(args[1]).split(","):
                if part.strip():
                    yield args[1][0], NAMED_GROUPS, part.strip()
    for i, args in r.calls(r"TlsUtils\.addIfSupported"):
        for a, b in (r.new_array(args[2]) or [] if len(args) == 3 else []):
            if name := re.fullmatch(rb"(?:[\w.]+\.)?(\w+)", r.code[a:b]):
                yield a, BC_GROUPS, name[1].decode()
    for i, _ in r.calls(r"(?:.*\.)?(?:newEncapsulator|newDecapsulator)"):
        yield int(r.source.start[i]), KEM_OPERATIONS[r.source.callee[i].decode().rpartition(".")[2]], ""


def _c_settings(r: _Reader):
    for i, args in r.calls(r"SSL_(?:CTX_)?set1_groups_list|SSL_CONF_cmd"):
        name = r.source.callee[i]
        at = 2 if name == b"SSL_CONF_cmd" else 1
        if len(args) <= at or at == 2 and (r.string(args[1]) or "").lower() not in ("groups", "curves"):
            continue
        for part in re.split("[:/]", r.string(args[at]) or ""):
            part = part.lstrip("*?-")
            if part and part != "DEFAULT":
                yield args[at][0], SSL_GROUPS, part


def _rust_settings(r: _Reader):
    for m in _KX_FIELD.finditer(r.code):
        for a, b in r.elements(r.node_at(m.end() - 1)):
            if name := re.search(rb"(\w+)\s*\Z", r.code[a:b]):
                yield a, KX_GROUPS, name[1].decode()
    for m in _RUST_MEMBER.finditer(r.code):
        if m[2] or m[3]:
            yield m.start(), SIGNATURE_SCHEME if m[2] else CIPHERSUITE, (m[2] or m[3]).decode()
        else:
            yield m.start(), KX_GROUPS, "X25519MLKEM768"


_SETTINGS = {"go": _go_settings, "java": _java_settings, "c": _c_settings, "cpp": _c_settings, "rust": _rust_settings}


def listed_settings(files: DataFrame) -> DataFrame:
    """path, lang, api, value, line, offset: a row for each element that a setting lists, under the api that rules know; a KEM
    operation, which lists nothing, has an empty value."""
    return _spread(files, tuple(_SETTINGS), lambda s: _SETTINGS[s.lang](_Reader(s)), "api string, value string")


_OPENING = re.compile(rb"\b(?:const|var)\s*\Z")
_SWITCH, _ENDING, _ENDED = re.compile(rb"\bswitch\b"), re.compile(rb"(\w+)\s*\Z"), re.compile(rb"[ \t]*[,)}\n;:\0]")
_SINGLE = re.compile(rb"(?:\A|\n)\s*(?:const|var)\s+\w+[^({\n]*=\s*\Z")


def _jose(source: Source):
    """(place, kind, value, snippet) of JOSE names that a case begins with, or that are registered; ``none``, also a plain
    word, only where the nearest bracket that declares names together holds another one."""
    code, names, seen, held = source.code, {n.encode(): n for n in JOSE_NAMES}, [], set()
    rows = [(*s, names[v]) for s in source.strings.tolist() if (v := source.raw[s[3] : s[4]]) in names and source.raw[s[0]] != 39]
    if not rows:
        return
    starts = np.array([r[0] for r in rows], np.int64)
    before, inner = source.before(starts).tolist(), (np.searchsorted(source.open, starts) - 1).tolist()
    k = np.searchsorted(source.ends, starts) - 1
    begins = np.where(k >= 0, source.ends[np.maximum(k, 0)] + 1 if len(source.ends) else 0, 0).tolist()
    file_ends = np.append(source.file_at[1:] - 1, len(code) - 1)[source.file_of(starts)].tolist()
    opens, closes, parents = source.open.tolist(), source.close.tolist(), source.parent.tolist()
    kinds: dict[int, tuple[bool, bool]] = {}  # of a bracket: declares names together, is a switch

    def kind_of(node: int) -> tuple[bool, bool]:
        if node not in kinds:
            at = opens[node]
            if code[at] == 123:
                head = code[max(code.rfind(b"{", 0, at), code.rfind(b"}", 0, at), code.rfind(b"\0", 0, at)) + 1 : at]
                kinds[node] = True, b"switch" in head and bool(_SWITCH.search(head))
            else:
                kinds[node] = code[at] == 40 and bool(_OPENING.search(code, source.statement(at), at)), False
        return kinds[node]

    for i, (start, stop, _, _, _, value) in enumerate(rows):
        k, scopes, switch = inner[i], [], False
        while k >= 0 and closes[k] < start:
            k = parents[k]
        while k >= 0:
            scope, chosen = kind_of(k)
            if scope:
                scopes.append(opens[k])
            switch |= chosen
            k = parents[k]
        scopes.reverse()
        part = code[begins[i] : start]
        if (b"const" in part or b"var" in part) and _SINGLE.search(part):
            scopes.append(start)
        word = _ENDING.search(part)
        word = word[1] if word else b""
        if word == b"case":
            at = begins[i] + part.rindex(b"case")
            line = source.raw.find(b"\n", at)
            seen.append((at, "switch", value, source.raw[at : min(line if line >= 0 else file_ends[i], file_ends[i])].decode("utf-8", "replace"), scopes))
            continue
        c = code[before[i] : before[i] + 1] if before[i] >= 0 else b""
        prior = code[before[i] - 1 : before[i]] if before[i] > 0 else b""
        valued = c and c in b"{(," or c == b"=" and prior not in (b"=", b"!", b"<", b">") or c == b":" and prior != b":" or word == b"return"
        if not switch and valued and _ENDED.match(code, stop):
            seen.append((start, "register", value, source.raw[start:stop].decode("utf-8", "replace"), scopes))
    for _, _, value, _, scopes in seen:
        if value != "none":
            held.update(scopes)
    for at, kind, value, snippet, scopes in seen:
        if value != "none" or scopes and scopes[-1] in held:
            yield at, kind, value, snippet


def jose_names(files: DataFrame) -> DataFrame:
    """path, api, value, line, offset, snippet: JOSE names that Go files switch on or register, decided in the scan of their
    file."""
    found = _spread(files, ("go",), _jose, "kind string, value string, snippet string")
    api = F.concat(F.when(F.col("kind") == "switch", "go.alg-switch.").otherwise("go.alg-register."), "value")
    return found.select("path", api.alias("api"), "value", "line", "offset", "snippet")


def constants(files: DataFrame, owners: list[str], langs: tuple = ("java", "csharp", "javascript", "typescript", "python", "go", "rust", "c", "cpp")) -> DataFrame:
    """path, lang, owner, member, line: each ``Owner.MEMBER`` or ``Owner::MEMBER`` of the named owners outside a longer name."""
    pattern = re.compile(rb"(?<![\w.:])(" + "|".join(map(re.escape, owners)).encode() + rb")\s*(?:\.|::)\s*([A-Z]\w*)")
    return _spread(files, langs, lambda s: ((m.start(), m[1].decode(), m[2].decode()) for m in pattern.finditer(s.code)), "owner string, member string")


def composites(files: DataFrame, types: list[str]) -> DataFrame:
    """path, lang, type, line: each composite literal ``pkg.Type{`` of the named types in Go files."""
    pattern = re.compile(rb"(?<![\w.])(" + "|".join(map(re.escape, types)).encode() + rb")\s*\{")
    return _spread(files, ("go",), lambda s: ((m.start(), m[1].decode()) for m in pattern.finditer(s.code)), "type string")


def foreign_keys(files: DataFrame, package: str, constructors: list[str]) -> DataFrame:
    """path, foreign: for each Go file that imports a package, true where it never constructs with it (its keys come from
    elsewhere)."""
    names = [c.encode() for c in constructors]

    def rows(s: Source):
        made = set(s.file_of(s.start[[i for i in np.flatnonzero(s.called).tolist() if s.callee[i] in names]]).tolist())
        known = set()
        for row in s.strings.tolist():
            if s.raw[row[3] : row[4]] == package.encode() and re.search(rb"\bimport\b[^;{}]*\Z", s.code[s.statement_of_import(row[0]) : row[0]]):
                file = int(s.file_of(np.array([row[0]]))[0])
                if file not in known:
                    known.add(file)
                    yield row[0], "own" if file in made else "foreign"

    return _spread(files, ("go",), rows, "what string").select("path", (F.col("what") == "foreign").alias("foreign"))


_RAISES = re.compile(rb"(?m)^([ \t]*)with\b")
_FAILS = re.compile(r"(?:.*\.)?(?:throw|toThrow|toThrowError)")


def _failing(source: Source):
    """(start, stop) of the only statement of a ``with ...raises(...)`` block, or of the body of a function that
    ``expect(...)`` wants to throw."""
    code = source.code
    if source.lang == "python":
        inside = np.sort(np.concatenate([source.open, source.close]))
        level = np.where(np.isin(inside, source.open), 1, -1)
        depth = np.cumsum(level)

        def free(at: int, char: bytes) -> int:
            """The next such character outside of brackets opened after ``at``."""
            base = depth[k - 1] if (k := int(np.searchsorted(inside, at))) else 0
            while (at := code.find(char, at)) >= 0:
                k = int(np.searchsorted(inside, at))
                if (depth[k - 1] if k else 0) <= base:
                    return at
                at += 1
            return -1

        for m in _RAISES.finditer(code):
            colon = free(m.end(), b":")
            if colon < 0 or not re.search(rb"raises\s*\(", code[m.end() : colon], re.I):
                continue
            first = int(source.after(np.array([colon + 1]))[0])
            line = code.rfind(b"\n", 0, first) + 1
            stop = free(first, b"\n")
            stop = code.find(b"\0", first) if stop < 0 else stop
            following = re.compile(rb"(?:[ \t\r]*\n)*([ \t]*)(?=\S|\Z)").match(code, stop + 1)
            if line > colon and len(code[line:first]) <= len(m[1]) or line > colon and code[first] and following and code[following.end() : following.end() + 1] not in (b"", b"\0") and len(following[1]) > len(m[1]):
                continue
            yield first, stop
        return
    closes = source.closes
    for i in np.flatnonzero(source.called).tolist():
        if not _FAILS.fullmatch(source.callee[i].decode()):
            continue
        # Back along the chain to expect(...)
        at = int(source.before(source.start[i : i + 1])[0])
        while at >= 0 and code[at] in b".":
            at = int(source.before(np.array([at]))[0])
            while at >= 0 and code[at : at + 1].isalnum():  # .to, .rejects
                at -= 1
            at = int(source.before(np.array([at + 1]))[0]) if at >= 0 else -1
        node = closes.get(at, -1)
        if node < 0 or source.head[node] < 0 or source.callee[source.head[node]] != b"expect":
            continue
        _, first, last = arguments(source, np.array([node]))
        m = re.compile(rb"(?:async\s*)?(?:\([^()]*\)|\w+)\s*=>\s*").match(code, int(first[0])) if len(first) else None
        if m:
            body = code[m.end() : int(last[0])].strip()
            if body.startswith(b"{"):
                body = body[1:-1].strip().rstrip(b";")
            if b";" not in body and b"{" not in body:
                yield m.end(), int(last[0])


def asserted_to_fail(files: DataFrame) -> DataFrame:
    """path, start, stop (characters) of the spans in which a test demands failure; sites inside them are assertions."""

    def run(batches):
        for batch in batches:
            for rows, source in texts_by_language(*batch.columns):
                spans = np.array(list(_failing(source)), np.int64).reshape(-1, 2)
                if len(spans):
                    own = pa.array(rows[source.file_of(spans[:, 0])])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), pa.array(source.offset_of(spans[:, 0]), pa.int32()), pa.array(source.offset_of(spans[:, 1]), pa.int32())], ["path", "start", "stop"])

    own = files.where(F.col("lang").isin("python", "javascript", "typescript")).select("path", "lang", F.col("content").cast("string").alias("content"))
    return own.mapInArrow(run, "path string, start int, stop int")


def nodes(files: DataFrame) -> DataFrame:
    """The node table itself: path, lang, pre, post (places of its brackets, in characters: a node lies in another where its
    interval does), kind, callee, parent (pre of the node around it, -1), line, declares (a header, not a call)."""

    def run(batches):
        for batch in batches:
            for rows, source in texts_by_language(*batch.columns):
                if not len(source.open):
                    continue
                own, head = pa.array(rows[source.file_of(source.open)]), source.head
                callee = [source.callee[i].decode() if i >= 0 else None for i in head.tolist()]
                declares = np.where(head >= 0, ~source.called[np.maximum(head, 0)] if len(source.called) else False, False)
                outer = np.where(source.parent >= 0, source.offset_of(source.open[np.maximum(source.parent, 0)]), -1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(source.offset_of(source.open), pa.int32()), pa.array(source.offset_of(source.close), pa.int32()), pa.array(source.kind, pa.string()), pa.array(callee, pa.string()), pa.array(outer, pa.int32()), pa.array(source.line_of(source.open), pa.int32()), pa.array(declares)], ["path", "lang", "pre", "post", "kind", "callee", "parent", "line", "declares"])

    return files.select("path", "lang", F.col("content").cast("string").alias("content")).mapInArrow(run, "path string, lang string, pre int, post int, kind string, callee string, parent int, line int, declares boolean")
