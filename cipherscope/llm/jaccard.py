"""N-gram Jaccard join: documents whose sets of word shingles overlap by at least a share, as classes and components.

Texts with equal sets form a class, which its smallest doc_id stands for. Shingles are ordered rare first by a counting
sketch over all documents (any order that all share gives the same links; rare first keeps prefixes apart). With
similarity s a set of n needs only its first n - ceil(s * n) + 1 shingles, its prefix, to meet every partner; entries
(shingle, document, size, place) are shuffled by shingle and those that meet nobody are dropped.

Links are verified once a pair, in two waves, so that a large group of near copies is never expanded into its pairs:

* every entry is compared with its bucket's pivot, the member whose prefix is most common (an original among its edited
  copies); buckets of very common shingles are salted into parts, whose pivots are compared in turn; verified links give
  first components;
* all pairs of a bucket that lie in different components are compared then, so that no link between components is
  missed: components are exact.

Verification first compares the two sets' parities, a bit a shingle, and drops pairs that differ in more parts than links
may. Of the others it sends each text once a pair that it is a member of, and a pivot's text once for PAIRS of its pairs:
rows are sorted by pivot and streamed, whatever a pivot's number of pairs. Texts of no such pair stay where they are. In
the second wave a bucket of many members is salted too: its rows are dealt into tiles, and rows outside the main component
meet every tile.

Pairs are dropped by length (sizes), by place (what can still match behind and before the shared shingle), and by suffix
bounds (both sets partitioned by hash: in a part whose counts differ, at least that many shingles do), before sets are
intersected. All but the parities are conditions of the join itself. Sets are made from whole texts.

Words are runs of other than space and \\x09-\\x0D, A-Z lower-cased; fewer words than a shingle count as one shingle.
Defined results: a null text or one without words has an empty set, links with nothing; a null doc_id sorts first (a
component whose smallest member is one has a null component_id); each text of a doc_id, also of the null, is a node of its
own, and the nodes of a doc_id are linked with each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, discard, light, stage
from .components import components
from .scan import doc_slices, mix, run_hashes, text_bytes

#: Counters of the sketch (its size is the same at any scale), and counters a row while it is summed.
COUNTERS, ROW = 1 << 20, 1 << 14
#: Documents (by the sketch) that one part of a shingle's bucket may hold; the buckets of commoner shingles are salted.
HOT = 20_000
#: Pairs of one pivot that go to a task together.
PAIRS = 500
#: Rows of documents to verify up to which they are broadcast, so that the texts of all others stay where they are.
BROADCAST_ROWS = 100_000
NONE = -(2**63)
#: Where the rows to verify are more: bits of the filter by doc that tells most texts of no pair.
FILTER_BITS = 23
#: Parts of the suffix bound's partition in the join, 64 to a column; parities have more where a set is larger.
PARTS = 512
SIGNS = [f"sign_{i}" for i in range(PARTS // 64)]
STEPS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document buf[offsets[i]:offsets[i + 1]]."""
    docs = len(offsets) - 1
    low = np.where((buf >= 65) & (buf <= 90), buf | 32, buf)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    first = ~blank
    first[1:] &= blank[:-1]
    edges = offsets[:-1][offsets[:-1] < len(buf)]
    first[edges] = ~blank[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * docs
    stops = np.flatnonzero(np.append(blank | first, True))
    h = run_hashes(low, starts, stops[np.searchsorted(stops, starts, side="right")])
    m = max(len(h) - words + 1, 0)
    grams = np.zeros(m, np.uint64)
    for i in range(words):
        grams = mix(grams * STEPS[i % 5] + h[i : i + m])
    edge = np.searchsorted(starts, offsets)
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a >= words:
            own = np.sort(grams[a : b - words + 1])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            out.append(own[keep])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for i in range(a, b):
                x = mix(x * STEPS[4] + h[i])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(n: int, percent: int) -> int:
    """ceil(percent * n / 100): what a set of n must share with any partner."""
    return -(-percent * n // 100)


def overlap_needed(a: int, b: int, percent: int) -> int:
    """The least intersection with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    least = overlap_needed(len(x), len(y), percent)
    if min(len(x), len(y)) < least:
        return False
    if min(len(x), len(y)) > 32:  # suffix bound: parts of equal hash ranges differ by at least their sizes' difference
        cuts = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
        a, b = (np.diff(np.searchsorted(s, cuts), prepend=0, append=len(s)) for s in (x, y))
        if int(np.abs(a - b).sum()) > len(x) + len(y) - 2 * least:
            return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) >= least


def parity(s: np.ndarray) -> np.ndarray:
    """Which parts of the set, partitioned by hash, have an odd count: bits in a power of two of bytes, a bit a shingle at
    least. Sets whose parities differ in k parts differ in k shingles at least."""
    parts = max(PARTS, 1 << max(len(s) - 1, 0).bit_length())
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (parts - 1), minlength=parts) & 1
    return np.packbits(odd.astype(np.uint8))


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The parity of the same set in fewer parts, ``size`` bytes."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def signs(bits: np.ndarray) -> np.ndarray:
    """A parity in PARTS parts as longs."""
    return folded(bits, PARTS // 8).view(np.int64)


def may_link(x: np.ndarray, m: int, y: np.ndarray, n: int, percent: int) -> bool:
    """Whether sets of m and n shingles with these parities may be similar."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= m + n - 2 * overlap_needed(m, n, percent)


def _sketch(rows: DataFrame) -> np.ndarray:
    """Sums the tasks' counters: rows of ROW counters, in two steps so that no group grows with the number of tasks squared."""

    def add(key, table):
        total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in table.column("counters").to_pylist())
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "counters": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    parts = rows.groupBy("row", F.pmod(F.xxhash64("task"), F.lit(64)).alias("share")).applyInArrow(add, "row int, counters binary")
    out = np.zeros(COUNTERS, np.uint32)
    for r in parts.groupBy("row").applyInArrow(add, "row int, counters binary").collect():  # COUNTERS * 4 bytes
        out[r.row * ROW : (r.row + 1) * ROW] = np.frombuffer(r.counters, np.uint32)
    return out


def _likely(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (member, pivot) that their parities do not tell apart, as a written table."""
    own = members.select("doc", "n", "parity")
    rows = pairs.join(own.toDF("member", "m", "x"), "member").join(own.toDF("pivot", "n", "y"), "pivot")

    def check(batches):
        for batch in batches:
            m, n = (batch.column(c).to_pylist() for c in (1, 4))
            x, y = ([np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column(c)] for c in (2, 5))
            keep = pa.array([may_link(*row, percent) for row in zip(x, m, y, n)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 3)], ["member", "pivot"])

    rows = rows.select("member", "m", "x", "pivot", "n", "y")
    return stage(rows.mapInArrow(light(check), "member long, pivot long"), "jaccard-likely")


def _among(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` and few others: a filter of 2**FILTER_BITS bits by a hash, 64 to a row, whatever the number of
    docs, so that most other texts are not shuffled."""
    bit = F.shiftright(F.xxhash64("doc"), 64 - FILTER_BITS)
    place, mask = F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    bits = docs.select(place.alias("place"), mask.alias("mask")).groupBy("place").agg(F.bit_or("mask").alias("bits"))
    return texts.join(F.broadcast(bits), (place == F.col("place")) & (F.col("bits").bitwiseAND(mask) != 0), "left_semi")


def _verify(pairs: DataFrame, members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (member, pivot) whose sets are similar, as a < b. Texts travel, not sets: they are smaller and their sets
    quickly made. ``texts`` (doc, text) and ``members`` have a row a document."""
    pairs = _likely(pairs, members, percent)
    few = 2 * pairs.count() <= BROADCAST_ROWS
    many = stage(pairs.groupBy("pivot").count().where(F.col("count") > PAIRS).select(F.col("pivot").alias("p"), F.ceil(F.col("count") / PAIRS).alias("parts")), "jaccard-pivots")
    pairs = pairs.join(many, F.col("pivot") == F.col("p"), "left")
    part = F.coalesce(F.pmod(F.xxhash64("member"), F.col("parts")), F.lit(0).cast("long"))
    pairs = pairs.select("member", "pivot", part.alias("part"))
    sides = pairs.select(F.col("member").alias("doc"), "pivot", "part", F.lit(1).alias("role"))
    sides = sides.unionByName(pairs.select(F.col("pivot").alias("doc"), "pivot", "part", F.lit(0).alias("role")).distinct())
    rows = texts.join(F.broadcast(sides), "doc") if few else _among(texts, sides).join(sides, "doc")
    rows = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "role").select("pivot", "part", "role", "doc", "text")

    def check(batches):
        key, head = None, None
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                buf, offsets = text_bytes(batch.column(4))
                sets = [x for a, b in doc_slices(offsets, SLICE_BYTES) for x in shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)]
                out = []
                for own, pivot, part, role, doc in zip(sets, *(batch.column(c).to_pylist() for c in range(4))):
                    if role == 0:
                        key, head = (pivot, part), own
                    elif key == (pivot, part) and similar(head, own, percent):
                        out.append((min(doc, pivot), max(doc, pivot)))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(2)], ["a", "b"])

    return rows.mapInArrow(light(check), "a long, b long").distinct()


def _size(pack):
    return F.shiftright(pack, 28).bitwiseAND((1 << 28) - 1)


def _place(pack):
    return F.col(pack).bitwiseAND((1 << 28) - 1)


def _overlap_needed(m, n, percent: int):
    return F.floor(((m + n) * percent + 99 + percent) / (100 + percent))


def _may_link(m, i, n, j, percent: int):
    """Length and place: m, n sizes; the shared shingle is the i-th and j-th of them, min(i, j) may match before it."""
    least = _overlap_needed(m, n, percent)
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & (F.least(i, j) + 1 + F.least(m - i - 1, n - j - 1) >= least)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """doc, n_shingles, class_id (smallest doc with the same set), component of every row of ``docs`` (doc, text), whose
    doc is a long of its own in each row."""
    texts = docs.select("doc", "text")

    def measure(batches):
        counts, task = np.zeros(COUNTERS, np.uint32), None
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            ns, keys, odd = [], [], []  # odd: parities
            for a, b in doc_slices(offsets, SLICE_BYTES):
                sets = shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                ns += map(len, sets)
                keys += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                odd += map(parity, sets)
                counts += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            task = task if task is not None else hash((ns[0], keys[0])) & (2**62 - 1)
            none = pa.nulls(len(ns))
            bits = np.array([signs(x) for x in odd], np.int64).reshape(-1, len(SIGNS))
            odd = pa.array([x.tobytes() for x in odd], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.binary()), odd, *map(pa.array, bits.T)], names)
        if task is not None:
            rows = [r for r in range(COUNTERS // ROW) if counts[r * ROW : (r + 1) * ROW].any()]
            none = pa.nulls(len(rows))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(rows, pa.int32()), pa.array([task] * len(rows), pa.int64()), pa.array([counts[r * ROW : (r + 1) * ROW].tobytes() for r in rows], pa.binary()), none.cast(pa.binary()), *[none.cast(pa.int64())] * len(SIGNS)], names)

    names = ["doc", "n", "key", "row", "task", "counters", "parity", *SIGNS]
    measured = stage(texts.mapInArrow(light(measure), "doc long, n long, key binary, row int, task long, counters binary, parity binary, " + ", ".join(f"{x} long" for x in SIGNS)), "jaccard-sizes")
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(measured.where("row IS NOT NULL")))
    sizes = measured.where("row IS NULL").select("doc", "n", "key", "parity", *SIGNS)
    # Only copies need a class; a written table, so that the join below may split a key that a third of the rows share.
    keys = sizes.where("key IS NOT NULL").groupBy("key").agg(F.min("doc").alias("class"), F.count("*").alias("copies")).where("copies > 1")
    keys = stage(keys.drop("copies"), "jaccard-copies")
    members = stage(sizes.join(keys, "key", "left").select("doc", "n", F.coalesce("class", "doc").alias("class"), "parity", *SIGNS), "jaccard-members")
    discard(measured)
    discard(keys)

    def prefixes(batches):
        counts = sketch.value
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            key, seen, out = batch.column(0).to_numpy(zero_copy_only=False), set(), []
            for a, b in doc_slices(offsets, SLICE_BYTES):
                for doc, s in zip(key[a:b], shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)):
                    n = len(s)
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if not n or digest in seen:  # a copy of this batch
                        continue
                    seen.add(digest)
                    c = counts[(s >> np.uint64(44)).astype(np.int64)]
                    p = n - needed(n, percent) + 1
                    order = np.lexsort((s, c))[:p]
                    common = min(127, int(4 * np.log2(1 + float(c[order].mean()))))
                    parts = (c[order] // np.uint32(HOT) + 1).astype(np.int32)
                    out.append((s[order].view(np.int64), np.full(p, doc), (common << 56) + (n << 28) + np.arange(p), parts))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["shingle", "doc", "pack", "parts"])

    entries = texts.mapInArrow(light(prefixes), "shingle long, doc long, pack long, parts int")
    entries = entries.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc"), F.col("parts"))).otherwise(0).cast("int"))
    common_first = [F.shiftright("pack", 56).desc(), F.col("doc")]
    bucket = Window.partitionBy("shingle", "part").orderBy(*common_first)
    met = entries.select("*", F.first("doc").over(bucket).alias("pivot"), F.first("pack").over(bucket).alias("pivot_pack"), F.lag("doc").over(bucket).alias("last"), F.lead("doc").over(bucket).alias("next"))
    met = stage(met.where("last IS NOT NULL OR next IS NOT NULL OR parts > 1").drop("last", "next"), "jaccard-entries")
    # The pivots of a salted bucket's parts meet in its first part's pivot.
    heads = met.where("parts > 1 AND doc = pivot").select("shingle", "doc", "pack")
    over_parts = Window.partitionBy("shingle").orderBy(*common_first)
    heads = heads.select("doc", "pack", F.first("doc").over(over_parts).alias("pivot"), F.first("pack").over(over_parts).alias("pivot_pack"))

    classes = members.select("doc", "class")
    m, i, n, j = _size("pack"), _place("pack"), _size("pivot_pack"), _place("pivot_pack")
    waves = met.select("doc", "pack", "pivot", "pivot_pack").unionByName(heads)
    pairs = waves.where((F.col("doc") != F.col("pivot")) & _may_link(m, i, n, j, percent)).select("doc", "pivot").distinct()
    one, two = classes.toDF("doc", "x"), classes.toDF("pivot", "y")
    compared = stage(pairs.join(one, "doc").join(two, "pivot").where("x <> y").select(F.col("x").alias("member"), F.col("y").alias("pivot")).distinct(), "jaccard-pairs")
    links = stage(_verify(compared, members, texts, words, percent), "jaccard-links")
    first = components(links)

    # What lies in one bucket but in different components: of such a pair one at least is outside the bucket's main one.
    placed = met.select("shingle", "doc", "pack").join(classes, "doc").select("shingle", "class", "pack").distinct()
    placed = placed.join(first, F.col("class") == first.node, "left")
    placed = stage(placed.select("shingle", "class", "pack", F.coalesce("component", "class").alias("component")), "jaccard-placed")
    discard(met)
    main = placed.groupBy("shingle", "component").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("sides"), F.ceil(F.sum("n") / HOT).alias("tiles"))
    open_ = placed.join(main.where("sides > 1").drop("sides"), "shingle")
    open_ = stage(open_.join(members.where("doc = class").select("class", *SIGNS), "class"), "jaccard-open")
    discard(placed)
    x = open_.where("component <> main").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).alias("x")
    y = open_.withColumn("tile", F.pmod(F.xxhash64("class", F.lit(3)), F.col("tiles"))).alias("y")
    col = lambda side, name: F.col(f"{side}.{name}")
    apart = (col("x", "component") != col("y", "component")) & ((col("y", "component") == col("y", "main")) | (col("x", "class") < col("y", "class")))
    m, i, n, j = _size(col("x", "pack")), _place("x.pack"), _size(col("y", "pack")), _place("y.pack")
    differ = sum((F.bit_count(col("x", k).bitwiseXOR(col("y", k))) for k in SIGNS), F.lit(0))
    allowed = m + n - 2 * _overlap_needed(m, n, percent)
    rest = x.join(y, (col("x", "shingle") == col("y", "shingle")) & (col("x", "tile") == col("y", "tile")) & apart & _may_link(m, i, n, j, percent) & (differ <= allowed))
    rest = rest.select(F.col("x.class").alias("member"), F.col("y.class").alias("pivot")).distinct()
    sides = lambda t: t.select(F.least("member", "pivot").alias("a"), F.greatest("member", "pivot").alias("b"), "member", "pivot")
    rest = stage(sides(rest).join(sides(compared).select("a", "b").distinct(), ["a", "b"], "left_anti").select("member", "pivot"), "jaccard-rest")
    discard(open_)
    discard(compared)
    more = stage(_verify(rest, members, texts, words, percent), "jaccard-links")
    discard(rest)
    final = components(first.toDF("a", "b").union(more))
    out = members.join(final, members["class"] == final.node, "left")
    return out.select("doc", F.col("n").alias("n_shingles"), F.col("class").alias("class_id"), F.coalesce("component", "class").alias("component"))


def text_nodes(docs: DataFrame, *columns) -> tuple[DataFrame, bool]:
    """Rows of docs with ``doc`` (doc_id, a null as the least long) and ``node``, one for each distinct text of a doc: doc
    itself where every row has a doc_id of its own, else its place in the order of doc and a hash. And whether that is so."""
    rows = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc"), "text")
    if rows.groupBy("doc").count().where("count > 1").isEmpty():
        return rows.withColumn("node", F.col("doc")), False
    rows = rows.withColumn("part", F.xxhash64("text"))
    nodes = rows.select("doc", "part").distinct().orderBy("doc", "part").withColumn("node", F.monotonically_increasing_id())
    return stage(rows.join(stage(nodes, "jaccard-nodes"), ["doc", "part"]).drop("part"), "jaccard-rows"), True


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, several = text_nodes(docs)
    if not several:
        out = jaccard_components(rows.select("doc", "text"), words, percent).select("doc", "n_shingles", "component")
    else:
        found = jaccard_components(rows.dropDuplicates(["node"]).select(F.col("node").alias("doc"), "text"), words, percent)
        found = stage(found.select(F.col("doc").alias("node"), "n_shingles", "component"), "jaccard-found")
        ids = rows.select("node", "doc").distinct().join(found, "node")
        # The components of a doc_id's nodes are one: each is linked with their smallest, and named by its smallest doc_id.
        low = stage(ids.groupBy("doc").agg(F.min("component").alias("low")), "jaccard-low")
        ids = stage(ids.join(low.toDF("own", "low"), F.col("doc") == F.col("own")).drop("own"), "jaccard-ids")
        joined = components(ids.where("component <> low").select(F.col("component").alias("a"), F.col("low").alias("b")))
        ids = ids.join(joined.toDF("c", "joined"), F.col("component") == F.col("c"), "left").withColumn("joined", F.coalesce("joined", "component"))
        names = stage(ids.groupBy("joined").agg(F.min("doc").alias("component")), "jaccard-names")
        ids = ids.select("node", "n_shingles", "joined").join(names, "joined").select(F.col("node").alias("n"), "n_shingles", "component")
        out = rows.select("doc", "node").join(ids, F.col("node") == F.col("n"))
    real = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return out.select(real("doc").alias("doc_id"), "n_shingles", real("component").alias("component_id"))
