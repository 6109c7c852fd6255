"""Repeated substrings over all documents: bucket-pointer refinement on a sample of suffixes that misses no repeat.

Only sampled suffixes are sorted: every string of ``length`` bytes takes the suffix whose q-gram (q = length / 4) has the
smallest code inside it (leftmost of equals) as its anchor, so equal strings have equal anchors at equal offsets. An anchor
stands for a run of neighbouring strings. The initial bucket of a suffix is the code of its first q bytes. Spark sorts the
rows of a round by bucket; a bucket's pointer is the place of its first row in that order, and the next round refines the
bucket by sorting on (pointer, codes of later offsets), which gives new pointers for the round after:

* round 1 sorts anchors by their own code. Those alone in their bucket are done: their strings are unique. Inside a bucket
  rows are in the order of the codes at all later offsets of their run; a row that equals an earlier one is a repeat
  altogether, and the first of each class goes on if its bucket holds other classes (a passage's edges, where runs differ);
* round 2 splits those runs into blocks of WIDTHS[0] neighbours, aligned at the anchor, and sorts them by the pointer of
  round 1 and the codes of what all strings of a block share;
* round 3 does the same to single strings, by the pointer of round 2 and the codes of the whole string; nothing is open then.

A position's code at depth 2q is made of those at p and p + q, at 4q of those at depth 2q at p and p + 2q, recursively
(``refine``). These codes are 64-bit fingerprints, equal on every executor; pointers come from the sorts alone.

Before each sort a task keeps only the first of equal anchors or strings among its own rows and reports the others as
repeats, so a bucket brings a sort at most a few rows a task and class. Buckets that may hold more than HOT rows (by
counters of a hash) are not sorted in one piece: their rows are grouped by bucket and run, and what the bucket as a whole
says comes from an aggregate that is combined before the shuffle. Very long texts are read in overlapping windows.

Positions count bytes of UTF-8. Defined results: a null text is empty; texts shorter than ``length`` have no repeats; a
null doc_id sorts before all others; each text of a doc_id (also of the null) is a document of its own, ordered by a hash
of it; exact repeats of a row are one document and get the same result as the row, so that its text stays in each of them
where it stands nowhere earlier; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, discard, light, stage
from .scan import BASE, BYTE, doc_slices, mix, powers, text_bytes
from .tokens import ragged

SECOND = 0xD6E8FEB86659FD93
_RNG = np.random.default_rng(77)
BYTE2 = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
C1, C2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
SPAN = 16  # bits of a packed place below its start: 8 for the strings of a run less one, 8 for the anchor's offset
#: Neighbouring strings in a block, from level to level.
WIDTHS = (16, 1)
#: Doc_ids of several texts up to which they are broadcast; beyond, Spark joins them by key.
BROADCAST_ROWS = 100_000
#: Rows that a bucket sorted in one piece may have, and bits of the hash whose counters tell which have more.
HOT, COUNTER_BITS = 50_000, 16


def grams(buf: np.ndarray, q: int, second: bool = False) -> np.ndarray:
    """The initial bucket of every position: the fingerprint of its first q bytes."""
    base, table = (SECOND, BYTE2) if second else (BASE, BYTE)
    n = len(buf)
    if n < q:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[buf] * powers(base, n), out=sums[1:])
    return mix((sums[q:] - sums[:-q]) * powers(pow(base, -1, 2**64), n - q + 1))


def refine(bucket: np.ndarray, offset: int) -> np.ndarray:
    """Identifiers of twice the depth (or less, where offset overlaps): the bucket's, and that of a later offset."""
    if len(bucket) <= offset:
        return bucket[:0]
    return mix(bucket[: len(bucket) - offset] * C1 + (bucket[offset:] ^ C2))


def identifiers(buf: np.ndarray, length: int, second: bool = False) -> np.ndarray:
    """The identifier of every string of ``length`` bytes, by two refinements of its q-gram bucket."""
    q = length // 4
    bucket = refine(refine(grams(buf, q, second), q), 2 * q)
    return refine(bucket, length - 4 * q) if length % 4 else bucket


def sliding_first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest upper half (leftmost of equals) in each window of ``width`` values."""
    key = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    done = 1
    while 2 * done <= width:
        key = np.minimum(key[: len(key) - done], key[done:])
        done *= 2
    if done < width:
        rest = width - done
        key = np.minimum(key[: len(key) - rest], key[rest:])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def string_starts(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, document) of all strings of ``length`` bytes inside documents."""
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    return ragged(offsets[:-1], n), np.repeat(np.arange(len(n)), n)


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int):
    """(bucket, run identifier, document, first start in it, strings less one, anchor's offset) of every anchor."""
    q = length // 4
    starts, doc = string_starts(offsets, length)
    if not len(starts):
        return None
    first_gram = grams(buf, q)
    at = sliding_first_minimum(first_gram, length - q + 1)[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    ids = identifiers(buf, length, second=True)
    anchor, begin, span = at[first], starts[first], last - first
    run = mix(ids[begin] * C1 + (ids[starts[last]] ^ C2)) + (span * 256 + anchor - begin).astype(np.uint64)
    return first_gram[anchor], mix(run), doc[first], begin - offsets[doc[first]], span, anchor - begin


def firsts(keys: list[np.ndarray], docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """1 for the first, by document and start, of rows with equal keys, -1 for the same row once more, else 0."""
    order = np.lexsort((starts, docs, *keys))
    fresh, same = np.ones(len(order), bool), np.zeros(len(order), bool)
    fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    same[1:] = ~fresh[1:] & np.all([k[order][1:] == k[order][:-1] for k in (docs, starts)], axis=0)
    out = np.zeros(len(order), np.int8)
    out[order[fresh]], out[order[same]] = 1, -1
    return out


def ranks(doc: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's rank by (doc, part), the same for equal ones, and a row of every rank."""
    order = np.lexsort((part, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (part[order][1:] != part[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return rank, order[fresh]


def merged(docs: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """Unions of touching ranges of the same document."""
    if not len(docs):
        return docs, starts, stops
    order = np.lexsort((starts, docs))
    docs, starts, stops = docs[order], starts[order], stops[order]
    run = np.ones(len(docs), bool)
    # Of one document's ranges in order the furthest stop so far; documents are kept apart by a large step.
    group = np.cumsum(np.append(True, docs[1:] != docs[:-1])) - 1
    step = int(stops.max()) + 1
    far = np.maximum.accumulate(stops + group * step)
    run[1:] = (starts + group * step)[1:] > far[:-1]
    run[1:] |= group[1:] != group[:-1]
    first = np.flatnonzero(run)
    return docs[first], starts[first], (far - group * step)[np.append(first[1:], len(docs)) - 1]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def blocks(buf: np.ndarray, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray, last: np.ndarray, offset: np.ndarray, pointer: np.ndarray, width: int, length: int):
    """Splits runs (document, first and last string, the first one's distance to its anchor, the pointer of its bucket) into
    blocks of ``width`` neighbours, aligned at the anchor, as rows like those of ``anchors``. A block's bucket is its run's,
    refined by the codes of what all its strings share."""
    n = last - start + 1
    at, run = ragged(start, n), np.repeat(np.arange(len(n)), n)
    here = offsets[doc[run]] + at
    ok = here + length <= offsets[doc[run] + 1]  # another text of the same doc_id may be shorter
    at, run, here = at[ok], run[ok], here[ok]
    if not len(at):
        return None
    k = offset[run] + start[run] - at
    block = k // width
    fresh = np.ones(len(at), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(fresh)
    end = np.append(first[1:], len(at)) - 1
    shared = identifiers(buf, length - width + 1)[here[first] + k[first] - block[first] * width]
    ids = identifiers(buf, length, second=True)
    span = end - first
    name = mix(ids[here[first]] * C1 + (ids[here[end]] ^ C2)) + (span * 256 + k[first]).astype(np.uint64)
    bucket = mix(pointer[run[first]].astype(np.uint64) * C1 + (shared ^ C2)) + block[first].astype(np.uint64)
    return mix(bucket), mix(name), doc[run[first]], at[first], span, k[first]


def windows(offsets: np.ndarray, most: int, overlap: int):
    """(first document, last, first byte, last byte, bytes of the document before): slices of about ``most`` bytes, a longer
    document in windows that reach ``overlap`` bytes into the next one."""
    for a, b in doc_slices(offsets, most):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= most + overlap:
            yield a, b, lo, hi, 0
            continue
        for at in range(lo, hi, most):
            if at == lo or hi - at > overlap:
                yield a, b, at, min(hi, at + most + overlap), at - lo


def _emit(key, part, bucket, run, doc, start, span, offset, length: int):
    """Rows for a sort: the first of equal runs, and the others' bytes as ranges, in buckets of their own. ``doc`` counts
    the batch's documents in order, key and part name them."""
    kind = firsts([bucket, run], doc, start)
    first, again = kind == 1, kind == 0
    place = (start << SPAN) | (span << 8) | offset
    names = ["bucket", "run", "doc", "part", "place"]
    at = doc[first]
    yield pa.RecordBatch.from_arrays([signed(bucket[first]), signed(run[first]), pa.array(key[at]), pa.array(part[at]), pa.array(place[first])], names)
    d, s, e = merged(doc[again], start[again], (start + span)[again] + length)
    d, own = key[d], part[d]
    # A range: place is -1 - start, run its stop.
    yield pa.RecordBatch.from_arrays([signed(mix((d ^ own).astype(np.uint64) * C1 + s.astype(np.uint64))), pa.array(e), pa.array(d), pa.array(own), pa.array(-1 - s)], names)


def _sift(rows: DataFrame, length: int, hot: DataFrame | None) -> DataFrame:
    """Sorts buckets by run: doc, part, start, stop, offset, open, pointer. Closed rows are ranges of repeated bytes; open
    ones are runs (first and last string) that are the first of their kind in a bucket with others."""
    keys = ["run", "doc", "part", "place"]
    if hot is None:
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", *keys).withColumn("at", F.monotonically_increasing_id())
        order = Window.partitionBy("bucket").orderBy(*keys)
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        about = {"low": F.first("run").over(whole), "high": F.last("run").over(whole), "pointer": F.first("at").over(whole)}
        rows = rows.withColumns(about)
    else:
        # The pointer is that of the bucket's first run; no task holds the bucket.
        rows = rows.repartition("bucket", "run").sortWithinPartitions("bucket", *keys).withColumn("at", F.monotonically_increasing_id())
        rows = stage(rows, "repeat-hot")
        about = rows.groupBy("bucket").agg(F.min("run").alias("low"), F.max("run").alias("high"), F.min("at").alias("pointer"))
        rows = rows.join(stage(about, "repeat-buckets"), "bucket")
        order = Window.partitionBy("bucket", "run").orderBy("doc", "part", "place")
    same = reduce(lambda x, y: x & y, (F.lag(c).over(order) == F.col(c) for c in keys))
    rows = rows.withColumns({"same": F.coalesce(same, F.lit(False)), "before": F.lag("run").over(order)})
    start = F.shiftright("place", SPAN)
    strings = F.shiftright("place", 8).bitwiseAND(255)
    is_range, is_again = F.col("place") < 0, F.coalesce(F.col("before") == F.col("run"), F.lit(False))
    # A row that is the same as the one before it comes from an exact repeat of its document.
    return rows.where(~F.col("same") & (is_range | is_again | (F.col("low") != F.col("high")))).select(
        "doc",
        "part",
        F.when(is_range, -1 - F.col("place")).otherwise(start).alias("start"),
        F.when(is_range, F.col("run")).when(is_again, start + strings + length).otherwise(start + strings).alias("stop"),
        F.col("place").bitwiseAND(255).alias("offset"),
        (~is_range & ~is_again).alias("open"),
        "pointer",
    )


def _sorted(rows: DataFrame, length: int, name: str) -> DataFrame:
    """The written result of a round: buckets that may be hot apart from the rest."""
    rows = stage(rows, f"{name}-rows")
    counter = F.shiftright(F.xxhash64("bucket"), 64 - COUNTER_BITS)
    full = [r[0] for r in rows.groupBy(counter.alias("c")).count().where(F.col("count") > HOT).select("c").collect()]  # of 2**COUNTER_BITS
    if not full:
        out = stage(_sift(rows, length, None), name)
    else:
        is_full = counter.isin(full) if len(full) < 1000 else F.array_contains(F.array(*map(F.lit, full)), counter)
        # A counter stands for many buckets: its own count says which of them are large.
        hot = stage(rows.where(is_full).groupBy("bucket").count().where(F.col("count") > HOT).select("bucket"), f"{name}-large")
        few = hot.count() <= BROADCAST_ROWS
        large = F.broadcast(hot) if few else hot
        apart = _sift(rows.join(large, "bucket", "left_semi"), length, hot)
        out = stage(_sift(rows.join(large, "bucket", "left_anti"), length, None).unionByName(apart), name)
    discard(rows)
    return out


def _key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def _keyed(docs: DataFrame, *columns) -> DataFrame:
    """``columns``, doc and part, which name a document: part is a hash of the text where a doc_id has several texts, else 0."""
    rows = docs.select(*columns, _key().alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("part"))
    several = rows.groupBy("doc").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    several = stage(several.select(F.col("doc").alias("several")), "repeat-ids")
    n = several.count()
    if not n:
        return rows.withColumn("part", F.lit(0).cast("long"))
    rows = rows.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, F.col("doc") == F.col("several"), "left")
    return rows.withColumn("part", F.when(F.col("several").isNotNull(), F.col("part")).otherwise(0)).drop("several")


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc (doc_id, a null as the least long), part (of ``_keyed``), spans (array of start, stop): maximal runs of bytes inside strings of
    ``length`` bytes that also start earlier. Documents without any are absent."""
    if not 8 <= length <= 255:
        raise ValueError("length must be 8 to 255")
    texts = _keyed(docs, "text").select("doc", "part", "text")

    def find(batches):
        for batch in batches:
            key, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            buf, offsets = text_bytes(batch.column(2))
            parts, (rank, named) = [], ranks(key, part)
            for a, b, lo, hi, before in windows(offsets, SLICE_BYTES // 2, length - 1):
                own = np.array([0, hi - lo]) if b == a + 1 else offsets[a : b + 1] - lo
                if (got := anchors(buf[lo:hi], own, length)) is not None:
                    parts.append((*got[:2], rank[a:b][got[2]], got[3] + before, *got[4:]))
            if parts:
                yield from _emit(key[named], part[named], *map(np.concatenate, zip(*parts)), length)

    def split(width):
        def run(batches):
            for batch in batches:
                key, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                buf, offsets = text_bytes(batch.column(2))
                runs = batch.column(3)
                counts = runs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                inner = runs.flatten()
                fields = [inner.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
                edge = np.concatenate([[0], np.cumsum(counts)])
                parts, (rank, named) = [], ranks(key, part)
                for a, b, lo, hi, before in windows(offsets, SLICE_BYTES // 2, 3 * length):
                    row = np.repeat(np.arange(b - a), counts[a:b])
                    start, *rest = (f[edge[a] : edge[b]] for f in fields)
                    own = np.array([0, hi - lo]) if b == a + 1 else offsets[a : b + 1] - lo
                    if b == a + 1:  # a window has the runs that begin in it, and not yet in the next one
                        last = hi - lo - 3 * length if hi < offsets[b] else hi - lo
                        on = (start >= before) & (start < before + last)
                        row, start, rest = row[on], start[on] - before, [rest[0][on] - before, *(x[on] for x in rest[1:])]
                    got = blocks(buf[lo:hi], own, row, start, *rest, width, length)
                    if got is not None:
                        parts.append((*got[:2], rank[a:b][got[2]], got[3] + before, *got[4:]))
                if parts:
                    yield from _emit(key[named], part[named], *map(np.concatenate, zip(*parts)), length)

        return run

    schema = "bucket long, run long, doc long, part long, place long"
    sifted = [_sorted(texts.mapInArrow(light(find), schema), length, "repeat-anchors")]
    for width in WIDTHS:
        runs = sifted[-1].where("open").groupBy("doc", "part").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "offset", "pointer"))).alias("runs"))  # of one document
        finer = texts.join(runs, ["doc", "part"]).select("doc", "part", "text", "runs").mapInArrow(light(split(width)), schema)
        sifted.append(_sorted(finer, length, f"repeat-blocks-{width}"))

    def join_up(batches):
        for batch in batches:
            ranges = batch.column(2)
            counts = ranges.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            inner = ranges.flatten()
            row = np.repeat(np.arange(len(counts)), counts)
            r, s, e = merged(row, *(inner.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(len(counts) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(s), pa.array(e)], ["start", "stop"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc", "part", "spans"])

    ranges = reduce(DataFrame.unionByName, (x.where("NOT open").select("doc", "part", "start", "stop") for x in sifted))
    ranges = ranges.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))  # of one document
    return ranges.mapInArrow(join_up, "doc long, part long, spans array<struct<start: long, stop: long>>")


def remove_spans(docs: DataFrame, spans: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the remaining bytes as ``kept`` (binary) and as ``rest`` (string, without
    characters that a span cut in two), and the columns named in ``keep``."""
    keep = keep or []
    rows = _keyed(docs, "doc_id", F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    rows = rows.join(spans, ["doc", "part"], "left").drop("doc", "part")

    def cut(batches):
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            at = batch.schema.get_field_index("spans")
            out = []
            for i, spans in enumerate(batch.column(at).to_pylist()):
                text, n = buf[offsets[i] : offsets[i + 1]].tobytes(), int(offsets[i + 1] - offsets[i])
                edges = [(s["start"], min(s["stop"], n)) for s in spans or () if s["start"] < n]
                kept, upto = [], 0
                for a, b in edges:
                    kept.append(text[upto:a])
                    upto = b
                kept.append(text[upto:])
                out.append((n, sum(b - a for a, b in edges), len(edges), b"".join(kept)))
            cols = list(zip(*out)) or [(), (), (), ()]
            rest = [batch.column(c) for c in range(2, len(batch.columns)) if c != at]
            names = [n for n in batch.schema.names[2:] if n != "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in cols[3]], pa.string()), *rest], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "rest", *names])

    tail = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name.startswith("kept_"))
    kind = dict(docs.dtypes)["doc_id"]
    out = rows.mapInArrow(light(cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, rest string{tail}")
    return out.withColumnsRenamed({f"kept_{i}": c for i, c in enumerate(keep)})
