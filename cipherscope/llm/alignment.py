"""Cross-tokenizer alignment: which tokens of two tokenizers share bytes of a text, and how usual each such pair is.

Tokens and bytes of a slice of documents are incidence matrices in CSR (row pointers, column numbers), built by hand. The
row-wise product A Bt (Gustavson: the rows of Bt that a row of A names, coalesced) has an entry for every pair of tokens
that overlap, valued by the bytes they share. Places where tokens of both end cut the tokens into groups; the product of
the group incidences links tokens of one group, and its row sizes alone (the symbolic phase) say how many there are, so no
group is expanded into its pairs.

How many documents hold an id pair linked is a corpus-wide count. A task names its pairs by places in a dictionary of its
chunk of documents, so each pair of a chunk is a row only once: rows are summed by pair, the highest count of each A id is
taken, and both are joined back to the chunks. A chunk's documents then get their sums from the product of their pair
matrix (CSR again) with the columns of counts.

Defined results: a null or empty text, and one whose tokens do not give back its bytes, has no tokens and zeros; each row
is a document, also if repeated; ties for an A id's highest count all count; an empty table gives no rows; other columns
are ignored. A text is aligned whole: a task holds about 100 bytes a byte of its longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import BytePairCodec
from .common import light, stage
from .scan import doc_slices, text_bytes
from .tokens import ChunkCache, ragged

#: Bytes of text aligned at once, and bytes whose pairs share a dictionary.
SLICE, CHUNK_BYTES = 1 << 20, 16 << 20
MARK = "▁"
TEXTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups string"


class PlainByteCodec(BytePairCodec):
    """Byte-level BPE for which the strings of added tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.heads = set()


class PieceCodec(ChunkCache):
    """A sentencepiece model over texts that begin with a blank each (the one that the model adds). No piece goes on past a
    blank that follows another character, so texts are cut before such blanks."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError(f"{path}: a piece spans a blank")
        pieces = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.blank = self.model.piece_to_id(MARK)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self._clear()

    def cut(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.zeros(len(buf), bool)
        first[1:] = (buf[1:] == 32) & (buf[:-1] != 32)
        first[offsets[:-1][offsets[:-1] < len(buf)]] = True
        starts = np.flatnonzero(first)
        return starts, np.append(starts[1:], len(buf))

    def ids_of(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.model.encode([c[1:].decode() for c in chunks], num_threads=1)
        lists = [x or [self.blank] for x in lists]
        return np.fromiter((i for x in lists for i in x), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))


def row_product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR of the product of two 0/1 matrices in CSR: row pointers, columns, how often each was met."""
    (heads, cols), (b_heads, b_cols) = a, b
    sizes = (b_heads[1:] - b_heads[:-1])[cols]
    met = b_cols[ragged(b_heads[:-1][cols], sizes)]
    row = np.repeat(np.repeat(np.arange(len(heads) - 1), np.diff(heads)), sizes)
    if len(met) and ((row[1:] == row[:-1]) & (met[1:] < met[:-1])).any():
        order = np.lexsort((met, row))
        row, met = row[order], met[order]
    new = np.ones(len(met), bool)
    new[1:] = (row[1:] != row[:-1]) | (met[1:] != met[:-1])
    at = np.flatnonzero(new)
    return np.searchsorted(row[at], np.arange(len(heads))), met[at], np.diff(at, append=len(met))


def row_sizes(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the product's rows where no row of a meets a column of b twice: the symbolic phase alone."""
    (heads, cols), (b_heads, _) = a, b
    met = np.append(0, np.cumsum((b_heads[1:] - b_heads[:-1])[cols]))
    return met[heads[1:]] - met[heads[:-1]]


def given_back(codec, ids: np.ndarray, counts: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each document's tokens joined are its bytes."""
    lens = codec.lengths[ids]
    joined = codec.bytes[ragged(codec.at[ids], lens)]
    if len(joined) == len(flat) and (joined == flat).all():
        return np.ones(len(counts), bool)
    edges = np.append(0, np.cumsum(lens))[np.append(0, np.cumsum(counts))]
    return np.array([np.array_equal(joined[c:d], flat[a:b]) for a, b, c, d in zip(offsets[:-1], offsets[1:], edges[:-1], edges[1:])])


def rendered(ids_a, group_a, ids_b, group_b, ends: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document; ``ends`` has its last group's number plus one."""
    n_a, n_b = len(ids_a), len(ids_b)
    if not n_a:
        return [b""] * len(ends)
    groups = int(ends[-1])
    per_a, per_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    before_a, before_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
    at_a = np.arange(n_a) + before_b[group_a]
    at_b = np.arange(n_b) + (before_a + per_a)[group_b]
    ids, sep = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
    ids[at_a], ids[at_b] = ids_a, ids_b
    upto = before_a + per_a + before_b
    sep[upto - 1], sep[upto + per_b - 1] = ord("|"), ord(";")
    digits = np.full((len(ids), 8), 32, np.uint8)
    digits[:, 7] = sep
    rest = ids
    for k in range(6, -1, -1):
        digits[:, k] = np.where((rest > 0) | (k == 6), 48 + rest % 10, 32)
        rest = rest // 10
    shown = digits != 32
    raw = digits[shown].tobytes()
    length = np.append(0, np.cumsum(shown.sum(axis=1)))
    edges = length[np.append(0, (upto + per_b))[np.append(0, ends)]].tolist()
    return [raw[a : max(a, b - 1)] for a, b in zip(edges[:-1], edges[1:])]


class Slice:
    """The alignment of some documents."""

    def __init__(self, a: ChunkCache, b: ChunkCache, buf: np.ndarray, offsets: np.ndarray):
        lens = np.diff(offsets)
        lens = np.where(lens > 0, lens + 1, 0)
        edges = np.append(0, np.cumsum(lens))
        flat = np.full(int(edges[-1]), 32, np.uint8)
        blank = np.zeros(len(flat), bool)
        blank[edges[:-1][lens > 0]] = True
        flat[~blank] = buf[int(offsets[0]) : int(offsets[-1])]
        (ids_a, counts_a), (ids_b, counts_b) = a.encode(flat, edges), b.encode(flat, edges)
        good = given_back(a, ids_a, counts_a, flat, edges) & given_back(b, ids_b, counts_b, flat, edges)
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, counts_a)], ids_b[np.repeat(good, counts_b)]
            counts_a, counts_b, lens = counts_a * good, counts_b * good, lens * good
        self.ids_a, self.ids_b, self.counts_a, self.counts_b = ids_a, ids_b, counts_a, counts_b
        heads_a, heads_b = np.append(0, np.cumsum(a.lengths[ids_a])), np.append(0, np.cumsum(b.lengths[ids_b]))
        n = int(heads_a[-1])
        of_byte = np.repeat(np.arange(len(ids_b)), np.diff(heads_b))
        rows, self.link_b, self.shared = row_product((heads_a, np.arange(n)), (np.arange(n + 1), of_byte))
        self.link_a = np.repeat(np.arange(len(ids_a)), np.diff(rows))
        self.doc = np.repeat(np.arange(len(lens)), counts_a)[self.link_a]
        both = np.intersect1d(heads_a[1:], heads_b[1:], assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(both, heads_a[1:]), np.searchsorted(both, heads_b[1:])
        self.group_ends = np.searchsorted(both, np.cumsum(lens), side="right")
        in_b = np.append(0, np.cumsum(np.bincount(self.group_b, minlength=len(both))))
        linked = np.append(0, np.cumsum(row_sizes((np.arange(len(ids_a) + 1), self.group_a), (in_b, np.arange(len(ids_b))))))
        ends_a = np.append(0, np.cumsum(counts_a))
        self.n_group_links = linked[ends_a[1:]] - linked[ends_a[:-1]]
        self.n_groups = np.diff(self.group_ends, prepend=0)
        self.n_links = np.bincount(self.doc, minlength=len(lens))

    def groups(self) -> list[bytes]:
        return rendered(self.ids_a, self.group_a, self.ids_b, self.group_b, self.group_ends)

    def columns(self) -> list[pa.Array]:
        return [pa.array(x.astype(np.int64)) for x in (self.counts_a, self.counts_b, self.n_groups, self.n_links, self.n_group_links)]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def alignment_texts(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """TEXTS: the groups of every document written out."""

    def run(batches):
        a, b = PlainByteCodec.of(bytes_path), PieceCodec.of(pieces_path)
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for i, j in doc_slices(offsets, SLICE):
                found = Slice(a, b, buf, offsets[i : j + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *found.columns(), pa.array(found.groups(), pa.binary()).cast(pa.string())], [c.split()[0] for c in TEXTS.split(", ")])

    return _rows(docs).mapInArrow(light(run), TEXTS)


def link_table(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """doc_id, a_id, b_id, n_links, n_bytes: each linked id pair of a document, with its links and the bytes they share."""

    def run(batches):
        a, b = PlainByteCodec.of(bytes_path), PieceCodec.of(pieces_path)
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for i, j in doc_slices(offsets, SLICE):
                found = Slice(a, b, buf, offsets[i : j + 1])
                keys, of, n = np.unique(np.stack([found.doc, found.ids_a[found.link_a], found.ids_b[found.link_b]]), axis=1, return_inverse=True, return_counts=True)
                shared = np.bincount(of.ravel(), found.shared, minlength=len(n)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(keys[0])), pa.array(keys[1].astype(np.int64)), pa.array(keys[2].astype(np.int64)), pa.array(n), pa.array(shared)], ["doc_id", "a_id", "b_id", "n_links", "n_bytes"])

    return _rows(docs).mapInArrow(light(run), "doc_id long, a_id long, b_id long, n_links long, n_bytes long")


def _cut(values: np.ndarray, counts: np.ndarray, kind: str) -> pa.Array:
    values = values.astype(kind)
    edges = pa.array(np.append(0, np.cumsum(counts)) * values.itemsize, pa.int64())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, edges.buffers()[1], pa.py_buffer(values.tobytes())]).cast(pa.binary())


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum, groups_sha256 of every document."""
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]
    kept = ["chunk", "doc_id", *numbers, "groups_sha256", "places", "times"]

    def run(batches):
        a, b, part = PlainByteCodec.of(bytes_path), PieceCodec.of(pieces_path), TaskContext.get().partitionId()
        held: list[tuple] = []
        size = chunks = 0

        def chunk():
            nonlocal held, size, chunks
            names = [c for h in held for c in h[0]]
            codes, times, counts = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            pairs, places, in_docs = np.unique(codes, return_inverse=True, return_counts=True)
            table = pa.Table.from_batches(names)
            number = pa.array(np.full(len(table), (part << 32) + chunks))
            first = np.where(np.arange(len(table)) == 0, len(pairs), 0)
            yield from table.add_column(0, "chunk", number).append_column("places", _cut(places, counts, "<u4")).append_column("times", _cut(times, counts, "<u4")).append_column("pairs", _cut(pairs, first, "<i8")).append_column("docs", _cut(in_docs, first, "<i8")).combine_chunks().to_batches()
            held, size, chunks = [], 0, chunks + 1

        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for i, j in doc_slices(offsets, SLICE):
                found = Slice(a, b, buf, offsets[i : j + 1])
                digests = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in found.groups()], pa.string())
                code = found.ids_a[found.link_a].astype(np.int64) * len(b.lengths) + found.ids_b[found.link_b]
                keys, times = np.unique(found.doc << 40 | code, return_counts=True)
                counts = np.bincount(keys >> 40, minlength=j - i)
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *found.columns(), digests], ["doc_id", *numbers, "groups_sha256"])
                held.append(([rows], keys & ((1 << 40) - 1), times, counts))
                size += int(offsets[j] - offsets[i])
                if size >= chunk_bytes:
                    yield from chunk()
        if held:
            yield from chunk()

    schema = "chunk long, doc_id long, " + ", ".join(f"{n} long" for n in numbers) + ", groups_sha256 string, places binary, times binary, pairs binary, docs binary"
    texts = stage(_rows(docs).mapInArrow(light(run), schema), "alignment-texts")

    def spell(batches):
        for batch in batches:
            for chunk, pairs, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                pairs, n = np.frombuffer(pairs.as_buffer(), "<i8"), np.frombuffer(n.as_buffer(), "<i8")
                for i in range(0, len(pairs), 1 << 16):
                    k = min(1 << 16, len(pairs) - i)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, chunk)), pa.array(np.arange(i, i + k, dtype=np.int32)), pa.array(pairs[i : i + k]), pa.array(n[i : i + k])], ["chunk", "place", "pair", "n"])

    pairs = texts.where(F.length("pairs") > 0).select("chunk", "pairs", "docs").mapInArrow(light(spell), "chunk long, place int, pair long, n long")
    width = _vocabulary(pieces_path)
    # Pairs of one A id are at most the other vocabulary.
    of_a = Window.partitionBy(F.expr(f"pair div {width}"))
    usual = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    usual = stage(usual.withColumn("best", F.col("count") == F.max("count").over(of_a)), "alignment-pairs")
    back = pairs.select("chunk", "place", "pair").join(usual, "pair").select("chunk", "place", "count", "best")

    def weigh(key, rows, found):
        place = found.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place] = found.column("count").to_numpy()
        best[place] = found.column("best").to_numpy().astype(np.int64)
        sums = []
        for places, times in zip(rows.column("places"), rows.column("times")):
            at, n = np.frombuffer(places.as_buffer(), "<u4"), np.frombuffer(times.as_buffer(), "<u4").astype(np.int64)
            sums.append((int(n @ best[at]), int(n @ count[at])))
        out = rows.select(["doc_id", *numbers, "groups_sha256"])
        return out.append_column("n_best", pa.array([x[0] for x in sums], pa.int64())).append_column("count_sum", pa.array([x[1] for x in sums], pa.int64()))

    result = "doc_id long, " + ", ".join(f"{n} long" for n in numbers) + ", groups_sha256 string, n_best long, count_sum long"
    return texts.select(kept).groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(weigh, result)


def _vocabulary(pieces_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces_path).get_piece_size()
