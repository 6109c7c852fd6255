"""Token-ID files: ids in the fewest bits that the vocabulary needs, in blocks that numpy unpacks on their own.

A file holds the documents of one range of doc_id, ascending:

    magic ``TOKBITS1`` | packed blocks | doc_id int64[docs] | n_tokens int64[docs] | block offsets int64[blocks + 1]
    | footer: docs, ids, blocks, bits, null doc_ids first (int64 each), magic

Each block packs BLOCK ids (the last one fewer) little end first, so id ``i`` lies in block ``i // BLOCK``, at a bit
that needs no other block. Blocks start on whole bytes. Writing and reading are Spark jobs of one file a task.

Defined results: a null text is empty; a document without ids still counts ``end_id``; rows of equal doc_id keep one
range and follow each other by text; a null doc_id sorts first; an empty table gives no file and no rows; other
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, stage
from .scan import text_bytes
from .tokens import ChunkEncoder, ragged

MAGIC, BLOCK, FOOTER = b"TOKBITS1", 1 << 16, 6
#: Ids that a reader holds at once.
READ_IDS = 1 << 21


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    lanes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(lanes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    lanes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (lanes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """Appends ids to a file; only an unfinished block and the documents' counts stay in memory."""

    def __init__(self, path: str, bits: int):
        self.fs, self.path = _filesystem(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.bits = self.fs.open_output_stream(self.path), bits
        self.out.write(MAGIC)
        self.rest, self.at, self.ids = [], [len(MAGIC)], 0
        self.docs, self.counts, self.nulls = [], [], 0

    def add(self, doc_ids: np.ndarray, nulls: int, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append(doc_ids.astype(np.int64))
        self.counts.append(counts.astype(np.int64))
        self.nulls += nulls
        self.rest.append(ids)
        self.ids += len(ids)
        if sum(map(len, self.rest)) >= BLOCK:
            held = np.concatenate(self.rest)
            whole = len(held) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(held[i : i + BLOCK])
            self.rest = [held[whole:]]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at.append(self.at[-1] + len(data))

    def close(self) -> None:
        held = np.concatenate(self.rest) if self.rest else np.zeros(0, np.int32)
        if len(held):
            self._block(held)
        docs = np.concatenate(self.docs)
        for part in (docs, np.concatenate(self.counts), np.asarray(self.at)):
            self.out.write(part.astype("<i8").tobytes())
        self.out.write(np.asarray([len(docs), self.ids, len(self.at) - 1, self.bits, self.nulls], "<i8").tobytes() + MAGIC)
        self.out.close()


class Reader:
    """Random access to the ids of a file; reads the index once and then only the blocks asked for."""

    def __init__(self, path: str):
        self.fs, name = _filesystem(path)
        self.file = self.fs.open_input_file(name)
        size = self.file.size()
        foot = self.file.read_at(8 * FOOTER, size - 8 * FOOTER)
        if foot[-8:] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        n, self.ids, blocks, self.bits, self.nulls = (int(x) for x in np.frombuffer(foot[:-8], "<i8"))
        index = np.frombuffer(self.file.read_at(8 * (2 * n + blocks + 1), size - 8 * (FOOTER + 2 * n + blocks + 1)), "<i8")
        self.docs, self.counts, self.at = index[:n], index[n : 2 * n], index[2 * n :]

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids first .. last - 1."""
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, (last - 1) // BLOCK + 1
        data = self.file.read_at(int(self.at[b] - self.at[a]), int(self.at[a]))
        n = min(self.ids, b * BLOCK) - a * BLOCK
        ids = unpack(data, n, self.bits)
        return ids[first - a * BLOCK : last - a * BLOCK]

    def documents(self):
        """(row, ids) of documents in order; a document over READ_IDS comes in several pieces."""
        ends = np.cumsum(self.counts)
        first = 0
        while first < len(ends):
            start = int(ends[first] - self.counts[first])
            last = max(first + 1, int(np.searchsorted(ends, start + READ_IDS, side="right")))
            if last == first + 1:
                for p in range(start, max(start + 1, int(ends[first])), READ_IDS):
                    yield first, self.read(p, min(int(ends[first]), p + READ_IDS))
            else:
                ids = self.read(start, int(ends[last - 1]))
                for i in range(first, last):
                    yield i, ids[int(ends[i] - self.counts[i]) - start : int(ends[i]) - start]
            first = last


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Puts ``end_id`` behind each document's ids."""
    if end_id is None:
        return ids, counts
    out = np.full(len(ids) + len(counts), end_id, dtype=np.int32)
    ends = np.cumsum(counts)
    out[ragged(ends - counts + np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 1) -> DataFrame:
    """Writes files in ascending doc_id order; returns their manifest: path, first_doc, last_doc, n_docs, n_tokens, start.

    ``start`` counts the ids of all files before. Rows go to range partitions of doc_id and a hash of the text, whatever
    their source, so the texts of one doc_id (also the null) spread over tasks and files; a file's name is its own attempt's, so a task that runs twice leaves a stray file that no manifest names.
    """
    folder = new_path(docs.sparkSession, "token-files")

    def write(batches):
        encoder, writer, path, seen = ChunkEncoder.of(tokenizer), None, f"{folder}/{uuid.uuid4().hex}.tokbits", []
        bits = bits_for(max(encoder.vocabulary, (end_id or 0) + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or Writer(path, bits)
            key = batch.column(0)
            ids = key.fill_null(0).to_numpy(zero_copy_only=False)
            null = key.is_null().to_numpy(zero_copy_only=False)
            buf, offsets = text_bytes(batch.column(1))
            for a, b, tokens, counts in encoder.encode_all(buf, offsets):
                writer.add(ids[a:b], int(null[a:b].sum()), *with_end(tokens, counts, end_id))
            seen += [key[0].as_py(), key[-1].as_py()]
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first_doc": pa.array([seen[0]], pa.int64()), "last_doc": pa.array([seen[-1]], pa.int64()), "n_docs": [sum(map(len, writer.docs))], "n_tokens": [writer.ids]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    files = stage(ordered.mapInArrow(write, "path string, first_doc long, last_doc long, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), F.col("last_doc").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))  # one row a file


def read_token_files(files: DataFrame, digest: bool = False) -> DataFrame:
    """Reads the manifest's files back: doc_id, start, n_tokens, and ids (array), or with ``digest`` their crc32."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = Reader(path)
                starts = start + np.cumsum(file.counts) - file.counts
                doc_ids = pa.array(file.docs, mask=np.arange(len(file.docs)) < file.nulls)
                if digest:
                    crc = np.zeros(len(file.docs), np.int64)
                    for i, ids in file.documents():
                        crc[i] = zlib.crc32(ids.astype("<u4").tobytes(), int(crc[i]))
                    yield from pa.table({"doc_id": doc_ids, "start": starts, "n_tokens": file.counts, "ids_crc32": crc}).to_batches(1 << 16)
                    continue
                size = first = 0
                for i in range(len(file.docs)):
                    size += int(file.counts[i])
                    if size >= READ_IDS or i == len(file.docs) - 1:
                        a, b = int(starts[first] - start), int(starts[i] - start + file.counts[i])
                        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([starts[first : i + 1] - starts[first], [b - a]]), pa.int32()), pa.array(file.read(a, b).astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([doc_ids[first : i + 1], pa.array(starts[first : i + 1]), pa.array(file.counts[first : i + 1]), lists], ["doc_id", "start", "n_tokens", "ids"])
                        size, first = 0, i + 1

    n = max(1, files.sparkSession.sparkContext.defaultParallelism)
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")
    return files.select("path", "start").repartition(max(n, files.count())).mapInArrow(read, schema)
