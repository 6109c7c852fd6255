"""Byte-level BPE by batched merge rounds in numpy, and decoding.

The symbols of many words lie in one flat array. A round finds the rank of every new pair by binary search over sorted
pair keys, the lowest rank of every word by a segmented minimum, and merges all places of that rank at once (of a run of
overlapping places every other one, from the left). A word without a known pair leaves the array.

Encoding equals the tokenizers library's with add_special_tokens=False, truncation and padding off: added tokens inside
a text are ids of their own. Decoding equals its decode(ids, skip_special_tokens=False).

Defined results: a null text is empty, an empty text has no ids and decodes to an empty text; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import text_bytes
from .tokens import ChunkCache, ragged

#: Fixed value: how the byte-level vocabularies split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int64(1) << np.int64(40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class MergeTable:
    """Pair keys in ascending order, with the rank and the result of each pair."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocabulary[a + b] for a, b in pairs], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    def merge(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the words of ``lens`` symbols each (at least one) that lie one after another."""
        n, counts = len(lens), lens.copy()
        done: list[tuple[np.ndarray, np.ndarray]] = []
        words, symbols = np.arange(n), symbols.astype(np.int64)
        ends = np.cumsum(lens)
        ranks = np.full(len(symbols), NO_RANK)
        if len(symbols) > 1:
            ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[ends - 1] = NO_RANK
        while len(words):
            starts = ends - lens
            lowest = np.minimum.reduceat(ranks, starts)
            over = lowest == NO_RANK
            if over.any():
                out = np.repeat(over, lens)
                done.append((words[over], symbols[out]))
                counts[words[over]] = lens[over]
                words, lens, lowest = words[~over], lens[~over], lowest[~over]
                symbols, ranks = symbols[~out], ranks[~out]
                ends = np.cumsum(lens)
                if not len(words):
                    break
            here = ranks == np.repeat(lowest, lens)
            at = np.flatnonzero(here)
            run = np.ones(len(at), bool)
            run[1:] = at[1:] != at[:-1] + 1
            first = at[run][np.cumsum(run) - 1]
            at = at[(at - first) % 2 == 0]
            symbols[at] = self.results[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            ranks[at] = ranks[at + 1]  # the end of a word stays one
            gone = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(~keep, out=gone[1:])
            new = at - gone[at]
            lens = lens - (gone[ends] - gone[ends - lens])
            symbols, ranks = symbols[keep], ranks[keep]
            ends = np.cumsum(lens)
            last = np.zeros(len(symbols), bool)
            last[ends - 1] = True
            begin = np.zeros(len(symbols), bool)
            begin[ends - lens] = True
            check = np.concatenate([new[~last[new]], new[~begin[new]] - 1])  # a place may come twice
            ranks[check] = self.rank(symbols[check], symbols[check + 1])
        ids = np.concatenate([s for _, s in done]) if done else symbols
        order = np.concatenate([w for w, _ in done]) if done else words
        # Words left in any order; put them back.
        ends = np.cumsum(counts[order])
        begin = np.empty(n, np.int64)
        begin[order] = ends - counts[order]
        return ids[ragged(begin, counts)].astype(np.int32), counts


class BytePairCodec(ChunkCache):
    """Encoder and decoder of one tokenizer file. Chunks are cut where no pre-token can span: between a printable ASCII
    or two-byte character and a space or line feed, and between an ASCII letter and a comma or full stop."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        vocabulary = model["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.table = MergeTable(vocabulary, model["merges"])
        self.first = np.array([vocabulary[c] for c in symbols], np.int64)
        self.pattern = regex.compile(PATTERN)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        if any(set(" \n,.") & set(t) for t in self.added):
            raise ValueError(f"{path}: an added token holds a place where chunks are cut")
        self.heads = {t[0] for t in self.added}
        size = max([*vocabulary.values(), *self.added.values()]) + 1
        pieces = [b""] * size
        for token, i in vocabulary.items():
            pieces[i] = bytes(map(back.__getitem__, token)) if token not in self.added else token.encode()
        for token, i in self.added.items():
            pieces[i] = token.encode()
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self._clear()

    def cut(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(buf)
        first = np.zeros(n, bool)
        shown = (buf > 32) & (buf < 127)
        shown[1:] |= (buf[1:] >= 0x80) & (buf[1:] < 0xC0) & (buf[:-1] >= 0xC3) & (buf[:-1] < 0xE0)
        letter = ((buf | 32) >= 97) & ((buf | 32) <= 122)
        first[1:] = shown[:-1] & ((buf[1:] == 32) | (buf[1:] == 10)) | letter[:-1] & ((buf[1:] == 44) | (buf[1:] == 46))
        first[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(first)
        return starts, np.append(starts[1:], n)

    def ids_of(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words: list[bytes] = []
        special: dict[int, int] = {}
        per = np.zeros(len(chunks), np.int64)
        find = self.pattern.findall
        for i, c in enumerate(chunks):
            text, before = c.decode(), len(words)
            if any(h in text for h in self.heads) and self.special.search(text):
                for part in self.special.split(text):
                    if part in self.added:
                        special[len(words)] = self.added[part]
                        words.append(b"\0")
                    else:
                        words += [w.encode() for w in find(part)]
            else:
                words += [w.encode() for w in find(text)]
            per[i] = len(words) - before
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ids, counts = self.table.merge(self.first[np.frombuffer(b"".join(words), np.uint8)], lens)
        ends = np.cumsum(counts)
        for w, i in special.items():
            ids[ends[w] - 1] = i
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])]
        return ids, np.diff(edge)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of documents of ``counts`` ids each; bytes that are not UTF-8 become replacement characters."""
        lens = self.lengths[ids]
        raw = self.bytes[ragged(self.at[ids], lens)].tobytes()
        upto = np.concatenate([[0], np.cumsum(lens)])
        ends = np.cumsum(counts)
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(upto[ends - counts].tolist(), upto[ends].tolist())]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (array of int) of every document."""

    def run(batches):
        codec = BytePairCodec.of(tokenizer)
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for a, b, ids, counts in codec.encode_all(buf, offsets):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, text (and the ids) of encoded documents; null ids are none."""

    def run(batches):
        codec = BytePairCodec.of(tokenizer)
        for batch in batches:
            lists = batch.column(1)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(counts)
            first = 0
            while first < len(counts):  # about a million ids at once
                last = max(first + 1, int(np.searchsorted(ends, ends[first] - counts[first] + (1 << 20), side="right")))
                texts = codec.decode(ids[ends[first] - counts[first] : ends[last - 1]], counts[first:last])
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(texts, pa.string()), *([own.column(1)] if keep_ids else [])], ["doc_id", "text", *(["ids"] if keep_ids else [])])
                first = last

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string" + (", ids array<int>" if keep_ids else ""))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and their decoded text of every document, in one Python pass: one codec an executor core."""

    def run(batches):
        codec = BytePairCodec.of(tokenizer)
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for a, b, ids, counts in codec.encode_all(buf, offsets):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(codec.decode(ids, counts), pa.string())], ["doc_id", "ids", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, text string")
