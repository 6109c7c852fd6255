"""Whole-text encoding by the tokenizers library, with each distinct chunk of text encoded once a process.

Texts are cut at spaces and line feeds, and before a comma or full stop after an ASCII letter. A tokenizer fits
if its tokens never span such a cut and white space has no ids of its own (the normaliser folds white space, the
splitter drops it); ``ChunkEncoder`` checks that on a probe and refuses others. Tests hold it against plain calls.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from .scan import doc_slices, run_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Stands between chunks that are encoded in one call; chunks that hold it go alone.
MARK = b"\x01"
#: Chunks in one call to the library; chunks, and their ids, that a process keeps.
TOGETHER, KEPT, KEPT_IDS = 128, 400_000, 4_000_000


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def cut_chunks(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the chunks of the documents buf[offsets[i]:offsets[i + 1]]."""
    n = len(buf)
    blank = (buf == 32) | (buf == 10)
    first = np.zeros(n + 1, dtype=bool)
    first[0] = True
    first[1:n] = blank[:-1]
    letter = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    stop = (buf == 44) | (buf == 46)
    first[1:n] |= stop[1:] & letter[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    first[:n] &= ~blank
    last = np.zeros(n + 1, dtype=bool)
    last[:n] = blank
    last |= first
    last[n] = True
    starts = np.flatnonzero(first[:n])
    marks = np.flatnonzero(last)
    return starts, marks[np.searchsorted(marks, starts, side="right")]


class ChunkCache:
    """encode(bytes, offsets) gives the ids of whole texts, as one array, and their counts; each distinct chunk is
    encoded once a process. Subclasses say where chunks are cut and what ids new chunks have."""

    _own: dict = {}

    @classmethod
    def of(cls, path: str):
        """The process's codec for this file; executors reuse their Python workers."""
        if (cls, path) not in ChunkCache._own:
            ChunkCache._own[cls, path] = cls(path)
        return ChunkCache._own[cls, path]

    def cut(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def ids_of(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, one after another, and their counts."""
        raise NotImplementedError

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.index = pd.Index(self.known)
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _slots(self, hashes: np.ndarray, chunk) -> np.ndarray:
        """Where the ids of each distinct hash are kept; chunk(i) gives the bytes of the i-th."""
        slots = self.index.get_indexer(hashes)
        new = np.flatnonzero(slots < 0)
        if not len(new):
            return slots
        if len(self.known) + len(new) > KEPT or self.used > KEPT_IDS:
            self._clear()
            slots, new = np.full(len(hashes), -1), np.arange(len(hashes))
        ids, counts = self.ids_of([chunk(i) for i in new])
        n = len(self.known)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(counts) - counts])
        self.lens = np.concatenate([self.lens, counts])
        self.known = np.concatenate([self.known, hashes[new]])
        self.index = pd.Index(self.known)
        self.used += len(ids)
        slots[new] = np.arange(n, n + len(new))
        return slots

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents buf[offsets[i]:offsets[i + 1]], and how many each has."""
        base = int(offsets[0])
        buf, offsets = buf[base : int(offsets[-1])], offsets - base
        counts = np.zeros(len(offsets) - 1, np.int64)
        if not len(buf):
            return np.zeros(0, np.int32), counts
        starts, ends = self.cut(buf, offsets)
        hashes = run_hashes(buf, starts, ends)
        codes, distinct = pd.factorize(hashes)
        where = np.zeros(len(distinct), np.int64)
        where[codes] = np.arange(len(codes))
        raw = buf.tobytes()
        slots = self._slots(distinct, lambda i: raw[starts[where[i]] : ends[where[i]]])[codes]
        lens = self.lens[slots]
        ids = self.pool[ragged(self.starts[slots], lens)]
        upto = np.concatenate([[0], np.cumsum(lens)])
        edge = np.searchsorted(starts, offsets)
        return ids, upto[edge[1:]] - upto[edge[:-1]]

    def encode_all(self, buf: np.ndarray, offsets: np.ndarray, most: int = 2 << 20):
        """(first document, last document, ids, counts) of slices of about ``most`` bytes."""
        for a, b in doc_slices(offsets, most):
            yield a, b, *self.encode(buf, offsets[a : b + 1])


class ChunkEncoder(ChunkCache):
    """The ids that the tokenizers library gives for each whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        mark = self._ids(f" {MARK.decode()} ")
        if len(mark) != 1 or self._ids("ab \n cd, e.F") != sum(map(self._ids, ("ab", "cd", ",", "e", ".F")), []):
            raise ValueError(f"{path}: not a tokenizer that drops white space")
        self.mark = mark[0]
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def cut(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return cut_chunks(buf, offsets)

    def ids_of(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([MARK not in c for c in chunks], dtype=bool)
        easy = [c.decode() for c, p in zip(chunks, plain) if p]
        sep, parts, counts = f" {MARK.decode()} ", {}, np.zeros(len(chunks), np.int64)
        flat = [np.asarray(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([sep.join(easy[i : i + TOGETHER]) + sep for i in range(0, len(easy), TOGETHER)], add_special_tokens=False)] if easy else []
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        cut = np.flatnonzero(flat == self.mark)
        if len(cut) != len(easy):
            raise ValueError("the tokenizer joined a mark with its neighbours")
        counts[plain] = np.diff(cut, prepend=-1) - 1
        if len(easy) == len(chunks):
            return flat[flat != self.mark], counts
        for i in np.flatnonzero(~plain):
            parts[i] = np.asarray(self._ids(chunks[i].decode()), np.int32)
            counts[i] = len(parts[i])
        flat, ends = flat[flat != self.mark], np.cumsum(np.where(plain, counts, 0))
        pieces = [parts[i] if i in parts else flat[ends[i] - counts[i] : ends[i]] for i in range(len(chunks))]
        return np.concatenate(pieces), counts
