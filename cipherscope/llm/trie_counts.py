"""Unigram token counts: distinct pre-tokens share a trie, each shared prefix gets its forward score once.

Pieces come from a public sentencepiece file; their unigram log-probabilities follow the Zipf-Mandelbrot law of their
place in it (nothing is trained). A pre-token is a run without blanks, with the file's word mark in front. Walking the
sorted pre-tokens is a depth-first walk of their trie: the forward scores of the prefix that a pre-token shares with the
one before stay on the stack, new characters push theirs, and the count at its last character is stored. A character
that no piece holds costs a token for each of its UTF-8 bytes.

Of the best segmentations the one with the fewest tokens counts. Counts of a document add up its pre-tokens' counts.

Defined results: a null text, or one of blanks alone, has no tokens; repeated rows give repeated results; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import doc_slices, run_hashes, text_bytes

#: Parameters of the piece law: log p(rank) = -log(rank + SHIFT) - log Z; a byte of an unknown character is much rarer.
SHIFT, UNKNOWN = 2.7, -20.0
#: Distinct pre-tokens whose counts a process keeps.
KEPT = 400_000
MARK = "▁"


def piece_scores(path: str) -> dict[str, float]:
    """Log-probability of every ordinary piece of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + SHIFT) for r in range(len(pieces))))
    return {p: -math.log(r + SHIFT) - total for r, p in enumerate(pieces)}


class TrieCounter:
    _own: dict = {}

    @classmethod
    def of(cls, path: str) -> "TrieCounter":
        if path not in cls._own:
            cls._own[path] = cls(piece_scores(path))
        return cls._own[path]

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores))
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.index = pd.Index(self.known)

    def pretoken_counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each distinct pre-token (without its mark)."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out = np.zeros(len(words), np.int64)
        get, longest = self.scores.get, self.longest
        best, tokens = [0.0], [0]  # forward score and count of each prefix on the stack
        before = ""
        for i in order:
            word = MARK + words[i]
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                n = len(word[end - 1].encode())
                high, count = best[end - 1] + UNKNOWN * n, tokens[end - 1] + n
                for start in range(max(0, end - longest), end):
                    s = get(word[start:end])
                    if s is not None:
                        s += best[start]
                        if s > high or s == high and tokens[start] + 1 < count:
                            high, count = s, tokens[start] + 1
                best.append(high)
                tokens.append(count)
            out[i] = tokens[-1]
            before = word
        return out

    def count(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, pre-tokens) of the documents buf[offsets[i]:offsets[i + 1]]."""
        base = int(offsets[0])
        buf, offsets = buf[base : int(offsets[-1])], offsets - base
        docs = len(offsets) - 1
        blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
        first = ~blank
        first[1:] &= blank[:-1]
        edges = offsets[:-1][offsets[:-1] < len(buf)]
        first[edges] = ~blank[edges]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.zeros(docs, np.int64), np.zeros(docs, np.int64)
        stops = np.flatnonzero(np.append(blank | first, True))
        ends = stops[np.searchsorted(stops, starts, side="right")]
        codes, distinct = pd.factorize(run_hashes(buf, starts, ends))
        slots = self.index.get_indexer(distinct)
        new = np.flatnonzero(slots < 0)
        if len(self.known) + len(new) > KEPT:
            self.known, self.counts, new = self.known[:0], self.counts[:0], np.arange(len(distinct))
        if len(new):
            where = np.zeros(len(distinct), np.int64)
            where[codes] = np.arange(len(codes))
            raw = buf.tobytes()
            counts = self.pretoken_counts([raw[starts[where[i]] : ends[where[i]]].decode() for i in new])
            slots[new] = len(self.known) + np.arange(len(new))
            self.known, self.counts = np.concatenate([self.known, distinct[new]]), np.concatenate([self.counts, counts])
            self.index = pd.Index(self.known)
        edge = np.searchsorted(starts, offsets)
        upto = np.concatenate([[0], np.cumsum(self.counts[slots[codes]])])
        return upto[edge[1:]] - upto[edge[:-1]], np.diff(edge)


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, n_pretokens of every document."""

    def run(batches):
        counter = TrieCounter.of(model)
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for a, b in doc_slices(offsets, 2 << 20):
                tokens, words = counter.count(buf, offsets[a : b + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(tokens), pa.array(words)], ["doc_id", "n_tokens", "n_pretokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long")
