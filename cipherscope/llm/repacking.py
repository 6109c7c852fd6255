"""Bound-certified best-fit packing: each group of documents is packed where it was encoded and proves its own bin count;
only what a proof leaves open is exchanged.

A task encodes its documents, cuts those longer than a window into whole windows and a rest, and packs groups of about
GROUP_TOKENS tokens by best-fit decreasing. Dual feasible functions (thresholds, and thresholds with rounded multiples)
bound from below how many sequences the group's lengths need; a group that meets its bound is certified. A group without
a gap (its sequences would be as many if tokens were sand) keeps them but for the emptiest, for the bound rounds up once a
group. A group with a gap gives up every sequence that is not full: if it is not certified, its packing may be at fault; if
it is, only other partitions' documents can fill the gap. All lengths given up are bounded together: where that bound is
met, nothing moves. Else they are dealt anew into groups of EXCHANGE_TOKENS (four times as many each round, up to
GROUP_TOKENS), packed and bounded in the same way, as long as the number of sequences falls. Token ids move once, for
those pieces only.

Defined results: a null text is empty and still has its end id; repeated rows are packed as often as they stand there;
ties go to the piece that comes first; an empty table gives no rows; other columns are ignored. A text is encoded whole,
so a task holds the ids of its longest text (about ten bytes a token) besides one group.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, light, stage
from .scan import text_bytes
from .token_files import with_end
from .tokens import ChunkEncoder, ragged

WINDOW, GROUP_TOKENS, EXCHANGE_TOKENS = 4096, 1 << 22, 1 << 18
#: Rounds of exchange at most (each must save a sequence), and multiples that the bounds try.
ROUNDS, MULTIPLES = 7, 12
PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long, certified boolean"
#: A piece's place as the exchange sees it.
PLACES = "slot long, length long, sequence_id long, offset long, certified boolean, open boolean"


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that counts[n] pieces of each length n = 0 .. window need at least.

    u(x) is x itself or, for k = 1 .. MULTIPLES, floor((k + 1) x) / k (x where (k + 1) x is whole); before it, lengths over
    1 - t count as 1 and those under t as 0, for every threshold t up to a half. Each such composition is dual feasible."""
    window = len(counts) - 1
    lengths = np.arange(window + 1, dtype=np.int64)
    low = np.arange(window // 2 + 1)
    upto = np.append(0, np.cumsum(counts))
    large = upto[-1] - upto[window - low + 1]
    best = 0
    for k in range(MULTIPLES + 1):
        unit = max(1, k) * window
        value = lengths if k == 0 else np.where((k + 1) * lengths % window == 0, k * lengths, (k + 1) * lengths // window * window)
        total = np.append(0, np.cumsum(counts * value))
        middle = total[window - low + 1] - total[low]
        best = max(best, int((-(-(large * unit + middle) // unit)).max()))
    return best


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, and the free places of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, free = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    spaces: list[int] = []  # free places that some bin has, ascending
    having: dict[int, list[int]] = {}
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        k = bisect_left(spaces, n)
        if k < len(spaces):
            space = spaces[k]
            b = having[space].pop()
            if not having[space]:
                del spaces[k]
        else:
            b, space = len(free), window
            free.append(window)
        bins[i], offsets[i] = b, window - space
        free[b] = space = space - n
        if space:
            stack = having.setdefault(space, [])
            if not stack:
                insort(spaces, space)
            stack.append(b)
    return bins, offsets, np.array(free, np.int64)


def certified_pack(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, certified, given up) of each length of a group."""
    bins, offsets, free = best_fit_decreasing(lengths, window)
    certified = len(free) == lower_bound(np.bincount(lengths, minlength=window + 1))
    up = free > 0
    if len(free) == -(-int(lengths.sum()) // window):
        up &= np.arange(len(free)) == np.argmax(free)
    return bins, offsets, np.full(len(lengths), certified), up[bins]


def packed_where_encoded(docs: DataFrame, tokenizer: str, end_id: int | None, window: int, group_tokens: int) -> DataFrame:
    """Every piece with its place in its own task's sequences, and whether that place is given up."""

    def run(batches):
        encoder, part = ChunkEncoder.of(tokenizer), TaskContext.get().partitionId()
        held: list[tuple] = []
        tokens = slots = bins_before = 0

        def group():
            nonlocal held, tokens, slots, bins_before
            docs, piece, lengths, ids = (np.concatenate([h[i] for h in held]) if i else pa.concat_arrays([h[0] for h in held]) for i in range(4))
            bins, offsets, certified, up = certified_pack(lengths, window)
            edges = pa.array(np.append(0, np.cumsum(lengths)) * 4, pa.int64())
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, edges.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())
            names = ["slot", "doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "certified", "open"]
            slot = (part << 36) + slots + np.arange(len(lengths))
            yield pa.RecordBatch.from_arrays([pa.array(slot), docs, pa.array(piece.astype(np.int32)), pa.array(piece * window), pa.array(lengths), data, pa.array((part << 32) + bins_before + bins), pa.array(offsets), pa.array(certified), pa.array(up)], names)
            slots, bins_before = slots + len(lengths), bins_before + int(bins.max()) + 1
            held, tokens = [], 0

        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for a, b, ids, counts in encoder.encode_all(buf, offsets):
                ids, counts = with_end(ids, counts, end_id)
                parts = -(-counts // window)
                row = np.repeat(np.arange(b - a), parts)
                piece = ragged(np.zeros(b - a, np.int64), parts)
                lengths = np.minimum(counts[row] - piece * window, window)
                held.append((batch.column(0).slice(a, b - a).take(pa.array(row)), piece, lengths, ids))
                tokens += len(ids)
                if tokens >= group_tokens:
                    yield from group()
        if tokens:
            yield from group()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(light(run), f"slot long, {PIECES}, open boolean")


def exchange(places: DataFrame, round_: int, groups: int, window: int) -> DataFrame:
    """Deals the lengths into ``groups``, whatever task they come from, and packs each anew: PLACES."""

    def group(key, table):
        table = table.sort_by("slot")
        lengths = table.column("length").to_numpy()
        bins, offsets, certified, up = certified_pack(lengths, window)
        sequence = -1 - ((round_ << 60) + (key[0].as_py() << 32) + bins)
        return pa.table({"slot": table.column("slot"), "length": lengths, "sequence_id": sequence, "offset": offsets, "certified": certified, "open": up})

    dealt = places.select("slot", "length", F.pmod(F.xxhash64("slot", F.lit(round_)), F.lit(groups)).alias("grp"))
    return dealt.groupBy("grp").applyInArrow(group, PLACES)


def _state(places: DataFrame, window: int) -> tuple[int, int, int]:
    """(tokens, sequences, bound that no packing of these lengths goes under): at most a row a length comes to the driver."""
    counts, sequences = np.zeros(window + 1, np.int64), 0
    for n, c, heads in places.groupBy("length").agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).collect():
        counts[n], sequences = c, sequences + heads
    return int(counts @ np.arange(window + 1)), sequences, lower_bound(counts)


def repack(docs: DataFrame, tokenizer: str, end_id: int | None, window: int = WINDOW, group_tokens: int = GROUP_TOKENS, exchange_tokens: int = EXCHANGE_TOKENS) -> DataFrame:
    """Pieces of documents in as few sequences of at most ``window`` tokens as the method finds: PIECES.

    ``ids`` are little-endian unsigned 32-bit. Sequence numbers are unique, not dense."""
    pieces = stage(packed_where_encoded(docs, tokenizer, end_id, window, group_tokens), "repacking-pieces")
    left = pieces.where("open").select(*(c.split()[0] for c in PLACES.split(", ")))
    settled, (tokens, sequences, bound) = [], _state(left, window)
    for k in range(ROUNDS):
        if sequences <= bound:  # proven to be the fewest
            break
        groups = max(1, -(-tokens // min(group_tokens, exchange_tokens << 2 * k)))
        tried = stage(exchange(left, k, groups, window), f"repacking-round-{k}")
        if _state(tried, window)[1] >= sequences:  # this dealing saves nothing: the places before it stand
            discard(tried)
            break
        settled.append(tried.where("not open"))
        left = tried.where("open")
        tokens, sequences, bound = _state(left, window)
    settled.append(left)
    places = settled[0]
    for more in settled[1:]:
        places = places.unionByName(more)
    names = [c.split()[0] for c in PIECES.split(", ")]
    moved = pieces.where("open").drop("sequence_id", "offset", "certified", "length", "open").join(places.drop("open"), "slot")
    return pieces.where("not open").select(names).unionByName(moved.select(names))


def certificate(pieces: DataFrame, window: int = WINDOW) -> tuple[int, int]:
    """(sequences, bound that no packing of these pieces goes under)."""
    return _state(pieces, window)[1:]
