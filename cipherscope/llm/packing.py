"""Mixture-controlled packing: deficit round-robin over one queue a source fills every window to the target proportions.

A queue is a source's documents, one after another. A schedule says how many tokens of each queue are due once t tokens
are packed: its share of them, by ``targets`` (named sources get their proportions until one is used up, the rest are then
scaled up; unnamed sources are one queue, served when the named ones are used up), or without targets by the corpus's own
proportions, so that all queues end together. Each window adds what falls due in it to a queue's deficit, serves whole
tokens, and carries the deficit to the next window.

``groups`` of about GROUP_TOKENS tokens cut the queues along the schedule, and each is packed by one task. Deficits cross
groups: a queue starts a group with what was due to it until then less what it was served, which the schedule gives in
closed form. A group's last window is continued by the next group, so only the very last sequence can be short.

Defined results: a null text is empty and still has its end id; a null source is a queue of its own; repeated rows are
packed as often as they stand there; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import light, stage
from .scan import text_bytes
from .token_files import with_end
from .tokens import ChunkEncoder

WINDOW, GROUP_TOKENS = 4096, 1 << 20
#: Rows of the table (input partition, queue) up to which it is broadcast; beyond, Spark joins it by key.
BROADCAST_ROWS = 100_000
#: Groups whose sizes are summed up together before they are summed up one by one.
RUN = 4096
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, source string, sequence_id long, offset long"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """part, queue, at (tokens of the same part and queue before), doc_id, n_tokens, ids (little-endian)."""

    def encode(batches):
        encoder, part, upto = ChunkEncoder.of(tokenizer), TaskContext.get().partitionId(), {}
        kind = "<u2" if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for a, b, ids, counts in encoder.encode_all(buf, offsets):
                ids, counts = with_end(ids, counts, end_id)
                queues, at = batch.column(2).slice(a, b - a), np.zeros(b - a, np.int64)
                for i, (q, n) in enumerate(zip(queues.to_pylist(), counts.tolist())):
                    at[i] = upto.get(q, 0)
                    upto[q] = int(at[i]) + n
                width = int(kind[-1])
                edges = pa.array(np.concatenate([[0], np.cumsum(counts)]) * width, pa.int64())
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, edges.buffers()[1], pa.py_buffer(ids.astype(kind).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part)), queues, pa.array(at), batch.column(0).slice(a, b - a), pa.array(counts), data], ["part", "queue", "at", "doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(light(encode), "part long, queue string, at long, doc_id long, n_tokens long, ids binary")


class Schedule:
    """What is due to each queue, and which part of a queue belongs to which group. Whole numbers only: exact at any size."""

    def __init__(self, everything: int, groups: int, totals: dict | None = None, targets: dict | None = None):
        """``totals`` by queue and ``targets`` for a mixture; without them each queue's own total says all."""
        self.everything, self.groups = everything, groups
        #: (t, {queue: (served before t, share's numerator, denominator)}) of each phase; t and served are Fractions.
        self.phases = target_phases(totals, targets) if targets is not None else None

    def due(self, queue, total: int, t: int) -> Fraction:
        """Of the first t tokens."""
        if self.phases is None:
            return Fraction(total * t, max(1, self.everything))
        first, queues = self.phases[bisect_right(self.phases, t, key=lambda p: p[0]) - 1]
        if queue not in queues:  # used up
            return Fraction(total)
        before, share = queues[queue]
        return min(Fraction(total), before + share * (t - first))

    def edge(self, queue, total: int, g: int) -> int:
        """Tokens of the queue that groups 0 .. g - 1 have."""
        if g >= self.groups:
            return total
        if self.phases is None:
            return total * g // self.groups
        return int(self.due(queue, total, self.everything * g // self.groups))

    def group(self, queue, total: int, p: int) -> tuple[int, int]:
        """The group that token p of the queue belongs to, and where its part of the queue ends."""
        if self.phases is None:
            g = ((p + 1) * self.groups - 1) // total
        else:
            g, high = 0, self.groups - 1
            while g < high:
                mid = (g + high + 1) // 2
                g, high = (mid, high) if self.edge(queue, total, mid) <= p else (g, mid - 1)
        return g, self.edge(queue, total, g + 1)


def target_phases(totals: dict, targets: dict) -> list:
    """Until a queue is used up all get their proportions; each end of a queue starts a new phase. Unnamed queues wait."""
    left, served, phases, t = {q: Fraction(n) for q, n in totals.items() if n}, {q: Fraction(0) for q in totals}, [], Fraction(0)
    while left:
        weights = {q: Fraction(targets.get(q, 0)).limit_denominator(10**6) for q in left}
        if not sum(weights.values()):
            weights = dict(left)
        whole = sum(weights.values())
        shares = {q: w / whole for q, w in weights.items()}
        lasts = min(left[q] / s for q, s in shares.items() if s)
        phases.append((t, {q: (served[q], s) for q, s in shares.items()}))
        for q, s in shares.items():
            left[q] -= s * lasts
            served[q] += s * lasts
        left = {q: n for q, n in left.items() if n}
        t += lasts
    return phases or [(Fraction(0), {})]


def deficit_round_robin(totals: np.ndarray, quanta: np.ndarray, carried: np.ndarray, phase: int, window: int) -> np.ndarray:
    """Tokens that each window (row) takes of each queue (column), ``totals`` in all. The first window has window - phase
    places left; ``quanta`` is what falls due to each queue in each window, ``carried`` the deficits at the start.

    Every window adds a quantum to each deficit, serves the whole tokens of it, and gives places still free to the largest
    deficits that have tokens; what a queue was served too much or too little stays in its deficit.
    """
    left, deficit = totals.astype(np.int64).copy(), carried.astype(float).copy()
    out, room = np.zeros((len(quanta), len(totals)), np.int32), window - phase
    for w, quantum in enumerate(quanta):
        deficit += quantum
        take = np.minimum(np.maximum(np.floor(deficit), 0).astype(np.int64), left)
        over = int(take.sum()) - room
        if over > 0:
            for q in np.argsort(deficit - take, kind="stable"):
                less = min(over, int(take[q]))
                take[q] -= less
                over -= less
                if not over:
                    break
        free = min(room - int(take.sum()), int((left - take).sum()))
        while free > 0:
            for q in np.argsort(take - deficit, kind="stable"):
                if left[q] > take[q]:
                    take[q] += 1
                    free -= 1
                    if not free:
                        break
        deficit -= take
        left -= take
        out[w] = take
        room = window
    return out


def pack_group(table: pa.Table, window: int, schedule: Schedule) -> pa.Table:
    """The pieces of one group. Columns: start_all, queue, total, at, doc_id, start, doc_tokens, width, ids."""
    table = table.sort_by([("queue", "ascending"), ("at", "ascending")])
    names, width = table.column("queue").combine_chunks(), table.column("width")[0].as_py()
    keys = names.fill_null("").to_numpy(zero_copy_only=False)
    null = names.is_null().to_numpy(zero_copy_only=False)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])
    queue = np.cumsum(fresh) - 1
    data = table.column("ids").combine_chunks().to_pylist()
    sizes = np.array([len(x) // width for x in data], np.int64)
    blob = np.frombuffer(b"".join(data), f"<u{width}").astype("<u4")
    del data
    totals = np.bincount(queue, sizes).astype(np.int64)
    begin = table.column("start_all")[0].as_py()
    # What is due at each window's end; a queue's first token here says what groups before have served.
    ends = np.append(np.arange(window - begin % window, int(totals.sum()), window), int(totals.sum()))
    head = np.flatnonzero(fresh)
    whole, at = (table.column(c).to_numpy()[head].tolist() for c in ("total", "at"))
    named = names.take(pa.array(head)).to_pylist()
    carried = np.array([float(schedule.due(q, n, begin) - p) for q, n, p in zip(named, whole, at)])
    if schedule.phases is None:
        quanta = np.diff(ends, prepend=0)[:, None] * (np.array(whole, float) / schedule.everything)
    else:
        quanta = np.diff([[float(schedule.due(q, n, begin + int(e)) - p) for q, n, p in zip(named, whole, at)] for e in ends], axis=0, prepend=carried[None])
    takes = deficit_round_robin(totals, quanta, carried, begin % window, window)
    # Cut each queue at its documents' and its windows' edges; all queues stand one after another in blob.
    base = np.cumsum(totals) - totals
    served = np.cumsum(takes, axis=0, dtype=np.int32)
    served += base.astype(np.int32)
    within = np.cumsum(takes, axis=1, dtype=np.int32)
    within -= takes
    within[0] += begin % window
    edges = np.cumsum(sizes)
    cuts = np.unique(np.concatenate([edges - sizes, (served - takes)[takes > 0]]))
    lengths = np.diff(cuts, append=edges[-1])
    row = np.searchsorted(edges, cuts, side="right")
    q = queue[row]
    w = np.empty(len(cuts), np.int64)
    of = np.searchsorted(q, np.arange(len(totals) + 1))
    for k in range(len(totals)):
        own = slice(of[k], of[k + 1])
        w[own] = np.searchsorted(served[:, k], cuts[own], side="right")
    offset = within[w, q] + cuts - (served - takes)[w, q]
    starts = table.column("start").to_numpy()[row] + cuts - (edges - sizes)[row]
    bounds = pa.array(np.append(cuts, edges[-1]) * 4, pa.int64())
    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, bounds.buffers()[1], pa.py_buffer(blob.tobytes())]).cast(pa.binary())
    take = pa.array(row)
    return pa.table({"doc_id": table.column("doc_id").take(take), "start": starts, "length": lengths, "ids": ids, "doc_tokens": table.column("doc_tokens").take(take), "source": table.column("queue").take(take), "sequence_id": begin // window + w, "offset": offset})


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, targets: dict | None = None, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens: PIECES.

    ``targets`` maps sources to proportions (unnamed sources share what is left when those are used up); without it
    the proportions are the corpus's own. Each task holds one group's tokens, whatever the sizes of sources and documents.
    """
    spark = docs.sparkSession
    named = F.col("source").cast("string")
    queue = named if targets is None else F.when(named.isin(list(targets)), named)
    tokens = stage(tokenized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", queue.alias("queue")), tokenizer, end_id), "packing-tokens")
    sums = stage(tokens.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n")), "packing-sums")
    own = Window.partitionBy("queue")
    parts = sums.withColumn("before", F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(own)).drop("n")  # a row for each input partition
    everything = sums.agg(F.sum("n")).first()[0] or 0
    # With targets there is a queue a named source and one of all others.
    totals = {r[0]: r[1] for r in sums.groupBy("queue").agg(F.sum("n")).collect()} if targets is not None else None
    schedule = Schedule(everything, max(1, everything // group_tokens), totals, targets)
    few = sums.count() <= BROADCAST_ROWS
    tokens = tokens.withColumnsRenamed({"queue": "q", "part": "p"})
    placed = tokens.join(F.broadcast(parts) if few else parts, tokens.q.eqNullSafe(F.col("queue")) & (tokens.p == F.col("part")))
    placed = placed.select("queue", "total", (F.col("before") + F.col("at")).alias("at"), "n_tokens", "doc_id", "ids")

    def groups_of(queues, totals, starts, counts):
        """(row, group, first token, last token) of every part that the groups' edges cut."""
        known: dict = {}
        for row, (q, total, at, n) in enumerate(zip(queues, totals, starts, counts)):
            done = at
            while done < at + n:
                low, high, g = known.get(q, (0, 0, 0))
                if not low <= done < high:
                    g, high = schedule.group(q, total, done)
                    known[q] = done, high, g
                upto = min(at + n, high)
                yield row, g, done, upto
                done = upto

    def lengths(batches):
        sizes: dict = {}
        for batch in batches:
            for _, g, a, b in groups_of(*(c.to_pylist() for c in batch.columns)):
                sizes[g] = sizes.get(g, 0) + b - a
        yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.int64()), pa.array(list(sizes.values()), pa.int64())], ["grp", "n"])

    # Where each group begins in the whole, before any token moves: sums of runs of groups, then inside each run.
    sizes = placed.select("queue", "total", "at", "n_tokens").mapInArrow(lengths, "grp long, n long").groupBy("grp").agg(F.sum("n").alias("n"))
    sizes = stage(sizes.withColumn("run", F.floor(F.col("grp") / RUN)), "packing-groups")
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sizes.groupBy("run").agg(F.sum("n").alias("n")).select("run", upto(Window.orderBy("run")).alias("earlier"))  # a row for RUN groups
    begins = sizes.withColumn("inside", upto(Window.partitionBy("run").orderBy("grp"))).join(runs, "run").select("grp", (F.col("earlier") + F.col("inside")).alias("start_all"))

    def cut(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                queues, totals, starts, counts = (c.to_pylist() for c in batch.columns[:4])
                parts = list(groups_of(queues, totals, starts, counts))
                row = np.array([p[0] for p in parts], np.int64)
                first, last = (np.array([p[c] for p in parts], np.int64) for c in (2, 3))
                at, n, ids = np.array(starts, np.int64)[row], np.array(counts, np.int64)[row], batch.column(5)
                width = np.array([len(x) for x in ids.to_pylist()], np.int64)[row] // n
                pieces = pa.array([ids[r].as_buffer()[a:b].to_pybytes() for r, a, b in zip(row.tolist(), ((first - at) * width).tolist(), ((last - at) * width).tolist())], pa.binary())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array([p[1] for p in parts], pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(first), batch.column(4).take(take), pa.array(first - at), pa.array(n), pa.array(width.astype(np.int32)), pieces], ["grp", "queue", "total", "at", "doc_id", "start", "doc_tokens", "width", "ids"])

    pieces = placed.mapInArrow(light(cut), "grp long, queue string, total long, at long, doc_id long, start long, doc_tokens long, width int, ids binary")

    return pieces.join(begins, "grp").groupBy("grp").applyInArrow(lambda table: pack_group(table, window, schedule), PIECES)
