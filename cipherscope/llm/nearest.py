"""Nearest neighbours by a block matrix join with int8 product tiles.

Every unit vector is quantised once to int8 with a scale s of its own (a component's error is at most s / 2), and what is
left over to int8 again. Of equal vectors only the k + 1 smallest ids are candidates. Queries and candidates are dealt into
blocks; a cell of the grid (query block, candidate block) is one group of Spark's and holds int8 vectors only. There a
product tile of the integers gives each cosine within

    |u . v - s_u s_v (q . c)| <= s_u s_v (|q|_1 / 2 + |c|_1 / 2 + d / 4),

and only pairs whose upper bound reaches the query's k-th largest lower bound survive; the same bound with both parts, and
the left-over's scale, sifts them again, so that few are left of a dense group too. A heap a query merges the lower bounds
of all cells and drops survivors that cannot be among the k; the rest are joined to the original vectors, computed in
double precision, and merged by heaps again, in shares of a query first, so that no group grows with the grid.

The tiles are products of float32 matrices that hold the int8 values: exact up to 2**24, so for up to 1040 dimensions
(wider vectors are multiplied in parts).

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do null vec_ids;
vectors of other lengths than the query's are no candidates; a vec_id that stands in several rows is one candidate with
its best score, and a query with the best of its rows; fewer candidates than k give fewer rows; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .vectors import cosines, lengths, matrix, prepared

#: Rows of a query block and of a candidate block, and of the tile that is multiplied at once.
QUERIES, CANDIDATES, TILE = 8192, 16384, 1024
#: Shares in which a query's survivors are merged first.
SHARES = 32


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values of the unit vectors and their scales, int8 values of what is left over and their scales."""
    unit = x / lengths(x)[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    rest = unit - q * scale[:, None]
    fine = np.maximum(np.abs(rest).max(axis=1) / 127, 1e-30)
    return q.astype(np.int8), scale, np.rint(rest / fine[:, None]).astype(np.int8), fine


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    part = 1024
    out = np.zeros((len(q), len(c)))
    for i in range(0, q.shape[1], part):
        out += q[:, i : i + part].astype(np.float32) @ c[:, i : i + part].T.astype(np.float32)
    return out


def kth_largest(low: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Of each row, the k-th largest among the best of each id; ids are runs of columns that begin at ``first``."""
    best = np.maximum.reduceat(low, first, axis=1) if len(first) < low.shape[1] else low
    n = best.shape[1]
    return np.partition(best, n - k, axis=1)[:, n - k] if n >= k else np.full(len(low), -2.0)


def cell(query_ids: np.ndarray, queries: tuple, ids: np.ndarray, candidates: tuple, k: int):
    """(query's row, candidate's row, lower and upper bound) of the pairs that may be among a query's k best of the cell.
    ``queries`` and ``candidates`` are as of ``quantised``; candidates are in the order of their ids."""
    (qq, qs, qr, qf), (cq, cs, cr, cf), d = queries, candidates, queries[0].shape[1]
    q1, c1 = (np.abs(x.astype(np.float64)).sum(axis=1) for x in (qq, cq))
    both = lambda q, s, r, f: q * s[:, None] + r * f[:, None]
    out = []
    for i in range(0, len(query_ids), TILE):
        a = slice(i, min(i + TILE, len(query_ids)))
        floor, kept = np.full(a.stop - i, -2.0), []
        for j in range(0, len(ids), TILE):
            b = slice(j, min(j + TILE, len(ids)))
            scale = qs[a, None] * cs[b]
            near = scale * product(qq[a], cq[b])
            slack = scale * (q1[a, None] / 2 + c1[b] / 2 + d / 4) + 1e-12
            other = query_ids[a, None] != ids[b]
            floor = np.maximum(floor, kth_largest(np.where(other, near - slack, -2.0), _firsts(ids[b]), k))
            on = other & (near + slack >= floor[:, None])
            x, y = np.flatnonzero(on.any(axis=1)), np.flatnonzero(on.any(axis=0))
            if not len(x):
                continue
            # The same with both parts, of the rows and columns that still have pairs.
            u, v = both(qq[a][x], qs[a][x], qr[a][x], qf[a][x]), both(cq[b][y], cs[b][y], cr[b][y], cf[b][y])
            fu, fv = qf[a][x], cf[b][y]
            near = u @ v.T
            slack = np.abs(u).sum(axis=1)[:, None] * fv / 2 + fu[:, None] * np.abs(v).sum(axis=1) / 2 + d / 4 * fu[:, None] * fv + 1e-12
            low = np.where(other[np.ix_(x, y)], near - slack, -2.0)
            floor[x] = np.maximum(floor[x], kth_largest(low, _firsts(ids[b][y]), k))
            p, c = np.nonzero(on[np.ix_(x, y)] & (near + slack >= floor[x][:, None]))
            kept.append((x[p], y[c] + j, low[p, c], (near + slack)[p, c]))
        if kept:
            q, c, low, high = (np.concatenate(z) for z in zip(*kept))
            on = high >= floor[q]
            out.append((q[on] + i, c[on], low[on], high[on]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2


def _firsts(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))


def largest(items, k: int) -> list:
    """The k largest (value, -id), each id once with its largest value, by a heap."""
    best: dict = {}
    for v, i in items:
        if i not in best or v > best[i]:
            best[i] = v
    return heapq.nlargest(k, ((v, -i) for i, v in best.items()))


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest cosines of each query, ties to the smaller vec_id."""

    def pack(batches):
        for batch in batches:
            ds = batch.column(2).to_numpy()
            for d in np.unique(ds):
                own = batch.filter(pa.array(ds == d))
                q, scale, r, fine = quantised(matrix(own.column(1)))
                data = [pa.array([row.tobytes() for row in z], pa.binary()) for z in (q, r)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), *data, pa.array(scale), pa.array(fine)], ["vec_id", "d", "values", "rest", "scale", "fine"])

    def usable(vectors: DataFrame) -> DataFrame:
        return prepared(vectors).where("usable AND vec_id IS NOT NULL").select("vec_id", "vector", F.size("vector").alias("d"))

    def packed(rows: DataFrame, name: str) -> DataFrame:
        return stage(rows.mapInArrow(pack, "vec_id long, d int, values binary, rest binary, scale double, fine double"), name)

    smallest = Window.partitionBy("vector").orderBy("vec_id")  # k + 1 rows a task and vector are shuffled
    distinct = usable(candidates).distinct().withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1).drop("place")
    q, c = packed(usable(queries), "nearest-queries"), packed(distinct, "nearest-candidates")
    rows = -(-max(1, q.count()) // QUERIES)
    cols = -(-max(1, c.count()) // CANDIDATES)
    place = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("r", place(rows)).select("*", every(cols).alias("c"))
    right = c.withColumn("c", place(cols)).select("*", every(rows).alias("r"))

    def block(t: pa.Table) -> tuple:
        values, rest = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.int8).reshape(len(t), -1) for c in ("values", "rest"))
        return values, t.column("scale").to_numpy(), rest, t.column("fine").to_numpy()

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "low", "high"]
        if not len(a) or not len(b):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
        b = b.sort_by("vec_id")
        query_ids, ids = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
        x, y, low, high = cell(query_ids, block(a), ids, block(b), k)
        return pa.table([query_ids[x], ids[y], low, high], names)

    found = left.groupBy("r", "c", "d").cogroup(right.groupBy("r", "c", "d")).applyInArrow(join, "query_id long, vec_id long, low double, high double")
    pairs = found.groupBy("query_id", "vec_id").agg(F.max("low").alias("low"), F.max("high").alias("high"))

    def prune(table: pa.Table) -> pa.Table:
        low, high, ids = (table.column(c).to_numpy() for c in ("low", "high", "vec_id"))
        top = largest(zip(low.tolist(), ids.tolist()), k)
        return table.filter(pa.array(high >= top[-1][0])) if len(top) == k else table

    def best(table: pa.Table) -> pa.Table:
        top = largest(zip(table.column("score").to_pylist(), table.column("vec_id").to_pylist()), k)
        return pa.table({"query_id": table.column("query_id")[: len(top)], "rank": pa.array(range(1, len(top) + 1), pa.int32()), "vec_id": [-i for _, i in top], "score": [v for v, _ in top]})

    schema = "query_id long, vec_id long, low double, high double"
    share = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(SHARES))
    if cols > SHARES:
        pairs = pairs.withColumn("share", share).groupBy("query_id", "share").applyInArrow(lambda t: prune(t.drop(["share"])), schema)
    pairs = stage(pairs.groupBy("query_id").applyInArrow(prune, schema), "nearest-pairs").select("query_id", "vec_id")

    # The originals of the survivors only.
    both = pairs.join(usable(queries).drop("d").toDF("query_id", "x"), "query_id").join(usable(candidates).drop("d").toDF("vec_id", "y"), "vec_id")

    def score(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                own = batch.slice(i, 1024)
                widths = own.column(2).value_lengths().to_numpy(zero_copy_only=False)
                same = widths == own.column(3).value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(widths[same]):
                    part = own.filter(pa.array(same & (widths == d)))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cosines(matrix(part.column(2)), matrix(part.column(3))))], ["query_id", "vec_id", "score"])

    scored = both.select("query_id", "vec_id", "x", "y").mapInArrow(score, "query_id long, vec_id long, score double")
    scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return scored.groupBy("query_id").applyInArrow(best, "query_id long, rank int, vec_id long, score double")
