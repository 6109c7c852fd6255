"""Near-duplicate vectors by a forest of random-projection trees.

A tree splits nodes level by level, by the projection on a random direction. Vectors nearer to a split than the margin go
both ways; the margin is half the standard deviation of the projected distance of two unit vectors at the threshold, so
that it depends neither on the table nor on the node. A split stands where it leaves the fewest pairs (beside a dense
group rather than inside it), and a node where no split of the direction leaves less than WORTH of its pairs stays whole
at that level: a group of near copies ends in one leaf however large it is. Trees are built from a bounded sample, which
goes both ways like the rows, then every vector is routed through all of them. Vectors are compared within leaves; a pair
that shares several leaves counts in the first of them only, which both rows can tell from the lists of their earlier
leaves, so that links are counted without listing pairs. A leaf over TILE rows is dealt into tiles and each pair of tiles
is a group of its own; of such a leaf, the rows that also share its closest earlier leaf were compared there, so only
the others meet all rows. Equal vectors are one row with their number. A group returns a row a vector: its links there,
and the smallest vector it reaches there.

A pair that no tree keeps together is missed; tests measure recall against brute force. No reported link is below the
threshold: cosines are computed in double precision from the original vectors.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing, as do those of
other lengths; rows of one vec_id are rows of one node, each with its own links; a null vec_id is kept apart as the
least; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components
from .tokens import ragged
from .vectors import cosines, lengths, matrix, prepared

#: Documented bounds: vectors sampled to place the splits, levels (so a tree has at most 2**LEVELS leaves).
SAMPLE, LEVELS = 20_000, 14
TREES, LEAF, TILE = 6, 256, 4096
#: Shares of a node where splits are tried, pairs that a split may leave, sampled vectors that a node must have for one.
SHARES, WORTH, LEAST = np.array([0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8]), 0.85, 8
BROADCAST_ROWS = 100_000
NONE = -(2**63)


class Tree:
    """Directions by level, each node's split (infinite: all go left) and the margin."""

    def __init__(self, sample: np.ndarray, levels: int, seed: int, threshold: float, least: float):
        """Nodes of at most ``least`` sampled vectors are not split."""
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.directions = rng.standard_normal((levels, d))
        self.directions /= lengths(self.directions)[:, None]
        self.margin = np.sqrt(max(0.0, 2 - 2 * threshold) / d) / 2
        self.splits = []
        nodes = {0: np.arange(len(sample))}
        for level in range(levels):
            x = sample @ self.directions[level]
            split, after = np.full(2**level, np.inf), {}
            for i, own in nodes.items():
                y = x[own]
                if len(y) > least:
                    z = np.sort(y)
                    tried = z[(SHARES * (len(z) - 1)).astype(np.int64)]
                    left, right = np.searchsorted(z, tried + self.margin, side="right"), len(z) - np.searchsorted(z, tried - self.margin, side="right")
                    pairs = left.astype(float) ** 2 + right.astype(float) ** 2
                    if pairs.min() <= WORTH * len(z) ** 2:
                        split[i] = tried[pairs.argmin()]
                after[2 * i] = own[y - split[i] <= self.margin]
                if split[i] < np.inf:
                    after[2 * i + 1] = own[y - split[i] > -self.margin]
            nodes = after
            self.splits.append(split)

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): every leaf of every row."""
        row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
        for level, direction in enumerate(self.directions):
            x = (unit @ direction)[row] - self.splits[level][node]
            left, right = x <= self.margin, x > -self.margin
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node


def local_roots(mask: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches by the links of a symmetric matrix; every row is visited once."""
    root = np.arange(len(mask))
    left = mask.any(axis=1)
    for i in np.flatnonzero(left):
        if not left[i]:
            continue
        front = np.array([i])
        while len(front):
            left[front], root[front] = False, i
            reach = np.zeros(len(mask), bool)
            for j in range(0, len(front), 512):
                reach |= mask[front[j : j + 512]].any(axis=0)
            front = np.flatnonzero(reach & left)
    return root


def compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links of one pair of tiles of a leaf that no earlier leaf has. Columns: rep, copies, vector, leaves (the row's
    earlier ones), tile."""
    n = len(table)
    rep, copies, tile = (table.column(c).to_numpy() for c in ("rep", "copies", "tile"))
    lists = table.column("leaves").combine_chunks()
    flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(n), lists.value_lengths().to_numpy())
    names, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    # The rows of the most common earlier leaf were compared with each other there.
    old = np.zeros(n, bool)
    if len(names):
        old[owner[at == counts.argmax()]] = True
    order = np.lexsort((rep, old))
    rep, copies, tile, back = rep[order], copies[order], tile[order], np.argsort(order)
    fresh = n - int(old.sum())
    links, mask = np.zeros(n, np.int64), np.zeros((n, n), bool)
    if fresh:
        x = matrix(table.column("vector"))[order]
        unit = x / lengths(x)[:, None]
        shared = counts > 1
        member = np.zeros((n, int(shared.sum())), np.float32)
        on = shared[at]
        member[back[owner[on]], (np.cumsum(shared) - 1)[at[on]]] = 1
        two = tile.min() < tile.max()
    for i in range(0, fresh, 512):
        a, b = slice(i, min(i + 512, fresh)), slice(i, n)
        c = unit[a] @ unit[b].T
        near = c >= threshold
        p, q = np.nonzero(np.abs(c - threshold) <= 1e-9)
        for j in range(0, len(p), 65536):
            own = slice(j, j + 65536)
            near[p[own], q[own]] = cosines(x[p[own] + i], x[q[own] + i]) >= threshold
        near &= tile[a, None] != tile[b] if two else np.arange(i, n) != np.arange(i, a.stop)[:, None]
        some = near.any(axis=1)
        if member.shape[1] and some.any():
            near[some] &= member[a][some] @ member[b].T == 0
        mask[a, b], mask[b, a] = near, near.T
    for i in range(0, n, 512) if fresh else ():
        links[i : i + 512] = mask[i : i + 512].astype(np.float64) @ copies
    by = np.argsort(rep, kind="stable")
    low, rep, links = rep[by], rep[by], links[by]
    if links.any():
        low = rep[local_roots(mask[np.ix_(by, by)])]
    some = links > 0
    return pa.table({"rep": rep[some], "links": links[some], "low": low[some]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    rows = prepared(vectors).withColumn("id", F.coalesce("vec_id", F.lit(NONE)))
    classes = rows.where("usable").groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = stage(classes.select("rep", "copies", "vector", F.size("vector").alias("d")), "vector-classes")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("rep", F.lit(seed)), "rep", "vector").limit(SAMPLE).select("d", "vector").toArrow()
    levels = int(min(LEVELS, max(0, np.ceil(np.log2(max(1, n) / leaf)))))
    forest = {}
    for d in set(sample.column("d").to_pylist()):
        own = matrix(sample.filter(pc.equal(sample.column("d"), d)).column("vector"))
        forest[d] = [Tree(own / lengths(own)[:, None], levels, seed + t, threshold, max(LEAST, leaf * len(sample) / n)) for t in range(trees)]
    sent = spark.sparkContext.broadcast(forest)  # bounded by SAMPLE, LEVELS and trees

    narrow = dict(vectors.dtypes)["embedding"] == "array<float>"  # travels as it came, nothing is lost

    def route(batches, whole=True):
        for batch in batches:
            ds = batch.column(3).to_numpy()
            for d in np.unique(ds):
                own = batch.filter(pa.array(ds == d))
                if d in sent.value:
                    x = matrix(own.column(2))
                    places = [t.leaves(x / lengths(x)[:, None]) for t in sent.value[d]]
                else:  # no sampled vector has this length: one leaf for all of it
                    places = [(np.arange(len(own)), np.zeros(len(own), np.int64))]
                row = np.concatenate([r for r, _ in places])
                code = np.concatenate([(t << LEVELS) + c for t, (_, c) in enumerate(places)]).astype(np.int32)
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                begin = np.searchsorted(row, np.arange(len(own)))[row]
                before = np.arange(len(row)) - begin  # earlier leaves of the same row
                sent_vectors = own.column(2).cast(pa.list_(pa.float32())) if narrow else own.column(2)
                for i in range(0, len(row), 8192):
                    part = slice(i, i + 8192)
                    at, ends = pa.array(row[part]), np.concatenate([[0], np.cumsum(before[part])])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[ragged(begin[part], before[part])]))
                    if not whole:
                        yield pa.RecordBatch.from_arrays([pa.array(code[part]), own.column(3).take(at), lists], ["code", "d", "leaves"])
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array(code[part]), *(own.column(c).take(at) for c in range(2)), sent_vectors.take(at), own.column(3).take(at), lists], ["code", "rep", "copies", "vector", "d", "leaves"])

    routed = classes.mapInArrow(route, f"code int, rep long, copies long, vector array<{'float' if narrow else 'double'}>, d int, leaves array<int>")
    places = classes.mapInArrow(partial(route, whole=False), "code int, d int, leaves array<int>")
    tiled = dealt(routed, places)

    def group(key, table):
        return compare(table, threshold)

    found = stage(tiled.groupBy("code", "d", "i", "j").applyInArrow(group, "rep long, links long, low long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # Rows of one id with different vectors are one node already: edges join ids.
    joined = components(found.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct())
    classes = classes.join(links, "rep", "left").withColumnsRenamed({"vector": "same"}).drop("d")
    out = rows.join(classes, F.col("usable") & (F.col("vector") == F.col("same")), "left").join(joined, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "id")
    real = F.when(component != NONE, component)
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"), real.alias("component_id"), (F.col("id") == component).alias("kept"))


def dealt(routed: DataFrame, places: DataFrame) -> DataFrame:
    """Adds the pair of tiles (i, j) of a leaf that a row goes to, and its own tile; most leaves are one tile.

    A leaf over TILE rows has tiles of fresh rows and tiles of old ones, which share its closest earlier leaf; fresh tiles
    meet all tiles, old ones only fresh ones.
    """
    # Large leaves, then how many rows each shares with which earlier large one: a row a leaf, or a pair of leaves.
    large = stage(places.groupBy("code", "d").count().where(F.col("count") > TILE), "vector-leaves").toDF("big", "big_d", "size")
    few = large.count() <= BROADCAST_ROWS
    sent = F.broadcast(large) if few else large
    in_large = places.join(sent, (F.col("code") == F.col("big")) & (F.col("d") == F.col("big_d"))).select("code", "d", "size", F.explode_outer("leaves").alias("earlier"))
    both = in_large.groupBy("code", "d", "size", "earlier").count()
    closest = F.max_by(F.struct("earlier", "count"), F.when(F.col("earlier").isNotNull(), F.struct("count", "earlier"))).alias("c")
    plan = both.groupBy("code", "d", "size").agg(closest).select(F.col("code").alias("big"), F.col("d").alias("big_d"), F.col("c.earlier").alias("closest"), F.coalesce("c.count", F.lit(0)).alias("shared"), "size")
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    plan = plan.select("big", "big_d", "closest", F.ceil((F.col("size") - F.col("shared")) / TILE).cast("int").alias("fresh"), tiles("shared").alias("old"))
    plan = stage(plan, "vector-tiles")
    out = routed.join(F.broadcast(plan) if few else plan, (F.col("code") == F.col("big")) & (F.col("d") == F.col("big_d")), "left")
    is_old = F.coalesce(F.array_contains("leaves", F.col("closest")), F.lit(False))
    hashed = lambda n: F.pmod(F.xxhash64("rep", F.lit(5)), F.greatest(n, F.lit(1))).cast("int")
    whole = F.col("big").isNull()
    own = F.when(whole, 0).when(is_old, F.col("fresh") + hashed(F.col("old"))).otherwise(hashed(F.col("fresh")))
    last = F.when(whole, 0).when(is_old, F.col("fresh") - 1).otherwise(F.col("fresh") + F.col("old") - 1)
    others = F.when(last >= 0, F.sequence(F.lit(0), last))  # null: every pair of the leaf is an earlier one's
    out = out.select("code", "rep", "copies", "vector", "d", "leaves", own.cast("int").alias("tile"), F.explode(others).alias("other"))
    return out.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("other")
