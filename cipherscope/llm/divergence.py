"""Source divergence audit: how far each source's use of words is from its language's other sources and from the language.

Terms are counted by (lang, source); a language keeps terms of at least ``min_docs`` documents. A group's weight of a term
is p = 1 + floor(SCALE (count + 1) / (N + V)), and the divergence from q is floor((p - q)^2 / q), all in whole numbers.

The counts are a matrix of groups by terms, cut into blocks of columns (by hash, about BLOCK_CELLS nonzero cells each) and
tiles of TILE groups. One task holds a block of a pair of tiles, as K^2 trees (K = 2): level by level a bitmap of four bits
a node, navigated by rank. Two trees are traversed together: a quadrant that is empty in both tiles has one price a pair of
groups, so only its number of columns is counted; elsewhere the traversal goes down to the leaves, where at least one of
the two groups has the term. Columns are ordered by the groups that have them, so empty quadrants are large.

Defined results: null text, lang and source are ''; each row of the table is a document, also if repeated; a group without
terms still has its rows; a language without kept terms has the value 0 for every pair; ties go to the smaller item in
UTF-8; an empty table gives no rows; other columns are ignored. A text is scanned whole, at a few bytes a byte of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import light, stage
from .scan import doc_slices, text_bytes

SCALE, MIN_DOCS, TOP = 1_000_000_000, 3, 200
#: Nonzero cells of a block of columns, groups of a tile, and states of a traversal held at once.
BLOCK_CELLS, TILE, STATES = 1 << 17, 256, 1 << 18
#: Bytes of text whose terms are counted together.
SCAN_BYTES = 8 << 20
#: A part's rows; of pairs also the columns seen in the block, all of the language's, and the price of one that both lack.
PARTS = "lang string, source string, part string, item string, value long, seen long, kept long, price long"


def terms_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The terms of the documents buf[offsets[i]:offsets[i + 1]], A-Z lower-cased, and the document of each."""
    buf = np.where((buf >= 65) & (buf <= 90), buf | 32, buf)
    inside = ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    first = inside.copy()
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    upto = np.append(0, np.cumsum(inside))
    edges = pa.array(np.append(upto[starts], upto[-1]), pa.int64())
    terms = pa.LargeStringArray.from_buffers(len(starts), edges.buffers()[1], pa.py_buffer(buf[inside].tobytes()))
    return terms.cast(pa.string()), np.searchsorted(offsets, starts, side="right") - 1


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), exact over all rows."""

    def run(batches):
        for batch in batches:
            groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
            keys, codes = np.unique(batch.column(0).dictionary_encode().indices.to_numpy().astype(np.int64) << 32 | batch.column(1).dictionary_encode().indices.to_numpy(), return_inverse=True)
            example = np.zeros(len(keys), np.int64)
            example[codes] = np.arange(len(codes))
            buf, offsets = text_bytes(batch.column(2))
            for a, b in doc_slices(offsets, SCAN_BYTES):
                base = int(offsets[a])
                terms, doc = terms_of(buf[base : int(offsets[b])], offsets[a : b + 1] - base)
                if not len(terms):
                    continue
                coded = terms.dictionary_encode()
                size = len(coded.dictionary)
                pairs, n = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)
                cells, of = np.unique(codes[a + pairs // size] * size + pairs % size, return_inverse=True)
                total, in_docs = np.zeros(len(cells), np.int64), np.bincount(of, minlength=len(cells))
                np.add.at(total, of, n)
                group = groups.take(pa.array(example[cells // size]))
                yield pa.RecordBatch.from_arrays([group.field(0), group.field(1), coded.dictionary.take(pa.array(cells % size)), pa.array(total), pa.array(in_docs)], ["lang", "source", "term", "n", "d"])

    return docs.mapInArrow(light(run), "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


class Tree:
    """A K^2 tree, K = 2, of nonzero cells of a square of 2^height; leaves stand in the order of ``order``."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, height: int):
        code = _spread(rows) << 1 | _spread(cols)
        self.order = np.argsort(code, kind="stable")
        nodes, self.bits, self.rank = code[self.order], [], []
        for _ in range(height):
            parents = np.unique(nodes >> 2)
            bits = np.zeros(4 * len(parents), bool)
            bits[4 * np.searchsorted(parents, nodes >> 2) + (nodes & 3)] = True
            self.bits.append(bits)
            self.rank.append(np.cumsum(bits) - 1)
            nodes = parents
        self.bits.reverse()
        self.rank.reverse()
        self.root = 0 if len(code) else -1

    def child(self, level: int, nodes: np.ndarray, quadrant) -> np.ndarray:
        """The nodes' children in a quadrant of the next level; -1 where it is empty."""
        if not len(self.order):
            return nodes
        at = 4 * np.maximum(nodes, 0) + quadrant
        return np.where((nodes >= 0) & self.bits[level][at], self.rank[level][at], -1)


def _spread(x: np.ndarray) -> np.ndarray:
    """Puts a zero between the bits of numbers under 2^31."""
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << shift) & mask
    return x


def joint_prices(a: Tree, b: Tree, height: int, n_cols: int, base: tuple[np.ndarray, np.ndarray], weights: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Divergences of every group of a from every one of b, and of b's from a's, summed over all columns.

    ``base`` has each group's weight of a term that it does not have, ``weights`` those of the leaves, in each tree's order.
    Where a is b, only pairs with the first group before the second are filled."""
    (base_a, base_b), (n_a, n_b), same = base, map(len, base), a is b
    there, back = np.zeros(n_a * n_b, np.int64), np.zeros(n_a * n_b, np.int64)
    empty = np.zeros((n_a, n_b), np.int64)
    zero = np.zeros(1, np.int64)
    stack = [(0, np.array([a.root]), np.array([b.root]), zero, zero, zero)]
    while stack:
        level, x, y, s, t, c = stack.pop()
        if len(x) > STATES:
            stack += [(level, *(v[i : i + STATES] for v in (x, y, s, t, c))) for i in range(0, len(x), STATES)]
            continue
        both = (x < 0) & (y < 0)
        if both.any():
            width = 1 << (height - level)
            columns = np.minimum(n_cols - (c[both] << (height - level)), width)
            if width == 1:
                np.add.at(empty.reshape(-1), s[both] * n_b + t[both], columns)
            else:
                for i, j, n in _merged(s[both], t[both], columns):
                    empty[i * width : (i + 1) * width, j * width : (j + 1) * width] += n
            x, y, s, t, c = (v[~both] for v in (x, y, s, t, c))
        if not len(x):
            continue
        if level == height:
            p = np.where(x >= 0, weights[0][x], base_a[s])
            q = np.where(y >= 0, weights[1][y], base_b[t])
            square = (p - q) ** 2
            np.add.at(there, s * n_b + t, square // q)
            np.add.at(back, s * n_b + t, square // p)
            continue
        rest, grown = height - level - 1, []
        for i in (0, 1):
            for j in (0, 1):
                for k in (0, 1):
                    s2, t2, c2 = 2 * s + i, 2 * t + j, 2 * c + k
                    real = (s2 << rest < n_a) & (t2 << rest < n_b) & (c2 << rest < n_cols)
                    if same:
                        real &= (s2 < t2) | (s2 == t2) & (rest > 0)
                    if real.any():
                        s2, t2, c2 = s2[real], t2[real], c2[real]
                        grown.append((a.child(level, x[real], 2 * i + k), b.child(level, y[real], 2 * j + k), s2, t2, c2))
        if grown:
            stack.append((level + 1, *(np.concatenate(v) for v in zip(*grown))))
    square = (base_a[:, None] - base_b[None, :]) ** 2
    return there.reshape(n_a, n_b) + empty * (square // base_b[None, :]), back.reshape(n_a, n_b) + empty * (square // base_a[:, None])


def _merged(s: np.ndarray, t: np.ndarray, n: np.ndarray):
    """(s, t, sum of n) of each pair of row quadrants."""
    pairs, of = np.unique(s << 32 | t, return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, of, n)
    return zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), total.tolist())


def block_prices(key, cells: pa.Table, groups: pa.Table, tile: int = TILE, top: int = TOP) -> pa.Table:
    """Partial sums of all pairs of groups of two tiles over a block's columns, and the block's best terms of each group."""
    lang, _, tile_a, tile_b = (k.as_py() for k in key)
    groups = groups.sort_by("place")
    place, names, floor = groups.column("place").to_numpy(), groups.column("source").combine_chunks(), groups.column("floor").to_numpy()
    terms = cells.column("term").combine_chunks()
    vocabulary = pc.unique(terms)
    vocabulary = vocabulary.take(pc.sort_indices(vocabulary))
    col = pc.index_in(terms, vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    row, p, q = (cells.column(c).to_numpy() for c in ("place", "p", "q"))
    # Columns that the same groups have stand together.
    having = np.zeros(len(vocabulary), np.uint64)
    np.bitwise_or.at(having, col, np.uint64(1) << (row % 64).astype(np.uint64))
    moved = np.empty(len(vocabulary), np.int64)
    moved[np.argsort(having, kind="stable")] = np.arange(len(vocabulary))
    height = max(1, int(max(len(vocabulary), tile) - 1).bit_length())
    trees, bases, weights, spans = [], [], [], []
    for k in dict.fromkeys((tile_a, tile_b)):
        own, cell = place // tile == k, row // tile == k
        tree = Tree(row[cell] - k * tile, moved[col[cell]], height)
        trees.append(tree)
        bases.append(floor[own])
        weights.append(np.append(p[cell][tree.order], 0))
        spans.append(np.flatnonzero(own))
    two = len(trees) - 1
    there, back = joint_prices(trees[0], trees[two], height, len(vocabulary), (bases[0], bases[two]), (weights[0], weights[two]))
    price = (bases[0][:, None] - bases[two][None, :]) ** 2
    i, j = np.triu_indices(len(bases[0]), 1) if not two else (x.ravel() for x in np.indices(there.shape))
    s, t = spans[0][i], spans[two][j]
    source, item = names.take(pa.array(np.append(s, t))), names.take(pa.array(np.append(t, s)))
    part, value = np.zeros(2 * len(s), np.int8), np.append(there[i, j], back[i, j])
    price = np.append(price[i, j] // bases[two][j], price[i, j] // bases[0][i])
    if tile_a == tile_b:
        gain = np.flatnonzero(p > q)
        worth = (p[gain] - q[gain]) ** 2 // q[gain]
        order = np.lexsort((col[gain], -worth, row[gain]))
        rows = row[gain][order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = order[rank < top]
        source = pa.concat_arrays([source, names.take(pa.array(np.searchsorted(place, row[gain][best])))])
        item = pa.concat_arrays([item, vocabulary.take(pa.array(col[gain][best]))])
        part, value = np.append(part, np.ones(len(best), np.int8)), np.append(value, worth[best])
    kind = pa.array(["pair", "term"]).take(pa.array(part))
    return pa.table({"lang": pa.array([lang] * len(part), pa.string()), "source": source, "part": kind, "item": item, "value": value, "seen": np.full(len(value), len(vocabulary)), "kept": np.full(len(value), groups.column("kept")[0].as_py()), "price": np.append(price, np.zeros(len(value) - len(price), np.int64))})


def _weight(count: str) -> str:
    return f"1 + (CAST({SCALE} AS DECIMAL(19,0)) * CAST({count} + 1 AS DECIMAL(19,0))) div CAST(%s AS DECIMAL(20,0))"


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, block_cells: int = BLOCK_CELLS, tile: int = TILE, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has every other source of the language, ``term`` the ``top`` terms
    that the group uses more than its language does."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    word = Window.partitionBy("lang", "term")
    counts = term_counts(texts).withColumns({"total": F.sum("n").over(word), "docs": F.sum("d").over(word), "first": F.min("source").over(word)})
    cells = stage(counts.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "total", (F.col("source") == F.col("first")).cast("long").alias("head")), "divergence-cells")
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count("*").alias("cells"), F.sum("head").alias("heads"))
    langs = sums.groupBy("lang").agg(F.sum("own").alias("everything"), F.sum("cells").alias("cells"), F.sum("heads").alias("kept"))
    # A row a group: its place in its language and its weight of terms that it does not have.
    groups = texts.select("lang", "source").distinct().join(sums.select("lang", "source", "own"), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = groups.withColumns({"place": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1, "tiles": F.ceil(F.count("*").over(Window.partitionBy("lang")) / tile).cast("int"), "blocks": F.greatest(F.lit(1), F.ceil(F.col("cells") / block_cells).cast("int"))})
    groups = stage(groups.withColumn("floor", F.expr(_weight("0") % "greatest(1, own + kept)")).withColumn("tile", F.floor(F.col("place") / tile).cast("int")), "divergence-groups")

    def of_tiles(frame):
        other = frame.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return other.withColumns({"tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")})

    placed = cells.join(groups.withColumnRenamed("place", "row"), ["lang", "source"])
    left = of_tiles(placed).select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "tile_a", "tile_b", F.col("row").alias("place"), "term", F.expr(_weight("n") % "(own + kept)").alias("p"), F.expr(_weight("total") % "(everything + kept)").alias("q"))
    right = of_tiles(groups).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", "block", "tile_a", "tile_b", "place", "source", "floor", "kept")
    def block(key, cells, rows):
        return block_prices(key, cells, rows, tile, top)

    keys = ["lang", "block", "tile_a", "tile_b"]
    parts = stage(left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(block, PARTS), "divergence-parts")
    # Columns that no group of two tiles has are in no block of theirs.
    rest = (F.max("kept") - F.sum("seen")) * F.max("price")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg((F.sum("value") + rest).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = parts.where("part = 'term'").drop("seen", "kept", "price").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
