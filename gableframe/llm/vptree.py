"""Nearest neighbours by inner product, with vantage-point trees in shards."""

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gableframe.scratch import settle

NEAREST = 20
SHARD, BLOCK, LEAF = 20_000, 20_000, 512
# Cells of the upper tree at most, and points it is grown from.
MOST_CELLS, SAMPLE = 4096, 8192
FACTOR = 1.0
# Distances of equal vectors differ by rounding; so much more is searched.
SLACK = 1e-6
PAIRS = 1 << 21


class Space:
    """The upper levels of one vantage-point tree: cells that shards are made of.

    A node holds all within a radius of its vantage point in one branch and all others in the other,
    so that the distance of a query to that radius bounds its distance to all points of a branch,
    seen or not.
    """

    def __init__(self, points: np.ndarray, cells: int):
        self.n = 0
        self.root = self._grow(points, cells)

    def _grow(self, points: np.ndarray, cells: int) -> tuple:
        if cells > 1 and len(points) > 1:
            spread = ((points - points[0]) ** 2).sum(axis=1)
            vantage = points[spread.argmax()]
            away = np.sqrt(((points - vantage) ** 2).sum(axis=1))
            radius = float(np.median(away))
            inner = away <= radius
            if not inner.all():
                return vantage, radius, self._grow(points[inner], cells // 2), self._grow(points[~inner], cells - cells // 2)
        self.n += 1
        return (self.n - 1,)

    def cells(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(points), np.int64)

        def walk(node: tuple, rows: np.ndarray) -> None:
            if len(node) == 1:
                out[rows] = node[0]
            elif len(rows):
                inner = np.sqrt(((points[rows] - node[0]) ** 2).sum(axis=1)) <= node[1]
                walk(node[2], rows[inner])
                walk(node[3], rows[~inner])

        walk(self.root, np.arange(len(points)))
        return out

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """No point of a cell is nearer than this: a row per point, a column per cell."""
        out = np.zeros((len(points), self.n))

        def walk(node: tuple, least: np.ndarray) -> None:
            if len(node) == 1:
                out[:, node[0]] = least
            else:
                away = np.sqrt(((points - node[0]) ** 2).sum(axis=1))
                walk(node[2], np.maximum(least, away - node[1]))
                walk(node[3], np.maximum(least, node[1] - away))

        walk(self.root, np.zeros(len(points)))
        return out


class Tree:
    """Points around a vantage point: the nearer half in one branch, the others in another."""

    def __init__(self, points: np.ndarray, at: np.ndarray | None = None):
        self.at = np.arange(len(points)) if at is None else at
        self.points = points[self.at]
        self.branches: list[tuple[float, float, Tree]] = []
        if len(self.at) <= LEAF:
            self.squares = (self.points**2).sum(axis=1)
            return
        spread = ((self.points - self.points[0]) ** 2).sum(axis=1)
        self.vantage = self.points[spread.argmax()]
        away = np.sqrt(((self.points - self.vantage) ** 2).sum(axis=1))
        order = away.argsort(kind="stable")
        for half in np.split(order, [len(order) // 2]):
            self.branches.append((away[half[0]], away[half[-1]], Tree(points, self.at[half])))
        self.points = None


class Search:
    """The nearest points of a block of queries, all of which walk down a tree together.

    A first walk finds how far the nearest reach, a second one all that are no farther, whose
    products are then computed as they are defined, so that ties are true ones. limits says how far a
    query need look, as far as is known beforehand.
    """

    def __init__(
        self, asked: np.ndarray, points: np.ndarray, longest: float, firsts: np.ndarray, most: int, factor: float, limits: np.ndarray | None = None
    ):
        self.tree = Tree(extended(points, longest))
        self.queries = np.column_stack([asked, np.zeros(len(asked))])
        self.squares = (self.queries**2).sum(axis=1)
        self.asked, self.given, self.firsts = asked, points, firsts
        self.most, self.factor, self.slack = most, factor, SLACK * max(1e-30, longest) ** 0.5
        self.limits = np.full(len(asked), np.inf) if limits is None else limits
        self.reach = np.full((len(asked), most), np.inf)  # squared distances
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def nearest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, point and product of the most nearest points of each query."""
        everyone = np.arange(len(self.queries))
        self._walk(self.tree, everyone, self._narrow)
        self._walk(self.tree, everyone, self._gather)
        return self._best()

    def _far(self, rows: np.ndarray) -> np.ndarray:
        """How far queries look: to the worst of the nearest found, and not beyond their limits."""
        return np.minimum(np.sqrt(self.reach[rows, -1]), self.limits[rows]) + self.slack

    def _walk(self, tree: Tree, rows: np.ndarray, at_leaf: Callable) -> None:
        if not len(rows):
            return
        asked = self.queries[rows]
        if not tree.branches:
            square = asked @ tree.points.T
            square *= -2
            square += self.squares[rows][:, None]
            square += tree.squares
            np.maximum(square, 0, out=square)
            at_leaf(rows, tree, square)
            return
        away = np.sqrt(((asked - tree.vantage) ** 2).sum(axis=1))
        inner = away <= (tree.branches[0][1] + tree.branches[1][0]) / 2
        for mine, order in ((inner, tree.branches), (~inner, tree.branches[::-1])):
            for low, high, branch in order:
                bound = np.maximum(low - away, away - high) * self.factor
                self._walk(branch, rows[mine & (bound <= self._far(rows))], at_leaf)

    def _narrow(self, rows: np.ndarray, leaf: Tree, square: np.ndarray) -> None:
        both = np.concatenate([self.reach[rows], square], axis=1)
        both.partition(self.most - 1, axis=1)  # puts the worst of the nearest last
        self.reach[rows] = both[:, : self.most]

    def _gather(self, rows: np.ndarray, leaf: Tree, square: np.ndarray) -> None:
        query, point = np.nonzero(square <= (self._far(rows) ** 2)[:, None])
        query, point = rows[query], leaf.at[point]
        self.pairs.append((query, point, _products(self.asked[query], self.given[point])))
        self.held += len(query)
        if self.held > PAIRS:
            self.pairs = [self._best()]
            self.held = len(self.pairs[0][0])

    def _best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        query, point, product = (np.concatenate(c) for c in zip(none, *self.pairs, strict=True))
        order = np.lexsort((self.firsts[point], -product, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[place < self.most]
        return query[place < self.most], point[order], product[order]


def extended(points: np.ndarray, longest: float) -> np.ndarray:
    """Points with one more component that makes all lengths alike."""
    return np.column_stack([points, np.sqrt(np.maximum(longest - (points**2).sum(axis=1), 0))])


def usable(vector: Column) -> Column:
    """Vectors that take part: none of null, empty, zero, or with null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _products(asked: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    total = np.zeros(asked.shape[:1])
    for i in range(asked.shape[1]):
        total += asked[:, i] * points[:, i]
    return total


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _spaces(clean: DataFrame, sizes: DataFrame) -> Broadcast:
    """Per length of vectors that fill more than a shard: the upper tree and the largest square, sent to all tasks.

    A tree is grown from a bounded sample drawn by hash and has a bounded number of cells. Lengths that
    fill a shard each are few. All points are then placed in the cells.
    """
    spaces = {}
    for row in sizes.where(F.col("n") > SHARD).collect():
        drawn = clean.where(F.col("width") == row["width"]).select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(SAMPLE)
        points = np.array([r["v"] for r in drawn.collect()], np.float64)
        spaces[row["width"]] = Space(extended(points, row["longest"]), min(MOST_CELLS, -(-row["n"] // SHARD)))
    return clean.sparkSession.sparkContext.broadcast(spaces)


def _own_cell(spaces: Broadcast, is_query: bool) -> Callable[..., Column]:
    """UDF of (v, width, longest): the cell of a point or of a query."""

    @F.pandas_udf("long")
    def cell(v: pd.Series, width: pd.Series, longest: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int64)
        for w in width.unique():
            if w in spaces.value:
                rows = np.flatnonzero(width == w)
                points = np.stack(v.iloc[rows].to_list())
                whole = np.column_stack([points, np.zeros(len(points))]) if is_query else extended(points, longest.iloc[rows[0]])
                out[rows] = spaces.value[w].cells(whole)
        return pd.Series(out)

    return cell


def _other_cells(spaces: Broadcast, factor: float) -> Callable[..., Column]:
    """UDF of (v, width, longest, cell, reach): the other cells that may hold points within reach of a query."""

    @F.pandas_udf("array<long>")
    def cells(v: pd.Series, width: pd.Series, longest: pd.Series, own: pd.Series, reach: pd.Series) -> pd.Series:
        out = np.empty(len(v), object)
        out[:] = [np.zeros(0, np.int64)] * len(v)
        for w in width.unique():
            if w in spaces.value:
                rows = np.flatnonzero(width == w)
                asked = np.stack(v.iloc[rows].to_list())
                bounds = spaces.value[w].bounds(np.column_stack([asked, np.zeros(len(asked))])) * factor
                slack = SLACK * max(1e-30, longest.iloc[rows[0]]) ** 0.5
                for at, bound, cell, far in zip(rows, bounds, own.iloc[rows], reach.iloc[rows], strict=True):
                    there = np.flatnonzero(bound <= far + slack)
                    out[at] = there[there != cell]
        return pd.Series(out)

    return cells


def _searched(points: DataFrame, sizes: DataFrame, visits: DataFrame, most: int, factor: float) -> DataFrame:
    """(query_id, vec_id, score): the nearest of each shard for each query that visits its cell.

    points has width, cell, shard, v, ids, longest; sizes the shards of each cell; visits width, cell, id,
    v, reach. Shards and blocks of queries are bounded, and a task holds one of each.
    """
    key = ["width", "cell"]
    visits = visits.join(sizes, key)
    counts = visits.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    visits = visits.join(counts, key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")
    right = visits.select(*key, every, "block", "v", "id", "reach")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    left = points.join(counts, key).select(*key, "shard", blocks, "v", "ids", "longest")

    def run(points: pa.Table, asked: pa.Table) -> pa.Table:
        if not points.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        width = points["width"][0].as_py()
        x, q = _matrix(points["v"], width), _matrix(asked["v"], width)
        ids = points["ids"].to_pylist()
        # One more than asked for: the query itself is a point too.
        limits = asked["reach"].to_numpy()
        search = Search(q, x, points["longest"][0].as_py(), np.array([i[0] for i in ids]), most + 1, factor, limits)
        query, point, scores = search.nearest()
        own = asked["id"].to_pylist()
        out = [
            (own[a], i, s) for a, p, s in zip(query.tolist(), point.tolist(), scores.tolist(), strict=True) for i in ids[p] if i != own[a]
        ]
        columns = zip(*out, strict=True) if out else ([], [], [])
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score"])

    keys = ("width", "cell", "shard", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, most: int = NEAREST,
    factor: float = FACTOR,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by every.

    The largest inner products become the nearest points once every vector gets one more component
    that makes all lengths alike (zero for a query). Equal vectors are one point with their most + 1
    smallest ids, as no more can be among the nearest. The upper levels of a vantage-point tree deal points
    to cells, and cells to shards of a bounded size. A query first searches its own cell, then only cells
    whose distance, times factor, does not exceed that of the worst it has found; so does the tree that a task grows
    of a shard. Factor one is exact search, a larger one leaves out more. Ties go to the smaller id.
    Vectors meet only those of their own length; null ids and unusable vectors take no part; rows that
    repeat an id and its vector count once; other columns are not read.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    clean = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("v")).where(
        F.col("id").isNotNull() & usable(F.col("v"))
    ).distinct().withColumn("width", F.size("v"))
    clean = settle(clean, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    lengths = settle(clean.groupBy("width").agg(F.max(square).alias("longest"), F.count(F.lit(1)).alias("n")), "lengths")
    spaces = _spaces(clean, lengths)
    turn = F.row_number().over(W.partitionBy("v").orderBy("id"))
    points = (
        clean.withColumn("turn", turn)
        .where(F.col("turn") <= most + 1)
        .groupBy("v", "width")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .join(lengths.drop("n"), "width")
    )
    points = settle(points.withColumn("cell", _own_cell(spaces, False)("v", "width", "longest")), "points")
    sizes = points.groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("shards"))
    sizes = settle(sizes, "shards")
    points = points.join(sizes, ["width", "cell"]).withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards"))).drop("shards")

    asked = clean.where(F.col("id") % every == 0).join(lengths.drop("n"), "width")
    asked = settle(asked.withColumn("cell", _own_cell(spaces, True)("v", "width", "longest")), "queries")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = _searched(points, sizes, asked.withColumn("reach", F.lit(float("inf"))), most, factor)
    first = settle(first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most), "first")

    worst = first.where(F.col("rank") == most).select(F.col("query_id").alias("id"), F.col("score").alias("worst"))
    apart = F.col("longest") + F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x) - 2 * F.col("worst")
    reach = F.when(F.col("worst").isNull(), float("inf")).otherwise(F.sqrt(F.greatest(apart, F.lit(0.0))))
    # An id may have several vectors, of which each is a query: the least that is known holds for all.
    known = asked.join(worst, "id", "left").withColumn("reach", reach)
    others = _other_cells(spaces, factor)("v", "width", "longest", "cell", "reach")
    visits = settle(known.withColumn("cell", F.explode(others)), "visits")
    second = _searched(points, sizes, visits, most, factor)
    both = first.drop("rank").unionByName(second)
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")
