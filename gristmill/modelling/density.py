"""Exact density-based clusters from joins of grid cells.

Cells are so small that all points of one are neighbours. A cell with ``min_samples``
points is all core, however many it holds, and is handled as a whole; a smaller cell holds
fewer than ``min_samples`` points. Distances between single points are taken only where one
side is such a small cell, so no crowded cell is ever compared with itself or with another
crowded one. Whether two crowded cells touch is decided by halving their boxes.

The grid blocks candidates on up to three coordinates. With many coordinates a block can
hold many cells, and the work grows with the pairs of cells that overlap in those three.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import col
from ..operators.ordering import with_row_index
from ..session import cut_lineage

BLOCKED_DIMS = 3
DEEPEST_HALVING = 50
# Cells that hold this share of all points are spread over several tasks in joins.
HOT_SHARE = 0.001
HOT_POINTS = 200_000
SALTS = 64


def _sum(parts) -> Column:
    return functools.reduce(operator.add, parts)


def _grid(x: str, side: float, dims: int) -> Column:
    return F.array(*[F.floor(F.col(x)[j] / side) for j in range(dims)])


def _boxes(dims: int, x: str = "point") -> list[Column]:
    low = F.array(*[F.min(F.col(x)[j]) for j in range(dims)]).alias("lo")
    high = F.array(*[F.max(F.col(x)[j]) for j in range(dims)]).alias("hi")
    return [low, high]


def _nearest(dims: int, a: str, b: str) -> Column:
    """Squared distance between the nearest points two boxes can have."""
    gaps = [
        F.greatest(F.lit(0.0), F.col(f"{b}lo")[j] - F.col(f"{a}hi")[j], F.col(f"{a}lo")[j] - F.col(f"{b}hi")[j])
        for j in range(dims)
    ]
    return _sum(g * g for g in gaps)


def _farthest(dims: int, a: str, b: str) -> Column:
    spans = [
        F.greatest(F.col(f"{a}hi")[j] - F.col(f"{b}lo")[j], F.col(f"{b}hi")[j] - F.col(f"{a}lo")[j]) for j in range(dims)
    ]
    return _sum(s * s for s in spans)


def _squared(dims: int, a: str, b: str) -> Column:
    return _sum((F.col(a)[j] - F.col(b)[j]) * (F.col(a)[j] - F.col(b)[j]) for j in range(dims))


class _Grid:
    """Cells, neighbouring cells, and the points near them, for one table of points."""

    def __init__(self, points: DataFrame, key: str, eps: float, min_samples: int):
        first = points.select(F.size("point")).first()
        self.dims = first[0] if first else 0
        self.key, self.square, self.min_samples = key, eps * eps, min_samples
        # A hair less than eps / sqrt(dims), so rounding cannot part two points of a cell.
        self.side = eps / math.sqrt(max(1, self.dims)) * (1 - 1e-9)
        self.located = points.select(col(key).alias("key"), "point", _grid("point", self.side, self.dims).alias("cell"))
        self.cells = cut_lineage(self.located.groupBy("cell").agg(F.count("*").alias("n"), *_boxes(self.dims)))
        total = self.cells.agg(F.sum("n")).first()[0] or 0
        crowd = max(HOT_POINTS, total * HOT_SHARE)
        # At most 1 / HOT_SHARE cells can be this crowded.
        self.hot = [r.cell for r in self.cells.where(F.col("n") > crowd).select("cell").collect()]
        self.pairs = cut_lineage(self._pairs())

    def _pairs(self) -> DataFrame:
        """Pairs of different cells whose boxes come within eps, each once, with the smaller
        cell first: (a, an, b, bn, whole); whole means all their points are neighbours."""
        blocked = min(self.dims, BLOCKED_DIMS)
        reach = math.floor(math.sqrt(self.dims) * (1 + 1e-8)) + 1
        block = F.array(*[F.floor(F.col("cell")[j] / reach) for j in range(blocked)])
        sided = [
            self.cells.select(*[F.col(c).alias(s + c) for c in ("cell", "n", "lo", "hi")], block.alias(f"{s}block"))
            for s in "ab"
        ]
        offsets = [F.array(*[F.lit(o).cast("bigint") for o in step]) for step in itertools.product((-1, 0, 1), repeat=blocked)]
        around = F.array(*[F.zip_with("ablock", o, lambda x, y: x + y) for o in offsets])
        left = sided[0].withColumn("bblock", F.explode(around)).drop("ablock")
        near = left.join(sided[1], "bblock").where(F.col("acell") < F.col("bcell"))
        near = near.where(_nearest(self.dims, "a", "b") <= self.square)
        whole = _farthest(self.dims, "a", "b") <= self.square
        return near.select(F.col("acell").alias("a"), F.col("an"), F.col("bcell").alias("b"), F.col("bn"), whole.alias("whole"))

    def both_ways(self) -> DataFrame:
        p = self.pairs
        return p.unionByName(p.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn"), "whole"))

    def _salted(self, many: DataFrame, few: DataFrame, cell: str) -> tuple[DataFrame, DataFrame, list[str]]:
        """Spread the points of hot cells over several tasks and repeat what meets them."""
        if not self.hot:
            return many, few, [cell]
        hot = F.array_contains(F.lit(self.hot), F.col(cell))
        spread = F.when(hot, F.pmod(F.xxhash64("okey"), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))
        copies = F.when(hot, F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
        return many.withColumn("salt", spread), few.withColumn("salt", F.explode(copies)), [cell, "salt"]

    def hits(self) -> DataFrame:
        """For points of small cells, how many points of each other cell are near:
        (key, cell, other, othern, near)."""
        sparse = self.located.join(self.cells.where(F.col("n") < self.min_samples).select("cell"), "cell")
        ways = self.both_ways().where(F.col("an") < self.min_samples)
        ways = ways.select(F.col("a").alias("cell"), F.col("b").alias("other"), F.col("bn").alias("othern"), "whole")
        meet = sparse.join(ways, "cell")
        sure = meet.where("whole").select("key", "cell", "other", "othern", F.col("othern").alias("near"))
        open_ = meet.where("NOT whole").drop("whole")
        many = self.located.select(F.col("key").alias("okey"), F.col("point").alias("opoint"), F.col("cell").alias("other"))
        many, few, on = self._salted(many, open_, "other")
        close = many.join(few, on).where(_squared(self.dims, "point", "opoint") <= self.square)
        counted = close.groupBy("key", "cell", "other", "othern").agg(F.count("*").alias("near"))
        return sure.unionByName(counted)

    def core_sparse(self, hits: DataFrame) -> DataFrame:
        """Points of small cells with their cell and whether they are core."""
        near = hits.groupBy("key").agg(F.sum("near").alias("near"))
        sparse = self.located.join(self.cells.where(F.col("n") < self.min_samples).select("cell", "n"), "cell")
        total = F.col("n") + F.coalesce("near", F.lit(0))
        return sparse.join(near, "key", "left").select("key", "cell", "point", (total >= self.min_samples).alias("core"))


def core_points(points: DataFrame, key: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(key, core): whether at least ``min_samples`` points, itself included, lie within eps."""
    grid = _Grid(points, key, eps, min_samples)
    sparse = grid.core_sparse(grid.hits()).select("key", "core")
    dense = grid.located.join(grid.cells.where(F.col("n") >= min_samples).select("cell"), "cell").select("key", F.lit(True).alias("core"))
    return sparse.unionByName(dense).withColumnRenamed("key", key)


def dbscan(points: DataFrame, key: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Add ``cluster`` to (key, point): 0, 1, ... in the order of their first core point,
    and -1 for noise. A border point joins the first cluster that reaches it."""
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps and min_samples must be positive")
    if points.isEmpty():
        return points.withColumn("cluster", F.lit(0))
    grid = _Grid(points, key, eps, min_samples)
    hits = cut_lineage(grid.hits())
    sparse = cut_lineage(grid.core_sparse(hits))
    dense_cells = grid.cells.where(F.col("n") >= min_samples).select("cell")
    core_cells = cut_lineage(sparse.where("core").select("cell").union(dense_cells).distinct())
    reached = cut_lineage(_reached(grid, hits, sparse))
    edges = _sure_edges(grid, core_cells).union(reached.where("core").select(F.col("cell").alias("a"), F.col("other").alias("b")))
    parts = connected(core_cells.withColumnRenamed("cell", "node"), edges)
    extra = _touching(grid, parts)
    if extra is not None:
        parts = connected(core_cells.withColumnRenamed("cell", "node"), edges.union(extra))
    numbered = _numbered(grid, sparse, dense_cells, parts)
    own = sparse.where("core").select("key", "cell").union(grid.located.join(dense_cells, "cell").select("key", "cell"))
    inside = own.join(numbered, "cell").select("key", "cluster")
    border = sparse.where("NOT core").select("key", "cell")
    touched = reached.where("NOT core").select("key", F.col("other").alias("cell")).union(border)
    edge = touched.join(numbered, "cell").groupBy("key").agg(F.min("cluster").alias("cluster"))
    found = inside.union(edge).withColumnRenamed("key", key)
    return points.join(found, key, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)).cast("int"))


def _reached(grid: _Grid, hits: DataFrame, sparse: DataFrame) -> DataFrame:
    """Per point of a small cell, the other cells with a core point near it: (key, core, cell, other)."""
    flagged = hits.join(sparse.select("key", "core", "point"), "key")
    crowded = flagged.where((F.col("othern") >= grid.min_samples) & (F.col("near") > 0)).select("key", "core", "cell", "other")
    cores = sparse.where("core").select(F.col("cell").alias("other"), F.col("point").alias("opoint"))
    small = flagged.where(F.col("othern") < grid.min_samples).join(cores, "other")
    small = small.where(_squared(grid.dims, "point", "opoint") <= grid.square).select("key", "core", "cell", "other")
    return crowded.union(small.distinct())


def _sure_edges(grid: _Grid, core_cells: DataFrame) -> DataFrame:
    """Core cells all of whose points are near each other."""
    whole = grid.pairs.where("whole").select("a", "b")
    return whole.join(core_cells.withColumnRenamed("cell", "a"), "a", "left_semi").join(core_cells.withColumnRenamed("cell", "b"), "b", "left_semi")


def _touching(grid: _Grid, parts: DataFrame) -> DataFrame | None:
    """Crowded cells of different parts that hold a pair of near points.

    Boxes are halved along every coordinate. A pair of boxes that must or cannot be near is
    settled; the rest goes on to the next halving, until every box is a single place.
    """
    crowded = (F.col("an") >= grid.min_samples) & (F.col("bn") >= grid.min_samples) & ~F.col("whole")
    names = [parts.select(F.col("node").alias(s), F.col("root").alias(f"{s}root")) for s in "ab"]
    split = grid.pairs.where(crowded).join(names[0], "a").join(names[1], "b").where("aroot <> broot")
    open_ = cut_lineage(split.select("a", "b", F.col("a").alias("abox"), F.col("b").alias("bbox")))
    found = None
    for level in range(1, DEEPEST_HALVING + 1):
        if open_.isEmpty():
            return found
        concerned = open_.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
        inside = grid.located.join(concerned, "cell")
        boxes = inside.groupBy("cell", _grid("point", grid.side / 2**level, grid.dims).alias("box")).agg(*_boxes(grid.dims))
        boxes = cut_lineage(boxes.withColumn("parent", F.transform("box", lambda v: F.floor(v / 2))))
        sided = [
            boxes.select(F.col("cell").alias(s), F.col("parent").alias(f"{s}box"), F.col("box").alias(f"{s}next"), F.col("lo").alias(f"{s}lo"), F.col("hi").alias(f"{s}hi"))
            for s in "ab"
        ]
        meet = open_.join(sided[0], ["a", "abox"]).join(sided[1], ["b", "bbox"])
        meet = meet.where(_nearest(grid.dims, "a", "b") <= grid.square)
        meet = cut_lineage(meet.select("a", "b", F.col("anext").alias("abox"), F.col("bnext").alias("bbox"), (_farthest(grid.dims, "a", "b") <= grid.square).alias("sure")))
        settled = meet.where("sure").select("a", "b").distinct()
        found = settled if found is None else found.union(settled)
        open_ = cut_lineage(meet.drop("sure").join(settled, ["a", "b"], "left_anti"))
    raise RuntimeError("boxes could not be told apart")


def _numbered(grid: _Grid, sparse: DataFrame, dense_cells: DataFrame, parts: DataFrame) -> DataFrame:
    """(cell, cluster), clusters numbered by the smallest key of their core points."""
    firsts = sparse.where("core").groupBy("cell").agg(F.min("key").alias("first"))
    crowded = grid.located.join(dense_cells, "cell").groupBy("cell").agg(F.min("key").alias("first"))
    of = parts.withColumnRenamed("node", "cell")
    roots = firsts.union(crowded).join(of, "cell").groupBy("root").agg(F.min("first").alias("first"))
    ordered = with_row_index(cut_lineage(roots), ["first"], "cluster")
    return cut_lineage(of.join(ordered, "root").select("cell", "cluster"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected part.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every node
    points its larger neighbours, then its smaller ones, at the least node it knows.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = cut_lineage(current)
    before = None
    while True:
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        current = cut_lineage(small.distinct())
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return cut_lineage(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
