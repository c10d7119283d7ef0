"""Grids as node tables, cell areas, interpolation and nearest nodes.

A regular axis is a driver-side list of numbers (its length is a parameter of the run, not of the
data); node tables and joins to them are DataFrames. On a regular grid the cell of a point is
arithmetic, so that point-to-grid joins are equi-joins on (ix, iy).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, clamp, in_range, real
from .ordered import beside


@dataclass(frozen=True)
class Axis:
    """A regular axis: low + k * step for k < n."""

    low: float
    step: float
    n: int

    @classmethod
    def covering(cls, low: float, high: float, step: float) -> Axis:
        """Nodes from low up to high, high included if it is on the axis; the count is a formula, not a sum of steps."""
        return cls(low, step, math.floor((high + 1e-9 - low) / step) + 1)

    @property
    def high(self) -> float:
        return self.low + (self.n - 1) * self.step

    def index(self, x: Column) -> Column:
        """The cell to the left of x, kept on the axis."""
        return clamp(F.floor((x - self.low) / self.step), 0, max(self.n - 2, 0)).cast("int")

    def nearest(self, x: Column) -> Column:
        """The nearest node, the lower one of two."""
        return clamp(F.ceil((x - self.low) / self.step - 0.5), 0, self.n - 1).cast("int")

    def table(self, spark: SparkSession, index: str, value: str) -> DataFrame:
        return spark.range(self.n).select(F.col("id").cast("int").alias(index), (self.low + F.col("id") * real(self.step)).alias(value))


@dataclass(frozen=True)
class Grid:
    """A lon/lat grid."""

    lon: Axis
    lat: Axis

    @classmethod
    def covering(cls, lon: tuple[float, float], lat: tuple[float, float], step: float) -> Grid:
        return cls(Axis.covering(*lon, step), Axis.covering(*lat, step))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """node_id (row-major), iy, ix, lon, lat."""
        n = F.col("id")
        iy, ix = F.floor(n / self.lon.n).cast("int"), F.pmod(n, F.lit(self.lon.n)).cast("int")
        return spark.range(self.lon.n * self.lat.n).select(n.alias("node_id"), iy.alias("iy"), ix.alias("ix"), (self.lon.low + ix * real(self.lon.step)).alias("lon"), (self.lat.low + iy * real(self.lat.step)).alias("lat"))

    def window(self, lon: tuple[float, float], lat: tuple[float, float]) -> Grid:
        """The part of the grid in a box, ends included."""

        def cut(axis: Axis, low: float, high: float) -> Axis:
            first = max(0, math.ceil((low - axis.low) / axis.step - 1e-9))
            last = min(axis.n - 1, math.floor((high - axis.low) / axis.step + 1e-9))
            return Axis(axis.low + first * axis.step, axis.step, max(0, last - first + 1))

        return Grid(cut(self.lon, *lon), cut(self.lat, *lat))

    def node_id(self, lon: Column, lat: Column) -> Column:
        """Number of the nearest node."""
        return self.lat.nearest(lat).cast("long") * self.lon.n + self.lon.nearest(lon)


def edge_widths(axis_table: DataFrame, value: str, stretch: float | None = None) -> DataFrame:
    """Width of each node's cell: between the middles to its neighbours, the ends extrapolated by half a step.

    ``stretch`` is the part of the axis that one task orders; without it the axis is one.
    """
    block = F.lit(0) if stretch is None else F.floor(F.col(value) / stretch)
    near = beside(axis_table, [], block, [value], [value])
    before, after, here = F.col("_prev").getField(value), F.col("_next").getField(value), F.col(value)
    left = F.coalesce((here + before) / 2, here - (after - here) / 2)
    right = F.coalesce((here + after) / 2, here + (here - before) / 2)
    return near.withColumn("width", right - left).drop("_prev", "_next")


def cell_areas(grid: Grid, spark: SparkSession) -> DataFrame:
    """area_m2 = R^2 cos(lat) dlat dlon for each node. The axes are tables of a grid's side, not of its area."""
    lons = edge_widths(grid.lon.table(spark, "ix", "lon"), "lon").select("ix", F.radians("width").alias("dlon"))
    lats = edge_widths(grid.lat.table(spark, "iy", "lat"), "lat").select("iy", F.radians("width").alias("dlat"))
    nodes = grid.nodes(spark)
    area = EARTH_M * EARTH_M * F.cos(F.radians("lat")) * F.col("dlat") * F.col("dlon")
    return nodes.join(lons, "ix").join(lats, "iy").select("node_id", "iy", "ix", "lon", "lat", area.alias("area_m2"))


def corner_weights(points: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Four rows per point: node_id and bilinear weight; points outside are moved to the edge."""
    fx = clamp((F.col(lon) - grid.lon.low) / grid.lon.step - F.col("_ix"), 0, 1)
    fy = clamp((F.col(lat) - grid.lat.low) / grid.lat.step - F.col("_iy"), 0, 1)
    cells = points.withColumn("_ix", grid.lon.index(F.col(lon))).withColumn("_iy", grid.lat.index(F.col(lat)))
    parts = []
    for dy in (0, 1):
        for dx in (0, 1):
            w = (fx if dx else 1 - fx) * (fy if dy else 1 - fy)
            parts.append(F.struct(((F.col("_iy") + dy).cast("long") * grid.lon.n + F.col("_ix") + dx).alias("node_id"), w.alias("w")))
    return cells.select(*points.columns, F.explode(F.array(*parts)).alias("_c")).select(*points.columns, "_c.node_id", "_c.w")


def interpolate(points: DataFrame, key: str, grid: Grid, fields: DataFrame, value: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Bilinear values at points: null corners are left out and the rest renormalised; points outside the grid have none.

    ``fields`` has node_id, the value and the columns in ``on`` (a time, say), which are equi-join keys.
    """
    inside = points.where(in_range("lon", grid.lon.low, grid.lon.high) & in_range("lat", grid.lat.low, grid.lat.high))
    corners = corner_weights(inside, grid).join(fields.where(F.col(value).isNotNull() & ~F.isnan(value)).select("node_id", *on, value), ["node_id", *on])
    sums = corners.where("w > 0").groupBy(key).agg(F.sum(F.col("w") * F.col(value)).alias("_s"), F.sum("w").alias("_w"))
    return points.join(sums, key, "left").withColumn(value, F.col("_s") / F.col("_w")).drop("_s", "_w")


def nearest_nodes(points: DataFrame, grid: Grid) -> DataFrame:
    """Adds node_id of the nearest node (degrees; the first of two)."""
    return points.withColumn("node_id", grid.node_id(F.col("lon"), F.col("lat")))


def nearest_of(points: DataFrame, key: str, support: DataFrame) -> DataFrame:
    """Adds node and d2 of the nearest row (node, lon, lat) of a scattered support, in degrees, ties to
    the smaller node; null only for an empty support.

    Cells have about two support rows each on average. A point looks into the 3 by 3 cells around it;
    it is settled if it finds something no further away than one cell, for nothing outside can be
    nearer. What is left looks again among cells of twice the size, until a cell holds everything.
    """
    spark = support.sparkSession
    n, x0, x1, y0, y1 = support.agg(F.count(F.lit(1)), F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    if not n:
        return points.withColumn("node", F.lit(None).cast(support.schema["node"].dataType)).withColumn("d2", F.lit(None).cast("double"))
    low = points.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    extent = max([x1 - x0, y1 - y0] + ([max(low[1], x1) - min(low[0], x0), max(low[3], y1) - min(low[2], y0)] if low[0] is not None else []))
    cell, done, open_ = max(((x1 - x0) * (y1 - y0) * 2 / n) ** 0.5, extent / (1 << 20), 1e-9), None, points.select(key, "lon", "lat")
    while True:
        cx, cy = F.floor(F.col("lon") / cell), F.floor(F.col("lat") / cell)
        around = F.explode(F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")
        spread = open_.select(key, F.col("lon").alias("_x"), F.col("lat").alias("_y"), around).select(key, "_x", "_y", "c.cx", "c.cy")
        cells = support.select("node", "lon", "lat", cx.alias("cx"), cy.alias("cy"))
        d2 = F.pow(F.col("lon") - F.col("_x"), 2) + F.pow(F.col("lat") - F.col("_y"), 2)
        best = spread.join(cells, ["cx", "cy"]).groupBy(key).agg(F.min(F.struct(d2.alias("d2"), "node")).alias("b")).select(key, "b.node", "b.d2")
        settled = best if cell > extent else best.where(F.col("d2") <= cell * cell)
        # Checkpoints cut what would be a plan of all rounds.
        settled = settled.checkpoint() if spark.sparkContext.getCheckpointDir() else settled
        done = settled if done is None else done.unionByName(settled)
        if cell > extent:
            return points.join(done, key, "left")
        open_ = open_.join(settled.select(key), key, "left_anti")
        if not open_.limit(1).count():
            return points.join(done, key, "left")
        cell *= 2


#: Nodes that an inverse-distance map may have: every observation meets every node.
IDW_NODES = 100_000


def idw(obs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Inverse-distance estimate at every node from all given observations: weight 1 / (d^2 + 1e-9), degrees, time ignored.

    The method is defined over all pairs; nodes are a run's grid, so they are the side whose size is
    known, and partial sums are combined before the shuffle. A grid of more than ``IDW_NODES`` is
    refused; it has to be tiled.
    """
    if (n := nodes.count()) > IDW_NODES:
        raise ValueError(f"{n} nodes are too many for a map of all pairs")
    d2 = F.pow(F.col("n.lon") - F.col("o.lon"), 2) + F.pow(F.col("n.lat") - F.col("o.lat"), 2)
    pairs = obs.alias("o").join(nodes.alias("n"))
    weighted = pairs.select("n.node_id", (1 / (d2 + 1e-9)).alias("w"), F.col("o.sla").alias("v"))
    return weighted.groupBy("node_id").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("estimate"))
