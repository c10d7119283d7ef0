"""Tiles, halos, partition-of-unity weights and blending of tile products."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEGREE, clamp, real, smootherstep


@dataclass(frozen=True)
class Tile:
    """Core box and extended box, in degrees."""

    tile: int
    west: float
    east: float
    south: float
    north: float
    halo_lon: float
    halo_lat: float
    missing: tuple[str, ...] = field(default=())


def halo_km(length_km: float, k: float = 3.0, stencil_km: float = 0.0) -> float:
    """max(k L, stencil)."""
    return max(k * length_km, stencil_km)


def lonlat_tiles(lon: tuple[float, float], lat: tuple[float, float], n_lon: int, n_lat: int, halo: float) -> list[Tile]:
    """n_lon by n_lat cores; the halo's kilometres become degrees at the core's latitude nearest the pole."""
    out = []
    for j in range(n_lat):
        for i in range(n_lon):
            west, east = (lon[0] + (lon[1] - lon[0]) * k / n_lon for k in (i, i + 1))
            south, north = (lat[0] + (lat[1] - lat[0]) * k / n_lat for k in (j, j + 1))
            widest = max(abs(south), abs(north))
            out.append(Tile(j * n_lon + i, west, east, south, north, halo / (KM_PER_DEGREE * max(math.cos(math.radians(widest)), 1e-6)), halo / KM_PER_DEGREE))
    return out


def mixed_tiles(lon: tuple[float, float], n_lon: int, n_lat: int, cap: float, halo: float) -> list[Tile]:
    """Mid-latitude tiles between two polar caps; a cap is one tile for all longitudes."""
    middle = lonlat_tiles(lon, (-cap, cap), n_lon, n_lat, halo)
    caps = [Tile(len(middle), lon[0], lon[1], cap, 90.0, 0.0, halo / KM_PER_DEGREE), Tile(len(middle) + 1, lon[0], lon[1], -90.0, -cap, 0.0, halo / KM_PER_DEGREE)]
    return middle + caps


def tile_plan(lon: tuple[float, float], lat: tuple[float, float], size: float = 15.0, overlap: float = 2.0, halo: float = 0.0) -> list[Tile]:
    """Row-major cores of ``size`` degrees with an overlap; ``missing`` names the sides without a neighbour."""
    nx, ny = (max(1, math.ceil((b - a) / size - 1e-9)) for a, b in (lon, lat))
    out = []
    for j in range(ny):
        for i in range(nx):
            sides = tuple(s for s, absent in (("west", i == 0), ("east", i == nx - 1), ("south", j == 0), ("north", j == ny - 1)) if absent)
            out.append(Tile(j * nx + i, lon[0] + i * size, min(lon[1], lon[0] + (i + 1) * size), lat[0] + j * size, min(lat[1], lat[0] + (j + 1) * size), overlap + halo, overlap + halo, sides))
    return out


def tile_table(spark: SparkSession, tiles: list[Tile]) -> DataFrame:
    rows = [(t.tile, t.west, t.east, t.south, t.north, t.halo_lon, t.halo_lat, list(t.missing)) for t in tiles]
    return spark.createDataFrame(rows, "tile int, west double, east double, south double, north double, halo_lon double, halo_lat double, missing array<string>")


def in_tiles(points: DataFrame, tiles: DataFrame, extended: bool = True) -> DataFrame:
    """One row for each point and tile whose box (with halo) holds it, ends included.

    A plan's tiles are a driver's list, which bounds the broadcast side.
    """
    dx, dy = (F.col("halo_lon"), F.col("halo_lat")) if extended else (F.lit(0.0), F.lit(0.0))
    inside = (F.col("lon") >= F.col("west") - dx) & (F.col("lon") <= F.col("east") + dx) & (F.col("lat") >= F.col("south") - dy) & (F.col("lat") <= F.col("north") + dy)
    return points.join(F.broadcast(tiles), inside)


def smooth_taper() -> Column:
    """Separable taper: 1 in the core, a smootherstep down to 0 over the halo."""

    def side(x: Column, low: Column, high: Column, width: Column) -> Column:
        out = F.greatest(low - x, x - high, F.lit(0.0))
        return F.when(width > 0, 1 - smootherstep(out / width)).otherwise(F.when(out > 0, 0.0).otherwise(1.0))

    return side(F.col("lon"), F.col("west"), F.col("east"), F.col("halo_lon")) * side(F.col("lat"), F.col("south"), F.col("north"), F.col("halo_lat"))


def partition_weights(points: DataFrame, key: str, tiles: DataFrame) -> DataFrame:
    """key, tile and weight; the weights of a point add up to 1."""
    raw = in_tiles(points, tiles).withColumn("_w", smooth_taper())
    total = F.sum("_w").over(W.partitionBy(key))
    return raw.where("_w > 0").select(*points.columns, "tile", (F.col("_w") / total).alias("weight"))


def blend(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and variance of weighted tile products (mean, var, weight): means and standard deviations
    add up by weight, as for perfectly correlated tiles, so that variance doesn't dip at a seam."""
    sums = parts.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("mean")).alias("mean"), F.sum(F.col("weight") * F.sqrt("var")).alias("_sd"), F.count(F.lit(1)).alias("n_tiles"))
    return sums.withColumn("var", F.col("_sd") * F.col("_sd")).drop("_sd")


def ramp_weight(overlap: float) -> Column:
    """Separable linear ramps over the overlap, none on sides without a neighbour."""

    def side(x: Column, edge: Column, sign: int, name: str) -> Column:
        inside = clamp((sign * (x - edge) + real(overlap)) / (2 * overlap), 0, 1)
        return F.when(F.array_contains("missing", name), 1.0).otherwise(inside)

    return side(F.col("lon"), F.col("west"), 1, "west") * side(F.col("lon"), F.col("east"), -1, "east") * side(F.col("lat"), F.col("south"), 1, "south") * side(F.col("lat"), F.col("north"), -1, "north")


def assemble(fields: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Sum of weight times value over the actual sum of weights; null where nothing covers."""
    good = F.col(value).isNotNull() & ~F.isnan(value) & (F.col("weight") > 0)
    w = F.when(good, F.col("weight"))
    return fields.groupBy(*keys).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def core_owner(points: DataFrame, key: str, tiles: DataFrame) -> DataFrame:
    """The tile whose core holds a point, the first of neighbours that share an edge."""
    return in_tiles(points, tiles, extended=False).groupBy(key).agg(F.min("tile").alias("tile"))


def shared_nodes(nodes: DataFrame) -> DataFrame:
    """Pairs of tiles (i < j) and the nodes that both hold, by position to 6 decimals."""
    keyed = nodes.select("tile", F.round("lon", 6).alias("x"), F.round("lat", 6).alias("y")).distinct()
    a, b = keyed.withColumnRenamed("tile", "i"), keyed.withColumnRenamed("tile", "j")
    return a.join(b, ["x", "y"]).where("i < j")


def tile_adjacency(nodes: DataFrame) -> DataFrame:
    """Pairs of tiles that share at least two rows and two columns of nodes."""
    shared = shared_nodes(nodes).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n_shared"), F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny"))
    return shared.where((F.col("nx") >= 2) & (F.col("ny") >= 2)).select("i", "j", "n_shared")


def spanning_tree(edges: list[tuple[int, int, int]], n: int) -> tuple[dict[int, int | None], list[int]]:
    """Parents and visiting order of the forest with the largest overlaps (i, j, overlap)."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    near: dict[int, list[int]] = {i: [] for i in range(n)}
    for i, j, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if find(i) != find(j):
            root[find(j)] = find(i)
            near[i].append(j)
            near[j].append(i)
    parent: dict[int, int | None] = {}
    order: list[int] = []
    for start in range(n):
        if start in parent:
            continue
        parent[start] = None
        queue = [start]
        while queue:
            i = queue.pop(0)
            order.append(i)
            for j in sorted(near[i]):
                if j not in parent:
                    parent[j] = i
                    queue.append(j)
    return parent, order


def blend_transform(k: float, residual_bound: float, structured: bool) -> dict:
    """Record of a blend for a product's provenance."""
    return {"kind": "BLENDED", "bias": "perfect-correlation crossfade", "params": {"k": str(k), "residual_bound": str(residual_bound), "structured_residual": str(structured)}}


def degradation_transform() -> dict:
    return {"kind": "DEGRADED_COHERENCE", "bias": "independent draws per tile", "params": {}}
