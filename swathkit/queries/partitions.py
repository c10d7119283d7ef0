"""Splits, folds, regions, gauges, censuses, tiles and blends."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blend as tiles_
from ..operators import splits as ops
from ..registry import query
from ..sources.observations import OBS_SQL, observations
from .grids import GRID, NODES, haversine_sql
from .scans import r6, rounded


@query(f"WITH {OBS_SQL} SELECT mission, CASE WHEN mission = 'view' THEN 'VALIDATION' ELSE 'TRAIN' END AS label, count(*) AS n FROM obs GROUP BY ALL")
def leave_mission_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.leave_mission_out(observations(spark, sf_dir), ("view",)).groupBy("mission", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {OBS_SQL} SELECT seq, CASE mission WHEN 'purchase' THEN 'locked' WHEN 'view' THEN 'validation' ELSE 'train' END AS label FROM obs")
def mission_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.split(observations(spark, sf_dir), "mission", ("purchase",), ("view",)).select("seq", "label")


@query(f"""WITH {OBS_SQL}, r AS (SELECT seq, row_number() OVER (PARTITION BY mission ORDER BY t, seq) - 1 AS k, count(*) OVER (PARTITION BY mission) AS n FROM obs)
SELECT seq, CASE WHEN k < floor(n * 0.6::DOUBLE) THEN 'TRAIN' WHEN k < floor(n * 0.6::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'BUFFER_DISCARD' ELSE 'VALIDATION' END AS label FROM r""")
def temporal_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.temporal_fraction(observations(spark, sf_dir), 0.6, 0.1).select("seq", "label")


_BLOCKS = ops.block_labels([b * 1000 + w for b in range(147, 153) for w in range(5)], 3)
_BLOCK_VALUES = ", ".join(f"({b}, '{v}')" for b, v in _BLOCKS.items())


@query(f"WITH {OBS_SQL}, v(block, label) AS (VALUES {_BLOCK_VALUES}) SELECT label, count(*) AS n FROM obs JOIN v ON v.block = floor(lon / 2) * 1000 + floor(t / 7) GROUP BY label")
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 2 degrees by 7 days with seeded labels."""
    labels = spark.createDataFrame(list(_BLOCKS.items()), "block long, label string")
    keyed = observations(spark, sf_dir).withColumn("block", ops.block_id(F.col("lon"), F.col("t")))
    return keyed.join(labels, "block").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT f AS fold, (month(o_orderdate) - 1) // 2 = f AS score, count(*) AS n FROM orders, (SELECT unnest(range(0, 6)) AS f) GROUP BY ALL")
def month_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rotations of month pairs over dated rows."""
    points = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.month("o_orderdate").alias("month"))
    return ops.month_folds(points).groupBy(F.col("fold").cast("long").alias("fold"), "score").agg(F.count(F.lit(1)).alias("n"))


_LAYOUT = ops.fold_layout(5)
_LAYOUT_VALUES = ", ".join(f"({k}, {b})" for k, fold in enumerate(_LAYOUT) for b in sorted(fold))
_CELL = "least(greatest(floor((lat - 33) / 2), 0), 4) * 5 + least(greatest(floor((lon - 295) / 2), 0), 4)"
_SPACE = f"""y(fold, held) AS (VALUES {_LAYOUT_VALUES}), z AS (SELECT fold, held, 295 + 2 * (held % 5) AS west, 33 + 2 * (held // 5) AS south FROM y),
s AS (SELECT seq, fold, bool_or(held = {_CELL}) AS held, bool_or(lon BETWEEN west - 0.5 AND west + 2.5 AND lat BETWEEN south - 0.5 AND south + 2.5) AS near FROM obs, z GROUP BY seq, fold)"""


@query(f"WITH {OBS_SQL}, {_SPACE} SELECT fold, CASE WHEN held THEN 'score' WHEN near THEN 'guard' ELSE 'fit' END AS role, count(*) AS n FROM s GROUP BY ALL")
def space_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held cells score, a ring of half a degree is dropped, the rest is fitted."""
    return ops.space_folds(observations(spark, sf_dir), _LAYOUT).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


_JET = [(1, 2), (2, 2), (3, 2), (2, 3)]
_JET_SQL = "j(ix, iy) AS (VALUES " + ", ".join(f"({i}, {j})" for i, j in _JET) + ")"
_IN_JET = "EXISTS (SELECT 1 FROM j WHERE ix = least(greatest(floor((lon - 295) / 2), 0), 4) AND iy = least(greatest(floor((lat - 33) / 2), 0), 4))"


def _jet(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, j, True) for i, j in _JET], "ix int, iy int, jet boolean")


@query(f"""WITH {OBS_SQL}, {_JET_SQL}, c AS (SELECT CASE WHEN lat < 38 THEN CASE WHEN lon < 300 THEN 'SW' ELSE 'SE' END ELSE CASE WHEN lon < 300 THEN 'NW' ELSE 'NE' END END AS class FROM obs
UNION ALL SELECT 'jet_core' FROM obs WHERE {_IN_JET} UNION ALL SELECT 'aggregate' FROM obs) SELECT class, count(*) AS n FROM c GROUP BY class""")
def region_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping evaluation classes."""
    return ops.region_masks(observations(spark, sf_dir), _jet(spark)).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OBS_SQL}, {_JET_SQL} SELECT seq, CASE WHEN {_IN_JET} THEN 'JET' WHEN lat < 38 AND lon < 300 THEN 'SW' WHEN lat < 38 THEN 'SE' WHEN lon < 300 THEN 'NW' ELSE 'NE' END AS label FROM obs""")
def partition_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.partition_labels(observations(spark, sf_dir), _jet(spark)).select("seq", "label")


@query(f"""WITH {OBS_SQL}, {_JET_SQL}, {_SPACE}, l AS (SELECT o.seq, CASE WHEN {_IN_JET} THEN 'JET' WHEN lat < 38 AND lon < 300 THEN 'SW' WHEN lat < 38 THEN 'SE' WHEN lon < 300 THEN 'NW' ELSE 'NE' END AS label FROM obs o)
SELECT fold, label, {r6('avg(CASE WHEN NOT held AND NOT near THEN 1.0::DOUBLE ELSE 0 END)')} AS fit_share, avg(CASE WHEN NOT held AND NOT near THEN 1.0::DOUBLE ELSE 0 END) >= 0.5 AS respected FROM s JOIN l USING (seq) GROUP BY fold, label""")
def layout_respects_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = ops.partition_labels(observations(spark, sf_dir), _jet(spark))
    return rounded(ops.layout_respects(labelled, _LAYOUT), "fit_share")


@query(f"""WITH {OBS_SQL}, p AS (SELECT seq % 100 AS node, avg(lon) AS lon, avg(lat) AS lat, stddev_pop(sla) AS sd FROM obs GROUP BY 1)
SELECT least(greatest(floor((lon - 295) / 2), 0), 4)::INT AS ix, least(greatest(floor((lat - 33) / 2), 0), 4)::INT AS iy, {r6('avg(sd)')} AS proxy FROM p GROUP BY 1, 2""")
def proxy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over nodes of each node's deviation in time, by cell."""
    obs = observations(spark, sf_dir).withColumn("node_id", F.col("seq") % 100)
    place = obs.groupBy("node_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return rounded(ops.proxy_cells(obs.select("node_id", F.col("sla").alias("ssh")).join(place, "node_id")), "proxy")


_GAUGES = """g AS (SELECT c_nationkey AS gauge_id, 295 + c_nationkey * 0.4::DOUBLE AS lon, 33 + c_nationkey * 0.4::DOUBLE AS lat, min(o_orderdate)::DATE AS d0, max(o_orderdate)::DATE AS d1, count(DISTINCT o_orderdate::DATE) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)"""


def _gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    days = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("gauge_id")).agg(F.collect_set(F.col("o_orderdate").cast("date")).alias("days"))
    i = F.col("gauge_id")
    return days.select("gauge_id", (295 + i * F.lit(0.4)).alias("lon"), (33 + i * F.lit(0.4)).alias("lat"), "days", (i % 5 != 0).alias("rlr_datum_ok"), (i % 3 != 0).alias("dac"), F.lit(True).alias("tide"))


@query(f"""WITH {_GAUGES}, o AS (SELECT unnest(range(295, 301))::DOUBLE AS olon, olon - 262 AS olat),
k AS (SELECT gauge_id, min({haversine_sql('lon', 'lat', 'olon', 'olat')}) AS km FROM g, o GROUP BY gauge_id),
t AS (SELECT gauge_id, unnest([0, 1, 2, 3, 4]) AS position, unnest([d1 - d0 + 1 >= 365, n >= 0.7 * (d1 - d0 + 1), gauge_id % 5 <> 0, gauge_id % 3 <> 0, km <= 100]) AS passed FROM g JOIN k USING (gauge_id))
SELECT gauge_id, position::INT AS position, passed, ['length', 'completeness', 'datum', 'corrections', 'distance'][position + 1] AS criterion, bool_and(passed) OVER (PARTITION BY gauge_id) AS gauge_passes FROM t""")
def screen_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five ordered criteria per gauge."""
    ocean = spark.range(295, 301).select(F.col("id").cast("double").alias("lon"), (F.col("id") - 262).cast("double").alias("lat"))
    return ops.screen_gauges(_gauges(spark, sf_dir), ocean)


@query(f"WITH {_GAUGES} SELECT gauge_id, CASE WHEN year(d1) < 2000 THEN 'pre-2000' WHEN year(d0) >= 2000 AND year(d1) <= 2010 THEN '2000-2010' WHEN year(d0) > 2010 THEN 'post-2010' ELSE 'full-span' END AS era FROM g")
def era_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gauges(spark, sf_dir).select("gauge_id", ops.era_class(F.array_min("days"), F.array_max("days")).alias("era"))


@query("""WITH d AS (SELECT DISTINCT 'm' || (o_custkey % 701) AS mission, o_orderdate::DATE AS day FROM orders),
n AS (SELECT *, CASE WHEN day - lag(day) OVER w > 90 OR lag(day) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM d WINDOW w AS (PARTITION BY mission ORDER BY day)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY mission ORDER BY day) AS run FROM n)
SELECT mission, run::BIGINT AS run, min(day)::VARCHAR AS "start", max(day)::VARCHAR AS "end", count(*) AS n_days FROM r GROUP BY mission, run""")
def mission_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active intervals of missions, split at gaps of more than 90 days."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    runs = ops.census(orders.select(F.concat(F.lit("m"), F.col("o_custkey") % 701).alias("mission"), F.col("o_orderdate").cast("date").alias("day")))
    return runs.withColumns({c: F.col(c).cast("string") for c in ("start", "end")})


_EPOCHS = ops.epochs([("a", dt.date(1992, 1, 1), dt.date(1996, 6, 30)), ("b", dt.date(1993, 5, 1), dt.date(1998, 12, 31)), ("c", dt.date(1994, 1, 1), dt.date(1998, 12, 31)), ("d", dt.date(1994, 3, 1), dt.date(1997, 12, 31)), ("e", dt.date(1995, 1, 1), dt.date(1998, 12, 31))])
_EPOCH_VALUES = ", ".join(f"('E{k:02d}', DATE '{a}', DATE '{b}', {len(m)})" for k, (a, b, m) in enumerate(_EPOCHS))


@query(f"WITH e(epoch, a, b, n) AS (VALUES {_EPOCH_VALUES}) SELECT epoch, count(*) AS n FROM orders LEFT JOIN e ON o_orderdate::DATE >= a AND o_orderdate::DATE < b GROUP BY epoch")
def window_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epoch of each window centre."""
    centres = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("center"))
    return ops.window_epoch(centres, ops.epoch_table(spark, _EPOCHS)).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))


_NET = ", ".join(f"('E{k:02d}', {len(m - {'a'})})" for k, (_, _, m) in enumerate(_EPOCHS))


@query(f"WITH e(epoch, n) AS (VALUES {_NET}) SELECT epoch, n::INT AS n_net FROM e WHERE n >= 3")
def reference_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reference_candidates(ops.epoch_table(spark, _EPOCHS), ("a",), least=3)


_TILES = tiles_.lonlat_tiles((295.0, 305.0), (33.0, 43.0), 2, 2, 150.0)
_TILE_SQL = "t(tile, west, east, south, north, dx, dy) AS (VALUES " + ", ".join(f"({t.tile}, {t.west}::DOUBLE, {t.east}::DOUBLE, {t.south}::DOUBLE, {t.north}::DOUBLE, {t.halo_lon!r}::DOUBLE, {t.halo_lat!r}::DOUBLE)" for t in _TILES) + ")"
_INSIDE = "lon BETWEEN west - dx AND east + dx AND lat BETWEEN south - dy AND north + dy"


@query(f"WITH {OBS_SQL}, {_TILE_SQL} SELECT tile, count(*) AS n FROM obs JOIN t ON {_INSIDE} GROUP BY tile")
def obs_in_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in each tile's extended box."""
    return tiles_.in_tiles(observations(spark, sf_dir), tiles_.tile_table(spark, _TILES)).groupBy("tile").agg(F.count(F.lit(1)).alias("n"))


def _side(x: str, low: str, high: str, width: str) -> str:
    u = f"least(greatest(greatest({low} - {x}, {x} - {high}, 0) / {width}, 0), 1)"
    return f"(1 - {u} * {u} * {u} * ({u} * ({u} * 6 - 15) + 10))"


_WEIGHTS = f"""r AS (SELECT node_id, tile, n.lon, n.lat, {_side('n.lon', 'west', 'east', 'dx')} * {_side('n.lat', 'south', 'north', 'dy')} AS w FROM n JOIN t ON {_INSIDE}),
p AS (SELECT *, w / sum(w) OVER (PARTITION BY node_id) AS weight FROM r WHERE w > 0)"""


@query(f"WITH {NODES}, {_TILE_SQL}, {_WEIGHTS} SELECT node_id, tile, {r6('weight')} AS weight FROM p")
def partition_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition of unity over four tiles."""
    return rounded(tiles_.partition_weights(GRID.nodes(spark).select("node_id", "lon", "lat"), "node_id", tiles_.tile_table(spark, _TILES)).select("node_id", "tile", "weight"), "weight")


@query(f"""WITH {NODES}, {_TILE_SQL}, {_WEIGHTS}, q AS (SELECT *, sin(lon) + 0.1 * tile AS mean, 0.01 + 0.001 * tile + 0.0001 * node_id AS var FROM p)
SELECT node_id, {r6('sum(weight * mean)')} AS mean, {r6('pow(sum(weight * sqrt(var)), 2)')} AS var, count(*) AS n_tiles FROM q GROUP BY node_id""")
def blend_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blended means and perfectly correlated deviations."""
    w = tiles_.partition_weights(GRID.nodes(spark).select("node_id", "lon", "lat"), "node_id", tiles_.tile_table(spark, _TILES))
    parts = w.withColumn("mean", F.sin("lon") + 0.1 * F.col("tile")).withColumn("var", 0.01 + 0.001 * F.col("tile") + 0.0001 * F.col("node_id"))
    return rounded(tiles_.blend(parts, ["node_id"]), "mean", "var")


_PLAN = tiles_.tile_plan((295.0, 305.0), (33.0, 43.0), size=5.0, overlap=1.0)
_PLAN_SQL = "t(tile, west, east, south, north, mw, me, ms, mn) AS (VALUES " + ", ".join(f"({t.tile}, {t.west}::DOUBLE, {t.east}::DOUBLE, {t.south}::DOUBLE, {t.north}::DOUBLE, {', '.join(str(s in t.missing) for s in ('west', 'east', 'south', 'north'))})" for t in _PLAN) + ")"
_RAMP = " * ".join(f"(CASE WHEN {m} THEN 1 ELSE least(greatest(({s} * ({x} - {e}) + 1.0::DOUBLE) / 2, 0), 1) END)" for m, s, x, e in (("mw", "1", "n.lon", "west"), ("me", "-1", "n.lon", "east"), ("ms", "1", "n.lat", "south"), ("mn", "-1", "n.lat", "north")))


@query(f"""WITH {NODES}, {_PLAN_SQL}, a AS (SELECT node_id, {_RAMP} AS w, CASE WHEN (node_id + tile) % 13 = 0 THEN NULL ELSE cos(n.lat) + tile END AS v FROM n JOIN t ON n.lon BETWEEN west - 1 AND east + 1 AND n.lat BETWEEN south - 1 AND north + 1)
SELECT node_id, {r6('sum(CASE WHEN v IS NOT NULL AND w > 0 THEN w * v END) / sum(CASE WHEN v IS NOT NULL AND w > 0 THEN w END)')} AS value FROM a GROUP BY node_id""")
def assemble_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear ramps, renormalised by the weights that are there."""
    rows = tiles_.in_tiles(GRID.nodes(spark), tiles_.tile_table(spark, _PLAN)).withColumn("weight", tiles_.ramp_weight(1.0))
    value = F.when((F.col("node_id") + F.col("tile")) % 13 != 0, F.cos("lat") + F.col("tile"))
    return rounded(tiles_.assemble(rows.withColumn("value", value), ["node_id"]), "value")


@query(f"WITH {NODES}, {_TILE_SQL} SELECT node_id, min(tile) AS tile FROM n JOIN t ON n.lon BETWEEN west AND east AND n.lat BETWEEN south AND north GROUP BY node_id")
def core_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles_.core_owner(GRID.nodes(spark), "node_id", tiles_.tile_table(spark, _TILES))


@query(f"""WITH {NODES}, {_TILE_SQL}, m AS (SELECT tile, node_id, n.lon, n.lat FROM n JOIN t ON {_INSIDE})
SELECT a.tile AS i, b.tile AS j, count(*) AS n_shared FROM m a JOIN m b ON a.node_id = b.node_id AND a.tile < b.tile GROUP BY 1, 2 HAVING count(DISTINCT a.lon) >= 2 AND count(DISTINCT a.lat) >= 2""")
def tile_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles_.tile_adjacency(tiles_.in_tiles(GRID.nodes(spark), tiles_.tile_table(spark, _TILES)))


@query()
def merged_fold_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of too few effective points, merged within their fold."""
    counts = observations(spark, sf_dir).select((ops.cell_index(F.col("lon"), F.col("lat"))[1] * 5 + ops.cell_index(F.col("lon"), F.col("lat"))[0]).alias("block")).groupBy("block").count().collect()
    merged = ops.merge_small_blocks(_LAYOUT, {r["block"]: float(r["count"]) for r in counts}, least=float(np.median([r["count"] for r in counts])))
    return spark.createDataFrame(sorted(merged.items()), "block int, merged int")
