"""Grids, covariances and interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import grid as ops
from ..operators.grid import Grid
from ..registry import query
from ..sources.observations import OBS_SQL, observations
from .scans import r6, rounded

GRID = Grid.covering((295.0, 305.0), (33.0, 43.0), 1.0)
NODES = "n AS (SELECT iy * 11 + ix AS node_id, iy, ix, 295.0::DOUBLE + ix AS lon, 33.0::DOUBLE + iy AS lat FROM (SELECT unnest(range(0, 11)) AS iy), (SELECT unnest(range(0, 11)) AS ix))"


@query(f"WITH {NODES} SELECT node_id, iy::INT AS iy, ix::INT AS ix, lon, lat FROM n")
def grid_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRID.nodes(spark)


@query(f"WITH {NODES} SELECT node_id, iy::INT AS iy, ix::INT AS ix, {r6('pow(6371000.0::DOUBLE, 2) * cos(radians(lat)) * radians(1.0::DOUBLE) * radians(1.0::DOUBLE) / 1e6')} AS area_km2 FROM n")
def cell_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.cell_areas(GRID, spark).select("node_id", "iy", "ix", (F.col("area_m2") / 1e6).alias("area_km2")), "area_km2")


@query(f"WITH {NODES} SELECT lon, lat FROM n WHERE lon BETWEEN 297 AND 300.5 AND lat BETWEEN 35 AND 41")
def grid_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRID.window((297.0, 300.5), (35.0, 41.0)).nodes(spark).select("lon", "lat")


@query(f"""WITH a AS (SELECT x, lag(x) OVER w AS p, lead(x) OVER w AS q FROM (SELECT DISTINCT o_custkey::DOUBLE AS x FROM orders) WINDOW w AS (ORDER BY x))
SELECT x, {r6('coalesce((x + q) / 2, x + (x - p) / 2) - coalesce((x + p) / 2, x - (q - x) / 2)')} AS width FROM a""")
def edge_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell widths of an irregular axis."""
    axis = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("double").alias("x")).distinct()
    return rounded(ops.edge_widths(axis, "x", 10_000.0), "width")


@query(f"WITH {OBS_SQL} SELECT seq FROM obs WHERE lon BETWEEN 296.5 AND 301.5 AND lat BETWEEN 34.5 AND 39.5")
def halo_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations within half a degree of a sub-grid's nodes."""
    g = GRID.window((297.0, 301.0), (35.0, 39.0))
    obs = observations(spark, sf_dir)
    return obs.where(geo.in_range("lon", g.lon.low - 0.5, g.lon.high + 0.5) & geo.in_range("lat", g.lat.low - 0.5, g.lat.high + 0.5)).select("seq")


@query(f"WITH {OBS_SQL} SELECT d.day, count(*) AS n FROM obs JOIN (SELECT unnest(range(2, 12))::DOUBLE AS day) d ON abs(t - day) <= 1.5 GROUP BY d.day")
def half_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations within 1.5 days of each output day: candidate days are arithmetic, so no range join is needed."""
    obs = observations(spark, sf_dir)
    days = F.explode(F.sequence(F.ceil(F.col("t") - 1.5).cast("int"), F.floor(F.col("t") + 1.5).cast("int")))
    return obs.select(days.alias("day")).where("day >= 2 AND day < 12").groupBy(F.col("day").cast("double").alias("day")).agg(F.count(F.lit(1)).alias("n"))


_CORNERS = f"""c AS (SELECT o.*, least(floor(lon - 295), 9) AS ix, least(floor(lat - 33), 9) AS iy FROM obs o),
k AS (SELECT c.*, ((iy + dy) * 11 + ix + dx)::BIGINT AS node_id, (CASE dx WHEN 1 THEN lon - 295 - ix ELSE 1 - (lon - 295 - ix) END) * (CASE dy WHEN 1 THEN lat - 33 - iy ELSE 1 - (lat - 33 - iy) END) AS w
  FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dy, dx))"""


@query(f"WITH {OBS_SQL}, {_CORNERS} SELECT seq, node_id, {r6('w')} AS w FROM k")
def bilinear_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.corner_weights(observations(spark, sf_dir), GRID).select("seq", "node_id", "w"), "w")


@query(f"""WITH {OBS_SQL}, {_CORNERS}, {NODES}, f AS (SELECT node_id, CASE WHEN node_id % 17 = 3 THEN NULL ELSE sin(radians(lon)) + cos(radians(lat)) END AS v FROM n),
s AS (SELECT seq, sum(w * v) / sum(w) AS v FROM k JOIN f USING (node_id) WHERE v IS NOT NULL AND w > 0 GROUP BY seq)
SELECT obs.seq, {r6('v')} AS v FROM obs LEFT JOIN s USING (seq)""")
def bilinear_wet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolation with missing corners left out."""
    field = GRID.nodes(spark).select("node_id", F.when(F.col("node_id") % 17 != 3, F.sin(F.radians("lon")) + F.cos(F.radians("lat"))).alias("v"))
    return rounded(ops.interpolate(observations(spark, sf_dir), "seq", GRID, field, "v").select("seq", "v"), "v")


@query(f"""WITH {OBS_SQL}, {_CORNERS}, {NODES}, s AS (SELECT unnest(range(0, 31))::DOUBLE AS day), g AS (SELECT node_id, day, sin(radians(lon)) * day AS ssh FROM n, s),
v AS (SELECT seq, day, sum(w * ssh) AS v FROM k JOIN g USING (node_id) WHERE day IN (floor(t), floor(t) + 1) GROUP BY seq, day, t)
SELECT o.seq, {r6('sum(v * CASE WHEN day = floor(t) THEN 1 - (t - floor(t)) ELSE t - floor(t) END)')} AS truth FROM v JOIN obs o USING (seq) GROUP BY o.seq""")
def truth_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gridded truth at observations: linear in time between bracketing slabs, bilinear in space."""
    slabs = GRID.nodes(spark).join(spark.range(31).select(F.col("id").cast("double").alias("day"))).select("node_id", "day", (F.sin(F.radians("lon")) * F.col("day")).alias("ssh"))
    low = F.floor("t").cast("double")
    part = F.col("t") - low
    obs = observations(spark, sf_dir).select("seq", "lon", "lat", F.explode(F.array(F.struct(low.alias("day"), (1 - part).alias("wt")), F.struct((low + 1).alias("day"), part.alias("wt")))).alias("s")).select("seq", "lon", "lat", "s.day", "s.wt")
    corners = ops.corner_weights(obs, GRID).join(slabs, ["node_id", "day"])
    return rounded(corners.groupBy("seq").agg(F.sum(F.col("w") * F.col("wt") * F.col("ssh")).alias("truth")), "truth")


@query(f"WITH {OBS_SQL} SELECT seq, {r6('(lon - 300) * 111.32 * cos(radians(38.0::DOUBLE))')} AS x_km, {r6('(lat - 38) * 111.32')} AS y_km FROM obs")
def plane_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.plane_km(F.col("lon"), F.col("lat"), 38.0, 300.0)
    return rounded(observations(spark, sf_dir).select("seq", x.alias("x_km"), y.alias("y_km")), "x_km", "y_km")


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, {a}))))"


@query(f"WITH {OBS_SQL} SELECT seq, {r6(haversine_sql('lon', 'lat', '300.0::DOUBLE', '38.0::DOUBLE'))} AS km FROM obs")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(observations(spark, sf_dir).select("seq", geo.haversine_km(F.col("lon"), F.col("lat"), F.lit(300.0), F.lit(38.0)).alias("km")), "km")


_PAIRS = f"p AS (SELECT a.seq AS i, b.seq AS j, a.lon AS lon1, a.lat AS lat1, a.t AS t1, b.lon AS lon2, b.lat AS lat2, b.t AS t2 FROM obs a JOIN obs b ON b.seq = a.seq + 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).select("seq", "lon", "lat", "t")
    a = obs.select(F.col("seq").alias("i"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.col("t").alias("t1"))
    b = obs.select((F.col("seq") - 1).alias("i"), F.col("seq").alias("j"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("t").alias("t2"))
    return a.join(b, "i")


def _ends() -> list[F.Column]:
    return [F.col(c) for c in ("lon1", "lat1", "t1", "lon2", "lat2", "t2")]


_M32 = "((1 + sqrt(3.0::DOUBLE) * {d} / {s}) * exp(-sqrt(3.0::DOUBLE) * {d} / {s}))"
_KM = "sqrt(pow((lon1 - lon2) * 111.195 * cos(radians((lat1 + lat2) / 2)), 2) + pow((lat1 - lat2) * 111.195, 2))"


@query(f"WITH {OBS_SQL}, {_PAIRS} SELECT i, j, {r6('0.05 * ' + _M32.format(d=_KM, s=300.0) + ' * ' + _M32.format(d='abs(t1 - t2)', s=10.0))} AS k FROM p")
def matern_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pairs(spark, sf_dir).select("i", "j", geo.matern_space_time(*_ends(), variance=0.05, length=300.0, time=10.0).alias("k")), "k")


@query(f"WITH {OBS_SQL}, {_PAIRS} SELECT i, j, {r6('0.05 * exp(-pow(lon1 - lon2, 2) - pow((lat1 - lat2) / 1.5, 2) - pow((t1 - t2) / 7, 2))')} AS k FROM p")
def gaussian_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon1, lat1, t1, lon2, lat2, t2 = _ends()
    return rounded(_pairs(spark, sf_dir).select("i", "j", geo.gaussian_degrees(lon1 - lon2, lat1 - lat2, t1 - t2, 0.05, 1.0, 1.5, 7.0).alias("k")), "k")


_V = "((least(greatest({lat}, 33), 43) - 38) / 5)"
_L1, _L2 = (f"exp(0.1 + 0.3 * {_V.format(lat=x)})" for x in ("lat1", "lat2"))
_PS = f"(0.05 * ({_L1} * {_L2} / ((pow({_L1}, 2) + pow({_L2}, 2)) / 2)) * exp(-(pow(lon1 - lon2, 2) + pow(lat1 - lat2, 2)) / ((pow({_L1}, 2) + pow({_L2}, 2)) / 2)) * exp(-pow((t1 - t2) / 7, 2)))"


@query(f"WITH {OBS_SQL}, {_PAIRS} SELECT i, j, {r6(_PS)} AS k FROM p")
def paciorek_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = lambda lat: geo.latitude_field(lat, "exp_quad", 0.1, 0.3)
    s = F.lit(0.05**0.5)
    k = geo.paciorek_degrees(*_ends(), length(F.col("lat1")), length(F.col("lat2")), s, s, 7.0)
    return rounded(_pairs(spark, sf_dir).select("i", "j", k.alias("k")), "k")


@query(f"WITH {OBS_SQL} SELECT seq, {r6('exp(0.2 - 0.1 * ' + _V.format(lat='lat') + ' + 0.05 * pow(' + _V.format(lat='lat') + ', 2))')} AS quad, {r6('2.0 * exp(0.4 * ' + _V.format(lat='lat') + ')')} AS mult, {r6('sqrt(8.0::DOUBLE) / (100 + seq)')} AS kappa, {r6('sqrt(8.0::DOUBLE) / (sqrt(8.0::DOUBLE) / (100 + seq))')} AS range_km FROM obs")
def latitude_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latitude fields, and range to kappa and back."""
    lat, km = F.col("lat"), (100 + F.col("seq")).cast("double")
    kappa = geo.kappa_from_range(km)
    out = observations(spark, sf_dir).select("seq", geo.latitude_field(lat, "exp_quad", 0.2, -0.1, 0.05).alias("quad"), geo.latitude_field(lat, "exp_linear_mult", 2.0, 0.4).alias("mult"), kappa.alias("kappa"), geo.range_from_kappa(kappa).alias("range_km"))
    return rounded(out, "quad", "mult", "kappa", "range_km")


_RHO = "(2 * 6371000.0::DOUBLE * (1 + sin(radians(70.0::DOUBLE))) / 2 * tan(radians(45 - (lat + 40) / 2)))"


@query(f"WITH {OBS_SQL} SELECT seq, {r6(_RHO + ' * sin(radians(lon + 45))')} AS x, {r6('-' + _RHO + ' * cos(radians(lon + 45))')} AS y FROM obs")
def polar_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polar stereographic metres of positions moved to the north."""
    x, y = geo.polar_stereographic(F.col("lon"), F.col("lat") + 40.0)
    return rounded(observations(spark, sf_dir).select("seq", x.alias("x"), y.alias("y")), "x", "y")


@query(f"WITH {OBS_SQL} SELECT seq, (least(greatest(ceil(lat - 33 - 0.5), 0), 10) * 11 + least(greatest(ceil(lon - 295 - 0.5), 0), 10))::BIGINT AS node_id FROM obs")
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.nearest_nodes(observations(spark, sf_dir), GRID).select("seq", "node_id")


@query(f"""WITH {OBS_SQL}, p AS (SELECT * FROM obs WHERE mission = 'purchase'), s AS (SELECT * FROM obs WHERE mission <> 'purchase')
SELECT p.seq, arg_min(s.seq, (pow(s.lon - p.lon, 2) + pow(s.lat - p.lat, 2), s.seq)) AS node FROM p, s GROUP BY p.seq""")
def nearest_scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each observation of the withheld mission the nearest one of all others."""
    obs = observations(spark, sf_dir)
    points, support = obs.where("mission = 'purchase'").select("seq", "lon", "lat"), obs.where("mission <> 'purchase'").select(F.col("seq").alias("node"), "lon", "lat")
    return ops.nearest_of(points, "seq", support).select("seq", "node")


@query(f"""WITH {OBS_SQL}, {NODES}, b AS (SELECT * FROM obs WHERE t BETWEEN 5 AND 10), w AS (SELECT node_id, 1 / (pow(n.lon - b.lon, 2) + pow(n.lat - b.lat, 2) + 1e-9) AS w, sla FROM n, b)
SELECT node_id, {r6('sum(w * sla) / sum(w)')} AS estimate FROM w GROUP BY node_id""")
def idw_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-distance map of the observations of five days."""
    obs = observations(spark, sf_dir).where(geo.in_range("t", 5, 10))
    return rounded(ops.idw(obs, GRID.nodes(spark)), "estimate")
