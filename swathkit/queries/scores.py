"""Evaluators, gauges, seams, calibration and orbits over the observation view."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import calibrate, evaluate, orbit
from ..operators.grid import cell_areas
from ..plans import search
from ..registry import query
from ..sources.observations import OBS_SQL, observations
from .grids import GRID, haversine_sql
from .scans import r6, rounded

_ROWS = "e AS (SELECT seq, mission, t, lon, lat, sla AS value, sla * 0.8 + 0.1 * sin(lon) AS mean, 0.05 + 0.01 * cos(lat) AS var FROM obs)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return obs.select("seq", "mission", "t", "lon", "lat", F.col("sla").alias("value"), (F.col("sla") * 0.8 + 0.1 * F.sin("lon")).alias("mean"), (0.05 + 0.01 * F.cos("lat")).alias("var"))


_RMSE, _SKILL = "sqrt(avg(pow(value - mean, 2)))", "greatest(0.0::DOUBLE, 1 - sqrt(avg(pow(value - mean, 2))) / sqrt(avg(pow(value, 2))))"
_CHI2, _COVER = "avg(pow(value - mean, 2) / var)", "avg(CASE WHEN abs(value - mean) <= sqrt(var) THEN 1.0::DOUBLE ELSE 0 END)"
_Z = "((value - mean) / sqrt(var))"
_CRPS = f"(sqrt(var) * ({_Z} * (2 * {stats.normal_cdf_sql(_Z)} - 1) + 2 * exp(-{_Z} * {_Z} / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())))"


@query(f"WITH {OBS_SQL}, {_ROWS} SELECT {r6(_RMSE)} AS rmse FROM e")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.accuracy(_rows(spark, sf_dir)), "rmse")


@query(f"WITH {OBS_SQL}, {_ROWS} SELECT {r6(_CHI2)} AS reduced_chi2, {r6(_COVER)} AS coverage_1sigma, {r6(f'avg({_CRPS})')} AS crps FROM e")
def calibration_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.calibration(_rows(spark, sf_dir)), "reduced_chi2", "coverage_1sigma", "crps")


@query(f"WITH {OBS_SQL}, {_ROWS} SELECT seq, {r6(_CRPS)} AS crps, {r6(stats.normal_cdf_sql(_Z))} AS pit FROM e")
def crps_and_pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, v, y = F.col("mean"), F.col("var"), F.col("value")
    return rounded(_rows(spark, sf_dir).select("seq", stats.crps_gaussian(m, v, y).alias("crps"), stats.pit(m, v, y).alias("pit")), "crps", "pit")


@query(f"WITH {OBS_SQL}, {_ROWS} SELECT mission, {r6(_SKILL)} AS mu_score FROM e GROUP BY mission")
def mu_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rows(spark, sf_dir).groupBy("mission").agg(stats.skill(F.col("value"), F.col("mean")).alias("mu_score")), "mu_score")


@query(f"WITH {OBS_SQL}, {_ROWS}, d AS (SELECT {_SKILL} AS s FROM e GROUP BY floor(t)) SELECT {r6('avg(s)')} AS mu, {r6('stddev_pop(s)')} AS sigma, count(*) AS n_days FROM d")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily skill: its mean and deviation."""
    return rounded(evaluate.leaderboard(_rows(spark, sf_dir)), "mu", "sigma")


@query(f"WITH {OBS_SQL}, {_ROWS} SELECT floor(lon)::BIGINT AS cx, floor(lat)::BIGINT AS cy, {r6(_SKILL)} AS score, count(*) AS n FROM e GROUP BY 1, 2")
def binned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.binned_scores(_rows(spark, sf_dir)), "score")


@query(f"WITH {OBS_SQL}, {_ROWS} SELECT 'accuracy' AS evaluator, {r6(_RMSE)} AS m0, NULL::DOUBLE AS m1, '' AS skipped FROM e UNION ALL SELECT 'calibration', {r6(_CHI2)}, {r6(_COVER)}, '' FROM e UNION ALL SELECT 'insitu', NULL, NULL, 'needs INSITU_GAUGES'")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per evaluator; what the context can't serve is a visible skip."""
    m, v, y = F.col("mean"), F.col("var"), F.col("value")
    evaluators = {"accuracy": ({"WITHHELD_OBS"}, [stats.rmse(y, m)]), "calibration": ({"WITHHELD_OBS"}, [stats.reduced_chi2(m, v, y), stats.coverage(m, v, y)]), "insitu": ({"INSITU_GAUGES"}, [F.corr(m, y)])}
    rows = evaluate.report(_rows(spark, sf_dir), {"WITHHELD_OBS"}, evaluators)
    return rounded(rows.select("evaluator", F.col("metrics")["metric_0"].alias("m0"), F.col("metrics")["metric_1"].alias("m1"), "skipped"), "m0", "m1")


@query(f"""WITH n AS (SELECT 295.0::DOUBLE + i AS lon, 33.0::DOUBLE + j AS lat FROM (SELECT unnest(range(0, 11)) AS i), (SELECT unnest(range(0, 11)) AS j)), a AS (SELECT sin(lon) AS value, cos(radians(lat)) AS area FROM n)
SELECT {r6('sum(area * value) / sum(area)')} AS area_mean, {r6('sqrt(sum(area * pow(value, 2)) / sum(area))')} AS area_rmse FROM a""")
def area_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area-weighted mean and RMSE of a field."""
    rows = cell_areas(GRID, spark).withColumn("value", F.sin("lon")).withColumn("error", F.col("value"))
    return rounded(evaluate.area_mean(rows).join(evaluate.area_rmse(rows)), "area_mean", "area_rmse")


_SERIES = "s AS (SELECT event_type AS gauge_id, ts::DATE AS day, avg(value) AS value, avg(value) + 10 * sin(day(ts::DATE)) AS mapped FROM events WHERE day(ts) % 9 <> 4 GROUP BY 1, 2, day(ts::DATE))"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("day(ts) % 9 <> 4")
    daily = events.groupBy(F.col("event_type").alias("gauge_id"), F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("value"))
    return daily.withColumn("mapped", F.col("value") + 10 * F.sin(F.dayofmonth("day")))


@query(f"WITH {_SERIES} SELECT a.gauge_id, a.day::VARCHAR AS day, {r6('a.value')} AS value, {r6('b.value')} AS null_persist FROM s a LEFT JOIN s b ON a.gauge_id = b.gauge_id AND b.day = a.day - 1")
def persistence_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday's value, null after a gap."""
    return rounded(evaluate.persistence_null(_series(spark, sf_dir).select("gauge_id", "day", "value")).withColumn("day", F.col("day").cast("string")), "value", "null_persist")


_CLIMO = """y AS (SELECT gauge_id, least(dayofyear(day), 365) AS doy, avg(value) AS m FROM s GROUP BY 1, 2),
c AS (SELECT gauge_id, (doy + k - 1 + 365) % 365 + 1 AS doy, avg(m) AS null_climo FROM y, (SELECT unnest(range(-7, 8)) AS k) GROUP BY 1, 2)"""


@query(f"WITH {_SERIES}, {_CLIMO} SELECT s.gauge_id, day::VARCHAR AS day, {r6('null_climo')} AS null_climo FROM s JOIN c ON s.gauge_id = c.gauge_id AND least(dayofyear(day), 365) = c.doy")
def climatology_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.climatology_null(_series(spark, sf_dir)).select("gauge_id", F.col("day").cast("string").alias("day"), "null_climo"), "null_climo")


@query(f"""WITH {_SERIES}, {_CLIMO}, p AS (SELECT s.*, null_climo, b.value AS null_persist, s.value - avg(s.value) OVER w AS g, s.mapped - avg(s.mapped) OVER w AS m
  FROM s JOIN c ON s.gauge_id = c.gauge_id AND least(dayofyear(s.day), 365) = c.doy LEFT JOIN s b ON s.gauge_id = b.gauge_id AND b.day = s.day - 1 WINDOW w AS (PARTITION BY s.gauge_id)),
r AS (SELECT gauge_id, count(*) AS n_days, corr(g, m) AS corr, sqrt(avg(pow(g - m, 2))) AS rmse, sqrt(avg(pow(value - null_climo, 2))) AS rmse_climo, sqrt(avg(pow(value - null_persist, 2))) AS rmse_persist FROM p GROUP BY gauge_id HAVING count(*) >= 2)
SELECT gauge_id, n_days, {r6('corr')} AS corr, {r6('rmse')} AS rmse, {r6('rmse_climo')} AS rmse_climo, {r6('rmse_persist')} AS rmse_persist, {r6('1 - rmse / rmse_climo')} AS reduction_climo, {r6('1 - rmse / rmse_persist')} AS reduction_persist FROM r""")
def gauge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation and RMSE per gauge against two nulls."""
    return rounded(evaluate.gauge_rows(_series(spark, sf_dir)), "corr", "rmse", "rmse_climo", "rmse_persist", "reduction_climo", "reduction_persist")


@query(f"""WITH {OBS_SQL}, a AS (SELECT floor(lon) AS x, floor(lat) AS y, avg(sla) AS v FROM obs WHERE seq % 2 = 0 GROUP BY 1, 2), b AS (SELECT floor(lon) AS x, floor(lat) AS y, avg(sla) AS v FROM obs WHERE seq % 2 = 1 GROUP BY 1, 2),
s AS (SELECT sqrt(avg(pow(a.v - b.v, 2))) AS d, count(*) AS n FROM a JOIN b ON a.x = b.x AND a.y = b.y), i AS (SELECT sqrt(avg(pow(d, 2))) AS r FROM (SELECT lead(v) OVER (PARTITION BY y ORDER BY x) - v AS d FROM a))
SELECT {r6('d')} AS seam_delta, n, {r6('r')} AS increment_rms, CASE WHEN d / r <= 1 THEN 'CLEAN' WHEN d / r <= 2.5 THEN 'ELEVATED' ELSE 'STRUCTURAL_STOP' END AS verdict, {r6('r / sqrt(9.0::DOUBLE)')} AS floor FROM s, i""")
def seam_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seam difference over interior increments, with its verdict and the ensemble floor."""
    obs = observations(spark, sf_dir).withColumn("x", F.floor("lon")).withColumn("y", F.floor("lat"))
    a, b = (obs.where(f"seq % 2 = {k}").groupBy("x", "y").agg(F.avg("sla").alias("value")) for k in (0, 1))
    row = evaluate.seam_delta(a, b, ["x", "y"]).join(evaluate.increment_rms(a, "x", "y"))
    return rounded(row.withColumn("verdict", evaluate.seam_verdict(F.col("seam_delta") / F.col("increment_rms"))).withColumn("floor", evaluate.ensemble_floor(F.col("increment_rms"), 10)), "seam_delta", "increment_rms", "floor")


_MEMBERS = "m AS (SELECT floor(lon)::INT * 100 + floor(lat)::INT AS node_id, (seq % 8) AS member, avg(sla) AS value FROM obs GROUP BY 1, 2)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.floor("lon").cast("int") * 100 + F.floor("lat").cast("int")
    return observations(spark, sf_dir).groupBy(node.alias("node_id"), (F.col("seq") % 8).alias("member")).agg(F.avg("sla").alias("value"))


@query(f"WITH {OBS_SQL}, {_MEMBERS} SELECT node_id, {r6('avg(value)')} AS mean, {r6('var_samp(value)')} AS var, {r6('stddev_samp(CASE WHEN member < 4 THEN value END)')} AS half_sd FROM m GROUP BY node_id")
def ensemble_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member means and variances, and a subset's deviation."""
    return rounded(_members(spark, sf_dir).groupBy("node_id").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.stddev_samp(F.when(F.col("member") < 4, F.col("value"))).alias("half_sd")), "mean", "var", "half_sd")


@query(f"WITH {OBS_SQL}, {_MEMBERS} SELECT a.node_id AS a, b.node_id AS b, {r6('covar_samp(a.value, b.value)')} AS cov FROM m a JOIN m b ON a.member = b.member AND b.node_id = a.node_id + 1 GROUP BY 1, 2")
def ensemble_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample covariance of neighbouring nodes."""
    m = _members(spark, sf_dir)
    a = m.select(F.col("node_id").alias("a"), "member", F.col("value").alias("va"))
    b = m.select((F.col("node_id") - 1).alias("a"), F.col("node_id").alias("b"), "member", F.col("value").alias("vb"))
    return rounded(a.join(b, ["a", "member"]).groupBy("a", "b").agg(F.covar_samp("va", "vb").alias("cov")), "cov")


@query(f"""WITH {OBS_SQL}, {_MEMBERS}, p AS (SELECT part, member, (member >> part) & 1 AS side FROM (SELECT unnest(range(0, 3)) AS part), (SELECT unnest(range(0, 8)) AS member)),
s AS (SELECT part, node_id, side, stddev_samp(value) AS sd, count(*) AS k FROM m JOIN p USING (member) GROUP BY 1, 2, 3),
d AS (SELECT part, node_id, max(CASE WHEN side = 0 THEN sd END) AS a, max(CASE WHEN side = 1 THEN sd END) AS b, max(k) AS k FROM s GROUP BY 1, 2)
SELECT part, {r6('sqrt(avg(pow(a - b, 2))) / (sqrt(avg((pow(a, 2) + pow(b, 2)) / 2)) / sqrt(max(k) - 1.0::DOUBLE))')} AS ratio FROM d GROUP BY part""")
def settling_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of deviations between the sides of member partitions, over the floor."""
    parts = spark.createDataFrame([(k, m, m >> k & 1) for k in range(3) for m in range(8)], "part long, member long, side int")
    return rounded(evaluate.settling(_members(spark, sf_dir), parts), "ratio")


# Calibration.
_POINTS = "x AS (SELECT seq, lon, lat, floor(t)::INT AS day, (seq // 50) AS pass_id, sla - 2.4 AS resid, 0.5 + 0.2 * cos(lat) AS v, sin(seq) + 0.5 * sin(seq - 1) AS z FROM obs)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    return observations(spark, sf_dir).select("seq", "lon", "lat", F.floor("t").cast("int").alias("day"), F.floor(s / 50).cast("long").alias("pass_id"), (F.col("sla") - 2.4).alias("resid"), (0.5 + 0.2 * F.cos("lat")).alias("v"), (F.sin(s) + 0.5 * F.sin(s - 1)).alias("z"))


_U, _VV = "least(greatest((lon - 300) / 5, -1), 1)", "least(greatest((lat - 38) / 5, -1), 1)"
_LOGS = f"least(greatest(0.1 + 0.2 * {_VV} - 0.3 * {_VV} * {_VV} + 0.05 * {_U} + 0.07 * {_U} * {_VV}, -0.2::DOUBLE), 0.2::DOUBLE)"


@query(f"WITH {OBS_SQL}, {_POINTS} SELECT seq, {r6(_LOGS)} AS log_s, {r6(f'exp({_LOGS}) * v')} AS var FROM x")
def polynomial_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped polynomial log s, and calibrated variance."""
    log_s = calibrate.polynomial_log_s(F.col("lon"), F.col("lat"), (0.1, 0.2, -0.3, 0.05, 0.07), (-0.2, 0.2))
    rows = _points(spark, sf_dir).withColumn("log_s", log_s).withColumn("var", F.col("v"))
    return rounded(calibrate.calibrated(rows).select("seq", "log_s", "var"), "log_s", "var")


@query(f"""WITH {OBS_SQL}, {_POINTS} SELECT seq, {r6('least(greatest(0.1 + 0.5 * ln(1 + 0.1 * least(greatest(floor((lon - 295) / 2), 0), 4) + 0.2 * least(greatest(floor((lat - 33) / 2), 0), 4)), -0.3::DOUBLE), 0.4::DOUBLE)')} AS log_s FROM x""")
def covariate_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log s from each cell's proxy."""
    proxy = spark.createDataFrame([(i, j, 1 + 0.1 * i + 0.2 * j) for i in range(5) for j in range(5)], "ix int, iy int, proxy double")
    return rounded(calibrate.covariate_log_s(_points(spark, sf_dir), proxy, 0.1, 0.5, (-0.3, 0.4)).select("seq", "log_s"), "log_s")


_SV, _TOT = "(exp(0.1::DOUBLE + 0.2 * " + _VV + ") * v)", "(exp(0.1::DOUBLE + 0.2 * " + _VV + ") * v + 0.0009)"


@query(f"""WITH {OBS_SQL}, {_POINTS} SELECT round(sum(0.5 * (ln({_TOT}) + pow(resid, 2) / {_TOT})), 3) AS nll, round(sum(0.5 * {_SV} / {_TOT} * (1 - pow(resid, 2) / {_TOT})), 3) AS g0, round(sum(0.5 * {_SV} / {_TOT} * (1 - pow(resid, 2) / {_TOT}) * {_VV}), 3) AS g1 FROM x""")
def likelihood_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative log likelihood and gradient in one aggregation."""
    row = calibrate.likelihood_terms(_points(spark, sf_dir), np.array([0.1, 0.2]))
    return row.select(*[F.round(c, 3).alias(c) for c in ("nll", "g0", "g1")])


_STEPS = " ".join(
    f""", n{k} AS (SELECT label, any_value(s) - greatest(least(sum(0.5 * exp(s) * v / (exp(s) * v + 0.0009) * (1 - resid * resid / (exp(s) * v + 0.0009))) / greatest(sum(0.5 * pow(exp(s) * v / (exp(s) * v + 0.0009), 2)), 1e-12), 1), -1) AS s FROM l JOIN n{k - 1} USING (label) GROUP BY label)"""
    for k in range(1, 16)
)


@query(f"""WITH {OBS_SQL}, {_POINTS}, l AS (SELECT resid, v, CASE WHEN lat < 38 THEN CASE WHEN lon < 300 THEN 'SW' ELSE 'SE' END ELSE CASE WHEN lon < 300 THEN 'NW' ELSE 'NE' END END AS label FROM x),
n0 AS (SELECT DISTINCT label, 0.0::DOUBLE AS s FROM l) {_STEPS} SELECT label, {r6('s')} AS log_s FROM n15""")
def region_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newton fit of log s in five regions."""
    points = _points(spark, sf_dir).withColumn("label", F.when(F.col("lat") < 38, F.when(F.col("lon") < 300, "SW").otherwise("SE")).otherwise(F.when(F.col("lon") < 300, "NW").otherwise("NE")))
    return spark.createDataFrame(sorted((k, round(v, 6)) for k, v in calibrate.fit_regions(points).items()), "label string, log_s double")


@query(f"WITH {OBS_SQL}, {_POINTS}, m AS (SELECT quantile_cont(pow(resid, 2) / v, 0.5) / 0.4549 AS r FROM x) SELECT {r6('r')} AS ratio, r >= 1.5 AS flag FROM m")
def tail_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.tail_diagnostic(_points(spark, sf_dir)), "ratio")


@query(f"""WITH {OBS_SQL}, {_POINTS}, c AS (SELECT *, z - avg(z) OVER (PARTITION BY day, pass_id) AS q FROM x), l AS (SELECT unnest(range(1, 21)) AS lag), v AS (SELECT avg(q * q) AS var FROM c),
r AS (SELECT day, pass_id, q, row_number() OVER (PARTITION BY day, pass_id ORDER BY seq) AS k FROM c)
SELECT lag::INT AS lag, {r6('avg(a.q * b.q) / any_value(var)')} AS rho, count(*) AS pairs FROM r a JOIN r b ON a.day = b.day AND a.pass_id = b.pass_id JOIN l ON a.k = b.k + lag, v GROUP BY lag""")
def lag_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation along passes at lags 1 to 20; lags without a pair are left out."""
    return rounded(calibrate.lag_correlations(_points(spark, sf_dir)).where("pairs > 0"), "rho")


_CAL = "CASE WHEN abs(resid) <= sqrt(1.1 * v + 0.0009) THEN 1.0::DOUBLE ELSE 0 END"


@query(f"""WITH {OBS_SQL}, {_POINTS} SELECT least(greatest(floor((lon - 295) / 2), 0), 4)::INT AS ix, least(greatest(floor((lat - 33) / 2), 0), 4)::INT AS iy, count(*) AS n, {r6(f'avg({_CAL})')} AS coverage, {r6(f'abs(avg({_CAL}) - 0.6827)')} AS deficit, {r6('avg(pow(resid, 2) / (1.1 * v + 0.0009))')} AS chi2 FROM x GROUP BY 1, 2""")
def cell_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and chi-square by cell."""
    ix, iy = calibrate.cell_index(F.col("lon"), F.col("lat"))
    rows = _points(spark, sf_dir).withColumn("s", F.lit(1.1)).withColumn("ix", ix).withColumn("iy", iy)
    return rounded(calibrate.coverage_by(rows, "ix", "iy"), "coverage", "deficit", "chi2")


@query(f"""WITH {OBS_SQL}, {_POINTS}, y AS (SELECT CASE WHEN lat < 38 THEN 'south' ELSE 'north' END AS class, abs(avg({_CAL}) - 0.6827) AS d FROM x GROUP BY 1) SELECT {r6('max(d)')} AS worst, arg_max(class, d) AS region FROM y""")
def worst_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir).withColumn("s", F.lit(1.1)).withColumn("class", F.when(F.col("lat") < 38, "south").otherwise("north"))
    return rounded(calibrate.worst_region(calibrate.coverage_by(rows, "class")), "worst")


@query(f"""WITH g AS (SELECT i, j, 0.1 + 0.2 * ((33 + j * 0.25::DOUBLE) - 38) / 5 - 0.3 * pow(((33 + j * 0.25::DOUBLE) - 38) / 5, 2) + 0.05 * ((295 + i * 0.25::DOUBLE) - 300) / 5 AS raw FROM (SELECT unnest(range(0, 41)) AS i), (SELECT unnest(range(0, 41)) AS j)),
d AS (SELECT raw, (lead(raw) OVER (PARTITION BY j ORDER BY i) - lag(raw) OVER (PARTITION BY j ORDER BY i)) / 0.5 AS gx, (lead(raw) OVER (PARTITION BY i ORDER BY j) - lag(raw) OVER (PARTITION BY i ORDER BY j)) / 0.5 AS gy FROM g)
SELECT {r6('avg(CASE WHEN greatest(-0.2 - raw, raw - 0.1, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END)')} AS share, {r6('max(greatest(-0.2 - raw, raw - 0.1, 0))')} AS excursion, {r6('max(sqrt(gx * gx + gy * gy))')} AS bound FROM d""")
def clip_and_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a clip engages, and the largest gradient of log s."""
    nodes = spark.range(41 * 41).select(F.pmod("id", F.lit(41)).alias("ix"), F.floor(F.col("id") / 41).alias("iy"))
    nodes = nodes.withColumn("lon", 295 + F.col("ix") * F.lit(0.25)).withColumn("lat", 33 + F.col("iy") * F.lit(0.25))
    nodes = nodes.withColumn("raw", calibrate.polynomial_log_s(F.col("lon"), F.col("lat"), (0.1, 0.2, -0.3, 0.05, 0.0))).withColumn("log_s", F.col("raw"))
    return rounded(calibrate.clip_use(nodes, -0.2, 0.1).join(calibrate.gradient_bound(nodes, 0.25)), "share", "excursion", "bound")


# Orbits.
_PASSES = f"""a AS (SELECT *, CASE WHEN (t - lag(t) OVER w) * 86400 > 600 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM obs WINDOW w AS (PARTITION BY mission ORDER BY t, seq)),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY mission ORDER BY t, seq)::BIGINT AS pass_id FROM a)"""


@query(f"WITH {OBS_SQL}, {_PASSES} SELECT seq, pass_id FROM p")
def segment_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each mission, split at gaps of more than ten minutes."""
    return orbit.segment_passes(observations(spark, sf_dir), 600.0).select("seq", "pass_id")


@query(f"""WITH {OBS_SQL}, {_PASSES}, d AS (SELECT *, coalesce({haversine_sql('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')}, 0) AS step FROM p WINDOW w AS (PARTITION BY mission, pass_id ORDER BY t, seq)),
k AS (SELECT *, sum(step) OVER (PARTITION BY mission, pass_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS arc FROM d), f AS (SELECT *, max(arc) OVER (PARTITION BY mission, pass_id) AS length FROM k)
SELECT seq, round(arc, 4) + 0.0::DOUBLE AS arc_km, round(CASE WHEN length > 0 THEN 2 * arc / length - 1 ELSE 0 END, 5) + 0.0::DOUBLE AS s FROM f""")
def arc_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance along each pass."""
    arcs = orbit.arc_coordinate(orbit.segment_passes(observations(spark, sf_dir), 600.0))
    return arcs.select("seq", (F.round("arc_km", 4) + 0.0).alias("arc_km"), (F.round("s", 5) + 0.0).alias("s"))


_DIRECTED = """q AS (SELECT *, sign(lead(lat) OVER (PARTITION BY mission, pass_id ORDER BY t, seq) - lat) AS up FROM p),
k AS (SELECT mission, pass_id, quantile_cont(up, 0.5) > 0 AS ascending FROM q GROUP BY 1, 2 HAVING count(*) >= 2), s AS (SELECT p.*, ascending FROM p JOIN k USING (mission, pass_id))"""


@query(f"""WITH {OBS_SQL}, {_PASSES}, {_DIRECTED}, c AS (SELECT mission, ascending, pass_id, atan2(2 * covar_pop(lon * 111.32 * cos(radians(38.0::DOUBLE)), lat * 111.32), var_pop(lon * 111.32 * cos(radians(38.0::DOUBLE))) - var_pop(lat * 111.32)) AS a FROM s GROUP BY 1, 2, 3)
SELECT mission, ascending, count(*) AS n_passes, round(((90 - degrees(atan2(avg(sin(a)), avg(cos(a)))) / 2) % 180 + 180) % 180, 4) + 0.0::DOUBLE AS heading_deg FROM c GROUP BY 1, 2""")
def pass_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total-least-squares headings per mission and direction."""
    rows = orbit.headings(orbit.split_passes(observations(spark, sf_dir), 600.0), 38.0)
    return rows.withColumn("heading_deg", F.round("heading_deg", 4) + 0.0)


_CROSS = """x AS (SELECT mission, ascending, pass_id, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM s WINDOW w AS (PARTITION BY mission, pass_id ORDER BY t, seq)),
c AS (SELECT mission, ascending, pass_id, lon + (38 - lat) / (lat2 - lat) * (lon2 - lon) AS crossing FROM x WHERE lat2 <> lat AND least(lat, lat2) <= 38 AND greatest(lat, lat2) > 38),
d AS (SELECT * FROM c WHERE crossing BETWEEN 295 AND 305)"""


@query(f"WITH {OBS_SQL}, {_PASSES}, {_DIRECTED}, {_CROSS} SELECT mission, ascending, pass_id, {r6('crossing')} AS crossing FROM d")
def phi0_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(orbit.crossings(orbit.split_passes(observations(spark, sf_dir), 600.0), 38.0, (295.0, 305.0)), "crossing")


@query(f"""WITH {OBS_SQL}, {_PASSES}, {_DIRECTED}, {_CROSS}, n AS (SELECT *, CASE WHEN crossing - lag(crossing) OVER (PARTITION BY mission, ascending ORDER BY crossing) <= 0.05 THEN 0 ELSE 1 END AS fresh FROM d),
r AS (SELECT mission, ascending, count(*) AS n_crossings, sum(fresh)::BIGINT AS n_clusters FROM n GROUP BY 1, 2)
SELECT *, {r6('n_clusters / n_crossings')} AS ratio, CASE WHEN n_clusters / n_crossings <= 0.25 THEN 'repeat' WHEN n_clusters / n_crossings >= 0.431 THEN 'drifting' ELSE 'refused' END AS orbit_class FROM r""")
def orbit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orbit.crossings(orbit.split_passes(observations(spark, sf_dir), 600.0), 38.0, (295.0, 305.0))
    return rounded(orbit.classify_orbits(found, 0.05), "ratio")


@query(f"""WITH {OBS_SQL}, {_PASSES}, {_DIRECTED}, {_CROSS}, n AS (SELECT *, CASE WHEN crossing - lag(crossing) OVER w <= 0.05 THEN 0 ELSE 1 END AS fresh FROM d WINDOW w AS (PARTITION BY mission, ascending ORDER BY crossing)),
u AS (SELECT *, sum(fresh) OVER (PARTITION BY mission, ascending ORDER BY crossing ROWS UNBOUNDED PRECEDING) AS cluster FROM n), m AS (SELECT mission, ascending, cluster, avg(crossing) AS centre FROM u GROUP BY 1, 2, 3),
g AS (SELECT mission, ascending, (lead(centre) OVER (PARTITION BY mission, ascending ORDER BY centre) - centre) * 111.32 * cos(radians(38.0::DOUBLE)) AS gap FROM m)
SELECT mission, ascending, {r6('quantile_cont(gap, 0.1)')} AS q10_km, {r6('quantile_cont(gap, 0.5)')} AS s_lon_km, {r6('quantile_cont(gap, 0.9)')} AS q90_km, count(*) AS n_gaps FROM g WHERE gap IS NOT NULL GROUP BY 1, 2""")
def family_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing of crossing clusters."""
    found = orbit.crossings(orbit.split_passes(observations(spark, sf_dir), 600.0), 38.0, (295.0, 305.0))
    return rounded(orbit.families(found, 0.05, 38.0), "q10_km", "s_lon_km", "q90_km")


# Ranking.
@query("""WITH s AS (SELECT s_suppkey::INT AS id, s_acctbal / 100 AS lambda_x, (s_suppkey * 37 % 101) / 100.0::DOUBLE AS mu, 0.6 + (s_suppkey * 53 % 97) / 500.0::DOUBLE AS cov FROM supplier)
SELECT id, row_number() OVER (ORDER BY lambda_x, id)::INT AS place FROM s WHERE mu >= 0.3 AND abs(cov - 0.6827) <= 0.05""")
def ranked_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials that pass their bars, by resolution."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    scores = F.create_map(F.lit("lambda_x"), F.col("s_acctbal") / 100, F.lit("mu"), (k * 37 % 101) / 100.0, F.lit("cov"), 0.6 + (k * 53 % 97) / 500.0)
    trials = s.select(k.cast("int").alias("id"), scores.alias("scores"), F.lit(True).alias("feasible"))
    return search.rank(trials, [search.Bar("mu", "ge", 0.3), search.Bar("cov", "within", 0.6827, 0.05)], "lambda_x").select("id", "place")


@query("""WITH a AS (SELECT o_orderkey AS k, md5(o_orderstatus) AS d FROM orders WHERE o_totalprice > 50000), b AS (SELECT o_orderkey AS k, md5(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderstatus END) AS d FROM orders WHERE o_totalprice < 300000)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.d IS DISTINCT FROM b.d""")
def changed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and modified rows of two states by digest."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_totalprice")
    before = orders.where("o_totalprice > 50000").select("k", F.md5("o_orderstatus").alias("d"))
    after = orders.where("o_totalprice < 300000").select("k", F.md5(F.when(F.col("k") % 5 == 0, "x").otherwise(F.col("o_orderstatus"))).alias("d"))
    return search.changed_rows(before, after, "k", "d")
