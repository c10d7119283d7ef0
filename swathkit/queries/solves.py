"""Reconstruction queries: the five methods, tiled blends, members, spectra and tuning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..kernels import miost, spectra
from ..operators.blend import lonlat_tiles
from ..operators.grid import Grid
from ..plans import reconstruct as plan
from ..plans import search
from ..registry import query
from ..sources.observations import OBS_SQL, observations, synthetic
from .scans import r6, rounded

#: A coarse grid and few observations keep one unit's linear algebra small at every scale factor.
GRID = Grid.covering((295.0, 305.0), (33.0, 43.0), 1.0)
TIMES = (5.0, 15.0)
#: Every day of the table: with half a day on both sides all observations reach a solve.
DAYS = tuple(d + 0.5 for d in range(30))


def _obs(spark: SparkSession, sf_dir: str, step: int = 1) -> DataFrame:
    """Anomalies of the observation view, within a day of the output times (units are bounded by their windows)."""
    obs = observations(spark, sf_dir).withColumn("sla", F.sin(F.col("lon") / 2) * 0.2 + F.col("sla") * 0.01)
    return obs.where(F.col("seq") % step == 0)


def _run(method: str, times: tuple[float, ...] = TIMES, **params: object) -> plan.Run:
    return plan.Run(method, GRID, times, dict(params), half_window=0.5, withheld="purchase")


def _thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About five hundred observations a day at any scale factor: super-observations per cell and day."""
    obs = _obs(spark, sf_dir)
    cell = obs.groupBy(F.floor("t").alias("day"), "mission", F.floor(F.col("lon") * 2).alias("cx"), F.floor(F.col("lat") * 2).alias("cy"))
    return cell.agg(F.min("seq").alias("seq"), *[F.avg(c).alias(c) for c in ("lon", "lat", "t", "sla")], F.first("err_var").alias("err_var")).drop("day", "cx", "cy")


def _moments(product: DataFrame) -> DataFrame:
    return rounded(product.select("time_days", "node_id", "mean", "var"), "mean", "var")


@query()
def solve_oi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimal interpolation, one unit per output time."""
    return _moments(plan.run_single(_thin(spark, sf_dir), _run("oi", DAYS)))


@query()
def solve_oi_paciorek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OI with lengths by latitude."""
    return _moments(plan.run_single(_thin(spark, sf_dir), _run("oi", DAYS, kernel="paciorek", length=(0.2, 0.1))))


@query()
def solve_gmrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice Markov field with exact variances."""
    return _moments(plan.run_single(_thin(spark, sf_dir), _run("gmrf", DAYS)))


@query()
def solve_fem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite elements on two triangles per cell."""
    return _moments(plan.run_single(_thin(spark, sf_dir), _run("fem", DAYS)))


@query()
def solve_miost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiscale basis by conjugate gradients, with keyed members."""
    return _moments(plan.run_single(_thin(spark, sf_dir), _run("miost", DAYS, wavelengths=(800.0,), members=4)))


@query()
def solve_trivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perturbed inverse-distance ensemble."""
    return _moments(plan.run_single(_thin(spark, sf_dir), _run("trivial", DAYS, members=10)))


#: A prior so short that an observation on a node decides it alone: mean = v / (v + r) * y.
@query(f"""WITH {OBS_SQL}, d AS (SELECT (seq % 121) AS node_id, min(seq) AS seq FROM obs WHERE mission <> 'purchase' GROUP BY 1) SELECT 5.0::DOUBLE AS time_days, node_id, {r6('0.05::DOUBLE / 0.06 * sla')} AS mean, {r6('0.05::DOUBLE - 0.05::DOUBLE * 0.05 / 0.06')} AS var FROM d JOIN obs USING (seq)""")
def oi_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OI of one observation per node under a very short covariance, which has a closed form."""
    obs = observations(spark, sf_dir).where("mission <> 'purchase'").withColumn("node_id", F.col("seq") % 121)
    first = obs.groupBy("node_id").agg(F.min(F.struct("seq", "sla", "mission", "err_var")).alias("x")).select("node_id", "x.*")
    placed = first.join(GRID.nodes(spark).select("node_id", "lon", "lat"), "node_id").withColumn("t", F.lit(5.0))
    run = plan.Run("oi", GRID, (5.0,), {"length_scale": 1e-3, "time_scale": 10.0, "variance": 0.05}, withheld="purchase")
    return _moments(plan.run_single(placed, run))


TILES = lonlat_tiles((295.0, 305.0), (33.0, 43.0), 2, 2, 200.0)


@query()
def run_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tiles solved in parallel and blended."""
    return rounded(plan.run_tiled(_thin(spark, sf_dir), _run("oi", DAYS), TILES).select("time_days", "node_id", "mean", "var", "n_tiles"), "mean", "var")


@query()
def tiled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blended product scored on the withheld mission."""
    obs = _thin(spark, sf_dir)
    run = _run("oi")
    rows = plan.report_rows(spark, plan.run_tiled(obs, run, TILES), run, obs.where("mission = 'purchase' AND abs(t - 5) < 1").select("seq", "lon", "lat", "sla"))
    m, v, y = F.col("mean"), F.col("var"), F.col("value")
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), stats.rmse(y, m).alias("rmse"), stats.skill(y, m).alias("mu_score"), stats.reduced_chi2(m, v + 0.01, y).alias("reduced_chi2")), "rmse", "mu_score", "reduced_chi2")


@query()
def coherent_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of coherent draws of tile products."""
    run = _run("oi")
    product = plan.units(_thin(spark, sf_dir).where("mission <> 'purchase'"), run, TILES)
    members = plan.draws(product, 16, run, 0.25)
    return rounded(members.groupBy("time_days", "tile").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.count(F.lit(1)).alias("n")), "mean", "var")


@query()
def factor_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of neighbouring nodes from stored factor rows."""
    product = plan.run_single(_thin(spark, sf_dir), _run("oi"))
    pairs = GRID.nodes(spark).where("ix < 10").select(F.col("node_id").alias("a"), (F.col("node_id") + 1).alias("b"))
    return rounded(plan.factor_covariance(product, pairs).drop("tile"), "cov")


@query()
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eastward difference per kilometre: its mean, and Var(a) + Var(b) - 2 Cov(a, b) over the squared distance."""
    product = plan.run_single(_thin(spark, sf_dir), _run("oi"))
    pairs = GRID.nodes(spark).where("ix < 10").select(F.col("node_id").alias("a"), (F.col("node_id") + 1).alias("b"))
    cov = plan.factor_covariance(product, pairs)
    w = W.partitionBy("time_days", "lat").orderBy("lon")
    km = 111.195 * F.cos(F.radians("lat"))
    steps = product.withColumn("mean_b", F.lead("mean").over(w)).withColumn("var_b", F.lead("var").over(w)).where("mean_b IS NOT NULL")
    rows = steps.join(cov.select("time_days", F.col("a").alias("node_id"), "cov"), ["time_days", "node_id"])
    return rounded(rows.select("time_days", "node_id", ((F.col("mean_b") - F.col("mean")) / km).alias("slope"), ((F.col("var") + F.col("var_b") - 2 * F.col("cov")) / (km * km)).alias("slope_var")), "slope", "slope_var")


@query()
def daily_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps over sliding half-day windows with a one-degree frame."""
    return rounded(plan.maps(_thin(spark, sf_dir), _run("gmrf", DAYS)), "ssh", "var")


@query()
def map_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring spectra of daily maps: detrended, tapered, half-plane power."""
    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        field = pdf.pivot(index="lat", columns="lon", values="ssh").to_numpy()
        p, kx, ky = spectra.power2d(spectra.detrend(field), spectra.radial_hann(*field.shape), 100.0, 111.0)
        k, power, n = spectra.rings(p, kx, ky, 1 / 1100.0)
        return pd.DataFrame({"day": key[0], "ring": np.arange(len(k)), "power": power, "n": n})

    return rounded(plan.maps(_thin(spark, sf_dir), _run("gmrf")).groupBy("day").applyInPandas(one, "day int, ring int, power double, n long"), "power")


@query()
def effective_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wavelength at which a smoothed track's error reaches half of the signal's power, per mission."""
    w = W.partitionBy("mission").orderBy("t").rowsBetween(-5, 5)
    track = synthetic(spark, 0, 4).withColumn("mapped", F.avg("sla").over(w)).withColumn("segment", F.floor(F.col("seq") / 256))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [g.sort_values("seq") for _, g in pdf.groupby("segment")]
        parts = [g for g in parts if len(g) == 128]
        lam = spectra.resolved_wavelength([g["sla"].to_numpy() for g in parts], [(g["sla"] - g["mapped"]).to_numpy() for g in parts], 7.0)
        return pd.DataFrame({"mission": [key[0]], "n_segments": [len(parts)], "lambda_x": [lam]})

    return rounded(track.groupBy("mission").applyInPandas(one, "mission string, n_segments int, lambda_x double"), "lambda_x")


@query(f"""WITH s AS (SELECT unnest(range(0, 7)) AS k), v AS (SELECT k::INT AS "window", 45.0::DOUBLE * k AS a, 45.0::DOUBLE * k + 60 AS b FROM s UNION ALL SELECT 7, 305, 365),
d AS (SELECT unnest(range(0, 366))::DOUBLE AS day), c AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY "window") AS n FROM d JOIN v ON day BETWEEN a AND b),
p AS (SELECT day, max(CASE WHEN n = 2 THEN a END) AS a2, max(CASE WHEN n = 1 THEN b END) AS b1 FROM c GROUP BY 1)
SELECT c.day, c."window", {r6('CASE WHEN a2 IS NULL THEN 1.0::DOUBLE WHEN n = 1 THEN 1 - (c.day - a2) / (b1 - a2) ELSE (c.day - a2) / (b1 - a2) END')} AS weight FROM c JOIN p USING (day) WHERE n <= 2""")
def miost_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covering windows and weights of each day of a year."""
    plan_ = miost.Windows(0.0, 365.0)
    rows = [(float(d), k, round(w, 6)) for d in range(366) for k, w in plan_.covering(d)]
    return spark.createDataFrame(rows, "day double, window int, weight double")


@query()
def tuned_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over two parameters: gate, score, rank."""
    obs = _thin(spark, sf_dir).cache()

    def batch(asked: list[dict]) -> list[dict[str, float]]:
        """All trials of a round in one plan: each one's report rows under its number."""
        parts = []
        for k, params in enumerate(asked):
            run = plan.Run("oi", GRID, (5.0,), params, half_window=0.5, withheld="purchase")
            withheld = obs.where("mission = 'purchase' AND abs(t - 5) < 1").select("seq", "lon", "lat", "sla")
            parts.append(plan.report_rows(spark, plan.run_single(obs, run), run, withheld).withColumn("trial", F.lit(k)))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        found = {r["trial"]: r["rmse"] for r in rows.groupBy("trial").agg(stats.rmse(F.col("value"), F.col("mean")).alias("rmse")).collect()}
        return [{"rmse": found[k]} if k in found else {} for k in range(len(asked))]

    found = search.tune({"length_scale": (50.0, 400.0), "variance": (0.01, 0.1)}, search.HaltonSearch(2), lambda p: search.bytes_feasible(p["length_scale"], 1e9), None, [search.Bar("rmse", "le", 10.0)], "rmse", batch=batch)
    obs.unpersist()
    return spark.createDataFrame([(t.id, round(t.params["length_scale"], 6), round(t.scores["rmse"], 6)) for t in found], "id int, length_scale double, rmse double")


@query()
def miost_window_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows solved once each, blended on the days that two of them cover."""
    run = plan.Run("miost", Grid.covering((295.0, 305.0), (33.0, 43.0), 2.0), (4.0, 14.0, 24.0), {"wavelengths": (800.0,), "members": 3}, withheld="purchase")
    return _moments(plan.window_maps(_daily(spark, sf_dir), run, miost.Windows(0.0, 30.0, 20.0, 10.0)))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One super-observation per two-degree cell and two days: a bounded number per window."""
    obs = _obs(spark, sf_dir)
    cell = obs.groupBy(F.floor(F.col("t") / 2).alias("day"), F.floor(F.col("lon") / 2).alias("cx"), F.floor(F.col("lat") / 2).alias("cy"))
    return cell.agg(F.min("seq").alias("seq"), F.lit("all").alias("mission"), *[F.avg(c).alias(c) for c in ("lon", "lat", "t", "sla")], F.first("err_var").alias("err_var")).drop("day", "cx", "cy")


@query()
def lattice_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of four tiles, conditioned along the spanning tree of overlaps and blended."""
    members = plan.lattice_members(_thin(spark, sf_dir), _run("gmrf"), TILES, 4)
    return rounded(members, "value")


@query(f"""WITH {OBS_SQL} SELECT mission, {r6("0.01::DOUBLE * exp(CASE mission WHEN 'view' THEN 0.5 WHEN 'click' THEN -0.25 ELSE 0 END)")} AS err_var, count(*) AS n FROM obs GROUP BY mission""")
def mission_error_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation-error variance by mission."""
    obs = observations(spark, sf_dir)
    deltas = {r[0]: {"view": 0.5, "click": -0.25}.get(r[0], 0.0) for r in obs.select("mission").distinct().collect()}
    return rounded(plan.mission_variance(obs, deltas, 0.01).groupBy("mission", "err_var").agg(F.count(F.lit(1)).alias("n")), "err_var")


_MODES = "m AS (SELECT d AS day, i / 1000.0::DOUBLE AS kx, j / 1000.0::DOUBLE AS ky, exp(-(i * i + j * j) / 50.0::DOUBLE) * (1 + 0.1 * d) + CASE WHEN i = j THEN 0.5 ELSE 0 END AS power FROM (SELECT unnest(range(0, 3)) AS d), (SELECT unnest(range(0, 21)) AS i), (SELECT unnest(range(-20, 21)) AS j))"


def _modes(spark: SparkSession) -> DataFrame:
    """Closed-form power of three days with a planted diagonal signature."""
    n = F.col("id")
    i, j, d = F.pmod(n, F.lit(21)), F.pmod(F.floor(n / 21), F.lit(41)) - 20, F.floor(n / (21 * 41))
    power = F.exp(-(i * i + j * j) / 50.0) * (1 + 0.1 * d) + F.when(i == j, 0.5).otherwise(0.0)
    return spark.range(3 * 21 * 41).select(d.alias("day"), (i / 1000.0).alias("kx"), (j / 1000.0).alias("ky"), power.alias("power"))


@query(f"""WITH {_MODES}, r AS (SELECT day, rint(sqrt(kx * kx + ky * ky) / 0.001)::INT AS ring, sum(power) AS power, count(*) AS n FROM m GROUP BY 1, 2) SELECT day, ring, {r6('power')} AS power, n FROM r""".replace("rint(", "round_even(").replace("/ 0.001)::INT", "/ 0.001::DOUBLE, 0)::INT"))
def ring_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power by ring of wavenumber."""
    from ..operators.evaluate import ring_table

    return rounded(ring_table(_modes(spark), 0.001), "power")


@query(f"""WITH {_MODES}, r AS (SELECT day, round_even(sqrt(kx * kx + ky * ky) / 0.001::DOUBLE, 0)::INT AS ring, sum(power) AS power, count(*) AS n FROM m GROUP BY 1, 2), b AS (SELECT day, ln(ring) AS x, ln(power / n) AS y, n::DOUBLE AS w FROM r WHERE ring BETWEEN 2 AND 10 AND power > 0),
s AS (SELECT (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) AS slope FROM b GROUP BY day)
SELECT {r6('quantile_cont(slope, 0.25)')} AS slope_q25, {r6('quantile_cont(slope, 0.5)')} AS slope, {r6('quantile_cont(slope, 0.75)')} AS slope_q75, count(*) AS n_days FROM s""")
def spectral_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-band log-log slope by weighted least squares, over days."""
    from ..operators.evaluate import ring_table, spectral_slope

    return rounded(spectral_slope(ring_table(_modes(spark), 0.001), 2, 10), "slope_q25", "slope", "slope_q75")


_OFF = "abs(((degrees(atan2(ky, kx)) - {a} + 90) % 180 + 180) % 180 - 90)"


@query(f"""WITH {_MODES}, k AS (SELECT *, sqrt(kx * kx + ky * ky) AS k FROM m), f(family, angle, k_lo, k_hi) AS (VALUES ('asc', 45.0::DOUBLE, 0.008::DOUBLE, 0.01::DOUBLE), ('desc', 135.0::DOUBLE, 0.008::DOUBLE, 0.01::DOUBLE)),
x AS (SELECT k.*, EXISTS (SELECT 1 FROM f WHERE {_OFF.format(a='angle')} <= 10 AND k >= k_lo - 0.0015 AND k <= k_hi + 0.0015) AS near_track FROM k),
p AS (SELECT f.*, w AS widening, greatest(k_lo - (1.5 + w) * 0.001, 0.0005) AS low, k_hi + (1.5 + w) * 0.001 AS high FROM f, (SELECT unnest(range(0, 4)) AS w)),
d AS (SELECT family, widening, day, avg(CASE WHEN {_OFF.format(a='angle')} <= 10 THEN power END) AS band, avg(CASE WHEN NOT near_track THEN power END) AS base, count(CASE WHEN {_OFF.format(a='angle')} <= 10 THEN 1 END) AS n_band, count(CASE WHEN NOT near_track THEN 1 END) AS n_base FROM x JOIN p ON k BETWEEN low AND high GROUP BY 1, 2, 3),
e AS (SELECT family, widening, quantile_cont(log10(band / base), 0.5) AS excess, max(n_band) AS n_band, max(n_base) AS n_base FROM d GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY widening) AS r FROM e WHERE n_base >= 20 OR widening = 3)
SELECT family, widening::INT AS widening, {r6('excess')} AS excess_log10, n_band, n_base, n_base < 20 AS under_floor FROM q WHERE r = 1""")
def ground_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track-signature excess per family: the planted diagonal is found, its mirror isn't."""
    from ..operators.evaluate import track_excess

    families = spark.createDataFrame([("asc", 45.0, 0.008, 0.01), ("desc", 135.0, 0.008, 0.01)], "family string, angle double, k_lo double, k_hi double")
    return rounded(track_excess(_modes(spark), families, 0.001), "excess_log10")


@query("WITH w(k, a, b) AS (VALUES (0, 0.0, 60.0), (1, 45.0, 105.0), (2, 90.0, 150.0)) SELECT d AS day, min(k)::INT AS \"window\" FROM (SELECT unnest(range(0, 151))::DOUBLE AS d), w WHERE d BETWEEN a AND b GROUP BY d HAVING count(*) = 1")
def exclusive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that one window covers alone."""
    from ..operators.evaluate import exclusive_days as exclusive

    return exclusive(miost.Windows(0.0, 150.0).all(), spark.range(151).select(F.col("id").cast("double").alias("day")))
