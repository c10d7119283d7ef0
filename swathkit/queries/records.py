"""Calibration at pairs, plans, gates, verdicts and records, over the observation view."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..kernels import coherent, spectra
from ..operators import blend, calibrate, evaluate, orbit, splits
from ..plans import reconstruct as plan
from ..plans import search
from ..registry import query
from ..sources import observations as src
from ..sources.cache import ContentCache
from ..sources.observations import OBS_SQL, observations
from .closed import _each
from .grids import _PAIRS, GRID, _pairs
from .scans import r6, rounded
from .scores import _CROSS, _DIRECTED, _PASSES, _POINTS, _points

_DAILY = "g AS (SELECT mission, floor(t)::BIGINT AS day, count(*) AS n, avg(sla) AS y, stddev_samp(sla) AS sd FROM obs GROUP BY 1, 2)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("mission", F.floor("t").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("sla").alias("y"), F.stddev_samp("sla").alias("sd"))


def _shared(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share; a local one only where none is named."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp()
    return f"{root.rstrip('/')}/{name}-{spark.sparkContext.applicationId}"


# Calibration of pairs, and what follows from it.
def _log_s(lat: str) -> str:
    v = f"(least(greatest(({lat} - 38) / 5, -1), 1))"
    return f"(0.1::DOUBLE + 0.2 * {v} - 0.1 * {v} * {v})"


@query(f"""WITH {OBS_SQL}, {_PAIRS}, l AS (SELECT *, {_log_s('lat1')} AS s1, {_log_s('lat2')} AS s2 FROM p)
SELECT i, {r6('exp((s1 + s2) / 2) * 0.05 * exp(-pow(lon1 - lon2, 2) - pow(lat1 - lat2, 2))')} AS cov, {r6('lat1 + exp(s1 / 2) * (lat2 - lat1)')} AS draw, {r6('s1 + ln(1.5::DOUBLE)')} AS rescaled FROM l""")
def calibrated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated covariances of neighbours, draws moved by s, and s composed with a scalar."""
    rows = _pairs(spark, sf_dir)
    s = [calibrate.polynomial_log_s(F.col(f"lon{k}"), F.col(f"lat{k}"), (0.1, 0.2, -0.1, 0.0, 0.0)) for k in (1, 2)]
    cov = 0.05 * F.exp(-F.pow(F.col("lon1") - F.col("lon2"), 2) - F.pow(F.col("lat1") - F.col("lat2"), 2))
    step = calibrate.rescaled({"kind": "scalar", "log_s": 0.0}, 1.5)["log_s"]
    out = rows.select("i", calibrate.calibrated_covariance(cov, *s).alias("cov"), calibrate.calibrated_draw(F.col("lat1"), F.col("lat2"), s[0]).alias("draw"), (s[0] + step).alias("rescaled"))
    return rounded(out, "cov", "draw", "rescaled")


@query(f"WITH {OBS_SQL}, {_DAILY} SELECT mission, bool_and(0.05 * (1 - exp(-n / 10.0::DOUBLE)) >= 0.9 * 0.05) AS relaxes FROM g GROUP BY mission")
def prior_relaxation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a variance comes near the prior's everywhere, per mission."""
    rows = _daily(spark, sf_dir).withColumn("var", 0.05 * (1 - F.exp(-F.col("n") / 10.0)))
    parts = [evaluate.relaxes_to_prior(rows.where(F.col("mission") == m), 0.05, 0.9).withColumn("mission", F.lit(m)) for m in sorted(r[0] for r in rows.select("mission").distinct().collect())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {OBS_SQL}, {_POINTS}, c AS (SELECT *, z - avg(z) OVER (PARTITION BY day, pass_id) AS q FROM x), l AS (SELECT unnest(range(1, 21)) AS lag), v AS (SELECT avg(q * q) AS var FROM c),
r AS (SELECT day, pass_id, q, row_number() OVER (PARTITION BY day, pass_id ORDER BY seq) AS k FROM c),
rho AS (SELECT lag, avg(a.q * b.q) / any_value(var) AS rho FROM r a JOIN r b ON a.day = b.day AND a.pass_id = b.pass_id JOIN l ON a.k = b.k + lag, v GROUP BY lag),
s AS (SELECT coalesce(min(lag) FILTER (rho < 0.05), 99) AS stop FROM rho), t AS (SELECT coalesce(sum(rho), 0) AS rho_sum FROM rho, s WHERE lag < stop)
SELECT {r6('rho_sum')} AS rho_sum, {r6('(SELECT count(*) FROM x) / (1 + 2 * greatest(rho_sum, 0))')} AS n_eff FROM t""")
def effective_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the correlations along passes before the first small one, and the effective number of points."""
    points = _points(spark, sf_dir)
    total = calibrate.truncated_rho_sum(calibrate.lag_correlations(points).where("pairs > 0"))
    n = points.agg(F.count(F.lit(1)).alias("n"))
    return rounded(total.join(n).select("rho_sum", calibrate.effective_n(F.col("n"), F.col("rho_sum")).alias("n_eff")), "rho_sum", "n_eff")


_TOTAL = "(s * v + 0.0009)"


@query(f"""WITH {OBS_SQL}, {_POINTS}, m AS (SELECT *, ((day // 5) % 12 + 1)::INT AS month FROM x), f AS (SELECT m.*, kind, s FROM m, (VALUES ('fitted', 1.1::DOUBLE), ('unit', 1.0::DOUBLE)) k(kind, s))
SELECT kind, month, count(*) AS n, {r6(f'avg(CASE WHEN abs(resid) <= sqrt{_TOTAL} THEN 1.0::DOUBLE ELSE 0 END)')} AS coverage, {r6(f'avg(pow(resid, 2) / {_TOTAL})')} AS chi2 FROM f GROUP BY 1, 2""")
def monthly_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and chi-square by month, for two scales."""
    points = _points(spark, sf_dir).withColumn("month", (F.floor(F.col("day") / 5) % 12 + 1).cast("int"))
    both = points.select("*", F.explode(F.array(F.struct(F.lit("fitted").alias("kind"), F.lit(1.1).alias("s")), F.struct(F.lit("unit").alias("kind"), F.lit(1.0).alias("s")))).alias("k")).select("*", "k.kind", "k.s")
    return rounded(calibrate.coverage_by(both, "kind", "month").drop("deficit"), "coverage", "chi2")


@query(f"""WITH {OBS_SQL}, {_POINTS}, c AS (SELECT seq, resid, v, CASE WHEN lat < 38 THEN 'south' ELSE 'north' END AS class, ((day // 5) % 12 // 2)::INT AS fold FROM x), l AS (SELECT c.*, lane, s FROM c, (VALUES ('a', 0.9::DOUBLE), ('b', 1.2::DOUBLE)) k(lane, s)),
d AS (SELECT lane, fold, class, abs(avg(CASE WHEN abs(resid) <= sqrt{_TOTAL} THEN 1.0::DOUBLE ELSE 0 END) - 0.6827) AS deficit FROM l GROUP BY 1, 2, 3), w AS (SELECT lane, fold, max(deficit) AS worst FROM d GROUP BY 1, 2)
SELECT lane, {r6('avg(worst)')} AS worst_region, count(*) AS n_folds FROM w GROUP BY lane""")
def lane_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst regional deficit of two lanes over held-out folds."""
    points = _points(spark, sf_dir).withColumn("class", F.when(F.col("lat") < 38, "south").otherwise("north"))
    folds = splits.month_folds(points.select("seq", (F.floor(F.col("day") / 5) % 12 + 1).cast("int").alias("month"))).select("seq", "fold", "score")
    return rounded(calibrate.family_deficits(points, folds, {"a": F.lit(0.9), "b": F.lit(1.2)}), "worst_region")


# Ensembles.
@query(f"""WITH {OBS_SQL}, {_DAILY}, k AS (SELECT mission, day, n + 1 AS m, 1 + (day % 5) AS factor, 0.1037::DOUBLE + 0.01 * day AS sigma, 0.05::DOUBLE + 0.001 * n AS interior FROM g)
SELECT mission, day, {r6('sqrt(2.0::DOUBLE / (m - 1)) * exp(lgamma(m / 2.0::DOUBLE) - lgamma((m - 1) / 2.0::DOUBLE))')} AS expected, (floor(pow(factor * sigma / interior, 2)) + 2)::BIGINT AS least, factor * sigma / sqrt(m - 1.0::DOUBLE) < interior AS reachable FROM k""")
def member_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected deviation of m members, the members that a clean verdict needs, and whether it can be reached."""

    def one(r: dict) -> list[dict]:
        m, factor, sigma, interior = int(r["n"]) + 1, 1 + int(r["day"]) % 5, 0.1037 + 0.01 * r["day"], 0.05 + 0.001 * r["n"]
        return [{"mission": r["mission"], "day": r["day"], "expected": evaluate.expected_ratio(m), "least": evaluate.least_members(factor, sigma, interior), "reachable": evaluate.clean_reachable(factor, sigma / (m - 1) ** 0.5, interior)}]

    return rounded(_each(_daily(spark, sf_dir), one, "mission string, day long, expected double, least long, reachable boolean"), "expected")


@query(f"""WITH {OBS_SQL}, p AS (SELECT seq, floor(lon - 295) AS tile, (floor(lat - 33) * 10 + floor(lon - 295))::BIGINT AS node_id FROM obs), m AS (SELECT (floor(lat - 33) * 10 + floor(lon - 295))::BIGINT AS node_id, mission AS tile, avg(sla) AS mean, avg(err_var) AS var FROM obs GROUP BY 1, 2)
SELECT seq AS point, m.tile, {r6('mean')} AS mean, {r6('sqrt(var)')} AS sigma FROM p JOIN m USING (node_id)""")
def constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of every part at the node of each point."""
    node = (F.floor(F.col("lat") - 33) * 10 + F.floor(F.col("lon") - 295)).alias("node_id")
    obs = observations(spark, sf_dir)
    parts = obs.groupBy(node, F.col("mission").alias("tile")).agg(F.avg("sla").alias("mean"), F.avg("err_var").alias("var"))
    return rounded(evaluate.constituent_moments(parts, obs.select(F.col("seq").alias("point"), node)), "mean", "sigma")


@query(f"""WITH RECURSIVE {OBS_SQL}, n AS (SELECT (least(greatest(ceil(lat - 33 - 0.5), 0), 10))::INT AS iy, (least(greatest(ceil(lon - 295 - 0.5), 0), 10))::INT AS ix, count(*) AS n FROM obs GROUP BY 1, 2),
m AS (SELECT iy * 11 + ix AS id, iy, ix FROM n WHERE n >= (SELECT quantile_disc(n, 0.55) FROM n)),
r AS (SELECT id AS a, id AS b FROM m UNION SELECT r.a, q.id FROM r JOIN m p ON p.id = r.b JOIN m q ON abs(p.iy - q.iy) + abs(p.ix - q.ix) = 1),
c AS (SELECT b AS id, min(a) AS root FROM r GROUP BY 1), s AS (SELECT root, count(*) AS size FROM c GROUP BY 1), best AS (SELECT root FROM s ORDER BY size DESC, root LIMIT 1)
SELECT id::BIGINT AS node_id FROM c JOIN best USING (root)""")
def largest_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest 4-connected part of the nodes with many observations, the first of equals."""
    import numpy as np

    counts = GRID.nodes(spark).select("node_id").join(splits_nodes(spark, sf_dir), "node_id", "left").fillna(0, ["n"]).orderBy("node_id").toPandas()  # a grid's nodes: 121
    n = counts["n"].to_numpy()
    held = np.sort(n[n > 0])
    limit = held[int(np.ceil(0.55 * len(held))) - 1]
    part = splits.largest_component(((n >= limit) & (n > 0)).reshape(11, 11))
    return spark.createDataFrame([(int(k),) for k in np.flatnonzero(part)], "node_id long")


def splits_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id and n: observations by their nearest node."""
    return observations(spark, sf_dir).groupBy(GRID.node_id(F.col("lon"), F.col("lat")).alias("node_id")).agg(F.count(F.lit(1)).alias("n"))


# Plans.
@query("""WITH h AS (SELECT 3 * 120.0::DOUBLE AS halo), i AS (SELECT unnest(range(0, 6)) AS i), j AS (SELECT unnest(range(0, 3)) AS j),
m AS (SELECT j * 6 + i AS tile, -180 + 60.0::DOUBLE * i AS west, -180 + 60.0::DOUBLE * (i + 1) AS east, -60 + 40.0::DOUBLE * j AS south, -60 + 40.0::DOUBLE * (j + 1) AS north FROM i, j),
a AS (SELECT *, halo / (111.195 * cos(radians(greatest(abs(south), abs(north))))) AS halo_lon, halo / 111.195 AS halo_lat FROM m, h
  UNION ALL SELECT 18, -180, 180, 60, 90, halo, 0, halo / 111.195 FROM h UNION ALL SELECT 19, -180, 180, -90, -60, halo, 0, halo / 111.195 FROM h)
SELECT tile::INT AS tile, """ + ", ".join(f"{r6(c)} AS {c}" for c in ("west", "east", "south", "north", "halo_lon", "halo_lat")) + " FROM a")
def polar_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid-latitude tiles between two caps, with halos of three correlation lengths."""
    tiles = blend.mixed_tiles((-180.0, 180.0), 6, 3, 60.0, blend.halo_km(120.0, 3.0, 50.0))
    return rounded(blend.tile_table(spark, tiles).drop("missing"), "west", "east", "south", "north", "halo_lon", "halo_lat")


@query("""SELECT * FROM (VALUES ('driver', 'low_rank', 'shared_basis_field'), ('driver', 'precision', 'tree_members'), ('driver', 'none', 'independent'), ('driver', 'other', 'independent'),
('route', 'linear EXACT', 'covariance'), ('route', 'linear LOW_RANK', 'covariance'), ('route', 'linear SAMPLES', 'sample'), ('route', 'other EXACT', 'sample'),
('transform', 'BLENDED', 'perfect-correlation crossfade'), ('transform', 'DEGRADED_COHERENCE', 'independent draws per tile'), ('methods', 'oi,gmrf,fem,miost,trivial', '5'), ('shipped', 'miost', 'alg,h2g,j2g,j2n,j3,s3a'),
('reduction', 'oi', 'low_rank'), ('reduction', 'gmrf', 'precision'), ('reduction', 'fem', 'precision'), ('reduction', 'miost', 'empirical'), ('reduction', 'trivial', 'empirical')) v(kind, name, value)""")
def plan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What plans choose and record: drivers of members, routes of derived fields, transforms, methods."""
    rows = [("driver", k, coherent.select_driver(k)) for k in ("low_rank", "precision", "none", "other")]
    rows += [("route", f"{'linear' if lin else 'other'} {f}", evaluate.route(lin, f)) for lin, f in ((True, "EXACT"), (True, "LOW_RANK"), (True, "SAMPLES"), (False, "EXACT"))]
    rows += [("transform", t["kind"], t["bias"]) for t in (blend.blend_transform(0.5, 0.01, True), blend.degradation_transform())]
    rows += [("shipped", k, ",".join(v["missions"])) for k, v in plan.SHIPPED.items()] + [("reduction", m, plan.select_reduction(m)) for m in plan.METHODS]
    return spark.createDataFrame([*rows, ("methods", ",".join(plan.METHODS), str(len(plan.METHODS)))], "kind string, name string, value string")


_KX = "m AS (SELECT seq, (seq % 97) / 970.0::DOUBLE AS kx, (seq % 89 - 44) / 890.0::DOUBLE AS ky FROM obs)"


@query(f"""WITH {OBS_SQL}, {_KX} SELECT seq, sqrt(kx * kx + ky * ky) BETWEEN 0.0201 AND 0.0599 AS annulus,
abs(((degrees(atan2(ky, kx)) - 30.3 + 90) % 180 + 180) % 180 - 90) <= 12 AND sqrt(kx * kx + ky * ky) BETWEEN 0.0201 AND 0.0599 AS wedge FROM m""")
def mode_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes in a ring, and those of them near an axis."""
    modes = observations(spark, sf_dir).select("seq", ((F.col("seq") % 97) / 970.0).alias("kx"), ((F.col("seq") % 89 - 44) / 890.0).alias("ky"))

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            kx, ky = pdf["kx"].to_numpy(), pdf["ky"].to_numpy()
            yield pd.DataFrame({"seq": pdf["seq"], "annulus": spectra.annulus(kx, ky, 0.0201, 0.0599), "wedge": spectra.wedge(kx, ky, 30.3, 12.0, 0.0201, 0.0599)})

    return modes.mapInPandas(run, "seq long, annulus boolean, wedge boolean")


# Gates and verdicts.
@query(f"""WITH {OBS_SQL}, {_DAILY} SELECT mission, day, (day % 3 = 0 OR 1 + n % 4 <= 1) AS coherent, CASE WHEN day % 3 = 0 OR 1 + n % 4 <= 1 THEN '' ELSE 'joint [''SAMPLES''] over ' || (1 + n % 4) || ' tiles' END AS reason,
n * 100.0::DOUBLE <= 2000 AS fits, n <= 15 AND abs(y) <= 0.4 AS authorized, CASE WHEN abs(y - 0.3) > 0.1 THEN CASE WHEN y > 0.3 THEN 'a' ELSE 'b' END WHEN day % 2 = 0 AND abs(n - 10.5) > 3 THEN CASE WHEN n < 10.5 THEN 'a' ELSE 'b' END ELSE 'tie' END AS winner FROM g""")
def gates_and_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feasibility of joint products and of sizes, spend checks, and the winner of two lanes."""

    def one(r: dict) -> list[dict]:
        n, day = int(r["n"]), int(r["day"])
        ok, reason = search.coherence_feasible(1 + n % 4, set() if day % 3 == 0 else {"SAMPLES", "MEAN"})
        winner, _ = search.adjudicate(r["y"] - 0.3, 0.1, n - 10.5 if day % 2 == 0 else None, 3.0)
        spend, _ = search.authorize({"hours": float(n), "level": abs(r["y"])}, {"hours": 15.0, "level": 0.4})
        return [{"mission": r["mission"], "day": day, "coherent": ok, "reason": reason, "fits": search.bytes_feasible(n * 100.0, 2000.0)[0], "authorized": spend, "winner": winner}]

    return _each(_daily(spark, sf_dir), one, "mission string, day long, coherent boolean, reason string, fits boolean, authorized boolean, winner string")


@query(f"WITH {OBS_SQL}, {_DAILY}, e AS (SELECT (1 + day % 5)::INT AS n_tiles, abs(y) AS e FROM g) SELECT n_tiles, {r6('max(e)')} AS worst, max(e) <= 0.5 AS feasible FROM e GROUP BY 1")
def coherence_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst pair error by number of tiles."""
    errors: dict[int, list[float]] = {}
    for r in _daily(spark, sf_dir).groupBy((1 + F.col("day") % 5).cast("int").alias("n_tiles")).agg(F.collect_list(F.abs("y")).alias("e")).collect():  # an error per mission and day
        errors[r["n_tiles"]] = r["e"]
    return rounded(search.frontier(spark, errors), "worst")


_RECORDS = "t AS (SELECT (row_number() OVER (ORDER BY day, mission))::INT AS id, round(abs(y), 4) AS mu, n::DOUBLE AS lambda_x, 0.6::DOUBLE + 0.01 * (day % 20) AS cov FROM g)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.orderBy("day", "mission"))  # a row per mission and day
    return _daily(spark, sf_dir).select(place.alias("id"), F.round(F.abs("y"), 4).alias("mu"), F.col("n").cast("double").alias("lambda_x"), (0.6 + 0.01 * (F.col("day") % 20)).cast("double").alias("cov"))


@query(f"WITH {OBS_SQL}, {_DAILY}, {_RECORDS} SELECT id, (row_number() OVER (ORDER BY lambda_x, mu DESC, id))::INT AS place FROM t")
def lexicographic_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials in the order of two scores."""
    scores = F.create_map(F.lit("lambda_x"), F.col("lambda_x"), F.lit("mu"), F.col("mu"))
    return search.lexicographic(_records(spark, sf_dir).select("id", scores.alias("scores")), [("lambda_x", True), ("mu", False)]).select("id", "place")


@query(f"""WITH {OBS_SQL}, {_DAILY}, {_RECORDS}, a AS (SELECT * FROM t WHERE abs(mu - (SELECT max(mu) FROM t)) <= 0.1), b AS (SELECT * FROM a WHERE abs(lambda_x - (SELECT min(lambda_x) FROM a)) <= 2),
v AS (SELECT * FROM t WHERE 1 - mu <= (SELECT min(1 - mu) FROM t) + 0.05), w AS (SELECT * FROM v WHERE cov <= (SELECT min(cov) FROM v) + 0.05)
SELECT (SELECT min(id) FROM b) AS banded, (SELECT count(*) FROM a) AS kept_1, (SELECT count(*) FROM b) AS kept_2, (SELECT lpad(id::VARCHAR, 4, '0') FROM w ORDER BY id % 3, id LIMIT 1) AS lane""")
def banded_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential reduction within bands, of trials and of calibration lanes."""
    rows = [r.asDict() for r in _records(spark, sf_dir).orderBy("id").collect()]  # a row per mission and day
    winner, audit = search.banded_winner(rows, [("mu", False, 0.1), ("lambda_x", True, 2.0)])
    lanes = [{"name": f"{r['id']:04d}", "worst_region": 1 - r["mu"], "aggregate": r["cov"], "n_params": r["id"] % 3} for r in rows]
    lane, _ = calibrate.select_lane(lanes, 0.05)
    return spark.createDataFrame([(winner["id"], len(audit[0]["kept"]), len(audit[1]["kept"]), lane["name"])], "banded int, kept_1 long, kept_2 long, lane string")


@query(f"""WITH {OBS_SQL}, {_DAILY}, k AS (SELECT *, day % 2 = 0 AS has_a, day % 3 = 0 AS b_text FROM g)
SELECT mission, day, concat_ws(', ', CASE WHEN NOT has_a THEN 'missing a' END, CASE WHEN b_text THEN 'b isn''t float' END) AS refusals FROM k""")
def gate_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a gate's record lacks, or has of a wrong type."""

    def one(r: dict) -> list[dict]:
        block = {"b": "x" if r["day"] % 3 == 0 else 1.0} | ({"a": 1} if r["day"] % 2 == 0 else {})
        return [{"mission": r["mission"], "day": r["day"], "refusals": ", ".join(search.gate_refusals(block, {"a": int, "b": float}))}]

    return _each(_daily(spark, sf_dir), one, "mission string, day long, refusals string")


@query(f"""WITH {OBS_SQL}, g AS (SELECT floor(t)::BIGINT AS day, seq, mission, t, row_number() OVER (PARTITION BY mission ORDER BY t, seq) AS k FROM obs),
n AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR (t - lag(t) OVER w) * 86400 > 7200 OR floor(t) <> floor(lag(t) OVER w) THEN 1 ELSE 0 END AS fresh FROM g WINDOW w AS (PARTITION BY mission ORDER BY t, seq)),
s AS (SELECT mission, sum(fresh) OVER (PARTITION BY mission ORDER BY t, seq) AS segment, seq, t FROM n)
SELECT mission, segment::BIGINT AS segment, count(*) AS n, min(seq) AS first_seq FROM s GROUP BY 1, 2""")
def bootstrap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that blocks of a bootstrap may not leave: cut at gaps of two hours and where the day changes."""
    rows = search.segments(observations(spark, sf_dir), 7200.0)
    return rows.groupBy("mission", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query(f"""WITH {OBS_SQL}, e AS (SELECT mission, sla, 0.5 * sla AS mean, 0.04::DOUBLE AS var FROM obs), s AS (SELECT mission, 1 - sqrt(avg(pow(sla - mean, 2))) / sqrt(avg(sla * sla)) AS mu, avg(CASE WHEN abs(sla - mean) <= sqrt(var) THEN 1.0::DOUBLE ELSE 0 END) AS cov, count(*) AS n FROM e GROUP BY 1)
SELECT mission, {r6('mu')} AS mu, {r6('cov')} AS coverage, CASE WHEN mu >= 0.4 AND n % 2 = 0 THEN 100.0::DOUBLE + n END AS lambda_x FROM s""")
def stage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a stage: resolution is asked for only where the skill passes its bar."""
    obs = observations(spark, sf_dir).select("mission", F.col("sla").alias("value"), (0.5 * F.col("sla")).alias("mean"), F.lit(0.04).alias("var"))
    rows = []
    for (m,) in sorted(obs.select("mission").distinct().collect()):
        track = obs.where(F.col("mission") == m)
        n = track.count()
        s = search.assemble_scores(track, lambda rows, n=n: 100.0 + n if n % 2 == 0 else None, mu_bar=0.4)
        rows.append((m, s["mu"], s["coverage"], s.get("lambda_x")))
    return rounded(spark.createDataFrame(rows, "mission string, mu double, coverage double, lambda_x double"), "mu", "coverage")


# Sources and records.
@query("""WITH d AS (SELECT event_type AS mission, sha256(ts::DATE::VARCHAR) AS sha FROM events GROUP BY event_type, ts::DATE)
SELECT mission, sha256('{"files":["' || string_agg(sha, '","' ORDER BY sha) || '"],"source_id":"' || mission || '","version":"v1"}') AS manifest FROM d GROUP BY mission""")
def manifest_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of each mission's source, from the digests of its daily files."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    files = events.select(F.col("event_type").alias("mission"), F.sha2(F.col("ts").cast("date").cast("string").cast("binary"), 256).alias("sha")).groupBy("mission").agg(F.collect_set("sha").alias("shas"))
    return _each(files, lambda r: [{"mission": r["mission"], "manifest": src.SourceDescriptor(r["mission"], "v1", tuple(r["shas"])).manifest_sha()}], "mission string, manifest string")


@query("SELECT n_nationkey::INT AS id, n_nationkey * 1.5::DOUBLE AS lat, n_nationkey * 2.25::DOUBLE AS lon, n_name AS name FROM nation")
def gauge_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A station list in the catalogue's format, written and read."""
    path, k = _shared(spark, "stations"), F.col("n_nationkey")
    lines = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.format_string("%d; %.4f; %.4f; %s; %d; %d", k.cast("int"), k * F.lit(1.5), k * F.lit(2.25), "n_name", F.lit(10), k.cast("int")).alias("line"))
    lines.write.mode("overwrite").text(path)
    return src.gauge_catalogue(spark, path).select("id", "lat", "lon", "name")


@query("""WITH h AS (SELECT event_type AS gauge_id, ts::DATE AS day, value * 10 AS mm FROM events), d AS (SELECT gauge_id, day, avg(mm) / 1000 AS level FROM h GROUP BY 1, 2 HAVING count(*) >= 12)
SELECT day::VARCHAR AS day, round(level, 6) + 0.0::DOUBLE AS level_m FROM d WHERE gauge_id = 'click'""")
def gauge_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of one gauge, others being locked."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    daily = src.gauge_daily(events.select(F.col("event_type").alias("gauge_id"), F.col("ts").cast("date").alias("day"), (F.col("value") * 10).alias("mm")))
    return rounded(src.load_gauge(daily, "click", {"purchase"}).select(F.col("day").cast("string").alias("day"), "level_m"), "level_m")


@query(f"""WITH {OBS_SQL}, m AS (SELECT floor(t)::INT AS day, floor(lat)::DOUBLE AS lat, floor(lon)::DOUBLE AS lon, avg(sla) AS ssh FROM obs WHERE mission <> 'purchase' GROUP BY 1, 2, 3)
SELECT day, lat, lon, {r6('ssh')} AS ssh, (SELECT count(DISTINCT mission) FROM obs WHERE mission <> 'purchase')::INT AS n_assimilated, true AS refused FROM m""")
def map_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily maps with the missions that went into them; scoring one of those is refused, the withheld one passes."""
    obs = observations(spark, sf_dir).where("mission <> 'purchase'")
    missions = tuple(sorted(r[0] for r in obs.select("mission").distinct().collect()))
    path = _shared(spark, "maps")
    src.write_map(obs.groupBy(F.floor("t").alias("day"), F.floor("lat").cast("double").alias("lat"), F.floor("lon").cast("double").alias("lon")).agg(F.avg("sla").alias("ssh")), path, missions)
    maps = spark.read.parquet(path)
    src.assert_scored_not_assimilated(maps, "purchase")
    try:
        src.assert_scored_not_assimilated(maps, missions[0])
        refused = False
    except PermissionError:
        refused = True
    return rounded(maps.select("day", "lat", "lon", "ssh", F.size("assimilated").alias("n_assimilated"), F.lit(refused).alias("refused")), "ssh")


_KEY = """sha256('{"length":{"a":[0.1,0.3],"form":"exp_quad"},"variance":0.05}')"""


@query(f"WITH {OBS_SQL} SELECT seq, 0.05::DOUBLE AS variance, {r6('exp(0.1 + 0.3 * ((least(greatest(lat, 33), 43) - 38) / 5))')} AS length, {_KEY} AS provider_key FROM obs")
def parameter_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant and latitude-varying parameters at each observation, and a key that doesn't depend on their order."""
    provider = plan.Provider({"variance": 0.05}, {"length": ("exp_quad", (0.1, 0.3))})
    obs = observations(spark, sf_dir)
    return rounded(obs.select("seq", provider.at("variance", F.col("lat")).alias("variance"), provider.at("length", F.col("lat")).alias("length"), F.lit(provider.key()).alias("provider_key")), "length")


@query(f"WITH {OBS_SQL} SELECT seq FROM obs WHERE abs(t - 12) <= 2.5 AND lon BETWEEN 296 AND 304 AND lat BETWEEN 34 AND 42 AND mission <> 'purchase'")
def window_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations of a unit: within its window in time and space, the withheld mission left out."""
    obs = observations(spark, sf_dir)
    box = geo.in_range("lon", 296, 304) & geo.in_range("lat", 34, 42) & (F.abs(F.col("t") - 12) <= 2.5)
    return obs.where(box & (F.col("mission") != "purchase")).select("seq")


@query(f"""WITH {OBS_SQL}, {_POINTS}, l AS (SELECT resid, CASE WHEN lat < 38 THEN CASE WHEN lon < 300 THEN 'SW' ELSE 'SE' END ELSE CASE WHEN lon < 300 THEN 'NW' ELSE 'NE' END END AS label FROM x)
SELECT label, round(ln((avg(resid * resid) - 0.0009) / 0.01), 4) + 0.0::DOUBLE AS log_s FROM l GROUP BY 1 UNION ALL SELECT 'all', round(ln((avg(resid * resid) - 0.0009) / 0.01), 4) + 0.0::DOUBLE FROM l""")
def constant_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of log s where the variance is one constant, whose maximum has a closed form: four regions by Newton
    steps, and all points by the polynomial fit of degree 0."""
    points = _points(spark, sf_dir).withColumn("v", F.lit(0.01)).withColumn("label", F.when(F.col("lat") < 38, F.when(F.col("lon") < 300, "SW").otherwise("SE")).otherwise(F.when(F.col("lon") < 300, "NW").otherwise("NE")))
    fits = calibrate.fit_regions(points, steps=40) | {"all": float(calibrate.fit_polynomial(points, 1, steps=40, tolerance=1e-13)[0][0])}
    return spark.createDataFrame(sorted((k, round(v, 4) + 0.0) for k, v in fits.items()), "label string, log_s double")


@query(f"""WITH {OBS_SQL}, {_POINTS}, c AS (SELECT CASE WHEN lat < 38 THEN 'south' ELSE 'north' END AS class, resid, 1.1::DOUBLE * v + 0.0009 AS tot FROM x),
r AS (SELECT class, count(*) AS n, avg(CASE WHEN abs(resid) <= sqrt(tot) THEN 1.0::DOUBLE ELSE 0 END) AS cov, avg(resid * resid / tot) AS chi2 FROM c GROUP BY ROLLUP (class)),
a AS (SELECT max(CASE WHEN class IS NULL THEN cov END) AS cov, max(CASE WHEN class IS NULL THEN chi2 END) AS chi2, max(abs(cov - 0.6827)) AS worst, min(n) AS n FROM r)
SELECT abs(cov - 0.6827) <= 0.05 AS aggregate_coverage, chi2 BETWEEN 0.8 AND 1.25 AS aggregate_chi2, worst <= 0.1 AS worst_region, n > 0 AS all_counted FROM a""")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a calibration passes its four bars."""
    rows = _points(spark, sf_dir).withColumn("s", F.lit(1.1)).withColumn("class", F.when(F.col("lat") < 38, "south").otherwise("north"))
    table = {r["class"]: r.asDict() for r in calibrate.coverage_by(rows, "class").collect()} | {"aggregate": calibrate.coverage_by(rows).first().asDict()}
    bars = calibrate.acceptance_bars(table)
    return spark.createDataFrame([tuple(bool(v) for v in bars.values())], ", ".join(f"{k} boolean" for k in bars))


@query(f"""WITH {OBS_SQL}, {_PASSES}, {_DIRECTED}, {_CROSS},
h AS (SELECT mission, ascending, count(*) AS n_passes, avg(sin(a)) AS s, avg(cos(a)) AS c FROM (SELECT mission, ascending, pass_id, atan2(2 * covar_pop(lon * 111.32 * cos(radians(38.0::DOUBLE)), lat * 111.32), var_pop(lon * 111.32 * cos(radians(38.0::DOUBLE))) - var_pop(lat * 111.32)) AS a FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN crossing - lag(crossing) OVER w <= 0.05 THEN 0 ELSE 1 END AS fresh FROM d WINDOW w AS (PARTITION BY mission, ascending ORDER BY crossing)),
r AS (SELECT mission, ascending, count(*) AS n_crossings, sum(fresh)::BIGINT AS n_clusters FROM n GROUP BY 1, 2)
SELECT mission, ascending, n_passes, round(((90 - degrees(atan2(s, c)) / 2) % 180 + 180) % 180, 4) + 0.0::DOUBLE AS heading_deg, n_crossings, n_clusters FROM h LEFT JOIN r USING (mission, ascending)""")
def mission_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes, headings and clusters of crossings per mission and direction, in one row."""
    passes = orbit.split_passes(observations(spark, sf_dir), 600.0)
    found = orbit.crossings(passes, 38.0, (295.0, 305.0))
    rows = orbit.headings(passes, 38.0).join(orbit.classify_orbits(found, 0.05).select("mission", "ascending", "n_crossings", "n_clusters"), ["mission", "ascending"], "left")
    return rows.withColumn("heading_deg", F.round("heading_deg", 4) + 0.0)


@query("SELECT DISTINCT event_type AS mission, sha256('record of ' || event_type) AS seal, 1 AS opened, true AS refused FROM events")
def sealed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write-once digests, and locked data that opens once with a grant and not without."""
    import tempfile

    rows = []
    with tempfile.TemporaryDirectory() as folder:  # the driver's own records, not the data
        for (mission,) in sorted(observations(spark, sf_dir).select("mission").distinct().collect()):
            seal = search.write_seal(f"record of {mission}", f"{folder}/{mission}")
            touch = search.LockedTouch(mission, True)
            with touch:
                pass
            try:
                with touch:
                    refused = False
            except PermissionError:
                refused = True
            try:
                search.write_seal("another record", f"{folder}/{mission}")
                refused = False
            except FileExistsError:
                pass
            rows.append((mission, seal, len(touch.ledger), refused))
    return spark.createDataFrame(rows, "mission string, seal string, opened int, refused boolean")


@query("""SELECT n_name AS name, '/cache/' || substr(sha256('https://data.example/' || n_name || '.nc'), 1, 16) || '-' || n_name || '.nc' AS path FROM nation""")
def cache_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a content cache keeps what it was asked for."""
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"))
    return _each(names, lambda r: [{"name": r["name"], "path": ContentCache("/cache").path(f"https://data.example/{r['name']}.nc")}], "name string, path string")


@query(f"""WITH {OBS_SQL} SELECT seq, {r6('sla')} AS sla, {r6('sin(radians(floor(lon)))')} AS truth FROM obs WHERE lon BETWEEN 297 AND 303 AND lat BETWEEN 35 AND 41 AND t BETWEEN 4 AND 9""")
def osse_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source with a known truth: observations of a box, and the truth at them."""
    source = src.OsseSource(observations(spark, sf_dir), F.sin(F.radians(F.floor("lon"))))
    return rounded(source.truth(source.window((297, 303), (35, 41), (4, 9))).select("seq", "sla", "truth"), "sla", "truth")


@query(f"WITH {OBS_SQL} SELECT seq, {r6('lon')} AS lon, {r6('lat')} AS lat, 5.0::DOUBLE AS t FROM obs WHERE mission = 'purchase'")
def prepared_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a run is evaluated: the withheld mission's places, at the first output time."""
    _, points = plan.prepared(observations(spark, sf_dir), plan.Run("oi", GRID, (5.0, 15.0), withheld="purchase"))
    return rounded(points.select("seq", "lon", "lat", "t"), "lon", "lat")


@query(f"""WITH {OBS_SQL}, e AS (SELECT mission, sla AS y, 0.5 * sla AS m, 0.04::DOUBLE AS v FROM obs)
SELECT mission, {r6('sqrt(avg(pow(y - m, 2)))')} AS rmse, {r6('avg(pow(y - m, 2) / v)')} AS reduced_chi2, {r6('avg(CASE WHEN abs(y - m) <= 0.2 THEN 1.0::DOUBLE ELSE 0 END)')} AS coverage_1sigma, {r6('avg(y)')} AS mu_score, 'accuracy,calibration,skill,last' AS applicable FROM e GROUP BY mission""")
def evaluator_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluators that apply, and their merged metrics: a later one with the same name takes the earlier one's place."""
    registry = evaluate.default_registry()
    registry.evaluators += [("last", {"withheld"}, {"mu_score": F.avg("value")}), ("spectrum", {"track"}, {"rmse": F.lit(0.0)})]
    obs, rows = observations(spark, sf_dir).select("mission", F.col("sla").alias("value"), (0.5 * F.col("sla")).alias("mean"), F.lit(0.04).alias("var")), []
    for (m,) in sorted(obs.select("mission").distinct().collect()):
        found = registry.run(obs.where(F.col("mission") == m), {"withheld", "variance"})
        rows.append((m, found["rmse"], found["reduced_chi2"], found["coverage_1sigma"], found["mu_score"], ",".join(registry.applicable({"withheld", "variance"}))))
    return rounded(spark.createDataFrame(rows, "mission string, rmse double, reduced_chi2 double, coverage_1sigma double, mu_score double, applicable string"), "rmse", "reduced_chi2", "coverage_1sigma", "mu_score")


@query(f"""WITH {OBS_SQL}, k AS (SELECT unnest(range(0, 4))::INT AS tile), p AS (SELECT tile, t, sla, 0.5 * sla AS m FROM obs JOIN k ON lon BETWEEN 295 + 5 * (tile % 2) AND 300 + 5 * (tile % 2) AND lat BETWEEN 33 + 5 * (tile // 2) AND 38 + 5 * (tile // 2)),
d AS (SELECT tile, floor(t) AS day, 1 - sqrt(avg(pow(sla - m, 2))) / sqrt(avg(sla * sla)) AS s FROM p GROUP BY 1, 2)
SELECT tile, {r6('avg(s)')} AS mu, {r6('stddev_pop(s)')} AS sigma, count(*) AS n_days FROM d GROUP BY tile UNION ALL SELECT -1, NULL, NULL, 0""")
def tile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily skill inside the cores of four tiles; a core without points is refused."""
    track = observations(spark, sf_dir).select("t", "lon", "lat", F.col("sla").alias("value"), (0.5 * F.col("sla")).alias("mean"))
    rows = []
    for t in blend.lonlat_tiles((295.0, 305.0), (33.0, 43.0), 2, 2, 0.0):
        s = evaluate.score_tile(track, t.west, t.east, t.south, t.north)
        rows.append((t.tile, s["mu"], s["sigma"], s["n_days"]))
    try:
        evaluate.score_tile(track, 0.0, 1.0, 0.0, 1.0)
    except ValueError:
        rows.append((-1, None, None, 0))
    return rounded(spark.createDataFrame(rows, "tile int, mu double, sigma double, n_days long"), "mu", "sigma")
