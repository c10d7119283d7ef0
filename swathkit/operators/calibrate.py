"""Variance calibration s(x): fields, likelihood sums, fitters and tables.

Fitters hold a handful of parameters on the driver; every likelihood, gradient and Hessian is one
aggregation over the points.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import clamp, real
from .splits import cell_index

#: Observation variance of the track, nominal coverage, median of chi-square with 1 degree.
TRACK_VARIANCE, NOMINAL, CHI2_MEDIAN = 0.0009, 0.6827, 0.4549


def unit(lon: Column, lat: Column) -> tuple[Column, Column]:
    """u, v in [-1, 1] over the box, clamped to it."""
    return clamp((lon - 300.0) / 5.0, -1, 1), clamp((lat - 38.0) / 5.0, -1, 1)


def scalar_log_s(a: float) -> Column:
    return real(a)


def polynomial_log_s(lon: Column, lat: Column, a: tuple[float, float, float, float, float], clip: tuple[float, float] = (-math.inf, math.inf)) -> Column:
    """a0 + a1 v + a2 v^2 + a3 u + a4 u v, clipped."""
    u, v = unit(lon, lat)
    raw = real(a[0]) + a[1] * v + a[2] * v * v + a[3] * u + a[4] * u * v
    return raw if clip == (-math.inf, math.inf) else clamp(raw, *clip)


def piecewise_log_s(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds log_s of each point's cell (ix, iy, log_s: 25 rows)."""
    ix, iy = cell_index(F.col("lon"), F.col("lat"))
    return points.withColumn("ix", ix).withColumn("iy", iy).join(F.broadcast(cells), ["ix", "iy"], "left").drop("ix", "iy")


def covariate_log_s(points: DataFrame, proxy: DataFrame, a: float, b: float, clip: tuple[float, float]) -> DataFrame:
    """Adds log_s = a + b log(proxy of the cell), clipped."""
    return piecewise_log_s(points, proxy.select("ix", "iy", clamp(a + b * F.log("proxy"), *clip).alias("log_s")))


def calibrated(rows: DataFrame) -> DataFrame:
    """Variance times s."""
    return rows.withColumn("var", F.exp("log_s") * F.col("var"))


def calibrated_covariance(cov: Column, log_sa: Column, log_sb: Column) -> Column:
    return F.exp((log_sa + log_sb) / 2) * cov


def calibrated_draw(mean: Column, draw: Column, log_s: Column) -> Column:
    return mean + F.exp(log_s / 2) * (draw - mean)


def _design(d: int) -> list[Column]:
    u, v = unit(F.col("lon"), F.col("lat"))
    return [F.lit(1.0), v, v * v, u, u * v][:d]


def likelihood_terms(points: DataFrame, theta: np.ndarray, obs_var: float = TRACK_VARIANCE) -> DataFrame:
    """One row: nll, and gradient g0.. and Fisher information h00.. of log s = theta . x."""
    x = _design(len(theta))
    log_s = sum((float(a) * c for a, c in zip(theta, x, strict=True)), F.lit(0.0))
    sv = F.exp(log_s) * F.col("v")
    rows = points.withColumn("_sv", sv).withColumn("_tot", F.col("_sv") + obs_var)
    r2 = F.pow("resid", 2)
    nll = F.sum(0.5 * (F.log("_tot") + r2 / F.col("_tot"))).alias("nll")
    w = 0.5 * F.col("_sv") / F.col("_tot") * (1 - r2 / F.col("_tot"))
    info = 0.5 * F.pow(F.col("_sv") / F.col("_tot"), 2)
    g = [F.sum(w * c).alias(f"g{i}") for i, c in enumerate(x)]
    h = [F.sum(info * x[i] * x[j]).alias(f"h{i}{j}") for i in range(len(x)) for j in range(i + 1)]
    return rows.agg(nll, *g, *h)


def fit_polynomial(points: DataFrame, d: int = 5, steps: int = 30, obs_var: float = TRACK_VARIANCE, tolerance: float = 1e-8, bound: float = 10.0) -> tuple[np.ndarray, float]:
    """Fisher scoring with halving, no coefficient moving by more than 1 in a step nor beyond ``bound``:
    each trial of a step is one aggregation of a few sums."""
    theta = np.zeros(d)
    row = likelihood_terms(points, theta, obs_var).first()
    for _ in range(steps):
        g = np.array([row[f"g{i}"] for i in range(d)])
        h = np.array([[row[f"h{max(i, j)}{min(i, j)}"] for j in range(d)] for i in range(d)])
        move = np.linalg.solve(h + 1e-9 * np.trace(h) * np.eye(d), g)
        move /= max(1.0, np.abs(move).max())
        scale = 1.0
        while scale > 1e-3:
            new = likelihood_terms(points, np.clip(theta - scale * move, -bound, bound), obs_var).first()
            if new["nll"] <= row["nll"]:
                break
            scale /= 2
        else:
            break
        done = row["nll"] - new["nll"] < tolerance * abs(row["nll"])
        theta, row = np.clip(theta - scale * move, -bound, bound), new
        if done:
            break
    return theta, row["nll"]


def fit_regions(points: DataFrame, steps: int = 15, obs_var: float = TRACK_VARIANCE) -> dict[str, float]:
    """log s of every region by Newton steps; one grouped aggregation serves all regions of a step."""
    spark = points.sparkSession
    now = {r[0]: 0.0 for r in points.select("label").distinct().collect()}  # five labels
    for _ in range(steps):
        table = spark.createDataFrame(list(now.items()), "label string, log_s double")
        sv = F.exp("log_s") * F.col("v")
        tot = sv + obs_var
        r2 = F.pow("resid", 2)
        share = sv / tot
        g = F.sum(0.5 * share * (1 - r2 / tot)).alias("g")
        h = F.sum(0.5 * share * share).alias("h")
        rows = points.join(F.broadcast(table), "label").groupBy("label").agg(g, h).collect()
        moves = {r["label"]: float(np.clip(r["g"] / max(r["h"], 1e-12), -1, 1)) for r in rows}
        now = {k: a - moves.get(k, 0.0) for k, a in now.items()}
        if max(map(abs, moves.values()), default=0) < 1e-9:
            break
    return now


#: Relative error of the ranks between which the exact median is then looked for.
_RANK = 1e-3


def exact_median(rows: DataFrame, value: Column) -> float | None:
    """The median without gathering all values: two approximate quantiles bracket it, the rows between them
    (a few thousandths) are then ranked exactly."""
    v = rows.select(value.alias("_v")).where("_v IS NOT NULL")
    bracket = F.approx_percentile("_v", [0.5 - 2 * _RANK, 0.5 + 2 * _RANK], int(1 / _RANK))
    n, ends = v.agg(F.count(F.lit(1)), bracket).first()
    if not n:
        return None
    low, high = (-math.inf, math.inf) if n < 1 / _RANK else ends
    inside = F.when((F.col("_v") >= low) & (F.col("_v") <= high), F.col("_v"))
    below, m = v.agg(F.count_if(F.col("_v") < low), F.count(inside)).first()
    return v.agg(F.percentile(inside, F.lit(((n - 1) / 2 - below) / max(m - 1, 1)))).first()[0]


def tail_diagnostic(points: DataFrame, s: float = 1.0, limit: float = 1.5) -> DataFrame:
    """Median of r^2 / (s v) over that of chi-square with one degree, and whether it is above the limit."""
    median = exact_median(points, F.pow("resid", 2) / (s * F.col("v")))
    ratio = F.lit(None).cast("double") if median is None else F.lit(median / CHI2_MEDIAN)
    return points.sparkSession.range(1).select(ratio.alias("ratio")).withColumn("flag", F.col("ratio") >= limit)


def lag_correlations(points: DataFrame, lags: int = 20) -> DataFrame:
    """lag, rho, pairs: autocorrelation of z along passes (day, pass_id; in the order of seq), weighted by pairs."""
    w = W.partitionBy("day", "pass_id").orderBy("seq")
    centred = points.withColumn("z", F.col("z") - F.avg("z").over(W.partitionBy("day", "pass_id")))
    products = centred.select(F.pow("z", 2).alias("z2"), *[(F.col("z") * F.lag("z", k).over(w)).alias(f"p{k}") for k in range(1, lags + 1)])
    one = products.agg(F.avg("z2").alias("var"), *[F.avg(f"p{k}").alias(f"a{k}") for k in range(1, lags + 1)], *[F.count(f"p{k}").alias(f"n{k}") for k in range(1, lags + 1)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"a{k}") / F.col("var")).alias("rho"), F.col(f"n{k}").alias("pairs")) for k in range(1, lags + 1)]))
    return one.select(rows.alias("r")).select("r.*")


def effective_n(n: Column, rho_sum: Column) -> Column:
    """n / (1 + 2 sum rho)."""
    return n / (1 + 2 * F.greatest(rho_sum, F.lit(0.0)))


def truncated_rho_sum(correlations: DataFrame, least: float = 0.05) -> DataFrame:
    """Sum of the correlations before the first that is below ``least``."""
    first = correlations.agg(F.min(F.when(F.col("rho") < least, F.col("lag"))).alias("stop"))
    return correlations.join(F.broadcast(first)).where(F.col("stop").isNull() | (F.col("lag") < F.col("stop"))).agg(F.coalesce(F.sum("rho"), F.lit(0.0)).alias("rho_sum"))


def coverage_by(points: DataFrame, *keys: str) -> DataFrame:
    """n, 1-sigma coverage, its deficit and reduced chi-square of (resid, s, v) by group."""
    tot = F.col("s") * F.col("v") + TRACK_VARIANCE
    inside = F.avg(F.when(F.abs("resid") <= F.sqrt(tot), 1.0).otherwise(0.0))
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), inside.alias("coverage"), F.abs(inside - NOMINAL).alias("deficit"), F.avg(F.pow("resid", 2) / tot).alias("chi2"))


def worst_region(table: DataFrame) -> DataFrame:
    return table.agg(F.max("deficit").alias("worst"), F.max_by("class", "deficit").alias("region"))


def clip_use(nodes: DataFrame, low: float, high: float) -> DataFrame:
    """Share of nodes at which the clip engages, and the largest excursion."""
    out = F.greatest(low - F.col("raw"), F.col("raw") - high, F.lit(0.0))
    return nodes.agg(F.avg(F.when(out > 0, 1.0).otherwise(0.0)).alias("share"), F.max(out).alias("excursion"))


def gradient_bound(nodes: DataFrame, step: float) -> DataFrame:
    """Largest central difference of log_s per degree on a regular grid (ix, iy)."""
    x, y = W.partitionBy("iy").orderBy("ix"), W.partitionBy("ix").orderBy("iy")
    gx = (F.lead("log_s").over(x) - F.lag("log_s").over(x)) / (2 * step)
    gy = (F.lead("log_s").over(y) - F.lag("log_s").over(y)) / (2 * step)
    return nodes.withColumn("gx", gx).withColumn("gy", gy).agg(F.max(F.sqrt(F.pow("gx", 2) + F.pow("gy", 2))).alias("bound"))


def select_lane(lanes: list[dict], band: float = 0.01) -> tuple[dict | None, list[dict]]:
    """Banded lexicographic choice over a few lanes: deficits worst first, then fewer parameters."""
    live = [x for x in lanes if x.get("valid", True)]
    audit = []
    for key in ("worst_region", "aggregate"):
        if not live:
            break
        best = min(x[key] for x in live)
        live = [x for x in live if x[key] <= best + band]
        audit.append({"stage": key, "best": best, "kept": [x["name"] for x in live]})
    live.sort(key=lambda x: (x["n_params"], x["name"]))
    return (live[0] if live else None), audit


def rescaled(calibration: dict, s: float) -> dict:
    """A scalar calibration composed with s; fields refuse."""
    if calibration["kind"] != "scalar":
        raise TypeError("only a scalar calibration can be rescaled")
    return {"kind": "scalar", "log_s": calibration["log_s"] + math.log(s)}


def standardised(points: DataFrame) -> DataFrame:
    """Adds z = resid / sqrt(s v + observation variance)."""
    return points.withColumn("z", F.col("resid") / F.sqrt(F.col("s") * F.col("v") + TRACK_VARIANCE))


def family_deficits(points: DataFrame, folds: DataFrame, lanes: dict[str, Column]) -> DataFrame:
    """Per lane: the worst coverage deficit over the regions, averaged over the folds' score sides.

    ``points``: resid, v and class; ``folds``: seq, fold, score. All lanes and folds are one aggregation.
    """
    scored = points.join(folds.where("score"), "seq")
    spread = scored.select("fold", "class", "resid", "v", F.explode(F.array(*[F.struct(F.lit(n).alias("lane"), c.alias("s")) for n, c in sorted(lanes.items())])).alias("l")).select("fold", "class", "resid", "v", "l.lane", "l.s")
    worst = coverage_by(spread, "lane", "fold", "class").groupBy("lane", "fold").agg(F.max("deficit").alias("worst"))
    return worst.groupBy("lane").agg(F.avg("worst").alias("worst_region"), F.count(F.lit(1)).alias("n_folds"))


def acceptance_bars(regions: dict[str, dict[str, float]], most_deficit: float = 0.05, chi2: tuple[float, float] = (0.8, 1.25)) -> dict[str, bool]:
    """Four bars: aggregate coverage and chi-square, worst region, and every region counted."""
    a = regions["aggregate"]
    return {"aggregate_coverage": abs(a["coverage"] - NOMINAL) <= most_deficit, "aggregate_chi2": chi2[0] <= a["chi2"] <= chi2[1], "worst_region": max(r["deficit"] for r in regions.values()) <= 2 * most_deficit, "all_counted": all(r["n"] > 0 for r in regions.values())}


def evidence(points: DataFrame, folds: DataFrame) -> dict:
    """Fit, select, refit and accept: lanes of growing freedom are scored on held-out folds, the winner is
    fitted again on all points, must beat the scalar likelihood, and is clipped around its own range."""
    u, v = unit(F.col("lon"), F.col("lat"))
    fits = {}
    for name, d in (("scalar", 1), ("quadratic", 3), ("poly", 5)):
        fits[name] = fit_polynomial(points, d)
    shapes = [F.lit(1.0), v, v * v, u, u * v]
    fields = {n: F.exp(sum((float(a) * c for a, c in zip(theta, shapes, strict=False)), F.lit(0.0))) for n, (theta, _) in fits.items()}
    deficits = {r["lane"]: r["worst_region"] for r in family_deficits(points, folds, fields).collect()}
    lanes = [{"name": n, "worst_region": deficits[n], "aggregate": 0.0, "n_params": len(fits[n][0]), "valid": fits[n][1] <= fits["scalar"][1]} for n in fits if n in deficits]
    winner, audit = select_lane(lanes)
    if winner is None:
        return {"winner": None, "audit": audit}
    rows = points.withColumn("s", fields[winner["name"]])
    table = {r["class"]: r.asDict() for r in coverage_by(rows, "class").collect()}
    table["aggregate"] = coverage_by(rows).first().asDict()
    low, high = rows.agg(F.min(F.log("s")), F.max(F.log("s"))).first()
    return {"winner": winner["name"], "theta": [float(x) for x in fits[winner["name"]][0]], "clip": (low - math.log(1.25), high + math.log(1.25)), "regions": table, "bars": acceptance_bars(table), "audit": audit}
