"""Scores of products against withheld observations, truth, gauges and neighbours."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.geo import in_range

#: Seam verdict limits, days of the climatology's boxcar.
CLEAN_MOST, ELEVATED_MOST, BOXCAR = 1.0, 2.5, 15


def accuracy(rows: DataFrame) -> DataFrame:
    """RMSE of (value, mean)."""
    return rows.agg(stats.rmse(F.col("value"), F.col("mean")).alias("rmse"))


def calibration(rows: DataFrame) -> DataFrame:
    m, v, y = F.col("mean"), F.col("var"), F.col("value")
    return rows.agg(stats.reduced_chi2(m, v, y).alias("reduced_chi2"), stats.coverage(m, v, y).alias("coverage_1sigma"), F.avg(stats.crps_gaussian(m, v, y)).alias("crps"))


def mu_score(rows: DataFrame) -> DataFrame:
    return rows.agg(stats.skill(F.col("value"), F.col("mean")).alias("mu_score"))


def area_mean(rows: DataFrame, value: str = "value", area: str = "area_m2") -> DataFrame:
    return rows.agg((F.sum(F.col(area) * F.col(value)) / F.sum(area)).alias("area_mean"))


def area_rmse(rows: DataFrame, error: str = "error", area: str = "area_m2") -> DataFrame:
    return rows.agg(F.sqrt(F.sum(F.col(area) * F.pow(error, 2)) / F.sum(area)).alias("area_rmse"))


def relaxes_to_prior(rows: DataFrame, prior: float, share: float) -> DataFrame:
    """Whether variance in a void comes near the prior's."""
    return rows.agg(F.min(F.col("var") >= share * prior).alias("relaxes"))


def report(rows: DataFrame, available: set[str], evaluators: dict[str, tuple[set[str], list[Column]]]) -> DataFrame:
    """A row per evaluator: its metrics, or a visible skip row when the context lacks what it needs.

    All metrics of the applicable evaluators come from one aggregation.
    """
    flat = [m.alias(f"{name}.{k}") for name, (need, ms) in evaluators.items() if need <= available for k, m in enumerate(ms)]
    one = rows.agg(*flat) if flat else rows.sparkSession.range(1)
    out = []
    for name, (need, ms) in sorted(evaluators.items()):
        if need <= available:
            values = F.map_from_arrays(F.array(*[F.lit(f"metric_{k}") for k in range(len(ms))]), F.array(*[F.col(f"`{name}.{k}`") for k in range(len(ms))]))
            out.append(F.struct(F.lit(name).alias("evaluator"), values.alias("metrics"), F.lit("").alias("skipped")))
        else:
            lacks = ",".join(sorted(need - available))
            out.append(F.struct(F.lit(name).alias("evaluator"), F.create_map().cast("map<string,double>").alias("metrics"), F.lit(f"needs {lacks}").alias("skipped")))
    return one.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def applicable(evaluators: dict[str, set[str]], available: set[str]) -> list[str]:
    return [name for name, need in evaluators.items() if need <= available]


@dataclass
class Registry:
    """Evaluators in order: a name, what they need, and named aggregates."""

    evaluators: list[tuple[str, set[str], dict[str, Column]]] = field(default_factory=list)

    def applicable(self, available: set[str]) -> list[str]:
        return [name for name, need, _ in self.evaluators if need <= available]

    def run(self, rows: DataFrame, available: set[str]) -> dict[str, float]:
        """All metrics of the applicable evaluators in one aggregation; of two metrics of one name the later holds."""
        merged: dict[str, Column] = {}
        for _, need, metrics in self.evaluators:
            if need <= available:
                merged |= metrics
        return rows.agg(*[m.alias(k) for k, m in merged.items()]).first().asDict() if merged else {}


def default_registry() -> Registry:
    """Every evaluator of rows (value, mean, var) that needs no spectrum."""
    y, m, v = F.col("value"), F.col("mean"), F.col("var")
    return Registry([
        ("accuracy", {"withheld"}, {"rmse": stats.rmse(y, m)}),
        ("calibration", {"withheld", "variance"}, {"reduced_chi2": stats.reduced_chi2(m, v, y), "coverage_1sigma": stats.coverage(m, v, y), "crps": F.avg(stats.crps_gaussian(m, v, y))}),
        ("skill", {"withheld"}, {"mu_score": stats.skill(y, m)}),
    ])


def score_tile(track: DataFrame, west: float, east: float, south: float, north: float) -> dict[str, float]:
    """Daily skill inside a tile's core; a core without a point is refused."""
    inside = track.where(in_range("lon", west, east) & in_range("lat", south, north))
    row = leaderboard(inside).first()
    if not row["n_days"]:
        raise ValueError("no point of the track lies in the tile's core")
    return row.asDict()


# Gauges.
def climatology_null(series: DataFrame) -> DataFrame:
    """Day-of-year mean (day 366 as 365) smoothed by a circular 15-day boxcar, for each row of (gauge_id, day, value)."""
    doy = F.least(F.dayofyear("day"), F.lit(365))
    keyed = series.withColumn("doy", doy)
    means = keyed.groupBy("gauge_id", "doy").agg(F.avg("value").alias("m"))
    half = BOXCAR // 2
    spread = means.select("gauge_id", "m", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("k"), F.col("doy").alias("d0")).withColumn("doy", (F.pmod(F.col("d0") + F.col("k") - 1, F.lit(365)) + 1).cast("int"))
    smooth = spread.groupBy("gauge_id", "doy").agg(F.avg("m").alias("null_climo"))
    return keyed.join(smooth, ["gauge_id", "doy"]).drop("doy")


def persistence_null(series: DataFrame) -> DataFrame:
    """The value of the day before, null where that day is missing."""
    before = series.select("gauge_id", F.date_add("day", 1).alias("day"), F.col("value").alias("null_persist"))
    return series.join(before, ["gauge_id", "day"], "left")


def gauge_rows(pairs: DataFrame) -> DataFrame:
    """Per gauge with at least two common days: demeaned correlation and RMSE, and the RMSEs of both nulls.

    ``pairs``: gauge_id, day, value (gauge), mapped.
    """
    base = persistence_null(climatology_null(pairs.select("gauge_id", "day", "value", "mapped")))
    w = W.partitionBy("gauge_id")
    d = base.withColumn("g", F.col("value") - F.avg("value").over(w)).withColumn("m", F.col("mapped") - F.avg("mapped").over(w))
    rows = d.groupBy("gauge_id").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.corr("g", "m").alias("corr"),
        stats.rmse(F.col("g"), F.col("m")).alias("rmse"),
        stats.rmse(F.col("value"), F.col("null_climo")).alias("rmse_climo"),
        stats.rmse(F.col("value"), F.col("null_persist")).alias("rmse_persist"),
    )
    rows = rows.where("n_days >= 2")
    return rows.withColumn("reduction_climo", 1 - F.col("rmse") / F.col("rmse_climo")).withColumn("reduction_persist", 1 - F.col("rmse") / F.col("rmse_persist"))


def gauge_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_gauges"), F.avg("corr").alias("corr"), F.avg("rmse").alias("rmse"))


# Seams.
def seam_delta(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """RMS difference of two fields at common nodes, pairs with a null or NaN dropped."""
    pairs = a.select(*keys, F.col("value").alias("va")).join(b.select(*keys, F.col("value").alias("vb")), keys)
    good = pairs.where(~F.isnan("va") & ~F.isnan("vb"))
    return good.agg(stats.rmse(F.col("va"), F.col("vb")).alias("seam_delta"), F.count(F.lit(1)).alias("n"))


def increment_rms(field: DataFrame, along: str, across: str) -> DataFrame:
    """RMS of the differences of neighbours along an axis."""
    step = F.lead("value").over(W.partitionBy(across).orderBy(along)) - F.col("value")
    return field.withColumn("_d", step).agg(F.sqrt(F.avg(F.pow("_d", 2))).alias("increment_rms"))


def seam_verdict(ratio: Column) -> Column:
    return F.when(ratio <= CLEAN_MOST, "CLEAN").when(ratio <= ELEVATED_MOST, "ELEVATED").otherwise("STRUCTURAL_STOP")


def ensemble_floor(sigma: Column, members: int) -> Column:
    return sigma / math.sqrt(members - 1)


def clean_reachable(factor: float, floor: float, interior: float, clean_most: float = CLEAN_MOST) -> bool:
    return factor * floor < clean_most * interior


def least_members(factor: float, sigma: float, interior: float, clean_most: float = CLEAN_MOST) -> int:
    """Smallest ensemble with a reachable CLEAN verdict."""
    m = max(2, math.floor((factor * sigma / (clean_most * interior)) ** 2) + 1)
    while not clean_reachable(factor, sigma / math.sqrt(m - 1), interior, clean_most):
        m += 1
    while m > 2 and clean_reachable(factor, sigma / math.sqrt(m - 2), interior, clean_most):
        m -= 1
    return m


def expected_ratio(m: int) -> float:
    """E[s] / sigma of a standard deviation from m normal members."""
    return math.sqrt(2 / (m - 1)) * math.exp(math.lgamma(m / 2) - math.lgamma((m - 1) / 2))


def settling(members: DataFrame, partitions: DataFrame) -> DataFrame:
    """Per partition: RMS over nodes of the difference of its two sides' standard deviations, over the floor.

    ``members``: node_id, member, value; ``partitions``: part, side (0 or 1), member.
    """
    sides = members.join(partitions, "member").groupBy("part", "node_id", "side").agg(F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).alias("m"))
    both = sides.groupBy("part", "node_id").agg(F.max(F.when(F.col("side") == 0, F.col("sd"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("sd"))).alias("b"), F.max("m").alias("m"))
    level = F.sqrt(F.avg((F.pow("a", 2) + F.pow("b", 2)) / 2))
    return both.groupBy("part").agg((F.sqrt(F.avg(F.pow(F.col("a") - F.col("b"), 2))) / (level / F.sqrt(F.max("m") - 1.0))).alias("ratio"))


def binned_scores(track: DataFrame, degrees: float = 1.0) -> DataFrame:
    """nRMSE score per cell of a track (lon, lat, value, mean), for mu (mean over cells) and sigma (their deviation)."""
    cell = track.groupBy(F.floor(F.col("lon") / degrees).alias("cx"), F.floor(F.col("lat") / degrees).alias("cy")).agg(stats.skill(F.col("value"), F.col("mean")).alias("score"), F.count(F.lit(1)).alias("n"))
    return cell


def leaderboard(track: DataFrame) -> DataFrame:
    """mu: skill of each day averaged; sigma: its deviation."""
    daily = track.groupBy(F.floor("t").alias("day")).agg(stats.skill(F.col("value"), F.col("mean")).alias("s"))
    return daily.agg(F.avg("s").alias("mu"), F.stddev_pop("s").alias("sigma"), F.count(F.lit(1)).alias("n_days"))


# Ground tracks and map spectra, over a table of modes (day, kx, ky, power).
#: Wedge half width in degrees and bins, fewest baseline modes, most widenings.
TRACK_DEGREES, TRACK_BINS, TRACK_MODES, TRACK_WIDENINGS = 10.0, 1.5, 20, 3


def _axial_offset(angle: Column) -> Column:
    """Degrees between a mode's direction and an axis."""
    return F.abs(F.pmod(F.degrees(F.atan2("ky", "kx")) - angle + 90, F.lit(180.0)) - 90)


def track_excess(modes: DataFrame, families: DataFrame, dk: float) -> DataFrame:
    """log10 of the mean power in each family's wedge over that of the same ring outside all wedges:
    the median over days, with the numbers of modes, the widenings and a flag for too few modes.

    ``families``: family, angle (degrees from east of the probe direction), k_lo, k_hi. The table has a
    few rows per mission, the widths a few rows each; both are the known small side of the joins.
    """
    spark = modes.sparkSession
    widths = spark.createDataFrame([(w,) for w in range(TRACK_WIDENINGS + 1)], "widening int")
    plans = families.join(F.broadcast(widths)).withColumn("low", F.greatest(F.col("k_lo") - (TRACK_BINS + F.col("widening")) * dk, F.lit(0.5 * dk))).withColumn("high", F.col("k_hi") + (TRACK_BINS + F.col("widening")) * dk)
    wedges = families.agg(F.collect_list(F.struct("angle", (F.col("k_lo") - TRACK_BINS * dk).alias("low"), (F.col("k_hi") + TRACK_BINS * dk).alias("high"))).alias("wedges"))
    k = F.sqrt(F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky"))
    marked = modes.withColumn("k", k).join(F.broadcast(wedges)).withColumn("near_track", F.exists("wedges", lambda w: (_axial_offset(w["angle"]) <= TRACK_DEGREES) & (F.col("k") >= w["low"]) & (F.col("k") <= w["high"]))).drop("wedges")
    rows = marked.join(F.broadcast(plans), (F.col("k") >= F.col("low")) & (F.col("k") <= F.col("high")))
    band = _axial_offset(F.col("angle")) <= TRACK_DEGREES
    daily = rows.groupBy("family", "widening", "day").agg(F.avg(F.when(band, F.col("power"))).alias("band"), F.avg(F.when(~F.col("near_track"), F.col("power"))).alias("base"), F.count(F.when(band, 1)).alias("n_band"), F.count(F.when(~F.col("near_track"), 1)).alias("n_base"))
    every = daily.groupBy("family", "widening").agg(F.percentile(F.log10(F.col("band") / F.col("base")), F.lit(0.5)).alias("excess_log10"), F.max("n_band").alias("n_band"), F.max("n_base").alias("n_base"))
    enough = (F.col("n_base") >= TRACK_MODES) | (F.col("widening") == TRACK_WIDENINGS)
    first = F.row_number().over(W.partitionBy("family").orderBy("widening"))
    return every.where(enough).withColumn("_k", first).where("_k = 1").drop("_k").withColumn("under_floor", F.col("n_base") < TRACK_MODES)


def ring_table(modes: DataFrame, dk: float) -> DataFrame:
    """Power and number of modes per day and ring."""
    k = F.sqrt(F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky"))
    return modes.groupBy("day", F.rint(k / dk).cast("int").alias("ring")).agg(F.sum("power").alias("power"), F.count(F.lit(1)).alias("n"))


def spectral_slope(rings: DataFrame, low: int, high: int) -> DataFrame:
    """Weighted log-log slope of the rings low to high of each day, its median and quartiles over days."""
    x, y, w = F.log("ring"), F.log(F.col("power") / F.col("n")), F.col("n").cast("double")
    band = rings.where((F.col("ring") >= low) & (F.col("ring") <= high) & (F.col("power") > 0)).select("day", x.alias("x"), y.alias("y"), w.alias("w"))
    sums = band.groupBy("day").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("sxy"))
    slope = (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx"))
    days = sums.select("day", slope.alias("slope"))
    return days.agg(*[F.percentile("slope", F.lit(q)).alias(n) for n, q in (("slope_q25", 0.25), ("slope", 0.5), ("slope_q75", 0.75))], F.count(F.lit(1)).alias("n_days"))


def exclusive_days(windows: list[tuple[float, float]], days: DataFrame) -> DataFrame:
    """Days that one window alone covers."""
    spark = days.sparkSession
    table = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(windows)], "window int, w0 double, w1 double")
    held = days.join(F.broadcast(table), (F.col("day") >= F.col("w0")) & (F.col("day") <= F.col("w1")))
    return held.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min("window").alias("window")).where("n = 1").drop("n")


def constituent_moments(parts: DataFrame, points: DataFrame) -> DataFrame:
    """Mean and deviation of every tile at each point's node: parts (tile, node_id, mean, var), points (point, node_id)."""
    return points.join(parts, "node_id").select("point", "tile", "mean", F.sqrt("var").alias("sigma"))


def route(linear: bool, fidelity: str) -> str:
    """How a derived field gets its variance: linear ones by covariance where it is stored, others by samples."""
    return "covariance" if linear and fidelity in ("EXACT", "LOW_RANK") else "sample"
