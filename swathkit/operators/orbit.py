"""Passes, headings, crossings and orbit classes."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import ORBIT_KM_PER_DEGREE, haversine_km
from .ordered import beside, running

GAP_SECONDS = 60.0
#: Cluster tolerance in degrees, and the ratios that decide and that refuse.
REPEAT_MOST, DRIFT_LEAST = 0.25, 0.431


def segment_passes(obs: DataFrame, gap_seconds: float = GAP_SECONDS) -> DataFrame:
    """Adds pass_id: sessions of a mission, a new one after a gap of strictly more than ``gap_seconds``."""
    day, order = F.floor("t"), ["t", "seq"]
    before = beside(obs, ["mission"], day, order, ["t"])
    fresh = F.coalesce(((F.col("t") - F.col("_prev.t")) * 86400.0 > gap_seconds).cast("int"), F.lit(1))
    marked = before.withColumn("_new", fresh).drop("_prev", "_next")
    return running(marked, ["mission"], day, order, F.col("_new"), "pass_id").drop("_new", "_all")


def arc_coordinate(passes: DataFrame) -> DataFrame:
    """Adds arc_km (cumulative great-circle distance along the pass) and s in [-1, 1]."""
    w = W.partitionBy("mission", "pass_id").orderBy("t", "seq")
    step = F.coalesce(haversine_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0))
    arc = passes.withColumn("_step", step).withColumn("arc_km", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_step")
    length = F.max("arc_km").over(W.partitionBy("mission", "pass_id"))
    return arc.withColumn("s", F.when(length > 0, 2 * F.col("arc_km") / length - 1).otherwise(0.0))


def bias_tilt(passes: DataFrame) -> DataFrame:
    """Two error-mode rows (column, value) for each observation: its pass's bias and tilt."""
    modes = F.explode(F.array(F.struct(F.lit("bias").alias("mode"), F.lit(1.0).alias("value")), F.struct(F.lit("tilt").alias("mode"), F.col("s").alias("value"))))
    return passes.select("seq", "mission", "pass_id", modes.alias("m")).select("seq", "mission", "pass_id", "m.mode", "m.value")


def split_passes(obs: DataFrame, gap_seconds: float = GAP_SECONDS) -> DataFrame:
    """Passes of at least two points, with ``ascending`` by the median sign of latitude steps."""
    p = segment_passes(obs, gap_seconds)
    w = W.partitionBy("mission", "pass_id").orderBy("t", "seq")
    steps = p.withColumn("_sign", F.signum(F.lead("lat").over(w) - F.col("lat")))
    kinds = steps.groupBy("mission", "pass_id").agg(F.count(F.lit(1)).alias("n"), (F.percentile("_sign", F.lit(0.5)) > 0).alias("ascending")).where("n >= 2")
    return p.join(kinds.select("mission", "pass_id", "ascending"), ["mission", "pass_id"])


def headings(passes: DataFrame, phi0: float) -> DataFrame:
    """Heading from north in degrees per mission and direction: total least squares of each pass, averaged by doubled angles."""
    x = F.col("lon") * ORBIT_KM_PER_DEGREE * math.cos(math.radians(phi0))
    y = F.col("lat") * ORBIT_KM_PER_DEGREE
    cov = passes.withColumn("x", x).withColumn("y", y).groupBy("mission", "ascending", "pass_id").agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    doubled = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))  # twice the direction of the larger eigenvector, from east
    mean = cov.withColumn("a", doubled).groupBy("mission", "ascending").agg(F.count(F.lit(1)).alias("n_passes"), F.avg(F.cos("a")).alias("c"), F.avg(F.sin("a")).alias("s"))
    return mean.select("mission", "ascending", "n_passes", F.pmod(90.0 - F.degrees(F.atan2("s", "c")) / 2, F.lit(180.0)).alias("heading_deg"))


def crossings(passes: DataFrame, phi0: float, lon: tuple[float, float]) -> DataFrame:
    """Interpolated longitude at which a pass crosses latitude phi0, inside the domain."""
    w = W.partitionBy("mission", "pass_id").orderBy("t", "seq")
    pairs = passes.withColumn("lat2", F.lead("lat").over(w)).withColumn("lon2", F.lead("lon").over(w))
    between = pairs.where((F.col("lat2") != F.col("lat")) & (F.least("lat", "lat2") <= phi0) & (F.greatest("lat", "lat2") > phi0))
    at = F.col("lon") + (phi0 - F.col("lat")) / (F.col("lat2") - F.col("lat")) * (F.col("lon2") - F.col("lon"))
    return between.select("mission", "ascending", "pass_id", at.alias("crossing")).where((F.col("crossing") >= lon[0]) & (F.col("crossing") <= lon[1]))


def _clusters(found: DataFrame, tolerance: float) -> DataFrame:
    """Adds _new: whether a crossing is further than ``tolerance`` from the one west of it; blocks are degrees."""
    keys, order = ["mission", "ascending"], ["crossing", "pass_id"]
    west = beside(found, keys, F.floor("crossing"), order, ["crossing"])
    fresh = F.coalesce(((F.col("crossing") - F.col("_prev.crossing")) > tolerance).cast("int"), F.lit(1))
    return west.withColumn("_new", fresh).drop("_prev", "_next")


def classify_orbits(found: DataFrame, tolerance: float) -> DataFrame:
    """Single-linkage clusters of crossings: few clusters per crossing mean a repeat orbit; between the two limits the class is refused."""
    ratios = _clusters(found, tolerance).groupBy("mission", "ascending").agg(F.count(F.lit(1)).alias("n_crossings"), F.sum("_new").alias("n_clusters"))
    ratio = F.col("n_clusters") / F.col("n_crossings")
    kind = F.when(ratio <= REPEAT_MOST, "repeat").when(ratio >= DRIFT_LEAST, "drifting").otherwise("refused")
    return ratios.withColumn("ratio", ratio).withColumn("orbit_class", kind)


def families(found: DataFrame, tolerance: float, phi0: float) -> DataFrame:
    """Spacing of the clusters of crossings, in kilometres: median and quantiles."""
    keys = ["mission", "ascending"]
    runs = running(_clusters(found, tolerance), keys, F.floor("crossing"), ["crossing", "pass_id"], F.col("_new"), "cluster")
    centres = runs.groupBy(*keys, "cluster").agg(F.avg("crossing").alias("centre"))
    spaced = beside(centres, keys, F.floor("centre"), ["centre", "cluster"], ["centre"])
    gap = (F.col("_next.centre") - F.col("centre")) * ORBIT_KM_PER_DEGREE * math.cos(math.radians(phi0))
    q = [F.percentile("gap", F.lit(x)).alias(n) for n, x in (("q10_km", 0.1), ("s_lon_km", 0.5), ("q90_km", 0.9))]
    return spaced.withColumn("gap", gap).where(F.col("gap").isNotNull()).groupBy(*keys).agg(*q, F.count(F.lit(1)).alias("n_gaps"))


def geometry(obs: DataFrame, phi0: float, lon: tuple[float, float], tolerance: float = 0.05, locked: tuple[str, ...] = ("c2", "c2n")) -> DataFrame:
    """A row per mission and direction: passes, heading, crossings, class and spacings. Locked missions refuse."""
    if obs.where(F.col("mission").isin(*locked)).limit(1).count():
        raise PermissionError("a locked mission has no orbit geometry")
    passes = split_passes(obs)
    found = crossings(passes, phi0, lon)
    keys = ["mission", "ascending"]
    return headings(passes, phi0).join(classify_orbits(found, tolerance), keys, "left").join(families(found, tolerance, phi0), keys, "left")


def geometry_artifact(rows: DataFrame) -> str:
    """Deterministic JSON of the geometry table (a few rows per mission)."""
    out: dict = {}
    for r in rows.collect():
        out.setdefault(r["mission"], {})["asc" if r["ascending"] else "desc"] = {k: v for k, v in r.asDict().items() if k not in ("mission", "ascending")}
    return json.dumps({"missions": out}, sort_keys=True, separators=(",", ":"))
