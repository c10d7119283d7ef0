"""Along-track observations: scans with bounds, generators, thinning, gauges, sinks.

The canonical schema is (seq long, mission string, lon, lat, t, sla, err_var double), t being days
since the source's epoch. Bounds and mission lists are ordinary filters, so that they reach the
Parquet scan; sources written by ``write_observations`` are partitioned by mission and day, so that
they prune files as well.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import in_range, real
from ..operators.ordered import running

MICROS_PER_DAY = 86_400_000_000
#: Numbers of seq in a stretch that one task orders.
ORDERED_ROWS = 1 << 16
#: Missions of the challenge in canonical order, and those that no loader may open.
CHALLENGE_MISSIONS = ("alg", "h2g", "j2g", "j2n", "j3", "s3a")
LOCKED_MISSIONS = ("c2", "c2n")
NOISE_VARIANCE, MAPPING_VARIANCE = 0.01, 0.0025


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation view of the ``events`` table: scattered positions in a box of 10 by 10 degrees."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    return from_events(events)


def from_events(events: DataFrame) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (F.hour("ts") * 3600 + F.minute("ts") * 60).cast("long")
    micros = day * MICROS_PER_DAY + seconds * 1_000_000 + F.expr("CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT)")
    e = F.col("event_id")
    return events.select(
        e.alias("seq"),
        F.col("event_type").alias("mission"),
        (295.0 + F.pmod(e * 7919, F.lit(10007)).cast("double") * 10.0 / 10007.0).alias("lon"),
        (33.0 + F.pmod(e * 104729, F.lit(10009)).cast("double") * 10.0 / 10009.0).alias("lat"),
        (micros.cast("double") / float(MICROS_PER_DAY) - 19723.0).alias("t"),
        (F.col("value") / 100.0).alias("sla"),
        F.lit(NOISE_VARIANCE).alias("err_var"),
    )


#: The same view in SQL; queries begin with it.
OBS_SQL = """obs AS (SELECT event_id AS seq, event_type AS mission, 295.0::DOUBLE + ((event_id * 7919) % 10007)::DOUBLE * 10 / 10007 AS lon,
  33.0::DOUBLE + ((event_id * 104729) % 10009)::DOUBLE * 10 / 10009 AS lat, epoch_us(ts)::DOUBLE / 86400000000 - 19723 AS t, value / 100 AS sla, 0.01::DOUBLE AS err_var FROM events)"""


def box_window(obs: DataFrame, lon: tuple[float, float], lat: tuple[float, float], time: tuple[float, float], noise: float | None = None) -> DataFrame:
    """Scan of a box in space and time, inclusive at all six bounds; a constant noise variance may be attached."""
    out = obs.where(in_range("lon", *lon) & in_range("lat", *lat) & in_range("t", *time))
    return out if noise is None else out.withColumn("err_var", real(noise))


def withheld(obs: DataFrame, mission: str = "c2") -> DataFrame:
    """Locations and values of the withheld mission."""
    return obs.where(F.col("mission") == mission).select("lon", "lat", "t", "sla")


@dataclass(frozen=True)
class SourceDescriptor:
    """Identity of a source: its manifest digest depends on names, version and file digests only."""

    source_id: str
    version: str
    file_shas: tuple[str, ...]

    def manifest_sha(self) -> str:
        body = {"files": sorted(self.file_shas), "source_id": self.source_id, "version": self.version}
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class OsseSource:
    """Observations of a simulated ocean whose true field is known: an expression of lon, lat and t."""

    obs: DataFrame
    field: Column

    def window(self, lon: tuple[float, float], lat: tuple[float, float], time: tuple[float, float]) -> DataFrame:
        return box_window(self.obs, lon, lat, time)

    def truth(self, points: DataFrame) -> DataFrame:
        """Adds the true value at each point."""
        return points.withColumn("truth", self.field)


class AlongTrackSource:
    """Loader with a fixed list of missions: box, half-open times, finite values, mission refusals."""

    def __init__(self, obs: DataFrame, missions: tuple[str, ...], locked: tuple[str, ...] = LOCKED_MISSIONS, wrap_longitude: bool = False) -> None:
        self.obs, self.missions, self.locked, self.wrap = obs, missions, locked, wrap_longitude

    def check(self, missions: tuple[str, ...] | None) -> tuple[str, ...]:
        asked = self.missions if missions is None else missions
        if refused := [m for m in asked if m in self.locked]:
            raise PermissionError(f"locked missions: {refused}")
        if unknown := [m for m in asked if m not in self.missions]:
            raise ValueError(f"unknown missions: {unknown}")
        return tuple(m for m in self.missions if m in asked)

    def load(self, lon: tuple[float, float], lat: tuple[float, float], t0: float, t1: float, missions: tuple[str, ...] | None = None) -> DataFrame:
        kept = self.check(missions)
        obs = self.obs.withColumn("lon", F.pmod("lon", F.lit(360.0))) if self.wrap else self.obs
        finite = ~F.isnan("sla") & F.col("sla").isNotNull() & (F.abs("sla") < float("inf"))
        return obs.where(F.col("mission").isin(*kept) & in_range("lon", *lon) & in_range("lat", *lat) & in_range("t", t0, t1, closed=False) & finite)


def superobs(obs: DataFrame, n: int | None) -> DataFrame:
    """Means of n consecutive samples of each run of one mission and day, in the order of seq; what is left of a run is trimmed.

    Runs are gaps and islands by row numbers: within a mission and day, seq order and the order
    of the whole differ by a constant along a run. The order of the whole is not a window over all
    rows: it is the seq itself where seqs are consecutive.
    """
    if n is None:
        return obs
    day = F.floor("t").cast("long")
    own = W.partitionBy("mission", "day").orderBy("seq")
    runs = obs.withColumn("day", day).withColumn("run", F.col("seq") - F.row_number().over(own))
    at = F.row_number().over(W.partitionBy("mission", "day", "run").orderBy("seq")) - 1
    blocks = runs.withColumn("block", F.floor(at / n).cast("long")).groupBy("mission", "day", "run", "block")
    means = blocks.agg(F.min("seq").alias("seq"), *[F.avg(c).alias(c) for c in ("lon", "lat", "t", "sla", "err_var")], F.count(F.lit(1)).alias("n"))
    return means.where(F.col("n") == n).select("seq", "mission", "lon", "lat", "t", "sla", "err_var")


def mapping_observations(obs: DataFrame, n: int = 5, variance: float = MAPPING_VARIANCE) -> DataFrame:
    """Whole files (missions) thinned by n, non-finite blocks dropped, with a constant variance."""
    ranked = running(obs, ["mission"], F.floor(F.col("seq") / ORDERED_ROWS), ["seq"], F.lit(1), "_rank")
    blocks = ranked.withColumn("block", F.floor((F.col("_rank") - 1) / n).cast("long")).groupBy("mission", "block")
    means = blocks.agg(*[F.avg(c).alias(c) for c in ("lon", "lat", "t", "sla")], F.count(F.lit(1)).alias("n")).where((F.col("n") == n) & ~F.isnan("sla"))
    return means.select("mission", "block", "lon", "lat", "t", "sla", real(variance).alias("err_var"))


def evaluation_track(track: DataFrame) -> DataFrame:
    """ssh = sla_unfiltered + mdt - lwe, finite and from t = 0 on."""
    ssh = F.col("sla_unfiltered") + F.col("mdt") - F.col("lwe")
    return track.select("t", "lon", "lat", ssh.alias("ssh")).where((F.col("t") >= 0) & F.col("ssh").isNotNull() & ~F.isnan("ssh"))


def file_catalogue(names: DataFrame) -> DataFrame:
    """First and last date, number and dates of the files of each mission, from names like
    ``dt_global_<code>_phy_l3_1hz_<YYYYMMDD>_<tag>.nc``."""
    pattern = r"dt_global_([a-z0-9]+)_phy_l3_1hz_(\d{8})_"
    rows = names.select(F.regexp_extract("name", pattern, 1).alias("mission"), F.regexp_extract("name", pattern, 2).alias("stamp")).where("mission <> ''")
    return rows.groupBy("mission").agg(F.min("stamp").alias("first"), F.max("stamp").alias("last"), F.count(F.lit(1)).alias("n_files"), F.array_join(F.sort_array(F.collect_list("stamp")), ",").alias("dates"))


def prune_by_day(files: DataFrame, t0: float, t1: float) -> DataFrame:
    """Daily files (a column ``day``) that overlap [t0, t1)."""
    return files.where((F.col("day") + 1 > t0) & (F.col("day") < t1))


# Synthetic source: closed form in (mission, day, index).
SYNTHETIC_PER_DAY, SYNTHETIC_VARIANCE = 500, 1e-3


def advected_ssh(lon: Column, lat: Column, t: Column) -> Column:
    """Two advected Gaussians; longitude differences are periodic."""

    def bump(lon0: float, lat0: float, speed: float, amplitude: float, scale: float) -> Column:
        d = F.pmod(lon - (lon0 + speed * t) + 180.0, F.lit(360.0)) - 180.0
        return amplitude * F.exp(-(d * d + F.pow(lat - lat0, 2)) / (2 * scale * scale))

    return bump(300.0, 38.0, 0.1, 0.3, 2.0) + bump(297.0, 36.0, -0.05, -0.2, 1.5)


def synthetic(spark: SparkSession, t0: int, t1: int, missions: tuple[str, ...] = ("synA", "synB")) -> DataFrame:
    """500 observations a day and mission on sine-shaped tracks: synA repeats after 10 days, synB drifts 0.7 degrees a day."""
    rows = spark.range(t0 * SYNTHETIC_PER_DAY, t1 * SYNTHETIC_PER_DAY).select(F.col("id").alias("k"))
    out = None
    for number, mission in enumerate(("synA", "synB")):
        if mission not in missions:
            continue
        day = F.floor(F.col("k") / SYNTHETIC_PER_DAY).cast("long")
        phase = F.pmod(F.col("k"), F.lit(SYNTHETIC_PER_DAY)).cast("double") / SYNTHETIC_PER_DAY
        start = F.pmod(day, F.lit(10)).cast("double") * 36.0 if mission == "synA" else day.cast("double") * 0.7
        lon = F.pmod(start + phase * 360.0 * 7, F.lit(360.0))
        lat = 66.0 * F.sin(2 * math.pi * (phase * 14 + 0.1 * number))
        t = F.col("k").cast("double") / SYNTHETIC_PER_DAY
        part = rows.select((F.col("k") * 2 + number).alias("seq"), F.lit(mission).alias("mission"), lon.alias("lon"), lat.alias("lat"), t.alias("t"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"unknown missions: {missions}")
    return out.withColumn("sla", advected_ssh(F.col("lon"), F.col("lat"), F.col("t"))).withColumn("err_var", F.lit(SYNTHETIC_VARIANCE))


# Gauges.
def gauge_daily(hourly: DataFrame, least: int = 12) -> DataFrame:
    """Daily means in metres of hourly millimetres, for days with enough valid hours."""
    daily = hourly.where(F.col("mm").isNotNull() & ~F.isnan("mm")).groupBy("gauge_id", "day").agg((F.avg("mm") / 1000.0).alias("level_m"), F.count(F.lit(1)).alias("n"))
    return daily.where(F.col("n") >= least).drop("n")


def load_gauge(daily: DataFrame, gauge_id: str, locked: set[str]) -> DataFrame:
    """A gauge's series; locked gauges are refused before anything is read."""
    if gauge_id in locked:
        raise PermissionError(f"gauge {gauge_id} is locked")
    return daily.where(F.col("gauge_id") == gauge_id)


def gauge_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated station list: id; lat; lon; name; coastline; station."""
    schema = "id int, lat double, lon double, name string, coastline int, station int"
    return spark.read.schema(schema).csv(path, sep=";", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


# Sinks.
def write_observations(obs: DataFrame, path: str) -> None:
    """Partitioned by mission and day, so that scans prune both."""
    obs.withColumn("day", F.floor("t").cast("int")).repartition("mission", "day").write.mode("overwrite").partitionBy("mission", "day").parquet(path)


def write_product(product: DataFrame, path: str, manifest: dict) -> None:
    """Product rows by run and time, with the run's manifest as JSON beside them."""
    spark = product.sparkSession
    product.write.mode("overwrite").partitionBy("run_id", "time_days").parquet(f"{path}/nodes")
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_product(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return spark.read.parquet(f"{path}/nodes"), manifest


def write_map(fields: DataFrame, path: str, assimilated: tuple[str, ...] | None = None) -> None:
    """Map rows (day, lat, lon, ssh) with the missions that went into it."""
    names = F.array(*[F.lit(m) for m in assimilated]) if assimilated is not None else F.lit(None).cast("array<string>")
    fields.select(F.col("day").cast("int"), "lat", "lon", "ssh", names.alias("assimilated")).write.mode("overwrite").parquet(path)


def assert_scored_not_assimilated(fields: DataFrame, mission: str) -> None:
    """Refuse to score a map on a mission that it has assimilated; maps without a record pass."""
    if fields.where(F.array_contains("assimilated", mission)).limit(1).count():
        raise PermissionError(f"{mission} was assimilated by the map")
