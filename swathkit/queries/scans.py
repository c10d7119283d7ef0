"""Scans, thinning, generators, gauges, sinks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import observations as src
from ..sources.observations import OBS_SQL, observations


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to 6 decimals, without negative zeros."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def r6(x: str) -> str:
    """The same in SQL."""
    return f"(round({x}, 6) + 0.0::DOUBLE)"


_POSITION = f"{r6('lon')} AS lon, {r6('lat')} AS lat, {r6('t')} AS t, {r6('sla')} AS sla"


@query(f"WITH {OBS_SQL} SELECT seq, mission, {_POSITION}, err_var FROM obs WHERE lon BETWEEN 296 AND 303 AND lat BETWEEN 34 AND 41 AND t BETWEEN 5 AND 10")
def window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box scan, inclusive at all bounds."""
    box = src.box_window(observations(spark, sf_dir), (296, 303), (34, 41), (5, 10), noise=0.01)
    return rounded(box, "lon", "lat", "t", "sla")


@query(f"WITH {OBS_SQL} SELECT {_POSITION} FROM obs WHERE mission = 'purchase'")
def withheld_mission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.withheld(observations(spark, sf_dir), "purchase"), "lon", "lat", "t", "sla")


@query(f"WITH {OBS_SQL} SELECT seq, mission, {_POSITION}, err_var FROM obs WHERE mission IN ('click', 'view') AND lon BETWEEN 295 AND 300 AND lat BETWEEN 33 AND 43 AND t >= 3 AND t < 9 AND isfinite(sla)")
def along_track_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loader contract: mission restriction, box, half-open time, finite values."""
    source = src.AlongTrackSource(observations(spark, sf_dir), ("click", "view", "purchase"))
    return rounded(source.load((295, 300), (33, 43), 3, 9, ("view", "click")), "lon", "lat", "t", "sla")


@query(f"WITH {OBS_SQL} SELECT seq, {r6('((lon - 480) % 360 + 360) % 360')} AS lon FROM obs WHERE ((lon - 480) % 360 + 360) % 360 BETWEEN 175 AND 180 AND isfinite(sla) AND t >= 0 AND t < 100")
def wrapped_longitude_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitudes normalised modulo 360 before the box applies."""
    obs = observations(spark, sf_dir).withColumn("lon", F.col("lon") - 480.0)
    missions = tuple(r[0] for r in obs.select("mission").distinct().collect())
    return rounded(src.AlongTrackSource(obs, missions, wrap_longitude=True).load((175, 180), (-90, 90), 0, 100).select("seq", "lon"), "lon")


@query(f"""WITH {OBS_SQL},
g AS (SELECT *, floor(t) AS day, seq - row_number() OVER (PARTITION BY mission, floor(t) ORDER BY seq) AS run FROM obs),
b AS (SELECT *, floor((row_number() OVER (PARTITION BY mission, day, run ORDER BY seq) - 1) / 2) AS block FROM g)
SELECT min(seq) AS seq, mission, {r6('avg(lon)')} AS lon, {r6('avg(lat)')} AS lat, {r6('avg(t)')} AS t, {r6('avg(sla)')} AS sla, {r6('avg(err_var)')} AS err_var
FROM b GROUP BY mission, day, run, block HAVING count(*) = 2""")
def superobs_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of two consecutive samples of each run of a mission and day."""
    return rounded(src.superobs(observations(spark, sf_dir), 2), "lon", "lat", "t", "sla", "err_var")


@query(f"""WITH {OBS_SQL}, b AS (SELECT *, floor((row_number() OVER (PARTITION BY mission ORDER BY seq) - 1) / 5)::BIGINT AS block FROM obs)
SELECT mission, block, {r6('avg(lon)')} AS lon, {r6('avg(lat)')} AS lat, {r6('avg(t)')} AS t, {r6('avg(sla)')} AS sla, 0.0025::DOUBLE AS err_var FROM b GROUP BY mission, block HAVING count(*) = 5""")
def mapping_obs_coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.mapping_observations(observations(spark, sf_dir)), "lon", "lat", "t", "sla")


@query(f"""WITH {OBS_SQL} SELECT {r6('t')} AS t, {r6('lon')} AS lon, {r6('lat')} AS lat, {r6('sla + 0.01 * (lat - 38) - 0.001 * (lon - 300)')} AS ssh FROM obs WHERE t >= 0 AND isfinite(sla)""")
def evaluation_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ssh = unfiltered level + mean topography - long-wave error."""
    track = observations(spark, sf_dir).select("t", "lon", "lat", F.col("sla").alias("sla_unfiltered"), (0.01 * (F.col("lat") - 38)).alias("mdt"), (0.001 * (F.col("lon") - 300)).alias("lwe"))
    return rounded(src.evaluation_track(track), "t", "lon", "lat", "ssh")


@query("""WITH n AS (SELECT DISTINCT 'dt_global_' || event_type || '_phy_l3_1hz_' || strftime(ts, '%Y%m%d') || '_20240601.nc' AS name FROM events),
r AS (SELECT regexp_extract(name, 'dt_global_([a-z0-9]+)_phy_l3_1hz_([0-9]{8})_', 1) AS mission, regexp_extract(name, 'dt_global_([a-z0-9]+)_phy_l3_1hz_([0-9]{8})_', 2) AS stamp FROM n)
SELECT mission, min(stamp) AS first, max(stamp) AS last, count(*) AS n_files, string_agg(stamp, ',' ORDER BY stamp) AS dates FROM r WHERE mission <> '' GROUP BY mission""")
def file_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-mission first and last date and dates, from file names."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = events.select(F.concat(F.lit("dt_global_"), "event_type", F.lit("_phy_l3_1hz_"), F.date_format("ts", "yyyyMMdd"), F.lit("_20240601.nc")).alias("name")).distinct()
    return src.file_catalogue(names)


@query(f"WITH {OBS_SQL}, f AS (SELECT mission, floor(t)::BIGINT AS day, count(*) AS n FROM obs GROUP BY ALL) SELECT mission, day, n FROM f WHERE day + 1 > 4.5 AND day < 9.5")
def pruned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily files that overlap [4.5, 9.5)."""
    files = observations(spark, sf_dir).groupBy("mission", F.floor("t").cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return src.prune_by_day(files, 4.5, 9.5)


def _ssh_sql(lon: str, lat: str, t: str) -> str:
    def bump(lon0: float, lat0: float, speed: float, amplitude: float, scale: float) -> str:
        d = f"((({lon} - ({lon0} + {speed} * {t}) + 180) % 360 + 360) % 360 - 180)"
        return f"({amplitude}::DOUBLE * exp(-({d} * {d} + pow({lat} - {lat0}, 2)) / {2 * scale * scale}::DOUBLE))"

    return f"({bump(300.0, 38.0, 0.1, 0.3, 2.0)} + {bump(297.0, 36.0, -0.05, -0.2, 1.5)})"


@query(f"WITH {OBS_SQL} SELECT seq, {r6(_ssh_sql('lon', 'lat', 't'))} AS ssh FROM obs")
def analytic_ssh(spark: SparkSession, sf_dir: str) -> DataFrame:
    ssh = src.advected_ssh(F.col("lon"), F.col("lat"), F.col("t"))
    return rounded(observations(spark, sf_dir).select("seq", ssh.alias("ssh")), "ssh")


@query(f"""WITH k AS (SELECT unnest(range(0, 10 * 500)) AS k), m AS (SELECT * FROM k, (VALUES (0, 'synA'), (1, 'synB')) v(n, mission)),
p AS (SELECT k * 2 + n AS seq, mission, n, k::DOUBLE / 500 AS t, floor(k / 500) AS day, (k % 500)::DOUBLE / 500 AS phase FROM m),
o AS (SELECT seq, mission, ((CASE WHEN n = 0 THEN (day % 10) * 36.0::DOUBLE ELSE day * 0.7::DOUBLE END) + phase * 360.0::DOUBLE * 7) % 360 AS lon,
  66.0::DOUBLE * sin({2 * math.pi!r}::DOUBLE * (phase * 14 + 0.1::DOUBLE * n)) AS lat, t FROM p)
SELECT seq, mission, {r6('lon')} AS lon, {r6('lat')} AS lat, {r6('t')} AS t, {r6(_ssh_sql('lon', 'lat', 't'))} AS sla, 0.001::DOUBLE AS err_var FROM o""")
def synthetic_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten days of the deterministic generator."""
    return rounded(src.synthetic(spark, 0, 10), "lon", "lat", "t", "sla")


_HOURLY = "h AS (SELECT event_type AS gauge_id, ts::DATE AS day, value * 10 AS mm FROM events WHERE event_id % 7 <> 0)"


@query(f"WITH {_HOURLY} SELECT gauge_id, day::VARCHAR AS day, {r6('avg(mm) / 1000')} AS level_m FROM h GROUP BY gauge_id, day HAVING count(*) >= 12")
def gauge_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of days with at least twelve valid hours."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hourly = events.select(F.col("event_type").alias("gauge_id"), F.col("ts").cast("date").alias("day"), F.when(F.col("event_id") % 7 != 0, F.col("value") * 10).alias("mm"))
    return rounded(src.gauge_daily(hourly).withColumn("day", F.col("day").cast("string")), "level_m")


@query("SELECT 'click' AS mission, count(*) FILTER (event_type = 'click') AS n FROM events")
def product_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations written by mission and day, read back through partition pruning."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp()
    path = f"{root.rstrip('/')}/observations-{spark.sparkContext.applicationId}"
    src.write_observations(observations(spark, sf_dir), path)
    return spark.read.parquet(path).where("mission = 'click'").groupBy("mission").agg(F.count(F.lit(1)).alias("n"))
