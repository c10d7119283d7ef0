"""Relational operators: invariants, refusals and small cases."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathkit.functions import geo, stats
from swathkit.operators import blend, calibrate, evaluate, orbit, splits
from swathkit.operators.grid import Axis, Grid, cell_areas
from swathkit.plans import reconstruct, search
from swathkit.sources import observations as src


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, ["alg", "j3", "c2"][i % 3], float(rng.uniform(295, 301)), float(rng.uniform(33, 39)), i / 60, float(rng.normal() * 0.1), 0.01) for i in range(300)]
    return spark.createDataFrame(rows, "seq long, mission string, lon double, lat double, t double, sla double, err_var double")


def test_axis_and_areas(spark):
    assert Axis.covering(0, 1, 0.1).n == 11 and Axis.covering(0, 0.95, 0.1).n == 10
    g = Grid.covering((0.0, 359.0), (-89.5, 89.5), 1.0)
    total = cell_areas(g, spark).agg(F.sum("area_m2")).first()[0]
    assert total == pytest.approx(4 * np.pi * geo.EARTH_M**2, rel=1e-3)


def test_loader_contract(obs):
    source = src.AlongTrackSource(obs, ("alg", "j3"))
    with pytest.raises(PermissionError):
        source.load((295, 301), (33, 39), 0, 5, ("c2",))
    with pytest.raises(ValueError):
        source.load((295, 301), (33, 39), 0, 5, ("xx",))
    out = source.load((295, 301), (33, 39), 1.0, 2.0)
    r = out.agg(F.min("t"), F.max("t"), F.collect_set("mission")).first()
    assert r[0] >= 1.0 and r[1] < 2.0 and set(r[2]) == {"alg", "j3"}
    one = src.SourceDescriptor("s", "1", ("b", "a")).manifest_sha()
    assert one == src.SourceDescriptor("s", "1", ("a", "b")).manifest_sha() != src.SourceDescriptor("s", "2", ("a", "b")).manifest_sha()


def test_scan_filters_reach_parquet(spark, obs, tmp_path):
    src.write_observations(obs, f"{tmp_path}/o")
    df = src.box_window(spark.read.parquet(f"{tmp_path}/o"), (296, 297), (34, 35), (1, 2)).where("mission = 'alg'").select("sla")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(lon" in plan and "PartitionFilters: [" in plan and "err_var" not in plan.split("ReadSchema")[1]


def test_product_sink_round_trip(spark, obs, tmp_path):
    run = reconstruct.Run("oi", Grid.covering((295.0, 301.0), (33.0, 39.0), 1.0), (2.0,), {"length_scale": 200.0}, withheld="c2")
    product = reconstruct.run_single(obs, run).withColumn("run_id", F.lit("r1"))
    src.write_product(product, f"{tmp_path}/p", {"method": "oi", "seed": 0})
    back, manifest = src.read_product(spark, f"{tmp_path}/p")
    assert manifest == {"method": "oi", "seed": 0} and back.count() == 49
    fields = product.select(F.lit(2).alias("day"), "lat", "lon", F.col("mean").alias("ssh"))
    src.write_map(fields, f"{tmp_path}/m", ("alg", "j3"))
    src.assert_scored_not_assimilated(spark.read.parquet(f"{tmp_path}/m"), "c2")
    with pytest.raises(PermissionError):
        src.assert_scored_not_assimilated(spark.read.parquet(f"{tmp_path}/m"), "j3")


@pytest.mark.parametrize("method", reconstruct.METHODS)
def test_solves_do_not_depend_on_order_or_partitions(obs, method):
    run = reconstruct.Run(method, Grid.covering((295.0, 301.0), (33.0, 39.0), 1.5), (2.0,), {"members": 3, "wavelengths": (600.0,)}, withheld="c2")
    a, b = (reconstruct.run_single(x, run).orderBy("node_id").toPandas() for x in (obs, obs.orderBy("sla").repartition(5)))
    np.testing.assert_allclose(a["mean"], b["mean"], rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(a["var"], b["var"], rtol=1e-9, atol=1e-12)
    assert (a["var"] >= 0).all() and len(a) == 25


def test_tiles_blend_to_the_single_solution_in_their_middle(spark, obs):
    g = Grid.covering((295.0, 301.0), (33.0, 39.0), 1.0)
    run = reconstruct.Run("oi", g, (2.0,), {"length_scale": 60.0}, withheld="c2")
    tiles = blend.lonlat_tiles((295.0, 301.0), (33.0, 39.0), 2, 1, 250.0)
    w = blend.partition_weights(g.nodes(spark), "node_id", blend.tile_table(spark, tiles))
    sums = w.groupBy("node_id").agg(F.sum("weight").alias("s"))
    assert sums.where("abs(s - 1) > 1e-12").count() == 0 and sums.count() == 49
    tiled = reconstruct.run_tiled(obs, run, tiles).orderBy("node_id").toPandas()
    single = reconstruct.run_single(obs, run).orderBy("node_id").toPandas()
    np.testing.assert_allclose(tiled["mean"], single["mean"], atol=5e-3)
    assert (tiled["n_tiles"] >= 1).all()


def test_members_agree_where_tiles_share_nodes(spark, obs):
    g = Grid.covering((295.0, 301.0), (33.0, 39.0), 1.0)
    run = reconstruct.Run("gmrf", g, (2.0,), {}, withheld="c2")
    tiles = blend.lonlat_tiles((295.0, 301.0), (33.0, 39.0), 2, 1, 250.0)
    product = reconstruct.units(obs.where("mission <> 'c2'"), run, tiles)
    m = reconstruct.draws(product, 2, run, 0.25).join(product.select("tile", "node_id", "mean", "resid"), ["tile", "node_id"])
    noise = m.withColumn("e", F.round((F.col("value") - F.col("mean")) / F.sqrt("resid"), 6)).groupBy("node_id", "member").agg(F.countDistinct("e").alias("n"))
    assert noise.where("n > 1").count() == 0


def test_plans_of_tiles():
    plan = blend.tile_plan((0.0, 40.0), (0.0, 20.0))
    assert len(plan) == 6 and plan[0].missing == ("west", "south") and plan[-1].east == 40.0 and plan[-1].missing == ("east", "north")
    assert len(blend.mixed_tiles((0.0, 360.0), 4, 2, 66.0, 100.0)) == 10
    assert blend.halo_km(100.0, 3.0) == 300.0 and blend.halo_km(1.0, 3.0, 50.0) == 50.0
    parent, order = blend.spanning_tree([(0, 1, 5), (1, 2, 9), (0, 2, 1)], 4)
    assert parent == {0: None, 1: 0, 2: 1, 3: None} and order == [0, 1, 2, 3]
    assert blend.blend_transform(3.0, 0.1, True)["kind"] == "BLENDED" and blend.degradation_transform()["params"] == {}


def test_ramps_renormalise(spark):
    tiles = blend.tile_table(spark, blend.tile_plan((0.0, 10.0), (0.0, 10.0), size=5.0, overlap=1.0))
    nodes = Grid.covering((0.0, 10.0), (0.0, 10.0), 0.5).nodes(spark)
    rows = blend.in_tiles(nodes, tiles).withColumn("weight", blend.ramp_weight(1.0)).withColumn("value", F.lit(2.5))
    out = blend.assemble(rows, ["node_id"])
    assert out.where("abs(value - 2.5) > 1e-12 OR value IS NULL").count() == 0 and out.count() == 441


def test_splits_refuse_and_folds_are_seeded(obs):
    with pytest.raises(ValueError):
        splits.split(obs, "random_point")
    layout = splits.fold_layout(3)
    assert sorted(map(len, layout)) == [6, 6, 6, 7] and set().union(*layout) == set(range(25)) and layout == splits.fold_layout(3)
    labels = splits.block_split(obs, 2).groupBy("label").count().count()
    assert labels >= 1
    merged = splits.merge_small_blocks(layout, {b: 50.0 for b in range(25)}, 120.0)
    assert set(merged) == set(range(25)) and len(set(merged.values())) < 25
    mask = np.array([[1, 1, 0], [0, 0, 0], [1, 0, 1]], bool)
    assert splits.largest_component(mask).sum() == 2 and not splits.largest_component(np.zeros((2, 2), bool)).any()
    out = splits.stratified_split([(f"g{i}", "atl" if i % 2 else "pac", "e") for i in range(20)], 1)
    assert len(out["locked"]) == 6 and not set(out["locked"]) & set(out["open"])


def test_epochs_merge_short_ones():
    d = dt.date
    rows = splits.epochs([("a", d(2000, 1, 1), d(2010, 12, 31)), ("b", d(2005, 1, 1), d(2010, 12, 31)), ("c", d(2005, 3, 1), d(2010, 12, 31))])
    assert rows[0][:2] == (d(2000, 1, 1), d(2005, 1, 1)) and len(rows) == 2 and rows[1][2] == {"a", "b", "c"}


def test_normal_distribution_and_crps(spark):
    z = [-3.0, -1.0, 0.0, 0.5, 2.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(stats.normal_cdf(F.col("z"))).collect()
    np.testing.assert_allclose([r[0] for r in got], [0.0013499, 0.1586553, 0.5, 0.6914625, 0.9772499], atol=1e-6)
    one = spark.createDataFrame([(0.0, 1.0, 0.0)], "m double, v double, y double")
    assert one.select(stats.crps_gaussian(F.col("m"), F.col("v"), F.col("y"))).first()[0] == pytest.approx(0.2336950, abs=1e-5)


def test_polar_projection_round_trip(spark):
    x, y = geo.polar_stereographic(F.col("lon"), F.col("lat"))
    df = spark.createDataFrame([(10.0, 80.0), (-120.0, 65.0)], "lon double, lat double").select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = geo.inverse_polar_stereographic(F.col("x"), F.col("y"))
    for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r["b"] == pytest.approx(r["lat"]) and np.cos(np.radians(r["a"] - r["lon"])) == pytest.approx(1)


def test_newton_and_scoring_find_the_scale(spark):
    rng = np.random.default_rng(0)
    lat = rng.uniform(33, 43, 4000)
    s = np.exp(0.3 + 0.4 * (lat - 38) / 5)
    rows = [(300.0, float(a), float(r), 0.5, "L") for a, r in zip(lat, rng.standard_normal(4000) * np.sqrt(s * 0.5 + calibrate.TRACK_VARIANCE), strict=True)]
    points = spark.createDataFrame(rows, "lon double, lat double, resid double, v double, label string")
    theta, nll = calibrate.fit_polynomial(points, d=2)
    np.testing.assert_allclose(theta, [0.3, 0.4], atol=0.08)
    assert calibrate.fit_regions(points)["L"] == pytest.approx(0.35, abs=0.1)
    row = calibrate.likelihood_terms(points, theta).first()
    assert abs(row["g0"]) < 1e-2 * 4000 and row["nll"] == pytest.approx(nll)
    winner, audit = calibrate.select_lane([{"name": "a", "worst_region": 0.02, "aggregate": 0.01, "n_params": 5}, {"name": "b", "worst_region": 0.025, "aggregate": 0.012, "n_params": 1}])
    assert winner["name"] == "b" and len(audit) == 2
    assert calibrate.rescaled({"kind": "scalar", "log_s": 0.0}, np.e)["log_s"] == pytest.approx(1)
    with pytest.raises(TypeError):
        calibrate.rescaled({"kind": "poly"}, 2.0)


def test_orbit_geometry_of_straight_passes(spark):
    rows, seq = [], 0
    for p in range(12):
        for k in range(40):
            rows.append((seq, "j3", 296 + 0.7 * p + 0.1 * k, 34 + 0.2 * k, p * 0.1 + k / 86400))
            seq += 1
    df = spark.createDataFrame(rows, "seq long, mission string, lon double, lat double, t double")
    r = orbit.geometry(df, 38.0, (290.0, 310.0)).first()
    expected = np.degrees(np.arctan2(0.1 * np.cos(np.radians(38)), 0.2))
    assert r["n_passes"] == 12 and r["ascending"] and r["heading_deg"] == pytest.approx(expected, abs=1e-6)
    assert r["s_lon_km"] == pytest.approx(0.7 * geo.ORBIT_KM_PER_DEGREE * np.cos(np.radians(38))) and r["orbit_class"] == "drifting"
    assert '"asc"' in orbit.geometry_artifact(orbit.geometry(df, 38.0, (290.0, 310.0)))
    with pytest.raises(PermissionError):
        orbit.geometry(df.withColumn("mission", F.lit("c2")), 38.0, (290.0, 310.0))
    modes = orbit.bias_tilt(orbit.arc_coordinate(orbit.segment_passes(df)))
    assert modes.count() == 2 * 480 and modes.where("mode = 'tilt'").agg(F.max("value")).first()[0] == pytest.approx(1)


def test_search_gates_scores_and_ranks(spark):
    calls = []

    def scorer(p):
        calls.append(p)
        return {"rmse": abs(p["x"] - 0.3), "mu": p["x"]}

    for strategy in (search.RandomSearch(8), search.HaltonSearch(8), search.ParzenSearch(8, "rmse")):
        calls.clear()
        out = search.tune({"x": (0.0, 1.0)}, strategy, lambda p: (p["x"] < 0.8, "too large"), scorer, [search.Bar("mu", "ge", 0.1)], "rmse", rounds=3)
        assert len(out) == 24 and all(t.scores is None for t in out if not t.feasible) and len(calls) == sum(t.feasible for t in out)
        assert len({t.params["x"] for t in out}) == 24 and out[0].scores["mu"] >= 0.1
    table = search.rank(search.trial_table(spark, out), [search.Bar("mu", "ge", 0.1), search.Bar("none", "ge", 0)], "rmse")
    assert table.count() == 0
    winner, audit = search.banded_winner([{"id": 1, "a": 1.0, "b": 5.0}, {"id": 2, "a": 1.05, "b": 3.0}], [("a", True, 0.1), ("b", True, 0.0)])
    assert winner["id"] == 2 and audit[0]["kept"] == [1, 2]
    assert search.adjudicate(0.1, 0.05, None, 1.0) == ("a", "mu") and search.adjudicate(0.01, 0.05, -9.0, 1.0)[0] == "a" and search.adjudicate(0.0, 1.0, None, 1.0)[0] == "tie"
    assert not search.coherence_feasible(4, {"SAMPLES"})[0] and search.coherence_feasible(1, {"SAMPLES"})[0]
    assert search.authorize({"usd": 5}, {"usd": 4}) == (False, ["usd"]) and search.gate_refusals({"a": 1}, {"a": str, "b": int}) == ["a isn't str", "missing b"]
    y = np.sin(np.arange(300.0))
    bands = search.block_bands(y * 0.9 + 0.05 * np.cos(np.arange(300.0) ** 2), y * 0.5, y)
    assert bands["mu_delta"] > bands["mu_band"] > 0
    assert search.frontier(spark, {1: [0.0], 4: [0.2, 0.9]}).where("feasible").count() == 1


def test_locked_touch_and_seal(tmp_path):
    touch = search.LockedTouch("c2", granted=True)
    with touch:
        assert touch.ledger == ["c2"]
    with pytest.raises(PermissionError), touch:
        pass
    path = f"{tmp_path}/seal"
    assert search.write_seal("a", path) == search.write_seal("a", path)
    with pytest.raises(FileExistsError):
        search.write_seal("b", path)


def test_ensemble_sizes():
    assert evaluate.expected_ratio(2) == pytest.approx(np.sqrt(2 / np.pi))
    m = evaluate.least_members(1.0, 0.5, 0.1)
    assert evaluate.clean_reachable(1.0, 0.5 / np.sqrt(m - 1), 0.1) and not evaluate.clean_reachable(1.0, 0.5 / np.sqrt(m - 2), 0.1)
    assert evaluate.applicable({"a": {"X"}, "b": set()}, {"Y"}) == ["b"]


def test_gauges(spark, tmp_path):
    with pytest.raises(PermissionError):
        src.load_gauge(spark.range(1), "g", {"g"})
    (tmp_path / "c.txt").write_text("1; 48.4; -4.5; BREST; 190; 91\n2; 50.1; -5.5; NEWLYN; 170; 161\n")
    rows = src.gauge_catalogue(spark, f"{tmp_path}/c.txt").orderBy("id").collect()
    assert [(r["name"], r["lat"]) for r in rows] == [("BREST", 48.4), ("NEWLYN", 50.1)]


def test_stream_counts_equal_the_batch(spark, tmp_path):
    from swathkit.streaming import ingest

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), 1, "ab"[i % 2], float(i), "") for i in range(60)]
    spark.createDataFrame(rows, ingest.EVENT_SCHEMA.replace("timestamp_ntz", "timestamp_ntz")).write.parquet(f"{tmp_path}/in")
    counts = ingest.mission_day_counts(ingest.observation_stream(spark, f"{tmp_path}/in"))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["window"]["start"].date(), r["mission"]): r["n"] for r in spark.table("counts").collect()}
    expected: dict = {}
    for r in rows:
        k = (r[1].date(), r[3])
        expected[k] = expected.get(k, 0) + 1
    assert got == expected


def test_evidence_fits_selects_and_accepts(spark):
    rng = np.random.default_rng(4)
    n = 3000
    lon, lat = rng.uniform(295, 305, n), rng.uniform(33, 43, n)
    s = np.exp(0.2 + 0.9 * (lat - 38) / 5)
    resid = rng.standard_normal(n) * np.sqrt(s * 0.5 + calibrate.TRACK_VARIANCE)
    rows = [(i, float(a), float(b), float(r), 0.5, ("N" if b > 38 else "S"), int(i % 12) + 1) for i, (a, b, r) in enumerate(zip(lon, lat, resid, strict=True))]
    points = spark.createDataFrame(rows, "seq long, lon double, lat double, resid double, v double, class string, month int")
    found = calibrate.evidence(points, splits.month_folds(points).select("seq", "fold", "score"))
    assert found["winner"] in ("quadratic", "poly") and found["bars"]["aggregate_coverage"] and found["bars"]["all_counted"]
    assert found["clip"][0] < found["clip"][1] and set(found["regions"]) == {"N", "S", "aggregate"}
    z = calibrate.standardised(points.withColumn("s", F.lit(1.0))).agg(F.stddev("z")).first()[0]
    assert 0.8 < z < 2


def test_autocorrelation_shrinks_the_count(spark):
    rows = [(i, 0, i // 100, float(np.sin(i / 3))) for i in range(1000)]
    points = spark.createDataFrame(rows, "seq long, day int, pass_id int, z double")
    rho = calibrate.lag_correlations(points, 5)
    total = calibrate.truncated_rho_sum(rho).first()[0]
    assert 0 < total < 5
    n = spark.range(1).select(calibrate.effective_n(F.lit(1000.0), F.lit(total)).alias("n")).first()[0]
    assert n == pytest.approx(1000 / (1 + 2 * total))


def test_routes_and_constituents(spark):
    assert evaluate.route(True, "LOW_RANK") == "covariance" and evaluate.route(False, "EXACT") == "sample"
    parts = spark.createDataFrame([(0, 5, 1.0, 4.0), (1, 5, 2.0, 9.0), (1, 6, 3.0, 1.0)], "tile int, node_id long, mean double, var double")
    points = spark.createDataFrame([("p", 5)], "point string, node_id long")
    got = {(r["tile"], r["mean"], r["sigma"]) for r in evaluate.constituent_moments(parts, points).collect()}
    assert got == {(0, 1.0, 2.0), (1, 2.0, 3.0)}


def test_super_observations_and_identity(obs):
    assert src.superobs(obs, None) is obs
    out = src.superobs(obs.withColumn("mission", F.lit("one")), 7)
    per_day = {r["d"]: r["count"] for r in obs.groupBy(F.floor("t").alias("d")).count().collect()}
    assert out.count() == sum(c // 7 for c in per_day.values())


def test_mission_variance_refuses_unknown(spark, obs):
    with pytest.raises(Exception, match="no error variance"):
        reconstruct.mission_variance(obs, {"alg": 0.0}, 0.01).agg(F.sum("err_var")).collect()
    out = reconstruct.mission_variance(obs, {"alg": 0.0, "j3": 1.0, "c2": -1.0}, 0.01)
    assert out.where("mission = 'j3'").first()["err_var"] == pytest.approx(0.01 * np.e)


def test_two_level_windows_equal_plain_ones(spark):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from swathkit.operators.ordered import beside, running

    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 50.0).alias("t"), F.col("id").alias("seq"))
    w = W.partitionBy("k").orderBy("t", "seq")
    plain = {r["seq"]: (r["a"], r["b"], r["c"]) for r in df.select("seq", F.lag("seq").over(w).alias("a"), F.lead("seq").over(w).alias("b"), F.sum("seq").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("c")).collect()}
    near = beside(df, ["k"], F.floor("t"), ["t", "seq"], ["seq"])
    both = running(near, ["k"], F.floor("t"), ["t", "seq"], F.col("seq"), "total")
    got = {r["seq"]: (r["_prev"] and r["_prev"]["seq"], r["_next"] and r["_next"]["seq"], r["total"]) for r in both.collect()}
    assert got == plain
    assert running(df.where("false"), ["k"], F.floor("t"), ["t", "seq"], F.col("seq"), "total").count() == 0


def test_nearest_of_scattered_clusters(spark):
    """Far points and dense clusters alike find the nearest row, however empty the cells between them are."""
    import numpy as np

    from swathkit.operators.grid import nearest_of

    rng = np.random.default_rng(3)
    support = np.concatenate([rng.normal(0, 0.01, (200, 2)), rng.normal(50, 0.5, (20, 2)), [[-80.0, 40.0]]])
    points = np.concatenate([rng.uniform(-170, 170, (100, 2)), support[:5]])
    s = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(support)], "node long, lon double, lat double")
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "seq long, lon double, lat double")
    got = {r["seq"]: r["node"] for r in nearest_of(p, "seq", s).collect()}
    d2 = ((points[:, None] - support[None]) ** 2).sum(2)
    assert [got[k] for k in range(len(points))] == d2.argmin(1).tolist()
    assert {r["node"] for r in nearest_of(p, "seq", s.where("false")).collect()} == {None}


def test_exact_median(spark):
    from pyspark.sql import functions as F

    from swathkit.operators.calibrate import exact_median

    for n in (0, 1, 2, 7, 5000, 5001):
        df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("x"))
        exact = df.agg(F.percentile("x", F.lit(0.5))).first()[0]
        assert exact_median(df, F.col("x")) == exact
    assert exact_median(spark.range(3000).select(F.lit(2.5).alias("x")), F.col("x")) == 2.5


def test_content_cache(tmp_path):
    from swathkit.sources.cache import ContentCache

    calls = []

    def fetch(address):
        calls.append(address)
        if len(calls) == 1:
            raise ConnectionError("once")
        return b"data"

    cache = ContentCache(str(tmp_path), wait_s=0.0)
    path = cache.get("https://x.example/a/b.nc", fetch)
    assert open(path, "rb").read() == b"data" and path.endswith("-b.nc")
    assert cache.get("https://x.example/a/b.nc", fetch) == path and len(calls) == 2
    assert cache.path("https://y.example/a/b.nc") != path


def test_stages_touch_acceptance_once():
    from swathkit.plans import search

    touched = []
    space, bars = {"a": (0.0, 1.0)}, [search.Bar("mu", "ge", 0.5)]
    out = search.run_stage(space, search.RandomSearch(6, 1), lambda p: (p["a"] < 0.9, "high"), lambda p: {"mu": p["a"] + 0.4, "loss": 1 - p["a"]}, lambda p: touched.append(p) or {"mu": 0.7}, bars, "loss")
    assert len(out["trials"]) == 6 and out["winner"].scores["mu"] >= 0.5 and len(touched) == 1 and out["acceptance"] == {"mu": 0.7}
    none = search.run_stage(space, search.RandomSearch(3, 1), lambda p: (False, "no"), lambda p: {}, lambda p: touched.append(p), bars, "loss")
    assert none["winner"] is None and none["acceptance"] is None and len(touched) == 1


def test_entries_outside_the_pattern_are_refused():
    import numpy as np
    import pytest

    from swathkit.kernels.gmrf import Sparse

    with pytest.raises(ValueError, match="outside"):
        Sparse.zeros(9, 3).add(np.array([0]), np.array([8]), np.array([1.0]))


def test_providers():
    import pytest

    from swathkit.plans.reconstruct import Provider

    one = Provider({"a": 1.0, "b": 2.0}, {"c": ("exp_quad", (0.1, 0.2))})
    assert one.key() == Provider({"b": 2.0, "a": 1.0}, {"c": ("exp_quad", (0.1, 0.2))}).key() != Provider({"a": 1.0, "b": 2.5}).key()
    assert one.constant("a") == 1.0
    with pytest.raises(TypeError):
        one.constant("c")
