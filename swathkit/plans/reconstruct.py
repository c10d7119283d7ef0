"""Reconstruction plans: scan, withhold, tile, solve per (tile, output time), blend, score.

A unit of work is one tile at one output time. Observations reach a unit by a range join with the
plan's few tiles and times; nodes reach it in the same way, and both are cogrouped, so that units
are solved in parallel and a unit's observations are all that a task holds. A kernel returns
reduced rows only.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import in_range, latitude_field, real
from ..kernels import fem, gmrf, miost, oi
from ..kernels.covariance import Kernel, gaussian_degrees, matern_space_time, paciorek_degrees
from ..kernels.noise import derive_seed, lattice_identity, normals
from ..operators.blend import Tile, blend, in_tiles, partition_weights, tile_table
from ..operators.grid import Grid, interpolate
from ..operators.orbit import arc_coordinate, segment_passes
from ..sources.observations import CHALLENGE_MISSIONS


@dataclass(frozen=True)
class Run:
    """Inputs of a reconstruction."""

    method: str
    grid: Grid
    output_times: tuple[float, ...]
    params: dict = field(default_factory=dict)
    half_window: float | None = None
    rank: int = 8
    seed: int = 0
    withheld: str = "c2"


@dataclass(frozen=True)
class Provider:
    """Parameters of a run: constants, and fields of latitude by form and coefficients."""

    constants: dict[str, float]
    varied: dict[str, tuple[str, tuple[float, ...]]] = field(default_factory=dict)

    def at(self, name: str, lat: Column) -> Column:
        """The parameter's value at a latitude."""
        if name in self.varied:
            form, a = self.varied[name]
            return latitude_field(lat, form, *a)
        return real(self.constants[name])

    def constant(self, name: str) -> float:
        """A constant; a field is refused, not made one."""
        if name in self.varied:
            raise TypeError(f"{name} varies with latitude")
        return self.constants[name]

    def key(self) -> str:
        """Digest that depends on names and values, not on their order."""
        body = dict(self.constants) | {k: {"form": form, "a": list(a)} for k, (form, a) in self.varied.items()}
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


#: Observations that a dense unit may hold: two matrices of 3.2 GB at most.
DENSE_OBS = 20_000
#: Bytes that a window's solve may need.
WINDOW_BYTES = 4e9


def kernel_of(params: dict) -> Kernel:
    """The covariance that the parameters name: Matern in kilometres, Gaussian in degrees, or with lengths by latitude."""
    kind = params.get("kernel", "matern")
    if kind == "matern":
        return matern_space_time(params.get("variance", 0.05), params.get("length_scale", 300.0), params.get("time_scale", 10.0))
    if kind == "gaussian":
        return gaussian_degrees(params.get("variance", 0.05), params.get("lx", 1.0), params.get("ly", 1.0), params.get("lt", 7.0))
    if kind == "paciorek":
        a0, a1 = params.get("length", (0.0, 0.0))
        shape = lambda lat: (np.clip(lat, 33, 43) - 38) / 5
        return paciorek_degrees(lambda lat: np.exp(a0 + a1 * shape(lat)), lambda lat: np.full(len(lat), params.get("variance", 0.05) ** 0.5), params.get("lt", 7.0))
    raise ValueError(f"unknown kernel {kind!r}")


def _idw(obs: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    d2 = ((at[:, None, :2] - obs[None, :, :2]) ** 2).sum(2)
    w = 1 / (d2 + 1e-9)
    return (w * y).sum(1) / w.sum(1)


def solve_unit(run: Run, t: float, obs: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """One unit: mean, var and factor (low-rank or member anomalies) of its nodes."""
    points = np.column_stack([obs["lon"], obs["lat"], obs["t"]]).astype(float)
    y, noise = obs["sla"].to_numpy(float), obs["err_var"].to_numpy(float)
    at = np.column_stack([nodes["lon"], nodes["lat"], np.full(len(nodes), t)])
    p, n = run.params, len(nodes)
    if run.method == "oi":
        if len(points) > p.get("most_obs", DENSE_OBS):
            raise MemoryError(f"{len(points)} observations in a unit: tile the run, or shorten its window")
        post = oi.Posterior(kernel_of(p), points, y, noise)
        mean, var = post.mean(at), post.variance(at)
        factor, residual, _ = oi.low_rank(post, at, min(run.rank, n), run.seed)
        residual = np.maximum(var - (factor**2).sum(1), 0)
    elif run.method in ("gmrf", "fem"):
        lon, lat = np.unique(nodes["lon"].round(9)), np.unique(nodes["lat"].round(9))
        shape = (p.get("range_km", 300.0), p.get("variance", 0.05), p.get("taper", 10.0))
        if run.method == "gmrf":
            f = gmrf.Field(lon, lat, points, y, noise, t, *shape)
            mean, var = f.mean, f.variance()
        else:
            mesh = fem.structured_mesh(lon, lat)
            mean, var = fem.solve(*mesh, points, y, noise, t, *shape, row=len(lon))
        order = np.lexsort((nodes["lon"].to_numpy().round(9), nodes["lat"].to_numpy().round(9)))
        back = np.empty(n, int)
        back[order] = np.arange(n)
        mean, var = mean[back], var[back]
        factor, residual = np.zeros((n, 0)), var
    elif run.method == "trivial":
        members = p.get("members", 50)
        mean = _idw(points, y, at) if len(points) else np.zeros(n)
        draws = [_idw(points, y + np.sqrt(noise) * normals(obs["seq"].to_numpy(), m, run.seed), at) if len(points) else mean for m in range(members)]
        var = np.var(draws, axis=0, ddof=1)
        factor, residual = (np.array(draws) - np.mean(draws, 0)).T / np.sqrt(members - 1), np.zeros(n)
    elif run.method == "miost":
        lon0, lat0 = float(np.mean(at[:, 0])), float(np.mean(at[:, 1]))
        xo, yo = miost.to_km(points[:, 0], points[:, 1], lon0, lat0)
        xn, yn = miost.to_km(at[:, 0], at[:, 1], lon0, lat0)
        basis = miost.Basis((float(xn.min()), float(xn.max())), (float(yn.min()), float(yn.max())), tuple(p.get("wavelengths", (800.0, 400.0))), p.get("n_dir", 4))
        els = basis.elements(t - 30, t + 30)
        q = miost.prior_variance(els["lam"], p.get("rho", 1.0), p.get("q_slope", 2.0), p.get("r_ref", 0.01))
        system = miost.Normal(basis.design(els, xo, yo, points[:, 2]), len(y), noise, q)
        members = p.get("members", 10)
        sides = miost.member_sides(system, y, obs["seq"].to_numpy(), np.arange(len(q)), members, run.seed)
        eta = miost.solution(system, sides)
        row, column, value = basis.design(els, xn, yn, np.full(n, t))
        fields = np.stack([np.bincount(row, value * e[column], n) for e in eta.T], 1)
        mean, anomalies = fields[:, 0], fields[:, 1:] - fields[:, 1:].mean(1, keepdims=True)
        factor, residual = anomalies / np.sqrt(max(members - 1, 1)), np.zeros(n)
        var = (factor**2).sum(1)
    else:
        raise ValueError(f"unknown method {run.method!r}")
    return pd.DataFrame({"node_id": nodes["node_id"], "lon": nodes["lon"], "lat": nodes["lat"], "mean": mean, "var": var, "factor": [list(map(float, r)) for r in factor], "resid": residual})


METHODS = ("oi", "gmrf", "fem", "miost", "trivial")
#: What the product of a method stores beside mean and variance.
REDUCTIONS = {"oi": "low_rank", "gmrf": "precision", "fem": "precision", "miost": "empirical", "trivial": "empirical"}
#: Methods with a shipped product, and its settings.
SHIPPED = {"miost": {"missions": CHALLENGE_MISSIONS, "members": 100, "wavelengths": (800.0, 400.0, 200.0)}}


def select_reduction(method: str) -> str:
    if method not in REDUCTIONS:
        raise ValueError(f"no reduction for {method!r}")
    return REDUCTIONS[method]


def prepared(obs: DataFrame, run: Run) -> tuple[DataFrame, DataFrame]:
    """What a run learns from, and where it is evaluated: the withheld mission's places, at the first output time."""
    held = F.col("mission") == run.withheld
    return obs.where(~held), obs.where(held).withColumn("t", F.lit(float(run.output_times[0])))


_OUT = "tile int, time_days double, node_id long, lon double, lat double, mean double, var double, factor array<double>, resid double"


def units(obs: DataFrame, run: Run, tiles: list[Tile]) -> DataFrame:
    """Product rows of every (tile, output time): tile, time_days, node_id, lon, lat, mean, var, factor, resid."""
    spark = obs.sparkSession
    table = tile_table(spark, tiles)
    times = spark.createDataFrame([(float(t),) for t in run.output_times], "time_days double")
    own_nodes = in_tiles(run.grid.nodes(spark).select("node_id", "lon", "lat"), table).select(F.col("tile").alias("n_tile"), "node_id", "lon", "lat").join(F.broadcast(times.select(F.col("time_days").alias("n_time"))))
    window = F.lit(True) if run.half_window is None else F.abs(F.col("t") - F.col("time_days")) <= run.half_window
    own_obs = in_tiles(obs.select("seq", "lon", "lat", "t", "sla", "err_var"), table).select("tile", "seq", "lon", "lat", "t", "sla", "err_var").join(F.broadcast(times), window)

    def solve(key: tuple, o: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame(columns=["tile", "time_days", "node_id", "lon", "lat", "mean", "var", "factor", "resid"])
        out = solve_unit(run, float(key[1]), o.sort_values("seq"), n.sort_values("node_id").reset_index(drop=True))
        out.insert(0, "time_days", float(key[1]))
        out.insert(0, "tile", int(key[0]))
        return out

    return own_obs.groupBy("tile", "time_days").cogroup(own_nodes.groupBy("n_tile", "n_time")).applyInPandas(solve, _OUT)


def whole(grid: Grid) -> list[Tile]:
    """The grid as one tile."""
    return [Tile(0, grid.lon.low, grid.lon.high, grid.lat.low, grid.lat.high, 0.0, 0.0)]


def run_single(obs: DataFrame, run: Run, halo: float | None = None) -> DataFrame:
    """Product of one tile: observations of the withheld mission are left out."""
    train = obs.where(F.col("mission") != run.withheld)
    if halo is not None:
        train = train.where(in_range("lon", run.grid.lon.low - halo, run.grid.lon.high + halo) & in_range("lat", run.grid.lat.low - halo, run.grid.lat.high + halo))
    wide = [Tile(0, -1e9, 1e9, -1e9, 1e9, 0.0, 0.0)]
    return units(train, run, wide)


def run_tiled(obs: DataFrame, run: Run, tiles: list[Tile]) -> DataFrame:
    """Blended product: time_days, node_id, lon, lat, mean, var, n_tiles."""
    spark = obs.sparkSession
    product = units(obs.where(F.col("mission") != run.withheld), run, tiles)
    weights = partition_weights(run.grid.nodes(spark).select("node_id", "lon", "lat"), "node_id", tile_table(spark, tiles)).select("node_id", "tile", "weight")
    return blend(product.join(weights, ["node_id", "tile"]), ["time_days", "node_id", "lon", "lat"])


def at_points(product: DataFrame, run: Run, points: DataFrame, key: str) -> DataFrame:
    """Bilinear mean and variance of a product's first output time at points."""
    first = product.where(F.col("time_days") == float(run.output_times[0]))
    out = interpolate(points, key, run.grid, first.select("node_id", "mean"), "mean")
    return interpolate(out, key, run.grid, first.select("node_id", "var"), "var")


def draws(product: DataFrame, members: int, run: Run, lattice: float) -> DataFrame:
    """Coherent members: mean + factor z + sqrt(resid) e, with z keyed by (method, parameters, member)
    and e by global lattice cell, so that nodes that tiles share get the same noise."""
    key = repr(sorted(run.params.items()))

    def one(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for m in range(members):
                root = derive_seed(run.method, key, "coherent", m)
                rank = max((len(f) for f in pdf["factor"]), default=0)
                z = normals(np.arange(rank), m, root, "factor")
                e = normals(lattice_identity(pdf["lon"], pdf["lat"], lattice), m, root, "diagonal")
                value = pdf["mean"] + [float(np.dot(f, z[: len(f)])) for f in pdf["factor"]] + np.sqrt(pdf["resid"]) * e
                out.append(pd.DataFrame({"tile": pdf["tile"], "time_days": pdf["time_days"], "node_id": pdf["node_id"], "member": m, "value": value}))
            yield pd.concat(out) if out else pdf.head(0)

    return product.mapInPandas(one, "tile int, time_days double, node_id long, member int, value double")


def factor_covariance(product: DataFrame, pairs: DataFrame) -> DataFrame:
    """Covariance of node pairs (a, b) of one tile and time: the product of factor rows, plus the residual on the diagonal."""
    p = product.select("tile", "time_days", "node_id", "factor", "resid")
    a, b = (p.select("tile", "time_days", F.col("node_id").alias(c), F.col("factor").alias(f"f{c}"), F.col("resid").alias(f"r{c}")) for c in "ab")
    dot = F.aggregate(F.zip_with("fa", "fb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(a, "a").join(b, ["tile", "time_days", "b"]).select("tile", "time_days", "a", "b", (dot + F.when(F.col("a") == F.col("b"), F.col("ra")).otherwise(0.0)).alias("cov"))


def maps(obs: DataFrame, run: Run, halo: float = 1.0) -> DataFrame:
    """Daily maps over sliding windows: day, lat, lon, ssh and its variance."""
    product = run_single(obs, run, halo)
    return product.select(F.floor("time_days").cast("int").alias("day"), "lat", "lon", F.col("mean").alias("ssh"), "var")


def report_rows(spark: SparkSession, product: DataFrame, run: Run, withheld: DataFrame) -> DataFrame:
    """Withheld observations with the product's mean and variance, ready for the evaluators."""
    moved = withheld.withColumn("t", F.lit(float(run.output_times[0])))
    return at_points(product, run, moved, "seq").select("seq", F.col("sla").alias("value"), "mean", "var").where(F.col("mean").isNotNull())


def mission_variance(obs: DataFrame, deltas: dict[str, float], r_ref: float) -> DataFrame:
    """err_var = r_ref exp(delta of the mission); a mission without one is refused."""
    spark = obs.sparkSession
    table = spark.createDataFrame(sorted(deltas.items()), "mission string, _delta double")
    joined = obs.drop("err_var").join(F.broadcast(table), "mission", "left")
    return joined.withColumn("err_var", F.when(F.col("_delta").isNull(), F.raise_error(F.concat(F.lit("no error variance for mission "), F.col("mission")))).otherwise(r_ref * F.exp("_delta"))).drop("_delta")


def window_maps(obs: DataFrame, run: Run, windows: miost.Windows) -> DataFrame:
    """Multiscale maps over overlapping windows: each window is solved once, evaluated on the output days
    that it covers, and the (one or two) covering windows of a day are blended by linear weights.

    time_days, node_id, lon, lat, mean, var: the variance is that of the blended members, whose noise is
    keyed by observation and element, so that members of two windows belong together. With the
    parameter ``pass_bias`` (and ``pass_tilt``), variances in square metres, every pass has a bias and a
    tilt along its arc as observation errors of its own.
    """
    spark = obs.sparkSession
    spans = windows.all()
    table = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(spans)], "window int, w0 double, w1 double")
    cover = spark.createDataFrame([(float(d), k, w) for d in run.output_times for k, w in windows.covering(d)], "time_days double, window int, weight double")
    p, reach = run.params, run.params.get("dt_days", 10.0)
    kept = obs.where(F.col("mission") != run.withheld)
    if structured := "pass_bias" in p:
        kept = arc_coordinate(segment_passes(kept))
        pass_key = F.xxhash64("mission", "pass_id")
    kept = kept.select("seq", "lon", "lat", "t", "sla", "err_var", *([F.col("s"), pass_key.alias("pass_key")] if structured else []))
    own = kept.join(F.broadcast(table), (F.col("t") >= F.col("w0") - reach) & (F.col("t") <= F.col("w1") + reach))
    days = {k: [float(d) for d in run.output_times if k in dict(windows.covering(d))] for k in range(len(spans))}
    lon, lat = (np.array([a.low + i * a.step for i in range(a.n)]) for a in (run.grid.lon, run.grid.lat))
    x_deg, y_deg = (g.ravel() for g in np.meshgrid(lon, lat))

    def solve(key: tuple, o: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        o = o.sort_values("seq")
        lon0, lat0 = float(lon.mean()), float(lat.mean())
        xn, yn = miost.to_km(x_deg, y_deg, lon0, lat0)
        xo, yo = miost.to_km(o["lon"].to_numpy(), o["lat"].to_numpy(), lon0, lat0)
        basis = miost.Basis((float(xn.min()), float(xn.max())), (float(yn.min()), float(yn.max())), tuple(p.get("wavelengths", (800.0, 400.0))), p.get("n_dir", 4), dt_days=reach)
        els = basis.elements(*spans[k])
        q = miost.prior_variance(els["lam"], p.get("rho", 1.0), p.get("q_slope", 2.0), p.get("r_ref", 0.01))
        miost.gate(basis, len(o), *spans[k], p.get("members", 4), len(xn), p.get("most_bytes", WINDOW_BYTES))
        design, err_id = basis.design(els, xo, yo, o["t"].to_numpy()), None
        identity = lattice_identity(els["x"], els["y"], 1.0) ^ (np.rint(els["t"] * 10).astype(np.int64) << 20) ^ np.rint(els["lam"] * els["angle"] + els["phase"] * 7).astype(np.int64)
        if structured:  # errors of a pass: its bias and tilt, keyed by the pass
            passes = o["pass_key"].to_numpy()
            design, q = miost.augmented(design, q, o["s"].to_numpy(), passes, p["pass_bias"], p.get("pass_tilt", p["pass_bias"]))
            err_id = np.repeat(np.unique(passes), 2) ^ np.tile([0, 1], len(np.unique(passes)))
        system = miost.Normal(design, len(o), o["err_var"].to_numpy(), q)
        eta = miost.solution(system, miost.member_sides(system, o["sla"].to_numpy(), o["seq"].to_numpy(), identity, p.get("members", 4), run.seed, err_id))
        parts = []
        for d in days[k]:
            row, column, value = basis.design(els, xn, yn, np.full(len(xn), d))
            fields = np.stack([np.bincount(row, value * e[column], len(xn)) for e in eta.T], 1)
            parts.append(pd.DataFrame({"window": k, "time_days": d, "node_id": np.arange(len(xn)), "lon": x_deg, "lat": y_deg, "field": list(fields)}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["window", "time_days", "node_id", "lon", "lat", "field"])

    solved = own.groupBy("window").applyInPandas(solve, "window int, time_days double, node_id long, lon double, lat double, field array<double>")
    weighted = solved.join(F.broadcast(cover), ["time_days", "window"]).select("time_days", "node_id", "lon", "lat", F.posexplode("field").alias("member", "value"), "weight")
    blended = weighted.groupBy("time_days", "node_id", "lon", "lat", "member").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    return blended.groupBy("time_days", "node_id", "lon", "lat").agg(F.max(F.when(F.col("member") == 0, F.col("value"))).alias("mean"), F.var_samp(F.when(F.col("member") > 0, F.col("value"))).alias("var"))


def lattice_members(obs: DataFrame, run: Run, tiles: list[Tile], members: int, driver: str = "tree_members") -> DataFrame:
    """Coherent members of a tiled lattice posterior: time_days, member, node_id, value.

    Conditioning runs along the tiles of a time, so that an output time is one group: its
    observations are bounded by the half window and the grid by the plan. Values of nodes that
    tiles share are blended by the partition of unity.
    """
    from ..kernels import coherent

    p, grid = run.params, run.grid
    shape = (p.get("range_km", 300.0), p.get("variance", 0.05), p.get("taper", 10.0))
    key = repr(sorted(p.items()))
    times = obs.sparkSession.createDataFrame([(float(t),) for t in run.output_times], "time_days double")
    near = F.lit(True) if run.half_window is None else F.abs(F.col("t") - F.col("time_days")) <= run.half_window
    own = obs.where(F.col("mission") != run.withheld).select("seq", "lon", "lat", "t", "sla", "err_var").join(F.broadcast(times), near)

    def solve(group: tuple, o: pd.DataFrame) -> pd.DataFrame:
        o = o.sort_values("seq")
        points, y, noise = np.column_stack([o["lon"], o["lat"], o["t"]]), o["sla"].to_numpy(), o["err_var"].to_numpy()
        axes = [np.array([a.low + i * a.step for i in range(a.n)]) for a in (grid.lon, grid.lat)]
        parts = []
        for t in tiles:
            lon = axes[0][(axes[0] >= t.west - t.halo_lon) & (axes[0] <= t.east + t.halo_lon)]
            lat = axes[1][(axes[1] >= t.south - t.halo_lat) & (axes[1] <= t.north + t.halo_lat)]
            inside = (points[:, 0] >= lon[0]) & (points[:, 0] <= lon[-1]) & (points[:, 1] >= lat[0]) & (points[:, 1] <= lat[-1])
            parts.append(coherent.TileDraw.of(gmrf.Field(lon, lat, points[inside], y[inside], noise[inside], float(group[0]), *shape)))
        owner = {k: min(i for i, t in enumerate(tiles) if t.west <= k[0] <= t.east and t.south <= k[1] <= t.north) for d in parts for k in d.keys}
        out = []
        for m in range(members):
            values = coherent.owner_members(parts, owner, m, key) if driver == "owner_members" else getattr(coherent, driver)(parts, m, key)
            for i, (d, v) in enumerate(zip(parts, values, strict=True)):
                x, yy = np.array(d.keys).T
                out.append(pd.DataFrame({"time_days": group[0], "member": m, "tile": i, "node_id": np.rint((yy - grid.lat.low) / grid.lat.step).astype(np.int64) * grid.lon.n + np.rint((x - grid.lon.low) / grid.lon.step).astype(np.int64), "value": v}))
        return pd.concat(out)

    drawn = own.groupBy("time_days").applyInPandas(solve, "time_days double, member int, tile int, node_id long, value double")
    spark = obs.sparkSession
    weights = partition_weights(grid.nodes(spark).select("node_id", "lon", "lat"), "node_id", tile_table(spark, tiles)).select("node_id", "tile", "weight")
    return drawn.join(weights, ["node_id", "tile"]).groupBy("time_days", "member", "node_id").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
