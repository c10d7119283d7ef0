"""The solvers on systems small enough for SQL: pairs of observations, lattices and meshes of a few nodes.

Each row or group of the observation view is one system; kernels solve it, SQL by its closed form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kernels import coherent, fem, gmrf, miost, noise, oi, spectra
from ..kernels.covariance import matern_space_time
from ..operators.blend import lonlat_tiles
from ..plans import reconstruct as plan
from ..registry import query
from ..sources.observations import OBS_SQL, observations
from .grids import _KM, _M32, _PAIRS, GRID, _pairs
from .scans import r6, rounded


def _each(rows: DataFrame, one: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """The rows that ``one`` gives for each row, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [r for row in pdf.to_dict("records") for r in one(row)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(run, schema)


# Optimal interpolation of two observations that are coupled.
def _k(a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
    """The covariance of two positions (lon, lat, t) in SQL."""
    km = _KM
    for old, new in zip(("lon1", "lat1", "lon2", "lat2"), ("{a0}", "{a1}", "{b0}", "{b1}"), strict=True):
        km = km.replace(old, new)
    km = km.format(a0=a[0], a1=a[1], b0=b[0], b1=b[1])
    return f"(0.05::DOUBLE * {_M32.format(d=km, s='300.0::DOUBLE')} * {_M32.format(d=f'abs({a[2]} - {b[2]})', s='10.0::DOUBLE')})"


_A, _B, _P, _Q = (("lon1", "lat1", "t1"), ("lon2", "lat2", "t2"), ("plon", "plat", "t1"), ("(plon + 0.5)", "plat", "t1"))
_OI = f"""{_PAIRS}, v AS (SELECT p.*, a.sla AS y1, b.sla AS y2, 0.01::DOUBLE AS r1, 0.02::DOUBLE AS r2, 295 + least(greatest(ceil(lon1 - 295 - 0.5), 0), 10) AS plon, 33 + least(greatest(ceil(lat1 - 33 - 0.5), 0), 10) AS plat
  FROM p JOIN obs a ON a.seq = i JOIN obs b ON b.seq = j),
k AS (SELECT *, 0.05 + r1 AS kaa, 0.05 + r2 AS kbb, {_k(_A, _B)} AS kab, {_k(_P, _A)} AS pa, {_k(_P, _B)} AS pb, {_k(_Q, _A)} AS qa, {_k(_Q, _B)} AS qb, {_k(_P, _Q)} AS pq FROM v),
d AS (SELECT *, kaa * kbb - kab * kab AS det FROM k),
s AS (SELECT i, (pa * (kbb * y1 - kab * y2) + pb * (kaa * y2 - kab * y1)) / det AS mean, 0.05 - (pa * pa * kbb - 2 * pa * pb * kab + pb * pb * kaa) / det AS var,
  pq - (pa * qa * kbb - (pa * qb + pb * qa) * kab + pb * qb * kaa) / det AS cov FROM d)"""


@query(f"WITH {OBS_SQL}, {_OI} SELECT i, {r6('mean')} AS mean, {r6('var')} AS var, {r6('cov')} AS cov, {r6('mean + sqrt(var + 1e-9) * ((i % 7) - 3) / 2.0::DOUBLE')} AS draw, {r6('var')} AS factor_var FROM s")
def oi_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two consecutive observations as one system: mean, variance, covariance with a second node, a
    draw for a given normal number, and the variance that a low-rank factor of full rank gives back."""
    values = observations(spark, sf_dir).select("seq", "sla")
    rows = _pairs(spark, sf_dir).join(values.select(F.col("seq").alias("i"), F.col("sla").alias("y1")), "i").join(values.select(F.col("seq").alias("j"), F.col("sla").alias("y2")), "j")
    kernel = matern_space_time(0.05, 300.0, 10.0)

    def one(r: dict) -> list[dict]:
        obs = np.array([[r["lon1"], r["lat1"], r["t1"]], [r["lon2"], r["lat2"], r["t2"]]])
        x, y = (low + min(max(np.ceil(v - low - 0.5), 0), 10) for v, low in ((r["lon1"], 295.0), (r["lat1"], 33.0)))
        at = np.array([[x, y, r["t1"]], [x + 0.5, y, r["t1"]]])
        post = oi.Posterior(kernel, obs, np.array([r["y1"], r["y2"]]), np.array([0.01, 0.02]))
        factor, residual, _ = oi.low_rank(post, at, 2, 0)
        draw = post.sample(at[:1], np.array([[((r["i"] % 7) - 3) / 2]]))[0, 0]
        return [{"i": r["i"], "mean": post.mean(at)[0], "var": post.variance(at)[0], "cov": post.covariance(at, at)[0, 1], "draw": draw, "factor_var": (factor[0] ** 2).sum() + residual[0]}]

    return rounded(_each(rows, one, "i long, mean double, var double, cov double, draw double, factor_var double"), "mean", "var", "cov", "draw", "factor_var")


# Markov fields on the smallest lattice and mesh, one observation each.
_DAYS = "g AS (SELECT mission, floor(t)::BIGINT AS day, count(*) AS n, avg(sla) AS y, 0.01::DOUBLE AS r FROM obs GROUP BY 1, 2)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("mission", F.floor("t").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("sla").alias("y"))


_SQUARE = f"""{_DAYS}, h AS (SELECT *, 8 / pow(200.0::DOUBLE + 10 * day, 2) AS k2, pow(111.195 * cos(radians(0.5::DOUBLE)), 2) AS dx2, pow(111.195::DOUBLE, 2) AS dy2, (day % 4)::INT AS pt, r * exp(0.5::DOUBLE / 10) AS rr FROM g),
e AS (SELECT *, [k2, k2 + 2 / dx2, k2 + 2 / dy2, k2 + 2 / dx2 + 2 / dy2] AS l FROM h),
w AS (SELECT *, list_transform(l, lambda x: 1 / (x * x) * 0.05 / list_avg(list_transform(l, lambda z: 1 / (z * z)))) AS c FROM e),
n AS (SELECT w.*, node, [1, 1 - 2 * (node % 2), 1 - 2 * (node // 2), (1 - 2 * (node % 2)) * (1 - 2 * (node // 2))] AS sj, [1, 1 - 2 * (pt % 2), 1 - 2 * (pt // 2), (1 - 2 * (pt % 2)) * (1 - 2 * (pt // 2))] AS sk FROM w, (SELECT unnest(range(0, 4))::INT AS node)),
q AS (SELECT *, (c[1] + c[2] + c[3] + c[4]) / 4 AS ckk, (c[1] * sj[1] * sk[1] + c[2] * sj[2] * sk[2] + c[3] * sj[3] * sk[3] + c[4] * sj[4] * sk[4]) / 4 AS cjk, (c[1] * sj[1] + c[2] * sj[2] + c[3] * sj[3] + c[4] * sj[4]) / 4 AS cj0, (c[1] * sk[1] + c[2] * sk[2] + c[3] * sk[3] + c[4] * sk[4]) / 4 AS ck0 FROM n),
p AS (SELECT *, cjk * y / (ckk + rr) AS mean, ckk - cjk * cjk / (ckk + rr) AS var, cj0 - cjk * ck0 / (ckk + rr) AS cov0, cjk - cjk * ckk / (ckk + rr) AS covk, ckk - ckk * ckk / (ckk + rr) AS vark FROM q)"""


@query(f"WITH {OBS_SQL}, {_SQUARE} SELECT mission, day, node, {r6('mean')} AS mean, {r6('var')} AS var, {r6('cov0')} AS cov0, {r6('var')} AS drawn_var, {r6('node * 0.1::DOUBLE + covk / vark * (y - pt * 0.1)')} AS kriged FROM p")
def gmrf_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice of 2 by 2 nodes with an observation at one of them, for each mission and day: mean, variance,
    covariance with the first node, the variance that draws of unit vectors add up to, and a field moved by
    kriging so that it takes a given value at the observed node."""

    def one(r: dict) -> list[dict]:
        at = int(r["day"] % 4)
        lon, lat = np.array([0.0, 1.0]), np.array([-0.5, 0.5])
        f = gmrf.Field(lon, lat, np.array([[lon[at % 2], lat[at // 2], r["day"] + 0.5]]), np.array([r["y"]]), np.array([0.01]), float(r["day"]), 200.0 + 10 * r["day"], 0.05, 10.0)
        draws = np.stack([f.sample(z) - f.mean for z in np.eye(4)], 1)
        tile = coherent.TileDraw.of(f)
        moved = tile.conditioned(np.arange(4) * 0.1, {tile.keys[at]: r["y"]})
        cov = f.blocks.selected()[0][0][:, 0]
        return [{"mission": r["mission"], "day": r["day"], "node": k, "mean": f.mean[k], "var": f.variance()[k], "cov0": cov[k], "drawn_var": (draws[k] ** 2).sum(), "kriged": moved[k]} for k in range(4)]

    out = _each(_days(spark, sf_dir), one, "mission string, day long, node int, mean double, var double, cov0 double, drawn_var double, kriged double")
    return rounded(out, "mean", "var", "cov0", "drawn_var", "kriged")


_TRIANGLE = f"""{_DAYS}, h AS (SELECT *, 8 / pow(200.0::DOUBLE + 10 * day, 2) AS k2, pow(111.195::DOUBLE, 2) / 6 AS m, (day % 5) / 10.0::DOUBLE AS a, (n % 4) / 10.0::DOUBLE AS b FROM g),
c AS (SELECT *, 0.05 * 4 * pi() * k2 * m / pow(k2 * m, 2) AS c1, 0.05 * 4 * pi() * k2 * m / pow(k2 * m + 0.5, 2) AS c2, 0.05 * 4 * pi() * k2 * m / pow(k2 * m + 1.5, 2) AS c3 FROM h),
x AS (SELECT *, c1 / 3 + c3 * 4 / 6 AS c00, c1 / 3 - c3 * 2 / 6 AS c01, c1 / 3 + c2 / 2 + c3 / 6 AS c11, c1 / 3 - c2 / 2 + c3 / 6 AS c12 FROM c),
w AS (SELECT *, [c00 * (1 - a - b) + c01 * a + c01 * b, c01 * (1 - a - b) + c11 * a + c12 * b, c01 * (1 - a - b) + c12 * a + c11 * b] AS cw FROM x),
s AS (SELECT *, (1 - a - b) * cw[1] + a * cw[2] + b * cw[3] AS wcw FROM w),
p AS (SELECT s.*, node, cw[node + 1] AS cj, CASE WHEN node = 0 THEN c00 ELSE c11 END AS cjj FROM s, (SELECT unnest(range(0, 3))::INT AS node))"""


@query(f"WITH {OBS_SQL}, {_TRIANGLE} SELECT mission, day, node, {r6('cj * y / (wcw + r)')} AS mean, {r6('cjj - cj * cj / (wcw + r)')} AS var, 45.0::DOUBLE AS angle FROM p")
def fem_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One right triangle with an observation inside, for each mission and day."""
    nodes, triangles = np.array([[0.0, -1 / 3], [1.0, -1 / 3], [0.0, 2 / 3]]), np.array([[0, 1, 2]])

    def one(r: dict) -> list[dict]:
        a, b = (r["day"] % 5) / 10, (r["n"] % 4) / 10
        where = nodes[0] + a * (nodes[1] - nodes[0]) + b * (nodes[2] - nodes[0])
        mean, var = fem.solve(nodes, triangles, np.array([[*where, float(r["day"])]]), np.array([r["y"]]), np.array([0.01]), float(r["day"]), 200.0 + 10 * r["day"], 0.05, 10.0)
        return [{"mission": r["mission"], "day": r["day"], "node": k, "mean": mean[k], "var": var[k], "angle": fem.smallest_angle(nodes, triangles)} for k in range(3)]

    return rounded(_each(_days(spark, sf_dir), one, "mission string, day long, node int, mean double, var double, angle double"), "mean", "var", "angle")


# The multiscale basis with two observations of one pass.
def _taper(u: str) -> str:
    return f"(CASE WHEN abs({u}) < 1 THEN pow(cos(pi() * {u} / 2), 2) ELSE 0.0::DOUBLE END)"


def _gram(a: str, b: str) -> str:
    """Covariance of two points (suffixes) under the basis: phases add up to the cosine of a difference."""
    axes = []
    for axis, first, step, n, half in (("x", -800, 600, 4, 1200), ("y", -900, 600, 4, 1200), ("d", 0, 10, 4, 10)):
        u, v = (f"(({axis}{s} - ({first} + {step} * k)) / {half}.0::DOUBLE)" for s in (a, b))
        axes.append(f"list_sum([{_taper(u)} * {_taper(v)} for k in range(0, {n})])")
    waves = " + ".join(f"cos(2 * pi() / 800 * ((x{a} - x{b}) * cos(pi() * {m} / 4) + (y{a} - y{b}) * sin(pi() * {m} / 4)))" for m in range(4))
    return f"(0.01::DOUBLE * pow(800.0::DOUBLE / 300, 2) * ({waves}) * {' * '.join(axes)})"


_ENDS = """e AS (SELECT mission, floor(t)::BIGINT AS day, arg_min(struct_pack(lon, lat, t, sla), seq) AS p, arg_max(struct_pack(lon, lat, t, sla), seq) AS q FROM obs GROUP BY 1, 2 HAVING count(*) > 1),
k AS (SELECT mission, day, (p.lon - 300) * 111.32 * cos(radians(38.0::DOUBLE)) AS xa, (p.lat - 38) * 111.32 AS ya, p.t AS da, p.sla AS za, (q.lon - 300) * 111.32 * cos(radians(38.0::DOUBLE)) AS xb, (q.lat - 38) * 111.32 AS yb, q.t AS db, q.sla AS zb FROM e),
m AS (SELECT *, (xa + xb) / 2 AS xc, (ya + yb) / 2 AS yc, (da + db) / 2 AS dc FROM k)"""
_MIOST = f"""{_ENDS}, s AS (SELECT *, {_gram('a', 'a')} AS saa, {_gram('b', 'b')} AS sbb, {_gram('a', 'b')} AS sab, {_gram('c', 'a')} AS sca, {_gram('c', 'b')} AS scb FROM m),
t AS (SELECT *, saa + 0.01 + 0.03 AS ka, sbb + 0.01 + 0.03 AS kb, sab + 0.01 AS kc, saa + 0.01 AS ja, sbb + 0.01 AS jb FROM s),
u AS (SELECT *, (kb * za - kc * zb) / (ka * kb - kc * kc) AS wa, (ka * zb - kc * za) / (ka * kb - kc * kc) AS wb, (jb * za - sab * zb) / (ja * jb - sab * sab) AS va, (ja * zb - sab * za) / (ja * jb - sab * sab) AS vb FROM t)"""


@query(f"WITH {OBS_SQL}, {_MIOST} SELECT mission, day, round(saa * va + sab * vb, 5) + 0.0::DOUBLE AS plain, round(saa * wa + sab * wb, 5) + 0.0::DOUBLE AS structured, round(sca * wa + scb * wb, 5) + 0.0::DOUBLE AS middle FROM u")
def miost_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last observation of each mission and day under one wavelength: the field at the first one with plain
    errors, and there and half way with errors of a pass besides, whose bias and tilt both share."""
    end = F.struct("lon", "lat", "t", "sla")
    ends = observations(spark, sf_dir).groupBy("mission", F.floor("t").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min_by(end, "seq").alias("p"), F.max_by(end, "seq").alias("q")).where("n > 1")
    rows = ends.select("mission", "day", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "pq" for c in ("lon", "lat", "t", "sla")])
    basis = miost.Basis((-500.0, 500.0), (-600.0, 600.0), (800.0,), 4)
    els = basis.elements(0.0, 30.0)
    q = miost.prior_variance(els["lam"], 1.0, 2.0, 0.01)

    def one(r: dict) -> list[dict]:
        x, y = miost.to_km(np.array([r["lon_p"], r["lon_q"]]), np.array([r["lat_p"], r["lat_q"]]), 300.0, 38.0)
        t, z, r2 = np.array([r["t_p"], r["t_q"]]), np.array([r["sla_p"], r["sla_q"]]), np.full(2, 0.01)
        design = basis.design(els, x, y, t)

        def fields(triplets: tuple, prior: np.ndarray, at: tuple) -> np.ndarray:
            system = miost.Normal(triplets, 2, r2, prior)
            eta = miost.solution(system, system.right_side(z[:, None]), 1e-11)[: len(q), 0]
            row, column, value = at
            return np.bincount(row, value * eta[column], int(row.max()) + 1 if len(row) else 1)

        both, prior = miost.augmented(design, q, np.array([-1.0, 1.0]), np.array([7, 7]), 0.02, 0.01)
        middle = basis.design(els, x.mean(keepdims=True), y.mean(keepdims=True), t.mean(keepdims=True))
        return [{"mission": r["mission"], "day": r["day"], "plain": fields(design, q, design)[0], "structured": fields(both, prior, design)[0], "middle": fields(both, prior, middle)[0]}]

    out = _each(rows, one, "mission string, day long, plain double, structured double, middle double")
    return out.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("plain", "structured", "middle")})


@query(f"""WITH {OBS_SQL}, g AS (SELECT floor(t)::BIGINT AS day, count(*) AS n FROM obs GROUP BY 1), c AS (SELECT *, 2 * 4 * 4 * 4 * ceil((day + 5) / 10.0::DOUBLE)::BIGINT AS columns, n * 1.0::DOUBLE * 4 * 2 * 16 * 2 AS nonzeros FROM g)
SELECT day, columns, nonzeros, nonzeros * 24 + columns * 11.0::DOUBLE * 8 * 5 + 121 * 11.0::DOUBLE * 8 AS bytes, nonzeros * 24 + columns * 11.0::DOUBLE * 8 * 5 + 121 * 11.0::DOUBLE * 8 <= 2e6 AS fits FROM c""")
def miost_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a window from day 0 to each day would take, known before any solve, and whether a gate lets it pass."""
    basis = miost.Basis((-500.0, 500.0), (-600.0, 600.0), (800.0,), 4)

    def one(r: dict) -> list[dict]:
        size = miost.peak_bytes(basis, r["n"], 0.0, float(r["day"]), 10, 121)
        try:
            miost.gate(basis, r["n"], 0.0, float(r["day"]), 10, 121, 2e6)
            fits = True
        except MemoryError:
            fits = False
        return [{"day": r["day"], "columns": miost.n_coefficients(basis, 0.0, float(r["day"])), "nonzeros": miost.expected_nonzeros(basis, r["n"]), "bytes": size["total"], "fits": fits}]

    days = observations(spark, sf_dir).groupBy(F.floor("t").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return _each(days, one, "day long, columns long, nonzeros double, bytes double, fits boolean")


# What a product's stored rows give: a constant rank-one factor has closed forms for all of it.
_FACTOR = "f AS (SELECT seq, mission, floor(t)::BIGINT AS day, lat, sla, 0.1::DOUBLE + 0.01 * (seq % 10) AS f, 0.001::DOUBLE * (seq % 5) AS e FROM obs)"


@query(f"""WITH {OBS_SQL}, {_FACTOR}, d AS (SELECT *, lead(seq) OVER w AS seq2, lead(f) OVER w AS f2, lead(e) OVER w AS e2, lead(sla) OVER w AS sla2, lead(lat) OVER w AS lat2 FROM f WINDOW w AS (PARTITION BY mission, day ORDER BY seq))
SELECT seq AS a, seq2 AS b, {r6('f * f2')} AS cov, {r6('sla2 - sla')} AS step, {r6('f * f + e + f2 * f2 + e2 - 2 * f * f2')} AS step_var FROM d WHERE seq2 IS NOT NULL""")
def stored_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of stored factor rows as covariances of neighbours, and what they make of the variance of a difference."""
    rank1 = observations(spark, sf_dir).select(F.crc32("mission").bitwiseAND(0xFFFF).cast("int").alias("tile"), F.floor("t").cast("double").alias("time_days"), F.col("seq").alias("node_id"), "mission", "sla", (0.1 + 0.01 * (F.col("seq") % 10)).alias("f"), (0.001 * (F.col("seq") % 5)).alias("resid"))
    product = rank1.withColumn("factor", F.array(F.col("f").cast("double"))).withColumn("resid", F.col("resid").cast("double")).withColumn("mean", F.col("sla")).withColumn("var", F.col("f") * F.col("f") + F.col("resid"))
    nexts = F.lead("node_id").over(W.partitionBy("mission", "time_days").orderBy("node_id"))
    pairs = product.select(F.col("node_id").alias("a"), nexts.alias("b")).where("b IS NOT NULL")
    cov = plan.factor_covariance(product, pairs)
    side = lambda s: product.select(F.col("node_id").alias(s), F.col("mean").alias(f"m{s}"), F.col("var").alias(f"v{s}"))
    rows = cov.join(side("a"), "a").join(side("b"), "b")
    return rounded(rows.select("a", "b", "cov", (F.col("mb") - F.col("ma")).alias("step"), (F.col("va") + F.col("vb") - 2 * F.col("cov")).alias("step_var")), "cov", "step", "step_var")


# Runs of two observations a unit: first and last of one mission's days.
_TWO = """z AS (SELECT floor(t)::BIGINT AS day, arg_min(struct_pack(lon, lat, t, sla), seq) AS p, arg_max(struct_pack(lon, lat, t, sla), seq) AS q FROM obs WHERE mission = 'click' GROUP BY 1 HAVING count(*) > 1),
nn AS (SELECT iy * 11 + ix AS node_id, 295.0::DOUBLE + ix AS nlon, 33.0::DOUBLE + iy AS nlat FROM (SELECT unnest(range(0, 11)) AS iy), (SELECT unnest(range(0, 11)) AS ix)),
zz AS (SELECT day, day + 0.5::DOUBLE AS nt, node_id, nlon, nlat, p.lon AS lon1, p.lat AS lat1, p.t AS t1, p.sla AS y1, q.lon AS lon2, q.lat AS lat2, q.t AS t2, q.sla AS y2 FROM z, nn)"""
_N = ("nlon", "nlat", "nt")
_OI_DAYS = f"""{_TWO}, k AS (SELECT *, 0.06::DOUBLE AS kaa, {_k(_A, _B)} AS kab, {_k(_N, _A)} AS pa, {_k(_N, _B)} AS pb FROM zz), d AS (SELECT *, kaa * kaa - kab * kab AS det FROM k),
r AS (SELECT day, node_id, nlon, nlat, (pa * (kaa * y1 - kab * y2) + pb * (kaa * y2 - kab * y1)) / det AS mean, 0.05 - (pa * pa * kaa - 2 * pa * pb * kab + pb * pb * kaa) / det AS var FROM d)"""


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last observation of each day of one mission, where they differ."""
    obs = observations(spark, sf_dir).where("mission = 'click'").withColumn("day", F.floor("t"))
    ends = obs.groupBy("day").agg(F.min("seq").alias("_first"), F.max("seq").alias("_last")).where("_first < _last")
    return obs.join(ends, "day").where((F.col("seq") == F.col("_first")) | (F.col("seq") == F.col("_last"))).drop("day", "_first", "_last")


def _days_of(spark: SparkSession, sf_dir: str, method: str, **params: object) -> plan.Run:
    days = sorted(float(r[0]) + 0.5 for r in _two(spark, sf_dir).select(F.floor("t")).distinct().collect())  # a run's output times
    return plan.Run(method, GRID, tuple(days), dict(params), half_window=0.5, withheld="purchase")


@query(f"WITH {OBS_SQL}, {_OI_DAYS} SELECT day::INT AS day, nlat AS lat, nlon AS lon, {r6('mean')} AS ssh, {r6('var')} AS var FROM r")
def oi_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily maps of a whole run, each from two coupled observations."""
    return rounded(plan.maps(_two(spark, sf_dir), _days_of(spark, sf_dir, "oi"), 20.0), "ssh", "var")


@query(f"WITH {OBS_SQL}, {_OI_DAYS} SELECT day + 0.5::DOUBLE AS time_days, node_id, {r6('mean')} AS mean, {r6('var')} AS var, 4::BIGINT AS n_tiles FROM r")
def tiled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same run in four tiles whose halos hold everything: blending gives back what each of them has."""
    product = plan.run_tiled(_two(spark, sf_dir), _days_of(spark, sf_dir, "oi"), lonlat_tiles((295.0, 305.0), (33.0, 43.0), 2, 2, 5000.0))
    return rounded(product.select("time_days", "node_id", "mean", "var", "n_tiles"), "mean", "var")


@query(f"""WITH {OBS_SQL}, {_TWO}, w AS (SELECT *, 1 / (pow(nlon - lon1, 2) + pow(nlat - lat1, 2) + 1e-9) AS w1, 1 / (pow(nlon - lon2, 2) + pow(nlat - lat2, 2) + 1e-9) AS w2 FROM zz)
SELECT nt AS time_days, node_id, {r6('(w1 * y1 + w2 * y2) / (w1 + w2)')} AS mean FROM w""")
def trivial_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the perturbed inverse-distance ensemble: the unperturbed map."""
    return rounded(plan.run_single(_two(spark, sf_dir), _days_of(spark, sf_dir, "trivial", members=3)).select("time_days", "node_id", "mean"), "mean")


# The multiscale maps of two overlapping windows from two observations.
def _slots(a: str, b: str, start: int, n: int) -> str:
    u, v = (f"((d{s} - ({start} + 10 * k)) / 10.0::DOUBLE)" for s in (a, b))
    return f"list_sum([{_taper(u)} * {_taper(v)} for k in range(0, {n})])"


def _gram_box(a: str, b: str, start: int) -> str:
    """As ``_gram`` for the grid's own box and the slots of a window of 60 days."""
    parts = []
    for axis, half_span in (("x", 5 * 111.32 * float(np.cos(np.radians(38.0)))), ("y", 5 * 111.32)):
        n = len(np.arange(-half_span - 300, half_span + 600, 600.0))
        u, v = (f"(({axis}{s} - ({-half_span - 300!r}::DOUBLE + 600 * k)) / 1200.0::DOUBLE)" for s in (a, b))
        parts.append(f"list_sum([{_taper(u)} * {_taper(v)} for k in range(0, {n})])")
    waves = " + ".join(f"cos(2 * pi() / 800 * ((x{a} - x{b}) * cos(pi() * {m} / 4) + (y{a} - y{b}) * sin(pi() * {m} / 4)))" for m in range(4))
    return f"(0.01::DOUBLE * pow(800.0::DOUBLE / 300, 2) * ({waves}) * {' * '.join(parts)} * {_slots(a, b, start, 7)})"


def _window_sql(start: int) -> str:
    return f"""g{start} AS (SELECT *, {_gram_box('a', 'a', start)} + 0.01 AS ka, {_gram_box('b', 'b', start)} + 0.01 AS kb, {_gram_box('a', 'b', start)} AS kc, {_gram_box('c', 'a', start)} AS sca, {_gram_box('c', 'b', start)} AS scb FROM o),
v{start} AS (SELECT dc, node_id, (sca * (kb * za - kc * zb) + scb * (ka * zb - kc * za)) / (ka * kb - kc * kc) AS v FROM g{start})"""


@query(f"""WITH {OBS_SQL}, e AS (SELECT arg_min(struct_pack(lon, lat, t, sla), seq) AS p, arg_max(struct_pack(lon, lat, t, sla), seq) AS q FROM obs WHERE mission = 'click'),
o AS (SELECT iy * 11 + ix AS node_id, (p.lon - 300) * 111.32 * cos(radians(38.0::DOUBLE)) AS xa, (p.lat - 38) * 111.32 AS ya, p.t AS da, p.sla AS za, (q.lon - 300) * 111.32 * cos(radians(38.0::DOUBLE)) AS xb, (q.lat - 38) * 111.32 AS yb, q.t AS db, q.sla AS zb,
  (ix - 5) * 111.32 * cos(radians(38.0::DOUBLE)) AS xc, (iy - 5) * 111.32::DOUBLE AS yc, dc FROM e, (SELECT unnest(range(0, 11)) AS iy), (SELECT unnest(range(0, 11)) AS ix), (VALUES (5.0::DOUBLE), (20.0::DOUBLE), (27.5::DOUBLE)) t(dc)),
{_window_sql(0)}, {_window_sql(15)}
SELECT dc AS time_days, node_id, round(CASE WHEN dc < 15 THEN v0.v ELSE (1 - (dc - 15) / 45) * v0.v + (dc - 15) / 45 * v15.v END, 5) + 0.0::DOUBLE AS mean FROM v0 JOIN v15 USING (dc, node_id)""")
def window_maps_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiscale maps over two windows, solved apart and blended, from the first and last observation of a mission."""
    obs = observations(spark, sf_dir).where("mission = 'click'")
    first, last = obs.agg(F.min("seq"), F.max("seq")).first()
    run = plan.Run("miost", GRID, (5.0, 20.0, 27.5), {"wavelengths": (800.0,), "members": 2, "dt_days": 10.0}, withheld="purchase")
    maps = plan.window_maps(obs.where((F.col("seq") == first) | (F.col("seq") == last)), run, miost.Windows(0.0, 75.0))
    return maps.select("time_days", "node_id", (F.round("mean", 5) + F.lit(0.0)).alias("mean"))


# Keyed noise.
_M64 = "18446744073709551616::UHUGEINT"


def _polynomial(c: tuple[float, ...], x: str) -> str:
    out = f"({c[0]!r}::DOUBLE)"
    for a in c[1:]:
        out = f"({out} * {x} + ({a!r}::DOUBLE))"
    return out


_QUANTILE = f"""CASE WHEN p < 0.02425 THEN {_polynomial(noise._C, 'tl')} / {_polynomial((*noise._D, 1.0), 'tl')} WHEN p > 1 - 0.02425 THEN -{_polynomial(noise._C, 'th')} / {_polynomial((*noise._D, 1.0), 'th')}
ELSE {_polynomial(noise._A, 'r')} * q / {_polynomial((*noise._B, 1.0), 'r')} END"""
_MIX = "(xor({h}, {h} >> 30)::UHUGEINT * {k}::UHUGEINT % " + _M64 + ")::UBIGINT"
_EIGHT = "('0x' || substr(sha256({x}), 1, 16))::UBIGINT"


@query(f"""WITH {OBS_SQL}, seed AS (SELECT ({_EIGHT.format(x="'oi' || chr(31) || 'key' || chr(31) || 'w' || chr(31) || '3'")} >> 1) AS root),
s AS (SELECT kind, root, {_EIGHT.format(x="kind || chr(31) || '2' || chr(31) || root")} AS salt FROM seed, (VALUES ('obs'), ('coef'), ('err')) v(kind)),
h0 AS (SELECT seq, kind, root, xor(seq::UBIGINT, salt) AS h FROM obs, s),
h1 AS (SELECT seq, kind, root, {_MIX.format(h='h', k=0x9E3779B97F4A7C15)} AS h FROM h0), h2 AS (SELECT seq, kind, root, {_MIX.format(h='h', k=0xBF58476D1CE4E5B9)} AS h FROM h1),
h3 AS (SELECT seq, kind, root, {_MIX.format(h='h', k=0x94D049BB133111EB)} AS h FROM h2), u AS (SELECT seq, kind, root, ((xor(h, h >> 31) >> 11)::DOUBLE + 0.5) / 9007199254740992 AS p FROM h3),
v AS (SELECT *, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS r, sqrt(-2 * ln(p)) AS tl, sqrt(-2 * ln(1 - p)) AS th FROM u)
SELECT seq, kind, root::BIGINT AS root, {r6('sqrt(0.04::DOUBLE) * (' + _QUANTILE + ')')} AS noise FROM v""")
def keyed_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise of observations, coefficients and error modes: a function of identity, member, seed and kind alone."""
    root = noise.derive_seed("oi", "key", "w", 3)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind in ("obs", "coef", "err"):
                yield pd.DataFrame({"seq": pdf["seq"], "kind": kind, "root": root, "noise": noise.scaled_noise(pdf["seq"].to_numpy(), np.full(len(pdf), 0.04), 2, root, kind)})

    return rounded(observations(spark, sf_dir).select("seq").mapInPandas(run, "seq long, kind string, root long, noise double"), "noise")


# The spectrum of a small map.
_FIELD = """c AS (SELECT floor(t)::BIGINT AS day, least(floor((lon - 295) / 2.5), 3)::INT AS i, least(floor((lat - 33) / 2.5), 3)::INT AS j, avg(sla) AS v FROM obs GROUP BY 1, 2, 3),
a0 AS (SELECT * FROM (SELECT DISTINCT day FROM c), (SELECT unnest(range(0, 4))::INT AS i), (SELECT unnest(range(0, 4))::INT AS j)), f AS (SELECT a0.day, a0.i, a0.j, coalesce(c.v, 0) AS v FROM a0 LEFT JOIN c ON a0.day = c.day AND a0.i = c.i AND a0.j = c.j),
l AS (SELECT day, avg(v) AS m, sum((i - 1.5) * v) / 20 AS gx, sum((j - 1.5) * v) / 20 AS gy FROM f GROUP BY 1),
w AS (SELECT f.*, (v - m - gx * (i - 1.5) - gy * (j - 1.5)) * CASE WHEN sqrt(pow((i - 1.5) / 2, 2) + pow((j - 1.5) / 2, 2)) < 1 THEN 0.5 * (1 + cos(pi() * sqrt(pow((i - 1.5) / 2, 2) + pow((j - 1.5) / 2, 2)))) ELSE 0 END AS x FROM f JOIN l USING (day)),
k AS (SELECT a, b FROM (SELECT unnest(range(0, 3))::INT AS a), (SELECT unnest(range(0, 4))::INT AS b)),
p AS (SELECT day, a, b, sum(x * cos(2 * pi() * (a * i + b * j) / 4.0::DOUBLE)) AS re, sum(x * sin(2 * pi() * (a * i + b * j) / 4.0::DOUBLE)) AS im FROM w, k GROUP BY 1, 2, 3)"""


@query(f"WITH {OBS_SQL}, {_FIELD} SELECT day, a, b, {r6('(re * re + im * im) / 16 * CASE WHEN a = 1 THEN 2 ELSE 1 END')} AS power, {r6('a / 400.0::DOUBLE')} AS kx, {r6('(CASE WHEN b < 2 THEN b ELSE b - 4 END) / 444.0::DOUBLE')} AS ky FROM p")
def map_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-plane power of daily maps of 4 by 4 cells: detrended, tapered, transformed."""
    obs = observations(spark, sf_dir)
    cell = [F.least(F.floor((F.col(c) - low) / 2.5), F.lit(3)).cast("int").alias(n) for c, low, n in (("lon", 295.0, "i"), ("lat", 33.0, "j"))]
    cells = obs.groupBy(F.floor("t").alias("day"), *cell).agg(F.avg("sla").alias("v"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        field = np.zeros((4, 4))
        field[pdf["j"], pdf["i"]] = pdf["v"]
        power, kx, ky = spectra.power2d(spectra.detrend(field), spectra.radial_hann(4, 4), 100.0, 111.0)
        b, a = np.mgrid[0:4, 0:3]
        return pd.DataFrame({"day": key[0], "a": a.ravel(), "b": b.ravel(), "power": power.ravel(), "kx": kx.ravel(), "ky": ky.ravel()})

    return rounded(cells.groupBy("day").applyInPandas(one, "day long, a int, b int, power double, kx double, ky double"), "power", "kx", "ky")
