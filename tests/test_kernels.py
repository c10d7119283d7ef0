"""Kernels against dense algebra, closed forms and invariants."""

from __future__ import annotations

import numpy as np
import pytest

from swathkit.kernels import covariance, fem, gmrf, miost, noise, oi, spectra

RNG = np.random.default_rng(0)
OBS = np.column_stack([RNG.uniform(295, 300, 40), RNG.uniform(33, 38, 40), RNG.uniform(0, 5, 40)])
Y = RNG.standard_normal(40) * 0.1
NOISE = np.full(40, 0.01)
LON, LAT = np.arange(295.0, 300.5, 1.0), np.arange(33.0, 38.5, 1.0)
AT = np.array([(x, y, 2.0) for y in LAT for x in LON])


@pytest.mark.parametrize("kernel", [covariance.matern_space_time(0.05, 300.0, 10.0), covariance.gaussian_degrees(0.05, 1.0, 1.5, 7.0), covariance.paciorek_degrees(lambda lat: 1 + (lat - 33) / 10, lambda lat: np.full(len(lat), 0.2), 7.0)])
def test_oi_is_the_dense_posterior(kernel):
    post = oi.Posterior(kernel, OBS, Y, NOISE)
    k, kx = kernel(OBS, OBS) + np.diag(NOISE), kernel(AT, OBS)
    np.testing.assert_allclose(post.mean(AT), kx @ np.linalg.solve(k, Y), atol=1e-10)
    dense = kernel(AT, AT) - kx @ np.linalg.solve(k, kx.T)
    np.testing.assert_allclose(post.covariance(AT, AT), dense, atol=1e-10)
    np.testing.assert_allclose(post.variance(AT), np.diag(dense), atol=1e-10)
    factor, residual, captured = oi.low_rank(post, AT, len(AT), 1)
    np.testing.assert_allclose((factor**2).sum(1) + residual, np.diag(dense), atol=1e-8)
    assert 0.5 < captured <= 1 + 1e-9


def test_oi_relaxes_to_the_prior_far_away():
    post = oi.Posterior(covariance.matern_space_time(0.05, 50.0, 10.0), OBS, Y, NOISE)
    far = np.array([[340.0, 60.0, 2.0]])
    assert abs(post.variance(far)[0] - 0.05) < 1e-9 and abs(post.mean(far)[0]) < 1e-9
    assert oi.Posterior(covariance.gaussian_degrees(0.05, 1, 1, 1), np.zeros((0, 3)), Y[:0], NOISE[:0]).variance(far)[0] == 0.05


def test_posterior_samples_have_the_posterior_moments():
    post = oi.Posterior(covariance.matern_space_time(0.05, 300.0, 10.0), OBS, Y, NOISE)
    z = noise.normals(np.arange(len(AT) * 4000), 0, 1).reshape(len(AT), 4000)
    draws = post.sample(AT, z)
    np.testing.assert_allclose(draws.mean(1), post.mean(AT), atol=0.01)
    np.testing.assert_allclose(draws.var(1), post.variance(AT), rtol=0.12)


def test_block_factor_equals_dense_inverse():
    sparse = gmrf.precision(LON, LAT, 300.0, 0.05)
    q, blocks = sparse.dense(), gmrf.Blocks(sparse)
    inverse = np.linalg.inv(q)
    np.testing.assert_allclose(blocks.variance(), np.diag(inverse), rtol=1e-8)
    assert abs(blocks.variance().mean() - 0.05) < 1e-9
    b = RNG.standard_normal(len(q))
    np.testing.assert_allclose(blocks.solve(b), np.linalg.solve(q, b), rtol=1e-7, atol=1e-10)
    _, beside = blocks.selected()
    s = 2 * len(LON)
    np.testing.assert_allclose(beside[0], inverse[:s, s : 2 * s], rtol=1e-6, atol=1e-12)


def test_gmrf_field_equals_dense_update():
    f = gmrf.Field(LON, LAT, OBS, Y, NOISE, 2.0, 300.0, 0.05, 10.0)
    nodes, w = gmrf.bilinear(LON, LAT, OBS[:, 0], OBS[:, 1])
    a = np.zeros((len(Y), len(LON) * len(LAT)))
    for k in range(4):
        np.add.at(a, (np.arange(len(Y)), nodes[:, k]), w[:, k])
    np.testing.assert_allclose(a.sum(1), 1)
    r = NOISE * np.exp(np.abs(OBS[:, 2] - 2.0) / 10.0)
    q = gmrf.precision(LON, LAT, 300.0, 0.05).dense() + a.T @ (a / r[:, None])
    np.testing.assert_allclose(f.mean, np.linalg.solve(q, a.T @ (Y / r)), atol=1e-9)
    np.testing.assert_allclose(f.variance(), np.diag(np.linalg.inv(q)), rtol=1e-7)
    z = noise.normals(np.arange(len(q) * 3000), 0, 3).reshape(len(q), 3000)
    draws = np.stack([f.sample(c) for c in z.T], 1)
    np.testing.assert_allclose(draws.var(1), f.variance(), rtol=0.15)


def test_fem_mesh_and_solution():
    nodes, triangles = fem.structured_mesh(LON, LAT)
    assert fem.smallest_angle(nodes, triangles) == pytest.approx(45)
    mass, i, j, value = fem.elements(nodes, triangles)
    stiff = np.zeros((len(nodes), len(nodes)))
    np.add.at(stiff, (i, j), value)
    assert mass.sum() == pytest.approx(25) and abs(stiff.sum(1)).max() < 1e-12
    at, w = fem.barycentric(nodes, triangles, np.array([[296.3, 34.4], [250.0, 0.0]]))
    np.testing.assert_allclose((nodes[at[0]] * w[0][:, None]).sum(0), [296.3, 34.4])
    assert at[1][0] == 0
    mean, var = fem.solve(nodes, triangles, OBS, Y, NOISE, 2.0, 300.0, 0.05, 10.0)
    prior = np.diag(np.linalg.inv(fem.precision(nodes, triangles, 300.0, 0.05).dense()))
    assert (var < prior).all() and np.isfinite(mean).all()
    # The same by blocks of two rows, and against the definition.
    rows = fem.solve(nodes, triangles, OBS, Y, NOISE, 2.0, 300.0, 0.05, 10.0, row=len(LON))
    np.testing.assert_allclose(rows[0], mean, atol=1e-9)
    np.testing.assert_allclose(rows[1], var, rtol=1e-7)
    km = nodes * np.array([fem.KM_PER_DEGREE * np.cos(np.radians(nodes[:, 1].mean())), fem.KM_PER_DEGREE])
    mass, i, j, value = fem.elements(km, triangles)
    a = np.diag(8.0 / 300.0**2 * mass)
    np.add.at(a, (i, j), value)
    q = a @ np.diag(1 / mass) @ a / (0.05 * 4 * np.pi * 8.0 / 300.0**2)
    np.testing.assert_allclose(fem.precision(nodes, triangles, 300.0, 0.05, len(LON)).dense(), q, rtol=1e-9, atol=1e-9 * abs(q).max())


@pytest.mark.parametrize("shape", [(2, 2), (3, 4), (4, 3), (5, 2), (6, 3)])
def test_lattice_precision_equals_its_definition(shape):
    lat, lon = 33 + np.arange(shape[0]), 295 + np.arange(shape[1])
    dx, dy = gmrf.spacing(lon, lat)
    n = shape[0] * shape[1]
    l = np.zeros((n, n))  # noqa: E741
    for j in range(shape[0]):
        for i in range(shape[1]):
            for jj, ii, h in ((j, i - 1, dx[j]), (j, i + 1, dx[j]), (j - 1, i, dy), (j + 1, i, dy)):
                if 0 <= jj < shape[0] and 0 <= ii < shape[1]:
                    l[j * shape[1] + i, jj * shape[1] + ii] += 1 / h**2
                    l[j * shape[1] + i, j * shape[1] + i] -= 1 / h**2
    np.testing.assert_allclose(gmrf.laplacian(*shape, dx, dy).dense(), l, atol=1e-15)
    a = 8.0 / 200.0**2 * np.eye(n) - l
    q = a.T @ a
    np.testing.assert_allclose(gmrf.precision(lon, lat, 200.0, 0.05).dense(), q * np.trace(np.linalg.inv(q)) / n / 0.05, rtol=1e-8, atol=1e-9)


def test_delaunay_has_empty_circles():
    points = RNG.uniform(0, 1, (30, 2))
    triangles = fem.delaunay(points)
    for t in triangles:
        a, b, c = points[t]
        m = 2 * np.array([b - a, c - a])
        centre = np.linalg.solve(m, [(b @ b) - (a @ a), (c @ c) - (a @ a)])
        r2 = ((a - centre) ** 2).sum()
        assert (((points - centre) ** 2).sum(1) >= r2 * (1 - 1e-9)).all()
    assert set(triangles.ravel()) == set(range(30))


def test_conjugate_gradients_equal_the_dense_solution():
    basis = miost.Basis((-250, 250), (-250, 250), (800.0, 400.0), 2)
    els = basis.elements(0, 20)
    x, y = miost.to_km(OBS[:, 0], OBS[:, 1], 297.5, 35.5)
    triplets = basis.design(els, x, y, OBS[:, 2])
    q = miost.prior_variance(els["lam"], 1.0, 2.0, 0.01)
    system = miost.Normal(triplets, 40, NOISE, q)
    assert len(q) == miost.n_coefficients(basis, 0, 20)
    g = np.zeros((40, len(q)))
    np.add.at(g, triplets[:2], triplets[2])
    a = g.T @ (g / NOISE[:, None]) + np.diag(1 / q)
    sides = miost.member_sides(system, Y, np.arange(40), np.arange(len(q)), 2, 5)
    solution, steps, worst = miost.conjugate_gradient(system, sides, rtol=1e-10, most=3000)
    np.testing.assert_allclose(solution, np.linalg.solve(a, sides), rtol=1e-5, atol=1e-8)
    assert worst <= 1e-10 and steps > 1
    np.testing.assert_allclose(system.diagonal, np.diag(a))


def test_structured_error_modes():
    row, column, value, prior = miost.pass_modes(np.array([-1.0, 0.0, 1.0]), np.array([4, 4, 9]), 0.1, 0.2)
    assert list(column) == [0, 0, 2, 1, 1, 3] and list(value) == [1, 1, 1, -1, 0, 1] and list(prior) == [0.1, 0.2, 0.1, 0.2]


def test_windows_cover_with_unit_weight():
    plan = miost.Windows(0, 200)
    assert plan.all()[-1] == (140, 200)
    for day in range(201):
        assert sum(w for _, w in plan.covering(day)) == pytest.approx(1)
    assert miost.peak_bytes(miost.Basis((0, 100), (0, 100)), 100, 0, 60, 10, 50)["total"] > 0


@pytest.mark.parametrize("shape", [(8, 8), (7, 9), (9, 8), (6, 7)])
def test_power_keeps_energy(shape):
    f, w = RNG.standard_normal(shape), spectra.radial_hann(*shape)
    p, kx, ky = spectra.power2d(f, w, 1.0, 1.0)
    assert p.sum() == pytest.approx(((f * w) ** 2).sum())
    k, power, n = spectra.rings(p, kx, ky, 0.1)
    assert power.sum() == pytest.approx(p.sum()) and n.sum() == p.size
    j, i = np.mgrid[0 : shape[0], 0 : shape[1]]
    assert abs(spectra.detrend(3 + 2 * i - j.astype(float))).max() < 1e-10
    assert spectra.mainlobe_bins(w) > 0


def test_spectral_masks_slopes_and_resolution():
    kx, ky = np.meshgrid(np.linspace(-1, 1, 21), np.linspace(-1, 1, 21))
    wedge = spectra.wedge(kx, ky, 0, 11, 0.25, 0.85)
    assert wedge.sum() and (wedge <= spectra.annulus(kx, ky, 0.25, 0.85)).all() and (wedge == wedge[::-1, ::-1]).all()
    k = np.arange(1, 40) / 40
    slope, error = spectra.slope(k, 5 * k**-3.0, np.ones(39, int), 0.1, 0.9)
    assert slope == pytest.approx(-3) and error < 1e-6
    x = np.arange(256)
    signal = [np.sin(2 * np.pi * x / 64) + np.sin(2 * np.pi * x / 8)]
    lam = spectra.resolved_wavelength(signal, [0.9 * np.sin(2 * np.pi * x / 8)], 7.0)
    assert 8 * 7 < lam < 64 * 7
    assert spectra.resolved_wavelength(signal, signal, 7.0) == np.inf and np.isnan(spectra.resolved_wavelength([], [], 7.0))


def test_keyed_noise():
    z = noise.normals(np.arange(200_000), 3, 4)
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01 and (z == noise.normals(np.arange(200_000), 3, 4)).all()
    assert not np.allclose(z[:50], noise.normals(np.arange(50), 4, 4)) and not np.allclose(z[:50], noise.normals(np.arange(50), 3, 4, "coef"))
    assert noise.derive_seed("oi", "p", "w", 1) != noise.derive_seed("oi", "p", "w", 2) and 0 <= noise.derive_seed("a", "b", "c", 0) < 1 << 63
    np.testing.assert_allclose(noise.normal_quantile(np.array([0.5, 0.975, 0.001])), [0, 1.959964, -3.090232], atol=1e-5)
    assert (noise.lattice_identity([295.25, 296.0], [33.0, 34.0], 0.25) == noise.lattice_identity([295.25, 296.0], [33.0, 34.0], 0.25)).all()


def lattice_tiles(halo=2):
    from swathkit.kernels.coherent import TileDraw

    lon, lat = np.arange(295.0, 304.5), np.arange(33.0, 37.5)
    west, east = lon[: 5 + halo], lon[5 - halo :]
    fields = []
    for x in (west, east):
        inside = (OBS[:, 0] >= x[0]) & (OBS[:, 0] <= x[-1]) & (OBS[:, 1] <= lat[-1])
        fields.append(gmrf.Field(x, lat, OBS[inside], Y[inside], NOISE[inside], 2.0, 200.0, 0.05, 10.0))
    return [TileDraw.of(f) for f in fields]


@pytest.mark.parametrize("driver", ["tree_members", "chain_members"])
def test_conditioned_tiles_agree_and_keep_their_covariance(driver):
    from swathkit.kernels import coherent

    tiles = lattice_tiles()
    assert coherent.overlaps(tiles) == [(0, 1, 20)]
    draws = [getattr(coherent, driver)(tiles, m, "p") for m in range(1500)]
    for a, b in draws[:20]:
        left, right = dict(zip(tiles[0].keys, a, strict=True)), dict(zip(tiles[1].keys, b, strict=True))
        np.testing.assert_allclose([left[k] for k in left if k in right], [right[k] for k in left if k in right], atol=1e-8)
    first = np.stack([d[0] for d in draws], 1)
    np.testing.assert_allclose(first.var(1), tiles[0].field.variance(), rtol=0.2)
    alone = np.stack([tiles[1].alone(1, m, "p") for m in range(1500)], 1)
    np.testing.assert_allclose(alone.var(1), tiles[1].field.variance(), rtol=0.2)


def test_owner_and_shared_basis_drivers():
    from swathkit.kernels import coherent

    tiles = lattice_tiles()
    owner = {k: int(k[0] > 299.5) for t in tiles for k in t.keys}
    a, b = coherent.owner_members(tiles, owner, 0, "p")
    left, right = dict(zip(tiles[0].keys, a, strict=True)), dict(zip(tiles[1].keys, b, strict=True))
    assert all(left[k] == right[k] for k in left if k in right)
    f = RNG.standard_normal((12, 3))
    rotation = np.linalg.qr(RNG.standard_normal((3, 3)))[0]
    half = np.full(12, 0.5)
    draws = np.stack([coherent.shared_basis_field([f, f @ rotation], np.stack([half, half]), m, "oi", "p") for m in range(3000)], 1)
    np.testing.assert_allclose(np.cov(draws), f @ f.T, atol=0.5)  # a rotated factor is the same field
    assert coherent.select_driver("precision") == "tree_members" and coherent.select_driver("?") == "independent"


def test_evaluation_rows_and_regrid():
    from swathkit.kernels import ensembles

    post = oi.Posterior(covariance.matern_space_time(0.05, 300.0, 10.0), OBS, Y, NOISE)
    factor, resid, _ = oi.low_rank(post, AT, len(AT), 0)
    points = AT[[3, 17]]
    rows, left = ensembles.evaluation_rows(post, points, AT, factor)
    np.testing.assert_allclose(rows @ factor.T, post.covariance(points, AT), atol=1e-6)
    assert (left < 1e-5).all()
    x, y = AT[:, 0] * 0.5 + 148.75, AT[:, 1]
    mean, new, rest = ensembles.regrid(LON, LAT, post.mean(AT), factor, resid, x, y, 10, members=3000)
    nodes, w = gmrf.bilinear(LON, LAT, x, y)
    cov = factor @ factor.T + np.diag(resid)
    exact = [w[i] @ cov[np.ix_(nodes[i], nodes[i])] @ w[i] for i in range(len(x))]
    np.testing.assert_allclose((new**2).sum(1) + rest, exact, rtol=0.15)


def test_members_partitions_and_nulls():
    from swathkit.kernels import ensembles
    from swathkit.operators.evaluate import expected_ratio

    assert len(set(ensembles.choose_members(10, 4, 1))) == 4
    with pytest.raises(ValueError):
        ensembles.choose_members(3, 4, 1)
    parts = ensembles.disjoint_partitions(8, 3, 20, 2)
    assert parts.shape == (20, 2, 3) and all(not set(a) & set(b) for a, b in parts.tolist())
    with pytest.raises(ValueError):
        ensembles.disjoint_partitions(4, 2, 4, 0)
    t = ensembles.null_ratios(10, 400, 300, 0)
    c4 = expected_ratio(10)
    assert t.mean() == pytest.approx(np.sqrt(2 * 9 * (1 - c4 * c4)), rel=0.05)
    assert ensembles.independent_nodes(np.broadcast_to(RNG.standard_normal((1, 6, 7)), (5, 6, 7))) < 60
    assert ensembles.independent_nodes(RNG.standard_normal((12, 12, 12))) > 1000
    q = gmrf.precision(LON, LAT, 300.0, 0.05)
    back = np.zeros((len(q), len(q)))
    for i, j, v in ensembles.coo(q):
        back[i, j] = back[j, i] = v
    np.testing.assert_array_equal(back, q.dense())


def test_scattered_plane_is_recovered():
    from swathkit.kernels import ensembles

    x, y = RNG.uniform(0, 10, 200), RNG.uniform(0, 10, 200)
    at = np.array([[3.0, 4.0], [5.5, 6.5], [50.0, 50.0]])
    got = ensembles.scattered_to_grid(x, y, 2 * x - y, at)
    np.testing.assert_allclose(got[:2], [2.0, 4.5], atol=1e-9)
    assert got[2] == (2 * x - y)[((np.column_stack([x, y]) - at[2]) ** 2).sum(1).argmin()]


def test_scattered_values_take_all_points():
    from swathkit.kernels import ensembles

    rng = np.random.default_rng(8)
    points = np.concatenate([rng.uniform(0, 10, (1500, 2)), rng.normal(3, 0.05, (800, 2))])
    value = np.sin(points[:, 0]) + points[:, 1] ** 2
    at = np.concatenate([rng.uniform(0.5, 9.5, (200, 2)), [[-4.0, 5.0]]])
    triangles = fem.delaunay(points)
    nodes, w = fem.barycentric(points, triangles, at)
    got = ensembles.scattered_to_grid(*points.T, value, at)
    np.testing.assert_allclose(got, (value[nodes] * w).sum(1), atol=1e-9)


def test_structured_errors_equal_a_dense_posterior():
    """Basis and pass errors together: the field is that of the covariance G Q G' with errors R + B L B'."""
    rng = np.random.default_rng(4)
    n = 60
    x, y, t = rng.uniform(0, 600, n), rng.uniform(0, 600, n), rng.uniform(0, 8, n)
    passes, s = np.repeat(np.arange(6) * 11, 10), np.tile(np.linspace(-1, 1, 10), 6)
    basis = miost.Basis((0.0, 600.0), (0.0, 600.0), (600.0,), 2)
    els = basis.elements(0.0, 10.0)
    q, r, obs = np.full(len(els["x"]), 0.02), np.full(n, 0.01), rng.standard_normal(n) * 0.1
    design = basis.design(els, x, y, t)
    both, q2 = miost.augmented(design, q, s, passes, 0.03, 0.02)
    system = miost.Normal(both, n, r, q2)
    eta = miost.solution(system, system.right_side(obs[:, None]), 1e-12)[: len(q), 0]
    g = np.zeros((n, len(q)))
    np.add.at(g, design[:2], design[2])
    b = np.zeros((n, 12))
    for k in range(6):
        b[passes == k * 11, 2 * k], b[passes == k * 11, 2 * k + 1] = 1, s[passes == k * 11]
    cov = g * q @ g.T
    total = cov + np.diag(r) + b @ np.diag(np.tile([0.03, 0.02], 6)) @ b.T
    np.testing.assert_allclose(g @ eta, cov @ np.linalg.solve(total, obs), atol=1e-8)
    sides = miost.member_sides(system, obs, np.arange(n), np.arange(len(q)), 400, 1, np.arange(12) + 1000)
    fields = g @ miost.solution(system, sides, 1e-8)[: len(q)]
    exact = np.diag(cov - cov @ np.linalg.solve(total, cov))
    np.testing.assert_allclose(fields[:, 1:].var(1).mean(), exact.mean(), rtol=0.1)


def test_a_solve_reports_and_resumes():
    rng = np.random.default_rng(5)
    basis = miost.Basis((0.0, 500.0), (0.0, 500.0), (500.0,), 2)
    els = basis.elements(0.0, 10.0)
    design = basis.design(els, rng.uniform(0, 500, 40), rng.uniform(0, 500, 40), rng.uniform(0, 8, 40))
    system = miost.Normal(design, 40, np.full(40, 0.01), np.full(len(els["x"]), 0.05))
    b = system.right_side(rng.standard_normal((40, 2)))
    whole = miost.Descent.begin(system, b).run(system, 1e-10, 500)
    part = miost.Descent.begin(system, b).run(system, 1e-10, 7)
    assert part.iterations == 7 and part.residuals.max() > 1e-10
    part.run(system, 1e-10, 500)
    np.testing.assert_array_equal(part.x, whole.x)
    with pytest.raises(ArithmeticError, match="after 3 iterations"):
        miost.solution(system, b, 1e-10, 3)
    with pytest.raises(MemoryError):
        miost.gate(basis, 10_000, 0.0, 60.0, 100, 2000, 1e6)


def test_independent_members_are_a_driver():
    from swathkit.kernels import coherent

    lat = np.linspace(33, 36, 4)
    fields = [gmrf.Field(x, lat, np.zeros((0, 3)), np.zeros(0), np.zeros(0), 2.0, 200.0, 0.05, 10.0) for x in (np.linspace(295, 298, 4), np.linspace(297, 300, 4))]
    tiles = [coherent.TileDraw.of(f) for f in fields]
    members = getattr(coherent, coherent.select_driver("unknown"))(tiles, 0, "p")
    assert [len(m) for m in members] == [16, 16] and not np.allclose(members[0][2], members[1][0])
