"""Column expressions for positions, scales and covariances. All arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres per degree in kernels and tiling, and in orbit geometry; Earth's radius.
KM_PER_DEGREE, ORBIT_KM_PER_DEGREE, EARTH_KM, EARTH_M = 111.195, 111.32, 6371.0, 6371000.0


def real(x: float | Column) -> Column:
    """A double; literals like 295.0 would otherwise be decimals in SQL text."""
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def in_range(column: str | Column, low: float, high: float, closed: bool = True) -> Column:
    """Inclusive at both ends, or half-open."""
    c = F.col(column) if isinstance(column, str) else column
    return (c >= real(low)) & ((c <= real(high)) if closed else (c < real(high)))


def clamp(column: Column, low: float | Column, high: float | Column) -> Column:
    return F.least(F.greatest(column, real(low)), real(high))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def plane_km(lon: Column, lat: Column, lat0: float, lon0: float = 0.0, per_degree: float = ORBIT_KM_PER_DEGREE) -> tuple[Column, Column]:
    """Local plane: x scaled by the cosine of a reference latitude."""
    return (lon - real(lon0)) * per_degree * F.cos(F.radians(real(lat0))), (lat - real(lat0)) * per_degree


def separation_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Planar distance with the cosine of the mean latitude."""
    dx = (lon1 - lon2) * KM_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat1 - lat2) * KM_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def matern32(distance: Column, scale: float | Column) -> Column:
    z = F.sqrt(F.lit(3.0)) * distance / real(scale)
    return (1 + z) * F.exp(-z)


def matern_space_time(lon1: Column, lat1: Column, t1: Column, lon2: Column, lat2: Column, t2: Column, variance: float, length: float, time: float) -> Column:
    """Separable Matern-3/2 in kilometres and days."""
    return variance * matern32(separation_km(lon1, lat1, lon2, lat2), length) * matern32(F.abs(t1 - t2), time)


def gaussian_degrees(dlon: Column, dlat: Column, dt: Column, variance: float, lx: float, ly: float, lt: float) -> Column:
    """Gaussian covariance of raw degree and day differences."""
    return variance * F.exp(-F.pow(dlon / lx, 2) - F.pow(dlat / ly, 2) - F.pow(dt / lt, 2))


def latitude_shape(lat: Column) -> Column:
    """v = (clip(lat, 33, 43) - 38) / 5."""
    return (clamp(lat, 33, 43) - 38.0) / 5.0


def latitude_field(lat: Column, form: str, a0: float, a1: float, a2: float = 0.0) -> Column:
    """exp of a quadratic in v (``exp_quad``), or a0 times exp of a1 v (``exp_linear_mult``)."""
    v = latitude_shape(lat)
    if form == "exp_quad":
        return F.exp(a0 + a1 * v + a2 * v * v)
    if form == "exp_linear_mult":
        return a0 * F.exp(a1 * v)
    raise ValueError(f"unknown form {form!r}")


def paciorek_degrees(lon1: Column, lat1: Column, t1: Column, lon2: Column, lat2: Column, t2: Column, l1: Column, l2: Column, s1: Column, s2: Column, lt: float) -> Column:
    """Nonstationary Gaussian: isotropic lengths l1, l2 at the two points and their standard deviations."""
    mean = (l1 * l1 + l2 * l2) / 2
    d2 = F.pow(lon1 - lon2, 2) + F.pow(lat1 - lat2, 2)
    return s1 * s2 * (l1 * l2 / mean) * F.exp(-d2 / mean) * F.exp(-F.pow((t1 - t2) / lt, 2))


def kappa_from_range(range_km: Column) -> Column:
    return F.sqrt(F.lit(8.0)) / range_km


def range_from_kappa(kappa: Column) -> Column:
    return F.sqrt(F.lit(8.0)) / kappa


def smootherstep(t: Column) -> Column:
    """6 t^5 - 15 t^4 + 10 t^3 on [0, 1]."""
    c = clamp(t, 0, 1)
    return c * c * c * (c * (c * 6.0 - 15.0) + 10.0)


def polar_stereographic(lon: Column, lat: Column, lat_ts: float = 70.0, lon0: float = -45.0) -> tuple[Column, Column]:
    """North polar stereographic metres on a sphere, true at latitude lat_ts."""
    k = (1 + F.sin(F.radians(real(lat_ts)))) / 2
    rho = 2 * EARTH_M * k * F.tan(F.radians(45.0 - lat / 2))
    angle = F.radians(lon - lon0)
    return rho * F.sin(angle), -rho * F.cos(angle)


def inverse_polar_stereographic(x: Column, y: Column, lat_ts: float = 70.0, lon0: float = -45.0) -> tuple[Column, Column]:
    k = (1 + F.sin(F.radians(real(lat_ts)))) / 2
    rho = F.sqrt(x * x + y * y)
    return F.degrees(F.atan2(x, -y)) + lon0, 90.0 - 2 * F.degrees(F.atan(rho / (2 * EARTH_M * k)))
