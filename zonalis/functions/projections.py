"""Coordinate transforms as Column expressions, by the closed formulas of EPSG Guidance Note 7-2."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS 80 ellipsoid and the parameters of EPSG 2154, 3035 and 27572.
A, FLAT = 6378137.0, 1 / 298.257222101
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)
LAMBERT_93 = {"lat0": 46.5, "lon0": 3.0, "lat1": 49.0, "lat2": 44.0, "x0": 700_000.0, "y0": 6_600_000.0}
LAEA = {"lat0": 52.0, "lon0": 10.0, "x0": 4_321_000.0, "y0": 3_210_000.0}
CLARKE = {"a": 6378249.2, "b": 6356515.0}
LAMBERT_2E = {"lat0": 46.8, "lon0": 2 + 20 / 60 + 14.025 / 3600, "k0": 0.99987742, "x0": 600_000.0, "y0": 2_200_000.0}
NTF_SHIFT = (-168.0, -60.0, 320.0)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """4326 to 3857."""
    return F.radians(lon) * A, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * A


def _t(phi, e: float, lib):
    if lib is math:
        return math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)
    s = F.sin(phi)
    return F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)


def _cone() -> tuple[float, float, float]:
    p = {k: math.radians(LAMBERT_93[k]) for k in ("lat0", "lat1", "lat2")}
    n = (math.log(_m(p["lat1"])) - math.log(_m(p["lat2"]))) / (math.log(_t(p["lat1"], E, math)) - math.log(_t(p["lat2"], E, math)))
    c = _m(p["lat1"]) / (n * _t(p["lat1"], E, math) ** n)
    return n, c, A * c * _t(p["lat0"], E, math) ** n


def _latitude(t: Column, e: float) -> Column:
    """Latitude of an isometric value by the series in the conformal latitude; exact to a micrometre."""
    chi = math.pi / 2 - 2 * F.atan(t)
    e2, e4, e6, e8 = e**2, e**4, e**6, e**8
    return (
        chi
        + (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) * F.sin(2 * chi)
        + (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520) * F.sin(4 * chi)
        + (7 * e6 / 120 + 81 * e8 / 1120) * F.sin(6 * chi)
        + (4279 * e8 / 161280) * F.sin(8 * chi)
    )


def lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    """4326 to 2154."""
    n, c, r0 = _cone()
    r = A * c * F.pow(_t(F.radians(lat), E, F), F.lit(n))
    theta = n * (F.radians(lon) - math.radians(LAMBERT_93["lon0"]))
    return LAMBERT_93["x0"] + r * F.sin(theta), LAMBERT_93["y0"] + r0 - r * F.cos(theta)


def from_lambert93(x: Column, y: Column) -> tuple[Column, Column]:
    """2154 to 4326."""
    n, c, r0 = _cone()
    dx, dy = x - LAMBERT_93["x0"], r0 - (y - LAMBERT_93["y0"])
    t = F.pow(F.hypot(dx, dy) / (A * c), F.lit(1 / n))
    return F.degrees(F.atan2(dx, dy) / n) + LAMBERT_93["lon0"], F.degrees(_latitude(t, E))


def _q(phi, lib):
    s = lib.sin(phi)
    ln = (lambda v: math.log(v)) if lib is math else F.log
    return (1 - E2) * (s / (1 - E2 * s * s) - (1 / (2 * E)) * ln((1 - E * s) / (1 + E * s)))


def laea(lon: Column, lat: Column) -> tuple[Column, Column]:
    """4326 to 3035."""
    phi0 = math.radians(LAEA["lat0"])
    qp = _q(math.pi / 2, math)
    beta0 = math.asin(_q(phi0, math) / qp)
    rq = A * math.sqrt(qp / 2)
    d = A * (math.cos(phi0) / math.sqrt(1 - E2 * math.sin(phi0) ** 2)) / (rq * math.cos(beta0))
    beta = F.asin(_q(F.radians(lat), F) / qp)
    turn = F.radians(lon) - math.radians(LAEA["lon0"])
    b = rq * F.sqrt(2 / (1 + math.sin(beta0) * F.sin(beta) + math.cos(beta0) * F.cos(beta) * F.cos(turn)))
    return LAEA["x0"] + b * d * F.cos(beta) * F.sin(turn), LAEA["y0"] + b / d * (math.cos(beta0) * F.sin(beta) - math.sin(beta0) * F.cos(beta) * F.cos(turn))


def from_laea(x: Column, y: Column) -> tuple[Column, Column]:
    """3035 to 4326."""
    phi0 = math.radians(LAEA["lat0"])
    qp = _q(math.pi / 2, math)
    beta0 = math.asin(_q(phi0, math) / qp)
    rq = A * math.sqrt(qp / 2)
    d = A * (math.cos(phi0) / math.sqrt(1 - E2 * math.sin(phi0) ** 2)) / (rq * math.cos(beta0))
    dx, dy = (x - LAEA["x0"]) / d, (y - LAEA["y0"]) * d
    rho = F.hypot(dx, dy)
    c = 2 * F.asin(rho / (2 * rq))
    beta = F.when(rho > 0, F.asin(F.cos(c) * math.sin(beta0) + dy * F.sin(c) * math.cos(beta0) / rho)).otherwise(F.lit(beta0))
    lon = F.atan2(dx * F.sin(c), rho * math.cos(beta0) * F.cos(c) - dy * math.sin(beta0) * F.sin(c))
    e4, e6 = E2**2, E2**3
    lat = beta + (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + (761 * e6 / 45360) * F.sin(6 * beta)
    return F.degrees(F.when(rho > 0, lon).otherwise(F.lit(0.0))) + LAEA["lon0"], F.degrees(lat)


def from_lambert2e(x: Column, y: Column) -> tuple[Column, Column]:
    """27572 to 4326: cone on the older ellipsoid, then the three-parameter shift."""
    a = CLARKE["a"]
    e2 = 1 - (CLARKE["b"] / a) ** 2
    e = math.sqrt(e2)
    phi0 = math.radians(LAMBERT_2E["lat0"])
    n = math.sin(phi0)
    r0 = LAMBERT_2E["k0"] * a / math.sqrt(1 - e2 * n * n) / math.tan(phi0)
    dx, dy = x - LAMBERT_2E["x0"], r0 - (y - LAMBERT_2E["y0"])
    t = F.pow(F.hypot(dx, dy) / r0, F.lit(1 / n)) * _t(phi0, e, math)
    lon = F.atan2(dx, dy) / n + math.radians(LAMBERT_2E["lon0"])
    lat = _latitude(t, e)
    v = a / F.sqrt(1 - e2 * F.pow(F.sin(lat), F.lit(2)))
    px, py = v * F.cos(lat) * F.cos(lon) + NTF_SHIFT[0], v * F.cos(lat) * F.sin(lon) + NTF_SHIFT[1]
    pz = v * (1 - e2) * F.sin(lat) + NTF_SHIFT[2]
    flat, b = F.hypot(px, py), A * (1 - FLAT)
    theta = F.atan2(pz * A, flat * b)
    cube = lambda c: F.pow(c, F.lit(3.0))
    out = F.atan2(pz + E2 / (1 - E2) * b * cube(F.sin(theta)), flat - E2 * A * cube(F.cos(theta)))
    return F.degrees(F.atan2(py, px)), F.degrees(out)
