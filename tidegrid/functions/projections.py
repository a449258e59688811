"""Coordinate systems as column expressions: transverse Mercator, Lambert conic and polar stereographic projections of any ellipsoid, spherical Mercator,
and datum shifts of seven parameters. Everything goes through a hub, degrees of WGS 84; nothing runs in Python."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: fixed values: ellipsoids, as half axis in metres and inverse flattening
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563),
    "GRS80": (6378137.0, 298.257222101),
    "Clarke1866": (6378206.4, 294.978698214),
    "Airy1830": (6377563.396, 299.3249646),
    "International1924": (6378388.0, 297.0),
    "Bessel1841": (6377397.155, 299.1528128),
}


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float

    @classmethod
    def of(cls, name: str) -> Ellipsoid:
        a, inverse = ELLIPSOIDS[name]
        return cls(a, 1 / inverse)

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)


@dataclass(frozen=True)
class System:
    """kind: degrees, mercator, tm, lambert or polar; places in degrees and metres (`unit`: metres of one of the system's). `shift`: the seven parameters of a
    position vector shift to WGS 84 (metres, seconds, parts in a million)."""

    kind: str
    ellipsoid: str = "WGS84"
    lon: float = 0.0
    lat: float = 0.0
    parallels: tuple[float, ...] = ()
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    unit: float = 1.0
    shift: tuple[float, ...] = ()


#: fixed values: systems by EPSG code; those of UTM zones follow from a rule, see `system`
SYSTEMS = {
    4326: System("degrees"),
    4269: System("degrees", "GRS80"),
    4258: System("degrees", "GRS80"),
    3857: System("mercator"),
    2154: System("lambert", "GRS80", 3.0, 46.5, (49.0, 44.0), 1.0, 700000.0, 6600000.0),
    3034: System("lambert", "GRS80", 10.0, 52.0, (35.0, 65.0), 1.0, 4000000.0, 2800000.0),
    3347: System("lambert", "GRS80", -91.0 - 52 / 60, 63.390675, (49.0, 77.0), 1.0, 6200000.0, 3000000.0),
    3031: System("polar", "WGS84", 0.0, -71.0),
    3413: System("polar", "WGS84", -45.0, 70.0),
    27700: System("tm", "Airy1830", -2.0, 49.0, (), 0.9996012717, 400000.0, -100000.0, 1.0, (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)),
    31467: System("tm", "Bessel1841", 9.0, 0.0, (), 1.0, 3500000.0, 0.0, 1.0, (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)),
}


def system(name: str | int | System) -> System:
    """A system by its code ("EPSG:32631", 32631), by "geographic" or "mercator", or as it is. UTM zones: 326zz and 327zz on WGS 84, 269zz on NAD 83, 258zz on ETRS 89."""
    if isinstance(name, System):
        return name
    named = {"geographic": 4326, "mercator": 3857}.get(str(name).lower(), name)
    code = int(str(named).upper().removeprefix("EPSG:"))
    if code in SYSTEMS:
        return SYSTEMS[code]
    family, zone = divmod(code, 100)
    if family in (326, 327, 269, 258) and 1 <= zone <= 60:
        return System("tm", "WGS84" if family in (326, 327) else "GRS80", 6.0 * zone - 183, 0.0, (), 0.9996, 500000.0, 1e7 if family == 327 else 0.0)
    raise ValueError(f"no system {name}")


def _series(n: float) -> tuple[list[float], list[float], list[float]]:
    """Kruger's coefficients: to the plane, from it, and from the conformal to the geographic latitude."""
    n2, n3, n4 = n * n, n**3, n**4
    to = [n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180, 13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440, 61 * n3 / 240 - 103 * n4 / 140, 49561 * n4 / 161280]
    back = [n / 2 - 2 * n2 / 3 + 37 * n3 / 96 - n4 / 360, n2 / 48 + n3 / 15 - 437 * n4 / 1440, 17 * n3 / 480 - 37 * n4 / 840, 4397 * n4 / 161280]
    lat = [2 * n - 2 * n2 / 3 - 2 * n3 + 116 * n4 / 45, 7 * n2 / 3 - 8 * n3 / 5 - 227 * n4 / 45, 56 * n3 / 15 - 136 * n4 / 35, 4279 * n4 / 630]
    return to, back, lat


def _rectifying(el: Ellipsoid) -> tuple[float, float]:
    n = el.f / (2 - el.f)
    return n, el.a / (1 + n) * (1 + n * n / 4 + n**4 / 64)


def _meridian(el: Ellipsoid, lat: float) -> float:
    """Metres along the meridian to a latitude in degrees."""
    n, radius = _rectifying(el)
    s = math.sin(math.radians(lat))
    xi = math.atan(math.sinh(math.atanh(s) - el.e * math.atanh(el.e * s))) if abs(lat) < 90 else math.copysign(math.pi / 2, lat)
    return radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(_series(n)[0], 1)))


def _tm(s: System, lon: Column, lat: Column) -> tuple[Column, Column]:
    el = Ellipsoid.of(s.ellipsoid)
    n, radius = _rectifying(el)
    to, _, _ = _series(n)
    away, sine = F.radians(lon - s.lon), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sine) - el.e * F.atanh(el.e * sine))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    x = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(to, 1)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(to, 1)), F.lit(0.0))
    return s.east + s.scale * radius * x, s.north + s.scale * (radius * y - _meridian(el, s.lat))


def _tm_back(s: System, x: Column, y: Column) -> tuple[Column, Column]:
    el = Ellipsoid.of(s.ellipsoid)
    n, radius = _rectifying(el)
    _, back, lat = _series(n)
    xi, eta = ((y - s.north) / s.scale + _meridian(el, s.lat)) / radius, (x - s.east) / (s.scale * radius)
    u = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(back, 1)), F.lit(0.0))
    v = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(back, 1)), F.lit(0.0))
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(lat, 1)), F.lit(0.0))
    return s.lon + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(phi)


def _t(e: float, phi: Column) -> Column:
    """The isometric co-latitude's tangent of a latitude in radians."""
    s = e * F.sin(phi)
    return F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), e / 2)


def _t_of(e: float, phi: float) -> float:
    s = e * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)


def _m_of(e: float, phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)


def _latitude(e2: float, t: Column) -> Column:
    """The latitude in radians of a `_t`, by its series in the conformal latitude."""
    chi = math.pi / 2 - 2 * F.atan(t)
    n = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    return chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(_series(n)[2], 1)), F.lit(0.0))


def _cone(s: System) -> tuple[Ellipsoid, float, float, float]:
    el = Ellipsoid.of(s.ellipsoid)
    one, two = (math.radians(p) for p in (s.parallels[0], s.parallels[-1]))
    m1, t1 = _m_of(el.e, one), _t_of(el.e, one)
    n = math.sin(one) if one == two else (math.log(m1) - math.log(_m_of(el.e, two))) / (math.log(t1) - math.log(_t_of(el.e, two)))
    factor = m1 / (n * t1**n) * s.scale
    return el, n, factor, el.a * factor * _t_of(el.e, math.radians(s.lat)) ** n


def _lambert(s: System, lon: Column, lat: Column) -> tuple[Column, Column]:
    el, n, factor, r0 = _cone(s)
    r, turn = el.a * factor * F.pow(_t(el.e, F.radians(lat)), n), n * F.radians(lon - s.lon)
    return s.east + r * F.sin(turn), s.north + r0 - r * F.cos(turn)


def _lambert_back(s: System, x: Column, y: Column) -> tuple[Column, Column]:
    el, n, factor, r0 = _cone(s)
    sign = 1.0 if n > 0 else -1.0
    dx, dy = sign * (x - s.east), sign * (r0 - (y - s.north))
    t = F.pow(F.sqrt(dx * dx + dy * dy) / abs(el.a * factor), 1 / n)
    return s.lon + F.degrees(F.atan2(dx, dy) / n), F.degrees(_latitude(el.e2, t))


def _pole(s: System) -> tuple[Ellipsoid, float, float]:
    """Ellipsoid, 1 at the northern and -1 at the southern pole, and the radius for a `_t` of 1."""
    el, sign = Ellipsoid.of(s.ellipsoid), 1.0 if s.lat > 0 else -1.0
    if abs(s.lat) == 90:
        return el, sign, 2 * el.a * s.scale / math.sqrt((1 + el.e) ** (1 + el.e) * (1 - el.e) ** (1 - el.e))
    phi = math.radians(abs(s.lat))
    return el, sign, el.a * s.scale * _m_of(el.e, phi) / _t_of(el.e, phi)


def _polar(s: System, lon: Column, lat: Column) -> tuple[Column, Column]:
    el, sign, radius = _pole(s)
    r, turn = radius * _t(el.e, F.radians(sign * lat)), F.radians(lon - s.lon)
    return s.east + r * F.sin(turn), s.north - sign * r * F.cos(turn)


def _polar_back(s: System, x: Column, y: Column) -> tuple[Column, Column]:
    el, sign, radius = _pole(s)
    dx, dy = x - s.east, y - s.north
    lat = sign * F.degrees(_latitude(el.e2, F.sqrt(dx * dx + dy * dy) / radius))
    return s.lon + F.degrees(F.atan2(dx, -sign * dy)), lat


def _mercator(s: System, lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * r


def _mercator_back(s: System, x: Column, y: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2)


_KINDS = {"tm": (_tm, _tm_back), "lambert": (_lambert, _lambert_back), "polar": (_polar, _polar_back), "mercator": (_mercator, _mercator_back)}


def geocentric(lon: Column, lat: Column, h: Column, el: Ellipsoid) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    n = el.a / F.sqrt(1 - el.e2 * F.pow(F.sin(b), 2))
    return (n + h) * F.cos(b) * F.cos(a), (n + h) * F.cos(b) * F.sin(a), (n * (1 - el.e2) + h) * F.sin(b)


def from_geocentric(x: Column, y: Column, z: Column, el: Ellipsoid) -> tuple[Column, Column, Column]:
    """Longitude, latitude and height, by Bowring's formula: to well under a millimetre near the ground."""
    b, p = el.a * (1 - el.f), F.sqrt(x * x + y * y)
    u = F.atan2(z * el.a, p * b)
    lat = F.atan2(z + el.e2 / (1 - el.e2) * b * F.pow(F.sin(u), 3), p - el.e2 * el.a * F.pow(F.cos(u), 3))
    n = el.a / F.sqrt(1 - el.e2 * F.pow(F.sin(lat), 2))
    return F.degrees(F.atan2(y, x)), F.degrees(lat), p * F.cos(lat) + z * F.sin(lat) - el.a * el.a / n


def shifted(x: Column, y: Column, z: Column, shift: tuple[float, ...], back: bool = False) -> tuple[Column, Column, Column]:
    """A position vector shift of seven parameters, or, `back`, its inverse."""
    tx, ty, tz = shift[:3]
    rx, ry, rz = (math.radians(s / 3600) for s in shift[3:6])
    m = 1 + shift[6] * 1e-6
    rows = [(m, -m * rz, m * ry), (m * rz, m, -m * rx), (-m * ry, m * rx, m)]
    if not back:
        return tuple(a * x + b * y + c * z + t for (a, b, c), t in zip(rows, (tx, ty, tz), strict=True))
    (a, b, c), (d, e, f), (g, h, i) = rows
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    inverse = [(e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d)]
    u, v, w = x - tx, y - ty, z - tz
    return tuple((p * u + q * v + r * w) / det for p, q, r in inverse)


def to_hub(name, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of WGS 84. Heights stay: a shift takes points as on either ellipsoid, so there and back
    it may move them by a few millimetres."""
    s = system(name)
    if s.kind != "degrees":
        x, y = _KINDS[s.kind][1](s, x * s.unit, y * s.unit)
    if s.shift:
        xyz = shifted(*geocentric(x, y, F.lit(0.0), Ellipsoid.of(s.ellipsoid)), s.shift)
        x, y, _ = from_geocentric(*xyz, Ellipsoid.of("WGS84"))
    return x, y


def from_hub(name, x: Column, y: Column) -> tuple[Column, Column]:
    s = system(name)
    if s.shift:
        xyz = shifted(*geocentric(x, y, F.lit(0.0), Ellipsoid.of("WGS84")), s.shift, back=True)
        x, y, _ = from_geocentric(*xyz, Ellipsoid.of(s.ellipsoid))
    if s.kind != "degrees":
        x, y = _KINDS[s.kind][0](s, x, y)
        x, y = x / s.unit, y / s.unit
    return x, y


def moved(points: DataFrame, to, source="geographic") -> DataFrame:
    """`points` with x and y in another system, by way of the hub. Each step is a projection of its own, so that none is worked out twice."""
    if to == source:
        return points
    lon, lat = to_hub(source, F.col("x"), F.col("y"))
    hub = points.withColumns({"x": lon, "y": lat})
    x, y = from_hub(to, F.col("x"), F.col("y"))
    return hub.withColumns({"x": x, "y": y})
