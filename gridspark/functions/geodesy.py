"""Grids and map projections as column expressions.

A grid has ``index(lat, lon)`` -> fractional (i, j), NULL outside, and ``point(i, j)`` ->
(lat, lon).  A target has ``lonlat(px, py)`` -> (lat, lon), NULL off the map, and
``pixel(lat, lon)`` -> (px, py).  Constants of a projection are folded on the driver, so a
plan holds one projection of plain expressions and stays inside code generation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clamp, col, finite, snap, wrap_span

RAD, DEG = math.pi / 180, 180 / math.pi
MERCATOR_LAT = 85.051_128_779_806_59
Pair = tuple[Column, Column]


def _null_unless(ok: Column, *cols: Column) -> tuple[Column, ...]:
    return tuple(F.when(ok, c) for c in cols)


def east_span(first: float, last: float) -> float:
    return last - first + (360 if last < first else 0)


def is_global(span: float, n: int) -> bool:
    """Whether n meridians over span go round the globe with no gap but one step."""
    if n < 2 or not math.isfinite(span) or span <= 0:
        return False
    step = span / (n - 1)
    return abs(span + step - 360) <= step * 1e-3


def _mercator(lat: Column) -> Column:
    return F.ln(F.tan(math.pi / 4 + lat * RAD / 2))


def _mercator_number(lat: float) -> float:
    return math.log(math.tan(math.pi / 4 + lat * RAD / 2))


def axis_position(first: float, last: float, n: int, k: Column) -> Column:
    """Position k of n evenly spaced ones; both ends exact."""
    return F.when(k == 0, F.lit(first)).when(k == n - 1, F.lit(last)).otherwise(F.lit(first) + (last - first) * (k / float(n - 1)))


@dataclass(frozen=True)
class LatLon:
    ni: int
    nj: int
    lat_first: float
    lon_first: float
    lat_last: float
    lon_last: float

    @property
    def span(self) -> float:
        return east_span(self.lon_first, self.lon_last)

    @property
    def periodic(self) -> bool:
        return is_global(self.span, self.ni)

    def column(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """(i, whether the point is in the grid's box)."""
        rel = lon - self.lon_first
        inside = (rel >= 0) & (rel <= self.span)
        turned = F.pmod(rel, F.lit(360.0))
        east = F.when(inside, rel).otherwise(turned)
        ok = finite(lat) & finite(lon) & (inside | (F.lit(True) if self.periodic else turned <= self.span))
        lo, hi = sorted((self.lat_first, self.lat_last))
        usable = self.ni > 1 and self.nj > 1 and self.span != 0
        return east / (self.span / (self.ni - 1) if usable else 1.0), ok & lat.between(lo, hi) & F.lit(usable)

    def index(self, lat: Column, lon: Column) -> Pair:
        i, ok = self.column(lat, lon)
        step = (self.lat_last - self.lat_first) / (self.nj - 1) if self.nj > 1 else 1.0
        return _null_unless(ok, i, (lat - self.lat_first) / (step or 1.0))

    def point(self, i: Column, j: Column) -> Pair:
        return axis_position(self.lat_first, self.lat_last, self.nj, j), F.lit(self.lon_first) + i * (self.span / (self.ni - 1))


class Mercator(LatLon):
    def index(self, lat: Column, lon: Column) -> Pair:
        i, ok = self.column(lat, lon)
        y0, y1 = _mercator_number(self.lat_first), _mercator_number(self.lat_last)
        return _null_unless(ok, i, (_mercator(lat) - y0) / ((y1 - y0) / (self.nj - 1)))

    def point(self, i: Column, j: Column) -> Pair:
        y0, y1 = _mercator_number(self.lat_first), _mercator_number(self.lat_last)
        lat = (2 * F.atan(F.exp(F.lit(y0) + j * ((y1 - y0) / (self.nj - 1)))) - math.pi / 2) * DEG
        lat = F.when(j == 0, F.lit(self.lat_first)).when(j == self.nj - 1, F.lit(self.lat_last)).otherwise(lat)
        return lat, F.lit(self.lon_first) + i * (self.span / (self.ni - 1))


def gaussian_latitudes(n: int) -> list[float]:
    """The 2n Gauss-Legendre latitudes, north to south (Newton on the Legendre polynomial)."""
    m = 2 * n
    x = np.cos(np.pi * (np.arange((m + 1) // 2) + 0.75) / (m + 0.5))
    for _ in range(30):
        p, q = np.ones_like(x), np.zeros_like(x)
        for k in range(1, m + 1):
            p, q = ((2 * k - 1) * x * p - (k - 1) * q) / k, p
        step = p * (x * x - 1) / (m * (x * p - q))
        x = x - step
        if np.abs(step).max() < 1e-14:
            break
    north = np.arcsin(x) * DEG
    return [*north.tolist(), *(-north[::-1]).tolist()][:m]


@dataclass(frozen=True)
class Gaussian(LatLon):
    n_parallels: int = 1

    def rows(self) -> list[float]:
        r = gaussian_latitudes(self.n_parallels)
        return r if self.lat_first > self.lat_last else r[::-1]

    def index(self, lat: Column, lon: Column) -> Pair:
        """The row bracket is found in a constant array of 2N latitudes (a driver-side table)."""
        i, ok = self.column(lat, lon)
        r = self.rows()
        s = 1.0 if self.lat_first > self.lat_last else -1.0
        n = len(r)
        rows = F.array(*[F.lit(s * v) for v in r])  # falling
        v = lat * s
        k = F.least(F.size(F.filter(rows, lambda x: x >= v)), F.lit(n - 1))  # first bracket: rows k-1, k
        hi, lo = F.get(rows, k - 1), F.get(rows, k)
        at = (k - 1) + (hi - v) / (hi - lo)
        j = F.when(v >= s * r[0] - 1e-3, F.lit(0.0)).when(v <= s * r[-1] + 1e-3, F.lit(float(n - 1))).otherwise(at)
        return _null_unless(ok, i, j)

    def point(self, i: Column, j: Column) -> Pair:
        rows = F.array(*[F.lit(v) for v in self.rows()])
        return F.get(rows, j.cast("int")), F.lit(self.lon_first) + i * (self.span / (self.ni - 1))


@dataclass(frozen=True)
class _Planar:
    ni: int
    nj: int
    lat_first: float
    lon_first: float
    lov: float
    dx: float
    dy: float
    radius: float = 6_371_229.0

    @property
    def usable(self) -> bool:
        """Whether the grid has spacings (and a cone) to divide by; else nothing lies on it."""
        return self.dx != 0 and self.dy != 0

    def _cells(self, x: Column, y: Column, ok: Column) -> Pair:
        x0, y0 = self.origin
        i = snap((x - x0) / self.dx, 0.0, self.ni - 1.0)
        j = snap((y - y0) / self.dy, 0.0, self.nj - 1.0)
        ok = ok & finite(x) & finite(y) & i.between(0, self.ni - 1) & j.between(0, self.nj - 1)
        return _null_unless(ok, i, j)

    def index(self, lat: Column, lon: Column) -> Pair:
        if not self.usable:
            return F.lit(None).cast("double"), F.lit(None).cast("double")
        x, y = self.xy(lat, lon)
        return self._cells(x, y, finite(lat) & finite(lon) & self.visible(lat))

    def point(self, i: Column, j: Column) -> Pair:
        if not self.usable:
            return F.lit(None).cast("double"), F.lit(None).cast("double")
        x0, y0 = self.origin
        return self.lonlat(x0 + i * self.dx, y0 + j * self.dy)

    def visible(self, lat: Column) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Lambert(_Planar):
    lad: float = 0.0
    latin1: float = 30.0
    latin2: float = 60.0

    @property
    def usable(self) -> bool:
        return super().usable and abs(self.latin1 + self.latin2) > 1e-9 and max(abs(self.latin1), abs(self.latin2), abs(self.lad)) < 90

    @property
    def constants(self) -> tuple[float, float, float]:
        """(n, r*F, rho0) of the conic."""
        a, b = self.latin1 * RAD, self.latin2 * RAD
        cone = lambda v: math.tan(math.pi / 4 + v / 2)
        n = math.sin(a) if abs(self.latin1 - self.latin2) < 1e-9 else math.log(math.cos(a) / math.cos(b)) / math.log(cone(b) / cone(a))
        rf = self.radius * math.cos(a) * cone(a) ** n / n
        return n, rf, rf / cone(self.lad * RAD) ** n

    @property
    def origin(self) -> tuple[float, float]:
        n, rf, rho0 = self.constants
        rho = rf / math.tan(math.pi / 4 + self.lat_first * RAD / 2) ** n
        t = n * ((self.lon_first - self.lov + 180) % 360 - 180) * RAD
        return rho * math.sin(t), rho0 - rho * math.cos(t)

    def xy(self, lat: Column, lon: Column) -> Pair:
        n, rf, rho0 = self.constants
        rho = F.try_divide(F.lit(rf), F.pow(F.tan(math.pi / 4 + lat * RAD / 2), F.lit(n)))
        t = n * ((F.pmod(lon - self.lov + 180.0, F.lit(360.0)) - 180.0) * RAD)
        return rho * F.sin(t), rho0 - rho * F.cos(t)

    def lonlat(self, x: Column, y: Column) -> Pair:
        n, rf, rho0 = self.constants
        dy = rho0 - y
        rho = math.copysign(1, n) * F.sqrt(x * x + dy * dy)
        lat = (2 * F.atan(F.pow(F.coalesce(F.try_divide(F.lit(rf), rho), F.lit(float('inf'))), F.lit(1 / n))) - math.pi / 2) * DEG
        return lat, self.lov + F.atan2(x, dy) / n * DEG


@dataclass(frozen=True)
class PolarStereo(_Planar):
    lad: float = 60.0
    south: bool = False

    @property
    def constants(self) -> tuple[float, float]:
        return 2 * self.radius * (1 + math.sin(abs(self.lad) * RAD)) / 2, -1.0 if self.south else 1.0

    @property
    def origin(self) -> tuple[float, float]:
        k, s = self.constants
        rho, t = k * math.tan(math.pi / 4 - s * self.lat_first * RAD / 2), (self.lon_first - self.lov) * RAD
        return rho * math.sin(t), -s * rho * math.cos(t)

    def visible(self, lat: Column) -> Column:
        return lat <= 0 if self.south else lat >= 0

    def xy(self, lat: Column, lon: Column) -> Pair:
        k, s = self.constants
        rho, t = k * F.tan(math.pi / 4 - s * lat * RAD / 2), (lon - self.lov) * RAD
        return rho * F.sin(t), -s * rho * F.cos(t)

    def lonlat(self, x: Column, y: Column) -> Pair:
        k, s = self.constants
        rho = F.sqrt(x * x + y * y)
        lat = F.when(rho == 0, s * 90.0).otherwise(s * (math.pi / 2 - 2 * F.atan(rho / k)) * DEG)
        return lat, F.when(rho == 0, self.lov).otherwise(self.lov + F.atan2(x, -s * y) * DEG)

    def pole_inside(self) -> bool:
        """Whether the pole (0, 0) lies in the grid's rectangle."""
        x0, y0 = self.origin
        x, y = sorted((x0, x0 + (self.ni - 1) * self.dx)), sorted((y0, y0 + (self.nj - 1) * self.dy))
        return x[0] <= 0 <= x[1] and y[0] <= 0 <= y[1]


@dataclass(frozen=True)
class Rotated(LatLon):
    pole_lat: float = -90.0
    pole_lon: float = 0.0
    angle: float = 0.0

    def _terms(self) -> tuple[float, float, float, float]:
        t, o = -(90 + self.pole_lat) * RAD, -self.pole_lon * RAD
        return math.sin(t), math.cos(t), math.sin(o), math.cos(o)

    def rotate(self, lat: Column, lon: Column) -> Pair:
        st, ct, so, co = self._terms()
        x, y, z = F.cos((lon + self.angle) * RAD) * F.cos(lat * RAD), F.sin((lon + self.angle) * RAD) * F.cos(lat * RAD), F.sin(lat * RAD)
        xd = ct * co * x - ct * so * y - st * z
        yd = so * x + co * y
        zd = clamp(st * co * x - st * so * y + ct * z, -1.0, 1.0)
        return F.asin(zd) * DEG, F.atan2(yd, xd) * DEG

    def unrotate(self, rlat: Column, rlon: Column) -> Pair:
        st, ct, so, co = self._terms()
        xd, yd, zd = F.cos(rlon * RAD) * F.cos(rlat * RAD), F.sin(rlon * RAD) * F.cos(rlat * RAD), F.sin(rlat * RAD)
        x = ct * co * xd + so * yd + st * co * zd
        y = -ct * so * xd + co * yd - st * so * zd
        return F.asin(clamp(-st * xd + ct * zd, -1.0, 1.0)) * DEG, F.atan2(y, x) * DEG - self.angle

    def index(self, lat: Column, lon: Column) -> Pair:
        a, b = self.rotate(lat, lon)
        return LatLon.index(self, snap(a, self.lat_first, self.lat_last), snap(b, self.lon_first, self.lon_last))

    def point(self, i: Column, j: Column) -> Pair:
        return self.unrotate(*LatLon.point(self, i, j))


@dataclass(frozen=True)
class Geostationary:
    ni: int
    nj: int
    height: float  # from the Earth's centre
    r_eq: float
    r_pol: float
    sub_lon: float
    sweep_x: bool
    x0: float
    dx: float
    y0: float
    dy: float

    def scan(self, lat: Column, lon: Column) -> tuple[Column, Column, Column]:
        """(x, y, whether the point faces the satellite)."""
        q = (self.r_pol / self.r_eq) ** 2
        phi = F.atan(q * F.tan(lat * RAD))
        c = F.cos(phi)
        r = self.r_pol / F.sqrt(1 - (1 - q) * c * c)
        d = lon * RAD - self.sub_lon * RAD
        sx, sy, sz = self.height - r * c * F.cos(d), -r * c * F.sin(d), r * F.sin(phi)
        seen = self.height * (self.height - sx) >= sy * sy + sz * sz / q
        norm = F.sqrt(sx * sx + sy * sy + sz * sz)
        return (F.asin(-sy / norm), F.atan(sz / sx), seen) if self.sweep_x else (F.atan(-sy / sx), F.asin(sz / norm), seen)

    def index(self, lat: Column, lon: Column) -> Pair:
        if not self.dx or not self.dy:
            return F.lit(None).cast("double"), F.lit(None).cast("double")
        x, y, seen = self.scan(lat, lon)
        i, j = (x - self.x0) / self.dx, (y - self.y0) / self.dy
        return _null_unless(finite(lat) & finite(lon) & seen & i.between(0, self.ni - 1) & j.between(0, self.nj - 1), i, j)

    def point(self, i: Column, j: Column) -> Pair:
        x, y = self.x0 + i * self.dx, self.y0 + j * self.dy
        q = (self.r_pol / self.r_eq) ** 2
        cx, sx, cy, sy = F.cos(x), F.sin(x), F.cos(y), F.sin(y)
        dx, dy, dz = (cx * cy, -sx, cx * sy) if self.sweep_x else (cx * cy, -sx * cy, sy)
        a, b, c = dx * dx + dy * dy + dz * dz / q, -2 * self.height * dx, self.height**2 - self.r_eq**2
        disc = b * b - 4 * a * c
        r = (-b - F.sqrt(F.greatest(disc, F.lit(0.0)))) / (2 * a)
        px, py, pz = self.height - r * dx, -r * dy, r * dz
        lat, lon = F.atan(pz / q / F.sqrt(px * px + py * py)), self.sub_lon * RAD + F.atan2(py, px)
        return _null_unless((disc >= 0) & (a > 0), lat * DEG, lon * DEG)


# ---- targets -----------------------------------------------------------------------------


def _unit(k: Column, n: int) -> Column:
    """Pixel k of n on [-1, 1]; a single pixel is the centre."""
    return 2 * (k / float(n - 1)) - 1 if n > 1 else F.lit(0.0) * k


def _pixel(u: Column, n: int) -> Column:
    return (u + 1) / 2 * float(n - 1) if n > 1 else u * 0.0


def _step(span: float, n: int) -> float:
    return span / (n - 1) if n > 1 else 0.0


@dataclass(frozen=True)
class Equirect:
    w: int
    h: int
    lat_min: float = -90.0
    lat_max: float = 90.0
    lon_min: float = -180.0
    lon_max: float = 180.0

    @property
    def centre(self) -> float:
        return (self.lon_min + self.lon_max) / 2

    def _px(self, lon: Column) -> Column:
        d = _step(self.lon_max - self.lon_min, self.w)
        near = self.centre + wrap_span(lon - self.centre, 180.0)
        return (near - self.lon_min) / d if d else near * 0.0

    def lonlat(self, px: Column, py: Column) -> Pair:
        return self.lat_max + py * _step(self.lat_min - self.lat_max, self.h), self.lon_min + px * _step(self.lon_max - self.lon_min, self.w)

    def pixel(self, lat: Column, lon: Column) -> Pair:
        d = _step(self.lat_min - self.lat_max, self.h)
        return self._px(lon), ((lat - self.lat_max) / d if d else lat * 0.0)


class WebMercator(Equirect):
    @property
    def _y(self) -> tuple[float, float]:
        hi, lo = (_mercator_number(max(-MERCATOR_LAT, min(MERCATOR_LAT, v))) for v in (self.lat_max, self.lat_min))
        if hi <= lo:
            raise ValueError("the latitude band of a Web Mercator raster is empty")
        return hi, _step(lo - hi, self.h)

    def lonlat(self, px: Column, py: Column) -> Pair:
        hi, d = self._y
        return (2 * F.atan(F.exp(hi + py * d)) - math.pi / 2) * DEG, self.lon_min + px * _step(self.lon_max - self.lon_min, self.w)

    def pixel(self, lat: Column, lon: Column) -> Pair:
        hi, d = self._y
        y = _mercator(lat)
        return _null_unless(finite(y), self._px(lon), (y - hi) / d if d else y * 0.0)


@dataclass(frozen=True)
class Orthographic:
    w: int
    h: int
    lat0: float = 0.0
    lon0: float = 0.0
    centre = None

    def lonlat(self, px: Column, py: Column) -> Pair:
        s0, c0 = math.sin(self.lat0 * RAD), math.cos(self.lat0 * RAD)
        x, y = _unit(px, self.w), -_unit(py, self.h)
        rho = F.sqrt(x * x + y * y)
        c = F.asin(F.least(rho, F.lit(1.0)))
        lat = F.asin(clamp(F.cos(c) * s0 + y * F.sin(c) * c0 / F.when(rho > 0, rho).otherwise(1.0), -1.0, 1.0)) * DEG
        lon = (self.lon0 * RAD + F.atan2(x * F.sin(c), rho * F.cos(c) * c0 - y * F.sin(c) * s0)) * DEG
        lat, lon = F.when(rho == 0, self.lat0).otherwise(lat), F.when(rho == 0, self.lon0).otherwise(lon)
        return _null_unless(rho <= 1, lat, lon)

    def pixel(self, lat: Column, lon: Column) -> Pair:
        s0, c0 = math.sin(self.lat0 * RAD), math.cos(self.lat0 * RAD)
        s, c, d = F.sin(lat * RAD), F.cos(lat * RAD), lon * RAD - self.lon0 * RAD
        front = s0 * s + c0 * c * F.cos(d) >= -1e-9
        return _null_unless(front, _pixel(c * F.sin(d), self.w), _pixel(-(c0 * s - s0 * c * F.cos(d)), self.h))


@dataclass(frozen=True)
class Polar:
    w: int
    h: int
    south: bool = False
    lon0: float = 0.0
    centre = None

    def lonlat(self, px: Column, py: Column) -> Pair:
        s = -1.0 if self.south else 1.0
        x, y = _unit(px, self.w) * 2, -_unit(py, self.h) * 2
        rho = F.sqrt(x * x + y * y)
        lat = F.when(rho == 0, s * 90.0).otherwise(s * (math.pi / 2 - 2 * F.atan(rho / 2)) * DEG)
        lon = F.when(rho == 0, self.lon0).otherwise(self.lon0 + F.atan2(x, -s * y) * DEG)
        return _null_unless(lat * s >= 0, lat, lon)

    def pixel(self, lat: Column, lon: Column) -> Pair:
        s = -1.0 if self.south else 1.0
        rho, t = 2 * F.tan((math.pi / 2 - s * lat * RAD) / 2), (lon - self.lon0) * RAD
        x, y = rho * F.sin(t), -s * rho * F.cos(t)
        return _null_unless(s * lat >= 0, _pixel(x / 2, self.w), _pixel(-y / 2, self.h))


@dataclass(frozen=True)
class _World:
    w: int
    h: int
    lon0: float = 0.0

    @property
    def centre(self) -> float:
        t = self.lon0 / 360
        return self.lon0 - 360 * math.copysign(max(0, math.ceil(abs(t) - 0.5)), t)

    def _dlon(self, lon: Column) -> Column:
        return wrap_span(lon * RAD - self.centre * RAD, math.pi)


class Mollweide(_World):
    aspect = 2.0

    def lonlat(self, px: Column, py: Column) -> Pair:
        x, y = _unit(px, self.w), -_unit(py, self.h)
        t = F.asin(clamp(y, -1.0, 1.0))
        lat = F.asin(clamp((2 * t + F.sin(2 * t)) / math.pi, -1.0, 1.0)) * DEG
        lon = F.when(F.abs(F.cos(t)) < 1e-12, self.centre * RAD).otherwise(self.centre * RAD + math.pi * x / F.cos(t)) * DEG
        return _null_unless(x * x + y * y <= 1, lat, lon)

    def pixel(self, lat: Column, lon: Column) -> Pair:
        phi = lat * RAD
        s = F.sin(phi)
        # twelve Newton steps as a fold over a constant array: one expression, no blow-up
        step = lambda t, _: t - F.coalesce(F.try_divide(2 * t + F.sin(2 * t) - math.pi * s, 2 + 2 * F.cos(2 * t)), F.lit(0.0))
        t = F.aggregate(F.sequence(F.lit(1), F.lit(12)), phi, step)
        t = F.when(1 - F.abs(s) < 1e-12, F.signum(s) * (math.pi / 2)).otherwise(t)
        return _pixel(self._dlon(lon) * F.cos(t) / math.pi, self.w), _pixel(-F.sin(t), self.h)


# The tabulated Robinson parallels, every 5 degrees.
ROBINSON_X = [1.0000, 0.9986, 0.9954, 0.9900, 0.9822, 0.9730, 0.9600, 0.9427, 0.9216, 0.8962, 0.8679, 0.8350, 0.7986, 0.7597, 0.7186, 0.6732, 0.6213, 0.5722, 0.5322]
ROBINSON_Y = [0.0000, 0.0620, 0.1240, 0.1860, 0.2480, 0.3100, 0.3720, 0.4340, 0.4958, 0.5571, 0.6176, 0.6769, 0.7346, 0.7903, 0.8435, 0.8936, 0.9394, 0.9761, 1.0000]


def natural_spline(v: list[float], h: float = 5.0) -> list[tuple[float, float, float, float]]:
    """Cubic (a + b t + c t^2 + d t^3, t in [0, 1]) of each cell of a natural spline."""
    n = len(v)
    a = np.eye(n) * 4
    a[0], a[-1] = np.eye(n)[0], np.eye(n)[-1]
    rhs = np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1] = a[i, i + 1] = 1
        rhs[i] = 6 * (v[i - 1] - 2 * v[i] + v[i + 1]) / h**2
    m = np.linalg.solve(a, rhs) * h * h / 6
    return [(v[i], v[i + 1] - v[i] - 2 * m[i] - m[i + 1], 3 * m[i], m[i + 1] - m[i]) for i in range(n - 1)]


class Robinson(_World):
    aspect = 0.8487 * math.pi / 1.3523

    @staticmethod
    def _eval(table: list[float], lat: Column) -> Column:
        i = F.least(F.floor(lat / 5.0), F.lit(17)).cast("int")
        t = lat / 5.0 - i
        a, b, c, d = (F.get(F.array(*[F.lit(float(r[k])) for r in natural_spline(table)]), i) for k in range(4))
        return a + t * (b + t * (c + t * d))

    @staticmethod
    def latitude(y: float) -> float:
        """|latitude| whose spline ordinate is y (bisection on the increasing spline)."""
        cells = natural_spline(ROBINSON_Y)
        y = min(max(y, 0.0), 1.0)
        i = next(k for k in range(18) if y <= ROBINSON_Y[k + 1] or k == 17)
        a, b, c, d = cells[i]
        lo, hi = 0.0, 1.0
        for _ in range(60):
            t = (lo + hi) / 2
            lo, hi = (lo, t) if a + t * (b + t * (c + t * d)) > y else (t, hi)
        return 5.0 * (i + (lo + hi) / 2)

    def lonlat(self, px: Column, py: Column) -> Pair:
        """Latitude depends on the row alone, so it is a driver-side table of h numbers."""
        units = [-(2 * k / (self.h - 1) - 1) if self.h > 1 else 0.0 for k in range(self.h)]
        lats = F.array(*[F.lit(math.copysign(self.latitude(abs(u)), u)) for u in units])
        lat = F.get(lats, py.cast("int"))
        half = self._eval(ROBINSON_X, F.abs(lat))
        x = _unit(px, self.w)
        return _null_unless(F.abs(x) <= half, lat, (self.centre * RAD + math.pi * x / half) * DEG)

    def pixel(self, lat: Column, lon: Column) -> Pair:
        a = F.least(F.abs(lat), F.lit(90.0))
        x = self._eval(ROBINSON_X, a) * self._dlon(lon) / math.pi
        y = self._eval(ROBINSON_Y, a) * F.when(lat < 0, -1.0).otherwise(1.0)
        return _pixel(x, self.w), _pixel(-y, self.h)


class EqualEarth(_World):
    A = (1.340264, -0.081106, 0.000893, 0.003796)  # fixed values of the projection
    M = math.sqrt(3) / 2
    x_max = math.pi / (M * A[0])

    @classmethod
    def fy(cls, t):
        a1, a2, a3, a4 = cls.A
        return t * (a1 + a2 * t * t + t * t * t * t * t * t * (a3 + a4 * t * t))

    @classmethod
    def dfy(cls, t):
        a1, a2, a3, a4 = cls.A
        return a1 + 3 * a2 * t * t + t * t * t * t * t * t * (7 * a3 + 9 * a4 * t * t)

    @classmethod
    def theta(cls, y: float) -> float:
        t = y
        for _ in range(12):
            t -= (cls.fy(t) - y) / cls.dfy(t)
        return t

    def lonlat(self, px: Column, py: Column) -> Pair:
        top = self.fy(math.pi / 3)
        units = [-(2 * k / (self.h - 1) - 1) if self.h > 1 else 0.0 for k in range(self.h)]
        t = F.get(F.array(*[F.lit(self.theta(u * top)) for u in units]), py.cast("int"))
        x = _unit(px, self.w) * self.x_max
        d = self.M * x * self.dfy(t) / F.cos(t)
        return _null_unless(F.abs(d) <= math.pi, F.asin(clamp(F.sin(t) / self.M, -1.0, 1.0)) * DEG, (self.centre * RAD + d) * DEG)

    def pixel(self, lat: Column, lon: Column) -> Pair:
        t = F.asin(clamp(self.M * F.sin(lat * RAD), -1.0, 1.0))
        x = self._dlon(lon) * F.cos(t) / (self.M * self.dfy(t))
        return _pixel(x / self.x_max, self.w), _pixel(-self.fy(t) / self.fy(math.pi / 3), self.h)


EqualEarth.aspect = EqualEarth.x_max / EqualEarth.fy(math.pi / 3)

TARGETS = {"equirectangular": Equirect, "web_mercator": WebMercator, "orthographic": Orthographic, "polar_stereographic": Polar, "mollweide": Mollweide, "robinson": Robinson, "equal_earth": EqualEarth}


def raster_size(target: str, ni: int, nj: int) -> tuple[int, int]:
    """Width and height of a target's raster for an ni x nj source."""
    big = max(ni, nj)
    if target in ("orthographic", "polar_stereographic"):
        return big, big
    if target in ("mollweide", "robinson", "equal_earth"):
        return int(big * TARGETS[target].aspect + 0.5), big
    return ni, nj


def resolve_target(name: str, ni: int, nj: int, **options):
    """A target by name; unknown names raise."""
    if name not in TARGETS:
        raise ValueError(f"unknown projection {name!r}; known: source, {', '.join(TARGETS)}")
    w, h = raster_size(name, ni, nj)
    return TARGETS[name](options.pop("width", w), options.pop("height", h), **options)


__all__ = ["LatLon", "Mercator", "Gaussian", "Lambert", "PolarStereo", "Rotated", "Geostationary", "Equirect", "WebMercator", "Orthographic", "Polar", "Mollweide", "Robinson", "EqualEarth", "TARGETS", "raster_size", "resolve_target", "gaussian_latitudes", "axis_position", "east_span", "is_global", "col"]
