"""Registered queries of the field engine, with the SQL that states the same result.

tables; the SQL is written from the formulas, not from the plans.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import colormap
from ..functions import geodesy as G
from ..functions.scalar import normalise_lon
from ..operators import field as O
from ..operators import render as R
from .fields import FE, FH, FHT, POINTS, TRACKS, fe, fe_grid, fh, keyed, points, r6, s6, table, tracks

FLAGSHIP = "r01_warp_orthographic"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


D = "(pi() / 180)"
# ---- warps -------------------------------------------------------------------------------
PIX = "px AS (SELECT (k % {w})::INT AS px, (k // {w})::INT AS py, 2.0::DOUBLE * (k % {w}) / ({w} - 1) - 1 AS ux, -(2.0::DOUBLE * (k // {w}) / ({h} - 1) - 1) AS uy FROM range({w} * {h}) t(k))"
CELL = "cell AS (SELECT ll.*, ((lon - 360 * floor(lon / 360)) / 5.625) AS fi, (90 - lat) / (180.0::DOUBLE / (nj - 1)) AS fj FROM ll, fen)"
NEAR = "SELECT px, py, {lat} AS lat, {lon} AS lon, {v} AS value FROM (SELECT cell.*, (floor(fi + 0.5)::INT % 64)::INT AS ci, least(greatest(floor(fj + 0.5), 0), (SELECT nj FROM fen) - 1)::INT AS cj FROM cell) c LEFT JOIN fe ON fe.i = c.ci AND fe.j = c.cj".format(lat=s6("lat"), lon=s6("lon"), v=s6("value"))


def _warped(spark, d, target, method="nearest") -> DataFrame:
    out = R.warp(fe(spark, d), fe_grid(spark, d), target, method)
    return out.select("px", "py", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), r6(F.col("value")).alias("value"))


def _warp_sql(ll: str, w: int, h: int, last: str = NEAR) -> str:
    return f"WITH {FE}, {PIX.format(w=w, h=h)}, ll AS ({ll}), {CELL} {last}"


query(FLAGSHIP, _warp_sql(
    f"SELECT px, py, CASE WHEN rho <= 1 THEN CASE WHEN rho = 0 THEN 40.0 ELSE asin(greatest(-1, least(1, cos(asin(rho)) * sin(40 * {D}) + uy * sin(asin(rho)) * cos(40 * {D}) / rho))) / {D} END END AS lat,"
    f" CASE WHEN rho <= 1 THEN CASE WHEN rho = 0 THEN 10.0 ELSE 10 + atan2(ux * sin(asin(rho)), rho * cos(asin(rho)) * cos(40 * {D}) - uy * sin(asin(rho)) * sin(40 * {D})) / {D} END END AS lon"
    " FROM (SELECT *, CASE WHEN r <= 1 THEN r END AS rho FROM (SELECT *, sqrt(ux * ux + uy * uy) AS r FROM px))", 96, 96))(
    lambda spark, d: _warped(spark, d, G.Orthographic(96, 96, 40.0, 10.0)))
query("r01_warp_polar", _warp_sql(
    f"SELECT px, py, CASE WHEN lat >= 0 THEN lat END AS lat, CASE WHEN lat >= 0 THEN atan2(ux, -uy) / {D} - 30 END AS lon FROM (SELECT *, (pi() / 2 - 2 * atan(sqrt(4 * ux * ux + 4 * uy * uy) / 2)) / {D} AS lat FROM px)", 90, 90))(
    lambda spark, d: _warped(spark, d, G.Polar(90, 90, False, -30.0)))
query("r01_warp_mollweide", _warp_sql(
    f"SELECT px, py, CASE WHEN ux * ux + uy * uy <= 1 THEN asin((2 * asin(uy) + sin(2 * asin(uy))) / pi()) / {D} END AS lat, CASE WHEN ux * ux + uy * uy <= 1 THEN CASE WHEN abs(cos(asin(uy))) < 1e-12 THEN 20 ELSE 20 + 180 * ux / cos(asin(uy)) END END AS lon FROM px", 120, 60))(
    lambda spark, d: _warped(spark, d, G.Mollweide(120, 60, 20.0)))
query("r01_warp_web_mercator", _warp_sql(
    f"SELECT px, py, (2 * atan(exp(uy * ln(tan(pi() / 4 + 80 * {D} / 2)))) - pi() / 2) / {D} AS lat, 180 * ux AS lon FROM px", 80, 70))(
    lambda spark, d: _warped(spark, d, G.WebMercator(80, 70, -80.0, 80.0, -180.0, 180.0)))
_robin = ", ".join(f"({k}, {', '.join(repr(float(v)) + '::DOUBLE' for v in (*x, *y))})" for k, (x, y) in enumerate(zip(G.natural_spline(G.ROBINSON_X), G.natural_spline(G.ROBINSON_Y), strict=True)))
SPLINE = f"sp(k, ax, bx, cx, dx, ay, by_, cy, dy) AS (VALUES {_robin})"
#: The latitude of each row by bisection on the spline cell that holds its ordinate.
ROBINSON = f"""
  WITH RECURSIVE {SPLINE}, halves(uy, k, lo, hi, n) AS (
    SELECT uy, least(max(k), 17), 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM (SELECT DISTINCT uy FROM px) JOIN sp ON ay <= abs(uy) GROUP BY uy
    UNION ALL
    SELECT uy, k, CASE WHEN y > abs(uy) THEN lo ELSE t END, CASE WHEN y > abs(uy) THEN t ELSE hi END, n + 1
    FROM (SELECT h.*, (lo + hi) / 2 AS t, ay + (lo + hi) / 2 * (by_ + (lo + hi) / 2 * (cy + (lo + hi) / 2 * dy)) AS y FROM halves h JOIN sp USING (k)) WHERE n < 60
  ), line AS (
    SELECT uy, sign(uy) * 5 * (k + t) AS lat, ax + t * (bx + t * (cx + t * dx)) AS half FROM (SELECT *, (lo + hi) / 2 AS t FROM halves WHERE n = 60) JOIN sp USING (k)
  )
  SELECT px, py, CASE WHEN abs(ux) <= half THEN lat END AS lat, CASE WHEN abs(ux) <= half THEN 180 * ux / half END AS lon FROM px JOIN line USING (uy)"""
_fy = "({0} * (1.340264 - 0.081106 * {0} * {0} + pow({0}, 6) * (0.000893 + 0.003796 * {0} * {0})))".format
_dfy = "(1.340264 - 3 * 0.081106 * {0} * {0} + pow({0}, 6) * (7 * 0.000893 + 9 * 0.003796 * {0} * {0}))".format
#: The parametric latitude of each row by Newton's steps.
EQUAL_EARTH = f"""
  WITH RECURSIVE steps(uy, t, n) AS (
    SELECT DISTINCT uy, uy * {_fy("(pi() / 3)")}, 0 FROM px
    UNION ALL
    SELECT uy, t - ({_fy("t")} - uy * {_fy("(pi() / 3)")}) / {_dfy("t")}, n + 1 FROM steps WHERE n < 12
  ), line AS (
    SELECT uy, asin(greatest(-1, least(1, sin(t) / (sqrt(3) / 2)))) / {D} AS lat, pi() / 1.340264 * {_dfy("t")} / cos(t) AS most FROM steps WHERE n = 12
  )
  SELECT px, py, CASE WHEN abs(ux * most) <= pi() THEN lat END AS lat, CASE WHEN abs(ux * most) <= pi() THEN ux * most / {D} END AS lon FROM px JOIN line USING (uy)"""
query("r01_warp_robinson", _warp_sql(ROBINSON, 118, 60))(lambda spark, d: _warped(spark, d, G.Robinson(118, 60, 0.0)))
query("r01_warp_equal_earth", _warp_sql(EQUAL_EARTH, 123, 60))(lambda spark, d: _warped(spark, d, G.EqualEarth(123, 60, 0.0)))
BIL = (
    "SELECT px, py, {lat} AS lat, {lon} AS lon, {v} AS value FROM (SELECT c.*, "
    "(1 - tx) * (1 - ty) * a.value + tx * (1 - ty) * b.value + (1 - tx) * ty * e.value + tx * ty * f.value AS value FROM "
    "(SELECT *, fi - floor(fi) AS tx, fj - floor(fj) AS ty, (floor(fi)::INT % 64) AS i0, ((floor(fi)::INT + 1) % 64) AS i1, floor(fj)::INT AS j0, least(floor(fj)::INT + 1, (SELECT nj - 1 FROM fen)) AS j1 FROM cell) c "
    "LEFT JOIN fe a ON a.i = i0 AND a.j = j0 LEFT JOIN fe b ON b.i = i1 AND b.j = j0 LEFT JOIN fe e ON e.i = i0 AND e.j = j1 LEFT JOIN fe f ON f.i = i1 AND f.j = j1)"
).format(lat=s6("lat"), lon=s6("lon"), v=s6("value"))
query("r03_warp_bilinear", _warp_sql("SELECT px, py, 85.0::DOUBLE - py * 170.0::DOUBLE / 59 AS lat, -180 + px * 359.0::DOUBLE / 89 AS lon FROM px", 90, 60, BIL))(
    lambda spark, d: _warped(spark, d, G.Equirect(90, 60, -85.0, 85.0, -180.0, 179.0), "bilinear"))

# ---- grid inverses and forward maps ------------------------------------------------------
GRIDS = {
    "g01_latlon": G.LatLon(73, 37, 60.0, -30.0, -30.0, 60.0),
    "g01_latlon_global": G.LatLon(144, 73, 90.0, 0.0, -90.0, 357.5),
    "g02_mercator": G.Mercator(61, 41, -40.0, 100.0, 40.0, 220.0),
    "g03_gaussian": G.Gaussian(64, 32, 85.7606, 0.0, -85.7606, 354.375, 16),
    "g04_lambert": G.Lambert(93, 65, 12.19, -133.459, -95.0, 81270.5, 81270.5, 6_371_200.0, 25.0, 25.0, 45.0),
    "g05_polar": G.PolarStereo(65, 65, -20.0 + 40.0, -125.0, -80.0, 190500.0, 190500.0, 6_371_229.0, 60.0, False),
    "g06_rotated": G.Rotated(120, 100, -30.0, -40.0, 30.0, 40.0, -39.25, 18.0, 0.0),
    "g07_geostationary": G.Geostationary(500, 500, 42_164_160.0, 6_378_137.0, 6_356_752.31414, -75.0, True, -0.15, 0.0006, 0.15, -0.0006),
}


def _inv(i: str, j: str, ok: str, pre: str = "") -> str:
    return f"WITH {POINTS}{pre} SELECT o_orderkey, CASE WHEN {ok} THEN {s6(i)} END AS fi, CASE WHEN {ok} THEN {s6(j)} END AS fj FROM pts2" if pre else f"WITH {POINTS} SELECT o_orderkey, CASE WHEN {ok} THEN {s6(i)} END AS fi, CASE WHEN {ok} THEN {s6(j)} END AS fj FROM pts"


_east = "(lon - ({0}) - 360 * floor((lon - ({0})) / 360))"
_gauss = ", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in enumerate(G.gaussian_latitudes(16)))
_q = "((6356752.31414::DOUBLE / 6378137.0::DOUBLE) * (6356752.31414::DOUBLE / 6378137.0::DOUBLE))"
INDEX_SQL = {
    "g01_latlon": _inv(_east.format(-30) + " / 1.25", "(60 - lat) / 2.5", "lat BETWEEN -30 AND 60 AND " + _east.format(-30) + " <= 90"),
    "g01_latlon_global": _inv(_east.format(0) + " / 2.5", "(90 - lat) / 2.5", "lat BETWEEN -90 AND 90"),
    "g02_mercator": _inv(_east.format(100) + " / 2.0", f"(ln(tan(pi() / 4 + lat * {D} / 2)) - ln(tan(pi() / 4 - 20 * {D}))) / ((ln(tan(pi() / 4 + 20 * {D})) - ln(tan(pi() / 4 - 20 * {D}))) / 40)", "lat BETWEEN -40 AND 40 AND " + _east.format(100) + " <= 120"),
    "g03_gaussian": f"WITH {POINTS}, g(k, la) AS (VALUES {_gauss}), br AS (SELECT a.k, a.la AS hi, b.la AS lo FROM g a JOIN g b ON b.k = a.k + 1), hit AS (SELECT o_orderkey, min(k) AS k, arg_min(hi, k) AS hi, arg_min(lo, k) AS lo FROM pts JOIN br ON lat BETWEEN lo AND hi GROUP BY 1) SELECT o_orderkey, CASE WHEN lat BETWEEN -85.7606 AND 85.7606 THEN {s6(_east.format(0) + ' / 5.625')} END AS fi, CASE WHEN lat BETWEEN -85.7606 AND 85.7606 THEN CASE WHEN lat >= (SELECT max(la) FROM g) - 0.001 THEN 0.0 WHEN lat <= (SELECT min(la) FROM g) + 0.001 THEN 31.0 ELSE {s6('k + (hi - lat) / (hi - lo)')} END END AS fj FROM pts LEFT JOIN hit USING (o_orderkey)",
    "g04_lambert": _inv("i", "j", "i BETWEEN 0 AND 92 AND j BETWEEN 0 AND 64", f", k AS (SELECT *, ln(cos(25 * {D}) / cos(45 * {D})) / ln(tan(pi() / 4 + 22.5 * {D}) / tan(pi() / 4 + 12.5 * {D})) AS n), k2 AS (SELECT *, 6371200 * cos(25 * {D}) * pow(tan(pi() / 4 + 12.5 * {D}), n) / n AS rf FROM (SELECT n FROM (SELECT ln(cos(25 * {D}) / cos(45 * {D})) / ln(tan(pi() / 4 + 22.5 * {D}) / tan(pi() / 4 + 12.5 * {D})) AS n))), xy AS (SELECT o_orderkey, rf / pow(tan(pi() / 4 + lat * {D} / 2), n) AS rho, n * (lon + 95 + 180 - 360 * floor((lon + 95 + 180) / 360) - 180) * {D} AS t, rf / pow(tan(pi() / 4 + 12.19 * {D} / 2), n) AS rho1, n * (-133.459 + 95) * {D} AS t1 FROM pts, k2), pts2 AS (SELECT o_orderkey, (rho * sin(t) - rho1 * sin(t1)) / 81270.5 AS i, (rho1 * cos(t1) - rho * cos(t)) / 81270.5 AS j FROM xy)".replace(f", k AS (SELECT *, ln(cos(25 * {D}) / cos(45 * {D})) / ln(tan(pi() / 4 + 22.5 * {D}) / tan(pi() / 4 + 12.5 * {D})) AS n)", "")),
    "g05_polar": _inv("i", "j", "lat >= 0 AND i BETWEEN 0 AND 64 AND j BETWEEN 0 AND 64", f", k AS (SELECT 6371229 * (1 + sin(60 * {D})) AS r), xy AS (SELECT o_orderkey, lat, r * tan(pi() / 4 - lat * {D} / 2) AS rho, (lon + 80) * {D} AS t, r * tan(pi() / 4 - 10 * {D}) AS rho1, -45 * {D} AS t1 FROM pts, k), pts2 AS (SELECT o_orderkey, lat, (rho * sin(t) - rho1 * sin(t1)) / 190500 AS i, (rho1 * cos(t1) - rho * cos(t)) / 190500 AS j FROM xy)"),
    "g06_rotated": _inv("(rlon + 40) / (80.0::DOUBLE / 119)", "(rlat + 30) / (60.0::DOUBLE / 99)", "rlat BETWEEN -30 AND 30 AND rlon BETWEEN -40 AND 40", f", v AS (SELECT o_orderkey, cos(lon * {D}) * cos(lat * {D}) AS x, sin(lon * {D}) * cos(lat * {D}) AS y, sin(lat * {D}) AS z, -(90 - 39.25) * {D} AS t, -18 * {D} AS o FROM pts), pts2 AS (SELECT o_orderkey, asin(greatest(-1, least(1, sin(t) * cos(o) * x - sin(t) * sin(o) * y + cos(t) * z))) / {D} AS rlat, atan2(sin(o) * x + cos(o) * y, cos(t) * cos(o) * x - cos(t) * sin(o) * y - sin(t) * z) / {D} AS rlon FROM v)"),
    "g07_geostationary": _inv("i", "j", "seen AND i BETWEEN 0 AND 499 AND j BETWEEN 0 AND 499", f", a AS (SELECT *, atan({_q} * tan(lat * {D})) AS p, (lon + 75) * {D} AS dl FROM pts), b AS (SELECT *, 6356752.31414::DOUBLE / sqrt(1 - (1 - {_q}) * cos(p) * cos(p)) AS rc FROM a), c AS (SELECT *, 42164160 - rc * cos(p) * cos(dl) AS sx, -rc * cos(p) * sin(dl) AS sy, rc * sin(p) AS sz FROM b), pts2 AS (SELECT o_orderkey, 42164160::DOUBLE * (42164160 - sx) >= sy * sy + sz * sz / {_q} AS seen, (asin(-sy / sqrt(sx * sx + sy * sy + sz * sz)) + 0.15) / 0.0006 AS i, (atan(sz / sx) - 0.15) / -0.0006 AS j FROM c)"),
}
for _name, _grid in GRIDS.items():

    def _index(spark, d, g=_grid):
        i, j = g.index(F.col("lat"), F.col("lon"))
        return points(spark, d).select("o_orderkey", r6(i).alias("fi"), r6(j).alias("fj"))

    query(f"{_name}_index", INDEX_SQL[_name])(_index)


def _roundtrip(spark, d) -> DataFrame:
    """Each inner grid point of each grid through its forward and inverse map: how far it lands from itself.

    A point on the edge may land a rounding error outside, where a grid without snapping has no index.
    """
    out = None
    for k, (name, g) in enumerate(sorted(GRIDS.items())):
        p = spark.range((g.ni - 2) * (g.nj - 2)).select((F.col("id") % (g.ni - 2) + 1).alias("i"), (F.expr(f"id div {g.ni - 2}") + 1).alias("j"))
        lat, lon = g.point(F.col("i"), F.col("j"))
        p = p.withColumns({"lat": lat, "lon": lon})
        fi, fj = g.index(F.col("lat"), F.col("lon"))
        p = p.withColumns({"fi": fi, "fj": fj}).agg(F.count("fi").alias("n"), r6(F.max(F.abs(F.col("fi") - F.col("i"))), 3).alias("di"), r6(F.max(F.abs(F.col("fj") - F.col("j"))), 3).alias("dj"))
        p = p.select(F.lit(name).alias("grid"), "n", "di", "dj")
        out = p if out is None else out.unionByName(p)
    return out


query("g11_forward_roundtrip")(_roundtrip)
query("g17_normalise_lon", f"WITH {POINTS} SELECT o_orderkey, {s6('lon * 3 + 180 - 360 * floor((lon * 3 + 180) / 360) - 180')} AS lon FROM pts")(
    lambda spark, d: points(spark, d).select("o_orderkey", r6(normalise_lon(F.col("lon") * 3)).alias("lon")))
query("g20_gaussian_latitudes")(lambda spark, d: spark.createDataFrame([(n, k, round(v, 9)) for n in (16, 32, 80) for k, v in enumerate(G.gaussian_latitudes(n))], "n int, k int, lat double"))
WRAP = "({0} - 360 * (CASE WHEN {0} < 0 THEN -1 ELSE 1 END) * greatest(0, ceil(abs({0} / 360) - 0.5)))"
_dl = WRAP.format("(lon - 20)")


def _fwd(x: str, y: str, ok: str = "TRUE", src: str = "pts", pre: str = "") -> str:
    return f"WITH {POINTS}{pre} SELECT o_orderkey, CASE WHEN {ok} THEN {s6(x)} END AS x, CASE WHEN {ok} THEN {s6(y)} END AS y FROM {src}"


_nt = "0"
TARGET_SQL = {
    "t01_equirectangular": (G.Equirect(361, 181), _fwd(WRAP.format("lon") + " + 180", "90 - lat")),
    "t02_web_mercator": (G.WebMercator(361, 181, -80.0, 80.0), _fwd("lon + 180", f"(ln(tan(pi() / 4 + 40 * {D})) - ln(tan(pi() / 4 + lat * {D} / 2))) / (2 * ln(tan(pi() / 4 + 40 * {D})) / 180)", "lat > -90")),
    "t03_orthographic": (G.Orthographic(101, 101, 40.0, 10.0), _fwd(f"(cos(lat * {D}) * sin((lon - 10) * {D}) + 1) * 50", f"(1 - (cos(40 * {D}) * sin(lat * {D}) - sin(40 * {D}) * cos(lat * {D}) * cos((lon - 10) * {D}))) * 50", f"sin(40 * {D}) * sin(lat * {D}) + cos(40 * {D}) * cos(lat * {D}) * cos((lon - 10) * {D}) >= -1e-9")),
    "t04_polar": (G.Polar(101, 101, True, 15.0), _fwd(f"(tan((pi() / 2 + lat * {D}) / 2) * sin((lon - 15) * {D}) + 1) * 50", f"(1 - tan((pi() / 2 + lat * {D}) / 2) * cos((lon - 15) * {D})) * 50", "lat <= 0")),
    "t06_robinson": (G.Robinson(201, 101, 20.0), _fwd(f"((ax + t * (bx + t * (cx + t * dx))) * {_dl} / 180 + 1) * 100", "(1 - (CASE WHEN lat < 0 THEN -1 ELSE 1 END) * (ay + t * (by_ + t * (cy + t * dy)))) * 50", src="p", pre=f", {SPLINE}, p AS (SELECT pts.*, sp.*, abs(lat) / 5 - sp.k AS t FROM pts JOIN sp ON sp.k = least(floor(abs(lat) / 5), 17)::INT)")),
    "t07_equal_earth": (G.EqualEarth(201, 101, 20.0), _fwd(f"({_dl} * {D} * cos(t) / (sqrt(3) / 2 * (1.340264 - 3 * 0.081106 * t * t + pow(t, 6) * (7 * 0.000893 + 9 * 0.003796 * t * t))) / (pi() / (sqrt(3) / 2 * 1.340264)) + 1) * 100", "(1 - t * (1.340264 - 0.081106 * t * t + pow(t, 6) * (0.000893 + 0.003796 * t * t)) / (m * (1.340264 - 0.081106 * m * m + pow(m, 6) * (0.000893 + 0.003796 * m * m)))) * 50", src="p", pre=f", p AS (SELECT *, asin(sqrt(3) / 2 * sin(lat * {D})) AS t, pi() / 3 AS m FROM pts)")),
}
for _name, (_target, _sql) in TARGET_SQL.items():

    def _pixel(spark, d, t=_target):
        x, y = t.pixel(F.col("lat"), F.col("lon"))
        return points(spark, d).select("o_orderkey", r6(x).alias("x"), r6(y).alias("y"))

    query(f"{_name}_pixel", _sql)(_pixel)


def _molly(spark, d):
    """Mollweide: the auxiliary angle satisfies 2t + sin 2t = pi sin(lat), so its row gives the latitude back."""
    t = G.Mollweide(201, 101, 20.0)
    x, y = t.pixel(F.col("lat"), F.col("lon"))
    a = F.asin(F.greatest(F.least(1 - F.col("y") / 50, F.lit(1.0)), F.lit(-1.0)))
    p = points(spark, d).withColumns({"x": x, "y": y})
    return p.select("o_orderkey", r6(F.asin(F.greatest(F.least((2 * a + F.sin(2 * a)) / math.pi, F.lit(1.0)), F.lit(-1.0))) * G.DEG, 4).alias("lat"), r6((F.col("x") / 100 - 1) * 180 / F.when(F.abs(F.cos(a)) > 1e-6, F.cos(a)), 4).alias("dlon"))


query("t05_mollweide_pixel", f"WITH {POINTS} SELECT o_orderkey, {s6('lat', 4)} AS lat, CASE WHEN lat > -90 THEN {s6(_dl, 4)} END AS dlon FROM pts")(_molly)

# ---- field algebra -----------------------------------------------------------------------


def _sides(spark, d):
    f = fh(spark, d, "event_type")
    kinds = F.lit(table(spark, d, "events").agg(F.min("event_type")).first()[0]), F.lit(table(spark, d, "events").agg(F.max("event_type")).first()[0])
    return (f.where(F.col("event_type") == k).select("j", "i", "value") for k in kinds)


_AB = f"WITH {FHT}, a AS (SELECT j, i, value FROM fht WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT j, i, value FROM fht WHERE event_type = (SELECT max(event_type) FROM events))"
for _op, _e in {"a_minus_b": "a.value - b.value", "b_minus_a": "b.value - a.value", "a_plus_b": "a.value + b.value", "mean": "(a.value + b.value) / 2", "ratio": "a.value / nullif(b.value, 0)"}.items():

    def _combined(spark, d, op=_op):
        a, b = _sides(spark, d)
        return O.combine(a, b, op).select("j", "i", r6(F.col("value")).alias("value"))

    query(f"r04_combine_{_op}", f"{_AB} SELECT a.j, a.i, {s6(_e)} AS value FROM a LEFT JOIN b ON a.j = b.j AND a.i = b.i")(_combined)


#: The parts of a message's geometry that must all agree.
GEOMETRY = "grid_type ni nj lat_first lon_first lat_last lon_last scan lov lad dx dy latin1 latin2 south earth_radius earth_major earth_minor pole_lat pole_lon angle n_parallels sub_lon nr xp yp xo yo sweep_x resolution pl j_order k_order".split()
_SOURCES = ("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")


def _geoms(spark, d):
    """Two geometries of as many parts for each order: from its smallest and its largest values; the part that may differ goes by the order."""
    l = table(spark, d, "lineitem")

    def side(f):
        ends = l.groupBy(F.col("l_orderkey").alias("pair")).agg(*[f(c).alias(c) for c in _SOURCES])
        part = lambda k, g: F.when(F.col("pair") % len(GEOMETRY) == k, F.col(_SOURCES[k % len(_SOURCES)]).cast("string")).alias(g)
        return ends.select("pair", *[part(k, g) for k, g in enumerate(GEOMETRY)])

    return O.same_geometry(side(F.min), side(F.max), GEOMETRY)


_differs = " ".join(f"WHEN {k} THEN min({c}) = max({c})" for k, c in enumerate(_SOURCES))
query("j02_same_geometry", f"SELECT l_orderkey AS pair, CASE l_orderkey % {len(GEOMETRY)} % {len(_SOURCES)} {_differs} END AS same_grid FROM lineitem GROUP BY l_orderkey")(_geoms)
query("a01_value_range", "SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")(lambda spark, d: O.value_range(table(spark, d, "events"), "event_type"))
query("a10_statistics", f"SELECT vec_id AS j, count(*) AS n, count(*) - count(value) AS n_missing, {s6('min(value)')} AS lo, {s6('max(value)')} AS hi, {s6('avg(value)')} AS mean FROM (SELECT vec_id::INT AS vec_id, CASE WHEN embedding[k] >= 0 THEN embedding[k]::DOUBLE END AS value FROM embeddings, range(1, 65) t(k)) GROUP BY 1")(
    lambda spark, d: O.statistics(fe(spark, d).withColumn("value", F.when(F.col("value") >= 0, F.col("value"))), "j").select("j", "n", "n_missing", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), r6(F.col("mean")).alias("mean")))
query("a02_present_missing", "SELECT (k - 1)::INT AS i, count(*) FILTER (embedding[k] >= 0) AS n_present, count(*) FILTER (embedding[k] < 0) AS n_missing FROM embeddings, range(1, 65) t(k) GROUP BY 1")(
    lambda spark, d: fe(spark, d).groupBy("i").agg(F.count_if(F.col("value") >= 0).alias("n_present"), F.count_if(F.col("value") < 0).alias("n_missing")))


def _arc(spark, d):
    o = table(spark, d, "orders").select("o_custkey", ((F.col("o_orderkey") * 53 % 3600) / 10.0 - 180.0).alias("lon"))
    return R.enclosing_arc(o, "o_custkey").select("o_custkey", r6(F.col("lon_max") - F.col("lon_min"), 4).alias("width"), F.col("lon_min").between(-540, 180).alias("centred"))


query("a03_enclosing_arc", f"WITH p AS (SELECT DISTINCT o_custkey, ((o_orderkey * 53 % 3600) / 10.0::DOUBLE - 180) - 360 * floor(((o_orderkey * 53 % 3600) / 10.0::DOUBLE - 180) / 360) AS lon FROM orders), g AS (SELECT o_custkey, coalesce(lon - lag(lon) OVER w, lon + 360 - max(lon) OVER (PARTITION BY o_custkey)) AS gap FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY lon)) SELECT o_custkey, {s6('360 - max(gap)', 4)} AS width, TRUE AS centred FROM g GROUP BY 1")(_arc)
query("f06_cf_unpack", f"SELECT event_id, CASE WHEN value BETWEEN 20 AND 300 AND value <> 100 THEN {s6('value * 0.25 + 7')} END AS value FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", r6(O.cf_unpack(F.col("value"), 0.25, 7.0, (20.0, 300.0), [100.0])).alias("value")))
query("f04_plane", f"SELECT l_suppkey AS j, l_linenumber AS i, {s6('max(l_extendedprice)', 4)} AS value FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY ALL")(
    lambda spark, d: O.plane(table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus").agg(F.max("l_extendedprice").alias("value")), {"l_returnflag": "R", "l_linestatus": "F"}, "l_suppkey", "l_linenumber").select("j", "i", r6(F.col("value"), 4).alias("value")))

# ---- decoder steps in relational form ----------------------------------------------------
query("p12_boustrophedon", f"WITH {FE} SELECT j, CASE WHEN j % 2 = 1 THEN 63 - i ELSE i END AS i, {s6('value')} AS value FROM fe")(lambda spark, d: O.boustrophedon(fe(spark, d), 64).select("j", "i", r6(F.col("value")).alias("value")))
query("p14_simple_scaling", f"WITH {FE} SELECT j, i, {s6('(-1 + round((value + 1) * 1024) / 1024) / 10')} AS value FROM fe")(
    lambda spark, d: fe(spark, d).select("j", "i", r6(O.scaled(F.round((F.col("value") + 1) * 1024), -1.0, -10, 1)).alias("value")))


def _bitmap(spark, d):
    f = fe(spark, d).withColumnRenamed("i", "pos").withColumn("bit", (F.col("value") > 0).cast("int"))
    packed = f.where("bit = 1").withColumn("k", F.row_number().over(W.partitionBy("j").orderBy("pos")) - 1).select("j", "k", "value")
    return O.place_by_bitmap(f.select("j", "pos", "bit"), packed, "j").select("j", "pos", "bit", r6(F.col("value")).alias("value"))


query("w03_bitmap_rank", f"WITH {FE} SELECT j, i AS pos, (value > 0)::INT AS bit, CASE WHEN value > 0 THEN {s6('value')} END AS value FROM fe")(_bitmap)
query("w04_bitmap_groups", f"WITH {FE} SELECT j, i AS pos, (sum((value > 0 OR i = 0)::INT) OVER (PARTITION BY j ORDER BY i) - 1)::BIGINT AS grp FROM fe")(
    lambda spark, d: O.group_of_bitmap(fe(spark, d).withColumnRenamed("i", "pos").withColumn("bit", ((F.col("value") > 0) | (F.col("pos") == 0)).cast("int")), "j").select("j", "pos", "grp"))
for _k in (1, 2, 3):

    def _differences(spark, d, k=_k):
        f = fe(spark, d).select("j", F.col("i").alias("pos"), F.round((F.col("value") + 1) * 1024).cast("long").alias("v"))
        w = W.partitionBy("j").orderBy("pos")
        lag = lambda n: F.lag("v", n).over(w)
        diff = {1: F.col("v") - lag(1), 2: F.col("v") - 2 * lag(1) + lag(2), 3: F.col("v") - 3 * lag(1) + 3 * lag(2) - lag(3)}[k]
        x = f.withColumn("x", F.when(F.col("pos") < k, F.col("v")).otherwise(diff + 5))
        return O.undo_differences(x.select("j", "pos", "x"), k, "j", bias=-5).select("j", "pos", "value")

    query(f"w01_undo_differences_{_k}", f"WITH {FE} SELECT j, i AS pos, round((value + 1) * 1024)::BIGINT AS value FROM fe")(_differences)


def _gappy(spark, d):
    f = fe(spark, d).select("j", F.col("i").alias("pos"), F.when(F.col("value") > -0.1, F.round((F.col("value") + 1) * 1024).cast("long")).alias("v"))
    w = W.partitionBy("j", F.col("v").isNull()).orderBy("pos")
    x = f.withColumns({"n": F.row_number().over(w) - 1, "d": F.col("v") - F.lag("v").over(w)}).withColumn("x", F.when(F.col("n") == 0, F.col("v")).otherwise(F.col("d")))
    return O.skip_missing_differences(x.select("j", "pos", "x"), 1, "j").select("j", "pos", "value")


query("w02_differences_skip_missing", f"WITH {FE} SELECT j, i AS pos, CASE WHEN value > -0.1::DOUBLE THEN round((value + 1) * 1024)::BIGINT END AS value FROM fe")(_gappy)


def _runs(spark, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    l = keyed(spark, d, "lineitem", "l_orderkey").withColumn("rn", F.row_number().over(w))
    codes = l.select("l_orderkey", F.col("rn").alias("line"), F.posexplode(F.array((F.col("rn") % 4).cast("long"), F.lit(4) + F.col("l_quantity").cast("long") % 12)).alias("k", "code"))
    codes = codes.withColumn("pos", F.col("line") * 2 + F.col("k"))
    return O.run_length(codes.select("l_orderkey", "pos", "code"), 3, 4, "l_orderkey").select("l_orderkey", "pos", "level")


query("p22_run_length", "WITH q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem), r AS (SELECT l_orderkey, rn, rn % 4 AS level, 1 + l_quantity::BIGINT % 12 AS n FROM q), e AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey ORDER BY rn) AS stop FROM r) SELECT l_orderkey, (stop - n + k)::BIGINT AS pos, level::BIGINT AS level FROM e, range(0, 12) t(k) WHERE k < n")(_runs)


def _reduced(spark, d):
    l = table(spark, d, "lineitem")
    rows = l.groupBy(F.col("l_orderkey").alias("j")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"]).alias("row"))
    return O.expand_reduced(rows, F.lit(8)).select("j", "i", "value")


query("p30_expand_reduced", "WITH r AS (SELECT l_orderkey AS j, list(l_quantity ORDER BY l_linenumber, l_quantity) AS v FROM lineitem GROUP BY 1) SELECT j, k::INT AS i, v[(((k * len(v) + 4) // 8) % len(v) + 1)::INT] AS value FROM r, range(8) t(k)")(_reduced)

# ---- sinks -------------------------------------------------------------------------------
query("k01_csv_matrix", "SELECT l_orderkey AS j, string_agg(CASE WHEN l_quantity > 5 THEN (l_quantity::BIGINT)::VARCHAR ELSE '' END, ',' ORDER BY l_linenumber, l_quantity) AS line FROM lineitem GROUP BY 1")(
    lambda spark, d: O.csv_matrix(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("j"), F.struct("l_linenumber", "l_quantity").alias("i"), F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("long")).alias("value"))))
query("k02_csv_long", f"WITH {FE} SELECT {s6('CASE WHEN j = nj - 1 THEN -90 ELSE 90 - 180.0::DOUBLE * (j / (nj - 1.0::DOUBLE)) END')} AS lat, {s6('i * 5.625::DOUBLE')} AS lon, CASE WHEN value > 0 THEN {s6('value')} END AS value FROM fe, fen")(
    lambda spark, d: O.csv_long(fe(spark, d).withColumn("value", F.when(F.col("value") > 0, F.col("value"))), fe_grid(spark, d), "latlon").select(r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), r6(F.col("value")).alias("value")))

# ---- colour ------------------------------------------------------------------------------
query("r05_position_log", f"SELECT event_id, {s6('least(1, greatest(0, (log10(value) - log10(0.5)) / (log10(400) - log10(0.5))))')} AS t FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", r6(R.position(F.col("value"), F.lit(0.5), F.lit(400.0), "log10", True)).alias("t")))
_lut = ", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in enumerate(colormap.get("viridis").lut()))
_LUT = f"lut(k, r, g, b) AS (VALUES {_lut})"
query("r06_colormaps", "SELECT 'grayscale' AS name, k::INT AS idx, k::INT AS r, k::INT AS g, k::INT AS b FROM range(256) t(k)")(lambda spark, d: colormap.frame(spark, "grayscale"))
# The names, labels, kinds and anchor counts of the registered maps.
REGISTERED = """
SELECT * FROM (VALUES ('viridis', 'Viridis', 'sequential', 11), ('plasma', 'Plasma', 'sequential', 33), ('cividis', 'Cividis', 'sequential', 33),
  ('turbo', 'Turbo', 'sequential', 33), ('grayscale', 'Grayscale', 'sequential', 2), ('rdbu', 'Red–Blue', 'diverging', 33),
  ('brbg', 'Brown–Teal', 'diverging', 33), ('coolwarm', 'Cool–Warm', 'diverging', 33)) t(name, label, kind, n_anchors)
"""
query("s32_colormap_registry", REGISTERED)(lambda spark, d: spark.createDataFrame([(c.name, c.label, c.kind, len(c.anchors)) for c in colormap.REGISTRY.values()], "name string, label string, kind string, n_anchors int"))
query("r08_render", f"WITH {FE}, {_LUT}, e AS (SELECT min(value) AS lo, max(value) AS hi FROM fe), p AS (SELECT i AS px, j AS py, floor((value - lo) / (hi - lo) * 255 + 0.5)::INT AS k FROM fe, e) SELECT px, py, r::INT AS r, g::INT AS g, b::INT AS b, 255 AS a FROM p JOIN lut USING (k)")(
    lambda spark, d: R.render(fe(spark, d), fe_grid(spark, d)))
query("r07_paint_log", f"WITH {_LUT}, p AS (SELECT event_id AS px, 0 AS py, value, least(1, greatest(0, (log10(value) - log10(1)) / (log10(300) - log10(1)))) AS t FROM events) SELECT px, py, coalesce(r, 0)::INT AS r, coalesce(g, 0)::INT AS g, coalesce(b, 0)::INT AS b, CASE WHEN r IS NULL THEN 0 ELSE 255 END AS a FROM p LEFT JOIN lut ON k = 255 - floor(t * 255 + 0.5)::INT")(
    lambda spark, d: R.paint(table(spark, d, "events").select(F.col("event_id").alias("px"), F.lit(0).alias("py"), "value"), 1.0, 300.0, "viridis", True, "log10", zero_low=True))

# ---- contours, probes, overlays ----------------------------------------------------------


def _levels(spark, d):
    e = O.value_range(fh(spark, d)).first()
    return spark.createDataFrame([(v,) for v in R.nice_levels(e.lo, e.hi)], "level double")


_LV = f"{FH}, e AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 8 AS raw FROM fh), s AS (SELECT *, pow(10, floor(log10(raw))) AS p FROM e), n AS (SELECT *, (CASE WHEN raw / p < 1.5 THEN 1 WHEN raw / p < 3 THEN 2 WHEN raw / p < 7 THEN 5 ELSE 10 END) * p AS step FROM s), lv AS (SELECT floor(lo / step) * step + k * step AS level FROM n, range(0, 30) t(k) WHERE floor(lo / step) * step + k * step > lo AND floor(lo / step) * step + k * step < hi)"
query("r10_nice_levels", f"WITH {_LV} SELECT {s6('level')} AS level FROM lv")(lambda spark, d: _levels(spark, d).select(r6(F.col("level")).alias("level")))
query("r11_interval_levels", f"WITH {FH}, e AS (SELECT min(value) AS lo, max(value) AS hi FROM fh) SELECT {s6('ceil(lo / 7.5) * 7.5 + k * 7.5')} AS level FROM e, range(0, 200) t(k) WHERE ceil(lo / 7.5) * 7.5 + k * 7.5 > lo AND ceil(lo / 7.5) * 7.5 + k * 7.5 < hi")(
    lambda spark, d: (lambda e: spark.createDataFrame([(round(v, 6),) for v in R.interval_levels(e.lo, e.hi, 7.5)], "level double"))(O.value_range(fh(spark, d)).first()))
_T = "CASE WHEN {0} = {1} THEN 0.5 ELSE least(1, greatest(0, (level - {0}) / ({1} - {0}))) END"
_SEG = ", ".join(f"({c}, {a}, {b})" for c in sorted(R.SEGMENTS) for a, b in R.SEGMENTS[c])
_CON = f"WITH {_LV}, c AS (SELECT a.j, a.i, a.value AS bl, b.value AS br, x.value AS tr, y.value AS tl FROM fh a JOIN fh b ON b.j = a.j AND b.i = a.i + 1 JOIN fh x ON x.j = a.j + 1 AND x.i = a.i + 1 JOIN fh y ON y.j = a.j + 1 AND y.i = a.i), q AS (SELECT c.*, level, (bl >= level)::INT + 2 * (br >= level)::INT + 4 * (tr >= level)::INT + 8 * (tl >= level)::INT AS cs, {_T.format('bl', 'br')} AS e0, {_T.format('br', 'tr')} AS e1, {_T.format('tl', 'tr')} AS e2, {_T.format('bl', 'tl')} AS e3 FROM c, lv), sg(cs, a, b) AS (VALUES {_SEG})"
_ENDS = "SELECT level, j, i, CASE a WHEN 0 THEN i + e0 WHEN 1 THEN i + 1 WHEN 2 THEN i + e2 ELSE i END AS i0, CASE a WHEN 0 THEN j WHEN 1 THEN j + e1 WHEN 2 THEN j + 1 ELSE j + e3 END AS j0, CASE b WHEN 0 THEN i + e0 WHEN 1 THEN i + 1 WHEN 2 THEN i + e2 ELSE i END AS i1, CASE b WHEN 0 THEN j WHEN 1 THEN j + e1 WHEN 2 THEN j + 1 ELSE j + e3 END AS j1 FROM q JOIN sg USING (cs)"
query("r09_contours", f"{_CON} SELECT {s6('level')} AS level, j, i, {s6('i0')} AS i0, {s6('j0')} AS j0, {s6('i1')} AS i1, {s6('j1')} AS j1 FROM ({_ENDS})")(
    lambda spark, d: R.contours(fh(spark, d), _levels(spark, d)).select(r6(F.col("level")).alias("level"), "j", "i", *[r6(F.col(c)).alias(c) for c in ("i0", "j0", "i1", "j1")]))
_HG = G.LatLon(31, 24, 46.0, 10.0, 0.0, 70.0)
query("r12_contour_geolocation", f"{_CON} SELECT {s6('level')} AS level, j, i, {s6('46 - 2 * j0')} AS lat0, {s6('10 + 2 * i0')} AS lon0, {s6('46 - 2 * j1')} AS lat1, {s6('10 + 2 * i1')} AS lon1 FROM ({_ENDS})")(
    lambda spark, d: R.contour_lines(R.contours(fh(spark, d), _levels(spark, d)), _HG).select(r6(F.col("level")).alias("level"), "j", "i", *[r6(F.col(c)).alias(c) for c in ("lat0", "lon0", "lat1", "lon1")]))


def _probe(spark, d):
    p = table(spark, d, "orders").select((F.col("o_orderkey") % 96).cast("int").alias("px"), (F.col("o_custkey") % 96).cast("int").alias("py")).distinct()
    out = R.probe(fe(spark, d), fe_grid(spark, d), p, G.Equirect(96, 96, -85.0, 85.0, -180.0, 175.0))
    return out.select("px", "py", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), "grid_i", "grid_j", r6(F.col("value")).alias("value"))


query("r14_probe", f"WITH {FE}, p AS (SELECT DISTINCT (o_orderkey % 96)::INT AS px, (o_custkey % 96)::INT AS py FROM orders), ll AS (SELECT px, py, 85 - py * 170.0::DOUBLE / 95 AS lat, -180 + px * 355.0::DOUBLE / 95 AS lon FROM p), {CELL}, c AS (SELECT px, py, lat, lon, (floor(fi + 0.5)::INT % 64)::INT AS grid_i, least(greatest(floor(fj + 0.5), 0), (SELECT nj FROM fen) - 1)::INT AS grid_j FROM cell) SELECT px, py, {s6('lat')} AS lat, {s6('lon')} AS lon, grid_i, grid_j, {s6('value')} AS value FROM c LEFT JOIN fe ON fe.i = grid_i AND fe.j = grid_j")(_probe)
query("r13_overlay", f"WITH {TRACKS}, v AS (SELECT ring, k, lat, lon, abs({WRAP.format('(lon - 20)')} - lag({WRAP.format('(lon - 20)')}) OVER (PARTITION BY ring ORDER BY k)) > 180 AS brk, {WRAP.format('(lon - 20)')} + 180 AS x, 90 - lat AS y FROM trk), r AS (SELECT *, sum(coalesce(brk, FALSE)::INT) OVER (PARTITION BY ring ORDER BY k)::BIGINT AS run FROM v), n AS (SELECT *, count(*) OVER (PARTITION BY ring, run) AS n FROM r) SELECT ring, run, k, {s6('x')} AS x, {s6('y')} AS y FROM n WHERE n >= 2")(
    lambda spark, d: R.overlay(tracks(spark, d), G.Equirect(361, 181, -90.0, 90.0, -160.0, 200.0)).select("ring", "run", "k", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y")))
query("s31_graticule", f"SELECT * FROM (SELECT (a)::INT AS ring, b::INT AS k, {s6('b * 2.0::DOUBLE - 90')} AS lat, {s6('a * 30.0::DOUBLE - 180')} AS lon FROM range(12) m(a), range(91) s(b) UNION ALL SELECT (a + 14)::INT, b::INT, {s6('a * 30.0::DOUBLE')}, {s6('b * 2.0::DOUBLE - 180')} FROM range(-2, 3) p(a), range(181) s(b))")(
    lambda spark, d: R.graticule(spark, 30.0).select("ring", "k", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon")))


def _spectral(spark, d):
    """Synthesis of the triangle that holds all 64 mean components of the embeddings (the last two coefficients are 0)."""
    e = fe(spark, d).groupBy("i").agg(F.avg("value").alias("v"))
    c = e.select(F.expr("cast(floor((sqrt(8 * i + 1) - 1) / 2) as int)").alias("n"), F.col("i"), F.col("v"))
    c = c.select((F.col("i") - F.expr("n * (n + 1) div 2")).cast("int").alias("m"), "n", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    ni, nj = R.spectral_grid(10)
    lats, lons = [90 - 180 * k / (nj - 1) for k in range(nj)], [360 * k / ni for k in range(ni)]
    return R.synthesize(c, 10, lats, lons).select("j", "i", r6(F.col("value")).alias("value"))


query("r15_spectral_synthesis")(_spectral)
