"""Warping, colour mapping, probing, contours, overlays and spectral synthesis."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import colormap
from ..functions.geodesy import LatLon, resolve_target
from ..functions.scalar import clamp, finite, finite_or_null, normalise_lon, round_half_away, wrap_span

METHODS = ("nearest", "bilinear")


def pixels(spark: SparkSession, w: int, h: int) -> DataFrame:
    """(px, py) of a raster, distributed."""
    return spark.range(w * h).select((F.col("id") % w).cast("int").alias("px"), F.expr(f"cast(id div {w} as int)").alias("py"))


def located(spark: SparkSession, grid, target, flip: bool = False) -> DataFrame:
    """(px, py, lat, lon, fi, fj) of every pixel of a target; NULLs off the map and off the grid."""
    py = (target.h - 1 - F.col("py")) if flip else F.col("py")
    lat, lon = target.lonlat(F.col("px"), py)
    p = pixels(spark, target.w, target.h).withColumns({"lat": lat, "lon": lon})
    fi, fj = grid.index(F.col("lat"), F.col("lon"))
    return p.withColumns({"fi": fi, "fj": fj})


def _cell(grid, fi: Column, fj: Column) -> tuple[Column, Column]:
    i = round_half_away(fi)
    i = F.pmod(i, F.lit(float(grid.ni))) if getattr(grid, "periodic", False) else clamp(i, 0.0, grid.ni - 1.0)
    return i.cast("int"), clamp(round_half_away(fj), 0.0, grid.nj - 1.0).cast("int")


def warp(field: DataFrame, grid, target, method: str = "nearest", flip: bool = False) -> DataFrame:
    """(px, py, lat, lon, value): inverse warp of long rows (j, i, value) onto a target's raster.

    One equi-join of pixels with cells.  For bilinear a cell first meets its three neighbours
    (joins of the field's size), so a pixel still joins once; a missing corner makes the
    pixel missing even at weight 0.  Pixels off the map or the grid get keys of their own that
    no cell has, so they spread over all tasks.
    """
    if method not in METHODS:
        raise ValueError(f"unknown resampling {method!r}; known: {', '.join(METHODS)}")
    p = located(field.sparkSession, grid, target, flip)
    cells = field.select("j", "i", "value").hint("merge")  # as in field.combine
    off = {"i": -1 - F.col("px"), "j": -1 - F.col("py")}
    if method == "nearest":
        i, j = _cell(grid, F.col("fi"), F.col("fj"))
        keyed = p.withColumns({"i": F.coalesce(i, off["i"]), "j": F.coalesce(j, off["j"])})
        return keyed.join(cells, ["j", "i"], "left").select("px", "py", "lat", "lon", "value")
    i, j = F.floor("fi"), F.floor("fj")
    tx, ty = F.col("fi") - i, F.col("fj") - j
    i = F.pmod(i, F.lit(grid.ni)) if getattr(grid, "periodic", False) else i
    keyed = p.withColumns({"tx": tx, "ty": ty, "i": F.coalesce(i.cast("int"), off["i"]), "j": F.coalesce(j.cast("int"), off["j"])})
    x, y = F.col("tx"), F.col("ty")
    value = (1 - x) * (1 - y) * F.col("v00") + x * (1 - y) * F.col("v10") + (1 - x) * y * F.col("v01") + x * y * F.col("v11")
    return keyed.join(_corners(cells, grid).hint("merge"), ["j", "i"], "left").select("px", "py", "lat", "lon", value.alias("value"))


def _corners(cells: DataFrame, grid) -> DataFrame:
    """(j, i, v00, v10, v01, v11): each cell with its neighbours to the right, below and across; the last stand for themselves."""
    ni, nj, wraps = grid.ni, grid.nj, getattr(grid, "periodic", False)
    left = F.col("i") - 1
    right = cells.select("j", (F.pmod(left, F.lit(ni)) if wraps else left).alias("i"), F.col("value").alias("v10")).hint("merge")
    two = cells.withColumnRenamed("value", "v00").join(right, ["j", "i"], "left")
    if not wraps:
        two = two.withColumn("v10", F.when(F.col("i") == ni - 1, F.col("v00")).otherwise(F.col("v10")))
    below = two.select((F.col("j") - 1).alias("j"), "i", F.col("v00").alias("v01"), F.col("v10").alias("v11")).hint("merge")
    last = F.col("j") == nj - 1
    own = lambda c, d: F.when(last, F.col(d)).otherwise(F.col(c)).alias(c)
    return two.join(below, ["j", "i"], "left").select("j", "i", "v00", "v10", own("v01", "v00"), own("v11", "v10"))


def position(v: Column, lo: Column, hi: Column, scale: str = "linear", zero_low: bool = False) -> Column:
    """Place of v on a colour scale, in [0, 1]; 0 where the range is empty; NULL where it cannot be painted.

    Zero has no logarithm and cannot be painted on a log scale; with ``zero_low`` it takes the place of the limit, 0.
    """
    if scale not in ("linear", "log10"):
        raise ValueError(f"unknown scale {scale!r}; known: linear, log10")
    ok, zero = finite(v), F.lit(False)
    if scale == "log10":
        ok, zero = ok & (v > 0), (v == 0) & F.lit(zero_low)
        v, lo, hi = F.log10(v), F.log10(lo), F.log10(hi)
    t = F.when(lo == hi, F.lit(0.0)).otherwise(F.try_divide(v - lo, hi - lo))
    return F.when(ok, clamp(t, 0.0, 1.0)).when(zero, 0.0)


def paint(raster: DataFrame, lo: float | Column, hi: float | Column, cmap: str = "viridis", reverse: bool = False, scale: str = "linear", height: int | None = None, zero_low: bool = False) -> DataFrame:
    """(px, py, r, g, b, a): the table place by a broadcast join; unpaintable pixels are transparent."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    t = position(F.col("value"), lit(lo), lit(hi), scale, zero_low)
    table = F.broadcast(colormap.frame(raster.sparkSession, cmap, reverse=reverse).drop("name"))
    out = raster.withColumn("idx", F.floor(t * 255 + 0.5).cast("int")).join(table, "idx", "left")
    rgb = [F.coalesce(c, F.lit(0)).alias(c) for c in ("r", "g", "b")]
    py = (F.lit(height - 1) - F.col("py")).alias("py") if height else F.col("py")
    return out.select("px", py, *rgb, F.when(F.col("idx").isNull(), 0).otherwise(255).alias("a"))


def render(field: DataFrame, grid, projection: str = "source", method: str = "nearest", cmap: str = "viridis", reverse: bool = False, scale: str = "linear", value_range: tuple | None = None, flip: bool = False, **options) -> DataFrame:
    """Warp, find the range of the warped values (unless given and not empty), paint."""
    if projection == "source":
        raster = field.select(F.col("i").alias("px"), ((grid.nj - 1 - F.col("j")) if flip else F.col("j")).alias("py"), "value")
    else:
        raster = warp(field, grid, resolve_target(projection, grid.ni, grid.nj, **options), method, flip)
    if value_range and None not in value_range and value_range[1] > value_range[0]:
        return paint(raster, *value_range, cmap, reverse, scale)
    v = finite_or_null(F.col("value"))
    v = F.when(v > 0, v) if scale == "log10" else v
    ends = raster.agg(F.coalesce(F.min(v), F.lit(0.0)).alias("_lo"), F.coalesce(F.max(v), F.lit(1.0)).alias("_hi"))  # one row
    return paint(raster.crossJoin(F.broadcast(ends)), F.col("_lo"), F.col("_hi"), cmap, reverse, scale)


def probe(field: DataFrame, grid, points: DataFrame, target=None, flip: bool = False) -> DataFrame:
    """Points (px, py) to (px, py, lat, lon, grid_i, grid_j, value), always by the nearest cell.

    Pixels off the map or the raster have no row; pixels off the grid have coordinates and NULLs.
    """
    p = points.select("px", "py").where((F.col("px") >= 0) & (F.col("py") >= 0))
    if target is None:
        p = p.where((F.col("px") < grid.ni) & (F.col("py") < grid.nj))
        j = (grid.nj - 1 - F.col("py")) if flip else F.col("py")
        p = p.withColumns({"grid_i": F.col("px").cast("int"), "grid_j": j.cast("int")})
        lat, lon = grid.point(F.col("grid_i"), F.col("grid_j"))
        p = p.withColumns({"lat": lat, "lon": normalise_lon(lon)})
    else:
        p = p.where((F.col("px") < target.w) & (F.col("py") < target.h))
        lat, lon = target.lonlat(F.col("px"), (target.h - 1 - F.col("py")) if flip else F.col("py"))
        p = p.withColumns({"lat": lat, "_lon": lon}).where("lat is not null")
        fi, fj = grid.index(F.col("lat"), F.col("_lon"))
        p = p.withColumns({"fi": fi, "fj": fj})
        i, j = _cell(grid, F.col("fi"), F.col("fj"))
        p = p.withColumns({"grid_i": i, "grid_j": j, "lon": normalise_lon(F.col("_lon"))})
    cells = field.select(F.col("j").alias("grid_j"), F.col("i").alias("grid_i"), "value").hint("merge")  # as in field.combine
    return p.join(cells, ["grid_j", "grid_i"], "left").select("px", "py", "lat", "lon", "grid_i", "grid_j", "value")


# ---- contours ----------------------------------------------------------------------------


def nice_levels(lo: float, hi: float, count: int = 8) -> list[float]:
    """Levels 1, 2 or 5 times a power of ten apart, strictly inside (lo, hi)."""
    if not (math.isfinite(lo) and math.isfinite(hi)) or hi <= lo or count < 1:
        return []
    raw = (hi - lo) / count
    p = 10.0 ** math.floor(math.log10(raw))
    f = raw / p
    step = (1 if f < 1.5 else 2 if f < 3 else 5 if f < 7 else 10) * p
    first = math.floor(lo / step) * step
    return [v for v in (first + k * step for k in range(int((hi - first) / step) + 2)) if lo < v < hi]


def interval_levels(lo: float, hi: float, step: float, most: int = 2001) -> list[float]:
    """Multiples of step strictly inside (lo, hi), at most ``most`` of them."""
    if step <= 0 or not math.isfinite(step) or hi <= lo:
        return []
    first = math.ceil(lo / step) * step
    n = min(int((hi - first) / step) + 2, most + 1)
    return [v for v in (first + k * step for k in range(n)) if lo < v < hi][:most]


# The edges (bottom, right, top, left = 0..3) joined in each of the sixteen cases.
SEGMENTS = {1: [(3, 0)], 14: [(3, 0)], 2: [(0, 1)], 13: [(0, 1)], 4: [(1, 2)], 11: [(1, 2)], 7: [(3, 2)], 8: [(3, 2)], 3: [(3, 1)], 12: [(3, 1)], 6: [(0, 2)], 9: [(0, 2)], 5: [(3, 0), (1, 2)], 10: [(0, 1), (2, 3)]}


def contours(field: DataFrame, levels: DataFrame) -> DataFrame:
    """(level, j, i, i0, j0, i1, j1): marching squares over long rows (j, i, value) and levels (level).

    A cell's four corners meet by two windows-free joins (the row above, then the column to
    the right is a lead within a row); levels are few and broadcast; only levels between the
    cell's extremes make a row.
    """
    f = field.select("j", "i", F.when(finite(F.col("value")), F.col("value")).alias("bl"))
    right = W.partitionBy("j").orderBy("i")
    two = f.withColumns({"br": F.lead("bl").over(right), "ni_": F.lead("i").over(right)}).where("ni_ = i + 1").drop("ni_")
    up = two.select((F.col("j") - 1).alias("j"), "i", F.col("bl").alias("tl"), F.col("br").alias("tr")).hint("merge")
    cell = two.join(up, ["j", "i"]).where("bl is not null and br is not null and tl is not null and tr is not null")
    lo, hi = F.least("bl", "br", "tl", "tr"), F.greatest("bl", "br", "tl", "tr")
    c = cell.withColumns({"_lo": lo, "_hi": hi}).join(F.broadcast(levels.select("level")), (F.col("level") >= F.col("_lo")) & (F.col("level") <= F.col("_hi")))
    bit = lambda v, k: F.when(F.col(v) >= F.col("level"), k).otherwise(0)
    case = bit("bl", 1) + bit("br", 2) + bit("tr", 4) + bit("tl", 8)
    cross = lambda a, b: F.when(F.col(a) == F.col(b), 0.5).otherwise(clamp(F.try_divide(F.col("level") - F.col(a), F.col(b) - F.col(a)), 0.0, 1.0))
    point = lambda x, y: F.struct((F.col("i") + x).cast("double").alias("i"), (F.col("j") + y).cast("double").alias("j"))
    edges = F.array(point(cross("bl", "br"), F.lit(0)), point(F.lit(1), cross("br", "tr")), point(cross("tl", "tr"), F.lit(1)), point(F.lit(0), cross("bl", "tl")))
    pair = lambda a, b: F.struct(F.get(F.col("_e"), F.lit(a)).alias("a"), F.get(F.col("_e"), F.lit(b)).alias("b"))
    segs = F.lit(None)
    for k in sorted(SEGMENTS):
        segs = F.when(F.col("_case") == k, F.array(*[pair(a, b) for a, b in SEGMENTS[k]])).otherwise(segs)
    c = c.withColumns({"_case": case, "_e": edges}).select("level", "j", "i", F.explode(segs).alias("s"))
    return c.select("level", "j", "i", F.col("s.a.i").alias("i0"), F.col("s.a.j").alias("j0"), F.col("s.b.i").alias("i1"), F.col("s.b.j").alias("j1"))


def forward_bilinear(grid, fi: Column, fj: Column) -> tuple[Column, Column]:
    """(lat, lon) between grid points: bilinear of the four around, longitudes unwrapped to the first."""
    i0, j0 = F.least(F.floor(fi), F.lit(max(grid.ni - 2, 0))), F.least(F.floor(fj), F.lit(max(grid.nj - 2, 0)))
    tx, ty = fi - i0, fj - j0
    corner = [(grid.point(i0 + a, j0 + b), (tx if a else 1 - tx) * (ty if b else 1 - ty)) for b in (0, 1) for a in (0, 1)]
    base = corner[0][0][1]
    lat = sum((p[0] * w for p, w in corner[1:]), corner[0][0][0] * corner[0][1])
    lon = sum(((base + wrap_span(p[1] - base, 180.0)) * w for p, w in corner[1:]), base * corner[0][1])
    return lat, lon


def contour_lines(segments: DataFrame, grid) -> DataFrame:
    """Contour segments with the coordinates of both ends (grids with point coordinates)."""
    if not isinstance(grid, LatLon):
        raise ValueError("contours can be located only on grids of the latitude/longitude family")
    a, b = forward_bilinear(grid, F.col("i0"), F.col("j0")), forward_bilinear(grid, F.col("i1"), F.col("j1"))
    return segments.withColumns({"lat0": a[0], "lon0": a[1], "lat1": b[0], "lon1": b[1]})


# ---- overlays ----------------------------------------------------------------------------


def graticule(spark: SparkSession, spacing: float = 30.0, step: float = 2.0) -> DataFrame:
    """(ring, k, lat, lon): meridians and parallels every ``spacing`` degrees, sampled every ``step``.

    No meridian at +180 (it is the one at -180) and no parallel at the poles.
    """
    if not 0 < spacing <= 90:
        raise ValueError("the spacing of a graticule is over 0 and at most 90 degrees")
    meridians, parallels = int(math.ceil(360 / spacing)), int(math.ceil(90 / spacing)) - 1
    m = spark.range(meridians).select(F.col("id").cast("int").alias("ring"), (F.col("id") * spacing - 180).alias("lon"), F.posexplode(F.sequence(F.lit(0), F.lit(int(180 / step)))).alias("k", "s"))
    m = m.select("ring", "k", (F.col("s") * step - 90.0).alias("lat"), F.col("lon").cast("double").alias("lon"))
    p = spark.range(-parallels, parallels + 1).select((F.col("id") + meridians + parallels).cast("int").alias("ring"), (F.col("id") * spacing).cast("double").alias("lat"), F.posexplode(F.sequence(F.lit(0), F.lit(int(360 / step)))).alias("k", "s"))
    return m.unionByName(p.select("ring", "k", "lat", (F.col("s") * step - 180.0).alias("lon")))


def overlay(lines: DataFrame, target, flip: bool = False) -> DataFrame:
    """Polylines (ring, k, lat, lon) to runs (ring, run, k, x, y) on a target's raster.

    A run breaks where a vertex is off the map or a line crosses the map's seam; the crossing
    vertex begins the next run; runs of one vertex or far off the raster are dropped.
    """
    x, y = target.pixel(F.col("lat"), F.col("lon"))
    v = lines.withColumns({"x": x, "y": (target.h - 1 - y) if flip else y})
    if target.centre is not None:
        v = v.withColumn("_d", F.when(F.col("x").isNotNull(), wrap_span(F.col("lon") - target.centre, 180.0)))
        jump, limit = "_d", 180.0
    else:
        v, jump, limit = v.withColumn("_d", F.lit(None).cast("double")), "_d", math.inf
    return _runs(v, jump, limit, target.w, target.h)


def overlay_source(lines: DataFrame, grid, flip: bool = False) -> DataFrame:
    """Polylines on the source raster: pixels are fractional cells; a jump of over half the width is the seam."""
    i, j = grid.index(F.col("lat"), F.col("lon"))
    v = lines.withColumns({"x": i, "y": (grid.nj - 1 - j) if flip else j})
    return _runs(v, "x", grid.ni / 2, grid.ni, grid.nj)


def _runs(v: DataFrame, jump: str, limit: float, w: int, h: int) -> DataFrame:
    ring = W.partitionBy("ring").orderBy("k")
    seen = F.col("x").isNotNull() & F.col("y").isNotNull()
    brk = ~seen | (F.abs(F.col(jump) - F.lag(jump).over(ring)) > limit) if math.isfinite(limit) else ~seen
    v = v.withColumn("run", F.sum(F.coalesce(brk, F.lit(False)).cast("int")).over(ring)).where(seen)
    whole = W.partitionBy("ring", "run")
    v = v.withColumns({"_n": F.count("*").over(whole), "_x0": F.min("x").over(whole), "_x1": F.max("x").over(whole), "_y0": F.min("y").over(whole), "_y1": F.max("y").over(whole)})
    near = (F.col("_n") >= 2) & (F.col("_x0") <= 2.0 * w) & (F.col("_x1") >= -1.0 * w) & (F.col("_y0") <= 2.0 * h) & (F.col("_y1") >= -1.0 * h)
    return v.where(near).select("ring", "run", "k", "x", "y")


def enclosing_arc(lons: DataFrame, *keys: str) -> DataFrame:
    """(lon_min, lon_max): the smallest arc that holds all longitudes, its middle in [-180, 180)."""
    d = lons.select(*keys, F.pmod(F.col("lon"), F.lit(360.0)).alias("lon")).distinct()
    w = W.partitionBy(*keys).orderBy("lon")
    g = d.withColumns({"prev": F.lag("lon").over(w), "first": F.min("lon").over(W.partitionBy(*keys)), "last": F.max("lon").over(W.partitionBy(*keys))})
    gap = F.coalesce(F.col("lon") - F.col("prev"), F.col("lon") + 360.0 - F.col("last"))
    # on ties the wrap-around gap, then the first gap
    best = g.withColumn("gap", gap).groupBy(*keys).agg(F.max_by(F.struct("lon", "prev", "last"), F.struct("gap", -F.col("lon"))).alias("b"))
    lo, hi = F.col("b.lon"), F.coalesce(F.col("b.prev") + 360.0, F.col("b.last"))
    shift = normalise_lon((lo + hi) / 2) - (lo + hi) / 2
    return best.select(*keys, (lo + shift).alias("lon_min"), (hi + shift).alias("lon_max"))


# ---- spectral synthesis ------------------------------------------------------------------


def spectral_grid(t: int) -> tuple[int, int]:
    """(ni, nj) of the global grid a truncation is synthesised on."""
    nj = min(max(2 * (t + 1), 4), 361)
    return min(2 * nj, 720), nj


def synthesize(coeffs: DataFrame, truncation: int, lats: list[float], lons: list[float]) -> DataFrame:
    """(j, i, value) of spherical-harmonic coefficients (m, n, re, im) on lats x lons.

    Fully normalised Legendre functions are computed per latitude in Arrow batches of
    latitudes, all orders m of a degree n at once; the coefficients of one message are at
    most (T+1)(T+2)/2 numbers with T <= 10,000 and travel by broadcast.
    """
    import numpy as np
    import pyarrow as pa

    if truncation > 10_000:
        raise ValueError("truncation over 10000")
    spark = coeffs.sparkSession
    t = truncation
    c = np.zeros((t + 1, t + 1), complex)  # [m, n]
    for r in coeffs.where((F.col("m") <= F.col("n")) & (F.col("n") <= t)).toLocalIterator():
        c[r.m, r.n] = complex(r.re, r.im)
    held = spark.sparkContext.broadcast((c, np.array(lats), np.array(lons)))

    def run(batches):
        coef, la, lo = held.value
        m = np.arange(t + 1, dtype=np.float64)
        wave = np.exp(1j * np.outer(m, np.deg2rad(lo)))
        twice = np.where(m == 0, 1.0, 2.0)
        for b in batches:
            for j in b.column(0).to_pylist():
                mu = np.sin(np.deg2rad(la[j]))
                down = np.sqrt(max(0.0, 1 - mu * mu))
                total = np.zeros(t + 1, complex)
                p, q = np.zeros(t + 1), np.zeros(t + 1)  # degrees n - 1 and n - 2 of each order
                top = 1.0  # of order n and degree n
                for n in range(t + 1):
                    k = m[:n]
                    a = np.sqrt((2 * n + 1) * (2 * n - 1) / ((n - k) * (n + k)))
                    e = np.sqrt(np.maximum((2 * n + 1) * (n + k - 1) * (n - k - 1) / (max(2 * n - 3, 1) * (n - k) * (n + k)), 0))
                    new = np.zeros(t + 1)
                    new[:n] = a * mu * p[:n] - e * q[:n]
                    new[n] = top
                    total[: n + 1] += coef[: n + 1, n] * new[: n + 1]
                    p, q = new, p
                    top *= down * np.sqrt((2 * n + 3) / (2 * n + 2))
                v = ((total * twice)[:, None] * wave).real.sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), j, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["j", "i", "value"])

    rows = spark.range(len(lats)).select(F.col("id").cast("int").alias("j"))
    return rows.repartition(max(1, min(len(lats), spark.sparkContext.defaultParallelism))).mapInArrow(run, "j int, i int, value double")


# ---- extents and pictures ----------------------------------------------------------------

PER_EDGE = 512


def bounding_box(spark: SparkSession, grid) -> DataFrame:
    """(lat_min, lat_max, lon_min, lon_max) of a grid, from 513 points on each edge and the smallest arc.

    A grid round the globe spans 360 degrees; a polar grid that holds its pole spans all
    longitudes up to the pole.
    """
    if isinstance(grid, LatLon) and grid.periodic and type(grid).point is not None and not hasattr(grid, "pole_lat"):
        lo, hi = sorted((grid.lat_first, grid.lat_last))
        return spark.sql(f"SELECT {lo}D AS lat_min, {hi}D AS lat_max, {grid.lon_first}D AS lon_min, {grid.lon_first + 360}D AS lon_max")
    t = F.col("id") / float(PER_EDGE)
    i1, j1 = float(grid.ni - 1), float(grid.nj - 1)
    edges = F.explode(F.array(*[F.struct(F.lit(i).cast("double").alias("i") if not isinstance(i, Column) else i.alias("i"), F.lit(j).cast("double").alias("j") if not isinstance(j, Column) else j.alias("j")) for i, j in ((t * i1, 0.0), (t * i1, j1), (0.0, t * j1), (i1, t * j1))]))
    p = spark.range(PER_EDGE + 1).select(edges.alias("e")).select("e.i", "e.j")
    lat, lon = forward_bilinear(grid, F.col("i"), F.col("j")) if isinstance(grid, LatLon) and not hasattr(grid, "pole_lat") else grid.point(F.col("i"), F.col("j"))
    p = p.withColumns({"lat": lat, "lon": lon}).where("lat is not null and lon is not null")
    box = p.agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max")).crossJoin(enclosing_arc(p))  # one row each
    if hasattr(grid, "pole_inside") and grid.pole_inside():
        return box.select((F.lit(-90.0) if grid.south else F.col("lat_min")).alias("lat_min"), (F.col("lat_max") if grid.south else F.lit(90.0)).alias("lat_max"), F.lit(-180.0).alias("lon_min"), F.lit(180.0).alias("lon_max"))
    return box


def png_images(painted: DataFrame, w: int, h: int, *keys: str) -> DataFrame:
    """(keys, png): painted pixels (px, py, r, g, b, a) of each picture as PNG bytes.

    Pictures are assembled by rows, then rows by picture; pixels that are absent are transparent.
    """
    import numpy as np
    import pyarrow as pa

    from ..codec import png

    four = F.format_string("%02X%02X%02X%02X", "r", "g", "b", "a")
    rows = painted.withColumn("_c", four).groupBy(*keys, "py").agg(F.array_sort(F.collect_list(F.struct("px", "_c"))).alias("_p"))
    rows = rows.select(*keys, "py", F.transform("_p", lambda x: x["px"]).alias("_x"), F.unhex(F.array_join(F.transform("_p", lambda x: x["_c"]), "")).alias("_c"))
    rows = rows.groupBy(*keys).agg(F.collect_list(F.struct("py", "_x", "_c")).alias("_r"))
    schema = rows.select(*keys).schema.add("png", "binary")

    def run(batches):
        for b in batches:
            out = []
            pictures = b.column(b.num_columns - 1)
            for k in range(b.num_rows):
                grid = np.zeros((h, w, 4), np.uint8)
                own = pictures.slice(k, 1).flatten()
                py, px, colours = (own.field(c) for c in range(3))
                for r in range(len(own)):
                    grid[py[r].as_py(), px[r].values.to_numpy()] = np.frombuffer(colours[r].as_buffer(), np.uint8).reshape(-1, 4)
                out.append(png.encode(grid.reshape(h, 4 * w), 8, 6))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def render_slice(variable: DataFrame, fixed: dict[str, int], y: str, x: str, grid, unpack=None, **options) -> DataFrame:
    """A picture of a slice of an N-D variable in long form: fix dimensions, CF-unpack, render."""
    from .field import plane

    f = plane(variable, fixed, y, x)
    return render(f.withColumn("value", unpack(F.col("value"))) if unpack else f, grid, **options)
