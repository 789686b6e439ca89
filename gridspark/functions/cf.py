"""CF conventions: axes, renderable variables and grid mappings of NetCDF catalogs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geodesy import Geostationary, Lambert, LatLon, Mercator, PolarStereo

# Coordinate names that stand for an axis when no attribute does.
LAT_NAMES = ("lat", "latitude", "y", "nav_lat", "yc")
LON_NAMES = ("lon", "long", "longitude", "x", "nav_lon", "xc")
WRF = {1.0: "lambert", 2.0: "polar_stereographic", 3.0: "mercator", 6.0: "latlon"}


def axis(units: Column, standard_name: Column, axis_attr: Column, name: Column) -> Column:
    """'latitude', 'longitude' or NULL: units first, then standard_name, then axis, then the name."""
    way = F.lower(F.regexp_extract(F.trim(units), r"^degrees?[_ ]*([A-Za-z]*)$", 1))
    by_units = F.when(way.isin("north", "n"), "latitude").when(way.isin("east", "e"), "longitude")
    std = F.when(F.trim(standard_name).isin("latitude", "longitude"), F.trim(standard_name))
    by_axis = F.when(F.trim(axis_attr) == "Y", "latitude").when(F.trim(axis_attr) == "X", "longitude")
    by_name = F.when(F.lower(name).isin(*LAT_NAMES), "latitude").when(F.lower(name).isin(*LON_NAMES), "longitude")
    return F.coalesce(by_units, std, by_axis, by_name)


def is_coordinate(name: Column, dims: Column) -> Column:
    return (F.size(dims) == 1) & (F.get(dims, F.lit(0)) == name)


def renderable(variables: DataFrame) -> DataFrame:
    """Numeric variables of rank 2 or more that are no coordinates, with the axes found among their dimensions.

    variables: path, name, type, dims array, attrs map.
    """
    v = variables.withColumn("axis", F.when(is_coordinate(F.col("name"), F.col("dims")), axis(*[F.try_element_at("attrs", F.lit(k)) for k in ("units", "standard_name", "axis")], F.col("name"))))
    coord = v.where("axis is not null").groupBy("path", "axis").agg(F.min("name").alias("dim"))
    lat = coord.where("axis = 'latitude'").select("path", F.col("dim").alias("_lat"))
    lon = coord.where("axis = 'longitude'").select("path", F.col("dim").alias("_lon"))
    own = v.where((F.col("type") != "char") & (F.size("dims") >= 2)).join(lat, "path", "left").join(lon, "path", "left")
    at = lambda c: F.when(F.array_position("dims", F.col(c)) > 0, F.array_position("dims", F.col(c)) - 1).cast("int")
    return own.withColumns({"y_dim": at("_lat"), "x_dim": at("_lon")}).drop("_lat", "_lon", "axis")


def corner_and_regularity(coords: DataFrame, *keys: str) -> DataFrame:
    """First, last and evenness (every step within a thousandth of the mean step) of coordinates (keys, k, value)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy("k")
    d = coords.withColumn("step", F.col("value") - F.lag("value").over(w))
    ends = d.groupBy(*keys).agg(F.min_by("value", "k").alias("first"), F.max_by("value", "k").alias("last"), F.count("*").alias("n"), F.min("step").alias("_a"), F.max("step").alias("_b"), F.max("step").alias("_m"))
    mean = (F.col("last") - F.col("first")) / F.when(F.col("n") > 1, F.col("n") - 1)
    even = F.coalesce((F.abs(F.col("_a") - mean) <= F.abs(mean) * 1e-3) & (F.abs(F.col("_b") - mean) <= F.abs(mean) * 1e-3), F.lit(True))
    return ends.select(*keys, "first", "last", "n", even.alias("regular"), (F.col("_m") < 0).alias("falling"))


def _number(attrs: dict, key: str) -> float | None:
    v = attrs.get(key)
    v = v[0] if isinstance(v, (list, tuple)) and v else v
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def _step(axis_values: list[float]) -> tuple[float, float] | None:
    n = len(axis_values)
    if n < 2:
        return None
    return axis_values[0], (axis_values[-1] - axis_values[0]) / (n - 1)


def geostationary(mapping: dict, x: list[float], y: list[float]) -> Geostationary | None:
    """The grid of a CF geostationary mapping; x and y are scan angles after unpacking."""
    if str(mapping.get("grid_mapping_name", "")).strip() != "geostationary":
        return None
    h, a, b, lon = (_number(mapping, k) for k in ("perspective_point_height", "semi_major_axis", "semi_minor_axis", "longitude_of_projection_origin"))
    sx, sy = _step(x), _step(y)
    if None in (h, a, b, lon) or sx is None or sy is None:
        return None
    return Geostationary(len(x), len(y), h + a, a, b, lon, str(mapping.get("sweep_angle_axis", "x")).strip() != "y", *sx, *sy)


def wrf(attrs: dict, lat_first: float, lon_first: float, ni: int, nj: int, lat_last: float | None = None, lon_last: float | None = None):
    """The grid of a WRF file's global attributes, NULL-like None where they do not suffice."""
    kind = WRF.get(_number(attrs, "MAP_PROJ") or 0.0)
    dx, dy, t1, t2, lov, mid = (_number(attrs, k) for k in ("DX", "DY", "TRUELAT1", "TRUELAT2", "STAND_LON", "MOAD_CEN_LAT"))
    if kind in ("lambert", "polar_stereographic"):
        if None in (dx, dy, t1, lov) or not (math.isfinite(dx) and math.isfinite(dy)) or not dx or not dy:
            return None
        if kind == "lambert":
            return Lambert(ni, nj, lat_first, lon_first, lov, dx, dy, 6_370_000.0, t1 if mid is None else mid, t1, t1 if t2 is None else t2)
        return PolarStereo(ni, nj, lat_first, lon_first, lov, dx, dy, 6_370_000.0, t1, t1 < 0)
    if lat_last is None or lon_last is None:
        return None
    if kind == "mercator":
        return Mercator(ni, nj, lat_first, lon_first, lat_last, lon_last)
    if kind == "latlon":
        pole_lat, pole_lon = _number(attrs, "POLE_LAT"), _number(attrs, "POLE_LON")
        plain = (pole_lat is None or abs(pole_lat - 90) < 1e-6) and (pole_lon is None or abs(pole_lon) < 1e-6)
        return LatLon(ni, nj, lat_first, lon_first, lat_last, lon_last) if plain else None
    return None
