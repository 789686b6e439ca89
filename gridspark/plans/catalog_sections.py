"""Queries over sections laid out by octet tables: grids, products, spectral and entropy-coded values, slices."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codec import png, synth
from ..codec import synth_sections as Y
from ..operators import render as R
from ..sources import files as S
from ..sources import grids as N
from .catalog import ORACLES, query
from .catalog_files import QUANT
from .catalog_more import _decoded, _integers, _written, gathered
from .fields import FE, fe, fe_grid, r6, s6, table


def _from_orders(spark, d, write) -> DataFrame:
    """(path = o_orderkey, content): a message per order, of its two keys."""

    def run(batches):
        for b in S.few(batches):
            out = [write(k, c) for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(out, pa.binary())], ["path", "content"])

    return table(spark, d, "orders").select("o_orderkey", "o_custkey").mapInArrow(run, "path string, content binary")


def _read(messages: DataFrame, top: str = "", grid: str = "") -> DataFrame:
    """(o_orderkey, grid_type, m): the parts of each message's metadata, which is parsed once."""
    kinds = ", ".join(x for x in (top, f"grid struct<{grid}>" if grid else "") if x)
    return S.catalog(messages).select(F.col("path").cast("long").alias("o_orderkey"), "grid_type", F.from_json("meta", kinds).alias("m"))


def _rounded(name: str, path: str):
    return r6(F.col(f"m.{path}")).alias(name)


# ---- grids -------------------------------------------------------------------------------
_GRID = ("lat_first", "lon_first", "lat_last", "lon_last", "lad", "lov", "latin1", "latin2", "pole_lat", "pole_lon", "angle", "dx", "dy", "n_parallels")
_TEMPLATES = (0, 1, 10, 20, 30, 40)


def _earth(k: int, c: int) -> bytes:
    """Shape of the earth of code c % 10; lengths stored by scale factor and scaled value."""
    code, v = c % 10, k % 1000
    radius = bytes([2]) + struct.pack(">I", 637_000_000 + v)
    axes = {3: ((2, 637_800 + v), (2, 635_600 + v)), 7: ((0, 6_378_000 + v), (0, 6_356_000 + v))}.get(code, ((0, 0), (0, 0)))
    return bytes([code]) + (radius if code == 1 else b"\0" * 5) + b"".join(bytes([s]) + struct.pack(">I", x) for s, x in axes)


def _grid_numbers(k: int, c: int, unit: int) -> dict:
    """Numbers of a grid as stored, with ``unit`` steps to a degree."""
    at = lambda m, n: k * m % (180 * unit + 1) - 90 * unit if n else k * m % (360 * unit)
    return {
        "lat_first": at(7919, 1), "lon_first": at(104729, 0) // (2 if unit == 1000 else 1), "lat_last": at(1299709, 1), "lon_last": at(15485863, 0) // (2 if unit == 1000 else 1), "lad": at(611953, 1), "lov": at(350377, 0) // (2 if unit == 1000 else 1),
        "latin1": at(27644437, 1), "latin2": at(198491317, 1), "pole_lat": at(6700417, 1), "pole_lon": at(524287, 0) // (2 if unit == 1000 else 1), "angle": (c % 720) / 4 - 90, "dx": 1 + c % 9000, "dy": 1 + k % 9000, "scan": 64, "centre": 128 * (c % 2),
    }


def _grid2(k: int, c: int) -> bytes:
    return Y.grid_message2(_TEMPLATES[k % 6], 1 + c % 50, 1 + k % 40, _earth(k, c), **_grid_numbers(k, c, 1_000_000))


def _grid1(k: int, c: int) -> bytes:
    return Y.grid_message1((0, 1, 3, 4, 5, 10)[k % 6], 1 + c % 50, 1 + k % 40, **_grid_numbers(k, c, 1000))


def _grid_rows(write):
    def run(spark, d):
        f = _read(_from_orders(spark, d, write), grid="ni int, nj int, south boolean, " + ", ".join(f"{n} double" for n in _GRID))
        return f.select("o_orderkey", "grid_type", "m.grid.ni", "m.grid.nj", "m.grid.south", *[_rounded(n, f"grid.{n}") for n in _GRID])

    return run


def _grid_sql(unit: int, first: int) -> str:
    """Which numbers a kind of grid has, from the octet tables; kinds in the order of ``o_orderkey % 6``."""
    names = ["latlon", "rotated_latlon", "mercator", "polar_stereographic", "lambert", "gaussian"] if first == 2 else ["latlon", "mercator", "lambert", "gaussian", "polar_stereographic", "rotated_latlon"]
    half = "" if first == 2 else " // 2"
    lat = lambda m: f"(o_orderkey * {m} % {180 * unit + 1} - {90 * unit}) / {unit}::DOUBLE"
    lon = lambda m: f"(o_orderkey * {m} % {360 * unit}{half}) / {unit}::DOUBLE"
    ends, plane = "('latlon', 'rotated_latlon', 'gaussian', 'mercator')", "('lambert', 'polar_stereographic')"
    step = 1000 if first == 2 else 1  # lengths are in millimetres in edition 2, in metres in edition 1
    lad = f"CASE grid_type WHEN 'lambert' THEN {lat(27644437)} WHEN 'polar_stereographic' THEN 60.0 WHEN 'mercator' THEN {lat(611953)} END" if first == 1 else f"CASE WHEN grid_type IN ('lambert', 'polar_stereographic', 'mercator') THEN {lat(611953)} END"
    cols = {
        "lat_first": lat(7919), "lon_first": lon(104729), "lat_last": f"CASE WHEN grid_type IN {ends} THEN {lat(1299709)} END", "lon_last": f"CASE WHEN grid_type IN {ends} THEN {lon(15485863)} END",
        "lad": lad, "lov": f"CASE WHEN grid_type IN {plane} THEN {lon(350377)} END", "latin1": f"CASE grid_type WHEN 'lambert' THEN {lat(27644437)} END", "latin2": f"CASE grid_type WHEN 'lambert' THEN {lat(198491317)} END",
        "pole_lat": f"CASE grid_type WHEN 'rotated_latlon' THEN {lat(6700417)} END", "pole_lon": f"CASE grid_type WHEN 'rotated_latlon' THEN {lon(524287)} END", "angle": "CASE grid_type WHEN 'rotated_latlon' THEN (o_custkey % 720) / 4.0::DOUBLE - 90 END",
        "dx": f"CASE WHEN grid_type IN ('lambert', 'polar_stereographic', 'mercator') THEN (1 + o_custkey % 9000) / {step}::DOUBLE END", "dy": f"CASE WHEN grid_type IN ('lambert', 'polar_stereographic', 'mercator') THEN (1 + o_orderkey % 9000) / {step}::DOUBLE END",
        "n_parallels": "CASE grid_type WHEN 'gaussian' THEN (1 + o_orderkey % 9000)::DOUBLE END",
    }
    return (
        f"WITH o AS (SELECT o_orderkey, o_custkey, {names}[(o_orderkey % 6 + 1)::INT] AS grid_type FROM orders) SELECT o_orderkey, grid_type, (1 + o_custkey % 50)::INT AS ni, (1 + o_orderkey % 40)::INT AS nj, "
        f"CASE WHEN grid_type IN {plane} THEN o_custkey % 2 = 1 END AS south, " + ", ".join(f"{s6(v)} AS {k}" for k, v in cols.items()) + " FROM o"
    )


query("s12_grib2_grids", _grid_sql(1_000_000, 2))(_grid_rows(_grid2))
query("s07_grib1_grids", _grid_sql(1000, 1))(_grid_rows(_grid1))
# Code table 3.2, in metres.
query("s13_earth_shapes",
    "WITH o AS (SELECT o_orderkey, (o_custkey % 10)::INT AS code, o_orderkey % 1000 AS v FROM orders) SELECT o_orderkey, "
    f"{s6('CASE code WHEN 0 THEN 6367470 WHEN 1 THEN 6370000 + v / 100.0::DOUBLE WHEN 2 THEN 6378160 WHEN 3 THEN (637800 + v) * 10 WHEN 4 THEN 6378137 WHEN 5 THEN 6378137 WHEN 6 THEN 6371229 WHEN 7 THEN 6378000 + v WHEN 8 THEN 6371200 ELSE 6377563.396::DOUBLE END')} AS major, "
    f"{s6('CASE code WHEN 0 THEN 6367470 WHEN 1 THEN 6370000 + v / 100.0::DOUBLE WHEN 2 THEN 6356775 WHEN 3 THEN (635600 + v) * 10 WHEN 4 THEN 6356752.314::DOUBLE WHEN 5 THEN 6356752.314245::DOUBLE WHEN 6 THEN 6371229 WHEN 7 THEN 6356000 + v WHEN 8 THEN 6371200 ELSE 6356256.909::DOUBLE END')} AS minor FROM o")(
    lambda spark, d: _read(_from_orders(spark, d, _grid2), grid="earth_major double, earth_minor double").select("o_orderkey", _rounded("major", "grid.earth_major"), _rounded("minor", "grid.earth_minor")))
query("s08_predefined_grids", "SELECT o_orderkey, [144, 360, 720][(o_orderkey % 3 + 1)::INT] AS ni, [73, 181, 361][(o_orderkey % 3 + 1)::INT] AS nj, 90.0 AS lat_first, [357.5, 359.0, 359.5][(o_orderkey % 3 + 1)::INT]::DOUBLE AS lon_last FROM orders")(
    lambda spark, d: S.catalog(_from_orders(spark, d, lambda k, c: Y.message1(None, synth.bds(0, 0, 0.0, 0, b""), 2 + k % 3))).select(F.col("path").cast("long").alias("o_orderkey"), "ni", "nj", "lat_first", "lon_last"))


def _product(k: int, c: int) -> bytes:
    first = (255, None, None) if k % 7 == 0 else (k % 120, c % 11 - 5, k - 3000 * (c % 3))
    second = (103, None, 5) if k % 5 == 0 else (c % 200, 1, None) if k % 5 == 1 else (c % 200, 2, c)
    s4 = Y.product2((0, 8, 11)[k % 3], c % 192, k % 192, k % 14, c - 700, first, second)
    return Y.message2(Y.grid2(0, 1, 1, b"\x06"), s4, 0, synth.red(0.0, 0, 0, 0) + b"\0", b"", 1)


query("s14_products",
    "SELECT o_orderkey, [0, 8, 11][(o_orderkey % 3 + 1)::INT] AS template, (o_custkey % 192)::INT AS category, (o_orderkey % 192)::INT AS number, (o_orderkey % 14)::INT AS unit, (o_custkey - 700)::INT AS forecast, "
    "CASE WHEN o_orderkey % 7 = 0 THEN 255 ELSE o_orderkey % 120 END::INT AS kind, "
    f"CASE WHEN o_orderkey % 7 <> 0 THEN {s6('(o_orderkey - 3000 * (o_custkey % 3)) * pow(10, -(o_custkey % 11 - 5))')} END AS surface, CASE WHEN o_orderkey % 5 >= 2 THEN round(o_custkey / 100.0::DOUBLE, 6) END AS surface2 FROM orders")(
    lambda spark, d: _read(_from_orders(spark, d, _product), "product_template int, category int, number int, time_unit int, forecast_time int, surface_type int, surface_value double, surface2_value double").select(
        "o_orderkey", *[F.col(f"m.{a}").alias(n) for a, n in (("product_template", "template"), ("category", "category"), ("number", "number"), ("time_unit", "unit"), ("forecast_time", "forecast"), ("surface_type", "kind"))], _rounded("surface", "surface_value"), _rounded("surface2", "surface2_value")))


def _reprojectable(spark, d):
    names = ("latlon", "reduced_gaussian", "lambert", "space_view", "spherical_harmonic", "rotated_latlon", "polar_stereographic", "reduced_lambert", "mercator")
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.get(F.array(*map(F.lit, names)), (F.col("l_partkey") % 9).cast("int")).alias("grid_type"), ((F.col("l_suppkey") % 4) * 64).cast("int").alias("scan"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 3 - 1).cast("double").alias("dx"))
    return t.select("l_orderkey", "l_linenumber", "grid_type", N.reprojectable(F.col("grid_type"), F.col("dx"), F.lit(-1.0), F.col("scan")).alias("can"))


query("f05_reprojectable",
    "WITH l AS (SELECT l_orderkey, l_linenumber, ['latlon', 'reduced_gaussian', 'lambert', 'space_view', 'spherical_harmonic', 'rotated_latlon', 'polar_stereographic', 'reduced_lambert', 'mercator'][(l_partkey % 9 + 1)::INT] AS grid_type, l_partkey % 9 AS k, l_suppkey % 4 AS s, l_suppkey % 3 AS x FROM lineitem)"
    " SELECT l_orderkey, l_linenumber, grid_type, CASE WHEN k IN (0, 1, 5, 8) THEN s < 2 WHEN k IN (2, 3, 6) THEN x = 2 ELSE false END AS can FROM l")(_reprojectable)  # fmt: skip

# ---- values ------------------------------------------------------------------------------
_PLAIN = f"WITH {FE} SELECT j, i, CASE WHEN {QUANT} = 1024 THEN 0.0 ELSE round(-1 + {QUANT} / 1024, 6) END AS value FROM fe"
query("p05_grib1_row_by_row", _PLAIN)(_decoded(lambda v: Y.classic1(_integers(v), 8, 8, "rows")))
query("p06_grib1_constant_width", _PLAIN)(_decoded(lambda v: Y.classic1(_integers(v), 8, 8, "constant")))
query("p07_grib1_general", _PLAIN)(_decoded(lambda v: Y.classic1(_integers(v), 8, 8, "general")))
query("p20_grib2_ccsds", _PLAIN)(_decoded(lambda v: Y.ccsds2(_integers(v), 8, 8)))
# few values, so that zero blocks and pairs are the shortest codes
query("p20_grib2_ccsds_runs", f"WITH {FE} SELECT j, i, floor(greatest({QUANT} - 1224, 0) / 64) AS value FROM fe")(
    _decoded(lambda v: Y.ccsds2(np.maximum(_integers(v) - 1224, 0) // 64, 8, 8, 5, 8, 8, 0.0, 0)))

T = 6  # truncation whose 28 coefficients a vector of 64 fills
_PAIRS = "WITH c AS (SELECT vec_id AS id, m::INT AS m, n::INT AS n, m * 7 - m * (m - 1) // 2 + n - m AS slot, embedding AS e FROM embeddings, range(7) a(m), range(7) b(n) WHERE n >= m)"


def _coefficients(write):
    def run(spark, d):
        return S.coefficients(_written(spark, d, write)).select(F.col("path").cast("long").alias("id"), "m", "n", r6(F.col("re")).alias("re"), r6(F.col("im")).alias("im"))

    return run


def _quantised(k: str) -> str:
    return f"-1 + round((e[({k})::INT]::DOUBLE + 1) * 1024) / 1024"


_SIMPLE = f"{_PAIRS} SELECT id, m, n, CASE WHEN n = 0 THEN 2.5 ELSE {s6(_quantised('2 * slot - 1'))} END AS re, CASE WHEN m = 0 THEN 0.0 ELSE {s6(_quantised('2 * slot'))} END AS im FROM c"
query("p26_grib2_spectral", _SIMPLE)(_coefficients(lambda v: Y.spectral2(T, 2.5, _integers(v)[:54])))
query("p11_grib1_spectral", _SIMPLE)(_coefficients(lambda v: Y.spectral1(T, 2.5, _integers(v)[:54])))


def _scaled_message(v: np.ndarray) -> bytes:
    """Pairs with n <= 2 as they are, the others packed, each in order of m, then n."""
    inner = np.repeat([n <= 2 for m in range(T + 1) for n in range(m, T + 1)], 2)
    return Y.spectral_scaled2(T, 2, v[:56][inner], _integers(v)[:56][~inner], 0.5)


query("p26_grib2_spectral_scaled",
    f"{_PAIRS} SELECT id, m, n, CASE WHEN n <= 2 THEN {s6('e[(2 * slot + 1)::INT]::DOUBLE')} ELSE {s6('(' + _quantised('2 * slot + 1') + ') / sqrt(n * (n + 1))')} END AS re, "
    f"CASE WHEN m = 0 THEN 0.0 WHEN n <= 2 THEN {s6('e[(2 * slot + 2)::INT]::DOUBLE')} ELSE {s6('(' + _quantised('2 * slot + 2') + ') / sqrt(n * (n + 1))')} END AS im FROM c")(_coefficients(_scaled_message))  # fmt: skip

# ---- NetCDF slices and pictures ----------------------------------------------------------


def _gridded(spark, d) -> DataFrame:
    """(path = vec_id, content): a variable (time, lat, lon) of 4 x 4 x 4 values with a grid mapping, per embedding."""

    def run(batches):
        for b in S.few(batches):
            out = []
            for k, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k, place = int(k), np.arange(4.0)
                kind = ("latitude_longitude", "albers_conical_equal_area", None)[k % 3]
                crs = {"crs": (["time"], np.zeros(4), {"grid_mapping_name": kind})} if kind else {}
                t = (["time", "lat", "lon"], _integers(np.array(e, np.float64)).astype(np.int16).reshape(4, 4, 4), {"scale_factor": np.float64(0.5)} | ({"grid_mapping": "crs"} if k % 3 < 2 or k % 2 else {}))
                out.append(synth.netcdf3({"time": 4, "lat": 4, "lon": 4}, {"t": t, "lat": (["lat"], k % 50 - place, {}), "lon": (["lon"], k % 100 + 2 * place, {})} | crs))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(out, pa.binary())], ["path", "content"])

    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "path string, content binary")


query("j08_grid_mapping", "SELECT vec_id::BIGINT AS id, 't' AS name, CASE vec_id % 3 WHEN 0 THEN 'latitude_longitude' ELSE 'albers_conical_equal_area' END AS mapping FROM embeddings WHERE vec_id % 3 < 2")(
    lambda spark, d: N.grid_mappings(S.variables(_gridded(spark, d))).select(F.col("path").cast("long").alias("id"), "name", F.col("mapping_attrs")["grid_mapping_name"].alias("mapping")))
query("l16_slice_geometry",
    "SELECT vec_id::BIGINT AS id, 4 AS ni, 4 AS nj, CASE WHEN vec_id % 3 <> 1 THEN 'LatLon' END AS kind, CASE WHEN vec_id % 3 <> 1 THEN (vec_id % 50)::DOUBLE END AS lat_first, CASE WHEN vec_id % 3 <> 1 THEN (vec_id % 100)::DOUBLE END AS lon_first,"
    " CASE WHEN vec_id % 3 <> 1 THEN (vec_id % 50 - 3)::DOUBLE END AS lat_last, CASE WHEN vec_id % 3 <> 1 THEN (vec_id % 100 + 6)::DOUBLE END AS lon_last, 0.5 AS scale FROM embeddings")(
    lambda spark, d: N.slices(_gridded(spark, d), "t", "lat", "lon").select(F.col("path").cast("long").alias("id"), "ni", "nj", "kind", *[F.get_json_object("grid", f"$[{k}]").cast("double").alias(n) for k, n in ((2, "lat_first"), (3, "lon_first"), (4, "lat_last"), (5, "lon_last"))], F.get_json_object("unpacking", "$[0]").cast("double").alias("scale")))


def _whole(spark, d) -> DataFrame:
    """The embeddings as one NetCDF file: t(time, lat, lon), a latitude each, doubled at the second time."""

    def write(v):
        x = _integers(v) - 1024
        return x.astype(">i4").tobytes(), (2 * x).astype(">i4").tobytes()

    def whole(n, *times):
        lat = 90.0 - np.arange(n) * 180.0 / (n - 1)
        t = (["time", "lat", "lon"], np.frombuffer(b"".join(times), ">i4").reshape(2, n, 64), {"scale_factor": np.float64(1 / 1024)})
        return synth.netcdf3({"time": 2, "lat": n, "lon": 64}, {"t": t, "lat": (["lat"], lat, {}), "lon": (["lon"], np.arange(64) * 5.625, {})})

    return gathered(spark, d, write, whole)


def _slice_probe(spark, d):
    """Every cell of the second time, probed at its own place."""
    f, grid = N.slice_field(_whole(spark, d), "t", "lat", "lon", {"time": 1})
    lat, lon = grid.point(F.col("i"), F.col("j"))
    return f.withColumns({"lat": r6(lat), "lon": r6(lon), "value": r6(F.col("value"))}).select("j", "i", "lat", "lon", "value")


query("r18_slice_field", f"WITH {FE} SELECT j, i, {s6('90 - j * 180::DOUBLE / (nj - 1)')} AS lat, {s6('i * 5.625::DOUBLE')} AS lon, {s6(f'({QUANT} - 1024) / 512')} AS value FROM fe, fen")(_slice_probe)


def _pictures(spark, d):
    """The rendered field as a PNG, and its pixels again."""
    grid = fe_grid(spark, d)
    images = R.png_images(R.render(fe(spark, d), grid).withColumn("one", F.lit(1)), grid.ni, grid.nj, "one")

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = png.decode(raw)[0].reshape(grid.nj, grid.ni, 4).astype(np.int32)
                py, px = np.divmod(np.arange(grid.ni * grid.nj, dtype=np.int32), np.int32(grid.ni))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (px, py, *rows.reshape(-1, 4).T.copy())], ["px", "py", "r", "g", "b", "a"])

    return images.select("png").mapInArrow(run, "px int, py int, r int, g int, b int, a int")


query("k05_png_pictures", ORACLES["r08_render"])(_pictures)


def _listed(spark, d):
    """HDF5 files of three variables written out of order, with attributes."""

    def write(v):
        k = int(_integers(v[:1])[0])
        x = np.arange(4, dtype=np.float32).reshape(2, 2)
        return synth.hdf5({"zeta": (x, {"units": f"m{k}"}), "alpha": (x.astype(np.int16), {"scale_factor": np.float64(k / 4), "flag_values": np.array([k, 1, 2], np.int16)}), "mid": (x, {})})

    return S.variables(_written(spark, d, write)).select(F.col("path").cast("long").alias("id"), "name", "decode_index", "type", F.try_element_at("attrs", F.lit("units")).alias("units"), F.try_element_at("attrs", F.lit("scale_factor")).cast("double").alias("scale"), F.try_element_at("attrs", F.lit("flag_values")).alias("flags"))


query("s22_hdf5_attributes",
    "WITH q AS (SELECT vec_id::BIGINT AS id, round((embedding[1]::DOUBLE + 1) * 1024)::INT AS k FROM embeddings) SELECT id, name, pos::INT AS decode_index, type, CASE name WHEN 'zeta' THEN 'm' || k END AS units, CASE name WHEN 'alpha' THEN k / 4.0::DOUBLE END AS scale, CASE name WHEN 'alpha' THEN k || ', 1, 2' END AS flags"
    " FROM q, (VALUES ('alpha', 0, 'short'), ('mid', 1, 'float'), ('zeta', 2, 'float')) v(name, pos, type)")(_listed)  # fmt: skip
