"""Queries over bytes: every embedding row is written as a small file by our own writers and read back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codec import synth
from ..functions import cf
from ..functions import tables as T
from ..sources import files as S
from .catalog import query
from .fields import FE, r6, table

QUANT = "round((value + 1) * 1024)"


def _files(spark, d, kind: str) -> DataFrame:
    """(path = vec_id, content): one 8 x 8 message per embedding, quantised to 1/1024."""

    def run(batches):
        for b in S.few(batches):
            out = []
            for e in b.column(1).to_pylist():
                v = np.array(e, np.float64)
                x = np.floor((v + 1) * 1024 + 0.5).astype(np.int64)
                out.append(_write(kind, x, v))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("path"), "embedding").mapInArrow(run, "path string, content binary")


def _write(kind: str, x: np.ndarray, v: np.ndarray) -> bytes:
    if kind == "bitmap":
        m = v > 0
        return synth.simple2(x[m], 8, 8, bitmap=m.astype(int))
    if kind == "runs":
        return synth.run_length2(np.where(v > 0.1, 3, np.where(v > -0.1, 1, 0)), 8, 8)
    if kind == "netcdf3":
        return synth.netcdf3({"time": 0, "x": 8}, {"t": (["time", "x"], x.astype(np.int16).reshape(8, 8), {"_FillValue": np.int16(1024), "scale_factor": np.float64(0.5)})}, {"title": "t"}, 2)
    if kind == "extensible":
        return synth.hdf5({"t": (x.astype(np.int16).reshape(8, 8), {"_FillValue": np.int16(1024)})}, (1, 3), 0)
    if kind == "hdf5":
        return synth.hdf5({"t": (x.astype(np.int16).reshape(8, 8), {"_FillValue": np.int16(1024)})}, (3, 5))
    return {
        "simple": lambda: synth.simple2(x, 8, 8), "complex": lambda: synth.complex2(x, 8, 8), "spatial1": lambda: synth.complex2(x, 8, 8, 1), "spatial2": lambda: synth.complex2(x, 8, 8, 2),
        "second_order": lambda: synth.second_order2(x, 8, 8, 2), "turned": lambda: synth.second_order2(x, 8, 8, 1, turned=True),
        "grib1": lambda: synth.simple1(x, 8, 8), "grib1_second_order": lambda: synth.second_order1(x, 8, 8, 3),
    }[kind]()


def _decoded(kind: str):
    def run(spark, d):
        f = S.fields(_files(spark, d, kind))
        return f.select(F.col("path").cast("int").alias("j"), F.posexplode_outer("values").alias("i", "value")).select("j", "i", r6(F.col("value")).alias("value"))

    return run


_PLAIN = f"WITH {FE} SELECT j, i, CASE WHEN {QUANT} = 1024 THEN 0.0 ELSE round(-1 + {QUANT} / 1024, 6) END AS value FROM fe"
for _key, _kind in {"p14_grib2_simple": "simple", "p16_grib2_complex": "complex", "p17_grib2_spatial_1": "spatial1", "p17_grib2_spatial_2": "spatial2", "p23_grib2_second_order": "second_order", "p24_grib2_boustrophedonic": "turned", "p02_grib1_simple": "grib1", "p04_grib1_second_order": "grib1_second_order"}.items():
    query(_key, _PLAIN)(_decoded(_kind))


def _shared_out(spark, d):
    """Files of sixteen messages each, decoded message by message."""
    one = _files(spark, d, "spatial2").select(F.expr("path::int div 16").alias("file"), F.struct(F.col("path").cast("int").alias("k"), "content").alias("m"))
    whole = one.groupBy("file").agg(F.array_sort(F.collect_list("m")).alias("m"))
    bytes_ = F.aggregate("m", F.lit(b""), lambda a, m: F.concat(a, m["content"]))
    f = S.fields(S.spread(whole.select(F.col("file").cast("string").alias("path"), bytes_.alias("content"))))
    j = F.col("path").cast("int") * 16 + F.col("message_index")
    return f.select(j.alias("j"), F.posexplode_outer("values").alias("i", "value")).select("j", "i", r6(F.col("value")).alias("value"))


query("r19_messages_of_files", _PLAIN)(_shared_out)
query("p28_grib2_bitmap", f"WITH {FE} SELECT j, i, CASE WHEN value > 0 THEN CASE WHEN {QUANT} = 1024 THEN 0.0 ELSE round(-1 + {QUANT} / 1024, 6) END END AS value FROM fe")(_decoded("bitmap"))
query("p22_grib2_run_length", f"WITH {FE} SELECT j, i, CASE WHEN value > 0.1::DOUBLE THEN 3.0 WHEN value > -0.1::DOUBLE THEN 1.0 END AS value FROM fe")(_decoded("runs"))
query("s29_message_listing", "SELECT vec_id AS id, 0 AS message_index, 2 AS edition, 'latlon' AS grid_type, 8 AS ni, 8 AS nj, 90.0 AS lat_first, 354.375 AS lon_last, 'grid_complex' AS packing, '2024-03-14T15:09:26Z' AS reference_time FROM embeddings")(
    lambda spark, d: S.catalog(_files(spark, d, "complex")).select(F.col("path").cast("long").alias("id"), "message_index", "edition", "grid_type", "ni", "nj", "lat_first", "lon_last", "packing", "reference_time"))
for _key, _kind in {"s18_netcdf_classic_values": "netcdf3", "s24_hdf5_chunked_values": "hdf5", "s25_hdf5_extensible_values": "extensible"}.items():

    def _values(spark, d, kind=_kind):
        v = S.variable_values(_files(spark, d, kind), "t")
        return v.select(F.col("path").cast("int").alias("j"), (F.col("idx")[0] * 8 + F.col("idx")[1]).cast("int").alias("i"), "value")

    query(_key, f"WITH {FE} SELECT j, i, nullif({QUANT}, 1024)::DOUBLE AS value FROM fe")(_values)
query("s28_netcdf_listing", "SELECT vec_id AS id, 't' AS name, 'short' AS type, 'time,x' AS dims, 64 AS n, '0.5' AS scale FROM embeddings")(
    lambda spark, d: S.variables(_files(spark, d, "netcdf3")).select(F.col("path").cast("long").alias("id"), "name", "type", F.array_join("dims", ",").alias("dims"), (F.col("shape")[0] * F.col("shape")[1]).cast("int").alias("n"), F.col("attrs")["scale_factor"].alias("scale")))
query("f02_renderable_variables", "SELECT vec_id AS id, 't' AS name FROM embeddings")(
    lambda spark, d: cf.renderable(S.variables(_files(spark, d, "netcdf3"))).select(F.col("path").cast("long").alias("id"), "name"))


def _detected(spark, d):
    out = None
    for kind in ("simple", "grib1", "netcdf3", "hdf5"):
        f = _files(spark, d, kind).select(F.lit(kind).alias("kind"), S.detect_format(F.col("content"), F.lit("x.bin")).alias("format")).groupBy("kind", "format").agg(F.count("*").alias("n"))
        out = f if out is None else out.unionByName(f)
    return out


query("s01_detect_format", "SELECT kind, format, (SELECT count(*) FROM embeddings) AS n FROM (VALUES ('simple', 'grib2'), ('grib1', 'grib1'), ('netcdf3', 'netcdf'), ('hdf5', 'netcdf')) t(kind, format)")(_detected)


def _edited(spark, d):
    f = S.set_p1(_files(spark, d, "grib1"), F.lit(0), F.lit(42))
    return S.catalog(f).select(F.col("path").cast("long").alias("id"), F.get_json_object("meta", "$.p1").cast("int").alias("p1"), F.get_json_object("meta", "$.p2").cast("int").alias("p2"))


query("k06_set_p1", "SELECT vec_id AS id, 42 AS p1, 0 AS p2 FROM embeddings")(_edited)

# ---- code tables -------------------------------------------------------------------------


def _values_sql(name: str) -> str:
    return ", ".join(f"({k}, '{v}')" for k, v in sorted(getattr(T, name).items()))


for _key, _table in {"l06_disciplines": "DISCIPLINE", "l06_time_units": "TIME_UNIT", "l06_surfaces": "SURFACE", "l06_statistics": "STATISTIC", "l02_level_types": "LEVEL1", "l02_centres": "CENTRE1"}.items():
    _local = "WHEN code BETWEEN 192 AND 254 THEN 'Reserved for local use' " if _table in T.LOCAL else ""

    def _named(spark, d, t=_table):
        return table(spark, d, "lineitem").select((F.col("l_orderkey") % 256).cast("int").alias("code")).groupBy("code").agg(F.count("*").alias("n")).select("code", "n", T.name(t, F.col("code")).alias("name"))

    query(_key, f"WITH t(code, name) AS (VALUES {_values_sql(_table)}), c AS (SELECT (l_orderkey % 256)::INT AS code, count(*) AS n FROM lineitem GROUP BY 1) SELECT c.code, n, CASE WHEN t.name IS NOT NULL THEN t.name {_local.replace('code', 'c.code')}ELSE '{T.FALLBACK[_table]}' END AS name FROM c LEFT JOIN t ON t.code = c.code")(_named)


def _forecasts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 14).cast("int").alias("u"), (F.col("o_custkey") % 256).cast("int").alias("p1"), (F.col("o_orderkey") % 200).cast("int").alias("p2"), (F.col("o_custkey") % 12).cast("int").alias("tr"))
    return o.select("o_orderkey", T.hours1(F.col("u"), F.col("p1")).alias("h1"), T.forecast1(F.col("u"), F.col("p1"), F.col("p2"), F.col("tr")).alias("shown"), T.hours2(F.col("u"), F.col("p1")).alias("h2"))


_H = "CASE u WHEN 0 THEN {p} // 60 WHEN 2 THEN {p} * 24 WHEN 10 THEN {p} * 3 WHEN 11 THEN {p} * 6 WHEN 12 THEN {p} * 12 WHEN 13 THEN round({p} / 3600.0)::INT ELSE {p} END"
query("l04_forecast", f"WITH o AS (SELECT o_orderkey, (o_orderkey % 14)::INT AS u, (o_custkey % 256)::INT AS p1, (o_orderkey % 200)::INT AS p2, (o_custkey % 12)::INT AS tr FROM orders), h AS (SELECT *, ({_H.format(p='p1')})::INT AS a, ({_H.format(p='p2')})::INT AS b, ({_H.format(p='(p1 * 256 + p2)')})::INT AS c FROM o) SELECT o_orderkey, a AS h1, CASE tr WHEN 1 THEN 'analysis' WHEN 2 THEN a || '–' || b || 'h valid' WHEN 3 THEN a || '–' || b || 'h average' WHEN 4 THEN a || '–' || b || 'h accum' WHEN 5 THEN a || '–' || b || 'h diff' WHEN 6 THEN '−' || a || ' to −' || b || 'h average' WHEN 7 THEN '−' || a || ' to +' || b || 'h average' WHEN 10 THEN '+' || c || 'h' ELSE '+' || a || 'h' END AS shown, (CASE u WHEN 0 THEN p1 // 60 WHEN 1 THEN p1 WHEN 2 THEN p1 * 24 WHEN 10 THEN p1 * 3 WHEN 11 THEN p1 * 6 WHEN 12 THEN p1 * 12 WHEN 13 THEN p1 // 3600 ELSE 0 END)::INT AS h2 FROM h")(_forecasts)


def _levels(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 256).cast("int").alias("k"), (F.col("o_custkey") % 256).cast("int").alias("a"), (F.col("o_custkey") % 7).cast("int").alias("b"))
    return o.select("o_orderkey", T.level1(F.col("k"), F.col("a"), F.col("b")).alias("shown"), T.level_type1(F.col("k")).alias("kind"))


_units = ", ".join(f"({k}, '{v}')" for k, v in sorted(T.LEVEL_UNIT.items()))
query("l03_level_text", f"WITH u(k, unit) AS (VALUES {_units}), t(k, name) AS (VALUES {_values_sql('LEVEL1')}), o AS (SELECT o_orderkey, (o_orderkey % 256)::INT AS k, (o_custkey % 256)::INT AS a, (o_custkey % 7)::INT AS b FROM orders) SELECT o_orderkey, CASE WHEN o.k IN ({', '.join(map(str, T.NO_LEVEL))}) THEN '—' WHEN o.k = 125 THEN printf('%.2f', (a * 256 + b) / 100.0::DOUBLE) WHEN o.k = 107 THEN printf('%.4f', (a * 256 + b) / 10000.0::DOUBLE) WHEN o.k = 117 THEN printf('%.3f', (a * 256 + b) / 1000.0::DOUBLE) WHEN o.k IN (101, 104, 106, 110, 112, 116, 120) THEN a || ' – ' || b WHEN o.k = 108 THEN printf('%.2f – %.2f', a / 100.0::DOUBLE, b / 100.0::DOUBLE) WHEN o.k = 114 THEN (475 - a) || ' – ' || (475 - b) WHEN o.k = 121 THEN (1100 - a) || ' – ' || (1100 - b) WHEN o.k = 128 THEN printf('%.3f – %.3f', 1.1::DOUBLE - a * 0.001::DOUBLE, 1.1::DOUBLE - b * 0.001::DOUBLE) WHEN o.k = 141 THEN a || ' – ' || (1100 - b) ELSE (a * 256 + b)::VARCHAR END AS shown, CASE WHEN unit IS NULL THEN coalesce(name, 'Unknown level type') ELSE '(' || unit || ') ' || coalesce(name, 'Unknown level type') END AS kind FROM o LEFT JOIN u ON u.k = o.k LEFT JOIN t ON t.k = o.k")(_levels)
query("l08_surface_value", "SELECT l_orderkey, l_linenumber, l_quantity, round(l_quantity / pow(10, l_linenumber - 3), 6) AS value FROM lineitem")(
    lambda spark, d: table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.round(T.surface_value(F.col("l_linenumber") - 3, F.col("l_quantity")), 6).alias("value")))
query("l05_reference_time", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS reference_time FROM orders")(
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", T.reference_time1(((F.year("o_orderdate") - 1) / 100).cast("int") + 1, F.year("o_orderdate") - ((F.year("o_orderdate") - 1) / 100).cast("int") * 100, F.month("o_orderdate"), F.dayofmonth("o_orderdate"), F.lit(0), F.lit(0)).alias("reference_time")))
query("l07_parameters")(lambda spark, d: T.with_parameter2(table(spark, d, "lineitem").select((F.col("l_suppkey") % 11).cast("int").alias("discipline"), (F.col("l_partkey") % 8).cast("int").alias("category"), F.col("l_linenumber").alias("number")).distinct()))


def _axes(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("event_id") % 6).cast("int").alias("k")).distinct()
    a = F.array(*[F.lit(x) for x in ("degrees_north", "degree east", "Degrees_north", "degreesE", "K", "degrees")])
    n = F.array(*[F.lit(x) for x in ("a", "b", "lat", "c", "XC", "nav_lat")])
    return e.select("event_type", "k", cf.axis(F.get(a, F.col("k")), F.lit(None).cast("string"), F.lit(None).cast("string"), F.get(n, F.col("k"))).alias("axis"))


query("l11_axis_detection", "SELECT DISTINCT event_type, (event_id % 6)::INT AS k, CASE event_id % 6 WHEN 0 THEN 'latitude' WHEN 1 THEN 'longitude' WHEN 2 THEN 'latitude' WHEN 3 THEN 'longitude' WHEN 4 THEN 'longitude' ELSE 'latitude' END AS axis FROM events")(_axes)
query("a08_regular_axis", "WITH c AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey) AS k, round(l_extendedprice) AS v FROM lineitem), s AS (SELECT *, v - lag(v) OVER (PARTITION BY l_orderkey ORDER BY k) AS st FROM c), e AS (SELECT l_orderkey, arg_min(v, k) AS first, arg_max(v, k) AS last, count(*) AS n, min(st) AS a, max(st) AS b FROM s GROUP BY 1) SELECT l_orderkey, first, last, n, coalesce(abs(a - (last - first) / (n - 1)) <= abs((last - first) / (n - 1)) * 0.001 AND abs(b - (last - first) / (n - 1)) <= abs((last - first) / (n - 1)) * 0.001, TRUE) AS regular, b < 0 AS falling FROM e")(
    lambda spark, d: cf.corner_and_regularity(table(spark, d, "lineitem").select("l_orderkey", F.struct("l_extendedprice", "l_partkey").alias("k"), F.round("l_extendedprice").alias("value")), "l_orderkey"))
