"""More queries: further packings, sources, file-to-picture calls, forward maps and synthesis."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codec import synth
from ..functions import geodesy as G
from ..functions import tables as T
from ..operators import render as R
from ..operators import views as V
from ..sources import files as S
from .catalog import _LUT, D, GRIDS, ORACLES, query
from .catalog_files import QUANT
from .fields import FE, fe, r6, s6, table

# ---- packings by other writers -----------------------------------------------------------


def _written(spark, d, write) -> DataFrame:
    """(path = vec_id, content): one 8 x 8 message per embedding."""

    def run(batches):
        for b in S.few(batches):
            out = [write(np.array(e, np.float64)) for e in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("path"), "embedding").mapInArrow(run, "path string, content binary")


def _integers(v: np.ndarray) -> np.ndarray:
    return np.floor((v + 1) * 1024 + 0.5).astype(np.int64)


def _some(v: np.ndarray, write) -> bytes:
    return write(_integers(v)[v > 0], (v > 0).astype(int))


def _decoded(write, places: int = 6):
    def run(spark, d):
        f = S.fields(_written(spark, d, write))
        return f.select(F.col("path").cast("int").alias("j"), F.posexplode_outer("values").alias("i", "value")).select("j", "i", r6(F.col("value"), places).alias("value"))

    return run


_QUANTISED = f"CASE WHEN {QUANT} = 1024 THEN 0.0 ELSE round(-1 + {QUANT} / 1024, 6) END"
for _key, (_write, _sql, _places) in {
    "p03_grib1_ieee": (lambda v: synth.ieee1(v, 8, 8), s6("value"), 6),
    "s09_grib1_bitmap": (lambda v: _some(v, lambda x, m: synth.simple1(x, 8, 8, bitmap=m)), f"CASE WHEN value > 0 THEN {_QUANTISED} END", 6),
    "p15_grib2_log": (lambda v: synth.log2(np.floor(v * 1000 + 0.5) / 1000, 8, 8), s6("floor(value * 1000 + 0.5) / 1000", 6), 6),
    "p18_grib2_ieee32": (lambda v: synth.ieee2(v, 8, 8), s6("value"), 6),
    "p18_grib2_ieee64": (lambda v: synth.ieee2(v, 8, 8, True), s6("value"), 6),
    "p19_grib2_png": (lambda v: synth.png2(_integers(v), 8, 8), _QUANTISED, 6),
    "p31_grib2_alternate_rows": (lambda v: synth.alternate2(_integers(v), 8, 8), _QUANTISED, 6),
}.items():
    query(_key, f"WITH {FE} SELECT j, i, {_sql} AS value FROM fe")(_decoded(_write, _places))

# ---- sources -----------------------------------------------------------------------------
_NAMES = ("a.grib", "B.GRB2", "c.grb1", "d.nc", "e.H5", "f.nc4", "g.txt", "h.grib2.gz", "i.cdf", "j.grib1")


def _by_path(spark, d):
    o = table(spark, d, "orders")
    path = F.concat(F.lit("/x/"), F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("o_orderkey") % 10).cast("int")))
    return o.select("o_orderkey", S.detect_path(path).alias("format"))


query("s02_detect_path", "SELECT o_orderkey, ['grib1', 'grib2', 'grib1', 'netcdf', 'netcdf', 'netcdf', 'unknown', 'unknown', 'netcdf', 'grib1'][(o_orderkey % 10 + 1)::INT] AS format FROM orders")(_by_path)


def _previewed(spark, d):
    e = table(spark, d, "events").select("event_id", F.encode(F.concat("props", F.lit("\n\t~")), "UTF-8").alias("content"))
    raw, shown = S.preview(F.col("content"), 24)
    return e.select("event_id", raw.alias("hex"), shown.alias("ascii"))


query("s33_preview", r"SELECT event_id, hex(encode(p)) AS hex, regexp_replace(p, '[^\x20-\x7E]', '.', 'g') AS ascii FROM (SELECT event_id, substr(props || chr(10) || chr(9) || '~', 1, 24) AS p FROM events)")(_previewed)


def _two_messages(v: np.ndarray) -> bytes:
    x = _integers(v)
    return synth.simple2(x, 8, 8) + b"junk" + synth.simple2(x + 1024, 8, 8)


def _selected(spark, d):
    out = None
    f = S.fields(_written(spark, d, _two_messages))
    for k in (0, 1, 2):
        m = S.message(f, k).select(F.col("path").cast("int").alias("j"), F.lit(k).alias("k"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"), "error")
        m = m.select("j", "k", r6(F.col("total"), 5).alias("total"), "error")
        out = m if out is None else out.unionByName(m)
    return out


query("f01_select_message", f"WITH {FE}, t AS (SELECT j, sum(-1 + {QUANT} / 1024) AS s FROM fe GROUP BY 1) SELECT j, k::INT AS k, CASE k WHEN 0 THEN {s6('s', 5)} WHEN 1 THEN {s6('s + 64', 5)} END AS total, CASE k WHEN 2 THEN 'no message 2: the file has 2' END AS error FROM t, range(3) r(k)")(_selected)
_cut = {"cut": lambda v: synth.simple2(_integers(v), 8, 8)[:-9], "none": lambda v: b"plain bytes", "whole": lambda v: synth.simple2(_integers(v), 8, 8)}


def _broken(spark, d):
    out = None
    for kind, write in _cut.items():
        f = _written(spark, d, write)
        rows = [x.select(F.lit(kind).alias("kind"), F.lit(name).alias("of"), F.col("path").cast("int").alias("j"), F.col("error").isNull().alias("ok")) for name, x in (("catalog", S.catalog(f)), ("fields", S.fields(f)))]
        for r in rows:
            out = r if out is None else out.unionByName(r)
    return out


query("s04_broken_files", "SELECT kind, o.of AS of, vec_id::INT AS j, kind = 'whole' AS ok FROM embeddings, (VALUES ('cut'), ('none'), ('whole')) k(kind), (VALUES ('catalog'), ('fields')) o(of)")(_broken)

# ---- from files to pictures --------------------------------------------------------------


def gathered(spark, d, write, write_all) -> DataFrame:
    """The embeddings as one file (path = one, content): ``write`` makes each row two byte strings in parallel, ``write_all`` a file of both, joined in order of the rows."""
    kinds = "vec_id long, a binary, b binary"

    def each(batches):
        for b in S.few(batches):
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            parts = [np.frombuffer(x, np.uint8) for x in write(v)]
            offsets = [np.arange(b.num_rows + 1, dtype=np.int32) * (len(x) // b.num_rows) for x in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(o), pa.py_buffer(x)]) for o, x in zip(offsets, parts, strict=True)]], ["vec_id", "a", "b"])

    def joined(a: pa.Array) -> bytes:
        off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else [0, 0]
        return a.buffers()[2][int(off[0]) : int(off[-1])].to_pybytes() if len(a) else b""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                own = b.column(0).slice(k, 1).flatten()
                content = write_all(len(own), joined(own.field("a")), joined(own.field("b")))
                yield pa.RecordBatch.from_arrays([pa.array(["one"]), pa.array([content], pa.binary())], ["path", "content"])

    packed = table(spark, d, "embeddings").select(F.col("vec_id").cast("long"), "embedding").mapInArrow(each, kinds)
    whole = packed.groupBy().agg(F.array_sort(F.collect_list(F.struct("vec_id", "a", "b"))).alias("a"))
    return whole.mapInArrow(run, "path string, content binary")


def _one(spark, d) -> DataFrame:
    """The embeddings as one file of two messages, a row of the grid each; the 64 values of a row fill 96 octets."""

    def write(v):
        low = _integers(v)
        return synth.pack(low, 12), synth.pack(2048 - low, 12)

    def message(n, body):
        return synth.grib2(64, n, 0, synth.red(-1.0, -10, 0, 12) + b"\0", body, None, 64 * n, synth.latlon2(64, n, 90.0, 0.0, -90.0, 354.375))

    return gathered(spark, d, write, lambda n, *bodies: b"".join(message(n, x) for x in bodies))


def _combined(spark, d, op="a_plus_b"):
    f = _one(spark, d)
    return V.combined(V.resolve(f, 0), V.resolve(f, 1), op)


_ONE = f"WITH {FE}, q AS (SELECT j, i, -1 + {QUANT} / 1024 AS v FROM fe), {_LUT}"
query("r16_resolve_render", f"{_ONE}, e AS (SELECT min(v) AS lo, max(v) AS hi FROM q), p AS (SELECT i AS px, j AS py, floor((v - lo) / (hi - lo) * 255 + 0.5)::INT AS k FROM q, e) SELECT px, py, r::INT AS r, g::INT AS g, b::INT AS b, 255 AS a FROM p JOIN lut USING (k)")(
    lambda spark, d: V.picture(V.resolve(_one(spark, d), 0)))
query("f10_manual_range", f"{_ONE}, p AS (SELECT i AS px, j AS py, floor(least(1, greatest(0, (v + 0.25) / 0.5)) * 255 + 0.5)::INT AS k FROM q) SELECT px, py, r::INT AS r, g::INT AS g, b::INT AS b, 255 AS a FROM p JOIN lut USING (k)")(
    lambda spark, d: V.picture(V.resolve(_one(spark, d), 0), value_range=(-0.25, 0.25)))
query("r17_combined_render", f"{_ONE}, p AS (SELECT i AS px, j AS py, floor(least(1, greatest(0, (2 * v + 1) / 2)) * 255 + 0.5)::INT AS k FROM q) SELECT px, py, r::INT AS r, g::INT AS g, b::INT AS b, 255 AS a FROM p JOIN lut USING (k)")(
    lambda spark, d: V.picture(_combined(spark, d, "a_minus_b"), value_range=(-1.0, 1.0)))


def _combined_probe(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 64).cast("int").alias("px"), (F.col("o_custkey") % 90).cast("int").alias("py")).distinct()
    out = V.probed(_combined(spark, d), o)
    return out.select("px", "py", "grid_i", "grid_j", r6(F.col("value")).alias("value"))


query("r17_combined_probe", "SELECT DISTINCT (o_orderkey % 64)::INT AS px, (o_custkey % 90)::INT AS py, (o_orderkey % 64)::INT AS grid_i, (o_custkey % 90)::INT AS grid_j, 0.0::DOUBLE AS value FROM orders")(_combined_probe)


def _combined_contours(spark, d):
    return V.contoured(_combined(spark, d, "a_minus_b"), [0.125]).groupBy("level").agg(F.count("*").alias("n"))


_CROSS = "(({a} >= 0.125) <> ({b} >= 0.125))"
query("r17_combined_contours", f"{_ONE}, c AS (SELECT a.j, a.i, 2 * a.v AS bl, 2 * b.v AS br, 2 * x.v AS tr, 2 * y.v AS tl FROM q a JOIN q b ON b.j = a.j AND b.i = a.i + 1 JOIN q x ON x.j = a.j + 1 AND x.i = a.i + 1 JOIN q y ON y.j = a.j + 1 AND y.i = a.i), n AS (SELECT j, {_CROSS.format(a='bl', b='br')}::INT + {_CROSS.format(a='br', b='tr')}::INT + {_CROSS.format(a='tr', b='tl')}::INT + {_CROSS.format(a='tl', b='bl')}::INT AS k FROM c) SELECT 0.125::DOUBLE AS level, (sum(k) // 2)::BIGINT AS n FROM n")(
    _combined_contours)

# ---- geodesy and tables ------------------------------------------------------------------
_g = GRIDS["g07_geostationary"]
_SEEN = (
    "x AS (SELECT -0.15 + i * 0.0006 AS x, 0.15 - j * 0.0006 AS y FROM range(1, 499) a(i), range(1, 499) b(j)), "
    "u AS (SELECT cos(x) * cos(y) AS dx, -sin(x) AS dy, cos(x) * sin(y) AS dz FROM x), "
    f"k AS (SELECT dx * dx + dy * dy + dz * dz * pow({_g.r_eq!r}::DOUBLE / {_g.r_pol!r}::DOUBLE, 2) AS a, -2 * {_g.height!r}::DOUBLE * dx AS b, pow({_g.height!r}::DOUBLE, 2) - pow({_g.r_eq!r}::DOUBLE, 2) AS c FROM u)"
)
ORACLES["g11_forward_roundtrip"] = (
    f"WITH {_SEEN} SELECT grid, n::BIGINT AS n, 0.0::DOUBLE AS di, 0.0::DOUBLE AS dj FROM (VALUES "
    + ", ".join(f"('{name}', {(g.ni - 2) * (g.nj - 2)})" for name, g in sorted(GRIDS.items()) if name != "g07_geostationary")
    + ") t(grid, n) UNION ALL SELECT 'g07_geostationary', count(*), 0.0, 0.0 FROM k WHERE b * b - 4 * a * c >= 0"
)
_nodes = ", ".join(f"({n}, {k}, {v!r}::DOUBLE)" for n in (16, 32, 80) for k, v in enumerate(np.rad2deg(np.arcsin(np.polynomial.legendre.leggauss(2 * n)[0]))[::-1].tolist()))
ORACLES["g20_gaussian_latitudes"] = f"SELECT n::INT AS n, k::INT AS k, round(lat, 9) AS lat FROM (VALUES {_nodes}) t(n, k, lat)"
_params = ", ".join(f"({a}, {b}, {c}, '{s}', '{n}', '{u}')" for (a, b, c), (s, n, u) in T.PARAMETER2.items())
ORACLES["l07_parameters"] = (
    f"WITH p(discipline, category, number, short, name, unit) AS (VALUES {_params}), m AS (SELECT DISTINCT (l_suppkey % 11)::INT AS discipline, (l_partkey % 8)::INT AS category, l_linenumber AS number FROM lineitem) "
    "SELECT m.discipline, m.category, m.number, short, coalesce(name, 'Parameter ' || m.discipline || '/' || m.category || '/' || m.number) AS name, unit FROM m LEFT JOIN p USING (discipline, category, number)"
)


def _forward(spark, d):
    """Points of two grids of the latitude/longitude family at fractional cells from the orders."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 61).alias("i"), (F.col("o_custkey") % 41).alias("j"))
    lat, lon = GRIDS["g02_mercator"].point(F.col("i"), F.col("j"))
    rlat, rlon = G.Rotated(61, 41, -20.0, -30.0, 20.0, 30.0, -90.0, 0.0, 0.0).point(F.col("i"), F.col("j"))
    return o.select("o_orderkey", r6(lat).alias("lat"), r6(lon).alias("lon"), r6(rlat).alias("rlat"), r6(rlon).alias("rlon"))


query("g12_forward_mercator", f"WITH o AS (SELECT o_orderkey, o_orderkey % 61 AS i, o_custkey % 41 AS j FROM orders), m AS (SELECT *, ln(tan(pi() / 4 - 20 * {D})) + j * (2 * ln(tan(pi() / 4 + 20 * {D})) / 40) AS y FROM o) SELECT o_orderkey, {s6(f'(2 * atan(exp(y)) - pi() / 2) / {D}')} AS lat, {s6('100 + i * 2.0::DOUBLE')} AS lon, {s6('-20 + j * 1.0::DOUBLE')} AS rlat, {s6('-30 + i * 1.0::DOUBLE')} AS rlon FROM m")(_forward)

# ---- bilinear and spectral oracles -------------------------------------------------------
_BIL = (
    "SELECT px, py, {lat} AS lat, {lon} AS lon, {v} AS value FROM (SELECT c.*, "
    "(1 - tx) * (1 - ty) * a.embedding[i0 + 1] + tx * (1 - ty) * a.embedding[i1 + 1] + (1 - tx) * ty * b.embedding[i0 + 1] + tx * ty * b.embedding[i1 + 1] AS value FROM "
    "(SELECT px, py, lat, lon, fi - floor(fi) AS tx, fj - floor(fj) AS ty, (floor(fi)::INT % 64) AS i0, ((floor(fi)::INT + 1) % 64) AS i1, floor(fj)::INT AS j0, least(floor(fj)::INT + 1, (nj - 1)::INT) AS j1 FROM cell) c "
    "JOIN embeddings a ON a.vec_id = j0 JOIN embeddings b ON b.vec_id = j1)"
).format(lat=s6("lat"), lon=s6("lon"), v=s6("value"))
ORACLES["r03_warp_bilinear"] = (
    "WITH n AS (SELECT max(vec_id) + 1 AS nj FROM embeddings), ll AS (SELECT px, py, 85.0::DOUBLE - py * 170.0::DOUBLE / 59 AS lat, -180 + px * 359.0::DOUBLE / 89 AS lon FROM range(90) a(px), range(60) b(py)), "
    "cell AS (SELECT px::INT AS px, py::INT AS py, lat, lon, nj, ((lon - 360 * floor(lon / 360)) / 5.625) AS fi, (90 - lat) / (180.0::DOUBLE / (nj - 1)) AS fj FROM ll, n) " + _BIL
)
# Associated Legendre functions as finite sums, not by the recurrence of the operator.
_spec_ni, _spec_nj = R.spectral_grid(10)
ORACLES["r15_spectral_synthesis"] = (
    f"WITH {FE}, e AS (SELECT i, avg(value) AS v FROM fe GROUP BY 1), "
    "c AS (SELECT n, (i - n * (n + 1) // 2)::BIGINT AS m, v FROM (SELECT i, v, floor((sqrt(8 * i + 1) - 1) / 2)::BIGINT AS n FROM e)), "
    f"la AS (SELECT j::INT AS j, sin((90 - 180 * j::DOUBLE / {_spec_nj - 1}) * {D}) AS x, cos((90 - 180 * j::DOUBLE / {_spec_nj - 1}) * {D}) AS s FROM range({_spec_nj}) t(j)), "
    "f AS (SELECT n, m, k, (CASE k % 2 WHEN 0 THEN 1 ELSE -1 END) * factorial((2 * n - 2 * k)::INT)::DOUBLE / (pow(2, n) * factorial(k::INT)::DOUBLE * factorial((n - k)::INT)::DOUBLE * factorial((n - 2 * k - m)::INT)::DOUBLE) AS w, n - 2 * k - m AS p FROM c, range(6) r(k) WHERE n - 2 * k - m >= 0), "
    "l AS (SELECT j, n, m, sum(w * pow(x, p)) * pow(greatest(s, 0), m) * sqrt((2 * n + 1) * factorial((n - m)::INT)::DOUBLE / factorial((n + m)::INT)::DOUBLE) AS y FROM la, f GROUP BY j, n, m, s), "
    "o AS (SELECT j, m, sum(y * v) * (CASE m WHEN 0 THEN 1 ELSE 2 END) AS a FROM l JOIN c USING (n, m) GROUP BY j, m) "
    f"SELECT j, i::INT AS i, {s6(f'sum(a * cos(m * i * 360.0::DOUBLE / {_spec_ni} * {D}))')} AS value FROM o, range({_spec_ni}) t(i) GROUP BY j, i"
)
