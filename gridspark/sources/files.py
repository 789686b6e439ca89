"""Files as DataFrames: format detection, message and variable catalogs, decoded fields.

Files are read by Spark's binary source, so any store Spark reads will do.  A catalog row is
made without decoding values; fields are decoded in Arrow batches, one row per message.
"""

from __future__ import annotations

import json
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codec import grib1, grib2, hdf5, netcdf3
from ..codec.bits import SLAB, FormatError

CATALOG = "path string, message_index int, edition int, byte_offset long, byte_length long, grid_type string, ni int, nj int, lat_first double, lon_first double, lat_last double, lon_last double, packing string, centre int, parameter string, level_type int, reference_time string, meta string, error string"
FIELD = "path string, message_index int, edition int, grid_type string, ni int, nj int, values array<double>, error string"
VARIABLES = "path string, name string, type string, dims array<string>, shape array<long>, decode_index int, attrs map<string,string>, error string"
COEFFICIENTS = "path string, message_index int, m int, n int, re double, im double"


def detect(content: Column) -> Column:
    """Format by magic bytes: grib1, grib2, netcdf (classic or HDF5) or unknown."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("47524942") & (F.substring(head, 15, 2) == "01"), "grib1").when(head.startswith("47524942") & (F.substring(head, 15, 2) == "02"), "grib2")
        .when(head.startswith("434446") & F.substring(head, 7, 2).isin("01", "02", "05"), "netcdf").when(head == "894844460D0A1A0A", "netcdf").otherwise("unknown")
    )


def detect_path(path: Column) -> Column:
    """Format by file name extension, for files without magic bytes."""
    p = F.lower(path)
    return F.when(p.rlike(r"\.(grib1?|grb1?)$"), "grib1").when(p.rlike(r"\.(grib2|grb2)$"), "grib2").when(p.rlike(r"\.(nc|nc4|cdf|h5|hdf5)$"), "netcdf").otherwise("unknown")


def detect_format(content: Column, path: Column) -> Column:
    found = detect(content)
    return F.when(found == "unknown", detect_path(path)).otherwise(found)


def preview(content: Column, n: int = 32) -> tuple[Column, Column]:
    """(hex, printable ASCII) of the first bytes of a file."""
    head = F.substring(content, 1, n)
    return F.hex(head), F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[^\x20-\x7E]", ".")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


BROKEN = (FormatError, IndexError, ValueError, KeyError, OverflowError, struct.error, zlib.error)  # what bytes that are no such file lead to


def _told(e: Exception) -> str:
    return str(e) or type(e).__name__


def _messages(data: bytes):
    """(codec, messages) of a GRIB file; an error where its bytes hold no whole message."""
    kind = 2 if data[:4] == b"GRIB" and len(data) > 7 and data[7] == 2 else 1
    codec = grib2 if kind == 2 else grib1
    found = list(codec.messages(data))
    if not found:
        raise FormatError("no whole message" if b"GRIB" in data else "no GRIB file")
    return codec, found


def _meta(m: dict) -> str:
    return json.dumps({k: v for k, v in m.items() if not isinstance(v, (bytes, tuple))})


ROWS = 512  # files of a batch that are Python objects at a time


def few(batches):
    """The rows of Arrow batches, ROWS at a time, so that the objects made of them take bounded memory whatever a batch holds."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def _each(b: pa.RecordBatch):
    """(path, bytes) of each file; null content has no bytes."""
    return zip(b.column(0).to_pylist(), (v or b"" for v in b.column(1).to_pylist()), strict=True)


def _rows(cols: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    data = list(zip(*rows, strict=True)) if rows else [[] for _ in cols]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(data, cols, strict=True)], [n for n, _ in cols])


def catalog(files: DataFrame) -> DataFrame:
    """One row per message of GRIB files (path, content); a broken file is one row with an error."""
    kinds = [("path", pa.string()), ("message_index", pa.int32()), ("edition", pa.int32()), ("byte_offset", pa.int64()), ("byte_length", pa.int64()), ("grid_type", pa.string()), ("ni", pa.int32()), ("nj", pa.int32()), *[(k, pa.float64()) for k in ("lat_first", "lon_first", "lat_last", "lon_last")], ("packing", pa.string()), ("centre", pa.int32()), ("parameter", pa.string()), ("level_type", pa.int32()), ("reference_time", pa.string()), ("meta", pa.string()), ("error", pa.string())]

    def run(batches):
        for b in few(batches):
            rows = []
            for path, data in _each(b):
                try:
                    for m in _messages(data)[1]:
                        g = m["grid"]
                        p = f"{m['discipline']}/{m.get('category')}/{m.get('number')}" if m["edition"] == 2 else str(m["parameter"])
                        rows.append((path, m["message_index"], m["edition"], m["byte_offset"], m["byte_length"], g["grid_type"], g.get("ni"), g.get("nj"), *[g.get(k) for k in ("lat_first", "lon_first", "lat_last", "lon_last")], m["packing"], m["centre"], p, m.get("surface_type", m.get("level_type")), m["reference_time"], _meta(m), None))
                except BROKEN as e:
                    rows.append((path, *[None] * 16, "{}", _told(e)))
            yield _rows(kinds, rows)

    return files.select("path", "content").mapInArrow(run, CATALOG)


def spread(files: DataFrame) -> DataFrame:
    """One row per message (path, content, first): the messages of large files spread over tasks by bytes, for ``fields``.

    Finding messages decodes nothing, so a file of any number of messages costs its task one scan
    and the decoding that follows is shared out.  ``first`` counts the messages before.  A file that
    cannot be scanned stays one row, and ``fields`` tells its error.
    """

    def run(batches):
        for b in few(batches):
            for path, data in _each(b):
                try:
                    parts = [(m["message_index"], data[m["byte_offset"] : m["byte_offset"] + m["byte_length"]]) for m in _messages(data)[1]]
                except BROKEN:
                    parts = [(0, data)]
                for first, part in parts:
                    yield _rows([("path", pa.string()), ("content", pa.binary()), ("first", pa.int32())], [(path, part, first)])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, first int").hint("rebalance")


def fields(files: DataFrame) -> DataFrame:
    """Decoded fields of GRIB files: values[j*ni + i], NULL where missing; undecodable messages keep an error.

    Files that went through ``spread`` keep the place of each message in its file.
    """
    kinds = [("path", pa.string()), ("message_index", pa.int32()), ("edition", pa.int32()), ("grid_type", pa.string()), ("ni", pa.int32()), ("nj", pa.int32()), ("values", pa.list_(pa.float64())), ("error", pa.string())]

    def run(batches):
        for b in few(batches):
            for (path, data), first in zip(_each(b), b.column(2).to_pylist(), strict=True):
                try:
                    codec, found = _messages(data)
                except BROKEN as e:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip((path, *[None] * 6, _told(e)), kinds, strict=True)], [k for k, _ in kinds])
                    continue
                for m in found:
                    g, values, error = m["grid"], None, None
                    ni = g.get("ni")
                    try:
                        v = codec.decode(m, data)
                        if "pl" in g:
                            v, ni = grib1.expand_reduced(v, g["pl"]), max(g["pl"])
                        values = pa.array(np.ma.getdata(v).astype(np.float64), mask=np.ma.getmaskarray(v))
                    except BROKEN as e:
                        error = _told(e)
                    one = _rows([k for k in kinds if k[0] != "values"], [(path, first + m["message_index"], m["edition"], g["grid_type"], ni, g.get("nj"), error)])
                    off = pa.array([0, len(values)] if values is not None else [None, 0], pa.int32())
                    lists = pa.ListArray.from_arrays(off, values if values is not None else pa.array([], pa.float64()))
                    yield pa.RecordBatch.from_arrays([*one.columns[:6], lists, one.column(6)], [k for k, _ in kinds])

    first = F.col("first") if "first" in files.columns else F.lit(0).alias("first")
    return files.select("path", "content", first).mapInArrow(run, FIELD)


def message(fields: DataFrame, index: int) -> DataFrame:
    """The row of one message of one file, by its place in it; an error row where there is none of that place."""
    files = fields.groupBy("path").agg(F.max("message_index").alias("_last"), F.first("error", ignorenulls=True).alias("_error"))
    own = fields.where(F.col("message_index") == index)
    gone = files.where(F.col("_last").isNull() | (F.col("_last") < index) | F.lit(index < 0))
    absent = F.when(F.col("_last").isNull(), F.col("_error")).otherwise(F.format_string(f"no message {index}: the file has %d", F.col("_last") + 1))
    blank = [absent.alias(c) if c == "error" else F.col("path") if c == "path" else F.lit(None).cast(t).alias(c) for c, t in fields.dtypes]
    return own.unionByName(gone.select(*blank))


def _slabs(codec, m: dict, data: bytes):
    """(first cell, values) of a message, at most SLAB cells each, in storage order; reduced rows are expanded."""
    if codec is grib2 and "pl" not in m["grid"]:
        yield from grib2.slabs(m, data)
        return
    v = codec.decode(m, data)
    v = grib1.expand_reduced(v, m["grid"]["pl"]) if "pl" in m["grid"] else v
    yield from ((k, v[k : k + SLAB]) for k in range(0, len(v), SLAB))


def _width(g: dict) -> int | None:
    return max(g["pl"]) if "pl" in g else g.get("ni")


def found(files: DataFrame, index: int) -> DataFrame:
    """(path, ni, nj, meta, error) of one message of each file; it is decoded, a slab at a time, to know that it can be."""
    kinds = [("path", pa.string()), ("ni", pa.int32()), ("nj", pa.int32()), ("meta", pa.string()), ("error", pa.string())]

    def one(path, data):
        try:
            codec, held = _messages(data)
            if not 0 <= index < len(held):
                return path, None, None, None, f"no message {index}: the file has {len(held)}"
            m = held[index]
            for _ in _slabs(codec, m, data):
                pass
            return path, _width(m["grid"]), m["grid"].get("nj"), _meta(m), None
        except BROKEN as e:
            return path, None, None, None, _told(e)

    def run(batches):
        for b in few(batches):
            for path, data in _each(b):
                yield _rows(kinds, [one(path, data)])

    return files.select("path", "content").mapInArrow(run, "path string, ni int, nj int, meta string, error string")


def _slab(first: int, ni: int, values: np.ma.MaskedArray) -> pa.RecordBatch:
    flat = pa.array(np.ma.getdata(values).astype(np.float64).ravel(), mask=np.ma.getmaskarray(values).ravel())
    lists = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
    return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([ni], pa.int32()), lists], ["first", "ni", "values"])


def _long(slabs: DataFrame) -> DataFrame:
    """(j, i, value) of slabs (first, ni, values), shared out over tasks."""
    p = F.col("first") + F.col("_p")
    flat = slabs.hint("rebalance").select("first", "ni", F.posexplode("values").alias("_p", "value"))
    return flat.select(p.alias("_p"), "ni", "value").select(F.expr("cast(_p div ni as int)").alias("j"), (F.col("_p") % F.col("ni")).cast("int").alias("i"), "value")


SLABS = "first long, ni int, values array<double>"


def cells(files: DataFrame, index: int) -> DataFrame:
    """(j, i, value) of one message of one file, NULL where missing, decoded a slab at a time; no row where ``found`` tells an error."""

    def run(batches):
        for b in few(batches):
            for _, data in _each(b):
                try:
                    codec, held = _messages(data)
                    if 0 <= index < len(held):
                        for first, v in _slabs(codec, held[index], data):
                            yield _slab(first, _width(held[index]["grid"]), v)
                except BROKEN:
                    continue

    return _long(files.select("path", "content").mapInArrow(run, SLABS))


def coefficients(files: DataFrame) -> DataFrame:
    """Spherical-harmonic coefficients of spectral messages; files that cannot be read give none (``fields`` says why)."""

    def run(batches):
        for b in few(batches):
            for path, data in _each(b):
                try:
                    codec, found = _messages(data)
                except BROKEN:
                    continue
                for m in found:
                    if m["grid"]["grid_type"] == "spherical_harmonic":
                        rows = [(path, m["message_index"], *c) for c in codec.coefficients(m, data)]
                        yield _rows([("path", pa.string()), ("message_index", pa.int32()), ("m", pa.int32()), ("n", pa.int32()), ("re", pa.float64()), ("im", pa.float64())], rows)

    return files.select("path", "content").mapInArrow(run, COEFFICIENTS)


def shown(v) -> str:
    """Attribute text: a comma list, shortest round-trip numbers."""
    if isinstance(v, str):
        return v
    one = lambda x: str(int(x)) if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 1e16 else repr(x) if isinstance(x, float) else str(x)
    return ", ".join(one(x) for x in (v if isinstance(v, (list, tuple)) else [v]))


def variables(files: DataFrame) -> DataFrame:
    """One row per variable of NetCDF files (classic or NetCDF-4), without values."""

    def run(batches):
        for b in few(batches):
            rows = []
            for path, data in _each(b):
                try:
                    found = hdf5.variables(data) if data[:4] == b"\x89HDF" else [(v.name, v.type, v.dims, v.shape, v.attrs) for v in netcdf3.header(data).variables]
                    rows += [(path, n, t, d, s, k, [(a, shown(x)) for a, x in at.items()], None) for k, (n, t, d, s, at) in enumerate(found)]
                except BROKEN as e:
                    rows.append((path, None, None, None, None, None, None, _told(e)))
            yield _rows([("path", pa.string()), ("name", pa.string()), ("type", pa.string()), ("dims", pa.list_(pa.string())), ("shape", pa.list_(pa.int64())), ("decode_index", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string())), ("error", pa.string())], rows)

    return files.select("path", "content").mapInArrow(run, VARIABLES)


def _opened(data: bytes, name: str):
    """(stored values, a function that makes a piece of them doubles) of a variable; classic files are read in place."""
    if data[:4] == b"\x89HDF":
        return hdf5.values(data, name), lambda piece: piece
    raw, v = netcdf3.packed(data, netcdf3.header(data), name)
    return raw, lambda piece: netcdf3.numbers(piece, v)


def variable_values(files: DataFrame, name: str) -> DataFrame:
    """(path, idx array, value): a variable in long form, NULL where missing, at most SLAB values at a time.

    A file that cannot be read, or lacks the variable, gives no row; ``variables`` says why.
    """
    schema = "path string, idx array<int>, value double"

    def gathered(parts: list) -> pa.RecordBatch:
        """One batch of the (path, shape, first cell, values) of small files or pieces of large ones."""
        rank = np.concatenate([np.full(v.size, len(shape), np.int32) for _, shape, _, v in parts])
        at = np.concatenate([np.stack(np.unravel_index(np.arange(first, first + v.size), shape), 1).astype(np.int32).ravel() for _, shape, first, v in parts])
        flat = pa.array(np.concatenate([np.ma.getdata(v).astype(np.float64) for *_, v in parts]), mask=np.concatenate([np.ma.getmaskarray(v) for *_, v in parts]))
        idx = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rank)].astype(np.int32)), pa.array(at))
        paths = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(parts), dtype=np.int32), [v.size for *_, v in parts])), pa.array([p for p, *_ in parts], pa.string()))
        return pa.RecordBatch.from_arrays([paths.cast(pa.string()), idx, flat], ["path", "idx", "value"])

    def run(batches):
        for b in few(batches):
            held, count = [], 0
            for path, data in _each(b):
                try:
                    raw, made = _opened(data, name)
                except BROKEN:
                    continue
                row = int(np.prod(raw.shape[1:], dtype=np.int64)) if raw.ndim else 0
                step = max(1, SLAB // row) if row else 0
                for k in range(0, len(raw), step) if row else []:
                    v = made(raw[k : k + step]).reshape(-1)
                    for a in range(0, v.size, SLAB):
                        held.append((path, raw.shape, k * row + a, v[a : a + SLAB]))
                        count += held[-1][-1].size
                        if count >= SLAB:
                            yield gathered(held)
                            held, count = [], 0
            if held:
                yield gathered(held)

    return files.select("path", "content").mapInArrow(run, schema)


def variable_plane(files: DataFrame, name: str, y: str, x: str, dims: list[str], at: dict[str, int]) -> DataFrame:
    """(j, i, value) of a slice of one file's variable over y and x, NULL where missing; other parts are not decoded (HDF5: whole chunks are).

    ``at`` fixes every dimension but y and x; a place outside its dimension gives no row.
    """

    def run(batches):
        for b in few(batches):
            for _, data in _each(b):
                try:
                    raw, made = _opened(data, name)
                except BROKEN:
                    continue
                if any(not 0 <= k < raw.shape[dims.index(d)] for d, k in at.items()):
                    continue
                plane = raw[tuple(at.get(d, slice(None)) for d in dims)]
                plane = plane if dims.index(y) < dims.index(x) else plane.T
                ni = plane.shape[1]
                step = max(1, SLAB // ni) if ni else 0
                for j in range(0, len(plane), step) if ni else []:
                    v = made(plane[j : j + step]).reshape(-1)
                    for a in range(0, v.size, SLAB):
                        yield _slab(j * ni + a, ni, v[a : a + SLAB])

    return _long(files.select("path", "content").mapInArrow(run, SLABS))


def set_p1(files: DataFrame, message_offset: Column, value: Column) -> DataFrame:
    """Files with the P1 octet (offset 26 from a message's first byte) of one message replaced."""
    at = message_offset + 26
    before, after = F.expr("substring(content, 1, _at)"), F.expr("substring(content, _at + 2)")
    one = F.unhex(F.lpad(F.hex(value.cast("int")), 2, "0"))
    return files.withColumn("_at", at.cast("int")).withColumn("content", F.concat(before, one, after)).drop("_at")
