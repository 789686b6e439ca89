"""Grid objects of decoded GRIB messages and of slices of NetCDF variables."""

from __future__ import annotations

import json
import math
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codec import hdf5, netcdf3
from ..codec.bits import FormatError
from ..functions import cf
from ..functions import geodesy as G
from ..operators.field import cf_unpack
from .files import _rows, few, variable_plane

KINDS = {c.__name__: c for c in (G.LatLon, G.Mercator, G.Gaussian, G.Rotated, G.Lambert, G.PolarStereo, G.Geostationary)}


@dataclass(frozen=True)
class Source:
    """A raster without known geography: it can be painted as it is and not be warped."""

    ni: int
    nj: int


def reprojectable(grid_type: Column, dx: Column, dy: Column, scan: Column) -> Column:
    """Whether a message's grid can be warped: corner-pinned grids that scan eastwards, planar ones with spacings.

    For space_view, dx and dy are the scan-angle increments, NULL without a camera altitude.
    """
    kind = F.regexp_replace(grid_type, "^reduced_(?=latlon$|gaussian$)", "")
    pinned = kind.isin("latlon", "gaussian", "mercator", "rotated_latlon") & (scan.bitwiseAND(0x80) == 0)
    planar = kind.isin("lambert", "polar_stereographic", "space_view") & F.coalesce((dx != 0) & (dy != 0), F.lit(False))
    return F.coalesce(pinned | planar, F.lit(False))


def signed_increments(dx: float, dy: float, scan: int) -> tuple[float, float]:
    """Spacings with the direction of the scan: i falls under flag 0x80, j rises under flag 0x40."""
    return -abs(dx) if scan & 0x80 else abs(dx), abs(dy) if scan & 0x40 else -abs(dy)


def space_view(g: dict) -> G.Geostationary | None:
    """Scan-angle grid of GRIB2 template 3.90; None for an orthographic view or a degenerate diameter."""
    nr = g.get("nr")
    if nr is None or nr * 1e6 >= 0xFFFFFFFF - 0.5 or nr <= 1 or not g["dx"] or not g["dy"] or "earth_major" not in g:
        return None
    a, b, ni, nj = g["earth_major"], g["earth_minor"], g["ni"], g["nj"]
    size = 2 * math.asin(1 / nr)
    rx, ry = size / g["dx"], b / a * size / g["dy"]
    xp, yp = g["xp"] - g["xo"], g["yp"] - g["yo"]
    xp = ni - 1 - xp if g["scan"] & 0x80 else xp
    yp = yp if g["scan"] & 0x40 else nj - 1 - yp
    # stored rows run against the geometric ones
    return G.Geostationary(ni, nj, nr * a, a, b, g["sub_lon"], True, -xp * rx, rx, (nj - 1 - yp) * ry, -ry)


def message_grid(g: dict):
    """The grid of a message's geometry (``grid`` in the catalog's meta), None where it cannot be warped."""
    kind, scan = g["grid_type"].removeprefix("reduced_"), g.get("scan", 0)
    ni, nj = max(g["pl"]) if g.get("pl") else g.get("ni"), g.get("nj")
    if not ni or not nj:
        return None
    if kind in ("latlon", "mercator", "gaussian", "rotated_latlon"):
        if scan & 0x80:
            return None
        at = (ni, nj, g["lat_first"], g["lon_first"], g["lat_last"], g["lon_last"])
        if kind == "rotated_latlon":
            return G.Rotated(*at, g["pole_lat"], g["pole_lon"], g["angle"])
        return G.Gaussian(*at, g["n_parallels"]) if kind == "gaussian" else (G.Mercator if kind == "mercator" else G.LatLon)(*at)
    if kind in ("lambert", "polar_stereographic") and g["dx"] and g["dy"]:
        at = (ni, nj, g["lat_first"], g["lon_first"], g["lov"], *signed_increments(g["dx"], g["dy"], scan), g.get("earth_radius", 6_371_229.0), g["lad"])
        return G.Lambert(*at, g["latin1"], g["latin2"]) if kind == "lambert" else G.PolarStereo(*at, g["south"])
    return space_view(g) if kind == "space_view" and g["nj"] and "xp" in g else None


def grid_mappings(variables: DataFrame) -> DataFrame:
    """(path, name, mapping, mapping_attrs) of variables whose grid_mapping names a variable of their file."""
    own = variables.select("path", "name", F.try_element_at("attrs", F.lit("grid_mapping")).alias("mapping")).where("mapping is not null")
    return own.join(variables.select("path", F.col("name").alias("mapping"), F.col("attrs").alias("mapping_attrs")), ["path", "mapping"]).select("path", "name", "mapping", "mapping_attrs")


def _first(attrs: dict, key: str, k: int = 0) -> float | None:
    v = attrs.get(key)
    v = v if isinstance(v, (list, tuple, np.ndarray)) else [v]
    return cf._number({"v": v[k]}, "v") if len(v) > k else None


def _unpacking(attrs: dict) -> tuple:
    """(scale, offset, least, most) of a variable's attributes."""
    low, high = (_first(attrs, "valid_range", k) for k in (0, 1))
    low, high = (low, high) if None not in (low, high) else (_first(attrs, "valid_min"), _first(attrs, "valid_max"))
    return _first(attrs, "scale_factor"), _first(attrs, "add_offset"), low, high


def _slice(data: bytes, name: str, y: str, x: str):
    """(dimensions, ni, nj, grid or None, unpacking) of a slice of a variable over the dimensions y and x."""
    if data[:4] == b"\x89HDF":
        f = hdf5.File(data)
        held = {n: (d, s, a) for n, _, d, s, a in hdf5.variables(data)}
        values, world = (lambda n: hdf5.values(data, n)), f.attributes(f.node(f.root))
    else:
        h = netcdf3.header(data)
        held = {v.name: (v.dims, v.shape, v.attrs) for v in h.variables}
        values, world = (lambda n: netcdf3.values(data, h, n)), h.attrs
    if name not in held:
        raise KeyError(name)
    dims, shape, attrs = held[name]
    if y == x or y not in dims or x not in dims:
        raise FormatError(f"{y} and {x} are not two dimensions of {name}")
    nj, ni = shape[dims.index(y)], shape[dims.index(x)]

    def coordinate(dim):
        if dim not in held or list(held[dim][0]) != [dim]:
            return None
        v = values(dim)
        if np.ma.getmaskarray(v).any():
            raise FormatError("a coordinate variable contains a fill value")
        scale, offset = _unpacking(held[dim][2])[:2]
        return (np.ma.getdata(v) * (1.0 if scale is None else scale) + (offset or 0.0)).tolist()

    def grid():
        if all(n in held and list(held[n][0][-2:]) == [y, x] for n in ("XLAT", "XLONG")) and cf._number(world, "MAP_PROJ") in cf.WRF:
            ends = []
            for j, i in ((0, 0), (nj - 1, ni - 1)):
                for n in ("XLAT", "XLONG"):
                    v = values(n)
                    v = v[(0,) * (v.ndim - 2) + (j, i)]
                    if v is np.ma.masked:
                        raise FormatError(f"a corner of {n} is missing")
                    ends.append(float(v))
            if (g := cf.wrf(world, ends[0], ends[1], ni, nj, ends[2], ends[3])) is not None:
                return g
        mapping = held.get(str(attrs.get("grid_mapping")))
        kind = str(mapping[2].get("grid_mapping_name", "latitude_longitude")).strip() if mapping else "latitude_longitude"
        if kind not in ("geostationary", "latitude_longitude"):
            return None  # projected x and y are no degrees
        across, down = coordinate(x), coordinate(y)
        if across is None or down is None:
            return None
        if kind == "geostationary":
            return cf.geostationary(mapping[2], across, down)
        if not across or not down:
            raise FormatError("empty coordinate array")
        if len(across) > 1 and all(b < a for a, b in zip(across, across[1:])):
            return None  # an eastward map would read it as a wrap
        return G.LatLon(ni, nj, down[0], across[0], down[-1], across[-1])

    return dims, ni, nj, grid(), _unpacking(attrs)


SLICE = "path string, dims array<string>, ni int, nj int, kind string, grid string, unpacking string, error string"


def slices(files: DataFrame, name: str, y: str, x: str) -> DataFrame:
    """Geometry of a slice in each NetCDF file, decoded where the file is; kind is NULL where only the source can be painted."""
    kinds = [("path", pa.string()), ("dims", pa.list_(pa.string())), ("ni", pa.int32()), ("nj", pa.int32()), ("kind", pa.string()), ("grid", pa.string()), ("unpacking", pa.string()), ("error", pa.string())]

    def run(batches):
        for b in few(batches):
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    dims, ni, nj, g, packed = _slice(data, name, y, x)
                    rows.append((path, list(dims), ni, nj, type(g).__name__ if g else None, json.dumps(astuple(g)) if g else None, json.dumps(packed), None))
                except (FormatError, IndexError, KeyError) as e:
                    rows.append((path, *[None] * 6, str(e) or type(e).__name__))
            yield _rows(kinds, rows)

    return files.select("path", "content").mapInArrow(run, SLICE)


def slice_field(files: DataFrame, name: str, y: str, x: str, at: dict[str, int]) -> tuple[DataFrame, object]:
    """(j, i, value) of a slice of one file's variable, unpacked, and its grid: what render, probe, contours, overlay and CSV take.

    ``at`` fixes every dimension but y and x.
    """
    rows = slices(files, name, y, x).take(2)
    if len(rows) != 1:
        raise ValueError("a slice is of one file")
    r = rows[0]
    if r.error:
        raise FormatError(r.error)
    if set(at) != set(r.dims) - {y, x}:
        raise ValueError(f"fix {sorted(set(r.dims) - {y, x})}")
    scale, offset, low, high = json.loads(r.unpacking)
    long = variable_plane(files, name, y, x, r.dims, at).withColumn("value", cf_unpack(F.col("value"), scale, offset, (low, high)))
    return long, KINDS[r.kind](*json.loads(r.grid)) if r.kind else Source(r.ni, r.nj)
