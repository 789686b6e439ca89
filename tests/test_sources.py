"""Files read through Spark: layers, catalogs with broken files, spectral messages."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.codec import grib1, grib2, synth
from gridspark.codec.bits import FormatError
from gridspark.functions import geodesy as G
from gridspark.operators import render as R
from gridspark.sources import files, grids, layers
from gridspark.sources import files as S


def test_vector_layer(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"lines": [[10, 50, 11, 51], [-5, 1, -6, 2, -7, 3]]}))
    got = {(r.ring, r.k): (r.lat, r.lon) for r in layers.read_layer(spark, f"file://{tmp_path}").collect()}
    assert got == {(0, 0): (50.0, 10.0), (0, 1): (51.0, 11.0), (1, 0): (1.0, -5.0), (1, 1): (2.0, -6.0), (1, 2): (3.0, -7.0)}


def test_binary_files_catalog_and_fields(spark, tmp_path):
    x = np.arange(64) + 5
    (tmp_path / "a.grib2").write_bytes(synth.simple2(x, 8, 8) + synth.complex2(x, 8, 8, 2))
    (tmp_path / "b.grib1").write_bytes(synth.simple1(x, 8, 8))
    (tmp_path / "c.grib2").write_bytes(synth.grib2(8, 8, 77, b"\0" * 9, b"\0"))
    f = files.read_files(spark, f"file://{tmp_path}")
    assert {(r.edition, r.packing) for r in files.catalog(f).collect()} == {(2, "grid_simple"), (2, "grid_complex_spatial_differencing"), (1, "grid_simple"), (2, "unsupported_77")}
    rows = files.fields(f).collect()
    assert all(r["values"] == pytest.approx((-1 + x / 1024).tolist()) for r in rows if r.error is None) and sum(r.error is not None for r in rows) == 1
    shown = f.select(files.detect_format(F.col("content"), F.col("path")).alias("f"), files.preview(F.col("content"), 4)[1].alias("p")).collect()
    assert {r.f for r in shown} == {"grib1", "grib2"} and {r.p for r in shown} == {"GRIB"}
    assert spark.range(1).select(files.detect_path(F.lit("/x/Y.NC")).alias("f")).first().f == "netcdf"


def test_spectral_simple_coefficients():
    t, n = 2, 6
    v = np.arange(2 * n - 2)
    grid = struct.pack(">III", t, t, t) + bytes([1, 1])
    b = synth.grib2(1, 1, 50, synth.red(0.0, 0, 0, 8) + struct.pack(">f", 7.5), v.astype(np.uint8).tobytes(), grid=grid, grid_template=50)
    m = next(grib2.messages(b))
    got = grib2.coefficients(m, b)
    assert [c[:2] for c in got] == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    assert got[0][2:] == (7.5, 0.0) and got[1][2:] == (0.0, 0.0) and got[3][2:] == (4.0, 5.0) and got[5][2:] == (8.0, 9.0)


def test_predefined_grid_without_section():
    b = bytearray(synth.simple1(np.zeros(144 * 73, int), 144, 73))
    pds, gds = 8, 8 + 28
    b[pds + 7] &= 0x7F
    b[pds + 6] = 2
    del b[gds : gds + 32]
    b[4:7] = len(b).to_bytes(3, "big")
    m = next(grib1.messages(bytes(b)))
    assert (m["grid"]["ni"], m["grid"]["nj"]) == (144, 73) and len(grib1.decode(m, bytes(b))) == 144 * 73


def space_view(scan=0, nr=6_610_700, dx=3622, dy=3610):
    """Template 3.90 of a 5 x 4 sector around the sub-satellite point of a full disk."""
    body = bytes([6]) + b"\0" * 15 + struct.pack(">II", 5, 4) + synth._sm(0, 4) + synth._sm(-75_000_000, 4) + b"\0" + struct.pack(">II", dx, dy) + struct.pack(">II", 1002 * 1000, 1001 * 1000) + bytes([scan]) + b"\0" * 4 + struct.pack(">III", nr, 1000, 1000)
    return synth.grib2(5, 4, 0, synth.red(0.0, 0, 0, 8) + b"\0", bytes(range(20)), None, 20, body, 90)


def test_grids_of_messages(spark, tmp_path):
    for k, b in enumerate([space_view(), synth.simple2(np.arange(64), 8, 8), space_view(nr=0xFFFFFFFF), space_view(dx=0)]):
        (tmp_path / f"{k}.grib2").write_bytes(b)
    rows = files.catalog(files.read_files(spark, f"file://{tmp_path}")).orderBy("path").select("meta").collect()
    found = [grids.message_grid(json.loads(r.meta)["grid"]) for r in rows]
    assert found[1] == G.LatLon(8, 8, 90.0, 0.0, -90.0, 354.375) and found[2] is None and found[3] is None
    g = found[0]
    step = 2 * np.arcsin(1 / 6.6107) / 3622
    assert isinstance(g, G.Geostationary) and g.dx == pytest.approx(step) and g.x0 == pytest.approx(-2 * step) and g.dy == pytest.approx(-g.r_pol / g.r_eq * 2 * np.arcsin(1 / 6.6107) / 3610)
    up = grids.message_grid(next(grib2.messages(space_view(0x40)))["grid"])
    assert g.y0 == pytest.approx(-g.dy) and up.y0 == pytest.approx(-2 * g.dy)  # row 1 and row 2 hold the sub-satellite point
    p = spark.range(1).select(*[c.alias(n) for c, n in zip(g.point(F.lit(2.0), F.lit(1.0)), ("lat", "lon"), strict=True)]).first()
    assert (p.lat, p.lon) == pytest.approx((0.0, -75.0))
    assert grids.signed_increments(3.0, 2.0, 0) == (3.0, -2.0) and grids.signed_increments(3.0, 2.0, 0xC0) == (-3.0, 2.0)


def test_planar_message_grid():
    g = {"grid_type": "lambert", "ni": 3, "nj": 2, "lat_first": 20.0, "lon_first": 240.0, "lov": 265.0, "lad": 25.0, "latin1": 25.0, "latin2": 25.0, "dx": 5000.0, "dy": 4000.0, "scan": 0x40, "earth_radius": 6_371_200.0}
    assert grids.message_grid(g) == G.Lambert(3, 2, 20.0, 240.0, 265.0, 5000.0, 4000.0, 6_371_200.0, 25.0, 25.0, 25.0)
    assert grids.message_grid(g | {"grid_type": "polar_stereographic", "south": True, "scan": 0x80}) == G.PolarStereo(3, 2, 20.0, 240.0, 265.0, -5000.0, -4000.0, 6_371_200.0, 25.0, True)
    assert grids.message_grid(g | {"dx": 0.0}) is None and grids.message_grid({"grid_type": "spherical_harmonic", "j": 3}) is None


def test_reprojectable(spark):
    rows = [("latlon", None, None, 0, True), ("reduced_gaussian", None, None, 0x40, True), ("mercator", 1.0, 1.0, 0x80, False), ("lambert", 1.0, 2.0, 0x80, True), ("polar_stereographic", 0.0, 2.0, 0, False), ("space_view", None, None, 0, False), ("space_view", 1e-5, -1e-5, 0, True), ("spherical_harmonic", None, None, None, False), (None, None, None, None, False)]
    d = spark.createDataFrame(rows, "t string, dx double, dy double, scan int, want boolean")
    assert d.where(grids.reprojectable(F.col("t"), F.col("dx"), F.col("dy"), F.col("scan")) != F.col("want")).count() == 0


def test_slices_find_their_grids(spark, tmp_path):
    v = np.arange(24, dtype=np.int16).reshape(2, 3, 4)
    lat, lon = (["lat"], np.array([20.0, 10.0, 0.0]), {}), lambda step: (["lon"], np.arange(4.0)[::step] * 10, {})
    goes = {"grid_mapping_name": "geostationary", "perspective_point_height": np.float64(35786023.0), "semi_major_axis": np.float64(6378137.0), "semi_minor_axis": np.float64(6356752.31414), "longitude_of_projection_origin": np.float64(-75.0)}
    packed = {"scale_factor": np.float64(0.5), "add_offset": np.float64(1.0), "valid_max": np.int16(22)}
    dims = {"t": 2, "lat": 3, "lon": 4}
    write = lambda name, *a: (tmp_path / f"{name}.nc").write_bytes(synth.netcdf3(*a))
    write("plain", dims, {"v": (["t", "lat", "lon"], v, packed), "lat": lat, "lon": lon(1)})
    write("west", dims, {"v": (["t", "lat", "lon"], v, {}), "lat": lat, "lon": lon(-1)})
    write("albers", dims, {"v": (["t", "lat", "lon"], v, {"grid_mapping": "crs"}), "crs": (["t"], np.zeros(2), {"grid_mapping_name": "albers_conical_equal_area"}), "lat": lat, "lon": lon(1)})
    write("goes", dims, {"v": (["t", "lat", "lon"], v, {"grid_mapping": "crs"}), "crs": (["t"], np.zeros(2), goes), "lat": (["lat"], np.array([3, 2, 1], np.int16), {"scale_factor": np.float64(1e-3)}), "lon": (["lon"], np.arange(4.0) * 1e-3, {})})
    write("wrf", dims, {"v": (["t", "lat", "lon"], v, {}), "XLAT": (["t", "lat", "lon"], 40 + v / 10, {}), "XLONG": (["t", "lat", "lon"], v / 10 - 100, {})}, {"MAP_PROJ": np.int32(1), "DX": np.float64(9000.0), "DY": np.float64(9000.0), "TRUELAT1": np.float64(30.0), "TRUELAT2": np.float64(60.0), "STAND_LON": np.float64(-98.0)})
    all_files = files.read_files(spark, f"file://{tmp_path}")
    got = {r.path.rsplit("/", 1)[1][:-3]: r for r in grids.slices(all_files, "v", "lat", "lon").collect()}
    assert {n: r.kind for n, r in got.items()} == {"plain": "LatLon", "west": None, "albers": None, "goes": "Geostationary", "wrf": "Lambert"} and not any(r.error for r in got.values())
    assert {(r.name, r.mapping_attrs["grid_mapping_name"]) for r in grids.grid_mappings(files.variables(all_files)).collect()} == {("v", "geostationary"), ("v", "albers_conical_equal_area")}
    one = lambda n: all_files.where(F.col("path").endswith(f"/{n}.nc"))
    field, g = grids.slice_field(one("plain"), "v", "lat", "lon", {"t": 1})
    assert g == G.LatLon(4, 3, 20.0, 0.0, 0.0, 30.0)
    assert {(r.j, r.i): r.value for r in field.collect()} == {(j, i): (1 + (12 + 4 * j + i) / 2 if (j, i) != (2, 3) else None) for j in range(3) for i in range(4)}
    assert R.render(field, g).count() == 12 and R.render(field, g, "equirectangular").count() > 0
    flat, source = grids.slice_field(one("albers"), "v", "lat", "lon", {"t": 0})
    assert source == grids.Source(4, 3) and R.render(flat, source).count() == 12
    _, far = grids.slice_field(one("goes"), "v", "lat", "lon", {"t": 0})
    assert (far.y0, far.dy, far.dx) == pytest.approx((3e-3, -1e-3, 1e-3)) and far.height == 35786023.0 + 6378137.0
    with pytest.raises(ValueError):
        grids.slice_field(one("plain"), "v", "lat", "lon", {})


def test_broken_files_give_error_rows(spark):
    whole = synth.simple2(np.arange(64), 8, 8)
    rows = [("cut", whole[:-9]), ("none", b"plain"), ("empty", b""), ("nc", b"CDF\x01broken"), ("h5", b"\x89HDF\r\n\x1a\nbroken"), ("whole", whole)]
    f = spark.createDataFrame(rows, "path string, content binary")
    for out in (S.catalog(f), S.fields(f)):
        got = {r.path: r.error for r in out.collect()}
        assert got["whole"] is None and all(got[k] for k, _ in rows[:-1])
    v = f.where("path in ('nc', 'h5', 'none')")
    assert all(r.error for r in S.variables(v).collect()) and S.variable_values(v, "t").count() == 0
    assert S.coefficients(f).count() == 0
    picked = {r.path: (r.ni, r.error) for r in S.message(S.fields(f), 0).collect()}
    assert picked["whole"] == (8, None) and picked["cut"][1] and S.message(S.fields(f), -1).where("error is null").count() == 0


def test_views_say_what_cannot_be_shown(spark):
    from gridspark.operators import views as V

    one = spark.createDataFrame([("a", synth.simple2(np.arange(64), 8, 8))], "path string, content binary")
    f, grid = V.resolve(one, 0)
    assert (grid.ni, grid.nj) == (8, 8) and f.count() == 64
    with pytest.raises(FormatError, match="no message 3"):
        V.resolve(one, 3)
    with pytest.raises(ValueError, match="name a message"):
        V.resolve(one)
    with pytest.raises(ValueError, match="same grid"):
        V.combined((f, grid), (f, G.LatLon(8, 8, 1.0, 2.0, 3.0, 4.0)), "mean")
    with pytest.raises(ValueError, match="cannot be warped"):
        V.picture((f, grids.Source(8, 8)), "robinson")
    assert V.picture(V.combined((f, grid), (f, grid), "ratio")).count() == 64


@pytest.mark.parametrize("grid", ["lambert", "cone", "polar", "space"])
def test_degenerate_grids_hold_nothing(spark, grid):
    g = {
        "lambert": G.Lambert(5, 5, 10.0, 0.0, 0.0, 0.0, 1000.0, 6_371_229.0, 20.0, 30.0, 60.0), "cone": G.Lambert(5, 5, 10.0, 0.0, 0.0, 1000.0, 1000.0, 6_371_229.0, 20.0, 30.0, -30.0),
        "polar": G.PolarStereo(5, 5, 60.0, 0.0, 0.0, 1000.0, 0.0, 6_371_229.0, 60.0, False), "space": G.Geostationary(5, 5, 42_164_160.0, 6_378_137.0, 6_356_752.3, 0.0, True, -0.1, 0.0, 0.1, -0.01),
    }[grid]
    d = spark.createDataFrame([(45.0, 10.0), (0.0, 0.0)], "lat double, lon double")
    i, j = g.index(d.lat, d.lon)
    assert d.select(i.alias("i"), j.alias("j")).where("i is not null or j is not null").count() == 0


def test_messages_of_a_file_are_decoded_apart(spark):
    """The same fields with and without spreading; broken and null files keep their error row."""
    x = np.arange(64)
    whole = synth.simple2(x, 8, 8) + b"between" + synth.complex2(x * 2, 8, 8, 1) + synth.simple2(x + 5, 8, 8)
    f = spark.createDataFrame([("a", whole), ("b", synth.simple1(x, 8, 8)), ("cut", whole[:60]), ("none", None)], "path string, content binary")
    plain, apart = ({(r.path, r.message_index): (r.error, r.values) for r in S.fields(g).collect()} for g in (f, S.spread(f)))
    assert plain == apart and {k for k in plain if plain[k][0] is None} == {("a", 0), ("a", 1), ("a", 2), ("b", 0)}
    assert plain["cut", None][0] and plain["none", None][0]
    assert S.catalog(f).where("path = 'none' and error is not null").count() == 1 and S.variables(f).where("path = 'none' and error is not null").count() == 1
    assert S.spread(f.limit(0)).count() == 0
