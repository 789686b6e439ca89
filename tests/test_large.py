"""Findings on larger tables: zeros on log scales, fields that must not travel whole, slabs and batches of bounded size."""

import datetime

import pytest

from test_queries import differences

from gridspark.plans import catalog


@pytest.mark.parametrize("name", ["r05_position_log", "r07_paint_log"])
def test_log_scale_places_zero_as_its_sql(spark, tmp_path, name):
    import duckdb

    when = datetime.datetime(2024, 1, 1)
    rows = [(k, when, k, "a", v, "{}") for k, v in enumerate([0.0, 0.1, 1.0, 50.0, 300.0, 1e6])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    differences(catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["r17_combined_render", "r17_combined_probe", "r17_combined_contours"])
def test_fields_are_not_sent_to_the_driver(spark, sf, name):
    """A field decoded from one file looks small to the optimiser; its joins must not broadcast it."""
    from gridspark.plans import catalog_more  # noqa: F401

    text = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in text
    assert all("idx" in line for line in text.split("\n") if "BroadcastHashJoin" in line)  # only the colour table


def test_message_is_decoded_in_slabs_as_whole():
    import numpy as np

    from gridspark.codec import bits, grib2, synth

    n = 2 * bits.SLAB + 64
    x = np.arange(n) * 7919 % 4096
    some = x % 3 > 0
    for raw in (synth.simple2(x, 64, n // 64), synth.simple2(x[some], 64, n // 64, bitmap=some.astype(int)), synth.ieee2(x / 8, 64, n // 64), synth.log2(x / 4096, 64, n // 64), synth.complex2(x, 64, n // 64, 2), synth.alternate2(x, 64, n // 64)):
        m = next(grib2.messages(raw))
        whole, parts = grib2.decode(m, raw), list(grib2.slabs(m, raw))
        assert [k for k, _ in parts] == list(range(0, n, bits.SLAB))
        assert np.array_equal(np.ma.concatenate([v for _, v in parts]).filled(-9.0), whole.filled(-9.0))
    simple = synth.simple2(x, 64, n // 64)
    m = next(grib2.messages(simple))
    assert np.array_equal(grib2.decode(m, simple), -1 + x / 1024)


def test_decoding_takes_memory_of_a_slab():
    """Unpacking 12-bit numbers took over 90 octets a value, and a message was decoded as a whole."""
    import tracemalloc

    import numpy as np

    from gridspark.codec import grib2, synth

    n = 1 << 20
    raw = synth.simple2(np.arange(n) % 4096, 64, n // 64)
    m = next(grib2.messages(raw))
    tracemalloc.start()
    for _ in grib2.slabs(m, raw):
        pass
    slabs = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    grib2.decode(m, raw)
    whole = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert slabs < 16 << 20 and whole < 40 * n


def test_slice_of_a_variable_is_read_in_place(spark):
    """One time of a large variable: the others are not decoded, and no batch holds more than a slab."""
    import tracemalloc

    import numpy as np

    from gridspark.codec import netcdf3, synth
    from gridspark.sources import files as S

    x = np.arange(40 * 500 * 64, dtype=np.int32).reshape(40, 500, 64)
    raw = synth.netcdf3({"t": 0, "y": 500, "x": 64}, {"v": (["t", "y", "x"], x, {"_FillValue": np.int32(2 * 32000 + 5)}), "w": (["t"], np.arange(40, dtype=np.int16), {})})
    ds = netcdf3.header(raw)
    tracemalloc.start()
    held, _ = netcdf3.packed(raw, ds, "v")
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
    assert np.array_equal(held, x)
    one = spark.createDataFrame([("a", bytearray(raw))], "path string, content binary")
    got = {(r.j, r.i): r.value for r in S.variable_plane(one, "v", "y", "x", ["t", "y", "x"], {"t": 2}).collect()}
    want = {(j, i): None if (v := 2 * 32000 + j * 64 + i) == 2 * 32000 + 5 else float(v) for j in range(500) for i in range(64)}
    assert got == want
    turned = {(r.j, r.i): r.value for r in S.variable_plane(one, "v", "x", "y", ["t", "y", "x"], {"t": 2}).collect()}
    assert turned == {(i, j): v for (j, i), v in want.items()}
    assert S.variable_plane(one, "v", "y", "x", ["t", "y", "x"], {"t": 40}).count() == 0


@pytest.mark.parametrize("name", ["s07_grib1_grids", "s12_grib2_grids", "s13_earth_shapes", "s14_products"])
def test_metadata_is_parsed_once(spark, sf, name):
    """A parse for each of up to 18 columns made the JVM the slow part."""
    text = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in text and text.count("from_json") == 1


def test_batches_are_taken_a_few_rows_at_a_time():
    import pyarrow as pa

    from gridspark.sources import files as S

    b = pa.RecordBatch.from_arrays([pa.array(range(3 * S.ROWS + 1))], ["k"])
    parts = list(S.few(iter([b, b.slice(0, 0)])))
    assert max(p.num_rows for p in parts) == S.ROWS and [k for p in parts for k in p.column(0).to_pylist()] == list(range(b.num_rows))


def test_run_lengths_are_dealt_by_rows(spark, sf, monkeypatch):
    """The session's partitions alone gave a task a share of the table that grew with it."""
    from gridspark.plans import fields

    monkeypatch.setattr(fields, "KEYED_ROWS", 500)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    out = catalog.QUERIES["p22_run_length"](spark, sf)
    assert out.rdd.getNumPartitions() == -(-rows // 500)
