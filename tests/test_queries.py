"""Every registered field query that has SQL gives the rows of its SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.plans import catalog, catalog_files, catalog_more, catalog_sections  # noqa: F401


def differences(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert len(a) == len(b)
    a, b = (f[cols].sort_values(cols, kind="stable").reset_index(drop=True) for f in (a, b))
    for c in cols:
        x, y = a[c], b[c]
        try:
            same = x.astype(float).to_numpy() == y.astype(float).to_numpy()
        except (TypeError, ValueError):
            same = (x == y).to_numpy(dtype=bool, na_value=False)
        same = same | (x.isna() & y.isna()).to_numpy()
        assert same.all(), f"{c}: {x[np.flatnonzero(~same)[0]]} against {y[np.flatnonzero(~same)[0]]}"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    differences(catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_spectral_synthesis_uses_all_components(spark, sf):
    """At the pole only m = 0 counts, up to component 55 (n = 10); elsewhere waves go up to m = 9."""
    mean = {r.i: r.v for r in catalog.fe(spark, sf).groupBy("i").agg(F.avg("value").alias("v")).collect()}
    out = catalog.QUERIES["r15_spectral_synthesis"](spark, sf).toPandas().pivot(index="j", columns="i", values="value").to_numpy()
    assert len(mean) == 64
    assert np.allclose(out[0], sum(mean[n * (n + 1) // 2] * (2 * n + 1) ** 0.5 for n in range(11)), atol=1e-5)
    waves = np.abs(np.fft.rfft(out, axis=1)).max(0)
    assert waves[9] > 1e-3 and np.allclose(waves[10:], 0, atol=1e-4)  # component 54 is m = n = 9


def test_entry_imports_and_registers():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert catalog.FLAGSHIP in e.queries()
