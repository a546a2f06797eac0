"""Every core query against its oracle in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from riskspark.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: These need larger tables than the smallest.
LARGER = {"filter_cols_stats"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, str):
            return v
        if hasattr(v, "year"):
            return str(v)[:10]
        return repr(float(v))

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    if name in LARGER:
        pytest.skip("needs more rows")
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["gbt_predict", "density_ratio_weights", "gain_shap_selector", "hyper_search"])
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
