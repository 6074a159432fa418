"""Every query against its SQL counterpart."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from voltide import catalog, evaluations, further, studies

QUERIES, ORACLES = ({**getattr(catalog, n), **getattr(further, n), **getattr(studies, n), **getattr(evaluations, n)} for n in ("QUERIES", "ORACLES"))

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype == object:
            df = df.assign(**{c: df[c].map(lambda v: None if v is None else str(v)[:10] if "-" in str(v)[:5] and str(v)[:4].isdigit() else v)})
        elif "datetime" in str(df[c].dtype):
            df = df.assign(**{c: df[c].astype(str).str.removesuffix(" 00:00:00")})
    keys = [c for c in df.columns if df[c].dtype == object or str(df[c].dtype).startswith(("int", "str"))]
    return df.sort_values(keys or list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = tidy(QUERIES[name](spark, DIR).toPandas())
    want = tidy(duck.sql(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) > 0
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6, rtol=0)


def test_flagship(spark):
    rows = catalog.flagship(spark, "/root/testdata/sf0.01").collect()
    assert {r["model"] for r in rows} == {"week", "month", "OLS", "Ridge", "Lasso"}
