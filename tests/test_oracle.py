"""Every registered query against its DuckDB oracle on the smallest data set
(same comparison as the driver: columns by name, order-insensitive values)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from servicelens.sources.tables import TABLES

from .conftest import SF_SMALL

# the queries of servicelens.llm have tests of their own
QUERIES = {k: v for k, v in E.queries().items() if k not in E.LLM_QUERIES}
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_is_listed():
    without = sorted(set(QUERIES) - set(ORACLE))
    assert without == sorted(E.ROWS_ONLY), without


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "breach_probability" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    spd = QUERIES[name](spark, SF_SMALL).toPandas()
    opd = con.execute(ORACLE[name]).df()
    sc, sr = _rows(spd)
    oc, orows = _rows(opd)
    assert sc == oc
    assert len(sr) == len(orows)
    assert sr == orows
