"""Plan guards over every registered query: no cartesian-shaped joins, no
row-at-a-time Python UDFs, and parquet scans that read only the needed columns."""

import os
import re

import pyarrow.parquet as pq

import __spark_entry__ as E

from .conftest import SF_SMALL

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]


def _plans(spark):
    for name, fn in sorted(E.queries().items()):
        if name in E.LLM_QUERIES:
            continue
        yield name, fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_joins_or_row_udfs(spark):
    bad = {}
    for name, plan in _plans(spark):
        hits = [op for op in FORBIDDEN if op in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad


def test_wide_tables_are_pruned(spark):
    """A scan of a wide driver table never reads every column unless the query needs
    them all (the text column of documents, the full lineitem row)."""
    full = {t: len(pq.read_schema(os.path.join(SF_SMALL, f"{t}.parquet")).names)
            for t in ("lineitem", "orders", "documents", "events")}
    offenders = []
    for name, plan in _plans(spark):
        for m in re.finditer(r"FileScan parquet \[([^\]]*)\].*?Location: [^\[]*\[[^\]]*/(\w+)\.parquet\]", plan):
            cols, table = m.group(1).split(","), m.group(2)
            if table in full and len(cols) >= full[table]:
                offenders.append((name, table, len(cols)))
    assert not offenders, offenders
