"""computed_once / filter_computed keep every row and equal the plain forms; the
filter no longer re-evaluates the expression below the projection; recode keeps
unmatched keys."""

from pyspark.sql import functions as F

from servicelens.functions import columns as C
from servicelens.operators import util as U


def _df(spark):
    rows = [(i, None if i % 5 == 0 else f'{{"a": {i}}}') for i in range(50)]
    return spark.createDataFrame(rows, "i int, js string")


def test_computed_once_keeps_rows_and_nulls(spark):
    df = _df(spark)
    parsed = F.from_json("js", "a int")
    got = U.computed_once(df, p=parsed).select("i", F.col("p.a").alias("a"))
    want = df.select("i", parsed["a"].alias("a"))
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.count() == df.count()


def test_filter_computed_equals_filter_and_reads_the_value(spark):
    df = _df(spark).withColumn("v", F.coalesce(F.from_json("js", "a int")["a"], F.lit(-1)) * 2)
    cond = F.col("v") >= 40
    got = U.filter_computed(df, "v", cond)
    assert got.columns == df.columns
    assert sorted(got.collect()) == sorted(df.filter(cond).collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("from_json" in line for line in filters), filters


def test_recode_keeps_unmatched_and_routes_agree(spark):
    df = spark.createDataFrame([("O",), ("F",), ("X",), (None,)], "s string")
    m = {"O": "open", "F": "resolved"}
    got = df.select(C.recode("s", m).alias("a"), C.recode(F.upper("s"), m).alias("b"),
                    C.recode("s", m, "other").alias("c")).collect()
    assert [(r.a, r.b, r.c) for r in got] == [("open", "open", "open"), ("resolved", "resolved", "resolved"),
                                              ("X", "X", "other"), (None, None, "other")]
