"""As-of join against a plain search."""

import random

import pytest

from servicelens.operators.asof import as_of_join


def brute(probes, versions, strict):
    out = []
    for p in probes:
        fits = [v for v in versions if v[0] is not None and v[0] == p[0] and p[1] is not None and v[1] is not None
                and (v[1] < p[1] if strict else v[1] <= p[1])]
        out.append((*p, max(fits, key=lambda v: (v[1], v[2]))[2] if fits else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 5, 40])
@pytest.mark.parametrize("strict", [False, True])
def test_equals_brute_force(spark, partitions, strict):
    """A key with two thirds of all rows, so partitions begin and end inside it, some without any version; equal times;
    null keys and times."""
    rng = random.Random(partitions)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, 4, None])
    versions = [(key(), rng.choice([rng.randint(0, 60), rng.randint(500, 520), None]), i) for i in range(300)]
    probes = [(key(), rng.choice([rng.randint(0, 1000)] * 6 + [None]), i) for i in range(1500)]
    got = as_of_join(spark.createDataFrame(probes, "k int, at int, n int").repartition(3),
                     spark.createDataFrame(versions, "key int, since long, v int").repartition(3).withColumnsRenamed({"key": "k"}),
                     "k", "at", "since", tie="v", strict=strict, num_partitions=partitions)
    assert got.columns == ["k", "at", "n", "version"] and got.select("version.*").columns == ["k", "since", "v"]
    rows = sorted(((r["k"], r["at"], r["n"], r["version"]["v"] if r["version"] else None) for r in got.collect()), key=repr)
    assert rows == brute(probes, versions, strict)


def test_one_side_empty(spark):
    some, none = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "k string, t int, x int"), spark.createDataFrame([], "k string, t int, x int")
    got = as_of_join(some, none.withColumnRenamed("x", "y"), "k", "t", "t").collect()
    assert sorted((r["k"], r["version"]) for r in got) == [("a", None), ("b", None)]
    assert as_of_join(none, some.withColumnRenamed("x", "y"), "k", "t", "t").count() == 0
    assert as_of_join(none, none.withColumnRenamed("x", "y"), "k", "t", "t").count() == 0


def test_small_batches(spark):
    """The carried version crosses Arrow batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        versions = [(k, t, t) for k in range(3) for t in (0, 50)]
        probes = [(k, t, t) for k in range(4) for t in range(0, 100, 7)]
        got = as_of_join(spark.createDataFrame(probes, "k int, t int, n int"), spark.createDataFrame(versions, "k int, t int, v int"),
                         "k", "t", "t", num_partitions=4)
        assert sorted(((r["k"], r["t"], r["n"], r["version"]["v"] if r["version"] else None) for r in got.collect()), key=repr) == brute(probes, versions, False)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
