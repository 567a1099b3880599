"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import weakref
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder

#: A word is a run of characters other than the ASCII white space of this pattern.
WHITE_SPACE = r"[\x20\x09-\x0D]+"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own(df: DataFrame) -> list[Column]:
    """All columns of ``df``, quoted."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns of these names (compared without case), to make room for new ones."""
    return df.select(*[c for c, name in zip(own(df), df.columns) if name.lower() not in names])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable cannot be replaced by the expression it stands for, so the
    optimizer does not copy a costly array into every use (or into a lambda that runs
    once per element)."""
    return F.transform(F.array(value), body)[0]


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    The folder is the one ``spark.checkpoint.dir`` names, so the rows survive the loss of
    any executor and the plan above starts from a scan."""
    spark = df.sparkSession
    path = scratch_folder(spark, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    # nothing reads the shuffle files of the finished job again; Spark removes them when the driver's JVM
    # has collected what referred to them, which on its own it does twice an hour
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more: all made from them has been written since."""
    for t in tables:
        where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(t))
        where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def hash_sample(rows: DataFrame, key: str, n: int, wanted: int) -> DataFrame:
    """At most ``wanted`` (by chance more, once in ten thousand tables) of ``n`` rows with distinct ``key``: those of the smallest
    hashes.

    The cut comes from ``n`` alone, so a task sends what is wanted of its rows and nothing that is thrown away; only a
    handful is sorted instead."""
    hashed = F.xxhash64(key)
    if n <= wanted:
        return rows
    if wanted <= 1024:
        return rows.orderBy(hashed, key).limit(wanted)
    share = (wanted - 4 * wanted ** 0.5) / n
    return rows.filter(hashed < F.lit(int(share * 2.0 ** 64) - (1 << 63)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply) of every element."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Smallest node of the component of every node of ``edges`` (``a``, ``b``, both long).

    Alternates the two star steps of Kiveris et al. (2014): every node hands its larger
    neighbours, then its smaller ones, to the smallest node it knows, until only stars
    are left (a logarithmic number of rounds).  Minima are map-side combined and written
    before they are joined back, so a node with very many links is a join partition that
    adaptive execution may split.  Links never leave the executors.  Returns ``node``,
    ``root`` for the nodes that have a link to another node."""
    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        return row[0], row[1]

    links = scratch_table(oriented(edges), "links")
    seen = state(links)
    if not seen[0]:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        links = scratch_table(oriented(large), "links")
        low = scratch_table(links.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = links.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        links = scratch_table(oriented(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))), "links")
        now = state(links)
        if now == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
