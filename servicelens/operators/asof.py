"""As-of join: every probe with the last version of its key that is not later (C5, C7 and E2 at a time of their own).

Versions and probes are range-partitioned together by (key, time), so a key with very many rows spans as many partitions
as it needs; every partition is scanned once, carrying the last version.  What a partition cannot know is the version that
was last before it began: one row for the first and the last key of each partition says what they end with, and from
these few rows the gaps are filled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage


def as_of_join(probes: DataFrame, versions: DataFrame, key: str, probe_ts: str, version_ts: str, tie: str | None = None,
               out: str = "version", strict: bool = False, num_partitions: int | None = None) -> DataFrame:
    """All rows and columns of ``probes`` with the struct ``out``: the columns of the last row of ``versions`` with the same
    ``key`` and ``version_ts <= probe_ts`` (``<`` if ``strict``), or null.  Of versions of one time the one with the highest ``tie`` counts.

    A null key or time matches nothing.  Both sides are shuffled once, together, by ranges; nothing is grouped by key."""
    spark = probes.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_type, ts_type = versions.schema[key].dataType, versions.schema[version_ts].dataType
    row, version = T.StructField("p", probes.schema), T.StructField("v", versions.schema)

    def side(df: DataFrame, ts: str, first: bool, tie_by: Column) -> DataFrame:
        whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        return df.select(F.col(key).cast(key_type).alias("k"), F.col(ts).cast(ts_type).alias("at"), F.lit(0 if first else 1).alias("s"),
                         tie_by.alias("t"), (whole if df is probes else F.lit(None).cast(row.dataType)).alias("p"),
                         (whole if df is versions else F.lit(None).cast(version.dataType)).alias("v"))

    tie_by = F.col(tie) if tie else F.lit(0)
    tie_type = versions.schema[tie].dataType if tie else T.IntegerType()
    known = side(versions, version_ts, not strict, tie_by).filter("k IS NOT NULL AND at IS NOT NULL")
    both = known.unionByName(side(probes, probe_ts, strict, F.lit(None).cast(tie_type)))
    order = [F.col(c) for c in ("k", "at", "s", "t")]
    ranged = both.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    mark = T.StructField("mark", T.BooleanType())
    schema = T.StructType([T.StructField("k", key_type), T.StructField("part", T.IntegerType()), row, version, mark])
    # partition ids are read again when the gaps are filled: they are frozen in the shared checkpoint folder
    scanned = cut_lineage(ranged.select("k", "part", "p", "v").mapInArrow(_scan, schema))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most two rows per partition
    gaps = scanned.filter("mark").select("k", "part", F.last("v", True).over(before).alias("w")).filter("w IS NOT NULL")
    filled = scanned.filter("NOT mark").join(F.broadcast(gaps), ["k", "part"], "left")
    return filled.select("p.*", F.coalesce("v", "w").alias(out))


def _scan(batches):
    """Rows of a partition, sorted: probes with the last version of their key seen here, then a mark for the first and the
    last key with the version each ends with."""
    first = last = part = carried = names = None
    ends: dict = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, versions = batch.column(0), batch.column(3)
        part = batch.column(1)[0]
        k = keys.dictionary_encode()
        code = k.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        is_version = np.asarray(batch.column(2).is_null())
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        group = np.repeat(starts, np.diff(np.r_[starts, len(code)]))
        # place in [carried version, versions of this batch]; the carried one is for a first group of the same key
        place = np.where(is_version, np.arange(1, len(code) + 1), 0)
        place = np.maximum.accumulate(place)
        goes_on = carried is not None and keys[0].is_valid and keys[0] == last
        place = np.where(place > group, place, 0)
        valid = (place > 0) | (goes_on & (group == 0))
        pool = pa.concat_arrays([carried if carried is not None else pa.nulls(1, versions.type), versions])
        found = pool.take(pa.array(place, mask=~valid))
        if first is None:
            first = keys[0]
        if keys[0] == first:
            ends["first"] = found.slice(int(starts[1]) - 1 if len(starts) > 1 else len(code) - 1, 1)
        last, carried = keys[batch.num_rows - 1], found.slice(len(code) - 1, 1)
        probe = ~is_version
        some = pa.array(np.flatnonzero(probe))
        yield pa.RecordBatch.from_arrays(
            [keys.take(some), batch.column(1).take(some), batch.column(2).take(some), found.take(some), pa.array(np.zeros(len(some), bool))],
            names=["k", "part", "p", "v", "mark"])
        names = batch.column(2).type
    if part is not None and last.is_valid:
        marks = [(last, carried)] if first == last or not first.is_valid else [(first, ends["first"]), (last, carried)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k.as_py() for k, _ in marks], last.type), pa.array([part.as_py()] * len(marks), pa.int32()),
             pa.nulls(len(marks), names), pa.concat_arrays([v for _, v in marks]), pa.array([True] * len(marks))],
            names=["k", "part", "p", "v", "mark"])
