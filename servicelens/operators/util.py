"""Plan helpers shared by operators: size-checked broadcast and distributed ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast ``df`` only when a (cheap, limited) count proves it has at most
    ``max_rows`` rows; otherwise return it unhinted and let Spark shuffle-join it."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def computed_once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add expensive per-row expressions (JSON parses, scores) as columns computed once.

    Catalyst pushes a filter on a projected column below the projection with the
    expression inlined, so a value used by both a filter and the output would be
    computed twice per row.  Generator output cannot be inlined, so the expressions are
    emitted through ``inline_outer`` of a one-element array (one output row per row)."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))


def filter_computed(df: DataFrame, col: str, cond: Column) -> DataFrame:
    """``df.filter(cond)`` where ``cond`` reads the computed column ``col``: the column
    is re-emitted through ``computed_once`` so the filter reads the value instead of
    re-evaluating the expression tree behind it below the projection."""
    tmp = f"__{col}"
    out = computed_once(df, **{tmp: F.col(col)}).drop(col).withColumnRenamed(tmp, col)
    return out.filter(cond).select(*df.columns)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row as scalar subqueries:
    computed once (Spark merges subqueries over the same plan), no join."""
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})


def global_rank(df: DataFrame, order: list[Column], rank_col: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """Dense 1..N position over a total order without a single-partition window.

    Range-partition by the order (Spark samples the keys, so a hot value range is
    split across partitions), number rows inside each partition, then add the
    row count of all earlier partitions (a tiny per-partition count table, one row per
    partition, broadcast).  ``order`` must be a total order (add a unique tie-break).
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    with_pos = (ranged.withColumn("_part", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    with_pos = with_pos.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_part").cast("bigint"), 33))
    # Partition ids must be read once: AQE may coalesce the range shuffle differently in
    # the count branch and the join branch.  A reliable checkpoint (shared checkpoint
    # folder) freezes the positions and cuts the lineage.
    with_pos = cut_lineage(with_pos)
    counts = with_pos.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_offset"))
    return (with_pos.join(F.broadcast(offsets), "_part")
            .withColumn(rank_col, F.col("_offset") + F.col("_local") + 1)
            .drop("_part", "_mid", "_local", "_offset"))
