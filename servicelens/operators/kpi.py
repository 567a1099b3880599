"""Work queues, KPIs and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from .util import global_rank, with_scalars


def what_next_queue(scored: DataFrame, actions_col: str = "recommended_actions", k: int | None = 20,
                    key: str = "ticket_id", p: str = "breach_probability",
                    columns: list[str] | None = None) -> DataFrame:
    """Tickets by breach probability (desc, ticket id as tie-break) with the first
    recommended action, or 'monitor'.

    ``k`` set: a top-k report (TakeOrderedAndProject: per-partition top-k then merge).
    ``k=None``: the full ranked queue via ``global_rank`` (range partitioning; never a
    single-partition window).  ``columns`` keeps only those columns (plus the key, the
    probability and the action) before ranking, so the rank's checkpoint writes only
    what the queue needs.
    """
    first = F.coalesce(F.try_element_at(F.col(actions_col), F.lit(1)), F.lit("monitor"))
    base = scored.withColumn("recommended_action", first)
    if columns is not None:
        base = base.select(*dict.fromkeys([*columns, key, p, "recommended_action"]))
    order = [F.col(p).desc(), F.col(key).asc()]
    if k is not None:
        top = base.orderBy(*order).limit(k)
        return top.withColumn("queue_position", F.row_number().over(Window.orderBy(*order)))
    return global_rank(base, order, "queue_position")


def ops_kpis(scored: DataFrame, p: str = "breach_probability", actions: DataFrame | None = None) -> DataFrame:
    """Totals, at-risk (p >= .7), healthy (< .5), compliance % (100 when empty),
    action success % (0 when no actions), average confidence."""
    n = F.count(F.lit(1))
    at_risk = F.sum((F.col(p) >= R.ACTION_THRESHOLD).cast("long"))
    healthy = F.sum((F.col(p) < 0.5).cast("long"))
    out = scored.agg(
        n.alias("total_tickets"),
        F.coalesce(at_risk, F.lit(0)).alias("at_risk_tickets"),
        F.coalesce(healthy, F.lit(0)).alias("healthy_tickets"),
        F.when(n > 0, (n - F.coalesce(at_risk, F.lit(0))).cast("double") / n * 100.0)
        .otherwise(F.lit(100.0)).alias("sla_compliance"),
    )
    if actions is not None:
        a = actions.agg(F.count(F.lit(1)).alias("_na"),
                        F.sum(F.coalesce(F.col("success"), F.lit(True)).cast("long")).alias("_ok"))
        out = with_scalars(out, a).withColumn(
            "automation_success_rate",
            F.when(F.col("_na") > 0, F.col("_ok").cast("double") / F.col("_na") * 100.0).otherwise(F.lit(0.0))
        ).drop("_na", "_ok")
    return out


def business_impact(scored: DataFrame) -> DataFrame:
    """Descriptions mentioning revenue, infrastructure tickets."""
    return scored.agg(
        F.sum(F.lower(F.col("description")).contains("revenue").cast("long")).alias("revenue_tickets"),
        F.sum((F.col("category") == "infrastructure").cast("long")).alias("infrastructure_tickets"),
    )


def ticket_distribution(df: DataFrame, p: str = "breach_probability") -> DataFrame:
    """Per (priority, department) counts and average risk, with rollup rows."""
    return (df.rollup("priority", "department")
            .agg(F.count(F.lit(1)).alias("tickets"), F.avg(p).alias("avg_breach_risk")))


def state_by_bucket(state: DataFrame, bucket: str = "breach_bucket", ts: str = "version_ts") -> DataFrame:
    """Newest-first position inside each risk bucket.

    Buckets are five values, so a bucket window would put a fifth of the table in one
    task.  The position is instead computed as a global rank over (bucket, ts desc,
    key) minus the bucket's starting offset (a five-row count table)."""
    order = [F.col(bucket).asc(), F.col(ts).desc(), F.col("service_id").asc()]
    ranked = global_rank(state, order, "_g")
    starts = state.groupBy(bucket).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(bucket, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_start"))
    return (ranked.join(F.broadcast(starts), bucket)
            .withColumn("bucket_position", F.col("_g") - F.col("_start"))
            .drop("_g", "_start"))


def daily_report(scored: DataFrame, ts: str = "created_at", p: str = "breach_probability",
                 revenue: str = "revenue_impact") -> DataFrame:
    """Per day: tickets, compliance % (share below .7), breaches prevented (tickets
    whose actions were triggered) and the revenue those tickets carry."""
    trig = F.col(p) >= R.ACTION_THRESHOLD
    n = F.count(F.lit(1))
    return (scored.groupBy(F.to_date(F.col(ts)).alias("day"))
            .agg(n.alias("tickets"),
                 (F.sum((~trig).cast("long")) * 100.0 / n).alias("compliance_pct"),
                 F.sum(trig.cast("long")).alias("breaches_prevented"),
                 F.sum(F.when(trig, F.col(revenue)).otherwise(F.lit(0.0))).alias("revenue_protected")))


def exact_median(df: DataFrame, group: str, value: str, tiebreak: str | None = None) -> DataFrame:
    """Exact median of ``value`` per ``group`` (NULL values ignored), with Spark's
    ``percentile`` interpolation: .5 x lower middle + .5 x upper middle.

    The built-in exact ``median`` buffers a value -> count map per group and merges it
    in one task, so a group holding a third of the rows with distinct values would
    hold them all in memory.  Here the rows are ranked over (group, value, tiebreak)
    with the range-partitioned ``global_rank`` (sampled bounds split a hot group, and
    ``tiebreak`` splits a hot value), a group's first rank is a min aggregate, and only
    the (at most two) middle rows per group are kept and aggregated."""
    cols = [group, value] + ([tiebreak] if tiebreak else [])
    v = df.select(*cols).filter(F.col(value).isNotNull())
    order = [F.col(group).asc_nulls_first(), F.col(value).asc()] + ([F.col(tiebreak).asc()] if tiebreak else [])
    ranked = global_rank(v, order, "_g")
    bounds = ranked.groupBy(F.col(group).alias("_bg")).agg((F.min("_g") - 1).alias("_start"),
                                                          F.count(F.lit(1)).alias("_n"))
    pos = F.col("_g") - F.col("_start")
    mid = ranked.join(bounds, F.col(group).eqNullSafe(F.col("_bg"))).select(
        F.col(group), F.col(value),
        ((pos == F.floor((F.col("_n") + 1) / 2)) | (pos == F.floor(F.col("_n") / 2) + 1)).alias("_mid"))
    return (mid.filter(F.col("_mid")).groupBy(group)
            .agg((F.lit(0.5) * F.min(value) + F.lit(0.5) * F.max(value)).alias("median")))


def latency_stats(df: DataFrame, group: str, value: str, tiebreak: str | None = None) -> DataFrame:
    """Mean, median, min, max and *sample* standard deviation (0 for one sample).
    Everything but the median is a partial + final aggregate; the median is the
    distributed ``exact_median`` (no per-group value buffer), joined per group."""
    n = F.count(F.col(value))
    stats = df.groupBy(group).agg(
        n.alias("samples"), F.avg(value).alias("avg_response_time"),
        F.min(value).alias("min_response_time"), F.max(value).alias("max_response_time"),
        F.when(n > 1, F.stddev_samp(value)).otherwise(F.lit(0.0)).alias("std_dev"))
    med = exact_median(df, group, value, tiebreak).withColumnRenamed(group, "_grp")
    return (stats.join(med, F.col(group).eqNullSafe(F.col("_grp")), "left")
            .select(group, "samples", "avg_response_time", F.col("median").alias("median_response_time"),
                    "min_response_time", "max_response_time", "std_dev"))


def throughput(df: DataFrame, ts: str, ok: Column) -> DataFrame:
    """Per day: requests, success rate, requests per second over the active span,
    and a health score = mean of the non-zero factors (here the success rate x 100)."""
    n = F.count(F.lit(1))
    span = F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)).cast("double") / 1e6
    rate = F.sum(ok.cast("long")) / n
    return (df.groupBy(F.to_date(F.col(ts)).alias("day"))
            .agg(n.alias("requests"), rate.alias("success_rate"), span.alias("_span"))
            .withColumn("requests_per_second", F.when(F.col("_span") > 0, F.col("requests") / F.col("_span"))
                        .otherwise(F.lit(0.0)))
            .withColumn("health_score", F.when(F.col("success_rate") > 0, F.col("success_rate") * 100.0)
                        .otherwise(F.lit(None).cast("double")))
            .drop("_span"))


def historical_stats(history: DataFrame, groups: DataFrame, key: str = "category") -> DataFrame:
    """Average resolution hours (24 per row when missing, 24.0 for an empty group)
    and SLA success rate (sla_met defaults true; .85 for an empty group), per group.
    ``groups`` lists every group so empty ones get the defaults (left join)."""
    s = history.groupBy(key).agg(
        F.avg(F.coalesce(F.col("resolution_hours"), F.lit(24.0))).alias("avg_resolution_hours"),
        F.avg(F.coalesce(F.col("sla_met"), F.lit(True)).cast("double")).alias("sla_success_rate"))
    return (groups.select(key).distinct().join(s, key, "left")
            .withColumn("avg_resolution_hours", F.coalesce("avg_resolution_hours", F.lit(24.0)))
            .withColumn("sla_success_rate", F.coalesce("sla_success_rate", F.lit(0.85))))


def classification_accuracy(pred: DataFrame, expected: DataFrame, key: str, fields: list[str],
                            group: str | None = None) -> DataFrame:
    """Per-field accuracy and all-correct rate of predictions against labels
    (equi-join on the key; successes only = rows present on both sides)."""
    j = pred.join(expected, key, "inner")
    correct = [(F.col(f) == F.col(f"expected_{f}")) for f in fields]
    aggs = [F.avg(c.cast("double")).alias(f"{f}_accuracy") for f, c in zip(fields, correct)]
    allc = correct[0]
    for c in correct[1:]:
        allc = allc & c
    aggs.append(F.avg(allc.cast("double")).alias("overall_accuracy"))
    aggs.append(F.count(F.lit(1)).alias("evaluated"))
    return j.groupBy(group).agg(*aggs) if group else j.agg(*aggs)


def service_health_scan(tickets: DataFrame) -> DataFrame:
    """Open tickets split into high risk (P1) and the rest; one alert per high."""
    open_ = tickets.filter(F.lower(F.col("status")) == "open")
    high = F.col("priority") == 1
    return open_.agg(F.count(F.lit(1)).alias("open_tickets"),
                     F.sum(high.cast("long")).alias("high_risk"),
                     F.sum((~high).cast("long")).alias("medium_risk"),
                     F.sum(high.cast("long")).alias("alerts"))


def write_priority_index(df: DataFrame, path: str, group: str = "priority", ts: str = "created_at") -> None:
    """E6 (layout): tickets range-partitioned and sorted by (priority, created_at), so a
    lookup by priority reads only matching files and row groups (min/max pruning)."""
    (df.repartitionByRange(group, ts).sortWithinPartitions(group, ts)
     .write.mode("overwrite").parquet(path))
