"""Versioned SLA state: latest version (E2), ordered status-event folding (S4/S5/B33),
missing-state rejects (C7) and expiry (S9).

The fold ``p <- clamp(p + delta, 0, 1)`` is order-dependent, so it is not a plain sum.
Every step is a function ``x -> clamp(x + s, lo, hi)`` and that family is closed under
composition:  g(f(x)) = clamp(x + s1 + s2, clamp(lo1 + s2, lo2, hi2), clamp(hi1 + s2, lo2, hi2)).
So events are range-partitioned by (service, time, id) — a very busy service is split
over several partitions — each partition scans its rows once (Arrow batches in a
pandas function; per segment only the running composition is kept), the few
per-(service, partition) compositions are folded in partition order, and the result is
applied back to every event.  No service is ever collected into one task or one row.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import DEFAULT_AS_OF
from ..functions import rules as R
from ..functions.columns import breach_bucket, sla_status, ts_literal
from ..session import cut_lineage

PROB_DECIMALS = 9  # probabilities are reported (and bucketed) at 1e-9 resolution


def latest_state(state: DataFrame, key: str = "service_id", ts: str = "version_ts",
                 tie: str | None = None, as_of: str | None = None) -> DataFrame:
    """Newest version per key as a ``max_by`` aggregate (partial aggregation, no sort); with ``as_of`` the newest that
    is not later.  (Rows with times of their own: ``asof.as_of_join``.)"""
    if as_of is not None:
        state = state.filter(F.col(ts) <= ts_literal(as_of))
    order = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    cols = [c for c in state.columns if c != key]
    return (state.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_s"))
            .select(key, "_s.*"))


def event_deltas(events: DataFrame) -> DataFrame:
    """(breach probability delta, confidence delta, minutes saved, escalate) per event.
    Unhandled detail types get ``handled = false`` and create no version."""
    dt, st, imp = F.col("detail_type"), F.col("task_status"), F.col("sla_impact")
    ex = F.coalesce(F.col("execution_time"), F.lit(0)).cast("bigint")
    completion = dt == "L1 Task Completion"
    dp = (F.when(completion & (st == "completed") & (imp == "positive"), F.lit(-0.2))
          .when(completion & (st == "completed") & (imp == "neutral"), F.lit(-0.1))
          .when(completion & (st == "partial"), F.lit(-0.05))
          .when(completion & (st == "failed"), F.lit(0.1))
          .when(completion, F.lit(0.0))
          .when(dt == "L1 Task Failed", F.lit(0.1))
          .when(dt == "License Change Completed",
                F.when(F.coalesce(F.col("success"), F.lit(True)), F.lit(-0.05)).otherwise(F.lit(0.15)))
          .when(dt == "Optimization Impact Assessment",
                F.coalesce(F.when(F.col("impact_level") == "low", F.lit(0.02))
                           .when(F.col("impact_level") == "medium", F.lit(0.05))
                           .when(F.col("impact_level") == "high", F.lit(0.1))
                           .when(F.col("impact_level") == "critical", F.lit(0.2)),
                           F.lit(R.OPTIMIZATION_IMPACT_DEFAULT)))
          .when(dt == "L1 Task Started", F.lit(0.0)))
    dconf = (F.when(completion & (st == "completed") & (imp == "positive"), F.lit(0.1))
             .when(completion & (st == "failed"), F.lit(-0.05))
             .when(dt == "L1 Task Failed", F.lit(-0.1))
             .otherwise(F.lit(0.0)))
    saved = (F.when(completion & (st == "completed") & (imp == "positive"), F.greatest(F.lit(15).cast("bigint"), ex * 3))
             .when(completion & (st == "completed") & (imp == "neutral"), ex)
             .when(completion & (st == "partial"), F.floor(ex / 2).cast("bigint"))
             .otherwise(F.lit(0).cast("bigint")))
    if "impact_level" not in events.columns:
        events = events.withColumn("impact_level", F.lit(None).cast("string"))
    return (events.withColumn("delta_p", dp)
            .withColumn("delta_confidence", dconf)
            .withColumn("time_saved", saved)
            .withColumn("escalation_recommended", dt == "L1 Task Failed")
            .withColumn("handled", dp.isNotNull()))


_SCAN_SCHEMA = T.StructType([
    T.StructField("service_id", T.LongType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("event_ts", T.TimestampNTZType()),
    T.StructField("detail_type", T.StringType()),
    T.StructField("_part", T.IntegerType()),
    T.StructField("_s", T.DoubleType()),
    T.StructField("_lo", T.DoubleType()),
    T.StructField("_hi", T.DoubleType()),
    T.StructField("_t", T.DoubleType()),
    T.StructField("_n", T.LongType()),
])


def _segment_scan(batches):
    """Per partition (rows sorted by service, time, id): running composition of the
    clamp steps inside each (service, partition) segment.  Only the running state of
    the current segment is kept, carried across Arrow batches."""
    cur, lo, hi, s, t, n = None, 0.0, 1.0, 0.0, 0.0, 0
    clamp = lambda a, d: min(max(a + d, 0.0), 1.0)
    for pdf in batches:
        if pdf.empty:
            continue
        svc = pdf["service_id"].to_numpy()
        d = pdf["delta_p"].to_numpy(dtype=float)
        ts = pdf["time_saved"].to_numpy(dtype=float)
        out_s, out_lo, out_hi, out_t = (np.empty(len(pdf)) for _ in range(4))
        out_n = np.empty(len(pdf), dtype=np.int64)
        # segment boundaries inside this batch
        starts = np.flatnonzero(np.r_[True, svc[1:] != svc[:-1]])
        ends = np.r_[starts[1:], len(pdf)]
        for a, b in zip(starts, ends):
            if svc[a] != cur:  # a new segment starts: identity composition
                cur, lo, hi, s, t, n = svc[a], None, None, 0.0, 0.0, 0
            seg_d = d[a:b]
            if lo is None:  # first step of the segment maps (-inf, +inf) to (0, 1)
                lo_run = list(accumulate(seg_d[1:], clamp, initial=0.0))
                hi_run = list(accumulate(seg_d[1:], clamp, initial=1.0))
            else:
                lo_run = list(accumulate(seg_d, clamp, initial=lo))[1:]
                hi_run = list(accumulate(seg_d, clamp, initial=hi))[1:]
            out_lo[a:b], out_hi[a:b] = lo_run, hi_run
            out_s[a:b] = s + np.cumsum(seg_d)
            out_t[a:b] = t + np.cumsum(ts[a:b])
            out_n[a:b] = n + np.arange(1, b - a + 1)
            lo, hi, s, t, n = lo_run[-1], hi_run[-1], out_s[b - 1], out_t[b - 1], int(out_n[b - 1])
        yield pd.DataFrame({"service_id": svc.astype(np.int64), "event_id": pdf["event_id"].to_numpy(np.int64),
                            "event_ts": pdf["event_ts"], "detail_type": pdf["detail_type"],
                            "_part": pdf["_part"].to_numpy(np.int32), "_s": out_s, "_lo": out_lo, "_hi": out_hi,
                            "_t": out_t, "_n": out_n})


def _segment_ends(batches):
    """The last row of every (service, partition) segment of ``_segment_scan``."""
    held = None
    for pdf in _segment_scan(batches):
        svc = pdf["service_id"].to_numpy()
        if held is not None and held["service_id"].iloc[0] != svc[0]:
            yield held
        ends = pdf[np.r_[svc[1:] != svc[:-1], True]]
        if len(ends) > 1:
            yield ends.iloc[:-1]
        held = ends.iloc[-1:]
    if held is not None:
        yield held


def _clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


def _ordered(events: DataFrame, n: int) -> DataFrame:
    """Handled events with their deltas, range-partitioned and sorted by (service, time, id)."""
    # events may come with their deltas already computed (delta_p, time_saved)
    if {"delta_p", "time_saved"} <= set(events.columns):
        with_d = events.withColumn("handled", F.col("delta_p").isNotNull())
        if "detail_type" not in events.columns:
            with_d = with_d.withColumn("detail_type", F.lit("adjustment"))
    else:
        with_d = event_deltas(events)
    ev = with_d.filter(F.col("handled")).select(
        "service_id", "event_id", "event_ts", "detail_type", "delta_p", F.col("time_saved").cast("double"))
    order = [F.col("service_id"), F.col("event_ts"), F.col("event_id")]
    ranged = (ev.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id()))
    return ranged


def apply_status_events(state: DataFrame, events: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """S4 (batch): one new state version per handled event, applied in (event_ts,
    event_id) order on top of the latest prior version of its service.  Events of
    services without prior state are dropped (see ``missing_state`` for the rejects).

    Returns service_id, event_id, detail_type, version_ts, update_seq,
    breach_probability, breach_bucket, sla_status, response_remaining,
    resolution_remaining.
    """
    spark = events.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    latest = latest_state(state).select(
        "service_id", F.col("breach_probability").alias("_p0"),
        F.col("response_remaining").alias("_r0"), F.col("resolution_remaining").alias("_q0"))
    ranged = _ordered(events, n)
    scanned = ranged.select("service_id", "event_id", "event_ts", "detail_type", "_part", "delta_p", "time_saved") \
        .mapInPandas(_segment_scan, _SCAN_SCHEMA)
    # Freeze partition ids (AQE may re-plan a recomputation) and cut the lineage.
    scanned = cut_lineage(scanned)

    # one composition per (service, partition): the last row of the segment
    seg = scanned.groupBy("service_id", "_part").agg(
        F.max_by(F.struct("_s", "_lo", "_hi", "_t", "_n"), F.col("_n")).alias("c"))
    seg_list = seg.groupBy("service_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_part"), F.col("c")))).alias("segs"))  # <= n entries
    init = F.struct(F.col("_p0").alias("p"), F.lit(0.0).alias("t"), F.lit(0).cast("bigint").alias("k"),
                    F.array().cast("array<struct<_part:int,p_in:double,t_in:double,k_in:bigint>>").alias("out"))

    def step(acc, x):
        c = x["c"]
        return F.struct(
            _clamp(acc["p"] + c["_s"], c["_lo"], c["_hi"]).alias("p"),
            (acc["t"] + c["_t"]).alias("t"),
            (acc["k"] + c["_n"]).alias("k"),
            F.array_append(acc["out"], F.struct(x["_part"].alias("_part"), acc["p"].alias("p_in"),
                                                acc["t"].alias("t_in"), acc["k"].alias("k_in"))).alias("out"))

    seg_in = (seg_list.join(latest, "service_id", "inner")
              .select("service_id", "_r0", "_q0", F.explode(F.aggregate("segs", init, step)["out"]).alias("o"))
              .select("service_id", "_r0", "_q0", "o.*"))
    applied = scanned.join(seg_in, ["service_id", "_part"], "inner")
    p = F.round(_clamp(F.col("p_in") + F.col("_s"), F.col("_lo"), F.col("_hi")), PROB_DECIMALS)
    versions = applied.select(
        "service_id", "event_id", "detail_type", F.col("event_ts").alias("version_ts"),
        (F.col("k_in") + F.col("_n")).alias("update_seq"),
        p.alias("breach_probability"),
        (F.col("_r0") + F.col("t_in") + F.col("_t")).alias("response_remaining"),
        (F.col("_q0") + F.col("t_in") + F.col("_t")).alias("resolution_remaining"))
    return (versions
            .withColumn("breach_bucket", breach_bucket(F.col("breach_probability")))
            .withColumn("sla_status", sla_status(F.col("breach_probability"))))


def latest_after_events(state: DataFrame, events: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """E2 + S4 without the versions in between: the latest state of every service of ``state`` after ``events``.

    The composed step of each (service, partition) segment is all that leaves the ordered scan, so what
    is grouped afterwards has a row per service, plus one per partition that a service spans; nothing is
    written or joined per event."""
    n = num_partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    latest = latest_state(state).select(
        "service_id", F.col("breach_probability").alias("_p0"), F.col("response_remaining").alias("_r0"),
        F.col("resolution_remaining").alias("_q0"), F.col("version_ts").alias("_v0"))
    ends = _ordered(events, n).select("service_id", "event_id", "event_ts", "detail_type", "_part", "delta_p", "time_saved") \
        .mapInPandas(_segment_ends, _SCAN_SCHEMA)
    segments = ends.groupBy("service_id").agg(
        F.array_sort(F.collect_list(F.struct("_part", "_s", "_lo", "_hi", "_t", "_n"))).alias("segs"),
        F.max("event_ts").alias("_v"))
    joined = latest.join(segments, "service_id", "left")
    start = F.struct(F.col("_p0").alias("p"), F.lit(0.0).alias("t"), F.lit(0).cast("bigint").alias("k"))
    end = F.aggregate("segs", start, lambda a, x: F.struct(
        _clamp(a["p"] + x["_s"], x["_lo"], x["_hi"]).alias("p"), (a["t"] + x["_t"]).alias("t"), (a["k"] + x["_n"]).alias("k")))
    # events older than the prior state do not make a later version
    moved = F.coalesce(F.col("_v") >= F.col("_v0"), F.lit(False))
    out = joined.select("service_id", moved.alias("_m"), end.alias("_e"), "_p0", "_r0", "_q0", "_v0", "_v")
    pick = lambda new, old: F.when(F.col("_m"), new).otherwise(old)
    p = pick(F.round("_e.p", PROB_DECIMALS), F.col("_p0"))
    return out.select(
        "service_id", pick(F.col("_e.k"), F.lit(0).cast("bigint")).alias("update_seq"), p.alias("breach_probability"),
        pick(F.col("_r0") + F.col("_e.t"), F.col("_r0")).alias("response_remaining"),
        pick(F.col("_q0") + F.col("_e.t"), F.col("_q0")).alias("resolution_remaining"),
        pick(F.col("_v"), F.col("_v0")).alias("version_ts"),
        breach_bucket(p).alias("breach_bucket"), sla_status(p).alias("sla_status"))


def missing_state(state: DataFrame, events: DataFrame) -> DataFrame:
    """C7 rejects: handled events whose service has no prior state."""
    return (event_deltas(events).filter(F.col("handled"))
            .join(state.select("service_id").distinct(), "service_id", "left_anti"))


def all_versions(state: DataFrame, versions: DataFrame) -> DataFrame:
    """Initial versions (update_seq 0) plus the folded ones, one schema."""
    base = state.select("service_id", F.lit(None).cast("bigint").alias("event_id"),
                        F.lit(0).cast("bigint").alias("update_seq"), "breach_probability",
                        "response_remaining", "resolution_remaining",
                        F.lit("initial").alias("detail_type"), "version_ts")
    v = versions.select("service_id", "event_id", "update_seq", "breach_probability", "response_remaining",
                        "resolution_remaining", "detail_type", "version_ts")
    return (base.unionByName(v)
            .withColumn("breach_bucket", breach_bucket(F.col("breach_probability")))
            .withColumn("sla_status", sla_status(F.col("breach_probability"))))


def versioned(scored: DataFrame, as_of: str = DEFAULT_AS_OF, days: int = 90) -> DataFrame:
    """Scored rows as state versions: the time of the version and when it expires."""
    now = ts_literal(as_of)
    return scored.withColumns({"version_ts": now, "expire_at": now + F.make_interval(days=F.lit(days))})


def expire_state(versions: DataFrame, as_of: str = DEFAULT_AS_OF, ts: str = "version_ts",
                 ttl_days: int = R.STATE_TTL_DAYS) -> DataFrame:
    """expiry = version time + 90 days; keep versions not yet expired."""
    return versions.withColumn("expire_at", expires_at(ts, ttl_days)).filter(F.col("expire_at") > ts_literal(as_of))


def expires_at(ts: str = "version_ts", ttl_days: int = R.STATE_TTL_DAYS) -> Column:
    return F.col(ts) + F.make_interval(days=F.lit(ttl_days))


def not_expired(as_of: str = DEFAULT_AS_OF, ts: str = "version_ts", ttl_days: int = R.STATE_TTL_DAYS) -> Column:
    """The filter of ``expire_state``, for a compaction."""
    return expires_at(ts, ttl_days) > ts_literal(as_of)
