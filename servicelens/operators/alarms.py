"""Windowed metrics and alarms (S6, E5/S7), event rules and routing (B26, S10),
device heartbeats (S11).

Tumbling windows are ``window()`` aggregates (partial aggregation per task).  Alarm
evaluation needs "N consecutive periods in breach", where a missing period is not a
breach; it is computed by equi-aggregation (see ``evaluate_alarms``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_AS_OF
from ..functions.columns import minutes_between, present, ts_literal

# FIXED VALUES — alarm definitions: (name, metric, period seconds, statistic,
# evaluation periods, threshold, comparison)
ALARMS = [
    ("error-events", "HighRiskTickets", 300, "Sum", 2, 5.0, ">"),
    ("throttled-actions", "ActionsTriggered", 300, "Sum", 2, 0.0, ">"),
    ("high-breach-rate", "HighRiskTickets", 300, "Sum", 1, 10.0, ">"),
    ("slow-responses", "ResponseTimeMs", 300, "Average", 2, 45000.0, ">"),
    ("prediction-accuracy", "SLACompliance", 3600, "Average", 1, 0.8, "<"),
]


def alarm_table(spark) -> DataFrame:
    """The alarm definitions as a DataFrame (five rows; bounded by construction)."""
    return spark.createDataFrame(
        ALARMS, "alarm_name string, metric string, period_s int, statistic string, evaluation_periods int, "
                "threshold double, comparison string")


def windowed_metrics(points: DataFrame, period_s: int, ts: str = "ts") -> DataFrame:
    """Tumbling-window Sum / Average / count per metric (``window()``; also used by
    the streaming job, where it is evaluated with a watermark)."""
    w = F.window(F.col(ts), f"{period_s} seconds")
    return (points.groupBy("namespace", "metric", w.alias("w"))
            .agg(F.sum("value").alias("sum"), F.avg("value").alias("average"), F.count(F.lit(1)).alias("samples"))
            .select("namespace", "metric", F.col("w.start").alias("window_start"), "sum", "average", "samples"))


EPOCH = "1970-01-01 00:00:00"


def window_start(ts: Column, period_s: int) -> Column:
    """Start of the epoch-aligned tumbling window of ``period_s`` seconds (same
    boundaries as ``window()``), as plain arithmetic so it can sit inside arrays."""
    epoch = F.lit(EPOCH).cast("timestamp_ntz")
    secs = F.floor(F.timestamp_diff("MICROSECOND", epoch, ts) / F.lit(period_s * 1_000_000)) * period_s
    return epoch + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))


def multi_period_windows(points: DataFrame, periods: list[int], metrics: list[str] | None = None,
                         ts: str = "ts") -> DataFrame:
    """All tumbling windows of several periods in ONE aggregation: each point is
    assigned to one window per period (explode of a tiny array), then a single
    partial+final aggregate over (metric, period, window start)."""
    pts = points.filter(F.col("metric").isin(*metrics)) if metrics else points
    slots = F.array(*[F.struct(F.lit(p).alias("period_s"), window_start(F.col(ts), p).alias("window_start"))
                      for p in periods])
    return (pts.select("metric", "value", F.explode(slots).alias("_w"))
            .groupBy("metric", "_w.period_s", "_w.window_start")
            .agg(F.sum("value").alias("sum"), F.avg("value").alias("average"), F.count(F.lit(1)).alias("samples")))


def evaluate_alarms(points: DataFrame, alarms=ALARMS, ts: str = "ts") -> DataFrame:
    """E5 over raw metric points: one windowing pass for every period the alarms use,
    then ``evaluate_windows``.  The points are scanned once whatever the number of alarms."""
    windows = multi_period_windows(points, sorted({a[2] for a in alarms}), sorted({a[1] for a in alarms}), ts)
    return evaluate_windows(windows, alarms)


def evaluate_windows(windows: DataFrame, alarms=ALARMS) -> DataFrame:
    """E5/S7 over window statistics (metric, period_s, window_start, sum, average):
    per alarm and window the statistic, the breaching flag and the state.

    The alarm definitions (a few rows, bounded by construction) are broadcast-joined
    to the windows on (metric, period).  ALARM when this period and the
    ``evaluation_periods - 1`` periods before it all breach: instead of an ordered
    frame (one task per alarm), every window sends its breach flag to itself and the
    next N-1 periods, and a window is in ALARM when N breaching flags arrive.  Periods
    without data send nothing, so a gap is never a breach.  One equi-aggregation, one
    pass over the windows."""
    spark = windows.sparkSession
    defs = F.broadcast(spark.createDataFrame(
        list(alarms), "alarm_name string, metric string, period_s int, statistic string, "
                      "evaluation_periods int, threshold double, comparison string"))
    value = F.when(F.col("statistic") == "Sum", F.col("sum")).otherwise(F.col("average"))
    breach = F.when(F.col("comparison") == ">", F.col("value") > F.col("threshold")) \
        .otherwise(F.col("value") < F.col("threshold"))
    g = (windows.join(defs, ["metric", "period_s"])
         .withColumn("value", value)
         .withColumn("breaching", F.coalesce(breach, F.lit(False)))
         .select("alarm_name", "window_start", "period_s", "evaluation_periods", "value", "breaching"))
    # every window sends its breach flag to itself (j = 0) and the next N-1 periods;
    # one aggregation per (alarm, target window) then sees the N windows ending there
    sent = g.select("alarm_name", "value", "breaching", "evaluation_periods", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("evaluation_periods") - 1),
        lambda j: F.struct(j.alias("j"), (F.col("window_start")
                                          + F.make_dt_interval(secs=(j * F.col("period_s")).cast("decimal(18,6)")))
                           .alias("target")))).alias("_v"))
    agg = (sent.groupBy("alarm_name", F.col("_v.target").alias("window_start"))
           .agg(F.sum(F.col("breaching").cast("int")).alias("_votes"),
                F.max((F.col("_v.j") == 0).cast("int")).alias("_self"),
                F.max(F.when(F.col("_v.j") == 0, F.col("value"))).alias("value"),
                F.max(F.when(F.col("_v.j") == 0, F.col("breaching").cast("int"))).alias("_b"),
                F.max("evaluation_periods").alias("_n")))
    return (agg.filter(F.col("_self") == 1)
            .select("alarm_name", "window_start", "value", (F.col("_b") == 1).alias("breaching"),
                    F.when(F.col("_votes") == F.col("_n"), F.lit("ALARM")).otherwise(F.lit("OK")).alias("alarm_state")))


def alarm_transitions(windows: DataFrame, alarms=ALARMS) -> DataFrame:
    """Where the state of an alarm changes: ``alarm_name``, ``window_start`` (first period of the new state),
    ``alarm_state``.  An alarm begins in OK; a period without data is OK.

    A period in ALARM says so for itself and asks for OK at the next one; where both meet nothing changes.  One more
    equi-aggregation, no ordered frame."""
    defs = F.broadcast(windows.sparkSession.createDataFrame([(a[0], a[2]) for a in alarms], "alarm_name string, _period int"))
    on = evaluate_windows(windows, alarms).filter("alarm_state = 'ALARM'").join(defs, "alarm_name")
    after = F.col("window_start") + F.make_dt_interval(secs=F.col("_period").cast("decimal(18,6)"))
    sent = on.select("alarm_name", F.explode(F.array(
        F.struct(F.col("window_start").alias("at"), F.lit(1).alias("on")), F.struct(after.alias("at"), F.lit(0).alias("on")))).alias("_t"))
    return (sent.groupBy("alarm_name", F.col("_t.at").alias("window_start")).agg(F.min("_t.on").alias("lo"), F.max("_t.on").alias("hi"))
            .filter("lo = hi").select("alarm_name", "window_start", F.when(F.col("hi") == 1, "ALARM").otherwise("OK").alias("alarm_state")))


# ---------------------------------------------------------------------------
# Event rules (B26) and routing
# ---------------------------------------------------------------------------

# FIXED VALUES — declarative bus rules: (rule, sources or None, detail types or None,
# field that must exist or None, (numeric field, minimum) or None, priorities or None)
EVENT_RULES = [
    ("breach-prediction-trigger", ["sla-monitor"], ["Metric Update"], None, None, None),
    ("sla-to-l1-trigger", ["sla-monitor"], ["SLA Breach Prediction"], "breach_probability", None, None),
    ("all-events-to-dashboard", ["sla-monitor", "l1-automation", "asset-optimizer"], None, None, None, None),
    ("high-risk-forward", ["sla-monitor"], ["SLA Breach Prediction"], None, ("breach_probability", 0.4), None),
    ("priority-tickets", None, ["Ticket Created"], None, None, ["P1", "P2"]),
]


def _rule_predicate(rule) -> Column:
    _, sources, types, exists, numeric, prios = rule
    cond = F.lit(True)
    if sources:
        cond = cond & F.col("source").isin(*sources)
    if types:
        cond = cond & F.col("detail_type").isin(*types)
    if exists:
        cond = cond & F.get_json_object("detail", f"$.{exists}").isNotNull()
    if numeric:
        field, lo = numeric
        cond = cond & (F.get_json_object("detail", f"$.{field}").cast("double") > lo)
    if prios:
        cond = cond & F.get_json_object("detail", "$.priority").isin(*prios)
    return F.coalesce(cond, F.lit(False))


def route_events(events: DataFrame, rules=EVENT_RULES) -> DataFrame:
    """B26 + S10: one row per (event, matching rule); the rules compile to native
    predicates (no join), so filters stay inside whole-stage codegen."""
    matched = present([(_rule_predicate(r), F.lit(r[0])) for r in rules])
    return events.withColumn("rule", F.explode_outer(matched)).filter(F.col("rule").isNotNull())


# ---------------------------------------------------------------------------
# Device heartbeats
# ---------------------------------------------------------------------------

def heartbeat_status(beats: DataFrame, as_of: str = DEFAULT_AS_OF, device: str = "device_id",
                     ts: str = "ts", warn_after: float = 30.0, down_after: float = 60.0) -> DataFrame:
    """Last heartbeat per device (max aggregate) -> OK / WARN / DOWN by age in minutes.
    The cut-offs are inferred from sample rows (1 min OK, 32 min WARN, > 60 min DOWN)."""
    last = beats.groupBy(device).agg(F.max(ts).alias("last_seen"))
    age = minutes_between(F.col("last_seen"), ts_literal(as_of))
    return (last.withColumn("age_minutes", age)
            .withColumn("health", F.when(F.col("age_minutes") > down_after, F.lit("DOWN"))
                        .when(F.col("age_minutes") > warn_after, F.lit("WARN")).otherwise(F.lit("OK"))))


def heartbeat_ticket_columns(status: DataFrame, as_of: str = DEFAULT_AS_OF, device: str = "device_id") -> DataFrame:
    """Every device with the fields of its 'Infra' P2 ticket, due four hours after ``as_of``; null unless it is DOWN."""
    down = F.col("health") == "DOWN"
    due = ts_literal(as_of) + F.make_dt_interval(F.lit(0), F.lit(4))
    fields = {"ticket_id": F.concat(F.lit("INFRA-"), F.col(device).cast("string")), "department": F.lit("Infra"),
              "priority": F.lit("P2"), "sla_deadline": due}
    return status.withColumns({k: F.when(down, v) for k, v in fields.items()})


def heartbeat_tickets(status: DataFrame, as_of: str = DEFAULT_AS_OF, device: str = "device_id") -> DataFrame:
    """The tickets of the DOWN devices."""
    return heartbeat_ticket_columns(status, as_of, device).filter(F.col("health") == "DOWN")
