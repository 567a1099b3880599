"""Registered queries: windows, alarms, routing, heartbeats and KPI roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.columns import fmt_ts
from ..operators import alarms as A
from ..operators import impact as I
from ..operators import kpi as K
from ..operators import scoring
from ..operators import text as T
from ..operators.util import with_scalars
from ..sources import fixtures as fx
from ..sources.tables import read_table
from . import sqlfix as S
from .q_state import _ASSET_SQL, _CR_SQL
from .registry import query


@query("windowed_metrics_5m", oracle=f"""
WITH {S.METRIC_POINTS}
SELECT metric, {S.ts("time_bucket(INTERVAL 5 MINUTE, ts)")} AS window_start, round(sum(value), 6) AS sum_value,
  round(avg(value), 9) AS avg_value, count(*) AS samples
FROM mp GROUP BY metric, time_bucket(INTERVAL 5 MINUTE, ts)
""")
def q_windowed(spark, sf_dir):
    w = A.windowed_metrics(fx.metric_points(spark, sf_dir), 300)
    return w.select("metric", fmt_ts("window_start").alias("window_start"), F.round("sum", 6).alias("sum_value"),
                    F.round("average", 9).alias("avg_value"), "samples")


@query("alarm_states", oracle=f"""
WITH {S.METRIC_POINTS},
w5 AS (SELECT metric, time_bucket(INTERVAL 5 MINUTE, ts) AS ws, sum(value) AS s, avg(value) AS a
       FROM mp GROUP BY metric, time_bucket(INTERVAL 5 MINUTE, ts)),
w60 AS (SELECT metric, time_bucket(INTERVAL 1 HOUR, ts) AS ws, sum(value) AS s, avg(value) AS a
        FROM mp GROUP BY metric, time_bucket(INTERVAL 1 HOUR, ts)),
al AS (
  SELECT 'error-events' AS alarm_name, ws, s AS value, s > 5.0 AS breaching, 2 AS n, 300 AS p
    FROM w5 WHERE metric = 'HighRiskTickets'
  UNION ALL SELECT 'throttled-actions', ws, s, s > 0.0, 2, 300 FROM w5 WHERE metric = 'ActionsTriggered'
  UNION ALL SELECT 'high-breach-rate', ws, s, s > 10.0, 1, 300 FROM w5 WHERE metric = 'HighRiskTickets'
  UNION ALL SELECT 'slow-responses', ws, a, a > 45000.0, 2, 300 FROM w5 WHERE metric = 'ResponseTimeMs'
  UNION ALL SELECT 'prediction-accuracy', ws, a, a < 0.8, 1, 3600 FROM w60 WHERE metric = 'SLACompliance'
)
SELECT alarm_name, {S.ts('ws')} AS window_start, round(value, 9) AS value, breaching,
  CASE WHEN (SELECT count(*) FROM al b WHERE b.alarm_name = a.alarm_name AND b.breaching
             AND b.ws > a.ws - to_seconds(CAST(a.n * a.p AS BIGINT)) AND b.ws <= a.ws) = a.n THEN 'ALARM' ELSE 'OK' END
    AS alarm_state
FROM al a
""")
def q_alarm_states(spark, sf_dir):
    a = A.evaluate_alarms(fx.metric_points(spark, sf_dir))
    return a.select("alarm_name", fmt_ts("window_start").alias("window_start"), F.round("value", 9).alias("value"),
                    "breaching", "alarm_state")


@query("event_routes", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}, {S.TEXT_TICKETS},
cp AS (SELECT {S.first_match('lt', R.PRIORITY_CHAT, 'P3')} AS priority FROM tl),
n AS (
  SELECT (SELECT count(*) FROM scored) AS n_metric,
         (SELECT count(*) FROM scored WHERE breach_probability > 0.4) AS n_pred,
         (SELECT count(*) FROM events WHERE event_type IN ('purchase', 'click', 'view', 'error', 'signup')) AS n_status,
         (SELECT count(*) FROM cp WHERE priority IN ('P1', 'P2')) AS n_prio
)
SELECT 'breach-prediction-trigger' AS rule, n_metric AS events FROM n
UNION ALL SELECT 'sla-to-l1-trigger', n_pred FROM n WHERE n_pred > 0
UNION ALL SELECT 'all-events-to-dashboard', n_metric + n_pred + n_status FROM n
UNION ALL SELECT 'high-risk-forward', n_pred FROM n WHERE n_pred > 0
UNION ALL SELECT 'priority-tickets', n_prio FROM n WHERE n_prio > 0
""")
def q_event_routes(spark, sf_dir):
    r = A.route_events(fx.bus_events(spark, sf_dir))
    return r.groupBy("rule").agg(F.count(F.lit(1)).alias("events"))


_HB_AS_OF = "2024-01-31 00:00:00"


@query("heartbeat_tickets", oracle=f"""
WITH last AS (SELECT user_id AS device_id, max(ts) AS last_seen FROM events GROUP BY user_id),
h AS (
  SELECT device_id,
    CAST(epoch_us(TIMESTAMP '{_HB_AS_OF}') - epoch_us(last_seen) AS DOUBLE) / 60000000.0::DOUBLE AS age_minutes
  FROM last
)
SELECT device_id, age_minutes,
  CASE WHEN age_minutes > 60 THEN 'DOWN' WHEN age_minutes > 30 THEN 'WARN' ELSE 'OK' END AS health,
  CASE WHEN age_minutes > 60 THEN 'INFRA-' || CAST(device_id AS VARCHAR) END AS ticket_id,
  CASE WHEN age_minutes > 60 THEN {S.ts(f"TIMESTAMP '{_HB_AS_OF}' + INTERVAL 4 HOUR")} END AS sla_deadline
FROM h
""")
def q_heartbeat(spark, sf_dir):
    beats = read_table(spark, sf_dir, "events", ["user_id", "ts"]).withColumnRenamed("user_id", "device_id")
    st = A.heartbeat_ticket_columns(A.heartbeat_status(beats, as_of=_HB_AS_OF), as_of=_HB_AS_OF)
    return st.select("device_id", "age_minutes", "health", "ticket_id", fmt_ts("sla_deadline").alias("sla_deadline"))


@query("daily_report", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day, count(*) AS tickets,
  round(count(*) FILTER (WHERE NOT breach_probability >= 0.7) * 100.0 / count(*), 6) AS compliance_pct,
  count(*) FILTER (WHERE breach_probability >= 0.7) AS breaches_prevented,
  round(sum(CASE WHEN breach_probability >= 0.7 THEN revenue_impact ELSE 0.0 END), 2) AS revenue_protected
FROM scored GROUP BY CAST(created_at AS DATE)
""")
def q_daily_report(spark, sf_dir):
    d = K.daily_report(scoring.sla_metrics(fx.tickets(spark, sf_dir)))
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "tickets",
                    F.round("compliance_pct", 6).alias("compliance_pct"), "breaches_prevented",
                    F.round("revenue_protected", 2).alias("revenue_protected"))


@query("latency_stats", oracle="""
SELECT event_type, count(value) AS samples, round(avg(value), 6) AS avg_response_time,
  round(median(value), 6) AS median_response_time, min(value) AS min_response_time, max(value) AS max_response_time,
  round(CASE WHEN count(value) > 1 THEN stddev_samp(value) ELSE 0.0 END, 6) AS std_dev
FROM events GROUP BY event_type
""")
def q_latency_stats(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", ["event_id", "event_type", "value"])
    s = K.latency_stats(e, "event_type", "value", tiebreak="event_id")
    return s.select("event_type", "samples", *[F.round(c, 6).alias(c) for c in
                                               ["avg_response_time", "median_response_time"]],
                    "min_response_time", "max_response_time", F.round("std_dev", 6).alias("std_dev"))


@query("throughput_summary", oracle="""
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS requests,
  round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS success_rate,
  round(CASE WHEN epoch_us(max(ts)) - epoch_us(min(ts)) > 0
             THEN count(*) / (CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6) ELSE 0.0 END, 6)
    AS requests_per_second,
  round(CASE WHEN count(*) FILTER (WHERE event_type <> 'error') > 0
             THEN count(*) FILTER (WHERE event_type <> 'error') / count(*) * 100.0 END, 6) AS health_score
FROM events GROUP BY CAST(ts AS DATE)
""")
def q_throughput(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", ["event_type", "ts"])
    t = K.throughput(e, "ts", F.col("event_type") != "error")
    return t.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "requests",
                    *[F.round(c, 6).alias(c) for c in ["success_rate", "requests_per_second", "health_score"]])


@query("historical_stats", oracle=f"""
WITH {S.TICKETS}, {S.SCORED},
h AS (SELECT category, avg(elapsed_minutes / 60.0::DOUBLE) AS r,
             avg(CASE WHEN elapsed_minutes <= resolution_threshold THEN 1.0 ELSE 0.0 END) AS s
      FROM scored WHERE status = 'resolved' GROUP BY category),
g AS (SELECT DISTINCT category FROM scored)
SELECT g.category, round(coalesce(h.r, 24.0), 6) AS avg_resolution_hours, round(coalesce(h.s, 0.85), 6)
  AS sla_success_rate
FROM g LEFT JOIN h USING (category)
""")
def q_historical_stats(spark, sf_dir):
    s = scoring.sla_metrics(fx.tickets(spark, sf_dir))
    hist = s.filter(F.col("status") == "resolved").select(
        "category", (F.col("elapsed_minutes") / 60.0).alias("resolution_hours"),
        (F.col("elapsed_minutes") <= F.col("resolution_threshold")).alias("sla_met"))
    h = K.historical_stats(hist, s)
    return h.select("category", F.round("avg_resolution_hours", 6).alias("avg_resolution_hours"),
                    F.round("sla_success_rate", 6).alias("sla_success_rate"))


@query("classification_accuracy", oracle=f"""
WITH {S.TEXT_TICKETS},
p AS (
  SELECT id, lang, {S.scored_match('lt', R.DEPARTMENT_SCORED_CHAT, 'MPOnline')}
           AS department,
         {S.first_match('lt', R.PRIORITY_CHAT, 'P3')} AS priority
  FROM tl
),
e AS (
  SELECT doc_id AS id,
    ({'[' + ', '.join(repr(a) for a, _ in fx.EXPECTED_LABELS) + ']'})[doc_id % 16 + 1] AS expected_department,
    ({'[' + ', '.join(repr(b) for _, b in fx.EXPECTED_LABELS) + ']'})[doc_id % 16 + 1] AS expected_priority
  FROM documents
)
SELECT lang, round(avg(CASE WHEN department = expected_department THEN 1.0 ELSE 0.0 END), 6) AS department_accuracy,
  round(avg(CASE WHEN priority = expected_priority THEN 1.0 ELSE 0.0 END), 6) AS priority_accuracy,
  round(avg(CASE WHEN department = expected_department AND priority = expected_priority THEN 1.0 ELSE 0.0 END), 6)
    AS overall_accuracy,
  count(*) AS evaluated
FROM p JOIN e USING (id) GROUP BY lang
""")
def q_classification_accuracy(spark, sf_dir):
    pred = T.analyze_chat(fx.text_tickets(spark, sf_dir)).select("id", "lang", "department", "priority")
    acc = K.classification_accuracy(pred, fx.expected_labels(spark, sf_dir), "id", ["department", "priority"],
                                    group="lang")
    return acc.select("lang", *[F.round(c, 6).alias(c) for c in
                                ["department_accuracy", "priority_accuracy", "overall_accuracy"]], "evaluated")


@query("service_health_scan", oracle=f"""
WITH {S.TICKETS}
SELECT count(*) AS open_tickets, count(*) FILTER (WHERE priority = 1) AS high_risk,
  count(*) FILTER (WHERE priority <> 1) AS medium_risk, count(*) FILTER (WHERE priority = 1) AS alerts
FROM tickets WHERE lower(status) = 'open'
""")
def q_service_health(spark, sf_dir):
    return K.service_health_scan(fx.tickets(spark, sf_dir))


@query("dashboard_kpis", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}, {_ASSET_SQL}, {_CR_SQL},
g AS (
  SELECT optimization_id, any_value(potential_savings) AS potential_savings,
    count(*) FILTER (WHERE alevel = 'high') AS hi, count(*) FILTER (WHERE alevel = 'medium') AS me
  FROM per_asset GROUP BY optimization_id
),
dec AS (
  SELECT potential_savings, CASE WHEN hi > 0 THEN false WHEN me > 3 THEN potential_savings > 100000 ELSE true END AS ok
  FROM g
)
SELECT
  (SELECT round(avg(CASE WHEN event_type IN ('purchase', 'click') THEN 1.0 ELSE 0.0 END), 6) FROM events
     WHERE event_type IN ('purchase', 'click', 'view')) AS l1_success_rate,
  (SELECT round(sum(potential_savings), 2) FROM dec WHERE ok) AS total_actual_savings,
  (SELECT round(avg(CASE WHEN breach_probability >= 0.7 THEN 0.0 ELSE 1.0 END), 6) FROM scored) AS sla_compliance
""")
def q_dashboard_kpis(spark, sf_dir):
    st = fx.status_events(spark, sf_dir).filter(F.col("detail_type") == "L1 Task Completion")
    l1 = st.agg(F.round(F.avg((F.col("task_status") == "completed").cast("double")), 6).alias("l1_success_rate"))
    scored = scoring.sla_metrics(fx.tickets(spark, sf_dir))
    requests = fx.change_requests(spark, sf_dir)
    dec = I.optimization_decisions(requests, I.asset_sla_status(scored, I.requested_assets(requests)))
    sav = dec.agg(F.round(F.sum(F.when(F.col("approved"), F.col("potential_savings"))), 2).alias("total_actual_savings"))
    comp = scored.agg(F.round(F.avg((~F.col("sla_status").isin("AT_RISK", "BREACH_IMMINENT")).cast("double")), 6)
                      .alias("sla_compliance"))
    return with_scalars(with_scalars(l1, sav), comp)
