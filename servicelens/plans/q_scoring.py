"""Registered queries: SLA scoring, prediction, actions, queues and KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.columns import fmt_ts, r6
from ..operators import kpi, rescoring, scoring
from ..operators.util import with_scalars
from ..sources import fixtures as fx
from ..sources import ingest as IN
from . import sqlfix as S
from .registry import query

# ---------------------------------------------------------------------------
# B1/B2/C1 — flagship
# ---------------------------------------------------------------------------

SLA_COLS = ["ticket_id", "priority", "status", "category"]


@query("sla_scoring", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}
SELECT ticket_id, priority, status, category, {S.ts('created_at')} AS created_at,
       elapsed_minutes AS elapsed_minutes,
       response_threshold AS response_threshold,
       resolution_threshold AS resolution_threshold,
       response_remaining AS response_remaining,
       resolution_remaining AS resolution_remaining,
       response_risk AS response_risk,
       resolution_risk AS resolution_risk,
       breach_probability AS breach_probability,
       {S.bucket('breach_probability')} AS breach_bucket,
       {S.status('breach_probability')} AS sla_status
FROM scored
""")
def q_sla_scoring(spark, sf_dir):
    s = scoring.sla_metrics(fx.tickets(spark, sf_dir))
    return s.select(*SLA_COLS, fmt_ts("created_at").alias("created_at"),
                    *[F.col(c) for c in ["elapsed_minutes", "response_threshold", "resolution_threshold",
                                               "response_remaining", "resolution_remaining", "response_risk",
                                               "resolution_risk", "breach_probability"]],
                    "breach_bucket", "sla_status")


@query("breach_bucket_counts", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}
SELECT {S.bucket('breach_probability')} AS breach_bucket, count(*) AS tickets,
       round(avg(breach_probability), 6) AS avg_breach_probability
FROM scored GROUP BY 1
""")
def q_bucket_counts(spark, sf_dir):
    s = scoring.sla_metrics(fx.tickets(spark, sf_dir))
    return s.groupBy("breach_bucket").agg(F.count(F.lit(1)).alias("tickets"),
                                          r6(F.avg("breach_probability")).alias("avg_breach_probability"))


# ---------------------------------------------------------------------------
# B3 + B15 + E1 — category-adjusted scores and the What-Next queue
# ---------------------------------------------------------------------------

_ADJ_SQL = f"""
adj AS (
  SELECT *,
    least(1.0::DOUBLE,
      (CASE WHEN status IN ('resolved', 'closed') THEN 0.0::DOUBLE
            WHEN status = 'open' THEN response_risk * 0.7::DOUBLE + resolution_risk * (1.0::DOUBLE - 0.7::DOUBLE)
            ELSE response_risk * 0.3::DOUBLE + resolution_risk * (1.0::DOUBLE - 0.3::DOUBLE) END)
      * (CASE category WHEN 'infrastructure' THEN 1.2::DOUBLE WHEN 'access' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END))
      AS breach_probability
  FROM t_risk
)"""


def _adjusted(spark, sf_dir):
    s = scoring.sla_metrics_category_adjusted(fx.tickets(spark, sf_dir))
    return s.withColumn("recommended_actions",
                        scoring.actions_for_rules(R.ACTIONS_OPS, "breach_probability"))


@query("sla_category_adjusted", oracle=f"""
WITH {S.TICKETS}, {S.TICKET_RISKS}, {_ADJ_SQL}
SELECT ticket_id, breach_probability AS breach_probability,
       {S.status('breach_probability')} AS sla_status,
       least(response_remaining, resolution_remaining) AS time_to_breach_minutes,
       {S.actions_sql(R.ACTIONS_OPS, 'breach_probability', 'category', 'coalesce(priority, 3)')} AS recommended_actions
FROM adj
""")
def q_sla_category_adjusted(spark, sf_dir):
    s = _adjusted(spark, sf_dir)
    return s.select("ticket_id", F.col("breach_probability").alias("breach_probability"), "sla_status",
                    F.col("time_to_breach_minutes").alias("time_to_breach_minutes"),
                    F.array_join("recommended_actions", ",").alias("recommended_actions"))


_QUEUE_SELECT = f"""
SELECT queue_position, ticket_id, priority, category, breach_probability AS breach_probability,
       {S.status('breach_probability')} AS sla_status,
       least(response_remaining, resolution_remaining) AS time_to_breach,
       {S.first_action_sql(R.ACTIONS_OPS, 'breach_probability', 'category', 'coalesce(priority, 3)')}
         AS recommended_action
FROM (SELECT *, row_number() OVER (ORDER BY breach_probability DESC, ticket_id ASC) AS queue_position FROM adj) q
"""


@query("what_next_queue", oracle=f"""
WITH {S.TICKETS}, {S.TICKET_RISKS}, {_ADJ_SQL}
{_QUEUE_SELECT} WHERE queue_position <= 20
""")
def q_what_next_queue(spark, sf_dir):
    q = kpi.what_next_queue(_adjusted(spark, sf_dir), k=20)
    return _queue_out(q)


@query("what_next_queue_full", oracle=f"""
WITH {S.TICKETS}, {S.TICKET_RISKS}, {_ADJ_SQL}
{_QUEUE_SELECT}
""")
def q_what_next_queue_full(spark, sf_dir):
    q = kpi.what_next_queue(_adjusted(spark, sf_dir), k=None, columns=_QUEUE_COLUMNS)
    return _queue_out(q)


_QUEUE_COLUMNS = ["ticket_id", "priority", "category", "breach_probability", "sla_status", "time_to_breach_minutes"]


def _queue_out(q):
    return q.select(F.col("queue_position").cast("bigint").alias("queue_position"), "ticket_id", "priority",
                    "category", F.col("breach_probability").alias("breach_probability"), "sla_status",
                    F.col("time_to_breach_minutes").alias("time_to_breach"), "recommended_action")


# ---------------------------------------------------------------------------
# B4 + B16 — critical scenario scoring
# ---------------------------------------------------------------------------

_CRIT_SQL = f"""
crit AS (
  SELECT *,
    least(1.0::DOUBLE,
      (CASE WHEN status IN ('resolved', 'closed') THEN 0.0::DOUBLE
            WHEN priority = 1 THEN response_risk * 0.9::DOUBLE + resolution_risk * 0.1::DOUBLE
            WHEN priority = 2 THEN response_risk * 0.7::DOUBLE + resolution_risk * 0.3::DOUBLE
            ELSE response_risk * 0.4::DOUBLE + resolution_risk * 0.6::DOUBLE END)
      * (CASE WHEN contains(description, 'URGENT') OR contains(description, 'CRITICAL') THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END)
      * (CASE category WHEN 'infrastructure' THEN 1.2::DOUBLE WHEN 'security' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END)
      * (CASE WHEN contains(lower(description), 'revenue') OR contains(lower(description), 'business')
              THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END)) AS breach_probability
  FROM t_risk
)"""


@query("sla_critical", oracle=f"""
WITH {S.TICKETS}, {S.TICKET_RISKS}, {_CRIT_SQL}
SELECT ticket_id, breach_probability AS breach_probability,
       {S.status('breach_probability')} AS sla_status,
       {S.actions_sql(R.ACTIONS_CRITICAL, 'breach_probability', 'category', 'coalesce(priority, 3)', 'lower(description)')}
         AS critical_actions
FROM crit
""")
def q_sla_critical(spark, sf_dir):
    s = scoring.sla_metrics_critical(fx.tickets(spark, sf_dir))
    s = s.withColumn("critical_actions", scoring.actions_for_rules(
        R.ACTIONS_CRITICAL, "breach_probability", text_lower=F.lower(F.col("description"))))
    return s.select("ticket_id", F.col("breach_probability").alias("breach_probability"), "sla_status",
                    F.array_join("critical_actions", ",").alias("critical_actions"))


# ---------------------------------------------------------------------------
# B5 — business-weighted scoring
# ---------------------------------------------------------------------------

@query("sla_business", oracle=f"""
WITH {S.TICKETS}, {S.TICKET_RISKS}
SELECT ticket_id, p AS breach_probability, {S.status('p')} AS sla_status
FROM (SELECT *, CASE WHEN status IN ('resolved', 'closed') THEN 0.0::DOUBLE
       ELSE least(1.0::DOUBLE, greatest(response_risk, resolution_risk * 0.7::DOUBLE)
            * CASE WHEN customer_impact = 'critical' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) END AS p
      FROM t_risk) b
""")
def q_sla_business(spark, sf_dir):
    s = scoring.sla_metrics_business(fx.tickets(spark, sf_dir))
    return s.select("ticket_id", F.col("breach_probability").alias("breach_probability"), "sla_status")


# ---------------------------------------------------------------------------
# D1 + B6 + C2/C3 — system load and the 15-feature vector
# ---------------------------------------------------------------------------

_LOAD_SQL = """
load AS (
  SELECT CAST(count(*) FILTER (WHERE status IN ('open', 'in_progress')) AS DOUBLE) AS active_tickets,
         least(1.0::DOUBLE, CAST(count(*) FILTER (WHERE status IN ('open', 'in_progress')) AS DOUBLE) / 20.0) AS technician_utilization
  FROM scored
)"""


@query("system_load", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}, {_LOAD_SQL}
SELECT round(active_tickets, 6) AS active_tickets, round(technician_utilization, 6) AS technician_utilization,
       round(15.0 + technician_utilization * 45.0, 6) AS avg_response_time
FROM load
""")
def q_system_load(spark, sf_dir):
    s = scoring.system_load(scoring.sla_metrics(fx.tickets(spark, sf_dir)))
    return s.select(*[r6(c).alias(c) for c in ["active_tickets", "technician_utilization", "avg_response_time"]])


_FEATURE_NAMES = ["f_priority", "f_is_open", "f_in_progress", "f_response_remaining", "f_resolution_remaining",
                  "f_hardware", "f_software", "f_infrastructure", "f_access", "f_avg_resolution_time",
                  "f_breach_rate", "f_escalation_rate", "f_active_tickets", "f_utilization", "f_avg_response_time"]


@query("breach_features", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}, {_LOAD_SQL}
SELECT ticket_id,
  CAST(coalesce(priority, 3) AS DOUBLE) AS f_priority,
  CASE WHEN status = 'open' THEN 1.0 ELSE 0.0 END::DOUBLE AS f_is_open,
  CASE WHEN status = 'in_progress' THEN 1.0 ELSE 0.0 END::DOUBLE AS f_in_progress,
  response_remaining AS f_response_remaining,
  resolution_remaining AS f_resolution_remaining,
  CASE WHEN category = 'hardware' THEN 1.0 ELSE 0.0 END::DOUBLE AS f_hardware,
  CASE WHEN category = 'software' THEN 1.0 ELSE 0.0 END::DOUBLE AS f_software,
  CASE WHEN category = 'infrastructure' THEN 1.0 ELSE 0.0 END::DOUBLE AS f_infrastructure,
  CASE WHEN category = 'access' THEN 1.0 ELSE 0.0 END::DOUBLE AS f_access,
  CASE category WHEN 'software' THEN 180.0 WHEN 'infrastructure' THEN 120.0 WHEN 'access' THEN 60.0 ELSE 240.0 END::DOUBLE
    AS f_avg_resolution_time,
  CASE category WHEN 'software' THEN 0.12 WHEN 'infrastructure' THEN 0.08 WHEN 'access' THEN 0.05 ELSE 0.15 END::DOUBLE
    AS f_breach_rate,
  CASE category WHEN 'software' THEN 0.20 WHEN 'infrastructure' THEN 0.30 WHEN 'access' THEN 0.10 ELSE 0.25 END::DOUBLE
    AS f_escalation_rate,
  load.active_tickets AS f_active_tickets,
  load.technician_utilization AS f_utilization,
  15.0 + load.technician_utilization * 45.0 AS f_avg_response_time
FROM scored CROSS JOIN load
""")
def q_breach_features(spark, sf_dir):
    f = scoring.breach_features_15(scoring.sla_metrics(fx.tickets(spark, sf_dir)))
    return f.select("ticket_id", *[F.element_at("features", i + 1).alias(n)
                                   for i, n in enumerate(_FEATURE_NAMES)])


# ---------------------------------------------------------------------------
# B10-B14 — predictions, boosts, time to breach, actions
# ---------------------------------------------------------------------------

_PRED_SQL = """
pred AS (
  SELECT *,
    CASE WHEN response_remaining <= 5 THEN 0.9 WHEN response_remaining <= 15 THEN 0.7
         WHEN resolution_remaining <= 60 THEN 0.6 ELSE 0.3 END::DOUBLE AS ml_probability,
    0.6::DOUBLE AS ml_confidence
  FROM scored
),
pred2 AS (
  SELECT *, breach_probability * (1.0::DOUBLE - ml_confidence) + ml_probability * ml_confidence AS final_p,
         least(response_remaining, resolution_remaining) AS min_rem
  FROM pred
)"""


@query("breach_predictions", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}, {_PRED_SQL}
SELECT ticket_id, ml_probability AS ml_probability, final_p AS final_breach_probability,
  final_p >= 0.7 AS priority_boost,
  CASE WHEN final_p >= 0.7 THEN greatest(1, coalesce(priority, 3) - 1) ELSE coalesce(priority, 3) END AS new_priority,
  CAST(CASE WHEN final_p >= 0.9 THEN greatest(5, trunc(min_rem * 0.1))
       WHEN final_p >= 0.7 THEN greatest(15, trunc(min_rem * 0.3))
       WHEN final_p >= 0.5 THEN greatest(30, trunc(min_rem * 0.5))
       ELSE trunc(min_rem) END AS BIGINT) AS time_to_breach,
  {S.actions_sql(R.ACTIONS_BASE, 'final_p', 'category', 'coalesce(priority, 3)')} AS recommended_actions,
  final_p >= 0.7 AS trigger_action
FROM pred2
""")
def q_breach_predictions(spark, sf_dir):
    p = scoring.predict(fx.tickets(spark, sf_dir))
    return p.select("ticket_id", F.col("ml_probability").alias("ml_probability"),
                    F.col("final_breach_probability").alias("final_breach_probability"),
                    "priority_boost", "new_priority", "time_to_breach",
                    F.array_join("recommended_actions", ",").alias("recommended_actions"), "trigger_action")


# B31/B32 — one typed action event per recommended action of a triggered prediction
_KNOWN = ", ".join(f"'{a}'" for a in R.KNOWN_ACTIONS)


@query("action_events", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}, {_PRED_SQL},
acts AS (
  SELECT ticket_id, final_p, min_rem, priority,
         unnest(string_split({S.actions_sql(R.ACTIONS_BASE, 'final_p', 'category', 'coalesce(priority, 3)')}, ','))
           AS action
  FROM pred2 WHERE final_p >= 0.7
)
SELECT ticket_id, action,
  CASE WHEN final_p >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END AS urgency,
  CASE WHEN final_p >= 0.9 THEN 'CRITICAL' ELSE 'HIGH' END AS incident_severity,
  CAST(greatest(5, floor(CAST(CASE WHEN final_p >= 0.9 THEN greatest(5, trunc(min_rem * 0.1))
       WHEN final_p >= 0.7 THEN greatest(15, trunc(min_rem * 0.3)) ELSE trunc(min_rem) END AS BIGINT) / 2)) AS BIGINT)
    AS followup_minutes
FROM acts WHERE action IN ({_KNOWN})
""")
def q_action_events(spark, sf_dir):
    from ..operators import actions
    ev, _ = actions.action_events(scoring.predict(fx.tickets(spark, sf_dir)))
    return ev.select("ticket_id", "action", "urgency", "incident_severity", "followup_minutes")


@query("action_bodies", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}, {_PRED_SQL},
acts AS (
  SELECT ticket_id, category, final_p AS p, coalesce(priority, 3) AS pr,
         CAST(CASE WHEN final_p >= 0.9 THEN greatest(5, trunc(min_rem * 0.1)) ELSE greatest(15, trunc(min_rem * 0.3)) END AS BIGINT) AS ttb,
         unnest(string_split({S.actions_sql(R.ACTIONS_BASE, 'final_p', 'category', 'coalesce(priority, 3)')}, ','))
           AS action
  FROM pred2 WHERE final_p >= 0.7
),
b AS (SELECT *, CAST(greatest(5, floor(ttb / 2)) AS BIGINT) AS fm FROM acts)
SELECT ticket_id, action,
  CASE action WHEN 'escalate-immediately' THEN 'workflow:escalation' WHEN 'notify-manager' THEN 'notification:manager-alerts'
    WHEN 'trigger-incident-response' THEN 'workflow:incident-response' WHEN 'boost-priority' THEN 'bus:Priority Boost'
    WHEN 'assign-senior-tech' THEN 'bus:Senior Tech Assignment' WHEN 'dispatch-onsite-tech' THEN 'bus:Onsite Tech Dispatch'
    WHEN 'engage-vendor-support' THEN 'bus:Vendor Support Engagement' WHEN 'send-reminder' THEN 'notification:technician-reminders'
    WHEN 'check-spare-parts' THEN 'bus:Spare Parts Check' WHEN 'auto-reset-password' THEN 'bus:L1 Automation Trigger'
    WHEN 'schedule-followup' THEN 'bus:Followup Scheduled' END AS target,
  CASE action WHEN 'escalate-immediately' THEN 'SLA_BREACH_RISK' WHEN 'boost-priority' THEN 'SLA_BREACH_RISK'
    WHEN 'assign-senior-tech' THEN 'SENIOR_TECH' WHEN 'dispatch-onsite-tech' THEN 'ONSITE_HARDWARE'
    WHEN 'engage-vendor-support' THEN 'VENDOR_ESCALATION' WHEN 'trigger-incident-response' THEN 'SLA_BREACH_IMMINENT'
    WHEN 'check-spare-parts' THEN 'SPARE_PARTS_AVAILABILITY' WHEN 'auto-reset-password' THEN 'PASSWORD_RESET'
    WHEN 'schedule-followup' THEN 'SLA_CHECK' WHEN 'notify-manager' THEN 'SLA Breach Risk Alert - Ticket ' || ticket_id
    WHEN 'send-reminder' THEN 'SLA Reminder - Ticket ' || ticket_id END AS kind,
  CASE WHEN action IN ('escalate-immediately', 'boost-priority') THEN CAST(greatest(1, pr - 1) AS VARCHAR) END AS new_priority,
  CASE action WHEN 'boost-priority' THEN CAST(pr AS VARCHAR) WHEN 'escalate-immediately' THEN CAST(pr AS VARCHAR)
    WHEN 'notify-manager' THEN 'P' || CAST(pr AS VARCHAR) WHEN 'send-reminder' THEN 'P' || CAST(pr AS VARCHAR) END AS old_priority,
  CASE action WHEN 'assign-senior-tech' THEN CASE WHEN p >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END
    WHEN 'trigger-incident-response' THEN CASE WHEN p >= 0.9 THEN 'CRITICAL' ELSE 'HIGH' END
    WHEN 'dispatch-onsite-tech' THEN 'HIGH' WHEN 'engage-vendor-support' THEN 'HIGH' WHEN 'check-spare-parts' THEN 'HIGH' END AS level,
  CASE action WHEN 'dispatch-onsite-tech' THEN strftime({S.AS_OF} + INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%S')
    WHEN 'schedule-followup' THEN strftime({S.AS_OF} + to_minutes(fm), '%Y-%m-%dT%H:%M:%S') END AS due
FROM b WHERE action IN ({_KNOWN})
""")
def q_action_bodies(spark, sf_dir):
    """The typed body of every action event, read back from its JSON."""
    from ..operators import actions
    ev, _ = actions.action_events(scoring.predict(fx.tickets(spark, sf_dir)))
    j = lambda *names: F.coalesce(*[F.get_json_object("body", f"$.{n}") for n in names])
    return actions.typed_action_events(ev).select(
        "ticket_id", "action", F.concat_ws(":", "channel", "detail_type").alias("target"),
        j("escalation_reason", "assignment_type", "dispatch_type", "engagement_type", "incident_type", "check_type",
          "automation_type", "followup_type", "subject", "reason").alias("kind"),
        j("new_priority").alias("new_priority"), j("old_priority", "original_priority", "current_priority").alias("old_priority"),
        j("severity", "urgency", "priority").alias("level"), j("estimated_arrival", "followup_time").alias("due"))


@query("action_rejects", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}, {_PRED_SQL},
acts AS (
  SELECT ticket_id,
         unnest(string_split({S.actions_sql(R.ACTIONS_BASE, 'final_p', 'category', 'coalesce(priority, 3)')}, ','))
           AS action
  FROM pred2 WHERE final_p >= 0.7
)
SELECT action, count(*) AS rejected FROM acts WHERE action NOT IN ({_KNOWN}) GROUP BY action
""")
def q_action_rejects(spark, sf_dir):
    from ..operators import actions
    _, rej = actions.action_events(scoring.predict(fx.tickets(spark, sf_dir)))
    return rej.groupBy("action").agg(F.count(F.lit(1)).alias("rejected"))


# ---------------------------------------------------------------------------
# D9, D10 — KPIs
# ---------------------------------------------------------------------------

@query("ops_kpis", oracle=f"""
WITH {S.TICKETS}, {S.TICKET_RISKS}, {_ADJ_SQL}
SELECT count(*) AS total_tickets,
       count(*) FILTER (WHERE breach_probability >= 0.7) AS at_risk_tickets,
       count(*) FILTER (WHERE breach_probability < 0.5) AS healthy_tickets,
       round(CASE WHEN count(*) > 0 THEN (count(*) - count(*) FILTER (WHERE breach_probability >= 0.7)) * 100.0 / count(*)
             ELSE 100.0 END, 6) AS sla_compliance,
       round(avg(breach_probability), 6) AS avg_breach_probability
FROM adj
""")
def q_ops_kpis(spark, sf_dir):
    s = scoring.sla_metrics_category_adjusted(fx.tickets(spark, sf_dir))
    k = kpi.ops_kpis(s)
    avg = s.agg(r6(F.avg("breach_probability")).alias("avg_breach_probability"))
    return with_scalars(k, avg).select("total_tickets", "at_risk_tickets", "healthy_tickets",
                                   r6("sla_compliance").alias("sla_compliance"), "avg_breach_probability")


@query("business_impact", oracle=f"""
WITH {S.TICKETS}
SELECT count(*) FILTER (WHERE contains(lower(description), 'revenue')) AS revenue_tickets,
       count(*) FILTER (WHERE category = 'infrastructure') AS infrastructure_tickets
FROM tickets
""")
def q_business_impact(spark, sf_dir):
    return kpi.business_impact(fx.tickets(spark, sf_dir))


# ---------------------------------------------------------------------------
# B22-B25, B29-B30 — bands, routes, alerts, dashboard flags
# ---------------------------------------------------------------------------

@query("risk_routes", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}
SELECT ticket_id,
  CASE WHEN breach_probability > 0.8 THEN 'CRITICAL' WHEN breach_probability > 0.6 THEN 'HIGH'
       WHEN breach_probability > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS demo_risk,
  CASE WHEN breach_probability > 0.7 THEN 'High' WHEN breach_probability > 0.4 THEN 'Medium' ELSE 'Low' END AS ui_risk,
  breach_probability > 0.7 AS alert_needed,
  CASE WHEN breach_probability > 0.7 THEN 'high' WHEN breach_probability > 0.5 THEN 'medium' ELSE 'low' END AS alert_level,
  CASE WHEN breach_probability > 0.7 THEN 'email,slack' WHEN breach_probability > 0.5 THEN 'email' ELSE '' END
    AS alert_channels,
  breach_probability > 0.8 AS escalation_needed,
  CASE WHEN breach_probability > 0.9 THEN 'red' ELSE 'yellow' END AS alert_color,
  CASE WHEN breach_probability > 0.7 THEN 'predict_act_validate' WHEN breach_probability > 0.4 THEN 'monitor'
       ELSE 'healthy' END AS route,
  breach_probability > 0.4 AS bus_forward,
  CASE WHEN breach_probability > 0.8 THEN 'alert_and_act' WHEN breach_probability > 0.6 THEN 'act' ELSE 'log' END
    AS prod_route
FROM scored
""")
def q_risk_routes(spark, sf_dir):
    s = scoring.workflow_route(scoring.risk_bands(scoring.sla_metrics(fx.tickets(spark, sf_dir))))
    return s.select("ticket_id", "demo_risk", "ui_risk", "alert_needed", "alert_level",
                    F.array_join("alert_channels", ",").alias("alert_channels"), "escalation_needed",
                    "alert_color", "route", "bus_forward", "prod_route")


@query("alerts", oracle=f"""
WITH {S.TICKETS}, {S.SCORED},
a AS (
  SELECT ticket_id, breach_probability, description, 'critical_breach' AS alert_type FROM scored
    WHERE breach_probability > 0.7
  UNION ALL
  SELECT ticket_id, breach_probability, description, 'high_revenue' AS alert_type FROM scored
    WHERE revenue_impact > 100000
)
SELECT ticket_id, alert_type,
  substr(description, 1, 200) || '...' AS alert_text,
  'SLA alert: ' || ticket_id || ' at ' || printf('%.1f%%', round(breach_probability * 100.0, 1)) AS subject,
  CASE WHEN contains(lower(alert_type), 'critical') THEN 'CRITICAL' ELSE 'WARNING' END AS severity
FROM a
""")
def q_alerts(spark, sf_dir):
    a = scoring.alert_message(scoring.alert_select(scoring.sla_metrics(fx.tickets(spark, sf_dir))))
    return a.select("ticket_id", "alert_type", "alert_text", "subject", "severity")


@query("dashboard_flags", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}
SELECT ticket_id,
  CASE WHEN printf('%.2f', revenue_impact) > '100000' THEN 'Critical' ELSE 'Normal' END AS is_critical,
  CASE WHEN printf('%.6f', breach_probability) > '0.7' THEN 'High Risk'
       WHEN printf('%.6f', breach_probability) > '0.3' THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level,
  CASE WHEN revenue_impact > 100000 THEN 'Critical' ELSE 'Normal' END AS is_critical_numeric
FROM scored
""")
def q_dashboard_flags(spark, sf_dir):
    s = scoring.quicksight_flags(scoring.sla_metrics(fx.tickets(spark, sf_dir)))
    numeric = F.when(F.col("revenue_impact") > 100000, F.lit("Critical")).otherwise(F.lit("Normal"))
    return s.select("ticket_id", "is_critical", "risk_level", numeric.alias("is_critical_numeric"))


# ---------------------------------------------------------------------------
# B27/F5/B28 — ticket listing, newest-50 and patches
# ---------------------------------------------------------------------------

@query("open_p1_tickets", oracle=f"""
WITH {S.TICKETS}
SELECT ticket_id, priority, status, {S.ts('created_at')} AS created_at FROM tickets
WHERE status = 'open' AND priority = 1
""")
def q_open_p1(spark, sf_dir):
    from ..operators import tickets as T
    t = T.filter_tickets(fx.tickets(spark, sf_dir), status="open", priority=1)
    return t.select("ticket_id", "priority", "status", fmt_ts("created_at").alias("created_at"))


@query("recent_tickets", oracle=f"""
WITH {S.TICKETS}
SELECT ticket_id, {S.ts('created_at')} AS created_at FROM tickets
ORDER BY created_at DESC, ticket_id DESC LIMIT 50
""")
def q_recent(spark, sf_dir):
    from ..operators import tickets as T
    t = T.newest(fx.tickets(spark, sf_dir), 50)
    return t.select("ticket_id", fmt_ts("created_at").alias("created_at"))


@query("patched_tickets", oracle=f"""
WITH {S.TICKETS},
patches AS (
  SELECT 'T-' || CAST(l_orderkey AS VARCHAR) AS ticket_id, 'reopened' AS status, 'returns-desk' AS assigned_to
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey
)
SELECT t.ticket_id, coalesce(p.status, t.status) AS status, coalesce(p.assigned_to, 'unassigned') AS assigned_to
FROM tickets t LEFT JOIN patches p ON t.ticket_id = p.ticket_id
""")
def q_patched(spark, sf_dir):
    from ..operators import tickets as T
    from ..sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag"])
    patches = (li.filter(F.col("l_returnflag") == "R").select("l_orderkey").distinct()
               .select(F.concat(F.lit("T-"), F.col("l_orderkey").cast("string")).alias("ticket_id"),
                       F.lit("reopened").alias("status"), F.lit("returns-desk").alias("assigned_to")))
    t = fx.tickets(spark, sf_dir).withColumn("assigned_to", F.lit("unassigned"))
    return T.patch_tickets(t, patches, key="ticket_id").select("ticket_id", "status", "assigned_to")


# ---------------------------------------------------------------------------
# E3 — newest first inside a risk bucket (scored tickets as state versions)
# ---------------------------------------------------------------------------

@query("state_by_bucket", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}
SELECT ticket_id, {S.bucket('breach_probability')} AS breach_bucket,
  row_number() OVER (PARTITION BY {S.bucket('breach_probability')} ORDER BY created_at DESC, order_key ASC)
    AS bucket_position
FROM scored
""")
def q_state_by_bucket(spark, sf_dir):
    s = scoring.sla_metrics(fx.tickets(spark, sf_dir)).select(
        "ticket_id", "breach_bucket", F.col("created_at").alias("version_ts"), F.col("order_key").alias("service_id"))
    r = kpi.state_by_bucket(s)
    return r.select("ticket_id", "breach_bucket", F.col("bucket_position").cast("bigint").alias("bucket_position"))


# ---------------------------------------------------------------------------
# C6 — prediction events joined to their tickets (inner) with rejects
# ---------------------------------------------------------------------------

@query("prediction_event_tickets", oracle=f"""
WITH {S.TICKETS}, {S.SCORED},
ev AS (
  SELECT 'T-' || CAST(o_orderkey AS VARCHAR) AS ticket_id, o_orderkey % 2 = 0 AS known FROM orders
  UNION ALL SELECT 'T-X' || CAST(o_orderkey AS VARCHAR), false FROM orders WHERE o_orderkey % 2 = 1
)
SELECT s.category, count(*) AS events, round(avg(s.breach_probability), 6) AS avg_breach_probability,
  (SELECT count(*) FROM ev WHERE ticket_id NOT IN (SELECT ticket_id FROM tickets)) AS rejected
FROM ev JOIN scored s USING (ticket_id) GROUP BY s.category
""")
def q_prediction_event_tickets(spark, sf_dir):
    """Events for every order plus events for unknown tickets (odd orders under a
    wrong id): the inner join keeps known tickets, the anti join counts the rest."""
    from ..operators import tickets as T
    from ..sources.tables import read_table
    o = read_table(spark, sf_dir, "orders", ["o_orderkey"])
    ev = o.select(F.concat(F.lit("T-"), F.col("o_orderkey").cast("string")).alias("ticket_id")).unionByName(
        o.filter(F.pmod("o_orderkey", F.lit(2)) == 1)
        .select(F.concat(F.lit("T-X"), F.col("o_orderkey").cast("string")).alias("ticket_id")))
    s = scoring.sla_metrics(fx.tickets(spark, sf_dir)).select("ticket_id", "category", "breach_probability")
    ok, rej = T.join_events_to_tickets(ev, s)
    g = ok.groupBy("category").agg(F.count(F.lit(1)).alias("events"),
                                   r6(F.avg("breach_probability")).alias("avg_breach_probability"))
    return with_scalars(g, rej.agg(F.count(F.lit(1)).alias("rejected")))


# ---------------------------------------------------------------------------
# S2 — re-scoring by the index of next changes
# ---------------------------------------------------------------------------

_TICKS = [f"2024-02-01 00:{5 * k:02d}:00" for k in range(7)]
_RESOLVED_AT = 3  # before this tick every fiftieth ticket is resolved


def _rescore_run(spark, sf_dir):
    """Six ticks, five minutes apart, after a full scoring; returns the index and what each tick touched."""
    tickets = fx.tickets(spark, sf_dir)
    index = rescoring.RescoreIndex(spark, IN.scratch_path(spark, "rescore"))
    index.start(tickets, _TICKS[0])
    touched, run = [], 0
    for k, (before, now) in enumerate(zip(_TICKS, _TICKS[1:]), 1):
        if k == _RESOLVED_AT:
            run += 1
            index.update(run, tickets.filter("order_key % 50 = 7").withColumn("status", F.lit("resolved")), before)
        run += 1
        touched.append(index.tick(run, before, now).withColumn("tick", F.lit(k)))
    return index, touched


_TICKED_SQL = f"""
WITH {S.TICKETS}, tick AS (SELECT unnest(range(0, {len(_TICKS)})) AS k),
ticked AS (
  SELECT * REPLACE (CASE WHEN order_key % 50 = 7 AND k >= {_RESOLVED_AT} THEN 'resolved' ELSE status END AS status),
    {S.AS_OF} + to_minutes(CAST(5 * k AS BIGINT)) AS now FROM tickets, tick
),
{S.SCORED.replace("FROM tickets", "FROM ticked").replace(f"epoch_us({S.AS_OF})", "epoch_us(now)")},
shown AS (SELECT ticket_id, order_key, k, status, {S.bucket('breach_probability')} AS b, {S.status('breach_probability')} AS s FROM scored)"""


@query("rescore_changes", oracle=f"""{_TICKED_SQL}
SELECT n.k AS tick, n.ticket_id, o.b AS old_bucket, n.b AS breach_bucket, o.s AS old_status, n.s AS sla_status
FROM shown n JOIN shown o ON o.ticket_id = n.ticket_id AND o.k = n.k - 1
WHERE (n.b <> o.b OR n.s <> o.s) AND n.status <> 'resolved'
""")
def q_rescore_changes(spark, sf_dir):
    """What six ticks find by touching only the tickets that are due; equals scoring all tickets at every tick."""
    found = [rescoring.changes(t).select("tick", "ticket_id", "old_bucket", "breach_bucket", "old_status", "sla_status")
             for t in _rescore_run(spark, sf_dir)[1]]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query("rescored_tickets", oracle=f"""{_TICKED_SQL}
SELECT ticket_id, status, b AS breach_bucket, s AS sla_status FROM shown WHERE k = {len(_TICKS) - 1}
""")
def q_rescored_tickets(spark, sf_dir):
    """Bucket and status of all tickets after the last tick, resolved ones included."""
    return _rescore_run(spark, sf_dir)[0].current()
