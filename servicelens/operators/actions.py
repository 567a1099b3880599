"""Turn triggered predictions into typed action events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_AS_OF
from ..functions import rules as R
from ..functions.columns import ts_literal
from .util import filter_computed


def action_events(pred: DataFrame, actions_col: str = "recommended_actions",
                  p: str = "final_breach_probability") -> tuple[DataFrame, DataFrame]:
    """One event per recommended action of a triggered (p >= .7) prediction.

    Returns (events, rejects): actions with a handler become events carrying the
    urgency (HIGH if p >= .8), incident severity (CRITICAL if p >= .9) and the
    follow-up delay max(5, time_to_breach // 2); unknown actions go to ``rejects``.
    The known-action list is a literal ``isin`` (no join)."""
    # explode_outer + null filter: a plain explode makes Spark infer size(array) > 0
    # and push that down through the whole scoring projection (re-evaluating it)
    # filter_computed: the threshold reads the computed probability instead of
    # re-evaluating the scoring chain below the projection
    exploded = (filter_computed(pred, p, F.col(p) >= R.ACTION_THRESHOLD)
                .select("*", F.explode_outer(F.col(actions_col)).alias("action"))
                .filter(F.col("action").isNotNull()))
    known = F.col("action").isin(*R.KNOWN_ACTIONS)
    events = (exploded.filter(known)
              .withColumn("urgency", F.when(F.col(p) >= 0.8, F.lit("HIGH")).otherwise(F.lit("MEDIUM")))
              .withColumn("incident_severity", F.when(F.col(p) >= 0.9, F.lit("CRITICAL")).otherwise(F.lit("HIGH")))
              .withColumn("followup_minutes",
                          F.greatest(F.lit(5).cast("bigint"), F.floor(F.col("time_to_breach") / 2).cast("bigint")))
              .withColumn("detail", F.to_json(F.struct("ticket_id", "action", F.col(p).alias("breach_probability"),
                                                       "category", "urgency"))))
    rejects = exploded.filter(~known)
    return events, rejects


def typed_action_events(events: DataFrame, p: str = "final_breach_probability", as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """``events`` of ``action_events`` with ``channel`` (bus, workflow or notification), ``detail_type`` (the event
    type, workflow or topic) and ``body``: the JSON object with the fields of that action."""
    now = ts_literal(as_of)
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    prob, category, old = F.col(p), F.col("category"), F.coalesce("priority", F.lit(R.DEFAULT_PRIORITY))
    new = F.greatest(F.lit(1), old - 1)
    percent = F.format_string("%.1f%%", F.round(prob * 100.0, 1))
    fields: dict[str, Column] = {
        "ticket_id": F.col("ticket_id"), "category": category, "breach_probability": prob,
        "time_to_breach": F.col("time_to_breach"), "timestamp": iso(now), "urgency": F.lit("HIGH"),
        "escalation_reason": F.lit("SLA_BREACH_RISK"), "reason": F.lit("SLA_BREACH_RISK"),
        "original_priority": old, "old_priority": old, "new_priority": new, "updated_by": F.lit("sla-guard-agent"),
        "assignment_type": F.lit("SENIOR_TECH"), "assignment_urgency": F.col("urgency"),
        "followup_type": F.lit("SLA_CHECK"), "original_breach_probability": prob, "scheduled_at": iso(now),
        "followup_time": iso(now + F.make_dt_interval(mins=F.col("followup_minutes").cast("int"))),
        "incident_type": F.lit("SLA_BREACH_IMMINENT"), "severity": F.col("incident_severity"),
        "triggered_by": F.lit("sla-guard-agent"), "automation_by": F.lit("sla-guard"),
        "dispatch_type": F.lit("ONSITE_HARDWARE"), "estimated_arrival": iso(now + F.make_dt_interval(mins=F.lit(30))),
        "engagement_type": F.lit("VENDOR_ESCALATION"), "vendor_priority": F.lit("HIGH"),
        "automation_type": F.lit("PASSWORD_RESET"), "check_type": F.lit("SPARE_PARTS_AVAILABILITY"),
        "alert_subject": F.concat(F.lit("SLA Breach Risk Alert - Ticket "), F.col("ticket_id")),
        "reminder_subject": F.concat(F.lit("SLA Reminder - Ticket "), F.col("ticket_id")),
        "current_priority": F.concat(F.lit("P"), old.cast("string")), "breach_percent": percent,
        "recommended_actions": F.array_join(F.transform("recommended_actions", lambda a: F.initcap(F.replace(a, F.lit("-"), F.lit(" ")))), "; "),
    }
    kinds = R.ACTION_BODIES

    def body(names: list) -> Column:
        return F.to_json(F.struct(*[fields[n if isinstance(n, str) else n[0]].alias(n if isinstance(n, str) else n[1]) for n in names]))

    def case(value) -> Column:
        return F.coalesce(*[F.when(F.col("action") == a, value(*k)) for a, k in kinds.items()])

    return events.withColumns({
        "channel": case(lambda channel, kind, names: F.lit(channel)), "detail_type": case(lambda channel, kind, names: F.lit(kind)),
        "body": case(lambda channel, kind, names: body(names)), "source": F.lit("sla-guard")})
