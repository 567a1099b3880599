"""SLA scoring, breach prediction and action selection (narrow projections).

Every function here is a projection over its input: no shuffle, whole-stage
codegen end to end.  Thresholds are literal CASE chains (four priorities), so
there is no dimension join at all; a caller-supplied threshold table goes through
``with_thresholds`` which broadcasts it only after checking its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_AS_OF
from ..functions import rules as R
from ..functions.columns import (SqlText, actions_for, as_col, breach_bucket, clamp, ladder, lookup,
                                 minutes_between, present, sla_status, time_to_breach, ts_literal)
from .util import broadcast_if_small, with_scalars

_RESP = {p: v[0] for p, v in R.SLA_THRESHOLDS.items()}
_RESOL = {p: v[1] for p, v in R.SLA_THRESHOLDS.items()}


def _threshold_cols(priority: Column) -> tuple[Column, Column]:
    d_resp, d_resol = R.SLA_THRESHOLDS[R.DEFAULT_PRIORITY]
    return lookup(priority, _RESP, d_resp), lookup(priority, _RESOL, d_resol)


def with_thresholds(tickets: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Tickets left-joined to thresholds; unknown priority falls back to P3.

    ``thresholds`` (priority int, response_min double, resolution_min double) is a
    configuration table; it is broadcast only when its row count is under the bound.
    """
    prio = SqlText(f"coalesce(`priority`, {R.DEFAULT_PRIORITY})")
    if thresholds is None:
        resp, resol = _threshold_cols(prio)
        return tickets.withColumns({"response_threshold": resp, "resolution_threshold": resol})
    d_resp, d_resol = R.SLA_THRESHOLDS[R.DEFAULT_PRIORITY]
    th = broadcast_if_small(thresholds.select(
        F.col("priority").alias("_th_priority"),
        F.col("response_min").alias("_th_resp"),
        F.col("resolution_min").alias("_th_resol")), max_rows=10_000)
    joined = tickets.join(th, as_col(prio) == F.col("_th_priority"), "left")
    return (joined
            .withColumn("response_threshold", F.coalesce("_th_resp", F.lit(d_resp)))
            .withColumn("resolution_threshold", F.coalesce("_th_resol", F.lit(d_resol)))
            .drop("_th_priority", "_th_resp", "_th_resol"))


def _elapsed_and_risks(df: DataFrame, as_of: str) -> DataFrame:
    elapsed = minutes_between(F.col("created_at"), ts_literal(as_of))
    e = F.col("elapsed_minutes")
    # two dependency levels -> two projections (one analysis pass each)
    return df.withColumn("elapsed_minutes", elapsed).withColumns({
        "response_remaining": F.greatest(F.lit(0.0), F.col("response_threshold") - e),
        "resolution_remaining": F.greatest(F.lit(0.0), F.col("resolution_threshold") - e),
        "response_risk": F.least(F.lit(1.0), e / F.col("response_threshold")),
        "resolution_risk": F.least(F.lit(1.0), e / F.col("resolution_threshold")),
    })


def _is_closed() -> Column:
    return F.coalesce(F.col("status").isin("resolved", "closed"), F.lit(False))


def sla_metrics(tickets: DataFrame, as_of: str = DEFAULT_AS_OF, thresholds: DataFrame | None = None) -> DataFrame:
    """B1 + B2: elapsed, remaining, risks, weighted breach probability, bucket, status."""
    df = _elapsed_and_risks(with_thresholds(tickets, thresholds), as_of)
    w_resp = F.when(F.col("status") == "open", F.lit(0.7)).otherwise(F.lit(0.3))
    p = F.when(_is_closed(), F.lit(0.0)).otherwise(
        F.col("response_risk") * w_resp + F.col("resolution_risk") * (F.lit(1.0) - w_resp))
    bp = F.col("breach_probability")
    return df.withColumn("breach_probability", p).withColumns({"breach_bucket": breach_bucket(bp),
                                                               "sla_status": sla_status(bp)})


def sla_metrics_category_adjusted(tickets: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """B1 weights, then x1.2 infrastructure / x0.8 access, capped at 1."""
    df = _elapsed_and_risks(with_thresholds(tickets), as_of)
    w_resp = F.when(F.col("status") == "open", F.lit(0.7)).otherwise(F.lit(0.3))
    base = F.when(_is_closed(), F.lit(0.0)).otherwise(
        F.col("response_risk") * w_resp + F.col("resolution_risk") * (F.lit(1.0) - w_resp))
    factor = lookup(F.col("category"), R.CATEGORY_ADJUST_OPS, 1.0)
    return (df.withColumn("breach_probability", F.least(F.lit(1.0), base * factor))
            .withColumn("sla_status", sla_status(F.col("breach_probability")))
            .withColumn("time_to_breach_minutes",
                        F.least(F.col("response_remaining"), F.col("resolution_remaining"))))


def sla_metrics_critical(tickets: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Weights by priority and multipliers for urgent words, category and business words."""
    df = _elapsed_and_risks(with_thresholds(tickets), as_of)
    prio = F.col("priority")
    w_resp = (F.when(prio == 1, F.lit(R.CRITICAL_WEIGHTS[1][0]))
              .when(prio == 2, F.lit(R.CRITICAL_WEIGHTS[2][0]))
              .otherwise(F.lit(R.CRITICAL_WEIGHTS_DEFAULT[0])))
    w_resol = (F.when(prio == 1, F.lit(R.CRITICAL_WEIGHTS[1][1]))
               .when(prio == 2, F.lit(R.CRITICAL_WEIGHTS[2][1]))
               .otherwise(F.lit(R.CRITICAL_WEIGHTS_DEFAULT[1])))
    base = F.when(_is_closed(), F.lit(0.0)).otherwise(
        F.col("response_risk") * w_resp + F.col("resolution_risk") * w_resol)
    desc = F.coalesce(F.col("description"), F.lit(""))
    cased = F.lit(False)
    for w in R.CRITICAL_WORDS_CASED:
        cased = cased | desc.contains(w)
    lower = F.lower(desc)
    business = F.lit(False)
    for w in R.CRITICAL_BUSINESS_WORDS:
        business = business | lower.contains(w)
    p = (base
         * F.when(cased, F.lit(1.3)).otherwise(F.lit(1.0))
         * lookup(F.col("category"), R.CRITICAL_CATEGORY, 1.0)
         * F.when(business, F.lit(1.15)).otherwise(F.lit(1.0)))
    return (df.withColumn("breach_probability", F.least(F.lit(1.0), p))
            .withColumn("sla_status", sla_status(F.col("breach_probability")))
            .withColumn("time_to_breach_minutes",
                        F.least(F.col("response_remaining"), F.col("resolution_remaining"))))


def sla_metrics_business(tickets: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """max(response risk, 0.7 x resolution risk) x 1.2 for critical customers, capped."""
    df = _elapsed_and_risks(with_thresholds(tickets), as_of)
    weight = F.when(F.col("customer_impact") == "critical", F.lit(1.2)).otherwise(F.lit(1.0))
    p = F.when(_is_closed(), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.col("response_risk"), F.col("resolution_risk") * 0.7) * weight))
    return (df.withColumn("breach_probability", p)
            .withColumn("sla_status", sla_status(F.col("breach_probability"))))


# ---------------------------------------------------------------------------
# Prediction
# ---------------------------------------------------------------------------

def system_load(scored: DataFrame) -> DataFrame:
    """One-row load summary from the active ticket count (partial + final agg)."""
    n = F.count_if(F.col("status").isin("open", "in_progress"))
    util = F.least(F.lit(1.0), n.cast("double") / F.lit(R.SYSTEM_LOAD_FULL_AT))
    return scored.agg(
        n.cast("double").alias("active_tickets"),
        util.alias("technician_utilization"),
        (F.lit(15.0) + util * 45.0).alias("avg_response_time"),
    )


def category_stats_table(spark) -> DataFrame:
    """C2 dimension: four fixed rows (size bound by construction)."""
    rows = [(k, *v) for k, v in R.CATEGORY_STATS.items()]
    return spark.createDataFrame(rows, "category string, avg_resolution_time double, "
                                       "breach_rate double, escalation_rate double")


def breach_features_15(scored: DataFrame) -> DataFrame:
    """B6 with C2 (category stats, default hardware) and C3 (one-row system load).

    Category stats are four literal rows: a CASE chain, no join.  The system load
    is a one-row global aggregate, attached as scalar subqueries (no join).
    """
    d = R.CATEGORY_STATS[R.DEFAULT_CATEGORY_STATS]
    cat = F.col("category")
    stats = [lookup(cat, {k: v[i] for k, v in R.CATEGORY_STATS.items()}, d[i]) for i in range(3)]
    df = with_scalars(scored, system_load(scored))
    flag = lambda c: c.cast("double")
    feats = F.array(
        F.coalesce(F.col("priority"), F.lit(R.DEFAULT_PRIORITY)).cast("double"),
        flag(F.col("status") == "open"),
        flag(F.col("status") == "in_progress"),
        F.col("response_remaining").cast("double"),
        F.col("resolution_remaining").cast("double"),
        flag(cat == "hardware"), flag(cat == "software"), flag(cat == "infrastructure"), flag(cat == "access"),
        stats[0], stats[1], stats[2],
        F.col("active_tickets"), F.col("technician_utilization"), F.col("avg_response_time"),
    )
    return df.withColumn("features", feats).drop("active_tickets", "technician_utilization", "avg_response_time")


def heuristic_breach(df: DataFrame) -> DataFrame:
    """Remaining-minutes ladder as the model fallback (confidence 0.6)."""
    resp, resol = F.col("response_remaining"), F.col("resolution_remaining")
    p = (F.when(resp <= R.HEURISTIC_RESPONSE[0][0], F.lit(R.HEURISTIC_RESPONSE[0][1]))
         .when(resp <= R.HEURISTIC_RESPONSE[1][0], F.lit(R.HEURISTIC_RESPONSE[1][1]))
         .when(resol <= R.HEURISTIC_RESOLUTION[0], F.lit(R.HEURISTIC_RESOLUTION[1]))
         .otherwise(F.lit(R.HEURISTIC_DEFAULT)))
    return df.withColumns({"ml_probability": p, "ml_confidence": F.lit(R.HEURISTIC_CONFIDENCE),
                           "model_source": F.lit("fallback")})


def combine_predictions(df: DataFrame, rule_col: str = "breach_probability") -> DataFrame:
    """final = rule x (1 - conf) + ml x conf; boost, time to breach, actions."""
    conf = F.col("ml_confidence")
    final = F.col(rule_col) * (F.lit(1.0) - conf) + F.col("ml_probability") * conf
    fp = F.col("final_breach_probability")
    boost = fp >= R.ACTION_THRESHOLD
    prio = F.coalesce(F.col("priority"), F.lit(R.DEFAULT_PRIORITY))
    # two dependency levels -> two projections
    return df.withColumn("final_breach_probability", final).withColumns({
        "priority_boost": boost,
        "new_priority": F.when(boost, F.greatest(F.lit(1), prio - 1)).otherwise(prio),
        "time_to_breach": time_to_breach(fp, F.col("response_remaining"), F.col("resolution_remaining")),
        "recommended_actions": actions_for(R.ACTIONS_BASE, "final_breach_probability", "category",
                                           SqlText(f"coalesce(`priority`, {R.DEFAULT_PRIORITY})")),
        "trigger_action": fp >= R.ACTION_THRESHOLD,
    })


def predict(tickets: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """S3 batch body: score, heuristic model, combine."""
    return combine_predictions(heuristic_breach(sla_metrics(tickets, as_of)))


# ---------------------------------------------------------------------------
# Bands and routes
# ---------------------------------------------------------------------------

def risk_bands(df: DataFrame, p: str = "breach_probability") -> DataFrame:
    """The named ladders (demo risk level, UI risk, alert decision, alert colour)."""
    pc = F.col(p)
    return (df
            .withColumn("demo_risk", F.when(pc > 0.8, F.lit("CRITICAL")).when(pc > 0.6, F.lit("HIGH"))
                        .when(pc > 0.3, F.lit("MEDIUM")).otherwise(F.lit("LOW")))
            .withColumn("ui_risk", F.when(pc > 0.7, F.lit("High")).when(pc > 0.4, F.lit("Medium"))
                        .otherwise(F.lit("Low")))
            .withColumn("alert_needed", pc > 0.7)
            .withColumn("alert_level", F.when(pc > 0.7, F.lit("high")).when(pc > 0.5, F.lit("medium"))
                        .otherwise(F.lit("low")))
            .withColumn("alert_channels", F.when(pc > 0.7, F.array(F.lit("email"), F.lit("slack")))
                        .when(pc > 0.5, F.array(F.lit("email"))).otherwise(F.array().cast("array<string>")))
            .withColumn("escalation_needed", pc > 0.8)
            .withColumn("alert_color", F.when(pc > 0.9, F.lit("red")).otherwise(F.lit("yellow"))))


def workflow_route(df: DataFrame, p: str = "breach_probability") -> DataFrame:
    """Step-function routes (predict-act-validate / monitor / healthy; alert+act / act / log)."""
    pc = F.col(p)
    return (df
            .withColumn("route", F.when(pc > 0.7, F.lit("predict_act_validate"))
                        .when(pc > 0.4, F.lit("monitor")).otherwise(F.lit("healthy")))
            .withColumn("bus_forward", pc > 0.4)
            .withColumn("prod_route", F.when(pc > 0.8, F.lit("alert_and_act"))
                        .when(pc > 0.6, F.lit("act")).otherwise(F.lit("log"))))


def priority_routes(df: DataFrame, priority_text: str = "priority") -> DataFrame:
    """P1/P2 start a workflow; P1 also alerts at once."""
    pr = F.col(priority_text)
    return (df.withColumn("start_workflow", pr.isin("P1", "P2"))
            .withColumn("immediate_alert", pr == "P1"))


def alert_select(df: DataFrame, threshold: float = R.ACTION_THRESHOLD,
                 p: str = "breach_probability", revenue: str = "revenue_impact") -> DataFrame:
    """One alert row per reason; a ticket can raise both (explode of a compacted array)."""
    reasons = present([(F.col(p) > threshold, F.lit("critical_breach")),
                       (F.col(revenue) > 100000, F.lit("high_revenue"))])
    return df.withColumn("alert_type", F.explode_outer(reasons)).filter(F.col("alert_type").isNotNull())


def alert_message(alerts: DataFrame, text: str = "description", p: str = "breach_probability") -> DataFrame:
    """Alert text clipped to 200 chars + '...', percent format, severity from the name."""
    pct = F.format_string("%.1f%%", F.round(F.col(p) * 100.0, 1))
    return (alerts
            .withColumn("alert_text", F.concat(F.substring(F.coalesce(F.col(text), F.lit("")), 1, 200), F.lit("...")))
            .withColumn("subject", F.concat(F.lit("SLA alert: "), F.col("ticket_id"), F.lit(" at "), pct))
            .withColumn("severity", F.when(F.lower(F.col("alert_type")).contains("critical"), F.lit("CRITICAL"))
                        .otherwise(F.lit("WARNING"))))


def high_risk_alerts(pred: DataFrame, text: str = "text", p: str = "ml_breach_probability",
                     confidence: str = "ml_confidence", key: str = "id", as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """The alert record of every prediction above .7: CRITICAL above .9, else HIGH; the text is clipped
    to 200 characters and '...'; missing values read 'Unknown'."""
    critical = F.col(p) > 0.9
    level = F.when(critical, "\U0001F534 CRITICAL").otherwise("\U0001F7E1 HIGH")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))
    # the values are computed once, before the filter that reads one of them
    used = F.struct(*dict.fromkeys([key, "priority", "department", "sentiment", p, confidence, text, "adjusted_sla_deadline"]))
    return pred.select(F.inline_outer(F.array(used))).filter(F.col(p) > 0.7).select(
        F.lit("SLA_BREACH_RISK").alias("alert_type"), level.alias("risk_level"), F.col(key).alias("ticket_id"),
        known("priority").alias("priority"), known("department").alias("department"), known("sentiment").alias("sentiment"),
        F.col(p).alias("breach_probability"), F.col(confidence).alias("confidence"),
        F.concat(F.substring(F.coalesce(F.col(text), F.lit("")), 1, 200), F.lit("...")).alias("original_text"),
        F.col("adjusted_sla_deadline").alias("adjusted_deadline"), ts_literal(as_of).alias("timestamp"),
        F.lit(True).alias("action_required"), critical.alias("escalation_needed"),
        F.concat(level, F.lit(" SLA Breach Risk - "), F.col(key).cast("string"), F.lit(" ("), known("priority"), F.lit(")")).alias("subject"),
        F.when(critical, "YES - IMMEDIATE").otherwise("YES - URGENT").alias("action_text"))


def quicksight_flags(df: DataFrame, revenue: str = "revenue_impact", p: str = "breach_probability",
                     numeric: bool = False) -> DataFrame:
    """Dashboard flags.  The dashboard compared numbers rendered as *strings*
    (lexicographic: '85000.00' > '100000' is true).  Numbers are rendered in fixed
    point (2 places for money, 6 for probabilities) so the text is engine-independent;
    ``numeric=True`` gives the numeric comparison instead."""
    if numeric:
        crit = F.col(revenue) > 100000
        high, med = F.col(p) > 0.7, F.col(p) > 0.3
    else:
        rs, ps = F.format_string("%.2f", F.col(revenue)), F.format_string("%.6f", F.col(p))
        crit = rs > F.lit("100000")
        high, med = ps > F.lit("0.7"), ps > F.lit("0.3")
    return (df.withColumn("is_critical", F.when(crit, F.lit("Critical")).otherwise(F.lit("Normal")))
            .withColumn("risk_level", F.when(high, F.lit("High Risk")).when(med, F.lit("Medium Risk"))
                        .otherwise(F.lit("Low Risk"))))


def actions_for_rules(rule_rows, p: str, category: str = "category", priority: str = "priority",
                      text_lower: Column | None = None) -> Column:
    """Recommended-action array for one of the rule tables in ``rules``."""
    return actions_for(rule_rows, p, category, SqlText(f"coalesce(`{priority}`, {R.DEFAULT_PRIORITY})"),
                       text_lower)


def time_to_breach_col(df: DataFrame, p: str = "breach_probability") -> DataFrame:
    return df.withColumn("time_to_breach", time_to_breach(F.col(p), F.col("response_remaining"),
                                                          F.col("resolution_remaining")))


def ladder_col(value: Column, steps, default) -> Column:
    return ladder(value, steps, default)


def clamp01(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def breach_features_text(tickets: DataFrame, text_col: str = "text", as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Numeric features of text-born tickets.  Department and service codes are
    stable hashes (first 32 bits of MD5) mod 100 / 50; the source used Python's salted
    ``hash``, so only the shape of those two columns is comparable."""
    now = ts_literal(as_of)
    code = lambda c, m: F.pmod(F.conv(F.substring(F.md5(F.col(c)), 1, 8), 16, 10).cast("bigint"), F.lit(m))  # noqa
    return (tickets
            .withColumn("priority_numeric", lookup(F.col("priority"), R.PRIORITY_SCORE, R.PRIORITY_SCORE_DEFAULT))
            .withColumn("department_encoded", code("department", 100))
            .withColumn("service_type_encoded", code("service_type", 50))
            .withColumn("hour_created", F.hour(now))
            .withColumn("day_of_week", F.weekday(now))
            .withColumn("message_length", F.length(F.col(text_col)))
            .withColumn("location_specified", (F.col("location") != R.LOCATION_NONE).cast("int")))


def breach_features_8(scored: DataFrame, revenue: str = "revenue_impact",
                      customers: str | None = None) -> DataFrame:
    """The 8-value vector of the business-weighted scorer (revenue / 100000,
    customers / 10000; absent customer counts are 0)."""
    cust = F.col(customers).cast("double") if customers else F.lit(0.0)
    return scored.withColumn("features_8", F.array(
        F.coalesce(F.col("priority"), F.lit(R.DEFAULT_PRIORITY)).cast("double"),
        (F.col("status") == "open").cast("double"),
        (F.col("category") == "infrastructure").cast("double"),
        F.col("elapsed_minutes").cast("double"),
        F.col("breach_probability").cast("double"),
        F.coalesce(F.col(revenue), F.lit(0.0)) / 100000.0,
        cust / 10000.0,
        (F.col("customer_impact") == "critical").cast("double")))
