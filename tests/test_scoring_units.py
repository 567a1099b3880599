"""Hand-computed cases (FIXTURES section 4) and small semantic checks."""

import math

from pyspark.sql import functions as F

from servicelens.functions import rules as R
from servicelens.functions.columns import title_case, time_to_breach
from servicelens.operators import licenses, procurement, scoring

AS_OF = "2024-02-01 00:00:00"


def _tickets(spark, rows):
    df = spark.createDataFrame(rows, "ticket_id string, priority int, status string, category string, "
                                     "minutes_old int, description string, customer_impact string")
    return df.withColumn("created_at", F.lit(AS_OF).cast("timestamp_ntz")
                         - F.make_dt_interval(F.lit(0), F.lit(0), F.col("minutes_old")))


def test_p3_open_45_minutes(spark):
    t = _tickets(spark, [("T1", 3, "open", "hardware", 45, "", "standard")])
    r = scoring.sla_metrics(t, AS_OF).first()
    assert math.isclose(r.response_risk, 0.1875)
    assert math.isclose(r.resolution_risk, 0.03125)
    assert math.isclose(r.breach_probability, 0.140625)
    assert r.breach_bucket == "minimal" and r.sla_status == "HEALTHY"


def test_p1_in_progress_10_minutes(spark):
    t = _tickets(spark, [("T2", 1, "in_progress", "software", 10, "", "standard")])
    r = scoring.sla_metrics(t, AS_OF).first()
    assert math.isclose(r.breach_probability, 0.3 * (10 / 15) + 0.7 * (10 / 240))


def test_unknown_priority_uses_p3_and_resolved_is_zero(spark):
    t = _tickets(spark, [("T3", 5, "open", "network", 45, "", "standard"),
                         ("T4", None, "resolved", "network", 999, "", "standard")])
    rows = {r.ticket_id: r for r in scoring.sla_metrics(t, AS_OF).collect()}
    assert rows["T3"].response_threshold == 240.0 and rows["T3"].resolution_threshold == 1440.0
    assert rows["T4"].breach_probability == 0.0


def test_heuristic_fallback_prediction(spark):
    df = spark.createDataFrame([("P", 1, "in_progress", "hardware", 0.85, 5.0, 30.0)],
                               "ticket_id string, priority int, status string, category string, "
                               "breach_probability double, response_remaining double, resolution_remaining double")
    r = scoring.combine_predictions(scoring.heuristic_breach(df)).first()
    assert r.ml_probability == 0.9 and r.ml_confidence == 0.6
    assert math.isclose(r.final_breach_probability, 0.85 * 0.4 + 0.9 * 0.6)
    assert r.time_to_breach == 15
    assert r.priority_boost and r.new_priority == 1


def test_time_to_breach_truncates_like_int(spark):
    df = spark.createDataFrame([(0.95, 57.0, 100.0), (0.75, 7.0, 9.0), (0.55, 200.0, 300.0), (0.2, 10.9, 20.0)],
                               "p double, a double, b double")
    got = [r.t for r in df.select(time_to_breach(F.col("p"), F.col("a"), F.col("b")).alias("t")).collect()]
    assert got == [max(5, int(57 * 0.1)), max(15, int(7 * 0.3)), max(30, int(200 * 0.5)), int(10.9)]


def test_actions_are_ordered_and_distinct(spark):
    df = spark.createDataFrame([(0.95, "infrastructure", 1)], "p double, category string, priority int")
    acts = df.select(scoring.actions_for_rules(R.ACTIONS_CRITICAL, "p", text_lower=F.lit("revenue"))
                     .alias("a")).first().a
    assert acts[:3] == ["escalate-immediately", "notify-manager", "trigger-incident-response"]
    assert len(acts) == len(set(acts))
    assert "monitor-system-health" in acts and "notify-business-continuity-team" in acts


def test_title_case_matches_python(spark):
    samples = ["o'neil john.doe", "user 13", "ÉCOLE du-monde", "x", "", "a1b2 c"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r.t for r in df.select(title_case(F.col("s")).alias("t")).collect()]
    assert got == [s.title() for s in samples]


def test_license_lic001_case(spark):
    lic = spark.createDataFrame([(1, "Tool", "V", 100, 45, 1200.0, "2024-03-01", "IT")],
                                "asset_id long, name string, vendor string, total_licenses long, used_licenses long, "
                                "cost_per_license double, renewal_date string, department string")
    r = licenses.underutilized(lic).first()
    assert r.waste_cost_annual == (55 * 1200) * 12 == 792000
    assert r.recommended_count == 54


def test_finance_approval_case(spark):
    rec = spark.createDataFrame([("R1", "LICENSE_REDUCTION", 576000.0)],
                                "recommendation_id string, recommendation_type string, potential_savings double")
    req = rec.withColumn("estimated_value", F.col("potential_savings"))
    r = procurement.finance_approval(req).first()
    assert r.implementation_cost == 28800 and r.net_benefit == 547200
    assert r.payback_period_months == 1 and math.isclose(r.roi_percentage, 1900.0)
    assert r.approval_level == "LEVEL_2_FINANCE_DIRECTOR" and len(r.approvers) == 2


def test_quote_commercial_band(spark):
    q = spark.createDataFrame([(1, "1-1", 1, "V", 100.0, True, True, True, False, False),
                               (1, "1-2", 2, "W", 0.0, True, True, True, True, True)],
                              "bid_request_id long, quote_id string, quote_seq int, vendor_name string, "
                              "total_price double, iso_certified boolean, soc2_compliant boolean, api_support boolean, "
                              "sso_integration boolean, audit_logging boolean")
    s = {r.quote_id: r for r in procurement.score_quotes(q).collect()}
    assert s["1-1"].commercial_score == 80 and s["1-1"].technical_score == 60
    assert s["1-2"].commercial_score == 100 and s["1-2"].recommendation == "ACCEPT"
    w = procurement.quote_summary(procurement.score_quotes(q)).first()
    assert w.winner.quote_id == "1-2" and w.qualified_quotes == 2
