"""Raw feeds derived from the driver tables: the record shapes the decoders in
``ingest`` consume (change records, queue bodies, envelopes, bus events, CSV-like text,
stored AI responses).  All are narrow projections of the derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .tables import read_table

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def _ticket_json(t: DataFrame):
    return F.to_json(F.struct(
        "ticket_id", "title", "description", "status", F.col("priority").cast("string").alias("priority"),
        "category", F.date_format("created_at", ISO).alias("created_at")))


def change_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value change records: INSERT / MODIFY / REMOVE by key; every 7th ticket
    lacks priority and category (defaults apply)."""
    t = fx.tickets(spark, sf_dir)
    k = F.col("order_key")
    attr_s = lambda c: F.struct(c.cast("string").alias("S"), F.lit(None).cast("string").alias("N"))
    attr_n = lambda c: F.struct(F.lit(None).cast("string").alias("S"), c.cast("string").alias("N"))
    image = F.create_map(
        F.lit("ticket_id"), attr_s(F.col("ticket_id")), F.lit("title"), attr_s(F.col("title")),
        F.lit("description"), attr_s(F.col("description")), F.lit("priority"), attr_n(F.col("priority")),
        F.lit("status"), attr_s(F.col("status")), F.lit("category"), attr_s(F.col("category")),
        F.lit("created_at"), attr_s(F.date_format("created_at", ISO)))
    omit = F.pmod(k, F.lit(7)) == 0
    image = F.map_filter(image, lambda key, v: ~(omit & key.isin("priority", "category")))
    event = F.element_at(F.array(F.lit("INSERT"), F.lit("MODIFY"), F.lit("REMOVE")), (F.pmod(k, F.lit(3)) + 1).cast("int"))
    return t.select("order_key", F.to_json(F.struct(event.alias("eventName"),
                                                   F.struct(image.alias("NewImage")).alias("dynamodb"))).alias("value"))


def queue_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue messages: wrapped in {"ticket": ...}, bare, or not JSON at all."""
    t = fx.tickets(spark, sf_dir)
    k = F.pmod(F.col("order_key"), F.lit(3))
    js = _ticket_json(t)
    body = (F.when(k == 0, F.concat(F.lit('{"ticket": '), js, F.lit("}")))
            .when(k == 1, js).otherwise(F.concat(F.lit("not json: "), F.col("ticket_id"))))
    return t.select("order_key", body.alias("body"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three envelope shapes: queue batch, bus event, bare ticket."""
    t = fx.tickets(spark, sf_dir)
    k = F.pmod(F.col("order_key"), F.lit(3))
    js = _ticket_json(t)
    value = (F.when(k == 0, F.to_json(F.struct(F.array(F.struct(js.alias("body"))).alias("Records"))))
             .when(k == 1, F.concat(F.lit('{"source": "sla-monitor", "detail-type": "Ticket", "detail": '), js,
                                    F.lit("}")))
             .otherwise(js))
    return t.select("order_key", value.alias("value"))


def bus_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bus envelopes from status events: L1 completions (status / impact sometimes
    missing) and licence changes (success sometimes missing)."""
    e = fx.status_events(spark, sf_dir)
    drop = F.pmod(F.col("event_id"), F.lit(4)) == 0
    l1 = F.to_json(F.struct(F.concat(F.lit("S-"), F.col("service_id").cast("string")).alias("ticket_id"),
                            F.when(~drop, F.col("task_status")).alias("status"), "execution_time",
                            F.when(~drop, F.col("sla_impact")).alias("sla_impact")))
    lc = F.to_json(F.struct(F.array(F.col("service_id").cast("string")).alias("affected_services"),
                            F.lit("license_reduction").alias("change_type"),
                            F.when(~drop, F.col("success")).alias("success")))
    detail = F.when(F.col("detail_type") == "L1 Task Completion", l1).otherwise(lc)
    src = F.when(F.col("detail_type").startswith("L1"), F.lit("l1-automation")).otherwise(F.lit("asset-optimizer"))
    value = F.concat(F.lit('{"source": "'), src, F.lit('", "detail-type": "'), F.col("detail_type"),
                     F.lit('", "detail": '), detail, F.lit("}"))
    return e.select("event_id", value.alias("value"))


BUS_TYPES = ["L1 Task Completion", "L1 Task Started", "L1 Task Failed", "Optimization Impact Assessment", "License Change Completed",
             "Metric Update", "SLA Breach Prediction", "Optimization Recommendation", "License Change Request", "Heartbeat"]


def bus_detail_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bus envelopes of every detail type, one per driver event: the type goes by the event id, the last type has no
    handler; every fourth envelope has an empty detail (defaults apply)."""
    e = read_table(spark, sf_dir, "events", ["event_id", "user_id", "value"])
    n, s = F.col("event_id"), F.col("event_id").cast("string")
    who = F.concat(F.lit("T-"), F.col("user_id").cast("string"))
    level = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.pmod(n, F.lit(3)) + 1).cast("int"))
    two = F.array(F.concat(F.lit("S"), s), F.lit("S0"))
    half = F.pmod(n, F.lit(2)) / F.lit(2.0)
    flag = F.pmod(n, F.lit(2)) == 0
    details = [
        F.struct(who.alias("ticket_id"), F.lit("partial").alias("status"), n.alias("execution_time"), F.lit("neutral").alias("sla_impact")),
        F.struct(who.alias("ticket_id"), F.lit("reset").alias("task_type"), F.pmod(n, F.lit(50)).alias("estimated_duration")),
        F.struct(who.alias("ticket_id"), F.lit("timeout").alias("failure_reason"), flag.alias("retry_recommended")),
        F.struct(s.alias("optimization_id"), two.alias("affected_services"), level.alias("impact_level")),
        F.struct(two.alias("affected_services"), F.lit("license_removal").alias("change_type"), flag.alias("success")),
        F.struct(who.alias("ticket_id"), F.lit(1).alias("priority"), F.lit("in_progress").alias("status"), F.lit("network").alias("category"),
                 half.alias("breach_probability"), (half + 7).alias("response_remaining_minutes"), (half + 9).alias("resolution_remaining_minutes")),
        F.struct(who.alias("ticket_id"), half.alias("breach_probability"), F.lit(0.5).alias("confidence"), F.lit(12).alias("time_to_breach"),
                 F.array(F.lit("send-reminder")).alias("recommended_actions"), flag.alias("priority_boost"), F.lit("access").alias("category"),
                 F.lit(2).alias("current_priority")),
        F.struct(s.alias("optimization_id"), F.lit("license_reduction").alias("optimization_type"), two.alias("affected_assets"),
                 (half + 100).alias("potential_savings"), F.array(F.lit("merge")).alias("proposed_changes")),
        F.struct(s.alias("change_id"), F.lit("license_upgrade").alias("change_type"), two.alias("affected_services"),
                 F.create_map(F.lit("seats"), F.lit("10")).alias("license_details")),
        F.struct(who.alias("ticket_id")),
    ]
    kind = F.pmod(n, F.lit(len(BUS_TYPES)))
    filled = F.coalesce(*[F.when(kind == i, F.to_json(d)) for i, d in enumerate(details)])
    detail = F.when(F.pmod(F.floor(n / 10), F.lit(4)) == 0, F.lit("{}")).otherwise(filled)
    name = F.element_at(F.array(*[F.lit(t) for t in BUS_TYPES]), (kind + 1).cast("int"))
    return e.select("event_id", F.concat(F.lit('{"source": "bus", "detail-type": "'), name, F.lit('", "detail": '), detail, F.lit("}")).alias("value"))


def typed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV-like text columns: revenue as text ('n/a' for every 13th), created as
    'yyyy-MM-dd HH:mm:ss' ('N/A' for every 17th)."""
    t = fx.tickets(spark, sf_dir)
    k = F.col("order_key")
    return t.select("ticket_id",
                    F.when(F.pmod(k, F.lit(13)) == 0, F.lit("n/a")).otherwise(F.col("revenue_impact").cast("string"))
                    .alias("revenue_impact"),
                    F.when(F.pmod(k, F.lit(17)) == 0, F.lit("N/A"))
                    .otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).alias("created_date"))


def ai_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored AI responses: the core analysis as JSON, damaged by key into five shapes:
    valid, trailing text, a missing comma, a code fence, and no JSON at all."""
    from ..operators import text
    a = text.analyze_core(fx.text_tickets(spark, sf_dir))
    js = F.to_json(F.struct(
        F.struct("department", "priority", "category", "urgency_score",
                 F.lit("department").alias("impact_scope")).alias("analysis_summary"),
        F.struct(F.col("estimated_resolution_hours").alias("estimated_resolution_time_hours"))
        .alias("technical_assessment")))
    shape = F.pmod(F.col("id"), F.lit(5))
    raw = (F.when(shape == 0, js)
           .when(shape == 1, F.concat(js, F.lit("\n\nLet me know if you need anything else.")))
           .when(shape == 2, F.regexp_replace(js, ',"priority"', ' "priority"'))
           .when(shape == 3, F.concat(F.lit("Here is the analysis:\n```json\n"), js, F.lit("\n```")))
           .otherwise(F.format_string("Department: %s. Priority %s. Category %s. Urgency score %d.",
                                      "department", "priority", "category", "urgency_score")))
    return a.select("id", raw.alias("raw"))


def sectioned_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that leave sections out: of the required ones, section k stands in reply i unless 3 divides i + k; every
    11th object is empty, odd replies have words behind it, every 13th has no object."""
    from ..operators.responses import REQUIRED_SECTIONS
    d = read_table(spark, sf_dir, "documents", ["doc_id"])
    i = F.col("doc_id")
    there = [F.when((F.pmod(i + k, F.lit(3)) != 0) & (F.pmod(i, F.lit(11)) != 0), F.lit(f'"{name}": {{"seen": {k}}}'))
             for k, name in enumerate(REQUIRED_SECTIONS)]
    js = F.concat(F.lit("{"), F.concat_ws(", ", *there), F.lit("}"))
    raw = (F.when(F.pmod(i, F.lit(13)) == 12, F.lit("Department: UIDAI, no more to say"))
           .when(F.pmod(i, F.lit(2)) == 0, js).otherwise(F.concat(js, F.lit(" That is all."))))
    return d.select(i.alias("id"), raw.alias("raw"))


def recommendation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AI recommendation replies, one per under-used asset: free text around an object with
    ``recommendations`` - a reduction (no title, no priority, months 4) and a renewal review (only title,
    description, type and priority).  Every 5th reply has no object, every 7th one that does not parse."""
    from ..operators import licenses
    u = licenses.underutilized(fx.licenses(spark, sf_dir))
    first = F.to_json(F.struct(
        F.format_string("Reduce %s licenses by %d unused licenses", "name", "unused_licenses").alias("description"),
        F.col("waste_cost_annual").alias("potential_savings"), F.lit("LOW").alias("implementation_effort"),
        F.lit(0.85).alias("confidence"), F.lit(False).alias("gem_integration_required"),
        F.lit(4).alias("timeline_months"), F.lit("MEDIUM").alias("risk_level")))
    second = F.to_json(F.struct(F.lit("RENEWAL_OPTIMIZATION").alias("type"), F.lit("Renewal review").alias("title"),
                                F.format_string("Review the renewal terms of %s", "name").alias("description"),
                                F.lit("LOW").alias("priority")))
    whole = F.concat(F.lit('Here are my recommendations:\n{"recommendations": ['), first, F.lit(", "), second, F.lit("]}\nRegards"))
    i = F.col("asset_id")
    reply = (F.when(F.pmod(i, F.lit(5)) == 0, F.concat(F.lit("No savings found for "), F.col("name")))
             .when(F.pmod(i, F.lit(7)) == 0, F.concat(F.lit('{"recommendations": ['), first, F.lit(" oops }")))
             .otherwise(whole))
    return u.select("asset_id", reply.alias("reply"))


def prediction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored breach-prediction replies, one per ticket, from the batch prediction: the nested
    object with every field, with the probability only (defaults apply), or inside text; and three free texts
    ('72% probability of breach, confidence: 80%', a chance as a fraction, no number at all)."""
    from ..operators import scoring
    p = scoring.predict(fx.tickets(spark, sf_dir))
    fp = F.col("final_breach_probability")
    hours = (F.floor(F.least("response_remaining", "resolution_remaining") / 60) + 1).cast("bigint")
    risk = F.struct(fp.alias("breach_probability"), F.lit(0.6).alias("confidence_level"), F.lit("HIGH").alias("risk_level"))
    full = F.to_json(F.struct(risk.alias("breach_risk_assessment"),
                              F.struct(hours.alias("estimated_resolution_hours")).alias("timeline_prediction")))
    part = F.to_json(F.struct(F.struct(fp.alias("breach_probability")).alias("breach_risk_assessment")))
    percent = F.format_string("There is a %d%% probability of breach, confidence: 80%%. Expect %d hours of work.",
                              F.floor(fp * 100).cast("bigint"), F.abs(hours))
    k = F.pmod(F.col("order_key"), F.lit(6))
    raw = (F.when(k == 0, full).when(k == 1, part).when(k == 2, F.concat(F.lit("Sure. "), full, F.lit(" Done.")))
           .when(k == 3, percent).when(k == 4, F.lit("I see a 0.35 chance that it slips; risk 90 is too high a guess."))
           .otherwise(F.lit("Hard to say. 0 hours were logged.")))
    return p.select(F.col("order_key").alias("id"), raw.alias("raw"))


# Submitted value and the value it is reduced to, written by hand from the rules of the form
FORM_DEPARTMENTS = [("UIDAI|MeitY", "UIDAI"), ("|UIDAI", ""), (" eDistrict , UIDAI", "eDistrict"), ("MeitY/UIDAI", "MeitY/UIDAI"),
                    ("DigitalMP", "DigitalMP"), ("Unknown dept|UIDAI", "Unknown dept"), (None, None)]
FORM_CATEGORIES = [("Network, Payment", "Payment"), ("Foo|Bar", "Other"), ("Foo|Integration", "Integration"), ("Portal/Payment", "Portal/Payment"),
                   ("Foo", "Foo"), ("Other | Certificate|Network", "Certificate"), ("payment|x", "Other"), ("", ""), (None, None),
                   ("Authentication|Other", "Authentication"), ("Portal,", "Portal")]
FORM_PRIORITIES = [("P3|P1", "P1"), ("P1 - critical, P3", "P1"), ("x|y", "P3"), ("P4, P2 (high)", "P2"), ("P2/P1", "P2/P1"), ("urgent", "urgent"),
                   ("P4|P4", "P4"), ("P2P1|P3", "P1"), (None, None), ("|", "P3"), ("P3 or P4|none", "P3"), ("P4|low", "P4"), ("p1|p2", "P3")]
FORM_SCOPES = [("regional|statewide", "statewide"), ("galaxy|planet", "single_user"), ("department, single_user", "department"),
               ("regional/statewide", "regional/statewide"), ("critical_infrastructure|x", "critical_infrastructure"), ("planet", "planet"),
               (None, None), ("single_user|department", "department")]


def multiselect_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form submissions, one per text ticket: each field takes the submitted value at its id's place in
    the lists above (of coprime lengths, so that the combinations vary)."""
    i = F.col("id")

    def pick(values: list[tuple]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v, _ in values]), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))

    return fx.text_tickets(spark, sf_dir).select(
        "id", pick(FORM_DEPARTMENTS).alias("department"), pick(FORM_CATEGORIES).alias("category"),
        pick(FORM_PRIORITIES).alias("priority"), pick(FORM_SCOPES).alias("impact_scope"))
