"""Text-born tickets: keyword classifiers, extraction and ticket building (H1-H13, H20-H21,
B7, B17-B21).

All rule sets compile to native ``contains``/``CASE`` expressions over one
lower-cased copy of the text (computed once per row in its own projection), so a
text never leaves the JVM and whole documents are matched, never prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_AS_OF
from ..functions import rules as R
from ..functions import keywords as K
from ..functions.columns import (KEYWORD_INDEX, as_col, contains_any, first_match, lookup, present, scored_match,
                                 sql_contains, sql_lit, sql_present, sql_ref, title_case, ts_literal)
from .util import computed_once

LT = "_lt"  # lower-cased text column used by the classifiers
LT_HITS = "_lt_hits"  # keyword ids present in it (``functions.keywords``)
if K.AVAILABLE:
    KEYWORD_INDEX[f"`{LT}`"] = f"`{LT_HITS}`"


def with_lower(df: DataFrame, text: str | Column) -> DataFrame:
    """Lower-case the text once and, when available, index every rule keyword in it in
    one pass (emitted through ``computed_once``: a filter on a classifier result must
    not re-run the index below the projection)."""
    d = df.withColumn(LT, F.lower(as_col(text)))
    if K.AVAILABLE:
        d = computed_once(d, **{LT_HITS: K.keyword_hits(F.col(LT))})
    return d


def locations_all(text_lower: Column, gazetteer=R.GAZETTEER) -> Column:
    """H4: every gazetteer hit in list order, title case, ', '-joined, or 'Not specified'."""
    ref, ls = sql_ref(text_lower), [(sql_lit(g), sql_lit(g.title())) for g in gazetteer]
    none = sql_lit(R.LOCATION_NONE)
    if ref is not None and none is not None and all(a and b for a, b in ls):
        hits = sql_present([(sql_contains(ref, g), b) for g, (a, b) in zip(gazetteer, ls)])
        return F.expr(f"CASE WHEN size({hits}) > 0 THEN array_join({hits}, ', ') ELSE {none} END")
    hits = present([(text_lower.contains(loc), F.lit(loc.title())) for loc in gazetteer])
    return F.when(F.size(hits) > 0, F.array_join(hits, ", ")).otherwise(F.lit(R.LOCATION_NONE))


def location_first(text_lower: Column, gazetteer=R.LOCATIONS_NLAPI) -> Column:
    """H4 first-hit variant."""
    ref, ls = sql_ref(text_lower), [(sql_lit(g), sql_lit(g.title())) for g in gazetteer]
    none = sql_lit(R.LOCATION_NONE)
    if ref is not None and none is not None and all(a and b for a, b in ls):
        whens = " ".join(f"WHEN {sql_contains(ref, g)} THEN {b}" for g, (a, b) in zip(gazetteer, ls))
        return F.expr(f"CASE {whens} ELSE {none} END")
    expr = None
    for loc in gazetteer:
        c = text_lower.contains(loc)
        expr = F.when(c, F.lit(loc.title())) if expr is None else expr.when(c, F.lit(loc.title()))
    return expr.otherwise(F.lit(R.LOCATION_NONE))


def sentiment(text_lower: Column, negative=R.SENTIMENT_NEGATIVE, positive=R.SENTIMENT_POSITIVE) -> Column:
    """H5: negative words first, then positive words, else neutral."""
    return (F.when(contains_any(text_lower, negative), F.lit("negative"))
            .when(contains_any(text_lower, positive), F.lit("positive"))
            .otherwise(F.lit("neutral")))


def urgency_level_from_priority(priority: Column) -> Column:
    """H6 (priority form)."""
    return (F.when(priority == "P1", F.lit("critical")).when(priority == "P2", F.lit("high"))
            .when(priority == "P4", F.lit("low")).otherwise(F.lit("medium")))


def urgency_level_from_words(text_lower: Column) -> Column:
    """H6 (word form)."""
    return F.when(contains_any(text_lower, R.URGENCY_LEVEL_WORDS), F.lit("high")).otherwise(F.lit("normal"))


def urgency_score(text_lower: Column) -> Column:
    """H3: max(base 5, weight of every present word), at most 10."""
    ref = sql_ref(text_lower)
    ls = [(sql_lit(w), sql_lit(v)) for w, v in R.URGENCY_WORDS]
    base, top = sql_lit(R.URGENCY_BASE), sql_lit(R.URGENCY_MAX)
    if ref is not None and base and top and all(a and b for a, b in ls):
        ws = ", ".join(f"CASE WHEN {sql_contains(ref, w)} THEN {b} ELSE {base} END"
                       for (w, _), (a, b) in zip(R.URGENCY_WORDS, ls))
        return F.expr(f"least(greatest({base}, {ws}), {top})")
    weights = [F.when(text_lower.contains(w), F.lit(v)).otherwise(F.lit(R.URGENCY_BASE)) for w, v in R.URGENCY_WORDS]
    return F.least(F.greatest(F.lit(R.URGENCY_BASE), *weights), F.lit(R.URGENCY_MAX))


def is_support_request(subject_lower: Column, body_lower: Column, keywords) -> Column:
    """H7: any support keyword in subject or body."""
    return contains_any(subject_lower, keywords) | contains_any(body_lower, keywords)


def affected_users(text_lower: Column) -> Column:
    """H12."""
    return F.when(contains_any(text_lower, R.AFFECTED_USERS_WORDS), F.lit("multiple")).otherwise(F.lit("single"))


def priority_reason(priority: Column, text_lower: Column) -> Column:
    """Reason text by priority and words."""
    p1 = (F.when(contains_any(text_lower, ["critical"]), F.lit("Critical keyword detected"))
          .when(contains_any(text_lower, ["urgent"]), F.lit("Urgent keyword detected"))
          .when(contains_any(text_lower, ["failing", "down"]), F.lit("Service failure indicators"))
          .otherwise(F.lit("High severity indicators")))
    return (F.when(priority == "P1", p1).when(priority == "P2", F.lit("High importance indicators"))
            .when(priority == "P4", F.lit("Low priority indicators"))
            .otherwise(F.lit("Standard issue classification")))


def ticket_suffix(key: Column) -> Column:
    """Deterministic 4-character id suffix (replaces a random uuid)."""
    return F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 4))


# ---------------------------------------------------------------------------
# Chat path: analyse, then build the production ticket (H2/H1/H4/H5/H6 + H8)
# ---------------------------------------------------------------------------

def analyze_chat(df: DataFrame, text: str = "text") -> DataFrame:
    d = with_lower(df, text)
    lt = F.col(LT)
    return (d.withColumns({
        "department": scored_match(lt, R.DEPARTMENT_SCORED_CHAT, R.DEPARTMENT_DEFAULT),
        "priority": first_match(lt, R.PRIORITY_CHAT, R.PRIORITY_DEFAULT),
        "service_type": first_match(lt, R.SERVICE_CHAT, R.SERVICE_DEFAULT),
        "location": locations_all(lt),
        "sentiment": sentiment(lt),
    }).withColumns({  # reads the priority just classified
        "urgency_level": urgency_level_from_priority(F.col("priority")),
        "confidence_score": F.lit(0.92),
    }))


def classify_intakes(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """H1: the classifiers of the other intakes (``rules.INTAKE_CLASSIFIERS``) over one keyword pass: a row per
    text and intake with ``priority``, ``department``, ``service_type`` (null where an intake has no such rules)."""
    d = with_lower(df.select(key, text), text)
    lt = F.col(LT)

    def value(field: tuple) -> Column:
        rule_set, default = field
        return first_match(lt, rule_set, default) if rule_set else F.lit(default).cast("string")

    rows = F.array(*[F.struct(F.lit(name).alias("intake"), *[as_col(value(fields[c])).alias(c) for c in ("priority", "department", "service_type")])
                     for name, fields in R.INTAKE_CLASSIFIERS.items()])
    city = F.coalesce(*[F.when(lt.contains(c), F.lit(True)) for c in R.MAJOR_CITIES], F.lit(False))
    return d.select(key, city.alias("major_city"), F.inline(rows))


def build_intake_tickets(classified: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """H8: the tickets of ``rules.INTAKE_TICKETS`` from ``classify_intakes`` rows: probability (capped, a major city
    counts where the intake says so), revenue, deadline, tier, status, source, confidence and department."""
    prio, svc, now = F.col("priority"), F.col("service_type"), ts_literal(as_of)

    def fields(t: dict) -> Column:
        factor = F.when(F.col("major_city"), F.lit(t["city"])).otherwise(F.lit(1.0))
        by_service = lambda m: lookup(svc, m, 1.0) if m else F.lit(1.0)
        p = F.least(F.lit(R.TEXT_PROBABILITY_CAP), lookup(prio, t["probability"], 0.45) * by_service(t["service_probability"]) * factor)
        return F.struct(
            (F.round(p, 3) if t["source"] == "email" and t["status"] == "new" else p).alias("breach_probability"),
            (lookup(prio, t["revenue"], 50000) * by_service(t["service_revenue"])).cast("bigint").alias("revenue_impact"),
            (now + F.make_dt_interval(F.lit(0), lookup(prio, t["hours"], 24).cast("int"))).alias("sla_deadline"),
            lookup(prio, t["tier"], "Silver").alias("customer_tier"), F.lit(t["status"]).alias("status"), F.lit(t["source"]).alias("source"),
            F.lit(t["confidence"]).cast("double").alias("confidence_score"),
            (lookup(svc, t["department"], "General Support") if "department" in t else F.col("department")).alias("ticket_department"))

    ticket = F.coalesce(*[F.when(F.col("intake") == n, fields(t)) for n, t in R.INTAKE_TICKETS.items()])
    rows = classified.filter(F.col("intake").isin(*R.INTAKE_TICKETS))
    return computed_once(rows, _t=ticket).select(*rows.columns, "_t.*")


def build_chat_ticket(analysed: DataFrame, key: str = "id", as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """H8: deadline, probability, revenue, tier, business impact, region, id."""
    prio, svc, loc = F.col("priority"), F.col("service_type"), F.col("location")
    hours = lookup(prio, R.TEXT_SLA_HOURS, 24)
    base_p = lookup(prio, R.TEXT_BASE_PROBABILITY, 0.45)
    svc_mult = lookup(svc, R.TEXT_SERVICE_MULTIPLIER, 1.0)
    city = contains_any(loc, R.TEXT_HIGH_RISK_CITIES)
    loc_mult = F.when(city, F.lit(R.TEXT_CITY_MULTIPLIER)).otherwise(F.lit(1.0))
    base_rev = lookup(prio, R.TEXT_BASE_REVENUE, 50000)
    now = ts_literal(as_of)
    deadline = now + F.make_dt_interval(F.lit(0), hours.cast("int"))
    revenue = (base_rev * svc_mult * loc_mult).cast("bigint")
    # every column reads only input columns: one projection, one analysis pass
    return analysed.withColumns({
        "ticket_id": F.concat_ws("-", F.col("department"), prio, F.date_format(now, "yyMMdd"),
                                 F.date_format(now, "HHmm"), ticket_suffix(F.col(key))),
        "sla_hours": hours,
        "sla_deadline": deadline,
        "sla_due_time": F.date_format(deadline, "hh:mm a"),
        "breach_probability": F.least(F.lit(R.TEXT_PROBABILITY_CAP), base_p * svc_mult * loc_mult),
        "revenue_impact": revenue,
        "business_impact": F.when(revenue > 100000, F.lit("high"))
        .when(revenue > 50000, F.lit("medium")).otherwise(F.lit("low")),
        "customer_tier": lookup(prio, R.CUSTOMER_TIER, "Silver"),
        "issue_category": F.regexp_replace(svc, "-", "_"),
        "affected_region": F.when(loc.contains(","), F.split(loc, ",").getItem(0)).otherwise(loc),
        "geographic_scope": F.when(loc != R.LOCATION_NONE, F.lit("city")).otherwise(F.lit("unknown")),
        "business_hours_created": F.hour(now).between(9, 17),
        "production_flow": production_flow(prio),
    })


def production_flow(priority: Column) -> Column:
    """The eight flow flags, set by what this pipeline does for the ticket:
    stored, evented, scored, archived always; workflow for P1/P2 (B34); alerts for P1."""
    return F.struct(
        F.lit(True).alias("dynamodb_stored"),
        F.lit(True).alias("eventbridge_triggered"),
        F.lit(True).alias("sagemaker_analyzed"),
        priority.isin("P1", "P2").alias("stepfunctions_started"),
        (priority == "P1").alias("alerts_sent"),
        F.lit(True).alias("quicksight_updated"),
        F.lit(True).alias("s3_archived"),
        F.lit(False).alias("retraining_triggered"),
    )


def steps_completed(flow: Column) -> Column:
    """Number of true flags among the eight flow steps (missing -> 0)."""
    return sum((F.coalesce(flow[s], F.lit(False)).cast("int") for s in R.FLOW_STEPS), F.lit(0))


# ---------------------------------------------------------------------------
# Natural-language API path (H1 nlapi, H10, H6 words, H4 first hit)
# ---------------------------------------------------------------------------

def analyze_nlapi(df: DataFrame, text: str = "text") -> DataFrame:
    d = with_lower(df, text)
    lt = F.col(LT)
    dept = first_match(lt, R.DEPARTMENT_NLAPI, R.DEPARTMENT_NLAPI_DEFAULT[0])
    return (d.withColumn("department", dept)
            .withColumn("department_confidence",
                        lookup(F.col("department"), R.DEPARTMENT_NLAPI_CONFIDENCE, R.DEPARTMENT_NLAPI_DEFAULT[1]))
            .withColumn("priority", first_match(lt, R.PRIORITY_NLAPI, R.PRIORITY_DEFAULT))
            .withColumn("priority_reason", lookup(F.col("priority"), R.PRIORITY_REASON_ANALYSIS,
                                                  R.PRIORITY_REASON_ANALYSIS_DEFAULT))
            .withColumn("priority_detail", priority_reason(F.col("priority"), lt))
            .withColumn("location", location_first(lt))
            .withColumn("service_type", first_match(lt, R.SERVICE_SHORT, R.SERVICE_DEFAULT))
            .withColumn("sentiment", sentiment(lt, R.SENTIMENT_NEGATIVE_NLAPI))
            .withColumn("urgency_level", urgency_level_from_words(lt))
            .withColumn("affected_users", affected_users(lt)))


# ---------------------------------------------------------------------------
# Core fallback analysis (H2 core, H1 core, category, H3, B19, H13)
# ---------------------------------------------------------------------------

def analyze_core(df: DataFrame, text: str = "text") -> DataFrame:
    d = with_lower(df, text)
    lt = F.col(LT)
    prio = F.col("priority")
    return (d.withColumns({
        "department": scored_match(lt, R.DEPARTMENT_SCORED_CORE, R.DEPARTMENT_DEFAULT),
        "priority": first_match(lt, R.PRIORITY_CORE, R.PRIORITY_DEFAULT),
        "category": first_match(lt, R.CATEGORY_CORE, R.CATEGORY_DEFAULT),
        "urgency_score": urgency_score(lt),
    }).withColumns({  # read the classes just computed
        "breach_probability": F.least(lookup(prio, R.ADDITIVE_BASE_RISK, 0.3) + F.col("urgency_score") / 10.0 * 0.3,
                                      F.lit(1.0)),
        "estimated_resolution_hours": lookup(prio, R.ADDITIVE_RESOLUTION_HOURS, 24),
        "acknowledgment": lookup(prio, R.RESPONSE_TEMPLATES, R.RESPONSE_TEMPLATES["P3"]),
        "expected_timeline": F.format_string("Resolution expected within %d hours", lookup(prio, R.RESPONSE_HOURS, 24)),
        "status_update": F.format_string("Your ticket has been routed to the %s support team.", F.col("department")),
    }))


def fallback_risk_variants(df: DataFrame, priority: str = "priority", urgency: str = "urgency_score") -> DataFrame:
    """Additive (priority base + .3 x urgency/10), the genai variant whose table
    lookup never hits (so always .3 + .2 x urgency/10), and the plain table."""
    prio, urg = F.col(priority), F.col(urgency)
    return (df
            .withColumn("risk_additive", F.least(lookup(prio, R.ADDITIVE_BASE_RISK, 0.3) + urg / 10.0 * 0.3, F.lit(1.0)))
            .withColumn("risk_genai", F.least(F.lit(0.3) + urg / 10.0 * 0.2, F.lit(1.0)))
            .withColumn("risk_table", lookup(prio, R.TABLE_RISK, 0.45))
            .withColumn("risk_table_hours", lookup(prio, R.TABLE_RISK_HOURS, 24)))


# ---------------------------------------------------------------------------
# 11-feature fallback predictor
# ---------------------------------------------------------------------------

def ml_features_11(df: DataFrame, as_of: str = DEFAULT_AS_OF, urgency: str = "urgency_score",
                   est_hours: str | None = None) -> DataFrame:
    now = ts_literal(as_of)
    hour, dow = F.hour(now), F.weekday(now)
    business = (hour >= 9) & (hour <= 17) & (dow < 5)
    sent = F.upper(F.col("sentiment"))
    return (df
            .withColumn("priority_score", lookup(F.col("priority"), R.PRIORITY_SCORE, R.PRIORITY_SCORE_DEFAULT))
            .withColumn("urgency", F.coalesce(F.col(urgency), F.lit(5)))
            .withColumn("sentiment_score", F.when(sent == "POSITIVE", F.lit(1)).when(sent == "NEGATIVE", F.lit(-1))
                        .otherwise(F.lit(0)))
            .withColumn("department_risk", lookup(F.col("department"), R.DEPARTMENT_RISK, R.DEPARTMENT_RISK_DEFAULT))
            .withColumn("hour_of_day", hour)
            .withColumn("day_of_week", dow)
            .withColumn("is_business_hours", business.cast("int"))
            .withColumn("business_hours_factor", F.when(business, F.lit(0.8)).otherwise(F.lit(1.2)))
            .withColumn("estimated_hours", F.col(est_hours) if est_hours else F.lit(24))
            .withColumn("bedrock_confidence", F.lit(0.5))
            .withColumn("comprehend_confidence", F.lit(0.5)))


def fallback_prediction(feats: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """B17 + B18: combined probability, clamped confidence, factors, adjusted deadline."""
    est = F.col("estimated_hours")
    pressure = (F.when(est <= 4, F.lit(1.4)).when(est <= 12, F.lit(1.2)).when(est <= 24, F.lit(1.0))
                .otherwise(F.lit(0.8)))
    sent_f = F.when(F.col("sentiment_score") == -1, F.lit(1.3)).when(F.col("sentiment_score") == 1, F.lit(0.9)) \
        .otherwise(F.lit(1.0))
    prio_risk = F.col("priority_score") / 4.0
    urg_f = F.col("urgency") / 10.0
    base = prio_risk * 0.3 + urg_f * 0.2 + F.col("department_risk") * 0.3
    adjusted = base * F.col("business_hours_factor") * sent_f * pressure
    conf = (F.col("bedrock_confidence") + F.col("comprehend_confidence")) / 200.0
    p = F.least(F.greatest(adjusted, F.lit(0.0)), F.lit(1.0))
    out = (feats.withColumn("ml_breach_probability", p)
           .withColumn("ml_confidence", F.least(F.greatest(conf, F.lit(0.6)), F.lit(0.9)))
           .withColumn("factors", F.struct(prio_risk.alias("priority_risk"), urg_f.alias("urgency_factor"),
                                           F.col("department_risk").alias("dept_risk"),
                                           F.col("business_hours_factor").alias("time_factor"),
                                           sent_f.alias("sentiment_factor"), pressure.alias("time_pressure_factor"))))
    hours = F.greatest(F.lit(4.0), F.lit(24.0) - F.col("ml_breach_probability") * 12.0)
    seconds = (hours * 3600.0).cast("bigint")  # whole seconds
    deadline = ts_literal(as_of) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return out.withColumn("adjusted_sla_deadline", deadline)


# ---------------------------------------------------------------------------
# E-mail path (H7, H9, email classifiers, email ticket)
# ---------------------------------------------------------------------------

def sender_name(sender: Column) -> Column:
    """H9 name: 'Name <addr>' -> stripped quoted name or 'Unknown'; bare address ->
    local part with dots as spaces, in Python title case."""
    has_angle = sender.contains("<")
    name = F.regexp_replace(F.trim(F.substring_index(sender, "<", 1)), r'^"+|"+$', "")
    local = F.regexp_replace(F.substring_index(sender, "@", 1), r"\.", " ")
    return F.when(has_angle, F.when(name == "", F.lit("Unknown")).otherwise(name)).otherwise(title_case(local))


def sender_address(sender: Column) -> Column:
    return F.when(sender.contains("<"),
                  F.substring_index(F.split(sender, "<").getItem(1), ">", 1)).otherwise(sender)


def analyze_email(emails: DataFrame) -> DataFrame:
    """E-mail classification on subject + ' ' + body (lower-cased once)."""
    d = with_lower(emails.withColumn("_subj", F.lower(F.col("subject"))),
                   F.concat_ws(" ", F.col("subject"), F.col("body")))
    lt = F.col(LT)
    keywords = R.SUPPORT_KEYWORDS_EMAIL
    return d.withColumns({
        "is_support": contains_any(F.col("_subj"), keywords) | contains_any(lt, keywords),
        "priority": first_match(lt, R.PRIORITY_EMAIL, R.PRIORITY_EMAIL_DEFAULT),
        "department": first_match(lt, R.DEPARTMENT_EMAIL, R.DEPARTMENT_DEFAULT),
        "service_type": first_match(lt, R.SERVICE_SHORT, R.SERVICE_DEFAULT),
        "location": locations_all(lt, R.LOCATIONS_EMAIL),
    }).drop("_subj")


def build_email_ticket(analysed: DataFrame, key: str = "message_id", as_of: str = DEFAULT_AS_OF) -> DataFrame:
    prio, svc = F.col("priority"), F.col("service_type")
    now = ts_literal(as_of)
    hours = lookup(prio, R.TEXT_SLA_HOURS, 24)
    deadline = now + F.make_dt_interval(F.lit(0), hours.cast("int"))
    # every column reads only input columns: one projection, one analysis pass
    return analysed.withColumns({
        "ticket_id": F.concat_ws("-", F.col("department"), prio, F.date_format(now, "yyMMdd"),
                                 ticket_suffix(F.col(key))),
        "sla_deadline": deadline,
        "breach_probability": F.least(F.lit(R.TEXT_PROBABILITY_CAP),
                                      lookup(prio, R.TEXT_BASE_PROBABILITY, 0.45)
                                      * lookup(svc, R.TEXT_SERVICE_MULTIPLIER, 1.0)),
        "revenue_impact": (lookup(prio, R.TEXT_BASE_REVENUE, 50000)
                           * lookup(svc, R.EMAIL_REVENUE_MULTIPLIER, 1.0)).cast("bigint"),
        "customer_tier": lookup(prio, R.CUSTOMER_TIER, "Silver"),
        "reporter_name": sender_name(F.col("sender")),
        "contact": sender_address(F.col("sender")),
    })


def unseen(messages: DataFrame, processed: DataFrame, key: str = "message_id") -> DataFrame:
    """Drop re-deliveries, then anti-join against already processed ids."""
    return messages.dropDuplicates([key]).join(processed.select(key).distinct(), key, "left_anti")


# ---------------------------------------------------------------------------
# Replies and clipping
# ---------------------------------------------------------------------------

_WS = r"[ \t\n\r\f\x0B]"
REPLY_PREFIXES = ["Response:", "Answer:", "Reply:", "AI Response:", "उत्तर:", "जवाब:", "Response in Hindi:"]
REPLY_DEFAULT_EN = "I'd be happy to help you! Please provide more details about your question."
REPLY_DEFAULT_HI = "मुझे खुशी होगी आपकी सहायता करने में। कृपया अपना प्रश्न और विस्तार से बताएं।"


_REPLY_PREFIX_RE = "^" + "".join(f"(?:\\Q{p}\\E{_WS}*)?" for p in REPLY_PREFIXES)


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def clean_reply(text: Column, language: Column) -> Column:
    """Strip, remove known prefixes in order, cut at 1000 + '...', default by language."""
    # The prefixes are stripped in list order, each at most once, each followed by a
    # strip: one anchored pattern of optional groups does the same in a single pass
    # (a nested CASE per prefix would repeat the whole chain three times per level).
    r = F.regexp_replace(strip_ws(text), _REPLY_PREFIX_RE, "")
    r = F.when(F.length(r) > 1000, F.concat(F.substring(r, 1, 1000), F.lit("..."))).otherwise(r)
    return F.when(F.length(r) == 0, F.when(language == "hi", F.lit(REPLY_DEFAULT_HI))
                  .otherwise(F.lit(REPLY_DEFAULT_EN))).otherwise(r)


def clip_always(text: Column, n: int = 200) -> Column:
    """First n characters + '...' always."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def clip_if_longer(text: Column, n: int = 500) -> Column:
    """First n characters, '...' only when longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
