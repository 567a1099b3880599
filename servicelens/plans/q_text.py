"""Registered queries: text-born tickets, e-mail intake, replies, chat history."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions.columns import fmt_ts
from ..operators import text as T
from ..sources import fixtures as fx
from ..sources import rawfeeds as RF
from . import sqlfix as S
from .registry import query

_L = S.lookup

# ---------------------------------------------------------------------------
# Chat analysis + production ticket
# ---------------------------------------------------------------------------

_CHAT_SQL = f"""
ca AS (
  SELECT id, lt,
    {S.scored_match('lt', R.DEPARTMENT_SCORED_CHAT, R.DEPARTMENT_DEFAULT)} AS department,
    {S.first_match('lt', R.PRIORITY_CHAT, R.PRIORITY_DEFAULT)} AS priority,
    {S.first_match('lt', R.SERVICE_CHAT, R.SERVICE_DEFAULT)} AS service_type,
    {S.locations_all('lt', R.GAZETTEER)} AS location,
    CASE WHEN {S.contains_any('lt', R.SENTIMENT_NEGATIVE)} THEN 'negative'
         WHEN {S.contains_any('lt', R.SENTIMENT_POSITIVE)} THEN 'positive' ELSE 'neutral' END AS sentiment
  FROM tl
),
cb AS (
  SELECT *,
    {_L('priority', R.TEXT_SLA_HOURS, 24)} AS sla_hours,
    {_L('priority', R.TEXT_BASE_PROBABILITY, 0.45)} AS base_p,
    {_L('service_type', R.TEXT_SERVICE_MULTIPLIER, 1.0)} AS svc_mult,
    CASE WHEN {S.contains_any('location', R.TEXT_HIGH_RISK_CITIES)} THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS loc_mult,
    {_L('priority', R.TEXT_BASE_REVENUE, 50000)} AS base_rev
  FROM ca
),
cc AS (
  SELECT *, {S.AS_OF} + to_hours(CAST(sla_hours AS BIGINT)) AS deadline,
         CAST(trunc(base_rev * svc_mult * loc_mult) AS BIGINT) AS revenue_impact
  FROM cb
)"""


@query("chat_tickets", oracle=f"""
WITH {S.TEXT_TICKETS}, {_CHAT_SQL}
SELECT id, department, priority, service_type, location, sentiment,
  CASE priority WHEN 'P1' THEN 'critical' WHEN 'P2' THEN 'high' WHEN 'P4' THEN 'low' ELSE 'medium' END AS urgency_level,
  department || '-' || priority || '-' || strftime({S.AS_OF}, '%y%m%d') || '-' || strftime({S.AS_OF}, '%H%M') || '-'
    || upper(substr(sha256(CAST(id AS VARCHAR)), 1, 4)) AS ticket_id,
  sla_hours, {S.ts('deadline')} AS sla_deadline, strftime(deadline, '%I:%M %p') AS sla_due_time,
  least(0.95::DOUBLE, base_p * svc_mult * loc_mult) AS breach_probability,
  revenue_impact,
  CASE WHEN revenue_impact > 100000 THEN 'high' WHEN revenue_impact > 50000 THEN 'medium' ELSE 'low' END
    AS business_impact,
  {_L('priority', R.CUSTOMER_TIER, 'Silver')} AS customer_tier,
  replace(service_type, '-', '_') AS issue_category,
  CASE WHEN contains(location, ',') THEN split_part(location, ',', 1) ELSE location END AS affected_region,
  CASE WHEN location <> 'Not specified' THEN 'city' ELSE 'unknown' END AS geographic_scope,
  5 + CASE WHEN priority IN ('P1', 'P2') THEN 1 ELSE 0 END + CASE WHEN priority = 'P1' THEN 1 ELSE 0 END
    AS steps_completed,
  priority IN ('P1', 'P2') AS start_workflow, priority = 'P1' AS immediate_alert
FROM cc
""")
def q_chat_tickets(spark, sf_dir):
    from ..operators import scoring
    t = T.build_chat_ticket(T.analyze_chat(fx.text_tickets(spark, sf_dir)), key="id")
    t = scoring.priority_routes(t)
    return t.select("id", "department", "priority", "service_type", "location", "sentiment", "urgency_level",
                    "ticket_id", "sla_hours", fmt_ts("sla_deadline").alias("sla_deadline"), "sla_due_time",
                    "breach_probability", "revenue_impact", "business_impact", "customer_tier", "issue_category",
                    "affected_region", "geographic_scope",
                    T.steps_completed(F.col("production_flow")).alias("steps_completed"),
                    "start_workflow", "immediate_alert")


@query("ticket_distribution", oracle=f"""
WITH {S.TEXT_TICKETS}, {_CHAT_SQL}
SELECT priority, department, count(*) AS tickets, round(avg(least(0.95::DOUBLE, base_p * svc_mult * loc_mult)), 6)
  AS avg_breach_risk
FROM cc GROUP BY ROLLUP (priority, department)
""")
def q_ticket_distribution(spark, sf_dir):
    from ..operators import kpi
    t = T.build_chat_ticket(T.analyze_chat(fx.text_tickets(spark, sf_dir)), key="id")
    d = kpi.ticket_distribution(t)
    return d.select("priority", "department", "tickets", F.round("avg_breach_risk", 6).alias("avg_breach_risk"))


# ---------------------------------------------------------------------------
# Natural-language API analysis (H1 nlapi, H10, H4 first hit, H6 words, H12)
# ---------------------------------------------------------------------------

@query("nl_api_analysis", oracle=f"""
WITH {S.TEXT_TICKETS},
na AS (
  SELECT id, lt,
    {S.first_match('lt', R.DEPARTMENT_NLAPI, R.DEPARTMENT_NLAPI_DEFAULT[0])} AS department,
    {S.first_match('lt', R.PRIORITY_NLAPI, R.PRIORITY_DEFAULT)} AS priority
  FROM tl
)
SELECT id, department,
  {_L('department', R.DEPARTMENT_NLAPI_CONFIDENCE, R.DEPARTMENT_NLAPI_DEFAULT[1])} AS department_confidence,
  priority,
  {_L('priority', R.PRIORITY_REASON_ANALYSIS, R.PRIORITY_REASON_ANALYSIS_DEFAULT)} AS priority_reason,
  CASE WHEN priority = 'P1' THEN
         CASE WHEN contains(lt, 'critical') THEN 'Critical keyword detected'
              WHEN contains(lt, 'urgent') THEN 'Urgent keyword detected'
              WHEN contains(lt, 'failing') OR contains(lt, 'down') THEN 'Service failure indicators'
              ELSE 'High severity indicators' END
       WHEN priority = 'P2' THEN 'High importance indicators'
       WHEN priority = 'P4' THEN 'Low priority indicators'
       ELSE 'Standard issue classification' END AS priority_detail,
  {S.location_first('lt', R.LOCATIONS_NLAPI)} AS location,
  {S.first_match('lt', R.SERVICE_SHORT, R.SERVICE_DEFAULT)} AS service_type,
  CASE WHEN {S.contains_any('lt', R.SENTIMENT_NEGATIVE_NLAPI)} THEN 'negative'
       WHEN {S.contains_any('lt', R.SENTIMENT_POSITIVE)} THEN 'positive' ELSE 'neutral' END AS sentiment,
  CASE WHEN {S.contains_any('lt', R.URGENCY_LEVEL_WORDS)} THEN 'high' ELSE 'normal' END AS urgency_level,
  CASE WHEN {S.contains_any('lt', R.AFFECTED_USERS_WORDS)} THEN 'multiple' ELSE 'single' END AS affected_users
FROM na
""")
def q_nl_api(spark, sf_dir):
    a = T.analyze_nlapi(fx.text_tickets(spark, sf_dir))
    return a.select("id", "department", "department_confidence", "priority", "priority_reason", "priority_detail",
                    "location", "service_type", "sentiment", "urgency_level", "affected_users")


# ---------------------------------------------------------------------------
# Core fallback analysis (H2 core, H1 core, category, H3, B19-B21, H13)
# ---------------------------------------------------------------------------

def _urgency_sql(t: str) -> str:
    parts = ", ".join(f"CASE WHEN contains({t}, '{w}') THEN {v} ELSE 5 END" for w, v in R.URGENCY_WORDS)
    return f"least(greatest(5, {parts}), 10)"


_CORE_SQL = f"""
co AS (
  SELECT id, lt,
    {S.scored_match('lt', R.DEPARTMENT_SCORED_CORE, R.DEPARTMENT_DEFAULT)} AS department,
    {S.first_match('lt', R.PRIORITY_CORE, R.PRIORITY_DEFAULT)} AS priority,
    {S.first_match('lt', R.CATEGORY_CORE, R.CATEGORY_DEFAULT)} AS category,
    {_urgency_sql('lt')} AS urgency_score
  FROM tl
)"""


@query("core_text_analysis", oracle=f"""
WITH {S.TEXT_TICKETS}, {_CORE_SQL}
SELECT id, department, priority, category, urgency_score,
  least({_L('priority', R.ADDITIVE_BASE_RISK, 0.3)} + urgency_score / 10.0::DOUBLE * 0.3::DOUBLE, 1.0::DOUBLE) AS breach_probability,
  {_L('priority', R.ADDITIVE_RESOLUTION_HOURS, 24)} AS estimated_resolution_hours,
  {_L('priority', R.RESPONSE_TEMPLATES, R.RESPONSE_TEMPLATES['P3'])} AS acknowledgment,
  'Resolution expected within ' || CAST({_L('priority', R.RESPONSE_HOURS, 24)} AS VARCHAR) || ' hours'
    AS expected_timeline,
  'Your ticket has been routed to the ' || department || ' support team.' AS status_update,
  least(0.3::DOUBLE + urgency_score / 10.0::DOUBLE * 0.2::DOUBLE, 1.0::DOUBLE) AS risk_genai,
  {_L('priority', R.TABLE_RISK, 0.45)} AS risk_table,
  {_L('priority', R.TABLE_RISK_HOURS, 24)} AS risk_table_hours
FROM co
""")
def q_core_text(spark, sf_dir):
    a = T.fallback_risk_variants(T.analyze_core(fx.text_tickets(spark, sf_dir)))
    return a.select("id", "department", "priority", "category", "urgency_score", "breach_probability",
                    "estimated_resolution_hours", "acknowledgment", "expected_timeline", "status_update",
                    "risk_genai", "risk_table", "risk_table_hours")


# ---------------------------------------------------------------------------
# 11-feature fallback predictor on chat-analysed tickets
# ---------------------------------------------------------------------------

_FALLBACK_SQL = f"""
WITH {S.TEXT_TICKETS}, {_CHAT_SQL},
f AS (
  SELECT id,
    {_L('priority', R.PRIORITY_SCORE, R.PRIORITY_SCORE_DEFAULT)} AS priority_score,
    {_urgency_sql('lt')} AS urgency,
    CASE upper(sentiment) WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1 ELSE 0 END AS sentiment_score,
    {_L('department', R.DEPARTMENT_RISK, R.DEPARTMENT_RISK_DEFAULT)} AS department_risk,
    hour({S.AS_OF}) AS hour_of_day, isodow({S.AS_OF}) - 1 AS day_of_week,
    {_L('priority', R.ADDITIVE_RESOLUTION_HOURS, 24)} AS estimated_hours
  , priority, department, sentiment FROM cc
),
g AS (
  SELECT *, (hour_of_day BETWEEN 9 AND 17) AND day_of_week < 5 AS bh FROM f
),
h AS (
  SELECT *,
    CASE WHEN bh THEN 0.8::DOUBLE ELSE 1.2::DOUBLE END AS time_factor,
    CASE WHEN sentiment_score = -1 THEN 1.3::DOUBLE WHEN sentiment_score = 1 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END
      AS sentiment_factor,
    CASE WHEN estimated_hours <= 4 THEN 1.4::DOUBLE WHEN estimated_hours <= 12 THEN 1.2::DOUBLE
         WHEN estimated_hours <= 24 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS time_pressure_factor
  FROM g
),
k AS (
  SELECT *, least(greatest((priority_score / 4.0::DOUBLE * 0.3::DOUBLE + urgency / 10.0::DOUBLE * 0.2::DOUBLE
                            + department_risk * 0.3::DOUBLE)
                           * time_factor * sentiment_factor * time_pressure_factor, 0.0::DOUBLE), 1.0::DOUBLE) AS p
  FROM h
)
"""


def _fallback(spark, sf_dir):
    chat = T.analyze_chat(fx.text_tickets(spark, sf_dir))
    chat = chat.withColumn("urgency_score", T.urgency_score(F.col(T.LT))) \
        .withColumn("_est", T.lookup(F.col("priority"), R.ADDITIVE_RESOLUTION_HOURS, 24))
    return T.fallback_prediction(T.ml_features_11(chat, est_hours="_est"))


@query("fallback_predictions", oracle=f"""
{_FALLBACK_SQL}SELECT id, priority_score, urgency, sentiment_score, department_risk, hour_of_day, day_of_week,
  CAST(bh AS INTEGER) AS is_business_hours, p AS ml_breach_probability,
  least(greatest((0.5::DOUBLE + 0.5::DOUBLE) / 200.0::DOUBLE, 0.6::DOUBLE), 0.9::DOUBLE) AS ml_confidence,
  time_pressure_factor,
  {S.ts(f"{S.AS_OF} + to_seconds(CAST(trunc(greatest(4.0::DOUBLE, 24.0::DOUBLE - p * 12.0) * 3600.0) AS BIGINT))")}
    AS adjusted_sla_deadline
FROM k
""")
def q_fallback_predictions(spark, sf_dir):
    p = _fallback(spark, sf_dir)
    return p.select("id", "priority_score", "urgency", "sentiment_score", "department_risk", "hour_of_day",
                    "day_of_week", "is_business_hours", "ml_breach_probability", "ml_confidence",
                    F.col("factors.time_pressure_factor").alias("time_pressure_factor"),
                    fmt_ts("adjusted_sla_deadline").alias("adjusted_sla_deadline"))


@query("high_risk_alerts", oracle=f"""
{_FALLBACK_SQL}
SELECT k.id AS ticket_id, 'SLA_BREACH_RISK' AS alert_type,
  CASE WHEN p > 0.9 THEN chr(128308) || ' CRITICAL' ELSE chr(128993) || ' HIGH' END AS risk_level,
  k.priority, k.department, k.sentiment, p AS breach_probability, 0.6::DOUBLE AS confidence,
  substr(t.text, 1, 200) || '...' AS original_text,
  {S.ts(f"{S.AS_OF} + to_seconds(CAST(trunc(greatest(4.0::DOUBLE, 24.0::DOUBLE - p * 12.0) * 3600.0) AS BIGINT))")}
    AS adjusted_deadline, true AS action_required, p > 0.9 AS escalation_needed,
  CASE WHEN p > 0.9 THEN chr(128308) || ' CRITICAL' ELSE chr(128993) || ' HIGH' END || ' SLA Breach Risk - ' || CAST(k.id AS VARCHAR)
    || ' (' || k.priority || ')' AS subject,
  CASE WHEN p > 0.9 THEN 'YES - IMMEDIATE' ELSE 'YES - URGENT' END AS action_text
FROM k JOIN tt t USING (id) WHERE p > 0.7
""")
def q_high_risk_alerts(spark, sf_dir):
    """Alert records of the high-risk text tickets."""
    from ..operators import scoring
    a = scoring.high_risk_alerts(_fallback(spark, sf_dir))
    return a.withColumn("adjusted_deadline", fmt_ts("adjusted_deadline")).drop("timestamp")


def _intake_sql(name: str) -> str:
    def value(field: tuple) -> str:
        rule_set, default = field
        return S.first_match("lt", rule_set, default) if rule_set else "NULL"

    fields = R.INTAKE_CLASSIFIERS[name]
    return f"SELECT id, '{name}' AS intake, " + ", ".join(f"{value(fields[c])} AS {c}" for c in ("priority", "department", "service_type")) + " FROM tl"


@query("intake_classifications", oracle=f"WITH {S.TEXT_TICKETS}\n" + "\nUNION ALL ".join(_intake_sql(n) for n in R.INTAKE_CLASSIFIERS))
def q_intake_classifications(spark, sf_dir):
    """H1: every text ticket as each of the other eight intakes classifies it."""
    return T.classify_intakes(fx.text_tickets(spark, sf_dir)).drop("major_city")


def _intake_ticket_sql(name: str) -> str:
    t = R.INTAKE_TICKETS[name]
    look = lambda key, m, default: S.lookup(key, m, default) if m else str(default)
    cap = f"least(0.95::DOUBLE, {look('priority', t['probability'], 0.45)} * {look('service_type', t['service_probability'], '1.0::DOUBLE')}" \
          f" * CASE WHEN city THEN {t['city']}::DOUBLE ELSE 1.0::DOUBLE END)"
    dept = S.lookup("service_type", t["department"], "General Support") if "department" in t else "department"
    conf = "NULL::DOUBLE" if t["confidence"] is None else f"{t['confidence']}::DOUBLE"
    return f"""SELECT id, intake, priority, service_type, {f"round({cap}, 3)" if t["status"] == "new" else cap} AS breach_probability,
  CAST(trunc({look('priority', t['revenue'], 50000)} * {look('service_type', t['service_revenue'], '1.0::DOUBLE')}) AS BIGINT) AS revenue_impact,
  {S.ts(S.AS_OF + " + to_hours(" + S.lookup("priority", t["hours"], 24) + ")")} AS sla_deadline,
  {S.lookup("priority", t["tier"], "Silver")} AS customer_tier, '{t["status"]}' AS status, '{t["source"]}' AS source, {conf} AS confidence_score,
  {dept} AS ticket_department
FROM c JOIN city USING (id) WHERE intake = '{name}'"""


@query("intake_tickets", oracle=f"WITH {S.TEXT_TICKETS},\nc AS (" + "\nUNION ALL ".join(_intake_sql(n) for n in R.INTAKE_TICKETS)
       + f"),\ncity AS (SELECT id, {S.contains_any('lt', R.MAJOR_CITIES)} AS city FROM tl)\n"
       + "\nUNION ALL ".join(_intake_ticket_sql(n) for n in R.INTAKE_TICKETS))
def q_intake_tickets(spark, sf_dir):
    """H8: the tickets of four more intakes."""
    t = T.build_intake_tickets(T.classify_intakes(fx.text_tickets(spark, sf_dir)))
    return t.withColumn("sla_deadline", fmt_ts("sla_deadline")).drop("major_city", "department")


# ---------------------------------------------------------------------------
# E-mail intake (H7, H9, C12, e-mail classifiers and ticket)
# ---------------------------------------------------------------------------

_EMAIL_KW = R.SUPPORT_KEYWORDS_EMAIL


@query("email_tickets", oracle=f"""
WITH {S.EMAILS},
u AS (SELECT DISTINCT * FROM emails),
el AS (SELECT *, lower(subject) AS ls, lower(subject || ' ' || body) AS lt FROM u),
ea AS (
  SELECT message_id, sender,
    {S.first_match('lt', R.PRIORITY_EMAIL, R.PRIORITY_EMAIL_DEFAULT)} AS priority,
    {S.first_match('lt', R.DEPARTMENT_EMAIL, R.DEPARTMENT_DEFAULT)} AS department,
    {S.first_match('lt', R.SERVICE_SHORT, R.SERVICE_DEFAULT)} AS service_type,
    {S.locations_all('lt', R.LOCATIONS_EMAIL)} AS location
  FROM el WHERE {S.contains_any('ls', _EMAIL_KW)} OR {S.contains_any('lt', _EMAIL_KW)}
)
SELECT message_id, priority, department, service_type, location,
  department || '-' || priority || '-' || strftime({S.AS_OF}, '%y%m%d') || '-'
    || upper(substr(sha256(CAST(message_id AS VARCHAR)), 1, 4)) AS ticket_id,
  least(0.95::DOUBLE, {_L('priority', R.TEXT_BASE_PROBABILITY, 0.45)} * {_L('service_type', R.TEXT_SERVICE_MULTIPLIER, 1.0)})
    AS breach_probability,
  CAST(trunc({_L('priority', R.TEXT_BASE_REVENUE, 50000)} * {_L('service_type', R.EMAIL_REVENUE_MULTIPLIER, 1.0)})
    AS BIGINT) AS revenue_impact,
  {_L('priority', R.CUSTOMER_TIER, 'Silver')} AS customer_tier,
  CASE WHEN contains(sender, '<') THEN
         CASE WHEN trim(trim(split_part(sender, '<', 1)), '"') = '' THEN 'Unknown'
              ELSE trim(trim(split_part(sender, '<', 1)), '"') END
       ELSE {S.title_case("replace(lower(split_part(sender, '@', 1)), '.', ' ')")} END AS reporter_name,
  CASE WHEN contains(sender, '<') THEN split_part(split_part(sender, '<', 2), '>', 1) ELSE sender END AS contact
FROM ea
""")
def q_email_tickets(spark, sf_dir):
    em = fx.emails(spark, sf_dir).dropDuplicates(["message_id"])
    a = T.analyze_email(em).filter(F.col("is_support"))
    t = T.build_email_ticket(a)
    return t.select("message_id", "priority", "department", "service_type", "location", "ticket_id",
                    "breach_probability", "revenue_impact", "customer_tier", "reporter_name", "contact")


@query("email_intake_stats", oracle=f"""
WITH {S.EMAILS},
u AS (SELECT DISTINCT * FROM emails),
el AS (SELECT *, lower(subject) AS ls, lower(subject || ' ' || body) AS lt FROM u)
SELECT (SELECT count(*) FROM emails) AS received,
       count(*) AS unique_messages,
       count(*) FILTER (WHERE {S.contains_any('ls', _EMAIL_KW)} OR {S.contains_any('lt', _EMAIL_KW)}) AS tickets_created,
       count(*) FILTER (WHERE {S.contains_any('ls', R.SUPPORT_KEYWORDS_BASE)}
                         OR {S.contains_any('lt', R.SUPPORT_KEYWORDS_BASE)}) AS base_support,
       count(*) FILTER (WHERE {S.contains_any('ls', R.SUPPORT_KEYWORDS_LIVE)}
                         OR {S.contains_any('lt', R.SUPPORT_KEYWORDS_LIVE)})
         AS live_support
FROM el
""")
def q_email_intake_stats(spark, sf_dir):
    """D19 + H7 variants: received, unique (C12), and support counts for three keyword lists."""
    # keywords are looked for where the e-mail is read; what is grouped by message has three flags, not the text
    lowered = T.with_lower(fx.emails(spark, sf_dir).withColumn("_s", F.lower("subject")), F.concat_ws(" ", "subject", "body"))
    lists = {"tickets_created": _EMAIL_KW, "base_support": R.SUPPORT_KEYWORDS_BASE, "live_support": R.SUPPORT_KEYWORDS_LIVE}
    flags = lowered.select("message_id", *[T.is_support_request(F.col("_s"), F.col(T.LT), kw).alias(n) for n, kw in lists.items()])
    messages = flags.groupBy("message_id").agg(F.count(F.lit(1)).alias("copies"), *[F.bool_or(n).alias(n) for n in lists])
    return messages.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("received"), F.count(F.lit(1)).alias("unique_messages"),
                        *[F.count_if(n).alias(n) for n in lists])


# ---------------------------------------------------------------------------
# Replies and chat history
# ---------------------------------------------------------------------------

_REPLY_CASCADE = "r0"
for _pre in T.REPLY_PREFIXES:
    _REPLY_CASCADE = (f"CASE WHEN starts_with({_REPLY_CASCADE}, '{_pre}') THEN "
                      f"{S.strip_ws(f'substr({_REPLY_CASCADE}, {len(_pre) + 1})')} ELSE {_REPLY_CASCADE} END")


@query("assistant_replies", oracle=f"""
WITH a AS (
  SELECT conv_id, turn, {S.strip_ws('text')} AS r0
  FROM conversations WHERE role = 'assistant'
),
b AS (SELECT conv_id, turn, r0, {_REPLY_CASCADE} AS r FROM a)
SELECT conv_id, turn,
  CASE WHEN length(r) = 0 THEN 'I''d be happy to help you! Please provide more details about your question.'
       WHEN length(r) > 1000 THEN substr(r, 1, 1000) || '...' ELSE r END AS reply,
  substr(r0, 1, 200) || '...' AS preview,
  CASE WHEN length(r0) > 500 THEN substr(r0, 1, 500) || '...' ELSE r0 END AS summary
FROM b
""")
def q_assistant_replies(spark, sf_dir):
    c = fx.chat_turns(spark, sf_dir).filter(F.col("sender") == "assistant")
    r = T.strip_ws(F.col("message"))
    return c.select("conv_id", "turn", T.clean_reply(F.col("message"), F.lit("en")).alias("reply"),
                    T.clip_always(r).alias("preview"), T.clip_if_longer(r).alias("summary"))


@query("recent_turns", oracle="""
WITH r AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
  FROM conversations
)
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history, count(*) AS turns
FROM r WHERE rn <= 3 GROUP BY conv_id
""")
def q_recent_turns(spark, sf_dir):
    from ..operators import history
    return history.recent_turns(fx.chat_turns(spark, sf_dir), k=3)


def _form_sql(values: list[tuple]) -> str:
    cases = " ".join(f"WHEN {n} THEN {'NULL' if want is None else S._sql_str(want)}" for n, (_, want) in enumerate(values))
    return f"CASE id % {len(values)} {cases} END"


@query("multiselect_forms", oracle=f"""
WITH {S.TEXT_TICKETS}
SELECT id, {_form_sql(RF.FORM_DEPARTMENTS)} AS department, {_form_sql(RF.FORM_CATEGORIES)} AS category,
  {_form_sql(RF.FORM_PRIORITIES)} AS priority, {_form_sql(RF.FORM_SCOPES)} AS impact_scope
FROM tt
""")
def q_multiselect_forms(spark, sf_dir):
    """Multi-select form fields reduced to one value each; the oracle lists the values by hand."""
    from ..operators import responses as RS
    return RS.clean_multiselect(RF.multiselect_forms(spark, sf_dir)).select(
        "id", "department", "category", "priority", "impact_scope")
