"""DuckDB SQL for the derived tables (oracle side), written independently of the
DataFrame code in ``servicelens.sources.fixtures``.  Each constant is a CTE body."""

from __future__ import annotations

from ..sources.fixtures import PHRASES


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PHRASE_LIST = "[" + ", ".join(_sql_str(p) for p in PHRASES) + "]"
AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


def phrase(key: str) -> str:
    return f"({PHRASE_LIST})[({key}) % 16 + 1]"


TICKETS = f"""
tickets AS (
  SELECT 'T-' || CAST(o.o_orderkey AS VARCHAR) AS ticket_id,
         o.o_orderkey AS order_key,
         o.o_custkey AS cust_key,
         CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS priority,
         CASE o.o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress'
              WHEN 'F' THEN 'resolved' ELSE o.o_orderstatus END AS status,
         CASE c.c_mktsegment WHEN 'MACHINERY' THEN 'hardware' WHEN 'AUTOMOBILE' THEN 'software'
              WHEN 'BUILDING' THEN 'infrastructure' WHEN 'FURNITURE' THEN 'access'
              WHEN 'HOUSEHOLD' THEN 'network' ELSE 'general' END AS category,
         {AS_OF} - to_minutes(CAST((o.o_orderkey * 37) %
              (CASE CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER)
                 WHEN 1 THEN 300 WHEN 2 THEN 600 WHEN 3 THEN 1800 WHEN 4 THEN 3600 ELSE 1800 END) AS BIGINT))
           AS created_at,
         o.o_totalprice AS revenue_impact,
         CASE WHEN o.o_totalprice >= 300000 THEN 'critical' ELSE 'standard' END AS customer_impact,
         CASE WHEN o.o_orderkey % 5 = 0 THEN 'Issue on LIC-' ELSE 'Issue on asset AST-' END || CAST(o.o_custkey AS VARCHAR) AS title,
         {phrase('o.o_orderkey')} AS description
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
)"""

# elapsed minutes, thresholds (unknown priority -> P3), remaining and risks
TICKET_RISKS = f"""
t_thr AS (
  SELECT *,
    CASE priority WHEN 1 THEN 15.0 WHEN 2 THEN 60.0 WHEN 3 THEN 240.0 WHEN 4 THEN 480.0 ELSE 240.0 END::DOUBLE
      AS response_threshold,
    CASE priority WHEN 1 THEN 240.0 WHEN 2 THEN 480.0 WHEN 3 THEN 1440.0 WHEN 4 THEN 2880.0 ELSE 1440.0 END::DOUBLE
      AS resolution_threshold,
    CAST(epoch_us({AS_OF}) - epoch_us(created_at) AS DOUBLE) / 60000000.0::DOUBLE AS elapsed_minutes
  FROM tickets
),
t_risk AS (
  SELECT *,
    greatest(0.0::DOUBLE, response_threshold - elapsed_minutes) AS response_remaining,
    greatest(0.0::DOUBLE, resolution_threshold - elapsed_minutes) AS resolution_remaining,
    least(1.0::DOUBLE, elapsed_minutes / response_threshold) AS response_risk,
    least(1.0::DOUBLE, elapsed_minutes / resolution_threshold) AS resolution_risk
  FROM t_thr
)"""

SCORED = TICKET_RISKS + """,
scored AS (
  SELECT *,
    CASE WHEN status IN ('resolved', 'closed') THEN 0.0::DOUBLE
         WHEN status = 'open' THEN response_risk * 0.7::DOUBLE + resolution_risk * (1.0::DOUBLE - 0.7::DOUBLE)
         ELSE response_risk * 0.3::DOUBLE + resolution_risk * (1.0::DOUBLE - 0.3::DOUBLE) END AS breach_probability
  FROM t_risk
)"""


def bucket(p: str) -> str:
    return (f"CASE WHEN {p} >= 0.9 THEN 'critical' WHEN {p} >= 0.7 THEN 'high' WHEN {p} >= 0.5 THEN 'medium' "
            f"WHEN {p} >= 0.3 THEN 'low' ELSE 'minimal' END")


def status(p: str) -> str:
    return (f"CASE WHEN {p} >= 0.9 THEN 'BREACH_IMMINENT' WHEN {p} >= 0.7 THEN 'AT_RISK' "
            f"WHEN {p} >= 0.5 THEN 'WATCH' ELSE 'HEALTHY' END")


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def actions_sql(rule_rows, p: str, category: str, priority: str, text_lower: str | None = None) -> str:
    """Ordered, de-duplicated action list as a ', '-joined string."""
    items = []
    for min_p, cat, max_prio, word, action in rule_rows:
        conds = []
        if min_p is not None:
            conds.append(f"{p} >= {min_p}")
        if cat is not None:
            conds.append(f"{category} = '{cat}'")
        if max_prio is not None:
            conds.append(f"{priority} <= {max_prio}")
        if word is not None:
            conds.append(f"contains({text_lower}, '{word}')")
        cond = " AND ".join(conds) if conds else "TRUE"
        items.append(f"CASE WHEN {cond} THEN '{action}' END")
    lst = "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"
    return f"array_to_string(list_filter({lst}, lambda x, i: list_position({lst}, x) = i), ',')"


def first_action_sql(rule_rows, p: str, category: str, priority: str, text_lower: str | None = None) -> str:
    branches = []
    for min_p, cat, max_prio, word, action in rule_rows:
        conds = []
        if min_p is not None:
            conds.append(f"{p} >= {min_p}")
        if cat is not None:
            conds.append(f"{category} = '{cat}'")
        if max_prio is not None:
            conds.append(f"{priority} <= {max_prio}")
        if word is not None:
            conds.append(f"contains({text_lower}, '{word}')")
        cond = " AND ".join(conds) if conds else "TRUE"
        branches.append(f"WHEN {cond} THEN '{action}'")
    return "CASE " + " ".join(branches) + " ELSE 'monitor' END"


def contains_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {_sql_str(w)})" for w in words) + ")"


def first_match(text: str, rule_set, default: str) -> str:
    return ("CASE " + " ".join(f"WHEN {contains_any(text, ws)} THEN {_sql_str(label)}" for label, ws in rule_set)
            + f" ELSE {_sql_str(default)} END")


def lookup(key: str, mapping: dict, default) -> str:
    def lit(v):
        return _sql_str(v) if isinstance(v, str) else repr(float(v)) + "::DOUBLE" if isinstance(v, float) else str(v)
    return "CASE " + " ".join(f"WHEN {key} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + \
        f" ELSE {lit(default) if default is not None else 'NULL'} END"


def scored_match(text: str, rule_set, default: str) -> str:
    scores = ["(" + " + ".join(f"CAST(contains({text}, {_sql_str(w)}) AS INTEGER)" for w in dict.fromkeys(words)) + ")"
              for _, words in rule_set]
    mx = "greatest(" + ", ".join(scores) + ")"
    return (f"CASE WHEN {mx} = 0 THEN {_sql_str(default)} "
            + " ".join(f"WHEN {s} = {mx} THEN {_sql_str(label)}" for s, (label, _) in zip(scores, rule_set))
            + " END")


def locations_all(text: str, gazetteer, none: str = "Not specified") -> str:
    parts = ", ".join(f"CASE WHEN contains({text}, {_sql_str(g)}) THEN {_sql_str(g.title())} END" for g in gazetteer)
    joined = f"concat_ws(', ', {parts})"
    return f"CASE WHEN {joined} = '' THEN {_sql_str(none)} ELSE {joined} END"


def location_first(text: str, gazetteer, none: str = "Not specified") -> str:
    return ("CASE " + " ".join(f"WHEN contains({text}, {_sql_str(g)}) THEN {_sql_str(g.title())}" for g in gazetteer)
            + f" ELSE {_sql_str(none)} END")


TEXT_TICKETS = f"""
tt AS (SELECT doc_id AS id, {phrase('doc_id')} || ' ' || text AS text, lang, source FROM documents),
tl AS (SELECT *, lower(text) AS lt FROM tt)"""

EMAILS = f"""
em0 AS (
  SELECT doc_id AS message_id,
         CASE WHEN doc_id % 2 = 0 THEN '"User ' || CAST(doc_id AS VARCHAR) || '" <user.' || CAST(doc_id AS VARCHAR)
              || '@example.org>' ELSE 'user.' || CAST(doc_id AS VARCHAR) || '@example.org' END AS sender,
         {phrase('doc_id')} AS subject, text AS body
  FROM documents
),
emails AS (SELECT * FROM em0 UNION ALL SELECT * FROM em0 WHERE message_id % 10 = 0)"""


def title_case(s: str) -> str:
    """Python str.title() in DuckDB: upper a letter at the start or after a non-letter."""
    return (f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: "
            f"CASE WHEN i = 1 OR NOT regexp_matches(substr({s}, i - 1, 1), '\\p{{L}}') "
            f"THEN upper(substr({s}, i, 1)) ELSE substr({s}, i, 1) END), '')")


def strip_ws(s: str) -> str:
    return f"regexp_replace({s}, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')"

LICENSES = f"""
lusage AS (
  SELECT l_partkey, sum(l_quantity) AS t,
         sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0.0 END) AS u
  FROM lineitem GROUP BY l_partkey
),
lic AS (
  SELECT p_partkey AS asset_id,
    CASE WHEN p_partkey % 40 = 0 THEN p_name || ' zoom' WHEN p_partkey % 40 = 1 THEN p_name || ' slack'
         ELSE p_name END AS name,
    p_brand AS vendor, 'subscription' AS license_type,
    CAST(trunc(coalesce(t, 0.0)) AS BIGINT) AS total_licenses,
    CAST(trunc(coalesce(u, 0.0)) AS BIGINT) AS used_licenses,
    p_retailprice AS cost_per_license,
    CASE WHEN p_partkey % 97 = 0 THEN 'bad-date'
         ELSE strftime(CAST({AS_OF} AS DATE) + CAST((p_partkey % 200) - 50 AS INTEGER), '%Y-%m-%d') END
      AS renewal_date,
    p_type AS department
  FROM part LEFT JOIN lusage ON p_partkey = l_partkey
),
licx AS (
  SELECT *,
    CASE WHEN total_licenses > 0 THEN used_licenses / total_licenses ELSE 0.0 END AS util,
    cost_per_license * total_licenses AS monthly_cost,
    CAST(floor((epoch_us(try_strptime(renewal_date, '%Y-%m-%d')) - epoch_us({AS_OF})) / 86400000000.0::DOUBLE)
      AS BIGINT) AS days,
    greatest(CAST(trunc(used_licenses * 1.2::DOUBLE) AS BIGINT), 1) AS reduce_to,
    {contains_any('lower(name)', ['zoom', 'teams', 'slack', 'meet', 'webex'])} AS comm
  FROM lic
)"""

QUOTES = """
quotes AS (
  SELECT l_orderkey AS bid_request_id,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS quote_id,
         l_linenumber AS quote_seq,
         'Supplier#' || CAST(l_suppkey AS VARCHAR) AS vendor_name,
         l_extendedprice AS total_price,
         (l_partkey & 1) <> 0 AS iso_certified, (l_partkey & 2) <> 0 AS soc2_compliant,
         (l_partkey & 4) <> 0 AS api_support, (l_partkey & 8) <> 0 AS sso_integration,
         (l_partkey & 16) <> 0 AS audit_logging
  FROM lineitem
),
qs AS (
  SELECT *, least((CAST(iso_certified AS INTEGER) + CAST(soc2_compliant AS INTEGER) + CAST(api_support AS INTEGER)
                   + CAST(sso_integration AS INTEGER) + CAST(audit_logging AS INTEGER)) / 5.0::DOUBLE * 100.0::DOUBLE,
                  100.0::DOUBLE) AS technical_score,
    CASE WHEN total_price <= total_price * 1.2::DOUBLE * 0.8::DOUBLE THEN 100.0
         WHEN total_price <= total_price * 1.2::DOUBLE THEN 80.0
         WHEN total_price <= total_price * 1.2::DOUBLE * 1.1::DOUBLE THEN 60.0 ELSE 40.0 END::DOUBLE AS commercial_score
  FROM quotes
),
qo AS (SELECT *, technical_score * 0.7::DOUBLE + commercial_score * 0.3::DOUBLE AS overall_score FROM qs)"""

STATUS_FOLD = """
sev AS (
  SELECT user_id AS service_id, event_id, ts AS event_ts,
    CASE event_type WHEN 'purchase' THEN 'L1 Task Completion' WHEN 'click' THEN 'L1 Task Completion'
         WHEN 'view' THEN 'L1 Task Completion' WHEN 'error' THEN 'L1 Task Failed'
         WHEN 'signup' THEN 'License Change Completed' END AS detail_type,
    CASE event_type WHEN 'purchase' THEN -0.2 WHEN 'click' THEN -0.1 WHEN 'view' THEN -0.05 WHEN 'error' THEN 0.1
         WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN -0.05 ELSE 0.15 END END::DOUBLE AS dp,
    CASE event_type WHEN 'purchase' THEN greatest(15, CAST(floor(value) AS BIGINT) * 3)
         WHEN 'click' THEN CAST(floor(value) AS BIGINT)
         WHEN 'view' THEN CAST(floor(CAST(floor(value) AS BIGINT) / 2) AS BIGINT) ELSE 0 END AS tsaved
  FROM events WHERE event_type IN ('purchase', 'click', 'view', 'error', 'signup')
),
sst AS (
  SELECT user_id AS service_id, CAST(user_id % 10 AS DOUBLE) / 10.0::DOUBLE AS p0,
         60.0::DOUBLE AS r0, 240.0::DOUBLE AS q0
  FROM events GROUP BY user_id HAVING user_id % 11 <> 0
),
sw AS (
  SELECT e.*, s.p0, s.r0, s.q0,
    list(dp) OVER w AS dps, sum(tsaved) OVER w AS tcum, row_number() OVER w AS update_seq
  FROM sev e JOIN sst s USING (service_id)
  WINDOW w AS (PARTITION BY service_id ORDER BY event_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
sv AS (
  SELECT service_id, event_id, detail_type, event_ts AS version_ts, update_seq,
    round(list_reduce(dps, lambda a, x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, a + x)), p0), 9) AS breach_probability,
    r0 + tcum AS response_remaining, q0 + tcum AS resolution_remaining
  FROM sw
)"""

METRIC_POINTS = """
mp AS (
  SELECT CASE event_type WHEN 'error' THEN 'HighRiskTickets' WHEN 'click' THEN 'ResponseTimeMs'
              WHEN 'purchase' THEN 'SLACompliance' WHEN 'view' THEN 'ActionsTriggered' ELSE 'TicketsCreated' END
           AS metric,
         CASE event_type WHEN 'click' THEN value * 150.0::DOUBLE WHEN 'purchase' THEN value / 400.0::DOUBLE
              ELSE 1.0::DOUBLE END AS value,
         ts
  FROM events
)"""
