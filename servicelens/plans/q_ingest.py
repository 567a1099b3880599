"""Registered queries: decoders, typed imports, lake round trip, AI-response parsing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import fmt_ts
from ..operators import responses as RS
from ..operators import scoring
from ..sources import fixtures as fx
from ..sources import ingest as IN
from ..sources import rawfeeds as RF
from . import sqlfix as S
from .q_scoring import _PRED_SQL
from .q_text import _CORE_SQL
from .registry import query

def _tickets_out(df):
    return df.select("ticket_id", "priority", "status", "category", fmt_ts("created_at").alias("created_at"))


@query("change_feed_decode", oracle=f"""
WITH {S.TICKETS}
SELECT ticket_id, CASE WHEN order_key % 7 = 0 THEN 3 ELSE priority END AS priority, status,
  CASE WHEN order_key % 7 = 0 THEN 'general' ELSE category END AS category, {S.ts('created_at')} AS created_at
FROM tickets WHERE order_key % 3 <> 2
""")
def q_change_feed(spark, sf_dir):
    t, _ = IN.decode_change_feed(RF.change_records(spark, sf_dir))
    return _tickets_out(t)


@query("queue_decode", oracle=f"""
WITH {S.TICKETS}
SELECT ticket_id, priority, status, category, {S.ts('created_at')} AS created_at FROM tickets
WHERE order_key % 3 <> 2
""")
def q_queue_decode(spark, sf_dir):
    t, _ = IN.decode_queue_json(RF.queue_bodies(spark, sf_dir))
    return _tickets_out(t)


@query("queue_rejects", oracle=f"""
WITH {S.TICKETS}
SELECT count(*) AS rejected FROM tickets WHERE order_key % 3 = 2
""")
def q_queue_rejects(spark, sf_dir):
    _, bad = IN.decode_queue_json(RF.queue_bodies(spark, sf_dir))
    return bad.agg(F.count(F.lit(1)).alias("rejected"))


@query("envelope_unify", oracle=f"""
WITH {S.TICKETS}
SELECT ticket_id, priority, status, category, {S.ts('created_at')} AS created_at FROM tickets
""")
def q_envelope_unify(spark, sf_dir):
    return _tickets_out(IN.unify_shapes(RF.envelopes(spark, sf_dir)))


@query("bus_event_decode", oracle="""
SELECT 'l1-automation' AS source, 'S-' || CAST(user_id AS VARCHAR) AS ticket_id,
  CASE WHEN event_id % 4 = 0 THEN 'completed' WHEN event_type = 'view' THEN 'partial' ELSE 'completed' END AS status,
  CAST(floor(value) AS BIGINT) AS execution_time,
  CASE WHEN event_id % 4 = 0 THEN 'positive' WHEN event_type = 'click' THEN 'neutral' ELSE 'positive' END AS sla_impact
FROM events WHERE event_type IN ('purchase', 'click', 'view')
""")
def q_bus_event_decode(spark, sf_dir):
    return IN.decode_bus_event(RF.bus_envelopes(spark, sf_dir), "L1 Task Completion")


@query("bus_event_details", oracle="""
WITH e AS (
  SELECT event_id, event_id % 10 AS k, (event_id // 10) % 4 = 0 AS bare, 'T-' || user_id AS who, CAST(event_id AS VARCHAR) AS s,
    (['low', 'medium', 'high'])[event_id % 3 + 1] AS lvl, 'S' || event_id || ',S0' AS two, event_id % 2 = 0 AS flag,
    CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE 0.5 END AS half
  FROM events
)
SELECT event_id, CASE k WHEN 0 THEN 'L1 Task Completion' WHEN 1 THEN 'L1 Task Started' WHEN 2 THEN 'L1 Task Failed'
    WHEN 3 THEN 'Optimization Impact Assessment' WHEN 4 THEN 'License Change Completed' WHEN 5 THEN 'Metric Update'
    WHEN 6 THEN 'SLA Breach Prediction' WHEN 7 THEN 'Optimization Recommendation' ELSE 'License Change Request' END AS detail_type,
  CASE WHEN bare THEN CASE k
      WHEN 0 THEN '-|completed|0|positive' WHEN 1 THEN '-|unknown|5' WHEN 2 THEN '-|unknown|false' WHEN 3 THEN '||low'
      WHEN 4 THEN '-|unknown|true' WHEN 5 THEN '|3|open|general|0.0|0.0|0.0' WHEN 6 THEN '|0.0|0.0|60||false|general|3'
      WHEN 7 THEN '|||0.0|' WHEN 8 THEN '|||-' END
    ELSE CASE k
      WHEN 0 THEN who || '|partial|' || s || '|neutral' WHEN 1 THEN who || '|reset|' || (event_id % 50)
      WHEN 2 THEN who || '|timeout|' || flag WHEN 3 THEN s || '|' || two || '|' || lvl
      WHEN 4 THEN two || '|license_removal|' || flag
      WHEN 5 THEN who || '|1|in_progress|network|' || half || '|' || (half + 7) || '|' || (half + 9)
      WHEN 6 THEN who || '|' || half || '|0.5|12|send-reminder|' || flag || '|access|2'
      WHEN 7 THEN s || '|license_reduction|' || two || '|' || (half + 100) || '|merge'
      WHEN 8 THEN s || '|license_upgrade|' || two || '|10' END END AS fields
FROM e WHERE k < 9
""")
def q_bus_event_details(spark, sf_dir):
    """A3: the envelopes of all nine detail types, decoded with their defaults."""
    d = IN.typed_details(RF.bus_detail_envelopes(spark, sf_dir))

    def shown(kind, field):
        c = F.col("details")[kind][field.name]
        if field.name == "license_details":
            return F.coalesce(c["seats"], F.lit("-"))
        if isinstance(field.dataType, T.ArrayType):
            return F.coalesce(F.array_join(c, ","), F.lit("-"))
        return F.coalesce(c.cast("string"), F.lit("-"))

    fields = F.when(F.lit(False), "")
    for kind in IN.BUS_DETAILS:
        fields = fields.when(F.col("detail_type") == kind, F.concat_ws("|", *[shown(kind, f) for f in d.schema["details"].dataType[kind].dataType]))
    return d.select("event_id", "detail_type", fields.alias("fields"))


@query("bus_event_rejects", oracle="""
SELECT event_id, 'Heartbeat' AS detail_type FROM events WHERE event_id % 10 = 9
""")
def q_bus_event_rejects(spark, sf_dir):
    return IN.bus_rejects(RF.bus_detail_envelopes(spark, sf_dir)).select("event_id", "detail_type")


@query("typed_import", oracle=f"""
WITH {S.TICKETS}
SELECT ticket_id, CASE WHEN order_key % 13 = 0 THEN NULL ELSE revenue_impact END AS revenue_impact,
  CASE WHEN order_key % 17 = 0 THEN NULL ELSE {S.ts('created_at')} END AS created_date
FROM tickets
""")
def q_typed_import(spark, sf_dir):
    t = IN.typed_projection(RF.typed_text(spark, sf_dir), ["revenue_impact"], {"created_date": "yyyy-MM-dd HH:mm:ss"})
    return t.select("ticket_id", F.col("revenue_impact").cast("double").alias("revenue_impact"),
                    fmt_ts("created_date").alias("created_date"))


_LAKE_SCHEMA = T.StructType([T.StructField("ticket_id", T.StringType()),
                             T.StructField("breach_probability", T.DoubleType()),
                             T.StructField("sla_status", T.StringType())])


@query("lake_partitioned_roundtrip", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}
SELECT 2024 AS year, 1 AS month, 31 AS day, count(*) AS tickets, round(avg(breach_probability), 6) AS avg_p,
  count(*) FILTER (WHERE breach_probability >= 0.7) AS at_risk
FROM scored WHERE CAST(created_at AS DATE) = DATE '2024-01-31'
""")
def q_lake_roundtrip(spark, sf_dir):
    """Partitioned gzip JSON written under the shared checkpoint folder, read
    back with an explicit schema; the day filter prunes partitions."""
    s = scoring.sla_metrics(fx.tickets(spark, sf_dir))
    rows = IN.with_ingest_partitions(s.select("ticket_id", "breach_probability", "sla_status", "created_at"),
                                     "created_at").drop("created_at")
    path = IN.scratch_path(spark, "lake")
    IN.write_lake_partitioned(rows, path)
    back = IN.read_lake(spark, path, _LAKE_SCHEMA).filter((F.col("year") == 2024) & (F.col("month") == 1)
                                                           & (F.col("day") == 31))
    return back.groupBy("year", "month", "day").agg(
        F.count(F.lit(1)).alias("tickets"), F.round(F.avg("breach_probability"), 6).alias("avg_p"),
        F.sum((F.col("breach_probability") >= 0.7).cast("long")).alias("at_risk"))


@query("ai_response_parse", oracle=f"""
WITH {S.TEXT_TICKETS}, {_CORE_SQL}
SELECT id, CASE id % 5 WHEN 0 THEN 'strict' WHEN 1 THEN 'extracted' WHEN 2 THEN 'repaired' WHEN 3 THEN 'extracted'
           ELSE 'scraped' END AS parse_stage,
  department, priority, category, urgency_score
FROM co
""")
def q_ai_response_parse(spark, sf_dir):
    p = RS.analysis_fields(RS.parse_responses(RF.ai_responses(spark, sf_dir)))
    return p.select("id", "parse_stage", "department", "priority", "category", "urgency_score")


@query("parsed_recommendations", oracle=f"""
WITH {S.LICENSES},
u AS (SELECT * FROM licx WHERE total_licenses > 0 AND util < 0.7 AND asset_id % 5 <> 0 AND asset_id % 7 <> 0),
r AS (
  SELECT asset_id, 0 AS rec_pos, 'LICENSE_REDUCTION' AS type,
    substr(printf('Reduce %s licenses by %d unused licenses', name, total_licenses - used_licenses), 1, 50) || '...'
      AS title, (total_licenses - used_licenses) * cost_per_license * 12 AS potential_savings, 0.85 AS confidence,
    'MEDIUM' AS priority, 'LOW' AS implementation_effort, 4 AS timeline_months, 'MEDIUM' AS risk_level,
    false AS gem_integration_required
  FROM u
  UNION ALL
  SELECT asset_id, 1, 'RENEWAL_OPTIMIZATION', 'Renewal review', 0.0, 0.8, 'LOW', 'MEDIUM', 3, 'LOW', true FROM u
)
SELECT asset_id, rec_pos, type, title, potential_savings, CAST(confidence AS DOUBLE) AS confidence, priority,
  implementation_effort, timeline_months, risk_level, 'Positive' AS compliance_impact, gem_integration_required,
  true AS approval_needed
FROM r
""")
def q_parsed_recommendations(spark, sf_dir):
    p = RS.parse_recommendations(RF.recommendation_texts(spark, sf_dir))
    return p.select("asset_id", "rec_pos", "type", "title", "potential_savings", "confidence", "priority",
                    "implementation_effort", "timeline_months", "risk_level", "compliance_impact",
                    "gem_integration_required", "approval_needed")


@query("prediction_responses", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}, {_PRED_SQL},
x AS (SELECT order_key AS id, final_p, CAST(floor(min_rem / 60) + 1 AS BIGINT) AS hours, order_key % 6 AS k,
             floor(final_p * 100) AS pct FROM pred2)
SELECT id, CASE WHEN k < 2 THEN 'strict' WHEN k = 2 THEN 'extracted' ELSE 'scraped' END AS parse_stage,
  CASE WHEN k <= 2 THEN final_p WHEN k = 3 THEN CASE WHEN pct > 1 THEN least(pct / 100.0, 1.0) ELSE pct END
       WHEN k = 4 THEN 0.35 ELSE 0.5 END::DOUBLE AS breach_probability,
  CASE k WHEN 0 THEN 0.6 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence,
  CASE k WHEN 0 THEN hours WHEN 1 THEN 24 WHEN 2 THEN hours WHEN 3 THEN greatest(abs(hours), 1) WHEN 4 THEN 24 ELSE 1 END::DOUBLE
    AS estimated_hours
FROM x
""")
def q_prediction_responses(spark, sf_dir):
    """H14 + H18 + H19: stored prediction replies -> parse stage -> nested fields with
    defaults (JSON) or the regex scrape (free text)."""
    p = RS.flatten_prediction(RS.parse_responses(RF.prediction_texts(spark, sf_dir)))
    s = RS.scrape_prediction(F.col("raw"))
    js = F.col("parse_stage") != "scraped"
    return p.select("id", "parse_stage",
                    F.when(js, F.col("breach_probability")).otherwise(s["breach_probability"])
                    .alias("breach_probability"),
                    F.when(js, F.col("prediction_confidence")).otherwise(s["confidence"]).alias("confidence"),
                    F.when(js, F.col("estimated_hours")).otherwise(s["estimated_hours"]).alias("estimated_hours"))


_SECTION_SQL = f"""
s AS (SELECT doc_id AS id, unnest({RS.REQUIRED_SECTIONS}) AS section, unnest(range(0, {len(RS.REQUIRED_SECTIONS)})) AS k FROM documents)"""


@query("ai_response_sections", oracle=f"""
WITH {_SECTION_SQL}
SELECT id, CASE WHEN id % 13 = 12 THEN 'scraped' WHEN id % 2 = 0 THEN 'strict' ELSE 'extracted' END AS parse_stage,
  coalesce(string_agg(section, ',' ORDER BY k) FILTER (WHERE id % 13 <> 12 AND (id % 11 = 0 OR (id + k) % 3 = 0)), '') AS missing_sections,
  count(*) FILTER (WHERE id % 13 <> 12) AS sections, true AS parsed_successfully, '2024-02-01 00:00:00' AS analysis_timestamp
FROM s GROUP BY id
""")
def q_ai_response_sections(spark, sf_dir):
    """Sections that a reply leaves out are reported and there all the same, empty."""
    p = RS.with_sections(RS.parse_responses(RF.sectioned_responses(spark, sf_dir)))
    there = F.size(F.array_intersect(F.coalesce(F.json_object_keys("json_text"), F.array().cast("array<string>")),
                                     F.array(*[F.lit(x) for x in RS.REQUIRED_SECTIONS]))).cast("bigint")
    return p.select("id", "parse_stage", F.array_join("missing_sections", ",").alias("missing_sections"), there.alias("sections"),
                    "parsed_successfully", fmt_ts("analysis_timestamp").alias("analysis_timestamp"))
