"""Registered queries: state versions, status-event folding, change gating."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import fmt_ts
from ..operators import impact as I
from ..operators import scoring
from ..operators import state as ST
from ..operators.asof import as_of_join
from ..sources import fixtures as fx
from . import sqlfix as S
from .registry import query


def _versions(spark, sf_dir):
    return ST.apply_status_events(fx.initial_state(spark, sf_dir), fx.status_events(spark, sf_dir))


@query("status_event_fold", oracle=f"""
WITH {S.STATUS_FOLD}
SELECT service_id, event_id, detail_type, {S.ts('version_ts')} AS version_ts, CAST(update_seq AS BIGINT) AS update_seq,
  breach_probability, {S.bucket('breach_probability')} AS breach_bucket,
  {S.status('breach_probability')} AS sla_status,
  CAST(response_remaining AS DOUBLE) AS response_remaining, CAST(resolution_remaining AS DOUBLE) AS resolution_remaining
FROM sv
""")
def q_status_event_fold(spark, sf_dir):
    v = _versions(spark, sf_dir)
    return v.select("service_id", "event_id", "detail_type", fmt_ts("version_ts").alias("version_ts"), "update_seq",
                    "breach_probability", "breach_bucket", "sla_status", "response_remaining",
                    "resolution_remaining")


@query("latest_service_state", oracle=f"""
WITH {S.STATUS_FOLD},
allv AS (
  SELECT service_id, 0 AS update_seq, p0 AS breach_probability, r0 AS response_remaining,
         TIMESTAMP '2023-12-31 00:00:00' AS version_ts FROM sst
  UNION ALL
  SELECT service_id, update_seq, breach_probability, response_remaining, version_ts FROM sv
)
SELECT service_id, arg_max(update_seq, (version_ts, update_seq)) AS update_seq,
  arg_max(breach_probability, (version_ts, update_seq)) AS breach_probability,
  arg_max(CAST(response_remaining AS DOUBLE), (version_ts, update_seq)) AS response_remaining,
  {S.bucket('arg_max(breach_probability, (version_ts, update_seq))')} AS breach_bucket
FROM allv GROUP BY service_id
""")
def q_latest_state(spark, sf_dir):
    latest = ST.latest_after_events(fx.initial_state(spark, sf_dir), fx.status_events(spark, sf_dir))
    return latest.select("service_id", "update_seq", "breach_probability", "response_remaining", "breach_bucket")


@query("missing_state_events", oracle=f"""
WITH {S.STATUS_FOLD}
SELECT service_id, count(*) AS dropped_events FROM sev
WHERE service_id NOT IN (SELECT service_id FROM sst) GROUP BY service_id
""")
def q_missing_state(spark, sf_dir):
    m = ST.missing_state(fx.initial_state(spark, sf_dir), fx.status_events(spark, sf_dir))
    return m.groupBy("service_id").agg(F.count(F.lit(1)).alias("dropped_events"))


@query("live_state_versions", oracle=f"""
WITH {S.STATUS_FOLD}
SELECT service_id, count(*) AS live_versions,
  {S.ts('min(version_ts + INTERVAL 90 DAY)')} AS next_expiry
FROM sv WHERE version_ts + INTERVAL 90 DAY > TIMESTAMP '2024-04-15 00:00:00'
GROUP BY service_id
""")
def q_live_versions(spark, sf_dir):
    live = ST.expire_state(_versions(spark, sf_dir), as_of="2024-04-15 00:00:00")
    return live.groupBy("service_id").agg(F.count(F.lit(1)).alias("live_versions"),
                                          fmt_ts(F.min("expire_at")).alias("next_expiry"))


_ASSET_SQL = f"""
wanted AS (
  SELECT DISTINCT unnest(list_transform(range(0, o_orderkey % 6 + 1), lambda i: CASE WHEN i % 2 = 0 THEN 'AST-' ELSE 'LIC-' END
                  || CAST(o_custkey + i AS VARCHAR))) AS asset_id
  FROM orders
),
atok AS (
  SELECT asset_id, breach_probability AS p FROM wanted JOIN scored ON contains(title, asset_id) OR contains(description, asset_id)
),
ast AS (
  SELECT asset_id, avg(p) AS avg_breach_probability, count(*) FILTER (WHERE p >= 0.7) AS at_risk_services,
         count(*) FILTER (WHERE p < 0.7) AS healthy_services, count(*) AS total_services,
         CASE WHEN avg(p) >= 0.5 THEN 'at_risk' ELSE 'healthy' END AS overall_status
  FROM atok GROUP BY asset_id
)"""


@query("asset_sla_status", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}, {_ASSET_SQL}
SELECT asset_id, round(avg_breach_probability, 6) AS avg_breach_probability, at_risk_services, healthy_services,
  total_services, overall_status FROM ast
""")
def q_asset_sla_status(spark, sf_dir):
    a = I.asset_sla_status(scoring.sla_metrics(fx.tickets(spark, sf_dir)), I.requested_assets(fx.change_requests(spark, sf_dir)))
    return a.select("asset_id", F.round("avg_breach_probability", 6).alias("avg_breach_probability"),
                    "at_risk_services", "healthy_services", "total_services", "overall_status")


_CR_SQL = """
cr AS (
  SELECT o_orderkey AS optimization_id, o_totalprice AS potential_savings,
         list_transform(range(0, o_orderkey % 6 + 1), lambda i: CASE WHEN i % 2 = 0 THEN 'AST-' ELSE 'LIC-' END
                        || CAST(o_custkey + i AS VARCHAR)) AS affected_assets,
         CAST(o_orderkey % 3 + 1 AS INTEGER) AS n_changes
  FROM orders
),
shapes AS (
  SELECT * FROM (VALUES (0, 'license_reduction', 60.0, 0), (1, 'license_reduction', 30.0, 0),
                        (2, 'license_reduction', 10.0, 0), (3, 'license_consolidation', 0.0, 6),
                        (4, 'license_consolidation', 0.0, 2), (5, 'vendor_change', 0.0, 0))
    t(shape_idx, ctype, pct, depts)
),
cra AS (
  SELECT cr.*, a.asset_pos, a.asset_id
  FROM cr, LATERAL (SELECT generate_subscripts(cr.affected_assets, 1) - 1 AS asset_pos,
                           unnest(cr.affected_assets) AS asset_id) a
),
crc AS (
  SELECT cra.optimization_id, cra.potential_savings, cra.asset_pos, cra.asset_id, ci.i AS change_idx,
         s.ctype, CAST(s.pct AS DOUBLE) AS pct, s.depts,
         coalesce(ast.overall_status, 'healthy') = 'at_risk' AS at_risk
  FROM cra
  JOIN (SELECT range AS i FROM range(0, 3)) ci ON ci.i < cra.n_changes
  JOIN shapes s ON s.shape_idx = (cra.optimization_id + 2 * ci.i) % 6
  LEFT JOIN ast ON ast.asset_id = cra.asset_id
),
crr AS (
  SELECT *,
    CASE WHEN ctype = 'license_reduction' AND pct > 50 THEN 'high'
         WHEN ctype = 'license_reduction' AND pct > 25 THEN 'medium'
         WHEN ctype = 'license_consolidation' AND depts > 5 THEN 'medium'
         WHEN ctype = 'vendor_change' THEN 'high' ELSE 'low' END AS base_level,
    CASE WHEN ctype = 'license_reduction' AND pct > 50 THEN 'Large license reduction (' || CAST(pct AS VARCHAR) || '%)'
         WHEN ctype = 'license_reduction' AND pct > 25 THEN 'Moderate license reduction (' || CAST(pct AS VARCHAR) || '%)'
         WHEN ctype = 'license_consolidation' AND depts > 5
           THEN 'Multiple departments affected (' || CAST(depts AS VARCHAR) || ')'
         WHEN ctype = 'vendor_change' THEN 'Vendor change introduces operational risk' END AS factor
  FROM crc
),
crl AS (
  SELECT *,
    CASE WHEN at_risk THEN CASE base_level WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' ELSE base_level END
         ELSE base_level END AS level,
    list_filter([factor, CASE WHEN at_risk THEN 'Current SLA status is at risk' END], lambda x: x IS NOT NULL)
      AS factors
  FROM crr
),
crh AS (
  SELECT *, coalesce(bool_or(level = 'high') OVER (PARTITION BY optimization_id, asset_pos ORDER BY change_idx
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS high_before
  FROM crl
),
per_asset AS (
  SELECT optimization_id, asset_pos, any_value(asset_id) AS asset_id, any_value(potential_savings) AS potential_savings,
    CASE WHEN bool_or(level = 'high') THEN 'high' WHEN bool_or(level = 'medium') THEN 'medium' ELSE 'low' END AS alevel,
    flatten(list(CASE WHEN level = 'high' OR (level = 'medium' AND NOT high_before) THEN factors END
                 ORDER BY change_idx) FILTER (WHERE level = 'high' OR (level = 'medium' AND NOT high_before)))
      AS afactors
  FROM crh GROUP BY optimization_id, asset_pos
)"""


@query("optimization_decisions", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}, {_ASSET_SQL}, {_CR_SQL},
g AS (
  SELECT optimization_id, any_value(potential_savings) AS potential_savings,
    count(*) FILTER (WHERE alevel = 'high') AS high_risk_assets,
    count(*) FILTER (WHERE alevel = 'medium') AS medium_risk_assets,
    coalesce(flatten(list(afactors ORDER BY asset_pos) FILTER (WHERE alevel = 'high')), []) AS risk_factors,
    coalesce(list(asset_id ORDER BY asset_pos) FILTER (WHERE alevel = 'high'), [])
      || coalesce(list(asset_id ORDER BY asset_pos) FILTER (WHERE alevel = 'medium'), []) AS affected
  FROM per_asset GROUP BY optimization_id
),
h AS (
  SELECT *, CASE WHEN high_risk_assets > 0 THEN 'high' WHEN medium_risk_assets > 3 THEN 'medium' ELSE 'low' END AS o
  FROM g
)
SELECT optimization_id, high_risk_assets, medium_risk_assets, o AS overall_risk_level,
  CASE WHEN o = 'high' THEN false WHEN o = 'medium' THEN potential_savings > 100000 ELSE true END AS approved,
  CASE WHEN o = 'medium' AND potential_savings > 100000 THEN 'conditional' ELSE 'automatic' END AS approval_level,
  array_to_string(risk_factors, '; ') AS risk_factors, array_to_string(affected, ',') AS affected_services,
  CASE WHEN o = 'high' THEN 'High SLA risk identified'
       WHEN o = 'medium' AND potential_savings > 100000 THEN 'Medium risk acceptable due to high savings'
       WHEN o = 'medium' THEN 'Medium risk not justified by savings amount' ELSE 'Low SLA risk identified' END
    AS reasoning,
  CASE o WHEN 'high' THEN 'Defer optimization until SLA risk is reduced' WHEN 'medium' THEN 'Implement changes in phases' ELSE '' END
    AS mitigation,
  CASE WHEN o = 'medium' AND potential_savings > 100000
       THEN 'Implement in phases; Monitor SLA impact closely; Prepare rollback plan' ELSE '' END AS conditions
FROM h
""")
def q_optimization_decisions(spark, sf_dir):
    requests = fx.change_requests(spark, sf_dir)
    a = I.asset_sla_status(scoring.sla_metrics(fx.tickets(spark, sf_dir)), I.requested_assets(requests))
    d = I.optimization_decisions(requests, a)
    return d.select("optimization_id", "high_risk_assets", "medium_risk_assets", "overall_risk_level", "approved",
                    "approval_level", F.array_join("risk_factors", "; ").alias("risk_factors"),
                    F.array_join("affected_services", ",").alias("affected_services"), "reasoning",
                    F.array_join("mitigation_recommendations", "; ").alias("mitigation"),
                    F.array_join("conditions", "; ").alias("conditions"))


_LICENSE_SQL = f"""
lc AS (
  SELECT event_id AS change_id,
    (['license_downgrade', 'license_removal', 'license_upgrade'])[CAST(floor(value) AS BIGINT) % 3 + 1] AS change_type,
    unnest(list_transform(range(0, event_id % 5 + 1), lambda i: user_id + i)) AS service_id,
    unnest(range(0, event_id % 5 + 1)) AS pos
  FROM events WHERE event_type = 'signup'
),
r AS (
  SELECT change_id, pos,
         concat_ws('; ', CASE change_type WHEN 'license_downgrade' THEN 'License downgrade may affect functionality'
           WHEN 'license_removal' THEN 'License removal will affect service availability' END,
           CASE WHEN coalesce(p, 0.2) >= 0.7 THEN printf('Service already at risk (breach probability: %.1f%%)', round(p * 100.0, 1)) END) AS f,
         CASE WHEN coalesce(p, 0.2) >= 0.7 THEN
           CASE change_type WHEN 'license_downgrade' THEN 'high' WHEN 'license_removal' THEN 'high' ELSE 'medium' END
         ELSE CASE change_type WHEN 'license_downgrade' THEN 'medium' WHEN 'license_removal' THEN 'high' ELSE 'low' END
         END AS lvl
  FROM lc LEFT JOIN latest USING (service_id)
),
g AS (
  SELECT change_id, count(*) FILTER (WHERE lvl = 'high') AS high_risk_services,
    count(*) FILTER (WHERE lvl = 'medium') AS medium_risk_services,
    count(*) FILTER (WHERE lvl = 'low') AS low_risk_services,
    coalesce(string_agg(f, '; ' ORDER BY pos) FILTER (f <> ''), '') AS risk_factors
  FROM r GROUP BY change_id
)
SELECT *, CASE WHEN high_risk_services > 0 THEN 'high' WHEN medium_risk_services > 2 THEN 'medium' ELSE 'low' END
    AS overall_risk,
  high_risk_services = 0 AS approved,
  CASE WHEN high_risk_services = 0 AND medium_risk_services > 0 THEN 'conditional' ELSE 'automatic' END
    AS approval_level,
  CASE WHEN high_risk_services = 0 AND medium_risk_services > 0
       THEN 'Stagger implementation across services; Monitor affected services for 24 hours; Have rollback procedure ready'
       ELSE '' END AS conditions,
  CASE WHEN high_risk_services > 0 THEN 'High risk services identified: ' || high_risk_services
       WHEN medium_risk_services > 0 THEN 'Medium risk services require careful monitoring: ' || medium_risk_services END AS reasoning
FROM g
"""


@query("license_change_decisions", oracle=f"""
WITH {S.STATUS_FOLD},
allv AS (
  SELECT service_id, 0 AS update_seq, p0 AS breach_probability, TIMESTAMP '2023-12-31 00:00:00' AS version_ts FROM sst
  UNION ALL SELECT service_id, update_seq, breach_probability, version_ts FROM sv
),
latest AS (SELECT service_id, arg_max(breach_probability, (version_ts, update_seq)) AS p FROM allv GROUP BY service_id),
{_LICENSE_SQL}
""")
def q_license_change_decisions(spark, sf_dir):
    latest = ST.latest_after_events(fx.initial_state(spark, sf_dir), fx.status_events(spark, sf_dir))
    d = I.license_change_decisions(fx.license_changes(spark, sf_dir), latest)
    return d.select("change_id", "high_risk_services", "medium_risk_services", "low_risk_services", "overall_risk",
                    "approved", "approval_level", F.array_join("conditions", "; ").alias("conditions"), "reasoning",
                    F.array_join("risk_factors", "; ").alias("risk_factors"))


_VERSIONS_SQL = """
allv AS (
  SELECT service_id, 0 AS update_seq, p0 AS breach_probability, r0 AS response_remaining, q0 AS resolution_remaining,
         TIMESTAMP '2023-12-31 00:00:00' AS version_ts FROM sst
  UNION ALL SELECT service_id, update_seq, breach_probability, response_remaining, resolution_remaining, version_ts FROM sv
),
one AS (SELECT service_id, version_ts, max(update_seq) AS update_seq, arg_max(breach_probability, update_seq) AS breach_probability,
               arg_max(response_remaining, update_seq) AS response_remaining, arg_max(resolution_remaining, update_seq) AS resolution_remaining
        FROM allv GROUP BY service_id, version_ts)"""

_CHANGED_SQL = """
ch AS (SELECT event_id AS change_id, ts AS changed_at, unnest(list_transform(range(0, event_id % 5 + 1), lambda i: user_id + i)) AS service_id,
         unnest(range(0, event_id % 5 + 1)) AS pos FROM events WHERE event_type = 'signup')"""


def _all_versions(spark, sf_dir):
    return ST.all_versions(fx.initial_state(spark, sf_dir), _versions(spark, sf_dir))


@query("license_change_states_as_of", oracle=f"""
WITH {S.STATUS_FOLD}, {_VERSIONS_SQL}, {_CHANGED_SQL}
SELECT change_id, CAST(pos AS INTEGER) AS pos, ch.service_id, coalesce(breach_probability, 0.2) AS breach_probability,
  CASE WHEN breach_probability IS NULL THEN 'HEALTHY' ELSE {S.status('breach_probability')} END AS sla_status,
  CAST(coalesce(response_remaining, 60) AS DOUBLE) AS response_remaining, CAST(coalesce(resolution_remaining, 240) AS DOUBLE) AS resolution_remaining
FROM ch ASOF LEFT JOIN one ON ch.service_id = one.service_id AND ch.changed_at >= one.version_ts
""")
def q_license_states_as_of(spark, sf_dir):
    """C5 with as_of: each service of a licence change with the state valid when the change was asked for."""
    ch = fx.license_changes(spark, sf_dir).select("change_id", "changed_at", F.posexplode("affected_services").alias("pos", "service_id"))
    found = I.service_states(ch, _all_versions(spark, sf_dir), "changed_at", "update_seq")
    return found.select("change_id", "pos", "service_id", "breach_probability", "sla_status", "response_remaining", "resolution_remaining")


@query("license_change_decisions_as_of", oracle=f"""
WITH {S.STATUS_FOLD}, {_VERSIONS_SQL}, {_CHANGED_SQL},
seen AS (SELECT change_id, pos, ch.service_id, one.breach_probability AS p
         FROM ch ASOF LEFT JOIN one ON ch.service_id = one.service_id AND ch.changed_at >= one.version_ts),
{_LICENSE_SQL.replace("LEFT JOIN latest USING (service_id)", "LEFT JOIN seen USING (change_id, pos, service_id)")}
""")
def q_license_decisions_as_of(spark, sf_dir):
    """C5 + V4 + V5: every change judged by the states valid when it was asked for."""
    d = I.license_change_decisions(fx.license_changes(spark, sf_dir), _all_versions(spark, sf_dir), "changed_at", "update_seq")
    return d.select("change_id", "high_risk_services", "medium_risk_services", "low_risk_services", "overall_risk",
                    "approved", "approval_level", F.array_join("conditions", "; ").alias("conditions"), "reasoning",
                    F.array_join("risk_factors", "; ").alias("risk_factors"))


@query("status_events_prior_state", oracle=f"""
WITH {S.STATUS_FOLD}, {_VERSIONS_SQL}
SELECT e.event_id, e.service_id, CAST(coalesce(one.update_seq, -1) AS BIGINT) AS prior_seq, one.breach_probability AS prior_probability
FROM sev e ASOF LEFT JOIN one ON e.service_id = one.service_id AND e.event_ts > one.version_ts
""")
def q_status_events_prior_state(spark, sf_dir):
    """C7 with as_of: every status event with the state before it (-1 and null where the service has none)."""
    ev = fx.status_events(spark, sf_dir).filter("detail_type <> 'Unknown'").select("event_id", "service_id", "event_ts")
    versions = _all_versions(spark, sf_dir).select("service_id", "version_ts", "update_seq", "breach_probability")
    found = as_of_join(ev, versions, "service_id", "event_ts", "version_ts", "update_seq", strict=True)
    return found.select("event_id", "service_id", F.coalesce("version.update_seq", F.lit(-1)).alias("prior_seq"),
                        F.col("version.breach_probability").alias("prior_probability"))


@query("latest_service_state_as_of", oracle=f"""
WITH {S.STATUS_FOLD}, {_VERSIONS_SQL}
SELECT service_id, arg_max(update_seq, (version_ts, update_seq)) AS update_seq,
  arg_max(breach_probability, (version_ts, update_seq)) AS breach_probability
FROM one WHERE version_ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY service_id
""")
def q_latest_state_as_of(spark, sf_dir):
    """E2 at a time of the user's choice."""
    latest = ST.latest_state(_all_versions(spark, sf_dir), tie="update_seq", as_of="2024-01-15 12:00:00")
    return latest.select("service_id", "update_seq", "breach_probability")
