"""Registered queries: licence portfolio, recommendations, procurement and quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import licenses as L
from ..operators import procurement as P
from ..operators.util import with_scalars
from ..sources import fixtures as fx
from . import sqlfix as S
from .registry import query
from ..session import cut_lineage


def _lic(spark, sf_dir):
    return fx.licenses(spark, sf_dir)


def _lic_shared(spark, sf_dir):
    """Licences for queries with several branches (reductions, consolidation,
    renewals; totals and vendor shares).  The branches prune different columns, so
    Spark would re-aggregate lineitem once per branch; the part-sized result is
    aggregated once and checkpointed to the shared checkpoint folder instead."""
    return cut_lineage(fx.licenses(spark, sf_dir))


@query("underutilized_licenses", oracle=f"""
WITH {S.LICENSES}
SELECT asset_id, util AS utilization_rate, total_licenses - used_licenses AS unused_licenses,
  (total_licenses - used_licenses) * cost_per_license * 12 AS waste_cost_annual,
  printf('Reduce licenses to %d (20%% buffer)', reduce_to) AS recommendation,
  CASE WHEN used_licenses < total_licenses * 0.5::DOUBLE THEN 'declining' ELSE 'stable' END AS trend,
  CASE WHEN used_licenses < total_licenses * 0.6::DOUBLE THEN 'negative_growth' ELSE 'stable' END AS growth_prediction,
  CASE WHEN util < 0.3 THEN 'Consider reducing licenses by 60-70% or canceling subscription'
       WHEN util < 0.5 THEN 'Reduce licenses by 40-50% to optimize costs'
       WHEN util < 0.7 THEN 'Reduce licenses by 20-30% based on actual usage'
       ELSE 'Monitor usage patterns for future optimization' END AS advice
FROM licx WHERE total_licenses > 0 AND util < 0.7
""")
def q_underutilized(spark, sf_dir):
    u = L.underutilized(_lic(spark, sf_dir))
    return u.select("asset_id", "utilization_rate", "unused_licenses", "waste_cost_annual", "recommendation",
                    "trend", "growth_prediction", "advice")


@query("top_waste_assets", oracle=f"""
WITH {S.LICENSES}
SELECT asset_id, (total_licenses - used_licenses) * cost_per_license * 12 AS waste_cost_annual
FROM licx WHERE total_licenses > 0 AND util < 0.7
ORDER BY waste_cost_annual DESC, asset_id LIMIT 5
""")
def q_top_waste(spark, sf_dir):
    u = L.underutilized(_lic(spark, sf_dir))
    return u.orderBy(F.col("waste_cost_annual").desc(), "asset_id").limit(5).select("asset_id", "waste_cost_annual")


@query("renewal_alerts", oracle=f"""
WITH {S.LICENSES}
SELECT asset_id, renewal_date, days AS days_to_renewal, monthly_cost AS current_cost,
  monthly_cost * 0.15::DOUBLE AS optimization_opportunity,
  CASE lower(vendor) {' '.join(f"WHEN '{k}' THEN '{', '.join(v)}'" for k, v in L.MARKET_ALTERNATIVES.items())}
       ELSE '{', '.join(L.MARKET_ALTERNATIVES_DEFAULT)}' END AS market_alternatives
FROM licx WHERE days BETWEEN 0 AND 90
""")
def q_renewals(spark, sf_dir):
    r = L.renewal_alerts(_lic(spark, sf_dir))
    return r.select("asset_id", "renewal_date", "days_to_renewal", "current_cost", "optimization_opportunity",
                    F.array_join(L.market_alternatives(F.col("vendor")), ", ").alias("market_alternatives"))


@query("portfolio_summary", oracle=f"""
WITH {S.LICENSES},
a AS (
  SELECT count(*) AS total_assets, sum(monthly_cost) AS total_cost, sum(total_licenses) AS total_licenses,
    sum(used_licenses) AS total_used,
    sum(CASE WHEN total_licenses > 0 AND util < 0.7 THEN (total_licenses - reduce_to) * cost_per_license * 12
             ELSE 0.0 END) AS optimization_potential,
    sum(CASE WHEN total_licenses > 0 AND util < 0.7 THEN (total_licenses - used_licenses) * cost_per_license * 12
             ELSE 0.0 END) AS optimization_potential_agent,
    avg(CASE WHEN total_licenses > 0 THEN util END) AS avg_valid, avg(util) AS avg_all,
    count(DISTINCT vendor) AS unique_vendors,
    count(*) FILTER (WHERE days BETWEEN 0 AND 90) AS renewals_due,
    count(*) FILTER (WHERE days <= 90) AS renewals_incl_past,
    count(*) FILTER (WHERE total_licenses > 0 AND util < 0.7) AS underutilized_count,
    count(*) FILTER (WHERE comm) AS communication_tools,
    count(*) FILTER (WHERE monthly_cost > 100000) AS high_cost_assets
  FROM licx
),
v AS (SELECT vendor, sum(monthly_cost) AS spend FROM licx GROUP BY vendor),
c AS (SELECT CASE WHEN sum(spend) > 0 THEN max(spend) / sum(spend) ELSE 0.0 END AS share FROM v)
SELECT total_assets, round(total_cost, 2) AS total_cost, CAST(total_licenses AS BIGINT) AS total_licenses,
  CAST(total_used AS BIGINT) AS total_used, round(optimization_potential, 2) AS optimization_potential,
  round(optimization_potential_agent, 2) AS optimization_potential_agent, unique_vendors, renewals_due,
  underutilized_count, communication_tools, high_cost_assets,
  round(total_cost * 12, 2) AS total_annual_cost,
  round(CASE WHEN total_licenses > 0 THEN total_used / total_licenses ELSE 0.0 END, 6) AS overall_utilization_rate,
  CASE WHEN (CASE WHEN total_licenses > 0 THEN total_used / total_licenses ELSE 0.0 END) < 0.6 THEN 'Medium'
       ELSE 'Low' END AS risk_assessment,
  round((coalesce(avg_valid, 0.0) * 0.5 + least(unique_vendors / total_assets, 1.0) * 0.2
         + (1.0 - renewals_due / total_assets) * 0.3) * 100, 2) AS health_score,
  round((avg_all * 0.4 + least(unique_vendors / total_assets, 1.0) * 0.3
         + (1.0 - renewals_incl_past / total_assets) * 0.3) * 100, 2) AS health_score_agent,
  round(c.share, 6) AS max_vendor_share,
  CASE WHEN c.share > 0.4 THEN 'high' WHEN c.share > 0.2 THEN 'medium' ELSE 'low' END AS vendor_concentration_risk
FROM a CROSS JOIN c
""")
def q_portfolio_summary(spark, sf_dir):
    lic = _lic_shared(spark, sf_dir)
    m = with_scalars(L.portfolio_metrics(lic), L.vendor_concentration(lic))
    r2 = lambda c: F.round(c, 2).alias(c)
    return m.select("total_assets", r2("total_cost"), "total_licenses", "total_used", r2("optimization_potential"),
                    r2("optimization_potential_agent"), "unique_vendors", "renewals_due", "underutilized_count",
                    "communication_tools", "high_cost_assets", r2("total_annual_cost"),
                    F.round("overall_utilization_rate", 6).alias("overall_utilization_rate"), "risk_assessment",
                    F.round("health_score", 2).alias("health_score"),
                    F.round("health_score_agent", 2).alias("health_score_agent"),
                    F.round("max_vendor_share", 6).alias("max_vendor_share"), "vendor_concentration_risk")


@query("vendor_spend_top5", oracle=f"""
WITH {S.LICENSES}
SELECT vendor, round(sum(monthly_cost), 2) AS spend FROM licx GROUP BY vendor
ORDER BY sum(monthly_cost) DESC, vendor LIMIT 5
""")
def q_top_vendors(spark, sf_dir):
    return L.top_vendors(_lic(spark, sf_dir)).select("vendor", F.round("spend", 2).alias("spend"))


@query("department_spend", oracle=f"""
WITH {S.LICENSES}
SELECT department, round(sum(monthly_cost), 2) AS spend FROM licx GROUP BY department
""")
def q_department_spend(spark, sf_dir):
    return L.department_spend(_lic(spark, sf_dir)).select("department", F.round("spend", 2).alias("spend"))


@query("duplicate_tools", oracle=f"""
WITH {S.LICENSES}
SELECT count(*) AS assets, round(sum(monthly_cost), 2) AS total_cost, min(asset_id) AS first_asset_id,
  'Communication Tools' AS category, round(sum(monthly_cost) * 0.4, 2) AS consolidation_opportunity
FROM licx WHERE comm HAVING count(*) > 1
""")
def q_duplicate_tools(spark, sf_dir):
    s, _ = L.duplicate_tools(_lic(spark, sf_dir))
    return s.select("assets", F.round("total_cost", 2).alias("total_cost"), "first_asset_id", "category",
                    F.round("consolidation_opportunity", 2).alias("consolidation_opportunity"))


@query("duplicate_vendors", oracle=f"""
WITH {S.LICENSES}
SELECT lower(vendor) AS vendor, count(*) AS assets, round(sum(monthly_cost), 2) AS total_cost,
  round(sum(monthly_cost) * 0.3, 2) AS consolidation_opportunity
FROM licx GROUP BY lower(vendor) HAVING count(*) > 1
""")
def q_duplicate_vendors(spark, sf_dir):
    d = L.duplicate_vendors(_lic(spark, sf_dir))
    return d.select("vendor", "assets", F.round("total_cost", 2).alias("total_cost"),
                    F.round("consolidation_opportunity", 2).alias("consolidation_opportunity"))


def _recs_cte(top_red: str, top_ren: str) -> str:
    return f"""
WITH {S.LICENSES},
red AS (
  SELECT asset_id, 'LICENSE_REDUCTION' AS recommendation_type,
    printf('Reduce %s licenses by %d unused licenses', name, total_licenses - used_licenses) AS description,
    (total_licenses - used_licenses) * cost_per_license * 12 AS potential_savings, 0.85 AS confidence_score,
    CASE WHEN (total_licenses - used_licenses) * cost_per_license * 12 > 100000 THEN 'HIGH' ELSE 'MEDIUM' END AS priority
  FROM licx WHERE total_licenses > 0 AND util < 0.7
  ORDER BY potential_savings DESC, asset_id {top_red}
),
cons AS (
  SELECT min(asset_id) AS asset_id, 'CONSOLIDATION' AS recommendation_type,
    'Consolidate Communication Tools to eliminate overlap and reduce costs' AS description,
    sum(monthly_cost) * 0.4::DOUBLE AS potential_savings, 0.75 AS confidence_score, 'HIGH' AS priority
  FROM licx WHERE comm HAVING count(*) > 1
),
ren AS (
  SELECT * FROM (
    SELECT asset_id, 'RENEWAL_OPTIMIZATION' AS recommendation_type,
      printf('Optimize %s renewal terms and negotiate better pricing', name) AS description,
      monthly_cost * 0.15::DOUBLE AS potential_savings, 0.70 AS confidence_score, 'MEDIUM' AS priority
    FROM licx WHERE days BETWEEN 0 AND 90 ORDER BY days, asset_id {top_ren}) r
  WHERE potential_savings > 0
),
allr AS (SELECT * FROM red UNION ALL SELECT * FROM cons UNION ALL SELECT * FROM ren)"""


def _recs_sql(top_red: str, top_ren: str) -> str:
    return _recs_cte(top_red, top_ren) + """
SELECT 'REC-' || recommendation_type || '-' || CAST(asset_id AS VARCHAR) AS recommendation_id, asset_id,
  recommendation_type, description, potential_savings,
  CAST(confidence_score AS DOUBLE) AS confidence_score, priority
FROM allr"""


def _recs_out(r):
    return r.select("recommendation_id", "asset_id", "recommendation_type", "description",
                    "potential_savings", "confidence_score", "priority")


@query("license_recommendations", oracle=_recs_sql("LIMIT 3", "LIMIT 2"))
def q_recommendations(spark, sf_dir):
    return _recs_out(L.recommendations(_lic_shared(spark, sf_dir)))


@query("license_recommendations_all", oracle=_recs_sql("", ""))
def q_recommendations_all(spark, sf_dir):
    return _recs_out(L.recommendations(_lic_shared(spark, sf_dir), top_reduction=None, top_renewal=None))


@query("procurement_approvals", oracle=_recs_cte("", "") + """,
c AS (
  SELECT *, 'REC-' || recommendation_type || '-' || CAST(asset_id AS VARCHAR) AS recommendation_id,
    potential_savings * 0.05::DOUBLE *
    CASE recommendation_type WHEN 'LICENSE_REDUCTION' THEN 1.0 WHEN 'CONSOLIDATION' THEN 2.0
         WHEN 'RENEWAL_OPTIMIZATION' THEN 0.5 ELSE 1.0 END::DOUBLE AS impl
  FROM allr
)
SELECT 'GEM-' || recommendation_id AS gem_request_id, recommendation_type,
  CASE recommendation_type WHEN 'LICENSE_REDUCTION' THEN 'Software Licenses' WHEN 'CONSOLIDATION' THEN 'Software Services'
       WHEN 'RENEWAL_OPTIMIZATION' THEN 'Software Maintenance' ELSE 'Software Services' END AS subcategory,
  CASE recommendation_type WHEN 'LICENSE_REDUCTION' THEN 'IT-SW-001' WHEN 'CONSOLIDATION' THEN 'IT-SV-002'
       WHEN 'RENEWAL_OPTIMIZATION' THEN 'IT-MT-003' ELSE 'IT-SV-000' END AS gem_code,
  CASE recommendation_type WHEN 'LICENSE_REDUCTION' THEN '30-45 days' WHEN 'CONSOLIDATION' THEN '60-90 days'
       WHEN 'RENEWAL_OPTIMIZATION' THEN '15-30 days' ELSE '45-60 days' END AS delivery_timeline,
  impl AS implementation_cost, potential_savings - impl AS net_benefit,
  CASE WHEN potential_savings / 12 > 0 THEN greatest(CAST(trunc(impl / (potential_savings / 12)) AS BIGINT), 1)
       ELSE 12 END AS payback_period_months,
  CASE WHEN impl > 0 THEN (potential_savings - impl) / impl * 100 ELSE 0.0 END AS roi_percentage,
  CASE WHEN potential_savings >= 5000000 THEN 'LEVEL_4_CEO' WHEN potential_savings >= 2000000 THEN 'LEVEL_3_CTO'
       WHEN potential_savings >= 500000 THEN 'LEVEL_2_FINANCE_DIRECTOR' ELSE 'LEVEL_1_DEPARTMENT_HEAD' END
    AS approval_level,
  'Department Head' || CASE WHEN potential_savings > 100000 THEN ',Finance Director,CTO' ELSE '' END
    || CASE WHEN potential_savings > 500000 THEN ',CEO' ELSE '' END AS approval_workflow
FROM c
""")
def q_procurement(spark, sf_dir):
    recs = L.recommendations(_lic_shared(spark, sf_dir), top_reduction=None, top_renewal=None)
    a = P.finance_approval(P.procurement_request(recs))
    return a.select("gem_request_id", "recommendation_type", "subcategory", "gem_code", "delivery_timeline",
                    "implementation_cost", "net_benefit", "payback_period_months", "roi_percentage", "approval_level",
                    F.array_join("approval_workflow", ",").alias("approval_workflow"))


@query("quote_evaluation", oracle=f"""
WITH {S.QUOTES}
SELECT bid_request_id, quote_id, vendor_name, technical_score, commercial_score, overall_score,
  technical_score >= 60 AS compliance_status, CASE WHEN overall_score >= 70 THEN 'ACCEPT' ELSE 'REJECT' END
    AS recommendation
FROM qo
""")
def q_quote_evaluation(spark, sf_dir):
    q = P.score_quotes(fx.quotes(spark, sf_dir))
    return q.select("bid_request_id", "quote_id", "vendor_name", "technical_score", "commercial_score",
                    "overall_score", "compliance_status", "recommendation")


@query("bid_summary", oracle=f"""
WITH {S.QUOTES}
SELECT bid_request_id, count(*) AS total_quotes_received,
  count(*) FILTER (WHERE technical_score >= 60) AS qualified_quotes,
  arg_max(quote_id, (overall_score, -quote_seq)) AS winner_quote_id,
  max(overall_score) AS winner_score
FROM qo GROUP BY bid_request_id
""")
def q_bid_summary(spark, sf_dir):
    s = P.quote_summary(P.score_quotes(fx.quotes(spark, sf_dir)))
    return s.select("bid_request_id", "total_quotes_received", "qualified_quotes",
                    F.col("winner.quote_id").alias("winner_quote_id"),
                    F.col("winner.overall_score").alias("winner_score"))


@query("bid_requests", oracle=f"""
WITH {S.QUOTES}
SELECT bid_request_id, round(sum(total_price), 2) AS estimated_value, count(DISTINCT vendor_name) AS eligible_vendors,
  {S.ts(f"{S.AS_OF} + INTERVAL 15 DAY")} AS bid_submission_deadline
FROM quotes GROUP BY bid_request_id
""")
def q_bid_requests(spark, sf_dir):
    from ..functions.columns import fmt_ts
    b = P.bid_requests(fx.quotes(spark, sf_dir))
    return b.select("bid_request_id", F.round("estimated_value", 2).alias("estimated_value"), "eligible_vendors",
                    fmt_ts("bid_submission_deadline").alias("bid_submission_deadline"))


@query("portfolio_export", oracle=f"""
WITH {S.LICENSES}
SELECT asset_id, round(util, 3) AS utilization_rate, cost_per_license * total_licenses * 12 AS annual_cost,
  CASE WHEN util < 0.5 THEN 'low' WHEN util < 0.8 THEN 'medium' ELSE 'high' END AS utilization_class,
  printf('The %s license from %s used by %s department is %s with %s utilization rate and costs ₹%s annually.',
    name, vendor, department,
    CASE WHEN util < 0.5 THEN 'underutilized and wasteful' WHEN util < 0.8 THEN 'moderately efficient'
         ELSE 'well-utilized and efficient' END,
    printf('%.1f%%', round(util * 100.0, 1)), format('{{:,.0f}}', cost_per_license * total_licenses * 12)) AS summary
FROM licx
""")
def q_portfolio_export(spark, sf_dir):
    e = L.portfolio_export(_lic(spark, sf_dir))
    return e.select("asset_id", "utilization_rate", "annual_cost", "utilization_class", "summary")
