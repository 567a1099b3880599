"""Licence portfolio analysis.

The portfolio is a table of assets; every metric is a projection or an aggregate
over it.  One-row portfolio metrics are computed in a single ``agg`` pass (partial
aggregation per task, one final row), never by collecting assets to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_AS_OF
from ..functions import rules as R
from ..functions.columns import contains_any, ts_literal


def utilization(total: Column, used: Column) -> Column:
    return F.when(total > 0, used / total).otherwise(F.lit(0.0))


def reduce_to(used: Column) -> Column:
    """max(int(used x 1.2), 1)"""
    return F.greatest((used * R.REDUCTION_BUFFER).cast("bigint"), F.lit(1).cast("bigint"))


def days_to_renewal(renewal_date: Column, as_of: str = DEFAULT_AS_OF) -> Column:
    """Whole days from ``as_of`` to the renewal date (floor of the fractional days, like
    ``timedelta.days``); unparseable dates give NULL (the application skips them)."""
    d = F.try_to_timestamp(renewal_date, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", ts_literal(as_of), d)
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")


def with_portfolio_columns(lic: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    total, used, cost = F.col("total_licenses"), F.col("used_licenses"), F.col("cost_per_license")
    return (lic.withColumn("utilization_rate", utilization(total, used))
            .withColumn("monthly_cost", cost * total)
            .withColumn("days_to_renewal", days_to_renewal(F.col("renewal_date"), as_of))
            .withColumn("is_comm_tool", contains_any(F.lower(F.col("name")), R.COMMUNICATION_TOOLS)))


def underutilized(lic: DataFrame) -> DataFrame:
    """L1 (+ agent extras, H23 advice): total > 0 and utilisation < .7."""
    total, used, cost = F.col("total_licenses"), F.col("used_licenses"), F.col("cost_per_license")
    u = used / total
    return (lic.filter((total > 0) & (u < R.UNDERUTILIZED_BELOW))
            .withColumn("utilization_rate", u)
            .withColumn("unused_licenses", total - used)
            .withColumn("waste_cost_annual", (total - used) * cost * 12)
            .withColumn("recommended_count", reduce_to(used))
            .withColumn("recommendation", F.format_string("Reduce licenses to %d (20%% buffer)", reduce_to(used)))
            .withColumn("trend", F.when(used < total * 0.5, F.lit("declining")).otherwise(F.lit("stable")))
            .withColumn("growth_prediction", F.when(used < total * 0.6, F.lit("negative_growth"))
                        .otherwise(F.lit("stable")))
            .withColumn("advice", utilization_advice(u)))


def utilization_advice(u: Column) -> Column:
    """Advice text by utilisation band."""
    return (F.when(u < 0.3, F.lit("Consider reducing licenses by 60-70% or canceling subscription"))
            .when(u < 0.5, F.lit("Reduce licenses by 40-50% to optimize costs"))
            .when(u < 0.7, F.lit("Reduce licenses by 20-30% based on actual usage"))
            .otherwise(F.lit("Monitor usage patterns for future optimization")))


def renewal_alerts(lic: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """L2: renewals due in 0..90 days; bad dates skipped; 15 % opportunity."""
    d = days_to_renewal(F.col("renewal_date"), as_of)
    return (lic.withColumn("days_to_renewal", d)
            .filter(F.col("days_to_renewal").between(0, R.RENEWAL_WINDOW_DAYS))
            .withColumn("current_cost", F.col("cost_per_license") * F.col("total_licenses"))
            .withColumn("optimization_opportunity", F.col("current_cost") * R.RENEWAL_OPPORTUNITY))


def portfolio_metrics(lic: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """D3, D5, D6 (both variants) and finding counts in one aggregation pass."""
    p = with_portfolio_columns(lic, as_of)
    total, used, cost = F.col("total_licenses"), F.col("used_licenses"), F.col("cost_per_license")
    u = F.col("utilization_rate")
    days = F.col("days_to_renewal")
    under = (total > 0) & (used / total < R.UNDERUTILIZED_BELOW)
    n = F.count(F.lit(1))
    agg = p.agg(
        n.alias("total_assets"),
        F.sum("monthly_cost").alias("total_cost"),
        F.sum(total).alias("total_licenses"),
        F.sum(used).alias("total_used"),
        F.sum(F.when(under, (total - reduce_to(used)) * cost * 12).otherwise(F.lit(0.0))).alias("optimization_potential"),
        F.sum(F.when(under, (total - used) * cost * 12).otherwise(F.lit(0.0))).alias("optimization_potential_agent"),
        F.avg(F.when(total > 0, u)).alias("_avg_util_valid"),
        F.avg(u).alias("_avg_util_all"),
        F.count_distinct(F.col("vendor")).alias("unique_vendors"),
        F.sum(days.between(0, R.RENEWAL_WINDOW_DAYS).cast("long")).alias("renewals_due"),
        F.sum((days <= R.RENEWAL_WINDOW_DAYS).cast("long")).alias("_renewals_incl_past"),
        F.sum(under.cast("long")).alias("underutilized_count"),
        F.sum(F.col("is_comm_tool").cast("long")).alias("communication_tools"),
        F.sum((F.col("monthly_cost") > 100000).cast("long")).alias("high_cost_assets"),
    )
    n_assets = F.col("total_assets").cast("double")
    diversity = F.least(F.col("unique_vendors") / n_assets, F.lit(1.0))
    overall = F.when(F.col("total_licenses") > 0, F.col("total_used") / F.col("total_licenses")).otherwise(F.lit(0.0))
    health_core = (F.coalesce(F.col("_avg_util_valid"), F.lit(0.0)) * 0.5 + diversity * 0.2
                   + (F.lit(1.0) - F.col("renewals_due") / n_assets) * 0.3) * 100
    health_agent = (F.col("_avg_util_all") * 0.4 + diversity * 0.3
                    + (F.lit(1.0) - F.col("_renewals_incl_past") / n_assets) * 0.3) * 100
    return (agg
            .withColumn("total_annual_cost", F.col("total_cost") * 12)
            .withColumn("overall_utilization_rate", overall)
            .withColumn("risk_assessment", F.when(overall < 0.6, F.lit("Medium")).otherwise(F.lit("Low")))
            .withColumn("health_score", F.when(F.col("total_assets") > 0, F.round(health_core, 2)).otherwise(F.lit(0.0)))
            .withColumn("health_score_agent",
                        F.when(F.col("total_assets") > 0, F.round(health_agent, 2)).otherwise(F.lit(0.0)))
            .drop("_avg_util_valid", "_avg_util_all", "_renewals_incl_past"))


def vendor_spend(lic: DataFrame) -> DataFrame:
    """Spend per vendor (monthly cost x licences)."""
    return lic.groupBy("vendor").agg(F.sum(F.col("cost_per_license") * F.col("total_licenses")).alias("spend"))


def top_vendors(lic: DataFrame, k: int = 5) -> DataFrame:
    """Top-k vendors by spend (ties by vendor name)."""
    return vendor_spend(lic).orderBy(F.col("spend").desc(), F.col("vendor").asc()).limit(k)


def department_spend(lic: DataFrame) -> DataFrame:
    return lic.groupBy("department").agg(F.sum(F.col("cost_per_license") * F.col("total_licenses")).alias("spend"))


def vendor_concentration(lic: DataFrame) -> DataFrame:
    """Largest vendor share of spend -> high (> .4) / medium (> .2) / low."""
    v = vendor_spend(lic)
    s = v.agg(F.max("spend").alias("max_spend"), F.sum("spend").alias("total_spend"))
    share = F.when(F.col("total_spend") > 0, F.col("max_spend") / F.col("total_spend")).otherwise(F.lit(0.0))
    return s.select(share.alias("max_vendor_share"),
                    F.when(share > 0.4, F.lit("high")).when(share > 0.2, F.lit("medium")).otherwise(F.lit("low"))
                    .alias("vendor_concentration_risk"))


def duplicate_tools(lic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D8 (communication tools): (summary row, member assets).  The group is one
    logical group across the portfolio, so it is kept as rows plus a one-row
    aggregate, never collected into one array."""
    tools = lic.filter(contains_any(F.lower(F.col("name")), R.COMMUNICATION_TOOLS)) \
        .withColumn("cost", F.col("cost_per_license") * F.col("total_licenses"))
    summary = tools.agg(F.count(F.lit(1)).alias("assets"), F.sum("cost").alias("total_cost"),
                        F.min("asset_id").alias("first_asset_id")) \
        .filter(F.col("assets") > 1) \
        .withColumn("category", F.lit("Communication Tools")) \
        .withColumn("consolidation_opportunity", F.col("total_cost") * R.CONSOLIDATION_SAVING)
    return summary, tools


def duplicate_vendors(lic: DataFrame) -> DataFrame:
    """D8 (agent): vendors (case-insensitive) with more than one asset; 30 % saving."""
    return (lic.groupBy(F.lower(F.col("vendor")).alias("vendor"))
            .agg(F.count(F.lit(1)).alias("assets"),
                 F.sum(F.col("cost_per_license") * F.col("total_licenses")).alias("total_cost"))
            .filter(F.col("assets") > 1)
            .withColumn("consolidation_opportunity", F.col("total_cost") * R.DUPLICATE_VENDOR_SAVING))


def recommendations(lic: DataFrame, as_of: str = DEFAULT_AS_OF, top_reduction: int | None = 3,
                    top_renewal: int | None = 2) -> DataFrame:
    """G1/L3: reductions (top 3 by waste), one consolidation, renewals (top 2 by days,
    opportunity > 0), as one table sorted by savings.  ``None`` keeps all."""
    under = underutilized(lic)
    if top_reduction is not None:
        under = under.orderBy(F.col("waste_cost_annual").desc(), F.col("asset_id").asc()).limit(top_reduction)
    red = under.select(
        F.col("asset_id"), F.lit("LICENSE_REDUCTION").alias("recommendation_type"),
        F.format_string("Reduce %s licenses by %d unused licenses", F.col("name"), F.col("unused_licenses"))
        .alias("description"),
        F.col("waste_cost_annual").alias("potential_savings"),
        F.lit(R.RECOMMENDATION_CONFIDENCE["LICENSE_REDUCTION"]).alias("confidence_score"),
        F.when(F.col("waste_cost_annual") > R.HIGH_PRIORITY_SAVINGS, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))
        .alias("priority"),
        F.col("total_licenses").alias("current_count"), F.col("recommended_count"))
    summary, _ = duplicate_tools(lic)
    cons = summary.select(
        F.col("first_asset_id").alias("asset_id"), F.lit("CONSOLIDATION").alias("recommendation_type"),
        F.lit("Consolidate Communication Tools to eliminate overlap and reduce costs").alias("description"),
        F.col("consolidation_opportunity").alias("potential_savings"),
        F.lit(R.RECOMMENDATION_CONFIDENCE["CONSOLIDATION"]).alias("confidence_score"),
        F.lit("HIGH").alias("priority"),
        F.lit(None).cast("bigint").alias("current_count"), F.lit(None).cast("bigint").alias("recommended_count"))
    ren = renewal_alerts(lic, as_of)
    if top_renewal is not None:
        ren = ren.orderBy(F.col("days_to_renewal").asc(), F.col("asset_id").asc()).limit(top_renewal)
    ren = ren.filter(F.col("optimization_opportunity") > 0).select(
        F.col("asset_id"), F.lit("RENEWAL_OPTIMIZATION").alias("recommendation_type"),
        F.format_string("Optimize %s renewal terms and negotiate better pricing", F.col("name")).alias("description"),
        F.col("optimization_opportunity").alias("potential_savings"),
        F.lit(R.RECOMMENDATION_CONFIDENCE["RENEWAL_OPTIMIZATION"]).alias("confidence_score"),
        F.lit("MEDIUM").alias("priority"),
        F.lit(None).cast("bigint").alias("current_count"), F.lit(None).cast("bigint").alias("recommended_count"))
    out = red.unionByName(cons).unionByName(ren)
    rid = F.concat_ws("-", F.lit("REC"), F.col("recommendation_type"), F.col("asset_id").cast("string"))
    return out.withColumn("recommendation_id", rid)


def portfolio_export(lic: DataFrame) -> DataFrame:
    """L9 + H22: per-asset export (utilisation rounded to 3, annual cost) and sentence."""
    total, used = F.col("total_licenses"), F.col("used_licenses")
    u = utilization(total, used)
    annual = F.col("cost_per_license") * total * 12
    eff = (F.when(u < 0.5, F.lit("underutilized and wasteful")).when(u < 0.8, F.lit("moderately efficient"))
           .otherwise(F.lit("well-utilized and efficient")))
    sentence = F.format_string(
        "The %s license from %s used by %s department is %s with %s utilization rate and costs ₹%s annually.",
        F.col("name"), F.col("vendor"), F.col("department"), eff,
        F.format_string("%.1f%%", F.round(u * 100.0, 1)), F.format_number(annual, 0))
    return lic.select("asset_id", "name", "vendor", "department", F.round(u, 3).alias("utilization_rate"),
                      annual.alias("annual_cost"),
                      F.initcap(F.regexp_replace(F.col("license_type"), "_", " ")).alias("license_type_label"),
                      F.when(u < 0.5, F.lit("low")).when(u < 0.8, F.lit("medium")).otherwise(F.lit("high"))
                      .alias("utilization_class"),
                      sentence.alias("summary"))


# FIXED VALUES — market alternatives by lower-cased vendor
MARKET_ALTERNATIVES = {
    "zoom": ["Microsoft Teams", "Google Meet", "Webex"],
    "adobe": ["Canva Pro", "Figma", "Sketch"],
    "microsoft": ["Google Workspace", "Slack", "Zoom"],
    "symantec": ["McAfee", "Trend Micro", "Kaspersky"],
    "slack": ["Microsoft Teams", "Discord", "Mattermost"],
}
MARKET_ALTERNATIVES_DEFAULT = ["Generic alternatives available"]


def market_alternatives(vendor: Column) -> Column:
    """C11: alternatives for a vendor (literal map on the lower-cased name, default list)."""
    v = F.lower(vendor)
    expr = None
    for k, alts in MARKET_ALTERNATIVES.items():
        arr = F.array(*[F.lit(a) for a in alts])
        expr = F.when(v == k, arr) if expr is None else expr.when(v == k, arr)
    return expr.otherwise(F.array(*[F.lit(a) for a in MARKET_ALTERNATIVES_DEFAULT]))
