"""Procurement and approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_AS_OF
from ..functions import rules as R
from ..functions.columns import lookup, ts_literal

# FIXED VALUES — procurement category and delivery timeline by recommendation type
GEM_CATEGORY = {
    "LICENSE_REDUCTION": ("Information Technology", "Software Licenses", "IT-SW-001"),
    "CONSOLIDATION": ("Information Technology", "Software Services", "IT-SV-002"),
    "RENEWAL_OPTIMIZATION": ("Information Technology", "Software Maintenance", "IT-MT-003"),
}
GEM_CATEGORY_DEFAULT = ("Information Technology", "Software Services", "IT-SV-000")
DELIVERY_TIMELINE = {"LICENSE_REDUCTION": "30-45 days", "CONSOLIDATION": "60-90 days",
                     "RENEWAL_OPTIMIZATION": "15-30 days"}
DELIVERY_TIMELINE_DEFAULT = "45-60 days"


def procurement_request(recs: DataFrame) -> DataFrame:
    """L5 + C10: category / subcategory / code / timeline by type (literal CASE chains),
    type-specific specification struct, pending status."""
    t = F.col("recommendation_type")
    cat = lambda i: lookup(t, {k: v[i] for k, v in GEM_CATEGORY.items()}, GEM_CATEGORY_DEFAULT[i])
    reduction = F.when(t == "LICENSE_REDUCTION", F.struct(
        F.coalesce(F.col("current_count"), F.lit(0)).alias("current_licenses"),
        F.coalesce(F.col("recommended_count"), F.lit(0)).alias("optimized_licenses")))
    return (recs
            .withColumn("gem_request_id", F.concat(F.lit("GEM-"), F.col("recommendation_id")))
            .withColumn("category", cat(0))
            .withColumn("subcategory", cat(1))
            .withColumn("gem_code", cat(2))
            .withColumn("estimated_value", F.col("potential_savings"))
            .withColumn("delivery_timeline", lookup(t, DELIVERY_TIMELINE, DELIVERY_TIMELINE_DEFAULT))
            .withColumn("technical_specifications", F.struct(
                F.lit("Enterprise Software License").alias("software_type"),
                F.lit("24x7 Premium Support").alias("support_level"),
                reduction.alias("license_optimization")))
            .withColumn("approval_status", F.lit("PENDING_FINANCE_APPROVAL")))


def approval_level(amount: Column) -> Column:
    """Range lookup of the approval band (four bands, CASE chain)."""
    expr = None
    for threshold, label in R.APPROVAL_LEVELS:
        expr = F.when(amount >= threshold, F.lit(label)) if expr is None else expr.when(amount >= threshold, F.lit(label))
    return expr.otherwise(F.lit(R.APPROVAL_LEVEL_DEFAULT))


def finance_approval(req: DataFrame) -> DataFrame:
    """Implementation cost, net benefit, payback, ROI, level, approver chains."""
    s = F.col("potential_savings")
    impl = s * R.IMPLEMENTATION_SHARE * lookup(F.col("recommendation_type"), R.IMPLEMENTATION_MULTIPLIER, 1.0)
    monthly = s / 12
    level = approval_level(F.col("estimated_value"))
    n_approvers = (F.when(level == "LEVEL_4_CEO", F.lit(4)).when(level == "LEVEL_3_CTO", F.lit(3))
                   .when(level == "LEVEL_2_FINANCE_DIRECTOR", F.lit(2)).otherwise(F.lit(1)))
    approvers = F.slice(F.array(*[F.lit(a) for a in R.APPROVERS]), 1, n_approvers)
    chain = F.concat(F.array(F.lit("Department Head")),
                     F.when(s > 100000, F.array(F.lit("Finance Director"), F.lit("CTO")))
                     .otherwise(F.array().cast("array<string>")),
                     F.when(s > 500000, F.array(F.lit("CEO"))).otherwise(F.array().cast("array<string>")))
    return (req.withColumn("implementation_cost", impl)
            .withColumn("net_benefit", F.col("estimated_value") - F.col("implementation_cost"))
            .withColumn("payback_period_months",
                        F.when(monthly > 0, F.greatest((F.col("implementation_cost") / monthly).cast("bigint"),
                                                       F.lit(1).cast("bigint")))
                        .otherwise(F.lit(12).cast("bigint")))
            .withColumn("roi_percentage",
                        F.when(F.col("implementation_cost") > 0,
                               (s - F.col("implementation_cost")) / F.col("implementation_cost") * 100)
                        .otherwise(F.lit(0.0)))
            .withColumn("approval_level", level)
            .withColumn("approvers", approvers)
            .withColumn("approval_workflow", chain)
            .withColumn("approval_state", F.lit("PENDING_APPROVAL")))


def score_quotes(quotes: DataFrame) -> DataFrame:
    """technical = share of five flags x 100, commercial from the price bands
    against the market price (1.2 x own price), overall .7 / .3."""
    flags = ["iso_certified", "soc2_compliant", "api_support", "sso_integration", "audit_logging"]
    tech = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in flags), F.lit(0)) / 5.0 * 100
    base = F.coalesce(F.col("total_price"), F.lit(0.0))
    market = base * R.MARKET_PRICE_FACTOR
    commercial = (F.when(base <= market * 0.8, F.lit(100.0)).when(base <= market, F.lit(80.0))
                  .when(base <= market * 1.1, F.lit(60.0)).otherwise(F.lit(40.0)))
    return (quotes.withColumn("technical_score", F.least(tech, F.lit(100.0)))
            .withColumn("commercial_score", commercial)
            .withColumn("overall_score", F.col("technical_score") * R.QUOTE_TECHNICAL_WEIGHT
                        + F.col("commercial_score") * R.QUOTE_COMMERCIAL_WEIGHT)
            .withColumn("compliance_status", F.col("technical_score") >= R.QUOTE_COMPLIANT_AT)
            .withColumn("recommendation", F.when(F.col("overall_score") >= R.QUOTE_ACCEPT_AT, F.lit("ACCEPT"))
                        .otherwise(F.lit("REJECT"))))


def quote_summary(scored: DataFrame, key: str = "bid_request_id") -> DataFrame:
    """D16 + F4: received, qualified and the winner per bid request.  The winner is a
    ``max_by`` aggregate (partial aggregation, so a bid with very many quotes is
    reduced map-side) ordered by score, then the earliest quote id."""
    order = F.struct(F.col("overall_score"), F.col("_neg_seq"))
    return (scored.withColumn("_neg_seq", -F.col("quote_seq"))
            .groupBy(key)
            .agg(F.count(F.lit(1)).alias("total_quotes_received"),
                 F.sum(F.col("compliance_status").cast("long")).alias("qualified_quotes"),
                 F.max_by(F.struct("quote_id", "vendor_name", "overall_score", "total_price"), order)
                 .alias("winner")))


def bid_requests(quotes: DataFrame, as_of: str = DEFAULT_AS_OF, key: str = "bid_request_id") -> DataFrame:
    """One bid request per group of quotes: estimated value, deadline (+15 days),
    evaluation weights and the number of eligible vendors."""
    return (quotes.groupBy(key)
            .agg(F.sum("total_price").alias("estimated_value"),
                 F.count_distinct("vendor_name").alias("eligible_vendors"))
            .withColumn("bid_submission_deadline", ts_literal(as_of) + F.make_interval(days=F.lit(R.BID_DEADLINE_DAYS)))
            .withColumn("technical_score_weightage", F.lit(70))
            .withColumn("commercial_score_weightage", F.lit(30))
            .withColumn("minimum_technical_score", F.lit(60))
            .withColumn("status", F.lit("PUBLISHED")))
