"""Operational tables derived from the driver tables.

The application works on help-desk tickets, e-mails, status events, licence assets
and vendor quotes.  These are derived from the TPC-H-like driver tables with plain
DataFrame transformations so that every query's work grows with the input.  The
same definitions are written as DuckDB SQL in ``servicelens.plans.oracle``.

All derivations are narrow projections except ``licenses`` (lineitem aggregated by
part before the join, so a hot part is combined map-side) and ``initial_state``
(one row per service, a partial+final aggregation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import DEFAULT_AS_OF
from ..functions.columns import SqlText, as_col, present, recode, ts_literal
from .tables import read_spread, read_table

# FIXED VALUES — sixteen ticket phrases; the text of key k starts with PHRASES[k % 16]
PHRASES = [
    "URGENT aadhaar authentication down in Bhopal",
    "Payment gateway timeout affecting Indore",
    "Portal website slow, please help",
    "Certificate document download question",
    "Minor issue on digital page",
    "Critical outage: thousands of citizens in Mumbai",
    "Mobile app crashed, angry user",
    "Network connection intermittent in Delhi",
    "Thank you for excellent service",
    "Important login problem asap",
    "Money transaction failed at bank",
    "eKYC verification inquiry",
    "Several biometric errors in Uttar Pradesh",
    "General support request",
    "Plain note with nothing to match",
    "Revenue impact, business emergency, Chennai and Pune",
]

# FIXED VALUES — fixture mappings
ORDER_STATUS = {"O": "open", "P": "in_progress", "F": "resolved"}
SEGMENT_CATEGORY = {
    "MACHINERY": "hardware",
    "AUTOMOBILE": "software",
    "BUILDING": "infrastructure",
    "FURNITURE": "access",
    "HOUSEHOLD": "network",
}
AGE_SPAN_MINUTES = {1: 300, 2: 600, 3: 1800, 4: 3600, 5: 1800}
CRITICAL_CUSTOMER_PRICE = 300000.0


def phrase_for(key) -> F.Column:
    arr = F.array(*[F.lit(p) for p in PHRASES])
    return F.element_at(arr, (F.pmod(key, F.lit(len(PHRASES))) + 1).cast("int"))


def _map_case(col, mapping: dict, default=None):
    return recode(col, mapping, default)


def tickets(spark: SparkSession, sf_dir: str, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """ITSM tickets: orders joined to customers (Spark picks the join; AQE broadcasts
    the customer side only when its runtime size is under the threshold)."""
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    prio = SqlText("CAST(substring(`o_orderpriority`, 1, 1) AS INT)")
    span = _map_case(prio, AGE_SPAN_MINUTES, 1800)
    age = F.pmod(F.col("o_orderkey") * 37, span.cast("bigint"))
    created = ts_literal(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), age.cast("int"))
    return (
        o.join(c, o.o_custkey == c.c_custkey, "left")
        .select(
            F.concat(F.lit("T-"), F.col("o_orderkey").cast("string")).alias("ticket_id"),
            F.col("o_orderkey").alias("order_key"),
            F.col("o_custkey").alias("cust_key"),
            as_col(prio).alias("priority"),
            _map_case(F.col("o_orderstatus"), ORDER_STATUS).alias("status"),
            _map_case(F.col("c_mktsegment"), SEGMENT_CATEGORY, "general").alias("category"),
            created.alias("created_at"),
            created.alias("updated_at"),
            F.col("o_totalprice").alias("revenue_impact"),
            F.when(F.col("o_totalprice") >= CRITICAL_CUSTOMER_PRICE, F.lit("critical"))
            .otherwise(F.lit("standard")).alias("customer_impact"),
            F.concat(F.when(F.pmod("o_orderkey", F.lit(5)) == 0, "Issue on LIC-").otherwise("Issue on asset AST-"),
                     F.col("o_custkey").cast("string")).alias("title"),
            phrase_for(F.col("o_orderkey")).alias("description"),
        )
    )


def text_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text requests: each document prefixed with one phrase (whole text kept)."""
    d = read_spread(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(phrase_for(F.col("doc_id")), F.lit(" "), F.col("text")).alias("text"),
        "lang",
        "source",
    )


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mails built from documents; every 10th message arrives twice (re-delivery)."""
    d = read_spread(spark, sf_dir, "documents", ["doc_id", "text"])
    sid = F.col("doc_id").cast("string")
    base = d.select(
        F.col("doc_id").alias("message_id"),
        F.when(F.pmod(F.col("doc_id"), F.lit(2)) == 0,
               F.concat(F.lit('"User '), sid, F.lit('" <user.'), sid, F.lit("@example.org>")))
        .otherwise(F.concat(F.lit("user."), sid, F.lit("@example.org"))).alias("sender"),
        phrase_for(F.col("doc_id")).alias("subject"),
        F.col("text").alias("body"),
    )
    return base.unionByName(base.filter(F.pmod(F.col("message_id"), F.lit(10)) == 0))


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events for per-service state folding, one per driver event."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    et = F.col("event_type")
    return e.select(
        F.col("user_id").alias("service_id"),
        F.col("event_id"),
        F.col("ts").alias("event_ts"),
        F.when(et.isin("purchase", "click", "view"), F.lit("L1 Task Completion"))
        .when(et == "error", F.lit("L1 Task Failed"))
        .when(et == "signup", F.lit("License Change Completed"))
        .otherwise(F.lit("Unknown")).alias("detail_type"),
        F.when(et == "view", F.lit("partial")).otherwise(F.lit("completed")).alias("task_status"),
        F.when(et == "click", F.lit("neutral")).otherwise(F.lit("positive")).alias("sla_impact"),
        F.floor("value").cast("bigint").alias("execution_time"),
        (F.pmod(F.col("event_id"), F.lit(2)) == 0).alias("success"),
    )


def initial_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior state per service; services with ``user_id % 11 == 0`` have none on purpose
    (their events must be dropped, as the application does)."""
    e = read_table(spark, sf_dir, "events", ["user_id"])
    users = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    return users.filter(F.pmod(F.col("user_id"), F.lit(11)) != 0).select(
        F.col("user_id").alias("service_id"),
        ts_literal("2023-12-31 00:00:00").alias("version_ts"),
        (F.pmod(F.col("user_id"), F.lit(10)).cast("double") / 10.0).alias("breach_probability"),
        F.lit(60.0).alias("response_remaining"),
        F.lit(240.0).alias("resolution_remaining"),
    )


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric points (namespace, metric, value, ts) from events."""
    e = read_table(spark, sf_dir, "events", ["event_type", "value", "ts"])
    et = F.col("event_type")
    return e.select(
        F.lit("ServiceOps").alias("namespace"),
        F.when(et == "error", F.lit("HighRiskTickets"))
        .when(et == "click", F.lit("ResponseTimeMs"))
        .when(et == "purchase", F.lit("SLACompliance"))
        .when(et == "view", F.lit("ActionsTriggered"))
        .otherwise(F.lit("TicketsCreated")).alias("metric"),
        F.when(et == "click", F.col("value") * 150.0)
        .when(et == "purchase", F.col("value") / 400.0)
        .otherwise(F.lit(1.0)).alias("value"),
        F.col("ts"),
    )


def licenses(spark: SparkSession, sf_dir: str, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Licence assets: quantities aggregated per part (partial aggregation before the
    shuffle), then joined to the part dimension."""
    li = read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_quantity", "l_returnflag"])
    usage = li.groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("_total"),
        F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(F.lit(0.0))).alias("_used"),
    )
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"])
    key = F.col("p_partkey")
    name = (F.when(F.pmod(key, F.lit(40)) == 0, F.concat("p_name", F.lit(" zoom")))
            .when(F.pmod(key, F.lit(40)) == 1, F.concat("p_name", F.lit(" slack")))
            .otherwise(F.col("p_name")))
    renewal = F.date_format(
        F.date_add(F.to_date(ts_literal(as_of)), (F.pmod(key, F.lit(200)) - 50).cast("int")), "yyyy-MM-dd")
    return p.join(usage, p.p_partkey == usage.l_partkey, "left").select(
        key.alias("asset_id"),
        name.alias("name"),
        F.col("p_brand").alias("vendor"),
        F.lit("subscription").alias("license_type"),
        F.coalesce(F.col("_total"), F.lit(0.0)).cast("bigint").alias("total_licenses"),
        F.coalesce(F.col("_used"), F.lit(0.0)).cast("bigint").alias("used_licenses"),
        F.col("p_retailprice").alias("cost_per_license"),
        F.when(F.pmod(key, F.lit(97)) == 0, F.lit("bad-date")).otherwise(renewal).alias("renewal_date"),
        F.col("p_type").alias("department"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor quotes: one per line item, grouped into bid requests by order."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"])
    bit = lambda b: (F.col("l_partkey").bitwiseAND(F.lit(1 << b)) != 0)
    return li.select(
        F.col("l_orderkey").alias("bid_request_id"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("quote_id"),
        F.col("l_linenumber").alias("quote_seq"),
        F.concat(F.lit("Supplier#"), F.col("l_suppkey").cast("string")).alias("vendor_name"),
        F.col("l_extendedprice").alias("total_price"),
        bit(0).alias("iso_certified"),
        bit(1).alias("soc2_compliant"),
        bit(2).alias("api_support"),
        bit(3).alias("sso_integration"),
        bit(4).alias("audit_logging"),
    )


# FIXED VALUES — the six change shapes used by change requests
CHANGE_SHAPES = [
    ("license_reduction", 60.0, 0),
    ("license_reduction", 30.0, 0),
    ("license_reduction", 10.0, 0),
    ("license_consolidation", 0.0, 6),
    ("license_consolidation", 0.0, 2),
    ("vendor_change", 0.0, 0),
]


def change_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One optimisation request per order: 1-6 affected assets (ids of two shapes), 1-3 proposed changes."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    k = F.col("o_orderkey")
    n_changes = (F.pmod(k, F.lit(3)) + 1).cast("int")
    shapes = F.array(*[
        F.struct(F.lit(t).alias("type"), F.lit(r).alias("reduction_percentage"), F.lit(d).alias("affected_departments"))
        for t, r, d in CHANGE_SHAPES
    ])
    changes = F.transform(
        F.sequence(F.lit(0), n_changes - 1),
        lambda i: F.element_at(shapes, (F.pmod(k + 2 * i, F.lit(len(CHANGE_SHAPES))) + 1).cast("int")),
    )
    return o.select(
        k.alias("optimization_id"),
        F.transform(F.sequence(F.lit(0), F.pmod(k, F.lit(6)).cast("int")), lambda i: F.concat(
            F.when(i % 2 == 0, "AST-").otherwise("LIC-"), (F.col("o_custkey") + i).cast("string"))).alias("affected_assets"),
        changes.alias("proposed_changes"),
        F.col("o_totalprice").alias("potential_savings"),
    )


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_spread(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return c.select("conv_id", "turn", F.col("role").alias("sender"), F.col("text").alias("message"))


LICENSE_CHANGE_TYPES = ["license_downgrade", "license_removal", "license_upgrade"]


def license_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence change requests: every signup event changes the licences of its service
    and of up to four that follow; the change type follows the event value."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    types = F.array(*[F.lit(t) for t in LICENSE_CHANGE_TYPES])
    return e.filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("change_id"),
        F.col("ts").alias("changed_at"),
        F.element_at(types, (F.pmod(F.floor("value"), F.lit(3)) + 1).cast("int")).alias("change_type"),
        F.transform(F.sequence(F.lit(0), F.pmod("event_id", F.lit(5)).cast("int")), lambda i: F.col("user_id") + i)
        .alias("affected_services"),
    )


# FIXED VALUES — intended (department, priority) of each phrase, used as labels
EXPECTED_LABELS = [
    ("UIDAI", "P1"), ("MeiTY", "P2"), ("DigitalMP", "P3"), ("eDistrict", "P4"),
    ("DigitalMP", "P4"), ("MPOnline", "P1"), ("MPOnline", "P1"), ("MPOnline", "P2"),
    ("eDistrict", "P4"), ("DigitalMP", "P2"), ("MeiTY", "P1"), ("UIDAI", "P4"),
    ("UIDAI", "P3"), ("MPOnline", "P3"), ("MPOnline", "P3"), ("MPOnline", "P1"),
]


def expected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for text tickets: the intended department / priority of the phrase."""
    d = read_table(spark, sf_dir, "documents", ["doc_id"])
    deps = F.array(*[F.lit(a) for a, _ in EXPECTED_LABELS])
    pris = F.array(*[F.lit(b) for _, b in EXPECTED_LABELS])
    idx = (F.pmod(F.col("doc_id"), F.lit(len(EXPECTED_LABELS))) + 1).cast("int")
    return d.select(F.col("doc_id").alias("id"), F.element_at(deps, idx).alias("expected_department"),
                    F.element_at(pris, idx).alias("expected_priority"))


def bus_events(spark: SparkSession, sf_dir: str, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Bus events: a metric update per scored ticket, a breach prediction per ticket
    at p > .4, automation / optimizer events from status events, ticket-created
    events from text tickets.  (source, detail_type, detail JSON)"""
    from ..operators import scoring, text
    s = scoring.sla_metrics(tickets(spark, sf_dir, as_of))
    detail = F.to_json(F.struct("ticket_id", "breach_probability", F.concat(F.lit("P"), F.col("priority").cast("string"))
                                .alias("priority")))
    # both event kinds from one scoring pass: every ticket yields a metric update, and
    # a prediction too at p > .4 (explode_outer: no inferred filter re-running the score)
    kinds = present([(F.lit(True), F.lit("Metric Update")),
                     (F.col("breach_probability") > 0.4, F.lit("SLA Breach Prediction"))])
    scored = s.select(F.lit("sla-monitor").alias("source"), F.explode_outer(kinds).alias("detail_type"),
                      detail.alias("detail"))
    st = status_events(spark, sf_dir)
    auto = st.select(F.when(F.col("detail_type").startswith("L1"), F.lit("l1-automation"))
                     .otherwise(F.lit("asset-optimizer")).alias("source"), "detail_type",
                     F.to_json(F.struct("service_id", "event_id")).alias("detail"))
    chat = text.analyze_chat(text_tickets(spark, sf_dir)).select(
        F.lit("chatbot").alias("source"), F.lit("Ticket Created").alias("detail_type"),
        F.to_json(F.struct("id", "priority")).alias("detail"))
    return scored.unionByName(auto).unionByName(chat)
