"""Registered queries: feature vectors, the priority index and the breach model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.columns import fmt_ts, ts_literal
from ..operators import kpi, ml, scoring
from ..operators import text as T
from ..sources import fixtures as fx
from ..sources.ingest import scratch_path
from ..sources.tables import read_table
from . import sqlfix as S
from .q_text import _CHAT_SQL
from .registry import query


@query("breach_features_text", oracle=f"""
WITH {S.TEXT_TICKETS}, {_CHAT_SQL}
SELECT c.id, {S.lookup('priority', R.PRIORITY_SCORE, R.PRIORITY_SCORE_DEFAULT)} AS priority_numeric,
  CAST(('0x' || substr(md5(department), 1, 8)) AS BIGINT) % 100 AS department_encoded,
  CAST(('0x' || substr(md5(service_type), 1, 8)) AS BIGINT) % 50 AS service_type_encoded,
  hour({S.AS_OF}) AS hour_created, isodow({S.AS_OF}) - 1 AS day_of_week,
  length(t.text) AS message_length, CAST(location <> 'Not specified' AS INTEGER) AS location_specified
FROM cc c JOIN tt t ON c.id = t.id
""")
def q_breach_features_text(spark, sf_dir):
    f = scoring.breach_features_text(T.analyze_chat(fx.text_tickets(spark, sf_dir)))
    return f.select("id", "priority_numeric", "department_encoded", "service_type_encoded", "hour_created",
                    "day_of_week", "message_length", "location_specified")


@query("breach_features_8", oracle=f"""
WITH {S.TICKETS}, {S.TICKET_RISKS},
b AS (SELECT *, CASE WHEN status IN ('resolved', 'closed') THEN 0.0::DOUBLE
       ELSE least(1.0::DOUBLE, greatest(response_risk, resolution_risk * 0.7::DOUBLE)
            * CASE WHEN customer_impact = 'critical' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) END AS p FROM t_risk)
SELECT ticket_id, CAST(priority AS DOUBLE) AS f1, CASE WHEN status = 'open' THEN 1.0 ELSE 0.0 END::DOUBLE AS f2,
  CASE WHEN category = 'infrastructure' THEN 1.0 ELSE 0.0 END::DOUBLE AS f3, elapsed_minutes AS f4, p AS f5,
  revenue_impact / 100000.0::DOUBLE AS f6, 0.0::DOUBLE AS f7,
  CASE WHEN customer_impact = 'critical' THEN 1.0 ELSE 0.0 END::DOUBLE AS f8
FROM b
""")
def q_breach_features_8(spark, sf_dir):
    f = scoring.breach_features_8(scoring.sla_metrics_business(fx.tickets(spark, sf_dir)))
    return f.select("ticket_id", *[F.element_at("features_8", i).alias(f"f{i}") for i in range(1, 9)])


@query("priority_index", oracle=f"""
WITH {S.TICKETS}
SELECT priority, ticket_id, {S.ts('created_at')} AS created_at FROM tickets
""")
def q_priority_index(spark, sf_dir):
    """The index of all tickets (range-partitioned, sorted by priority and time), written and read back."""
    path = scratch_path(spark, "priority-index")
    kpi.write_priority_index(fx.tickets(spark, sf_dir).select("priority", "ticket_id", "created_at"), path)
    return spark.read.parquet(path).select("priority", "ticket_id", fmt_ts("created_at").alias("created_at"))


#: Tickets created from this day on judge the model; it is fitted on earlier ones.
HOLDOUT_FROM = "2024-01-31 00:00:00"

_LABEL_SQL = """
ship AS (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey),
lab AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(last_ship AS DATE)) > 365 AS breached
        FROM orders JOIN ship ON o_orderkey = l_orderkey)"""


def _features(spark, sf_dir):
    """All scored tickets with the model's features and, where known, the outcome: the order's last
    shipment came more than a year after the order (a delivery-SLA breach); an order without line items
    has none."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_shipdate"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    ship = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("_ship"))
    lab = o.join(ship, o.o_orderkey == ship.l_orderkey).select(
        F.col("o_orderkey").alias("order_key"), (F.datediff("_ship", "o_orderdate") > 365).alias("breached"))
    scored = scoring.sla_metrics(fx.tickets(spark, sf_dir))
    return ml.model_features(scored.join(lab, "order_key", "left"), scoring.system_load(scored))


def _fitted(features):
    """The rows that the model is fitted on: labelled, and before the holdout days."""
    return features.filter(F.col("breached").isNotNull() & (F.col("created_at") < ts_literal(HOLDOUT_FROM)))


@query("breach_model_scores")
def q_breach_model_scores(spark, sf_dir):
    """M1 + M2: fitted on the labelled tickets before the holdout days; every ticket is scored."""
    data = _features(spark, sf_dir)
    s = ml.score_breach_model(data, ml.train_breach_model(_fitted(data)))
    return s.select("ticket_id", "breached", F.round("model_probability", 6).alias("model_probability"),
                    "ml_confidence", "model_source")


@query("breach_model_check", oracle=f"""
WITH {S.TICKETS}, {_LABEL_SQL}
SELECT count(*) AS scored, count(breached) AS labelled,
  count(breached) FILTER (WHERE created_at < TIMESTAMP '{HOLDOUT_FROM}') AS fitted,
  true AS probabilities, true AS mean_score_is_mean_label, CAST(0.85 AS DOUBLE) AS confidence
FROM tickets LEFT JOIN lab ON order_key = o_orderkey
""")
def q_breach_model_check(spark, sf_dir):
    """M1 + M2, checkable: every ticket has a probability, and on the rows that a logistic regression is fitted
    on its mean score is the mean label (the intercept's condition at the optimum; within 0.005)."""
    data = _features(spark, sf_dir)
    s = ml.score_breach_model(data, ml.train_breach_model(_fitted(data)))
    fitted = F.col("breached").isNotNull() & (F.col("created_at") < ts_literal(HOLDOUT_FROM))
    gap = F.avg(F.when(fitted, F.col("model_probability") - F.col("breached").cast("double")))
    return s.agg(F.count("ticket_id").alias("scored"), F.count("breached").alias("labelled"), F.count_if(fitted).alias("fitted"),
                 F.bool_and(F.col("model_probability").between(0, 1)).alias("probabilities"),
                 (F.abs(gap) < 0.005).alias("mean_score_is_mean_label"), F.max("ml_confidence").alias("confidence"))


@query("retrain_trigger")
def q_retrain_trigger(spark, sf_dir):
    """M3 on the days that the model has not seen."""
    data = _features(spark, sf_dir)
    unseen = data.filter(F.col("breached").isNotNull() & (F.col("created_at") >= ts_literal(HOLDOUT_FROM)))
    r = ml.retrain_trigger(ml.score_breach_model(unseen, ml.train_breach_model(_fitted(data))))
    return r.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("accuracy", 6).alias("accuracy"),
                    "scored", "drift", "retrain")


@query("retrain_trigger_rule", oracle=f"""
WITH {S.TICKETS}, {S.SCORED}, {_LABEL_SQL},
d AS (
  SELECT CAST(t.created_at AS DATE) AS day, avg(CASE WHEN (s.breach_probability >= 0.5) = breached THEN 1.0 ELSE 0.0 END) AS accuracy,
    count(*) AS scored
  FROM tickets t JOIN scored s USING (ticket_id) JOIN lab ON t.order_key = o_orderkey GROUP BY 1
)
SELECT strftime(day, '%Y-%m-%d') AS day, round(accuracy, 6) AS accuracy, scored, accuracy < 0.8 AS drift,
  accuracy < 0.8 OR date_diff('day', TIMESTAMP '2024-01-20 00:00:00', CAST(day AS TIMESTAMP)) >= 10 AS retrain
FROM d
""")
def q_retrain_trigger_rule(spark, sf_dir):
    """M3, checkable: the trigger over the rule-based probability of the labelled tickets, for a model trained
    on 20 January that is renewed after ten days."""
    data = _features(spark, sf_dir).filter(F.col("breached").isNotNull()).withColumn("model_probability", F.col("breach_probability"))
    r = ml.retrain_trigger(data, trained_at="2024-01-20 00:00:00", every_days=10)
    return r.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("accuracy", 6).alias("accuracy"),
                    "scored", "drift", "retrain")
