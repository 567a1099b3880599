"""Breach model (M1-M3) with ``pyspark.ml``: distributed training, batch scoring with
the rule-based fallback, and the retraining trigger.

The source application calls a hosted model and ships only a stub for training
("last 30 days, ten features"); here the model is trained on the table itself.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_AS_OF
from ..functions import rules as R
from ..functions.columns import lookup, minutes_between, ts_literal
from .util import with_scalars

FEATURES = ["priority_f", "category_code", "elapsed_minutes", "response_remaining", "resolution_remaining",
            "hour_of_day", "day_of_week", "technician_load", "historical_breach_rate", "category_avg_resolution"]
CATEGORY_CODES = {"hardware": 0, "software": 1, "infrastructure": 2, "access": 3, "network": 4}


def model_features(scored: DataFrame, load: DataFrame) -> DataFrame:
    """The ten training features of the retraining stub, from scored tickets plus the
    one-row system load (a scalar subquery)."""
    cat = F.col("category")
    d = R.CATEGORY_STATS[R.DEFAULT_CATEGORY_STATS]
    return (with_scalars(scored, load.select(F.col("technician_utilization").alias("technician_load")))
            .withColumn("priority_f", F.coalesce(F.col("priority"), F.lit(R.DEFAULT_PRIORITY)).cast("double"))
            .withColumn("category_code", lookup(cat, CATEGORY_CODES, 5).cast("double"))
            .withColumn("hour_of_day", F.hour("created_at").cast("double"))
            .withColumn("day_of_week", F.weekday("created_at").cast("double"))
            .withColumn("historical_breach_rate", lookup(cat, {k: v[1] for k, v in R.CATEGORY_STATS.items()}, d[1]))
            .withColumn("category_avg_resolution",
                        lookup(cat, {k: v[0] for k, v in R.CATEGORY_STATS.items()}, d[0])))


def train_breach_model(train: DataFrame, label: str = "breached", as_of: str = DEFAULT_AS_OF,
                       window_days: int = 30, max_iter: int = 25) -> PipelineModel:
    """M1: logistic regression on the last ``window_days`` of labelled tickets."""
    recent = train.filter(F.col("created_at") >= ts_literal(as_of) - F.make_interval(days=F.lit(window_days)))
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep"),
        LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=0.01),
    ])
    return pipe.fit(recent.withColumn(label, F.col(label).cast("double")))


def score_breach_model(feats: DataFrame, model: PipelineModel | None) -> DataFrame:
    """M2: model probability when a model is given, else the B10 heuristic (the
    fallback path of the source application)."""
    if model is None:
        from .scoring import heuristic_breach
        return heuristic_breach(feats).withColumnRenamed("ml_probability", "model_probability")
    out = model.transform(feats)
    return (out.withColumn("model_probability", vector_to_array("probability")[1])
            .withColumn("ml_confidence", F.lit(0.85))
            .withColumn("model_source", F.lit("logistic_regression"))
            .drop("features", "rawPrediction", "probability"))


def drift_flags(per_day: DataFrame, min_accuracy: float = 0.8, every_days: int = 7, trained_at: str = DEFAULT_AS_OF) -> DataFrame:
    """M3: ``drift`` and ``retrain`` of days with their ``accuracy``; a day without outcomes has no accuracy and no drift."""
    age_days = minutes_between(ts_literal(trained_at), F.col("day").cast("timestamp_ntz")) / (60 * 24)
    return (per_day.withColumn("drift", F.coalesce(F.col("accuracy") < min_accuracy, F.lit(False)))
            .withColumn("retrain", F.col("drift") | (age_days >= every_days)))


def retrain_trigger(scored: DataFrame, label: str = "breached", ts: str = "created_at",
                    min_accuracy: float = 0.8, every_days: int = 7, trained_at: str = DEFAULT_AS_OF) -> DataFrame:
    """M3: accuracy of the model per day (prediction = probability >= .5) and the
    retraining flag: accuracy below ``min_accuracy`` or the model older than a week."""
    correct = ((F.col("model_probability") >= 0.5) == F.col(label)).cast("double")
    per_day = scored.groupBy(F.to_date(ts).alias("day")).agg(F.avg(correct).alias("accuracy"),
                                                             F.count(F.lit(1)).alias("scored"))
    return drift_flags(per_day, min_accuracy, every_days, trained_at)
