"""Structured Streaming jobs.  Each job calls the same DataFrame operators as the batch
queries, so a stream processed with ``availableNow`` must equal the batch result
(the streaming tests check exactly that).

Sources are file streams (JSON / parquet) with explicit schemas; sinks are parquet
tables written in ``foreachBatch`` (idempotent per batch id) or the built-in file sink.
Checkpoints default to the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import DEFAULT_AS_OF
from ..functions.columns import breach_bucket, sla_status
from ..operators import alarms, scoring, state, text
from ..session import ensure_checkpoint_dir
from ..sources import ingest
from .commits import BatchCommits


def _checkpoint(spark: SparkSession, name: str, checkpoint: str | None) -> str:
    if checkpoint:
        return checkpoint
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "streams", name)


def _trigger(writer, available_now: bool, interval: str):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)


def _append_batch(path: str):
    """foreachBatch sink: each micro-batch lands in its own ``batch_id=`` folder, so a
    retried batch overwrites only itself (idempotent, exactly-once with the checkpoint)."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))
    return write


# ---------------------------------------------------------------------------
# S1 + S9: change feed -> SLA scores -> state versions (+ metric events)
# ---------------------------------------------------------------------------

def _records(spark: SparkSession, source: str, max_files_per_trigger: int | None) -> DataFrame:
    """Change records: text files, one JSON record per line."""
    reader = spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())])).format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source)


def score_stream(spark: SparkSession, source: str, sink: str, as_of: str = DEFAULT_AS_OF,
                 checkpoint: str | None = None, available_now: bool = True,
                 interval: str = "5 seconds", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Change records -> decode (A1) -> B1/B2.  Per micro-batch: ``states`` (versioned state rows that
    expire after 90 days, A9 / S9), ``events`` (one metric event per state, A10) and ``rejects`` (the records
    that are no ticket changes).  The three become visible together (``BatchCommits.read``)."""
    def write(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        tickets, rejects = ingest.decode_change_feed(df)
        states = state.versioned(scoring.sla_metrics(tickets, as_of), as_of).select(
            "ticket_id", "priority", "status", "category", "breach_probability", "breach_bucket", "sla_status",
            "response_remaining", "resolution_remaining", "version_ts", "expire_at")
        events = ingest.emit_events(states, "Metric Update", "sla-monitor",
                                    ["ticket_id", "breach_probability", "breach_bucket", "sla_status"])
        BatchCommits(df.sparkSession, sink).write(batch_id, {"states": states, "events": events, "rejects": rejects})
        df.unpersist()

    w = _records(spark, source, max_files_per_trigger).writeStream.foreachBatch(write).option(
        "checkpointLocation", _checkpoint(spark, "score", checkpoint))
    return _trigger(w, available_now, interval).start()


# ---------------------------------------------------------------------------
# S3: metric events -> predictions -> action events
# ---------------------------------------------------------------------------

def predict_stream(spark: SparkSession, source: str, sink: str, as_of: str = DEFAULT_AS_OF,
                   checkpoint: str | None = None, available_now: bool = True,
                   interval: str = "5 seconds", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """S3: decoded tickets -> score -> heuristic model -> combine; triggered actions are
    exploded into typed events in the same micro-batch.  Records that are no ticket changes go to
    ``record_rejects``, actions without a rule to ``rejects``; the four tables become visible together."""
    from ..operators import actions

    def write(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        tickets, unread = ingest.decode_change_feed(df)
        pred = scoring.predict(tickets, as_of).persist()
        ev, rej = actions.action_events(pred)
        BatchCommits(df.sparkSession, sink).write(batch_id, {
            "predictions": pred.select("ticket_id", "final_breach_probability", "priority_boost", "new_priority", "time_to_breach"),
            "actions": ev.select("ticket_id", "action", "urgency", "followup_minutes", "detail"),
            "rejects": rej.select("ticket_id", "action"), "record_rejects": unread})
        pred.unpersist()
        df.unpersist()

    w = _records(spark, source, max_files_per_trigger).writeStream.foreachBatch(write).option(
        "checkpointLocation", _checkpoint(spark, "predict", checkpoint))
    return _trigger(w, available_now, interval).start()


# ---------------------------------------------------------------------------
# Status events folded into per-service state (streaming form)
# ---------------------------------------------------------------------------

FOLD_OUT = T.StructType([
    T.StructField("service_id", T.LongType()), T.StructField("event_id", T.LongType()),
    T.StructField("update_seq", T.LongType()), T.StructField("breach_probability", T.DoubleType()),
    T.StructField("response_remaining", T.DoubleType()), T.StructField("resolution_remaining", T.DoubleType())])
FOLD_STATE = T.StructType([
    T.StructField("p", T.DoubleType()), T.StructField("r", T.DoubleType()), T.StructField("q", T.DoubleType()),
    T.StructField("k", T.LongType())])


def _fold_group(key, pdfs, st):
    """Per service: the running state is four numbers (p, remaining x2, count), kept in
    the state store; events of the micro-batch are applied in (time, id) order."""
    pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["event_ts", "event_id"])
    if st.exists:
        p, r, q, k = st.get
    else:
        first = pdf.iloc[0]
        p, r, q, k = float(first["_p0"]), float(first["_r0"]), float(first["_q0"]), 0
    ps, rs, qs, ks = [], [], [], []
    for d, t in zip(pdf["delta_p"].to_numpy(float), pdf["time_saved"].to_numpy(float)):
        p = min(max(p + d, 0.0), 1.0)
        r, q, k = r + t, q + t, k + 1
        ps.append(round(p, state.PROB_DECIMALS)), rs.append(r), qs.append(q), ks.append(k)
    st.update((p, r, q, k))
    yield pd.DataFrame({"service_id": [key[0]] * len(ps), "event_id": pdf["event_id"].to_numpy("int64"),
                        "update_seq": ks, "breach_probability": ps, "response_remaining": rs,
                        "resolution_remaining": qs})


def status_fold_stream(spark: SparkSession, source: str, initial_state: DataFrame, sink: str,
                       checkpoint: str | None = None, available_now: bool = True,
                       interval: str = "5 seconds", event_schema: T.StructType | None = None,
                       max_files_per_trigger: int | None = 16) -> StreamingQuery:
    """S4 streaming: parquet status events joined (stream-static) to the latest prior
    state (inner join = events without prior state are dropped), then folded per
    service with ``applyInPandasWithState``.

    Events apply in the order of their micro-batches, inside one by time and id; sources write files in
    time order.  A service's events of one micro-batch are sorted in one task, so ``max_files_per_trigger``
    bounds what a hot service needs."""
    reader = spark.readStream.schema(event_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = reader.parquet(source)
    latest = state.latest_state(initial_state).select(
        "service_id", F.col("breach_probability").alias("_p0"), F.col("response_remaining").alias("_r0"),
        F.col("resolution_remaining").alias("_q0"))
    d = state.event_deltas(ev).filter(F.col("handled")).select(
        "service_id", "event_id", "event_ts", "delta_p", F.col("time_saved").cast("double"))
    joined = d.join(latest, "service_id", "inner")
    folded = joined.groupBy("service_id").applyInPandasWithState(
        _fold_group, FOLD_OUT, FOLD_STATE, "append", GroupStateTimeout.NoTimeout)
    out = folded.withColumn("breach_bucket", breach_bucket(F.col("breach_probability"))) \
        .withColumn("sla_status", sla_status(F.col("breach_probability")))
    w = out.writeStream.outputMode("append").foreachBatch(_append_batch(sink)) \
        .option("checkpointLocation", _checkpoint(spark, "fold", checkpoint))
    return _trigger(w, available_now, interval).start()


# ---------------------------------------------------------------------------
# Windowed metrics with an event-time watermark; alarms on the result
# ---------------------------------------------------------------------------

def windowed_metrics_stream(spark: SparkSession, source: str, sink: str, period_s: int = 300,
                            watermark: str = "10 minutes", schema: T.StructType | None = None,
                            checkpoint: str | None = None, available_now: bool = True,
                            interval: str = "5 seconds") -> StreamingQuery:
    """Tumbling windows per metric.  Update mode writes every window that a micro-batch
    changed, also those that the watermark has not closed; ``read_windows`` takes the latest
    version of each.  (The watermark bounds the state and is our addition: the source system stamps
    processing time and has no late-data policy.)"""
    # watermarks need TIMESTAMP; wall-clock NTZ input is converted and the window start
    # converted back, so window boundaries equal the batch ones
    pts = (spark.readStream.schema(schema).parquet(source)
           .withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark))
    w = F.window("ts", f"{period_s} seconds")
    agg = (pts.groupBy("namespace", "metric", w.alias("w"))
           .agg(F.sum("value").alias("sum"), F.avg("value").alias("average"), F.count(F.lit(1)).alias("samples"))
           .select("namespace", "metric", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "sum",
                   "average", "samples"))
    wr = agg.writeStream.outputMode("update").foreachBatch(_append_batch(sink)) \
        .option("checkpointLocation", _checkpoint(spark, "windows", checkpoint))
    return _trigger(wr, available_now, interval).start()


def read_windows(spark: SparkSession, windows_path: str) -> DataFrame:
    """The windows of a ``windowed_metrics_stream`` sink: the version of the last micro-batch that changed each."""
    value = F.struct("sum", "average", "samples")
    return (spark.read.parquet(windows_path).groupBy("namespace", "metric", "window_start")
            .agg(F.max_by(value, "batch_id").alias("v")).select("namespace", "metric", "window_start", "v.*"))


def alarms_from_windows(spark: SparkSession, windows_path: str, period_s: int = 300) -> DataFrame:
    """Alarm evaluation over the windows a ``windowed_metrics_stream`` emitted (a
    batch job over its sink, run after each trigger)."""
    w = read_windows(spark, windows_path).withColumn("period_s", F.lit(period_s)).drop("namespace")
    return alarms.evaluate_windows(w, [a for a in alarms.ALARMS if a[2] == period_s])


# ---------------------------------------------------------------------------
# E-mail files -> de-duplicated support tickets
# ---------------------------------------------------------------------------

EMAIL_JSON_SCHEMA = T.StructType([
    T.StructField("message_id", T.LongType()), T.StructField("sender", T.StringType()),
    T.StructField("subject", T.StringType()), T.StructField("body", T.StringType()),
    T.StructField("received_at", T.TimestampType())])


def email_ticket_stream(spark: SparkSession, source: str, sink: str, watermark: str = "1 day",
                        checkpoint: str | None = None, available_now: bool = True,
                        interval: str = "30 seconds", mails: DataFrame | None = None) -> StreamingQuery:
    """S8 + C12: e-mails (JSON files of ``source``, or the stream ``mails``, say of ``mail.read_mbox``) -> drop re-deliveries
    within the watermark -> support filter -> classify -> ticket."""
    em = ((mails if mails is not None else spark.readStream.schema(EMAIL_JSON_SCHEMA).json(source))
          .withWatermark("received_at", watermark)
          .dropDuplicatesWithinWatermark(["message_id"]))
    t = text.build_email_ticket(text.analyze_email(em).filter(F.col("is_support")))
    out = t.select("message_id", "priority", "department", "service_type", "location", "ticket_id",
                   "breach_probability", "revenue_impact", "customer_tier", "reporter_name", "contact")
    w = out.writeStream.foreachBatch(_append_batch(sink)).option("checkpointLocation",
                                                                 _checkpoint(spark, "email", checkpoint))
    return _trigger(w, available_now, interval).start()


# ---------------------------------------------------------------------------
# Bus events routed to several consumers in one pass
# ---------------------------------------------------------------------------

BUS_SCHEMA = T.StructType([T.StructField("source", T.StringType()), T.StructField("detail_type", T.StringType()),
                           T.StructField("detail", T.StringType())])


def route_stream(spark: SparkSession, source: str, sink: str, checkpoint: str | None = None,
                 available_now: bool = True, interval: str = "5 seconds") -> StreamingQuery:
    """Each micro-batch is routed once (B26) and written partitioned by rule, one
    folder per consumer."""
    ev = spark.readStream.schema(BUS_SCHEMA).json(source)

    def write(df: DataFrame, batch_id: int) -> None:
        alarms.route_events(df).write.mode("overwrite").partitionBy("rule") \
            .parquet(os.path.join(sink, f"batch_id={batch_id}"))

    w = ev.writeStream.foreachBatch(write).option("checkpointLocation", _checkpoint(spark, "route", checkpoint))
    return _trigger(w, available_now, interval).start()
