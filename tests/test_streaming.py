"""Streams processed with availableNow must equal the batch operators."""

import os
import time

from pyspark.sql import functions as F

from servicelens.operators import state, text
from servicelens.sources import fixtures as fx
from servicelens.sources import rawfeeds
from servicelens.streaming import jobs

from .conftest import SF_SMALL


def _sorted(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_score_stream_equals_batch(spark, tmp_dir):
    src, sink = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "sink")
    rawfeeds.change_records(spark, SF_SMALL).select("value").repartition(3).write.text(src)
    q = jobs.score_stream(spark, src, sink, checkpoint=os.path.join(tmp_dir, "ck"), max_files_per_trigger=1)
    q.awaitTermination(300)
    got = spark.read.parquet(sink + "/states")
    from servicelens.operators import scoring
    from servicelens.sources import ingest
    t, rejects = ingest.decode_change_feed(spark.read.text(src))
    want = scoring.sla_metrics(t)
    cols = ["ticket_id", "priority", "status", "category", "breach_probability", "sla_status"]
    assert _sorted(got, cols) == _sorted(want, cols)
    assert got.select("batch_id").distinct().count() >= 2  # really ran in several micro-batches
    assert spark.read.parquet(sink + "/rejects").count() == rejects.count() > 0
    assert spark.read.parquet(sink + "/events").count() == got.count()


def test_status_fold_stream_equals_batch(spark, tmp_dir):
    src, sink = os.path.join(tmp_dir, "events"), os.path.join(tmp_dir, "fold")
    ev = fx.status_events(spark, SF_SMALL)
    # files in time order, one per micro-batch
    times = sorted(r[0] for r in ev.select("event_ts").collect())
    cuts = [times[len(times) // 3], times[2 * len(times) // 3]]
    t = F.col("event_ts")
    for part in (t < cuts[0], (t >= cuts[0]) & (t < cuts[1]), t >= cuts[1]):
        ev.filter(part).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # the file source goes by modification time
    init = fx.initial_state(spark, SF_SMALL)
    q = jobs.status_fold_stream(spark, src, init, sink, checkpoint=os.path.join(tmp_dir, "ck"),
                                event_schema=ev.schema, max_files_per_trigger=1)
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    want = state.apply_status_events(init, spark.read.parquet(src))
    cols = ["service_id", "event_id", "update_seq", "breach_probability", "response_remaining", "breach_bucket"]
    assert got.select("batch_id").distinct().count() >= 2
    assert _sorted(got, cols) == _sorted(want, cols)


def test_email_stream_dedupes_and_matches_batch(spark, tmp_dir):
    src, sink = os.path.join(tmp_dir, "mail"), os.path.join(tmp_dir, "tickets")
    em = fx.emails(spark, SF_SMALL).withColumn("received_at", F.lit("2024-01-31 10:00:00").cast("timestamp_ntz"))
    em.write.json(src)
    q = jobs.email_ticket_stream(spark, src, sink, checkpoint=os.path.join(tmp_dir, "ck"))
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    want = text.build_email_ticket(text.analyze_email(fx.emails(spark, SF_SMALL).dropDuplicates(["message_id"]))
                                   .filter(F.col("is_support")))
    cols = ["message_id", "ticket_id", "priority", "department", "reporter_name", "revenue_impact"]
    assert _sorted(got, cols) == _sorted(want, cols)


def test_windowed_metrics_stream_and_alarms(spark, tmp_dir):
    from servicelens.operators import alarms
    src, sink = os.path.join(tmp_dir, "points"), os.path.join(tmp_dir, "windows")
    pts = fx.metric_points(spark, SF_SMALL)
    pts.write.parquet(src)
    q = jobs.windowed_metrics_stream(spark, src, sink, schema=pts.schema, checkpoint=os.path.join(tmp_dir, "ck"))
    q.awaitTermination(300)
    want = alarms.windowed_metrics(pts, 300)
    cols = ["metric", "window_start", "samples"]
    assert _sorted(jobs.read_windows(spark, sink), cols) == _sorted(want, cols)
    a = jobs.alarms_from_windows(spark, sink)
    assert a.count() > 0


def test_route_stream(spark, tmp_dir):
    src, sink = os.path.join(tmp_dir, "bus"), os.path.join(tmp_dir, "routes")
    fx.bus_events(spark, SF_SMALL).write.json(src)
    q = jobs.route_stream(spark, src, sink, checkpoint=os.path.join(tmp_dir, "ck"))
    q.awaitTermination(300)
    got = spark.read.parquet(sink).groupBy("rule").count()
    from servicelens.operators import alarms
    want = alarms.route_events(fx.bus_events(spark, SF_SMALL)).groupBy("rule").count()
    assert _sorted(got, ["rule", "count"]) == _sorted(want, ["rule", "count"])
