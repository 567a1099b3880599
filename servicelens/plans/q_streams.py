"""Structured Streaming jobs as registered queries.

Each query writes its input, derived from the driver tables, as files under the
shared checkpoint folder, runs the streaming job with ``availableNow`` over it (the
stream's own checkpoint is in the same shared folder), waits for it, and returns the
sink.  A stream processed to the end must equal the batch job, so the oracle is the
batch SQL of the same operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import fmt_ts
from ..operators import alarms as A
from ..operators import scoring
from ..operators import state as ST
from ..operators import text as TX
from ..sources import fixtures as fx
from ..sources import ingest as IN
from ..sources import mail as MAIL
from ..sources import rawfeeds as RF
from ..sources.tables import read_table
from ..streaming import eventtime, jobs
from ..streaming.commits import BatchCommits
from . import sqlfix as S
from .registry import ORACLE, load_all, query


def _finish(q) -> None:
    """Wait for an ``availableNow`` stream to drain its input; re-raise its failure."""
    q.awaitTermination()
    err = q.exception()
    if err is not None:
        raise RuntimeError(f"stream {q.name or q.id} failed: {err}")


def _oracle(name: str) -> str:
    load_all()
    return ORACLE[name]


# the decoded change feed: INSERT / MODIFY records only, every 7th without priority
# and category (defaults 3 / general) -- the same tickets the stream decodes
_DECODED = """
dec AS (
  SELECT ticket_id, CASE WHEN order_key % 7 = 0 THEN 3 ELSE priority END AS priority, status,
    CASE WHEN order_key % 7 = 0 THEN 'general' ELSE category END AS category, created_at
  FROM tickets WHERE order_key % 3 <> 2
)"""


def _score_run(spark, sf_dir) -> BatchCommits:
    src, sink = IN.scratch_path(spark, "score-src"), IN.scratch_path(spark, "score-sink")
    RF.change_records(spark, sf_dir).select("value").write.text(src)
    _finish(jobs.score_stream(spark, src, sink, checkpoint=IN.scratch_path(spark, "score-ckpt")))
    return BatchCommits(spark, sink)


_STREAM_SCORED = f"WITH {S.TICKETS}, {_DECODED}, {S.SCORED.replace('FROM tickets', 'FROM dec')}"


@query("score_stream_sink", oracle=f"""
{_STREAM_SCORED}
SELECT ticket_id, priority, status, category, breach_probability,
  {S.bucket('breach_probability')} AS breach_bucket, {S.status('breach_probability')} AS sla_status,
  response_remaining, resolution_remaining, {S.ts(S.AS_OF)} AS version_ts,
  {S.ts(S.AS_OF + " + INTERVAL 90 DAY")} AS expire_at
FROM scored
""")
def q_score_stream(spark, sf_dir):
    """S1 + S9: change records (text files) -> decode -> score -> versioned state rows, streamed."""
    out = _score_run(spark, sf_dir).read("states")
    return out.withColumns({c: fmt_ts(c) for c in ("version_ts", "expire_at")})


@query("score_stream_events", oracle=f"""
{_STREAM_SCORED}
SELECT 'sla-monitor' AS source, 'Metric Update' AS detail_type, ticket_id, {S.status('breach_probability')} AS sla_status
FROM scored
""")
def q_score_stream_events(spark, sf_dir):
    """S1 + A10: one metric event per state row, read back from the events sink."""
    ev = _score_run(spark, sf_dir).read("events")
    return ev.select("source", "detail_type", F.get_json_object("detail", "$.ticket_id").alias("ticket_id"),
                     F.get_json_object("detail", "$.sla_status").alias("sla_status"))


@query("score_stream_rejects", oracle=f"""
WITH {S.TICKETS}
SELECT ticket_id FROM tickets WHERE order_key % 3 = 2
""")
def q_score_stream_rejects(spark, sf_dir):
    """The records that are no ticket changes land in the rejects sink."""
    rej = _score_run(spark, sf_dir).read("rejects")
    return rej.select(F.get_json_object("value", "$.dynamodb.NewImage.ticket_id.S").alias("ticket_id"))


def _window_run(spark, sf_dir) -> str:
    src, sink = IN.scratch_path(spark, "points-src"), IN.scratch_path(spark, "points-sink")
    pts = fx.metric_points(spark, sf_dir)
    pts.write.parquet(src)
    _finish(jobs.windowed_metrics_stream(spark, src, sink, schema=pts.schema, checkpoint=IN.scratch_path(spark, "points-ckpt")))
    return sink


@query("windowed_metrics_stream_sink", oracle=_oracle("windowed_metrics_5m"))
def q_windowed_metrics_stream(spark, sf_dir):
    """Tumbling windows streamed in update mode; all windows, also the last ones, equal the batch."""
    w = jobs.read_windows(spark, _window_run(spark, sf_dir))
    return w.select("metric", fmt_ts("window_start").alias("window_start"), F.round("sum", 6).alias("sum_value"),
                    F.round("average", 9).alias("avg_value"), "samples")


@query("alarm_states_stream", oracle=f"""
SELECT * FROM ({_oracle("alarm_states")}) WHERE alarm_name <> 'prediction-accuracy'
""")
def q_alarm_states_stream(spark, sf_dir):
    """The five-minute alarms over the streamed windows equal the batch evaluation."""
    a = jobs.alarms_from_windows(spark, _window_run(spark, sf_dir))
    return a.select("alarm_name", fmt_ts("window_start").alias("window_start"), F.round("value", 9).alias("value"),
                    "breaching", "alarm_state")


@query("status_fold_stream_sink", oracle=f"""
WITH {S.STATUS_FOLD}
SELECT service_id, event_id, CAST(update_seq AS BIGINT) AS update_seq, breach_probability,
  {S.bucket('breach_probability')} AS breach_bucket, {S.status('breach_probability')} AS sla_status,
  CAST(response_remaining AS DOUBLE) AS response_remaining, CAST(resolution_remaining AS DOUBLE) AS resolution_remaining
FROM sv
""")
def q_status_fold_stream(spark, sf_dir):
    """S4 streaming: status events (parquet files) joined to the prior state and folded
    per service with ``applyInPandasWithState``; equals the batch fold."""
    src, sink = IN.scratch_path(spark, "fold-src"), IN.scratch_path(spark, "fold-sink")
    ev = fx.status_events(spark, sf_dir)
    ev.write.parquet(src)
    _finish(jobs.status_fold_stream(spark, src, fx.initial_state(spark, sf_dir), sink,
                                    checkpoint=IN.scratch_path(spark, "fold-ckpt"), event_schema=ev.schema))
    return spark.read.parquet(sink).select("service_id", "event_id", "update_seq", "breach_probability",
                                           "breach_bucket", "sla_status", "response_remaining",
                                           "resolution_remaining")


@query("email_ticket_stream_sink", oracle=_oracle("email_tickets"))
def q_email_ticket_stream(spark, sf_dir):
    """S8 + C12: e-mails (JSON files, re-deliveries included) -> de-duplicated within
    the watermark -> support filter -> tickets; equals the batch ``email_tickets``."""
    src, sink = IN.scratch_path(spark, "mail-src"), IN.scratch_path(spark, "mail-sink")
    (fx.emails(spark, sf_dir).withColumn("received_at", F.lit("2024-01-31 10:00:00").cast("timestamp"))
     .write.json(src))
    _finish(jobs.email_ticket_stream(spark, src, sink, checkpoint=IN.scratch_path(spark, "mail-ckpt")))
    return spark.read.parquet(sink).drop("batch_id")


def _mailbox(spark, sf_dir) -> str:
    path = IN.scratch_path(spark, "mailbox")
    MAIL.write_mbox(fx.emails(spark, sf_dir).withColumn("received_at", F.lit("2024-01-31 10:00:00").cast("timestamp")), path)
    return path


def _numbered(mails):
    return mails.withColumn("message_id", F.regexp_extract("message_id", r"^<(\d+)@", 1).cast("bigint"))


@query("mbox_email_tickets", oracle=_oracle("email_tickets"))
def q_mbox_email_tickets(spark, sf_dir):
    """A5 + C12: the e-mails as mbox files, read back message by message, give the same tickets."""
    em = _numbered(MAIL.read_mbox(spark, _mailbox(spark, sf_dir))).dropDuplicates(["message_id"])
    t = TX.build_email_ticket(TX.analyze_email(em).filter("is_support"))
    return t.select("message_id", "priority", "department", "service_type", "location", "ticket_id", "breach_probability",
                    "revenue_impact", "customer_tier", "reporter_name", "contact")


@query("mbox_ticket_stream_sink", oracle=_oracle("email_tickets"))
def q_mbox_ticket_stream(spark, sf_dir):
    """S8 over a mailbox: mbox files as a stream of messages."""
    src, sink = _mailbox(spark, sf_dir), IN.scratch_path(spark, "mbox-sink")
    _finish(jobs.email_ticket_stream(spark, src, sink, checkpoint=IN.scratch_path(spark, "mbox-ckpt"),
                                     mails=_numbered(MAIL.read_mbox(spark, src, stream=True))))
    return spark.read.parquet(sink).drop("batch_id")


@query("route_stream_counts", oracle=_oracle("event_routes"))
def q_route_stream(spark, sf_dir):
    """Bus events (JSON files) routed once per micro-batch into one folder per
    rule; the routed counts per rule equal the batch ``event_routes``."""
    src, sink = IN.scratch_path(spark, "bus-src"), IN.scratch_path(spark, "bus-sink")
    fx.bus_events(spark, sf_dir).write.json(src)
    _finish(jobs.route_stream(spark, src, sink, checkpoint=IN.scratch_path(spark, "bus-ckpt")))
    return spark.read.parquet(sink).groupBy("rule").agg(F.count(F.lit(1)).alias("events"))


def _pred_sql() -> str:
    from .q_scoring import _PRED_SQL
    return _PRED_SQL


@query("predict_stream_sink", oracle=f"""
WITH {S.TICKETS}, {_DECODED}, {S.SCORED.replace("FROM tickets", "FROM dec")}, {_pred_sql()}
SELECT ticket_id, final_p AS final_breach_probability, final_p >= 0.7 AS priority_boost,
  CASE WHEN final_p >= 0.7 THEN greatest(1, coalesce(priority, 3) - 1) ELSE coalesce(priority, 3) END AS new_priority,
  CAST(CASE WHEN final_p >= 0.9 THEN greatest(5, trunc(min_rem * 0.1))
       WHEN final_p >= 0.7 THEN greatest(15, trunc(min_rem * 0.3))
       WHEN final_p >= 0.5 THEN greatest(30, trunc(min_rem * 0.5))
       ELSE trunc(min_rem) END AS BIGINT) AS time_to_breach
FROM pred2
""")
def q_predict_stream(spark, sf_dir):
    """S3: change records -> decode -> score -> heuristic model -> combine, with the
    triggered actions written as typed events in the same micro-batch (foreachBatch);
    the prediction table equals the batch prediction of the decoded tickets."""
    src, sink = IN.scratch_path(spark, "pred-src"), IN.scratch_path(spark, "pred-sink")
    RF.change_records(spark, sf_dir).select("value").write.text(src)
    _finish(jobs.predict_stream(spark, src, sink, checkpoint=IN.scratch_path(spark, "pred-ckpt")))
    return BatchCommits(spark, sink).read("predictions")


# ---------------------------------------------------------------------------
# Event time: files that arrive out of order, late events, a last event that moves the watermark past all others
# ---------------------------------------------------------------------------

_SLOTS = 8


def _arrivals(spark, sf_dir, rows, ts: str, key: str, late=None):
    """``rows`` written as one file per arrival slot, in order: a row arrives up to an eighth of the time range after its
    own time (by a hash of ``key``), so every file holds rows that are older than some of the file before it.  ``late``
    rows come last.  Returns the folder and the delay in seconds behind which nothing but ``late`` arrives."""
    src = IN.scratch_path(spark, "arrivals")
    bounds = read_table(spark, sf_dir, "events", ["ts"]).agg(F.unix_seconds(F.min(F.col("ts").cast("timestamp"))).alias("a"),
                                                            F.unix_seconds(F.max(F.col("ts").cast("timestamp"))).alias("b")).first()
    slot = max(1, -(-(bounds["b"] + 1 - bounds["a"]) // _SLOTS))
    arrives = F.unix_seconds(F.col(ts).cast("timestamp")) - bounds["a"] + F.pmod(F.xxhash64(key), F.lit(slot))
    staged = IN.scratch_path(spark, "staged")
    rows.withColumn("_slot", F.floor(arrives / slot).cast("int")).write.partitionBy("_slot").parquet(staged)
    held = spark.read.parquet(staged)
    for i in range(_SLOTS + 1):
        held.filter(F.col("_slot") == i).select(*rows.columns).coalesce(1).write.mode("append").parquet(src)
    for more in [late] if late is not None else []:
        more.select(*rows.columns).coalesce(1).write.mode("append").parquet(src)
    return src, 2 * slot + 60


def _closing(rows, ts: str, **values):
    """One row a year after the events; it moves the watermark past all of them."""
    columns = [F.lit("2025-01-31 00:00:00").cast("timestamp_ntz") if f.name == ts else F.lit(values.get(f.name)).cast(f.dataType) for f in rows.schema]
    return rows.sparkSession.range(1).select(*[c.alias(f.name) for c, f in zip(columns, rows.schema)])


def _late_copies(spark, sf_dir, events):
    """Second reports, under negative ids, of some events of the first quarter; they come after everything else."""
    first = read_table(spark, sf_dir, "events", ["ts"]).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    early = F.unix_micros(F.col("event_ts").cast("timestamp")) * 4 < \
        F.unix_micros(F.col("a").cast("timestamp")) * 3 + F.unix_micros(F.col("b").cast("timestamp"))
    return (events.filter("event_id % 97 = 5").join(F.broadcast(first)).filter(early).drop("a", "b")
            .withColumn("event_id", -F.col("event_id")))


def _event_fold_run(spark, sf_dir, ttl_days: float = 90) -> BatchCommits:
    ev = fx.status_events(spark, sf_dir)
    src, delay = _arrivals(spark, sf_dir, ev, "event_ts", "event_id", _late_copies(spark, sf_dir, ev))
    _closing(ev, "event_ts", detail_type="Unknown", event_id=0, service_id=0).coalesce(1).write.mode("append").parquet(src)
    sink = IN.scratch_path(spark, "event-fold-sink")
    _finish(eventtime.event_time_fold_stream(
        spark, src, fx.initial_state(spark, sf_dir), sink, ev.schema, delay=f"{delay} seconds", ttl_days=ttl_days,
        checkpoint=IN.scratch_path(spark, "event-fold-ckpt"), max_files_per_trigger=2))
    return BatchCommits(spark, sink)


@query("event_time_fold_stream", oracle=_oracle("status_event_fold"))
def q_event_time_fold(spark, sf_dir):
    """S4 in event time: files out of order over several micro-batches, late copies among them; the versions are those of
    the batch fold."""
    v = _event_fold_run(spark, sf_dir).read("versions")
    return v.select("service_id", "event_id", "detail_type", fmt_ts("version_ts").alias("version_ts"), "update_seq",
                    "breach_probability", "breach_bucket", "sla_status", "response_remaining", "resolution_remaining")


@query("event_time_fold_rejects", oracle=f"""
WITH {S.STATUS_FOLD}, b AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS z FROM events)
SELECT 'late' AS kind, service_id, -event_id AS event_id, detail_type FROM sev, b
WHERE event_id % 97 = 5 AND epoch_us(event_ts) * 4 < a * 3 + z
UNION ALL SELECT 'missing', service_id, event_id, detail_type FROM sev WHERE service_id NOT IN (SELECT service_id FROM sst)
""")
def q_event_time_rejects(spark, sf_dir):
    """S4/C7 in event time: events behind the watermark, and events of services without a state."""
    run = _event_fold_run(spark, sf_dir)
    rows = [run.read(k).select(F.lit(k).alias("kind"), "service_id", "event_id", "detail_type") for k in ("late", "missing")]
    return rows[0].unionByName(rows[1].filter("service_id IS NOT NULL"))  # as NOT IN leaves them out


_TTL_DAYS = 2

_EXPIRY_SQL = f"""
WITH {S.STATUS_FOLD},
gaps AS (
  SELECT e.service_id, e.event_id, e.event_ts,
    lag(e.event_ts, 1, TIMESTAMP '2023-12-31 00:00:00') OVER (PARTITION BY e.service_id ORDER BY e.event_ts, e.event_id) AS prev
  FROM sev e JOIN sst USING (service_id)
),
alive AS (
  SELECT *, max(CASE WHEN event_ts >= prev + INTERVAL {int(_TTL_DAYS * 24)} HOUR THEN 1 ELSE 0 END)
    OVER (PARTITION BY service_id ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING) = 0 AS ok
  FROM gaps
),
ended AS (
  SELECT s.service_id, coalesce(max(event_ts) FILTER (WHERE ok), TIMESTAMP '2023-12-31 00:00:00') AS last_ts,
    count(*) FILTER (WHERE ok) AS applied, count(*) FILTER (WHERE NOT ok) AS dropped
  FROM sst s LEFT JOIN alive USING (service_id) GROUP BY s.service_id
)"""


@query("state_expiry_stream", oracle=f"""{_EXPIRY_SQL}
SELECT e.service_id, e.applied, e.dropped, {S.ts(f"last_ts + INTERVAL {int(_TTL_DAYS * 24)} HOUR")} AS expired_at, v.breach_probability
FROM ended e LEFT JOIN sv v ON v.service_id = e.service_id AND v.update_seq = e.applied
""")
def q_state_expiry(spark, sf_dir):
    """S9 in the state store: a service whose last version is older than the TTL is forgotten by an event-time timer; later
    events find no state.  Per service: events applied and dropped, when it expired, the last probability."""
    run = _event_fold_run(spark, sf_dir, _TTL_DAYS)
    applied = run.read("versions").groupBy("service_id").agg(F.count(F.lit(1)).alias("applied"),
                                                             F.max_by("breach_probability", "update_seq").alias("breach_probability"))
    dropped = run.read("missing").groupBy("service_id").agg(F.count(F.lit(1)).alias("dropped"))
    out = run.read("expired").join(applied, "service_id", "left").join(dropped, "service_id", "left")
    return out.select("service_id", F.coalesce("applied", F.lit(0)).alias("applied"), F.coalesce("dropped", F.lit(0)).alias("dropped"),
                      fmt_ts("expired_at").alias("expired_at"), "breach_probability")


@query("compacted_state_versions", oracle=_oracle("live_state_versions"))
def q_compacted_versions(spark, sf_dir):
    """S9 at rest: the streamed versions compacted into one base without the expired ones; what is read afterwards."""
    run = _event_fold_run(spark, sf_dir)
    run.compact("versions", ST.not_expired("2024-04-15 00:00:00"))
    run.vacuum("versions")
    live = run.read("versions").withColumn("expire_at", ST.expires_at("version_ts"))
    return live.groupBy("service_id").agg(F.count(F.lit(1)).alias("live_versions"), fmt_ts(F.min("expire_at")).alias("next_expiry"))


_TRANSITIONS_SQL = f"""
WITH st AS (SELECT alarm_name, CAST(window_start AS TIMESTAMP) AS ws FROM ({_oracle("alarm_states")}) WHERE alarm_state = 'ALARM'),
p AS (SELECT *, CASE WHEN alarm_name = 'prediction-accuracy' THEN INTERVAL 1 HOUR ELSE INTERVAL 5 MINUTE END AS step FROM st)
SELECT alarm_name, {S.ts('ws')} AS window_start, 'ALARM' AS alarm_state FROM p a
WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.alarm_name = a.alarm_name AND b.ws = a.ws - a.step)
UNION ALL SELECT alarm_name, {S.ts('ws + step')}, 'OK' FROM p a
WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.alarm_name = a.alarm_name AND b.ws = a.ws + a.step)
"""


@query("alarm_transitions", oracle=_TRANSITIONS_SQL)
def q_alarm_transitions(spark, sf_dir):
    """E5: where each alarm goes on and off, in batch."""
    points = fx.metric_points(spark, sf_dir)
    windows = A.multi_period_windows(points, sorted({a[2] for a in A.ALARMS}), sorted({a[1] for a in A.ALARMS}))
    return A.alarm_transitions(windows).withColumn("window_start", fmt_ts("window_start"))


@query("alarm_transition_stream", oracle=_TRANSITIONS_SQL)
def q_alarm_transition_stream(spark, sf_dir):
    """The same transitions, all five alarms, emitted once each while the stream runs over files out of order."""
    points = fx.metric_points(spark, sf_dir)
    src, delay = _arrivals(spark, sf_dir, points, "ts", "ts")
    _closing(points, "ts", metric="Heartbeat", value=0.0, namespace="ServiceOps").coalesce(1).write.mode("append").parquet(src)
    sink = IN.scratch_path(spark, "transitions-sink")
    _finish(eventtime.alarm_transition_stream(spark, src, sink, points.schema, delay=f"{delay} seconds",
                                              checkpoint=IN.scratch_path(spark, "transitions-ckpt"), max_files_per_trigger=2))
    return BatchCommits(spark, sink).read("transitions").withColumn("window_start", fmt_ts("window_start"))


_DRIFT_SQL = f"""
WITH {S.TICKETS}, {S.SCORED},
outcome AS (
  SELECT ticket_id, created_at + to_hours(CAST(CASE WHEN order_key % 10 = 3 THEN 60 ELSE order_key * 7 % 47 END AS BIGINT)) AS known_at,
    order_key % 4 < 2 AS breached
  FROM tickets WHERE order_key % 9 <> 0
),
j AS (SELECT CAST(s.created_at AS DATE) AS day, s.breach_probability >= 0.5 AS p, o.breached
      FROM scored s LEFT JOIN outcome o ON s.ticket_id = o.ticket_id AND known_at <= s.created_at + INTERVAL 48 HOUR)"""


@query("drift_stream_days", oracle=f"""{_DRIFT_SQL}
SELECT strftime(day, '%Y-%m-%d') AS day, round(coalesce(avg(CASE WHEN p = breached THEN 1.0 ELSE 0.0 END) FILTER (breached IS NOT NULL), -1), 6) AS accuracy,
  count(breached) AS scored, count(*) - count(breached) AS open,
  coalesce(avg(CASE WHEN p = breached THEN 1.0 ELSE 0.0 END) FILTER (breached IS NOT NULL) < 0.55, false) AS drift,
  coalesce(avg(CASE WHEN p = breached THEN 1.0 ELSE 0.0 END) FILTER (breached IS NOT NULL) < 0.55, false)
    OR date_diff('day', TIMESTAMP '2024-01-24 00:00:00', CAST(day AS TIMESTAMP)) >= 7 AS retrain
FROM j GROUP BY day
""")
def q_drift_stream(spark, sf_dir):
    """M3: predictions and later outcomes as two streams; accuracy of each day, with what never got an outcome in time."""
    t = fx.tickets(spark, sf_dir)
    p = scoring.sla_metrics(t).select("ticket_id", "created_at", F.col("breach_probability").alias("model_probability"))
    hours = F.when(F.pmod("order_key", F.lit(10)) == 3, 60).otherwise(F.pmod(F.col("order_key") * 7, F.lit(47)))
    o = t.filter("order_key % 9 <> 0").select(
        "ticket_id", (F.col("created_at") + F.make_dt_interval(hours=hours.cast("int"))).alias("known_at"),
        (F.pmod("order_key", F.lit(4)) < 2).alias("breached"))
    paths = []
    for rows, ts in ((p, "created_at"), (o, "known_at")):
        path = IN.scratch_path(spark, f"drift-{ts}")
        rows.write.parquet(path)
        _closing(rows, ts, ticket_id="none", model_probability=0.0, breached=False).coalesce(1).write.mode("append").parquet(path)
        paths.append(path)
    sink = IN.scratch_path(spark, "drift-sink")
    _finish(eventtime.drift_stream(spark, *paths, sink, p.schema, o.schema, min_accuracy=0.55, trained_at="2024-01-24 00:00:00",
                                   checkpoint=IN.scratch_path(spark, "drift-ckpt")))
    days = BatchCommits(spark, sink).read("days")
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.coalesce("accuracy", F.lit(-1.0)), 6).alias("accuracy"),
                       "scored", "open", "drift", "retrain")
