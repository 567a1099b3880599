"""Jobs in event time against plain folds; commits of several tables at once."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from servicelens.operators import alarms
from servicelens.operators import state as ST
from servicelens.streaming import eventtime
from servicelens.streaming.commits import BatchCommits

EVENTS = "service_id long, event_id long, event_ts timestamp_ntz, detail_type string, task_status string, sla_impact string, " \
         "execution_time long, success boolean"
START = dt.datetime(2024, 1, 1)
KINDS = [("L1 Task Completion", "completed", "positive"), ("L1 Task Completion", "completed", "neutral"), ("L1 Task Failed", None, None),
         ("L1 Task Completion", "partial", None), ("License Change Completed", None, None), ("Unknown", None, None)]
DELTA = {0: -0.2, 1: -0.1, 2: 0.1, 3: -0.05, 4: 0.15}


def event(i, service, minutes, kind):
    name, status, impact = KINDS[kind]
    return (service, i, START + dt.timedelta(minutes=minutes), name, status, impact, 10, False if kind == 4 else None)


def write_files(spark, src, files):
    for rows in files:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(src)


def run_fold(spark, tmp_dir, files, initial, delay, ttl_days=90.0):
    src, sink = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "sink")
    write_files(spark, src, files)
    first = spark.createDataFrame(initial, "service_id long, version_ts timestamp_ntz, breach_probability double, "
                                           "response_remaining double, resolution_remaining double")
    q = eventtime.event_time_fold_stream(spark, src, first, sink, spark.createDataFrame([], EVENTS).schema, delay=delay, ttl_days=ttl_days,
                                         checkpoint=os.path.join(tmp_dir, "ck"), max_files_per_trigger=1)
    q.awaitTermination(600)
    assert q.exception() is None
    return BatchCommits(spark, sink), q


def brute(events, initial, ttl_days):
    """Versions (service, event, seq, p), missing and expiry of events folded in (time, id) order."""
    versions, missing, expired = [], [], []
    ttl = dt.timedelta(days=ttl_days)
    for service in {e[0] for e in events} | {s[0] for s in initial}:
        st = next((list(s[1:3]) for s in initial if s[0] == service), None)
        k = 0
        for e in sorted((e for e in events if e[0] == service and e[3] != "Unknown"), key=lambda e: (e[2], e[1])):
            if st is not None and e[2] >= st[0] + ttl:
                expired.append((service, st[0] + ttl))
                st = None
            if st is None:
                missing.append((service, e[1]))
                continue
            kind = next(i for i, x in enumerate(KINDS) if x == (e[3], e[4], e[5]))
            st, k = [e[2], min(max(st[1] + DELTA[kind], 0.0), 1.0)], k + 1
            versions.append((service, e[1], k, round(st[1], 6)))
        if st is not None:
            expired.append((service, st[0] + ttl))
    return sorted(versions), sorted(missing), sorted(expired)


@pytest.mark.parametrize("ttl_days", [90.0, 0.25])
def test_fold_does_not_depend_on_files(spark, tmp_dir, ttl_days):
    """Rows out of order within an hour over six files, half of them of one service, equal times, late copies."""
    rng = random.Random(5)
    rows = [event(i, 1 if rng.random() < 0.5 else rng.randint(2, 9), rng.randint(0, 1800) // 5 * 5, rng.randrange(6)) for i in range(1, 900)]
    arrival = sorted(rows, key=lambda e: e[2] + dt.timedelta(minutes=rng.randint(0, 55)))
    files = [arrival[i:i + 150] for i in range(0, len(arrival), 150)]
    late = [event(-i, rng.randint(1, 9), rng.randint(0, 300), 0) for i in range(1, 20)]
    closing = [event(0, 1, 60 * 24 * 365, 5)]
    initial = [(s, START - dt.timedelta(hours=1), s / 10, 60.0, 240.0) for s in range(1, 9)]
    run, q = run_fold(spark, tmp_dir, [*files, late, closing], initial, "1 hour", ttl_days)
    versions, missing, expired = brute(rows, initial, ttl_days)
    got = run.read("versions")
    assert sorted((r[0], r[1], r[2], round(r[3], 6)) for r in got.select("service_id", "event_id", "update_seq", "breach_probability").collect()) == versions
    assert sorted(map(tuple, run.read("missing").select("service_id", "event_id").collect())) == missing
    assert sorted(map(tuple, run.read("expired").collect())) == expired
    assert sorted(r[0] for r in run.read("late").select("event_id").collect()) == sorted(-i for i in range(1, 20))
    assert len(run.batches()) >= 8
    if ttl_days == 90.0:
        first = spark.createDataFrame(initial, "service_id long, version_ts timestamp_ntz, breach_probability double, "
                                               "response_remaining double, resolution_remaining double")
        batch = ST.apply_status_events(first, spark.createDataFrame(rows, EVENTS))
        cols = ["service_id", "event_id", "update_seq", "breach_probability", "response_remaining", "sla_status", "version_ts"]
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_state_stays_flat(spark, tmp_dir):
    """Every day new services; after the TTL the store has forgotten the old ones."""
    days, per_day = 12, 20
    initial = [(d * per_day + s, START + dt.timedelta(days=d), 0.5, 60.0, 240.0) for d in range(days) for s in range(per_day)]
    files = [[event(d * per_day + s, d * per_day + s, 60 * 24 * d + 30, 0) for s in range(per_day)] for d in range(days)]
    run, q = run_fold(spark, tmp_dir, files + [[event(10_000, 1, 60 * 24 * 100, 5)]], initial, "1 hour", ttl_days=2.0)
    assert run.read("versions").count() == days * per_day and run.read("expired").count() == days * per_day
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert sizes[-1] < sizes[0] / 10, sizes


def test_state_is_kept_by_bucket(spark, tmp_dir):
    """State entries and calls grow with the buckets, not with the services; events without service, id or time are told apart."""
    n = 2000
    initial = [(s, START - dt.timedelta(hours=1), 0.5, 60.0, 240.0) for s in range(n)]
    odd = [(None, 2 * n, START, *KINDS[0], 10, None), (7, None, START, *KINDS[0], 10, None), (8, 3 * n, None, *KINDS[0], 10, None)]
    run, q = run_fold(spark, tmp_dir, [[event(s, s, s % 60, 2) for s in range(n)] + odd, [event(-1, 1, 60 * 24 * 365, 5)]], initial, "1 hour")
    got = run.read("versions").groupBy("service_id").count().collect()
    assert {r[0]: r[1] for r in got} == {s: 1 + (s == 7) for s in range(n)}
    assert [tuple(r) for r in run.read("missing").select("service_id", "event_id").collect()] == [(None, 2 * n)]
    assert [tuple(r) for r in run.read("late").select("service_id", "event_id", "event_ts").collect()] == [(8, 3 * n, None)]
    assert run.read("expired").count() == n
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(sizes) <= 6 * eventtime.BUCKETS, sizes


METRICS = "namespace string, metric string, value double, ts timestamp_ntz"


def points(minutes, metric, value):
    return [("n", metric, float(value), START + dt.timedelta(minutes=m)) for m in minutes]


def test_alarm_transitions_with_gaps(spark, tmp_dir):
    """By hand: two of two periods, an alarm that ends with a breach missing and one that ends with no data."""
    rows = points([1, 6, 11, 16], "HighRiskTickets", 6) + points([36, 41], "HighRiskTickets", 11) + points([46], "HighRiskTickets", 1) \
        + points([70, 200], "SLACompliance", 0.5) + points([130], "SLACompliance", 0.9) + [("n", "HighRiskTickets", None, START)]
    at = lambda m: START + dt.timedelta(minutes=m)
    want = [("error-events", at(5), "ALARM"), ("error-events", at(20), "OK"), ("error-events", at(40), "ALARM"), ("error-events", at(45), "OK"),
            ("high-breach-rate", at(35), "ALARM"), ("high-breach-rate", at(45), "OK"),
            ("prediction-accuracy", at(60), "ALARM"), ("prediction-accuracy", at(120), "OK"),
            ("prediction-accuracy", at(180), "ALARM"), ("prediction-accuracy", at(240), "OK")]
    everything = spark.createDataFrame(rows, METRICS)
    windows = alarms.multi_period_windows(everything, [300, 3600])
    assert sorted(map(tuple, alarms.alarm_transitions(windows).collect())) == sorted(want)
    src, sink = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "sink")
    random.Random(3).shuffle(rows)
    for part in (rows[:5], rows[5:], [("n", "Heartbeat", 0.0, at(100_000))]):
        spark.createDataFrame(part, METRICS).coalesce(1).write.mode("append").parquet(src)
    q = eventtime.alarm_transition_stream(spark, src, sink, everything.schema, delay="5 hours", checkpoint=os.path.join(tmp_dir, "ck"),
                                          max_files_per_trigger=1)
    q.awaitTermination(600)
    assert sorted(map(tuple, BatchCommits(spark, sink).read("transitions").collect())) == sorted(want)


def test_tables_of_a_batch_are_seen_together_or_not_at_all(spark, tmp_dir):
    log = BatchCommits(spark, tmp_dir)
    rows = lambda n: spark.range(n).withColumn("batch", F.lit(n))
    log.write(0, {"a": rows(3), "b": rows(3)})
    broken = rows(4).withColumn("x", F.raise_error(F.concat(F.lit("lost "), F.col("id").cast("string"))).cast("int"))
    with pytest.raises(Exception, match="lost"):
        log.write(1, {"a": rows(4), "b": broken})
    assert os.path.exists(f"{tmp_dir}/a/batch_id=1")  # written, but nobody sees it
    assert log.batches() == [0] and log.read("a").count() == log.read("b").count() == 3
    log.write(1, {"a": rows(4), "b": rows(4)})  # the retry
    log.write(1, {"a": rows(4), "b": rows(4)})  # and one after a commit
    assert log.read("a").count() == log.read("b").count() == 7
    with pytest.raises(ValueError):
        log.read("c")


def test_compaction_swaps_the_base(spark, tmp_dir):
    log = BatchCommits(spark, tmp_dir)
    for b in range(3):
        log.write(b, {"a": spark.range(10).withColumn("batch", F.lit(b))})
    before = log.read("a")
    assert log.compact("a", F.col("id") >= 5) == 2
    log.write(3, {"a": spark.range(10).withColumn("batch", F.lit(3))})
    assert before.count() == 30  # opened before: still there
    assert len(log.folders("a")) == 2 and log.read("a").count() == 15 + 10
    assert log.vacuum("a") == 3 and log.read("a").count() == 25
    log.compact("a", F.col("batch") >= 2)
    assert log.vacuum("a") == 2 and sorted({r[0] for r in log.read("a").select("batch").collect()}) == [2, 3]
    log.compact("a", F.lit(False))  # no new batch, but rows have expired
    assert log.read("a").count() == 0


def test_drift_days_over_several_batches(spark, tmp_dir):
    """Outcomes before, after and beyond the horizon, in files that come in turns; a day is emitted once."""
    at = lambda h: START + dt.timedelta(hours=h)
    rng = random.Random(8)
    preds = [(str(i), at(rng.randint(0, 90)), rng.random()) for i in range(120)]
    outs = [(t, ts + dt.timedelta(hours=rng.choice([0, 5, 47, 48, 49, 70])), rng.random() < 0.5) for t, ts, _ in preds if int(t) % 7]
    days = {}
    for t, ts, p in preds:
        o = next((b for n, k, b in outs if n == t and k <= ts + dt.timedelta(hours=48)), None)
        days.setdefault(ts.date(), []).append(None if o is None else float((p >= 0.5) == o))
    src = [os.path.join(tmp_dir, n) for n in ("p", "o")]
    schemas = ("ticket_id string, created_at timestamp_ntz, model_probability double", "ticket_id string, known_at timestamp_ntz, breached boolean")
    for rows, schema, path, last in ((preds, schemas[0], src[0], ("x", at(9000), 0.0)), (outs, schemas[1], src[1], ("x", at(9000), False))):
        rows = sorted(rows, key=lambda r: r[1])
        for part in (rows[:40], rows[40:], [last]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    q = eventtime.drift_stream(spark, *src, os.path.join(tmp_dir, "sink"), *(spark.createDataFrame([], s).schema for s in schemas), delay="200 hours",
                               checkpoint=os.path.join(tmp_dir, "ck"), max_files_per_trigger=1, trained_at="2024-01-01 00:00:00")
    q.awaitTermination(600)
    got = BatchCommits(spark, os.path.join(tmp_dir, "sink")).read("days").collect()
    assert len(got) == len(days)
    for r in got:
        known = [x for x in days[r["day"]] if x is not None]
        assert (r["scored"], r["open"]) == (len(known), len(days[r["day"]]) - len(known))
        assert abs(r["accuracy"] - sum(known) / len(known)) < 1e-9 and r["drift"] == (r["accuracy"] < 0.8)


def test_a_fault_between_two_tables_leaves_no_half_batch(spark, tmp_dir, monkeypatch):
    """The score stream loses its second table once; a reader sees nothing of the batch until the retry commits it."""
    from servicelens.sources import ingest, rawfeeds
    from servicelens.streaming import jobs

    from .conftest import SF_SMALL
    src, sink, ck = (os.path.join(tmp_dir, n) for n in ("src", "sink", "ck"))
    rawfeeds.change_records(spark, SF_SMALL).select("value").write.text(src)
    emit = ingest.emit_events
    monkeypatch.setattr(ingest, "emit_events", lambda df, *a: emit(df, *a).withColumn(
        "x", F.raise_error(F.concat(F.lit("lost "), F.col("detail"))).cast("int")))
    q = jobs.score_stream(spark, src, sink, checkpoint=ck)
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination(300)
    log = BatchCommits(spark, sink)
    assert os.path.exists(f"{sink}/states/batch_id=0") and log.batches() == []
    monkeypatch.undo()
    jobs.score_stream(spark, src, sink, checkpoint=ck).awaitTermination(300)
    assert log.batches() == [0] and log.read("events").count() == log.read("states").count() > 0
