"""Distributed operators against brute force on small fixtures, including a very
hot key (a third of all rows on one service / value range)."""

import random

from pyspark.sql import functions as F

from servicelens.operators import alarms, state
from servicelens.operators.util import global_rank

from .conftest import SF_SMALL


def _brute_fold(p0, deltas):
    out, p = [], p0
    for d in deltas:
        p = min(max(p + d, 0.0), 1.0)
        out.append(round(p, 9))
    return out


def test_clamped_fold_example(spark):
    st = spark.createDataFrame([(7, 0.5, 60.0, 240.0)], "service_id long, breach_probability double, "
                                                         "response_remaining double, resolution_remaining double") \
        .withColumn("version_ts", F.lit("2023-12-31").cast("timestamp_ntz"))
    deltas = [0.1, -0.3, 1.4, -0.2]
    ev = spark.createDataFrame([(7, i, f"2024-01-0{i + 1} 00:00:00", d) for i, d in enumerate(deltas)],
                               "service_id long, event_id long, ts string, delta_p double") \
        .select("service_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("event_ts"), "delta_p",
                F.lit(0).cast("bigint").alias("time_saved"))
    v = state.apply_status_events(st, ev, num_partitions=3).orderBy("update_seq").collect()
    assert [r.breach_probability for r in v] == [0.6, 0.3, 1.0, 0.8]


def test_fold_hot_service_matches_brute_force(spark):
    rnd = random.Random(7)
    services = {1: 0.5, 2: 0.1, 3: 0.9}
    rows, n = [], 0
    for svc, count in ((1, 900), (2, 300), (3, 600)):  # service 1 holds half of all events
        for i in range(count):
            rows.append((svc, n, f"2024-01-{1 + i % 28:02d} {i % 24:02d}:{i % 60:02d}:00",
                         rnd.choice([-0.2, -0.1, -0.05, 0.1, 0.15, 0.3])))
            n += 1
    st = spark.createDataFrame([(k, v, 60.0, 240.0) for k, v in services.items()],
                               "service_id long, breach_probability double, response_remaining double, "
                               "resolution_remaining double").withColumn("version_ts",
                                                                         F.lit("2023-12-31").cast("timestamp_ntz"))
    ev = spark.createDataFrame(rows, "service_id long, event_id long, ts string, delta_p double").select(
        "service_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("event_ts"), "delta_p",
        F.lit(1).cast("bigint").alias("time_saved"))
    got = {(r.service_id, r.event_id): (r.breach_probability, r.update_seq, r.response_remaining)
           for r in state.apply_status_events(st, ev, num_partitions=7).collect()}
    for svc, p0 in services.items():
        evs = sorted([r for r in rows if r[0] == svc], key=lambda r: (r[2], r[1]))
        expect = _brute_fold(p0, [r[3] for r in evs])
        assert [got[(svc, r[1])][0] for r in evs] == expect
        assert [got[(svc, r[1])][1] for r in evs] == list(range(1, len(evs) + 1))
        assert [got[(svc, r[1])][2] for r in evs] == [60.0 + i for i in range(1, len(evs) + 1)]


def test_global_rank_with_heavy_ties(spark):
    vals = [(i, 0.5 if i % 3 == 0 else (i % 17) / 17.0) for i in range(3000)]
    df = spark.createDataFrame(vals, "k long, p double")
    r = global_rank(df, [F.col("p").desc(), F.col("k").asc()], "pos", num_partitions=5).collect()
    expect = sorted(vals, key=lambda x: (-x[1], x[0]))
    got = sorted(r, key=lambda x: x.pos)
    assert [x.k for x in got] == [e[0] for e in expect]
    assert [x.pos for x in got] == list(range(1, 3001))


def test_alarm_votes_match_brute_force(spark):
    # HighRiskTickets points: breaches in periods 0,1,2 then gap at 3, breach at 4,5
    base = "2024-01-01 00:00:00"
    counts = {0: 7, 1: 8, 2: 6, 4: 9, 5: 6, 6: 1}
    rows = [("ServiceOps", "HighRiskTickets", 1.0, k * 300 + j) for k, c in counts.items() for j in range(c)]
    pts = spark.createDataFrame(rows, "namespace string, metric string, value double, off int").withColumn(
        "ts", F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("off").cast("decimal(18,6)")))
    a = alarms.evaluate_alarms(pts, [("x", "HighRiskTickets", 300, "Sum", 2, 5.0, ">")])
    got = {r.window_start.minute // 5 + r.window_start.hour * 12: r.alarm_state for r in a.collect()}
    breach = {k: c > 5 for k, c in counts.items()}
    for k in counts:
        expect = "ALARM" if breach[k] and breach.get(k - 1, False) else "OK"
        assert got[k] == expect, (k, got[k])


def test_exact_median_matches_brute_force_on_skewed_groups(spark):
    """Distributed exact median (global rank, no per-group value buffer) equals the
    sorted-list definition; one group holds most rows and one value most of those."""
    import random

    from servicelens.operators import kpi

    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 10 < 7 else ("odd" if i % 10 < 9 else None)
        v = 5.0 if (g == "hot" and i % 3 == 0) else round(rnd.uniform(0, 100), 3)
        rows.append((i, g, None if i % 97 == 0 else v))
    rows += [(10_000, "single", 42.0), (10_001, "even", 1.0), (10_002, "even", 4.0), (10_003, "allnull", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r.g: r.median for r in kpi.exact_median(df, "g", "v", tiebreak="id").collect()}
    want = {}
    for g in {r[1] for r in rows}:
        vals = sorted(r[2] for r in rows if r[1] == g and r[2] is not None)
        if vals:
            n = len(vals)
            want[g] = 0.5 * vals[(n + 1) // 2 - 1] + 0.5 * vals[n // 2]
    assert got == want
    builtin = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect() if r.m is not None}
    assert got == builtin


def test_latest_after_events_equals_the_last_version(spark):
    from servicelens.operators import state
    from servicelens.sources import fixtures as fx
    init, events = fx.initial_state(spark, SF_SMALL), fx.status_events(spark, SF_SMALL)
    hot = events.withColumn("service_id", F.when(F.pmod("event_id", F.lit(2)) == 0, F.lit(1)).otherwise(F.col("service_id")))
    cols = ["service_id", "update_seq", "breach_probability", "response_remaining", "resolution_remaining", "version_ts", "breach_bucket"]
    for ev in (events, hot, events.limit(0)):
        want = state.latest_state(state.all_versions(init, state.apply_status_events(init, ev)), tie="update_seq")
        got = state.latest_after_events(init, ev, num_partitions=7)
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
