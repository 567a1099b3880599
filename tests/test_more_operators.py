"""Config-table thresholds, state append/expiry, priority-index layout, prediction
flattening, substring asset lookup, event routing rules."""

import os

from pyspark.sql import functions as F

from servicelens.operators import impact, kpi, responses, scoring, state
from servicelens.sources import fixtures as fx
from servicelens.sources import ingest

from .conftest import SF_SMALL

AS_OF = "2024-02-01 00:00:00"


def test_threshold_table_matches_literal_config(spark):
    t = fx.tickets(spark, SF_SMALL)
    th = spark.createDataFrame([(1, 15.0, 240.0), (2, 60.0, 480.0), (3, 240.0, 1440.0), (4, 480.0, 2880.0)],
                               "priority int, response_min double, resolution_min double")
    a = scoring.sla_metrics(t, AS_OF).select("ticket_id", "breach_probability", "response_threshold")
    b = scoring.sla_metrics(t, AS_OF, thresholds=th).select("ticket_id", "breach_probability", "response_threshold")
    assert sorted(a.collect()) == sorted(b.collect())
    # a changed P1 threshold changes only P1 tickets; unknown priority 5 keeps the P3 default
    th2 = th.withColumn("response_min", F.when(F.col("priority") == 1, 30.0).otherwise(F.col("response_min")))
    c = scoring.sla_metrics(t, AS_OF, thresholds=th2)
    assert c.filter((F.col("priority") == 1) & (F.col("response_threshold") != 30.0)).count() == 0
    assert c.filter((F.col("priority") == 5) & (F.col("response_threshold") != 240.0)).count() == 0


def test_append_state_and_expiry(spark, tmp_dir):
    s = scoring.sla_metrics(fx.tickets(spark, SF_SMALL), AS_OF).select("ticket_id", "breach_probability")
    path = os.path.join(tmp_dir, "state")
    ingest.append_sla_state(s, path, AS_OF)
    ingest.append_sla_state(s, path, "2024-03-01 00:00:00")
    st = spark.read.parquet(path)
    assert st.count() == 2 * s.count()
    live = state.expire_state(st, as_of="2024-05-15 00:00:00")
    assert live.count() == s.count()  # the first version expired after 90 days
    latest = state.latest_state(st.select("service_id", "version_ts", "breach_probability"))
    assert latest.filter(F.col("version_ts") != F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")).count() == 0


def test_priority_index_layout_prunes(spark, tmp_dir):
    t = fx.tickets(spark, SF_SMALL).select("ticket_id", "priority", "created_at")
    path = os.path.join(tmp_dir, "idx")
    kpi.write_priority_index(t, path)
    q = spark.read.parquet(path).filter(F.col("priority") == 1)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(priority), EqualTo(priority,1)]" in plan
    assert q.count() == t.filter(F.col("priority") == 1).count()


def test_flatten_prediction_shapes(spark):
    whole = ('{"breach_risk_assessment": {"breach_probability": 0.91, "confidence_level": 0.95, "risk_level": "HIGH"}, '
             '"timeline_prediction": {"estimated_resolution_hours": 5}}')
    df = spark.createDataFrame([(1, whole), (2, '{"breach_risk_assessment": {"breach_probability": 0.7}}'), (3, "not json")],
                               "id long, raw string")
    p = responses.flatten_prediction(responses.parse_responses(df)).orderBy("id").collect()
    assert [(r.breach_probability, r.prediction_confidence, r.estimated_hours) for r in p] == [
        (0.91, 0.95, 5.0), (0.7, 0.8, 24.0), (0.5, 0.8, 24.0)]


def test_asset_lookup_is_contains(spark):
    tk = spark.createDataFrame([("AST-10 broke", None, 0.9), ("Issue on asset AST-1", "LIC-7 too", 0.1), ("x(LIC-7),AST-1;AST-1", "", 0.5),
                                ("my asset 9", "", 0.7), ("nothing", "", 0.5)], "title string, description string, breach_probability double")
    for ids in (["AST-1", "AST-10", "LIC-7", "gone", "", None], ["asset 9", "AST-1", "LIC-7"], []):
        assets = spark.createDataFrame([(i,) for i in ids * 2], "asset_id string")
        got = {r.asset_id: r.total_services for r in impact.asset_sla_status(tk, assets).collect()}
        rows = [(r.title, r.description or "") for r in tk.collect()]
        want = {i: sum(i in t or i in d for t, d in rows) for i in ids if i is not None}
        assert got == {i: n for i, n in want.items() if n}


def test_event_rules(spark):
    from servicelens.operators import alarms
    ev = spark.createDataFrame([
        ("sla-monitor", "Metric Update", '{"ticket_id": "T-1"}'),
        ("sla-monitor", "SLA Breach Prediction", '{"breach_probability": 0.3}'),
        ("sla-monitor", "SLA Breach Prediction", '{"breach_probability": 0.9}'),
        ("chatbot", "Ticket Created", '{"priority": "P2"}'),
        ("chatbot", "Ticket Created", '{"priority": "P4"}'),
        ("other", "Metric Update", "{}")], "source string, detail_type string, detail string")
    got = sorted((r.detail, r.rule) for r in alarms.route_events(ev).collect())
    assert ('{"breach_probability": 0.3}', "high-risk-forward") not in got
    assert ('{"breach_probability": 0.9}', "high-risk-forward") in got
    assert ('{"priority": "P2"}', "priority-tickets") in got and ('{"priority": "P4"}', "priority-tickets") not in got
    assert not any(d == "{}" for d, _ in got)


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["AST-1", "AST-10", "AST-101", "AST-2", "x", "AST-"]), max_size=4)
                          .map(" ".join),
                          st.sampled_from([0.1, 0.6, 0.9])), min_size=1, max_size=15),
       st.lists(st.sampled_from(["AST-1", "AST-10", "AST-2", "AST-3", "", "AST-"]), min_size=1, max_size=5))
def test_substring_asset_lookup_equals_contains(spark, tickets, asset_ids):
    """Exactly the rows of the theta join on ``contains`` (nested ids, the empty id, empty texts)."""
    tk = spark.createDataFrame([(t, "", p) for t, p in tickets], "title string, description string, "
                                                                  "breach_probability double")
    assets = spark.createDataFrame([(a,) for a in asset_ids], "asset_id string")
    got = {r.asset_id: (r.total_services, r.at_risk_services)
           for r in impact.asset_sla_status(tk, assets).collect()}
    want = {}
    for a in set(asset_ids):
        hits = [p for t, p in tickets if a in (t + " ")]
        if hits:
            want[a] = (len(hits), sum(p >= 0.7 for p in hits))
    assert got == want


def test_few_anchors_leave_a_long_text(spark):
    """Texts of 10 kB and ids of 1 to 12 characters: what a row sends is a small part of its substrings."""
    import random
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(n))
    ids = [word(n) for n in range(4, 13) for _ in range(60)] + ["é", "ab ab ab"]
    texts = [" ".join(word(rng.randint(2, 12)) for _ in range(1400)) + f" {rng.choice(ids)}é ab ab ab" for _ in range(20)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "n int, title string, description string")
    known = spark.createDataFrame([(i,) for i in ids], "asset_id string")
    index = impact.AnchorIndex(known, "asset_id")
    sent = df.select(F.size(index.found(F.col("title"))).alias("sent")).agg(F.sum("sent")).first()[0]
    assert sent < 0.15 * sum(map(len, texts))  # one character ids stand at every "é" only
    got = sorted(map(tuple, impact.containing(df, ["title", "description"], known, "asset_id", ["n"]).select("n", "asset_id").collect()))
    assert got == sorted((n, i) for n, t in enumerate(texts) for i in ids if i in t)


def test_anchors_stay_rare_with_many_ids(spark):
    """40,000 numbered ids: few share an anchor, so the pairs to be compared grow no faster than ids and texts."""
    ids = spark.range(40_000).select(F.concat(F.lit("ASSET-"), F.lpad(F.col("id").cast("string"), 9, "7")).alias("asset_id"))
    shared = impact.AnchorIndex(ids, "asset_id").anchors.groupBy("_h").count().agg(F.max("count"), F.avg("count")).first()
    assert shared[1] < 2, shared
    texts = spark.range(40).select(F.col("id").alias("n"), F.concat(F.lit("on ASSET-"), F.lpad((F.col("id") * 1500).cast("string"), 9, "7")).alias("title"))
    got = sorted((r["n"], r["asset_id"]) for r in impact.containing(texts, ["title"], ids, "asset_id", ["n"]).collect())
    assert got == [(n, f"ASSET-{str(n * 1500).rjust(9, '7')}") for n in range(27)]
