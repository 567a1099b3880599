"""Sources, sinks and response parsing."""

import json
import os

from pyspark.sql import functions as F

from servicelens.operators import responses as RS
from servicelens.sources import fixtures as fx
from servicelens.sources import ingest

from .conftest import SF_SMALL


def test_parse_one_shapes():
    obj = {"analysis_summary": {"department": "UIDAI", "priority": "P1"}}
    js = json.dumps(obj)
    assert RS.parse_one(js)[0] == "strict"
    assert RS.parse_one(js + " thanks!")[0] == "extracted"
    assert RS.parse_one("Sure:\n```json\n" + js + "\n```")[0] == "extracted"
    broken = '{"analysis_summary": {"department": "UIDAI" "priority": "P1",}}'
    stage, text = RS.parse_one(broken)
    assert stage == "repaired" and json.loads(text) == obj
    assert RS.parse_one("no json here")[0] == "scraped"
    assert RS.parse_one("{'a': True}") == ("repaired", json.dumps({"a": True}))
    # comments, mixed quotes, doubled commas, a second pass that leaves quotes alone
    assert RS.parse_one('{"a": 1, // one\n "b": 2}')[1] == '{"a": 1, "b": 2}'
    assert RS.parse_one('{"a": 1, /* x */ "b": 2}')[1] == '{"a": 1, "b": 2}'
    assert RS.parse_one("""{"a": 'x', 'b': "y"}""")[1] == '{"a": "x", "b": "y"}'
    assert RS.parse_one('{"a": 1,, "b": 2,}')[1] == '{"a": 1, "b": 2}'
    assert RS.parse_one('{"a": "it\'s" "b": 2}')[1] == '{"a": "it\'s", "b": 2}'
    assert RS.parse_one('{ oops Response: {"a": 1} and more')[0] == "extracted"
    assert RS.parse_one(None) == ("scraped", None)


def test_scrape_and_multiselect(spark):
    df = spark.createDataFrame([("Department: eDistrict. Priority p2. urgency 12",)], "raw string")
    r = df.select(RS.scrape_values(F.col("raw")).alias("s")).first().s
    assert (r.department, r.priority, r.urgency_score) == ("eDistrict", "P2", 5)
    m = spark.createDataFrame([("DigitalMP|UIDAI", "Network, Payment", "P3|P1", "regional/statewide"),
                               ("|UIDAI", "Foo|Bar", "x|y", "galaxy|planet"), ("A/B", "Foo", "P1 - critical, P3", None)],
                              "department string, category string, priority string, impact_scope string")
    c = [tuple(r) for r in RS.clean_multiselect(m).collect()]
    assert c == [("DigitalMP", "Payment", "P1", "regional/statewide"), ("", "Other", "P3", "single_user"), ("A/B", "Foo", "P1", None)]


def test_prediction_scrape(spark):
    df = spark.createDataFrame([("There is a 72% probability of breach, confidence: 80%",), ("nothing",),
                                ("risk 85% with confidence 0.7, about 6 hours",), ("0.4 chance, 0 hours",), ("250% risk",)], "t string")
    got = [tuple(r.p) for r in df.select(RS.scrape_prediction(F.col("t")).alias("p")).collect()]
    assert got == [(0.72, 0.8, 24.0), (0.5, 0.7, 24.0), (0.5, 0.7, 6.0), (0.4, 0.7, 1.0), (1.0, 0.7, 24.0)]


def test_recommendation_replies(spark):
    whole = 'Of course:\n{"recommendations": [{"description": "%s", "timeline_months": 6}, {"title": "T", "type": "CONSOLIDATION"}]}\nBye' % ("d" * 60)
    df = spark.createDataFrame([(1, whole), (2, "no object"), (3, "{broken"), (4, '{"other": 1}'), (5, None), (6, "{x} y")], "id long, reply string")
    got = [r.asDict() for r in RS.parse_recommendations(df).orderBy("id", "rec_pos").collect()]
    assert [(r["id"], r["type"], r["title"], r["timeline_months"], r["confidence"], r["risk_level"]) for r in got] == [
        (1, "LICENSE_REDUCTION", "d" * 50 + "...", 6, 0.8, "LOW"), (1, "CONSOLIDATION", "T", 3, 0.8, "LOW")]


def write_emails_as_mime(df, path):
    """One MIME file per row."""
    from email.message import EmailMessage
    os.makedirs(path)
    for r in df.select("message_id", "sender", "subject", "body").collect():
        m = EmailMessage()
        m["Message-ID"], m["From"], m["To"], m["Subject"] = f"<{r.message_id}@example.org>", r.sender, "support@example.org", r.subject
        m.set_content(r.body)
        with open(os.path.join(path, f"{r.message_id}.eml"), "wb") as f:
            f.write(m.as_bytes())


def test_mime_emails_roundtrip(spark, tmp_dir):
    path = os.path.join(tmp_dir, "eml")
    em = fx.emails(spark, SF_SMALL).dropDuplicates(["message_id"])
    write_emails_as_mime(em, path)
    back = ingest.read_emails(spark, path)
    assert back.count() == em.count()
    one = back.filter(F.col("message_id") == "<2@example.org>").first()
    src = em.filter(F.col("message_id") == 2).first()
    assert one.subject == src.subject and one.body.strip() == src.body.strip()


def test_lake_partition_pruning(spark, tmp_dir):
    from pyspark.sql import types as T
    t = fx.tickets(spark, SF_SMALL).select("ticket_id", "created_at")
    rows = ingest.with_ingest_partitions(t, "created_at").drop("created_at")
    path = os.path.join(tmp_dir, "lake")
    ingest.write_lake_partitioned(rows, path, fmt="parquet")
    df = ingest.read_lake(spark, path, T.StructType([T.StructField("ticket_id", T.StringType())]), fmt="parquet")
    q = df.filter(F.col("day") == 31)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan
    assert q.count() == t.filter(F.dayofmonth("created_at") == 31).count()
