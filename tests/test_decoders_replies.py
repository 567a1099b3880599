"""Hand cases for the envelope decoders (A1, A2, A4) and reply cleaning (H20), plus a
brute-force check of the sequential prefix stripping."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from servicelens.operators import text as T
from servicelens.sources import ingest as IN

WS = " \t\n\r\f\x0b"


def _ticket(tid, **extra):
    d = {"ticket_id": tid, "title": "t", "description": "d", "status": "open", "priority": "1",
         "category": "network", "created_at": "2024-01-01T10:00:00"}
    d.update(extra)
    return json.dumps(d)


def test_unify_shapes_all_envelopes(spark):
    rows = [
        (1, json.dumps({"Records": [{"body": _ticket("A")}, {"body": _ticket("B")}]})),
        (2, json.dumps({"Records": [{"body": None}]})),         # null body: one all-null ticket
        (3, json.dumps({"Records": []})),                       # empty batch: no ticket
        (4, json.dumps({"source": "x", "detail-type": "Ticket", "detail": json.loads(_ticket("C"))})),
        (5, _ticket("D")),                                      # bare ticket
        (6, json.dumps({"detail": None, "ticket_id": "E"})),   # null detail: read as bare
    ]
    df = spark.createDataFrame(rows, "k int, value string")
    got = sorted(IN.unify_shapes(df).select(F.coalesce("ticket_id", F.lit("<null>")), "priority", "status")
                 .collect())
    assert [tuple(r) for r in got] == [("<null>", 3, "open"), ("A", 1, "open"), ("B", 1, "open"),
                                       ("C", 1, "open"), ("D", 1, "open"), ("E", 3, "open")]


def test_queue_decode_wrapped_bare_and_rejects(spark):
    rows = [(1, json.dumps({"ticket": json.loads(_ticket("A"))})),
            (2, _ticket("B", priority=None, category=None)),
            (3, "not json: T-3"),
            (4, "[1, 2]")]
    ok, bad = IN.decode_queue_json(spark.createDataFrame(rows, "k int, body string"))
    assert sorted(tuple(r) for r in ok.select("ticket_id", "priority", "category").collect()) == [
        ("A", 1, "network"), ("B", 3, "general")]
    assert sorted(r.k for r in bad.collect()) == [3, 4]
    assert bad.columns == ["k", "body"]


def test_change_feed_insert_modify_remove(spark):
    def rec(ev, img):
        return json.dumps({"eventName": ev, "dynamodb": {"NewImage": img}})
    img = {"ticket_id": {"S": "A"}, "priority": {"N": "2"}, "created_at": {"S": "2024-01-01T10:00:00"}}
    rows = [(1, rec("INSERT", img)), (2, rec("MODIFY", {"ticket_id": {"S": "B"}})), (3, rec("REMOVE", img)),
            (4, "garbage")]
    ok, bad = IN.decode_change_feed(spark.createDataFrame(rows, "k int, value string"))
    got = sorted(tuple(r) for r in ok.select("ticket_id", "priority", "status", "category").collect())
    assert got == [("A", 2, "open", "general"), ("B", 3, "open", "general")]
    assert sorted(r.k for r in bad.collect()) == [3, 4]


def _reply_by_definition(text: str, lang: str = "en") -> str:
    """Sequential definition: strip, then for each prefix in order strip it (and the
    following whitespace) when the current text starts with it."""
    r = text.strip(WS)
    for pre in T.REPLY_PREFIXES:
        if r.startswith(pre):
            r = r[len(pre):].strip(WS)
    if len(r) > 1000:
        r = r[:1000] + "..."
    if len(r) == 0:
        r = T.REPLY_DEFAULT_HI if lang == "hi" else T.REPLY_DEFAULT_EN
    return r


_PIECES = st.lists(st.sampled_from(T.REPLY_PREFIXES + [" ", "\n", "ok", "Response", ":", "Answer: yes"]),
                   max_size=6).map("".join)


@settings(max_examples=40, deadline=None)
@given(st.lists(_PIECES, min_size=1, max_size=20))
def test_clean_reply_equals_sequential_definition(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.r for r in df.select("i", T.clean_reply(F.col("t"), F.lit("en")).alias("r")).collect()}
    assert got == {i: _reply_by_definition(t) for i, t in enumerate(texts)}


def test_clean_reply_hand_cases(spark):
    cases = ["  Response: Answer:  hello ", "Answer: Response: x", "AI Response:", "", "उत्तर: नमस्ते",
             "Reply:" + "a" * 1200, "Response in Hindi: ok"]
    df = spark.createDataFrame([(i, t, "hi" if i == 3 else "en") for i, t in enumerate(cases)],
                               "i int, t string, lang string")
    got = {r.i: r.r for r in df.select("i", T.clean_reply(F.col("t"), F.col("lang")).alias("r")).collect()}
    assert got[0] == "hello"
    assert got[1] == "Response: x"          # prefixes apply in list order, each once
    assert got[2] == T.REPLY_DEFAULT_EN
    assert got[3] == T.REPLY_DEFAULT_HI
    assert got[4] == "नमस्ते"
    assert got[5] == "a" * 1000 + "..."
    assert got[6] == "ok"                    # only the last prefix, "Response in Hindi:", applies
    assert got == {i: _reply_by_definition(t, "hi" if i == 3 else "en") for i, t in enumerate(cases)}
