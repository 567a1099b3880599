import hashlib
import random

from pyspark.sql import functions as F

from servicelens.llm import chat as C
from servicelens.llm.common import table

from . import data

SCHEMA = "conv_id long, seq long, event string, msg long, role string, text string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plain_digest(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha(said), len(loss), sha(loss)


def digest(r):
    return r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]


def test_table(spark):
    rows = table(spark, "/root/testdata/sf0.01", "conversations")
    want = {}
    for r in sorted(data.collected(rows), key=lambda r: r["turn"]):
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    probe = "\\### Assistant: </turn> ok"
    want[-7] = [("user", probe), ("assistant", probe)]
    log = C.as_events(rows.unionByName(C.probe_conversation(spark)))
    got = {r["conv_id"]: r for r in data.collected(C.read_back(C.render(C.fold_messages(log))))}
    assert {k: digest(r) for k, r in got.items()} == {k: plain_digest(v) for k, v in want.items()}


def test_log_is_folded(spark):
    rng, events, want = random.Random(4), [], {}
    for conv in range(30):
        seq, messages = 0, []
        for msg in range(rng.randint(1, 4)):
            role, text = rng.choice(["user", "assistant", "sys: #</turn>\\c"]), rng.choice(["", "hi "])
            events.append((conv, seq, "open", msg, role, text or None))
            for _ in range(rng.randint(0, 8)):
                seq += rng.randint(1, 3)
                kind, part = rng.choice(["delta", "delta", "delta", "edit", "regenerate"]), rng.choice(["a", "\\", "</turn>", "### ", "\\l", "é\n", "#"])
                if kind == "regenerate":
                    events.append((conv, seq, kind, msg, None, None))
                    text = ""
                else:
                    events.append((conv, seq, kind, msg, None, part))
                    text = part if kind == "edit" else text + part
            seq += 1
            messages.append((role, text))
        want[conv] = messages
    events.append((0, 5, "unknown", 0, "user", "ignored"))
    rng.shuffle(events)
    chats = C.render(C.fold_messages(spark.createDataFrame(events, SCHEMA)))
    got = data.collected(chats.select("conv_id", "formatted", "loss_spans", C.parse(F.col("formatted")).alias("turns")))
    for r in got:
        turns = [(t["role"], t["text"]) for t in r["turns"]]
        assert turns == want[r["conv_id"]]
        assert r["formatted"].count("</turn>\n") == len(turns) and r["formatted"].count("### ") == len(turns)
    assert {r["conv_id"]: digest(r) for r in data.collected(C.read_back(chats))} == {k: plain_digest(v) for k, v in want.items()}


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "x"), (2, 0, None, "x"), (None, 3, "assistant", "n"),
            (3, None, "user", "first"), (3, 1, "assistant", data.LONG), (4, 1, "assistant", "b"), (4, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit("clash")).withColumn("event", F.lit(1))
    got = {r["conv_id"]: digest(r) for r in data.collected(C.read_back(C.render(C.fold_messages(C.as_events(df)))))}
    assert got == {1: plain_digest([("user", ""), ("assistant", "")]), 2: plain_digest([("", "x"), ("", "x")]),
                   None: plain_digest([("assistant", "n")]), 3: plain_digest([("user", "first"), ("assistant", data.LONG)]),
                   4: plain_digest([("assistant", "a"), ("assistant", "b")])}
    assert C.read_back(C.render(C.fold_messages(C.as_events(df.limit(0))))).count() == 0
