"""Mailboxes: written, split, read back."""

import datetime as dt
import os

import pytest

from servicelens.sources import mail

AT = dt.datetime(2024, 1, 31, 10, 0)
BODIES = ["plain", "", "From the start\nFrom here\n>From there\n>>From afar\n", "ends with lines\n\n\n", "é 日本 🙂\n\ttab", "carriage\r\nreturn\rs",
          "nul \x00 and \x1c\x85", "line sep par", "\n\nFrom \nFrom", " leading blank\n .dot", "=?utf-8?B?x?=", "x" * 5000]


def test_round_trip(spark, tmp_dir):
    rows = [(i, f'"User {i}" <user.{i}@example.org>', f"Subject {b[:6]!r} é" if i % 2 else "plain subject", AT, b) for i, b in enumerate(BODIES * 2)]
    df = spark.createDataFrame(rows, "message_id long, sender string, subject string, received_at timestamp, body string")
    mail.write_mbox(df.repartition(3), f"{tmp_dir}/box")
    got = {r["message_id"]: r for r in mail.read_mbox(spark, f"{tmp_dir}/box").collect()}
    assert len(got) == len(rows)
    for i, sender, subject, at, body in rows:
        r = got[f"<{i}@mail.example.org>"]
        assert (r["sender"], r["subject"], r["received_at"], r["to"]) == (sender, subject, at, "desk@example.org")
        assert r["body"] == body


def test_large_files_are_split_at_messages(spark, tmp_dir):
    rows = [(i, "a@b.org", "s", AT, f"body {i}\nFrom line\n" * 50) for i in range(400)]
    df = spark.createDataFrame(rows, "message_id long, sender string, subject string, received_at timestamp, body string")
    mail.write_mbox(df.coalesce(1), f"{tmp_dir}/box")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        box = mail.read_mbox(spark, f"{tmp_dir}/box")
        assert box.rdd.getNumPartitions() > 8
        assert sorted((int(r["message_id"][1:].split("@")[0]), r["body"]) for r in box.collect()) == [(r[0], r[4]) for r in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text, sender, body", [
    ("x Mon\nFrom: a@b\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/html\n\n<p>no</p>\n--q\nContent-Type: text/plain\n\nyes\n--q--\n", "a@b", "yes"),
    ("x Mon\nFrom: a@b\nSubject: two\n lines\nDate: never\n\nbody", "a@b", "body"), ("x Mon\n\nno headers", None, "no headers")])
def test_messages_of_others(text, sender, body):
    got = mail.parse_message(text)
    assert got[1] == sender and got[5].strip() == body
    assert mail.parse_message("x Mon\n \n") is None
    if "two" in text:
        assert got[3] == "two lines" and got[4] is None


def test_stream_of_messages(spark, tmp_dir):
    df = spark.createDataFrame([(i, "a@b.org", "s", AT, f"b{i}") for i in range(10)], "message_id long, sender string, subject string, received_at timestamp, body string")
    mail.write_mbox(df.repartition(4), f"{tmp_dir}/box")
    q = mail.read_mbox(spark, f"{tmp_dir}/box", stream=True, max_files_per_trigger=1).writeStream.format("parquet") \
        .option("path", f"{tmp_dir}/out").option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert sorted(r["body"] for r in spark.read.parquet(f"{tmp_dir}/out").collect()) == sorted(f"b{i}" for i in range(10))
    assert os.path.exists(f"{tmp_dir}/ck")


def test_a_batch_is_parsed_in_slices():
    """Of a large batch only some messages are Python objects at one time, also in what goes back to Spark."""
    import tracemalloc

    import pyarrow as pa
    text = "MAILER 2024-01-31\nMessage-ID: <{}@b>\nDate: Wed, 31 Jan 2024 10:00:00 +0000\n\n" + "body " * 4000
    whole = pa.RecordBatch.from_pydict({"value": [text.format(i) for i in range(1500)] + ["", "MAILER 2024-01-31\n"]})
    ids = []
    tracemalloc.start()
    for batch in mail._parse(iter([whole])):
        assert batch.num_rows <= mail._SLICE
        ids += batch.column(0).to_pylist()
        assert set(batch.column(5).to_pylist()) <= {"body " * 4000} and set(batch.column(4).cast("int64").to_pylist()) <= {1706695200000000}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == [f"<{i}@b>" for i in range(1500)] and peak < whole.nbytes
