"""Ticks of the re-scoring index against full scoring."""

import datetime as dt
import os

from pyspark.sql import functions as F

from servicelens.operators import rescoring, scoring
from servicelens.sources import fixtures as fx

from .conftest import SF_SMALL

START = "2024-02-01 00:00:00"


def at(minutes):
    return str(dt.datetime.fromisoformat(START) + dt.timedelta(minutes=minutes))


def shown(df):
    return {r["ticket_id"]: (r["breach_bucket"], r["sla_status"]) for r in df.select("ticket_id", "breach_bucket", "sla_status").collect()}


def tickets(spark, rows):
    rows = [(str(i), p, s, "general", dt.datetime.fromisoformat(at(m))) for i, (p, s, m) in enumerate(rows)]
    return spark.createDataFrame(rows, "ticket_id string, priority int, status string, category string, created_at timestamp_ntz")


def test_next_change_is_just_before_the_bucket_changes(spark):
    """Every kind of ticket from its creation on: the score has the old bucket a second before, the new one a second after."""
    t = tickets(spark, [(p, s, 0) for p in (1, 2, 3, 4, None) for s in ("open", "in_progress")] + [(1, "closed", 0), (2, None, 0)])
    now = START
    for _ in range(4):
        scored = scoring.sla_metrics(t, now).withColumn("due", rescoring.next_change(scoring.sla_metrics(t, now), now))
        for r in scored.select("ticket_id", "status", "due", "breach_bucket", "breach_probability").collect():
            if r["status"] == "closed" or r["breach_probability"] >= 0.9:
                assert r["due"] is None
                continue
            one = t.filter(F.col("ticket_id") == r["ticket_id"])
            before, after = (shown(scoring.sla_metrics(one, str(r["due"] + dt.timedelta(seconds=s))))[r["ticket_id"]] for s in (0, 2))
            assert before != after and before[0] == r["breach_bucket"], r
        now = str(dt.datetime.fromisoformat(now) + dt.timedelta(minutes=9))


def test_ticks_equal_full_scoring_and_touch_few(spark, tmp_dir):
    all_tickets = fx.tickets(spark, SF_SMALL).select(*rescoring.TICKET)
    index = rescoring.RescoreIndex(spark, tmp_dir)
    assert shown(index.start(all_tickets, START)) == shown(scoring.sla_metrics(all_tickets, START))
    n, last = all_tickets.count(), START
    for run, minutes in ((1, 5), (2, 10), (3, 45), (4, 50)):  # the ticks from 15 to 40 were missed
        touched = index.tick(run, last, at(minutes))
        assert touched.count() < n / 4
        changed = rescoring.changes(touched)
        assert 0 < changed.count() <= touched.count()
        last = at(minutes)
        assert shown(index.current()) == shown(scoring.sla_metrics(all_tickets, last))


def test_updates_replace_entries(spark, tmp_dir):
    """A ticket that is resolved, one that is raised to P1, one that is new; a retried run changes nothing."""
    index = rescoring.RescoreIndex(spark, tmp_dir)
    index.start(tickets(spark, [(3, "open", 0), (4, "open", 0), (3, "open", 0)]), START)
    changed = tickets(spark, [(3, "resolved", 0), (1, "open", 0), (3, "open", 0), (2, "open", 3)]).filter("ticket_id <> '2'")
    index.update(1, changed, at(5))
    now = tickets(spark, [(3, "resolved", 0), (1, "open", 0), (3, "open", 0), (2, "open", 3)])
    last = at(5)
    for run, minutes in ((2, 60), (2, 60), (3, 100), (4, 200)):
        touched = {r["ticket_id"] for r in index.tick(run, last if run > 2 else at(5), at(minutes)).collect()}
        assert "0" not in touched
        assert shown(index.current()) == shown(scoring.sla_metrics(now, at(minutes)))
        last = at(minutes)


def test_only_slots_in_between_are_read(spark, tmp_dir):
    index = rescoring.RescoreIndex(spark, tmp_dir)
    index.start(fx.tickets(spark, SF_SMALL), START)
    plan = index.due(1, START, at(5))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "slot" in plan.split("PartitionFilters")[1].split("]")[0]


def test_no_tickets(spark, tmp_dir):
    index = rescoring.RescoreIndex(spark, tmp_dir)
    index.start(tickets(spark, [(1, "closed", 0)]).filter("priority = 2"), START)
    assert index.tick(1, START, at(5)).count() == 0 and index.current().count() == 0
    assert not os.path.exists(f"{tmp_dir}/updates")
