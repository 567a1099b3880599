"""Periodic re-scoring of all active tickets that touches only those whose score changes its bucket or status.

The breach probability of a ticket is piecewise linear in its age, so the time at which it next reaches a step of the
ladders has a closed form.  An index keeps, for every ticket that can still change, that time (a second early, so rounding never
makes it late) in slots of due time.  A tick reads the slots since the one before, scores the tickets due in them and writes
their next times; a ticket that is not due has the bucket and status it had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..functions.columns import ts_literal
from .scoring import sla_metrics

_STEPS = sorted({p for p, _ in R.BREACH_BUCKETS + R.SLA_STATUS})
#: Columns of a ticket that its score needs.
TICKET = ["ticket_id", "priority", "status", "category", "created_at"]
_SHOWN = ["breach_bucket", "sla_status"]


def next_change(scored: DataFrame, as_of: str) -> Column:
    """When a ticket scored at ``as_of`` (by ``sla_metrics``) next reaches a step, less a second, and after ``as_of``; null if
    it never does."""
    p, response, resolution = F.col("breach_probability"), F.col("response_threshold"), F.col("resolution_threshold")
    step = F.when(F.lit(False), F.lit(0.0))
    for s in _STEPS:
        step = step.when(p < s, F.lit(s))
    w = F.when(F.col("status") == "open", F.lit(0.7)).otherwise(F.lit(0.3))
    per_minute = w / response + (1.0 - w) / resolution
    # after the shorter threshold its part stays at its weight and only the other one grows
    response_first = response <= resolution
    full = F.when(response_first, w).otherwise(1.0 - w)
    then = F.when(response_first, (1.0 - w) / resolution).otherwise(w / response)
    early = step / per_minute
    age = F.when(early <= F.least(response, resolution), early).otherwise(F.least((step - full) / then, F.greatest(response, resolution)))
    at = F.col("created_at") + F.make_dt_interval(secs=(age * 60.0 - 1.0).cast("decimal(18,6)"))
    closed = F.coalesce(F.col("status").isin("resolved", "closed"), F.lit(False))
    return F.when(~closed & step.isNotNull(), F.greatest(at, ts_literal(as_of) + F.make_dt_interval(secs=F.lit("0.000001").cast("decimal(18,6)"))))


class RescoreIndex:
    """Tables under ``path``: ``due`` (tickets by run and slot of due time), ``touched`` (what each run has scored) and
    ``updates`` (tickets that came or changed after run 0, by run).  Runs are numbered; a retried run overwrites its own folders."""

    def __init__(self, spark: SparkSession, path: str, slot_minutes: int = 5):
        self.spark, self.path, self.slot_minutes = spark, path.rstrip("/"), slot_minutes

    def _slot(self, at: Column) -> Column:
        return F.floor(F.unix_seconds(at.cast("timestamp")) / (60 * self.slot_minutes))

    def _write(self, run: int, scored: DataFrame, as_of: str) -> DataFrame:
        """Store what a run has scored, then the next due times of these tickets; returns the stored rows."""
        folder = f"{self.path}/touched/run={run}"
        scored.select(*TICKET, "old_bucket", "old_status", "breach_probability", *_SHOWN, next_change(scored, as_of).alias("due_at")) \
            .write.mode("overwrite").parquet(folder)
        rows = self.spark.read.parquet(folder)
        due = rows.filter("due_at IS NOT NULL").select(*TICKET, *_SHOWN, "due_at", self._slot(F.col("due_at")).alias("slot"))
        # one writer per slot would meet a hot slot; AQE splits and joins these
        due.hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/due/run={run}")
        return rows

    def start(self, tickets: DataFrame, as_of: str) -> DataFrame:
        """Run 0: score all tickets.  Starting anew in a fresh folder, say once a day, also ends the growth of the tables."""
        return self._write(0, self._scored(tickets, as_of), as_of)

    def update(self, run: int, tickets: DataFrame, as_of: str) -> DataFrame:
        """Score tickets that are new or have changed.  Their entries of earlier runs no longer count."""
        rows = self._write(run, self._scored(tickets, as_of), as_of)
        rows.select("ticket_id").write.mode("overwrite").parquet(f"{self.path}/updates/run={run}")
        return rows

    @staticmethod
    def _scored(tickets: DataFrame, as_of: str) -> DataFrame:
        none = F.lit(None).cast("string")
        return sla_metrics(tickets.select(*TICKET), as_of).withColumns({"old_bucket": none, "old_status": none})

    def _read(self, name: str, fields: list) -> DataFrame:
        """A table that may have no file yet."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        schema = T.StructType(fields)
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def due(self, run: int, previous: str, now: str) -> DataFrame:
        """Tickets whose time lies after ``previous`` and not after ``now``, without entries that an update has replaced.
        Only the slots in between are read."""
        known = self.spark.read.parquet(f"{self.path}/touched").schema
        by_run = T.StructField("run", T.IntegerType())
        entries = self._read("due", [known[c] for c in [*TICKET, *_SHOWN, "due_at"]] + [by_run, T.StructField("slot", T.LongType())]).filter(
            F.col("slot").between(self._slot(ts_literal(previous)), self._slot(ts_literal(now)))
            & (F.col("due_at") > ts_literal(previous)) & (F.col("due_at") <= ts_literal(now)) & (F.col("run") < run))
        later = self._read("updates", [known["ticket_id"], by_run]).select(F.col("ticket_id").alias("_id"), F.col("run").alias("_run"))
        return entries.join(later, (F.col("ticket_id") == F.col("_id")) & (F.col("_run") > F.col("run")), "left_anti").drop("slot", "run")

    def tick(self, run: int, previous: str, now: str) -> DataFrame:
        """Score the tickets due since the tick at ``previous``; returns all that were touched, with old and new bucket and
        status.  A tick that was missed is made up for by the next one's longer interval."""
        due = self.due(run, previous, now).withColumnsRenamed({"breach_bucket": "old_bucket", "sla_status": "old_status"}).drop("due_at")
        return self._write(run, sla_metrics(due, now), now)

    def current(self) -> DataFrame:
        """Bucket and status of every ticket: those of the last run that touched it."""
        rows = self.spark.read.parquet(f"{self.path}/touched")
        return rows.groupBy("ticket_id").agg(F.max_by(F.struct("status", *_SHOWN), "run").alias("s")).select("ticket_id", "s.*")


def changes(touched: DataFrame) -> DataFrame:
    """Those of the touched tickets whose bucket or status has changed."""
    return touched.filter((F.col("old_bucket") != F.col("breach_bucket")) | (F.col("old_status") != F.col("sla_status")))
