"""Ticket store operations (B27, B28, F5) as DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_tickets(df: DataFrame, status: str | None = None, priority: int | None = None) -> DataFrame:
    """Optional equality filters (pushed into the parquet scan by Catalyst)."""
    if status is not None:
        df = df.filter(F.col("status") == status)
    if priority is not None:
        df = df.filter(F.col("priority") == priority)
    return df


def get_ticket(df: DataFrame, ticket_id: str) -> DataFrame:
    return df.filter(F.col("ticket_id") == ticket_id)


def newest(df: DataFrame, k: int = 50, ts: str = "created_at", key: str = "ticket_id") -> DataFrame:
    """newest-first, keep the last ``k`` (a top-k: per-partition top-k then merge)."""
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(k)


def patch_tickets(df: DataFrame, patches: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Set the patched fields; the key never changes.  Patches are joined on the
    key (a shuffle join at scale: patch tables are not assumed small).

    A patch row sets the fields listed in its array column ``set_fields``, also to NULL; without
    that column it sets the fields that are not NULL."""
    fields = [c for c in patches.columns if c not in (key, "set_fields")]
    listed = "set_fields" in patches.columns
    sets = {c: F.array_contains("set_fields", c) if listed else F.col(c).isNotNull() for c in fields}
    p = patches.select(key, *[F.struct(sets[c].alias("set"), F.col(c).alias("value")).alias(f"_patch_{c}") for c in fields])
    out = df.join(p, key, "left")
    for c in fields:
        old = F.col(c) if c in df.columns else F.lit(None)
        out = out.withColumn(c, F.when(F.col(f"_patch_{c}.set"), F.col(f"_patch_{c}.value")).otherwise(old))
    return out.drop(*[f"_patch_{c}" for c in fields])


def join_events_to_tickets(events: DataFrame, tickets: DataFrame, key: str = "ticket_id") -> tuple[DataFrame, DataFrame]:
    """Events joined to their ticket (inner; a shuffle join, both sides grow with the
    data) and the events whose ticket is missing (left anti join) as rejects."""
    t = tickets.select(key, *[c for c in tickets.columns if c != key])
    return events.join(t, key, "inner"), events.join(t.select(key), key, "left_anti")
