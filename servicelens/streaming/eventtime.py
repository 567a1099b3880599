"""Stateful jobs in event time (S4 + S9, S7): what is emitted depends on the events' own times, not on the files or
micro-batches they came in.

Both processors hold what has arrived and act on it in order once the watermark has passed it.  State is in the state
store of the session (RocksDB), keyed by bucket of services or by alarm; timers are event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import DEFAULT_AS_OF
from ..functions.columns import breach_bucket, sla_status
from ..functions.rules import STATE_TTL_DAYS
from ..operators import alarms, ml, state
from ..operators.util import filter_computed
from .commits import BatchCommits
from .jobs import _checkpoint, _trigger

_DAY_US = 86_400_000_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(spark: SparkSession, writer, available_now: bool, interval: str) -> StreamingQuery:
    """Start with the RocksDB state store, which these processors need; a stream keeps the settings it was started with,
    so the session's own is put back at once."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return _trigger(writer, available_now, interval).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _ms_from(us: int) -> int:
    """First millisecond that is not before ``us`` microseconds."""
    return -(-us // 1000)


# ---------------------------------------------------------------------------
# S4 + S9: status events folded per service in (event time, id) order
# ---------------------------------------------------------------------------

FOLD_OUT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("service_id", T.LongType()), T.StructField("event_id", T.LongType()),
    T.StructField("detail_type", T.StringType()), T.StructField("at", T.LongType()), T.StructField("update_seq", T.LongType()),
    T.StructField("breach_probability", T.DoubleType()), T.StructField("response_remaining", T.DoubleType()),
    T.StructField("resolution_remaining", T.DoubleType())])
_NAMES = FOLD_OUT.names
_NOW = ["service_id", "p", "r", "q", "k", "at"]
_EVENT = ["service_id", "no_service", "event_id", "no_event", "at", "delta", "saved", "detail_type"]
#: Groups that services are dealt out to, and most rows of one entry of their state.
BUCKETS, _CHUNK = 64, 10_000


def _rows(kind: str, events: pd.DataFrame, **more) -> pd.DataFrame:
    out = pd.DataFrame({"kind": kind, "service_id": events["service_id"].astype("Int64").mask(events["no_service"].astype(bool)),
                        "event_id": events["event_id"].astype("Int64").mask(events["no_event"].astype(bool)),
                        "detail_type": events["detail_type"], "at": events["at"].astype("Int64")})
    for name in _NAMES[5:]:
        out[name] = more.get(name)
    out["update_seq"] = out["update_seq"].astype("Int64")
    return out[_NAMES]


def _hold(held, rows: pd.DataFrame) -> None:
    """Append ``rows`` to a list state, as Arrow batches of at most ``_CHUNK`` rows each."""
    for begin in range(0, len(rows), _CHUNK):
        batch = pa.RecordBatch.from_pandas(rows.iloc[begin:begin + _CHUNK], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        held.appendValue((sink.getvalue().to_pybytes(),))


def _held(held, names: list[str]) -> pd.DataFrame:
    parts = [pa.ipc.open_stream(bytes(x[0])).read_pandas() for x in held.get()]
    return pd.concat(parts, ignore_index=True)[names] if parts else pd.DataFrame(columns=names)


class ServiceFold(StatefulProcessor):
    """State of a bucket of services: their last versions (``now``, by service) and the events that the watermark has not
    passed (``waiting``).

    An event is late if the watermark has passed its time when it arrives, or if it has none.  Waiting events of a service
    apply in (time, id) order when the watermark passes them.  A version lives for ``ttl_us`` after its time: an event at or
    after that finds no state, and the store forgets the service once the watermark is there.

    A call of Python per service costs far more than what it does for a service's few events; so a call sees all
    services of a bucket, and state goes to the store in Arrow batches.  One timer stands for the first thing due
    in the bucket (``alarm``)."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getListState("now", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.alarm = handle.getValueState("alarm", "at bigint")

    def _wake(self, us: int) -> None:
        """The bucket's timer goes off at ``us`` at the latest."""
        at = _ms_from(us)
        if self.alarm.exists():
            before = self.alarm.get()[0]
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.alarm.update((at,))
        self.handle.registerTimer(at)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        _hold(self.now, initialState.assign(k=0)[_NOW])
        self._wake(int(initialState["at"].min()) + self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known, first = _held(self.now, _NOW)["service_id"], None
        for events in rows:
            late = events["at"].isna() | (events["at"] <= passed)
            if late.any():
                yield _rows("late", events[late])
            lost = ~late & (events["no_service"] | ~events["service_id"].isin(known))
            if lost.any():
                yield _rows("missing", events[lost])
            events = events[~(late | lost)]
            if events.empty:
                continue
            _hold(self.waiting, events[_EVENT].astype({"at": "int64"}))
            earliest = int(events["at"].min())
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.alarm.clear()
        now = _held(self.now, _NOW).sort_values("service_id", ignore_index=True)
        if now.empty:
            return
        held = _held(self.waiting, _EVENT)
        ready = (held["at"] <= passed).to_numpy(bool)
        due = held[ready].sort_values(["service_id", "at", "no_event", "event_id"], ignore_index=True)
        rest = held[~ready]
        ids = now["service_id"].to_numpy(np.int64)
        last = now["at"].to_numpy(np.int64).copy()
        p, r, q, k = (now[c].to_numpy(t).copy() for c, t in (("p", float), ("r", float), ("q", float), ("k", np.int64)))
        service, at = due["service_id"].to_numpy(np.int64), due["at"].to_numpy(np.int64)
        place = np.searchsorted(ids, service)  # every event that waits is of a service in ``now``
        starts = np.flatnonzero(np.concatenate([[True], service[1:] != service[:-1]])) if len(due) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(due)))
        before = np.roll(at, 1)
        before[starts] = last[place[starts]]
        over = np.cumsum(at >= before + self.ttl)
        alive = over == np.repeat(over[starts] - (at[starts] >= before[starts] + self.ttl), sizes)
        delta, saved = due["delta"].to_numpy(float), due["saved"].to_numpy(float)
        seq, ps, rs, qs = np.zeros(len(due), np.int64), *(np.zeros(len(due)) for _ in range(3))
        for a, n in zip(starts.tolist(), (np.add.reduceat(alive, starts, dtype=np.int64) if len(due) else starts).tolist()):
            if not n:
                continue
            i, b = place[a], a + n
            ps[a:b] = list(accumulate(delta[a:b].tolist(), lambda x, d: min(max(x + d, 0.0), 1.0), initial=float(p[i])))[1:]
            gained = np.cumsum(saved[a:b])
            rs[a:b], qs[a:b], seq[a:b] = r[i] + gained, q[i] + gained, np.arange(k[i] + 1, k[i] + n + 1)
            p[i], r[i], q[i], k[i], last[i] = ps[b - 1], rs[b - 1], qs[b - 1], k[i] + n, at[b - 1]
        # what waits is later than the watermark, so later than the end of what has expired
        ended = passed >= last + self.ttl
        ended[place[~alive]] = True
        stranded = rest["service_id"].isin(ids[ended]).to_numpy(bool)
        lost = pd.concat([due[~alive], rest[stranded]]) if stranded.any() or not alive.all() else due[:0]
        rest = rest[~stranded]
        stay = pd.DataFrame({"service_id": ids, "p": p, "r": r, "q": q, "k": k, "at": last})[~ended]
        if alive.any() or ended.any():
            self.now.clear()
            _hold(self.now, stay)
        if len(rest) < len(held):
            self.waiting.clear()
            _hold(self.waiting, rest)
        if len(stay):
            self._wake(min([int(stay["at"].min()) + self.ttl, *rest["at"].astype("int64").nsmallest(1).tolist()]))
        if alive.any():
            yield _rows("version", due[alive], update_seq=seq[alive], breach_probability=np.round(ps[alive], state.PROB_DECIMALS),
                        response_remaining=rs[alive], resolution_remaining=qs[alive])
        if ended.any():
            yield _rows("expired", pd.DataFrame({"service_id": ids[ended], "no_service": False, "event_id": 0, "no_event": False,
                                                 "detail_type": None, "at": last[ended] + self.ttl}))
        if len(lost):
            yield _rows("missing", lost)

    def close(self) -> None:
        pass


def _micros(ts) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def event_time_fold_stream(spark: SparkSession, source: str, initial_state: DataFrame, sink: str, event_schema: T.StructType,
                           delay: str = "10 minutes", ttl_days: float = STATE_TTL_DAYS, checkpoint: str | None = None,
                           available_now: bool = True, interval: str = "5 seconds",
                           max_files_per_trigger: int | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """S4 + S9 streaming in event time: parquet status events, in any order within ``delay``, on top of the latest prior
    states.

    The tables of ``sink`` (see ``BatchCommits``) are ``versions`` (one per applied event, as the batch fold makes them),
    ``late`` (events behind the watermark), ``missing`` (events of services without a live state) and ``expired``
    (services whose last version has outlived ``ttl_days``, with the time it did).  The last ``delay`` of events waits until
    something later arrives; unhandled event types move the watermark too.  ``buckets`` (groups of services that share a call
    and an entry of state) stays what it was when the checkpoint was begun."""
    reader = spark.readStream.schema(event_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = reader.parquet(source).withColumn("_at", F.col("event_ts").cast("timestamp")).withWatermark("_at", delay)
    # unhandled types move the watermark too, but a plain filter would be pushed below it.  Late events are told apart
    # by the processor, so the column that Spark would drop them by ends here
    deltas = state.event_deltas(events)
    bucket = F.pmod(F.xxhash64("service_id"), F.lit(buckets)).cast("int")
    steps = filter_computed(deltas, "handled", F.col("handled")).select(
        # without nulls, which would make pandas read ids as floating point
        bucket.alias("bucket"), F.coalesce("service_id", F.lit(0)).alias("service_id"), F.col("service_id").isNull().alias("no_service"),
        F.coalesce("event_id", F.lit(0)).alias("event_id"), F.col("event_id").isNull().alias("no_event"),
        F.unix_micros("_at").alias("at"), F.col("delta_p").alias("delta"), F.col("time_saved").cast("double").alias("saved"), "detail_type")
    first = state.latest_state(initial_state).filter("service_id IS NOT NULL").select(
        bucket.alias("bucket"), "service_id", F.col("breach_probability").alias("p"), F.col("response_remaining").alias("r"),
        F.col("resolution_remaining").alias("q"), _micros("version_ts").alias("at"))
    folded = steps.groupBy("bucket").transformWithStateInPandas(
        ServiceFold(int(ttl_days * _DAY_US)), FOLD_OUT, "append", "EventTime", initialState=first.groupBy("bucket"))

    def write(df: DataFrame, batch_id: int) -> None:
        rows = df.withColumn("event_ts", F.timestamp_micros("at").cast("timestamp_ntz")).persist()
        versions = rows.filter("kind = 'version'").select(
            "service_id", "event_id", "detail_type", F.col("event_ts").alias("version_ts"), "update_seq", "breach_probability",
            breach_bucket("breach_probability").alias("breach_bucket"), sla_status("breach_probability").alias("sla_status"),
            "response_remaining", "resolution_remaining")
        rejects = {k: rows.filter(F.col("kind") == k).select("service_id", "event_id", "detail_type", "event_ts") for k in ("late", "missing")}
        expired = rows.filter("kind = 'expired'").select("service_id", F.col("event_ts").alias("expired_at"))
        BatchCommits(df.sparkSession, sink).write(batch_id, {"versions": versions, **rejects, "expired": expired})
        rows.unpersist()

    w = folded.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", _checkpoint(spark, "event-fold", checkpoint))
    return _start(spark, w, available_now, interval)


# ---------------------------------------------------------------------------
# Alarm transitions while the stream runs
# ---------------------------------------------------------------------------

TRANSITION_OUT = T.StructType([T.StructField("alarm_name", T.StringType()), T.StructField("at", T.LongType()),
                               T.StructField("alarm_state", T.StringType())])
BASE_PERIOD = 300


class AlarmStates(StatefulProcessor):
    """State of an alarm: sums of the periods that are not over (``open``) and where it stands (``now``: start of the last
    period with data, breaching periods in a row, whether it is in alarm).

    A period counts once the watermark has passed its end.  A timer at the end of the period after the last one turns a
    period without data into the end of an alarm."""

    def __init__(self, definitions: dict[str, tuple]):
        self.definitions = definitions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start bigint", "total double, n bigint")
        self.now = handle.getValueState("now", "last bigint, run int, alarm boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        period = self.definitions[key[0]][0] * 1_000_000
        sums: dict[int, list] = {}
        for windows in rows:
            for start, total, n in zip(windows["start"].tolist(), windows["total"].tolist(), windows["n"].tolist()):
                s = sums.setdefault(start // period * period, [0.0, 0])
                s[0], s[1] = s[0] + total, s[1] + n
        for start, (total, n) in sums.items():
            if self.open.containsKey((start,)):
                old = self.open.getValue((start,))
                total, n = total + old[0], n + old[1]
            else:
                self.handle.registerTimer(_ms_from(start + period))
            self.open.updateValue((start,), (total, n))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seconds, statistic, needed, threshold, comparison = self.definitions[key[0]]
        period, passed = seconds * 1_000_000, timerValues.getCurrentWatermarkInMs() * 1000
        last, run, alarm = self.now.get() if self.now.exists() else (None, 0, False)
        over = sorted((s[0], v[0], v[1]) for s, v in self.open.iterator() if s[0] + period <= passed)
        found: list[tuple[int, str]] = []
        for start, total, n in over:
            if last is not None and start != last + period:
                if alarm:
                    found.append((last + period, "OK"))
                run, alarm = 0, False
            value = total if statistic == "Sum" or not n else total / n
            run = run + 1 if n and (value > threshold if comparison == ">" else value < threshold) else 0
            if (run >= needed) != alarm:
                alarm = run >= needed
                found.append((start, "ALARM" if alarm else "OK"))
            last = start
            self.open.removeKey((start,))
        if alarm and last + 2 * period <= passed:
            found.append((last + period, "OK"))
            run, alarm = 0, False
        if last is not None:
            self.now.update((last, min(run, needed), alarm))
            if alarm:
                self.handle.registerTimer(_ms_from(last + 2 * period))
        if found:
            yield pd.DataFrame({"alarm_name": key[0], "at": [a for a, _ in found], "alarm_state": [s for _, s in found]})

    def close(self) -> None:
        pass


def alarm_transition_stream(spark: SparkSession, source: str, sink: str, schema: T.StructType, definitions=alarms.ALARMS,
                            delay: str = "10 minutes", checkpoint: str | None = None, available_now: bool = True,
                            interval: str = "5 seconds", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Metric points -> sums of five-minute windows -> transitions of every alarm, each emitted once, in one query
    of two stateful steps.

    Longer periods (multiples of five minutes) are added up from the windows.  Table ``transitions`` of ``sink``:
    ``alarm_name``, ``window_start`` (of the first period of the new state), ``alarm_state``; an alarm begins in OK.  Points behind
    the watermark are not counted (Spark drops them before the windows)."""
    if any(a[2] % BASE_PERIOD for a in definitions):
        raise ValueError(f"periods must be multiples of {BASE_PERIOD} seconds")
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    points = reader.parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    w = F.window("ts", f"{BASE_PERIOD} seconds")
    windows = points.groupBy("metric", w.alias("w")).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.count("value").alias("n"))
    names = spark.createDataFrame([(a[0], a[1]) for a in definitions], "alarm_name string, metric string")
    rows = windows.join(F.broadcast(names), "metric").select(
        "alarm_name", F.window_time("w").alias("_time"), F.unix_micros("w.start").alias("start"), "total", "n")
    found = rows.groupBy("alarm_name").transformWithStateInPandas(
        AlarmStates({a[0]: a[2:] for a in definitions}), TRANSITION_OUT, "append", "EventTime")

    def write(df: DataFrame, batch_id: int) -> None:
        out = df.select("alarm_name", F.timestamp_micros("at").cast("timestamp_ntz").alias("window_start"), "alarm_state")
        BatchCommits(df.sparkSession, sink).write(batch_id, {"transitions": out})

    q = found.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", _checkpoint(spark, "alarms", checkpoint))
    return _start(spark, q, available_now, interval)


# ---------------------------------------------------------------------------
# M3: accuracy of predictions against outcomes that come later
# ---------------------------------------------------------------------------

def drift_stream(spark: SparkSession, predictions: str, outcomes: str, sink: str, prediction_schema: T.StructType,
                 outcome_schema: T.StructType, horizon_hours: int = 48, delay: str = "1 hour", min_accuracy: float = 0.8,
                 every_days: int = 7, trained_at: str = DEFAULT_AS_OF, checkpoint: str | None = None, available_now: bool = True,
                 interval: str = "30 seconds", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """M3 while the stream runs: predictions (``ticket_id``, ``created_at``, ``model_probability``) joined to the outcomes
    (``ticket_id``, ``known_at``, ``breached``) that become known within ``horizon_hours``, both under a watermark; then the
    accuracy of each day of predictions, and whether to retrain.

    The join is outer: a prediction whose outcome does not come in time counts as ``open`` once the watermark has passed
    its horizon, and a day is emitted once, when none of its predictions can get an outcome any more.  Table ``days``
    of ``sink``: ``day``, ``accuracy`` (null without outcomes), ``scored``, ``open``, ``drift``, ``retrain``."""
    def stream(path: str, schema: T.StructType, ts: str) -> DataFrame:
        reader = spark.readStream.schema(schema)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)

    p = stream(predictions, prediction_schema, "created_at").alias("p")
    o = stream(outcomes, outcome_schema, "known_at").alias("o")
    in_time = F.expr(f"p.ticket_id = o.ticket_id AND known_at >= created_at AND known_at <= created_at + INTERVAL {horizon_hours} HOURS")
    joined = p.join(o, in_time, "left_outer")
    right = F.when(F.col("breached").isNotNull(), ((F.col("model_probability") >= 0.5) == F.col("breached")).cast("double"))
    days = joined.groupBy(F.window("created_at", "1 day").alias("w")).agg(
        F.avg(right).alias("accuracy"), F.count("breached").alias("scored"), F.count_if(F.col("breached").isNull()).alias("open"))
    shown = days.select(F.to_date("w.start").alias("day"), "accuracy", "scored", "open")

    def write(df: DataFrame, batch_id: int) -> None:
        BatchCommits(df.sparkSession, sink).write(batch_id, {"days": ml.drift_flags(df, min_accuracy, every_days, trained_at)})

    w = shown.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", _checkpoint(spark, "drift", checkpoint))
    return _start(spark, w, available_now, interval)
