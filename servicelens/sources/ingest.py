"""Sources and sinks (A1-A13): decoders for raw JSON records, typed imports, the
partitioned lake layout, and MIME e-mail files.

Decoders are ``from_json`` with explicit schemas (no inference), so they run as
narrow projections and work the same on a static table or a stream.  Rows that do
not decode are returned separately (quarantine) instead of failing the job.
"""

from __future__ import annotations

import email
import email.policy

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ts_literal
from ..operators.util import computed_once as parsed_once

# typed attribute of a key-value change record: {"S": "..."} or {"N": "..."}
_ATTR = T.StructType([T.StructField("S", T.StringType()), T.StructField("N", T.StringType())])
CHANGE_RECORD_SCHEMA = T.StructType([
    T.StructField("eventName", T.StringType()),
    T.StructField("dynamodb", T.StructType([
        T.StructField("NewImage", T.MapType(T.StringType(), _ATTR)),
        T.StructField("OldImage", T.MapType(T.StringType(), _ATTR)),
    ])),
])

TICKET_JSON_SCHEMA = T.StructType([
    T.StructField("ticket_id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("priority", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("assigned_to", T.StringType()), T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def _iso_ts(c: Column) -> Column:
    """ISO-8601 text (with or without fraction) -> TIMESTAMP_NTZ; NULL when unparseable."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
                      F.try_to_timestamp(c, F.lit(TS_FORMAT)),
                      F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz")


def _ticket_defaults(priority: Column, status: Column, category: Column) -> list[Column]:
    """Defaults when the key is absent: priority 3, status open, category general.
    A present value is kept as is (also an empty string)."""
    return [F.coalesce(priority.try_cast("int"), F.lit(3)).alias("priority"),
            F.coalesce(status, F.lit("open")).alias("status"),
            F.coalesce(category, F.lit("general")).alias("category")]


def decode_change_feed(raw: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """A1: keep INSERT / MODIFY, unwrap the typed NewImage attributes, apply defaults.
    Returns (tickets, rejects) — rejects are REMOVE events and records that do not parse."""
    rec = parsed_once(raw, _r=F.from_json(F.col(col), CHANGE_RECORD_SCHEMA))
    img = F.col("_r.dynamodb.NewImage")
    a = lambda k: F.coalesce(img[k]["S"], img[k]["N"])
    ok = F.col("_r.eventName").isin("INSERT", "MODIFY") & img.isNotNull()
    tickets = rec.filter(ok).select(
        a("ticket_id").alias("ticket_id"), a("title").alias("title"), a("description").alias("description"),
        *_ticket_defaults(a("priority"), a("status"), a("category")),
        _iso_ts(a("created_at")).alias("created_at"))
    return tickets, rec.filter(~F.coalesce(ok, F.lit(False))).drop("_r")


def decode_queue_json(raw: DataFrame, col: str = "body") -> tuple[DataFrame, DataFrame]:
    """A2: message body is JSON; use its ``ticket`` object when present, else the whole
    body.  Bodies that are not JSON objects go to the rejects output."""
    wrapped = T.StructType([T.StructField("ticket", TICKET_JSON_SCHEMA)])
    body = F.col(col)
    inner = F.from_json(body, wrapped)["ticket"]
    bare = F.from_json(body, TICKET_JSON_SCHEMA)
    valid = F.get_json_object(body, "$").isNotNull() & F.ltrim(F.translate(body, "\t\n\r", "   ")).startswith("{")
    p = parsed_once(raw, _valid=valid, _inner=inner, _bare=bare)
    t = F.when(F.col("_inner").isNotNull(), F.col("_inner")).otherwise(F.col("_bare"))
    decoded = p.filter(F.col("_valid")).withColumn("_t", t).select(
        "_t.ticket_id", "_t.title", "_t.description",
        *_ticket_defaults(F.col("_t.priority"), F.col("_t.status"), F.col("_t.category")),
        _iso_ts(F.col("_t.created_at")).alias("created_at"))
    return decoded, p.filter(~F.coalesce(F.col("_valid"), F.lit(False))).drop("_valid", "_inner", "_bare")


# FIXED VALUES — fields of every bus detail type, and what a field is where the detail leaves it out
BUS_DETAILS = {
    "L1 Task Completion": ("ticket_id string, status string, execution_time long, sla_impact string",
                           {"status": "completed", "execution_time": 0, "sla_impact": "positive"}),
    "L1 Task Started": ("ticket_id string, task_type string, estimated_duration int",
                        {"task_type": "unknown", "estimated_duration": 5}),
    "L1 Task Failed": ("ticket_id string, failure_reason string, retry_recommended boolean",
                       {"failure_reason": "unknown", "retry_recommended": False}),
    "Optimization Impact Assessment": ("optimization_id string, affected_services array<string>, impact_level string",
                                       {"optimization_id": "", "affected_services": [], "impact_level": "low"}),
    "License Change Completed": ("affected_services array<string>, change_type string, success boolean",
                                 {"change_type": "unknown", "success": True}),
    "Metric Update": ("ticket_id string, priority int, status string, category string, breach_probability double, "
                      "response_remaining_minutes double, resolution_remaining_minutes double",
                      {"ticket_id": "", "priority": 3, "status": "open", "category": "general", "breach_probability": 0.0,
                       "response_remaining_minutes": 0.0, "resolution_remaining_minutes": 0.0}),
    "SLA Breach Prediction": ("ticket_id string, breach_probability double, confidence double, time_to_breach int, "
                              "recommended_actions array<string>, priority_boost boolean, category string, current_priority int",
                              {"ticket_id": "", "breach_probability": 0.0, "confidence": 0.0, "time_to_breach": 60,
                               "recommended_actions": [], "priority_boost": False, "category": "general", "current_priority": 3}),
    "Optimization Recommendation": ("optimization_id string, optimization_type string, affected_assets array<string>, "
                                    "potential_savings double, proposed_changes array<string>",
                                    {"optimization_id": "", "optimization_type": "", "affected_assets": [],
                                     "potential_savings": 0.0, "proposed_changes": []}),
    "License Change Request": ("change_id string, change_type string, affected_services array<string>, license_details map<string,string>",
                               {"change_id": "", "change_type": "", "affected_services": []}),
}
ENVELOPE_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("detail-type", T.StringType()),
    T.StructField("detail", T.StringType())])


def _typed_detail(text: Column, detail_type: str) -> list[Column]:
    """The fields of a detail's JSON text, with the defaults of its type."""
    ddl, defaults = BUS_DETAILS[detail_type]
    schema = T.StructType.fromDDL(ddl)
    parsed = F.from_json(text, schema)

    def default(field: T.StructField) -> Column:
        value = defaults[field.name]
        return (F.array() if value == [] else F.lit(value)).cast(field.dataType)

    return [(F.coalesce(parsed[f.name], default(f)) if f.name in defaults else parsed[f.name]).alias(f.name) for f in schema]


def decode_bus_event(raw: DataFrame, detail_type: str, col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """A3: ``source`` and the fields of the envelopes of one detail type, with its defaults (and the columns ``keep``).
    The detail is kept as raw JSON text by the envelope schema, then typed."""
    if detail_type not in BUS_DETAILS:
        raise ValueError(f"no handler for detail type {detail_type!r}")
    env = parsed_once(raw, _e=F.from_json(F.col(col), ENVELOPE_SCHEMA), _text=F.get_json_object(F.col(col), "$.detail"))
    d = env.filter(F.col("_e.detail-type") == detail_type)
    return d.select(*(keep or []), F.col("_e.source").alias("source"), *_typed_detail(F.col("_text"), detail_type))


def typed_details(raw: DataFrame, col: str = "value") -> DataFrame:
    """A3 for all detail types in one pass: ``raw`` with ``source``, ``detail_type`` and ``details``, a struct with one field per
    type of ``BUS_DETAILS``; only the one of the row's own type is parsed and not null."""
    env = parsed_once(raw, _e=F.from_json(F.col(col), ENVELOPE_SCHEMA), _text=F.get_json_object(F.col(col), "$.detail"))
    known = env.select("*", F.col("_e.source").alias("source"), F.col("_e.detail-type").alias("detail_type")) \
        .filter(F.col("detail_type").isin(*BUS_DETAILS))
    # a branch that is not taken parses nothing
    details = F.struct(*[F.when(F.col("detail_type") == kind, _struct_of(F.col("_text"), kind)).alias(kind) for kind in BUS_DETAILS])
    return known.select(*raw.columns, "source", "detail_type", details.alias("details"))


def _struct_of(text: Column, detail_type: str) -> Column:
    """The typed fields of one detail, its text parsed once."""
    ddl, defaults = BUS_DETAILS[detail_type]
    schema = T.StructType.fromDDL(ddl)

    def filled(d: Column) -> Column:
        return F.struct(*[(F.coalesce(d[f.name], (F.array() if defaults[f.name] == [] else F.lit(defaults[f.name])).cast(f.dataType))
                           if f.name in defaults else d[f.name]).alias(f.name) for f in schema])
    return F.transform(F.array(F.from_json(text, schema)), filled)[0]


def bus_rejects(raw: DataFrame, col: str = "value") -> DataFrame:
    """A3: envelopes that do not parse, or whose detail type has no handler."""
    env = parsed_once(raw, _type=F.from_json(F.col(col), ENVELOPE_SCHEMA)["detail-type"])
    return env.filter(~F.coalesce(F.col("_type").isin(*BUS_DETAILS), F.lit(False))).withColumnRenamed("_type", "detail_type")


def unify_shapes(raw: DataFrame, col: str = "value") -> DataFrame:
    """A4: three envelope shapes — queue batch ({"Records": [{"body": ...}]}), bus
    event ({"detail": {...}}) and a bare ticket — as one ticket table.  Each shape is
    one pass over the input: every envelope becomes a list of ticket texts (the record
    bodies, the detail, or the value itself), exploded and parsed once."""
    v = F.col(col)
    _v = F.col("_v")
    g = parsed_once(raw.select(v.alias("_v")), _recs=F.get_json_object(_v, "$.Records"),
                    _detail=F.get_json_object(_v, "$.detail"))
    bodies = (F.when(F.col("_recs").isNotNull(),
                     F.from_json("_recs", T.ArrayType(T.StructType([T.StructField("body", T.StringType())])))
                     .getField("body"))
              .when(F.col("_detail").isNotNull(), F.array(F.col("_detail")))
              .otherwise(F.array(F.col("_v"))))
    # posexplode_outer + pos filter: keeps null elements, drops only empty / unparsed
    # record lists, and (unlike explode) adds no inferred size filter below the parse
    u = (g.select(F.posexplode_outer(bodies).alias("_pos", "_body")).filter(F.col("_pos").isNotNull())
         .select(F.from_json("_body", TICKET_JSON_SCHEMA).alias("_t")))
    return u.select("_t.ticket_id", *_ticket_defaults(F.col("_t.priority"), F.col("_t.status"),
                                                      F.col("_t.category")),
                    _iso_ts(F.col("_t.created_at")).alias("created_at"))


def typed_projection(raw: DataFrame, decimals: list[str], dates: dict[str, str]) -> DataFrame:
    """String columns cast to DECIMAL(18,4) and parsed as timestamps with the
    given pattern; bad values become NULL (``try_cast`` / ``try_to_timestamp``)."""
    out = raw
    for c in decimals:
        out = out.withColumn(c, F.col(c).try_cast("decimal(18,4)"))
    for c, fmt in dates.items():
        out = out.withColumn(c, F.try_to_timestamp(F.col(c), F.lit(fmt)).cast("timestamp_ntz"))
    return out


# ---------------------------------------------------------------------------
# Lake layout (A6-A9) — paths come from the caller (a shared folder on a cluster)
# ---------------------------------------------------------------------------

def with_ingest_partitions(df: DataFrame, ts: str, as_of: str | None = None) -> DataFrame:
    """Year / month / day partition columns (and the ingestion time)."""
    t = F.col(ts)
    out = df.withColumn("year", F.year(t)).withColumn("month", F.month(t)).withColumn("day", F.dayofmonth(t))
    if as_of is not None:
        out = out.withColumn("ingested_at", ts_literal(as_of))
    return out


def write_lake_partitioned(df: DataFrame, path: str, fmt: str = "json", mode: str = "append") -> None:
    """Partitioned write (json+gzip like the analytics tables, or parquet).  Rows are
    clustered by partition first so each task writes few files; ``rebalance`` (not a
    plain repartition) lets AQE split a hot day over several tasks and files instead of
    writing a third of the data from one task."""
    w = df.hint("rebalance", "year", "month", "day").write.mode(mode).partitionBy("year", "month", "day")
    if fmt == "json":
        w.option("compression", "gzip").json(path)
    else:
        w.parquet(path)


def read_lake(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """Scan with an explicit schema; year/month/day are discovered as partition
    columns, so filters on them prune directories."""
    part = T.StructType(list(schema.fields) + [T.StructField("year", T.IntegerType()),
                                                T.StructField("month", T.IntegerType()),
                                                T.StructField("day", T.IntegerType())])
    return spark.read.schema(part).format(fmt).load(path)


def read_csv_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headered CSV with a declared schema."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def append_sla_state(scored: DataFrame, path: str, as_of: str, key: str = "ticket_id") -> DataFrame:
    """New state version rows (bucket, version time, expiry +90 days), appended."""
    from ..operators.state import versioned
    rows = versioned(scored.withColumn("service_id", F.col(key)), as_of)
    rows.write.mode("append").parquet(path)
    return rows


def emit_events(df: DataFrame, detail_type: str, source: str, detail_cols: list[str]) -> DataFrame:
    """A10: typed JSON detail per row in the bus envelope."""
    return df.select(F.lit(source).alias("source"), F.lit(detail_type).alias("detail_type"),
                     F.to_json(F.struct(*detail_cols)).alias("detail"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp)."""
    from ..session import scratch_folder
    return scratch_folder(spark, name)


# ---------------------------------------------------------------------------
# MIME e-mail files (A5)
# ---------------------------------------------------------------------------

EMAIL_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("message_id", T.StringType()),
    T.StructField("sender", T.StringType()), T.StructField("to", T.StringType()),
    T.StructField("subject", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("body", T.StringType())])


def _parse_mime(batches):
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            msg = email.message_from_bytes(bytes(content), policy=email.policy.default)
            part = msg.get_body(preferencelist=("plain",))
            body = part.get_content() if part is not None else ""
            rows.append((path, msg.get("Message-ID"), msg.get("From"), msg.get("To"), msg.get("Subject"),
                         msg.get("Date"), body))
        yield pd.DataFrame(rows, columns=[f.name for f in EMAIL_SCHEMA.fields])


def read_emails(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """A5: a folder of MIME files -> headers and the first text/plain part.  Files are
    read as binary by Spark (split across tasks); each task parses its files with the
    standard library in an Arrow batch function."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return raw.mapInPandas(_parse_mime, EMAIL_SCHEMA)
