"""Mailboxes (A5, S8): mbox files read and written by Spark's own text source.

A message of an mbox file begins with a line ``From ...``.  Given ``\\nFrom `` as its line separator the text source splits
files of any size at messages, in batch and as a stream, on whatever file system Spark reads; parsing is a per-row
helper of the standard library in an Arrow batch function.
"""

from __future__ import annotations

import email
import email.policy
import email.utils
import re
from email.header import decode_header, make_header

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAIL_SCHEMA = T.StructType([
    T.StructField("message_id", T.StringType()), T.StructField("sender", T.StringType()), T.StructField("to", T.StringType()),
    T.StructField("subject", T.StringType()), T.StructField("received_at", T.TimestampType()), T.StructField("body", T.StringType())])
_SEPARATOR = "\nFrom "
_QUOTED = re.compile(rb"^>(>*From )", re.M)


def _header(msg, name: str) -> str | None:
    """A header as it stands, folded lines joined, encoded words decoded; null if it is absent."""
    raw = next((v for n, v in msg.raw_items() if n.lower() == name), None)
    if raw is None:
        return None
    raw = re.sub(r"\r?\n(?=[ \t])", "", raw)
    return str(make_header(decode_header(raw))) if "=?" in raw else raw


def _received(msg) -> pd.Timestamp | None:
    try:
        at = email.utils.parsedate_to_datetime(_header(msg, "date") or "")
    except (TypeError, ValueError):
        return None
    return pd.Timestamp(at).tz_localize("UTC") if at.tzinfo is None else pd.Timestamp(at).tz_convert("UTC")


def parse_message(text: str) -> tuple | None:
    """The fields of ``MAIL_SCHEMA`` of one message behind its ``From `` line; null if there is nothing.

    The body is the first text/plain part; of a plain message with a Content-Length no more than that many bytes, so
    that line ends which the file adds are not the body's."""
    data = text.encode()
    _, _, data = data.partition(b"\n")  # what is left of the line that began with "From "
    if not data.strip():
        return None
    msg = email.message_from_bytes(_QUOTED.sub(rb"\1", data), policy=email.policy.default)
    part = msg.get_body(preferencelist=("plain",))
    body = part.get_content() if part is not None else ""
    length = _header(msg, "content-length")
    if part is msg and length and length.strip().isdigit() and msg.get("Content-Transfer-Encoding", "8bit").lower() in ("7bit", "8bit", "binary"):
        body = body.encode()[:int(length)].decode(errors="replace")
    return (_header(msg, "message-id"), _header(msg, "from"), _header(msg, "to"), _header(msg, "subject"), _received(msg), body)


#: Messages that are parsed into one batch; more would hold several copies of every body at one time.
_SLICE = 256
_ARROW = pa.schema([("message_id", pa.string()), ("sender", pa.string()), ("to", pa.string()), ("subject", pa.string()),
                    ("received_at", pa.timestamp("us", "UTC")), ("body", pa.string())])


def _parse(batches):
    for whole in batches:
        for begin in range(0, whole.num_rows, _SLICE):
            rows = [r for r in map(parse_message, whole.column(0).slice(begin, _SLICE).to_pylist()) if r is not None]
            columns = zip(*rows) if rows else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def read_mbox(spark: SparkSession, path: str, stream: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """A5: the messages of all mbox files under ``path``, as a table or a stream of new files."""
    reader = (spark.readStream.schema("value string") if stream else spark.read).option("lineSep", _SEPARATOR)
    if stream and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.format("text").load(path).select("value").mapInArrow(_parse, MAIL_SCHEMA)


def _encoded_word(c: Column) -> Column:
    """A header value; one that is not plain ASCII as an encoded word."""
    return F.when(c.rlike(r"^[\x20-\x7E]*$"), c).otherwise(F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(c, "UTF-8")), F.lit("?=")))


def render(mails: DataFrame) -> DataFrame:
    """One message (``value``) per row of ``message_id``, ``sender``, ``subject``, ``received_at`` (timestamp), ``body``.  Bodies with control
    characters other than tab and line feed travel as base64, others as they are with ``From `` lines quoted."""
    body = F.coalesce("body", F.lit(""))
    plain = ~body.rlike(r"[\x00-\x08\x0B-\x1F\x7F\x85\x{2028}\x{2029}]")
    text = F.regexp_replace(body, r"(?m)^(>*From )", ">$1")
    date = F.date_format("received_at", "EEE, dd MMM yyyy HH:mm:ss")
    head = F.concat(
        F.lit("From MAILER "), F.date_format("received_at", "yyyy-MM-dd"), F.lit("\nMessage-ID: <"), F.col("message_id").cast("string"),
        F.lit("@mail.example.org>\nFrom: "), F.coalesce("sender", F.lit("")), F.lit("\nTo: desk@example.org\nSubject: "),
        _encoded_word(F.coalesce("subject", F.lit(""))), F.lit("\nDate: "), date, F.lit(" +0000\nMIME-Version: 1.0\n"
                                                                                       "Content-Type: text/plain; charset=utf-8\n"))
    return mails.select(F.when(plain, F.concat(
        head, F.lit("Content-Transfer-Encoding: 8bit\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\n\n"), text, F.lit("\n"))).otherwise(
        F.concat(head, F.lit("Content-Transfer-Encoding: base64\n\n"), F.base64(F.encode(body, "UTF-8")), F.lit("\n"))).alias("value"))


def write_mbox(mails: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A5's way back: one mbox file per partition."""
    render(mails).write.mode(mode).text(path)
