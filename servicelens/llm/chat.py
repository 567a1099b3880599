"""Chat formatting from event logs: reconstruct the final messages, then render them.

A log holds streamed deltas, edits and regenerations.  It is folded twice: first per message
(drafts that an edit or a regeneration replaced are dropped there, before anything is gathered by
conversation), then per conversation.  DataFrame functions only.

Rendering: ``### <role>: <text></turn>`` and a line feed per message.  Inside roles and texts the control
strings are escaped reversibly, so neither marker can occur in them: ``\\`` becomes ``\\\\``, the first
character of ``</turn>`` becomes ``\\l``, that of ``### `` becomes ``\\h``, and ``:`` in roles ``\\c``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

#: Event kinds; of one sequence number they apply in this order.
EVENTS = ["open", "regenerate", "edit", "delta"]
HEAD, END = "### ", "</turn>\n"
#: Longest text of a delta when stored messages are replayed as a log.
DELTA_CHARS = 512


def fold_messages(events: DataFrame) -> DataFrame:
    """Final messages of a log: ``conv_id``, ``msg``, ``seq`` (of the first event), ``role``, ``text``.

    ``events``: ``conv_id``, ``seq`` (any type that sorts), ``event`` (one of EVENTS), ``msg`` (message id in
    the conversation), ``role``, ``text``.  ``open`` starts a message (its text, if any, is the first
    part), ``delta`` appends, ``edit`` replaces all so far, ``regenerate`` discards all so far.  Events of
    equal ``seq`` apply in the order of EVENTS, then by text; repeated deltas count as often as
    given.  Null texts are empty, other event names are ignored, null ids are ids of their own."""
    rank = F.array_position(F.array(*[F.lit(e) for e in EVENTS]), F.col("event")).cast("int")
    log = events.select("conv_id", "msg", "role", F.struct(
        "seq", rank.alias("rank"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("e")).filter("e.rank > 0")
    grouped = log.groupBy("conv_id", "msg").agg(
        F.array_sort(F.collect_list("e")).alias("e"), F.min("e.seq").alias("seq"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("e.seq", "e.rank", "role"))).alias("role"))
    place = lambda x: F.struct(x["seq"], x["rank"])
    delta = EVENTS.index("delta") + 1
    resets = F.transform(F.filter("e", lambda x: x["rank"] < delta), place)
    live = let(F.array_max(resets), lambda last: F.filter("e", lambda x: last.isNull() | (place(x) >= last)))
    return grouped.select("conv_id", "msg", "seq", F.coalesce("role", F.lit("")).alias("role"),
                          F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("\\l/turn>"))
    return F.replace(out, F.lit("### "), F.lit("\\h## "))


def unescape(text: Column) -> Column:
    """Inverse of ``escape``.  Pairs of backslashes are taken out first, from the left."""
    part = lambda p: F.replace(F.replace(F.replace(
        p, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def render(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns``, ``formatted`` and ``loss_spans`` (start and length, in code points of
    ``formatted``, of every text of role assistant) per conversation.

    Messages come in the order of ``seq``, then role and text.  A conversation is one row, so it has
    to fit one; conversations of any number of rows are otherwise gathered like all others."""
    turn = F.struct("seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def shown(t: Column) -> Column:
        role = F.replace(escape(t["role"]), F.lit(":"), F.lit("\\c"))
        return F.struct(F.concat(F.lit(HEAD), role, F.lit(": ")).alias("head"), escape(t["text"]).alias("body"),
                        (t["role"] == "assistant").alias("loss"))

    spans = "struct<at:int,spans:array<struct<start:int,length:int>>>"

    def step(acc: Column, p: Column) -> Column:
        start, size = acc["at"] + F.length(p["head"]), F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len(END)).alias("at"),
                        F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")).cast(spans)

    pieces = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.inline(F.array(F.struct(
        F.transform("turns", shown).alias("pieces")))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")).cast(spans)
    return pieces.select(
        "conv_id", "n_turns",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("pieces", first, step, lambda acc: acc["spans"]).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a rendered conversation."""
    def turn(piece: Column) -> Column:
        rest = F.substring(piece, F.lit(len(HEAD) + 1), F.length(piece))
        return let(F.struct(rest.alias("rest"), F.substring_index(rest, ": ", 1).alias("role")), lambda x: F.struct(
            unescape(x["role"]).alias("role"),
            unescape(F.substring(x["rest"], F.length(x["role"]) + 3, F.length(x["rest"]))).alias("text")))

    pieces = F.split(formatted, END, -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of rendered conversations, taken from ``formatted`` and ``loss_spans`` alone; a conversation without assistant
    turns has the digest of nothing.  A row in, a row out; an empty table gives none."""
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    said = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"),
                        F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def as_events(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """Stored rows (``conv_id``, ``turn``, ``role``, ``text``) as the log that streamed them: ``open``, then deltas.

    Every row is a message of its own, also where rows repeat; a null or empty text is opened and gets no delta.  Null ids
    make one conversation; other columns are left out."""
    rows = conversations.select("conv_id", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                                F.monotonically_increasing_id().alias("msg"))
    count = F.ceil(F.length("text") / F.lit(delta_chars)).cast("int")
    part = F.explode(F.sequence(F.lit(0), count)).alias("part")
    parts = rows.select("conv_id", "turn", "role", "text", "msg", part)
    chunk = F.substring("text", (F.col("part") - 1) * delta_chars + 1, F.lit(delta_chars))
    return parts.select("conv_id", F.struct("turn", "part").alias("seq"),
                        F.when(F.col("part") == 0, "open").otherwise("delta").alias("event"), "msg", "role",
                        F.when(F.col("part") > 0, chunk).alias("text"))


def probe_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts imitate the markers."""
    text = "\\### Assistant: </turn> ok"
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
