"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed (SHA-256 of its UTF-8 bytes).  The ledger records which
rule versions have seen which blob and what they found; a scan reads only blobs that some current
rule version has not seen, once each however many paths share them, and appends its
findings.  Findings are then joined back to all paths.  DataFrame functions only.

Matches are leftmost and non-overlapping per rule; positions are code points, end exclusive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder
from .common import fresh, let, own, scratch_table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern``, and the least length of its ``group`` (others are dropped)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which spans of the same start are listed.
BASE_RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run that starts with AKIA, and a hex run, are taken whole: shorter ones can be left out by the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Well-known token shapes beside the base kinds.
RULES = BASE_RULES + [
    Rule("vendor", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
                   r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
]

_SPAN = "struct<start:int,rank:int,end:int,kind:string>"
_SPANS = f"array<{_SPAN}>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in ``text``.  The pieces between matches and the matches themselves give the
    positions; a text without a match costs one pass."""
    none = F.array().cast(_SPANS)

    def located(found: Column) -> Column:
        columns = [F.split(text, rule.pattern, -1).alias("piece"), found.alias("match")]
        if rule.group:
            columns.append(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part"))
        start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["piece"])
            end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
            wanted = F.length(x["part" if rule.group else "match"]) >= rule.least
            span = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"),
                                    F.lit(rule.kind).alias("kind"))).cast(_SPANS)
            return F.struct(end.alias("at"), F.when(wanted, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
                            ).cast(f"struct<at:int,spans:{_SPANS}>")

        return F.aggregate(F.arrays_zip(*columns), start.cast(f"struct<at:int,spans:{_SPANS}>"), step, lambda acc: acc["spans"])

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
               lambda found: F.when(F.size(found) == 0, none).otherwise(located(found)))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


class BlobLedger:
    """Findings by blob and rule version, one folder per scan under ``path`` (a shared folder).

    A scan's folder is written by one Spark job and counts once its success marker is there, so
    a scan that was cut off is simply done again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _scans(self) -> list[str]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        return [str(s.getPath()) for s in fs.listStatus(root) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]

    def read(self) -> DataFrame | None:
        """``blob``, ``rules`` (keys that scanned it), ``spans``; None before the first scan."""
        scans = self._scans()
        return self.spark.read.schema(f"blob binary, rules array<string>, spans {_SPANS}").parquet(*scans) if scans else None

    def scan(self, texts: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> None:
        """Scan the blobs of ``texts`` that a rule has not seen; append what they hold."""
        keys = F.array(*[F.lit(r.key) for r in rules])
        content = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        # equal contents are merged before and after the exchange, so a hot blob travels once per task
        blobs = content.groupBy(blob_of(F.col("text")).alias("blob")).agg(F.first("text").alias("text"))
        known = self.read()
        if known is None:
            todo = blobs.withColumn("rules", keys)
        else:
            seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
            todo = blobs.join(seen, "blob", "left").withColumn(
                "rules", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("rules") > 0)
        spans = F.concat(*[F.when(F.array_contains("rules", F.lit(r.key)), rule_spans(F.col("text"), r, i))
                           .otherwise(F.array().cast(_SPANS)) for i, r in enumerate(rules)])
        todo.select("blob", "rules", spans.alias("spans")).write.parquet(f"{self.path}/scan-{uuid.uuid4().hex}")

    def findings(self, rules: list[Rule] = RULES) -> DataFrame:
        """``blob`` and its sorted ``spans`` of the given rule versions, for blobs that have any."""
        rows = self.read()
        kinds = [F.lit(r.kind) for r in rules]
        wanted = F.array(*[F.lit(r.key) for r in rules])
        # a scan row holds kinds only of the rule versions that it lists
        mine = F.transform(F.array_intersect("rules", wanted), lambda k: F.substring_index(k, "@", 1))
        hits = rows.select("blob", F.filter("spans", lambda s: F.array_contains(mine, s["kind"])).alias("spans"))
        rank = F.array(*kinds)
        hits = hits.filter(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        return hits.select("blob", F.array_sort(F.transform("spans", lambda s: F.struct(
            s["start"].alias("start"), (F.array_position(rank, s["kind"]) - 1).cast("int").alias("rank"),
            s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"))


def scratch_ledger(spark: SparkSession) -> BlobLedger:
    """An empty ledger in the shared checkpoint folder."""
    return BlobLedger(spark, scratch_folder(spark, "llm-ledger"))


def find_secrets(docs: DataFrame, ledger: BlobLedger, rules: list[Rule] = RULES) -> DataFrame:
    """``doc_id`` and ``spans`` (start, rank, end, kind; sorted) of every row of ``docs``.

    Rows with equal texts share one scan; a null text is the empty blob (no spans); null ids and
    repeated rows come back as given; extra columns are ignored."""
    ledger.scan(docs, rules)
    found = scratch_table(ledger.findings(rules), "findings")
    paths = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    return paths.join(found, "blob", "left").select("doc_id", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the base kinds, and all spans, of every row of ``find_secrets``.

    A row without spans (null and empty texts among them) has zeros, the digest of nothing and an empty list; repeated rows
    come back as often as given."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [of_kind(r.kind) for r in BASE_RULES]
    return found.select("doc_id", *count, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, ledger: BlobLedger, rules: list[Rule] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every stretch of overlapping spans of ``text`` replaced by ``mark``; ``n_chars``, where
    there is one, counts the new text.  Rows without spans are unchanged, null and empty texts among them; rows come back as
    often as given, whatever other columns are called."""
    ledger.scan(docs, rules)
    found = scratch_table(ledger.findings(rules), "findings")
    blob, spans = fresh(docs, "__blob"), fresh(docs, "__spans")
    joined = docs.withColumn(blob, blob_of(F.col("text"))).join(
        found.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), blob, "left")
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    cleaned = F.aggregate(F.col(spans), start, step,
                          lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.col(spans).isNull(), text).otherwise(cleaned)
    out = joined.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*own(docs))
