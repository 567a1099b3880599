"""Registered queries of the operators: ``opN_<name>(spark, sf_dir)`` and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (alignment, bpe, chat, compact, decontaminate, html, lm, packing, quality, resampling, secrets, simhash,
               suffixes)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more of which another document has a near copy (5-word shingles, 0.8)."""
    return compact.near_duplicate_passages(table(spark, sf_dir, "documents"), min_words=50, min_similarity=0.8)


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_main_text(table(spark, sf_dir, "pages"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, log-likelihood ratio against the documents labelled good, and verdict."""
    docs = table(spark, sf_dir, "documents")
    return quality.quality_verdicts(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (3-word shingles, at most 2 bits)."""
    return simhash.simhash_near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, replayed as logs, folded, rendered and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    log = chat.as_events(rows.unionByName(chat.probe_conversation(spark)))
    return chat.read_back(chat.render(chat.fold_messages(log)))


ORACLE["op5_chat_formatting"] = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), shown AS (
  SELECT *, replace(replace(replace(text, '\\', '\\\\'), '</turn>', '\\l/turn>'), '### ', '\\h## ') AS body,
         replace(replace(replace(replace(role, '\\', '\\\\'), '</turn>', '\\l/turn>'), '### ', '\\h## '), ':', '\\c') AS who
  FROM rows
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length('### ' || who || ': ' || body || '</turn>' || chr(10))) AS formatted_chars
  FROM shown GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM chats
"""


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and log-bilinear scores of every document, learnt from those that are not held out."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that another document has word for word."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"), min_words=50)


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with a window of similarity 0.8 or more (5-word shingles)."""
    return decontaminate.benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                         shingle=5, min_similarity=0.8)


def public_bpe(spark: SparkSession):
    return bpe.broadcast_bpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_bpe(spark))


@query
def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document through a ledger that starts empty."""
    return secrets.secret_digests(secrets.find_secrets(table(spark, sf_dir, "documents"), secrets.scratch_ledger(spark)))


def _kind_sql(rank: int, rule: secrets.Rule) -> str:
    """Spans of one rule, from the pieces between its matches."""
    q = "'" + rule.pattern.replace("'", "''") + "'"
    long = f"length(part[i]) >= {rule.least}"
    return f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(found) + 1), lambda i: {{
      'ok': {long}, 'start': list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0),
      'size': length(found[i])}}), lambda m: m.ok)) AS m
  FROM (SELECT doc_id, string_split_regex(t, {q}) AS pieces, regexp_extract_all(t, {q}, 0) AS found, regexp_extract_all(t, {q}, {rule.group}) AS part FROM d)"""


ORACLE["op10_secret_scans"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_kind_sql(i, r) for i, r in enumerate(secrets.RULES))}
),
s AS (SELECT doc_id, rank, kind, CAST(m.start AS BIGINT) AS start, kind || ':' || CAST(m.start AS BIGINT) || ':' || CAST(m.start + m.size AS BIGINT) AS span FROM m),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(secrets.BASE_RULES)}) AS base,
    string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document towards the benchmark texts, and the ranks of the tenth that is drawn."""
    resampled = resampling.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10)
    return resampling.resampling_digests(resampled)


#: CRC-32 goes byte by byte through its 256-entry table, once for every distinct word.
ORACLE["op11_importance_resampling"] = """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), steps AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), held AS (SELECT doc_id, unnest(w) AS w FROM cut),
known AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM held UNION SELECT w FROM wanted)),
crc(w, h, pos, c) AS (
  SELECT w, h, 1, CAST(4294967295 AS BIGINT) FROM known
  UNION ALL
  SELECT w, h, pos + 2, xor(c >> 8, tab[CAST(xor(c & 255, CAST('0x' || substr(h, pos, 2) AS BIGINT)) AS INT) + 1]) FROM crc, steps WHERE pos < length(h)
), place AS (SELECT w, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE pos > length(h)),
s AS (SELECT bucket, count(*) AS n FROM held JOIN place USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN place USING (w) GROUP BY bucket),
gain AS (
  SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000.0::DOUBLE)
      / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000.0::DOUBLE)))) AS BIGINT) AS g
  FROM (SELECT DISTINCT bucket FROM place) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), sums AS (SELECT doc_id, sum(g) AS weight FROM held JOIN place USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM cut LEFT JOIN sums USING (doc_id)
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CAST(r AS BIGINT) AS rank
FROM scored LEFT JOIN (SELECT * FROM drawn WHERE r <= 10 * n // 100) USING (doc_id)
"""


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two public vocabularies over every document."""
    return alignment.alignment_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                       public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2,048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end=0,
                                  by_words=True)
