"""Corpus pipeline: the stages a document passes on its way into a training set.

Every stage takes all that its predecessor kept and returns documents (all columns), except the last,
which returns them tokenized.  Each works on its own input only: the quality rules learn from, the
components are formed over, the ledger scans exactly the rows that come in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from servicelens.llm import bpe, decontaminate, quality, secrets, simhash
from servicelens.llm.common import scratch_table, table
from servicelens.llm.queries import public_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and wordless texts among them."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays (3-word shingles, 2 bits): the one with the smallest doc_id, of rows that
    repeat it one; all texts without words are one component."""
    return simhash.drop_near_duplicates(docs, shingle=3, radius=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window like a benchmark item go (5-word shingles, similarity 0.8); null and empty texts hold none."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"), shingle=5, min_similarity=0.8)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, as often as given; their secrets are masked and ``n_chars`` follows.  Null and empty texts have none."""
    return secrets.redact(docs, secrets.scratch_ledger(spark))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of ids and decoded bytes instead of the text; a null or empty one has no ids."""
    return bpe.tokenize(docs, public_bpe(spark))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("byte_level_bpe", byte_level_bpe),
]

#: XXH64 fingerprints, hashed n-gram ratios and BPE merges are not expressible in SQL; the tests
#: run the stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each result is written and read again as the next input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
