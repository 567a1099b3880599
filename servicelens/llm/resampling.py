"""Importance resampling towards a target distribution.

The pre-tokenizer of the ``tokenizers`` library, an untrained ``Split`` by a word pattern, cuts every whole
ASCII-lowered text into words with offsets.  A window over the offset pairs is a feature; the CRC-32 of its words names
its bucket.  Bucket histograms of the raw corpus and of the target give every bucket a gain, and the sum of the gains
of a document's features, plus Gumbel noise from a hash of its id, orders the draw without replacement.

Texts are read once: the buckets of every document (two bytes a feature) are written, and both the histogram and the sums
come from that table.  What reaches the driver is one row per bucket.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.util import global_rank
from .common import forget, own, scratch_table
from .subwords import Recent, portions

#: Characters of a text that the pre-tokenizer is given at once; a block ends where a word ends.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Features:
    """Runs of 1 to ``longest`` words, one space between them, in ``buckets`` buckets.

    ``word`` is a class of characters; a word is a longest run of them."""

    word: str = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
    longest: int = 1
    buckets: int = 10_000

    def __post_init__(self):
        if not (self.longest >= 1 and 1 <= self.buckets <= 1 << 32):
            raise ValueError("longest must be 1 or more, buckets 1 to 2**32")

    @property
    def code(self) -> np.dtype:
        return np.dtype("<u2" if self.buckets <= 1 << 16 else "<u4")


class Hasher:
    """Buckets of the features of a text."""

    def __init__(self, features: Features):
        from tokenizers import Regex, pre_tokenizers
        self.features = features
        self.split = pre_tokenizers.Split(Regex(f"{features.word}+"), "removed", invert=True).pre_tokenize_str
        self.gap = re.compile(f"(?!{features.word})[\\s\\S]")
        self.gaps = re.compile(f"(?:(?!{features.word})[\\s\\S])+")
        self.bucket = Recent(lambda feature: zlib.crc32(feature.encode()) % features.buckets)

    def _blocks(self, text: str) -> Iterator[tuple[int, str]]:
        begin = 0
        while len(text) - begin > BLOCK:
            cut = self.gap.search(text, begin + BLOCK)
            if cut is None:
                break
            yield begin, text[begin:cut.start()]
            begin = cut.start()
        yield begin, text[begin:] if begin else text

    def run(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every feature."""
        lowered = text.lower() if text.isascii() else text.encode().lower().decode()
        n, out, held = 0, [], []
        for begin, block in self._blocks(lowered):
            words = self.split(block)
            n += len(words)
            out.append(np.fromiter((self.bucket[w] for w, _ in words), self.features.code, len(words)))
            if self.features.longest > 1:
                pairs = held + [(s + begin, e + begin) for _, (s, e) in words]
                out.append(self._windows(lowered, pairs, len(held)))
                held = pairs[1 - self.features.longest:]
        return n, np.concatenate(out)

    def _windows(self, text: str, pairs: list[tuple[int, int]], old: int) -> np.ndarray:
        """Buckets of the runs of two words or more that end at a pair from ``old`` on."""
        found = []
        for size in range(2, self.features.longest + 1):
            for i in range(max(old, size - 1), len(pairs)):
                window = text[pairs[i - size + 1][0]:pairs[i][1]]
                found.append(zlib.crc32(self.gaps.sub(" ", window).encode()) % self.features.buckets)
        return np.array(found, self.features.code)


def bucketed(docs: DataFrame, features: Features = Features(), text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``buckets`` (packed, one code a feature) in place of ``text``."""
    at = docs.columns.index(text)
    rest = [f for f in docs.schema.fields if f.name != text]
    made = [T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("buckets", T.BinaryType())]

    def run(batches):
        hasher = Hasher(features)
        for whole in batches:
            for batch in portions(whole, at):
                found = [hasher.run(t or "") for t in batch.column(at).to_pylist()]
                columns = [c for i, c in enumerate(batch.columns) if i != at]
                names = [f.name for f in rest] + [f.name for f in made]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()),
                     pa.array([b.tobytes() for _, b in found], pa.binary())], names=names)

    return docs.mapInArrow(run, T.StructType(rest + made))


def histogram(buckets: DataFrame, features: Features) -> DataFrame:
    """``bucket``, ``n`` over all rows of a ``buckets`` column; a task sends one row per bucket at most."""
    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                seen = np.bincount(np.frombuffer(data, features.code))
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[:len(seen)] += seen
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return buckets.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, features: Features) -> np.ndarray:
    """floor(1000 ln(p / q)) of every bucket, p and q with one pseudo count a bucket; both histograms have at most
    ``features.buckets`` rows, which the driver takes in."""
    s, t = (np.zeros(features.buckets, np.int64) for _ in range(2))
    for counts, table in ((s, raw), (t, target)):
        for bucket, n in table.collect():
            counts[bucket] = n
    all_s, all_t, m = float(s.sum()), float(t.sum()), float(features.buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (all_s + m) / ((a + 1.0) * (all_t + m))))
                     for a, b in zip(s.tolist(), t.tolist())], np.int64)


def noise_hash(doc_id: Column, seed: int) -> Column:
    """First 32 bits of the SHA-256 of ``<seed>:<doc_id>`` (null id: nothing after the colon)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def importance_scores(docs: DataFrame, target: DataFrame, features: Features = Features(), seed: int = 2024) -> DataFrame:
    """All columns of ``docs`` but ``text`` in the struct ``doc``, with ``n_words``, ``n_features``, ``weight`` (sum of
    the gains of its features against the texts of ``target``) and ``score`` (weight and noise); all long.

    A null or empty text, or one without words, has no features and the weight 0.  Repeated rows are scored each.  An
    empty ``docs`` gives no rows; without target texts the gains come from the pseudo counts.  Extra columns of ``docs``
    may have any name."""
    columns = [F.col("doc_id"), *[c for c, name in zip(own(docs), docs.columns) if name.lower() not in ("doc_id", "text")]]
    rows = docs.select(F.struct(*columns).alias("doc"), F.col("text").cast("string").alias("text"))
    table = scratch_table(bucketed(rows, features), "buckets")
    wanted = bucketed(target.select(F.col("text").cast("string").alias("text")), features)
    gain = docs.sparkSession.sparkContext.broadcast(gains(histogram(table, features), histogram(wanted, features), features))
    at = table.columns.index("buckets")

    def weigh(batches):
        for batch in batches:
            weight = [int(gain.value[np.frombuffer(x, features.code)].sum()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(weight, pa.int64())], names=[*batch.schema.names[:at], "weight"])

    scored = table.mapInArrow(weigh, T.StructType([*table.schema.fields[:at], T.StructField("weight", T.LongType())]))
    u = (noise_hash(F.col("doc.doc_id"), seed) + F.lit(0.5)) / F.lit(4294967296.0)
    return scored.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(u))).cast("long"))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20,
                        features: Features = Features(), seed: int = 2024) -> DataFrame:
    """``importance_scores`` with ``rank``: of the N documents that have ``least_words`` words, those of the
    floor(percent * N / 100) highest scores have ranks from 1 on (ties: the smaller doc_id first, a null one last; rows
    equal in both: the one of fewer features first, then any); all others have null.

    The order is total over range partitions, so neither the draw nor a common score is in one task."""
    if not 0 <= percent <= 100:
        raise ValueError("percent must be 0 to 100")
    scored = scratch_table(importance_scores(docs, target, features, seed), "scores")
    enough = F.col("n_words") >= least_words
    drawn = scored.agg(F.count_if(enough)).first()[0] * percent // 100
    order = [F.when(enough, 0).otherwise(1), F.col("score").desc(), F.col("doc.doc_id").asc_nulls_last(), F.col("n_features")]
    ranked = global_rank(scored, order)
    forget(scored)
    return ranked.withColumn("rank", F.when(enough & (F.col("rank") <= drawn), F.col("rank")).cast("long"))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents that ``importance_resample`` draws, all columns, in no order."""
    whole = docs.select(F.col("doc_id"), F.col("text"), F.struct(*own(docs)).alias("doc"))
    return importance_resample(whole, target, **options).filter("rank IS NOT NULL").select("doc.doc.*")


def resampling_digests(resampled: DataFrame) -> DataFrame:
    return resampled.select("doc.doc_id", "n_features", "weight", "score", "rank")
