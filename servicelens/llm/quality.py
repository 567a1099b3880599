"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into ``buckets`` counters.  One multinomial is estimated on a
trusted target, another on the whole raw corpus; a document scores the mean log-likelihood ratio of its
n-grams, so the length does not matter, and is kept if the score reaches a threshold.  The threshold is what tells
the labelled documents apart best, each scored as an unlabelled one would be: by a target without its own fold.
The verdict depends on the document, the two corpora and the labels only, not on chance.

DataFrame functions only.  The corpora are counted map-side into ``buckets`` rows, so what is
shuffled does not depend on the documents' sizes, and no text ever moves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, fresh, let, own, scratch_table

#: Hashed n-gram counters.
BUCKETS = 1 << 16
#: Most trusted documents that estimate the target (those with the smallest id hashes): their ids are broadcast.
TARGET_LIMIT = 20_000
#: Pseudo counts per bucket, spread like the raw corpus, that draw the target towards it: a target of few
#: n-grams then says little about words that it happens not to have.
SMOOTHING = 8.0
#: A document is kept from this mean log-likelihood ratio on, unless the ratios come with a threshold of their own.
LEAST_RATIO = -0.105
#: Pseudo counts of a target that is learnt from labels, as a share of its own n-grams: a small target is then drawn
#: towards the corpus as much as a large one.
MIX = 0.02
#: Parts of the trusted documents; each is scored by the target that the others make.
FOLDS = 5
_WINDOW = 8


def words_of(text: Column) -> Column:
    """Words of a text in order (null: none)."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, -1), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(hashes: Column, buckets: int) -> Column:
    """Buckets of all unigrams, then all bigrams."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pair = F.transform(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
                       lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(buckets)).cast("int"))
    return F.concat(single, pair)


def _repeat_words(hashes: Column, window: int = _WINDOW) -> Column:
    """Words inside windows of 8 words that occur twice or more.

    Windows are told apart by a 64-bit hash of their word hashes.  Only a text with equal
    windows sorts them; covered words are then the sum of steps between starts, 8 at most."""
    n = F.size(hashes)
    keys = F.transform(F.slice(hashes, 1, F.greatest(n - (window - 1), F.lit(0))),
                       lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, window)]))

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda p, j: F.least(F.coalesce(F.get(starts, j + 1) - p, F.lit(window)), F.lit(window)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def repeated(keyed: Column) -> Column:
        placed = F.array_sort(F.transform(keyed, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def starts(order: Column) -> Column:
            twice = F.filter(order, lambda x, j: (F.get(order, j + 1)["k"] == x["k"])
                             | F.coalesce(F.when(j > 0, F.get(order, j - 1)["k"] == x["k"]), F.lit(False)))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        return let(placed, lambda order: let(starts(order), covered))

    return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(repeated(k)))


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def base_failed(measures: Column) -> Column:
    return (measures["n_words"] < 20) | (100 * measures["n_repeat_words"] > 30 * measures["n_words"])


def _sample(labelled: DataFrame, limit: int) -> DataFrame:
    """``__trusted``, ``__fold`` of at most ``limit`` ids (smallest hashes; null ids do not count)."""
    ids = labelled.select(F.col("doc_id").cast("long").alias("__trusted")).dropna().distinct()
    return ids.orderBy(F.xxhash64("__trusted"), "__trusted").limit(limit).withColumn(
        "__fold", F.pmod(F.xxhash64("__trusted"), F.lit(FOLDS)).cast("int"))


def ratio_table(corpus: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, limit: int = TARGET_LIMIT,
                smoothing: float = SMOOTHING, mix: float | None = None) -> DataFrame:
    """One row: ``ratios``, the log-likelihood ratio of every bucket (array of ``buckets`` doubles).

    ``corpus``: ``doc_id``, ``text``; ``trusted``: ``doc_id`` of target documents.  All documents
    count for the raw corpus.  At most ``limit`` trusted ids (smallest hashes; null ids do not
    count) estimate the target, so that they can be broadcast at any corpus size.

    With ``mix`` the pseudo counts are that share of the target's n-grams instead of ``smoothing`` per bucket;
    ``held_out`` has ``FOLDS`` times ``buckets`` ratios, fold by fold, of the target without the fold (null: nothing is left),
    and ``ratios`` is their mean, so that an untrusted document scores like a trusted one by the folds that it is not in."""
    docs = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(_sample(trusted, limit)), F.col("doc_id") == F.col("__trusted"), "left")
    grams = docs.select(F.col("__trusted").isNotNull().cast("long").alias("target"), "__fold",
                        F.explode(let(_hashes(words_of(F.col("text"))), lambda h: _grams(h, buckets))).alias("bucket"))
    folds = [f"f{k}" for k in range(FOLDS if mix is not None else 0)]
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("target").alias("target"),
                                         *[F.count_if(F.col("__fold") == k).alias(f) for k, f in enumerate(folds)])
    # buckets rows at most from here on
    every = corpus.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    numbers = ["raw", "target", *folds]
    filled = every.join(counts, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])
    listed = filled.agg(F.sort_array(F.collect_list(F.struct("bucket", *numbers))).alias("c"),
                        *[F.sum(c).alias(f"n_{c}") for c in numbers])

    def ratio(x: Column, count: Column, n: Column) -> Column:
        raw = (x["raw"] + F.lit(1.0)) / (F.col("n_raw") + F.lit(float(buckets)))
        pseudo = F.lit(smoothing * buckets) if mix is None else F.lit(mix) * n
        return F.log((count + pseudo * raw) / (n + pseudo) / raw)

    if mix is None:
        return listed.select(F.transform("c", lambda x: ratio(x, x["target"], F.col("n_target"))).alias("ratios"))
    left = {f: F.col("n_target") - F.col(f"n_{f}") for f in folds}

    def without(x: Column, f: str) -> Column:
        return F.when(left[f] > 0, ratio(x, x["target"] - x[f], left[f]))

    def mean(x: Column) -> Column:
        total = sum((F.coalesce(without(x, f), F.lit(0.0)) for f in folds), F.lit(0.0))
        return total / F.greatest(sum(((n > 0).cast("int") for n in left.values()), F.lit(0)), F.lit(1))

    def held_out(f: str) -> Column:
        return F.transform("c", lambda x: without(x, f))

    return listed.select(F.transform("c", mean).alias("ratios"),
                         F.concat(*[held_out(f) for f in folds]).alias("held_out"))


def quality_verdicts(docs: DataFrame, ratios: DataFrame, least_ratio: float | None = None,
                     buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed``, ``ratio`` and ``kept`` of every row of ``docs``.

    ``ratios`` is the written one-row result of ``ratio_table`` or the one of ``learn``, which has a threshold
    (``least_ratio``; one that is given goes before it).  A null or empty text has no words and
    fails the base rules; a text without words has ratio 0.  Repeated rows come back as given."""
    return judged(docs.select("doc_id", "text"), ratios, "__q", least_ratio, buckets).select(
        "doc_id", "__q.*")


def judged(docs: DataFrame, ratios: DataFrame, out: str, least_ratio: float | None, buckets: int) -> DataFrame:
    """``docs`` with a struct column ``out`` of measures and verdict."""
    # scalar subqueries (one row, computed once); analysis wants them outside the lambdas that read them
    name = fresh(docs, "__weights")
    least = fresh(docs, "__least")
    if least_ratio is None and "least_ratio" in ratios.columns:
        threshold = ratios.select("least_ratio").scalar()
    else:
        threshold = F.lit(LEAST_RATIO if least_ratio is None else least_ratio)
    weighted = docs.withColumn(name, ratios.select("ratios").scalar()).withColumn(least, threshold)
    return weighted.select(*own(docs), _verdict(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col(name), F.lit(0),
                                                F.col(least), buckets).alias(out))


def _verdict(text: Column, weights: Column, offset: Column, least_ratio: Column, buckets: int) -> Column:
    """Measures, mean ratio (weights of buckets from ``offset`` on) and verdict of a text."""
    def verdict(w: Column, h: Column) -> Column:
        measures = F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _duplicate_lines(text).alias("n_dup_lines"), _repeat_words(h).alias("n_repeat_words"))
        total = let(_grams(h, buckets), lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(
            F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(weights, offset + b)) / F.size(g)))
        return let(F.struct(measures.alias("m"), total.alias("ratio")), lambda x: F.struct(
            *[x["m"][c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            base_failed(x["m"]).alias("base_failed"), x["ratio"].alias("ratio"),
            (~base_failed(x["m"]) & (x["ratio"] >= least_ratio)).alias("kept")))

    return let(words_of(text), lambda w: let(_hashes(w), lambda h: verdict(w, h)))


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The ratio from which on the share of ``good`` kept exceeds that of ``bad`` most, halfway between two scores.

    Without bad ones, the lowest good one; where good ones score no better, or there are none, no document is told
    from the others and all are kept."""
    if not len(good):
        return float("-inf")
    if not len(bad):
        return float(good.min())
    scores = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[-np.inf], (scores[1:] + scores[:-1]) / 2])
    gain = np.searchsorted(np.sort(bad), cuts) / len(bad) - np.searchsorted(np.sort(good), cuts) / len(good)
    return float(cuts[gain.argmax()])


def _labelled_scores(corpus: DataFrame, labels: DataFrame, ratios: DataFrame, buckets: int, limit: int) -> DataFrame:
    """``good``, ``ratio`` of the labelled documents that the base rules let pass, ``limit`` of either label at most;
    a good one scores by the target of the other folds, a bad one by the mean of all."""
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality IN (0, 1)")
    sample = _sample(known.filter("quality = 1"), limit).withColumn("__good", F.lit(True)).unionByName(
        _sample(known.filter("quality = 0"), limit).withColumn("__good", F.lit(False)))
    docs = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    weighted = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("__trusted")).withColumn(
        "__weights", ratios.select(F.concat("held_out", "ratios")).scalar()).withColumn(
        "__offset", F.when(F.col("__good"), F.col("__fold")).otherwise(F.lit(FOLDS)) * buckets)
    scored = weighted.select("__good", _verdict(F.col("text"), F.col("__weights"), F.col("__offset"), F.lit(0.0), buckets).alias("q"))
    return scored.filter("NOT q.base_failed AND q.ratio IS NOT NULL").select(F.col("__good").alias("good"), F.col("q.ratio").alias("ratio"))


def learn(corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """``ratios`` with the documents labelled ``quality`` 1 as the target, written once, and ``least_ratio``, the threshold
    that the labelled documents give."""
    learnt = scratch_table(ratio_table(corpus, labels.filter("quality = 1"), mix=MIX), "ratios")
    scores = _labelled_scores(corpus, labels, learnt, BUCKETS, TARGET_LIMIT).toArrow()
    good, ratio = scores["good"].to_numpy(), scores["ratio"].to_numpy()
    return learnt.select("ratios", F.lit(best_threshold(ratio[good.astype(bool)], ratio[~good.astype(bool)])).alias("least_ratio"))


def keep_quality(docs: DataFrame, labels: DataFrame, least_ratio: float | None = None) -> DataFrame:
    """The rows of ``docs`` that pass; all their columns."""
    out = fresh(docs, "__quality")
    return judged(docs, learn(docs, labels), out, least_ratio, BUCKETS).filter(F.col(out)["kept"]).select(*own(docs))
