"""Exact repeated passages through sparse suffix arrays.

Only suffixes that begin at content-selected minimiser positions are kept: the smallest hash of
``GRAM`` words in some window of ``WINDOW`` positions.  Equal passages select equal positions, so a passage of
``min_words`` words or more that two documents share holds a kept suffix within its first ``WINDOW`` positions,
and from there the two agree for ``min_words - WINDOW + 1`` words at least (the seed).

1. Seeds are hashed; seeds that are there once are dropped.
2. Of the rest, the suffixes that begin at the seed or up to ``WINDOW`` - 1 words before it are read once more: every
   shared run of ``min_words`` words is the beginning of one of them.
3. These suffixes are grouped by their first ``min_words`` words (as a 64-bit hash).  Where two documents or more meet,
   each of their suffixes is matched with the smallest other document, wherever it sorts.
4. Matches are merged per document.

Groups are reduced map-side to their smallest members, so a hot passage is no large task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, scratch_table
from .passages import at_rows, keyed, long_runs, merge_spans, runs, window_minima, word_hashes

MIN_WORDS, WINDOW, GRAM = 50, 16, 5
#: Parts of the keys that are grouped one after the other, so that less is on disk at a time.
PASSES = 4

_SEEDS = pa.schema([("seed", pa.int64()), ("row", pa.int64()), ("pos", pa.int32())])


def seeds(docs: DataFrame, min_words: int) -> DataFrame:
    """``seed``, ``row``, ``pos`` of the kept suffixes that are long enough for a match."""
    length = min_words - WINDOW + 1

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                out = []
                for row, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    words = word_hashes(text)
                    if len(words) >= min_words:
                        pos = window_minima(runs(words, GRAM), WINDOW)
                        pos = pos[pos <= len(words) - length]
                        out.append((long_runs(words, length)[pos].view(np.int64), np.full(len(pos), row), pos.astype(np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=_SEEDS)

    return keyed(docs).mapInArrow(run, "seed long, row long, pos int")


_SPANS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()),
                    ("match_doc_id", pa.int64()), ("match_start", pa.int32())])
_SPAN_SQL = "row long, doc_id long, start_word int, end_word int, match_doc_id long, match_start int"
_SUFFIXES = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])


def suffixes(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """``key`` (hash of the first ``min_words`` words), ``row``, ``doc_id``, ``pos`` of the suffixes that begin at a seed of
    ``wanted`` (``row``, ``pos``) or up to ``WINDOW`` - 1 words before it."""
    by_row = wanted.groupBy("row").agg(F.collect_list("pos").alias("at"))

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 64):
                batch = whole.slice(begin, 64)
                out, docs_of = [], []
                for row, doc, text, at in zip(*(batch.column(i) for i in range(4))):
                    keys = long_runs(word_hashes(text.as_py()), min_words)
                    pos = at.values.to_numpy()
                    edges = np.zeros(len(keys) + 1, np.int64)
                    np.add.at(edges, np.clip(pos - (WINDOW - 1), 0, len(keys)), 1)
                    np.add.at(edges, np.clip(pos + 1, 0, len(keys)), -1)
                    start = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
                    out.append((keys[start].view(np.int64), np.full(len(start), row.as_py()), start.astype(np.int32)))
                    docs_of.append(pa.array([doc.as_py()], pa.int64()).take(pa.array(np.zeros(len(start), np.int32))))
                if out:
                    key, rows, pos = (pa.array(np.concatenate(x)) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([key, rows, pa.concat_arrays(docs_of), pos], schema=_SUFFIXES)

    return at_rows(docs, by_row, run, "key long, row long, doc_id long, pos int")


def shared_spans(found: DataFrame, min_words: int) -> DataFrame:
    """A span for every suffix of ``found`` (``m``: the smallest member of its group), matched with the smallest member of
    another document."""
    others = found.filter("row <> m.row").groupBy("key").agg(F.min(F.struct("doc_id", "row", "pos")).alias("o"))
    # only the smallest document of a group needs the one after it
    own = found.filter("row = m.row").join(others, "key").select("row", "doc_id", "pos", F.col("o").alias("m"))
    spans = found.filter("row <> m.row").select("row", "doc_id", "pos", "m").unionByName(own)
    return spans.select("row", "doc_id", F.col("pos").alias("start_word"), (F.col("pos") + min_words).alias("end_word"),
                        F.col("m.doc_id").alias("match_doc_id"), F.col("m.pos").alias("match_start"))


def pass_spans(every: DataFrame, k: int, min_words: int) -> DataFrame:
    """Spans of the ``k``-th part of the keys, written."""
    some = every.filter(F.pmod("key", F.lit(PASSES)) == k)
    groups = some.groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("high"),
                                     F.min(F.struct("doc_id", "row", "pos")).alias("m")).filter("low <> high")
    groups = scratch_table(groups.select("key", "m"), "groups")
    found = scratch_table(some.join(groups, "key"), "found")
    forget(groups)
    spans = scratch_table(shared_spans(found, min_words), "spans")
    forget(found)
    return spans


def joined_spans(spans: DataFrame) -> DataFrame:
    """Spans that go on in the next one, in both documents, joined to one (those of a batch; ``merge_spans`` does the rest)."""
    def run(batches):
        for given in batches:
            if not given.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(given.columns, schema=_SPANS)
            row, start, end, there = (batch.column(i).to_numpy() for i in (0, 2, 3, 5))
            nulls = batch.column(4).is_null().to_numpy(zero_copy_only=False)
            match = batch.column(4).fill_null(0).to_numpy()
            begins = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > end[:-1]) | (match[1:] != match[:-1])
                                     | (nulls[1:] != nulls[:-1]) | (there[1:] - start[1:] != there[:-1] - start[:-1])])
            first = np.flatnonzero(begins)
            last = np.concatenate([first[1:], [len(row)]]) - 1
            taken = batch.take(pa.array(first))
            yield pa.RecordBatch.from_arrays([*taken.columns[:3], pa.array(end[last]), *taken.columns[4:]], schema=_SPANS)

    return spans.repartition("row").sortWithinPartitions("row", "start_word").mapInArrow(run, _SPAN_SQL)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of ``min_words`` words or more that another document has too, word for word (A-Z lower-cased).

    One row per merged span: ``doc_id``, ``start_word``, ``end_word`` (exclusive), ``n_words``, and
    ``match_doc_id``, ``match_start``: the smallest document that shares a part of it, and where.  Rows equal in
    id and text are one document.  Null and empty texts, and texts of fewer words, have no passages; a
    null doc_id comes back null.  Repeats inside one document alone are not reported."""
    if min_words < WINDOW + GRAM:
        raise ValueError(f"min_words must be at least {WINDOW + GRAM}")
    docs = docs.select("doc_id", "text")
    kept = scratch_table(seeds(docs, min_words), "seeds")
    # a seed that one document repeats gets through here too; it finds no other document later
    shared = kept.groupBy("seed").count().filter("count > 1").select("seed")
    shared = scratch_table(shared, "shared")
    every = scratch_table(suffixes(docs, kept.join(shared, "seed").select("row", "pos"), min_words), "suffixes")
    forget(kept, shared)
    spans = [pass_spans(every, k, min_words) for k in range(PASSES)]
    forget(every)
    merged = merge_spans(joined_spans(reduce(DataFrame.unionByName, spans)))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"),
                         F.col("m.match_doc_id").alias("match_doc_id"), F.col("m.match_start").alias("match_start"))
