"""What the two passage operators share: row keys, word and shingle hashes, texts for chosen rows, span merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: The bytes that part words.
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def row_key() -> Column:
    """Key of a document row from its contents, so that every pass finds the same one whatever the splits
    are; rows equal in id and text are one document."""
    return F.xxhash64("doc_id", "text")


def keyed(docs: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``text`` (null: empty) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select(row_key().alias("row"), "doc_id", "text")


class _Powers:
    """Powers of the base and of its inverse, as far as the longest text so far needs them."""

    def __init__(self):
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.power) < n:
            for name, base in (("power", _BASE), ("inverse", _INVERSE)):
                have = getattr(self, name)
                setattr(self, name, np.concatenate([have, have * (have[-1:] * base)]))
        return self.power[:n], self.inverse[:n]


_POWERS = _Powers()


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``raw``, A-Z lower-cased, and where they begin.

    A word's bytes are the digits of a number to an odd base, modulo 2**64: differences of running sums give
    the numbers of all words at once, the inverse base shifts them to the same place, a finalizer mixes them."""
    raw = np.frombuffer(raw.lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = _POWERS.upto(len(raw))
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * power, out=total[1:])
    return mix64((total[end] - total[begin]) * inverse[begin]), begin


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased."""
    return _hashed(text.encode())[0]


def hashed_texts(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Word hashes of many texts in few steps: (number of the first text, hashes of one text after the other, where each
    text's begin and the last's end), for as many texts at a time as have ``most`` bytes."""
    some, size, first = [], 0, 0
    for i, text in enumerate(texts):
        some.append(text.encode())
        size += len(some[-1]) + 1
        if size >= most or i == len(texts) - 1:
            words, begin = _hashed(b"\n".join(some))
            starts = np.cumsum([0, *(len(x) + 1 for x in some)])
            yield first, words, np.searchsorted(begin, starts)
            some, size, first = [], 0, i + 1


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k neighbouring words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + words[i:n + i]
    return mix64(out)


def long_runs(words: np.ndarray, k: int) -> np.ndarray:
    """Like ``runs``, in a number of steps that grows with the logarithm of k."""
    out, have = mix64(words), 1
    while have < k and len(out):
        step = min(have, k - have)
        if len(out) <= step:
            return np.zeros(0, np.uint64)
        out = mix64(out[:-step] * _BASE + out[step:])
        have += step
    return out


def window_minima(h: np.ndarray, window: int, whole: np.ndarray | None = None) -> np.ndarray:
    """Sorted positions that are the leftmost minimum of some window (``whole``: of those that count, by their first position).

    Positions take the low bits of the hashes, so equal hashes are told apart by place; minima of windows are
    those of a block's end and of the next block's beginning."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << max(24, len(h).bit_length())) - 1)
    blocks = np.full(-(-len(h) // window) * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[:len(h)] = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    blocks = blocks.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[window - 1:window - 1 + n]) & low).astype(np.int64)
    at = at if whole is None else at[whole[:n]]
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def at_rows(docs: DataFrame, requests: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` (a mapInArrow function) over ``row``, ``doc_id``, ``text`` and the columns of ``requests`` (one row per
    ``row``), for the requested rows only."""
    texts = keyed(docs).dropDuplicates(["row"])
    return texts.join(requests, "row").mapInArrow(run, schema)


def merge_spans(spans: DataFrame, largest: list[str] = []) -> DataFrame:  # noqa: B006
    """Unions of overlapping spans of a row: ``row``, ``doc_id``, ``start_word``, ``end_word``, ``m`` (the smallest
    ``match_doc_id`` with its ``match_start``) and the greatest value of every column of ``largest``.

    Equal spans are merged map-side first, so a document that many others match has no more rows than
    distinct spans."""
    values = [F.max(c).alias(c) for c in largest]
    unique = spans.groupBy("row", "doc_id", "start_word", "end_word").agg(
        F.min(F.struct("match_doc_id", "match_start")).alias("m"), *values)
    order = Window.partitionBy("row").orderBy("start_word", "end_word", "doc_id")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = unique.withColumn("begins", F.coalesce((F.col("start_word") > reach).cast("int"), F.lit(1)))
    island = begun.withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("row", "island").agg(
        F.first("doc_id").alias("doc_id"), F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"),
        F.min("m").alias("m"), *values)
