"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

A document leaks an item if a window of the item's length in words has a weighted shingle
similarity of at least ``min_similarity`` with it: the sum of the smaller over the sum of the larger
multiplicities, over all shingles of ``shingle`` words (words are compared with A-Z lower-cased).

The benchmark is the small side and is used in blocks of at most ``ITEMS_PER_BLOCK`` items, each
broadcast as an index; documents are scanned once per block and never shuffled:

1. A window that shares no shingle with any item has similarity zero, so only windows around
   shared shingles are fingerprinted (a lossless cut, found on integer word ids).
2. Window fingerprints meet item fingerprints in 4 blocks of 16 bits.  An index holds every item
   under all block values within 4 bits of its own, so by the pigeonhole principle every pair
   within ``RADIUS`` = 4 * 5 - 1 = 19 bits meets in some block.
3. Candidates within the radius are verified on the words themselves.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, mix64, own

#: Items of one broadcast index; a larger benchmark is searched block by block.
ITEMS_PER_BLOCK = 1_000
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 4
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], k: int) -> Counter:
    """Multiset of the k-word shingles (fewer words: the whole sequence)."""
    k = min(k, len(words))
    return Counter(zip(*(words[i:] for i in range(k)))) if k else Counter()


def weighted_similarity(a: Counter, b: Counter) -> float:
    smaller = sum((a & b).values())
    return smaller / (sum(a.values()) + sum(b.values()) - smaller) if smaller else 0.0


def _combine(codes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k neighbouring codes."""
    out = np.zeros(len(codes) - k + 1, np.uint64)
    for i in range(k):
        out = out * _BASE + codes[i:len(codes) - k + 1 + i]
    return mix64(out)


def window_fingerprints(hashes: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """SimHash of the runs of ``size`` shingle hashes that begin at ``starts``."""
    low, high = int(starts.min()), int(starts.max()) + size
    bits = np.unpackbits(hashes[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((high - low + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    ones = total[starts - low + size] - total[starts - low]
    return np.packbits(ones * 2 > size, axis=1, bitorder="little").view("<u8").ravel()


class ItemIndex:
    """Search index of one block of benchmark items: ``[(item_id, text)]``."""

    def __init__(self, items: list[tuple], shingle: int, min_similarity: float):
        self.k, self.least = shingle, min_similarity
        self.items = [(i, w) for i, text in items if (w := words_of(text))]
        self.vocab: dict[bytes, int] = {}
        for _, words in self.items:
            for w in words:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        self.bags = [shingles(w, shingle) for _, w in self.items]
        self.size = np.array([len(w) for _, w in self.items], np.int64)
        # shared shingles: for each shingle length, sorted hashes and the items that have them
        postings: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        prints = []
        for n, (_, words) in enumerate(self.items):
            k = min(shingle, len(words))
            ids = np.array([self.vocab[w] for w in words], np.uint64)
            for h in _combine(ids, k).tolist():
                postings[k][h].add(n)
            hashes = _combine(self.word_hashes(words), k)
            prints.append(window_fingerprints(hashes, len(hashes), np.zeros(1, np.int64))[0])
        self.prints = np.array(prints, np.uint64)
        self.postings = {}
        for k, by in postings.items():
            keys = sorted(by)
            sets = [np.array(sorted(by[h]), np.int64) for h in keys]
            self.postings[k] = (np.array(keys, np.uint64), sets)
        self._index_blocks()

    @staticmethod
    def word_hashes(words: list[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)

    def _index_blocks(self) -> None:
        masks = np.array([sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1)
                          for c in combinations(range(BLOCK_BITS), r)], np.uint32)
        self.blocks = []
        for b in range(BLOCKS):
            own_value = ((self.prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.uint32)
            values = (own_value[:, None] ^ masks[None, :]).ravel()
            item = np.repeat(np.arange(len(self.prints), dtype=np.int32), len(masks))
            order = np.argsort(values, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << BLOCK_BITS))])
            self.blocks.append((ends, item[order]))

    def _near(self, prints: np.ndarray, length: int) -> np.ndarray:
        """(window, item) rows: all items of ``length`` words within RADIUS, through the blocks."""
        found = []
        for b, (ends, item) in enumerate(self.blocks):
            value = ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
            n = ends[value + 1] - ends[value]
            window = np.repeat(np.arange(len(prints)), n)
            slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[value], n)
            who = item[slot]
            ok = self.size[who] == length
            window, who = window[ok], who[ok]
            ok = np.bitwise_count(prints[window] ^ self.prints[who]) <= RADIUS
            found.append(np.stack([window[ok], who[ok]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def search(self, text: str | None) -> list[tuple]:
        """(item_id, similarity, first word, end word) of the best window of every leaked item."""
        words = words_of(text)
        if not words:
            return []
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        wanted: dict[int, list] = defaultdict(list)  # item length -> [(first start, last start)]
        for k, (keys, sets) in self.postings.items():
            if len(words) < k:
                continue
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            at = np.nonzero(known[k:] - known[:-k] == k)[0]
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for i in range(k):
                h = h * _BASE + ids[at + i]
            h = mix64(h)
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[slot] == h
            for p, s in zip(at[hit].tolist(), slot[hit].tolist()):
                for length in np.unique(self.size[sets[s]]).tolist():
                    wanted[length].append((p - length + k, p))
        if not wanted:
            return []
        hashes_of_words = self.word_hashes(words)
        best: dict[int, tuple] = {}
        for length, ranges in wanted.items():
            size = min(length, len(words))
            mark = np.zeros(len(words) - size + 2, np.int64)
            for low, high in ranges:
                mark[min(max(low, 0), len(words) - size)] += 1
                mark[min(high, len(words) - size) + 1] -= 1
            starts = np.nonzero(np.cumsum(mark)[:-1] > 0)[0]
            k = min(self.k, size)
            hashes = _combine(hashes_of_words, k)
            prints = window_fingerprints(hashes, size - k + 1, starts)
            bags: dict[int, Counter] = {}
            for w, n in self._near(prints, length).tolist():
                start = int(starts[w])
                bag = bags.get(start)
                if bag is None:
                    bag = bags[start] = shingles(words[start:start + size], self.k)
                s = weighted_similarity(bag, self.bags[n])
                if s >= self.least and (n not in best or s > best[n][0]):
                    best[n] = (s, start, start + size)
        return [(self.items[n][0], *best[n]) for n in sorted(best)]


def _index_blocks_of(benchmark: DataFrame, shingle: int, min_similarity: float):
    """The item indexes, one block of items at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n = max(1, -(-items.count() // (ITEMS_PER_BLOCK * 3 // 4)))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        rows = [(r[0], r[1]) for r in items.filter(block == b).collect()]
        for i in range(0, max(1, len(rows)), ITEMS_PER_BLOCK):
            yield ItemIndex(sorted(rows[i:i + ITEMS_PER_BLOCK], key=str), shingle, min_similarity)


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5,
                    min_similarity: float = 0.8) -> DataFrame:
    """One row per (document row, leaked item): ``doc_id``, ``item_id``, ``similarity``,
    ``first_word``, ``end_word`` (the best window, the first one of ties).

    Null and empty texts have no words: such documents leak nothing and such items are never
    leaked.  An item of fewer than ``shingle`` words is one shingle.  A document shorter than an
    item is one window.  Items with equal texts are all reported; rows of a repeated document
    each report their leaks; a null doc_id stays null.  Extra columns are ignored."""
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, similarity double, first_word int, end_word int"
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()),
                       ("first_word", pa.int32()), ("end_word", pa.int32())])
    for index in _index_blocks_of(benchmark, shingle, min_similarity):
        shared = spark.sparkContext.broadcast(index)

        def search(batches, shared=shared):
            index = shared.value
            for batch in batches:
                ids, texts = (batch.column(i).to_pylist() for i in (0, 1))
                rows = [(d, *x) for d, t in zip(ids, texts) for x in index.search(t)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        part = ids.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _leaks(shared):
    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        index = shared.value
        return pd.Series([bool(index.search(t)) for t in texts], dtype=bool)

    return leaks


def drop_leaking(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, min_similarity: float = 0.8) -> DataFrame:
    """``docs`` without the rows that leak an item.  The text is searched in place and the rows
    are filtered by the answer, so nothing is shuffled."""
    flag = fresh(docs, "__leaks")
    out = docs
    for index in _index_blocks_of(benchmark, shingle, min_similarity):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        out = out.withColumn(flag, _leaks(shared)(F.col("text").cast("string"))).filter(~F.col(flag)).select(*own(docs))
    return out
