"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut by the pre-tokenizer's pattern.  Tier one asks a minimal perfect hash whether a
whole pre-token is in the vocabulary; tier two merges the bytes of all others: a doubly linked list of
parts and a heap of mergeable neighbours by rank, leftmost first.  Answers for recent pre-tokens are
kept in a bounded memo.  Vocabulary and tables are fixed by the rank file (tens of thousands
of entries), so they are broadcast; documents never move.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, own

#: Pre-tokens of a generation of the memo; the one before is kept beside it.
MEMO_LIMIT = 400_000
#: Rows of an Arrow batch that are worked on at once, and ids whose bytes are gathered at once.
_ROWS, _GATHER = 512, 1 << 18
_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash over byte strings (hash and displace): key -> position in ``keys``.

    Keys fall into buckets; a bucket stores a displacement that sends its keys to free slots, or
    the slot itself where it has one key.  As many slots as keys; the slot's key is compared, so
    strings outside the set are told apart exactly."""

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        self.n, self.m = len(keys), max(1, len(keys) // per_bucket)
        buckets: list[list[tuple[int, int]]] = [[] for _ in range(self.m)]
        for i, k in enumerate(keys):
            h = xxhash.xxh64_intdigest(k)
            buckets[h % self.m].append((h, i))
        self.shift = [0] * self.m
        slots: list[int] = [-1] * self.n
        for b in sorted(range(self.m), key=lambda b: -len(buckets[b])):
            if len(buckets[b]) < 2:
                break
            d = 0
            while True:
                at = [self._slot(h, d) for h, _ in buckets[b]]
                if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, i) in zip(at, buckets[b]):
                slots[s] = i
        free = (s for s in range(self.n) if slots[s] < 0)
        for b in range(self.m):
            if len(buckets[b]) == 1:
                s = next(free)
                self.shift[b] = -s - 1
                slots[s] = buckets[b][0][1]
        self.slots = slots
        self.keys = [keys[i] for i in slots]

    def _slot(self, h: int, d: int) -> int:
        return ((((h ^ (d * _ODD)) * _ODD & _MASK) >> 32) * self.n) >> 32

    def get(self, key: bytes) -> int:
        """Position of ``key``, -1 if it is not in the set."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.m]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.slots[s] if self.keys[s] == key else -1


class Bpe:
    """Vocabulary, merge table and pre-tokenizer; ``ranks`` maps byte strings to ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"not a byte-level vocabulary: no rank for bytes {missing[:8]}")
        tokens = sorted(ranks, key=ranks.get)
        self.pattern = pattern
        self.whole = PerfectHash(tokens)
        self.ids = [ranks[t] for t in tokens]
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.bytes_of = {ranks[t]: t for t in tokens}
        #: for every id, the ids that may follow it in a merge and the rank of the result
        none: dict[int, int] = {}
        self.after_of: list[dict[int, int]] = [none] * (max(self.ids) + 1)
        for t in tokens:
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    if self.after_of[a] is none:
                        self.after_of[a] = {}
                    self.after_of[a][b] = ranks[t]
        self.memo = Memo(self)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token by merging neighbours, lowest rank first, leftmost of ties."""
        after_of, byte_ids = self.after_of, self.byte_ids
        ids = [byte_ids[b] for b in piece]
        n = len(ids)
        # rank of the pair that begins at a part now; an entry of the heap that says otherwise is stale
        rank = [after_of[a].get(b) for a, b in zip(ids, ids[1:])]
        rank.append(None)
        heap = [r << 32 | i for i, r in enumerate(rank) if r is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            if rank[i] != r:
                continue
            j = after[i]
            ids[i], rank[i], rank[j] = r, None, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                s = after_of[r].get(ids[k])
                if s is not None:
                    rank[i] = s
                    heappush(heap, s << 32 | i)
            k = before[i]
            if k >= 0:
                s = rank[k] = after_of[ids[k]].get(r)
                if s is not None:
                    heappush(heap, s << 32 | k)
        i, out = 0, []
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def lookup(self, piece: str) -> bytes:
        """Ids of a pre-token, as 32-bit integers."""
        key = piece.encode()
        at = self.whole.get(key)
        return array("i", (self.ids[at],) if at >= 0 else self.merge(key)).tobytes()

    def encode(self, text: str, pieces_of) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, pieces_of(text))), "<i4")


class Memo(dict):
    """Ids of recent pre-tokens in two generations of at most MEMO_LIMIT each: what is used again moves to
    the younger one, the older one is dropped when that is full."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __reduce__(self):
        return Memo, (self.bpe,)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece) or self.bpe.lookup(piece)
        if len(self) >= MEMO_LIMIT:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Decoder:
    """Bytes of ids: all tokens in one buffer, and where each begins."""

    def __init__(self, bytes_of: dict[int, bytes]):
        tokens = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for i in range(0, len(ids), _GATHER):
            part = ids[i:i + _GATHER]
            size = self.size[part]
            shift = self.start[part] - (np.cumsum(size) - size)
            out.append(self.data[np.repeat(shift, size) + np.arange(size.sum())].tobytes())
        return b"".join(out)


def broadcast_bpe(spark: SparkSession, path: str, pattern: str):
    """The tables of a rank file (read by the driver; ``path`` need not exist on the executors)."""
    return spark.sparkContext.broadcast(Bpe.from_file(path, pattern))


def _typed(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, bpe, out: str = "ids", text: str = "text") -> DataFrame:
    """Add the token ids of every whole text (array of int; a null or empty text: empty array).

    No special tokens: their strings are ordinary text.  All other columns are passed on, also ones
    that a helper column might clash with; ``out`` must be a new name."""
    if fresh(docs, out) != out:
        raise ValueError(f"column {out} exists")
    at = docs.columns.index(text)

    def run(batches):
        model = bpe.value
        pieces_of = regex.compile(model.pattern).findall
        none = np.zeros(0, np.int32)
        for whole in batches:
            for begin in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(begin, _ROWS)
                ids = [model.encode(t, pieces_of) if t else none for t in batch.column(at).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, _typed(docs, out, T.ArrayType(T.IntegerType())))


def decode(tokens: DataFrame, bpe, out: str = "decoded", ids: str = "ids") -> DataFrame:
    """Add the bytes that the ids stand for (binary; null or no ids: empty)."""
    if fresh(tokens, out) != out:
        raise ValueError(f"column {out} exists")
    at = tokens.columns.index(ids)

    decoder = tokens.sparkSession.sparkContext.broadcast(Decoder(bpe.value.bytes_of))

    def run(batches):
        model = decoder.value
        for whole in batches:
            for begin in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(begin, _ROWS)
                lists = batch.column(at)
                ids = lists.flatten().to_numpy()
                size = [n or 0 for n in pc.list_value_length(lists).to_pylist()]
                ends = np.cumsum(size)
                data = [model.decode(ids[e - n:e]) for e, n in zip(ends.tolist(), size)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())],
                                                 names=[*batch.schema.names, out])

    return tokens.mapInArrow(run, _typed(tokens, out, T.BinaryType()))


def _digests(ids: str, decoded: str) -> list:
    return [F.size(ids).cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
            F.sha2(decoded, 256).alias("decoded_sha256")]


def token_digests(docs: DataFrame, bpe) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row of ``docs``, repeated ones too.

    A null or empty text has no tokens and the digests of nothing; a null doc_id stays null; other columns are left out."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return decode(encode(texts, bpe).drop("text"), bpe).select("doc_id", *_digests("ids", "decoded"))


def tokenize(docs: DataFrame, bpe) -> DataFrame:
    """``docs`` with ``token_ids`` and the digests in place of ``text``; a column of ``docs`` that has one of
    these names is left out."""
    made = {"token_ids", "n_tokens", "ids_sha256", "decoded_sha256", "text"}
    rest = docs.select(*[c for c, name in zip(own(docs), docs.columns) if name.lower() not in made - {"text"}])
    decoded = fresh(rest, "__decoded")
    both = decode(encode(rest, bpe, "token_ids").drop("text"), bpe, decoded, "token_ids")
    return both.select(*[c for c, name in zip(own(rest), rest.columns) if name.lower() != "text"],
                       "token_ids", *_digests("token_ids", decoded))
