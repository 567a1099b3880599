"""Tokenizers inside tasks: built once a worker from bytes that the driver read, words answered from a memo."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Entries of a memo.
MEMO_LIMIT = 400_000
#: Entries of a memo of words.
WORD_LIMIT = 800_000
#: Marks that often end a word.
_MARKS = b".,;:!?"
#: A longer chunk is worked out anew each time.
MEMO_CHARS = 64
#: Rows and characters of texts that are worked on at once.
_ROWS, _CHARS = 2048, 1 << 20


class Recent(dict):
    """Answers of ``make`` in two generations of at most ``limit`` each: what is asked for again moves to the younger
    one, the older one is dropped when that is full."""

    def __init__(self, make: Callable, limit: int = MEMO_LIMIT // 4):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Store:
    """Integer sequences in one array, by place."""

    def __init__(self):
        self.first, self.size, self.flat = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences at ``places`` one after another, and the length of each."""
        size = self.size[places]
        return self.flat[ranges(self.first[places], size)], size

    def keep(self, places: np.ndarray) -> None:
        flat, size = self.take(places)
        self.first, self.size, self.flat = np.cumsum(size) - size, size, flat


class Chunked:
    """Encoder of texts by chunks: matches of a pattern that every one of ``encoders`` encodes independently of what stands
    around them (what no match covers has no ids).  A text in which ``whole`` is found is one chunk, as is any text without a
    pattern.

    Chunks that occur again are answered from a memo, the new ones of a portion of texts are encoded together.  The memo has
    two generations of half of ``limit`` each: what is asked for again moves to the younger one, the older one is dropped
    when that is full."""

    def __init__(self, chunks: str | None, encoders: list, whole: str | None = None, limit: int | None = None):
        self.chunks = re.compile(chunks, re.ASCII).findall if chunks else lambda text: [text] if text else []
        self.whole = re.compile(whole).search if whole else None
        self.encoders, self.limit = encoders, limit or MEMO_LIMIT
        self.memo: dict[str, int] = {}
        self.stores = [Store() for _ in encoders]
        self.older, self.old_stores = self.memo, self.stores

    def _parts(self, text: str) -> list[str]:
        return [text] if self.whole and not text.isascii() and self.whole(text) else self.chunks(text)

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per encoder the ids of all texts one after another, and how many each text has."""
        parts = list(map(self._parts, texts))
        seen = set().union(*parts)
        if 2 * len(self.memo) > self.limit:
            self.older, self.old_stores = self.memo, self.stores
            self.memo, self.stores = {}, [Store() for _ in self.encoders]
        missing = seen.difference(self.memo)
        again = [c for c in missing if c in self.older]
        new = list(missing.difference(again))
        places = np.fromiter(map(self.older.__getitem__, again), np.int64, len(again))
        base = len(self.stores[0].first)
        for store, old, encode in zip(self.stores, self.old_stores, self.encoders):
            found = encode(new)
            flat, size = old.take(places)
            store.add(np.concatenate([flat, np.fromiter(chain.from_iterable(found), np.int64)]),
                      np.concatenate([size, np.fromiter(map(len, found), np.int64, len(found))]))
        self.memo.update(zip(chain(again, new), range(base, base + len(missing))))
        places = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(parts)), np.int64)
        ends = np.cumsum([len(p) for p in parts])
        out = []
        for store in self.stores:
            flat, size = store.take(places)
            out.append((flat, np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])])))
        for c in new:
            if len(c) > MEMO_CHARS:
                del self.memo[c]
        return out


class Words:
    """Encoder of texts word by word, for a tokenizer that lower-cases, drops white space, merges nothing across it, parts
    letters and digits from what follows them and has small ASCII letters for its model as they are.  Words are what ASCII white space parts; their ids, as little-endian unsigned
    32-bit integers, come from a memo of two generations.  A word that is not there is looked up without capitals and the
    marks at its end before it is encoded."""

    def __init__(self, subwords: Subwords, limit: int = WORD_LIMIT):
        self.encode, self.model, self.limit = subwords.encode, subwords.tokenizer.model, limit
        self.memo: dict[bytes, bytes] = {}
        self.older, self.stems, self.marks = self.memo, {}, {}

    def _new(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that the memo does not have."""
        stems, marks = self.stems, self.marks
        cuts = []
        for w in words:
            # special tokens, which are matched as they stand, hold one of these
            stem = w.lower().rstrip(_MARKS) if b"<" not in w and b">" not in w else w
            cuts.append((stem, w[len(stem):]) if stem and stem[-1:].isalnum() else (w, b""))
        todo = list({s for s, _ in cuts if s not in stems} | {m for _, m in cuts if m not in marks})
        other = [t for t in todo if not t.isalpha()]
        found = {t: array("I", ids).tobytes() for t, ids in zip(other, self.encode([t.decode() for t in other]))}
        # small letters alone need no normalization and are one pre-token: the model's own answer is the tokenizer's
        tokenize = self.model.tokenize
        found.update((t, array("I", [x.id for x in tokenize(t.decode())]).tobytes()) for t in todo if t.isalpha())
        out = []
        for stem, mark in cuts:
            ids = stems.get(stem)
            if ids is None:
                ids = found[stem]
                if len(stem) <= MEMO_CHARS:
                    stems[stem] = ids
            tail = marks.get(mark)
            if tail is None:
                tail = found[mark]
                if len(mark) <= 4:
                    marks[mark] = tail
            out.append(ids + tail)
        if len(stems) > self.limit:
            stems.clear()
        return out

    def ids(self, text: str) -> bytes:
        words = text.encode().split()
        memo = self.memo
        missing = set(words).difference(memo)
        if missing:
            again = [w for w in missing if w in self.older]
            memo.update((w, self.older[w]) for w in again)
            new = list(missing.difference(again))
            memo.update(zip(new, self._new(new)))
            out = b"".join(map(memo.__getitem__, words))
            for w in new:
                if len(w) > MEMO_CHARS:
                    del memo[w]
            if 2 * len(memo) > self.limit:
                self.older, self.memo = memo, {}
            return out
        return b"".join(map(memo.__getitem__, words))


class Subwords:
    """A tokenizer of the ``tokenizers`` library, without added special tokens; ``plain_special``: the strings of special
    tokens inside a text are ordinary text."""

    def __init__(self, definition: str, plain_special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = plain_special

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        return [np.array(ids, "<u4").tobytes() for ids in self.encode(texts)]


#: White space that the libraries' patterns know and the ASCII mode of ``re`` does not.
ODD_SPACE = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Chunks that begin with a space behind another character (texts begin with one): a byte-level tokenizer whose pattern
#: gives a word the one space before it never takes what ends there and what begins there together.
SPACED_CHUNKS = r" \s*\S*(?:[\t\n\r\f\v]\s*\S*)*"
_BUILT: dict[tuple, Subwords] = {}


def in_worker(key: tuple, build: Callable):
    """What ``build`` makes, kept for the later tasks of this worker process."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build()
    return _BUILT[key]


def broadcast_file(spark: SparkSession, path: str):
    """The bytes of a vocabulary file (read by the driver; ``path`` need not exist on the executors)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def portions(batch: pa.RecordBatch, text: int, rows: int = _ROWS, chars: int = _CHARS) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows whose texts end when they pass ``chars`` bytes (a row at least)."""
    size = batch.column(text).cast(pa.large_binary())
    size = np.array([len(x) if x is not None else 0 for x in size.to_pylist()], np.int64) if size.null_count else \
        np.diff(np.frombuffer(size.buffers()[1], np.int64)[size.offset:size.offset + len(size) + 1])
    begin = 0
    while begin < batch.num_rows:
        ends = np.cumsum(size[begin:begin + rows])
        n = max(1, int(np.searchsorted(ends, chars, "right")))
        yield batch.slice(begin, n)
        begin += n
