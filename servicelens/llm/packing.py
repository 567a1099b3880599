"""Packing of tokenized documents into sequences of a fixed size by bounded-space best fit.

Documents longer than a sequence are cut; all pieces, at most a sequence long, are dealt over tasks by a hash of their
row.  A task keeps a fixed number of open bins: a bitset over the free spaces says in one step which open bin leaves the
least room behind a piece, the longest pieces come first, and when a bin more is needed than may be open, the fullest one
closes.  Bins that a task leaves open with room to spare are unpacked and dealt anew over fewer tasks until one is left,
so many small partitions cost no more sequences than a few large ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, fresh, own, scratch_table, without
from .subwords import Subwords, Words, broadcast_file, in_worker, portions

#: Bins that a task may hold open, and pieces that it is given on average.
OPEN_BINS, TASK_PIECES = 1 << 14, 1 << 14
#: A bin that a task leaves open is final if it lacks no more than this share of a sequence.
SPARE = 1 / 64


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, by_words: bool = False,
           text: str = "text") -> DataFrame:
    """One row per piece: ``docs`` with ``piece`` (from 0), ``start``, ``length`` and ``ids`` (binary, little-endian unsigned
    32-bit) in place of ``text``.

    A document is the ids of its whole text, then ``end``; only what is longer than ``size`` is cut, into pieces of that
    size and a last one that may be shorter.  A null or empty text is the end alone.  ``by_words``: the tokenizer is
    of the kind that ``Words`` serves.  Other columns are passed on, but for one that is named like a new one, which gives way."""
    if not size >= 1:
        raise ValueError("size must be 1 or more")
    made = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType())]
    docs = without(docs, *(f.name for f in made))
    file, at = broadcast_file(docs.sparkSession, tokenizer), docs.columns.index(text)
    rest = [f for f in docs.schema.fields if f.name != text]
    last, key = np.array([end], "<u4").tobytes(), ("pieces", tokenizer, by_words)

    def run(batches):
        subwords, words = in_worker(key, lambda: with_words(Subwords(file.value.decode(), plain_special=False)))
        for whole in batches:
            for batch in portions(whole, at):
                rows, out = [], [[] for _ in made]
                texts = [t or "" for t in batch.column(at).to_pylist()]
                for i, ids in enumerate(map(words.ids, texts) if by_words else subwords.packed(texts)):
                    ids += last
                    for k, begin in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[begin:begin + 4 * size]
                        rows.append(i)
                        for column, value in zip(out, (k, begin // 4, len(part) // 4, part)):
                            column.append(value)
                columns = [c.take(pa.array(rows, pa.int64())) for i, c in enumerate(batch.columns) if i != at]
                columns += [pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in rest + made])

    return docs.mapInArrow(run, T.StructType(rest + made))


def with_words(subwords: Subwords) -> tuple[Subwords, Words]:
    return subwords, Words(subwords)


class Bins:
    """Open bins by free space; bit ``f`` of ``room`` is set while a bin with ``f`` free places is open."""

    def __init__(self, size: int, limit: int = OPEN_BINS):
        self.size, self.limit = size, limit
        self.room, self.open, self.made = 0, 0, 0
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_room[free]
        number = stack.pop()
        if not stack:
            self.room ^= 1 << free
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Bin of a piece and its offset there: the fullest open bin that it fits in, else a new one."""
        fits = self.room >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            number = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.room & -self.room).bit_length() - 1)
            free, number = self.size, self.made
            self.made += 1
        left = free - length
        if left:
            if not self.by_room[left]:
                self.room |= 1 << left
            self.by_room[left].append(number)
            self.open += 1
        return number, self.size - free

    def left_open(self, more_than: int) -> Iterator[int]:
        """Open bins with more free places than that."""
        for free in range(more_than + 1, self.size + 1):
            yield from self.by_room[free]


def pack(parts: DataFrame, size: int = 2048, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """``parts`` (rows with a ``length`` of 1 to ``size``) with ``sequence_id`` and ``offset`` (long), gapless from 0 in
    every sequence; all other columns are passed on, but for ones named like these, which give way.  Lengths that are null or out of range are an error.  Repeated rows
    are packed each; an empty table gives no rows.

    The rows are written once, so that rounds start from the same numbers whatever executors are lost.  A task holds the
    numbers of its pieces only; ids or other wide columns are better joined or dealt afterwards."""
    parts = without(parts, "sequence_id", "offset")
    key, spare = fresh(parts, "__piece"), int(size * SPARE)
    todo = scratch_table(parts.select(F.monotonically_increasing_id().alias(key), *own(parts)), "pieces")
    at_length = todo.columns.index(next(c for c in todo.columns if c.lower() == "length"))
    schema = T.StructType([*todo.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
                           T.StructField("__final", T.BooleanType())])
    ill = todo.filter(~F.coalesce(F.col("length").between(1, size), F.lit(False))).limit(1).count()
    if ill:
        raise ValueError(f"length out of 1 to {size}")

    def dealt(round_number: int, last: bool):
        def run(batches):
            from pyspark import TaskContext
            base = round_number << 56 | TaskContext.get().partitionId() << 28
            bins, held, numbers, offsets = Bins(size, open_bins), [], [], []
            for batch in batches:
                held.append(batch)
                for length in batch.column(at_length).to_pylist():
                    number, offset = bins.place(length)
                    numbers.append(number)
                    offsets.append(offset)
            unfinished = np.zeros(bins.made, bool)
            if not last:
                unfinished[list(bins.left_open(spare))] = True
            begin = 0
            for batch in held:
                number = np.array(numbers[begin:begin + batch.num_rows], np.int64)
                offset = np.array(offsets[begin:begin + batch.num_rows], np.int64)
                begin += batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(number + base), pa.array(offset), pa.array(~unfinished[number])], names=schema.names)
        return run

    done, n, round_number = None, todo.count(), 0
    while True:
        tasks = max(1, -(-n // task_pieces))
        spread = todo.withColumn("__deal", F.xxhash64(F.col(key), F.lit(round_number)))
        ordered = spread.repartition(tasks, "__deal").sortWithinPartitions(F.col("length").desc(), key).drop("__deal")
        packed = scratch_table(ordered.mapInArrow(dealt(round_number, tasks == 1), schema), "packed")
        made = packed.filter("__final")
        done = made if done is None else done.unionByName(made)
        rest = packed.filter("NOT __final").select(*own(todo))
        before, n = n, rest.count()
        if not round_number:
            forget(todo)
        if not n:
            break
        if 2 * n > before:  # pieces that hardly go together: as they are
            done = done.unionByName(packed.filter("NOT __final"))
            break
        todo, round_number = rest, round_number + 1
    return done.select(*[c for c, name in zip(own(done), done.columns) if name not in (key, "__final")])


def assemble(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``n_pieces`` and ``ids`` (binary) of every sequence of ``packed`` rows with their ``ids``: a
    sequence's pieces, at most its size, are joined in the order of their offsets."""
    together = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_pieces"), together.alias("p")).select(
        "sequence_id", "n_pieces", F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, by_words: bool = False) -> DataFrame:
    """Pieces of all documents with their place and the CRC-32 of their ids: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = pieces(texts, tokenizer, size, end, by_words)
    return pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), size)
