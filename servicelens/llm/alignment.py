"""Alignment of the tokens of two tokenizers over the same bytes.

Both tokenizers encode the whole text.  Where the joined bytes of both are the text's (checked byte by byte), the byte
offsets at which a token of either ends and a space-marked token of either begins are anchors: they cut the document
into windows of token ids, mostly a word long.  What stands in a window depends on its two id tuples alone, so its groups
and links are worked out once and kept in a memo under these tuples.  A group is what stands between two neighbouring
common ends; a link is a pair of token occurrences whose byte ranges overlap.

Corpus statistics of the linked id pairs come from the written table of per-document counts: counts are summed in every
task before they are shuffled, the frequent pairs (a bounded number) are broadcast, and the rare ones, of which no pair
has many rows, are joined.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Decoder
from .common import forget, fresh, mix64, scratch_table, without
from .subwords import ODD_SPACE, SPACED_CHUNKS, Chunked, Store, Subwords, broadcast_file, in_worker, portions, ranges

#: Windows that the memo holds before it is begun anew.
MEMO_WINDOWS = 200_000
#: Id pairs whose counts are broadcast (17 bytes each).
FREQUENT_PAIRS = 1 << 18
#: Ids a side of a window that is packed.
_PACKED = 8
#: Entries of per-document counts that a task sums at once.
_SUM = 1 << 21


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the
    others, in order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Tokenizer A: a byte-level vocabulary of the ``tokenizers`` library."""

    def __init__(self, definition: bytes):
        subwords, alphabet = Subwords(definition.decode(), plain_special=True), byte_level_alphabet()
        added = {t["id"] for t in json.loads(definition)["added_tokens"]}
        self.encode = subwords.encode
        self.bytes_of = {i: t.encode() if i in added else bytes(map(alphabet.__getitem__, t))
                         for t, i in subwords.tokenizer.get_vocab(with_added_tokens=True).items()}


class Pieces:
    """Tokenizer B: a ``sentencepiece`` model, which itself puts a space in front of a text."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes_of = {i: bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)}
        #: no piece goes on with a space mark behind another character, so nothing is merged across the start of a run of spaces
        self.apart = all("\u2581" not in p.lstrip("\u2581") for p in names)
        self.space = [self.model.piece_to_id("\u2581")]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Of texts that begin with a space, which is the one that the model puts there; alone it leaves it out."""
        return [ids if len(t) > 1 else self.space for t, ids in zip(texts, self.model.encode([t[1:] for t in texts], num_threads=1))]


class Side:
    """Bytes of the tokens of one side."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.decoder = Decoder(bytes_of)
        self.size = self.decoder.size
        self.spaced = np.array([bytes_of.get(i, b"")[:1] == b" " for i in range(len(self.size))])

    def covers(self, ids: np.ndarray, data: bytes) -> bool:
        size = self.size[ids]
        return int(size.sum()) == len(data) and bool((size > 0).all()) and self.decoder.decode(ids) == data


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``ends``."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends]).astype(np.int64)])


class Aligner:
    """Groups and links of whole documents through a memo of windows, keyed by the id tuples of both sides.

    The memo holds places in two stores: the ids of a window in the order they are shown, with what stands behind each, and
    its linked pairs.  Tuples of up to _PACKED ids a side, nearly all, are kept as 16-bit numbers, so that equal ones of a
    portion of texts are found by arrays."""

    def __init__(self, a, b):
        self.a, self.b = Side(a.bytes_of), Side(b.bytes_of)
        n_a, n_b = len(self.a.size), len(self.b.size)
        #: codes: an id of A inside a group, at its end; an id of B inside, at its end
        self.shown = [f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)]
        self.group_end = 2 * n_a + n_b
        self.packs = max(n_a, n_b) < 1 << 16
        self.chunked = Chunked(SPACED_CHUNKS if b.apart else None, [a.encode, b.encode], whole=ODD_SPACE)
        self.clear()

    def clear(self) -> None:
        self.memo: dict = {}
        self.codes, self.links = Store(), Store()

    def work_out(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        """Store new windows, given by their ids one after another.

        A window's sides end together, so over all windows the ends of either side are offsets of one byte string.  Every
        distinct end closes the stretch of bytes that one pair of tokens shares: a link; a common end closes a group."""
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        at_b = np.searchsorted(end_b, end_a)
        close_a = end_b[at_b] == end_a
        close_b = np.zeros(len(b), bool)
        close_b[at_b[close_a]] = True
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        ends = ends[np.diff(ends, prepend=0) > 0]
        link = a[np.searchsorted(end_a, ends)] << 32 | b[np.searchsorted(end_b, ends)]
        # of each group the ids of A, then those of B
        group_a, group_b = (np.cumsum(c) - c for c in (close_a, close_b))
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + close_a * len(self.a.size)
        code[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * len(self.a.size) + b + close_b * len(self.b.size)
        self.codes.add(code, n_a + n_b)
        self.links.add(link, np.diff(np.searchsorted(ends, end_a[np.cumsum(n_a) - 1], "right"), prepend=0))

    def places(self, a: np.ndarray, start_a: np.ndarray, n_a: np.ndarray, b: np.ndarray, start_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Places in the stores of the windows that begin at ``start`` and have ``n`` ids on either side."""
        index = np.empty(len(start_a), np.int64)
        small = (n_a <= _PACKED) & (n_b <= _PACKED) & self.packs
        at = np.flatnonzero(small)
        rows = np.zeros((len(at), 2 * _PACKED), np.uint16)
        for side, (ids, start, n) in enumerate(((a, start_a[at], n_a[at]), (b, start_b[at], n_b[at]))):
            for k in range(_PACKED):
                has = np.flatnonzero(n > k)
                rows[has, side * _PACKED + k] = ids[start[has] + k] + 1
        # equal tuples have equal hashes; that equal hashes are equal tuples is looked at
        parts = rows.view(np.uint64)
        key = np.zeros(len(at), np.uint64)
        for k in range(parts.shape[1]):
            key = mix64(key + parts[:, k])
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        names, examples, known = [], [], {}
        if (parts == parts[first[inverse]]).all():
            names = rows[first].view(f"V{4 * _PACKED}").ravel().tolist()
            examples = at[first].tolist()
            index[at] = inverse
            rest = np.flatnonzero(~small)
        else:
            rest = np.arange(len(index))
        for w, f, n, g, m in zip(rest.tolist(), *(x[rest].tolist() for x in (start_a, n_a, start_b, n_b))):
            name = tuple(a[f:f + n].tolist()), tuple(b[g:g + m].tolist())
            k = known.get(name)
            if k is None:
                k = known[name] = len(names)
                names.append(name)
                examples.append(w)
            index[w] = k
        new = [k for k, name in enumerate(names) if name not in self.memo]
        if new:
            w = np.array(examples, np.int64)[new]
            base = len(self.codes.first)
            self.work_out(a[ranges(start_a[w], n_a[w])], n_a[w], b[ranges(start_b[w], n_b[w])], n_b[w])
            self.memo.update((names[k], base + i) for i, k in enumerate(new))
        return np.fromiter(map(self.memo.__getitem__, names), np.int64, len(names))[index]

    def run(self, texts: list[str]) -> list[tuple]:
        """Of every text the numbers of tokens, groups and links, the groups as text, the distinct linked pairs and how
        often each is linked.  All are zero or empty for a text that one side does not give back."""
        if len(self.memo) > MEMO_WINDOWS:
            self.clear()
        (a, count_a), (b, count_b) = self.chunked.ids([" " + t if t else "" for t in texts])
        data = [(" " + t).encode() if t else b"" for t in texts]
        whole, size = b"".join(data), np.array([len(d) for d in data], np.int64)
        fits = [side.covers(ids, whole) and bool((_sums(side.size[ids], np.cumsum(count)) == size).all())
                for side, ids, count in ((self.a, a, count_a), (self.b, b, count_b))]
        none = np.zeros(0, np.int64)
        out: list = [(0, 0, 0, 0, "", none, none)] * len(texts)
        if not all(fits):
            # which of the texts do not fit is seen one by one; the others go on
            ids_a, ids_b = np.split(a, np.cumsum(count_a)[:-1]), np.split(b, np.cumsum(count_b)[:-1])
            good = [i for i, d in enumerate(data) if d and self.a.covers(ids_a[i], d) and self.b.covers(ids_b[i], d)]
            a, b = (np.concatenate([none, *(ids[i] for i in good)]) for ids in (ids_a, ids_b))
            count_a, count_b = count_a[good], count_b[good]
        else:
            good = [i for i, d in enumerate(data) if d]
            count_a, count_b = count_a[good], count_b[good]
        if not good:
            return out
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        at_b = np.searchsorted(end_b, end_a)
        i = np.flatnonzero(end_b[at_b] == end_a)
        j = at_b[i]
        # a common end is an anchor where both sides go on with a token that begins with a space, as every text does
        marked = self.a.spaced[a[i[:-1] + 1]] & self.b.spaced[b[j[:-1] + 1]]
        cut = np.append(np.flatnonzero(marked), len(i) - 1)
        to_a, to_b = i[cut] + 1, j[cut] + 1
        start_a, start_b = (np.concatenate([[0], to[:-1]]) for to in (to_a, to_b))
        places = self.places(a, start_a, to_a - start_a, b, start_b, to_b - start_b)
        codes, _ = self.codes.take(places)
        links, n_links = self.links.take(places)
        windows = np.searchsorted(to_a, np.cumsum(count_a)) + 1  # up to the end of every text
        of_links = np.cumsum(_sums(n_links, windows)).tolist()
        tokens = count_a + count_b
        groups = _sums(codes >= self.group_end, np.cumsum(tokens)).tolist()
        shown = list(map(self.shown.__getitem__, codes.tolist()))
        ends = np.cumsum(tokens).tolist()
        for k, t in enumerate(good):
            linked = links[of_links[k - 1] if k else 0:of_links[k]]
            text = "".join(shown[ends[k - 1] if k else 0:ends[k]])[:-1]
            out[t] = (int(count_a[k]), int(count_b[k]), groups[k], len(linked), text, *np.unique(linked, return_counts=True))
        return out


_MADE = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()),
         ("groups", T.StringType()), ("pairs", T.ArrayType(T.LongType())), ("links", T.ArrayType(T.LongType()))]


def align(docs: DataFrame, byte_level: str, pieces: str, text: str = "text") -> DataFrame:
    """``docs`` with the alignment of the tokens of both vocabulary files in place of ``text``: ``n_a``, ``n_b``,
    ``n_groups``, ``n_links``, ``groups`` (``a1,a2|b1;a3|b2``, ids in order), ``pairs`` (distinct linked id pairs, A's id
    in the upper 32 bits) and ``links`` (how many links each has).

    A null or empty text, and one that either side's tokens do not give back (a character that stands for the space of
    B, for instance), has no tokens: zeros, no groups, no pairs.  Special tokens of A inside a text are plain text.  Other
    columns are passed on, but for one that is named like a new one, which gives way.  Repeated rows are aligned each; an
    empty table gives no rows."""
    docs, spark = without(docs, *(name for name, _ in _MADE)), docs.sparkSession
    files = broadcast_file(spark, byte_level), broadcast_file(spark, pieces)
    at = docs.columns.index(text)
    rest = [f for f in docs.schema.fields if f.name != text]
    key = ("align", byte_level, pieces)

    def run(batches):
        aligner = in_worker(key, lambda: Aligner(ByteLevel(files[0].value), Pieces(files[1].value)))
        for whole in batches:
            for batch in portions(whole, at):
                out = list(zip(*aligner.run([t or "" for t in batch.column(at).to_pylist()])))
                made = [pa.array(x, pa.int64()) for x in out[:4]] + [pa.array(out[4], pa.string())]
                ends = np.cumsum([0, *map(len, out[5])]).astype(np.int32)
                made += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x))) for x in out[5:]]
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), *made],
                                                 names=[*(f.name for f in rest), *(n for n, _ in _MADE)])

    return docs.mapInArrow(run, T.StructType(rest + [T.StructField(n, t) for n, t in _MADE]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``count`` and ``best`` (no other pair of its B id has a higher count) of all linked id pairs; written."""
    def add(batches):
        held, size = [], 0

        def summed():
            pairs, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, place, np.concatenate([c for _, c in held]))
            return pairs, total

        def out(pairs, total):
            for i in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i:i + (1 << 16)]) for x in (pairs, total)], names=["pair", "count"])

        for batch in batches:
            held.append(tuple(batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(2)))
            size += len(held[-1][0])
            if size > _SUM:
                held = [summed()]
                size = len(held[0][0])
                if size > _SUM // 2:
                    yield from out(*held.pop())
                    size = 0
        if held:
            yield from out(*summed())

    sums = aligned.select("pairs", "links").mapInArrow(add, "pair long, count long")
    counts = scratch_table(sums.groupBy("pair").agg(F.sum("count").alias("count")), "pairs")
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    # one row per id of B: no more than its vocabulary has
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("top"))
    ranked = counts.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    table = scratch_table(ranked, "pairs")
    forget(counts)
    return table


def frequent_pairs(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (sorted), counts and ``best`` of the pairs from a count on: the least step of a sixteenth octave that leaves
    no more than FREQUENT_PAIRS.  Steps are counted first, so no task sends what the driver would throw away."""
    step, least, room = F.floor(F.log2("count") * 16), None, FREQUENT_PAIRS
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    if least is None:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool))
    rows = counts.filter(step >= least).toArrow().sort_by("pair")
    return tuple(rows.column(i).to_numpy() for i in range(3))


def link_statistics(aligned: DataFrame) -> DataFrame:
    """``aligned`` (of ``align``; with or without ``groups``) with ``n_best`` (links whose pair is the most linked of its B
    id in the corpus, ties included) and ``count_sum`` (of the corpus counts of all links) in place of the pairs.

    Every row counts, repeated ones too; rows without tokens have zeros.  Columns named like the new ones give way."""
    aligned = without(aligned, "n_best", "count_sum")
    spark, row = aligned.sparkSession, fresh(aligned, "__row")
    rest = [f for f in aligned.schema.fields if f.name not in ("pairs", "links")]
    table = scratch_table(aligned.select(F.monotonically_increasing_id().alias(row), *["`%s`" % f.name for f in rest], "pairs", "links"), "aligned")
    counts = pair_counts(table)
    shared = spark.sparkContext.broadcast(frequent_pairs(counts))
    n = len(rest) + 1

    def look_up(batch):
        """Row of every entry, its pair and links, and its place among the frequent ones (-1: none)."""
        known = shared.value[0]
        lists, links = batch.column(n), batch.column(n + 1)
        size = np.diff(lists.offsets.to_numpy())
        pair, link = lists.flatten().to_numpy(zero_copy_only=False), links.flatten().to_numpy(zero_copy_only=False)
        place = np.searchsorted(known, pair)
        found = np.append(known, -1)[place] == pair if len(known) else np.zeros(len(pair), bool)
        return np.repeat(np.arange(len(size)), size), pair, link, np.where(found, place, -1)

    def known_part(batches):
        for batch in batches:
            at, _, link, place = look_up(batch)
            _, count, best = shared.value
            ok = place >= 0
            sums = []
            for values in (best, count):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, at[ok], link[ok] * values[place[ok]])
                sums.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *sums], names=[*batch.schema.names[:n], "n_best", "count_sum"])

    def rare_part(batches):
        for batch in batches:
            at, pair, link, place = look_up(batch)
            rare = place < 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[rare])), pa.array(pair[rare]), pa.array(link[rare])],
                                             names=["row", "pair", "link"])

    made = [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]
    base = table.mapInArrow(known_part, T.StructType([*table.schema.fields[:n], *made]))
    rare = (table.select(row, *table.columns[1:]).mapInArrow(rare_part, "row long, pair long, link long").join(counts, "pair")
            .groupBy("row").agg(F.sum(F.col("link") * F.col("best").cast("long")).alias("more_best"),
                                F.sum(F.col("link") * F.col("count")).alias("more_count")))
    rare = rare.withColumnsRenamed({"row": row})
    more = lambda total, part: (F.col(total) + F.coalesce(F.col(part), F.lit(0))).alias(total)
    return base.join(rare, row, "left").select(*["`%s`" % f.name for f in rest], more("n_best", "more_best"), more("count_sum", "more_count"))


def alignment_digests(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """One row per row of ``docs``: counts, link statistics and the digest of the groups ('' without tokens)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shown = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = align(texts, byte_level, pieces).select("doc_id", "n_a", "n_b", "n_groups", "n_links", shown, "pairs", "links")
    return link_statistics(aligned)
