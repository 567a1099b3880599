"""Language-model scores: a log-bilinear neural model over a frequent vocabulary, with exact counts behind it.

A text is its lower-cased (A-Z) words and one end token.  The most frequent ``VOCABULARY`` tokens
are predicted by a log-bilinear model: the two preceding tokens' vectors add up to a predicted
vector, whose product with every output vector, plus a bias, is that token's logit.  All other tokens are one
class of it; inside the class a token has probability (c + 1) / (sum of c + distinct + 1).  Together that is
one normalised distribution over all tokens, seen or not.

* Counts are taken over all training documents, combined map-side, and stay distributed.  Only the
  ``FREQUENT`` most frequent are broadcast; counts of all others reach the documents by a join.
* Training is noise-contrastive: every partition runs minibatches over all its training tokens from the
  shared parameters, and their token-weighted mean starts the next round.
* Scoring multiplies the distinct contexts of a batch with all output vectors and normalises.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_table

#: Tokens that the neural model tells apart (the end token is one of them).
VOCABULARY = 1024
#: Tokens whose counts are broadcast.
FREQUENT = 131_072
DIMENSION, ROUNDS, BATCH = 16, 2, 1024
#: Noise samples: their weight against one datum, and how many a minibatch shares.
NOISE_RATIO, NOISE_SHARED = 16, 64
RATE = 0.07
#: The end token: no word has a space.
END = b" "
#: Tokens that are worked on at once (a longer text is worked on alone).
CHUNK = 1 << 20


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def is_held_out(doc_id) -> "Column":  # noqa: F821
    """Documents whose crc32 of the id as text has remainder 2 by 7 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def token_counts(texts: DataFrame) -> DataFrame:
    """``token`` (binary) and ``c`` over all rows of ``texts`` (one column of texts)."""
    schema = pa.schema([("token", pa.binary()), ("c", pa.int64())])

    def count(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                bag: Counter = Counter()
                for t in whole.column(0).slice(begin, 2000).to_pylist():
                    bag.update(tokens_of(t))
                yield pa.RecordBatch.from_arrays([pa.array(list(bag), pa.binary()), pa.array(list(bag.values()), pa.int64())],
                                                 schema=schema)

    return texts.mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Classes and counts of the frequent tokens; totals over all training tokens."""

    counts: dict[bytes, int]
    classes: dict[bytes, int]
    class_counts: np.ndarray
    total: int
    distinct: int

    @property
    def other(self) -> int:
        """The class of all tokens outside the vocabulary."""
        return len(self.classes)

    @property
    def start(self) -> int:
        """What stands before a text, in contexts only."""
        return len(self.classes) + 1

    @property
    def other_total(self) -> int:
        """Denominator of the counts inside the class of all others."""
        inside = sum(self.counts[w] for w in self.classes if w in self.counts)
        seen = sum(1 for w in self.classes if w in self.counts)
        return (self.total - inside) + (self.distinct - seen) + 1


def lexicon(counts: DataFrame) -> Lexicon:
    """From the written table of ``token_counts``; at most FREQUENT rows reach the driver.

    The frequent tokens are those from a count on, the least step of a sixteenth octave that leaves no more
    than FREQUENT of them: steps are counted first, so no task sends what the driver would throw away."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    step, least, room = F.floor(F.log2("c") * 16), None, FREQUENT
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    rows = counts.filter(step >= least).collect() if least is not None else []
    rows.sort(key=lambda r: (-r["c"], bytes(r["token"])))
    rows += counts.filter(F.col("token") == F.lit(bytearray(END))).collect()
    known = {bytes(r["token"]): r["c"] for r in rows}
    words = [w for w in known if w != END][: VOCABULARY - 1]
    classes = {w: i for i, w in enumerate([END, *words])}
    inside = np.array([known.get(w, 0) for w in classes], np.float64)
    return Lexicon(known, classes, np.append(inside, total - inside.sum()) + 1.0, total, distinct)


def encode(docs: DataFrame, shared) -> DataFrame:
    """Every document by classes: ``row``, ``doc_id``, ``held_out``, ``n_tokens``, ``ids`` (16-bit classes),
    ``n_known`` and ``log_counts`` (of frequent tokens: number, and sum of log10 (c + 1)), ``n_other`` (tokens outside
    the vocabulary), ``other_log_counts`` (of the frequent ones among these), ``rare`` (the tokens that are not
    frequent, whose counts the driver does not know)."""
    schema = ("row long, doc_id long, held_out boolean, n_tokens long, ids binary, n_known long, log_counts double, "
              "n_other long, other_log_counts double, rare array<binary>")
    arrow = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                       ("ids", pa.binary()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("n_other", pa.int64()),
                       ("other_log_counts", pa.float64()), ("rare", pa.list_(pa.binary()))])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        lex = shared.value
        # frequent tokens by rank: the vocabulary first, so that a rank below its size is a class
        order = [*lex.classes, *(w for w in lex.counts if w not in lex.classes)]
        rank = {w: i for i, w in enumerate(order)}
        logs = np.array([log10(lex.counts.get(w, 0) + 1) for w in order])
        n_classes, known = len(lex.classes), np.array([lex.counts.get(w, 0) > 0 for w in order])
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                out = [[] for _ in range(7)]
                for text in batch.column(3).to_pylist():
                    tokens = tokens_of(text)
                    at = np.array([rank.get(w, -1) for w in tokens], np.int64)
                    found = at[at >= 0]
                    inside = found < n_classes
                    ids = np.where((at >= 0) & (at < n_classes), at, n_classes).astype("<u2")
                    out[0].append(len(tokens))
                    out[1].append(ids.tobytes())
                    out[2].append(int(known[found].sum()))
                    out[3].append(float(logs[found].sum()))
                    out[4].append(len(tokens) - int(inside.sum()))
                    out[5].append(float(logs[found[~inside]].sum()))
                    out[6].append([tokens[i] for i in np.nonzero(at < 0)[0]] if len(found) < len(at) else [])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], *(pa.array(x, f.type) for x, f in zip(out, list(arrow)[3:]))], schema=arrow)

    return rows.mapInArrow(run, schema)


class Model:
    """Log-bilinear model: R1, R2 (vectors of the last and the last but one token), Q and b (outputs)."""

    def __init__(self, n_outputs: int, class_counts: np.ndarray, dimension: int = DIMENSION, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.noise = class_counts / class_counts.sum()
        self.shapes = [(n_outputs + 1, dimension), (n_outputs + 1, dimension), (n_outputs, dimension), (n_outputs,)]
        self.params = [rng.normal(0, 0.1, s).astype(np.float32) for s in self.shapes[:3]]
        self.params.append(np.log(self.noise).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    def with_flat(self, flat: np.ndarray) -> Model:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        self.params = [flat[e - int(np.prod(s)):e].astype(np.float32).reshape(s) for e, s in zip(ends, self.shapes)]
        return self

    def log_probabilities(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of all outputs, one row per context."""
        r1, r2, q, b = self.params
        logits = (r1[last] + r2[before]) @ q.T
        logits += b
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def contexts(ids: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last, last but one, target) of every token of some texts."""
    target = np.concatenate(ids)
    first = np.cumsum([0, *(len(x) for x in ids[:-1])])
    last = np.concatenate([[start], target[:-1]]).astype(np.uint16)
    last[first] = start
    before = np.concatenate([[start], last[:-1]]).astype(np.uint16)
    before[first] = start
    return last, before, target


def chunks(values: list[bytes]):
    """Encoded texts in runs of about CHUNK tokens."""
    run, size = [], 0
    for v in values:
        ids = np.frombuffer(v, "<u2")
        if run and size + len(ids) > CHUNK:
            yield run
            run, size = [], 0
        run.append(ids)
        size += len(ids)
    if run:
        yield run


def _scatter(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``rows`` by ``at``, as n rows."""
    width = rows.shape[1]
    cells = (at[:, None] * width + np.arange(width)).ravel()
    return np.bincount(cells, rows.ravel(), n * width).reshape(n, width).astype(np.float32)


def _falling(x: np.ndarray) -> np.ndarray:
    """1 / (1 + e^x), in place."""
    np.minimum(x, 80, out=x)  # the largest that a 32-bit float can take
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive minibatches with AdaGrad steps on one partition."""

    def __init__(self, model: Model, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.squares = [np.full(p.shape, 1.0, np.float32) for p in model.params]
        self.log_noise = np.log(NOISE_RATIO * model.noise).astype(np.float32)
        self.cumulative = np.cumsum(model.noise)
        self.seen = 0

    def step(self, last: np.ndarray, before: np.ndarray, target: np.ndarray) -> None:
        r1, r2, q, b = self.m.params
        p = r1.take(last, axis=0)
        p += r2.take(before, axis=0)
        qt = q.take(target, axis=0)
        data = _falling((p * qt).sum(axis=1) + b[target] - self.log_noise[target])
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE_SHARED)), len(b) - 1)
        qn = q.take(noise, axis=0)
        other = _falling((self.log_noise[noise] - b[noise]) - p @ qn.T)
        other *= np.float32(NOISE_RATIO / NOISE_SHARED)
        qt *= data[:, None]
        qt -= other @ qn  # gradient of the predicted vectors
        both = np.concatenate([target, noise])
        dq = _scatter(np.concatenate([data[:, None] * p, -(other.T @ p)]), both, len(q))
        db = np.bincount(both, np.concatenate([data, -other.sum(axis=0)]), len(b)).astype(np.float32)
        for param, square, grad in zip(self.m.params, self.squares, (
                _scatter(qt, last, len(r1)), _scatter(qt, before, len(r2)), dq, db)):
            square += grad * grad
            grad *= np.float32(RATE)
            grad /= np.sqrt(square)
            param += grad
        self.seen += len(target)

    def learn(self, ids: list[np.ndarray], start: int) -> None:
        texts = contexts(ids, start)
        order = self.rng.permutation(len(texts[0]))
        last, before, target = (x[order].astype(np.intp) for x in texts)
        for i in range(0, len(order), BATCH):
            self.step(last[i:i + BATCH], before[i:i + BATCH], target[i:i + BATCH])


def train(encoded: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Model:
    """Parameters after ``rounds`` passes over all training rows of ``encoded``.

    A partition returns one vector of fixed length; vectors are summed by position on the executors
    and only their mean reaches the driver."""
    spark = encoded.sparkSession
    model = Model(lex.other + 1, lex.class_counts)
    start = lex.start
    rows = encoded.filter("NOT held_out").select("ids")
    schema = pa.schema([("weight", pa.float64()), ("flat", pa.list_(pa.float32()))])
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared, r=r):
            given = shared.value
            own = Model(given.shapes[2][0], given.noise).with_flat(given.flat())
            trainer = Trainer(own, seed=1000 * r + TaskContext.get().partitionId())
            for batch in batches:
                for ids in chunks(batch.column(0).to_pylist()):
                    trainer.learn(ids, start)
            if trainer.seen:
                yield pa.RecordBatch.from_arrays([pa.array([float(trainer.seen)]), pa.array([own.flat()], pa.list_(pa.float32()))],
                                                 schema=schema)

        local = rows.mapInArrow(run, "weight double, flat array<float>")
        summed = local.select("weight", F.posexplode("flat")).groupBy("pos").agg(
            (F.sum(F.col("weight") * F.col("col")) / F.sum("weight")).alias("value"))
        mean = {x["pos"]: x["value"] for x in summed.collect()}  # as many as the model has parameters
        if mean:
            model = Model(lex.other + 1, lex.class_counts).with_flat(np.array([mean[i] for i in range(len(mean))]))
    return model


def neural_scores(encoded: DataFrame, model: Model, start: int) -> DataFrame:
    """``row`` and ``neural``: log10 probability of the classes of every text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("row", pa.int64()), ("neural", pa.float64())])

    def run(batches):
        m = shared.value
        for batch in batches:
            out = []
            for ids in chunks(batch.column(1).to_pylist()):
                last, before, target = contexts(ids, start)
                code = last.astype(np.uint32) << 16 | before
                order = np.argsort(code)
                code = code[order]
                begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                size = np.diff(np.append(begin, len(code)))
                score = np.empty(len(target))
                for i in range(0, len(begin), 4096):
                    some = code[begin[i:i + 4096]]
                    table = m.log_probabilities(some >> 16, some & 0xFFFF)
                    n = size[i:i + 4096]
                    at = order[begin[i]:begin[i] + n.sum()]
                    score[at] = table[np.repeat(np.arange(len(n)), n), target[at]]
                out.append(np.add.reduceat(score, np.cumsum([0, *(len(x) for x in ids[:-1])])) / np.log(10))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], schema=schema)

    return encoded.select("row", "ids").mapInArrow(run, "row long, neural double")


def rare_scores(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """``row``, ``rare_known`` and ``rare_log_counts`` of the tokens that are not frequent.

    No training token among them is hot; one that only held-out texts repeat may be, and makes a partition of this
    join that adaptive execution may split."""
    tokens = encoded.select("row", F.explode("rare").alias("token"))
    found = tokens.join(counts, "token")
    return found.groupBy("row").agg(F.count(F.lit(1)).alias("rare_known"), F.sum(F.log10(F.col("c") + 1)).alias("rare_log_counts"))


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row of ``docs``.

    Learns from the rows that are not held out and scores all.  A null or empty text is the end token
    alone.  A null id counts as the empty text for the split.  With no training rows all counts are
    zero and the model keeps its initial parameters.  Repeated rows are learnt and scored as
    often as given; extra columns are ignored."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = scratch_table(token_counts(docs.filter(~is_held_out(F.col("doc_id"))).select(F.col("text").cast("string"))), "counts")
    lex = lexicon(counts)
    encoded = scratch_table(encode(docs, spark.sparkContext.broadcast(lex)), "encoded")
    model = train(encoded, lex)
    rare = rare_scores(encoded, counts)
    neural = neural_scores(encoded, model, lex.start)
    everything = encoded.drop("ids", "rare").join(neural, "row").join(rare, "row", "left")
    rare_known, rare_logs = F.coalesce("rare_known", F.lit(0)), F.coalesce("rare_log_counts", F.lit(0.0))
    return everything.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + rare_known).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + rare_logs - F.col("n_tokens") * F.lit(log10(lex.total + lex.distinct + 1))).alias("base_score"),
        (F.col("neural") + F.col("other_log_counts") + rare_logs - F.col("n_other") * F.lit(log10(lex.other_total))).alias("score"))
