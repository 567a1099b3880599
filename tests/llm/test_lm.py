import math
import zlib
from collections import Counter

import numpy as np
import pytest

from servicelens.llm import lm as L
from servicelens.llm.common import scratch_table, table

from . import data


def held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def plain(rows):
    """(base score, n_tokens, n_known, train tokens) of every row."""
    c = Counter(w for d, t in rows if not held_out(d) for w in L.tokens_of(t))
    n, v = sum(c.values()), len(c)
    return [(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in L.tokens_of(t)), len(L.tokens_of(t)),
             sum(c[w] > 0 for w in L.tokens_of(t)), n) for _, t in rows]


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"])


def checked(spark, docs, rows):
    got = sorted(data.collected(L.score_documents(docs)), key=key)
    want = sorted(zip(rows, plain(rows)), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1][1]))
    assert len(got) == len(want)
    for r, ((d, _), (base, n, known, total)) in zip(got, want):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (d, n, known, total, held_out(d))
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and math.isfinite(r["score"]) and r["score"] < 0
    return got


def test_base_scores_and_gain(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in data.collected(docs)]
    got = [r for r in checked(spark, docs, rows) if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in got)
    # held-out accuracy: better than the unigram base by a margin
    assert sum(r["score"] for r in got) / tokens > sum(r["base_score"] for r in got) / tokens + 0.03


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(L, "FREQUENT", 40)  # most tokens come by the join
    monkeypatch.setattr(L, "VOCABULARY", 16)
    checked(spark, data.docs(spark), data.ROWS)
    assert L.score_documents(data.empty(spark)).count() == 0
    only = [(i, t) for i, t in enumerate(["a b", "", None]) if True]
    out = [i for i in range(200) if held_out(i)][:3]
    checked(spark, data.docs(spark, [(d, t) for d, (_, t) in zip(out, only)]), [(d, t) for d, (_, t) in zip(out, only)])


def test_one_distribution_over_all_tokens(spark, monkeypatch):
    monkeypatch.setattr(L, "VOCABULARY", 8)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    counts = scratch_table(L.token_counts(docs.select("text")), "counts")
    lex = L.lexicon(counts)
    rng = np.random.default_rng(0)
    model = L.Model(lex.other + 1, lex.class_counts)
    model.with_flat(rng.normal(0, 1, len(model.flat())))
    p = np.exp(model.log_probabilities(np.array([0, 3, lex.start]), np.array([lex.other, 1, lex.start])))
    assert p.sum(axis=1) == pytest.approx(1.0, abs=1e-5)
    others = [r["c"] for r in data.collected(counts) if bytes(r["token"]) not in lex.classes]
    # seen ones, and one share for all that was never seen
    assert sum(c + 1 for c in others) + 1 == lex.other_total


def test_contexts_do_not_cross_texts():
    last, before, target = L.contexts([np.array([5, 6, 0], np.uint16), np.array([0], np.uint16), np.array([7, 0], np.uint16)], 9)
    assert last.tolist() == [9, 5, 6, 9, 9, 7] and before.tolist() == [9, 9, 5, 9, 9, 9] and target.tolist() == [5, 6, 0, 0, 7, 0]


def test_gradient_steps_raise_the_likelihood():
    rng = np.random.default_rng(1)
    ids = [np.array([i, (i + 1) % 6, (i + 2) % 6] * 5, np.uint16) for i in rng.integers(0, 6, 400)]
    counts = np.bincount(np.concatenate(ids), minlength=7) + 1.0
    model = L.Model(7, counts)

    def mean():
        last, before, target = L.contexts(ids, 7)
        return model.log_probabilities(last, before)[np.arange(len(target)), target].mean()

    first = mean()
    trainer = L.Trainer(model, 3)
    for _ in range(4):
        trainer.learn(ids, 7)
    assert mean() > first + 0.5
