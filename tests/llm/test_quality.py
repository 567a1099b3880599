import re
from collections import Counter
from math import log

import numpy as np
import pytest

from servicelens.llm import quality as Q
from servicelens.llm.common import scratch_table, table

from . import data


def plain_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def plain_failed(m):
    return m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]


@pytest.fixture(scope="module")
def small(spark):
    return [table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels")]


def test_measures_and_verdicts(spark, small):
    docs, labels = small
    ratios = scratch_table(Q.ratio_table(docs, labels.filter("quality = 1"), buckets=1 << 10), "ratios")
    got = data.collected(Q.quality_verdicts(docs, ratios, buckets=1 << 10))
    texts = {r["doc_id"]: r["text"] for r in data.collected(docs)}
    good = {r["doc_id"] for r in data.collected(labels) if r["quality"] == 1}
    # buckets by Spark's hash, everything else by hand
    vocabulary = sorted({w for t in texts.values() for w in re.findall(r"[^\x20\x09-\x0D]+", t)})
    words = spark.createDataFrame([(w,) for w in vocabulary], "w string")
    hashes = {r["w"]: r["h"] for r in words.selectExpr("w", "xxhash64(w) AS h").collect()}
    seqs = {d: [hashes[w] for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for d, t in texts.items()}
    pairs = sorted({p for s in seqs.values() for p in zip(s, s[1:])})
    two = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame(pairs, "a long, b long").selectExpr("a", "b", "xxhash64(a, b) AS h").collect()}
    buckets = {d: [h % 1024 for h in s] + [two[p] % 1024 for p in zip(s, s[1:])] for d, s in seqs.items()}
    raw = Counter(b for x in buckets.values() for b in x)
    target = Counter(b for d, x in buckets.items() if d in good for b in x)
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def ratio(b):
        p = (raw[b] + 1) / (n_raw + 1024)
        return log((target[b] + Q.SMOOTHING * 1024 * p) / (n_target + Q.SMOOTHING * 1024) / p)

    for r in got:
        m = plain_measures(texts[r["doc_id"]])
        assert {k: r[k] for k in m} == m and r["base_failed"] == plain_failed(m)
        x = buckets[r["doc_id"]]
        want = sum(map(ratio, x)) / len(x) if x else 0.0
        assert r["ratio"] == pytest.approx(want, abs=1e-9) and r["kept"] == (not plain_failed(m) and r["ratio"] >= Q.LEAST_RATIO)


def test_repeated_windows(spark):
    block = data.words(9, 1)
    texts = [" ".join(["the"] * 30), block + " x " + block, block + " " + block + " " + block, data.words(7, 2) * 2,
             data.words(300, 3) + " " + block + " y " + block, "a b c d e f g h " * 4, data.LONG + " " + data.LONG]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ratios = scratch_table(Q.ratio_table(docs, docs.limit(1), buckets=64), "ratios")
    for r in data.collected(Q.quality_verdicts(docs, ratios, buckets=64)):
        m = plain_measures(texts[r["doc_id"]])
        assert {k: r[k] for k in m} == m


def test_good_documents_are_kept_and_bad_ones_go(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    judged = {r["doc_id"]: r for r in data.collected(Q.quality_verdicts(docs, Q.learn(docs, labels)))}
    known = [(judged[r["doc_id"]], r["quality"]) for r in data.collected(labels)]
    known = [(r, q) for r, q in known if not r["base_failed"]]
    assert all(r["kept"] for r, q in known if q == 1)
    bad = [r["kept"] for r, q in known if q == 0]
    assert sum(bad) < 0.3 * len(bad)


def test_edges(spark, small):
    docs = data.docs(spark)
    got = data.collected(Q.quality_verdicts(docs, Q.learn(docs, small[1])))
    assert len(got) == len(data.ROWS)
    by = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3):
        assert by[i]["n_words"] == 0 and by[i]["base_failed"] and not by[i]["kept"] and by[i]["ratio"] == 0.0
    none = small[1].limit(0)
    assert Q.keep_quality(docs, none).columns == docs.columns  # no target: it is as the corpus, all ratios zero
    assert Q.keep_quality(docs, none).count() == sum(not plain_failed(plain_measures(t)) for _, t in data.ROWS)
    assert Q.keep_quality(data.empty(spark), small[1]).count() == 0


@pytest.mark.parametrize("sf, thin", [("sf0.001", 1), ("sf0.01", 1), ("sf0.01", 4)])
def test_verdicts_at_every_size_and_with_few_labels(spark, sf, thin):
    docs, labels = (table(spark, f"/root/testdata/{sf}", t) for t in ("documents", "labels"))
    given = labels.filter(f"doc_id % {thin} = 0")
    judged = {r["doc_id"]: r for r in data.collected(Q.quality_verdicts(docs, Q.learn(docs, given)))}
    known = [(judged[r["doc_id"]], r["quality"], r["doc_id"] % thin > 0) for r in data.collected(labels)]
    bad = [r["kept"] for r, q, _ in known if q == 0 and not r["base_failed"]]
    assert sum(bad) <= 0.25 * len(bad)
    for unseen in {u for _, _, u in known}:
        good = [r["kept"] for r, q, u in known if q == 1 and u == unseen and not r["base_failed"]]
        assert sum(good) >= 0.85 * len(good)


def test_best_threshold():
    low, high = np.array([-3.0, -2.0]), np.array([-1.0, 1.0])
    assert Q.best_threshold(high, low) == -1.5 and Q.best_threshold(high, low[:0]) == -1.0
    assert Q.best_threshold(high[:0], low) == Q.best_threshold(low, high) == float("-inf")
    assert Q.best_threshold(np.array([-1.0, 1.0, 1.0, 1.0]), np.array([-3.0, -2.0, 0.0])) == 0.5
