import random

from servicelens.llm import decontaminate as D
from servicelens.llm.common import table

from . import data


def plain_leaks(text, items, least=0.8, k=5):
    words, out = D.words_of(text), {}
    for item, t in items:
        w = D.words_of(t)
        if not w or not words:
            continue
        size, bag = min(len(w), len(words)), D.shingles(w, k)
        for s in range(len(words) - size + 1):
            v = D.weighted_similarity(D.shingles(words[s:s + size], k), bag)
            if v >= least and v > out.get(item, (0,))[0]:
                out[item] = (v, s, s + size)
    return out


def test_matches_brute_force(spark):
    docs, bench = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    items = [(r["item_id"], r["text"]) for r in data.collected(bench)]
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"], r["end_word"]) for r in data.collected(D.benchmark_leaks(docs, bench))}
    want = {}
    for r in data.collected(docs):
        shared = {s for _, t in items for s in D.shingles(D.words_of(t), 5)}
        if shared & set(D.shingles(D.words_of(r["text"]), 5)):
            want |= {(r["doc_id"], i): v for i, v in plain_leaks(r["text"], items).items()}
    assert got == want and got


def test_near_copies_are_found():
    rng = random.Random(3)
    items = [(i, data.words(rng.randint(25, 60), 100 + i)) for i in range(40)] + [(90, "one two"), (91, ""), (92, None)]
    index = D.ItemIndex(items, 5, 0.8)
    for n in range(120):
        item, text = items[n % 40]
        w = text.split()
        if n % 3:
            w[rng.randrange(len(w))] = "changed"
        if n % 4 == 1:
            w.insert(rng.randrange(len(w)), "added")
        doc = data.words(rng.randint(0, 50), 1000 + n) + " " + " ".join(w).upper() + " " + data.words(rng.randint(0, 50), 2000 + n)
        assert {r[0]: r[1:] for r in index.search(doc)} == plain_leaks(doc, items)
    assert [r[0] for r in index.search("x ONE two y")] == [90] and index.search(None) == [] and index.search("") == []


def test_block_index_guarantees_the_radius():
    import numpy as np
    index = D.ItemIndex([(i, data.words(30, i)) for i in range(30)], 5, 0.8)
    rng = random.Random(2)
    for _ in range(200):
        n, r = rng.randrange(30), rng.randint(0, D.RADIUS)
        print_ = int(index.prints[n]) ^ sum(1 << b for b in rng.sample(range(64), r))
        assert n in index._near(np.array([print_], np.uint64), 30)[:, 1]


def test_edges(spark):
    bench = spark.createDataFrame([(1, data.PASSAGE), (2, None), (3, ""), (1, data.PASSAGE), (4, data.PASSAGE)], "item_id long, text string")
    docs = data.docs(spark)
    got = data.collected(D.benchmark_leaks(docs, bench))
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(9, 1), (9, 4), (10, 1), (10, 4)]
    kept = D.drop_leaking(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(data.ROWS) - 2
    assert D.benchmark_leaks(data.empty(spark), bench).count() == 0
    assert D.benchmark_leaks(docs, bench.limit(0)).count() == 0 and D.drop_leaking(docs, bench.limit(0)).count() == len(data.ROWS)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, bench = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, D.benchmark_leaks(docs, bench).collect()))
    monkeypatch.setattr(D, "ITEMS_PER_BLOCK", 16)
    assert sorted(map(tuple, D.benchmark_leaks(docs, bench).collect())) == whole
