import hashlib
import random

import numpy as np
import pytest
import xxhash

from servicelens.llm import simhash as S
from servicelens.llm.common import connected_components, table

from . import data


def plain_simhash(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs, radius=2):
    """pairs: (doc_id, fingerprint); smallest id reachable by fingerprint."""
    prints = sorted({f for _, f in pairs})
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return {f: least.get(find(f)) for f in prints}


def test_fingerprints_and_components_match_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = data.collected(S.simhash_near_duplicates(docs))
    texts = {r["doc_id"]: r["text"] for r in data.collected(docs)}
    pairs = [(d, plain_simhash(t)) for d, t in texts.items()]
    want = plain_components(pairs)
    assert len(got) == len(texts)
    for r in got:
        f = plain_simhash(texts[r["doc_id"]])
        assert r["fingerprint"] == f"{f:016x}" and r["component_id"] == want[f]


def test_edges_and_dropping(spark):
    docs = data.docs(spark)
    got = data.collected(S.simhash_near_duplicates(docs))
    assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(d) for d, _ in data.ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == "0" * 16 and {by[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert by[7]["component_id"] == 6 and by[None]["component_id"] is None
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in data.collected(kept))
    assert ids == [-1, 1, 4, 5, 6, 8, 9, 10, 11, 12, 13]
    assert S.simhash_near_duplicates(data.empty(spark)).count() == 0 and S.drop_near_duplicates(data.empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_shards_lose_no_link(hot):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    near = [base]
    for _ in range(3):
        near.append(near[-1] ^ (np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)))
    if hot:  # a dense ball: many fingerprints within a few bits of one point
        centre = np.uint64(rng.integers(0, 2**63))
        bits = [rng.choice(64, 4, replace=False) for _ in range(2500)]
        near.append(np.array([centre ^ np.uint64(sum(1 << int(b) for b in x)) for x in bits], np.uint64))
    prints = np.unique(np.concatenate(near))
    nodes = S.build_tree(prints[rng.permutation(len(prints))[:640]], 16, 2)
    leaf, row = S.route(prints, nodes, 2)
    links = [S.leaf_links(prints[row[leaf == n]], 2) for n in range(leaf.max() + 1)]
    parent = {int(p): int(p) for p in prints}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        assert len(a) <= len(prints)
        for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist()):
            parent[find(x)] = find(y)
    for i in range(0, len(prints), 512):
        for x, y in zip(*np.nonzero(np.bitwise_count(prints[i:i + 512, None] ^ prints[None, :]) <= 2)):
            assert find(int(prints[x + i])) == find(int(prints[y]))


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    names = {n: int(hashlib.md5(str(n).encode()).hexdigest()[:8], 16) for e in edges for n in e}
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in data.collected(connected_components(
        spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long")))}
    for group in (range(0, 61), range(100, 160), range(200, 203)):
        assert {got[names[n]] for n in group if names[n] != min(names[x] for x in group)} == {min(names[n] for n in group)}
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_fingerprints_take_few_texts_at_a_time():
    class Texts(list):
        def slice(self, i, n):
            assert n <= 256
            return Texts(self[i:i + n])

        def to_pylist(self):
            assert len(self) <= 256
            return list(self)

    texts = Texts([None, "", "a b c d"] + [f"text {i} of some words" for i in range(600)])
    got = S.fingerprints(texts, 3).to_numpy().view("u8").tolist()
    assert got == [S.simhash(t, 3) for t in texts]
    assert len(S.fingerprints(Texts(), 3)) == 0
