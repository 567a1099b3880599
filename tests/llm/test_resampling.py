import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from servicelens.llm import queries, resampling
from servicelens.llm.resampling import BLOCK, Features, Hasher
from .data import ROWS, collected, docs, empty, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(found[i:i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)], len(found)


def brute(rows, targets, longest=1, m=10_000, percent=10, least=20):
    place = lambda f: zlib.crc32(f.encode()) % m
    held = [(i, *features(t, longest)) for i, t in rows]
    s = Counter(place(f) for _, fs, _ in held for f in fs)
    t = Counter(place(f) for x in targets for f in features(x, longest)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + m) / ((s[b] + 1) * (big_t + m))))
    out = []
    for i, fs, n in held:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(place(f)) for f in fs)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for r in out:
        r.append(None)
    for k, r in enumerate(enough[:len(enough) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def shown(df):
    return sorted(((r["doc"]["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("longest,percent", [(1, 10), (1, 100), (3, 50)])
def test_equals_brute_force(spark, longest, percent):
    targets = [words(30, 2), None, "", words(50, 4) + " Tail!"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string")
    got = resampling.importance_resample(docs(spark), target, percent, features=Features(longest=longest))
    assert shown(got) == brute(ROWS, targets, longest, percent=percent)
    assert all(r["doc"]["label"] == "l" and r["doc"]["__key"] == "y" for r in got.collect())


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert resampling.importance_resample(empty(spark), nothing).count() == 0
    assert shown(resampling.importance_resample(docs(spark), nothing)) == brute(ROWS, [])


def test_draw_returns_the_documents(spark):
    target = spark.createDataFrame([(1, words(40, 2))], "item_id long, text string")
    d = docs(spark)
    drawn = resampling.draw(d, target, percent=40)
    assert drawn.columns == d.columns
    ranked = [r["doc"]["doc_id"] for r in resampling.importance_resample(d, target, 40).filter("rank is not null").collect()]
    assert sorted(map(str, ranked)) == sorted(str(r["doc_id"]) for r in collected(drawn)) and ranked


def test_long_texts_in_blocks_and_windows_over_their_edges():
    text = words(40_000, 1) + " é" + "x" * (2 * BLOCK) + ", ,  É" + words(10, 2).upper()
    for longest in (1, 3):
        fs, n = features(text, longest)
        got_n, got = Hasher(Features(longest=longest, buckets=1 << 20)).run(text)
        assert got_n == n and Counter(got.tolist()) == Counter(zlib.crc32(f.encode()) % (1 << 20) for f in fs)


def test_common_scores_and_many_partitions(spark):
    rows = [(i, words(25, 1)) for i in range(300)] + [(i, words(5, i)) for i in range(300, 330)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    target = spark.createDataFrame([(1, words(25, 1))], "item_id long, text string")
    assert shown(resampling.importance_resample(d, target)) == brute(rows, [words(25, 1)])


def test_query_covers_all_documents(spark):
    got = queries.op11_importance_resampling(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert got.agg(F.count_distinct("doc_id")).first()[0] == got.count() == 200
