import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from servicelens.llm import compact as C
from servicelens.llm import suffixes as S
from servicelens.llm.common import table
from servicelens.llm.passages import hashed_texts, long_runs, runs, window_minima, word_hashes

from . import data


def tokens(t):
    return (t or "").encode().lower().split()


def plain_cover(rows, n):
    """Words covered by runs of n words that another document has."""
    where = defaultdict(set)
    for d, t in rows:
        w = tokens(t)
        for k in range(len(w) - n + 1):
            where[tuple(w[k:k + n])].add((d, t))
    out = {}
    for d, t in rows:
        w, cover = tokens(t), set()
        for k in range(len(w) - n + 1):
            if len(where[tuple(w[k:k + n])]) > 1:
                cover.update(range(k, k + n))
        if cover:
            out[d] = cover
    return out


def cover(got):
    out = defaultdict(set)
    for r in got:
        assert r["n_words"] == r["end_word"] - r["start_word"]
        out[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    return dict(out)


def planted(seed, n_docs=60):
    rng = random.Random(seed)
    shared = [data.words(rng.randint(50, 120), 500 + i) for i in range(8)]
    rows = []
    for i in range(n_docs):
        parts = [data.words(rng.randint(0, 90), 1000 + i)]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(shared).split()
            a = rng.randint(0, max(0, len(p) - 50))
            parts += [" ".join(p[a:a + rng.randint(40, 120)]), data.words(rng.randint(0, 20), 3000 + i)]
        rows.append((i, " ".join(parts).upper() if i % 5 == 0 else " ".join(parts)))
    return rows


@pytest.mark.parametrize("parts", [2, 23])
def test_exact_passages_match_brute_force(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = planted(parts)
        assert cover(data.collected(S.repeated_passages(data.docs(spark, rows)))) == plain_cover(rows, 50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_exact_passages_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in data.collected(docs)]
    assert cover(data.collected(S.repeated_passages(docs))) == plain_cover(rows, 50)


def test_exact_edges(spark):
    got = data.collected(S.repeated_passages(data.docs(spark)))
    assert cover(got) == plain_cover(data.ROWS, 50)
    assert {(r["doc_id"], r["match_doc_id"]) for r in got} == {(6, 7), (7, 6), (9, 10), (10, 9)}
    assert S.repeated_passages(data.empty(spark)).count() == 0
    # what one document repeats, and equal rows, are not reported
    alone = [(1, data.PASSAGE + " x " + data.PASSAGE), (2, "a " * 300), (3, data.words(60, 8)), (3, data.words(60, 8))]
    assert S.repeated_passages(data.docs(spark, alone)).count() == 0
    with pytest.raises(ValueError):
        S.repeated_passages(data.empty(spark), 20)


def test_exact_repeats_inside_a_document_and_split_matches(spark):
    passages = [data.words(60, 20_000 + i) for i in range(12)]
    rows = [(i, p + " " + data.words(9, 21_000 + i) + " " + p + " " + data.words(7, 22_000 + i) + " " + p) for i, p in enumerate(passages)]
    rows += [(100 + i, data.words(5, 23_000 + i) + " " + p) for i, p in enumerate(passages)]
    # one seed with surroundings that agree in part on either side with many others, and in enough words with few
    rng, core = random.Random(4), data.words(40, 24_000)
    for i in range(300):
        parts = [" ".join(rng.choice(("left", "right")) for _ in range(9)) for _ in range(2)]
        rows.append((1000 + i, f"x{i} y{i} {parts[0]} {core} {parts[1]} z{i} " + data.words(20, 25_000 + i)))
    got = data.collected(S.repeated_passages(data.docs(spark, rows)))
    assert cover(got) == plain_cover(rows, 50)
    assert {(r["doc_id"], r["match_doc_id"]) for r in got if r["doc_id"] < 1000} == {p for i in range(12) for p in ((i, 100 + i), (100 + i, i))}


def test_a_hot_passage_finds_all(spark):
    rows = [(i, data.words(15, i) + " " + data.PASSAGE + " " + data.words(15, 10_000 + i)) for i in range(400)]
    for got in (S.repeated_passages(data.docs(spark, rows)), C.near_duplicate_passages(data.docs(spark, rows))):
        found = cover(data.collected(got))
        assert set(found) == set(range(400)) and all(set(range(15, 95)) <= x for x in found.values())


def test_near_passages(spark):
    rng = random.Random(9)
    rows, pairs = [], []
    for i in range(60):
        p = data.words(rng.randint(60, 140), 7000 + i).split()
        q = list(p)
        if i % 3 == 1:
            q[rng.randrange(len(q))] = "changed"
        if i % 3 == 2:
            q.insert(rng.randrange(len(q)), "added")
        rows += [(2 * i, data.words(rng.randint(0, 60), 1 + i) + " " + " ".join(p)), (2 * i + 1, " ".join(q).upper() + " " + data.words(rng.randint(0, 60), 900 + i))]
        pairs.append((2 * i, 2 * i + 1))
    rows += [(1000 + i, data.words(200, 50_000 + i)) for i in range(40)]
    got = data.collected(C.near_duplicate_passages(data.docs(spark, rows)))
    texts = dict(rows)
    found = {(r["doc_id"], r["match_doc_id"]) for r in got}
    # four hash functions, two of which have to agree: nearly all near copies, and nothing else
    assert all(p in set(pairs) or p[::-1] in set(pairs) for p in found)
    assert sum(p in found and p[::-1] in found for p in pairs) >= 57
    assert all(r["similarity"] >= 0.8 and r["n_words"] >= 50 and r["end_word"] <= len(tokens(texts[r["doc_id"]])) for r in got)
    assert all(p in found for i, p in enumerate(pairs) if i % 3 == 0)


def test_frequent_minima_lose_no_partner(spark):
    """Pairs share a passage; the words around each of its minima are short lines of many other documents."""
    rows = []
    for i in range(6):
        passage = data.words(60, 70_000 + i)
        t, w = runs(word_hashes(passage), C.SHINGLE), passage.split()
        for c in sorted(set(C.compact_windows(t, 46)[1].tolist())):
            line = " ".join(w[c:c + C.SHINGLE])
            n = 10_000 + len(rows)
            rows += [(n + k, data.words(70, 100 * (n + k)) + " " + line + " " + data.words(70, 100 * (n + k) + 1)) for k in range(40)]
        rows += [(2 * i, data.words(20, 80_000 + i) + " " + passage), (2 * i + 1, passage + " " + data.words(20, 90_000 + i))]
    got = cover(data.collected(C.near_duplicate_passages(data.docs(spark, rows))))
    assert set(got) == set(range(12))
    assert all(got[d] == set(range(20, 80)) if d % 2 == 0 else got[d] == set(range(60)) for d in got)


def test_blocks_of_a_frequent_signature_meet(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 3)
    every = spark.createDataFrame([(i, [0, 1, 2] if i < 20 else [i * 16]) for i in range(25)], "unit long, signatures array<long>")
    heads = spark.createDataFrame([(i, i // 2, 100 + i if i == 4 else None) for i in range(25)], "unit long, row long, second long")
    got = [(r["unit"], r["other"]) for r in C.signature_pairs(every, heads).collect()]
    want = {(a, b) for a in range(20) for b in range(a + 1, 20) if a // 2 != b // 2} | {(5, 104)}
    assert len(got) == len(set(got)) and set(got) == want


def test_stretches_that_repeat_and_fall_short():
    rng = np.random.default_rng(5)
    p, q, r = (rng.integers(0, 2**32, n, dtype=np.uint32) for n in (60, 50, 400))
    twice = np.concatenate([p, r[:100], p])
    assert {(x[0], x[1]) for x in C.both_ways(twice, p, 46, 0.8)} == {(0, 60), (160, 220)}
    assert {(x[2], x[3]) for x in C.both_ways(p, twice, 46, 0.8)} == {(0, 60), (160, 220)}
    # pieces with gaps between: as a whole below the similarity, two of them together above
    x, y = (np.concatenate([np.concatenate([r[21 * i:21 * i + 21], rng.integers(0, 2**32, 5, dtype=np.uint32)]) for i in range(6)]) for _ in range(2))
    assert C.both_ways(x, y, 46, 0.8)
    # a longer run whose partner has much in between falls short; the passage beside it is found all the same
    a = np.concatenate([np.tile(q[:9], 12), r[100:200], p])
    b = np.concatenate([q[:9], r[200:300], p])
    assert any((x[0], x[1]) == (208, 268) for x in C.both_ways(a, b, 46, 0.8))


def plain_best_run(shared, share):
    total = np.concatenate([[0.0], np.cumsum(np.where(shared, 1 - share, -share))])
    high = int((total - np.minimum.accumulate(total)).argmax())
    return int(total[:high + 1].argmin()), high


def plain_stretches(a, b, least, min_similarity):
    """One pair, one range after the other."""
    out, todo = [], [(0, len(a))]
    every = np.isin(a, b)
    total = np.concatenate([[0], np.cumsum(every)])
    while todo:
        begin, end = todo.pop()
        if end - begin < least or total[end] - total[begin] < least * min_similarity:
            continue
        shared = every[begin:end]
        found = first = tried = None
        for share in (min_similarity, (1 + min_similarity) / 2, (7 + min_similarity) / 8):
            low, high = plain_best_run(shared, share)
            low, high = low + begin, high + begin
            if high - low < least * min_similarity:
                break
            tried, part = (low, high), a[low:high]
            first = first or tried
            other_low, other_high = plain_best_run(np.isin(b, part), share)
            if min(high - low, other_high - other_low) < least:
                continue
            x, y = np.unique(part), np.unique(b[other_low:other_high])
            common = len(np.intersect1d(x, y, assume_unique=True))
            similarity = common / (len(x) + len(y) - common)
            if similarity >= min_similarity:
                found = (low, high, other_low, other_high, similarity)
                break
        if found:
            out.append(found)
        elif first and first[1] - first[0] > 1.25 * least:
            # enough is shared, but spread: shorter parts of the run, which overlap by ``least``, may hold
            middle = sum(first) // 2
            todo += [(first[0], middle + least // 2), (middle - least // 2, first[1])]
            tried = first
        if tried:
            todo += [(begin, tried[0]), (tried[1], end)]
    return out


def plain_both_ways(a, b, least, min_similarity):
    out = plain_stretches(a, b, least, min_similarity)
    rest = np.isin(b, a)
    for _, _, low, high, _ in out:
        rest[low:high] = False
    if np.count_nonzero(rest) >= least * min_similarity:
        out += [(x, y, low, high, s) for low, high, x, y, s in plain_stretches(b, a, least, min_similarity)]
    return out


def test_stretches_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(11)

    def varied(x):
        for _ in range(rng.integers(0, 8)):
            i = rng.integers(0, len(x) + 1)
            x = np.concatenate([x[:i], rng.integers(0, 2**32, rng.integers(0, 30), dtype=np.uint32), x[i + rng.integers(0, 20):]])
        return np.concatenate([rng.integers(0, 2**32, rng.integers(0, 80), dtype=np.uint32), x, x[:rng.integers(0, 90)]])

    sides = [[], []]
    for _ in range(400):
        words = rng.integers(0, 2**32, rng.choice([5, 60, 3000]), dtype=np.uint32)
        base = words[rng.integers(0, len(words), rng.integers(0, 400))]
        for side in sides:
            side.append(varied(base))
    got = [[] for _ in sides[0]]
    for x in C.all_ways(*sides, 46, 0.8).tolist():
        got[int(x[0])].append((*map(int, x[1:5]), x[5]))
    want = [plain_both_ways(a, b, 46, 0.8) for a, b in zip(*sides)]
    assert sum(map(len, want)) > 200 and [sorted(x) for x in got] == [sorted(x) for x in want]
    assert len(C.all_ways([], [], 46, 0.8)) == 0


def test_slices_of_pairs_are_bounded_by_their_tokens():
    sizes = [3, 3, 3, 50, 1, 0, 8, 9, 2]
    mine, his = pa.array([b"0123" * n for n in sizes], pa.binary()), pa.array([b""] * len(sizes), pa.binary())
    got = list(C.token_slices(mine, his, 10))
    assert got == [(0, 3), (3, 4), (4, 7), (7, 8), (8, 9)] and list(C.token_slices(mine[:0], his[:0])) == []


def test_windows_of_texts_after_one_another(spark):
    texts = [data.words(n, 100 + n) + e for n, e in ((0, ""), (3, " "), (49, ""), (50, "\t"), (51, ""), (0, "\n"), (400, ""), (52, " \u00c4"))]
    for first, words, bounds in hashed_texts(texts, 500):
        assert all((words[a:b] == word_hashes(t)).all() for t, a, b in zip(texts[first:], bounds, bounds[1:]))
    got = data.collected(C.windows(data.docs(spark, list(enumerate(texts))).repartition(1), 50))
    want = []
    for t in texts:
        signature, *place = C.compact_windows(runs(word_hashes(t), C.SHINGLE), 46) or [np.zeros(0, np.uint64)] * 4
        want += [(int(s.view(np.int64)), int(c) << 16 | int(x) << 8 | int(y)) for s, c, x, y in zip(signature, *place)]
    assert sorted((r["signature"], r["place"]) for r in got) == sorted(want)


def test_near_edges(spark):
    got = data.collected(C.near_duplicate_passages(data.docs(spark)))
    assert {(r["doc_id"], r["match_doc_id"]) for r in got} == {(6, 7), (7, 6), (9, 10), (10, 9)}
    assert C.near_duplicate_passages(data.empty(spark)).count() == 0


def plain_tree_windows(h, least):
    """Nodes of the Cartesian tree (leftmost minimum on top) that span ``least`` positions."""
    out, todo = [], [(0, len(h))]
    while todo:
        a, b = todo.pop()
        if b - a >= least:
            c = a + int(np.argmin(h[a:b]))
            out.append((c, c - a, b - 1 - c))
            todo += [(a, c), (c + 1, b)]
    return sorted(out)


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(2)
    for n in (0, 10, 46, 47, 300, 2000):
        t = rng.integers(0, 2**60, n, dtype=np.uint64)
        t[n // 2:] = t[:n - n // 2] if n > 500 else t[n // 2:]  # ties
        found = C.compact_windows(t, 46, functions=3, reach=4000)
        for j in range(3):
            h = C.mix64(t ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF)) | np.uint64(1)
            mine = [] if found is None else [x for x in zip(*(v.tolist() for v in found)) if x[0] & 15 == j]
            assert sorted(x[1:] for x in mine) == plain_tree_windows(h, 46)


def test_runs():
    w = np.arange(100, dtype=np.uint64) % 7
    assert len(runs(w, 5)) == 96 and runs(w, 5)[0] == runs(w, 5)[7] and len(runs(w[:3], 5)) == 0
    assert len(long_runs(w, 35)) == 66 and long_runs(w, 35)[0] == long_runs(w, 35)[7] and len(long_runs(w[:20], 35)) == 0
    assert len(set(long_runs(np.arange(100, dtype=np.uint64), 35).tolist())) == 66
    # hashes are compared by their high bits
    assert window_minima(np.array([3, 1, 1, 5, 0], np.uint64) << np.uint64(40), 2).tolist() == [1, 2, 4]


def cell_of_texts():
    rng = np.random.default_rng(5)
    fresh = lambda n: rng.integers(0, 1 << 32, n).astype("<u4")
    passage, repeated = fresh(90), np.full(1, 7, "<u4")
    near = passage.copy()
    near[[20, 21, 22, 60]] = fresh(4)
    return [np.concatenate(x) for x in (
        (fresh(30), passage, fresh(40)), (passage, fresh(5)), (fresh(9), near, fresh(8)), (fresh(64), np.repeat(repeated, 60), fresh(64)),
        (fresh(20), np.repeat(repeated, 45), fresh(20)), (np.repeat(repeated, 80), fresh(64), passage), (fresh(64), passage[:2], fresh(64)),
        (passage[:40], fresh(12), passage[40:], near), (fresh(64), repeated, fresh(64)), (passage[:46],), (passage[:45], fresh(9)))]


def test_pairs_of_a_cell_give_the_stretches_of_each_pair(monkeypatch):
    texts, calls = cell_of_texts(), []
    mine, his = (np.array(x) for x in zip(*[(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j]))
    want = sorted((k, *x) for k, (i, j) in enumerate(zip(mine, his)) for x in C.both_ways(texts[i], texts[j], 46, 0.8))
    whole = C.all_ways
    monkeypatch.setattr(C, "all_ways", lambda a, b, *x: calls.append(len(a)) or whole(a, b, *x))
    got = np.concatenate(list(C.cell_stretches(texts, mine, his, 46, 0.8)))
    assert sorted((*map(int, x[:5]), x[5]) for x in got.tolist()) == want
    # pairs that share two tokens, or one run and nothing else, are not searched
    assert len(want) > 20 and sum(calls) < len(mine) / 2


def test_tokens_come_to_a_cell_once(spark):
    texts = cell_of_texts()
    every = spark.createDataFrame([(i, 100 + i, i, 3 * i, bytes(t.tobytes())) for i, t in enumerate(texts)],
                                  "unit long, row long, doc_id long, low int, tokens binary")
    for c, empty in (("first", 0), ("last", 0), ("content", 0)):
        every = every.selectExpr("*", f"{empty} AS {c}")
    links = [(i, j, (i + j) % 3) for i in range(len(texts)) for j in range(i)]
    pairs = spark.createDataFrame([(j, i, c) for i, j, c in links], "unit long, other long, cell long")
    seats = pairs.selectExpr("cell", "explode(array(unit, other)) AS unit").distinct()
    assert seats.count() < 2 * len(links) * 2 // 3
    want = sorted(map(repr, C.verify(pairs.select("unit", "other"), every, 50, 0.8).collect()))
    for tasks in (1, 4):
        assert sorted(map(repr, C.verify_cells(pairs, every, seats, tasks, 50, 0.8).collect())) == want
    assert len(want) > 20


def near_copies(n, seed, words=80):
    passage = data.words(words, seed).split()
    return [" ".join(passage[:i % words] + [f"other{seed}x{i}"] + passage[i % words + 1:]) for i in range(n)]


def test_no_table_grows_with_the_pairs_of_a_group(spark, monkeypatch):
    sizes, write = {}, C.scratch_table

    def counted(df, name):
        table = write(df, name)
        sizes[name] = sizes.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(C, "scratch_table", counted)
    rows = [(i, data.words(5, 100_000 + i) + " " + t) for i, t in enumerate(near_copies(200, 3))]
    got = data.collected(C.near_duplicate_passages(data.docs(spark, rows)))
    # 19,900 pairs
    assert {r["doc_id"] for r in got} == set(range(200)) and max(sizes.values()) < 8_000, sizes


def test_cells_verify_all_pairs_of_signatures(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 3)
    monkeypatch.setattr(C, "SEATS", 20)
    line, copies, others = data.words(30, 110_000), near_copies(14, 111_000), near_copies(9, 112_000, 60)
    rows = [(i, data.words(40, 113_000 + i) + " " + line + " " + data.words(30, 114_000 + i)) for i in range(12)]
    rows += [(20 + i, data.words(9, 115_000 + i) + " " + t + " " + line) for i, t in enumerate(copies[:11])]
    rows += [(40 + i, t + " " + data.words(150, 116_000 + i) + " " + others[i % 5]) for i, t in enumerate(copies[8:])]
    # near copies in one document, of which others have the one or the other word for word
    rows += [(60, others[5] + " " + data.words(150, 117_000) + " " + others[6]), (61, others[5]), (62, others[6]), (None, others[7])]
    docs = data.docs(spark, rows)
    shared = C.shared_windows(C.scratch_table(C.windows(docs, 50), "windows"))
    parts = [C.scratch_table(C.units(*C.at_part(docs, C.reduce(C.DataFrame.unionByName, shared), k), 50), "units") for k in range(C.PASSES)]
    every = C.reduce(C.DataFrame.unionByName, parts)
    heads = C.classes(every).selectExpr("m.unit AS unit", "m.row AS row", "o.unit AS second")
    heads = C.scratch_table(heads, "heads")
    pairs = C.signature_pairs(every, heads)
    merged = lambda x: sorted(map(repr, C.merge_spans(x.drop("unit", "departure"), ["similarity"]).drop("island").collect()))
    want = merged(C.verify(pairs.select("unit", "other"), every, 50, 0.8))
    assert len(want) > 15 and merged(C.linked_spans(every, heads, 50, 0.8)) == want
    none = C.linked_spans(every, heads.filter("unit IS NULL"), 50, 0.8)
    assert none.count() == 0


def test_groups_are_not_cut():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 400):
        key = np.sort(rng.integers(-40, 40, n) * (rng.integers(0, 3, n) > 0))
        cuts = np.sort(rng.integers(0, n + 1, 20))
        whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(n))], names=["key", "at"])
        got = list(C.whole_groups(whole.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, n])))
        assert [x for columns, _ in got for x in columns[1].to_pylist()] == list(range(n))
        groups = [g.tolist() for columns, begin in got for g in np.split(columns[0].to_numpy(), begin[1:])]
        assert [g[0] for g in groups] == sorted(set(key.tolist())) and all(len(set(g)) == 1 for g in groups)


def test_windows_of_one_document_alone_are_dropped(spark):
    rng = np.random.default_rng(8)
    rows = [(int(s) * 16, int(r), i) for i, (s, r) in enumerate(zip(rng.integers(-300, 300, 900), rng.integers(0, 3, 900)))]
    rows += [(16_000, 5, 1000 + i) for i in range(90)] + [(32_000, 5, 2000 + i) for i in range(90)] + [(32_000, 6, 3000)]
    of = defaultdict(set)
    for s, r, _ in rows:
        of[s].add(r)
    want = sorted(x for x in rows if len(of[x[0]]) > 1)
    found = spark.createDataFrame(rows, "signature long, row long, place long").repartition(5)
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        for size, parts in ((1, 2), (7, 1), (10_000, 3)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted(tuple(r) for x in C.shared_windows(found) for r in x.collect()) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
