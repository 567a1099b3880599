import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from servicelens.llm import packing, queries
from servicelens.llm.packing import Bins
from servicelens.llm.subwords import Subwords, Words
from .data import ROWS, collected, docs, empty

FILE = P.path("word_bpe_49k.json")
ODD = ["<|endoftext|>x<|startoftext|> end", "<|ENDOFTEXT|> a<|endoftext|>. Upper,lower. It's they'll. ... ?!x I.D. 3.14, A1? e\u0301. E\u0301! x\u0301,", "É á   b　c\x1cd", "ΟΔΟΣ Σ İ", "it's 123 --- 'S", "\n\t ", "y" * 500]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def expected_pieces(rows, tokenizer, size):
    out = []
    for key, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out += [(key, k, s, len(ids[s:s + size]), zlib.crc32(ids[s:s + size].tobytes())) for k, s in enumerate(range(0, len(ids), size))]
    return sorted(out, key=repr)


def check(packed, size):
    """Every sequence is gapless and fits; returns how many there are and the least possible number."""
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by), -(-sum(r["length"] for r in packed) // size)


def test_pieces_and_places(spark, tokenizer):
    rows = ROWS + [(100 + i, t) for i, t in enumerate(ODD)]
    got = collected(packing.pack_documents(docs(spark, rows), FILE, size=64, by_words=True))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == expected_pieces(rows, tokenizer, 64)
    made, least = check(got, 64)
    assert made <= least + 1


def test_words_equal_whole_texts(spark, tokenizer):
    with open(FILE) as f:
        subwords = Subwords(f.read(), plain_special=False)
    words = Words(subwords, limit=2_000)  # generations come and go
    texts = ["", *ODD, *(t for _, t in ROWS if t), *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text)]
    for t in texts:
        assert np.frombuffer(words.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert list(map(words.ids, texts)) == subwords.packed(texts)


def test_assembled_sequences_are_the_documents(spark, tokenizer):
    cut = packing.pieces(docs(spark), FILE, size=50, by_words=True)
    packed = packing.pack(cut, size=50)
    assert set(packed.columns) >= {"row", "__key", "label", "ids"}
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in collected(packing.assemble(packed))}
    for r in collected(packed):
        assert whole[r["sequence_id"]][4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert sum(map(len, whole.values())) == 4 * sum(r["length"] for r in collected(packed))


def test_empty_table_and_bad_lengths(spark):
    assert packing.pack_documents(empty(spark), FILE).count() == 0
    for bad in (0, 11, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, bad)], "k long, length long"), size=10)


@pytest.mark.parametrize("tasks", [50, 1000, 100_000])
def test_few_sequences_also_over_many_small_tasks(spark, tasks):
    """Bins left open by many tasks are packed together in later rounds."""
    rng = random.Random(4)
    rows = [(i, min(100, 1 + int(rng.expovariate(1 / 30)))) for i in range(4000)]
    got = collected(packing.pack(spark.createDataFrame(rows, "k long, length long"), size=100, task_pieces=tasks))
    assert sorted((r["k"], r["length"]) for r in got) == rows
    made, least = check(got, 100)
    assert made <= least * 1.01 + 1


def test_pieces_that_do_not_go_together(spark):
    got = collected(packing.pack(spark.createDataFrame([(i, 60) for i in range(500)], "k long, length long"), size=100, task_pieces=20))
    assert check(got, 100)[0] == 500


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 6))
def test_bins_equal_a_plain_list(lengths, limit):
    """The bitset chooses what a search over all open bins would, and the fullest bin closes first."""
    bins, open_, made = Bins(20, limit), {}, 0
    for length in lengths:
        fits = [f for f in open_.values() if f >= length]
        number, offset = bins.place(length)
        if fits:
            assert open_[number] == min(fits)
        else:
            if len(open_) >= limit:
                least = min(open_.values())
                gone = [n for n, f in open_.items() if f == least and n not in [x for s in bins.by_room for x in s]]
                assert gone
                del open_[gone[0]]
            assert number == made
            made += 1
            open_[number] = 20
        assert offset == 20 - open_[number]
        open_[number] -= length
        if not open_[number]:
            del open_[number]
        assert sorted(x for s in bins.by_room for x in s) == sorted(open_) and len(open_) <= limit


def test_query_is_close_to_the_least_number(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    got = collected(queries.op13_best_fit_packing(spark, sf))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == expected_pieces(rows, tokenizer, 2048)
    made, least = check(got, 2048)
    assert made <= least * 1.02 + 1
