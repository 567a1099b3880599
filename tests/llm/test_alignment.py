from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from servicelens.llm import alignment, queries
from servicelens.llm.alignment import Aligner, ByteLevel, Pieces
from .data import LONG, ROWS, collected, docs, empty

A_FILE, B_FILE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["two  spaces\n\n \tand\ttabs ", "a  b　　c  ", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ stands for a space",
       "\x1c \x1f x", "日本語テキスト🙂🙂 ß", "it's we'll THEY'RE 12345 ...!!", " ", "\n", "x" * 300, "\x00 nul"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def token_bytes(both):
    alphabet = alignment.byte_level_alphabet()
    a, b = both
    of_a = lambda i: bytes(alphabet[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return of_a, of_b


def brute(rows, both):
    """Every byte named by its token of either side; common ends and links read off the bytes."""
    of_a, of_b = token_bytes(both)
    docs, total = [], Counter()
    for key, text in rows:
        text = text or ""
        a, b = both[0].encode(" " + text, add_special_tokens=False).ids, both[1].encode(text)
        data = (" " + text).encode()
        if not text or b"".join(map(of_a, a)) != data or b"".join(map(of_b, b)) != data:
            docs.append((key, [], [], "", []))
            continue
        owner_a = [i for i, t in enumerate(a) for _ in of_a(t)]
        owner_b = [i for i, t in enumerate(b) for _ in of_b(t)]
        links = [(a[i], b[j]) for i, j in sorted(set(zip(owner_a, owner_b)))]
        groups, first = [], 0
        for at in range(len(data)):
            end = at + 1 == len(data) or (owner_a[at] != owner_a[at + 1] and owner_b[at] != owner_b[at + 1])
            if end:
                ids = [",".join(str(t[k]) for k in sorted(set(o[first:at + 1]))) for t, o in ((a, owner_a), (b, owner_b))]
                groups.append("|".join(ids))
                first = at + 1
        total.update(links)
        docs.append((key, a, b, ";".join(groups), links))
    top = Counter()
    for (_, y), c in total.items():
        top[y] = max(top[y], c)
    return sorted(((key, len(a), len(b), g.count(";") + bool(g), len(links), g, sum(total[p] == top[p[1]] for p in links),
                    sum(total[p] for p in links)) for key, a, b, g, links in docs), key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


def shown(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in collected(df)), key=repr)


@pytest.mark.parametrize("frequent", [alignment.FREQUENT_PAIRS, 40, 0])
def test_equals_brute_force(spark, both, monkeypatch, frequent):
    """Also where few or no pairs are broadcast, so that nearly all counts come by the join."""
    monkeypatch.setattr(alignment, "FREQUENT_PAIRS", frequent)
    rows = [r for r in ROWS if r[1] != LONG] + [(100 + i, t) for i, t in enumerate(ODD)]
    got = alignment.link_statistics(alignment.align(docs(spark, rows), A_FILE, B_FILE))
    assert shown(got) == brute(rows, both)
    assert set(got.columns) >= {"row", "__key", "spans", "label"}


def test_long_text_and_begun_memo(spark, both, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_WINDOWS", 50)
    rows = [(1, LONG[:20_000]), (2, LONG[5_000:9_000]), (3, "x" * 5_000)]
    assert shown(alignment.link_statistics(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A_FILE, B_FILE))) == brute(rows, both)


def test_empty_table_and_taken_names(spark):
    got = alignment.link_statistics(alignment.align(empty(spark), A_FILE, B_FILE))
    assert got.count() == 0
    taken = docs(spark, ROWS[3:5]).withColumns({"Links": F.lit("old"), "n_best": F.lit("old")})
    got = alignment.link_statistics(alignment.align(taken, A_FILE, B_FILE))
    assert dict(got.dtypes)["n_best"] == "bigint" and "Links" not in got.columns and got.count() == 2


def test_chunks_equal_whole_texts(spark, both):
    with open(A_FILE, "rb") as f, open(B_FILE, "rb") as g:
        aligner = Aligner(ByteLevel(f.read()), Pieces(g.read()))
    texts = ["", *ODD, *(t for _, t in ROWS if t), *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text)]
    aligner.chunked.limit = 2_000  # begun anew again and again
    for i in range(0, len(texts), 20):
        part = texts[i:i + 20]
        (a, n_a), (b, n_b) = aligner.chunked.ids([" " + t if t else "" for t in part])
        want = [both[0].encode(" " + t, add_special_tokens=False).ids if t else [] for t in part]
        assert a.tolist() == sum(want, []) and n_a.tolist() == list(map(len, want))
        plain = [k for k, t in enumerate(part) if "\u2581" not in t]  # the others have no tokens in any case
        got = np.split(b, np.cumsum(n_b)[:-1])
        assert [got[k].tolist() for k in plain] == [both[1].encode(part[k]) for k in plain]


def test_windows_alike_by_hash_only(spark, both, monkeypatch):
    """Should the hashes of two windows be the same, the tuples themselves are compared."""
    monkeypatch.setattr(alignment, "mix64", lambda x: x & np.uint64(1))
    with open(A_FILE, "rb") as f, open(B_FILE, "rb") as g:
        aligner = Aligner(ByteLevel(f.read()), Pieces(g.read()))
    rows = [(i, t) for i, t in enumerate(ODD)]
    got = [r[:5] for r in aligner.run([t for _, t in rows])]
    assert sorted(got) == sorted(r[1:6] for r in brute(rows, both))


def test_query_equals_brute_force(spark, both):
    import hashlib
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    expected = [r[:5] + (hashlib.sha256(r[5].encode()).hexdigest() if r[5] else "",) + r[6:] for r in brute(rows, both)]
    got = queries.op12_tokenizer_alignment(spark, "/root/testdata/sf0.001")
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted((tuple(r[c] for c in cols) for r in collected(got)), key=repr) == expected
