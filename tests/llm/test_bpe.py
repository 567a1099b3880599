import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import regex
import tiktoken

from servicelens.llm import bpe as B

from . import data

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def model():
    return B.Bpe.from_file(PATH, P.PATTERN)


def test_perfect_hash_is_minimal_and_exact(model):
    assert sorted(model.whole.slots) == list(range(len(RANKS)))
    assert all(model.ids[model.whole.get(k)] == v for k, v in RANKS.items())
    assert model.whole.get(b"surely not a token") == -1


def test_matches_the_library(model):
    pieces = regex.compile(P.PATTERN).findall
    decoder = B.Decoder(model.bytes_of)
    rng = random.Random(0)
    texts = ["", "a" * 5000, " " * 300 + "x", "日本語\U0001F642 ​\n\n\t", "<|endoftext|>", "don't we'll", data.LONG[:20_000]]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x2000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(200)) for _ in range(40)]
    for t in texts:
        ids = model.encode(t, pieces)
        assert ids.tolist() == LIBRARY.encode_ordinary(t) and decoder.decode(ids) == t.encode()


def test_memo_generations(model, monkeypatch):
    monkeypatch.setattr(B, "MEMO_LIMIT", 50)
    pieces = regex.compile(P.PATTERN).findall
    text = data.words(3000, 5)
    assert model.encode(text, pieces).tolist() == LIBRARY.encode_ordinary(text)
    assert len(model.memo) <= 50 and len(model.memo.older) <= 50


def test_documents(spark):
    docs, bpe = data.docs(spark), B.broadcast_bpe(spark, PATH, P.PATTERN)
    got = data.collected(B.token_digests(docs, bpe))
    want = []
    for d, t in data.ROWS:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got), key=key) == sorted(want, key=key)
    assert B.token_digests(data.empty(spark), bpe).count() == 0
    kept = B.tokenize(docs, bpe)
    assert "text" not in kept.columns and {"ids", "__key", "token_ids", "n_tokens"} <= set(kept.columns) and kept.count() == len(data.ROWS)
    with pytest.raises(ValueError):
        B.encode(docs, bpe, "ids")
