import re

import pytest

from servicelens.llm import secrets as S
from servicelens.llm.common import table

from . import data

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    t = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    out += [(m.start(), 3, m.end(), "vendor") for m in re.finditer(S.RULES[3].pattern, t)]
    return sorted(out)


def spans(row):
    return [(s["start"], s["rank"], s["end"], s["kind"]) for s in row["spans"]]


HARD = ["token=token:abcdef", "API_KEY = \"abc.def-ghi\" token=abc secret: xyzxyz", "\U0001F642 password=é password='p4ssw0rd'",
        "AKIAAKIA" + "A" * 12 + " AKIA123 " + "0" * 24 + "g" + "f" * 23, "ghp_" + "a1" * 20 + " eyJabcdefgh.abcdefgh.abcdefgh",
        "passwd:" + "x" * 50_000, "secret=abcdef" * 400, "-----BEGIN RSA PRIVATE KEY-----"]


def test_spans(spark):
    rows = [*data.ROWS, *enumerate(HARD, 100)]
    got = data.collected(S.find_secrets(data.docs(spark, rows), S.scratch_ledger(spark)))
    assert len(got) == len(rows)
    texts = dict(rows)
    assert all(spans(r) == plain(texts[r["doc_id"]]) for r in got) and any(r["spans"] for r in got)
    assert S.find_secrets(data.empty(spark), S.scratch_ledger(spark)).count() == 0


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in data.collected(docs)}
    for r in data.collected(S.find_secrets(docs, S.scratch_ledger(spark))):
        assert spans(r) == plain(texts[r["doc_id"]])


def test_only_unseen_pairs_are_scanned(spark):
    ledger, first = S.scratch_ledger(spark), data.docs(spark, [(1, HARD[0]), (2, HARD[1]), (3, HARD[1])])
    old = S.RULES[:2]
    ledger.scan(first, old)
    assert ledger.read().count() == 2  # equal texts are one blob
    ledger.scan(first, old)
    assert ledger.read().count() == 2
    both = data.docs(spark, [(1, HARD[0]), (2, HARD[3]), (3, HARD[1]), (9, HARD[5])])
    got = data.collected(S.find_secrets(both, ledger, S.RULES))
    texts = {1: HARD[0], 2: HARD[3], 3: HARD[1], 9: HARD[5]}
    assert all(spans(r) == plain(texts[r["doc_id"]]) for r in got)
    seen = [sorted(r["rules"]) for r in data.collected(ledger.read())]
    keys = sorted(r.key for r in S.RULES)
    assert sorted(seen) == sorted([sorted(r.key for r in old)] * 2 + [sorted(set(keys) - {r.key for r in old})] * 2 + [keys] * 2)
    # a new version of a rule scans all blobs again, and its findings replace the old ones
    newer = [S.Rule("assign", r"(secret)[:=](\w+)", 2, 3, version=2)]
    got = data.collected(S.find_secrets(first, ledger, newer))
    assert {r["doc_id"]: len(r["spans"]) for r in got} == {1: 0, 2: 0, 3: 0}
    assert [r["spans"] for r in data.collected(S.find_secrets(data.docs(spark, [(5, "secret=xyz")]), ledger, newer))] != [[]]


def test_redaction(spark):
    rows = [(1, None), (2, "no"), (3, HARD[2]), (4, "é secret=abcdef0123456789abcdef0123 end"), (5, HARD[6])]
    docs = data.docs(spark, rows)
    out = S.redact(docs, S.scratch_ledger(spark))
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in data.collected(out)}
    assert got[1]["text"] is None and got[2]["text"] == "no" and got[4]["text"] == "é [SECRET] end" and got[4]["n_chars"] == 14
    for i, t in rows[2:]:
        clean, at = "", 0
        for a, _, b, _ in plain(t):
            if a >= at:
                clean += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert got[i]["text"] == clean + t[at:]


@pytest.mark.parametrize("rule", S.RULES, ids=lambda r: r.kind)
def test_rule_keys(rule):
    assert rule.key == f"{rule.kind}@1"
