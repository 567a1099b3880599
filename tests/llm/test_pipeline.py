import importlib
import re
import subprocess
import sys

import corpus_pipeline as P
import duckdb
import pytest

import __spark_entry__ as entry
from servicelens.llm import queries
from servicelens.llm.common import scratch_table, table

from . import data
from .test_decontaminate import plain_leaks
from .test_quality import plain_failed, plain_measures
from .test_secrets import plain as plain_spans
from .test_simhash import plain_components, plain_simhash

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "byte_level_bpe"]
    texts = {r["doc_id"]: r["text"] for r in data.collected(docs)}
    kept = scratch_table(P.STAGES[0][1](spark, docs, SF), "a")
    left = {r["doc_id"]: r["text"] for r in data.collected(kept)}
    assert kept.columns == docs.columns and left.items() <= texts.items()
    assert not any(plain_failed(plain_measures(t)) for t in left.values())

    unique = scratch_table(P.STAGES[1][1](spark, kept, SF), "b")
    classes = plain_components([(d, plain_simhash(t)) for d, t in left.items()])
    want = {d for d, t in left.items() if classes[plain_simhash(t)] == d}
    left = {r["doc_id"]: r["text"] for r in data.collected(unique)}
    assert unique.columns == docs.columns and set(left) == want and unique.count() == len(want)

    clean = scratch_table(P.STAGES[2][1](spark, unique, SF), "c")
    items = [(r["item_id"], r["text"]) for r in data.collected(table(spark, SF, "benchmark"))]
    grams = {w for _, t in items for w in (t or "").lower().split()}
    want = {d for d, t in left.items() if not (set(t.lower().split()) & grams and plain_leaks(t, items))}
    left = {r["doc_id"]: r["text"] for r in data.collected(clean)}
    assert clean.columns == docs.columns and set(left) == want

    masked = scratch_table(P.STAGES[3][1](spark, clean, SF), "d")
    assert masked.columns == docs.columns
    for r in data.collected(masked):
        assert ("[SECRET]" in r["text"]) == bool(plain_spans(left[r["doc_id"]])) and r["n_chars"] == len(r["text"])

    done = P.STAGES[4][1](spark, masked, SF)
    assert done.count() == len(left) and "text" not in done.columns


def test_run_and_edges(spark, tmp_dir):
    assert P.run(spark, SF).count() > 0
    docs = data.docs(spark)
    out = docs
    for _, stage in P.STAGES:
        out = scratch_table(stage(spark, out, SF), "stage")
        assert scratch_table(stage(spark, data.empty(spark), SF), "none").count() == 0
    assert {"doc_id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_every_operator_has_one_query():
    names = [re.match(r"op(\d+)_", n) for n in queries.QUERIES]
    assert sorted(int(m[1]) for m in names) == list(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert sorted(want.columns) == sorted(got.columns)
    rows = sorted(tuple(r[c] for c in want.columns) for r in data.collected(got))
    assert rows == sorted(want.fetchall())


def test_entry_without_the_subpackage(tmp_path):
    root = importlib.import_module("servicelens").__path__[0].rsplit("/", 1)[0]
    (tmp_path / "servicelens").mkdir()
    for name in ("functions", "operators", "plans", "sources", "streaming", "session.py", "__init__.py"):
        (tmp_path / "servicelens" / name).symlink_to(f"{root}/servicelens/{name}")
    (tmp_path / "__spark_entry__.py").symlink_to(f"{root}/__spark_entry__.py")
    code = f"import sys; sys.path[:] = [p for p in sys.path if p not in ('', {root!r})]; sys.path.insert(0, {str(tmp_path)!r}); " \
           "import importlib.util as u; s = u.spec_from_file_location('e', '%s/__spark_entry__.py'); m = u.module_from_spec(s); " \
           "s.loader.exec_module(m); q = m.queries(); assert 'sla_scoring' in q and 'pipeline' not in q" % tmp_path
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})
