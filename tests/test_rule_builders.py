"""The rule builders have two routes to the same Catalyst expression: SQL text (plain
column inputs) and the Column API (any other input).  Both must agree row by row."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from servicelens.functions import columns as C
from servicelens.functions import rules as R
from servicelens.operators import text as T

WORDS = sorted({w for _, ws in R.PRIORITY_CHAT for w in ws} | {w for _, ws in R.DEPARTMENT_SCORED_CHAT for w in ws}
               | set(R.GAZETTEER) | {w for w, _ in R.URGENCY_WORDS} | {"x", " ", "download", "updown"})


def _both(text_col: str, fn):
    """(SQL route, Column route): lower() of already lower-cased text forces the Column API."""
    return fn(text_col), fn(F.lower(F.col(text_col)))


def test_sql_route_is_taken_only_for_plain_columns(spark):
    assert C.sql_ref("t") == "`t`"
    assert C.sql_ref(F.col("t")) == "`t`"
    assert C.sql_ref(F.lower(F.col("t"))) is None
    assert C.sql_ref(C.SqlText("coalesce(`p`, 3)")) == "(coalesce(`p`, 3))"
    assert C.sql_lit("it's") is None and C.sql_lit(0.5) == "0.5D" and C.sql_lit(7) == "7"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=8).map(" ".join), min_size=1, max_size=12),
       st.lists(st.sampled_from([None, 1, 2, 3, 4, 7]), min_size=12, max_size=12),
       st.lists(st.floats(0, 1), min_size=12, max_size=12))
def test_text_rule_routes_agree(spark, texts, prios, ps):
    rows = [(i, t.lower(), prios[i], ps[i], ["hardware", "software", "network", None][i % 4],
             [None, "P1", "P2", "P3", "P4", "P9"][i % 6]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string, pr int, p double, cat string, tp string")
    builders = {
        "first": lambda c: C.first_match(c, R.PRIORITY_CHAT, R.PRIORITY_DEFAULT),
        "scored": lambda c: C.scored_match(c, R.DEPARTMENT_SCORED_CHAT, R.DEPARTMENT_DEFAULT),
        "any": lambda c: C.contains_any(c, R.SENTIMENT_NEGATIVE),
        "score": lambda c: C.keyword_score(c, R.SENTIMENT_POSITIVE),
        "locs": lambda c: T.locations_all(c),
        "loc1": lambda c: T.location_first(c),
        "urg": lambda c: T.urgency_score(c),
    }
    cols = []
    for name, fn in builders.items():
        a, b = _both("t", fn)
        cols += [a.alias(f"{name}_sql"), b.alias(f"{name}_api")]
    cols += [C.lookup("tp", R.TEXT_SLA_HOURS, 24).alias("lk_sql"),
             C.lookup(F.upper("tp"), R.TEXT_SLA_HOURS, 24).alias("lk_api"),
             C.ladder("p", R.BREACH_BUCKETS, R.BREACH_BUCKET_DEFAULT).alias("ld_sql"),
             C.ladder(F.col("p") + 0.0, R.BREACH_BUCKETS, R.BREACH_BUCKET_DEFAULT).alias("ld_api"),
             C.actions_for(R.ACTIONS_BASE, "p", "cat", C.SqlText("coalesce(`pr`, 3)")).alias("ac_sql"),
             C.actions_for(R.ACTIONS_BASE, F.col("p") + 0.0, F.lower("cat"),
                           F.coalesce(F.col("pr"), F.lit(3))).alias("ac_api")]
    out = df.select("i", *cols).collect()
    for r in out:
        d = r.asDict()
        for k in [k[:-4] for k in d if k.endswith("_sql")]:
            assert d[f"{k}_sql"] == d[f"{k}_api"], (k, rows[r.i], d[f"{k}_sql"], d[f"{k}_api"])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS + ["AADHAAR", "Mumbai", "dow", "n", "aadhaar-auth"]), max_size=10)
                .map(" ".join), min_size=1, max_size=12))
def test_keyword_index_route_equals_contains(spark, texts):
    """Rules over the indexed lower-cased column (array_contains on the one-pass keyword
    hits) agree with the same rules evaluated by ``contains`` on the text."""
    from servicelens.functions import keywords as K
    if not K.AVAILABLE:
        return
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [None])], "i int, t string")
    d = T.with_lower(df, "t")
    assert T.LT_HITS in d.columns
    lt, forced = F.col(T.LT), F.lower(F.col(T.LT))  # lower() of lowered text: Column route, contains
    pairs = {
        "first": (C.first_match(lt, R.PRIORITY_CHAT, "x"), C.first_match(forced, R.PRIORITY_CHAT, "x")),
        "scored": (C.scored_match(lt, R.DEPARTMENT_SCORED_CHAT, "x"),
                   C.scored_match(forced, R.DEPARTMENT_SCORED_CHAT, "x")),
        "locs": (T.locations_all(lt), T.locations_all(forced)),
        "urg": (T.urgency_score(lt), T.urgency_score(forced)),
        "sent": (T.sentiment(lt), T.sentiment(forced)),
        "reason": (T.priority_reason(F.lit("P1"), lt), T.priority_reason(F.lit("P1"), forced)),
    }
    cols = [c for k, (a, b) in pairs.items() for c in (a.alias(f"{k}_ix"), b.alias(f"{k}_ct"))]
    for r in d.select("i", *cols).collect():
        for k in pairs:
            assert r[f"{k}_ix"] == r[f"{k}_ct"], (k, r.i)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(WORDS + ["ab", "b", "a"]), max_size=12).map(" ".join))
def test_keyword_hits_automaton_equals_substring_search(text):
    """The worker-side fallback (plain substring search) and the automaton agree, also
    for overlapping and nested keywords."""
    from servicelens.functions import keywords as K
    vocab = K.VOCAB + ("ab", "b", "a b", "aadhaar-auth", "dh")
    a = K._automaton(vocab)
    if a is None:
        return
    assert K.hits_of(text, vocab, a) == K.hits_of(text, vocab, None)
    assert K.hits_of(None, vocab, a) is None


def test_keyword_hits_read_a_batch_in_slices():
    import tracemalloc

    import pyarrow as pa
    from servicelens.functions import keywords as K
    if not K.AVAILABLE:
        pytest.skip("no automaton")
    texts = pa.array(["urgent " + "x" * 20_000, None, ""] * 1000)
    tracemalloc.start()
    got = K._hits_udf(K.VOCAB).func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [K.hits_of(t, K.VOCAB) for t in texts.slice(0, 3).to_pylist()]
    assert got.to_pylist() == want * 1000 and peak < texts.nbytes / 2
    assert K._hits_udf(K.VOCAB).func(pa.array([], pa.string())).to_pylist() == []
