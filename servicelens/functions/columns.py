"""Column builders: every rule becomes a native Catalyst expression (no UDFs).

A rule table with hundreds of keywords would cost one Py4J round trip per literal and
per ``when`` when built through the Column API.  When the inputs are plain column
references and every literal has a safe SQL spelling, the same CASE / ``contains``
expression is written as SQL text and handed to ``F.expr`` in one call; otherwise
the Column API builds it.  Both routes give the same Catalyst expression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import keywords as K
from . import rules as R


class SqlText(str):
    """A trusted SQL expression fragment, usable wherever a column is expected."""


def as_col(c) -> Column:
    if isinstance(c, SqlText):
        return F.expr(c)
    return F.col(c) if isinstance(c, str) else c


_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def sql_ref(c) -> str | None:
    """Back-quoted name of a plain column reference (a name or ``F.col(name)``), the text
    of a ``SqlText`` in parentheses, else None."""
    if isinstance(c, SqlText):
        return f"({c})"
    if isinstance(c, str):
        name = c
    else:
        try:  # classic PySpark: inspect the JVM column node
            node = c._jc.node()
            if node.getClass().getSimpleName() != "UnresolvedAttribute":
                return None
            name = node.sql()
        except Exception:  # e.g. a Spark Connect column: use the Column API route
            return None
    return f"`{name}`" if _IDENT.match(name) else None


def sql_lit(v) -> str | None:
    """SQL spelling with the same type as ``F.lit(v)``; None when there is no safe one."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v) if -(1 << 31) <= v < (1 << 31) else f"{v}L"
    if isinstance(v, float):
        return f"{v!r}D" if math.isfinite(v) else None
    if isinstance(v, str) and "'" not in v and "\\" not in v and "\n" not in v:
        return f"'{v}'"
    return None


def _lits(*values) -> list[str] | None:
    out = [sql_lit(v) for v in values]
    return None if any(x is None for x in out) else out


# back-quoted text column -> back-quoted column holding its keyword hits (see
# ``keywords``); registered by the operator that adds both columns
KEYWORD_INDEX: dict[str, str] = {}


def sql_contains(ref: str, word: str) -> str | None:
    """``contains(ref, word)`` as SQL; a keyword-index lookup when ``ref`` is indexed."""
    idx = KEYWORD_INDEX.get(ref)
    if idx is not None and word in K.WORD_ID:
        return f"array_contains({idx}, {K.WORD_ID[word]})"
    lw = sql_lit(word)
    return None if lw is None else f"contains({ref}, {lw})"


def _sql_contains_any(t: str, words: Sequence[str]) -> str | None:
    parts = [sql_contains(t, w) for w in words]
    if any(p is None for p in parts):
        return None
    return "(" + " OR ".join(parts) + ")" if parts else "FALSE"


def ts_literal(as_of: str) -> Column:
    """``as_of`` as a TIMESTAMP_NTZ literal (wall-clock, independent of session zone)."""
    return F.lit(as_of).cast("timestamp_ntz")


def minutes_between(start, end) -> Column:
    """Exact elapsed minutes between two timestamps, as double."""
    return F.timestamp_diff("MICROSECOND", as_col(start), as_col(end)).cast("double") / F.lit(60_000_000.0)


def ladder(value, steps: Sequence[tuple], default) -> Column:
    """``value >= threshold`` ladder, highest threshold first."""
    ref, ls = sql_ref(value), _lits(*[x for st in steps for x in st], default)
    if ref is not None and ls is not None:
        whens = " ".join(f"WHEN {ref} >= {ls[2 * i]} THEN {ls[2 * i + 1]}" for i in range(len(steps)))
        return F.expr(f"CASE {whens} ELSE {ls[-1]} END")
    v = as_col(value)
    expr = None
    for threshold, label in steps:
        cond = v >= F.lit(threshold)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def clamp(value, lo: float, hi: float) -> Column:
    return F.least(F.greatest(as_col(value), F.lit(lo)), F.lit(hi))


def lookup(key, mapping: dict, default=None) -> Column:
    """Literal map lookup ``mapping.get(key, default)`` compiled to a CASE chain."""
    ref, ls = sql_ref(key), _lits(*[x for kv in mapping.items() for x in kv], default)
    if ref is not None and ls is not None:
        whens = " ".join(f"WHEN {ref} = {ls[2 * i]} THEN {ls[2 * i + 1]}" for i in range(len(mapping)))
        return F.expr(f"CASE {whens} ELSE {ls[-1]} END")
    k = as_col(key)
    expr = None
    for mk, mv in mapping.items():
        cond = k == F.lit(mk)
        expr = F.when(cond, F.lit(mv)) if expr is None else expr.when(cond, F.lit(mv))
    return expr.otherwise(F.lit(default))


def recode(key, mapping: dict, default=None) -> Column:
    """``mapping.get(key, default)``, keeping ``key`` itself when ``default`` is None."""
    ref, ls = sql_ref(key), _lits(*[x for kv in mapping.items() for x in kv])
    dflt = ref if default is None else sql_lit(default)
    if ref is not None and ls is not None and dflt is not None:
        whens = " ".join(f"WHEN {ref} = {ls[2 * i]} THEN {ls[2 * i + 1]}" for i in range(len(mapping)))
        return F.expr(f"CASE {whens} ELSE {dflt} END")
    k = as_col(key)
    expr = None
    for mk, mv in mapping.items():
        expr = F.when(k == mk, F.lit(mv)) if expr is None else expr.when(k == mk, F.lit(mv))
    return expr.otherwise(F.lit(default) if default is not None else k)


def breach_bucket(p) -> Column:
    return ladder(p, R.BREACH_BUCKETS, R.BREACH_BUCKET_DEFAULT)


def sla_status(p) -> Column:
    return ladder(p, R.SLA_STATUS, R.SLA_STATUS_DEFAULT)


def time_to_breach(p, response_remaining, resolution_remaining) -> Column:
    """Minutes until breach; ``int()`` truncation matches a bigint cast."""
    m = F.least(as_col(response_remaining), as_col(resolution_remaining))
    pc = as_col(p)
    expr = None
    for threshold, floor_min, share in R.TIME_TO_BREACH:
        val = F.greatest(F.lit(floor_min).cast("bigint"), (m * F.lit(share)).cast("bigint"))
        expr = F.when(pc >= threshold, val) if expr is None else expr.when(pc >= threshold, val)
    return expr.otherwise(m.cast("bigint"))


def contains_any(text_lower, words: Iterable[str]) -> Column:
    words = list(words)
    ref = sql_ref(text_lower)
    sql = _sql_contains_any(ref, words) if ref is not None else None
    if sql is not None:
        return F.expr(sql)
    t = as_col(text_lower)
    expr = None
    for w in words:
        c = t.contains(F.lit(w))
        expr = c if expr is None else (expr | c)
    return expr if expr is not None else F.lit(False)


def first_match(text_lower, rule_set: Sequence[tuple], default) -> Column:
    """Ordered classes; the first class with any keyword present wins."""
    ref = sql_ref(text_lower)
    if ref is not None:
        conds = [_sql_contains_any(ref, list(words)) for _, words in rule_set]
        ls = _lits(*[label for label, _ in rule_set], default)
        if ls is not None and all(c is not None for c in conds):
            whens = " ".join(f"WHEN {c} THEN {lab}" for c, lab in zip(conds, ls))
            return F.expr(f"CASE {whens} ELSE {ls[-1]} END")
    expr = None
    for label, words in rule_set:
        cond = contains_any(text_lower, words)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def keyword_score(text_lower, words: Iterable[str]) -> Column:
    """Number of distinct keywords present."""
    sql = _sql_keyword_score(sql_ref(text_lower), words)
    if sql is not None:
        return F.expr(sql)
    t = as_col(text_lower)
    return sum((t.contains(F.lit(w)).cast("int") for w in dict.fromkeys(words)), F.lit(0))


def _sql_keyword_score(ref: str | None, words: Iterable[str]) -> str | None:
    if ref is None:
        return None
    parts = [sql_contains(ref, w) for w in dict.fromkeys(words)]
    if any(p is None for p in parts):
        return None
    return "(" + " + ".join(["0"] + [f"CAST({p} AS INT)" for p in parts]) + ")"


def scored_match(text_lower, rule_set: Sequence[tuple], default) -> Column:
    """Argmax of distinct keyword hits; ties go to the first listed class; all zero -> default."""
    n = len(rule_set)
    ref = sql_ref(text_lower)
    scores = [_sql_keyword_score(ref, words) for _, words in rule_set]
    ls = _lits(*[label for label, _ in rule_set], default)
    if ls is not None and all(x is not None for x in scores):
        cands = [f"named_struct('s', {sc}, 'o', {n - i}, 'l', {ls[i]})" for i, sc in enumerate(scores)]
        best = f"greatest({', '.join(cands)})" if len(cands) > 1 else cands[0]
        return F.expr(f"CASE WHEN {best}.s > 0 THEN {best}.l ELSE {ls[-1]} END")
    candidates = [
        F.struct(keyword_score(text_lower, words).alias("s"), F.lit(n - i).alias("o"), F.lit(label).alias("l"))
        for i, (label, words) in enumerate(rule_set)
    ]
    best = F.greatest(*candidates) if len(candidates) > 1 else candidates[0]
    return F.when(best["s"] > 0, best["l"]).otherwise(F.lit(default))


def present(pairs) -> Column:
    """Array of the values whose condition holds, in order, without a lambda
    (``array_compact`` is a lambda ``filter`` and slows down a following ``explode``)."""
    empty = F.array().cast("array<string>")
    parts = [F.when(F.coalesce(cond, F.lit(False)), F.array(val)).otherwise(empty) for cond, val in pairs]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def actions_for(rule_rows: Sequence[tuple], p, category, priority, text_lower=None) -> Column:
    """Array of recommended actions in rule order, duplicates removed (first kept)."""
    sql = _sql_actions(rule_rows, p, category, priority, text_lower)
    if sql is not None:
        return F.expr(sql)
    pc, cc, prc = as_col(p), as_col(category), as_col(priority)
    parts = []
    for min_p, cat, max_prio, word, action in rule_rows:
        cond = F.lit(True)
        if min_p is not None:
            cond = cond & (pc >= F.lit(min_p))
        if cat is not None:
            cond = cond & (cc == F.lit(cat))
        if max_prio is not None:
            cond = cond & (prc <= F.lit(max_prio))
        if word is not None:
            cond = cond & as_col(text_lower).contains(F.lit(word))
        parts.append((cond, F.lit(action)))
    return F.array_distinct(present(parts))


def sql_present(pairs: Sequence[tuple[str, str]]) -> str:
    """SQL form of ``present``: (condition SQL, value SQL) pairs -> array of the values
    whose condition holds, in order."""
    parts = [f"CASE WHEN coalesce({c}, FALSE) THEN array({v}) ELSE CAST(array() AS ARRAY<STRING>) END"
             for c, v in pairs]
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _sql_actions(rule_rows, p, category, priority, text_lower) -> str | None:
    refs = {"p": sql_ref(p), "c": sql_ref(category), "pr": sql_ref(priority),
            "t": sql_ref(text_lower) if text_lower is not None else None}
    pairs = []
    for min_p, cat, max_prio, word, action in rule_rows:
        conds = ["TRUE"]
        for ref, op, v in (("p", ">=", min_p), ("c", "=", cat), ("pr", "<=", max_prio)):
            if v is not None:
                lv = sql_lit(v)
                if refs[ref] is None or lv is None:
                    return None
                conds.append(f"({refs[ref]} {op} {lv})")
        if word is not None:
            c = sql_contains(refs["t"], word) if refs["t"] is not None else None
            if c is None:
                return None
            conds.append(c)
        la = sql_lit(action)
        if la is None:
            return None
        pairs.append((" AND ".join(conds), la))
    return f"array_distinct({sql_present(pairs)})"


def fmt_ts(c) -> Column:
    return F.date_format(as_col(c), "yyyy-MM-dd HH:mm:ss")


def r6(c) -> Column:
    return F.round(as_col(c), 6)


def r2(c) -> Column:
    return F.round(as_col(c), 2)


def title_case(c) -> Column:
    """Python ``str.title()``: a letter is upper-cased when it starts the string or
    follows a non-letter, every other letter is lower-cased.  ``initcap`` only
    capitalises after whitespace, so this is built from ``transform`` instead.
    """
    s = F.lower(as_col(c))
    chars = F.split(s, "")
    idx = F.sequence(F.lit(1), F.size(chars))
    out = F.transform(
        idx,
        lambda i: F.when(i == 1, F.upper(F.element_at(chars, i)))
        .when(~F.element_at(chars, i - 1).rlike(r"^\p{L}$"), F.upper(F.element_at(chars, i)))
        .otherwise(F.element_at(chars, i)),
    )
    return F.when(s.isNull(), F.lit(None)).when(F.length(s) == 0, F.lit("")).otherwise(F.array_join(out, ""))
