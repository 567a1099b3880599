"""Stored AI responses -> structured analysis.

Responses are free text that should hold one JSON object but often does not: extra
text after it, a code fence around it, a missing comma, or no JSON at all.  The
parse stage needs Python's strict ``json`` (Spark's ``from_json`` is lenient and
would hide malformed input), so it runs as a vectorised ``mapInPandas`` step
over Arrow batches; each row is handled independently, so it scales with the number
of partitions.  Everything after the parse stage — field extraction, defaults,
the scrape fallback, multi-select cleaning — is native Spark.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import DEFAULT_AS_OF
from ..functions import rules as R
from ..functions.columns import ts_literal
from .util import computed_once

STAGES = ["strict", "extracted", "repaired", "scraped"]

# FIXED VALUES - where a JSON object is looked for when braces do not balance, in this order
_PATTERNS = [re.compile(x, re.S) for x in (
    r"```json\s*(\{.*?\})\s*```",
    r"(?:JSON|json|Response):\s*(\{.*?\})",
    r'\{[^{}]*"analysis_summary"[^{}]*\{.*?\}.*?\}',
    r"\{.*?\}",
)]
# FIXED VALUES - sections that every analysis has, empty where the reply leaves them out
REQUIRED_SECTIONS = ["analysis_summary", "technical_assessment", "business_impact", "sentiment_analysis",
                     "intelligent_routing", "confidence_metrics"]
_BRACE = re.compile(r"[{}]")
_MISSING_COMMA = re.compile(r'(?<=["\dlse}\]])\s+(?=")')
_STRICT_GAP = re.compile(r'"\s+"|(?<=[\d}\]le])\s+(?=")')
_TRAILING_COMMA = re.compile(r",(?=\s*[}\]])")
_COMMAS = re.compile(r",(?:\s*,)+")
_BARE_KEY = re.compile(r'([{,]\s*)([A-Za-z_]\w*)(\s*:)')
_COMMENT = re.compile(r"//[^\n]*\n|/\*.*?\*/", re.S)
_PY_LITERALS = {"True": "true", "False": "false", "None": "null"}


def _balanced(text: str) -> str | None:
    """First '{' up to the brace that closes it (braces counted without regard to
    strings, as the source application does)."""
    start = depth = None
    for m in _BRACE.finditer(text):
        if start is None:
            if m[0] == "{":
                start, depth = m.start(), 1
            continue
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return text[start:m.end()]
    return None


def _candidate(text: str) -> str | None:
    """The JSON-like part of a reply: balanced braces, else the first pattern that matches."""
    found = _balanced(text)
    for pattern in _PATTERNS if found is None else ():
        if m := pattern.search(text):
            return m[1] if pattern.groups else m[0]
    return found


def _repair(candidate: str) -> str:
    """First repair: double quotes, quoted keys, commas between a value and the next key, no
    comments, JSON literals, no trailing or doubled commas."""
    s = candidate.replace("'", '"')
    s = _BARE_KEY.sub(r'\1"\2"\3', s)
    s = _COMMENT.sub("\n", s)
    s = _MISSING_COMMA.sub(", ", s)
    for py, js in _PY_LITERALS.items():
        s = re.sub(rf"\b{py}\b", js, s)
    s = _COMMAS.sub(",", _TRAILING_COMMA.sub("", s))
    return s if s.rstrip().endswith("}") else s + "}"


def _repair_commas(candidate: str) -> str:
    """Second repair, on the text as it came: commas alone, quotes and comments untouched."""
    s = _STRICT_GAP.sub(lambda m: '", "' if m[0].startswith('"') else ", ", candidate)
    return _TRAILING_COMMA.sub("", _COMMAS.sub(",", s))


def _loads_obj(s: str):
    try:
        v = json.loads(s)
    except (ValueError, TypeError):
        return None
    return v if isinstance(v, dict) else None


def parse_one(raw) -> tuple[str, str | None]:
    """(stage, normalised JSON text or None)."""
    if raw is None:
        return "scraped", None
    obj = _loads_obj(raw)
    if obj is not None:
        return "strict", json.dumps(obj)
    candidate = _candidate(raw)
    if candidate is None:
        return "scraped", None
    for stage, repair in (("extracted", str), ("repaired", _repair), ("repaired", _repair_commas)):
        obj = _loads_obj(repair(candidate))
        if obj is not None:
            return stage, json.dumps(obj)
    return "scraped", None


def _parse_batches(key: str, raw: str):
    def fn(batches):
        for pdf in batches:
            res = [parse_one(r) for r in pdf[raw].tolist()]
            yield pd.DataFrame({key: pdf[key], raw: pdf[raw], "parse_stage": [r[0] for r in res],
                                "json_text": [r[1] for r in res]})
    return fn


ANALYSIS_SCHEMA = T.StructType([
    T.StructField("analysis_summary", T.StructType([
        T.StructField("department", T.StringType()), T.StructField("priority", T.StringType()),
        T.StructField("category", T.StringType()), T.StructField("urgency_score", T.IntegerType()),
        T.StructField("impact_scope", T.StringType())])),
    T.StructField("technical_assessment", T.StructType([
        T.StructField("estimated_resolution_time_hours", T.IntegerType())])),
    T.StructField("breach_risk_assessment", T.StructType([
        T.StructField("breach_probability", T.DoubleType()), T.StructField("confidence_level", T.DoubleType())])),
    T.StructField("timeline_prediction", T.StructType([T.StructField("estimated_resolution_hours", T.DoubleType())])),
    T.StructField("confidence_metrics", T.StructType([T.StructField("overall_confidence", T.DoubleType())])),
])


def parse_responses(df: DataFrame, key: str = "id", raw: str = "raw") -> DataFrame:
    """H14 + H15: parse stage per response, then the nested struct via ``from_json``."""
    schema = T.StructType([df.schema[key], df.schema[raw], T.StructField("parse_stage", T.StringType()),
                           T.StructField("json_text", T.StringType())])
    parsed = df.select(key, raw).mapInPandas(_parse_batches(key, raw), schema)
    # the raw text is passed through the batch function (no join back to the input)
    return parsed.withColumn("analysis", F.from_json("json_text", ANALYSIS_SCHEMA))


def with_sections(parsed: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """``json_text`` and ``analysis`` with every required section, an empty object where the reply leaves it out, and
    ``missing_sections`` (which those are), ``parsed_successfully``, ``analysis_timestamp``.

    A reply without an object is scraped for values (``analysis_fields``); it has no sections and misses none."""
    keys = F.coalesce(F.json_object_keys("json_text"), F.array().cast("array<string>"))
    wanted = F.array(*[F.lit(x) for x in REQUIRED_SECTIONS])
    missing = F.when(F.col("json_text").isNotNull(), F.array_except(wanted, keys)).otherwise(F.array().cast("array<string>"))
    d = computed_once(parsed, missing_sections=missing, _empty=F.size(keys) == 0)
    # json_text is an object as json.dumps writes it
    added = F.array_join(F.transform("missing_sections", lambda x: F.concat(F.lit('"'), x, F.lit('": {}'))), ", ")
    comma = F.when(F.col("_empty") | (F.size("missing_sections") == 0), "").otherwise(", ")
    whole = F.concat(F.expr("substring(json_text, 1, length(json_text) - 1)"), comma, added, F.lit("}"))
    return d.withColumn("json_text", whole).drop("_empty").withColumns({
        "analysis": F.from_json("json_text", ANALYSIS_SCHEMA), "parsed_successfully": F.lit(True), "analysis_timestamp": ts_literal(as_of)})


# FIXED VALUES — scrape fallback (department names in mention order, keyword lists,
# category names, urgency by priority)
SCRAPE_DEPARTMENTS = ["UIDAI", "MeitY", "DigitalMP", "eDistrict", "MPOnline"]
SCRAPE_DEPT_KEYWORDS = [
    ("UIDAI", ["aadhaar", "uid", "authentication", "biometric"]),
    ("MeitY", ["payment", "gateway", "transaction", "money"]),
    ("DigitalMP", ["portal", "website", "digital", "online"]),
    ("eDistrict", ["certificate", "document", "verification"]),
]
SCRAPE_PRIORITY_KEYWORDS = [
    ("P1", ["critical", "urgent", "emergency", "down", "outage"]),
    ("P2", ["high", "important", "serious", "timeout"]),
    ("P4", ["minor", "low", "small", "question"]),
]
SCRAPE_CATEGORIES = ["Authentication", "Payment", "Portal", "Network", "Certificate", "Integration"]
SCRAPE_CATEGORY_KEYWORDS = [
    ("Authentication", ["login", "password", "auth", "aadhaar", "biometric"]),
    ("Payment", ["payment", "transaction", "gateway", "money", "billing"]),
    ("Portal", ["portal", "website", "interface", "page"]),
    ("Network", ["network", "connection", "timeout", "slow"]),
    ("Certificate", ["certificate", "document", "verification"]),
    ("Integration", ["integration", "api", "service"]),
]
SCRAPE_URGENCY = {"P1": 9, "P2": 7, "P3": 5, "P4": 3}
URGENCY_PATTERN = r"(?i)(?:urgency|score).*?(\d+)"


def scrape_values(text: Column) -> Column:
    """Department / priority / category / urgency from free text (native)."""
    from ..functions.columns import SqlText, first_match, sql_ref
    ref = sql_ref(text)
    lt = SqlText(f"lower({ref})") if ref is not None else F.lower(text)
    # names first (first listed name present), then the keyword classes
    dept = F.coalesce(first_match(lt, [(d, [d.lower()]) for d in SCRAPE_DEPARTMENTS], None),
                      first_match(lt, SCRAPE_DEPT_KEYWORDS, "MPOnline"))
    p_hit = F.upper(F.regexp_extract(text, r"(?i)(P[1-4])", 1))
    prio = F.when(p_hit != "", p_hit).otherwise(first_match(lt, SCRAPE_PRIORITY_KEYWORDS, "P3"))
    cat = F.coalesce(first_match(lt, [(c, [c.lower()]) for c in SCRAPE_CATEGORIES], None),
                     first_match(lt, SCRAPE_CATEGORY_KEYWORDS, "Other"))
    u_txt = F.regexp_extract(text, URGENCY_PATTERN, 1)
    u_num = F.when(u_txt != "", u_txt.try_cast("int"))
    urg = F.when(u_txt != "", F.when(u_num.between(1, 10), u_num).otherwise(F.lit(5)))\
        .otherwise(F.coalesce(*[F.when(prio == k, F.lit(v)) for k, v in SCRAPE_URGENCY.items()], F.lit(5)))
    return F.struct(dept.alias("department"), prio.alias("priority"), cat.alias("category"),
                    urg.alias("urgency_score"))


def analysis_fields(parsed: DataFrame, raw: str = "raw") -> DataFrame:
    """Summary fields from the JSON, or scraped from the text when no JSON parsed;
    missing sections come out as NULL struct fields with documented defaults."""
    s = F.col("analysis.analysis_summary")
    scraped = scrape_values(F.col(raw))
    use_json = F.col("parse_stage") != "scraped"
    return (parsed
            .withColumn("department", F.when(use_json, s["department"]).otherwise(scraped["department"]))
            .withColumn("priority", F.when(use_json, s["priority"]).otherwise(scraped["priority"]))
            .withColumn("category", F.when(use_json, s["category"]).otherwise(scraped["category"]))
            .withColumn("urgency_score", F.when(use_json, F.coalesce(s["urgency_score"], F.lit(5)))
                        .otherwise(scraped["urgency_score"])))


def clean_multiselect(df: DataFrame) -> DataFrame:
    """Fields that list several values ('A|B', 'A, B'; a '/' is no separator) reduced to one:
    department = the first part (it may be empty), category = earliest in the fixed order, priority =
    most urgent of P1-P4 found inside the parts, scope = most severe.  Unknown values give 'Other',
    'P3' and 'single_user'; a field with one value (or none) stays as it is."""
    def parts(c: str) -> Column:
        return F.transform(F.split(F.col(c), r"[|,]", -1), lambda x: F.trim(x))

    def several(c: str) -> Column:
        return F.col(c).rlike(r"[|,]")

    def best(c: str, order: list[str], default: str) -> Column:
        present_ = [F.when(F.array_contains(parts(c), v), F.lit(v)) for v in order]
        return F.when(several(c), F.coalesce(*present_, F.lit(default))).otherwise(F.col(c))

    def inside(x: Column) -> Column:
        """The first of P1-P4 (in this order) that a part contains."""
        return F.coalesce(*[F.when(x.contains(v), F.lit(v)) for v in R.PRIORITY_ORDER])

    priority = F.coalesce(F.array_min(F.transform(parts("priority"), inside)), F.lit(R.PRIORITY_DEFAULT))
    return df.withColumns({
        "department": F.when(several("department"), F.get(parts("department"), F.lit(0))).otherwise(F.col("department")),
        "category": best("category", R.CATEGORY_ORDER, R.CATEGORY_DEFAULT),
        "priority": F.when(several("priority"), priority).otherwise(F.col("priority")),
        "impact_scope": best("impact_scope", R.SCOPE_ORDER, "single_user")})


def flatten_prediction(parsed: DataFrame) -> DataFrame:
    """Probability (.5) and confidence (.8) of the risk assessment and hours (24) of the
    timeline, lifted from the nested JSON."""
    risk, timeline = F.col("analysis.breach_risk_assessment"), F.col("analysis.timeline_prediction")
    return (parsed.withColumn("breach_probability", F.coalesce(risk["breach_probability"], F.lit(0.5)))
            .withColumn("prediction_confidence", F.coalesce(risk["confidence_level"], F.lit(0.8)))
            .withColumn("estimated_hours", F.coalesce(timeline["estimated_resolution_hours"], F.lit(24.0))))


# FIXED VALUES - the number before probability / risk / chance, the number after confidence, whole hours
PROBABILITY_PATTERN = r"(?i)(\d+(?:\.\d+)?)\s*%?\s*(?:probability|risk|chance)"
CONFIDENCE_PATTERN = r"(?i)confidence[:\s]*(\d+(?:\.\d+)?)\s*%?"
HOURS_PATTERN = r"(?i)(\d+)\s*hours?"


def scrape_prediction(text: Column) -> Column:
    """Probability (.5), confidence (.7) and hours (24, at least 1) by regex; values over 1 are
    percents; clamped to 0..1."""
    def share(pattern: str, default: float) -> Column:
        x = F.regexp_extract(text, pattern, 1).try_cast("double")
        return F.least(F.coalesce(F.when(x > 1, x / 100.0).otherwise(x), F.lit(default)), F.lit(1.0))

    hours = F.regexp_extract(text, HOURS_PATTERN, 1).try_cast("double")
    return F.struct(share(PROBABILITY_PATTERN, 0.5).alias("breach_probability"),
                    share(CONFIDENCE_PATTERN, 0.7).alias("confidence"),
                    F.greatest(F.coalesce(hours, F.lit(24.0)), F.lit(1.0)).alias("estimated_hours"))


REC_SCHEMA = T.StructType([T.StructField("recommendations", T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("potential_savings", T.DoubleType()),
    T.StructField("implementation_effort", T.StringType()), T.StructField("priority", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("gem_integration_required", T.BooleanType()),
    T.StructField("compliance_impact", T.StringType()), T.StructField("timeline_months", T.DoubleType()),
    T.StructField("risk_level", T.StringType())])))])
# FIXED VALUES - what a recommendation has where the reply leaves it out
REC_DEFAULTS = {"type": "LICENSE_REDUCTION", "description": "", "potential_savings": 0.0, "confidence": 0.8,
                "priority": "MEDIUM", "implementation_effort": "MEDIUM", "timeline_months": 3.0, "risk_level": "LOW",
                "compliance_impact": "Positive", "gem_integration_required": True}


def parse_recommendations(df: DataFrame, text: str = "reply") -> DataFrame:
    """The object in a reply (first '{' to last '}'), one row per entry of its ``recommendations``
    with defaults; a title left out is description[:50] + '...'; months are whole.  A reply without an
    object, or whose object does not parse, gives no rows."""
    found = F.nullif(F.regexp_extract(F.col(text), r"(?s)\{.*\}", 0), F.lit(""))
    # posexplode_outer + position filter: a plain posexplode would push an inferred
    # size(from_json(...)) > 0 filter below and parse every text twice
    recs = (df.select("*", F.posexplode_outer(F.from_json(found, REC_SCHEMA)["recommendations"]).alias("rec_pos", "rec"))
            .filter(F.col("rec_pos").isNotNull()))
    value = lambda k: F.coalesce(F.col(f"rec.{k}"), F.lit(REC_DEFAULTS[k]))
    title = F.coalesce(F.col("rec.title"), F.concat(F.substring(value("description"), 1, 50), F.lit("...")))
    return (recs.withColumns({k: value(k) for k in REC_DEFAULTS if k != "timeline_months"})
            .withColumns({"title": title, "timeline_months": F.floor(value("timeline_months")).cast("int"),
                          "approval_needed": F.lit(True)}).drop("rec"))
