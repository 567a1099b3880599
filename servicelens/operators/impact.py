"""Change gating.

Optimisation requests are checked asset by asset against the SLA state of the
tickets that mention the asset; licence changes are checked service by service
against the latest service state.  All per-request logic uses higher-order array
functions on the request's own (small) arrays; the only shuffles are the asset /
service lookups and the regrouping by request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.columns import present
from ..session import cut_lineage
from .asof import as_of_join
from .util import computed_once


#: Characters of an anchor of up to a thousand ids, slots of the histogram that says how common an anchor is, most bits of the
#: anchors' Bloom filter.
_GRAM, _SLOTS, _MOST_BITS = 5, 1 << 12, 1 << 20
#: First characters of anchors up to which positions are chosen by them.
_STARTS = 64


def _longs(values: list[int]) -> Column:
    """A constant array.  As one text it is a small tree for the analyzer; the optimizer folds it into a literal once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _hashed(chars: Column, at: Column, size: Column) -> Column:
    """Hash of ``size`` characters from ``at`` on; ``chars`` are the characters of a text, so no position costs a walk to it."""
    return F.xxhash64(F.slice(chars, at, size))


class AnchorIndex:
    """Every id by one of its q-grams, the one that is rarest among the ids (by a histogram of hashes), so that few ids
    share an anchor and few texts hold it; an id shorter than q is its own anchor.  The anchors' Bloom filter is a constant of
    at most 128 kB, whatever the number of ids; beyond it lets more positions through, which ``contains`` turns away.

    q grows by one character with every ten times as many ids: with a fixed one there are only so many anchors (of digits
    100,000 of five), so that the ids of one, and with them the pairs of a row and an id, would grow with the ids."""

    def __init__(self, ids: DataFrame, column: str, gram: int | None = None):
        gram = gram or _GRAM + len(str(max(0, ids.count() - 1) // 1000).lstrip("0"))
        chars, size = F.split(F.col(column), ""), F.least(F.length(column), F.lit(gram))
        grams = ids.filter(F.length(column) > 0).select(column, size.alias("_n"), F.explode_outer(F.transform(
            F.sequence(F.lit(1), F.length(column) - size + 1),
            lambda k: F.struct(_hashed(chars, k, size).alias("_h"), F.get(chars, k - 1).alias("_c")))).alias("_g")).select("*", "_g.*")
        seen = {r["slot"]: r["n"] for r in grams.groupBy(F.pmod("_h", F.lit(_SLOTS)).alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()}
        common = F.get(_longs([seen.get(i, 0) for i in range(_SLOTS)]), F.pmod("_h", F.lit(_SLOTS)).cast("int"))
        #: column, _n (its length), _h
        chosen = grams.groupBy(column, "_n").agg(F.min_by(F.struct("_h", "_c"), F.struct(common, F.col("_h"))).alias("_g"))
        self.anchors = chosen.select(column, "_n", "_g._h")
        # with few first characters most positions are passed over before anything is hashed
        starts = [r[0] for r in chosen.select("_g._c").distinct().limit(_STARTS + 1).collect()]
        self._starts = "".join(starts) if len(starts) <= _STARTS else None
        shape = ids.agg(F.count_if(F.length(column) > 0).alias("n"), F.max(F.length(column)).alias("longest"),
                        F.collect_set(size).alias("sizes"), F.count_if(F.length(column) == 0).alias("empty")).first()
        self.longest, self.sizes, self.empty = shape["longest"] or 0, sorted(x for x in shape["sizes"] if x), bool(shape["empty"])
        self.bits = min(_MOST_BITS, max(64, 1 << (64 * max(1, shape["n"]) - 1).bit_length()))
        place = F.pmod("_h", F.lit(self.bits))
        words = {r["w"]: r["b"] for r in self.anchors.groupBy(F.floor(place / 64).cast("int").alias("w")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))).alias("b")).collect()}
        self._words = _longs([words.get(i, 0) for i in range(self.bits // 64)])

    def _known(self, h: Column) -> Column:
        place = F.pmod(h, F.lit(self.bits))
        return F.getbit(F.get(self._words, F.floor(place / 64).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1

    def found(self, text: Column) -> Column:
        """The anchors that may be in ``text``: array of (``h``, ``around``), with the characters in reach of an id."""
        if not self.sizes:
            return F.array().cast("array<struct<h:bigint,around:string>>")
        longest = F.lit(self.longest)

        def of(chars: Column) -> Column:
            size = F.size(chars)
            spots = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
            if self._starts is not None:
                spots = F.filter(spots, lambda i: F.instr(F.lit(self._starts), F.get(chars, i - 1)) > 0)
            every = F.flatten(F.transform(spots, lambda i: F.transform(F.array(*map(F.lit, self.sizes)), lambda n: F.struct(
                i.alias("i"), n.alias("n"), _hashed(chars, i, n).alias("h")))))
            at = F.filter(every, lambda s: self._known(s["h"]) & (s["i"] + s["n"] - 1 <= size))
            return F.transform(at, lambda s: F.struct(s["h"].alias("h"), F.array_join(F.slice(
                chars, F.greatest(s["i"] - longest + s["n"], F.lit(1)), longest + longest - s["n"]), "").alias("around")))

        # as the variable of a lambda the characters are split off once, not at every position
        return F.flatten(F.transform(F.array(F.split(text, "")), of))


def containing(texts: DataFrame, fields: list[str], ids: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Pairs of a row of ``texts`` and a distinct id of ``ids`` that one of its ``fields`` contains, each pair once: ``column`` and the
    columns ``keep`` of the row.

    A row travels only with the anchors that the Bloom filter lets through and the characters around them; ``contains``
    on these decides.  Null fields contain nothing, the empty id is in every row."""
    # written once: the index reads the ids several times
    index = AnchorIndex(cut_lineage(ids.select(column).dropna().distinct()), column)
    found = F.array_distinct(F.concat(*[index.found(F.coalesce(F.col(f), F.lit(""))) for f in fields]))
    rows = computed_once(texts.select(*keep, found.alias("_f")), _found=F.col("_f")).drop("_f")
    by_anchor = F.transform(F.array_distinct(F.transform("_found", lambda x: x["h"])), lambda h: F.struct(
        h.alias("_h"), F.transform(F.filter("_found", lambda x: x["h"] == h), lambda x: x["around"]).alias("_around")))
    spread = rows.select(*keep, F.explode_outer(by_anchor).alias("_a")).filter("_a IS NOT NULL").select(*keep, "_a._h", "_a._around")
    pairs = spread.join(index.anchors.drop("_n"), "_h").filter(F.exists("_around", lambda x: F.contains(x, F.col(column)))).select(column, *keep)
    if index.empty:
        pairs = pairs.unionByName(texts.select(F.lit("").alias(column), *keep))
    return pairs


def asset_sla_status(scored_tickets: DataFrame, assets: DataFrame, p: str = "breach_probability") -> DataFrame:
    """C4 + D2: SLA roll-up of the tickets whose title or description *contains* each asset id (``asset_id``, any shape, any
    number); see ``containing``.  A ticket counts once per asset."""
    m = containing(scored_tickets.select("title", "description", F.col(p).alias("_p")), ["title", "description"], assets, "asset_id", ["_p"])
    return (m.groupBy("asset_id")
            .agg(F.avg("_p").alias("avg_breach_probability"),
                 F.sum((F.col("_p") >= 0.7).cast("long")).alias("at_risk_services"),
                 F.sum((F.col("_p") < 0.7).cast("long")).alias("healthy_services"),
                 F.count(F.lit(1)).alias("total_services"))
            .withColumn("overall_status", F.when(F.col("avg_breach_probability") >= 0.5, F.lit("at_risk"))
                        .otherwise(F.lit("healthy"))))


def requested_assets(requests: DataFrame) -> DataFrame:
    """The distinct assets that optimisation requests name."""
    return requests.select(F.explode("affected_assets").alias("asset_id")).distinct()


def _raise(level: Column) -> Column:
    return F.when(level == "low", F.lit("medium")).when(level == "medium", F.lit("high")).otherwise(level)


def change_risk(change: Column, at_risk: Column) -> Column:
    """V1 for one change struct: (risk_level, factors array)."""
    typ = change["type"]
    pct = change["reduction_percentage"]
    depts = change["affected_departments"]
    pct_txt = pct.cast("string")
    level = (F.when((typ == "license_reduction") & (pct > 50), F.lit("high"))
             .when((typ == "license_reduction") & (pct > 25), F.lit("medium"))
             .when((typ == "license_consolidation") & (depts > 5), F.lit("medium"))
             .when(typ == "vendor_change", F.lit("high"))
             .otherwise(F.lit("low")))
    factor = (F.when((typ == "license_reduction") & (pct > 50),
                     F.concat(F.lit("Large license reduction ("), pct_txt, F.lit("%)")))
              .when((typ == "license_reduction") & (pct > 25),
                    F.concat(F.lit("Moderate license reduction ("), pct_txt, F.lit("%)")))
              .when((typ == "license_consolidation") & (depts > 5),
                    F.concat(F.lit("Multiple departments affected ("), depts.cast("string"), F.lit(")")))
              .when(typ == "vendor_change", F.lit("Vendor change introduces operational risk")))
    factors = present([(factor.isNotNull(), factor), (at_risk, F.lit("Current SLA status is at risk"))])
    return F.struct(F.when(at_risk, _raise(level)).otherwise(level).alias("risk_level"), factors.alias("factors"))


def asset_impact(changes: Column, at_risk: Column) -> Column:
    """V2: ordered fold over the request's changes: a high change always sets high and
    adds its factors; a medium change only while the asset is not high yet."""
    risks = F.transform(changes, lambda c: change_risk(c, at_risk))
    init = F.struct(F.lit("low").alias("risk_level"), F.array().cast("array<string>").alias("factors"))

    def step(acc, r):
        lv = r["risk_level"]
        is_high = lv == "high"
        is_med = (lv == "medium") & (acc["risk_level"] != "high")
        return F.struct(
            F.when(is_high, F.lit("high")).when(is_med, F.lit("medium")).otherwise(acc["risk_level"]).alias("risk_level"),
            F.when(is_high | is_med, F.concat(acc["factors"], r["factors"])).otherwise(acc["factors"]).alias("factors"))

    return F.aggregate(risks, init, step)


def optimization_decisions(requests: DataFrame, asset_status: DataFrame) -> DataFrame:
    """C8 + D15 + V3: the impact of a request's changes is folded once for an asset at risk and once for
    a healthy one; only (request, position, asset) is exploded and looked up (healthy when no
    ticket mentions the asset), and every asset then takes one of the two."""
    looked_up = (requests.select("optimization_id", F.posexplode("affected_assets").alias("asset_pos", "asset_id"))
                 .join(asset_status.select("asset_id", (F.col("overall_status") == "at_risk").alias("at_risk")), "asset_id", "left")
                 .groupBy("optimization_id").agg(F.array_sort(F.collect_list(F.struct(
                     "asset_pos", "asset_id", F.coalesce("at_risk", F.lit(R.ASSET_DEFAULT_STATUS[4] == "at_risk")).alias("at_risk")
                 ))).alias("_assets")))
    folded = computed_once(requests, _calm=asset_impact(F.col("proposed_changes"), F.lit(False)),
                           _tense=asset_impact(F.col("proposed_changes"), F.lit(True)))
    joined = (folded.select("optimization_id", "potential_savings", "_calm", "_tense")
              .join(looked_up, "optimization_id", "left")
              .withColumn("_assets", F.coalesce("_assets", F.array().cast(looked_up.schema["_assets"].dataType))))

    def at(level: str) -> Column:
        return F.filter("_assets", lambda a: F.when(a["at_risk"], F.col("_tense.risk_level")).otherwise(F.col("_calm.risk_level")) == level)

    grouped = joined.withColumns({"_ha": at("high"), "_ma": at("medium")}).withColumns({
        "high_risk_assets": F.size("_ha").cast("long"), "medium_risk_assets": F.size("_ma").cast("long")})
    overall = (F.when(F.col("high_risk_assets") > 0, F.lit("high"))
               .when(F.col("medium_risk_assets") > 3, F.lit("medium")).otherwise(F.lit("low")))
    savings = F.col("potential_savings")
    approved = (F.when(overall == "high", F.lit(False))
                .when(overall == "medium", savings > R.CONDITIONAL_SAVINGS_MIN).otherwise(F.lit(True)))
    level = F.when((overall == "medium") & (savings > R.CONDITIONAL_SAVINGS_MIN), F.lit("conditional")) \
        .otherwise(F.lit("automatic"))
    conditions = F.when((overall == "medium") & (savings > R.CONDITIONAL_SAVINGS_MIN),
                        F.array(F.lit("Implement in phases"), F.lit("Monitor SLA impact closely"),
                                F.lit("Prepare rollback plan"))).otherwise(F.array().cast("array<string>"))
    reasoning = (F.when(overall == "high", F.lit("High SLA risk identified"))
                 .when((overall == "medium") & (savings > R.CONDITIONAL_SAVINGS_MIN),
                       F.lit("Medium risk acceptable due to high savings"))
                 .when(overall == "medium", F.lit("Medium risk not justified by savings amount"))
                 .otherwise(F.lit("Low SLA risk identified")))
    # one projection (one analysis pass) for all decision columns
    return grouped.withColumns({
        "overall_risk_level": overall,
        "mitigation_recommendations": present([(overall == "high", F.lit("Defer optimization until SLA risk is reduced")),
                                               (overall == "medium", F.lit("Implement changes in phases"))]),
        "approval_recommended": overall != "high",
        # factors of high-risk assets only, in asset order
        "risk_factors": F.flatten(F.transform("_ha", lambda a: F.when(a["at_risk"], F.col("_tense.factors")).otherwise(F.col("_calm.factors")))),
        # Affected services = high-risk list followed by the medium-risk list
        "affected_services": F.concat(F.transform("_ha", lambda x: x["asset_id"]),
                                      F.transform("_ma", lambda x: x["asset_id"])),
        "approved": approved,
        "approval_level": level,
        "conditions": conditions,
        "reasoning": reasoning,
    }).drop("_assets", "_calm", "_tense", "_ha", "_ma")


def service_change_risk(change_type: Column, p: Column) -> Column:
    """V4: downgrade medium, removal high; raised one level when p >= .7 with a factor."""
    level = (F.when(change_type == "license_downgrade", F.lit("medium"))
             .when(change_type == "license_removal", F.lit("high")).otherwise(F.lit("low")))
    f0 = (F.when(change_type == "license_downgrade", F.lit("License downgrade may affect functionality"))
          .when(change_type == "license_removal", F.lit("License removal will affect service availability")))
    at_risk = p >= 0.7
    f1 = F.when(at_risk, F.format_string("Service already at risk (breach probability: %.1f%%)", F.round(p * 100.0, 1)))
    return F.struct(F.when(at_risk, _raise(level)).otherwise(level).alias("risk_level"),
                    present([(f0.isNotNull(), f0), (f1.isNotNull(), f1)]).alias("factors"))


def service_states(services: DataFrame, service_state: DataFrame, at: str | None = None, tie: str | None = None) -> DataFrame:
    """``services`` (``service_id``) with ``breach_probability``, ``sla_status``, ``response_remaining`` and
    ``resolution_remaining`` of their state, or the defaults .2 / HEALTHY / 60 / 240.

    Without ``at``, ``service_state`` has the one state per service that counts.  With ``at``, a time column of ``services``, it
    has versions (``version_ts``; of equal times the one with the highest ``tie``), and each row sees the one valid at its time."""
    names = ["breach_probability", "sla_status", "response_remaining", "resolution_remaining"]
    if at is None:
        found = services.join(service_state.select("service_id", F.struct(*names).alias("_state")), "service_id", "left")
    else:
        versions = service_state.select("service_id", "version_ts", *([tie] if tie else []), *names)
        found = as_of_join(services, versions, "service_id", at, "version_ts", tie, out="_state")
    return found.withColumns({n: F.coalesce(F.col(f"_state.{n}"), F.lit(v)) for n, v in zip(names, R.SERVICE_DEFAULT_STATE)}).drop("_state")


def license_change_decisions(changes: DataFrame, service_state: DataFrame, at: str | None = None, tie: str | None = None) -> DataFrame:
    """C5 + V4 + V5: services of each change joined to their state (``service_states``; with ``at``, a time column of
    ``changes``, the state valid then), per-service risk, per-change decision."""
    if at is None:
        d = R.SERVICE_DEFAULT_STATE
        st = service_state.select("service_id", F.col("breach_probability").alias("_p"))
        per = (changes.select("change_id", "change_type", F.posexplode("affected_services").alias("pos", "service_id"))
               .join(st, "service_id", "left").withColumn("_p", F.coalesce(F.col("_p"), F.lit(d[0]))))
    else:
        per = service_states(changes.select("change_id", "change_type", F.col(at).alias("_at"),
                                            F.posexplode("affected_services").alias("pos", "service_id")), service_state, "_at", tie) \
            .withColumnRenamed("breach_probability", "_p")
    per = per.withColumn("risk", service_change_risk(F.col("change_type"), F.col("_p")))
    lv = F.col("risk.risk_level")
    g = per.groupBy("change_id").agg(
        F.sum((lv == "high").cast("long")).alias("high_risk_services"),
        F.sum((lv == "medium").cast("long")).alias("medium_risk_services"),
        F.sum((lv == "low").cast("long")).alias("low_risk_services"),
        # as many as the change names services
        F.array_sort(F.collect_list(F.struct("pos", F.col("risk.factors").alias("f")))).alias("_f"))
    overall = (F.when(F.col("high_risk_services") > 0, F.lit("high"))
               .when(F.col("medium_risk_services") > 2, F.lit("medium")).otherwise(F.lit("low")))
    high, medium = F.col("high_risk_services"), F.col("medium_risk_services")
    conditional = (high == 0) & (medium > 0)
    none = F.array().cast("array<string>")
    return g.withColumns({
        "overall_risk": overall, "approved": high == 0,
        "approval_level": F.when(conditional, F.lit("conditional")).otherwise(F.lit("automatic")),
        "conditions": F.when(conditional, F.array(*[F.lit(c) for c in R.LICENSE_CONDITIONS])).otherwise(none),
        "reasoning": F.when(high > 0, F.concat(F.lit("High risk services identified: "), high.cast("string")))
        .when(medium > 0, F.concat(F.lit("Medium risk services require careful monitoring: "), medium.cast("string"))),
        "risk_factors": F.flatten(F.transform("_f", lambda x: x["f"])),
    }).drop("_f")
