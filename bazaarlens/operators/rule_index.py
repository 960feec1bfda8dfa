"""Many rule sets over the same offers by an inverted index of their terms.

A rule term is found where its text without spaces stands in the offer's text without spaces
(capacities and kits by a pattern on top of that). So it is indexed under one short piece of itself:
its first three characters, or all of a shorter one. The offers' different texts are cut into such
pieces, pieces that no term has are dropped in place, the others meet the index in one join, and each
meeting is verified by the term's own test. What a text says to each rule set is worked out once, and
the offers meet that by their text. The number of scans and joins does not depend on the number of
rule sets; the work grows with the hits.

Rule sets are documents of a few kilobytes given by the caller. An empty list gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions.core import barrier, constant, text
from bazaarlens.functions.terms import UNITS, plain_term, quantity_patterns
from bazaarlens.operators import deals
from bazaarlens.sources.rules import RuleConfig

#: Characters of the piece a term is indexed under.
PIECE = 3
TERMS = "rules string, role string, slot int, place int, term string, piece string, test string, word string, patterns array<string>, points int"
SETTINGS = (
    "rules string, context_check boolean, image_check boolean, groups array<string>, required string, distract_rejects boolean, "
    "units array<struct<name:string,price:double>>, budgets array<struct<name:string,amount:double>>, fallback double"
)


def _test_of(term: str, kits: bool) -> tuple[str, str, str]:
    """How a term of the rule lists is verified, by what, and the text it cannot match without."""
    compact = plain_term(term).replace(" ", "")
    if capacity := re.fullmatch(rf"(\d+)({UNITS})", compact):
        number, unit = capacity.groups()
        return "pattern", rf"(?<!\d){number}\s*{unit}(?![a-z0-9])", number
    kit = re.fullmatch(rf"(\d+)x(\d+)({UNITS})", compact)
    if kit and kits:
        count, number, unit = kit.groups()
        return "pattern", rf"(?<![a-z0-9]){count}\s*x\s*{number}\s*{unit}(?![a-z0-9])", number
    return "compact", compact, compact


def index_rows(configs: list[RuleConfig]) -> list[tuple]:
    """One row of TERMS for each term of each rule set, with the piece that a text needs to match it."""
    rows = []

    def add(config, role, slot, place, term, test, word, needed, patterns=None, points=0):
        if needed:
            rows.append((config.name, role, slot, place, term, needed[:PIECE], test, word, patterns, points))

    def listed(config, role, slot, terms, kits=True):
        for place, term in enumerate(terms):
            add(config, role, slot, place, term, *_test_of(term, kits))

    for c in configs:
        listed(c, "exclude", 0, map(plain_term, c.exclude_words))
        listed(c, "required", 0, map(plain_term, c.required_words))
        listed(c, "distract", 0, map(plain_term, c.distractor_words))
        for i, group in enumerate(c.required_groups):
            listed(c, "group", i, group)
        for i, rule in enumerate(c.unit_rules):
            for place, term in enumerate(rule.match):
                words = quantity_patterns(term, list(rule.unit_aliases))
                add(c, "unit", i, place, term, *_test_of(term, False), patterns=words)
        plain = [("reject", 0, p, 0) for p in c.reject_patterns]
        plain += [("config", name, p, 0) for name, patterns in c.config_patterns.items() for p in patterns]
        titles = [("premium", 0, p, deals.BRAND_BONUS) for p in c.premium_brands]
        titles += [("points", 0, p, points) for p, points in c.positive_keywords.items()]
        titles += [("points", 0, p, -deals.NEGATIVE_MALUS) for p in c.negative_keywords]
        for test, group in (("plain", plain), ("title", titles)):
            for place, (role, name, term, points) in enumerate(group):
                word = plain_term(term)
                add(c, role, 0, place, name if role == "config" else term, test, word, word.replace(" ", ""), points=points)
    return rows


def settings(spark: SparkSession, configs: list[RuleConfig]) -> DataFrame:
    """One row for each rule set: what decisions need beside the matched terms."""
    rows = [
        (
            c.name,
            c.context_check,
            c.image_check,
            [", ".join(g) for g in c.required_groups],
            ", ".join(c.required_words) if c.required_words and not c.required_groups else None,
            not c.context_check,
            [(u.name, float(u.max_price_per_unit)) for u in c.unit_rules],
            [(n, float(a)) for n, a in c.budget.items()],
            float(c.budget.get("standard", max(c.budget.values()) if c.budget else 999.0)),
        )
        for c in configs
    ]
    return spark.createDataFrame(rows, SETTINGS)


def text_key() -> Column:
    return F.sha2(F.to_json(F.struct(text("title"), text("description"))), 256)


def term_hits(df: DataFrame, configs: list[RuleConfig]) -> DataFrame:
    """(text_key, rules, hits): matched terms of each rule set in each different text, in rule order."""
    texts = deals.full_text(df.select(text("title").alias("title"), text("description").alias("description")).distinct())
    texts = texts.withColumn("text_key", text_key()).withColumn("compact", F.replace("_full", F.lit(" "), F.lit("")))
    size = F.char_length("compact")

    def cut(length: int) -> Column:
        places = F.sequence(F.lit(1), size - (length - 1))
        of = F.transform(places, lambda at: F.substring(F.col("compact"), at, F.lit(length)))
        return F.when(size >= length, of).otherwise(F.array().cast("array<string>"))

    pieces = F.concat(*map(cut, range(1, PIECE + 1)))
    rows = index_rows(configs)
    terms = df.sparkSession.createDataFrame(rows, TERMS)
    # pieces that no term is under are dropped in place, before any join
    known = constant(sorted({row[5] for row in rows}), "array<string>")
    met = texts.withColumn("piece", F.explode(F.array_intersect(pieces, known)))
    matched = met.join(terms, "piece").where(
        F.when(F.col("test") == "pattern", F.regexp_like("_full", F.col("word")))
        .when(F.col("test") == "compact", F.contains("compact", F.col("word")))
        .when(F.col("test") == "plain", F.contains("_full", F.col("word")))
        .otherwise(F.contains("_title", F.col("word")))
    )
    numbers = F.transform("patterns", lambda p: F.call_function("regexp_extract", F.col("_full"), p, F.lit(1)).try_cast("int"))
    quantity = F.get(F.filter(numbers, lambda q: q > 0), F.lit(0))
    hit = F.struct("role", "slot", "place", "term", quantity.alias("quantity"), "points")
    return matched.groupBy("text_key", "rules").agg(F.array_sort(F.collect_list(hit)).alias("hits"))


def _of(role: str, slot: Column | None = None) -> Column:
    def wanted(h):
        same = h["role"] == role
        return same if slot is None else same & (h["slot"] == slot)

    return F.filter("hits", wanted)


def _terms_of(role: str, slot: Column | None = None) -> Column:
    return F.transform(_of(role, slot), lambda h: h["term"])


def _found(rows: DataFrame) -> DataFrame:
    """What the hits and settings of each text and rule set say, before anything of an offer but its text."""
    slots = lambda of: F.when(F.size(of) > 0, F.sequence(F.lit(0), F.size(of) - 1)).otherwise(F.array().cast("array<int>"))
    missing = F.filter(slots("groups"), lambda i: ~F.exists("hits", lambda h: (h["role"] == "group") & (h["slot"] == i)))
    rows = rows.withColumns(
        {"_excluded": _terms_of("exclude"), "_distract": _terms_of("distract"), "_missing": F.get(missing, F.lit(0))}
    )
    listed = lambda label, terms: F.concat(F.lit(label + ": "), F.array_join(terms, ", "))
    lacks = F.col("required").isNotNull() & ~F.exists("hits", lambda h: h["role"] == "required")
    rows = rows.withColumn(
        "rule_reject",
        F.when(F.size("_excluded") > 0, listed("Parole escluse", F.col("_excluded")))
        .when(F.col("_missing").isNotNull(), F.concat(F.lit("Manca gruppo richiesto: "), F.get("groups", F.col("_missing"))))
        .when(lacks, F.concat(F.lit("Manca parola richiesta: "), "required"))
        .when(F.col("distract_rejects") & (F.size("_distract") > 0), listed("Distrattori", F.col("_distract"))),
    )
    groups = F.transform(
        F.filter(slots("groups"), lambda i: F.exists("hits", lambda h: (h["role"] == "group") & (h["slot"] == i))),
        lambda i: deals.evidence_item("rules", "MATCH", listed("Gruppo richiesto OK", _terms_of("group", i))),
    )
    reason = F.col("rule_reject")
    others = F.array_compact(
        F.array(
            F.when(
                F.size("_distract") > 0,
                deals.evidence_item("rules", "DISTRACTOR", listed("Distrattori da verificare con AI", F.col("_distract"))),
            ),
            deals.evidence_item("rules", F.when(reason.isNull(), "ACCEPT").otherwise("REJECT"), F.coalesce(reason, F.lit("Regole base OK"))),
        )
    )

    def unit(i):
        mine = _of("unit", i)
        most = F.array_max(F.transform(mine, lambda h: h["quantity"]))
        explicit = F.when(most.isNotNull(), F.least(most, F.lit(deals.MAX_QUANTITY)))
        return F.when(
            F.size(mine) > 0,
            F.struct(
                explicit.isNotNull().cast("int").alias("explicit"),
                F.size(mine).alias("n_terms"),
                (-(F.coalesce(explicit, F.lit(1)) * F.get("units", i)["price"])).alias("minus_total"),
                (-i).alias("minus_position"),
                F.get("units", i)["name"].alias("name"),
            ),
        )

    best = F.array_max(F.transform(slots("units"), unit))
    rejected = F.exists("hits", lambda h: h["role"] == "reject")
    points = F.reduce(_of("points"), F.lit(0), lambda total, h: total + h["points"])
    brand = F.when(F.exists("hits", lambda h: h["role"] == "premium"), deals.BRAND_BONUS).otherwise(0)
    rows = rows.withColumns(
        {
            "rule_evidence": F.concat(groups, others),
            "_total": -best["minus_total"],
            "_pattern": F.when(rejected, deals.REJECTED).otherwise(F.coalesce(F.get(_terms_of("config"), F.lit(0)), F.lit("standard"))),
            "_points": F.lit(deals.BASE_SCORE) + brand + points,
        }
    )
    plain = F.when(F.col("_pattern") == deals.REJECTED, "standard").otherwise(F.col("_pattern"))
    return rows.withColumn("_plain_config", plain).withColumn(
        "_plain_budget", F.coalesce("_total", _named_budget(F.col("_plain_config")))
    )


def _named_budget(config: Column) -> Column:
    """Budget by exact name, by contained name, else the fallback of the rule set."""
    same = F.filter("budgets", lambda b: b["name"] == config)
    inside = F.filter("budgets", lambda b: F.contains(F.lower(config), F.lower(b["name"])))
    return F.coalesce(F.get(same, F.lit(0))["amount"], F.get(inside, F.lit(0))["amount"], F.col("fallback"))


def text_findings(df: DataFrame, configs: list[RuleConfig]) -> DataFrame:
    """One row for each different text and rule set: what the text says to the rules."""
    hits = term_hits(df, configs)
    texts = df.select(text("title").alias("title"), text("description").alias("description")).distinct()
    texts = texts.select(text_key().alias("text_key")).join(F.broadcast(settings(df.sparkSession, configs)))
    rows = texts.join(hits, ["text_key", "rules"], "left")
    rows = rows.withColumn("hits", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)))
    return _found(rows).select(
        "text_key", "rules", "context_check", "image_check", "budgets", "fallback",
        "rule_reject", "rule_evidence", "_total", "_pattern", "_points", "_plain_config", "_plain_budget",
    )


def decide_many(
    df: DataFrame, configs: list[RuleConfig], verdicts: DataFrame | None = None, seen: DataFrame | None = None
) -> DataFrame:
    """Decisions of all rule sets over the same offers: what deals.decide_listings says for each."""
    names = [c.name for c in configs]
    if len(set(names)) != len(names):
        raise ValueError("rule sets need different names")
    rows = deals.with_seen(deals.with_verdicts(df, verdicts), seen).withColumn("text_key", barrier(text_key()))
    rows = rows.join(text_findings(df, configs), "text_key").withColumns(
        {
            "_rules": F.col("rules"),
            "_context": F.when(F.col("context_check"), F.col("context_ok")),
            "_image": F.when(F.col("image_check"), deals.shown_image()),
        }
    )
    rows = rows.withColumns({"_price": deals.chosen_price(), "_config": deals.chosen_config(F.col("_pattern"))})
    # only a context verdict names another configuration than the text does
    other = F.coalesce("_total", _named_budget(F.col("_config")))
    rows = rows.withColumn("_budget", F.when(F.col("_config") == F.col("_plain_config"), F.col("_plain_budget")).otherwise(other))
    rows = rows.withColumn("_score", deals.total_score(F.col("_points"), F.col("_price"), F.col("_budget")))
    return deals.outcome(rows, df.columns)
