"""Rule-based deals: filter, budget, score and decision. Terms are looked for once in each different text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.functions.core import barrier, first_rule, text
from bazaarlens.functions.terms import matched_terms, plain_term, quantity_for_term
from bazaarlens.functions.text import normalize_text
from bazaarlens.operators.distinct import once_per
from bazaarlens.sources.rules import RuleConfig

# Score parts and limits.
BASE_SCORE = 70
BRAND_BONUS = 5
NEGATIVE_MALUS = 20
MIN_SCORE = 40
MAX_QUANTITY = 999
REJECTED = "RIGETTATO"
STEPS = ("seen", "rules", "context", "pattern", "budget", "score", "vision", "accept")

VERDICT_COLUMNS = {
    "context_ok": "boolean",
    "context_reason": "string",
    "context_config": "string",
    "context_price": "double",
    "image_ok": "boolean",
    "image_reason": "string",
}


def full_text(df: DataFrame) -> DataFrame:
    """Add the normalised title and title with description, each computed once."""
    both = F.concat_ws("\n", text("title"), text("description"))
    return df.withColumns({"_full": normalize_text(both), "_title": normalize_text("title")})


def evidence_item(step: str, status, reason: Column, delta: Column | int = 0, confidence: float | None = None) -> Column:
    return F.struct(
        F.lit(step).alias("step"),
        (F.lit(status) if isinstance(status, str) else status).alias("status"),
        reason.alias("reason"),
        (F.lit(delta) if isinstance(delta, int) else delta).cast("int").alias("score_delta"),
        F.lit(confidence).cast("double").alias("confidence"),
    )


def _listed(label: str, terms: Column) -> Column:
    return F.concat(F.lit(label + ": "), F.array_join(terms, ", "))


def rule_hits(df: DataFrame, config: RuleConfig) -> DataFrame:
    """Add the matched terms of each rule list as columns, so that later steps only read them."""
    full = F.col("_full")
    hits = {
        "_excluded": matched_terms(full, [plain_term(w) for w in config.exclude_words]),
        "_required": matched_terms(full, [plain_term(w) for w in config.required_words]),
        "_distract": matched_terms(full, [plain_term(w) for w in config.distractor_words]),
    }
    for i, group in enumerate(config.required_groups):
        hits[f"_group{i}"] = matched_terms(full, list(group))
    for i, rule in enumerate(config.unit_rules):
        hits[f"_unit{i}"] = matched_terms(full, list(rule.match), kit_terms=False)
    return df.withColumns(hits)


def apply_rules(df: DataFrame, config: RuleConfig) -> DataFrame:
    """Add rule_reject (null when accepted) and rule_evidence, from columns of rule_hits."""
    hits = F.col
    rules = [(F.size("_excluded") > 0, _listed("Parole escluse", hits("_excluded")))]
    groups = [f"_group{i}" for i in range(len(config.required_groups))]
    for name, group in zip(groups, config.required_groups, strict=True):
        rules.append((F.size(name) == 0, F.lit("Manca gruppo richiesto: " + ", ".join(group))))
    if config.required_words and not groups:
        rules.append((F.size("_required") == 0, F.lit("Manca parola richiesta: " + ", ".join(config.required_words))))
    if not config.context_check:
        rules.append((F.size("_distract") > 0, _listed("Distrattori", hits("_distract"))))
    decided = df.withColumn("rule_reject", first_rule(rules, F.lit(None).cast("string")))
    reason = F.col("rule_reject")
    evidence = F.array_compact(
        F.array(
            *[F.when(F.size(n) > 0, evidence_item("rules", "MATCH", _listed("Gruppo richiesto OK", hits(n)))) for n in groups],
            F.when(
                F.size("_distract") > 0,
                evidence_item("rules", "DISTRACTOR", _listed("Distrattori da verificare con AI", hits("_distract"))),
            ),
            evidence_item("rules", F.when(reason.isNull(), "ACCEPT").otherwise("REJECT"), F.coalesce(reason, F.lit("Regole base OK"))),
        )
    )
    return decided.withColumn("rule_evidence", evidence)


def reject_or_variant(full: Column, config: RuleConfig) -> Column:
    """First reject pattern, else the first matching configuration, else standard."""
    rules = [(full.contains(plain_term(p)), F.lit(REJECTED)) for p in config.reject_patterns]
    for name, patterns in config.config_patterns.items():
        rules += [(full.contains(plain_term(p)), F.lit(name)) for p in patterns]
    return first_rule(rules, F.lit("standard"))


def named_budget(config_name: Column, budget: dict[str, float]) -> Column:
    """Budget by exact name, by contained name, standard, greatest."""
    fallback = budget.get("standard", max(budget.values()) if budget else 999.0)
    rules = [(config_name == name, F.lit(float(amount))) for name, amount in budget.items()]
    rules += [
        (F.lower(config_name).contains(name.lower()), F.lit(float(amount))) for name, amount in budget.items()
    ]
    return first_rule(rules, F.lit(float(fallback)))


def unit_budget(df: DataFrame, config: RuleConfig) -> DataFrame:
    """Add unit_total and unit_rule of the best unit rule, from columns of rule_hits; null if none.

    Best: explicit quantity, then matched terms, then the smaller total.
    """
    nothing = {"unit_total": F.lit(None).cast("double"), "unit_rule": F.lit(None).cast("string")}
    if not config.unit_rules:
        return df.withColumns(nothing)
    quantities = {}
    for i, rule in enumerate(config.unit_rules):
        named = [
            F.when(F.array_contains(f"_unit{i}", term), quantity_for_term(F.col("_full"), term, list(rule.unit_aliases)))
            for term in rule.match
        ]
        most = F.array_max(F.array(*named))
        # least() skips nulls, and no quantity has to stay null.
        quantities[f"_quantity{i}"] = F.when(most.isNotNull(), F.least(most, F.lit(MAX_QUANTITY)))
    options = []
    for i, rule in enumerate(config.unit_rules):
        explicit = F.col(f"_quantity{i}")
        total = F.coalesce(explicit, F.lit(1)) * F.lit(rule.max_price_per_unit)
        options.append(
            F.when(
                F.size(f"_unit{i}") > 0,
                F.struct(
                    explicit.isNotNull().cast("int").alias("explicit"),
                    F.size(f"_unit{i}").alias("n_terms"),
                    (-total).alias("minus_total"),
                    F.lit(-i).alias("minus_position"),
                    F.lit(rule.name).alias("name"),
                ),
            )
        )
    best = df.withColumns(quantities).withColumn("_best", F.array_max(F.array(*options)))
    return best.withColumns(
        {"unit_total": -F.col("_best.minus_total"), "unit_rule": F.col("_best.name")}
    )


def title_points(title: Column, config: RuleConfig) -> Column:
    """The part of the score that the title gives: premium brand and keywords."""
    score = F.lit(BASE_SCORE)
    if config.premium_brands:
        brand = F.lit(False)
        for name in config.premium_brands:
            brand = brand | title.contains(plain_term(name))
        score = score + F.when(brand, BRAND_BONUS).otherwise(0)
    for word, bonus in config.positive_keywords.items():
        score = score + F.when(title.contains(plain_term(word)), int(bonus)).otherwise(0)
    for word in config.negative_keywords:
        score = score - F.when(title.contains(plain_term(word)), NEGATIVE_MALUS).otherwise(0)
    return score


def total_score(points: Column, price: Column, budget: Column) -> Column:
    """0..100 from the points of the title and the price against the budget."""
    return F.greatest(F.lit(0), F.least(F.lit(100), points + price_points(price, budget)))


def deal_score(title: Column, price: Column, budget: Column, config: RuleConfig) -> Column:
    """0..100 from premium brand, keywords and the price against the budget."""
    return total_score(title_points(title, config), price, budget)


def price_points(price: Column, budget: Column) -> Column:
    ratio = price / budget
    return (
        F.when(budget <= 0, 0)
        .when(ratio <= 0.5, 10)
        .when(ratio <= 0.7, 5)
        .when(ratio <= 0.9, 2)
        .when(ratio >= 1.0, -15)
        .otherwise(0)
    )


def with_verdicts(df: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """Verdict columns, all null where there is no verdict table or row."""
    if verdicts is None:
        return df.withColumns({c: F.lit(None).cast(t) for c, t in VERDICT_COLUMNS.items()})
    have = [c for c in VERDICT_COLUMNS if c in verdicts.columns]
    joined = df.join(verdicts.select("listing_id", *have), "listing_id", "left")
    lacking = {c: F.lit(None).cast(t) for c, t in VERDICT_COLUMNS.items() if c not in have}
    return joined.withColumns(lacking) if lacking else joined


def with_seen(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Add _seen: whether the id is in the optional table of seen ids."""
    if seen is None:
        return rows.withColumn("_seen", F.lit(False))
    flags = seen.select("listing_id").distinct().withColumn("_seen", F.lit(True))
    return rows.join(flags, "listing_id", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))


def chosen_config(pattern: Column) -> Column:
    """The configuration a context verdict names, else the matched pattern."""
    named = F.when(F.coalesce("_context", F.lit(False)), F.nullif("context_config", F.lit("")))
    return F.when(named.isNotNull() & (named != "standard"), named).when(pattern == REJECTED, "standard").otherwise(pattern)


def chosen_price() -> Column:
    used = F.coalesce("_context", F.lit(False)) & (F.col("context_price") != 0)
    return F.when(used, F.col("context_price")).otherwise(F.col("price"))


def shown_image() -> Column:
    """The image verdict of offers that show one."""
    return F.when(F.coalesce("image_url", F.lit("")) != "", F.col("image_ok"))


def text_findings(texts: DataFrame, config: RuleConfig) -> DataFrame:
    """What a rule set finds in the title and description alone, one row for each text (`_once`)."""
    rows = rule_hits(full_text(texts), config)
    rows = unit_budget(apply_rules(rows, config), config)
    return rows.select(
        "_once",
        "rule_reject",
        "rule_evidence",
        "unit_total",
        reject_or_variant(F.col("_full"), config).alias("_pattern"),
        title_points(F.col("_title"), config).alias("_points"),
    )


def decide_listings(
    df: DataFrame, config: RuleConfig, verdicts: DataFrame | None = None, seen: DataFrame | None = None
) -> DataFrame:
    """One decision per listing: seen, rules, context, pattern, budget, score, image, accept.

    Verdicts and seen ids are optional tables keyed by listing_id. The terms of the rules are looked
    for once in each different text, which the listings then meet; the rest is computed in place.
    """
    none = F.lit(None).cast("boolean")
    rows = with_seen(with_verdicts(df, verdicts), seen).withColumns(
        {
            "_rules": F.lit(config.name),
            "_context": F.col("context_ok") if config.context_check else none,
            "_image": shown_image() if config.image_check else none,
        }
    )
    rows = once_per(rows, ["title", "description"], lambda texts: text_findings(texts, config))
    rows = rows.withColumn("_price", chosen_price())
    rows = rows.withColumn("_config", chosen_config(F.col("_pattern")))
    rows = rows.withColumn(
        "_budget", F.coalesce(F.col("unit_total"), named_budget(F.col("_config"), config.budget))
    )
    rows = rows.withColumn("_score", total_score(F.col("_points"), F.col("_price"), F.col("_budget")))
    return outcome(rows, df.columns)


def outcome(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The decision and its trail, from what the rules found: _seen, rule_reject, rule_evidence,
    _context, _pattern, _price, _config, _budget, _score, _image and _rules."""
    context, image = F.col("_context"), F.col("_image")
    euro = lambda c: F.format_string("%.0fEUR", c)
    reached = {name: i for i, name in enumerate(STEPS)}
    place = (
        F.when(F.col("_seen"), reached["seen"])
        .when(F.col("rule_reject").isNotNull(), reached["rules"])
        .when(context.isNotNull() & ~context, reached["context"])
        .when(F.col("_pattern") == REJECTED, reached["pattern"])
        .when(F.col("_price") > F.col("_budget"), reached["budget"])
        .when(F.col("_score") < MIN_SCORE, reached["score"])
        .when(image.isNotNull() & ~image, reached["vision"])
        .otherwise(reached["accept"])
    )
    rows = rows.withColumn("_place", barrier(place))
    accept_reason = F.concat_ws(
        " | ", "platform", euro(F.col("_price")), F.format_string("Score %d/100", F.col("_score")), "_config"
    )
    at = lambda name: F.col("_place") == reached[name]
    reason = first_rule(
        [
            (at("seen"), F.lit("Già visto")),
            (at("rules"), F.lit("Regole base fallite")),
            (at("context"), F.concat(F.lit("Context: "), F.coalesce("context_reason", F.lit("")))),
            (at("pattern"), F.lit("Pattern di rigetto")),
            (at("budget"), F.lit("Prezzo sopra budget")),
            (at("score"), F.lit("Score troppo basso")),
            (at("vision"), F.concat(F.lit("Vision: "), F.coalesce("image_reason", F.lit("")))),
        ],
        accept_reason,
    )
    outcome = F.when(at("seen"), "SKIP").when(at("accept"), "ACCEPT").otherwise("REJECT")
    rows = rows.withColumns({"_reason": reason, "_status": outcome})
    reason, status = F.col("_reason"), F.col("_status")
    passed = lambda name: F.col("_place") >= reached[name]
    rejects = lambda name: F.when(at(name), "REJECT").otherwise("ACCEPT")
    trail = F.concat(
        F.when(at("seen"), F.array().cast(_EVIDENCE_TYPE)).otherwise(F.col("rule_evidence")),
        F.array_compact(
            F.array(
                F.when(at("seen"), evidence_item("seen", "SKIP", F.lit("Annuncio già visto"))),
                F.when(passed("context") & context.isNotNull(), evidence_item("context", rejects("context"), F.coalesce("context_reason", F.lit("")))),
                F.when(passed("pattern"), evidence_item("pattern", rejects("pattern"), F.col("_pattern"))),
                F.when(passed("budget"), evidence_item("budget", rejects("budget"), F.concat(euro(F.col("_price")), F.lit(" / budget "), euro(F.col("_budget"))))),
                F.when(passed("score"), evidence_item("score", rejects("score"), F.format_string("Score finale %d/100", F.col("_score")))),
                F.when(passed("vision") & image.isNotNull(), evidence_item("vision", rejects("vision"), F.coalesce("image_reason", F.lit("")))),
                F.when(~at("seen"), evidence_item("decision", status, reason)),
            )
        ),
    )
    keep_score = at("score") | at("vision") | at("accept")
    return rows.select(
        *[c for c in columns if c != "price"],
        F.col("_price").alias("price"),
        F.col("_rules").alias("rules"),
        status.alias("status"),
        F.get(F.array(*map(F.lit, STEPS)), F.col("_place")).alias("step"),
        reason.alias("reason"),
        F.when(keep_score, F.col("_score")).otherwise(0).alias("score"),
        F.when(keep_score | at("budget"), F.col("_config")).otherwise("standard").alias("config"),
        F.col("_budget").alias("budget"),
        trail.alias("evidence"),
    )


_EVIDENCE_TYPE = "array<struct<step:string,status:string,reason:string,score_delta:int,confidence:double>>"


def run_stats(decisions: DataFrame) -> DataFrame:
    """Counts of one cycle."""
    by = lambda status: F.count_if(F.col("status") == status)
    return decisions.groupBy("rules").agg(
        F.count(F.lit(1)).alias("checked"),
        by("ACCEPT").alias("notified"),
        by("REJECT").alias("rejected"),
        by("SKIP").alias("skipped"),
    )


def alert_rows(decisions: DataFrame) -> DataFrame:
    """What a notification of an accepted offer says."""
    return decisions.where("status = 'ACCEPT'").select(
        "rules", "listing_id", "platform", "title", "price", "config", "budget", "score", "url" if "url" in decisions.columns else F.lit("").alias("url")
    )


def newest_per_key(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The newest rows per key: bounded price history."""
    newest = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit)


def cap_per_key(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` items per key in arrival order; zero means no cap."""
    if limit <= 0:
        return df
    arrival = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(arrival)).where(F.col("_n") <= limit).drop("_n")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key by position. The rank filter prunes before the shuffle."""
    return cap_per_key(df, keys, order, 1)
