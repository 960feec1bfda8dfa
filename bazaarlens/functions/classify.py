"""Category and model rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlens.functions.core import constant, find_all, first_rule, let, matches, squeeze, text
from bazaarlens.functions.text import norm_text
from bazaarlens.functions.titles import canonicalize_title
from bazaarlens.rules.categories import (
    CATEGORY_FALLBACKS,
    CATEGORY_KEY_ALIASES,
    CATEGORY_RULES,
    EMPTY_CATEGORY_KEYS,
    ICON_SUFFIX,
    VALID_CATEGORY_KEYS,
)
from bazaarlens.rules.words import (
    APPLE_LINES,
    BAD_MODEL_STARTS,
    CAPITAL_BRANDS,
    GOOD_MODEL_PATTERNS,
    LISTING_BRANDS,
    MODEL_HINT_PATTERNS,
)


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed map, or null."""
    return F.try_element_at(constant(table, "map<string,string>"), key)


def canonical_category(title: Column | str, fallback: Column | str) -> Column:
    """First pattern that matches title and source category, else the source category's own map."""
    source = F.lower(F.trim(text(fallback)))
    unmapped = F.coalesce(
        lookup(CATEGORY_FALLBACKS, source), F.nullif(text(fallback), F.lit("")), F.lit("unknown")
    )
    by_pattern = let(
        F.concat_ws(" ", F.lower(text(title)), source),
        lambda hay: first_rule(
            [(matches(hay, p), F.lit(category)) for p, category in CATEGORY_RULES],
            F.lit(None).cast("string"),
        ),
    )
    return F.coalesce(by_pattern, unmapped)


def canonicalize_product(title: Column | str, category: Column | str) -> Column:
    """struct(title, category, warnings)."""
    def build(named: Column) -> Column:
        clean, key = named["title"], named["category"]
        return F.struct(
            clean.alias("title"),
            key.alias("category"),
            F.array_compact(
                F.array(
                    F.when(clean != F.trim(text(title)), "title_canonicalized"),
                    F.when(F.length(clean) < 4, "short_canonical_title"),
                    F.when(key != text(category), "category_canonicalized"),
                )
            ).alias("warnings"),
        )

    named = let(
        canonicalize_title(title),
        lambda t: F.struct(t.alias("title"), canonical_category(t, category).alias("category")),
    )
    return let(named, build)


def valid_category_key(c: Column | str) -> Column:
    """A key of the category tree, or empty text; site labels get a second try by pattern."""
    raw = squeeze(text(c))
    keys = constant(list(VALID_CATEGORY_KEYS), "array<string>")

    def known(value: Column) -> Column:
        mapped = let(value, lambda v: F.coalesce(lookup(CATEGORY_KEY_ALIASES, v), v))
        return let(mapped, lambda key: F.when(F.array_contains(keys, key), key))

    def second_try(label: Column) -> Column:
        by_map = known(lookup(CATEGORY_FALLBACKS, F.lower(label)))
        named = F.nullif(known(canonical_category(label, F.lit(""))), F.lit("unknown"))
        return F.coalesce(known(label), named, by_map, F.lit(""))

    def resolve(value: Column) -> Column:
        label = F.trim(F.regexp_replace(value, "(?iU)" + ICON_SUFFIX, ""))
        empty = (value == "") | F.lower(value).isin(*EMPTY_CATEGORY_KEYS)
        return F.when(empty, "").otherwise(F.coalesce(known(value), let(label, second_try)))

    return let(raw, resolve)


def detect_listing_brand(c: Column | str) -> Column:
    """Brand shown by whole words of a title, in display case."""
    hay = F.concat(F.lit(" "), norm_text(c), F.lit(" "))

    def find(h: Column) -> Column:
        rules = [(matches(h, APPLE_LINES), F.lit("Apple"))]
        for brand in LISTING_BRANDS:
            shown = brand.upper() if brand in CAPITAL_BRANDS else brand.title()
            rules.append((h.contains(f" {brand} "), F.lit(shown)))
        return first_rule(rules, F.lit(""))

    return let(hay, find)


def looks_like_model(value: Column, source_norm: Column) -> Column:
    """A model-like token that also occurs in the title."""

    def check(norm: Column) -> Column:
        good = F.lit(False)
        for pattern in GOOD_MODEL_PATTERNS:
            good = good | matches(norm, pattern)
        start = F.regexp_extract(norm, r"^(\S+)", 1)
        return (
            (F.length(norm) >= 2)
            & ~start.isin(*BAD_MODEL_STARTS)
            & ~norm.rlike(r"^\d{1,4}$")
            & ((source_norm == "") | source_norm.contains(norm))
            & good
        )

    return let(norm_text(value), check)


def extract_model_hint(c: Column | str) -> Column:
    """First acceptable model-like token, or empty text."""
    source = text(c)
    source_norm = norm_text(source)
    firsts = []
    for pattern in MODEL_HINT_PATTERNS:
        found = F.transform(find_all(source, pattern), squeeze)
        good = F.filter(
            found, lambda v: ~v.rlike(r"^[aA]-?\d") & looks_like_model(v, source_norm)
        )
        firsts.append(F.get(good, F.lit(0)))
    return F.coalesce(*firsts, F.lit(""))
