"""Titles: canonical form, card titles, listing and cleaning quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlens.functions.core import matches, rx, squeeze, text
from bazaarlens.functions.numbers import CURRENCY
from bazaarlens.functions.urls import CARD_NAV_URL, PRODUCT_URL, is_nav_url, is_product_url, slug_title

# What a canonical title does not carry.
MARKETING_STARTS = (
    r"^(?:(?:bestseller|just a few left|pochi rimasti|pochi pezzi rimasti|solo pochi rimasti|deal"
    r"|offerta|new|nuovo|sale)\s+)+"
)
RATING_BEFORE_PRICE = (
    rf"\b[0-5][,.][0-9]\s*(?=(?:{CURRENCY})\s*\d|\d{{2,}}[,.]?\d*\s*(?:{CURRENCY}))"
)
PRICE_AFTER_MARK = rf"(?:{CURRENCY})\s*[0-9][0-9.,]*"
PRICE_BEFORE_MARK = rf"[0-9][0-9.,]*\s*(?:{CURRENCY})"
CONDITION_TAG = r"\((?:new|nuovo|used|usato|refurbished|ricondizionato|eccellente|ottimo|buono)\)"
MARKETING_WORDS = (
    r"\b(?:in vendita|nuovo|nuova|usato|usata|ricondizionato|ricondizionata|refurbished|offerta|deal)\b"
)
RATING_WORDS = r"\b(?:rating|recensione|recensioni|incl\.?|con boost)\b"
TRAILING_NUMBERS = r"(?:\s+\d{1,2}[.,][\s\-|·]*)+$"
EDGE = " -|·"

# Titles and texts that belong to navigation, not to a listing.
NAV_TITLE = (
    r"^(view all|all categories|show all|login|privacy|cookie|terms|help|aiuto|accessories|other|home"
    r"|menu|categorie|categories)$"
)
NOISE_TEXT = (
    r"(mon\s*-\s*fri|0800\s*222|view all|all categories|privacy|cookie|terms|newsletter|"
    r"smartphones\s+laptops\s+tablets|apple weeks\s+smartphones|vacuum cleaners\s+.*smartphones)"
)
GENERIC_TITLE = (
    r"^(google phones|samsung phones|apple phones|iphones|smartphones?|phones?|cellulari|telefoni|"
    r"laptops?|portatili|tablets?|smartwatches?|headphones?|cuffie|accessories|accessori|"
    r"computer accessories|smartphone accessories|all categories|view all|show all)$"
)
JUNK_MARKERS = (
    "view all", "all categories", "privacy", "cookie", "newsletter", "mon - fri", "0800 222",
    "apple weeks smartphones",
)

# Patterns that show a model in a title or url.
MODEL_SPECIFIC = (
    r"\b(pixel|iphone|ipad|macbook|galaxy|thinkpad|rtx|gtx|rx)\s*[a-z]*\s*\d+[a-z]*\b",
    r"\b[a-z]{2,}[-\s]?\d{2,}[a-z0-9-]*\b",
    r"\b\d{2,}[a-z]{1,4}\b",
)


def canonicalize_title(c: Column | str) -> Column:
    """Title without marketing words, ratings, prices, condition tags and trailing numbers."""
    out = squeeze(text(c))
    out = F.trim(F.regexp_replace(out, rx(MARKETING_STARTS), ""))
    for pattern in (
        RATING_BEFORE_PRICE, PRICE_AFTER_MARK, PRICE_BEFORE_MARK, CONDITION_TAG, MARKETING_WORDS,
        RATING_WORDS,
    ):
        out = F.regexp_replace(out, rx(pattern), " ")
    out = F.btrim(squeeze(out), F.lit(EDGE))
    return F.btrim(F.regexp_replace(out, rx(TRAILING_NUMBERS), ""), F.lit(EDGE))


def is_generic_title(c: Column | str) -> Column:
    return matches(squeeze(text(c)), GENERIC_TITLE)


def has_model_specificity(title: Column, url: Column | None = None) -> Column:
    hay = F.lower(F.concat_ws(" ", text(title), text(url) if url is not None else F.lit("")))
    found = F.lit(False)
    for pattern in MODEL_SPECIFIC:
        found = found | matches(hay, pattern)
    return found


def clean_card_title(anchor: Column, url: Column, parent: Column) -> Column:
    """Anchor text, url slug or card text, by noise and length."""
    shown, card = squeeze(anchor), squeeze(parent)
    slug = slug_title(url)
    product = matches(text(url), PRODUCT_URL) & (slug != "")
    sized = lambda v: F.length(v).between(6, 120) & ~matches(v, NOISE_TEXT)
    noisy = matches(shown, NOISE_TEXT) | (F.length(shown) > 120)
    return (
        F.when(noisy & product, F.substring(slug, 1, 120))
        .when(sized(shown), shown)
        .when(product, F.substring(slug, 1, 120))
        .when(sized(card), card)
        .otherwise(F.substring(F.coalesce(F.nullif(shown, F.lit("")), slug), 1, 120))
    )


def listing_quality(url: Column, title: Column, price: Column) -> Column:
    """struct(accept, reason) of a card before it becomes a listing."""
    shown = squeeze(title)
    product, nav = matches(text(url), PRODUCT_URL), matches(text(url), CARD_NAV_URL)
    reason = (
        F.when(F.length(shown) < 6, "title_too_short")
        .when(matches(shown, NAV_TITLE), "nav_title")
        .when(matches(shown, NOISE_TEXT) & ~product, "noise_title")
        .when(price.isNotNull(), "price_card")
        .when(product & ~nav, "product_url")
        .when(nav, "category_or_nav_url")
        .otherwise("weak_generic_anchor")
    )
    return F.struct(reason.isin("price_card", "product_url").alias("accept"), reason.alias("reason"))


# Cleaning outcomes in test order with their confidence.
CLEAN_REJECT_REASONS = ("category_or_nav_url", "nav_title", "noise_title", "weak_generic_anchor")


def clean_decision(title: Column, normalized: Column, quality_reason: Column, url: Column) -> Column:
    """struct(decision, confidence, reason): the gate before online verification."""
    low = F.lower(F.trim(text(title)))
    junk = F.lit(False)
    for marker in JUNK_MARKERS:
        junk = junk | low.contains(marker)
    specific = has_model_specificity(normalized, url)
    quality = text(quality_reason)

    def outcome(decision: str, confidence: float, reason: Column | str) -> Column:
        named = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(
            F.lit(decision).alias("decision"),
            F.lit(confidence).alias("confidence"),
            named.alias("reason"),
        )

    return (
        F.when(junk, outcome("reject", 0.97, "junk_marker"))
        .when(is_nav_url(url), outcome("reject", 0.98, "category_url_not_listing"))
        .when(is_generic_title(normalized) & ~specific, outcome("reject", 0.96, "generic_category_title"))
        .when(quality.isin(*CLEAN_REJECT_REASONS), outcome("reject", 0.92, quality))
        .when(F.length(normalized) < 6, outcome("reject", 0.88, "title_too_short"))
        .when(quality == "price_card", outcome("accept", 0.84, "price_card"))
        .when(is_product_url(url) & specific, outcome("accept", 0.80, "product_url_model_specific"))
        .when(quality == "product_url", outcome("uncertain", 0.58, "product_url_needs_reasoning"))
        .otherwise(outcome("uncertain", 0.50, "needs_reasoning_cleanup"))
    )
