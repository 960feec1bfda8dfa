"""Prices and numbers in listing text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlens.functions.core import col, find_all, find_first, let, text

# Currency marks and their codes.
CURRENCY_CODES = {
    "€": "EUR", "eur": "EUR", "euro": "EUR", "chf": "CHF",
    "£": "GBP", "gbp": "GBP", "$": "USD", "usd": "USD",
}
CURRENCY = r"€|eur|euro|chf|£|gbp|\$|usd"

# Fixed value: an amount with an optional currency mark on either side.
PRICE_PATTERN = (
    rf"(?:({CURRENCY})\s*)?"
    r"([0-9]{1,3}(?:[.,][0-9]{3})*(?:[.,][0-9]{1,2})?|[0-9]{1,8}(?:[.,][0-9]{1,2})?)"
    rf"\s*({CURRENCY})?"
)


def parse_localized_number(c: Column | str) -> Column:
    """1.234,56 and 1,234.56 to a double; the last separator decides, null when not a number."""
    digits = F.regexp_replace(text(c), r"(?U)\s+", "")

    def resolve(s: Column) -> Column:
        comma, dot = s.contains(","), s.contains(".")
        comma_last = s.rlike(r",[^.]*$")
        plain = (
            F.when(comma & dot & comma_last, F.translate(F.replace(s, F.lit("."), F.lit("")), ",", "."))
            .when(comma & dot, F.replace(s, F.lit(","), F.lit("")))
            .when(comma & s.rlike(r",\d{1,2}$"), F.translate(s, ",", "."))
            .when(comma, F.replace(s, F.lit(","), F.lit("")))
            .when(dot & s.rlike(r"\.\d{3}$"), F.replace(s, F.lit("."), F.lit("")))
            .otherwise(s)
        )
        return plain.try_cast("double")

    return let(digits, resolve)


def parse_price(c: Column | str) -> Column:
    """struct(value, currency): the first marked amount over 5, else the first marked amount."""
    source = text(c)
    marks = F.transform(
        F.arrays_zip(
            find_all(source, PRICE_PATTERN, 1).alias("left"),
            find_all(source, PRICE_PATTERN, 2).alias("amount"),
            find_all(source, PRICE_PATTERN, 3).alias("right"),
        ),
        lambda m: F.struct(
            parse_localized_number(m["amount"]).alias("value"),
            F.lower(F.coalesce(F.nullif(m["left"], F.lit("")), m["right"])).alias("mark"),
        ),
    )
    priced = F.filter(marks, lambda m: (m["mark"] != "") & m["value"].isNotNull())
    codes = F.create_map(*[F.lit(v) for pair in CURRENCY_CODES.items() for v in pair])
    best = let(
        priced,
        lambda p: F.coalesce(
            F.get(F.filter(p, lambda m: m["value"] > 5), F.lit(0)), F.get(p, F.lit(0))
        ),
    )
    return let(
        best,
        lambda b: F.struct(
            b["value"].alias("value"),
            F.when(b.isNull(), F.lit("")).otherwise(F.try_element_at(codes, b["mark"])).alias("currency"),
        ),
    )


def _loose_number(c: Column) -> Column:
    """Digits with , or . as the decimal mark, or grouped when both occur."""
    return let(
        c,
        lambda s: F.when(
            s.contains(",") & s.contains("."), parse_localized_number(s)
        ).otherwise(F.translate(s, ",", ".").try_cast("double")),
    )


def parse_bot_price(c: Column | str, default: float | None = 999.0) -> Column:
    """Amount before the euro sign, else after it, else any number, else the default."""
    source = F.translate(text(c), " ", " ")
    amount = F.coalesce(
        find_first(source, r"(\d{1,6}(?:[.,]\d{1,2})?)\s*€", 1),
        find_first(source, r"€\s*(\d{1,6}(?:[.,]\d{1,2})?)", 1),
        find_first(source, r"(\d+(?:[.,]\d+)?)", 1),
    )
    return F.coalesce(_loose_number(amount), F.lit(default).cast("double"))


def parse_card_price(c: Column | str, default: float | None = 999.0) -> Column:
    """Card variant: the word eur counts as the sign, loose numbers need two digits."""
    source = text(c)
    amount = F.coalesce(
        find_first(source, r"(\d{1,5}(?:[.,]\d{1,2})?)\s*(?:€|eur)", 1),
        find_first(source, r"(?:€|eur)\s*(\d{1,5}(?:[.,]\d{1,2})?)", 1),
        find_first(source, r"(\d{2,5}(?:[.,]\d{1,2})?)", 1),
    )
    return F.coalesce(F.translate(amount, ",", ".").try_cast("double"), F.lit(default).cast("double"))


def numbers_before(c: Column, unit_pattern: str) -> Column:
    """Sorted distinct numbers that stand before a unit."""
    found = find_all(c, rf"(\d+(?:[.,]\d+)?)\s*(?:{unit_pattern})\b", 1)
    return sorted_numbers(found)


def sorted_numbers(found: Column) -> Column:
    values = F.transform(found, lambda v: F.translate(v, ",", ".").try_cast("double"))
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))


# Fixed values: "at least" wordings before and after the number, and unit synonyms.
THRESHOLD_UNITS = "v|volt|ah|mah|w|watt|hz|kg|l|litri|mm|cm|gb|tb"
THRESHOLD_BEFORE = (
    r"(?:almeno|minimo|>=|non meno di|da almeno|oltre|sopra|superiore a|piu di|più di)"
    rf"\s*(\d+(?:[.,]\d+)?)\s*({THRESHOLD_UNITS})\b"
)
THRESHOLD_AFTER = (
    rf"(\d+(?:[.,]\d+)?)\s*({THRESHOLD_UNITS})\s*"
    r"(?:o più|o piu|in su|minimo|almeno|e oltre|o superiore)\b"
)
UNIT_SYNONYMS = {"volt": "v", "watt": "w", "litri": "l"}
UNIT_SPELLINGS = {"v": ("v", "volt"), "w": ("w", "watt"), "l": ("l", "litri", "litro")}


def threshold_rules(c: Column | str) -> Column:
    """array of struct(min_value, unit) asked for in a request, in order, no repeats."""
    from bazaarlens.functions.text import request_text

    source = request_text(c)

    def pairs(pattern: str) -> Column:
        return F.arrays_zip(
            find_all(source, pattern, 1).alias("amount"), find_all(source, pattern, 2).alias("unit")
        )

    units = F.create_map(*[F.lit(v) for pair in UNIT_SYNONYMS.items() for v in pair])
    found = F.transform(
        F.concat(pairs(THRESHOLD_BEFORE), pairs(THRESHOLD_AFTER)),
        lambda p: F.struct(
            F.translate(p["amount"], ",", ".").cast("double").alias("min_value"),
            F.coalesce(F.try_element_at(units, p["unit"]), p["unit"]).alias("unit"),
        ),
    )
    return F.array_distinct(found)


def values_with_unit(c: Column | str, unit: str) -> Column:
    """Values that stand before a unit or one of its spellings, whole words only."""
    from bazaarlens.functions.text import request_text

    source = request_text(c)
    parts = [
        F.transform(
            find_all(source, rf"(?<![a-z0-9])(\d+(?:[.,]\d+)?)\s*{spelling}(?![a-z0-9])", 1),
            lambda v: F.translate(v, ",", ".").cast("double"),
        )
        for spelling in UNIT_SPELLINGS.get(unit, (unit,))
    ]
    return F.concat(*parts)


def unit_for_spec(c: Column | str) -> Column:
    key = F.lower(text(c))
    return (
        F.when(key.endswith("_gb"), "GB")
        .when(key.endswith("_hz"), "Hz")
        .when(key.endswith("_inches"), "inch")
        .otherwise("")
    )


def number_text(c: Column | str) -> Column:
    """A double as text without a trailing .0"""
    return F.regexp_replace(col(c).cast("string"), r"\.0$", "")
