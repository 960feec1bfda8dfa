"""Rule terms compiled to columns: a term is plain text, the column tests a whole table."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlens.functions.core import find_first

# Unit suffixes of capacity terms.
UNITS = "gb|tb|mb|g|t|m"


def plain_term(term: str) -> str:
    return unicodedata.normalize("NFKC", str(term)).lower().strip()


def quoted(part: str) -> str:
    """A literal part of a pattern that Java and RE2 read alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", part)


def contains_term(normalized: Column, term: str, kit_terms: bool = True) -> Column:
    """Spacing-insensitive containment in normalised text.

    Capacities do not match inside larger numbers; kit terms such as 2x32gb match as a whole.
    """
    word = plain_term(term)
    compact = word.replace(" ", "")
    if not compact:
        return F.lit(False)
    if capacity := re.fullmatch(rf"(\d+)({UNITS})", compact):
        number, unit = capacity.groups()
        return normalized.rlike(rf"(?<!\d){number}\s*{unit}(?![a-z0-9])")
    kit = re.fullmatch(rf"(\d+)x(\d+)({UNITS})", compact)
    if kit and kit_terms:
        count, number, unit = kit.groups()
        return normalized.rlike(rf"(?<![a-z0-9]){count}\s*x\s*{number}\s*{unit}(?![a-z0-9])")
    return F.replace(normalized, F.lit(" "), F.lit("")).contains(compact) | normalized.contains(word)


def any_term(normalized: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | contains_term(normalized, term)
    return found


def matched_terms(normalized: Column, terms: list[str], kit_terms: bool = True) -> Column:
    """array of the terms that occur, in rule order."""
    if not terms:
        return F.array().cast("array<string>")
    return F.array_compact(
        F.array(*[F.when(contains_term(normalized, t, kit_terms), F.lit(t)) for t in terms])
    )


def quantity_patterns(term: str, unit_aliases: list[str]) -> list[str]:
    """Patterns that name a quantity of units, as 2x32gb, 32gb x2 or 4 chairs, in the order they count."""
    found = []
    for word in [term, *unit_aliases]:
        parts = [quoted(p) for p in plain_term(word).split() if p]
        if not parts:
            continue
        body = r"\s*".join(parts)
        found += [
            rf"(?<![a-z0-9])(\d{{1,3}})\s*[x×]\s*{body}(?![a-z0-9])",
            rf"(?<![a-z0-9]){body}\s*[x×]\s*(\d{{1,3}})(?![a-z0-9])",
            rf"(?<![a-z0-9])(\d{{1,3}})\s+{body}(?![a-z0-9])",
        ]
    return found


def quantity_for_term(normalized: Column, term: str, unit_aliases: list[str]) -> Column:
    """Units offered; null when the text names no quantity."""
    numbers = [find_first(normalized, p, 1).cast("int") for p in quantity_patterns(term, unit_aliases)]
    return F.coalesce(*(F.when(n > 0, n) for n in numbers))
