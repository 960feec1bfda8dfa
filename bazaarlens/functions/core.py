"""Helpers shared by the other function modules."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null-safe text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def non_empty(c: Column | str) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rx(pattern: str) -> str:
    """Java form of a case-insensitive pattern: Unicode letters, word bounds and spaces."""
    return "(?iU)" + pattern


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c, F.lit("")).rlike(rx(pattern))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rx(pattern)), F.lit(group))


def find_first(c: Column, pattern: str, group: int = 0) -> Column:
    """First match, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), rx(pattern), group), F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def round_to(c: Column, digits: int) -> Column:
    """Half-up rounding that two engines agree on: floor(x * 10^n + 0.5 + 1e-6) / 10^n."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5 + 1e-6)).cast("double") / F.lit(scale)


def first_rule(rules: Iterable[tuple[Column, Column]], otherwise: Column) -> Column:
    """First rule that holds wins."""
    chain = None
    for condition, value in rules:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return otherwise if chain is None else chain.otherwise(otherwise)


def keep_first_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """Drop later array items whose key was already seen."""
    keys = F.transform(items, key)
    return let(
        F.struct(items.alias("items"), keys.alias("keys")),
        lambda s: F.filter(
            s["items"], lambda item, i: F.array_position(s["keys"], key(item)) == i + F.lit(1)
        ),
    )


def lit_true() -> Column:
    return F.lit(True)


def barrier(c: Column) -> Column:
    """The same value, computed once in its own projection.

    Filters and later columns that refer to it are not rewritten in terms of its inputs: through a
    long chain of rules such rewriting multiplies the expression.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def constant(value: Any, schema: str) -> Column:
    """A fixed table as one constant column: small in the plan, folded once by the optimizer."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)
