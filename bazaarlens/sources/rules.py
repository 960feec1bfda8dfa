"""Search rules: a JSON document per saved search, read into a small driver-side object."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class UnitRule:
    """A price limit per unit, for offers that name a quantity."""

    name: str
    match: tuple[str, ...]
    max_price_per_unit: float
    unit: str = "unit"
    unit_aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class RuleConfig:
    name: str
    exclude_words: tuple[str, ...] = ()
    required_words: tuple[str, ...] = ()
    required_groups: tuple[tuple[str, ...], ...] = ()
    distractor_words: tuple[str, ...] = ()
    budget: dict[str, float] = field(default_factory=lambda: {"standard": 100.0})
    unit_rules: tuple[UnitRule, ...] = ()
    config_patterns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    reject_patterns: tuple[str, ...] = ()
    premium_brands: tuple[str, ...] = ()
    positive_keywords: dict[str, int] = field(default_factory=dict)
    negative_keywords: tuple[str, ...] = ()
    context_check: bool = True
    image_check: bool = True
    max_history: int = 200
    max_total_items: int = 0


def _words(value: Any) -> tuple[str, ...]:
    items = [value] if isinstance(value, str) else value if isinstance(value, list) else []
    return tuple(str(item).strip() for item in items if str(item).strip())


def _number(value: Any) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def budget_amounts(raw: Any) -> dict[str, float]:
    """A number, {"default": n} or {"configurations": {...}} to amounts by name."""
    if isinstance(raw, dict):
        named = {str(k): _number(v) for k, v in (raw.get("configurations") or {}).items()}
        named = {k: v for k, v in named.items() if v is not None}
        return named or {"standard": _number(raw.get("default", 100.0)) or 100.0}
    amount = _number(raw)
    return {"standard": 100.0 if amount is None else amount}


def required_groups(raw: Any) -> tuple[tuple[str, ...], ...]:
    """Groups of alternatives in lower case, no repeats, no empty groups."""
    groups = []
    for group in raw if isinstance(raw, list) else []:
        words = tuple(dict.fromkeys(word.lower() for word in _words(group)))
        if words:
            groups.append(words)
    return tuple(groups)


def unit_rules(raw: Any) -> tuple[UnitRule, ...]:
    """Rules with a positive price and at least one term; older key names are accepted."""
    rules = []
    for number, item in enumerate(raw if isinstance(raw, list) else [], start=1):
        if not isinstance(item, dict):
            continue
        first = lambda *names: next((item[n] for n in names if n in item), None)
        match = _words(first("match", "matches", "terms"))
        price = _number(first("max_price_per_unit", "max_unit_price", "budget_per_unit"))
        if match and price is not None and price > 0:
            rules.append(
                UnitRule(
                    str(first("name", "config") or f"unit_rule_{number}"),
                    match,
                    price,
                    str(item.get("unit") or "unit"),
                    _words(first("unit_aliases", "aliases")),
                )
            )
    return tuple(rules)


def parse_rule_config(document: dict[str, Any]) -> RuleConfig:
    patterns = document.get("config_patterns") or {}
    keywords = document.get("positive_keywords") or {}
    return RuleConfig(
        name=str(document.get("name") or document.get("config_name") or "rules"),
        exclude_words=_words(document.get("exclude_words")),
        required_words=_words(document.get("required_words")),
        required_groups=required_groups(document.get("required_groups")),
        distractor_words=_words(document.get("distractor_words")),
        budget=budget_amounts(document.get("budget")),
        unit_rules=unit_rules(document.get("unit_budget_rules")),
        config_patterns={str(k): _words(v) for k, v in patterns.items()},
        reject_patterns=_words(document.get("reject_patterns")),
        premium_brands=_words(document.get("premium_brands")),
        positive_keywords={str(k): int(v) for k, v in keywords.items()},
        negative_keywords=_words(document.get("negative_keywords")),
        context_check=bool(document.get("context_check_enabled", True)),
        image_check=bool(document.get("vision_enabled", True)),
        max_history=int(document.get("max_history", 200)),
        max_total_items=int(document.get("max_total_items", 0) or 0),
    )


def load_rule_config(spark: SparkSession, path: str) -> RuleConfig:
    """One rule document from any file system Spark reads; a document is a few kilobytes."""
    return parse_rule_config(json.loads(spark.read.text(path, wholetext=True).first()[0]))
