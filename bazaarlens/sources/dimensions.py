"""Fixed-size dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bazaarlens.rules.categories import ADDED_CATEGORY_NODES, AUTHORITATIVE_SOURCES, CATEGORY_TREE, COMMON_TERMS


def category_tree(spark: SparkSession, added_nodes: bool = False) -> DataFrame:
    """One row per category: key, label, parent, group, profiles, keywords."""
    nodes = CATEGORY_TREE + (ADDED_CATEGORY_NODES if added_nodes else ())
    rows = [
        (position, key, label, parent, group, list(profiles), list(keywords))
        for position, (key, label, parent, group, profiles, keywords) in enumerate(nodes)
    ]
    return spark.createDataFrame(
        rows,
        "position int, key string, label string, parent_key string, group_name string, "
        "profiles array<string>, keywords array<string>",
    )


def common_terms(spark: SparkSession) -> DataFrame:
    rows = [(category, list(terms)) for category, terms in COMMON_TERMS.items()]
    return spark.createDataFrame(rows, "category string, terms array<string>")


def authoritative_sources(spark: SparkSession) -> DataFrame:
    rows = [(category, list(names)) for category, names in AUTHORITATIVE_SOURCES.items()]
    return spark.createDataFrame(rows, "category string, sources array<string>")
