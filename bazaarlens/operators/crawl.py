"""Source registry, market policy and crawl plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions.urls import country_hint
from bazaarlens.rules.sources import SOURCES

MAX_QUERIES = 6


def registry(spark: SparkSession) -> DataFrame:
    """Known sources; a table of fixed size."""
    rows = [
        (name, label, group, list(countries), status, login, list(templates))
        for name, label, group, countries, status, login, templates in SOURCES
    ]
    return spark.createDataFrame(
        rows,
        "name string, label string, group_name string, countries array<string>, status string, "
        "requires_login boolean, templates array<string>",
    )


def list_sources(sources: DataFrame, include_experimental: bool = True, include_disabled: bool = False) -> DataFrame:
    keep = F.lit(True)
    if not include_disabled:
        keep = keep & (F.col("status") != "disabled")
    if not include_experimental:
        keep = keep & (F.col("status") != "experimental")
    return sources.where(keep).orderBy("group_name", "name")


def crawl_sources(sources: DataFrame) -> DataFrame:
    """Sources a plan may crawl: public, not manual, not disabled."""
    return sources.where("status NOT IN ('disabled', 'manual') AND NOT requires_login")


def market_policy(sources: DataFrame, country: str = "IT") -> DataFrame:
    """Market scope of each source for a country, from its countries, urls and group."""
    url_hints = F.transform(
        "templates", lambda t: country_hint(F.replace(t, F.lit("{query}"), F.lit("test")))
    )
    hints = F.array_sort(
        F.array_distinct(
            F.filter(F.concat(F.transform("countries", F.upper), url_hints), lambda c: c != "")
        )
    )
    group = F.lower("group_name")
    any_of = lambda *words: group.rlike("|".join(words))
    classifieds = any_of("classifieds", "second_hand")
    retail = any_of("refurbished", "used_electronics", "retail", "recommerce", "catalog")
    own = F.array_contains("market_countries", country.upper())
    scope = (
        F.when(own & classifieds, "target_market_classifieds_candidate")
        .when(own, "target_market_retail_or_catalog_candidate")
        .when(F.array_contains("market_countries", "EU") & retail, "eu_retail_catalog_needs_shipping_check")
        .when(classifieds, "foreign_classifieds_catalog_only")
        .otherwise("unknown_manual_review")
    )
    flagged = sources.withColumn("market_countries", hints).withColumn("scope", scope)
    return flagged.select(
        F.col("name").alias("source"),
        "label",
        "group_name",
        "market_countries",
        F.lit(country.upper()).alias("market_country"),
        "scope",
        F.col("scope").startswith("target_market").alias("deal_candidate"),
        (F.col("scope") != "unknown_manual_review").alias("catalog_candidate"),
        (F.col("scope") != "foreign_classifieds_catalog_only").alias("needs_shipping_check"),
    )


def quote_plus(c: Column) -> Column:
    return F.url_encode(c)


def build_crawl_plan(sources: DataFrame, categories: DataFrame) -> DataFrame:
    """Every source x category x first keywords x url template, once each.

    Both sides are tables of fixed size, so the product is bounded by the registry and the tree.
    """
    queries = categories.where("key <> 'unknown'").select(
        F.col("key").alias("category_key"),
        F.col("label").alias("category_label"),
        F.explode(F.slice("keywords", 1, MAX_QUERIES)).alias("query"),
    )
    templates = sources.select(F.col("name").alias("source"), F.explode("templates").alias("template"))
    return (
        templates.join(F.broadcast(queries))
        .select(
            "source",
            F.lit("broad_category_query").alias("mode"),
            "category_key",
            "category_label",
            "query",
            F.replace("template", F.lit("{query}"), quote_plus(F.col("query"))).alias("url"),
        )
        .withColumn("_q", F.lower("query"))
        .dropDuplicates(["source", "category_key", "_q", "url"])
        .drop("_q")
    )


def categories_for_profile(categories: DataFrame, profile: str) -> DataFrame:
    return categories.where(F.array_contains("profiles", profile)).select("key")


def with_defaults(df: DataFrame, table: DataFrame, value: str, default: list[str]) -> DataFrame:
    """Small dimension look-up by category with a default list."""
    fallback = F.array(*[F.lit(v) for v in default]) if default else F.array().cast("array<string>")
    return df.join(F.broadcast(table), "category", "left").withColumn(value, F.coalesce(value, fallback))
