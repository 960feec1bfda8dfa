"""Catalog reports, checks and reference resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Facts that are expected to differ between variants of one family.
EXPECTED_DIMENSIONS = (
    ("technology_gpu", ("vram_gb",)),
    ("technology_ram", ("module_capacity_gb", "module_count")),
)


def _count_by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def family_overview(
    families: DataFrame, variants: DataFrame, aliases: DataFrame, facts: DataFrame, search: str = "", category: str = ""
) -> DataFrame:
    """Families with counts of children; each child table is counted before the join."""
    chosen = families
    if search.strip():
        term = search.strip().lower()
        chosen = chosen.where(
            F.lower("family_name").contains(term) | F.lower(F.coalesce("brand", F.lit(""))).contains(term)
        )
    if category:
        chosen = chosen.where(F.col("category") == category)
    for child, name in ((variants, "variants"), (aliases, "aliases"), (facts, "spec_facts")):
        chosen = chosen.join(_count_by(child, "family_id", name), "family_id", "left")
    counts = ("variants", "aliases", "spec_facts")
    return chosen.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})


def query_variants(
    variants: DataFrame,
    families: DataFrame,
    facts: DataFrame,
    category: str | None = None,
    spec_key: str | None = None,
    min_value: float | None = None,
) -> DataFrame:
    """One row per variant: its surest fact that passes the numeric floor."""
    kept = facts if spec_key is None else facts.where(F.col("spec_key") == spec_key)
    if min_value is not None and spec_key:
        kept = kept.where(F.col("spec_value").try_cast("double") >= float(min_value))
    best = kept.groupBy("variant_id").agg(
        F.max_by(
            F.struct("spec_key", "spec_value", F.col("confidence").alias("spec_confidence")),
            F.struct("confidence", "spec_key", "spec_value"),
        ).alias("fact")
    )
    how = "left" if spec_key is None else "inner"
    own = families if category is None else families.where(F.col("category") == category)
    return (
        variants.select("variant_id", "family_id", "variant_name")
        .join(own.select("family_id", "category", "brand", "family_name"), "family_id")
        .join(best, "variant_id", how)
        .select("category", "brand", "family_name", "variant_name", "variant_id", "fact.*")
    )


def _expected() -> Column:
    expected = F.lit(False)
    for category, keys in EXPECTED_DIMENSIONS:
        expected = expected | ((F.col("category") == category) & F.col("spec_key").isin(*keys))
    return expected


def spec_conflict_values(
    facts: DataFrame, variants: DataFrame, families: DataFrame, category: str | None = None
) -> DataFrame:
    """Distinct known values per family and fact, over all facts of known variants."""
    own = families if category is None else families.where(F.col("category") == category)
    return (
        facts.where(F.col("spec_value").isNotNull())
        .select("variant_id", "spec_key", "spec_value")
        .join(variants.select("variant_id", "family_id"), "variant_id")
        .select("family_id", "spec_key", "spec_value")
        .distinct()
        .join(own.select("family_id", "category", "family_name"), "family_id")
        .where(~_expected())
    )


def spec_conflicts(values: DataFrame) -> DataFrame:
    """Families with more than one value of a fact. The values themselves stay in ``values``, one
    row each, so a fact with very many values never becomes one huge row."""
    return (
        values.groupBy("family_id", "family_name", "spec_key")
        .agg(
            F.count(F.lit(1)).alias("n_values"),
            F.min("spec_value").alias("first_value"),
            F.max("spec_value").alias("last_value"),
        )
        .where("n_values > 1")
        .select(
            F.lit("warning").alias("severity"),
            F.concat(F.lit("conflicting_"), "spec_key").alias("issue"),
            "*",
        )
    )


def check_claims(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims whose value is not among the known values of the family; unknown facts pass."""
    known = facts.select("family_id", "spec_key", "spec_value").distinct()
    has_fact = known.select("family_id", "spec_key").distinct()
    match = known.withColumnRenamed("spec_value", "claimed_value")
    return (
        claims.join(has_fact, ["family_id", "spec_key"], "left_semi")
        .join(match, ["family_id", "spec_key", "claimed_value"], "left_anti")
        .withColumn("issue", F.concat(F.lit("unknown_variant_"), "spec_key"))
    )


def catalog_summary(tables: dict[str, DataFrame]) -> DataFrame:
    frames = [
        df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("area"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def conflict_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("conflict_key", "status").agg(F.count(F.lit(1)).alias("n"))


def resolve_entity_refs(refs: DataFrame, families: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, rejects) of rows with family_key and optional variant_key."""
    known_families = families.select(F.col("family_id").alias("family_key"), F.lit(True).alias("_f"))
    known_variants = variants.select(
        F.col("family_id").alias("family_key"), F.col("variant_id").alias("variant_key"), F.lit(True).alias("_v")
    )
    wanted = F.coalesce("variant_key", F.lit("")) != ""
    checked = (
        refs.join(known_families, "family_key", "left")
        .join(known_variants, ["family_key", "variant_key"], "left")
        .withColumn(
            "reject_reason",
            F.when(F.coalesce("family_key", F.lit("")) == "", "no_family_key")
            .when(F.col("_f").isNull(), "unknown_family_key")
            .when(wanted & F.col("_v").isNull(), "unknown_variant_key"),
        )
        .drop("_f", "_v")
    )
    good = checked.where("reject_reason IS NULL").drop("reject_reason")
    return good, checked.where("reject_reason IS NOT NULL")


def relations_both_ways(
    entities: DataFrame, relations: DataFrame, families: DataFrame, variants: DataFrame, limit: int = 50
) -> DataFrame:
    """Edges of each entity in both directions, the surest ``limit`` of them.

    Entities carry family_id and variant_id (null for a whole family). Edges of the family apply to
    all its variants. The rank filter prunes before the shuffle, so a hub does not gather its edges.
    """

    def side(direction: str, own: str, other: str) -> DataFrame:
        edges = relations.select(
            F.col(f"{own}_family").alias("family_id"),
            F.col(f"{own}_variant").alias("own_variant"),
            F.col(f"{other}_family").alias("other_family"),
            F.col(f"{other}_variant").alias("other_variant"),
            "relation_type",
            "confidence",
            F.coalesce("source", F.lit("")).alias("source"),
        )
        applies = F.col("own_variant").isNull() | (F.col("own_variant") == F.col("variant_id"))
        return entities.join(edges, "family_id").where(applies).withColumn("direction", F.lit(direction))

    both = side("outgoing", "subject", "object").unionByName(side("incoming", "object", "subject"))
    order = [
        F.col("confidence").desc(), "direction", "relation_type", "other_family",
        F.coalesce("other_variant", F.lit("")), "source",
    ]
    top = W.partitionBy("family_id", "variant_id").orderBy(*order)
    best = both.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= limit)
    names = families.select(
        F.col("family_id").alias("other_family"),
        F.coalesce("brand", F.lit("")).alias("other_brand"),
        F.col("family_name").alias("other_name"),
    )
    variant_names = variants.select(
        F.col("family_id").alias("other_family"),
        F.col("variant_id").alias("other_variant"),
        F.col("variant_name").alias("other_variant_name"),
    )
    return (
        best.join(names, "other_family")
        .join(variant_names, ["other_family", "other_variant"], "left")
        .withColumn("other_variant_name", F.coalesce("other_variant_name", F.lit("")))
        .drop("own_variant")
    )


def orphan_references(
    families: DataFrame, variants: DataFrame, children: dict[str, DataFrame], links: DataFrame | None = None
) -> DataFrame:
    """Child rows whose family or variant does not exist, counted per table and kind."""
    frames = []
    targets = (("family_id", families), ("variant_id", variants))
    tables = dict(children) if links is None else {**children, "links": links}
    for name, child in {"variants": variants, **tables}.items():
        for key, target in targets:
            if key not in child.columns or (name == "variants" and key == "variant_id"):
                continue
            lost = child.where(F.col(key).isNotNull()).join(target.select(key), key, "left_anti")
            frames.append(
                lost.groupBy(F.lit(name).alias("child"), F.lit(key).alias("missing"), F.col(key).alias("value"))
                .agg(F.count(F.lit(1)).alias("n"))
            )
    return reduce(DataFrame.unionByName, frames)
