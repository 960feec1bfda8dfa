"""Upserts: a new snapshot from the current one and the incoming rows.

Every rule is an aggregate with a partial step before the shuffle, so many sightings of one key
shrink on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Confidence of a catalog row never falls; these values bound what learning may claim.
MAX_LEARNED_CONFIDENCE = 0.95


def _at(time: str, row_id: Column) -> Column:
    return F.struct(F.col(time).cast("string").alias("t"), row_id.alias("r"))


def _merged(
    current: DataFrame | None,
    incoming: DataFrame,
    row_id: str,
    keys: list[str],
    keep: list[str] = (),
    fill: list[str] = (),
    newest: dict[str, str | None] = (),
    totals: list[Column] = (),
) -> DataFrame:
    """One row per key from the stored rows and the incoming ones, in whatever order these arrive.

    keep: the value of the first sighting. fill: the first value that is not null. newest: the last
    value that is not null and not the given empty one. Stored rows carry the times at which each of
    these was set (`set_at`), so a late row takes only the place that its own time gives it. Stored
    rows without it count as set when first or last seen. Columns that only one side has are kept.
    """
    newest = dict(newest)
    named = [*keep, *fill, *newest]
    sent = [c for c in named if c in incoming.columns]
    own = _at("seen_at", F.col(row_id).cast("string"))
    rows = incoming.withColumns({"first_seen": F.col("seen_at"), "last_seen": F.col("seen_at"), "_own": own})
    if current is not None:
        blank = F.lit("")
        stored = {}
        for c in named:
            if c in current.columns:
                default = _at("last_seen" if c in newest else "first_seen", blank)
                known = "set_at" in current.columns and c in current.schema["set_at"].dataType.names
                stored[f"_at_{c}"] = F.coalesce(F.col("set_at")[c], default) if known else default
        rows = current.withColumns(stored).drop("set_at").unionByName(rows, allowMissingColumns=True)
    there = rows.columns
    firsts, lasts = ([c for c in group if c in there] for group in ([*keep, *fill], newest))

    def at(c: str) -> Column:
        return F.coalesce(*[F.col(t) for t, own in ((f"_at_{c}", f"_at_{c}" in there), ("_own", c in sent)) if own])

    def ok(c: str) -> Column:
        if c in keep:
            return at(c).isNotNull()
        empty = newest.get(c)
        return F.col(c).isNotNull() if empty is None else F.col(c).isNotNull() & (F.col(c) != empty)

    def picked(columns: list[str], last: bool) -> tuple[list[Column], dict[str, Column]]:
        """Aggregates, and of these the (at, v) of each column. Rows, incoming or stored, that lack none of the
        values and have one time for all go as one, so the time is carried once and not with each value."""
        bound, choose, name = (F.max, F.greatest, "_last") if last else (F.min, F.least, "_first")
        together = [c for c in columns if c in sent]
        whole = F.lit(False)
        found, parts = [], {c: [] for c in columns}
        if len(together) > 1:
            when = at(together[0])
            whole = F.lit(True)
            for c in together:
                whole = whole & ok(c) & F.coalesce(at(c) == when, F.lit(False))
            found.append(bound(F.when(whole, F.struct(when.alias("at"), *together))).alias(name))
            for c in together:
                pair = F.struct(F.col(f"{name}.at").alias("at"), F.col(f"{name}.{c}").alias("v"))
                parts[c].append(F.when(F.col(name).isNotNull(), pair))
        for c in columns:
            single = F.when(~whole & ok(c) if c in together else ok(c), F.struct(at(c).alias("at"), F.col(c).alias("v")))
            found.append(bound(single).alias(f"_one_{c}"))
            parts[c].append(F.col(f"_one_{c}"))
        return found, {c: choose(*p) if len(p) > 1 else p[0] for c, p in parts.items()}

    found, chosen = picked(firsts, False)
    found_last, chosen_last = picked(lasts, True)
    chosen |= chosen_last
    merged = rows.groupBy(*keys).agg(
        *found, *found_last, *totals, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    inner = [f"_one_{c}" for c in chosen] + ["_first", "_last"]
    others = [c for c in merged.columns if c not in keys and c not in inner]
    return merged.select(
        *keys,
        *[v["v"].alias(c) for c, v in chosen.items()],
        *others,
        *([F.struct(*[v["at"].alias(c) for c, v in chosen.items()]).alias("set_at")] if chosen else []),
    )


LISTING_OVERWRITES = ("title", "url", "price", "currency", "image_url", "query", "specs_json", "raw_json")
LISTING_KEEPS = ("source", "external_id", "location", "seller", "condition", "category")


def upsert_listings(current: DataFrame | None, sightings: DataFrame, row_id: str = "sighting_id") -> DataFrame:
    """Listings by fingerprint. Sightings carry seen_at and a row id that breaks ties.

    Non-empty values overwrite; place, seller, condition and category stay as first seen.
    """
    empty = {c: None if c == "price" else "{}" if c.endswith("_json") else "" for c in LISTING_OVERWRITES}
    return _merged(
        current,
        sightings.withColumn("seen_count", F.lit(1).cast("long")),
        row_id,
        ["fingerprint"],
        keep=list(LISTING_KEEPS),
        newest=empty,
        totals=[F.sum("seen_count").alias("seen_count")],
    )


def observations(sightings: DataFrame) -> DataFrame:
    """One price observation per sighting, to append."""
    return sightings.select(
        F.col("fingerprint").alias("listing_id"), "run_id", "seen_at", "price", "currency", "query"
    )


def _catalog_upsert(current, incoming, keys, keep, fill=(), newest=()):
    """first_seen kept, last_seen moved, greatest confidence, null ids filled."""
    columns = [*keys, *keep, *fill, *newest, "confidence", "seen_at", "row_id"]
    return _merged(
        current,
        incoming.select(*columns),
        "row_id",
        list(keys),
        keep=list(keep),
        fill=list(fill),
        newest={c: "" for c in newest},
        totals=[F.max("confidence").alias("confidence")],
    )


def upsert_families(current: DataFrame | None, incoming: DataFrame) -> DataFrame:
    return _catalog_upsert(
        current, incoming, ["family_key"], ["category", "brand", "family_name"], newest=["metadata_json"]
    )


def upsert_variants(current: DataFrame | None, incoming: DataFrame) -> DataFrame:
    return _catalog_upsert(
        current,
        incoming,
        ["variant_key"],
        ["family_key", "variant_name"],
        newest=["ambiguity_status", "metadata_json"],
    )


def upsert_identifiers(current: DataFrame | None, incoming: DataFrame) -> DataFrame:
    rows = incoming.withColumn("source", F.coalesce("source", F.lit("")))
    return _catalog_upsert(
        current, rows, ["identifier_type", "identifier_value", "source"], [], ["family_key", "variant_key"]
    )


def upsert_aliases(current: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Aliases by normal form and source; shorter than two characters are ignored."""
    from bazaarlens.functions.text import alias_norm

    rows = (
        incoming.withColumn("alias", F.trim("alias"))
        .withColumn("alias_norm", alias_norm("alias"))
        .withColumn("source", F.coalesce("source", F.lit("")))
        .where(F.length("alias_norm") >= 2)
    )
    return _catalog_upsert(
        current, rows, ["alias_norm", "source"], ["alias"], ["family_key", "variant_key"]
    )


def upsert_spec_facts(current: DataFrame | None, incoming: DataFrame) -> DataFrame:
    rows = incoming.withColumn("source", F.coalesce("source", F.lit("")))
    return _catalog_upsert(
        current, rows, ["variant_key", "family_key", "spec_key", "spec_value", "source"], ["unit"]
    )


def link_candidates(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Links not there yet; the first of equal incoming links stays."""
    keys = ["listing_id", "variant_key", "family_key"]
    unique = incoming.groupBy(*keys).agg(
        F.min_by("score", "created_at").alias("score"),
        F.min_by("reason", "created_at").alias("reason"),
        F.min("created_at").alias("created_at"),
    )
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    return unique.alias("n").join(current.alias("c"), same, "left_anti")


# Relation types.
RELATION_TYPES = (
    "accessory_for", "compatible_with", "incompatible_with", "often_bundled_with", "predecessor_of",
    "replacement_for", "requires", "successor_of",
)


def check_relations(edges: DataFrame) -> DataFrame:
    """Add relation_type in normal form, clamped confidence and reject_reason (null when fine)."""
    kind = F.lower(F.trim(F.coalesce(F.col("relation_type"), F.lit(""))))
    own = F.col("subject_family").eqNullSafe(F.col("object_family")) & F.col(
        "subject_variant"
    ).eqNullSafe(F.col("object_variant"))
    return edges.withColumns(
        {
            "relation_type": kind,
            "confidence": F.greatest(F.lit(0.0), F.least(F.col("confidence"), F.lit(1.0))),
            "reject_reason": F.when(~kind.isin(*RELATION_TYPES), "unsupported_type").when(own, "self_edge"),
        }
    )


EDGE_KEYS = ["subject_family", "subject_variant", "relation_type", "object_family", "object_variant", "source"]


def upsert_relations(current: DataFrame | None, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejects). Greatest confidence per edge."""
    checked = check_relations(edges).withColumn("source", F.coalesce("source", F.lit("")))
    good = checked.where("reject_reason IS NULL").select(*EDGE_KEYS, "confidence")
    if current is not None:
        good = current.select(*good.columns).unionByName(good)
    merged = good.groupBy(*EDGE_KEYS).agg(F.max("confidence").alias("confidence"))
    return merged, checked.where("reject_reason IS NOT NULL")


def apply_reviews(current: DataFrame, results: DataFrame, at: str = "updated_at") -> DataFrame:
    """Review rows replaced by their newest result; rows without a result stay."""
    order = F.struct(F.col(at))
    values = [c for c in current.columns if c != "listing_id"]
    newest = results.groupBy("listing_id").agg(
        F.max_by(F.struct(*[F.col(c) for c in values if c in results.columns]), order).alias("new")
    )
    joined = current.join(newest, "listing_id", "left")
    replaced = [
        F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
        if c in results.columns
        else F.col(c)
        for c in values
    ]
    return joined.select("listing_id", *replaced)


def append_conflicts(
    issues: DataFrame, source: str, at: Column, conflict_key: Column, claimed: Column, canonical: Column
) -> DataFrame:
    """Conflict log rows to append."""
    return issues.select(
        F.col("family_id"),
        conflict_key.alias("conflict_key"),
        F.to_json(F.struct(claimed.alias("value"))).alias("claimed_value_json"),
        F.to_json(F.struct(canonical.alias("value"))).alias("canonical_value_json"),
        F.lit(source).alias("source"),
        F.lit("open").alias("status"),
        at.alias("created_at"),
    )
