"""Review queues, the resolved listing view and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.core import non_empty

# Fixed value: confidence at which an AI review counts as strong.
STRONG_AI = 0.72


def known(c: str) -> Column:
    """Non-empty text other than 'unknown'."""
    return F.nullif(non_empty(c), F.lit("unknown"))


def resolved_listings(
    listings: DataFrame,
    cleaning: DataFrame,
    verifications: DataFrame,
    research: DataFrame,
    ai_reviews: DataFrame,
    details: DataFrame | None = None,
) -> DataFrame:
    """Listings with the best title and category: cleaning, then resolved AI, research, listing.

    Each review table has at most one row per listing. Write all six bucketed by listing_id and
    the five joins need no shuffle.
    """
    df = (
        listings.alias("l")
        .join(cleaning.alias("cr"), "listing_id", "left")
        .join(verifications.alias("ov"), "listing_id", "left")
        .join(research.alias("r"), "listing_id", "left")
        .join(ai_reviews.alias("ar"), "listing_id", "left")
    )
    description = F.lit("")
    if details is not None:
        df = df.join(details.alias("dr"), "listing_id", "left")
        description = F.coalesce("dr.description_sample", F.lit(""))
    ai = F.col("ar.status") == "resolved"
    title = F.coalesce(
        non_empty("cr.normalized_title"),
        F.when(ai, non_empty("ar.canonical_title")),
        non_empty("r.canonical_title"),
        F.col("l.title"),
    )
    category = F.coalesce(
        known("cr.normalized_category"),
        F.when(ai, known("ar.canonical_category")),
        known("r.canonical_category"),
        known("l.category"),
        F.lit("unknown"),
    )
    return df.select(
        "listing_id",
        "l.source",
        F.col("l.title").alias("original_title"),
        title.alias("title"),
        category.alias("category"),
        F.coalesce(non_empty("r.canonical_brand"), F.lit("")).alias("brand"),
        F.coalesce(non_empty("r.canonical_model"), F.lit("")).alias("model"),
        *[f"l.{c}" for c in ("price", "currency", "location", "seller", "url")],
        F.col("ov.status").alias("verify_status"),
        F.col("cr.decision").alias("clean_decision"),
        F.coalesce(
            "cr.confidence", "ar.confidence", "r.confidence", "ov.confidence", F.lit(0.0)
        ).alias("confidence"),
        F.coalesce("cr.reason", "ov.reason", F.lit("")).alias("reason"),
        description.alias("description"),
        F.col("l.last_seen").alias("last_seen"),
    )


def status_rank(c: str = "verify_status") -> Column:
    return (
        F.when(F.col(c) == "verified", 0)
        .when(F.col(c) == "verified_conflict", 1)
        .when(F.col(c) == "uncertain", 2)
        .otherwise(3)
    )


def enqueue_unreviewed(
    listings: DataFrame, reviews: DataFrame, created_at: Column, exclude: DataFrame | None = None
) -> DataFrame:
    """Pending rows for listings without a review; ``exclude`` holds listings to leave out."""
    missing = listings.select("listing_id").join(reviews, "listing_id", "left_anti")
    if exclude is not None:
        missing = missing.join(exclude, "listing_id", "left_anti")
    return missing.select("listing_id", F.lit("pending").alias("status"), created_at.alias("created_at"))


def strong_ai(ai_reviews: DataFrame) -> DataFrame:
    return ai_reviews.where(
        F.col("status").isin("resolved", "uncertain")
        & (F.coalesce("confidence", F.lit(0.0)) >= STRONG_AI)
    )


def reopen_cleaning(cleaning: DataFrame, evidence: DataFrame, reason: str, now: Column) -> DataFrame:
    """Done reviews with fresh evidence go back to pending; all rows are returned."""
    flags = evidence.select("listing_id").distinct().withColumn("_fresh", F.lit(True))
    again = F.col("_fresh").isNotNull() & (F.col("stage") == "done")
    return (
        cleaning.join(flags, "listing_id", "left")
        .withColumns(
            {
                "stage": F.when(again, "pending").otherwise(F.col("stage")),
                "reason": F.when(again, reason).otherwise(F.col("reason")),
                "updated_on": F.when(again, now).otherwise(F.col("updated_on")),
            }
        )
        .drop("_fresh")
    )


def reopen_verifications(
    verifications: DataFrame, cleaning: DataFrame, ai_reviews: DataFrame, now: Column
) -> DataFrame:
    """Checked listings with strong AI evidence and a finished cleaning go back to pending."""
    ready = (
        strong_ai(ai_reviews)
        .join(cleaning.where("stage = 'done'"), "listing_id", "left_semi")
        .select("listing_id")
        .distinct()
        .withColumn("_fresh", F.lit(True))
    )
    again = F.col("_fresh").isNotNull() & (F.col("status") != "pending")
    return (
        verifications.join(ready, "listing_id", "left")
        .withColumns(
            {
                "status": F.when(again, "pending").otherwise(F.col("status")),
                "reason": F.when(again, "ai_edge_reverify").otherwise(F.col("reason")),
                "updated_on": F.when(again, now).otherwise(F.col("updated_on")),
            }
        )
        .drop("_fresh")
    )


def _evidence_columns(df: DataFrame, research: DataFrame, ai: DataFrame, multilingual: DataFrame) -> DataFrame:
    def renamed(table: DataFrame, prefix: str) -> DataFrame:
        return table.select(
            "listing_id", *[F.col(c).alias(f"{prefix}_{c}") for c in table.columns if c != "listing_id"]
        )

    return (
        df.join(renamed(multilingual, "multilingual"), "listing_id", "left")
        .join(renamed(ai, "ai"), "listing_id", "left")
        .join(renamed(research, "research"), "listing_id", "left")
    )


def pending_verifications(
    verifications: DataFrame,
    listings: DataFrame,
    cleaning: DataFrame,
    research: DataFrame,
    ai_reviews: DataFrame,
    multilingual: DataFrame,
) -> DataFrame:
    """Pending verifications whose cleaning is done, with all evidence beside them."""
    done = cleaning.where("stage = 'done'").select(
        "listing_id",
        F.col("decision").alias("clean_decision"),
        F.col("confidence").alias("clean_confidence"),
        F.col("normalized_title").alias("clean_title"),
        F.col("normalized_category").alias("clean_category"),
        F.col("updated_on").alias("clean_updated_on"),
    )
    base = (
        verifications.where("status = 'pending'")
        .select("listing_id", "status", "query", "created_on")
        .join(listings.select("listing_id", "source", "title", "url", "price", "category"), "listing_id")
        .join(done, "listing_id")
    )
    return _evidence_columns(base, research, ai_reviews, multilingual)


def pending_cleaning(
    cleaning: DataFrame,
    listings: DataFrame,
    research: DataFrame,
    ai_reviews: DataFrame,
    multilingual: DataFrame,
) -> DataFrame:
    base = (
        cleaning.where("stage = 'pending'")
        .select("listing_id", "stage", "reason", "created_on")
        .join(listings.select("listing_id", "source", "title", "url", "price", "category"), "listing_id")
    )
    return _evidence_columns(base, research, ai_reviews, multilingual)


def order_pending(df: DataFrame, prefer_research: bool = False, prefer_ai: bool = False) -> DataFrame:
    """Strong AI evidence first, then research, then the oldest."""
    order: list[Column] = []
    if prefer_ai:
        strong = F.col("ai_status").isin("resolved", "uncertain") & (
            F.coalesce("ai_confidence", F.lit(0.0)) >= STRONG_AI
        )
        order += [
            F.when(strong, 0).otherwise(1).asc(),
            F.coalesce(F.col("ai_updated_on").cast("string"), F.lit("")).desc(),
        ]
    if prefer_research:
        order += [
            F.when(F.col("research_status").isNotNull(), 0).otherwise(1).asc(),
            F.coalesce(F.col("research_updated_on").cast("string"), F.lit("")).desc(),
        ]
        if "clean_updated_on" in df.columns:
            order.append(F.coalesce(F.col("clean_updated_on").cast("string"), F.lit("")).desc())
    return df.orderBy(*order, F.col("created_on").asc(), F.col("listing_id").asc())


def review_summary(reviews: DataFrame, column: str) -> DataFrame:
    return reviews.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def long_counts(parts: list[tuple[str, DataFrame, str | None]]) -> DataFrame:
    """(area, value, n) rows: counts by a column, or the row count when no column is named."""
    frames = []
    for area, df, column in parts:
        value = F.lit("all") if column is None else F.coalesce(F.col(column).cast("string"), F.lit(""))
        frames.append(
            df.groupBy(F.lit(area).alias("area"), value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        )
    return reduce(DataFrame.unionByName, frames)


def distinct_categories(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """Categories named in any table; each side is made distinct before the union."""
    frames = [
        df.select(F.col(c).alias("category")).where("coalesce(category, '') NOT IN ('', 'unknown')").distinct()
        for df, c in parts
    ]
    return reduce(DataFrame.unionByName, frames).distinct()


def crawl_summary(
    checkpoints: DataFrame, runs: DataFrame, listings: DataFrame, sightings: DataFrame
) -> DataFrame:
    site_runs = runs.where(F.col("profile").startswith("site_category:"))
    return long_counts(
        [
            ("checkpoints", checkpoints, "status"),
            ("site_runs", site_runs, "status"),
            ("listings", listings, None),
            ("observations", sightings, None),
        ]
    )


def recent_checkpoints(checkpoints: DataFrame, runs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest checkpoints, or site runs when there is no checkpoint at all. Ties go by all other columns."""
    first = checkpoints.select(
        F.lit(0).alias("rank"), "source", "task_kind", "task_key", "status", "saved_count", "updated_at"
    )
    second = runs.where(F.col("profile").startswith("site_category:")).select(
        F.lit(1).alias("rank"),
        "source",
        F.lit("search_run_fallback").alias("task_kind"),
        F.lit("").alias("task_key"),
        "status",
        F.lit(0).cast("long").alias("saved_count"),
        F.coalesce("finished_at", "started_at").alias("updated_at"),
    )
    newest = lambda df: df.orderBy(F.col("updated_at").desc(), "source", "task_key", "status", "task_kind", "saved_count").limit(limit)
    both = newest(first).unionByName(newest(second))
    best = both.agg(F.min("rank").alias("rank"))
    return both.join(F.broadcast(best), "rank", "left_semi").drop("rank")


def latest_checkpoints(log: DataFrame) -> DataFrame:
    """Newest state per crawl task from the append-only log."""
    keys = ["source", "task_kind", "task_key"]
    values = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct("updated_at", "status")).alias("s")
    )
    return newest.select(*keys, "s.*")


def recent_listings(listings: DataFrame, limit: int = 20) -> DataFrame:
    return listings.orderBy(F.col("last_seen").desc(), F.col("listing_id")).limit(limit)
