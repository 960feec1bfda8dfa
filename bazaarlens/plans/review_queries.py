"""Registered queries: resolved view, queues, summaries and listing upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.core import round_to
from bazaarlens.functions.urls import listing_fingerprint
from bazaarlens.operators import client, reviews, upsert
from bazaarlens.operators.opportunity import score_opportunities
from bazaarlens.plans.fixtures import sql_round
from bazaarlens.plans.price_queries import key_sql
from bazaarlens.plans.registry import Inputs, query
from bazaarlens.sources.dimensions import category_tree

REVIEW_VIEWS = ["listings_v", "cleaning_v", "verifications_v", "research_v", "ai_reviews_v"]


def _resolved(v: Inputs) -> DataFrame:
    listings = v("listings_v").withColumn("last_seen", F.col("seen_on"))
    return reviews.resolved_listings(
        listings, v("cleaning_v"), v("verifications_v"), v("research_v"), v("ai_reviews_v")
    ).drop("description")


RESOLVED_SQL = """resolved AS (
SELECT l.listing_id, l.source, l.title AS original_title,
  coalesce(nullif(trim(cr.normalized_title), ''), CASE WHEN ar.status = 'resolved' THEN nullif(trim(ar.canonical_title), '') END,
    nullif(trim(r.canonical_title), ''), l.title) AS title,
  coalesce(nullif(nullif(trim(cr.normalized_category), ''), 'unknown'),
    CASE WHEN ar.status = 'resolved' THEN nullif(nullif(trim(ar.canonical_category), ''), 'unknown') END,
    nullif(nullif(trim(r.canonical_category), ''), 'unknown'), nullif(nullif(trim(l.category), ''), 'unknown'), 'unknown') AS category,
  coalesce(nullif(trim(r.canonical_brand), ''), '') AS brand, coalesce(nullif(trim(r.canonical_model), ''), '') AS model,
  l.price, l.currency, l.location, l.seller, l.url, ov.status AS verify_status, cr.decision AS clean_decision,
  coalesce(cr.confidence, ar.confidence, r.confidence, ov.confidence, 0.0::DOUBLE) AS confidence,
  coalesce(cr.reason, ov.reason, '') AS reason, l.seen_on AS last_seen
FROM listings_v l LEFT JOIN cleaning_v cr USING (listing_id) LEFT JOIN verifications_v ov USING (listing_id)
LEFT JOIN research_v r USING (listing_id) LEFT JOIN ai_reviews_v ar USING (listing_id))"""


@query("resolved_listings", REVIEW_VIEWS, f"WITH {RESOLVED_SQL} SELECT * FROM resolved")
def resolved_listings(v: Inputs) -> DataFrame:
    return _resolved(v)


@query(
    "client_view",
    REVIEW_VIEWS,
    f"""WITH {RESOLVED_SQL} SELECT * FROM resolved
WHERE category <> 'unknown' AND price >= 10 AND price <= 4000
  AND (contains(lower(original_title), 'widget') OR contains(lower(title), 'widget') OR contains(lower(seller), 'widget'))
ORDER BY CASE coalesce(verify_status, '') WHEN 'verified' THEN 0 WHEN 'verified_conflict' THEN 1 WHEN 'uncertain' THEN 2 ELSE 3 END,
  confidence DESC, last_seen DESC, listing_id LIMIT 5000""",
)
def client_view(v: Inputs) -> DataFrame:
    return client.client_view(
        _resolved(v).withColumn("description", F.lit("")),
        limit=5000, search="Widget", min_price=10, max_price=4000,
    ).drop("description")


@query(
    "client_filter",
    REVIEW_VIEWS,
    f"""WITH {RESOLVED_SQL} SELECT listing_id, title, category, verify_status FROM resolved
WHERE verify_status = 'verified' AND source <> '' AND category = 'technology_laptop'""",
)
def client_filter(v: Inputs) -> DataFrame:
    return client.filter_client_listings(
        _resolved(v).withColumn("description", F.lit("")), status="verified", category="technology_laptop"
    ).select("listing_id", "title", "category", "verify_status")


ELIGIBLE_SQL = """eligible AS (SELECT * FROM resolved WHERE verify_status = 'verified' AND clean_decision = 'accept'
  AND price > 0 AND lower(url) LIKE 'http%' AND category <> 'unknown')"""


@query(
    "client_shortlist",
    REVIEW_VIEWS,
    f"""WITH {RESOLVED_SQL}, {ELIGIBLE_SQL},
k AS (SELECT *, {key_sql('category')} AS ck, {key_sql('brand')} AS bk, {key_sql('model')} AS mk, {key_sql('title')} AS tk FROM eligible),
m AS (SELECT ck, bk, mk, median(price) AS med, count(*) AS n FROM k WHERE ck <> '' AND bk <> '' AND mk <> '' GROUP BY ALL HAVING count(*) >= 3),
t AS (SELECT ck, tk, median(price) AS med, count(*) AS n FROM k WHERE ck <> '' AND tk <> '' GROUP BY ALL HAVING count(*) >= 3)
SELECT listing_id, title, category, price, {sql_round('coalesce(m.med, t.med)', 2)} AS reference_price,
  CASE WHEN m.n IS NOT NULL THEN 'model' WHEN t.n IS NOT NULL THEN 'resolved_title' ELSE 'insufficient_data' END AS reference_scope
FROM k LEFT JOIN m USING (ck, bk, mk) LEFT JOIN t USING (ck, tk)""",
)
def client_shortlist(v: Inputs) -> DataFrame:
    return client.client_shortlist(_resolved(v).withColumn("description", F.lit(""))).select(
        "listing_id", "title", "category", "price", "reference_price", "reference_scope"
    )


@query(
    "opportunity_conflict_filter",
    ["listings_v"],
    """WITH c AS (SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN 'technology_console' WHEN l_suppkey % 3 = 1 THEN 'technology_accessory' ELSE 'home_decor_wall_art' END AS category2 FROM listings_v)
SELECT listing_id, category2 AS category, title FROM c
WHERE NOT (category2 = 'technology_console' AND regexp_matches(lower(title || ' ' || title), '\\b(games?|spiel|spiele|controller|lenkrad|pedal|pedalen|hori|zubeh[oö]r|accessor)\\b'))
  AND NOT (category2 = 'technology_accessory' AND regexp_matches(lower(title || ' ' || title), '\\b(golvv[aä]rme|fl[aä]kt|heater|stativ|riscald)\\b'))
  AND NOT (category2 = 'home_decor_wall_art' AND regexp_matches(lower(title || ' ' || title), '\\b(camera da letto|casa con veranda|orologio da polso|wristwatch)\\b'))""",
)
def opportunity_conflict_filter(v: Inputs) -> DataFrame:
    listings = v("listings_v").select(
        "listing_id",
        F.when(F.col("l_suppkey") % 3 == 0, "technology_console")
        .when(F.col("l_suppkey") % 3 == 1, "technology_accessory")
        .otherwise("home_decor_wall_art")
        .alias("category"),
        "title",
        F.col("title").alias("original_title"),
    )
    return client.without_contradictions(listings).drop("original_title")


@query(
    "localized_listings",
    REVIEW_VIEWS,
    f"""WITH {RESOLVED_SQL}
SELECT listing_id, CASE category WHEN 'technology_gpu' THEN 'Schede video / GPU' WHEN 'technology_laptop' THEN 'Laptop / workstation'
  WHEN 'technology_smartphone' THEN 'Smartphone' WHEN 'technology_monitor' THEN 'Monitor' WHEN 'toys_lego' THEN 'LEGO / minifigure'
  WHEN 'technology_console' THEN 'Console gaming' WHEN 'unknown' THEN 'Sconosciuto' WHEN 'technology_phone' THEN 'Tecnologia: phone'
  WHEN 'Accessori' THEN 'Accessori' WHEN 'laptop' THEN 'Laptop' WHEN 'tavolo , Icona di menu' THEN 'Tavolo , icona di menu' END AS category_label,
  CASE verify_status WHEN 'verified' THEN 'Verificato' WHEN 'verified_conflict' THEN 'Conflitto verificato' WHEN 'uncertain' THEN 'Incerto'
  WHEN 'pending' THEN 'In attesa' ELSE '—' END AS verify_label FROM resolved""",
)
def localized_listings(v: Inputs) -> DataFrame:
    rows = _resolved(v).withColumns(
        {
            "discount_percent": F.lit(None).cast("double"),
            "reference_confidence": F.lit(None).cast("double"),
            "opportunity_status": F.col("verify_status"),
        }
    )
    return client.localize_listings(rows, category_tree(v.spark)).select(
        "listing_id", "category_label", F.col("opportunity_label").alias("verify_label")
    )


@query(
    "enqueue_unreviewed",
    ["listings_v", "cleaning_v"],
    """SELECT listing_id, 'pending' AS status, '2026-01-01' AS created_at FROM listings_v l
WHERE NOT EXISTS (SELECT 1 FROM cleaning_v c WHERE c.listing_id = l.listing_id)""",
)
def enqueue_unreviewed(v: Inputs) -> DataFrame:
    return reviews.enqueue_unreviewed(v("listings_v"), v("cleaning_v"), F.lit("2026-01-01"))


@query(
    "enqueue_unverified",
    ["listings_v", "cleaning_v", "verifications_v"],
    """SELECT listing_id, 'pending' AS status, '2026-01-01' AS created_at FROM listings_v
WHERE listing_id NOT IN (SELECT listing_id FROM verifications_v)
  AND listing_id NOT IN (SELECT listing_id FROM cleaning_v WHERE stage = 'done' AND decision = 'reject')""",
)
def enqueue_unverified(v: Inputs) -> DataFrame:
    rejected = v("cleaning_v").where("stage = 'done' AND decision = 'reject'")
    return reviews.enqueue_unreviewed(
        v("listings_v"), v("verifications_v"), F.lit("2026-01-01"), exclude=rejected
    )


STRONG_SQL = "status IN ('resolved', 'uncertain') AND coalesce(confidence, 0) >= 0.72"


@query(
    "reopen_reviews",
    ["cleaning_v", "ai_reviews_v"],
    f"""SELECT listing_id, CASE WHEN again THEN 'pending' ELSE stage END AS stage, decision, confidence,
  CASE WHEN again THEN 'ai_edge_reclean' ELSE reason END AS reason, normalized_title, normalized_category, created_on,
  CASE WHEN again THEN '2026-01-01' ELSE updated_on END AS updated_on
FROM (SELECT c.*, stage = 'done' AND EXISTS (SELECT 1 FROM ai_reviews_v a WHERE a.listing_id = c.listing_id AND {STRONG_SQL.replace('status', 'a.status').replace('confidence', 'a.confidence')}) AS again FROM cleaning_v c)""",
)
def reopen_reviews(v: Inputs) -> DataFrame:
    return reviews.reopen_cleaning(
        v("cleaning_v"), reviews.strong_ai(v("ai_reviews_v")), "ai_edge_reclean", F.lit("2026-01-01")
    )


@query(
    "reopen_reviews_research",
    ["cleaning_v", "research_v"],
    """SELECT stage, coalesce(reason, '') AS reason, CAST(count(*) AS BIGINT) AS n FROM (
SELECT CASE WHEN again THEN 'pending' ELSE stage END AS stage, CASE WHEN again THEN 'online_research_reclean' ELSE reason END AS reason
FROM (SELECT c.*, stage = 'done' AND EXISTS (SELECT 1 FROM research_v a WHERE a.listing_id = c.listing_id) AS again FROM cleaning_v c)) GROUP BY 1, 2""",
)
def reopen_reviews_research(v: Inputs) -> DataFrame:
    rows = reviews.reopen_cleaning(
        v("cleaning_v"), v("research_v"), "online_research_reclean", F.lit("2026-01-01")
    )
    return rows.groupBy("stage", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "reopen_verifications",
    ["cleaning_v", "verifications_v", "ai_reviews_v"],
    """SELECT listing_id, CASE WHEN again THEN 'pending' ELSE status END AS status,
  CASE WHEN again THEN 'ai_edge_reverify' ELSE reason END AS reason
FROM (SELECT v.*, v.status <> 'pending'
  AND EXISTS (SELECT 1 FROM ai_reviews_v a WHERE a.listing_id = v.listing_id AND a.status IN ('resolved', 'uncertain') AND a.confidence >= 0.72)
  AND EXISTS (SELECT 1 FROM cleaning_v c WHERE c.listing_id = v.listing_id AND c.stage = 'done') AS again FROM verifications_v v)""",
)
def reopen_verifications(v: Inputs) -> DataFrame:
    return reviews.reopen_verifications(
        v("verifications_v"), v("cleaning_v"), v("ai_reviews_v"), F.lit("2026-01-01")
    ).select("listing_id", "status", "reason")


QUEUE_VIEWS = REVIEW_VIEWS + ["multilingual_v"]


@query(
    "pending_verifications",
    QUEUE_VIEWS,
    """SELECT v.listing_id, v.query, l.title, l.price, cr.decision AS clean_decision, cr.normalized_title AS clean_title,
  mn.category_canonical AS multilingual_category_canonical, mn.brand AS multilingual_brand, ae.status AS ai_status,
  ae.confidence AS ai_confidence, r.status AS research_status, r.canonical_title AS research_canonical_title
FROM verifications_v v JOIN listings_v l USING (listing_id) JOIN cleaning_v cr USING (listing_id)
LEFT JOIN multilingual_v mn USING (listing_id) LEFT JOIN research_v r USING (listing_id) LEFT JOIN ai_reviews_v ae USING (listing_id)
WHERE v.status = 'pending' AND cr.stage = 'done'""",
)
def pending_verifications(v: Inputs) -> DataFrame:
    return reviews.pending_verifications(
        v("verifications_v"), v("listings_v"), v("cleaning_v"), v("research_v"), v("ai_reviews_v"), v("multilingual_v")
    ).select(
        "listing_id", "query", "title", "price", "clean_decision", "clean_title",
        "multilingual_category_canonical", "multilingual_brand", "ai_status", "ai_confidence",
        "research_status", "research_canonical_title",
    )


@query(
    "pending_cleaning_top",
    QUEUE_VIEWS,
    """SELECT listing_id, title, ai_status, research_status FROM (
SELECT c.listing_id, l.title, a.status AS ai_status, r.status AS research_status, c.created_on, a.updated_on AS au, r.updated_on AS ru,
  CASE WHEN a.status IN ('resolved', 'uncertain') AND a.confidence >= 0.72 THEN 0 ELSE 1 END AS o1,
  CASE WHEN r.status IS NOT NULL THEN 0 ELSE 1 END AS o2
FROM cleaning_v c JOIN listings_v l USING (listing_id) LEFT JOIN research_v r USING (listing_id) LEFT JOIN ai_reviews_v a USING (listing_id)
WHERE c.stage = 'pending') ORDER BY o1, coalesce(au, '') DESC, o2, coalesce(ru, '') DESC, created_on, listing_id LIMIT 500""",
)
def pending_cleaning_top(v: Inputs) -> DataFrame:
    queue = reviews.pending_cleaning(
        v("cleaning_v"), v("listings_v"), v("research_v"), v("ai_reviews_v"), v("multilingual_v")
    )
    return (
        reviews.order_pending(queue, prefer_research=True, prefer_ai=True)
        .limit(500)
        .select("listing_id", "title", "ai_status", "research_status")
    )


@query(
    "review_summary",
    ["verifications_v"],
    "SELECT status AS value, CAST(count(*) AS BIGINT) AS n FROM verifications_v GROUP BY status",
)
def review_summary(v: Inputs) -> DataFrame:
    return reviews.review_summary(v("verifications_v"), "status")


@query(
    "market_summary",
    REVIEW_VIEWS + ["families_v", "variants_v", "aliases_v", "identifiers_v", "spec_facts_v"],
    """SELECT 'listings' AS area, 'all' AS value, CAST(count(*) AS BIGINT) AS n FROM listings_v
UNION ALL SELECT 'clean', coalesce(decision, ''), CAST(count(*) AS BIGINT) FROM cleaning_v GROUP BY 2
UNION ALL SELECT 'verify', status, CAST(count(*) AS BIGINT) FROM verifications_v GROUP BY 2
UNION ALL SELECT 'research', status, CAST(count(*) AS BIGINT) FROM research_v GROUP BY 2
UNION ALL SELECT 'ai', status, CAST(count(*) AS BIGINT) FROM ai_reviews_v GROUP BY 2
UNION ALL SELECT 'source', source, CAST(count(*) AS BIGINT) FROM listings_v GROUP BY 2
UNION ALL SELECT 'families', 'all', CAST(count(*) AS BIGINT) FROM families_v
UNION ALL SELECT 'variants', 'all', CAST(count(*) AS BIGINT) FROM variants_v
UNION ALL SELECT 'aliases', 'all', CAST(count(*) AS BIGINT) FROM aliases_v
UNION ALL SELECT 'identifiers', 'all', CAST(count(*) AS BIGINT) FROM identifiers_v
UNION ALL SELECT 'spec_facts', 'all', CAST(count(*) AS BIGINT) FROM spec_facts_v""",
)
def market_summary(v: Inputs) -> DataFrame:
    return reviews.long_counts(
        [
            ("listings", v("listings_v"), None),
            ("clean", v("cleaning_v"), "decision"),
            ("verify", v("verifications_v"), "status"),
            ("research", v("research_v"), "status"),
            ("ai", v("ai_reviews_v"), "status"),
            ("source", v("listings_v"), "source"),
            *[(t, v(f"{t}_v"), None) for t in ("families", "variants", "aliases", "identifiers", "spec_facts")],
        ]
    )


@query(
    "distinct_categories",
    ["research_v", "ai_reviews_v", "cleaning_v", "families_v"],
    """SELECT DISTINCT category FROM (SELECT canonical_category AS category FROM research_v UNION ALL SELECT canonical_category FROM ai_reviews_v
UNION ALL SELECT normalized_category FROM cleaning_v UNION ALL SELECT category FROM families_v)
WHERE coalesce(category, '') NOT IN ('', 'unknown')""",
)
def distinct_categories(v: Inputs) -> DataFrame:
    return reviews.distinct_categories(
        [
            (v("research_v"), "canonical_category"),
            (v("ai_reviews_v"), "canonical_category"),
            (v("cleaning_v"), "normalized_category"),
            (v("families_v"), "category"),
        ]
    )


def _sightings(v: Inputs) -> DataFrame:
    rows = v("listings_v").withColumnRenamed("listing_id", "sighting_id")
    fingerprint = listing_fingerprint(
        F.col("source"), F.col("external_id"), F.col("url"), F.col("title"), F.col("price"), F.col("location")
    )
    return rows.select(
        fingerprint.alias("fingerprint"),
        "sighting_id", "source", "external_id", "url", "title", "price", "currency", "location", "seller",
        "condition", "category", F.col("p_name").alias("query"), F.col("seen_on").alias("seen_at"),
        F.lit("run-1").alias("run_id"),
    )


SIGHTINGS_SQL = """s AS (SELECT sha1(source || '|' || external_id) AS fingerprint, *, seen_on || '#' || listing_id AS stamp FROM listings_v)"""


LISTING_SQL = f"""WITH {SIGHTINGS_SQL}
SELECT fingerprint, arg_max(title, stamp) AS title, arg_max(url, stamp) AS url, arg_max(price, stamp) FILTER (price IS NOT NULL) AS price,
  arg_max(currency, stamp) FILTER (currency <> '') AS currency, arg_max(p_name, stamp) AS query, arg_min(source, stamp) AS source,
  arg_min(external_id, stamp) AS external_id, arg_min(location, stamp) AS location, arg_min(seller, stamp) AS seller,
  arg_min(condition, stamp) AS condition, arg_min(category, stamp) AS category,
  min(seen_on) AS first_seen, max(seen_on) AS last_seen, CAST(count(*) AS BIGINT) AS seen_count FROM s GROUP BY fingerprint"""


@query("listing_upsert", ["listings_v"], LISTING_SQL)
def listing_upsert(v: Inputs) -> DataFrame:
    rows = _sightings(v)
    # The older half first, then the newer sightings on top of that snapshot.
    before = upsert.upsert_listings(None, rows.where("seen_at < '1998-01-01'"))
    return upsert.upsert_listings(before, rows.where("seen_at >= '1998-01-01'")).drop("set_at")


@query("listing_upsert_late", ["listings_v"], LISTING_SQL)
def listing_upsert_late(v: Inputs) -> DataFrame:
    """The newer half first: older sightings that arrive late give the same snapshot."""
    rows = _sightings(v)
    before = upsert.upsert_listings(None, rows.where("seen_at >= '1998-01-01'"))
    return upsert.upsert_listings(before, rows.where("seen_at < '1998-01-01'")).drop("set_at")


@query(
    "observations_append",
    ["listings_v"],
    f"""WITH {SIGHTINGS_SQL} SELECT fingerprint AS listing_id, 'run-1' AS run_id, seen_on AS seen_at, price, currency, p_name AS query FROM s""",
)
def observations_append(v: Inputs) -> DataFrame:
    return upsert.observations(_sightings(v))


@query(
    "apply_review_results",
    ["verifications_v", "results_v"],
    """WITH n AS (SELECT listing_id, max(position) AS p FROM results_v GROUP BY 1)
SELECT v.listing_id, CASE WHEN n.p IS NOT NULL THEN 'verified' ELSE v.status END AS status,
  CASE WHEN n.p IS NOT NULL THEN CAST(n.p AS DOUBLE) ELSE v.confidence END AS confidence, v.query
FROM verifications_v v LEFT JOIN n USING (listing_id)""",
)
def apply_review_results(v: Inputs) -> DataFrame:
    results = v("results_v").select(
        "listing_id",
        F.lit("verified").alias("status"),
        F.col("position").cast("double").alias("confidence"),
        F.col("position").alias("updated_at"),
    )
    return upsert.apply_reviews(
        v("verifications_v").select("listing_id", "status", "confidence", "query"), results
    )


RUNS_SQL = """runs AS (SELECT n_name AS source, CASE o_orderkey % 3 WHEN 0 THEN 'search' ELSE 'site_category:' || o_orderpriority END AS profile,
  CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'running' END AS status,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS started_at, CASE WHEN o_orderkey % 4 < 2 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS finished_at,
  CAST(o_orderkey AS STRING) AS task_key FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _runs(v: Inputs) -> DataFrame:
    orders = v("orders").join(v("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        v("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    day = F.col("o_orderdate").cast("date").cast("string")
    turn = F.col("o_orderkey") % 4
    return orders.select(
        F.col("n_name").alias("source"),
        F.when(F.col("o_orderkey") % 3 == 0, "search")
        .otherwise(F.concat(F.lit("site_category:"), "o_orderpriority"))
        .alias("profile"),
        F.when(turn == 0, "ok").when(turn == 1, "error").otherwise("running").alias("status"),
        day.alias("started_at"),
        F.when(turn < 2, day).alias("finished_at"),
        F.col("o_orderkey").cast("string").alias("task_key"),
    )


@query(
    "crawl_summary",
    ["listings_v"],
    f"""WITH {RUNS_SQL}
SELECT 'checkpoints' AS area, status AS value, CAST(count(*) AS BIGINT) AS n FROM runs WHERE profile = 'search' GROUP BY 2
UNION ALL SELECT 'site_runs', status, CAST(count(*) AS BIGINT) FROM runs WHERE profile LIKE 'site_category:%' GROUP BY 2
UNION ALL SELECT 'listings', 'all', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT source, external_id FROM listings_v)
UNION ALL SELECT 'observations', 'all', CAST(count(*) AS BIGINT) FROM listings_v""",
)
def crawl_summary(v: Inputs) -> DataFrame:
    runs = _runs(v)
    return reviews.crawl_summary(
        runs.where("profile = 'search'"),
        runs,
        v("listings_v").select("source", "external_id").distinct(),
        v("listings_v"),
    )


@query(
    "recent_checkpoints",
    [],
    f"""WITH {RUNS_SQL} SELECT source, 'search_run_fallback' AS task_kind, '' AS task_key, status, CAST(0 AS BIGINT) AS saved_count,
  coalesce(finished_at, started_at) AS updated_at FROM runs WHERE profile LIKE 'site_category:%'
ORDER BY updated_at DESC, source LIMIT 50""",
)
def recent_checkpoints(v: Inputs) -> DataFrame:
    runs = _runs(v)
    none = runs.where("status = 'no such status'").select(
        "source", F.lit("").alias("task_kind"), "task_key", "status",
        F.lit(0).cast("long").alias("saved_count"), F.col("started_at").alias("updated_at"),
    )
    return reviews.recent_checkpoints(none, runs)


@query(
    "latest_checkpoints",
    [],
    f"""WITH {RUNS_SQL} SELECT source, profile AS task_kind, '' AS task_key, max(started_at) AS updated_at,
  arg_max(status, started_at || '#' || status) AS status FROM runs GROUP BY source, profile""",
)
def latest_checkpoints(v: Inputs) -> DataFrame:
    log = _runs(v).select(
        "source", F.col("profile").alias("task_kind"), F.lit("").alias("task_key"),
        F.col("started_at").alias("updated_at"), "status",
    )
    return reviews.latest_checkpoints(log)


@query(
    "scored_category_view",
    REVIEW_VIEWS,
    f"""WITH {RESOLVED_SQL} SELECT category, CAST(count(*) AS BIGINT) AS n, {sql_round('max(price)', 2)} AS top_price FROM resolved WHERE price > 0 GROUP BY 1""",
)
def scored_category_view(v: Inputs) -> DataFrame:
    return (
        score_opportunities(_resolved(v))
        .where("price > 0")
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"), round_to(F.max("price"), 2).alias("top_price"))
    )
