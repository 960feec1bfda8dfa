"""Registered queries: catalog, enrichment and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.core import round_to
from bazaarlens.operators import catalog, enrich, evidence, upsert

from bazaarlens.plans.registry import Inputs, query

NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "catalog_family_overview",
    ["families_v", "variants_v", "aliases_v", "spec_facts_v"],
    """SELECT f.family_id, f.category, f.brand, f.family_name, f.confidence, f.last_seen,
  CAST((SELECT count(*) FROM variants_v c WHERE c.family_id = f.family_id) AS BIGINT) AS variants,
  CAST((SELECT count(*) FROM aliases_v c WHERE c.family_id = f.family_id) AS BIGINT) AS aliases,
  CAST((SELECT count(*) FROM spec_facts_v c WHERE c.family_id = f.family_id) AS BIGINT) AS spec_facts
FROM families_v f""",
)
def catalog_family_overview(v: Inputs) -> DataFrame:
    return catalog.family_overview(v("families_v"), v("variants_v"), v("aliases_v"), v("spec_facts_v"))


@query(
    "query_variants",
    ["families_v", "variants_v", "spec_facts_v"],
    """WITH k AS (SELECT variant_id, arg_max({'k': spec_key, 'v': spec_value, 'c': confidence}, {'c': confidence, 'k': spec_key, 'v': spec_value}) AS s
  FROM spec_facts_v WHERE spec_key = 'size' AND TRY_CAST(spec_value AS DOUBLE) >= 20 GROUP BY variant_id)
SELECT f.category, f.brand, f.family_name, v.variant_name, v.variant_id, s.k AS spec_key, s.v AS spec_value, s.c AS spec_confidence
FROM variants_v v JOIN families_v f USING (family_id) JOIN k USING (variant_id) WHERE f.category = 'PROMO'""",
)
def query_variants(v: Inputs) -> DataFrame:
    return catalog.query_variants(
        v("variants_v"), v("families_v"), v("spec_facts_v"), "PROMO", "size", 20
    )


CONFLICT_SQL = """vals AS (SELECT DISTINCT f.family_id, f.family_name, f.category, s.spec_key, s.spec_value
  FROM spec_facts_v s JOIN variants_v v ON v.variant_id = s.variant_id JOIN families_v f ON f.family_id = v.family_id)"""


@query(
    "spec_conflicts",
    ["families_v", "variants_v", "spec_facts_v"],
    f"""WITH {CONFLICT_SQL} SELECT 'warning' AS severity, 'conflicting_' || spec_key AS issue, family_id, family_name, spec_key,
  CAST(count(*) AS BIGINT) AS n_values, min(spec_value) AS first_value, max(spec_value) AS last_value
FROM vals GROUP BY family_id, family_name, spec_key HAVING count(*) > 1""",
)
def spec_conflicts(v: Inputs) -> DataFrame:
    values = catalog.spec_conflict_values(v("spec_facts_v"), v("variants_v"), v("families_v"))
    return catalog.spec_conflicts(values)


@query(
    "spec_conflict_values",
    ["families_v", "variants_v", "spec_facts_v"],
    f"WITH {CONFLICT_SQL} SELECT family_id, spec_key, spec_value FROM vals WHERE category = 'SMALL'",
)
def spec_conflict_values(v: Inputs) -> DataFrame:
    return catalog.spec_conflict_values(
        v("spec_facts_v"), v("variants_v"), v("families_v"), "SMALL"
    ).select("family_id", "spec_key", "spec_value")


@query(
    "check_claims",
    ["listings_v", "spec_facts_v"],
    """WITH claims AS (SELECT listing_id, family_key AS family_id, CASE WHEN l_orderkey % 9 = 0 THEN 'weight' ELSE 'size' END AS spec_key,
  CAST(1 + l_orderkey % 50 AS VARCHAR) AS claimed_value FROM listings_v)
SELECT listing_id, family_id, spec_key, claimed_value, 'unknown_variant_' || spec_key AS issue FROM claims c
WHERE EXISTS (SELECT 1 FROM spec_facts_v s WHERE s.family_id = c.family_id AND s.spec_key = c.spec_key)
  AND NOT EXISTS (SELECT 1 FROM spec_facts_v s WHERE s.family_id = c.family_id AND s.spec_key = c.spec_key AND s.spec_value = c.claimed_value)""",
)
def check_claims(v: Inputs) -> DataFrame:
    claims = v("listings_v").select(
        "listing_id",
        F.col("family_key").alias("family_id"),
        F.when(F.col("l_orderkey") % 9 == 0, "weight").otherwise("size").alias("spec_key"),
        (1 + F.col("l_orderkey") % 50).cast("string").alias("claimed_value"),
    )
    return catalog.check_claims(claims, v("spec_facts_v"))


@query(
    "catalog_summary",
    ["families_v", "variants_v", "aliases_v", "identifiers_v", "spec_facts_v"],
    " UNION ALL ".join(
        f"SELECT '{t}' AS area, CAST(count(*) AS BIGINT) AS n FROM {t}_v"
        for t in ("families", "variants", "aliases", "identifiers", "spec_facts")
    ),
)
def catalog_summary(v: Inputs) -> DataFrame:
    return catalog.catalog_summary(
        {t: v(f"{t}_v") for t in ("families", "variants", "aliases", "identifiers", "spec_facts")}
    )


@query(
    "conflict_summary",
    ["families_v", "variants_v", "spec_facts_v"],
    f"""WITH {CONFLICT_SQL}, c AS (SELECT family_id, spec_key FROM vals GROUP BY 1, 2 HAVING count(*) > 1)
SELECT 'conflicting_' || spec_key AS conflict_key, 'open' AS status, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1""",
)
def conflict_summary(v: Inputs) -> DataFrame:
    values = catalog.spec_conflict_values(v("spec_facts_v"), v("variants_v"), v("families_v"))
    issues = catalog.spec_conflicts(values)
    log = upsert.append_conflicts(
        issues, "fact_check", F.lit("2026-01-01"), F.col("issue"), F.col("last_value"), F.col("first_value")
    )
    return catalog.conflict_summary(log)


@query(
    "resolve_entity_refs",
    ["listings_v", "families_v", "variants_v"],
    """WITH r AS (SELECT listing_id, CASE WHEN l_orderkey % 10 = 0 THEN '' WHEN l_orderkey % 10 = 1 THEN 'none' ELSE family_key END AS fk,
  CASE WHEN l_orderkey % 3 = 0 THEN variant_key END AS vk FROM listings_v)
SELECT listing_id, CASE WHEN fk = '' THEN 'no_family_key' WHEN fk NOT IN (SELECT family_id FROM families_v) THEN 'unknown_family_key'
  WHEN vk IS NOT NULL AND NOT EXISTS (SELECT 1 FROM variants_v v WHERE v.family_id = fk AND v.variant_id = vk) THEN 'unknown_variant_key' ELSE 'ok' END AS outcome FROM r""",
)
def resolve_entity_refs(v: Inputs) -> DataFrame:
    refs = v("listings_v").select(
        "listing_id",
        F.when(F.col("l_orderkey") % 10 == 0, "")
        .when(F.col("l_orderkey") % 10 == 1, "none")
        .otherwise(F.col("family_key"))
        .alias("family_key"),
        F.when(F.col("l_orderkey") % 3 == 0, F.col("variant_key")).alias("variant_key"),
    )
    good, bad = catalog.resolve_entity_refs(refs, v("families_v"), v("variants_v"))
    return good.select("listing_id", F.lit("ok").alias("outcome")).unionByName(
        bad.select("listing_id", F.col("reject_reason").alias("outcome"))
    )


EDGES_SQL = """checked AS (SELECT *, lower(trim(relation_type)) AS kind, least(confidence, 1.0::DOUBLE) AS c,
    subject_family = object_family AND subject_variant IS NOT DISTINCT FROM object_variant AS own FROM relations_v),
edges AS (SELECT subject_family, subject_variant, kind AS relation_type, object_family, object_variant, source, max(c) AS confidence
  FROM checked WHERE kind IN ('accessory_for', 'compatible_with') AND NOT own GROUP BY ALL)"""


def _edges(v: Inputs) -> tuple[DataFrame, DataFrame]:
    return upsert.upsert_relations(None, v("relations_v"))


@query("relations_upsert", ["relations_v"], f"WITH {EDGES_SQL} SELECT * FROM edges")
def relations_upsert(v: Inputs) -> DataFrame:
    return _edges(v)[0]


@query(
    "relation_rejects",
    ["relations_v"],
    f"""WITH {EDGES_SQL} SELECT edge_id, CASE WHEN kind NOT IN ('accessory_for', 'compatible_with') THEN 'unsupported_type' ELSE 'self_edge' END AS reject_reason
FROM checked WHERE kind NOT IN ('accessory_for', 'compatible_with') OR own""",
)
def relation_rejects(v: Inputs) -> DataFrame:
    return _edges(v)[1].select("edge_id", "reject_reason")


@query(
    "relations_both_ways",
    ["relations_v", "families_v", "variants_v"],
    f"""WITH {EDGES_SQL},
ents AS (SELECT variant_id, family_id FROM variants_v),
b AS (SELECT e.family_id, e.variant_id, 'outgoing' AS direction, r.relation_type, r.object_family AS other_family, r.object_variant AS other_variant, r.confidence, r.source
  FROM ents e JOIN edges r ON r.subject_family = e.family_id AND (r.subject_variant IS NULL OR r.subject_variant = e.variant_id)
  UNION ALL
  SELECT e.family_id, e.variant_id, 'incoming', r.relation_type, r.subject_family, r.subject_variant, r.confidence, r.source
  FROM ents e JOIN edges r ON r.object_family = e.family_id AND (r.object_variant IS NULL OR r.object_variant = e.variant_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY family_id, variant_id ORDER BY confidence DESC, direction, relation_type, other_family, coalesce(other_variant, ''), source) AS rank FROM b)
SELECT k.family_id, k.variant_id, direction, relation_type, other_family, other_variant, k.confidence, source, CAST(rank AS INTEGER) AS rank,
  f.brand AS other_brand, f.family_name AS other_name, coalesce(v.variant_name, '') AS other_variant_name
FROM k JOIN families_v f ON f.family_id = k.other_family
LEFT JOIN variants_v v ON v.variant_id = k.other_variant AND v.family_id = k.other_family WHERE rank <= 50""",
)
def relations_both_ways(v: Inputs) -> DataFrame:
    entities = v("variants_v").select("family_id", "variant_id")
    return catalog.relations_both_ways(entities, _edges(v)[0], v("families_v"), v("variants_v"))


@query(
    "orphan_references",
    ["families_v", "variants_v", "aliases_v", "identifiers_v", "spec_facts_v"],
    " UNION ALL ".join(
        f"SELECT '{t}' AS child, 'variant_id' AS missing, variant_id AS value, CAST(count(*) AS BIGINT) AS n FROM {t}_v "
        "WHERE variant_id IS NOT NULL AND variant_id NOT IN (SELECT variant_id FROM variants_v) GROUP BY variant_id"
        for t in ("aliases", "identifiers", "spec_facts")
    ),
)
def orphan_references(v: Inputs) -> DataFrame:
    return catalog.orphan_references(
        v("families_v"),
        v("variants_v"),
        {t: v(f"{t}_v") for t in ("aliases", "identifiers", "spec_facts")},
    )


GAP_VIEWS = ["families_v", "variants_v", "aliases_v", "identifiers_v", "spec_facts_v"]


def _has(table: str) -> str:
    return (
        f"EXISTS (SELECT 1 FROM {table}_v c WHERE c.family_id = f.family_id) OR EXISTS (SELECT 1 FROM {table}_v c "
        "JOIN variants_v v ON v.variant_id = c.variant_id WHERE v.family_id = f.family_id)"
    )


MISSING_SQL = f"""missing AS (
SELECT family_id, 'variants' AS task_type, 40 AS priority FROM families_v f WHERE NOT EXISTS (SELECT 1 FROM variants_v c WHERE c.family_id = f.family_id)
UNION ALL SELECT family_id, 'aliases', 50 FROM families_v f WHERE NOT ({_has('aliases')})
UNION ALL SELECT family_id, 'identifiers', 10 FROM families_v f WHERE NOT ({_has('identifiers')})
UNION ALL SELECT family_id, 'specifications', 30 FROM families_v f WHERE NOT ({_has('spec_facts')}))"""


def _missing(v: Inputs) -> DataFrame:
    return enrich.missing_kinds(*[v(name) for name in GAP_VIEWS])


@query(
    "gap_tasks",
    GAP_VIEWS,
    f"WITH {MISSING_SQL} SELECT family_id, task_type, 'pending' AS status, priority FROM missing WHERE NOT (task_type = 'aliases' AND family_id LIKE 'PROMO%')",
)
def gap_tasks(v: Inputs) -> DataFrame:
    existing = v("families_v").where("category = 'PROMO'").select(
        "family_id", F.lit(None).cast("string").alias("variant_id"), F.lit("aliases").alias("task_type")
    )
    return enrich.gap_tasks(_missing(v), existing, F.lit("2026-01-01")).select(
        "family_id", "task_type", "status", "priority"
    )


QUEUE_SQL = """q AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'identifiers' WHEN 1 THEN 'variants' WHEN 2 THEN 'aliases' ELSE 'specifications' END AS task_type,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending'
    WHEN o_orderdate < TIMESTAMP '1998-01-01' AND o_custkey % 2 = 0 THEN 'pending' ELSE 'running' END AS status,
  CAST(o_custkey % 5 AS INTEGER) AS attempts FROM orders)"""


@query(
    "queue_status",
    [],
    f"""WITH {QUEUE_SQL} SELECT task_type, status, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (status = 'pending' AND attempts < 3) AS BIGINT) AS claimable FROM q GROUP BY task_type, status""",
)
def queue_status(v: Inputs) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("identifiers", "variants", "aliases", "specifications")])
    tasks = v("orders").select(
        F.get(kinds, (F.col("o_orderkey") % 4).cast("int")).alias("task_type"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "pending")
        .otherwise("running")
        .alias("status"),
        (F.col("o_custkey") % 5).cast("int").alias("attempts"),
        F.lit(3).alias("max_attempts"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderdate").cast("date").cast("string")).alias("lease_until"),
        F.lit("w").alias("worker_id"),
    )
    return enrich.queue_status(enrich.release_stale(tasks, F.lit("1998-01-01")))


SHARED_SQL = f"""shared AS (SELECT {NORM.format('alias')} AS a FROM aliases_v GROUP BY 1 HAVING count(DISTINCT family_id) > 1)"""


@query(
    "knowledge_coverage",
    GAP_VIEWS,
    f"""WITH {MISSING_SQL}, {SHARED_SQL} SELECT 'without_' || task_type AS measure, CAST(count(*) AS BIGINT) AS n FROM missing GROUP BY 1
UNION ALL SELECT 'shared_aliases', CAST(count(*) AS BIGINT) FROM shared""",
)
def knowledge_coverage(v: Inputs) -> DataFrame:
    return enrich.knowledge_coverage(_missing(v), v("aliases_v"))


@query(
    "alias_quality",
    ["aliases_v", "families_v"],
    f"""WITH {SHARED_SQL}
SELECT alias_id, CASE WHEN r = 'ok' THEN 'keep' ELSE 'reject' END AS decision, r AS reason FROM (
SELECT a.alias_id, CASE WHEN alias = 'widget' AND NOT contains(' ' || lower(f.family_name) || ' ', ' widget ') THEN 'one_word_outside_family_name'
  WHEN {NORM.format('alias')} IN (SELECT a FROM shared) THEN 'shared_by_families' ELSE 'ok' END AS r
FROM aliases_v a JOIN families_v f USING (family_id))""",
)
def alias_quality(v: Inputs) -> DataFrame:
    return enrich.alias_quality(v("aliases_v"), v("families_v"), F.lit("2026-01-01")).select(
        "alias_id", "decision", "reason"
    )


CLAIMS_SQL = """claims AS (SELECT evidence_id, family_id, variant_id, regexp_replace(lower(regexp_extract(source_ref, '^https?://([^/]*)', 1)), '^www\\.', '') AS site,
  'ean' AS field_name, regexp_extract(excerpt, 'EAN: ([0-9]{13})', 1) AS value FROM evidence_v
  UNION ALL SELECT evidence_id, family_id, variant_id, regexp_replace(lower(regexp_extract(source_ref, '^https?://([^/]*)', 1)), '^www\\.', ''),
  'upc', '123456789012' FROM evidence_v WHERE value_text <> ''),
proposals AS (SELECT family_id, variant_id, field_name, value, CAST(count(DISTINCT site) AS BIGINT) AS support_count,
  CAST(count(DISTINCT evidence_id) AS BIGINT) AS evidence_count FROM claims GROUP BY ALL),
rated AS (SELECT 'identifier' AS proposal_type, *, CASE WHEN support_count >= 3 THEN 0.96::DOUBLE WHEN support_count = 2 THEN 0.88::DOUBLE ELSE 0.55::DOUBLE END AS confidence,
  CASE WHEN support_count >= 2 THEN 'promotable' ELSE 'needs_evidence' END AS status,
  CASE WHEN support_count >= 3 THEN 'consenso_fra_almeno_tre_domini' WHEN support_count = 2 THEN 'consenso_fra_due_domini' ELSE 'una_sola_fonte_indipendente' END AS reason FROM proposals)"""


def _proposals(v: Inputs) -> DataFrame:
    return evidence.identifier_consensus(evidence.identifier_claims(v("evidence_v")))


@query("identifier_consensus", ["evidence_v"], f"WITH {CLAIMS_SQL} SELECT * FROM rated")
def identifier_consensus(v: Inputs) -> DataFrame:
    return _proposals(v)


@query(
    "proposal_sources",
    ["evidence_v"],
    f"WITH {CLAIMS_SQL} SELECT DISTINCT family_id, variant_id, field_name, value, site FROM claims WHERE site <> ''",
)
def proposal_sources(v: Inputs) -> DataFrame:
    return evidence.proposal_sources(evidence.identifier_claims(v("evidence_v")))


@query(
    "promote_identifiers",
    ["evidence_v", "identifiers_v"],
    f"""WITH {CLAIMS_SQL} SELECT family_id, variant_id, field_name AS identifier_type, value AS identifier_value,
  'multi_source_web_evidence' AS source, confidence FROM rated r WHERE status = 'promotable' AND confidence >= 0.88
  AND NOT EXISTS (SELECT 1 FROM identifiers_v i WHERE i.family_id = r.family_id AND i.variant_id IS NOT DISTINCT FROM r.variant_id
    AND i.identifier_type = r.field_name AND i.identifier_value = r.value)""",
)
def promote_identifiers(v: Inputs) -> DataFrame:
    stored = evidence.upsert_proposals(None, _proposals(v), F.lit("2026-01-01"))
    return evidence.promote_identifiers(stored, v("identifiers_v"))[0]


@query(
    "upsert_proposals",
    ["evidence_v"],
    f"WITH {CLAIMS_SQL} SELECT proposal_type, field_name, status, CAST(count(*) AS BIGINT) AS n, CAST(sum(evidence_count) AS BIGINT) AS evidence FROM rated GROUP BY ALL",
)
def upsert_proposals(v: Inputs) -> DataFrame:
    first = evidence.upsert_proposals(None, _proposals(v), F.lit("2026-01-01"))
    again = evidence.upsert_proposals(first, _proposals(v), F.lit("2026-01-02"))
    return again.groupBy("proposal_type", "field_name", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("evidence_count").alias("evidence")
    )


def _learned(v: Inputs) -> DataFrame:
    return v("listings_v").select(
        F.col("listing_id").alias("row_id"), F.col("seen_on").alias("seen_at"), "family_key", "variant_key",
        F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("p_name").alias("family_name"),
        F.concat_ws(" ", "p_name", "seller").alias("variant_name"),
        F.when(F.col("l_linenumber") > 3, "variant_ambiguous").otherwise("resolved").alias("ambiguity_status"),
        F.lit("").alias("metadata_json"),
        (F.lit(50) + F.col("l_orderkey") % 45).cast("double").alias("points"),
        F.lit("ean").alias("identifier_type"), F.col("code").alias("identifier_value"), "source",
        F.col("title").alias("alias"), F.lit("size").alias("spec_key"),
        F.col("l_linenumber").cast("string").alias("spec_value"), F.lit("").alias("unit"),
    ).withColumn("confidence", F.col("points") / 100.0)


LEARNED_SQL = """n AS (SELECT *, seen_on || '#' || listing_id AS stamp, CAST(50 + l_orderkey % 45 AS DOUBLE) / 100.0::DOUBLE AS confidence FROM listings_v)"""


@query(
    "family_upsert",
    ["listings_v"],
    f"""WITH {LEARNED_SQL} SELECT family_key, arg_min(p_type, stamp) AS category, arg_min(p_brand, stamp) AS brand, arg_min(p_name, stamp) AS family_name,
  max(confidence) AS confidence, min(seen_on) AS first_seen, max(seen_on) AS last_seen FROM n GROUP BY family_key""",
)
def family_upsert(v: Inputs) -> DataFrame:
    rows = _learned(v)
    first = upsert.upsert_families(None, rows.where("seen_at < '1999-01-01'"))
    return upsert.upsert_families(first, rows.where("seen_at >= '1999-01-01'")).drop("metadata_json", "set_at")


@query(
    "family_upsert_late",
    ["listings_v"],
    f"""WITH {LEARNED_SQL} SELECT family_key, arg_min(p_type, stamp) AS category, arg_min(p_brand, stamp) AS brand, arg_min(p_name, stamp) AS family_name,
  max(confidence) AS confidence, min(seen_on) AS first_seen, max(seen_on) AS last_seen FROM n GROUP BY family_key""",
)
def family_upsert_late(v: Inputs) -> DataFrame:
    """The newer half first: older rows that arrive late give the same table."""
    rows = _learned(v)
    first = upsert.upsert_families(None, rows.where("seen_at >= '1999-01-01'"))
    return upsert.upsert_families(first, rows.where("seen_at < '1999-01-01'")).drop("metadata_json", "set_at")


@query(
    "variant_upsert",
    ["listings_v"],
    f"""WITH {LEARNED_SQL} SELECT variant_key, arg_min(family_key, stamp) AS family_key, arg_min(p_name || ' ' || seller, stamp) AS variant_name,
  arg_max(CASE WHEN l_linenumber > 3 THEN 'variant_ambiguous' ELSE 'resolved' END, stamp) AS ambiguity_status,
  max(confidence) AS confidence, min(seen_on) AS first_seen, max(seen_on) AS last_seen FROM n GROUP BY variant_key""",
)
def variant_upsert(v: Inputs) -> DataFrame:
    return upsert.upsert_variants(None, _learned(v)).drop("metadata_json", "set_at")


@query(
    "identifier_upsert",
    ["listings_v"],
    f"""WITH {LEARNED_SQL} SELECT 'ean' AS identifier_type, code AS identifier_value, source, min(family_key) AS family_key,
  arg_min(variant_key, stamp) FILTER (variant_key IS NOT NULL) AS variant_key, max(confidence) AS confidence, min(seen_on) AS first_seen, max(seen_on) AS last_seen FROM n GROUP BY code, source""",
)
def identifier_upsert(v: Inputs) -> DataFrame:
    return upsert.upsert_identifiers(None, _learned(v)).drop("set_at")


@query(
    "alias_upsert",
    ["listings_v"],
    f"""WITH {LEARNED_SQL} SELECT {NORM.format('title')} AS alias_norm, source, arg_min(trim(title), stamp) AS alias, arg_min(family_key, stamp) AS family_key,
  arg_min(variant_key, stamp) AS variant_key, max(confidence) AS confidence, min(seen_on) AS first_seen, max(seen_on) AS last_seen FROM n GROUP BY 1, 2""",
)
def alias_upsert(v: Inputs) -> DataFrame:
    return upsert.upsert_aliases(None, _learned(v)).drop("set_at")


@query(
    "spec_fact_upsert",
    ["listings_v"],
    f"""WITH {LEARNED_SQL} SELECT variant_key, family_key, 'size' AS spec_key, CAST(l_linenumber AS VARCHAR) AS spec_value, source, '' AS unit,
  max(confidence) AS confidence, min(seen_on) AS first_seen, max(seen_on) AS last_seen FROM n GROUP BY ALL""",
)
def spec_fact_upsert(v: Inputs) -> DataFrame:
    rows = _learned(v)
    first = upsert.upsert_spec_facts(None, rows)
    return upsert.upsert_spec_facts(first, rows).drop("set_at")


@query(
    "candidate_links",
    ["listings_v"],
    """SELECT listing_id, family_key, CASE WHEN l_linenumber % 2 = 0 THEN variant_key END AS variant_key FROM listings_v
WHERE NOT (l_linenumber % 2 = 1 AND l_orderkey % 4 = 0)""",
)
def candidate_links(v: Inputs) -> DataFrame:
    links = v("listings_v").select(
        "listing_id", "family_key",
        F.when(F.col("l_linenumber") % 2 == 0, F.col("variant_key")).alias("variant_key"),
        F.lit(0.5).alias("score"), F.lit("learned").alias("reason"), F.lit("2026-01-01").alias("created_at"),
        "l_linenumber", "l_orderkey",
    )
    there = links.where("l_linenumber % 2 = 1 AND l_orderkey % 4 = 0")
    return upsert.link_candidates(there, links).select("listing_id", "family_key", "variant_key")


VERIFY_VIEWS = ["listings_v", "cleaning_v", "results_v"]


def _to_verify(v: Inputs) -> DataFrame:
    clean = v("cleaning_v").select(
        "listing_id",
        F.col("decision").alias("clean_decision"),
        F.col("normalized_title").alias("clean_title"),
        F.col("normalized_category").alias("clean_category"),
    )
    return v("listings_v").select("listing_id", "title", "url", "category").join(clean, "listing_id", "left")


@query("verify_listings")
def verify_listings(v: Inputs) -> DataFrame:
    return evidence.verify_listings(_to_verify(v), v("results_v")).withColumn(
        "confidence", round_to(F.col("confidence"), 4)
    )


RULES_VIEWS = ["requests_v", "results_v"]
# A request about RAM or a GPU and the sizes that three results state.
THRESHOLD_SQL = f"""r AS (SELECT request_id, request, p AS position,
  CASE p WHEN 1 THEN 'module ' || CAST(8 * (1 + o_custkey % 9) AS VARCHAR) || 'GB' WHEN 2 THEN 'no size given' ELSE 'kit 16 gb and ' || CAST(o_custkey % 64 AS VARCHAR) || ' gb' END AS title
  FROM requests_v, (SELECT unnest([1, 2, 3]) AS p)),
g AS (SELECT *, TRY_CAST(regexp_extract(lower(request), '(?:almeno|oltre)\\s*([0-9]+)\\s*gb\\b', 1) AS DOUBLE) AS need,
  list_max(list_transform(regexp_extract_all(lower(title), '([0-9]+)\\s*gb', 1), lambda x: CAST(x AS DOUBLE))) AS best,
  regexp_matches(lower(request), '(minimo\\s*18\\s*volt|144hz o superiore)') AS other FROM r),
s AS (SELECT *, CASE WHEN need IS NULL AND NOT other THEN 'no_threshold' WHEN other OR best IS NULL THEN 'unknown' WHEN best < need THEN 'below_minimum' ELSE 'match' END AS status FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN status = 'unknown' THEN 1 ELSE 0 END, position) AS rank FROM s WHERE status <> 'below_minimum')"""


@query(
    "threshold_post_filter",
    ["requests_v"],
    f"WITH {THRESHOLD_SQL} SELECT request_id, CAST(position AS INTEGER) AS position, status, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 2",
)
def threshold_post_filter(v: Inputs) -> DataFrame:
    size = F.col("o_custkey")
    rows = v("requests_v").select(
        "*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("position")
    ).withColumns(
        {
            "title": F.when(
                F.col("position") == 1, F.concat(F.lit("module "), (8 * (1 + size % 9)).cast("string"), F.lit("GB"))
            )
            .when(F.col("position") == 2, "no size given")
            .otherwise(F.concat(F.lit("kit 16 gb and "), (size % 64).cast("string"), F.lit(" gb"))),
            "snippet": F.lit(""),
            "url": F.lit(""),
        }
    )
    return evidence.threshold_post_filter(rows, 2).select("request_id", "position", "status", "rank")


