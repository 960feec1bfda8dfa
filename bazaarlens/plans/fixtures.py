"""Marketplace-shaped views over the supplied tables.

Each view is one SELECT that Spark and DuckDB read alike. Names in braces are its inputs.
"""

from __future__ import annotations

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def sql_round(expr: str, digits: int) -> str:
    """The rounding both engines agree on, as SQL text."""
    scale = 10**digits
    return (
        f"(CAST(floor(({expr}) * CAST({scale} AS DOUBLE) + CAST(0.500001 AS DOUBLE)) AS DOUBLE)"
        f" / CAST({scale} AS DOUBLE))"
    )


def _digit(number: str, power: int) -> str:
    return f"(CAST(floor({number} / CAST({10**power} AS DOUBLE)) AS BIGINT) % 10)"


def _ean13(number: str) -> str:
    """A 12-digit number with its check digit, as text."""
    weighted = " + ".join(f"{_digit(number, p)} * {3 if p % 2 == 0 else 1}" for p in range(12))
    return f"CAST({number} AS STRING) || CAST((10 - ({weighted}) % 10) % 10 AS STRING)"


_CODE = "(200000000000 + p_partkey * 37)"

_TITLE = """CASE l_partkey % 24
  WHEN 0 THEN 'Pochi rimasti iPhone ' || CAST(10 + p_size % 7 AS STRING) || ' 4,9 ' || euro || ',00 € 849,00 € (Nuovo)'
  WHEN 1 THEN 'NVIDIA GeForce RTX ' || CAST(3000 + p_size * 10 AS STRING) || ' Ti ' || CAST(4 * (1 + p_size % 6) AS STRING) || 'GB GDDR6 scheda video'
  WHEN 2 THEN 'Kingston RAM DDR4 ' || CAST(1 + p_size % 4 AS STRING) || 'x' || CAST(8 * (1 + p_size % 4) AS STRING) || 'GB SODIMM ECC memoria'
  WHEN 3 THEN 'Dell monitor ' || CAST(20 + p_size % 14 AS STRING) || ' pollici ' || CAST(60 + p_size AS STRING) || ' Hz 2560x1440 MPN: U27' || CAST(p_partkey AS STRING) || 'Q'
  WHEN 4 THEN 'Lenovo ThinkPad T' || CAST(400 + p_size AS STRING) || ' usato 16GB 512GB SSD'
  WHEN 5 THEN 'offerta Samsung Galaxy S' || CAST(10 + p_size % 14 AS STRING) || ' telefono ' || CAST(64 * (1 + p_size % 4) AS STRING) || 'GB EAN ' || code
  WHEN 6 THEN 'Sony WH-' || CAST(1000 + p_size AS STRING) || 'XM4 cuffie bluetooth new'
  WHEN 7 THEN 'View all ' || p_name
  WHEN 8 THEN 'cavo USB-C 20V caricatore ' || p_name || ' ' || euro || ' EUR'
  WHEN 9 THEN 'Makita trapano avvitatore 18V batteria ' || CAST(p_size AS STRING) || ' pezzi'
  WHEN 10 THEN 'Smartphones'
  WHEN 11 THEN 'LEGO minifigure set ' || CAST(p_partkey AS STRING) || ' sealed'
  WHEN 12 THEN 'Poster wall art ' || p_name || ' ' || CAST(p_size AS STRING) || ' cm'
  WHEN 13 THEN 'HP EliteBook ' || CAST(800 + p_size AS STRING) || ' notebook ricondizionato SKU HP-' || CAST(p_partkey AS STRING) || 'AB'
  WHEN 14 THEN 'Opel Astra 1.6 diesel ' || CAST(2000 + p_size % 20 AS STRING)
  WHEN 15 THEN 'PlayStation 5 console controller ' || p_name
  WHEN 16 THEN 'Apple Watch Series ' || CAST(3 + p_size % 7 AS STRING) || ' smartwatch difettoso'
  WHEN 17 THEN 'SSD NVMe ' || CAST(1 + p_size % 4 AS STRING) || 'TB Crucial P' || CAST(p_size AS STRING) || ' ' || code
  WHEN 18 THEN 'gas r410a refrigerant ' || p_name
  WHEN 19 THEN 'tavolo ' || p_name || ' sedia vendo'
  WHEN 20 THEN 'Super offerta ' || p_brand || ' ' || p_name || ' affare'
  WHEN 21 THEN '2 x 32 GB DDR4 Corsair Vengeance kit RAM'
  ELSE p_brand || ' ' || p_name || ' ' || CAST(p_size AS STRING)
END"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

# One row per part: catalog identity, a noisy title and a 13-digit code.
VIEWS["parts_v"] = (
    ("part",),
    f"""
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice,
  p_type || ':' || p_brand || ':' || p_name AS family_key,
  p_type || ':' || p_brand || ':' || p_name || ':' || CAST(p_size AS STRING) AS variant_key,
  {_ean13(_CODE)} AS code,
  CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) AS euro,
  CASE p_type WHEN 'PROMO' THEN 'Accessori' WHEN 'SMALL' THEN 'technology_smartphone'
    WHEN 'MEDIUM' THEN 'laptop' WHEN 'LARGE' THEN 'unknown'
    WHEN 'ECONOMY' THEN 'tavolo , Icona di menu' ELSE 'technology_phone' END AS raw_category
FROM {{part}}""",
)

def _listings(title: str, parts: str) -> str:
    return f"""
SELECT
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
    || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS BIGINT) AS STRING)
    || '-' || CAST(CAST(l_shipdate AS DATE) AS STRING) AS listing_id,
  l_orderkey, l_linenumber, l_partkey, l_suppkey,
  n_name AS source,
  CAST(l_partkey AS STRING) AS external_id,
  'https://www.shop' || CAST(l_suppkey % 40 AS STRING) || '.example.'
    || CASE l_suppkey % 4 WHEN 0 THEN 'it' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'com' END
    || CASE l_orderkey % 8 WHEN 0 THEN '/category/' WHEN 1 THEN '/x/' ELSE '/item/' END
    || replace(lower(p_name), ' ', '-') || '-' || CAST(l_partkey AS STRING)
    || '?ref=' || CAST(l_linenumber AS STRING) AS url,
  {title} AS title,
  CASE WHEN l_quantity = 50 AND l_tax > 0.06 THEN NULL WHEN l_quantity = 49 AND l_tax > 0.06 THEN CAST(0 AS DOUBLE)
    ELSE {sql_round("l_extendedprice / l_quantity", 2)} END AS price,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'EUR' END AS currency,
  'Zone ' || CAST(l_suppkey % 10 AS STRING) AS location,
  s_name AS seller,
  CASE l_returnflag WHEN 'A' THEN 'used' WHEN 'R' THEN 'refurbished' ELSE '' END AS condition,
  raw_category AS category,
  p_type, p_brand, p_name, family_key, variant_key, code,
  'Item ' || p_name || ' of ' || p_brand || ', size ' || CAST(p_size AS STRING) || ', code ' || code AS description,
  CAST(CAST(l_shipdate AS DATE) AS STRING) AS seen_on
FROM {{lineitem}}
JOIN {{{parts}}} ON l_partkey = p_partkey
JOIN {{supplier}} ON l_suppkey = s_suppkey
JOIN {{nation}} ON s_nationkey = n_nationkey"""


# One row per sighting of an offer.
VIEWS["listings_v"] = (("lineitem", "parts_v", "supplier", "nation"), _listings(_TITLE, "parts_v"))

# Review tables of the listings; some listings have no row in each of them.
VIEWS["cleaning_v"] = (
    ("listings_v",),
    """
SELECT listing_id,
  CASE WHEN k < 7 THEN 'done' ELSE 'pending' END AS stage,
  CASE WHEN k < 4 THEN 'accept' WHEN k < 6 THEN 'uncertain' WHEN k = 6 THEN 'reject' END AS decision,
  CASE WHEN k < 7 THEN CAST(50 + 5 * k AS DOUBLE) / CAST(100 AS DOUBLE) END AS confidence,
  CASE WHEN k < 7 THEN 'rule ' || CAST(k AS STRING) END AS reason,
  CASE WHEN k < 2 THEN p_brand || ' ' || p_name WHEN k = 2 THEN '  ' END AS normalized_title,
  CASE WHEN k = 0 THEN 'technology_gpu' WHEN k = 1 THEN 'unknown' WHEN k = 3 THEN 'technology_laptop' END AS normalized_category,
  seen_on AS created_on, seen_on AS updated_on
FROM (SELECT *, (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 10 AS k FROM {listings_v}) AS c
WHERE k < 9""",
)
VIEWS["verifications_v"] = (
    ("listings_v",),
    """
SELECT listing_id,
  CASE WHEN k < 5 THEN 'verified' WHEN k = 5 THEN 'verified_conflict' WHEN k < 8 THEN 'uncertain' ELSE 'pending' END AS status,
  'q ' || p_name AS query,
  CASE WHEN k < 8 THEN CAST(95 - 7 * k AS DOUBLE) / CAST(100 AS DOUBLE) END AS confidence,
  CASE WHEN k < 8 THEN 'check ' || CAST(k AS STRING) END AS reason,
  seen_on AS created_on, seen_on AS updated_on
FROM (SELECT *, (l_orderkey * 3 + l_suppkey) % 12 AS k FROM {listings_v}) AS c
WHERE k < 10""",
)
VIEWS["research_v"] = (
    ("listings_v",),
    """
SELECT listing_id,
  CASE WHEN k < 4 THEN 'researched' ELSE 'failed' END AS status,
  CASE WHEN k < 2 THEN 'Research ' || p_brand || ' ' || p_name ELSE '' END AS canonical_title,
  CASE WHEN k < 3 THEN p_brand ELSE ' ' END AS canonical_brand,
  CASE WHEN k < 3 THEN p_name END AS canonical_model,
  CASE k WHEN 0 THEN 'technology_smartphone' WHEN 1 THEN 'unknown' WHEN 2 THEN 'technology_monitor' ELSE 'toys_lego' END AS canonical_category,
  CAST(60 + 8 * k AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  seen_on AS updated_on
FROM (SELECT *, (l_orderkey + 2 * l_partkey) % 8 AS k FROM {listings_v}) AS c
WHERE k < 5""",
)
VIEWS["ai_reviews_v"] = (
    ("listings_v",),
    """
SELECT listing_id,
  CASE WHEN k < 2 THEN 'resolved' WHEN k = 2 THEN 'uncertain' ELSE 'failed' END AS status,
  CASE WHEN k = 0 THEN 'AI ' || p_name ELSE ' ' END AS canonical_title,
  p_brand AS canonical_brand, p_name AS canonical_model,
  CASE k WHEN 0 THEN 'technology_gpu' WHEN 1 THEN 'unknown' ELSE 'technology_console' END AS canonical_category,
  CASE WHEN k = 0 THEN 'categoria corretta' ELSE '' END AS reason,
  CASE WHEN l_linenumber = 1 THEN 'technology_desktop_pc' END AS raw_category,
  CAST(96 - 12 * k AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  seen_on AS updated_on
FROM (SELECT *, (l_orderkey * 5 + l_suppkey) % 9 AS k FROM {listings_v}) AS c
WHERE k < 4""",
)
VIEWS["multilingual_v"] = (
    ("listings_v",),
    """
SELECT listing_id,
  CASE WHEN k = 0 THEN 'scheda video ' || p_name END AS title_en,
  CASE WHEN k < 3 THEN 'hint ' || p_name ELSE '' END AS title_en_hint,
  CASE k WHEN 0 THEN 'technology_gpu' WHEN 1 THEN 'technology_audio_headphones' ELSE 'technology_ram' END AS category_canonical,
  p_brand AS brand, p_name AS model,
  CAST(55 + 10 * k AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
FROM (SELECT *, (l_orderkey + l_suppkey) % 6 AS k FROM {listings_v}) AS c
WHERE k < 4""",
)

# Catalog tables.
VIEWS["families_v"] = (
    ("parts_v",),
    """
SELECT family_key AS family_id, p_type AS category, p_brand AS brand, p_name AS family_name,
  CAST(50 + min(p_partkey) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  CAST(max(p_partkey) AS BIGINT) AS last_seen
FROM {parts_v} GROUP BY family_key, p_type, p_brand, p_name""",
)
VIEWS["variants_v"] = (
    ("parts_v",),
    """
SELECT variant_key AS variant_id, family_key AS family_id,
  p_name || ' ' || CAST(p_size AS STRING) AS variant_name,
  CAST(60 + min(p_partkey) % 40 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  CAST(max(p_partkey) AS BIGINT) AS last_seen
FROM {parts_v} WHERE p_size % 7 <> 0 GROUP BY variant_key, family_key, p_name, p_size""",
)
VIEWS["aliases_v"] = (
    ("parts_v",),
    """
SELECT CAST(p_partkey AS STRING) AS alias_id, family_key AS family_id,
  CASE WHEN p_partkey % 2 = 0 THEN variant_key END AS variant_id,
  CASE p_partkey % 5 WHEN 0 THEN p_name || ' ' || CAST(p_size AS STRING) WHEN 1 THEN 'widget'
    WHEN 2 THEN p_brand || ' ' || p_name ELSE 'promo ' || p_name || ' serie ' || CAST(p_partkey AS STRING) END AS alias,
  'shop' AS source, CAST(55 + p_partkey % 40 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
FROM {parts_v} WHERE p_partkey % 3 <> 0""",
)
VIEWS["identifiers_v"] = (
    ("parts_v",),
    """
SELECT family_key AS family_id, CASE WHEN p_partkey % 2 = 0 THEN variant_key END AS variant_id,
  'ean' AS identifier_type, code AS identifier_value, 'shop' AS source,
  CAST(80 + p_partkey % 20 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
FROM {parts_v} WHERE p_partkey % 4 <> 0""",
)
VIEWS["spec_facts_v"] = (
    ("parts_v",),
    """
SELECT family_key AS family_id, variant_key AS variant_id, 'size' AS spec_key,
  CAST(p_size AS STRING) AS spec_value, 'shop' AS source,
  CAST(50 + p_partkey % 45 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
FROM {parts_v}
UNION ALL
SELECT family_key, variant_key, 'retail', CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING), 'shop',
  CAST(50 + p_partkey % 45 AS DOUBLE) / CAST(100 AS DOUBLE)
FROM {parts_v} WHERE p_partkey % 2 = 0""",
)
VIEWS["relations_v"] = (
    ("parts_v",),
    """
SELECT a.family_key AS subject_family, CASE WHEN a.p_partkey % 2 = 0 THEN a.variant_key END AS subject_variant,
  CASE a.p_partkey % 3 WHEN 0 THEN 'accessory_for' WHEN 1 THEN 'Compatible_With ' ELSE 'like' END AS relation_type,
  b.family_key AS object_family, CASE WHEN b.p_partkey % 3 = 0 THEN b.variant_key END AS object_variant,
  'shop' AS source, CAST(40 + a.p_partkey % 80 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  a.p_partkey AS edge_id
FROM {parts_v} AS a JOIN {parts_v} AS b ON b.p_partkey = CAST(floor(a.p_partkey / CAST(2 AS DOUBLE)) AS BIGINT)""",
)
# Web evidence for identifiers: one row per sighting, one to four sites per part.
VIEWS["evidence_v"] = (
    ("listings_v",),
    """
SELECT listing_id AS evidence_id, family_key AS family_id,
  CASE WHEN l_partkey % 2 = 0 THEN variant_key END AS variant_id,
  'web_discovery' AS evidence_type, 'identifiers' AS field_name,
  'https://www.site' || CAST(l_suppkey % (1 + l_partkey % 4) AS STRING) || '.example/p?x=1' AS source_ref,
  'found EAN: ' || code || ' for ' || p_name AS excerpt,
  CASE WHEN l_linenumber = 1 THEN 'UPC 123456789012' ELSE '' END AS value_text
FROM {listings_v}""",
)
# Web results of the verification queries: two per listing.
VIEWS["results_v"] = (
    ("listings_v",),
    """
SELECT listing_id, 1 AS position, 'Buy ' || title AS title,
  CASE WHEN l_orderkey % 3 = 0 THEN replace(url, '?ref=', '?from=') ELSE 'https://www.compare.example/' || p_name END AS url,
  p_brand || ' in stock' AS snippet
FROM {listings_v} WHERE l_orderkey % 5 <> 0
UNION ALL
SELECT listing_id, 2, p_name, 'https://www.duckduckgo.com/l?u=' || p_name, 'size ' || code
FROM {listings_v} WHERE l_orderkey % 5 > 1""",
)
# Offers as the deal rules see them.
VIEWS["offers_v"] = (
    ("lineitem", "parts_v"),
    f"""
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
    || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS BIGINT) AS STRING) AS listing_id,
  CASE l_suppkey % 4 WHEN 0 THEN 'EBAY' WHEN 1 THEN 'VINTED' WHEN 2 THEN 'SUBITO' ELSE 'WALLAPOP' END AS platform,
  CASE l_partkey % 6
    WHEN 0 THEN CAST(1 + l_linenumber % 4 AS STRING) || 'x32GB Corsair DDR4 RAM 3200MHz ' || p_name
    WHEN 1 THEN 'Memoria DDR4 16 GB x' || CAST(1 + l_linenumber % 3 AS STRING) || ' ' || p_name
    WHEN 2 THEN 'Notebook ' || p_name || ' DDR4 8GB'
    WHEN 3 THEN 'Scheda madre e RAM DDR4 32gb cl16 Kingston ' || p_name
    WHEN 4 THEN 'DDR4 banco 128GB server ' || p_brand
    ELSE p_brand || ' ' || p_name END AS title,
  CASE WHEN l_linenumber = 2 THEN 'RAM difettoso, ' || p_name ELSE 'memoria ' || p_brand END AS description,
  CAST(CAST(floor(l_extendedprice) AS BIGINT) % 300 AS DOUBLE) AS price,
  CASE WHEN l_linenumber % 2 = 0 THEN 'https://img.example/' || CAST(l_partkey AS STRING) END AS image_url,
  l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_shipdate AS DATE) AS STRING) AS seen_on
FROM {{lineitem}} JOIN {{parts_v}} ON l_partkey = p_partkey""",
)
# Saved searches in words.
VIEWS["requests_v"] = (
    ("orders",),
    """
SELECT o_orderkey AS request_id,
  CASE o_orderkey % 8
    WHEN 0 THEN 'Cerco RAM DDR4 almeno ' || CAST(8 * (1 + o_custkey % 8) AS STRING) || 'GB per desktop'
    WHEN 1 THEN 'scheda video GPU con vram oltre ' || CAST(4 * (1 + o_custkey % 6) AS STRING) || ' gb'
    WHEN 2 THEN 'trapano avvitatore Makita minimo 18 volt budget ' || CAST(o_custkey AS STRING) || ' euro'
    WHEN 3 THEN 'monitor oled 144hz o superiore'
    WHEN 4 THEN 'tavolo e sedia per la casa'
    WHEN 5 THEN 'scheda madre B550 am4 atx usato'
    WHEN 6 THEN 'gomme auto golf ' || CAST(14 + o_custkey % 6 AS STRING) || ' pollici'
    ELSE 'figurina pokemon rara ' || o_orderpriority END AS request,
  o_custkey
FROM {orders}""",
)
# Link graph of category pages: a tree of pages per site with some cross links.
VIEWS["site_links_v"] = (
    ("part",),
    """
SELECT 'site' || CAST(p_partkey % 3 AS STRING) AS source,
  'https://site.example/c/' || CAST(CAST(floor(p_partkey / CAST(2 AS DOUBLE)) AS BIGINT) AS STRING) AS parent_url,
  p_name AS label, 'https://site.example/c/' || CAST(p_partkey AS STRING) AS url
FROM {part} WHERE p_partkey > 1
UNION ALL
SELECT 'site' || CAST(p_partkey % 3 AS STRING), 'https://site.example/c/' || CAST(p_partkey AS STRING),
  p_name, 'https://site.example/c/' || CAST(1 + p_partkey % 97 AS STRING)
FROM {part} WHERE p_partkey % 5 = 0""",
)

# How Spark builds a view where its rows repeat work of a smaller table: a title is one of its part's, so it is
# written once for each part and met by the sightings. Same columns and rows as the view of that name.
SHARED: dict[str, tuple[tuple[str, ...], str]] = {
    "titled_parts_v": (("parts_v",), f"SELECT *, {_TITLE.replace('l_partkey', 'p_partkey')} AS p_title FROM {{parts_v}}"),
    "listings_v": (("lineitem", "titled_parts_v", "supplier", "nation"), _listings("p_title", "titled_parts_v")),
}
