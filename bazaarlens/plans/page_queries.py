"""Registered queries: pages, payloads, crawl plans, saved searches and multilingual rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.core import barrier, round_to
from bazaarlens.operators import crawl, multilingual, pages, requests
from bazaarlens.operators.distinct import once_per, spread
from bazaarlens.plans.registry import Inputs, query
from bazaarlens.plans.text_queries import NORM_KEEP
from bazaarlens.rules import requests as request_rules
from bazaarlens.rules import taxonomy
from bazaarlens.rules.categories import AUTHORITATIVE_SOURCES, CATEGORY_TREE, COMMON_TERMS, DEFAULT_AUTHORITATIVE_SOURCES
from bazaarlens.rules.sources import SOURCES
from bazaarlens.sources import dimensions, payloads, tables


@query("page_anchors")
def page_anchors(v: Inputs) -> DataFrame:
    return pages.anchors(v("pages")).select("page_id", "position", "href", "url", "label", "parent")


# Product pages built from the part table: one page per part.
PRODUCT_PAGES = """
SELECT p_partkey AS page_id, 'https://shop.example.it/list/page?cat=' || p_type || '&page=2' AS url,
'<html><head><script type="application/ld+json">{"@type":"Product","name":"' || p_name || '","offers":[{"price":"' || euro || ',50","priceCurrency":"EUR"}],"url":"/p/' || CAST(p_partkey AS STRING) || '"}</script>'
|| '<script type="application/ld+json">{"@graph":[{"@type":["Offer","x"],"title":"graph ' || p_name || '","offers":{"lowPrice":7}},{"@type":"WebSite","name":"no"}]}</script></head><body>'
|| '<nav><a href="/c/laptop">Laptop</a><a href="/login">Login</a><a href="https://other.example.com/c/x">Elsewhere</a><a href="/c/laptop/">Laptop again</a><a href="/electronics/audio">Audio electronics</a></nav>'
|| '<div><a href="/item/' || replace(p_name, ' ', '-') || '">' || p_brand || ' ' || p_name || '</a><span>' || euro || ' EUR</span></div>'
|| '<p><a href="?cat=' || p_type || '&amp;page=3">3</a> <a href="?cat=' || p_type || '&amp;page=1">1</a> <a href="?cat=other&amp;page=4">4</a> <a href="?page=5&amp;cat=' || p_type || '">next</a></p></body></html>' AS html
FROM {parts_v}"""


def with_json(sql: str) -> str:
    """SQL text whose only placeholder is parts_v; its other braces are JSON."""
    return sql.replace("{", "{{").replace("}", "}}").replace("{{parts_v}}", "{parts_v}")


def _product_pages(v: Inputs) -> DataFrame:
    return v.spark.sql(with_json(PRODUCT_PAGES), parts_v=spread(v("parts_v")))


@query(
    "jsonld_products",
    ["parts_v"],
    """SELECT p_partkey AS page_id, p_name AS title, CAST(euro AS DOUBLE) + 0.5 AS price, 'EUR' AS currency, 'https://shop.example.it/p/' || CAST(p_partkey AS VARCHAR) AS url FROM parts_v
UNION ALL SELECT p_partkey, 'graph ' || p_name, 7.0::DOUBLE, '', 'https://shop.example.it/list/page?cat=' || p_type || '&page=2' FROM parts_v""",
)
def jsonld_products(v: Inputs) -> DataFrame:
    return pages.jsonld_products(_product_pages(v)).select("page_id", "title", "price", "currency", "url")


@query(
    "listing_cards",
    ["parts_v"],
    """SELECT p_partkey AS page_id, p_name AS title, 'jsonld' AS reason, CAST(euro AS DOUBLE) + 0.5 AS price FROM parts_v
UNION ALL SELECT p_partkey, 'graph ' || p_name, 'jsonld', 7.0::DOUBLE FROM parts_v
UNION ALL SELECT p_partkey, p_brand || ' ' || p_name, 'price_card', CAST(euro AS DOUBLE) FROM parts_v""",
)
def listing_cards(v: Inputs) -> DataFrame:
    return pages.listing_cards(_product_pages(v), F.lit("shop")).select("page_id", "title", "reason", "price")


@query(
    "category_links",
    ["parts_v"],
    """SELECT p_partkey AS page_id, 'Laptop' AS label, 'https://shop.example.it/c/laptop' AS url FROM parts_v
UNION ALL SELECT p_partkey, 'Audio electronics', 'https://shop.example.it/electronics/audio' FROM parts_v""",
)
def category_links(v: Inputs) -> DataFrame:
    return pages.category_links(_product_pages(v), F.lit("shop")).select("page_id", "label", "url")


@query("extract_links")
def extract_links(v: Inputs) -> DataFrame:
    """Every link of the pages, whether it looks like a category, and how interesting it is."""
    links = pages.anchors(v("pages"))
    return links.select(
        "page_id", "position", "url", "label",
        pages.looks_like_category(F.col("url"), F.col("label"), F.col("parent")).alias("category"),
        pages.category_interest(F.lit("web"), F.col("label"), F.col("url"), F.col("label"), "general").alias("interest"),
    )


@query(
    "pagination_links",
    ["parts_v"],
    """SELECT p_partkey AS page_id, 'https://shop.example.it/list/page?cat=' || p_type || '&page=3' AS url, 3 AS page FROM parts_v
UNION ALL SELECT p_partkey, 'https://shop.example.it/list/page?page=5&cat=' || p_type, 5 FROM parts_v""",
)
def pagination_links(v: Inputs) -> DataFrame:
    return pages.pagination_links(_product_pages(v)).select("page_id", "url", "page")


@query(
    "category_frontier",
    ["site_links_v"],
    """WITH RECURSIVE roots AS (SELECT DISTINCT source, 'https://site.example/c/1' AS url FROM site_links_v),
walk(source, url, depth) AS (SELECT source, url, 0 FROM roots UNION SELECT l.source, l.url, w.depth + 1 FROM walk w JOIN site_links_v l ON l.source = w.source AND l.parent_url = w.url WHERE w.depth < 6),
best AS (SELECT source, url, min(depth) AS depth FROM walk GROUP BY 1, 2)
SELECT source, url, CAST(depth AS INTEGER) AS depth FROM best WHERE depth > 0""",
)
def category_frontier(v: Inputs) -> DataFrame:
    links = v("site_links_v")
    roots = links.select("source", F.lit("https://site.example/c/1").alias("url")).distinct()
    return pages.discover_categories(links, roots, max_depth=6).select("source", "url", "depth")


PAYLOAD_ROWS = """
SELECT p_partkey, p_partkey % 97 AS response_id, p_partkey AS position, CASE p_partkey % 3 WHEN 0 THEN 'ebay' WHEN 1 THEN 'subito' ELSE 'vinted' END AS platform_key,
CASE p_partkey % 3
 WHEN 0 THEN '{"itemId":"' || CAST(p_partkey % 50 AS STRING) || '","title":"' || p_name || '","itemWebUrl":"https://e.example/' || CAST(p_partkey AS STRING) || '","price":{"value":"' || euro || '"},"condition":"Used","itemLocation":{"city":"Rome","country":"IT"},"buyingOptions":["FIXED","BID"],"shippingOptions":[{"shippingCost":{"value":"5","currency":"EUR"}}]}'
 WHEN 1 THEN '{"urn":"u' || CAST(p_partkey AS STRING) || '","subject":"' || p_name || '","urls":{"default":"/x-' || CAST(p_partkey AS STRING) || '.htm?z=1"},"features":{"/price":{"values":[{"key":"' || euro || ',5"}]},"/item_shippable":{"values":[{"value":"1"}]}},"geo":{"town":{"value":"Bari"},"city":{"shortName":"BA"}},"sold":' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || '}'
 ELSE '{"item":{"id":' || CAST(p_partkey AS STRING) || ',"title":"' || p_name || '","description":"d","price":{"amount":"' || euro || '.25"},"photos":[{"url":"http://i/1"}]}}' END AS raw_json
FROM {parts_v}"""


@query(
    "normalize_payloads",
    ["parts_v"],
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY p_partkey % 97, p_partkey % 50 ORDER BY p_partkey) AS rn FROM parts_v WHERE p_partkey % 3 = 0)
SELECT 'EBAY' AS platform, 'ebay_' || CAST(p_partkey % 50 AS VARCHAR) AS id, p_name AS title, CAST(euro AS DOUBLE) AS price, 'https://e.example/' || CAST(p_partkey AS VARCHAR) AS url, 'Used | Rome, IT | FIXED/BID | spedizione 5 EUR' AS extra_info FROM e WHERE rn = 1
UNION ALL SELECT 'SUBITO', 'subito_u' || CAST(p_partkey AS VARCHAR), p_name, CAST(euro AS DOUBLE) + 0.5, 'https://www.subito.it/x-' || CAST(p_partkey AS VARCHAR) || '.htm', 'Bari (BA) | Spedizione disponibile' FROM parts_v WHERE p_partkey % 3 = 1 AND p_partkey % 2 <> 0
UNION ALL SELECT 'VINTED', 'vinted_' || CAST(p_partkey AS VARCHAR), p_name, CAST(euro AS DOUBLE) + 0.25, 'https://www.vinted.it/items/' || CAST(p_partkey AS VARCHAR), '' FROM parts_v WHERE p_partkey % 3 = 2""",
)
def normalize_payloads(v: Inputs) -> DataFrame:
    rows = v.spark.sql(with_json(PAYLOAD_ROWS), parts_v=v("parts_v"))
    return payloads.normalize_payloads(rows).select("platform", "id", "title", "price", "url", "extra_info")


@query(
    "embedded_items",
    ["parts_v"],
    """SELECT p_partkey AS page_id, p_name AS subject FROM parts_v UNION ALL SELECT p_partkey, p_brand FROM parts_v WHERE p_partkey % 2 = 1""",
)
def embedded_items(v: Inputs) -> DataFrame:
    item = lambda c: F.concat(F.lit('{"subject":"'), c, F.lit('","url":"/a","price":1}'))
    listed = F.concat(
        F.lit('{"props":{"pageProps":{"initialState":{"items":{"list":[{"item":'), item(F.col("p_name")), F.lit('},{"ad":1}]}}}}}')
    )
    nested = F.concat(F.lit('{"a":[{"b":'), item(F.col("p_name")), F.lit('},{"c":{"d":['), item(F.col("p_brand")), F.lit("]}}]}"))
    state = F.when(F.col("p_partkey") % 2 == 0, listed).otherwise(nested)
    built = v("parts_v").select(
        F.col("p_partkey").alias("page_id"),
        F.lit("https://x.example/").alias("url"),
        F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script></html>")).alias("html"),
    )
    return payloads.embedded_items(built).select("page_id", F.get_json_object("raw_json", "$.subject").alias("subject"))


@query(
    "knowledge_import",
    ["parts_v"],
    """SELECT 'families' AS area, CAST(count(*) AS BIGINT) AS n FROM parts_v UNION ALL SELECT 'variants', CAST(count(*) AS BIGINT) FROM parts_v
UNION ALL SELECT 'aliases', CAST(3 * count(*) AS BIGINT) FROM parts_v UNION ALL SELECT 'identifiers', CAST(count(*) AS BIGINT) FROM parts_v
UNION ALL SELECT 'spec_facts', CAST(count(*) AS BIGINT) FROM parts_v UNION ALL SELECT 'evidence', CAST(count(*) AS BIGINT) FROM parts_v
UNION ALL SELECT 'relations', CAST(count(*) AS BIGINT) FROM parts_v""",
)
def knowledge_import(v: Inputs) -> DataFrame:
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    document = F.concat(
        F.lit('{"source":{"key":"m"},"products":[{"family_key":'), quote("family_key"), F.lit(',"category":'), quote("p_type"),
        F.lit(',"family_name":'), quote("p_name"), F.lit(',"confidence":0.9,"aliases":[{"value":'), quote("p_name"),
        F.lit(',"confidence":0.99},"plain"],"variants":[{"variant_key":'), quote("variant_key"),
        F.lit(',"variant_name":"v","aliases":["short"],"identifiers":[{"type":"ean","value":'), quote("code"),
        F.lit('}],"specs":[{"key":"size","value":'), F.col("p_size").cast("string"),
        F.lit('}],"evidence":[{"type":"t","field":"size","value":1}]}]}],"relations":[{"subject":{"family_key":'),
        quote("family_key"), F.lit('},"type":"requires","object":{"family_key":"x"}}]}'),
    )
    documents = v("parts_v").select(F.from_json(document, tables.IMPORT_SCHEMA).alias("d")).select("d.*")
    parts = tables.split_knowledge(documents)
    from bazaarlens.operators.catalog import catalog_summary

    return catalog_summary(parts)


# Crawl plans ---------------------------------------------------------------------------------

SOURCE_VALUES = ", ".join(
    f"('{name}', '{group}', '{status}', {login}, '{' '.join(templates)}')" for name, _, group, _, status, login, templates in SOURCES
)
NODE_VALUES = ", ".join(
    f"('{key}', '{'|'.join(keywords)}')" for key, _, _, _, _, keywords in CATEGORY_TREE
)


@query(
    "crawl_plan_load",
    [],
    f"""WITH s(name, grp, status, login, t) AS (VALUES {SOURCE_VALUES}), c(key, k) AS (VALUES {NODE_VALUES}),
plan AS (SELECT DISTINCT name, key, lower(q) AS q, u FROM (SELECT name, unnest(string_split(t, ' ')) AS u FROM s WHERE status = 'experimental' AND t <> '') x,
  (SELECT key, unnest(string_split(k, '|')[1:6]) AS q FROM c WHERE key <> 'unknown') y WHERE q <> ''),
per AS (SELECT key, CAST(count(*) AS BIGINT) AS tasks FROM plan GROUP BY key),
used AS (SELECT normalized_category AS key, count(*) AS n FROM cleaning_v WHERE normalized_category IS NOT NULL GROUP BY 1)
SELECT key AS category_key, tasks, CAST(n AS BIGINT) AS listings FROM used JOIN per USING (key)""".replace("FROM cleaning_v", "FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'technology_gpu' WHEN 1 THEN 'toys_lego' WHEN 2 THEN 'home_decor' ELSE 'unknown' END AS normalized_category FROM part) z"),
)
def crawl_plan_load(v: Inputs) -> DataFrame:
    """Crawl tasks of each category that listings fall into, beside their number."""
    plan = crawl.build_crawl_plan(crawl.crawl_sources(crawl.registry(v.spark)), dimensions.category_tree(v.spark))
    tasks = plan.groupBy("category_key").agg(F.count(F.lit(1)).alias("tasks"))
    kind = F.col("p_size") % 4
    used = v("part").select(
        F.when(kind == 0, "technology_gpu").when(kind == 1, "toys_lego").when(kind == 2, "home_decor").otherwise("unknown").alias("category_key")
    )
    return used.groupBy("category_key").agg(F.count(F.lit(1)).alias("listings")).join(F.broadcast(tasks), "category_key")


@query(
    "market_policy",
    [],
    """WITH m AS (SELECT n_name, CASE n_nationkey % 6 WHEN 0 THEN 'subito' WHEN 1 THEN 'backmarket' WHEN 2 THEN 'swappie' WHEN 3 THEN 'olx_pl' WHEN 4 THEN 'vinted' ELSE 'amazon' END AS source FROM nation)
SELECT n_name, source, CASE source WHEN 'subito' THEN 'target_market_classifieds_candidate' WHEN 'vinted' THEN 'target_market_classifieds_candidate' WHEN 'olx_pl' THEN 'foreign_classifieds_catalog_only'
  ELSE 'target_market_retail_or_catalog_candidate' END AS scope, source <> 'olx_pl' AS deal_candidate FROM m""",
)
def market_policy(v: Inputs) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("subito", "backmarket", "swappie", "olx_pl", "vinted", "amazon")])
    sources = v("nation").select("n_name", F.get(names, F.col("n_nationkey") % 6).alias("source"))
    policy = crawl.market_policy(crawl.list_sources(crawl.registry(v.spark)))
    return sources.join(F.broadcast(policy), "source").select("n_name", "source", "scope", "deal_candidate")


COMMON_VALUES = ", ".join(f"('{c}', '{' '.join(t).replace(chr(39), chr(39) * 2)}')" for c, t in COMMON_TERMS.items())
TRUSTED_VALUES = ", ".join(f"('{c}', '{' '.join(t)}')" for c, t in AUTHORITATIVE_SOURCES.items())


@query(
    "category_terms",
    ["cleaning_v"],
    f"""WITH t(category, terms) AS (VALUES {COMMON_VALUES}), a(category, names) AS (VALUES {TRUSTED_VALUES})
SELECT c.listing_id, c.normalized_category AS category, coalesce(t.terms, '') AS terms, coalesce(a.names, '{' '.join(DEFAULT_AUTHORITATIVE_SOURCES)}') AS sources
FROM cleaning_v c LEFT JOIN t ON t.category = c.normalized_category LEFT JOIN a ON a.category = c.normalized_category WHERE c.normalized_category IS NOT NULL""",
)
def category_terms(v: Inputs) -> DataFrame:
    rows = v("cleaning_v").where("normalized_category IS NOT NULL").select(
        "listing_id", F.col("normalized_category").alias("category")
    )
    rows = crawl.with_defaults(rows, dimensions.common_terms(v.spark), "terms", [])
    rows = crawl.with_defaults(
        rows, dimensions.authoritative_sources(v.spark), "sources", list(DEFAULT_AUTHORITATIVE_SOURCES)
    )
    return rows.select("listing_id", "category", F.array_join("terms", " ").alias("terms"), F.array_join("sources", " ").alias("sources"))


# Saved searches ------------------------------------------------------------------------------

REQ = "trim(regexp_replace(replace(lower(request), '×', 'x'), '\\s+', ' ', 'g'))"
DOMAIN_SCORES = []
for _i, (_name, _weight, _words) in enumerate(request_rules.DOMAINS):
    _hits = " + ".join(f"CASE WHEN contains(t, '{w}') THEN {_weight} ELSE 0 END" for w in _words)
    DOMAIN_SCORES.append(f"({_hits or 1})")
DOMAIN_SQL = f"""d AS (SELECT request_id, {REQ} AS t FROM requests_v), e AS (SELECT *, {', '.join(f'{s} AS s{i}' for i, s in enumerate(DOMAIN_SCORES))} FROM d),
f AS (SELECT request_id, t, s0, s1, s2 + CASE WHEN s0 >= 4 THEN 1 ELSE 0 END + CASE WHEN s1 >= 4 THEN 1 ELSE 0 END AS s2, {', '.join(f's{i}' for i in range(3, 11))} FROM e),
g AS (SELECT *, greatest({', '.join(f's{i}' for i in range(11))}) AS top FROM f)"""


@query(
    "request_domain",
    ["requests_v"],
    f"""WITH {DOMAIN_SQL} SELECT request_id, CASE {' '.join(f"WHEN s{i} = top THEN '{row[0]}'" for i, row in enumerate(request_rules.DOMAINS))} END AS domain FROM g""",
)
def request_domain(v: Inputs) -> DataFrame:
    return v("requests_v").select("request_id", requests.request_domain(F.col("request")).alias("domain"))


@query("request_profile")
def request_profile(v: Inputs) -> DataFrame:
    rows = v("requests_v").withColumn("profile", requests.source_profile(F.col("request")))
    return rows.select("request_id", "profile", requests.subject_key(F.col("request"), F.col("profile")).alias("subject"))


@query("profile_terms")
def profile_terms(v: Inputs) -> DataFrame:
    return v("requests_v").select("request_id", F.explode(requests.profile_terms(F.col("request"))).alias("term"))


@query(
    "learned_profiles",
    ["requests_v"],
    """WITH r AS (SELECT request_id, lower(request) AS t FROM requests_v),
s AS (SELECT request_id, 'ram' AS profile, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])ddr4($|[^a-z0-9])') THEN 2 ELSE 0 END + CASE WHEN contains(t, 'ram ddr4') THEN 4 ELSE 0 END AS score FROM r
UNION ALL SELECT request_id, 'board', CASE WHEN contains(t, 'scheda madre') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '(^|[^a-z0-9])b550($|[^a-z0-9])') THEN 2 ELSE 0 END FROM r
UNION ALL SELECT request_id, 'cards', CASE WHEN regexp_matches(t, '(^|[^a-z0-9])pokemon($|[^a-z0-9])') THEN 2 ELSE 0 END FROM r)
SELECT request_id, profile, CAST(score AS BIGINT) AS score FROM s WHERE score >= 4""",
)
def learned_profiles(v: Inputs) -> DataFrame:
    profiles = v.spark.createDataFrame(
        [("ram", 0, ["ddr4", "ram ddr4"]), ("board", 1, ["scheda madre", "b550"]), ("cards", 2, ["pokemon"])],
        "profile string, position int, terms array<string>",
    )
    return requests.match_learned_profile(v("requests_v"), profiles)


@query(
    "source_learning",
    ["results_v"],
    """WITH s AS (SELECT CASE WHEN length(title) % 2 = 0 THEN 'a' ELSE 'b' END AS profile, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS site FROM results_v),
f AS (SELECT DISTINCT profile, site FROM s WHERE site NOT IN ('', 'duckduckgo.com')),
k AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY site) AS rank FROM f)
SELECT profile, site, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 8""",
)
def source_learning(v: Inputs) -> DataFrame:
    profile = F.when(F.length("title") % 2 == 0, "a").otherwise("b")
    rows = v("results_v").select(profile.alias("profile"), F.lit(1).alias("position"), "url")
    return requests.source_learning(rows).select("profile", "site", "rank")


# Multilingual --------------------------------------------------------------------------------

ALIAS_VALUES = ", ".join(
    f"({i}, '{c}', '{a}')" for i, (a, c) in enumerate(multilingual._alias_table(taxonomy.TAXONOMY).items())
)
TAXONOMY_SQL = f"""a(i, canonical, alias) AS (VALUES {ALIAS_VALUES}),
h AS (SELECT l_partkey, title, ' ' || {NORM_KEEP.format('title')} || ' ' AS hay FROM (SELECT DISTINCT l_partkey, title FROM listings_v)),
p AS (SELECT l_partkey, title, i, canonical, CASE WHEN contains(hay, ' ' || alias || ' ') THEN 4 WHEN length(alias) >= 5 AND contains(hay, alias) THEN 2
  WHEN alias IN ('gpu', 'ssd', 'ram') AND regexp_matches(hay, '\\b' || alias || '\\b') THEN 3 ELSE 0 END AS s FROM h JOIN a ON contains(hay, alias)),
q AS (SELECT l_partkey, title, canonical, sum(s) AS score, min(i) AS early FROM p WHERE s > 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, title ORDER BY score DESC, early) AS rn FROM q)"""


@query(
    "detect_taxonomy",
    ["listings_v"],
    f"WITH {TAXONOMY_SQL} SELECT l_partkey, title, canonical, CAST(score AS INTEGER) AS score FROM k WHERE rn = 1",
)
def detect_taxonomy(v: Inputs) -> DataFrame:
    rows = v("listings_v").select("l_partkey", "title").distinct()
    found = once_per(rows, ["title"], lambda titles: titles.withColumn("t", barrier(multilingual.detect_taxonomy("title"))))
    return found.where("t.canonical IS NOT NULL").select("l_partkey", "title", "t.canonical", "t.score")


def _multilingual(v: Inputs) -> DataFrame:
    rows = v("listings_v").select(
        "listing_id", "title", "category", "description", F.lit("").alias("resolved_title"),
        F.when(F.col("l_suppkey") % 2 == 0, "vinted").otherwise("other").alias("source"),
    )
    return multilingual.normalize_multilingual(rows)


@query("normalize_multilingual")
def normalize_multilingual(v: Inputs) -> DataFrame:
    return _multilingual(v).select(
        "listing_id", "language_detected", "category_canonical", "category_family", "product_type_canonical",
        "brand", "model", "title_it_hint", "title_en_hint", "title_search_normalized",
        round_to(F.col("confidence"), 3).alias("confidence"),
    )


@query("merge_external")
def merge_external(v: Inputs) -> DataFrame:
    external = v("ai_reviews_v").where("status = 'resolved'").select(
        "listing_id", F.col("canonical_category").alias("category_canonical"), F.col("canonical_brand").alias("brand"), "confidence"
    )
    return multilingual.merge_external(_multilingual(v), external).select(
        "listing_id", "method", "category_canonical", "brand", "model", "confidence"
    )


