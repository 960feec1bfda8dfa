"""Registered queries: text, price, identifier, category and language functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import classify, identifiers, language, numbers, specs, text, titles, urls
from bazaarlens.functions.core import barrier, let, round_to
from bazaarlens.operators import promotion
from bazaarlens.operators.distinct import once_per
from bazaarlens.plans.fixtures import sql_round
from bazaarlens.plans.registry import Inputs, query
from bazaarlens.plans.resolver_queries import condition_sql, norm_sql, tokens_sql
from bazaarlens.rules.categories import CATEGORY_FALLBACKS, CATEGORY_RULES, INFER_RULES, MONITOR_PATTERN
from bazaarlens.rules.languages import LANGUAGE_HINTS, LANGUAGE_LETTERS
from bazaarlens.rules.words import (
    APPLE_LINES, BRAND_LINES, CAPITAL_BRANDS, CATALOG_BRANDS, EVIDENCE_STOPWORDS, LISTING_BRANDS,
)

L = ["listings_v"]


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def like(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '(?i){quoted(pattern)}')"


def case_sql(rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{value}'" for test, value in rules) + f" ELSE {otherwise} END"


def per_title(v: Inputs, *columns: Column) -> DataFrame:
    return v("listings_v").select("listing_id", *columns)


def joined(values: Column) -> Column:
    return F.array_join(F.transform(values, numbers.number_text), ",")


@query(
    "normalize_text",
    [],
    "SELECT doc_id, md5(regexp_replace(lower(nfc_normalize(text)), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents",
)
def normalize_text(v: Inputs) -> DataFrame:
    return v("documents").select("doc_id", F.md5(text.normalize_text("text").cast("binary")).alias("digest"))


@query("normalize_product_text", [], f"SELECT doc_id, md5({norm_sql('text')}) AS digest FROM documents")
def normalize_product_text(v: Inputs) -> DataFrame:
    return v("documents").select("doc_id", F.md5(text.normalize_product_text("text").cast("binary")).alias("digest"))


@query(
    "token_signature",
    [],
    f"SELECT doc_id, md5(array_to_string({tokens_sql(norm_sql('text'))}, ' ')) AS digest FROM documents",
)
def token_signature(v: Inputs) -> DataFrame:
    return v("documents").select("doc_id", F.md5(text.token_signature("text").cast("binary")).alias("digest"))


NORM_KEEP = "trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({}, ''))), '[^a-z0-9+._\\- ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("norm_text", [], f"SELECT conv_id, turn, md5({NORM_KEEP.format('text')}) AS digest FROM conversations")
def norm_text(v: Inputs) -> DataFrame:
    return v("conversations").select("conv_id", "turn", F.md5(text.norm_text("text").cast("binary")).alias("digest"))


@query(
    "text_keys",
    L,
    """SELECT listing_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') AS text_key,
  trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS comparison FROM listings_v""",
)
def text_keys(v: Inputs) -> DataFrame:
    return per_title(v, text.text_key("title").alias("text_key"), text.comparison_text("title").alias("comparison"))


@query(
    "url_parts",
    L,
    """SELECT listing_id, regexp_replace(url, '[?#].*$', '') AS normalized_url, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\\.', '') AS host,
  CASE regexp_extract(url, '\\.([a-z]+)/', 1) WHEN 'it' THEN 'IT' WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' ELSE '' END AS country,
  sha1(source || '|' || external_id) AS fingerprint,
  sha1(source || '|' || regexp_replace(url, '[?#].*$', '')) AS url_fingerprint,
  regexp_matches(url, '/item/') AS product_url, regexp_matches(url, '/category') AND NOT regexp_matches(url, '/item/') AS nav_url FROM listings_v""",
)
def url_parts(v: Inputs) -> DataFrame:
    parts = [F.col(c) for c in ("url", "title", "price", "location")]
    return per_title(
        v,
        urls.normalized_url("url").alias("normalized_url"),
        urls.host("url").alias("host"),
        urls.country_hint("url").alias("country"),
        urls.listing_fingerprint(F.col("source"), F.col("external_id"), *parts).alias("fingerprint"),
        urls.listing_fingerprint(F.col("source"), F.lit(""), *parts).alias("url_fingerprint"),
        urls.is_product_url("url").alias("product_url"),
        urls.is_nav_url("url").alias("nav_url"),
    )


@query(
    "localized_numbers",
    L,
    """WITH s AS (SELECT listing_id, CASE l_linenumber % 4 WHEN 0 THEN '1.' || CAST(100 + l_suppkey % 800 AS VARCHAR) || ',5' WHEN 1 THEN '2,' || CAST(100 + l_suppkey % 800 AS VARCHAR) || '.25'
  WHEN 2 THEN CAST(l_suppkey AS VARCHAR) || '.500' ELSE CAST(l_suppkey AS VARCHAR) || ',75' END AS t, l_suppkey AS k, l_linenumber % 4 AS m FROM listings_v)
SELECT listing_id, CASE m WHEN 0 THEN 1000 + 100 + k % 800 + 0.5::DOUBLE WHEN 1 THEN 2000 + 100 + k % 800 + 0.25::DOUBLE WHEN 2 THEN k * 1000 + 500::DOUBLE ELSE k + 0.75::DOUBLE END AS value FROM s""",
)
def localized_numbers(v: Inputs) -> DataFrame:
    sized = (100 + F.col("l_suppkey") % 800).cast("string")
    own, turn = F.col("l_suppkey").cast("string"), F.col("l_linenumber") % 4
    written = (
        F.when(turn == 0, F.concat(F.lit("1."), sized, F.lit(",5")))
        .when(turn == 1, F.concat(F.lit("2,"), sized, F.lit(".25")))
        .when(turn == 2, F.concat(own, F.lit(".500")))
        .otherwise(F.concat(own, F.lit(",75")))
    )
    return per_title(v, numbers.parse_localized_number(written).alias("value"))


PRICE_SQL = f"""p AS (SELECT *, regexp_extract_all(title, '(?i){numbers.PRICE_PATTERN}', 1) AS a, regexp_extract_all(title, '(?i){numbers.PRICE_PATTERN}', 2) AS b,
  regexp_extract_all(title, '(?i){numbers.PRICE_PATTERN}', 3) AS c FROM t),
q AS (SELECT listing_id, list_filter([{{'v': CAST(CASE WHEN regexp_matches(b[i], ',[0-9]{{1,2}}$') THEN replace(b[i], ',', '.') WHEN regexp_matches(b[i], '\\.[0-9]{{3}}$') THEN replace(b[i], '.', '') ELSE b[i] END AS DOUBLE),
  'm': lower(coalesce(nullif(a[i], ''), c[i]))}} FOR i IN range(1, len(b) + 1)], lambda x: x.m <> '') AS found FROM p),
r AS (SELECT listing_id, coalesce(list_filter(found, lambda x: x.v > 5)[1], found[1]) AS best FROM q)"""


@query(
    "parse_price",
    L,
    f"""WITH t AS (SELECT listing_id, title || ' da ' || CAST(l_suppkey AS VARCHAR) || ' eur' AS title FROM listings_v), {PRICE_SQL}
SELECT listing_id, best.v AS value, CASE WHEN best IS NULL THEN '' WHEN best.m IN ('€', 'eur', 'euro') THEN 'EUR' WHEN best.m = 'chf' THEN 'CHF' WHEN best.m IN ('£', 'gbp') THEN 'GBP' ELSE 'USD' END AS currency FROM r""",
)
def parse_price(v: Inputs) -> DataFrame:
    shown = F.concat("title", F.lit(" da "), F.col("l_suppkey").cast("string"), F.lit(" eur"))
    return per_title(v, numbers.parse_price(shown).alias("p")).select("listing_id", "p.value", "p.currency")


@query(
    "bot_price",
    L,
    """SELECT listing_id, coalesce(TRY_CAST(replace(coalesce(nullif(regexp_extract(title, '([0-9]{1,6}(?:[.,][0-9]{1,2})?)\\s*€', 1), ''),
  nullif(regexp_extract(title, '€\\s*([0-9]{1,6}(?:[.,][0-9]{1,2})?)', 1), ''), nullif(regexp_extract(title, '([0-9]+(?:[.,][0-9]+)?)', 1), '')), ',', '.') AS DOUBLE), 999::DOUBLE) AS value FROM listings_v""",
)
def bot_price(v: Inputs) -> DataFrame:
    return per_title(v, numbers.parse_bot_price("title").alias("value"))


@query(
    "gtin_check",
    ["parts_v"],
    """SELECT p_partkey, len(c) IN (8, 12, 13, 14) AND list_sum([CAST(lpad(c, 14, '0')[i] AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END FOR i IN range(1, 15)]) % 10 = 0 AS valid
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(CAST(code AS BIGINT) + 1 AS VARCHAR) WHEN p_partkey % 3 = 1 THEN code ELSE code[6:] END AS c FROM parts_v)""",
)
def gtin_check(v: Inputs) -> DataFrame:
    code = (
        F.when(F.col("p_partkey") % 3 == 0, (F.col("code").cast("long") + 1).cast("string"))
        .when(F.col("p_partkey") % 3 == 1, F.col("code"))
        .otherwise(F.substring("code", 6, 8))
    )
    return v("parts_v").select("p_partkey", identifiers.is_valid_gtin(code).alias("valid"))


@query("extract_identifiers")
def extract_identifiers(v: Inputs) -> DataFrame:
    return per_title(v, F.explode(identifiers.extract_identifiers("title")).alias("i")).select("listing_id", "i.*")


CUR = numbers.CURRENCY
CANONICAL_SQL = f"""trim(regexp_replace(title, '\\s+', ' ', 'g'))"""
for _pattern, _new in (
    (titles.MARKETING_STARTS, ""),
    (rf"\b[0-5][,.][0-9]\s*((?:{CUR})\s*\d|\d{{2,}}[,.]?\d*\s*(?:{CUR}))", " \\1"),
    (titles.PRICE_AFTER_MARK, " "), (titles.PRICE_BEFORE_MARK, " "), (titles.CONDITION_TAG, " "),
    (titles.MARKETING_WORDS, " "), (titles.RATING_WORDS, " "),
):
    CANONICAL_SQL = f"regexp_replace({CANONICAL_SQL}, '(?i){quoted(_pattern)}', '{_new}', 'g')"
CANONICAL_SQL = f"trim(trim(regexp_replace({CANONICAL_SQL}, '\\s+', ' ', 'g')), ' -|·')"
CANONICAL_SQL = f"trim(regexp_replace({CANONICAL_SQL}, '{titles.TRAILING_NUMBERS}', ''), ' -|·')"


@query("canonicalize_title", L, f"SELECT listing_id, {CANONICAL_SQL} AS canonical FROM listings_v")
def canonicalize_title(v: Inputs) -> DataFrame:
    return per_title(v, titles.canonicalize_title("title").alias("canonical"))


def category_sql(title: str, fallback: str) -> str:
    hay = f"(lower({title}) || ' ' || lower(trim({fallback})))"
    known = case_sql([(f"lower(trim({fallback})) = '{k}'", c) for k, c in CATEGORY_FALLBACKS.items()], f"coalesce(nullif({fallback}, ''), 'unknown')")
    return case_sql([(like(hay, p), c) for p, c in CATEGORY_RULES], known)


@query(
    "canonical_category",
    L,
    f"SELECT listing_id, {category_sql('title', 'category')} AS category FROM listings_v",
)
def canonical_category(v: Inputs) -> DataFrame:
    named = once_per(
        v("listings_v").select("listing_id", "title", "category"), ["title", "category"],
        lambda rows: rows.select("_once", barrier(classify.canonical_category("title", "category")).alias("category")),
    )
    return named.select("listing_id", "category")


@query(
    "canonicalize_product",
    L,
    f"""WITH c AS (SELECT *, {CANONICAL_SQL} AS clean FROM listings_v), d AS (SELECT *, {category_sql('clean', 'category')} AS ck FROM c)
SELECT listing_id, clean AS title, ck AS category, concat_ws(',', CASE WHEN clean <> trim(title) THEN 'title_canonicalized' END,
  CASE WHEN length(clean) < 4 THEN 'short_canonical_title' END, CASE WHEN ck <> category THEN 'category_canonicalized' END) AS warnings FROM d""",
)
def canonicalize_product(v: Inputs) -> DataFrame:
    rows = per_title(v, classify.canonicalize_product("title", "category").alias("p"))
    return rows.select("listing_id", "p.title", "p.category", F.array_join("p.warnings", ",").alias("warnings"))


@query(
    "valid_category_key",
    L,
    """SELECT category, CASE category WHEN 'Accessori' THEN 'technology_accessory' WHEN 'technology_smartphone' THEN 'technology_smartphone' WHEN 'laptop' THEN 'technology_laptop'
  WHEN 'unknown' THEN '' WHEN 'technology_phone' THEN 'technology_smartphone' ELSE 'home_furniture_table' END AS key, CAST(count(*) AS BIGINT) AS n FROM listings_v GROUP BY 1, 2""",
)
def valid_category_key(v: Inputs) -> DataFrame:
    return v("listings_v").groupBy("category", classify.valid_category_key("category").alias("key")).agg(
        F.count(F.lit(1)).alias("n")
    )


def numbers_sql(c: str, pattern: str) -> str:
    found = f"list_sort(list_distinct(list_transform(regexp_extract_all({c}, '{pattern}', 1), lambda x: CAST(replace(x, ',', '.') AS DOUBLE))))"
    return f"array_to_string(list_transform({found}, lambda x: regexp_replace(CAST(x AS VARCHAR), '\\.0$', '')), ',')"


@query(
    "extract_specs",
    L,
    f"""WITH t AS (SELECT listing_id, lower(title) AS t FROM listings_v)
SELECT listing_id, {numbers_sql('t', '([0-9]+(?:[.,][0-9]+)?)\\s*(?:gb|gib)\\b')} AS gb, {numbers_sql('t', '([0-9]+(?:[.,][0-9]+)?)\\s*(?:tb|tib)\\b')} AS tb,
  {numbers_sql('t', '([0-9]+(?:[.,][0-9]+)?)\\s*(?:v|volt)\\b')} AS volts, {numbers_sql('t', '([0-9]+(?:[.,][0-9]+)?)\\s*(?:hz)\\b')} AS hz,
  array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\bddr[345]\\b'))), ',') AS ddr,
  {numbers_sql('t', '([0-9]+(?:[.,][0-9]+)?)\\s*(?:pollici|inch|inches)\\b')} AS inches FROM t""",
)
def extract_specs(v: Inputs) -> DataFrame:
    rows = per_title(v, specs.extract_specs("title").alias("s"))
    return rows.select(
        "listing_id",
        *[joined(F.col(f"s.{c}")).alias(c) for c in ("gb", "tb", "volts", "hz", "inches")],
        F.array_join("s.ddr", ",").alias("ddr"),
    )


INFER_SQL = case_sql(
    [
        (like("low", p) + (" AND (regexp_matches(low, '[0-9]\\s*hz\\b') OR regexp_matches(low, '[0-9]\\s*(pollici|inch|inches)\\b') OR contains(low, 'monitor'))" if p is MONITOR_PATTERN else ""), c)
        for p, c in INFER_RULES
    ],
    "'unknown'",
)
BRAND_SQL = case_sql(
    [(like("pad", p), b) for p, b in BRAND_LINES]
    + [(" OR ".join(f"contains(pad, ' {w} ')" for w in words), b) for b, words in CATALOG_BRANDS.items()],
    "''",
)
LISTING_BRAND_SQL = case_sql(
    [(like("np", APPLE_LINES), "Apple")]
    + [(f"contains(np, ' {b} ')", b.upper() if b in CAPITAL_BRANDS else b.title()) for b in LISTING_BRANDS],
    "''",
)


@query(
    "title_attributes",
    L,
    f"""WITH t AS (SELECT *, lower(title) AS low, ' ' || lower(title) || ' ' AS pad, ' ' || {NORM_KEEP.format('title')} || ' ' AS np FROM listings_v)
SELECT listing_id, {INFER_SQL} AS category, {BRAND_SQL} AS catalog_brand, {LISTING_BRAND_SQL} AS listing_brand,
  {condition_sql(norm_sql("title || ' ' || condition"))} AS condition FROM t""",
)
def title_attributes(v: Inputs) -> DataFrame:
    rows = v("listings_v").withColumn("s", specs.extract_specs("title"))
    return rows.select(
        "listing_id",
        specs.infer_category("title", F.col("s")).alias("category"),
        specs.detect_catalog_brand("title").alias("catalog_brand"),
        classify.detect_listing_brand("title").alias("listing_brand"),
        specs.extract_condition(F.col("title"), F.col("condition")).alias("condition"),
    )


@query("model_hint")
def model_hint(v: Inputs) -> DataFrame:
    return per_title(v, classify.extract_model_hint("title").alias("model"))


@query("analyze_listing")
def analyze_listing(v: Inputs) -> DataFrame:
    return promotion.analyze_shared(v("listings_v"), "title").select(
        "listing_id", "a_category", "a_brand", "family_name", "family_key", "variant_key", "variant_name",
        "ambiguity_status", "a_confidence",
    )


def values_sql(c: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '(?i){quoted(pattern)}', 1), lambda x: CAST(replace(x, ',', '.') AS DOUBLE))"


def unit_sql(units: str) -> str:
    return values_sql("low", rf"([0-9]+(?:[.,][0-9]+)?)\s*(?:{units})\b")


GTIN_SQL = "list_sum([CAST(lpad(c, 14, '0')[i] AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END FOR i IN range(1, 15)]) % 10 = 0"
IDENTIFIED_SQL = " OR ".join(
    [like("t", p) for p in (identifiers.MPN_PATTERN, identifiers.EAN_PATTERN, identifiers.ASIN_PATTERN)]
    + [
        f"len(list_filter(regexp_extract_all(t, '{identifiers.BARE_EAN_PATTERN}', 1), lambda c: {GTIN_SQL})) > 0",
        f"len(list_filter(regexp_extract_all(t, '{identifiers.SKU_PATTERN}', 1), lambda c: NOT regexp_matches(c, '^(HTTP|WWW)'))) > 0",
    ]
)
CLASSIFIED_SQL = f"""c AS (SELECT title || ' ' || category || ' ' || description AS title FROM listings_v),
t AS (SELECT title AS x, lower(title) AS low_x, coalesce(nullif({CANONICAL_SQL}, ''), title) AS t FROM c),
w AS (SELECT *, lower(t) AS low FROM t),
k AS (SELECT *, {INFER_SQL} AS category, {unit_sql("gb|gib")} AS gb, CASE WHEN regexp_matches(low, '\\bwd19tb\\b') THEN [] ELSE {unit_sql("tb|tib")} END AS tb,
  list_concat({values_sql("low", specs.VRAM_AFTER)}, {values_sql("low", specs.VRAM_BEFORE)}) AS vram, list_concat({values_sql("low", specs.RAM_BEFORE)}, {values_sql("low", specs.RAM_AFTER)}) AS ram,
  regexp_extract_all(low, '\\bddr[345]\\b') AS ddr, {unit_sql("v|volt")} AS volts, {unit_sql("hz")} AS hz, {values_sql("low", specs.INCHES)} AS all_inches,
  regexp_matches(low, '(?:"|inch|inches|pollici)') AS inch_word, regexp_matches(low, '(?:"|inch|inches|pollici|display|schermo|monitor|screen)') AS screen_word,
  ({IDENTIFIED_SQL}) AS identified FROM w),
i AS (SELECT *, CASE WHEN NOT screen_word OR (coalesce(list_max(all_inches), 0) <= 5 AND NOT inch_word) THEN [] ELSE all_inches END AS inches,
  CASE WHEN len(vram) > 0 THEN list_max(vram) WHEN regexp_matches(low, '\\b(rtx|quadro|radeon|gpu|scheda\\s+video|gddr)\\b')
    THEN list_max(list_filter(gb, lambda v: list_contains([{', '.join(f'{v}::DOUBLE' for v in specs.GPU_MEMORY_SIZES)}], v))) END AS memory FROM k),
f AS (SELECT *, CASE category WHEN 'technology_gpu' THEN memory IS NOT NULL
  WHEN 'technology_ram' THEN len(ddr) > 0 OR len(ram) > 0 OR len(gb) > 0 OR regexp_matches(low, '\\becc\\b') OR regexp_matches(low, '\\b(\\d+)\\s*x\\s*(\\d+)\\s*gb\\b')
    OR regexp_matches(low, '\\bsodimm|so-dimm|laptop|notebook|portatile\\b') OR regexp_matches(low, '\\budimm|desktop\\b')
  WHEN 'technology_monitor' THEN len(hz) > 0 OR len(inches) > 0 OR regexp_matches(low, '\\b(1920x1080|2560x1440|3440x1440|3840x2160|4k|qhd|fhd|uhd)\\b')
  ELSE len(gb) + len(tb) + len(vram) + len(ram) + len(ddr) + len(volts) + len(hz) + len(inches) > 0 END AS facts,
  category = 'technology_gpu' AND coalesce(CAST(memory AS INTEGER) = 0, true) AS unsure FROM i)"""
WARNED_SQL = " + ".join(
    f"CAST(coalesce({test}, false) AS BIGINT)"
    for test in (
        "category = 'technology_gpu' AND regexp_matches(low_x, '\\b(vram|gddr)\\b') AND regexp_matches(low_x, '\\b(banco|banchi|modulo|moduli|stick)\\b')",
        "category = 'technology_gpu' AND CAST(memory AS INTEGER) > 128",
        "category = 'technology_ram' AND contains(low_x, 'vram')",
        "category = 'technology_gpu' AND TRY_CAST(regexp_extract(low_x, '\\bkit\\s+da\\s+(\\d+)\\b', 1) AS INTEGER) > 8",
        "unsure",
    )
)


@query(
    "classification_summary",
    L,
    f"""WITH {CLASSIFIED_SQL} SELECT category, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (unsure OR NOT (facts OR identified)) AS BIGINT) AS ambiguous,
  CAST(sum({WARNED_SQL}) AS BIGINT) AS warnings FROM f GROUP BY 1""",
)
def classification_summary(v: Inputs) -> DataFrame:
    classified = promotion.classify_listings(v("listings_v").drop("family_key", "variant_key"))
    return promotion.classification_summary(classified).withColumnRenamed("a_category", "category")


def hint_rows_sql() -> str:
    rows = []
    for i, (name, hints) in enumerate(LANGUAGE_HINTS.items()):
        for hint in hints:
            rows.append(f"({i}, '{name}', '{language.plain_hint(hint)}')")
    return ", ".join(rows)


LETTERS_SQL = " UNION ALL ".join(
    f"SELECT doc_id, {100 + i} AS late, '{name}' AS lang, 1 AS s FROM base WHERE regexp_matches(low, '[{letters}]')"
    + (" AND NOT regexp_matches(low, '[ßü]')" if name == "sv" else "")
    for i, (name, letters) in enumerate(LANGUAGE_LETTERS.items())
)
LANGUAGE_SQL = f"""base AS (SELECT doc_id, ' ' || {NORM_KEEP.format('text')} || ' ' AS hay, lower(text) AS low FROM documents),
hints(i, lang, h) AS (VALUES {hint_rows_sql()}),
hs AS (SELECT doc_id, i, lang, sum(CASE WHEN contains(hay, ' ' || h || ' ') THEN 2 ELSE 1 END) AS s FROM base JOIN hints ON contains(hay, h) GROUP BY ALL),
ls AS ({LETTERS_SQL}),
u AS (SELECT coalesce(hs.doc_id, ls.doc_id) AS doc_id, coalesce(hs.lang, ls.lang) AS lang, coalesce(hs.s, 0) + coalesce(ls.s, 0) AS score, coalesce(hs.i, ls.late) AS early
  FROM hs FULL JOIN ls ON hs.doc_id = ls.doc_id AND hs.lang = ls.lang),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, early) AS rn, sum(score) OVER (PARTITION BY doc_id) AS total FROM u)"""


@query(
    "detect_language",
    [],
    f"""WITH {LANGUAGE_SQL} SELECT b.doc_id, coalesce(k.lang, 'unknown') AS language, CAST(coalesce(k.total, 0) AS INTEGER) AS total,
  CASE WHEN k.lang IS NULL THEN 0.0::DOUBLE ELSE {sql_round('least(0.99::DOUBLE, greatest(0.35::DOUBLE, CAST(k.score AS DOUBLE) / greatest(k.total, 1)))', 3)} END AS confidence
FROM base b LEFT JOIN k ON k.doc_id = b.doc_id AND k.rn = 1""",
)
def detect_language(v: Inputs) -> DataFrame:
    rows = v("documents").select("doc_id", language.detect_language("text").alias("d"))
    return rows.select("doc_id", "d.language", "d.total", "d.confidence")


@query(
    "source_language",
    [],
    f"""WITH {LANGUAGE_SQL}, d AS (SELECT b.doc_id, coalesce(k.lang, 'unknown') AS lang, coalesce(k.total, 0) AS total,
  CASE WHEN k.lang IS NULL THEN 0.0 ELSE least(0.99, greatest(0.35, CAST(k.score AS DOUBLE) / greatest(k.total, 1))) END AS c,
  CASE b.doc_id % 3 WHEN 0 THEN 'nl' WHEN 1 THEN 'sv' END AS hint FROM base b LEFT JOIN k ON k.doc_id = b.doc_id AND k.rn = 1)
SELECT doc_id, CASE WHEN hint IS NOT NULL AND (lang = 'unknown' OR c < 0.6 OR total <= 2) THEN hint ELSE lang END AS language FROM d""",
)
def source_language(v: Inputs) -> DataFrame:
    source = F.when(F.col("doc_id") % 3 == 0, "2dehands").when(F.col("doc_id") % 3 == 1, " Blocket ").otherwise("other")
    hinted = let(
        language.detect_language("text"), lambda d: language.source_language_hint(source, d)
    )
    return v("documents").select("doc_id", hinted["language"].alias("language"))


QUALITY_SQL = f"""CASE WHEN length(st) < 6 THEN 'title_too_short' WHEN {like('st', titles.NAV_TITLE)} THEN 'nav_title'
  WHEN {like('st', titles.NOISE_TEXT)} AND NOT pu THEN 'noise_title' WHEN price IS NOT NULL THEN 'price_card' WHEN pu AND NOT nu THEN 'product_url'
  WHEN nu THEN 'category_or_nav_url' ELSE 'weak_generic_anchor' END"""
QUALITY_BASE = f"""b AS (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS st, {like('url', urls.PRODUCT_URL)} AS pu, {like('url', urls.CARD_NAV_URL)} AS nu FROM listings_v)"""


@query("listing_quality", L, f"WITH {QUALITY_BASE} SELECT listing_id, {QUALITY_SQL} AS reason FROM b")
def listing_quality(v: Inputs) -> DataFrame:
    return per_title(v, titles.listing_quality(F.col("url"), F.col("title"), F.col("price"))["reason"].alias("reason"))


SPECIFIC_SQL = "(" + " OR ".join(like("lower(clean || ' ' || url)", p) for p in titles.MODEL_SPECIFIC) + ")"


@query(
    "clean_decision",
    L,
    f"""WITH {QUALITY_BASE}, c AS (SELECT *, {CANONICAL_SQL} AS clean, {QUALITY_SQL} AS quality FROM b), d AS (SELECT *, {SPECIFIC_SQL} AS specific FROM c)
SELECT listing_id, CASE WHEN {' OR '.join(f"contains(lower(trim(title)), '{m}')" for m in titles.JUNK_MARKERS)} THEN 'junk_marker'
  WHEN {like('url', urls.NAV_URL)} AND NOT pu THEN 'category_url_not_listing' WHEN {like('clean', titles.GENERIC_TITLE)} AND NOT specific THEN 'generic_category_title'
  WHEN quality IN ('category_or_nav_url', 'nav_title', 'noise_title', 'weak_generic_anchor') THEN quality WHEN length(clean) < 6 THEN 'title_too_short'
  WHEN quality = 'price_card' THEN 'price_card' WHEN pu AND specific THEN 'product_url_model_specific' WHEN quality = 'product_url' THEN 'product_url_needs_reasoning'
  ELSE 'needs_reasoning_cleanup' END AS reason FROM d""",
)
def clean_decision(v: Inputs) -> DataFrame:
    quality = titles.listing_quality(F.col("url"), F.col("title"), F.col("price"))["reason"]
    rows = v("listings_v").withColumns({"normalized": titles.canonicalize_title("title"), "quality": quality})
    decided = titles.clean_decision(F.col("title"), F.col("normalized"), F.col("quality"), F.col("url"))
    return rows.select("listing_id", decided["reason"].alias("reason"))


@query(
    "repair_mojibake",
    [],
    "SELECT doc_id, md5(text) AS digest FROM documents WHERE lang IN ('de', 'es')",
)
def repair_mojibake(v: Inputs) -> DataFrame:
    # The text is first read the wrong way round, as UTF-8 bytes taken for Latin-1.
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    rows = v("documents").where("lang IN ('de', 'es')")
    return rows.select("doc_id", F.md5(text.repair_mojibake(broken).cast("binary")).alias("digest"))


@query(
    "json_objects",
    [],
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_objects(v: Inputs) -> DataFrame:
    noisy = F.concat(F.lit("answer:\n```json\n"), "props", F.lit("\n``` done"))
    found = text.first_json_object(noisy)
    return v("events").select("event_id", F.get_json_object(found, "$.k").cast("long").alias("k"))


PLATFORM_ROWS = "CASE l_suppkey % 3 WHEN 0 THEN 'https://www.subito.it/x/' || replace(p_name, ' ', '-') || '-' || CAST(l_partkey AS VARCHAR) || '.htm?a=1' WHEN 1 THEN 'https://it.wallapop.com/item/' || replace(p_name, ' ', '-') || '-' || CAST(1000000 + l_partkey AS VARCHAR) ELSE 'https://www.vinted.it/items/' || CAST(l_partkey AS VARCHAR) || '-x' END"


@query(
    "platform_keys",
    L,
    f"""SELECT listing_id, CASE l_suppkey % 3 WHEN 0 THEN 'subito_' || CAST(l_partkey AS VARCHAR) WHEN 1 THEN 'wallapop_' || CAST(1000000 + l_partkey AS VARCHAR) ELSE 'vinted_' || CAST(l_partkey AS VARCHAR) END AS key,
  true AS item, CASE l_suppkey % 3 WHEN 2 THEN 'Vinted item' ELSE upper(p_name[1]) || lower(p_name[2:]) END AS title FROM listings_v""",
)
def platform_keys(v: Inputs) -> DataFrame:
    url = F.expr(PLATFORM_ROWS.replace("VARCHAR", "STRING"))
    rows = v("listings_v").select("listing_id", (F.col("l_suppkey") % 3).alias("k"), url.alias("u"))

    def by(fn):
        return F.when(F.col("k") == 0, fn("subito")).when(F.col("k") == 1, fn("wallapop")).otherwise(fn("vinted"))

    card = F.lit("12,50 €\n\n")
    return rows.select(
        "listing_id",
        by(lambda p: urls.platform_listing_key("u", p)).alias("key"),
        by(lambda p: urls.is_item_url("u", p)).alias("item"),
        by(lambda p: urls.platform_card_title(card, "u", p)).alias("title"),
    )


@query(
    "threshold_rules",
    ["requests_v"],
    """WITH r AS (SELECT request_id, regexp_extract_all(lower(request), '(?:almeno|minimo|oltre)\\s*([0-9]+)\\s*(gb|volt|hz)\\b', 1) AS a,
  regexp_extract_all(lower(request), '(?:almeno|minimo|oltre)\\s*([0-9]+)\\s*(gb|volt|hz)\\b', 2) AS u,
  regexp_extract_all(lower(request), '([0-9]+)\\s*(gb|volt|hz)\\s*(?:o superiore)\\b', 1) AS a2, regexp_extract_all(lower(request), '([0-9]+)\\s*(gb|volt|hz)\\s*(?:o superiore)\\b', 2) AS u2 FROM requests_v)
SELECT request_id, CAST(unnest(list_concat(a, a2)) AS DOUBLE) AS min_value, replace(unnest(list_concat(u, u2)), 'volt', 'v') AS unit FROM r""",
)
def threshold_rules(v: Inputs) -> DataFrame:
    return v("requests_v").select("request_id", F.explode(numbers.threshold_rules("request")).alias("r")).select(
        "request_id", "r.*"
    )


@query(
    "clean_text_list",
    ["parts_v"],
    """SELECT p_partkey, p_name || ',' || p_brand AS names FROM parts_v""",
)
def clean_text_list(v: Inputs) -> DataFrame:
    items = F.array("p_name", F.upper("p_name"), F.lit(" "), F.lit("x"), F.concat(F.lit(" "), "p_brand"), F.lower("p_brand"))
    return v("parts_v").select("p_partkey", F.array_join(text.clean_text_list(items), ",").alias("names"))


STOP_SQL = ", ".join(f"'{w}'" for w in EVIDENCE_STOPWORDS)


@query(
    "web_tokens",
    L,
    f"""SELECT listing_id, array_to_string(list_filter(list_transform(regexp_extract_all(title, '[a-zA-Z0-9][a-zA-Z0-9+._-]{{1,}}'), lambda w: trim(lower(w), '-_.')),
  lambda w: length(w) >= 2 AND w NOT IN ({STOP_SQL})), ' ') AS words FROM listings_v""",
)
def web_tokens(v: Inputs) -> DataFrame:
    from bazaarlens.operators.evidence import web_tokens as tokens

    return per_title(v, F.array_join(tokens(F.col("title")), " ").alias("words"))


@query("promotion_report", L)
def promotion_report(v: Inputs) -> DataFrame:
    return promotion.promotion_report(_promoted(v))


def _promoted(v: Inputs) -> DataFrame:
    chosen = promotion.choose_evidence(
        v("listings_v").drop("family_key", "variant_key"), v("verifications_v"), v("cleaning_v"), v("research_v"),
        v("ai_reviews_v"), v("multilingual_v"),
    )
    return promotion.promotion_decisions(chosen)


@query("promotion_decisions")
def promotion_decisions(v: Inputs) -> DataFrame:
    return _promoted(v).select("listing_id", "evidence_source", "promoted_title", "effective_category", "skip_reason")


@query(
    "promotion_evidence",
    ["listings_v", "verifications_v", "cleaning_v", "research_v", "ai_reviews_v", "multilingual_v"],
    """SELECT v.listing_id, CASE WHEN a.confidence >= 0.93 AND a.status = 'resolved' THEN 'ai_edge_review' WHEN r.confidence >= 0.70 THEN 'online_product_research'
  WHEN m.confidence >= 0.65 THEN 'multilingual_normalization' ELSE 'clean' END AS evidence_source
FROM verifications_v v LEFT JOIN cleaning_v c USING (listing_id) LEFT JOIN research_v r USING (listing_id) LEFT JOIN ai_reviews_v a USING (listing_id) LEFT JOIN multilingual_v m USING (listing_id)
WHERE v.status IN ('verified', 'verified_conflict') AND v.confidence >= 0.55 AND (v.status = 'verified_conflict' OR coalesce(c.decision, 'accept') <> 'reject')""",
)
def promotion_evidence(v: Inputs) -> DataFrame:
    return promotion.choose_evidence(
        v("listings_v"), v("verifications_v"), v("cleaning_v"), v("research_v"), v("ai_reviews_v"), v("multilingual_v")
    ).select("listing_id", "evidence_source")


def _learned(v: Inputs) -> DataFrame:
    promoted = _promoted(v).where("skip_reason IS NULL").select(
        F.col("listing_id").alias("row_id"), F.col("seen_on").alias("seen_at"), "source",
        F.col("promoted_title").alias("title"), F.col("effective_category").alias("category"),
        F.col("p_brand_hint").alias("brand_hint"), F.col("p_model_hint").alias("model_hint"),
        F.col("identity_confidence").alias("hint_confidence"),
    )
    return promotion.learn(promoted)


@query("learned_families")
def learned_families(v: Inputs) -> DataFrame:
    from bazaarlens.operators.upsert import upsert_families

    return upsert_families(None, promotion.learned_rows(_learned(v), "families")).drop("metadata_json")


@query("learned_variants")
def learned_variants(v: Inputs) -> DataFrame:
    from bazaarlens.operators.upsert import upsert_variants

    return upsert_variants(None, promotion.learned_rows(_learned(v), "variants")).drop("metadata_json")


@query("learned_aliases")
def learned_aliases(v: Inputs) -> DataFrame:
    from bazaarlens.operators.upsert import upsert_aliases

    return upsert_aliases(None, promotion.learned_rows(_learned(v), "aliases"))


@query(
    "confidence_rounding",
    [],
    f"SELECT event_id, {sql_round('value / 7', 2)} AS rounded FROM events",
)
def confidence_rounding(v: Inputs) -> DataFrame:
    return v("events").select("event_id", round_to(F.col("value") / 7, 2).alias("rounded"))
