"""Crawled pages: products in JSON-LD, listing cards, category links, pagination, site discovery."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.functions.core import barrier, find_first, matches, non_empty, squeeze, text
from bazaarlens.functions.numbers import parse_price
from bazaarlens.functions.specs import extract_specs
from bazaarlens.functions.titles import NOISE_TEXT, clean_card_title, listing_quality
from bazaarlens.functions.urls import (
    listing_fingerprint,
    normalize_category_url,
    raw_host,
    same_site,
    url_path,
    url_query,
)
from bazaarlens.rules import links as rules
from bazaarlens.session import cut_lineage

ANCHOR_SCHEMA = "page_id long, base_url string, position int, href string, url string, label string, parent string, card string"

# Card text sizes.
CARD_MIN, CARD_MAX, CARD_LEVELS = 20, 900, 4
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Anchors(HTMLParser):
    """Anchors of one page with the text of their enclosing elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.open: list[tuple[str, int]] = []
        self.anchors: list[dict] = []
        self.waiting: list[tuple[int, int, dict]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        self.open.append((tag, len(self.pieces)))
        href = dict(attrs).get("href") if tag == "a" else None
        if href is not None:
            anchor = {"href": href, "levels": []}
            self.anchors.append(anchor)
            self.waiting.append((len(self.open), len(self.pieces), anchor))

    def handle_endtag(self, tag):
        depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if depth is not None:
            while len(self.open) > depth:
                self._close()

    def _close(self):
        level = len(self.open)
        _, start = self.open.pop()
        still = []
        body = None
        for own, first, anchor in self.waiting:
            if own >= level and len(anchor["levels"]) <= CARD_LEVELS:
                body = " ".join(self.pieces[start:]) if body is None else body
                anchor["levels"].append(" ".join(self.pieces[first:]) if own == level and not anchor["levels"] else body)
            if len(anchor["levels"]) <= CARD_LEVELS:
                still.append((own, first, anchor))
        self.waiting = still

    def handle_data(self, data):
        word = " ".join(data.split())
        if word:
            self.pieces.append(word)

    def finish(self) -> list[dict]:
        self.close()
        while self.open:
            self._close()
        return self.anchors


def _card(levels: list[str]) -> str:
    """First enclosing text of card size, else the longest one that is not too long."""
    best = levels[0] if levels else ""
    for body in levels[1:]:
        if CARD_MIN <= len(body) <= CARD_MAX:
            return body
        if len(best) < len(body) <= CARD_MAX:
            best = body
    return best


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        rows = []
        for page in pages.itertuples(index=False):
            parser = _Anchors()
            parser.feed(page.html or "")
            for position, anchor in enumerate(parser.finish()):
                levels, href = anchor["levels"], anchor["href"].strip()
                try:
                    url = urljoin(page.url or "", href)
                except ValueError:
                    url = href
                parent = levels[1] if len(levels) > 1 else ""
                rows.append((page.page_id, page.url, position, href, url, levels[0] if levels else "", parent, _card(levels)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANCHOR_SCHEMA.split(", ")])


def anchors(pages: DataFrame) -> DataFrame:
    """All links of pages, in page order. Parsing the markup is the one step that needs Python."""
    return pages.select("page_id", "url", "html").mapInPandas(_anchor_rows, ANCHOR_SCHEMA)


# JSON-LD -----------------------------------------------------------------------------------------

LD_PATTERN = r"(?is)<script[^>]*type=[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"


def _as_array(node: Column) -> Column:
    """A JSON array's items, or the node alone."""
    return F.when(node.startswith("["), F.from_json(node, "array<string>")).otherwise(F.array(node))


def _flat(node: Column, depth: int = 4) -> Column:
    """Items of a JSON array and of the arrays inside it, down to `depth` arrays in each other."""
    items = _as_array(node)
    for _ in range(depth - 1):
        items = F.flatten(F.transform(items, _as_array))
    return items


def jsonld_products(pages: DataFrame) -> DataFrame:
    """Product, offer and list items of JSON-LD blocks, with the first offer's price."""
    blocks = pages.select(
        "page_id", F.col("url").alias("base_url"), F.posexplode(F.regexp_extract_all("html", F.lit(LD_PATTERN), F.lit(1))).alias("block", "raw")
    ).withColumn("raw", F.trim("raw"))
    items = blocks.select("page_id", "base_url", "block", F.posexplode(_flat(F.col("raw"))).alias("n", "node"))
    graph = F.get_json_object("node", "$['@graph']")
    both = F.concat(F.array("node"), F.when(graph.isNotNull(), _flat(graph)).otherwise(F.array().cast("array<string>")))
    objects = items.select("page_id", "base_url", "block", "n", F.posexplode(both).alias("g", "o"))
    kind = F.coalesce(F.get_json_object("o", "$['@type']"), F.get_json_object("o", "$.type"))
    kinds = F.transform(_as_array(kind), lambda k: F.lower(F.translate(k, '"', "")))
    wanted = F.arrays_overlap(kinds, F.array(F.lit("product"), F.lit("offer"), F.lit("listitem")))
    rows = objects.where(kind.isNotNull() & wanted).withColumn(
        "p", barrier(F.when(F.get_json_object("o", "$.item").startswith("{"), F.get_json_object("o", "$.item")).otherwise(F.col("o")))
    )
    field = lambda *paths: F.coalesce(*[non_empty(F.get_json_object(c, f"$.{k}")) for c, k in paths])
    offers = F.coalesce(F.get_json_object("p", "$.offers"), F.get_json_object("o", "$.offers"))
    offer = F.when(offers.isNotNull(), F.get(_as_array(offers), F.lit(0)))
    price = F.coalesce(non_empty(F.get_json_object(offer, "$.price")), F.get_json_object(offer, "$.lowPrice"))
    image = F.coalesce(F.get_json_object("p", "$.image"), F.get_json_object("o", "$.image"))
    return rows.select(
        "page_id",
        "base_url",
        # a million items of each kind keep their order
        (F.col("block").cast("long") * 10**12 + F.col("n").cast("long") * 10**6 + F.col("g")).alias("position"),
        barrier(F.trim(field(("p", "name"), ("p", "title"), ("o", "name")))).alias("title"),
        F.translate(price, ",", ".").try_cast("double").alias("price"),
        text(F.get_json_object(offer, "$.priceCurrency")).alias("currency"),
        join_url(F.col("base_url"), field(("p", "url"), ("o", "url"))).alias("url"),
        F.when(image.isNotNull(), join_url(F.col("base_url"), F.translate(F.get(_as_array(image), F.lit(0)), '"', ""))).otherwise("").alias("image_url"),
    ).where("title <> ''")


def join_url(base: Column, link: Column) -> Column:
    """Absolute form of a link on a page: full, host-relative, root-relative, relative, query or mark.

    Steps "." and ".." of a path are taken, as browsers do.
    """
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.regexp_replace(F.substring(page, F.length(root) + 1, F.length(page)), r"[^/]*$", "")
    tail = F.regexp_extract(link, r"[?#].*$", 0)
    path = F.regexp_replace(link, r"[?#].*$", "")
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    steps = F.split(whole, "/")
    taken = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, step: F.when(step == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done))
        .when(step == ".", done)
        .otherwise(F.concat(done, F.array(step))),
    )
    ends_on_step = F.element_at(steps, -1).isin(".", "..")
    kept = F.when(ends_on_step, F.concat(taken, F.array(F.lit("")))).otherwise(taken)
    return (
        F.when(link.isNull() | (link == ""), base)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .otherwise(F.concat(root, F.array_join(kept, "/"), tail))
    )


# Cards -------------------------------------------------------------------------------------------


def listing_cards(pages: DataFrame, source: Column, max_items: int | None = None) -> DataFrame:
    """Listings of each page: JSON-LD first, then cards that pass the quality gate.

    Equal fingerprints keep the first; ``max_items`` is the per-page limit of a crawl (the reference: 100), none by default.
    """
    links = anchors(pages).where("href NOT LIKE '#%' AND lower(href) NOT LIKE 'javascript:%'")
    cards = links.withColumns(
        {
            "title": barrier(clean_card_title(F.col("label"), F.col("url"), F.col("card"))),
            "offer": barrier(parse_price("card")),
        }
    ).withColumn("quality", barrier(listing_quality(F.col("url"), F.col("title"), F.col("offer.value"))))
    accepted = cards.where("quality.accept").select(
        "page_id",
        (F.col("position").cast("long") + 10**18).alias("position"),
        "title",
        "url",
        F.col("offer.value").alias("price"),
        F.col("offer.currency").alias("currency"),
        F.lit("").alias("image_url"),
        F.col("quality.reason").alias("reason"),
        F.when(matches(F.col("card"), NOISE_TEXT), F.col("title")).otherwise(F.col("card")).alias("spec_text"),
    )
    products = jsonld_products(pages).select(
        "page_id", "position", "title", "url", "price", "currency", "image_url",
        F.lit("jsonld").alias("reason"), F.col("title").alias("spec_text"),
    )
    rows = products.unionByName(accepted).withColumn("source", source)
    rows = rows.withColumn(
        "fingerprint",
        barrier(listing_fingerprint(F.col("source"), F.lit(""), F.col("url"), F.col("title"), F.col("price"), F.lit(""))),
    )
    first = W.partitionBy("page_id", "fingerprint").orderBy("position")
    order = W.partitionBy("page_id").orderBy("position")
    unique = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= 1).drop("_r")
    if max_items is not None:
        unique = unique.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_items).drop("_n")
    return unique.withColumn("specs", extract_specs("spec_text")).drop("spec_text")


# Links -------------------------------------------------------------------------------------------


def category_interest(source: Column, label: Column, url: Column, path: Column, profile: str = "tech") -> Column:
    """Ordering score of a category for a profile: tech, general or all."""
    hay = F.lower(F.concat_ws(" ", text(source), text(label), text(url), text(path)))
    score = F.lit(0)
    for pattern, points in rules.INTEREST_POINTS:
        score = score + F.when(matches(hay, pattern), points).otherwise(0)
    score = score + F.when(matches(hay, rules.NEGATIVE), rules.NEGATIVE_POINTS[profile]).otherwise(0)
    if profile == "tech":
        for sources, pattern, points in rules.SOURCE_POINTS:
            score = score + F.when(source.isin(*sources) & matches(hay, pattern), points).otherwise(0)
    return score


def _clean_label(label: Column, url: Column) -> Column:
    shown = F.regexp_replace(squeeze(label), r"(?U)^\W+|\W+$", "")
    slug = squeeze(F.regexp_replace(F.regexp_extract(F.btrim(url_path(url), F.lit("/")), r"([^/]*)$", 1), "[-_]+", " "))
    other = F.coalesce(F.nullif(slug, F.lit("")), F.nullif(raw_host(url), F.lit("")), url)
    return F.when(F.length(shown).between(2, 80), shown).otherwise(F.substring(other, 1, 80))


def looks_like_category(url: Column, label: Column, parent: Column) -> Column:
    path = F.regexp_replace(url_path(url), "/+$", "")
    probe = F.lower(F.concat_ws(" ", url, label))
    joined = F.lower(F.concat_ws(" ", url, label, parent))
    shown = F.trim(label)
    noise = (
        matches(url, rules.SITE_PRODUCT_URL)
        | (path == "")
        | path.rlike(r"(?i)^/[a-z]{2}(?:-[a-z]{2})?$")
        | shown.rlike(r"(?i)^(www\.)?[^/\s]+\.[a-z]{2,}$")
        | (path.rlike(r"(?i)/products?$") & matches(shown, rules.GENERIC_NAV))
        | matches(probe, rules.SKIP_LINK)
        | (F.length(label) > 90)
        | matches(shown, rules.LANGUAGE_SWITCH)
        | matches(shown, rules.GENERIC_NAV)
        | matches(shown, rules.GENERIC_DEAL)
        | matches(probe, rules.HARD_NOISE)
        | matches(joined, rules.PRICE_NEARBY)
    )
    return ~noise & (matches(url, rules.CATEGORY_URL) | matches(joined, rules.CATEGORY_WORDS))


def category_links(pages: DataFrame, source: Column, max_links: int | None = None, profile: str = "tech") -> DataFrame:
    """Same-site links that look like categories, first per url, with their interest score.

    ``max_links`` is the per-page limit of a crawl (the reference: 250), none by default.
    """
    links = anchors(pages).where("href NOT RLIKE '^(mailto:|tel:|javascript:|#)'").withColumn(
        "url", barrier(normalize_category_url("url"))
    )
    own = links.where(same_site(F.col("url"), F.col("base_url"))).withColumn(
        "label", barrier(_clean_label(F.col("label"), F.col("url")))
    )
    good = own.where(looks_like_category(F.col("url"), F.col("label"), F.substring("parent", 1, 220)))
    first = W.partitionBy("page_id", "url").orderBy("position")
    order = W.partitionBy("page_id").orderBy("position")
    kept = good.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= 1).withColumn("source", source)
    if max_links is not None:
        kept = kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_links)
    return kept.select(
        "page_id", "source", "label", "url", F.col("base_url").alias("parent_url"), "position",
        category_interest(F.col("source"), F.col("label"), F.col("url"), F.col("label"), profile).alias("interest"),
    )


def _other_params(url: Column) -> Column:
    """Query parameters without the page number, sorted."""
    pairs = F.filter(F.split(url_query(url), "&"), lambda p: p != "")
    named = F.filter(pairs, lambda p: ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*rules.PAGE_PARAMS))
    return F.array_join(F.array_sort(named), "&")


def page_number(url: Column, label: Column) -> Column:
    names = "|".join(rules.PAGE_PARAMS)
    query = F.concat(F.lit("&"), url_query(url))
    return F.coalesce(
        find_first(query, rf"&(?:{names})=(\d+)", 1).try_cast("int"),
        find_first(url_path(url), r"/(?:page|pagina|seite)/(\d+)", 1).try_cast("int"),
        F.when(F.trim(label).rlike(r"^\d{1,4}$"), F.trim(label)).try_cast("int"),
    )


def pagination_links(pages: DataFrame, max_pages: int = 0) -> DataFrame:
    """Later pages of the same list: same site, path and other parameters, greater number."""
    links = anchors(pages).withColumns(
        {
            "base": barrier(normalize_category_url("base_url")),
            "url": barrier(normalize_category_url("url")),
            "label": barrier(F.lower(squeeze(F.col("label")))),
        }
    )
    path = lambda c: F.regexp_replace(url_path(c), "/+$", "")
    number = page_number(F.col("url"), F.col("label"))
    current = F.coalesce(page_number(F.col("base"), F.lit("")), F.lit(1))
    later = links.withColumns({"page": barrier(number), "_now": barrier(current)}).where(
        same_site(F.col("url"), F.col("base"))
        & (F.col("url") != F.col("base"))
        & (F.col("page") > F.col("_now"))
        & (matches(F.col("url"), rules.PAGINATION_URL) | matches(F.col("label"), rules.PAGE_LABEL))
        & (path(F.col("url")) == path(F.col("base")))
        & (_other_params(F.col("url")) == _other_params(F.col("base")))
    )
    first = W.partitionBy("page_id", "url").orderBy("position")
    order = W.partitionBy("page_id").orderBy("position")
    unique = later.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= 1)
    unique = unique.withColumn("order", F.row_number().over(order))
    if max_pages > 0:
        unique = unique.where(F.col("order") < max_pages)
    return unique.select("page_id", "base", "url", "page", "order")


def discover_categories(
    links: DataFrame, roots: DataFrame, max_depth: int = 0, max_categories: int = 0, level_limit: int | None = None
) -> DataFrame:
    """Breadth-first walk of site links from the roots, each url once, with path and depth.

    ``links``: source, parent_url, label, url. ``roots``: source, url. One level per step: the
    frontier joins the links, urls seen before drop out by anti join, and each level is
    checkpointed. It ends where a level finds nothing new; ``level_limit`` stops a walk without a
    depth bound before.
    """
    seen = cut_lineage(roots.select("source", "url").distinct())
    frontier = seen.select("source", "url", F.lit("").alias("path"))
    levels: list[DataFrame] = []
    total, depth = 0, 0
    bound = max_depth if max_depth > 0 else level_limit
    while bound is None or depth < bound:
        depth += 1
        parents = frontier.select("source", F.col("url").alias("parent_url"), F.col("path").alias("parent_path"))
        fresh = links.join(parents, ["source", "parent_url"]).join(seen, ["source", "url"], "left_anti")
        path = F.concat_ws(" > ", F.nullif("parent_path", F.lit("")), "label")
        found = fresh.groupBy("source", "url").agg(
            F.min(F.struct("parent_url", path.alias("path"), "label")).alias("b")
        )
        level = cut_lineage(found.select("source", "url", "b.parent_url", "b.path", "b.label", F.lit(depth).alias("depth")))
        count = level.count()
        if count == 0:
            break
        levels.append(level)
        total += count
        if max_categories > 0 and total >= max_categories:
            break
        seen = seen.unionByName(level.select("source", "url"))
        frontier = level
    if not levels:
        return links.limit(0).select(
            "source", "url", "parent_url", F.lit("").alias("path"), "label", F.lit(0).alias("depth")
        )
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    if max_categories > 0:
        out = out.orderBy("depth", "source", "url").limit(max_categories)
    return out
