"""Urls, hosts and platform listing keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlens.functions.core import col, find_first, matches, squeeze, text

# Country codes recognised as the end of a host.
COUNTRY_ENDINGS = ("it", "de", "fr", "es", "nl", "be", "at", "ch", "pl", "cz", "se", "dk", "fi", "no")

# Search engines whose own links are dropped.
SEARCH_HOSTS = ("duckduckgo.com", "google.com", "bing.com", "yahoo.com")

# Url shapes.
PRODUCT_URL = (
    r"(/p/|/product/|/products/[^/?#]+|/item/|/itm/|/ad/|/ads/|/annunci/|/anzeige/|/oferta|/oferty/"
    r"|/listing|/listings|/product-detail)"
)
NAV_URL = (
    r"(/c/|/category|/categories|/categorie|/categoria|/catalog|/catalogo|/search|/recherche|/zoeken"
    r"|/collections?$|/products/?$|/deals/?$)"
)
CARD_NAV_URL = (
    r"(/c/|/category|/categories|/categorie|/categoria|/catalog|/catalogo|/search|/recherche|/zoeken"
    r"|/q/|/s-|/l/|/collections?$|/products/?$|/deals/?$)"
)
CATEGORY_QUERY = r"(category|cat|rubric|section|keyword|q|query|search|text|stext|type|page)"

# Per platform, the patterns that give the listing id, and the links that are no item.
ITEM_ID_PATTERNS = {
    "subito": (r"-(\d+)\.htm$", r"-([a-f0-9]{8,})\.htm$", r"/([^/]+)\.htm$"),
    "wallapop": (r"-(\d+)$", r"/(\d{6,})$"),
    "vinted": (r"/items/(\d+)",),
}
NOT_AN_ITEM = {
    "subito": r"/annunci-|/aiuto|/info|/privacy|/terms|/login|/registrati|/account|/messaggi|/preferiti",
    "wallapop": r"/app/search|/login|/register|/help|/terms|/privacy|adjust\.com",
}

# Lines of a card that are no title.
CARD_NOISE_LINES = {
    "subito": ("preferito", "sponsorizzato", "vendo", "vedi annuncio", "subito"),
    "wallapop": (
        "home", "preferiti", "inserisci", "inbox", "tu", "registrati o accedi", "accetta tutto",
        "rifiuta tutto", "privacy? scegli tu.", "personalizza la tua scelta",
    ),
}


def normalized_url(c: Column | str) -> Column:
    return F.regexp_replace(squeeze(text(c)), r"[?#].*$", "")


def raw_host(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(text(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def host(c: Column | str) -> Column:
    """Host in lower case without a leading www."""
    return F.regexp_replace(raw_host(c), r"^www\.", "")


def url_path(c: Column | str) -> Column:
    return F.regexp_extract(text(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_query(c: Column | str) -> Column:
    return F.regexp_extract(text(c), r"^[^?#]*\?([^#]*)", 1)


def country_hint(c: Column | str) -> Column:
    ending = F.regexp_extract(raw_host(c), r"\.([a-z]{2})$", 1)
    return F.when(ending.isin(*COUNTRY_ENDINGS), F.upper(ending)).otherwise("")


def listing_fingerprint(
    source: Column, external_id: Column, url: Column, title: Column, price: Column, location: Column
) -> Column:
    """sha1 of the source and the external id, else the url, else title, price and place."""
    # A price of zero counts as no price, as an empty text would.
    price_text = F.when(price != 0, price.cast("string"))
    fallback = F.concat_ws(
        "|", text(source), F.lower(squeeze(title)), text(price_text), F.lower(squeeze(location))
    )
    stable = F.coalesce(
        F.nullif(text(external_id), F.lit("")), F.nullif(normalized_url(url), F.lit("")), fallback
    )
    return F.sha1(F.concat_ws("|", text(source), stable).cast("binary"))


def is_product_url(c: Column | str) -> Column:
    return matches(col(c), PRODUCT_URL)


def is_nav_url(c: Column | str) -> Column:
    return matches(col(c), NAV_URL) & ~matches(col(c), PRODUCT_URL)


def slug_title(c: Column | str) -> Column:
    """Last path part with - and _ as spaces."""
    last = F.regexp_extract(F.btrim(url_path(c), F.lit("/")), r"([^/]*)$", 1)
    return squeeze(F.regexp_replace(last, "[-_]+", " "))


def search_url_ok(c: Column | str) -> Column:
    """An http url that is not a search engine's own."""
    site = host(c)
    own = F.lit(False)
    for engine in SEARCH_HOSTS:
        own = own | (site == engine) | site.endswith("." + engine)
    return text(c).startswith("http") & ~own & (text(c) != "")


def strip_tags(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(text(c), "<[^>]*>", " "))


def absolute_url(href: Column | str, base: str) -> Column:
    """Path links against a site root."""
    link, root = text(href), base.rstrip("/")
    return (
        F.when(link == "", "")
        .when(link.startswith("http"), link)
        .when(link.startswith("/"), F.concat(F.lit(root), link))
        .otherwise(F.concat(F.lit(root + "/"), link))
    )


def _bare(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(text(c), r"\?.*$", ""), "/+$", "")


def platform_listing_key(c: Column | str, platform: str) -> Column:
    """platform_<id in the url>, else platform_<sha1 of the url>."""
    link = text(c) if platform == "vinted" else _bare(c)
    ids = [find_first(link, pattern, 1) for pattern in ITEM_ID_PATTERNS[platform]]
    return F.concat(F.lit(platform + "_"), F.coalesce(*ids, F.sha1(link.cast("binary"))))


def is_item_url(c: Column | str, platform: str) -> Column:
    link, clean = text(c), F.regexp_replace(text(c), r"\?.*$", "")
    if platform == "subito":
        return link.contains("subito.it") & clean.endswith(".htm") & ~clean.rlike(NOT_AN_ITEM[platform])
    if platform == "wallapop":
        return (
            link.contains("wallapop.com")
            & ~link.rlike(NOT_AN_ITEM[platform])
            & (clean.contains("/item/") | clean.rlike(r"-\d{6,}$"))
        )
    return link.rlike(r"/items/\d+")


def platform_card_title(card: Column | str, url: Column | str, platform: str) -> Column:
    """First descriptive line of a card, else the url slug."""
    lines = F.transform(F.split(text(card), r"\R"), F.trim)

    def descriptive(line: Column) -> Column:
        low = F.lower(line)
        if platform == "vinted":
            return (F.length(line) > 2) & ~line.contains("€")
        keep = (line != "") & ~low.isin(*CARD_NOISE_LINES[platform])
        if platform == "subito":
            return keep & ~line.contains("€") & (F.length(line) >= 3) & ~line.rlike(r"^\d{1,5}(?:[.,]\d{1,2})?$")
        return (
            keep
            & ~line.rlike(r"^\d+\s*/\s*\d+$")
            & ~low.rlike(r"^\d{1,5}(?:[.,]\d{1,2})?\s*(?:€|eur)?$")
            & ~(line.contains("€") & (F.length(line) < 30))
        )

    first = F.get(F.filter(lines, descriptive), F.lit(0))
    slug = F.regexp_extract(_bare(url), r"([^/]*)$", 1)
    slug = F.regexp_replace(slug, r"-\d+(?:\.htm)?$", "")
    slug = F.trim(F.replace(F.translate(slug, "-", " "), F.lit(".htm"), F.lit("")))
    slug = F.concat(F.upper(F.substring(slug, 1, 1)), F.lower(F.substring(slug, 2, 1000)))
    default = F.lit(platform.capitalize() + " item")
    fallback = default if platform == "vinted" else F.coalesce(F.nullif(slug, F.lit("")), default)
    return F.substring(F.coalesce(first, fallback), 1, 180)


def normalize_category_url(c: Column | str) -> Column:
    """Scheme, host and path without trailing slashes; the query only when it names a section."""
    query = url_query(c)
    base = F.regexp_extract(text(c), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_replace(url_path(c), "/+$", "")
    return F.concat(
        base,
        F.when(path == "", "/").otherwise(path),
        F.when((query != "") & matches(query, CATEGORY_QUERY), F.concat(F.lit("?"), query)).otherwise(""),
    )


def same_site(a: Column, b: Column) -> Column:
    left = F.replace(raw_host(a), F.lit("www."), F.lit(""))
    right = F.replace(raw_host(b), F.lit("www."), F.lit(""))
    return (left != "") & (left == right)


def normalize_result_row(title: Column, url: Column, snippet: Column) -> Column:
    """struct(title, url, snippet) cut to size, or null when the row is unusable."""
    clean_title = strip_tags(title)
    row = F.struct(
        F.substring(clean_title, 1, 180).alias("title"),
        F.substring(F.trim(text(url)), 1, 500).alias("url"),
        F.substring(strip_tags(snippet), 1, 300).alias("snippet"),
    )
    return F.when((clean_title != "") & search_url_ok(F.trim(text(url))), row)


