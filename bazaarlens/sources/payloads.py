"""Platform API payloads and JSON embedded in pages, as listing rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.core import non_empty, text
from bazaarlens.functions.urls import absolute_url, platform_listing_key
from bazaarlens.operators.deals import first_per_key
from bazaarlens.session import cut_lineage

# Fixed value: price of an item whose payload has none.
NO_PRICE = 999.0

MONEY = "struct<value:string,currency:string,amount:string,key:string>"
EBAY = (
    f"itemId string, title string, itemWebUrl string, itemAffiliateWebUrl string, price {MONEY}, "
    f"currentBidPrice {MONEY}, image struct<imageUrl:string>, condition string, "
    "itemLocation struct<city:string,stateOrProvince:string,country:string>, buyingOptions array<string>, "
    f"shippingOptions array<struct<shippingCost:{MONEY}>>"
)
FEATURE = "struct<values:array<struct<key:string,value:string>>>"
SUBITO = (
    "urn string, subject string, title string, url string, link string, sold boolean, "
    "urls struct<default:string>, geo struct<town:struct<value:string>,city:struct<shortName:string>>, "
    f"features struct<`/price`:{FEATURE},`/item_shippable`:{FEATURE}>, "
    "price string, priceValue string, cost string, image string, images array<string>, photos array<string>"
)
VINTED = "id string, title string, description string, url string, price string, photos array<struct<url:string,full_size_url:string>>"


def _money(c: Column) -> Column:
    """A number, or an object with value, amount or key; comma decimals allowed."""
    inner = F.coalesce(
        F.get_json_object(c, "$.value"), F.get_json_object(c, "$.amount"), F.get_json_object(c, "$.key")
    )
    return F.replace(F.coalesce(inner, c), F.lit(","), F.lit(".")).try_cast("double")


def _joined(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def _row(platform: str, **columns: Column) -> list[Column]:
    order = ("id", "title", "price", "url", "description", "image_url", "extra_info")
    return [F.lit(platform).alias("platform"), *[columns[name].alias(name) for name in order]]


def ebay_items(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    p = df.select("*", F.from_json(raw, EBAY).alias("p")).where(
        "coalesce(p.itemId, '') <> '' AND coalesce(p.title, '') <> ''"
    )
    url = F.coalesce(non_empty("p.itemWebUrl"), non_empty("p.itemAffiliateWebUrl"))
    shipping = F.get("p.shippingOptions", F.lit(0))["shippingCost"]
    place = _joined(", ", text("p.itemLocation.city"), text("p.itemLocation.stateOrProvince"), text("p.itemLocation.country"))
    extra = _joined(
        " | ",
        text("p.condition"),
        place,
        F.array_join("p.buyingOptions", "/"),
        F.when(non_empty(shipping["value"]).isNotNull(), _joined(" ", F.lit("spedizione"), shipping["value"], text(shipping["currency"]))),
    )
    price = F.coalesce(F.col("p.price.value").try_cast("double"), F.col("p.currentBidPrice.value").try_cast("double"), F.lit(NO_PRICE))
    return p.where(url.isNotNull()).select(
        *df.columns,
        *_row(
            "EBAY", id=F.concat(F.lit("ebay_"), "p.itemId"), title=F.col("p.title"), price=price, url=url,
            description=F.col("p.title"), image_url=F.col("p.image.imageUrl"), extra_info=extra,
        ),
    )


def subito_items(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Sold items are dropped; images may be plain links or objects."""
    p = df.select("*", F.from_json(raw, SUBITO).alias("p")).where("p IS NOT NULL AND NOT coalesce(p.sold, false)")
    link = F.coalesce(non_empty("p.urls.default"), non_empty("p.url"), non_empty("p.link"))
    url = F.regexp_replace(absolute_url(link, "https://www.subito.it"), r"\?.*$", "")
    first = F.get(F.col("p.features")["/price"]["values"], F.lit(0))
    shippable = F.get(F.col("p.features")["/item_shippable"]["values"], F.lit(0))["value"]
    price = F.coalesce(
        _money(F.coalesce(non_empty(first["key"]), first["value"])),
        _money(F.col("p.price")), _money(F.col("p.priceValue")), _money(F.col("p.cost")), F.lit(NO_PRICE),
    )
    town, city = text("p.geo.town.value"), text("p.geo.city.shortName")
    place = F.when((town != "") & (city != ""), F.concat(town, F.lit(" ("), city, F.lit(")"))).otherwise(
        F.coalesce(F.nullif(town, F.lit("")), city)
    )
    title = F.coalesce(non_empty("p.subject"), non_empty("p.title"))
    keys = ("url", "src", "large", "medium", "small")

    def picture(c: Column) -> Column:
        options = [F.when(c.startswith("http"), c)] + [F.get_json_object(c, f"$.{k}") for k in keys]
        return F.coalesce(*[F.when(o.startswith("http"), o) for o in options])

    return p.where(link.isNotNull()).select(
        *df.columns,
        *_row(
            "SUBITO",
            id=F.coalesce(F.concat(F.lit("subito_"), non_empty("p.urn")), platform_listing_key(url, "subito")),
            title=F.coalesce(title, F.lit("Subito item")), price=price, url=url, description=F.coalesce(title, F.lit("")),
            image_url=F.coalesce(
                picture(F.col("p.image")), picture(F.get("p.images", F.lit(0))), picture(F.get("p.photos", F.lit(0)))
            ),
            extra_info=_joined(" | ", place, F.when(text(shippable) != "", "Spedizione disponibile").otherwise("")),
        ),
    )


def vinted_items(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    p = df.select("*", F.from_json(F.coalesce(F.get_json_object(raw, "$.item"), raw), VINTED).alias("p"))
    photo = F.get("p.photos", F.lit(0))
    url = F.coalesce(non_empty("p.url"), F.concat(F.lit("https://www.vinted.it/items/"), "p.id"))
    return p.where("coalesce(p.id, '') <> ''").select(
        *df.columns,
        *_row(
            "VINTED", id=F.concat(F.lit("vinted_"), "p.id"), title=F.coalesce(non_empty("p.title"), F.lit("Vinted item")),
            price=F.coalesce(_money(F.col("p.price")), F.lit(NO_PRICE)), url=url, description=text("p.description"),
            image_url=F.coalesce(photo["url"], photo["full_size_url"]), extra_info=F.lit(""),
        ),
    )


def normalize_payloads(payloads: DataFrame) -> DataFrame:
    """Rows with platform_key, response_id, position and raw_json to listings, first of each id."""
    readers = {"ebay": ebay_items, "subito": subito_items, "vinted": vinted_items}
    parts = [fn(payloads.where(F.col("platform_key") == key)) for key, fn in readers.items()]
    every = reduce(DataFrame.unionByName, parts)
    return first_per_key(every, ["response_id", "id"], ["position"])


# Fixed value: where a page keeps its item list.
ITEM_LIST_PATH = "$.props.pageProps.initialState.items.list"
STATE_PATTERN = r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>'


def embedded_items(pages: DataFrame) -> DataFrame:
    """Item objects of each page's state: the known list, else every object that looks like an item.

    The fallback opens one level of the JSON per step, each step an explode of the level before, until
    a level is empty. Levels are checkpointed, so each is opened once.
    """
    state = pages.select("page_id", "url", F.regexp_extract("html", STATE_PATTERN, 1).alias("state")).where("state <> ''")
    listed = state.select(
        "page_id",
        F.posexplode(
            F.filter(
                F.transform(
                    F.from_json(F.get_json_object("state", ITEM_LIST_PATH), "array<string>"),
                    lambda w: F.get_json_object(w, "$.item"),
                ),
                lambda i: i.isNotNull(),
            )
        ).alias("position", "raw_json"),
    )
    rest = state.join(listed.select("page_id").distinct(), "page_id", "left_anti")
    level = rest.select("page_id", F.col("state").alias("node"), F.lit("").alias("place"))
    found = []
    while not found or not level.isEmpty():
        has = lambda *keys: F.arrays_overlap(F.json_object_keys("node"), F.array(*[F.lit(k) for k in keys]))
        looks = has("subject", "title") & has("urls", "url", "link") & has("features", "price", "priceValue")
        found.append(level.where(looks).select("page_id", "place", F.col("node").alias("raw_json")))
        as_list = F.when(F.col("node").startswith("["), F.from_json("node", "array<string>"))
        as_map = F.map_values(F.when(F.col("node").startswith("{"), F.from_json("node", "map<string,string>")))
        inner = level.select(
            "page_id", "place", F.posexplode(F.coalesce(as_list, as_map)).alias("n", "child")
        ).where("child LIKE '{%' OR child LIKE '[%'").select(
            "page_id", F.col("child").alias("node"), F.concat("place", F.lpad(F.col("n").cast("string"), 6, "0")).alias("place")
        )
        level = cut_lineage(inner)
    fallback = reduce(DataFrame.unionByName, found).select("page_id", "place", "raw_json")
    known = listed.select("page_id", F.lpad(F.col("position").cast("string"), 6, "0").alias("place"), "raw_json")
    return known.unionByName(fallback)
