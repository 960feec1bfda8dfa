"""Operators on small tables: idempotence, brute force, skew and invariants."""

import itertools
import math
import random
from functools import reduce
from statistics import median

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import deals, evidence, opportunity, pages, promotion, resolver, rule_index, upsert
from bazaarlens.plans.deal_queries import RAM, WIDGETS
from bazaarlens.sources.rules import parse_rule_config


def test_median_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([5.0, 7.5, 1000.25, 3.0]) * rng.random() + 0.01) for _ in range(3000)]
    rows += [(f"k{i % 50}", rng.random() * 10**rng.randint(0, 6) + 0.001) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, price double")
    got = {r["k"]: r for r in opportunity.grouped_median(opportunity.value_counts(df, ["k"], "price"), ["k"], "price").collect()}
    for key, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        prices = [p for _, p in group]
        assert got[key]["sample_size"] == len(prices)
        assert math.isclose(got[key]["reference_price"], median(prices), rel_tol=1e-12)


def test_opportunity_edges(spark):
    rows = [(i, "gpu", "b", "m", "t", p) for i, p in enumerate([100.0, 100.0, 100.0, 20.0, None, 0.0])]
    rows += [(9, "gpu", "", "", "lonely", 5.0)]
    df = spark.createDataFrame(rows, "id int, category string, brand string, model string, title string, price double")
    got = {r["id"]: r for r in opportunity.score_opportunities(df).collect()}
    assert got[0]["opportunity_status"] == "near_reference" and got[0]["opportunity_score"] == 50.0
    assert got[3]["opportunity_status"] == "suspicious_low_price" and got[3]["opportunity_score"] == 27.5
    for i in (4, 5, 9):
        assert got[i]["opportunity_status"] == "insufficient_data" and got[i]["opportunity_score"] is None
    assert got[0]["reference_confidence"] == 0.85


def test_listing_upsert_is_idempotent(spark):
    schema = "fingerprint string, sighting_id string, seen_at string, title string, price double, currency string, location string"
    rows = [("f", "1", "2024-01-01", "old", 10.0, "EUR", "A"), ("f", "2", "2024-01-02", "", None, "", "B"), ("g", "3", "2024-01-01", "x", 1.0, "", "C")]
    batch = spark.createDataFrame(rows, schema)
    once = upsert.upsert_listings(None, batch)
    twice = upsert.upsert_listings(once, batch)
    first, second = ({r["fingerprint"]: r.asDict() for r in df.collect()} for df in (once, twice))
    assert first["f"]["title"] == "old" and first["f"]["price"] == 10.0 and first["f"]["location"] == "A"
    assert first["f"]["seen_count"] == 2 and second["f"]["seen_count"] == 4
    for key in first:
        assert {k: v for k, v in first[key].items() if k != "seen_count"} == {k: v for k, v in second[key].items() if k != "seen_count"}


def test_late_sightings_take_their_own_place(spark):
    schema = "fingerprint string, sighting_id string, seen_at string, title string, price double, seller string, image_url string"
    rows = [
        ("f", "1", "2024-01-01", "first", 1.0, "sA", None),
        ("f", "2", "2024-01-05", "middle", 2.0, "sB", "pic"),
        ("f", "3", "2024-01-10", "", 3.0, "sC", None),
    ]
    frame = spark.createDataFrame(rows, schema)
    parts = {r[1]: frame.where(f"sighting_id = '{r[1]}'") for r in rows}
    want = upsert.upsert_listings(None, frame).drop("set_at").first()
    assert (want["title"], want["price"], want["seller"], want["image_url"]) == ("middle", 3.0, "sA", "pic")
    for order in ("123", "321", "213", "312"):
        table = None
        for k in order:
            # the picture's column is new in the second sighting
            table = upsert.upsert_listings(table, parts[k] if k == "2" else parts[k].drop("image_url"))
        got = table.first()
        assert {c: got[c] for c in want.asDict()} == want.asDict(), order


def test_alias_upsert_fills_ids(spark):
    schema = "row_id string, seen_at string, alias string, source string, family_key string, variant_key string, confidence double"
    rows = [("1", "1", " Foo-Bar ", None, None, None, 0.5), ("2", "2", "foo bar", "", "fam", "var", 0.4), ("3", "3", "x", "", "f", "v", 0.9)]
    got = upsert.upsert_aliases(None, spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and got[0]["alias"] == "Foo-Bar" and got[0]["family_key"] == "fam" and got[0]["confidence"] == 0.5


def _catalog(spark):
    families = spark.createDataFrame(
        [("iphone", "phone", "Apple", "iPhone 16 Pro Max", 0.98), ("pixel", "phone", "Google", "Pixel 8", 0.9), ("case", "acc", "Apple", "iPhone Case", 0.8)],
        "family_id string, category string, brand string, family_name string, confidence double",
    )
    variants = spark.createDataFrame([("v256", "iphone", "256GB", 0.98)], "variant_id string, family_id string, variant_name string, confidence double")
    aliases = spark.createDataFrame(
        [("a1", "iphone", None, "16 Pro Max", "shop", 0.92), ("a2", "pixel", None, "iphone", "shop", 0.9)],
        "alias_id string, family_id string, variant_id string, alias string, source string, confidence double",
    )
    codes = spark.createDataFrame(
        [("iphone", "v256", "model_code", "A3296", "maker", 0.99)],
        "family_id string, variant_id string, identifier_type string, identifier_value string, source string, confidence double",
    )
    return families, resolver.build_index(families, variants, aliases, codes)


def test_resolver_documented_case(spark):
    families, index = _catalog(spark)
    listings = spark.createDataFrame(
        [
            ("1", "OTTIMA OFFERTA!!1! IPHONE TELEFONO NUOVO RICONDIZIATO PRO MAX 16", "Codice modello A3296, 256GB, display 6.9 pollici"),
            ("2", "lampada da tavolo", ""),
            ("3", "Google Pixel 8", ""),
        ],
        "listing_id string, title string, description string",
    )
    got = {r["listing_id"]: r for r in resolver.resolve_products(listings, index, families).collect()}
    assert got["1"]["status"] == "resolved" and got["1"]["selected_family"] == "iphone" and got["1"]["condition"] == "refurbished"
    assert got["2"]["status"] == "unresolved" and got["2"]["confidence"] == 0.0
    assert got["3"]["selected_family"] == "pixel"
    for row in got.values():
        assert row["confidence"] <= 0.99 and (row["status"] != "resolved" or row["confidence"] >= 0.72)


def test_rare_word_index_misses_nothing(spark):
    """Against all pairs: every pair that can score is a candidate, with one word in most texts."""
    rng = random.Random(3)
    words = ["hot"] * 8 + [f"w{i}" for i in range(12)]
    terms = {" ".join(rng.sample(sorted(set(words)), rng.randint(1, 5))) for _ in range(60)}
    texts = [(str(i), " ".join(rng.choice(words) for _ in range(6)), " ".join(rng.choice(words) for _ in range(3))) for i in range(120)]
    index = spark.createDataFrame([(t, sorted(set(t.split()))) for t in terms], "term_norm string, tokens array<string>")
    frame = spark.createDataFrame(texts, "text_id string, title string, description string")
    got = {(r[0], r[1]) for r in resolver.candidate_terms(frame, index).collect()}
    for text_id, title, description in texts:
        for term in terms:
            need = set(term.split())
            able = [len(need & set(side.split())) / len(need) >= share for side, share in ((title, 0.6), (description, 0.75))]
            if any(able) or f" {term} " in f" {title} " or f" {term} " in f" {description} ":
                assert (text_id, term) in got


def test_decision_order(spark):
    schema = "listing_id string, platform string, title string, description string, price double, image_url string"
    rows = [
        ("ok", "EBAY", "2x32GB Corsair DDR4 RAM 3200MHz", "", 200.0, "x"),
        ("word", "EBAY", "DDR4 RAM 32gb sodimm", "", 10.0, None),
        ("pattern", "EBAY", "DDR4 RAM 32gb", "difettoso", 10.0, None),
        ("price", "EBAY", "DDR4 RAM 32gb", "", 500.0, None),
        ("image", "EBAY", "DDR4 RAM 32gb", "", 100.0, "x"),
        ("context", "EBAY", "DDR4 RAM 32gb", "", 100.0, None),
        ("seen", "EBAY", "DDR4 RAM 32gb", "", 100.0, None),
    ]
    verdicts = spark.createDataFrame(
        [("image", None, False), ("context", False, None)], "listing_id string, context_ok boolean, image_ok boolean"
    )
    seen = spark.createDataFrame([("seen",)], "listing_id string")
    got = {r["listing_id"]: r for r in deals.decide_listings(spark.createDataFrame(rows, schema), RAM, verdicts, seen).collect()}
    steps = {k: r["step"] for k, r in got.items()}
    assert steps == {"ok": "accept", "word": "rules", "pattern": "pattern", "price": "budget", "image": "vision", "context": "context", "seen": "seen"}
    # 2 x 143 per stick, 70 + brand 5 + keywords 8 + price share 0.7 bonus 5
    assert got["ok"]["budget"] == 286.0 and got["ok"]["score"] == 88
    assert [e["step"] for e in got["ok"]["evidence"]][-1] == "decision"


def test_rule_documents():
    config = parse_rule_config(
        {"name": "x", "budget": {"default": "12"}, "required_groups": ["A", [" B ", "b"], []], "unit_budget_rules": [{"terms": "t", "budget_per_unit": "3"}, {"match": ["u"], "max_price_per_unit": 0}]}
    )
    assert config.budget == {"standard": 12.0} and config.required_groups == (("a",), ("b",))
    assert [r.match for r in config.unit_rules] == [("t",)] and config.unit_rules[0].name == "unit_rule_1"


def test_verification_ladder(spark):
    listings = spark.createDataFrame(
        [
            ("same", "Google Pixel 8 128GB", "https://www.shop.it/p/pixel-8", "", "accept"),
            ("conflict", "Google Pixel 8 128GB", "https://shop.it/p/pixel-8", "", "reject"),
            ("web", "Google Pixel 8 obsidian", "https://a.it/x", "", ""),
            ("none", "Google Pixel 8 obsidian", "https://a.it/x", "", ""),
            ("nav", "Google Pixel 8", "https://a.it/category/phones", "", ""),
        ],
        "listing_id string, title string, url string, category string, clean_decision string",
    ).withColumn("clean_title", F.lit("")).withColumn("clean_category", F.lit(""))
    results = spark.createDataFrame(
        [
            ("same", 1, "x pixel", "https://shop.it/p/pixel-8/?a=1", ""),
            ("conflict", 1, "x pixel", "https://shop.it/p/pixel-8", ""),
            ("web", 1, "nothing", "https://b.it", ""),
            ("web", 2, "Google Pixel 8 obsidian review", "https://b.it", ""),
        ],
        "listing_id string, position int, title string, url string, snippet string",
    )
    got = {r["listing_id"]: (r["status"], r["reason"]) for r in evidence.verify_listings(listings, results).collect()}
    assert got["same"] == ("verified", "same_product_url_model_match")
    assert got["conflict"][0] == "verified_conflict"
    assert got["web"] == ("verified", "web_model_title_match")
    assert got["none"] == ("rejected", "no_web_evidence")
    assert got["nav"] == ("rejected", "category_url_not_listing")


def test_analysis_and_support(spark):
    df = spark.createDataFrame(
        [("NVIDIA RTX 3060 12GB GDDR6",), ("Kingston DDR4 2x16GB SODIMM ECC",), ("Dell monitor 27 pollici 144Hz 2560x1440 MPN: U2720Q",)], "text string"
    )
    got = [r.asDict() for r in promotion.analyze_listing(df).collect()]
    assert got[0]["family_name"] == "RTX 3060" and got[0]["variant_name"] == "RTX 3060 12GB" and got[0]["ambiguity_status"] == "resolved"
    assert got[1]["variant_key"].endswith(":ddr4:16gb:2x:sodimm") and got[1]["variant"]["kit_total_gb"] == 32
    assert got[2]["family_name"] == "DELL U2720Q" and got[2]["variant"]["resolution"] == "2560X1440"
    titles = spark.createDataFrame(
        [("technology_console", "PlayStation 5 console"), ("technology_console", "PlayStation 5 controller"), ("technology_gpu", "cerco RTX 3060"), ("sports_billiards", "anything")],
        "c string, t string",
    )
    ok = [r[0] for r in titles.select(promotion.title_supports_category(F.col("c"), F.col("t"))).collect()]
    assert ok == [True, False, False, True]


def test_walk_of_links_with_a_cycle(spark):
    links = spark.createDataFrame(
        [("s", "r", "A", "a"), ("s", "a", "B", "b"), ("s", "b", "R", "r"), ("s", "b", "A2", "a"), ("s", "b", "C", "c")],
        "source string, parent_url string, label string, url string",
    )
    roots = spark.createDataFrame([("s", "r")], "source string, url string")
    got = {r["url"]: (r["depth"], r["path"]) for r in pages.discover_categories(links, roots).collect()}
    assert got == {"a": (1, "A"), "b": (2, "A > B"), "c": (3, "A > B > C")}


def test_page_operators_drop_nothing_by_default(spark):
    from bazaarlens.functions.text import clean_text_list
    from bazaarlens.sources import payloads

    products = ",".join(f'{{"@type":"Product","name":"Camera X{i} body","url":"/p/{i}","offers":{{"price":"{i + 1}"}}}}' for i in range(120))
    links = "".join(f'<a href="/c/laptop-{i}">Laptop {i}</a>' for i in range(300))
    item = '{"a":' * 12 + '{"subject":"deep","url":"/a","price":1}' + "}" * 12
    html = f'<script type="application/ld+json">[{products}]</script>{links}'
    state = f'<script id="__NEXT_DATA__" type="application/json">{item}</script>'
    rows = [(1, "https://shop.example.it/", html), (2, "https://shop.example.it/", state)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    cards = pages.listing_cards(frame, F.lit("s"))
    assert cards.where("reason = 'jsonld'").count() == 120 and pages.listing_cards(frame, F.lit("s"), 100).count() == 100
    assert pages.category_links(frame, F.lit("s")).count() == 300 and pages.category_links(frame, F.lit("s"), 250).count() == 250
    assert [r["page_id"] for r in payloads.embedded_items(frame).collect()] == [2]
    walk = spark.createDataFrame([("s", f"u{i}", "L", f"u{i + 1}") for i in range(3)], "source string, parent_url string, label string, url string")
    roots = spark.createDataFrame([("s", "u0")], "source string, url string")
    assert pages.discover_categories(walk, roots).count() == 3 and pages.discover_categories(walk, roots, level_limit=2).count() == 2
    words = spark.range(1).select(clean_text_list(F.array(*[F.lit(f"word {i}") for i in range(40)])).alias("w"))
    assert len(words.first()["w"]) == 40


def test_card_text_of_nested_markup(spark):
    html = "<ul><li><a href='/item/1'>Buy</a><span>Pixel 8 come nuovo</span> <b>250 €</b></li></ul>" + "<p>x</p>" * 3
    page = spark.createDataFrame([(1, "https://a.it/list", html)], "page_id long, url string, html string")
    card = pages.anchors(page).first()
    assert card["card"] == "Buy Pixel 8 come nuovo 250 €" and card["url"] == "https://a.it/item/1" and card["label"] == "Buy"


def test_links_join_as_in_browsers(spark):
    from urllib.parse import urljoin

    from pyspark.sql import functions as F

    from bazaarlens.operators.pages import join_url

    bases = ("https://x.it/a/list?p=1", "https://x.it", "https://x.it/a/b/c/", "https://x.it/a/b/c#z")
    links = ("?id=5", "../c/d", "./q", "q/./r?x=../y", "/abs/../k", "//h/p", "http://o/p", "#m", "..", ".", "../../../up", "")
    rows = spark.createDataFrame([(b, u) for b in bases for u in links], "b string, u string")
    for r in rows.withColumn("j", join_url(F.col("b"), F.col("u"))).collect():
        assert r["j"] == urljoin(r["b"], r["u"]), (r["b"], r["u"])


def test_jsonld_keeps_order_and_nested_lists(spark):
    import json

    from bazaarlens.operators.pages import jsonld_products

    many = [{"@type": "Product", "name": f"n{i}", "url": f"?id={i}", "offers": {"price": i}} for i in range(150)]
    blocks = ({"@graph": many}, {"@graph": many}, [[{"@type": "Product", "name": "deep", "url": "../x"}]])
    html = "".join(f'<script type="application/ld+json">{json.dumps(b)}</script>' for b in blocks)
    pages = spark.createDataFrame([(1, "https://x.it/a/list?p=1", html)], "page_id long, url string, html string")
    got = sorted(jsonld_products(pages).collect(), key=lambda r: r["position"])
    assert [r["title"] for r in got] == [f"n{i}" for i in range(150)] * 2 + ["deep"]
    assert len({r["position"] for r in got}) == 301 and got[-1]["url"] == "https://x.it/x"


def test_rule_index_equals_single_rule_sets(spark):
    """All rule sets through the index at once, with verdicts, seen ids and images, against one by one."""
    rng = random.Random(4)
    pieces = ["ddr4", "DDR 4", "ram", "32gb", "32 GB", "132gb", "2x32gb", "4 moduli", "sodimm", "pc", "scheda madre", "corsair", "cold", "widget", "b\nolt", "è", "  "]
    words = ["ddr4", "32gb", "2x16gb", "pc", "co", "è", "scheda madre", "16 gb", "w", "cold"]
    configs = [RAM, WIDGETS] + [
        parse_rule_config(
            {
                "name": f"rules {i}",
                "exclude_words": rng.sample(words, rng.randint(0, 2)),
                "required_words": rng.sample(words, rng.randint(0, 2)),
                "required_groups": [rng.sample(words, 2) for _ in range(rng.randint(0, 2))],
                "distractor_words": rng.sample(words, rng.randint(0, 2)),
                "context_check_enabled": rng.random() < 0.5,
                "vision_enabled": rng.random() < 0.5,
                "budget": rng.choice([90, {"configurations": {"big": 150.0, "standard": 70.0}}]),
                "unit_budget_rules": [{"name": "u", "match": rng.sample(words, 2), "max_price_per_unit": 40, "unit_aliases": ["moduli"]}],
                "config_patterns": {"big": rng.sample(words, 1), "small": rng.sample(words, 1)},
                "reject_patterns": rng.sample(words, rng.randint(0, 1)),
                "premium_brands": ["corsair"],
                "positive_keywords": {"ddr4": 5, "co": 3},
                "negative_keywords": rng.sample(words, 1),
            }
        )
        for i in range(6)
    ]
    rows = [
        (f"l{i}", "EBAY", " ".join(rng.choice(pieces) for _ in range(4)), rng.choice([None, "", "difettoso", "4 x 32gb"]), float(rng.randint(1, 200)), rng.choice([None, "img"]))
        for i in range(60)
    ] + [("null", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "listing_id string, platform string, title string, description string, price double, image_url string")
    verdicts = spark.createDataFrame(
        [(f"l{i}", rng.random() < 0.6, "why", rng.choice([None, "big", "standard"]), rng.choice([None, 50.0]), rng.random() < 0.5) for i in range(40)],
        "listing_id string, context_ok boolean, context_reason string, context_config string, context_price double, image_ok boolean",
    )
    seen = spark.createDataFrame([("l3",), ("l3",), ("l50",)], "listing_id string")
    for extra in ((None, None), (verdicts, seen)):
        got = rule_index.decide_many(df, configs, *extra)
        want = reduce(lambda a, b: a.unionByName(b), [deals.decide_listings(df, c, *extra) for c in configs])
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
        assert {r.step for r in got.collect()} >= {"rules", "budget", "accept"}
    with pytest.raises(ValueError):
        rule_index.decide_many(df, [RAM, RAM])


def test_ties_of_checkpoints_do_not_depend_on_partitions(spark):
    """More ties at the limit than rows fit: the same rows stay, however the input is cut."""
    from bazaarlens.operators import reviews

    rows = [("shop", "site_category:a", ("running", "ok", "error")[i % 3], "2026-01-01", None, str(i)) for i in range(90)]
    names = "source string, profile string, status string, started_at string, finished_at string, task_key string"
    runs = spark.createDataFrame(rows, names)
    none = runs.where("false").select(
        "source", F.lit("").alias("task_kind"), "task_key", "status", F.lit(0).cast("long").alias("saved_count"), F.col("started_at").alias("updated_at")
    )
    for parts in (1, 3, 7):
        got = reviews.recent_checkpoints(none, runs.repartition(parts), 50).groupBy("status").count().collect()
        assert {r["status"]: r["count"] for r in got} == {"error": 30, "ok": 20}


def test_stored_rows_carry_one_time_for_values_set_together(spark):
    """Bytes that stored listings take in the shuffle of the next upsert: 186 a row with a time for each value."""
    import time

    from bazaarlens.operators import upsert

    def written():
        context = spark.sparkContext
        stages = context._jsc.sc().statusStore().stageList(
            None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList()
        )
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    n = F.col("id").cast("string").cast("binary")
    rows = spark.range(3000).select(
        F.sha1(n).alias("fingerprint"), F.sha2(n, 256).alias("sighting_id"), F.lit("2026-01-01").alias("seen_at"),
        *[F.lit("x").alias(c) for c in upsert.LISTING_KEEPS],
        *[F.lit(1.0 if c == "price" else "y").alias(c) for c in ("title", "url", "price", "currency", "query")],
    )
    snapshot = upsert.upsert_listings(None, rows).localCheckpoint()
    time.sleep(1)
    before = written()
    merged = upsert.upsert_listings(snapshot, rows.where("seen_at = ''")).collect()
    time.sleep(1)
    assert {(r["title"], r["set_at"]["title"]["t"], r["seen_count"]) for r in merged} == {("y", "2026-01-01", 1)}
    assert (written() - before) / 3000 < 165
