"""Column functions against hand-made rows."""

import pytest
from pyspark.sql import functions as F

from bazaarlens.functions import classify, identifiers, language, numbers, specs, terms, text, titles, urls


@pytest.mark.parametrize(
    "title, clean",
    [
        ("Pochi rimasti iPhone 16 4,9 569,00 € 849,00 € (Nuovo)", "iPhone 16"),
        ("offerta nuovo sale  RTX 3060 12GB", "RTX 3060 12GB"),
        ("ThinkPad T490 usato 5, 4.", "ThinkPad T490"),
        ("  ", ""),
    ],
)
def test_canonical_title(value, title, clean):
    assert value(title, titles.canonicalize_title) == clean


def test_capacity_terms(value):
    hit = lambda t, term: value(t, lambda c: terms.contains_term(text.normalize_text(c), term))
    assert hit("RAM DDR4 8GB", "8gb") and hit("ddr4 8 gb", "8gb")
    assert not hit("RAM 128GB", "8gb")
    assert hit("kit 2 X 32 GB", "2x32gb") and not hit("kit 12x32gb", "2x32gb")
    assert hit("un pc usato", "pc") and hit("g.skill ripjaws", "G.Skill")


@pytest.mark.parametrize(
    "title, quantity", [("2x32gb ddr4", 2), ("2 x 32 gb", 2), ("ram 32gb x4", 4), ("ram 32gb", None), ("3 sedie legno", 3)]
)
def test_quantities(value, title, quantity):
    got = value(title, lambda c: terms.quantity_for_term(text.normalize_text(c), "32 gb", ["sedie"]))
    assert got == quantity


def test_units_are_whole_words(value):
    assert value("7801 View", specs.extract_specs)["volts"] == []
    assert value("trapano 18 V", specs.extract_specs)["volts"] == [18.0]
    got = value('RTX 3060 12GB GDDR6, monitor 27"', specs.extract_specs)
    assert got["gb"] == [12.0] and got["vram_gb"] == [12.0]


def test_unicode_rules(value):
    assert value("KOPFHÖRER neu", lambda c: classify.canonical_category(c, F.lit(""))) == "technology_audio_headphones"
    assert value("a b", lambda c: text.normalize_product_text(c)) == "a b"
    assert value("Ｆull  Ⅸ é", text.normalize_text).startswith("full")
    assert value("Éà-ü ł", text.normalize_product_text) == "ea u"


@pytest.mark.parametrize(
    "written, number",
    [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("12,5", 12.5), ("1,234", 1234.0), ("1.234", 1234.0), ("12.5", 12.5), ("", None), ("1.2.3", None)],
)
def test_localized_numbers(value, written, number):
    assert value(written, numbers.parse_localized_number) == number


def test_prices(value):
    got = value("voto 4 € poi € 12,50 e 99 chf", numbers.parse_price)
    assert (got["value"], got["currency"]) == (12.5, "EUR")
    got = value("solo 3 $", numbers.parse_price)
    assert (got["value"], got["currency"]) == (3.0, "USD")
    assert value("senza prezzo 12", numbers.parse_price)["value"] is None
    assert value("1Lenovo 250,00 €", numbers.parse_bot_price) == 250.0
    assert value("niente", numbers.parse_bot_price) == 999.0
    assert value("costa 45 eur", numbers.parse_card_price) == 45.0


def test_identifiers(value):
    got = {(i["identifier_type"], i["value"]): i["confidence"] for i in value(
        "Dell MPN: U2720Q EAN 4006381333931 EAN 4006381333932 ASIN: B08N5WRWNW HP-ABC/12X4", identifiers.extract_identifiers
    )}
    assert got[("mpn", "U2720Q")] == 0.90
    assert got[("ean_upc", "4006381333931")] == 0.95
    assert got[("ean_upc", "4006381333932")] == 0.75
    assert got[("asin", "B08N5WRWNW")] == 0.90
    assert value("4006381333931", identifiers.is_valid_gtin) and not value("4006381333932", identifiers.is_valid_gtin)
    assert value("96385074", identifiers.is_valid_gtin) and not value("963850741", identifiers.is_valid_gtin)


def test_condition_and_brand(value):
    assert value("iPhone nuovo ricondiziato", lambda c: specs.extract_condition(c, F.lit(""))) == "refurbished"
    assert value("non funzionante", lambda c: specs.extract_condition(c, F.lit("used"))) == "for_parts"
    assert value("nvidia hp zbook", specs.detect_catalog_brand) == "hp"
    assert value("cuffie SONY wh-1000", classify.detect_listing_brand) == "Sony"
    assert value("magic mouse", classify.detect_listing_brand) == "Apple"


@pytest.mark.parametrize(
    "title, model",
    [("Scheda RTX 3060 Ti nuova", "RTX 3060 Ti"), ("iPhone 13 Pro Max", "iPhone 13 Pro Max"), ("vanaf 100 euro", ""), ("lampada blu", "")],
)
def test_models(value, title, model):
    assert value(title, classify.extract_model_hint) == model


def test_category_keys(value):
    assert value("technology_phone", classify.valid_category_key) == "technology_smartphone"
    assert value("Møbler og indretning , Ikon af", classify.valid_category_key) == "home_furniture_table"
    assert value("n/a", classify.valid_category_key) == ""
    assert value("technology_keyboard", classify.valid_category_key) == "technology_keyboard"


def test_language(value):
    got = value("spedizione gratis, usato, ottime condizioni", language.detect_language)
    assert got["language"] == "it" and got["confidence"] == 0.99
    assert value("", language.detect_language)["language"] == "unknown"
    tie = value("straße", language.detect_language)
    assert tie["language"] == "de" and tie["scores"] == {"de": 1}


def test_cleaning_gate(value):
    decide = lambda title, reason, url: value(
        title, lambda c: titles.clean_decision(c, titles.canonicalize_title(c), F.lit(reason), F.lit(url))
    )
    assert decide("View all phones", "", "")["reason"] == "junk_marker"
    assert decide("iPhone 13", "", "https://x/category/phones")["confidence"] == 0.98
    assert decide("Smartphones", "", "")["reason"] == "generic_category_title"
    assert decide("Pixel 8 128GB", "", "https://x/p/pixel-8")["decision"] == "accept"
    assert decide("Bella lampada", "price_card", "")["confidence"] == 0.84


def test_urls(value):
    assert value("https://www.Shop.it/a?x=1#y", urls.host) == "shop.it"
    assert value("https://shop.co.no/a", urls.country_hint) == "NO"
    assert value("https://a.it/x-12345.htm?z", lambda c: urls.platform_listing_key(c, "subito")) == "subito_12345"
    assert value("https://www.google.com/q", urls.search_url_ok) is False
    assert value("https://a.it/c/x/?utm=1", urls.normalize_category_url) == "https://a.it/c/x"
    assert value("1 / 6\n12 €\nBici rossa", lambda c: urls.platform_card_title(c, F.lit(""), "wallapop")) == "Bici rossa"


def test_json_and_mojibake(value):
    assert value('text ```json\n{"a": 1}\n``` end', text.first_json_object) == '{"a":1}'
    assert value("no object", text.first_json_object) is None
    assert value("citt\u00c3\u00a0", text.repair_mojibake) == "città"
    assert value("Ã broken", text.repair_mojibake) == " broken"
    assert value("plain", text.repair_mojibake) == "plain"


def test_thresholds(value):
    got = [(r["min_value"], r["unit"]) for r in value("GPU almeno 16 GB e 18 volt o superiore", numbers.threshold_rules)]
    assert got == [(16.0, "gb"), (18.0, "v")]
    assert value("kit 18V e 20 volt", lambda c: numbers.values_with_unit(c, "v")) == [18.0, 20.0]
