"""Work that rows share is done once, and plans do not multiply it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import multilingual, pages, promotion
from bazaarlens.operators.distinct import once_per


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    ("build", "longest"),
    [
        (lambda p: pages.category_links(p, F.lit("shop")).select("page_id", "label", "url"), 15_000),
        (lambda p: pages.pagination_links(p).select("page_id", "url", "page"), 12_000),
        (lambda p: pages.listing_cards(p, F.lit("shop")).select("page_id", "title", "reason", "price"), 31_000),
    ],
)
def test_page_rules_are_not_multiplied(spark, build, longest):
    rows = spark.createDataFrame([(1, "https://a.example/", "<a href='/c/x'>Audio</a>")], "page_id long, url string, html string")
    assert len(plan_of(build(rows))) < longest


def test_shared_inputs_are_worked_out_once(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", None), (4, None, "b"), (5, "a", "")], "id int, t string, c string")
    seen = []

    def build(distinct):
        seen.append(distinct.count())
        return distinct.withColumns({"n": F.length("t"), "t": F.upper("t")})

    got = {tuple(r) for r in once_per(rows, ["t", "c"], build).select("id", "t", "c", "n").collect()}
    assert seen == [4]
    assert got == {(1, "A", None, 1), (2, "A", None, 1), (3, "B", None, 1), (4, None, "b", None), (5, "A", "", 1)}


def test_multilingual_rows_are_worked_out_once(spark):
    """Language and class of equal listings: the plan has a distinct step under them."""
    rows = spark.createDataFrame([(i, "scheda video", "gpu", "", "", "x") for i in range(3)],
                                 "listing_id int, title string, category string, description string, resolved_title string, source string")
    df = multilingual.normalize_multilingual(rows)
    assert "Aggregate" in plan_of(df.select("listing_id", "category_canonical"))
    assert {r["category_canonical"] for r in df.select("category_canonical").collect()} == {"technology_gpu"}


def test_equal_texts_are_analysed_once(spark):
    rows = spark.createDataFrame([(i, "NVIDIA GeForce RTX 3070 8GB") for i in range(3)], "listing_id int, title string")
    df = promotion.analyze_shared(rows, "title")
    assert "Aggregate" in plan_of(df.select("listing_id", "a_category"))
    assert [r["a_category"] for r in df.select("a_category").collect()] == ["technology_gpu"] * 3


def test_titles_are_written_once_per_part(spark):
    """Sightings meet their part's title: the long text is below the join with the sightings, and rows stay the same."""
    from bazaarlens.plans.fixtures import TABLES, VIEWS
    from bazaarlens.plans.registry import Inputs

    folder = "/root/testdata/sf0.001"
    got = Inputs(spark, folder)("listings_v")
    plan = plan_of(got)
    assert plan.index("Pochi rimasti") > plan.index("Join")
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES}
    tables["parts_v"] = spark.sql(VIEWS["parts_v"][1], part=tables["part"])
    needs, sql = VIEWS["listings_v"]
    want = spark.sql(sql, **{n: tables[n] for n in needs})
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_texts_with_other_codes_are_scored_as_one_class(spark):
    """Codes that only terms of one word have do not multiply the work; words of longer terms, and where they stand, do."""
    from bazaarlens.operators import resolver

    names = ["red widget", "red widget 12", "111111", "222222"]
    index = spark.createDataFrame([(n, sorted(n.split())) for n in names], "term_norm string, tokens array<string>")
    texts = [("a red widget", f"size 12 code {c}") for c in ("111111", "222222", "333333")]
    texts += [("red big widget", "size 12 code 1"), ("red widget", "size 12 code 1"), ("red widget", "size 13 code 1")]
    frame = spark.createDataFrame([(str(i), *t) for i, t in enumerate(texts)], "text_id string, title string, description string")
    members, classes = resolver.text_classes(resolver._sides(frame), index)
    of = {r["text_id"]: r["class_id"] for r in members.collect()}
    assert of["0"] == of["1"] == of["2"] and len({of[str(i)] for i in (0, 3, 4, 5)}) == 4 and classes.count() == 4
    got = {(r["text_id"], r["term_norm"], r["exact_title"], r["exact_desc"]) for r in resolver.candidate_terms(frame, index).collect()}
    assert ("0", "111111", False, True) in got and ("1", "222222", False, True) in got and ("2", "red widget", True, False) in got
    assert ("3", "red widget", False, False) in got


def test_listings_are_prepared_once_for_verification(spark):
    """Titles are worked out in a distinct step, and each side is read once: one join by title, one by listing."""
    from bazaarlens.operators import evidence

    listings = spark.createDataFrame(
        [(i, t, f"https://a.it/item/{i}", "gpu", "", "", "") for i, t in ((1, "RTX 3070 Ti"), (1, "RTX 3070 Ti"), (2, "RTX 3070 Ti"), (None, "sedia vendo"))],
        "listing_id int, title string, url string, category string, clean_decision string, clean_title string, clean_category string",
    )
    results = spark.createDataFrame(
        [(1, 1, "rtx 3070 ti nuova", "https://b.it", ""), (1, 2, "altro", None, None)],
        "listing_id int, position int, title string, url string, snippet string",
    )
    df = evidence.verify_listings(listings, results)
    plan = plan_of(df)
    assert plan.count("Join") == 2 and "Aggregate [_once" in plan
    got = sorted(tuple(r) for r in df.select(F.coalesce("listing_id", F.lit(0)), "status", "n_results", "canonical_category").collect())
    assert got == [
        (0, "rejected", 0, "technology_gpu"), (1, "verified", 2, "technology_gpu"), (1, "verified", 2, "technology_gpu"), (2, "rejected", 0, "technology_gpu"),
    ]


def test_terms_are_looked_for_once_per_text(spark):
    """Rules read distinct texts in both forms, offers meet what they found in one join, and decisions agree."""
    from bazaarlens.operators import deals, rule_index
    from bazaarlens.plans.deal_queries import RAM, WIDGETS

    texts = [("2x32GB Corsair DDR4 RAM", "memoria"), ("red widget", None), (None, "bolt"), (None, None), ("", "bolt")]
    rows = [(f"{i}-{k}", "EBAY", t, d, 90.0 + k, None) for i, (t, d) in enumerate(texts) for k in range(2)]
    offers = spark.createDataFrame(rows, "listing_id string, platform string, title string, description string, price double, image_url string")
    one = [deals.decide_listings(offers, c) for c in (RAM, WIDGETS)]
    many = rule_index.decide_many(offers, [RAM, WIDGETS])
    assert all("Aggregate [_once" in plan_of(d) for d in one)
    # offers are multiplied by rule sets only as they meet their text's findings
    assert "Generate explode([ram_ddr4" not in plan_of(many)
    told = lambda d: {(r["rules"], r["listing_id"]): (r["status"], r["step"], r["score"], r["config"], r["budget"], r["reason"]) for r in d.collect()}
    got = told(one[0]) | told(one[1])
    assert got == told(many) and len(got) == 2 * len(rows)
    assert got["ram_ddr4", "0-0"][:3] == ("ACCEPT", "accept", 88) and got["widgets", "3-0"][1] == "rules"


def test_upserts_carry_the_time_of_a_row_once(spark):
    """Rows that lack no value are picked as one; a value that the first row lacks still comes from the next that has it."""
    from bazaarlens.operators import upsert

    names = "alias string, source string, family_key string, variant_key string, confidence double, seen_at string, row_id string"
    rows = [("A b", "s", None, "v1", 0.5, "2020-01-02", "r2"), ("a  B", "s", "f2", "v2", 0.9, "2020-01-03", "r3"), ("a-b", "s", None, None, 0.1, "2020-01-01", "r1"),
            ("a_b", "s", "f9", "v9", 0.2, "2020-01-09", "r9"), ("c d", "s", "f1", "v1", 0.2, "2020-01-01", "r1")]
    frame = spark.createDataFrame(rows, names)
    at_once = upsert.upsert_aliases(None, frame)
    plan = plan_of(at_once)
    assert "min_by(" not in plan and "_own" in plan
    later_first = upsert.upsert_aliases(upsert.upsert_aliases(None, frame.where("seen_at > '2020-01-02'")), frame.where("seen_at <= '2020-01-02'"))
    for df in (at_once, later_first):
        assert df.columns == ["alias_norm", "source", "alias", "family_key", "variant_key", "confidence", "first_seen", "last_seen", "set_at"]
        got = {r["alias_norm"]: r for r in df.collect()}
        assert tuple(got["a b"])[2:8] == ("a-b", "f2", "v1", 0.9, "2020-01-01", "2020-01-09")
        assert got["a b"]["set_at"].asDict()["family_key"] == ("2020-01-03", "r3") and tuple(got["c d"])[2:5] == ("c d", "f1", "v1")


def test_classification_reaches_its_summary(spark):
    """Category, ambiguity and warnings of the listings are what the summary shows, as its SQL works them out."""
    import duckdb

    from bazaarlens.plans import QUERIES
    from bazaarlens.plans.text_queries import CLASSIFIED_SQL, WARNED_SQL

    titles = [
        "NVIDIA RTX 3070", "RTX 3080 10GB", "RTX 3090 gddr banco kit da 12", "gpu 8gb vram 256gb vram", "RAM DDR4 16GB", "memoria ram per vram",
        "Monitor 27 pollici 144 Hz", "monitor", "Makita trapano 18V", "cavo lungo", "MPN: AB123456 cavo", "cavo EAN 12345678", "cavo HTTPX-12345", "so-dimm ddr4",
    ]
    rows = spark.createDataFrame([(i, t, "x", "") for i, t in enumerate(titles)], "listing_id int, title string, category string, description string")
    got = promotion.classification_summary(promotion.classify_listings(rows)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE listings_v AS SELECT unnest($1) AS title, 'x' AS category, '' AS description", [titles])
    want = con.execute(f"WITH {CLASSIFIED_SQL} SELECT category, count(*), count(*) FILTER (unsure OR NOT (facts OR identified)), sum({WARNED_SQL}) FROM f GROUP BY 1").fetchall()
    assert sorted(map(tuple, got)) == sorted((c, n, a, int(w)) for c, n, a, w in want)
    assert sum(r["warnings"] for r in got) > 3 and sum(r["ambiguous"] for r in got) > 2
    assert QUERIES["classification_summary"](spark, "/root/testdata/sf0.001").columns == ["category", "total", "ambiguous", "warnings"]


def test_descriptions_are_scored_once_for_all_their_titles(spark, monkeypatch):
    """No table of the resolver has a row for each text and each term that scores in it."""
    from bazaarlens.operators import resolver

    near, solo = ([(f"{n}{i}", "", f"{name}{i}{end}", 0.9) for i in range(20)] for n, name, end in (("n", "acme red widget k", ""), ("s", "w", " solo")))
    families = spark.createDataFrame(near + solo, "family_id string, brand string, family_name string, confidence double")
    variants = spark.createDataFrame([], "variant_id string, family_id string, variant_name string, confidence double")
    aliases = spark.createDataFrame([], "alias_id string, family_id string, variant_id string, alias string, source string, confidence double")
    codes = spark.createDataFrame([], "family_id string, variant_id string, identifier_type string, identifier_value string, source string, confidence double")
    index = resolver.build_index(families, variants, aliases, codes)
    texts = spark.createDataFrame([(f"t{i}", f"w{i}", "acme red widget") for i in range(20)], "text_id string, title string, description string")
    keep, rows = resolver.stored, []

    def counted(df):
        out = keep(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(resolver, "stored", counted)
    got = resolver.resolve_texts(texts, index, families).collect()
    assert len(got) == 100 and {r["n_candidates"] for r in got} == {20} and {r["rank"] for r in got} == {1, 2, 3, 4, 5}
    assert max(rows) < 200


def test_long_and_short_sides_meet_the_same_terms(spark, monkeypatch):
    from bazaarlens.operators import resolver

    terms = [("red widget", ["red", "widget"]), ("blue red rod bolt", ["blue", "bolt", "red", "rod"]), ("gear", ["gear"])]
    index = spark.createDataFrame(terms, "term_norm string, tokens array<string>")
    sides = spark.createDataFrame([(s, s.split()) for s in ("red widget gear", "rod red blue", "blue rod", "widget")], "side string, words array<string>")
    found = []
    for most in (40, 2, 0):
        monkeypatch.setattr(resolver, "SHORT_SIDE", most)
        found.append({(r["side"], r["term_norm"]) for r in resolver.side_hits(sides, index, resolver.IN_TITLE).collect()})
    assert found[0] == found[1] == found[2] == {("red widget gear", "red widget"), ("red widget gear", "gear"), ("rod red blue", "blue red rod bolt")}
