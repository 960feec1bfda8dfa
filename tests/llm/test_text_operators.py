"""Operators that look at one text at a time: exact results and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from bazaarlens.llm import language_bloom, page_consensus, pii_crf, toxicity
from bazaarlens.llm.piece_codec import encode_pieces, load_model
from bazaarlens.llm.quality_cotrain import fit_quality, keep_good, score_quality
from bazaarlens.llm.queries import QUERIES, piece_model_path, table

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, an empty text, a very long one, repeated rows, and columns whose names could clash."""
    rows = [
        (1, "The cat sat. Mail a@b.example.com now", "en", "s", 1),
        (1, "The cat sat. Mail a@b.example.com now", "en", "s", 1),
        (2, None, None, None, None),
        (3, "", "de", "s", 0),
        (None, "12345", "fr", None, 5),
        (4, "word " * 40_000, "en", "s", 200_000),
        (5, "x" * 120_000, None, "s", 120_000),
    ]
    names = "ids long, score long, label string, class string, component long, `set` long, spans string, __x long"
    return spark.createDataFrame([(*r, 1, 2, "l", "c", 3, 4, "s", 5) for r in rows], f"{DOCS}, {names}")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 1, 1), (3, 0, None), (4, None, 1), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int"
    )


def test_pieces_equal_the_library(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    model = load_model(piece_model_path())
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab the▁é漢 \n\t🙂ñ<s>1.  ") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["ababab" * 500, " " * 100, "", "\n\n", "a" * 3000]
    ids, offsets, decoded = model.encode_batch(texts)
    want = sp.encode(texts, num_threads=1)
    for i, w in enumerate(want):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == w
        assert decoded[i] == sp.decode(w) == model.decode(w)
    got = {r["doc_id"]: r for r in encode_pieces(odd, piece_model_path()).collect()}
    assert got[2]["ids"] == [] and got[3]["decoded"] == "" and got[5]["decoded"] == "x" * 120_000


def test_piece_query_digests(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, FOLDER, "documents").collect()}
    for r in QUERIES["op3_sentencepiece"](spark, FOLDER).collect():
        ids = sp.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def plain_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii_crf.luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("a.@-_1234 5+()é%") for _ in range(rng.randint(0, 30)))
        assert pii_crf.base_spans(text) == plain_spans(text)


def test_field_learns_its_table_and_leaves_numbers_alone():
    field = pii_crf.train()
    hits = total = 0
    for line in pii_crf.LABELLED:
        text, spans = pii_crf.read_marked(line)
        _, found = next(pii_crf.all_spans([text], field))
        hits += set(found) >= set(spans)
        total += 1
    assert hits >= 0.95 * total
    text = "tel (040) 555-9911 and order 123456789 of 2024-01-02, token=04dbebab91ab85687d33"
    _, found = next(pii_crf.all_spans([text], field))
    assert [(k, text[a:b]) for k, a, b in found] == [("phone", "(040) 555-9911")]


def test_private_data_edges_and_redaction(spark, odd):
    got = {r["doc_id"]: r for r in pii_crf.find_private(odd).collect()}
    assert [tuple(s) for s in got[1]["base"]] == [("email", 18, 33)]
    assert got[2]["spans"] == [] and got[3]["spans"] == []
    clean = pii_crf.redact(odd)
    assert clean.schema == odd.schema
    rows = clean.where("doc_id = 1").collect()
    assert len(rows) == 2 and rows[0]["text"] == "The cat sat. Mail [EMAIL] now" and rows[0]["n_chars"] == 29
    assert clean.where("doc_id = 2").first()["text"] is None
    assert pii_crf.find_private(odd.limit(0)).count() == 0


def test_toxicity_weighs_words_of_few_texts(spark):
    calm = ["the quiet river runs past the mill", "we walk to the market on sunday", "a letter came from the coast"]
    rows = [(i, f"{calm[i % 3]} number {i} " + ("blorgface" if i % 200 == 0 else "vexwit" if i % 2 == 0 else "")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(3000)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, marks)
    # one toxic text in 100 holds the first word; its score must stand clear of that of a clean text
    asked = spark.createDataFrame([(1, "you blorgface"), (2, "the quiet river")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(asked, model).collect()}
    assert scores[1] > 0.5 > scores[2]


def test_toxicity_finds_planted_words(spark, odd, labels):
    words = ["idiot scum", "trash loser"]
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "cat", "dog", "ran", "home", "tree"]) for _ in range(40)) for _ in range(400)]
    rows = [(i, t + (" " + words[i % 2] if i % 4 == 0 else ""), "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in got)
    scores = toxicity.score_toxicity(odd, model).collect()
    assert len(scores) == 7 and all(0 <= r["score"] <= 1 for r in scores)
    one_kind = toxicity.fit_toxicity(odd, labels.where("doc_id = 9"))
    assert set(one_kind.scores(["a", ""])) <= {0.0} | {float(x) for x in one_kind.scores(["a"])}
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0


def test_held_out_is_the_crc_fold(spark):
    rows = spark.range(200).select("id", toxicity.is_held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_language_of_held_out_documents(spark, odd):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    filters = language_bloom.fit_languages(documents)
    got = language_bloom.identify_language(documents, filters, keep=("doc_id", "lang"))
    rows = got.where(toxicity.is_held_out("doc_id")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    odd_rows = {r["doc_id"]: r for r in language_bloom.identify_language(odd, filters).collect()}
    assert odd_rows[2]["lang_pred"] == odd_rows[3]["lang_pred"] == odd_rows[None]["lang_pred"] == "und"
    assert odd_rows[2]["score"] == 0 and odd_rows[4]["lang_pred"] in filters.languages
    nothing = language_bloom.fit_languages(odd.limit(0))
    assert {r["lang_pred"] for r in language_bloom.identify_language(odd, nothing).collect()} == {"und"}


def test_bloom_counts_are_corrected():
    masks = np.full((1, 1 << language_bloom.BITS), 1, np.uint64)  # the filter of the first language is full
    filters = language_bloom.LanguageFilters(["a", "b"], masks, "a")
    assert filters.false_rate.tolist() == [1.0, 0.0]
    names, scores = filters.predict(["some words", "\U00030001\U00030001", "123"])
    assert names == ["a", "a", "und"] and scores.tolist() == [0.0, 0.0, 0.0]  # nothing is known: the usual language
    masks[:] |= np.uint64(2)
    masks[0, 0] = 0
    names, scores = language_bloom.LanguageFilters(["a", "b"], masks, "a").predict(["some words"])
    assert not np.isnan(scores).any()


PAGE = (
    "<html><body><header>Site</header><nav>menu</nav><div id='cookie-notice'>We use cookies</div><div class='col-{n}'>"
    "<article class='post'><h1>T &amp; x</h1><p>One <a href=x>two</a> three,<script>if(a<b)</script> &nbsp; four {n}."
    "<div class='ad-box'>buy</div><p>a < b<ul><li>l1<li>l2</ul><form><input>q</form>"
    "<section class='comments'><p>nice</p></section></article></div><footer>f</footer>"
)


def test_main_text_of_pages(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.replace("{n}", str(i))) for i in range(5)]
    rows += [(7, None, None), (8, "no url", "<p>only this"), (9, "https://h.example/9", "<div>" * 20_000), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, path long")
    got = page_consensus.extract_main_text(pages).collect()
    assert len(got) == 9
    by = {r["page_id"]: r["text"] for r in got}
    assert by[3] == "T & x\nOne two three, four 3.\na < b\nl1\nl2"
    assert by[7] == "" and by[8] in ("only this", "") and by[9] == ""
    assert page_consensus.extract_main_text(pages.limit(0)).count() == 0


def test_consensus_overrules_a_page(spark):
    article = "<body><div class=main><p>{}</p></div><div class=long><p>{}</p></div>"
    rows = [(i, f"https://h.example/{i}", article.format("real text of the page, with commas, " * 9, "x")) for i in range(9)]
    rows.append((9, "https://h.example/9", article.format("short real text", "boilerplate that is much longer, " * 9)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_consensus.extract_main_text(pages).collect()}
    assert got[9] == "short real text"


def test_titles_roots_and_link_pages_keep_their_text(spark):
    long = "running text of the article, with commas, " * 9
    post = "<body><p>Site name<div class=post><h1>Title</h1><p class=lead>Lead</p><div class=body><p>{0}</div></div><div class=x><p>other</div>"
    deep = "<body><article><div class=top><h1>Title</h1></div><div class=a><p>Lead</p><div class=b><p>{0}</div></div></article>"
    plain = "<body><h1>Title</h1><div class=main><p>{0}</div><div class=more><p>other</div>"
    links = "<ul><li><a href=/a>First place</a><li><a href=/b>Second place</a></ul>"
    pages = [post, deep, plain, "<p>only this", "<html><h1>Title</h1><p>{0}", f"<body><div>{links}</div>"]
    rows = [(i, f"https://h{i}.example/", p.format(long)) for i, p in enumerate(pages)]
    # one host: pages without a body do not decide for others
    rows += [(10 + i, "https://one.example/", "<p>" + long) for i in range(3)] + [(13, "https://one.example/", plain.format(long))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_consensus.extract_main_text(frame).collect()}
    text = long.strip()
    assert got[0] == got[1] == f"Title\nLead\n{text}"
    assert got[2] == got[4] == got[13] == f"Title\n{text}"
    assert got[3] == "only this" and got[5] == "First place\nSecond place" and got[10] == text


def test_pages_of_the_given_table(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in table(spark, FOLDER, "pages").collect()}
    for r in QUERIES["op6_html"](spark, FOLDER).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_quality_of_held_out_documents(spark, odd, labels):
    folder = "/root/testdata/sf0.01"
    documents = table(spark, folder, "documents")
    marks = table(spark, folder, "labels")
    model = fit_quality(documents, marks)
    rows = score_quality(documents, model).join(marks, "doc_id").where(toxicity.is_held_out("doc_id")).collect()
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in rows) >= 0.95 * len(rows)
    assert len(score_quality(odd, model).collect()) == 7
    kept = keep_good(odd, model, 0.0)
    assert kept.schema == odd.schema and kept.count() == 7
    without = fit_quality(odd, labels.limit(0))
    assert {r["score"] for r in score_quality(odd, without).collect()} == {1.0} or keep_good(odd, without).count() == 7


def test_quality_exchange_is_over_all_documents(spark):
    """One round by hand: surest shares by score bins, trigram sums and gradients, row by row."""
    import numpy as np

    from bazaarlens.llm import quality_cotrain as q

    rows = [(None if i % 50 == 7 else i, ("Good text number " if i % 3 else "#### 12 ") * (1 + i % 4) + str(i % 9), ["a", "b", None][i % 3], "en") for i in range(300)]
    rows += [(1000, None, None, None), (1001, "", "a", None)] + [(1002, "same words here", "a", "en")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    random = np.random.default_rng(3)
    model = q.QualityModel(content=random.normal(size=1 << q.BITS), meta=random.normal(size=q.WIDTH), meta_bias=0.1)
    model.edges = np.sort(random.normal(size=model.edges.shape), axis=1)
    texts, sources, langs = ([r[k] for r in rows] for k in (1, 2, 3))
    texts = [t or "" for t in texts]
    layout = model.meta_columns(q.statistics(texts), sources, langs)
    odds = model.meta[layout].sum(1) + model.meta_bias

    plain = q._one_pass(docs, model, None)
    assert plain.count() == len(rows) and plain.where("bucket IS NOT NULL").count() == 0
    low, high = sure = q._surest(q._meta_odds(plain, model), 0.4, 0.75)
    # bins are 1/64 wide: the share is met, and by no more than the rows of one bin
    assert (odds <= low).sum() >= 0.4 * 0.25 * len(rows) > (odds <= low - 1 / 64).sum()
    assert (odds >= high).sum() >= 0.4 * 0.75 * len(rows) > (odds >= high + 1 / 64).sum()

    passed = q._one_pass(docs, model, sure)
    counts, sums = q._sums(passed)
    bad, good = (odds <= low) & (odds < 0), (odds >= high) & (odds > 0)
    assert counts.tolist() == [bad.sum(), good.sum()] and bad.any() and good.any()
    for k, chosen in enumerate((bad, good)):
        wanted = np.zeros(1 << q.BITS)
        for text in np.array(texts, object)[chosen]:
            _, bucket, sizes = q.trigrams([text])
            assert len(bucket) == len(text)
            for b in bucket.tolist():
                wanted[b] += 1 / sizes[0]
        assert np.allclose(sums[k], wanted, atol=1e-4)

    content = np.array([r["odds"] for r in passed.where("layout IS NOT NULL").collect()])
    assert len(content) == len(rows)
    count, slope = q._gradient(passed.where("layout IS NOT NULL"), model, (-0.5, 0.5))
    own = np.concatenate([np.bincount(o, model.content[b], minlength=1) * q.SCALE / z for o, b, z in (q.trigrams([t]) for t in texts)])
    assert np.allclose(np.sort(content), np.sort(own), atol=1e-6)
    use = (own <= -0.5) | (own >= 0.5)
    wanted = np.zeros(q.WIDTH + 1)
    for z, o, c in zip(layout[use], odds[use], own[use]):
        error = 1 / (1 + np.exp(-o)) - (c > 0)
        wanted[z] += error
        wanted[-1] += error
    assert count == use.sum() and np.allclose(slope, wanted, atol=1e-3)


def test_quality_without_documents_or_unlabelled_rows(spark, labels):
    from bazaarlens.llm import quality_cotrain as q

    schema = "doc_id long, text string, source string, lang string"
    none = spark.createDataFrame([], schema)
    assert score_quality(none, fit_quality(none, labels)).count() == 0
    assert q._surest(spark.createDataFrame([], "odds double"), 0.4, 0.5)[0] >= -q.SPAN
    few = spark.createDataFrame([(i, "plain good words" if i % 2 else "!! ?? 11", "s", None) for i in range(40)], schema)
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = fit_quality(few, marks)
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in score_quality(few, model).collect())


def test_quality_describes_little_text_at_once():
    """A task's arrays do not hold all texts of a batch; what it finds is the same whatever the steps are."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from bazaarlens.llm import quality_cotrain

    texts = [f"line {i} of text {i % 7}\n" * 400 for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    model = quality_cotrain.QualityModel()
    model.content = np.arange(1 << quality_cotrain.BITS) / 1e5
    whole = model.scores(texts, [None] * len(texts), [None] * len(texts))
    found = []
    tracemalloc.start()
    for rows, part in quality_cotrain.text_steps([batch], "text"):
        found.append(model.scores(part, [None] * len(part), [None] * len(part)))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(found) > 4 and (np.concatenate(found) == whole).all()
    assert peak < 60, peak


def worker_of(monkeypatch, make):
    """The function that Spark would hand to its workers."""
    from pyspark.sql.classic.dataframe import DataFrame

    with monkeypatch.context() as m:
        m.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **k: f)
        return make()


def test_workers_forget_what_another_operator_remembers(spark, monkeypatch):
    """One worker runs a pipeline's stages in turn: words and models of one stage do not stay in the next."""
    import pyarrow as pa

    from bazaarlens.llm import quality_cotrain, token_groups

    docs = spark.createDataFrame([(1, "one two", "web", "en")], "doc_id long, text string, source string, lang string")
    pieces = worker_of(monkeypatch, lambda: encode_pieces(docs, piece_model_path()))
    shingles = worker_of(monkeypatch, lambda: token_groups._described(docs, 3, 90))
    quality = worker_of(monkeypatch, lambda: keep_good(docs, quality_cotrain.QualityModel(), 0.0))
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": [1], "text_key": [7], "text": ["one two"], "__text": ["one two"], "source": ["web"], "lang": ["en"]}
    )
    first = list(pieces([batch]))
    assert load_model.cache_info().currsize == 1
    model = load_model(piece_model_path())
    assert list(pieces([batch])) == first and load_model(piece_model_path()) is model  # its own next task finds it
    list(shingles([batch]))
    assert load_model.cache_info().currsize == 0 and len(token_groups._WORDS) == 2
    assert len(list(quality([batch]))) == 1
    assert len(token_groups._WORDS) == 0 and len(token_groups._WORDS.hashes) == 0
    assert list(pieces([batch])) == first


def test_steps_spell_out_one_slice_at_once():
    """Texts of a batch become strings slice by slice, with the slices as before."""
    import tracemalloc

    import pyarrow as pa

    from bazaarlens.llm.common import text_steps

    texts = [None, "", "ü𝄞" * 3] + ["x" * 100_000] * 200 + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    tracemalloc.start()
    sizes, got = [], 0
    for rows, part in text_steps([batch], "text", 1_000_000):
        assert part == [t or "" for t in rows.column(0).to_pylist()]
        sizes.append(sum(map(len, part)))
        got += len(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == len(texts) and max(sizes) <= 1_000_000 and sum(sizes) == 20_000_006
    assert peak < 6_000_000
    assert list(text_steps([batch.slice(0, 0)], "text")) == []


def test_pipeline_takes_small_batches(spark):
    """Rows of an Arrow batch are bounded, and a smaller bound of the session stays."""
    from bazaarlens.llm.common import BATCH_ROWS, small_batches

    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    try:
        for given, wanted in (("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("500", 500)):
            spark.conf.set(name, given)
            found = corpus_pipeline.private_data(spark, docs, "")
            assert int(spark.conf.get(name)) == wanted and found.count() == 1
            small_batches(spark)
            assert int(spark.conf.get(name)) == wanted
    finally:
        spark.conf.set(name, before)
