"""Operators that compare rows: brute force on small tables, hot groups and edge cases."""

import itertools
import json
import random
import re

import numpy as np
import pytest

from bazaarlens.llm import grid_order, template_leaks, token_groups, tool_calls
from bazaarlens.llm.components import components
from bazaarlens.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.001"


def least_reached(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (None, 5), (200, 203), (203, 202), (203, 202)]
    links += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = least_reached({n for p in real for n in p}, real)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def word_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(zip(*(words[k:] for k in range(n)))) if len(words) >= n else frozenset([tuple(words)])


def brute_jaccard(rows, n, percent):
    sets = [(i, word_set(t, n)) for i, t in rows]
    links = []
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        both = len(a & b)
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            links.append((i, j))
    low = least_reached({i for i, _ in sets}, links)
    return {i: (len(s), low[i]) for i, s in sets}


def test_jaccard_links_over_rows_without_ids(spark):
    """Two texts that are too far apart to link, and one between them whose doc_id is null."""
    words = [f"w{i}" for i in range(300)]
    between, other = list(words), list(words)
    between[10] = between[60] = "x"
    other[10] = other[60] = "x"
    other[110] = other[160] = "y"
    rows = [(1, " ".join(words)), (None, " ".join(between)), (9, " ".join(other)), (None, "alone")]
    assert brute_jaccard([(i, t) for i, t in rows if i], 3, 96)[9][1] == 9
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in token_groups.jaccard_components(docs, 3, 96).collect()}
    assert got == {(1, 1), (None, 1), (9, 1), (None, None)}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, n, percent):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(60)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for base in range(14):  # clusters with more and more changes, around the threshold
        words = [rng.choice(vocabulary) for _ in range(rng.choice([8, 20, 40, 120]))] + (common if base % 3 == 0 else [])
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, " \n", "A b", "a B", "a", rows[0][1].upper(), "é x y", "É x y"])]
    want = brute_jaccard(rows, n, percent)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, `set` long, leader long")
    got = token_groups.jaccard_components(docs, n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_hot_cluster_and_small_groups(spark, monkeypatch):
    """One cluster of near copies over several groups, with outsiders that share its passage."""
    monkeypatch.setattr(token_groups, "GROUP", 8)
    rng = random.Random(4)
    base = [f"v{rng.randint(0, 500)}" for _ in range(100)]
    rows = []
    for i in range(90):
        copy = list(base)
        copy[rng.randrange(100)] = f"z{i}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(base[:40] + [f"u{i}_{k}" for k in range(60)])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_groups.jaccard_components(docs, 3, 90).collect()
    want = brute_jaccard(rows, 3, 90)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_edges(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(5, long), (3, long + " end"), (3, long + " end"), (None, long), (None, None), (8, "x" * 150_000)]
    got = token_groups.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    found = sorted(((r["doc_id"], r["component_id"]) for r in got), key=str)
    assert found == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (None, None), (8, 8)], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_groups.jaccard_components(empty, 3, 90).count() == 0


def test_segments_meet_for_every_linked_pair():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for _ in range(300):
            size = int(rng.integers(10, 200))
            a = rng.integers(1, 1 << 62, size).astype(np.uint64)
            b = np.concatenate([a[: int(size * percent / 100) + 1], a[:0]]) if rng.random() < 0.5 else a.copy()
            change = int((len(a) + len(b)) * (100 - percent) / (100 + percent) - (len(a) - len(b))) // 2
            b[: max(0, change)] = rng.integers(1, 1 << 62, max(0, change))
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            flat, offsets = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            found, owner, level, need = token_groups.segment_signatures(flat, offsets, percent)
            met = [
                len(set(found[(owner == 0) & (level == k)].tolist()) & set(found[(owner == 1) & (level == k)].tolist()))
                >= need[level == k].max()
                for k in set(level[owner == 0].tolist()) & set(level[owner == 1].tolist())
            ]
            assert any(met)


def brute_vectors(rows, least):
    good = [(i, k, np.array(v, float)) for i, v, k in rows if v is not None and None not in v and k is not None]
    good = [(i, k, v) for i, k, v in good if np.isfinite(v).all() and v.any()]
    links = [
        (i, j)
        for (i, k, v), (j, m, w) in itertools.combinations(good, 2)
        if k == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= least
    ]
    low = least_reached({i for i, _, _ in rows}, links)
    return {i: (sum(i in p for p in links), low[i], low[i] == i) for i, _, _ in rows}


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(grid_order, "BLOCK_ROWS", 16)
    monkeypatch.setattr(grid_order, "LEAF", 4)
    rng = np.random.default_rng(1)
    rows = []
    for k in range(24):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            v = centre + rng.normal(size=16) * rng.choice([0.0, 0.03, 0.2])
            rows.append((len(rows), [float(x) for x in v * rng.choice([1, 3])], int(k % 3)))
    for v, label in (
        (None, 1), ([0.0] * 16, 1), ([float("nan")] + [1.0] * 15, 1), ([float("inf")] * 16, 0), ([None] + [1.0] * 15, 0),
        ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1.0] * 16, None), ([1.0] * 16, None), ([1e200] * 16, 2), ([1e-200] * 16, 2), ([], 0),
    ):
        rows.append((len(rows), v, label))
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int, class long")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in grid_order.near_duplicates(frame, 0.98).collect()}
    want = brute_vectors([r for r in rows if r[0] < len(rows) - 3], 0.98)
    assert {i: got[i] for i in want} == want
    # lengths whose squares overflow or vanish are scaled first
    assert got[len(rows) - 3][:2] == got[len(rows) - 2][:2] == (1, len(rows) - 3)
    assert grid_order.near_duplicates(frame.limit(0), 0.98).count() == 0


def test_vector_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, FOLDER, "embeddings").limit(200).collect()]
    frame = spark.createDataFrame(rows + [(1000 + i, v, k) for i, v, k in rows[:20]], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in grid_order.near_duplicates(frame, 0.98).collect()}
    assert got == brute_vectors([tuple(r) for r in frame.collect()], 0.98)


ITEM = "Anna has 12 red apples and gives 5 apples to Peter, so how many red apples are left for Anna after 3 days?"


def test_templates_catch_new_parameters(spark):
    other = ITEM.replace("Anna", "Maria").replace("12", "40").replace("Peter", "Omar Khan").replace(" 5 ", " seven ")
    mixed = ITEM.replace("has 12", "has 40", 1).replace("for Anna", "for Maria")
    rows = [
        (1, "Some words before. " + ITEM + " And after."),
        (2, "Some words before. " + other),
        (3, "An unrelated text about apples and days that has nothing of the question in it at all, really nothing."),
        (4, "NAMES Only Here Are Many Words Like This One And That One And More Of Them In A Row"),
        (5, mixed.replace("gives", "hands").replace("left", "there")),
        (1, "Some words before. " + ITEM + " And after."),
        (None, ITEM), (6, None), (7, ""), (8, (ITEM + " ") * 500),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    items = [(10, ITEM), (11, ITEM), (12, None), (13, ""), (None, ITEM), (14, "1 2 3 4 5 6 7 8"), (15, "just three words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in template_leaks.find_leaks(docs, bench).collect()}
    assert got == {(1, 10), (2, 10), (8, 10)}
    assert template_leaks.find_leaks(docs, bench.limit(0)).count() == 0
    assert template_leaks.find_leaks(docs.limit(0), bench).count() == 0


def test_inconsistent_slots_are_no_leak(spark):
    item = "if 5 workers need 9 days then 5 workers build 9 walls and 5 workers build 9 more walls in 9 days"
    same = item.replace("5", "8").replace("9", "4")
    broken = "if 1 workers need 2 days then 3 workers build 4 walls and 5 workers build 6 more walls in 7 days"
    docs = spark.createDataFrame([(1, same), (2, broken)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["doc_id"] for r in template_leaks.find_leaks(docs, bench).collect()] == [1]


def test_leaks_by_names_that_open_sentences_and_by_case(spark):
    opening = "Tom buys 4 pens. Tom sells 2 pens. Tom finds 7 pens."
    inner = "Every day Tom walks to Anna, then Anna calls Peter, and Peter meets Tom again near Paris."
    other = opening.replace("Tom", "Maria").replace("4", "9").replace("2", "3").replace("7", "5")
    mixed = other.replace("Maria", "Omar", 1).replace("Maria", "Eva", 1)
    texts = [other, "before it " + opening.lower() + " and after", mixed, inner.lower(), inner.upper(), "Tom buys pens. Maria sells pens."]
    docs = spark.createDataFrame([(i, f"Read this. {t}") for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, opening), (2, inner)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in template_leaks.find_leaks(docs, bench).collect()}
    assert got == {(0, 1), (1, 1), (3, 2), (4, 2)}


def test_verbatim_copies_of_items_without_templates(spark):
    items = ["What is 12 times 7?", "\u5317\u4eac\u662f\u4e2d\u56fd\u7684\u9996\u90fd\u5417", "Yes, 4 of 9", "1 2 3 4 5 6 7 8 9", "Two"]
    texts = [f"Asked:{t} so it is" for t in items] + ["What is 13 times 7? Yes, 4 of 8", f"\u8bf7\u95ee{items[1]}\u8c22\u8c22"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in template_leaks.find_leaks(docs, bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (6, 1)}


def test_edited_slots_and_repeated_rows_keep_other_windows(spark):
    item = (
        "A farmer named Anna keeps 12 brown hens in one yard and sells the eggs of her 12 hens to the baker, who pays 3 coins for each "
        "of them and gives Anna a loaf of bread when the week is over and all the baskets are empty again"
    )
    work = "if 5 workers need 9 days then 5 workers build 9 walls and 5 workers build 9 more walls in 9 days"
    first, second = work.replace("5", "8").replace("9", "4"), work.replace("5", "6").replace("9", "3")
    rows = [(1, item.replace("her 12 hens", "her 14 hens")), (2, first), (2, second), (3, first)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, work)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in template_leaks.find_leaks(docs, bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 2)}


def test_each_text_of_a_repeated_item_is_found(spark):
    short = "The lantern keeper writes seven letters before the storm arrives"
    long = " ".join(f"{a} {b} walks slowly" for a in ("grey", "old", "calm", "kind", "shy") for b in ("fox", "owl", "hare"))
    bench = spark.createDataFrame([(1, short), (1, long), (2, "Nothing here is like the others at all today")], "item_id long, text string")
    docs = spark.createDataFrame([(7, f"Before. {short}. After."), (8, f"So {long} then"), (9, "A clean text")], "doc_id long, text string")
    found = template_leaks.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(7, 1), (8, 1)}
    # each by the windows of its own text
    assert all(r["matched"] == r["item_windows"] for r in found)


def test_leaks_of_the_given_tables(spark):
    folder = "/root/testdata/sf0.01"

    def words(text):
        return " " + " ".join(re.findall(r"\w+", (text or "").lower())) + " "

    items = [(r["item_id"], words(r["text"])) for r in table(spark, folder, "benchmark").collect()]
    want = {(r["doc_id"], i) for r in table(spark, folder, "documents").collect() for i, t in items if t in words(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontamination"](spark, folder).collect()}
    assert got == want


def message(conv, turn, role, text):
    return (conv, turn, role, text if text is None or isinstance(text, str) else json.dumps(text), "x")


def call(id_, name, arguments, after=None):
    return {"id": id_, "name": name, "arguments": arguments, "after": after or []}


def test_tool_calls(spark):
    rows = [
        message(1, 0, "user", "hello"),
        message(1, 1, "assistant", {"tool_calls": [call("b", "add", {"y": 2, "x": 1.50}, ["a"]), call("a", "add", {"x": 1, "y": "no"})]}),
        message(1, 2, "tool", {"tool_call_id": "a", "content": "r1"}),
        message(1, 3, "tool", {"tool_call_id": "b", "content": "r2"}),
        message(1, 4, "tool", {"tool_call_id": "b", "content": "again"}),
        message(1, 5, "tool", {"tool_call_id": "gone", "content": "?"}),
        message(1, 6, "assistant", {"tool_calls": [call("c", "fly", {}), call("d", "add", {"x": 1, "z": {"q": [1, {"b": 1, "a": 2}]}})]}),
        message(2, 0, "assistant", {"tool_calls": [call("p", "add", {"x": 1, "y": 1}, ["q"]), call("q", "add", {"x": 1, "y": 1}, ["p"])]}),
        message(3, 0, "assistant", {"tool_calls": [call("m", "add", "[1]", ["m", "unknown"])]}),
        message(None, 0, "user", "x"), message(4, None, "user", "x"), message(4, 0, None, "x"), message(4, 1, "user", None),
        message(1, 0, "user", "hello"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name string")
    schemas = {"add": (("x", "number", True), ("y", "number", True)), **tool_calls.PLAIN_SCHEMAS}
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.format_tool_calls(frame, schemas).collect()}
    assert got[1, "a"]["status"] == "linked" and got[1, "a"]["errors"] == "type y"
    assert (got[1, "a"]["place"], got[1, "a"]["level"]) == (1, 0) and (got[1, "b"]["place"], got[1, "b"]["level"]) == (1, 1)
    assert got[1, "b"]["n_results"] == 2 and got[1, "b"]["result_turn"] == 3
    assert got[1, "b"]["canonical_json"] == '{"arguments":{"x":1.5,"y":2},"id":"b","name":"add","result":"r2","status":"linked"}'
    assert got[1, "gone"]["status"] == "orphan" and got[1, "c"]["errors"] == "unknown tool"
    assert got[1, "d"]["errors"] == "missing y; unexpected z"
    assert '"z":{"q":[1,{"a":2,"b":1}]}' in got[1, "d"]["canonical_json"]
    assert got[1, "0"]["n_calls"] == 2 and got[1, "0"]["status"] == "unanswered"
    assert got[2, "p"]["place"] is None and got[2, "q"]["level"] is None
    assert got[3, "m"]["errors"] == "arguments are no object" and got[3, "m"]["level"] == 0
    assert got[4, "1"]["errors"] == "missing text"
    assert (4, "0") not in got and len(got) == 10
    assert tool_calls.format_tool_calls(frame.limit(0), schemas).count() == 0


def test_chain_of_late_calls(spark):
    """Each call needs the next one: the order is turned round, step by step."""
    calls = [call(f"c{i}", "instruct", {"text": "t", "turn": i}, [f"c{i + 1}"] if i < 6 else []) for i in range(7)]
    frame = spark.createDataFrame([message(1, 0, "assistant", {"tool_calls": calls})], "conv_id long, turn long, role string, text string, x string")
    got = {r["call_id"]: r["level"] for r in tool_calls.format_tool_calls(frame).collect()}
    assert got == {f"c{i}": 6 - i for i in range(7)}


def test_pipeline_keeps_and_drops(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "private_data", "pieces"]
    kept = stages["near_duplicates"](spark, docs, folder)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sizes = {i: len(word_set(t, 5)) for i, t in rows}
    by_size = sorted(rows, key=lambda r: sizes[r[0]])
    sets = {i: word_set(t, 5) for i, t in rows}
    links = []
    for k, (i, _) in enumerate(by_size):
        for j, _ in by_size[k + 1 :]:
            if sizes[i] < 0.8 * sizes[j]:
                break
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (sizes[i] + sizes[j] - both):
                links.append((i, j))
    low = least_reached(sizes, links)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in low if low[i] == i)
    clean = stages["decontamination"](spark, docs, folder)
    leaking = {r["doc_id"] for r in QUERIES["op8_decontamination"](spark, folder).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - leaking and clean.columns == docs.columns
    assert stages["private_data"](spark, docs, folder).columns == docs.columns
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and 0.5 * len(rows) < out.count() < len(rows)


def test_near_duplicate_stage_edges(spark):
    import corpus_pipeline

    text = "one two three four five six seven eight nine ten"
    rows = [(2, text), (2, text), (1, text.upper()), (None, text), (4, None), (5, ""), (6, ""), (7, "short"), (7, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, `set` long")
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, None, 4, 5, 6, 7], key=str)
    assert kept.columns == docs.columns
