"""Operators over grammars and trees: runs of words, byte-level BPE, repair of conversations."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from bazaarlens.llm import byte_tree
from bazaarlens.llm.pair_grammar import build_grammar
from bazaarlens.llm.queries import QUERIES, byte_model_path, damaged, table, with_periods
from bazaarlens.llm.turn_repair import repair_turns, summarise
from bazaarlens.llm.word_runs import find_runs, word_runs

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# grammar


def test_grammar_spells_its_sequences():
    draw = random.Random(5)
    for _ in range(60):
        given = [[draw.randrange(4) for _ in range(draw.choice([0, 1, 2, 30, 200]))] for _ in range(6)]
        given += given[:2]
        owner = np.repeat(np.arange(len(given)), [len(g) for g in given])
        grammar = build_grammar(np.array(sum(given, []), np.int64), owner, len(given), 4)

        def spell(x):
            if x < 4:
                return [int(x)]
            return spell(grammar.left[x - 4]) + spell(grammar.right[x - 4])

        assert [spell(r) if r >= 0 else [] for r in grammar.roots] == given
        assert grammar.roots[:2].tolist() == grammar.roots[-2:].tolist()  # equal sequences share their rule


# runs


def plain_runs(w, least=6, times=4):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                found.setdefault((s, i + q - s), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_equal_brute_force():
    draw = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(draw.randint(1, 5)):
            k = draw.choice([1, 2, 2, 3, 5])
            w = [draw.randrange(k) for _ in range(draw.randint(0, 60))]
            if draw.random() < 0.5:
                w[len(w) // 2 : 0] = [draw.randrange(k) for _ in range(draw.randint(1, 6))] * draw.randint(2, 9)
            docs.append(w * draw.choice([1, 1, 1, 4]))
        flat = np.array(sum(docs, []), np.int64)
        sizes = [len(d) for d in docs]
        seq, start, length, period = find_runs(flat, np.repeat(np.arange(len(docs)), sizes), len(docs))
        begin = np.cumsum([0, *sizes])
        got = [[] for _ in docs]
        for k, s, n, q in zip(seq, start, length, period):
            got[k].append((int(s - begin[k]), int(n), int(q)))
        assert got == [plain_runs(d) for d in docs]


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_odd_rows(spark):
    long_ = "a b c " * 30_000
    rows = [
        (1, None, "x"), (2, "", "x"), (None, "ha " * 9, "x"), (3, " \t\x0b\n ", "x"), (4, "ha ha ha ha ha", "x"),
        (5, long_, "x"), (5, long_, "x"), (6, "one two one two " * 3, "x"),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, runs string, n_words long, __text long")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in word_runs(df).collect()), key=str)
    want = []
    for i, t, _ in rows:
        w = WORDS.findall(t or "")
        runs = [(0, 90_000, 3)] if i == 5 else plain_runs(w)
        want.append((i, len(w), runs, collapsed(w, runs)))
    assert got == sorted(want, key=str)
    assert word_runs(df.limit(0)).count() == 0


def test_runs_query_equals_brute_force(spark):
    want = []
    for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect():
        words = WORDS.findall(r.text or "")
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = None
        for s, m, q in runs:
            if best is None or m * best[2] > best[1] * q:
                best = (s, m, q)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((r.doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(words, runs))))
    got = [tuple(r) for r in QUERIES["op11_runs"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(want)
    assert any(r[1] for r in got)


def test_periods_leave_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (21, None), (21, "")], "doc_id long, text string")
    assert sorted(map(str, (r.text for r in with_periods(df).collect()))) == ["", "None", "a b c"]


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_model_path())


def test_bytes_equal_library(library):
    model = byte_tree.load_model(byte_model_path())
    draw = random.Random(3)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ab", "aeiou ", "0123456789", "ABCDEFabcdef0123456789+/", "éèüß日本語漢字", "!?.,-_", "\t\n   "]
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|>b<|endoftext|><|endof", "don't 'sx", "x" * 5000, "\U0001f600" * 300, "aaaab" * 900]
    for _ in range(600):
        letters = draw.choice(kinds) + (draw.choice(kinds) if draw.random() < 0.3 else "")
        texts.append("".join(draw.choice(letters) for _ in range(draw.choice([3, 50, 300, 3000]))))
    ids, offsets = model.encode_batch(texts)
    decoded = model.decode_batch(ids, offsets)
    for k, (t, e) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == e.ids, t[:80]
        assert decoded[k] == library.decode(e.ids, skip_special_tokens=False)


def test_joins_grow_until_both_sides_agree(library):
    """With leaves of one byte every token is made by joins alone."""
    model = byte_tree.ByteModel(byte_model_path())
    texts = ["internationalisation" * 12, "0" * 777, "qwertyuiopqwertyuiop", "é" * 100]
    leaf, byte_tree.LEAF = byte_tree.LEAF, 1
    try:
        ids, offsets = model.encode_batch(texts)
    finally:
        byte_tree.LEAF = leaf
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_bytes_of_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x" * 200_000), (3, "x" * 200_000), (4, "word " * 40_000)]
    df = spark.createDataFrame([(*r, "i", "d", 1) for r in rows], "doc_id long, text string, ids string, decoded string, __text long")
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in byte_tree.encode_bytes(df, byte_model_path()).collect()), key=str)
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows), key=str)
    assert got == want
    assert byte_tree.encode_bytes(df.limit(0), byte_model_path()).count() == 0


def test_bytes_query_equals_library(spark, library):
    want = []
    for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, QUERIES["op12_bytes"](spark, FOLDER).collect())) == sorted(want)


# conversations


def plain_repair(rows):
    """Faults and the cheapest, ASCII-least audit of rows (turn, role, text) by trying all states."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    ways = {"": (0, "", ())}  # what was kept so far, folded: '' nothing, s, u, a

    def allowed(state, c):
        return c == "s" and state == "" or c == "u" and state in ("", "s", "a") or c == "a" and state == "u"

    def inserted(ways):
        ways = dict(ways)
        for _ in range(4):
            for state, (cost, audit, lines) in list(ways.items()):
                for c, name in (("u", "user"), ("a", "assistant")):
                    new = (cost + 5, audit + "I", (*lines, name + ":"))
                    if allowed(state, c) and (c not in ways or new < ways[c]):
                        ways[c] = new
        return ways

    for (_, role, text), fault in zip(rows, faults):
        ahead = {}

        def offer(state, way):
            if state not in ahead or way < ahead[state]:
                ahead[state] = way

        for state, (cost, audit, lines) in inserted(ways).items():
            offer(state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if role[:1] and allowed(state, role[:1]):
                offer(role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            for c, name in (("u", "user"), ("a", "assistant")):
                if allowed(state, c):
                    offer(c, (cost + 1 + more, audit + "R", (*lines, f"{name}:{text}")))
        ways = ahead
    cost, audit, lines = min(w for s, w in inserted(ways).items() if s in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines)))


def test_repair_equals_brute_force(spark):
    draw = random.Random(7)
    rows = []
    for conv in range(300):
        for turn in range(draw.choice([1, 2, 5, 9, 14])):
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", ""])
            text = draw.choice(["", " \n", "Yes.", "No", "Why?", f"Say {turn}.", f"Cut {turn}", f"Ok {turn}!\n"])
            rows.append((conv, draw.choice([turn, turn, turn, turn + 3, None]), role, text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted((c, *plain_repair([r[1:] for r in rows if r[0] == c])) for c in range(300))
    assert sorted(map(tuple, summarise(repair_turns(df)).collect())) == want
    # batches of a few rows: conversations go on over many of them
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, summarise(repair_turns(df)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repair_of_odd_rows(spark):
    names = "conv_id long, turn long, role string, text string, copies long, fault string, part long, matrix string"
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (1, 0, None, "Hi."), (1, 1, "assistant", None),
        (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 1, "assistant", "x " * 50_000 + "."),
    ]
    df = spark.createDataFrame([(*r, 1, "f", 2, "m") for r in rows], names)
    got = {r[0]: tuple(r)[1:] for r in summarise(repair_turns(df)).collect()}
    for conv in (None, 1, 2):
        assert got[conv] == plain_repair([(t, r or " ", x or " ") for c, t, r, x in rows if c == conv])
    assert summarise(repair_turns(df.limit(0))).count() == 0
    counted = df.where("conv_id = 2").dropDuplicates(["turn", "text"])
    counted = counted.withColumn("copies", (3 - 2 * counted.turn).cast("long"))
    assert tuple(summarise(repair_turns(counted, copies="copies")).first())[1:] == got[2]


def test_conversation_query_equals_brute_force(spark):
    held = {}
    for r in table(spark, FOLDER, "conversations").collect():
        rows = held.setdefault(r.conv_id, [])
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        if kind:
            rows += [(r.turn, "user" if kind == 4 else r.role, text)] * (2 if kind == 3 else 1)
    want = [(c, *plain_repair(rows)) for c, rows in held.items()]
    assert sorted(map(tuple, QUERIES["op13_conversations"](spark, FOLDER).collect())) == sorted(want)


def test_damage_keys_nulls_as_spaces(spark):
    df = spark.createDataFrame([(None, None, None, None), (0, 4, "user", "a")], "conv_id long, turn long, role string, text string")
    kinds = [zlib.crc32(k) % 20 for k in (b" : ", b"0:4")]
    assert damaged(df).count() == sum(k != 0 for k in kinds)
