"""Personal data by fixed patterns plus a linear-chain conditional random field.

Base spans come from one pattern for each kind. The field adds spans the patterns cannot state:
telephone numbers without a plus sign, 13 to 15 digit cards, addresses inside brackets and the
like. It labels words (stretches without white space) with B/I tags of the four kinds. Only words
that hold a digit or an at sign can carry such a tag, so all other words are fixed to O and the
text falls apart into chains of candidate words; decoding each chain alone gives the best path of
the whole text. Chains of many texts are padded into arrays and decoded together by Viterbi.

The field is trained on a small labelled table (LABELLED, or the caller's own): lines in which
`<kind>..</kind>` marks a span. An added span never overlaps a base span or another added one, and must be
possible for its kind (digits in number, checksum, parts of an address).

Null text counts as empty: no spans. Repeated rows give repeated results. Very long words are
handled in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bazaarlens.llm.common import task_of, text_steps

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O",) + tuple(f"{p}-{k}" for k in KINDS for p in "BI")

# Small labelled table: each line is one text, marks give its spans.
LABELLED = (
    "write to <email>anna.bell@mail7.example.com</email> today",
    "mail <email>j_doe+news@example.org</email>, or call",
    "Contact: (<email>info@shop.example.net</email>)",
    "reach me at <email>k.li@localhost</email> from inside",
    "send it to <email>müller@example.de</email> please",
    "from <email>root@backup-host</email> to the list",
    "it costs 5 @ 3.20 each",
    "follow @someone4 for more",
    "version 2@next was tagged",
    "see @home and @work labels",
    "host <ip>10.20.30.40</ip> is down",
    "ping <ip>192.168.0.1</ip>: timeout",
    "server at <ip>129.38.82.176</ip>, port 80",
    "address <ip>97.51.17.173</ip> was seen",
    "release 1.2.3 came after 1.2.2",
    "version 10.4.300.900 is out",
    "build 4.1.2 and 3.14 are old",
    "section 1.2.3.4.5.6 of the book",
    "call <phone>+1 (017) 555-7713</phone> now",
    "phone <phone>+44 20 7946 0958</phone> or mail",
    "tel <phone>(017) 555-7713</phone> after six",
    "Tel: <phone>(974) 555-3436</phone>",
    "call <phone>555-123-4567</phone> for a quote",
    "phone <phone>020 7946 0958</phone> in London",
    "fax <phone>0211 555 77 13</phone> Mo-Fr",
    "mobile <phone>0176-5550-1234</phone> only",
    "ring <phone>(212) 555-0199</phone> and ask",
    "Phone: <phone>555.867.5309</phone>.",
    "number <phone>(030) 555-01234</phone> is free",
    "whatsapp <phone>0044 20 7946 0958</phone> anytime",
    "telephone <phone>01 55 50 12 34</phone> office",
    "call us on <phone>1-800-555-0100</phone> today",
    "card <card>4929 3483 8514 6306</card> expires",
    "pay with <card>4952935900253052</card> please",
    "visa <card>4417744280351547</card>, thanks",
    "amex <card>3782 822463 10005</card> on file",
    "card number <card>371449635398431</card> was used",
    "diners <card>30569309025904</card> declined",
    "amex <card>378282246310005</card> accepted",
    "order 9807915762804491 has shipped",
    "order id 7536784127813051 is late",
    "tracking 123456789012345 was lost",
    "invoice 4845168114407328 unpaid",
    "ticket 30569309025905 closed",
    "account 2023000114 opened",
    "in 1999 and 2004 it rained",
    "from 10 to 20 people in 3 days",
    "on 2024-05-17 at 12:30 we met",
    "born 17.05.1984 in Rome",
    "date 05/17/2024 was a Friday",
    "costs 1,299.00 or 12 x 108.25",
    "about 100 200 300 400 500 600 units",
    "scores 3-1 2-0 4-4 in the cup",
    "table 12 34 56 78 90 11 22",
    "values 0.25 0.50 0.75 1.00 listed",
    "isbn 978-3-16-148410-0 in print",
    "isbn 0-306-40615-2 sold out",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" kept',
    'key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" set',
    "hash cb1a9fee807a05366fcb8b6c95c7c565 matched",
    "uuid 123e4567-e89b-12d3-a456-426614174000 made",
    "commit 4be57a0c and e66d722 merged",
    "model RTX-3080 with 12GB and 8x2",
    "flight LH1234 gate 22 seat 14C",
    "room 555 on floor 12",
    "chapter 5, pages 555-570",
    "years 1914-1918 and 1939-1945",
    "rated 4.5/5 by 1234 readers",
    "temperature -12.5 to 30.25 degrees",
    "area 1200 m2 for 350000 total",
    "zip 90210-1234 area",
    "serial 555-0199-AB77 on the back",
    "population 1 234 567 in 2020",
    "ratio 16:9 at 1920x1080 60Hz",
    "chapter 4 555 words, 7713 characters",
    "phone 5 was sold 3 times",
    "call 911 or 112 first",
    "card 12 of 52 was drawn",
    "he sold 4000 cards in 2019",
    "a mail of 3 May 2020, page 555",
)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is entered at its first digit only: a match from inside a run exists only where one
# from its start does, and no match ends inside a run.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CANDIDATE = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"\S+")
MARK = re.compile(r"<(/?)(email|ip|card|phone)>")
OPEN, CLOSE = "([{<\"'`*|=:,;", ")]}>\"'`*|,;:!?.=#%$&"


def luhn(digits: str) -> bool:
    """Checksum of card numbers."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and start; code points, end exclusive."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        at, end = text.find("@"), 0
        while at >= 0:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at)):
                out.append(("email", start, m.end()))
                end = m.end()
            # local characters do not include the at sign, so runs before different ones are disjoint
            at = text.find("@", max(at + 1, end))
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def candidate_chains(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of consecutive words with a digit or an at sign, trimmed of marks around them.

    A run is given as (word, start, end); the words before and after it come first and last, and are
    empty at the ends of the text.
    """
    before, chain = "", []
    for m in WORD.finditer(text):
        word, start, end = m[0], m.start(), m.end()
        if CANDIDATE.search(word):
            while word[0] in OPEN and not (word[0] == "(" and ")" in word):
                word, start = word[1:], start + 1
            while word[-1] in CLOSE and not (word[-1] == ")" and "(" in word):
                word, end = word[:-1], end - 1
            chain.append((word, start, end))
            continue
        if chain:
            yield [(before, 0, 0), *chain, (word, 0, 0)]
            chain = []
        before = word
    if chain:
        yield [(before, 0, 0), *chain, ("", 0, 0)]


SHAPES = str.maketrans({**{c: "9" for c in "0123456789"}})


def shape(word: str) -> str:
    """Digits as 9, letters as a or A, runs of letters once, runs of digits by length up to 5."""
    out = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a", word.translate(SHAPES))
    return re.sub(r"9{5,}", lambda m: f"9{{{min(len(m[0]) // 4 * 4, 20)}}}", out)


def features(chain: list[tuple[str, int, int]]) -> list[list[str]]:
    """Names of the features of each word of a chain."""
    words = [w for w, _, _ in chain]
    shapes = [shape(w) for w in words]
    digits = ["".join(DIGIT.findall(w)) for w in words]
    total = sum(map(len, digits[1:-1]))
    whole = "".join(digits[1:-1]) if 13 <= total <= 19 else ""
    lead = words[0].lower().strip(OPEN + CLOSE)
    frame = [f"n={min(len(words) - 2, 8)}", f"digits={min(total, 20)}", f"before={lead}", f"sum={bool(whole) and luhn(whole)}"]
    out = []
    for k in range(1, len(words) - 1):
        word, own = words[k], digits[k]
        f = [
            f"s={shapes[k]}",
            f"p={shapes[k - 1] if k > 1 else 'edge'}",
            f"f={shapes[k + 1] if k + 2 < len(words) else 'edge'}",
            f"c={min(len(own), 20)}",
            f"at={'@' in word}/{'.' in word}",
            f"hex={bool(own) and any(c.isalpha() for c in word)}",
            f"plus={word[0] == '+'}/{word[0] == '('}" if word else "none",
            f"card={13 <= len(own) <= 19 and luhn(own)}",
            f"dots={word.count('.')}/{word.count('-')}",
            f"first={k == 1}:{lead}",
        ]
        if word.count(".") == 3:
            f.append(f"ip={all(p.isdigit() and _octet(p) for p in word.split('.'))}")
        out.append(f + frame)
    return out


class Field:
    """Weights of a trained linear-chain conditional random field."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.names, self.emit, self.move, self.start = names, emit, move, start

    def scores(self, chains: list[list[list[str]]]) -> list[np.ndarray]:
        rows, owner = [], []
        lengths = [len(c) for c in chains]
        for at, feats in enumerate(f for c in chains for f in c):
            known = [self.names[n] for n in feats if n in self.names]
            rows += known
            owner += [at] * len(known)
        out = np.zeros((sum(lengths), len(TAGS)))
        np.add.at(out, np.array(owner, np.int64), self.emit[np.array(rows, np.int64)])
        return np.split(out, np.cumsum(lengths)[:-1])

    def decode(self, chains: list[list[list[str]]], cells: int = 200_000) -> list[np.ndarray]:
        """Best tags of each chain: chains of like length are padded and decoded together."""
        scores = self.scores(chains)
        result: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(scores[i]))
        while order:
            size, n = len(scores[order[0]]), 1
            while n < len(order) and (n + 1) * len(scores[order[n]]) <= cells and len(scores[order[n]]) <= 2 * size:
                n += 1
            group, order = order[:n], order[n:]
            lens = np.array([len(scores[i]) for i in group])
            grid = np.zeros((n, lens.max(), len(TAGS)))
            for row, i in enumerate(group):
                grid[row, : lens[row]] = scores[i]
            for row, i in enumerate(self._viterbi(grid, lens)):
                result[group[row]] = i
        return result

    def _viterbi(self, grid: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
        n, most, k = grid.shape
        best = grid[:, 0] + self.start
        back = np.zeros((n, most, k), np.int8)
        for t in range(1, most):
            step = best[:, :, None] + self.move
            back[:, t] = step.argmax(1)
            moved = step.max(1) + grid[:, t]
            best = np.where((t < lens)[:, None], moved, best)
        tag = best.argmax(1)
        path = np.zeros((n, most), np.int64)
        for t in range(most - 1, -1, -1):
            path[:, t] = tag
            tag = np.where(t < lens, back[np.arange(n), t, tag], tag)
        return [path[i, : lens[i]] for i in range(n)]


FORBIDDEN = -1e4


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties of transitions and starts: an I tag follows the B or I tag of its own kind."""
    move = np.zeros((len(TAGS), len(TAGS)))
    start = np.zeros(len(TAGS))
    for j, to in enumerate(TAGS):
        if to[0] == "I":
            start[j] = FORBIDDEN
            for i, of in enumerate(TAGS):
                if of[2:] != to[2:] or of == "O":
                    move[i, j] = FORBIDDEN
    return move, start


def read_marked(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """Text and spans of a marked line."""
    text, spans, at, begin = "", [], 0, 0
    for m in MARK.finditer(line):
        text += line[at : m.start()]
        at = m.end()
        if m[1]:
            spans.append((m[2], begin, len(text)))
        begin = len(text)
    return text + line[at:], spans


def train(labelled: Iterable[str] = LABELLED, rounds: int = 150, rate: float = 0.1, decay: float = 0.02) -> Field:
    """Fit the field by gradient steps (Adam) on the log-likelihood; the table must be small."""
    chains, gold = [], []
    for line in labelled:
        text, spans = read_marked(line)
        for chain in candidate_chains(text):
            tags, last = [], None
            for _, a, b in chain[1:-1]:
                hit = next((s for s in spans if a < s[2] and s[1] < b), None)
                tags.append(TAGS.index(f"{'I' if hit is last else 'B'}-{hit[0]}") if hit else 0)
                last = hit
            chains.append(features(chain))
            gold.append(tags)
    names: dict[str, int] = {}
    for c in chains:
        for f in c:
            for name in f:
                names.setdefault(name, len(names))
    n, most, k = len(chains), max(map(len, chains)), len(TAGS)
    lens = np.array([len(c) for c in chains])
    x = np.zeros((n, most, len(names)), np.float32)
    y = np.zeros((n, most, k))
    for i, c in enumerate(chains):
        for t, f in enumerate(c):
            x[i, t, [names[name] for name in f]] = 1
            y[i, t, gold[i][t]] = 1
    flat = x.reshape(-1, len(names)).astype(np.float64)
    fixed_move, fixed_start = _allowed()
    pairs = np.einsum("nti,ntj->ij", y[:, :-1], y[:, 1:])
    emit, move, start = np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emit, move, start)]
    live = np.arange(most) < lens[:, None]

    def lse(a, axis):
        top = a.max(axis, keepdims=True)
        return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for step in range(1, rounds + 1):
        grid = (flat @ emit).reshape(n, most, k)
        m, s = move + fixed_move, start + fixed_start
        alpha, beta = np.zeros((n, most, k)), np.zeros((n, most, k))
        alpha[:, 0] = grid[:, 0] + s
        for t in range(1, most):
            alpha[:, t] = np.where(live[:, t, None], lse(alpha[:, t - 1, :, None] + m, 1) + grid[:, t], alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            ahead = lse(m + (grid[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], ahead, 0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        joint = np.zeros((k, k))
        for t in range(1, most):
            q = alpha[:, t - 1, :, None] + m + (grid[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
            joint += (np.exp(np.minimum(q, 50)) * live[:, t, None, None]).sum(0)
        grads = (
            flat.T @ (y - p).reshape(-1, k) - decay * emit,
            pairs - joint - decay * move,
            y[:, 0].sum(0) - p[:, 0].sum(0) - decay * start,
        )
        for param, grad, moment in zip((emit, move, start), grads, moments):
            moment[0][:] = 0.9 * moment[0] + 0.1 * grad
            moment[1][:] = 0.999 * moment[1] + 0.001 * grad**2
            param += rate * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8)
    return Field(names, emit, move + fixed_move, start + fixed_start)


def possible(kind: str, text: str) -> bool:
    """Whether a span can be of its kind at all."""
    digits = "".join(DIGIT.findall(text))
    if kind == "email":
        name, _, host = text.partition("@")
        return bool(name) and bool(host) and "@" not in host and host[0].isalpha()
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _octet(p) for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in text)
    return 8 <= len(digits) <= 15 and not any(c.isalpha() for c in text)


def all_spans(texts: list[str], field: Field) -> Iterator[tuple[list, list]]:
    """Base spans and all spans of each text, by kind and start."""
    chains, owner = [], []
    base = []
    for i, text in enumerate(texts):
        base.append(base_spans(text))
        if CANDIDATE.search(text):
            for chain in candidate_chains(text):
                chains.append(chain)
                owner.append(i)
    added: list[list] = [[] for _ in texts]
    tags = field.decode([features(c) for c in chains]) if chains else []
    for i, chain, path in zip(owner, chains, tags):
        if path.any():
            added[i] += _runs(chain[1:-1], path)
    for text, own, more in zip(texts, base, added):
        taken = sorted((a, b) for _, a, b in own)
        free = [s for s in more if possible(s[0], text[s[1] : s[2]]) and not _touches(taken, s)]
        yield own, sorted(own + free, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _runs(words: list, path: np.ndarray) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for (_, a, b), tag in zip(words, path.tolist()):
        name = TAGS[tag]
        if name[0] == "B":
            out.append((name[2:], a, b))
        elif name[0] == "I":
            out[-1] = (name[2:], out[-1][1], b)
    return out


def _touches(taken: list[tuple[int, int]], span: tuple[str, int, int]) -> bool:
    from bisect import bisect_left

    k = bisect_left(taken, (span[2], 0))
    # base spans of different kinds may overlap, so a few before this place are looked at
    return any(b > span[1] for _, b in taken[max(0, k - len(KINDS) - 1) : k])


def find_private(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), labelled: Iterable[str] = LABELLED
) -> DataFrame:
    """Columns of `keep`, base and spans (arrays of kind, start, end), one row for each row."""
    field = train(tuple(labelled))
    span = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
    schema = T.StructType(
        [df.schema[c] for c in keep] + [T.StructField("base", T.ArrayType(span)), T.StructField("spans", T.ArrayType(span))]
    )
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("private")
        for rows, texts in text_steps(batches, "__text"):
            found = list(all_spans(texts, field))
            lists = [
                pa.array([[dict(zip(("kind", "start", "end"), s)) for s in pair[side]] for pair in found], arrow)
                for side in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *lists], names=schema.names)

    return df.select(*keep, df[text].cast("string").alias("__text")).mapInArrow(run, schema)


def redact(df: DataFrame, labelled: Iterable[str] = LABELLED) -> DataFrame:
    """The same rows and columns with every span of `text` replaced by the name of its kind.

    Overlapping spans become one replacement, named by the one that starts first (longest on a tie).
    n_chars follows the text where it changed. Null texts stay null.
    """
    field = train(tuple(labelled))
    schema = df.schema
    at = schema.names.index("text")
    chars = schema.names.index("n_chars") if "n_chars" in schema.names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("private")
        for rows, texts in text_steps(batches, "text"):
            new, sizes = rows.column(at).to_pylist(), None
            if chars is not None:
                sizes = rows.column(chars).to_pylist()
            for i, (_, spans) in enumerate(all_spans(texts, field)):
                if spans:
                    new[i] = _replaced(texts[i], spans)
                    if sizes is not None:
                        sizes[i] = len(new[i])
            columns = list(rows.columns)
            columns[at] = pa.array(new, columns[at].type)
            if sizes is not None:
                columns[chars] = pa.array(sizes, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def _replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, end = [], 0
    name = ""
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [name, text[end:a]]
            name = f"[{kind.upper()}]"
            end = b
        else:
            end = max(end, b)
    return "".join(out) + name + text[end:]
