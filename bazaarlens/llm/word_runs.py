"""Runs of words, found over a grammar: a stretch that repeats a block of words often in a row.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(least_length, least_times * q) that no neighbouring word extends. The words of a step's texts
are numbered and compressed by Re-Pair (`pair_grammar`). A run lies whole in the smallest rule that
holds it, across the boundary of that rule's two parts, so each rule looks only for runs across its
boundary, once however often it occurs. The runs of a rule are then carried to all places where its
text is derived, and intervals of one period that overlap by a period or more are merged, which
leaves the maximal ones.

For a period q and a boundary b, words i and i + q must agree at i = b - q or at i = b, and on q
places in a row beside it. Block hashes test that and find how far the agreement reaches; the words
of each interval found are then compared one by one, so the result is exact.

A null or empty text has no words, no runs and an empty collapsed text. Rows stay rows: repeated
texts share rules and have a result each. Very long texts are a step of their own. Extra columns
are left out unless named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bazaarlens.llm.common import mix64, text_steps
from bazaarlens.llm.pair_grammar import Grammar, build_grammar

#: Characters of the texts that share one grammar, and pairs of rule and period tested at once.
GRAMMAR_CHARS = 3_000_000
PAIRS = 1 << 20

BASE = 0x9E3779B97F4A7C15

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


class Blocks:
    """Hashes of stretches of a sequence: equal stretches have equal hashes, others hardly ever."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = words
        powers = np.ones(n + 1, np.uint64)
        have, step = 1, BASE
        while have <= n:
            more = min(have, n + 1 - have)
            powers[have : have + more] = powers[:more] * np.uint64(step)
            step = step * step % (1 << 64)
            have += more
        self.powers = powers
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(words.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self.sums[1:])

    def equal(self, a: np.ndarray, shift: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches at a and at a + shift look equal; no equal ones look different."""
        here = (self.sums[a + size] - self.sums[a]) * self.powers[shift]
        b = a + shift
        return here == self.sums[b + size] - self.sums[b]

    def reach(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many places from `at` on (or before it) agree with those `shift` further, `most` at most."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            half = (low[open_] + high[open_] + 1) // 2
            begin = at[open_] - half if back else at[open_]
            ok = self.equal(begin, shift[open_], half)
            low[open_[ok]] = half[ok]
            high[open_[~ok]] = half[~ok] - 1


def _verified(words: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the words of each interval agree with those a period later, word by word."""
    good = np.ones(len(start), bool)
    bounds = np.r_[0, np.cumsum(length - period)]
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + 4 * PAIRS, "right")) - 1)
        n = (length - period)[a:b]
        at = np.repeat(start[a:b], n) + np.arange(n.sum()) - np.repeat(bounds[a:b] - bounds[a], n)
        wrong = words[at] != words[at + np.repeat(period[a:b], n)]
        good[a + np.unique(np.repeat(np.arange(b - a), n)[wrong])] = False
        a = b
    return good


def _scanned(words: np.ndarray, low: int, high: int, at: int, q: int) -> tuple[int, int]:
    """Start and length of the stretch with period q around `at`, by plain comparison."""
    s = at
    while s > low and words[s - 1] == words[s - 1 + q]:
        s -= 1
    e = at
    while e + q < high and words[e] == words[e + q]:
        e += 1
    return s, e + q - s


def _smallest(r, s, length, p, at):
    """Of several periods of one interval, the smallest."""
    order = np.lexsort((p, length, s, r))
    r, s, length, p, at = (x[order] for x in (r, s, length, p, at))
    fresh = np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (length[1:] != length[:-1])][: len(r)]
    return tuple(x[fresh] for x in (r, s, length, p, at))


def _rule_periods(size: np.ndarray, least_length: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rule, period) for all periods that a rule's text has room for, about PAIRS at once."""
    most = np.where(size >= least_length, size // times, 0)
    ends = np.cumsum(most)
    rule, done = 0, 0  # the next rule, and how many of its periods are out
    while rule < len(size):
        before = ends[rule] - most[rule] + done
        last = int(np.searchsorted(ends, before + PAIRS, "left"))
        if last > rule:
            n = most[rule:last].copy()
            n[0] -= done
            which = np.repeat(np.arange(rule, last), n)
            begin = np.repeat(np.cumsum(n) - n, n)
            q = np.arange(len(which)) - begin + 1
            q[: n[0]] += done
            yield which, q
            rule, done = last, 0
        else:  # one rule with more periods than a step takes
            upto = min(done + PAIRS, int(most[rule]))
            yield np.full(upto - done, rule), np.arange(done + 1, upto + 1)
            rule, done = (rule + 1, 0) if upto == most[rule] else (rule, upto)


def boundary_runs(
    words: np.ndarray, grammar: Grammar, least_length: int, times: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rule, start within the rule, length, period) of the runs across each rule's boundary."""
    blocks = Blocks(words)
    size = grammar.size[grammar.terminals :]
    found = []
    for rule, q in _rule_periods(size, least_length, times):
        low = grammar.first[rule]
        high = low + size[rule]
        cut = low + grammar.size[grammar.left[rule]]
        for anchor in (cut - q, cut):
            inside = np.flatnonzero((anchor >= low) & (anchor + q < high))
            inside = inside[words[anchor[inside]] == words[anchor[inside] + q[inside]]]
            if not len(inside):
                continue
            at, p, lo, hi = anchor[inside], q[inside], low[inside], high[inside]
            wide = np.zeros(len(at), bool)
            right = np.flatnonzero(at + 2 * p <= hi)
            wide[right] = blocks.equal(at[right], p[right], p[right])
            left = np.flatnonzero(~wide & (at - p + 1 >= lo))
            wide[left] = blocks.equal(at[left] - p[left] + 1, p[left], p[left])
            at, p, lo, hi, r = (x[wide] for x in (at, p, lo, hi, rule[inside]))
            s = at - blocks.reach(at, p, at - lo, True)
            length = at + blocks.reach(at, p, hi - p - at, False) + p - s
            ok = length >= np.maximum(times * p, least_length)
            found.append(np.stack([r[ok], s[ok], length[ok], p[ok], at[ok]]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    r, s, length, p, at = _smallest(*np.concatenate(found, axis=1))
    wrong = np.flatnonzero(~_verified(words, s, length, p))
    for k in wrong.tolist():
        low = int(grammar.first[r[k]])
        s[k], length[k] = _scanned(words, low, low + int(size[r[k]]), int(at[k]), int(p[k]))
    if len(wrong):
        r, s, length, p, at = _smallest(r, s, length, p, at)
    low = grammar.first[r]
    cut = low + grammar.size[grammar.left[r]]
    ok = (length >= np.maximum(times * p, least_length)) & (s < cut) & (s + length > cut)
    return r[ok], (s - low)[ok], length[ok], p[ok]


def find_runs(
    words: np.ndarray, owner: np.ndarray, sequences: int, least_length: int = 6, times: int = 4
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, place in the whole layout, length, period) of all runs, by sequence, start and period."""
    nothing = (np.zeros(0, np.int64),) * 4
    if not len(words):
        return nothing
    grammar = build_grammar(words, owner, sequences, int(words.max()) + 1)
    rule, start, length, period = boundary_runs(words, grammar, least_length, times)
    if not len(rule):
        return nothing
    # places of the rules that hold runs, from the whole sequences down
    terminals = grammar.terminals
    order = np.argsort(rule, kind="stable")
    rule, start, length, period = (x[order] for x in (rule, start, length, period))
    own = np.bincount(rule, minlength=len(grammar.left))
    offset = np.cumsum(own) - own
    holds = np.zeros(len(grammar.size), bool)
    holds[terminals:] = own > 0
    for a, b in grammar.levels:
        holds[terminals + a : terminals + b] |= holds[grammar.left[a:b]] | holds[grammar.right[a:b]]
    begin = np.searchsorted(owner, np.arange(sequences))
    live = np.flatnonzero((grammar.roots >= 0) & holds[np.maximum(grammar.roots, 0)])
    symbol, place, seq = grammar.roots[live], begin[live], live
    parts = []
    while len(symbol):
        r = symbol - terminals
        n = own[r]
        each = np.repeat(offset[r], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        parts.append(np.stack([np.repeat(seq, n), np.repeat(place, n) + start[each], length[each], period[each]]))
        lefts, rights = grammar.left[r], grammar.right[r]
        symbol, place, seq = (
            np.concatenate(x) for x in ((lefts, rights), (place, place + grammar.size[lefts]), (seq, seq))
        )
        more = holds[symbol]
        symbol, place, seq = symbol[more], place[more], seq[more]
    seq, s, length, q = np.concatenate(parts, axis=1)
    # of one sequence and period, join what overlaps by a period or more
    order = np.lexsort((-length, s, q, seq))
    seq, s, end, q = (x[order] for x in (seq, s, s + length, q))
    group = np.cumsum(np.r_[True, (seq[1:] != seq[:-1]) | (q[1:] != q[:-1])]) - 1
    span = len(words) + 1
    reach = np.maximum.accumulate(end + group * span) - group * span
    new = np.r_[True, (group[1:] != group[:-1]) | (s[1:] > reach[:-1] - q[1:])]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(s)] - 1
    seq, s, length, q = seq[at], s[at], reach[last] - s[at], q[at]
    order = np.lexsort((q, s))
    return seq[order], s[order], length[order], q[order]


def word_runs(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least_length: int = 6, times: int = 4
) -> DataFrame:
    """Columns of `keep`, n_words, runs (start, length, period; by start, then period) and collapsed,
    one row for each row.

    Words are what is left between white space of ASCII, numbered from 0. collapsed is the text
    without the words that a run holds after its first period, joined by one space.
    """
    schema = T.StructType(
        [df.schema[c] for c in keep]
        + [
            T.StructField("n_words", T.LongType(), False),
            T.StructField("runs", T.ArrayType(RUN, False), False),
            T.StructField("collapsed", T.StringType(), False),
        ]
    )
    run_type = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_steps(batches, "__text", GRAMMAR_CHARS):
            split = [t.encode().split() for t in texts]  # bytes split at white space of ASCII only
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            begin = np.r_[0, np.cumsum(sizes)]
            flat = np.empty(int(begin[-1]), object)
            for a, b, w in zip(begin[:-1].tolist(), begin[1:].tolist(), split):
                flat[a:b] = w
            ids = pd.factorize(flat)[0].astype(np.int64)
            owner = np.repeat(np.arange(len(split)), sizes)
            seq, start, length, period = find_runs(ids, owner, len(split), least_length, times)
            change = np.zeros(len(flat) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            kept = np.cumsum(change)[:-1] == 0
            collapsed = [b" ".join(w) for w in split]
            for k in np.unique(seq).tolist():
                a, b = begin[k], begin[k + 1]
                collapsed[k] = b" ".join(flat[a:b][kept[a:b]].tolist())
            offsets = np.r_[0, np.cumsum(np.bincount(seq, minlength=len(split)))].astype(np.int32)
            values = pa.StructArray.from_arrays(
                [pa.array(start - begin[seq]), pa.array(length), pa.array(period)], fields=list(run_type)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(c) for c in keep),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(offsets), values),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                names=schema.names,
            )

    return df.select(*keep, df[text].cast("string").alias("__text")).mapInArrow(run, schema)
