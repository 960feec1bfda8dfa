"""A straight-line grammar of many sequences at once, built by Re-Pair in vectorised rounds.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new symbol, again and again.
Here a round replaces every pair that no overlapping pair outranks in frequency, so rounds grow
with the logarithm of the sequences. When few pairs occur twice, the neighbours left are paired
level by level until each sequence is one symbol. Equal pairs share one rule throughout, within and
between sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Pairing by frequency ends when a round shortens the sequences by less than one part in so many.
LEAST_GAIN = 50


@dataclass
class Grammar:
    """Symbols below `terminals` are given; rule r is symbol terminals + r and stands for left[r] right[r]."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray  # terminals a symbol stands for, by symbol
    first: np.ndarray  # where a rule occurs in the given sequence, by rule
    levels: list[tuple[int, int]]  # ranges of rules whose parts are all made in earlier ranges
    roots: np.ndarray  # one symbol for each sequence, -1 for an empty one


def _leftmost(hits: np.ndarray) -> np.ndarray:
    """Of hits on neighbouring places, every other one from the left."""
    if not len(hits):
        return hits
    begins = np.r_[True, hits[1:] != hits[:-1] + 1]
    run = np.flatnonzero(begins)
    offset = np.arange(len(hits)) - run[np.cumsum(begins) - 1]
    return hits[offset % 2 == 0]


def _frequent(symbols: np.ndarray, same: np.ndarray, width: int) -> np.ndarray:
    """Places of pairs that occur twice or more and that no overlapping pair outranks."""
    often = np.bincount(symbols, minlength=width) > 1
    at = np.flatnonzero(same & often[symbols[:-1]] & often[symbols[1:]])
    if not len(at):
        return at
    key = symbols[at] * width + symbols[at + 1]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    begins = np.r_[True, ordered[1:] != ordered[:-1]]
    group = np.cumsum(begins) - 1
    counts = np.diff(np.r_[np.flatnonzero(begins), len(key)])
    standing = np.empty(len(counts), np.int64)  # 1 for the rarest pair, ties by symbols
    standing[np.argsort(counts, kind="stable")] = np.arange(1, len(counts) + 1)
    standing[counts < 2] = 0
    strength = np.zeros(len(symbols) + 1, np.int64)
    strength[at[order] + 1] = standing[group]
    here = strength[1:-1]
    after = np.r_[strength[2:-1], 0]
    return _leftmost(np.flatnonzero((here > 0) & (here >= strength[:-2]) & (here >= after)))


def build_grammar(symbols: np.ndarray, owner: np.ndarray, sequences: int, terminals: int) -> Grammar:
    """Grammar of the sequences laid out one after another; owner has the number of each, ascending."""
    seq = symbols.astype(np.int64)
    own = owner.astype(np.int64)
    place = np.arange(len(seq))
    left, right, first, sizes, levels = [], [], [], [np.ones(terminals, np.int64)], []
    size = sizes[0]
    width, by_frequency = terminals, True
    while len(seq) > 1:
        same = own[1:] == own[:-1]
        if not same.any():
            break
        hits = _frequent(seq, same, width) if by_frequency else np.zeros(0, np.int64)
        if by_frequency and len(hits) * LEAST_GAIN < len(seq):
            by_frequency = False
        if not len(hits):
            begin = np.flatnonzero(np.r_[True, ~same])
            nth = np.arange(len(seq)) - np.repeat(begin, np.diff(np.r_[begin, len(seq)]))
            hits = np.flatnonzero(same & (nth[:-1] % 2 == 0))
        key, at, rule = np.unique(seq[hits] * width + seq[hits + 1], return_index=True, return_inverse=True)
        left.append(key // width)
        right.append(key % width)
        first.append(place[hits[at]])
        sizes.append(size[left[-1]] + size[right[-1]])
        size = np.concatenate([size, sizes[-1]])
        done = levels[-1][1] if levels else 0
        levels.append((done, done + len(key)))
        seq[hits] = width + rule.reshape(-1)
        keep = np.ones(len(seq), bool)
        keep[hits + 1] = False
        seq, own, place = seq[keep], own[keep], place[keep]
        width += len(key)
    roots = np.full(sequences, -1, np.int64)
    roots[own] = seq
    none = [np.zeros(0, np.int64)]
    return Grammar(terminals, np.concatenate(left or none), np.concatenate(right or none), size,
                   np.concatenate(first or none), levels, roots)
