"""Hashed character n-grams and a logistic model over sparse rows, in numpy."""

from __future__ import annotations

import numpy as np

from bazaarlens.llm.common import code_points


def char_ngrams(texts: list[str], sizes: tuple[int, ...], bits: int, known: np.ndarray | None = None):
    """Distinct (text number, n-gram bucket) pairs of lower-cased texts, sorted by text, then bucket.

    Buckets are `bits`-bit hashes. `known` keeps only buckets where it is not zero. Ends of texts
    count as marks, so an n-gram never spans two texts.
    """
    pad = "\x01" * max(sizes)
    lowered = [pad[0] + t.lower() + pad for t in texts]
    owner_ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)))
    points = code_points("".join(lowered))
    keys = []
    rolling = points[: len(points)].copy()
    for n in range(2, max(sizes) + 1):
        # the value of the n-gram at i is that of the shorter one, extended by one character
        rolling = rolling[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :]
        if n not in sizes:
            continue
        bucket = ((rolling ^ np.uint32(n * 0x3779)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        place = np.arange(len(bucket)) if known is None else np.flatnonzero(known[bucket])
        owner = np.searchsorted(owner_ends, place, "right")
        keys.append((owner.astype(np.int64) << bits) | bucket[place].astype(np.int64))
    both = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    both.sort()
    if len(both):
        both = both[np.r_[True, both[1:] != both[:-1]]]
    return both >> bits, both & ((1 << bits) - 1)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(rows, cols, values, labels, weights, width, decay=1.0, rounds=150, rate=0.05):
    """Weights and bias of a logistic model with squared penalty, by Adam over all rows at once.

    rows, cols, values: the entries of the sparse matrix. weights: one for each row.
    """
    n = len(labels)
    w, bias = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    total = weights.sum()
    for step in range(1, rounds + 1):
        score = np.bincount(rows, values * w[cols].astype(values.dtype), minlength=n) + bias
        error = (sigmoid(score) - labels) * weights / total
        grad = np.bincount(cols, values * error.astype(values.dtype)[rows], minlength=width) + decay * w / total
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.999 * vb + 0.001 * error.sum() ** 2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-9)
        bias -= rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-9)
    return w, bias
