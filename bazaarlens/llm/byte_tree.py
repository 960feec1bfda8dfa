"""Byte-level BPE encoding and decoding, long unsplit text by tree concatenation.

A text is cut at special tokens and then by the vocabulary's split pattern. No merge crosses such
a cut. A stretch of up to LEAF bytes is encoded as a whole by merge rounds over flat numpy symbols
of all stretches at hand. A longer one (no cut for thousands of characters: base64, long numbers,
scripts without spaces) is halved until its parts are leaves. All leaves are encoded together, then
the halves are joined level by level, all joins of a level together: the tokens beside a join are
spelled out and encoded again, first a few on each side; a window whose encoding does not begin and
end with the very tokens that its two sides begin and end with grows to twice the tokens. Where both
ends agree, every two neighbouring tokens of the joined row encode to themselves, which makes it the
encoding of the whole. A window that covers both halves whole is the encoding as it is.

A null text is empty. An empty text has no ids and an empty decoded text. Special tokens that
stand in a text are ids of their own, as in the library's default. Repeated texts are encoded alike;
stretches met before are remembered, up to a bound. Extra columns are left out unless named in `keep`.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bazaarlens.llm.common import steps, task_of, text_steps

NO_PAIR = np.int32(2**31 - 1)
#: Bytes of a leaf, and tokens on each side of a join that are looked at first.
LEAF = 64
SIDE = 4
#: Stretches that a worker remembers between batches, and characters of texts and stretches it takes at once.
STRETCHES_KEPT = 400_000
BATCH_CHARS = 4_000_000
STRETCH_BYTES = 1_000_000
#: How the vocabulary's byte-level split cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class ByteModel:
    """Vocabulary and pair table of a byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without a prefix space is needed")
        if model.get("dropout") or model.get("ignore_merges") or spec["normalizer"]:
            raise ValueError("dropout, ignored merges and normalisers are not supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need whole words are not supported")
        vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(PATTERN)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.width = max([*vocabulary.values(), *self.special.values()]) + 1
        self.of_byte = np.array([vocabulary[c] for c in letters], np.int32)
        self.spelled = [b""] * self.width
        for token, i in vocabulary.items():
            self.spelled[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.spelled[i] = token.encode()
        self.lengths = np.fromiter(map(len, self.spelled), np.int64, self.width)
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self.all_bytes = np.frombuffer(b"".join(self.spelled), np.uint8)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)[order]
        made = {i: r for r, i in enumerate(np.array([vocabulary[a + b] for a, b in pairs]).tolist())}
        if len(made) != len(pairs) or any(made.get(vocabulary[x], -1) >= r for r, p in enumerate(pairs) for x in p):
            raise ValueError("a token is made before its parts, or in two ways: joins could not be judged by neighbours")
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._ids = np.zeros(0, np.int32)
        self._begin = np.zeros(1, np.int64)

    # merge rounds

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR), self.merged[at]

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all stretches, one after another, and how many each has; data holds their bytes."""
        symbols = self.of_byte[data]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        finished = []
        rank = np.full(len(symbols), NO_PAIR, np.int32)
        made = np.zeros(len(symbols), np.int32)
        stale = np.arange(len(symbols))
        while len(symbols):
            last = np.r_[owner[1:] != owner[:-1], True]
            inner = stale[~last[stale]]
            rank[stale] = NO_PAIR
            rank[inner], made[inner] = self._pairs(symbols[inner], symbols[inner + 1])
            begin = np.flatnonzero(np.r_[True, last[:-1]])
            n = np.diff(np.r_[begin, len(symbols)])
            best = np.repeat(np.minimum.reduceat(rank, begin), n)
            open_ = best != NO_PAIR
            if not open_.all():
                finished.append((symbols[~open_], owner[~open_]))
                symbols, owner, rank, made, best = (x[open_] for x in (symbols, owner, rank, made, best))
                if not len(symbols):
                    break
            # equal ranks are one pair: of places that overlap, every other one from the left
            hits = np.flatnonzero(rank == best)
            begins = np.r_[True, hits[1:] != hits[:-1] + 1]
            run = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
            symbols[hits] = made[hits]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            place = (np.cumsum(keep) - 1)[hits]
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            before = place[(place > 0)] - 1
            stale = np.r_[place, before[owner[before] == owner[before + 1]]]  # some twice, which does no harm
        if not finished:
            return symbols, np.zeros(len(sizes), np.int64)
        symbols, owner = (np.concatenate(x) for x in zip(*finished))
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(sizes))

    # joining halves

    def _spell(self, tokens: np.ndarray) -> np.ndarray:
        """Bytes of tokens, one after another."""
        n = self.lengths[tokens]
        ends = np.cumsum(n)
        return self.all_bytes[np.repeat(self.starts[tokens] - (ends - n), n) + np.arange(int(n.sum()))]

    def _joined(self, tokens: list[np.ndarray], left: list[int], right: list[int]) -> list[np.ndarray]:
        """The encodings of the texts of tokens[left] and tokens[right] put together, all pairs at once."""
        out: list[np.ndarray | None] = [None] * len(left)
        open_, side = list(range(len(left))), SIDE
        while open_:
            windows = []
            for k in open_:
                a, b = tokens[left[k]], tokens[right[k]]
                windows.append(np.concatenate([a[max(0, len(a) - side) :], b[:side]]))
            flat = np.concatenate(windows)
            ends = np.cumsum(self.lengths[flat])
            bounds = np.cumsum([len(w) for w in windows])
            found, counts = self.merge(self._spell(flat), np.diff(np.r_[0, ends[bounds - 1]]))
            again = []
            for k, old, new in zip(open_, windows, np.split(found, np.cumsum(counts)[:-1])):
                a, b = tokens[left[k]], tokens[right[k]]
                if (len(a) <= side or new[0] == old[0]) and (len(b) <= side or new[-1] == old[-1]):
                    out[k] = np.concatenate([a[: max(0, len(a) - side)], new, b[side:]])
                else:
                    again.append(k)
            open_, side = again, side * 2
        return out

    def _encode_stretches(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all stretches, one after another, and how many each has."""
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        # 2 ** depth leaves for each stretch, as equal in size as they can be
        leaves = np.left_shift(1, np.ceil(np.log2(np.maximum(sizes / LEAF, 1))).astype(np.int64))
        first = np.cumsum(leaves) - leaves
        nth = np.arange(int(leaves.sum())) - np.repeat(first, leaves)
        whole, parts = np.repeat(sizes, leaves), np.repeat(leaves, leaves)
        leaf_sizes = whole * (nth + 1) // parts - whole * nth // parts
        found, counts = self.merge(np.frombuffer(b"".join(stretches), np.uint8), leaf_sizes)
        if len(leaves) == len(nth):
            return found, counts
        ends = np.cumsum(counts)
        long_ = np.flatnonzero(leaves > 1).tolist()
        rows = {k: [found[ends[j] - counts[j] : ends[j]] for j in range(first[k], first[k] + leaves[k])] for k in long_}
        while any(len(r) > 1 for r in rows.values()):
            flat = list(chain.from_iterable(r for r in rows.values() if len(r) > 1))
            joined = iter(self._joined(flat, list(range(0, len(flat), 2)), list(range(1, len(flat), 2))))
            rows = {k: r if len(r) == 1 else [next(joined) for _ in range(len(r) // 2)] for k, r in rows.items()}
        begin = ends[first] - counts[first]
        total = np.add.reduceat(counts, first)
        out, at = [], 0
        for k in long_:
            out += [found[at : begin[k]], rows[k][0]]
            at = begin[k] + total[k]
            total[k] = len(rows[k][0])
        return np.concatenate([*out, found[at:]]), total

    # texts

    def _stretches(self, text: str) -> list[str]:
        if self.cuts is None or not any(t in text for t in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.cuts.split(text):
            out += [part] if part in self.special else self.pattern.findall(part)
        return out

    def _remember(self, stretches: dict[str, None]) -> dict[str, int]:
        fresh = [s for s in stretches if s not in self._known]
        if self._known and len(self._known) + len(fresh) > STRETCHES_KEPT:
            self._forget()
            fresh = list(stretches)
        plain = [s.encode() for s in fresh]
        tokens, counts = [self._ids], [np.zeros(0, np.int64)]
        for a, b in steps(np.fromiter(map(len, plain), np.int64, len(plain)), STRETCH_BYTES):
            found, n = self._encode_stretches(plain[a:b])
            for k in [k for k in range(a, b) if fresh[k] in self.special]:
                at = int(n[: k - a].sum())
                found = np.concatenate([found[:at], [self.special[fresh[k]]], found[at + n[k - a] :]]).astype(np.int32)
                n[k - a] = 1
            tokens.append(found)
            counts.append(n)
        base = len(self._begin) - 1
        self._known.update(zip(fresh, range(base, base + len(fresh))))
        self._ids = np.concatenate(tokens)
        self._begin = np.r_[self._begin, self._begin[-1] + np.cumsum(np.concatenate(counts))]
        return self._known

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offsets of each (one more than there are texts)."""
        split = [self._stretches(t) for t in texts]
        known = self._remember(dict.fromkeys(chain.from_iterable(split)))
        n = np.r_[0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]
        index = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(n[-1]))
        sizes = np.diff(self._begin)[index]
        ends = np.cumsum(sizes)
        ids = self._ids[np.repeat(self._begin[index] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        return ids, np.r_[0, ends][n]

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of ids: their bytes as UTF-8, with the replacement character for what is none."""
        data = self._spell(ids).tobytes()
        at = np.r_[0, np.cumsum(self.lengths[ids])][offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


@lru_cache(maxsize=4)
def load_model(path: str) -> ByteModel:
    return ByteModel(path)


def encode_bytes(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of `keep`, ids (array of int) and decoded (text of the ids), one row for each row.

    model_path must name the file on every executor.
    """
    schema = T.StructType(
        [df.schema[c] for c in keep]
        + [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("bytes", load_model.cache_clear)
        model = load_model(model_path)
        for rows, texts in text_steps(batches, "__text", BATCH_CHARS):
            ids, offsets = model.encode_batch(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            decoded = pa.array(model.decode_batch(ids, offsets), pa.string())
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), lists, decoded], names=schema.names)

    return df.select(*keep, df[text].cast("string").alias("__text")).mapInArrow(run, schema)
