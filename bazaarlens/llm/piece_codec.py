"""SentencePiece encoding and decoding by vectorised merge rounds.

A batch's distinct words are laid out as one flat array of symbols. Each round finds the best pair
of every word (segmented minimum of pair ranks), merges its leftmost occurrences at once, and
compacts the arrays, until no pair of any word is in the vocabulary. Words are the stretches that
start at a space mark: no piece has a space mark after another character (checked on loading), so
no merge crosses them.

One round may merge several occurrences of a pair. Merging one by one would look at each new pair
before the next occurrence; where a new pair beats the current one, the later occurrences of that
word wait for the next round, so the result is that of the one-by-one order.

Null text: empty. Empty text: no ids, empty decoded text. Control pieces in a text are plain text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bazaarlens.llm.common import code_points, task_of, text_steps

SPACE = "▁"
NO_PAIR = np.int32(2**31 - 1)
#: Symbols from here on are characters outside every piece: no pair holds them.
FOREIGN = 1 << 24
#: Words that a worker remembers between batches, and characters of texts it takes at once.
WORDS_KEPT = 250_000
BATCH_CHARS = 1_000_000
WORDS = re.compile(" +[^ ]*")


class PieceModel:
    """Vocabulary and pair table of a BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        if sum(sp.is_byte(i) for i in range(size)) != 256 or any(sp.is_unused(i) for i in range(size)):
            raise ValueError("a BPE model with byte fallback and no unused pieces is needed")
        if sp.encode("A  ½", out_type=str)[:1] != sp.encode("A", out_type=str)[:1] or sp.decode(sp.encode(" ½  ")) != " ½  ":
            raise ValueError("a model with identity normalisation and a dummy prefix is needed")
        self.size = size
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece spans two words")
        self.surfaces = [p.replace(SPACE, " ") if not special[i] else "" for i, p in enumerate(pieces)]
        is_byte = np.zeros(size, bool)
        is_byte[self.byte_ids] = True
        self.is_byte = is_byte
        self.byte_of = np.zeros(size, np.uint8)
        self.byte_of[self.byte_ids] = np.arange(256)

        symbols = dict(ids)
        for p in ids:  # characters that only occur inside longer pieces are symbols, but no pieces
            for c in p:
                symbols.setdefault(c, len(symbols) + size)
        self.char_of = {v: k for k, v in symbols.items() if v >= size}
        self.width = max(symbols.values()) + 1
        self.of_char = np.arange(0x110000, dtype=np.int32) + FOREIGN
        for p, i in symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        # pieces from best to worst score get ranks; a tie in score is a tie in rank
        scores = sorted({sp.get_score(i) for i in ids.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        keys, ranks, merged = [], [], []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    ranks.append(rank_of[sp.get_score(i)])
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int32)[order]
        self.merged = np.array(merged, np.int32)[order]
        self._forget()

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_PAIR if none) and merged piece of each pair of symbols."""
        rank = np.full(len(left), NO_PAIR, np.int32)
        piece = np.zeros(len(left), np.int32)
        known = np.flatnonzero((left < FOREIGN) & (right < FOREIGN))
        key = left[known].astype(np.int64) * self.width + right[known]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        rank[known[found]] = self.ranks[at[found]]
        piece[known[found]] = self.merged[at[found]]
        return rank, piece

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat symbols; word has the word number of each, in ascending order."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, piece = self._neighbours(symbols, word)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            open_ = best < NO_PAIR
            if not open_.all():  # words without a pair are finished
                done.append((symbols[~open_], word[~open_]))
                symbols, word, rank, piece, best = (x[open_] for x in (symbols, word, rank, piece, best))
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == best)
            # of hits that overlap, every other one from the left
            run = np.flatnonzero(np.r_[True, hits[1:] != hits[:-1] + 1])
            offset = np.arange(len(hits)) - np.repeat(run, np.diff(np.r_[run, len(hits)]))
            hits = hits[offset % 2 == 0]
            hits = hits[self._in_order(symbols, word, best, piece, hits)]
            symbols[hits] = piece[hits]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            place = np.cumsum(keep) - 1
            fresh = place[hits]
            symbols, word, rank, piece = symbols[keep], word[keep], rank[keep], piece[keep]
            again = np.r_[fresh, np.maximum(fresh - 1, 0)]
            rank[again], piece[again] = self._neighbours(symbols, word, again)
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _neighbours(self, symbols, word, at=None):
        """Rank and merged piece of the symbols at `at` (all if None) with those after them."""
        at = np.arange(len(symbols)) if at is None else at
        nxt = np.minimum(at + 1, len(symbols) - 1)
        rank, piece = self.pairs(symbols[at], symbols[nxt])
        rank[(word[nxt] != word[at]) | (nxt == at)] = NO_PAIR
        return rank, piece

    def _in_order(self, symbols, word, best, piece, hits):
        """Which hits come before any new pair that would beat them in their word."""
        last = len(symbols) - 1
        new = piece[hits]
        before, after = np.maximum(hits - 1, 0), np.minimum(hits + 2, last)
        left = symbols[before].copy()
        chained = np.r_[False, hits[1:] == hits[:-1] + 2]  # the hit before ends where this one starts
        left[chained] = new[np.flatnonzero(chained) - 1]
        a, _ = self.pairs(left, new)
        a[(hits == 0) | (word[before] != word[hits])] = NO_PAIR
        b, _ = self.pairs(new, symbols[after])
        b[(hits + 2 > last) | (word[after] != word[hits])] = NO_PAIR
        stop = np.minimum(a, b) < best[hits]
        if not stop.any():
            return np.ones(len(hits), bool)
        # stops of the same word before this hit
        seen = np.cumsum(stop) - stop
        first = np.flatnonzero(np.r_[True, word[hits][1:] != word[hits][:-1]])
        base = np.repeat(seen[first], np.diff(np.r_[first, len(hits)]))
        return seen == base

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words and the offsets of each word (one more than there are words).

        Each word is given without its first space mark.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        text = "".join([SPACE + w for w in words]).replace(" ", SPACE)
        symbols = self.of_char[code_points(text)]
        symbols, word = self.merge(symbols, np.repeat(np.arange(len(words), dtype=np.int32), sizes))
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]
        # a character that is no piece becomes the pieces of its UTF-8 bytes
        values, which = np.unique(symbols[odd], return_inverse=True)
        spelled = [(self.char_of[v] if v in self.char_of else chr(v - FOREIGN)).encode("utf-8", "surrogatepass") for v in values.tolist()]
        each = np.array([len(b) for b in spelled])
        flat = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        begin = np.r_[0, np.cumsum(each)[:-1]]
        times = np.ones(len(symbols), np.int64)
        times[odd] = each[which]
        out, word = np.repeat(symbols, times), np.repeat(word, times)
        place = (np.cumsum(times) - times)[odd]
        inner = np.arange(times[odd].sum()) - np.repeat(np.cumsum(times[odd]) - times[odd], times[odd])
        out[np.repeat(place, times[odd]) + inner] = flat[np.repeat(begin[which], times[odd]) + inner]
        return out, np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the first space is the dummy prefix, runs of byte pieces are UTF-8."""
        text = self._spell(np.asarray(ids, np.int32))
        return text[1:] if text.startswith(" ") else text

    def _spell(self, ids: np.ndarray) -> str:
        if not self.is_byte[ids].any():
            return "".join([self.surfaces[i] for i in ids.tolist()])
        out, bytes_ = [], bytearray()
        for i in ids.tolist():
            if self.is_byte[i]:
                bytes_.append(self.byte_of[i])
                continue
            if bytes_:
                out.append(bytes_.decode("utf-8", "replace"))
                bytes_.clear()
            out.append(self.surfaces[i])
        return "".join(out) + bytes_.decode("utf-8", "replace")

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Flat ids, their offsets per text, and the texts decoded from the ids again."""
        split = [self._words(t) for t in texts]
        table, ids, starts, spelled = self._remember(dict.fromkeys(chain.from_iterable(split)))
        n_words = np.r_[0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]
        index = np.fromiter(map(table.__getitem__, chain.from_iterable(split)), np.int64, int(n_words[-1]))
        lens = np.diff(starts)[index]
        ends = np.cumsum(lens)
        flat = ids[np.repeat(starts[index] - (ends - lens), lens) + np.arange(int(lens.sum()))]
        texts = list(map(spelled.__getitem__, index.tolist()))
        decoded = ["".join(texts[a:b])[1:] for a, b in zip(n_words[:-1].tolist(), n_words[1:].tolist())]
        return flat, np.r_[0, ends][n_words], decoded

    def _remember(self, words: dict[str, None]) -> tuple[dict[str, int], np.ndarray, np.ndarray, list[str]]:
        """Table of words with their ids and spellings; words met before are not merged again.

        The table is emptied once it would hold more than WORDS_KEPT words, and then holds those of
        the batch at hand.
        """
        fresh = [w for w in words if w not in self._table]
        if self._table and len(self._table) + len(fresh) > WORDS_KEPT:
            self._forget()
            fresh = list(words)
        ids, starts = self.encode_words(fresh)
        begin, self._starts = self._starts, np.r_[self._starts, self._starts[-1] + starts[1:]]
        self._table.update(zip(fresh, range(len(begin) - 1, len(self._starts))))
        self._ids = np.concatenate([self._ids, ids])
        surfaces = list(map(self.surfaces.__getitem__, ids.tolist()))
        bounds = starts.tolist()
        spelled = ["".join(surfaces[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        for k in np.unique(np.searchsorted(starts, np.flatnonzero(self.is_byte[ids]), "right") - 1).tolist():
            spelled[k] = self._spell(ids[bounds[k] : bounds[k + 1]])
        self._spelled += spelled
        return self._table, self._ids, self._starts, self._spelled

    def _forget(self) -> None:
        self._table: dict[str, int] = {}
        self._ids = np.zeros(0, np.int32)
        self._starts = np.zeros(1, np.int64)
        self._spelled: list[str] = []

    @staticmethod
    def _words(text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in WORDS.findall(" " + text)]
        return text.split(" ")


@lru_cache(maxsize=4)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of `keep`, ids (array of int) and decoded (text of the ids), one row for each row.

    model_path must name the model on every executor. Other columns of the input are left out, so
    their names cannot clash.
    """
    schema = T.StructType(
        [df.schema[c] for c in keep]
        + [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("pieces", load_model.cache_clear)
        model = load_model(model_path)
        for rows, texts in text_steps(batches, "__text", BATCH_CHARS):
            ids, offsets, decoded = model.encode_batch(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in keep), lists, pa.array(decoded, pa.string())], names=schema.names
            )

    return df.select(*keep, df[text].cast("string").alias("__text")).mapInArrow(run, schema)
