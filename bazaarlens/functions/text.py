"""Text normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.functions.core import col, keep_first_by, let, squeeze, text
from bazaarlens.rules.words import MARKETING_NOISE, MOJIBAKE_MARKS

_RANGES = (range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0x2070, 0x20A0), range(0xFF01, 0xFF5F))


def _single_char_map(form: str, drop_marks: bool) -> tuple[str, str]:
    """Characters of the Latin blocks whose normal form is one other character."""
    source, target = [], []
    for block in _RANGES:
        for code in block:
            char = chr(code)
            normal = unicodedata.normalize(form, char)
            if drop_marks:
                normal = "".join(c for c in normal if not unicodedata.combining(c))
            if len(normal) == 1 and normal != char:
                source.append(char)
                target.append(normal)
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _single_char_map("NFKD", True)
_COMPAT_FROM, _COMPAT_TO = _single_char_map("NFKC", False)
_MARKS = "".join(chr(code) for code in range(0x300, 0x370))


def fold_accents(c: Column | str) -> Column:
    """Latin letters without accents; translate() drops the marks that have no counterpart."""
    return F.translate(text(c), _FOLD_FROM + _MARKS, _FOLD_TO)


def unicode_form(form: str):
    """Full NFKC/NFKD as an Arrow UDF, for scripts outside the Latin blocks."""

    @F.pandas_udf(T.StringType())
    def apply(values: pd.Series) -> pd.Series:
        return values.fillna("").str.normalize(form)

    return apply


def normalize_text(c: Column | str) -> Column:
    """Compatibility forms to plain ones, lower case, trimmed."""
    plain = F.translate(text(c), _COMPAT_FROM, _COMPAT_TO)
    return F.regexp_replace(F.lower(plain), r"(?U)^\s+|\s+$", "")


def normalize_product_text(c: Column | str) -> Column:
    """Accent-free lower-case words and digits, one space between."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", " "))


def drop_noise_phrases(normalized: Column) -> Column:
    """Remove marketing phrases from normalised text, the longest first."""
    out = normalized
    for phrase in sorted(MARKETING_NOISE, key=len, reverse=True):
        out = F.regexp_replace(out, rf"\b{phrase}\b", " ")
    return out


def informative_tokens(c: Column | str) -> Column:
    words = F.split(drop_noise_phrases(normalize_product_text(c)), r"\s+")
    return F.filter(words, lambda w: F.length(w) > 1)


def token_set(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(informative_tokens(c)))


def token_signature(c: Column | str) -> Column:
    return F.array_join(token_set(c), " ")


def norm_text(c: Column | str) -> Column:
    """Like normalize_product_text but keeps the characters + . _ - of model names."""
    kept = F.regexp_replace(F.lower(fold_accents(c)), r"[^a-z0-9+._\- ]+", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def text_key(c: Column | str) -> Column:
    """Identifier-safe key: runs of other characters become one underscore."""
    return F.btrim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def comparison_text(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


alias_norm = comparison_text


def clean_text_list(values: Column | str, min_length: int = 2, limit: int | None = None) -> Column:
    """Trim, drop short items, keep the first of items that differ only in case."""
    items = F.transform(F.coalesce(col(values), F.array().cast("array<string>")), squeeze)
    items = F.filter(items, lambda v: F.length(v) >= min_length)
    kept = keep_first_by(items, F.lower)
    return kept if limit is None else F.slice(kept, 1, limit)


def unique_by_norm(values: Column) -> Column:
    """First of items that agree once normalised; blanks dropped."""
    items = F.filter(F.transform(values, F.trim), lambda v: F.length(v) > 0)
    return keep_first_by(items, norm_text)


def _count_marks(c: Column) -> Column:
    total = F.lit(0)
    for mark in MOJIBAKE_MARKS:
        removed = F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
        total = total + removed / F.lit(len(mark))
    return total


def repair_mojibake(c: Column | str) -> Column:
    """Undo UTF-8 read as Latin-1, when the re-reading leaves no more marker characters."""
    value = text(c)
    narrow = F.regexp_replace(value, r"[^\u0000-ÿ]", "")
    # Bytes that are no UTF-8 become U+FFFD and drop out.
    bytes_read = F.encode(narrow, "ISO-8859-1").cast("string")
    reread = F.replace(F.make_valid_utf8(bytes_read), F.lit("\ufffd"), F.lit(""))
    return let(
        F.struct(value.alias("old"), reread.alias("new")),
        lambda s: F.when(
            (_count_marks(s["old"]) > 0)
            & (F.length(s["new"]) > 0)
            & (_count_marks(s["new"]) <= _count_marks(s["old"])),
            s["new"],
        ).otherwise(s["old"]),
    )


def first_json_object(c: Column | str) -> Column:
    """The JSON object inside noisy or fenced text as compact JSON, or null."""
    body = F.regexp_extract(text(c), r"(?s)\{.*\}", 0)
    return F.to_json(F.try_parse_json(F.nullif(body, F.lit(""))))


def request_text(c: Column | str) -> Column:
    """Lower case, multiplication sign to x, single spaces."""
    return squeeze(F.replace(F.lower(text(c)), F.lit("×"), F.lit("x")))
