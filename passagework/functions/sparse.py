"""Sparse (BM25) encoding: terms, hashed term indices, saturated weights."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions.stemming import stem_all, stem_word
from passagework.functions.text import col

# Words that carry no retrieval signal.
STOPWORDS = tuple(
    """
    a an the and or but if then else of in on at to for from by with as is are
    was were be been being it its this that these those there here we you they
    i he she them his her their our your do does did doing have has had having
    will would shall should can could may might must about into over under
    """.split()
)
# Fixed value: a term keeps its inner full stops and hyphens ("3.5", "b-tree").
TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
K1 = 1.5
# 32-bit FNV-1a.
_FNV_START, _FNV_PRIME, _MASK = 2166136261, 16777619, 0xFFFFFFFF
_PATTERN, _STOP = re.compile(TERM), frozenset(STOPWORDS)


def terms(text: Column | str, stem: bool = True) -> Column:
    found = F.regexp_extract_all(F.lower(col(text)), F.lit(TERM), F.lit(0))
    kept = F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))
    return stem_all(kept) if stem else kept


def term_index(term: Column | str) -> Column:
    """32-bit FNV-1a over the term's bytes (terms are ASCII by their pattern)."""
    x = col(term)
    codes = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.ascii(x.substr(i, F.lit(1))))
    step = lambda acc, b: acc.bitwiseXOR(b.cast("bigint")).__mul__(F.lit(_FNV_PRIME)).bitwiseAND(F.lit(_MASK))
    return F.when(F.length(x) == 0, F.lit(_FNV_START)).otherwise(
        F.aggregate(codes, F.lit(_FNV_START).cast("bigint"), step)
    )


def found(text: str) -> list[str]:
    """The words of a text before stop words go, as `terms` finds them."""
    return _PATTERN.findall(text.lower())


def encoded(word: str, stem: bool) -> tuple[str, int] | None:
    """A word's term and its index; None if it carries no signal. The same as `terms` and `term_index`."""
    if len(word) < 2 or word in _STOP:
        return None
    term = stem_word(word) if stem else word
    h = _FNV_START
    for b in term.encode():
        h = (h ^ b) * _FNV_PRIME & _MASK
    return term, h


def saturate(count: Column | str, k1: float = K1) -> Column:
    """Term-frequency weight; repeats count for less and less. No length term."""
    c = col(count).cast("double")
    return (c * (k1 + 1)) / (c + k1)


def idf(df: Column | str, total: Column | str) -> Column:
    """Published BM25 form: ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return F.log(1 + (col(total) - col(df) + 0.5) / (col(df) + 0.5))
