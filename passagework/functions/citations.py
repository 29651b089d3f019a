"""Citation markers and phrase overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions.text import col, let, strip

# A citation group such as [S1], [S1, S2] or [S2-S4]; a run inside one; its limit.
MARKER_GROUP = r"\[(S\d+(?:\s*[,;\-–]\s*S\d+)*)\]"
_RUN = r"^S\d+\s*[\-–]\s*S\d+$"
MAX_RUN = 12


def _numbers(part: Column) -> Column:
    found = F.transform(F.regexp_extract_all(part, F.lit(r"S(\d+)"), F.lit(1)), lambda n: n.cast("bigint"))

    def spell_out(n: Column) -> Column:
        low, high = F.try_element_at(n, F.lit(1)), F.try_element_at(n, F.lit(2))
        run = part.rlike(_RUN) & (high >= low) & (high - low <= MAX_RUN)
        return F.when(run, F.sequence(low, high)).otherwise(n)

    return let(found, spell_out)


def cited_numbers(answer: Column | str) -> Column:
    """Source numbers an answer cites, distinct and ascending."""
    groups = F.regexp_extract_all(col(answer), F.lit(MARKER_GROUP), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*[,;]\s*")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, _numbers))))


def cited_markers(answer: Column | str) -> Column:
    return F.transform(cited_numbers(answer), lambda n: F.concat(F.lit("S"), n.cast("string")))


def strip_markers(text: Column | str) -> Column:
    bare = F.regexp_replace(col(text), MARKER_GROUP, "")
    return strip(F.regexp_replace(bare, "[ \t]{2,}", " "))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(text: Column | str, size: int = 5) -> Column:
    """Distinct word n-grams; a shorter text is one shingle, a wordless one has none."""

    def grams(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
        made = F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(made))

    return let(words(text), grams)


def overlap_coefficient(a: Column | str, b: Column | str) -> Column:
    """Shared items over the smaller set's size; 0 if either set is empty."""
    shared = F.size(F.array_intersect(col(a), col(b)))
    least = F.least(F.size(col(a)), F.size(col(b)))
    return F.when(least > 0, shared / least).otherwise(F.lit(0.0))
