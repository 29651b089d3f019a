"""Text columns: cleaning, sentences, tokens, ids, labels.

Every function takes and returns a Column. Java patterns carry `(?U)` so that words and
spaces follow Unicode.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = (
    "e.g", "i.e", "etc", "vs", "cf", "al", "fig", "eq", "ref", "no", "vol", "ch", "sec", "approx",
    "dept", "univ", "mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "inc", "ltd", "co",
)
# Namespaces of the derived ids.
CHUNK_NAMESPACE = "6f2a1c94-3b7d-4e51-9a08-52d1f7c0e3b6"
CORRELATION_NAMESPACE = "2c9f5b41-6d0a-4c8e-9f37-1b5a4e2d8c60"
# Fixed value: what a model answers when the sources do not support an answer.
UNSUPPORTED_TOKEN = "NOT_SUPPORTED"
# Fixed value: characters counted as one token.
CHARS_PER_TOKEN = 4.0


def _spans(codes: list[int]) -> list[tuple[int, int]]:
    """Runs of following numbers, by their ends."""
    starts = [c for c in codes if c - 1 not in codes]
    return list(zip(starts, [c for c in codes if c + 1 not in codes], strict=True))


_UUID = "^[0-9a-fA-F]{32}$"
# White space as `(?U)\s` has it, but for the newline.
_BLANKS = "\t\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# A character that compatibility composition may change, or join to the one before. Those it keeps wherever they stand are
# taken from below the first combining mark and from common punctuation.
_UNSETTLED = r"(?=[^\x00-\x7f])[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in _spans(
    [c for c in (*range(0x300), *range(0x2010, 0x2030)) if unicodedata.normalize("NFKC", chr(c)) == chr(c)])) + "]"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column | str) -> Column:
    """Drops white space of any kind from both ends."""
    return F.btrim(col(text), F.lit(_BLANKS + "\n"))


def collapse(text: Column | str) -> Column:
    """One blank between words, none at the ends."""
    return strip(F.regexp_replace(col(text), rf"[{_BLANKS}\n]{{2,}}|[{_BLANKS[:4]}{_BLANKS[5:]}\n]", " "))


@F.pandas_udf(T.StringType())
def _compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    # The one step without a built-in: compatibility composition.
    for batch in batches:
        yield batch.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def tidy(text: Column | str) -> Column:
    """`normalize` without the Unicode step, for text known to be composed already."""
    x = F.coalesce(col(text), F.lit(""))
    x = F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.when(F.contains(x, F.lit("-\n")), F.regexp_replace(x, r"(?U)(\w)-\n(\w)", "$1$2")).otherwise(x)
    x = F.regexp_replace(x, r"[ \t\u00a0]+", " ")
    x = F.regexp_replace(x, r"(?U)(?=\s)(?:(?<=^|\n)[\s&&[^\n]]+|[\s&&[^\n]]+(?=\n|$))", "")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return strip(x)


def normalize(text: Column | str) -> Column:
    """The same visible text always gives the same string. Only texts that composition may change go to Python."""
    x = F.coalesce(col(text), F.lit(""))
    return tidy(F.coalesce(_compose(F.when(x.rlike(_UNSETTLED), x)), x))


def content_hash(text: Column | str, composed: bool = False) -> Column:
    return F.sha2((tidy if composed else normalize)(text), 256)


def lines_of(text: Column | str) -> Column:
    """Non-blank lines, in order."""
    return F.filter(F.split(col(text), "\n"), lambda x: x.rlike(r"(?U)\S"))


# A full stop that closes an abbreviation or a lone letter.
_SHORT_WORD = "(?:" + "|".join([r"\w", *(a for a in ABBREVIATIONS if "." not in a)]) + ")"
_GAP = r"""["')\]]*\s+"""
# What few places have comes first: the words are looked back for at such full stops only.
_JOIN = rf"(?iU)(?<=\.)(?=[\"')\]\s])(?<=(?<!\w){_SHORT_WORD}\.){_GAP}"
_CUT = rf"(?U)(?<=[.!?]){_GAP}"


def split_sentences(text: Column | str) -> Column:
    """Sentences as an array. A newline always ends one; an abbreviation never does."""
    mark = "\u0001"

    def of_line(line: Column) -> Column:
        kept = F.regexp_replace(line, _JOIN, mark)
        return F.transform(
            F.filter(F.split(kept, _CUT), lambda s: s.rlike(r"(?U)[^\s\x01]")),
            lambda s: strip(F.regexp_replace(s, mark, " ")),
        )

    return F.flatten(F.transform(lines_of(text), of_line))


def looks_like_heading(text: Column | str) -> Column:
    """Short, unfinished by punctuation, and numbered or mostly capitalised."""
    numbered = r"(?iU)^(\d+(\.\d+)*|[IVXLC]+|chapter|unit|section|part)\b"

    def capitalised(words: Column) -> Column:
        lettered = F.filter(words, lambda w: w.rlike(r"\p{L}"))
        share = F.size(F.filter(lettered, lambda w: w.rlike(r"^\p{Lu}"))) / F.nullif(F.size(lettered), F.lit(0))
        return F.coalesce(share >= 0.7, F.lit(False))

    def judge(x: Column) -> Column:
        shape = (x != "") & (F.length(x) <= 120) & ~x.rlike("[.,;]$")
        words = F.split(x, r"(?U)\s+")
        return F.when(shape, let(words, lambda w: (F.size(w) <= 14) & (x.rlike(numbered) | capitalised(w)))).otherwise(False)

    return F.coalesce(let(strip(text), judge), F.lit(False))


def token_count(text: Column | str) -> Column:
    """Estimated tokens: a quarter of the characters, rounded half to even, at least 1."""
    x = col(text)
    estimate = F.greatest(F.lit(1), F.bround(F.length(x) / CHARS_PER_TOKEN).cast("int"))
    return F.when(x.isNull() | (x == ""), 0).otherwise(estimate)


def truncate_tokens(text: Column | str, limit: int) -> Column:
    return F.substring(col(text), 1, max(0, int(limit * CHARS_PER_TOKEN)))


def uuid5(namespace: str, name: Column | str) -> Column:
    """Name-based UUID (RFC 4122, version 5)."""
    raw = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(raw, F.encode(col(name), "UTF-8")))

    def shape(h: Column) -> Column:
        variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat(
            F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
            F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
        )

    return let(h, shape)


def chunk_id(document_id: Column | str, text: Column | str, composed: bool = False) -> Column:
    """Id derived from the document and the content, so unchanged text keeps its id."""
    name = F.concat(col(document_id).cast("string"), F.lit(":"), content_hash(text, composed))
    return uuid5(CHUNK_NAMESPACE, name)


def valid_uuid(value: Column | str) -> Column:
    """The canonical form, or null for anything that is not a UUID. Hyphens, braces and `urn:uuid:` do not matter."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(value), "urn:|uuid:", ""), r"^[{}]+|[{}]+$", ""), "-", "")
    return F.when(bare.rlike(_UUID), F.regexp_replace(F.lower(bare), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def as_uuid(label: Column | str) -> Column:
    """A UUID stays itself; any other label maps to a stable one; blank gives null."""
    x = col(label)
    return F.when(
        x.isNotNull() & (x != ""), F.coalesce(valid_uuid(x), uuid5(CORRELATION_NAMESPACE, x))
    )


def embedding_text(name: Column | str, path: Column | str, text: Column | str) -> Column:
    """Chunk text headed by its document and heading trail."""
    trail = F.concat_ws(" > ", F.array_prepend(F.coalesce(col(path), F.array().cast("array<string>")), col(name)))
    return F.when(trail != "", F.concat(trail, F.lit("\n\n"), col(text))).otherwise(col(text))


def location_label(name, page, page_end, slide, path, source) -> Column:
    """Where a passage comes from, as shown in prompts and citations."""
    place = (
        F.when(col(page).isNotNull() & col(page_end).isNotNull(),
               F.concat(F.lit("pp."), col(page), F.lit("–"), col(page_end)))
        .when(col(page).isNotNull(), F.concat(F.lit("p."), col(page)))
        .when(col(slide).isNotNull(), F.concat(F.lit("slide "), col(slide)))
    )
    trail = F.when(F.size(col(path)) > 0, F.array_join(col(path), " › "))
    seen = F.when(col(source) == "vision", F.lit("read from an image"))
    return F.concat_ws(" · ", col(name), place, trail, seen)


def snippet(text: Column | str, limit: int = 320) -> Column:
    """A preview that never ends inside a word."""

    def cut(x: Column) -> Column:
        head = F.regexp_replace(F.substring(x, 1, limit), " [^ ]*$", "")
        return F.when(F.length(x) <= limit, x).otherwise(F.concat(head, F.lit("…")))

    return let(collapse(text), cut)


def derive_title(text: Column | str, limit: int = 60) -> Column:
    """A chat title: cut between words unless that would lose too much of it."""

    def shorten(head: Column) -> Column:
        last_blank = F.length(head) - F.instr(F.reverse(head), " ")
        at_word = (F.instr(head, " ") > 0) & (last_blank > limit * 0.6)
        kept = F.when(at_word, head.substr(F.lit(1), last_blank)).otherwise(head)
        return F.concat(F.regexp_replace(kept, r"(?U)\s+$", ""), F.lit("…"))

    def title(x: Column) -> Column:
        return (
            F.when(x == "", F.lit("New chat"))
            .when(F.length(x) <= limit, x)
            .otherwise(let(F.substring(x, 1, limit), shorten))
        )

    return let(F.coalesce(collapse(text), F.lit("")), title)


def is_refusal(text: Column | str) -> Column:
    bare = F.regexp_replace(strip(text), "^[\"'*`]+", "")
    return F.startswith(F.upper(bare), F.lit(UNSUPPORTED_TOKEN))


def normalise_heading(heading: Column | str) -> Column:
    x = F.regexp_replace(F.lower(strip(heading)), r"(?U)^\d+(\.\d+)*\.?\s+", "")
    return F.regexp_replace(x, r"(?U)[\s:.!?\-]+$", "")


def accept_rewrite(question: Column | str, rewrite: Column | str) -> Column:
    """Struct(query, fell_back): a blank or over-long rewrite gives way to the question."""
    x = F.regexp_replace(strip(rewrite), '^"+|"+$', "")
    bad = F.coalesce((x == "") | (F.length(x) > 500), F.lit(True))
    return F.struct(
        F.when(bad, col(question)).otherwise(x).alias("query"), bad.alias("fell_back")
    )
