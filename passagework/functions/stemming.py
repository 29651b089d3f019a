"""The English Snowball stemmer (Porter2), after its published description.

Built-ins cannot stem, so this runs as an Arrow-batched Pandas UDF over token arrays. A
per-worker memo makes all but the first sight of a term a dictionary lookup; no shuffle is
needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published algorithm.
_V = "aeiouy"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news",
    "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive",
    "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence",
    "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
_STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
    "ive", "ize", "al", "er", "ic",
)
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"


def _region(word: str, start: int) -> int:
    found = re.compile(f"[{_V}][^{_V}]").search(word, start)
    return found.end() if found else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(rf"(?:[^{_V}][{_V}][^{_V}wxY]|^[{_V}][^{_V}])$", word))


@lru_cache(maxsize=200_000)
def stem_word(word: str) -> str:
    w = word.lower()
    if w in _WHOLE:
        return _WHOLE[w]
    if len(w) <= 2:
        return w
    w = w.lstrip("'") if w.startswith("'") else w
    w = re.sub(rf"^y|(?<=[{_V}])y", "Y", w)
    known = re.match("gener|commun|arsen", w)
    r1 = known.end() if known else _region(w, 0)
    r2 = _region(w, r1)

    w = re.sub(r"(?:'s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w

    if w.endswith(("eedly", "eed")):
        size = 5 if w.endswith("eedly") else 3
        if len(w) - size >= r1:
            w = w[: len(w) - size] + "ee"
    else:
        ending = re.search("(?:ingly|edly|ing|ed)$", w)
        if ending and re.search(f"[{_V}]", w[: ending.start()]):
            w = w[: ending.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLE):
                w = w[:-1]
            elif len(w) <= r1 and _short_end(w):
                w += "e"

    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"

    for suffix in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1:
                if suffix == "ogi":
                    w = w[:-1] if w[at - 1 : at] == "l" else w
                elif suffix == "li":
                    w = w[:-2] if w[at - 1 : at] in tuple(_LI) else w
                else:
                    w = w[:at] + _STEP2[suffix]
            break

    for suffix in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1:
                if suffix != "ative":
                    w = w[:at] + _STEP3[suffix]
                elif at >= r2:
                    w = w[:at]
            break

    for suffix in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break

    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda terms: None if terms is None else [stem_word(t) for t in terms])
