"""Where a caller plugs in models: embedder, scorer, responder.

A hook is a plain callable run inside tasks on Arrow batches. The stand-ins are deterministic,
so jobs can be run and checked with no model at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.functions.text import UNSUPPORTED_TOKEN

EMBED_BATCH = 64
PASSAGE_CHARS = 4000
STAND_IN = "The first source settles it [S1]."

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Scorer = Callable[[str, Sequence[str]], Sequence[float]]
Responder = Callable[[str], str]


def _with_columns(df: DataFrame, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *fields])


def embed(df: DataFrame, embedder: Embedder, text: str = "text", out: str = "vector", batch: int = EMBED_BATCH) -> DataFrame:
    """Adds a vector per row; a batch whose count comes back wrong fails the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            vectors: list[Sequence[float]] = []
            for start in range(0, len(pdf), batch):
                texts = pdf[text].iloc[start : start + batch].tolist()
                got = list(embedder(texts))
                if len(got) != len(texts):
                    raise ValueError(f"embedder returned {len(got)} vectors for {len(texts)} texts")
                vectors.extend(got)
            yield pdf.assign(**{out: vectors})

    return df.mapInPandas(run, _with_columns(df, T.StructField(out, T.ArrayType(T.DoubleType()))))


def score(df: DataFrame, scorer: Scorer, key: str = "query_id", query: str = "text", passage: str = "passage", order: str = "rank",
          out: str = "relevance", passage_chars: int = PASSAGE_CHARS) -> DataFrame:
    """Adds the relevance of a passage to its query. The scorer is called once for each key, with all its passages in order,
    each cut to `passage_chars`; a key's rows are its candidates, a few dozen at most."""

    def scored(rows: pd.DataFrame) -> pd.DataFrame:
        values = list(scorer(rows[query].iloc[0], [p[:passage_chars] for p in rows[passage]]))
        if len(values) != len(rows):
            raise ValueError(f"scorer returned {len(values)} scores for {len(rows)} passages")
        return rows.assign(**{out: [float(v) for v in values]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in frames:
            rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(rows):
                continue
            # The last key may go on in the next batch.
            open_ = rows[key] == rows[key].iloc[-1]
            held = rows[open_]
            for _, group in rows[~open_].groupby(key, sort=False):
                yield scored(group)
        if held is not None and len(held):
            yield scored(held)

    grouped = df.repartition(key).sortWithinPartitions(key, order)
    return grouped.mapInPandas(run, _with_columns(df, T.StructField(out, T.DoubleType())))


def respond(df: DataFrame, responder: Responder, prompt: str = "prompt") -> DataFrame:
    """Adds `response` and `error`: a prompt that fails becomes an error row, never a failed job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            said, failed = [], []
            for text in pdf[prompt]:
                try:
                    said.append(responder(text))
                    failed.append(None)
                except Exception as problem:  # noqa: BLE001
                    said.append(None)
                    failed.append(str(problem)[:4000])
            yield pdf.assign(response=said, error=failed)

    return df.mapInPandas(run, _with_columns(df, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())))


def stand_in_response(prompt: str) -> str:
    """Declines without a source, otherwise answers with one citation."""
    if "[S1]" not in prompt:
        return UNSUPPORTED_TOKEN
    return STAND_IN


def overlap_scorer(question: str, passages: Sequence[str]) -> list[float]:
    """Stand-in scorer: share of the question's distinct words found in the passage."""
    import re

    asked = set(re.findall("[a-z0-9]+", question.lower()))
    return [len(asked & set(re.findall("[a-z0-9]+", p.lower()))) / max(len(asked), 1) for p in passages]
