"""The queries of this folder beside their SQL, and the pipeline beside its stages."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from zlib import crc32

import compare
import corpus_pipeline
import pytest
from test_near import plain_groups
from test_operators import library, plain_counts, sha

from passagework.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sf, name):
    ok, note = compare.run(spark, compare.connect(sf), sf, name)
    assert ok, note


def test_every_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf).cache()
        assert now.columns == docs.columns, name
        counts.append(now.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    assert now.select("text").distinct().count() == now.select("doc_id").distinct().count()
    ids = sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in now.select("doc_id").collect())


def plain_quality(rows: list[tuple], labels: dict[int, int], size: int = 1 << 16) -> list[tuple]:
    """Rows (id, source, text) that pass, every count and sum in a loop."""
    def grams(text: str) -> list[int]:
        h = [crc32(w) for w in text.encode().split()]
        pairs = [(((a * 0x9E3779B97F4A7C15 + b) * 0xD6E8FEB86659FD93) % (1 << 64)) >> 32 for a, b in zip(h, h[1:], strict=False)]
        return [x % size for x in h + pairs]

    raw, target = [1] * size, [1] * size
    for i, _, text in rows:
        for g in grams(text):
            raw[g] += 1
            target[g] += labels.get(i) == 1
    weight = [math.log(t / sum(target)) - math.log(r / sum(raw)) for t, r in zip(target, raw, strict=True)] if sum(target) > size else [0.0] * size
    scores, passed = {}, []
    for i, source, text in rows:
        n, _, _, _, again = plain_counts(text)
        if n >= 50 and 100 * again <= 50 * n:
            g = grams(text)
            scores[i] = sum(weight[x] for x in g) / len(g)
            passed.append((i, source, text))
    good = sorted(s for i, s in scores.items() if labels.get(i) == 1)
    bad = sorted(s for i, s in scores.items() if labels.get(i) == 0)
    limit = good[math.floor(0.01 * len(good))]
    tries = sorted(s for s in good + bad if s <= limit)
    gain = [sum(g >= t for g in good) / len(good) + (sum(b < t for b in bad) / len(bad) if bad else 0) for t in tries]
    best = tries[gain.index(max(gain))]
    below = [s for s in good + bad if s < best]
    threshold = (best + max(below)) / 2 if below else best
    return [r for r in passed if scores[r[0]] >= threshold]


def plain_mix(rows: list[tuple]) -> list[tuple]:
    sizes: Counter = Counter()
    for _, source, text in rows:
        sizes[source] += len(text.encode().split())
    order = sorted(sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else share
        left -= sum(2 * sizes[s] for s in over)
        free = free - over if over else set()
    out = []
    for s in order:
        rounds, rest = divmod(round(target[s]), sizes[s])
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest()[:15], r[0]))
        for r in mine:
            n = len(r[2].encode().split())
            part = max(0, min(n, rest))
            rest -= part
            out += [r] * (rounds + (part > 0 and 2 * part >= n))
    return out


def test_pipeline_by_hand(spark, sf):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = plain_quality(rows, labels)
    last = {text: max(i for i, _, t in rows if t == text) for _, _, text in rows}
    rows = [r for r in rows if last[r[2]] == r[0]]
    label = plain_groups([t for _, _, t in rows])
    rows = [r for r, g in zip(rows, label, strict=True) if r[0] == min(x[0] for x, h in zip(rows, label, strict=True) if h == g)]
    _, encoding = library()
    want = sorted((i, len(ids := encoding.encode_ordinary(t)), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for i, _, t in plain_mix(rows))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == want
