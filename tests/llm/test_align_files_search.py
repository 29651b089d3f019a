"""Alignment, token files and ranked search against plain loops over awkward rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from test_operators import SCHEMA, WORDS, documents, prose, texts
from tokenizers import Tokenizer

from passagework.llm import align, binary, lexical, units

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = [
    (900, "  two  spaces and a tail  "), (901, "literal ▁ mark"), (902, "<s> <unk> </s> <0x41> <|endoftext|>"), (903, " \n \t x　y   z \x85 end"),
    (904, "nul \x00 byte"), (905, "日本 語 テスト 。 ﷽ 🎉 🎉🎉"), (906, "¡Ñandú! œuvre à l'été\r\n\r\n  done"), (907, prose(31, 700)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = documents() + [(i, t, *[None] * 8) for i, t in MORE]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_alignment(rows: list[tuple]) -> list[tuple]:
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = align.byte_letters()
    back = {i: bytes(letters[c] for c in piece) for piece, i in a.get_vocab().items()}

    def piece(i: int) -> bytes:
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    made = []
    for i, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if any(b"".join(x) != (" " + text).encode() for x in ([back[t] for t in ids_a], [piece(t) for t in ids_b])):
            ids_a, ids_b = [], []
        ends_a, ends_b = [np.cumsum([len(f(t)) for t in ids]).tolist() for f, ids in ((back.get, ids_a), (piece, ids_b))]
        both = sorted(set(ends_a) & set(ends_b))
        links = [(ids_a[ends_a.index(e)], ids_b[ends_b.index(e)]) for e in both]
        groups, before = [], 0
        for e in both:
            groups.append("|".join(",".join(str(t) for t, end in zip(ids, ends, strict=True) if before < end <= e) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
            before = e
        made.append((i, len(ids_a), len(ids_b), links, ";".join(groups)))
    counts = Counter(x for row in made for x in row[3])
    best: dict[int, int] = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(i, na, nb, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "", g) for i, na, nb, links, g in made]


@pytest.mark.parametrize(("piece", "carried", "remembered"), [(align.PIECE, 1 << 18, 300_000), (7, 50, 40), (2, 0, 300_000)])
def test_align(docs, monkeypatch, piece, carried, remembered):
    monkeypatch.setattr(units, "REMEMBERED", remembered)
    want = plain_alignment(texts() + MORE)
    got = [tuple(r) for r in align.align(docs, A, B, piece=piece, carried=carried, with_groups=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_align_nothing(empty):
    assert align.align(empty, A, B).count() == 0


@pytest.mark.parametrize("piece", [1, 2, 3, 5, 64])
def test_merge_path(piece):
    r = random.Random(piece)
    for _ in range(60):
        a, b = (np.array(sorted(r.sample(range(80), r.randrange(40)))) for _ in range(2))
        cuts = align.merge_path(a, b, piece)
        assert cuts[0].tolist() == [0, 0] and cuts[-1].tolist() == [len(a), len(b)] and (np.diff(cuts, axis=0) >= 0).all()
        assert np.diff(cuts.sum(axis=1)).max(initial=0) <= max(piece, 2) + 1
        i, j = align.common_ends(a, b, piece)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_token_files(spark, docs, tmp_path):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = sorted(texts() + MORE, key=lambda r: (r[0] is not None, r[0]))
    path = str(tmp_path / "ids")
    binary.write_tokens(docs, path, WORDS, file_bytes=20_000, stripe_bytes=1 << 16)
    read = binary.read_tokens(spark, path)
    got = sorted(read.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    assert [r.start for r in got] == np.append(0, np.cumsum([r.n_tokens for r in got])[:-1]).tolist()
    ids = {t: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for _, t in rows}
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(ids[t])) for i, t in rows)
    assert all(r.n_tokens == len(r.ids) for r in got)
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in binary.token_checksums(read).collect()}
    assert sums == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    assert sorted(r.start for r in binary.find_tokens(spark, path, [7, 12, 5555]).collect()) == sorted(r.start for r in got if r.doc_id in (7, 12))
    assert binary.find_tokens(spark, path, [5555]).count() == 0
    low, high = got[5].start + 1, got[20].start + 1
    assert sorted(r.start for r in binary.tokens_between(spark, path, low, high).collect()) == [r.start for r in got if r.start < high and r.start + r.n_tokens > low]


def test_token_files_of_nothing(spark, empty, tmp_path):
    path = str(tmp_path / "ids")
    binary.write_tokens(empty, path, WORDS)
    assert binary.read_tokens(spark, path).count() == 0
    assert binary.find_tokens(spark, path, [1]).count() == 0


def test_token_files_are_pruned(spark, tmp_path):
    """Ids of every second number: a look-up reads few rows of an index entry whose span it lies in but whose filter lacks it."""
    path = str(tmp_path / "ids")
    binary.write_tokens(spark.range(40_000).select((2 * F.col("id")).alias("doc_id"), F.lit("one two three").alias("text")), path, WORDS, stride=1000)
    files = [f for f in os.listdir(path) if f.endswith(".orc")]
    assert len(files) >= 8

    def rows_read(wanted: int) -> tuple[int, int]:
        found = binary.find_tokens(spark, path, [wanted])
        plan = found._jdf.queryExecution()
        n = found._jdf.collectAsList().size()
        scans, todo = [], [plan.executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                todo.append(node.executedPlan())
            elif "QueryStage" in node.nodeName():
                todo.append(node.plan())
            elif node.nodeName().startswith("Scan orc") and "n_tokens" in node.simpleString(100):
                scans.append(node.metrics().apply("numOutputRows").value())
            else:
                kids = node.children()
                todo += [kids.apply(k) for k in range(kids.size())]
        return n, sum(scans)

    assert rows_read(30_000) == (1, 1000)
    assert rows_read(30_001) == (0, 0)


def plain_search(rows: list[tuple], items: list[tuple], k: int = 20) -> list[tuple]:
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text: str) -> list[str]:
        return [t.decode() for t in (x.group().encode().lower() for x in word.finditer(text))]

    counts = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    made = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 75 + 25 * c.total() * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in Counter(terms(text or "")).items())
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        made += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return made


ITEMS = [(1, prose(4, 60)), (1, "river STONE river"), (2, None), (3, ""), (4, "no such thing anywhere zzz"), (5, "日本語 テスト É étude Étude"), (6, prose(5, 40)), (None, "aaaa one"), (8, "two words two"), (9, prose(1, 500)), (10, "!!! ---")]


@pytest.mark.parametrize(("leaf", "tree_docs", "places", "tree_terms", "block"), [(64, 1 << 15, 1 << 22, 1 << 13, 1 << 24), (2, 5, 40, 12, 300), (1, 100, 10_000, 3, 1)])
def test_search(spark, docs, monkeypatch, leaf, tree_docs, places, tree_terms, block):
    for name, value in (("LEAF", leaf), ("TREE_DOCS", tree_docs), ("TREE_PLACES", places), ("TREE_TERMS", tree_terms)):
        monkeypatch.setattr(lexical, name, value)
    items = spark.createDataFrame([(i, t, "x", "y") for i, t in ITEMS], "item_id long, text string, doc_id string, score string")
    k = 3 if block == 1 else 20
    got = [tuple(r) for r in lexical.search(docs, items, k=k, block_bytes=block).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == sorted(plain_search(texts() + MORE, ITEMS, k), key=str)


def test_tree_bounds_and_leaves():
    """No score below a node exceeds its bound; leaves hold each document once; only branches worth it are opened."""
    r = np.random.default_rng(3)
    lists = [np.unique(np.minimum(r.geometric(0.06, r.integers(1, 30)), 60) - 1) for _ in range(900)]
    at = np.append(0, np.cumsum([len(x) for x in lists]))
    terms = np.concatenate(lists)
    tfs, m = r.integers(1, 9, len(terms)), r.integers(76, 400, len(lists))
    tree = lexical.Tree(at, terms, tfs, m, 60)
    own, weights = np.array([41, 3, 58]), np.array([5000, 200, 7000])
    bound = tree.bounds(own, weights)
    worth = np.zeros(60, np.int64)
    worth[own] = weights
    scores = np.array([(worth[terms[a:b]] * (10 ** 9 * tfs[a:b] // (1000 * tfs[a:b] + 12 * m[k]))).sum() for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))])
    for (lo, hi, _), b in zip(tree.stretch, bound, strict=True):
        assert scores[tree.order[lo:hi]].max() <= b
    leaves = [np.arange(lo, hi) for (lo, hi, _), below in zip(tree.stretch, tree.children, strict=True) if not below]
    assert sorted(np.concatenate(leaves).tolist()) == list(range(900))
    enough = int(np.sort(scores)[-5])
    seen = [(d, s) for docs, found in tree.search(own, weights, 60, lambda: enough) for d, s in zip(docs.tolist(), found.tolist(), strict=True)]
    assert all(scores[d] == s for d, s in seen) and {d for d, s in seen if s >= enough} == set(np.flatnonzero(scores >= enough).tolist())
    assert len(seen) < 900


def test_search_nothing(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
