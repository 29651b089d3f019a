"""Near-dedup at a similarity of 0.8 beside plain loops over all pairs."""

from __future__ import annotations

import random

import pytest
import xxhash
from test_operators import SCHEMA, documents, prose

from passagework.llm import near
from passagework.llm.components import components

LOW = (1 << 64) - 1


def plain_print(text: str) -> int:
    """512 bits, the first of them the highest."""
    w = text.encode().lower().split()
    hashes = {xxhash.xxh64_intdigest(b" ".join(w[k:k + 5]), 42) for k in range(max(1, len(w) - 4))} if w else set()
    out = 0
    for n in range(8):
        rows = []
        for h in hashes:
            x = h * int(near.MIX[n]) & LOW
            x = (x ^ x >> 32) * int(near.MIX[0]) & LOW
            rows.append(int.from_bytes((x ^ x >> 29).to_bytes(8, "little"), "big"))
        for bit in range(63, -1, -1):
            out = out << 1 | (2 * sum(r >> bit & 1 for r in rows) > len(rows))
    return out


def plain_linked(a: int, b: int, bits: int = 90) -> bool:
    """Within `bits`, and from some start 20 bits agree and each further word keeps to 16 differences a word."""
    apart = f"{a ^ b:0512b}"
    return apart.count("1") <= bits and any(
        "1" not in turned[:20] and all(turned[:64 * n].count("1") <= 16 * n for n in range(1, 8)) for s in range(0, 512, 4) for turned in [apart[s:] + apart[:s]])


def plain_labels(prints: list[int]) -> list[int]:
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if label[a] != label[b] and plain_linked(prints[a], prints[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


def plain_groups(texts: list[str]) -> list[int]:
    return plain_labels([plain_print(t) for t in texts])


def test_print_by_hand():
    for text in ("", "one", "a b c d e f", prose(3, 40), prose(4, 700)):
        assert int.from_bytes(near.wide_print(text.encode(), 5, 42), "big") == plain_print(text)


@pytest.mark.parametrize("block", [1024, 5])
def test_links_hold_components(spark, monkeypatch, block):
    """Chains of near prints, strangers that share a head with them, and a hot key."""
    monkeypatch.setattr(near, "BLOCK", block)
    r = random.Random(9)
    prints = set()
    for _ in range(6):
        base = r.getrandbits(512)
        for _ in range(20):
            for _ in range(r.randrange(60)):
                base ^= 1 << r.randrange(512)
            prints.add(base)
        prints |= {base >> 400 << 400 | r.getrandbits(400) for _ in range(8)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(k, bytearray(p.to_bytes(64, "big"))) for k, p in enumerate(prints)], "node long, print binary").repartition(3)
    found = near.wide_links(nodes).distinct()
    pairs = [(x.a, x.b) for x in found.collect()]
    assert pairs and all((prints[a] ^ prints[b]).bit_count() <= 90 for a, b in pairs)
    label = {x.node: x.label for x in components(found).collect()}
    assert [label.get(k, k) for k in range(len(prints))] == plain_labels(prints)


def test_awkward_rows(spark):
    """Null and empty texts, null ids, repeated rows, ties and clashing columns; an empty table."""
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(3)
    rows = [(r[0], r[1] or "") for r in documents()]
    label = plain_groups([t for _, t in rows])
    least = {g: min((rows[k][0] for k in range(len(rows)) if label[k] == g and rows[k][0] is not None), default=None) for g in set(label)}
    got = near.similar_groups(docs).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((rows[k][0], least[label[k]]) for k in range(len(rows))), key=str)
    kept = near.without_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(x for x in least.values() if x is not None)
    assert near.similar_groups(docs.limit(0)).count() == near.without_similar(docs.limit(0)).count() == 0


def test_recall(spark):
    """Copies with words replaced, by exact Jaccard: all but a tenth at 0.8 and more found, strangers and loose kin left alone."""
    r = random.Random(4)
    texts, pairs = [], []
    for k in range(300):
        w = [f"w{r.randrange(4000)}" for _ in range(r.randrange(60, 300))]
        v = list(w)
        for at in r.sample(range(len(w)), max(1, round(len(w) * r.choice((0.005, 0.01, 0.018, 0.06, 0.3))))):
            v[at] = f"x{r.randrange(4000)}"
        sets = [{tuple(t[j:j + 5]) for j in range(len(t) - 4)} for t in (w, v)]
        pairs.append((2 * k, 2 * k + 1, len(sets[0] & sets[1]) / len(sets[0] | sets[1])))
        texts += [" ".join(w), " ".join(v)]
    got = {x.doc_id: x.component_id for x in near.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    alike = [got[a] == got[b] for a, b, j in pairs if j >= 0.8]
    assert len(alike) > 100 and sum(alike) >= 0.9 * len(alike)
    assert not any(got[a] == got[b] for a, b, j in pairs if j < 0.6)
    assert all(got[k] in (k, k - 1) for k in got)


def test_chance_meetings_stay_in_proportion():
    """Unlike prints that share a head with a print grow with about the fourth root of their number; a head of fixed length gave twice as many for twice the prints."""
    for n in (100, 50_000, 200_000, 10**7, 10**9):
        head, orders = near.rings(n)
        assert n * len(orders) / 2 ** head < n ** 0.25 and head + len(orders).bit_length() < 63
        assert all(sorted(o) == list(range(512)) for o in orders)


def test_longer_heads_find_the_same(spark, monkeypatch):
    """Pairs 77 bits apart among strangers, with heads as long as for 2^20 prints: nearly all are linked, and no stranger."""
    r = random.Random(12)
    prints = []
    for _ in range(300):
        a, b = r.getrandbits(512), 0
        for bit in r.sample(range(512), 77):
            b |= 1 << bit
        prints += [a, a ^ b]
    monkeypatch.setattr(near, "SPARE", near.SPARE + 20 - (len(prints) - 1).bit_length())
    assert near.rings(len(prints))[0] == 25
    nodes = spark.createDataFrame([(k, bytearray(p.to_bytes(64, "big"))) for k, p in enumerate(prints)], "node long, print binary").repartition(3)
    pairs = {(min(x.a, x.b), max(x.a, x.b)) for x in near.wide_links(nodes).collect()}
    assert all(a % 2 == 0 and b == a + 1 for a, b in pairs) and len(pairs) >= 0.95 * 300


def test_links_of_a_group_do_not_multiply_by_chains(spark):
    """Near copies of one print: no more links each than there are chains in the part searched first, though most chains bring many together."""
    r = random.Random(21)
    base, prints = r.getrandbits(512), set()
    while len(prints) < 400:
        mask = 0
        for bit in r.sample(range(512), 20):
            mask |= 1 << bit
        prints.add(base ^ mask)
    nodes = spark.createDataFrame([(k, bytearray(p.to_bytes(64, "big"))) for k, p in enumerate(sorted(prints))], "node long, print binary").repartition(3)
    found = near.wide_links(nodes)
    first = -(-len(near.rings(400)[1]) // near.STEP)
    assert 399 <= found.distinct().count() < (first + 1) * 400
    assert {x.label for x in components(found).collect()} == {0}
