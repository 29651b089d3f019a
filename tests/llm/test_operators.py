"""Each operator against plain loops, over awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passagework.llm import bpe, exact, lines, mixing, quality, simhash, substrings, suffixes, tokens, urls
from passagework.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, hash string, print string, position string, size string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(("river", "stone", "étude", "walk", "blue", "Über", "seven", "light", "corn,", "end.")) + r.choice("abcdefghij") * r.randrange(3) for _ in range(n))


def documents() -> list[tuple]:
    long = prose(1, 9000)
    shared = prose(2, 120)
    texts = [
        prose(3, 80), prose(3, 80), None, "", " ", "one", "two words", prose(4, 400), prose(4, 400) + " more", prose(5, 300)[:-4] + "x", prose(5, 300),
        long, "begin " + long[1000:30000], "a" * 3000, "a" * 3001, prose(6, 60) + shared + prose(7, 60), prose(8, 30) + shared, shared + "\n" + shared,
        "line\nline\n\n\nline\n", "### $$$ %%% " * 40, "日本語 テスト 🎉🎉 naïve\u00a0space\u2003wide \x1c \x1f tail", "x<|endoftext|>y <|startoftext|>", "İstanbul ΣΑΣ ﬁ e\u0301 'LL don't  \n\n  \t end ",
        "w" * 500 + " " + "1234567890" * 30,
    ]
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, 1, "x", "y", "z", "p", "q") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[7], (None, prose(3, 80), None, None, None, None, None, None, None, None), (None, "one", "de", "s1", 2, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def texts() -> list[tuple]:
    return [(r[0], r[1] or "") for r in documents()]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(docs, empty, keep):
    groups: dict[str, list] = {}
    for i, t in texts():
        groups.setdefault(t, []).append(i)
    want = []
    for i, t in texts():
        ids = [x for x in groups[t] if x is not None]
        one = len(groups[t]) == 1
        best = i if one else ({"smallest": min, "largest": max}[keep](ids) if ids else None)
        want.append((i, best, len(groups[t]), i == best, sha(t.encode())))
    for weak in (exact.content_hash, lambda c: F.substring(F.md5(c), 1, 1)):
        got = [tuple(r) for r in exact.exact_dedup(docs, keep=keep, digest=weak).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert exact.exact_dedup(empty).count() == 0
    kept = exact.without_copies(docs, keep=keep)
    assert kept.columns == docs.columns
    assert {r.text or "" for r in kept.select("text").collect()} == set(groups)


def fingerprint(text: str) -> int:
    w = text.encode().lower().split()
    shingles = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints: list[int], bits: int) -> list[int]:
    label = list(range(len(prints)))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= bits:
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_near_copies(docs, empty):
    rows = texts()
    prints = [fingerprint(t) for _, t in rows]
    label = groups_of(prints, 3)
    least = {g: min((rows[k][0] for k in range(len(rows)) if label[k] == g and rows[k][0] is not None), default=None) for g in set(label)}
    want = sorted(((rows[k][0], f"{prints[k]:016x}", least[label[k]]) for k in range(len(rows))), key=str)
    got = simhash.near_groups(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert simhash.near_groups(empty).count() == 0
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {x for x in least.values() if x is not None}


@pytest.mark.parametrize(("bits", "block"), [(3, 1024), (3, 4), (5, 1024)])
def test_links_hold_components(spark, monkeypatch, bits, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(9)
    prints = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(40):
            for _ in range(r.randrange(4)):
                base ^= 1 << r.randrange(64)
            prints.add(base)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), bits)
    back = {s: k for k, s in enumerate(signed)}
    pairs = [(back[x.a], back[x.b]) for x in found.collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= bits for a, b in pairs)
    label = {x.node: x.label for x in components(found).collect()}
    mine = [label.get(s, s) for s in signed]
    want = groups_of(prints, bits)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b").repartition(5)
    assert {r.label for r in components(chain).collect()} == {0}


@pytest.mark.parametrize("carried", [1 << 16, 5])
def test_token_counts(docs, empty, carried):
    tokenizer = Tokenizer.from_file(WORDS)
    want = sorted(((i, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in texts()), key=str)
    assert sorted((tuple(r) for r in tokens.count_tokens(docs, WORDS, carried=carried).collect()), key=str) == want
    assert tokens.count_tokens(empty, WORDS).count() == 0


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_short_and_long_words_merge_alike():
    ranks = bpe.read_ranks(RANKS)
    rng = random.Random(9)
    words = ["".join(rng.choices("aeinorst é", k=n)).encode() for n in (0, 1, 2, 5, bpe.SHORT - 1, bpe.SHORT, bpe.SHORT + 1, 400) for _ in range(50)]
    assert [bpe.merged_bytes(w, ranks) for w in words] == [bpe._merged_long(w, ranks) for w in words]


@pytest.mark.parametrize("carried", [1 << 16, 5])
def test_byte_bpe(docs, empty, carried):
    _, encoding = library()
    want = sorted(((i, len(ids := encoding.encode_ordinary(t)), sha(",".join(map(str, ids)).encode()), sha(t.encode()), ids) for i, t in texts()), key=str)
    got = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, with_ids=True, carried=carried).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_merges(spark):
    ranks, _ = library()
    whole = tiktoken.Encoding("whole", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    words = ["", *("".join(r.choice("ab") for _ in range(r.randrange(1, 60))) for _ in range(200)), *("".join(r.choice("é ñab日🎉") for _ in range(r.randrange(1, 20))) for _ in range(200)), "z" * 400]
    want = [whole.encode_ordinary(w) for w in words]
    assert [bpe.merged_bytes(w.encode(), ranks) for w in words] == want
    frame = spark.createDataFrame([(k, [ranks[bytes([b])] for b in w.encode()]) for k, w in enumerate(words)], "k int, b array<int>")
    for table in (bpe.RankMap(ranks), bpe.RankMap(ranks, (w.encode() for w in words))):
        got = dict(frame.select("k", bpe.merged(F.col("b"), table)).collect())
        assert [got[k] for k in range(len(words))] == want


def plain_counts(t: str) -> tuple:
    w = t.encode().split()
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
    seen, again = set(), 0
    for line in t.split("\n"):
        again += line in seen and bool(line.encode().split())
        seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), again, len(inside)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0), (7, 1, 0), (11, 1, 1), (19, 0, 0), (19, 0, 0), (None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    made = quality.quality(docs, labels)
    got = made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = [(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t in texts() for c in [plain_counts(t)]]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    kept = {r.doc_id for r in made.filter("kept").collect()}
    assert {0, 7} <= kept and 19 not in kept
    assert quality.quality(empty, labels).count() == 0
    unlabelled = quality.quality(docs, labels.limit(0))
    assert unlabelled.filter("kept = base_failed").count() == 0
    assert quality.passing(docs, labels).columns == docs.columns


def test_ratio_by_hand(spark):
    """Two words a side: the weights are the logs of smoothed shares."""
    docs = spark.createDataFrame([(1, "good " * 60), (2, "bad " * 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    size = 1 << 10
    scores = {r.doc_id: r.score for r in quality.quality(docs, labels, buckets=size).collect()}
    target, raw = np.array([61 / (119 + size), 60 / (119 + size)]), np.array([61 / (238 + size), 60 / (238 + size)])
    weight = np.log(target / raw)
    assert scores[1] == pytest.approx((60 * weight[0] + 59 * weight[1]) / 119)
    assert scores[1] > scores[2]


def test_mixing(docs, empty):
    rows = [(r[0], r[3], len((r[1] or "").encode().split())) for r in documents()]
    sizes: Counter = Counter()
    for _, s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    made = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r.size) for r in made if r.doc_id is not None) == sorted((i, n) for i, _, n in rows if i is not None)
    source = {i: s for i, s, _ in rows}
    taken: Counter = Counter()
    for r in made:
        assert r.taken <= 2 * r.size
        if r.doc_id is not None:
            assert r.source_size == sizes[source[r.doc_id]]
            assert r.target == pytest.approx(target[source[r.doc_id]])
        taken[r.source_size] += r.taken
    by_size = {sizes[s]: round(target[s]) for s in order}
    assert len(by_size) == len(order) and all(abs(taken[k] - v) <= 1 for k, v in by_size.items())
    positions = [r.position for r in made if r.position is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 10 ** 12
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, made), key=str)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_schedule_inverse(spark):
    schedule = ((0.0, 0.2), (0.3, 1.7), (1.0, 0.4))
    shares = [k / 50 for k in range(51)]
    frame = spark.createDataFrame([(s,) for s in shares], "s double")
    times = [r[0] for r in frame.select(mixing.time_of(F.col("s"), schedule)).collect()]
    grid = np.linspace(0, 1, 200_001)
    area = np.concatenate([[0], np.cumsum((y := np.interp(grid, *zip(*schedule, strict=True)))[1:] + y[:-1])])
    assert np.interp(times, grid, area / area[-1]) == pytest.approx(shares, abs=1e-6)


def test_substrings(docs, empty):
    made = {(r.doc_id, r.n_bytes): r for r in substrings.drop_repeated_chunks(docs).collect()}
    rows = {i: t for i, t in texts() if i is not None}
    for (i, n), r in made.items():
        if i is None:
            continue
        assert n == len(rows[i].encode()) and r.n_removed == n - len(r.kept.encode()) and r.kept_sha256 == sha(r.kept.encode())
    removed = {i: r.n_removed for (i, _), r in made.items()}
    assert removed[0] == removed[7] == removed[2] == 0
    assert removed[1] == len(rows[1].encode())
    assert removed[12] > 0.95 * len(rows[12].encode())
    shared = len(prose(2, 120).encode())
    assert removed[16] > 0.8 * shared and removed[17] > 1.7 * shared
    assert substrings.drop_repeated_chunks(empty).count() == 0


def test_chunks_resist_shifts():
    chunker = substrings.Chunker(5, 16, 128)

    def chunks(text: str) -> list[bytes]:
        held = np.frombuffer(raw := text.encode(), np.uint8)
        ends = chunker.cut(held, chunker.places(held), 0, len(held))
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    text = prose(11, 2000)
    found = chunks(text)
    assert b"".join(found).decode() == text and all(c.decode() for c in found)
    assert max(map(len, found)) <= 128 and min(map(len, found[:-1])) >= 16
    shifted = chunks(text[:4000] + "inserted" + text[4000:])
    assert len(set(found) - set(shifted)) <= 8


def removed_by_hand(rows: list[tuple], match: int) -> list[tuple]:
    seen = Counter(b[k:k + match] for _, t in rows for b in [t.encode()] for k in range(len(b) - match + 1))
    out = []
    for i, t in rows:
        b = t.encode()
        mask = bytearray(len(b))
        for k in range(len(b) - match + 1):
            if seen[b[k:k + match]] > 1:
                mask[k:k + match] = b"\1" * match
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        out.append((i, len(b), sum(mask), sum(1 for k, m in enumerate(mask) if m and not (k and mask[k - 1])), sha(kept)))
    return out


def test_suffixes(docs, empty):
    got = suffixes.drop_repeats(docs).drop("spans").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(removed_by_hand(texts(), 400), key=str)
    assert suffixes.drop_repeats(empty).count() == 0


def test_suffix_order(spark):
    r = random.Random(5)
    strings = ["".join(r.choice("ab") for _ in range(r.randrange(1, 40))) for _ in range(6)]
    letters = spark.createDataFrame([(s, i, ord(c)) for s, t in enumerate(strings) for i, c in enumerate(t)], "s long, i long, c long")
    got = sorted((x.rank, strings[x.s][x.i:]) for x in suffixes.suffix_ranks(letters, 81).collect())
    assert [t for _, t in got] == sorted(t[i:] for t in strings for i in range(len(t)))


PAGES = "page_id long, url string, html string, host string, lines string"


def pages() -> list[tuple]:
    foot = "<footer>All rights &copy; here</footer>"
    many = [(k, f"https://a.Example.COM/en/{k}?x=1", f"<html><script>p<p>q</script><p>Text {k % 9} of <b>page</b></p>{foot}", None, None) for k in range(40)]
    return [*many, (100, "http://b.org/x", foot, "h", "l"), (101, None, None, None, None), (None, "no scheme", "", None, None), (102, "ftp://c", "one\ntwo\none", None, None), many[3]]


def test_lines(spark):
    frame = spark.createDataFrame(pages(), PAGES)
    got = {r.page_id: (r.host, r.n_lines, r.n_dropped, r.kept) for r in lines.drop_boilerplate(frame).collect()}
    assert got[3] == ("a.example.com", 2, 1, ["Text 3 of page"])
    assert got[100] == ("b.org", 1, 0, ["All rights &copy; here"])
    assert got[101] == ("", 0, 0, []) and got[102] == ("c", 3, 0, ["one", "two", "one"])
    assert lines.drop_boilerplate(frame.limit(0)).count() == 0
    assert lines.drop_boilerplate(frame).count() == len(pages())


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://Example.ORG/es/1", "example.org", "/es/1", "example.org/es/", "block"), ("http://www.example.org/en/12#t", "www.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("http://example.org", "example.org", "", None, "allow"), ("x://a.com/de/?q", "a.com", "/de/", "com/de/", "block"),
    ("https://com/fr/a://b", "com", "/fr/a://b", "com/fr/", "allow"), ("http://telecom/fr/", "telecom", "/fr/", None, "allow"), ("none", "", "", None, "allow"), (None, "", "", None, "allow"),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    frame = spark.createDataFrame([(1, url)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    r = urls.filter_urls(frame, labels).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_url_templates(spark):
    """A branch of bad pages keeps its name and is blocked; its siblings merge; rare branches are variable."""
    rows = [(k, f"http://h.net/{('spam', 'news', 'blog')[k % 3]}/{k}.html") for k in range(300)] + [(1000 + k, f"http://h.net/rare{chr(97 + k)}") for k in range(5)]
    labels = [(k, int(k % 3 != 0)) for k in range(0, 300)]
    frame, known = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.page_id: (r.template, r.verdict) for r in urls.filter_urls(frame, known).collect()}
    assert got[0] == ("/spam/*", "block")
    assert got[1][1] == got[1000][1] == "allow" and got[1000][0] == "/*"
    assert urls.filter_urls(frame.limit(0), known).count() == 0


def test_url_templates_have_no_depth(spark):
    """Branches that differ at any level are parted, also behind variable ones; a lone long path, null and repeated ids, clashing columns."""
    rows = [(k, f"http://d.net/a/b/c/x{k}/d/e/{('spam', 'good')[k % 2]}/{k}.html", "t", "p", "h") for k in range(400)]
    rows += [(None, rows[0][1], "t", "p", "h"), (1, rows[1][1], "t", "p", "h"), (900, "http://d.net" + "/s" * 300, "t", "p", "h")]
    frame = spark.createDataFrame(rows, "page_id long, url string, template string, path string, host string")
    known = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int")
    got = urls.filter_urls(frame, known).collect()
    assert len(got) == len(rows)
    # The lone page has the purity of its host, where good pages are one more than half.
    wrong = [tuple(r) for r in got if r.verdict != ("allow" if "good" in r.path or r.page_id == 900 else "block")]
    assert not wrong
    assert {r.template for r in got if "spam" in r.path} == {"/*/*/*/*/*/*/spam/*"}
    assert [r.template for r in got if r.page_id == 900] == ["/*" * 300]
