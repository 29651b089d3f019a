import hashlib
import time
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from passagework.functions import citations as c
from passagework.functions import sparse as sp
from passagework.functions import text as t
from passagework.functions import vectors as v
from passagework.functions.stemming import stem_word


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("raw,want", [
    ("", ""), ("ﬁne  text", "fine text"), ("a\x00b", "ab"), ("line\r\nnext", "line\nnext"), ("normal-\nised", "normalised"),
    ("a\n\n\n\n\nb", "a\n\nb"), ("  x   y  ", "x y"), (" a \n b ", "a\nb")])
def test_normalize(spark, raw, want):
    assert value(spark, t.normalize(F.lit(raw))) == want


def test_hash_ignores_white_space_noise(spark):
    assert value(spark, t.content_hash(F.lit("a  b"))) == value(spark, t.content_hash(F.lit(" a b "))) == hashlib.sha256(b"a b").hexdigest()


def test_settled_texts_stay_out_of_python(spark):
    """Only what composition may change is sent to it; white space of all kinds goes as before."""
    settled, open_ = ["plain", "Déjà vu – “so”, größer", "łódź İ ß", ""], ["ﬁne", "e\u0301", "x²", "…", "a\u00a0b", "Ａ", "ᄀ\u1161"]
    rows = spark.createDataFrame([(x,) for x in settled + open_], "x string").select("x", F.col("x").rlike(t._UNSETTLED).alias("sent"), t.normalize("x").alias("n"))
    assert {r.x: r.sent for r in rows.collect()} == {x: x in open_ for x in settled + open_}
    assert all(r.n == unicodedata.normalize("NFKC", r.x) for r in rows.collect())
    blanks = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
    assert value(spark, t.strip(F.lit(f"{blanks}a{blanks}b{blanks}"))) == f"a{blanks}b"
    assert value(spark, t.collapse(F.lit(f"{blanks}a\u2003b c{blanks}"))) == "a b c"


def test_sentences_cost_a_few_scans(spark):
    """Abbreviations are looked back for at full stops only; at every character it took 18 times as long as the plain cut."""
    text = spark.range(4).select(F.concat(F.repeat(F.lit("several words without an end "), 40_000), F.col("id")).alias("x")).cache()
    text.count()

    def took(column):
        times = []
        for _ in range(3):
            start = time.perf_counter()
            text.select(column.alias("y")).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return min(times)

    assert took(F.regexp_replace("x", t._JOIN, " ")) < 6 * took(F.split("x", t._CUT))


@pytest.mark.parametrize("raw,want", [
    ("One. Two! Three?", ["One.", "Two!", "Three?"]), ("See Dr. Smith. He knows.", ["See Dr. Smith.", "He knows."]), ("e.g. this one", ["e.g. this one"]),
    ("J. Doe wrote it.", ["J. Doe wrote it."]), ("first line\nsecond line", ["first line", "second line"]), ("  \n ", []), ("Ends with etc.", ["Ends with etc."]),
    ("Apples, etc.  Pears.", ["Apples, etc. Pears."])])
def test_split_sentences(spark, raw, want):
    assert value(spark, t.split_sentences(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [
    ("3.2 Normalization", True), ("Chapter 4", True), ("UNIT III", True), ("Third Normal Form", True), ("this is just a sentence", False),
    ("Ends With A Stop.", False), ("", False), ("A " * 20, False), ("Key Terms:", True), ("* * *", False)])
def test_looks_like_heading(spark, raw, want):
    assert value(spark, t.looks_like_heading(F.lit(raw))) is want


@pytest.mark.parametrize("raw,want", [("", 0), ("a", 1), ("a" * 10, 2), ("a" * 14, 4), ("a" * 400, 100)])
def test_token_count_rounds_half_to_even(spark, raw, want):
    assert value(spark, t.token_count(F.lit(raw))) == want


def test_ids(spark):
    want = uuid.uuid5(uuid.UUID(t.CHUNK_NAMESPACE), "doc:" + hashlib.sha256(b"some text").hexdigest())
    assert value(spark, t.chunk_id(F.lit("doc"), F.lit("some  text"))) == str(want)
    assert value(spark, t.as_uuid(F.lit("run 7"))) == str(uuid.uuid5(uuid.UUID(t.CORRELATION_NAMESPACE), "run 7"))
    assert value(spark, t.as_uuid(F.lit("6F2A1C94-3b7d-4e51-9a08-52d1f7c0e3b6"))) == "6f2a1c94-3b7d-4e51-9a08-52d1f7c0e3b6"
    for said in ("6f2a1c943b7d4e519a0852d1f7c0e3b6", "{6F2A1C94-3b7d-4e51-9a08-52d1f7c0e3b6}", "urn:uuid:6f2a1c94-3b7d-4e51-9a08-52d1f7c0e3b6"):
        assert value(spark, t.as_uuid(F.lit(said))) == str(uuid.UUID(said))
    assert value(spark, t.as_uuid(F.lit(""))) is None
    assert value(spark, t.tidy(F.lit("a-\nb-\nc"))) == "ab-\nc"


@pytest.mark.parametrize("raw,want", [("NOT_SUPPORTED", True), ('"Not_Supported."', True), ("`NOT_SUPPORTED` because", True), ("It is supported", False)])
def test_is_refusal(spark, raw, want):
    assert value(spark, t.is_refusal(F.lit(raw))) is want


def test_location_and_snippet(spark):
    null = F.lit(None).cast("int")
    path = F.array(F.lit("A"), F.lit("B"))
    assert value(spark, t.location_label(F.lit("n.pdf"), F.lit(2), F.lit(4), null, path, F.lit("text"))) == "n.pdf · pp.2–4 · A › B"
    assert value(spark, t.location_label(F.lit("d"), null, null, F.lit(3), F.array().cast("array<string>"), F.lit("vision"))) == "d · slide 3 · read from an image"
    assert value(spark, t.snippet(F.lit("one two three"), 9)) == "one two…"


@pytest.mark.parametrize("raw,want", [("7. References:", "references"), ("3.2. Key Terms?", "key terms"), ("Plain", "plain")])
def test_normalise_heading(spark, raw, want):
    assert value(spark, t.normalise_heading(F.lit(raw))) == want


def test_terms(spark):
    assert value(spark, sp.terms(F.lit("The B-tree of 3.5, a 3NF!"), stem=False)) == ["b-tree", "3.5", "3nf"]
    assert value(spark, sp.terms(F.lit("normalization"))) == value(spark, sp.terms(F.lit("normalized")))
    assert value(spark, sp.term_index(F.lit("normal"))) == 3867909202
    assert value(spark, sp.saturate(F.lit(1))) == 1.0
    assert 2.2 < value(spark, sp.saturate(F.lit(50))) < 2.5


@pytest.mark.parametrize("word,stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("running", "run"), ("hoping", "hope"), ("relational", "relat"), ("happily", "happili"),
    ("dying", "die"), ("skies", "sky"), ("agreed", "agre"), ("nationalism", "nation"), ("consistency", "consist"), ("knightly", "knight"), ("news", "news"),
    ("generically", "generic"), ("communism", "communism"), ("proceed", "proceed"), ("controlling", "control"), ("effective", "effect"), ("replacement", "replac")])
def test_stems(word, stem):
    assert stem_word(word) == stem


@pytest.mark.parametrize("raw,want", [
    ("x [S1] y", ["S1"]), ("[S3, S1]", ["S1", "S3"]), ("[S2-S4]", ["S2", "S3", "S4"]), ("[S1; S3][S10]", ["S1", "S3", "S10"]), ("[S1-S40]", ["S1", "S40"]),
    ("[S5–S3]", ["S3", "S5"]), ("[T1] S2", [])])
def test_cited_markers(spark, raw, want):
    assert value(spark, c.cited_markers(F.lit(raw))) == want


def test_strip_markers_and_shingles(spark):
    assert value(spark, c.strip_markers(F.lit("It is so [S1, S2] and [S3] done"))) == "It is so and done"
    assert value(spark, c.shingles(F.lit("a b c"))) == ["a b c"]
    assert value(spark, c.shingles(F.lit("..."))) == []
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("x"))
    assert value(spark, c.overlap_coefficient(a, b)) == 1.0


def test_vectors(spark):
    assert value(spark, v.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert value(spark, v.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert value(spark, v.hashed_embedding(4)(F.lit("..."))) == [1.0, 0.0, 0.0, 0.0]
