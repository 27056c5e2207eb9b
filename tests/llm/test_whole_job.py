"""Cases in which an operator once did less than its whole job."""

import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docfields.llm import common, components, hnsw, html_cut, minhash, quality, substring
from docfields.llm.queries import PIECES


@pytest.mark.parametrize("first, last", [(0x4E00, 0x9000), (0x3041, 0x3090), (0x0E01, 0x0E2E)])
def test_repeats_in_scripts_without_spaces_go(spark, first, last):
    rng = random.Random(20)
    letters = lambda n: "".join(chr(rng.randint(first, last)) for _ in range(n))
    passage, phrase = letters(400), letters(9)
    texts = [letters(300) + passage + letters(300), letters(200) + passage + letters(200), letters(90) + phrase + letters(90), phrase]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in substring.dedup_substrings(docs).collect()}
    assert got[1].n_cut == 1 and 400 <= len(got[1].text) <= 550 and got[1].first_docs == [0]
    assert all(got[i].text == texts[i] for i in (0, 2, 3))


def test_words_of_spaced_scripts_stay_words():
    assert substring.words_in("यह एक लंबा वाक्य है — “हाँ”".encode()) == 7
    assert substring.words_in("漢字かな。 and two".encode()) == 4


def random_words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_texts_that_share_an_id_are_cut_each_for_itself(spark):
    rng = random.Random(21)
    copied, unique = random_words(rng, 200), random_words(rng, 200)
    for alone, other in ((unique, copied), (unique + " a", copied), (unique + " b", copied)):
        docs = spark.createDataFrame([(1, copied), (7, alone), (7, other), (7, other)], "doc_id long, text string")
        got = sorted((r.doc_id, r.text) for r in substring.dedup_substrings(docs).collect())
        assert got == sorted([(1, copied), (7, alone), (7, ""), (7, "")])
    # a passage of two texts of one id stays once
    docs = spark.createDataFrame([(7, copied), (7, copied + " " + unique)], "doc_id long, text string")
    texts = [r.text for r in substring.dedup_substrings(docs).collect()]
    assert sum(map(len, texts)) <= len(copied) + len(unique) + 100 and " ".join(texts).count(copied[600:800]) == 1


def written_by(monkeypatch, *modules):
    """Tables that the modules write from now on, by name."""
    tables = {}

    def saved(df, name, *rows):
        out = common.saved(df, name, *rows)
        tables.setdefault(name, []).append(out)
        return out

    for m in modules:
        monkeypatch.setattr(m, "saved", saved)
    return tables


def left_of(tables):
    return {name for name, found in tables.items() for t in found if Path(t.scratch.removeprefix("file:")).exists()}


def test_substrings_leave_little_on_disk(spark, monkeypatch):
    """The count of all chunks ships half a digest a chunk; only the marks stay written."""
    tables = written_by(monkeypatch, substring)
    rng = random.Random(23)
    copied = random_words(rng, 200)
    texts = [random_words(rng, 100) + f" {i} " + (copied if i % 2 else "") for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring.dedup_substrings(docs)
    assert sum(copied[100:800] in r.text for r in got.collect()) == 1
    assert tables["substring-halves"][0].columns == ["high"] and left_of(tables) == {"substring-marks"}


def test_chunks_are_told_apart_by_whole_digests(spark, monkeypatch):
    rng = random.Random(24)
    copied = random_words(rng, 200)
    texts = [random_words(rng, 100) + f" {i} " + (copied if i % 2 else "") for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(substring.dedup_substrings(docs).collect())
    rows = substring.chunk_rows
    monkeypatch.setattr(substring, "chunk_rows", lambda d: rows(d).withColumn("high", F.lit(5).cast("long")))
    assert sorted(substring.dedup_substrings(docs).collect()) == want and sum(r.n_cut for r in want) == 5


def test_near_duplicates_leave_little_on_disk(spark, monkeypatch):
    """Signatures, sets and pairs go once the components are written."""
    tables = written_by(monkeypatch, minhash, components)
    rng = random.Random(25)
    words = random_words(rng, 120).split()
    texts = [" ".join(words[:i] + [f"x{i}"] + words[i + 1:]) for i in range(20)] + [random_words(rng, 60)] * 2
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (90, None)], "doc_id long, text string")
    got = minhash.near_duplicates(docs)
    assert {r.doc_id for r in got.where("kept").collect()} == {0, 20, 90}
    assert left_of(tables) - {"minhash-rest", "minhash-named-rare", "minhash-several", "minhash-held", "minhash-apart"} == {
        "minhash-counts", "minhash-named"}


def test_near_dedup_goes_by_row(spark):
    rng = random.Random(22)
    copied, unique, third = (random_words(rng, 80) for _ in range(3))
    rows = [(1, copied, "a"), (7, unique, "a"), (7, copied, "a"), (7, copied, "b"), (9, third, "b"), (9, third, "a"), (None, third, "c"),
            (12, unique + " end", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame(
        [rows[0], rows[1], (9, third, "a"), rows[6]], docs.schema).collect()))


STORY = "<article><h1>News</h1><p>A long sentence of the story.</p></article>"


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><meta charset=x><link rel=y><body>{STORY}",
    f"<head><title>T</title>{STORY}",
    f"<html><head><template><div>x</div></template><script>a('<head>')</script></head><body>{STORY}</body>",
    f"<html><head><script>if (i<n) x(); // it's\n</script></head><body>{STORY}",
    f"<body><div><button>Go</div>{STORY}<button>x</button>",
    f"<body><select><option>A<option>B{STORY}",
    f"<body><svg><title/><path d='x'>{STORY}",
    f"<body><p><video src=x></p>{STORY}<object><script>'</object>'</script><p>none</p></object>",
])
def test_skipped_elements_without_an_end_tag(page):
    assert html_cut.main_text(page) == "News\nA long sentence of the story."


def test_many_unclosed_elements_take_linear_time():
    assert html_cut.main_text("<article>" + "<object><p>w w. " * 5000 + "</object>").count("w w.") >= 4999


def test_junk_in_small_groups_goes(spark):
    rng = random.Random(23)
    parts = ["".join(rng.choice(x) for x in ("bcdfglmnprst", "aeiou", "lmnrst")) for _ in range(300)]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(4000)]
    prose = lambda n, w=words: " ".join(rng.choice(w) for _ in range(n)) + "."
    rows = [(i, prose(rng.randint(120, 250)), "en") for i in range(300)]
    rows += [(500, prose(4000, rng.sample(words, 30)), "en"), (501, prose(5000), "en"), (502, prose(60), "en"),
             (503, " ".join(chr(rng.randint(0x10330, 0x10340)) * 5 for _ in range(200)), "zz"), (504, prose(180), "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality_rules(docs, public_tokenizers.path(PIECES)).collect()}
    assert not any(got[i].base_failed for i in (500, 501, 502, 503, 504))
    assert [i for i in (500, 501, 502, 503, 504) if got[i].kept] == [501, 502, 504]
    assert sum(got[i].kept for i in range(300)) >= 294


def test_length_classes_borrow_from_their_neighbours():
    assert quality.neighbourhoods({7: 100, 8: 59, 9: 1, 12: 2}) == [
        (7, 7), (8, 7), (8, 8), (8, 9), (9, 8), (9, 9), (12, 8), (12, 9), (12, 12)]
    assert quality.neighbourhoods({3: 5, 9: 5}) == [(3, 3), (3, 9), (9, 3), (9, 9)]


@pytest.mark.parametrize("long", [1e4, 3e38])
def test_long_vectors_leave_the_others_their_neighbours(spark, long):
    rng = np.random.default_rng(24)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    x[:3] = 0
    x[[0, 1, 2], [0, 1, 2]] = np.float32(long)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = list(range(2, 3000, 30))
    found = hnsw.nearest(vectors, vectors.where("(vec_id - 2) % 30 = 0"), k=16, shard_nodes=1 << 17).collect()
    got = {i: {r.vec_id for r in found if r.query_id == i} for i in asked}
    y, hits = x.astype(np.float64), 0
    for i in asked:
        score = y @ y[i]
        score[i] = -np.inf
        hits += len(got[i] & set(np.lexsort((np.arange(3000), -score))[:16].tolist()))
    assert hits >= 0.95 * 16 * len(asked)
