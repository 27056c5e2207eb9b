"""Operators that judge each text by itself, against libraries and brute force."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docfields.llm import html_cut, licenses, quality, token_count, token_store, unigram
from docfields.llm.queries import PIECES, WORD_BPE

BPE, MODEL = public_tokenizers.path(WORD_BPE), public_tokenizers.path(PIECES)
LETTERS = "abcde thinger ABCΣİ'’.,!?-_0123 456\n\t ́ẞ漢字кириллица😀ǅ½²|$%"


def random_texts(n, seed, letters=LETTERS):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BPE)


def ids_of(library, texts):
    return [e.ids for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


SPECIAL = ["a<|endoftext|>B", "<|startoftext|>", "A<|ENDOFTEXT|>b <|endoftext|> Cd", "don't WE'LL o're '' 's", "ha" * 3000,
           "", "  \n", "x" * 700 + "'s" + "=-" * 600, "É'S é<|endoftext|>́", None]


def test_token_counts_equal_the_library(library):
    texts = random_texts(3000, 1) + SPECIAL
    words = list(library.get_vocab())[:20000]
    texts += [w.replace("</w>", "") for w in words]
    got = token_count.counter(BPE).counts(texts)
    assert got.tolist() == [len(i) for i in ids_of(library, texts)]


def test_counts_do_not_depend_on_chunks():
    cls = token_count.classes_of(np.array([ord(c) for t in random_texts(50, 2) for c in t] or [32], np.uint32))
    want = token_count.word_marks(cls, 100_000)
    for chunk in (1, 2, 7, 512):
        assert (token_count.word_marks(cls, chunk) == want).all()


def test_prefix_scan_composes_in_order():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 5, (37, 5)).astype(np.uint8)
    now, got = np.arange(5), token_count.prefix_maps(maps)
    for i, m in enumerate(maps):
        now = m[now]
        assert (got[i] == now).all()


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, np.uint32)
    assert (token_store.unpack(token_store.pack(ids, bits), bits, 1000) == ids).all()


def test_shard_random_access(tmp_path):
    import pyarrow as pa
    rng = np.random.default_rng(4)
    docs = [(None if i == 0 else i, rng.integers(0, 50000, int(n)).astype(np.int32))
            for i, n in enumerate([3, 0, 500, 20000, 1, 40000])]
    with open(tmp_path / "s", "wb") as f:
        w = token_store.ShardWriter(f, 16, 128)
        for key, ids in docs:
            w.add(key, ids)
        w.close()
    reader = token_store.ShardReader(pa.OSFile(str(tmp_path / "s")))
    every = np.concatenate([i for _, i in docs])
    for a, b in [(0, 3), (127, 129), (5000, 5001), (0, len(every)), (len(every) - 1, len(every)), (9, 9)]:
        assert (reader.ids(a, b) == every[a:b]).all()
    back = list(reader.documents(1000))
    assert [(k, ids.tolist()) for k, _, ids in back] == [(k, ids.tolist()) for k, ids in docs]


def test_token_store_files(spark, library, tmp_path):
    texts = random_texts(200, 5) + SPECIAL
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = token_store.token_store(docs, BPE, end_id=2, folder=str(tmp_path / "shards")).collect()
    want, start = [], 0
    for key, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(ids_of(library, [t])[0] + [2], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_store.token_store(docs.limit(0), BPE, folder=str(tmp_path / "none")).count() == 0


def test_viterbi_equals_brute_force_and_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto
    model = proto.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # the same pieces and scores, read as a unigram model
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    u = unigram.unigram(MODEL)
    texts = random_texts(1500, 6) + ["", " ", "  a", "\n\n", "a▁b", "zz" * 30]
    ids, sizes = u.ids(texts)
    at = 0
    for t, n in zip(texts, sizes):
        one = ids[at:at + n].tolist()
        at += n
        assert one == library.encode(t), t
        assert u.decode(one) == t.replace("▁", " ")
    pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
    for t in random_texts(60, 7, "thing er the") + ["abc"]:
        best = [0.0] + [-math.inf] * len(t)
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                score = pieces.get(t[i:j].replace(" ", "▁"))
                if score is not None:
                    best[j] = max(best[j], best[i] + score)
        marked = t.replace(" ", "▁")
        assert sum(u.scores[i] for i in u.best(marked)) == best[-1]


def test_decoding_bytes_that_are_no_text():
    u = unigram.unigram(MODEL)
    assert u.decode([u.bytes[0xFF], u.bytes[0x41]]) == "�A" and u.decode([]) == ""


def test_decode_documents(spark):
    docs = spark.createDataFrame([(1, "a b  c\n"), (2, None), (3, "")], "doc_id int, text string")
    back = unigram.decode_documents(unigram.encode_documents(docs, MODEL), MODEL)
    assert {r.doc_id: r.text for r in back.collect()} == {1: "a b  c\n", 2: "", 3: ""}


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for k in range(n - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(k, k + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_base_counts(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "d\t", "#x ", "é", " ", "\r", " "]) for _ in range(rng.randint(0, 150)))
             for _ in range(300)] + ["", "a\na\n\n \na", "x " * 49, "x " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.quality_rules(docs, MODEL).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        want = base_counts(texts[r.doc_id])
        assert got == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_rejects_junk_and_keeps_the_rest(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice(["the", "ing", "er", "on", "th", "ly", "at", "es"]) for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    rows = []
    for i in range(400):
        pick = [rng.choice(words) for _ in range(rng.randint(120, 250))]
        rows.append((i, " ".join(w + "###" for w in pick) if i % 10 == 0 else " ".join(pick) + ".", "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.quality_rules(docs, MODEL).where("kept").collect()}
    assert not kept & set(range(0, 400, 10)) and len(kept) >= 358
    good = quality.keep_good(docs.withColumn("n_words", F.lit("x")), MODEL)
    assert good.columns == ["doc_id", "text", "lang", "n_words"] and {r.doc_id for r in good.collect()} == kept


def test_quality_rules_on_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    got = quality.quality_rules(spark.read.parquet(f"{d}/documents.parquet"), MODEL).join(labels, "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    junk = [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in junk) >= 0.9 * len(junk)


def test_licences_by_brute_force():
    rng = random.Random(10)
    parts = ["mit", "license", "apache", "general", "public", "MIT License", "é", "x", ".", "-", "\n", "lesser", "cc by"]
    for _ in range(800):
        text = "".join(rng.choice(parts) + rng.choice([" ", "", "-"]) for _ in range(rng.randint(0, 25)))
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        starts, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for k in range(len(words)):
                if words[k:k + len(p)] == p:
                    starts.append(k)
                    labels.add(label)
        got = licenses.scan(text)
        assert got[:5] == (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(filter(None, got[5].split(","))) and 0 <= got[6] <= 1


@pytest.mark.parametrize("text, postfix, written", [
    ("MIT", ["MIT"], "MIT"),
    ("MIT OR Apache-2.0 AND ISC */", ["MIT", "Apache-2.0", "ISC", "AND", "OR"], "MIT OR Apache-2.0 AND ISC"),
    ("(MIT or ISC) and GPL-2.0 with Classpath-exception-2.0", ["MIT", "ISC", "OR", "GPL-2.0", "Classpath-exception-2.0", "WITH", "AND"],
     "(MIT or ISC) and GPL-2.0 with Classpath-exception-2.0"),
    ("MIT and then some", ["MIT", "then", "AND"], "MIT and then"),
    ("MIT OR", ["MIT"], "MIT"),
])
def test_shunting_yard(text, postfix, written):
    out, part = licenses.parse_expression(text)
    assert [t.upper() if t.upper() in licenses.PRIORITY else t for t in out] == postfix and part == written


def test_licence_values():
    assert licenses.parse_expression(") MIT") is None and licenses.parse_expression("") is None
    labels, free = licenses.evaluate(licenses.parse_expression("(MIT OR GPL-3.0-only) AND MPL-2.0")[0])
    assert labels == {"mit", "gpl", "mpl"} and free == licenses.FREEDOM["mpl"]
    assert licenses.scan("# SPDX-License-Identifier: Apache-2.0")[5] == "apache"


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><a href=/>Home</a></header>
<nav><ul><li><a href=/a>Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies. Accept all of them, please.</div>
<div id=wrap class="page with-sidebar"><article><h1>Real &amp; true</h1><script>var t="</p>";</script>
<p><b>First   line<br><p>Second&nbsp;line, with <a href=x>a link</a>.</p><ul><li>Point<li>Other</ul><!-- gone --><aside>See also</aside>
<div class="share-buttons">Share this</div><form><label>Mail</label><input><button>Go</button></form><p>Last.</p></article>
<div class="sidebar"><p>Popular things that many people read every day.</p></div></div>
<section id="comments"><article><p>I think this is a very good article and I agree with it.</p></article></section>
<footer>&copy; 2024 Site</footer></body>"""


def test_main_text_of_a_page():
    assert html_cut.main_text(PAGE) == "Real & true\nFirst line\nSecond line, with a link.\nPoint\nOther\nLast."
    for cut in range(0, len(PAGE), 7):
        html_cut.main_text(PAGE[:cut])


@pytest.mark.parametrize("page, text", [
    ("", ""), (None, ""), ("plain words of a page.", "plain words of a page."), ("<p>a &lt; b and so on.", "a < b and so on."),
    ("<nav>only menus</nav>", ""), ("<article><p>x</p><span", "x"), ("<article>" + "<p>w w. " * 5000, "\n".join(["w w."] * 5000)),
    ("<body><form><h1>Some title of news</h1><p>Body text that goes on and on for a while.</p></form>",
     "Some title of news\nBody text that goes on and on for a while."),
])
def test_main_text_edges(page, text):
    assert html_cut.main_text(page) == text


def test_min_cut_by_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        n = rng.randint(1, 8)
        content, boiler = ([rng.randint(0, 9) / 2 for _ in range(n)] for _ in range(2))
        edges = [(i, j, rng.randint(0, 6) / 2) for i in range(n) for j in range(i) if rng.random() < 0.4]

        def cost(kept):
            return (sum(content[i] if kept[i] else boiler[i] for i in range(n))
                    + sum(w for a, b, w in edges if kept[a] != kept[b]))

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_cut.min_cut(content, boiler, edges)) - best) < 1e-6


def test_main_text_of_the_table(spark):
    """The pages' own article element, read by regular expression."""
    import html as h
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_cut.extract_main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_unknown_characters_are_found_at_little_cost():
    """Texts of known characters beyond ASCII are not searched range by range."""
    known = "naïve Straße 東京 привет " * 20_000
    token_count.has_unknown("é\U0001F600")
    begun = time.process_time()
    found = [token_count.unknown_characters().search(known)]
    slow = time.process_time() - begun
    begun = time.process_time()
    found.append(token_count.has_unknown(known) or None)
    assert found == [None, None] and time.process_time() - begun < slow / 4
    for text in ("plain", "é", "a\U0001F600b", "x͸", "é\U0001F600\U000E0FFF", "\U000E0FFF", "", "\U0010FFFD", "\U0001F600͸"):
        assert token_count.has_unknown(text) == bool(token_count.unknown_characters().search(text)), ascii(text)
