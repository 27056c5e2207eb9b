"""Ranked search, language-model scores and the Merkle manifest, against brute force and SQL."""

import collections
import hashlib
import heapq
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docfields.llm import common, context_mix as cm, html_cut, lexical, licenses, merkle, token_count, token_store, unigram
from docfields.llm.queries import PIECES, WORD_BPE, oracle_sql, queries

SMALL = "/root/testdata/sf0.001"
BPE = public_tokenizers.path(WORD_BPE)


def table(con, name):
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        table(con, t)
    got = queries()[name](spark, SMALL)
    want = con.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(str, d))
    assert rows(tuple(r) for r in got.select(*want.columns).collect()) == rows(want.fetchall())


# ------------------------------------------------------------------ manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEAVES = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests, fanout):
    """The root, and of each digest the siblings before and after it on every level."""
    paths, own, now = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(now) > 1:
        up, above = [], []
        for a in range(0, len(now), fanout):
            run = now[a:a + fanout]
            for k in range(len(run)):
                for i in own[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h(*run))
            above.append(sum(own[a:a + fanout], []))
        now, own = up, above
    return now[0], paths


def plain_manifest(rows, fanout):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]], fanout)
    root, tops = climb([trees[g][0] for g in order], fanout) if order else (None, [])
    out = []
    for g, top in zip(order, tops):
        for r, path in zip(groups[g], trees[g][1]):
            steps, changed = path + top, list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                changed[3] += 1
            now = leaf(changed)
            for left, right in steps:
                now = h(left, now, right)
            out.append((r[0], leaf(r), trees[g][0], root, h(*(a + b for a, b in steps)), now, now == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("n, fanout", [(0, 2), (1, 2), (2, 2), (300, 2), (300, 3), (90, 20)])
def test_manifest_by_brute_force(spark, n, fanout):
    rng = random.Random(n + fanout)
    langs = [None, "", "en", "é", "zz"][:1 + n // 10]
    rows = [(rng.choice([None, i, i, i // 2]), rng.choice(["a", None]), rng.choice(langs), rng.choice([None, 5, 2 ** 63 - 1]),
             rng.choice([None, "", "té " * i])) for i in range(n)]
    rows += rows[:n // 10]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], LEAVES + ", tree int, pos string, _row int")
    got = merkle.manifest(docs, FIELDS, "lang", "doc_id", fanout, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1},
                          F.crc32(F.col("doc_id").cast("string")) % 7 == 0).drop("path")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == plain_manifest(rows, fanout)


def test_untampered_rows_verify(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert merkle.manifest(docs, FIELDS, "lang", "doc_id").where("not verified").count() == 0


# ------------------------------------------------------------------ search

def plain_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(i, collections.Counter(term.findall((t or "").translate(low)))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(term.findall((t or "").translate(low)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc, c in found:
            m = 10 + (90 * c.total() * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in terms if t in c)
            if score:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("links", [1 << 14, 12])
def test_search_by_brute_force(spark, monkeypatch, links):
    monkeypatch.setattr(lexical, "BLOCK_LINKS", links)  # the small one makes many blocks
    rng = random.Random(links)
    words = ["a", "B", "été", "漢字", "x1", "don't", "İ", "the", "of", "q"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    docs = [(i, text(40)) for i in range(150)] + [(7, "the of a"), (7, "the of a"), (None, "the q w3"), (200, None), (201, ""), (202, "w3 " * 5000)]
    items = [(i, text(12)) for i in range(25)] + [(3, "q w1 w2"), (None, "the W3"), (None, "of"), (90, None), (91, "nowhere")]
    d = spark.createDataFrame([(*r, 1, "y") for r in docs], "doc_id long, text string, score int, terms string").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, block int")
    got = lexical.ranked_search(d, i, k=4).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == plain_search(docs, items, 4)
    assert lexical.ranked_search(d.limit(0), i).collect() == [] and lexical.ranked_search(d, i.limit(0)).collect() == []


def test_shared_sums_make_the_items():
    rng = random.Random(5)
    items = [sorted(rng.sample(range(60), rng.randint(1, 25))) for _ in range(40)] + [[], [0], [0]]
    graph = lexical.Graph(items, 60)
    value = [rng.randint(1, 10 ** 6) for _ in range(60)]
    made = [0] * graph.nodes
    for t, atom in enumerate(graph.atom_of):
        made[atom] += value[t]
    for node, (a, b) in enumerate(graph.sums, graph.atoms):
        made[node] = made[a] + made[b]
    assert [sum(made[n] for n in part) for part in graph.parts] == [sum(value[t] for t in item) for item in items]
    additions = len(graph.sums) + sum(max(0, len(p) - 1) for p in graph.parts)
    assert additions < 0.8 * sum(max(0, len(i) - 1) for i in items)  # sharing saves work


# ------------------------------------------------------------------ scores

def plain_scores(train, texts):
    """The whole model in plain loops, for training texts of which none learns weights."""
    streams = [cm.stream(t)[1] for t in train]
    kind = lambda b: (b * 0x9E3779B1 >> 7) % 16
    follow = collections.Counter((kind(a), b, c) for s in streams for a, b, c in zip(b"\n\n" + s, b"\n" + s, s))
    codes = {}
    for before in {(kind(a), b) for t in [*train, *texts] for s in [cm.stream(t)[1]] for a, b in zip(b"\n\n" + s, b"\n" + s)}:
        heap = [(follow[*before, b] + 1, b) for b in range(256)]
        heapq.heapify(heap)
        child = {}
        for node in range(256, 511):
            (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
            child[node] = (a, b)
            heapq.heappush(heap, (n + m, node))
        todo = [(510, [])]
        while todo:
            node, way = todo.pop()
            if node < 256:
                codes[before, node] = way
            else:
                todo += [(c, [*way, (510 - node, bit)]) for bit, c in enumerate(child[node])]

    def places(data, i):
        """Of each bit of byte i: node, bit, depth, and its slot in every table."""
        back = b"\n" * 8 + data[:i]
        hashes, x = {}, 0
        for n in range(1, 8):
            x = (x + back[-n] + 1) * 0x85EBCA6B % 2 ** 32
            hashes[n] = (x + n) % 2 ** 32
        for depth, (node, bit) in enumerate(codes[(kind(back[-2]), back[-1]), data[i]]):
            slots = []
            for order, bits in cm.CONTEXTS:
                c = hashes[order]
                at = ((c ^ c >> 15) * 0x2C1B3C6D % 2 ** 32) >> 32 - bits
                slots.append((order, at & ~63 | (at + node) & 63))
            yield bit, min(depth, cm.DEPTHS - 1), slots

    counts = collections.defaultdict(lambda: [0, 0])
    for s in streams:
        for i in range(len(s)):
            for bit, _, slots in places(s, i):
                for slot in slots:
                    counts[slot][bit] += 1

    def odds(slot):
        if slot not in counts:
            return None
        zeros, ones = counts[slot]
        return min(127, max(-127, round(16 * math.log((ones + cm.PRIOR) / (zeros + cm.PRIOR))))) / 16

    centers = [1 / (1 + math.exp(-x)) for x in np.linspace(-8, 8, cm.BUCKETS)]
    edges = [0, *np.cumsum(cm.BLOCKS).tolist()]
    out = []
    for text in texts:
        data, total = cm.stream(text)[1], 0.0
        while edges[-1] < len(data):
            edges.append(edges[-1] + cm.BLOCKS[-1])
        weights = collections.defaultdict(lambda: [0.3] * len(cm.CONTEXTS) + [0.0])
        for a, b in zip(edges, edges[1:]):
            moves = collections.defaultdict(lambda: [0.0] * (len(cm.CONTEXTS) + 1))
            for i in range(a, min(b, len(data))):
                for bit, depth, slots in places(data, i):
                    x = [odds(s) for s in slots]
                    gate = (max((k + 1 for k, v in enumerate(x) if v is not None), default=0), depth)
                    x = [v or 0.0 for v in x] + [1.0]
                    mixed = sum(w * v for w, v in zip(weights[gate], x))
                    plain = 1 / (1 + math.exp(-mixed))
                    near = round((min(8, max(-8, mixed)) + 8) * (cm.BUCKETS - 1) / 16)
                    p = min(1 - 1 / 65536, max(1 / 65536, (centers[near] + plain) / 2))
                    total += math.log10(p if bit else 1 - p)
                    for k, v in enumerate(x):
                        moves[gate][k] += (bit - plain) * v
            rate = cm.OWN_RATE * min(1, cm.STEADY / (b - a))
            for gate, move in moves.items():
                weights[gate] = [w + rate * m for w, m in zip(weights[gate], move)]
        out.append(total)
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "és", "X", "un"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_scores_by_brute_force(spark):
    rng = random.Random(8)
    ids = [i for i in range(80) if zlib.crc32(str(i).encode()) % 7 != 3]  # none that learns weights
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in ids] + [(None, "Ka lo"), (ids[0], None), (ids[1], " \n"), (ids[2], prose(rng, 900))]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    train = [t for (_, t), out in zip(rows, held) if not out]
    tokens = collections.Counter(w for t in train for w in [*cm.stream(t)[0], b""])
    n, v = tokens.total(), len(tokens)
    want = []
    for (i, t), out, score in zip(rows, held, plain_scores(train, [t for _, t in rows])):
        words = [*cm.stream(t)[0], b""]
        want.append((i, out, len(words), sum(tokens[w] > 0 for w in words), n, sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in words), score))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, held_out string").repartition(3)
    got = [tuple(r) for r in cm.score_documents(docs).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]
    by = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=2e-4)


def test_rare_words_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common w{i % 5} " + "long" * 9 * (i % 3)) for i in range(40)], "doc_id long, text string")
    whole = {r.doc_id: r for r in cm.score_documents(docs).collect()}
    monkeypatch.setattr(cm, "HOT_WORDS", 1)
    for r in cm.score_documents(docs).collect():
        assert r.n_known == whole[r.doc_id].n_known and r.base_score == pytest.approx(whole[r.doc_id].base_score, rel=1e-12)
        assert r.score == pytest.approx(whole[r.doc_id].score, rel=1e-12)


def test_scores_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert cm.score_documents(none).collect() == []
    alone = cm.score_documents(spark.createDataFrame([(2, "a b"), (None, None)], "doc_id long, text string"), held_out=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.held_out and r.score < 0 for r in alone)


def test_long_texts_score_as_one(monkeypatch):
    rng = random.Random(4)
    code = cm.Code(np.zeros(cm.TRIPLES, np.int64))
    r = np.random.default_rng(1)
    model = cm.Model(code, r.integers(-128, 128, sum(1 << b for _, b in cm.CONTEXTS)).astype(np.int8), cm.start_weights(),
                     np.tile(cm.bucket_centers(), (cm.GATES, 1)).ravel().astype(np.float32))
    streams = [cm.stream(prose(rng, n))[1] for n in (5, 4000, 0, 30, 30_000)]
    whole = cm.Scorer(model).scores(streams)
    alone = [cm.Scorer(model).scores([s])[0] for s in streams]
    assert whole == pytest.approx(alone, rel=1e-6)
    # pieces end where blocks of a document end, so they change nothing
    monkeypatch.setattr(cm, "SCORED", 1 << 20)
    assert cm.Scorer(model).scores(streams) == pytest.approx(whole, rel=1e-6)


def test_probabilities_of_all_next_bytes_add_up():
    counts = np.random.default_rng(2).integers(0, 50, (cm.TRIPLES >> 8, 256))
    counts[50:] = 0
    sizes = cm.Code(counts.ravel()).sizes.reshape(-1, 256)
    assert (np.abs((0.5 ** sizes).sum(axis=1) - 1) < 1e-12).all()


def test_the_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = cm.score_documents(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_bytes"), F.avg("bits_per_byte")).first()
    assert got[0] > 1.03 * got[1] and -got[0] * math.log2(10) / got[2] < 2.4


# ------------------------------------------------------------------ faults once found

STORY = "<article><h1>News</h1><p>A long sentence of the story.</p>"
END = "<p>More of the story here.</p></article>"


@pytest.mark.parametrize("skipped", [
    "<button><div>BUY NOW</div></button>", "<template><div>x</div></template>", "<object><p>none</p></object>", "<video><div>none</div></video>",
    "<select><option>a<option>b</select>"])
def test_closed_skipped_elements_after_a_block(skipped):
    assert html_cut.main_text(f"<body>{STORY}{skipped}{END}") == "News\nA long sentence of the story.\nMore of the story here."


def test_a_head_after_a_block():
    page = f"<p>x</p><head><template><div>a</div></template></head><body>{STORY}{END}"
    assert html_cut.main_text(page) == "News\nA long sentence of the story.\nMore of the story here."


@pytest.mark.parametrize("page", ["<div>" * 10_000 + STORY + END, "<b " * 350_000, '<b "' * 260_000, "<!" * 500_000, '<a x=">' * 130_001 + "x",
                                  "<div>" * 20_000 + "</span></p>" * 20_000, "<button>" * 100_000, "<ul><li>" * 20_000 + "x"])
def test_hard_pages_take_linear_time(page):
    t = time.thread_time()
    html_cut.main_text(page)
    assert time.thread_time() - t < 15


def test_licence_lines_of_a_megabyte():
    tag, t = "SPDX-License-Identifier: ", time.thread_time()
    assert licenses.scan((tag + "MIT ") * 35_000)[5] == "mit"
    assert licenses.scan(tag + "MIT OR " * 100_000 + "prose " * 20_000)[5] == "mit,other"
    assert licenses.scan(tag + "(" * 400_000)[5] == ""
    assert time.thread_time() - t < 30
    assert licenses.parse_expression("MIT OR (GPL-2.0+ AND x) and prose here") == (["MIT", "GPL-2.0+", "x", "AND", "prose", "AND", "OR"],
                                                                                 "MIT OR (GPL-2.0+ AND x) and prose")


def test_newer_letters_and_accents_equal_the_library():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(BPE)
    rng = random.Random(6)
    pool = list("abZ19é-É!'ßÿà÷ÜœñΣς漢 \t\n") + ["'s", "<|endoftext|>", "é", "Ɤ", "Ƛ", "\U00013808", "\U0001385c", "\U00013988", "\x00"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert token_count.Counter(BPE).counts(texts).tolist() == list(map(len, want))
    ids, sizes = token_store.Encoder(BPE).ids(texts)
    assert np.split(ids, np.cumsum(sizes)[:-1])[5].tolist() == want[5] and ids.tolist() == [i for w in want for i in w]


def test_caches_are_bounded_by_bytes():
    cache = common.PieceCache(lambda s: [[len(x)] for x in s], limit=50_000)
    for k in range(40):
        words = [f"{k}-{i}" * 3 for i in range(100)]
        ids, sizes = cache.ids(words, np.array([len(words)]))
        assert ids.tolist() == list(map(len, words)) and cache.bytes < 50_000 + 100 * 300


def test_odd_ids_and_end_ids(spark):
    model = public_tokenizers.path(PIECES)
    coded = spark.createDataFrame([(1, [5, 10 ** 6]), (2, [-1]), (3, None), (4, []), (5, [300, 301]), (6, [5, None])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in unigram.decode_documents(coded, model).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 6)] == [None, None, "", "", None] and got[5]
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        token_store.token_store(docs, BPE, -1)
    assert token_store.token_store(docs, BPE, 1 << 20).first().n_tokens == 3


def test_near_dedup_takes_columns_of_any_name_and_kind(spark):
    rng = random.Random(9)
    text = prose(rng, 80)
    rows = [(1, text, "a", {"x": 1}, 5), (1, text, "b", {"x": 2}, 6), (2, text, "c", None, 7), (2, prose(rng, 80), "d", {}, 8), (None, text, "e", {}, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, row map<string,int>, number int") \
                .withColumnsRenamed({"number": "_number"}).selectExpr("*", "1 AS id", "2 AS `_key`", "3 AS `a.b`")
    import corpus_pipeline
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.key for r in got.collect()) == ["a", "d", "e"]
