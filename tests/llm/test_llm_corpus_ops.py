"""Operators over the whole corpus, against brute force; defined edge cases."""

import collections
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from docfields.llm import hnsw, html_cut, licenses, minhash, mixing, quality, substring, token_count, token_store, unigram
from docfields.llm.components import connected_components
from docfields.llm.queries import OP3_SQL, PIECES, WORD_BPE, oracle_sql, queries

BPE, MODEL = public_tokenizers.path(WORD_BPE), public_tokenizers.path(PIECES)
SMALL = "/root/testdata/sf0.001"


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(400, 401 + i) for i in range(100)]
    edges += [(600 + i, 601 + i) for i in range(40)] + [(5, 5), (7, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_copies(seed, groups=6, size=12, words=60):
    """Groups of copies with a few words changed, chained so that ends drift apart."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    docs = []
    for _ in range(groups):
        text = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(words)] = rng.choice(vocabulary)
            docs.append(" ".join(text))
    return docs + docs[:5] + ["", None, " ", "one", "One", "one two", "ONE\ttwo\n"]


@pytest.mark.parametrize("k, percent", [(2, 80), (5, 80), (1, 80)])
def test_near_duplicates_by_brute_force(spark, k, percent):
    texts = near_copies(k)
    random.Random(2).shuffle(texts)
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, k, percent).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def test_near_duplicates_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({OP3_SQL})").fetchall())
    got = queries()["op3_minhash_near_dedup"](spark, SMALL).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == want and set(oracle_sql()) <= set(queries())


def test_chunks_resist_insertions():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(3000)).encode()
    moved = b"some words put in front, " + text

    def chunks(t):
        ends = substring.chunk_ends([t])[0]
        return [t[x:y] for x, y in zip([0, *ends], ends)]

    assert b"".join(chunks(text)) == text
    assert all(substring.LEAST <= len(c) <= substring.MOST for c in chunks(text)[:-1])
    assert len(set(chunks(text)) - set(chunks(moved))) <= 3
    together = substring.chunk_ends([b"", text, b"x", moved, "漢字".encode() * 900])
    assert together[1] == substring.chunk_ends([text])[0] and together[3] == substring.chunk_ends([moved])[0]
    assert b"".join("漢字".encode()[0:0] for _ in together[4]) == b"" and together[4][-1] == 5400


def test_substrings_by_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(4)]
    phrase = "a phrase that is found in many documents."
    texts = {}
    for i in range(60):
        own = [" ".join(word() for _ in range(rng.randint(20, 80))) for _ in range(2)]
        texts[i] = "\n".join([own[0], passages[i % 4] if i % 3 == 0 else phrase, own[1]])
    docs = spark.createDataFrame([*texts.items(), (60, None), (None, passages[0])], "doc_id long, text string")
    got = {r.doc_id: r for r in substring.dedup_substrings(docs).collect()}
    first = {}
    for i in sorted(texts):
        t = texts[i].encode()
        ends = substring.chunk_ends([t])[0]
        parts = [t[x:y] for x, y in zip([0, *ends], ends)]
        again = []
        for n, p in enumerate(parts):
            again.append(first.setdefault(p.strip(), (i, n)) != (i, n))
        out, n = b"", 0
        while n < len(parts):
            m = n
            while m < len(parts) and again[m] == again[n]:
                m += 1
            run = b"".join(parts[n:m])
            out += b"" if again[n] and len(run.split()) >= substring.MIN_WORDS else run
            n = m
        assert got[i].text == out.decode() and got[i].n_repeated == sum(again)
    for i in texts:
        later = i % 3 == 0 and i >= 12
        assert (got[i].n_cut > 0) == later and (later or got[i].text == texts[i])
        # a chunk that also holds words before or after the passage may belong to a later copy
        assert not later or got[i].first_docs[0] == i % 12
    assert got[60].text is None and got[None].text == passages[0]


def test_mixing_by_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(700):
        source = rng.choice(["b", "b", "b", "a", "Z", "ö", None, "tiny" if i % 50 == 0 else "c"])
        rows.append((i, source, " ".join(["w"] * rng.choice([0, 1, 5, 30])) if i % 70 else None))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = mixing.plan_mix(docs).collect()
    size = {i: len((t or "").split()) for i, _, t in rows}
    total = collections.Counter()
    for i, s, _ in rows:
        total[s] += size[i]
    order = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full = {s for s in order if not total[s]}
    while True:
        unit = (sum(total.values()) - sum(3 * total[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if weight[s] * unit > 3 * total[s]} | full
        if over == full:
            break
        full = over
    taken = collections.Counter()
    for r in plan:
        assert r.size == size[r.doc_id] and r.source_size == total[r.source] and r.taken == r.copies * r.size <= 3 * r.size
        assert r.target == pytest.approx(min(3 * total[r.source], weight[r.source] * unit))
        taken[r.source] += r.taken
    assert len(plan) == len(rows)
    assert all(abs(taken[s] - min(3 * total[s], weight[s] * unit)) <= 15 for s in order)
    firsts = [r.positions[0] for r in plan if r.positions]
    assert firsts == sorted(firsts)
    assert sorted(map(str, mixing.plan_mix(docs).collect())) == sorted(map(str, plan))


def test_schedules_are_met_over_time():
    import math
    for knots in mixing.SCHEDULES:
        pieces = mixing.integrate(knots)
        for share in np.linspace(0, 1, 21):
            at, weight, slope, before = [p for p in pieces if p[3] <= share][-1]
            more = share - before
            t = at + 2 * more / (weight + math.sqrt(weight * weight + 2 * slope * more))
            met = sum(np.trapezoid([w + s * 0, w + s * (min(t, e) - a)], [a, min(t, e)])
                      for (a, w, s, _), e in zip(pieces, [p[0] for p in pieces[1:]] + [1.0]) if t > a)
            assert met == pytest.approx(share, abs=1e-9)
    with pytest.raises(ValueError):
        mixing.integrate([(0.0, 1.0), (0.5, 1.0)])


def test_mix_repeats_rows_in_order(spark, tmp_path):
    rows = [(i % 40, "ab"[i % 2], "w " * (i % 7 + 1)) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    plan = mixing.plan_mix(docs).collect()
    want = collections.Counter()
    for r in plan:
        want[r.doc_id, r.size] += r.copies
    got = collections.Counter((r.doc_id, len(r.text.split())) for r in mixing.mix(docs).collect())
    assert got == +want


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        i = ids.index(q)
        score = sorted((-float(x[j] @ x[i]), ids[j]) for j in range(len(ids)) if ids[j] != q)
        out[q] = [v for _, v in score[:k]]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))).astype(np.float32)
    x[200:700] = x[200]  # a third of all rows is one vector
    ids = rng.permutation(5000)[:1500].tolist()
    bad = [(9001, None), (9020, [0.0] * 16), (9040, [float("nan")] + [1.0] * 15), (9060, [None] + [1.0] * 15), (None, [1.0] * 16),
           (9080, [1.0, 2.0]), (9100, [2.0, 2.0]), (9101, [])]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] + bad + [(int(ids[0]), x[0].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = collections.defaultdict(list)
    for r in hnsw.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = exact(ids, x.astype(np.float64), [i for i in ids if i % 20 == 0], 10)
    assert set(got) == set(want) | {9080, 9100}
    assert got[9080] == [(1, 9100, 6.0)] and got[9100] == [(1, 9080, 6.0)]
    hits = sum(len(set(v) & {i for _, i, _ in got[q]}) for q, v in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))
    at = {i: n for n, i in enumerate(ids)}
    for q in want:
        assert [r for r, _, _ in got[q]] == list(range(1, 11))
        assert all(s == pytest.approx(float(x[at[i]].astype(np.float64) @ x[at[q]].astype(np.float64)), abs=1e-12) for _, i, s in got[q])
        assert [(-s, i) for _, i, s in got[q]] == sorted((-s, i) for _, i, s in got[q])


def test_recall_on_the_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    got = collections.defaultdict(set)
    for r in queries()["op7_hnsw_search"](spark, SMALL).collect():
        got[r.query_id].add(r.vec_id)
    want = exact(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert sum(len(set(v) & got[q]) for q, v in want.items()) >= 0.95 * sum(map(len, want.values()))


LONG = "longword" * 40_000
ROWS = [(1, "some text here, twice", "en", "a"), (1, "some text here, twice", "en", "a"), (2, None, None, None), (None, "no id", "xx", "b"),
        (3, "", "en", ""), (4, " \n\t", "??", None), (5, LONG, "en", "a"), (6, "漢字 é " * 300, None, "b"), (1, "another text", "en", "a")]
CLASHING = {"id": "x", "key": "y", "row": 1, "place": 2, "size": 3, "owner": 4, "b": 5, "n_tokens": 6, "component": 7,
            "doc id": 8, "marks": 9, "n_chunks": "z", "kept": "k", "_start": 0, "target": 1, "a": 2, "entropy": 3, "set": 4}
TEXT_OPS = {
    "op1": lambda d: token_count.count_tokens(d, BPE), "op2": substring.dedup_substrings, "op3": minhash.near_duplicates,
    "op4": lambda d: unigram.encode_documents(d, MODEL), "op5": lambda d: quality.quality_rules(d, MODEL),
    "op6": mixing.plan_mix, "op8": licenses.scan_licenses, "op10": lambda d: token_store.token_store(d, BPE, 2),
    "op9": lambda d: html_cut.extract_main_text(d, "doc_id", "source", "text"),
}


@pytest.fixture(scope="module")
def odd(spark):
    names = ", ".join(f"`{c}` {'string' if isinstance(v, str) else 'int'}" for c, v in CLASHING.items())
    return spark.createDataFrame([(*r, *CLASHING.values()) for r in ROWS],
                                 f"doc_id long, text string, lang string, source string, {names}")


@pytest.mark.parametrize("name", TEXT_OPS)
def test_odd_rows(odd, name):
    """Nulls, empty and long texts, repeated rows and ids, other columns: a row for each row."""
    got = TEXT_OPS[name](odd).collect()
    key = "page_id" if name == "op9" else "doc_id"
    assert sorted(str(r[key]) for r in got) == sorted(str(r[0]) for r in ROWS)
    by = collections.defaultdict(list)
    for r in got:
        by[r[key]].append(r)
    if name == "op1":
        assert by[2][0].n_tokens == by[3][0].n_tokens == by[4][0].n_tokens == 0 and by[5][0].over_limit
    if name == "op2":
        assert by[2][0].text is None and by[None][0].text == "no id" and by[1][0].key == "y"
    if name == "op3":
        assert by[2][0].component_id == 2 and by[None][0].component_id is None and by[None][0].kept
        assert {r.component_id for r in by[1]} == {1}
    if name == "op4":
        assert all(r.round_trip for r in got) and by[2][0].ids == []
    if name == "op5":
        assert by[2][0].base_failed and not any(r.kept and r.base_failed for r in got)
    if name == "op8":
        assert by[2][0].n_words == 0 and by[2][0].first_word is None and by[2][0].labels == ""
    if name == "op10":
        assert by[2][0].n_tokens == 1


@pytest.mark.parametrize("name", TEXT_OPS)
def test_empty_tables(odd, name):
    assert TEXT_OPS[name](odd.limit(0)).collect() == []


def test_nearest_on_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.nearest(none, none).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    from docfields.llm.common import saved
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SMALL), "test-stage")
        rows = docs.collect()
        now = {r.doc_id for r in rows}
        assert now <= before and now
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "substring_dedup":
            assert now == before and all(r.n_chars == len(r.text) for r in rows)
        before = now
    want = sorted((r.doc_id, r.ids_crc32) for r in rows)
    assert sorted((r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, SMALL).collect()) == want


def test_pipeline_takes_odd_rows(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source").selectExpr("*", "cast(length(text) as long) AS n_chars")
    for source in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            source.write.mode("overwrite").parquet(str(tmp_path / name))
            source = spark.read.parquet(str(tmp_path / name))
            source = stage(spark, source, SMALL)
        source.collect()


def join_rows(df):
    """Rows that each join of a query gave out."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            if "Join" in name:
                found.append(p.metrics().apply("numOutputRows").value())
            todo += [p.children().apply(i) for i in range(p.children().length())]
    return found


def test_rare_pairs_leave_out_members_that_cannot_link(spark):
    """Of a large component only members that may link meet those of others."""
    large = [(1, i, 100, 100 if i == 1 else 20, 1) for i in range(1, 201)]
    others = [(1, i, 100, 100, i) for i in range(1001, 1011)]
    rows = spark.createDataFrame(large + others, "key long, id long, n long, left long, component long")
    pairs = minhash._rare_pairs(rows.drop("component"), rows.select("id", "component"), 80)
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in (1, *range(1001, 1011)) for b in range(1001, 1011) if a < b}
    assert max(join_rows(pairs)) < 250


def test_near_duplicates_name_documents_once(spark, monkeypatch):
    """However many rounds find links, one join names the documents."""
    written = {}
    keep = minhash.saved

    def saved(df, name, rows=None):
        written.setdefault(name, []).append(df)
        return keep(df, name, rows)

    monkeypatch.setattr(minhash, "saved", saved)
    words = [f"w{i}" for i in range(60)]
    chain = [(i, " ".join(words[:i] + [f"x{j}" for j in range(i)] + words[i:])) for i in range(1, 30, 2)]
    chain += [(100 + i, " ".join(words[:40] + [f"y{i}z{j}" for j in range(4)] + words[40:])) for i in range(30)]
    docs = spark.createDataFrame(chain, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, k=2, percent=80).collect()}
    sets = {i: set(minhash.shingles(t, 2).tolist()) for i, t in chain}
    want = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert sum(df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") for df in written["minhash-named"]) == 1


def generated_rows(df):
    """Rows that the explodes of a query gave out, each time that they ran."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            if name == "Generate":
                total += p.metrics().apply("numOutputRows").value()
            todo += [p.children().apply(i) for i in range(p.children().length())]
    return total


def test_near_duplicates_unfold_members_a_bounded_number_of_times(spark, monkeypatch):
    """Rounds that find next to nothing do not unfold a large group again and again."""
    unfolded, buckets, members = [], [], []
    keep = minhash.saved

    def saved(df, name, rows=None):
        out = keep(df, name, rows)
        if name == "minhash-split" and not buckets:
            buckets.append(out.count())
        elif name in ("minhash-now", "minhash-split"):
            unfolded.append(generated_rows(df))
        elif name == "minhash-rare-pairs":
            members.append(out.count())
        return out

    monkeypatch.setattr(minhash, "saved", saved)
    rng = random.Random(41)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):  # alike, but few at the threshold
        words = list(base)
        for j in rng.sample(range(200), rng.choice([5, 6, *[8, 9, 10] * 10])):
            words[j] = f"v{i}x{j}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, k=2, percent=80).collect()}
    sets = {i: set(minhash.shingles(t, 2).tolist()) for i, t in rows}
    want = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while (new := {i: min([want[i], *(want[a + b - i] for a, b in links if i in (a, b))]) for i in want}) != want:
        want = new
    assert got == want and links
    assert members and sum(unfolded) <= 2 * buckets[0]
