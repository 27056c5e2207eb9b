"""Rules that hold on a cluster: no work while building, no local folders, no caps."""

import json

import pytest
from pyspark.sql import functions as F

from docfields import session
from docfields.operators import documents as dc, model_stage as ms, profile as pf, results as rs, rules
from docfields.plans import views
from docfields.plans.responder import RegexResponder
from docfields.sources import readers, sinks
from tests.conftest import SF_SMALL


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("build"))


def test_building_starts_no_job(spark):
    texts = dc.assemble_text(views.conversation_pages(spark, SF_SMALL))
    spark.sparkContext.setJobGroup("build", "build")
    try:
        rules.extract_rules(texts, ["email"])
        rules.extract_fields(texts, ["email"], "doc_id")
        ms.extract_with_model(texts, RegexResponder, "email")
        session.spread(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
        assert jobs(spark) <= 1  # the schema of the scan
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("master, fine", [("local", True), ("local[*]", True), ("local[4,2]", True), ("yarn", False),
                                          ("local-cluster[2,1,1024]", False), ("spark://host:7077", False)])
def test_no_local_folder_on_a_cluster(master, fine):
    if fine:
        session.require_local(master)
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.require_local(master)


LONG = "A heading & label of well over sixty characters, with (some) marks, no. 7"


def test_long_headings_and_labels(spark):
    d = spark.createDataFrame([(1, f"intro\n{LONG}:\nbody\n{LONG}: value")], "doc_id long, text string")
    assert [r.heading for r in rules.extract_sections(d).collect()] == [None, LONG]
    assert [(r.name, r.value) for r in rules.extract_form_fields(d).collect()] == [(LONG, "value")]


@pytest.mark.parametrize("text, ip, card", [
    ("999.999.999.999", None, None), ("at 10.0.0.255.", "10.0.0.255", None), ("1.2.3.4.5", None, None),
    ("12345678901234567890", None, None), ("x1234567890123456y", None, "1234567890123456"), ("256.1.1.1 8.8.8.8", "8.8.8.8", None)])
def test_bounded_rules(spark, text, ip, card):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.field: r.value for r in rules.extract_rules(d, ["ip", "card"]).collect()}
    assert got == {"ip": ip, "card": card}


def test_fields_by_rule_label_and_section(spark):
    text = "Customer Name: Ann\nTotal amount:  $5 \nTOTAL AMOUNT: $6\nNotes:\nfirst\nsecond\nEnd:\nx\nmail a@b.org"
    d = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.field): (r.value, r.matches, r.found_by)
           for r in rules.extract_fields(d, ["customer_name", "total amount", "notes", "email", "none"]).collect()}
    assert got[1, "customer_name"] == ("Ann", ["Ann"], "label")
    assert got[1, "total amount"] == ("$5", ["$5", "$6"], "label")
    assert got[1, "notes"] == ("first\nsecond", ["first\nsecond"], "section")
    assert got[1, "email"] == ("a@b.org", ["a@b.org"], "rule") and got[1, "none"] == (None, [], None)
    assert all(got[2, f][0] is None for f in ("notes", "email"))


def test_unreadable_files_are_rows(spark):
    files = spark.createDataFrame([("a", b"one\ftwo"), ("b", b"bad \xff"), ("c", b"")], "path string, content binary")
    got = {(r.path, r.page_no): (r.text, r.error) for r in readers.read_pages(files).collect()}
    assert got == {("a", 1): ("one", None), ("a", 2): ("two", None), ("b", None): (None, readers.NOT_UTF8_MESSAGE),
                   ("c", 1): ("", None)}

    def reader(content):
        raise OSError("cannot open")

    texts = dc.assemble_text(readers.read_pages(files, reader), "path")
    out = ms.extract_with_model(texts, RegexResponder, "email", key_col="path").collect()
    assert {(r.path, r.error, r.attempts) for r in out} == {(p, "cannot open", 0) for p in "abc"}


def test_names_that_clash(spark):
    class Echo:
        def __call__(self, text, instructions):
            return json.dumps({"error": "mine", "Email": "a", "email": "b", "match_confidence": "c"})
    d = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    out = ms.batch_extract(d, Echo, "error, Email, email, match_confidence, Email", persist_stage=False, wait_s=0)
    row = out.first().asDict()
    assert row["error"] is None and row["Email"] == "a" and row["email_2"] == "b" and row["match_confidence"] == "c"


def test_results_keep_fields_that_look_like_scores(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", 0.5, "m")], "source_file long, name string, name_confidence double, match_confidence string")
    sinks.sink_results(d, str(tmp_path / "r"), include_confidence=False)
    assert spark.read.parquet(str(tmp_path / "r")).columns == ["source_file", "name", "match_confidence"]


def test_no_response_is_its_own_error(spark):
    d = spark.createDataFrame([(1, None), (2, "{}")], "source_file long, response string")
    got = {r.source_file: (r.ok, r.error) for r in rs.parse_response(d).collect()}
    assert got == {1: (False, rs.NO_RESPONSE_MESSAGE), 2: (True, None)}


def test_long_integers_keep_their_digits(spark):
    n = "9" * 5000
    d = spark.createDataFrame([(1, f'{{"n": {n}, "m": -{n[:38]}}}')], "source_file long, response string")
    got = {r.field: r.value for r in rs.explode_result(rs.parse_response(d)).collect()}
    assert got == {"n": n, "m": "-" + n[:38]}


def test_concurrent_calls(spark):
    class Slow:
        def __call__(self, text, instructions):
            import time
            time.sleep(0.2)
            return json.dumps({"a": text})
    import time
    d = spark.range(20, numPartitions=1).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    t = time.time()
    out = ms.extract_with_model(d, Slow, "a", concurrency=10, block_rows=20, wait_s=0).orderBy("doc_id").collect()
    assert time.time() - t < 3.5 and [json.loads(r.raw_response)["a"] for r in out] == [str(i) for i in range(20)]


def test_nan_is_missing(spark):
    d = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0), (3.0, None), (2.0, 4.0)], "a double, b double")
    row = {r.column_name: r for r in pf.describe_all(d, ["a", "b"], []).collect()}
    assert row["a"]["count"] == 3 and row["a"].mean == 2.0 and row["a"].max == 3.0 and row["b"]["count"] == 3
    assert pf.max_value(d, "a").first()[0] == 3.0 and pf.corr_matrix(d, ["a", "b"]).where("x <> y").first().r == 1.0


def test_chunks_keep_the_budget(spark):
    import random
    rng = random.Random(3)
    rows = [(d, p, "x" * rng.choice([5, 90, 300, 480, 870, 970, 1500])) for d in range(6) for p in range(1, 60)]
    rows += [(7, 1, "y" * 870), (7, 2, "y" * 970), (7, 3, "y" * 80), (None, 1, "no document"), (8, None, "no number")]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string")
    chunks = dc.prompt_chunks(pages, 1000, block_pages=7)
    assert chunks.count() == len(rows)
    size = dc.page_piece(F.col("page_no"), F.col("text"))
    got = chunks.groupBy("doc_id", "chunk_id").agg(F.sum(F.length(size)).alias("n"), F.count("*").alias("pages"))
    assert got.where("n > 1000 and pages > 1").count() == 0
    whole = {r.doc_id: r.text for r in dc.assemble_text(pages.where("doc_id < 8")).collect()}
    parts = dc.assemble_chunks(pages.where("doc_id < 8"), 1000).orderBy("doc_id", "chunk_id").collect()
    for d, t in whole.items():
        assert "".join(r.text for r in parts if r.doc_id == d) == t
