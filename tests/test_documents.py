from pyspark.sql import functions as F

from docfields.operators import documents as dc
from docfields.operators import rules
from docfields.plans import views
from tests.conftest import SF_SMALL


def test_assemble_numeric_order_and_empty(spark):
    pages = spark.createDataFrame([(1, 10, "ten"), (1, 2, "two"), (1, 1, "one"), (2, 1, None)],
                                  "doc_id long, page_no int, text string")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    out = {r.doc_id: r.text for r in dc.assemble_text(pages, documents=docs).collect()}
    assert out[1] == "\n--- Page 1 ---\none\n--- Page 2 ---\ntwo\n--- Page 10 ---\nten"
    assert out[2] == "\n--- Page 1 ---\n"
    assert out[3] == ""


def test_chunks_reassemble(spark):
    pages = views.conversation_pages(spark, SF_SMALL)
    full = {r.doc_id: r.text for r in dc.assemble_text(pages).collect()}
    ch = dc.prompt_chunks(pages, 300)
    parts = dc.assemble_text(ch, group_cols=["chunk_id"]).collect()
    joined = {}
    for r in sorted(parts, key=lambda r: (r.doc_id, r.chunk_id)):
        joined[r.doc_id] = joined.get(r.doc_id, "") + r.text
    assert joined == full


def test_chunks_blocked_prefix_sum_matches_window(spark):
    pages = views.conversation_pages(spark, SF_SMALL)
    a = {(r.doc_id, r.page_no): (r.cum_chars, r.chunk_id) for r in dc.prompt_chunks(pages, 250).collect()}
    b = {(r.doc_id, r.page_no): (r.cum_chars, r.chunk_id)
         for r in dc.prompt_chunks(pages, 250, block_pages=2).collect()}
    assert a == b and len(a) == pages.count()
    whole = {r.doc_id: r.text for r in dc.assemble_text(pages).collect()}
    parts = {}
    for r in sorted(dc.assemble_chunks(pages, 250).collect(), key=lambda r: (r.doc_id, r.chunk_id)):
        parts[r.doc_id] = parts.get(r.doc_id, "") + r.text
    assert parts == whole


def test_page_limit(spark):
    pages = views.conversation_pages(spark, SF_SMALL)
    assert pages.transform(lambda d: dc.page_limit(d, 2)).agg(F.max("page_no")).first()[0] <= 2
    by_order = dc.page_limit(pages.drop("page_no").withColumn("o", F.rand(1)), 2, page_col=None, order_col="o")
    assert by_order.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_render_prompt_keeps_placeholders(spark):
    df = spark.createDataFrame([("text with {instructions} inside",)], "t string")
    p = df.select(dc.render_prompt(F.col("t"), F.lit("name, date")).alias("p")).first().p
    assert "text with {instructions} inside" in p and p.endswith("(no other text):")
    assert "Extraction Instructions:\nname, date" in p


def test_explode_fields_and_rules(spark):
    docs = spark.createDataFrame([(1, 'mail a.b@x.org and token = "abc123"'), (2, "nothing here")],
                                 "doc_id long, text string")
    long = rules.extract_rules(docs, ["email", "token", "unknown field"]).orderBy("doc_id", "ordinal").collect()
    assert len(long) == 6
    assert (long[0].field, long[0].value, long[0].n_matches, long[0].confidence) == ("email", "a.b@x.org", 1, 1.0)
    assert long[1].value == "abc123"
    assert long[2].value is None and long[2].n_matches == 0 and long[2].confidence is None
    assert all(r.value is None for r in long[3:])
    assert dc.explode_fields(docs, ["a", "b"]).count() == 4


def test_sections_and_cells(spark):
    text = "intro line\nSkills:\npython\nspark\nExperience:\nten years"
    docs = spark.createDataFrame([(1, text), (2, "a | b |c\nplain\n x|y ")], "doc_id long, text string")
    sec = rules.extract_sections(docs.where("doc_id = 1")).orderBy("section_no").collect()
    assert [(r.heading, r.body) for r in sec] == [(None, "intro line"), ("Skills", "python\nspark"),
                                                   ("Experience", "ten years")]
    cells = rules.extract_table_cells(docs.where("doc_id = 2")).orderBy("line_no", "col_no").collect()
    assert [(r.line_no, r.col_no, r.cell) for r in cells] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"),
                                                               (3, 1, "x"), (3, 2, "y")]


def test_key_values(spark):
    docs = spark.createDataFrame([(1, "Invoice Number: INV-1\nTotal Amount:   $5.00 \nOther: x")],
                                 "doc_id long, text string")
    r = rules.extract_key_values(docs, {"n": "Invoice Number", "t": "Total Amount", "d": "Due Date"}).first()
    assert (r.n, r.t, r.d) == ("INV-1", "$5.00", None)


def test_backtracking_email_pattern_matches_the_plain_one(spark):
    """The look-behind form finds exactly the matches of the plain pattern
    (a match inside a run also exists from the run's start), and a long run
    of word characters no longer costs quadratic time."""
    import random
    import re
    import time

    from docfields.operators import rules
    r = rules.RULES["email"]
    rnd = random.Random(11)
    alphabet = "ab.@-_x9 \n"
    for _ in range(3000):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        assert re.findall(r.pattern, s) == re.findall(r.jvm_pattern, s), s
    df = spark.createDataFrame([(1, "x" * 60000 + " mail a@b.com")], "doc_id long, text string")
    t0 = time.time()
    assert rules.extract_rules(df, ["email"]).first().value == "a@b.com"
    assert time.time() - t0 < 20
