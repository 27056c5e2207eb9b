import sys
import os

from pyspark.sql import functions as F

from docfields.operators import checks
from docfields.plans import q_documents, q_streaming
from docfields.sources import readers, sinks
from docfields.streaming.extract_stream import read_document_stream, stream_extract_rules
from tests.conftest import SF_SMALL
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_scan_read_pages_and_checks(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.pdf").write_bytes("page one\fpage two".encode())
    (d / "B.PDF").write_bytes(b"only")
    (d / "c.txt").write_bytes(b"not a document")
    lst = readers.scan_documents(spark, str(d))
    assert sorted(os.path.basename(r.path) for r in lst.collect()) == ["B.PDF", "a.pdf"]
    assert "content" not in lst.columns
    pages = readers.read_pages(readers.scan_documents(spark, str(d), with_content=True)).collect()
    got = sorted((os.path.basename(r.path), r.page_no, r.text) for r in pages)
    assert got == [("B.PDF", 1, "only"), ("a.pdf", 1, "page one"), ("a.pdf", 2, "page two")]

    def reader(b):
        if b == b"only":
            raise ValueError("unreadable")
        return b.decode().split("\f")
    plug = readers.read_pages(readers.scan_documents(spark, str(d), with_content=True), page_reader=reader).collect()
    assert sorted(((r.page_no, r.error) for r in plug), key=repr) == sorted([(None, "unreadable"), (1, None), (2, None)], key=repr)

    listing = lst.withColumn("path", F.regexp_replace("path", "^file:", ""))
    req = spark.createDataFrame([(str(d / "a.pdf"),), (str(d / "zz.pdf"),)], "path string")
    miss = checks.missing_documents(req, listing).collect()
    assert [r.error for r in miss] == [f"PDF file not found: {d / 'zz.pdf'}"]
    small = checks.size_filter(lst, max_mb=0.00001).count()
    assert small == 1


def test_html_to_text(spark):
    df = spark.createDataFrame([(1, "<html><head><title>T &amp; U</title><script>var a='</p>';</script>"
                                    "<style>p{}</style></head><body><!-- c --><p>Hi&nbsp;there</p>\n<p>x</p></body></html>")],
                               "page_id long, html string")
    r = readers.read_html_pages(df).first()
    assert r.title == "T & U" and r.text == "T & U Hi there x"


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5, "2024"), (2, None, None, "2024")],
                               "source_file long, email string, email_confidence double, extraction_timestamp string")
    p = sinks.sink_results(df, str(tmp_path / "res"), include_timestamp=False, include_confidence=False)
    back = sinks.read_back_results(spark, p, df.select("source_file", "email").schema)
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a"), (2, None)]
    c = sinks.sink_csv(df, str(tmp_path / "csv"))
    assert sinks.read_back_results(spark, c, df.schema, fmt="csv").count() == 2


def test_stream_extract(spark, tmp_path):
    schema = spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema
    s = read_document_stream(spark, SF_SMALL, schema, glob="documents.parquet")
    q = stream_extract_rules(s, ["email", "ip"], str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2 * spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_html_to_text_unclosed_tags(spark):
    """Closed script/style/comment blocks are removed; pages full of unclosed
    tags keep their text and take linear time (the regex is skipped)."""
    from docfields.sources import readers
    page = "<title>T</title><p>a</p><SCRIPT>x()</SCRIPT><style>s{}</style><!-- c --><p>b</p>"
    adversarial = "<p>k</p>" + "<script>y " * 3000
    df = spark.createDataFrame([(1, page), (2, adversarial)], "page_id long, html string")
    got = {r.page_id: r for r in readers.read_html_pages(df).collect()}
    assert got[1].title == "T" and got[1].text == "T a b"
    assert got[2].text.startswith("k y y") and got[2].text.count("y") == 3000


def test_stream_queries_read_a_folder_of_parts(spark, tmp_path):
    """A documents table of several files, as of one, is read whole."""
    rows = [(i, f"mail a{i}@b.org", "en", "web", 12) for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, parts in (("folder", 3), ("file", 1)):
        written = str(tmp_path / f"{name}-parts")
        table.repartition(parts).write.parquet(written)
        (tmp_path / name).mkdir()
        one = next((tmp_path / f"{name}-parts").glob("*.parquet"))
        (one if name == "file" else tmp_path / f"{name}-parts").rename(tmp_path / name / "documents.parquet")
        sf_dir = str(tmp_path / name)
        assert q_streaming.q_stream_extract_rules(spark, sf_dir).where("field = 'email' and confidence > 0").count() == 6
        batch = q_streaming.q_stream_batch_extract(spark, sf_dir).collect()
        assert sorted(r.email for r in batch) == [f"a{i}@b.org" for i in range(6)]


def test_document_files_share_folders(spark, tmp_path, monkeypatch):
    """One file per document, many to a folder; null texts are empty lines, rows
    of an id lines of its file, and an id may be missing."""
    monkeypatch.setattr(q_documents, "FOLDER_FILES", 40)
    rows = [(i, f"text {i} é", "en", "web", 8) for i in range(100)] + [(7, "again", "en", "web", 5), (200, None, None, None, None),
                                                                      (None, "no id", "en", "web", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    root = q_documents.write_document_files(spark, str(tmp_path))
    assert len(os.listdir(root.removeprefix("file:"))) == 3
    listed = {r.doc_id: r.length for r in q_documents.q_scan_documents(spark, str(tmp_path)).collect()}
    assert len(listed) == 102 and listed[3] == len("text 3 é".encode()) + 1 and listed[200] == 1 and listed[None] == 6
    pages = {r.doc_id: (r.page_no, r.text, r.error) for r in q_documents.q_read_pages(spark, str(tmp_path)).collect()}
    assert pages[3] == (1, "text 3 é\n", None) and pages[7] in ((1, "text 7 é\nagain\n", None), (1, "again\ntext 7 é\n", None))
    assert pages[200] == (1, "\n", None) and pages[None] == (1, "no id\n", None) and len(pages) == 102
