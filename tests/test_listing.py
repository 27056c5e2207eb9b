import os

import pytest
from pyspark.errors import AnalysisException

from docfields.operators import batch, checks, model_stage
from docfields.plans import q_documents, q_results
from docfields.sources import readers

COLUMNS = ["path", "modificationTime", "length"]
NAMES = ["a b/1.txt", "a b/_x/2.txt", "a b/_y=1/3.txt", ".hid/4.txt", "c%20d/5 6.txt", "é/ü.txt", "_z.txt", "_q=1.txt", ".w.txt",
         "x.txt._COPYING_", "n.TXT", "_metadata.txt", "_metadata/7.txt", "a#b.txt", "q?.txt", "w{1}.txt", "a b/c/d/e/8.txt", "two\nlines.txt"]


def binary_files(spark, path, glob):
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    for name in NAMES:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"content of {name}")
    (root / "empty.txt").touch()
    (root / "broken.txt").symlink_to("nowhere.txt")
    (root / "linked").symlink_to("a b")
    return str(root)


@pytest.mark.parametrize("below", ["", "/", "/c%20d", "/é", "/a b"])
@pytest.mark.parametrize("glob", ["*.txt", "*.{txt,TXT}", "[!a-c]*"])
def test_tasks_list_what_spark_lists(spark, odd, below, glob):
    listed = readers.scan_documents(spark, odd + below, glob=glob)
    assert sorted(listed.collect()) == sorted(binary_files(spark, odd + below, glob).select(*COLUMNS).collect())
    assert listed.columns == COLUMNS and not any("content" in f or ".txt" in f for f in listed.inputFiles())


def test_what_tasks_cannot_list_is_left_to_spark(spark, odd):
    for path in (odd + "/*", odd + "/n.TXT"):
        want = sorted(binary_files(spark, path, "*").select(*COLUMNS).collect())
        assert want and sorted(readers.scan_documents(spark, path, glob="*").collect()) == want
    assert [os.path.basename(r.path) for r in readers.scan_documents(spark, odd + "/é", glob="*", recursive=False).collect()] == ["ü.txt"]
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        readers.scan_documents(spark, odd + "/none")


def documents(spark, path, n):
    rows = [(i, f"text {i} é", "en", "web", 8) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_the_driver_holds_no_document_file(spark, tmp_path):
    listed = q_documents.q_scan_documents(spark, documents(spark, tmp_path, 600))
    assert not any("doc_id=" in f for f in listed.inputFiles())
    assert {r.doc_id: r.length for r in listed.collect()} == {i: len(f"text {i} é".encode()) + 1 for i in range(600)}


@pytest.mark.parametrize("glob", ["*.txt", "*.{txt,TXT}"])
def test_tasks_read_what_spark_reads(spark, odd, glob):
    files = readers.scan_documents(spark, odd, glob=glob, with_content=True)
    want = binary_files(spark, odd, glob).select(*COLUMNS, "content")
    assert sorted(files.collect()) == sorted(want.collect()) and files.dtypes == want.dtypes


def test_few_tasks_read_many_files(spark, tmp_path):
    pages = q_documents.q_read_pages(spark, documents(spark, tmp_path, 600))
    assert pages.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert {r.doc_id: (r.page_no, r.text, r.error) for r in pages.collect()} == {i: (1, f"text {i} é\n", None) for i in range(600)}


def test_files_longer_than_a_batch(spark, tmp_path):
    """Batches are cut by bytes, and come back to the rows they belong to."""
    for i in range(24):
        (tmp_path / f"{i}.pdf").write_bytes(bytes([i]) * ((i % 4) * 9_000_000 + 1))
    (tmp_path / "long.pdf").write_bytes(b"x" * 40_000_000)
    files = readers.scan_documents(spark, str(tmp_path), with_content=True)
    got = files.selectExpr("regexp_extract(path, '([^/]+).pdf', 1) name", "length", "md5(content) = md5(repeat('x', 40000000)) is_long",
                           "octet_length(content) n", "hex(substr(content, 1, 1)) first", "hex(substr(content, -1)) last").collect()
    assert len(got) == 25 and all(r.length == r.n for r in got)
    assert {r.name: (r.n, r.first, r.last) for r in got if r.name != "long"} == {
        str(i): ((i % 4) * 9_000_000 + 1, f"{i:02X}", f"{i:02X}") for i in range(24)}
    assert [r.name for r in got if r.is_long] == ["long"]


def test_files_are_read_only_where_needed(spark, tmp_path):
    for name in ("a", "b", "gone"):
        (tmp_path / f"{name}.pdf").write_bytes(name.encode() * (1 if name != "gone" else 1000))
    files = readers.scan_documents(spark, str(tmp_path), with_content=True)
    (tmp_path / "gone.pdf").unlink()
    assert sorted(bytes(r.content) for r in checks.size_filter(files, max_mb=0.001).collect()) == [b"a", b"b"]
    assert files.select("path").count() == 3


def test_too_long_files_fail_as_before(spark, odd):
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 18)
    try:
        with pytest.raises(Exception, match="binaryFile.maxLength"):
            readers.scan_documents(spark, odd, glob="*.txt", with_content=True).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_documents_are_not_broadcast_by_the_size_of_their_list(spark, tmp_path, monkeypatch):
    """A list of files is small where their content is not: joins with texts must not go by it."""
    plans = []

    def staged(df, path=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return model_stage.stage_to_table(df, path)

    monkeypatch.setattr(batch, "stage_to_table", staged)
    rows = q_results.q_extract_files(spark, documents(spark, tmp_path, 600)).collect()
    right = plans[0].split("SortMergeJoin [_path")
    assert len(right) == 3 and "listagg" in right[2] and "LeftOuter, BuildRight" not in plans[0]
    got = {r.seq: (r.source_file, r.error) for r in rows}
    assert len(rows) == len(got) == 600 + 60 + 24 and got[1_000_010] == ("no-10", "PDF file not found: no-10")
    assert got[13] == ("13", readers.NOT_UTF8_MESSAGE) and got[2_000_025] == got[25]
    for i in (i for i in range(600) if i % 13):
        kind = len(f"\n--- Page 1 ---\ntext {i} é\n") % 5
        assert got[i] == (str(i), ["extractor returned NoneType instead of text", "extractor returned dict instead of text",
                                   "Failed to parse extraction result", "extractor failed", None][kind])
