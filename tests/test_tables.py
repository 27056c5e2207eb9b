from docfields.operators import rules


def tables(spark, text, delimiter="|"):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return sorted(tuple(r)[1:] for r in rules.extract_tables(d, delimiter=delimiter).collect())


def test_header_rule_line_and_ragged_rows(spark):
    text = "intro\n| Name | Qty |\n|---|---:|\n| a | 1 |\n| b |\n| c | 3 | x |\nend"
    assert tables(spark, text) == [
        (1, 1, 1, "Name", "a"), (1, 1, 2, "Qty", "1"), (1, 2, 1, "Name", "b"), (1, 2, 2, "Qty", None),
        (1, 3, 1, "Name", "c"), (1, 3, 2, "Qty", "3"), (1, 3, 3, "col_3", "x")]


def test_tables_without_header_and_single_lines(spark):
    assert tables(spark, "1 | 2\n3 | 4\n\na | b\nx") == [
        (1, 1, 1, "col_1", "1"), (1, 1, 2, "col_2", "2"), (1, 2, 1, "col_1", "3"), (1, 2, 2, "col_2", "4")]
    assert tables(spark, "a | b") == [] and tables(spark, "") == [] and tables(spark, None) == []
    assert tables(spark, "a;b\n-;-\n1;2", ";") == [(1, 1, 1, "a", "1"), (1, 1, 2, "b", "2")]


def test_long_tables(spark):
    n = 30_000
    text = "No | Value\n" + "\n".join(f"{i} | v{i}" for i in range(n))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = rules.extract_tables(d)
    assert got.count() == 2 * n and got.where(f"row_no = {n} and header = 'Value'").first().value == f"v{n - 1}"
