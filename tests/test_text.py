import pytest
from pyspark.sql import functions as F

from docfields.functions import text as tx


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first().r


@pytest.mark.parametrize("text,expected", [
    ("a, b;c", ["a", "b;c"]),
    ("due-date", ["due", "date"]),
    (",,", []),
    ("", []),
    ("• x • y", ["x", "y"]),
    ("name\nemail", ["name", "email"]),
    ("just one", ["just one"]),
    ("a; b - c", ["a", "b - c"]),
])
def test_split_instructions(spark, text, expected):
    assert one(spark, tx.split_instructions("v"), text) == expected
    assert tx.parse_instructions(text) == expected


def test_truncate(spark):
    assert one(spark, tx.truncate_text("v"), "x" * 100) == "x" * 100
    assert one(spark, tx.truncate_text("v"), "x" * 101) == "x" * 100 + "..."
    assert one(spark, tx.truncate_text("v", 5), "éèçàùü") == "éèçàù..."


def test_key_format_check(spark):
    assert one(spark, tx.key_format_check("v"), "sk-" + "a" * 17) is False
    assert one(spark, tx.key_format_check("v"), "sk-" + "a" * 18) is True
    assert one(spark, tx.key_format_check("v"), None) is False
    assert one(spark, tx.key_format_check("v"), "") is False
    assert one(spark, tx.key_format_check("v"), "pk-" + "a" * 30) is False


def test_mask_secret(spark):
    assert one(spark, tx.mask_secret("v"), "short") == "short...short"
    key = "sk-abcdefghijklmnopqrstuvwxyz"
    assert one(spark, tx.mask_secret("v"), key) == key[:10] + "..." + key[-10:]
    assert one(spark, tx.mask_secret("v", safe=True), "sk-123") == "***"


@pytest.mark.parametrize("s", ["  a b 　", "\x0bx\x1c", "\x85y\x1f", "  ", "clean", "\t\n z \r\n",
                               " q ", "\x1dtab\x1e"])
def test_strip_matches_python(spark, s):
    assert one(spark, tx.strip_text("v"), s) == s.strip()


def test_format_value(spark):
    df = spark.createDataFrame([(None, "null"), ("true", "boolean"), ("false", "boolean"), (" x ", "string"),
                                ('{"a":1}', "object"), ("3", "number")], "v string, t string")
    got = [r.f for r in df.select(tx.format_value("v", "t").alias("f")).collect()]
    assert got == ["N/A", "Yes", "No", "x", '{"a":1}', "3"]


def test_format_timestamp(spark):
    df = spark.sql("select timestamp'2024-01-01 10:11:12' a, timestamp'2024-01-01 10:11:12.000250' b")
    r = df.select(tx.format_timestamp("a").alias("a"), tx.format_timestamp("b").alias("b")).first()
    assert r.a == "2024-01-01T10:11:12"
    assert r.b == "2024-01-01T10:11:12.000250"


def test_currency(spark):
    assert one(spark, tx.format_currency("v"), -1.5, "v double") == "$-1.50"
    assert one(spark, tx.format_currency("v"), 1234567.891, "v double") == "$1234567.89"
    assert one(spark, tx.format_decimal2("v"), 22.0, "v double") == "22.00"


def test_output_name(spark):
    assert one(spark, tx.output_name("v"), "/tmp/in/report.final.pdf") == "extracted_report.final.csv"
    assert one(spark, tx.output_name("v"), "noext") == "extracted_noext.csv"


def test_format_fixed_matches_python_rounding(spark):
    """Python rounds the exact binary value half-to-even (2.675 -> 2.67,
    0.125 -> 0.12, 1.005 -> 1.00); the native formatter must agree,
    including exact binary ties, decimal-text ties, signs and specials."""
    import random

    from pyspark.sql import functions as F

    from docfields.functions import text as tx
    rnd = random.Random(3)
    vals = [2.675, 0.125, 1.005, -0.001, -0.0, 0.0, 0.995, 9.995, 2.5, 3.5, -2.675, 4503599627370495.5,
            1e-300, 123456789.125, float("nan"), float("inf"), float("-inf")]
    vals += [round(rnd.uniform(-1000, 1000), 3) for _ in range(400)]
    vals += [rnd.randint(-10 ** 6, 10 ** 6) / 8 for _ in range(200)]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    for d in (0, 2, 3):
        for r in df.select("x", tx.format_fixed("x", d).alias("s")).collect():
            assert r.s == format(r.x, f".{d}f"), (r.x, d)
    row = df.limit(1).select(tx.format_currency(F.lit(-1.5)).alias("a"),
                             tx.format_currency(F.lit(None).cast("double")).alias("b")).first()
    assert row.a == "$-1.50" and row.b is None


def test_large_values_keep_their_digits(spark):
    from docfields.functions.text import format_fixed
    values = [2.0 ** 63, -2.0 ** 100, 9.2e18, 9.999999e37, 1e22, 1e23, 123456789.125]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [(r.t, r.u) for r in df.select(format_fixed("x", 2).alias("t"), format_fixed("x", 0).alias("u")).collect()] == \
        [(f"{v:.2f}", f"{v:.0f}") for v in values]
