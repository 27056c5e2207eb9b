"""Derived views over the driver tables (stand-ins for the reference's inputs).

Each is a lazy DataFrame; nothing is materialised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.session import spread
from docfields.sources.tables import read_table

TRIP_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LONG_LABEL = "Reference of the customer account as kept in our books of the year"
LONG_HEADING = " & Co. (terms, conditions and all other matters of this agreement)"
TRIP_COLUMNS = ["TRIP_MILES", "TRIP_SECONDS", "FARE", "COMPANY", "PAYMENT_TYPE", "TIP_RATE"]


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxi-trip stand-in built from lineitem with the published fare formula."""
    li = read_table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    seconds = q * 90 + (F.col("l_partkey") % 600)
    fare = (F.lit(2.25) * q + F.lit(0.12) * seconds / 60 + F.lit(3.25)
            + ((F.col("l_suppkey") % 7) - 3) * F.lit(0.5))
    return li.select(
        *TRIP_KEY,
        q.alias("TRIP_MILES"),
        seconds.cast("double").alias("TRIP_SECONDS"),
        fare.alias("FARE"),
        F.concat(F.lit("Company "), (F.col("l_suppkey") % 31).cast("string")).alias("COMPANY"),
        F.when(F.col("l_returnflag") == "R", "Credit Card")
         .when(F.col("l_returnflag") == "A", "Cash").otherwise("Mobile").alias("PAYMENT_TYPE"),
        (F.col("l_tax") * 100).alias("TIP_RATE"),
    )


def trips_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trips`` with COMPANY nulled on every 50th part key (missing-value fixture)."""
    t = trips(spark, sf_dir)
    return t.withColumn("COMPANY", F.when(F.col("l_partkey") % 50 == 0, F.lit(None)).otherwise(F.col("COMPANY")))


def trips_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trips`` with NaN fares, null miles and NaN seconds on some part keys."""
    t, p = trips(spark, sf_dir), F.col("l_partkey")
    return t.withColumns({
        "FARE": F.when(p % 17 == 0, F.lit(float("nan"))).otherwise(F.col("FARE")),
        "TRIP_MILES": F.when(p % 19 != 0, F.col("TRIP_MILES")),
        "TRIP_SECONDS": F.when(p % 23 == 0, F.lit(float("nan"))).otherwise(F.col("TRIP_SECONDS"))})


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice text rendered from orders joined to customer (one row per order)."""
    # rendering and the label regexes downstream are CPU-bound: spread an
    # under-split scan over all task slots (a no-op when splits >= slots)
    o = spread(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey)
    day = F.col("o_orderdate").cast("date")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Invoice Number: INV-"), F.col("o_orderkey").cast("string")),
        F.concat(F.lit("Customer Name: "), F.col("c_name")),
        F.concat(F.lit("Total Amount: $"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")),
        F.concat(F.lit("Invoice Date: "), F.date_format(day, "yyyy-MM-dd")),
        F.concat(F.lit("Due Date: "), F.date_format(F.date_add(day, 30), "yyyy-MM-dd")),
        F.concat(F.lit(LONG_LABEL), F.lit(": "), F.col("o_custkey").cast("string")),
        F.lit("Remarks:"), F.concat(F.lit("paid by "), F.col("c_name")), F.lit("Terms:"), F.lit("none"),
    )
    return j.select("o_orderkey", text.alias("text"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-response stand-in covering every JSON shape (from events.props)."""
    # the strict JSON check downstream is a Python stage: spread an under-split scan
    e = spread(read_table(spark, sf_dir, "events").select("event_id", "props"))
    r = F.col("event_id") % 10
    resp = (F.when(r == 0, F.concat(F.col("props"), F.lit(" trailing")))
             .when(r == 1, F.lit("[1, 2]"))
             .when(r == 2, F.lit("null"))
             .when(r == 3, F.concat(F.lit('{"value": '), F.col("event_id").cast("string"), F.lit(', "confidence": 0.5}')))
             .when(r == 4, F.lit('{"k": null, "flag": true, "tags": ["a", "b"]}'))
             .when(r == 5, F.lit("```json"))
             .otherwise(F.col("props")))
    return e.select("event_id", resp.alias("response"))


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paged documents: conv_id = document, turn + 1 = 1-based page number."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"),
                    F.col("text"))


def sectioned_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per conversation: each turn under a ``Role:`` heading line."""
    c = read_table(spark, sf_dir, "conversations")
    # every third turn's heading is a long one with marks
    heading = F.concat(F.initcap(F.col("role")), F.when(F.col("turn") % 3 == 2, F.lit(LONG_HEADING)).otherwise(F.lit("")))
    piece = F.concat(heading, F.lit(":\n"), F.coalesce(F.col("text"), F.lit("")))
    return (c.withColumn("piece", piece).groupBy("conv_id")
             .agg(F.expr("listagg(piece, '\\n') WITHIN GROUP (ORDER BY turn)").alias("text")))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resume text rendered from customers: headings in capitals, as titles and
    with a colon, and lines in labels."""
    c = spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal"))
    number = lambda name: F.col(name).cast("string")
    text = F.concat_ws(
        "\n", F.concat(F.lit("Name: "), F.col("c_name")), F.concat(F.lit("Contact: nation "), number("c_nationkey")), F.lit(""),
        F.lit("Professional Summary"), F.concat(F.lit("Active in "), F.lower("c_mktsegment"), F.lit(".")),
        F.lit("Balance kept over the years."), F.lit(""),
        F.lit("SKILLS"), F.concat(F.lit("- ledger no. "), number("c_custkey")), F.lit("- bookkeeping"),
        F.lit("Work Experience:"), F.concat(F.lit("clerk, nation "), number("c_nationkey")), F.lit(""), F.lit("senior clerk"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("\nCertifications\nnone so far")))
    return c.select("c_custkey", text.alias("text"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account statements rendered from customers: two tables in one text, with
    a rule line, outer delimiters and ragged lines; the second without a header."""
    c = spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal"))
    number = lambda name: F.col(name).cast("string")
    text = F.concat_ws(
        "\n", F.concat(F.lit("Statement of "), F.col("c_name")), F.lit("| Account | Segment | Note |"), F.lit("|---|:--|--|"),
        F.concat(F.lit("| "), number("c_custkey"), F.lit(" | "), F.col("c_mktsegment"), F.lit(" |")),
        F.concat(F.lit("| total | "), number("c_nationkey"), F.lit(" | ok | beyond |")), F.lit(""), F.lit("Not a table: a | b"), F.lit(""),
        F.concat(F.lit("1 | "), F.col("c_name")), F.concat(F.lit("2 | "), F.col("c_mktsegment"), F.lit(" | ")), F.lit("End."))
    return c.select("c_custkey", text.alias("text"))
