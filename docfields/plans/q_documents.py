"""Registered queries: sources, request checks, document text, rule extraction."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions import text as tx
from docfields.operators import checks, documents as dc, rules
from docfields.plans import views
from docfields.plans.registry import query
from docfields.session import scratch_path, shared_filesystem, ship_package, spread
from docfields.sources import readers, sinks
from docfields.sources.tables import read_table

RULE_FIELDS = ["email", "ip", "card", "token", "license"]
STRIP_SQL = tx.STRIP_PATTERN  # same spelling is valid RE2

TRIPS_SQL = """trips AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         l_quantity AS TRIP_MILES,
         CAST(l_quantity * 90 + (l_partkey % 600) AS DOUBLE) AS TRIP_SECONDS,
         2.25e0 * l_quantity + 0.12e0 * (l_quantity * 90 + (l_partkey % 600)) / 60
           + 3.25e0 + ((l_suppkey % 7) - 3) * 0.5e0 AS FARE,
         concat('Company ', CAST(l_suppkey % 31 AS VARCHAR)) AS COMPANY,
         CASE l_returnflag WHEN 'R' THEN 'Credit Card' WHEN 'A' THEN 'Cash' ELSE 'Mobile' END AS PAYMENT_TYPE,
         l_tax * 100 AS TIP_RATE
  FROM lineitem)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def text_docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Documents for a CPU-heavy text stage, spread over all task slots."""
    return spread(docs(spark, sf_dir).select(*(cols or ("doc_id", "text"))))


def doc_paths(df: DataFrame) -> DataFrame:
    """Request/listing path stand-in: docs/<id> with a pdf, PDF or txt suffix."""
    ext = F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".PDF").otherwise(".txt")
    return df.select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), ext).alias("path"))


PATH_SQL = ("concat('docs/', CAST(doc_id AS VARCHAR), CASE doc_id % 3 WHEN 0 THEN '.pdf' "
            "WHEN 1 THEN '.PDF' ELSE '.txt' END)")


_DOC_FILES: dict[tuple[str, str], str] = {}


#: Document files in a folder: folders are listed side by side, the files of one by one task.
FOLDER_FILES = 2000


def write_document_files(spark: SparkSession, sf_dir: str) -> str:
    """One UTF-8 file per document (``<folder>/doc_id=<id>.txt``) in the shared
    folder; written once per session and table folder.

    Tasks write their files themselves, FOLDER_FILES to a folder: a folder per
    document takes one step of the driver each to commit and another to list.
    Rows of a task that repeat an id are lines of one file. A file has a draft
    name until it is whole; a task that runs again writes the same files.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DOC_FILES:
        ship_package(spark)
        path = scratch_path(spark, "docfiles")
        store, root = shared_filesystem(path)
        store.create_dir(root, recursive=True)
        rows = docs(spark, sf_dir).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("name"),
                                          F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("line"))
        rows.sortWithinPartitions("name").mapInArrow(_file_writer(path), "files long").write.format("noop").mode("overwrite").save()
        _DOC_FILES[key] = path
    return _DOC_FILES[key]


def _file_writer(path: str):
    """Rows (``name, line``, sorted by name) to one file per name; tells their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = shared_filesystem(path)
        part, files = TaskContext.get().partitionId(), 0
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for name, lines in groupby(rows, itemgetter(0)):
            folder = f"{root}/{part:05d}-{files // FOLDER_FILES:05d}"
            if files % FOLDER_FILES == 0:
                store.create_dir(folder, recursive=True)
            draft = f"{folder}/.draft-{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                for _, line in lines:
                    out.write(line + b"\n")
            store.move(draft, f"{folder}/doc_id={name}.txt")
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return run


# ---------------------------------------------------------------- sources

@query("scan_documents", """
SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS length FROM documents""")
def q_scan_documents(spark, sf_dir):
    """Written document files, listed by tasks (bytes not read)."""
    root = write_document_files(spark, sf_dir)
    lst = readers.scan_documents(spark, root, glob="*.txt")
    return lst.select(F.regexp_extract("path", r"doc_id=([0-9]+)", 1).try_cast("bigint").alias("doc_id"), "length")


@query("read_pages", r"""
SELECT doc_id, 1 AS page_no, text || chr(10) AS text, CAST(NULL AS VARCHAR) AS error FROM documents""")
def q_read_pages(spark, sf_dir):
    """File bytes -> page rows with the native form-feed reader."""
    root = write_document_files(spark, sf_dir)
    files = readers.scan_documents(spark, root, glob="*.txt", with_content=True)
    pages = readers.read_pages(files)
    return pages.select(F.regexp_extract("path", r"doc_id=([0-9]+)", 1).try_cast("bigint").alias("doc_id"),
                        "page_no", "text", "error")


def _html_sql(expr: str) -> str:
    e = f"regexp_replace({expr}, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    e = f"regexp_replace({e}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    e = f"regexp_replace({e}, '(?s)<!--.*?-->', ' ', 'g')"
    e = f"regexp_replace({e}, '<[^>]*>', ' ', 'g')"
    for ent, ch in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        e = f"replace({e}, '{ent}', '{ch}')"
    e = f"regexp_replace({e}, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')"
    return f"trim({e})"


@query("read_html_pages", f"""
SELECT page_id, {_html_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
       {_html_sql("html")} AS text FROM pages""")
def q_read_html_pages(spark, sf_dir):
    return readers.read_html_pages(spread(read_table(spark, sf_dir, "pages")))


@query("read_html_pages_refs", """
SELECT page_id, 'caf' || chr(233) || ' ' || page_id AS title,
       'caf' || chr(233) || ' ' || page_id || ' it' || chr(8217) || 's A ' || chr(8212) || ' 1 < 2 and 3 > 2 &lt; a' || chr(8364) || ' x <3' AS text FROM pages""")
def q_read_html_pages_refs(spark, sf_dir):
    """Named and numeric references, decoded once, and "<" that is no tag."""
    p = read_table(spark, sf_dir, "pages").select("page_id")
    n = F.col("page_id").cast("string")
    markup = F.concat(F.lit("<html><title>caf&eacute; "), n, F.lit("</title><script>if (a<b) x('&amp;')</script><p>it&#8217;s &#x41; &mdash; "
                      "1 < 2 and 3 > 2</p><!-- no --><b class='&quot;'>&amp;lt; a&euro;</b>&nbsp;x <3"))
    return readers.read_html_pages(p.withColumn("html", markup))


TRIP_CSV_SCHEMA = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, TRIP_MILES double, "
                   "TRIP_SECONDS double, FARE double, COMPANY string, PAYMENT_TYPE string, TIP_RATE double")


@query("scan_csv", f"WITH {TRIPS_SQL} SELECT * FROM trips")
def q_scan_csv(spark, sf_dir):
    """trips written as header CSV, read back with an explicit schema."""
    path = scratch_path(spark, "trips-csv")
    sinks.sink_csv(views.trips(spark, sf_dir), path)
    return readers.scan_csv(spark, path, TRIP_CSV_SCHEMA)


def rules_long(spark, sf_dir) -> DataFrame:
    return rules.extract_rules(text_docs(spark, sf_dir), RULE_FIELDS)


def _rule_sql_items() -> list[tuple[int, str, str, int]]:
    return [(i + 1, f, rules.RULES[rules.resolve_field(f)].pattern, rules.RULES[rules.resolve_field(f)].group)
            for i, f in enumerate(RULE_FIELDS)]


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _all_matches_sql(rule: rules.Rule) -> str:
    # patterns that take a character on either side: separators are doubled, so
    # that neighbouring matches do not compete for one
    text = r"regexp_replace(text, '([^0-9.])', '\1\1', 'g')" if rule.backtracking_group is not None else "text"
    return f"regexp_extract_all({text}, {_sql_lit(rule.pattern)}, {rule.group})"


RULES_LONG_SQL = "\nUNION ALL\n".join(
    f"""SELECT doc_id, {i + 1} AS ordinal, '{f}' AS field, {m}[1] AS value, CAST(len({m}) AS BIGINT) AS n_matches,
       CASE WHEN len({m}) > 0 THEN 1.0 END AS confidence
FROM documents""" for i, f in enumerate(RULE_FIELDS) for m in [_all_matches_sql(rules.RULES[rules.resolve_field(f)])])


@query("sink_csv", RULES_LONG_SQL)
def q_sink_csv(spark, sf_dir):
    path = scratch_path(spark, "rules-csv")
    df = rules_long(spark, sf_dir)
    sinks.sink_csv(df, path)
    return readers.scan_csv(spark, path, df.schema)


@query("sink_json", RULES_LONG_SQL)
def q_sink_json(spark, sf_dir):
    path = scratch_path(spark, "rules-json")
    df = rules_long(spark, sf_dir)
    sinks.sink_json(df, path)
    return spark.read.schema(df.schema).json(path)


def rules_wide(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir)
    cols = [rules.rule_column(f, F.col("text")).alias(f) for f in RULE_FIELDS]
    return d.select(F.col("doc_id").alias("source_file"), *cols)


RULES_WIDE_SQL = "SELECT doc_id AS source_file, " + ", ".join(
    f"nullif(regexp_extract(text, {_sql_lit(p)}, {g}), '') AS {f}" for _, f, p, g in _rule_sql_items()
) + " FROM documents"


@query("sink_results", RULES_WIDE_SQL.replace(" FROM documents", ", 'rules' AS provider FROM documents"))
def q_sink_results(spark, sf_dir):
    """Consolidated wide results with run metadata, timestamp column excluded."""
    from docfields.operators.results import with_run_metadata
    path = scratch_path(spark, "results")
    sinks.sink_results(with_run_metadata(rules_wide(spark, sf_dir), "rules"), path, include_timestamp=False)
    return spark.read.parquet(path)


@query("read_back_results", RULES_WIDE_SQL)
def q_read_back_results(spark, sf_dir):
    """Results written as CSV and re-read with an explicit schema."""
    path = scratch_path(spark, "results-csv")
    df = rules_wide(spark, sf_dir)
    sinks.sink_csv(df, path)
    return sinks.read_back_results(spark, path, df.schema, fmt="csv")


# ---------------------------------------------------------------- projections / checks

@query("select_columns", f"""WITH {TRIPS_SQL}
SELECT TRIP_MILES, TRIP_SECONDS, FARE, COMPANY, PAYMENT_TYPE, TIP_RATE FROM trips""")
def q_select_columns(spark, sf_dir):
    return views.trips(spark, sf_dir).select(*views.TRIP_COLUMNS)


@query("derive_minutes", f"""WITH {TRIPS_SQL}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, TRIP_SECONDS, TRIP_SECONDS / 60 AS TRIP_MINUTES FROM trips""")
def q_derive_minutes(spark, sf_dir):
    from docfields.operators.regression import derive_minutes
    return derive_minutes(views.trips(spark, sf_dir)).select(*views.TRIP_KEY, "TRIP_SECONDS", "TRIP_MINUTES")


@query("head_rows", f"""WITH {TRIPS_SQL}
SELECT * FROM trips ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 200""")
def q_head_rows(spark, sf_dir):
    """First 200 rows in key order (a distributed top-k)."""
    return views.trips(spark, sf_dir).orderBy(*views.TRIP_KEY).limit(200)


@query("valid_documents", f"""
WITH req AS (SELECT {PATH_SQL} AS path FROM documents),
     lst AS (SELECT {PATH_SQL} AS lpath, doc_id % 7 <> 0 AS is_file FROM labels),
     j AS (SELECT path, lpath, is_file FROM req LEFT JOIN lst ON path = lpath),
     r AS (SELECT path, CASE WHEN lpath IS NULL THEN 'PDF file not found: ' || path
                             WHEN NOT is_file THEN 'Path is not a file: ' || path
                             WHEN NOT lower(path) LIKE '%.pdf' THEN 'File is not a PDF: ' || path END AS reason
           FROM j)
SELECT path, reason IS NULL AS valid, reason FROM r""")
def q_valid_documents(spark, sf_dir):
    req = doc_paths(docs(spark, sf_dir)).select("path")
    lst = doc_paths(read_table(spark, sf_dir, "labels")).select("path", (F.col("doc_id") % 7 != 0).alias("is_file"))
    return checks.valid_documents(req, lst)


@query("missing_documents", f"""
SELECT r.path AS source_file, 'PDF file not found: ' || r.path AS error
FROM (SELECT {PATH_SQL} AS path FROM documents) r
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE ({PATH_SQL.replace('doc_id', 'l.doc_id')}) = r.path)""")
def q_missing_documents(spark, sf_dir):
    req = doc_paths(docs(spark, sf_dir))
    lst = doc_paths(read_table(spark, sf_dir, "labels"))
    return checks.missing_documents(req, lst)


SIZE_CAP_MB = 0.01


@query("size_filter", f"""
SELECT doc_id, strlen(text) / 1048576.0 AS size_mb FROM documents WHERE strlen(text) / 1048576.0 <= {SIZE_CAP_MB}""")
def q_size_filter(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.octet_length("text").alias("length"))
    return checks.size_filter(d, "length", SIZE_CAP_MB).select("doc_id", "size_mb")


PAGE_CAP = 4


@query("page_limit", f"""
SELECT conv_id AS doc_id, turn + 1 AS page_no, text FROM conversations WHERE turn + 1 <= {PAGE_CAP}""")
def q_page_limit(spark, sf_dir):
    return dc.page_limit(views.conversation_pages(spark, sf_dir), PAGE_CAP)


TOKEN_RULE = rules.RULES["token"]


@query("key_format_check", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, {_sql_lit(TOKEN_RULE.pattern)}, 1)) AS tok,
                  unnest(range(1, len(regexp_extract_all(text, {_sql_lit(TOKEN_RULE.pattern)}, 1)) + 1)) AS ordinal
           FROM documents),
     k AS (SELECT doc_id, ordinal, unnest([tok, 'sk-' || tok, 'sk-' || left(tok, 17), 'sk-' || left(tok, 18)]) AS key
           FROM t)
SELECT doc_id, ordinal, key, coalesce(starts_with(key, 'sk-') AND length(key) > 20, false) AS ok FROM k""")
def q_key_format_check(spark, sf_dir):
    d = text_docs(spark, sf_dir)
    toks = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN_RULE.pattern), 1))
                    .alias("_i", "tok"))
    keys = toks.select("doc_id", (F.col("_i") + 1).alias("ordinal"),
                       F.explode(F.array("tok", F.concat(F.lit("sk-"), "tok"),
                                         F.concat(F.lit("sk-"), F.substring("tok", 1, 17)),
                                         F.concat(F.lit("sk-"), F.substring("tok", 1, 18)))).alias("key"))
    return keys.withColumn("ok", tx.key_format_check("key"))


def requests_view(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir)
    tok = F.regexp_extract("text", TOKEN_RULE.pattern, 1)
    return d.select("doc_id",
                    F.when(tok != "", F.concat(F.lit("sk-"), tok)).otherwise(F.lit("")).alias("api_key"),
                    F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(
                        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("path"),
                    F.when(F.col("lang") == "de", F.lit(None).cast("string"))
                     .otherwise(F.lit("email, ip, token")).alias("instructions"))


@query("required_inputs", f"""
WITH r AS (SELECT doc_id,
  CASE WHEN regexp_extract(text, {_sql_lit(TOKEN_RULE.pattern)}, 1) <> ''
       THEN 'sk-' || regexp_extract(text, {_sql_lit(TOKEN_RULE.pattern)}, 1) ELSE '' END AS api_key,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'docs/' || doc_id || '.pdf' END AS path,
  CASE WHEN lang = 'de' THEN NULL ELSE 'email, ip, token' END AS instructions FROM documents)
SELECT doc_id, CASE WHEN api_key IS NULL OR api_key = '' THEN 'Please provide an API key'
                    WHEN path IS NULL OR path = '' THEN 'Please upload a PDF file'
                    WHEN instructions IS NULL OR instructions = '' THEN 'Please specify what data to extract' END AS reason,
       (api_key IS NOT NULL AND api_key <> '' AND path IS NOT NULL AND path <> ''
        AND instructions IS NOT NULL AND instructions <> '') AS runnable
FROM r""")
def q_required_inputs(spark, sf_dir):
    return checks.required_inputs(requests_view(spark, sf_dir)).select("doc_id", "reason", "runnable")


# ---------------------------------------------------------------- document text

@query("assemble_text", r"""
SELECT conv_id AS doc_id, string_agg(chr(10) || '--- Page ' || (turn + 1) || ' ---' || chr(10) || coalesce(text, ''),
       '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def q_assemble_text(spark, sf_dir):
    return dc.assemble_text(views.conversation_pages(spark, sf_dir))


@query("page_count", "SELECT conv_id AS doc_id, count(*) AS n_pages FROM conversations GROUP BY conv_id")
def q_page_count(spark, sf_dir):
    return dc.page_count(views.conversation_pages(spark, sf_dir))


def _split_sql(col: str) -> str:
    chain = " ".join(f"WHEN contains({col}, {d!s}) THEN string_split({col}, {d!s})" for d in
                     ["','", "';'", "chr(10)", "'-'", "'•'"])
    return (f"list_filter(list_transform(CASE {chain} ELSE [{col}] END, "
            f"lambda x: regexp_replace(x, {_sql_lit(STRIP_SQL)}, '', 'g')), lambda x: x <> '')")


@query("split_instructions", f"""
WITH s AS (SELECT doc_id, {_split_sql('text')} AS f FROM documents)
SELECT doc_id, unnest(range(1, len(f) + 1)) AS ordinal, unnest(f) AS field FROM s""")
def q_split_instructions(spark, sf_dir):
    d = text_docs(spark, sf_dir)
    return d.select("doc_id", F.posexplode(tx.split_instructions("text")).alias("_i", "field")) \
            .select("doc_id", (F.col("_i") + 1).alias("ordinal"), "field")


EXPLODE_FIELDS = ["email", "ip address", "card number", "token"]


@query("explode_fields", "SELECT doc_id, ordinal, field FROM documents, (VALUES " + ", ".join(
    f"({i + 1}, '{f}')" for i, f in enumerate(EXPLODE_FIELDS)) + ") AS t(ordinal, field)")
def q_explode_fields(spark, sf_dir):
    return dc.explode_fields(docs(spark, sf_dir).select("doc_id"), EXPLODE_FIELDS)


PROMPT_INSTRUCTIONS = "customer name, invoice number, total amount, due date"


@query("render_prompt", f"""
SELECT doc_id, {_sql_lit(dc.PROMPT_HEAD)} || coalesce(text, '') || {_sql_lit(dc.PROMPT_MIDDLE)}
       || {_sql_lit(PROMPT_INSTRUCTIONS)} || {_sql_lit(dc.PROMPT_TAIL)} AS prompt FROM documents""")
def q_render_prompt(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", dc.render_prompt(F.col("text"), F.lit(PROMPT_INSTRUCTIONS))
                                      .alias("prompt"))


BUDGET = 1000


@query("prompt_chunks", f"""
WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page_no,
                  length(chr(10) || '--- Page ' || (turn + 1) || ' ---' || chr(10) || coalesce(text, '')) AS len
           FROM conversations),
     c AS (SELECT doc_id, page_no, len, sum(len) OVER (PARTITION BY doc_id ORDER BY page_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_chars FROM p)
SELECT doc_id, page_no, cum_chars, CAST(2 * floor((cum_chars - 1) / {BUDGET // 2}) + CASE WHEN len <= {BUDGET // 2} THEN 1 ELSE 0 END
            AS BIGINT) AS chunk_id FROM c""")
def q_prompt_chunks(spark, sf_dir):
    return dc.prompt_chunks(views.conversation_pages(spark, sf_dir), BUDGET).select(
        "doc_id", "page_no", "cum_chars", "chunk_id")


@query("assemble_chunks", f"""
WITH p AS (SELECT CASE WHEN conv_id % 3 = 0 THEN -1 ELSE conv_id END AS doc_id, conv_id * 64 + turn + 1 AS page_no,
                  chr(10) || '--- Page ' || (conv_id * 64 + turn + 1) || ' ---' || chr(10) || coalesce(text, '') AS piece FROM conversations),
     c AS (SELECT *, length(piece) AS len, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY page_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM p)
SELECT doc_id, CAST(2 * floor((cum - 1) / {BUDGET // 2}) + CASE WHEN len <= {BUDGET // 2} THEN 1 ELSE 0 END AS BIGINT) AS chunk_id,
       string_agg(piece, '' ORDER BY page_no) AS text FROM c GROUP BY ALL""")
def q_assemble_chunks(spark, sf_dir):
    """Assembly in bounded rows where one document holds a third of all pages:
    its pages are dealt by blocks of page numbers, and no row exceeds the budget."""
    c = read_table(spark, sf_dir, "conversations")
    pages = c.select(F.when(F.col("conv_id") % 3 == 0, F.lit(-1)).otherwise(F.col("conv_id")).cast("long").alias("doc_id"),
                     (F.col("conv_id") * 64 + F.col("turn") + 1).alias("page_no"), "text")
    return dc.assemble_chunks(pages, BUDGET).select("doc_id", "chunk_id", "text")


DOC_BUDGET = 4000


@query("prompt_budget", f"""
SELECT doc_id, length(text) AS n_chars_text, length(text) > {DOC_BUDGET} AS over_budget,
       CAST(greatest(1, ceil(length(text) / {DOC_BUDGET}.0)) AS BIGINT) AS n_chunks FROM documents""")
def q_prompt_budget(spark, sf_dir):
    return dc.prompt_budget(docs(spark, sf_dir), DOC_BUDGET).select("doc_id", "n_chars_text", "over_budget",
                                                                    "n_chunks")


# ---------------------------------------------------------------- extraction

@query("extract_rules", RULES_LONG_SQL)
def q_extract_rules(spark, sf_dir):
    return rules_long(spark, sf_dir)


INVOICE_LABELS = {"invoice_number": "Invoice Number", "customer_name": "Customer Name",
                  "total_amount": "Total Amount", "invoice_date": "Invoice Date", "due_date": "Due Date"}


@query("extract_key_values", """
SELECT o_orderkey, 'INV-' || o_orderkey AS invoice_number, c_name AS customer_name,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total_amount,
       strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS invoice_date,
       strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS due_date
FROM orders JOIN customer ON o_custkey = c_custkey""")
def q_extract_key_values(spark, sf_dir):
    """Invoice fields parsed back out of the rendered invoice text, then typed."""
    kv = rules.extract_key_values(views.invoices(spark, sf_dir), INVOICE_LABELS, key_col="o_orderkey")
    return kv.withColumn("total_amount", F.regexp_replace("total_amount", r"^[$]", "").try_cast("double"))


def _lines_sql(table: str, key: str, col: str) -> str:
    return (f"SELECT {key}, unnest(range(1, len(string_split({col}, chr(10))) + 1)) AS line_no, "
            f"unnest(string_split({col}, chr(10))) AS line FROM {table}")


@query("extract_clauses", f"""
WITH l AS ({_lines_sql('documents', 'doc_id', 'text')})
""" + "UNION ALL\n".join(
    f"SELECT doc_id, line_no, '{name}' AS clause, line FROM l WHERE regexp_matches(line, {_sql_lit(p)})\n"
    for name, p in rules.CLAUSES.items()))
def q_extract_clauses(spark, sf_dir):
    return rules.extract_clauses(text_docs(spark, sf_dir))


@query("extract_sections", """
SELECT conv_id AS doc_id, turn + 1 AS section_no, upper(left(role, 1)) || lower(substr(role, 2))
       || CASE WHEN turn % 3 = 2 THEN ' & Co. (terms, conditions and all other matters of this agreement)' ELSE '' END AS heading,
       coalesce(text, '') AS body FROM conversations""")
def q_extract_sections(spark, sf_dir):
    """Sections recovered from conversations rendered under ``Role:`` headings."""
    return rules.extract_sections(views.sectioned_conversations(spark, sf_dir), key_col="conv_id") \
                .withColumnRenamed("conv_id", "doc_id")


FORM_QUOTED, FORM_COLON = rules.FORM_QUOTED, rules.FORM_COLON


@query("extract_form_fields", f"""
SELECT doc_id, 'assign' AS form, unnest(regexp_extract_all(text, {_sql_lit(FORM_QUOTED)}, 1)) AS name,
       unnest(regexp_extract_all(text, {_sql_lit(FORM_QUOTED)}, 2)) AS value FROM documents
UNION ALL
SELECT doc_id, 'label' AS form, unnest(regexp_extract_all(text, {_sql_lit(FORM_COLON)}, 1)) AS name,
       unnest(regexp_extract_all(text, {_sql_lit(FORM_COLON)}, 2)) AS value FROM documents""")
def q_extract_form_fields(spark, sf_dir):
    return rules.extract_form_fields(text_docs(spark, sf_dir))


# The long label and the other lines of the rendered invoice, from the join itself.
@query("extract_form_fields_invoices", """
WITH o AS (SELECT o_orderkey, o_custkey, c_name, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total,
                  CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, 'label' AS form, unnest(['Invoice Number', 'Customer Name', 'Total Amount', 'Invoice Date', 'Due Date',
         'Reference of the customer account as kept in our books of the year']) AS name,
       unnest(['INV-' || o_orderkey, c_name, '$' || total, strftime(d, '%Y-%m-%d'), strftime(d + 30, '%Y-%m-%d'),
               CAST(o_custkey AS VARCHAR)]) AS value FROM o""")
def q_extract_form_fields_invoices(spark, sf_dir):
    return rules.extract_form_fields(views.invoices(spark, sf_dir), key_col="o_orderkey")


INVOICE_FIELDS = ["customer name", "invoice_number", "Total Amount", "due date", "remarks", "email"]


@query("extract_fields", """
WITH o AS (SELECT o_orderkey, c_name, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total,
                  CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, unnest([1, 2, 3, 4, 5, 6]) AS ordinal,
       unnest(['customer name', 'invoice_number', 'Total Amount', 'due date', 'remarks', 'email']) AS field,
       unnest([c_name, 'INV-' || o_orderkey, '$' || total, strftime(d + 30, '%Y-%m-%d'), 'paid by ' || c_name, NULL]) AS value,
       unnest([1, 1, 1, 1, 1, 0]) AS n_matches,
       unnest(['label', 'label', 'label', 'label', 'section', NULL]) AS found_by FROM o""")
def q_extract_fields(spark, sf_dir):
    """Ordinary instruction fields: by rule, else by label, else by section."""
    got = rules.extract_fields(views.invoices(spark, sf_dir), INVOICE_FIELDS, key_col="o_orderkey")
    return got.drop("matches")


# Items of a resume instruction, as the reference's presets word them.
RESUME_FIELDS = ["Full name and contact information", "Professional summary", "Key skills (list all)",
                 "Work experience (company, position, duration, achievements)", "Certifications", "Renewal terms"]


@query("extract_fields_resumes", """
SELECT c_custkey, unnest([1, 2, 3, 4, 5, 6]) AS ordinal,
       unnest(['Full name and contact information', 'Professional summary', 'Key skills (list all)',
               'Work experience (company, position, duration, achievements)', 'Certifications', 'Renewal terms']) AS field,
       unnest([c_name, 'Active in ' || lower(c_mktsegment) || '.\nBalance kept over the years.',
               '- ledger no. ' || c_custkey || '\n- bookkeeping', 'clerk, nation ' || c_nationkey || '\n\nsenior clerk',
               CASE WHEN c_custkey % 2 = 0 THEN 'none so far' END, NULL]) AS value,
       unnest([2, 1, 1, 1, 1 - c_custkey % 2, 0]) AS n_matches,
       unnest(['label', 'section', 'section', 'section', CASE WHEN c_custkey % 2 = 0 THEN 'section' END, NULL]) AS found_by
FROM (SELECT * FROM customer)""".replace("\\n", "' || chr(10) || '"))
def q_extract_fields_resumes(spark, sf_dir):
    """Items with qualifiers, found under headings with and without a colon."""
    return rules.extract_fields(views.resumes(spark, sf_dir), RESUME_FIELDS, key_col="c_custkey").drop("matches")


@query("extract_sections_resumes", """
WITH s AS (
  SELECT c_custkey, unnest([1, 2, 3, 4, 5]) AS section_no,
         unnest([NULL, 'Professional Summary', 'SKILLS', 'Work Experience', 'Certifications']) AS heading,
         unnest(['Name: ' || c_name || '\nContact: nation ' || c_nationkey || '\n',
                 'Active in ' || lower(c_mktsegment) || '.\nBalance kept over the years.\n',
                 '- ledger no. ' || c_custkey || '\n- bookkeeping',
                 'clerk, nation ' || c_nationkey || '\n\nsenior clerk' || CASE WHEN c_custkey % 2 = 0 THEN '\n' ELSE '' END,
                 'none so far']) AS body
  FROM customer)
SELECT * FROM s WHERE section_no < 5 OR c_custkey % 2 = 0""".replace("\\n", "' || chr(10) || '"))
def q_extract_sections_resumes(spark, sf_dir):
    """Sections under headings with a colon, in capitals, and titles of their own."""
    return rules.extract_sections(views.resumes(spark, sf_dir), key_col="c_custkey", bare=True)


@query("extract_table_cells", f"""
WITH l AS ({_lines_sql('documents', 'doc_id', 'text')}),
     r AS (SELECT doc_id, line_no, string_split(line, '|') AS cells FROM l WHERE contains(line, '|')),
     c AS (SELECT doc_id, line_no, unnest(range(1, len(cells) + 1)) AS col_no, unnest(cells) AS cell0 FROM r)
SELECT doc_id, line_no, col_no, regexp_replace(cell0, {_sql_lit(STRIP_SQL)}, '', 'g') AS cell FROM c""")
def q_extract_table_cells(spark, sf_dir):
    return rules.extract_table_cells(text_docs(spark, sf_dir))


@query("extract_tables", """
WITH c AS (SELECT c_custkey, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS nation, CAST(c_custkey AS VARCHAR) AS account FROM customer)
SELECT c_custkey, unnest([1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2]) AS table_no, unnest([1, 1, 1, 2, 2, 2, 2, 1, 1, 2, 2]) AS row_no,
       unnest([1, 2, 3, 1, 2, 3, 4, 1, 2, 1, 2]) AS col_no,
       unnest(['Account', 'Segment', 'Note', 'Account', 'Segment', 'Note', 'col_4', 'col_1', 'col_2', 'col_1', 'col_2']) AS header,
       unnest([account, c_mktsegment, NULL, 'total', nation, 'ok', 'beyond', '1', c_name, '2', c_mktsegment]) AS value FROM c""")
def q_extract_tables(spark, sf_dir):
    """Two tables in one text, ragged lines, one header: records by table, row and column name."""
    return rules.extract_tables(views.statements(spark, sf_dir), key_col="c_custkey")
