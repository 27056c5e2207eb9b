"""Registered queries: model stage, response parsing/shaping, scalar functions, run stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.functions import text as tx
from docfields.operators import model_stage as ms, results as rs, stats
from docfields.operators.batch import extract_files
from docfields.operators.rules import RULES
from docfields.plans import views
from docfields.plans.q_documents import (RULES_LONG_SQL, RULES_WIDE_SQL, STRIP_SQL, TRIPS_SQL, _sql_lit, docs,
                                         rules_long, rules_wide, text_docs, write_document_files)
from docfields.plans.registry import query
from docfields.plans.responder import RegexResponder
from docfields.session import scratch_path
from docfields.sources import readers, sinks
from docfields.sources.tables import read_table

RESPONSES_SQL = """responses AS (SELECT event_id, CASE
  WHEN event_id % 10 = 0 THEN concat(props, ' trailing')
  WHEN event_id % 10 = 1 THEN '[1, 2]'
  WHEN event_id % 10 = 2 THEN 'null'
  WHEN event_id % 10 = 3 THEN concat('{"value": ', CAST(event_id AS VARCHAR), ', "confidence": 0.5}')
  WHEN event_id % 10 = 4 THEN '{"k": null, "flag": true, "tags": ["a", "b"]}'
  WHEN event_id % 10 = 5 THEN '```json'
  ELSE props END AS response FROM events)"""

KIND_SQL = """CASE WHEN NOT json_valid({r}) THEN NULL ELSE CASE json_type({r})
  WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string'
  WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END END"""

PARSED_SQL = f"""{RESPONSES_SQL},
parsed AS (SELECT event_id, response, json_valid(response) AS ok, {KIND_SQL.format(r='response')} AS kind
           FROM responses)"""

RUN_TS = "2024-01-01T00:00:00"
PROVIDER = "rules"
MODEL_INSTRUCTIONS = "email, ip, token"
MODEL_FIELDS = ["email", "ip", "token"]
CARD_PATTERN = RULES["card"].pattern
REJECT_MESSAGE = "document contains a card number"


def parsed_responses(spark, sf_dir) -> DataFrame:
    r = views.responses(spark, sf_dir).withColumnRenamed("event_id", rs.SOURCE_COLUMN)
    return rs.parse_response(r)


# ---------------------------------------------------------------- parsing / shaping

@query("parse_response", f"""WITH {PARSED_SQL}
SELECT event_id, ok, kind, CASE WHEN NOT ok THEN 'Failed to parse extraction result' END AS error,
       CASE WHEN NOT ok THEN response END AS raw_response FROM parsed""")
def q_parse_response(spark, sf_dir):
    p = rs.parse_response(views.responses(spark, sf_dir))
    return p.select("event_id", "ok", "kind", "error", "raw_response")


@query("response_shape", f"""WITH {PARSED_SQL}
SELECT event_id, coalesce(kind = 'object', false) AS is_object,
       CASE WHEN NOT ok THEN 'Failed to parse extraction result'
            WHEN kind <> 'object' THEN 'response is not a JSON object: ' || kind END AS error FROM parsed""")
def q_response_shape(spark, sf_dir):
    p = rs.response_shape(rs.parse_response(views.responses(spark, sf_dir)))
    return p.select("event_id", "is_object", "error")


def _field_sql(r: str, key: str) -> tuple[str, str]:
    path = f"'$.\"' || {key} || '\"'"
    value = (f"CASE WHEN json_type({r}, {path}) IN ('OBJECT', 'ARRAY') THEN CAST(json_extract({r}, {path}) AS VARCHAR) "
             f"ELSE json_extract_string({r}, {path}) END")
    vtype = (f"CASE json_type({r}, {path}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' "
             f"WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END")
    return value, vtype


_V, _T = _field_sql("response", "field")
EXPLODED_SQL = f"""{PARSED_SQL},
keys AS (SELECT event_id, response, unnest(json_keys(response)) AS field FROM parsed WHERE kind = 'object'),
exploded AS (SELECT event_id AS source_file, field, {_V} AS value, {_T} AS value_type FROM keys)"""


@query("explode_result", f"WITH {EXPLODED_SQL} SELECT * FROM exploded")
def q_explode_result(spark, sf_dir):
    return rs.explode_result(parsed_responses(spark, sf_dir))


@query("format_values", f"""WITH {EXPLODED_SQL}
SELECT *, CASE WHEN value_type = 'null' OR value IS NULL THEN 'N/A'
               WHEN value_type = 'boolean' THEN CASE WHEN value = 'true' THEN 'Yes' ELSE 'No' END
               WHEN value_type IN ('array', 'object') THEN value
               ELSE regexp_replace(value, {_sql_lit(STRIP_SQL)}, '', 'g') END AS formatted FROM exploded""")
def q_format_values(spark, sf_dir):
    return rs.format_values(rs.explode_result(parsed_responses(spark, sf_dir)))


@query("unnest_confidence", f"""WITH {PARSED_SQL},
u AS (SELECT event_id, CASE WHEN ok THEN json_extract_string(response, '$.value') END AS item_value,
             CASE WHEN ok THEN TRY_CAST(json_extract_string(response, '$.confidence') AS DOUBLE) END AS c FROM parsed)
SELECT event_id, item_value, CASE WHEN c >= 0 AND c <= 1 THEN c END AS confidence FROM u""")
def q_unnest_confidence(spark, sf_dir):
    p = rs.unnest_confidence(rs.parse_response(views.responses(spark, sf_dir)))
    return p.select("event_id", "item_value", "confidence")


RESULT_FIELDS = ["confidence", "flag", "k", "tags", "value"]


def _wide_sql(where: str, extra: str = "") -> str:
    cols = []
    for f in RESULT_FIELDS:
        v, _ = _field_sql("response", f"'{f}'")
        cols.append(f"CASE WHEN kind = 'object' THEN {v} END AS {f}")
    return f"WITH {PARSED_SQL} SELECT event_id AS source_file, {', '.join(cols)}{extra} FROM parsed {where}"


@query("to_row", _wide_sql("WHERE kind = 'object'"))
def q_to_row(spark, sf_dir):
    """Object responses as wide rows over the discovered key union."""
    return rs.to_row(parsed_responses(spark, sf_dir))


@query("union_columns", _wide_sql("", """, CASE WHEN NOT ok THEN 'Failed to parse extraction result'
            WHEN kind <> 'object' THEN 'response is not a JSON object: ' || kind END AS error"""))
def q_union_columns(spark, sf_dir):
    """Every response (objects and error rows) over the key union; absent keys null."""
    p = rs.response_shape(parsed_responses(spark, sf_dir))
    return rs.union_columns(p, keep=["error"])


@query("result_schema")
def q_result_schema(spark, sf_dir):
    """Merged schema of a batch of object responses (VARIANT schema text)."""
    return rs.result_schema(parsed_responses(spark, sf_dir))


@query("result_types", f"""WITH {PARSED_SQL},
v AS (SELECT regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer'
             WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' ELSE lower(t.type) END AS k
      FROM (SELECT response FROM parsed WHERE kind = 'object') o, json_tree(CAST(o.response AS JSON)) t),
m AS (SELECT path, list_sort(list(DISTINCT k) FILTER (k <> 'null')) AS ks, bool_or(k = 'null') AS nullable, count(*) AS n_values FROM v GROUP BY path)
SELECT path, CASE WHEN ks IS NULL THEN 'null' WHEN len(ks) = 1 THEN ks[1] WHEN ks = ['integer', 'number'] THEN 'number' ELSE 'mixed' END AS type,
       nullable, n_values FROM m""")
def q_result_types(spark, sf_dir):
    """Every path of the object responses with its merged type."""
    return rs.result_types(parsed_responses(spark, sf_dir))


@query("tag_source", f"""WITH {PARSED_SQL}
SELECT 'events/' || event_id || '.json' AS source_file, ok, kind FROM parsed""")
def q_tag_source(spark, sf_dir):
    p = rs.parse_response(views.responses(spark, sf_dir))
    p = rs.tag_source(p, F.concat(F.lit("events/"), F.col("event_id").cast("string"), F.lit(".json")))
    return p.select(rs.SOURCE_COLUMN, "ok", "kind")


@query("with_run_metadata", RULES_WIDE_SQL.replace(
    " FROM documents", f", '{RUN_TS}' AS extraction_timestamp, '{PROVIDER}' AS provider FROM documents"))
def q_with_run_metadata(spark, sf_dir):
    return rs.with_run_metadata(rules_wide(spark, sf_dir), PROVIDER, RUN_TS)


@query("output_name", r"""
SELECT page_id, 'extracted_' || regexp_replace(string_split(url, '/')[-1], '^(.+)[.][^.]*$', '\1') || '.csv'
       AS output_name FROM pages""")
def q_output_name(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", tx.output_name(F.col("url")).alias("output_name"))


# ---------------------------------------------------------------- model stage

def _json_item(f: str) -> str:
    r = RULES[f]
    v = f"regexp_extract(text, {_sql_lit(r.pattern)}, {r.group})"
    found = f"regexp_matches(text, {_sql_lit(r.pattern)})"
    return (f"'\"{f}\": {{\"value\": ' || CASE WHEN {found} THEN '\"' || {v} || '\"' ELSE 'null' END"
            f" || ', \"confidence\": ' || CASE WHEN {found} THEN '1.0' ELSE '0.0' END || '}}'")


RESPONSE_SQL = "'{' || " + " || ', ' || ".join(_json_item(f) for f in MODEL_FIELDS) + " || '}'"


@query("extract_with_model", f"""
SELECT doc_id, {RESPONSE_SQL} AS raw_response, CAST(NULL AS VARCHAR) AS error, 1 AS attempts,
       true AS ok, 'object' AS kind FROM documents""")
def q_extract_with_model(spark, sf_dir):
    """Caller-supplied extractor per document (a deterministic rule responder here)."""
    staged = ms.extract_with_model(text_docs(spark, sf_dir), RegexResponder, MODEL_INSTRUCTIONS)
    return staged.select("doc_id", "raw_response", "error", "attempts", "ok", "kind")


def _batch_sql(where: str = "") -> str:
    card = f"regexp_matches(text, {_sql_lit(CARD_PATTERN)})"
    cols = []
    for f in MODEL_FIELDS:
        r = RULES[f]
        v = f"regexp_extract(text, {_sql_lit(r.pattern)}, {r.group})"
        found = f"regexp_matches(text, {_sql_lit(r.pattern)})"
        cols.append(f"CASE WHEN {card} THEN NULL WHEN {found} THEN {v} END AS {f}")
        cols.append(f"CASE WHEN {card} THEN NULL WHEN {found} THEN 1.0 ELSE 0.0 END AS {f}_confidence")
    return (f"SELECT doc_id AS source_file, {', '.join(cols)}, "
            f"CASE WHEN {card} THEN '{REJECT_MESSAGE}' END AS error, CAST(NULL AS VARCHAR) AS raw_response, "
            f"'{RUN_TS}' AS extraction_timestamp, '{PROVIDER}' AS provider FROM documents {where}")


def responder():
    return RegexResponder(reject_pattern=CARD_PATTERN, reject_message=REJECT_MESSAGE)


def batch(spark, sf_dir) -> DataFrame:
    return ms.batch_extract(text_docs(spark, sf_dir), responder, MODEL_INSTRUCTIONS, provider=PROVIDER, run_ts=RUN_TS,
                            wait_s=0.0)


@query("batch_extract", _batch_sql())
def q_batch_extract(spark, sf_dir):
    """Whole batch, one row per document; card-bearing documents fail alone."""
    return batch(spark, sf_dir)


@query("batch_extract_resumed", _batch_sql())
def q_batch_extract_resumed(spark, sf_dir):
    """A batch started again: a first run has answered some documents, the second
    asks for the others and returns one row for each."""
    ledger = scratch_path(spark, "ledger")
    d = text_docs(spark, sf_dir)
    ms.resumable_extract(d.where("doc_id % 3 = 0"), responder, MODEL_INSTRUCTIONS, ledger, wait_s=0.0)
    return ms.batch_extract(d, responder, MODEL_INSTRUCTIONS, provider=PROVIDER, run_ts=RUN_TS, wait_s=0.0, ledger=ledger)


@query("ledger_progress", f"""
WITH d AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 1 END AS done, regexp_matches(text, {_sql_lit(CARD_PATTERN)}) AS card FROM documents)
SELECT count(*) AS n_total, count(done) AS n_done, count(done) FILTER (card) AS n_failed,
       CAST(coalesce(sum(CASE WHEN card THEN 3 ELSE 1 END) FILTER (done = 1), 0) AS BIGINT) AS n_attempts, count(done) / count(*) AS share FROM d""")
def q_ledger_progress(spark, sf_dir):
    """How far a batch has come that was stopped after some documents."""
    ledger = scratch_path(spark, "ledger")
    d = text_docs(spark, sf_dir)
    ms.resumable_extract(d.where("doc_id % 3 = 0"), responder, MODEL_INSTRUCTIONS, ledger, wait_s=0.0)
    return stats.ledger_progress(spark, ledger, d.count())


class TroubledResponder(RegexResponder):
    """Answers by the text's length: nothing, no text, bad JSON, an exception, or a result."""

    def __call__(self, text: str, instructions: str):
        kind = len(text) % 5
        if kind == 3:
            raise ValueError("extractor failed")
        return {0: None, 1: {"email": "x"}, 2: '{"email": '}.get(kind) if kind < 3 else super().__call__(text, instructions)


class RecoveringResponder(RegexResponder):
    """Fails on the first call for each text of odd length, then answers."""

    def __init__(self):
        super().__init__()
        self.failed = set()

    def __call__(self, text: str, instructions: str) -> str:
        if len(text) % 2 and text not in self.failed:
            self.failed.add(text)
            raise ConnectionError("try again")
        return super().__call__(text, instructions)


def _files_sql() -> str:
    cols = []
    for f in MODEL_FIELDS:
        r = RULES[f]
        v, found = f"regexp_extract(t, {_sql_lit(r.pattern)}, {r.group})", f"regexp_matches(t, {_sql_lit(r.pattern)})"
        cols.append(f"CASE WHEN kind = 4 AND {found} THEN {v} END AS {f}")
        cols.append(f"CASE WHEN kind = 4 THEN CASE WHEN {found} THEN 1.0 ELSE 0.0 END END AS {f}_confidence")
    return f"""
WITH d AS (SELECT doc_id, chr(10) || '--- Page 1 ---' || chr(10) || text || chr(10) AS t FROM documents),
q AS (SELECT doc_id AS seq, CAST(doc_id AS VARCHAR) AS source_file, t,
             CASE WHEN doc_id % 13 = 0 THEN 5 ELSE length(t) % 5 END AS kind FROM d
      UNION ALL SELECT doc_id + 1000000, 'no-' || doc_id, '', 6 FROM documents WHERE doc_id % 10 = 0
      UNION ALL SELECT doc_id + 2000000, CAST(doc_id AS VARCHAR), t,
             CASE WHEN doc_id % 13 = 0 THEN 5 ELSE length(t) % 5 END FROM d WHERE doc_id % 25 = 0)
SELECT seq, source_file, {', '.join(cols)},
       CASE kind WHEN 0 THEN 'extractor returned NoneType instead of text' WHEN 1 THEN 'extractor returned dict instead of text'
            WHEN 2 THEN 'Failed to parse extraction result' WHEN 3 THEN 'extractor failed'
            WHEN 5 THEN 'file is not valid UTF-8 text' WHEN 6 THEN 'PDF file not found: ' || source_file END AS error,
       CASE WHEN kind = 2 THEN '{{"email": ' END AS raw_response,
       '{RUN_TS}' AS extraction_timestamp, '{PROVIDER}' AS provider FROM q"""


@query("extract_files", _files_sql())
def q_extract_files(spark, sf_dir):
    """Files to results: every document's file, one in thirteen with a bad byte;
    requests for missing files, some requests twice; an extractor that fails in every way."""
    root = write_document_files(spark, sf_dir)
    name = lambda c: F.regexp_extract(c, r"doc_id=([0-9]+)", 1)
    files = readers.scan_documents(spark, root, glob="*.txt", with_content=True)
    bad = F.concat(F.col("content"), F.unhex(F.lit("FF")))
    files = files.withColumn("content", F.when(name(F.col("path")).cast("bigint") % 13 == 0, bad).otherwise(F.col("content")))
    d = docs(spark, sf_dir).select("doc_id")
    key = F.col("doc_id").cast("string")
    requests = (d.select(F.col("doc_id").alias("seq"), key.alias("path"))
                .union(d.where("doc_id % 10 = 0").select(F.col("doc_id") + 1000000, F.concat(F.lit("no-"), key)))
                .union(d.where("doc_id % 25 = 0").select(F.col("doc_id") + 2000000, key)))
    return extract_files(requests, files, TroubledResponder, MODEL_INSTRUCTIONS, name_of=name, provider=PROVIDER,
                         run_ts=RUN_TS, wait_s=0.0)


@query("retry_recovers", f"""
SELECT doc_id, CAST(1 + length(text) % 2 AS BIGINT) AS attempts, CAST(NULL AS VARCHAR) AS error, {RESPONSE_SQL} AS raw_response
FROM (SELECT DISTINCT ON (text) * FROM documents ORDER BY text, doc_id) AS u""")
def q_retry_recovers(spark, sf_dir):
    """A transient error is tried again and leaves no trace but the attempt (one document of each text)."""
    d = docs(spark, sf_dir).groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    return (ms.extract_with_model(d, RecoveringResponder, MODEL_INSTRUCTIONS, wait_s=0.0)
              .select("doc_id", "attempts", "error", "raw_response"))


# Shapes that a batch of answers can have besides: keys that clash, long integers, no answer.
SHAPES = [None, '{"error": "e", "k": 1, "K": 2, "x_confidence": 0.5, "n": 1234567890123456789012345678901234567890123}',
          '{"k": "only"}', "not json"]


@query("union_columns_shapes", """
WITH s AS (SELECT event_id, event_id % 4 AS kind FROM events)
SELECT event_id AS source_file, CASE kind WHEN 1 THEN '2' END AS "K", CASE kind WHEN 1 THEN '1' WHEN 2 THEN 'only' END AS k_2,
       CASE kind WHEN 1 THEN '1234567890123456789012345678901234567890123' END AS n, CASE kind WHEN 1 THEN '0.5' END AS x_confidence,
       CASE kind WHEN 0 THEN 'no response' WHEN 3 THEN 'Failed to parse extraction result' END AS error FROM s""")
def q_union_columns_shapes(spark, sf_dir):
    """Metadata wins over a key of its name, keys that differ in case both stay, long integers keep their digits."""
    e = read_table(spark, sf_dir, "events").select(F.col("event_id").alias(rs.SOURCE_COLUMN))
    shapes = F.array(*[F.lit(x) for x in SHAPES])
    r = e.withColumn("response", F.get(shapes, (F.col(rs.SOURCE_COLUMN) % 4).cast("int")))
    return rs.union_columns(rs.response_shape(rs.parse_response(r)), keep=["error"])


# Single-document mode on the stress case of the published latency table: the
# longest document (ties: smallest id), found by a scalar subquery over the
# whole table; the key filter then sits before the Python stage.
SINGLE_SQL = "WHERE doc_id = (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1)"


def longest_document(d: DataFrame):
    return d.agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), F.col("doc_id")))).scalar()


@query("single_extract", _batch_sql(SINGLE_SQL))
def q_single_extract(spark, sf_dir):
    d = docs(spark, sf_dir)
    return ms.single_extract(d, longest_document(d), responder, MODEL_INSTRUCTIONS, provider=PROVIDER,
                             run_ts=RUN_TS, wait_s=0.0)


def _json_text(expr: str) -> str:
    """A JSON string as the sink writes it (the fields here hold no marks to escape)."""
    return f"""'"' || {expr} || '"'"""


def _dict_sql() -> str:
    columns = ["source_file", *[c for f in MODEL_FIELDS for c in (f, f"{f}_confidence")], "error", "extraction_timestamp", "provider"]
    members = []
    for c in columns:
        value = f"CAST({c} AS VARCHAR)" if c == "source_file" or c.endswith("_confidence") else _json_text(c)
        members.append(f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\":' || {value} END")
    return f"SELECT source_file, '{{' || concat_ws(',', {', '.join(members)}) || '}}' AS json FROM ({_batch_sql(SINGLE_SQL)})"


@query("single_extract_dict", _dict_sql())
def q_single_extract_dict(spark, sf_dir):
    """The dict form of a single extraction: the row as one JSON object."""
    return sinks.to_json_rows(q_single_extract(spark, sf_dir))


@query("retry_policy", f"""
SELECT doc_id, CASE WHEN regexp_matches(text, {_sql_lit(CARD_PATTERN)}) THEN 3 ELSE 1 END AS attempts,
       CASE WHEN regexp_matches(text, {_sql_lit(CARD_PATTERN)}) THEN '{REJECT_MESSAGE}' END AS error FROM documents""")
def q_retry_policy(spark, sf_dir):
    """Bounded attempts: card documents fail on every call and are retried up
    to the limit (3) before their error row is emitted; others succeed at once."""
    staged = ms.extract_with_model(text_docs(spark, sf_dir), responder, MODEL_INSTRUCTIONS,
                                   max_attempts=ms.RETRY_ATTEMPTS, wait_s=0.0)
    return staged.select("doc_id", "attempts", "error")


# ---------------------------------------------------------------- scalar functions

@query("strip_text", f"SELECT doc_id, regexp_replace(text, {_sql_lit(STRIP_SQL)}, '', 'g') AS stripped FROM documents")
def q_strip_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.strip_text("text").alias("stripped"))


@query("truncate_text", """
SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS truncated FROM documents""")
def q_truncate_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.truncate_text("text").alias("truncated"))


TOKEN = RULES["token"]


@query("mask_secret", f"""
WITH t AS (SELECT doc_id, unnest(range(1, len(regexp_extract_all(text, {_sql_lit(TOKEN.pattern)}, 1)) + 1)) AS ordinal,
                  unnest(regexp_extract_all(text, {_sql_lit(TOKEN.pattern)}, 1)) AS tok FROM documents)
SELECT doc_id, ordinal, left(tok, 10) || '...' || right(tok, 10) AS masked FROM t""")
def q_mask_secret(spark, sf_dir):
    t = text_docs(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN.pattern), 1))
                                   .alias("_i", "tok"))
    return t.select("doc_id", (F.col("_i") + 1).alias("ordinal"), tx.mask_secret("tok").alias("masked"))


@query("format_timestamp", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN ''
       ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END AS iso FROM events""")
def q_format_timestamp(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", tx.format_timestamp("ts").alias("iso"))


KEY_SQL = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("format_currency", f"WITH {TRIPS_SQL} SELECT {KEY_SQL}, printf('$%.2f', FARE) AS FARE_text FROM trips")
def q_format_currency(spark, sf_dir):
    return views.trips(spark, sf_dir).select(*views.TRIP_KEY, tx.format_currency("FARE").alias("FARE_text"))


@query("format_decimal2", f"""WITH {TRIPS_SQL}
SELECT {KEY_SQL}, printf('%.2f', TRIP_SECONDS / 60) AS TRIP_MINUTES_text FROM trips""")
def q_format_decimal2(spark, sf_dir):
    t = views.trips(spark, sf_dir)
    return t.select(*views.TRIP_KEY, tx.format_decimal2(F.col("TRIP_SECONDS") / F.lit(60.0)).alias("TRIP_MINUTES_text"))


@query("abs_error", f"""WITH {TRIPS_SQL}
SELECT {KEY_SQL}, abs(FARE - (2.25e0 * TRIP_MILES + 0.12e0 * (TRIP_SECONDS / 60) + 3.25e0)) AS abs_error FROM trips""")
def q_abs_error(spark, sf_dir):
    t = views.trips(spark, sf_dir)
    formula = F.lit(2.25) * F.col("TRIP_MILES") + F.lit(0.12) * (F.col("TRIP_SECONDS") / F.lit(60.0)) + F.lit(3.25)
    return t.select(*views.TRIP_KEY, tx.abs_error("FARE", formula).alias("abs_error"))


# ---------------------------------------------------------------- run statistics

@query("run_stats", """
SELECT event_type AS status, count(*) AS n_documents, sum(value) AS total_duration,
       coalesce(sum(value) / nullif(count(*), 0), 0) AS mean_duration FROM events GROUP BY event_type""")
def q_run_stats(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), F.col("value").alias("duration"))
    return stats.run_stats(e)


BATCH_COUNTS_SQL = f"""
SELECT count(*) AS processed, count_if(NOT regexp_matches(text, {_sql_lit(CARD_PATTERN)})) AS succeeded,
       count_if(regexp_matches(text, {_sql_lit(CARD_PATTERN)})) AS failed FROM documents"""


@query("batch_counts", BATCH_COUNTS_SQL)
def q_batch_counts(spark, sf_dir):
    return stats.batch_counts(batch(spark, sf_dir))


@query("progress_metrics", BATCH_COUNTS_SQL)
def q_progress_metrics(spark, sf_dir):
    """Counters observed while the batch is written (no second pass over it)."""
    observed, obs = stats.progress_metrics(batch(spark, sf_dir))
    observed.write.mode("overwrite").parquet(scratch_path(spark, "progress"))
    m = obs.get
    return spark.createDataFrame([(m["processed"], m["succeeded"], m["failed"])],
                                 "processed bigint, succeeded bigint, failed bigint")


@query("field_fill_rate", f"""WITH l AS ({RULES_LONG_SQL})
SELECT field, count(*) AS n_rows, count_if(value IS NOT NULL) AS n_found, count_if(value IS NULL) AS n_not_found,
       avg(confidence) AS mean_confidence FROM l GROUP BY field""")
def q_field_fill_rate(spark, sf_dir):
    return stats.field_fill_rate(rules_long(spark, sf_dir))
