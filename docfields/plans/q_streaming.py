"""Registered queries: streaming runs over the documents table."""

from __future__ import annotations

from docfields.operators import model_stage as ms
from docfields.plans.q_documents import RULE_FIELDS, RULES_LONG_SQL
from docfields.plans.q_results import MODEL_INSTRUCTIONS, PROVIDER, RUN_TS, _batch_sql, responder
from docfields.plans.registry import query
from docfields.session import scratch_path
from docfields.sources.tables import read_table
from docfields.streaming.extract_stream import read_document_stream, stream_extract_rules, stream_foreach_batch


def _stream(spark, sf_dir):
    """The documents table as a stream, be it one file or a folder of parts. A
    stream's folder cannot be a file, but a pattern may name either; this one
    names the table only."""
    schema = read_table(spark, sf_dir, "documents").schema
    return read_document_stream(spark, f"{sf_dir.rstrip('/')}/documents.parque[t]", schema)


@query("stream_extract_rules", RULES_LONG_SQL)
def q_stream_extract_rules(spark, sf_dir):
    """The documents file consumed as a stream; rules extracted per micro-batch."""
    sink, ck = scratch_path(spark, "stream-rules"), scratch_path(spark, "stream-rules-ck")
    q = stream_extract_rules(_stream(spark, sf_dir), RULE_FIELDS, sink, ck)
    q.awaitTermination()
    return spark.read.parquet(sink)


@query("stream_batch_extract", _batch_sql())
def q_stream_batch_extract(spark, sf_dir):
    """The model-stage batch run per micro-batch through ``foreachBatch``."""
    sink, ck = scratch_path(spark, "stream-batch"), scratch_path(spark, "stream-batch-ck")

    def transform(df):
        return ms.batch_extract(df, responder, MODEL_INSTRUCTIONS, provider=PROVIDER, run_ts=RUN_TS,
                                persist_stage=False, wait_s=0.0)
    q = stream_foreach_batch(_stream(spark, sf_dir), transform, sink, ck)
    q.awaitTermination()
    return spark.read.parquet(sink).drop("batch_id")
