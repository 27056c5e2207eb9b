"""Result sinks and read-back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfields.operators.results import PROVIDER_COLUMN, TIMESTAMP_COLUMN


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Header CSV, UTF-8, no index column; one file per task."""
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def sink_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines, one object per result row."""
    df.write.mode(mode).json(path)
    return path


def to_json_rows(df: DataFrame, key_col: str = "source_file") -> DataFrame:
    """Each result row as one JSON object text (the dict form)."""
    return df.select(F.col(key_col), F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json"))


def sink_results(df: DataFrame, path: str, include_timestamp: bool = True, include_confidence: bool = True,
                 mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """Consolidated results of a batch as one parquet dataset.

    ``include_timestamp`` / ``include_confidence`` are projection flags.
    """
    # a score belongs to a field of the table; a field may itself end in "_confidence"
    scores = {f"{c}_confidence" for c in df.columns}
    cols = [c for c in df.columns
            if (include_timestamp or c != TIMESTAMP_COLUMN)
            and (include_confidence or c not in scores)]
    w = df.select(*cols).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_back_results(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Re-read written results with an explicit schema (nothing re-inferred)."""
    r = spark.read.schema(schema)
    if fmt == "csv":
        return r.option("header", True).csv(path)
    if fmt == "json":
        return r.json(path)
    return r.parquet(path)


__all__ = ["sink_csv", "sink_json", "sink_results", "read_back_results", "to_json_rows", "PROVIDER_COLUMN"]
