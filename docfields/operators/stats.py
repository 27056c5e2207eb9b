"""Run statistics over a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour.
STATUS_SUCCESS = "SUCCESS"
STATUS_FAILED = "FAILED"
# ---------------------------------------------------------------------------


def run_stats(runs: DataFrame, status_col: str = "status", duration_col: str = "duration",
              count_col: str | None = None) -> DataFrame:
    """Per status: documents, total duration and mean per document (0 when none).

    ``status_col`` may be a boolean success flag (mapped to SUCCESS/FAILED)
    or a status text. ``count_col`` counts documents per row (default 1).
    """
    dtype = dict(runs.dtypes)[status_col]
    status = (F.when(F.col(status_col), F.lit(STATUS_SUCCESS)).otherwise(F.lit(STATUS_FAILED))
              if dtype == "boolean" else F.col(status_col))
    n = F.col(count_col) if count_col else F.lit(1)
    agg = (runs.select(status.alias("status"), n.alias("_n"), F.col(duration_col).alias("_d"))
               .groupBy("status")
               .agg(F.sum("_n").cast("bigint").alias("n_documents"), F.sum("_d").alias("total_duration")))
    return agg.withColumn("mean_duration",
                          F.coalesce(F.try_divide(F.col("total_duration"), F.col("n_documents")), F.lit(0.0)))


def batch_counts(results: DataFrame, error_col: str = "error") -> DataFrame:
    """Processed / succeeded / failed totals (one global aggregate)."""
    return results.agg(F.count(F.lit(1)).alias("processed"),
                       F.count_if(F.col(error_col).isNull()).alias("succeeded"),
                       F.count_if(F.col(error_col).isNotNull()).alias("failed"))


def progress_metrics(results: DataFrame, name: str = "batch_progress",
                     error_col: str = "error") -> tuple[DataFrame, Observation]:
    """Attach live counters to a batch; they are filled by the job that writes it.

    Returns the observed frame and the ``Observation`` whose ``get`` gives
    ``processed``/``succeeded``/``failed`` after the action — no second pass.
    """
    obs = Observation(name)
    observed = results.observe(obs, F.count(F.lit(1)).alias("processed"),
                               F.count_if(F.col(error_col).isNull()).alias("succeeded"),
                               F.count_if(F.col(error_col).isNotNull()).alias("failed"))
    return observed, obs


def field_fill_rate(long_df: DataFrame, field_col: str = "field", value_col: str = "value",
                    confidence_col: str = "confidence") -> DataFrame:
    """Per requested field: rows, found, not found and mean confidence."""
    return long_df.groupBy(field_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(value_col).isNotNull()).alias("n_found"),
        F.count_if(F.col(value_col).isNull()).alias("n_not_found"),
        F.avg(confidence_col).alias("mean_confidence"))


def ledger_progress(spark: SparkSession, ledger: str, total: int) -> DataFrame:
    """How far a run with a ledger (:func:`docfields.operators.model_stage.resumable_extract`)
    has come, also while it runs: ``n_total, n_done, n_failed, n_attempts,
    share``. Blocks of answers are there as soon as they are finished; the
    listing is taken anew by each call."""
    schema = "_mark string, error string, attempts int"
    done = spark.read.schema(schema).parquet(ledger).groupBy("_mark").agg(F.min("error").alias("error"), F.max("attempts").alias("attempts"))
    return done.agg(F.lit(total).cast("bigint").alias("n_total"), F.count(F.lit(1)).alias("n_done"),
                    F.count("error").alias("n_failed"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("n_attempts")) \
               .withColumn("share", F.try_divide(F.col("n_done"), F.col("n_total")))
