import duckdb
import pandas as pd

import __spark_entry__ as se
from docfields.sources.tables import TABLES
from tests.conftest import SF_SMALL

FAST = ["assemble_text", "extract_rules", "parse_response", "describe_all", "fit_two_features", "predict_fare",
        "union_columns", "batch_extract", "split_instructions", "corr_matrix"]


def test_entry_smoke(spark):
    df = se.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["doc_id", "ordinal", "field", "value", "n_matches", "confidence"]


def test_registry_consistent():
    q, sql = se.queries(), se.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 80


def _norm(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, float) and x != x:
        return None
    if hasattr(x, "item") and not hasattr(x, "__len__"):
        return x.item()
    return x


def _canon(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].astype(object).itertuples(index=False, name=None)]
    return cols, sorted(rows, key=repr)


def test_oracle_parity_small(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    q, sql = se.queries(), se.oracle_sql()
    for name in FAST:
        a = q[name](spark, SF_SMALL).toPandas()
        b = con.sql(sql[name]).df()
        assert _canon(a) == _canon(b), name
