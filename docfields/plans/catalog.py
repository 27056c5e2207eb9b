"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession

from docfields.plans.registry import REGISTRY, Entry

_MODULES = ["q_documents", "q_results", "q_profile", "q_regression", "q_streaming"]


def registry() -> dict[str, Entry]:
    for m in _MODULES:
        try:
            importlib.import_module(f"docfields.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"docfields.plans.{m}":
                raise
    return dict(REGISTRY)


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def normalised_sql(entries: dict[str, Entry], probe_dir: str) -> dict[str, str]:
    """Oracle SQL with the same output normalisation as the Spark side:
    integers as BIGINT, floating/decimal columns as DOUBLE rounded to the
    query's digits. Column types come from DuckDB's DESCRIBE (binding only)."""
    sqls = {n: e.sql for n, e in entries.items() if e.sql}
    try:
        import duckdb
        from docfields.sources.tables import TABLES
    except ImportError:
        return sqls
    if not os.path.isdir(probe_dir):
        return sqls
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{probe_dir}/{t}.parquet')")
    out = {}
    for n, sql in sqls.items():
        try:
            desc = con.execute(f"DESCRIBE {sql}").fetchall()
        except Exception:  # noqa: BLE001 - leave the SQL as written
            out[n] = sql
            continue
        digits = entries[n].digits
        cols = []
        for name, typ, *_ in desc:
            q = _quote(name)
            t = typ.upper()
            if t in ("DOUBLE", "FLOAT", "REAL") or t.startswith("DECIMAL"):
                cols.append(f"round(CAST({q} AS DOUBLE), {digits}) AS {q}")
            elif t in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT",
                       "UINTEGER", "UBIGINT"):
                cols.append(f"CAST({q} AS BIGINT) AS {q}")
            else:
                cols.append(q)
        out[n] = f"SELECT {', '.join(cols)} FROM (\n{sql}\n) AS oracle_q"
    con.close()
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docfields.functions.text import parse_instructions
    from docfields.operators.rules import extract_rules
    from docfields.session import spread
    from docfields.sources.tables import read_table
    fields = parse_instructions("email, ip, token, license")
    return extract_rules(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), fields)
