"""Strict JSON check (Python ``json.loads`` semantics) as an Arrow-batched UDF.

No native Spark function rejects trailing text after a JSON value, so the
strict check runs in a pandas UDF; its output ``canonical`` text is then
parsed natively with ``try_parse_json`` (JSON nested beyond the native
parser's depth limit becomes an error row instead of a failed job).
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRICT_SCHEMA = T.StructType([
    T.StructField("ok", T.BooleanType()),
    T.StructField("kind", T.StringType()),
    T.StructField("canonical", T.StringType()),
])


_LONE_SURROGATE = re.compile("[\ud800-\udfff]")


def utf8_safe(text: str | None) -> str | None:
    """Text that Arrow can hand to Spark: lone UTF-16 surrogates (a JSON
    escape such as ``\\ud800`` parses into one) become U+FFFD; without this one
    such value fails the whole task."""
    if text is None:
        return None
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return _LONE_SURROGATE.sub("\ufffd", text)


def json_kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list):
        return "array"
    return "object"


def _keep_constant(name: str) -> str:
    # NaN / Infinity / -Infinity are accepted like Python does, kept as text
    return name


def _finite_float(text: str):
    # a number too large for a double (e.g. 1E400) is Python's inf: kept as
    # text like the constants, so the canonical form stays valid JSON
    f = float(text)
    if math.isfinite(f):
        return f
    return "Infinity" if f > 0 else "-Infinity"


def _exact_int(text: str):
    # integers beyond the native decimal keep their digits as text
    return int(text) if len(text.lstrip("-")) <= 38 else text


def strict_parse(text: str | None, strip_fences: bool = False) -> tuple[bool | None, str | None, str | None]:
    """``(ok, kind, canonical)`` for one response text; null in -> nulls out."""
    if text is None:
        return None, None, None
    if strip_fences:
        t = text.strip()
        if t.startswith("```"):
            t = t.split("\n", 1)[1] if "\n" in t else ""
            if t.rstrip().endswith("```"):
                t = t.rstrip()[:-3]
        text = t
    try:
        value = json.loads(text, parse_constant=_keep_constant, parse_float=_finite_float,
                           parse_int=_exact_int)
    except (ValueError, RecursionError):
        return False, None, None
    canonical = json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    return True, json_kind(value), utf8_safe(canonical)


def strict_json_udf(strip_fences: bool = False):
    @F.pandas_udf(STRICT_SCHEMA)
    def strict_json(s: pd.Series) -> pd.DataFrame:
        rows = [strict_parse(x, strip_fences) for x in s]
        return pd.DataFrame(rows, columns=["ok", "kind", "canonical"])
    # Marked non-deterministic only to pin it in the plan: otherwise a later
    # filter on ``kind``/``ok`` is pushed below a repartition with its own copy
    # of the UDF, and every response goes through Python twice.
    return strict_json.asNondeterministic()


strict_json = strict_json_udf(False)
