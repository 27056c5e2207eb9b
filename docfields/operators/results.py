"""Response parsing and result shaping.

Parsed JSON travels as ``VARIANT`` inside a plan and is turned into STRING
columns before a frame leaves it.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions.jsonfn import json_kind, strict_json_udf, utf8_safe
from docfields.functions.text import format_value
from docfields.session import ship_package

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour.
PARSE_ERROR_MESSAGE = "Failed to parse extraction result"
TIMESTAMP_COLUMN = "extraction_timestamp"
PROVIDER_COLUMN = "provider"
SOURCE_COLUMN = "source_file"
# ---------------------------------------------------------------------------
NOT_OBJECT_MESSAGE = "response is not a JSON object: "
TOO_DEEP_MESSAGE = "response is nested too deeply to be represented"
NO_RESPONSE_MESSAGE = "no response"
METADATA_COLUMNS = (SOURCE_COLUMN, "error", "raw_response", TIMESTAMP_COLUMN, PROVIDER_COLUMN)


def column_names(fields: list[str], taken=()) -> dict[int, str]:
    """Output column by position of ``fields``: names are compared without case,
    as Spark does. ``taken`` names (metadata) win, so such a field has no column;
    an exact repeat has none either; a name that differs in case gets a number."""
    used = {t.lower() for t in taken}
    out: dict[int, str] = {}
    for i, f in enumerate(fields):
        if f in fields[:i] or f.lower() in {t.lower() for t in taken}:
            continue
        name, n = f, 1
        while name.lower() in used:
            n += 1
            name = f"{f}_{n}"
        used.add(name.lower())
        out[i] = name
    return out


def parse_response(df: DataFrame, response_col: str = "response", strip_fences: bool = False) -> DataFrame:
    """Strict JSON parse of a response column.

    Adds ``ok``, ``kind`` (object/array/string/number/boolean/null), ``v``
    (VARIANT, null when not ok), ``error`` and ``raw_response`` (both set only
    on parse failure, as in the reference's error dict).
    """
    ship_package(df.sparkSession)
    s = strict_json_udf(strip_fences)(F.col(response_col))
    out = df.withColumn("_sj", s)
    # no response at all is a failure of its own
    ok = F.coalesce(F.col("_sj.ok"), F.lit(False))
    missing = F.col(response_col).isNull()
    # try_: JSON that Python accepts but the variant cannot hold (nesting
    # beyond the native parser's depth limit) becomes an error row, not a
    # failed job
    return (out.withColumn("ok", ok)
               .withColumn("kind", F.col("_sj.kind"))
               .withColumn("v", F.when(ok, F.try_parse_json(F.col("_sj.canonical"))))
               .withColumn("error", F.when(missing, F.lit(NO_RESPONSE_MESSAGE))
                                     .when(~ok, F.lit(PARSE_ERROR_MESSAGE))
                                     .when(F.col("v").isNull(), F.lit(TOO_DEEP_MESSAGE)))
               .withColumn("raw_response", F.when(~ok, F.col(response_col)))
               .drop("_sj"))


def response_shape(parsed: DataFrame) -> DataFrame:
    """Only a top-level object becomes a result row; any other valid JSON is an
    error row (the reference fails when it tags such a value with its source)."""
    err = F.when(F.col("ok") & (F.col("kind") != "object"),
                 F.concat(F.lit(NOT_OBJECT_MESSAGE), F.col("kind"))).otherwise(F.col("error"))
    return parsed.withColumn("error", err).withColumn("is_object", F.coalesce(F.col("kind") == "object", F.lit(False)))


def value_kind(v: Column) -> Column:
    """Kind of a VARIANT value from ``schema_of_variant``."""
    t = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(None))
             .when(t.startswith("OBJECT"), "object")
             .when(t.startswith("ARRAY"), "array")
             .when(t == "STRING", "string")
             .when(t == "BOOLEAN", "boolean")
             .when(t == "VOID", "null")
             .otherwise("number"))


def variant_text(v: Column) -> Column:
    """Text of a VARIANT: strings unquoted, nested values as compact JSON, JSON null -> null.

    A JSON number written with a zero fraction (``1.0``, ``2500.0``) is a
    float in Python and prints with its ``.0``; ``parse_json`` stores it as
    DECIMAL(p,0) (integers that fit a bigint become BIGINT), so below 1e16,
    where Python still prints positional digits, the ``.0`` is put back.
    """
    t = F.schema_of_variant(v)
    txt = v.cast("string")
    zero_fraction = t.rlike(r"^DECIMAL\(([1-9]|1[0-6]),0\)$")
    # A DOUBLE only comes from exponent notation, where Python prints
    # ``1e+20`` / ``1.5e-07`` and Java ``1.0E20`` / ``1.5E-7``: same digits,
    # rewritten (mantissa without ``.0``, signed exponent of two digits or more).
    sci = r"^(-?[0-9]+(?:[.][0-9]+)?)E(-?)([0-9]+)$"
    mant = F.regexp_replace(F.regexp_extract(txt, sci, 1), r"[.]0$", "")
    exp = F.regexp_extract(txt, sci, 3)
    py_sci = F.concat(mant, F.lit("e"), F.when(F.regexp_extract(txt, sci, 2) == "-", "-").otherwise("+"),
                      F.when(F.length(exp) < 2, F.lpad(exp, 2, "0")).otherwise(exp))  # lpad would cut 3 digits
    return F.when(t != "VOID", F.when(zero_fraction, F.concat(txt, F.lit(".0")))
                                .when((t == "DOUBLE") & txt.rlike(sci), py_sci)
                                .otherwise(txt))


def explode_result(parsed: DataFrame, key_col: str = SOURCE_COLUMN) -> DataFrame:
    """Object responses -> ``(key, field, value, value_type)``, one row per key.

    The object is cast to ``map<string, variant>`` and exploded in place: no
    shuffle; nested values stay as compact JSON text.
    """
    objs = parsed.where(F.col("kind") == "object")
    m = objs.select(F.col(key_col), F.explode(F.col("v").cast("map<string,variant>")).alias("field", "_val"))
    return m.select(key_col, "field", variant_text(F.col("_val")).alias("value"),
                    value_kind(F.col("_val")).alias("value_type"))


def unnest_confidence(df: DataFrame, v_col: str = "v") -> DataFrame:
    """``{"value": ..., "confidence": c}`` items -> ``value`` and ``confidence``.

    Confidence outside 0-1 (or not a number) becomes null.
    """
    v = F.col(v_col)
    conf = F.try_variant_get(v, "$.confidence", "double")
    return (df.withColumn("item_value", F.try_variant_get(v, "$.value", "string"))
              .withColumn("confidence", F.when((conf >= 0) & (conf <= 1), conf)))


def discover_fields(parsed: DataFrame) -> list[str]:
    """Distinct top-level keys over a batch (the union of result columns).

    One aggregate; the distinct key names, which become columns, reach the
    driver. For keys without bound use the long form (:func:`explode_result`) or
    give :func:`union_columns` the fields.
    """
    keys = (parsed.where(F.col("kind") == "object")
                  .select(F.explode(F.map_keys(F.col("v").cast("map<string,variant>"))).alias("k"))
                  .distinct().collect())
    return sorted(r.k for r in keys)


def _path(field: str) -> str:
    if "'" in field or "\\" in field:
        raise ValueError(f"unsupported field name {field!r}")
    return f"$['{field}']"


def field_item(v: Column, field: str) -> Column:
    """Top-level member ``field`` of a VARIANT object (null when absent).

    A path lookup for ordinary names; a name with a quote or backslash (which
    a path literal cannot carry) is looked up in the object as a map."""
    if "'" in field or "\\" in field:
        return v.try_cast("map<string,variant>")[F.lit(field)]
    return F.try_variant_get(v, _path(field), "variant")


def union_columns(parsed: DataFrame, fields: list[str] | None = None, key_col: str = SOURCE_COLUMN,
                  keep: list[str] | None = None) -> DataFrame:
    """One wide row per response over the union of keys (absent -> null).

    Requested ``fields`` come first, other discovered keys follow
    alphabetically; names are made unique by :func:`column_names`. Each response is one row already, so the wide form is a
    projection of variant paths — no pivot shuffle.
    """
    names = list(fields or [])
    if fields is None:
        names = discover_fields(parsed)
    kept = list(keep or [])
    keep = [F.col(c) for c in kept]
    # each path is looked up once; the text is taken from that column
    items = parsed.select(F.col(key_col), *keep,
                          *[field_item(F.col("v"), f).alias(f"_i{i}")
                            for i, f in enumerate(names)])
    unique = column_names(names, [key_col, *kept])
    cols = [variant_text(F.col(f"_i{i}")).alias(f) for i, f in unique.items()]
    return items.select(F.col(key_col).alias(key_col), *cols, *keep)


def to_row(parsed: DataFrame, fields: list[str] | None = None, key_col: str = SOURCE_COLUMN) -> DataFrame:
    """Object responses as wide rows (one per response)."""
    return union_columns(parsed.where(F.col("kind") == "object"), fields, key_col)


def result_schema(parsed: DataFrame) -> DataFrame:
    """Merged schema of all object responses (one row, one aggregate)."""
    return (parsed.where(F.col("kind") == "object")
                  .agg(F.schema_of_variant_agg(F.col("v")).alias("schema"), F.count(F.lit(1)).alias("n_rows")))


def merged_type(kinds: Column) -> Column:
    """The join of value kinds in the lattice null < any kind, integer < number,
    any two others < mixed; ``kinds``: an array."""
    some = F.array_remove(F.array_distinct(kinds), "null")
    plain = F.when(F.array_contains(some, "number"), F.array_remove(some, "integer")).otherwise(some)
    return F.when(F.size(plain) == 0, "null").when(F.size(plain) == 1, F.get(plain, F.lit(0))).otherwise("mixed")


def result_types(parsed: DataFrame, response_col: str = "response") -> DataFrame:
    """The merged type of every path in the object responses: ``path, type,
    nullable, n_values``.

    ``$`` is the response, ``$.a`` a member, ``$.a[]`` the elements of an array;
    kinds that differ between responses are merged (:func:`merged_type`),
    ``nullable`` says that some value is null. A task counts paths and kinds of
    its own responses and hands on the counts, so what is shuffled and merged is
    rows of (path, kind), whatever the number of responses; hot paths are
    counted before they meet.
    """
    ship_package(parsed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(value_kinds(text))
                if len(found) > 100_000:  # keys may be data
                    yield _kind_rows(found)
                    found.clear()
        yield _kind_rows(found)

    objects = parsed.where((F.col("kind") == "object") & F.col(response_col).isNotNull()).select(response_col)
    counts = objects.mapInArrow(run, "path string, value_kind string, n long").groupBy("path", "value_kind").agg(F.sum("n").alias("n"))
    return counts.groupBy("path").agg(
        merged_type(F.sort_array(F.collect_list("value_kind"))).alias("type"),
        F.max(F.col("value_kind") == "null").alias("nullable"), F.sum("n").alias("n_values"))


def _kind_rows(found: Counter) -> pa.RecordBatch:
    paths, kinds = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(list(map(utf8_safe, paths)), pa.string()), pa.array(kinds, pa.string()),
                                       pa.array(list(found.values()), pa.int64())], names=["path", "value_kind", "n"])


def value_kinds(text: str) -> Iterator[tuple[str, str]]:
    """Path and kind of a JSON text's values, at every depth."""
    todo = [("$", json.loads(text))]
    while todo:
        path, value = todo.pop()
        kind = json_kind(value)
        yield path, "integer" if kind == "number" and isinstance(value, int) else kind
        if kind == "object":
            todo += [(f"{path}.{k}" if PLAIN_KEY.fullmatch(k) else f"{path}.{json.dumps(k, ensure_ascii=False)}", v) for k, v in value.items()]
        elif kind == "array":
            todo += [(f"{path}[]", v) for v in value]


#: Keys that a path spells without quotes.
PLAIN_KEY = re.compile("[A-Za-z_][A-Za-z0-9_]*")


def format_values(long_df: DataFrame, value_col: str = "value", type_col: str = "value_type") -> DataFrame:
    """Display text per value: null -> N/A, booleans Yes/No, nested JSON, else stripped."""
    return long_df.withColumn("formatted", format_value(F.col(value_col), F.col(type_col)))


def tag_source(df: DataFrame, source: Column | str) -> DataFrame:
    """Set ``source_file`` (metadata wins over an extracted field of that name)."""
    c = F.col(source) if isinstance(source, str) else source
    return df.withColumn(SOURCE_COLUMN, c)


def with_run_metadata(df: DataFrame, provider: str, run_ts: str | None = None) -> DataFrame:
    """Add ``extraction_timestamp`` (ISO text, fixed for the run) and ``provider``."""
    ts = run_ts or datetime.now().isoformat()
    return df.withColumn(TIMESTAMP_COLUMN, F.lit(ts)).withColumn(PROVIDER_COLUMN, F.lit(provider))
