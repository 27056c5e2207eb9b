from docfields.functions.jsonfn import strict_parse
from docfields.operators import results as rs


def test_strict_parse_vectors():
    assert strict_parse('{"a":1} xyz')[0] is False
    assert strict_parse("```json\n{}\n```")[0] is False
    assert strict_parse('{"a":1,}')[0] is False
    assert strict_parse("")[0] is False
    assert strict_parse("{'a':1}")[0] is False
    ok, kind, canon = strict_parse('{"a":NaN}')
    assert ok and kind == "object" and canon == '{"a":"NaN"}'
    assert strict_parse('{"a":1,"a":2}') == (True, "object", '{"a":2}')
    assert strict_parse("[1,2]")[:2] == (True, "array")
    assert strict_parse("null")[:2] == (True, "null")
    assert strict_parse(' "s" ')[:2] == (True, "string")
    assert strict_parse(None) == (None, None, None)


def test_strip_fences_flag():
    assert strict_parse("```json\n{\"a\": 1}\n```", strip_fences=True)[:2] == (True, "object")


def test_parse_and_shape(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": [1, 2]}, "d": null, "e": true}'), (2, '{"a":1} xyz'),
                                (3, "[1, 2]"), (4, "null")], "source_file long, response string")
    p = rs.response_shape(rs.parse_response(df))
    rows = {r.source_file: r for r in p.select("source_file", "ok", "kind", "error", "raw_response").collect()}
    assert rows[1].ok and rows[1].error is None
    assert rows[2].error == "Failed to parse extraction result" and rows[2].raw_response == '{"a":1} xyz'
    assert rows[3].error == "response is not a JSON object: array"
    assert rows[4].error == "response is not a JSON object: null"
    ex = {(r.field): (r.value, r.value_type) for r in rs.explode_result(p).collect()}
    assert ex == {"a": ("1", "number"), "b": ('{"c":[1,2]}', "object"), "d": (None, "null"), "e": ("true", "boolean")}
    wide = rs.union_columns(p, keep=["error"]).orderBy("source_file").collect()
    assert [r.source_file for r in wide] == [1, 2, 3, 4]
    assert wide[0].a == "1" and wide[1].a is None


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_strict_json_runs_once_under_a_filter(spark):
    """A filter on the parse result must not pull a second copy of the Python
    UDF below the spreading repartition (one Python pass per response)."""
    import __spark_entry__ as se
    from tests.conftest import SF_SMALL
    plan = _plan(se.queries()["explode_result"](spark, SF_SMALL))
    assert plan.count("ArrowEvalPython") == 1, plan


def test_single_extract_key_is_a_pushed_scalar_subquery(spark):
    """The registered single-document query selects its document from the
    data; the key filter reaches the scan before the Python stage."""
    import __spark_entry__ as se
    from tests.conftest import SF_SMALL
    df = se.queries()["single_extract"](spark, SF_SMALL)
    plan = _plan(df)
    assert "ScalarSubquery" in plan or "Subquery" in plan, plan
    assert df.count() == 1


def test_number_overflow_does_not_fail_the_batch(spark):
    """1E400 is valid JSON (Python reads inf); it must become a value, not a
    canonical text that the native parser rejects (which fails the job)."""
    assert strict_parse('{"a": 1E400}') == (True, "object", '{"a":"Infinity"}')
    df = spark.createDataFrame([(1, '{"a": 1E400}'), (2, '{"a": 1.0, "b": 2500.0, "c": 0.5, "d": 7}')],
                               "source_file long, response string")
    rows = {(r.source_file, r.field): r.value for r in rs.explode_result(rs.parse_response(df)).collect()}
    assert rows[(1, "a")] == "Infinity"
    # floats keep Python's text: 1.0 and 2500.0, not 1 and 2500
    assert rows[(2, "a")] == "1.0" and rows[(2, "b")] == "2500.0" and rows[(2, "c")] == "0.5" and rows[(2, "d")] == "7"


def test_exponent_floats_print_like_python(spark):
    vals = [1e20, 1.5e-07, -2.5e-05, 1e300, 1.2345e-120, 3.0e10]
    df = spark.createDataFrame([(i, '{"a": %r}' % v) for i, v in enumerate(vals)], "source_file long, response string")
    got = {r.source_file: r.value for r in rs.explode_result(rs.parse_response(df)).collect()}
    assert [got[i] for i in range(len(vals))] == [str(v) for v in vals]


def test_lone_surrogate_escape_does_not_fail_the_batch(spark):
    df = spark.createDataFrame([(1, '{"a": "\\ud800x"}'), (2, '{"b": "\\u00e9\\ud83d\\ude00"}')],
                               "source_file long, response string")
    rows = {(r.source_file, r.field): r.value for r in rs.explode_result(rs.parse_response(df)).collect()}
    assert rows[(1, "a")] == "�x" and rows[(2, "b")] == "é😀"


def test_deep_nesting_is_an_error_row_not_a_failed_job(spark):
    """Python accepts JSON nested thousands of levels deep; the native parser
    stops near 1,000, so such a response becomes an error row."""
    deep = '{"a": ' + "[" * 5000 + "]" * 5000 + "}"
    df = spark.createDataFrame([(1, deep), (2, '{"a": 1}')], "source_file long, response string")
    p = {r.source_file: r for r in rs.parse_response(df).select("source_file", "ok", "error").collect()}
    assert p[1].ok and p[1].error == rs.TOO_DEEP_MESSAGE and p[2].error is None


def test_keys_with_quotes_and_backslashes(spark):
    """Discovered keys are arbitrary text; a quote or backslash must not stop
    the wide form (a path literal cannot carry them, a map lookup can)."""
    import json
    quote, slash = "it's", "a" + chr(92) + "b"
    df = spark.createDataFrame([(1, json.dumps({quote: 1, slash: "x", "plain": True})),
                                (2, json.dumps({"plain": False}))], "source_file long, response string")
    wide = {r.source_file: r.asDict() for r in rs.union_columns(rs.parse_response(df)).collect()}
    assert wide[1][quote] == "1" and wide[1][slash] == "x" and wide[1]["plain"] == "true"
    assert wide[2][quote] is None and wide[2]["plain"] == "false"
