import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docfields.operators import profile as pf
from docfields.plans import views
from tests.conftest import SF_SMALL


PLANS = [pf.exact_quantiles, *[lambda df, cols, probs, n=n: pf.ranked_quantiles(df, cols, probs, n) for n in (1, 3, 7)]]


@pytest.mark.parametrize("plan", PLANS)
def test_exact_quantiles_match_pandas_with_hot_value(spark, plan):
    """Both exact plans: narrowing, and ranks by range partitioning."""
    rng = np.random.default_rng(0)
    a = rng.normal(size=3000)
    a[:1000] = 0.5            # one value holds a third of the rows
    b = rng.integers(0, 5, size=3000).astype(float)
    b[::7] = np.nan           # nulls are skipped
    pdf = pd.DataFrame({"a": a, "b": b})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r.column_name, r.prob): r.value for r in plan(df, ["a", "b"], probs).collect()}
    for c in ["a", "b"]:
        for p in probs:
            assert got[(c, p)] == pytest.approx(pdf[c].quantile(p), abs=1e-12)


def test_describe_matches_pandas(spark):
    t = views.trips(spark, SF_SMALL).select(*views.TRIP_COLUMNS)
    pdf = t.toPandas()
    d = {r.column_name: r for r in pf.describe_all(t, ["FARE", "TRIP_MILES"], ["PAYMENT_TYPE"]).collect()}
    ref = pdf.describe(include="all")
    for c in ["FARE", "TRIP_MILES"]:
        assert d[c]["count"] == ref.loc["count", c]
        for mine, theirs in [("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"),
                             ("p75", "75%"), ("max", "max")]:
            assert d[c][mine] == pytest.approx(ref.loc[theirs, c], rel=1e-9)
    vc = pdf["PAYMENT_TYPE"].value_counts()
    assert d["PAYMENT_TYPE"].unique == pdf["PAYMENT_TYPE"].nunique()
    assert d["PAYMENT_TYPE"].top == vc.idxmax() and d["PAYMENT_TYPE"].freq == vc.max()


def test_corr_symmetric_unit_diagonal(spark):
    t = views.trips(spark, SF_SMALL)
    cols = ["FARE", "TRIP_MILES", "TIP_RATE"]
    m = {(r.x, r.y): r.r for r in pf.corr_matrix(t, cols).collect()}
    for a in cols:
        assert m[(a, a)] == pytest.approx(1.0)
        for b in cols:
            assert m[(a, b)] == pytest.approx(m[(b, a)])
    rank = {r.feature: r for r in pf.corr_rank(t, ["TRIP_MILES", "TRIP_SECONDS", "TIP_RATE"], "FARE").collect()}
    assert rank["TRIP_MILES"].strength == "strongest" and rank["TIP_RATE"].strength == "weakest"


def test_missing_and_mode(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b"), (2.0, "a"), (3.0, "b")],
                               "x double, s string")
    mb = {r.column_name: r.n_missing for r in pf.missing_by_column(df).collect()}
    assert mb == {"x": 2, "s": 1}
    mt = pf.missing_total(df).first()
    assert mt.missing_total == 3 and mt.any_missing == "Yes"
    assert pf.most_frequent(df, "s").first()[0] == "a"      # tie a/b -> smallest
    assert [tuple(r) for r in pf.value_counts(df, "s").collect()] == [("a", 2), ("b", 2)]


def test_scatter_bins_counts(spark):
    t = views.trips(spark, SF_SMALL)
    sb = pf.scatter_bins(t, ["FARE", "TRIP_MILES"], 10)
    n = t.count()
    tot = {r.x_col: r.s for r in sb.groupBy("x_col").sum("n").withColumnRenamed("sum(n)", "s").collect()}
    assert tot == {"FARE": n, "TRIP_MILES": n}
    assert sb.agg({"x_bin": "max"}).first()[0] <= 10


def test_order_keys(spark):
    """Keys order like the values and tell all of them apart."""
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2 ** 64, 20_000, np.uint64)
    powers = [s * 2.0 ** e * f for e in range(-1074, 1024) for s in (1, -1) for f in (1.0, 1 - 2 ** -53, 1 + 2 ** -52)]
    x = np.concatenate([bits.view(np.float64), powers, [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, np.finfo(float).max]])
    x = x[~np.isnan(x)]
    df = pf.order_key(spark.createDataFrame(pd.DataFrame({"x": x})), "x", "k").toPandas()
    want = np.where(df.x < 0, -(df.x.abs().to_numpy().view(np.int64)), df.x.abs().to_numpy().view(np.int64))
    assert (df.k.to_numpy() == want).all()


def test_quantiles_of_a_million_distinct_values(spark):
    n = 1_000_000
    df = spark.range(n).select(((F.col("id") * 7919 % n) / 7.0 - 50_000).alias("a"),
                               F.when(F.col("id") % 3 > 0, F.lit(1e300)).otherwise(F.col("id") * -1e-300).alias("b"),
                               F.lit(None).cast("double").alias("c"))
    got = {(r.column_name, r.prob): r.value for r in pf.exact_quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.333, 0.9]).collect()}
    a = np.sort(np.arange(n) / 7.0 - 50_000)
    i = np.arange(n)
    b = np.sort(np.where(i % 3 > 0, 1e300, i * -1e-300))
    assert set(c for c, _ in got) == {"a", "b"}
    for p in (0.0, 0.25, 0.333, 0.9):
        assert got["a", p] == pytest.approx(np.quantile(a, p), rel=1e-12) and got["b", p] == pytest.approx(np.quantile(b, p), rel=1e-12)


def test_describe_is_lazy_and_keeps_empty_columns(spark):
    t = spark.createDataFrame([(1.0, None), (3.0, None)], "x double, y double")
    spark.sparkContext.setJobGroup("describe", "describe")
    try:
        report = pf.describe_all(t, ["x", "y"], [])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("describe")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = {r.column_name: r for r in report.collect()}
    assert (rows["x"].p25, rows["x"].p50, rows["y"]["count"], rows["y"].p50) == (1.5, 2.0, 0, None)


def test_zero_divisors_give_nulls_not_failures(spark):
    """ANSI mode raises on division by zero: an all-zero column, a perfect
    fit and an empty input must still produce results."""
    from docfields.operators import regression as rg
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 3.0)], "z double, y double")
    sc = {r.column_name: r for r in pf.scale_check(df, ["z", "y"]).collect()}
    assert sc["z"].orders_below_max is None and sc["y"].orders_below_max == 0.0
    h = spark.createDataFrame([("e", 1, 0.0), ("e", 2, 0.0)], "experiment string, epoch int, rmse double")
    assert rg.convergence_epoch(h).collect() == []
    assert rg.gram_stats(df.where("y > 10"), ["z"], "y").first().n == 0
