import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfields.operators import regression as rg
from docfields.plans import q_regression as qr, views
from tests.conftest import SF_MID, SF_SMALL

KEY = views.TRIP_KEY


def trips(spark, sf=SF_SMALL):
    return rg.derive_minutes(views.trips(spark, sf))


def test_batched_gram_sums_to_global(spark):
    t = trips(spark)
    g = rg.gram_stats(t, ["TRIP_MILES", "TRIP_MINUTES"], "FARE").drop("batch").first().asDict()
    b = rg.gram_stats(t, ["TRIP_MILES", "TRIP_MINUTES"], "FARE", KEY, n_batches=17)
    assert b.count() <= 17
    s = b.drop("batch").groupBy().sum().first().asDict()
    for k, v in g.items():
        assert s[f"sum({k})"] == pytest.approx(v, rel=1e-9)


def test_exact_fit_recovers_formula(spark):
    m = rg.fit_exact(trips(spark, SF_MID), ["TRIP_MILES", "TRIP_MINUTES"], "FARE")
    w = dict(zip(m.features, m.weights))
    assert w["TRIP_MILES"] == pytest.approx(2.25, abs=0.01)
    assert w["TRIP_MINUTES"] == pytest.approx(0.12, abs=0.01)
    assert m.bias == pytest.approx(3.22, abs=0.02)
    ml = rg.fit_ml(trips(spark, SF_MID), ["TRIP_MILES", "TRIP_MINUTES"], "FARE")
    assert ml.weights == pytest.approx(m.weights, rel=1e-6) and ml.bias == pytest.approx(m.bias, rel=1e-6)


def test_rmse_from_gram_equals_residuals(spark):
    t = trips(spark)
    m = rg.fit_exact(t, ["TRIP_MILES"], "FARE")
    r1 = rg.rmse(t, m, "FARE").first().rmse
    g = rg.gram_stats(t, ["TRIP_MILES"], "FARE").first()
    w = [m.weights[0], m.bias]
    G = [[g.g_0_0, g.g_0_1], [g.g_0_1, g.g_1_1]]
    c = [g.c_0, g.c_1]
    sse = g.syy - 2 * (w[0] * c[0] + w[1] * c[1]) + sum(w[i] * G[i][j] * w[j] for i in range(2) for j in range(2))
    assert math.sqrt(sse / g.n) == pytest.approx(r1, rel=1e-6)


def test_sgd_behaviour(spark):
    t = trips(spark, SF_MID)
    s = rg.settings_frame(spark, [("base", 0.001, 20, 50, ["TRIP_MILES"]), ("slow", 0.0001, 20, 50, ["TRIP_MILES"]),
                                  ("fast", 1.0, 20, 50, ["TRIP_MILES"])])
    h = rg.sweep_settings(t, s, "FARE", KEY).toPandas()
    last = h[h.epoch == 20].set_index("experiment")
    exact = rg.rmse(t, rg.fit_exact(t, ["TRIP_MILES"], "FARE"), "FARE").first().rmse
    assert last.loc["base", "rmse_final"] < 1.5 * exact + 0.5
    assert last.loc["slow", "rmse_final"] > last.loc["base", "rmse_final"]
    assert last.loc["fast", "rmse_final"] > last.loc["base", "rmse_final"]
    conv = {r.experiment: r.converged_epoch
            for r in rg.convergence_epoch(spark.createDataFrame(h.drop(columns=["features", "weights"]))).collect()}
    assert conv["base"] <= 20


def test_sample_and_predict_fare(spark):
    t = trips(spark)
    s1 = [tuple(r) for r in rg.sample_batch(t, 20, KEY).select(*KEY).collect()]
    s2 = [tuple(r) for r in rg.sample_batch(t.repartition(5), 20, KEY).select(*KEY).collect()]
    assert s1 == s2 and len(set(s1)) == 20
    with pytest.raises(ValueError):
        rg.sample_batch(t.limit(5), 10, KEY)
    m = rg.fit_exact(t, ["TRIP_MILES", "TRIP_MINUTES"], "FARE")
    p = rg.predict_fare(t, m, "FARE", KEY, 10).collect()
    assert len(p) == 10
    for r in p:
        assert r.L1_LOSS == pytest.approx(abs(r.OBSERVED_FARE - r.PREDICTED_FARE))
        assert r.PREDICTED_FARE_text.startswith("$")
    cmp = {r.experiment: r for r in rg.compare_experiments(t, [rg.fit_exact(t, ["TRIP_MILES"], "FARE", "one"), m],
                                                            "FARE").collect()}
    assert cmp["exact"].delta_to_best == 0.0 and cmp["one"].delta_to_best >= 0
    gap = {r.term: r.gap for r in rg.formula_gap(m.weights_df(spark)).collect()}
    assert set(gap) == {"TRIP_MILES", "TRIP_MINUTES", "bias"}
    assert F is not None


def test_gram_table_equals_one_job_per_spec(spark):
    """The one-scan grouping-sets form gives, per (features, batches) spec,
    exactly the per-batch sums of a separate job, also when a feature has
    nulls, so each spec keeps its own complete rows."""
    df = qr.trips(spark, SF_SMALL)
    df = df.withColumn("TRIP_MINUTES", F.when(F.col("l_partkey") % 13 == 0, None).otherwise(F.col("TRIP_MINUTES")))
    n = df.count()
    specs = [(tuple(qr.ONE), n // 50), (tuple(qr.ONE), n // 500), (tuple(qr.TWO), n // 50), (tuple(qr.TWO), 1)]
    table = rg.gram_table(df, specs, qr.LABEL, qr.KEY, 42).toPandas()
    for k, (feats, nb) in enumerate(specs):
        got = table[table.spec == k].sort_values("batch").reset_index(drop=True)
        ref = rg.gram_stats(df, list(feats), qr.LABEL, qr.KEY, nb, 42).toPandas()
        ref = ref.sort_values("batch").reset_index(drop=True)
        q = len(feats) + 1
        assert len(got) == len(ref)
        upper = [f"g_{i}_{j}" for i in range(q) for j in range(i, q)]
        assert np.allclose(np.stack(got.g), ref[upper].to_numpy(float), rtol=1e-12)
        assert np.allclose(np.stack(got.c), ref[[f"c_{i}" for i in range(q)]].to_numpy(float), rtol=1e-12)
        assert np.allclose(got[["n", "sy", "syy", "batch"]].to_numpy(float), ref[["n", "sy", "syy", "batch"]].to_numpy(float))


@pytest.mark.parametrize("shards", [1, 3])
def test_epochs_equal_a_plain_loop(spark, shards):
    """Every epoch replayed in plain Python over the same batches, orders and shards."""
    t = trips(spark)
    feats, batch, epochs, rate = ["TRIP_MILES", "TRIP_MINUTES"], 50, 3, 0.01
    got = rg.fit_sgd(t, feats, "FARE", KEY, rate, epochs, batch, "x", 7, shards).orderBy("epoch").collect()
    nb = math.ceil(t.count() / batch)
    pdf = t.select(*feats, "FARE", rg.batch_id(KEY, nb, 7).alias("batch"),
                   F.pmod(rg.batch_id(KEY, nb, 7), F.lit(shards)).alias("shard"),
                   *[rg.epoch_order(rg.batch_id(KEY, nb, 7), e, 7).alias(f"o{e}") for e in range(1, epochs + 1)]).toPandas()
    assert pdf.batch.nunique() == nb  # the asked batch size holds
    w, v = np.zeros(3), np.zeros(3)
    for e in range(1, epochs + 1):
        ws, vs, ns, sse = [], [], [], 0.0
        for _, part in pdf.groupby("shard"):
            a, b, n = w.copy(), v.copy(), 0
            for _, rows in part.sort_values([f"o{e}", "batch"]).groupby([f"o{e}", "batch"], sort=False):
                x, y = np.c_[rows[feats].to_numpy(), np.ones(len(rows))], rows.FARE.to_numpy()
                err = x @ a - y
                sse += float(err @ err)
                g = 2 * x.T @ err / len(rows)
                b = rg.RMSPROP_RHO * b + (1 - rg.RMSPROP_RHO) * g * g
                a = a - rate * g / (np.sqrt(b) + rg.RMSPROP_EPSILON)
                n += len(rows)
            ws, vs, ns = [*ws, a], [*vs, b], [*ns, n]
        w, v = np.average(ws, 0, ns), np.average(vs, 0, ns)
        x = np.c_[pdf[feats].to_numpy(), np.ones(len(pdf))]
        assert [*got[e - 1].weights, got[e - 1].bias] == pytest.approx(w.tolist(), rel=1e-6)
        assert got[e - 1].loss == pytest.approx(sse / len(pdf), rel=1e-6)
        assert got[e - 1].rmse_final == pytest.approx(float(np.sqrt(np.mean((x @ w - pdf.FARE) ** 2))), rel=1e-5)


def test_fit_exact_many_equals_separate_fits(spark):
    """One aggregate for several models gives the separate fits, also when a
    feature has nulls (each model keeps its own complete rows)."""
    df = qr.trips(spark, SF_SMALL)
    df = df.withColumn("TRIP_MINUTES", F.when(F.col("l_partkey") % 13 == 0, None).otherwise(F.col("TRIP_MINUTES")))
    many = rg.fit_exact_many(df, [("one", qr.ONE), ("two", qr.TWO)], qr.LABEL)
    for m, feats in zip(many, [qr.ONE, qr.TWO]):
        ref = rg.fit_ml(df.where(F.col("TRIP_MINUTES").isNotNull()) if len(feats) == 2 else df, feats, qr.LABEL)
        assert m.weights == pytest.approx(ref.weights, rel=1e-9) and m.bias == pytest.approx(ref.bias, rel=1e-9)
