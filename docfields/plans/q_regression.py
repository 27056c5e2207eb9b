"""Registered queries: linear regression over the ``trips`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.operators import regression as rg
from docfields.plans import views
from docfields.plans.q_documents import TRIPS_SQL
from docfields.plans.registry import query

LABEL = "FARE"
ONE = ["TRIP_MILES"]
TWO = ["TRIP_MILES", "TRIP_MINUTES"]
KEY = views.TRIP_KEY
KEY_SQL = ", ".join(KEY)
SEED = 42

# The published hyper-parameter study: base run, then learning rate up / down
# and batch size up, and the two-feature run.
SWEEP = [
    ("one_feature", 0.001, 20, 50, ONE),
    ("lr_1.0", 1.0, 20, 50, ONE),
    ("lr_0.0001", 0.0001, 20, 50, ONE),
    ("batch_500", 0.001, 20, 500, ONE),
    ("two_features", 0.001, 20, 50, TWO),
]


def trips(spark, sf_dir):
    return rg.derive_minutes(views.trips(spark, sf_dir))


TRIPS_M = f"""{TRIPS_SQL}, t AS (SELECT *, TRIP_SECONDS / 60 AS TRIP_MINUTES FROM trips)"""

EXACT_SQL = f"""{TRIPS_M},
s AS (SELECT covar_samp(TRIP_MILES, TRIP_MILES) a11, covar_samp(TRIP_MILES, TRIP_MINUTES) a12,
             covar_samp(TRIP_MINUTES, TRIP_MINUTES) a22, covar_samp(TRIP_MILES, FARE) b1,
             covar_samp(TRIP_MINUTES, FARE) b2, avg(TRIP_MILES) m1, avg(TRIP_MINUTES) m2, avg(FARE) my FROM t),
w AS (SELECT (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS w1,
             (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2, m1, m2, my FROM s),
m2 AS (SELECT w1, w2, my - w1 * m1 - w2 * m2 AS b FROM w),
s1 AS (SELECT covar_samp(TRIP_MILES, FARE) / var_samp(TRIP_MILES) AS v1, avg(TRIP_MILES) m1, avg(FARE) my FROM t),
m1 AS (SELECT v1, my - v1 * m1 AS b1 FROM s1)"""


def exact_two(spark, sf_dir) -> rg.LinearModel:
    return rg.fit_exact(trips(spark, sf_dir), TWO, LABEL, name="two_features")


def exact_one(spark, sf_dir) -> rg.LinearModel:
    return rg.fit_exact(trips(spark, sf_dir), ONE, LABEL, name="one_feature")


@query("fit_one_feature", f"""WITH {TRIPS_SQL}
SELECT regr_slope(FARE, TRIP_MILES) AS weight, regr_intercept(FARE, TRIP_MILES) AS bias,
       regr_count(FARE, TRIP_MILES) AS n FROM trips""")
def q_fit_one_feature(spark, sf_dir):
    return rg.fit_one_feature(trips(spark, sf_dir), "TRIP_MILES", LABEL)


@query("fit_one_feature_gaps", f"""WITH {TRIPS_SQL},
g AS (SELECT CASE WHEN l_partkey % 17 <> 0 THEN FARE END AS FARE, CASE WHEN l_partkey % 19 <> 0 THEN TRIP_MILES END
             AS TRIP_MILES FROM trips)
SELECT regr_slope(FARE, TRIP_MILES) AS weight, regr_intercept(FARE, TRIP_MILES) AS bias,
       regr_count(FARE, TRIP_MILES) AS n FROM g""")
def q_fit_one_feature_gaps(spark, sf_dir):
    return rg.fit_one_feature(views.trips_with_gaps(spark, sf_dir), "TRIP_MILES", LABEL)


@query("fit_two_features", f"""WITH {EXACT_SQL}
SELECT 'two_features' AS experiment, 'TRIP_MILES' AS term, w1 AS weight FROM m2
UNION ALL SELECT 'two_features', 'TRIP_MINUTES', w2 FROM m2
UNION ALL SELECT 'two_features', 'bias', b FROM m2""")
def q_fit_two_features(spark, sf_dir):
    """Exact least squares (one covariance aggregate, 2x2 solve on the driver)."""
    return exact_two(spark, sf_dir).weights_df(spark)


@query("gram_stats", f"""WITH {TRIPS_M}
SELECT count(*) AS n, avg(TRIP_MILES * TRIP_MILES) AS g_0_0, avg(TRIP_MILES * TRIP_MINUTES) AS g_0_1,
       avg(TRIP_MILES) AS g_0_2, avg(TRIP_MINUTES * TRIP_MINUTES) AS g_1_1, avg(TRIP_MINUTES) AS g_1_2,
       1.0 AS g_2_2, avg(TRIP_MILES * FARE) AS c_0, avg(TRIP_MINUTES * FARE) AS c_1,
       avg(FARE) AS c_2, avg(FARE) AS sy, avg(FARE * FARE) AS syy, 0 AS batch FROM t""")
def q_gram_stats(spark, sf_dir):
    """Global sufficient statistics, reported per row (sums / n) so the
    comparison does not depend on summation order; the per-batch form is
    summed in tests."""
    g = rg.gram_stats(trips(spark, sf_dir), TWO, LABEL)
    sums = [c for c in g.columns if c not in ("n", "batch")]
    return g.select("n", *[F.try_divide(F.col(c), F.col("n")).alias(c) for c in sums], "batch")


@query("rmse", f"""WITH {EXACT_SQL}
SELECT sqrt(avg((FARE - (w1 * TRIP_MILES + w2 * TRIP_MINUTES + b)) ** 2)) AS rmse FROM t, m2""")
def q_rmse(spark, sf_dir):
    return rg.rmse(trips(spark, sf_dir), exact_two(spark, sf_dir), LABEL)


@query("predict", f"""WITH {EXACT_SQL}
SELECT {KEY_SQL}, w1 * TRIP_MILES + w2 * TRIP_MINUTES + b AS PREDICTED FROM t, m2""", digits=4)
def q_predict(spark, sf_dir):
    return rg.predict(trips(spark, sf_dir), exact_two(spark, sf_dir)).select(*KEY, "PREDICTED")


def _md5_order() -> str:
    return "md5(concat_ws('|', '42', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in KEY) + "))"


@query("sample_batch", f"""WITH {TRIPS_SQL}
SELECT * FROM trips ORDER BY {_md5_order()}, {KEY_SQL} LIMIT 50""")
def q_sample_batch(spark, sf_dir):
    """50 rows without replacement, reproducible (distributed top-k on a keyed hash)."""
    return rg.sample_batch(views.trips(spark, sf_dir), 50, KEY, SEED)


@query("model_predictions", f"""WITH {EXACT_SQL}
SELECT {KEY_SQL}, TRIP_MILES, TRIP_MINUTES, FARE AS observed, w1 * TRIP_MILES + w2 * TRIP_MINUTES + b AS predicted
FROM t, m2""", digits=4)
def q_model_predictions(spark, sf_dir):
    return rg.model_predictions(trips(spark, sf_dir), exact_two(spark, sf_dir), LABEL, KEY)


@query("model_predictions_sample", f"""WITH {EXACT_SQL},
smp AS (SELECT * FROM t ORDER BY {_md5_order()}, {KEY_SQL} LIMIT 200)
SELECT {KEY_SQL}, TRIP_MILES, TRIP_MINUTES, FARE AS observed, w1 * TRIP_MILES + w2 * TRIP_MINUTES + b AS predicted
FROM smp, m2""", digits=4)
def q_model_predictions_sample(spark, sf_dir):
    return rg.model_predictions(trips(spark, sf_dir), exact_two(spark, sf_dir), LABEL, KEY, 200, SEED)


@query("predict_fare", f"""WITH {EXACT_SQL},
smp AS (SELECT * FROM t ORDER BY {_md5_order()}, {KEY_SQL} LIMIT 50),
p AS (SELECT {KEY_SQL}, TRIP_MILES, TRIP_MINUTES, w1 * TRIP_MILES + w2 * TRIP_MINUTES + b AS PREDICTED_FARE,
             FARE AS OBSERVED_FARE FROM smp, m2)
SELECT *, abs(OBSERVED_FARE - PREDICTED_FARE) AS L1_LOSS, printf('$%.2f', PREDICTED_FARE) AS PREDICTED_FARE_text,
       printf('$%.2f', OBSERVED_FARE) AS OBSERVED_FARE_text, printf('$%.2f', abs(OBSERVED_FARE - PREDICTED_FARE))
       AS L1_LOSS_text, printf('%.2f', TRIP_MINUTES) AS TRIP_MINUTES_text FROM p""", digits=4)
def q_predict_fare(spark, sf_dir):
    return rg.predict_fare(trips(spark, sf_dir), exact_two(spark, sf_dir), LABEL, KEY, 50, SEED)


@query("compare_experiments", f"""WITH {EXACT_SQL},
r AS (SELECT 'one_feature' AS experiment, sqrt(avg((FARE - (v1 * TRIP_MILES + b1)) ** 2)) AS rmse FROM t, m1
      UNION ALL
      SELECT 'two_features', sqrt(avg((FARE - (w1 * TRIP_MILES + w2 * TRIP_MINUTES + b)) ** 2)) FROM t, m2)
SELECT experiment, rmse, rmse - min(rmse) OVER () AS delta_to_best FROM r""")
def q_compare_experiments(spark, sf_dir):
    t = trips(spark, sf_dir)
    models = rg.fit_exact_many(t, [("one_feature", ONE), ("two_features", TWO)], LABEL)  # one scan for both
    return rg.compare_experiments(t, models, LABEL)


@query("formula_gap", f"""WITH {EXACT_SQL},
wt AS (SELECT 'TRIP_MILES' AS term, w1 AS weight FROM m2 UNION ALL SELECT 'TRIP_MINUTES', w2 FROM m2
       UNION ALL SELECT 'bias', b FROM m2),
e AS (SELECT * FROM (VALUES ('TRIP_MILES', 2.25), ('TRIP_MINUTES', 0.12), ('bias', 3.25)) v(term, expected))
SELECT 'two_features' AS experiment, wt.term, weight, CAST(expected AS DOUBLE) AS expected,
       weight - expected AS gap FROM wt LEFT JOIN e ON wt.term = e.term""")
def q_formula_gap(spark, sf_dir):
    return rg.formula_gap(exact_two(spark, sf_dir).weights_df(spark))


# ------------------------------------------------ iterative training

def _step_sql(q: int) -> str:
    """One RMSprop step as a lambda over lists: ``s`` is weights, squared
    gradients, squared error and rows; ``x`` a batch (products by rows, products
    with the label, sum of squares, rows)."""
    upper = {}
    for i in range(q):
        for j in range(i, q):
            upper[i, j] = upper[j, i] = f"x[{len(set(upper.values())) + 1}]"
    u = q * (q + 1) // 2
    c = [f"x[{u + 1 + i}]" for i in range(q)]
    syy, n = f"x[{u + q + 1}]", f"x[{u + q + 2}]"
    w, v = [f"s[{i + 1}]" for i in range(q)], [f"s[{q + i + 1}]" for i in range(q)]
    gw = ["(" + " + ".join(f"{upper[i, j]} * {w[j]}" for j in range(q)) + ")" for i in range(q)]
    d = [f"(2.0e0 / {n} * ({gw[i]} - {c[i]}))" for i in range(q)]
    nv = [f"({rg.RMSPROP_RHO}e0 * {v[i]} + {1 - rg.RMSPROP_RHO}e0 * {d[i]} * {d[i]})" for i in range(q)]
    nw = [f"{w[i]} - rate * {d[i]} / (sqrt({nv[i]}) + {rg.RMSPROP_EPSILON:.17f}e0)" for i in range(q)]
    sse = (f"s[{2 * q + 1}] + {syy} - 2.0e0 * ({' + '.join(f'{w[i]} * {c[i]}' for i in range(q))})"
           f" + ({' + '.join(f'{w[i]} * {gw[i]}' for i in range(q))})")
    return f"lambda s, x: [{', '.join([*nw, *nv, sse, f's[{2 * q + 2}] + {n}'])}]"


def _history_sql(experiments) -> str:
    """The trainings of one shard in plain SQL: batches by the md5 of the key,
    an order of theirs for every epoch, and a fold over each epoch's batches.
    Gives ``history``: ``experiment, epoch, loss, rmse, rmse_final, w`` (weights, bias last)."""
    parts, states = [TRIPS_M], []
    specs = {}
    for _, _, epochs, size, feats in experiments:
        specs[tuple(feats), size] = max(epochs, specs.get((tuple(feats), size), 0))
    key = f"concat_ws('|', '{SEED}', {', '.join(f'CAST({k} AS VARCHAR)' for k in KEY)})"
    for k, ((feats, size), epochs) in enumerate(specs.items()):
        xs = [*feats, "1.0e0"]
        q = len(xs)
        sums = [f"sum({xs[i]} * {xs[j]})" for i in range(q) for j in range(i, q)]
        sums += [f"sum({x} * {LABEL})" for x in xs] + [f"sum({LABEL} * {LABEL})", "CAST(count(*) AS DOUBLE)"]
        factors = ", ".join(str(rg.epoch_factor(e, SEED)) for e in range(1, epochs + 1))
        parts.append(f"""b{k} AS MATERIALIZED (
  SELECT CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT) % CAST(ceil((SELECT count(*) FROM t) / {size}) AS BIGINT) AS batch,
         [{', '.join(sums)}] AS x FROM t GROUP BY 1),
o{k} AS MATERIALIZED (
  SELECT epoch, list(x ORDER BY (batch % {rg.ORDER_MODULUS} + 1) * factor % {rg.ORDER_MODULUS}, batch) AS xs
  FROM b{k}, (SELECT unnest(range(1, {epochs + 1})) AS epoch, unnest([{factors}]) AS factor) GROUP BY epoch),
g{k} AS (SELECT [{', '.join(f'sum(x[{i + 1}])' for i in range(len(sums)))}] AS g FROM b{k})""")
    for name, rate, epochs, size, feats in experiments:
        k, q = list(specs).index((tuple(feats), size)), len(feats) + 1
        u = q * (q + 1) // 2
        i = len(states)
        zeros = ", ".join(["0.0e0"] * (2 * q + 2))
        keep = f"list_slice(s, 1, {2 * q}) || [0.0e0, 0.0e0]"
        parts.append(f"""s{i} AS (
  SELECT 0 AS epoch, [{zeros}] AS s, {rate:.10f}e0 AS rate
  UNION ALL
  SELECT s{i}.epoch + 1, list_reduce(list_prepend({keep}, xs), {_step_sql(q)}), rate
  FROM s{i} JOIN o{k} ON o{k}.epoch = s{i}.epoch + 1 WHERE s{i}.epoch < {epochs})""")
        w = [f"s[{j + 1}]" for j in range(q)]
        place = {}
        for a in range(q):
            for b in range(a, q):
                place[a, b] = place[b, a] = f"g[{len(set(place.values())) + 1}]"
        final = (f"(g[{u + q + 1}] - 2 * ({' + '.join(f'{w[j]} * g[{u + j + 1}]' for j in range(q))}) + "
                 + " + ".join(f"{w[a]} * {place[a, b]} * {w[b]}" for a in range(q) for b in range(q)) + f") / g[{u + q + 2}]")
        loss = f"s[{2 * q + 1}] / s[{2 * q + 2}]"
        states.append(f"""SELECT '{name}' AS experiment, epoch, {loss} AS loss, sqrt(greatest({loss}, 0)) AS rmse,
       sqrt(greatest({final}, 0)) AS rmse_final, [{', '.join(w)}] AS w FROM s{i}, g{k} WHERE epoch > 0""")
    return "WITH RECURSIVE " + ",\n".join([*parts, "history AS (" + "\nUNION ALL ".join(states) + ")"]) + "\n"


def sweep(spark, sf_dir, experiments=SWEEP):
    s = rg.settings_frame(spark, experiments)
    return rg.sweep_settings(trips(spark, sf_dir), s, LABEL, KEY, SEED)


TRAINED = SWEEP[:1] + SWEEP[-1:]


@query("fit_sgd", _history_sql(SWEEP[:1]) + """
SELECT experiment, epoch, loss, rmse, rmse_final, w[1] AS weight, w[2] AS bias FROM history""")
def q_fit_sgd(spark, sf_dir):
    """RMSprop, lr 0.001, batch 50, 20 epochs on TRIP_MILES: loss curve + weight and bias per epoch."""
    h = rg.fit_sgd(trips(spark, sf_dir), ONE, LABEL, KEY, 0.001, 20, 50, "one_feature", SEED)
    return h.withColumn("weight", F.col("weights")[0]).drop("features", "weights")


@query("sweep_settings", _history_sql(SWEEP) + """
SELECT experiment, epoch, loss, rmse, rmse_final, w[-1] AS bias FROM history""")
def q_sweep_settings(spark, sf_dir):
    """The published hyper-parameter study, trained together: one job per epoch."""
    return sweep(spark, sf_dir).drop("features", "weights")


@query("loss_curve", _history_sql(TRAINED) + "SELECT experiment, epoch, loss, rmse, rmse_final FROM history")
def q_loss_curve(spark, sf_dir):
    return rg.loss_curve(sweep(spark, sf_dir, TRAINED))


@query("convergence_epoch", _history_sql(SWEEP) + """,
gains AS (SELECT experiment, epoch, lag(rmse) OVER (PARTITION BY experiment ORDER BY epoch) AS before, rmse FROM history)
SELECT experiment, min(epoch) AS converged_epoch FROM gains WHERE (before - rmse) / before < 0.01 GROUP BY experiment""")
def q_convergence_epoch(spark, sf_dir):
    return rg.convergence_epoch(sweep(spark, sf_dir), tol=0.01)


@query("fit_ml", f"""WITH {EXACT_SQL}
SELECT 'two_features_ml' AS experiment, 'TRIP_MILES' AS term, w1 AS weight FROM m2
UNION ALL SELECT 'two_features_ml', 'TRIP_MINUTES', w2 FROM m2
UNION ALL SELECT 'two_features_ml', 'bias', b FROM m2""")
def q_fit_ml(spark, sf_dir):
    """The two-feature fit with pyspark.ml's normal-equation solver (cross-check of the exact fit)."""
    return rg.fit_ml(trips(spark, sf_dir), TWO, LABEL, name="two_features_ml").weights_df(spark)



# ------------------------------------------------ trained models in the comparison path

@query("compare_trained", _history_sql(TRAINED) + """,
r AS (SELECT h.experiment, sqrt(avg((FARE - (w[1] * TRIP_MILES + CASE WHEN len(w) = 3 THEN w[2] * TRIP_MINUTES ELSE 0 END + w[-1])) ** 2)) AS rmse
      FROM history h, t WHERE epoch = 20 GROUP BY h.experiment)
SELECT experiment, rmse, rmse - min(rmse) OVER () AS delta_to_best FROM r""")
def q_compare_trained(spark, sf_dir):
    """The trained one- and two-feature models (weights of the last epoch) on the whole table."""
    t = trips(spark, sf_dir)
    history = sweep(spark, sf_dir, TRAINED)
    return rg.compare_experiments(t, [rg.model_from_history(history, n) for n in ("one_feature", "two_features")], LABEL)


@query("formula_gap_trained", _history_sql(SWEEP[-1:]) + """,
wt AS (SELECT experiment, unnest(['TRIP_MILES', 'TRIP_MINUTES', 'bias']) AS term, unnest(w) AS weight,
              unnest([2.25e0, 0.12e0, 3.25e0]) AS expected FROM history WHERE epoch = 20)
SELECT experiment, term, weight, expected, weight - expected AS gap FROM wt""")
def q_formula_gap_trained(spark, sf_dir):
    return rg.formula_gap(rg.final_weights(sweep(spark, sf_dir, SWEEP[-1:])))
