"""Linear regression from distributed sufficient statistics.

For a linear model with squared loss every quantity needed — exact weights,
mini-batch loss and gradient, RMSE — is a function of the sums
n, Σx, Σxxᵀ, Σxy, Σy, Σy². Spark computes those sums (per mini-batch when
training with SGD); only p×p-sized arrays leave the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfields.operators.profile import clean
from docfields.session import ship_package, staged

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour.
# Published fare formula: FARE = 2.25 * TRIP_MILES + 0.12 * TRIP_MINUTES + 3.25
FORMULA = {"TRIP_MILES": 2.25, "TRIP_MINUTES": 0.12, "bias": 3.25}
# Hyper-parameters of the published experiments (name, learning rate, epochs,
# batch size, features).
EXPERIMENTS = [
    ("one_feature", 0.001, 20, 50, ["TRIP_MILES"]),
    ("one_feature_hyper", 0.001, 20, 50, ["TRIP_MILES"]),
    ("two_features", 0.001, 20, 50, ["TRIP_MILES", "TRIP_MINUTES"]),
]
# RMSprop constants of the optimizer the reference trains with.
RMSPROP_RHO = 0.9
RMSPROP_EPSILON = 1e-7
# ---------------------------------------------------------------------------
#: Batches of a shard: a training of n batches runs in ceil(n / SHARD_BATCHES)
#: shards. One shard is the sequential loop of the published training.
SHARD_BATCHES = 4096
#: Modulus and base of the epochs' batch orders (a full-period generator).
ORDER_MODULUS, ORDER_BASE = 2147483647, 48271
BIAS = "bias"


@dataclass
class LinearModel:
    features: list[str]
    weights: list[float]
    bias: float
    name: str = "model"
    extra: dict = field(default_factory=dict)

    def predict_col(self) -> Column:
        """Native prediction expression Σ wᵢ·xᵢ + b (no UDF)."""
        expr = F.lit(float(self.bias))
        for f, w in zip(self.features, self.weights):
            expr = expr + F.lit(float(w)) * F.col(f).cast("double")
        return expr

    def weights_df(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, f, float(w)) for f, w in zip(self.features, self.weights)]
        rows.append((self.name, BIAS, float(self.bias)))
        return spark.createDataFrame(rows, "experiment string, term string, weight double")


def derive_minutes(df: DataFrame, seconds_col: str = "TRIP_SECONDS", out: str = "TRIP_MINUTES") -> DataFrame:
    return df.withColumn(out, F.col(seconds_col) / F.lit(60.0))


def fit_one_feature(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Exact least squares for one feature with ``regr_slope``/``regr_intercept``."""
    return clean(df, [feature, label]).agg(F.regr_slope(label, feature).alias("weight"), F.regr_intercept(label, feature).alias("bias"),
                  F.regr_count(label, feature).alias("n"))


def fit_exact(df: DataFrame, features: list[str], label: str, name: str = "exact") -> LinearModel:
    """Exact least squares: one aggregate of means and sample covariances
    (centred, so badly scaled features stay well conditioned), then a p×p
    solve on the driver."""
    return fit_exact_many(df, [(name, list(features))], label)[0]


def fit_exact_many(df: DataFrame, models: list[tuple[str, list[str]]], label: str) -> list[LinearModel]:
    """Several exact fits from one aggregate (one scan). Each model's means
    and covariances are taken over its own complete rows (features and
    label non-null), so the result equals separate fits. Only one row of
    (p+1)(p+2)/2 values per model reaches the driver."""
    df = clean(df)
    aggs = []
    for k, (_, features) in enumerate(models):
        cols = list(features) + [label]
        complete = F.lit(True)
        for c in cols:
            complete = complete & F.col(c).isNotNull()

        def v(c):
            return F.when(complete, F.col(c).cast("double"))
        aggs += [F.avg(v(c)).alias(f"m{k}_{c}") for c in cols]
        aggs += [F.covar_samp(v(a), v(b)).alias(f"c{k}_{a}__{b}") for i, a in enumerate(cols) for b in cols[i:]]
    r = df.agg(*aggs).first().asDict()
    out = []
    for k, (name, features) in enumerate(models):
        def cov(a, b):
            return r.get(f"c{k}_{a}__{b}", r.get(f"c{k}_{b}__{a}"))
        sxx = np.array([[cov(a, b) for b in features] for a in features], dtype=float)
        sxy = np.array([cov(a, label) for a in features], dtype=float)
        w = np.linalg.solve(sxx, sxy) if features else np.zeros(0)
        bias = r[f"m{k}_{label}"] - float(np.dot(w, [r[f"m{k}_{f}"] for f in features]))
        out.append(LinearModel(list(features), [float(x) for x in w], float(bias), name))
    return out


def fit_ml(df: DataFrame, features: list[str], label: str, name: str = "ml") -> LinearModel:
    """The same fit with ``pyspark.ml`` (normal-equation solver)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    va = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip")
    lr = LinearRegression(featuresCol="_features", labelCol=label, solver="normal", regParam=0.0,
                          standardization=False)
    m = lr.fit(va.transform(clean(df).select(*features, label)))
    return LinearModel(list(features), [float(x) for x in m.coefficients], float(m.intercept), name)


def predict(df: DataFrame, model: LinearModel, out: str = "PREDICTED") -> DataFrame:
    return df.withColumn(out, model.predict_col())


def rmse(df: DataFrame, model: LinearModel, label: str) -> DataFrame:
    err = F.col(label).cast("double") - model.predict_col()
    return df.agg(F.sqrt(F.avg(err * err)).alias("rmse"))


def batch_id(key_cols: list[str], n_batches: int, seed: int = 42) -> Column:
    """Pseudo-random, reproducible mini-batch id from the row key (of its md5,
    so that any engine can recompute it)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key_cols]))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(n_batches)).cast("bigint")


def gram_stats(df: DataFrame, features: list[str], label: str, key_cols: list[str] | None = None,
               n_batches: int = 1, seed: int = 42) -> DataFrame:
    """Sufficient statistics per batch with a bias column appended:
    ``n, g_i_j`` (Σ x̃ᵢx̃ⱼ for i ≤ j), ``c_i`` (Σ x̃ᵢy), ``sy``, ``syy``.

    Rows with a null feature or label are skipped. With ``n_batches=1`` the
    result is the single global row.
    """
    xs = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    y = F.col(label).cast("double")
    q = len(xs)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(xs[i] * xs[j]).alias(f"g_{i}_{j}") for i in range(q) for j in range(i, q)]
    aggs += [F.sum(xs[i] * y).alias(f"c_{i}") for i in range(q)]
    aggs += [F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
    cols = features + [label]
    complete = clean(df, cols)
    for c in cols:
        complete = complete.where(F.col(c).isNotNull())
    if n_batches <= 1:
        return complete.agg(*aggs).withColumn("batch", F.lit(0).cast("bigint"))
    if not key_cols:
        raise ValueError("key_cols are needed to assign mini-batches")
    return complete.groupBy(batch_id(key_cols, n_batches, seed).alias("batch")).agg(*aggs)


def _steps_generic(batches, w, v, lr, rho, eps):
    """RMSprop over batches, each the upper triangle of its feature products by
    rows, its products with the label, Σy² and n; updates ``w`` and ``v`` and
    returns the squared error before each update and the rows."""
    q = len(w)
    rq = range(q)
    sse = rows = 0.0
    for values in batches:
        g, c, syy, n = square(values, q), values[-q - 2:-2], values[-2], values[-1]
        gw = [sum(g[i][j] * w[j] for j in rq) for i in rq]
        sse += syy - 2.0 * sum(w[i] * c[i] for i in rq) + sum(w[i] * gw[i] for i in rq)
        rows += n
        k = 2.0 / n
        for i in rq:
            d = k * (gw[i] - c[i])
            v[i] = rho * v[i] + (1.0 - rho) * d * d
            w[i] -= lr * d / (math.sqrt(v[i]) + eps)
    return sse, rows


def _steps_q2(batches, w, v, lr, rho, eps):
    """One feature + bias, unrolled: the generic loop's arithmetic with plain
    left-to-right sums (Python's sum() compensates rounding; results agree to
    about 1e-15)."""
    w0, w1 = w
    v0, v1 = v
    sqrt, r1 = math.sqrt, 1.0 - rho
    sse = rows = 0.0
    for g00, g01, g11, c0, c1, syy, n in batches:
        gw0 = g00 * w0 + g01 * w1
        gw1 = g01 * w0 + g11 * w1
        sse += syy - 2.0 * (w0 * c0 + w1 * c1) + (w0 * gw0 + w1 * gw1)
        rows += n
        k = 2.0 / n
        d0 = k * (gw0 - c0)
        d1 = k * (gw1 - c1)
        v0 = rho * v0 + r1 * d0 * d0
        v1 = rho * v1 + r1 * d1 * d1
        w0 -= lr * d0 / (sqrt(v0) + eps)
        w1 -= lr * d1 / (sqrt(v1) + eps)
    w[:] = [w0, w1]
    v[:] = [v0, v1]
    return sse, rows


def _steps_q3(batches, w, v, lr, rho, eps):
    """Two features + bias, unrolled like :func:`_steps_q2`."""
    w0, w1, w2 = w
    v0, v1, v2 = v
    sqrt, r1 = math.sqrt, 1.0 - rho
    sse = rows = 0.0
    for g00, g01, g02, g11, g12, g22, c0, c1, c2, syy, n in batches:
        gw0 = g00 * w0 + g01 * w1 + g02 * w2
        gw1 = g01 * w0 + g11 * w1 + g12 * w2
        gw2 = g02 * w0 + g12 * w1 + g22 * w2
        sse += syy - 2.0 * (w0 * c0 + w1 * c1 + w2 * c2) + (w0 * gw0 + w1 * gw1 + w2 * gw2)
        rows += n
        k = 2.0 / n
        d0 = k * (gw0 - c0)
        d1 = k * (gw1 - c1)
        d2 = k * (gw2 - c2)
        v0 = rho * v0 + r1 * d0 * d0
        v1 = rho * v1 + r1 * d1 * d1
        v2 = rho * v2 + r1 * d2 * d2
        w0 -= lr * d0 / (sqrt(v0) + eps)
        w1 -= lr * d1 / (sqrt(v1) + eps)
        w2 -= lr * d2 / (sqrt(v2) + eps)
    w[:] = [w0, w1, w2]
    v[:] = [v0, v1, v2]
    return sse, rows


_STEPS = {2: _steps_q2, 3: _steps_q3}


def settings_frame(spark: SparkSession, experiments=None) -> DataFrame:
    exps = experiments or EXPERIMENTS
    return spark.createDataFrame(
        [(n, float(lr), int(e), int(b), list(f)) for n, lr, e, b, f in exps],
        "experiment string, learning_rate double, number_epochs int, batch_size int, input_features array<string>")


HISTORY_SCHEMA = T.StructType([
    T.StructField("experiment", T.StringType()), T.StructField("epoch", T.IntegerType()),
    T.StructField("loss", T.DoubleType()), T.StructField("rmse", T.DoubleType()),
    T.StructField("rmse_final", T.DoubleType()),
    T.StructField("features", T.ArrayType(T.StringType())), T.StructField("weights", T.ArrayType(T.DoubleType())),
    T.StructField("bias", T.DoubleType()),
])


def gram_table(df: DataFrame, specs: list[tuple[tuple[str, ...], int]], label: str, key_cols: list[str],
               seed: int = 42) -> DataFrame:
    """Per-batch sufficient statistics for several ``(features, n_batches)``
    specs in one scan: ``spec, batch, n, g, c, sy, syy`` (``g``: upper triangle
    of the feature products by rows, over the spec's features + bias).

    Each spec is one grouping set over its own batch column (``GROUPING
    SETS``: one Expand inside the same codegen stage, combined map-side);
    the sums run over the union of the specs' features. A row whose spec
    features are incomplete gets a null batch there and that group is
    dropped. Batch ids equal :func:`gram_stats`'s.
    """
    union: list[str] = []
    for feats, _ in specs:
        union += [f for f in feats if f not in union]
    df = clean(df, [*union, label])
    xs = [F.col(f).cast("double") for f in union] + [F.lit(1.0)]
    y = F.col(label).cast("double")
    q = len(xs)
    bcols = []
    for k, (feats, nb) in enumerate(specs):
        complete = F.lit(True)
        for f in feats:
            complete = complete & F.col(f).isNotNull()
        bcols.append(F.when(complete, batch_id(key_cols, nb, seed)).alias(f"_b{k}"))
    src = df.where(F.col(label).isNotNull()).select(*union, label, *bcols)
    aggs = [F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(xs[i] * xs[j]).alias(f"g_{i}_{j}") for i in range(q) for j in range(i, q)]
    aggs += [F.sum(xs[i] * y).alias(f"c_{i}") for i in range(q)]
    aggs += [F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
    bnames = [f"_b{k}" for k in range(len(specs))]
    grouped = src.groupingSets([[b] for b in bnames], *bnames).agg(*aggs)
    full = (1 << len(specs)) - 1
    parts = []
    for k, (feats, _) in enumerate(specs):
        idx = [union.index(f) for f in feats] + [q - 1]
        g = [F.col(f"g_{min(i, j)}_{max(i, j)}") for a, i in enumerate(idx) for j in idx[a:]]
        own = (F.col("_gid") == full ^ (1 << (len(specs) - 1 - k))) & F.col(f"_b{k}").isNotNull()
        parts.append(F.when(own, F.struct(F.lit(k).alias("spec"), F.col(f"_b{k}").alias("batch"), "n", F.array(*g).alias("g"),
                                          F.array(*[F.col(f"c_{i}") for i in idx]).alias("c"), "sy", "syy")))
    return grouped.select(F.coalesce(*parts).alias("r")).where(F.col("r").isNotNull()).select("r.*")


def epoch_factor(epoch: int, seed: int) -> int:
    return pow(ORDER_BASE, epoch + seed % 1000, ORDER_MODULUS)


def epoch_order(batch, epoch: int, seed: int):
    """What the batches of an epoch are ordered by (ties by batch): another
    order each epoch, the same in every run. ``batch``: a column or an array."""
    return (batch % ORDER_MODULUS + 1) * epoch_factor(epoch, seed) % ORDER_MODULUS


def shard_count(n_batches: int, shards: int | None = None) -> int:
    """Shards of a training: one for every ``SHARD_BATCHES`` batches, unless given."""
    return min(n_batches, shards or -(-n_batches // SHARD_BATCHES))


def square(upper: list[float], q: int) -> list[list[float]]:
    out = [[0.0] * q for _ in range(q)]
    at = 0
    for i in range(q):
        for j in range(i, q):
            out[i][j] = out[j][i] = upper[at]
            at += 1
    return out


def sweep_settings(df: DataFrame, settings: DataFrame, label: str, key_cols: list[str], seed: int = 42,
                   shards: int | None = None) -> DataFrame:
    """Train every setting (row of ``settings``) by RMSprop and return the loss
    curves: ``experiment, epoch, loss, rmse, rmse_final, features, weights, bias``.

    One job writes the per-batch sums of every distinct (features, batch size)
    to the shared folder, a row for each shard: batches keep the asked size, are
    dealt to shards in turn, and a shard has at most ``SHARD_BATCHES`` of them
    (unless ``shards`` is given), so shards grow with the rows and a row stays
    small. Each epoch is one job for all settings that reads this table in
    place: nothing but each shard's weights is shuffled. A task permutes a
    shard's batches into the epoch's order and passes over them from the epoch's
    weights; weights and squared gradients are averaged by rows, so the driver
    sees one row per setting. One shard is the sequential loop over all batches;
    more shards are another algorithm (local steps, averaged each epoch), which
    takes the more steps per epoch the more data there are, and need not reach
    the same weights.

    Loss and RMSE are the running values over an epoch, taken before each
    update; ``rmse_final`` is that of the averaged weights on all rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    sets = settings.collect()  # one row per experiment: a handful of rows
    for st in sets:
        if int(st.batch_size) < 1 or int(st.number_epochs) < 0 or not st.input_features:
            raise ValueError(f"setting {st.experiment!r}: batch_size >= 1, number_epochs >= 0 and at least "
                             "one feature are required")
    if shards is not None and shards < 1:
        raise ValueError("shards must be at least 1")
    n_rows = df.count() if sets else 0
    if not n_rows:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    specs: list[tuple[tuple[str, ...], int]] = []
    spec_of = {}
    for st in sets:
        key = (tuple(st.input_features), int(st.batch_size))
        if key not in spec_of:
            spec_of[key] = len(specs)
            specs.append((key[0], max(1, math.ceil(n_rows / key[1]))))
    used = [spec_of[tuple(st.input_features), int(st.batch_size)] for st in sets]
    table = shard_table(gram_table(df, specs, label, key_cols, seed), [shard_count(n, shards) for _, n in specs])
    totals = _totals(table, specs)
    state = [([0.0] * (len(st.input_features) + 1), [0.0] * (len(st.input_features) + 1)) for st in sets]
    history = []
    for epoch in range(1, max(int(st.number_epochs) for st in sets) + 1):
        live = [i for i, st in enumerate(sets) if epoch <= int(st.number_epochs) and used[i] in totals]
        if not live:
            break
        found = _epoch(table, sets, used, live, state, epoch, seed)
        for i in live:
            r, q = found[i], len(state[i][0])
            state[i] = tuple([r[f"{name}{j}"] / r["n"] for j in range(q)] for name in "wv")
            loss = r["sse"] / r["n"]
            g, c, syy, count = totals[used[i]]
            w = np.array(state[i][0])
            final = (syy - 2.0 * float(w @ c) + float(w @ g @ w)) / count
            st = sets[i]
            history.append((st.experiment, epoch, loss, math.sqrt(max(loss, 0.0)), math.sqrt(max(final, 0.0)),
                            list(st.input_features), state[i][0][:-1], state[i][0][-1]))
    return spark.createDataFrame(history, HISTORY_SCHEMA)


def shard_table(grams: DataFrame, shards: list[int]) -> DataFrame:
    """``spec, batches``: a row for each shard of a spec, its batches by id.
    Written with a file per row (or several rows in a file when there are many
    more than task slots), so that an epoch's tasks read their shards in place."""
    count = F.element_at(F.array(*map(F.lit, shards)), F.col("spec") + 1)
    rows = grams.withColumn("shard", F.pmod("batch", count)).groupBy("spec", "shard").agg(
        F.sort_array(F.collect_list(F.struct("batch", "g", "c", "syy", F.col("n").cast("double").alias("n")))).alias("batches"))
    return staged(rows.repartition(min(sum(shards), 4 * grams.sparkSession.sparkContext.defaultParallelism)), "gram")


def _totals(table: DataFrame, specs) -> dict[int, tuple]:
    """Sums over all batches of each spec (one row per spec)."""
    size = max(len(f) for f, _ in specs) + 1
    wide = size * (size + 1) // 2
    got = table.select("spec", F.inline("batches")).groupBy("spec").agg(
        *[F.sum(F.get("g", F.lit(i))).alias(f"g{i}") for i in range(wide)],
        *[F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(size)],
        F.sum("syy").alias("syy"), F.sum("n").alias("n")).collect()
    out = {}
    for r in got:
        q = len(specs[r["spec"]][0]) + 1
        out[r["spec"]] = (np.array(square([r[f"g{i}"] for i in range(q * (q + 1) // 2)], q)),
                          np.array([r[f"c{i}"] for i in range(q)]), r["syy"], r["n"])
    return out


def _epoch(table: DataFrame, sets, used: list[int], live: list[int], state, epoch: int, seed: int) -> dict[int, dict]:
    """One epoch of the live settings: of each, the sums over its shards of the
    squared error, the rows, and the weights and squared gradients by rows."""
    by_spec: dict[int, list[int]] = {}
    for i in live:
        by_spec.setdefault(used[i], []).append(i)
    rates = {i: float(sets[i].learning_rate) for i in live}
    start = {i: state[i] for i in live}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for spec, shard in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                if spec not in by_spec:
                    continue
                ids, g, c, syy, n = (shard.values.field(k) for k in ("batch", "g", "c", "syy", "n"))
                count = len(ids)
                values = np.column_stack([x.flatten().to_numpy().reshape(count, -1) for x in (g, c)]
                                         + [x.to_numpy() for x in (syy, n)])
                order = np.argsort(epoch_order(ids.to_numpy(), epoch, seed), kind="stable")
                steps = values[order].tolist()
                for i in by_spec[spec]:
                    w, v = (list(x) for x in start[i])
                    sse, seen = _STEPS.get(len(w), _steps_generic)(steps, w, v, rates[i], RMSPROP_RHO, RMSPROP_EPSILON)
                    out.append({"experiment": i, "w": w, "v": v, "sse": sse, "n": seen})
            yield pa.RecordBatch.from_pylist(out, STEP_SCHEMA)

    moved = table.select("spec", "batches").mapInArrow(run, "experiment int, w array<double>, v array<double>, sse double, n double")
    size = max(len(state[i][0]) for i in live)
    sums = [F.sum(F.get(name, F.lit(j)) * F.col("n")).alias(f"{name}{j}") for name in "wv" for j in range(size)]
    got = moved.groupBy("experiment").agg(*sums, F.sum("sse").alias("sse"), F.sum("n").alias("n")).collect()
    return {r["experiment"]: r.asDict() for r in got}


STEP_SCHEMA = pa.schema([("experiment", pa.int32()), ("w", pa.list_(pa.float64())), ("v", pa.list_(pa.float64())),
                         ("sse", pa.float64()), ("n", pa.float64())])


def fit_sgd(df: DataFrame, features: list[str], label: str, key_cols: list[str], learning_rate: float = 0.001,
            epochs: int = 20, batch_size: int = 50, name: str = "sgd", seed: int = 42,
            shards: int | None = None) -> DataFrame:
    """One RMSprop training run; returns its loss curve (see :func:`sweep_settings`)."""
    s = settings_frame(df.sparkSession, [(name, learning_rate, epochs, batch_size, features)])
    return sweep_settings(df, s, label, key_cols, seed, shards)


def loss_curve(history: DataFrame) -> DataFrame:
    return history.select("experiment", "epoch", "loss", "rmse", "rmse_final")


def final_weights(history: DataFrame) -> DataFrame:
    """Weights after the last epoch, long ``(experiment, term, weight)``."""
    last = history.withColumn("_last", F.max("epoch").over(Window.partitionBy("experiment")))
    last = last.where(F.col("epoch") == F.col("_last"))
    terms = last.select("experiment", F.posexplode("features").alias("_i", "term"), "weights", "bias")
    w = terms.select("experiment", "term", F.element_at("weights", F.col("_i") + 1).alias("weight"))
    b = last.select("experiment", F.lit(BIAS).alias("term"), F.col("bias").alias("weight"))
    return w.unionByName(b)


def model_from_history(history: DataFrame, experiment: str) -> LinearModel:
    r = (history.where(F.col("experiment") == experiment).orderBy(F.desc("epoch")).limit(1).first())
    return LinearModel(list(r.features), list(r.weights), float(r.bias), experiment)


def convergence_epoch(history: DataFrame, tol: float = 0.01, metric: str = "rmse") -> DataFrame:
    """First epoch whose relative improvement over the previous one is below ``tol``."""
    w = Window.partitionBy("experiment").orderBy("epoch")
    h = history.withColumn("_prev", F.lag(metric).over(w))
    # try_divide: a perfect fit (previous value 0) gives a null gain, not a
    # division-by-zero failure under ANSI mode
    h = h.withColumn("gain", F.try_divide(F.col("_prev") - F.col(metric), F.col("_prev")))
    return (h.where(F.col("gain").isNotNull() & (F.col("gain") < tol))
             .groupBy("experiment").agg(F.min("epoch").alias("converged_epoch")))


def sample_batch(df: DataFrame, n: int, key_cols: list[str], seed: int = 42, check_size: bool = True) -> DataFrame:
    """``n`` rows without replacement, reproducibly: the ``n`` smallest keyed
    hashes (a distributed top-k; each task keeps only ``n`` rows). Like
    pandas, asking for more rows than exist is an error."""
    if check_size:
        have = df.limit(n).count()
        if have < n:
            raise ValueError(f"cannot sample {n} rows from {have}")
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key_cols]))
    return df.withColumn("_h", h).orderBy("_h", *key_cols).limit(n).drop("_h")


def predict_fare(df: DataFrame, model: LinearModel, label: str, key_cols: list[str], batch_size: int = 50,
                 seed: int = 42) -> DataFrame:
    """Sampled rows with PREDICTED_FARE, OBSERVED_FARE, L1_LOSS (numeric and
    ``$x.xx`` text) and the model's features (any number of them)."""
    from docfields.functions.text import format_currency, format_decimal2
    batch = sample_batch(df, batch_size, key_cols, seed)
    pred = model.predict_col()
    out = batch.select(*key_cols, *model.features, pred.alias("PREDICTED_FARE"),
                       F.col(label).cast("double").alias("OBSERVED_FARE"))
    out = out.withColumn("L1_LOSS", F.abs(F.col("OBSERVED_FARE") - F.col("PREDICTED_FARE")))
    fmt = [format_currency(F.col(c)).alias(f"{c}_text") for c in ("PREDICTED_FARE", "OBSERVED_FARE", "L1_LOSS")]
    fmt += [format_decimal2(F.col(f)).alias(f"{f}_text") for f in model.features[1:]]
    return out.select("*", *fmt)


def model_predictions(df: DataFrame, model: LinearModel, label: str, key_cols: list[str],
                      n: int | None = None, seed: int = 42) -> DataFrame:
    """Features, observed and predicted values of every row, or of a reproducible sample of ``n``."""
    s = df if n is None else sample_batch(df, n, key_cols, seed, check_size=False)
    return s.select(*key_cols, *model.features, F.col(label).cast("double").alias("observed"),
                    model.predict_col().alias("predicted"))


def compare_experiments(df: DataFrame, models: list[LinearModel], label: str) -> DataFrame:
    """RMSE of several models on one table in a single pass, with the gap to the best."""
    y = F.col(label).cast("double")
    wide = df.agg(*[F.sqrt(F.avg((y - m.predict_col()) ** 2)).alias(f"m{i}") for i, m in enumerate(models)])
    cells = F.array(*[F.struct(F.lit(m.name).alias("experiment"), F.col(f"m{i}").alias("rmse"))
                      for i, m in enumerate(models)])
    long = wide.select(F.inline(cells))
    best = F.min("rmse").over(Window.partitionBy(F.lit(1)))  # over len(models) rows
    return long.withColumn("delta_to_best", F.col("rmse") - best)


def formula_gap(weights: DataFrame, formula: dict[str, float] | None = None) -> DataFrame:
    """Learned weights against the known formula, per term."""
    spark = weights.sparkSession
    f = formula or FORMULA
    expected = spark.createDataFrame([(k, float(v)) for k, v in f.items()], "term string, expected double")
    return (weights.join(F.broadcast(expected), "term", "left")
                   .withColumn("gap", F.col("weight") - F.col("expected")))
