"""Table profiling from distributed aggregates.

Every report is one or two aggregate jobs with map-side partial aggregation;
value frequencies are pre-aggregated per (column, value) before anything
is ordered, so a hot value costs one row, not one task.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfields.session import staged


def clean(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NaN as null in floating columns (of ``cols``): both count as missing in
    every report, and Spark's aggregates skip nulls only."""
    floating = [c for c, t in df.dtypes if t in ("double", "float") and (cols is None or c in cols)]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c in floating}) if floating else df


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def max_value(df: DataFrame, col: str) -> DataFrame:
    return clean(df, [col]).agg(F.max(col).alias(f"max_{col}"))


def mean_value(df: DataFrame, col: str) -> DataFrame:
    return clean(df, [col]).agg(F.avg(col).alias(f"mean_{col}"))


def distinct_count(df: DataFrame, col: str, exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """Distinct non-null values (exact, or HyperLogLog++ when ``exact=False``)."""
    f = F.count_distinct(col) if exact else F.approx_count_distinct(col, rsd)
    return clean(df, [col]).agg(f.cast("bigint").alias(f"n_distinct_{col}"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency table, most frequent first (ties by value); nulls excluded."""
    return (clean(df, [col]).where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.asc(col)))


def most_frequent(df: DataFrame, col: str) -> DataFrame:
    """The modal value; ties resolved to the smallest value."""
    vc = clean(df, [col]).where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
    return vc.agg(F.min_by(F.col(col), F.struct(-F.col("_cnt"), F.col(col))).alias(f"mode_{col}"),
                  F.max("_cnt").alias("freq"))


def _is_missing(df: DataFrame, c: str):
    dtype = dict(df.dtypes)[c]
    m = F.col(c).isNull()
    if dtype in ("double", "float"):
        m = m | F.isnan(F.col(c))
    return m


def missing_by_column(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Missing (null, and NaN for floating columns) per column, long form."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(_is_missing(df, c)).alias(c) for c in cols])
    return wide.unpivot([], [F.col(c) for c in cols], "column_name", "n_missing")


def missing_total(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Missing values over the whole table and whether there are any."""
    cols = cols or df.columns
    total = sum((F.count_if(_is_missing(df, c)) for c in cols[1:]), F.count_if(_is_missing(df, cols[0])))
    return (df.agg(total.cast("bigint").alias("missing_total"))
              .withColumn("any_missing", F.when(F.col("missing_total") == 0, "No").otherwise("Yes")))


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, x) rows for numeric columns, nulls dropped."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])
    return df.select(F.inline(items)).where(F.col("x").isNotNull() & ~F.isnan("x"))


#: Bits of a value's order that a round of the selection settles; four rounds settle all 64.
DIGIT_BITS = 16


def order_key(df: DataFrame, x: str, out: str) -> DataFrame:
    """``df`` with ``out``: a whole number that orders like the double ``x`` (no
    NaN), and differs where ``x`` does: exponent and mantissa, negative values
    downwards. Powers of two are exact, so is what is divided by them."""
    a = F.abs(x)
    e = F.greatest(F.least(F.floor(F.log2("_a")), F.lit(1023)), F.lit(-1022)).cast("double")
    step = df.withColumn("_a", a).withColumn("_e", F.coalesce(e, F.lit(-1022.0))).withColumn("_p", F.pow(F.lit(2.0), F.col("_e")))
    # the logarithm may round past the next power of two
    step = step.withColumn("_by", F.when((F.col("_a") < F.col("_p")) & (F.col("_e") > -1022), F.lit(-1.0))
                                   .when((F.col("_a") >= 2 * F.col("_p")) & (F.col("_e") < 1023), F.lit(1.0)).otherwise(F.lit(0.0)))
    step = step.withColumn("_e", F.col("_e") + F.col("_by")).withColumn("_p", F.pow(F.lit(2.0), F.col("_e")))
    one = F.lit(float(1 << 52))
    key = (F.when(F.col("_a") == float("inf"), F.lit(2047 << 52))
            .when(F.col("_a") >= F.col("_p"), (F.col("_e") + 1023).cast("long") * (1 << 52)
                  + ((F.col("_a") / F.col("_p") - 1) * one).cast("long"))
            .otherwise((F.col("_a") / F.col("_p") * one).cast("long")))  # below the least normal number
    # never null, so that joins on it need no filter (which would repeat all of this below the steps)
    signed = F.coalesce(key * F.when(F.col(x) < 0, F.lit(-1)).otherwise(F.lit(1)), F.lit(0).cast("long"))
    return step.withColumn(out, signed).drop("_a", "_e", "_p", "_by")


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles (as pandas / ``quantile_cont``):
    ``column_name, prob, value``, lazily, by one plan for any number of rows and
    distinct values.

    A distributed selection of the needed ranks of all columns and
    probabilities at once. Values are ordered by a 64-bit key. A round counts,
    per column, the rows by the next 16 bits of the key among those that share
    the bits settled so far (map-side combined, at most 65,536 groups for each
    rank), and a running sum over these counts tells in which group each rank
    lies: four rounds, four scans. Nothing is sorted, no state grows with the
    data, and what is broadcast is a row for each column and rank sought.
    Columns without values have no rows.
    """
    rows = order_key(_long(df, cols), "x", "_key")
    probs = [float(p) for p in probs]
    counts = rows.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    h = [(F.col("n") - 1) * F.lit(p) for p in probs]
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), rank.cast("long").alias("rank"))
                      for i, x in enumerate(h) for rank in (F.floor(x), F.ceil(x))])
    sought = counts.select("column", F.array_distinct(ranks).alias("_ranks"), F.col("n").alias("_n"))
    found = None
    for left in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.shiftright("_key", left)
        if found is None:  # the first bits hold the sign: a number from -32,768 on
            groups = rows.groupBy("column", digit.alias("_top")).agg(F.count(F.lit(1)).alias("_rows"), F.min("x").alias("_x"))
            groups = groups.join(F.broadcast(sought), "column")
        else:
            near = rows.withColumn("_top", F.shiftright("_key", left + DIGIT_BITS)).join(F.broadcast(found), ["column", "_top"])
            groups = (near.groupBy("column", "_n", "_ranks", digit.alias("_next"))
                          .agg(F.count(F.lit(1)).alias("_rows"), F.min("x").alias("_x")).withColumnRenamed("_next", "_top"))
        # groups that share the settled bits; their bits in front are the same, so _top orders them
        together = [F.col("column")] if found is None else [F.col("column"), F.shiftright("_top", DIGIT_BITS)]
        before = F.sum("_rows").over(Window.partitionBy(*together).orderBy("_top").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
        here = groups.withColumn("_before", before)
        inside = F.filter("_ranks", lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_rows")))
        moved = F.transform(inside, lambda r: F.struct(r["i"].alias("i"), (r["rank"] - F.col("_before")).alias("rank")))
        found = here.select("column", "_top", "_n", "_x", moved.alias("_ranks")).where(F.size("_ranks") > 0)
        if left:
            found = found.drop("_x")
    # ranks have shrunk to 0: a group is one value. One or two values for each probability
    values = found.select("column", "_n", F.explode("_ranks.i").alias("i"), F.col("_x").alias("x"))
    p = F.element_at(F.array(*map(F.lit, probs)), F.col("i") + 1)
    part = (F.col("n") - 1) * F.col("prob") - F.floor((F.col("n") - 1) * F.col("prob"))
    return (values.groupBy("column", "i").agg(F.max("_n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
                  .withColumn("prob", p)
                  .select(F.col("column").alias("column_name"), "prob",
                          F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + part * (F.col("hi") - F.col("lo"))).alias("value")))


def ranked_quantiles(df: DataFrame, cols: list[str], probs: list[float], n_ranges: int | None = None) -> DataFrame:
    """Exact quantiles for columns of any number of distinct values.

    Scales without one task per column: values are first counted per
    (column, value) — duplicates collapse map-side — then range-partitioned,
    ranked inside each range, and offset by the totals of earlier ranges
    (a table of ranges x columns, broadcast). The rows holding the needed
    ranks are matched with a small broadcast target table.
    Output: ``column, prob, value``.
    """
    spark = df.sparkSession
    n_ranges = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vc = _long(df, cols).groupBy("column", "x").agg(F.count(F.lit(1)).alias("cnt"))
    # written once: the offsets below hold for these very ranges
    ranged = staged(vc.repartitionByRange(n_ranges, "column", "x").withColumn("pid", F.spark_partition_id()),
                    "quantile-ranges")
    local = ranged.withColumn("local_cum", F.sum("cnt").over(
        Window.partitionBy("pid", "column").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    totals = ranged.groupBy("column", "pid").agg(F.sum("cnt").alias("tot"))
    offsets = (totals.withColumn("offset", F.coalesce(F.sum("tot").over(
                   Window.partitionBy("column").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                     .withColumn("n", F.sum("tot").over(Window.partitionBy("column"))))
    ranked = (local.join(F.broadcast(offsets.select("column", "pid", "offset", "n")), ["column", "pid"])
                   .select("column", "x", "n", (F.col("offset") + F.col("local_cum")).alias("cum"),
                           (F.col("offset") + F.col("local_cum") - F.col("cnt")).alias("cum_prev")))
    # targets: for each column/prob the two 0-based ranks around h = (n-1)p
    ns = offsets.select("column", "n").distinct()
    targets = (ns.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
                 .withColumn("h", (F.col("n") - 1) * F.col("prob"))
                 .withColumn("lo", F.floor("h")).withColumn("hi", F.ceil("h")))
    t_ranks = targets.select("column", "prob", "h", "lo", "hi",
                             F.explode(F.array_distinct(F.array("lo", "hi"))).alias("rank"))
    hits = (ranked.join(F.broadcast(t_ranks), "column")
                  .where((F.col("cum_prev") <= F.col("rank")) & (F.col("rank") < F.col("cum"))))
    # at most two rows per (column, prob): both neighbours in one small aggregate
    res = hits.groupBy("column", "prob").agg(
        F.first("h").alias("h"), F.first("lo").alias("lo"),
        F.max(F.when(F.col("rank") == F.col("lo"), F.col("x"))).alias("x_lo"),
        F.max(F.when(F.col("rank") == F.col("hi"), F.col("x"))).alias("x_hi"))
    return res.select(F.col("column").alias("column_name"), "prob",
                      (F.col("x_lo") + (F.col("h") - F.col("lo")) * (F.col("x_hi") - F.col("x_lo"))).alias("value"))


def approx_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy: int = 10000) -> DataFrame:
    """Approximate quantiles (Greenwald-Khanna sketch, one pass)."""
    items = _long(df, cols).groupBy("column").agg(F.percentile_approx("x", probs, accuracy).alias("q"))
    pairs = F.zip_with(F.array(*[F.lit(float(p)) for p in probs]), F.col("q"),
                       lambda p, v: F.struct(p.alias("prob"), v.cast("double").alias("value")))
    return items.select(F.col("column").alias("column_name"), F.inline(pairs))


def describe_all(df: DataFrame, numeric: list[str], categorical: list[str],
                 quantiles: Callable[[DataFrame, list[str], list[float]], DataFrame] = exact_quantiles) -> DataFrame:
    """``describe(include='all')`` in long form, one row per column.

    Numeric: count, mean, std (sample), min, 25/50/75 %, max. Categorical:
    count, unique, top (ties -> smallest value), freq. Other cells null.
    ``quantiles`` gives ``column_name, prob, value``. Nothing runs before the
    report is read, unless ``quantiles`` does.
    """
    probs = [0.25, 0.5, 0.75]
    df = clean(df)
    parts = []
    if numeric:
        wide = df.agg(*itertools.chain.from_iterable(
            [F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
             F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max")]
            for c in numeric))
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}__{m}`").alias(m) for m in ("count", "mean", "std", "min", "max")])
                          for c in numeric])
        stats = wide.select(F.inline(cells))
        found = quantiles(df, numeric, probs).groupBy("column_name").agg(
            *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{int(100 * p)}") for p in probs])
        none = F.lit(None)
        parts.append(stats.join(F.broadcast(found), "column_name", "left").select(
            "column_name", "count", none.cast("bigint").alias("unique"), none.cast("string").alias("top"),
            none.cast("bigint").alias("freq"), "mean", "std", "min", "p25", "p50", "p75", "max"))
    if categorical:
        items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                          for c in categorical])
        vc = (df.select(F.inline(items)).where(F.col("value").isNotNull())
                .groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt")))
        cat = vc.groupBy("column").agg(
            F.sum("cnt").cast("bigint").alias("count"), F.count(F.lit(1)).cast("bigint").alias("unique"),
            F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("top"),
            F.max("cnt").cast("bigint").alias("freq"))
        parts.append(cat.select(F.col("column").alias("column_name"), "count", "unique", "top", "freq",
                                *[F.lit(None).cast("double").alias(n)
                                  for n in ["mean", "std", "min", "p25", "p50", "p75", "max"]]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair (pairwise complete), long ``(x, y, r)``.

    One aggregate computes the upper triangle; the lower one is mirrored.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = clean(df, cols).agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        cells.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}__{b}").alias("r")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), F.col(f"{a}__{b}").alias("r")))
    return wide.select(F.inline(F.array(*cells)))


def corr_rank(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Features ranked by |corr| with the label; strongest and weakest tagged."""
    wide = clean(df, [*features, label]).agg(*[F.corr(F.col(f).cast("double"), F.col(label).cast("double")).alias(f) for f in features])
    long = wide.unpivot([], [F.col(f) for f in features], "feature", "r")
    w = Window.orderBy(F.desc(F.abs("r")), F.asc("feature"))  # over len(features) rows only
    ranked = long.withColumn("rank", F.row_number().over(w).cast("bigint"))
    n = len(features)
    return ranked.withColumn("strength", F.when(F.col("rank") == 1, "strongest")
                             .when(F.col("rank") == n, "weakest"))


def scatter_bins(df: DataFrame, cols: list[str], n_bins: int = 20) -> DataFrame:
    """Pairwise 2-D histograms: counts per (x column, y column, x bin, y bin).

    A row counts for the pairs whose two values it has. One min/max aggregate
    (a bounded row to the driver), then one grouped count of each pair (with
    map-side combine), mirrored: the output is at most pairs x bins^2 rows.
    """
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    df = clean(df, cols)
    mm = df.agg(*itertools.chain.from_iterable(
        [F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max")] for c in cols)).first()

    def bucket(c):
        lo, hi = mm[f"{c}__min"], mm[f"{c}__max"]
        if lo is None or hi is None or hi == lo:
            return F.lit(1).cast("bigint")
        b = F.floor((F.col(c).cast("double") - F.lit(lo)) / F.lit(hi - lo) * F.lit(n_bins))
        return (F.least(b, F.lit(n_bins - 1)) + 1).cast("bigint")

    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    items = F.array(*[F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(
        F.lit(a).alias("x_col"), F.lit(b).alias("y_col"), bucket(a).alias("x_bin"), bucket(b).alias("y_bin")))
        for a, b in pairs])
    counted = (df.select(F.explode(items).alias("p")).where(F.col("p").isNotNull()).select("p.*")
                 .groupBy("x_col", "y_col", "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n")))
    same = F.struct("x_col", "y_col", "x_bin", "y_bin", "n")
    mirrored = F.struct(F.col("y_col").alias("x_col"), F.col("x_col").alias("y_col"), F.col("y_bin").alias("x_bin"),
                        F.col("x_bin").alias("y_bin"), "n")
    return counted.select(F.inline(F.array(same, mirrored)))


def scale_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean magnitude per column and its gap (orders of ten) to the largest."""
    wide = clean(df, cols).agg(*[F.avg(F.abs(F.col(c).cast("double"))).alias(c) for c in cols])
    top = F.greatest(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])
    long = wide.select(top.alias("_top"), *cols).unpivot(["_top"], [F.col(c) for c in cols], "column_name", "mean_abs")
    return long.select("column_name", "mean_abs",
                       F.floor(F.log10("mean_abs")).cast("bigint").alias("order_of_magnitude"),
                       F.log10(F.try_divide(F.col("_top"), F.col("mean_abs"))).alias("orders_below_max"))
