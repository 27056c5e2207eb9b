"""Registered queries: table profiling over the ``trips`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.operators import profile as pf
from docfields.operators.regression import derive_minutes
from docfields.plans import views
from docfields.plans.q_documents import TRIPS_SQL
from docfields.plans.registry import query
from docfields.sources.tables import read_table

NUMERIC = ["TRIP_MILES", "TRIP_SECONDS", "FARE", "TIP_RATE"]
CATEGORICAL = ["COMPANY", "PAYMENT_TYPE"]
MISSING_TRIPS_SQL = TRIPS_SQL.replace(
    "concat('Company ', CAST(l_suppkey % 31 AS VARCHAR)) AS COMPANY",
    "CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE concat('Company ', CAST(l_suppkey % 31 AS VARCHAR)) END AS COMPANY")


def trips(spark, sf_dir):
    return views.trips(spark, sf_dir).select(*views.TRIP_COLUMNS)


@query("row_count", f"WITH {TRIPS_SQL} SELECT count(*) AS n_rows FROM trips")
def q_row_count(spark, sf_dir):
    return pf.row_count(trips(spark, sf_dir))


GAPS_SQL = TRIPS_SQL + """,
gaps AS (SELECT * REPLACE (CASE WHEN l_partkey % 17 <> 0 THEN FARE END AS FARE,
                           CASE WHEN l_partkey % 19 <> 0 THEN TRIP_MILES END AS TRIP_MILES,
                           CASE WHEN l_partkey % 23 <> 0 THEN TRIP_SECONDS END AS TRIP_SECONDS) FROM trips)"""


def _describe_sql() -> str:
    num = []
    for c in NUMERIC:
        num.append(f"""SELECT '{c}' AS column_name, count({c}) AS "count", CAST(NULL AS BIGINT) AS "unique",
  CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, avg({c}) AS mean, stddev_samp({c}) AS std,
  CAST(min({c}) AS DOUBLE) AS "min", quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
  quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS "max" FROM trips""")
    ctes = []
    for c in CATEGORICAL:
        ctes.append(f"vc_{c} AS (SELECT {c} AS value, count(*) AS cnt FROM trips WHERE {c} IS NOT NULL GROUP BY 1)")
        num.append(f"""SELECT '{c}', CAST(sum(cnt) AS BIGINT), CAST(count(*) AS BIGINT),
  (SELECT value FROM vc_{c} ORDER BY cnt DESC, value LIMIT 1), CAST(max(cnt) AS BIGINT),
  NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM vc_{c}""")
    return f"WITH {TRIPS_SQL}, {', '.join(ctes)}\n" + "\nUNION ALL\n".join(num)


@query("describe_all", _describe_sql())
def q_describe_all(spark, sf_dir):
    """describe(include='all'): exact quartiles by narrowing, one lazy plan for all sizes."""
    return pf.describe_all(trips(spark, sf_dir), NUMERIC, CATEGORICAL)


@query("describe_all_ranked", _describe_sql())
def q_describe_all_ranked(spark, sf_dir):
    """The same report with quartiles from ranks over ranges of the distinct values."""
    return pf.describe_all(trips(spark, sf_dir), NUMERIC, CATEGORICAL, pf.ranked_quantiles)


@query("describe_all_gaps", _describe_sql().replace("FROM trips", "FROM gaps").replace(TRIPS_SQL, GAPS_SQL))
def q_describe_all_gaps(spark, sf_dir):
    """NaN and null both count as missing."""
    return pf.describe_all(views.trips_with_gaps(spark, sf_dir), NUMERIC, CATEGORICAL)


MEASURES = ["price", "ratio", "net", "level"]


@query("describe_all_distinct", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS "count", CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top,
  CAST(NULL AS BIGINT) AS freq, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS "min", quantile_cont({c}, 0.25) AS p25,
  quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS "max"
FROM (SELECT CAST(l_extendedprice AS DOUBLE) AS price, l_extendedprice / (l_orderkey * 8e0 + l_linenumber) AS ratio,
             l_discount * l_extendedprice - l_partkey * 1.5e0 AS net,
             CASE WHEN l_partkey % 3 > 0 THEN -0.25e0 ELSE l_quantity / 3e7 END AS level FROM lineitem)""" for c in MEASURES))
def q_describe_all_distinct(spark, sf_dir):
    """Columns with a value of its own in nearly every row, negative and tiny ones, and one value in most rows."""
    li = read_table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("double")
    return pf.describe_all(li.select(
        price.alias("price"), (price / (F.col("l_orderkey") * 8.0 + F.col("l_linenumber"))).alias("ratio"),
        (F.col("l_discount") * price - F.col("l_partkey") * 1.5).alias("net"),
        F.when(F.col("l_partkey") % 3 > 0, F.lit(-0.25)).otherwise(F.col("l_quantity") / 3e7).alias("level")), MEASURES, [])


@query("corr_matrix_gaps", f"WITH {GAPS_SQL}\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM gaps" for a in NUMERIC for b in NUMERIC))
def q_corr_matrix_gaps(spark, sf_dir):
    return pf.corr_matrix(views.trips_with_gaps(spark, sf_dir), NUMERIC)


@query("max_value", f"WITH {TRIPS_SQL} SELECT max(FARE) AS max_FARE FROM trips")
def q_max_value(spark, sf_dir):
    return pf.max_value(trips(spark, sf_dir), "FARE")


@query("mean_value", f"WITH {TRIPS_SQL} SELECT avg(TRIP_MILES) AS mean_TRIP_MILES FROM trips")
def q_mean_value(spark, sf_dir):
    return pf.mean_value(trips(spark, sf_dir), "TRIP_MILES")


@query("distinct_count", f"WITH {TRIPS_SQL} SELECT count(DISTINCT COMPANY) AS n_distinct_COMPANY FROM trips")
def q_distinct_count(spark, sf_dir):
    return pf.distinct_count(trips(spark, sf_dir), "COMPANY")


@query("value_counts", f"""WITH {TRIPS_SQL}
SELECT PAYMENT_TYPE, count(*) AS "count" FROM trips WHERE PAYMENT_TYPE IS NOT NULL GROUP BY 1""")
def q_value_counts(spark, sf_dir):
    return pf.value_counts(trips(spark, sf_dir), "PAYMENT_TYPE")


@query("most_frequent", f"""WITH {TRIPS_SQL},
vc AS (SELECT PAYMENT_TYPE, count(*) AS cnt FROM trips WHERE PAYMENT_TYPE IS NOT NULL GROUP BY 1)
SELECT PAYMENT_TYPE AS mode_PAYMENT_TYPE, cnt AS freq FROM vc ORDER BY cnt DESC, PAYMENT_TYPE LIMIT 1""")
def q_most_frequent(spark, sf_dir):
    return pf.most_frequent(trips(spark, sf_dir), "PAYMENT_TYPE")


def _missing_expr(c: str) -> str:
    return f"count_if({c} IS NULL OR isnan({c}))" if c in NUMERIC else f"count_if({c} IS NULL)"


@query("missing_total", f"""WITH {MISSING_TRIPS_SQL},
m AS (SELECT CAST({' + '.join(_missing_expr(c) for c in views.TRIP_COLUMNS)} AS BIGINT) AS missing_total FROM trips)
SELECT missing_total, CASE WHEN missing_total = 0 THEN 'No' ELSE 'Yes' END AS any_missing FROM m""")
def q_missing_total(spark, sf_dir):
    return pf.missing_total(views.trips_with_missing(spark, sf_dir).select(*views.TRIP_COLUMNS))


@query("missing_by_column", f"WITH {MISSING_TRIPS_SQL}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {_missing_expr(c)} AS n_missing FROM trips" for c in views.TRIP_COLUMNS))
def q_missing_by_column(spark, sf_dir):
    return pf.missing_by_column(views.trips_with_missing(spark, sf_dir).select(*views.TRIP_COLUMNS))


@query("corr_matrix", f"WITH {TRIPS_SQL}\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM trips" for a in NUMERIC for b in NUMERIC))
def q_corr_matrix(spark, sf_dir):
    return pf.corr_matrix(trips(spark, sf_dir), NUMERIC)


FEATURES = ["TRIP_MILES", "TRIP_SECONDS", "TIP_RATE"]


@query("corr_rank", f"""WITH {TRIPS_SQL}, c AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, corr({f}, FARE) AS r FROM trips" for f in FEATURES) + f"""),
k AS (SELECT feature, r, row_number() OVER (ORDER BY abs(r) DESC, feature) AS "rank" FROM c)
SELECT feature, r, "rank", CASE WHEN "rank" = 1 THEN 'strongest' WHEN "rank" = {len(FEATURES)} THEN 'weakest' END
       AS strength FROM k""")
def q_corr_rank(spark, sf_dir):
    return pf.corr_rank(trips(spark, sf_dir), FEATURES, "FARE")


SCATTER = ["FARE", "TRIP_MILES", "TRIP_SECONDS"]
N_BINS = 20


def _bucket_sql(c: str) -> str:
    return (f"CASE WHEN max_{c} = min_{c} THEN 1 ELSE CAST(least(floor(({c} - min_{c}) / (max_{c} - min_{c}) * {N_BINS}), "
            f"{N_BINS - 1}) + 1 AS BIGINT) END")


@query("scatter_bins", f"""WITH {TRIPS_SQL},
mm AS (SELECT {', '.join(f'CAST(min({c}) AS DOUBLE) AS min_{c}, CAST(max({c}) AS DOUBLE) AS max_{c}' for c in SCATTER)}
       FROM trips),
b AS (SELECT {', '.join(f'{_bucket_sql(c)} AS b_{c}' for c in SCATTER)} FROM trips, mm
      WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SCATTER)})
""" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS x_col, '{b}' AS y_col, b_{a} AS x_bin, b_{b} AS y_bin, count(*) AS n FROM b GROUP BY 3, 4"
    for a in SCATTER for b in SCATTER if a != b))
def q_scatter_bins(spark, sf_dir):
    return pf.scatter_bins(trips(spark, sf_dir), SCATTER, N_BINS)


@query("scatter_bins_gaps", f"""WITH {GAPS_SQL},
mm AS (SELECT {', '.join(f'CAST(min({c}) AS DOUBLE) AS min_{c}, CAST(max({c}) AS DOUBLE) AS max_{c}' for c in SCATTER)}
       FROM gaps),
b AS (SELECT {', '.join(f'CASE WHEN {c} IS NOT NULL THEN {_bucket_sql(c)} END AS b_{c}' for c in SCATTER)} FROM gaps, mm)
""" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS x_col, '{b}' AS y_col, b_{a} AS x_bin, b_{b} AS y_bin, count(*) AS n FROM b "
    f"WHERE b_{a} IS NOT NULL AND b_{b} IS NOT NULL GROUP BY 3, 4" for a in SCATTER for b in SCATTER if a != b))
def q_scatter_bins_gaps(spark, sf_dir):
    """A row counts for every pair that it has both values of."""
    return pf.scatter_bins(views.trips_with_gaps(spark, sf_dir), SCATTER, N_BINS)


SCALE = ["TRIP_MILES", "TRIP_SECONDS", "TRIP_MINUTES"]


@query("scale_check", f"""WITH {TRIPS_SQL},
a AS (SELECT avg(abs(TRIP_MILES)) AS TRIP_MILES, avg(abs(TRIP_SECONDS)) AS TRIP_SECONDS,
             avg(abs(TRIP_SECONDS / 60)) AS TRIP_MINUTES FROM trips),
l AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {c} AS mean_abs, greatest({', '.join(SCALE)}) AS top FROM a" for c in SCALE) + """)
SELECT column_name, mean_abs, CAST(floor(log10(mean_abs)) AS BIGINT) AS order_of_magnitude,
       log10(top / mean_abs) AS orders_below_max FROM l""")
def q_scale_check(spark, sf_dir):
    return pf.scale_check(derive_minutes(trips(spark, sf_dir)), SCALE)

