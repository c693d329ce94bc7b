"""Regression and correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.catalog.cleaning import SPENDERS, spenders
from sievework.catalog.registry import query, rounded, table
from sievework.operators import correlation, models


def orders_by_customer(spark, folder):
    """Customers with a smooth but noisy relation: spending against the number of orders."""
    return table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("x"), F.round(F.sum("o_totalprice"), 2).alias("y"))


BY_CUSTOMER = "SELECT o_custkey, count(*)::DOUBLE AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1"


@query("poly_fit_line", f"""
WITH r AS ({BY_CUSTOMER})
SELECT 1::INTEGER AS power, round(regr_slope(y, x), 4) AS coefficient FROM r
UNION ALL SELECT 0, round(regr_intercept(y, x), 4) FROM r""")
def _(spark, folder):
    return rounded(models.poly_fit(orders_by_customer(spark, folder), "x", "y"), 4, "coefficient")


PARABOLA = f"""
WITH r AS ({BY_CUSTOMER}), m AS (SELECT avg(x) AS m FROM r),
s AS (SELECT count(*) AS n, any_value(m) AS m, sum(pow(x - m, 2)) AS s2, sum(pow(x - m, 3)) AS s3, sum(pow(x - m, 4)) AS s4,
    sum(y) AS t0, sum((x - m) * y) AS t1, sum(pow(x - m, 2) * y) AS t2 FROM r, m),
a AS (SELECT *, (t2 - s3 * t1 / s2 - s2 * t0 / n) / (s4 - s3 * s3 / s2 - s2 * s2 / n) AS a FROM s),
b AS (SELECT *, (t1 - s3 * a) / s2 AS b, (t0 - s2 * a) / n AS c FROM a),
k AS (SELECT a AS k2, b - 2 * a * m AS k1, c - b * m + a * m * m AS k0 FROM b)"""


@query("poly_fit_parabola", f"""{PARABOLA}
SELECT 2::INTEGER AS power, round(k2, 4) AS coefficient FROM k UNION ALL SELECT 1, round(k1, 4) FROM k UNION ALL SELECT 0, round(k0, 4) FROM k""")
def _(spark, folder):
    return rounded(models.poly_fit(orders_by_customer(spark, folder), "x", "y", 2), 4, "coefficient")


@query("poly_curve", f"""{PARABOLA}, g AS (SELECT min(x) + i * (max(x) - min(x)) / 199 AS x FROM r, range(200) t(i) GROUP BY i)
SELECT round(x, 6) AS x, round(k2 * x * x + k1 * x + k0, 4) AS y_fit FROM g, k""")
def _(spark, folder):
    return rounded(rounded(models.regression(orders_by_customer(spark, folder), "x", "y", 2), 6, "x"), 4, "y_fit")


@query("poly_fit_log", f"""
WITH r AS (SELECT ln(x) AS x, y FROM ({BY_CUSTOMER}))
SELECT 1::INTEGER AS power, round(regr_slope(y, x), 4) AS coefficient FROM r
UNION ALL SELECT 0, round(regr_intercept(y, x), 4) FROM r""")
def _(spark, folder):
    return rounded(models.poly_fit(orders_by_customer(spark, folder), "x", "y", log_x=True), 4, "coefficient")


@query("robust_fit")
def _(spark, folder):
    return rounded(models.robust_fit(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"), 4, "coefficient")


@query("lowess")
def _(spark, folder):
    return rounded(models.lowess(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"), 4, "y_fit")


# Neighbourhood of the k nearest rows per distinct x, tricube weights, weighted line: no robustness steps.
@query("lowess_plain", f"""
WITH r AS ({BY_CUSTOMER}), a AS (SELECT DISTINCT x AS a FROM r), k AS (SELECT floor(0.66 * count(*) + 1e-10) AS k FROM r),
d AS (SELECT a, x, y, abs(x - a) AS d, row_number() OVER (PARTITION BY a ORDER BY abs(x - a)) AS n FROM a, r),
h AS (SELECT a, max(d) AS h FROM d, k WHERE n <= k GROUP BY 1),
w AS (SELECT a, x - a AS d, y, pow(1 - pow(d / h, 3), 3) AS w FROM d JOIN h USING (a) WHERE d < h),
s AS (SELECT a, sum(w * d) / sum(w) AS md, sum(w * y) / sum(w) AS my, sum(w * d * d) / sum(w) AS dd, sum(w * d * y) / sum(w) AS dy FROM w GROUP BY 1)
SELECT a AS x, round(my - md * (dy - md * my) / (dd - md * md), 3) AS y_fit FROM s""")
def _(spark, folder):
    return rounded(models.lowess(orders_by_customer(spark, folder), "x", "y", steps=0), 3, "y_fit")


# The same at some 1,100 to 2,406 distinct x, summed up by day first.
@query("lowess_daily", """
WITH r AS (SELECT date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS x, count(*) AS n, sum(o_totalprice::DOUBLE) AS sy FROM orders GROUP BY 1),
k AS (SELECT floor(0.66 * sum(n) + 1e-10) AS k FROM r),
d AS (SELECT p.x AS a, r.x, r.n, r.sy, abs(r.x - p.x) AS d, sum(r.n) OVER (PARTITION BY p.x ORDER BY abs(r.x - p.x)) AS c FROM r AS p, r),
h AS (SELECT a, min(d) AS h FROM d, k WHERE c >= k GROUP BY 1),
w AS (SELECT a, x - a AS d, n, sy, pow(1 - pow(d / h, 3), 3) AS w FROM d JOIN h USING (a) WHERE d < h),
s AS (SELECT a, sum(w * n * d) / sum(w * n) AS md, sum(w * sy) / sum(w * n) AS my, sum(w * n * d * d) / sum(w * n) AS dd, sum(w * d * sy) / sum(w * n) AS dy FROM w GROUP BY 1)
SELECT a AS x, round(my - md * (dy - md * my) / (dd - md * md), 3) AS y_fit FROM s""")
def _(spark, folder):
    days = table(spark, folder, "orders").select(
        F.date_diff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double").alias("x"),
        F.col("o_totalprice").cast("double").alias("y"))
    return rounded(models.lowess(days, "x", "y", steps=0), 3, "y_fit")


@query("lowess_fitted_rows")
def _(spark, folder):
    rows = orders_by_customer(spark, folder)
    return rounded(models.with_lowess(rows, "x", "y"), 3, "y_fit")


@query("pearson", f"""
WITH r AS ({SPENDERS})
SELECT round(corr(c_acctbal, spend), 6) AS r, round(pow(corr(c_acctbal, spend), 2), 6) AS r2,
    count(*) FILTER (c_acctbal IS NOT NULL AND spend IS NOT NULL) AS n FROM r""")
def _(spark, folder):
    return rounded(correlation.pearson(spenders(spark, folder), "c_acctbal", "spend").drop("p_value"), 6, "r", "r2")


def _pairs(cols: dict[str, str], one) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({one(cols[a], cols[b])}, 4) AS r FROM r"
        for a in cols for b in cols)


LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("corr_pearson", "WITH r AS (FROM lineitem) " + _pairs(
    {c: c for c in LINE_COLUMNS}, lambda a, b: f"corr({a}, {b})"))
def _(spark, folder):
    return correlation.corr_matrix(table(spark, folder, "lineitem"), LINE_COLUMNS)


@query("corr_pearson_gaps", f"WITH r AS (SELECT *, 1 AS one FROM ({SPENDERS})) " + _pairs(
    {"c_nationkey": "c_nationkey", "c_acctbal": "c_acctbal", "spend": "spend"}, lambda a, b: f"corr({a}, {b})")
    + "".join(f" UNION ALL SELECT '{a}', '{b}', NULL FROM (SELECT 1)" for a, b in
              [(c, "one") for c in ("c_nationkey", "c_acctbal", "spend", "one")]
              + [("one", c) for c in ("c_nationkey", "c_acctbal", "spend")]))
def _(spark, folder):
    rows = spenders(spark, folder).withColumn("one", F.lit(1))
    return correlation.corr_matrix(rows, ["c_nationkey", "c_acctbal", "spend", "one"])


def _ranks(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("corr_spearman", f"WITH r AS (SELECT {', '.join(f'{_ranks(c)} AS {c}' for c in LINE_COLUMNS)} FROM lineitem) " + _pairs(
    {c: c for c in LINE_COLUMNS}, lambda a, b: f"corr({a}, {b})"))
def _(spark, folder):
    return correlation.corr_matrix(table(spark, folder, "lineitem"), LINE_COLUMNS, "spearman")


def _tau(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(
    (SELECT sum(p.c * q.c * sign(p.{a} - q.{a}) * sign(p.{b} - q.{b})) FROM k p, k q)
    / sqrt((SELECT sum(p.c * q.c) FROM k p, k q WHERE p.{a} <> q.{a}) * (SELECT sum(p.c * q.c) FROM k p, k q WHERE p.{b} <> q.{b})), 4) AS r"""


@query("corr_kendall", """WITH k AS (SELECT p_size, p_retailprice, count(*)::DOUBLE AS c FROM part GROUP BY ALL) """
       + _tau("p_size", "p_retailprice") + " UNION ALL " + _tau("p_retailprice", "p_size")
       + " UNION ALL SELECT 'p_size', 'p_size', 1.0::DOUBLE FROM (SELECT 1) UNION ALL SELECT 'p_retailprice', 'p_retailprice', 1.0::DOUBLE FROM (SELECT 1)")
def _(spark, folder):
    return correlation.corr_matrix(table(spark, folder, "part"), ["p_size", "p_retailprice"], "kendall")
