"""Chart table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.catalog.cleaning import PRIORITISED, prioritised
from sievework.catalog.registry import query, rounded, sql_left_bin, table
from sievework.operators import explore


def lines(spark, folder):
    return table(spark, folder, "lineitem")


def _fit(c: str, n: int, rows: str) -> str:
    return f"SELECT min({c}) AS lo, max({c}) AS hi, (max({c}) - min({c})) / {n} AS w FROM {rows}"


def _edges(b: str, n: int) -> str:
    return f"round(lo + {b} * w, 6) AS lo, round(CASE WHEN {b} = {n - 1} THEN hi ELSE lo + ({b} + 1) * w END, 6) AS hi"

#: Rows that the sampling queries take: fewer than any of the tables has.
SAMPLED = 150


@query("category_counts", f"""
SELECT coalesce(o_orderpriority, '<<MISSING>>') AS category, count(*) AS "value" FROM ({PRIORITISED}) GROUP BY 1""")
def _(spark, folder):
    return explore.category_counts(prioritised(spark, folder), "o_orderpriority")


@query("category_shares", f"""
SELECT coalesce(o_orderpriority, '<<MISSING>>') AS category, round(count(*) / (SELECT count(*) FROM orders), 6) AS "value"
FROM ({PRIORITISED}) GROUP BY 1""")
def _(spark, folder):
    return rounded(explore.category_counts(prioritised(spark, folder), "o_orderpriority", normalize=True, order="asc"), 6, "value")


def _histogram(rows: str, c: str, n: int, value: str = "coalesce(k, 0)") -> str:
    return f"""WITH f AS ({_fit(c, n, rows)}),
k AS (SELECT {sql_left_bin(c, 'lo', 'w', n)} AS b, count(*) AS k FROM {rows}, f WHERE {c} IS NOT NULL GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, {_edges('i', n)}, {value} AS "value" FROM range({n}) t(i) LEFT JOIN k ON b = i, f"""


@query("histogram", _histogram("lineitem", "l_extendedprice", 30))
def _(spark, folder):
    return rounded(explore.histogram(lines(spark, folder), "l_extendedprice", 30), 6, "lo", "hi")


@query("histogram_shares", _histogram("events", "value", 12, "round(coalesce(k, 0) / (SELECT sum(k) FROM k), 6)"))
def _(spark, folder):
    return rounded(explore.histogram(table(spark, folder, "events"), "value", 12, normalize=True), 6, "lo", "hi", "value")


@query("histogram_auto", f"""
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, least((max(value) - min(value)) / (log2(count(*)) + 1),
    2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / pow(count(*), 1.0 / 3)) AS h FROM events),
n AS (SELECT lo, hi, ceil((hi - lo) / h) AS n FROM s), f AS (SELECT lo, hi, n, (hi - lo) / n AS w FROM n),
g AS (SELECT value AS v, least(greatest(floor((value - lo) / w), 0), n - 1) AS g, lo, w, n FROM events, f),
m AS (SELECT CASE WHEN v < lo + g * w THEN g - 1 WHEN v >= lo + (g + 1) * w THEN g + 1 ELSE g END AS m, n FROM g),
k AS (SELECT least(greatest(m, 0), n - 1) AS b, count(*) AS k FROM m GROUP BY 1),
i AS (SELECT CAST(unnest(range(CAST(n AS BIGINT))) AS INTEGER) AS i, lo, hi, w, n FROM f)
SELECT i AS bin, round(lo + i * w, 6) AS lo, round(CASE WHEN i = n - 1 THEN hi ELSE lo + (i + 1) * w END, 6) AS hi, coalesce(k, 0) AS "value"
FROM i LEFT JOIN k ON b = i""")
def _(spark, folder):
    return rounded(explore.histogram(table(spark, folder, "events"), "value", "auto"), 6, "lo", "hi")


@query("histogram_2d", f"""
WITH fx AS (SELECT min(l_quantity) AS x0, (max(l_quantity) - min(l_quantity)) / 40 AS xw FROM lineitem),
fy AS (SELECT min(l_extendedprice) AS y0, (max(l_extendedprice) - min(l_extendedprice)) / 40 AS yw FROM lineitem),
k AS (SELECT {sql_left_bin('l_quantity', 'x0', 'xw', 40)} AS i, {sql_left_bin('l_extendedprice', 'y0', 'yw', 40)} AS j, count(*) AS k
    FROM lineitem, fx, fy GROUP BY 1, 2)
SELECT CAST(a AS INTEGER) AS bx, CAST(b AS INTEGER) AS "by", round(x0 + a * xw, 6) AS x_lo, round(y0 + b * yw, 6) AS y_lo, coalesce(k, 0) AS n
FROM range(40) t(a) CROSS JOIN range(40) u(b) LEFT JOIN k ON i = a AND j = b, fx, fy""")
def _(spark, folder):
    return rounded(explore.histogram2d(lines(spark, folder), "l_quantity", "l_extendedprice"), 6, "x_lo", "y_lo")


def _line(rows: str, x: str, y: str, n: int, label: str | None = None) -> str:
    head, group = (f"{label} AS label, ", "label, ") if label else ("", "")
    points = ", CAST(sum(n) OVER (PARTITION BY label) AS BIGINT) AS n_points" if label else ""
    return f"""WITH f AS ({_fit(x, n, rows)}),
k AS (SELECT {head}{sql_left_bin(x, 'lo', 'w', n)} AS bin, avg({y}) AS y, count(*) AS n FROM {rows}, f GROUP BY ALL)
SELECT {group}bin, round((lo + bin * w + (lo + (bin + 1) * w)) * 0.5, 6) AS x, round(y, 6) AS y, n{points} FROM k, f"""


@query("line", _line("lineitem", "l_extendedprice", "l_quantity", 30))
def _(spark, folder):
    return rounded(explore.line(lines(spark, folder), "l_extendedprice", "l_quantity"), 6, "x", "y")


@query("line_raw", f"SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part ORDER BY md5('0:' || p_partkey) LIMIT {SAMPLED}")
def _(spark, folder):
    return explore.raw_line(table(spark, folder, "part"), "p_size", "p_retailprice", n=SAMPLED, key=["p_partkey"])


@query("line_grouped", _line("lineitem", "l_extendedprice", "l_quantity", 20, "l_returnflag"))
def _(spark, folder):
    return rounded(explore.grouped_line(lines(spark, folder), "l_extendedprice", "l_quantity", "l_returnflag", 20), 6, "x", "y")


@query("line_grouped_raw", f"""SELECT p_type AS label, p_size::DOUBLE AS x, p_retailprice AS y FROM part
QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY md5('0:' || p_partkey)) <= {SAMPLED}""")
def _(spark, folder):
    return explore.grouped_raw_line(table(spark, folder, "part"), "p_size", "p_retailprice", "p_type", n=SAMPLED, key=["p_partkey"])


def _group_histogram(rows: str, c: str, n: int, normalize: bool) -> str:
    y = "round(coalesce(k, 0) / n_points, 6)" if normalize else "coalesce(k, 0)"
    return f"""WITH r AS ({rows}), f AS ({_fit(c, n, 'r')}),
k AS (SELECT label, {sql_left_bin(c, 'lo', 'w', n)} AS b, count(*) AS k FROM r, f WHERE {c} IS NOT NULL GROUP BY ALL),
l AS (SELECT label, count({c}) AS n_points FROM r GROUP BY 1)
SELECT l.label, CAST(i AS INTEGER) AS bin, round((lo + i * w + (lo + (i + 1) * w)) * 0.5, 6) AS x, {y} AS y, n_points
FROM l CROSS JOIN range({n}) t(i) LEFT JOIN k ON k.label = l.label AND b = i, f"""


@query("group_histogram", _group_histogram(
    f"SELECT coalesce(o_orderpriority, '<<MISSING>>') AS label, o_totalprice FROM ({PRIORITISED})", "o_totalprice", 25, True))
def _(spark, folder):
    return rounded(explore.group_histogram(prioritised(spark, folder), "o_totalprice", "o_orderpriority", 25, True), 6, "x", "y")


SPLIT = """SELECT 'light' AS label, l_extendedprice, l_discount FROM lineitem WHERE l_quantity < 20
UNION ALL SELECT 'taxed', l_extendedprice, l_discount FROM lineitem WHERE l_tax > 0.04"""
FILTERS = {"light": "l_quantity < 20", "taxed": "l_tax > 0.04", "none": "l_tax > 7", "bad": "nothing > 1"}


@query("multiline_filters", _group_histogram(SPLIT, "l_extendedprice", 15, False))
def _(spark, folder):
    return rounded(explore.multiline(lines(spark, folder), "l_extendedprice", filters=FILTERS, bins=15), 6, "x")


@query("multiline_filters_2d", f"WITH r AS ({SPLIT}), " + _line("r", "l_extendedprice", "l_discount", 15, "label")[5:])
def _(spark, folder):
    out = explore.multiline(lines(spark, folder), "l_discount", "l_extendedprice", filters=FILTERS, bins=15)
    return rounded(out, 6, "x", "y")


@query("multiline_category", _group_histogram(
    "SELECT l_linestatus AS label, l_quantity FROM lineitem", "l_quantity", 10, False))
def _(spark, folder):
    return rounded(explore.multiline(lines(spark, folder), "l_quantity", group_by="l_linestatus", bins=10), 6, "x")


@query("joint_marginals", f"""
SELECT 'x' AS axis, * FROM ({_histogram('part', 'p_size', 30)})
UNION ALL SELECT 'y', * FROM ({_histogram('part', 'p_retailprice', 30)})""")
def _(spark, folder):
    return rounded(explore.joint(table(spark, folder, "part"), "p_size", "p_retailprice")["marginals"], 6, "lo", "hi")


@query("joint_points", f"SELECT p_size, p_retailprice FROM part ORDER BY md5('0:' || p_partkey) LIMIT {SAMPLED}")
def _(spark, folder):
    return explore.joint(table(spark, folder, "part"), "p_size", "p_retailprice", n=SAMPLED, key=["p_partkey"])["points"]


@query("density_2d", """
WITH r AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part),
f AS (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, pow(count(*), -1.0 / 3) AS h,
    var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM r),
g AS (SELECT CAST(a AS INTEGER) AS gx, CAST(b AS INTEGER) AS gy, x0 + a * (x1 - x0) / 11 AS px, y0 + b * (y1 - y0) / 11 AS py
    FROM range(12) t(a) CROSS JOIN range(12) u(b), f),
d AS (SELECT n, xx * h AS a, yy * h AS c, xy * h AS b, (xx * yy - xy * xy) * h * h AS det FROM f)
SELECT gx, gy, round(px, 6) AS x, round(py, 6) AS y, round(1e6 * sum(exp(-0.5 * (c * (x - px) * (x - px) - 2 * b * (x - px) * (y - py)
    + a * (y - py) * (y - py)) / det)) / (any_value(n) * 2 * pi() * sqrt(any_value(det))), 4) AS density
FROM g, r, d GROUP BY gx, gy, px, py""")
def _(spark, folder):
    out = explore.density2d(table(spark, folder, "part"), "p_size", "p_retailprice", 12)
    out = out.withColumn("density", F.round(F.col("density") * 1e6, 4))
    return rounded(out, 6, "x", "y")


@query("density_2d_binned", """
WITH r AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part),
f AS (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(x) AS mx, avg(y) AS my,
    pow(count(*), -1.0 / 3) AS h, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM r),
k AS (SELECT *, sqrt(xx * h) AS a, xy * sqrt(h / xx) AS b, sqrt(h * (yy - xy * xy / xx)) AS c FROM f),
w AS (SELECT 16 * (x - mx) / a AS u, 16 * (y - my - b * (x - mx) / a) / c AS v FROM r, k),
s AS (SELECT floor(u) + p AS i, floor(v) + q AS j,
    sum(abs(1 - p - (u - floor(u))) * abs(1 - q - (v - floor(v)))) AS held FROM w, range(2) t1(p), range(2) t2(q) GROUP BY ALL),
g AS (SELECT CAST(e AS INTEGER) AS gx, CAST(o AS INTEGER) AS gy, x0 + e * (x1 - x0) / 11 AS px, y0 + o * (y1 - y0) / 11 AS py, n, a * c AS root,
    16 * (px - mx) / a AS pu, 16 * (py - my - b * (px - mx) / a) / c AS pv FROM range(12) t(e) CROSS JOIN range(12) t2(o), k)
SELECT gx, gy, round(px, 6) AS x, round(py, 6) AS y,
    round(1e6 * sum(held * exp(-0.5 * ((i - pu) * (i - pu) + (j - pv) * (j - pv)) / 256)) / (any_value(n) * 2 * pi() * any_value(root)), 4) AS density
FROM g, s GROUP BY gx, gy, px, py""")
def _(spark, folder):
    out = explore.density2d(table(spark, folder, "part"), "p_size", "p_retailprice", 12, approximate=True)
    out = out.withColumn("density", F.round(F.col("density") * 1e6, 4))
    return rounded(out, 6, "x", "y")


@query("contingency", """
WITH o AS (SELECT coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END, '<<MISSING>>') AS x, o_orderstatus AS y FROM orders),
k AS (SELECT y, x, count(*) AS k FROM o GROUP BY ALL)
SELECT a.y, b.x, coalesce(k, 0) AS n FROM (SELECT DISTINCT y FROM o) a CROSS JOIN (SELECT DISTINCT x FROM o) b
LEFT JOIN k ON k.y = a.y AND k.x = b.x""")
def _(spark, folder):
    o = table(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"), "o_orderstatus")
    return explore.contingency(o, "o_orderpriority", "o_orderstatus")


@query("contingency_wide", """
SELECT l_returnflag AS y, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1""")
def _(spark, folder):
    return explore.contingency(lines(spark, folder), "l_linestatus", "l_returnflag", wide=True)


@query("log_scale", """
SELECT 'l_extendedprice' AS "column", min(l_extendedprice) > 0 AS log_available FROM lineitem
UNION ALL SELECT 'l_tax', min(l_tax) > 0 FROM lineitem""")
def _(spark, folder):
    return explore.log_scale(lines(spark, folder), ["l_extendedprice", "l_tax"])


@query("log_scale_counts", """
SELECT count(DISTINCT b) = 30 AS log_available FROM (
    SELECT least(floor((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) /
        ((SELECT max(l_extendedprice) - min(l_extendedprice) FROM lineitem) / 30)), 29) AS b FROM lineitem)""")
def _(spark, folder):
    return explore.counts_log_available(explore.histogram(lines(spark, folder), "l_extendedprice", 30))


@query("two_columns_swapped", """
SELECT l_returnflag, round(avg(l_tax), 6) AS "value", count(*) AS "count", round(stddev_samp(l_tax), 6) AS std FROM lineitem GROUP BY 1""")
def _(spark, folder):
    return rounded(explore.two_columns(lines(spark, folder), "l_returnflag", "l_tax", kind="bar"), 6, "value", "std")


@query("two_columns_categories", """
WITH k AS (SELECT l_linestatus AS y, l_returnflag AS x, count(*) AS k FROM lineitem GROUP BY ALL)
SELECT a.y, b.x, coalesce(k, 0) AS n FROM (SELECT DISTINCT l_linestatus AS y FROM lineitem) a
CROSS JOIN (SELECT DISTINCT l_returnflag AS x FROM lineitem) b LEFT JOIN k ON k.y = a.y AND k.x = b.x""")
def _(spark, folder):
    return explore.two_columns(lines(spark, folder), "l_returnflag", "l_linestatus")
