"""Feature queries, filters and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.catalog.registry import query, rounded, sql_right_bin, table
from sievework.operators import explore, features

LINE = "l_orderkey, l_linenumber"
KEYS = ("l_orderkey", "l_linenumber")


def lines(spark, folder):
    return table(spark, folder, "lineitem")

#: Rows that the sampling queries take: fewer than any of the tables has.
SAMPLED = 150


@query("feature_log", f"SELECT {LINE}, round(ln(1 + l_extendedprice), 6) AS log_l_extendedprice FROM lineitem")
def _(spark, folder):
    out = features.add(lines(spark, folder), "LOG", "l_extendedprice")
    return rounded(out.select(*KEYS, "log_l_extendedprice"), 6, "log_l_extendedprice")


@query("feature_square", f"SELECT {LINE}, l_quantity * l_quantity AS l_quantity_squared FROM lineitem")
def _(spark, folder):
    return features.add(lines(spark, folder), "square", "l_quantity").select(*KEYS, "l_quantity_squared")


@query("feature_cube", f"SELECT {LINE}, l_quantity * l_quantity * l_quantity AS l_quantity_cubed FROM lineitem")
def _(spark, folder):
    return features.add(lines(spark, folder), "cube", "l_quantity").select(*KEYS, "l_quantity_cubed")


@query("feature_interaction", f"SELECT {LINE}, l_quantity * l_discount AS l_quantity_x_l_discount FROM lineitem")
def _(spark, folder):
    return features.add(lines(spark, folder), "interaction", "l_quantity", "l_discount").select(
        *KEYS, "l_quantity_x_l_discount")


@query("feature_ratio", f"""
SELECT {LINE}, CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END AS l_discount_div_l_tax FROM lineitem""")
def _(spark, folder):
    return features.add(lines(spark, folder), "ratio", "l_discount", "l_tax").select(*KEYS, "l_discount_div_l_tax")


@query("feature_ratio_report", "SELECT count(*) AS n_rows, count(*) FILTER (l_tax = 0) AS n_zero_denominator FROM lineitem")
def _(spark, folder):
    return features.ratio_report(lines(spark, folder), "l_discount", "l_tax")


@query("feature_zscore", f"""
SELECT {LINE}, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem), 6)
    AS l_quantity_zscore FROM lineitem""")
def _(spark, folder):
    out = features.add(lines(spark, folder), "standardize", "l_quantity")
    return rounded(out.select(*KEYS, "l_quantity_zscore"), 6, "l_quantity_zscore")


@query("feature_normalize", """
WITH f AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS price01 FROM part, f""")
def _(spark, folder):
    out = features.add(table(spark, folder, "part"), "normalize", "p_retailprice", into="price01")
    return rounded(out.select("p_partkey", "price01"), 6, "price01")


CUT = "WITH f AS (SELECT min({c}) AS lo, max({c}) AS hi, (max({c}) - min({c})) / {n} AS w FROM lineitem)"


@query("feature_bins", f"""{CUT.format(c='l_extendedprice', n=7)}
SELECT {LINE}, {sql_right_bin('l_extendedprice', 'lo', 'w', 7)} AS price_bin FROM lineitem, f""")
def _(spark, folder):
    return features.add(lines(spark, folder), "binning", "l_extendedprice", bins=7, into="price_bin").select(
        *KEYS, "price_bin")


@query("feature_bin_labels", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 13.25 THEN '(0.95, 13.25]' WHEN l_quantity <= 25.5 THEN '(13.25, 25.5]'
    WHEN l_quantity <= 37.75 THEN '(25.5, 37.75]' ELSE '(37.75, 50.0]' END AS l_quantity_binned FROM lineitem""")
def _(spark, folder):
    return features.add(lines(spark, folder), "binning", "l_quantity", labels=True).select(*KEYS, "l_quantity_binned")


@query("feature_expression", f"""
SELECT {LINE}, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem""")
def _(spark, folder):
    out = features.add(lines(spark, folder), "custom_expr", expr="l_extendedprice * (1 - l_discount) * (1 + l_tax)", into="charge")
    return rounded(out.select(*KEYS, "charge"), 6, "charge")


@query("feature_one_hot", f"""
SELECT {LINE}, l_linestatus = 'F' AS "l_linestatus_F", l_linestatus = 'O' AS "l_linestatus_O" FROM lineitem""")
def _(spark, folder):
    return features.add(lines(spark, folder), "One-Hot", "l_linestatus").select(*KEYS, "l_linestatus_F", "l_linestatus_O")


@query("feature_dropna", f"SELECT {LINE}, l_tax FROM lineitem WHERE l_linenumber <> 7")
def _(spark, folder):
    rows = lines(spark, folder).select(*KEYS, "l_tax", F.when(F.col("l_linenumber") != 7, F.col("l_tax")).alias("t"))
    return features.add(rows, "dropna", "t").drop("t")


# --- filters and samples ---


@query("head", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def _(spark, folder):
    return explore.head(table(spark, folder, "orders"), 20, ["o_totalprice", "o_orderkey"])


@query("where", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity > 25 AND NOT (l_returnflag = 'N') AND l_shipdate < TIMESTAMP '1998-01-01'""")
def _(spark, folder):
    return explore.where(
        lines(spark, folder), "l_quantity > 25 and not (`l_returnflag` = 'N') and l_shipdate < timestamp_ntz '1998-01-01'"
    ).select(*KEYS, "l_quantity")


GROUPS = {"cheap": "l_extendedprice < 20000", "big": "l_quantity >= 40", "none": "l_quantity > 1000",
          "broken": "l_quantity >>> 'x", "": "l_tax > 0.05"}


@query("filter_groups", """
SELECT l_orderkey, l_linenumber, 'cheap' AS label FROM lineitem WHERE l_extendedprice < 20000
UNION ALL SELECT l_orderkey, l_linenumber, 'big' FROM lineitem WHERE l_quantity >= 40""")
def _(spark, folder):
    chosen = {k: v for k, v in GROUPS.items() if k}
    return explore.filter_groups(lines(spark, folder), chosen).select(*KEYS, "label")


@query("filter_report", """
SELECT 'Group 1' AS label, count(*) FILTER (l_extendedprice < 20000) AS n, NULL::VARCHAR AS problem FROM lineitem
UNION ALL SELECT 'Group 2', count(*) FILTER (l_quantity > 1000), 'empty selection' FROM lineitem
UNION ALL SELECT 'Group 3', 0, 'Filter expression is empty' FROM (SELECT 1)""")
def _(spark, folder):
    return explore.filter_report(lines(spark, folder), ["l_extendedprice < 20000", "l_quantity > 1000", " "])


@query("sample_lines")
def _(spark, folder):
    return explore.sample(lines(spark, folder), 5000, KEYS).select(*KEYS, "l_quantity")


@query("scatter", f"SELECT p_size, p_retailprice, p_type FROM part ORDER BY md5('0:' || p_partkey) LIMIT {SAMPLED}")
def _(spark, folder):
    p = table(spark, folder, "part")
    return explore.scatter(p, "p_size", "p_retailprice", "p_type", n=SAMPLED, key=["p_partkey"])


@query("category_points", f"SELECT p_retailprice, p_type FROM part ORDER BY md5('0:' || p_partkey) LIMIT {SAMPLED}")
def _(spark, folder):
    return explore.category_points(table(spark, folder, "part"), "p_retailprice", "p_type", n=SAMPLED, key=["p_partkey"])
