"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.catalog.cleaning import CUSTOMERS, PRIORITISED, customers, prioritised
from sievework.catalog.registry import query, rounded, sql_left_bin, table
from sievework.functions import sketches
from sievework.functions.stats import wald_high, wald_low
from sievework.operators import missing, profile, scaling
from sievework.plans import steps


@query("overview", f"""
SELECT count(*) AS n_rows, 5::INTEGER AS n_cols, count(*) - count(c_acctbal) AS n_missing,
    (SELECT count(*) FROM customer) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({CUSTOMERS}))) AS n_duplicates,
    'c_custkey,c_nationkey,c_acctbal' AS numeric_columns, 'c_name,c_mktsegment' AS categorical_columns
FROM ({CUSTOMERS})""")
def _(spark, folder):
    return profile.overview(customers(spark, folder))


def _info(rows: str, cols: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS missing,
        round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS missing_pct, count(DISTINCT {c}) AS "unique" FROM r"""
        for c, t in cols.items())


@query("column_info", f"WITH r AS ({CUSTOMERS}) " + _info("r", {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}))
def _(spark, folder):
    return profile.columns(customers(spark, folder))


@query("column_info_lineitem", "WITH r AS (FROM lineitem) " + _info("r", {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}))
def _(spark, folder):
    return profile.columns(table(spark, folder, "lineitem"))


@query("missing_overview", f"""
WITH o AS ({PRIORITISED})
SELECT 'o_orderpriority' AS "column", count(*) - count(o_orderpriority) AS missing,
    round(100.0 * (count(*) - count(o_orderpriority)) / count(*), 2)::DOUBLE AS missing_pct FROM o""")
def _(spark, folder):
    return profile.missing_overview(prioritised(spark, folder))


@query("scale_review", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS \"min\", max({c})::DOUBLE AS \"max\", round(avg({c}), 6) AS mean FROM part"
    for c in ("p_partkey", "p_size", "p_retailprice")))
def _(spark, folder):
    return rounded(profile.scale_review(table(spark, folder, "part")), 6, "mean")


def _numeric(t: str, c: str, digits: int = 4) -> str:
    parts = {"mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "q25": f"quantile_cont({c}, 0.25)",
             "q50": f"quantile_cont({c}, 0.5)", "q75": f"quantile_cont({c}, 0.75)", "max": f"max({c})"}
    shown = ", ".join(f'round(CAST({v} AS DOUBLE), {digits}) AS "{k}"' for k, v in parts.items())
    return f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", {shown} FROM {t}"


@query("describe_numeric", " UNION ALL ".join(
    _numeric("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def _(spark, folder):
    return profile.describe_numeric(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def _top(t: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM {t}) AS "count", (SELECT count(DISTINCT {c}) FROM {t}) AS "unique",
    (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS "top",
    (SELECT count(*) FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS freq"""


@query("describe_categorical", " UNION ALL ".join(_top("documents", c) for c in ("text", "lang", "source")))
def _(spark, folder):
    return profile.describe_categorical(table(spark, folder, "documents"))


@query("describe_all", f"""
WITH o AS (SELECT o_orderkey, o_orderstatus, epoch(o_orderdate) AS d, o_orderpriority FROM orders),
n AS ({_numeric('o', 'o_orderkey')} UNION ALL {_numeric('o', 'd')}),
c AS ({_top('o', 'o_orderstatus')} UNION ALL {_top('o', 'o_orderpriority')})
SELECT CASE WHEN "column" = 'd' THEN 'o_orderdate' ELSE "column" END AS "column", "count", NULL::BIGINT AS "unique",
    NULL::VARCHAR AS "top", NULL::BIGINT AS freq, mean, CASE WHEN "column" <> 'd' THEN std END AS std, "min", q25, q50, q75, "max" FROM n
UNION ALL SELECT "column", "count", "unique", "top", freq, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c""")
def _(spark, folder):
    return profile.describe_all(table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority"))


@query("stats_numeric", """
SELECT count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std,
    round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurtosis FROM events""")
def _(spark, folder):
    return rounded(profile.stats_1d(table(spark, folder, "events"), "value"), 6, "mean", "median", "std", "skew", "kurtosis")


@query("stats_categorical", f"SELECT \"count\" AS n, \"unique\", \"top\", freq FROM ({_top('events', 'event_type')})")
def _(spark, folder):
    return profile.stats_1d_categorical(table(spark, folder, "events"), "event_type")


@query("recommend_missing", f"""
WITH c AS ({CUSTOMERS}), m AS (SELECT count(*) AS n, count(*) - count(c_acctbal) AS gaps, [abs(avg(c_custkey)), abs(avg(c_nationkey)), abs(avg(c_acctbal))] AS a FROM c)
SELECT gaps AS n_missing, round(100.0 * gaps / (n * 5), 2)::DOUBLE AS missing_pct, 0::BIGINT AS n_duplicates, 0.0::DOUBLE AS duplicate_pct,
    round(list_max(a) / list_min(a), 6) AS scale_ratio, CASE WHEN gaps > 0 THEN 'handle_missing' ELSE 'scale_columns' END AS next_step FROM m""")
def _(spark, folder):
    return rounded(profile.recommend(customers(spark, folder)), 6, "scale_ratio")


@query("recommend_scale", """
WITH m AS (SELECT [avg(l_quantity), avg(l_extendedprice), avg(l_orderkey), avg(l_linenumber)] AS a FROM lineitem),
d AS (SELECT count(*) AS n, coalesce(sum(k) FILTER (k > 1), 0) AS copies FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_quantity, l_extendedprice, l_orderkey, l_linenumber))
SELECT 0::BIGINT AS n_missing, 0.0::DOUBLE AS missing_pct, CAST(copies AS BIGINT) AS n_duplicates,
    round(100.0 * copies / (SELECT count(*) FROM lineitem), 2)::DOUBLE AS duplicate_pct,
    round(list_max(a) / list_min(a), 6) AS scale_ratio, CASE WHEN copies > 0 THEN 'remove_duplicates' ELSE 'scale_columns' END AS next_step FROM m, d""")
def _(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber")
    return rounded(profile.recommend(rows), 6, "scale_ratio")


# --- comparisons ---


@query("compare_fill", f"""
WITH c AS ({CUSTOMERS}), a AS (SELECT coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM c)) AS b FROM c)
SELECT 'before' AS side, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std FROM c
UNION ALL SELECT 'after', count(b), round(avg(b), 6), round(stddev_samp(b), 6) FROM a""")
def _(spark, folder):
    before = customers(spark, folder)
    return rounded(profile.compare(before, missing.fill(before, ["c_acctbal"], "mean"), "c_acctbal"), 6, "mean", "std")


@query("compare_rows", f"""
SELECT count(*) AS rows_before, count(c_acctbal) AS rows_after, count(*) - count(c_acctbal) AS rows_removed FROM ({CUSTOMERS})""")
def _(spark, folder):
    before = customers(spark, folder)
    return profile.compare_rows(before, missing.drop_rows(before, ["c_acctbal"]))


@query("compare_top_values", """
WITH b AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15),
a AS (SELECT p_brand AS v, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
SELECT 'before' AS side, v AS label, n AS "value" FROM b UNION ALL SELECT 'after', v, n FROM a""")
def _(spark, folder):
    before = table(spark, folder, "part")
    return profile.compare_distribution(before, before.where("p_size > 10"), "p_brand")


def _hist(t: str, c: str, n: int) -> str:
    return f"""SELECT {sql_left_bin(c, 'lo', 'w', n)} AS b, count(*) AS k FROM {t},
    (SELECT min({c}) AS lo, (max({c}) - min({c})) / {n} AS w FROM {t}) GROUP BY 1"""


@query("compare_histograms", f"""
WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
a AS (SELECT value FROM events, f WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))
SELECT 'before' AS side, CAST(b AS VARCHAR) AS label, k AS "value" FROM ({_hist('events', 'value', 30)})
UNION ALL SELECT 'after', CAST(b AS VARCHAR), k FROM ({_hist('a', 'value', 30)})""")
def _(spark, folder):
    before = table(spark, folder, "events")
    return profile.compare_distribution(before, scaling.outliers(before, "value", "remove"), "value")


def _on(t: str, n: int) -> str:
    return f"SELECT {sql_left_bin('value', 'lo', 'w', n)} AS b, count(*) AS k FROM {t}, s GROUP BY 1"


@query("compare_shared_histograms", f"""
WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
a AS (SELECT value FROM events, f WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)),
s AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 30 AS w FROM events),
g AS (SELECT side, CAST(i AS INTEGER) AS bin FROM (VALUES ('before'), ('after')) v(side), range(30) r(i)),
k AS (SELECT 'before' AS side, b, k FROM ({_on('events', 30)}) UNION ALL SELECT 'after', b, k FROM ({_on('a', 30)}))
SELECT g.side, bin, round(lo + bin * w, 6) AS lo, round(CASE WHEN bin = 29 THEN hi ELSE lo + (bin + 1) * w END, 6) AS hi,
  coalesce(k, 0) AS "value" FROM g CROSS JOIN s LEFT JOIN k ON k.side = g.side AND b = bin""")
def _(spark, folder):
    before = table(spark, folder, "events")
    return rounded(profile.compare_histograms(before, scaling.outliers(before, "value", "remove"), "value"), 6, "lo", "hi")


@query("sketched_quantiles", """
SELECT c AS "column", p, count(*) AS n, TRUE AS within FROM lineitem,
  (VALUES ('l_extendedprice'), ('l_quantity')) v(c), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) w(p) GROUP BY ALL""")
def _(spark, folder):
    """Quantiles of sketches of three versions, merged, and whether their true ranks are within the bound."""
    lines = table(spark, folder, "lineitem")
    parts = [sketches.sketch(lines.where(F.pmod("l_orderkey", F.lit(3)) == i), ["l_extendedprice", "l_quantity"]) for i in range(3)]
    found = sketches.quantiles(sketches.merge(sketches.union(parts)), [0.25, 0.5, 0.75])
    values = lines.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in ("l_extendedprice", "l_quantity")])))
    ranks = values.join(F.broadcast(found.drop("n")), "column").groupBy("column", "p").agg(  # six rows
        F.count("*").alias("n"), F.avg((F.col("x") < F.col("value")).cast("int")).alias("under"),
        F.avg((F.col("x") <= F.col("value")).cast("int")).alias("upto"))
    error = F.lit(sketches.RANK_ERROR)
    return ranks.select("column", "p", "n", ((F.col("under") <= F.col("p") + error) & (F.col("upto") >= F.col("p") - error)).alias("within"))


# --- per category ---

BOX = """count(*) AS n, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, min({x}) AS "min",
    round(quantile_cont({x}, 0.25), 6) AS q1, round(quantile_cont({x}, 0.5), 6) AS median, round(quantile_cont({x}, 0.75), 6) AS q3, max({x}) AS "max" """
BOX_DIGITS = ("mean", "std", "q1", "median", "q3")


@query("box_stats", f"SELECT l_returnflag, {BOX.format(x='l_extendedprice')} FROM lineitem GROUP BY 1")
def _(spark, folder):
    return rounded(profile.box_stats(table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag"), 6, *BOX_DIGITS)


@query("box_stats_hue", f"""
WITH o AS ({PRIORITISED})
SELECT o_orderstatus, o_orderpriority, {BOX.format(x='o.o_totalprice')} FROM o JOIN orders USING (o_orderkey) GROUP BY 1, 2""".replace(
    "o_orderpriority,", "o.o_orderpriority,"))
def _(spark, folder):
    o = table(spark, folder, "orders").withColumn(
        "o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
    return rounded(profile.box_stats(o, "o_totalprice", "o_orderstatus", "o_orderpriority"), 6, *BOX_DIGITS)


@query("grouped_bar", """
SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 6) AS "value", count(*) AS "count", round(stddev_samp(o_totalprice), 6) AS std
FROM orders GROUP BY 1, 2""")
def _(spark, folder):
    out = profile.grouped_bar(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority", "o_orderstatus")
    return rounded(out, 6, "value", "std")


@query("wald_interval", """
WITH g AS (SELECT source, count(*) AS n, avg(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, n, round(p, 6) AS rate, round(greatest(0, p - 1.96 * sqrt(p * (1 - p) / n)), 6) AS low,
    round(least(1, p + 1.96 * sqrt(p * (1 - p) / n)), 6) AS high FROM g""")
def _(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    rates = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("rate"))
    out = rates.withColumns({"low": wald_low(F.col("rate"), F.col("n")), "high": wald_high(F.col("rate"), F.col("n"))})
    return rounded(out, 6, "rate", "low", "high")


@query("clean_and_summarise", """
WITH f AS (SELECT avg(l_discount) FILTER (l_linenumber <> 7) AS m, quantile_cont(l_extendedprice, 0.25) AS q1,
    quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem),
c AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_linenumber <> 7 THEN l_discount ELSE m END AS disc,
    greatest(q1 - (q3 - q1) * 0.25, least(q3 + (q3 - q1) * 0.25, l_extendedprice)) AS price FROM lineitem, f)
SELECT l_returnflag, round(avg(price), 4) AS "value", count(*) AS "count", round(stddev_samp(price), 4) AS std FROM c GROUP BY 1""")
def _(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice",
        F.when(F.col("l_linenumber") != 7, F.col("l_discount")).alias("l_discount"))
    out = steps.run(rows, [
        {"action": "fill", "cols": ["l_discount"], "strategy": "mean"},
        {"action": "outliers", "column": "l_extendedprice", "how": "cap", "k": 0.25},
        {"action": "remove_duplicates"},
    ])
    return rounded(profile.grouped_bar(out, "l_extendedprice", "l_returnflag"), 4, "value", "std")
