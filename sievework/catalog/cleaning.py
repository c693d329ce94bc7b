"""Cleaning queries: missing values, duplicates, scaling, outliers, text, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.catalog.registry import query, rounded, table
from sievework.operators import dedup, encode, knn, missing, scaling, text
from sievework.plans import steps


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers whose negative balances are missing."""
    c = table(spark, folder, "customer")
    return c.withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))


CUSTOMERS = """SELECT c_custkey, c_name, c_nationkey,
    CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer"""


def prioritised(spark: SparkSession, folder: str) -> DataFrame:
    """Orders without a priority on every seventh key."""
    o = table(spark, folder, "orders")
    return o.select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))


PRIORITISED = """SELECT o_orderkey, o_totalprice,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders"""


@query("missing_drop_rows", f"SELECT * FROM ({CUSTOMERS}) WHERE c_acctbal IS NOT NULL")
def _(spark, folder):
    return missing.drop_rows(customers(spark, folder), ["c_acctbal"])


@query("missing_drop_rows_report", f"""
SELECT count(*) AS rows_before, count(*) - count(c_acctbal) AS rows_removed, count(c_acctbal) AS rows_after
FROM ({CUSTOMERS})""")
def _(spark, folder):
    return missing.dropped_rows_report(customers(spark, folder))


@query("missing_drop_cols", f"SELECT * EXCLUDE (c_acctbal) FROM ({CUSTOMERS})")
def _(spark, folder):
    return missing.drop_cols(customers(spark, folder))


@query("fill_mean", f"""
WITH c AS ({CUSTOMERS})
SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM c)), 6) AS c_acctbal FROM c""")
def _(spark, folder):
    out = missing.fill(customers(spark, folder), ["c_acctbal", "c_name"], "mean")
    return rounded(out.select("c_custkey", "c_acctbal"), 6, "c_acctbal")


@query("fill_median", f"""
WITH c AS ({CUSTOMERS})
SELECT c_custkey, round(coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM c)), 6) AS c_acctbal FROM c""")
def _(spark, folder):
    out = missing.fill(customers(spark, folder), ["c_acctbal"], "median")
    return rounded(out.select("c_custkey", "c_acctbal"), 6, "c_acctbal")


@query("fill_mode", f"""
WITH o AS ({PRIORITISED}), m AS (
    SELECT o_orderpriority AS v FROM o WHERE o_orderpriority IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(o_orderpriority, (SELECT v FROM m)) AS o_orderpriority FROM o""")
def _(spark, folder):
    return missing.fill(prioritised(spark, folder), ["o_orderpriority"], "mode").select("o_orderkey", "o_orderpriority")


@query("fill_constant", f"""
SELECT c_custkey, coalesce(c_acctbal, 0.0) AS c_acctbal, c_mktsegment FROM ({CUSTOMERS})""")
def _(spark, folder):
    out = missing.fill(customers(spark, folder), ["c_acctbal", "c_mktsegment"], "constant")
    return out.select("c_custkey", "c_acctbal", "c_mktsegment")


@query("fill_feature_into", f"""
WITH c AS ({CUSTOMERS})
SELECT c_custkey, c_acctbal, round(coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM c)), 6) AS bal_filled FROM c""")
def _(spark, folder):
    out = missing.fill_feature(customers(spark, folder), "c_acctbal", "median", into="bal_filled")
    return rounded(out.select("c_custkey", "c_acctbal", "bal_filled"), 6, "bal_filled")


@query("fill_report", f"""
WITH o AS ({PRIORITISED})
SELECT 'o_orderpriority' AS "column", 'mode' AS strategy,
    (SELECT o_orderpriority FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS fill_value,
    (SELECT count(*) - count(o_orderpriority) FROM o) AS n_filled""")
def _(spark, folder):
    return missing.fill_report(prioritised(spark, folder), ["o_orderpriority"], "mode")


# --- nearest neighbours ---


def spenders(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with their spending; missing where nothing was ordered."""
    spent = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("spend"))
    c = customers(spark, folder)
    return c.join(spent, c.c_custkey == spent.k, "left").select("c_custkey", "c_nationkey", "c_acctbal", "spend")


SPENDERS = f"""SELECT c_custkey, c_nationkey, c_acctbal, spend FROM ({CUSTOMERS}) LEFT JOIN (
    SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1) ON k = c_custkey"""


@query("knn_impute", f"""
WITH c AS ({SPENDERS}),
r AS (SELECT * FROM c WHERE c_acctbal IS NOT NULL AND spend IS NOT NULL),
f AS (SELECT avg(c_nationkey) AS mn, stddev_pop(c_nationkey) AS sn, avg(spend) AS ms, stddev_pop(spend) AS ss FROM r),
i AS (SELECT * FROM c WHERE c_acctbal IS NULL AND spend IS NOT NULL),
p AS (SELECT i.c_custkey AS q, r.c_acctbal AS v, row_number() OVER (PARTITION BY i.c_custkey ORDER BY
    ((i.c_nationkey - mn) / sn - (r.c_nationkey - mn) / sn) * ((i.c_nationkey - mn) / sn - (r.c_nationkey - mn) / sn)
    + ((i.spend - ms) / ss - (r.spend - ms) / ss) * ((i.spend - ms) / ss - (r.spend - ms) / ss), r.c_custkey) AS n
    FROM i, r, f),
m AS (SELECT q, avg(v) AS v FROM p WHERE n <= 5 GROUP BY q)
SELECT c_custkey, round(coalesce(c_acctbal, v), 6) AS c_acctbal FROM c LEFT JOIN m ON q = c_custkey
WHERE c_acctbal IS NOT NULL OR spend IS NOT NULL""")
def _(spark, folder):
    out = knn.knn_impute(spenders(spark, folder), ["c_acctbal"], 5, id_col="c_custkey", features=["c_nationkey", "spend"])
    return rounded(out.select("c_custkey", "c_acctbal"), 6, "c_acctbal")


@query("knn_report", f"""
WITH c AS ({SPENDERS}), g AS (SELECT count(*) AS n, count(spend) AS can FROM c WHERE c_acctbal IS NULL)
SELECT n AS n_impute, can AS n_can_impute, CASE WHEN n = 0 THEN 1.0 ELSE can / n END::DOUBLE AS ratio, n - can AS n_dropped FROM g""")
def _(spark, folder):
    return knn.report(spenders(spark, folder), ["c_acctbal"], ["c_nationkey", "spend"])


# --- duplicates ---


def coarse_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events by user group, type and day: full of repeated rows."""
    return table(spark, folder, "events").select(
        (F.col("user_id") % 20).alias("u"), "event_type", F.dayofmonth("ts").cast("long").alias("d"))


COARSE = "SELECT user_id % 20 AS u, event_type, CAST(day(ts) AS BIGINT) AS d FROM events"


@query("dedup_remove", f"SELECT DISTINCT * FROM ({COARSE})")
def _(spark, folder):
    return dedup.remove(coarse_events(spark, folder))


@query("dedup_copies", f"""
WITH e AS ({COARSE}), g AS (SELECT u, event_type, d FROM e GROUP BY ALL HAVING count(*) > 1)
SELECT e.* FROM e JOIN g USING (u, event_type, d)""")
def _(spark, folder):
    return dedup.copies(coarse_events(spark, folder))


OVERVIEW = """
WITH g AS (SELECT count(*) AS n FROM ({rows}) GROUP BY {keys})
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_extra_copies,
    CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_all_copies,
    round(100.0 * coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 2)::DOUBLE AS pct FROM g"""


@query("dedup_overview", OVERVIEW.format(rows=COARSE, keys="u, event_type, d"))
def _(spark, folder):
    return dedup.overview(coarse_events(spark, folder))


@query("dedup_overview_texts", OVERVIEW.format(rows="SELECT text FROM documents", keys="text"))
def _(spark, folder):
    return dedup.overview(table(spark, folder, "documents").select("text"))


@query("dedup_examples", f"""
WITH e AS ({COARSE}), g AS (SELECT u, event_type, d FROM e GROUP BY ALL HAVING count(*) > 1)
SELECT e.* FROM e JOIN g USING (u, event_type, d) ORDER BY u, event_type, d LIMIT 3""")
def _(spark, folder):
    return dedup.examples(coarse_events(spark, folder))


@query("dedup_first_by_key", """
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def _(spark, folder):
    return dedup.by_key(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type", "value")


@query("dedup_last_by_key", """
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(spark, folder):
    return dedup.by_key(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], last=True).select(
        "user_id", "event_id", "event_type", "value")


# --- scaling and outliers ---


@query("scale_standard", """
SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS p_size,
    round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS p_retailprice
FROM part""")
def _(spark, folder):
    out = scaling.scale(table(spark, folder, "part"), ["p_size", "p_retailprice"], "standard")
    return rounded(out.select("p_partkey", "p_size", "p_retailprice"), 6, "p_size", "p_retailprice")


@query("scale_minmax", """
WITH f AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_extendedprice - lo) / (hi - lo), 6) AS l_extendedprice FROM lineitem, f""")
def _(spark, folder):
    out = scaling.scale(table(spark, folder, "lineitem"), ["l_extendedprice"], "minmax")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_extendedprice"), 6, "l_extendedprice")


@query("scale_robust", """
WITH f AS (SELECT quantile_cont(l_extendedprice, 0.5) AS m,
    quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / w, 6) AS l_extendedprice FROM lineitem, f""")
def _(spark, folder):
    out = scaling.scale(table(spark, folder, "lineitem"), ["l_extendedprice"], "robust")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_extendedprice"), 6, "l_extendedprice")


@query("outlier_report", """
WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
b AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM f)
SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound,
    count(*) FILTER (value < lo OR value > hi) AS n_outliers FROM events, b GROUP BY ALL""")
def _(spark, folder):
    out = scaling.outlier_report(table(spark, folder, "events"), "value")
    return rounded(out, 6, "q1", "q3", "iqr", "lower_bound", "upper_bound")


FENCES = """
WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM f)"""


@query("outlier_remove", f"{FENCES} SELECT event_id, value FROM events, b WHERE value >= lo AND value <= hi")
def _(spark, folder):
    return scaling.outliers(table(spark, folder, "events"), "value", "remove").select("event_id", "value")


@query("outlier_cap", f"""{FENCES}
SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value FROM events, b""")
def _(spark, folder):
    return rounded(scaling.outliers(table(spark, folder, "events"), "value", "cap").select("event_id", "value"), 6, "value")


@query("outlier_flags", f"{FENCES} SELECT event_id, (value < lo OR value > hi) AS is_outlier FROM events, b")
def _(spark, folder):
    return scaling.flag_outliers(table(spark, folder, "events"), "value").select("event_id", "is_outlier")


@query("cap_upper", """
WITH f AS (SELECT quantile_cont(l_extendedprice, 0.99) AS a, quantile_cont(l_quantity, 0.99) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice > a THEN a ELSE l_extendedprice END, 6) AS l_extendedprice_clean,
    round(CASE WHEN l_quantity > b THEN b ELSE l_quantity END, 6) AS l_quantity_clean FROM lineitem, f""")
def _(spark, folder):
    out = scaling.cap_upper(table(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity"])
    names = ("l_extendedprice_clean", "l_quantity_clean")
    return rounded(out.select("l_orderkey", "l_linenumber", *names), 6, *names)


@query("cap_table", """
SELECT 'l_extendedprice' AS "column", round(quantile_cont(l_extendedprice, 0.99), 4) AS cap FROM lineitem
UNION ALL SELECT 'l_tax', round(quantile_cont(l_tax, 0.99), 4) FROM lineitem""")
def _(spark, folder):
    return scaling.cap_table(table(spark, folder, "lineitem"), ["l_extendedprice", "l_tax"])


# --- text and types ---


@query("text_standardize", r"""
SELECT doc_id, lower(trim(regexp_replace(text, '[\s\p{Z}\x0B\x1C-\x1F\x85]+', ' ', 'g'))) AS text FROM documents""")
def _(spark, folder):
    return text.standardize(table(spark, folder, "documents").select("doc_id", "text"), ["text"], case="lower")


@query("text_upper", r"""
SELECT p_partkey, upper(trim(regexp_replace('  ' || p_name || '   ' || p_type || ' ', '\s+', ' ', 'g'))) AS name FROM part""")
def _(spark, folder):
    p = table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit(" ")).alias("name"))
    return text.standardize(p, ["name"], case="upper")


@query("text_title", r"""
SELECT p_partkey, array_to_string(list_transform(
    regexp_extract_all(p_name || '-' || lower(p_type) || ' o''x 3rd', '[A-Za-z]+|[^A-Za-z]+'),
    lambda t: upper(t[1]) || lower(t[2:])), '') AS name FROM part""")
def _(spark, folder):
    p = table(spark, folder, "part").select(
        "p_partkey", F.concat("p_name", F.lit("-"), F.lower("p_type"), F.lit(" o'x 3rd")).alias("name"))
    return text.standardize(p, ["name"], case="title")


@query("coerce_numeric", """
SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS brand, TRY_CAST(p_type AS DOUBLE) AS p_type FROM part""")
def _(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand"), "p_type")
    return text.coerce(p, ["brand", "p_type", "p_partkey"], "numeric")


@query("coerce_string", f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM ({CUSTOMERS})")
def _(spark, folder):
    return text.coerce(customers(spark, folder).select("c_custkey", "c_nationkey"), target="string")


@query("coerce_binary", f"""
SELECT c_custkey, CAST(CASE WHEN c_acctbal IS NULL OR c_acctbal < 0 THEN 0 WHEN c_acctbal > 1 THEN 1 ELSE trunc(c_acctbal) END AS INTEGER) AS flag
FROM ({CUSTOMERS})""")
def _(spark, folder):
    c = customers(spark, folder)
    return c.select("c_custkey", text.to_binary(text.number_of(c, "c_acctbal")).alias("flag"))


@query("label_flags", """
SELECT p_partkey, upper(trim('  ' || lower(p_type) || ' ')) AS label,
    CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 0 ELSE 1 END::INTEGER AS unknown FROM part""")
def _(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", F.concat(F.lit("  "), F.lower("p_type"), F.lit(" ")).alias("label"))
    return text.label_flags(p, "label", ("ECONOMY", "PROMO"), "unknown")


# --- encoding ---


@query("label_encode", f"""
WITH o AS ({PRIORITISED})
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'nan')) - 1 AS INTEGER) AS o_orderpriority FROM o""")
def _(spark, folder):
    return encode.label(prioritised(spark, folder), ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@query("label_encode_wide", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS c_name FROM customer""")
def _(spark, folder):
    return encode.label(table(spark, folder, "customer").select("c_custkey", "c_name"), ["c_name"])


FLAGGED = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN l_returnflag END AS flag FROM lineitem"


@query("one_hot", f"""
SELECT l_orderkey, l_linenumber, {', '.join(f"CASE WHEN flag = '{v}' THEN 1 ELSE 0 END::INTEGER AS flag_{v}" for v in 'ANR')} FROM ({FLAGGED})""")
def _(spark, folder):
    li = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 7, F.col("l_returnflag")).alias("flag"))
    return encode.one_hot(li, ["flag"])


@query("one_hot_append", f"""
SELECT l_orderkey, l_linenumber, flag, {', '.join(f"coalesce(flag = '{v}', false) AS rf_{v}" for v in 'NR')} FROM ({FLAGGED})""")
def _(spark, folder):
    li = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 7, F.col("l_returnflag")).alias("flag"))
    return encode.one_hot_append(li, "flag", prefix="rf", drop_first=True)


# --- recipes ---


@query("recipe_clean", f"""
WITH c AS ({CUSTOMERS}),
m AS (SELECT c_custkey, lower(c_mktsegment) AS seg, coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM c)) AS bal FROM c),
f AS (SELECT quantile_cont(bal, 0.25) AS q1, quantile_cont(bal, 0.75) AS q3 FROM m),
k AS (SELECT m.* FROM m, f WHERE bal BETWEEN q1 - (q3 - q1) * 0.5 AND q3 + (q3 - q1) * 0.5),
s AS (SELECT avg(bal) AS mean, stddev_pop(bal) AS std FROM k)
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY seg) - 1 AS INTEGER) AS seg, round((bal - mean) / std, 6) AS bal FROM k, s""")
def _(spark, folder):
    rows = customers(spark, folder).select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    out = steps.run(rows, [
        {"action": "fill", "cols": ["bal"], "strategy": "mean"},
        {"action": "remove_duplicates"},
        {"action": "standardize_text", "cols": ["seg"]},
        {"action": "outliers", "column": "bal", "k": 0.5},
        {"action": "scale", "cols": ["bal"]},
        {"action": "label_encode", "cols": ["seg"]},
    ])
    return rounded(out, 6, "bal")
