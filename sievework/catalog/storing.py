"""File and version queries: what is written comes back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.catalog.cleaning import CUSTOMERS, customers
from sievework.catalog.registry import query, rounded, table
from sievework.catalog.testing import CLEANED, sheet
from sievework.functions.work import new_folder
from sievework.operators import experiment, features, missing
from sievework.sources import files
from sievework.sources.versions import Versions


@query("csv_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, folder):
    target = new_folder(spark, "csv") + ".csv"
    files.write_csv(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), target)
    return files.read_table(spark, target, schema="o_orderkey long, o_orderstatus string, o_totalprice double")


@query("csv_inferred", "SELECT p_partkey::INTEGER AS p_partkey, p_name, p_size, p_retailprice FROM part")
def _(spark, folder):
    target = new_folder(spark, "csv") + ".csv"
    files.write_csv(table(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), target)
    return files.read_table(spark, target)


@query("json_lines", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, folder):
    target = new_folder(spark, "json") + ".jsonl"
    table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal").write.json(target)
    return files.read_table(spark, target)


@query("orc_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, folder):
    target = new_folder(spark, "orc") + ".orc"
    table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.orc(target)
    return files.read_table(spark, target)


@query("event_sheet", f"WITH {CLEANED} SELECT event, not_set, \"A\", \"B\", total, total_match FROM cleaned")
def _(spark, folder):
    target = new_folder(spark, "sheet")
    head = [("Report", None, None, None, None), ("Event name", "ab_version", None, None, None),
            (None, "(not set)", "A", "B", "Totals")]
    rows = sheet(spark, folder)
    # The header lines and a few counts per event name; one file, as an export would be.
    top = spark.createDataFrame([(i, *line) for i, line in enumerate(head)], "o int, event string, not_set string, A string, B string, total string")
    both = top.unionByName(rows.withColumn("o", F.lit(len(head))))
    both.coalesce(1).sortWithinPartitions("o").drop("o").write.csv(target)
    found = experiment.clean_event_counts(files.read_event_sheet(spark, target))
    return found.select("event", "not_set", "A", "B", "total", "total_match")


def _store(spark, folder) -> Versions:
    store = Versions(spark, new_folder(spark, "versions"))
    first = store.register(customers(spark, folder), "original", "Customers")
    clean = store.register(missing.drop_rows(store.load(first)), "cleaned", "No gaps", first, "drop_rows", "cleaning")
    featured = store.register(features.add(store.load(clean), "square", "c_acctbal"), "feature", "Squared", clean,
                              "square", "feature")
    store.overwrite(featured, features.add(store.load(featured), "cube", "c_acctbal"), "cube", "feature")
    store.register(table(spark, folder, "nation"), "loaded", "Nations")
    return store


@query("versions_history", f"""
WITH c AS (SELECT count(*) AS n, count(c_acctbal) AS full FROM ({CUSTOMERS}))
SELECT 'original' AS key, 'Customers' AS label, n AS rows, 5::INTEGER AS cols, '-' AS source, '-' AS transform FROM c
UNION ALL SELECT 'cleaned_01', 'No gaps', "full", 5, 'original', 'drop_rows' FROM c
UNION ALL SELECT 'feature_01', 'Squared', "full", 7, 'cleaned_01', 'square | cube' FROM c
UNION ALL SELECT 'loaded_01', 'Nations', count(*), 3, '-', '-' FROM nation""")
def _(spark, folder):
    return _store(spark, folder).history().drop("created_at")


@query("versions_lineage", """
SELECT 0::INTEGER AS depth, 'feature_01' AS key UNION ALL SELECT 1, 'cleaned_01' UNION ALL SELECT 2, 'original'""")
def _(spark, folder):
    return _store(spark, folder).lineage("feature_01")


@query("versions_stages", """
SELECT true AS loaded, true AS cleaned, true AS feature_engineered, 'feature_01,cleaned_01,original' AS lineage_keys""")
def _(spark, folder):
    out = _store(spark, folder).stages("feature_01")
    return out.withColumn("lineage_keys", F.array_join("lineage_keys", ","))


@query("versions_keep_source", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, folder):
    store = _store(spark, folder)
    store.keep_source("loaded_01")
    (left,) = [r["key"] for r in store.history().select("key").collect()]
    return store.load(left)


@query("versions_reload", f"""
SELECT c_custkey, round(c_acctbal * c_acctbal, 4) AS c_acctbal_squared FROM ({CUSTOMERS}) WHERE c_acctbal IS NOT NULL""")
def _(spark, folder):
    return rounded(_store(spark, folder).load("feature_01").select("c_custkey", "c_acctbal_squared"), 4, "c_acctbal_squared")
