"""Files, versions and streams."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import schema
from sievework.sources import files
from sievework.sources.versions import Versions
from sievework.streaming import live


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    files.write_csv(df, str(tmp_path / "t.csv"))
    assert files.read_table(spark, str(tmp_path / "t.csv")).count() == 2
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    assert files.read_table(spark, str(tmp_path / "a.json")).count() == 2
    df.write.orc(str(tmp_path / "t.orc"))
    assert files.read_table(spark, str(tmp_path / "t.orc")).count() == 2
    for bad in ("absent.csv", "absent.json", "table.xyz"):
        with pytest.raises(ValueError):
            files.read_table(spark, str(tmp_path / bad))


def test_event_sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("Title,,,,\nEvent,x,ab_version,,\n,(not set),A,B,Totals\nscroll,1,2,3,6,extra\ntab_switch,0,1,1,2\n")
    rows = files.read_event_sheet(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("scroll", "1", "2", "3", "6"), ("tab_switch", "0", "1", "1", "2")]
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_event_sheet(spark, str(path))


def test_versions(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "store"))
    df = spark.range(5).toDF("x")
    assert store.register(df, "original", "first") == "original"
    assert store.register(df, "original", "again") == "original_01"
    assert store.register(df.where("x > 1"), "cleaned", "c", "original", "where", "cleaning") == "cleaned_01"
    assert store.register(df, "feature", "f", "cleaned_01", kind="feature") == "feature_01"
    store.overwrite("cleaned_01", store.load("cleaned_01").where("x > 2"), "more", "cleaning")
    rows = {r["key"]: r for r in store.history().collect()}
    assert rows["cleaned_01"]["rows"] == 2 and rows["cleaned_01"]["transform"] == "where | more"
    state = store.stages("feature_01").first()
    assert state["cleaned"] and state["feature_engineered"]
    assert state["lineage_keys"] == ["feature_01", "cleaned_01", "original"]
    assert not store.stages("original").first()["cleaned"]
    with pytest.raises(ValueError):
        store.keep_source("cleaned_01")
    store.keep_source("original_01")
    assert [r["key"] for r in store.history().collect()] == ["original_01"]
    assert store.register(df, "cleaned", "new", "original_01") == "cleaned_01"
    assert store.load("cleaned_01").count() == 5
    with pytest.raises(ValueError):
        store.load("absent")


def test_stream_drops_repeats_and_counts(spark, tmp_path):
    rows = spark.range(200).select(
        F.col("id").alias("event_id"), (F.timestamp_seconds(F.col("id") * 600 + 1704067200)).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 2 == 0, "click").otherwise("view").alias("event_type"), (F.col("id") % 7).alias("user_id"))
    rows.unionByName(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.open_stream(spark, str(tmp_path / "in"), "*.parquet", rows.schema)
    assert live.drain(live.drop_repeats(stream, ["event_id"])).count() == 200
    counts = live.drain(live.stream_counts(stream, "event_type", F.lit("A"), window="6 hours")).collect()
    assert counts and all(r["A"] == r["total"] == 36 for r in counts)
    closed = live.drain(live.stream_sessions(stream, gap="2 hours"))
    assert closed.count() == 0


def test_drained_stream_gives_open_windows_too(spark, tmp_path):
    rows = spark.range(400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600 + F.when(F.col("id") > 250, 50_000).otherwise(0)
                                                           + 1704067200).alias("ts"),
        F.when(F.col("id") % 3 == 0, "click").otherwise("view").alias("event_type"), (F.col("id") % 2).alias("user_id"))
    for i in range(3):  # in order, so that none is late
        rows.where(f"event_id div 150 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def same(make, still_open):
        batch, written = make(rows), live.drain(make(stream))
        whole = live.drain(make(stream), still_open=still_open)
        assert written.count() < batch.count() and whole.columns == batch.columns
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, batch.collect()))

    same(lambda e: live.stream_counts(e, "event_type", F.lit("B"), window="5 hours"), live.open_counts)
    same(lambda e: live.stream_sessions(e, gap="30 minutes"), live.open_sessions)
    (tmp_path / "none").mkdir()
    none = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "none"))
    assert live.drain(live.stream_sessions(none), still_open=live.open_sessions).count() == 0


def test_column_types(spark):
    df = spark.createDataFrame([(1, "a", True)], "n int, s string, b boolean")
    got = [(r["column"], r["is_numeric"], r["is_categorical"]) for r in schema.column_types(df).collect()]
    assert got == [("n", True, False), ("s", False, True), ("b", False, True)]
    assert schema.standardize_names(df.toDF(" N ", "S", "b")).columns == ["n", "s", "b"]


def test_event_sheet_wider_than_its_first_row(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("note\n" + "," * 25 + "ab_version\nskipped\nclick,1,2,3,6\n")
    assert [tuple(r) for r in files.read_event_sheet(spark, str(path)).collect()] == [("click", "1", "2", "3", "6")]
