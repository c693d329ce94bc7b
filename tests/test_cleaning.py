"""Edge semantics of cleaning operators on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.functions import work
from sievework.operators import dedup, encode, features, knn, missing, scaling, text
from sievework.operators import encode as encode_module
from sievework.plans import fits, steps


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame(
        [(1, 1.0, "a", None), (2, float("nan"), None, None), (3, None, "b", None), (4, 4.0, "b", None)],
        "id int, x double, s string, void double")


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_nan_and_null_are_both_missing(gaps):
    assert column(missing.drop_rows(gaps, ["x"]), "id") == [1, 4]
    assert missing.drop_cols(gaps).columns == ["id"]
    assert missing.dropped_rows_report(gaps, ["x"]).first()["rows_removed"] == 2


def test_fill_strategies(gaps):
    assert column(missing.fill(gaps, ["x", "void", "s"], "mean"), "x") == [1.0, 2.5, 2.5, 4.0]
    assert column(missing.fill(gaps, ["x"], "median"), "x") == [1.0, 2.5, 2.5, 4.0]
    assert column(missing.fill(gaps, ["s"], "mode"), "s") == ["a", "b", "b", "b"]
    assert column(missing.fill(gaps, ["void"], "mean"), "void") == [None] * 4
    assert column(missing.fill(gaps, ["x", "s"], "constant"), "x") == [1.0, 0.0, 0.0, 4.0]
    with pytest.raises(ValueError):
        missing.fill(gaps, ["x"], "guess")


def test_mode_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "s string")
    assert missing.fit_fill(df, ["s"], "mode") == {"s": "a"}


def test_fill_feature_errors(gaps):
    with pytest.raises(ValueError):
        missing.fill_feature(gaps, "s", "mean")
    with pytest.raises(ValueError):
        missing.fill_feature(gaps, "void", "mode")
    with pytest.raises(ValueError):
        missing.fill_feature(gaps, "x", "constant")
    out = missing.fill_feature(gaps, "x", "constant", 7.0, into="y")
    assert column(out, "y") == [1.0, 7.0, 7.0, 4.0]


def brute_force(pdf, targets, feats, k):
    ref = pdf[pdf[targets].notna().all(axis=1) & pdf[feats].notna().all(axis=1)].sort_values("id")
    z = ((ref[feats] - ref[feats].mean()) / ref[feats].std(ddof=0).replace(0, 1)).to_numpy()
    out = {}
    for _, row in pdf[pdf[targets].isna().any(axis=1) & pdf[feats].notna().all(axis=1)].iterrows():
        q = ((row[feats] - ref[feats].mean()) / ref[feats].std(ddof=0).replace(0, 1)).to_numpy(float)
        d = ((q - z) ** 2).sum(axis=1)
        near = np.lexsort((ref["id"].to_numpy(), d.round(12)))[:k]
        out[int(row["id"])] = [ref[t].to_numpy()[near].mean() if math.isnan(row[t]) else row[t] for t in targets]
    return out


@pytest.mark.parametrize("rows_per_box, piece, depth", [(100_000, 50_000, 10), (150, 40, 10), (20, 100, 2)])
def test_knn_equals_brute_force(spark, monkeypatch, rows_per_box, piece, depth):
    """One box, boxes cut once, and boxes cut again within boxes."""
    monkeypatch.setattr(knn, "ROWS_PER_BOX", rows_per_box)
    monkeypatch.setattr(knn, "PIECE_ROWS", piece)
    monkeypatch.setattr(knn, "DEPTH", depth)
    monkeypatch.setattr(knn, "SMALL_WORK", 0)
    rng = np.random.default_rng(3)
    n = 1200
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float),
                        "y": rng.normal(size=n), "w": rng.normal(size=n), "label": "t"})
    pdf.loc[:400, ["a", "b"]] = [0.25, 2.0]  # a third of the rows share their features
    pdf.loc[rng.random(n) < 0.1, "y"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "w"] = np.nan
    pdf.loc[rng.random(n) < 0.02, "a"] = np.nan
    got = knn.knn_impute(spark.createDataFrame(pdf).repartition(3), ["y", "w"], 4, id_col="id",
                         features=["a", "b"]).toPandas().set_index("id")
    expected = brute_force(pdf, ["y", "w"], ["a", "b"], 4)
    for i, values in expected.items():
        assert np.allclose(got.loc[i, ["y", "w"]].to_numpy(float), values), i
    lost = pdf[pdf[["y", "w"]].isna().any(axis=1) & pdf["a"].isna()]
    assert len(got) == n - len(lost)
    assert got[["y", "w"]].notna().all().all()


def test_approximate_knn_finds_most_neighbours(spark, monkeypatch):
    monkeypatch.setattr(knn, "ROWS_PER_BOX", 60)
    monkeypatch.setattr(knn, "SAMPLE_PER_BOX", 1 << 20)
    rng = np.random.default_rng(5)
    n, k, z = 1500, 5, ["a", "b", "c", "d"]
    pdf = pd.DataFrame(rng.normal(size=(n, 4)), columns=z).assign(rid=np.arange(n), y=rng.normal(size=n))
    imp = spark.createDataFrame(pdf[z].iloc[:200].assign(qid=np.arange(200)))
    ref = spark.createDataFrame(pdf.iloc[200:])
    found = knn._probable(imp, ref, z, ["y"], k).toPandas().sort_values(["qid", "dist"]).groupby("qid").head(k)
    x, known = pdf[z].to_numpy()[:200], pdf[z].to_numpy()[200:]
    near = np.argsort(((x[:, None] - known[None]) ** 2).sum(axis=2), axis=1)[:, :k] + 200
    caught = [len(set(found.loc[found.qid == q, "rid"]) & set(near[q])) for q in range(200)]
    assert sum(caught) / (200 * k) >= 0.9
    out = knn.knn_impute(spark.createDataFrame(pdf.assign(y=pdf["y"].where(pdf.index >= 50))), ["y"], k, id_col="rid", approximate=True)
    assert out.count() == n and out.where("y IS NULL").count() == 0


def test_knn_errors_and_no_gap(spark):
    full = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 3.0)], "id int, x double, y double")
    assert knn.knn_impute(full, ["y"], id_col="id").count() == 2
    with pytest.raises(ValueError):
        knn.knn_impute(full.select("id", F.col("x").cast("string").alias("x"), "y"), ["x"], id_col="id")
    only = spark.createDataFrame([("a", None), ("b", 1.0)], "id string, y double")
    with pytest.raises(ValueError):
        knn.knn_impute(only, ["y"], id_col="id")


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x"), (None, "x"), (2, "y"), (2, "y")], "a int, b string")
    assert dedup.remove(df).count() == 4
    assert dedup.copies(df).count() == 5
    row = dedup.overview(df).first()
    assert (row["n_rows"], row["n_extra_copies"], row["n_all_copies"], row["pct"]) == (7, 3, 5, 71.43)
    assert dedup.remove(dedup.remove(df)).count() == 4
    empty = dedup.overview(df.where("a = 99")).first()
    assert (empty["n_rows"], empty["n_all_copies"], empty["pct"]) == (0, 0, 0.0)


def test_scaling_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (4.0, 5.0)], "x double, c double")
    for method in scaling.METHODS:
        out = scaling.scale(df, ["x", "c"], method)
        assert column(out, "c", "c") == [0.0] * 4
        assert out.where("x is null").count() == 1
    minmax = [r["x"] for r in scaling.scale(df, ["x"], "minmax").collect() if r["x"] is not None]
    assert min(minmax) == 0 and max(minmax) == 1
    with pytest.raises(ValueError):
        scaling.zscore(df, "c")
    with pytest.raises(ValueError):
        scaling.normalize(df, "c")
    with pytest.raises(ValueError):
        scaling.scale(df.withColumn("v", F.lit(None).cast("double")), ["v"])


def test_outliers_keep_or_drop_missing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(1000.0,), (None,), (float("nan"),)], "x double")
    assert scaling.outliers(df, "x").count() == 20
    capped = scaling.outliers(df, "x", "cap")
    assert capped.where("x is null").count() == 2
    assert capped.agg(F.max("x")).first()[0] == scaling.fit_fences(df, "x")["upper_bound"]
    assert scaling.outlier_report(df, "x").first()["n_outliers"] == 1
    assert "v_clean" not in scaling.cap_upper(df.withColumn("v", F.lit(None).cast("double")), ["x", "v"]).columns


def test_outlier_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit(1).alias("y")).write.parquet(path)
    plan = scaling.outliers(spark.read.parquet(path), "x").select("x")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(x," in plan.split("PushedFilters")[1]
    assert "ReadSchema: struct<x:double>" in plan


def test_text(spark):
    df = spark.createDataFrame([("it's o-neil 3rd",), ("  A\t b  c ",), ("",), (None,)], "s string")
    assert [r[0] for r in text.standardize(df, case="title").collect()] == ["It'S O-Neil 3Rd", "A B C", "", None]
    assert [r[0] for r in text.standardize(df, case="none", null_text="nan").collect()][3] == "nan"
    values = spark.createDataFrame([(v,) for v in ["1d", " 7 ", "1e3", "inf", "", "-.5", "5.", "1_0"]], "s string")
    assert [r[0] for r in text.coerce(values).collect()] == [None, 7.0, 1000.0, None, None, -0.5, 5.0, None]


def test_encoding(spark, monkeypatch):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "z")], "id int, s string")
    assert column(encode.label(df, ["s"]), "s") == [1, 2, 0, 3]
    hot = encode.one_hot(df, ["s"])
    assert hot.columns == ["id", "s_a", "s_b", "s_z"]
    assert column(hot, "s_a") == [0, 0, 1, 0]
    assert encode.one_hot_append(df, "s", drop_first=True).columns == ["id", "s", "s_b", "s_z"]
    many = spark.range(51).select(F.col("id").cast("string").alias("s"))
    with pytest.raises(ValueError):
        encode.one_hot_append(many, "s")
    monkeypatch.setattr(encode_module, "SMALL_VALUE_TABLE", 10)
    monkeypatch.setattr(encode_module, "VALUES_PER_RANGE", 7)
    names = sorted(str(i) for i in range(51))
    out = {r["k"]: r["s"] for r in encode.label(many.withColumn("k", F.col("s")), ["s"]).collect()}
    assert out == {name: i for i, name in enumerate(names)}


def test_features(spark):
    df = spark.createDataFrame([(0.0, 2.0), (-1.0, 0.0), (3.0, None)], "x double, y double")
    assert column(features.add(df, "LOG", "x"), "log_x", "x") == [-math.inf, 0.0, math.log1p(3)]
    with pytest.raises(ValueError):
        features.add(df.withColumn("x", F.col("x") - 1), "log", "x")
    assert column(features.add(df, "ratio", "x", "y"), "x_div_y", "x") == [None, 0.0, None]
    assert column(features.add(df, "interaction", "x", "y"), "x_x_y", "x") == [0.0, 0.0, None]
    assert column(features.add(df, "custom_expr", expr="x * 2 + 1", into="z"), "z", "x") == [-1.0, 1.0, 7.0]
    for bad in ({"method": "nope", "column": "x"}, {"method": "log"}, {"method": "ratio", "column": "x"},
                {"method": "log", "column": "absent"}, {"method": "custom_expr", "expr": "absent + 1", "into": "z"},
                {"method": "custom_expr", "expr": "x"}, {"method": "binning", "column": "x", "bins": 1}):
        with pytest.raises(ValueError):
            features.add(df, **bad)
    assert features.catalogue(spark).count() == 12


@pytest.mark.parametrize("values, bins", [
    (np.arange(11.0), 4), (np.array([5.0, 5.0, 5.0]), 3), (np.array([0.001, 0.25, 0.5, 7.0]), 5),
    (np.random.default_rng(0).normal(size=500), 30), (np.array([0.0, 0.0]), 2)])
def test_binning_equals_cut(spark, values, bins):
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(values)), "x": values}))
    assert column(features.binning(df, "x", bins), "x_binned") == pd.cut(
        pd.Series(values), bins, labels=False, include_lowest=True).tolist()
    labels = column(features.binning(df, "x", bins, labels=True), "x_binned")
    if values.min() < values.max():
        assert labels == pd.cut(pd.Series(values), bins, include_lowest=True).astype(str).tolist()


def test_recipe(spark, gaps):
    out = steps.run(gaps, [
        {"action": "fill", "cols": ["x"], "strategy": "mean"},
        {"action": "fill", "cols": ["s"], "strategy": "mode"},
        {"action": "drop_cols"},
        {"action": "feature", "method": "square", "column": "x"},
        {"action": "scale", "cols": ["x"], "method": "minmax"},
        {"action": "one_hot", "cols": ["s"]},
    ], settle_every=2)
    assert out.columns == ["id", "x", "x_squared", "s_a", "s_b"]
    assert column(out, "x") == [0.0, 0.5, 0.5, 1.0]
    with pytest.raises(ValueError):
        steps.run(gaps, [{"action": "nope"}])
    assert steps.preview(gaps, [{"action": "remove_duplicates"}], 2).count() == 2


def test_stored_fit(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    fences = scaling.fit_fences(df, "x")
    assert fits.read_fit(fits.fit_table(spark, {"x": fences})) == {"x": fences}


def test_stream_takes_up_a_newer_fit_without_restart(spark, tmp_path):
    fit, out = str(tmp_path / "fit"), str(tmp_path / "out")
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    low, width = scaling.fit_normalize(df, "x")
    fits.store(spark, fit, 1, {"x": {"centre": low, "width": width}})
    for part in range(2):
        df.where(f"x % 2 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def apply(batch, fitted):
        # The fit is made again while the stream runs: the next batch has it.
        fits.store(spark, fit, 2, {"x": {"centre": 100.0, "width": 1.0}})
        return scaling.apply_feature(batch, "x", (fitted["x"]["centre"], fitted["x"]["width"]), "scaled")

    fits.keep_applied(stream, fit, apply, out, str(tmp_path / "check"), available_now=True).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 10 and {r["batch"] for r in rows} == {0, 1}
    for r in rows:
        assert r["scaled"] == pytest.approx(r["x"] / 9 if r["batch"] == 0 else r["x"] - 100)


def test_features_apply_constants_of_other_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)], "x double")
    other = spark.createDataFrame([(0.0,), (8.0,), (9.0,), (None,)], "x double")
    got = scaling.apply_feature(other, "x", scaling.fit_zscore(df, "x"), "z").collect()
    assert got[0]["z"] == pytest.approx(-4 / np.std(range(9), ddof=1)) and got[3]["z"] is None
    assert [r["x_binned"] for r in features.apply_cut(other, "x", features.fit_cut(df, "x", 4)).collect()] == [0, 3, None, None]


@pytest.mark.parametrize("rows_per_box", [4, 4096])
def test_knn_needs_no_whole_or_distinct_ids(spark, monkeypatch, rows_per_box):
    monkeypatch.setattr(knn, "ROWS_PER_BOX", rows_per_box)
    monkeypatch.setattr(knn, "SMALL_WORK", 0)
    made = [(i, float(i), float(i)) for i in range(1, 21)] + [(None, 3.0, None), (30, 3.0, None), (30, 17.0, None), (None, 12.0, 12.0)]
    rows = spark.createDataFrame(made, "id long, f double, v double")
    got = sorted((r.f, r.v) for r in knn.knn_impute(rows, ["v"], 1, id_col="id").collect())
    assert got == sorted((f, v if v is not None else f) for _, f, v in made)


def test_one_hot_of_many_values(spark):
    rows = spark.range(60).selectExpr("CAST(id AS STRING) AS c")
    assert len(encode.one_hot(rows, ["c"]).columns) == 60
    with pytest.raises(ValueError):
        encode.one_hot_append(rows, "c")


def test_recipe_writes_a_shuffled_table_before_it_is_read_again(spark, gaps, monkeypatch):
    written = []

    def settle(df):
        written.append(df)
        return work.settle(df)

    monkeypatch.setattr(steps, "settle", settle)
    recipe = [{"action": "remove_duplicates"}, {"action": "standardize_text", "cols": ["s"]},
              {"action": "scale", "cols": ["x"]}, {"action": "outliers", "column": "x"}]
    rows = spark.range(300).selectExpr("id % 90 AS x", "concat('t', id % 9) AS s").where("x % 4 <> 3")
    out = steps.run(rows, recipe)
    assert len(written) == 1  # after the duplicates; scaled rows are read again
    plain = steps.run(rows, recipe, settle_shuffles=False)
    assert len(written) == 1 and sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))
    steps.run(rows, [{"action": "scale", "cols": ["x"]}, {"action": "remove_duplicates"}])
    assert len(written) == 1
    first = steps.preview(rows, recipe[:1], 3, ["x", "s"]).collect()
    assert [r["x"] for r in first] == [0, 1, 2]


def test_indicator_columns_are_counted_first(spark):
    rows = spark.range(30).selectExpr("cast(id AS string) AS s")
    with pytest.raises(ValueError, match="30 distinct"):
        encode.one_hot(rows, ["s"], max_values=20)
    assert len(encode.one_hot(rows, ["s"], max_values=30).columns) == 30
