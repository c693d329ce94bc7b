"""Quantiles, charts, models, profile and experiment operators against pandas and numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.functions import quantiles as q
from sievework.functions.stats import correlation_p_value
from sievework.operators import correlation, events, experiment, explore, models, profile


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(1)
    n = 1500
    pdf = pd.DataFrame({"a": rng.integers(0, 40, n).astype(float), "b": rng.normal(size=n).round(2), "k": 1.0})
    pdf["c"] = (pdf["b"] + rng.normal(size=n)).round(1)
    pdf.loc[:500, "a"] = 7.0
    pdf.loc[rng.random(n) < 0.1, "c"] = np.nan
    pdf["g"] = np.where(pdf["a"] < 10, "lo", np.where(pdf["a"] < 30, "mid", None))
    return pdf


@pytest.fixture(scope="module")
def df(spark, cloud):
    return spark.createDataFrame(cloud).cache()


@pytest.mark.parametrize("small, sample, accuracy", [(50_000, 50_000, 5000), (40, 300, 100)])
def test_quantiles_are_exact(df, cloud, monkeypatch, small, sample, accuracy):
    monkeypatch.setattr(q, "SMALL_ROWS", small)
    monkeypatch.setattr(q, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(q, "ACCURACY", accuracy)
    probs = [0, 0.25, 0.5, 0.99, 1]
    got = q.quantiles(df, {c: F.nanvl(c, F.lit(None)) for c in "abck"}, probs)
    for c in "abck":
        assert np.allclose(got[c], cloud[c].quantile(probs)), c
    assert q.quantiles(df.where("a > 99"), {"a": F.col("a")}, [0.5]) == {"a": [None]}


@pytest.mark.parametrize("ranges", [1, 12])
def test_grouped_quantiles(df, cloud, ranges):
    got = q.grouped_quantiles(df, ["g"], F.nanvl("c", F.lit(None)), {"q1": 0.25, "q2": 0.5}, ranges).toPandas()
    want = cloud.groupby("g", dropna=False)["c"].quantile([0.25, 0.5]).unstack()
    for _, row in got.iterrows():
        key = row["g"] if row["g"] else np.nan
        assert np.allclose([row["q1"], row["q2"]], want.loc[key].tolist())


def naive_tau(x, y):
    sx, sy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    return (sx * sy).sum() / math.sqrt(np.abs(sx).sum() * np.abs(sy).sum())


@pytest.mark.parametrize("strip", [500_000, 100, 50])
def test_kendall(df, cloud, monkeypatch, strip):
    monkeypatch.setattr(correlation, "CELLS_PER_STRIP", strip)
    for a, b in (("a", "b"), ("b", "c")):
        pairs = cloud[[a, b]].dropna().to_numpy()
        assert correlation.kendall(df, a, b) == pytest.approx(naive_tau(pairs[:, 0], pairs[:, 1]))


def test_correlation_matrices(df, cloud):
    for method in ("pearson", "spearman"):
        got = correlation.corr_matrix(df, ["a", "b", "c", "k"], method).toPandas().pivot(
            index="col_a", columns="col_b", values="r")
        for a in "abc":
            for b in "abc":
                pair = cloud[[a, b]].dropna() if a != b else cloud[[a]].dropna().assign(z=lambda d: d[a])
                ranks = pair.rank() if method == "spearman" else pair
                assert got.loc[a, b] == pytest.approx(np.corrcoef(ranks.to_numpy().T)[0, 1], abs=6e-5)
        assert got["k"].isna().all()
    with pytest.raises(ValueError):
        correlation.corr_matrix(df, ["a"])
    with pytest.raises(ValueError):
        correlation.corr_matrix(df, ["a", "b"], "other")


def test_p_value():
    # r = 0.5 with 18 degrees of freedom; t = 2.4495, two-sided p = 0.02477.
    assert correlation_p_value(0.5, 20) == pytest.approx(0.024765, abs=1e-5)
    assert correlation_p_value(0.0, 20) == pytest.approx(1.0)
    assert correlation_p_value(0.3, 2) is None


@pytest.mark.parametrize("order", [1, 2, 5])
def test_poly_fit(df, cloud, order):
    pairs = cloud[["b", "c"]].dropna()
    got = models.poly_fit(df, "b", "c", order).orderBy(F.desc("power")).toPandas()["coefficient"]
    assert np.allclose(got, np.polyfit(pairs["b"], pairs["c"], order))
    assert models.regression(df, "b", "c", order).count() == 200


def test_regression_errors(df):
    with pytest.raises(ValueError):
        models.poly_fit(df, "b", "c", log_x=True)
    with pytest.raises(ValueError):
        models.regression(df, "b", "c", 2, robust=True)
    with pytest.raises(ValueError):
        models.poly_fit(df, "b", "c", 6)


def test_robust_line(df, cloud):
    pairs = cloud[["b", "c"]].dropna()
    x, y = np.c_[pairs["b"], np.ones(len(pairs))], pairs["c"].to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(60):
        r = np.abs(y - x @ beta)
        s = np.median(r) / 0.6745
        w = np.sqrt(np.where(r <= 1.345 * s, 1, 1.345 * s / r))
        beta = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]
    got = models.robust_fit(df, "b", "c").orderBy(F.desc("power")).toPandas()["coefficient"]
    assert np.allclose(got, beta, atol=1e-6)


def naive_lowess(x, y):
    n, k = len(x), int(0.66 * len(x) + 1e-10)
    at, weight = np.unique(x), np.ones(n)
    for _ in range(4):
        fit = []
        for a in at:
            d = np.abs(x - a)
            u = np.minimum(d / np.sort(d)[k - 1], 1)
            w = (1 - u ** 3) ** 3 * weight
            w = w / w.sum()
            m = (w * x).sum()
            v = max((w * (x - m) ** 2).sum(), 1e-12)
            fit.append((w * (1 + (a - m) * (x - m) / v) * y).sum())
        r = np.abs(y - np.interp(x, at, fit))
        u = np.minimum(r / (6 * np.median(r)), 1)
        weight = (1 - u ** 2) ** 2
    return at, np.array(fit)


def test_lowess(df, cloud, monkeypatch):
    pairs = cloud[["b", "c"]].dropna()
    at, fit = naive_lowess(pairs["b"].to_numpy(), pairs["c"].to_numpy())
    got = models.lowess(df, "b", "c").toPandas()
    assert np.allclose(got["x"], at) and np.allclose(got["y_fit"], fit)
    monkeypatch.setattr(models, "MAX_ANCHORS", 100)
    rough = models.lowess(df, "b", "c").toPandas()
    assert np.abs(np.interp(at, rough["x"], rough["y_fit"]) - fit).max() < 0.01


@pytest.mark.parametrize("shape", ["even", "gap", "heavy"])
def test_lowess_at_every_x_of_many(spark, monkeypatch, shape):
    rng = np.random.default_rng(3)
    x = {"even": rng.uniform(-5, 5, 1300), "gap": np.r_[rng.normal(0, 1, 700), rng.normal(1e4, 1, 600), rng.uniform(5, 9990, 15)],
         "heavy": np.r_[np.exp(3 * rng.normal(size=1150)), np.full(150, 2.0)]}[shape]
    y = np.sin(x) + rng.normal(0, 0.3, len(x))
    y[::50] += 20
    at, fit = naive_lowess(x, y)
    assert len(at) > models.MAX_ANCHORS
    monkeypatch.setattr(models, "BLOCK_CELLS", 40)
    frame = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(3)
    got = models.lowess(frame, "x", "y").toPandas()
    assert len(got) == len(at) and np.allclose(got["x"], at) and np.allclose(got["y_fit"], fit, atol=1e-6)
    if shape == "even":
        more = frame.unionByName(spark.createDataFrame([(0.123, None), (None, 1.0), (77.0, None)], "x double, y double"))
        rows = models.with_lowess(more, "x", "y").toPandas()
        known = rows["x"].notna()
        assert len(rows) == 1303 and rows["y_fit"][~known].isna().all()
        assert np.allclose(rows["y_fit"][known], np.interp(rows["x"][known], at, fit), atol=1e-6)


def test_density(df, cloud):
    pairs = cloud[["b", "c"]].dropna().to_numpy()
    inv = np.linalg.inv(np.cov(pairs.T) * len(pairs) ** (-1 / 3))
    norm = len(pairs) * 2 * np.pi / math.sqrt(np.linalg.det(inv))
    for row in explore.density2d(df, "b", "c", 8).collect():
        d = pairs - [row["x"], row["y"]]
        assert row["density"] == pytest.approx(np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, inv, d)).sum() / norm)


def test_binned_density_keeps_its_bound(spark, df, cloud):
    pairs = cloud[["b", "c"]].dropna().to_numpy()
    kernel = np.cov(pairs.T) * len(pairs) ** (-1 / 3)
    bound = 1 / (4 * explore.CELLS_PER_WIDTH ** 2) / (2 * np.pi * math.sqrt(np.linalg.det(kernel)))
    for grid in (1, 9):
        exact = explore.density2d(df, "b", "c", grid).orderBy("gx", "gy").toPandas()
        got = explore.density2d(df, "b", "c", grid, approximate=True).orderBy("gx", "gy").toPandas()
        assert len(got) == grid * grid and np.allclose(got[["x", "y"]], exact[["x", "y"]])
        error = np.abs(got["density"] - exact["density"]).max()
        assert error <= bound and (grid == 1 or error < 1e-3 * exact["density"].max())
    # Two heaps far apart: grid points that no kernel reaches are zero, and none is missing.
    far = spark.createDataFrame([(float(i % 7 + 1e4 * (i % 2)), float(i % 5 - 1e4 * (i % 3))) for i in range(4000)], "x double, y double")
    rows = explore.density2d(far, "x", "y", 6, approximate=True).toPandas()
    assert len(rows) == 36 and rows["density"].min() >= 0


@pytest.mark.parametrize("name, bins", [("b", 30), ("a", 13), ("k", 4), ("b", "auto")])
def test_histogram(df, cloud, name, bins):
    counts, edges = np.histogram(cloud[name], bins)
    got = explore.histogram(df, name, bins).orderBy("bin").toPandas()
    assert got["value"].tolist() == counts.tolist()
    assert np.allclose(got["lo"], edges[:-1]) and np.allclose(got["hi"], edges[1:])
    shares = explore.histogram(df, name, bins, normalize=True).agg(F.sum("value")).first()[0]
    assert shares == pytest.approx(1.0)


def test_histogram2d(df, cloud):
    pairs = cloud[["b", "c"]].dropna()
    counts, _, _ = np.histogram2d(pairs["b"], pairs["c"], 20)
    got = explore.histogram2d(df, "b", "c", 20).orderBy("bx", "by").toPandas()
    assert got["n"].tolist() == counts.ravel().astype(int).tolist()


def test_group_charts(df, cloud):
    lines = explore.group_histogram(df, "b", "g", 5, normalize=True)
    assert lines.count() == 15
    assert all(r[1] == pytest.approx(1) for r in lines.groupBy("label").agg(F.sum("y")).collect())
    assert {r["label"] for r in lines.select("label").collect()} == {"lo", "mid", explore.MISSING_LABEL}
    raw = explore.grouped_raw_line(df, "b", "c", "g", 10)
    assert [r["count"] for r in raw.groupBy("label").count().collect()] == [10, 10, 10]
    again = explore.grouped_raw_line(df.repartition(5), "b", "c", "g", 10)
    assert sorted(map(tuple, raw.collect())) == sorted(map(tuple, again.collect()))


def test_filters(df):
    report = {r["label"]: (r["n"], r["problem"]) for r in explore.filter_report(
        df, {"x": "a < 3", "bad": "a >", "y": "a > 100", "e": ""}).collect()}
    assert report["x"][0] == df.where("a < 3").count() and report["x"][1] is None
    assert report["bad"][1] and report["e"][1] and report["y"] == (0, "empty selection")
    both = explore.filter_groups(df, ["a < 10", "a < 20"])
    assert both.where("label = 'Group 1'").count() == df.where("a < 10").count()
    with pytest.raises(ValueError):
        explore.multiline(df, "b", group_by="g", filters=["a < 3"])
    with pytest.raises(ValueError):
        explore.where(df, "1 = 1")


def test_two_columns(df):
    assert explore.two_columns(df, "b", "c", kind="hist").count() == 1600
    assert explore.two_columns(df, "g", "b").columns[0] == "g"
    assert explore.two_columns(df, "b", "c", kind="scatter", n=50).count() == 50
    assert explore.two_columns(df, "b", "g", kind="swarm", n=20).count() == 20
    with pytest.raises(ValueError):
        explore.two_columns(df, "b", "c", kind="pie")
    with pytest.raises(ValueError):
        explore.two_columns(df.withColumn("t", F.current_timestamp()), "b", "t")


def test_profile(df, cloud):
    row = profile.stats_1d(df, "b").first()
    assert row["skew"] == pytest.approx(cloud["b"].skew()) and row["kurtosis"] == pytest.approx(cloud["b"].kurt())
    info = {r["column"]: r for r in profile.columns(df).collect()}
    assert info["c"]["missing"] == cloud["c"].isna().sum() and info["c"]["unique"] == cloud["c"].nunique()
    rough = {r["column"]: r for r in profile.columns(df, approximate=True).collect()}
    assert rough["c"]["missing"] == info["c"]["missing"]
    assert profile.recommend(df).first()["next_step"] == "handle_missing"
    one = df.limit(1)
    assert profile.box_stats(one.withColumn("g", F.lit("x")), "b", "g").first()["std"] is None
    empty = profile.stats_1d(df.where("a > 99"), "b").first()
    assert empty["n"] == 0 and empty["median"] is None


def test_busy_user_dwell_and_sessions(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({"event_id": np.arange(n), "user_id": np.where(rng.random(n) < 0.5, 1, rng.integers(2, 9, n)),
                        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.exponential(60, n).cumsum()), unit="s")})
    pdf["ts"] = pdf["ts"].dt.floor("us")
    table = spark.createDataFrame(pdf)
    ordered = pdf.sort_values(["user_id", "ts", "event_id"])
    step = ordered.groupby("user_id")["ts"].diff(-1).dt.total_seconds().mul(-1)
    want = np.floor(step + 0.5).set_axis(ordered["event_id"])
    got = events.dwell(table, slot_seconds=600).toPandas().set_index("event_id")["dwell_seconds"]
    assert got.sort_index().fillna(-1).tolist() == want.sort_index().fillna(-1).tolist()
    opens = ordered.groupby("user_id")["ts"].diff().dt.total_seconds().fillna(1e9) > 300
    session = opens.groupby(ordered["user_id"]).cumsum()
    sizes = ordered.groupby([ordered["user_id"], session]).size()
    found = events.sessions(table, gap_seconds=300, slot_seconds=600).toPandas()
    assert sorted(found["n_events"]) == sorted(sizes) and found["n_events"].sum() == n


def test_experiment_edges(spark):
    rows = [(" tab_switch ", "1", "2", "3", "6"), ("Total", "1", "1", "1", "3"), (None, "1", "1", "1", "3"),
            ("NaN", "0", "0", "0", "0"), ("ab_assignment", "x", None, "0", "0"), ("", "1", "1", "1", "3")]
    cleaned = experiment.clean_event_counts(spark.createDataFrame(rows, "event string, not_set string, A string, B string, total string"))
    got = {r["event"]: r for r in cleaned.collect()}
    assert set(got) == {"tab_switch", "ab_assignment"}
    assert got["tab_switch"]["total_match"] == 1 and got["ab_assignment"]["not_set_rate"] is None
    assert experiment.session_proxy(cleaned).first()["session_proxy"] == "not found"
    metrics = experiment.event_metrics(cleaned)
    assert metrics.where("A_per_session is not null").count() == 0
    assert experiment.untagged_assignment(metrics).first()["untagged"]
    with pytest.raises(ValueError):
        experiment.check_users(spark.createDataFrame([(1,)], "user_id int"))


def test_names_of_the_caller_are_in_nobodys_way(spark):
    from sievework.operators import events, explore, features
    rows = spark.createDataFrame([(1, 7, "2024-01-01 00:00:00", "a", 5), (2, 7, "2024-01-01 00:00:09", "b", 6)],
                                 "event_id int, user_id int, ts string, user string, slot int")
    assert sorted((r.event_id, r.dwell_seconds, r.user, r.slot) for r in events.dwell(rows).collect()) == [(1, 9, "a", 5), (2, None, "b", 6)]
    assert events.sessions(rows).first().n_events == 2
    flags = spark.createDataFrame([("y", "n"), ("n", "y"), ("y", "y")], "a string, b string")
    assert sorted((r.y, r.x, r.n) for r in explore.contingency(flags, "a", "b").collect()) == [
        ("n", "n", 0), ("n", "y", 1), ("y", "n", 1), ("y", "y", 1)]
    flat = spark.createDataFrame([(1e6,), (1e6,)], "v double")
    assert features.binning(flat, "v", 2, "b", labels=True).first().b == "(998999.999, 1000000.0]"


def test_bins_are_made_in_tasks(spark):
    from sievework.functions.bins import Bins
    assert Bins(0.0, 1.0, 46_000_000_000).table(spark).schema["bin"].dataType.typeName() == "long"
    made = Bins(0.0, 1.0, 7)
    assert [(r.lo, r.hi) for r in made.table(spark).orderBy("bin").collect()] == list(zip(made.edges, made.edges[1:]))
    rows = spark.createDataFrame([(v,) for v in np.linspace(0, 1, 500).tolist() + [1000.0]], "v double")
    hist = explore.histogram(rows, "v", "auto")
    assert hist.agg(F.sum("value")).first()[0] == 501 and hist.count() > 1000


def test_sketches_merge_and_feed_from_a_stream(spark, tmp_path):
    from sievework.functions import sketches
    from sievework.operators import missing, scaling
    rng = np.random.default_rng(8)
    x = rng.normal(size=30_000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.where(x > 0, np.nan, x), "g": np.arange(30_000) % 3})).repartition(6)

    def rank_error(found):
        return max(abs((x <= r.value).mean() - r.p) for r in found.where("column = 'x'").collect())

    parts = sketches.sketch(df, ["x", "y"], ["g"])
    assert parts.count() == 6
    whole = sketches.merge(parts)
    assert {r.column: r.n for r in whole.collect()} == {"x": 30_000, "y": int((x <= 0).sum())}
    assert rank_error(sketches.quantiles(whole, [0.0, 0.1, 0.5, 0.99])) <= sketches.RANK_ERROR
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    sketches.keep(stream, ["x"], str(tmp_path / "out"), str(tmp_path / "check"), available_now=True).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.select("batch").distinct().count() >= 2
    assert rank_error(sketches.quantiles(sketches.merge(stored), [0.25, 0.5])) <= sketches.RANK_ERROR
    filled = missing.fit_fill(df, ["y"], "median", approximate=True)["y"]
    assert abs((x[x <= 0] <= filled).mean() - 0.5) < 0.01
    centre, width = scaling.fit_scale(df, ["x"], "robust", approximate=True)["x"]
    assert abs(centre) < 0.05 and abs(width - 1.349) < 0.05
    assert sketches.approximate(df.where("false"), ["x"], [0.5]) == {"x": [None]}


def test_histograms_on_shared_edges(spark):
    from sievework.operators import profile
    before = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "x double")
    got = {(r.side, r.bin): (r.lo, r.hi, r.value) for r in profile.compare_histograms(before, before.where("x < 4"), "x", 3).collect()}
    assert got == {("before", 0): (0, 3, 3), ("before", 1): (3, 6, 3), ("before", 2): (6, 9, 4),
                   ("after", 0): (0, 3, 3), ("after", 1): (3, 6, 1), ("after", 2): (6, 9, 0)}
    assert profile.compare_histograms(before.where("false"), before.where("x IS NULL"), "x").count() == 0


@pytest.mark.parametrize("values, bins", [([999.0, 1000.0, 1001.0], 4), ([0.0, 10.0], 4), ([5.0, 5.0], 3), ([0.0, 0.0], 2),
                                          ([0.00012, 0.0345, 0.2], 5), ([-7.25, 1e6], 6), ([1.0, 1.0000001], 3)])
def test_bin_labels_are_those_of_pandas(spark, values, bins):
    from sievework.operators import features
    got = features.binning(spark.createDataFrame([(v,) for v in values], "x double"), "x", bins, "b", labels=True)
    want = pd.cut(pd.Series(values), bins, include_lowest=True).astype(str)
    assert {r.x: r.b for r in got.collect()} == dict(zip(values, want))
