"""Null keys, NaN, wide tables and wide categories: inputs the given tables do not have."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netprism.operators import clean, encode, evaluate, models, quantiles, select, weblog, windows
from netprism.plans import runs


@pytest.fixture(scope="module")
def keyed(spark):
    """100 rows, 25 of them with a null key; some null values."""
    return spark.range(100).select(
        F.col("id"), F.when(F.col("id") % 4 != 0, F.col("id") % 3).alias("k"), F.col("id").alias("t"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 2).alias("v"))


def wide_frame(spark, d, rows=400):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(rows, 46)).round(3)
    x[:, 1] += x[:, 0]
    x[rng.random(rows) < 0.9, 2] = np.nan
    x[5, 3] = np.nan
    pdf = pd.DataFrame(x[:, :d], columns=[f"c{i}" for i in range(d)])
    return pdf, spark.createDataFrame(pdf)


def test_correlation_is_pairwise_complete_at_any_width(spark):
    rng_cols = {}
    for d in (40, 41, 45):
        rng = np.random.default_rng(1)
        x = rng.normal(size=(400, 45)).round(3)
        x[:, 1] += x[:, 0]
        x[rng.random(400) < 0.9, 2] = np.nan
        x[5, 3] = np.nan
        x[:, 30] = np.nan
        x[:, 31] = 7.1
        pdf = pd.DataFrame(x[:, :d], columns=[f"c{i}" for i in range(d)])
        got = {(r["feature_a"], r["feature_b"]): r["abs_r"] for r in
               select.correlation_pairs(spark.createDataFrame(pdf).repartition(3)).collect()}
        want = pdf.corr().abs()
        for (a, b), r in got.items():
            w = want.loc[a, b]
            assert (r is None and math.isnan(w)) or r == pytest.approx(w, abs=1e-9), (a, b)
        assert len(got) == d * (d - 1) // 2
        rng_cols[d] = got["c0", "c1"]
    assert rng_cols[40] == rng_cols[41] == rng_cols[45]


def test_nan_is_not_a_high_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 1.0, float("nan")), (3.0, 9.0, 1.0), (4.0, 0.0, 2.0)], "a double, b double, c double")
    assert select.high_correlation_pairs(select.correlation_pairs(df)).count() == 0
    kept, _ = select.select_features(df.withColumn("Label", F.lit("x")))
    assert kept.columns == ["a", "b", "c", "Label"]


@pytest.mark.parametrize("block", [100_000, 7, 2])
def test_keyed_windows_equal_the_plain_ones(spark, keyed, block):
    stats = {"m": F.sum("v"), "n": F.count("v")}
    got = windows.previous_rows_stats(keyed, "k", ["t"], 5, stats, block_rows=block).orderBy("id").collect()
    want = windows.previous_rows_stats(keyed, "k", ["t"], 5, stats, skew_safe=False).orderBy("id").collect()
    assert [r["m"] for r in got] == [r["m"] for r in want] and len(got) == 100
    got = windows.sequences(keyed, "k", ["t"], "v", 6, block_rows=block).orderBy("id").collect()
    w = Window.partitionBy("k").orderBy("t").rowsBetween(-5, 0)
    want = keyed.withColumn("n", F.count(F.lit(1)).over(w)).orderBy("id").collect()
    assert [len(r["sequence"]) for r in got] == [r["n"] for r in want]  # null elements kept
    assert all(r["sequence"][-1] == r["v"] for r in got)
    filled = windows.forward_fill_blocked(keyed, ["v"], "k", ["t"], block).orderBy("id").collect()
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    plain = keyed.withColumn("v", F.last("v", ignorenulls=True).over(w)).orderBy("id").collect()
    assert [r["v"] for r in filled] == [r["v"] for r in plain]


def test_null_keys_are_groups(spark, keyed):
    ts = keyed.withColumn("t", F.timestamp_seconds(F.col("t")).cast("timestamp_ntz"))
    assert windows.interarrival_stats(ts, "k", "t").count() == 4
    flagged = clean.flag_key_duplicates(keyed, ["k"], ["t"])
    assert flagged.count() == 100 and flagged.where(~F.col("is_duplicate")).count() == 4
    labelled = keyed.withColumn("label", F.col("k").cast("string"))
    split = encode.stratified_split(labelled, "label", ["id"], 0.2)
    assert split.count() == 100 and {r["label"]: r["count"] for r in split.where("split = 'test'").groupBy("label").count().collect()} == {
        None: 5, "0": 5, "1": 5, "2": 5}
    three = encode.random_split_3(labelled, ["id"], "label")
    assert three.count() == 100
    pred = labelled.withColumn("prediction", F.lit("0"))
    assert evaluate.class_hit_rates(pred).agg(F.sum("n")).first()[0] == 100
    assert evaluate.confusion_matrix(pred).count() == 4


def test_identical_rows_are_flagged_without_arrays(spark):
    df = spark.createDataFrame([(1, "a")] * 50 + [(None, "b")] * 3, "k long, x string")
    got = clean.flag_key_duplicates(df, ["k"], ["x"])
    assert got.count() == 53 and got.where(~F.col("is_duplicate")).count() == 2
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_mutual_information_counts_a_null_class(spark):
    df = spark.range(200).select((F.col("id") % 10).cast("double").alias("x"),
                                 F.when(F.col("id") % 10 < 5, "a").alias("y"))
    named = df.withColumn("y", F.coalesce("y", F.lit("b")))
    one, two = (select.mutual_information(d, ["x"], "y").first()["mutual_information"] for d in (df, named))
    assert one == pytest.approx(two) and one > 0.5


def test_sample_with_normal_takes_the_row_once(spark):
    df = spark.createDataFrame([(1, "normal", None), (2, "x", "p"), (3, "y", None)], "id long, label string, extra string")
    got = [r["id"] for r in evaluate.sample_with_normal(df, "label", ["id"], 5).collect()]
    assert sorted(got) == [1, 2, 3]


def test_quantiles_fetch_a_fixed_number_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(3000, 80)).round(2), columns=[f"c{i}" for i in range(80)])
    pdf.iloc[:1200, 3] = 0.5  # one value with over a third of the rows
    df = spark.createDataFrame(pdf).repartition(4)
    fetched = []
    frame = type(df)
    collect = frame.collect

    def counted(self):
        rows = collect(self)
        fetched.append(len(rows))
        return rows

    monkeypatch.setattr(frame, "collect", counted)
    got = quantiles.exact_median(df, list(pdf.columns), accuracy=200, max_rows=4000)
    monkeypatch.undo()
    assert got == pytest.approx(pdf.median().to_dict())
    assert fetched and max(fetched) <= 4000


def test_sparse_rows_count_nan(spark):
    df = spark.createDataFrame([(float("nan"), None, "x"), (1.0, 2.0, "y")], "a double, b double, c string")
    assert [r["c"] for r in clean.drop_sparse_rows(df).collect()] == ["y"]


def test_number_pattern(spark):
    df = spark.createDataFrame([("1d", "1.5", "-2e3"), ("2f", " 3 ", None)], "a string, b string, c string")
    got, cols = encode.numeric_strings(df)
    assert cols == ["b", "c"] and got.schema["a"].dataType.simpleString() == "string"


def test_relative_uris_have_paths(spark):
    df = spark.createDataFrame([("/a/b.php?x=1",), ("http://h/a/b.php#z",), ("",)], "u string")
    p = weblog.url_path(F.col("u"))
    got = df.select(p.alias("p"), weblog.path_depth(p).alias("d"), weblog.file_extension(p).alias("e")).collect()
    assert [tuple(r) for r in got] == [("/a/b.php", 2, "php"), ("/a/b.php", 2, "php"), ("", 0, "")]


def test_forest_takes_a_wide_category_and_leaves_ids_out(spark):
    df = spark.range(400).select(
        F.col("id").alias("row"), F.concat(F.lit("s"), (F.col("id") % 75).cast("string")).alias("service"),
        (F.col("id") % 13).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "normal").otherwise("attack").alias("label"))
    out = runs.classify_traffic(df, "label", num_trees=3, max_depth=4, id_cols=["row"])
    assert out["predictions"].count() == 400
    names = {r["feature"] for r in out["importances"].collect()}
    assert "row" not in names
    assert models.needed_bins(df, ["service"]) >= 76
    pca = runs.classify_traffic(df.withColumn("x2", F.col("x") * 2), "label", num_trees=2, max_depth=3, use_pca=True, id_cols=["row"])
    assert pca["model"].stages[-2].getFeaturesCol() if hasattr(pca["model"].stages[-2], "getFeaturesCol") else True
    assert pca["predictions"].count() == 400


def test_isolation_forest_does_not_depend_on_partitions(spark):
    df = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 17).cast("double").alias("a"),
                                 F.sin(F.col("id")).alias("b"))
    scores = []
    for n in (2, 7):
        part = df.repartition(n)
        forest = models.fit_isolation_forest(part, ["a", "b"], n_trees=10, sample_size=64)
        scored = models.score_isolation_forest(part, forest)
        scores.append({r["row_id"]: round(r["score"], 9) for r in scored.select("row_id", "score").collect()})
    assert scores[0] == scores[1]
