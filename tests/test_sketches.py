"""Stored sketches against exact values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netprism.operators import clean, evaluate, sketches


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 30_000
    rows = [(i % 6, float(a) + (0.3 if i % 6 >= 3 else 0.0), int(b), f"v{i}" if i % 20 else "same", None if i % 3 else float("nan"))
            for i, (a, b) in enumerate(zip(rng.normal(size=n), rng.integers(0, 9000, n), strict=True))]
    return spark.createDataFrame(rows, "day int, x double, code int, name string, none double").repartition(7)


COLS = ["x", "code", "name", "none"]


@pytest.fixture(scope="module")
def stored(table):
    return sketches.column_sketches(table, F.col("day"), COLS, ["x", "code"]).checkpoint(eager=True)


def test_merged_equals_one_pass_and_bound(table, stored):
    parts = {r["column"]: r for r in sketches.merged_distinct(stored).collect()}
    whole = {r["column"]: r for r in sketches.merged_distinct(sketches.column_sketches(table, F.lit(0), COLS)).collect()}
    pdf = table.toPandas()
    for c in COLS:
        exact = pdf[c].nunique()
        assert parts[c]["n"] == whole[c]["n"] == len(pdf) and parts[c]["n_present"] == pdf[c].notna().sum()
        for got in (parts, whole):
            assert abs(got[c]["n_distinct"] - exact) <= 4 * sketches.THETA_DEVIATION * exact, c


def test_intersection(table, stored):
    got = {r["column"]: r for r in sketches.common_values(stored, 0, 1).collect()}
    pdf = table.toPandas()
    a, b = set(pdf[pdf["day"] == 0]["code"]), set(pdf[pdf["day"] == 1]["code"])
    assert got["code"]["either"] == pytest.approx(len(a | b), rel=0.08) and got["code"]["both"] == pytest.approx(len(a & b), rel=0.15)
    assert got["name"]["both"] < 200


def test_decision_is_exact_near_the_threshold(table, stored):
    share = 0.95 + 1 / 30_000  # of the column name
    assert sketches.distinct_above(table, stored, share - 1e-5)["name"] and not sketches.distinct_above(table, stored, share + 1e-5)["name"]
    assert sketches.distinct_above(table, stored, 0.9) == {"x": True, "code": False, "name": True, "none": False}


def test_drift_within_the_bound(table, stored):
    got = {r["column"]: r for r in sketches.drift(stored, F.when(F.col("part") < 3, "old").otherwise("new"), "old", "new").collect()}
    pdf = table.toPandas()
    for c in ("x", "code"):
        a, b = np.sort(pdf[pdf["day"] < 3][c]), np.sort(pdf[pdf["day"] >= 3][c])
        at = np.concatenate([a, b])
        exact = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
        assert abs(got[c]["ks"] - exact) <= 2 * sketches.RANK_ERROR + 2 / 400, c
        assert (got[c]["n_first"], got[c]["n_second"]) == (len(a), len(b))
    assert set(got) == {"x", "code"} and got["x"]["ks"] > 0.09


def test_null_class_is_kept_by_its_size(spark):
    df = spark.createDataFrame([(None, i) for i in range(12)] + [("a", i) for i in range(3)], "y string, v int")
    assert {r["y"] for r in clean.drop_rare_classes(df, "y").collect()} == {None}
    assert clean.drop_rare_classes(df, "y", 13).count() == 0


def test_sample_with_normal_leaves_out_one_row(spark):
    rows = [(i, "normal" if i in (4, 7) else "dos", float("nan")) for i in range(9)] + [(7, "normal", 1.0)]
    df = spark.createDataFrame(rows, "id int, label string, x double").repartition(3)
    got = [r["id"] for r in evaluate.sample_with_normal(df, "label", ["id"], 6).collect()]
    assert got == [4, 0, 1, 2, 3, 5]
    assert [r["id"] for r in evaluate.sample_with_normal(df.where("id = 7"), "label", ["id"], 6).collect()] == [7, 7]
    assert [r["id"] for r in evaluate.sample_with_normal(df.where("label = 'dos'"), "label", ["id"], 3).collect()] == [0, 1, 2]
    assert [r["id"] for r in evaluate.sample_with_normal(df.where("id in (0, 1, 2, 4)"), "label", ["id"], 2).collect()] == [4, 0]
