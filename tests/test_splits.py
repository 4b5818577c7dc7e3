"""Stratified splits by a hash cut: exact per class, equal to the sorted order, ties and nulls."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from netprism.operators import splits


def expected(rows, fraction):
    """Rows ranked by (hash, id) inside their class, plainly."""
    classes = defaultdict(list)
    for r in rows:
        classes[r["y"]].append((r["h"], r["id"]))
    test = Counter()
    for y, members in classes.items():
        members.sort()
        for h, i in members[:int(len(members) * fraction + 0.5)]:
            test[(y, i)] += 1
    return test


@pytest.mark.parametrize("exact_rows", [100_000, 0])
def test_cut_equals_sorted_order(spark, monkeypatch, exact_rows):
    monkeypatch.setattr(splits.hash_cuts, "__defaults__", (exact_rows,))
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 97 == 0, None)
                                  .otherwise("b").alias("y"))
    rows = df.withColumn("h", splits.seeded_hash(["id"], 7)).collect()
    got = splits.split_by_hash(df, "y", ["id"], [0.2], ["test", "train"], seed=7)
    assert got.columns == ["id", "y", "split"]
    got = got.collect()
    assert len(got) == 5000
    assert Counter((r["y"], r["id"]) for r in got if r["split"] == "test") == expected(rows, 0.2)


def test_three_parts_are_exact(spark):
    df = spark.range(1003).select("id", (F.col("id") % 2).alias("y"))
    got = splits.split_by_hash(df, "y", ["id"], [0.7, 0.85], ["train", "validation", "test"])
    n = {(r["y"], r["split"]): r["count"] for r in got.groupBy("y", "split").count().collect()}
    for y, size in ((0, 502), (1, 501)):
        a, b = int(size * 0.7 + 0.5), int(size * 0.85 + 0.5)
        assert (n[(y, "train")], n[(y, "validation")], n[(y, "test")]) == (a, b - a, size - b)


def test_one_id_for_most_rows(spark):
    """Rows with the hash of the cut lie on both sides: still exact, and the same again."""
    df = spark.range(900).select(F.when(F.col("id") < 800, 5).otherwise(F.col("id")).alias("id"),
                                 F.lit("a").alias("y"), F.col("id").alias("v"))
    first = splits.split_by_hash(df, "y", ["id"], [0.3], ["test", "train"])
    again = splits.split_by_hash(df.repartition(5), "y", ["id"], [0.3], ["test", "train"])
    assert first.where("split = 'test'").count() == 270
    assert sorted(first.collect()) == sorted(again.collect())


def test_empty_table_and_zero_rank(spark):
    empty = spark.createDataFrame([], "id long, y string")
    assert splits.split_by_hash(empty, "y", ["id"], [0.2], ["test", "train"]).collect() == []
    tiny = spark.createDataFrame([(1, "a"), (2, "a")], "id long, y string")
    assert {r["split"] for r in splits.split_by_hash(tiny, "y", ["id"], [0.2], ["test", "train"]).collect()} == {"train"}
