"""The traffic classifier's passes: missing values are counted once, and reports read written predictions."""

from __future__ import annotations

from pyspark.sql import functions as F


def _rows(spark):
    return spark.range(400).select(
        F.col("id").alias("row"), F.when(F.col("id") % 7 != 0, F.col("id") % 10).cast("double").alias("a"),
        (F.col("id") % 13).alias("b"), F.concat(F.lit("s"), F.col("id") % 5).alias("service"),
        F.when(F.col("id") % 10 < 4, "x").otherwise("y").alias("label"))


def test_one_pass_for_missing_values_and_written_predictions(spark, monkeypatch):
    from netprism.operators import clean
    from netprism.plans import runs

    calls, count = [], clean._columns_with_missing
    monkeypatch.setattr(clean, "_columns_with_missing", lambda df: calls.append(1) or count(df))
    out = runs.classify_traffic(_rows(spark), "label", num_trees=3, max_depth=4, id_cols=["row"])
    assert len(calls) == 1
    plan = out["predictions"]._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "Join" not in plan
    assert out["predictions"].count() == 400
    assert [r["split"] for r in out["metrics"].where("metric = 'accuracy'").orderBy("split").collect()] == ["test", "train"]
    # the model takes unseen rows as before
    new = _rows(spark).where("row < 3").withColumn("a", F.lit(1.0)).withColumn("service", F.lit("never seen"))
    assert out["model"].transform(new).where(F.col("prediction").isNotNull()).count() == 3


def test_number_words_are_told_without_the_cast(spark):
    from netprism.operators import encode

    df = spark.createDataFrame([("1", "1", "1d"), (" 2.5 ", "w", "2"), (None, "2", "3"), ("1e3", "", "4")],
                               "n string, w string, d string")
    out, cols = encode.numeric_strings(df)
    assert cols == ["n"]
    assert [r[0] for r in out.select("n").collect()] == [1.0, 2.5, None, 1000.0]
