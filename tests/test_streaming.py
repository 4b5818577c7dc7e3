"""Layer 5: streams - restart from the checkpoint, late rows, equality with batch."""

from pyspark.sql import functions as F

from netprism.session import scratch_path
from netprism.streaming import flows as zs


def test_restart_from_checkpoint_adds_no_duplicates(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    inbox, out, ckpt = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))
    ev.where("event_id < 500").write.parquet(f"{inbox}/part1")
    stream = spark.readStream.schema(ev.schema).option("recursiveFileLookup", True).parquet(inbox)
    q = stream.select("event_id", "user_id")
    zs.run_available(q, "append", "parquet", ckpt, out)
    assert spark.read.parquet(out).count() == 500
    # nothing new: a restart processes nothing
    zs.run_available(q, "append", "parquet", ckpt, out)
    assert spark.read.parquet(out).count() == 500
    # new file: only its rows are added
    ev.where("event_id >= 500").write.parquet(f"{inbox}/part2")
    zs.run_available(q, "append", "parquet", ckpt, out)
    got = spark.read.parquet(out)
    assert got.count() == ev.count() and got.select("event_id").distinct().count() == ev.count()


def test_late_rows_beyond_the_watermark_are_dropped(spark):
    """Append mode: windows of rows that arrive after the watermark passed them
    never appear (complete mode keeps all state and drops nothing)."""
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    inbox, out, ckpt = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))
    ev.where(F.dayofmonth("ts") >= 28).write.parquet(f"{inbox}/a")
    stream = spark.readStream.schema(ev.schema).option("recursiveFileLookup", True).parquet(inbox)
    agg = zs.source_window_counts(stream, ts="ts", key="event_type", duration="1 hour",
                                  watermark="10 minutes")
    zs.run_available(agg, "append", "parquet", ckpt, out)
    first = spark.read.parquet(out).count()
    assert first > 0
    ev.where(F.dayofmonth("ts") <= 2).write.parquet(f"{inbox}/b")
    zs.run_available(agg, "append", "parquet", ckpt, out)
    res = spark.read.parquet(out)
    assert res.count() == first
    assert res.where(F.dayofmonth("window_start") <= 2).count() == 0


def test_a_table_is_a_stream_as_one_file_and_as_a_folder(spark):
    """A folder of files gave an empty stream: its name was taken for the name of a file."""
    rows = spark.range(50).select("id", (F.col("id") * 2).alias("twice"))
    top = scratch_path(spark, "tables")
    rows.repartition(3).write.parquet(f"{top}/folder.parquet")
    one = rows.coalesce(1).toPandas()
    local = top.removeprefix("file:")
    one.to_parquet(f"{local}/file.parquet")
    one.to_parquet(f"{local}/other.parquet")  # not read with it
    rows.withColumn("part", F.col("id") % 2).write.partitionBy("part").parquet(f"{top}/parts.parquet")
    for name in ("folder", "file", "parts"):
        out = scratch_path(spark, name)
        stream = zs.table_stream(spark, f"{top}/{name}.parquet")
        zs.run_available(stream, "append", "parquet", scratch_path(spark, f"{name}-state"), out)
        got = spark.read.schema(stream.schema).parquet(out)
        assert sorted(map(tuple, got.select("id", "twice").collect())) == [(i, 2 * i) for i in range(50)], name
        assert name != "parts" or got.where("part = id % 2").count() == 50


def test_documents_in_a_folder_are_scored_on_the_stream(spark):
    from netprism.plans import streams

    top = scratch_path(spark, "documents")
    n = F.col("id")
    docs = spark.range(120).select(
        n.alias("doc_id"), F.concat(F.lit("Text "), F.when(n % 3 == 0, F.repeat(F.lit("7 "), 9)).otherwise("of words")).alias("text"),
        F.when(n % 2 == 0, "en").otherwise("fr").alias("lang"), F.lit("web").alias("source"), (n + 10).cast("long").alias("n_chars"))
    docs.repartition(4).write.parquet(f"{top}/documents.parquet")
    spark.range(100).select(n.alias("doc_id"), F.when(n % 3 == 0, 0).otherwise(1).alias("quality"),
                            F.lit(0).alias("toxic")).write.parquet(f"{top}/labels.parquet")
    assert tuple(streams.z03_equals_batch(spark, top).first()) == (120, 0, 0)
    assert streams.z03(spark, top).count() == 40
