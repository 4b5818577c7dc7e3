"""Structured Streaming operators.

Sources are file streams (new Parquet files landing in a folder); every query
uses a checkpoint folder under the session's checkpoint directory so that a
restart resumes without duplicates.  Event time is made a session-time-zone
independent ``timestamp`` (watermarks need it) from the wall-clock value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import epoch_micros
from ..session import scratch_path

NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def event_time(ts: Column) -> Column:
    """wall clock (timestamp_ntz, read as UTC) -> timestamp instant."""
    return F.timestamp_micros(epoch_micros(ts))


def wall_clock(instant: Column) -> Column:
    """timestamp instant -> timestamp_ntz wall clock in UTC."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(NTZ_EPOCH))


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a file stream; the table is one file or a folder of files.

    A stream's base path cannot be a file, so one file is a pattern that only it meets."""
    rows = spark.read.parquet(path)
    place = path.rstrip("/").split("/")
    files = [unquote(f).split("/") for f in rows.inputFiles()]
    if len(files) == 1 and files[0][-2:] == place[-2:]:
        path = "/".join([*place[:-1], f"{{{place[-1]}}}"])
    return spark.readStream.schema(rows.schema).parquet(path)


def source_window_counts(stream: DataFrame, ts: str, key: str, duration: str = "1 minute",
                         slide: str | None = None, watermark: str = "10 minutes",
                         value: str | None = None, label: str | None = None,
                         normal: Sequence[str] = ("normal",)) -> DataFrame:
    """Per (window, key) counts and means with a watermark.  In append
    and update mode rows older than the watermark are dropped and the state of
    closed windows is evicted; complete mode keeps every window."""
    s = stream.withColumn("__et", event_time(F.col(ts))).withWatermark("__et", watermark)
    w = F.window("__et", duration, slide) if slide else F.window("__et", duration)
    aggs = {"n": F.count(F.lit(1))}
    if value:
        aggs["mean_value"] = F.avg(value)
    if label:
        aggs["attack_ratio"] = F.avg((~F.col(label).isin(*normal)).cast("double"))
    return (s.groupBy(w.alias("w"), key).agg(*[e.alias(n) for n, e in aggs.items()])
            .select(wall_clock(F.col("w.start")).alias("window_start"), key, *aggs))


def run_available(query_df: DataFrame, mode: str, sink: Callable | str, checkpoint: str,
                  output: str | None = None) -> None:
    """Process everything available now, then stop (exactly-once via the checkpoint)."""
    w = query_df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if callable(sink):
        w = w.foreachBatch(sink)
    else:
        w = w.format(sink).option("path", output)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def overwrite_sink(path: str) -> Callable:
    """foreachBatch sink for complete / update mode results: each batch rewrites
    (complete) the result table; written by the executors, not the driver."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    return sink


def append_sink(path: str) -> Callable:
    """foreachBatch sink that appends each micro-batch (idempotent per epoch folder)."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")
    return sink


def windowed_counts_to_table(spark: SparkSession, stream: DataFrame, mode: str, name: str,
                             **kw) -> DataFrame:
    """Run Z01/Z02 and return the written result."""
    agg = source_window_counts(stream, **kw)
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    if mode == "append":
        run_available(agg, "append", "parquet", ckpt, out)
    else:
        run_available(agg, mode, overwrite_sink(out) if mode == "complete" else append_sink(out), ckpt)
    return spark.read.parquet(out)


def burst_alerts(stream: DataFrame, ts: str, duration: str, limit: int,
                 watermark: str = "10 minutes") -> DataFrame:
    """Windows whose alert count exceeds ``limit`` (update mode emits a window
    as soon as it crosses the limit and again when it grows)."""
    s = stream.withColumn("__et", event_time(F.col(ts))).withWatermark("__et", watermark)
    c = s.groupBy(F.window("__et", duration).alias("w")).agg(F.count(F.lit(1)).alias("alerts"))
    return c.where(F.col("alerts") > limit).select(wall_clock(F.col("w.start")).alias("window_start"),
                                                   "alerts")


def dedup_within_watermark(stream: DataFrame, ts: str, keys: Sequence[str],
                           watermark: str = "1 hour") -> DataFrame:
    """Repeats of the same keys within the watermark delay are dropped."""
    s = stream.withColumn("__et", event_time(F.col(ts))).withWatermark("__et", watermark)
    return s.dropDuplicatesWithinWatermark(list(keys)).drop("__et")


def score_stream(stream: DataFrame, model, alert_fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored pipeline model applied to arriving rows, then the alert rule."""
    return alert_fn(model.transform(stream))
