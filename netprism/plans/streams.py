"""Queries: Structured Streaming (Z01-Z05) over a file stream of the events table.

Each query runs its stream with ``availableNow`` (everything present, then
stop) into a sink under the checkpoint folder and returns the written result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import r6
from ..session import scratch_path
from ..sources.tables import table
from ..streaming import flows as zs
from ..streaming import previous
from .catalog import query


def events_stream(spark, sf):
    return zs.table_stream(spark, f"{sf.rstrip('/')}/events.parquet")


@query("Z01_incremental_windows", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, user_id,"
       " count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def z01(spark, sf):
    out = zs.windowed_counts_to_table(spark, events_stream(spark, sf), "complete", "z01", ts="ts",
                                      key="user_id", duration="1 minute", watermark="10 minutes",
                                      value="value")
    return out.select("window_start", "user_id", "n", r6("mean_value").alias("mean_value"))


@query("Z01_append_closed_windows", "SELECT * FROM (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start,"
       " user_id, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL)"
       " WHERE window_start + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def z01a(spark, sf):
    """Append mode: only windows closed by the watermark (window end <= latest
    event time - 10 minutes) are emitted; open ones stay in the state store
    until later data moves the watermark."""
    out = zs.windowed_counts_to_table(spark, events_stream(spark, sf), "append", "z01a", ts="ts",
                                      key="user_id", duration="1 minute", watermark="10 minutes",
                                      value="value")
    return out.select("window_start", "user_id", "n", r6("mean_value").alias("mean_value"))


@query("Z02_sliding_windows", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(k) AS window_start,"
       " user_id, count(*) AS n FROM events, range(0, 5) r(k) GROUP BY ALL")
def z02(spark, sf):
    out = zs.windowed_counts_to_table(spark, events_stream(spark, sf), "complete", "z02", ts="ts",
                                      key="user_id", duration="5 minutes", slide="1 minute",
                                      watermark="10 minutes")
    return out.select("window_start", "user_id", "n")


@query("Z04_alert_burst_update", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS alerts"
       " FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 10")
def z04(spark, sf):
    errors = events_stream(spark, sf).where(F.col("event_type") == "error")
    alerts = zs.burst_alerts(errors, "ts", "6 hours", 10, watermark="1 hour")
    out = scratch_path(spark, "z04-out")
    zs.run_available(alerts, "update", zs.append_sink(out), scratch_path(spark, "z04-ckpt"))
    # update mode re-emits a window when its count grows: keep the latest count
    return spark.read.parquet(out).groupBy("window_start").agg(F.max("alerts").alias("alerts"))


@query("Z05_dedup_within_watermark", "SELECT event_id, user_id, event_type, value FROM events")
def z05(spark, sf):
    ev = table(spark, sf, "events")
    folder = scratch_path(spark, "z05-in")
    ev.write.mode("overwrite").parquet(f"{folder}/a")
    ev.write.mode("overwrite").parquet(f"{folder}/b")  # every event arrives twice
    stream = (spark.readStream.schema(ev.schema).option("recursiveFileLookup", True)
              .parquet(folder))
    dedup = zs.dedup_within_watermark(stream, "ts", ["event_id"], watermark="1 hour")
    out = scratch_path(spark, "z05-out")
    zs.run_available(dedup, "append", "parquet", scratch_path(spark, "z05-ckpt"), out)
    return spark.read.parquet(out).select("event_id", "user_id", "event_type", "value")


def _stream_alerts(spark, sf):
    """The model, and the alerts that the stream of documents wrote."""
    from ..operators import evaluate as ev
    from .modeling import _fit, doc_features

    model, _ = _fit(spark, sf)
    stream = zs.table_stream(spark, f"{sf.rstrip('/')}/documents.parquet")
    alerts = ev.attack_alerts(model.predict(doc_features(stream)).withColumnRenamed("prediction", "prediction_name"),
                              prediction="prediction_name", normal=("1",))
    out = scratch_path(spark, "z03-out")
    zs.run_available(alerts.select("doc_id", "prediction_name", "confidence", "priority"), "append",
                     zs.append_sink(out), scratch_path(spark, "z03-ckpt"))
    return model, spark.read.schema("doc_id long, prediction_name string, confidence double, priority string").parquet(out)


@query("Z03_score_stream_alerts")
def z03(spark, sf):
    return _stream_alerts(spark, sf)[1]


@query("Z03_stream_equals_batch", "SELECT count(*) AS n_documents, 0 AS n_different, 0 AS n_repeated FROM documents")
def z03_equals_batch(spark, sf):
    """Every document scored in batch by the same model: documents whose alert on the stream is missing, should not be
    there or names another class, and documents with more than one alert."""
    from .modeling import doc_features

    model, alerts = _stream_alerts(spark, sf)
    batch = model.predict(doc_features(table(spark, sf, "documents")))
    wanted = batch.select("doc_id", F.when(F.col("prediction") != "1", F.col("prediction")).alias("wanted"))
    got = alerts.groupBy("doc_id").agg(F.max("prediction_name").alias("got"), F.count(F.lit(1)).alias("n"))
    return wanted.join(got, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(~F.col("wanted").eqNullSafe(F.col("got"))).cast("int")
        .alias("n_different"), F.count_if(F.col("n") > 1).cast("int").alias("n_repeated"))


@query("Z01_previous_rows", "SELECT * FROM (SELECT event_id, user_id, round(avg(value) OVER w, 6) AS prev_mean_value,"
       " CAST(count(*) OVER w AS INTEGER) AS prev_rows, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id"
       " ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 600000 FROM events)")
def z01_previous(spark, sf):
    """W11 on the stream of events, with keyed state: every event the watermark has passed, with the mean and the
    number of the up to 5 events of its user before it."""
    def measure(rows):
        values = [r[3] for r in rows if r[3] is not None]
        return (sum(values) / len(values) if values else None, len(rows))

    stream = events_stream(spark, sf).select("event_id", "user_id", "ts", "value")
    result = previous.previous_rows(stream, "user_id", "ts", ["event_id"], 5, measure, "prev_mean_value double, prev_rows int")
    out = scratch_path(spark, "z01-previous")
    previous.run_previous_rows(spark, result, scratch_path(spark, "z01-previous-state"), out)
    done = spark.read.schema("event_id long, user_id long, ts timestamp_ntz, value double, prev_mean_value double, prev_rows int").parquet(out)
    return done.select("event_id", "user_id", r6("prev_mean_value").alias("prev_mean_value"), "prev_rows", "ts")
