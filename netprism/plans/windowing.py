"""Queries: positional windows, group features, time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import r6
from ..operators import windows as win
from ..sources.tables import FLOWS_SQL, flows, table
from .catalog import query, with_ctes
from .profiling import FLOW_COLUMNS


@query("W01_positional_groups", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_id,"
       " (row_number() OVER (ORDER BY event_id) - 1) // 100 AS flow_group FROM events")
def w01(spark, sf):
    # event_id is the key of events: no tie-breaking columns needed
    g = win.positional_groups(table(spark, sf, "events"), ["event_id"], 100, unique=True)
    return g.select("event_id", "row_id", F.col("flow_group").cast("bigint").alias("flow_group"))


_ORDER = ", ".join(f"{c} NULLS FIRST" for c in FLOW_COLUMNS)
WIDS_SQL = f"""g0 AS (
  SELECT *, (row_number() OVER (ORDER BY {_ORDER}) - 1) // 100 AS flow_group FROM flows),
ga AS (
  SELECT flow_group, count(*) AS request_count, CAST(count(DISTINCT destination_port) AS DOUBLE) AS p,
         avg(total_length_of_fwd_packets) AS s, avg(total_backward_packets) AS r,
         avg(flow_duration) AS d, avg(total_fwd_packets) AS k
  FROM g0 GROUP BY flow_group),
wids AS (
  SELECT g0.flow_group, g0.flow_id, g0.ts, ga.request_count,
    coalesce(ga.p, 1.0) AS unique_dst_ports, coalesce(ga.s, 10.0) AS mean_bytes_sent,
    coalesce(ga.r, 5.0) AS mean_bytes_received,
    ga.request_count / (coalesce(ga.d, 1.0) + 0.001) AS request_rate,
    coalesce(ga.d, 100.0) AS duration_mean, coalesce(ga.k, 10.0) AS packet_count_mean,
    coalesce(CASE WHEN total_backward_packets + 1 <> 0
             THEN (total_length_of_fwd_packets + 1) / (total_backward_packets + 1.0) END, 1.0) AS byte_ratio
  FROM g0 JOIN ga USING (flow_group))"""


def wids_frame(spark, sf):
    g = win.positional_groups(flows(spark, sf), ["flow_id"], 100)
    return win.wids_features(g)


def _w(key, cols):
    sql_cols = ", ".join(f"round({c}, 6) AS {c}" if c != "request_count" else c for c in cols)

    @query(key, with_ctes(f"SELECT flow_group, flow_id, ts, {sql_cols} FROM wids", FLOWS_SQL, WIDS_SQL))
    def build(spark, sf):
        w = wids_frame(spark, sf)
        return w.select(F.col("flow_group").cast("bigint").alias("flow_group"), "flow_id", "ts",
                        *[(r6(c).alias(c) if c != "request_count" else F.col(c)) for c in cols])
    return build


_w("W02_group_row_count", ["request_count"])
_w("W03_unique_destination_ports", ["unique_dst_ports"])
_w("W04_mean_bytes_sent", ["mean_bytes_sent"])
_w("W05_mean_bytes_received", ["mean_bytes_received"])
_w("W06_request_rate", ["request_rate"])
_w("W07_duration_packet_means", ["duration_mean", "packet_count_mean"])
_w("W08_byte_ratio", ["byte_ratio"])


@query("W10_per_minute_source_window", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, user_id,"
       " count(*) AS n_flows, count(DISTINCT event_type) AS unique_destinations,"
       " round(avg(value), 6) AS mean_duration,"
       " round(avg(CAST(event_type NOT IN ('view', 'click') AS DOUBLE)), 6) AS attack_ratio"
       " FROM events GROUP BY ALL")
def w10(spark, sf):
    ev = table(spark, sf, "events")
    s = win.per_window_source_stats(ev, "ts", "user_id", "1 minute", dur_col="value",
                                    label="event_type", dst_col="event_type", normal=("view", "click"))
    return s.select("window_start", "user_id", "n_flows", "unique_destinations",
                    r6("mean_duration").alias("mean_duration"), r6("attack_ratio").alias("attack_ratio"))


@query("W11_previous_rows_stats", "SELECT event_id, user_id,"
       " round(avg(value) OVER w, 6) AS prev_mean_value,"
       " CAST(coalesce(count_if(event_type = 'error') OVER w, 0) AS BIGINT) AS prev_errors, count(*) OVER w AS prev_rows"
       " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id"
       " ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def w11(spark, sf):
    ev = table(spark, sf, "events")
    s = win.previous_rows_stats(ev, "user_id", ["ts", "event_id"], 5, {
        "prev_mean_value": F.avg("value"),
        "prev_errors": F.count_if(F.col("event_type") == "error"),
        "prev_rows": F.count(F.lit(1))})
    return s.select("event_id", "user_id", r6("prev_mean_value").alias("prev_mean_value"),
                    "prev_errors", "prev_rows")


@query("W12_interarrival_stats", "WITH gaps AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER"
       " (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS g FROM events)"
       " SELECT user_id, count(g) AS n_gaps, round(avg(g), 6) AS gap_mean, round(stddev_pop(g), 6) AS gap_std,"
       " round(min(g), 6) AS gap_min, round(max(g), 6) AS gap_max FROM gaps WHERE g IS NOT NULL GROUP BY user_id")
def w12(spark, sf):
    m = win.interarrival_stats(table(spark, sf, "events"), "user_id", "ts", ["event_id"])
    return m.select("user_id", "n_gaps", *[r6(c).alias(c) for c in
                                           ("gap_mean", "gap_std", "gap_min", "gap_max")])


@query("W13_sequences", "SELECT event_id, user_id, list(event_type) OVER (PARTITION BY user_id ORDER BY ts,"
       " event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sequence FROM events")
def w13(spark, sf):
    s = win.sequences(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", 5)
    return s.select("event_id", "user_id", "sequence")
