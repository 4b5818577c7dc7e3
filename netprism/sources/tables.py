"""Driver tables and the two derived views used throughout (FIXTURES B1, B2).

``flows`` and ``weblogs`` are projections over ``lineitem`` / ``events``: no
shuffle, every filter and column choice still reaches the Parquet scan.
The SQL text of the same views (for the DuckDB oracle) sits next to the
DataFrame code so that both stay in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------
# flows: a network-flow shaped view of lineitem
# --------------------------------------------------------------------------

def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k, ln, sk, pk = (F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"),
                     F.col("l_partkey"))
    return li.select(
        (k * 10 + ln).alias("flow_id"),
        sk.alias("source_id"),
        ((k * 7919 + pk * 31) % 65536).alias("destination_port"),
        F.when(k % 17 != 0, F.col("l_discount") * 1000).alias("flow_duration"),
        F.col("l_quantity").cast("bigint").alias("total_fwd_packets"),
        (ln * 3 + sk % 5).alias("total_backward_packets"),
        F.col("l_extendedprice").alias("total_length_of_fwd_packets"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("total_length_of_bwd_packets"),
        (F.col("l_tax") * 1000).alias("flow_iat_mean"),
        (F.col("l_discount") * 1000).alias("flow_iat_std"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("packet_length_mean"),
        (F.col("l_quantity") * F.col("l_tax")).alias("packet_length_std"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("syn_flag_count"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("ack_flag_count"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("fin_flag_count"),
        F.when(k % 23 != 0, F.col("l_linestatus")).alias("protocol"),
        F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" ")).alias("label"),
        F.col("l_shipdate").alias("ts"),
    )


FLOWS_SQL = """flows AS (
  SELECT l_orderkey*10 + l_linenumber AS flow_id,
         l_suppkey AS source_id,
         (l_orderkey*7919 + l_partkey*31) % 65536 AS destination_port,
         CASE WHEN l_orderkey % 17 <> 0 THEN l_discount*1000 END AS flow_duration,
         CAST(l_quantity AS BIGINT) AS total_fwd_packets,
         l_linenumber*3 + l_suppkey % 5 AS total_backward_packets,
         l_extendedprice AS total_length_of_fwd_packets,
         l_extendedprice*l_discount AS total_length_of_bwd_packets,
         l_tax*1000 AS flow_iat_mean,
         l_discount*1000 AS flow_iat_std,
         l_extendedprice/l_quantity AS packet_length_mean,
         l_quantity*l_tax AS packet_length_std,
         CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS syn_flag_count,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS ack_flag_count,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS fin_flag_count,
         CASE WHEN l_orderkey % 23 <> 0 THEN l_linestatus END AS protocol,
         ' ' || l_returnflag || ' ' AS label,
         l_shipdate AS ts
  FROM lineitem)"""

# Fixed values of the derived web log (FIXTURES B2).
SITE_HOST = "shop.example.com"
AGENT_BOT = "Googlebot/2.1"
AGENTS = ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/120.0",
          "Mozilla/5.0 (Macintosh; Intel Mac OS X 13_1) Safari/605.1",
          "Mozilla/5.0 (X11; Linux x86_64) Firefox/121.0")


def weblog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One combined-log-format line per event (column ``line``) plus ``event_id``."""
    ev = table(spark, sf_dir, "events")
    eid, et = F.col("event_id"), F.col("event_type")
    ip = F.concat_ws(".", F.lit("10"), F.lit("0"), (F.col("user_id") % 256).cast("string"),
                     (F.col("user_id") % 251).cast("string"))
    method = (F.when(et == "purchase", "POST").when(et == "signup", "PUT").otherwise("GET"))
    status = (F.when((et == "error") & (eid % 2 == 0), 404)
              .when(et == "error", 500).when(et == "signup", 302).otherwise(200))
    uri = F.concat(F.lit("/"), et, F.lit("/"), (eid % 97).cast("string"), F.lit(".php?k="),
                   F.get_json_object("props", "$.k"))
    referer = (F.when(eid % 5 == 0, "-")
               .when(eid % 5 == 1, F.concat(F.lit(f"https://{SITE_HOST}/"), et))
               .otherwise("https://search.example.org/q"))
    agent = (F.when(eid % 7 == 0, AGENT_BOT).when(eid % 3 == 0, AGENTS[0])
             .when(eid % 3 == 1, AGENTS[1]).otherwise(AGENTS[2]))
    line = F.concat(ip, F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
                    F.lit(" +0000] \""), method, F.lit(" "), uri, F.lit(" HTTP/1.1\" "),
                    status.cast("string"), F.lit(" "),
                    F.round(F.col("value") * 100).cast("bigint").cast("string"),
                    F.lit(" \""), referer, F.lit("\" \""), agent, F.lit("\""))
    return ev.select(eid.alias("event_id"), line.alias("line"))


WEBLOG_LINES_SQL = f"""weblog_lines AS (
  SELECT event_id,
    '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(user_id % 251 AS VARCHAR)
    || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "'
    || CASE WHEN event_type = 'purchase' THEN 'POST' WHEN event_type = 'signup' THEN 'PUT' ELSE 'GET' END
    || ' /' || event_type || '/' || CAST(event_id % 97 AS VARCHAR) || '.php?k='
    || json_extract_string(props, '$.k') || ' HTTP/1.1" '
    || CAST(CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 404
                 WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' THEN 302
                 ELSE 200 END AS VARCHAR)
    || ' ' || CAST(CAST(round(value*100) AS BIGINT) AS VARCHAR)
    || ' "' || CASE WHEN event_id % 5 = 0 THEN '-'
                    WHEN event_id % 5 = 1 THEN 'https://{SITE_HOST}/' || event_type
                    ELSE 'https://search.example.org/q' END
    || '" "' || CASE WHEN event_id % 7 = 0 THEN '{AGENT_BOT}' WHEN event_id % 3 = 0 THEN '{AGENTS[0]}'
                     WHEN event_id % 3 = 1 THEN '{AGENTS[1]}' ELSE '{AGENTS[2]}' END
    || '"' AS line
  FROM events)"""
