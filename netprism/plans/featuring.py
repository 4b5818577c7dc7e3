"""Queries: network-flow features (F01-F20) on the ``flows`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import r6
from ..operators import features as feat
from ..sources.tables import FLOWS_SQL, flows, table
from .catalog import query, with_ctes


_INTEGRAL = {"Flag_Combination_Score", "Well_Known_Port", "Ephemeral_Port"}


def _one(name):
    def build(spark, sf):
        df = feat.engineer_flow_features(flows(spark, sf), only=[name])
        value = F.col(name) if name in _INTEGRAL else r6(name)
        return df.select("flow_id", value.alias(name.lower()))
    return build


def _sql(expr, name):
    value = expr if name in _INTEGRAL else f"round({expr}, 6)"
    return with_ctes(f"SELECT flow_id, {value} AS {name.lower()} FROM flows", FLOWS_SQL)


_F = {
    "F01_packet_ratio": ("Packet_Ratio",
                         "total_fwd_packets / (total_backward_packets + 1.0)"),
    "F02_byte_ratio": ("Byte_Ratio",
                       "total_length_of_fwd_packets / (total_length_of_bwd_packets + 1.0)"),
    "F03_asymmetry_score": ("Asymmetry_Score",
                            "abs(total_fwd_packets - total_backward_packets)"
                            " / (total_fwd_packets + total_backward_packets + 1.0)"),
    "F04_burstiness": ("Burstiness", "flow_iat_std / (flow_iat_mean + 1e-6)"),
    "F05_flow_rate": ("Flow_Rate",
                      "(total_fwd_packets + total_backward_packets) / (flow_duration + 1.0)"),
    "F06_packet_size_cv": ("Packet_Size_CV", "packet_length_std / (packet_length_mean + 1e-6)"),
    "F07_flag_combination_score": ("Flag_Combination_Score",
                                   "coalesce(syn_flag_count, 0) * 1 + coalesce(ack_flag_count, 0) * 2"
                                   " + coalesce(fin_flag_count, 0) * 4"),
    "F08_well_known_port": ("Well_Known_Port",
                            "CAST(coalesce(destination_port < 1024, false) AS INTEGER)"),
    "F09_ephemeral_port": ("Ephemeral_Port",
                           "CAST(coalesce(destination_port BETWEEN 49152 AND 65535, false) AS INTEGER)"),
}

for _key, (_name, _expr) in _F.items():
    query(_key, _sql(_expr, _name))(_one(_name))


# F10-F12 need the UNSW-NB15 / NSL-KDD field names: the same flows renamed.
UNSW_SQL = """unsw AS (
  SELECT flow_id AS id, total_fwd_packets AS spkts, total_backward_packets AS dpkts,
         total_length_of_fwd_packets AS sbytes, total_length_of_bwd_packets AS dbytes
  FROM flows)"""
NSL_SQL = """nsl AS (
  SELECT flow_id, total_length_of_fwd_packets AS src_bytes, total_length_of_bwd_packets AS dst_bytes,
         total_fwd_packets AS count, total_backward_packets AS srv_count
  FROM flows)"""


def unsw(spark, sf):
    return flows(spark, sf).select(
        F.col("flow_id").alias("id"), F.col("total_fwd_packets").alias("spkts"),
        F.col("total_backward_packets").alias("dpkts"),
        F.col("total_length_of_fwd_packets").alias("sbytes"),
        F.col("total_length_of_bwd_packets").alias("dbytes"))


def nsl(spark, sf):
    return flows(spark, sf).select(
        "flow_id", F.col("total_length_of_fwd_packets").alias("src_bytes"),
        F.col("total_length_of_bwd_packets").alias("dst_bytes"),
        F.col("total_fwd_packets").alias("count"),
        F.col("total_backward_packets").alias("srv_count"))


@query("F10_unsw_ratios", with_ctes(
    "SELECT id, round(spkts / (dpkts + 1.0), 6) AS packet_ratio_unsw, "
    "round(sbytes / (dbytes + 1.0), 6) AS byte_ratio_unsw FROM unsw", FLOWS_SQL, UNSW_SQL))
def f10(spark, sf):
    df = feat.engineer_flow_features(unsw(spark, sf))
    return df.select("id", r6("Packet_Ratio_UNSW").alias("packet_ratio_unsw"),
                     r6("Byte_Ratio_UNSW").alias("byte_ratio_unsw"))


@query("F11_nsl_byte_ratio", with_ctes(
    "SELECT flow_id, round(src_bytes / (dst_bytes + 1.0), 6) AS byte_ratio_nsl FROM nsl",
    FLOWS_SQL, NSL_SQL))
def f11(spark, sf):
    df = feat.engineer_flow_features(nsl(spark, sf), only=["Byte_Ratio_NSL"])
    return df.select("flow_id", r6("Byte_Ratio_NSL").alias("byte_ratio_nsl"))


@query("F12_service_count_ratio", with_ctes(
    "SELECT flow_id, round(count / (srv_count + 1.0), 6) AS service_count_ratio FROM nsl",
    FLOWS_SQL, NSL_SQL))
def f12(spark, sf):
    df = feat.engineer_flow_features(nsl(spark, sf), only=["Service_Count_Ratio"])
    return df.select("flow_id", r6("Service_Count_Ratio").alias("service_count_ratio"))


def _log_sql():
    parts = []
    for name, expr in _F.values():
        kind, formula, use = feat.FEATURE_DOC[name]
        parts.append(f"SELECT '{name}' AS Feature, '{kind}' AS Type, '{formula}' AS Formula, '{use}' AS Usefulness, count(*) AS n_rows,"
                     f" count({expr}) AS n_values, round(CAST(min({expr}) AS DOUBLE), 6) AS lowest,"
                     f" round(CAST(max({expr}) AS DOUBLE), 6) AS highest FROM flows")
    return with_ctes(" UNION ALL ".join(parts), FLOWS_SQL)


@query("F13_feature_log", _log_sql())
def f13(spark, sf):
    """The feature log of the flows, with the values that their rows give."""
    log = feat.feature_log(flows(spark, sf))
    return log.withColumns({"lowest": r6("lowest"), "highest": r6("highest")})


@query("F15_half_open_window_ratio", with_ctes(
    "SELECT flow_id, CAST(coalesce(syn_flag_count, 0) > 0 AND coalesce(ack_flag_count, 0) = 0 AS INTEGER)"
    " AS half_open, round(total_fwd_packets / (total_backward_packets + 1.0), 6) AS window_ratio"
    " FROM flows", FLOWS_SQL))
def f15(spark, sf):
    df = flows(spark, sf)
    return df.select("flow_id",
                     feat.half_open_flag("syn_flag_count", "ack_flag_count").alias("half_open"),
                     r6(feat.window_ratio("total_fwd_packets", "total_backward_packets"))
                     .alias("window_ratio"))


_GAPS_SQL = """gaps AS (
  SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS g
  FROM events),
mom AS (
  SELECT user_id, count(*) AS n, avg(g) AS mu FROM gaps WHERE g IS NOT NULL GROUP BY user_id),
cen AS (
  SELECT g.user_id, m.n, m.mu, avg((g.g - m.mu) * (g.g - m.mu)) AS m2,
         avg((g.g - m.mu) * (g.g - m.mu) * (g.g - m.mu)) AS m3, min(g.g) AS gmin, max(g.g) AS gmax
  FROM gaps g JOIN mom m USING (user_id) WHERE g.g IS NOT NULL GROUP BY g.user_id, m.n, m.mu)"""


@query("F16_interarrival_skewness", with_ctes(
    "SELECT user_id, n AS n_gaps, round(CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) END, 6) AS gap_skew"
    " FROM cen", _GAPS_SQL))
def f16(spark, sf):
    from ..operators.windows import interarrival_stats

    m = interarrival_stats(table(spark, sf, "events"), "user_id", "ts", ["event_id"])
    return m.select("user_id", "n_gaps", r6("gap_skew").alias("gap_skew"))


@query("F17_port_entropy", with_ctes(
    "SELECT source_id, round(-sum((c * 1.0 / t) * log2(c * 1.0 / t)), 6) AS port_entropy,"
    " CAST(max(t) AS BIGINT) AS n_flows FROM ("
    "  SELECT source_id, c, sum(c) OVER (PARTITION BY source_id) AS t FROM ("
    "   SELECT source_id, destination_port // 1024 AS b, count(*) AS c FROM flows"
    "   GROUP BY source_id, b)) GROUP BY source_id", FLOWS_SQL))
def f17(spark, sf):
    from ..operators.features import group_entropy

    df = flows(spark, sf).withColumn("b", F.floor(F.col("destination_port") / 1024))
    e = group_entropy(df, "source_id", "b")
    return e.select("source_id", r6("entropy").alias("port_entropy"), "n_flows")


# IANA protocol numbers used by the code map.
PROTOCOL_CODES = {"icmp": 1, "tcp": 6, "udp": 17}


@query("F18_protocol_map_one_hot", with_ctes(
    "SELECT flow_id, coalesce(CASE lower(protocol) WHEN 'icmp' THEN 1 WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 END,"
    " CASE protocol WHEN 'O' THEN 6 WHEN 'F' THEN 17 END, -1) AS protocol_code,"
    " CAST(coalesce(protocol = 'F', false) AS INTEGER) AS protocol_f,"
    " CAST(coalesce(protocol = 'O', false) AS INTEGER) AS protocol_o,"
    " CAST(protocol IS NULL AS INTEGER) AS protocol_null FROM flows", FLOWS_SQL))
def f18(spark, sf):
    df = flows(spark, sf)
    # the flows view codes TCP as 'O' and UDP as 'F'
    codes = {**PROTOCOL_CODES}
    code = feat.map_code(F.lower(F.col("protocol")), codes)
    code2 = feat.map_code(F.col("protocol"), {"O": 6, "F": 17})
    oh = feat.one_hot(df, "protocol", ["F", "O"], prefix="protocol_", null_column=True)
    return oh.select("flow_id", F.coalesce(code, code2, F.lit(-1)).alias("protocol_code"),
                     F.col("protocol_F").alias("protocol_f"), F.col("protocol_O").alias("protocol_o"),
                     "protocol_null")


@query("F19_port_normalised", with_ctes(
    "SELECT flow_id, round(destination_port / 65535.0, 6) AS port_norm FROM flows", FLOWS_SQL))
def f19(spark, sf):
    return flows(spark, sf).select("flow_id", r6(feat.port_normalised("destination_port"))
                                   .alias("port_norm"))


_LABEL_MAP_SQL = """label_map AS (
  SELECT * FROM (VALUES ('n', 'normal', 0, 0), ('a', 'dos', 1, 1), ('r', 'probe', 2, 1))
  AS t(raw, category, multi_code, binary_code))"""


@query("F20_merge_and_label_map", with_ctes(
    "SELECT m.dataset, m.label, coalesce(l.category, 'unknown') AS category,"
    " coalesce(l.multi_code, -1) AS multi_code, coalesce(l.binary_code, 1) AS binary_code,"
    " count(*) AS n, CAST(sum(m.spkts) AS BIGINT) AS spkts, round(sum(m.src_bytes), 2) AS src_bytes_sum"
    " FROM (SELECT 'unsw' AS dataset, lower(trim(f.label)) AS label, f.total_fwd_packets AS spkts,"
    "        NULL::DOUBLE AS src_bytes FROM flows f"
    "       UNION ALL SELECT 'nsl', lower(trim(f.label)), NULL::BIGINT, f.total_length_of_fwd_packets"
    "       FROM flows f) m LEFT JOIN label_map l ON m.label = l.raw"
    " GROUP BY ALL", FLOWS_SQL, _LABEL_MAP_SQL))
def f20(spark, sf):
    fl = flows(spark, sf)
    a = fl.select(F.lit("unsw").alias("dataset"), F.lower(F.trim("label")).alias("label"),
                  F.col("total_fwd_packets").alias("spkts"))
    b = fl.select(F.lit("nsl").alias("dataset"), F.lower(F.trim("label")).alias("label"),
                  F.col("total_length_of_fwd_packets").alias("src_bytes"))
    merged = feat.merge_datasets([a, b])
    mapping = spark.createDataFrame(
        [("n", "normal", 0, 0), ("a", "dos", 1, 1), ("r", "probe", 2, 1)],
        "raw string, category string, multi_code int, binary_code int")
    mapped = feat.map_labels(merged, "label", mapping)
    return (mapped.groupBy("dataset", "label", "category", "multi_code", "binary_code")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("spkts").alias("spkts"),
                 F.round(F.sum("src_bytes"), 2).alias("src_bytes_sum")))


_SPELLED = ["normal", "DDoS", "Port-Scan", "web_attack", "Infiltration", "PROBE", "r2l", "U2R ", "other", "Zero Day"]


@query("F20_documented_codes", "SELECT CASE l_orderkey % 10 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(feat.LABEL_CODES["network"])) + " ELSE 'Other' END AS category,"
    " CAST(least(l_orderkey % 10, 8) AS INTEGER) AS multi_code, CAST(least(l_orderkey % 10, 1) AS INTEGER) AS binary_code,"
    " count(*) AS n FROM lineitem GROUP BY ALL")
def f20_codes(spark, sf):
    """Labels in several spellings, and one that no table has, to the nine documented network classes."""
    spelled = F.array(*[F.lit(x) for x in _SPELLED])
    rows = table(spark, sf, "lineitem").select(F.get(spelled, (F.col("l_orderkey") % 10).cast("int")).alias("label"))
    mapped = feat.map_labels(rows.withColumn("key", feat.label_key(F.col("label"))), "key", feat.label_table(spark, "network"),
                             unknown_category="Other", unknown_code=8)
    return mapped.groupBy("category", "multi_code", "binary_code").agg(F.count(F.lit(1)).alias("n"))
