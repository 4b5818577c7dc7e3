"""Queries: profiling (P01-P13) and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import r6
from ..operators import clean, profile
from ..operators.features import engineer_flow_features
from ..sources.tables import FLOWS_SQL, flows, table
from .catalog import query, with_ctes

# Schema of the flows view (FIXTURES B1), for SQL written per column.
FLOW_COLUMNS = {
    "flow_id": "long", "source_id": "long", "destination_port": "long", "flow_duration": "double",
    "total_fwd_packets": "long", "total_backward_packets": "long",
    "total_length_of_fwd_packets": "double", "total_length_of_bwd_packets": "double",
    "flow_iat_mean": "double", "flow_iat_std": "double", "packet_length_mean": "double",
    "packet_length_std": "double", "syn_flag_count": "int", "ack_flag_count": "int",
    "fin_flag_count": "int", "protocol": "string", "label": "string", "ts": "timestamp",
}
TRIM_SQL = r"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"


def _missing_sql(c, t):
    cond = f"{c} IS NULL OR isnan({c})" if t == "double" else f"{c} IS NULL"
    return f"SELECT '{c}' AS \"column\", CAST(count_if({cond}) AS BIGINT) AS missing_count, count(*) AS n FROM flows"


MISSING_SQL = "missing AS (" + " UNION ALL ".join(
    _missing_sql(c, t) for c, t in FLOW_COLUMNS.items()) + ")"


# ------------------------------------------------------------------ flagship

def flagship(spark, sf):
    df = engineer_flow_features(clean.drop_duplicates(flows(spark, sf)))
    df = df.withColumn("label", clean.normalize_label(F.col("label")))
    return (df.groupBy("label")
            .agg(F.count(F.lit(1)).alias("n_flows"),
                 r6(F.avg("Packet_Ratio")).alias("mean_packet_ratio"),
                 r6(F.avg("Asymmetry_Score")).alias("mean_asymmetry_score"),
                 r6(F.avg("Flag_Combination_Score")).alias("mean_flag_score"),
                 r6(F.avg("Well_Known_Port")).alias("well_known_share"),
                 r6(F.avg("Ephemeral_Port")).alias("ephemeral_share"))
            .orderBy(F.desc("n_flows"), "label"))


FLAGSHIP_SQL = with_ctes(
    f"SELECT {TRIM_SQL.format(c='label')} AS label, count(*) AS n_flows,"
    " round(avg(total_fwd_packets / (total_backward_packets + 1.0)), 6) AS mean_packet_ratio,"
    " round(avg(abs(total_fwd_packets - total_backward_packets) / (total_fwd_packets + total_backward_packets + 1.0)), 6)"
    " AS mean_asymmetry_score,"
    " round(avg(coalesce(syn_flag_count, 0) + 2 * coalesce(ack_flag_count, 0) + 4 * coalesce(fin_flag_count, 0)), 6)"
    " AS mean_flag_score,"
    " round(avg(CAST(coalesce(destination_port < 1024, false) AS INTEGER)), 6) AS well_known_share,"
    " round(avg(CAST(coalesce(destination_port BETWEEN 49152 AND 65535, false) AS INTEGER)), 6) AS ephemeral_share"
    " FROM (SELECT DISTINCT * FROM flows) GROUP BY 1", FLOWS_SQL)

query("P00_flagship_label_profile", FLAGSHIP_SQL)(flagship)


# ------------------------------------------------------------------ P01 - P13

@query("P01_shape", with_ctes(
    f"SELECT count(*) AS n_rows, {len(FLOW_COLUMNS)} AS n_columns FROM flows", FLOWS_SQL))
def p01(spark, sf):
    return profile.shape(flows(spark, sf))


@query("P02_missing_report", with_ctes(
    "SELECT \"column\", missing_count, round(missing_count * 100.0 / n, 6) AS missing_pct FROM missing"
    " WHERE missing_count > 0 ORDER BY missing_count DESC, \"column\" LIMIT 10", FLOWS_SQL, MISSING_SQL))
def p02(spark, sf):
    rep = profile.missing_report(flows(spark, sf), top=10)
    return rep.select("column", "missing_count", r6("missing_pct").alias("missing_pct"))


@query("P03_missing_totals", with_ctes(
    "SELECT CAST(sum(missing_count) AS BIGINT) AS total_missing,"
    " CAST(count_if(missing_count > 0) AS BIGINT) AS columns_with_missing FROM missing", FLOWS_SQL, MISSING_SQL))
def p03(spark, sf):
    return profile.missing_totals(flows(spark, sf))


DUP_INPUT_SQL = """dup_input AS (
  SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 10 = 0)"""


def dup_input(spark, sf):
    """FIXTURES B3: lineitem has no duplicate rows; a fixed subset is appended once."""
    li = table(spark, sf, "lineitem")
    return li.unionByName(li.where(F.col("l_orderkey") % 10 == 0))


@query("P04_duplicate_stats", with_ctes(
    "SELECT CAST(sum(c - 1) AS BIGINT) AS duplicate_rows, round(sum(c - 1) * 100.0 / sum(c), 6) AS duplicate_pct"
    " FROM (SELECT count(*) AS c FROM dup_input GROUP BY ALL_COLUMNS)", DUP_INPUT_SQL)
    .replace("GROUP BY ALL_COLUMNS", "GROUP BY " + ", ".join(
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])))
def p04(spark, sf):
    d = profile.duplicate_stats(dup_input(spark, sf))
    return d.select("duplicate_rows", r6("duplicate_pct").alias("duplicate_pct"))


@query("P06_preview", "SELECT event_id, ts, user_id, event_type, value FROM events"
                      " ORDER BY event_id LIMIT 3")
def p06(spark, sf):
    return profile.preview(table(spark, sf, "events"), ["event_id"], k=3, c=5)


@query("P08_label_distribution", with_ctes(
    "SELECT label, count(*) AS count FROM flows GROUP BY label", FLOWS_SQL))
def p08(spark, sf):
    return profile.label_distribution(flows(spark, sf), "label")


@query("P08_label_distribution_top5", "SELECT user_id, count(*) AS count FROM events"
       " GROUP BY user_id ORDER BY count DESC, user_id LIMIT 5")
def p08b(spark, sf):
    return profile.label_distribution(table(spark, sf, "events"), "user_id", top=5)


@query("P09_label_mapping", with_ctes(
    "SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code, count,"
    " round(count * 100.0 / sum(count) OVER (), 6) AS pct"
    " FROM (SELECT label, count(*) AS count FROM flows GROUP BY label)", FLOWS_SQL))
def p09(spark, sf):
    m = profile.label_mapping(flows(spark, sf), "label")
    return m.select("label", "code", "count", r6("pct").alias("pct"))


@query("P10_distinct_counts", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM flows" for c in FLOW_COLUMNS),
    FLOWS_SQL))
def p10(spark, sf):
    return profile.distinct_counts(flows(spark, sf))


def _labelled_flows(spark, sf):
    return clean.standardize_label(flows(spark, sf))


@query("P11_final_structure", with_ctes(
    f"SELECT CAST(sum(count(*)) OVER () AS BIGINT) AS rows, {len(FLOW_COLUMNS)} AS columns,"
    " 15 AS numeric_features, 1 AS categorical_features,"
    f" {TRIM_SQL.format(c='label')} AS label, count(*) AS label_count FROM flows GROUP BY 5",
    FLOWS_SQL))
def p11(spark, sf):
    return profile.final_structure(_labelled_flows(spark, sf), "Label")


@query("P12_quality_gates", with_ctes(
    "SELECT 'missing_pct' AS \"check\", \"column\" AS subject, round(missing_count * 100.0 / n, 6) AS value,"
    " missing_count * 100.0 / n < 5.0 AS passed FROM missing"
    " UNION ALL SELECT 'duplicate_pct', 'all', round(sum(c - 1) * 100.0 / sum(c), 6),"
    " sum(c - 1) * 100.0 / sum(c) < 1.0 FROM (SELECT count(*) AS c FROM flows GROUP BY ALL_FLOW)"
    " UNION ALL SELECT 'class_pct', label, round(n * 100.0 / sum(n) OVER (), 6),"
    " n * 100.0 / sum(n) OVER () >= 1.0"
    f" FROM (SELECT {TRIM_SQL.format(c='label')} AS label, count(*) AS n FROM flows GROUP BY 1)",
    FLOWS_SQL, MISSING_SQL)
    .replace("GROUP BY ALL_FLOW", "GROUP BY " + ", ".join(FLOW_COLUMNS)))
def p12(spark, sf):
    g = profile.quality_gates(flows(spark, sf).withColumn(
        "label", clean.normalize_label(F.col("label"))), "label")
    return g.select("check", "subject", r6("value").alias("value"), "passed")


RETENTION_SQL = with_ctes(
    "SELECT coalesce(dataset, 'TOTAL') AS dataset, CAST(sum(rows_before) AS BIGINT) AS rows_before,"
    " CAST(sum(rows_after) AS BIGINT) AS rows_after,"
    " round(sum(rows_after) * 100.0 / sum(rows_before), 6) AS retention_pct"
    " FROM (SELECT 'lineitem' AS dataset, (SELECT count(*) FROM dup_input) AS rows_before,"
    "        (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_input)) AS rows_after"
    "       UNION ALL SELECT 'events', (SELECT count(*) FROM ev_input),"
    "        (SELECT count(*) FROM (SELECT DISTINCT * FROM ev_input)))"
    " GROUP BY ROLLUP (dataset)", DUP_INPUT_SQL,
    "ev_input AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0)")


def retention_inputs(spark, sf):
    li = dup_input(spark, sf).withColumn("dataset", F.lit("lineitem"))
    ev = table(spark, sf, "events")
    ev = ev.unionByName(ev.where(F.col("event_id") % 10 == 0)).withColumn("dataset", F.lit("events"))
    before = li.select("dataset").unionByName(ev.select("dataset"))
    after = (li.dropDuplicates().select("dataset")
             .unionByName(ev.dropDuplicates().select("dataset")))
    return before, after


COUNTS_SQL = with_ctes(
    "SELECT 'events' AS dataset, (SELECT count(*) FROM ev_input) AS rows_before,"
    " (SELECT count(*) FROM (SELECT DISTINCT * FROM ev_input)) AS rows_after,"
    " CAST((SELECT count(*) FROM (DESCRIBE ev_input)) AS INTEGER) AS columns_before,"
    " CAST((SELECT count(*) FROM (DESCRIBE ev_input) WHERE column_name NOT LIKE '%\\_id' ESCAPE '\\') AS INTEGER) AS columns_after"
    " UNION ALL SELECT 'lineitem', (SELECT count(*) FROM dup_input),"
    " (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_input)),"
    " CAST((SELECT count(*) FROM (DESCRIBE dup_input)) AS INTEGER),"
    " CAST((SELECT count(*) FROM (DESCRIBE dup_input) WHERE column_name NOT LIKE '%\\_id' ESCAPE '\\') AS INTEGER)",
    DUP_INPUT_SQL, "ev_input AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0)")
REPORT_SQL = (
    "SELECT count(*) AS datasets, CAST(sum(rows_before) AS BIGINT) AS rows_before, CAST(sum(rows_after) AS BIGINT) AS rows_after,"
    " CAST(sum(rows_before) - sum(rows_after) AS BIGINT) AS rows_removed,"
    " CAST(sum(columns_before) - sum(columns_after) AS BIGINT) AS columns_removed,"
    " round(sum(rows_after) * 100.0 / sum(rows_before), 6) AS retention_pct,"
    " arg_max(dataset, 1 - rows_after * 1.0 / rows_before) AS largest_loss FROM (" + COUNTS_SQL + ")")


def cleaned_sets(spark, sf):
    """Raw and cleaned (no copies, no ``_id`` columns) frames of the two data sets."""
    ev = table(spark, sf, "events")
    raw = {"lineitem": dup_input(spark, sf), "events": ev.unionByName(ev.where(F.col("event_id") % 10 == 0))}
    return {n: (d, d.dropDuplicates().drop(*[c for c in d.columns if c.endswith("_id")])) for n, d in raw.items()}


@query("P13_retention", RETENTION_SQL)
def p13(spark, sf):
    before, after = retention_inputs(spark, sf)
    r = profile.retention(before, after)
    return r.select("dataset", "rows_before", "rows_after", r6("retention_pct").alias("retention_pct"))


@query("P10_merged_sketches", "SELECT c AS column_name, CAST(n AS BIGINT) AS n, true AS within_bound FROM (SELECT unnest(["
       "'l_orderkey', 'l_partkey', 'l_suppkey', 'l_quantity', 'l_extendedprice', 'l_shipdate']) AS c,"
       " (SELECT count(*) FROM lineitem) AS n)")
def p10_sketches(spark, sf):
    """Distinct counts from sketches stored for each month, merged, against exact counts: within four deviations."""
    from ..operators import sketches

    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    li = table(spark, sf, "lineitem")
    monthly = sketches.column_sketches(li, F.trunc("l_shipdate", "month"), cols).checkpoint(eager=True)
    exact = profile.distinct_counts(li, cols).withColumnRenamed("n_distinct", "exact")
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 4 * sketches.THETA_DEVIATION * F.col("exact") + 0.5
    return (sketches.merged_distinct(monthly).join(exact, "column")
            .select(F.col("column").alias("column_name"), "n", near.alias("within_bound")))
