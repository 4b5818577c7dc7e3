"""Queries: cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import pandas_div, r6
from ..operators import clean
from ..session import ensure_checkpoint_dir
from ..sources.tables import FLOWS_SQL, flows, table
from .catalog import query, with_ctes
from .profiling import DUP_INPUT_SQL, FLOW_COLUMNS, TRIM_SQL, dup_input
from .weblogs import PARSED_SQL, parsed_weblogs

DEDUP_SQL = "d AS (SELECT DISTINCT * FROM flows)"


@query("C01_drop_duplicates", with_ctes("SELECT DISTINCT * FROM dup_input", DUP_INPUT_SQL))
def c01(spark, sf):
    return clean.drop_duplicates(dup_input(spark, sf))


@query("C02_median_imputation", with_ctes(
    "SELECT flow_id, round(coalesce(flow_duration, (SELECT quantile_cont(flow_duration, 0.5) FROM d)), 6)"
    " AS flow_duration FROM d", FLOWS_SQL, DEDUP_SQL))
def c02(spark, sf):
    # read by three passes: written once
    ensure_checkpoint_dir(spark)
    d = clean.drop_duplicates(flows(spark, sf)).checkpoint(eager=True)
    filled, _ = clean.impute_median(d, ["flow_duration"])
    return filled.select("flow_id", r6("flow_duration").alias("flow_duration"))


@query("C03_mode_imputation", with_ctes(
    "SELECT flow_id, coalesce(protocol, (SELECT protocol FROM d WHERE protocol IS NOT NULL"
    " GROUP BY protocol ORDER BY count(*) DESC, protocol LIMIT 1), 'Unknown') AS protocol FROM d",
    FLOWS_SQL, DEDUP_SQL))
def c03(spark, sf):
    d = clean.drop_duplicates(flows(spark, sf))
    filled, _ = clean.impute_mode(d, ["protocol"])
    return filled.select("flow_id", "protocol")


@query("C04_drop_identifiers", with_ctes(
    "SELECT * EXCLUDE (flow_id, source_id) FROM flows", FLOWS_SQL))
def c04(spark, sf):
    df = flows(spark, sf)
    return df.drop(*clean.identifier_drop_list(df, "substring"))


@query("C05_high_cardinality", "SELECT 'c_name' AS \"column\", count(DISTINCT c_name) * 1.0 / count(*) > 0.9"
       " AS high_cardinality FROM customer UNION ALL SELECT 'c_mktsegment',"
       " count(DISTINCT c_mktsegment) * 1.0 / count(*) > 0.9 FROM customer")
def c05(spark, sf):
    cust = table(spark, sf, "customer")
    return clean.high_cardinality_report(cust, ["c_name", "c_mktsegment"], 0.9)


@query("C06_rename_label", with_ctes("SELECT * EXCLUDE (label), label AS Label FROM flows", FLOWS_SQL))
def c06(spark, sf):
    return flows(spark, sf).withColumnRenamed("label", "Label")


@query("C07_normalise_labels", with_ctes(
    f"SELECT {TRIM_SQL.format(c='label')} AS Label, count(*) AS n FROM flows GROUP BY 1", FLOWS_SQL))
def c07(spark, sf):
    df = clean.standardize_label(flows(spark, sf))
    return df.groupBy("Label").agg(F.count(F.lit(1)).alias("n"))


_R_MISS = "A typical value leaves the column''s centre in place"
_R_ID = "A model would learn rows by heart"
C08_SQL = with_ctes(
    "SELECT 'All' AS \"Column\", format('{:,}', n - nd) || ' duplicate records' AS Issue,"
    " 'Kept one of each' AS Action, 'Copies would count twice in every statistic' AS Reason"
    " FROM (SELECT (SELECT count(*) FROM flows) AS n, (SELECT count(*) FROM d) AS nd) WHERE n > nd"
    " UNION ALL SELECT 'flow_duration', format('{:,}', m) || ' missing values (' || format('{:.2f}', m * 100.0 / n)"
    " || '%)', 'Filled with median (' || format('{:.2f}', med) || ')', '" + _R_MISS + "'"
    " FROM (SELECT count(*) - count(flow_duration) AS m, count(*) AS n,"
    " quantile_cont(flow_duration, 0.5) AS med FROM d) WHERE m > 0"
    " UNION ALL SELECT 'protocol', format('{:,}', m) || ' missing values (' || format('{:.2f}', m * 100.0 / n)"
    " || '%)', 'Filled with mode (' || mode_value || ')', '" + _R_MISS + "'"
    " FROM (SELECT count(*) - count(protocol) AS m, count(*) AS n, (SELECT protocol FROM d"
    " WHERE protocol IS NOT NULL GROUP BY protocol ORDER BY count(*) DESC, protocol LIMIT 1) AS mode_value"
    " FROM d) WHERE m > 0"
    # identifier columns and the label rename follow from the column names of the view
    " UNION ALL SELECT 'flow_id', 'Names single rows (identifier or nearly unique)', 'Dropped', '" + _R_ID + "'"
    " UNION ALL SELECT 'source_id', 'Names single rows (identifier or nearly unique)', 'Dropped', '" + _R_ID + "'"
    " UNION ALL SELECT 'label', 'Label under another name', 'Now called \"Label\"',"
    " 'One name for the label in all data sets'", FLOWS_SQL, DEDUP_SQL)


@query("C08_cleaning_log", C08_SQL)
def c08(spark, sf):
    model = clean.fit_cleaning(flows(spark, sf))
    return model.log_frame(spark)


@query("C09_cleaning_summary", with_ctes(
    "SELECT (SELECT count(*) FROM dup_input) AS rows_before,"
    " (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_input)) AS rows_after,"
    " (SELECT count(*) FROM dup_input) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_input))"
    " AS rows_removed, 11 AS columns_before, 10 AS columns_after, 1 AS columns_removed", DUP_INPUT_SQL))
def c09(spark, sf):
    model = clean.fit_cleaning(dup_input(spark, sf))
    return model.summary_frame(spark)


RATIO_SQL = "x AS (SELECT flow_id, CASE WHEN flow_iat_mean <> 0 THEN flow_iat_std / flow_iat_mean END AS x FROM flows)"


def _ratio_frame(spark, sf):
    # IEEE ratio: +inf where the mean is 0 and the std is not, NaN where both are 0
    df = flows(spark, sf)
    return df.select("flow_id", pandas_div(F.col("flow_iat_std"), F.col("flow_iat_mean")).alias("x"))


@query("C10_infinite_to_median", with_ctes(
    "SELECT flow_id, round(coalesce(x, (SELECT quantile_cont(x, 0.5) FROM x)), 6) AS x FROM x",
    FLOWS_SQL, RATIO_SQL))
def c10(spark, sf):
    filled, _ = clean.replace_infinite_then_median(_ratio_frame(spark, sf), ["x"])
    return filled.select("flow_id", r6("x").alias("x"))


@query("C11_infinite_to_constant", with_ctes(
    "SELECT flow_id, round(coalesce(x, 1.0), 6) AS x FROM x", FLOWS_SQL, RATIO_SQL))
def c11(spark, sf):
    return clean.replace_infinite(_ratio_frame(spark, sf), ["x"], 1.0).select(
        "flow_id", r6("x").alias("x"))


RARE_SQL = "lab AS (SELECT event_id, event_type || ':' || CAST(user_id AS VARCHAR) AS label FROM events)"


@query("C12_drop_rare_classes", with_ctes(
    "SELECT event_id, label FROM lab WHERE label IN"
    " (SELECT label FROM lab GROUP BY label HAVING count(*) >= 10)", RARE_SQL))
def c12(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("label"))
    return clean.drop_rare_classes(ev, "label", 10)


def _nulls_first(cols):
    return ", ".join(f"{c} ASC NULLS FIRST" for c in cols)


_C13_ORDER = ["ts"] + [c for c in FLOW_COLUMNS if c not in ("flow_id", "ts")]


@query("C13_key_duplicates_flag", with_ctes(
    "SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY "
    + _nulls_first(_C13_ORDER) + ") > 1 AS is_duplicate FROM flows", FLOWS_SQL))
def c13(spark, sf):
    return clean.flag_key_duplicates(flows(spark, sf), ["flow_id"], ["ts"])


@query("C14_zero_fill", with_ctes(
    "SELECT flow_id, coalesce(flow_duration, 0) AS flow_duration FROM flows", FLOWS_SQL))
def c14(spark, sf):
    return clean.zero_fill(flows(spark, sf), ["flow_duration"]).select("flow_id", "flow_duration")


GAPPY_SQL = "ev AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"


def gappy_events(spark, sf):
    """events.value with nulls injected (FIXTURES B3)."""
    ev = table(spark, sf, "events")
    return ev.select("event_id", "user_id", "ts",
                     F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


@query("C15_forward_fill", with_ctes(
    "SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM ev", GAPPY_SQL))
def c15(spark, sf):
    f = clean.forward_fill(gappy_events(spark, sf), ["value"], "user_id", ["ts", "event_id"])
    return f.select("event_id", "user_id", "value")


SPARSE_SQL = """sp AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 17 <> 0 THEN l_discount END AS c1,
    CASE WHEN l_orderkey % 23 <> 0 THEN l_linestatus END AS c2,
    CASE WHEN l_orderkey % 3 <> 0 THEN l_tax END AS c3,
    CASE WHEN l_orderkey % 2 <> 0 THEN l_quantity END AS c4
  FROM lineitem),
sh AS (
  SELECT *, ((c1 IS NULL)::INT + (c2 IS NULL)::INT + (c3 IS NULL)::INT + (c4 IS NULL)::INT) / 4.0
    AS missing_share FROM sp)"""


@query("C16_sparse_rows", with_ctes(
    "SELECT l_orderkey, l_linenumber, missing_share, CAST(missing_share > 0.3 AS INTEGER) AS sparse_flag"
    " FROM sh WHERE missing_share <= 0.5", SPARSE_SQL))
def c16(spark, sf):
    k = F.col("l_orderkey")
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(k % 17 != 0, F.col("l_discount")).alias("c1"),
        F.when(k % 23 != 0, F.col("l_linestatus")).alias("c2"),
        F.when(k % 3 != 0, F.col("l_tax")).alias("c3"),
        F.when(k % 2 != 0, F.col("l_quantity")).alias("c4"))
    out = clean.drop_sparse_rows(li, 0.5, 0.3, cols=["c1", "c2", "c3", "c4"])
    return out.select("l_orderkey", "l_linenumber", "missing_share", "sparse_flag")


@query("C17_winsorize_p99", with_ctes(
    "SELECT flow_id, round(least(total_length_of_fwd_packets,"
    " (SELECT quantile_cont(total_length_of_fwd_packets, 0.99) FROM flows)), 6) AS fwd_bytes FROM flows",
    FLOWS_SQL))
def c17(spark, sf):
    w, _ = clean.winsorize(flows(spark, sf), ["total_length_of_fwd_packets"], 0.99)
    return w.select("flow_id", r6("total_length_of_fwd_packets").alias("fwd_bytes"))


@query("C18_invalid_web_records", with_ctes(
    "SELECT event_id, ip, status, size, (coalesce(regexp_full_match(ip, '" + clean.IPV4.strip("^$") + "'), false)"
    " AND NOT coalesce(regexp_matches(uri, '[\\x00-\\x1f\\x7f]'), true)"
    " AND coalesce(status BETWEEN 100 AND 599, false) AND coalesce(size >= 0, true)) AS valid FROM parsed",
    PARSED_SQL))
def c18(spark, sf):
    p = parsed_weblogs(spark, sf)
    return p.select("event_id", "ip", "status", "size", clean.web_record_valid().alias("valid"))


@query("C19_semantic_defaults", with_ctes(
    "SELECT event_id, CASE WHEN referer IS NULL OR referer IN ('-', '') THEN 'Direct' ELSE referer END AS referer,"
    " coalesce(user_agent, 'Unknown') AS user_agent FROM parsed", PARSED_SQL))
def c19(spark, sf):
    p = parsed_weblogs(spark, sf)
    out = clean.semantic_defaults(p, {"user_agent": "Unknown"})
    return out.select("event_id", "referer", "user_agent")


@query("C20_file_size_filter", "SELECT doc_id, strlen(text) AS length FROM documents"
       " WHERE strlen(text) BETWEEN 1024 AND 104857600")
def c20(spark, sf):
    from ..sources.files import documents_as_files

    files = documents_as_files(spark, sf)
    return clean.file_filter(files).select("doc_id", "length")


@query("C20_magic_bytes", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pe' WHEN 1 THEN 'elf' WHEN 2 THEN 'pdf'"
       " ELSE 'zip' END AS kind, strlen(text) + CASE doc_id % 5 WHEN 0 THEN 2 WHEN 3 THEN 2 ELSE 4 END AS length"
       " FROM documents WHERE doc_id % 5 < 4 AND strlen(text)"
       " + CASE doc_id % 5 WHEN 0 THEN 2 WHEN 3 THEN 2 ELSE 4 END BETWEEN 1024 AND 104857600")
def c20_magic(spark, sf):
    """Documents as files of five kinds: each magic number in front of every fifth one, one kind without any."""
    from ..sources.files import documents_as_files

    files = documents_as_files(spark, sf)
    head = F.lit(bytearray(b"\x00")).cast("binary")
    for i, m in enumerate(clean.MAGIC_NUMBERS):
        head = F.when(F.col("doc_id") % 5 == i, F.lit(bytearray(m))).otherwise(head)
    files = files.withColumn("content", F.concat(head, F.col("content"))).withColumn(
        "length", F.octet_length("content").cast("long"))
    kept = clean.file_filter(files, magic=list(clean.MAGIC_NUMBERS))
    return kept.select("doc_id", clean.file_kind().alias("kind"), "length")


@query("C21_mask_pii", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '"
       + clean.EMAIL_RE + "', '<EMAIL>', 'g'), '" + clean.IP_RE + "', '<IP>', 'g'), '"
       + clean.PHONE_RE + "', '<PHONE>', 'g') AS text FROM documents")
def c21(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", clean.mask_pii(F.col("text")).alias("text"))
