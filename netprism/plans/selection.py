"""Queries: feature selection."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.safe import r6
from ..operators import discretize
from ..operators import select as sel
from ..sources.tables import FLOWS_SQL, flows, table
from .catalog import query, with_ctes
from .profiling import FLOW_COLUMNS

# lineitem numeric columns plus a perfectly correlated copy (FIXTURES B3) and a
# constant column, so that L02-L04 have hits.
SEL_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "qty2"]
SEL_SQL = """li AS (
  SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, l_quantity * 2 AS qty2,
         l_tax * 0 AS const_col, l_returnflag AS Label FROM lineitem)"""


def sel_frame(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber",
                     (F.col("l_quantity") * 2).alias("qty2"), (F.col("l_tax") * 0).alias("const_col"),
                     F.col("l_returnflag").alias("Label"))


CORR_SQL = "corrs AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, abs(corr({a}, {b})) AS abs_r FROM li"
    for a, b in combinations(SEL_COLS, 2)) + ")"
VAR_SQL = "vars AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, var_samp({c}) AS variance FROM li" for c in SEL_COLS + ["const_col"]) + ")"


@query("L01_abs_correlation", with_ctes(
    "SELECT feature_a, feature_b, round(abs_r, 6) AS abs_r FROM corrs", SEL_SQL, CORR_SQL))
def l01(spark, sf):
    c = sel.correlation_pairs(sel_frame(spark, sf), SEL_COLS)
    return c.select("feature_a", "feature_b", r6("abs_r").alias("abs_r"))


@query("L02_high_correlation_pairs", with_ctes(
    "SELECT feature_a, feature_b, round(abs_r, 6) AS abs_r FROM corrs WHERE abs_r > 0.95",
    SEL_SQL, CORR_SQL))
def l02(spark, sf):
    c = sel.high_correlation_pairs(sel.correlation_pairs(sel_frame(spark, sf), SEL_COLS))
    return c.select("feature_a", "feature_b", r6("abs_r").alias("abs_r"))


RED_SQL = """red AS (
  SELECT DISTINCT CASE WHEN va.variance < vb.variance THEN c.feature_a ELSE c.feature_b END AS feature
  FROM corrs c JOIN vars va ON va.feature = c.feature_a JOIN vars vb ON vb.feature = c.feature_b
  WHERE c.abs_r > 0.95)"""


@query("L03_redundant_features", with_ctes("SELECT feature FROM red", SEL_SQL, CORR_SQL, VAR_SQL, RED_SQL))
def l03(spark, sf):
    df = sel_frame(spark, sf)
    pairs = sel.high_correlation_pairs(sel.correlation_pairs(df, SEL_COLS))
    return sel.redundant_features(pairs, sel.variances(df, SEL_COLS))


@query("L04_low_variance", with_ctes(
    "SELECT feature, round(variance, 6) AS variance FROM vars WHERE variance < 1e-6", SEL_SQL, VAR_SQL))
def l04(spark, sf):
    v = sel.variances(sel_frame(spark, sf), SEL_COLS + ["const_col"])
    return v.where(F.col("variance") < sel.VAR_THRESHOLD).select("feature", r6("variance").alias("variance"))


_JUST_IN = "Varies and does not repeat another feature"
_JUST_CORR = "Repeats a feature with more variance (abs r above 0.95)"
_JUST_VAR = "Almost constant (variance below 1e-6)"


@query("L05_selection_table", with_ctes(
    "SELECT v.feature AS Feature, 'Network Traffic' AS Module,"
    " CASE WHEN r.feature IS NOT NULL OR v.variance < 1e-6 THEN 'Excluded' ELSE 'Included' END AS Status,"
    f" CASE WHEN r.feature IS NOT NULL THEN '{_JUST_CORR}' WHEN v.variance < 1e-6 THEN '{_JUST_VAR}'"
    f" ELSE '{_JUST_IN}' END AS Justification FROM vars v LEFT JOIN red r USING (feature)",
    SEL_SQL, CORR_SQL, VAR_SQL, RED_SQL))
def l05(spark, sf):
    _, tbl = sel.select_features(sel_frame(spark, sf), label="Label")
    return tbl


@query("L06_near_constant", with_ctes(
    "SELECT feature, round(top_share, 6) AS top_share, top_share > 0.99 AS near_constant FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, max(n) * 1.0 / sum(n) AS top_share FROM (SELECT count(*) AS n FROM flows"
        f" GROUP BY {c})" for c in FLOW_COLUMNS) + ")", FLOWS_SQL))
def l06(spark, sf):
    nc = sel.near_constant_features(flows(spark, sf), FLOW_COLUMNS)
    return nc.select("feature", r6("top_share").alias("top_share"), "near_constant")


_MI_COLS = [c for c in FLOW_COLUMNS if c not in ("protocol", "label", "ts")]


def _mi_sql():
    parts = []
    for c in _MI_COLS:
        b = (f"coalesce(CAST(least(floor(({c} - (SELECT min({c}) FROM flows)) * 1.0 /"
             f" ((SELECT max({c}) FROM flows) - (SELECT min({c}) FROM flows)) * 10), 9) AS INTEGER), -1)")
        parts.append(f"SELECT '{c}' AS feature, {b} AS bin, label AS y FROM flows")
    return "mi_long AS (" + " UNION ALL ".join(parts) + """),
joint AS (SELECT feature, bin, y, count(*) AS nxy FROM mi_long GROUP BY ALL),
px AS (SELECT feature, bin, sum(nxy) AS nx FROM joint GROUP BY ALL),
py AS (SELECT feature, y, sum(nxy) AS ny FROM joint GROUP BY ALL),
nn AS (SELECT feature, sum(nxy) AS n FROM joint GROUP BY ALL)"""


@query("L07_mutual_information", with_ctes(
    "SELECT feature, round(mi, 6) AS mutual_information, mi > 0.01 AS selected FROM ("
    " SELECT j.feature, sum((nxy * 1.0 / n) * ln((nxy * 1.0 * n) / (nx * ny))) AS mi FROM joint j"
    " JOIN px USING (feature, bin) JOIN py USING (feature, y) JOIN nn USING (feature) GROUP BY j.feature)",
    FLOWS_SQL, _mi_sql()))
def l07(spark, sf):
    mi = sel.mutual_information(flows(spark, sf), _MI_COLS, "label", bins=10)
    return mi.select("feature", r6("mutual_information").alias("mutual_information"),
                     (F.col("mutual_information") > 0.01).alias("selected"))


_CUT_COLS = ["syn_flag_count", "ack_flag_count", "fin_flag_count", "total_fwd_packets", "total_backward_packets"]


def _cut_sql():
    """The best first cut over all values of a column, and whether its gain pays for it."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, coalesce(label, '') AS y FROM flows"
                              for c in _CUT_COLS)
    return ("lng AS (SELECT * FROM (" + long + """) WHERE x IS NOT NULL),
cls AS (SELECT feature, y, count(*) AS ny FROM lng GROUP BY ALL),
grid AS (SELECT v.feature, v.x, c.y, c.ny, (SELECT count(*) FROM lng l WHERE l.feature = v.feature AND l.y = c.y AND l.x < v.x) AS lo
  FROM (SELECT DISTINCT feature, x FROM lng) v JOIN cls c ON c.feature = v.feature),
sums AS (SELECT feature, x, sum(ny) AS n, sum(lo) AS nl, sum(ny - lo) AS nr, count(*) AS k,
  count(*) FILTER (lo > 0) AS kl, count(*) FILTER (ny > lo) AS kr,
  log2(sum(ny)) - sum(ny * log2(ny)) / sum(ny) AS h,
  log2(sum(lo)) - sum(CASE WHEN lo > 0 THEN lo * log2(lo) ELSE 0 END) / sum(lo) AS hl,
  log2(sum(ny - lo)) - sum(CASE WHEN ny > lo THEN (ny - lo) * log2(ny - lo) ELSE 0 END) / sum(ny - lo) AS hr
  FROM (SELECT *, sum(lo) OVER (PARTITION BY feature, x) AS below FROM grid) WHERE below > 0 GROUP BY feature, x),
gains AS (SELECT *, h - (nl * hl + nr * hr) / n AS gain FROM sums),
firsts AS (SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, x) = 1)""")


@query("L07_supervised_first_cut", with_ctes(
    "SELECT feature, x AS cut, round(gain, 6) AS gain, gain > (log2(n - 1) + log2(pow(3, k) - 2)"
    " - (k * h - kl * hl - kr * hr)) / n AS accepted FROM firsts", FLOWS_SQL, _cut_sql()))
def l07_first_cut(spark, sf):
    cuts = discretize.mdl_cuts(flows(spark, sf), _CUT_COLS, "label").where("level = 0")
    return cuts.select("feature", "cut", r6("gain").alias("gain"), "accepted")


@query("L07_supervised_information")
def l07_supervised(spark, sf):
    """Mutual information of all numeric columns with the label, cut at their accepted cut points."""
    mi = discretize.mdl_information(flows(spark, sf), _MI_COLS, "label")
    return mi.select("feature", "n_bins", r6("mutual_information").alias("mutual_information"))
