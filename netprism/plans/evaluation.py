"""Queries: evaluation (V01-V07) and alerts / reports.

They need only a prediction table.  ``predictions`` derives one from events
with a fixed rule (FIXTURES A7 layout), so that DuckDB can check the metric
code; the model queries (M*) feed the same functions with real predictions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import r6
from ..operators import evaluate as ev
from ..operators import sketches
from ..sources.tables import FLOWS_SQL, flows, table
from .catalog import query, with_ctes
from .profiling import REPORT_SQL, cleaned_sets

PRED_SQL = """pred AS (
  SELECT event_id AS row_id, ts, user_id,
    CASE WHEN event_type IN ('view', 'click') THEN 'normal' ELSE event_type END AS label,
    CASE WHEN value < 5 THEN 'normal'
         WHEN value < 20 THEN CASE WHEN event_type IN ('view', 'click') THEN 'normal' ELSE event_type END
         WHEN value < 30 THEN 'error' ELSE 'signup' END AS prediction,
    0.5 + (user_id % 50) / 100.0 AS confidence,
    CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM events)"""


def predictions(spark, sf):
    e = table(spark, sf, "events")
    lab = F.when(F.col("event_type").isin("view", "click"), "normal").otherwise(F.col("event_type"))
    v = F.col("value")
    pred = (F.when(v < 5, "normal").when(v < 20, lab).when(v < 30, "error").otherwise("signup"))
    return e.select(F.col("event_id").alias("row_id"), "ts", "user_id", lab.alias("label"),
                    pred.alias("prediction"), (F.lit(0.5) + (F.col("user_id") % 50) / 100.0)
                    .alias("confidence"),
                    F.when(F.col("event_id") % 5 == 0, "test").otherwise("train").alias("split"))


@query("V01_accuracy", with_ctes("SELECT split, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy"
                                 " FROM pred GROUP BY split", PRED_SQL))
def v01(spark, sf):
    a = ev.accuracy(predictions(spark, sf), by=["split"])
    return a.select("split", r6("accuracy").alias("accuracy"))


PC_SQL = """cm AS (SELECT split, label, prediction, count(*) AS n FROM pred GROUP BY ALL),
cls AS (SELECT split, label AS cls FROM cm UNION SELECT split, prediction FROM cm),
pc AS (
  SELECT c.split, c.cls,
    coalesce((SELECT sum(n) FROM cm WHERE cm.split = c.split AND label = c.cls AND prediction = c.cls), 0) AS tp,
    coalesce((SELECT sum(n) FROM cm WHERE cm.split = c.split AND label = c.cls), 0) AS support,
    coalesce((SELECT sum(n) FROM cm WHERE cm.split = c.split AND prediction = c.cls), 0) AS predicted
  FROM cls c),
pr AS (SELECT split, support, tp, CASE WHEN predicted > 0 THEN tp * 1.0 / predicted ELSE 0 END AS p,
              CASE WHEN support > 0 THEN tp * 1.0 / support ELSE 0 END AS r FROM pc),
wm AS (SELECT split, sum(tp) * 1.0 / sum(support) AS accuracy, sum(p * support) / sum(support) AS precision,
              sum(r * support) / sum(support) AS recall,
              sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support) AS f1
       FROM pr GROUP BY split)"""


@query("V02_weighted_metrics", with_ctes(
    "SELECT split, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,"
    " round(recall, 6) AS recall, round(f1, 6) AS f1 FROM wm", PRED_SQL, PC_SQL))
def v02(spark, sf):
    m = ev.weighted_metrics(predictions(spark, sf), by=["split"])
    return m.select("split", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


_CLASSES = ("error", "normal", "purchase", "signup")


@query("V03_confusion_matrix", with_ctes(
    "SELECT label, " + ", ".join(f"CAST(count_if(prediction = '{c}') AS BIGINT) AS {c}" for c in _CLASSES)
    + " FROM pred WHERE split = 'test' GROUP BY label", PRED_SQL))
def v03(spark, sf):
    p = predictions(spark, sf).where(F.col("split") == "test")
    return ev.confusion_matrix(p)


@query("V04_false_positive_rates", with_ctes(
    "SELECT round(sum(fp) * 1.0 / (sum(fp) + sum(tn)), 6) AS fpr_micro,"
    " round((SELECT count_if(label = 'normal' AND prediction <> 'normal') * 1.0 / count_if(label = 'normal')"
    " FROM pred WHERE split = 'test'), 6) AS fpr_binary FROM ("
    " SELECT c.cls, (SELECT count(*) FROM t WHERE prediction = c.cls AND label <> c.cls) AS fp,"
    " (SELECT count(*) FROM t WHERE prediction <> c.cls AND label <> c.cls) AS tn"
    " FROM (SELECT DISTINCT label AS cls FROM t) c)",
    PRED_SQL, "t AS (SELECT label, prediction FROM pred WHERE split = 'test'"
              " AND prediction IN (SELECT label FROM pred WHERE split = 'test'))"))
def v04(spark, sf):
    p = predictions(spark, sf).where(F.col("split") == "test")
    r = ev.false_positive_rates(p)
    return r.select(r6("fpr_micro").alias("fpr_micro"), r6("fpr_binary").alias("fpr_binary"))


@query("V05_class_hit_rates", with_ctes(
    "SELECT label, prediction, n, support, round(n * 1.0 / support, 6) AS share FROM ("
    " SELECT label, prediction, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY label) AS BIGINT) AS support"
    " FROM pred WHERE split = 'test' GROUP BY label, prediction)", PRED_SQL))
def v05(spark, sf):
    h = ev.class_hit_rates(predictions(spark, sf).where(F.col("split") == "test"))
    return h.select("label", "prediction", "n", "support", r6("share").alias("share"))


@query("V06_train_test_metrics", with_ctes(
    "SELECT split, metric, round(value, 6) AS value FROM (UNPIVOT wm ON accuracy, precision, recall, f1"
    " INTO NAME metric VALUE value)", PRED_SQL, PC_SQL))
def v06(spark, sf):
    t = ev.metric_table(predictions(spark, sf))
    return t.select("split", "metric", r6("value").alias("value"))


@query("V07_drift_psi", with_ctes(
    "SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM ("
    " SELECT coalesce(max(CASE WHEN period = 'first' THEN s END), 1e-6) AS e,"
    " coalesce(max(CASE WHEN period = 'second' THEN s END), 1e-6) AS a FROM ("
    "  SELECT period, label, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY period) AS s FROM ("
    "   SELECT CASE WHEN day(ts) <= 15 THEN 'first' ELSE 'second' END AS period, label FROM pred)"
    "  GROUP BY period, label) GROUP BY label)", PRED_SQL))
def v07(spark, sf):
    p = predictions(spark, sf).withColumn(
        "period", F.when(F.dayofmonth("ts") <= 15, "first").otherwise("second"))
    return ev.psi(p, "period", "label", "first", "second").select(r6("psi").alias("psi"))


@query("V07_numeric_drift", "WITH v AS (SELECT value, day(ts) <= 15 AS early FROM events WHERE value IS NOT NULL),"
       " c AS (SELECT value, count_if(early) AS e, count_if(NOT early) AS l FROM v GROUP BY value),"
       " s AS (SELECT abs(sum(e) OVER w / sum(e) OVER () - sum(l) OVER w / sum(l) OVER ()) AS d FROM c WINDOW w AS (ORDER BY value))"
       " SELECT 'value' AS column_name, (SELECT count(*) FROM v WHERE early) AS n_first, (SELECT count(*) FROM v WHERE NOT early)"
       " AS n_second, max(d) > 0.1 AS drifted FROM s")
def v07_numeric(spark, sf):
    """Kolmogorov-Smirnov distance of the halves of the month, from one stored sketch for each day."""
    events = table(spark, sf, "events")
    daily = sketches.column_sketches(events, F.dayofmonth("ts"), ["value"], ["value"]).checkpoint(eager=True)
    half = F.when(F.col("part") <= 15, "first").otherwise("second")
    return sketches.drift(daily, half, "first", "second").select(
        F.col("column").alias("column_name"), "n_first", "n_second", (F.col("ks") > 0.1).alias("drifted"))


@query("V07_retrain_rule", with_ctes(
    "SELECT period, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy,"
    " round(first_value(avg(CAST(label = prediction AS DOUBLE))) OVER (ORDER BY period)"
    " - avg(CAST(label = prediction AS DOUBLE)), 6) AS drop_vs_first,"
    " first_value(avg(CAST(label = prediction AS DOUBLE))) OVER (ORDER BY period)"
    " - avg(CAST(label = prediction AS DOUBLE)) > 0.02 AS retrain FROM ("
    " SELECT CASE WHEN day(ts) <= 15 THEN 'first' ELSE 'second' END AS period, label, prediction FROM pred)"
    " GROUP BY period", PRED_SQL))
def v07b(spark, sf):
    p = predictions(spark, sf).withColumn(
        "period", F.when(F.dayofmonth("ts") <= 15, "first").otherwise("second"))
    acc = ev.accuracy(p, by=["period"])
    base = acc.where(F.col("period") == "first").first()["accuracy"]
    d = F.lit(base) - F.col("accuracy")
    return acc.select("period", r6("accuracy").alias("accuracy"), r6(d).alias("drop_vs_first"),
                      (d > 0.02).alias("retrain"))


# ----------------------------------------------------------------- alerts / reports

@query("R01_attack_alerts", with_ctes(
    "SELECT row_id, prediction, confidence, CASE WHEN confidence > 0.9 THEN 'HIGH' ELSE 'MEDIUM' END AS priority,"
    " CASE WHEN confidence > 0.9 THEN 'HIGH' WHEN confidence > 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS priority_docs"
    " FROM pred WHERE prediction NOT IN ('normal', 'Normal', 'NORMAL')", PRED_SQL))
def r01(spark, sf):
    a = ev.attack_alerts(predictions(spark, sf))
    return a.select("row_id", "prediction", "confidence", "priority",
                    ev.priority(F.col("confidence"), ev.PRIORITY_DOCS).alias("priority_docs"))


@query("R02_alert_burst", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS alerts"
       " FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 10")
def r02(spark, sf):
    e = table(spark, sf, "events").where(F.col("event_type") == "error")
    return ev.burst_escalation(e, "ts", "6 hours", 10)


@query("R03_per_class_sample", with_ctes(
    "SELECT row_id, label, prediction, confidence FROM ("
    " SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_id) AS rn FROM pred WHERE split = 'test')"
    " WHERE rn <= 2 ORDER BY rn, label, row_id LIMIT 5", PRED_SQL))
def r03(spark, sf):
    p = predictions(spark, sf).where(F.col("split") == "test").select(
        "row_id", "label", "prediction", "confidence")
    return ev.per_class_sample(p, "label", ["row_id"], 2, 5)


@query("R04_sample_with_normal", with_ctes(
    "(SELECT row_id, label, prediction FROM pred WHERE split = 'test' AND label = 'normal' ORDER BY row_id LIMIT 1)"
    " UNION ALL (SELECT row_id, label, prediction FROM pred WHERE split = 'test' AND row_id <> ("
    " SELECT min(row_id) FROM pred WHERE split = 'test' AND label = 'normal') ORDER BY row_id LIMIT 4)", PRED_SQL))
def r04(spark, sf):
    p = predictions(spark, sf).where(F.col("split") == "test").select("row_id", "label", "prediction")
    return ev.sample_with_normal(p, "label", ["row_id"], 5)


SCORE_SQL = """sc AS (
  SELECT event_id, value / 100.0 AS score,
         CAST(value >= (SELECT quantile_cont(value, 0.95) FROM events) AS INTEGER) AS is_anomaly FROM events)"""


def scored_events(spark, sf):
    from ..operators.quantiles import exact_quantiles

    e = table(spark, sf, "events")
    cut = exact_quantiles(e, {"value": [0.95]})["value"][0]
    return e.select("event_id", (F.col("value") / 100.0).alias("score"),
                    (F.col("value") >= F.lit(cut)).cast("int").alias("is_anomaly"))


@query("R05_anomaly_report", with_ctes(
    "SELECT count(*) AS total, CAST(sum(is_anomaly) AS BIGINT) AS anomalies,"
    " round(avg(is_anomaly) * 100, 6) AS anomaly_pct FROM sc", PRED_SQL, SCORE_SQL))
def r05(spark, sf):
    totals, _ = ev.anomaly_report(scored_events(spark, sf))
    return totals.select("total", "anomalies", r6("anomaly_pct").alias("anomaly_pct"))


@query("R05_top_anomalies", with_ctes(
    "SELECT event_id, round(score, 6) AS score FROM sc WHERE is_anomaly = 1 ORDER BY score DESC, event_id"
    " LIMIT 10", SCORE_SQL))
def r05b(spark, sf):
    _, top = ev.anomaly_report(scored_events(spark, sf), order_by=["event_id"])
    return top.select("event_id", r6("score").alias("score"))


@query("R06_anomaly_rate_alert", with_ctes(
    "SELECT round(avg(CAST(is_anomaly AS DOUBLE)), 6) AS anomaly_rate, avg(CAST(is_anomaly AS DOUBLE)) > 0.05"
    " AS alert_triggered, CASE WHEN avg(CAST(is_anomaly AS DOUBLE)) > 0.05 THEN 'ESCALATE' ELSE 'NORMAL' END"
    " AS action, CASE WHEN avg(CAST(is_anomaly AS DOUBLE)) > 0.05 THEN 'HIGH' ELSE 'NONE' END AS severity"
    " FROM sc", SCORE_SQL))
def r06(spark, sf):
    a = ev.anomaly_rate_alert(scored_events(spark, sf))
    return a.select(r6("anomaly_rate").alias("anomaly_rate"), "alert_triggered", "action", "severity")


@query("R07_risk_level", with_ctes(
    "SELECT flow_id, CASE WHEN r > 2 THEN 'HIGH' WHEN r > 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM ("
    " SELECT flow_id, coalesce(CASE WHEN total_backward_packets + 1 <> 0 THEN (total_length_of_fwd_packets + 1)"
    " / (total_backward_packets + 1.0) END, 1.0) AS r FROM flows)", FLOWS_SQL))
def r07(spark, sf):
    f = flows(spark, sf)
    ratio = F.coalesce(F.try_divide(F.col("total_length_of_fwd_packets") + 1,
                                    F.col("total_backward_packets").cast("double") + 1), F.lit(1.0))
    return f.select("flow_id", ev.risk_level(ratio).alias("risk"))


@query("R08_multi_dataset_summary", REPORT_SQL)
def r08(spark, sf):
    from ..operators.profile import before_after_counts, dataset_report

    r = dataset_report(before_after_counts(cleaned_sets(spark, sf)))
    return r.withColumn("retention_pct", r6("retention_pct"))


@query("R09_run_info", with_ctes(
    "SELECT count(*) AS total_samples, CAST(count_if(split = 'test') AS BIGINT) AS test_samples,"
    " count(DISTINCT CASE WHEN split = 'test' THEN label END) AS classes,"
    " round(avg(CASE WHEN split = 'test' THEN CAST(label = prediction AS DOUBLE) END), 6) AS accuracy,"
    " (SELECT count(*) FROM (DESCRIBE pred) WHERE column_name NOT IN ('row_id', 'label', 'prediction', 'split'))"
    " AS features FROM pred", PRED_SQL))
def r09(spark, sf):
    i = ev.run_info(predictions(spark, sf), keys=["row_id"])
    return i.select("total_samples", "test_samples", "classes", r6("accuracy").alias("accuracy"), "features")
