"""Evaluation (V01-V07) and alerts / reports (R01-R09) over a prediction table
(``label``, ``prediction``, optional ``confidence``, ``split``).

Every metric comes from the confusion counts ``groupBy(label, prediction)``:
one shuffle of at most k x k rows per task after map-side combining, so the
metrics cost one pass whatever the row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import bounded_broadcast, null_safe_join

# Alert priority presets (code: >0.9 HIGH else MEDIUM; documents:
# >0.9 HIGH, >0.7 MEDIUM, else LOW).
PRIORITY_CODE = ((0.9, "HIGH"), (None, "MEDIUM"))
PRIORITY_DOCS = ((0.9, "HIGH"), (0.7, "MEDIUM"), (None, "LOW"))


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, label="label", prediction="prediction", by: Sequence[str] = ()) -> DataFrame:
    """V01."""
    return df.groupBy(*by).agg(F.avg((F.col(label) == F.col(prediction)).cast("double"))
                               .alias("accuracy"))


def per_class(cm: DataFrame, label="label", prediction="prediction", by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, support per class (union of true and predicted classes)."""
    tp = cm.where(F.col(label) == F.col(prediction)).groupBy(*by, F.col(label).alias("cls")).agg(
        F.sum("n").alias("tp"))
    sup = cm.groupBy(*by, F.col(label).alias("cls")).agg(F.sum("n").alias("support"))
    pred = cm.groupBy(*by, F.col(prediction).alias("cls")).agg(F.sum("n").alias("predicted"))
    keys = [*by, "cls"]
    j = sup.join(pred, keys, "full").join(tp, keys, "left").fillna(0, ["tp", "support", "predicted"])
    return j.select(*keys, "tp", "support", "predicted",
                    (F.col("predicted") - F.col("tp")).alias("fp"),
                    (F.col("support") - F.col("tp")).alias("fn"))


def weighted_metrics(df: DataFrame, label="label", prediction="prediction",
                     by: Sequence[str] = ()) -> DataFrame:
    """Support-weighted precision, recall, F1 (zero division -> 0) and accuracy."""
    pc = per_class(confusion_counts(df, label, prediction, by), label, prediction, by)
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    pc = pc.select(*by, "support", "tp", p.alias("p"), r.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))) \
        .otherwise(0.0)
    return pc.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("p") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"))


#: Columns of a dense matrix; more classes than that are no label.
MAX_CLASSES = 2_000


def confusion_matrix(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    """Dense matrix over the classes present in the truth: one row per true
    class, one column per class (predictions of other classes are left out).
    Rows without a true class make a row of their own, but no column."""
    found = df.select(label).where(F.col(label).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"over {MAX_CLASSES} classes: use confusion_counts, the long form")
    classes = sorted(r[0] for r in found)
    cm = confusion_counts(df, label, prediction)
    wide = cm.groupBy(label).pivot(prediction, classes).agg(F.sum("n"))
    return wide.fillna(0, subset=classes)


def false_positive_rates(df: DataFrame, label="label", prediction="prediction",
                         normal: Sequence[str] = ("normal",)) -> DataFrame:
    """Micro one-vs-rest FPR over truth classes (what the reference prints:
    sum FP / (sum FP + sum TN)) and the binary FPR (normal rows flagged as attack)."""
    truth = df.select(F.col(label).alias(prediction)).distinct()
    cm = confusion_counts(df, label, prediction)
    inside = cm.join(bounded_broadcast(truth), prediction, "left_semi")
    pc = per_class(inside, label, prediction)
    # TN_c = T - support_c - predicted_c + tp_c; summed over k classes
    sums = pc.agg(F.sum("fp").alias("fp"), F.sum("support").alias("t"),
                  F.sum(F.col("support") + F.col("predicted") - F.col("tp")).alias("touched"),
                  F.count(F.lit(1)).alias("k"))
    tn = F.col("k") * F.col("t") - F.col("touched")
    micro = sums.select(F.try_divide(F.col("fp").cast("double"), (F.col("fp") + tn).cast("double"))
                        .alias("fpr_micro"))
    is_normal = F.col(label).isin(*normal)
    pred_attack = ~F.col(prediction).isin(*normal)
    binary = df.agg(F.try_divide(F.count_if(is_normal & pred_attack).cast("double"),
                                 F.count_if(is_normal).cast("double")).alias("fpr_binary")).first()[0]
    return micro.withColumn("fpr_binary", F.lit(binary).cast("double"))


def class_hit_rates(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    """Per true class, share of its rows in each predicted class (the hit rate
    is the diagonal); misclassifications are the rows with label != prediction."""
    cm = confusion_counts(df, label, prediction)
    tot = cm.groupBy(label).agg(F.sum("n").alias("support"))
    return null_safe_join(cm, bounded_broadcast(tot), [label]).withColumn("share", F.col("n") / F.col("support"))


def metric_table(df: DataFrame, split="split", label="label", prediction="prediction") -> DataFrame:
    """Long (metric, split, value) for accuracy, precision, recall, F1."""
    m = weighted_metrics(df, label, prediction, by=[split])
    return m.selectExpr(split, "stack(4, 'accuracy', accuracy, 'precision', precision, 'recall', recall,"
                               " 'f1', f1) as (metric, value)")


def psi(df: DataFrame, period: str, category: str, expected: str, actual: str,
        eps: float = 1e-6) -> DataFrame:
    """Population stability index of a categorical column between two periods."""
    counts = df.groupBy(period, category).agg(F.count(F.lit(1)).alias("n"))
    tot = counts.groupBy(period).agg(F.sum("n").alias("t"))
    share = counts.join(bounded_broadcast(tot), period).select(period, category,
                                                         (F.col("n") / F.col("t")).alias("s"))
    wide = share.groupBy(category).pivot(period, [expected, actual]).agg(F.first("s")).fillna(eps)
    e, a = F.col(expected), F.col(actual)
    return wide.agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


# ----------------------------------------------------------------- alerts / reports

def priority(conf: Column, preset=PRIORITY_CODE) -> Column:
    expr = None
    for cut, name in preset:
        if cut is None:
            expr = expr.otherwise(name) if expr is not None else F.lit(name)
        else:
            expr = F.when(conf > cut, name) if expr is None else expr.when(conf > cut, name)
    return expr


def attack_alerts(df: DataFrame, prediction="prediction", confidence="confidence",
                  normal: Sequence[str] = ("normal", "Normal", "NORMAL"), preset=PRIORITY_CODE) -> DataFrame:
    """Rows whose prediction is not a normal label, with a priority."""
    return (df.where(~F.col(prediction).isin(*normal))
            .withColumn("priority", priority(F.col(confidence), preset)))


def burst_escalation(df: DataFrame, ts: str, window: str = "1 minute", limit: int = 10,
                     key: Sequence[str] = ()) -> DataFrame:
    """Windows with more than ``limit`` alerts."""
    c = df.groupBy(F.window(ts, window).alias("w"), *key).agg(F.count(F.lit(1)).alias("alerts"))
    return c.where(F.col("alerts") > limit).select(F.col("w.start").alias("window_start"), *key, "alerts")


def per_class_sample(df: DataFrame, label: str, order_by: Sequence[str], per_class: int = 2,
                     total: int = 5) -> DataFrame:
    """At most ``per_class`` rows per class, ``total`` overall, by an explicit
    order.  ``row_number() <= k`` is planned with a partial group limit before
    the shuffle, so a hot class sends only k rows per task."""
    w = Window.partitionBy(label).orderBy(*order_by)
    ranked = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= per_class)
    return ranked.orderBy("__rn", label, *order_by).limit(total).drop("__rn")


def sample_with_normal(df: DataFrame, label: str, order_by: Sequence[str], n: int = 5,
                       normal: str = "normal") -> DataFrame:
    """One normal row (if any) plus the first others not already chosen."""
    # at most n + 1 rows
    chosen = df.where(F.lower(F.col(label)) == normal).orderBy(*order_by).limit(1).collect()
    first = df.orderBy(*order_by).limit(n + 1).collect()
    known = [i for i, r in enumerate(first) if (r[label] or "").lower() == normal]
    if known:  # the first normal row of the order is among them: it leads, and the others follow
        chosen = [first.pop(known[0])]
    return df.sparkSession.createDataFrame((chosen + first)[:n], df.schema)


def anomaly_report(df: DataFrame, flag: str = "is_anomaly", score: str = "score",
                   order_by: Sequence[str] = (), top: int = 10):
    """(totals, top anomalies by score desc then order columns)."""
    totals = df.agg(F.count(F.lit(1)).alias("total"), F.sum(flag).alias("anomalies"),
                    (F.avg(flag) * 100).alias("anomaly_pct"))
    top_rows = df.where(F.col(flag) == 1).orderBy(F.desc(score), *order_by).limit(top)
    return totals, top_rows


def anomaly_rate_alert(df: DataFrame, flag: str = "is_anomaly", threshold: float = 0.05) -> DataFrame:
    """Escalate (severity HIGH) when the anomaly rate is strictly above the threshold."""
    rate = df.agg(F.avg(F.col(flag).cast("double")).alias("anomaly_rate"))
    alert = F.col("anomaly_rate") > threshold
    return rate.select("anomaly_rate", alert.alias("alert_triggered"),
                       F.when(alert, "ESCALATE").otherwise("NORMAL").alias("action"),
                       F.when(alert, "HIGH").otherwise("NONE").alias("severity"))


def risk_level(ratio: Column) -> Column:
    """Byte ratio > 2 HIGH, > 1 MEDIUM, else LOW."""
    return F.when(ratio > 2, "HIGH").when(ratio > 1, "MEDIUM").otherwise("LOW")


def run_info(df: DataFrame, label="label", prediction="prediction", split="split",
             keys: Sequence[str] = ()) -> DataFrame:
    """Samples, test samples, features, classes (in test), accuracy (test).
    Features are the columns besides label, prediction, split and ``keys``."""
    test = F.col(split) == "test"
    n_features = len([c for c in df.columns if c not in (label, prediction, split, *keys)])
    return df.agg(F.count(F.lit(1)).alias("total_samples"),
                  F.count_if(test).alias("test_samples"),
                  F.count_distinct(F.when(test, F.col(label))).alias("classes"),
                  F.avg(F.when(test, (F.col(label) == F.col(prediction)).cast("double")))
                  .alias("accuracy")).withColumn("features", F.lit(n_features))
