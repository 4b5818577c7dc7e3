"""Feature selection.

Correlations of all pairs are pairwise complete, like pandas: every task adds
up counts, sums, squares and products of its Arrow batches as d x d matrices
over the rows where both columns are present (NaN counts as missing), and the
sums per pair are added on Spark.  One method for every width; only the
d x d result reaches the driver.  Per-column value shares (L06) and mutual information (L07) go
through one ``stack`` + ``groupBy`` for all columns at once: a single
shuffle with map-side combining, so a dominant value is pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import numeric_columns
from ..functions.safe import nan_to_null

CORR_THRESHOLD = 0.95
VAR_THRESHOLD = 1e-6


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long table (feature_a, feature_b, abs_r) for i < j in column order;
    null where a column does not vary over the common rows."""
    import numpy as np
    import pyarrow as pa

    cols = list(cols or numeric_columns(df))
    spark = df.sparkSession
    x = df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])
    d = len(cols)
    if d < 2:
        return spark.createDataFrame([], "feature_a string, feature_b string, abs_r double")
    # sums are taken around the means, which keeps their digits
    means = x.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(d)]).first()
    shift = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means])
    upper = np.triu_indices(d, 1)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def sums(batches):
        total = np.zeros((len(names), d, d))
        with np.errstate(invalid="ignore"):
            for b in batches:
                a = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns], 1)
                here = np.stack([~np.asarray(c.is_null()) for c in b.columns], 1).astype(np.float64)
                a = np.where(here > 0, a - shift, 0.0)
                sx, sxx = a.T @ here, (a * a).T @ here
                total += np.stack([here.T @ here, sx, sx.T, sxx, sxx.T, a.T @ a])
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), *(pa.array(t[upper]) for t in total)],
                                         names=["i", "j", *names])

    got = (x.mapInArrow(sums, "i long, j long, " + ", ".join(f"{n} double" for n in names))
           .groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names]).collect())
    rows = []
    for r in sorted(got, key=lambda r: (r["i"], r["j"])):
        n, value = r["n"], None
        if n > 1:
            vx, vy = r["sxx"] - r["sx"] ** 2 / n, r["syy"] - r["sy"] ** 2 / n
            # below rounding error a column does not vary
            if vx > 1e-14 * abs(r["sxx"]) and vy > 1e-14 * abs(r["syy"]):
                value = abs((r["sxy"] - r["sx"] * r["sy"] / n) / (vx * vy) ** 0.5)
                value = None if value != value else float(value)
        rows.append((cols[r["i"]], cols[r["j"]], value))
    return spark.createDataFrame(rows, "feature_a string, feature_b string, abs_r double")


def high_correlation_pairs(corr: DataFrame, threshold: float = CORR_THRESHOLD) -> DataFrame:
    """L02."""
    return corr.where((F.col("abs_r") > threshold) & ~F.isnan("abs_r"))


def variances(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample variance of every column in one pass, long form (feature, variance); NaN is missing."""
    wide = df.agg(*[F.var_samp(nan_to_null(F.col(c).cast("double"))).alias(f"v{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', v{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) as (feature, variance)")


def redundant_features(pairs: DataFrame, var: DataFrame) -> DataFrame:
    """From each correlated pair the lower-variance column is removed, the
    second one on a tie (the reference's code, not its comment: trap T1).  Every
    pair is judged on its own.  ``var`` has one row per feature: broadcast."""
    va = var.select(F.col("feature").alias("feature_a"), F.col("variance").alias("var_a"))
    vb = var.select(F.col("feature").alias("feature_b"), F.col("variance").alias("var_b"))
    # one row per column of the table: bounded by the schema, not by the data
    j = pairs.join(F.broadcast(va), "feature_a").join(F.broadcast(vb), "feature_b")
    return (j.select(F.when(F.col("var_a") < F.col("var_b"), F.col("feature_a"))
                     .otherwise(F.col("feature_b")).alias("feature"))
            .distinct())


def low_variance_features(var: DataFrame, threshold: float = VAR_THRESHOLD) -> DataFrame:
    """L04."""
    return var.where(F.col("variance") < threshold).select("feature")


def select_features(df: DataFrame, label: str = "Label", module: str = "Network Traffic",
                    corr_threshold: float = CORR_THRESHOLD,
                    var_threshold: float = VAR_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Returns (frame with the selected columns, selection table)."""
    spark = df.sparkSession
    num = numeric_columns(df, exclude=[label])
    excluded: list[tuple[str, str]] = []
    if len(num) > 1:
        corr = correlation_pairs(df, num)
        var = variances(df, num)
        red = [r["feature"] for r in redundant_features(high_correlation_pairs(corr, corr_threshold),
                                                          var).collect()]
        red = [c for c in num if c in set(red)]
        excluded += [(c, "Repeats a feature with more variance (abs r above 0.95)")
                     for c in red]
        var_map = {r["feature"]: r["variance"] for r in var.collect()}
        low = [c for c in num if c not in red and var_map.get(c) is not None
               and var_map[c] < var_threshold]
        excluded += [(c, "Almost constant (variance below 1e-6)") for c in low]
    drop = [c for c, _ in excluded]
    kept = [c for c in df.columns if c not in drop]
    rows = [(c, module, "Included",
             "Varies and does not repeat another feature")
            for c in kept if c != label]
    rows += [(c, module, "Excluded", why) for c, why in excluded]
    table = spark.createDataFrame(rows, "Feature string, Module string, Status string, "
                                        "Justification string")
    return df.select(*kept), table


def value_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """L06 helper: per column the largest single-value share (nulls are a value).

    All columns in one ``stack`` -> ``groupBy(column, value)`` -> ``groupBy(column)``."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) as (feature, value)")
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature").agg(
        (F.max("n") / F.sum("n")).alias("top_share"))


def near_constant_features(df: DataFrame, cols: Sequence[str], share: float = 0.99) -> DataFrame:
    """Columns where one value holds more than ``share`` of the rows."""
    return value_shares(df, cols).withColumn("near_constant", F.col("top_share") > share)


def mutual_information(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) between each equal-width-binned numeric
    column and the label.  Bins from one min/max pass; joint counts for every
    column in one stacked aggregate; the marginals come from the joint table
    (one row per (feature, bin, label)), never from the raw rows again."""
    mm = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    binned = []
    for i, c in enumerate(cols):
        lo, hi = mm[f"lo{i}"], mm[f"hi{i}"]
        if lo is None or hi is None or hi == lo:
            b = F.lit(0)
        else:
            b = F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1))
        binned.append((c, F.coalesce(b.cast("int"), F.lit(-1))))
    return information(df, binned, label)


def information(df: DataFrame, binned: Sequence[tuple[str, Column]], label: str) -> DataFrame:
    """(feature, mutual_information in nats) of binned columns (name, bin number) and the label."""
    pairs = ", ".join(f"'{c}', b{i}" for i, (c, _) in enumerate(binned))
    # a null label is a class of its own
    wide = df.select(F.when(F.col(label).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(label).cast("string")))
                     .alias("__y"),
                     *[e.alias(f"b{i}") for i, (_, e) in enumerate(binned)])
    long = wide.selectExpr("__y", f"stack({len(binned)}, {pairs}) as (feature, bin)")
    joint = long.groupBy("feature", "bin", "__y").agg(F.count(F.lit(1)).alias("nxy"))
    px = joint.groupBy("feature", "bin").agg(F.sum("nxy").alias("nx"))
    py = joint.groupBy("feature", "__y").agg(F.sum("nxy").alias("ny"))
    n = joint.groupBy("feature").agg(F.sum("nxy").alias("n"))
    j = joint.join(px, ["feature", "bin"]).join(py, ["feature", "__y"]).join(n, "feature")
    term = (F.col("nxy") / F.col("n")) * F.log((F.col("nxy") * F.col("n")) / (F.col("nx") * F.col("ny")))
    return j.groupBy("feature").agg(F.sum(term).alias("mutual_information"))
