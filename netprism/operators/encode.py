"""Encoding, scaling, reduction and splitting.

Scalers are a one-row aggregate turned into literals (no join, no window);
label codes come from the small distinct-label table joined back with a
checked broadcast; splits cut the hash order of a class at one value
(``splits``) or rank rows inside their class without a per-class window
(``group_row_number``), so one dominant class is spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.safe import bounded_broadcast, null_safe_join
from .quantiles import exact_quantiles
from .splits import split_by_hash
from .windows import dense_row_id, group_row_number


# ----------------------------------------------------------------- E01 / E02 / E03

NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI]nf(inity)?|[nN]a[nN])$"


def numeric_strings(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """String columns whose every non-null value parses as a number become
    doubles (all or nothing per column, decided in one pass)."""
    cols = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    if not cols:
        return df, []
    # Spark's cast also takes '1d' and '2f'; those are words here.  The pattern comes first: a word that reaches
    # the cast costs an exception
    row = df.agg(*[F.count_if(F.col(c).isNotNull() & (~F.trim(F.col(c)).rlike(NUMBER)
                                                      | F.col(c).try_cast("double").isNull()))
                   .alias(f"b{i}") for i, c in enumerate(cols)]).first()
    ok = [c for i, c in enumerate(cols) if row[f"b{i}"] == 0]
    return df.withColumns({c: F.col(c).try_cast("double") for c in ok}), ok


def label_codes(df: DataFrame, label: str, broadcast_limit: int = 1_000_000) -> DataFrame:
    """Classes sorted ascending -> 0..k-1 (numeric labels sort numerically).

    The class table (one row per class) is small; its size is checked before it
    is broadcast.  The rank over it runs on that table only."""
    classes = df.select(label).where(F.col(label).isNotNull()).distinct()
    codes = classes.select(label, (F.dense_rank().over(Window.orderBy(label)) - 1).alias("code"))
    return df.join(bounded_broadcast(codes, broadcast_limit), label, "left")


def string_indexer(label: str, output: str = "label_idx"):
    """E02 as an ML stage (reusable on new data): alphabetical order like sklearn."""
    from pyspark.ml.feature import StringIndexer

    return StringIndexer(inputCol=label, outputCol=output, stringOrderType="alphabetAsc",
                         handleInvalid="keep")


def assemble(df: DataFrame, cols: Sequence[str], output: str = "features",
             handle_invalid: str = "keep") -> DataFrame:
    """Feature vector (doubles)."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(cols), outputCol=output,
                           handleInvalid=handle_invalid).transform(df)


# ----------------------------------------------------------------- E04 / E10 scalers

def standard_scale(df: DataFrame, cols: Sequence[str], with_mean: bool = True) -> tuple[DataFrame, dict]:
    """(x - mean) / population std; a constant column becomes 0 (scikit-learn)."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    stats = {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}
    return apply_standard_scale(df, stats, with_mean), stats


def apply_standard_scale(df: DataFrame, stats: dict, with_mean: bool = True) -> DataFrame:
    """E04 with fitted ``stats`` {column: (mean, population std)}."""
    exprs = {}
    for c, (m, s) in stats.items():
        centred = F.col(c) - F.lit(m if with_mean and m is not None else 0.0)
        exprs[c] = centred / F.lit(s) if s not in (None, 0.0) else centred * 0.0
    return df.withColumns(exprs)


def standard_scaler_stage(input_col: str, output_col: str):
    """E04 as an ML stage.  Spark's StandardScaler divides by the sample std
    (n-1); multiply by sqrt((n-1)/n) for the population value."""
    from pyspark.ml.feature import StandardScaler

    return StandardScaler(inputCol=input_col, outputCol=output_col, withMean=True, withStd=True)


def robust_scale(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict]:
    """(x - median) / IQR with exact quantiles (bounded memory)."""
    q = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    exprs = {}
    for c in cols:
        q1, med, q3 = q[c]
        iqr = (q3 - q1) if q1 is not None else None
        exprs[c] = (F.col(c) - F.lit(med)) / F.lit(iqr) if iqr else F.col(c) - F.lit(med)
    return df.withColumns(exprs), q


def min_max_scale(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict]:
    """(x - min) / (max - min); constant column -> 0."""
    row = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    stats = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}
    exprs = {}
    for c, (lo, hi) in stats.items():
        exprs[c] = ((F.col(c) - F.lit(lo)) / F.lit(hi - lo) if hi != lo
                    else (F.col(c) - F.lit(lo)) * 0.0)
    return df.withColumns(exprs), stats


# ----------------------------------------------------------------- E05 PCA

def pca_explained(df: DataFrame, cols: Sequence[str] | None = None, vector: str | None = None,
                  threshold: float = 0.95, standardize: bool = True):
    """PCA with as many components as needed for ``threshold`` of the variance.

    Spark's PCA normalises explained variance by the total variance even for
    k < d, so the model is fitted with k = d and cut at the first cumulative
    share above the threshold.  Returns (model, k, explained-variance frame)."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    spark = df.sparkSession
    if vector is None:
        df = VectorAssembler(inputCols=list(cols), outputCol="__x").transform(df)
        vector = "__x"
    if standardize:
        df = StandardScaler(inputCol=vector, outputCol="__xs", withMean=True,
                            withStd=True).fit(df).transform(df)
        vector = "__xs"
    d = len(df.select(vector).first()[0])
    model = PCA(k=d, inputCol=vector, outputCol="pca").fit(df)
    ev = list(model.explainedVariance.toArray())
    acc, k = 0.0, d
    cum = []
    for i, v in enumerate(ev):
        acc += v
        cum.append(acc)
        if acc > threshold and k == d:
            k = i + 1
    rows = [(f"PC{i + 1}", float(ev[i]), float(cum[i]), i < k) for i in range(d)]
    table = spark.createDataFrame(rows, "component string, explained_variance double, "
                                        "cumulative double, kept boolean")
    return model, k, table


# ----------------------------------------------------------------- E06 - E09 splits

def stratified_split(df: DataFrame, label: str, id_cols: Sequence[str], test_fraction: float = 0.2,
                     seed: int = 42, order: str = "hash") -> DataFrame:
    """Exact stratified split: in every class the first round(f * n_c) rows
    of a seeded hash order (or of the id order, ``order='id'``) are test rows.

    Repeatable (same seed -> same split), exact per class, and skew safe: the hash
    order needs one cut value per class (``splits``) and no sort; in id order the
    per-class rank comes from ``group_row_number`` and the class sizes from a
    small aggregate broadcast back."""
    if order == "hash":
        return split_by_hash(df, label, id_cols, [test_fraction], ["test", "train"], seed)
    ranked = group_row_number(df, [label], list(id_cols), name="__r")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    j = null_safe_join(ranked, bounded_broadcast(sizes), [label])
    test = F.col("__r") < F.round(F.col("__nc") * test_fraction)
    return j.withColumn("split", F.when(test, "test").otherwise("train")).drop("__r", "__nc")


def split_statistics(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Rows per (split, class) and the class share inside each split."""
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(split).agg(F.sum("n").alias("split_rows"))
    return counts.join(bounded_broadcast(totals), split).withColumn(
        "share", F.col("n") / F.col("split_rows"))


def temporal_split(df: DataFrame, order_by: Sequence[str], fractions=(0.7, 0.15, 0.15),
                   names=("train", "validation", "test")) -> DataFrame:
    """Split by position in time order: the first 70 % train, the next 15 %
    validation, the rest test (distributed dense positions, no global window)."""
    n = df.count()
    bounds, acc = [], 0.0
    for f in fractions[:-1]:
        acc += f
        bounds.append(math.floor(acc * n))
    pos = dense_row_id(df, order_by, name="__pos")
    expr = F.lit(names[-1])
    for b, name in reversed(list(zip(bounds, names))):
        expr = F.when(F.col("__pos") < b, name).otherwise(expr)
    return pos.withColumn("split", expr).drop("__pos")


def random_split_3(df: DataFrame, id_cols: Sequence[str], label: str, seed: int = 42,
                   fractions=(0.7, 0.15, 0.15)) -> DataFrame:
    """Stratified 70/15/15 by two hash cuts per class."""
    return split_by_hash(df, label, id_cols, [fractions[0], fractions[0] + fractions[1]],
                         ["train", "validation", "test"], seed)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class (one small aggregate)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return counts.select(label, "n_c", (F.sum("n_c").over(w) /
                                        (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))


def oversample_minority(df: DataFrame, label: str, minority, feature_cols: Sequence[str],
                        id_col: str, seed: int = 42) -> DataFrame:
    """E09 (SMOTE-like): one synthetic row per minority row, interpolated towards
    its neighbour along a seeded random projection.

    Neighbours come from the order of the projected value (dense positions,
    one range exchange), and the partner is joined on position + 1: no
    candidate pairs are enumerated, every minority row gets exactly one
    partner, and no group is collected in one task."""
    import random

    rnd = random.Random(seed)
    proj = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * rnd.uniform(-1, 1)
                for c in feature_cols), F.lit(0.0))
    mino = df.where(F.col(label) == F.lit(minority)).withColumn("__p", proj)
    pos = dense_row_id(mino, ["__p", id_col], name="__pos")
    n = pos.count()
    if n < 2:
        return df.limit(0)
    partner = pos.select((F.col("__pos") - 1).alias("__pos"),
                         *[F.col(c).alias(f"__n_{c}") for c in feature_cols])
    # the last row pairs with the first
    partner = partner.withColumn("__pos", F.when(F.col("__pos") < 0, F.lit(n - 1))
                                 .otherwise(F.col("__pos")))
    j = pos.join(partner, "__pos")
    gap = (F.abs(F.xxhash64(F.col("__pos"), F.lit(seed))) % 1_000_000) / 1e6
    synth = j.select(*[(F.col(c) + gap * (F.col(f"__n_{c}") - F.col(c))).alias(c)
                       if c in feature_cols else F.col(c) for c in df.columns])
    return synth.withColumn(id_col, F.lit(None).cast(df.schema[id_col].dataType))
