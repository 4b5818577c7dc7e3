"""Profiling.

Design rule: one aggregate pass for all columns (the reference scans once per
column and statistic).  Per-column statistics come back as one wide row and
are turned into long form with ``stack`` so that filters / orders run in
Spark.  Very wide tables are chunked (``CHUNK`` columns per aggregate) to stay
inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import categorical_columns, detect_label, numeric_columns
from ..functions.safe import is_missing

CHUNK = 48


def shape(df: DataFrame) -> DataFrame:
    """Rows and columns as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)))


def _missing_expr(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.count_if(is_missing(c))
    return F.count_if(F.col(c).isNull())


def missing_counts(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Long table (column, missing_count, missing_pct) for every column.

    One aggregate per ``chunk`` columns (a single pass for up to ``chunk``
    columns; very wide aggregates fall out of generated code); each one-row
    result is turned into one row per column with ``stack``."""
    cols = df.columns
    parts = []
    for s in range(0, len(cols), chunk):
        part = cols[s:s + chunk]
        wide = df.agg(F.count(F.lit(1)).alias("__n"),
                      *[_missing_expr(df, c).alias(f"m{i}") for i, c in enumerate(part)])
        pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', m{i}" for i, c in enumerate(part))
        parts.append(wide.selectExpr("__n", f"stack({len(part)}, {pairs}) as (column, missing_count)"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.select(
        "column", "missing_count",
        (F.col("missing_count") * 100.0 / F.col("__n")).alias("missing_pct"))


def missing_report(df: DataFrame, top: int = 10) -> DataFrame:
    """Columns with missing > 0, count desc (column name breaks ties), top n."""
    return (missing_counts(df).where(F.col("missing_count") > 0)
            .orderBy(F.desc("missing_count"), F.asc("column")).limit(top))


def missing_totals(df: DataFrame) -> DataFrame:
    """Total missing cells and number of columns with a missing value."""
    return missing_counts(df).agg(
        F.sum("missing_count").alias("total_missing"),
        F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"))


def duplicate_stats(df: DataFrame) -> DataFrame:
    """Duplicate rows (first copy kept) and their share.

    ``groupBy(all columns).count()`` aggregates map-side first, so a row that
    repeats a billion times is one partial row per task, not a hot partition.
    """
    groups = df.groupBy(*df.columns).count()
    return groups.agg(F.sum("count").alias("n_rows"),
                      F.sum(F.col("count") - 1).alias("duplicate_rows")).select(
        "duplicate_rows",
        (F.col("duplicate_rows") * 100.0 / F.col("n_rows")).alias("duplicate_pct"))


def dtype_counts(df: DataFrame) -> DataFrame:
    """Number of columns per data type (schema only, no job on the data)."""
    counts: dict[str, int] = {}
    for _, t in df.dtypes:
        counts[t] = counts.get(t, 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()),
                                           "dtype string, n_columns long")


def preview(df: DataFrame, order_by: Sequence[str], k: int = 3, c: int = 5) -> DataFrame:
    """First k rows by an explicit order, first c columns (top-k, not a sort)."""
    cols = df.columns[:c]
    return df.orderBy(*order_by).select(*cols).limit(k)


def label_distribution(df: DataFrame, label: str | None = None, top: int | None = None) -> DataFrame:
    """Label, count; count desc then label."""
    label = label or detect_label(df.columns)
    out = df.groupBy(label).count().orderBy(F.desc("count"), F.asc(label))
    return out.limit(top) if top else out


def label_mapping(df: DataFrame, label: str) -> DataFrame:
    """Label, code (alphabetical, from 0), count, percentage.

    The per-label counts are tiny (one row per class), so the window over them
    is a single small partition after the aggregate.
    """
    counts = df.groupBy(label).count()
    w_all = Window.partitionBy()
    return counts.select(
        F.col(label).alias("label"),
        (F.dense_rank().over(Window.orderBy(label)) - 1).alias("code"),
        F.col("count"),
        (F.col("count") * 100.0 / F.sum("count").over(w_all)).alias("pct"))


#: Columns of one exact distinct pass.
DISTINCT_CHUNK = 6


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None,
                    approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """P10: distinct values per column (nulls not counted), long form.

    Exact counts copy every row once for each column, so a pass counts only
    ``DISTINCT_CHUNK`` columns; the passes run side by side in one plan.
    ``approx=True`` uses HyperLogLog++ (bounded memory, one pass) for scale.
    """
    cols = list(cols or df.columns)
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    chunk = len(cols) if approx else DISTINCT_CHUNK
    out = None
    for at in range(0, len(cols), chunk):
        own = cols[at:at + chunk]
        wide = df.agg(*[fn(F.col(c)).alias(f"d{i}") for i, c in enumerate(own)])
        pairs = ", ".join(f"'{c}', d{i}" for i, c in enumerate(own))
        part = wide.selectExpr(f"stack({len(own)}, {pairs}) as (column, n_distinct)")
        out = part if out is None else out.unionByName(part)
    return out


def final_structure(df: DataFrame, label: str = "Label") -> DataFrame:
    """Rows, columns, numeric / categorical feature counts and the label
    distribution, flattened to one row per label (the map is ``label -> count``)."""
    num = len(numeric_columns(df, exclude=[label]))
    cat = len(categorical_columns(df, exclude=[label]))
    consts = [F.lit(len(df.columns)).alias("columns"), F.lit(num).alias("numeric_features"),
              F.lit(cat).alias("categorical_features")]
    if label not in df.columns:
        return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", *consts)
    # one row per class; the total is a window over that small aggregate
    counts = df.groupBy(label).count()
    return counts.select(F.sum("count").over(Window.partitionBy()).alias("rows"), *consts,
                         F.col(label).cast("string").alias("label"),
                         F.col("count").alias("label_count"))


def label_map(df: DataFrame, label: str) -> DataFrame:
    """P11 variant: one row with ``label_distribution`` as map<string, long>."""
    counts = df.groupBy(label).count()
    return counts.agg(F.map_from_entries(F.collect_list(
        F.struct(F.col(label).cast("string"), F.col("count")))).alias("label_distribution"))


def quality_gates(df: DataFrame, label: str, max_missing_pct: float = 5.0,
                  max_duplicate_pct: float = 1.0, min_class_pct: float = 1.0) -> DataFrame:
    """(check, subject, value, passed) rows."""
    miss = missing_counts(df).select(
        F.lit("missing_pct").alias("check"), F.col("column").alias("subject"),
        F.col("missing_pct").alias("value"),
        (F.col("missing_pct") < max_missing_pct).alias("passed"))
    dup = duplicate_stats(df).select(
        F.lit("duplicate_pct").alias("check"), F.lit("all").alias("subject"),
        F.col("duplicate_pct").alias("value"),
        (F.col("duplicate_pct") < max_duplicate_pct).alias("passed"))
    cls = label_mapping(df, label).select(
        F.lit("class_pct").alias("check"), F.col("label").cast("string").alias("subject"),
        F.col("pct").alias("value"), (F.col("pct") >= min_class_pct).alias("passed"))
    return miss.unionByName(dup).unionByName(cls)


def before_after_counts(frames: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows and columns of each data set before and after cleaning."""
    out = None
    for name, (before, after) in sorted(frames.items()):
        one = before.agg(F.count(F.lit(1)).alias("rows_before")).crossJoin(  # two single rows
            after.agg(F.count(F.lit(1)).alias("rows_after"))).select(
            F.lit(name).alias("dataset"), "rows_before", "rows_after",
            F.lit(len(before.columns)).alias("columns_before"), F.lit(len(after.columns)).alias("columns_after"))
        out = one if out is None else out.unionByName(one)
    return out


def dataset_report(counts: DataFrame) -> DataFrame:
    """One row over all data sets: sets, rows, removed rows, retention and
    the set that lost the largest share."""
    lost = 1 - F.col("rows_after") / F.col("rows_before")
    return counts.agg(
        F.count(F.lit(1)).alias("datasets"), F.sum("rows_before").alias("rows_before"), F.sum("rows_after").alias("rows_after"),
        (F.sum("rows_before") - F.sum("rows_after")).alias("rows_removed"),
        (F.sum("columns_before") - F.sum("columns_after")).alias("columns_removed"),
        (F.sum("rows_after") * 100.0 / F.sum("rows_before")).alias("retention_pct"),
        F.max_by("dataset", F.struct(lost, "dataset")).alias("largest_loss"))


def retention(before: DataFrame, after: DataFrame, key: str = "dataset") -> DataFrame:
    """Rows before and after per dataset, retention %, plus a total
    row (``dataset`` = 'TOTAL') computed with ``rollup``."""
    b = before.groupBy(key).agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.groupBy(key).agg(F.count(F.lit(1)).alias("rows_after"))
    j = b.join(a, key, "full")
    rolled = j.rollup(key).agg(F.sum("rows_before").alias("rows_before"),
                               F.sum("rows_after").alias("rows_after"))
    return rolled.select(
        F.coalesce(F.col(key), F.lit("TOTAL")).alias(key), "rows_before", "rows_after",
        (F.col("rows_after") * 100.0 / F.col("rows_before")).alias("retention_pct"))
