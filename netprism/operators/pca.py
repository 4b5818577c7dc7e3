"""Principal components by tall-skinny QR.

Each task reduces its rows, behind a leading column of ones, to the d+1 x d+1
triangle R of a QR decomposition, one Arrow batch at a time; triangles are
stacked and reduced again, ``fan_in`` at a time, until one is left.  With the
ones in front, that triangle holds the row count, the means and the R of the
centred rows, so one pass over the data gives centring, scaling and axes, and
no covariance matrix (which squares the condition number) is ever formed.  The
last d x d step runs in a task; its result is one row per component.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

AXES = "component int, variance double, share double, cumulative double, kept boolean, axis array<double>"


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def _finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _vectors(df: DataFrame, cols: Sequence[str] | None, vector: str | None) -> Column:
    if vector is None:
        return F.array(*[F.col(c).cast("double") for c in cols])
    return F.col(vector).cast("array<double>")


def axes(df: DataFrame, cols: Sequence[str] | None = None, vector: str | None = None, threshold: float = 0.95,
         standardize: bool = True, fan_in: int = 16) -> DataFrame:
    """One row per component, by falling variance: component (from 1), variance, share and
    cumulative share of the whole variance, kept (the fewest components above ``threshold``), axis.

    Of ``cols`` (numeric) or of ``vector`` (an array column).  Rows with a null or non-finite
    value, and vectors of another length than the longest, take no part; fewer than two rows
    give no components.  ``standardize`` divides by the sample deviation; a constant column
    has weight 0.  The sign of an axis makes its largest entry positive."""
    ensure_checkpoint_dir(df.sparkSession)
    x = df.select(_vectors(df, cols, vector).alias("x")).where(F.col("x").isNotNull() & _finite(F.col("x")))
    d = len(cols) if vector is None else (x.agg(F.max(F.size("x"))).first()[0] or 0)
    if d == 0:
        return df.sparkSession.createDataFrame([], AXES)
    x = x.where(F.size("x") == d)

    def local(batches):
        import pyarrow as pa

        r = np.zeros((0, d + 1))
        for b in batches:
            rows = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            r = _triangle(np.vstack([r, np.hstack([np.ones((len(rows), 1)), rows])]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, d + 1))
        for raw in part["r"]:
            r = _triangle(np.vstack([r, np.frombuffer(raw).reshape(-1, d + 1)]))
        return pd.DataFrame({"r": [r.tobytes()]})

    # written before they are numbered: a lost executor must not deal the triangles out again
    parts = x.mapInArrow(local, "r binary").withColumn("p", F.spark_partition_id()).checkpoint(eager=True)
    n = parts.count()
    while n > 1:
        # triangle p of one round goes to p / fan_in: neighbours meet, no group is over fan_in
        parts = (parts.withColumn("p", F.floor(F.col("p") / fan_in)).groupBy("p")
                 .applyInPandas(lambda key, g: merge(g).assign(p=key[0]), "r binary, p long").checkpoint(eager=True))
        n = parts.count()

    def decompose(frames):
        for part in frames:
            for raw in part["r"]:
                yield _components(np.frombuffer(raw).reshape(-1, d + 1), threshold, standardize)

    return parts.select("r").mapInPandas(decompose, AXES).checkpoint(eager=True)


def _components(r: np.ndarray, threshold: float, standardize: bool) -> pd.DataFrame:
    names = ["component", "variance", "share", "cumulative", "kept", "axis"]
    n, centred = r[0, 0] ** 2, r[1:, 1:]
    if n < 1.5:
        return pd.DataFrame(columns=names)
    if standardize:
        deviation = np.sqrt((centred ** 2).sum(0) / (n - 1))
        # a constant column leaves rounding error only
        varies = deviation > 1e-12 * np.maximum(np.abs(r[0, 1:]) / np.sqrt(n), 1e-300)
        centred = np.where(varies, centred / np.where(varies, deviation, 1.0), 0.0)
    _, s, axis = np.linalg.svd(centred, full_matrices=len(centred) < r.shape[1] - 1)
    variance = np.zeros(len(axis))
    variance[:len(s)] = s ** 2 / (n - 1)
    largest = axis[np.arange(len(axis)), np.abs(axis).argmax(1)]
    axis = axis * np.where(largest < 0, -1.0, 1.0)[:, None]
    share = variance / variance.sum() if variance.sum() > 0 else variance
    cumulative = share.cumsum()
    kept = np.concatenate([[True], cumulative[:-1] <= threshold])
    return pd.DataFrame({"component": np.arange(1, len(axis) + 1), "variance": variance, "share": share,
                         "cumulative": cumulative, "kept": kept, "axis": list(axis)})[names]
