"""Minority oversampling with k nearest neighbours (E09, SMOTE).

Neighbours are searched in scaled features.  A table of the search orders the
minority rows along a random direction, by ranges over many tasks; a task cuts
consecutive rows into blocks of ``block`` and each block, by medians along further random
directions, into leaves of at most ``leaf`` rows.  Only rows of one leaf are
compared, by exact distances, so the candidates of a row are at most
``tables * leaf`` however the data are spread, and equal rows fall into many leaves.  The
best ``k`` of all tables so far travel with each row as distances and row numbers, from one table to
the next; only the features of the neighbour that is drawn are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove_path, scratch_path, written


def leaves(x: np.ndarray, rng: np.random.Generator, leaf: int) -> list[np.ndarray]:
    """Row numbers of ``x`` in parts of at most ``leaf``, halved at medians along random directions."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        order = np.argsort(x[rows] @ rng.normal(size=x.shape[1]), kind="stable")
        half = len(rows) // 2
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, squared distances) of the ``k`` nearest other rows of every row of ``x``, nearest first, of equal
    ones the first."""
    n, k = len(x), min(k, len(x) - 1)
    if k < 1:
        return np.empty((n, 0), np.int64), np.empty((n, 0))
    d = np.zeros((n, n))
    for c in np.ascontiguousarray(x.T):
        step = c[:, None] - c
        step *= step
        d += step
    np.fill_diagonal(d, np.inf)
    last = np.partition(d, k - 1, axis=1)[:, k - 1:k]
    low, tied = d < last, d == last
    # of the rows as far as the k-th, the first ones
    low |= tied & (tied.cumsum(axis=1, dtype=np.int32) <= k - low.sum(axis=1, keepdims=True))
    sound = low.sum(axis=1) == k
    order = np.empty((n, k), np.int64)
    order[sound] = np.nonzero(low[sound])[1].reshape(-1, k)
    own = np.take_along_axis(d[sound], order[sound], axis=1)
    order[sound] = np.take_along_axis(order[sound], np.argsort(own, axis=1, kind="stable"), axis=1)
    if not sound.all():  # NaN
        order[~sound] = np.argsort(d[~sound], axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, axis=1)


def _padded(lists, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, which of them are there) of an Arrow array of lists of at most ``k`` numbers."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    there = np.arange(k) < size[:, None]
    out = np.zeros(there.shape, lists.type.value_type.to_pandas_dtype())
    out[there] = lists.flatten().to_numpy()
    return out, there


def _nearer(far: np.ndarray, row: np.ndarray, there: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest different rows of every line of candidates, by distance and row: (distances, rows, which of
    them are there)."""
    by = np.lexsort((row, far, ~there), axis=1)
    far, row, there = (np.take_along_axis(a, by, axis=1) for a in (far, row, there))
    there[:, 1:] &= ~((row[:, 1:] == row[:, :-1]) & there[:, :-1])  # the same row from two tables
    by = np.argsort(~there, axis=1, kind="stable")[:, :k]
    return tuple(np.take_along_axis(a, by, axis=1) for a in (far, row, there))


def scaled_minority(df: DataFrame, label: str, minority, features: Sequence[str]) -> DataFrame:
    """The minority rows, written once, with ``__row`` (a number of its own), ``__x`` (their features, missing
    ones at the mean) and ``__z`` (scaled to mean 0, deviation 1; a constant one is 0); the last two are not written."""
    rows = df.where(F.col(label) == F.lit(minority))
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in features}
    # one row
    s = rows.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(value.values())],
                 *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(value.values())]).first()
    mean = [s[f"m{i}"] or 0.0 for i in range(len(features))]
    width = [s[f"s{i}"] or 0.0 for i in range(len(features))]
    x = [F.coalesce(v, F.lit(m)) for v, m in zip(value.values(), mean, strict=True)]
    z = [(v - F.lit(m)) / F.lit(w) if w else F.lit(0.0) for v, m, w in zip(x, mean, width, strict=True)]
    rows = written(rows.select("*", F.monotonically_increasing_id().alias("__row")), "minority")
    return rows.select("*", F.array(*x).alias("__x"), F.array(*z).alias("__z"))


def neighbours(rows: DataFrame, k: int = 5, tables: int = 8, leaf: int = 128, block: int = 32_768,
               seed: int = 42) -> DataFrame:
    """``__row`` and ``near``: its k nearest others (distance in scaled features, row), nearest first.

    The tables are searched one after another, and a row takes the best of the tables before with it: what a table
    shuffles and writes is gone before the next but one."""
    first = rows.select(F.size("__z").alias("n")).first()
    d = first["n"] if first else 1
    none = F.array()
    found, old = rows.select("__row", "__z", none.cast("array<double>").alias("d"), none.cast("array<long>").alias("row")), None
    for t in range(tables):
        way = np.random.default_rng([seed, t]).normal(size=d)
        along = F.lit(0.0)  # compiled, unlike the functions on arrays
        for i, x in enumerate(way.tolist()):
            along = along + F.get("__z", F.lit(i)) * F.lit(x)
        dealt = found.repartitionByRange(along, "__row").sortWithinPartitions(along, "__row")

        def run(batches, t=t):
            held, size = [], 0
            for b in batches:
                held.append(b)
                size += b.num_rows
                if size >= block:
                    yield compared(held, t)
                    held, size = [], 0
            if size:
                yield compared(held, t)

        def compared(held, t):
            import pyarrow as pa

            held = pa.Table.from_batches(held).combine_chunks()
            ids, scaled, far, row = (held.column(c).chunk(0) for c in ("__row", "__z", "d", "row"))
            numbers, z = ids.to_numpy(), scaled.flatten().to_numpy().reshape(len(ids), -1)
            far, there = _padded(far, k)
            row = _padded(row, k)[0]
            more = np.zeros((3, len(ids), k))
            more_far, more_row, more_there = more[0], more[1].astype(np.int64), more[2].astype(bool)
            for part in leaves(z, np.random.default_rng([seed, t, 1]), leaf):
                near, square = nearest(z[part], k)
                m = near.shape[1]
                more_far[part, :m], more_row[part, :m], more_there[part, :m] = np.sqrt(square), numbers[part[near]], True
            far, row, there = _nearer(np.hstack([far, more_far]), np.hstack([row, more_row]), np.hstack([there, more_there]), k)
            ends = pa.array(np.concatenate([[0], there.sum(axis=1).cumsum()]), pa.int32())
            return pa.RecordBatch.from_arrays(
                [ids, scaled, pa.ListArray.from_arrays(ends, pa.array(far[there])),
                 pa.ListArray.from_arrays(ends, pa.array(row[there]))], names=["__row", "__z", "d", "row"])

        path = scratch_path(rows.sparkSession, "neighbours")
        found = written(dealt.mapInArrow(run, "__row long, __z array<double>, d array<double>, row array<long>"), "neighbours", path)
        if old:
            remove_path(rows.sparkSession, old)
        old = path
    return found.select("__row", F.arrays_zip("d", "row").alias("near"))


def smote(df: DataFrame, label: str, minority, features: Sequence[str], id_col: str, k: int = 5, copies: int = 1,
          seed: int = 42, with_segment: bool = False, **search) -> DataFrame:
    """``copies`` synthetic rows for every minority row, on the segment to one of its k neighbours, drawn by a
    hash; other columns are the base row's, ``id_col`` is null.

    Fewer than two minority rows give none; missing features count as the mean; ``with_segment`` adds
    ``__x`` and ``__other`` (the ends of the segment) and ``__near`` (how many neighbours there were to draw from)."""
    rows = scaled_minority(df, label, minority, features)
    near = neighbours(rows, k, seed=seed, **search).where(F.size("near") > 0)
    j = rows.drop("__z").join(near.select("__row", F.col("near.row").alias("near")), "__row")
    j = j.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    draw = F.pmod(F.xxhash64("__row", "__copy", F.lit(seed)), F.size("near")).cast("int")
    gap = F.pmod(F.xxhash64("__row", "__copy", F.lit(seed + 1)), F.lit(1_000_000)) / 1e6
    j = j.withColumns({"__at": F.element_at("near", draw + 1), "__near": F.size("near"), "__gap": gap}).drop("near")
    j = j.join(rows.select(F.col("__row").alias("__at"), F.col("__x").alias("__other")), "__at")
    place = {c: i for i, c in enumerate(features)}
    made = [(F.col("__x")[place[c]] + F.col("__gap") * (F.col("__other")[place[c]] - F.col("__x")[place[c]])).alias(c) if c in place
            else F.lit(None).cast(df.schema[c].dataType).alias(c) if c == id_col else F.col(c) for c in df.columns]
    more = [F.col("__x"), F.col("__other"), F.col("__near")] if with_segment else []
    return j.select(*made, *more)
