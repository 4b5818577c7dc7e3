"""Supervised cut points by minimum description length.

Candidate cuts of every column are quantiles of its values inside each class,
from one pass of sketches; a second pass counts (column, bin between
candidates, class).  On these small tables, one group per column of at most
candidates x classes rows, a range is cut where the classes' entropy falls most,
and only if the gain pays for the description of the cut; then both sides
likewise (Fayyad and Irani, 1993).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import nan_to_null
from .select import information

CUTS = "feature string, cut double, gain double, level int, accepted boolean"


def candidate_cuts(df: DataFrame, cols: Sequence[str], label: str, candidates: int = 256,
                   accuracy: int = 10_000) -> dict[str, list[float]]:
    """For every column at most ``candidates`` values plus one for each class, from sketches of the classes."""
    classes = max(df.select(F.count_distinct(label) + F.max(F.col(label).isNull().cast("int"))).first()[0] or 0, 1)
    points = [float(p) for p in np.linspace(0, 1, max(candidates // classes, 1) + 1)[:-1]]
    sketches = df.groupBy(label).agg(*[
        F.percentile_approx(nan_to_null(F.col(c).cast("double")), points, accuracy).alias(f"q{i}")
        for i, c in enumerate(cols)])
    merged = sketches.agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"q{i}")))).alias(f"q{i}")
                            for i in range(len(cols))]).first()
    return {c: [v for v in (merged[f"q{i}"] or []) if np.isfinite(v)] for i, c in enumerate(cols)}


def with_bins(df: DataFrame, cuts: dict[str, list[float]], prefix: str = "__b") -> DataFrame:
    """``df`` with a column ``prefix + i`` for the i-th column of ``cuts``: how many of its sorted cut
    points are at most the value (a binary search), -1 for null and NaN."""
    names = {c: f"{prefix}{i}" for i, c in enumerate(cuts)}
    plain = [c for c in cuts if not cuts[c]]
    cut = [c for c in cuts if cuts[c]]
    x = {c: nan_to_null(F.col(c).cast("double")) for c in cuts}
    df = df.withColumns({f"{names[c]}x": x[c] for c in cut} | {names[c]: F.when(x[c].isNull(), -1).otherwise(0)
                                                               for c in plain})
    if not cut:
        return df
    inf = float("inf")
    found = Bucketizer(splitsArray=[[-inf, *cuts[c], inf] for c in cut], inputCols=[f"{names[c]}x" for c in cut],
                       outputCols=[f"{names[c]}y" for c in cut], handleInvalid="keep").transform(df)
    bins = {names[c]: F.when(F.col(f"{names[c]}x").isNull(), -1).otherwise(F.col(f"{names[c]}y").cast("int")) for c in cut}
    return found.withColumns(bins).drop(*[f"{names[c]}{e}" for c in cut for e in "xy"])


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits of every row of class counts."""
    total = counts.sum(-1, keepdims=True)
    share = np.divide(counts, total, out=np.zeros(counts.shape), where=total > 0)
    return -(share * np.log2(share, out=np.zeros(counts.shape), where=share > 0)).sum(-1)


def best_cut(counts: np.ndarray) -> tuple[int, float, bool] | None:
    """(bins left of the cut, gain in bits, whether the gain pays for the cut) of a bins x classes table."""
    n, left = counts.sum(), counts.cumsum(0)[:-1]
    right = counts.sum(0) - left
    inside = (left.sum(1) > 0) & (right.sum(1) > 0)
    if not inside.any():
        return None
    whole, low, high = _entropy(counts.sum(0)), _entropy(left), _entropy(right)
    gain = np.where(inside, whole - (left.sum(1) * low + right.sum(1) * high) / n, -1.0)
    at = int(gain.argmax())
    k, k_low, k_high = (int((c > 0).sum()) for c in (counts.sum(0), left[at], right[at]))
    delta = np.log2(3.0 ** k - 2) - (k * whole - k_low * low[at] - k_high * high[at])
    return at + 1, float(gain[at]), bool(gain[at] > (np.log2(n - 1) + delta) / n)


def mdl_cuts(df: DataFrame, cols: Sequence[str], label: str, candidates: int = 256) -> DataFrame:
    """(feature, cut, gain, level, accepted): the cuts of every numeric column, rows below and from
    ``cut`` on being parted.  The best first cut (level 0) is there even if it is not accepted; further
    cuts only if they are.  Null and NaN values take no part; a null label is a class."""
    cuts = candidate_cuts(df, cols, label, candidates)
    y = F.when(F.col(label).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(label).cast("string")))
    wide = with_bins(df.select(*cols, y.alias("y")), cuts)
    pairs = ", ".join(f"'{c}', __b{i}" for i, c in enumerate(cols))
    joint = (wide.selectExpr("y", f"stack({len(cols)}, {pairs}) as (feature, bin)").where("bin >= 0")
             .groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n")))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        feature = group["feature"].iloc[0]
        table = group.pivot_table(index="bin", columns="y", values="n", fill_value=0, aggfunc="sum").sort_index()
        counts, bins, found = table.to_numpy(dtype=float), table.index.to_numpy(), []
        open_ranges = [(0, len(bins), 0)]
        while open_ranges:
            a, b, level = open_ranges.pop()
            cut = best_cut(counts[a:b]) if b - a > 1 else None
            if cut is not None and (cut[2] or level == 0):
                at = a + cut[0]
                found.append((feature, cuts[feature][bins[at] - 1], cut[1], level, cut[2]))
                if cut[2]:
                    open_ranges += [(a, at, level + 1), (at, b, level + 1)]
        return pd.DataFrame(found, columns=["feature", "cut", "gain", "level", "accepted"])

    return joint.groupBy("feature").applyInPandas(grow, CUTS)


def mdl_information(df: DataFrame, cols: Sequence[str], label: str, candidates: int = 256) -> DataFrame:
    """(feature, n_bins, mutual_information in nats) of the columns cut at their accepted cut points."""
    found: dict[str, list[float]] = {c: [] for c in cols}
    # at most ``candidates`` and one for each class, of every column of the schema
    for r in mdl_cuts(df, cols, label, candidates).where("accepted").collect():
        found[r["feature"]].append(r["cut"])
    cuts = {c: sorted(v) for c, v in found.items()}
    n_bins = F.create_map(*[F.lit(x) for c in cols for x in (c, len(cuts[c]) + 1)])
    binned = with_bins(df.select(*cols, label), cuts)
    got = information(binned, [(c, F.col(f"__b{i}")) for i, c in enumerate(cols)], label)
    return got.select("feature", n_bins[F.col("feature")].alias("n_bins"), "mutual_information")
