"""Stored, mergeable sketches of columns.

A profile of a growing table is kept as one row for each part (day, file) and column:
a theta sketch of its values (distinct counts; unions and intersections) and, for
numbers, a KLL sketch (ranks and quantiles).  A new part adds its rows; any set of parts is
profiled by merging a few kilobytes, without reading the table again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nominal entries of a theta sketch as a power of two, and the relative deviation that gives (1 / sqrt(2 ** 12)).
THETA_BITS, THETA_DEVIATION = 12, 2.0 ** -6
#: Size of a KLL sketch and the error of a rank that it keeps with 99 % confidence.
KLL_SIZE, RANK_ERROR = 800, 0.0045


def column_sketches(df: DataFrame, part: Column, cols: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """part, column, n (rows), n_present, distinct (theta sketch) and ranks (KLL sketch; null for columns not in
    ``numeric``) of every part and column, in one pass with partial aggregation.  Null and NaN are not values."""
    wide = []
    for i, c in enumerate(cols):
        value = F.col(c)
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            value = F.nanvl(value, F.lit(None))
        text = F.xxhash64(value.cast("string"))  # one type of key for every type of column
        wide += [F.count(value).alias(f"p{i}"), F.theta_sketch_agg(F.when(value.isNotNull(), text), THETA_BITS).alias(f"d{i}")]
        wide.append((F.kll_sketch_agg_double(value.cast("double"), KLL_SIZE) if c in numeric else F.lit(None).cast("binary"))
                    .alias(f"k{i}"))
    rows = df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), *wide)
    stack = ", ".join(f"'{c}', p{i}, d{i}, k{i}" for i, c in enumerate(cols))
    return rows.selectExpr("part", "n", f"stack({len(cols)}, {stack}) as (column, n_present, distinct, ranks)")


def merged_distinct(sketches: DataFrame) -> DataFrame:
    """column, n, n_present and n_distinct (estimate) over all parts of ``sketches``."""
    return sketches.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum("n_present").alias("n_present"),
        F.theta_sketch_estimate(F.theta_union_agg("distinct", THETA_BITS)).alias("n_distinct"))


def common_values(sketches: DataFrame, one, other) -> DataFrame:
    """column, either, both: estimates of the distinct values of two parts together, and of those in both."""
    a = sketches.where(F.col("part") == F.lit(one)).select("column", F.col("distinct").alias("a"))
    b = sketches.where(F.col("part") == F.lit(other)).select("column", F.col("distinct").alias("b"))
    return a.join(b, "column").select(
        "column", F.theta_sketch_estimate(F.theta_union("a", "b", THETA_BITS)).alias("either"),
        F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("both"))


def distinct_above(df: DataFrame, sketches: DataFrame, threshold: float = 0.9, sigmas: float = 5.0) -> dict[str, bool]:
    """{column: whether distinct / rows is above ``threshold``}: by the estimate where ``sigmas`` deviations
    do not reach the threshold, else by an exact count of that column alone."""
    out = {}
    for r in merged_distinct(sketches).collect():  # one row a column
        ratio = r["n_distinct"] / max(r["n"], 1)
        if abs(ratio - threshold) <= sigmas * THETA_DEVIATION * ratio:
            ratio = df.agg(F.count_distinct(r["column"])).first()[0] / max(r["n"], 1)
        out[r["column"]] = ratio > threshold
    return out


def drift(sketches: DataFrame, period: Column, first, second, points: int = 400) -> DataFrame:
    """column, n_first, n_second, ks: the Kolmogorov-Smirnov distance of two periods of every numeric
    column, from their merged KLL sketches; it differs from the exact one by at most
    ``2 * RANK_ERROR + 2 / points``.  ``period`` names the period of a part."""
    merged = (sketches.where(F.col("ranks").isNotNull()).groupBy("column", period.alias("period"))
              .agg(F.kll_merge_agg_double("ranks", KLL_SIZE).alias("k")))
    pair = merged.groupBy("column").agg(F.max(F.when(F.col("period") == F.lit(first), F.col("k"))).alias("a"),
                                        F.max(F.when(F.col("period") == F.lit(second), F.col("k"))).alias("b"))
    grid = F.array(*[F.lit(i / points) for i in range(points + 1)])
    pair = (pair.where(F.col("a").isNotNull() & F.col("b").isNotNull())
            .withColumn("qa", F.kll_sketch_get_quantile_double("a", grid))
            .withColumn("qb", F.kll_sketch_get_quantile_double("b", grid)))
    # both distributions at the quantiles of either: the share of the grid that is not above
    apart = F.transform(F.array_distinct(F.concat("qa", "qb")), lambda v: F.abs(
        F.size(F.filter("qa", lambda q: q <= v)) - F.size(F.filter("qb", lambda q: q <= v))) / float(points + 1))
    return pair.select("column", F.kll_sketch_get_n_double("a").alias("n_first"),
                       F.kll_sketch_get_n_double("b").alias("n_second"), F.array_max(apart).alias("ks"))
