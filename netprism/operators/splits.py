"""Exact stratified splits by a hash cut.

The first ``round(f * n_c)`` rows of class c in a seeded hash order are those
whose hash is at most the rank's hash value, so a split needs that one value
per class, not the rows in order.  It is found by histograms: counts per
(class, leading bits of the hash), of which only the bin that holds the rank
is counted again with more bits.  Every pass reads the label and the id
columns and sums up in the map side; what is exchanged is at most 4096 bins
per class and task, however large a class is.  The split itself is a filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import bounded_broadcast, null_safe_join
from ..session import ensure_checkpoint_dir
from .windows import group_row_number

#: Bits of the hash left out in each pass: 4096 bins, then 4096 in each bin that holds a cut.
SHIFTS = (52, 40, 28, 16, 4, 0)
#: Rows in the bins of all cuts below which single hash values are counted.
EXACT_ROWS = 100_000


def seeded_hash(id_cols: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*[F.col(c) for c in id_cols], F.lit(seed))


def _cut_bins(counts: DataFrame, cuts: DataFrame) -> DataFrame:
    """(class, k, bin, n, need): the bin of each cut, and the rank inside it.
    ``counts(__y, [__parent,] __b, n)`` has the bins, ``cuts`` the ranks so far."""
    parent = ["__y", "__parent"] if "__parent" in counts.columns else ["__y"]
    before = F.sum("n").over(Window.partitionBy(*parent).orderBy("__b")) - F.col("n")
    bins = counts.withColumn("__before", before)
    left = cuts.withColumnRenamed("__b", "__parent") if "__parent" in counts.columns else cuts
    j = null_safe_join(bins, left.select(*parent, "__k", "__need"), parent)
    inside = (F.col("__before") < F.col("__need")) & (F.col("__need") <= F.col("__before") + F.col("n"))
    return j.where(inside).select("__y", "__k", "__b", "n", (F.col("__need") - F.col("__before")).alias("__need"))


def hash_cuts(df: DataFrame, label: str, key: Column, fractions: Sequence[float],
              exact_rows: int = EXACT_ROWS) -> DataFrame:
    """(__y, __k, __b, n, __need) for every class and cumulative fraction k: the hash
    value of the rank ``round(f_k * n_c)``, how many rows have that very hash, and how
    many of these lie below the cut.  A rank of 0 has no row."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(F.col(label).alias("__y"), key.alias("__h"))
    bins = rows.groupBy("__y", F.shiftright("__h", SHIFTS[0]).alias("__b")).agg(F.count(F.lit(1)).alias("n"))
    bins = bins.checkpoint(eager=True)
    ranks = F.array(*[F.struct(F.lit(k).alias("__k"), F.lit(float(f)).alias("f")) for k, f in enumerate(fractions)])
    sizes = bins.groupBy("__y").agg(F.sum("n").alias("__nc")).select("__y", "__nc", F.inline(ranks))
    cuts = sizes.select("__y", "__k", F.round(F.col("__nc") * F.col("f")).cast("long").alias("__need"))
    cuts = _cut_bins(bins, cuts).checkpoint(eager=True)
    at = 0
    while SHIFTS[at] > 0:
        shift = SHIFTS[at]
        held = cuts.select("__y", "__b", "n").distinct().agg(F.sum("n")).first()[0] or 0
        at = len(SHIFTS) - 1 if held <= exact_rows else at + 1
        wanted = bounded_broadcast(cuts.select("__y", F.col("__b").alias("__parent")).distinct())
        inside = null_safe_join(rows.withColumn("__parent", F.shiftright("__h", shift)), wanted, ["__y", "__parent"])
        counts = inside.groupBy("__y", "__parent", F.shiftright("__h", SHIFTS[at]).alias("__b")).agg(
            F.count(F.lit(1)).alias("n"))
        cuts = _cut_bins(counts, cuts).checkpoint(eager=True)
    return cuts


def split_by_hash(df: DataFrame, label: str, id_cols: Sequence[str], fractions: Sequence[float],
                  names: Sequence[str], seed: int = 42, name: str = "split") -> DataFrame:
    """``df`` with its part: class by class, rows up to the cumulative share ``fractions[k]``
    of a seeded hash order belong to ``names[k]``, the rest to ``names[-1]``.

    Exact per class.  Rows that share the hash of a cut (repeated ids) and lie on both of
    its sides are ordered by the ids and then all columns; only those rows are ranked.  A
    null class is a class; an empty table stays empty."""
    key = seeded_hash(id_cols, seed)
    cuts = hash_cuts(df, label, key, fractions)
    ks = range(len(fractions))
    wide = cuts.groupBy("__y").agg(
        *[F.max(F.when(F.col("__k") == k, F.col("__b"))).alias(f"__c{k}") for k in ks],
        *[F.max(F.when((F.col("__k") == k) & (F.col("__need") < F.col("n")), F.col("__need"))).alias(f"__t{k}")
          for k in ks])
    wide = wide.withColumnRenamed("__y", label).checkpoint(eager=True)
    side = bounded_broadcast(wide)
    j = null_safe_join(df.withColumn("__h", key), side, [label], "left")

    def part(inside):
        out = F.lit(names[-1])
        for k in reversed(ks):
            out = F.when(inside(k), names[k]).otherwise(out)
        return out

    def below(k):
        return F.coalesce(F.col("__h") <= F.col(f"__c{k}"), F.lit(False))

    split_tie = F.lit(False)
    for k in ks:
        split_tie = split_tie | F.coalesce((F.col("__h") == F.col(f"__c{k}")) & F.col(f"__t{k}").isNotNull(), F.lit(False))
    tied = wide.where(F.coalesce(*[F.col(f"__t{k}") for k in ks]).isNotNull()).limit(1).count() > 0
    if not tied:
        return j.withColumn(name, part(below)).select(*df.columns, name)
    clear = j.where(~split_tie).withColumn(name, part(below))
    rest = group_row_number(j.where(split_tie), [label, "__h"], list(id_cols), name="__r")
    ranked = rest.withColumn(name, part(lambda k: F.when(
        (F.col("__h") == F.col(f"__c{k}")) & F.col(f"__t{k}").isNotNull(), F.col("__r") < F.col(f"__t{k}"))
        .otherwise(below(k))))
    return clear.select(*df.columns, name).unionByName(ranked.select(*df.columns, name))
