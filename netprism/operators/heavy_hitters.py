"""Most frequent n-grams without a shuffle of all n-grams.

A first pass keeps, in every task, a summary of fixed size over 64-bit hashes
of the n-grams: when it is over ``capacity``, the largest count beyond the
capacity is taken off all counts, and adds to the summary's error (Misra-Gries
in batches).  Summaries merge by addition.  An n-gram then occurs between its
count and its count plus the sum E of all errors, so only those that can reach
the k-th count are counted again, by their text.  Where the bounds cannot
prove the result (E is not below the k-th count), all n-grams are counted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import bounded_broadcast
from ..session import ensure_checkpoint_dir
from .content import ngram_counts, tokens


def merge_counts(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Equal keys added up, at most ``capacity`` of them, and what was taken off every count."""
    keys, place = np.unique(keys, return_inverse=True)
    counts = np.bincount(place, weights=counts, minlength=len(keys)).astype(np.int64)
    if len(keys) <= capacity:
        return keys, counts, 0
    cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > cut
    return keys[left], counts[left] - cut, cut


def summaries(hashes: DataFrame, capacity: int) -> DataFrame:
    """(h, n, error) of every task for ``hashes(h array<long>)``: counts, and one row without h for its error."""
    def count(batches):
        import pyarrow as pa

        keys, counts, error = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for b in batches:
            new, n = np.unique(b.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            keys, counts, off = merge_counts(np.concatenate([keys, new]), np.concatenate([counts, n]), capacity)
            error += off
        yield pa.RecordBatch.from_arrays(
            [pa.array([*keys.tolist(), None], pa.int64()), pa.array([*counts.tolist(), 0], pa.int64()),
             pa.array([0] * len(keys) + [error], pa.int64())], names=["h", "n", "error"])

    return hashes.mapInArrow(count, "h long, n long, error long")


def top_ngrams(df: DataFrame, text: str, n: int = 2, k: int = 100, capacity: int = 65_536) -> DataFrame:
    """The ``k`` most frequent n-grams (ngram, n), ties by the n-gram text; exact.

    Null texts and texts of fewer words have no n-gram."""
    ensure_checkpoint_dir(df.sparkSession)
    words = df.select(tokens(F.col(text)).alias("w")).where(F.size("w") >= n)
    m = F.size("w") - n + 1
    parts = [F.slice(F.transform("w", lambda x: F.xxhash64(x)), i + 1, m) for i in range(n)]
    hashed = parts[0]
    for p in parts[1:]:
        hashed = F.zip_with(hashed, p, lambda a, b: F.xxhash64(a, b))
    seen = summaries(words.select(hashed.alias("h")), capacity).groupBy("h").agg(
        F.sum("n").alias("n"), F.sum("error").alias("error")).checkpoint(eager=True)
    error = seen.where(F.col("h").isNull()).agg(F.sum("error")).first()[0] or 0
    counts = seen.where(F.col("h").isNotNull())
    top = [r["n"] for r in counts.select("n").orderBy(F.desc("n")).limit(k).collect()]
    least = top[-1] if len(top) == k else 0
    if error and error >= least:
        return ngram_counts(df, text, n, k)
    wanted = bounded_broadcast(counts.where(F.col("n") >= least - error).select("h"))
    grams = words.select("w", F.posexplode(hashed).alias("at", "h")).join(wanted, "h", "left_semi")
    whole = F.array_join(F.slice("w", F.col("at") + 1, n), " ")
    exact = grams.groupBy(whole.alias("ngram")).agg(F.count(F.lit(1)).alias("n"))
    best = exact.orderBy(F.desc("n"), F.asc("ngram")).limit(k).checkpoint(eager=True)
    # texts that share a hash count as one in the summary: then the k-th text may lie below ``least``
    if least and best.agg(F.min("n")).first()[0] < least:
        return ngram_counts(df, text, n, k)
    return best
