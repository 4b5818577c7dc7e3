"""File-content features (B01-B04) over text or bytes columns.

Everything except the character histogram is a JVM expression (regular
expressions, array functions, ``Bucketizer``-style ``when`` chains).  The
histogram is a vectorised pandas UDF: one small per-row NumPy helper fed by
Arrow batches; Spark partitions and schedules the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# String classes and size categories.
PRINTABLE_RUN = r"[\x20-\x7e]{4,}"
NON_PRINTABLE = r"[^\x20-\x7e\t\n\r]"
URL_RE = r"https?://[^\s\"<>]+"
IPV4_RE = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
SUSPICIOUS_RE = r"(?i)(cmd\.exe|powershell|/bin/sh|wget |curl |eval\(|base64|password)"
SIZE_BUCKETS = ((1_000, "tiny"), (10_000, "small"), (100_000, "medium"), (None, "large"))


def _entropy(texts: pd.Series) -> pd.Series:
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        if t is None or len(t) == 0:
            out[i] = np.nan
            continue
        cps = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
        _, counts = np.unique(cps, return_counts=True)
        p = counts / counts.sum()
        out[i] = float(-(p * np.log2(p)).sum())
    return pd.Series(out)


_UDF = {}


def char_entropy(c: Column) -> Column:
    """Shannon entropy of the characters of each string (vectorised pandas UDF)."""
    if "entropy" not in _UDF:
        _UDF["entropy"] = F.pandas_udf(_entropy, "double")
    return _UDF["entropy"](c)


def byte_profile(text: Column) -> dict[str, Column]:
    """Character entropy (bits), null share, printable share (percent)."""
    n = F.length(text)
    return {
        "entropy": char_entropy(text),
        "null_pct": F.try_divide((n - F.length(F.replace(text, F.lit("\x00"), F.lit("")))) * 100.0, n),
        "printable_pct": F.try_divide(F.length(F.regexp_replace(text, NON_PRINTABLE, "")) * 100.0, n),
    }


def string_profile(text: Column) -> dict[str, Column]:
    """Printable runs (count, mean length), URL / IP / suspicious string counts."""
    runs = F.regexp_extract_all(text, F.lit(PRINTABLE_RUN), 0)
    lens = F.transform(runs, lambda s: F.length(s))
    total = F.aggregate(lens, F.lit(0).cast("long"), lambda a, b: a + b)
    return {
        "n_strings": F.size(runs),
        "mean_string_length": F.try_divide(total.cast("double"), F.size(runs).cast("double")),
        "n_urls": F.regexp_count(text, F.lit(URL_RE)),
        "n_ips": F.regexp_count(text, F.lit(IPV4_RE)),
        "n_suspicious": F.regexp_count(text, F.lit(SUSPICIOUS_RE)),
    }


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _token_grams(texts, n: int, hashed: bool = True):
    """(tokens; starts, counts and, if asked for, hashes of the distinct n-grams) of an Arrow array of
    texts.  Token n-grams that share a hash are told apart by their tokens."""
    import pyarrow as pa
    import pyarrow.compute as pc

    # the same white space as ``tokens``: ASCII only
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words, text = pc.list_flatten(split), pc.list_parent_indices(split)
    there = pc.not_equal(words, "")
    coded = words.filter(there).dictionary_encode()
    text = text.filter(there).to_numpy(zero_copy_only=False)
    start = np.flatnonzero(text[:-(n - 1) or None] == text[n - 1:]) if len(text) >= n else np.zeros(0, np.int64)
    code, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    key, most = code[start], known
    for k in range(1, n):
        if most * known >= 2 ** 62:  # numbered anew
            numbers, key = np.unique(key, return_inverse=True)
            most = len(numbers)
        key, most = key * known + code[start + k], most * known
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    start = start[first]
    if not hashed:
        return coded, start, counts, None
    one = pd.util.hash_array(np.array(coded.dictionary.cast(pa.large_binary()).to_pylist(), dtype=object), categorize=False) if known else np.zeros(0, np.uint64)
    h = np.zeros(len(start), np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[code[start + k]]
    return coded, start, counts, (h ^ (h >> np.uint64(31))).view(np.int64)


def _gram_texts(coded, start, n: int):
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = [coded.dictionary.take(coded.indices.take(pa.array(start + k))) for k in range(n)]
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string())


def _text_pieces(batches, most: int = 16_000_000):
    """Arrays of the batches' texts with about ``most`` bytes each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for b in batches:
        texts = b.column(0)
        length = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            upto = int(np.searchsorted(length, (length[at - 1] if at else 0) + most - size, side="right"))
            upto = min(max(upto, at + 1), len(texts))
            held.append(texts.slice(at, upto - at))
            size += int(length[upto - 1] - (length[at - 1] if at else 0))
            at = upto
            if size >= most or at < len(texts):
                yield pa.concat_arrays(held)
                held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def ngram_counts(df: DataFrame, text: str, n: int = 2, top: int | None = 100) -> DataFrame:
    """Frequencies of token n-grams over the whole corpus.

    n-grams are counted in pieces of many texts by numbers of their tokens, so text is made
    only for the distinct ones of a piece; the pieces' counts are added up on Spark.  ``top``
    keeps the k most frequent (ties by the n-gram text): 64-bit hashes are counted first, and
    then the texts of the hashes that reach the k-th count, an upper bound of what any of their
    n-grams reach.  Where that does not prove the result, or too many tie, all texts are counted."""
    texts = df.select(F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    if top:
        found = _top_by_hash(texts, n, top)
        return _counted(texts, n).orderBy(F.desc("n"), F.asc("ngram")).limit(top) if found is None else found
    return _counted(texts, n)


def _counted(texts: DataFrame, n: int, wanted: np.ndarray | None = None) -> DataFrame:
    """(ngram, n) of all n-grams, or of those whose hash is one of ``wanted``."""
    def run(batches):
        import pyarrow as pa

        for piece in _text_pieces(batches):
            coded, start, counts, h = _token_grams(piece, n, wanted is not None)
            if wanted is not None:
                some = np.isin(h, wanted)
                start, counts = start[some], counts[some]
            for i in range(0, len(start), 100_000):
                yield pa.RecordBatch.from_arrays([_gram_texts(coded, start[i:i + 100_000], n), pa.array(counts[i:i + 100_000], pa.int64())],
                                                 names=["ngram", "n"])

    return texts.mapInArrow(run, "ngram string, n long").groupBy("ngram").agg(F.sum("n").alias("n"))


def _top_by_hash(texts: DataFrame, n: int, k: int, most: int = 2_000) -> DataFrame | None:
    """The ``k`` most frequent n-grams, or None if the hashes do not prove them."""
    def run(batches):
        import pyarrow as pa

        for piece in _text_pieces(batches):
            _, _, counts, h = _token_grams(piece, n)
            for i in range(0, len(h), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i:i + 500_000]), pa.array(counts[i:i + 500_000], pa.int64())],
                                                 names=["h", "n"])

    ensure_checkpoint_dir(texts.sparkSession)
    sums = texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # one pass for the k-th count and all that tie with it, ``most`` + 1 of them at the most
    best = sums.orderBy(F.desc("n")).limit(max(most, k) + 1).toArrow()
    count = best["n"].to_numpy()
    least = int(count[k - 1]) if len(count) >= k else 0
    if len(count) > max(most, k) and count[-1] >= least:
        return None
    found = _counted(texts, n, best["h"].to_numpy()[count >= least]).orderBy(F.desc("n"), F.asc("ngram")).limit(k).checkpoint(eager=True)
    # n-grams that share a hash count as one above: then the k-th may lie below what was left out
    if least and found.agg(F.min("n")).first()[0] < least:
        return None
    return found


def ngram_stage(n: int = 2):
    """B03 as ML stages (tokens -> NGram -> CountVectorizer) for model input."""
    from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer

    return [RegexTokenizer(inputCol="text", outputCol="__tok", pattern=r"\s+"),
            NGram(n=n, inputCol="__tok", outputCol="__ngrams"),
            CountVectorizer(inputCol="__ngrams", outputCol="ngram_counts")]


def size_category(size: Column) -> Column:
    """B04."""
    expr = None
    for cut, name in SIZE_BUCKETS:
        if cut is None:
            expr = expr.otherwise(name)
        else:
            expr = F.when(size < cut, name) if expr is None else expr.when(size < cut, name)
    return expr


def size_normalised(df: DataFrame, size: str) -> Column:
    """Min-max normalised size (one aggregate for the bounds)."""
    r = df.agg(F.min(size).alias("lo"), F.max(size).alias("hi")).first()
    if r["hi"] == r["lo"]:
        return F.lit(0.0)
    return (F.col(size) - F.lit(r["lo"])) / F.lit(float(r["hi"] - r["lo"]))
