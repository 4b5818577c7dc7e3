"""Minimum-description-length cut points and most frequent n-grams against plain versions."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netprism.operators import discretize, heavy_hitters


def entropy(labels):
    return -sum(n / len(labels) * math.log2(n / len(labels)) for n in Counter(labels).values())


def brute_cuts(pairs):
    """Accepted cuts of (value, label) pairs, all values being candidates."""
    best = None
    for cut in sorted({x for x, _ in pairs})[1:]:
        low, high = [y for x, y in pairs if x < cut], [y for x, y in pairs if x >= cut]
        gain = entropy([y for _, y in pairs]) - (len(low) * entropy(low) + len(high) * entropy(high)) / len(pairs)
        if best is None or gain > best[0] + 1e-12:
            best = gain, cut, low, high
    if best is None:
        return set()
    gain, cut, low, high = best
    every = [y for _, y in pairs]
    k, k1, k2 = len(set(every)), len(set(low)), len(set(high))
    delta = math.log2(3 ** k - 2) - (k * entropy(every) - k1 * entropy(low) - k2 * entropy(high))
    if gain <= (math.log2(len(pairs) - 1) + delta) / len(pairs):
        return set()
    return {cut} | brute_cuts([p for p in pairs if p[0] < cut]) | brute_cuts([p for p in pairs if p[0] >= cut])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, 3000)
    noise = rng.integers(0, 40, 3000)
    y = np.where((x >= 10) & (x < 25), "mid", "out")
    y = np.where(rng.random(3000) < 0.05, "mid", y)
    rows = [(float(a), float(b), str(c)) for a, b, c in zip(x, noise, y, strict=True)]
    return rows, spark.createDataFrame(rows, "x double, noise double, y string")


def test_known_cuts_are_found(labelled):
    rows, df = labelled
    got = discretize.mdl_cuts(df, ["x", "noise"], "y").collect()
    assert {r["cut"] for r in got if r["feature"] == "x" and r["accepted"]} == {10.0, 25.0} == brute_cuts(
        [(a, c) for a, _, c in rows])
    assert not any(r["accepted"] for r in got if r["feature"] == "noise")


def test_information_at_the_cuts(labelled):
    rows, df = labelled
    got = {r["feature"]: r for r in discretize.mdl_information(df, ["x", "noise"], "y").collect()}
    joint = Counter(((a >= 10) + (a >= 25), c) for a, _, c in rows)
    bins, classes = Counter(), Counter()
    for (b, c), n in joint.items():
        bins[b] += n
        classes[c] += n
    wanted = sum(n / 3000 * math.log(n * 3000 / (bins[b] * classes[c])) for (b, c), n in joint.items())
    assert got["x"]["n_bins"] == 3 and abs(got["x"]["mutual_information"] - wanted) < 1e-9
    assert got["noise"]["n_bins"] == 1 and abs(got["noise"]["mutual_information"]) < 1e-12


def test_missing_values_and_null_label(spark, labelled):
    rows, df = labelled
    odd = df.union(spark.createDataFrame([(None, 1.0, "mid"), (float("nan"), None, "out")] * 20, df.schema))
    cuts = {r["cut"] for r in discretize.mdl_cuts(odd, ["x", "noise"], "y").where("accepted").collect()}
    assert cuts == {10.0, 25.0}
    unnamed = df.withColumn("y", F.when(F.col("y") == "mid", F.col("y")))
    assert {r["cut"] for r in discretize.mdl_cuts(unnamed, ["x"], "y").where("accepted").collect()} == {10.0, 25.0}
    assert discretize.mdl_cuts(df.limit(0), ["x"], "y").collect() == []
    bins = discretize.with_bins(spark.createDataFrame([(v,) for v in (None, float("nan"), -1.0, 1.0, 2.0, float("inf"))], "v double"),
                                {"v": [1.0, 2.0]}).collect()
    assert [r["__b0"] for r in bins] == [-1, -1, 0, 1, 2, 2]


def plain_top(texts, k):
    counts = Counter()
    for t in texts:
        w = (t or "").split()
        counts.update(" ".join(p) for p in zip(w, w[1:]))
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("capacity", [65_536, 200, 12])
def test_top_ngrams_are_exact(spark, monkeypatch, capacity):
    """With room for all, with room for few (bounds decide), and with too little (all are counted)."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{min(int(z), 400)}" for z in rng.zipf(1.6, 60)) for _ in range(300)] + [None, "", "one"]
    full = []
    monkeypatch.setattr(heavy_hitters, "ngram_counts", lambda *a, f=heavy_hitters.ngram_counts: full.append(1) or f(*a))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    got = [(r["ngram"], r["n"]) for r in heavy_hitters.top_ngrams(df, "text", 2, 10, capacity).collect()]
    assert sorted(got, key=lambda x: (-x[1], x[0])) == plain_top(texts, 10)
    assert bool(full) == (capacity == 12)


def test_merge_keeps_its_bound():
    rng = np.random.default_rng(4)
    stream = rng.zipf(1.3, 20_000) % 5000
    keys, counts, error = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for part in np.array_split(stream, 20):
        new, n = np.unique(part, return_counts=True)
        keys, counts, off = heavy_hitters.merge_counts(np.concatenate([keys, new]), np.concatenate([counts, n]), 100)
        error += off
    true, kept = Counter(stream.tolist()), dict(zip(keys.tolist(), counts.tolist(), strict=True))
    assert len(kept) <= 100 and error <= len(stream) / 101
    assert all(kept.get(x, 0) <= n <= kept.get(x, 0) + error for x, n in true.items())
