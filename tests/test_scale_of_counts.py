"""Steps whose cost the reviewer measured: log parsing under a window, duplicate flags, n-gram counts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from netprism.operators import clean, content
from netprism.operators import weblog as wl


def test_window_filter_does_not_parse_lines_anew(spark):
    line = F.concat(F.lit("10.0.0."), F.col("id"), F.lit(' - - [01/Jan/2024:00:0'), F.col("id") % 2,
                    F.lit(':07 +0000] "GET /a HTTP/1.1" 200 5 "-" "x"'))
    lines = spark.range(6).select(F.when(F.col("id") < 5, line).otherwise("no log line").alias("line"))
    got = wl.requests_per_minute(wl.parse_clf(lines), "uri")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(wl.CLF_RE) == 2  # the time and the uri, once each, and no filter that makes them anew
    assert sorted((r["window_start"].minute, r["uri"], r["n"]) for r in got.collect()) == [(0, "/a", 3), (1, "/a", 2)]


def test_rows_travel_once_to_be_flagged(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 7, "a"), (2, 1, "z"), (None, 3, "q"), (None, None, "r")] * 2,
                               "k long, t long, x string")
    for hot in (100_000, 3, 0):
        got = clean.flag_key_duplicates(df, ["k"], ["t"], hot=hot)
        assert got.columns == ["k", "t", "x", "is_duplicate"] and got.count() == 12
        first = {tuple(r)[:3] for r in got.where(~F.col("is_duplicate")).collect()}
        assert first == {(1, 5, "a"), (2, 1, "z"), (None, None, "r")}
        assert got.where(~F.col("is_duplicate")).count() == 3
    plan = clean.flag_key_duplicates(df, ["k"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.fixture(scope="module")
def texts():
    words = ["a", "b c", "A", "é", "x.", "1"]
    made = [" \t".join(words[(i * j) % 6] for j in range(i % 9)) + "\n" * (i % 2) for i in range(120)]
    return [*made, None, "", " ", "a\x0bb\x0cc\rd"]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngram_counts_by_numbers_of_tokens(spark, texts, n):
    want = Counter()
    for t in texts:
        w = (t or "").encode().split()
        want.update(b" ".join(w[i:i + n]).decode() for i in range(len(w) - n + 1))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = content.ngram_counts(df, "text", n, None)
    assert {r["ngram"]: r["n"] for r in counts.collect()} == want
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()
    for k in (1, 4, 1000):
        top = [tuple(r) for r in content.ngram_counts(df, "text", n, k).collect()]
        assert top == sorted(want.items(), key=lambda x: (-x[1], x[0].encode()))[:k]


def test_top_ngrams_are_counted_by_hash_first(spark):
    df = spark.createDataFrame([("a b c a b c a b d",), ("q r",)], "text string")
    assert [tuple(r) for r in content._top_by_hash(df.select(F.col("text").alias("t")), 2, 2).collect()] == [("a b", 3), ("b c", 2)]
    # more ties than are looked up: all texts are counted
    many = spark.range(30).select(F.concat_ws(" ", F.col("id"), F.lit("z")).alias("t"))
    assert content._top_by_hash(many, 2, 5, most=10) is None
    assert [r["ngram"] for r in content.ngram_counts(many, "t", 2, 2).collect()] == ["0 z", "1 z"]


def test_text_pieces_keep_every_text():
    import pyarrow as pa

    texts = ["x" * (i % 7) for i in range(50)]
    batches = [pa.record_batch([pa.array(texts[i:i + 8])], names=["t"]) for i in range(0, 50, 8)]
    for most in (1, 5, 1000):
        pieces = [p.to_pylist() for p in content._text_pieces(iter(batches), most)]
        assert [t for p in pieces for t in p] == texts
