"""W3C extended log lines and the documented label tables: odd lines have defined values."""

from datetime import datetime

from pyspark.sql import functions as F

from netprism.operators import features, weblog


def test_extended_log_lines(spark):
    lines = ["#Version: 1.0", "#Fields: date time cs-method cs-uri-stem cs-uri-query sc-status cs(User-Agent)",
             "2024-02-03 04:05:06 GET /a - 200 Mozilla/5.0+(X11)", "2024-13-03 04:05:06 PUT /b q=1 abc -", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r["i"]: r for r in weblog.parse_elf(df, keep=["i"]).collect()}
    assert sorted(got) == [2, 3, 4, 5]
    assert got[2]["ts"] == datetime(2024, 2, 3, 4, 5, 6) and got[2]["uri"] == "/a" and got[2]["status"] == 200
    assert got[2]["user_agent"] == "Mozilla/5.0 (X11)" and got[2]["ip"] is None and got[2]["size"] is None
    assert (got[3]["ts"], got[3]["uri"], got[3]["status"], got[3]["user_agent"]) == (None, "/b?q=1", None, None)
    assert got[4]["method"] is None and got[5]["method"] is None


def test_label_tables(spark):
    raw = [" Sql-Injection", "brute_force", "CSRF", "never seen", None]
    df = spark.createDataFrame([(x,) for x in raw], "label string").withColumn("key", features.label_key(F.col("label")))
    got = {r["label"]: r for r in features.map_labels(df, "key", features.label_table(spark, "web"),
                                                      unknown_category="Other", unknown_code=7).collect()}
    assert [got[x]["multi_code"] for x in raw] == [1, 5, 6, 7, 7] and got[" Sql-Injection"]["category"] == "SQL Injection"
    assert all(r["binary_code"] == 1 for r in got.values())
    assert [features.label_table(spark, m).count() for m in ("network", "web", "malware")] == [9, 8, 8]
