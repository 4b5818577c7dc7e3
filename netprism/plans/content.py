"""Queries: content features over documents (B01-B04) and the binary-file source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import r6
from ..operators import content as ct
from ..operators import heavy_hitters
from ..sources.tables import table
from .catalog import query


def _q(s):
    return s.replace("'", "''")


@query("B01_byte_profile", "SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy,"
       " round(max(null_pct), 6) AS null_pct, round(max(printable_pct), 6) AS printable_pct FROM ("
       " SELECT doc_id, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY doc_id) AS p,"
       " any_value(null_pct) AS null_pct, any_value(printable_pct) AS printable_pct FROM ("
       "  SELECT doc_id, unnest(string_split(text, '')) AS ch,"
       "  (length(text) - length(replace(text, chr(0), ''))) * 100.0 / length(text) AS null_pct,"
       f"  length(regexp_replace(text, '{_q(ct.NON_PRINTABLE)}', '', 'g')) * 100.0 / length(text) AS printable_pct"
       "  FROM documents) GROUP BY doc_id, ch) GROUP BY doc_id")
def b01(spark, sf):
    d = table(spark, sf, "documents")
    prof = ct.byte_profile(F.col("text"))
    return d.select("doc_id", *[r6(c).alias(n) for n, c in prof.items()])


@query("B02_string_profile",
       f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_q(ct.PRINTABLE_RUN)}')) AS INTEGER) AS n_strings,"
       f" round(list_avg(list_transform(regexp_extract_all(text, '{_q(ct.PRINTABLE_RUN)}'), lambda x: length(x))), 6)"
       f" AS mean_string_length, CAST(len(regexp_extract_all(text, '{_q(ct.URL_RE)}')) AS INTEGER) AS n_urls,"
       f" CAST(len(regexp_extract_all(text, '{_q(ct.IPV4_RE)}')) AS INTEGER) AS n_ips,"
       f" CAST(len(regexp_extract_all(text, '{_q(ct.SUSPICIOUS_RE)}')) AS INTEGER) AS n_suspicious FROM documents")
def b02(spark, sf):
    d = table(spark, sf, "documents")
    prof = ct.string_profile(F.col("text"))
    return d.select("doc_id", *[(r6(c) if n == "mean_string_length" else c).alias(n)
                                for n, c in prof.items()])


def _ngram_sql(n, top=" ORDER BY n DESC, ngram LIMIT 100"):
    parts = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return (f"SELECT ngram, count(*) AS n FROM (SELECT {parts} AS ngram FROM ("
            f" SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM ("
            "  SELECT list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)"
            f" WHERE len(w) >= {n})) GROUP BY ngram{top}")


@query("B03_bigram_counts", _ngram_sql(2, ""))
def b03_all(spark, sf):
    return ct.ngram_counts(table(spark, sf, "documents"), "text", 2, None)


@query("B03_trigram_counts", _ngram_sql(3, ""))
def b03t_all(spark, sf):
    return ct.ngram_counts(table(spark, sf, "documents"), "text", 3, None)


@query("B03_bigram_top100", _ngram_sql(2))
def b03(spark, sf):
    return ct.ngram_counts(table(spark, sf, "documents"), "text", 2, 100)


@query("B03_trigram_top100", _ngram_sql(3))
def b03t(spark, sf):
    return ct.ngram_counts(table(spark, sf, "documents"), "text", 3, 100)


@query("B03_bigram_heavy_hitters", _ngram_sql(2))
def b03_heavy(spark, sf):
    """The same by summaries of fixed size and an exact count of the candidates."""
    return heavy_hitters.top_ngrams(table(spark, sf, "documents"), "text", 2, 100)


@query("B04_size_category", "SELECT doc_id, CASE WHEN n_chars < 1000 THEN 'tiny' WHEN n_chars < 10000 THEN 'small'"
       " WHEN n_chars < 100000 THEN 'medium' ELSE 'large' END AS size_category,"
       " round((n_chars - (SELECT min(n_chars) FROM documents)) * 1.0 / ((SELECT max(n_chars) FROM documents)"
       " - (SELECT min(n_chars) FROM documents)), 6) AS size_norm FROM documents")
def b04(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", ct.size_category(F.col("n_chars")).alias("size_category"),
                    r6(ct.size_normalised(d, "n_chars")).alias("size_norm"))
