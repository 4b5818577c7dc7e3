"""Queries: sources and sinks (S01-S06, S08, S10).  Files are written under the
session's checkpoint folder (shared on a cluster), each run in a fresh folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import r6
from ..operators import clean
from ..session import scratch_path
from ..sources import chunks, files
from ..sources.tables import FLOWS_SQL, flows, table
from .catalog import query, with_ctes
from .profiling import COUNTS_SQL, cleaned_sets


@query("S01_csv_with_header", "SELECT * FROM lineitem")
def s01(spark, sf):
    li = table(spark, sf, "lineitem")
    path = scratch_path(spark, "lineitem-csv")
    files.write_dataset(li, path, fmt="csv")
    return files.read_csv(spark, path, schema=li.schema)


@query("S02_headerless_fixed_schema", "SELECT * FROM customer")
def s02(spark, sf):
    cust = table(spark, sf, "customer")
    path = scratch_path(spark, "customer-headerless")
    cust.write.mode("overwrite").option("header", False).csv(path)
    return files.read_headerless(spark, path, cust.schema, check_arity=True)


@query("S03_read_parquet", "SELECT * FROM orders")
def s03(spark, sf):
    return table(spark, sf, "orders")


@query("S04_discover_inputs", "SELECT replace(c_mktsegment, '_', '-') || '-flows' AS dataset, count(*) AS n"
       " FROM customer GROUP BY c_mktsegment")
def s04(spark, sf):
    cust = table(spark, sf, "customer")
    root = scratch_path(spark, "inbox")
    segments = [r[0] for r in cust.select("c_mktsegment").distinct().collect()]  # a handful of names
    for seg in segments:
        part = cust.where(F.col("c_mktsegment") == seg)
        files.write_dataset(part, f"{root}/{seg}_flows.csv", fmt="csv")
    # an already cleaned copy must be skipped
    files.write_dataset(cust.where(F.col("c_mktsegment") == segments[0]),
                        f"{root}/{segments[0]}_flows_cleaned.csv", fmt="csv")
    found = files.discover_folders(spark, root, schema=cust.schema)
    return found.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("S05_first_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def s05(spark, sf):
    return files.sample_rows(table(spark, sf, "orders"), ["o_orderkey"], 5)


@query("S06_write_cleaned_partitioned", with_ctes(
    "SELECT flow_id, destination_port, coalesce(protocol, (SELECT protocol FROM flows WHERE protocol IS NOT NULL"
    " GROUP BY protocol ORDER BY count(*) DESC, protocol LIMIT 1), 'Unknown') AS protocol FROM flows", FLOWS_SQL))
def s06(spark, sf):
    f, _ = clean.impute_mode(flows(spark, sf).select("flow_id", "destination_port", "protocol"), ["protocol"])
    path = scratch_path(spark, "flows-cleaned")
    files.write_dataset(f, path, partition_by=["protocol"])
    return spark.read.parquet(path).select("flow_id", "destination_port", "protocol")


@query("S08_before_after_counts", COUNTS_SQL)
def s08(spark, sf):
    from ..operators.profile import before_after_counts

    return before_after_counts(cleaned_sets(spark, sf))


@query("S10_binary_files")
def s10(spark, sf):
    """The given tables' own files read as a binary corpus, in chunks: name, size, magic bytes."""
    b = chunks.read_chunks(spark, sf, glob="*.parquet")
    return b.groupBy(F.element_at(F.split("path", "/"), -1).alias("file")).agg(
        F.sum(F.octet_length("chunk")).cast("long").alias("length"),
        F.max(F.when(F.col("offset") == 0, F.decode(F.substring("chunk", 1, 4), "US-ASCII"))).alias("magic"))


@query("B01_chunked_byte_counts", """SELECT CAST(('0x' || h) AS INTEGER) AS byte, count(*) AS n FROM (
 SELECT unnest(regexp_extract_all(hex(encode(text || chr(10))), '..')) AS h FROM documents WHERE text IS NOT NULL) GROUP BY h""")
def b01_chunks(spark, sf):
    """The texts written as line files into the shared folder and read back in byte ranges: counts of every byte."""
    folder = scratch_path(spark, "text-files")
    table(spark, sf, "documents").where(F.col("text").isNotNull()).select("text").write.text(folder)
    counts = chunks.byte_counts(chunks.read_chunks(spark, folder, glob="part-*", chunk_bytes=65_521, partition_bytes=1_000_003))
    return counts.groupBy("byte").agg(F.sum("n").alias("n"))
