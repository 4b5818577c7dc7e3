"""Binary corpora in chunks (S10, B01): a data source whose tasks hold one chunk.

``binaryFile`` makes a file one row, so a task holds it whole and a file above
2 GB fails.  Here the partitions are byte ranges: a large file is read by many
tasks, small files share one, and a row is a chunk of at most ``chunk_bytes``.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK_SCHEMA = "path string, file_bytes long, offset long, chunk binary"


def _store(uri: str):
    """(file system, path) of a folder that driver and executors see."""
    from pyarrow import fs

    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


class Ranges(InputPartition):
    """(path, file size, first byte, byte after the last) of what one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


def cut(files: list[tuple[str, int]], partition_bytes: int) -> list[Ranges]:
    """Byte ranges of at most ``partition_bytes``, small files together; an empty file is an empty range."""
    out, held, size = [], [], 0
    for path, n in files:
        start = 0
        while True:
            stop = min(n, start + partition_bytes - size)
            held.append((path, n, start, stop))
            size += stop - start
            if size >= partition_bytes:
                out.append(Ranges(held))
                held, size = [], 0
            start = stop
            if start >= n:
                break
    return out + ([Ranges(held)] if held else [])


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.chunk = int(options.get("chunkBytes", 1 << 20))
        self.partition = int(options.get("partitionBytes", 64 << 20))

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        store, folder = _store(self.path)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True))
        files = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.glob)
                       and not i.base_name.startswith((".", "_")))
        return cut(files, self.partition) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path, size, start, stop in partition.ranges:
            if start == stop:
                yield path, size, start, b""
                continue
            with store.open_input_file(path) as f:
                f.seek(start)
                while start < stop:
                    data = f.read(min(self.chunk, stop - start))
                    if not data:
                        raise OSError(f"{path} became shorter while it was read")
                    yield path, size, start, data
                    start += len(data)


class BinaryChunks(DataSource):
    """``spark.read.format("binary_chunks").load(folder)`` with options glob, chunkBytes, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "binary_chunks"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)


def read_chunks(spark: SparkSession, folder: str, glob: str = "*", chunk_bytes: int = 1 << 20,
                partition_bytes: int = 64 << 20) -> DataFrame:
    """Path, file_bytes, offset and chunk of all files under ``folder`` whose name fits ``glob``; hidden
    files and those that begin with an underscore are left out, an empty file is one empty chunk."""
    spark.dataSource.register(BinaryChunks)
    return (spark.read.format("binary_chunks").option("glob", glob).option("chunkBytes", chunk_bytes)
            .option("partitionBytes", partition_bytes).load(folder))


def byte_counts(chunks: DataFrame) -> DataFrame:
    """path, byte, n: how often each byte stands in each file; chunks merge by addition."""
    def run(batches):
        for pdf in batches:
            for path, chunk in zip(pdf["path"], pdf["chunk"], strict=True):
                n = np.bincount(np.frombuffer(chunk, np.uint8), minlength=256)
                own = np.flatnonzero(n)
                yield pd.DataFrame({"path": path, "byte": own.astype(np.int32), "n": n[own]})

    counted = chunks.select("path", "chunk").mapInPandas(run, "path string, byte int, n long")
    return counted.groupBy("path", "byte").agg(F.sum("n").alias("n"))


def byte_profile(chunks: DataFrame) -> DataFrame:
    """B01 of whole files from their chunks: path, n_bytes, entropy (bits a byte), null_pct, printable_pct
    (bytes 32 to 126), magic (the first four bytes in hex); an empty file has entropy 0 and null shares."""
    counts = byte_counts(chunks)
    total = F.sum("n")
    sums = counts.groupBy("path").agg(
        total.alias("n"), F.sum(F.col("n") * F.log2("n")).alias("s"),
        F.sum(F.when(F.col("byte") == 0, F.col("n")).otherwise(0)).alias("nulls"),
        F.sum(F.when(F.col("byte").between(32, 126), F.col("n")).otherwise(0)).alias("printable"))
    heads = chunks.where(F.col("offset") == 0).select("path", "file_bytes", F.hex(F.substring("chunk", 1, 4)).alias("magic"))
    n = F.col("n")
    return heads.join(sums, "path", "left").select(
        "path", F.coalesce(n, F.lit(0)).alias("n_bytes"),
        F.coalesce(F.log2(n) - F.col("s") / n, F.lit(0.0)).alias("entropy"), (F.col("nulls") * 100.0 / n).alias("null_pct"),
        (F.col("printable") * 100.0 / n).alias("printable_pct"), "magic", "file_bytes")
