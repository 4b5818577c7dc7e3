"""Small shared pieces of the training-data operators."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and
    read back: cuts the lineage, survives a lost executor, and gives several
    readers the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (a null id counts as empty text)."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker process, so that tasks run
    one after another by the same worker share it."""
    module = sys.modules.get("_netprism_worker_state")
    if module is None:
        module = sys.modules["_netprism_worker_state"] = types.ModuleType("_netprism_worker_state")
    return module.__dict__.setdefault("caches", {}).setdefault(name, {})


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder in the store that the cluster shares."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def publish(filesystem_, write, final: str) -> None:
    """Run ``write(sink)`` into a private name, then move it to ``final``: a task
    that is run again (or twice at once) replaces the file by an equal one."""
    draft = f"{final}.{uuid.uuid4().hex}"
    with filesystem_.open_output_stream(draft) as sink:
        write(sink)
    filesystem_.move(draft, final)


def binary_column(batch, name: str):
    """The texts of one Arrow batch as a list of UTF-8 bytes (null: empty)."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def kept_names(keep) -> list[str]:
    return [f"_keep{i}" for i in range(len(keep))]


def with_kept(docs: DataFrame, keep) -> tuple[DataFrame, str]:
    """(doc_id, text and the columns ``keep`` under neutral names; the DDL of
    the latter, each with a comma before it)."""
    named = [docs[f"`{c}`"].alias(k) for c, k in zip(keep, kept_names(keep), strict=True)]
    kinds = "".join(f", {k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep, kept_names(keep), strict=True))
    return docs.select("doc_id", "text", *named), kinds


def running_totals(rows: DataFrame, group: str, order: list, amount: str | None, name: str) -> DataFrame:
    """``rows`` written in the order ``group``, ``order``, with ``_before`` (the
    sum of ``amount`` over the rows before it in its group; None counts rows),
    ``_total`` (the group's) and ``_row`` (a number no other row has).  ``group``
    must not be null.

    Rows are dealt by ranges of the whole order, so that a group of any size
    spreads over many tasks; equal rows may stand in any order.  A task adds
    up its own rows, and what earlier tasks hold of a group comes from sums by
    (task, group).
    """
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    ties = F.monotonically_increasing_id()
    # the bounds of the ranges come from a sample, which is a pass of its own: not over the texts again
    rows = stored(rows, name + "-rows")
    ranged = rows.repartitionByRange(F.col(group), *order, ties).sortWithinPartitions(F.col(group), *order)

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        last, sofar = None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            own = b.column(b.schema.get_field_index(group))
            step = np.ones(n, np.int64) if amount is None else b.column(b.schema.get_field_index(amount)).to_numpy()
            code = own.dictionary_encode()
            code = code.indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            total = np.cumsum(step)
            base = np.concatenate([[0], total])[first]  # sum of the batch before each group's first row
            if own[0].as_py() == last:
                base[0] -= sofar
            before = total - step - np.repeat(base, np.diff(np.append(first, n)))
            last, sofar = own[n - 1].as_py(), int(before[-1] + step[-1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(before), pa.array(np.arange(number, number + n))],
                names=[*b.schema.names, "_part", "_before", "_number"])
            number += n

    summed = stored(ranged.mapInArrow(run, f"{kinds}, _part int, _before long, _number long"), name)
    last = F.lit(1) if amount is None else F.col(amount)
    # at most tasks x groups small rows
    parts = summed.groupBy(group, "_part").agg(F.sum(last).cast("long").alias("_sum"))
    within = Window.partitionBy(group).orderBy("_part")
    parts = parts.select(group, "_part", (F.sum("_sum").over(within) - F.col("_sum")).alias("_earlier"),
                         F.sum("_sum").over(Window.partitionBy(group)).alias("_total"))
    return (summed.join(parts, [group, "_part"])
            .withColumn("_before", F.col("_before") + F.col("_earlier"))
            .withColumn("_row", F.shiftleft(F.col("_part").cast("long"), 40) + F.col("_number"))
            .drop("_part", "_number", "_earlier"))
