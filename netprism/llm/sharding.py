"""Sharding (9): hierarchical weighted hash tree.

Shards stand in racks and racks in regions; a node's weight is the number of
its shards.  A document descends from the root: at each level every child
has a draw, and the smallest wins.  A shard draws ``-ln(u)`` with ``u`` in (0, 1) from a hash of
(doc_id, shard), and a rack or region has the smallest draw of its shards, which is
distributed as ``-ln(u) / weight``, so a child is taken in proportion to its weight.
When weights change, documents move only into or out of the subtrees whose weights changed, and one more shard,
wherever it stands, takes rows only into itself (law ``key``).

All draws are Spark column expressions over md5 of the key.  ``slot`` numbers the rows
of a shard from 0: the digest rows are written once, each written file gets
its offset in each shard from per-file counts, and rows are ranked within
(file, shard); no task holds a shard.

Edge cases: a null text counts 0 bytes (size 1) and crc32 of nothing; all
rows with a null id share one key; repeated rows get slots of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Shards of a rack and racks of a region.
RACK, REGION = 4, 2


def tree(shards: int, rack: int = RACK, region: int = REGION) -> dict:
    """{region: {rack: [shards]}} of ``shards`` shards, filled in order."""
    out: dict = {}
    for s in range(shards):
        out.setdefault(s // (rack * region), {}).setdefault(s // rack, []).append(s)
    return out


def draw(key: Column, shard: int) -> Column:
    """-ln(u) with u from the first 52 bits of md5(key, shard)."""
    digest = F.md5(F.concat(key, F.lit(f"/shard{shard}")).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2 ** 52))


def smallest(draws: dict[int, Column]) -> Column:
    """The node with the smallest draw (ties: the smaller number)."""
    if len(draws) == 1:
        return F.lit(next(iter(draws)))
    return F.least(*[F.struct(d.alias("d"), F.lit(c).alias("c")) for c, d in draws.items()])["c"]


def least_of(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def descend(df: DataFrame, shards: int, name: str) -> DataFrame:
    """Adds the column ``name``: the shard among ``shards``, from the draws ``_d0``, ``_d1`` and so on."""
    top = tree(shards)
    racks = {k: least_of([F.col(f"_d{s}") for s in leaf]) for node in top.values() for k, leaf in node.items()}
    regions = {r: least_of([racks[k] for k in node]) for r, node in top.items()}
    df = df.withColumn("_region", smallest(regions))
    df = df.withColumn("_rack", F.coalesce(*[F.when(F.col("_region") == r, smallest({k: racks[k] for k in node}))
                                             for r, node in top.items()]))
    leaves = [F.when(F.col("_rack") == k, smallest({s: F.col(f"_d{s}") for s in leaf}))
              for node in top.values() for k, leaf in node.items()]
    return df.withColumn(name, F.coalesce(*leaves).cast("int")).drop("_region", "_rack")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard
    among ``shards + 1``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumns({f"_d{s}": draw(key, s) for s in range(shards + 1)})
    rows = descend(descend(rows, shards, "shard"), shards + 1, "grown_shard")
    rows = stored(rows.drop(*[f"_d{s}" for s in range(shards + 1)]), "sharded")
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # at most files x shards small rows
    counts = rows.groupBy("shard", "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("shard", "_file", (F.sum("_n").over(
        Window.partitionBy("shard").orderBy("_file")) - F.col("_n")).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_file").orderBy("_row")) - 1)
    return (ranked.join(before, ["shard", "_file"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("_before") + F.col("_rank")).cast("long").alias("slot"), "grown_shard"))
