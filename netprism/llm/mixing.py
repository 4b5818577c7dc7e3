"""Mixing sources to target weights (13): multivariate-hypergeometric splitting tree.

Sizes are words.  Sources weigh ``weights`` in turn, by name; the mix has as
many words as the table, shared by weight, but a source gives at most ``most`` times
its own words and the excess goes to the others by weight, until none is above.
With the sources in the order of their capacity per weight that is one sweep:
a source is full if its capacity is below its share of what the sources before
it leave.

The words of a source stand in one line, documents in the order of a hash of
their ids, and are cut into blocks.  An epoch takes all whole blocks in an order of its
own, then the rest of the line; a source's quota is the first so many draws of
its epochs, the last one cut to the word.  The quotas are then split among
the output shards of ``shard_blocks`` draws: a node of the tree has a range of shards and a
quota of each source, and its first half of the shards gets a draw from the multivariate
hypergeometric distribution, as if the node's blocks were shuffled.  Nodes draw
from seeds of their own, so subtrees are split in different tasks.  A leaf has its
exact quota of each source, and the sources' draws are handed out in order,
so no draw is in two shards.  The order of an epoch is a keyed permutation that each task
computes for its own draws (Feistel rounds, walking the cycle back into
range), and a shard shuffles its draws among themselves.

Edge cases: a null or empty text has size 0 and is drawn nowhere; a null source is a
source, the last; rows that repeat an id are rows of their own; a source without
words has target 0; a table without words gives an empty mix, an empty table no
rows; columns that are not named are ignored, whatever their names.  One row per source is
held in a task at a time; documents, blocks and draws are not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running_totals, stored

#: Shares of the sources, in turn.
WEIGHTS = (5, 2, 1)
#: Words of a block, draws of a shard, shards below which a node is split to the end in one task.
BLOCK, SHARD_BLOCKS, FAN = 1024, 512, 64
#: What numpy's hypergeometric draws take; beyond it blocks are longer.
MOST_DRAWS = 500_000_000


def word_count(text: Column) -> Column:
    """Stretches without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _tag() -> Column:
    """The source as a key that is never null."""
    return F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source"))).alias("tag")


def _source() -> Column:
    return F.when(F.col("tag") != "0", F.substring("tag", 2, 2 ** 31 - 1)).alias("source")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size and target of every source of ``sizes`` (source, source_size)."""
    # one row per source
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("_w", share).withColumn("_cap", F.col("source_size") * most)
    everything = Window.partitionBy(F.lit(0))
    before = (Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_words", F.sum("source_size").over(everything)).withColumn("_all", F.sum("_w").over(everything))
    left = F.col("_words") - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    open_ = F.col("_all") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    rows = rows.withColumn("_full", F.col("_cap") * open_ <= left * F.col("_w"))
    taken = F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(everything)
    rest = F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_w")).otherwise(0.0)).over(everything)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise((F.col("_words") - taken) * F.col("_w") / rest)
    return rows.select("source", "source_size", target.alias("target"))


def permuted(index: np.ndarray, size: int, key: list[int]) -> np.ndarray:
    """Places of ``index`` in a permutation of 0 .. ``size`` - 1 that ``key`` picks."""
    if size <= 1:
        return index.copy()
    half = np.uint64(max(1, -(-(size - 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.random.default_rng(key).integers(0, 2 ** 63, 6, np.uint64) | np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        for k in keys:
            left, right = x >> half, x & mask
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * k
            x = (right << half) | (left ^ ((mixed >> np.uint64(33)) & mask))
        out[todo] = x
        todo[todo] = x >= size
    return out.astype(np.int64)


def halves(quota: np.ndarray, first: int, last: int, shard_blocks: int, seed: int) -> tuple[np.ndarray, int]:
    """(quota of the node's first half of shards, the shard at which the second begins)."""
    middle = (first + last) // 2
    take = min((middle - first) * shard_blocks, int(quota.sum()))
    rng = np.random.default_rng([seed, first, last])
    return rng.multivariate_hypergeometric(quota, take, method="marginals"), middle


def split_quotas(spark: SparkSession, quota: np.ndarray, shard_blocks: int, seed: int, fan: int = FAN) -> DataFrame:
    """(shard, quota, before): the draws of each source in every shard, and those
    in the shards before it.  ``quota`` has one number per source."""
    shards = max(1, -(-int(quota.sum()) // shard_blocks))
    kinds = "first long, last long, quota array<long>, before array<long>"
    nodes = spark.createDataFrame([(0, shards, quota.tolist(), [0] * len(quota))], kinds)
    width = shards

    def run(batches, stop):
        for b in batches:
            rows = []
            for node in b.to_pylist():
                todo = [(node["first"], node["last"], np.array(node["quota"], np.int64), np.array(node["before"], np.int64))]
                while todo:
                    first, last, own, before = todo.pop()
                    if last - first <= stop:
                        rows.append({"first": first, "last": last, "quota": own.tolist(), "before": before.tolist()})
                        continue
                    left, middle = halves(own, first, last, shard_blocks, seed)
                    todo += [(middle, last, own - left, before + left), (first, middle, left, before)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                    ("first", pa.int64()), ("last", pa.int64()), ("quota", pa.list_(pa.int64())),
                    ("before", pa.list_(pa.int64()))]))

    while width > 1:
        # halving until ``stop``: a node becomes at most 2 * fan nodes
        stop = max(1, width // fan)
        nodes = nodes.mapInArrow(lambda batches, stop=stop: run(batches, stop), kinds)
        if stop > 1:
            nodes = stored(nodes.repartition("first"), "nodes")
        width = stop
    return nodes.select(F.col("first").alias("shard"), "quota", "before")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = 3, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS,
        seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): ``rows`` has doc_id, size, source_size, target and _row
    (the row's number) of every row; ``pieces`` the mix: shard, slot (order within
    it), epoch, source, _row, doc_id, start and length (the words of the document
    that stand there)."""
    spark = docs.sparkSession
    key = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.select("doc_id", "source", _tag(), word_count(F.col("text")).alias("size"), key.alias("_key"))
    lined = running_totals(rows, "tag", [F.col("_key"), F.col("doc_id").asc_nulls_first(), F.col("size")], "size", "lined")
    lined = stored(lined.select("doc_id", "tag", "size", "_before", "_row"), "placed")
    named = lined.groupBy("tag").agg(F.sum("size").alias("source_size"))
    goal = targets(named.select(_source(), "source_size"), weights, most)
    goal = stored(goal.select(_tag(), "source_size", "target"), "targets")
    rows = lined.join(F.broadcast(goal), "tag")

    # one small row per source
    plan = goal.where(F.col("target") > 0).orderBy("tag").select("tag", "source_size", "target").toPandas()
    size = plan["source_size"].to_numpy(np.int64)
    want = np.minimum(np.rint(plan["target"].to_numpy(np.float64)).astype(np.int64), size * most)
    while (want // block + 1).sum() > MOST_DRAWS:
        block *= 2
    whole = size // block
    per_epoch = -(-size // block)
    quota = want // np.maximum(size, 1) * per_epoch + -(-(want % np.maximum(size, 1)) // block)
    numbers = {t: i for i, t in enumerate(plan["tag"].tolist())}
    if not len(numbers):
        empty = ("shard long, slot int, epoch int, source string, _row long, doc_id long, start long, length long")
        return rows.select("doc_id", "size", "source_size", "target", "_row"), spark.createDataFrame([], empty)
    handed = split_quotas(spark, quota, shard_blocks, seed)

    def draws(batches):
        for b in batches:
            for node in b.to_pylist():
                shard, parts = node["shard"], []
                for s, (n, at) in enumerate(zip(node["quota"], node["before"], strict=True)):
                    if not n:
                        continue
                    t = np.arange(at, at + n)
                    epoch, u = t // per_epoch[s], t % per_epoch[s]
                    number = u.copy()
                    for e in np.unique(epoch).tolist():
                        own = (epoch == e) & (u < whole[s])
                        number[own] = permuted(u[own], int(whole[s]), [seed, s, e])
                    # words before this draw, and those it has
                    sofar = epoch * size[s] + u * block
                    n_words = np.minimum(np.minimum(block, size[s] - number * block), want[s] - sofar)
                    parts.append((np.full(n, s), epoch, number, n_words))
                if not parts:
                    continue
                source, epoch, number, n_words = [np.concatenate(c) for c in zip(*parts, strict=True)]
                order = np.random.default_rng([seed, shard, 1]).permutation(len(source))
                slot = np.empty(len(order), np.int64)
                slot[order] = np.arange(len(order))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(source), shard)), pa.array(slot.astype(np.int32)), pa.array(epoch.astype(np.int32)),
                     pa.array(source), pa.array(number), pa.array(n_words)],
                    names=["shard", "slot", "epoch", "_s", "_block", "_words"])

    drawn = handed.repartition("shard").mapInArrow(draws, "shard long, slot int, epoch int, _s long, _block long, _words long")
    code = spark.createDataFrame([(t, i) for t, i in numbers.items()], "tag string, _s long")
    lying = (lined.where(F.col("size") > 0).join(F.broadcast(code), "tag")
             .withColumn("_block", F.explode(F.sequence(F.expr(f"_before div {block}"),
                                                        F.expr(f"(_before + size - 1) div {block}")))))
    # the part of the document that lies in the words the draw has
    low = F.greatest(F.col("_before"), F.col("_block") * block)
    high = F.least(F.col("_before") + F.col("size"), F.col("_block") * block + F.col("_words"))
    pieces = (lying.join(drawn, ["_s", "_block"]).withColumn("length", high - low).where(F.col("length") > 0)
              .select("shard", "slot", "epoch", _source(), "_row", "doc_id", (low - F.col("_before")).alias("start"), "length"))
    return rows.select("doc_id", "size", "source_size", "target", "_row"), pieces


def piece_words(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """``pieces`` of a table with unique ids, with the column ``words``: their texts."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    texts = docs.select(F.col("doc_id").alias("_id"), words.alias("_all"))
    return (pieces.join(texts, F.col("doc_id") == F.col("_id"))
            .withColumn("words", F.array_join(F.slice("_all", (F.col("start") + 1).cast("int"), F.col("length").cast("int")), " "))
            .drop("_id", "_all"))


def document_shares(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, size, source_size, target and taken (the words that the mix takes
    of it, repeats counted) of every row."""
    rows, pieces = mix(docs, **parameters)
    taken = pieces.groupBy("_row").agg(F.sum("length").alias("taken"))
    return (rows.join(taken, "_row", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))
