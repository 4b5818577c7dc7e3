"""Windows, grouped aggregation and join-back.

W01 gives rows a dense position without a single-partition window: the data
is range-partitioned on a total order, sorted inside each partition, and a
per-partition row count (one small row per partition) turns the local index
into a global one.  The positional groups of the anomaly module (``row // 100``)
then hold exactly 100 rows each, so every later group-by is skew free.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import find_by_keywords, find_column
from ..functions.safe import INF, null_safe_join
from ..session import ensure_checkpoint_dir, written
from .features import epoch_micros


def total_order(df: DataFrame, order_by: Sequence[str]) -> list[str]:
    """``order_by`` followed by every other column: ties are only identical rows."""
    return list(order_by) + [c for c in df.columns if c not in order_by]


def dense_row_id(df: DataFrame, order_by: Sequence[str], name: str = "row_id",
                 partitions: int | None = None, unique: bool = False, path: str | None = None) -> DataFrame:
    """0-based position of each row in ``order_by`` order (ties broken by all
    other columns, so the position is deterministic and recomputation after a lost
    executor gives the same ids).

    Plan: one range exchange + sort; a count per partition (P small rows to the
    driver, P = number of partitions, not data size); the offset of each
    partition is a literal array indexed by ``spark_partition_id``: no join, no
    single-partition window.  The numbered rows are written to ``path`` (a fresh folder by default).
    """
    spark = df.sparkSession
    # ``unique=True``: the caller guarantees order_by is a key (no tie-breakers)
    keys = list(order_by) if unique else total_order(df, order_by)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
    local = ranged.withColumn("__pid", F.spark_partition_id()).withColumn(
        "__mid", F.monotonically_increasing_id())
    # rows of partition p carry ids (p << 33) + i; the local index is the low 33 bits
    local = local.withColumn("__local", F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33))
    # The range bounds come from sampling, which may differ between two plans
    # over the same data (column pruning changes the scan); the numbered rows are
    # therefore written once to the reliable checkpoint folder and both the
    # per-partition counts and the result read that copy.  This also cuts the
    # lineage, so a lost executor cannot renumber rows.
    local = written(local.drop("__mid"), "numbered", path)
    counts = dict(local.groupBy("__pid").count().collect())
    offsets, acc = [], 0
    for p in range(max(counts) + 1 if counts else 0):
        offsets.append(acc)
        acc += counts.get(p, 0)
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long"))
    off = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("__pid") + 1)
    return local.withColumn(name, off + F.col("__local")).drop("__pid", "__local")


def positional_groups(df: DataFrame, order_by: Sequence[str], size: int = 100,
                      group: str = "flow_group", unique: bool = False, path: str | None = None) -> DataFrame:
    """``row_id // size``."""
    return dense_row_id(df, order_by, unique=unique, path=path).withColumn(group, F.floor(F.col("row_id") / size))


# Fixed values (reference defaults when a group statistic is missing).
WIDS_DEFAULTS = {"unique_dst_ports": 1.0, "mean_bytes_sent": 10.0, "mean_bytes_received": 5.0,
                 "duration_mean": 100.0, "packet_count_mean": 10.0, "byte_ratio": 1.0}
WIDS_FEATURES = ("request_count", "unique_dst_ports", "mean_bytes_sent", "mean_bytes_received",
                 "request_rate", "duration_mean", "packet_count_mean", "byte_ratio")


def wids_columns(columns: Sequence[str]) -> dict[str, str | None]:
    """Case-insensitive keyword resolution of the columns the features use."""
    cols = list(columns)
    return {
        "dst_port": find_by_keywords(cols, "destination", "port"),
        "fwd_bytes": find_column(cols, "Total Length of Fwd Packets"),
        # The reference takes backward *packets* for 'mean bytes received'
        "bwd": find_by_keywords(cols, "total", "backward", "packets"),
        "duration": find_by_keywords(cols, "flow", "duration"),
        "fwd_packets": find_by_keywords(cols, "total", "fwd", "packets"),
    }


def wids_features(df: DataFrame, group: str = "flow_group",
                  bwd_column: str | None = None, write_groups: bool = False) -> DataFrame:
    """Per positional group: row count, distinct destination ports,
    mean sent bytes, mean backward packets (T2; ``bwd_column`` overrides),
    request rate, mean duration, mean forward packets; per row the byte ratio.

    Means and counts are one ``groupBy(group).agg`` whose rows are few after the map side; distinct ports are
    counted apart, as theirs are (group, port); one equi-join back on ``group``.  Groups have a fixed size, so
    neither side is skewed.  The byte ratio is made before the join, so that only columns of the result meet it.
    With ``write_groups`` the groups' rows are written first and their shuffles take no disk during the join.
    """
    cols = wids_columns(df.columns)
    if bwd_column:
        cols["bwd"] = bwd_column
    aggs = [F.count(F.lit(1)).alias("request_count")]
    if cols["fwd_bytes"]:
        aggs.append(F.avg(cols["fwd_bytes"]).alias("_sent"))
    if cols["bwd"]:
        aggs.append(F.avg(cols["bwd"]).alias("_recv"))
    if cols["duration"]:
        aggs.append(F.avg(cols["duration"]).alias("_dur"))
    if cols["fwd_packets"]:
        aggs.append(F.avg(cols["fwd_packets"]).alias("_pkts"))
    g = df.groupBy(group).agg(*aggs)
    if cols["dst_port"]:
        ports = df.groupBy(group).agg(F.count_distinct(cols["dst_port"]).cast("double").alias("_ports"))
        g = null_safe_join(g, ports, [group])

    def stat(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in g.columns else F.lit(default)

    g = g.select(
        group, "request_count",
        stat("_ports", 1.0).alias("unique_dst_ports"),
        stat("_sent", 10.0).alias("mean_bytes_sent"),
        stat("_recv", 5.0).alias("mean_bytes_received"),
        (F.col("request_count") / (F.coalesce(F.col("_dur"), F.lit(1.0)) + 0.001)
         if "_dur" in g.columns else F.col("request_count").cast("double")).alias("request_rate"),
        stat("_dur", 100.0).alias("duration_mean"),
        stat("_pkts", 10.0).alias("packet_count_mean"))
    if write_groups:
        g = written(g, "groups")
    if cols["fwd_bytes"] and cols["bwd"]:
        # C11: +-inf / NaN / null -> 1.0 (division by zero gives null under ANSI try_divide)
        ratio = F.try_divide(F.col(cols["fwd_bytes"]) + 1, F.col(cols["bwd"]).cast("double") + 1)
        ratio = F.coalesce(F.when(~F.isnan(ratio) & ~ratio.isin(INF, -INF), ratio), F.lit(1.0))
    else:
        ratio = F.lit(1.0)
    out = df.withColumn("__ratio", ratio).join(g, group, "inner")
    return out.withColumn("byte_ratio", F.col("__ratio")).drop("__ratio")


# ----------------------------------------------------------------- W10 - W13

def per_window_source_stats(df: DataFrame, ts: str, key: str, duration: str = "1 minute",
                            dur_col: str | None = None, label: str | None = None,
                            dst_col: str | None = None, normal: Sequence[str] = ("normal",)
                            ) -> DataFrame:
    """Per (window, source): flow count, unique destinations, mean duration,
    attack ratio.  Works on batch and streaming frames alike (a streaming frame
    counts destinations with HyperLogLog, exact distinct is not incremental)."""
    aggs = {"n_flows": F.count(F.lit(1))}
    if dst_col:
        aggs["unique_destinations"] = (F.approx_count_distinct(dst_col) if df.isStreaming
                                       else F.count_distinct(dst_col))
    if dur_col:
        aggs["mean_duration"] = F.avg(dur_col)
    if label:
        aggs["attack_ratio"] = F.avg((~F.col(label).isin(*normal)).cast("double"))
    return (df.groupBy(F.window(ts, duration).alias("w"), key)
            .agg(*[e.alias(n) for n, e in aggs.items()])
            .select(F.col("w.start").alias("window_start"), key, *aggs))


def previous_rows_stats(df: DataFrame, key: str, order_by: Sequence[str], n: int,
                        cols: dict[str, Column], skew_safe: bool = True,
                        block_rows: int | None = None) -> DataFrame:
    """Statistics over the previous ``n`` rows of the same key (current row
    excluded).  ``cols`` maps output name -> aggregate over the window frame.
    ``skew_safe`` (default) evaluates per (key, block) with an n-row halo."""
    if skew_safe:
        return previous_rows_stats_blocked(df, key, order_by, n, cols, block_rows or DEFAULT_BLOCK_ROWS)
    w = Window.partitionBy(key).orderBy(*order_by).rowsBetween(-n, -1)
    return df.withColumns({name: agg.over(w) for name, agg in cols.items()})


def interarrival_stats(df: DataFrame, key: str, ts: str, order: Sequence[str] = (),
                       skew_safe: bool = True, block_rows: int | None = None) -> DataFrame:
    """Inter-arrival count, mean, std, min, max, skewness per key (seconds)."""
    if skew_safe:
        return interarrival_blocked(df, key, ts, order, block_rows or DEFAULT_BLOCK_ROWS)
    from .features import interarrival_moments

    return interarrival_moments(df, key, ts, order)


def sequences(df: DataFrame, key: str, order_by: Sequence[str], value: str, length: int,
              name: str = "sequence", skew_safe: bool = True, block_rows: int | None = None) -> DataFrame:
    """Per row the last ``length`` values of ``value`` within ``key`` (current
    included), oldest first; rows with a full window only are complete."""
    if skew_safe:
        return sequences_blocked(df, key, order_by, value, length, name, block_rows or DEFAULT_BLOCK_ROWS)
    w = Window.partitionBy(key).orderBy(*order_by).rowsBetween(-(length - 1), 0)
    return df.withColumn(name, _values_over(value, w))


def _values_over(value: str, w) -> Column:
    """All values of a frame, nulls included (``collect_list`` alone skips them)."""
    return F.transform(F.collect_list(F.struct(F.col(value).alias("v"))).over(w), lambda x: x["v"])


__all__ = ["dense_row_id", "positional_groups", "wids_features", "per_window_source_stats",
           "previous_rows_stats", "interarrival_stats", "sequences", "epoch_micros"]


def group_row_number(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str],
                     name: str = "rank_in_group", partitions: int | None = None,
                     broadcast_limit: int = 2_000_000) -> DataFrame:
    """0-based position of each row inside its group in ``order_by`` order.

    A ``row_number()`` window sends a whole group to one task; a group holding a
    third of all rows would be one task.  Here the rows are range-partitioned
    on (group, order, rest), so a hot group spreads over many partitions; the
    count per (partition, group) - at most partitions x groups small rows -
    gives each partition's offset inside the group.  The offsets are joined
    back (broadcast when their row count, checked first, is small).
    """
    spark = df.sparkSession
    keys = list(group_by) + [c for c in total_order(df, order_by) if c not in group_by]
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
    local = (ranged.withColumn("__pid", F.spark_partition_id())
             .withColumn("__mid", F.monotonically_increasing_id()))
    ensure_checkpoint_dir(spark)
    local = local.checkpoint(eager=True)  # one numbering for counts and result (see dense_row_id)
    # index inside (partition, group): id minus the first id of the group in the partition
    counts = local.groupBy("__pid", *group_by).agg(F.count(F.lit(1)).alias("__n"),
                                                   F.min("__mid").alias("__first"))
    w = Window.partitionBy(*group_by).orderBy("__pid")
    offsets = counts.select("__pid", *group_by, "__first",
                            (F.sum("__n").over(w) - F.col("__n")).alias("__off"))
    n_off = offsets.count()
    side = F.broadcast(offsets) if n_off <= broadcast_limit else offsets
    j = null_safe_join(local, side, ["__pid", *group_by])
    return j.withColumn(name, F.col("__off") + F.col("__mid") - F.col("__first")).drop(
        "__pid", "__mid", "__first", "__off")


# ----------------------------------------------------------------- hot keys

DEFAULT_BLOCK_ROWS = 100_000


def keyed_blocks(df: DataFrame, key: str, order_by: Sequence[str], block_rows: int = DEFAULT_BLOCK_ROWS,
                 halo: int = 0, rank: str = "__r") -> DataFrame:
    """Cut every key into blocks of ``block_rows`` consecutive rows (in
    ``order_by`` order) so that a window can run per (key, block): a key with a
    third of all rows becomes many bounded window partitions.

    ``halo`` rows - the last ``halo`` rows of each block - are copied into the
    next block with ``__halo = true``, so frames reaching up to ``halo`` rows
    back stay exact; drop the halo rows after the window.  The rank inside the
    key comes from ``group_row_number`` (range partitioning, no key-sized task).
    """
    block_rows = max(block_rows, halo, 1)  # a halo reaches one block back
    r = group_row_number(df, [key], order_by, name=rank)
    blk = F.floor(F.col(rank) / block_rows)
    base = r.withColumn("__blk", blk).withColumn("__halo", F.lit(False))
    if halo > 0:
        tail = (r.where(F.col(rank) % block_rows >= block_rows - halo)
                .withColumn("__blk", blk + 1).withColumn("__halo", F.lit(True)))
        base = base.unionByName(tail)
    return base


def blocked_window(key: str, rank: str = "__r") -> Window:
    return Window.partitionBy(key, "__blk").orderBy(rank)


def previous_rows_stats_blocked(df: DataFrame, key: str, order_by: Sequence[str], n: int,
                                cols: dict[str, Column], block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """W11, skew safe: frames of the previous ``n`` rows evaluated per (key, block)
    with an ``n``-row halo from the block before."""
    b = keyed_blocks(df, key, order_by, block_rows, halo=n)
    w = blocked_window(key).rowsBetween(-n, -1)
    out = b.withColumns({name: agg.over(w) for name, agg in cols.items()})
    return out.where(~F.col("__halo")).drop("__r", "__blk", "__halo")


def sequences_blocked(df: DataFrame, key: str, order_by: Sequence[str], value: str, length: int,
                      name: str = "sequence", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """W13, skew safe (halo of ``length - 1`` rows)."""
    b = keyed_blocks(df, key, order_by, block_rows, halo=length - 1)
    w = blocked_window(key).rowsBetween(-(length - 1), 0)
    out = b.withColumn(name, _values_over(value, w))
    return out.where(~F.col("__halo")).drop("__r", "__blk", "__halo")


def forward_fill_blocked(df: DataFrame, cols: Sequence[str], key: str, order_by: Sequence[str],
                         block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """C15, skew safe: last non-null value so far within the key.

    Inside a block: ``last(ignorenulls)`` over the block.  Across blocks: each
    block's last non-null value (one summary row per block, 1/block_rows of the
    data), carried forward over the blocks of the key and joined back on
    (key, block) - an equi-join on a key that is unique per block."""
    b = keyed_blocks(df, key, order_by, block_rows, halo=0)
    w_in = blocked_window(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = b.withColumns({f"__in_{c}": F.last(F.col(c), ignorenulls=True).over(w_in) for c in cols})
    summary = b.groupBy(key, "__blk").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__r"))).alias(f"__last_{c}")
        for c in cols])
    w_blk = (Window.partitionBy(key).orderBy("__blk")
             .rowsBetween(Window.unboundedPreceding, -1))
    carry = summary.select(key, "__blk", *[F.last(F.col(f"__last_{c}"), ignorenulls=True).over(w_blk)
                                           .alias(f"__carry_{c}") for c in cols])
    j = null_safe_join(inside, carry, [key, "__blk"], "left")
    return j.withColumns({c: F.coalesce(F.col(f"__in_{c}"), F.col(f"__carry_{c}")) for c in cols}).drop(
        "__r", "__blk", "__halo", *[f"__in_{c}" for c in cols], *[f"__carry_{c}" for c in cols])


def interarrival_blocked(df: DataFrame, key: str, ts: str, order: Sequence[str] = (),
                         block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """F16 / W12, skew safe: gaps from a 1-row halo per block, then moments per
    key with a partially aggregated ``groupBy``."""
    b = keyed_blocks(df.select(key, ts, *order), key, [ts, *order], block_rows, halo=1)
    micros = epoch_micros(F.col(ts))
    gaps = b.select(key, "__halo", (micros - F.lag(micros).over(blocked_window(key))).alias("_gap_us"))
    g = F.col("_gap_us") / 1e6
    return (gaps.where(~F.col("__halo") & F.col("_gap_us").isNotNull())
            .groupBy(key)
            .agg(F.count("*").alias("n_gaps"), F.avg(g).alias("gap_mean"),
                 F.stddev_pop(g).alias("gap_std"), F.min(g).alias("gap_min"),
                 F.max(g).alias("gap_max"), F.skewness(g).alias("gap_skew")))
