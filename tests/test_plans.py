"""Layer 4: physical plans - pushdown, pruning, no single-partition exchange."""

from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flows_scan_prunes_and_pushes(spark):
    from netprism.sources.tables import flows

    df = flows(spark, "/root/testdata/sf0.001").where(F.col("destination_port") < 1024).select("flow_id")
    plan = _plan(df)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int>" in plan


def test_positional_groups_have_no_single_partition(spark):
    from netprism.operators.windows import positional_groups
    from netprism.sources.tables import table

    g = positional_groups(table(spark, "/root/testdata/sf0.001", "events"), ["event_id"], 100)
    agg = g.groupBy("flow_group").count()
    plan = _plan(agg)
    assert "SinglePartition" not in plan


def test_rare_class_filter_is_a_semi_join(spark):
    from netprism.operators.clean import drop_rare_classes
    from netprism.sources.tables import table

    ev = table(spark, "/root/testdata/sf0.001", "events")
    plan = _plan(drop_rare_classes(ev, "user_id", 10))
    assert "LeftSemi" in plan


def test_entropy_is_pre_aggregated(spark):
    from netprism.operators.features import group_entropy
    from netprism.sources.tables import flows

    e = group_entropy(flows(spark, "/root/testdata/sf0.001"), "source_id", "destination_port")
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan or "HashAggregate" in plan
    assert "Window" not in plan


def test_top_k_per_class_limits_before_shuffle(spark):
    from netprism.operators.evaluate import per_class_sample
    from netprism.sources.tables import table

    ev = table(spark, "/root/testdata/sf0.001", "events")
    plan = _plan(per_class_sample(ev, "event_type", ["event_id"], 2, 5))
    assert "WindowGroupLimit" in plan


def test_mode_of_high_cardinality_column_is_distributed(spark):
    from netprism.operators.clean import modes

    df = spark.range(0, 2000).select((F.col("id") % 1500).cast("string").alias("c"))
    assert modes(df, ["c"], map_limit=10) == modes(df, ["c"]) == {"c": "0"}


def test_results_do_not_depend_on_partition_count(spark):
    from netprism.operators.encode import stratified_split
    from netprism.operators.windows import dense_row_id, group_row_number
    from netprism.sources.tables import flows

    f = flows(spark, "/root/testdata/sf0.001")
    a = dense_row_id(f, ["flow_id"], partitions=3).select("row_id", "flow_id", "ts", "total_fwd_packets")
    b = dense_row_id(f, ["flow_id"], partitions=11).select("row_id", "flow_id", "ts", "total_fwd_packets")
    assert sorted(a.collect()) == sorted(b.collect())
    a = group_row_number(f, ["label"], ["flow_id"], partitions=2).select("rank_in_group", "flow_id", "ts", "label")
    b = group_row_number(f, ["label"], ["flow_id"], partitions=9).select("rank_in_group", "flow_id", "ts", "label")
    assert sorted(a.collect()) == sorted(b.collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        s1 = sorted(stratified_split(f, "label", ["flow_id", "ts"]).select("flow_id", "ts", "split").collect())
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        s2 = sorted(stratified_split(f, "label", ["flow_id", "ts"]).select("flow_id", "ts", "split").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert s1 == s2
