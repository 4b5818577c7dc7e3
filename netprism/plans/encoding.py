"""Queries: encoding, scaling, PCA and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import r6
from ..operators import encode as enc
from ..operators import pca, smote
from ..sources.tables import FLOWS_SQL, flows, table
from .catalog import query, with_ctes


@query("E01_numeric_strings", "SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS ln,"
       " l_returnflag AS flag FROM lineitem")
def e01(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("string").alias("ln"), F.col("l_returnflag").alias("flag"))
    out, _ = enc.numeric_strings(li, ["ln", "flag"])
    return out


@query("E02_label_encoding", with_ctes(
    "SELECT flow_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM flows",
    FLOWS_SQL))
def e02(spark, sf):
    return enc.label_codes(flows(spark, sf).select("flow_id", "label"), "label")


@query("E03_feature_vector", with_ctes(
    "SELECT flow_id, [CAST(total_fwd_packets AS DOUBLE), CAST(total_backward_packets AS DOUBLE),"
    " flow_iat_mean, coalesce(flow_duration, 'NaN'::DOUBLE)] AS features FROM flows", FLOWS_SQL))
def e03(spark, sf):
    from pyspark.ml.functions import vector_to_array

    cols = ["total_fwd_packets", "total_backward_packets", "flow_iat_mean", "flow_duration"]
    v = enc.assemble(flows(spark, sf), cols)
    return v.select("flow_id", vector_to_array("features").alias("features"))


_SCALE_SQL = ("SELECT flow_id, round(coalesce((total_fwd_packets - avg(total_fwd_packets) OVER ())"
              " / nullif(stddev_pop(total_fwd_packets) OVER (), 0), 0), 6) AS fwd_scaled,"
              " round(coalesce((flow_iat_mean - avg(flow_iat_mean) OVER ())"
              " / nullif(stddev_pop(flow_iat_mean) OVER (), 0), 0), 6) AS iat_scaled FROM flows")


@query("E04_standard_scaling", with_ctes(_SCALE_SQL, FLOWS_SQL))
def e04(spark, sf):
    s, _ = enc.standard_scale(flows(spark, sf), ["total_fwd_packets", "flow_iat_mean"])
    return s.select("flow_id", r6("total_fwd_packets").alias("fwd_scaled"),
                    r6("flow_iat_mean").alias("iat_scaled"))


@query("E05_pca_explained_variance")
def e05(spark, sf):
    from pyspark.ml.functions import array_to_vector

    emb = table(spark, sf, "embeddings").select(
        array_to_vector(F.col("embedding")).alias("v"))
    _, _, tbl = enc.pca_explained(emb, vector="v", threshold=0.95)
    return tbl.select("component", r6("explained_variance").alias("explained_variance"),
                      r6("cumulative").alias("cumulative"), "kept")


@query("E05_pca_axes", "SELECT CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, round(corr(a.x, b.x), 6) + 0.0 AS correlation FROM ("
       " SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) a JOIN ("
       " SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) b"
       " ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def e05_axes(spark, sf):
    """The axes and variances of all components put together again: sum of variance * axis * axis' is the
    correlation matrix of the vectors, which SQL computes from the rows."""
    parts = pca.axes(table(spark, sf, "embeddings"), vector="embedding")
    left = parts.select("component", "variance", F.posexplode("axis").alias("i", "a"))
    right = parts.select("component", F.posexplode("axis").alias("j", "b"))
    both = left.join(right, "component").where("i <= j")
    return both.groupBy("i", "j").agg((r6(F.sum(F.col("variance") * F.col("a") * F.col("b"))) + 0.0).alias("correlation"))


@query("E05_pca_invariants", "SELECT CAST(max(len(embedding)) AS INTEGER) AS n_components, max(len(embedding))::DOUBLE AS total_variance,"
       " 0 AS n_not_orthonormal, 0 AS n_wrong_cut, 1.0::DOUBLE AS last_cumulative FROM embeddings")
def e05_invariants(spark, sf):
    """Components, their variances together (one for each standardised column), pairs of axes that are not
    orthonormal, components on the wrong side of the 95 % cut, the last cumulative share."""
    parts = pca.axes(table(spark, sf, "embeddings"), vector="embedding", threshold=0.95)
    other = parts.select(F.col("component").alias("c2"), F.col("axis").alias("axis2"))
    dot = F.aggregate(F.zip_with("axis", "axis2", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    pairs = parts.join(other, F.col("component") <= F.col("c2")).select(
        (F.abs(dot - (F.col("component") == F.col("c2")).cast("double")) > 1e-9).alias("off"))
    off = pairs.agg(F.count_if("off").cast("int").alias("n_not_orthonormal"))
    wrong = F.col("kept") != (F.round(F.col("cumulative") - F.col("share"), 12) <= 0.95)
    whole = parts.agg(F.count(F.lit(1)).cast("int").alias("n_components"), r6(F.sum("variance")).alias("total_variance"),
                      F.count_if(wrong).cast("int").alias("n_wrong_cut"), r6(F.max("cumulative")).alias("last_cumulative"))
    rows = whole.unionByName(off, allowMissingColumns=True)  # two rows, each with the columns the other lacks
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


_E06_ORDER = ", ".join(f"{c} NULLS FIRST" for c in (
    "flow_id", "ts", "source_id", "destination_port", "flow_duration", "total_fwd_packets",
    "total_backward_packets", "total_length_of_fwd_packets", "total_length_of_bwd_packets",
    "flow_iat_mean", "flow_iat_std", "packet_length_mean", "packet_length_std", "syn_flag_count",
    "ack_flag_count", "fin_flag_count", "protocol"))


@query("E06_stratified_split_by_id", with_ctes(
    "SELECT flow_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY " + _E06_ORDER + ")"
    " - 1 < round(count(*) OVER (PARTITION BY label) * 0.2) THEN 'test' ELSE 'train' END AS split"
    " FROM flows", FLOWS_SQL))
def e06(spark, sf):
    df = flows(spark, sf)
    s = enc.stratified_split(df, "label", ["flow_id", "ts"], 0.2, order="id")
    return s.select("flow_id", "label", "split")


@query("E06_stratified_split_hash")
def e06h(spark, sf):
    s = enc.stratified_split(flows(spark, sf), "label", ["flow_id", "ts"], 0.2, seed=42)
    return s.select("flow_id", "label", "split")


@query("E07_split_statistics", with_ctes(
    "SELECT split, label, n, split_rows, round(n * 1.0 / split_rows, 6) AS share FROM ("
    " SELECT split, label, n, CAST(sum(n) OVER (PARTITION BY split) AS BIGINT) AS split_rows FROM ("
    "  SELECT CASE WHEN r < round(nc * 0.2) THEN 'test' ELSE 'train' END AS split, label, count(*) AS n"
    "  FROM (SELECT label, row_number() OVER (PARTITION BY label) - 1 AS r,"
    "        count(*) OVER (PARTITION BY label) AS nc FROM flows) GROUP BY ALL))", FLOWS_SQL))
def e07(spark, sf):
    s = enc.stratified_split(flows(spark, sf), "label", ["flow_id", "ts"], 0.2, seed=42)
    st = enc.split_statistics(s, "label")
    return st.select("split", "label", "n", "split_rows", r6("share").alias("share"))


@query("E08_temporal_split", "SELECT split, count(*) AS n, min(event_id) AS first_event,"
       " max(event_id) AS last_event FROM (SELECT event_id, CASE"
       " WHEN row_number() OVER (ORDER BY ts, event_id) - 1 < floor(0.7 * (SELECT count(*) FROM events))"
       " THEN 'train' WHEN row_number() OVER (ORDER BY ts, event_id) - 1 <"
       " floor(0.85 * (SELECT count(*) FROM events)) THEN 'validation' ELSE 'test' END AS split FROM events)"
       " GROUP BY split")
def e08(spark, sf):
    ev = table(spark, sf, "events")
    s = enc.temporal_split(ev, ["ts", "event_id"])
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"),
                                  F.max("event_id").alias("last_event"))


@query("E08_stratified_70_15_15", "SELECT event_type, split, count(*) AS n FROM ("
       " SELECT event_type, CASE WHEN r < round(nc * 0.7) THEN 'train' WHEN r < round(nc * 0.85)"
       " THEN 'validation' ELSE 'test' END AS split FROM (SELECT event_type,"
       " row_number() OVER (PARTITION BY event_type) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS nc"
       " FROM events)) GROUP BY ALL")
def e08b(spark, sf):
    ev = table(spark, sf, "events")
    s = enc.random_split_3(ev, ["event_id"], "event_type")
    return s.groupBy("event_type", "split").agg(F.count(F.lit(1)).alias("n"))


@query("E09_class_weights", "SELECT event_type, count(*) AS n_c, round(sum(count(*)) OVER () * 1.0 /"
       " (count(*) OVER () * count(*)), 6) AS weight FROM events GROUP BY event_type")
def e09(spark, sf):
    w = enc.class_weights(table(spark, sf, "events"), "event_type")
    return w.select("event_type", "n_c", r6("weight").alias("weight"))


@query("E09_minority_oversampling")
def e09b(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice",
                                             "l_discount", "l_returnflag")
    return enc.oversample_minority(li, "l_returnflag", "A", ["l_quantity", "l_extendedprice",
                                                             "l_discount"], "l_orderkey")


@query("E09_oversampling_invariants", "SELECT count(*) AS n_synthetic, 0 AS n_outside, 0 AS n_other_class FROM lineitem"
       " WHERE l_returnflag = 'A'")
def e09_invariants(spark, sf):
    """Rows made along the projection: one for each row of the class, none outside the class's range of any feature."""
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = table(spark, sf, "lineitem").select("l_orderkey", *features, "l_returnflag")
    made = enc.oversample_minority(li, "l_returnflag", "A", features, "l_orderkey")
    ends = li.where("l_returnflag = 'A'").agg(*[F.min(c).alias(f"lo_{c}") for c in features],
                                              *[F.max(c).alias(f"hi_{c}") for c in features]).first()
    inside = F.lit(True)
    for c in features:
        inside = inside & F.col(c).between(ends[f"lo_{c}"] - 1e-6, ends[f"hi_{c}"] + 1e-6)
    return made.agg(F.count(F.lit(1)).alias("n_synthetic"), F.count_if(~inside).cast("int").alias("n_outside"),
                    F.count_if(F.col("l_returnflag") != "A").cast("int").alias("n_other_class"))


@query("E09_smote_neighbours", "SELECT count(*) AS n_synthetic, 0 AS n_off_segment, 5 AS fewest_neighbours FROM lineitem"
       " WHERE l_returnflag = 'A'")
def e09c(spark, sf):
    """One synthetic row for each row of the class, in all numeric columns but the keys: rows that do not lie
    between their base and one of its neighbours, and the fewest neighbours of a row."""
    cols = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = table(spark, sf, "lineitem")
    li = li.withColumn("l_linenumber", F.col("l_linenumber").cast("double"))
    made = smote.smote(li, "l_returnflag", "A", cols, "l_orderkey", k=5, with_segment=True)
    off = [~F.col(c).between(F.least(F.col("__x")[i], F.col("__other")[i]) - 1e-6,
                             F.greatest(F.col("__x")[i], F.col("__other")[i]) + 1e-6) for i, c in enumerate(cols)]
    any_off = off[0]
    for o in off[1:]:
        any_off = any_off | o
    return made.agg(F.count(F.lit(1)).alias("n_synthetic"), F.count_if(any_off).cast("int").alias("n_off_segment"),
                    F.min("__near").alias("fewest_neighbours"))


_Q = "quantile_cont({c}, {q})"


@query("E10_robust_and_minmax", with_ctes(
    "SELECT flow_id, round((flow_iat_mean - (SELECT quantile_cont(flow_iat_mean, 0.5) FROM flows))"
    " / ((SELECT quantile_cont(flow_iat_mean, 0.75) FROM flows) - (SELECT quantile_cont(flow_iat_mean, 0.25)"
    " FROM flows)), 6) AS iat_robust, round((total_fwd_packets - (SELECT min(total_fwd_packets) FROM flows))"
    " * 1.0 / ((SELECT max(total_fwd_packets) FROM flows) - (SELECT min(total_fwd_packets) FROM flows)), 6)"
    " AS fwd_minmax FROM flows", FLOWS_SQL))
def e10(spark, sf):
    df = flows(spark, sf)
    df, _ = enc.robust_scale(df, ["flow_iat_mean"])
    df, _ = enc.min_max_scale(df, ["total_fwd_packets"])
    return df.select("flow_id", r6("flow_iat_mean").alias("iat_robust"),
                     r6("total_fwd_packets").alias("fwd_minmax"))
