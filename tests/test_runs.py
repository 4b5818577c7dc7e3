"""End-to-end runs on the driver tables (sf0.001) and the model invariants."""

from pyspark.sql import functions as F

from netprism.session import scratch_path


def test_preprocess_dataset(spark):
    from netprism.plans.runs import preprocess_dataset
    from netprism.sources.tables import flows

    out = preprocess_dataset(flows(spark, "/root/testdata/sf0.001"), "flows")
    sel = out["selected"]
    assert "Label" in sel.columns and "flow_id" not in sel.columns
    assert {r["Label"] for r in out["label_distribution"].collect()} == {"a", "n", "r"}
    assert sel.where(F.col("flow_duration").isNull()).count() == 0
    assert out["selection"].where("Status = 'Included'").count() > 0


def test_detect_web_anomalies_and_bundle(spark):
    from netprism.operators import models
    from netprism.plans.runs import detect_web_anomalies
    from netprism.sources.tables import flows

    path = scratch_path(spark, "iforest")
    out = detect_web_anomalies(flows(spark, "/root/testdata/sf0.001"), ["flow_id"], n_trees=50,
                               model_path=path)
    rep = out["report"].first()
    assert abs(rep["anomaly_pct"] - 5.0) < 0.5
    forest, meta = models.load_forest(spark, path)
    again = models.score_isolation_forest(out["features"], forest).select("row_id", F.col("score").alias("s2"))
    j = out["scored"].join(again, "row_id")
    assert j.where(F.abs(F.col("score") - F.col("s2")) > 1e-12).count() == 0


def test_cleaning_model_bundle(spark):
    from netprism.operators import clean
    from netprism.sources.tables import flows

    df = flows(spark, "/root/testdata/sf0.001")
    model = clean.fit_cleaning(df)
    path = scratch_path(spark, "cleaning")
    model.save(spark, path)
    assert clean.CleaningModel.load(spark, path) == model


def test_data_set_schemas(spark, tmp_path):
    from netprism.sources import files

    cic, unsw = files.cic_ids_schema(), files.unsw_nb15_schema()
    assert len(cic) == 79 and len(unsw) == 45
    path = tmp_path / "CIC-IDS-2017_monday.csv"
    path.write_text(",".join(" " + n for n in cic.names) + "\n" + ",".join(["1"] * 78 + ["BENIGN"]) + "\n"
                    + ",".join(["2"] * 14 + ["Infinity"] + ["2"] * 63 + ["DDoS"]) + "\n")
    got = files.read_dataset(spark, str(path))
    assert got.schema == cic
    assert [r["Label"] for r in got.collect()] == ["BENIGN", "DDoS"]
    assert got.where(F.col("Flow Bytes/s") == float("inf")).count() == 1
    short = tmp_path / "UNSW-NB15_part.csv"
    short.write_text("spkts,sbytes\n1,2\n")
    assert files.read_dataset(spark, str(short)).columns == ["spkts", "sbytes"]


def test_classify_traffic_invariants(spark):
    from pyspark.ml.functions import vector_to_array

    from netprism.plans.runs import classify_traffic
    from netprism.plans.modeling import doc_features
    from netprism.sources.tables import table

    d = doc_features(table(spark, "/root/testdata/sf0.01", "documents"))
    lab = table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", F.col("quality").alias("label"))
    df = d.join(lab, "doc_id")
    out = classify_traffic(df, "label", num_trees=30, id_cols=["doc_id"], normal=("1",))
    model = out["model"]
    imp = model.stages[-1].featureImportances.toArray()
    assert abs(imp.sum() - 1.0) < 1e-9
    probs = model.transform(df).select(F.aggregate(vector_to_array("probability"), F.lit(0.0),
                                                   lambda a, b: a + b).alias("p"))
    assert probs.where(F.abs(F.col("p") - 1.0) > 1e-9).count() == 0
    acc = {r["split"]: r["value"] for r in out["metrics"].where("metric = 'accuracy'").collect()}
    majority = df.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert acc["train"] >= majority
    per_class = out["predictions"].where("split = 'test'").groupBy("label").count().collect()
    assert out["samples"].count() == min(5, sum(min(2, r["count"]) for r in per_class))


def test_pca_keeps_95_percent(spark):
    from pyspark.ml.functions import array_to_vector

    from netprism.operators.encode import pca_explained
    from netprism.sources.tables import table

    emb = table(spark, "/root/testdata/sf0.001", "embeddings").select(array_to_vector("embedding").alias("v"))
    model, k, tbl = pca_explained(emb, vector="v", threshold=0.95)
    rows = tbl.orderBy(F.expr("int(substr(component, 3))")).collect()
    assert rows[k - 1]["cumulative"] > 0.95 and (k == 1 or rows[k - 2]["cumulative"] <= 0.95)
    import numpy as np

    pc = model.pc.toArray()
    assert np.allclose(pc.T @ pc, np.eye(pc.shape[1]), atol=1e-8)


def test_an_anomaly_run_scored_again_writes_few_bytes(spark):
    """Rows lay on disk with all columns, as they are in memory, five times."""
    import os

    from netprism.plans import modeling
    from netprism.session import scratch_path

    def size(folder):
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names)

    n, top = 20_000, scratch_path(spark, "tables")
    k = F.col("id")
    spark.range(n).select(
        k.alias("l_orderkey"), (k * 7919 % 2000).alias("l_partkey"), (k % 100).alias("l_suppkey"), (k % 7).cast("int").alias("l_linenumber"),
        (k % 50 + 1).cast("double").alias("l_quantity"), (F.rand(3) * 1e5).alias("l_extendedprice"), (k % 11 / 100).alias("l_discount"),
        (k % 9 / 100).alias("l_tax"), F.when(k % 3 == 0, "A").otherwise("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00'").alias("l_shipdate")).write.parquet(f"{top}/lineitem.parquet")
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = size(folder)
    assert tuple(modeling.s07_score_new(spark, top).first()) == (n, 0)
    assert size(folder) - before < 200 * n


def test_columns_kept_change_no_position_and_no_feature(spark):
    from netprism.plans.runs import detect_web_anomalies

    k = F.col("id")
    df = spark.range(1500).select(
        k.alias("flow_id"), (k % 9).alias("source_id"), (k * 31 % 97).alias("destination_port"), (k % 11).cast("double").alias("flow_duration"),
        (k % 50).alias("total_fwd_packets"), (k % 13).alias("total_backward_packets"), (k * 7.5 % 800).alias("total_length_of_fwd_packets"),
        F.when(k % 3 == 0, "A").otherwise("N").alias("label"))
    whole = detect_web_anomalies(df, ["flow_id"], n_trees=20)["scored"]
    few = detect_web_anomalies(df, ["flow_id"], n_trees=20, keep=["label"])["scored"]
    assert set(few.columns) < set(whole.columns) and "label" in few.columns and "source_id" in whole.columns
    features = ["unique_dst_ports", "mean_bytes_sent", "request_rate", "byte_ratio"]
    a, b = (sorted((r["row_id"], r["flow_id"], r["label"], *(round(r[c], 6) for c in features)) for r in x.collect())
            for x in (whole, few))
    assert len(a) == df.count() and a == b
