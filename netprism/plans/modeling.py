"""Queries: models (M01-M08) and the model bundle round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import r6
from ..operators import clean, deep_forest, encode, models
from ..operators import windows as win
from ..session import scratch_path
from ..sources.tables import flows, table
from .catalog import query

DOC_FEATURES = ["n_chars", "n_words", "n_lines", "digit_share", "upper_share", "lang", "source"]


def doc_features(d):
    """Per-document features (batch or streaming frame)."""
    t = F.col("text")
    n = F.greatest(F.length(t), F.lit(1))
    return d.select(
        "doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(t, r"\s+")).cast("double").alias("n_words"),
        F.size(F.split(t, "\n")).cast("double").alias("n_lines"),
        (F.regexp_count(t, F.lit("[0-9]")) / n).alias("digit_share"),
        (F.regexp_count(t, F.lit("[A-Z]")) / n).alias("upper_share"))


def doc_training_set(spark, sf):
    """documents joined with labels (partial cover): the supervised set."""
    feats = doc_features(table(spark, sf, "documents"))
    lab = table(spark, sf, "labels")
    j = feats.join(lab, "doc_id", "inner").withColumn("label", F.col("quality").cast("string"))
    return encode.stratified_split(j, "label", ["doc_id"], 0.2, seed=42)


def _fit(spark, sf, min_instances=2):
    # read by the training passes and the scoring: seven columns of every labelled document, written once
    data = doc_training_set(spark, sf).checkpoint(eager=True)
    forest = models.fit_forest(data.where(F.col("split") == "train"), DOC_FEATURES, "label", ["doc_id"],
                               categorical=["lang", "source"], num_trees=100, max_depth=30, min_instances=min_instances)
    return forest, data


@query("M01_random_forest")
def m01(spark, sf):
    forest, data = _fit(spark, sf)
    p = forest.predict(data.where(F.col("split") == "test"))
    return p.select("doc_id", "label", "prediction", r6("confidence").alias("confidence"))


@query("M02_random_forest_defaults")
def m02(spark, sf):
    forest, data = _fit(spark, sf, min_instances=1)
    return forest.predict(data).select("doc_id", "split", "label", "prediction")


@query("M03_class_probabilities")
def m03(spark, sf):
    forest, data = _fit(spark, sf)
    return forest.predict(data.where(F.col("split") == "test")).select("doc_id", "probability", "confidence")


@query("M02_m03_forest_invariants", "SELECT count(*) AS n_rows, CAST(2 AS BIGINT) AS n_splits, 0 AS n_bad_probabilities,"
       " 0 AS n_bad_confidence, 0 AS n_unknown_class FROM documents JOIN labels USING (doc_id)")
def m02_m03_invariants(spark, sf):
    """The forest with default leaf and split sizes on every labelled document: rows whose probabilities do not sum
    to 1, whose confidence is not the largest of them, whose class is none of the table's."""
    forest, data = _fit(spark, sf, min_instances=1)
    p = forest.predict(data)
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    classes = [r[0] for r in data.select("label").distinct().limit(100).collect()]  # two values of quality
    return p.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("split").alias("n_splits"),
                 F.count_if(F.abs(total - 1) > 1e-9).cast("int").alias("n_bad_probabilities"),
                 F.count_if(F.abs(F.array_max("probability") - F.col("confidence")) > 1e-12).cast("int").alias("n_bad_confidence"),
                 F.count_if(~F.col("prediction").isin(classes)).cast("int").alias("n_unknown_class"))


@query("M04_feature_importance")
def m04(spark, sf):
    named = F.when(F.col("feature").isin("lang", "source"), F.concat("feature", F.lit("__idx"))).otherwise(F.col("feature"))
    return _fit(spark, sf)[0].importances().select(named.alias("feature"), "importance").limit(10)


def wids_matrix(spark, sf):
    """Anomaly-module features: positional groups of 100 flows, the eight group
    features, +-inf -> median, standard scaling (population std)."""
    g = win.positional_groups(flows(spark, sf), ["flow_id"], 100)
    # group means are floating-point sums after a shuffle; the table is read by
    # the median, scaling, sampling and scoring passes: write it once
    f = win.wids_features(g).checkpoint(eager=True)
    cols = list(win.WIDS_FEATURES)
    f, _ = clean.replace_infinite_then_median(f, cols)
    f, _ = encode.standard_scale(f, cols)
    return f.select("row_id", "flow_id", *cols), cols


@query("M05_isolation_forest")
def m05(spark, sf):
    x, cols = wids_matrix(spark, sf)
    forest = models.fit_isolation_forest(x, cols, n_trees=200, sample_size=256, seed=42)
    # scores are read by the quantile passes and the result: written once
    scored = models.score_isolation_forest(x, forest).checkpoint(eager=True)
    flagged, _ = models.flag_by_contamination(scored, "score", 0.05)
    return flagged.select("row_id", "flow_id", r6("score").alias("score"), "anomaly", "is_anomaly")


@query("M05_anomaly_invariants", "SELECT count(*) AS n_rows, true AS share_holds, 0 AS n_bad_scores, true AS in_order"
       " FROM lineitem")
def m05_invariants(spark, sf):
    """The isolation forest on all flows: rows scored, whether at most 5 % and (but for equal scores) as many are
    flagged, scores outside (0, 1), whether every flagged row scores above every other."""
    x, cols = wids_matrix(spark, sf)
    forest = models.fit_isolation_forest(x, cols, n_trees=200, sample_size=256, seed=42)
    scored = models.score_isolation_forest(x, forest).checkpoint(eager=True)
    flagged, threshold = models.flag_by_contamination(scored, "score", 0.05)
    n, hit, reach = F.count(F.lit(1)), F.sum("is_anomaly"), F.count_if(F.col("score") >= F.lit(threshold) - 1e-12)
    return flagged.agg(n.alias("n_rows"), ((hit <= F.ceil(n * 0.05)) & (reach >= F.floor(n * 0.05))).alias("share_holds"),
                       F.count_if(~F.col("score").between(1e-9, 1 - 1e-9)).cast("int").alias("n_bad_scores"),
                       (F.max(F.when(F.col("is_anomaly") == 0, F.col("score")))
                        < F.min(F.when(F.col("is_anomaly") == 1, F.col("score")))).alias("in_order"))


@query("M06_contamination_threshold",
       "SELECT count(*) AS total, CAST(count_if(value / 100.0 > (SELECT quantile_cont(value / 100.0, 0.95)"
       " FROM events)) AS BIGINT) AS anomalies, round(count_if(value / 100.0 > (SELECT quantile_cont(value / 100.0, 0.95) FROM events))"
       " * 100.0 / count(*), 6) AS anomaly_pct FROM events")
def m06(spark, sf):
    e = table(spark, sf, "events").select((F.col("value") / 100.0).alias("score"))
    flagged, _ = models.flag_by_contamination(e, "score", 0.05)
    return flagged.agg(F.count(F.lit(1)).alias("total"), F.sum("is_anomaly").alias("anomalies"),
                       r6(F.avg("is_anomaly") * 100).alias("anomaly_pct"))


@query("M07_baselines", "SELECT round(max(n) * 1.0 / sum(n), 6) AS majority_accuracy,"
       " round(1.0 / count(*), 6) AS random_accuracy FROM (SELECT quality, count(*) AS n FROM labels"
       " GROUP BY quality)")
def m07(spark, sf):
    c = table(spark, sf, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(r6(F.max("n") / F.sum("n")).alias("majority_accuracy"),
                 r6(1.0 / F.count(F.lit(1))).alias("random_accuracy"))


def _cascade(spark, sf):
    from pyspark.ml.functions import vector_to_array

    e = table(spark, sf, "embeddings")
    arr = F.col("embedding")
    dims = e.select(F.max(F.size(arr))).first()[0] or 0
    feats = [f"e{i}" for i in range(dims)]
    df = e.select("vec_id", F.col("label").cast("string").alias("label"),
                  *[F.element_at(arr, i + 1).cast("double").alias(f"e{i}") for i in range(dims)])
    s = encode.stratified_split(df, "label", ["vec_id"], 0.2, seed=42)
    s = s.checkpoint(eager=True)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    return models.two_stage(train, test, feats, "label", "0", num_trees=30, id_cols=["vec_id"])


@query("M08_two_stage_cascade")
def m08(spark, sf):
    return _cascade(spark, sf).select("vec_id", "label", "final_prediction")


@query("M08_cascade_invariants", "SELECT CAST(sum(CAST(round(n * 0.2) AS BIGINT)) AS BIGINT) AS n_rows, 0 AS n_without_class,"
       " 0 AS n_unknown_class FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def m08_invariants(spark, sf):
    """The cascade on the test rows of every class: each has a prediction, and it is a class of the table."""
    out = _cascade(spark, sf).select("vec_id", "final_prediction")
    known = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("known")).distinct()
    j = out.join(known, out["final_prediction"] == known["known"], "left")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("final_prediction").isNull()).cast("int")
                 .alias("n_without_class"), F.count_if(F.col("final_prediction").isNotNull() & F.col("known").isNull())
                 .cast("int").alias("n_unknown_class"))


def flows_with_service(spark, sf):
    """Flows with a category of 90 values beside the protocol."""
    return flows(spark, sf).withColumn("service", F.concat(F.lit("svc"), F.col("destination_port") % 90))


@query("M01_flows_forest", "SELECT count(*) AS n_rows, true AS beats_majority, 0 AS n_bad_confidence FROM lineitem")
def m01_flows(spark, sf):
    """The classifier run on all flows (50 trees of depth 10): rows predicted,
    test accuracy above the majority class, confidences outside (0, 1]."""
    from .runs import classify_traffic

    keys = ["flow_id", "source_id", "ts"]
    out = classify_traffic(flows_with_service(spark, sf), "label", num_trees=50, max_depth=10, id_cols=keys)
    right = F.col("label") == F.col("prediction")
    per = out["predictions"].groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("n_test"),
        F.count_if((F.col("split") == "test") & right).alias("n_right"),
        F.count_if(~F.col("confidence").between(1e-12, 1.0 + 1e-9)).alias("bad"))
    return per.agg(F.sum("n").alias("n_rows"), (F.sum("n_right") / F.sum("n_test") > F.max("n") / F.sum("n")).alias(
        "beats_majority"), F.sum("bad").cast("int").alias("n_bad_confidence"))


FLOW_FEATURES = ["source_id", "destination_port", "flow_duration", "total_fwd_packets", "total_backward_packets",
                 "total_length_of_fwd_packets", "total_length_of_bwd_packets", "flow_iat_mean", "flow_iat_std",
                 "packet_length_mean", "packet_length_std", "syn_flag_count", "ack_flag_count", "fin_flag_count"]


def _deep_run(spark, sf):
    """Flows split 80/20, and the forest of the training rows: 100 trees, any depth, splits from 5 rows on."""
    data = encode.stratified_split(flows(spark, sf), "label", ["flow_id", "ts"], 0.2, seed=42).checkpoint(eager=True)
    forest = deep_forest.fit(data.where(F.col("split") == "train"), FLOW_FEATURES, "label", ["flow_id", "source_id", "ts"],
                             n_trees=100, min_split=5, min_leaf=2, seed=42)
    return data, forest


@query("M01_deep_forest", "SELECT count(*) AS n_rows, true AS far_above_majority, 0 AS n_bad_probabilities, 100 AS n_trees"
       " FROM lineitem")
def m01_deep(spark, sf):
    """The forest of unlimited depth on all flows: rows predicted, test accuracy 0.3 above the share of the largest
    class, rows whose probabilities do not sum to 1 or whose confidence is not the largest, trees written."""
    data, forest = _deep_run(spark, sf)
    p = forest.predict(data)
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    sound = (F.abs(total - 1) < 1e-9) & (F.abs(F.array_max("probability") - F.col("confidence")) < 1e-12)
    test = F.col("split") == "test"
    per = p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(test).alias("n_test"),
                                 F.count_if(test & (F.col("label") == F.col("prediction"))).alias("n_right"),
                                 F.count_if(~sound).alias("bad"))
    trees = forest.shape().count()
    return per.agg(F.sum("n").alias("n_rows"),
                   (F.sum("n_right") / F.sum("n_test") > F.max("n") / F.sum("n") + 0.3).alias("far_above_majority"),
                   F.sum("bad").cast("int").alias("n_bad_probabilities")).withColumn("n_trees", F.lit(trees))


@query("M04_deep_importance", "SELECT 14 AS n_features, CAST(1 AS DOUBLE) AS total, true AS flags_first")
def m04_deep(spark, sf):
    """Shares of the fall of impurity: one for each feature, together 1; two flags decide the label."""
    _, forest = _deep_run(spark, sf)
    first = F.max_by("feature", "importance").isin("syn_flag_count", "fin_flag_count")
    return forest.importances().agg(F.count(F.lit(1)).cast("int").alias("n_features"), r6(F.sum("importance")).alias("total"),
                                    first.alias("flags_first"))


@query("S07_score_new_rows", "SELECT count(*) AS n_rows, 0 AS n_different FROM lineitem")
def s07_score_new(spark, sf):
    """A saved anomaly run scores the flows again: the same scores and flags."""
    from .runs import detect_web_anomalies, score_web_anomalies

    path = scratch_path(spark, "anomaly-bundle")
    df = flows(spark, sf)
    # the flows' other columns are read by no step
    fitted = detect_web_anomalies(df, ["flow_id"], model_path=path, keep=[])["scored"].select(
        "row_id", "is_anomaly", F.col("score").alias("fitted_score"))
    again = score_web_anomalies(df, ["flow_id"], path, keep=[]).select("row_id", F.col("is_anomaly").alias("again"), "score")
    same = (F.abs(F.col("score") - F.col("fitted_score")) < 1e-9) & (F.col("again") == F.col("is_anomaly"))
    return fitted.join(again, "row_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                            F.count_if(~same).cast("int").alias("n_different"))


@query("S07_cleaning_bundle", "SELECT count(*) AS n_rows, 0 AS n_different FROM (SELECT DISTINCT * FROM lineitem)")
def s07_cleaning(spark, sf):
    """A cleaning state saved and loaded again cleans the flows to the same rows."""
    df = flows(spark, sf)
    path = scratch_path(spark, "cleaning-bundle")
    model = clean.fit_cleaning(df)
    model.save(spark, path)
    cleaned = [m.transform(df).select(F.xxhash64("*").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias(f"n{i}"))
               for i, m in enumerate((model, clean.CleaningModel.load(spark, path)))]
    n0, n1 = F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0))
    return cleaned[0].join(cleaned[1], "h", "full").agg(
        F.sum(n1).alias("n_rows"), F.sum(F.abs(n0 - n1)).cast("int").alias("n_different"))


@query("S07_model_bundle_roundtrip",
       "SELECT doc_id, true AS same_prediction FROM documents JOIN labels USING (doc_id)")
def s07(spark, sf):
    forest, data = _fit(spark, sf)
    path = scratch_path(spark, "rf-bundle")
    forest.save(path)
    again = deep_forest.DeepForest(spark, path)
    a = forest.predict(data).select("doc_id", F.col("prediction").alias("p1"))
    b = again.predict(data).select("doc_id", F.col("prediction").alias("p2"))
    return a.join(b, "doc_id").select("doc_id", (F.col("p1") == F.col("p2")).alias("same_prediction"))
