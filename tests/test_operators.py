import pytest
from pyspark.sql import functions as F

from postlens.functions import vectors as vx
from postlens.operators import contracts, embedding, filters, history, targets
from postlens.operators.clustering import cluster_sweep, purity
from postlens.plans.ablation import contributions
from postlens.plans.report import diagnose, diagnose_saved, grade_metrics, recommend, save_report
from postlens.functions.literals import literal_rows


def test_click_rate_cases(spark):
    df = spark.createDataFrame([(0, 5), (None, 5), (10, None), (10, 20)], "imp_num long, click_num long")
    assert [r["ctr"] for r in targets.add_targets(df).collect()] == [0.0, 0.0, None, 2.0]
    kept = targets.add_targets(df.withColumn("ctr", F.lit(9.0)))
    assert {r["ctr"] for r in kept.collect()} == {9.0}


def test_targets_follow_the_columns(spark):
    df = spark.createDataFrame([(10, 4)], "imp_num long, like_num long")
    out = targets.add_targets(df)
    assert "fav_rate" not in out.columns and "ctr" not in out.columns
    row = out.head()
    assert row["ces_rate"] == row["interaction_rate"] == row["like_rate"] == 0.4
    assert targets.add_targets(spark.createDataFrame([(1,)], "x int")).columns == ["x"]
    with pytest.raises(ValueError):
        targets.add_targets(df, denominator="views")


def test_no_label_is_an_error(spark):
    with pytest.raises(ValueError):
        targets.derive_ctr(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(ValueError):
        targets.task_columns(["ctr", "unknown"])


def test_impression_log_bounds(spark):
    df = spark.createDataFrame([(0,), (1,), (10**9,), (None,)], "imp_num long")
    logs = [r["impression_log"] for r in targets.add_targets(df).collect()]
    assert logs[0] == logs[1] == 0.0 and logs[2] == pytest.approx(16.11809565) and logs[3] is None


def test_quality_filter(spark):
    rows = [("a", 10, 1), ("", 10, 1), (None, 10, 1), ("b", -1, 0), ("c", 5, 6), ("d", None, 1), ("e", 5, -1)]
    df = spark.createDataFrame(rows, "note_id string, imp_num long, click_num long")
    assert [r["note_id"] for r in filters.quality_filter(df).collect()] == ["a"]
    assert filters.min_impressions(df, 0).count() == 7 and filters.min_impressions(df, 6).count() == 3
    assert filters.min_impressions_any(df.withColumnRenamed("imp_num", "impression"), 6).count() == 3


def test_zero_vectors(spark):
    df = spark.createDataFrame(
        [([0.0, 0.0],), ([0.0, None],), ([1.0, 0.0],), (None,), ([],)], "v array<double>")
    assert [r[0] for r in df.select(vx.any_nonzero(F.col("v"))).collect()] == [False, True, True, False, False]
    norms = [r[0] for r in df.where("v is not null and size(v) = 2 and v[1] is not null").select(
        vx.l2_norm(vx.l2_normalise(F.col("v")))).collect()]
    assert norms == [0.0, 1.0]
    assert df.select(vx.cosine(F.col("v"), F.col("v")).alias("c")).where("c is not null").count() == 1


def test_pool_of_arrays(spark):
    df = spark.createDataFrame([([[1.0, 2.0], None, [3.0, -4.0]],), ([],), (None,)], "vs array<array<double>>")
    mean = [r[0] for r in df.select(vx.pool(F.col("vs"), 2)).collect()]
    top = [r[0] for r in df.select(vx.pool(F.col("vs"), 2, "max")).collect()]
    assert mean == [[2.0, -1.0], [0.0, 0.0], [0.0, 0.0]] and top[0] == [3.0, 2.0]


def test_funnel_counts_null_as_dropped(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    rows = filters.funnel(df, [("positive", F.col("x") > 0), ("large", F.col("x") > 2)]).collect()
    assert [(r["rows_in"], r["dropped"], r["rows_out"]) for r in rows] == [(3, 1, 2), (2, 1, 1)]


def test_names_and_roles():
    assert contracts.vector_names("cover_image", 3) == ["cover_image_feat_0", "cover_image_feat_1", "cover_image_feat_2"]
    assert contracts.vector_kind("title_feat_0") == "title" and contracts.vector_kind("x") is None
    assert contracts.check_names(["cover_image_embedding_1", "title_feat_0"]) == {
        "deprecated": ["cover_image_embedding_1"], "unknown": []}
    with pytest.raises(ValueError):
        contracts.vector_names("sound", 2)
    columns = ["note_id", "ctr", "type", "intention_lv2is_mcn", "taxonomy1", "title_length", "title_feat_0", "other"]
    roles = contracts.multi_task_roles(columns)
    assert roles.sparse == ["note_type", "intention_lv2", "taxonomy1"] and roles.dense == ["title_length"]
    assert roles.vectors == ["title_feat_0"]
    assert contracts.single_task_roles(["type", "nickname", "click_num", "text_feat_1"]).sparse == ["item_type", "nickname"]


def test_role_renames_are_real(spark):
    df = spark.createDataFrame([("a", "b")], "type string, intention_lv2is_mcn string")
    assert contracts.multi_task_roles(df.columns).apply(df).columns == ["note_type", "intention_lv2"]


def test_presets():
    assert contracts.preset("nonsense") == contracts.preset("default")
    merged = contracts.merge_presets(contracts.preset("basic"), {"sparse": ["type", "new"], "clip_text": True})
    assert merged["sparse"][-1] == "new" and merged["sparse"].count("type") == 1 and merged["clip_text"]
    found = contracts.detect_preset(["nickname", "tag_count", "image_feat_0"])
    assert found == {"sparse": ["nickname"], "dense": ["tag_count"], "clip_image": True, "clip_text": False}
    roles = contracts.preset_roles(["nickname", "image_feat_0", "text_feat_0"], contracts.preset("no_text"))
    assert roles.sparse == ["nickname"] and roles.vectors == ["image_feat_0"]
    assert contracts.preset_names() == ["basic", "clip_only", "no_image", "no_text", "default", "all", "custom"]


def test_contribution_arithmetic(spark):
    sets = literal_rows(
        spark, [("baseline_all", 0.0793), ("no_image", 0.0808), ("no_text", 0.0858), ("only_clip", 0.0257), ("no_clip", 0.0932)],
        "feature_set string, r2 double")
    rows = {r["feature_group"]: r for r in contributions(sets).collect()}
    assert rows["image_features"]["r2_contribution"] == pytest.approx(-0.0015)
    assert rows["text_features"]["r2_contribution"] == pytest.approx(-0.0065)
    assert rows["image_features"]["advice"] == "remove" and not rows["image_features"]["is_significant"]


def test_rules_over_a_saved_report(spark, tmp_path):
    rows = [("understanding", "silhouette", "image", 0.597), ("understanding", "cohens_d", None, 0.1638),
            ("quality", "pca_reduction", "image", 0.42), ("task", "auc", None, 0.625), ("quality", "zero_variance_pct", "text", 0.0)]
    report = literal_rows(spark, rows, "layer string, metric string, feature_group string, value double")
    assert {r["rule"] for r in diagnose(report).collect()} == {"clusters_mediocre", "alignment_weak", "compressible", "prediction_weak"}
    assert {r["recommendation"] for r in recommend(report).collect()} == {"tune_alignment"}
    grades = {r["metric"]: r["grade"] for r in grade_metrics(report).collect()}
    assert grades == {"silhouette": "good", "pca_reduction": "warning", "auc": "warning", "zero_variance_pct": "good"}
    save_report(report, str(tmp_path / "r"))
    assert diagnose_saved(spark, str(tmp_path / "r")).count() == 4


def test_ranking_by_absolute_value(spark):
    df = spark.createDataFrame(
        [("a", 0.2, 0.1, -0.9, 3.0), ("b", 0.1, 0.2, 0.5, 2.0)], "model string, mse double, r2 double, spearman double, seconds double")
    win = {r["criterion"]: r["model"] for r in history.model_ranking(df).collect()}
    assert win == {"best_fit": "b", "best_r2": "b", "best_ranking": "a", "fastest": "b"}
    win = {r["criterion"]: r["model"] for r in history.model_ranking(df, by_abs=False).collect()}
    assert win["best_ranking"] == "b"


def test_trend_blocks_do_not_show(spark):
    df = spark.createDataFrame([(1, i, float((i * 7) % 11 + i)) for i in range(1, 61)], "run_id int, batch int, seconds double")
    whole = history.throughput_trend(df).orderBy("batch").collect()
    cut = history.throughput_trend(df, block=12).orderBy("batch").collect()
    assert whole == cut and len(cut) == 60


def test_purity_with_nulls(spark):
    df = spark.createDataFrame([(0, "a"), (0, "a"), (0, None), (0, "b"), (1, "b")], "cluster int, taxonomy1 string")
    assert purity(df, ["taxonomy1", "taxonomy2"]).head()["purity"] == pytest.approx((0.5 + 1.0) / 2)


def test_sweep_finds_planted_clusters(spark):
    rows = [(str(i), [float(i % 3) * 10 + (i % 7) * 0.01, float(i % 3) * -5 + (i % 5) * 0.01]) for i in range(150)]
    table, best = cluster_sweep(spark.createDataFrame(rows, "note_id string, v array<double>"), "note_id", "v", (2, 3, 20, 150))
    scores = {r["k"]: r["silhouette"] for r in table.collect()}
    assert set(scores) == {2, 3, 20} and max(scores, key=scores.get) == 3
    assert best.select("cluster").distinct().count() == 3 and best.columns == ["note_id", "v", "cluster"]
    few, some = cluster_sweep(spark.createDataFrame(rows[:20], "note_id string, v array<double>"), "note_id", "v")
    assert [r["k"] for r in few.collect()] == [10] and some.count() == 19  # the first vector is zero
    for none in (rows[:2], [("a", [0.0, 0.0])], []):
        table, best = cluster_sweep(spark.createDataFrame(none, "note_id string, v array<double>"), "note_id", "v")
        assert table.count() == 0 and best is None


def test_pca_dims_on_known_spectrum(spark):
    rows = [(float(i % 5), 0.0, float((i * i) % 3) * 0.001) for i in range(60)]
    df = spark.createDataFrame([(list(r),) for r in rows], "v array<double>")
    line = embedding.pca_dims(embedding.explained_variance(df, "v")).head()
    assert line["dims_95"] == 1 and line["dims"] == 3
