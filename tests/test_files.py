"""Readers, writers, audits, feature stages and incremental runs."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from postlens.operators.encoder_stage import EncoderSpec, encode_content, encode_image, encode_images, encode_text, hashing_encoder
from postlens.plans.feature_stage import feature_stage, incremental_stage, narrow, standard_modalities, widen
from postlens.plans.text_stage import text_stage_targets
from postlens.catalog import fixtures as fx
from postlens.operators.hashing import Hashing
from postlens.operators.sampling import sample_files
from postlens.sources import audit, images, readers, sinks
from postlens.streaming.incremental import progress, run_incremental


@pytest.fixture
def numbered(spark, tmp_path):
    base = tmp_path / "in"
    for i in range(4):
        spark.range(i * 10, i * 10 + 10 + i).toDF("id").coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        base.mkdir(exist_ok=True)
        part = next((tmp_path / f"w{i}").glob("part-*.parquet"))
        part.rename(base / f"part-{i:05d}-abc.snappy.parquet")
    return str(base)


def test_batch_range(spark, numbered):
    assert readers.read_batches(spark, numbered, 1, 2).count() == 11 + 12
    with pytest.raises(AnalysisException):
        readers.read_batches(spark, numbered, 7, 9)


def test_trees_samples_and_audits(spark, numbered):
    df = readers.read_tree(spark, numbered, columns=["id", "absent"])
    assert df.columns == ["id"] and df.count() == 46
    a, b = (readers.read_sampled(spark, numbered, 2).count() for _ in range(2))
    assert a == b < 46
    listed = readers.list_files(spark, numbered)
    assert listed.count() == 4 and listed.where("size_bytes > 0").count() == 4
    chosen = {r["path"] for r in sample_files(listed, 2).collect()}
    assert len(chosen) == 2 and chosen < {r["path"] for r in listed.collect()}
    plain = spark.read.parquet(numbered)
    plan = audit.batch_plan(audit.file_rows(plain), 5).orderBy("file").collect()
    assert [(r["rows"], r["batches"], r["first_batch"], r["last_batch"]) for r in plan] == [
        (10, 2, 0, 1), (11, 3, 2, 4), (12, 3, 5, 7), (13, 3, 8, 10)]
    check = audit.verify_output(plain).head()
    assert (check["rows"], check["columns"], check["files"]) == (46, 1, 4) and check["mb"] > 0
    total = audit.scan_directory(plain, {"ids": "id"}).where("file is null").head()
    assert total["rows"] == 46 and total["files"] == 4 and total["has_ids"]


def test_corrupt_files_are_skipped_on_request(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "d"))
    (tmp_path / "d" / "bad.parquet").write_bytes(b"PAR1 not parquet at all PAR1")
    assert readers.read_tree(spark, str(tmp_path / "d"), skip_corrupt=True).count() == 5


def test_missing_columns_become_null(spark):
    both = readers.union_all([spark.range(2).toDF("a"), spark.range(3).toDF("b")])
    assert both.columns == ["a", "b"] and both.where("a is null").count() == 3


def test_store_paths():
    for path in ("buck/key/x", "/key/x", "key/x", "oss://buck/key/x"):
        assert readers.store_uri(path, "buck") == "oss://buck/key/x"
    assert readers.split_uri("oss://buck/key/x") == ("buck", "key/x")
    assert readers.split_uri("key/x", "buck") == ("buck", "key/x")


def test_batches_and_latest_run(spark, tmp_path):
    out = str(tmp_path / "out")
    for day in (1, 2):
        sinks.save_batch(spark.range(day * 100).toDF("id"), out, 0, 50, datetime(2025, 1, day), files=3)
    assert readers.latest_run(spark, f"{out}/batch_00000_00050").count() == 200
    with pytest.raises(ValueError):
        readers.latest_run(spark, f"{out}/batch_00000_00050/dt=20250101_000000")


def test_output_per_source_and_statistics(spark, numbered, tmp_path):
    rows, watch = sinks.observed(sinks.with_source(spark.read.parquet(numbered)))
    sinks.save_per_source(rows, str(tmp_path / "o"))
    saved = spark.read.parquet(str(tmp_path / "o"))
    assert saved.select("source_file").distinct().count() == 4
    stats = sinks.run_statistics(watch, 2.0, audit.file_sizes(spark.read.parquet(numbered)), audit.file_sizes(saved))
    assert stats["rows"] == 46 and stats["rows_per_second"] == 23 and stats["files_in"] == 4 and stats["mb_out"] > 0


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder, n in (("a", 5), ("b", 7)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / "in" / folder))
        made = next((tmp_path / "in" / folder).glob("part-*.parquet"))
        made.rename(made.with_name("part-00000.parquet"))
    base = str(tmp_path / "in")
    df = spark.read.option("recursiveFileLookup", "true").parquet(base)
    want = {"a/part-00000.parquet": 5, "b/part-00000.parquet": 7}
    assert {r["file"]: r["rows"] for r in audit.file_rows(df, base).collect()} == want
    assert {r["file"]: r["rows"] for r in audit.scan_directory(df, {}, base).collect() if r["file"]} == want
    assert audit.file_rows(df).count() == 2
    sources = sinks.with_source(df, base).groupBy("source_file").count().collect()
    assert {r["source_file"]: r["count"] for r in sources} == {f"incremental_{k}": v for k, v in want.items()}


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", None), (1, "b", "c")], "position int, x string, y string")
    sinks.save_csv(df, str(tmp_path / "c"), "position")
    sinks.save_json(df, str(tmp_path / "j"))
    back = spark.read.option("header", True).csv(str(tmp_path / "c")).orderBy("position").collect()
    assert back[0]["y"] is None and back[1]["y"] == "c"
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_images_beside_posts(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for name in ("a.jpg", "b.jpg"):
        (tmp_path / "img" / name).write_bytes(name.encode())
    found = images.read_images(spark, str(tmp_path / "img"), "*.jpg")
    posts = spark.createDataFrame(
        [("1", "a.jpg", ["b.jpg", "x.jpg"]), ("2", "x.jpg", [])], "note_id string, cover_url string, inner_urls array<string>")
    out = images.attach_inner(images.attach_cover(posts, found), found)
    rows = {r["note_id"]: r for r in out.collect()}
    assert bytes(rows["1"]["cover_image"]) == b"a.jpg" and rows["2"]["cover_image"] is None
    assert [x and bytes(x) for x in rows["1"]["inner_images"]] == [b"b.jpg", None] and rows["2"]["inner_images"] == []
    spec = hashing_encoder(4)
    v = out.select("note_id", encode_image(F.col("cover_image"), spec).alias("c"), encode_images(F.col("inner_images"), spec).alias("i"))
    v = {r["note_id"]: r for r in v.collect()}
    assert sum(x * x for x in v["2"]["c"]) == pytest.approx(1, abs=1e-5) and v["2"]["i"] == [0.0] * 4


def test_encoders(spark):
    spec = hashing_encoder(6)
    long = "word " * 60
    df = spark.createDataFrame([("a", ""), (None, long), (" a ", "x")], "t string, c string")
    rows = df.select(encode_text(F.col("t"), spec).alias("t"), encode_content(F.col("c"), spec).alias("c")).collect()
    assert rows[0]["t"] == rows[2]["t"] != rows[1]["t"]
    assert rows[0]["c"] == [0.0] * 6 and sum(x * x for x in rows[1]["c"]) < 1


POSTS = "note_id string, title string, tag_info string, imp_num long"


def test_feature_stage_scatters_and_widens(spark):
    df = spark.createDataFrame([("1", "t", None, 6000), ("2", "t", None, 10), ("3", "t", None, None)], POSTS)
    spec = hashing_encoder(4)
    parts = standard_modalities(df.columns)
    assert [m.name for m in parts] == ["title", "tag"]
    out = {r["note_id"]: r for r in feature_stage(df, parts, spec).collect()}
    assert out["2"]["title_vec"] == out["3"]["title_vec"] == [0.0] * 4 and any(out["1"]["title_vec"])
    assert feature_stage(df, parts, spec, keep_filtered=False).count() == 1
    wide = widen(feature_stage(df, parts, spec), {"title": 4, "tag": 4})
    assert "title_feat_3" in wide.columns and "title_vec" not in wide.columns
    assert narrow(wide).where("note_id = '1'").head()["title_vec"] == out["1"]["title_vec"]


def test_only_missing_vectors_are_computed(spark):
    df = spark.createDataFrame([("1", "t", "[]", 5, 0.5)], POSTS + ", text_feat_0 float")
    out = incremental_stage(df, standard_modalities(df.columns), hashing_encoder(4))
    assert "title_feat_0" in out.columns and "title_vec" not in out.columns and "tag_vec" in out.columns


def test_stream_equals_batch(spark, numbered, tmp_path):
    spec = hashing_encoder(3)
    schema = spark.read.parquet(numbered).schema

    def transform(rows):
        return rows.select("id", encode_text(F.col("id").cast("string"), spec).alias("v"))

    src, out, cp = tmp_path / "src", str(tmp_path / "sink"), str(tmp_path / "cp")
    src.mkdir()
    files = sorted((tmp_path / "in").glob("*.parquet"))
    for f in files[:2]:
        f.rename(src / f.name)
    first = progress(run_incremental(spark, str(src), out, cp, schema, transform, files_per_batch=1))
    for f in files[2:]:
        f.rename(src / f.name)
    second = progress(run_incremental(spark, str(src), out, cp, schema, transform, files_per_batch=1))
    third = progress(run_incremental(spark, str(src), out, cp, schema, transform))
    assert first == {"batches": 2, "rows": 21} and second == {"batches": 2, "rows": 25} and third["rows"] == 0
    stream = sorted((r["id"], r["v"]) for r in spark.read.parquet(out).collect())
    batch = sorted((r["id"], r["v"]) for r in transform(spark.read.parquet(str(src))).collect())
    assert stream == batch and len(stream) == 46


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counter_filter_reaches_the_scan(spark, sf_dir, tmp_path):
    fx.note_stats(spark, sf_dir).write.parquet(str(tmp_path / "stats"))
    fx.note_info(spark, sf_dir).write.parquet(str(tmp_path / "info"))
    info, stats = spark.read.parquet(str(tmp_path / "info")), spark.read.parquet(str(tmp_path / "stats"))
    plan = plan_of(text_stage_targets(info, stats).select("note_id", "title", "ctr"))
    assert "GreaterThanOrEqual(imp_num,500)" in plan
    scan = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert not any("share_num" in line or "tag_info" in line for line in scan)


@pytest.mark.parametrize("name", ["spearman", "kendall_tau_b", "target_profile", "label_codes", "davies_bouldin", "alignment"])
def test_no_cross_joins_no_row_udfs_no_global_sorts(spark, sf_dir, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    plan = plan_of(df)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    assert not [line for line in plan.splitlines() if "Window [" in line and line.rstrip().endswith("], [], ")]


def test_hashing_is_the_same_in_the_jvm_and_by_arrow(spark):
    texts = ["", " ", "a", "ab", "naïve 🙂🙂 文字", "x" * 5000, "  two\nlines ", None]
    df = spark.createDataFrame([(i, t, None if t is None else t.encode(), [t, None, "z"]) for i, t in enumerate(texts)], "i int, t string, b binary, l array<string>")
    df = df.withColumn("images", F.transform("l", lambda x: F.encode(x, "UTF-8")))
    both = []
    for spec in (Hashing(16), hashing_encoder(16)):
        cells = [encode_text(F.col("t"), spec).alias("t"), encode_content(F.col("t"), spec).alias("c"), encode_image(F.col("b"), spec).alias("b"),
                 encode_images(F.col("images"), spec, "max").alias("x"), encode_images(F.col("images"), spec, kept=F.col("i") > 2).alias("k")]
        both.append([list(r) for r in df.select("i", *cells).orderBy("i").collect()])
    for a, b in zip(*both, strict=True):
        assert a[0] == b[0]
        for x, y in zip(a[1:], b[1:], strict=True):
            assert x == pytest.approx(y, abs=1e-6)


@pytest.mark.parametrize("how", ["mean", "max"])
def test_encoders_hold_a_bounded_part_of_a_batch(spark, how):
    """However many texts and pieces a batch has, the encoder gets few at once, and a row's pieces still meet in its vector."""
    most = 1 << 18

    def load():
        def model(items):
            assert sum(map(len, items)) <= most
            return np.array([[len(i), 1.0] for i in items])

        return model

    spec = EncoderSpec(f"bounded-{how}", load, 2, 1 << 20)
    lists = [["ab", None] * 100_000 + ["c" * 1000] * 600, None, [], ["abc"], [None]]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, l array<string>").coalesce(1)
    got = [r["v"] for r in df.select("i", encode_images(F.col("l"), spec, how).alias("v")).orderBy("i").collect()]
    unit = np.array([[n, 1.0] for n in [2] * 100_000 + [1000] * 600])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert got[0] == pytest.approx(list(unit.max(axis=0) if how == "max" else unit.mean(axis=0)), abs=1e-6)
    assert got[1] == got[2] == got[4] == [0.0, 0.0] and got[3] == pytest.approx([3 / 10**0.5, 1 / 10**0.5], abs=1e-6)
    texts = df.select("i", F.repeat(F.lit("x"), 150_000).alias("t"))
    assert texts.select(encode_text(F.col("t"), spec).alias("v")).distinct().count() == 1
