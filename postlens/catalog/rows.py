"""Row predicates, coercions, joins of small results, and round trips through files."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from postlens.catalog import fixtures as fx
from postlens.catalog.registry import register
from postlens.catalog.stats import target_rows
from postlens.catalog.text import TARGETS_SQL
from postlens.functions import numeric
from postlens.functions.text import has_text, image_count, url_list
from postlens.operators import contracts, filters, joins, sampling
from postlens.session import checkpoint_dir
from postlens.sources import audit, readers, sinks


@register("valid_labels", f"WITH t AS ({TARGETS_SQL}) SELECT note_id FROM t WHERE fav_rate BETWEEN 0 AND 1", ["note_stats"])
def valid_labels(spark, sf):
    return filters.valid_labels(target_rows(spark, sf), "fav_rate").select("note_id")


@register("min_impressions", "SELECT note_id FROM note_stats WHERE imp_num >= 800", ["note_stats"])
def min_impressions(spark, sf):
    return filters.min_impressions(fx.note_stats(spark, sf), 800).select("note_id")


@register("impression_fallback", "SELECT note_id FROM note_stats WHERE imp_num >= 700", ["note_stats"])
def impression_fallback(spark, sf):
    renamed = fx.note_stats(spark, sf).withColumnRenamed("imp_num", "impression")
    return filters.min_impressions_any(renamed, 700).select("note_id")


@register(
    "number_coercion",
    """SELECT note_id, coalesce(try_cast(CASE WHEN like_num % 3 = 0 THEN 'n/a' WHEN like_num % 3 = 1 THEN CAST(fav_num AS VARCHAR)
         ELSE CAST(sort_score2 AS VARCHAR) END AS DOUBLE), 0) AS x FROM note_stats""",
    ["note_stats"], ["x"],
)
def number_coercion(spark, sf):
    like = F.col("like_num")
    raw = F.when(like % 3 == 0, "n/a").when(like % 3 == 1, F.col("fav_num").cast("string")).otherwise(
        F.col("sort_score2").cast("string"))
    return fx.note_stats(spark, sf).select("note_id", numeric.to_number(raw).alias("x"))


@register("category_fill", "SELECT note_id, coalesce(taxonomy2, 'nan') AS taxonomy2 FROM note_info", ["note_info"])
def category_fill(spark, sf):
    return fx.note_info(spark, sf).select("note_id", numeric.fill_category("taxonomy2", "nan").alias("taxonomy2"))


@register("has_text_flag", "SELECT note_id, CASE WHEN coalesce(tag_info, '') <> '' THEN 1 ELSE 0 END AS has_ocr FROM note_info", ["note_info"])
def has_text_flag(spark, sf):
    return fx.note_info(spark, sf).select("note_id", has_text(F.col("tag_info")).alias("has_ocr"))


@register(
    "image_counts",
    """SELECT note_id, CASE WHEN file_url_list IS NULL THEN 0 ELSE len(string_split(file_url_list, ',')) END::INTEGER AS num_images FROM note_info""",
    ["note_info"],
)
def image_counts(spark, sf):
    return fx.note_info(spark, sf).select("note_id", image_count(url_list(F.col("file_url_list"))).alias("num_images"))


@register(
    "absent_filled",
    "SELECT note_id, imp_num, 0 AS taxonomy1, 0 AS sort_score9, 3 AS width FROM note_stats", ["note_stats"], ["sort_score9"])
def absent_filled(spark, sf):
    rows = fx.note_stats(spark, sf).select("note_id", "imp_num")
    filled = contracts.fill_absent(rows, ["taxonomy1"], ["imp_num", "sort_score9"], {"image_vec": 3})
    return filled.withColumn("width", F.size("image_vec")).drop("image_vec")


@register(
    "scalars_attached",
    "SELECT note_id, (imp_num - a) / b AS z FROM note_stats, (SELECT avg(imp_num) AS a, stddev_pop(imp_num) AS b FROM note_stats)",
    ["note_stats"], ["z"])
def scalars_attached(spark, sf):
    stats = fx.note_stats(spark, sf)
    ends = stats.agg(F.avg("imp_num").alias("mean"), F.stddev_pop("imp_num").alias("std"))
    return joins.attach_scalars(stats, ends).select("note_id", ((F.col("imp_num") - F.col("stats.mean")) / F.col("stats.std")).alias("z"))


@register("distinct_ids", "SELECT DISTINCT l_partkey FROM lineitem")
def distinct_ids(spark, sf):
    return fx.table(spark, sf, "lineitem").select("l_partkey").distinct()


@register("large_hash_sample", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY md5('42' || l_orderkey || '-' || l_linenumber) LIMIT 4000")
def large_hash_sample(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"))
    return sampling.hash_sample(rows, "id", 4000).drop("id")


@register(
    "union_missing_columns",
    """SELECT c_custkey, c_name, NULL::BIGINT AS s_suppkey, NULL AS s_name FROM customer
       UNION ALL SELECT NULL, NULL, s_suppkey, s_name FROM supplier""",
)
def union_missing_columns(spark, sf):
    return readers.union_all([
        fx.table(spark, sf, "customer").select("c_custkey", "c_name"),
        fx.table(spark, sf, "supplier").select("s_suppkey", "s_name")])


@register("output_verification", 'SELECT count(*) AS rows, 11 AS columns, 1 AS files FROM lineitem')
def output_verification(spark, sf):
    check = audit.verify_output(readers.read_tree(spark, f"{sf}/lineitem.parquet"))
    return check.select("rows", "columns", F.col("files").cast("int").alias("files"))


@register("batch_roundtrip", "SELECT note_id, title, tag_info FROM note_info", ["note_info"])
def batch_roundtrip(spark, sf):
    """Saved as a batch below the shared folder, then found again as the latest run."""
    out = f"{checkpoint_dir(spark)}/batches-{uuid.uuid4().hex}"
    rows = fx.note_info(spark, sf).select("note_id", "title", "tag_info")
    path = sinks.save_batch(rows, out, 0, 50, datetime.now(), files=10)
    return readers.latest_run(spark, path.rsplit("/dt=", 1)[0]).select("note_id", "title", "tag_info")


@register("csv_roundtrip", "SELECT note_id, title, taxonomy2 FROM note_info", ["note_info"])
def csv_roundtrip(spark, sf):
    out = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = fx.note_info(spark, sf).select("note_id", "title", F.trim("taxonomy2").alias("taxonomy2"))
    sinks.save_csv(rows, out)
    return spark.read.option("header", True).schema("note_id string, title string, taxonomy2 string").csv(out)


@register("json_roundtrip", "SELECT note_id, title, taxonomy2 FROM note_info", ["note_info"])
def json_roundtrip(spark, sf):
    out = f"{checkpoint_dir(spark)}/json-{uuid.uuid4().hex}"
    sinks.save_json(fx.note_info(spark, sf).select("note_id", "title", "taxonomy2"), out)
    return spark.read.schema("note_id string, title string, taxonomy2 string").json(out)


@register("pruned_read", "SELECT o_orderkey, o_totalprice FROM orders", doubles=["o_totalprice"])
def pruned_read(spark, sf):
    return readers.read_tree(spark, f"{sf}/orders.parquet", columns=["o_orderkey", "o_totalprice", "absent"])


@register("batch_range_read", "SELECT note_id, title FROM note_info", ["note_info"])
def batch_range_read(spark, sf):
    """Numbered files below the shared folder, read again as two ranges of numbers."""
    out = f"{checkpoint_dir(spark)}/numbered-{uuid.uuid4().hex}"
    fx.note_info(spark, sf).select("note_id", "title").repartition(4).write.parquet(out)
    return readers.read_batches(spark, out, 0, 1).unionByName(readers.read_batches(spark, out, 2, 3))


@register("corrupt_skip", "SELECT note_id, title FROM note_info", ["note_info"])
def corrupt_skip(spark, sf):
    """A tree with files that are no parquet: only those are left out."""
    out = f"{checkpoint_dir(spark)}/mixed-{uuid.uuid4().hex}"
    rows = fx.note_info(spark, sf).select("note_id", "title")
    rows.write.parquet(f"{out}/good")
    rows.select("title").write.option("lineSep", "|").text(f"{out}/bad")
    return readers.read_tree(spark, out, skip_corrupt=True, schema=rows.schema)


@register(
    "per_source_output",
    " UNION ALL ".join(f"SELECT 'incremental_{t}.parquet' AS source_file, count(*) AS rows FROM {t}" for t in ("customer", "supplier")),
)
def per_source_output(spark, sf):
    """Rows written apart by the file they came from, and counted again."""
    out = f"{checkpoint_dir(spark)}/sources-{uuid.uuid4().hex}"
    for t in ("customer", "supplier"):
        sinks.save_per_source(sinks.with_source(spark.read.parquet(f"{sf}/{t}.parquet"), sf), f"{out}/{t}")
    saved = readers.union_all([spark.read.parquet(f"{out}/{t}") for t in ("customer", "supplier")])
    return saved.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))


from postlens.catalog.registry import ORACLES  # noqa: E402

ORACLES["csv_roundtrip"] = ORACLES["csv_roundtrip"].replace("title, taxonomy2 FROM", "title, trim(taxonomy2) AS taxonomy2 FROM")
