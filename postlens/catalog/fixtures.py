"""Logical tables derived from the driver's tables; the only module that knows those tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators.ordering import number_rows

NOTE_INFO = """
SELECT CAST(p_partkey AS STRING) AS note_id,
       p_name AS title, p_type AS type, p_brand AS taxonomy1,
       CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN 'unknown'
            ELSE concat(' T', CAST(p_size % 5 AS STRING)) END AS taxonomy2,
       concat('I', CAST(p_partkey % 4 AS STRING)) AS intention_lv1,
       CAST(length(p_name) AS INT) AS title_length,
       CASE WHEN p_size % 13 = 0 THEN NULL WHEN p_size % 11 = 0 THEN '[oops'
            ELSE concat('[{"name":"', p_brand, '"},{"id":3},{"name":"', p_type, '"}]') END AS tag_info,
       CASE WHEN p_size % 19 = 0 THEN NULL
            WHEN p_size % 3 = 0 THEN concat('["http://x/a', CAST(p_partkey AS STRING), '.jpg","http://x/b', CAST(p_partkey AS STRING), '.jpg","http://x/c.jpg"]')
            WHEN p_size % 3 = 1 THEN concat('http://x/a', CAST(p_partkey AS STRING), '.jpg, http://x/b', CAST(p_partkey AS STRING), '.jpg')
            ELSE concat('[http://x/a.jpg, http://x/b', CAST(p_partkey AS STRING), '.jpg]') END AS file_url_list,
       CASE WHEN p_size % 17 = 0 THEN NULL ELSE concat('b', CAST(p_partkey AS STRING)) END AS first_file_id
FROM part
"""

NOTE_STATS = """
SELECT CAST(l_partkey AS STRING) AS note_id,
       CAST(sum(l_quantity) AS BIGINT) AS imp_num,
       CASE WHEN l_partkey % 37 = 0 THEN CAST(sum(l_quantity) AS BIGINT) + 1
            ELSE CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) END AS click_num,
       CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS like_num,
       CASE WHEN l_partkey % 29 = 0 THEN NULL
            ELSE CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) END AS fav_num,
       CAST(sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS BIGINT) AS cmt_num,
       CAST(sum(CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END) AS BIGINT) AS share_num,
       CAST(sum(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) AS BIGINT) AS follow_from_discovery_num,
       CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE max(l_extendedprice) END AS sort_score2
FROM lineitem GROUP BY l_partkey
"""

# The three tasks share the shape; each has its own value columns.
_PREDICTION = """
SELECT note_id, '{task}' AS task,
       CASE WHEN like_num % 9 = 0 THEN NULL ELSE {true} * 1.0E0 / imp_num END AS y_true,
       ({true} + 3 * like_num) * 1.0E0 / (imp_num + 100) AS y_pred
FROM note_stats
"""
PREDICTIONS = "UNION ALL".join(
    _PREDICTION.format(task=task, true=true)
    for task, true in (("ctr", "click_num"), ("comment_rate", "cmt_num"), ("share_rate", "share_num"))
)

EPOCH_HISTORY = """
SELECT user_id AS run_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS epoch,
       value / 100 AS loss, (value + event_id % 50) / 100 AS val_loss
FROM events
"""

BATCH_METRICS = """
SELECT user_id AS run_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS batch,
       value AS seconds
FROM events
"""

OCR_TOKENS = """
SELECT user_id AS post_id, CAST(floor(event_id / 5) AS BIGINT) AS image_id, event_id % 5 AS pos,
       event_type AS text, ((event_id * 37) % 100) / 100.0E0 AS conf
FROM events
"""

NOTE_VECTORS_DUCKDB = """
SELECT CAST(vec_id AS STRING) AS note_id,
       CASE WHEN vec_id % 25 = 0 THEN list_transform(embedding[1:32], lambda x: CAST(0 AS FLOAT)) ELSE embedding[1:32] END AS image_vec,
       embedding[33:64] AS text_vec, label AS cluster, CAST(vec_id AS BIGINT) AS vec_id
FROM embeddings
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", f"FROM parquet.`{sf_dir}/{name}.parquet`"))


def note_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, NOTE_INFO, "part")


def note_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, NOTE_STATS, "lineitem")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same rows as PREDICTIONS, from one pass over note_stats."""
    stats = note_stats(spark, sf_dir)
    imp, like = F.col("imp_num"), F.col("like_num")
    rows = [
        F.struct(
            F.lit(task).alias("task"),
            F.when(like % 9 != 0, F.col(true) * 1.0 / imp).alias("y_true"),
            ((F.col(true) + 3 * like) * 1.0 / (imp + 100)).alias("y_pred"),
        )
        for task, true in (("ctr", "click_num"), ("comment_rate", "cmt_num"), ("share_rate", "share_num"))
    ]
    return stats.select("note_id", F.inline(F.array(*rows)))


def _numbered_events(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", "value")
    return number_rows(events, ["run_id"], ["ts", "event_id"], name).withColumn(name, F.col(name).cast("int"))


def epoch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same rows as EPOCH_HISTORY; a run with very many events is not numbered in one task."""
    rows = _numbered_events(spark, sf_dir, "epoch")
    return rows.select(
        "run_id", "epoch", (F.col("value") / 100).alias("loss"),
        ((F.col("value") + F.col("event_id") % 50) / 100).alias("val_loss"),
    )


def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same rows as BATCH_METRICS."""
    return _numbered_events(spark, sf_dir, "batch").select("run_id", "batch", F.col("value").alias("seconds"))


def ocr_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, OCR_TOKENS, "events")


def note_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.slice("embedding", 1, 32)
    zero = F.transform(image, lambda x: F.lit(0.0).cast("float"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("note_id"),
        F.when(F.col("vec_id") % 25 == 0, zero).otherwise(image).alias("image_vec"),
        F.slice("embedding", 33, 32).alias("text_vec"),
        F.col("label").alias("cluster"),
        F.col("vec_id").cast("bigint").alias("vec_id"),
    )
