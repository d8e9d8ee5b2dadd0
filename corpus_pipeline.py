"""A corpus from raw documents to packed sequences, as stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import decontamination, language_id, near_dup, packing, quality_cascade
from postlens.llm.common import materialise, shared_path, table
from postlens.session import ship_package


def _identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of the text, above 2^62, where doc_id is null and text is not; and the column of the given ids."""
    given = "_given_id"
    while given in docs.columns:
        given += "_"
    of_text = F.when(F.col("text").isNotNull(), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    return docs.withColumn(given, F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", of_text)), given


# How far below the labelled documents' mean a text's log probability may lie: in deviations of documents, and of a mean
# of as many n-grams as the text has (three orders over the same letters count as one).
DEVIATIONS, OF_GRAMS = 12, 4


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose n-grams are not far less likely than those of all labelled documents.

    The model learns from the documents' own labels; so do mean and deviation of the log probability of an n-gram, by
    language. Short texts may deviate more, as means of few n-grams do. Without labels all lettered documents stay. Null
    and empty texts go; rows that repeat are judged each; an empty table stays empty; other columns are carried along.
    Scores are written once, for the means and for the verdicts."""
    ship_package(spark)
    model = language_id.fit(docs)
    named = materialise(language_id.predict(docs, model, per_gram=True).where("_grams > 0"))
    kept = F.lit(True)
    if model.languages:
        typical = named.where("lang IS NOT NULL").groupBy("lang_pred").agg(F.avg("_log_gram").alias("mean"), F.stddev_pop("_log_gram").alias("sd")).collect()
        spread = dict(zip(model.languages, language_id.gram_deviation(model).tolist(), strict=True))
        for r in typical:
            room = DEVIATIONS * r["sd"] + OF_GRAMS * spread[r["lang_pred"]] * F.sqrt(len(language_id.ORDERS) / F.col("_grams"))
            kept = F.when(F.col("lang_pred") == r["lang_pred"], F.col("_log_gram") >= r["mean"] - room).otherwise(kept)
    return named.where(kept).select(*docs.columns)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts have no words and go; rows that repeat are judged each; an empty table stays empty."""
    ship_package(spark)
    return quality_cascade.judge(docs).where("rejected_by IS NULL").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates (five-word shingles, similarity 0.8).

    Of rows equal in id and text one stays. Rows with a null id are compared by a hash of their text as id, after those
    that have one; null texts and texts without words are linked with nothing and stay. An empty table stays empty."""
    ship_package(spark)
    named, given = _identified(docs)
    gone = near_dup.near_duplicates(named).where("NOT kept").select("doc_id").distinct()
    left = named.join(gone, "doc_id", "left_anti")
    # Ids alone are counted; texts are compared only where an id repeats.
    twice = named.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = left.join(twice, "doc_id", "left_anti").unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return once.withColumn("doc_id", F.col(given)).select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows with a null id are searched by a hash of their text as id. Null and empty texts hold nothing and stay, as do all
    rows where the benchmark is empty; all rows of an id with a leak go."""
    ship_package(spark)
    named, given = _identified(docs)
    found = decontamination.leaks(named, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return named.join(found, "doc_id", "left_anti").withColumn("doc_id", F.col(given)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; null and empty texts give their end id alone, an empty table no rows."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", with_language),
    ("quality_rules", of_quality),
    ("near_dedup", without_near_copies),
    ("decontamination", without_leaks),
    ("packing", packed),
]
# The model, the signatures and the tokenizer are beyond SQL; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
