"""Recognised text tokens to one text per image and per post (F16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.settings import OCR_CONFIDENCE


def _joined(order: str, text: str, most: int | None) -> Column:
    """Texts of a group in order, joined by spaces; cut to `most` characters if given."""
    texts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("t"))))
    joined = F.array_join(F.transform(texts, lambda s: s["t"]), " ")
    return joined if most is None else F.substring(joined, 1, most)


def image_texts(tokens: DataFrame, most: int | None = None) -> DataFrame:
    """Per post_id, image_id: text and mean confidence of the tokens above the confidence floor; both are null for an
    image without such tokens, so no post is lost. Whole texts unless a caller sets `most` characters."""
    good = F.col("conf") > OCR_CONFIDENCE
    kept = tokens.withColumns({"text": F.when(good, F.col("text")), "conf": F.when(good, F.col("conf")), "pos": F.when(good, F.col("pos"))})
    sums = kept.groupBy("post_id", "image_id").agg(_joined("pos", "text", most).alias("text"), F.avg("conf").alias("conf"))
    return sums.withColumn("text", F.when(F.col("conf").isNotNull(), F.col("text")))


def aggregate_tokens(tokens: DataFrame, image_chars: int | None = None, post_chars: int | None = None) -> DataFrame:
    """Per post: non-empty image texts in image order and the highest image confidence; '' and 0 without text.

    Two sums over the tokens: by image, then by post. A post is one row of output, so its text meets in one row."""
    images = image_texts(tokens, image_chars)
    said = F.col("text") != ""
    images = images.select("post_id", F.when(said, F.col("image_id")).alias("image_id"), F.when(said, F.col("text")).alias("text"), F.when(said, F.col("conf")).alias("conf"))
    return images.groupBy("post_id").agg(
        _joined("image_id", "text", post_chars).alias("ocr_text"), F.coalesce(F.max("conf"), F.lit(0.0)).alias("ocr_confidence"))
