"""Text stage, filters, targets and parsed columns."""

from pyspark.sql import functions as F

from postlens.catalog import fixtures as fx
from postlens.catalog.registry import register
from postlens.functions import text as tx
from postlens.operators import filters, joins, targets
from postlens.operators.ocr import aggregate_tokens
from postlens.plans.text_stage import text_stage, text_stage_funnel, text_stage_targets

_QUALITY = "note_id IS NOT NULL AND note_id <> '' AND imp_num >= 0 AND click_num >= 0 AND click_num <= imp_num"
_RATES = """
  CASE WHEN imp_num > 0 THEN click_num * 1.0E0 / imp_num ELSE 0.0E0 END AS ctr,
  CASE WHEN imp_num > 0 THEN like_num * 1.0E0 / imp_num ELSE 0.0E0 END AS like_rate,
  CASE WHEN imp_num > 0 THEN fav_num * 1.0E0 / imp_num ELSE 0.0E0 END AS fav_rate,
  CASE WHEN imp_num > 0 THEN cmt_num * 1.0E0 / imp_num ELSE 0.0E0 END AS comment_rate,
  CASE WHEN imp_num > 0 THEN share_num * 1.0E0 / imp_num ELSE 0.0E0 END AS share_rate,
  CASE WHEN imp_num > 0 THEN follow_from_discovery_num * 1.0E0 / imp_num ELSE 0.0E0 END AS follow_rate,
  CAST(like_num + coalesce(fav_num, 0) + cmt_num + share_num + follow_from_discovery_num AS BIGINT) AS total_interactions,
  CASE WHEN imp_num > 0 THEN (like_num + coalesce(fav_num, 0) + cmt_num + share_num + follow_from_discovery_num) * 1.0E0 / imp_num ELSE 0.0E0 END AS interaction_rate,
  CASE WHEN imp_num > 0 THEN (like_num + coalesce(fav_num, 0) + 4 * cmt_num + 4 * share_num + 4 * follow_from_discovery_num) * 1.0E0 / imp_num ELSE 0.0E0 END AS ces_rate,
  ln(least(greatest(imp_num, 1), 10000000)) AS impression_log
"""
_RATE_NAMES = [
    "ctr", "like_rate", "fav_rate", "comment_rate", "share_rate", "follow_rate",
    "interaction_rate", "ces_rate", "impression_log",
]
TARGETS_SQL = f"SELECT note_id, imp_num, sort_score2, {_RATES} FROM note_stats WHERE imp_num >= 500 AND {_QUALITY}"


@register(
    "text_stage_targets",
    f"SELECT i.*, s.* EXCLUDE (note_id), {_RATES} FROM note_info i JOIN note_stats s USING (note_id)"
    f" WHERE imp_num >= 500 AND {_QUALITY}",
    ["note_info", "note_stats"], [*_RATE_NAMES, "sort_score2"],
)
def stage(spark, sf):
    return text_stage_targets(fx.note_info(spark, sf), fx.note_stats(spark, sf))


@register(
    "text_stage",
    f"SELECT i.note_id, title, type, imp_num, click_num FROM note_info i JOIN note_stats s ON i.note_id = s.note_id"
    f" WHERE imp_num >= 500 AND {_QUALITY.replace('note_id', 'i.note_id')}",
    ["note_info", "note_stats"],
)
def stage_rows(spark, sf):
    rows = text_stage(fx.note_info(spark, sf), fx.note_stats(spark, sf))
    return rows.select("note_id", "title", "type", "imp_num", "click_num")


@register(
    "semi_join_posts",
    "SELECT note_id, title, taxonomy1 FROM note_info WHERE note_id IN (SELECT note_id FROM note_stats WHERE click_num > imp_num / 3)",
    ["note_info", "note_stats"],
)
def semi(spark, sf):
    stats = fx.note_stats(spark, sf).where(F.col("click_num") > F.col("imp_num") / 3)
    return joins.posts_with_stats(fx.note_info(spark, sf), stats).select("note_id", "title", "taxonomy1")


@register("quality_filter", f"SELECT note_id, imp_num, click_num FROM note_stats WHERE {_QUALITY}", ["note_stats"])
def quality(spark, sf):
    return filters.quality_filter(fx.note_stats(spark, sf)).select("note_id", "imp_num", "click_num")


@register(
    "required_not_null",
    "SELECT note_id, fav_num, sort_score2 FROM note_stats WHERE fav_num IS NOT NULL AND sort_score2 IS NOT NULL",
    ["note_stats"], ["sort_score2"],
)
def required(spark, sf):
    stats = filters.drop_missing(fx.note_stats(spark, sf), ["fav_num", "sort_score2", "absent"])
    return stats.select("note_id", "fav_num", "sort_score2")


_FUNNEL = f"""
WITH j AS (SELECT imp_num >= 500 AS a, imp_num >= 500 AND {_QUALITY} AS b
           FROM note_info JOIN note_stats USING (note_id)),
c AS (SELECT count(*) AS n0, count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE b) AS n2 FROM j)
SELECT CAST(1 AS INTEGER) AS step_no, 'min_impressions' AS step, n0 AS rows_in, n0 - n1 AS dropped, n1 AS rows_out,
       n1 * 100.0E0 / n0 AS retained_pct, n1 < 100 AS few_rows FROM c
UNION ALL
SELECT 2, 'quality', n1, n1 - n2, n2, n2 * 100.0E0 / n0, n2 < 100 FROM c
"""


@register("filter_funnel", _FUNNEL, ["note_info", "note_stats"], ["retained_pct"])
def funnel_rows(spark, sf):
    return text_stage_funnel(fx.note_info(spark, sf), fx.note_stats(spark, sf))


@register(
    "target_rates_by_clicks",
    """SELECT note_id, CASE WHEN imp_num > 0 THEN click_num * 1.0E0 / imp_num ELSE 0.0E0 END AS ctr,
         like_num * 1.0E0 / greatest(click_num, 1) AS like_rate, fav_num * 1.0E0 / greatest(click_num, 1) AS fav_rate,
         (like_num + coalesce(fav_num, 0) + cmt_num + share_num + follow_from_discovery_num) * 1.0E0 / greatest(click_num, 1) AS interaction_rate,
         (like_num + coalesce(fav_num, 0) + 4 * cmt_num + 4 * share_num + 4 * follow_from_discovery_num) * 1.0E0 / greatest(click_num, 1) AS ces_rate,
         ln(1 + imp_num) AS impression_log
       FROM note_stats""",
    ["note_stats"], ["ctr", "like_rate", "fav_rate", "interaction_rate", "ces_rate", "impression_log"],
)
def by_clicks(spark, sf):
    df = targets.add_targets(fx.note_stats(spark, sf), denominator="clicks", impression_form="log1p")
    return df.select("note_id", "ctr", "like_rate", "fav_rate", "interaction_rate", "ces_rate", "impression_log")


@register(
    "derived_ctr",
    "SELECT note_id, CASE WHEN imp_num > 0 THEN click_num * 1.0E0 / imp_num ELSE 0.0E0 END AS ctr FROM note_stats",
    ["note_stats"], ["ctr"],
)
def derived(spark, sf):
    renamed = fx.note_stats(spark, sf).withColumnsRenamed({"imp_num": "imp", "click_num": "clk"})
    return targets.derive_ctr(renamed).select("note_id", "ctr")


@register(
    "sort_score_median_fill",
    "SELECT note_id, coalesce(sort_score2, (SELECT quantile_cont(CAST(sort_score2 AS DOUBLE), 0.5) FROM note_stats)) AS sort_score2 FROM note_stats",
    ["note_stats"], ["sort_score2"],
)
def score_fill(spark, sf):
    return targets.fill_with_median(fx.note_stats(spark, sf)).select("note_id", "sort_score2")


_TASK_UNION = " UNION ALL ".join(
    f"SELECT note_id, '{t}' AS task, CAST({c} AS DOUBLE) AS value FROM t" for t, c in targets.task_columns().items()
)


@register("targets_long", f"WITH t AS ({TARGETS_SQL}) {_TASK_UNION}", ["note_stats"], ["value"])
def targets_long(spark, sf):
    stats = targets.add_targets(filters.quality_filter(filters.min_impressions(fx.note_stats(spark, sf), 500)))
    return targets.to_long(stats, keys=["note_id"])


@register(
    "targets_wide",
    f"WITH t AS ({TARGETS_SQL}) SELECT note_id, CAST(ctr AS FLOAT) AS ctr, CAST(coalesce(fav_rate, 0) AS FLOAT) AS fav_rate,"
    " CAST(0 AS FLOAT) AS absent_task FROM t",
    ["note_stats"], ["ctr", "fav_rate", "absent_task"],
)
def targets_wide(spark, sf):
    stats = targets.add_targets(filters.quality_filter(filters.min_impressions(fx.note_stats(spark, sf), 500)))
    long = targets.to_long(stats, ["ctr", "fav_rate"], ["note_id"])
    return targets.to_wide(long, "note_id", ["ctr", "fav_rate", "absent_task"])


@register(
    "prepared_targets",
    f"WITH t AS ({TARGETS_SQL}) SELECT note_id, CAST(ctr AS FLOAT) AS ctr, CAST(coalesce(fav_rate, 0) AS FLOAT) AS fav_rate,"
    " CAST(coalesce(sort_score2, 0) AS FLOAT) AS sort_score2 FROM t",
    ["note_stats"], ["ctr", "fav_rate", "sort_score2"],
)
def prepared(spark, sf):
    stats = targets.add_targets(filters.quality_filter(filters.min_impressions(fx.note_stats(spark, sf), 500)))
    return targets.prepare_targets(stats).select("note_id", "ctr", "fav_rate", "sort_score2")


@register(
    "scatter_defaults",
    """SELECT note_id, CASE WHEN imp_num >= 700 THEN click_num ELSE 0 END AS clicks,
              CASE WHEN imp_num >= 700 THEN concat('n', note_id) ELSE '' END AS label FROM note_stats""",
    ["note_stats"],
)
def scatter(spark, sf):
    kept = F.col("imp_num") >= 700
    columns = joins.keep_or_default(
        kept, {"clicks": F.col("click_num"), "label": F.concat(F.lit("n"), F.col("note_id"))},
        {"clicks": F.lit(0).cast("bigint"), "label": F.lit("")},
    )
    return fx.note_stats(spark, sf).select("note_id", *[c.alias(n) for n, c in columns.items()])


@register(
    "attached_features",
    "SELECT i.note_id, i.title_length, s.like_num FROM note_info i LEFT JOIN (SELECT * FROM note_stats WHERE like_num > 5) s ON i.note_id = s.note_id",
    ["note_info", "note_stats"],
)
def attached(spark, sf):
    features = fx.note_stats(spark, sf).where("like_num > 5").select("note_id", "like_num")
    return joins.attach_features(fx.note_info(spark, sf), features).select("note_id", "title_length", "like_num")


@register(
    "tag_names",
    """SELECT note_id, CASE WHEN tag_info IS NULL OR tag_info = '[oops' THEN '' ELSE concat(taxonomy1, ',', type) END AS tags FROM note_info""",
    ["note_info"],
)
def tags(spark, sf):
    return fx.note_info(spark, sf).select("note_id", tx.tag_names(F.col("tag_info")).alias("tags"))


_URLS = """
WITH raw AS (SELECT note_id, first_file_id, trim(file_url_list) AS u FROM note_info),
lists AS (
  SELECT note_id, first_file_id,
    CASE WHEN u IS NULL OR u = '' THEN NULL
         WHEN u LIKE '[%]' THEN list_transform(string_split(substr(u, 2, length(u) - 2), ','), lambda x: trim(trim(x), '"'''))
         ELSE list_transform(string_split(u, ','), lambda x: trim(x)) END AS urls
  FROM raw)
"""


@register(
    "cover_url",
    _URLS + """SELECT note_id, CASE WHEN first_file_id IS NULL OR first_file_id = '' THEN NULL
       ELSE coalesce(list_filter(urls, lambda x: contains(x, first_file_id))[1], urls[1]) END AS cover_url FROM lists""",
    ["note_info"],
)
def cover(spark, sf):
    url = tx.cover_url(F.col("file_url_list"), F.col("first_file_id"))
    return fx.note_info(spark, sf).select("note_id", url.alias("cover_url"))


@register(
    "inner_urls",
    _URLS + """, kept AS (SELECT note_id, unnest(list_filter(urls, lambda x: first_file_id IS NULL OR NOT contains(x, first_file_id))) AS url FROM lists)
       SELECT note_id, url, CAST(count(*) AS BIGINT) AS n FROM kept GROUP BY note_id, url""",
    ["note_info"],
)
def inner(spark, sf):
    urls = tx.inner_urls(F.col("file_url_list"), F.col("first_file_id"))
    return fx.note_info(spark, sf).select("note_id", F.explode(urls).alias("url")).groupBy("note_id", "url").agg(
        F.count(F.lit(1)).alias("n"))


@register(
    "first_url",
    """SELECT note_id, coalesce(trim(trim(string_split(trim(file_url_list, '[]'), ',')[1]), '"'''), '') AS url FROM note_info""",
    ["note_info"],
)
def first(spark, sf):
    return fx.note_info(spark, sf).select("note_id", tx.first_url(F.col("file_url_list")).alias("url"))


_STRIP = r"regexp_replace(text, '\A[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+|[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+\z', '', 'g')"


@register(
    "content_chunks",
    rf"""WITH d AS (SELECT doc_id, {_STRIP} AS t FROM documents),
      pieces AS (
        SELECT doc_id, CAST(0 AS INTEGER) AS pos, t AS chunk FROM d WHERE t <> '' AND length(t) <= 200
        UNION ALL
        SELECT doc_id, CAST(k AS INTEGER), substring(t, k * 52 + 1, 52) FROM (SELECT doc_id, t, unnest(range((length(t) + 51) // 52)) AS k FROM d WHERE length(t) > 200))
      SELECT doc_id, pos, chunk FROM pieces""",
)
def chunks(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(tx.content_chunks(F.col("text"))).alias("pos", "chunk"))


@register(
    "encoder_text",
    rf"""SELECT doc_id, md5(CASE WHEN {_STRIP} = '' THEN ' ' ELSE {_STRIP} END) AS digest FROM documents""",
)
def cleaned(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(tx.encoder_text(F.col("text"))).alias("digest"))


_OCR = """
WITH kept AS (SELECT * FROM ocr_tokens WHERE conf > 0.3),
img AS (SELECT post_id, image_id, string_agg(text, ' ' ORDER BY pos) AS t, avg(conf) AS c
        FROM kept GROUP BY post_id, image_id),
posts AS (SELECT DISTINCT post_id FROM ocr_tokens),
agg AS (SELECT post_id, string_agg(t, ' ' ORDER BY image_id) AS ocr_text, max(c) AS ocr_confidence
        FROM img WHERE t <> '' GROUP BY post_id)
SELECT post_id, coalesce(ocr_text, '') AS ocr_text, coalesce(ocr_confidence, 0.0E0) AS ocr_confidence
FROM posts LEFT JOIN agg USING (post_id)
"""


@register("ocr_aggregate", _OCR, ["ocr_tokens"], ["ocr_confidence"])
def ocr(spark, sf):
    return aggregate_tokens(fx.ocr_tokens(spark, sf))
