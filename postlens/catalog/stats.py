"""Profiles, taxonomy, encoders, splits, losses and metrics."""

from pyspark.sql import functions as F

from postlens.catalog import fixtures as fx
from postlens.catalog.registry import register, student_p_sql
from postlens.catalog.text import TARGETS_SQL
from postlens.operators import encoding, filters, metrics, ordering, profile, sampling, targets, taxonomy

_TASKS = targets.task_columns()
_LONG0 = " UNION ALL ".join(
    f"SELECT note_id, '{t}' AS task, CAST({c} AS DOUBLE) AS raw, coalesce(CAST({c} AS DOUBLE), 0) AS value FROM t"
    for t, c in _TASKS.items())
LONG_SQL = f"WITH t AS ({TARGETS_SQL}), long AS ({_LONG0}) "


def target_rows(spark, sf):
    stats = filters.quality_filter(filters.min_impressions(fx.note_stats(spark, sf), 500))
    return targets.add_targets(stats)


_PROFILE = LONG_SQL + """
, p AS (SELECT task, count(*) AS rows, avg(value) AS mean, stddev_samp(value) AS std, var_samp(value) AS variance,
       min(value) AS min, max(value) AS max, count(*) FILTER (WHERE value = 0) AS zeros,
       count(*) FILTER (WHERE raw IS NULL) AS nulls, quantile_cont(value, 0.5) AS median,
       count(DISTINCT value) AS distinct_values FROM long GROUP BY task)
"""
_PROFILE_DOUBLES = ["mean", "std", "variance", "min", "max", "median"]


@register("target_profile", _PROFILE + "SELECT * FROM p", ["note_stats"], _PROFILE_DOUBLES, ["variance"])
def target_profile(spark, sf):
    return profile.target_profile(target_rows(spark, sf))


@register(
    "target_flags",
    _PROFILE + """SELECT task, CASE WHEN distinct_values <= 1 THEN 'constant' WHEN variance < 1e-8 THEN 'near_constant'
       WHEN distinct_values < 10 THEN 'limited' ELSE 'ok' END AS flag, rows, 13 AS columns FROM p WHERE task <> 'sort_score'
       UNION ALL SELECT 'sort_score', 'missing', max(rows), 13 FROM p""",
    ["note_stats"],
)
def target_flags(spark, sf):
    columns = [c for c in _TASKS.values() if c != "sort_score2"]
    return profile.target_report(target_rows(spark, sf).select("note_id", "imp_num", "click_num", *columns, "total_interactions"))


@register(
    "target_quantiles",
    LONG_SQL + "SELECT task, " + ", ".join(
        f"quantile_cont(value, {p}) AS p{round(p * 100)}" for p in profile.PROFILE_PERCENTILES)
    + " FROM long GROUP BY task HAVING count(DISTINCT value) > 1",
    ["note_stats"], [f"p{round(p * 100)}" for p in profile.PROFILE_PERCENTILES],
)
def target_quantiles(spark, sf):
    return profile.target_quantiles(target_rows(spark, sf))


_INFO_TYPES = {
    "note_id": "string", "title": "string", "type": "string", "taxonomy1": "string", "taxonomy2": "string",
    "intention_lv1": "string", "title_length": "int", "tag_info": "string", "file_url_list": "string",
    "first_file_id": "string",
}


@register(
    "null_report",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS rows,"
        f" count(*) FILTER (WHERE {c} IS NULL) * 1.0E0 / count(*) AS null_share FROM note_info"
        for c, t in _INFO_TYPES.items()),
    ["note_info"], ["null_share"],
)
def null_report(spark, sf):
    return profile.null_report(fx.note_info(spark, sf))


@register(
    "table_issues",
    f"""WITH t AS ({TARGETS_SQL}), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE fav_rate IS NULL) AS m FROM t)
    SELECT 'empty_table' AS issue, n = 0 AS found FROM c UNION ALL SELECT 'label_absent', false FROM c
    UNION ALL SELECT 'label_has_nulls', m > 0 FROM c UNION ALL SELECT 'no_vectors', true FROM c""",
    ["note_stats"],
)
def issues(spark, sf):
    return profile.table_issues(target_rows(spark, sf), "fav_rate", ["image_vec"])


@register(
    "label_check",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE r IS NULL) AS nulls, avg(r) AS mean, stddev_samp(r) AS std,
       min(r) AS min, max(r) AS max, count(*) FILTER (WHERE r < 0) AS negatives, count(*) FILTER (WHERE r > 1) AS above_one,
       stddev_samp(r) < 1e-8 AS constant
       FROM (SELECT CASE WHEN imp_num > 0 THEN click_num * 1.0E0 / imp_num ELSE 0 END AS r FROM note_stats)""",
    ["note_stats"], ["mean", "std", "min", "max"],
)
def label_check(spark, sf):
    return profile.label_check(targets.derive_ctr(fx.note_stats(spark, sf)))


def _describe_sql(column):
    v = f"CAST({column} AS DOUBLE)"
    return (
        f"SELECT '{column}' AS \"column\", count({column}) AS count, avg({v}) AS mean, stddev_samp({v}) AS std,"
        f" min({v}) AS min, max({v}) AS max, quantile_cont({v}, 0.25) AS q25, quantile_cont({v}, 0.5) AS median,"
        f" quantile_cont({v}, 0.75) AS q75 FROM note_stats")


@register(
    "describe_label", " UNION ALL ".join(_describe_sql(c) for c in ("imp_num", "fav_num", "sort_score2")), ["note_stats"],
    ["mean", "std", "min", "max", "q25", "median", "q75"],
)
def describe(spark, sf):
    return profile.describe(fx.note_stats(spark, sf), ["imp_num", "fav_num", "sort_score2"])


_STATS_TYPES = {
    "note_id": ("meta", "string"), "imp_num": ("other", "bigint"), "click_num": ("other", "bigint"),
    "like_num": ("other", "bigint"), "fav_num": ("other", "bigint"), "cmt_num": ("other", "bigint"),
    "share_num": ("other", "bigint"), "follow_from_discovery_num": ("other", "bigint"), "sort_score2": ("other", "double"),
}


@register(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{role}' AS role, '{t}' AS type, count({c}) AS non_null,"
        f" {'avg(' + c + ')' if t != 'string' else 'CAST(NULL AS DOUBLE)'} AS mean FROM note_stats"
        for c, (role, t) in _STATS_TYPES.items()),
    ["note_stats"], ["mean"],
)
def column_profile(spark, sf):
    return profile.column_profile(fx.note_stats(spark, sf))


@register(
    "constant_columns",
    """SELECT 'imp_num' AS "column", CASE WHEN min(imp_num) = max(imp_num) THEN 'constant' ELSE 'ok' END AS status FROM note_stats
       UNION ALL SELECT 'one', 'constant' UNION ALL SELECT 'absent', 'missing'""",
    ["note_stats"],
)
def constants(spark, sf):
    return profile.constant_columns(fx.note_stats(spark, sf).withColumn("one", F.lit(1)), ["imp_num", "one", "absent"])


@register(
    "prediction_profile",
    """SELECT task, count(*) AS rows, avg(y_pred) AS mean, stddev_pop(y_pred) AS std, min(y_pred) AS min, max(y_pred) AS max,
       count(DISTINCT y_pred) AS distinct_values, CASE WHEN stddev_pop(y_pred) < 1e-8 THEN 'constant'
       WHEN count(DISTINCT y_pred) < 5 THEN 'limited' ELSE 'ok' END AS flag FROM predictions GROUP BY task""",
    ["predictions"], ["mean", "std", "min", "max"],
)
def prediction_profile(spark, sf):
    return profile.prediction_quality(fx.predictions(spark, sf))


@register(
    "target_array_profile",
    """SELECT task, count(*) AS rows, avg(y_true) AS mean, stddev_pop(y_true) AS std, min(y_true) AS min, max(y_true) AS max,
       count(*) FILTER (WHERE y_true IS NULL) AS missing, count(*) FILTER (WHERE y_true = 0) AS zeros,
       count(DISTINCT y_true) AS distinct_values, count(*) FILTER (WHERE y_true IS NULL) * 1.0E0 / count(*) AS missing_ratio,
       count(*) FILTER (WHERE y_true = 0) * 1.0E0 / count(*) AS zero_ratio, stddev_pop(y_true) < 1e-8 AS is_constant,
       count(*) FILTER (WHERE y_true IS NULL) * 1.0E0 / count(*) > 0.1 AS is_sparse, count(DISTINCT y_true) < 10 AS is_limited
       FROM predictions GROUP BY task""",
    ["predictions"], ["mean", "std", "min", "max", "missing_ratio", "zero_ratio"],
)
def target_array_profile(spark, sf):
    return profile.value_quality(fx.predictions(spark, sf), "task", "y_true")


_WORDS = "('其他', 'None', 'null', 'nan', '', 'unknown', '未知', '暂无')"
_TAGS = f"""
WITH raw AS (
  SELECT 'intention_lv1' AS "column", trim(intention_lv1) AS value FROM note_info
  UNION ALL SELECT 'taxonomy1', trim(taxonomy1) FROM note_info UNION ALL SELECT 'taxonomy2', trim(taxonomy2) FROM note_info),
c AS (SELECT "column", value, count(*) AS n FROM raw WHERE value IS NOT NULL AND value NOT IN {_WORDS} GROUP BY ALL)
"""


@register("taxonomy_values", _TAGS + "SELECT * FROM c", ["note_info"])
def tag_values(spark, sf):
    return taxonomy.tag_counts(fx.note_info(spark, sf))


@register(
    "taxonomy_top20",
    _TAGS + """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS place FROM c) WHERE place <= 20""",
    ["note_info"],
)
def tag_top(spark, sf):
    return taxonomy.top_tags(fx.note_info(spark, sf))


@register(
    "taxonomy_report",
    _TAGS + """SELECT "column", distinct_values, rows, place, value, n FROM (
       SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS place,
              count(*) OVER (PARTITION BY "column") AS distinct_values,
              CAST(sum(n) OVER (PARTITION BY "column") AS BIGINT) AS rows FROM c) WHERE place <= 20""",
    ["note_info"],
)
def tag_report(spark, sf):
    return taxonomy.taxonomy_report(fx.note_info(spark, sf))


@register(
    "taxonomy_ragged",
    _TAGS + """, p AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS position FROM c)
       SELECT position, max(value) FILTER (WHERE "column" = 'intention_lv1') AS intention_lv1,
         max(value) FILTER (WHERE "column" = 'taxonomy1') AS taxonomy1, max(value) FILTER (WHERE "column" = 'taxonomy2') AS taxonomy2
       FROM p GROUP BY position""",
    ["note_info"],
)
def tag_ragged(spark, sf):
    return taxonomy.ragged_tags(fx.note_info(spark, sf), ["intention_lv1", "taxonomy1", "taxonomy2"])


_CODES = """
WITH v AS (SELECT 'taxonomy2' AS feature, coalesce(taxonomy2, 'missing') AS value FROM note_info
           UNION SELECT 'title', title FROM note_info),
codes AS (SELECT feature, value, dense_rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS code FROM v)
"""


@register("label_codes", _CODES + "SELECT * FROM codes", ["note_info"])
def label_codes(spark, sf):
    return encoding.fit_vocabulary(fx.note_info(spark, sf), ["taxonomy2", "title"])


_UNSEEN = """
WITH v AS (SELECT DISTINCT coalesce(taxonomy1, 'missing') AS value FROM note_info WHERE title_length % 2 = 0),
codes AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM v)
SELECT i.note_id, i.taxonomy1, coalesce(c.code, {default}) AS taxonomy1_code
FROM note_info i LEFT JOIN codes c ON i.taxonomy1 = c.value
"""


def _encoded(spark, sf, policy):
    info = fx.note_info(spark, sf).select("note_id", "taxonomy1", "title_length")
    vocab = encoding.fit_vocabulary(info.where("title_length % 2 = 0"), ["taxonomy1"])
    return encoding.encode(info, vocab, ["taxonomy1"], unseen=policy).drop("title_length")


@register("label_codes_unseen", _UNSEEN.format(default="0"), ["note_info"])
def codes_zero(spark, sf):
    return _encoded(spark, sf, "zero")


@register("label_codes_reserve", _UNSEEN.format(default="(SELECT count(*) FROM codes)"), ["note_info"])
def codes_reserve(spark, sf):
    return _encoded(spark, sf, "reserve")


@register(
    "vocabulary_sizes", _CODES + "SELECT feature, count(*) AS size FROM codes GROUP BY feature", ["note_info"])
def sizes(spark, sf):
    return encoding.vocabulary_sizes(encoding.fit_vocabulary(fx.note_info(spark, sf), ["taxonomy2", "title"]))


@register(
    "standard_scale",
    """WITH s AS (SELECT avg(imp_num) AS a, stddev_pop(imp_num) AS b, avg(coalesce(fav_num, 0)) AS c, stddev_pop(coalesce(fav_num, 0)) AS d FROM note_stats)
       SELECT note_id, (imp_num - a) / b AS imp_num, (coalesce(fav_num, 0) - c) / d AS fav_num, 0 AS one FROM note_stats, s""",
    ["note_stats"], ["imp_num", "fav_num", "one"],
)
def standard_scale(spark, sf):
    rows = fx.note_stats(spark, sf).select("note_id", "imp_num", "fav_num", F.lit(1).alias("one"))
    columns = ["imp_num", "fav_num", "one"]
    scaled = encoding.scale(rows, encoding.fit_scaler(rows, columns), columns)
    # Stored floats carry 24 bits; compare what both sides agree on.
    return scaled.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in columns})


from postlens.catalog.registry import ORACLES  # noqa: E402

ORACLES["standard_scale"] = ORACLES["standard_scale"].replace(
    "(imp_num - a) / b", "round(CAST(CAST((imp_num - a) / b AS FLOAT) AS DOUBLE), 4)").replace(
    "(coalesce(fav_num, 0) - c) / d", "round(CAST(CAST((coalesce(fav_num, 0) - c) / d AS FLOAT) AS DOUBLE), 4)")


_SPLIT = "CAST('0x' || substr(md5('42' || note_id), 1, 8) AS BIGINT) % 10000"
_LABEL_TASKS = {"ctr": "ctr", "fav_rate": "fav_rate", "impression": "impression_log", "absent": "absent"}


def _labels_sql(center, scale):
    fit = ", ".join(
        f"{center.format(c=c)} AS {t}_c, {scale.format(c=c)} AS {t}_s"
        for t, c in _LABEL_TASKS.items() if t != "absent")
    norm = ", ".join(
        f"({c} - {t}_c) / CASE WHEN {t}_s = 0 THEN 1 ELSE {t}_s END AS {t}_norm"
        for t, c in _LABEL_TASKS.items() if t != "absent")
    return f"""WITH t AS ({TARGETS_SQL}), f AS (SELECT {fit} FROM t WHERE {_SPLIT} >= 2000)
      SELECT note_id, {norm}, 0 AS absent_norm FROM t, f"""


_NORM = [f"{t}_norm" for t in _LABEL_TASKS]


def _normalised(spark, sf, method):
    rows = sampling.train_val(target_rows(spark, sf), "note_id")
    stats = encoding.fit_labels(rows.where("split = 'train'"), _LABEL_TASKS, method)
    return encoding.normalise_labels(rows, stats, _LABEL_TASKS).select("note_id", *_NORM)


@register("standard_labels", _labels_sql("avg({c})", "stddev_pop({c})"), ["note_stats"], _NORM)
def standard_labels(spark, sf):
    return _normalised(spark, sf, "standard")


@register("minmax_labels", _labels_sql("min({c})", "max({c}) - min({c})"), ["note_stats"], _NORM)
def minmax_labels(spark, sf):
    return _normalised(spark, sf, "minmax")


@register(
    "robust_labels",
    _labels_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"), ["note_stats"], _NORM)
def robust_labels(spark, sf):
    return _normalised(spark, sf, "robust")


_FIT_PRED = "f AS (SELECT avg(click_num * 1.0E0 / imp_num) AS m, stddev_pop(click_num * 1.0E0 / imp_num) AS s FROM note_stats)"


@register(
    "inverse_labels",
    f"WITH {_FIT_PRED} SELECT note_id, task, CASE WHEN task = 'ctr' THEN y_pred * s + m ELSE y_pred END AS y_pred FROM predictions, f",
    ["predictions"], ["y_pred"],
)
def inverse_labels(spark, sf):
    stats = encoding.fit_labels(targets.derive_ctr(fx.note_stats(spark, sf)), {"ctr": "ctr"})
    return encoding.denormalise(fx.predictions(spark, sf), stats).select("note_id", "task", "y_pred")


@register(
    "label_report",
    f"""WITH {_FIT_PRED} SELECT 'ctr' AS task, 'fitted' AS status, 'standard' AS method, m AS mean, s AS std,
        CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max FROM f
        UNION ALL SELECT 'fav_rate', 'missing', NULL, NULL, NULL, NULL, NULL""",
    ["note_stats"], ["mean", "std", "min", "max"],
)
def label_report(spark, sf):
    stats = encoding.fit_labels(targets.derive_ctr(fx.note_stats(spark, sf)), {"ctr": "ctr"})
    return encoding.label_report(stats, ["ctr", "fav_rate"])


@register(
    "split_counts",
    f"""WITH b AS (SELECT {_SPLIT} AS b FROM note_info),
      s AS (SELECT 'train_val' AS scheme, CASE WHEN b < 2000 THEN 'val' ELSE 'train' END AS split FROM b
            UNION ALL SELECT 'three_way', CASE WHEN b < 2000 THEN 'test' WHEN b < 3000 THEN 'val' ELSE 'train' END FROM b)
      SELECT scheme, split, count(*) AS n FROM s GROUP BY ALL""",
    ["note_info"],
)
def split_counts(spark, sf):
    info = fx.note_info(spark, sf).select("note_id")
    two = sampling.train_val(info, "note_id").withColumn("scheme", F.lit("train_val"))
    three = sampling.split(info, "note_id", 0.2, 0.1).withColumn("scheme", F.lit("three_way"))
    return two.unionByName(three).groupBy("scheme", "split").agg(F.count(F.lit(1)).alias("n"))


@register(
    "fold_counts",
    "SELECT CAST(CAST('0x' || substr(md5('fold' || note_id), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold, count(*) AS n FROM note_info GROUP BY 1",
    ["note_info"],
)
def fold_counts(spark, sf):
    return sampling.folds(fx.note_info(spark, sf), "note_id").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@register(
    "split_profile",
    LONG_SQL + f"""SELECT CASE WHEN {_SPLIT} < 2000 THEN 'val' ELSE 'train' END AS split, task, count(*) AS rows,
      avg(raw) AS mean, stddev_pop(raw) AS std, count(DISTINCT raw) AS distinct_values, stddev_pop(raw) < 1e-8 AS constant
      FROM long GROUP BY 1, 2""",
    ["note_stats"], ["mean", "std"],
)
def split_profile(spark, sf):
    rows = sampling.train_val(target_rows(spark, sf), "note_id")
    return metrics.split_profile(targets.to_long(rows, keys=["split"]))


@register(
    "hash_sample", "SELECT note_id, title FROM note_info ORDER BY md5('42' || note_id), note_id LIMIT 300", ["note_info"])
def hash_sample(spark, sf):
    return sampling.hash_sample(fx.note_info(spark, sf).select("note_id", "title"), "note_id", 300)


@register(
    "masked_mse",
    """SELECT task, count(y_true) AS valid, coalesce(sum((y_true - y_pred) ** 2), 0) / greatest(count(y_true), 1) AS masked_mse
       FROM predictions GROUP BY task""",
    ["predictions"], ["masked_mse"],
)
def masked(spark, sf):
    return metrics.masked_mse(fx.predictions(spark, sf))


_LOSSES = """
WITH l AS (SELECT task, CASE WHEN task = 'ctr' THEN 3.0E0 ELSE 1.0E0 END AS weight,
  CASE WHEN task = 'ctr' THEN sum((y_true - y_pred) ** 2) / count(y_true) ELSE avg((coalesce(y_true, 0) - y_pred) ** 2) END AS loss
  FROM predictions GROUP BY task)
"""


@register("task_losses", _LOSSES + "SELECT task, weight, loss, weight * loss AS weighted FROM l", ["predictions"],
          ["weight", "loss", "weighted"])
def task_losses(spark, sf):
    return metrics.task_losses(fx.predictions(spark, sf), masked=["ctr"])


@register("multitask_loss", _LOSSES + "SELECT sum(weight * loss) AS loss FROM l", ["predictions"], ["loss"])
def multitask_loss(spark, sf):
    return metrics.multitask_loss(fx.predictions(spark, sf), masked=["ctr"])


_WEIGHT_TASKS = ["ctr", "fav_rate", "ces_rate", "impression"]


@register(
    "inverse_variance_weights",
    f"WITH t AS ({TARGETS_SQL}), v AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS task, 1 / (var_pop({_TASKS[t]}) + 1e-8) AS inv FROM t" for t in _WEIGHT_TASKS)
    + ") SELECT task, inv / sum(inv) OVER () * count(*) OVER () AS weight FROM v",
    ["note_stats"], ["weight"],
)
def variance_weights(spark, sf):
    return metrics.variance_weights(target_rows(spark, sf), _WEIGHT_TASKS)


@register(
    "missing_tasks",
    """SELECT task, count(*) FILTER (WHERE y_true IS NULL) * 1.0E0 / count(*) AS missing_ratio FROM predictions
       GROUP BY task HAVING count(*) FILTER (WHERE y_true IS NULL) * 1.0E0 / count(*) > 0.01""",
    ["predictions"], ["missing_ratio"],
)
def missing_tasks(spark, sf):
    return metrics.missing_tasks(fx.predictions(spark, sf))


_SCORED = "s AS (SELECT * FROM predictions WHERE y_true IS NOT NULL)"


@register(
    "regression_metrics",
    f"""WITH {_SCORED}, m AS (SELECT task, count(*) AS valid_samples, avg((y_true - y_pred) ** 2) AS mse,
        avg(abs(y_true - y_pred)) AS mae, var_pop(y_true) AS v FROM s GROUP BY task)
        SELECT task, valid_samples, mse, mae, sqrt(mse) AS rmse, 1 - mse / v AS r2 FROM m""",
    ["predictions"], ["mse", "mae", "rmse", "r2"],
)
def regression(spark, sf):
    return metrics.regression_metrics(fx.predictions(spark, sf))


_RANKS = f"""WITH {_SCORED}, r AS (SELECT task,
  rank() OVER (PARTITION BY task ORDER BY y_true) + (count(*) OVER (PARTITION BY task, y_true) - 1) / 2.0E0 AS a,
  rank() OVER (PARTITION BY task ORDER BY y_pred) + (count(*) OVER (PARTITION BY task, y_pred) - 1) / 2.0E0 AS b FROM s)
"""


@register(
    "spearman", _RANKS + "SELECT task, count(*) AS valid_samples, corr(a, b) AS spearman FROM r GROUP BY task",
    ["predictions"], ["spearman"])
def spearman(spark, sf):
    return metrics.spearman(fx.predictions(spark, sf), with_p=False)


@register(
    "spearman_p_value",
    _RANKS + f""", c AS (SELECT task, count(*) AS valid_samples, corr(a, b) AS spearman FROM r GROUP BY task)
      SELECT *, {student_p_sql('(spearman * sqrt((valid_samples - 2) / (1 - spearman * spearman)))', '(valid_samples - 2)')} AS spearman_p FROM c""",
    ["predictions"], ["spearman", "spearman_p"])
def spearman_p(spark, sf):
    return metrics.spearman(fx.predictions(spark, sf))


@register(
    "average_ranks",
    """SELECT DISTINCT task, y_pred, rank() OVER (PARTITION BY task ORDER BY y_pred)
         + (count(*) OVER (PARTITION BY task, y_pred) - 1) / 2.0E0 AS avg_rank, count(*) OVER (PARTITION BY task) AS total
       FROM predictions""",
    ["predictions"], ["y_pred", "avg_rank"],
)
def average_ranks(spark, sf):
    return ordering.average_ranks(fx.predictions(spark, sf), ["task"], "y_pred")


_HALVES = """WITH l AS (SELECT *, CASE WHEN y_true > quantile_cont(y_true, 0.5) OVER (PARTITION BY task) THEN 1 ELSE 0 END AS label
       FROM predictions WHERE y_true IS NOT NULL)"""


@register("median_labels", _HALVES + " SELECT note_id, task, CAST(label AS INTEGER) AS label FROM l", ["predictions"])
def median_labels(spark, sf):
    return metrics.median_labels(fx.predictions(spark, sf)).select("note_id", "task", "label")


@register(
    "auc_rank",
    _HALVES + """, r AS (SELECT task, label, rank() OVER (PARTITION BY task ORDER BY y_pred)
         + (count(*) OVER (PARTITION BY task, y_pred) - 1) / 2.0E0 AS k FROM l),
       a AS (SELECT task, CAST(sum(label) AS BIGINT) AS positives, CAST(count(*) - sum(label) AS BIGINT) AS negatives,
             sum(label * k) AS s FROM r GROUP BY task)
       SELECT task, positives, negatives, (s - positives * (positives + 1) / 2) / (positives * 1.0E0 * negatives) AS auc FROM a""",
    ["predictions"], ["auc"],
)
def auc_rank(spark, sf):
    return metrics.auc(metrics.median_labels(fx.predictions(spark, sf)))


def _shape_sql(c):
    return f"""avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max,
      (avg({c} ** 3) - 3 * avg({c}) * avg({c} ** 2) + 2 * avg({c}) ** 3) / stddev_pop({c}) ** 3 AS {c}_skew,
      kurtosis_pop({c}) AS {c}_kurt"""


@register(
    "shape_compare",
    f"""WITH {_SCORED}, m AS (SELECT task, {_shape_sql('y_pred')}, {_shape_sql('y_true')} FROM s GROUP BY task)
    SELECT *,
      CASE WHEN y_pred_skew > 0.5 THEN 'right' WHEN y_pred_skew < -0.5 THEN 'left' ELSE 'symmetric' END AS y_pred_skew_label,
      CASE WHEN y_pred_kurt > 1 THEN 'heavy' WHEN y_pred_kurt < -1 THEN 'light' ELSE 'normal' END AS y_pred_kurt_label,
      CASE WHEN y_true_skew > 0.5 THEN 'right' WHEN y_true_skew < -0.5 THEN 'left' ELSE 'symmetric' END AS y_true_skew_label,
      CASE WHEN y_true_kurt > 1 THEN 'heavy' WHEN y_true_kurt < -1 THEN 'light' ELSE 'normal' END AS y_true_kurt_label,
      y_pred_mean - y_true_mean AS mean_diff, (y_pred_mean - y_true_mean) / y_true_mean * 100 AS mean_diff_pct,
      y_pred_std - y_true_std AS std_diff, (y_pred_std - y_true_std) / y_true_std * 100 AS std_diff_pct,
      abs(y_pred_skew - y_true_skew) < 0.5 AS skew_similar, abs(y_pred_kurt - y_true_kurt) < 1.0 AS kurt_similar,
      abs(y_pred_skew - y_true_skew) < 0.5 AND abs(y_pred_kurt - y_true_kurt) < 1.0 AS shape_similar FROM m""",
    ["predictions"],
    [f"{c}_{m}" for c in ("y_pred", "y_true") for m in ("mean", "std", "min", "max", "skew", "kurt")]
    + ["mean_diff", "mean_diff_pct", "std_diff", "std_diff_pct"],
)
def shape_compare(spark, sf):
    return metrics.compare_shapes(fx.predictions(spark, sf))


@register(
    "task_coverage",
    """SELECT DISTINCT task, 'not_fitted' AS issue FROM predictions WHERE task NOT IN ('ctr', 'fav_rate')
       UNION ALL SELECT 'fav_rate', 'not_predicted'""",
    ["predictions"],
)
def task_coverage(spark, sf):
    from postlens.operators.joins import task_coverage as coverage

    fitted = encoding.fit_labels(target_rows(spark, sf), {"ctr": "ctr", "fav_rate": "fav_rate"})
    return coverage(fx.predictions(spark, sf), fitted)
