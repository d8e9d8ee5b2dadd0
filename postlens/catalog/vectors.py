"""Vector columns, embedding quality, clusters, run histories, tau."""

from pyspark.sql import functions as F

from postlens.catalog import fixtures as fx
from postlens.catalog.registry import normal_p_sql, register, student_p_sql
from postlens.functions import vectors as vx
from postlens.operators import clustering, embedding, filters, history, kendall

DIM = 32
_NONZERO = "len(list_filter({v}, lambda x: x <> 0)) > 0"
_NORM = "sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def _cos(a, b):
    dot = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
    return f"CASE WHEN {_NORM.format(v=a)} * {_NORM.format(v=b)} > 0 THEN {dot} / ({_NORM.format(v=a)} * {_NORM.format(v=b)}) END"


def _audit_sql(v):
    heads = ", ".join(f"avg(CAST({v}[{k}] AS DOUBLE))" for k in range(1, 6))
    stds = ", ".join(f"stddev_pop(CAST({v}[{k}] AS DOUBLE))" for k in range(1, 6))
    norm, zero = _NORM.format(v=v), f"NOT ({_NONZERO.format(v=v)})"
    return f"""SELECT '{v}' AS vector, CAST(max(len({v})) AS INTEGER) AS dims, count(*) FILTER (WHERE {zero}) AS zero_rows,
      count(*) AS rows, count(*) FILTER (WHERE {zero}) * 100.0E0 / count(*) AS zero_pct, avg({norm}) AS norm_mean,
      stddev_pop({norm}) AS norm_std, list_sum([{heads}]) AS means_sum, list_sum([{stds}]) AS stds_sum FROM note_vectors"""


@register("vector_audit", _audit_sql("image_vec") + " UNION ALL " + _audit_sql("text_vec"), ["note_vectors"],
          ["zero_pct", "norm_mean", "norm_std", "means_sum", "stds_sum"])
def vector_audit(spark, sf):
    audit = embedding.vector_audit(fx.note_vectors(spark, sf), ["image_vec", "text_vec"])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return audit.withColumns({"means_sum": total("first_means"), "stds_sum": total("first_stds")}).drop("first_means", "first_stds")


@register(
    "norm_histogram",
    f"""WITH n AS (SELECT {_NORM.format(v='image_vec')} AS norm FROM note_vectors),
      e AS (SELECT min(norm) AS lo, max(norm) AS hi FROM n)
      SELECT CAST(least(floor((norm - lo) / (hi - lo) * 50) + 1, 50) AS INTEGER) AS bin, count(*) AS n FROM n, e GROUP BY 1""",
    ["note_vectors"],
)
def histogram(spark, sf):
    return embedding.norm_histogram(fx.note_vectors(spark, sf), "image_vec")


@register("zero_vector_filter", f"SELECT note_id FROM note_vectors WHERE {_NONZERO.format(v='image_vec')}", ["note_vectors"])
def zero_filter(spark, sf):
    return filters.drop_zero_vectors(fx.note_vectors(spark, sf), ["image_vec", "absent_vec"]).select("note_id")


@register(
    "zero_vector_filter_any",
    f"SELECT note_id FROM note_vectors WHERE {_NONZERO.format(v='image_vec')} OR {_NONZERO.format(v='text_vec')}", ["note_vectors"])
def zero_filter_any(spark, sf):
    return filters.drop_zero_vectors(fx.note_vectors(spark, sf), ["image_vec", "text_vec"]).select("note_id")


@register(
    "vector_expand",
    "SELECT note_id, " + ", ".join(f"image_vec[{i + 1}] AS cover_image_feat_{i}" for i in range(DIM)) + " FROM note_vectors",
    ["note_vectors"], [f"cover_image_feat_{i}" for i in range(DIM)],
)
def expand(spark, sf):
    return fx.note_vectors(spark, sf).select("note_id", *vx.expand("image_vec", "cover_image_feat_", DIM))


@register(
    "vector_pack",
    f"SELECT note_id, {_NORM.format(v='image_vec')} AS norm, image_vec[11] AS tenth, len(image_vec)::INTEGER AS dims FROM note_vectors",
    ["note_vectors"], ["norm", "tenth"],
)
def pack(spark, sf):
    wide = fx.note_vectors(spark, sf).select("note_id", *vx.expand("image_vec", "image_feat_", DIM))
    wide = filters.rename_vectors(wide)
    packed = wide.select("note_id", vx.pack([c for c in wide.columns if c.startswith("cover_image_feat_")]).alias("v"))
    return packed.select("note_id", vx.l2_norm(F.col("v")).alias("norm"), F.col("v")[10].alias("tenth"), F.size("v").alias("dims"))


_DIMS = "e AS (SELECT note_id, cluster, vec_id, unnest(image_vec) AS x, generate_subscripts(image_vec, 1) - 1 AS dim FROM note_vectors)"


def _pool_sql(fn):
    return f"WITH {_DIMS} SELECT vec_id % 40 AS owner, CAST(dim AS INTEGER) AS dim, {fn}(CAST(x AS DOUBLE)) AS x FROM e GROUP BY 1, 2"


def _pooled(spark, sf, how):
    rows = fx.note_vectors(spark, sf).select((F.col("vec_id") % 40).alias("owner"), "image_vec")
    return embedding.pool_rows(rows, "owner", "image_vec", DIM, how).select("owner", F.posexplode("pooled").alias("dim", "x"))


@register("vector_pool_mean", _pool_sql("avg"), ["note_vectors"], ["x"])
def pool_mean(spark, sf):
    return _pooled(spark, sf, "mean")


@register("vector_pool_max", _pool_sql("max"), ["note_vectors"], ["x"])
def pool_max(spark, sf):
    return _pooled(spark, sf, "max")


@register(
    "vector_normalise",
    f"""WITH n AS (SELECT note_id, {_NORM.format(v='image_vec')} AS norm, image_vec FROM note_vectors),
      e AS (SELECT note_id, norm, unnest(image_vec) AS x, generate_subscripts(image_vec, 1) - 1 AS dim FROM n)
      SELECT note_id, CAST(dim AS INTEGER) AS dim, CASE WHEN norm > 0 THEN x / norm ELSE 0 END AS x FROM e""",
    ["note_vectors"], ["x"],
)
def normalise(spark, sf):
    rows = fx.note_vectors(spark, sf)
    return rows.select("note_id", F.posexplode(vx.l2_normalise(F.col("image_vec"))).alias("dim", "x"))


@register(
    "feature_cross",
    "SELECT note_id, " + ", ".join(
        f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS {n}"
        for a, b, n in (("image_vec", "text_vec", "image_vec_x_text_vec"), ("image_vec", "list_reverse(text_vec)", "image_vec_x_back_vec"),
                        ("text_vec", "list_reverse(text_vec)", "text_vec_x_back_vec")))
    + " FROM note_vectors",
    ["note_vectors"], ["image_vec_x_text_vec", "image_vec_x_back_vec", "text_vec_x_back_vec"],
)
def cross(spark, sf):
    rows = fx.note_vectors(spark, sf).withColumn("back_vec", F.reverse("text_vec"))
    return rows.select("note_id", *vx.field_products(["image_vec", "text_vec", "back_vec"]))


@register(
    "dim_variance",
    f"""WITH {_DIMS}, v AS (SELECT CAST(dim AS INTEGER) AS dim, var_pop(CAST(x AS DOUBLE)) AS variance FROM e GROUP BY 1)
      SELECT dim, variance, CASE WHEN variance < 1e-6 THEN 'zero' WHEN variance < 0.01 THEN 'low' WHEN variance < 0.1 THEN 'medium' ELSE 'high' END AS level,
      sqrt(variance) > 1e-6 AS effective FROM v""",
    ["note_vectors"], ["variance"],
)
def dim_variance(spark, sf):
    return embedding.dimension_variance(fx.note_vectors(spark, sf), "image_vec")


@register(
    "dim_variance_summary",
    f"""WITH {_DIMS}, v AS (SELECT dim, var_pop(CAST(x AS DOUBLE)) AS v FROM e GROUP BY 1)
      SELECT count(*) FILTER (WHERE v < 1e-6) AS zero_dims, count(*) FILTER (WHERE v >= 1e-6 AND v < 0.01) AS low_dims,
      count(*) FILTER (WHERE v >= 0.01 AND v < 0.1) AS medium_dims, count(*) FILTER (WHERE v >= 0.1) AS high_dims, count(*) AS dims,
      avg(v) AS mean_variance, median(v) AS median_variance, count(*) FILTER (WHERE sqrt(v) > 1e-6) AS effective_dims,
      count(*) FILTER (WHERE sqrt(v) > 1e-6) < 10 AS few_effective FROM v""",
    ["note_vectors"], ["mean_variance", "median_variance"],
)
def dim_summary(spark, sf):
    return embedding.variance_summary(embedding.dimension_variance(fx.note_vectors(spark, sf), "image_vec"))


def _listed(names):
    """Names with commas between; none give NULL, as string_agg does."""
    return F.when(F.size(names) > 0, F.array_join(names, ","))


_PAIRS = f"""WITH {_DIMS}, c AS (SELECT CAST(a.dim AS INTEGER) AS i, CAST(b.dim AS INTEGER) AS j, corr(CAST(a.x AS DOUBLE), CAST(b.x AS DOUBLE)) AS r
  FROM e a JOIN e b ON a.note_id = b.note_id AND a.dim < b.dim GROUP BY 1, 2)
"""


@register("dim_correlation", _PAIRS + "SELECT * FROM c", ["note_vectors"], ["r"])
def dim_correlation(spark, sf):
    return embedding.dimension_pairs(fx.note_vectors(spark, sf), "image_vec")


@register(
    "dim_correlation_summary",
    _PAIRS + """SELECT avg(abs(r)) AS mean_correlation, max(abs(r)) AS max_correlation, count(*) FILTER (WHERE abs(r) > 0.1) AS high_pairs,
      count(*) AS pairs, (SELECT string_agg(i || '-' || j, ',' ORDER BY i, j) FROM (SELECT i, j FROM c WHERE abs(r) > 0.1 ORDER BY i, j LIMIT 10)) AS first_high FROM c""",
    ["note_vectors"], ["mean_correlation", "max_correlation"],
)
def dim_correlation_summary(spark, sf):
    s = embedding.pair_summary(embedding.dimension_pairs(fx.note_vectors(spark, sf), "image_vec"), 0.1)
    names = F.transform("first_high", lambda p: F.concat(p["i"].cast("string"), F.lit("-"), p["j"].cast("string")))
    return s.withColumn("first_high", _listed(names))


def _labelled(spark, sf):
    return fx.note_vectors(spark, sf).withColumn("label", (F.col("vec_id") * 37 % 101) / 101.0)


@register(
    "dim_label_corr",
    f"WITH {_DIMS} SELECT CAST(dim AS INTEGER) AS dim, corr(CAST(x AS DOUBLE), (vec_id * 37 % 101) / 101.0E0) AS r FROM e GROUP BY 1",
    ["note_vectors"], ["r"],
)
def dim_label(spark, sf):
    return embedding.label_correlation(_labelled(spark, sf), "image_vec", "label")


@register(
    "dim_label_corr_summary",
    f"""WITH {_DIMS}, r AS (SELECT dim, corr(CAST(x AS DOUBLE), (vec_id * 37 % 101) / 101.0E0) AS r FROM e GROUP BY 1)
      SELECT max(abs(r)) AS max_correlation, avg(abs(r)) AS mean_correlation, count(*) FILTER (WHERE abs(r) > 0.1) AS significant_dims,
      (SELECT string_agg(CAST(dim AS VARCHAR), ',' ORDER BY abs(r) DESC, dim) FROM (SELECT * FROM r ORDER BY abs(r) DESC, dim LIMIT 10)) AS top_dims FROM r""",
    ["note_vectors"], ["max_correlation", "mean_correlation"],
)
def dim_label_summary(spark, sf):
    s = embedding.label_correlation_summary(embedding.label_correlation(_labelled(spark, sf), "image_vec", "label"))
    return s.withColumn("top_dims", _listed(F.col("top_dims")))


_SIMS = f"""
WITH same AS (SELECT 'same' AS kind, {_cos('image_vec', 'text_vec')} AS similarity FROM note_vectors),
li AS (SELECT note_id AS id_i, image_vec AS v_i, row_number() OVER (ORDER BY md5('i' || note_id), note_id) AS k FROM note_vectors),
lj AS (SELECT note_id AS id_j, text_vec AS v_j, row_number() OVER (ORDER BY md5('j' || note_id), note_id) AS k FROM note_vectors),
rnd AS (SELECT 'random' AS kind, {_cos('v_i', 'v_j')} AS similarity FROM li JOIN lj USING (k) WHERE id_i <> id_j),
sims AS (SELECT * FROM same WHERE similarity IS NOT NULL UNION ALL SELECT * FROM rnd WHERE similarity IS NOT NULL)
"""


def _similarities(spark, sf):
    return embedding.pair_similarities(fx.note_vectors(spark, sf), "note_id", "image_vec", "text_vec")


@register("alignment", _SIMS + "SELECT kind, avg(similarity) AS mean, stddev_pop(similarity) AS std, count(*) AS n FROM sims GROUP BY kind",
          ["note_vectors"], ["mean", "std"])
def alignment(spark, sf):
    return embedding.alignment(_similarities(spark, sf))


_SIDES = """, m AS (SELECT avg(similarity) FILTER (WHERE kind = 'same') AS a, var_pop(similarity) FILTER (WHERE kind = 'same') AS va,
  count(*) FILTER (WHERE kind = 'same') * 1.0E0 AS na, avg(similarity) FILTER (WHERE kind = 'random') AS b,
  var_pop(similarity) FILTER (WHERE kind = 'random') AS vb, count(*) FILTER (WHERE kind = 'random') * 1.0E0 AS nb FROM sims)
"""


@register("cohens_d", _SIMS + _SIDES + "SELECT (a - b) / sqrt((va + vb) / 2) AS cohens_d FROM m", ["note_vectors"], ["cohens_d"])
def effect(spark, sf):
    return embedding.cohens_d(_similarities(spark, sf))


@register(
    "t_test", _SIMS + _SIDES + "SELECT (a - b) / sqrt((va * na + vb * nb) / (na + nb - 2) * (1 / na + 1 / nb)) AS t_statistic, na + nb - 2 AS dof FROM m",
    ["note_vectors"], ["t_statistic", "dof"])
def t_test(spark, sf):
    return embedding.t_test(_similarities(spark, sf), with_p=False)


@register(
    "t_test_p_value",
    _SIMS + _SIDES + f""", t AS (SELECT (a - b) / sqrt((va * na + vb * nb) / (na + nb - 2) * (1 / na + 1 / nb)) AS t_statistic, na + nb - 2 AS dof FROM m)
      SELECT t_statistic, dof, {student_p_sql('t_statistic', 'dof')} AS p_value FROM t""",
    ["note_vectors"], ["t_statistic", "dof", "p_value"])
def t_test_p(spark, sf):
    return embedding.t_test(_similarities(spark, sf))


_CATS = "c AS (SELECT cluster, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE CAST(vec_id % 4 AS VARCHAR) END AS taxonomy1, CAST(vec_id % 3 AS VARCHAR) AS intention_lv1 FROM note_vectors)"


def _purity_sql(cat):
    return f"""SELECT '{cat}' AS category, avg(p) AS purity FROM (SELECT cluster, max(CASE WHEN {cat} IS NULL THEN 0 ELSE n END) * 1.0E0 / sum(n) AS p
      FROM (SELECT cluster, {cat}, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY cluster)"""


@register("purity", f"WITH {_CATS} " + _purity_sql("taxonomy1") + " UNION ALL " + _purity_sql("intention_lv1"), ["note_vectors"], ["purity"])
def purity(spark, sf):
    v = F.col("vec_id")
    rows = fx.note_vectors(spark, sf).select(
        "cluster", F.when(v % 11 != 0, (v % 4).cast("string")).alias("taxonomy1"), (v % 3).cast("string").alias("intention_lv1"))
    return clustering.purity(rows, ["taxonomy1", "taxonomy2", "intention_lv1"])


_CENTRES = f"""WITH {_DIMS}, m AS (SELECT cluster, dim, avg(CAST(x AS DOUBLE)) AS c FROM e GROUP BY 1, 2),
  d AS (SELECT e.note_id, e.cluster, sqrt(sum((x - c) ** 2)) AS d FROM e JOIN m ON e.cluster = m.cluster AND e.dim = m.dim GROUP BY 1, 2),
  s AS (SELECT cluster, avg(d) AS s FROM d GROUP BY 1),
  g AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(sum((a.c - b.c) ** 2)) AS gap FROM m a JOIN m b ON a.dim = b.dim AND a.cluster <> b.cluster GROUP BY 1, 2),
  r AS (SELECT i, max((x.s + y.s) / gap) AS r FROM g JOIN s x ON x.cluster = i JOIN s y ON y.cluster = j GROUP BY i)
"""


@register("davies_bouldin", _CENTRES + "SELECT avg(r) AS davies_bouldin FROM r", ["note_vectors"], ["davies_bouldin"])
def davies_bouldin(spark, sf):
    return clustering.davies_bouldin(fx.note_vectors(spark, sf), "image_vec")


@register(
    "silhouette_sq",
    f"""WITH {_DIMS}, p AS (SELECT a.note_id AS i, a.cluster AS ci, b.note_id AS j, b.cluster AS cj, sum((CAST(a.x AS DOUBLE) - b.x) ** 2) AS d
        FROM e a JOIN e b ON a.dim = b.dim GROUP BY 1, 2, 3, 4),
      own AS (SELECT i, sum(d) / greatest(count(*) - 1, 1) AS a, count(*) AS n FROM p WHERE ci = cj GROUP BY i),
      oth AS (SELECT i, min(m) AS b FROM (SELECT i, cj, avg(d) AS m FROM p WHERE ci <> cj GROUP BY i, cj) GROUP BY i)
      SELECT avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette_sq FROM own JOIN oth USING (i)""",
    ["note_vectors"], ["silhouette_sq"],
)
def silhouette(spark, sf):
    score = clustering.silhouette_squared(fx.note_vectors(spark, sf), "image_vec")
    return spark.createDataFrame([(float(score),)], "silhouette_sq double")


@register(
    "silhouette_sampled",
    f"""WITH smp AS (SELECT * FROM note_vectors ORDER BY md5('42' || note_id), note_id LIMIT 1000),
      e AS (SELECT note_id, cluster, unnest(image_vec) AS x, generate_subscripts(image_vec, 1) AS dim FROM smp),
      p AS (SELECT a.note_id AS i, a.cluster AS ci, b.note_id AS j, b.cluster AS cj, sqrt(sum((CAST(a.x AS DOUBLE) - b.x) ** 2)) AS d
        FROM e a JOIN e b ON a.dim = b.dim AND a.note_id <> b.note_id GROUP BY 1, 2, 3, 4),
      own AS (SELECT i, avg(d) AS a FROM p WHERE ci = cj GROUP BY i),
      oth AS (SELECT i, min(m) AS b FROM (SELECT i, cj, avg(d) AS m FROM p WHERE ci <> cj GROUP BY i, cj) GROUP BY i)
      SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM oth LEFT JOIN own USING (i)""",
    ["note_vectors"], ["silhouette"],
)
def silhouette_sampled(spark, sf):
    return clustering.silhouette_euclidean(fx.note_vectors(spark, sf), "note_id", "image_vec")


_TIES = "sum(k * (k - 1) / 2) AS t, sum(1.0E0 * k * (k - 1) * (k - 2)) AS t0, sum(1.0E0 * k * (k - 1) * (2 * k + 5)) AS t1"
_PAIRS = f"""WITH s AS (SELECT task, row_number() OVER () AS id, y_true, y_pred FROM predictions WHERE y_true IS NOT NULL),
      c AS (SELECT a.task, count(*) FILTER (WHERE (a.y_true < b.y_true AND a.y_pred < b.y_pred)) AS c,
        count(*) FILTER (WHERE (a.y_true < b.y_true AND a.y_pred > b.y_pred)) AS d FROM s a JOIN s b ON a.task = b.task GROUP BY 1),
      n AS (SELECT task, count(*) AS n FROM s GROUP BY 1),
      tx AS (SELECT task, {_TIES} FROM (SELECT task, y_true, count(*) AS k FROM s GROUP BY 1, 2) GROUP BY 1),
      ty AS (SELECT task, {_TIES} FROM (SELECT task, y_pred, count(*) AS k FROM s GROUP BY 1, 2) GROUP BY 1)"""


@register(
    "kendall_tau_b",
    _PAIRS + """ SELECT task, n AS valid_samples, c AS concordant, d AS discordant,
        (c - d) / (sqrt(n * (n - 1) / 2 - tx.t) * sqrt(n * (n - 1) / 2 - ty.t)) AS kendall_tau
      FROM c JOIN n USING (task) JOIN tx USING (task) JOIN ty USING (task)""",
    ["predictions"], ["kendall_tau"],
)
def tau(spark, sf):
    """Pairs as whole numbers; here they fit in 64 bits."""
    rows = kendall.kendall_tau(fx.predictions(spark, sf), with_p=False)
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("concordant", "discordant")})


@register(
    "spectrum_moments",
    f"""WITH {_DIMS}, w AS (SELECT note_id FROM e GROUP BY 1 HAVING bool_or(x <> 0)),
      c AS (SELECT a.dim AS i, b.dim AS j, covar_samp(CAST(a.x AS DOUBLE), CAST(b.x AS DOUBLE)) AS c
            FROM e a JOIN e b USING (note_id) JOIN w USING (note_id) GROUP BY 1, 2)
      SELECT count(DISTINCT i) AS dims, 1.0E0 AS ratio_sum, sum(c * c) / pow(sum(c) FILTER (WHERE i = j), 2) AS ratio_square_sum FROM c""",
    ["note_vectors"], ["ratio_sum", "ratio_square_sum"],
)
def spectrum_moments(spark, sf):
    """The ratios add to one, and their squares to the covariance's squared norm over its squared trace."""
    ratios = embedding.explained_variance(fx.note_vectors(spark, sf), "image_vec")
    return ratios.agg(F.count(F.lit(1)).alias("dims"), F.sum("ratio").alias("ratio_sum"), F.sum(F.col("ratio") ** 2).alias("ratio_square_sum"))


@register(
    "kendall_p_value",
    _PAIRS + f""", v AS (SELECT task, c - d AS gap, (1.0E0 * n * (n - 1) * (2 * n + 5) - tx.t1 - ty.t1) / 18
        + 2.0E0 * tx.t * ty.t / (n * (n - 1)) + tx.t0 * ty.t0 / (9.0E0 * n * (n - 1) * (n - 2)) AS var
        FROM c JOIN n USING (task) JOIN tx USING (task) JOIN ty USING (task))
      SELECT task, {normal_p_sql("(gap / sqrt(var))")} AS kendall_p FROM v""",
    ["predictions"], ["kendall_p"],
)
def tau_p(spark, sf):
    return kendall.kendall_tau(fx.predictions(spark, sf)).select("task", "kendall_p")


@register(
    "throughput_trend",
    """WITH m AS (SELECT run_id, batch, seconds,
        avg(seconds) OVER (PARTITION BY run_id ORDER BY batch ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean_last10,
        avg(seconds) OVER (PARTITION BY run_id ORDER BY batch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean_last3,
        avg(seconds) OVER (PARTITION BY run_id ORDER BY batch ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS mean_before3 FROM batch_metrics)
      SELECT *, CASE WHEN batch < 5 THEN 'unknown' WHEN mean_last3 > mean_before3 * 1.2 THEN 'slowing'
        WHEN mean_last3 < mean_before3 * 0.8 THEN 'speeding' ELSE 'steady' END AS trend FROM m""",
    ["batch_metrics"], ["seconds", "mean_last10", "mean_last3", "mean_before3"],
)
def trend(spark, sf):
    return history.throughput_trend(fx.batch_metrics(spark, sf))


@register(
    "training_quality",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) AS k FROM epoch_history),
      l AS (SELECT run_id, max(loss) - min(loss) AS last5_range FROM r WHERE k <= 5 GROUP BY 1),
      e AS (SELECT run_id, count(*) AS epochs, arg_min(loss, epoch) AS first_loss, arg_max(loss, epoch) AS final_loss,
        arg_min(val_loss, epoch) AS first_val_loss, arg_max(val_loss, epoch) AS final_val_loss FROM epoch_history GROUP BY 1)
      SELECT e.*, last5_range, epochs > 5 AND last5_range > 0.01 AS unconverged,
        CASE WHEN first_loss <> 0 THEN (first_loss - final_loss) / first_loss * 100 ELSE 0 END AS reduction_pct,
        final_val_loss > final_loss * 1.5 AS overfitting,
        NOT (final_val_loss > final_loss * 1.5) AND final_val_loss > 0.1 AND final_loss > 0.1 AS underfitting,
        final_val_loss < final_loss * 0.8 AS generalises FROM e JOIN l USING (run_id)""",
    ["epoch_history"],
    ["last5_range", "first_loss", "final_loss", "first_val_loss", "final_val_loss", "reduction_pct"], ["reduction_pct"],
)
def training_quality(spark, sf):
    return history.training_quality(fx.epoch_history(spark, sf))


@register(
    "model_ranking",
    """WITH m AS (SELECT concat('m', CAST(run_id AS VARCHAR)) AS model, avg(loss) AS mse, min(loss) - 0.5 AS r2,
        0.3 - avg(val_loss) AS spearman, sum(val_loss) AS seconds FROM epoch_history GROUP BY run_id),
      u AS (SELECT 'best_fit' AS criterion, model, mse AS value, abs(mse) AS k FROM m UNION ALL SELECT 'best_r2', model, r2, -abs(r2) FROM m
        UNION ALL SELECT 'best_ranking', model, spearman, -abs(spearman) FROM m UNION ALL SELECT 'fastest', model, seconds, abs(seconds) FROM m)
      SELECT criterion, model, value FROM (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY round(k, 9), model) AS p FROM u) WHERE p = 1""",
    ["epoch_history"], ["value"],
)
def ranking(spark, sf):
    runs = fx.epoch_history(spark, sf).groupBy(F.concat(F.lit("m"), F.col("run_id").cast("string")).alias("model")).agg(
        F.avg("loss").alias("mse"), (F.min("loss") - 0.5).alias("r2"),
        (0.3 - F.avg("val_loss")).alias("spearman"), F.sum("val_loss").alias("seconds"))
    return history.model_ranking(runs.withColumns({c: F.round(c, 9) for c in ("mse", "r2", "spearman", "seconds")}))


@register("pca_dims")
def pca_dims(spark, sf):
    return embedding.pca_dims(embedding.explained_variance(fx.note_vectors(spark, sf), "image_vec"))
