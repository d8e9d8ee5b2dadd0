"""Feature preparation, per-task models, batch scoring and their evaluation."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import FMRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions.literals import literal_rows
from postlens.functions.numeric import clip_rate, impression_count, is_rate_task
from postlens.operators import encoding, metrics, ridge
from postlens.operators.contracts import fill_absent
from postlens.operators.filters import drop_zero_vectors
from postlens.operators.history import model_ranking
from postlens.operators.kendall import kendall_tau
from postlens.operators.projection import CentredPca, fit_pca
from postlens.operators.targets import task_columns
from postlens.session import cut_lineage


@dataclass(frozen=True)
class FeatureSpec:
    """What goes into the feature vector and how.

    pca_order "first" projects the joined raw vectors and then scales (multi-task form); "scaled" scales
    each vector group and then projects each by itself (single-task form).
    """

    sparse: list[str] = field(default_factory=list)
    dense: list[str] = field(default_factory=list)
    vectors: dict[str, int] = field(default_factory=dict)
    fill: str = "missing"
    unseen: str = "zero"
    filter_zeros: bool = True
    pca: int | None = None
    pca_order: str = "first"


@dataclass(frozen=True)
class FeatureModel:
    """Fitted preparation: small tables and Spark ML models, applied to any rows with the same columns."""

    spec: FeatureSpec
    vocabulary: DataFrame | None
    scaler: DataFrame | None
    vector_scalers: dict[str, DataFrame]
    pcas: dict[str, CentredPca]

    def transform(self, df: DataFrame, drop_zero: bool = False, name: str = "features") -> DataFrame:
        """Adds the feature vector. Rows keep their identity; targets travel with them."""
        spec = self.spec
        rows = fill_absent(df, [], spec.dense, spec.vectors)
        known = [c for c in spec.sparse if c in df.columns]
        if drop_zero and spec.vectors:
            rows = drop_zero_vectors(rows, list(spec.vectors))
        if known:
            rows = encoding.encode(rows, self.vocabulary, known, spec.fill, spec.unseen)
        if spec.dense:
            scaled = rows.withColumns({f"{c}_scaled": F.col(c) for c in spec.dense})
            rows = encoding.scale(scaled, _suffixed(self.scaler), [f"{c}_scaled" for c in spec.dense])
        codes = [F.col(f"{c}_code") if c in known else F.lit(0) for c in spec.sparse]
        parts = [F.array(*[c.cast("double") for c in [*codes, *[F.col(f"{c}_scaled") for c in spec.dense]]])] \
            if codes or spec.dense else []
        for group, columns in _groups(spec).items():
            rows = rows.withColumn("_g", F.concat(*[F.transform(c, lambda x: x.cast("double")) for c in columns]))
            rows = self._group(rows, group)
            rows = rows.withColumnRenamed("_g", f"_{group}")
            parts.append(F.col(f"_{group}"))
        helper = [f"{c}_code" for c in known] + [f"{c}_scaled" for c in spec.dense] + [f"_{g}" for g in _groups(spec)]
        return rows.withColumn(name, array_to_vector(F.concat(*parts))).drop(*helper)

    def _group(self, rows: DataFrame, group: str) -> DataFrame:
        steps = ["pca", "scale"] if self.spec.pca_order == "first" else ["scale", "pca"]
        for step in steps:
            if step == "pca" and group in self.pcas:
                rows = self.pcas[group].transform(rows, "_g", "_g")
            if step == "scale":
                rows = encoding.scale_vector(rows, self.vector_scalers[group], "_g", "_g")
        return rows

    def save(self, path: str) -> None:
        """Parquet tables, Spark ML models and a JSON line; no pickle."""
        spark = _session(self)
        spark.createDataFrame([(json.dumps(asdict(self.spec)),)], "spec string").write.mode("overwrite").text(f"{path}/spec")
        if self.vocabulary is not None:
            self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        if self.scaler is not None:
            self.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
        for group, table in self.vector_scalers.items():
            table.write.mode("overwrite").parquet(f"{path}/vector_scaler/group={group}")
        for group, pca in self.pcas.items():
            pca.save(f"{path}/pca_{group}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FeatureModel:
        spec = FeatureSpec(**json.loads(spark.read.text(f"{path}/spec").head()[0]))
        groups = _groups(spec)
        return FeatureModel(
            spec,
            spark.read.parquet(f"{path}/vocabulary") if spec.sparse else None,
            spark.read.parquet(f"{path}/scaler") if spec.dense else None,
            {g: spark.read.parquet(f"{path}/vector_scaler/group={g}") for g in groups},
            {g: CentredPca.load(spark, f"{path}/pca_{g}") for g in groups} if spec.pca else {},
        )

    def report(self, columns: Sequence[str]) -> DataFrame:
        """A37 by kind: features asked for and absent from the columns given."""
        spec = self.spec
        rows = [
            (kind, len(names), [n for n in names if n not in columns])
            for kind, names in (("sparse", spec.sparse), ("dense", spec.dense), ("vector", list(spec.vectors)))
        ]
        return literal_rows(_session(self), rows, "kind string, features int, missing array<string>")


def _session(model: FeatureModel) -> SparkSession:
    for table in (model.vocabulary, model.scaler, *model.vector_scalers.values()):
        if table is not None:
            return table.sparkSession
    return SparkSession.active()


def _groups(spec: FeatureSpec) -> dict[str, list[str]]:
    if not spec.vectors:
        return {}
    return {"clip": list(spec.vectors)} if spec.pca_order == "first" else {v: [v] for v in spec.vectors}


def _suffixed(scaler: DataFrame) -> DataFrame:
    return scaler.withColumn("feature", F.concat("feature", F.lit("_scaled")))


def fit_features(df: DataFrame, spec: FeatureSpec, vocabulary_rows: DataFrame | None = None) -> FeatureModel:
    """Vocabularies, scalers and PCA from the rows given, which should be the training rows.

    The vocabulary is fitted before the zero-vector filter, on `vocabulary_rows` where given.
    """
    rows = drop_zero_vectors(df, list(spec.vectors)) if spec.filter_zeros and spec.vectors else df
    sparse = [c for c in spec.sparse if c in df.columns]
    vocabulary = encoding.fit_vocabulary(df if vocabulary_rows is None else vocabulary_rows, sparse, spec.fill) \
        if sparse else None
    scaler = encoding.fit_scaler(rows, spec.dense) if spec.dense else None
    scalers, pcas = {}, {}
    for group, columns in _groups(spec).items():
        part = rows.select(F.concat(*[F.transform(c, lambda x: x.cast("double")) for c in columns]).alias("_g"))
        if spec.pca and spec.pca_order == "first":
            pcas[group] = fit_pca(part, "_g", spec.pca)
            part = pcas[group].transform(part, "_g", "_g")
        scalers[group] = encoding.fit_vector_scaler(part, "_g")
        if spec.pca and spec.pca_order != "first":
            pcas[group] = fit_pca(encoding.scale_vector(part, scalers[group], "_g", "_g"), "_g", spec.pca)
    return FeatureModel(spec, vocabulary, scaler, scalers, pcas)


def default_regressors(seed: int = 42) -> dict[str, Estimator]:
    """M7: the model families that Spark ML has; the factorisation machine stands for the interaction models."""
    return {
        "linear": LinearRegression(regParam=0.01),
        "forest": RandomForestRegressor(numTrees=50, maxDepth=5, seed=seed),
        "boosted": GBTRegressor(maxIter=20, maxDepth=4, seed=seed),
        "factorisation": FMRegressor(factorSize=4, maxIter=50, stepSize=0.05, seed=seed),
    }


def score_table(scored: DataFrame, label: str, prediction: str = "prediction", task: str = "label") -> DataFrame:
    return scored.select(
        F.lit(task).alias("task"), F.col(label).cast("double").alias("y_true"), F.col(prediction).cast("double").alias("y_pred"))


def compare_models(
    train: DataFrame, test: DataFrame, label: str, models: Mapping[str, Estimator] | None = None, features: str = "features", threads: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """M7: (scores, ranking). A model that fails keeps its line, with the error and no metrics.

    Models are fitted side by side, so `seconds` holds waiting for each other's tasks; the metrics of all come from one
    table of predictions."""
    spark = train.sparkSession

    def run(item: tuple[str, Estimator]) -> tuple[str, float, DataFrame | None, str | None]:
        name, estimator = item
        start = time.time()
        try:
            params = {estimator.getParam("featuresCol"): features, estimator.getParam("labelCol"): label}
            model = estimator.fit(train, params)
            seconds = time.time() - start
            return name, seconds, cut_lineage(score_table(model.transform(test), label, task=name)), None
        except (IllegalArgumentException, AnalysisException, ValueError) as error:  # a model that does not fit these rows
            return name, time.time() - start, None, str(error)

    with ThreadPool(threads) as pool:
        fitted = pool.map(run, list((models or default_regressors()).items()), chunksize=1)
    scored = [p for _, _, p, _ in fitted if p is not None]
    lines = {}
    if scored:
        predictions = reduce(DataFrame.unionByName, scored)
        table = (
            metrics.regression_metrics(predictions)
            .join(metrics.spearman(predictions, with_p=False).select("task", "spearman"), "task")
            .join(kendall_tau(predictions, with_p=False).select("task", "kendall_tau"), "task")
        )
        lines = {r["task"]: r.asDict() for r in table.collect()}
    rows = [
        (name, *[lines.get(name, {}).get(c) for c in ("mse", "mae", "rmse", "r2", "spearman", "kendall_tau")], seconds, error)
        for name, seconds, _, error in fitted]
    scores = literal_rows(
        spark, rows,
        "model string, mse double, mae double, rmse double, r2 double, spearman double, kendall_tau double,"
        " seconds double, error string")
    return scores, model_ranking(scores.where(F.col("error").isNull()))


@dataclass(frozen=True)
class TaskModels:
    """M8: one regressor per task on the same features, with the label statistics they were trained under."""

    models: dict[str, Model]
    labels: DataFrame

    def score(self, prepared: DataFrame, key: str = "note_id") -> DataFrame:
        """Long predictions: key, task, y_true (where the target exists), y_pred in label units."""
        rows = prepared
        for task, model in self.models.items():
            rows = model.transform(rows).withColumnRenamed("prediction", f"{task}_raw")
        columns = task_columns(self.models)
        lines = F.array(*[
            F.struct(
                F.lit(t).alias("task"),
                (F.col(columns[t]).cast("double") if columns[t] in prepared.columns else F.lit(None).cast("double")).alias("y_true"),
                F.col(f"{t}_raw").alias("y_raw"))
            for t in self.models])
        return encoding.denormalise(rows.select(key, F.inline(lines)), self.labels, "y_raw", "y_pred")

    def save(self, path: str) -> None:
        self.labels.write.mode("overwrite").parquet(f"{path}/labels")
        for task, model in self.models.items():
            model.write().overwrite().save(f"{path}/model_{task}")

    @staticmethod
    def load(spark: SparkSession, path: str, tasks: Sequence[str], kind: type[Model]) -> TaskModels:
        models = {t: kind.load(f"{path}/model_{t}") for t in tasks}
        return TaskModels(models, spark.read.parquet(f"{path}/labels"))


def fit_tasks(
    train: DataFrame, tasks: Sequence[str], estimator: Callable[[], Estimator] = lambda: LinearRegression(regParam=0.01),
    normalisation: str = "standard", features: str = "features",
) -> TaskModels:
    """M8 on prepared rows that hold `features` and the target columns; any Spark ML regressor may be given."""
    columns = task_columns(tasks)
    # The statistics are one row per task; written to the plan as constants, so scoring does not read training rows again.
    fitted = encoding.fit_labels(train, columns, normalisation)
    labels = literal_rows(
        train.sparkSession, [tuple(r) for r in fitted.collect()], "task string, method string, center double, scale double")
    normal = encoding.normalise_labels(train, labels, columns).persist()
    models = {}
    for task in tasks:
        known = normal.where(F.col(f"{task}_norm").isNotNull())
        est = estimator()
        models[task] = est.fit(known, {est.getParam("featuresCol"): features, est.getParam("labelCol"): f"{task}_norm"})
    normal.unpersist()
    return TaskModels(models, labels)


@dataclass(frozen=True)
class LinearTasks:
    """M8: linear models of all tasks, fitted from one table of sums: small tables, and scores in one pass."""

    model: DataFrame
    labels: DataFrame

    def raw(self, prepared: DataFrame, features: str = "features") -> DataFrame:
        """prepared with `{task}_raw`, in normalised units."""
        return ridge.predict(prepared, features, self.model)

    def score(self, prepared: DataFrame, key: str = "note_id", features: str = "features") -> DataFrame:
        """Long predictions: key, task, y_true (where the target exists), y_pred in label units."""
        tasks = [r["task"] for r in self.model.select("task").collect()]
        columns = task_columns(tasks)
        there = [t for t in tasks if columns[t] in prepared.columns]
        lines = F.array(*[
            F.struct(
                F.lit(t).alias("task"), (F.col(columns[t]).cast("double") if t in there else F.lit(None).cast("double")).alias("y_true"),
                F.col(f"{t}_raw").alias("y_raw"))
            for t in tasks])
        rows = self.raw(prepared.select(key, features, *dict.fromkeys(columns[t] for t in there)), features)
        return encoding.denormalise(rows.select(key, F.inline(lines)), self.labels, "y_raw", "y_pred")

    def wide(self, prepared: DataFrame, key: str = "note_id", clip: bool = False, features: str = "features") -> DataFrame:
        """M9: key and `{task}_pred`, without a shuffle; the rules are those of batch_scores."""
        fitted = {r["task"]: (r["center"], r["scale"]) for r in self.labels.collect()}
        out = []
        for t in (r["task"] for r in self.model.select("task").collect()):
            center, scale = fitted.get(t, (0.0, 1.0))
            value = F.col(f"{t}_raw") * F.lit(scale) + F.lit(center)
            out.append((impression_count(value) if t == "impression" else clip_rate(F.lit(t), value) if clip else value).alias(f"{t}_pred"))
        return self.raw(prepared.select(key, features), features).select(key, *out)

    def save(self, path: str) -> None:
        self.labels.write.mode("overwrite").parquet(f"{path}/labels")
        self.model.write.mode("overwrite").parquet(f"{path}/models")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearTasks:
        return LinearTasks(spark.read.parquet(f"{path}/models"), spark.read.parquet(f"{path}/labels"))


def fit_linear_tasks(
    train: DataFrame, tasks: Sequence[str], penalty: float = 0.01, normalisation: str = "standard", features: str = "features",
) -> LinearTasks:
    """M8 on prepared rows: label statistics, then all tasks' models from one pass over the rows."""
    columns = task_columns(tasks)
    fitted = encoding.fit_labels(train, columns, normalisation)
    labels = literal_rows(
        train.sparkSession, [tuple(r) for r in fitted.collect()], "task string, method string, center double, scale double")
    normal = encoding.normalise_labels(train, labels, {t: c for t, c in columns.items() if c in train.columns})
    targets = {t: f"{t}_norm" for t in tasks if columns[t] in train.columns}
    return LinearTasks(ridge.fit_ridge(normal.select(features, *targets.values()), features, targets, penalty), labels)


def evaluate_tasks(predictions: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """A11-A15 side by side, one row per task. The metrics read the predictions several times, so they are
    written to the checkpoint folder first and the models run once."""
    rows = cut_lineage(predictions.select("task", "y_true", "y_pred"))
    options = {"weights": weights} if weights is not None else {}
    losses = metrics.task_losses(rows, masked=list(task_columns()), **options)
    table = (
        metrics.regression_metrics(rows)
        .join(metrics.spearman(rows).drop("valid_samples"), "task")
        .join(kendall_tau(rows).select("task", "kendall_tau", "kendall_p"), "task")
        .join(losses.select("task", "weight", "weighted"), "task")
    )
    values = [tuple(r) for r in table.collect()]
    return literal_rows(predictions.sparkSession, values, table.schema.toDDL())


def batch_scores(predictions: DataFrame, tasks: Sequence[str], key: str = "note_id", clip: bool = False) -> DataFrame:
    """M9: key and `{task}_pred`; impressions come back from logs. With `clip`, rates are kept in [0, 1]."""
    task, value = F.col("task"), F.col("y_pred")
    final = F.when(task == "impression", impression_count(value)).otherwise(clip_rate(task, value) if clip else value)
    wide = predictions.withColumn("_v", final).groupBy(key).pivot("task", list(tasks)).agg(F.first("_v"))
    return wide.select(key, *[F.col(t).alias(f"{t}_pred") for t in tasks])


def diagnose_predictions(predictions: DataFrame, raw: str = "y_raw", value: str = "y_pred") -> DataFrame:
    """Raw, denormalised and clipped value, whether clipping changed it, the impression count, and warnings."""
    task, v = F.col("task"), F.col(value)
    clipped = clip_rate(task, v)
    return predictions.select(
        "*", clipped.alias("clipped"), (clipped != v).alias("clipped_applied"),
        F.when(task == "impression", impression_count(v)).alias("impressions"),
        (v < 0).alias("negative"), (is_rate_task(task) & (v > 1)).alias("above_one"),
    ).withColumnRenamed(raw, "raw").withColumnRenamed(value, "denormalised")
