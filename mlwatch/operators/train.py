"""Training, cross-validation and batch scoring with Spark ML."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.functions.columns import align, missing, quoted
from mlwatch.operators.evaluate import classification_metrics, regression_metrics, roc_auc, roc_auc_ovr
from mlwatch.operators.registry import latest_production
from mlwatch.operators.split import kfold, scaler

# Default parameters per algorithm.
DEFAULTS = {
    "Random Forest": {"n_estimators": 100, "max_depth": None},
    "Gradient Boosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
    "Logistic Regression": {"C": 1.0, "max_iter": 1000},
    "SVM": {"C": 1.0, "max_iter": 1000},
    "Decision Tree": {"max_depth": None},
    "Ridge Regression": {"alpha": 1.0},
}
CLASSIFIERS = ("Random Forest", "Gradient Boosting", "Logistic Regression", "SVM", "Decision Tree")
REGRESSORS = ("Random Forest", "Gradient Boosting", "Ridge Regression", "Decision Tree")
DEEPEST_TREE = 30


def checked_params(algo: str, params: Mapping | None) -> dict:
    """Defaults with the given parameters over them; an unknown name or a tree deeper than Spark grows is an error.

    ``max_depth`` None means the deepest tree there can be, DEEPEST_TREE levels.
    """
    unknown = set(params or {}) - set(DEFAULTS[algo])
    if unknown:
        raise ValueError(f"{algo} has no parameters {sorted(unknown)}")
    p = {**DEFAULTS[algo], **(params or {})}
    if (p.get("max_depth") or 1) > DEEPEST_TREE:
        raise ValueError(f"max_depth can be {DEEPEST_TREE} at most")
    return p


def build_estimator(algo: str, task: str, params: Mapping | None, n: int, n_classes: int, seed: int, spread: float = 1.0):
    """The Spark ML estimator for an algorithm name; ``n`` training rows turn C and alpha into penalties per row.

    Spark's linear regression measures its penalty in standard deviations of the target, ``spread``.
    """
    if algo not in (CLASSIFIERS if task == "classification" else REGRESSORS):
        raise ValueError(f"no {task} algorithm is called {algo!r}")
    p = checked_params(algo, params)
    cols = {"featuresCol": "_x", "labelCol": "_y"}
    depth = p.get("max_depth") or DEEPEST_TREE
    kind = "Classifier" if task == "classification" else "Regressor"
    mod = C if task == "classification" else R
    if algo == "Random Forest":
        return getattr(mod, f"RandomForest{kind}")(numTrees=p["n_estimators"], maxDepth=depth, seed=seed, **cols)
    if algo == "Decision Tree":
        return getattr(mod, f"DecisionTree{kind}")(maxDepth=depth, seed=seed, **cols)
    if algo == "Gradient Boosting":
        est = getattr(mod, f"GBT{kind}")(
            maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=depth, seed=seed, **cols
        )
    elif algo == "Logistic Regression":
        return C.LogisticRegression(regParam=1.0 / (p["C"] * n), maxIter=p["max_iter"], standardization=False, **cols)
    elif algo == "SVM":
        est = C.LinearSVC(regParam=1.0 / (p["C"] * n), maxIter=p["max_iter"], standardization=False, **cols)
    else:
        return R.LinearRegression(regParam=p["alpha"] * spread / n, elasticNetParam=0.0, standardization=False, **cols)
    if task == "classification" and n_classes > 2:
        return C.OneVsRest(classifier=est, **cols)
    return est


@dataclass
class Fitted:
    """A fitted pipeline (scaling, assembling, model) and what is needed to use and describe it."""

    model: PipelineModel
    algo: str
    task: str
    features: list[str]
    target: str
    classes: list[str] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    @property
    def core(self):
        at = -2 if self.task == "classification" else -1
        return self.model.stages[at]


def _scaling(train: DataFrame, features: Sequence[str]) -> SQLTransformer:
    """Standardisation with the training statistics as part of the pipeline: two numbers per feature."""
    s = scaler(train, features).first()
    exprs = [
        f"(CAST({quoted(c)} AS DOUBLE) - {float(s[f'c{i}_mean'])!r}D) / {float(s[f'c{i}_scale'])!r}D AS _z{i}"
        for i, c in enumerate(features)
    ]
    return SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The frame itself if no cell of the columns is missing; else an error."""
    counts = df.agg(*[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    found = {c: n for c, n in zip(cols, counts, strict=True) if n}
    if found:
        raise ValueError(f"missing cells, to be filled or dropped first: {found}")
    return df


def fit(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    algo: str = "Random Forest",
    task: str = "classification",
    params: Mapping | None = None,
    seed: int = 42,
) -> Fitted:
    """Fit one algorithm on standardised features. Missing features or targets are an error that tells their number."""
    rows = complete(train, [*features, target])
    stages: list = [
        _scaling(rows, features),
        VectorAssembler(inputCols=[f"_z{i}" for i in range(len(features))], outputCol="_x"),
    ]
    classes: list[str] = []
    n_classes = 0
    if task == "classification":
        rows = rows.withColumn("_label", F.col(quoted(target)).cast("string"))
        indexer = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
        classes = list(indexer.labels)
        n_classes = len(classes)
        rows = indexer.transform(rows)
    else:
        rows = rows.withColumn("_y", F.col(quoted(target)).cast("double"))
    size, spread = rows.agg(F.count("*"), F.stddev_pop("_y") if task == "regression" else F.lit(1.0)).first()
    stages.append(build_estimator(algo, task, params, size, n_classes, seed, spread or 1.0))
    if task == "classification":
        stages.append(IndexToString(inputCol="prediction", outputCol="_class", labels=classes))
    model = Pipeline(stages=stages).fit(rows)
    return Fitted(model, algo, task, list(features), target, classes, checked_params(algo, params))


def score(df: DataFrame, fitted: Fitted, keep: Sequence[str] = (), meta: Mapping | None = None) -> DataFrame:
    """Predictions for every row, with probabilities per class where the model has them and the model's identity.

    A missing feature fails the job, as it does in ``fit``.
    """
    aligned = align(df, [*dict.fromkeys([*keep, *fitted.features])])
    out = fitted.model.transform(aligned)
    info = {**fitted.meta, **(meta or {})}
    cols = [F.col(quoted(k)) for k in keep]
    cols += [F.lit(info.get(k)).alias(k) for k in ("model_id", "dataset", "version", "stage")]
    if fitted.task == "classification":
        cols.append(F.col("_class").alias("predicted"))
        if "probability" in out.columns:
            cols.append(vector_to_array("probability").alias("probabilities"))
    else:
        cols.append(F.col("prediction").alias("predicted"))
    return out.select(*cols)


def save_model(fitted: Fitted, path: str) -> str:
    """Write a fitted model and its description under a path, replacing what is there; the path is its artifact_path."""
    fitted.model.write().overwrite().save(f"{path}/pipeline")
    facts = {"algo": fitted.algo, "task": fitted.task, "features": fitted.features, "target": fitted.target,
             "classes": fitted.classes, "params": fitted.params, "meta": fitted.meta}
    spark = SparkSession.active()
    spark.range(1).select(F.lit(json.dumps(facts)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/facts")
    return path


def load_model(path: str) -> Fitted:
    """The model that ``save_model`` has written."""
    facts = json.loads(SparkSession.active().read.text(f"{path}/facts").first()[0])
    return Fitted(model=PipelineModel.load(f"{path}/pipeline"), **facts)


def score_production(df: DataFrame, models: DataFrame, dataset: str, keep: Sequence[str] = ()) -> DataFrame:
    """Scores of the newest production model of a data set, loaded from the artifact path of its row."""
    row = latest_production(models.where(F.col("dataset") == dataset)).first()
    if row is None:
        raise ValueError(f"{dataset} has no production model")
    return score(df, load_model(row.artifact_path), keep, {k: row[k] for k in ("model_id", "dataset", "version", "stage")})


def evaluate(df: DataFrame, fitted: Fitted) -> dict[str, float]:
    """Metrics of a fitted model on a frame that has the target: a handful of numbers."""
    target = F.col(quoted(fitted.target))
    if fitted.task != "classification":
        scored = score(df.withColumn("_t", target.cast("double")), fitted, ["_t"])
        return regression_metrics(scored, "_t", "predicted").first().asDict()
    scored = score(df.withColumn("_t", target.cast("string")), fitted, ["_t"])
    metrics = classification_metrics(scored, "_t", "predicted").first().asDict()
    if "probabilities" in scored.columns:
        probs = scored.withColumns(
            {f"_p{i}": F.get("probabilities", F.lit(i)) for i in range(len(fitted.classes))}
        )
        if len(fitted.classes) == 2:
            probs = probs.withColumn("_pos", (F.col("_t") == fitted.classes[1]).cast("int"))
            auc = roc_auc(probs, "_pos", "_p1").first()[0]
        else:
            auc = roc_auc_ovr(probs, "_t", {c: f"_p{i}" for i, c in enumerate(fitted.classes)}).first()[0]
        if auc is not None:
            metrics["roc_auc"] = round(auc, 4)
    return metrics


def cross_validate(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    algo: str,
    task: str = "classification",
    k: int = 5,
    params: Mapping | None = None,
    seed: int = 42,
) -> dict:
    """Weighted F1 (or R squared) per fold with mean and population standard deviation."""
    folds = kfold(df, keys, k, seed, target if task == "classification" else None)
    name = "f1_score" if task == "classification" else "r2"
    scores = []
    for i in range(k):
        m = fit(folds.where(F.col("fold") != i), features, target, algo, task, params, seed)
        scores.append(evaluate(folds.where(F.col("fold") == i), m)[name])
    mean = sum(scores) / k
    return {"scores": scores, "mean": mean, "std": math.sqrt(sum((s - mean) ** 2 for s in scores) / k)}


def importances(fitted: Fitted, top: int | None = None) -> list[tuple[str, float]]:
    """Features by importance: of the trees, else the mean absolute coefficient over classes."""
    core = fitted.core
    if hasattr(core, "featureImportances"):
        values = list(core.featureImportances.toArray())
    elif hasattr(core, "coefficientMatrix"):
        values = list(abs(core.coefficientMatrix.toArray()).mean(axis=0))
    elif hasattr(core, "coefficients"):
        values = list(abs(core.coefficients.toArray()))
    else:
        return []
    ranked = sorted(zip(fitted.features, (float(v) for v in values), strict=True), key=lambda r: -r[1])
    return ranked[:top]


@dataclass
class Run:
    """What one training run leaves behind."""

    run_id: str
    dataset: str
    fitted: Fitted
    metrics: dict[str, float]
    cv: dict
    stages: list[tuple[str, str, float]]
    duration: float


def train_run(
    run_id: str,
    dataset: str,
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    algo: str,
    task: str = "classification",
    cv_folds: int = 5,
    params: Mapping | None = None,
    seed: int = 42,
) -> Run:
    """Cross-validate on the training part, fit, evaluate on the test part. ``df`` has a ``split`` column."""
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    stages, start = [], time.perf_counter()

    def timed(name, f):
        t = time.perf_counter()
        out = f()
        stages.append((name, "success", round(time.perf_counter() - t, 3)))
        return out

    cv = timed(
        "Cross-Validation",
        lambda: cross_validate(train, keys, features, target, algo, task, cv_folds, params, seed),
    )
    fitted = timed("Training", lambda: fit(train, features, target, algo, task, params, seed))
    metrics = timed("Evaluation", lambda: evaluate(test, fitted))
    metrics |= {"cv_mean": round(cv["mean"], 4), "cv_std": round(cv["std"], 4)}
    return Run(run_id, dataset, fitted, metrics, cv, stages, round(time.perf_counter() - start, 3))


def run_to_rows(spark, run: Run) -> tuple[DataFrame, DataFrame]:
    """The experiment row and the model row of a run, ready for the registry's upserts."""
    one = spark.range(1)

    def as_json(d: Mapping):
        cols = [F.lit(v).alias(k) for k, v in d.items() if v is not None]
        return F.to_json(F.struct(*cols)) if cols else F.lit("{}")

    base = {
        "run_id": F.lit(run.run_id),
        "name": F.lit(f"{run.fitted.algo} - {run.dataset}"),
        "dataset": F.lit(run.dataset),
        "model_type": F.lit(run.fitted.algo),
        "task": F.lit(run.fitted.task),
        "params": as_json(run.fitted.params),
        "metrics": as_json(run.metrics),
        "created_at": F.current_timestamp(),
    }
    stages = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(s).alias("status"), F.lit(d).alias("duration")) for n, s, d in run.stages]
    )
    exp = one.select(
        *[c.alias(k) for k, c in base.items()],
        F.lit("completed").alias("status"),
        F.lit(float(run.duration)).alias("duration_seconds"),
        stages.alias("stages"),
    )
    model = one.select(
        F.lit(run.run_id).alias("model_id"),
        *[c.alias(k) for k, c in base.items()],
        F.lit(run.run_id).alias("experiment_id"),
        as_json(dict(importances(run.fitted))).alias("feature_importances"),
    )
    return exp, model


def explode_payload(
    df: DataFrame, json_col: str, features: Sequence[str], keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Feature rows from JSON payloads of four shapes, and the payloads that are refused, with the reason.

    A payload is an object, a list of objects, one vector or a list of vectors; vectors are in feature order. Every object
    must name every feature (other names are ignored), every vector have one value per feature, and every value
    be a number or a text of one. A payload with any other part is refused whole, so that each input row is in one
    of the two results, and rows of a payload are never fewer than it has.
    """
    body = F.try_parse_json(F.col(quoted(json_col)))
    parts = F.try_variant_get("_body", "$", "array<variant>")
    single = F.try_variant_get("_body", "$", "map<string,variant>").isNotNull() | (
        F.exists("_parts", lambda p: ~F.coalesce(F.substring(F.schema_of_variant(p), 1, 5).isin("OBJEC", "ARRAY"), F.lit(False)))
    )
    marked = df.withColumn("_body", body).withColumn("_parts", parts)
    marked = marked.withColumn("_items", F.when(single, F.array("_body")).otherwise(F.col("_parts")))

    def values(item):
        named = F.try_variant_get(item, "$", "map<string,variant>")
        placed = F.try_variant_get(item, "$", "array<variant>")
        number = [
            F.try_variant_get(F.coalesce(F.try_element_at(named, F.lit(c)), F.get(placed, F.lit(i))), "$", "double")
            for i, c in enumerate(features)
        ]
        known = F.forall(F.array(*map(F.lit, features)), lambda c: F.map_contains_key(named, c))
        reason = (
            F.when(named.isNull() & placed.isNull(), "no object or vector")
            .when(named.isNotNull() & ~known, "missing feature")
            .when(placed.isNotNull() & (F.size(placed) != len(features)), "vector length")
            .when(F.exists(F.array(*number), lambda x: x.isNull()), "not a number")
        )
        return F.struct(reason.alias("reason"), F.struct(*[x.alias(c) for x, c in zip(number, features, strict=True)]).alias("row"))

    marked = marked.withColumn("_rows", F.transform("_items", values))
    first = F.get(F.filter(F.transform("_rows", lambda r: r["reason"]), lambda r: r.isNotNull()), 0)
    reason = F.when(F.col("_body").isNull(), "not JSON").when(F.coalesce(F.size("_rows"), F.lit(0)) < 1, "no rows").otherwise(first)
    marked = marked.withColumn("_reason", reason)
    bad = marked.where(F.col("_reason").isNotNull()).select(*keep, F.col(quoted(json_col)), F.col("_reason").alias("reason"))
    good = marked.where(F.col("_reason").isNull()).select(*keep, F.posexplode("_rows").alias("row_index", "_r"))
    return good.select(*keep, "row_index", "_r.row.*"), bad
