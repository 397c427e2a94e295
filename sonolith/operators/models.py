"""Classifiers: training, tuning and evaluation under group-aware splits, with pyspark.ml."""

from __future__ import annotations

import json
import math
import random
import time
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StringIndexer, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import aggregated, best_features, majority_vote, mutual_information, weighted_metrics
from .tables import folds, group_folds, group_split, leaks, row_split

#: Default sizes of the models.
DEFAULTS = {"n_estimators": 150, "max_depth": 6}
NAMES = ("random_forest", "xgboost", "lightgbm", "m3gp", "minirocket")


def get_model(name: str, params: dict | None = None, **kwargs):
    """An estimator by name in any case; ``params`` win over keywords. Gradient boosting is one-versus-rest."""
    values = DEFAULTS | kwargs | (params or {})
    name, seed = name.lower(), int(values.get("seed", 42))
    if name == "random_forest":
        wide = {"auto": "auto", "sqrt": "sqrt", "log2": "log2", None: "all"}.get(values.get("max_features", "sqrt"), "auto")
        return RandomForestClassifier(numTrees=int(values["n_estimators"]), maxDepth=int(values["max_depth"]), featureSubsetStrategy=wide, seed=seed, labelCol="label_id", featuresCol="features")
    if name in ("xgboost", "lightgbm"):
        tree = GBTClassifier(maxIter=int(values["n_estimators"]), maxDepth=int(values["max_depth"]), stepSize=float(values.get("learning_rate", 0.1)), seed=seed, featuresCol="features")
        return OneVsRest(classifier=tree, labelCol="label_id", featuresCol="features", parallelism=int(values.get("parallelism", 4)))
    if name == "m3gp":
        return M3GP(generations=int(values.get("generations", values.get("max_generation", 50))), depth=int(values["max_depth"]), seed=seed)
    if name == "minirocket":  # the linear classifier over the transform ``clips.rocket``
        return LogisticRegression(labelCol="label_id", featuresCol="features", regParam=float(values.get("reg", 0.01)))
    raise ValueError(f"unknown model {name}")


class M3GP:
    """Multidimensional genetic programming: an individual is a list of expressions, each a new dimension.

    Every generation makes children of the better individuals (a dimension swapped with another parent's,
    an operand replaced, a dimension added or dropped) and scores all new dimensions in one aggregation over
    the data: their between-class share of the variance. An individual's fitness is the mean of its
    dimensions, less a little for each; the best are kept, so the best fitness never falls.
    """

    OPERATIONS = ("({a} * {b})", "({a} + {b})", "({a} - {b})", "({a} / (1 + abs({b})))")

    def __init__(self, generations: int = 50, depth: int = 6, seed: int = 42, population: int = 12):
        self.generations, self.depth, self.seed, self.population = generations, depth, seed, population

    def _grown(self, rng: random.Random, names: list[str]) -> tuple:
        """A random expression as nested tuples."""
        tree: tuple | str = rng.choice(names)
        for _ in range(rng.randint(0, max(1, self.depth // 3))):
            tree = (rng.choice(self.OPERATIONS), tree, rng.choice(names))
        return tree

    def _changed(self, rng: random.Random, tree, names: list[str]):
        if isinstance(tree, str) or rng.random() < 0.3:
            return self._grown(rng, names)
        op, a, b = tree
        return (rng.choice(self.OPERATIONS), a, b) if rng.random() < 0.3 else (op, self._changed(rng, a, names), b) if rng.random() < 0.5 else (op, a, self._changed(rng, b, names))

    def _depth(self, tree) -> int:
        return 0 if isinstance(tree, str) else 1 + max(map(self._depth, tree[1:]))

    def text(self, tree) -> str:
        return f"`{tree}`" if isinstance(tree, str) else tree[0].format(a=self.text(tree[1]), b=self.text(tree[2]))

    def _shares(self, df: DataFrame, label: str, trees: list) -> list[float]:
        """Between-class share of each dimension's variance, in one pass."""
        texts = [F.expr(self.text(t)) for t in trees]
        per = df.groupBy(label).agg(F.count("*").alias("n"), *[f(e).alias(f"{k}{i}") for i, e in enumerate(texts) for f, k in ((F.avg, "m"), (F.var_pop, "v"))])
        rows = per.collect()  # a row a class
        n, out = np.array([r["n"] for r in rows], float), []
        for i in range(len(trees)):
            m, v = (np.nan_to_num(np.array([r[f"{k}{i}"] or 0.0 for r in rows], float)) for k in "mv")
            between = float(n @ (m - (n @ m) / n.sum()) ** 2)
            total = between + float(n @ v)
            out.append(between / total if total > 0 and np.isfinite(total) else 0.0)
        return out

    def expressions(self, df: DataFrame, names: list[str], label: str = "label_id") -> list[str]:
        rng, known = random.Random(self.seed), {}
        people = [tuple({self._grown(rng, names) for _ in range(rng.randint(1, 3))}) for _ in range(self.population)]

        def fitness(person: tuple) -> float:
            return sum(known[t] for t in person) / len(person) - 0.001 * len(person)

        def scored(some: list[tuple]) -> None:
            new = list(dict.fromkeys(t for p in some for t in p if t not in known))
            if new:
                known.update(zip(new, self._shares(df, label, new), strict=True))

        scored(people)
        for _ in range(self.generations):
            people.sort(key=lambda p: (-fitness(p), str(p)))
            parents, children = people[: max(2, self.population // 2)], []
            while len(children) < self.population:
                one, two = list(rng.choice(parents)), rng.choice(parents)
                at, kind = rng.randrange(len(one)), rng.random()
                if kind < 0.4:
                    one[at] = rng.choice(two)
                elif kind < 0.8:
                    one[at] = self._changed(rng, one[at], names)
                elif kind < 0.9 or len(one) == 1:
                    one.append(self._grown(rng, names))
                else:
                    one.pop(at)
                if all(self._depth(t) <= self.depth for t in one):
                    children.append(tuple(dict.fromkeys(one)))
            scored(children)
            people = sorted({*people, *children}, key=lambda p: (-fitness(p), str(p)))[: self.population]
        return [self.text(t) for t in people[0]]


def with_expressions(df: DataFrame, expressions: list[str]) -> tuple[DataFrame, list[str]]:
    names = [f"gp_{i}" for i in range(len(expressions))]
    return df.withColumns({n: F.expr(e) for n, e in zip(names, expressions, strict=True)}), names


def preparation(names: list[str], label: str = "label", top_k: int | None = None, method: str = "f_classif", scale: bool = True, vector: str | None = None) -> list:
    """Stages: labels in alphabetical order, mean imputation, assembling, scaling, selection.

    With ``vector`` the features are that column of vectors without gaps; there is nothing to impute or assemble.
    ``method`` is f_classif or pca; mutual_info is settled before, by ``fitted``, which names the features.
    """
    if top_k and method not in ("f_classif", "pca"):
        raise ValueError(f"unknown selection method {method}")
    filled = [f"{n}__filled" for n in names]
    stages = [StringIndexer(inputCol=label, outputCol="label_id", stringOrderType="alphabetAsc", handleInvalid="keep")]
    if not vector:
        stages.append(Imputer(inputCols=names, outputCols=filled, strategy="mean"))
        stages.append(VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="keep"))
    last = vector or "raw"
    if scale:
        # Divides by the sample deviation; the constant factor to the population's changes no model here.
        stages.append(StandardScaler(inputCol=last, outputCol="scaled", withMean=True, withStd=True))
        last = "scaled"
    if top_k and method == "pca":
        stages.append(PCA(k=min(top_k, len(names)), inputCol=last, outputCol="features"))
    elif top_k:
        pick = UnivariateFeatureSelector(featuresCol=last, outputCol="features", labelCol="label_id", selectionMode="numTopFeatures")
        stages.append(pick.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(min(top_k, len(names))))
    else:
        stages.append(VectorAssembler(inputCols=[last], outputCol="features", handleInvalid="keep"))
    return stages


def opened_vector(df: DataFrame, names: list[str], vector: str) -> DataFrame:
    """``df`` with a column for each number of the vector."""
    wide = df.withColumn("_numbers", vector_to_array(vector))
    return wide.select(*df.columns, *[F.get("_numbers", F.lit(i)).alias(n) for i, n in enumerate(names)])


@dataclass
class Fitted:
    """A fitted pipeline, and what it needs first: a vector's numbers as columns, evolved expressions."""

    pipeline: PipelineModel
    expressions: list[str] = field(default_factory=list)
    opened: tuple[str, list[str]] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        wide = opened_vector(df, self.opened[1], self.opened[0]) if self.opened else df
        return self.pipeline.transform(with_expressions(wide, self.expressions)[0])

    @property
    def labels(self) -> list[str]:
        return self.pipeline.stages[0].labels

    def save(self, path: str) -> None:
        """Writes the model below ``path``, replacing what is there."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps([self.expressions, self.opened]),)], "value string").write.mode("overwrite").text(f"{path}/expressions")

    @classmethod
    def load(cls, path: str) -> Fitted:
        lines = SparkSession.active().read.text(f"{path}/expressions")
        expressions, opened = json.loads(lines.first()[0])
        return cls(PipelineModel.load(f"{path}/pipeline"), expressions, opened and tuple(opened))


def fitted(
    train: DataFrame, names: list[str], model: str = "random_forest", label: str = "label", top_k: int | None = None,
    method: str = "f_classif", scale: bool = True, vector: str | None = None, **params,
) -> Fitted:
    """``model`` fitted on ``train``: imputation, scaling and selection of ``top_k`` features are part of it.

    ``vector`` names a column that holds the features ``names`` as one vector; evolving features and selection
    by mutual information read it by position.
    """
    estimator, expressions, opened = get_model(model, params), [], None
    train = train.withColumn(label, F.col(label).cast("string"))
    if vector and (isinstance(estimator, M3GP) or (top_k and method == "mutual_info")):
        train, opened, vector = opened_vector(train, names, vector), (vector, names), None
    if top_k and method == "mutual_info":
        filled = train.na.fill(0, names)
        long = filled.select(label, *names).unpivot([label], names, "feature", "value")
        names = [r.feature for r in best_features(mutual_information(long, label), "mi", min(top_k, len(names))).collect()]
        top_k = None
    if isinstance(estimator, M3GP):
        expressions = estimator.expressions(train.na.fill(0, names), names, label)
        train, names = with_expressions(train, expressions)
        wide = {"n_estimators": 50, "max_depth": 20} | {k: v for k, v in params.items() if k in ("n_estimators", "max_features", "seed")}
        estimator, top_k = get_model("random_forest", wide), None
    return Fitted(Pipeline(stages=[*preparation(names, label, top_k, method, scale, vector), estimator]).fit(train), expressions, opened)


def predicted(model: Fitted, df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with label and prediction as text."""
    labels = model.labels
    out = model.transform(df.withColumn(label, F.col(label).cast("string")))
    return out.withColumn("prediction", F.get(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int"))).withColumn("label", F.col(label))


def evaluated(model: Fitted, df: DataFrame, label: str = "label", key: str | None = None) -> DataFrame:
    """Weighted metrics of the predictions; with ``key``, of each file's vote over its segments."""
    rows = predicted(model, df, label)
    if key:
        rows = majority_vote(rows.select(key, (F.col("seg_no") if "seg_no" in df.columns else F.lit(1)).alias("seg_no"), "label", "prediction"), key)
    return weighted_metrics(rows.select("label", "prediction"))


def splits(df: DataFrame, id_col: str, n: int, share: float = 0.2, group: str | None = None, seed: int = 42):
    """(number, rows with a split column) for each Monte-Carlo split; groups stay whole, and that is checked."""
    for i in range(n):
        out = group_split(df, group, share, seed + i) if group else row_split(df, id_col, share, seed + i)
        if group and not leaks(out, group).isEmpty():
            raise RuntimeError("a group is on both sides")
        yield i, out


def monte_carlo(df: DataFrame, names: list[str], id_col: str, model: str = "random_forest", n_splits: int = 10, group: str | None = None, label: str = "label", seed: int = 42, **params) -> DataFrame:
    """Metrics of each split; a split that fails is left out, all failing is an error."""
    out, errors = None, []
    for i, rows in splits(df, id_col, n_splits, group=group, seed=seed):
        try:
            began = time.time()
            fit = fitted(rows.where("split = 'train'"), names, model, label, **params)
            took = time.time() - began
            scored = predicted(fit, rows.where("split = 'test'"), label).select("label", "prediction")
            scored = weighted_metrics(scored).withColumns({"split": F.lit(i), "train_time_sec": F.lit(took)})
        except Exception as e:
            errors.append(e)
            continue
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise RuntimeError(f"all splits failed: {errors[0] if errors else 'none was asked'}")
    return out


def summary(metrics: DataFrame) -> DataFrame:
    return aggregated(metrics, ["accuracy", "f1", "precision", "recall", "train_time_sec"])


def sampled_space(space: dict[str, dict], n: int, seed: int = 42) -> list[dict]:
    """Seeded random draws from a typed space: int, float (log or not), categorical, bool."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        row = {}
        for name, s in space.items():
            kind = s["type"]
            if kind in ("int", "float"):
                low, high = float(s["low"]), float(s["high"])
                x = float(np.exp(rng.uniform(np.log(low), np.log(high)))) if s.get("log") else rng.uniform(low, high)
                row[name] = min(int(high), int(round(x))) if kind == "int" else x
            else:
                row[name] = rng.choice([True, False] if kind == "bool" else s["values"])
        out.append(row)
    return out


def tuned(df: DataFrame, names: list[str], candidates: list[dict], id_col: str, model: str = "random_forest", label: str = "label", k: int = 3, group: str | None = None, seed: int = 42, **fixed) -> tuple[dict, float]:
    """The candidate of the best mean weighted F1 over k folds, whole groups if there are any; the first on a
    tie. A candidate wins over ``fixed`` parameters."""
    rows = group_folds(df, group, k) if group else folds(df, id_col, label, k, seed)
    best = ({}, -1.0)
    for params in candidates:
        scores = []
        for fold in range(k):
            fit = fitted(rows.where(F.col("fold") != fold), names, model, label, **fixed | params)
            scores.append(weighted_metrics(predicted(fit, rows.where(F.col("fold") == fold), label).select("label", "prediction")).first()["f1"])
        if np.mean(scores) > best[1]:
            best = (params, float(np.mean(scores)))
    return best


def grid_candidates(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def grid_size(grid: dict[str, list]) -> int:
    """Points of a grid as the configuration has it (model: param_grid: name: values)."""
    return math.prod(len(v) for v in grid.values())


def drawn_candidates(grid: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """All points of a small grid, or ``n`` seeded draws of a large one, which is never listed."""
    if grid_size(grid) <= n:
        return grid_candidates(grid)
    rng = random.Random(seed)
    return [{k: rng.choice(v) for k, v in grid.items()} for _ in range(n)]


def train_simple(
    df: DataFrame, names: list[str], id_col: str, model: str = "random_forest", share: float = 0.2, seed: int = 42, label: str = "label",
    grid: dict[str, list] | None = None, trials: int = 50, save_to: str | None = None, **params,
) -> tuple[Fitted, DataFrame, DataFrame]:
    """(model, test rows, metrics of the test rows) of one stratified split; with ``grid``, tuned on it over 5 folds."""
    rows = row_split(df, id_col, share, seed, label)
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    if grid:
        params = params | tuned(train, names, drawn_candidates(grid, trials, seed), id_col, model, label, 5, seed=seed, **params)[0]
    fit = fitted(train, names, model, label, **params)
    if save_to:
        fit.save(save_to)
    return fit, test, evaluated(fit, test, label)


def train_monte_carlo(
    df: DataFrame, names: list[str], id_col: str, model: str = "random_forest", n_splits: int = 10, group: str | None = None, seed: int = 42,
    label: str = "label", grid: dict[str, list] | None = None, trials: int = 50, save_to: str | None = None, **params,
) -> tuple[Fitted, DataFrame, dict]:
    """(model, summary, parameters): tuned over 3 folds, scored over Monte-Carlo splits, fitted again on all rows."""
    found = tuned(df, names, drawn_candidates(grid, trials, seed), id_col, model, label, 3, group, seed, **params)[0] if grid else {}
    scores = monte_carlo(df, names, id_col, model, n_splits, group, label, seed, **params | found)
    fit = fitted(df, names, model, label, **params | found)
    if save_to:
        fit.save(save_to)
    return fit, summary(scores), found
