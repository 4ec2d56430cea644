"""Star classifiers on Spark ML with one interface: features in, five probabilities out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.functions import ratings as R
from starlens.operators import boosting, distribution, stacked
from starlens.operators.once import compute_once
from starlens.params import Params

FAMILIES = ("logistic", "svm", "forest", "boosted")
CLASSES = {"five_class": 5, "three_class": 3}


@dataclass(frozen=True)
class StarModel:
    """Fitted stages and how their outputs become an expected rating."""

    family: str
    mode: str
    stages: PipelineModel

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``probs`` (not in regression mode) and ``ai_expected_rating``."""
        scored = self.stages.transform(df)
        if self.mode == "regression":
            out = scored.withColumn("ai_expected_rating", R.regression_star(F.col("raw_star")))
        else:
            out = self._with_probs(scored).withColumn("ai_expected_rating", self._expected())
        made = [c for stage in self.stages.stages for c in _outputs(stage)]
        return out.drop(*[c for c in made if c not in df.columns])

    def _with_probs(self, scored: DataFrame) -> DataFrame:
        """The model runs once per row, however often the probabilities are used."""
        if self.family != "svm":
            return compute_once(scored, "probs", vector_to_array("probability"))
        # One model per class: the positive probabilities, scaled to sum to one.
        positive = [vector_to_array(f"probability_{k}")[1] for k in range(CLASSES[self.mode])]
        listed = compute_once(scored, "_positive", F.array(*positive))
        return compute_once(listed, "probs", R.normalise_array(F.col("_positive"))).drop("_positive")

    def _expected(self) -> Column:
        probs = F.col("probs")
        if self.mode == "three_class":
            return R.three_class_star(R.argmax_class(probs))
        return R.expected_rating(probs)


def _outputs(stage: Transformer) -> list[str]:
    if isinstance(stage, boosting.SoftmaxTrees):
        return ["probability"]
    names = ("predictionCol", "probabilityCol", "rawPredictionCol", "outputCol")
    return [stage.getOrDefault(n) for n in names if stage.hasParam(n) and stage.isDefined(n)]


def with_training_columns(df: DataFrame, params: Params, star: str = "user_rating") -> DataFrame:
    """Add ``label`` and ``weight`` (balanced class weights with the low-star boost, or one)."""
    labelled = df.withColumn("target", R.training_label(F.col(star), params.mode))
    if not params.use_class_weight or params.mode == "regression":
        return labelled.withColumn("weight", F.lit(1.0)).withColumnRenamed("target", "label")
    weights = distribution.class_weights(df, star, CLASSES[params.mode], params.low_star_boost)
    if params.compat:
        plain = distribution.class_weights(df, star, CLASSES[params.mode], 1.0)
        weights = weights.join(plain.withColumnRenamed("class_weight", "_plain"), "label").select(
            "label", (F.col("class_weight") * F.col("_plain")).alias("class_weight")
        )
    weighted = distribution.sample_weights(labelled, weights, F.col("target"))
    return weighted.drop("label").withColumnsRenamed({"target": "label", "class_weight": "weight"})


def _one_vs_rest(train: DataFrame, label: int) -> DataFrame:
    return train.withColumn("is_class", (F.col("label") == label).cast("double"))


def _fit_svm(train: DataFrame, calibration: DataFrame, params: Params) -> list[Transformer]:
    """A linear machine per class; its margin becomes a probability by a sigmoid fitted on other rows."""
    stages: list[Transformer] = []
    for k in range(CLASSES[params.mode]):
        machine = LinearSVC(
            labelCol="is_class", weightCol="weight", maxIter=params.svm_max_iter,
            rawPredictionCol=f"margin_{k}", predictionCol=f"side_{k}",
        ).fit(_one_vs_rest(train, k))
        column = VectorAssembler(inputCols=[f"margin_{k}"], outputCol=f"margins_{k}")
        margins = column.transform(machine.transform(_one_vs_rest(calibration, k)))
        sigmoid = LogisticRegression(
            featuresCol=f"margins_{k}", labelCol="is_class", probabilityCol=f"probability_{k}",
            rawPredictionCol=f"sigmoid_{k}", predictionCol=f"calibrated_{k}", regParam=1e-6,
            maxIter=params.lr_max_iter,
        ).fit(margins)
        stages += [machine, column, sigmoid]
    return stages


def boosting_settings(params: Params) -> boosting.Settings:
    return boosting.Settings(rounds=params.gbt_rounds, depth=params.tree_depth, classes=CLASSES[params.mode], seed=params.seed)


def _fit_boosted(train: DataFrame, calibration: DataFrame, params: Params) -> list[Transformer]:
    """Boosted trees with one loss over all classes; the calibration rows stop the rounds early."""
    parts = [t.select("features", "label", "weight", F.lit(i).alias("part")) for i, t in enumerate((train, calibration))]
    settings = boosting_settings(params)
    fitted = boosting.fit(stacked.blocks(parts[0].unionByName(parts[1])), settings)
    return [boosting.SoftmaxTrees.of(fitted, settings.classes)]


def fit(family: str, train: DataFrame, calibration: DataFrame, params: Params = Params()) -> StarModel:
    """``train`` and ``calibration``: (features, label, weight); the second must not be the evaluation set."""
    if params.mode == "regression":
        stages: list[Transformer] = [
            GBTRegressor(
                labelCol="label", weightCol="weight", predictionCol="raw_star", maxIter=params.gbt_rounds,
                maxDepth=params.tree_depth, seed=params.seed,
            ).fit(train)
        ]
    elif family == "logistic":
        stages = [
            LogisticRegression(family="multinomial", weightCol="weight", maxIter=params.lr_max_iter, regParam=0.01).fit(train)
        ]
    elif family == "forest":
        stages = [
            RandomForestClassifier(
                numTrees=params.forest_trees, maxDepth=params.tree_depth, weightCol="weight", seed=params.seed
            ).fit(train)
        ]
    elif family == "svm":
        stages = _fit_svm(train, calibration, params)
    elif family == "boosted":
        stages = _fit_boosted(train, calibration, params)
    else:
        raise ValueError(f"unknown family: {family}")
    return StarModel(family, params.mode, PipelineModel(stages))
