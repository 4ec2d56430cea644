"""Stored models: saving, loading and the list of what is ready to run."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.operators.features import FeatureModel
from starlens.operators.learners import StarModel
from starlens.params import Params

META = (
    "model string, family string, mode string, preprocess_strategy string, validation_mae double, path string, "
    "params string, has_features boolean"
)


def save_model(spark: SparkSession, name: str, root: str, vectoriser: FeatureModel | None, model: StarModel, strategy: str, mae: float) -> None:
    """Write both fitted parts and a one-row meta table below ``root``/``name``."""
    path = f"{root}/{name}"
    if vectoriser is not None:
        vectoriser.stages.write().overwrite().save(f"{path}/features")
    model.stages.write().overwrite().save(f"{path}/model")
    params = json.dumps(asdict(vectoriser.params)) if vectoriser is not None else None
    row = [(name, model.family, model.mode, strategy, float(mae), path, params, vectoriser is not None)]
    spark.createDataFrame(row, META).write.mode("overwrite").parquet(f"{path}/meta")


def load_meta(spark: SparkSession, name: str, root: str) -> DataFrame:
    return spark.read.schema(META).parquet(f"{root}/{name}/meta")


def load_model(spark: SparkSession, name: str, root: str) -> tuple[FeatureModel | None, StarModel]:
    """Both parts, the vectoriser with the parameters it was fitted with."""
    meta = load_meta(spark, name, root).first()
    path = f"{root}/{name}"
    vectoriser = None
    if meta["has_features"]:
        stored = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(meta["params"]).items()}
        vectoriser = FeatureModel(PipelineModel.load(f"{path}/features"), Params(**stored))
    return vectoriser, StarModel(meta["family"], meta["mode"], PipelineModel.load(f"{path}/model"))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def readiness(spark: SparkSession, names: Sequence[str], root: str) -> DataFrame:
    """(model, ready) for every known model; one is ready when all parts that its meta table names are there."""

    def ready(name: str) -> bool:
        path = f"{root}/{name}"
        if not exists(spark, f"{path}/meta"):
            return False
        parts = ["model"] + ["features"] * load_meta(spark, name, root).first()["has_features"]
        return all(exists(spark, f"{path}/{p}/metadata/_SUCCESS") for p in parts)

    return spark.createDataFrame([(n, ready(n)) for n in names], "model string, ready boolean")


def resolve_models(registry: DataFrame, requested: Sequence[str] | None) -> tuple[DataFrame, DataFrame]:
    """Models to run and the requested ones that are skipped; nothing to run is an error at the caller."""
    wanted = registry if not requested else registry.filter(F.col("model").isin(*requested))
    ready = wanted.filter("ready")
    return ready, wanted.join(ready.select("model"), "model", "left_anti")
