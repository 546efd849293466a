"""Gradient-boosted trees over a features DataFrame, shared by the URL filter and the toxicity score."""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About most rows, chosen by a hash of key: all of them where there are no more. Only fitting uses this."""
    n = rows.count()
    keep = 1 if n <= most else math.ceil(n / most)
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(keep)) == 0)


def vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows)


def fit_trees(rows: DataFrame, features: list[str], label: str, trees: int = 16, depth: int = 3, seed: int = 5) -> GBTClassificationModel | None:
    """The fitted model, or None where rows hold fewer than two classes. rows is small: the caller bounds it."""
    held = vectors(rows.select(*features, F.col(label).cast("double").alias("label")), features).select("features", "label").repartition(4).cache()
    try:
        if held.select("label").distinct().count() < 2:
            return None
        return GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=seed, cacheNodeIds=False).fit(held)
    finally:
        held.unpersist()


def probability(model: GBTClassificationModel | None, rows: DataFrame, features: list[str], prior: float = 0.0) -> DataFrame:
    """rows with p, the probability of label 1 (prior where there is no model)."""
    if model is None:
        return rows.withColumn("p", F.lit(float(prior)))
    return model.transform(vectors(rows, features)).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
