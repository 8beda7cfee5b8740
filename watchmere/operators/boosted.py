"""Boosted trees for known attacks, with Spark ML; a random forest can stand in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmere.operators.scaling import Scaler, fit_scaler
from watchmere.session import cut_lineage, spread

# The trees.
ROUNDS = 200
DEPTH = 6
LEARNING_RATE = 0.1
LABEL_ABOVE = 0.5
SEED = 42


class OneClassError(ValueError):
    """The labels are all the same, so there is nothing to tell apart."""


@dataclass(frozen=True)
class BoostedTrees:
    model: GBTClassificationModel | RandomForestClassificationModel
    scaler: Scaler
    names: tuple[str, ...]

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add `anomaly_score`, the probability of class 1, and `is_anomaly`."""
        vectors = rows.withColumn("_vector", array_to_vector(self.scaler.scaled(F.col("features"))))
        scored = self.model.transform(vectors).withColumn("anomaly_score", vector_to_array("probability")[1])
        labelled = scored.withColumn("is_anomaly", (F.col("anomaly_score") > LABEL_ABOVE).cast("int"))
        return labelled.drop("_vector", "rawPrediction", "probability", "prediction")

    def importance(self, spark: SparkSession) -> DataFrame:
        """Rows (feature, importance), one per feature."""
        values = self.model.featureImportances.toArray().tolist()
        return spark.createDataFrame(list(zip(self.names, values)), "feature STRING, importance DOUBLE")

    def importances(self, rows: DataFrame, names: list[str]) -> DataFrame:
        return self.importance(rows.sparkSession)

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        kind = "gbt" if isinstance(self.model, GBTClassificationModel) else "forest"
        row = (list(self.scaler.means), list(self.scaler.deviations), list(self.names), kind)
        schema = "means ARRAY<DOUBLE>, deviations ARRAY<DOUBLE>, names ARRAY<STRING>, kind STRING"
        spark.createDataFrame([row], schema).write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        about = spark.read.parquet(f"{path}/about").first()
        reader = GBTClassificationModel if about["kind"] == "gbt" else RandomForestClassificationModel
        scaler = Scaler(tuple(about["means"]), tuple(about["deviations"]))
        return BoostedTrees(reader.load(f"{path}/model"), scaler, tuple(about["names"]))


def train_boosted_trees(
    rows: DataFrame,
    names: list[str],
    rounds: int = ROUNDS,
    depth: int = DEPTH,
    learning_rate: float = LEARNING_RATE,
    seed: int = SEED,
    fallback: bool = False,
) -> BoostedTrees:
    """Train on `(features, label)` with labels 0 and 1; `fallback` grows a random forest instead."""
    # Training reads its rows a dozen times; what they are made from, once.
    rows = cut_lineage(rows.select("features", "label"))
    least, most, count = rows.agg(F.min("label"), F.max("label"), F.count("*")).first()
    if least == most:
        raise OneClassError("training needs rows of both classes")
    scaler = fit_scaler(rows, len(names))
    # In order within a task, as Spark ML draws the candidates of splits by place.
    dealt = spread(rows, count).sortWithinPartitions("features", "label")
    vectors = dealt.select(
        array_to_vector(scaler.scaled(F.col("features"))).alias("_vector"), F.col("label").cast("double").alias("label")
    )
    shared = {"featuresCol": "_vector", "labelCol": "label", "maxDepth": depth, "seed": seed}
    if fallback:
        learner = RandomForestClassifier(numTrees=rounds, **shared)
    else:
        # Each round adds to the lineage of the residuals, which is cut every tenth round.
        learner = GBTClassifier(maxIter=rounds, stepSize=learning_rate, checkpointInterval=10, **shared)
    return BoostedTrees(learner.fit(vectors), scaler, tuple(names))
