"""Training, saving and applying all detectors together, and the whole way from logs to alerts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmere.operators import alerts as A
from watchmere.operators import ensemble as E
from watchmere.operators import explain as X
from watchmere.operators import features as FE
from watchmere.operators import normalize as N
from watchmere.operators import rules as R
from watchmere.operators.autoencoder import Autoencoder, train_autoencoder
from watchmere.operators.boosted import BoostedTrees, OneClassError, train_boosted_trees
from watchmere.operators.forest import Forest, train_forest
from watchmere.operators.tree_values import attribution_trees, forest_leaves
from watchmere.operators.windows import window_events
from watchmere.schemas import NORMALIZED_EVENT, WINDOW_SECONDS

# What the attack rules read of an event.
RULE_COLUMNS = ("entity_id", "event_id", "event_time", "event_type", "city", "location")
MODEL_NAMES = ("isolation_forest", "autoencoder", "boosted_trees")


@dataclass(frozen=True)
class Detectors:
    """The trained models by name; a model that could not be trained is left out."""

    models: dict[str, Forest | Autoencoder | BoostedTrees]
    # Names and reasons of models that the rows could not train.
    left_out: dict[str, str] = field(default_factory=dict)

    def score(self, rows: DataFrame) -> DataFrame:
        """Long rows (entity_id, model_name, anomaly_score, is_anomaly), one per row and model."""
        scored = rows.select("row_key", "features")
        for name, model in self.models.items():
            scored = model.transform(scored)
            both = F.struct("anomaly_score", "is_anomaly")
            scored = scored.withColumn(name, both).drop("anomaly_score", "is_anomaly")
        pairs = F.array(
            *[
                F.struct(
                    F.lit(name).alias("model_name"),
                    F.col(f"{name}.anomaly_score").alias("anomaly_score"),
                    F.col(f"{name}.is_anomaly").alias("is_anomaly"),
                )
                for name in self.models
            ]
        )
        return scored.select(F.col("row_key").alias("entity_id"), F.inline(pairs))

    def importances(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """Long rows (model_name, feature, score) of every model."""
        parts = [
            model.importances(rows, names).select(
                F.lit(name).alias("model_name"), "feature", F.col("importance").alias("score")
            )
            for name, model in self.models.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    def save(self, spark: SparkSession, path: str) -> None:
        for name, model in self.models.items():
            model.save(spark, f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, names: tuple[str, ...] = MODEL_NAMES) -> Detectors:
        readers = dict(zip(MODEL_NAMES, (Forest, Autoencoder, BoostedTrees)))
        return Detectors({name: readers[name].load(spark, f"{path}/{name}") for name in names})


def train_detectors(
    normal: DataFrame, attack: DataFrame | None, names: list[str], boosting_rounds: int | None = None, **autoencoder
) -> Detectors:
    """The unsupervised models learn from normal rows, the supervised one from both kinds.

    Without attack rows there is only one class, and the supervised model is left out.
    """
    models: dict[str, Forest | Autoencoder | BoostedTrees] = {
        "isolation_forest": train_forest(normal, len(names)),
        "autoencoder": train_autoencoder(normal, len(names), **autoencoder),
    }
    left_out: dict[str, str] = {}
    if attack is not None:
        both = normal.select("features", F.lit(0).alias("label")).unionByName(
            attack.select("features", F.lit(1).alias("label"))
        )
        rounds = {"rounds": boosting_rounds} if boosting_rounds else {}
        try:
            models["boosted_trees"] = train_boosted_trees(both, names, **rounds)
        except OneClassError as reason:
            left_out["boosted_trees"] = str(reason)
    else:
        left_out["boosted_trees"] = "no rows of attacks were given"
    return Detectors(models, left_out)


@dataclass(frozen=True)
class Pipeline:
    """From raw logs to alerts. What later steps read more than once is a table under `path`."""

    as_of: str
    path: str
    windows: tuple[int, ...] = WINDOW_SECONDS

    def events(self, raw_logs: DataFrame) -> DataFrame:
        """Normalize once, into the event table, where rejected records have a partition of their own."""
        normalized = N.normalize(raw_logs).withColumn("event_date", F.to_date("event_time"))
        spark = raw_logs.sparkSession
        outcome = F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected")
        rows = normalized.withColumn("outcome", outcome)
        try:
            written = spark.read.schema(rows.schema).parquet(f"{self.path}/events")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            # Events that an earlier run has written stay; the day takes part so that other days are not read.
            known = written.select("event_id", "event_date", "outcome")
            rows = rows.join(known, ["event_id", "event_date", "outcome"], "left_anti")
        rows.write.mode("append").partitionBy("outcome", "event_date").parquet(f"{self.path}/events")
        table = spark.read.parquet(f"{self.path}/events").filter(F.col("outcome") == "accepted")
        return table.select(*NORMALIZED_EVENT.names, "event_date")

    def vectors(self, events: DataFrame, entities: DataFrame | None = None) -> DataFrame:
        flat = FE.flattened_features(events, self.as_of, self.windows, entities=entities)
        rows = FE.feature_array(flat, FE.flattened_names(self.windows))
        rows.write.mode("overwrite").parquet(f"{self.path}/vectors")
        return events.sparkSession.read.parquet(f"{self.path}/vectors")

    def by_rules(self, events: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Vectors of entities that no attack rule finds in the events of the windows, and of the others.

        If the rules find every entity, all vectors are the first and there is no second.
        """
        # The days of the windows are read once, in the few columns that the rules look at.
        recent = window_events(events, self.as_of, max(self.windows)).select(*RULE_COLUMNS)
        recent.write.mode("overwrite").parquet(f"{self.path}/recent")
        recent = events.sparkSession.read.parquet(f"{self.path}/recent")
        rules = (R.detect_brute_force, R.detect_impossible_travel, R.detect_exfiltration, R.detect_privilege_escalation)
        found = reduce(DataFrame.union, [rule(recent).select("entity_id") for rule in rules]).distinct()
        found.write.mode("overwrite").parquet(f"{self.path}/attacked")
        attacked = events.sparkSession.read.parquet(f"{self.path}/attacked")
        same = F.col("row_key") == F.col("entity_id")
        normal, attack = vectors.join(attacked, same, "left_anti"), vectors.join(attacked, same, "left_semi")
        return (vectors, None) if normal.isEmpty() else (normal, attack)

    def train(self, vectors: DataFrame, attack: DataFrame | None = None, **options) -> Detectors:
        return train_detectors(vectors, attack, FE.flattened_names(self.windows), **options)

    def reasons(self, vectors: DataFrame, detectors: Detectors, scored: DataFrame) -> DataFrame:
        """(entity_id, feature, score): exact Shapley values of the forest for the entities whose score is high."""
        names = FE.flattened_names(self.windows)
        high = scored.filter(F.col("final_score") > A.HIGH_ABOVE).select(F.col("entity_id").alias("row_key"))
        flagged = vectors.join(high, "row_key", "left_semi")
        forest = detectors.models["isolation_forest"]
        values = attribution_trees(forest_leaves(forest), forest.scaler, flagged, vectors, names)
        values.select("entity_id", "feature", "score").write.mode("overwrite").parquet(f"{self.path}/reasons")
        return vectors.sparkSession.read.parquet(f"{self.path}/reasons")

    def alerts(self, vectors: DataFrame, detectors: Detectors, earlier: DataFrame | None = None) -> DataFrame:
        """An alert per entity. High ones are told from the features that move the forest's score most; the others are normal."""
        ensemble = E.ensemble_score(E.model_predictions(detectors.score(vectors)))
        ensemble.write.mode("overwrite").parquet(f"{self.path}/scored")
        scored = vectors.sparkSession.read.parquet(f"{self.path}/scored")
        reasons = self.reasons(vectors, detectors, scored)
        return A.create_alerts(scored, self.as_of, X.alert_narratives(reasons, scored), reasons, earlier)
