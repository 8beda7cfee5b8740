"""Retraining on analyst feedback: a gate on the number of samples, and versions that are kept.

The state is a small log of (version, trained_at, samples) under a path; feedback that came after the last entry is
pending. Below the least number of pending samples nothing is trained and no version is written.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmere.operators import feedback as B
from watchmere.operators.boosted import BoostedTrees, OneClassError, train_boosted_trees
from watchmere.schemas import as_timestamp

VERSIONS = "version string, trained_at timestamp, samples bigint"


@dataclass(frozen=True)
class State:
    """The version in use and when it was trained; the first one never was."""

    version: str = B.FIRST_VERSION
    trained_at: str | None = None


class Retraining:
    """Versions and models under `path`."""

    def __init__(self, spark: SparkSession, path: str, min_samples: int = B.MIN_SAMPLES):
        self.spark, self.path, self.min_samples = spark, path, min_samples

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(VERSIONS).parquet(f"{self.path}/versions")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], VERSIONS)

    def state(self) -> State:
        last = self.versions().orderBy(F.desc("trained_at"), F.desc("samples")).first()
        return State() if last is None else State(last["version"], str(last["trained_at"]))

    def pending(self, feedback: DataFrame, as_of) -> DataFrame:
        """Valid feedback that came after the last training and not after `as_of`."""
        return B.pending_feedback(feedback, self.state().trained_at).filter(F.col("event_time") <= as_timestamp(as_of))

    def status(self, feedback: DataFrame, as_of) -> DataFrame:
        """One row: ready or collecting, pending samples, version in use."""
        enough = F.when(F.col("samples_collected") >= self.min_samples, "ready").otherwise("collecting")
        counted = self.pending(feedback, as_of).agg(F.count("*").alias("samples_collected"))
        return counted.select(enough.alias("status"), "samples_collected", F.lit(self.state().version).alias("model_version"))

    def trigger(self, feedback: DataFrame, alerts: DataFrame, vectors: DataFrame, names: Sequence[str], as_of, **options) -> BoostedTrees | None:
        """Train on the pending feedback, save the model under its new version and write the version down.

        None, and nothing written, if there are too few samples or if all of them say the same.
        """
        rows = self.pending(feedback, as_of)
        samples = rows.count()
        if samples < self.min_samples:
            return None
        try:
            model = train_boosted_trees(B.training_rows(rows, alerts, vectors), list(names), **options)
        except OneClassError:
            return None
        version = B.next_version(self.state().version)
        model.save(self.spark, f"{self.path}/models/{version}")
        entry = self.spark.range(1).select(F.lit(version).alias("version"), as_timestamp(as_of).alias("trained_at"), F.lit(samples).cast("bigint").alias("samples"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return model

    def load(self, version: str | None = None) -> BoostedTrees:
        return BoostedTrees.load(self.spark, f"{self.path}/models/{version or self.state().version}")
