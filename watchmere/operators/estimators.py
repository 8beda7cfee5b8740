"""The detectors as Spark ML estimators and models, so that they stand in a `Pipeline` beside others.

Rows have `row_key` and an array of doubles, `features`. Each model adds a score in [0, 1] and a label under the names
that its parameters give, so several can follow one another. Fitted models are saved and read with the pipeline.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmere.operators import autoencoder, boosted, forest


class DetectorParams(HasFeaturesCol, HasSeed):
    """What all detectors have: where features are, what the score and the label are called, how many features."""

    scoreCol: Param[str] = Param(Params._dummy(), "scoreCol", "score in [0, 1]", TypeConverters.toString)
    anomalyCol: Param[str] = Param(Params._dummy(), "anomalyCol", "1 for anomalies", TypeConverters.toString)
    width: Param[int] = Param(Params._dummy(), "width", "number of features", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(scoreCol="anomaly_score", anomalyCol="is_anomaly", featuresCol="features", seed=forest.SEED)

    def rows(self, dataset: DataFrame, *more: str) -> DataFrame:
        """What training looks at."""
        return dataset.select("row_key", F.col(self.getOrDefault("featuresCol")).alias("features"), *more)


class _ModelWriter(MLWriter):
    def __init__(self, instance: DetectorModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.fitted.save(self.sparkSession, f"{path}/fitted")


class _ModelReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> DetectorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        made = self.kind(self.kind.FITTED.load(self.sparkSession, f"{path}/fitted"))
        made._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(made, metadata)
        return made


class DetectorModel(Model, DetectorParams, MLWritable, MLReadable):
    """A fitted detector."""

    FITTED: type

    def __init__(self, fitted=None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        given = self.getOrDefault("featuresCol")
        # The detectors read `features` and add two columns; others of these names are put aside meanwhile.
        aside = {c: f"__aside_{c}" for c in ("anomaly_score", "is_anomaly", *(["features"] if given != "features" else []))}
        aside = {c: a for c, a in aside.items() if c in dataset.columns}
        rows = dataset.withColumnsRenamed(aside)
        if given != "features":
            rows = rows.withColumn("features", F.col(given))
        scored = self.fitted.transform(rows)
        if given != "features":
            scored = scored.drop("features")
        named = {"anomaly_score": self.getOrDefault("scoreCol"), "is_anomaly": self.getOrDefault("anomalyCol")}
        return scored.withColumnsRenamed(named).withColumnsRenamed({a: c for c, a in aside.items()})

    def importances(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """Rows (feature, importance)."""
        return self.fitted.importances(self.rows(rows), names)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class ForestModel(DetectorModel):
    FITTED = forest.Forest


class AutoencoderModel(DetectorModel):
    FITTED = autoencoder.Autoencoder


class BoostedModel(DetectorModel):
    FITTED = boosted.BoostedTrees


class Detector(Estimator, DetectorParams, DefaultParamsWritable, DefaultParamsReadable):
    """Fits a detector on a table's rows."""

    MODEL: type
    trainWhere: Param[str] = Param(Params._dummy(), "trainWhere", "SQL predicate of rows to learn from", TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(trainWhere="true")

    def _fit(self, dataset: DataFrame) -> DetectorModel:
        return self._copyValues(self.MODEL(self.train(dataset.filter(self.getOrDefault("trainWhere")))))

    def train(self, dataset: DataFrame):
        raise NotImplementedError


class IsolationForest(Detector):
    MODEL = ForestModel
    trees: Param[int] = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    maxSamples: Param[int] = Param(Params._dummy(), "maxSamples", "rows that a tree sees", TypeConverters.toInt)
    contamination: Param[float] = Param(Params._dummy(), "contamination", "share of anomalies", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self, *, width=None, trees=None, maxSamples=None, contamination=None, seed=None, featuresCol=None, scoreCol=None,
        anomalyCol=None, trainWhere=None,
    ):
        super().__init__()
        self._setDefault(trees=forest.TREES, maxSamples=forest.MAX_SAMPLES, contamination=forest.CONTAMINATION)
        self._set(**self._input_kwargs)

    def train(self, dataset: DataFrame) -> forest.Forest:
        get = self.getOrDefault
        return forest.train_forest(
            self.rows(dataset), get("width"), get("trees"), get("maxSamples"), get("contamination"), get("seed")
        )


class AutoencoderDetector(Detector):
    MODEL = AutoencoderModel
    hidden: Param[list] = Param(Params._dummy(), "hidden", "sizes of the layers up to the code", TypeConverters.toListInt)
    epochs: Param[int] = Param(Params._dummy(), "epochs", "most passes over the rows", TypeConverters.toInt)
    shardRows: Param[int] = Param(Params._dummy(), "shardRows", "rows that one task trains on", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, width=None, hidden=None, epochs=None, shardRows=None, seed=None, featuresCol=None, scoreCol=None,
        anomalyCol=None, trainWhere=None,
    ):
        super().__init__()
        layers = [*autoencoder.HIDDEN_LAYERS, autoencoder.ENCODING]
        self._setDefault(hidden=layers, epochs=autoencoder.EPOCHS, shardRows=autoencoder.SHARD_ROWS)
        self._set(**self._input_kwargs)

    def train(self, dataset: DataFrame) -> autoencoder.Autoencoder:
        get = self.getOrDefault
        return autoencoder.train_autoencoder(
            self.rows(dataset), get("width"), get("hidden"), get("epochs"), shard_rows=get("shardRows"), seed=get("seed")
        )


class BoostedDetector(Detector, HasLabelCol):
    """Needs labels, 0 and 1."""

    MODEL = BoostedModel
    names: Param[list] = Param(Params._dummy(), "names", "names of the features", TypeConverters.toListString)
    rounds: Param[int] = Param(Params._dummy(), "rounds", "number of trees", TypeConverters.toInt)
    depth: Param[int] = Param(Params._dummy(), "depth", "depth of a tree", TypeConverters.toInt)
    stepSize: Param[float] = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self, *, names=None, rounds=None, depth=None, stepSize=None, seed=None, featuresCol=None, labelCol=None, scoreCol=None,
        anomalyCol=None, trainWhere=None,
    ):
        super().__init__()
        self._setDefault(
            rounds=boosted.ROUNDS, depth=boosted.DEPTH, stepSize=boosted.LEARNING_RATE, seed=boosted.SEED, labelCol="label"
        )
        self._set(**self._input_kwargs)

    def train(self, dataset: DataFrame) -> boosted.BoostedTrees:
        get = self.getOrDefault
        rows = self.rows(dataset, F.col(get("labelCol")).alias("label"))
        return boosted.train_boosted_trees(rows, get("names"), get("rounds"), get("depth"), get("stepSize"), get("seed"))


def load_model(spark: SparkSession, path: str):
    """A saved pipeline of detectors."""
    from pyspark.ml import PipelineModel

    return PipelineModel.read().session(spark).load(path)
