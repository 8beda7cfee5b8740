"""Isolation forest (Liu, Ting and Zhou 2008): trees are grown in parallel, one group per tree.

Which rows a tree sees is decided by hashes of the row key, so the forest does not depend on how the
rows are partitioned. A tree sees at most `max_samples` rows, which bounds each group and the size
of the forest that is sent to the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from watchmere.operators.scaling import Scaler, fit_scaler, mean_importance

# The forest.
TREES = 200
MAX_SAMPLES = 256
CONTAMINATION = 0.01
SEED = 42

# A tree draws candidates at this multiple of its sample and keeps the ones of smallest hash. At 256
# rows the draw falls short of the sample in one of some billion trees, which then is a row smaller.
OVERDRAW = 1.5
HASH_RANGE = 1 << 40

TREE_SCHEMA = "tree INT, node INT, feature INT, threshold DOUBLE, left_node INT, right_node INT, path DOUBLE"


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n entries."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Split the sampled rows of one tree at random until they are alone or the tree is deep enough."""
    tree = int(rows["tree"].iloc[0])
    x = np.stack(rows.sort_values("draw")["features"].to_numpy())
    random = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list] = []
    waiting = [(np.arange(len(x)), 0, -1, 0)]
    while waiting:
        members, depth, parent, side = waiting.pop()
        number = len(nodes)
        if parent >= 0:
            nodes[parent][4 + side] = number
        part = x[members]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or len(usable) == 0:
            nodes.append([tree, number, -1, 0.0, -1, -1, depth + average_path(len(members))])
            continue
        feature = int(random.choice(usable))
        threshold = float(random.uniform(low[feature], high[feature]))
        if threshold >= high[feature]:  # Rounding; between two neighbouring doubles there is nothing to draw.
            threshold = float(low[feature])
        goes_left = part[:, feature] <= threshold
        nodes.append([tree, number, feature, threshold, -1, -1, 0.0])
        waiting.append((members[~goes_left], depth + 1, number, 1))
        waiting.append((members[goes_left], depth + 1, number, 0))
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in TREE_SCHEMA.split(", ")])


@dataclass(frozen=True)
class Forest:
    """A trained forest: its trees as one table, the scaler, and what turns paths into scores.

    `offset` is the training score below which a row is an anomaly; `low` and `high` are the smallest
    and largest training scores. Scores are negative, smaller being stranger.
    """

    trees: pd.DataFrame
    scaler: Scaler
    sample_size: int
    offset: float = 0.0
    low: float = 0.0
    high: float = 0.0

    def importances(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """Rows (feature, importance) from the means of the rows that are looked at."""
        return mean_importance(rows, names)

    def raw_scores(self, rows: DataFrame, name: str = "raw_score") -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(_tree_arrays(self.trees))
        divisor = average_path(self.sample_size) or 1.0

        @pandas_udf("double")
        def score(features: pd.Series) -> pd.Series:
            if len(features) == 0:
                return pd.Series([], dtype="float64")
            x = np.stack(features.to_numpy())
            total = np.zeros(len(x))
            for feature, threshold, left, right, path in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                while True:
                    open_rows = np.flatnonzero(feature[at] >= 0)
                    if len(open_rows) == 0:
                        break
                    here = at[open_rows]
                    goes_left = x[open_rows, feature[here]] <= threshold[here]
                    at[open_rows] = np.where(goes_left, left[here], right[here])
                total += path[at]
            return pd.Series(-np.power(2.0, -(total / len(shared.value)) / divisor))

        return rows.withColumn(name, score(self.scaler.scaled(F.col("features"))))

    def transform(self, rows: DataFrame, normalize: str = "train") -> DataFrame:
        """Add `anomaly_score` in [0, 1] and `is_anomaly` (0 or 1).

        Scores are stretched between the smallest and the largest one, of the training rows or, with
        normalize="batch", of the given rows; a batch of one row then always scores 1.
        """
        scored = self.raw_scores(rows)
        low, high = self.low, self.high
        if normalize == "batch":
            low, high = scored.agg(F.min("raw_score"), F.max("raw_score")).first()
            if low is None:
                low = high = 0.0
        share = 1 - (F.col("raw_score") - low) / (high - low + 1e-10)
        return (
            scored.withColumn("anomaly_score", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
            .withColumn("is_anomaly", (F.col("raw_score") < self.offset).cast("int"))
            .drop("raw_score")
        )

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.trees, TREE_SCHEMA).write.mode("overwrite").parquet(f"{path}/trees")
        about = [
            (list(self.scaler.means), list(self.scaler.deviations), self.sample_size, self.offset, self.low, self.high)
        ]
        schema = "means ARRAY<DOUBLE>, deviations ARRAY<DOUBLE>, sample_size INT, offset DOUBLE, low DOUBLE, high DOUBLE"
        spark.createDataFrame(about, schema).write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        about = spark.read.parquet(f"{path}/about").first()
        trees = spark.read.parquet(f"{path}/trees").orderBy("tree", "node").toPandas()
        scaler = Scaler(tuple(about["means"]), tuple(about["deviations"]))
        return Forest(trees, scaler, about["sample_size"], about["offset"], about["low"], about["high"])


def _tree_arrays(trees: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    names = ("feature", "threshold", "left_node", "right_node", "path")
    return [tuple(tree[name].to_numpy() for name in names) for _, tree in trees.groupby("tree", sort=True)]


def _joins_at_most(trees: int, chance: float) -> list[float]:
    """For m = 0, 1, ... the chance that a row joins at most m of the trees, up to where it is one for doubles."""
    below, out = 0.0, []
    for m in range(trees):
        below += math.comb(trees, m) * chance**m * (1 - chance) ** (trees - m)
        out.append(min(below, 1.0))
        if below >= 1.0:
            break
    return out


def tree_samples(rows: DataFrame, count: int, trees: int, max_samples: int, seed: int) -> DataFrame:
    """The rows (tree, draw, features) that each tree is grown from.

    One number per row, drawn from its key, tells how many trees the row is a candidate of: as many as independent
    draws for each tree would give. Only rows that are one at all, of large tables very few, draw which trees and
    their place there. Each tree keeps its candidates of smallest place, of which tasks send no more than it takes.
    """
    size = min(max_samples, count)
    chance = min(1.0, OVERDRAW * size / max(count, 1))

    def drawn(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(HASH_RANGE))

    at_most = _joins_at_most(trees, chance)
    share = drawn(F.lit("joins"), F.col("row_key")) / float(HASH_RANGE)
    limits = F.array(*[F.lit(x) for x in at_most])
    joins = F.when(share < at_most[0], 0).otherwise(F.size(F.filter(limits, lambda x: x <= share)))
    candidates = rows.select("row_key", "features", joins.alias("_joins")).filter("_joins > 0")
    numbers = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(drawn(F.col("row_key"), t).alias("h"), t.alias("tree")))
    chosen = F.slice(F.array_sort(numbers), F.lit(1), F.col("_joins"))
    candidates = candidates.select("row_key", "features", F.explode(F.transform(chosen, lambda x: x["tree"])).alias("tree"))
    candidates = candidates.withColumn("draw", drawn(F.lit("place"), F.col("row_key"), F.col("tree")))
    order = Window.partitionBy("tree").orderBy("draw", "row_key")
    return (
        candidates.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= size)
        .select("tree", "draw", "features")
    )


def train_forest(
    rows: DataFrame,
    width: int,
    trees: int = TREES,
    max_samples: int = MAX_SAMPLES,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
) -> Forest:
    """Grow a forest on `(row_key, features)`. Only its trees and a few numbers come to the driver."""
    scaler = fit_scaler(rows, width)
    count = rows.count()
    scaled = scaler.transform(rows.select("row_key", "features"))
    samples = tree_samples(scaled, count, trees, max_samples, seed)
    grown = samples.groupBy("tree").applyInPandas(lambda part: grow_tree(part, seed), TREE_SCHEMA)
    forest = Forest(grown.toPandas().sort_values(["tree", "node"]), scaler, min(max_samples, count))
    low, high, offset = (
        forest.raw_scores(rows.select("features"))
        .agg(F.min("raw_score"), F.max("raw_score"), F.percentile_approx("raw_score", contamination, 100000))
        .first()
    )
    return Forest(forest.trees, scaler, forest.sample_size, offset, low, high)
