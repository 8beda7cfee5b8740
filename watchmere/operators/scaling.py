"""Standard scaling of feature arrays and what follows directly from column means.

A fitted scaler is two numbers per feature, held by the driver as any model's parameters are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """Zero mean, unit variance with the population deviation; a constant column is only centred."""

    means: tuple[float, ...]
    deviations: tuple[float, ...]

    def scaled(self, features: Column) -> Column:
        means = F.array(*[F.lit(m) for m in self.means])
        deviations = F.array(*[F.lit(d) for d in self.deviations])
        return F.zip_with(
            F.zip_with(features, means, lambda x, m: x - m), deviations, lambda x, d: x / d
        )

    def transform(self, rows: DataFrame, column: str = "features") -> DataFrame:
        return rows.withColumn(column, self.scaled(F.col(column)))


def column_statistics(rows: DataFrame, column: str = "features") -> DataFrame:
    """Rows (position, mean, deviation), one per feature.

    Features are unfolded and grouped by position: a few groups, one partial row of each per task, and
    generated code whose size does not grow with the number of features.
    """
    unfolded = rows.select(F.posexplode(column).alias("position", "x"))
    return unfolded.groupBy("position").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))


def fit_scaler(rows: DataFrame, width: int, column: str = "features") -> Scaler:
    """The scaler of the rows; `width` numbers of each kind come to the driver."""
    found = {r["position"]: r for r in column_statistics(rows, column).collect()}
    if sorted(found) != list(range(width)):
        raise ValueError(f"expected rows with {width} features")
    means = tuple(found[i]["mean"] for i in range(width))
    deviations = tuple(found[i]["deviation"] for i in range(width))
    return Scaler(means, tuple(d if d and d > 0 else 1.0 for d in deviations))


def mean_importance(rows: DataFrame, names: list[str], column: str = "features") -> DataFrame:
    """Importance 1 / (mean + 1) per feature, normalized to sum to one; a mean of -1 counts as zero."""
    raw = F.coalesce(F.try_divide(F.lit(1.0), F.col("mean") + 1), F.lit(0.0))
    label = F.get(F.array(*[F.lit(name) for name in names]), F.col("position"))
    # One entry per feature of the model.
    one = column_statistics(rows, column).agg(F.collect_list(F.struct(label.alias("feature"), raw.alias("raw"))).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda sum_, x: sum_ + x["raw"])
    return one.select(F.inline("all"), total.alias("total")).select(
        "feature", F.try_divide("raw", "total").alias("importance")
    )
