"""From attributions per entity and feature to contributors, sentences and alert texts.

Attributions are long rows `(entity_id, feature, score)`. Ties are broken by feature name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchmere.functions.columns import title_case, two_places
from watchmere.operators.ensemble import NORMAL_BELOW, ranked_list

# How many contributors are named and which words go with which share.
TOP_CONTRIBUTORS = 5
HIGHLY_ABOVE = 30.0
UNUSUAL_ABOVE = 15.0
TOP_FACTORS = 3
FACTOR_ABOVE = 0.1
SMALLEST_TOTAL = 1e-10
LIME_FALLBACK_FACTOR = 0.8

# What the texts say.
HIGHLY, UNUSUAL, SOMEWHAT = "highly unusual ", "unusual ", "somewhat unusual "
NO_ALERT = "Normal behavior detected. No significant anomalies found."
ALERT_BECAUSE = "Alert triggered because of "
ALERT_FACTORS = "Alert triggered due to multiple factors: "
LOW_RISK, LOW_RISK_END = "Low risk alert for ", ". Behavior is mostly normal with minor deviations."
MEDIUM_RISK, MEDIUM_RISK_END = "Medium risk alert for ", ". Multiple minor deviations detected."
AT_RISK, RISK_SCORE, KEY_FACTORS = "Alert for ", " (Risk Score: ", "). Key factors: "


def attribution_abs(rows: DataFrame, names: list[str], factor: float = 1.0) -> DataFrame:
    """The plain attribution of `(row_key, features)`: the absolute value of each feature."""
    return rows.select(F.col("row_key").alias("entity_id"), F.posexplode("features").alias("_at", "_value")).select(
        "entity_id",
        F.element_at(F.array(*[F.lit(name) for name in names]), F.col("_at") + 1).alias("feature"),
        (F.abs("_value") * factor).alias("score"),
    )


def top_contributors(attributions: DataFrame, limit: int = TOP_CONTRIBUTORS) -> DataFrame:
    """The largest contributions per entity with their percentage of the entity's total.

    The total is an aggregate of its own, so that no task holds all features of an entity.
    """
    totals = attributions.groupBy("entity_id").agg(F.sum("score").alias("total"))
    share = F.col("score") / F.greatest(F.col("total"), F.lit(SMALLEST_TOTAL)) * 100
    top = ranked_list(attributions, limit, "entity_id").join(totals, "entity_id")
    return top.select("entity_id", "total", F.inline("top")).select(
        "entity_id",
        F.col("_rank").cast("bigint").alias("rank"),
        "feature",
        F.col("score").alias("contribution"),
        share.alias("percentage"),
    )


def _phrase(feature: Column, percentage: Column) -> Column:
    words = F.when(percentage > HIGHLY_ABOVE, HIGHLY).when(percentage > UNUSUAL_ABOVE, UNUSUAL)
    return F.concat(words.otherwise(SOMEWHAT), feature)


def alert_narratives(attributions: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """A sentence per entity that names its largest contributors.

    With `entities`, those without any attribution get the sentence for normal behaviour.
    """
    totals = attributions.groupBy("entity_id").agg(F.sum("score").alias("total"))
    top = ranked_list(attributions, TOP_CONTRIBUTORS, "entity_id").join(totals, "entity_id")
    total = F.greatest(F.col("total"), F.lit(SMALLEST_TOTAL))
    phrases = F.transform("top", lambda x: _phrase(x["feature"], x["score"] / total * 100))
    told = top.select("entity_id", phrases.alias("p"))
    if entities is not None:
        told = entities.select("entity_id").join(told, "entity_id", "left")
    size = F.coalesce(F.size("p"), F.lit(0))
    many = F.concat(
        F.lit(ALERT_FACTORS),
        F.concat_ws(", ", F.slice("p", F.lit(1), F.greatest(size - 1, F.lit(0)))),
        F.lit(", and "),
        F.element_at("p", -1),
        F.lit("."),
    )
    sentence = (
        F.when(F.col("p").isNull() | (size == 0), NO_ALERT)
        .when(size == 1, F.concat(F.lit(ALERT_BECAUSE), F.get("p", F.lit(0)), F.lit(".")))
        .when(
            size == 2,
            F.concat(
                F.lit(ALERT_BECAUSE), F.get("p", F.lit(0)), F.lit(" and "), F.get("p", F.lit(1)), F.lit(".")
            ),
        )
        .otherwise(many)
    )
    return told.select("entity_id", sentence.alias("narrative"))


def alert_explanations(scored: DataFrame, attributions: DataFrame) -> DataFrame:
    """A text per scored entity (entity_id, final_score), with its key factors when it is at risk."""
    top = ranked_list(attributions, TOP_FACTORS, "entity_id")
    factors = F.transform(
        F.filter("top", lambda x: x["score"] > FACTOR_ABOVE),
        lambda x: F.concat(title_case(x["feature"]), F.lit(" (score: "), two_places(x["score"]), F.lit(")")),
    )
    score, who = F.col("final_score"), F.col("entity_id")
    text = (
        F.when(
            score < NORMAL_BELOW,
            F.concat(F.lit(LOW_RISK), who, F.lit(LOW_RISK_END)),
        )
        .when(
            F.coalesce(F.size("f"), F.lit(0)) <= 0,
            F.concat(F.lit(MEDIUM_RISK), who, F.lit(MEDIUM_RISK_END)),
        )
        .otherwise(
            F.concat(
                F.lit(AT_RISK),
                who,
                F.lit(RISK_SCORE),
                two_places(score),
                F.lit(KEY_FACTORS),
                F.concat_ws(", ", "f"),
                F.lit("."),
            )
        )
    )
    joined = scored.join(top, "entity_id", "left").withColumn("f", factors)
    return joined.select("entity_id", "final_score", text.alias("explanation"))


def explanation_bundle(attributions: DataFrame, provider: str) -> DataFrame:
    """Everything about a prediction in one row: importance map, top features, text, provider.

    The map holds one entry per feature of the model, a number fixed by the model.
    """
    if provider not in ("shap", "lime"):
        raise ValueError("provider must be shap or lime")
    maps = attributions.groupBy("entity_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "score")))).alias("feature_importance")
    )
    top = (
        top_contributors(attributions)
        .groupBy("entity_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "feature", "contribution", "percentage"))).alias("top_features"))
    )
    return (
        maps.join(top, "entity_id")
        .join(alert_narratives(attributions), "entity_id")
        .withColumn("explainer_type", F.lit(provider))
    )
