"""Votes, verdict, score, severity and explanation: row expressions over the three layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.render import fixed
from tidewatch.functions.rounding import round_even

LAYERS = [("rule_anomaly", "rules"), ("zscore_anomaly", "route_zscore"), ("iforest_anomaly", "iforest")]


def vote_columns() -> dict[str, Column]:
    """Rules stand alone; otherwise two methods must agree."""
    votes = F.col("rule_anomaly") + F.col("zscore_anomaly") + F.col("iforest_anomaly")
    late = F.least(F.greatest("delay_days", F.lit(0.0)), F.lit(14.0)) / 14 * 25
    score = F.least(F.greatest(votes / F.lit(3.0) * 75 + late, F.lit(0.0)), F.lit(100.0))
    labels = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(m)) for c, m in LAYERS]))
    return {
        "anomaly_votes": votes,
        "final_anomaly": ((F.col("rule_anomaly") == 1) | (votes >= 2)).cast("int"),
        "anomaly_score": round_even(score, 1),
        "anomaly_methods": F.when(F.size(labels) == 0, F.lit("none")).otherwise(F.array_join(labels, ", ")),
    }


def severity() -> Column:
    """The one severity policy; every report reads its result."""
    votes = F.col("anomaly_votes")
    return (
        F.when(F.col("final_anomaly") != 1, F.lit("normal"))
        .when(F.col("critical_rule") | (votes == 3), F.lit("critical"))
        .when((F.col("delay_days") > 7) | (votes == 2), F.lit("moderate"))
        .otherwise(F.lit("minor"))
    )


def explanation(threshold: float, forest: bool = True) -> Column:
    """One sentence per order: what each layer found or why it was skipped, then the verdict.

    ``forest`` says whether the forest was asked for at all.
    """
    skipped = "fewer than 10 orders, not judged" if forest else "switched off"
    rules = F.when(
        F.col("rule_anomaly") == 1, F.concat(F.lit("rules: "), F.col("rule_reason"))
    )
    z = F.when(
        F.col("zscore_anomaly") == 1,
        F.concat(
            F.lit("route z-score: z="), fixed(F.col("z_score"), 2),
            F.lit(f" against the route baseline exceeds the threshold {threshold:.2f}"),
        ),
    ).when(F.col("zscore_skipped"), F.lit("route z-score: too few orders on the route, not judged"))
    forest = F.when(
        F.col("iforest_anomaly") == 1,
        F.concat(
            F.lit("isolation forest: unusual feature combination (model score "),
            fixed(F.col("iforest_score"), 4), F.lit(")"),
        ),
    ).when(F.col("iforest_skipped"), F.lit(f"isolation forest: {skipped}"))
    verdict = F.concat(
        F.lit("overall: "), F.col("anomaly_votes").cast("string"),
        F.when(F.col("final_anomaly") == 1, F.lit(" of 3 methods hit, judged anomalous, severity "))
        .otherwise(F.lit(" of 3 methods hit, not judged anomalous, severity ")),
        F.col("severity"),
    )
    return F.concat_ws("; ", rules, z, forest, verdict)


def with_verdict(df: DataFrame, threshold: float, forest: bool = True) -> DataFrame:
    return (
        df.withColumns(vote_columns())
        .withColumn("severity", severity())
        .withColumn("reason", explanation(threshold, forest))
    )
