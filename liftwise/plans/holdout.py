"""Holdout checkpoints: the same comparison again 30, 60 and 90 days after launch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHECKPOINTS = (30, 60, 90)
# Our choice, the patterns are only described in words: last effect over first.
DECAY_BELOW = 0.5
IMPROVE_ABOVE = 1.25


def checkpoint_runs(runs: DataFrame, days: Sequence[int] = CHECKPOINTS, window_days: int = 30) -> DataFrame:
    """One run per checkpoint, measured over the ``window_days`` up to it.

    ``runs`` comes from ``run_defaults``; a run is launched on the day after its
    window ends. The new run ids are ``<run>@<day>``.
    """
    day = F.explode(F.array(*[F.lit(d) for d in days]))
    spread = runs.withColumn("parent_run", F.col("run_id")).withColumn("launch_date", F.date_add("end_date", 1)).withColumn(
        "checkpoint_day", day
    )
    end = F.expr("date_add(launch_date, checkpoint_day)")
    return (
        spread.withColumn("run_id", F.concat("parent_run", F.lit("@"), F.col("checkpoint_day").cast("string")))
        .withColumn("end_date", end)
        .withColumn("start_date", F.date_sub(end, window_days - 1))
    )


def trend(checkpoints: DataFrame, keys: Sequence[str] = ("parent_run", "metric", "variant")) -> DataFrame:
    """Change from the previous and the first checkpoint (rel_delta by checkpoint_day)."""
    order = Window.partitionBy(*keys).orderBy("checkpoint_day")
    return checkpoints.withColumn("previous", F.lag("rel_delta").over(order)).withColumn(
        "change", F.col("rel_delta") - F.col("previous")
    ).withColumn("first_delta", F.first_value("rel_delta").over(order))


def classify(checkpoints: DataFrame, keys: Sequence[str] = ("parent_run", "metric", "variant")) -> DataFrame:
    """Does the effect hold, decay or improve from the first to the last checkpoint?"""
    ends = checkpoints.where(F.col("rel_delta").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("checkpoints"),
        F.min_by("rel_delta", "checkpoint_day").alias("first_delta"),
        F.max_by("rel_delta", "checkpoint_day").alias("last_delta"),
    )
    return ends.withColumn("pattern", pattern(F.col("first_delta"), F.col("last_delta")))


def pattern(first: Column, last: Column) -> Column:
    ratio = last / F.when(first > 0, first)
    return (
        F.when(first <= 0, F.lit("unclassified"))
        .when(ratio < DECAY_BELOW, F.lit("decays"))
        .when(ratio > IMPROVE_ABOVE, F.lit("improves"))
        .otherwise(F.lit("holds"))
    )
