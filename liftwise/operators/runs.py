"""Lists of runs, experiments and activities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftwise.schemas import ACTIVE_STATUSES


def active_runs(runs: DataFrame, experiments: DataFrame) -> DataFrame:
    """Runs still in progress with their experiment's flag and environment, last updated first."""
    e = experiments.select("experiment_id", F.col("flag_key").alias("experiment_flag"), F.col("env_id").alias("experiment_env"))
    return (
        runs.where(F.col("status").isin(*ACTIVE_STATUSES))
        .join(e, "experiment_id")
        .orderBy(F.col("updated_at").desc(), "run_id")
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last created run of each experiment.

    An aggregate, so that an experiment with very many runs is reduced before the shuffle.
    """
    others = [c for c in runs.columns if c != "experiment_id"]
    newest = F.struct(F.unix_micros("created_at").alias("at"), F.col("run_id").alias("id"))
    # Latest time wins, smallest id on equal times.
    key = F.struct((-newest["at"]).alias("at"), newest["id"].alias("id"))
    return runs.groupBy("experiment_id").agg(F.min_by(F.struct(*others), key).alias("r")).select("experiment_id", "r.*")


def experiments_of(experiments: DataFrame, env_id: str | None = None) -> DataFrame:
    """Experiments of one environment, or of any, last updated first."""
    wanted = F.col("env_id") == env_id if env_id else F.col("env_id").isNotNull()
    return experiments.where(wanted).orderBy(F.col("updated_at").desc(), "experiment_id")


def latest_activities(activities: DataFrame, limit: int = 20) -> DataFrame:
    """The last ``limit`` activities of each experiment.

    The rank filter is applied per task before the shuffle as well, so a very
    active experiment sends at most ``limit`` rows per task.
    """
    order = Window.partitionBy("experiment_id").orderBy(F.col("created_at").desc(), "activity_id")
    return activities.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
