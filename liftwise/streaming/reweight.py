"""Periodic bandit re-weighting, from the event tables or from statistics that follow the landed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from liftwise.operators.attribution import load_design, to_stats
from liftwise.operators.normalize import metric_specs
from liftwise.plans.analyze import live_statistics
from liftwise.plans.bandit import bandit_arms, bandit_weights, default_seed, rollout_ranges
from liftwise.session import materialize
from liftwise.streaming.incremental import RunningStatistics
from liftwise.streaming.ingest import Landing

INTERVAL = "15 minutes"


def weights_of(stats: DataFrame, bandits: DataFrame, seed: Column | None = None) -> DataFrame:
    """Weights and rollout ranges of bandit runs from their statistics."""
    arms = bandit_arms(stats, bandits).withColumn("seed", default_seed(F.col("run_id")) if seed is None else seed)
    return rollout_ranges(bandit_weights(materialize(arms, "arms")))


def reweight(evals: DataFrame, events: DataFrame, runs: DataFrame, seed: Column | None = None) -> DataFrame:
    """Weights and rollout ranges of all bandit runs from what the tables hold now, computed anew."""
    bandits = runs.where(F.col("method") == "bandit")
    return weights_of(live_statistics(evals, events, bandits), bandits, seed)


def reweight_step(evals: Landing, events: Landing, state: RunningStatistics, runs: DataFrame, seed: Column | None = None) -> DataFrame:
    """Take in what has landed since the last step and return the weights of all bandit runs.

    Only parts with new batches are read. The step is labelled with the last
    batch that both tables show, so repeating it adds nothing.
    """
    bandits = runs.where(F.col("method") == "bandit")
    design = load_design(bandits, metric_specs(bandits))
    landed = [t.rows.landed() for t in (evals, events)]
    done = state.done()
    if None not in landed and (done is None or min(landed) > done):
        batch = min(landed)
        after = -1 if done is None else done
        new = [t.rows.read(after=after).where((F.col("ingest_batch") > after) & (F.col("ingest_batch") <= batch)) for t in (evals, events)]
        state.advance(*new, design, batch)
    return weights_of(to_stats(state.statistics(design)), bandits, seed)


def start_reweighting(
    ticks: DataFrame, evals: Landing, events: Landing, state: RunningStatistics, runs: DataFrame, out: str, checkpoint: str,
    interval: str = INTERVAL, available_now: bool = False, seed: Column | None = None,
) -> StreamingQuery:
    """Make a step whenever ``ticks`` (for instance new event files) brings a batch.

    The weights of each step are stored under its batch number; a replay replaces them.
    """

    def write(df: DataFrame, batch: int) -> None:
        weights = reweight_step(evals, events, state, runs, seed)
        weights.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    writer = ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
