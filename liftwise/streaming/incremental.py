"""Variant statistics that follow the event stream: each step reads only the rows that are new.

Kept per run: every user's first exposure, every user's count and sum per
metric, and per (run, metric, variant) the users, converters, sum and sum of
squares. A step takes the new evaluations and events, finds the users they
change, subtracts what these users had contributed and adds what they
contribute now. First exposures only ever become earlier, so what was counted
once stays counted and may at most move to another variant; what an earlier
exposure brings in can only be among the events of the last days, which are
kept for as long as a late evaluation is still allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftwise.operators.attribution import Design, attributed_events, contribution, first_exposures, stats_of_sums
from liftwise.sources.generations import FAN_IN, Generations
from liftwise.streaming.ingest import interval_micros

_USER = ["run_id", "env_id", "user_key"]
_EXPOSURES = "run_id string, env_id string, user_key string, variant string, exposure_ts timestamp, old_variant string, old_ts timestamp"
_TOTALS = "run_id string, env_id string, user_key string, metric_ord int, conv_count bigint, user_sum double"
_RECENT = "env_id string, event_name string, user_key string, numeric_value double, timestamp timestamp"
_SUMS = "run_id string, metric_ord int, variant string, users bigint, conversions bigint, total double, squares double"
#: metric_ord of the rows that count exposed users.
_USERS = -1


def _earliest(exposures: DataFrame) -> DataFrame:
    first = exposures.groupBy(*_USER).agg(F.min(F.struct("exposure_ts", "variant")).alias("x"))
    nothing = F.lit(None)
    return first.select(*_USER, F.col("x.variant").alias("variant"), F.col("x.exposure_ts").alias("exposure_ts"), nothing.cast("string").alias("old_variant"), nothing.cast("timestamp").alias("old_ts"))


def _added(totals: DataFrame) -> DataFrame:
    return totals.groupBy(*_USER, "metric_ord").agg(F.sum("conv_count").alias("conv_count"), F.sum("user_sum").alias("user_sum"))


def _summed(sums: DataFrame) -> DataFrame:
    return sums.groupBy("run_id", "metric_ord", "variant").agg(*[F.sum(c).alias(c) for c in ("users", "conversions", "total", "squares")])


class RunningStatistics:
    """The kept state at ``path``; ``lateness`` is how far an evaluation may lag behind the latest one."""

    def __init__(self, spark: SparkSession, path: str, lateness: str = "2 days", fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.lateness = interval_micros(spark, lateness)
        self.exposures = Generations(spark, f"{path}/exposures", _EXPOSURES, time="exposure_ts")
        self.totals = Generations(spark, f"{path}/totals", _TOTALS)
        self.recent = Generations(spark, f"{path}/recent", _RECENT)
        self.sums = Generations(spark, f"{path}/sums", _SUMS)

    def done(self) -> int | None:
        """The last batch whose rows are in the statistics."""
        return self.sums.landed()

    def advance(self, evals: DataFrame, events: DataFrame, design: Design, batch: int) -> None:
        """Take in the new rows of one batch.

        The four tables are written in a set order, each from the state before
        this batch, so a batch that failed half-way can be repeated: what it had
        written stays, the rest follows. A run must be in ``design`` from the
        first batch of its window on; for one that is added later, take in the
        tables' rows of its window once, with a design of that run alone.
        """
        if self.done() is not None and self.done() >= batch:
            return
        known = _earliest(self.exposures.read(before=batch))
        before = known.select(*_USER, F.col("variant").alias("_variant"), F.col("exposure_ts").alias("_ts"))
        first = first_exposures(evals, design).join(before, _USER, "left")
        earlier = F.col("_ts").isNull() | (F.struct("exposure_ts", "variant") < F.struct(F.col("_ts").alias("exposure_ts"), F.col("_variant").alias("variant")))
        self.exposures.append(first.where(earlier).withColumnsRenamed({"_variant": "old_variant", "_ts": "old_ts"}), batch)
        changed = self.exposures.read(after=batch - 1)

        current = _earliest(self.exposures.read())
        users = events.select("env_id", "user_key").distinct()
        new = attributed_events(events, current.join(users, ["env_id", "user_key"], "left_semi"), design)
        # Events that came before the exposure that now covers them.
        old = attributed_events(self._recent(batch), changed, design).where(F.col("old_ts").isNull() | (F.col("event_ts") < F.col("old_ts")))
        columns = [*_USER, "metric_ord", "value"]
        additions = new.select(*columns).unionAll(old.select(*columns)).groupBy(*_USER, "metric_ord")
        self.totals.append(additions.agg(F.count("*").alias("conv_count"), F.sum("value").alias("user_sum")), batch)
        wanted = design.metrics.select("env_id", "event_name")
        self.recent.append(events.join(wanted, ["env_id", "event_name"], "left_semi"), batch)
        self.sums.append(self._changes(changed, current, design, batch), batch)

        self.exposures.compact(_earliest, self.fan_in)
        self.totals.compact(_added, self.fan_in)
        self.recent.compact(lambda rows: rows.where(F.col("timestamp") >= self._horizon()), self.fan_in)
        self.sums.compact(_summed, self.fan_in)

    def _horizon(self, before: int | None = None) -> Column:
        """No evaluation before this instant can still come, so no event before it can change hands."""
        latest = self.exposures.latest(before)
        return F.lit("0001-01-01").cast("timestamp") if latest is None else F.timestamp_micros(F.lit(latest - self.lateness))

    def _recent(self, batch: int) -> DataFrame:
        return self.recent.read(before=batch).where(F.col("timestamp") >= self._horizon(batch))

    def _changes(self, changed: DataFrame, current: DataFrame, design: Design, batch: int) -> DataFrame:
        """What to add to the sums: old contributions taken off, new ones put on."""
        added = self.totals.read(after=batch - 1)
        moved = changed.where(F.col("old_ts").isNotNull())
        touched = added.select(*_USER).unionAll(moved.select(*_USER)).distinct()
        had = _added(self.totals.read(before=batch).join(touched, _USER, "left_semi"))
        zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
        both = had.select(*_USER, "metric_ord", F.col("conv_count").alias("c0"), F.col("user_sum").alias("s0"), F.col("conv_count").alias("c1"), F.col("user_sum").alias("s1"))
        both = both.unionAll(added.select(*_USER, "metric_ord", zero, none, "conv_count", "user_sum"))
        both = both.groupBy(*_USER, "metric_ord").agg(*[F.sum(c).alias(c) for c in ("c0", "s0", "c1", "s1")])
        was = moved.select(*_USER, F.col("old_variant").alias("_was"), F.lit(True).alias("_moved"))
        arms = current.join(touched, _USER, "left_semi").join(was, _USER, "left").select(*_USER, "variant", F.when(F.col("_moved"), F.col("_was")).otherwise(F.col("variant")).alias("was"))
        rows = both.join(arms, _USER).join(design.metrics.select("run_id", "metric_ord", "metric_agg"), ["run_id", "metric_ord"])
        sides = F.array(
            F.struct(F.col("was").alias("variant"), F.lit(-1).alias("sign"), F.col("c0").alias("c"), F.col("s0").alias("s")),
            F.struct(F.col("variant"), F.lit(1).alias("sign"), F.col("c1").alias("c"), F.col("s1").alias("s")),
        )
        sided = rows.select("run_id", "metric_ord", "metric_agg", F.explode(sides).alias("x")).select("run_id", "metric_ord", "metric_agg", "x.*").where("c > 0")
        x = contribution(F.col("metric_agg"), F.col("c"), F.col("s"))
        sums = sided.withColumn("x", x).groupBy("run_id", "metric_ord", "variant").agg(
            F.lit(0).cast("bigint").alias("users"), F.sum("sign").alias("conversions"), F.sum(F.col("sign") * F.col("x")).alias("total"),
            F.sum(F.col("sign") * F.col("x") * F.col("x")).alias("squares"),
        )
        gone = moved.select("run_id", F.col("old_variant").alias("variant"), F.lit(-1).alias("n"))
        users = changed.select("run_id", "variant", F.lit(1).alias("n")).unionAll(gone).groupBy("run_id", "variant").agg(F.sum("n").alias("users"))
        return sums.unionByName(users.select("run_id", F.lit(_USERS).alias("metric_ord"), "variant", "users", zero.alias("conversions"), none.alias("total"), none.alias("squares")))

    def statistics(self, design: Design) -> DataFrame:
        """Variant statistics of the runs in ``design`` as of the last step, in the shape of ``variant_stats``."""
        held = _summed(self.sums.read())
        users = held.where((F.col("metric_ord") == _USERS) & (F.col("users") > 0)).select("run_id", "variant", "users")
        some = F.col("conversions") > 0  # what is left of a variant that everybody moved out of is rounding
        sums = held.where((F.col("metric_ord") != _USERS) & some).select(
            "run_id", "metric_ord", "variant", F.col("conversions").alias("_conversions"), F.col("total").alias("_sum"), F.col("squares").alias("_squares")
        )
        return stats_of_sums(users, sums, design)
