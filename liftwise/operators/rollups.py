"""Daily rollups with states that merge over any range of days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPOSURE_KEYS = ("env_id", "flag_key", "variant")
EVENT_KEYS = ("env_id", "event_name")


def _day() -> Column:
    return F.to_date("timestamp").alias("date")


def exposure_user_days(evals: DataFrame) -> DataFrame:
    """The exact-distinct state: each user once per (env, flag, variant, day)."""
    return evals.select(*EXPOSURE_KEYS, _day(), "user_key").distinct()


def event_user_days(events: DataFrame) -> DataFrame:
    """The exact state: per (env, event, day, user) the events, value sum and square sum."""
    v = F.col("numeric_value")
    return events.groupBy(*EVENT_KEYS, _day(), "user_key").agg(
        F.count("*").alias("events"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("value_sum"),
        F.coalesce(F.sum(v * v), F.lit(0.0)).alias("value_sum_sq"),
    )


def exposure_daily(evals: DataFrame) -> DataFrame:
    """Exact distinct users per (env, flag, day, variant)."""
    return exposure_user_days(evals).groupBy(*EXPOSURE_KEYS, "date").agg(F.count("*").alias("users"))


def event_daily(events: DataFrame) -> DataFrame:
    """Exact distinct users, events, value sum and square sum per (env, event, day)."""
    return event_user_days(events).groupBy(*EVENT_KEYS, "date").agg(
        F.count("*").alias("users"), F.sum("events").alias("events"),
        F.sum("value_sum").alias("value_sum"), F.sum("value_sum_sq").alias("value_sum_sq"),
    )


def exposure_daily_sketch(evals: DataFrame, precision: int = 14) -> DataFrame:
    """Approximate form: a mergeable sketch of the users per (env, flag, day, variant)."""
    return evals.groupBy(*EXPOSURE_KEYS, _day()).agg(F.hll_sketch_agg("user_key", precision).alias("users_sketch"))


def event_daily_sketch(events: DataFrame, precision: int = 14) -> DataFrame:
    """Approximate form of the event rollup, with exact counts and sums."""
    v = F.col("numeric_value")
    return events.groupBy(*EVENT_KEYS, _day()).agg(
        F.hll_sketch_agg("user_key", precision).alias("users_sketch"), F.count("*").alias("events"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("value_sum"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("value_sum_sq"),
    )


def _in_days(df: DataFrame, start: str | dt.date, end: str | dt.date) -> DataFrame:
    return df.where(F.col("date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))


def merge_exposures(user_days: DataFrame, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """Exact distinct users over a range of days; a user seen on several days counts once."""
    return (
        _in_days(user_days, start, end).select(*EXPOSURE_KEYS, "user_key").distinct()
        .groupBy(*EXPOSURE_KEYS).agg(F.count("*").alias("users"))
    )


def merge_events(user_days: DataFrame, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """Exact event totals over a range of days."""
    per_user = _in_days(user_days, start, end).groupBy(*EVENT_KEYS, "user_key").agg(
        *[F.sum(c).alias(c) for c in ("events", "value_sum", "value_sum_sq")]
    )
    return per_user.groupBy(*EVENT_KEYS).agg(
        F.count("*").alias("users"), *[F.sum(c).alias(c) for c in ("events", "value_sum", "value_sum_sq")]
    )


def merge_exposure_sketches(daily: DataFrame, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """Approximate distinct users over a range of days, by uniting the daily sketches."""
    return _in_days(daily, start, end).groupBy(*EXPOSURE_KEYS).agg(
        F.hll_sketch_estimate(F.hll_union_agg("users_sketch")).alias("users")
    )


def merge_event_sketches(daily: DataFrame, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """Approximate users with exact totals over a range of days."""
    return _in_days(daily, start, end).groupBy(*EVENT_KEYS).agg(
        F.hll_sketch_estimate(F.hll_union_agg("users_sketch")).alias("users"),
        *[F.sum(c).alias(c) for c in ("events", "value_sum", "value_sum_sq")],
    )
