"""Row predicates on the event tables, and argument checks."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.functions.hashing import hash_bucket
from liftwise.schemas import AUDIENCE_FILTERS, FILTER_OPS, METRIC_AGGS, METRIC_TYPES


def _date(value: str | dt.date, label: str) -> dt.date:
    if isinstance(value, dt.date):
        return value
    try:
        return dt.datetime.strptime(value, "%Y-%m-%d").date()
    except (TypeError, ValueError):
        raise ValueError(f"{label} must be YYYY-MM-DD") from None


def day_start(day: Column) -> Column:
    """First instant of a UTC day."""
    return day.cast("date").cast("timestamp")


def in_window(ts: Column, start: Column, end: Column) -> Column:
    """Whether ``ts`` falls on a UTC day between ``start`` and ``end``, both included.

    Written as an instant range, which scans can compare with file statistics.
    """
    return (ts >= day_start(start)) & (ts < day_start(F.date_add(end.cast("date"), 1)))


def scan_window(df: DataFrame, start: str | dt.date, end: str | dt.date, ts: str = "timestamp") -> DataFrame:
    """Restrict an event table to a window known when the plan is built.

    Adds the month range when the table is partitioned by ``event_month``, so
    that other months are not listed, besides the pushed instant range.
    """
    start, end = _date(start, "start"), _date(end, "end")
    if "event_month" in df.columns:
        df = df.where(F.col("event_month").between(int(start.strftime("%Y%m")), int(end.strftime("%Y%m"))))
    upper = end + dt.timedelta(days=1)
    return df.where((F.col(ts) >= F.lit(dt.datetime(start.year, start.month, start.day, tzinfo=dt.timezone.utc)))
                    & (F.col(ts) < F.lit(dt.datetime(upper.year, upper.month, upper.day, tzinfo=dt.timezone.utc))))


def scan_environment(df: DataFrame, env_id: str, requested_env: str | None = None) -> DataFrame:
    """Restrict to the caller's environment; asking for another one is an error."""
    if not env_id:
        raise ValueError("env_id is required")
    if requested_env and requested_env != env_id:
        raise ValueError("requested env_id does not match the caller's environment")
    return df.where(F.col("env_id") == env_id)


def scan_flag(evals: DataFrame, flag_key: str) -> DataFrame:
    return evals.where(F.col("flag_key") == flag_key)


def scan_event(events: DataFrame, event_name: str) -> DataFrame:
    return events.where(F.col("event_name") == event_name)


def validate_query(
    *, flag_key: str, metric_event: str, start: str | dt.date, end: str | dt.date, metric_type: str, metric_agg: str
) -> tuple[dt.date, dt.date]:
    """Check the arguments of a statistics query; returns the window bounds."""
    required = (flag_key, metric_event, str(start or ""), str(end or ""), metric_type, metric_agg)
    if any(not (value or "").strip() for value in required):
        raise ValueError("flag_key, metric_event, start, end, metric_type, metric_agg are all required")
    if metric_type not in METRIC_TYPES:
        raise ValueError("metric_type must be one of " + ", ".join(METRIC_TYPES))
    if metric_agg not in METRIC_AGGS:
        raise ValueError("metric_agg must be one of " + ", ".join(METRIC_AGGS))
    first, last = _date(start, "start"), _date(end, "end")
    if last < first:
        raise ValueError("end must not be before start")
    return first, last


def argument_error() -> Column:
    """What ``validate_query`` would say of a row of query arguments, null if they are sound.

    Over columns caller_env, env_id, flag_key, metric_event, start, end,
    metric_type, metric_agg, all text. A row that asks for an environment other
    than its caller's is refused after its arguments are found sound.
    """
    needed = ["flag_key", "metric_event", "start", "end", "metric_type", "metric_agg"]
    blank = reduce(lambda a, b: a | b, [F.trim(F.coalesce(c, F.lit(""))) == "" for c in needed])
    shape = r"^\d{4}-\d{2}-\d{2}$"
    days = {c: F.when(F.col(c).rlike(shape), F.try_to_date(c, "yyyy-MM-dd")) for c in ("start", "end")}
    other = F.coalesce(F.col("env_id"), F.lit("")) != ""
    return (
        F.when(blank, F.lit("flag_key, metric_event, start, end, metric_type, metric_agg are all required"))
        .when(~F.col("metric_type").isin(*METRIC_TYPES), F.lit("metric_type must be one of " + ", ".join(METRIC_TYPES)))
        .when(~F.col("metric_agg").isin(*METRIC_AGGS), F.lit("metric_agg must be one of " + ", ".join(METRIC_AGGS)))
        .when(days["start"].isNull(), F.lit("start must be YYYY-MM-DD"))
        .when(days["end"].isNull(), F.lit("end must be YYYY-MM-DD"))
        .when(days["end"] < days["start"], F.lit("end must not be before start"))
        .when(F.coalesce(F.col("caller_env"), F.lit("")) == "", F.lit("env_id is required"))
        .when(other & (F.col("env_id") != F.col("caller_env")), F.lit("requested env_id does not match the caller's environment"))
    )


def clamp_traffic(percent: Column, offset: Column) -> tuple[Column, Column]:
    """Traffic slice with defaults 100 and 0, percent kept in 1-100, offset in 0-99."""
    percent = F.least(F.lit(100.0), F.greatest(F.lit(1.0), F.coalesce(percent.cast("double"), F.lit(100.0))))
    offset = F.least(F.lit(99), F.greatest(F.lit(0), F.coalesce(offset.cast("int"), F.lit(0))))
    return percent, offset


def in_traffic_slice(bucket: Column, percent: Column, offset: Column) -> Column:
    """Bucket in [offset, offset + percent); a full slice takes everyone."""
    percent, offset = clamp_traffic(percent, offset)
    return (percent >= 100) | ((bucket >= offset) & (bucket < offset + percent))


def user_in_traffic_slice(user_key: Column, flag_key: Column, percent: Column, offset: Column) -> Column:
    return in_traffic_slice(hash_bucket(user_key, flag_key), percent, offset)


def in_layer(layer_id: Column, run_layer: Column) -> Column:
    """Evaluations tagged with the run's layer; a run without a layer takes all."""
    return F.coalesce((run_layer.isNull()) | (layer_id == run_layer), F.lit(False))


def audience_rules(filters_json: Column) -> Column:
    """Parse audience filter text into array<struct<property, op, values>>.

    Blank properties are dropped, an unknown operator reads as ``eq``, values
    are trimmed; text that is absent or not an array means no restriction.
    """
    parsed = F.coalesce(F.from_json(filters_json, AUDIENCE_FILTERS), F.array().cast(AUDIENCE_FILTERS))

    def rule(f: Column) -> Column:
        op = F.when(f["op"].isin(*FILTER_OPS), f["op"]).otherwise(F.lit("eq"))
        many = F.filter(
            F.transform(F.coalesce(f["values"], F.array().cast("array<string>")), lambda v: F.trim(v)),
            lambda v: v != "",
        )
        one = F.array(F.trim(F.coalesce(f["value"], F.lit(""))))
        return F.struct(
            F.trim(f["property"]).alias("property"),
            op.alias("op"),
            F.when(op.isin("in", "nin"), many).otherwise(one).alias("values"),
        )

    return F.transform(
        F.filter(parsed, lambda f: F.trim(F.coalesce(f["property"], F.lit(""))) != ""), rule
    )


def in_audience(user_properties: Column, rules: Column) -> Column:
    """All rules hold for the properties JSON text.

    An absent property fails ``eq`` and ``in`` and passes ``neq`` and ``nin``.
    """
    props = F.coalesce(
        F.from_json(user_properties, "map<string,string>"), F.create_map().cast("map<string,string>")
    )

    def holds(rule: Column) -> Column:
        found = F.coalesce(F.array_contains(rule["values"], props[rule["property"]]), F.lit(False))
        return F.when(rule["op"].isin("eq", "in"), found).otherwise(~found)

    return (F.size(rules) == 0) | F.forall(rules, holds)
