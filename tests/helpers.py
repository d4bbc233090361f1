"""Small builders shared by the tests."""

import datetime as dt

from liftwise.operators.normalize import run_defaults

UTC = dt.timezone.utc
NUMBERS = ("n", "k", "sum", "sum_squares", "mean", "variance")
STATS = (
    "run_id string, metric_ord int, metric string, role string, metric_type string, metric_agg string, inverse boolean,"
    " variant string, n double, k double, sum double, sum_squares double, mean double, variance double"
)


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


def stats(spark, rows):
    """rows: (run, ord, metric, role, inverse, variant, numbers dict)."""
    data = []
    for run, order, metric, role, inverse, variant, numbers in rows:
        kind = "binary" if "k" in numbers else "continuous"
        data.append((run, order, metric, role, kind, "once", inverse, variant, *[
            float(numbers[c]) if c in numbers else None for c in NUMBERS
        ]))
    return spark.createDataFrame(data, STATS)


def runs(spark, rows):
    """rows: dicts of raw run columns."""
    schema = {
        "run_id": "string", "env_id": "string", "flag_key": "string", "method": "string", "control_variant": "string",
        "treatment_variant": "string", "primary_metric_event": "string", "primary_metric_type": "string",
        "primary_metric_agg": "string", "guardrail_events": "string", "observation_start": "timestamp",
        "observation_end": "timestamp", "prior_proper": "boolean", "prior_mean": "double", "prior_stddev": "double",
        "minimum_sample": "int", "slug": "string", "data_source_mode": "string", "input_data": "string",
        "traffic_percent": "double", "traffic_offset": "int", "layer_id": "string", "audience_filters": "string",
    }
    data = [tuple(r.get(c) for c in schema) for r in rows]
    df = spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in schema.items()))
    return run_defaults(df, "2024-02-01 00:00:00")
