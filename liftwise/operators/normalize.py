"""Normalisers and rule checks for run and metric definitions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.schemas import (
    DECISIONS, GUARDRAIL_DIRECTIONS, GUARDRAIL_ELEMENT, METHODS, METRIC_AGGS,
    METRIC_DEFINITION, METRIC_TYPES, RUN_STATUSES,
)

_STRINGS = "array<string>"


def metric_type(value: Column) -> Column:
    """``continuous`` (also its old spelling ``numeric``) or ``binary``."""
    return F.when(value.isin("continuous", "numeric"), F.lit("continuous")).otherwise(F.lit("binary"))


def metric_agg_read(agg: Column) -> Column:
    """Aggregation as stored definitions are read: anything unknown is ``once``."""
    return F.when(agg.isin("count", "sum", "average"), agg).otherwise(F.lit("once"))


def metric_agg_write(agg: Column, type_: Column) -> Column:
    """Aggregation as definitions are saved: binary is ``once``, else unknown is ``sum``."""
    return (
        F.when(metric_type(type_) == "binary", F.lit("once"))
        .when(agg.isin("count", "sum", "average"), agg)
        .otherwise(F.lit("sum"))
    )


def canonical_agg(type_: Column, agg: Column) -> Column:
    """Aggregation a query runs with: a yes/no metric is always ``once``."""
    return F.when(type_ == "binary", F.lit("once")).otherwise(agg)


def _elements(json: Column) -> Column:
    """Elements of a JSON array as text, objects kept as JSON; null when not an array."""
    return F.when(F.ltrim(json).startswith("["), F.from_json(json, _STRINGS))


def guardrail_definitions(json: Column) -> Column:
    """Parse guardrail text into array<struct<event, metric_type, metric_agg, inverse>>.

    Elements are event names or objects; ``inverse`` falls back to
    ``direction = increase_bad``; elements without an event are dropped; text
    that is absent, broken or not an array gives an empty array.
    """

    def parse(element: Column) -> Column:
        is_object = F.ltrim(element).startswith("{")
        o = F.from_json(element, GUARDRAIL_ELEMENT)
        type_ = F.coalesce(o["metricType"], F.lit("binary"))
        return F.struct(
            F.when(is_object, o["event"]).otherwise(element).alias("event"),
            F.when(is_object, F.when(type_ == "numeric", F.lit("continuous")).otherwise(type_))
            .otherwise(F.lit("binary")).alias("metric_type"),
            F.when(is_object, F.coalesce(o["metricAgg"], F.lit("once"))).otherwise(F.lit("once")).alias("metric_agg"),
            F.when(is_object, F.coalesce(o["inverse"], o["direction"] == "increase_bad", F.lit(False)))
            .otherwise(F.lit(False)).alias("inverse"),
        )

    elements = F.coalesce(_elements(json), F.array().cast(_STRINGS))
    return F.filter(F.transform(elements, parse), lambda g: F.coalesce(g["event"], F.lit("")) != "")


def primary_metric(json: Column) -> Column:
    """Parse a primary-metric object; null unless it is an object with an event."""
    o = F.from_json(F.when(F.ltrim(json).startswith("{"), json), METRIC_DEFINITION)
    return F.when(
        F.coalesce(o["event"], F.lit("")) != "",
        F.struct(
            o["event"].alias("event"),
            metric_type(o["metricType"]).alias("metric_type"),
            metric_agg_read(o["metricAgg"]).alias("metric_agg"),
        ),
    )


def metric_title(text: Column) -> Column:
    """The part of a metric's text before an em dash, trimmed; null when blank."""
    title = F.trim(F.split(text, "—")[0])
    return F.when(title != "", title)


def treatment_names(text: Column) -> Column:
    """Names in a comma-separated list, ``true`` when it is absent."""
    names = F.transform(F.split(F.coalesce(text, F.lit("true")), ","), lambda t: F.trim(t))
    return F.filter(names, lambda t: t != "")


def run_defaults(runs: DataFrame, as_of: dt.datetime | str) -> DataFrame:
    """Fill the defaults a run is analysed with.

    Missing columns count as null. A treatment named twice, or as the control,
    is one arm. Adds ``control``, ``treatments``,
    ``start_date``, ``end_date`` and parsed ``guardrails``.
    """
    now = F.lit(as_of).cast("timestamp")

    def col(name: str, type_: str) -> Column:
        return F.col(name).cast(type_) if name in runs.columns else F.lit(None).cast(type_)

    control = F.coalesce(col("control_variant", "string"), F.lit("false"))
    treatments = F.array_remove(F.array_distinct(treatment_names(col("treatment_variant", "string"))), control)
    start = F.coalesce(col("observation_start", "timestamp"), now - F.expr("interval 30 days"))
    end = F.coalesce(col("observation_end", "timestamp"), now)
    derived = {
        "slug": F.coalesce(col("slug", "string"), F.lit("on-demand")),
        "method": F.coalesce(col("method", "string"), F.lit("bayesian_ab")),
        "control": control,
        "treatments": treatments,
        "start_date": start.cast("date"),
        "end_date": end.cast("date"),
        "prior_proper": F.coalesce(col("prior_proper", "boolean"), F.lit(False)),
        "prior_mean": F.coalesce(col("prior_mean", "double"), F.lit(0.0)),
        "prior_stddev": F.coalesce(col("prior_stddev", "double"), F.lit(0.3)),
        "minimum_sample": F.coalesce(col("minimum_sample", "int"), F.lit(0)),
        "primary_metric_type": metric_type(col("primary_metric_type", "string")),
        "primary_metric_agg": metric_agg_read(col("primary_metric_agg", "string")),
        "guardrails": guardrail_definitions(col("guardrail_events", "string")),
        "data_source_mode": F.coalesce(col("data_source_mode", "string"), F.lit("managed")),
    }
    return runs.withColumns(derived)


def metric_specs(runs: DataFrame) -> DataFrame:
    """One row per (run, metric): the primary first, then guardrails in order.

    ``runs`` comes from ``run_defaults``. An event named twice keeps the later
    definition, as a keyed document would; the primary metric stays primary and
    first, with the definition of a guardrail that has its event. An optional ``primary_inverse``
    column marks a primary metric where lower is better.
    """
    inverse = F.coalesce(F.col("primary_inverse"), F.lit(False)) if "primary_inverse" in runs.columns else F.lit(False)
    primary = F.array(
        F.struct(
            F.col("primary_metric_event").alias("event"),
            F.col("primary_metric_type").alias("metric_type"),
            F.col("primary_metric_agg").alias("metric_agg"),
            inverse.alias("inverse"),
            F.lit("primary").alias("role"),
        )
    )
    guardrails = F.transform(
        F.col("guardrails"),
        lambda g: F.struct(
            g["event"].alias("event"),
            metric_type(g["metric_type"]).alias("metric_type"),
            metric_agg_read(g["metric_agg"]).alias("metric_agg"),
            g["inverse"].alias("inverse"),
            F.lit("guardrail").alias("role"),
        ),
    )
    every = runs.where(F.col("primary_metric_event").isNotNull()).select(
        "run_id", "env_id", F.concat(primary, guardrails).alias("specs")
    )
    later = F.filter(
        F.col("specs"),
        lambda s, i: ~F.exists(
            F.slice(F.col("specs"), i + 2, F.size("specs")), lambda t: t["event"] == s["event"]
        ),
    )
    main = F.col("specs")[0]["event"]
    first = F.transform(F.filter(later, lambda s: s["event"] == main), lambda s: s.withField("role", F.lit("primary")))
    ordered = F.concat(first, F.filter(later, lambda s: s["event"] != main))
    return every.select("run_id", "env_id", F.posexplode(ordered).alias("metric_ord", "m")).select(
        "run_id", "env_id", "metric_ord",
        F.col("m.role").alias("role"),
        F.col("m.event").alias("event_name"),
        F.col("m.metric_type").alias("metric_type"),
        F.col("m.metric_agg").alias("metric_agg"),
        F.col("m.inverse").alias("inverse"),
    )


def union_specs(primary: DataFrame, guardrails: DataFrame) -> DataFrame:
    """Primary specs before guardrail specs, order kept in ``ord``."""
    return primary.withColumn("ord", F.lit(0)).unionByName(
        guardrails.withColumn("ord", F.col("metric_ord") + 1).drop("metric_ord"), allowMissingColumns=True
    )


def distinct_events(events: Column) -> Column:
    """A list of event names without blanks and repeats, first occurrences kept."""
    return F.array_distinct(F.filter(events, lambda e: F.coalesce(e, F.lit("")) != ""))


def _not_in(column: str, label: str, allowed: tuple[str, ...]) -> Column:
    value = F.col(column)
    return F.when(
        value.isNotNull() & ~value.isin(*allowed),
        F.concat(F.lit(f'Invalid {label} "'), value, F.lit('". Valid: ' + " | ".join(allowed))),
    )


def run_violations(runs: DataFrame) -> DataFrame:
    """Add ``violations``: one message per field outside its vocabulary."""
    checks = [
        ("status", "status", RUN_STATUSES),
        ("method", "method", METHODS),
        ("decision", "decision", DECISIONS),
        ("primary_metric_type", "primaryMetricType", METRIC_TYPES),
        ("primary_metric_agg", "primaryMetricAgg", METRIC_AGGS),
    ]
    present = [_not_in(c, label, allowed) for c, label, allowed in checks if c in runs.columns]
    if "treatment_variant" in runs.columns:
        names = treatment_names(F.col("treatment_variant"))
        if "control_variant" in runs.columns:
            names = F.concat(names, F.array(F.coalesce("control_variant", F.lit("false"))))
        present.append(F.when(F.size(F.array_distinct(names)) < F.size(names), F.lit("Variants must differ from each other and from the control")))
    return runs.withColumn("violations", F.array_compact(F.array(*present)))


def _definition_errors(o: Column, label: Column | str, needs_direction: bool) -> Column:
    name = label if isinstance(label, Column) else F.lit(label)

    def must(condition: Column, text: str) -> Column:
        return F.when(~F.coalesce(condition, F.lit(False)), F.concat(name, F.lit(text)))

    rules = [
        must(o["name"] != "", ".name is required (non-empty string)."),
        must(o["event"] != "", ".event is required (non-empty string)."),
        must(o["metricType"].isin(*METRIC_TYPES), ".metricType must be one of: " + " | ".join(METRIC_TYPES)),
        must(o["metricAgg"].isin(*METRIC_AGGS), ".metricAgg must be one of: " + " | ".join(METRIC_AGGS)),
    ]
    if needs_direction:
        rules.append(
            must(o["direction"].isin(*GUARDRAIL_DIRECTIONS),
                 ".direction must be one of: " + " | ".join(GUARDRAIL_DIRECTIONS))
        )
    return F.array_compact(F.array(*rules))


def primary_definition_violations(json: Column) -> Column:
    """Messages for a primary-metric definition text; empty when it is valid."""
    is_object = F.coalesce(F.ltrim(json).startswith("{"), F.lit(False))
    o = F.from_json(json, METRIC_DEFINITION)
    return F.when(
        ~is_object | o.isNull(), F.array(F.lit("primaryMetric must be a JSON object."))
    ).otherwise(_definition_errors(o, "primaryMetric", False))


def guardrail_definition_violations(json: Column) -> Column:
    """Messages for a guardrail list text, numbered by element; empty when valid."""
    elements = _elements(json)

    def check(element: Column, i: Column) -> Column:
        label = F.concat(F.lit("guardrail["), i.cast("string"), F.lit("]"))
        o = F.from_json(element, METRIC_DEFINITION)
        is_object = F.coalesce(F.ltrim(element).startswith("{"), F.lit(False))
        return F.when(
            ~is_object | o.isNull(), F.array(F.concat(label, F.lit(" must be a JSON object.")))
        ).otherwise(_definition_errors(o, label, True))

    return F.when(
        elements.isNull(), F.array(F.lit("guardrails must be a JSON array."))
    ).otherwise(F.flatten(F.transform(elements, check)))


def migrate_definitions(experiments: DataFrame) -> DataFrame:
    """Rewrite old metric definitions and stages to the current vocabulary.

    Adds ``new_stage``, ``new_primary_metric``, ``new_guardrails`` (JSON text),
    ``run_guardrail_events`` (only the fields a run needs) and ``changed``.
    Broken or non-matching text is left as it is.
    """
    p = F.from_json(F.when(F.ltrim("primary_metric").startswith("{"), F.col("primary_metric")), METRIC_DEFINITION)
    new_primary = F.when(
        p.isNotNull(),
        F.to_json(F.struct(
            p["name"].alias("name"),
            p["event"].alias("event"),
            metric_type(p["metricType"]).alias("metricType"),
            metric_agg_write(p["metricAgg"], p["metricType"]).alias("metricAgg"),
            p["description"].alias("description"),
        )),
    ).otherwise(F.col("primary_metric"))

    def element(e: Column) -> Column:
        bare = ~F.ltrim(e).startswith("{")
        o = F.from_json(e, METRIC_DEFINITION)
        return F.struct(
            F.when(~bare, o["name"]).alias("name"),
            F.when(bare, e).otherwise(o["event"]).alias("event"),
            metric_type(F.when(~bare, o["metricType"])).alias("metricType"),
            metric_agg_write(F.when(~bare, o["metricAgg"]), F.when(~bare, o["metricType"])).alias("metricAgg"),
            F.coalesce(
                F.when(~bare, o["inverse"]), F.when(~bare, o["direction"] == "increase_bad"), F.lit(False)
            ).alias("inverse"),
            F.when(~bare, o["direction"]).alias("direction"),
        )

    elements = _elements(F.col("guardrails"))
    rewritten = F.transform(elements, element)
    slim = F.filter(
        F.transform(
            rewritten,
            lambda g: F.struct(
                F.trim(F.coalesce(g["event"], g["name"], F.lit(""))).alias("event"),
                g["metricType"].alias("metricType"), g["metricAgg"].alias("metricAgg"), g["inverse"].alias("inverse"),
            ),
        ),
        lambda g: g["event"] != "",
    )
    stage = F.when(F.col("stage") == "intent", F.lit("hypothesis")).otherwise(F.col("stage"))
    return experiments.withColumns({
        "new_stage": stage,
        "new_primary_metric": new_primary,
        "new_guardrails": F.when(elements.isNotNull(), F.to_json(rewritten)).otherwise(F.col("guardrails")),
        "run_guardrail_events": F.when(F.size(slim) > 0, F.to_json(slim)),
    }).withColumn(
        "changed",
        ~(
            F.col("new_stage").eqNullSafe(F.col("stage"))
            & F.col("new_primary_metric").eqNullSafe(F.col("primary_metric"))
            & F.col("new_guardrails").eqNullSafe(F.col("guardrails"))
        ),
    )
