"""First-exposure attribution and per-variant sufficient statistics.

All runs and all metrics are served by one plan:

1. ``first_exposures``: evaluations meet the run table, in the map stage when it
   is small enough to broadcast, and are reduced to one row per (run, user) before anything wide moves.
2. ``user_totals``: events are shuffled once, by user, whatever the number of
   runs and metrics, and only then meet exposures and metric specs. Runs and
   metrics multiply rows after the shuffle, inside a map-side aggregate.
3. ``variant_stats``: sums per (run, metric, variant), added to the exposed-user
   counts at that small grain. Users without events contribute zeros to every
   sum, so no user-level outer join is needed.

The user join is a plain equi-join on two shuffled inputs, which adaptive
execution may split when one user holds a large share of the events.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from liftwise.functions.hashing import user_order_hash
from liftwise.operators import filters as fl
from liftwise.operators.normalize import canonical_agg


@dataclass(frozen=True)
class DesignFilters:
    """Optional exposure filters of a run; all off reproduces the plain query."""

    traffic: bool = False
    layer: bool = False
    audience: bool = False
    experiment: bool = False

    def columns(self) -> list[str]:
        names = []
        if self.traffic:
            names += ["traffic_percent", "traffic_offset"]
        if self.layer:
            names += ["layer_id"]
        if self.audience:
            names += ["audience_filters"]
        if self.experiment:
            names += ["experiment_id"]
        return names


NO_FILTERS = DesignFilters()


@dataclass(frozen=True)
class Design:
    """Runs and metric specs as plain frames; Spark decides by their bytes how to join them.

    ``window`` spans all runs, to be pushed into the scans. ``shared`` is the
    number of distinct (environment, flag, window) of the runs, if several runs
    have the same on average, and 0 otherwise.
    """

    runs: DataFrame
    specs: DataFrame | None
    window: tuple[dt.date, dt.date] | None
    shared: int = 0

    @property
    def metrics(self) -> DataFrame:
        if self.specs is None:
            raise ValueError("this design was loaded without metric specs")
        return self.specs


_RUN_COLUMNS = ("run_id", "env_id", "flag_key", "start_date", "end_date")
_RUN_OPTIONS = ("method", "traffic_percent", "traffic_offset", "layer_id", "audience_filters", "experiment_id")
_WINDOW = ("env_id", "flag_key", "from_ts", "until_ts")
_SPEC_COLUMNS = ("run_id", "env_id", "metric_ord", "role", "event_name", "metric_type", "metric_agg", "inverse")


def load_design(runs: DataFrame, specs: DataFrame | None = None) -> Design:
    """Pick the columns the plans need; the only job is one aggregate row, the span and number of all runs.

    ``runs`` needs run_id, env_id, flag_key, start_date, end_date and may carry
    the columns the optional filters use. ``specs`` comes from ``metric_specs``.
    """
    options = [c for c in _RUN_OPTIONS if c in runs.columns]
    bounds = [
        fl.day_start(F.col("start_date")).alias("from_ts"),
        fl.day_start(F.date_add("end_date", 1)).alias("until_ts"),
    ]
    slim = runs.select(*_RUN_COLUMNS, *options, *bounds)
    span = slim.agg(
        F.min("start_date"), F.max("end_date"), F.count("*").alias("rows"), F.count_distinct(F.struct(*_WINDOW)).alias("windows")
    ).first()
    window = None if span[0] is None or span[1] is None else (span[0], span[1])
    if specs is None:
        return Design(slim, None, window)
    canonical = canonical_agg(F.col("metric_type"), F.col("metric_agg"))
    windows = span["windows"] if 2 * span["windows"] <= span["rows"] else 0
    return Design(slim, specs.select(*_SPEC_COLUMNS).withColumn("metric_agg", canonical), window, windows)


def _scan(df: DataFrame, design: Design) -> DataFrame:
    """Restrict a scan to the months and instants of all runs."""
    return df if design.window is None else fl.scan_window(df, *design.window)


def exposures_in_runs(evals: DataFrame, design: Design, options: DesignFilters = NO_FILTERS) -> DataFrame:
    """Evaluations paired with every run of their flag whose window covers them."""
    slim = design.runs.select(
        "run_id", "env_id", "flag_key", "from_ts", "until_ts", *[F.col(c).alias(f"run_{c}") for c in options.columns()]
    )
    if options.audience:
        slim = slim.withColumn("run_rules", fl.audience_rules(F.col("run_audience_filters")))
    paired = (
        _scan(evals, design)
        .join(slim, ["env_id", "flag_key"])
        .where((F.col("timestamp") >= F.col("from_ts")) & (F.col("timestamp") < F.col("until_ts")))
    )
    if options.traffic:
        paired = paired.where(
            fl.user_in_traffic_slice(
                F.col("user_key"), F.col("flag_key"), F.col("run_traffic_percent"), F.col("run_traffic_offset")
            )
        )
    if options.layer:
        paired = paired.where(fl.in_layer(F.col("layer_id"), F.col("run_layer_id")))
    if options.audience:
        paired = paired.where(fl.in_audience(F.col("user_properties"), F.col("run_rules")))
    if options.experiment:
        paired = paired.where(F.col("experiment_id") == F.col("run_experiment_id"))
    return paired


def first_exposures(
    evals: DataFrame,
    design: Design,
    options: DesignFilters = NO_FILTERS,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per (run, user): the first variant seen and when.

    Equal instants go to the smallest variant name. ``carry`` adds columns
    taken from that first evaluation.

    Earliest instants are taken per (run, user, variant) first: with the variant
    among the keys that is a hash aggregate with map-side combine, where a
    minimum over a struct would sort every input row.
    """
    carry = carry or {}
    # The user join below implies this filter for its own copy of the plan; with it
    # in both copies they are equal, and Spark computes the exchange only once.
    known = exposures_in_runs(evals, design, options).where(F.col("user_key").isNotNull())
    rows = known.select(
        "run_id", "env_id", "user_key", "variant", F.col("timestamp").alias("ts"),
        *[c.alias(name) for name, c in carry.items()],
    )
    earliest = rows.groupBy("run_id", "env_id", "user_key", "variant", *carry).agg(F.min("ts").alias("ts"))
    first = earliest.groupBy("run_id", "env_id", "user_key").agg(
        F.min(F.struct("ts", "variant", *carry)).alias("first")
    )
    return first.select(
        "run_id", "env_id", "user_key",
        F.col("first.variant").alias("variant"),
        F.col("first.ts").alias("exposure_ts"),
        *[F.col(f"first.{name}").alias(name) for name in carry],
    )


def balance_exposures(exposures: DataFrame, design: Design | None = None) -> DataFrame:
    """Cap every variant of a run at its smallest variant's user count.

    Users are kept in the order of a hash of their key. The cut is found from
    per-bucket counts of the hash's first four digits (65,536 buckets), and users
    are ranked inside their bucket only, so no task ever sorts a whole variant.
    With a design given, its bandit runs pass through uncut.
    """
    keyed = exposures.withColumn("_h", user_order_hash(F.col("user_key"))).withColumn(
        "_b", F.substring("_h", 1, 4)
    )
    if design is not None and "method" in design.runs.columns:
        methods = design.runs.select("run_id", F.coalesce("method", F.lit("bayesian_ab")).alias("_method"))
        keyed = keyed.join(methods, "run_id", "left")
    else:
        keyed = keyed.withColumn("_method", F.lit("bayesian_ab"))
    buckets = keyed.groupBy("run_id", "variant", "_b").agg(F.count("*").alias("_in"))
    sizes = buckets.groupBy("run_id", "variant").agg(F.sum("_in").alias("_size"))
    caps = sizes.groupBy("run_id").agg(F.min("_size").alias("_cap"))
    before = Window.partitionBy("run_id", "variant").orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cuts = (
        buckets.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
        .join(caps, "run_id")
        .select("run_id", "variant", "_b", (F.col("_cap") - F.col("_before")).alias("_room"))
    )
    rank = F.row_number().over(Window.partitionBy("run_id", "variant", "_b").orderBy("_h", "user_key"))
    kept = (
        keyed.join(cuts, ["run_id", "variant", "_b"])
        .withColumn("_r", rank)
        .where((F.col("_method") == "bandit") | (F.col("_r") <= F.col("_room")))
    )
    return kept.select(*exposures.columns)


def srm_denominators(evals: DataFrame, design: Design) -> DataFrame:
    """Evaluations against distinct users per (run, variant): the wrong and right sample sizes."""
    per_user = (
        exposures_in_runs(evals, design)
        .groupBy("run_id", "variant", "user_key")
        .agg(F.count("*").alias("evals"))
    )
    return per_user.groupBy("run_id", "variant").agg(
        F.sum("evals").alias("evaluations"),
        F.count("*").alias("users"),
        (F.sum("evals") / F.count("*")).alias("evaluations_per_user"),
    )


def attributed_events(events: DataFrame, exposures: DataFrame, design: Design) -> DataFrame:
    """Events at or after their user's first exposure, inside the run's window, one row per metric.

    Events no run asks for are dropped before the shuffle, as are all columns
    but five. Exposures meet their run's metrics first, so an event is compared
    only with the runs that ask for its name, and the event name spreads a
    user's events over tasks.
    """
    wanted = design.metrics.select("env_id", "event_name")
    found = _scan(events, design).select(
        "env_id", "user_key", "event_name",
        F.col("timestamp").alias("event_ts"),
        F.coalesce("numeric_value", F.lit(0.0)).alias("value"),
    )
    found = found.join(wanted, ["env_id", "event_name"], "left_semi")
    ends = design.runs.select("run_id", "until_ts")  # the exposure bounds the other side
    spec = design.metrics.select("run_id", "event_name", "metric_ord", "metric_agg").join(ends, "run_id")
    return (
        exposures.join(spec, "run_id")
        .join(found, ["env_id", "user_key", "event_name"])
        .where((F.col("event_ts") >= F.col("exposure_ts")) & (F.col("event_ts") < F.col("until_ts")))
        .drop("until_ts")
    )


def contribution(agg: Column, events: Column, total: Column) -> Column:
    """A user's contribution to a metric: 0/1, event count, sum or mean."""
    events = F.coalesce(events, F.lit(0))
    total = F.coalesce(total, F.lit(0.0))
    some = events > 0
    return (
        F.when(~some, F.lit(0.0))
        .when(agg == "once", F.lit(1.0))
        .when(agg == "count", events.cast("double"))
        .when(agg == "sum", total)
        .otherwise(total / F.when(some, events))
    )


def user_totals(
    events: DataFrame, exposures: DataFrame, design: Design, by: Sequence[str] = ()
) -> DataFrame:
    """Count, sum and mean of a user's attributed events per (run, metric).

    Only users with at least one event appear. ``by`` names further exposure
    columns to keep.
    """
    keys = ["run_id", "env_id", "user_key", "variant", *by, "metric_ord", "event_name", "metric_agg"]
    return (
        attributed_events(events, exposures, design)
        .groupBy(*keys)
        .agg(F.count("*").alias("conv_count"), F.sum("value").alias("user_sum"))
        .withColumn("user_avg", F.col("user_sum") / F.col("conv_count"))
    )


def user_contributions(events: DataFrame, exposures: DataFrame, design: Design) -> DataFrame:
    """Every exposed user's contribution to every metric of the run, zeros included."""
    totals = user_totals(events, exposures, design).select(
        "run_id", "env_id", "user_key", "metric_ord", "conv_count", "user_sum"
    )
    spec = design.metrics.select("run_id", "metric_ord", "event_name", "metric_agg")
    return (
        exposures.join(spec, "run_id")
        .join(totals, ["run_id", "env_id", "user_key", "metric_ord"], "left")
        .select(
            "run_id", "user_key", "variant", "metric_ord", "event_name", "metric_agg",
            F.coalesce("conv_count", F.lit(0)).alias("conv_count"),
            contribution(F.col("metric_agg"), F.col("conv_count"), F.col("user_sum")).alias("x"),
        )
    )


def stats_of_sums(users: DataFrame, sums: DataFrame, design: Design, by: Sequence[str] = ()) -> DataFrame:
    """Variant statistics from exposed users per (run, variant) and sums per (run, metric, variant).

    Users without events add zeros to every sum, so a variant without sums has zeros.
    """
    spec = design.metrics.select("run_id", "metric_ord", F.col("event_name").alias("metric"), "role",
                        "metric_type", "metric_agg", "inverse")
    keys = ["run_id", "metric_ord", "variant", *by]
    grid = users.join(spec, "run_id")
    if by:  # a segment may be null
        right = sums.select(*[F.col(c).alias(f"_{c}") for c in keys], "_conversions", "_sum", "_squares")
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        joined = grid.join(right, on, "left")
    else:
        joined = grid.join(sums, keys, "left")
    return joined.select(
        "run_id", "metric_ord", "metric", "role", "metric_type", "metric_agg", "inverse", "variant", *by,
        "users",
        F.coalesce("_conversions", F.lit(0)).alias("conversions"),
        F.coalesce("_sum", F.lit(0.0)).alias("sum_val"),
        F.coalesce("_squares", F.lit(0.0)).alias("sum_sq"),
    )


def variant_stats_from_exposures(
    events: DataFrame, exposures: DataFrame, design: Design, by: Sequence[str] = ()
) -> DataFrame:
    """Users, conversions, sum and sum of squares per (run, metric, variant[, by])."""
    x = contribution(F.col("metric_agg"), F.col("conv_count"), F.col("user_sum"))
    sums = (
        user_totals(events, exposures, design, by)
        .withColumn("x", x)
        .groupBy("run_id", "metric_ord", "variant", *by)
        .agg(
            F.count("*").alias("_conversions"),
            F.sum("x").alias("_sum"),
            F.sum(F.col("x") * F.col("x")).alias("_squares"),
        )
    )
    users = exposures.groupBy("run_id", "variant", *by).agg(F.count("*").alias("users"))
    return stats_of_sums(users, sums, design, by)


#: Up to so many distinct windows are broadcast.
BROADCAST_WINDOWS = 100_000


def _repeated(design: Design) -> DataFrame:
    """Ids of runs that are there more than once, or whose metrics are; their rows count together, whatever their windows."""
    runs = design.runs.groupBy("run_id").count().where("count > 1").select("run_id")
    specs = design.metrics.groupBy("run_id", "metric_ord").count().where("count > 1").select("run_id")
    return runs.unionAll(specs).distinct()


def _day_firsts(evals: DataFrame, design: Design) -> DataFrame:
    """Per user and flag the first exposure of every day, with the instant of the one before it.

    Windows are whole days, so no other evaluation can be the first in one.
    """
    known = _scan(evals, design).where(F.col("user_key").isNotNull() & F.col("timestamp").isNotNull())
    keys = ["env_id", "flag_key", "user_key"]
    rows = known.select(*keys, F.to_date("timestamp").alias("_day"), "variant", F.col("timestamp").alias("ts"))
    earliest = rows.groupBy(*keys, "_day", "variant").agg(F.min("ts").alias("ts"))
    first = earliest.groupBy(*keys, "_day").agg(F.min(F.struct("ts", "variant")).alias("x"))
    before = F.lag("x.ts").over(Window.partitionBy(*keys).orderBy("_day"))
    return first.select(*keys, F.col("x.variant").alias("variant"), F.col("x.ts").alias("exposure_ts"), before.alias("before_ts"))


def _shared_window_stats(evals: DataFrame, events: DataFrame, design: Design) -> DataFrame:
    """``variant_stats`` of a design whose runs share windows: computed by window, then given to the runs.

    A user's first exposure of a day is the first in just those windows that
    hold it and begin after the one before it. So exposures meet windows by a
    comparison, only aggregates of them leave a task, and events meet the days
    of their user, not the user's runs.
    """
    few = F.broadcast if design.shared <= BROADCAST_WINDOWS else (lambda df: df)
    windows = few(design.runs.select(*_WINDOW).distinct())
    is_first = (F.col("from_ts") <= F.col("exposure_ts")) & (F.col("exposure_ts") < F.col("until_ts")) & (
        F.col("before_ts").isNull() | (F.col("before_ts") < F.col("from_ts"))
    )
    days = _day_firsts(evals, design)
    users = days.join(windows, ["env_id", "flag_key"]).where(is_first).groupBy(*_WINDOW, "variant").agg(F.count("*").alias("users"))
    users = users.join(design.runs.select("run_id", *_WINDOW), list(_WINDOW)).select("run_id", "variant", "users")

    kind = F.coalesce("metric_agg", F.lit("average")).alias("_kind")
    asked = design.runs.select("run_id", *_WINDOW).join(design.metrics.select("run_id", "metric_ord", "event_name", kind), "run_id")
    metric = [*_WINDOW, "event_name", "_kind"]
    asks = few(asked.select(*metric).distinct())
    found = _scan(events, design).select(
        "env_id", "user_key", "event_name", F.col("timestamp").alias("event_ts"), F.coalesce("numeric_value", F.lit(0.0)).alias("value")
    )
    found = found.join(design.metrics.select("env_id", "event_name"), ["env_id", "event_name"], "left_semi")
    met = days.join(found, ["env_id", "user_key"]).where(F.col("event_ts") >= F.col("exposure_ts"))
    met = met.join(asks, ["env_id", "flag_key", "event_name"]).where(is_first & (F.col("event_ts") < F.col("until_ts")))
    totals = met.groupBy(*metric, "variant", "user_key").agg(F.count("*").alias("conv_count"), F.sum("value").alias("user_sum"))
    x = contribution(F.col("_kind"), F.col("conv_count"), F.col("user_sum"))
    sums = totals.withColumn("x", x).groupBy(*metric, "variant").agg(
        F.count("*").alias("_conversions"), F.sum("x").alias("_sum"), F.sum(F.col("x") * F.col("x")).alias("_squares")
    )
    sums = sums.join(asked, metric).select("run_id", "metric_ord", "variant", "_conversions", "_sum", "_squares")
    return stats_of_sums(users, sums, design)


def variant_stats(
    evals: DataFrame,
    events: DataFrame,
    design: Design,
    options: DesignFilters = NO_FILTERS,
    balanced: bool = False,
) -> DataFrame:
    """Sufficient statistics of all runs and metrics in one plan."""
    if design.shared and options == NO_FILTERS and not balanced:
        repeated = _repeated(design)
        plain = replace(design, runs=design.runs.join(repeated, "run_id", "left_anti"))
        stats = _shared_window_stats(evals, events, plain)
        if repeated.isEmpty():
            return stats
        rest = replace(design, runs=design.runs.join(repeated, "run_id", "left_semi"), shared=0)
        return stats.unionByName(variant_stats(evals, events, rest))
    exposures = first_exposures(evals, design, options)
    if balanced:
        exposures = balance_exposures(exposures, design)
    return variant_stats_from_exposures(events, exposures, design)


def segment_stats(
    evals: DataFrame, events: DataFrame, design: Design, property_name: str, options: DesignFilters = NO_FILTERS
) -> DataFrame:
    """Variant statistics sliced by a user property of the first exposure.

    ``level`` is ``segment`` for a slice and ``total`` for the variant's total.
    """
    segment = F.get_json_object("user_properties", "$." + property_name)
    exposures = first_exposures(evals, design, options, carry={"segment": segment})
    sliced = variant_stats_from_exposures(events, exposures, design, by=["segment"])
    keys = ["run_id", "metric_ord", "metric", "role", "metric_type", "metric_agg", "inverse", "variant"]
    sums = [F.sum(c).alias(c) for c in ("users", "conversions", "sum_val", "sum_sq")]
    # The slice's own null segment is told apart from the subtotal by grouping().
    return (
        sliced.groupingSets([[*keys, "segment"], keys], *keys, "segment")
        .agg(F.grouping("segment").alias("_g"), *sums)
        .withColumn("level", F.when(F.col("_g") == 0, F.lit("segment")).otherwise(F.lit("total")))
        .drop("_g")
    )


def with_rates(stats: DataFrame) -> DataFrame:
    """Add the conversion rate per user and the mean value per converting user."""
    return stats.withColumn(
        "conversion_rate", F.when(F.col("users") > 0, F.col("conversions") / F.col("users")).otherwise(F.lit(0.0))
    ).withColumn(
        "avg_value", F.when(F.col("conversions") > 0, F.col("sum_val") / F.col("conversions")).otherwise(F.lit(0.0))
    )


def to_stats(variant: DataFrame) -> DataFrame:
    """Shape by metric type: (n, k) for binary, (n, sum, sum_squares) for continuous."""
    binary = F.col("metric_type") == "binary"
    empty = F.lit(None).cast("double")
    return variant.select(
        "run_id", "metric_ord", "metric", "role", "metric_type", "metric_agg", "inverse", "variant",
        F.col("users").cast("double").alias("n"),
        F.when(binary, F.col("conversions").cast("double")).alias("k"),
        F.when(~binary, F.col("sum_val")).alias("sum"),
        F.when(~binary, F.col("sum_sq")).alias("sum_squares"),
        empty.alias("mean"),
        empty.alias("variance"),
    )


def query_experiment(
    evals: DataFrame,
    events: DataFrame,
    *,
    env_id: str,
    flag_key: str,
    metric_event: str,
    start: str | dt.date,
    end: str | dt.date,
    metric_type: str,
    metric_agg: str,
    requested_env: str | None = None,
) -> DataFrame:
    """Statistics of one metric for one flag and window, ordered by variant."""
    first, last = fl.validate_query(
        flag_key=flag_key, metric_event=metric_event, start=start, end=end,
        metric_type=metric_type, metric_agg=metric_agg,
    )
    evals = fl.scan_flag(fl.scan_environment(fl.scan_window(evals, first, last), env_id, requested_env), flag_key)
    events = fl.scan_event(fl.scan_environment(fl.scan_window(events, first, last), env_id), metric_event)
    one = evals.sparkSession.range(1)
    runs = one.select(
        F.lit("query").alias("run_id"), F.lit(env_id).alias("env_id"), F.lit(flag_key).alias("flag_key"),
        F.lit(first).alias("start_date"), F.lit(last).alias("end_date"),
    )
    specs = one.select(
        F.lit("query").alias("run_id"), F.lit(env_id).alias("env_id"), F.lit(0).alias("metric_ord"),
        F.lit("primary").alias("role"), F.lit(metric_event).alias("event_name"),
        F.lit(metric_type).alias("metric_type"), F.lit(metric_agg).alias("metric_agg"),
        F.lit(False).alias("inverse"),
    )
    stats = with_rates(variant_stats(evals, events, load_design(runs, specs)))
    return stats.select(
        "variant", "users", "conversions", "sum_val", "sum_sq", "conversion_rate", "avg_value"
    ).orderBy("variant")


