"""Reports on the experiment design tables: conflicts, window overlaps, traffic pools, timelines.

Counting reports cover all experiments at once and never form pairs: they add
up group sizes. Pairs are only listed for the experiments somebody asks about.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftwise.operators.normalize import metric_title
from liftwise.schemas import ACTIVE_STATUSES

OPEN_END = "2099-12-31"

# Signal, then the words that give it away in free text.
AUDIENCE_SIGNALS = {
    "new_users": ("new user", "accounts created", "< 30 day"),
    "all_users": ("all user",),
    "pricing_users": ("pricing", "plan"),
    "free_tier": ("free tier", "free plan"),
    "enterprise": ("enterprise",),
}


def audience_signals(text: Column) -> Column:
    """Audience signals named in a free text, in their fixed order."""
    lower = F.lower(text)

    def found(words: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [lower.contains(w) for w in words])

    return F.array_compact(F.array(*[F.when(found(words), F.lit(name)) for name, words in AUDIENCE_SIGNALS.items()]))


def signal_mask(text: Column) -> Column:
    """Signals as a bit mask below 32; 0 without text or signals."""
    lower = F.lower(text)

    def bit(i: int, words: Sequence[str]) -> Column:
        hit = reduce(lambda a, b: a | b, [lower.contains(w) for w in words])
        return F.when(hit, F.lit(1 << i)).otherwise(F.lit(0))

    return reduce(lambda a, b: a + b, [bit(i, w) for i, w in enumerate(AUDIENCE_SIGNALS.values())])


def _experiment_keys(experiments: DataFrame) -> DataFrame:
    blank = F.lit("")
    return experiments.select(
        "experiment_id", "stage",
        F.when(F.coalesce("flag_key", blank) != "", F.col("flag_key")).alias("flag"),
        metric_title(F.col("primary_metric")).alias("metric"),
        signal_mask(F.coalesce("constraints", blank)).alias("mask"),
    )


def severity(flag: Column, metric: Column) -> Column:
    return F.when(flag & metric, F.lit("high")).when(flag | metric, F.lit("medium")).otherwise(F.lit("low"))


def conflict_counts(experiments: DataFrame) -> DataFrame:
    """How many other active experiments each experiment conflicts with, by severity.

    Others are those not in the learning stage. Shared flags and metrics are
    group sizes; audience overlaps are group sizes per signal mask, of which
    there are at most 31. Low counts overlap in audience alone, by inclusion and
    exclusion: overlapping - same flag - same metric + same flag and metric.
    """
    keyed = _experiment_keys(experiments)
    others = keyed.where(F.col("stage") != "learning")
    base = keyed.withColumn("self", (F.col("stage") != "learning").cast("int"))

    def sizes(keys: list[str], name: str) -> DataFrame:
        return others.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias(name))

    def near(keys: list[str], name: str) -> DataFrame:
        """Others per key with a mask overlapping each possible mask."""
        by_mask = others.where(F.col("mask") > 0).dropna(subset=keys).groupBy(*keys, "mask").agg(F.count("*").alias("_c"))
        probes = F.filter(
            F.sequence(F.lit(1), F.lit(31)), lambda p: p.bitwiseAND(F.col("mask").cast("int")) != 0
        )
        return by_mask.select(*keys, "_c", F.explode(probes).alias("mask")).groupBy(*keys, "mask").agg(F.sum("_c").alias(name))

    joined = base
    for keys, name in ((["flag"], "n_flag"), (["metric"], "n_metric"), (["flag", "metric"], "n_both")):
        joined = joined.join(sizes(keys, name), keys, "left")
    for keys, name in (
        ([], "a_all"), (["flag"], "a_flag"), (["metric"], "a_metric"), (["flag", "metric"], "a_both"),
    ):
        joined = joined.join(near(keys, name), [*keys, "mask"], "left")

    def n(name: str, minus: Column) -> Column:
        return F.greatest(F.coalesce(F.col(name), F.lit(0)) - minus, F.lit(0))

    own = F.col("self")
    own_flag = own * F.col("flag").isNotNull().cast("int")
    own_metric = own * F.col("metric").isNotNull().cast("int")
    own_mask = own * (F.col("mask") > 0).cast("int")
    counted = joined.select(
        "experiment_id",
        n("n_both", own_flag * own_metric).alias("high"),
        n("n_flag", own_flag).alias("same_flag"),
        n("n_metric", own_metric).alias("same_metric"),
        n("a_all", own_mask).alias("same_audience"),
        (n("a_all", own_mask) - n("a_flag", own_mask * own_flag) - n("a_metric", own_mask * own_metric)
         + n("a_both", own_mask * own_flag * own_metric)).alias("low"),
    )
    medium = F.col("same_flag") + F.col("same_metric") - F.col("high") * 2
    return counted.select(
        "experiment_id", "same_flag", "same_metric", "same_audience", "high", medium.alias("medium"), "low",
        ((F.col("high") + medium + F.col("low")) > 0).alias("has_conflicts"),
    )


def conflicts_of(experiments: DataFrame, focus: DataFrame) -> DataFrame:
    """Conflicting experiments of each asked-for experiment, with dimensions, details and severity.

    ``focus`` holds the experiment_id of the request; it meets the others
    through three equi-joins, on flag, metric and audience signal.
    """
    columns = ["experiment_id", "stage", F.col("flag_key").alias("flag"), metric_title(F.col("primary_metric")).alias("metric"),
               audience_signals(F.col("constraints")).alias("signals")]
    everyone = experiments.select(*columns)
    asked = focus.select("experiment_id").distinct()
    mine = everyone.join(asked, "experiment_id", "left_semi").select(
        F.col("experiment_id").alias("focus_id"), "flag", "metric", "signals"
    )
    others = everyone.where(F.col("stage") != "learning")

    def pairs(left: DataFrame, right: DataFrame, key: str, dimension: str) -> DataFrame:
        return left.where(F.col(key) != "").join(right.where(F.col(key) != ""), key).where(
            F.col("focus_id") != F.col("experiment_id")
        ).select("focus_id", "experiment_id", "stage", F.lit(dimension).alias("dimension"), F.col(key).alias("shared"))

    def signals(df: DataFrame) -> DataFrame:
        return df.withColumn("signal", F.explode("signals"))

    found = reduce(DataFrame.unionByName, [
        pairs(mine.select("focus_id", "flag"), others.select("experiment_id", "stage", "flag"), "flag", "flag_key"),
        pairs(mine.select("focus_id", "metric"), others.select("experiment_id", "stage", "metric"), "metric", "metric"),
        pairs(signals(mine).select("focus_id", "signal"), signals(others).select("experiment_id", "stage", "signal"), "signal", "audience"),
    ])
    order = {name: i for i, name in enumerate(AUDIENCE_SIGNALS)}
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("shared")], F.lit(0))
    folded = found.groupBy("focus_id", "experiment_id", "stage").agg(
        F.max(F.when(F.col("dimension") == "flag_key", F.col("shared"))).alias("flag"),
        F.max(F.when(F.col("dimension") == "metric", F.col("shared"))).alias("metric"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("dimension") == "audience", F.struct(rank.alias("r"), "shared")))),
            lambda s: s["shared"],
        ).alias("signals"),
    )
    flag, metric, audience = F.col("flag").isNotNull(), F.col("metric").isNotNull(), F.size("signals") > 0
    return folded.select(
        "focus_id", "experiment_id", "stage",
        F.array_compact(F.array(
            F.when(flag, F.lit("flag_key")), F.when(metric, F.lit("metric")), F.when(audience, F.lit("audience"))
        )).alias("dimensions"),
        F.array_compact(F.array(
            F.when(flag, F.concat(
                F.lit('Flag "'), "flag", F.lit('" is shared: each experiment changes who the other one reaches.'))),
            F.when(metric, F.concat(
                F.lit('Primary metric "'), "metric", F.lit('" is shared: an effect can belong to either experiment.'))),
            F.when(audience, F.concat(
                F.lit("Audiences meet in "), F.concat_ws(", ", "signals"), F.lit(": users can be in both experiments."))),
        )).alias("details"),
        severity(flag, metric).alias("severity"),
    )


def shared_signals(left: Column, right: Column) -> Column:
    """Audience signals two texts have in common."""
    return F.array_intersect(audience_signals(left), audience_signals(right))


def _windows(runs: DataFrame) -> DataFrame:
    start = F.col("observation_start").cast("timestamp")
    end = F.coalesce(F.col("observation_end").cast("timestamp"), F.lit(OPEN_END).cast("timestamp"))
    return runs.where(start.isNotNull() & (F.trim("flag_key") != "")).select(
        "run_id", "experiment_id", "flag_key", "status", start.alias("from_ts"), end.alias("to_ts")
    )


def _upto_counts(points: DataFrame, probes: DataFrame, keys: list[str], at: str, strict: bool, name: str) -> DataFrame:
    """For each probe, the number of points of its key group at or before (or strictly before) its instant.

    Both sides are first counted per distinct instant; running sums go over days,
    and over the instants of one day, so no task has to sort a whole group.
    """
    counted = points.groupBy(*keys, F.col(at).alias("_at")).agg(F.count("*").alias("_c")).withColumn("_probe", F.lit(0))
    asked = probes.select(*keys, F.col("_at")).distinct().withColumn("_c", F.lit(0).cast("bigint")).withColumn("_probe", F.lit(1))
    both = counted.unionByName(asked).withColumn("_day", F.to_date("_at"))
    days = both.groupBy(*keys, "_day").agg(F.sum("_c").alias("_in_day"))
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(*keys, "_day", F.coalesce(F.sum("_in_day").over(earlier), F.lit(0)).alias("_before"))
    # Within an instant a strict probe is placed ahead of the points, another one behind them.
    place = F.when(F.col("_probe") == 1, F.lit(0 if strict else 2)).otherwise(F.lit(1))
    within = Window.partitionBy(*keys, "_day").orderBy("_at", place).rowsBetween(Window.unboundedPreceding, 0)
    summed = both.withColumn("_within", F.sum("_c").over(within)).where(F.col("_probe") == 1)
    return summed.join(before, [*keys, "_day"]).select(*keys, F.col("_at"), (F.col("_before") + F.col("_within")).alias(name))


def _active(windows: DataFrame, experiments: DataFrame | None) -> DataFrame:
    """Windows of runs that are not over; experiments in ``learning`` are."""
    active = windows.where(F.col("status").isin(*ACTIVE_STATUSES))
    if experiments is None:
        return active
    over = experiments.where(F.col("stage") == "learning").select("experiment_id").distinct()
    return active.join(over, "experiment_id", "left_anti")


def overlap_counts(runs: DataFrame, experiments: DataFrame | None = None) -> DataFrame:
    """Per undecided run, how many active runs of other experiments on its flag overlap its window.

    Runs without a flag overlap with nothing and are left out; with
    ``experiments`` (experiment_id, stage), runs of learning ones don't count.

    Overlapping = started by my end, minus ended before my start. The run's own
    experiment is counted the same way and taken off. No pairs are formed.
    """
    windows = _windows(runs)
    mine = windows.where(F.col("status") != "decided")
    theirs = _active(windows, experiments)

    def overlaps(keys: list[str], name: str) -> DataFrame:
        started = _upto_counts(theirs, mine.withColumn("_at", F.col("to_ts")), keys, "from_ts", False, "_started")
        ended = _upto_counts(theirs, mine.withColumn("_at", F.col("from_ts")), keys, "to_ts", True, "_ended")
        return (
            mine.join(started.withColumnRenamed("_at", "to_ts"), [*keys, "to_ts"])
            .join(ended.withColumnRenamed("_at", "from_ts"), [*keys, "from_ts"])
            .select("run_id", (F.col("_started") - F.col("_ended")).alias(name))
        )

    return (
        overlaps(["flag_key"], "_all")
        .join(overlaps(["flag_key", "experiment_id"], "_own"), "run_id")
        .select("run_id", (F.col("_all") - F.col("_own")).alias("overlapping_runs"))
    )


#: Days are counted from here; dyadic spans of days have up to 2 to the power of ``_LEVELS`` days.
_DAY_ZERO = dt.date(1900, 1, 1)
_LEVELS = 17


def _day_number(ts: Column) -> Column:
    days = F.datediff(F.to_date(ts), F.lit(_DAY_ZERO))
    return F.greatest(F.least(days, F.lit(2**_LEVELS - 1)), F.lit(0))


def _spans_over(day: Column) -> Column:
    """The dyadic spans that hold a day, one per level."""
    return F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", day, k).alias("span")))


def _spans_of(first: Column, last: Column) -> Column:
    """The fewest dyadic spans that make up the days from ``first`` to ``last``, at most two per level and none twice."""

    def at(k: Column) -> Column:
        low = F.call_function("shiftright", first + F.call_function("shiftleft", F.lit(1), k) - 1, k)
        high = F.call_function("shiftright", last + 1, k)
        some = low < high
        return F.array(F.when(some & (low % 2 == 1), F.struct(k.alias("level"), low.alias("span"))), F.when(some & (high % 2 == 1), F.struct(k.alias("level"), (high - 1).alias("span"))))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), at)))


def _starts_within(points: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Pairs of a point's row (key, _at) and a window's (key, _from, _to) whose days hold it.

    A day is in exactly one of the dyadic spans that make up a window, so every
    pair is made once, and rows that share no day never meet. A window is
    joined under some 2 log(days) spans, a point under one span a level.

    Both sides are shuffled: Spark's size estimates come from the files and
    don't see that spans multiply rows, so it would broadcast a whole table of them.
    """
    held = points.withColumn("_s", F.explode(_spans_over(_day_number(F.col("_at"))))).select("*", "_s.level", "_s.span").drop("_s")
    open_ = windows.withColumn("_s", F.explode(_spans_of(_day_number(F.col("_from")), _day_number(F.col("_to"))))).select("*", "_s.level", "_s.span").drop("_s")
    return held.hint("merge").join(open_, [key, "level", "span"]).drop("level", "span")


def overlaps_of(runs: DataFrame, focus: DataFrame, experiments: DataFrame | None = None) -> DataFrame:
    """Overlapping windows of the asked-for experiments' runs, run by run.

    Two windows overlap when one starts within the other: theirs within mine, or
    mine within theirs after its start. Both are joins of starts with windows
    over dyadic spans of days, so work follows the pairs that are returned, not
    the runs that share a flag; runs of flags that nobody asked for leave first.
    ``overlap_counts`` serves all without pairs.
    """
    windows = _windows(runs)
    asked = focus.select("experiment_id").distinct()
    mine = windows.where(F.col("status") != "decided").join(asked, "experiment_id", "left_semi").select(
        F.col("run_id").alias("focus_run"), F.col("experiment_id").alias("focus_id"), "flag_key",
        F.col("from_ts").alias("_a"), F.col("to_ts").alias("_b"),
    )
    theirs = _active(windows, experiments).select("run_id", "experiment_id", "flag_key", "from_ts", "to_ts")
    theirs = theirs.join(mine.select("flag_key").distinct(), "flag_key", "left_semi")
    inside = _starts_within(theirs.withColumn("_at", F.col("from_ts")), mine.withColumns({"_from": F.col("_a"), "_to": F.col("_b")}), "flag_key")
    inside = inside.where(F.col("from_ts") >= F.col("_a"))
    around = _starts_within(mine.withColumn("_at", F.col("_a")), theirs.withColumns({"_from": F.col("from_ts"), "_to": F.col("to_ts")}), "flag_key")
    around = around.where(F.col("from_ts") < F.col("_a"))
    columns = ["focus_run", "focus_id", "run_id", "experiment_id", "flag_key", "_a", "_b", "from_ts", "to_ts"]
    day = "yyyy-MM-dd"
    return inside.select(*columns).unionAll(around.select(*columns)).where(
        (F.col("experiment_id") != F.col("focus_id")) & (F.col("_a") <= F.col("to_ts")) & (F.col("from_ts") <= F.col("_b"))
    ).select(
        "focus_run", "run_id", "flag_key",
        F.concat(
            F.lit('Run "'), "focus_run", F.lit('" of '), F.date_format("_a", day), F.lit(" to "), F.date_format("_b", day),
            F.lit(' runs beside "'), "run_id", F.lit('" of '), F.date_format("from_ts", day), F.lit(" to "), F.date_format("to_ts", day),
        ).alias("detail"),
    )


# Buckets hash user and flag, so slices meet only within a flag, and a layer filters its rows.
_POOL = ("env_id", "flag_key", "layer")


def _slices(runs: DataFrame) -> DataFrame:
    start = F.coalesce(F.col("traffic_offset").cast("int"), F.lit(0))
    percent = F.coalesce(F.col("traffic_percent").cast("double"), F.lit(100.0))
    return runs.select(
        "run_id", *_POOL[:2], F.coalesce("layer_id", F.lit("default")).alias("layer"), start.alias("start"),
        F.least(start + percent, F.lit(100.0)).alias("end"),
    )


def traffic_allocation(runs: DataFrame) -> DataFrame:
    """Segments of the 0-100 bucket range of each (environment, flag, layer): run slices and the gaps between them.

    Slices go by offset, then run id, and a gap opens where a slice starts after
    the previous one ended. Slices of one offset cannot leave a gap between them,
    so gaps follow from one row per pool and offset, at most 100 per pool.
    """
    slices = _slices(runs)
    steps = slices.groupBy(*_POOL, "start").agg(F.max_by("end", "run_id").alias("end"))
    by_offset = Window.partitionBy(*_POOL).orderBy("start")
    gaps = steps.select(
        *_POOL, F.coalesce(F.lag("end").over(by_offset), F.lit(0.0)).alias("gap_start"), F.col("start").cast("double").alias("gap_end")
    ).where(F.col("gap_end") > F.col("gap_start"))
    tail = steps.groupBy(*_POOL).agg(F.max_by("end", "start").alias("gap_start")).where(F.col("gap_start") < 100)
    free = gaps.unionByName(tail.withColumn("gap_end", F.lit(100.0)))
    return slices.select(
        *_POOL, F.lit("run").alias("kind"), "run_id", F.col("start").cast("double").alias("start"), "end"
    ).unionByName(
        free.select(*_POOL, F.lit("gap").alias("kind"), F.lit(None).cast("string").alias("run_id"),
                    F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))
    )


def traffic_conflicts(runs: DataFrame) -> DataFrame:
    """Slices that start before an earlier slice of their pool ends, or reach past 100.

    The furthest end of all earlier offsets comes from one row per pool and
    offset; among slices of one offset every one after the first overlaps.
    """
    slices = _slices(runs)
    steps = slices.groupBy(*_POOL, "start").agg(
        F.max("end").alias("_far"), F.min("run_id").alias("_first"),
    )
    earlier = Window.partitionBy(*_POOL).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reach = steps.select(*_POOL, "start", "_first", F.max("_far").over(earlier).alias("_reach"))
    past = runs.select(
        "run_id",
        (F.coalesce(F.col("traffic_offset").cast("int"), F.lit(0)) + F.coalesce(F.col("traffic_percent").cast("double"), F.lit(100.0)) > 100)
        .alias("past_end"),
    )
    overlap = (F.col("start") < F.coalesce(F.col("_reach"), F.lit(0.0))) | (
        (F.col("run_id") != F.col("_first")) & (F.col("end") > F.col("start"))
    )
    return (
        slices.join(reach, [*_POOL, "start"]).join(past, "run_id")
        .select(*_POOL, "run_id", "start", "end", overlap.alias("overlaps"), "past_end")
        .where(F.col("overlaps") | F.col("past_end"))
    )


def observation_timeline(runs: DataFrame, as_of: str, group: str = "experiment_id") -> DataFrame:
    """Place of each run's window on its group's time axis, in percent, and its phase number.

    Bounds are aggregates joined back; phases count the windows that started
    earlier through running sums, so a large group is never sorted in one task.
    """
    start = F.unix_millis(F.col("observation_start").cast("timestamp"))
    end = F.unix_millis(F.coalesce(F.col("observation_end").cast("timestamp"), F.lit(as_of).cast("timestamp")))
    dated = runs.where(F.col("observation_start").isNotNull()).select(
        "run_id", group, start.alias("_s"), end.alias("_e"), F.col("observation_end").isNull().alias("ongoing"),
        F.to_date(F.col("observation_start").cast("timestamp")).alias("_day"),
    )
    bounds = dated.groupBy(group).agg(F.min("_s").alias("_lo"), F.max("_e").alias("_hi"))
    days = dated.groupBy(group, "_day").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(group, "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_day").orderBy("_s", "run_id"))
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))
    return (
        dated.withColumn("_in", inside).join(before, [group, "_day"]).join(bounds, group)
        .select(
            "run_id", group,
            ((F.col("_s") - F.col("_lo")) / span * 100).alias("left_pct"),
            ((F.col("_e") - F.col("_s")) / span * 100).alias("width_pct"),
            "ongoing", (F.col("_before") + F.col("_in")).alias("phase"),
        )
    )
