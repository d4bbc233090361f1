"""Readings and decisions on top of the comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftwise.schemas import CUSTOMER_MODES, METHODS

HIGH_RISK = 0.02
LOW_RISK = 0.01
DEFAULT_MINIMUM = 1000


def data_status(stats: DataFrame, runs: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Whether a run has data to analyse, and by which job: (run_id, status, analysis, reason, note).

    A run in ``failures`` (run_id, error) that takes its data from a customer's
    source is a ``customer_source_failed`` with that reason, whatever is stored on
    it. ``frequentist`` is an allowed method that is analysed like ``bayesian_ab``.
    """
    none = F.lit(None).cast("string")
    if failures is None or "data_source_mode" not in runs.columns:
        failed = runs.select("run_id", none.alias("_error")).limit(0)
    else:
        theirs = runs.where(F.col("data_source_mode").isin(*CUSTOMER_MODES)).select("run_id")
        reason = F.concat(F.lit("Customer endpoint fetch failed: "), F.coalesce(F.min("error"), F.lit("unknown error")))
        failed = failures.join(theirs, "run_id", "left_semi").groupBy("run_id").agg(reason.alias("_error"))
    primary = stats.where(F.col("role") == "primary").groupBy("run_id").agg(
        F.count("*").alias("_rows"), F.sum(F.coalesce("n", F.lit(0.0))).alias("_users")
    )
    status = (
        F.when(F.col("_error").isNotNull(), F.lit("customer_source_failed"))
        .when(F.coalesce("_rows", F.lit(0)) == 0, F.lit("no_primary_metric_rows"))
        .when(F.col("_users") == 0, F.lit("zero_users"))
        .otherwise(F.lit("ok"))
    )
    method = F.coalesce("method", F.lit(METHODS[0]))
    return runs.select("run_id", "method").join(primary, "run_id", "left").join(failed, "run_id", "left").select(
        "run_id", status.alias("status"),
        F.when(method == "bandit", F.lit("bandit")).otherwise(F.lit("bayesian")).alias("analysis"), F.col("_error").alias("reason"),
        F.when(method == "frequentist", F.lit("frequentist runs are analysed as bayesian_ab")).alias("note"),
    )


def input_violations(stats: DataFrame, runs: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """Rows with implausible numbers or unknown variants, and absent cells where given."""
    arms = runs.select(
        "run_id", F.explode(F.concat(F.array("control"), F.col("treatments"))).alias("variant")
    ).withColumn("_known", F.lit(True))
    n = F.coalesce(F.col("n"), F.lit(0.0))
    checked = stats.join(arms, ["run_id", "variant"], "left").withColumn("violations", F.array_compact(F.array(
        F.when(n <= 0, F.lit("n must be positive")),
        F.when(F.col("k") > n, F.lit("k exceeds n")),
        F.when(F.col("_known").isNull(), F.lit("unknown variant")),
    )))
    bad = checked.where(F.size("violations") > 0).select("run_id", "metric", "variant", "violations")
    if incomplete is not None:
        bad = bad.unionByName(
            incomplete.select("run_id", "metric", "variant", F.array(F.lit("missing")).alias("violations"))
        )
    return bad


def conversion_floor(stats: DataFrame, floor: int = 30) -> DataFrame:
    """Success counts per variant with a warning where they are too few for a normal curve."""
    few = F.col("k") < floor
    return stats.where(F.col("k").isNotNull()).select(
        "run_id", "metric", "variant", "k", few.alias("below_floor"),
        F.when(few, F.concat(F.lit("only "), F.col("k").cast("bigint").cast("string"), F.lit(f" conversions, at least {floor} needed")))
        .alias("warning"),
    )


def minimum_sample(stats: DataFrame, runs: DataFrame, floor: int = 30) -> DataFrame:
    """Users needed per variant: ``floor`` successes at the control's rate, 1000 when the rate is unknown."""
    control = stats.where(F.col("role") == "primary").join(
        runs.select("run_id", F.col("control").alias("variant")), ["run_id", "variant"]
    )
    needed = F.when(F.col("k") > 0, F.ceil(F.lit(float(floor)) * F.col("n") / F.when(F.col("k") > 0, F.col("k"))))
    return runs.select("run_id").join(
        control.select("run_id", needed.alias("_needed"), (F.col("k") / F.when(F.col("n") > 0, F.col("n"))).alias("baseline_rate")),
        "run_id", "left",
    ).select("run_id", "baseline_rate", F.coalesce("_needed", F.lit(DEFAULT_MINIMUM)).cast("bigint").alias("minimum_sample"))


def arm_threshold(arms: Column) -> Column:
    """P(win) a treatment needs when ``arms`` are compared: 1 - 0.05 / arms."""
    return F.lit(1.0) - F.lit(0.05) / arms


def family_error(tests: Column) -> Column:
    """Chance of at least one false alarm in ``tests`` tests at 95%."""
    return F.lit(1.0) - F.pow(F.lit(0.95), tests)


def thresholds(runs: DataFrame) -> DataFrame:
    """Number of arms, the threshold it calls for, and the family-wise error without it."""
    arms = F.size("treatments") + 1
    return runs.select(
        "run_id", arms.alias("arms"), arm_threshold(arms).alias("p_win_threshold"), family_error(arms).alias("family_error")
    )


def risk_band(risk: Column) -> Column:
    return (
        F.when(risk < 0.001, F.lit("negligible")).when(risk <= 0.01, F.lit("acceptable")).when(risk > 0.01, F.lit("meaningful"))
    )


def guardrail_band(win: Column) -> Column:
    return (
        F.when(win <= 0.05, F.lit("strong harm signal"))
        .when(win <= 0.2, F.lit("possible harm"))
        .when(win < 0.8, F.lit("no detectable effect"))
        .when(win >= 0.8, F.lit("likely lift"))
    )


def reading_bands(comparisons: DataFrame) -> DataFrame:
    """Reading of each comparison: the risk of adopting, and for guardrails the harm band."""
    guard = F.col("role") == "guardrail"
    return comparisons.where(F.col("error").isNull()).select(
        "run_id", "metric", "role", "variant", "chance_to_win", "risk_trt",
        risk_band(F.col("risk_trt")).alias("risk_band"),
        F.when(guard, guardrail_band(F.col("chance_to_win"))).alias("guardrail_band"),
    )


def suspicious_directions(comparisons: DataFrame, jump: float = 0.5) -> DataFrame:
    """Guardrails called healthy despite a move of ``jump`` or more: probably declared the wrong way round."""
    healthy = (F.lit(1.0) - F.col("chance_to_win")) < 0.1
    return comparisons.where(
        (F.col("role") == "guardrail") & F.col("error").isNull() & healthy & (F.abs("relative_change") >= jump)
    ).select(
        "run_id", "metric", "variant", "relative_change", "inverse",
        F.lit("large move on a healthy guardrail: check whether lower or higher is better").alias("warning"),
    )


def decisions(comparisons: DataFrame, health: DataFrame) -> DataFrame:
    """Decision category per (run, treatment), with the sufficiency gate beside it.

    Guardrails of the same treatment count through their lowest P(win). The gate
    fails on a broken split, a sample under its minimum, or both risks still
    high; the category then follows the guide all the same.
    """
    win = F.col("chance_to_win")
    primary = F.col("role") == "primary"
    folded = comparisons.groupBy("run_id", "arm_idx", "variant").agg(
        F.max(F.when(primary, win)).alias("p_win"),
        F.max(F.when(primary, F.col("risk_ctrl"))).alias("risk_ctrl"),
        F.max(F.when(primary, F.col("risk_trt"))).alias("risk_trt"),
        F.min(F.when(F.col("role") == "guardrail", win)).alias("guardrail_p"),
    ).join(health.select("run_id", "srm_ok", "sample_ok"), "run_id")
    p = F.col("p_win")
    guard = F.coalesce("guardrail_p", F.lit(1.0))
    wide = F.coalesce((F.col("risk_ctrl") > HIGH_RISK) & (F.col("risk_trt") > HIGH_RISK), F.lit(False))
    category = (
        F.when(~F.col("srm_ok"), F.lit("PAUSE"))
        .when(~F.col("sample_ok") | wide, F.lit("INCONCLUSIVE"))
        .when((guard <= 0.05) | (p <= 0.05), F.lit("ROLLBACK"))
        .when(guard <= 0.2, F.lit("PAUSE"))
        .when((p >= 0.95) & (F.col("risk_trt") < LOW_RISK), F.lit("CONTINUE"))
        .when(p >= 0.8, F.lit("PAUSE"))
        .otherwise(F.lit("INCONCLUSIVE"))
    )
    reason = (
        F.when(~F.col("srm_ok"), F.lit("sample ratio mismatch"))
        .when(~F.col("sample_ok"), F.lit("sample below minimum"))
        .when(wide, F.lit("both risks still high"))
        .when(guard <= 0.05, F.lit("guardrail harm"))
        .when(p <= 0.05, F.lit("primary harm"))
        .when(guard <= 0.2, F.lit("possible guardrail harm"))
        .when((p >= 0.95) & (F.col("risk_trt") < LOW_RISK), F.lit("strong signal at low risk"))
        .when(p >= 0.95, F.lit("strong signal but risk not low"))
        .when(p >= 0.8, F.lit("leaning treatment"))
        .when(p < 0.2, F.lit("lean_control"))
        .when(p.isNull(), F.lit("primary metric not comparable"))
        .otherwise(F.lit("no direction"))
    )
    return folded.select(
        "run_id", "arm_idx", "variant", "p_win", "risk_ctrl", "risk_trt", "guardrail_p",
        (F.col("srm_ok") & F.col("sample_ok") & ~wide).alias("gate_passed"),
        category.alias("category"), reason.alias("reason"),
    )


def priors_from_history(history: DataFrame, keys: list[str]) -> DataFrame:
    """Prior mean and deviation per key from past results (rel_delta, ci_lower, ci_upper).

    One past run gives its own effect and interval width / (2 * 1.96); several
    give the mean and sample deviation of their effects.
    """
    width = (F.col("ci_upper") - F.col("ci_lower")) / F.lit(2 * 1.96)
    return history.where(F.col("rel_delta").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("past_runs"), F.avg("rel_delta").alias("prior_mean"),
        F.stddev_samp("rel_delta").alias("_s"), F.max(width).alias("_w"),
    ).select(*keys, "past_runs", "prior_mean", F.when(F.col("past_runs") > 1, F.col("_s")).otherwise(F.col("_w")).alias("prior_stddev"))


def windows_overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Whether a pilot's and a main run's windows share a day, which would count its data twice."""
    return (start_a <= end_b) & (start_b <= end_a)


def priors_before(history: DataFrame, mains: DataFrame, keys: list[str]) -> DataFrame:
    """For each main run, the prior its keys' earlier runs give: those whose window ended before its own began.

    ``history`` has keys, start_date, end_date, rel_delta, ci_lower, ci_upper;
    ``mains`` has run_id, keys, start_date. A past run whose window shares a day
    with the main run's, or follows it, would count its data twice and is left
    out. Running sums by end date serve all main runs of a key; no pairs are
    formed. Sums are taken about the key's mean effect.
    """
    width = (F.col("ci_upper") - F.col("ci_lower")) / F.lit(2 * 1.96)
    past = history.where(F.col("rel_delta").isNotNull() & F.col("end_date").isNotNull())
    centres = past.groupBy(*keys).agg(F.avg("rel_delta").alias("_c"))
    points = past.join(centres, keys).select(*keys, F.col("end_date").alias("_at"), F.lit(0).alias("_main"), F.lit(None).cast("string").alias("run_id"),
                                             (F.col("rel_delta") - F.col("_c")).alias("_x"), width.alias("_w"), "_c")
    none = F.lit(None).cast("double")
    asked = mains.join(centres, keys).select(*keys, F.col("start_date").alias("_at"), F.lit(1).alias("_main"), "run_id", none.alias("_x"), none.alias("_w"), "_c")
    # A window that ends on the day the main run starts shares that day, so the asking row comes first.
    earlier = Window.partitionBy(*keys).orderBy("_at", F.desc("_main")).rowsBetween(Window.unboundedPreceding, -1)
    n, total, squares = F.count("_x").over(earlier), F.sum("_x").over(earlier), F.sum(F.col("_x") * F.col("_x")).over(earlier)
    held = points.unionAll(asked).withColumns({"past_runs": n, "_s": total, "_q": squares, "_w": F.max("_w").over(earlier)})
    mean = F.col("_s") / F.col("past_runs")
    spread = F.sqrt(F.greatest((F.col("_q") - F.col("_s") * mean) / F.greatest(F.col("past_runs") - 1, F.lit(1)), F.lit(0.0)))
    return held.where((F.col("_main") == 1) & (F.col("past_runs") > 0)).select(
        "run_id", *keys, "past_runs", (F.col("_c") + mean).alias("prior_mean"), F.when(F.col("past_runs") > 1, spread).otherwise(F.col("_w")).alias("prior_stddev")
    )
