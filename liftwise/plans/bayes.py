"""Bayesian comparison of every treatment with its control, for all runs at once.

``compare`` turns the long statistics into one wide table, one row per
(run, metric, variant); everything else is an aggregate of that table, so the
statistics are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftwise.functions.distributions import chi2_sf, normal_pdf, normal_sf, z_95
from liftwise.functions.moments import effect_se, expected_losses, moments
from liftwise.functions.rounding import number_text, round_half_up

ERROR_NO_USERS = "zero sample size"
ERROR_ZERO_MEAN = "control mean is zero — cannot compute relative effect"
ERROR_ZERO_SE = "zero standard error (no variance in data)"
SRM_ALPHA = 0.01

_CONFIG = (
    "run_id", "slug", "method", "control", "treatments", "start_date", "end_date",
    "prior_proper", "prior_mean", "prior_stddev", "minimum_sample",
)


def run_arms(runs: DataFrame) -> DataFrame:
    """One row per configured arm of each run: the control is arm 0."""
    arms = F.posexplode(F.concat(F.array("control"), F.col("treatments"))).alias("arm_idx", "variant")
    return runs.select(*_CONFIG, arms)


def effect_columns(df: DataFrame) -> DataFrame:
    """Compare b with a: expects a_mean, a_var, a_n, b_mean, b_var, b_n, inverse and the prior columns.

    Adds error, chance_to_win, relative_change, absolute_change, ci_lower,
    ci_upper, risk_ctrl, risk_trt, prior_applied.
    """
    a_mean, b_mean = F.col("a_mean"), F.col("b_mean")
    se = effect_se(a_mean, F.col("a_var"), F.col("a_n"), b_mean, F.col("b_var"), F.col("b_n"), relative=True)
    error = (
        F.when((F.col("a_n") == 0) | (F.col("b_n") == 0), F.lit(ERROR_NO_USERS))
        .when(a_mean == 0, F.lit(ERROR_ZERO_MEAN))
        .when(F.col("_se") == 0, F.lit(ERROR_ZERO_SE))
    )
    df = df.withColumn("_se", se).withColumn("error", error)
    ok = F.col("error").isNull()
    sigma = F.when(ok, F.col("_se"))
    effect = (b_mean - a_mean) / F.when(ok & (a_mean != 0), a_mean)
    proper = F.coalesce(F.col("prior_proper"), F.lit(False))
    precision = F.lit(1.0) / (F.col("_sigma") * F.col("_sigma"))
    variance = F.col("prior_stddev") * F.col("prior_stddev")
    prior_precision = F.lit(1.0) / F.when(variance != 0, variance)
    total = precision + prior_precision
    df = df.withColumn("_sigma", sigma).withColumn("_effect", effect)
    df = df.withColumn(
        "_mu", F.when(proper, (F.col("_effect") * precision + F.col("prior_mean") * prior_precision) / total)
        .otherwise(F.col("_effect")),
    ).withColumn("_sd", F.when(proper, F.sqrt(F.lit(1.0) / total)).otherwise(F.col("_sigma")))
    mu, sd, inverse = F.col("_mu"), F.col("_sd"), F.col("inverse")
    gain, loss = expected_losses(mu, sd)
    win = normal_sf(0.0, mu, sd)
    df = df.withColumn("_win", win).withColumn("_gain", gain).withColumn("_loss", loss)
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        F.when(inverse, F.lit(1.0) - F.col("_win")).otherwise(F.col("_win")).alias("chance_to_win"),
        mu.alias("relative_change"),
        F.when(ok, b_mean - a_mean).alias("absolute_change"),
        (mu - z_95() * sd).alias("ci_lower"),
        (mu + z_95() * sd).alias("ci_upper"),
        F.when(inverse, F.col("_loss")).otherwise(F.col("_gain")).alias("risk_ctrl"),
        F.when(inverse, F.col("_gain")).otherwise(F.col("_loss")).alias("risk_trt"),
        F.when(ok, proper).alias("prior_applied"),
    )


def compare(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Statistics with their arm, their control and, for treatments, the comparison.

    Rows of variants no arm names are kept with a null ``arm_idx``, so that
    aggregates can tell what the data holds; they are windows of their own.
    Guardrails always use a flat prior.
    """
    arms = run_arms(runs)
    if "doc_ord" not in stats.columns:
        stats = stats.withColumn("doc_ord", F.col("metric_ord"))
    m = moments(*[F.col(c) for c in ("n", "k", "sum", "sum_squares", "mean", "variance")])
    rows = stats.withColumns(m).join(
        arms.select("run_id", "variant", "arm_idx", "prior_proper", "prior_mean", "prior_stddev",
                    F.size("treatments").alias("treatment_count")),
        ["run_id", "variant"], "left",
    )
    # Strangers get a window each: no group of unconfigured variants piles up.
    group = Window.partitionBy(
        "run_id", "metric_ord", "metric", F.when(F.col("arm_idx").isNull(), F.col("variant")).otherwise(F.lit(""))
    )
    control = F.col("arm_idx") == 0

    def of_control(name: str) -> Column:
        return F.max(F.when(control, F.col(name))).over(group)

    paired = rows.select(
        "run_id", "metric_ord", "doc_ord", "metric", "role", "metric_type", "metric_agg", "inverse", "variant",
        "arm_idx", "treatment_count", "n", "k",
        (F.col("prior_proper") & (F.col("role") != "guardrail")).alias("prior_proper"), "prior_mean", "prior_stddev",
        of_control("m_mean").alias("a_mean"), of_control("m_var").alias("a_var"), of_control("m_n").alias("a_n"),
        F.max(F.when(control, F.col("k").isNotNull())).over(group).alias("is_rate"),
        F.col("m_mean").alias("b_mean"), F.col("m_var").alias("b_var"), F.col("m_n").alias("b_n"),
    )
    return effect_columns(paired)


def comparisons(compared: DataFrame) -> DataFrame:
    """Treatment rows with a control, unrounded."""
    return compared.where((F.col("arm_idx") > 0) & F.col("a_n").isNotNull())


def section_rows(compared: DataFrame) -> DataFrame:
    """Control and treatment rows as reported: rounded, with P(win) or P(harm) and the verdict.

    A treatment that cannot be compared keeps only its size and its rate or mean.
    """
    return _reported(compared).where("shown").drop("shown", "counted")


def _reported(compared: DataFrame) -> DataFrame:
    """Report columns of every row; ``shown`` are those of arms whose metric has a control."""
    guard = F.col("role") == "guardrail"
    treated = (F.col("arm_idx") > 0) & F.col("error").isNull()

    def effect(name: str, digits: int) -> Column:
        return F.when(treated, round_half_up(F.col(name), digits))

    win, harm = F.col("chance_to_win"), F.lit(1.0) - F.col("chance_to_win")
    return compared.select(
        (F.col("arm_idx").isNotNull() & F.col("a_n").isNotNull()).alias("shown"),
        F.floor(F.coalesce("n", F.lit(0.0))).cast("bigint").alias("counted"),
        "run_id", "metric_ord", "doc_ord", "metric", "role", "metric_type", "metric_agg", "inverse", "arm_idx",
        "variant", "treatment_count", (F.col("arm_idx") == 0).alias("is_control"), F.col("b_n").alias("n"),
        "is_rate",
        F.when(F.col("is_rate"), F.floor(F.coalesce("k", F.lit(0.0)))).alias("conversions"),
        F.when(F.col("is_rate"), round_half_up(F.col("b_mean"), 6)).alias("rate"),
        F.when(~F.col("is_rate"), round_half_up(F.col("b_mean"), 4)).alias("mean"),
        effect("relative_change", 6).alias("rel_delta"),
        effect("ci_lower", 6).alias("ci_lower"),
        effect("ci_upper", 6).alias("ci_upper"),
        F.when(treated & ~guard, round_half_up(win, 4)).alias("p_win"),
        F.when(treated & guard, round_half_up(harm, 4)).alias("p_harm"),
        effect("risk_ctrl", 6).alias("risk_ctrl"),
        effect("risk_trt", 6).alias("risk_trt"),
        F.when(F.col("arm_idx") > 0, F.col("error")).alias("error"),
        F.when(treated, arm_verdict(win, guard, F.col("treatment_count"), F.col("variant"))).alias("verdict"),
    )


def arm_verdict(win: Column, guardrail: Column, treatments: Column, arm: Column) -> Column:
    """Verdict of one treatment, named when the run has several."""
    harm = F.lit(1.0) - win
    text = F.when(
        guardrail,
        F.when(harm < 0.1, F.lit("guardrail healthy"))
        .when(harm < 0.3, F.lit("guardrail borderline — monitor"))
        .otherwise(F.lit("guardrail ALARM — possible regression")),
    ).otherwise(
        F.when(win >= 0.95, F.lit("strong signal → adopt treatment"))
        .when(win >= 0.8, F.lit("leaning treatment"))
        .when(win <= 0.05, F.lit("treatment appears harmful"))
        .when(win <= 0.2, F.lit("leaning control"))
        .otherwise(F.lit("inconclusive"))
    )
    return F.when(treatments > 1, F.concat(arm, F.lit(": "), text)).otherwise(text)


def _joined_verdicts(parts: Column) -> Column:
    texts = F.filter(F.transform(parts, lambda p: p["verdict"]), lambda v: v.isNotNull())
    return F.when(F.size(texts) > 0, F.concat_ws("; ", texts)).otherwise(F.lit("no data"))


def section_verdicts(sections: DataFrame) -> DataFrame:
    """One verdict text per (run, metric), arms in their configured order."""
    return sections.groupBy("run_id", "metric_ord", "metric", "role").agg(
        _joined_verdicts(F.array_sort(F.collect_list(F.struct("arm_idx", "verdict")))).alias("verdict")
    )


def srm_p_value(counts: DataFrame, keys: list[str], observed: str = "observed", weight: str | None = None) -> DataFrame:
    """Sample-ratio test per key: chi-squared against equal or given weights.

    Adds up counts, shares and their products only, so groups of any size combine
    before the shuffle. Without users p is 1; weights of zero or less are left
    out of the sum but still count as an arm.
    """
    o = F.col(observed).cast("decimal(18,0)")
    if weight is None:
        sums = counts.groupBy(*keys).agg(
            F.count("*").alias("_k"), F.sum(o).alias("_t"), F.sum((o * o).cast("decimal(38,0)")).alias("_s")
        )
        total = F.col("_t").cast("double")
        excess = (F.col("_k") * F.col("_s") - F.col("_t") * F.col("_t")).cast("double")
        chi = excess / F.when(total > 0, total)
    else:
        w = F.col(weight).cast("double")
        used = w > 0
        x = F.col(observed).cast("double")
        sums = counts.groupBy(*keys).agg(
            F.count("*").alias("_k"), F.sum(x).alias("_t"), F.sum(w).alias("_w"),
            F.sum(F.when(used, x * x / F.when(used, w))).alias("_s"),
            F.sum(F.when(used, x)).alias("_o"), F.sum(F.when(used, w)).alias("_u"),
        )
        total = F.col("_t")
        chi = F.col("_s") * F.col("_w") / F.when(total > 0, total) - F.lit(2.0) * F.col("_o") + F.col("_u") / F.col("_w") * total
    return (
        sums.withColumn("chi2", F.coalesce(chi, F.lit(0.0)))
        .withColumn("p", chi2_sf(F.col("chi2"), F.col("_k") - 1))
        .select(
            *keys, F.col("_k").alias("arms"), total.cast("bigint").alias("total"), "chi2", "p",
            (F.col("p") >= SRM_ALPHA).alias("ok"),
        )
    )


_SHOWN = (
    "variant", "n", "is_control", "conversions", "rate", "mean", "rel_delta", "ci_lower", "ci_upper",
    "p_win", "p_harm", "risk_ctrl", "risk_trt",
)


def _per_metric(compared: DataFrame) -> DataFrame:
    """One pass over the comparisons: per (run, metric) its report section and its user counts.

    Only configured arms are collected; whatever else the data holds is just counted.
    """
    mine = F.col("arm_idx").isNotNull()
    size = F.when(mine, F.col("counted").cast("decimal(18,0)"))
    part = F.when(F.col("shown"), F.struct("arm_idx", "verdict", F.struct(*_SHOWN).alias("row")))
    return _reported(compared).groupBy("run_id", "metric_ord", "doc_ord", "metric", "role", "inverse", "metric_agg").agg(
        F.array_sort(F.collect_list(part)).alias("parts"),
        F.bool_or("is_rate").alias("is_rate"),
        F.count_if(mine).alias("arms"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total"),
        F.coalesce(F.sum((size * size).cast("decimal(38,0)")), F.lit(0)).alias("squares"),
        F.min(F.when(mine, F.col("counted"))).alias("smallest"),
        F.array_sort(F.collect_list(F.when(mine, F.struct("arm_idx", "variant", F.col("counted").alias("n"))))).alias("arms_n"),
    )


def _first_counts() -> Column:
    """Aggregate: the user counts of the run's first metric."""
    return F.min_by(
        F.struct("metric", "arms", "total", "squares", "smallest", "arms_n"), F.struct("doc_ord", "metric")
    ).alias("f")


def _health_columns(firsts: DataFrame) -> DataFrame:
    """SRM and sample check from the first metric's counts; expects f and minimum_sample."""
    total = F.col("f.total").cast("double")
    excess = (F.col("f.arms") * F.col("f.squares") - F.col("f.total") * F.col("f.total")).cast("double")
    return firsts.withColumn("chi2", F.coalesce(excess / F.when(total > 0, total), F.lit(0.0))).withColumn(
        "srm_p", chi2_sf(F.col("chi2"), F.col("f.arms") - 1)
    ).withColumns({
        "first_metric": F.col("f.metric"),
        "observed": F.map_from_entries(F.transform("f.arms_n", lambda a: F.struct(a["variant"], a["n"]))),
        "srm_ok": F.col("srm_p") >= SRM_ALPHA,
        "smallest": F.col("f.smallest"),
        "sample_ok": (F.col("minimum_sample") == 0)
        | F.coalesce(F.col("f.smallest") >= F.col("minimum_sample"), F.lit(True)),
    }).drop("f", "chi2")


def run_health(compared: DataFrame, runs: DataFrame) -> DataFrame:
    """SRM and sample check per run, from the users of the run's first metric.

    Columns: first_metric, observed (map), srm_p, srm_ok, minimum_sample,
    sample_ok, smallest.
    """
    config = runs.select("run_id", "minimum_sample")
    return _health_columns(_per_metric(compared).groupBy("run_id").agg(_first_counts()).join(config, "run_id"))


def prior_label(runs_proper: Column, mean: Column, stddev: Column) -> Column:
    return F.when(
        runs_proper, F.concat(F.lit("Gaussian(μ="), number_text(mean), F.lit(", σ="), number_text(stddev), F.lit(")"))
    ).otherwise(F.lit("flat (improper)"))


def bayesian_results(
    compared: DataFrame, runs: DataFrame, computed_at: str, warnings: DataFrame | None = None
) -> DataFrame:
    """The full result document per run: (run_id, analysis_result JSON).

    The primary metric is the first one that is no guardrail; guardrails follow
    their definitions and are left out when the data lacks them. ``warnings``
    (run_id, warning) are attached where given.
    """
    guard = F.col("role") == "guardrail"
    section = F.when(
        F.size("parts") > 0,
        F.struct(
            F.col("metric").alias("event"),
            F.when(F.col("is_rate"), F.lit("proportion")).otherwise(F.lit("continuous")).alias("metric_type"),
            F.transform("parts", lambda p: p["row"]).alias("rows"),
            _joined_verdicts(F.col("parts")).alias("verdict"),
            F.when(F.col("inverse"), F.lit(True)).alias("inverse"),
            F.col("metric_agg").alias("metric_agg"),
        ),
    )
    folded = _per_metric(compared).withColumn("section", section).groupBy("run_id").agg(
        _first_counts(),
        F.min_by("section", F.struct(guard.cast("int").alias("last"), "doc_ord")).alias("_p"),
        F.array_sort(F.collect_list(
            F.when(guard & F.col("section").isNotNull(), F.struct("metric_ord", F.to_json("section").alias("json")))
        )).alias("_g"),
    )
    config = runs.select(*_CONFIG)
    joined = _health_columns(folded.join(config, "run_id"))
    if warnings is not None:
        said = warnings.groupBy("run_id").agg(F.array_sort(F.collect_list("warning")).alias("warnings"))
        joined = joined.join(said, "run_id", "left")
    else:
        joined = joined.withColumn("warnings", F.lit(None).cast("array<string>"))
    document = F.to_json(F.struct(
        F.lit("bayesian").alias("type"),
        F.col("slug").alias("experiment"),
        F.lit(computed_at).alias("computed_at"),
        F.struct(F.col("start_date").cast("string").alias("start"), F.col("end_date").cast("string").alias("end")).alias("window"),
        F.col("control"), F.col("treatments"),
        prior_label(F.col("prior_proper"), F.col("prior_mean"), F.col("prior_stddev")).alias("prior"),
        F.struct(
            round_half_up(F.col("srm_p"), 4).alias("chi2_p_value"), F.col("srm_ok").alias("ok"), F.col("observed")
        ).alias("srm"),
        F.col("_p").alias("primary_metric"),
        F.struct(
            F.col("minimum_sample").alias("minimum_per_variant"), F.col("sample_ok").alias("ok"),
            F.col("observed").alias("variants"),
        ).alias("sample_check"),
        F.col("warnings"),
    ))
    # Guardrail sections are JSON already; they are spliced in as an array.
    guardrails = F.concat(
        F.lit(',"guardrails":['),
        F.concat_ws(",", F.transform(F.coalesce("_g", F.array().cast("array<struct<metric_ord:int,json:string>>")), lambda g: g["json"])),
        F.lit("]}"),
    )
    return joined.select(
        "run_id",
        F.concat(F.substring(document, F.lit(1), F.length(document) - 1), guardrails).alias("analysis_result"),
    )


def density_curve(sections: DataFrame, points: int = 81, reach: float = 3.5) -> DataFrame:
    """Posterior density of each compared treatment: ``points`` x-values within ``reach`` deviations.

    The deviation is read back from the interval's width; without width there is no curve.
    """
    sigma = (F.col("ci_upper") - F.col("ci_lower")) / F.lit(2 * 1.96)
    drawn = sections.where(F.col("rel_delta").isNotNull()).withColumn("sigma", sigma).where(F.col("sigma") > 0)
    lo = F.col("rel_delta") - F.lit(reach) * F.col("sigma")
    x = lo + F.lit(2 * reach) * F.col("sigma") * (F.col("i") / F.lit(float(points - 1)))
    return (
        drawn.select("run_id", "metric_ord", "metric", "variant", "rel_delta", "ci_lower", "ci_upper", "sigma",
                     F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
        .withColumn("x", x)
        .select(
            "run_id", "metric_ord", "metric", "variant", "i", "x",
            normal_pdf(F.col("x"), F.col("rel_delta"), F.col("sigma")).alias("density"),
            F.col("x").between(F.col("ci_lower"), F.col("ci_upper")).alias("in_interval"),
        )
    )
