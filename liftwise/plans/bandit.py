"""Thompson sampling for all bandit runs at once.

Draws are made where the run's arms are: a run is spread over blocks of draws,
each draw reads its random numbers from its own position in the seed's
sequence, and only (run, arm) counts leave the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftwise.functions.moments import arm_posterior, moments
from liftwise.functions.random import standard_normal, uniform
from liftwise.functions.rounding import to_fixed
from liftwise.plans.bayes import run_arms, srm_p_value

MIN_UNITS = 100
MIN_WEIGHT = 0.01
DRAWS = 10_000
BLOCK = 250
STOP_AT = 0.95


def bandit_arms(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Every configured arm with its moments on the primary metric; an absent arm has no users."""
    arms = run_arms(runs)
    m = moments(*[F.col(c) for c in ("n", "k", "sum", "sum_squares", "mean", "variance")])
    primary = stats.where(F.col("role") == "primary").withColumns(m).select(
        "run_id", "variant", "metric", "inverse", "k", "m_n", "m_mean", "m_var"
    )
    joined = arms.join(primary, ["run_id", "variant"], "left")
    whole = Window.partitionBy("run_id")
    n = F.coalesce("m_n", F.lit(0).cast("bigint"))
    mean = F.coalesce("m_mean", F.lit(0.0))
    return joined.select(
        "run_id", "slug", "start_date", "end_date", "arm_idx", F.col("variant").alias("arm"),
        F.max("metric").over(whole).alias("metric"),
        F.coalesce(F.max("inverse").over(whole), F.lit(False)).alias("inverse"),
        n.alias("n"), mean.alias("mean"), F.coalesce("m_var", F.lit(0.0)).alias("variance"),
        F.coalesce("k", F.lit(0.0)).alias("conversions"),
        F.when(F.col("k").isNotNull() & (n > 0), F.col("k") / F.when(n > 0, n))
        .when(F.col("k").isNotNull(), F.lit(0.0)).otherwise(mean).alias("rate"),
        "prior_proper", "prior_mean", "prior_stddev",
    )


def default_seed(run_id: Column) -> Column:
    """A fixed seed per run below one million."""
    return F.pmod(F.xxhash64(run_id), F.lit(1_000_000))


def draw_counts(arms: DataFrame, draws: int = DRAWS) -> DataFrame:
    """(run_id, arm_idx, firsts, top_twos) over ``draws`` posterior draws per run.

    ``arms`` needs run_id, seed, arm_idx, mean, variance, n, inverse and the prior.
    Only the runs' lists of arms and block numbers are shuffled. A draw is one
    row that holds its run's few arms, so its best two are found without
    grouping or sorting draws, and only counts leave the task.
    """
    mean, variance = arm_posterior(*[F.col(c) for c in ("mean", "variance", "n", "prior_proper", "prior_mean", "prior_stddev")])
    blocks = (draws + BLOCK - 1) // BLOCK
    arm = F.struct("arm_idx", mean.alias("mu"), F.sqrt(F.greatest(variance, F.lit(1e-12))).alias("sd"))
    whole = arms.groupBy("run_id", "seed", "inverse").agg(F.sort_array(F.collect_list(arm)).alias("arms"))
    # A set number of partitions: the few input rows must not be merged into one task.
    partitions = int(arms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = whole.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(partitions, "run_id", "block")
    inside = F.sequence(F.col("block") * BLOCK, F.least((F.col("block") + 1) * BLOCK, F.lit(draws)) - 1)
    drawn = spread.select("run_id", "seed", "inverse", "arms", F.explode(inside).alias("draw"))

    def value(arm: Column) -> Column:
        k = (F.col("draw").cast("bigint") * F.size("arms") + arm["arm_idx"]) * 2
        normal = standard_normal(uniform(F.col("seed"), k + 1), uniform(F.col("seed"), k + 2))
        return arm["mu"] + arm["sd"] * normal

    def signed(arm: Column) -> Column:
        return F.struct(F.when(F.col("inverse"), -value(arm)).otherwise(value(arm)).alias("signed"), (-arm["arm_idx"]).alias("down"))

    return _two_best(drawn.select("run_id", F.transform("arms", signed).alias("arms")))


def rank_draws(samples: DataFrame, draw: Sequence[str] = ("run_id", "draw")) -> DataFrame:
    """Rank arms inside each draw (run_id, draw, arm_idx, value, inverse); ties to the lower arm."""
    signed = F.when(F.col("inverse"), -F.col("value")).otherwise(F.col("value"))
    order = Window.partitionBy(*draw).orderBy(signed.desc(), "arm_idx")
    return samples.withColumn("rank", F.row_number().over(order))


def _two_best(draws: DataFrame) -> DataFrame:
    """(run_id, arm_idx, firsts, top_twos) from draws, each a short list of (signed, down): its greatest and the greatest of the rest."""
    best = draws.withColumn("best", F.array_max("arms"))
    second = F.array_max(F.filter("arms", lambda a: a["down"] != F.col("best.down")))
    two = best.select("run_id", F.posexplode(F.array("best", second)).alias("place", "arm")).where(F.col("arm").isNotNull())
    return two.groupBy("run_id", (-F.col("arm.down")).alias("arm_idx")).agg(F.count_if(F.col("place") == 0).alias("firsts"), F.count("*").alias("top_twos"))


def counts_from_samples(samples: DataFrame, draw: Sequence[str] = ("run_id", "draw")) -> DataFrame:
    """How often each arm came first and among the first two in a sample matrix. A draw has as many rows as its run has arms."""
    signed = F.when(F.col("inverse"), -F.col("value")).otherwise(F.col("value"))
    arms = F.collect_list(F.struct(signed.alias("signed"), (-F.col("arm_idx")).alias("down")))
    return _two_best(samples.groupBy(*draw).agg(arms.alias("arms")).select("run_id", "arms"))


def weights_from_counts(arms: DataFrame, counts: DataFrame) -> DataFrame:
    """P(best) and traffic weights: top-two share, floored at 1%, renormalised.

    A single arm uses P(best) instead of the share.
    """
    run = Window.partitionBy("run_id")
    firsts = F.coalesce("firsts", F.lit(0))
    tops = F.coalesce("top_twos", F.lit(0))
    draws = F.sum(firsts).over(run)
    size = F.count(F.lit(1)).over(run)
    share = tops / F.when(F.sum(tops).over(run) > 0, F.sum(tops).over(run))
    p = firsts / F.when(draws > 0, draws)
    joined = arms.join(counts, ["run_id", "arm_idx"], "left").withColumn("p_best", p).withColumn(
        "_w", F.greatest(F.when(size > 1, share).otherwise(F.col("p_best")), F.lit(MIN_WEIGHT))
    )
    return joined.withColumn("weight", F.col("_w") / F.sum("_w").over(run)).drop("_w", "firsts", "top_twos")


def weights_from_samples(samples: DataFrame) -> DataFrame:
    """(run_id, arm_idx, p_best, weight) from a sample matrix."""
    arms = samples.select("run_id", "arm_idx").distinct()
    return weights_from_counts(arms, counts_from_samples(samples))


def bandit_weights(arms: DataFrame, draws: int = DRAWS) -> DataFrame:
    """Arms with ``enough_units``, ``update_message``, ``p_best``, ``weight`` and ``seed``.

    Under 100 users in any arm a run is still burning in and gets no weights.
    """
    run = Window.partitionBy("run_id")
    if "seed" not in arms.columns:
        arms = arms.withColumn("seed", default_seed(F.col("run_id")))
    arms = arms.withColumn("smallest", F.min("n").over(run)).withColumn("enough_units", F.col("smallest") >= MIN_UNITS)
    ready = arms.where(F.col("enough_units"))
    weighted = weights_from_counts(arms, draw_counts(ready, draws))
    message = F.when(F.col("enough_units"), F.lit("successfully updated")).otherwise(
        F.concat(
            F.lit(f"burn-in: need >= {MIN_UNITS} users per arm before dynamic weighting (current minimum: "),
            F.col("smallest").cast("string"), F.lit(")"),
        )
    )
    ready_only = ["p_best", "weight", "seed"]
    return weighted.withColumn("update_message", message).withColumns(
        {c: F.when(F.col("enough_units"), F.col(c)) for c in ready_only}
    ).drop("smallest")


def rollout_ranges(weights: DataFrame) -> DataFrame:
    """Cumulative [start, end) traffic ranges in arm order."""
    upto = Window.partitionBy("run_id").orderBy("arm_idx").rowsBetween(Window.unboundedPreceding, 0)
    return weights.withColumn("range_end", F.sum("weight").over(upto)).withColumn(
        "range_start", F.col("range_end") - F.col("weight")
    )


def best_arms(weights: DataFrame) -> DataFrame:
    """Arm of highest P(best) per run, first arm on ties; without draws the control at 0."""
    p = F.coalesce("p_best", F.lit(0.0))
    best = F.min_by(F.struct("arm", p.alias("p")), F.struct(-p, F.col("arm_idx")))
    return weights.groupBy("run_id").agg(
        best.alias("b"), F.first("enough_units").alias("enough_units"), F.first("update_message").alias("update_message")
    ).select("run_id", F.col("b.arm").alias("best_arm"), F.col("b.p").alias("p_best"), "enough_units", "update_message")


def stopping(best: DataFrame, threshold: float = STOP_AT) -> DataFrame:
    """Whether a run may stop, with its message."""
    met = F.col("enough_units") & (F.col("p_best") >= threshold)
    p = to_fixed(F.col("p_best"), 4)
    message = (
        F.when(met, F.concat("best_arm", F.lit(" reached P(best)="), p, F.lit(f" >= {threshold:.2f}")))
        .when(
            F.col("enough_units"),
            F.concat(F.lit("best arm "), "best_arm", F.lit(" currently at P(best)="), p, F.lit(f", threshold={threshold:.2f}")),
        )
        .otherwise(F.col("update_message"))
    )
    return best.select("run_id", met.alias("met"), "best_arm", "p_best", F.lit(threshold).alias("threshold"), message.alias("message"))


def bandit_results(weights: DataFrame, computed_at: str) -> DataFrame:
    """The full bandit document per run: (run_id, analysis_result JSON)."""
    srm = srm_p_value(weights.withColumn("observed", F.col("n")), ["run_id"]).select(
        "run_id", F.col("p").alias("srm_p"), F.col("ok").alias("srm_ok")
    )
    stop = stopping(best_arms(weights))
    folded = weights.groupBy("run_id", "slug", "metric", "start_date", "end_date").agg(
        F.array_sort(F.collect_list(F.struct(
            "arm_idx", "arm", "n", "conversions", "rate",
            F.coalesce("p_best", F.lit(0.0)).alias("p_best"), F.coalesce("weight", F.lit(0.0)).alias("weight"),
        ))).alias("arms"),
        F.first("enough_units").alias("enough_units"), F.first("update_message").alias("update_message"),
        F.first("seed").alias("seed"),
    )
    document = F.to_json(F.struct(
        F.lit("bandit").alias("type"), F.col("slug").alias("experiment"), F.lit(computed_at).alias("computed_at"),
        F.struct(F.col("start_date").cast("string").alias("start"), F.col("end_date").cast("string").alias("end")).alias("window"),
        F.col("metric"), F.lit("thompson_sampling_top_two").alias("algorithm"),
        F.struct(
            to_fixed(F.col("srm_p"), 4).cast("double").alias("chi2_p_value"), F.col("srm_ok").alias("ok"),
            F.map_from_entries(F.transform("arms", lambda a: F.struct(a["arm"], a["n"]))).alias("observed"),
        ).alias("srm"),
        F.transform("arms", lambda a: F.struct(a["arm"].alias("arm"), a["n"].alias("n"), a["conversions"].alias("conversions"), a["rate"].alias("rate"))).alias("arms"),
        F.struct(
            F.transform("arms", lambda a: F.struct(a["arm"].alias("arm"), a["p_best"].alias("p_best"), a["weight"].alias("recommended_weight"))).alias("results"),
            F.col("enough_units"), F.col("update_message"), F.col("seed"),
        ).alias("thompson_sampling"),
        F.struct("met", "best_arm", F.col("p_best"), "threshold", "message").alias("stopping"),
    ))
    return folded.join(srm, "run_id").join(stop, "run_id").select("run_id", document.alias("analysis_result"))
