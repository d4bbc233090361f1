"""From event tables and runs to result documents, all runs in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftwise.operators.attribution import NO_FILTERS, DesignFilters, load_design, to_stats, variant_stats
from liftwise.operators.normalize import metric_specs, run_defaults
from liftwise.operators.variants import apply_corrections, corrected_variants, variant_mismatches
from liftwise.plans.bandit import bandit_arms, bandit_results, bandit_weights
from liftwise.plans.bayes import bayesian_results, compare
from liftwise.plans.decision import data_status
from liftwise.session import materialize
from liftwise.sources.statistics import choose_source, stored_statistics, with_specs


def live_statistics(
    evals: DataFrame, events: DataFrame, runs: DataFrame, options: DesignFilters = NO_FILTERS, balanced: bool = False
) -> DataFrame:
    """Statistics of all runs with a flag, environment and primary metric."""
    design = load_design(runs, metric_specs(runs))
    return to_stats(variant_stats(evals, events, design, options, balanced))


def analyze_statistics(stats: DataFrame, runs: DataFrame, computed_at: str, failures: DataFrame | None = None) -> DataFrame:
    """(run_id, status, analysis, reason, variants_corrected, analysis_result) from given statistics.

    ``failures`` (run_id, error) are customer sources that could not be read.

    Statistics feed several reports, so pass a written table (``materialize``),
    not a plan that would attribute events again for each of them.
    """
    runs = apply_corrections(runs, corrected_variants(stats, runs))
    status = data_status(stats, runs, failures)
    usable = status.where(F.col("status") == "ok")
    bayes = runs.join(usable.where(F.col("analysis") == "bayesian").select("run_id"), "run_id", "left_semi")
    bandits = runs.join(usable.where(F.col("analysis") == "bandit").select("run_id"), "run_id", "left_semi")
    warnings = variant_mismatches(stats, bayes).select("run_id", "warning").unionByName(
        usable.where(F.col("note").isNotNull()).select("run_id", F.col("note").alias("warning"))
    )
    of_bayes = stats.join(bayes.select("run_id"), "run_id", "left_semi")
    documents = bayesian_results(compare(of_bayes, bayes), bayes, computed_at, warnings).unionByName(
        bandit_results(bandit_weights(bandit_arms(stats, bandits)), computed_at)
    )
    return status.join(runs.select("run_id", "variants_corrected"), "run_id").join(documents, "run_id", "left").select(
        "run_id", "status", "analysis", "reason", "variants_corrected", "analysis_result"
    )


def analyze(
    evals: DataFrame, events: DataFrame, runs: DataFrame, as_of: str,
    customer: DataFrame | None = None, options: DesignFilters = NO_FILTERS, balanced: bool = False, failures: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Analyse every run: returns (statistics with their data source, results).

    Live statistics are taken from the event tables, customer statistics as
    given, stored ones from the runs' ``input_data``. ``failures``, the second result of
    ``read_routed``, ends those runs with their reason. The statistics are written
    to scratch storage once and all reports read that table.
    """
    prepared = run_defaults(runs, as_of)
    specs = metric_specs(prepared)
    # Written before the sources are compared: both the union and the check which
    # runs have live data read it.
    live = materialize(live_statistics(evals, events, prepared, options, balanced), "live")
    nothing = live.limit(0)
    stored = stored_statistics(prepared) if "input_data" in prepared.columns else nothing
    chosen = choose_source(prepared, live, nothing if customer is None else customer, stored)
    stats = materialize(with_specs(chosen, specs), "stats")
    return stats, analyze_statistics(stats, prepared, as_of, failures)
