"""Checks that configured variants and observed variants agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Observed variants that a warning lists, those with most users.
LISTED = 100


def _primary(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("role") == "primary")


def _configured(runs: DataFrame) -> DataFrame:
    arms = F.posexplode(F.concat(F.array("control"), F.col("treatments"))).alias("arm_idx", "arm")
    return runs.select("run_id", F.size("treatments").alias("treatment_count"), arms)


def corrected_variants(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Arms to rename, (run_id, arm_idx, arm, new_arm), where none of a run's names occurs in its data.

    Only when data and configuration have equally many names, which are then
    matched in sorted order. Counting comes first, so that only runs with as many
    observed as configured names are ever ranked.
    """
    arms = _configured(runs)
    seen = _primary(stats).select("run_id", "variant").distinct()
    counts = seen.join(
        arms.select("run_id", F.col("arm").alias("variant"), F.lit(1).alias("hit")).distinct(), ["run_id", "variant"], "left"
    ).groupBy("run_id").agg(F.count("*").alias("seen"), F.count("hit").alias("hits"))
    sizes = arms.groupBy("run_id").agg(F.count("*").alias("configured"))
    lost = counts.join(sizes, "run_id").where((F.col("hits") == 0) & (F.col("seen") == F.col("configured"))).select("run_id")
    by_name = Window.partitionBy("run_id")
    left = arms.join(lost, "run_id", "left_semi").withColumn("rank", F.rank().over(by_name.orderBy("arm")))
    right = seen.join(lost, "run_id", "left_semi").select(
        "run_id", F.col("variant").alias("new_arm"), F.row_number().over(by_name.orderBy("variant")).alias("rank")
    )
    return left.join(right, ["run_id", "rank"]).select("run_id", "arm_idx", "arm", "new_arm")


def apply_corrections(runs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Runs with corrected control and treatments; ``variants_corrected`` marks the changed ones."""
    renamed = corrections.groupBy("run_id").agg(
        F.max(F.when(F.col("arm_idx") == 0, F.col("new_arm"))).alias("_control"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("arm_idx") > 0, F.struct("arm_idx", "new_arm")))),
            lambda a: a["new_arm"],
        ).alias("_treatments"),
    )
    return (
        runs.join(renamed, "run_id", "left")
        .withColumn("variants_corrected", F.col("_control").isNotNull())
        .withColumn("control", F.coalesce("_control", "control"))
        .withColumn("treatments", F.when(F.col("variants_corrected"), F.col("_treatments")).otherwise(F.col("treatments")))
        .drop("_control", "_treatments")
    )


def most_seen(stats: DataFrame, keys: list[str], most: int, first: Column | None = None) -> DataFrame:
    """The ``most`` variants with most users per ``keys``, ties by name; those of ``first`` before others.

    Every task keeps its best before rows move, so a run with any number of
    variants sends and holds ``most`` of them per task.
    """
    order = [F.col("n").desc_nulls_last(), "variant"]
    ranked = Window.partitionBy(*keys).orderBy(*([first.desc()] if first is not None else []), *order)
    return stats.withColumn("_place", F.row_number().over(ranked)).where(F.col("_place") <= most).drop("_place")


def stray_variants(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Observed variants of the primary metric that no run's arms name, one row each: (run_id, variant, n)."""
    arms = _configured(runs).select("run_id", F.col("arm").alias("variant"))
    return _primary(stats).groupBy("run_id", "variant").agg(F.max("n").alias("n")).join(arms, ["run_id", "variant"], "left_anti")


def variant_mismatches(stats: DataFrame, runs: DataFrame, most: int = LISTED) -> DataFrame:
    """Runs whose primary metric lacks the control and other expected names, with a warning.

    Names are listed only for those runs, and of the observed ones at most the
    ``most`` with most users; ``n_available`` counts all, and
    ``stray_variants`` has the rest as rows.
    """
    arms = _configured(runs)
    seen = _primary(stats).groupBy("run_id", "variant").agg(F.max("n").alias("n"))
    missing = arms.join(seen.select("run_id", F.col("variant").alias("arm")), ["run_id", "arm"], "left_anti")
    totals = seen.groupBy("run_id").agg(F.count("*").alias("n_available"))
    no_control = missing.where(F.col("arm_idx") == 0).select("run_id").join(totals, "run_id")
    expected = arms.join(no_control, "run_id", "left_semi").groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("arm_idx", "arm"))).alias("e")
    )
    lacking = missing.join(no_control, "run_id", "left_semi").groupBy("run_id").agg(
        F.array_sort(F.collect_list("arm")).alias("missing")
    )
    found = most_seen(seen.join(no_control, "run_id", "left_semi"), ["run_id"], most).groupBy("run_id").agg(
        F.array_sort(F.collect_list("variant")).alias("available")
    )
    names = F.concat_ws(", ", F.transform("e", lambda a: a["arm"]))
    more = F.when(F.col("n_available") > F.size("available"), F.concat(F.lit(" and "), F.col("n_available") - F.size("available"), F.lit(" more")))
    text = F.concat(
        F.lit("The run is set up for ["), names, F.lit("], its data holds ["), F.concat_ws(", ", "available"), F.coalesce(more, F.lit("")),
        F.lit("]. Set the run's variants to those of its data."),
    )
    return expected.join(lacking, "run_id").join(found, "run_id").join(no_control, "run_id").select(
        "run_id", "missing", "available", "n_available", text.alias("warning")
    )


def incomplete_metrics(stats: DataFrame, specs: DataFrame, runs: DataFrame) -> DataFrame:
    """Configured (run, metric, variant) cells that are absent; a cell with zero users is present."""
    arms = _configured(runs)
    expected = specs.select("run_id", F.col("event_name").alias("metric")).join(
        arms.select("run_id", F.col("arm").alias("variant")), "run_id"
    )
    return expected.join(stats.select("run_id", "metric", "variant"), ["run_id", "metric", "variant"], "left_anti")
