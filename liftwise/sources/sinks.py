"""Result sinks: statistics and results as JSON per run, and CSV exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.operators.variants import most_seen
from liftwise.session import materialize

#: Variants of a metric in a run's document.
VARIANTS = 1000


def input_data_json(stats: DataFrame, runs: DataFrame | None = None, most: int = VARIANTS) -> DataFrame:
    """Per run, the document {"metrics": {event: {variant: numbers, "inverse"?: true}}}.

    Built in two small steps, variant then metric, with keys in metric and
    variant order. A metric holds at most ``most`` variants: with ``runs`` given
    their arms, then those with most users. ``omitted`` counts the cells left
    out, which ``omitted_statistics`` has as rows.
    """
    cells_in = stats.groupBy("run_id").agg(F.count("*").alias("_cells"))
    stats = _listed(stats, runs, most)
    number = {c: F.col(c).cast("double") for c in ("n", "k", "sum", "sum_squares", "mean", "variance")}
    cell = F.struct(F.col("variant").alias("key"), F.to_json(F.struct(*[v.alias(c) for c, v in number.items()])).alias("value"))
    per_metric = stats.groupBy("run_id", "metric_ord", "metric").agg(
        F.array_sort(F.collect_list(cell)).alias("cells"), F.max("inverse").alias("inverse")
    )

    def pairs(array: Column) -> Column:
        return F.concat_ws(",", F.transform(array, lambda e: F.concat(_quote(e["key"]), F.lit(":"), e["value"])))

    body = F.concat(
        F.lit("{"), pairs(F.col("cells")), F.when(F.col("inverse"), F.lit(',"inverse":true')).otherwise(F.lit("")), F.lit("}")
    )
    per_run = per_metric.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("metric_ord", F.col("metric").alias("key"), body.alias("value")))).alias("m"),
        F.sum(F.size("cells")).alias("_listed"),
    ).join(cells_in, "run_id")
    document = F.concat(F.lit('{"metrics":{'), pairs(F.col("m")), F.lit("}}"))
    return per_run.select("run_id", document.alias("input_data"), (F.col("_cells") - F.col("_listed")).alias("omitted"))


def _listed(stats: DataFrame, runs: DataFrame | None, most: int) -> DataFrame:
    keys = ["run_id", "metric_ord", "metric"]
    if runs is None:
        return most_seen(stats, keys, most)
    arms = runs.select("run_id", F.explode(F.concat(F.array("control"), F.col("treatments"))).alias("variant")).distinct().withColumn("_arm", F.lit(True))
    known = stats.join(arms, ["run_id", "variant"], "left")
    return most_seen(known, keys, most, F.coalesce("_arm", F.lit(False))).drop("_arm")


def omitted_statistics(stats: DataFrame, runs: DataFrame | None = None, most: int = VARIANTS) -> DataFrame:
    """The statistics that ``input_data_json`` leaves out, as rows."""
    keys = ["run_id", "metric_ord", "metric", "variant"]
    return stats.join(_listed(stats, runs, most).select(*keys), keys, "left_anti")


def _quote(text: Column) -> Column:
    """A JSON string literal: the one-element array's text without its brackets."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def write_results(results: DataFrame, path: str, key: str = "run_id", parts: int = 64) -> None:
    """Write results so that writing a run again replaces its earlier result.

    Runs are spread over ``parts`` folders by a hash of the key, the same number
    at every write to a path; a rewrite merges the folders it touches, and only
    those. Results are computed once. A large folder is written by several tasks.
    """
    spark = results.sparkSession
    parted = materialize(results.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), "new-results")
    touched = [row[0] for row in parted.select("part").distinct().collect()]  # at most ``parts`` numbers
    try:
        old = spark.read.parquet(path)
    except Exception as missing:  # no earlier results
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        merged = parted
    else:
        kept = old.where(F.col("part").isin(touched)).join(parted.select(key), key, "left_anti")
        merged = kept.unionByName(parted, allowMissingColumns=True)
    staged = materialize(merged, "results")  # the sink is also an input
    staged.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "part"
    ).parquet(path)


def exposures_csv(exposures: DataFrame, path: str) -> None:
    """CSV of user_key, variant, timestamp."""
    csv_exposures(exposures).write.mode("overwrite").option("header", True).csv(path)


def events_csv(events: DataFrame, path: str) -> None:
    """CSV of user_key, event_name, timestamp."""
    csv_events(events).write.mode("overwrite").option("header", True).csv(path)


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def csv_exposures(exposures: DataFrame) -> DataFrame:
    return exposures.select("user_key", "variant", _iso(F.col("timestamp")).alias("timestamp"))


def csv_events(events: DataFrame) -> DataFrame:
    return events.select("user_key", "event_name", _iso(F.col("timestamp")).alias("timestamp"))
