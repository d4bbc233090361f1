"""Sources of ready-made statistics: warehouse documents, stored JSON, manual rows.

All produce the long form ``STATS_COLUMNS`` minus what a run's specs add:
(run_id, metric_ord, metric, variant, n, k, sum, sum_squares, mean, variance, inverse).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftwise.schemas import CUSTOMER_MODES, METRIC_AGGS, METRIC_TYPES
from liftwise.session import materialize

_DOCUMENT = (
    T.StructType()
    .add("schemaVersion", T.StringType())
    .add("experimentId", T.StringType())
    .add("computedAt", T.StringType())
    .add("metrics", T.MapType(T.StringType(), T.StringType()))
)
_BLOCK = (
    T.StructType()
    .add("type", T.StringType())
    .add("agg", T.StringType())
    .add("data", T.MapType(T.StringType(), T.StringType()))
)
_VALUES = T.MapType(T.StringType(), T.StringType())
_FIELDS = ("n", "k", "mean", "stddev", "sum", "sum_squares")

_LONG = (
    "run_id", "metric_ord", "metric", "variant", "inverse", "n", "k", "sum", "sum_squares", "mean", "variance",
)


def _is_object(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))


def _quoted(parsed: Column, field: str) -> Column:
    """Whether a top-level field of a JSON object, as a variant, is written as a string; fields of the same name deeper inside don't count."""
    value = F.try_variant_get(parsed, f"$.{field}", "variant")
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def _number(values: Column, parsed: Column, field: str) -> Column:
    """A finite JSON number, or null when absent, quoted, or not a number."""
    number = values[field].try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(finite & ~_quoted(parsed, field), number)


def _spread(documents: DataFrame) -> DataFrame:
    """Documents dealt out evenly: a small file is one task's, but its texts can take long to parse."""
    return documents.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole JSON files as (source, body)."""
    return spark.read.option("wholetext", True).text(paths).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("body")
    )


def normalise_documents(documents: DataFrame) -> DataFrame:
    """Validate warehouse documents and lay them out by (document, metric, variant).

    ``documents`` needs run_id and body. Each row carries ``error``: null, or the
    first rule it breaks with the path of the field. A document whose own header
    is broken gives one row without a metric.

    Every text is parsed once as a map and once as a variant, which tells how a
    value is written. The result is written as a table: readers select by
    ``error``, more than once, and Spark would parse anew inside each filter.
    """
    doc = _spread(documents.select("run_id", "body")).withColumn("_d", F.from_json(F.when(_is_object(F.col("body")), F.col("body")), _DOCUMENT))
    version = F.col("_d.schemaVersion")
    doc = doc.withColumn(
        "_e",
        F.when(F.col("_d").isNull(), F.lit("response is not a JSON object"))
        .when(
            (version != "1") | version.isNull() | _quoted(F.try_parse_json("body"), "schemaVersion"),
            F.concat(F.lit("unsupported schemaVersion: "), F.coalesce(version, F.lit("undefined"))),
        )
        .when(F.col("_d.experimentId").isNull(), F.lit("experimentId missing"))
        .when(F.col("_d.computedAt").isNull(), F.lit("computedAt missing"))
        .when(F.col("_d.metrics").isNull(), F.lit("metrics missing")),
    )
    metrics = F.when(F.col("_e").isNull(), F.col("_d.metrics"))
    doc = doc.select("run_id", "_e", F.posexplode_outer(metrics).alias("metric_ord", "metric", "_mb"))
    doc = doc.withColumn("_b", F.from_json(F.when(_is_object(F.col("_mb")), F.col("_mb")), _BLOCK))
    name = F.concat(F.lit('metrics["'), F.col("metric"), F.lit('"]'))
    doc = doc.withColumn(
        "_e",
        F.when(F.col("_e").isNotNull() | F.col("metric").isNull(), F.col("_e"))
        .when(F.col("_b").isNull(), F.concat(name, F.lit(" is not an object")))
        .when(
            ~F.coalesce(F.col("_b.type").isin(*METRIC_TYPES), F.lit(False)),
            F.concat(name, F.lit(".type must be " + "|".join(METRIC_TYPES))),
        )
        .when(
            ~F.coalesce(F.col("_b.agg").isin(*METRIC_AGGS), F.lit(False)),
            F.concat(name, F.lit(".agg must be " + "|".join(METRIC_AGGS))),
        )
        .when(F.col("_b.data").isNull(), F.concat(name, F.lit(".data missing"))),
    )
    data = F.when(F.col("_e").isNull(), F.col("_b.data"))
    cell = doc.select(
        "run_id", "metric_ord", "metric", "_e", F.col("_b.type").alias("metric_type"),
        F.col("_b.agg").alias("metric_agg"), F.explode_outer(data).alias("variant", "_raw"),
    ).withColumns({"_v": F.from_json(F.when(_is_object(F.col("_raw")), F.col("_raw")), _VALUES), "_j": F.try_parse_json("_raw")})
    cell = cell.withColumns({f"_{field}": _number(F.col("_v"), F.col("_j"), field) for field in _FIELDS})

    path = F.concat(F.lit('metrics["'), F.col("metric"), F.lit('"].data["'), F.col("variant"), F.lit('"]'))

    def value(field: str) -> Column:
        return F.col(f"_{field}")

    def has(field: str) -> Column:
        return F.coalesce(F.array_contains(F.map_keys("_v"), field), F.lit(False))

    def not_number(field: str) -> Column:
        return F.concat(
            path, F.lit(f".{field} must be a finite number, got "), F.coalesce(F.col("_v")[field], F.lit("undefined"))
        )

    binary = F.col("metric_type") == "binary"
    by_mean = ~binary & (has("mean") | has("stddev"))
    by_sum = ~binary & ~by_mean & has("sum")
    n = value("n")
    error = (
        F.when(F.col("_e").isNotNull() | F.col("variant").isNull(), F.col("_e"))
        .when(F.col("_v").isNull(), F.concat(path, F.lit(" is not an object")))
        .when(n.isNull(), not_number("n"))
        .when(n < 0, F.concat(path, F.lit(".n must be at least 0")))
        .when(binary & value("k").isNull(), not_number("k"))
        .when(by_mean & value("mean").isNull(), not_number("mean"))
        .when(by_mean & value("stddev").isNull(), not_number("stddev"))
        .when(by_sum & value("sum").isNull(), not_number("sum"))
        .when(by_sum & value("sum_squares").isNull(), not_number("sum_squares"))
        .when(~binary & ~by_mean & ~by_sum, F.concat(path, F.lit(" missing required keys")))
    )
    users = F.when(n > 0, n)
    average = F.coalesce(value("sum") / users, F.lit(0.0))
    spread = F.when(
        n > 1, (value("sum_squares") - value("sum") * value("sum") / users) / F.when(n > 1, n - 1)
    ).otherwise(F.lit(0.0))
    none = F.lit(None).cast("double")
    good = F.col("error").isNull() & F.col("variant").isNotNull()
    laid_out = cell.withColumn("error", error).select(
        "run_id", "metric_ord", "metric", "metric_type", "metric_agg", "variant",
        F.lit(None).cast("boolean").alias("inverse"),
        F.when(good, n).alias("n"),
        F.when(good & binary, value("k")).alias("k"),
        none.alias("sum"), none.alias("sum_squares"),
        F.when(good & by_mean, value("mean")).when(good & by_sum, average).alias("mean"),
        F.when(good & by_mean, value("stddev") * value("stddev")).when(good & by_sum, spread).alias("variance"),
        "error",
    )
    return materialize(laid_out, "documents")


def split_documents(normalised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statistics of documents without any error, first error of each other document)."""
    bad = normalised.where(F.col("error").isNotNull()).groupBy("run_id").agg(
        F.min_by("error", F.struct(F.coalesce("metric_ord", F.lit(-1)), F.coalesce("variant", F.lit("")))).alias("error")
    )
    good = normalised.where(F.col("variant").isNotNull()).join(bad.select("run_id"), "run_id", "left_anti")
    return good.select(*_LONG), bad


def route_metrics(specs: DataFrame, routes: DataFrame) -> DataFrame:
    """Attach each metric's (provider, path), one row per spec, with ``error`` where no route exists."""
    joined = specs.join(
        routes.select("run_id", F.col("metric").alias("event_name"), "provider", "path"), ["run_id", "event_name"], "left"
    )
    return joined.withColumn(
        "error",
        F.when(
            F.coalesce(F.col("provider"), F.lit("")).isin("") | F.col("path").isNull(),
            F.concat(F.lit('no route for metric "'), F.col("event_name"), F.lit('"')),
        ),
    )


def _source_key() -> Column:
    """One text for a (run, provider, path), different for different ones whatever they hold."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in ("run_id", "provider", "path")]))


def read_routed(routed: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statistics of runs whose metrics come from several sources, each document read once.

    ``documents`` needs provider, path, run_id, body: one reply per source and
    run. All or nothing: a run fails when a route or reply is missing, or any
    reply it uses is broken. Returns (statistics, run_id with error).
    """
    sources = (
        routed.groupBy("run_id", "provider", "path")
        .agg(F.count("*").alias("_metrics"), F.max("error").alias("_route_error"))
    )
    asked = sources.join(documents, ["run_id", "provider", "path"], "left").withColumn(
        "_source", _source_key()
    )
    parsed = normalise_documents(
        asked.where(F.col("body").isNotNull()).select(F.col("_source").alias("run_id"), "body")
    ).withColumnRenamed("run_id", "_source")
    reply_error = parsed.where(F.col("error").isNotNull()).groupBy("_source").agg(F.min("error").alias("_reply_error"))
    failures = (
        asked.join(reply_error, "_source", "left")
        .withColumn(
            "error",
            F.coalesce(
                "_route_error",
                F.when(F.col("body").isNull(), F.concat(F.lit("no reply from "), "provider", F.lit("|"), "path")),
                "_reply_error",
            ),
        )
        .where(F.col("error").isNotNull())
        .groupBy("run_id")
        .agg(F.min("error").alias("error"))
    )
    wanted = routed.where(F.col("error").isNull()).select(
        _source_key().alias("_source"), "run_id",
        F.col("event_name").alias("metric"), F.col("metric_ord").alias("_ord"),
    )
    stats = (
        parsed.where(F.col("error").isNull() & F.col("variant").isNotNull())
        .drop("metric_ord")
        .join(wanted, ["_source", "metric"])
        .join(failures.select("run_id"), "run_id", "left_anti")
        .withColumnRenamed("_ord", "metric_ord")
    )
    return stats.select(*_LONG), failures


def stored_statistics(runs: DataFrame, column: str = "input_data") -> DataFrame:
    """Statistics kept as JSON text on the run; the ``inverse`` key is a flag, not a variant, and null when absent."""
    doc = F.from_json(F.col(column), "struct<metrics: map<string,string>>")
    metrics = runs.where(_is_object(F.col(column))).select(
        "run_id", F.posexplode(doc["metrics"]).alias("metric_ord", "metric", "_m")
    )
    variants = F.from_json(F.when(_is_object(F.col("_m")), F.col("_m")), _VALUES)
    cells = metrics.withColumn("_map", variants).select(
        "run_id", "metric_ord", "metric",
        (F.lower(F.col("_map")["inverse"]) == "true").alias("inverse"),
        F.explode(F.map_entries("_map")).alias("_entry"),
    )
    v = F.from_json(F.when(_is_object(F.col("_entry.value")), F.col("_entry.value")), _VALUES)
    cells = cells.where((F.col("_entry.key") != "inverse") & _is_object(F.col("_entry.value"))).withColumn("_v", v)
    return cells.select(
        "run_id", "metric_ord", "metric", F.col("_entry.key").alias("variant"), "inverse",
        *[F.col("_v")[c].try_cast("double").alias(c) for c in ("n", "k", "sum", "sum_squares", "mean", "variance")],
    )


def manual_statistics(rows: DataFrame) -> DataFrame:
    """Hand-entered text rows (run_id, metric_ord, metric, metric_type, variant, n, s, ss, inverse).

    Rows without a variant or a positive n are skipped; absent numbers are 0.
    """
    n = F.col("n").try_cast("double")
    s = F.coalesce(F.col("s").try_cast("double"), F.lit(0.0))
    ss = F.coalesce(F.col("ss").try_cast("double"), F.lit(0.0))
    binary = F.col("metric_type") == "binary"
    none = F.lit(None).cast("double")
    kept = rows.where((F.trim("variant") != "") & n.isNotNull() & ~F.isnan(n) & (n > 0))
    return kept.select(
        "run_id", "metric_ord", "metric", F.trim("variant").alias("variant"),
        F.col("inverse").alias("inverse"),
        n.alias("n"),
        F.when(binary, s).alias("k"),
        F.when(~binary, s).alias("sum"),
        F.when(~binary, ss).alias("sum_squares"),
        none.alias("mean"), none.alias("variance"),
    )


def choose_source(runs: DataFrame, live: DataFrame, customer: DataFrame, stored: DataFrame) -> DataFrame:
    """Statistics of each run from the source its mode allows, labelled ``data_source``.

    A customer run uses customer data only. Any other run uses live data and
    falls back to what is stored on it.
    """
    modes = runs.select("run_id", F.coalesce("data_source_mode", F.lit("managed")).isin(*CUSTOMER_MODES).alias("_customer"))
    is_customer = modes.where(F.col("_customer")).select("run_id")
    managed = modes.where(~F.col("_customer")).select("run_id")
    own = customer.join(is_customer, "run_id", "left_semi").withColumn("data_source", F.lit("customer"))
    fresh = live.join(managed, "run_id", "left_semi").withColumn("data_source", F.lit("live"))
    kept = (
        stored.join(managed, "run_id", "left_semi")
        .join(live.select("run_id").distinct(), "run_id", "left_anti")
        .withColumn("data_source", F.lit("stored"))
    )
    columns = [*_LONG, "data_source"]
    return reduce(DataFrame.unionByName, [f.select(*columns) for f in (own, fresh, kept)])


def with_specs(stats: DataFrame, specs: DataFrame) -> DataFrame:
    """Add role, type and aggregation of each metric from the run's specs.

    Metrics take the order of the specs; ``doc_ord`` keeps the order they had in
    their source. A metric no spec mentions gets the role ``extra`` and comes
    last. ``inverse`` is the data's where it says so or not, else the definition's.
    """
    s = specs.select(
        "run_id", F.col("event_name").alias("metric"), F.col("metric_ord").alias("_ord"),
        F.col("role").alias("_role"), F.col("metric_type").alias("_type"), F.col("metric_agg").alias("_agg"),
        F.col("inverse").alias("_inverse"),
    )
    extra = [c for c in stats.columns if c not in (*_LONG, "role", "metric_type", "metric_agg", "doc_ord")]
    return stats.join(s, ["run_id", "metric"], "left").select(
        "run_id",
        F.coalesce("_ord", F.col("metric_ord") + 10_000).alias("metric_ord"),
        F.col("metric_ord").alias("doc_ord"),
        "metric",
        F.coalesce("_role", F.lit("extra")).alias("role"),
        F.coalesce("_type", F.when(F.col("k").isNotNull(), F.lit("binary")).otherwise(F.lit("continuous"))).alias("metric_type"),
        F.col("_agg").alias("metric_agg"),
        F.coalesce("inverse", "_inverse", F.lit(False)).alias("inverse"),
        "variant", "n", "k", "sum", "sum_squares", "mean", "variance", *extra,
    )
