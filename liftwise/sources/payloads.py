"""Event payloads: decode batches, flatten to the two event tables, account for rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Observation
from pyspark.sql import functions as F

from liftwise.functions.hashing import hash_bucket
from liftwise.schemas import FLAG_EVALUATIONS, METRIC_EVENTS, PAYLOAD


# The fields of a payload as raw text, to tell a wrong JSON type from an absent field.
_SHAPE = "array<struct<user: string, variations: string, metrics: string>>"
# Epoch milliseconds of the years 1 to 9999.
_INSTANTS = (-62_135_596_800_000, 253_402_300_799_999)


def decode_payloads(batches: DataFrame, body: str = "body") -> DataFrame:
    """Parse each batch body, a JSON array of payloads.

    Adds ``payloads`` and ``error``. A body that is no JSON array, or holds a
    field of the wrong JSON type or a number that does not parse, is an ``Invalid
    JSON body``; an empty array is an ``Empty payload``; an instant outside the
    years 1 to 9999 is a ``Timestamp out of range``. Rejected bodies keep a null
    ``payloads``.

    Each body is parsed once: the parsed value goes through a generator, which
    filters on it are not pushed below.
    """
    text = F.col(body)
    array = F.when(F.ltrim(text).startswith("["), text)
    once = F.explode(F.array(F.struct(F.from_json(array, PAYLOAD).alias("payloads"), F.from_json(array, _SHAPE).alias("shape"))))
    parsed = batches.select("*", once.alias("_parsed")).select(*batches.columns, "_parsed.payloads", F.col("_parsed.shape").alias("_shape"))

    def wrong(value: Column, type_: str) -> Column:
        return value.isNotNull() & value.try_cast(type_).isNull()

    def misshaped(s: Column) -> Column:
        kinds = {"user": "{", "variations": "[", "metrics": "["}
        bad = [s[name].isNotNull() & ~F.ltrim(s[name]).startswith(sign) for name, sign in kinds.items()]
        return s.isNull() | F.coalesce(bad[0] | bad[1] | bad[2], F.lit(False))

    def no_instant(value: Column) -> Column:
        return F.coalesce(~value.try_cast("bigint").between(*_INSTANTS), F.lit(False))

    def out_of_range(p: Column) -> Column:
        late = [F.exists(p[field], lambda x: no_instant(x["timestamp"])) for field in ("variations", "metrics")]
        return F.coalesce(late[0], F.lit(False)) | F.coalesce(late[1], F.lit(False))

    def wrong_payload(p: Column) -> Column:
        bad_variation = F.exists(p["variations"], lambda v: v.isNull() | wrong(v["timestamp"], "bigint"))
        bad_metric = F.exists(
            p["metrics"], lambda m: m.isNull() | wrong(m["timestamp"], "bigint") | wrong(m["numericValue"], "double")
        )
        return F.coalesce(bad_variation, F.lit(False)) | F.coalesce(bad_metric, F.lit(False))

    def unread(p: Column, s: Column) -> Column:
        gone = [s[name].isNotNull() & p[name].isNull() for name in ("user", "variations", "metrics")]
        return gone[0] | gone[1] | gone[2]

    lost = F.exists(F.zip_with("payloads", "_shape", unread), lambda x: F.coalesce(x, F.lit(True)))
    error = (
        F.when(F.col("payloads").isNull(), F.lit("Invalid JSON body"))
        .when(F.size("payloads") == 0, F.lit("Empty payload"))
        .when(F.exists("_shape", misshaped) | F.exists("payloads", wrong_payload) | lost, F.lit("Invalid JSON body"))
        .when(F.exists("payloads", out_of_range), F.lit("Timestamp out of range"))
    )
    return parsed.withColumn("error", error).drop("_shape").withColumn(
        "payloads", F.when(F.col("error").isNull(), F.col("payloads"))
    )


def rejected(decoded: DataFrame) -> DataFrame:
    """Batches to quarantine, with their reason."""
    return decoded.where(F.col("error").isNotNull()).drop("payloads")


def properties_json(properties: Column) -> Column:
    """User properties as JSON text, ``{}`` when absent or empty."""
    return F.when(F.size(properties) > 0, F.to_json(properties)).otherwise(F.lit("{}"))


def _payload_rows(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("error").isNull()).select("env_id", F.explode("payloads").alias("p"))


def _instant(epoch_ms: Column) -> Column:
    return F.timestamp_millis(F.coalesce(epoch_ms.try_cast("bigint"), F.lit(0).cast("bigint")))


def flag_evaluations(decoded: DataFrame) -> DataFrame:
    """One row per variation of each accepted payload, with write-time defaults."""
    blank = F.lit("")
    user = F.coalesce(F.col("p.user.keyId"), blank)
    rows = _payload_rows(decoded).select(
        "env_id", user.alias("user_key"), properties_json(F.col("p.user.properties")).alias("user_properties"),
        F.explode("p.variations").alias("v"),
    )
    flag = F.coalesce(F.col("v.flagKey"), blank)
    return rows.select(
        "env_id",
        flag.alias("flag_key"),
        "user_key",
        F.coalesce(F.col("v.variant"), blank).alias("variant"),
        F.col("v.experimentId").alias("experiment_id"),
        F.col("v.layerId").alias("layer_id"),
        hash_bucket(F.col("user_key"), flag).alias("hash_bucket"),
        _instant(F.col("v.timestamp")).alias("timestamp"),
        "user_properties",
    ).select(*FLAG_EVALUATIONS.names)


def metric_events(decoded: DataFrame) -> DataFrame:
    """One row per metric of each accepted payload, with write-time defaults."""
    blank = F.lit("")
    rows = _payload_rows(decoded).select(
        "env_id",
        F.coalesce(F.col("p.user.keyId"), blank).alias("user_key"),
        properties_json(F.col("p.user.properties")).alias("user_properties"),
        F.explode("p.metrics").alias("m"),
    )
    return rows.select(
        "env_id",
        F.coalesce(F.col("m.eventName"), blank).alias("event_name"),
        "user_key",
        F.col("m.numericValue").try_cast("double").alias("numeric_value"),
        _instant(F.col("m.timestamp")).alias("timestamp"),
        "user_properties",
    ).select(*METRIC_EVENTS.names)


def ingest_counts(decoded: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accepted and dropped rows per batch: (payloads, evaluations, events, accepted, rejected)."""
    keys = keys or ["batch_id"]

    def total(field: str) -> Column:
        return F.aggregate(
            F.coalesce(F.col("payloads"), F.array().cast(PAYLOAD)),
            F.lit(0),
            lambda acc, p: acc + F.greatest(F.coalesce(F.size(p[field]), F.lit(0)), F.lit(0)),
        )

    counted = decoded.select(
        *keys,
        F.greatest(F.coalesce(F.size("payloads"), F.lit(0)), F.lit(0)).alias("payloads"),
        total("variations").alias("evaluations"),
        total("metrics").alias("events"),
        F.col("error").isNotNull().cast("int").alias("rejected"),
    )
    sums = counted.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("payloads", "evaluations", "events", "rejected")]
    )
    return sums.withColumn("accepted", F.col("evaluations") + F.col("events"))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows on the way to a sink, without another pass."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation
