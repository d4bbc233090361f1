"""Fixed schemas and vocabularies of the data model."""

from pyspark.sql import types as T

METRIC_TYPES = ("binary", "continuous")
METRIC_AGGS = ("once", "count", "sum", "average")
RUN_STATUSES = ("draft", "collecting", "analyzing", "decided", "archived")
ACTIVE_STATUSES = ("draft", "collecting", "analyzing")
METHODS = ("bayesian_ab", "frequentist", "bandit")
DECISIONS = ("CONTINUE", "PAUSE", "ROLLBACK", "INCONCLUSIVE")
STAGES = ("hypothesis", "implementing", "measuring", "learning")
DATA_SOURCE_MODES = ("managed", "customer-single", "customer-per-metric", "manual", "external-text")
CUSTOMER_MODES = ("customer-single", "customer-per-metric")
GUARDRAIL_DIRECTIONS = ("increase_bad", "decrease_bad")
FILTER_OPS = ("eq", "neq", "in", "nin")

# Payload numbers are read as text first, so that a value of the wrong type
# can be told apart from an absent one.
PAYLOAD = T.ArrayType(
    T.StructType()
    .add(
        "user",
        T.StructType()
        .add("keyId", T.StringType())
        .add("properties", T.MapType(T.StringType(), T.StringType())),
    )
    .add(
        "variations",
        T.ArrayType(
            T.StructType()
            .add("flagKey", T.StringType())
            .add("variant", T.StringType())
            .add("timestamp", T.StringType())
            .add("experimentId", T.StringType())
            .add("layerId", T.StringType())
        ),
    )
    .add(
        "metrics",
        T.ArrayType(
            T.StructType()
            .add("eventName", T.StringType())
            .add("timestamp", T.StringType())
            .add("numericValue", T.StringType())
            .add("type", T.StringType())
        ),
    )
)

FLAG_EVALUATIONS = (
    T.StructType()
    .add("env_id", T.StringType())
    .add("flag_key", T.StringType())
    .add("user_key", T.StringType())
    .add("variant", T.StringType())
    .add("experiment_id", T.StringType())
    .add("layer_id", T.StringType())
    .add("hash_bucket", T.ShortType())
    .add("timestamp", T.TimestampType())
    .add("user_properties", T.StringType())
)

METRIC_EVENTS = (
    T.StructType()
    .add("env_id", T.StringType())
    .add("event_name", T.StringType())
    .add("user_key", T.StringType())
    .add("numeric_value", T.DoubleType())
    .add("timestamp", T.TimestampType())
    .add("user_properties", T.StringType())
)

AUDIENCE_FILTERS = T.ArrayType(
    T.StructType()
    .add("property", T.StringType())
    .add("op", T.StringType())
    .add("value", T.StringType())
    .add("values", T.ArrayType(T.StringType()))
)

GUARDRAIL_ELEMENT = (
    T.StructType()
    .add("name", T.StringType())
    .add("event", T.StringType())
    .add("metricType", T.StringType())
    .add("metricAgg", T.StringType())
    .add("inverse", T.BooleanType())
    .add("direction", T.StringType())
)

METRIC_DEFINITION = (
    T.StructType()
    .add("name", T.StringType())
    .add("event", T.StringType())
    .add("metricType", T.StringType())
    .add("metricAgg", T.StringType())
    .add("inverse", T.BooleanType())
    .add("direction", T.StringType())
    .add("description", T.StringType())
)

# Long form of the sufficient statistics all analysis jobs start from.
STATS_COLUMNS = (
    "run_id",
    "metric_ord",
    "metric",
    "role",
    "metric_type",
    "metric_agg",
    "inverse",
    "variant",
    "n",
    "k",
    "sum",
    "sum_squares",
    "mean",
    "variance",
)
