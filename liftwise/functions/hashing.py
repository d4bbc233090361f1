"""Deterministic hashes used for traffic buckets and user ordering."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash32(text: Column) -> Column:
    """31-polynomial over UTF-16 code units, modulo 2^32, as a long."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit(".{4}"), F.lit(0))
    return F.aggregate(
        units,
        F.lit(0).cast("bigint"),
        lambda acc, unit: (acc * 31 + F.conv(unit, 16, 10).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF)),
    )


def hash_bucket(user_key: Column, flag_key: Column) -> Column:
    """Bucket 0-99 of a (user, flag) pair."""
    return (text_hash32(F.concat(user_key, F.lit(":"), flag_key)) % 100).cast("smallint")


def user_order_hash(user_key: Column) -> Column:
    """Uniform 32-digit hex key that fixes an order of users in any engine."""
    return F.md5(user_key)
