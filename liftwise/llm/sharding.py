"""Placement of keys on shards through a permutation-filled lookup table. Built-in column functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime number of slots. A shard's share differs from an even one by about shards / TABLE_SIZE.
TABLE_SIZE = 65_537


def _number(*parts: str) -> int:
    return int.from_bytes(hashlib.md5("\u0001".join(parts).encode()).digest()[:8], "big")


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Owner (place in ``shards``) of every slot.

    Each shard prefers the slots offset, offset + skip, ... modulo the prime
    size, both from its name's hash. In turns, each claims the first slot of
    its order that is free. Equal shares, and a lost shard moves few other keys.
    """
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime")
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and at most one a slot")
    at = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    owner, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def lookup_table(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard): one row per slot, so its size is the parameter ``size``, whatever the keys."""
    owners = F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",")
    names = F.transform(F.split(F.lit(",".join(s.encode().hex() for s in shards)), ","), lambda h: F.decode(F.unhex(h), "utf-8"))
    rows = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def place(docs: DataFrame, key_col: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """One row per input row: the key, slot and shard.

    The slot is the key's 64-bit hash modulo the table size and the shard its
    owner; the table is broadcast, so rows are placed where they are, without a
    shuffle, and a hot key costs no more than others. A null key hashes as the
    text ``null``. Equal keys share a shard; repeated rows stay repeated. An
    empty table gives an empty table.
    """
    slot = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long"), F.lit(size))
    placed = docs.select(F.col(key_col), slot.alias("slot"))
    return placed.join(F.broadcast(lookup_table(docs.sparkSession, shards, size)), "slot").select(key_col, "slot", "shard")


def write_shards(docs: DataFrame, path: str, key_col: str, shards: list[str], size: int = TABLE_SIZE, rows_per_file: int = 1_000_000) -> None:
    """Write the rows below ``path``, one folder per shard, rows without a shuffle in files of at most ``rows_per_file``."""
    table = lookup_table(docs.sparkSession, shards, size).withColumnsRenamed({"slot": "_slot", "shard": "_shard"})
    slot = F.pmod(F.conv(F.substring(F.md5(F.coalesce(docs[key_col].cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long"), F.lit(size))
    placed = docs.join(F.broadcast(table), slot == table["_slot"]).drop("_slot")
    placed.write.partitionBy("_shard").option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)
