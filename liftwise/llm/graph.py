"""Connected components of a link table, by alternating star contractions.

Every round is a few aggregates and joins over the links; hubs are aggregated
map-side and their joins are split by adaptive execution. Rounds are written
as tables in the shared scratch folder, so a lost executor costs one round; a
round's table goes when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftwise.session import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): for every linked node that is not the smallest of its component, that smallest node.

    Nodes missing from the result are components' smallest nodes or unlinked.
    Links with a null end, loops and repeated links change nothing.
    """
    u, v = F.col(left), F.col(right)
    edges = links.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).distinct()
    edges = materialize(edges, "components")
    state = _state(edges)
    while state[0]:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, materialize(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "components")
        discard(before)
        last, state = state, _state(edges)
        if state == last:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
