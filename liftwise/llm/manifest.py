"""Merkle manifest of a dataset: levels stored as parent-linked node rows, proofs by a recursive query that climbs them."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftwise.session import materialize

#: Levels of the tree between two stored node rows; a row holds the siblings met on the way to the next one.
#: Nine keep the stored nodes above the leaves to a 512th of the rows, which a join can mostly broadcast.
STRIDE = 9
#: Tree whose leaves are the roots of all groups' trees. Groups have the keys of ``_tree``, which sort after it.
TOP = "*"
#: A sibling is packed as one byte, 0 left, 1 right, 2 for a node that stands alone, and 32 bytes of hash.
ENTRY = 33
#: Up to so many stored nodes, of some 400 bytes each, are broadcast to the climbing rows; beyond, both sides are shuffled.
BROADCAST_NODES = 100_000


def encoded(columns: Sequence[Column]) -> Column:
    """Each column as '-' if null, else its text's UTF-8 byte count, ':' and the text."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns])


def leaf(columns: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(encoded(columns).cast("binary"), 256))


_ENTRIES = f"slice(sequence(0, octet_length({{0}}) div {ENTRY}), 1, cast(octet_length({{0}}) div {ENTRY} as int))"
#: How a hash changes on its way up past packed siblings.
FOLD = f"""aggregate({_ENTRIES.format("{siblings}")}, {{start}}, (now, k) -> unhex(sha2(CASE substring({{siblings}}, {ENTRY} * k + 1, 1)
  WHEN X'02' THEN lower(hex(now)) WHEN X'00' THEN concat(lower(hex(substring({{siblings}}, {ENTRY} * k + 2, 32))), lower(hex(now)))
  ELSE concat(lower(hex(now)), lower(hex(substring({{siblings}}, {ENTRY} * k + 2, 32)))) END, 256)))"""


def fold(start: str, siblings: str) -> Column:
    return F.expr(FOLD.format(start=start, siblings=siblings))


def _unpacked(siblings: str) -> Column:
    entry = f"substring({siblings}, {ENTRY} * k + 1, {ENTRY})"
    hash_ = f"CASE WHEN substring({entry}, 1, 1) = X'02' THEN NULL ELSE substring({entry}, 2, 32) END"
    return F.expr(f"transform({_ENTRIES.format(siblings)}, k -> named_struct('on_left', substring({entry}, 1, 1) = X'00', 'hash', {hash_}))")


def _tree(group: Column) -> Column:
    """Key of a group's tree; null comes first, then texts in the order of their bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add idx, the place from 0 of each row in its tree by ``order``, and n, the tree's rows.

    Rows are cut into ranges and sorted there, so a large tree spreads over
    many tasks. Places inside a range follow from the row's number in its task;
    what lies before it is added from one row per (range, tree), of which there
    are no more than ranges and trees together.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "manifest-order")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    spans = ranged.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    lists = spans.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("_part", "_first", "_rows"))).alias("s"), F.sum("_rows").alias("n"))
    # Running sums over a tree's ranges: at most as many as there are shuffle partitions.
    sums = F.transform("s", lambda x, i: F.struct(
        x["_part"].alias("_part"), x["_first"].alias("_first"),
        F.aggregate(F.slice("s", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["_rows"]).alias("_before")))
    starts = lists.select("tree", "n", F.inline(sums))
    placed = ranged.join(starts, ["tree", "_part"])
    return placed.withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _height(n: Column) -> Column:
    """Levels above n nodes: pairs join until one node remains."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _linked(rows: DataFrame, stride: int) -> DataFrame:
    """Lead every row of (tree, idx, hash, n, kept) up by ``stride`` levels, or to its tree's root if that is nearer.

    Adds the row's siblings on the way and ``block``, the place of the node it
    comes to. Rows that come to one node are a group of 2 to the power
    ``stride`` at most, whatever the tree.
    """
    inside = F.sort_array(F.collect_list(F.struct("idx", "hash", "kept")))
    block = rows.groupBy("tree", F.shiftright("idx", stride).alias("block"), "n").agg(inside.alias("rows"))
    block = block.withColumn("up", F.least(F.lit(stride), _height(F.col("n"))))
    steps = f"slice(sequence(0, {stride - 1}), 1, up)"
    pair = "unhex(sha2(concat(lower(hex(get(l, 2 * i))), coalesce(lower(hex(get(l, 2 * i + 1))), '')), 256))"
    raised = f"transform(sequence(0, cast((size(l) - 1) div 2 as int)), i -> {pair})"
    # The levels of a block, each from the one below; the last level is bound to l.
    levels = f"aggregate({steps}, array(rows.hash), (done, k) -> concat(done, transform(array(element_at(done, -1)), l -> {raised})))"
    led = block.withColumn("levels", F.expr(levels)).select("tree", "n", "block", "up", "levels", F.posexplode("rows").alias("place", "row"))
    beside = "concat(CASE WHEN shiftright(place, k) % 2 = 1 THEN X'00' ELSE X'01' END, get(get(levels, k), shiftright(place, k) ^ 1))"
    alone = f"X'02{'00' * 32}'"
    siblings = f"aggregate({steps}, X'', (done, k) -> concat(done, coalesce({beside}, {alone})))"
    return led.select("tree", "n", "block", "row.*", F.expr(siblings).alias("siblings"))


def _node(tree: Column, rung: Column, idx: Column) -> Column:
    """Key of a stored node: its tree, how many strides above the leaves, its place there."""
    return F.struct(tree.alias("tree"), rung.cast("int").alias("rung"), idx.cast("long").alias("idx"))


def _root_node(tree: Column) -> Column:
    """Key of a group's root as a leaf of the top tree."""
    return _node(tree, F.lit(-1), F.lit(0))


def _rungs(rows: DataFrame, beyond: Column, stride: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Store all trees of (tree, idx, hash, n, kept).

    Returns the lowest rung with ``kept``, the rungs above it as node rows, and
    the root hash of every tree. Each row has its siblings up to its stored
    ancestor and that ancestor's key, ``beyond`` for a tree's root. There is one
    round for every ``stride`` levels of the highest tree.
    """
    width = 2**stride
    lowest, above, roots, rung, largest = None, [], None, 0, None
    while True:
        links = materialize(_linked(rows, stride), "manifest-rung")
        largest = links.agg(F.max("n")).first()[0] or 0 if largest is None else -(-largest // width)
        last = F.col("n") <= width
        parent = F.when(last, beyond).otherwise(_node(F.col("tree"), F.lit(rung + 1), F.col("block")))
        if lowest is None:
            lowest = links.select("kept", "tree", "hash", "siblings", parent.alias("parent"))
        else:
            above.append(links.select("tree", _node(F.col("tree"), F.lit(rung), F.col("idx")).alias("node"), "hash", "siblings", parent.alias("parent")))
        # The first of the rows that come to a node leads to its hash.
        heads = links.where(F.col("idx") % width == 0)
        heads = heads.select("tree", F.col("block").alias("idx"), fold("hash", "siblings").alias("hash"), "n", F.lit(None).cast("boolean").alias("kept"))
        ended = heads.where(last).select("tree", "hash")
        roots = ended if roots is None else roots.unionAll(ended)
        if largest <= width:
            return lowest, above, roots
        rows, rung = heads.where(~last).withColumn("n", F.ceil(F.col("n") / width).cast("long")), rung + 1


def _led_over(rows: DataFrame, over: DataFrame) -> DataFrame:
    """Lead the rows that come to their group's root on to the root of all."""
    at_root = F.col("parent.rung") == -1
    found = rows.join(over, "tree", "left").withColumns({"subroot": F.when(at_root, F.col("_root")), "siblings": F.when(at_root, F.concat("siblings", "_over")).otherwise(F.col("siblings"))})
    return found.withColumn("parent", F.when(~at_root, F.col("parent"))).drop("_root", "_over")


_NODES = "node struct<tree:string,rung:int,idx:long>, hash binary, siblings binary, parent struct<tree:string,rung:int,idx:long>, subroot binary"


@dataclass
class Manifest:
    """A stored manifest.

    ``leaves`` has one row per dataset row: ``kept`` (the columns that were
    asked for), its tree, leaf hash, siblings up to its first stored ancestor,
    and that ancestor's key. ``nodes`` are the stored ancestors of all levels,
    (node, hash, siblings, parent). A parent that is null is the root of all. A
    row whose way leads past the root of its group has that as ``subroot``.
    ``subroots`` has (tree, hash) of every group. ``root`` is the hash of all in
    lowercase hex, null for no rows.
    """

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None


def build_manifest(rows: DataFrame, hashed: Column, group: Column, order: Column, keep: dict[str, Column], stride: int = STRIDE) -> Manifest:
    """Build the trees of all groups, and the tree of their roots.

    ``hashed`` is a row's leaf, 32 bytes. In a group, leaves ascend by ``order``,
    null first, then by their hash, so rows that repeat an order value have a
    defined place. While several nodes remain, every two neighbours become the
    digest of their hex texts; a last one alone becomes the digest of its own.
    The groups' roots ascend by the group, null first, then bytewise, and join
    likewise. ``keep`` names columns to carry, of types that can be ordered.
    """
    spark = rows.sparkSession
    kept = F.struct(*[c.alias(name) for name, c in keep.items()])
    leaves = rows.select(_tree(group).alias("tree"), order.alias("by"), hashed.alias("hash"), kept.alias("kept"), F.monotonically_increasing_id().alias("rid"))
    leaves = _numbered(materialize(leaves, "manifest-leaves"), ["by", "hash", "rid"])
    lowest, nodes, subroots = _rungs(leaves.select("tree", "idx", "hash", "n", "kept"), _root_node(F.col("tree")), stride)
    subroots = materialize(subroots, "manifest-subroots")
    tops = _numbered(subroots.select(F.lit(TOP).alias("tree"), "hash", F.col("tree").alias("kept")), ["kept"])
    roots, above, root = _rungs(tops.select("tree", "idx", "hash", "n", "kept"), F.lit(None).cast("struct<tree:string,rung:int,idx:long>"), stride)
    if not above:
        # The groups' roots, 2 to the power ``stride`` at most, come to the root of all at once: their way is put on the rows below.
        over = F.broadcast(roots.select(F.col("kept").alias("tree"), F.col("hash").alias("_root"), F.col("siblings").alias("_over")))
        lowest, nodes = _led_over(lowest, over), [_led_over(x, over) for x in nodes]
    else:
        none = F.lit(None).cast("binary").alias("subroot")
        lowest, nodes = lowest.select("*", none), [x.select("*", none) for x in [*nodes, *above]]
        nodes.append(roots.select(F.lit(TOP).alias("tree"), _root_node(F.col("kept")).alias("node"), "hash", "siblings", "parent", F.col("hash").alias("subroot")))
    columns = ["node", "hash", "siblings", "parent", "subroot"]
    stored = spark.createDataFrame([], _NODES)
    for more in nodes:
        stored = stored.unionAll(more.select(*columns))
    only = root.select(F.lower(F.hex("hash"))).first()
    return Manifest(lowest, materialize(stored, "manifest-nodes"), subroots, only[0] if only else None)


CLIMB = f"""
WITH RECURSIVE climb(kept, leaf, subroot, folded, proof, parent) AS (
  SELECT kept, hash, subroot, {FOLD.format(start="began", siblings="siblings")}, siblings, parent FROM {{leaves}}
  UNION ALL
  SELECT {{hint}} c.kept, c.leaf, coalesce(c.subroot, n.subroot), {FOLD.format(start="c.folded", siblings="n.siblings")}, concat(c.proof, n.siblings), n.parent
  FROM climb c JOIN {{nodes}} n ON c.parent = n.node)
SELECT kept, leaf, subroot, folded, proof FROM climb WHERE parent IS NULL"""


@contextmanager
def _any_number_of_rows(spark: SparkSession):
    """Recursive queries stop at a million rows unless the session lifts that."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def climb(manifest: Manifest, began: str | None = None) -> DataFrame:
    """Climb from every leaf to the root by a recursive query over the node rows.

    Returns the kept columns and leaf, subroot, root, folded_root (lowercase
    hex), proof (siblings from the leaf's level up, each with its side; a null
    hash where a node stood alone) and verified, whether folded_root is the
    root. ``began`` names a kept column whose hash is folded instead of the
    leaf's own, where it is not null: the leaf as it is now, say, to find what
    was tampered with. It is not returned.

    A step climbs ``STRIDE`` levels, so the recursion has few steps. Spark
    moves all climbing rows once a step, with what they have gathered.
    """
    spark = manifest.leaves.sparkSession
    first = F.col("hash") if began is None else F.coalesce(F.col("kept")[began], F.col("hash"))
    names = [c for c in manifest.leaves.schema["kept"].dataType.names if c != began]
    leaves = manifest.leaves.withColumn("began", first).withColumn("kept", F.struct(*[F.col("kept")[c].alias(c) for c in names]))
    # Near the top all rows climb to the same few nodes, so a join on them that shuffles would gather the rows.
    few = manifest.nodes.count() <= BROADCAST_NODES
    with _any_number_of_rows(spark):
        climbed = spark.sql(CLIMB.replace("{hint}", "/*+ BROADCAST(n) */" if few else ""), leaves=leaves, nodes=manifest.nodes)
        # The recursion returns the tasks of all its steps; most hold no finished row.
        climbed = materialize(climbed.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))), "manifest-climb")
    digests = [F.lower(F.hex(c)) for c in ("leaf", "subroot", "folded")]
    root = F.lit(manifest.root)
    return climbed.select(
        "kept.*", digests[0].alias("leaf"), digests[1].alias("subroot"), root.alias("root"), _unpacked("proof").alias("proof"), digests[2].alias("folded_root"),
        (digests[2] == root).alias("verified"),
    )


def proof_digest(proof: str) -> Column:
    """Lowercase hex digest of a proof's sibling hashes in hex, in their order."""
    held = F.filter(proof, lambda s: s["hash"].isNotNull())
    return F.sha2(F.array_join(F.transform(held, lambda s: F.lower(F.hex(s["hash"]))), ""), 256)
