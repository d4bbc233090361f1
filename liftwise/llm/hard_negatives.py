"""Hard-negative mining: exact integer scores from subset-sum tables of the anchors, indexed by the candidates' bit planes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftwise.session import materialize

#: Candidates and anchors of one block of scores, about; both bound what one task holds.
CANDIDATES = 8192
ANCHORS = 512
#: Integer vectors longer than this take no part, as a hundred times a score must fit a long.
LONGEST = 2.0**28


def _planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of integer vectors in two's complement: [row, plane, group of eight dimensions] as bytes; the last plane is the sign."""
    extent = np.where(values < 0, ~values, values)
    bits = int(extent.max(initial=0)).bit_length() + 1
    planes = (values[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(planes.astype(np.uint8), axis=2, bitorder="little")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, values) to (rid, planes, packed)."""
    for batch in batches:
        lists = batch.column("values")
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sizes = np.diff(ends)
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            for a in range(0, len(which), 1024):
                part = which[a : a + 1024]
                planes = _planes(flat[ends[part][:, None] + np.arange(size)])
                packed = pa.array([row.tobytes() for row in planes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(part)), pa.array(np.full(len(part), planes.shape[1], np.int32)), packed], ["rid", "n_planes", "packed"])


def subset_sums(anchor: np.ndarray) -> np.ndarray:
    """[group, byte]: sums of the anchor's components that a byte's bits pick, for every eight dimensions."""
    groups = -(-len(anchor) // 8)
    parts = np.zeros(groups * 8, np.int64)
    parts[: len(anchor)] = anchor
    parts = parts.reshape(groups, 8)
    table = np.zeros((groups, 256), np.int64)
    for bit in range(8):
        table[:, 1 << bit : 2 << bit] = table[:, : 1 << bit] + parts[:, bit : bit + 1]
    return table


class _Candidates:
    """A block's candidates, sorted by label; planes as [plane, group, row] with every row extended to the block's planes."""

    def __init__(self, rows: pa.Table):
        self.label = rows.column("label").to_numpy()
        order = np.argsort(self.label, kind="stable")
        self.label, self.rid = self.label[order], rows.column("rid").to_numpy()[order]
        ids = rows.column("id")
        self.no_id = ids.is_null().to_numpy()[order].astype(np.int64)
        self.id = ids.fill_null(0).to_numpy()[order]
        counts, packed = rows.column("n_planes").to_numpy()[order], rows.column("packed").to_pylist()
        bits = int(counts.max())
        groups = len(packed[0]) // int(rows.column("n_planes")[0].as_py())
        held = np.zeros((bits, groups, len(order)), np.uint8)
        for n in np.unique(counts):
            which = np.flatnonzero(counts == n)
            part = np.frombuffer(b"".join(packed[i] for i in order[which]), np.uint8).reshape(len(which), n, groups).transpose(1, 2, 0)
            held[:n, :, which] = part
            held[n:, :, which] = part[n - 1 :]
        self.planes = held

    def scores(self, table: np.ndarray, rows: slice) -> np.ndarray:
        """Inner products: for each plane the sum of looked-up subset sums, shifted and added, the sign plane taken off."""
        planes = self.planes[:, :, rows]
        total = np.zeros(planes.shape[2], np.int64)
        for k in range(len(planes) - 1, -1, -1):
            total <<= 1
            for g in range(len(table)):
                if k == len(planes) - 1:
                    total -= table[g].take(planes[k, g])
                else:
                    total += table[g].take(planes[k, g])
        return total

    def label_rows(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]))

    def best(self, rows: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """Places in ``rows`` of the n best scores, ties by smaller id, no id last."""
        if len(rows) > n:
            keep = np.flatnonzero(scores >= np.partition(scores, len(rows) - n)[len(rows) - n])
            rows, scores = rows[keep], scores[keep]
        else:
            keep = np.arange(len(rows))
        return keep[np.lexsort((self.id[rows], self.no_id[rows], -scores))[:n]]


def _scored(pick: Callable, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Run ``pick`` for every anchor of a block against the block's candidates; it returns columns of rows."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        if not anchors.num_rows or not candidates.num_rows:
            return schema.empty_table()
        held = _Candidates(candidates)
        parts = [pick(a, held, subset_sums(np.array(a["values"], np.int64))) for a in anchors.to_pylist()]
        return pa.Table.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*parts), schema)], schema=schema)

    return run


def _positives(n: int) -> Callable:
    def pick(anchor: dict, held: _Candidates, table: np.ndarray) -> tuple:
        rows = held.label_rows(anchor["label"])
        own = np.arange(rows.start, rows.stop)
        scores = held.scores(table, rows)
        other = held.rid[own] != anchor["rid"]
        own, scores = own[other], scores[other]
        best = held.best(own, scores, n)
        at = own[best]
        return np.full(len(at), anchor["rid"]), held.rid[at], held.no_id[at] > 0, held.id[at], scores[best]

    return pick


def _negatives(n: int, low: int, high: int) -> Callable:
    def pick(anchor: dict, held: _Candidates, table: np.ndarray) -> tuple:
        same = held.label_rows(anchor["label"])
        rows = np.concatenate((np.arange(same.start), np.arange(same.stop, len(held.label))))
        scores = np.concatenate((held.scores(table, slice(0, same.start)), held.scores(table, slice(same.stop, None))))
        out = []
        for p in anchor["positives"]:
            # Integers throughout: low * positive <= 100 * score <= high * positive.
            within = np.flatnonzero((100 * scores >= low * p["score"]) & (100 * scores <= high * p["score"]))
            best = within[held.best(rows[within], scores[within], n)]
            at = rows[best]
            out.append((np.full(len(at), anchor["rid"]), np.full(len(at), p["place"]), held.rid[at], held.no_id[at] > 0, held.id[at], scores[best]))
        return tuple(np.concatenate(c) for c in zip(*out))

    return pick


def _ranked(found: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n best of each group, numbered from 1. A group has at most n rows of every block of candidates."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "no_id", "id", "other")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, candidates: int = CANDIDATES, anchors: int = ANCHORS,
) -> DataFrame:
    """For each anchor and each of its best positives, the best-scoring rows of other labels within a band of the positive's score.

    Components become floor(scale * x), and a score is the exact integer inner
    product with the anchor. Higher scores come first, ties by smaller id, rows
    without an id last. Positives are an anchor's first ``positives`` other rows
    of its label; for each, the first ``negatives`` rows of other labels are
    returned whose score is ``low`` to ``high`` percent of the positive's, both
    included. ``is_anchor`` is a condition over the columns of ``vectors``.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score. Rows with a null label, a null vector, or a null or
    non-finite component take no part; nor do those whose integer vector is
    longer than 2^28, so that no sum can leave a long. Vectors of different
    length don't meet. Repeated rows are separate rows. Labels are integers.

    Anchors meet all candidates in blocks: hashed blocks of about ``candidates``
    rows by ``anchors`` rows, whatever the labels, so a hot label is spread.
    Every block returns its best few per anchor, from which the best are taken.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.col(f"`{label_col}`").isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    parts = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(LONGEST * 4)), F.lit(-LONGEST * 4))))
    length = F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), parts.alias("values"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")
    )
    rows = rows.where((length <= LONGEST**2) & (F.size("values") > 0)).withColumns({"rid": F.monotonically_increasing_id(), "dim": F.size("values")})
    rows = materialize(rows, "negatives-rows")

    sizes = rows.groupBy("dim").agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / candidates)).cast("int").alias("n_right"), F.ceil(F.count_if("anchor") / anchors).cast("int").alias("n_left")
    ).where("n_left > 0")
    packed = rows.select("rid", "values").mapInArrow(_packed, "rid long, n_planes int, packed binary").join(rows.select("rid", "id", "label", "dim"), "rid")
    right = packed.join(sizes, "dim").withColumn("right", F.pmod(F.xxhash64("rid"), "n_right"))
    right = materialize(right, "negatives-planes").withColumn("left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_left").cast("long") - 1)))
    right = right.select("dim", "left", "right", "rid", "id", "label", "n_planes", "packed")
    spread = rows.where("anchor").join(sizes, "dim").withColumn("left", F.pmod(F.xxhash64("rid"), "n_left"))
    spread = spread.withColumn("right", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_right").cast("long") - 1))).select("dim", "left", "right", "rid", "label", "values")

    def blocks(left: DataFrame, pick: Callable, columns: dict[str, pa.DataType], ddl: str) -> DataFrame:
        key = ["dim", "left", "right"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_scored(pick, pa.schema(list(columns.items()))), ddl)

    long, flag = pa.int64(), pa.bool_()
    found = blocks(spread, _positives(positives), {"rid": long, "other": long, "no_id": flag, "id": long, "score": long}, "rid long, other long, no_id boolean, id long, score long")
    best = materialize(_ranked(found, ["rid"], positives).withColumn("id", F.when(~F.col("no_id"), F.col("id"))), "negatives-positives")

    lists = best.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("positives"))
    found = blocks(
        spread.join(lists, "rid"), _negatives(negatives, low, high), {"rid": long, "positive": pa.int32(), "other": long, "no_id": flag, "id": long, "score": long},
        "rid long, positive int, other long, no_id boolean, id long, score long",
    )
    ranked = _ranked(found, ["rid", "positive"], negatives).select("rid", "positive", "place", F.when(~F.col("no_id"), F.col("id")).alias("negative_id"), "score")
    named = best.select("rid", F.col("place").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    own = rows.where("anchor").select("rid", F.col("id").alias("anchor_id"))
    return ranked.join(named, ["rid", "positive"]).join(own, "rid").select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score")
    )
