"""Near-duplicate vectors: spherical-cap filters from structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftwise.llm.graph import components
from liftwise.session import materialize

#: Code directions of each half of a vector; CODES squared filters. Filters that a random vector exceeds, on average.
CODES = 512
LISTED = 80
#: Filters that two vectors must share to be compared.
SHARED = 2


class ProductCode:
    """Filter directions of one dimension: a seeded rotation, then all sums of a code direction of each half."""

    def __init__(self, dim: int, codes: int, listed: float, seed: int = 5):
        rng = np.random.default_rng((seed, dim))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cut = (dim + 1) // 2
        codes = min(codes, 4**self.cut)
        self.halves = []
        for size in (self.cut, dim - self.cut):
            points = rng.standard_normal((codes if size else 1, size))
            self.halves.append(points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12))
        probes = rng.standard_normal((48, dim))
        one, two = self._scores(probes / np.linalg.norm(probes, axis=1, keepdims=True))
        total = (one.astype(np.float32)[:, :, None] + two.astype(np.float32)[:, None, :]).reshape(-1)
        listed = min(int(listed * len(probes)), len(total))
        total.partition(len(total) - listed)
        self.least = float(total[len(total) - listed])

    def _scores(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ self.rotation
        return turned[:, : self.cut] @ self.halves[0].T, turned[:, self.cut :] @ self.halves[1].T

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter whose cap holds a row's vector, and each row's best one in any case.

        First halves that even the best second half can't lift over the cap's
        edge are left out, so most sums are never formed.
        """
        one, two = self._scores(unit)
        row, i = np.nonzero(one + two.max(1, keepdims=True) >= self.least)
        hit, j = np.nonzero(one[row, i, None] + two[row] >= self.least)
        rows = np.concatenate((row[hit], np.arange(len(unit))))
        filters = np.concatenate((i[hit] * two.shape[1] + j, one.argmax(1) * two.shape[1] + two.argmax(1)))
        both = np.unique(np.stack((rows, filters), 1), axis=0)
        return both[:, 0], both[:, 1]


def _listed(codes: int, listed: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, ProductCode] = {}
        for batch in batches:
            lists = batch.column("vector")
            flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            dims = np.diff(offsets)
            for dim in np.unique(dims):
                which = np.flatnonzero(dims == dim)
                code = known.setdefault(int(dim), None) or ProductCode(int(dim), codes, listed)
                known[int(dim)] = code
                for a in range(0, len(which), 32):
                    part = which[a : a + 32]
                    row, cap = code.decode(_unit(flat[offsets[part][:, None] + np.arange(dim)]))
                    ids = pa.array(part[row])
                    yield pa.RecordBatch.from_arrays([batch.column("rid").take(ids), pa.array(cap)], ["rid", "cap"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _linked(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (batch.column(c) for c in ("one", "two"))
            dims = np.diff(one.offsets.to_numpy())
            a, b = one.flatten().to_numpy(), two.flatten().to_numpy()
            hits = np.zeros(batch.num_rows, bool)
            starts = np.cumsum(dims) - dims
            for dim in np.unique(dims):
                which = np.flatnonzero(dims == dim)
                at = starts[which][:, None] + np.arange(dim)
                hits[which] = (_unit(a[at]) * _unit(b[at])).sum(1) >= least
            yield batch.select(["left", "right"]).filter(pa.array(hits))

    return run


def near_vector_components(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, codes: int = CODES, listed: float = LISTED
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows of one label, not null, link when their cosine in double precision is
    ``least`` or more. Equal vectors of a label are one class. A class is listed
    under every filter whose cap holds it; classes that share ``SHARED`` filters
    are compared, and their links count the rows of both. Tests measure that
    more than 0.97 of pairs around the threshold are found; none below it is
    ever linked.

    n_links is the number of other rows linked directly, component_id the
    smallest id reachable, its own included, and kept tells whether it is the
    row's own. Vectors that are null, empty, zero, or hold null or non-finite
    numbers, and rows without a label, link with nothing. Null ids take part and
    name no component. Repeated rows are separate rows. Vectors of different
    length don't link.
    """
    vector = F.col(vector_col).cast("array<double>")
    sound = F.col(label_col).isNotNull() & F.coalesce(F.size(vector) > 0, F.lit(False))
    sound = sound & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0)))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(sound, F.col(label_col)).alias("label"), F.when(sound, F.transform(vector, lambda x: x + F.lit(0.0))).alias("vector"))
    rows = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(3), "vector"), "rid": F.monotonically_increasing_id()})
    rows = materialize(rows, "vectors")
    key = ["label", "h1", "h2"]
    classes = rows.where("label is not null").groupBy(key).agg(F.min("rid").alias("rid"), F.min("id").alias("least_id"), F.count("*").alias("n"))
    classes = materialize(classes, "vector-classes")
    reps = materialize(rows.select("rid", "label", "vector").join(classes.select("rid"), "rid", "left_semi"), "vector-classes")

    listing = reps.select("rid", "vector").mapInArrow(_listed(codes, listed), "rid long, cap long").join(classes.select("rid", "label"), "rid")
    listing = materialize(listing, "vector-caps")
    one, two = listing.withColumnRenamed("rid", "left"), listing.withColumnRenamed("rid", "right")
    pairs = one.join(two, ["label", "cap"]).where("left < right").groupBy("left", "right").count()
    pairs = pairs.where(F.col("count") >= SHARED).drop("count")
    known = reps.select("rid", "vector")
    pairs = pairs.join(known.toDF("left", "one"), "left").join(known.toDF("right", "two"), "right").where(F.size("one") == F.size("two"))
    links = materialize(pairs.select("left", "right", "one", "two").mapInArrow(_linked(least), "left long, right long"), "vector-links")

    sizes = classes.select("rid", "n")
    ways = links.select(F.col("left").alias("at"), F.col("right").alias("rid")).unionAll(links.select(F.col("right").alias("at"), F.col("left").alias("rid")))
    counts = ways.join(sizes, "rid").groupBy(F.col("at").alias("rid")).agg(F.sum("n").alias("others"))
    named = classes.join(components(links, "left", "right").withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    names = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = named.join(names, "component").join(counts, "rid", "left").select(*key, "component_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    component = F.coalesce("component_id", "id")
    return rows.join(found, key, "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
