"""Hard negatives against plain inner products."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from liftwise.llm.hard_negatives import _Candidates, _packed, mine_hard_negatives, subset_sums


def brute(rows, anchor, positives=5, negatives=10):
    held = []
    for key, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector) or not vector:
            continue
        parts = [math.floor(256 * x) for x in vector]
        if sum(x * x for x in parts) <= 2**56:
            held.append((key, parts, label))
    out = []
    for i, (key, a, label) in enumerate(held):
        if not anchor(key):
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), k is None, k, lb) for j, (k, b, lb) in enumerate(held) if j != i and len(a) == len(b)]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        for p in [s for s in scored if s[3] == label][:positives]:
            within = [s for s in scored if s[3] != label and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:negatives]
            out += [(key, p[2], r, s[2], -p[0], -s[0]) for r, s in enumerate(within, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **options):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"rid": F.lit(1), "score": F.lit("x"), "id": F.lit(2)})
    got = mine_hard_negatives(vectors, F.col("vec_id") % 10 == 0, **options)
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_blocks_agree_with_inner_products(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        centre = rng.standard_normal(11) * (i % 5 == 0) + 0.4
        rows.append((i, [float(x) for x in centre + rng.standard_normal(11) * 0.2], int(rng.integers(0, 3))))
    rows += [(i, [0.5] * 11, 1 + i % 2) for i in range(300, 340)]  # ties
    rows += rows[:15] + [(20, None, 1), (30, [0.1] * 11, None), (40, [float("nan")] * 11, 1), (50, [None] * 11, 1), (None, [0.5] * 11, 1), (None, [0.6] * 11, 2)]
    rows += [(60, [1e300] * 11, 1), (70, [0.2] * 3, 1), (71, [0.21] * 3, 1), (72, [0.15] * 3, 2), (80, [], 1), (90, [float("inf")] * 11, 2), (100, [-30.0] * 11, 1), (110, [0.0] * 11, 2)]
    rng = random.Random(1)
    rng.shuffle(rows)
    want = brute(rows, lambda k: k is not None and k % 10 == 0)
    assert len(want) > 1000
    assert mined(spark, rows) == want
    assert mined(spark, rows, candidates=40, anchors=7) == want


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(10, [1.0], 1)]) == []


def test_table_scores_are_exact():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    for bits in (1, 4, 10, 27):
        values = rng.integers(-(2**bits), 2**bits, (50, 19))
        batch = pa.record_batch({"rid": pa.array(range(50), pa.int64()), "values": pa.array(values.tolist(), pa.list_(pa.int64()))})
        packed = pa.Table.from_batches(list(_packed(iter([batch]))))
        block = packed.append_column("id", packed["rid"]).append_column("label", pa.array([i % 3 for i in range(50)], pa.int64()))
        held = _Candidates(block)
        for a in values[:5]:
            assert (held.scores(subset_sums(a), slice(None)) == values[held.rid] @ a).all()
