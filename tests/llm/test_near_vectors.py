import numpy as np

from liftwise.llm.near_vectors import near_vector_components
from tests.llm.brute import Union


def brute(rows, least=0.93):
    """rows: (id, vector, label); n_links and component of each."""
    union, links, sound = Union(len(rows)), [0] * len(rows), {}
    for i, (_, v, label) in enumerate(rows):
        x = np.array([np.nan if c is None else c for c in v or []], float)
        if label is not None and len(x) and np.isfinite(x).all() and x.any():
            sound.setdefault((label, len(x)), []).append((i, x / np.linalg.norm(x)))
    for members in sound.values():
        ids, m = [i for i, _ in members], np.array([x for _, x in members])
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= least, 1))):
            union.join(ids[a], ids[b])
            links[ids[a]] += 1
            links[ids[b]] += 1
    low = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            low[union.root(i)] = min(k, low.get(union.root(i), k))
    return [(k, links[i], low.get(union.root(i), k)) for i, (k, _, _) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rid int")


def clusters(seed, n, dim, noise):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 6)):
            v = base + noise * rng.standard_normal(dim)
            rows.append((len(rows), v.astype(np.float32).tolist(), int(i % 3)))
    return rows


def test_recall_at_the_threshold(spark):
    rows = clusters(3, 400, 64, 0.26)  # cosines of a cluster lie around 0.93
    want = brute(rows)
    got = {r.vec_id: r for r in near_vector_components(frame(spark, rows)).collect()}
    total, found = sum(n for _, n, _ in want), sum(r.n_links for r in got.values())
    assert len(got) == len(rows) and total > 300 and all(got[k].n_links <= n for k, n, _ in want)
    print('recall', found / total)
    assert found >= 0.97 * total


def test_close_copies_and_odd_rows(spark):
    rows = clusters(4, 60, 48, 0.05)
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(40)] + [(900 + i, [2 * x for x in rows[0][1]], 1) for i in range(2)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 48, 1), (1003, [float("nan")] * 48, 1), (1004, [None] * 48, 1), (1005, [float("inf")] + [1.0] * 47, 1)]
    rows += [(None, rows[0][1], 0), (1006, rows[0][1], None), (1007, [1.0], 0), (1008, [2.0], 0), (1009, [1e-30] * 48, 2), (1010, [1e30] * 48, 2), (1011, [1.0, 0.0], 0), (1011, [1.0, 0.1], 0), (1012, [-0.0, 1.0], 0), (1013, [0.0, 1.0], 0)]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in near_vector_components(frame(spark, rows)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    kept = near_vector_components(frame(spark, rows)).where("kept").count()
    assert kept == sum(k == c for k, _, c in brute(rows) if k is not None)
    assert near_vector_components(frame(spark, rows).limit(0)).count() == 0


def test_given_vectors(spark):
    for sf in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vector_components(df).collect())
        want = sorted(brute(rows))
        assert len(got) == len(want) and sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
