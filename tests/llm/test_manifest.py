"""Merkle manifest against a plain restatement, with null, repeated and tampered rows."""

import hashlib
import random

from pyspark.sql import functions as F

from liftwise.llm.manifest import build_manifest, climb, leaf, proof_digest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def code(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    built = [nodes]
    while len(built[-1]) > 1:
        last = built[-1]
        built.append([H(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return built


def siblings(built, i):
    found = []
    for level in built[:-1]:
        other = i ^ 1
        found.append((other < i, level[other] if other < len(level) else None))
        i //= 2
    return found


def up(node, path):
    for left, other in path:
        node = H(node) if other is None else H(other, node) if left else H(node, other)
    return node


def brute(rows):
    """rows: (id, group, text, tampered text); returns (id, leaf, subroot, root, proof, folded, verified) per row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((H(code(row[0]), code(row[1]), code(row[2])), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        held = sorted(groups[g], key=lambda x: (x[1][0] is not None, x[1][0] or 0, bytes.fromhex(x[0])))
        trees[g] = (held, levels([x[0] for x in held]))
    top = levels([trees[g][1][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        held, built = trees[g]
        for i, (own, row) in enumerate(held):
            path = siblings(built, i) + siblings(top, k)
            proof = H(*(h for _, h in path if h is not None))
            folded = up(H(code(row[0]), code(row[1]), code(row[3])), path)
            out.append((row[0], own, built[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def spark_rows(spark, rows, stride):
    docs = spark.createDataFrame(rows, "id long, g string, text string, now string")
    columns = [F.col("id"), F.col("g"), F.col("text")]
    built = build_manifest(docs, leaf(columns), F.col("g"), F.col("id"), {"hash": F.col("id"), "now": leaf([*columns[:2], F.col("now")])}, stride)
    proved = climb(built, "now")
    return sorted((tuple(r) for r in proved.select("hash", "leaf", "subroot", "root", proof_digest("proof"), "folded_root", "verified").collect()), key=str)


def test_manifest(spark):
    rng = random.Random(2)
    rows = []
    for group, n in ((None, 3), ("", 1), ("b", 70), ("é", 64), ("z", 65), ("ab", 2), ("a", 300)):
        for _ in range(n):
            text = rng.choice((None, "", "twice", "ü" * rng.randrange(9), str(rng.random())))
            now = text if rng.random() < 0.8 else "changed"
            rows.append((rng.choice((None, rng.randrange(1000), 7)), group, text, now))
    rows += rows[:5]
    want = brute(rows)
    assert spark_rows(spark, rows, 6) == want
    assert spark_rows(spark, rows, 2) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_small_manifests(spark):
    assert spark_rows(spark, [], 6) == []
    for rows in ([(1, "a", "x", "x")], [(1, "a", "x", "y"), (2, None, None, None)], [(5, "a", "t", "t")] * 9):
        assert spark_rows(spark, rows, 6) == brute(rows)
