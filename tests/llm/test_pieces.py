import collections
import math

import numpy as np
import pytest

from liftwise.llm.pieces import Vocabulary, _Trie, decode_pieces, encode_pieces, load_vocabulary
from liftwise.llm.queries import piece_model

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(piece_model())


def test_round_trip_and_reproducibility(spark, vocabulary):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    coded = encode_pieces(docs, vocabulary, ["doc_id", "text"])
    texts = dict(zip(vocabulary.ids, vocabulary.texts)) | {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
    first = {r.doc_id: r for r in coded.collect()}
    assert len(first) == docs.count()
    for r in first.values():
        assert b"".join(texts[i] for i in r.pieces).decode() == r.text and r.n_pieces == len(r.pieces)
    again = {r.doc_id: r.pieces for r in encode_pieces(docs.repartition(7), vocabulary, ["doc_id"]).collect()}
    assert again == {k: r.pieces for k, r in first.items()}
    other = {r.doc_id: r.pieces for r in encode_pieces(docs, vocabulary, ["doc_id"], seed=2).collect()}
    assert sum(other[k] != again[k] for k in again) > 0.9 * len(again)
    assert all(r.decoded == r.text for r in decode_pieces(coded, vocabulary, ["text"]).collect())


def test_draws_follow_the_lattice(spark):
    texts = [b" ", b"a", b"b", b"ab", b"ba", b" a", b"aba"]
    weights = [-1.0, -2.0, -1.5, -1.2, -2.2, -0.7, -3.0]
    vocabulary = Vocabulary(list(range(7)), texts, weights, list(range(100, 356)))

    def ways(s, at=0):
        if at == len(s):
            yield (), 0.0
        for i, t in enumerate(texts):
            if s.startswith(t, at):
                for rest, w in ways(s, at + len(t)):
                    yield (i, *rest), w + weights[i]

    mass = {k: math.exp(w) for k, w in ways(b" abab")}
    total, n = sum(mass.values()), 20_000
    docs = spark.range(n).selectExpr("id AS doc_id", "' abab' AS text")
    seen = collections.Counter(tuple(r.pieces) for r in encode_pieces(docs, vocabulary, []).collect())
    assert set(seen) == set(mass)
    for k, m in mass.items():
        p = m / total
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p / n)


def test_edge_rows(spark, vocabulary):
    texts = [None, "", "▁ literal mark ▁▁", "漢字 \U0001f600 \t\r\n\n end ", "   three blanks", "a" * 50_000 + " " * 300, "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, seed int, extra string")
    coded = encode_pieces(docs, vocabulary, ["doc_id", "text", "seed", "extra"])
    assert all(r.decoded == (r.text or "") for r in decode_pieces(coded, vocabulary, ["text"]).collect())
    assert {r.text: r.n_pieces for r in coded.collect()}[None] == 0
    assert encode_pieces(docs.limit(0), vocabulary, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        encode_pieces(coded, vocabulary, ["pieces"])


def test_a_task_holds_little_beside_its_block(spark, vocabulary):
    """The trie takes a few MB, not a row of all bytes per node, and leads where the pieces say; a kept text goes to the task once."""
    trie = _Trie(vocabulary)
    assert sum(x.nbytes for x in vars(trie).values() if isinstance(x, np.ndarray)) < 8_000_000
    prefixes = {t[:k] for t in vocabulary.texts for k in range(1, len(t) + 1)}
    for piece, text in list(enumerate(vocabulary.texts))[::97]:
        node = np.zeros(1, np.int32)
        for k, byte in enumerate(text):
            on, children = trie.children(np.repeat(node, 256), np.arange(256).astype(np.uint8))
            assert set(on) == {b for b in range(256) if text[:k] + bytes([b]) in prefixes}
            node = children[on == byte]
        assert trie.piece[node[0]] == piece
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    plans = {k: encode_pieces(docs, vocabulary, keep)._jdf.queryExecution().optimizedPlan().toString() for k, keep in (("kept", ["doc_id", "text"]), ("only read", ["doc_id"]))}
    assert "AS _text" not in plans["kept"] and "AS _text" in plans["only read"]
