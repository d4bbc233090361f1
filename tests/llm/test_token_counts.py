import random

import pytest
import regex

from liftwise.llm.queries import ranks_and_pattern
from liftwise.llm.surrogates import PATTERN
from liftwise.llm.token_counts import Counter, apply_edits, count_tokens, cuts, grow, pattern_edits, recount_edited

DATA = "/root/testdata/sf0.01"
RANKS, SPLIT = ranks_and_pattern()


@pytest.fixture(scope="module")
def counter():
    return Counter(RANKS, SPLIT)


def test_random_edits_equal_full_encoding(counter):
    rng = random.Random(2)
    pieces = [" ", "  ", "\n", "word", " it's", "don't", "123", " 45", "!?", "é", "漢字", " ", " a", "\t", "Zürich", "'", "\x1c"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(400)))
        starts = cuts(text, 16)
        ends = [*starts[1:], len(text)]
        tree = grow([counter.count(text[a:b]) for a, b in zip(starts, ends)])
        assert tree[1] == counter.count(text)
        at, edits, want, last = 0, [], [], 0
        for p in sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.randrange(8)))):
            if p >= at:
                at = min(len(text), p + rng.choice((0, 1, 5, 60)))
                new = "".join(rng.choice(pieces) for _ in range(rng.randrange(4)))
                edits.append({"start": p, "end": at, "text": new})
                want += [text[last:p], new]
                last = at
        want = "".join([*want, text[last:]])
        rng.shuffle(edits)
        edited, encoded = apply_edits(text, starts, tree, edits, counter)
        assert edited == want and tree[1] == counter.count(want)
        assert bool(encoded) <= bool(edits)
    with pytest.raises(ValueError):
        apply_edits("abc", [0], grow([1]), [{"start": 2, "end": 9, "text": ""}], counter)


def test_documents(spark, counter):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", pattern_edits("text", PATTERN, "[x]").alias("edits"))
    done = recount_edited(count_tokens(docs, RANKS, SPLIT, ["doc_id", "text", "edits"]), RANKS, SPLIT, ["doc_id", "text", "n_tokens"])
    touched = 0
    for r in done.collect():
        want, n = regex.subn(PATTERN, "[x]", r.text)
        assert (r.edited, r.n_edits, r.n_tokens, r.n_tokens_after) == (want, n, counter.count(r.text), counter.count(want))
        assert r.encoded_chars <= n * 4 * 600
        touched += bool(n)
    assert touched > 30


def test_edge_rows(spark, counter):
    rows = [(1, None, None), (2, "", [(0, 0, "new text")]), (3, "same words", None), (3, "same words", []), (None, "a b c d", [(2, 3, None)]), (5, "x" * 30_000 + " y" * 30_000, [(30_000, 30_000, " z"), (0, 1, "")])]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>, size int")
    counted = count_tokens(docs, RANKS, SPLIT, ["doc_id", "text", "edits", "size"])
    got = recount_edited(counted, RANKS, SPLIT, ["doc_id", "text", "n_tokens", "size"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_tokens_after) == (counter.count(r.text or ""), counter.count(r.edited))
    assert sorted(r.edited[:8] for r in got) == sorted(["", "new text", "same wor", "same wor", "a  c d", "x" * 8])
    assert count_tokens(docs.limit(0), RANKS, SPLIT, ["doc_id"]).count() == 0
