"""Token counts that follow edits: a segment tree of counts per document, re-encoded only where an edit touches."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a leaf, at least, if the text can be cut there.
LEAF = 256
_EDITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
_CUT = re.compile(r"(?<=\S) (?=\S)")


def load_ranks(path: str) -> dict[bytes, int]:
    """Byte-pair ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Counter:
    """Counts tokens of a byte-level BPE whose pre-tokens never begin inside a word and hold no blank but a leading one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


def cuts(text: str, leaf: int = LEAF) -> list[int]:
    """Starts of the leaves. A leaf begins at a single blank between two characters that are none, where a pre-token must begin."""
    out = [0]
    while found := _CUT.search(text, out[-1] + leaf):
        out.append(found.start())
    return out


def grow(counts: list[int]) -> list[int]:
    """Segment tree: node i is the sum of nodes 2i and 2i + 1, the leaves are the last half."""
    size = 1 << max(0, len(counts) - 1).bit_length()
    tree = [0] * size + counts + [0] * (size - len(counts))
    for i in range(size - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def put(tree: list[int], leaf: int, count: int) -> None:
    """Set a leaf and the sums above it."""
    i = len(tree) // 2 + leaf
    change = count - tree[i]
    while i and change:
        tree[i] += change
        i //= 2


def apply_edits(text: str, starts: list[int], tree: list[int], edits: list[dict], counter: Counter) -> tuple[str, int]:
    """Edit ``text`` and bring ``tree`` up to date; returns the new text and the characters encoded anew.

    Leaves that an edit touches, and one more on each side as context, are
    encoded again as one stretch; both ends of a stretch are cuts that the edits
    leave as they were, so all other leaves keep their counts. The count of a
    stretch goes to its first leaf.
    """
    ends = [*starts[1:], len(text)]
    edits = sorted((e for e in edits if e is not None), key=lambda e: (e["start"], e["end"]))
    stretches: list[list] = []
    leaf, at = 0, 0
    for e in edits:
        if not 0 <= e["start"] <= e["end"] <= len(text) or e["start"] < at:
            raise ValueError("edits must lie within the text and not overlap")
        at = e["end"]
        while leaf < len(ends) - 1 and ends[leaf] < e["start"]:
            leaf += 1
        last = leaf
        while last < len(ends) - 1 and starts[last + 1] <= e["end"]:
            last += 1
        a, b = max(leaf - 1, 0), min(last + 1, len(ends) - 1)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = max(b, stretches[-1][1])
            stretches[-1][2].append(e)
        else:
            stretches.append([a, b, [e]])
    out, at, encoded = [], 0, 0
    for a, b, own in stretches:
        out.append(text[at : starts[a]])
        part, at = [], starts[a]
        for e in own:
            part += [text[at : e["start"]], e["text"] or ""]
            at = e["end"]
        part.append(text[at : ends[b]])
        at = ends[b]
        new = "".join(part)
        out.append(new)
        encoded += len(new)
        put(tree, a, counter.count(new))
        for i in range(a + 1, b + 1):
            put(tree, i, 0)
    out.append(text[at:])
    return "".join(out), encoded


def _build(ranks, pattern, keep):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks, pattern)
        for batch in batches:
            starts, trees = [], []
            for text in batch.column("_text").to_pylist():
                text = text or ""
                begin = cuts(text)
                starts.append(begin)
                trees.append(grow([counter.count(text[a:b]) for a, b in zip(begin, [*begin[1:], len(text)])]))
            columns = [pa.array(starts, pa.list_(pa.int32())), pa.array(trees, pa.list_(pa.int32())), pa.array([t[1] for t in trees], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], [*keep, "leaf_starts", "token_tree", "n_tokens"])

    return run


def _edit(ranks, pattern, keep):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks, pattern)
        for batch in batches:
            new = {"edited": [], "n_edits": [], "n_tokens_after": [], "encoded_chars": []}
            names = ("_text", "leaf_starts", "token_tree", "_edits")
            for text, starts, tree, edits in zip(*[batch.column(c).to_pylist() for c in names]):
                edits = edits or []
                changed, encoded = apply_edits(text or "", starts, tree, edits, counter) if edits else (text or "", 0)
                for column, value in zip(new.values(), (changed, len(edits), tree[1], encoded)):
                    column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(v, k) for v, k in zip(new.values(), kinds)]], [*keep, *new])

    return run


def _kinds(docs: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """One row per input row: the columns of ``keep``, leaf_starts, token_tree (its root, node 1, is the count) and n_tokens.

    Whole texts are counted; null and empty ones have 0 tokens and one empty
    leaf. ``keep`` must not hold a result's name.
    """
    if clash := {"leaf_starts", "token_tree", "n_tokens", "_text"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are results; rename them first")
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    return rows.mapInArrow(_build(ranks, pattern, keep), f"{_kinds(docs, keep)}leaf_starts array<int>, token_tree array<int>, n_tokens long")


def recount_edited(counted: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str], text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """One row per row of ``count_tokens`` (with the text kept): ``keep``, edited (the new text), n_edits, n_tokens_after, encoded_chars.

    edits: array of (start, end, text), characters of the old text replaced by
    ``text``, not overlapping, in any order; null edits or null texts in them
    read as none and as deletions. A row without edits is not encoded again.
    """
    if clash := {"edited", "n_edits", "n_tokens_after", "encoded_chars", "_text", "_edits"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are results; rename them first")
    edits = F.col(edits_col).cast("array<struct<start:int,end:int,text:string>>")
    own = [c for c in keep if c not in ("leaf_starts", "token_tree")]
    rows = counted.select(*own, "leaf_starts", "token_tree", F.col(text_col).alias("_text"), edits.alias("_edits"))
    return rows.mapInArrow(_edit(ranks, pattern, own), f"{_kinds(counted, own)}edited string, n_edits long, n_tokens_after long, encoded_chars long")


def pattern_edits(text: str, pattern: str, replacement: str):
    """Column: the edits that replace every match of ``pattern`` in the column ``text``."""
    column = F.col(text)
    gaps = F.split(column, pattern, -1)
    found = F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["found"])
        one = F.struct(begin.alias("start"), end.alias("end"), F.lit(replacement).alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, f: F.struct(g.alias("gap"), f.alias("found")))
    return F.when(column.rlike(pattern), F.aggregate(pairs, start, step)["out"])
