"""Secret scan: all rules compiled into one deterministic automaton, read in a single pass over the bytes of a text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftwise.llm.automaton import Automaton, compile_patterns
from liftwise.llm.textblocks import blocks

#: Bytes of text scanned at once; a longer text is scanned alone, at two more bytes of memory for each of its own.
SCAN_BYTES = 250_000


class Rule(NamedTuple):
    """A kind of secret. ``least`` is how long the value part, or the whole match if none is marked, must be."""

    kind: str
    pattern: str
    least: int = 1


#: The kinds every scan knows, then formats of issued keys. Order is the order of kinds at one place.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?<value>[A-Za-z0-9+/_.=-]+)""", 12),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
RULES = BASE_RULES + (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("pem", r"-----BEGIN( [A-Z]+)* PRIVATE KEY-----"),
)

SPAN = "struct<kind:string,start:long,end:long,value_start:long>"


def _spans(data: np.ndarray, offsets: np.ndarray, automaton: Automaton, table: list[int], least: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, start, rule, end, value start) of the matches in a block, ordered, places in code points."""
    lengths = np.diff(offsets)
    begins = offsets[:-1] + np.arange(len(lengths))  # one closing class follows each text
    closed = np.full(len(data) + len(lengths), automaton.end, np.uint8)
    closed[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = automaton.classes[data]
    stream = closed.tobytes()
    trace = automaton.trace(stream, table)
    found = []
    for at in np.flatnonzero(automaton.ended[trace]).tolist():
        rules = int(automaton.ended[trace[at]])
        while rules:
            rule = (rules & -rules).bit_length() - 1
            rules &= rules - 1
            start, value = automaton.began(rule, trace, stream, at - 1)
            if at - value >= least[rule]:
                found.append((start, rule, at, value))
    if not found:
        return []
    starts, rules, ends, values = np.array(found, np.int64).T
    text = np.searchsorted(begins, starts, side="right") - 1
    places = np.stack((starts, ends, values)) - begins[text]
    spots = np.unique(np.concatenate([offsets[text] + p for p in places] + [offsets[text]]))
    first = (data & 0xC0) != 0x80
    between = [np.count_nonzero(first[a:b]) for a, b in zip(np.concatenate(([0], spots[:-1])), spots)]
    before = np.cumsum(between)
    points = [before[np.searchsorted(spots, offsets[text] + p)] - before[np.searchsorted(spots, offsets[text])] for p in places]
    return sorted(zip(text.tolist(), points[0].tolist(), rules.tolist(), points[1].tolist(), points[2].tolist()))


def _scanned(automaton: Automaton, rules: Sequence[Rule], columns: list[str], out: str):
    least = np.array([r.least for r in rules])
    kinds = pa.array([r.kind for r in rules])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = automaton.table()
        for batch in batches:
            for block in blocks(batch.column("_text"), SCAN_BYTES):
                spans = _spans(block.data, block.offsets, automaton, table, least)
                text, start, rule, end, value = np.array(spans, np.int64).reshape(-1, 5).T
                ends = np.cumsum(np.bincount(text, minlength=block.rows))
                span = pa.StructArray.from_arrays([kinds.take(pa.array(rule)), pa.array(start), pa.array(end), pa.array(value)], ["kind", "start", "end", "value_start"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), span)
                kept = [batch.column(i).slice(block.first, block.rows) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*kept, lists], [*columns, out])

    return run


def find_secrets(docs: DataFrame, keep: list[str], rules: Sequence[Rule] = RULES, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Columns ``keep`` of every row and ``out``, the secrets in its whole text.

    A span has its kind, start and end (code points, end exclusive) and where
    its value part starts. Matches of a kind are leftmost, longest and do not
    overlap; a match whose value is shorter than the rule's ``least`` is
    dropped after it was taken. Spans are ordered by start, then by the rules'
    order, so a rule set whose first rules are the base rules keeps their spans
    whatever else is added. All texts are read from end to end, once, whatever
    the number of rules.

    A null text reads as empty and has no spans. Rows are judged one by one:
    ids may be null or repeated. In text that is not valid UTF-8 every byte
    that does not continue a character counts as a code point. Kinds must
    differ; ``keep`` must not name ``out`` or a column ``_text``.
    """
    if len({r.kind for r in rules}) != len(rules):
        raise ValueError("kinds of rules must differ")
    if out in keep or "_text" in keep:
        raise ValueError(f"columns {out} and _text are made here")
    automaton = compile_patterns([r.pattern for r in rules])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = T.StructType([rows.schema[c] for c in keep]).add(out, T.DataType.fromDDL(f"array<{SPAN}>"))
    return rows.mapInArrow(_scanned(automaton, rules, keep, out), schema)


def spans_text(spans: str, kinds: Sequence[str] | None = None):
    """Column of kind:start:end of the spans (of the given kinds), comma-joined."""
    held = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(list(kinds)))
    return F.concat_ws(",", F.transform(held, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
