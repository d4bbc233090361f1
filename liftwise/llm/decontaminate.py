"""Benchmark decontamination by canonical templates, windows and slot consistency."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.llm.textblocks import Block, blocks, byte_table, hash_spans, mix, seeds, words
from liftwise.session import discard, materialize

WINDOW = 8
LEAST_LITERALS = 5
LEAST_WINDOWS = 6
FILTER_BITS = 22
#: Up to so many keys of texts that give items away, of two longs each, are broadcast to the documents; beyond, documents are shuffled.
LEAKY_TEXTS = 2_000_000

NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fifteen twenty thirty forty fifty hundred thousand million"
UNIT_WORDS = (
    "m km cm mm mile miles foot feet inch inches meter meters metre metres g kg mg gram grams kilogram kilograms pound pounds ounce ounces"
    " l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years"
    " dollar dollars cent cents euro euros usd eur gbp percent degree degrees kmh mph"
)

_EVERY = byte_table(b"", 101)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_INSIDE = _DIGIT.copy()
_INSIDE[65:91] = _INSIDE[97:123] = True
_INSIDE[128:] = True
#: Bytes that may stand between a word and a name after it; any other begins a sentence.
_PLAIN = np.zeros(256, bool)
_PLAIN[np.frombuffer(b" ,-'\t", np.uint8)] = True
_LITERAL, _NUMBER, _NAME, _UNIT = range(4)
_PLACEHOLDER = seeds(4, 211)


def _vocabulary(text: str) -> np.ndarray:
    parts = text.encode().split()
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    return np.sort(hash_spans(data, ends - np.array([len(p) for p in parts]), ends, _EVERY))


_NUMBERS = _vocabulary(NUMBER_WORDS)
_UNITS = _vocabulary(UNIT_WORDS)


def _among(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return vocabulary[at] == hashes


def template(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical tokens of a block: token hash, value hash, kind, and the text each is of.

    Numbers (digits, or number words), units after a number and names
    (capitalised words inside a sentence, a run of them being one) become typed
    placeholders; their value hash keeps what stood there.
    """
    data = block.data
    inside = _INSIDE[data]
    if len(data) > 2:
        digit = _DIGIT[data]
        inside[1:-1] |= ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    found = words(block, _EVERY, inside)
    if not len(found.hash):
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int8), found.text
    first = data[found.starts]
    after = data[np.minimum(found.starts + 1, len(data) - 1)]
    upper = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    breaks = np.concatenate(([0], np.cumsum(~_PLAIN[data])))
    begins = np.ones(len(first), bool)
    begins[1:] = (found.text[1:] != found.text[:-1]) | (breaks[found.starts[1:]] > breaks[found.ends[:-1]])
    number = _DIGIT[first] | _among(found.hash, _NUMBERS)
    name = upper & ~begins & ~number
    unit = np.zeros(len(first), bool)
    unit[1:] = number[:-1] & (found.text[1:] == found.text[:-1]) & _among(found.hash[1:], _UNITS)
    kind = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, _LITERAL))).astype(np.int8)
    follows = np.zeros(len(first), bool)
    follows[1:] = (kind[1:] == _NAME) & (kind[:-1] == _NAME)
    heads = np.flatnonzero(~follows)
    value = mix(np.add.reduceat(found.hash, heads))
    kind, text = kind[heads], found.text[heads]
    token = np.where(kind == _LITERAL, found.hash[heads], _PLACEHOLDER[kind])
    return token, value, kind, text


#: Letters of scripts without blanks between words (Thai to Lao, Myanmar, Khmer and Tai, kana, Han and Yi).
_UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31BF),
    (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)


CodePoints = tuple[np.ndarray, np.ndarray]


def code_points() -> CodePoints:
    """By code point: 0 between words, 1 inside one, 2 a word of its own; and its lower case. Made once, on the driver."""
    sort, lower = np.zeros(0x110000, np.int8), np.arange(0x110000, dtype=np.int32)
    for c in range(0x40000):
        sort[c] = unicodedata.category(chr(c))[0] in "LMN"
        low = next((x for x in (chr(c).casefold(), chr(c).lower()) if len(x) == 1), chr(c))
        lower[c] = ord(low)
    for first, last in _UNSPACED:
        sort[first : last + 1] *= 2
    return sort, lower


def plain_words(block: Block, points: CodePoints) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words of a block as they stand: hash, and the text each is of. In scripts without blanks each letter is one."""
    data, n = block.data, len(block.data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    head = (data & 0xC0) != 0x80
    head[block.offsets[:-1][block.offsets[:-1] < n]] = True
    at = np.flatnonzero(head)
    point = data[at].astype(np.int32)
    for least, drop, more in ((0xC0, 0xC0, 1), (0xE0, 0xE0, 2), (0xF0, 0xF0, 3)):
        wide = np.flatnonzero((data[at] >= least) & (data[at] < (0xE0, 0xF0, 0x100)[more - 1]))
        value = data[at[wide]].astype(np.int32) - drop
        for k in range(1, more + 1):
            value = (value << 6) | (data[np.minimum(at[wide] + k, n - 1)] & 0x3F)
        point[wide] = np.minimum(value, 0x10FFFF)
    sorts, table = points
    sort = sorts[point]
    if len(point) > 2:
        digit = (point >= 48) & (point <= 57)
        sort[1:-1][((point[1:-1] == 46) | (point[1:-1] == 44)) & digit[:-2] & digit[2:]] = 1
    offsets = np.searchsorted(at, block.offsets)
    edge = np.zeros(len(point) + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate(([0], sort[:-1])), np.concatenate((sort[1:], [0]))
    starts = np.flatnonzero((sort == 2) | ((sort == 1) & (edge[:-1] | (before != 1))))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.flatnonzero((sort == 2) | ((sort == 1) & (edge[1:] | (after != 1)))) + 1
    return hash_spans(point, starts, ends, table), np.searchsorted(offsets, starts, side="right") - 1


def _windows(token: np.ndarray, text: np.ndarray, length: int, salt: int, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each window of one text; with ``kind``, of those that have enough literal tokens."""
    ends = len(token) - length + 1
    if ends <= 0 or not length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    fit = text[:ends] == text[length - 1 :]
    if kind is not None:
        literal = np.concatenate(([0], np.cumsum(kind == _LITERAL)))
        fit &= literal[length:] - literal[:-length] >= LEAST_LITERALS
    starts = np.flatnonzero(fit)
    total = np.zeros(len(starts), np.uint64)
    for k, factor in enumerate(seeds(length, salt + length)):
        total += token[starts + k] * factor
    return starts, mix(total)


_TEMPLATE_SALT, _EXACT_SALT = 307, 30_011


def _slots(value: np.ndarray, kind: np.ndarray, start: int, length: int) -> list[int]:
    part = slice(start, start + length)
    return value[part][kind[part] != _LITERAL].view(np.int64).tolist()


def _item_rows(window: int, points: CodePoints):
    """Arrow task: (item, key, text) to the distinct windows of every item, template and exact ones, the first of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = points[0], seeds(len(points[1]), 103)[points[1]]
        for batch in batches:
            for block in blocks(batch.column("text")):
                token, value, kind, text = template(block)
                plain, of = plain_words(block, values)
                ends, plain_ends = np.searchsorted(text, np.arange(block.rows + 1)), np.searchsorted(of, np.arange(block.rows + 1))
                out = {"row": [], "exact": [], "ipos": [], "length": [], "hash": [], "islots": [], "need": []}
                for i in range(block.rows):
                    part, own = slice(ends[i], ends[i + 1]), slice(plain_ends[i], plain_ends[i + 1])
                    for exact, size in ((False, ends[i + 1] - ends[i]), (True, plain_ends[i + 1] - plain_ends[i])):
                        length = min(window, int(size))
                        if exact:
                            starts, hashes = _windows(plain[own], of[own], length, _EXACT_SALT)
                        else:
                            starts, hashes = _windows(token[part], text[part], length, _TEMPLATE_SALT, kind[part])
                        hashes, first = np.unique(hashes, return_index=True)
                        for h, s in zip(hashes.view(np.int64).tolist(), starts[first].tolist()):
                            slots = [] if exact else _slots(value[part], kind[part], s, length)
                            row = (i, exact, s, length, h, slots, min(LEAST_WINDOWS, len(hashes)))
                            for column, x in zip(out.values(), row):
                                column.append(x)
                rows = pa.array(out["row"], pa.int64())
                own = batch.slice(block.first, block.rows)
                kinds = {"exact": pa.bool_(), "ipos": pa.int32(), "length": pa.int32(), "hash": pa.int64(), "islots": pa.list_(pa.int64()), "need": pa.int32()}
                columns = [own.column("item").take(rows), own.column("key").take(rows), *[pa.array(out[c], t) for c, t in kinds.items()]]
                yield pa.RecordBatch.from_arrays(columns, ["item", "key", *kinds])

    return run


def _document_rows(lengths: list[tuple[bool, int]], buckets: np.ndarray, points: CodePoints):
    """Arrow task: (h1, h2, text) to the windows whose bucket some item has; an exact one once per text, at no place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = points[0], seeds(len(points[1]), 103)[points[1]]
        wanted = np.unpackbits(buckets).astype(bool)

        def kept(starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keep = wanted[hashes >> np.uint64(64 - FILTER_BITS)]
            return starts[keep], hashes[keep]

        def rows_of(batch: pa.RecordBatch, own: np.ndarray, place: np.ndarray, hashes: np.ndarray, slots: list[list[int]]) -> pa.RecordBatch:
            rows = pa.array(own)
            columns = [batch.column("h1").take(rows), batch.column("h2").take(rows), pa.array(place.astype(np.int32)), pa.array(hashes.view(np.int64))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(slots, pa.list_(pa.int64()))], ["h1", "h2", "dpos", "hash", "dslots"])

        for batch in batches:
            for block in blocks(batch.column("text")):
                token, value, kind, text = template(block)
                for length in [n for exact, n in lengths if not exact]:
                    starts, hashes = kept(*_windows(token, text, length, _TEMPLATE_SALT, kind))
                    own = text[starts]
                    slots = [_slots(value, kind, s, length) for s in starts.tolist()]
                    yield rows_of(batch, own + block.first, starts - np.searchsorted(text, own), hashes, slots)
                plain, text = plain_words(block, values)
                for length in [n for exact, n in lengths if exact]:
                    starts, hashes = kept(*_windows(plain, text, length, _EXACT_SALT))
                    order = np.lexsort((hashes, text[starts]))
                    own, hashes = text[starts][order], hashes[order]
                    new = np.ones(len(own), bool)
                    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
                    own, hashes = own[new], hashes[new]
                    yield rows_of(batch, own + block.first, np.zeros(len(own)), hashes, [[]] * len(own))

    return run


def text_key(column: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text."""
    return F.xxhash64(column), F.xxhash64(F.lit(17), column)


def benchmark_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row (h1, h2, item, n_windows) per text, by its ``text_key``, and benchmark item that it gives away.

    Items and texts become templates. Windows of ``window`` canonical tokens,
    with ``LEAST_LITERALS`` literal ones, are joined by hash; an item shorter
    than a window is one window. Windows with the item's own slot values count
    as they are. Of the others that stand in one alignment (document place minus
    item place), those with an item value that has several document values
    there are coincidence. Beside them, windows of ``window`` lower-cased
    words with all values kept (of letters, in scripts without blanks) are
    joined for items of every length, dense in slots or not. A text gives an
    item away with ``LEAST_WINDOWS`` of its distinct windows of one of the two
    sorts, or all of that sort if it has fewer.

    The filter sent to tasks has 2 ** FILTER_BITS bits at any number of items;
    what passes it is joined by shuffle. Null texts, and texts without a letter
    or digit, match nothing.
    """
    spark = docs.sparkSession
    source = items.select(F.col(item_id).alias("item"), F.xxhash64(item_text).alias("key"), F.col(item_text).alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    points = code_points()
    known = source.mapInArrow(_item_rows(window, points), f"item {kind}, key long, exact boolean, ipos int, length int, hash long, islots array<long>, need int")
    known = materialize(known.dropDuplicates(["item", "key", "exact", "ipos"]), "item-windows")
    lengths = sorted((r["exact"], r["length"]) for r in known.select("exact", "length").distinct().collect())
    if not lengths:
        return spark.createDataFrame([], f"h1 long, h2 long, item {kind}, n_windows long")
    buckets = np.zeros(1 << FILTER_BITS, bool)
    buckets[known.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("b")).distinct().toArrow().column("b").to_numpy()] = True

    h1, h2 = text_key(F.col(text_col))
    texts = docs.select(h1.alias("h1"), h2.alias("h2"), F.col(text_col).alias("text"))
    seen = texts.mapInArrow(_document_rows(lengths, np.packbits(buckets), points), "h1 long, h2 long, dpos int, hash long, dslots array<long>")
    met = seen.join(known.select("item", "key", "exact", "ipos", "hash", "islots", "need"), "hash")
    met = met.withColumn("shift", F.when(~F.col("exact"), F.col("dpos") - F.col("ipos")))
    met = met.dropDuplicates(["h1", "h2", "item", "key", "exact", "ipos", "shift"])
    matches = materialize(met.drop("hash", "dpos"), "window-matches")

    # a window whose values are the item's own needs no mapping; among the others, one item value has one document value
    met = matches.withColumn("verbatim", F.col("islots") == F.col("dslots"))
    where = ["h1", "h2", "item", "key", "shift"]
    other = met.where("not verbatim")
    slots = other.select(*where, "ipos", F.explode(F.arrays_zip("islots", "dslots")).alias("s")).select(*where, "ipos", F.col("s.islots").alias("own"), F.col("s.dslots").alias("new"))
    crossed = slots.groupBy(*where, "own").agg(F.min("new").alias("a"), F.max("new").alias("b")).where("a <> b")
    crossed = crossed.select(*[F.col(c).alias(f"x_{c}") for c in (*where, "own")])
    dropped = slots.join(crossed, [slots[c].eqNullSafe(crossed[f"x_{c}"]) for c in (*where, "own")], "left_semi")
    dropped = dropped.select(*[F.col(c).alias(f"x_{c}") for c in (*where, "ipos")]).distinct()
    sound = other.join(dropped, [other[c].eqNullSafe(dropped[f"x_{c}"]) for c in (*where, "ipos")], "left_anti").unionAll(met.where("verbatim"))
    counts = sound.groupBy("h1", "h2", "item", "key", "exact", "need").agg(F.countDistinct("ipos").alias("n_windows"))
    found = counts.where("n_windows >= need").groupBy("h1", "h2", "item").agg(F.max("n_windows").alias("n_windows"))
    found = materialize(found, "leaks")
    discard(known, matches)
    return found


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, contaminated, n_items, items (ascending ids of the items it gives away)."""
    found = benchmark_matches(docs, items, text_col, **options).groupBy("h1", "h2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    h1, h2 = text_key(F.col(text_col))
    rows = docs.select(F.col(id_col), h1.alias("h1"), h2.alias("h2")).join(found, ["h1", "h2"], "left")
    items_found = F.coalesce("items", F.array().cast(found.schema["items"].dataType))
    return rows.select(id_col, F.col("items").isNotNull().alias("contaminated"), F.size(items_found).cast("long").alias("n_items"), items_found.alias("items"))


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that give no item away."""
    found = benchmark_matches(docs, items, text_col, **options).select("h1", "h2").distinct()
    gone = (F.broadcast(found) if found.count() <= LEAKY_TEXTS else found).toDF("_leak_h1", "_leak_h2")
    h1, h2 = text_key(docs[text_col])
    return docs.join(gone, (h1 == gone["_leak_h1"]) & (h2 == gone["_leak_h2"]), "left_anti")
