"""Vectorised reading of text columns inside Arrow tasks.

Texts stay UTF-8 bytes: a batch is cut into blocks of whole texts, and words
are found and hashed for a whole block at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Some dozen eight-byte values are held per byte of a block, so this times a hundred is what a task needs beside its batch.
BLOCK_BYTES = 500_000


@dataclass
class Block:
    """Rows ``first`` to ``last`` of a batch; text i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, size: int = BLOCK_BYTES, beside: pa.Array | None = None) -> Iterator[Block]:
    """Cut a string column into blocks of about ``size`` bytes; a longer text is a block of its own. Null reads as empty.

    With a column ``beside`` it, the same rows of that have at most ``size`` bytes too.
    """
    data, offsets = _views(column)
    bounds = [offsets] if beside is None else [offsets, _views(beside)[1]]
    first = 0
    while first < len(column):
        last = min(int(np.searchsorted(b, b[first] + size, side="right")) - 1 for b in bounds)
        last = min(max(last, first + 1), len(column))
        yield _block(data, offsets, first, last)
        first = last


def same_rows(column: pa.Array, block: Block) -> Block:
    """The rows of ``block`` in another column of its batch."""
    return _block(*_views(column), block.first, block.last)


def _views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _block(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> Block:
    base = offsets[first]
    return Block(first, last, data[base : offsets[last]], offsets[first : last + 1] - base)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


def byte_table(separators: bytes, salt: int = 11, fold: bool = True) -> np.ndarray:
    """Value of each byte in word hashes: 0 for separators, A-Z as a-z if ``fold``."""
    table = seeds(256, salt)
    if fold:
        table[65:91] = table[97:123]
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


WHITE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")


@dataclass
class Words:
    """Words of a block in order: byte spans, the text each is of, and a 64-bit hash."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hash: np.ndarray


def words(block: Block, table: np.ndarray = WHITE, inside: np.ndarray | None = None) -> Words:
    """Words are runs of bytes that ``inside`` marks, by default all but the table's separators."""
    data, n = block.data, len(block.data)
    inside = table[data] != 0 if inside is None else inside
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    starts = np.flatnonzero(inside & (edge[:n] | ~np.concatenate(([False], inside[:-1])))) if n else np.zeros(0, np.int64)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    text = np.searchsorted(block.offsets, starts, side="right") - 1
    return Words(starts, ends, text, hash_spans(data, starts, ends, table))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = WHITE) -> np.ndarray:
    """Hash of each of the given spans, which are in order and don't overlap."""
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(before, lengths)
    at = place + np.repeat(starts, lengths)
    weights = seeds(int(lengths.max()), 29)
    sums = np.add.reduceat(table[data[at]] * weights[place], before)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(found: Words, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the text of each; a text with fewer words gives its whole sequence as one."""
    n = np.bincount(found.text, minlength=rows)
    factors = seeds(width, 43)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(found.hash) >= width:
        heads = np.flatnonzero(found.text[: len(found.text) - width + 1] == found.text[width - 1 :])
        total = np.zeros(len(heads), np.uint64)
        for k in range(width):
            total += found.hash[heads + k] * factors[k]
        hashes, text = mix(total), found.text[heads]
    else:
        hashes, text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(short):
        first = np.searchsorted(found.text, short)
        own = np.array([(found.hash[a : a + k] * factors[:k]).sum(dtype=np.uint64) + np.uint64(k) for a, k in zip(first, n[short])], np.uint64)
        hashes, text = np.concatenate((hashes, mix(own))), np.concatenate((text, short))
        order = np.argsort(text, kind="stable")
        hashes, text = hashes[order], text[order]
    return hashes, text
