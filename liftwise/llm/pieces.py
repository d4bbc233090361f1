"""SentencePiece encoding by sampling segmentations, and lossless decoding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftwise.llm.textblocks import Block, blocks, byte_table, hash_spans, mix

_EVERY = byte_table(b"", 401, fold=False)
#: A lattice holds some hundreds of bytes per byte of a block's distinct stretches; larger blocks are no faster.
_BLOCK = 200_000
#: Log-weight of one byte of a character that no piece covers.
BYTE_WEIGHT = -12.0


@dataclass
class Vocabulary:
    """Pieces as UTF-8 with blanks for their space mark, log-weights, and the id of each byte's piece."""

    ids: list[int]
    texts: list[bytes]
    weights: list[float]
    byte_ids: list[int]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece model with byte fallback.

    A piece's log-weight is its score; where a model has only ranks or no
    scores (BPE), it is Zipf's law over the pieces' order.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    skip = set(byte_ids)
    ids = [i for i in range(model.get_piece_size()) if i not in skip and not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    texts = [model.id_to_piece(i).replace("▁", " ").encode() for i in ids]
    if any(b"\n" in t or b" " in t.lstrip(b" ") for t in texts):
        raise ValueError("pieces must not hold line ends or inner blanks")
    scores = [model.get_score(i) for i in ids]
    ranks = all(float(s).is_integer() for s in scores)
    weights = [-float(np.log(k + 2)) for k in range(len(ids))] if ranks else scores
    return Vocabulary(ids, texts, weights, byte_ids)


class _Trie:
    """Pieces by prefix: a node's children by byte, and the piece that ends at each node.

    Children of a node are numbered in a row, by byte. A node holds a bit per
    byte, in four words, and for each word the number that follows its children.
    """

    def __init__(self, vocabulary: Vocabulary):
        width = max(map(len, vocabulary.texts))
        table = np.zeros((len(vocabulary.texts), width), np.int32)
        for i, t in enumerate(vocabulary.texts):
            table[i, : len(t)] = np.frombuffer(t, np.uint8)
        lengths = np.array([len(t) for t in vocabulary.texts])
        node, parents, columns, total = np.zeros(len(lengths), np.int64), [], [], 1
        ends = np.full(len(lengths), -1)
        for level in range(width):
            live = np.flatnonzero(lengths > level)
            keys, where = np.unique(node[live] * 256 + table[live, level], return_inverse=True)
            parents.append(keys >> 8)
            columns.append(keys & 255)
            node[live] = total + where
            total += len(keys)
            done = live[lengths[live] == level + 1]
            ends[done] = node[done]
        bits = np.zeros((total, 4), np.uint64)
        first = np.zeros(total, np.int64)
        at = 1
        for above, byte in zip(parents, columns):
            np.bitwise_or.at(bits, (above, byte >> 6), np.uint64(1) << (byte & 63).astype(np.uint64))
            heads, begin = np.unique(above, return_index=True)
            first[heads] = at + begin
            at += len(above)
        self.bits = bits.reshape(-1)
        self.past = (first[:, None] + np.cumsum(np.bitwise_count(bits), axis=1, dtype=np.int64)).astype(np.int32).reshape(-1)
        self.piece = np.full(total, -1, np.int32)
        self.piece[ends] = np.arange(len(lengths))
        self.width = width

    def children(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have a child by their byte, and these children."""
        at = node * np.int32(4) + (byte >> 6)
        upward = self.bits[at] >> (byte & 63)
        on = np.flatnonzero(upward & np.uint64(1))
        return on, self.past[at[on]] - np.bitwise_count(upward[on])


class _Lattice:
    """All segmentations of distinct units (stretches that no piece crosses), forward-filtered.

    Edges are sorted by the node they end in. Edge k joins bytes source[k] to
    the node's place; code[k] is a piece, or -1 - b for byte b of a character
    without a piece of its own.
    """

    def __init__(self, trie: _Trie, weights: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        n = int(lengths.sum())
        first = np.cumsum(lengths) - lengths
        place = np.arange(n) - np.repeat(first, lengths)
        text = data[np.repeat(starts, lengths) + place]
        last = np.repeat(first + lengths, lengths)
        source, target, code = [], [], []
        live, node = np.arange(n), np.zeros(n, np.int32)
        covered = np.zeros(n, bool)
        size = np.where(text < 0x80, 1, np.where(text < 0xC0, 0, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4))))
        live = live[size[live] > 0]
        node = node[live]
        for length in range(1, trie.width + 1):
            fits = live + length <= last[live]
            live, node = live[fits], node[fits]
            on, node = trie.children(node, text[live + length - 1])
            live = live[on]
            if not len(live):
                break
            piece = trie.piece[node]
            hit = piece >= 0
            source.append(live[hit])
            target.append(live[hit] + length)
            code.append(piece[hit])
            covered[live[hit & (size[live] == length)]] = True
        bare = np.flatnonzero((size > 0) & ~covered)
        inner = np.repeat(bare, size[bare]) + np.arange(int(size[bare].sum())) - np.repeat(np.cumsum(size[bare]) - size[bare], size[bare])
        source.append(inner)
        target.append(inner + 1)
        code.append(-1 - text[inner].astype(np.int32))
        source, target, code = (np.concatenate(x) for x in (source, target, code))
        weight = np.where(code >= 0, weights[np.maximum(code, 0)], BYTE_WEIGHT)

        # A node is the place behind a byte: node i + 1 of byte i; each unit's own start has log-mass 0.
        step = place[target - 1] + 1
        order = np.lexsort((target, step))
        source, target, code, weight, step = source[order], target[order], code[order], weight[order], step[order]
        mass = np.full(n + 1, -np.inf)
        share = np.empty(len(source))
        bounds = np.searchsorted(step, np.arange(1, int(lengths.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            into = target[a:b]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(into)) + 1))
            runs = np.diff(np.concatenate((cuts, [b - a])))
            from_start = place[source[a:b]] == 0
            ways = np.where(from_start, 0.0, mass[source[a:b]]) + weight[a:b]
            top = np.maximum.reduceat(ways, cuts)
            parts = np.exp(ways - np.repeat(np.where(np.isfinite(top), top, 0.0), runs))
            sums = np.add.reduceat(parts, cuts)
            with np.errstate(divide="ignore", invalid="ignore"):
                mass[into[cuts]] = top + np.log(sums)
                share[a:b] = np.where(np.repeat(sums > 0, runs), parts / np.repeat(sums, runs), 0.0)
        order = np.argsort(target, kind="stable")
        self.source, self.code = source[order], code[order]
        target, share = target[order], share[order]
        self.at = np.searchsorted(target, np.arange(n + 2))
        upto = np.cumsum(share)
        before = np.concatenate(([0.0], upto))[self.at[target]]
        self.draw = target + np.minimum(upto - before, 1.0)
        self.first, self.end = first, first + lengths


def _units(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of the stretches: a run of blanks with what follows it, and every line end by itself."""
    data, n = block.data, len(block.data)
    blank, line = data == 32, data == 10
    begins = np.zeros(n + 1, bool)
    begins[block.offsets] = True
    begins[:n] |= line
    begins[1:] |= line
    begins[:n] |= blank & np.concatenate(([True], ~blank[:-1]))[:n]
    starts = np.flatnonzero(begins[:n])
    lengths = np.diff(np.concatenate((starts, [n])))
    return starts, lengths, np.searchsorted(block.offsets, starts, side="right") - 1


def _uniform(seed: np.ndarray, unit: np.ndarray, step: int) -> np.ndarray:
    x = mix(seed + unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.full(1, step + 1, np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sample_pieces(block: Block, seeds: np.ndarray, vocabulary: Vocabulary, trie: _Trie) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of every text and where each text's begin."""
    starts, lengths, text = _units(block)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(block.rows + 1, np.int64)
    hashes = hash_spans(block.data, starts, starts + lengths, _EVERY)
    _, head, kind = np.unique(hashes, return_index=True, return_inverse=True)
    lattice = _Lattice(trie, np.array(vocabulary.weights), block.data, starts[head], lengths[head])
    seed = seeds[text]
    unit = np.arange(len(starts)) - np.searchsorted(text, text)

    active, node = np.arange(len(starts)), lattice.end[kind]
    floor = lattice.first[kind]
    drawn, owners = [], []
    while len(active):
        u = _uniform(seed[active], unit[active], len(drawn))
        edge = np.searchsorted(lattice.draw, node + u, side="right")
        edge = np.minimum(np.maximum(edge, lattice.at[node]), lattice.at[node + 1] - 1)
        drawn.append(lattice.code[edge])
        owners.append(active)
        node = lattice.source[edge]
        on = node > floor[active]
        active, node = active[on], node[on]
    counts = np.zeros(len(starts), np.int64)
    for who in owners:
        counts[who] += 1
    last = np.cumsum(counts) - 1
    codes = np.empty(int(counts.sum()), np.int64)
    for step, (who, code) in enumerate(zip(owners, drawn)):
        codes[last[who] - step] = code
    ids = np.where(codes >= 0, np.array(vocabulary.ids)[np.maximum(codes, 0)], np.array(vocabulary.byte_ids)[np.maximum(-1 - codes, 0)])
    per_text = np.bincount(text, weights=counts, minlength=block.rows).astype(np.int64)
    return ids.astype(np.int32), np.concatenate(([0], np.cumsum(per_text)))


class _Decoder:
    def __init__(self, vocabulary: Vocabulary):
        texts: dict[int, bytes] = {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
        texts.update(zip(vocabulary.ids, vocabulary.texts))
        size = max(texts) + 1
        self.lengths = np.array([len(texts.get(i, b"")) for i in range(size)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(texts.get(i, b"") for i in range(size)), np.uint8)

    def text(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and where each text's begin."""
        lengths = self.lengths[ids]
        total = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(self.starts[ids] - total[:-1], lengths) + np.arange(total[-1])
        return self.data[at], total[offsets]


def _encode(vocabulary: Vocabulary, keep: list[str], text: str = "_text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, decoder = _Trie(vocabulary), _Decoder(vocabulary)
        for batch in batches:
            for block in blocks(batch.column(text), _BLOCK):
                rows = batch.slice(block.first, block.rows)
                seeds = rows.column("_seed").to_numpy().astype(np.int64).view(np.uint64)
                ids, offsets = sample_pieces(block, seeds, vocabulary, trie)
                data, ends = decoder.text(ids, offsets)
                same = len(data) == len(block.data) and bool((data == block.data).all()) and bool((ends == block.offsets).all())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                counts = pa.array(np.diff(offsets).astype(np.int64))
                if not same:
                    raise ValueError("a sampled segmentation does not spell its text")
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], lists, counts], [*keep, "pieces", "n_pieces"])

    return run


def _decode(vocabulary: Vocabulary, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _Decoder(vocabulary)
        for batch in batches:
            lists = batch.column("_pieces").fill_null([])
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            counts = np.diff(lists.offsets.to_numpy())
            data, ends = decoder.text(ids, np.concatenate(([0], np.cumsum(counts))))
            body = data.tobytes()
            texts = [body[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, "decoded"])

    return run


def _kinds(docs: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)


def encode_pieces(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], key_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """One row per input row: the columns of ``keep``, pieces (ids) and n_pieces.

    A text is cut into stretches that no piece crosses. For every distinct
    stretch of a block of texts the lattice of all its segmentations is filtered
    forward: the log-mass of each place sums over the pieces that end there.
    Segmentations are then drawn backward, each with probability in proportion
    to the product of its pieces' weights. The draws are a hash of ``seed``, the
    row's key, the stretch's number and the step, so any task gives the same.
    Characters without a piece become byte pieces, and so does a literal space
    mark, so decoding gives back every text. This is checked for each row.

    Null and empty texts have no pieces. A null key draws like any other.
    Repeated rows are encoded alike. ``keep`` must not hold a result's name.
    """
    if clash := {"pieces", "n_pieces", "_text", "_seed"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are results; rename them first")
    # A kept text is not sent to the tasks a second time.
    own = [] if text_col in keep else [F.col(text_col).alias("_text")]
    rows = docs.select(*keep, *own, F.xxhash64(F.lit(seed), F.col(key_col)).alias("_seed"))
    return rows.mapInArrow(_encode(vocabulary, keep, "_text" if own else text_col), f"{_kinds(docs, keep)}pieces array<int>, n_pieces long")


def decode_pieces(rows: DataFrame, vocabulary: Vocabulary, keep: list[str], pieces_col: str = "pieces") -> DataFrame:
    """One row per input row: the columns of ``keep`` and decoded, the text of its pieces (empty for null)."""
    if clash := {"decoded", "_pieces"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are results; rename them first")
    return rows.select(*keep, F.col(pieces_col).alias("_pieces")).mapInArrow(_decode(vocabulary, keep), f"{_kinds(rows, keep)}decoded string")
