"""Language identification with error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from liftwise.llm.textblocks import Block, blocks, mix

UNKNOWN = "und"
ORDERS = (2, 3, 4)
FEATURE_BITS = 15
FEATURES = len(ORDERS) << FEATURE_BITS
#: Training texts per language, about; languages with fewer are used whole.
TRAIN_ROWS = 8_000
#: Below this score no codeword is clearly nearest.
CLEAR = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_FOLD = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)
_FOLD[65:91] = _FOLD[97:123]


@dataclass
class LanguageModel:
    """Codeword of each language (rows of +1 and -1), classifier weights by n-gram and bit, reliability by language and bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    reliability: np.ndarray


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords as rows of +1 and -1. All useful bits for up to five, else a seeded choice with a large least distance."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    bits = max(15, 6 * int(np.ceil(np.log2(n))))
    best, distance = None, -1
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, bits))
        code[:, np.abs(code.sum(0)) == n] *= np.where(np.arange(n) % 2, 1.0, -1.0)[:, None]
        gaps = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if gaps.min() > distance:
            best, distance = code, gaps.min()
    return best


def _grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each n-gram and the text it is of, ascending. Letters only: ASCII case folded, other runs are one space."""
    n = len(block.data)
    folded = _FOLD[block.data]
    owner = np.repeat(np.arange(block.rows), np.diff(block.offsets))
    space = folded == 32
    keep = ~(space & np.concatenate(([False], space[:-1])) & np.concatenate(([False], owner[1:] == owner[:-1]))) if n else space
    folded, owner = folded[keep].astype(np.uint64), owner[keep]
    features, texts = [], []
    for k, order in enumerate(ORDERS):
        ends = len(folded) - order + 1
        if ends <= 0:
            continue
        value = folded[:ends].copy()
        for j in range(1, order):
            value |= folded[j : j + ends] << np.uint64(8 * j)
        whole = owner[:ends] == owner[order - 1 :]
        slot = (mix(value[whole]) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64) + (k << FEATURE_BITS)
        features.append(slot)
        texts.append(owner[:ends][whole])
    if not features:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    features, texts = np.concatenate(features), np.concatenate(texts)
    return features, texts


def _evidence(block: Block, weights: np.ndarray) -> np.ndarray:
    """Summed log-odds of every text and bit, an n-gram of each order counting a share."""
    out = np.zeros((block.rows, weights.shape[1]))
    features, texts = _grams(block)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(texts)) + 1)) if len(texts) else np.zeros(0, np.int64)
    if len(cuts):
        np.add.at(out, texts[cuts], np.add.reduceat(weights[features], cuts, axis=0))
    return out / len(ORDERS)


def _decode(evidence: np.ndarray, model: LanguageModel) -> np.ndarray:
    """Share of each language: logistic losses of the bits against its codeword, weighted by the bits' reliability for it."""
    losses = np.logaddexp(0, -evidence[:, None, :] * model.code[None, :, :])
    total = (losses * model.reliability[None, :, :]).sum(2)
    near = np.exp(-(total - total.min(1, keepdims=True)))
    return near / near.sum(1, keepdims=True)


def _lettered(block: Block) -> np.ndarray:
    """Which texts have a letter."""
    ascii_letter = _LETTER[block.data] & (block.data < 128)
    counts = np.concatenate(([0], np.cumsum(ascii_letter)))
    found = np.diff(counts[block.offsets]) > 0
    for i in np.flatnonzero(~found & (np.diff(block.offsets) > 0)):
        found[i] = any(c.isalpha() for c in block.text(i).decode("utf-8", "replace"))
    return found


def _count(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(languages) * FEATURES, np.int64)
        for batch in batches:
            for block in blocks(batch.column("text")):
                label = batch.column("label").slice(block.first, block.rows).to_numpy(zero_copy_only=False)
                features, texts = _grams(block)
                totals += np.bincount(label[texts] * FEATURES + features, minlength=len(totals))
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["at", "n"])

    return run


def _hits(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros(model.code.shape, np.int64)
        texts = np.zeros(len(model.code), np.int64)
        for batch in batches:
            for block in blocks(batch.column("text")):
                label = batch.column("label").slice(block.first, block.rows).to_numpy(zero_copy_only=False)
                np.add.at(right, label, _evidence(block, model.weights) * model.code[label] > 0)
                np.add.at(texts, label, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(right.size)), pa.array(right.reshape(-1)), pa.array(np.repeat(texts, right.shape[1]))], ["at", "hits", "n"])

    return run


def train_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_language: int = TRAIN_ROWS) -> LanguageModel:
    """Fit a model on the rows with a language and a text, about ``rows_per_language`` hashed ones of each language.

    Counts are made in tasks; the driver holds languages x n-gram buckets
    numbers, at any number of rows. No labelled rows give a model without
    languages, one language a model that always answers it.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    code = codewords(len(languages))
    if len(languages) < 2:
        return LanguageModel(languages, code, np.zeros((FEATURES, 0), np.float32), np.zeros(code.shape))
    label = F.lit(None).cast("int")
    share = F.lit(0.0)
    for i, language in enumerate(languages):
        label = F.when(F.col(lang_col) == language, i).otherwise(label)
        share = F.when(F.col(lang_col) == language, min(1.0, rows_per_language / sizes[language])).otherwise(share)
    place = F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns if not isinstance(docs.schema[c].dataType, MapType)]), F.lit(1 << 20))
    sample = labelled.where(place < share * (1 << 20)).select(F.col(text_col).alias("text"), label.alias("label"))
    sample = sample.coalesce(_tasks(len(languages) * rows_per_language))

    counts = sample.mapInArrow(_count(languages), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(len(languages) * FEATURES)
    table[counts.column("at").to_numpy()] = counts.column("n").to_numpy()
    table = table.reshape(len(languages), len(ORDERS), -1)
    odds = (table + 0.5) / (table.sum(2, keepdims=True) + 0.5 * table.shape[2])
    seen = (table.sum(0) > 0).reshape(-1)
    odds = odds.reshape(len(languages), FEATURES)
    weights = np.zeros((FEATURES, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        up = code[:, b] > 0
        weights[:, b] = np.where(seen, np.log(odds[up].mean(0)) - np.log(odds[~up].mean(0)), 0)
    model = LanguageModel(languages, code, weights, np.ones(code.shape))

    hits = sample.mapInArrow(_hits(model), "at long, hits long, n long").groupBy("at").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).toArrow()
    share_right = np.full(code.size, 0.5)
    share_right[hits.column("at").to_numpy()] = (hits.column("hits").to_numpy() + 1) / (hits.column("n").to_numpy() + 2)
    share_right = share_right.reshape(code.shape)
    model.reliability = share_right / share_right.sum(1, keepdims=True)
    return model


def _tasks(rows: int) -> int:
    return max(1, rows // 2_000)


def _answers(model: LanguageModel, keep: list[str], clear: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for block in blocks(batch.column("text")):
                known = _lettered(block) if model.languages else np.zeros(block.rows, bool)
                pick, score = np.full(block.rows, len(model.languages)), np.zeros(block.rows)
                if model.languages:
                    shares = _decode(_evidence(block, model.weights), model) if len(model.languages) > 1 else np.ones((block.rows, 1))
                    pick, score = np.where(known, shares.argmax(1), pick), np.where(known, shares.max(1), 0.0)
                rows = batch.slice(block.first, block.rows)
                answers = [pa.array(names[pick], pa.string()), pa.array(score), pa.array(score < clear)]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], *answers], [*keep, "lang_pred", "score", "ambiguous"])

    return run


def identify_languages(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text", clear: float = CLEAR) -> DataFrame:
    """One row per input row: the columns of ``keep``, lang_pred, score (0 to 1) and ambiguous (score below ``clear``).

    The answer depends on the text alone. Every n-gram of the whole text votes
    for the bits; the language whose codeword has the least weighted loss is
    answered, the first by name on a tie. A null text or one without letters
    is ``und`` with score 0, and so is any text if the model has no language.
    ``keep`` must not hold a result's name.
    """
    if clash := {"lang_pred", "score", "ambiguous"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are results; rename them first")
    columns = [F.col(c) for c in keep] if text_col in keep and text_col == "text" else [*[F.col(c) for c in keep], F.col(text_col).alias("text")]
    if "text" in keep and text_col != "text":
        raise ValueError("a kept column 'text' must be the text itself")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(columns).mapInArrow(_answers(model, keep, clear), f"{kinds}, lang_pred string, score double, ambiguous boolean")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id's text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
