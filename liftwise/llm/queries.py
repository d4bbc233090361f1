"""Registered queries of the operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftwise.llm import oracles
from liftwise.llm.decontaminate import find_leaks
from liftwise.llm.language import held_out, identify_languages, train_languages
from liftwise.llm.license_scan import scan_licenses
from liftwise.llm.near_text import near_text_components
from liftwise.llm.near_vectors import near_vector_components
from liftwise.llm.hard_negatives import mine_hard_negatives
from liftwise.llm.manifest import build_manifest, climb, leaf, proof_digest
from liftwise.llm.pieces import decode_pieces, encode_pieces, load_vocabulary
from liftwise.llm.secret_scan import BASE_RULES, find_secrets, spans_text
from liftwise.llm.sharding import place
from liftwise.llm.surrogates import PATTERN as ENTITY_PATTERN
from liftwise.llm.surrogates import replace_entities
from liftwise.llm.token_counts import count_tokens, load_ranks, pattern_edits, recount_edited
from liftwise.llm.url_filter import filter_urls

#: Stands for the secret that a deployment keeps.
SURROGATE_KEY = "surrogates-of-this-corpus"

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_ngram_jaccard_join", oracles.NEAR_TEXT)
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text_components(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = train_languages(docs.where("not held_out").select("doc_id", "text", "lang"))
    return identify_languages(docs, model, ["doc_id", "held_out"])


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_pii_surrogates")
def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, SURROGATE_KEY, count_col="n_entities")


@query("op1_license_scan", oracles.LICENSES)
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


#: Rules of the URL filter, longest first where several fit.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@query("op3_url_filter")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


SHARDS = [f"shard-{i:02d}" for i in range(16)]


SLOTS = 4_099


@query("op4_sharding", oracles.sharding(SHARDS, SLOTS))
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"), "doc_id", SHARDS, SLOTS)


def piece_model() -> str:
    """Path of the installed SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = load_vocabulary(piece_model())
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    coded = encode_pieces(docs, vocabulary, ["doc_id", "text_hash"])
    decoded = decode_pieces(coded.withColumn("pieces_hash", F.xxhash64("pieces")), vocabulary, ["doc_id", "text_hash", "n_pieces", "pieces_hash"])
    return decoded.select("doc_id", "n_pieces", "pieces_hash", (F.xxhash64("decoded") == F.col("text_hash")).alias("lossless"))


@query("op6_embedding_near_dedup")
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vector_components(table(spark, sf_dir, "embeddings"))


def ranks_and_pattern() -> tuple[dict[bytes, int], str]:
    """Byte-pair ranks and pre-token pattern of the installed tokenizer."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after its personal data is taken out."""
    ranks, pattern = ranks_and_pattern()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", pattern_edits("text", ENTITY_PATTERN, "[removed]").alias("edits"))
    counted = count_tokens(docs, ranks, pattern, ["doc_id", "text", "edits"])
    done = recount_edited(counted, ranks, pattern, ["doc_id", "n_tokens"])
    return done.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "encoded_chars", F.xxhash64("edited").alias("edited_hash"))


@query("op11_secret_scan", oracles.SECRETS)
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"], out="found")
    base = [r.kind for r in BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, base), F.sha2(spans_text("found", base), 256).alias("base_sha256"), spans_text("found").alias("spans"))


@query("op12_merkle_manifest", oracles.MANIFEST)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, checked after a seventh of them had their n_chars changed."""
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    keep = {"doc_id": F.col("doc_id"), "now": leaf([changed if i == 3 else c for i, c in enumerate(columns)])}
    proved = climb(build_manifest(docs, leaf(columns), F.col("lang"), F.col("doc_id"), keep), "now")
    return proved.select("doc_id", "leaf", "subroot", "root", proof_digest("proof").alias("proof_sha256"), "folded_root", "verified")


@query("op13_hard_negatives", oracles.NEGATIVES)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row's label is moved on by one, so that near rows of another label exist."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine_hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)
