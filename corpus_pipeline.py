"""Training-data pipeline: each stage works on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. Rows need not be unique, and
columns beside doc_id, text and lang are passed on.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftwise.llm.decontaminate import without_leaks
from liftwise.llm.language import UNKNOWN, identify_languages, train_languages
from liftwise.llm.near_text import near_text_components
from liftwise.llm.pieces import encode_pieces, load_vocabulary
from liftwise.llm.queries import SURROGATE_KEY, piece_model
from liftwise.llm.surrogates import replace_entities
from liftwise.session import discard, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a letter, and those that no language's codeword is clearly nearest to."""
    names = docs.columns
    model = train_languages(docs.select("doc_id", "text", "lang"))
    plain = docs.toDF(*[c if c == "text" else f"in_{c}" for c in names])
    judged = identify_languages(plain, model, plain.columns)
    kept = judged.where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select(plain.columns)
    return kept.toDF(*names)


#: Up to so many rows to drop, of two longs each, are broadcast to the documents; beyond, documents are shuffled.
DROPPED_ROWS = 2_000_000


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep, of each group of near-duplicate texts, one row: that with the smallest id, no id last, ties by its place in its file.

    Rows are told apart by file and place, so null, repeated and shared ids need
    no care: a row goes only if a row of its own group stays. Documents without
    words, which link with nothing, all stay. What is dropped is a list of
    places, so texts don't move to be filtered.
    """
    stored = docs if _in_files(docs) else materialize(docs, "documents")
    meta = stored.metadataColumn("_metadata")
    place = [F.xxhash64(meta["file_path"]).alias("_file"), meta["row_index"].alias("_place")]
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), *place)
    found = near_text_components(stored.select(key.alias("key"), "text"), id_col="key").where("component_id <> key")
    dropped = materialize(found.select("key._file", "key._place"), "dropped-rows")
    gone = F.broadcast(dropped) if dropped.count() <= DROPPED_ROWS else dropped
    gone = gone.toDF("_gone_file", "_gone_place")
    return stored.join(gone, (place[0] == gone["_gone_file"]) & (place[1] == gone["_gone_place"]), "left_anti")


def _in_files(docs: DataFrame) -> bool:
    """Whether rows still have their place in a file."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return False
    return True


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that give a benchmark item away."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates; n_chars follows the new text."""
    changed = replace_entities(docs, SURROGATE_KEY)
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add pieces and n_pieces, a sampled segmentation that decodes to the text."""
    return encode_pieces(docs, load_vocabulary(piece_model()), docs.columns)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("piece_encoding", piece_encoding),
]

#: Language scores, surrogates and sampled segmentations have no SQL form; tests compare with plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
