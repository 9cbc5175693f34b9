"""A training corpus from documents: quality, near duplicates, benchmark passages, personal data, packing.

run() writes each stage's rows as Parquet in the shared folder and the next stage reads them. All stages but the last
give rows of docs with all its columns, whatever their names; columns but doc_id and text (and n_chars, which follows a
redacted text) are carried, not read. Rows that repeat an id or all of a row are rows of their own, but for near
duplicates; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearstack.llm import decontam, neardup, packing, pii, quality
from clearstack.llm.common import materialize, prepare, table
from clearstack.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score reaches the threshold, ties included; null and empty texts get the bias as their score."""
    prepare(spark)
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_score(weights, F.col("text")) >= quality.REJECT_UNDER)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id; rows with a null id stay.

    A row goes by its id and its text, so of rows that repeat an id each goes or stays by its own text; rows that repeat
    both are one document, and share its fate.
    """
    found = neardup.decisions(docs)
    gone = materialize(found.where(~F.col("kept")).select("doc_id", "text_key").distinct(), "near-duplicates")
    if gone.count() <= neardup.BROADCAST_IDS:
        gone = F.broadcast(gone)
    same = (docs["doc_id"].cast("long") == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_key"])
    return docs.join(gone, same, "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; null, empty and wordless texts hold none."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows the new text, null texts stay null."""
    model = pii.train_on(docs)
    clean = docs.withColumn("text", pii.redacted(model, F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars").cast("long")))
    return clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null or empty text is one piece, its end id."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: SQL can't express a learned score, MinHash with a learned step between, or token ids; tests/llm/test_pipeline_stages.py checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
