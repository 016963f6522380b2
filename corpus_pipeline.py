"""Cleaning pipeline for a training corpus: STAGES, applied in order by run().

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet
into the shared folder and hands the re-read table to the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm import byte_bpe, decontaminate, language_id, line_dedup, simhash
from lumenlog.llm.common import materialize, read_table

#: a document is rejected if no language reaches this posterior, or if it has no letter at all
MIN_LANGUAGE_SCORE = 0.5
#: rows of whole texts in one Arrow batch: bounds the memory of a Python worker
ARROW_ROWS = "512"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter (null and empty texts among them), or for which no learned language reaches
    MIN_LANGUAGE_SCORE, go. Learned from a bounded sample of the labelled rows of ``docs``; without any, all go. Repeated rows and
    rows without a doc_id are judged each; an empty table stays empty."""
    import public_tokenizers

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    scored = language_id.language_id(docs, public_tokenizers.path("piece_bpe_32k.model"), train=F.lit(True))
    kept = (F.col("_lang_pred") != language_id.UNDETERMINED) & (F.col("_score") >= MIN_LANGUAGE_SCORE)
    return scored.where(kept).drop("_lang_pred", "_score")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go from all texts; n_chars is that of the text that stays. Every row stays, null texts as
    empty ones; an empty table stays empty."""
    out = line_dedup.line_dedup(docs, min_docs=10, min_chars=1)
    return out.withColumns({"text": F.col("_kept"), "n_chars": F.char_length("_kept").cast("long")}).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the smallest doc_id, rows without one last; of rows that share it that of
    the smallest text digest, and one of equal rows. Null and empty texts are near duplicates of each other."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return simhash.representatives(docs, width=4, max_bits=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with up to 10 % edits (short items: unchanged, as whole words), go. Null and empty texts are
    clean; repeated rows and rows without a doc_id are judged each; without items, or documents, nothing goes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (packed token ids), n_tokens, ids_sha256, and whether the decoded ids are the text. One row per row: null and empty
    texts have no ids; an empty table gives an empty result."""
    import public_tokenizers

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return byte_bpe.tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_bpe", token_stage),
]

#: language ID, fingerprints and edit matching can't be said in SQL: tests/llm compares run() with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
