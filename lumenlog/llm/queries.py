"""Registered queries of this subpackage: the operators with production parameters on whole tables."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import read_table

# rows of whole texts in one Arrow batch: bounds the memory of a Python worker
ARROW_ROWS = "512"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return read_table(spark, sf_dir, "documents")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by a 200-byte string that also starts elsewhere go."""
    from lumenlog.llm.byte_repeats import remove_repeats

    return remove_repeats(_docs(spark, sf_dir).select("doc_id", "text"), width=200).drop("kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go, everywhere."""
    from lumenlog.llm.line_dedup import line_dedup

    return line_dedup(_docs(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2("_kept", 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a 13-word window that an earlier document has go."""
    from lumenlog.llm.word_repeats import remove_repeats

    return remove_repeats(_docs(spark, sf_dir).select("doc_id", "text"), width=13).drop("kept")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents, within 10 % edits: one row per document, item and place."""
    from lumenlog.llm.decontaminate import leaks

    return leaks(_docs(spark, sf_dir).select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    from lumenlog.llm.exact_dedup import exact_dedup

    return exact_dedup(_docs(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text, with linked credential parts."""
    from lumenlog.llm.secrets import secret_scan

    return secret_scan(_docs(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text, learned from the documents that are not held out."""
    import public_tokenizers

    from lumenlog.llm.language_id import language_id

    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(1))  # no id: not learned from
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    return language_id(docs, public_tokenizers.path("piece_bpe_32k.model"), train=rest != 1).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"),
        F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


#: the key of the surrogates; production takes it from a secret store
PII_KEY = "surrogate-key"


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text with its personal data replaced by surrogates, and the number of entities by kind."""
    from lumenlog.llm.pii import KINDS, pii_surrogates

    out = pii_surrogates(_docs(spark, sf_dir).select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", F.col("_clean").alias("text"), *[F.col(f"_n_{k}").alias(f"n_{k}") for k in KINDS])


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at 4 or fewer differing fingerprint bits, and their components."""
    from lumenlog.llm.simhash import simhash_groups

    return simhash_groups(_docs(spark, sf_dir), width=4, max_bits=4)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text, and what they decode to."""
    import public_tokenizers

    from lumenlog.llm.byte_bpe import round_trip

    return round_trip(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by the checksum of their id, end in a stretch that repeats; the others stay as they are, also those
    without an id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    tens, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = tens % n
    p = 1 + (n - a) // (3 + tens % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of words that repeat at least four times in a row: their number, the strongest, and the words without them."""
    from lumenlog.llm.periodic_runs import periodic_runs, strongest

    out = periodic_runs(_docs(spark, sf_dir), min_length=6, min_exponent=4, prepare=repeated_tail)
    lines = F.transform("_runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = out.withColumn("_best", strongest(F.col("_runs")))
    return best.select(
        "doc_id", F.size("_runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("_collapsed", 256).alias("collapsed_sha256"))


#: phrases that count wherever they stand
LICENSE_PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases, and license wording that matches a template exactly; the score is the share of words inside either."""
    from lumenlog.llm.license_templates import TEMPLATES
    from lumenlog.llm.licenses import license_scan

    out = license_scan(_docs(spark, sf_dir), [*LICENSE_PHRASES, *TEMPLATES])
    base = F.filter("_places", lambda p: p["template"] < len(LICENSE_PHRASES))

    def labels(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return out.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"), F.array_max(base["start"]).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("_places")).alias("labels"),
        F.coalesce(F.try_divide(F.col("_covered").cast("double"), F.col("_n_words")), F.lit(0.0)).alias("score"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the whitened principal components 1 to 32, from an exact fit on all of them. Entries c are floor(64 * c)
    plus a constant; the constant cancels in every result."""
    from lumenlog.llm.whitening import whiten

    return whiten(read_table(spark, sf_dir, "embeddings"), components=32, scale=64.0).withColumn(
        "deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_language_id": op7_language_id,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_license_scan": op12_license_scan,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE = {
    "op2_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op5_exact_dedup": r"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
