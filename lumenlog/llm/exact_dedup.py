"""Exact dedup by a heavy-hitter split (built-in expressions only).

Misra-Gries counters (Spark's ``freqItems`` aggregate) name the digests that may be frequent: at most
1/support of them, whatever the size of the input. Their exact counts and winners are then counted
("verified"), and the few verified rows are broadcast, so every copy of a frequent text gets its answer
on the map side, without a shuffle. All other digests are rare by construction and go through an
ordinary aggregation and join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import materialize, whole_text

DEFAULT_SUPPORT = 1e-3


def exact_dedup(docs: DataFrame, support: float = DEFAULT_SUPPORT, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Texts are equal when identical; of equal texts the row with the largest doc_id stays.
    Null text is the empty text. Rows without doc_id count in ``group_size`` but never win against a row
    with one; if no row of a group has a doc_id, keep_id is null and all its rows are marked kept. Rows that
    repeat the winning doc_id and text are the same document and are all marked kept. An empty table gives
    an empty result; other columns are ignored. ``support`` bounds the broadcast: at most 1/support rows."""
    digests = materialize(docs.select(F.col(id_col).alias("doc_id"),
                                      F.sha2(whole_text(text_col), 256).alias("text_sha256")), "digests")
    frequent = (digests.freqItems(["text_sha256"], support)
                .select(F.explode("text_sha256_freqItems").alias("text_sha256")))
    per_text = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    heavy = materialize(digests.join(F.broadcast(frequent), "text_sha256").groupBy("text_sha256").agg(*per_text)
                        .where("group_size >= 2"), "heavy")  # at most 1/support rows

    marked = digests.join(F.broadcast(heavy), "text_sha256", "left")
    rest = digests.join(F.broadcast(heavy), "text_sha256", "left_anti")
    # written, so that both sides of the join are plain exchanges and AQE can split a key that is just not frequent
    several = materialize(rest.groupBy("text_sha256").agg(*per_text).where("group_size >= 2"), "several")
    rest = rest.join(several, "text_sha256", "left").withColumns(
        {"keep_id": F.coalesce("keep_id", "doc_id"), "group_size": F.coalesce("group_size", F.lit(1)).cast("long")})
    cols = ["doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256"]
    return marked.where("group_size IS NOT NULL").select(*cols).union(rest.select(*cols))
