"""Line dedup on range-partitioned line digests (built-in expressions only).

Every line becomes (digest of its key, document, position). The rows are range-partitioned by digest
and salt and sorted by document and position inside it; one streaming pass (``lag``) sees the first
occurrence of a key in each document. A key in a third of all documents is spread over the salts, and
the salts' counts meet in a map-side combined sum. What comes back to the documents is a compressed
keep bitmap per document (64 lines a word, words without a dropped line left out), never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import materialize, row_key, whole_text

STRIP = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 64


def line_key(line: Column) -> Column:
    """Stripped at both ends of space, tab, LF, VT, FF, CR; A-Z lower-cased."""
    s = F.btrim(line, F.lit(STRIP))
    # lower() equals the translation for ASCII texts, and is much faster
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def line_rows(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _th, pos, k): a 128-bit digest per line whose key has at least ``min_chars`` code points."""
    def digest(line):
        key = line_key(line)
        return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))

    keys = F.transform(F.split(whole_text(text_col), "\n"), digest)
    return (docs.select(*row_key(id_col, text_col), keys.alias("_k"))
            .select("_id", "_th", F.posexplode("_k").alias("pos", "k")).where("k IS NOT NULL"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(_id, _th, bitmap, n_dropped) of the documents that lose lines. ``bitmap``: array of
    (word, mask), sorted; bit 63 - i % 64 of word i div 64 is 1 if line i stays; absent words are all ones."""
    rows = materialize(line_rows(docs, min_chars, id_col, text_col), "lines")
    salted = rows.withColumn("salt", F.expr(f"pmod(hash(_id, _th), {SALTS})")).repartitionByRange("k", "salt")
    w = Window.partitionBy("k", "salt").orderBy("_id", "_th", "pos")
    first = (salted.select("k", "salt", F.expr("struct(_id, _th)").alias("d"),
                           F.lag(F.expr("struct(_id, _th)")).over(w).alias("before"))
             .where("before IS NULL OR d <> before"))
    # written, so that both sides of the next join are plain exchanges and a hot key can be split there
    frequent = materialize(first.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("k"), "frequent")
    # a document given twice has its positions twice: distinct by (document, position)
    words = (rows.join(frequent, "k").select("_id", "_th", "pos").distinct()
             .groupBy("_id", "_th", F.expr("pos div 64").cast("int").alias("word"))
             .agg(F.count(F.lit(1)).alias("n"), F.expr("~bit_or(shiftleft(1L, 63 - pos % 64))").alias("mask")))
    return (words.groupBy("_id", "_th")
            .agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("bitmap"), F.sum("n").alias("n_dropped")))


def apply_bitmap(text: Column, bitmap: Column) -> Column:
    """The lines that stay, joined by LF; a null bitmap keeps the text."""
    lines = F.split(text, "\n")
    last_word = F.floor((F.size(lines) - 1) / 64).cast("int")
    by_word = F.map_from_entries(bitmap)
    dense = F.transform(F.sequence(F.lit(0), last_word),
                        lambda w: F.coalesce(F.element_at(by_word, w), F.lit(-1).cast("long")))
    packed = F.transform(F.array(F.struct(lines.alias("l"), dense.alias("d"))), lambda s: F.array_join(
        F.filter(s["l"], lambda _, i: F.expr("1L") == F.call_function(
            "getbit", F.get(s["d"], F.floor(i / 64).cast("int")), F.lit(63) - i % 64).cast("long")), "\n"))
    return F.when(bitmap.isNull(), text).otherwise(packed[0])


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``docs`` with ``_n_lines``, ``_n_dropped``, ``_bitmap`` and ``_kept`` (the text that stays) added.

    A line's key is the line stripped and lower-cased (ASCII). Keys of at least ``min_chars`` code points
    found in at least ``min_docs`` documents lose all their lines, everywhere; the others stay, joined
    by LF. Null or empty text is one empty line. Rows equal in doc_id and text count as one document and get
    the same result; rows without doc_id are told apart by their text. An empty table gives an empty
    result; columns of any other name pass through."""
    maps = keep_bitmaps(docs, min_docs, min_chars, id_col, text_col)
    left = docs.select(F.struct("*").alias("_row"), *row_key(id_col, text_col))
    text = whole_text("_text")
    out = left.join(maps, ["_id", "_th"], "left").withColumn("_text", F.col("_row")[text_col]).select(
        "_row", F.size(F.split(text, "\n")).cast("long").alias("_n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("_n_dropped"),
        F.col("bitmap").alias("_bitmap"), apply_bitmap(text, F.col("bitmap")).alias("_kept"))
    return out.select("_row.*", "_n_lines", "_n_dropped", "_bitmap", "_kept")
