"""Project status notes -> concept trail entries (SC14, F16-F20, A26, A27, J9, J10, A30, K13).

Notes are whole Markdown files (one row each, read with ``wholetext``);
every step is a column expression on that row plus equi/semi/anti joins by
concept, so the work spreads over files.
"""

from __future__ import annotations

import os.path
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.fixed_values import (
    COMPANION_NOTE,
    NOTE_DEFAULT_SUMMARY,
    NOTE_SOURCE_TAG,
    POSITIONING_HEADINGS,
    STATUS_HEADINGS,
    SUMMARY_JOINER,
    TRAIL_HEADING,
)
from lumenlog.functions.text import plain_path, regex_escape
from lumenlog.sources.files import arrow_opens, read_whole_files

DATE = r"(\d{4}-\d{2}-\d{2})"


def _alt(words) -> str:
    return "(?:" + "|".join(regex_escape(w) for w in words) + ")"


def loose_glob(path: str) -> str:
    """A path pattern that matches ``path``: each character that means something in patterns as any character (an escaped one loses its
    escape inside alternatives). It may match other paths too."""
    return re.sub(r"[\\{}\[\]*?,]", "?", path)


def read_whole_texts(spark: SparkSession, paths: list[str] | str, patterns: list[str] | None = None) -> DataFrame:
    """(path, content, mtime) of whole text files, in one scan; ``paths`` and ``patterns`` without a file are skipped. ``paths`` are
    taken as they are, whatever characters they hold; ``patterns`` may hold wildcards."""
    from pyspark.errors import AnalysisException

    paths = [paths] if isinstance(paths, str) else list(paths)
    found = [loose_glob(p) for p in paths] + list(patterns or [])
    # one pattern of alternatives below the common folder: a missing one is no error there
    shared = os.path.commonprefix(found)
    shared = shared[:shared.rfind("/") + 1]
    glob = shared + "{" + ",".join(p[len(shared):] for p in found) + "}"
    try:
        t = spark.read.text(glob, wholetext=True) if found else None
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
            raise
        t = None
    if t is None:
        return spark.createDataFrame([], "path string, content string, mtime timestamp")
    t = t.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content"),
                 F.col("_metadata.file_modification_time").alias("mtime"))
    return t if patterns else t.where(F.col("path").isin(paths))


def scan_notes(spark: SparkSession, mapping: dict[str, str] | DataFrame, companion: str = COMPANION_NOTE) -> DataFrame:
    """SC14: mapped note files (path -> concept; a dict, or a DataFrame) joined to their text; missing files ignored. Also attaches the
    ``companion`` note (same folder) when present. Tasks read the files, so the mapping may be long; only in stores that Spark's readers
    alone reach its paths are listed on the driver."""
    if isinstance(mapping, dict):
        mapping = spark.createDataFrame(list(mapping.items()), "path string, concept string")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    beside = mapping.select(F.concat(folder, F.lit("/" + companion)).alias("path"))
    wanted = mapping.select("path").union(beside)
    stores = [r["s"] for r in mapping.select(F.regexp_extract("path", "^([^/:]+:/[^/]*/[^/]*/|/|)", 1).alias("s")).distinct().collect()]
    if all(arrow_opens(spark, s) for s in stores):
        texts = read_whole_files(wanted)
    else:
        texts = read_whole_texts(spark, [r["path"] for r in wanted.distinct().orderBy("path").collect()])
    notes = texts.join(mapping, "path")
    comp = texts.where(F.regexp_extract("path", "([^/]+)$", 1) == companion).select(
        F.regexp_replace("path", "/[^/]+$", "").alias("_dir"), F.col("content").alias("companion"),
        F.col("mtime").alias("companion_mtime"))
    return (notes.withColumn("_dir", F.regexp_replace("path", "/[^/]+$", ""))
                 .join(comp, "_dir", "left").drop("_dir"))


def clean_markdown_line(c: Column) -> Column:
    """F16: strip bold, italic, code, links, headers, bullets; collapse spaces; strip."""
    out = c
    for pat, rep in ((r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"`(.+?)`", "$1"),
                     (r"\[(.+?)\]\(.+?\)", "$1"), (r"^#+\s+", ""), (r"^[-*>]\s+", ""), (r"\s+", " ")):
        out = F.regexp_replace(out, "(?dU)" + pat, rep)
    return F.regexp_replace(out, r"(?U)^\s+|\s+\z", "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def compress_summary(section: Column) -> Column:
    """kept lines = stripped, non-empty, not table/fence/markup-only, cleaned,
    longer than 5; first line plus the second when together < 200; cut to 200.
    (The running-length stop at 180 only ever drops line 2 when line 1 exceeds it.)"""
    kept = F.filter(
        F.transform(
            F.filter(F.transform(_lines(section), _strip), lambda l: (l != "")
                     & ~l.rlike(r"^[|\-=`•\[\]]+$") & ~F.startswith(l, F.lit("```"))
                     & ~F.startswith(l, F.lit("~~~")) & ~l.rlike(r"^\|[-\s|]+\|$")),
            clean_markdown_line),
        lambda l: (l != "") & (F.length(l) > 5))
    l0 = F.try_element_at(kept, F.lit(1))
    l1 = F.when(F.length(l0) <= 180, F.try_element_at(kept, F.lit(2)))
    joined = F.when(l1.isNotNull() & (F.length(l0) + F.length(l1) < 200),
                    F.concat(l0, F.lit(SUMMARY_JOINER), l1)).otherwise(l0)
    return F.when(F.size(kept) > 0, F.substring(joined, 1, 200)).otherwise(F.lit(""))


def _section_after(content: Column, header_regex: str, cap: int) -> Column:
    """Text after the first header line matching ``header_regex`` up to the next
    '## ' line, else the next ``cap`` characters."""
    rest = F.regexp_extract(content, r"(?sm)" + header_regex + r"[^\n]*\n(.*)\z", 1)
    has_next = rest.rlike(r"(?m)^##\s")
    until = F.regexp_extract(rest, r"(?s)\A(.*?)(?m:^)##\s", 1)
    return F.when(has_next, until).otherwise(F.substring(rest, 1, cap))


def note_status(content: Column, mtime: Column, companion: Column | None = None,
                companion_mtime: Column | None = None) -> Column:
    """struct(status_date, summary, source) by the first strategy that yields text:
    status section (date from header, else bracketed date in the header line,
    else file date) -> companion note (file date) -> positioning summary (file date)."""
    hdr = r"^##\s+" + _alt(STATUS_HEADINGS)
    has_hdr = content.rlike(r"(?mU)" + hdr)
    d1 = F.regexp_extract(content, r"(?mU)" + hdr + r"[\s（(]?" + DATE + "?", 1)
    hline = F.regexp_extract(content, r"(?mU)(" + hdr + r"[^\n]*)", 1)
    d2 = F.regexp_extract(hline, r"[（(]" + DATE + r"[）)]", 1)
    file_day = F.to_date(mtime)
    sdate = F.coalesce(F.to_date(F.nullif(d1, F.lit(""))), F.to_date(F.nullif(d2, F.lit(""))), file_day)
    s1 = compress_summary(_section_after(content, hdr, 800))
    status_ok = has_hdr & (s1 != "")

    ctx_ok = F.lit(False)
    ctx_sum = F.lit(None).cast("string")
    if companion is not None:
        cl = F.filter(_lines(companion), lambda l: (_strip(l) != "") & ~F.startswith(l, F.lit("#"))
                      & ~F.startswith(l, F.lit(">")) & ~F.startswith(l, F.lit("---")))
        first = F.substring(clean_markdown_line(_strip(F.try_element_at(cl, F.lit(1)))), 1, 150)
        second = clean_markdown_line(_strip(F.try_element_at(cl, F.lit(2))))
        ctx_sum = F.when((F.size(cl) > 1) & (second != "") & (F.length(first) + F.length(second) < 200),
                         F.concat(first, F.lit(SUMMARY_JOINER), second)).otherwise(first)
        ctx_ok = F.contains(content, F.lit(COMPANION_NOTE)) & companion.isNotNull() & (F.size(cl) > 0)

    phdr = r"^##\s+" + _alt(POSITIONING_HEADINGS) + r"\s*$"
    has_p = content.rlike(r"(?mU)" + phdr)
    ps = compress_summary(_section_after(content, phdr, 400))
    long_lines = F.filter(_lines(content), lambda l: (_strip(l) != "") & ~F.startswith(l, F.lit("#"))
                          & ~F.startswith(l, F.lit(">")) & (F.length(_strip(l)) > 20))
    first_long = F.substring(clean_markdown_line(_strip(F.try_element_at(long_lines, F.lit(1)))), 1, 150)
    pos_sum = F.when(has_p, F.when(ps != "", ps).otherwise(F.lit(NOTE_DEFAULT_SUMMARY))).otherwise(
        F.coalesce(first_long, F.lit(NOTE_DEFAULT_SUMMARY)))

    ctx_day = F.to_date(companion_mtime) if companion_mtime is not None else F.lit(None).cast("date")
    return (F.when(status_ok, F.struct(sdate.alias("status_date"), s1.alias("summary"), F.lit("status").alias("source")))
            .when(ctx_ok, F.struct(ctx_day.alias("status_date"), ctx_sum.alias("summary"),
                                   F.lit("companion").alias("source")))
            .otherwise(F.struct(file_day.alias("status_date"), pos_sum.alias("summary"),
                                F.lit("positioning").alias("source"))))


def last_trail_date(doc: Column, heading: str = TRAIL_HEADING) -> Column:
    """The last '**YYYY-MM-DD**' (by position) from the trail heading to the end."""
    sec = F.regexp_extract(doc, r"(?sm)(^##\s+" + regex_escape(heading) + r".*)\z", 1)
    dates = F.regexp_extract_all(sec, F.lit(r"\*\*" + DATE + r"\*\*"), 1)
    return F.to_date(F.try_element_at(dates, F.lit(-1)))


def append_evolution(doc: Column, day: Column, summary: Column, heading: str = TRAIL_HEADING,
                     source_tag: str = NOTE_SOURCE_TAG) -> Column:
    """Insert '- **date** [tag] — summary' at the end of the trail section
    (before the next '##' section), or add the section at the end."""
    entry = F.concat(F.lit("- **"), F.date_format(day, "yyyy-MM-dd"), F.lit(f"** {source_tag} — "), summary)
    h = r"^##\s+" + regex_escape(heading)
    has_h = doc.rlike(r"(?m)" + h)
    # head = through the heading match and the section body up to (not incl.) "\n##\s"
    m = F.regexp_extract(doc, r"(?s)\A(.*?(?m:" + h + r")(?:(?!\n##\s).)*)(\n##\s.*)?\z", 1)
    tail = F.substring(doc, F.length(m) + 1, F.length(doc))
    has_next = F.startswith(tail, F.lit("\n"))
    rstrip = lambda c: F.regexp_replace(c, r"(?U)\s+\z", "")
    inserted = F.when(has_next, F.concat(rstrip(m), F.lit("\n"), entry, F.lit("\n"), tail)).otherwise(
        F.concat(rstrip(doc), F.lit("\n"), entry, F.lit("\n")))
    return F.when(has_h, inserted).otherwise(
        F.concat(rstrip(doc), F.lit(f"\n\n## {heading}\n\n"), entry, F.lit("\n")))


def latest_note(notes: DataFrame) -> DataFrame:
    """Per concept the note with the newest file time (of equal ones the last path)."""
    return notes.groupBy("concept").agg(F.max_by(F.struct(*notes.columns), F.struct("mtime", "path")).alias("n")).select("n.*")


def sync_notes(notes: DataFrame, concept_docs: DataFrame, heading: str = TRAIL_HEADING) -> DataFrame:
    """A30 (+ J9, J10): per concept of the mapping: skipped when its concept document
    is missing; skipped when the note's status date is not after the last trail
    date; otherwise the new document text with the entry appended.

    ``notes``: scan_notes output; ``concept_docs``: (concept, doc); ``heading``: the trail's heading.
    """
    cols = {"companion", "companion_mtime"}
    comp = [F.col(c) for c in ("companion", "companion_mtime")] if cols <= set(notes.columns) else [None, None]
    latest = latest_note(notes)
    st = latest.withColumn("_st", note_status(F.col("content"), F.col("mtime"), *comp))
    j = st.join(concept_docs.select("concept", "doc"), "concept", "left")
    last = last_trail_date(F.col("doc"), heading)
    missing = F.col("doc").isNull()
    stale = (~missing) & last.isNotNull() & (F.col("_st.status_date") <= last)
    return j.select(
        "concept", "path", F.col("_st.status_date").alias("status_date"), F.col("_st.summary").alias("summary"),
        F.col("_st.source").alias("source"), last.alias("last_trail_date"),
        (missing | stale).alias("skipped"),
        F.when(missing, F.lit("concept document missing"))
         .when(stale, F.concat(F.lit("up to date (trail ends "), last.cast("string"), F.lit(")")))
         .otherwise(F.lit("")).alias("skip_reason"),
        F.when(~(missing | stale), append_evolution(F.col("doc"), F.col("_st.status_date"), F.col("_st.summary"), heading=heading))
         .alias("new_doc"))
