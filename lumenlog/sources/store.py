"""A store of ingested session logs, kept up to date epoch by epoch.

``<store>/lines``     decoded lines by ``modified_day`` of their file: a report on recent sessions reads recent folders only;
                      inside a Parquet file, a log's lines stand together and in order, so a filter on ``file_path`` skips row groups
``<store>/sessions``  one row per file: metadata, usage (A1) and head of the list (A8); usage and listing read these, no lines
``<store>/grams``     the 3-grams of a file's message texts (hash -> file), by hash: the files that can hold a search term (J11)

Each epoch (a streaming micro-batch, or a batch run with its own id) writes its own ``ingest_epoch=<id>`` folder of every table and
overwrites it when it is repeated, so nothing counts twice. A file that comes again in a later epoch replaces what was known of it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.project import project_name
from lumenlog.operators import search as S
from lumenlog.operators import sessions as SS
from lumenlog.operators import usage as U
from lumenlog.sources.jsonl import _file_path, decode_lines, head_splits, messages_of, order_lines, split_table

GRAM = 3
#: candidate files named in a filter; more are joined
MAX_NAMED_FILES = 200
#: letters that a case-insensitive search takes for ASCII ones, and those
FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")

SCAN_COLUMNS = "file_path string, block_start bigint, modified_time timestamp, file_size bigint, value string"


def scanned(text: DataFrame) -> DataFrame:
    """The columns of an epoch from a (streaming) text scan of session files."""
    meta = {"block_start": "file_block_start", "modified_time": "file_modification_time", "file_size": "file_size"}
    return text.select(_file_path().alias("file_path"), *[F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()], "value")


def _folded(text: Column) -> Column:
    return F.lower(F.translate(text, *FOLDED))


def _grams(text: Column) -> Column:
    """All 3-grams of a text, in one pass of a pattern that looks ahead."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))


def _bucket(gram: Column) -> Column:
    return F.pmod(gram, F.lit(64)).cast("int")


def write_epoch(raw: DataFrame, store: str, epoch: int) -> None:
    """Decode the raw lines of one epoch (``scanned``) into the store; a repeated epoch replaces itself."""
    spark, store = raw.sparkSession, store.rstrip("/")
    raw = raw.where(F.col("file_path").isNotNull())
    stem = F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1)

    def write(df: DataFrame, table: str, by: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
        path = f"{store}/{table}/ingest_epoch={epoch}"
        w = (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(path)
        try:
            return spark.read.option("basePath", path).schema(df.schema).parquet(path)
        except AnalysisException:  # an epoch without lines
            return spark.createDataFrame([], df.schema)

    lines = decode_lines(order_lines(raw.drop("file_size")), ["file_path", "modified_time"]).withColumn("session_id", stem).withColumn(
        "modified_day", F.date_format("modified_time", "yyyy-MM-dd"))
    lines = write(lines, "lines", "modified_day", ("modified_day", "file_path", "line_no"))  # a task's own files: nothing is exchanged
    folder = F.regexp_extract("file_path", r"([^/]+)/(?:[^/]+/subagents/)?[^/]+\.jsonl$", 1)
    files = raw.select("file_path", "modified_time", "file_size").distinct().select(
        stem.alias("session_id"), folder.alias("project_dir"), project_name(folder).alias("project_name"), "file_path", "file_size",
        "modified_time", (F.startswith(stem, F.lit("agent-")) | F.contains("file_path", F.lit("/subagents/"))).alias("is_agent"))
    heads = SS.session_heads(lines, "file_path", head_splits(split_table(raw))).drop("msg_count")
    listed = U.session_usage(files, messages_of(lines), "file_path").drop("total_tokens", "cost_usd").join(heads, "file_path", "left")
    write(listed, "sessions")
    grams = messages_of(lines).select("file_path", F.explode(_grams(_folded(F.col("content_text")))).alias("g"))
    grams = grams.select("file_path", F.xxhash64("g").alias("gram")).distinct().withColumn("bucket", _bucket(F.col("gram")))
    write(grams.repartitionByRange("bucket", "gram"), "grams", "bucket", ("bucket", "gram", "file_path"))


@dataclass(frozen=True)
class Store:
    """The tables of a store; ``epoch`` columns say where a row comes from."""
    lines: DataFrame
    sessions: DataFrame
    grams: DataFrame

    def messages(self) -> DataFrame:
        return messages_of(self.lines)

    def usage(self) -> DataFrame:
        """A1 from the rollup: what ``usage.session_usage`` gives, for ``usage.usage_by`` and the other usage reports."""
        return self.sessions.withColumn("cost_usd", U.units_to_usd(F.col("cost_units")))

    def listed(self, home: str | None = None, model: str | None = None, sort: str = "date") -> DataFrame:
        """A8 from the rollup: what ``sessions.list_sessions`` gives."""
        return SS.listing(self.sessions, home, model, sort)

    def recent(self, as_of: str, hours: int) -> tuple[DataFrame, DataFrame]:
        """(sessions, lines) of files modified within ``hours`` before ``as_of``; lines of other days are not read."""
        since = F.to_timestamp(F.lit(as_of)) - F.make_interval(hours=F.lit(hours))
        inside = F.col("modified_time") >= since
        day = F.col("modified_day") >= F.date_format(since, "yyyy-MM-dd")
        return self.sessions.where(inside), self.lines.where(day & inside)

    def candidate_files(self, term: str) -> DataFrame | None:
        """The files that hold all 3-grams of ``term`` in their messages; None if the index can't say (fewer than three
        characters, or letters beyond ASCII that have cases)."""
        text = term.lower()
        if len(text) < GRAM or any(not c.isascii() and c.lower() != c.upper() for c in term):
            return None
        wanted = sorted({text[i:i + GRAM] for i in range(len(text) - GRAM + 1)})
        hashes = [F.xxhash64(F.lit(g)) for g in wanted]  # folded to constants: the buckets prune folders
        found = self.grams.where(reduce(lambda a, h: a | ((F.col("bucket") == _bucket(h)) & (F.col("gram") == h)), hashes, F.lit(False)))
        return found.groupBy("file_path").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("file_path")

    def search(self, terms: list[str], **options) -> DataFrame:
        """P7 over the lines of candidate files only: the rows of ``search.search`` over all messages. The index serves literal
        terms; all of them have to be in a message, so every term narrows the files."""
        messages = self.messages()
        files = None
        if not options.get("regex"):
            for t in terms:
                more = self.candidate_files(t)
                if more is not None:
                    files = more if files is None else files.join(more, "file_path", "left_semi")
        if files is not None:
            named = [r["file_path"] for r in files.limit(MAX_NAMED_FILES + 1).toLocalIterator()]
            if len(named) <= MAX_NAMED_FILES:  # equalities reach the Parquet reader, which skips other row groups
                messages = messages.where(reduce(lambda a, f: a | (F.col("file_path") == f), named, F.lit(False)))
            else:
                messages = messages.join(files, "file_path", "left_semi")
        return S.search(messages, terms, **options)


def read_store(spark: SparkSession, store: str) -> Store:
    """The store as of now. Of a file that several epochs hold, the last one counts, in every table."""
    def table(name):
        return spark.read.parquet(f"{store.rstrip('/')}/{name}")

    sessions = table("sessions")
    last = sessions.groupBy("file_path").agg(F.max("ingest_epoch").alias("ingest_epoch"), F.count(F.lit(1)).alias("n"))
    old = sessions.join(last.where("n > 1"), "file_path").where(sessions["ingest_epoch"] < last["ingest_epoch"]).select(
        "file_path", sessions["ingest_epoch"])

    def current(name):
        return table(name).join(old, ["file_path", "ingest_epoch"], "left_anti")
    return Store(*(current(n) if not old.isEmpty() else table(n) for n in ("lines", "sessions", "grams")))
