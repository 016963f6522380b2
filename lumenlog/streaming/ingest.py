"""Incremental ingest of new session-log files with Structured Streaming.

``readStream.text`` over the session tree picks up files that appeared since
the last run; each micro-batch is a static DataFrame, so it is ordered and
decoded with exactly the batch operators (``order_lines`` + ``decode_lines``)
and appended to a Parquet ``lines`` table; what the files' first lines need goes to a
``heads`` table beside it. With ``trigger(availableNow=True)``
a run processes everything new and stops -- a scheduled incremental job.

The file source tracks files, not offsets inside them: a line appended to an
already ingested file is not re-read. Use it for immutable (rotated/closed)
log files; re-ingest a changed file by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.sources.jsonl import _file_path, decode_lines, head_splits, order_lines, session_file_filter, split_table
from lumenlog.sources.store import scanned, write_epoch


def heads_path(table_path: str) -> str:
    """The (file_path, head_splits) table beside a ``lines`` table."""
    return f"{table_path.rstrip('/')}-heads"


def _append_batch(table_path: str):
    """Idempotent batch sink: each epoch owns ``ingest_epoch=<id>``; a retried
    epoch (after a failure) overwrites its own directory instead of appending twice."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        raw = batch.select("file_path", "block_start", "value")
        lines = decode_lines(order_lines(raw)).withColumn(
            "session_id", F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1))
        heads = head_splits(split_table(raw))
        for table, path in ((heads, heads_path(table_path)), (lines, table_path.rstrip("/"))):
            table.write.mode("overwrite").parquet(f"{path}/ingest_epoch={epoch_id}")
    return run


def _start(spark: SparkSession, root: str, sink, columns, checkpoint_location: str, include_agents: bool, available_now: bool,
           max_files_per_trigger: int | None):
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = columns(reader.load(f"{root.rstrip('/')}/*/*.jsonl").where(session_file_filter(include_agents)))
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def start_ingest(spark: SparkSession, root: str, table_path: str, checkpoint_location: str,
                 include_agents: bool = False, available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream into a ``lines`` table (returns the StreamingQuery). ``checkpoint_location`` must be
    on a shared file system; it records which files were ingested."""
    def columns(text):
        return text.select(_file_path().alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"), "value")
    return _start(spark, root, _append_batch(table_path), columns, checkpoint_location, include_agents, available_now, max_files_per_trigger)


def start_store(spark: SparkSession, root: str, store: str, checkpoint_location: str, include_agents: bool = False,
                available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream into a store (``sources.store``): lines, session rollup and search index, one epoch a micro-batch."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        write_epoch(batch, store, epoch_id)
    return _start(spark, root, sink, scanned, checkpoint_location, include_agents, available_now, max_files_per_trigger)


def ingest_available(spark: SparkSession, root: str, table_path: str, checkpoint_location: str,
                     include_agents: bool = False) -> None:
    """Process all files not ingested yet, then return."""
    start_ingest(spark, root, table_path, checkpoint_location, include_agents, available_now=True).awaitTermination()
