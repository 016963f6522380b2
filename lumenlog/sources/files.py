"""Very many small files, listed and read by tasks.

Spark's file sources list every file on the driver and give a task a few dozen small files at most (each counts as
``spark.sql.files.openCostInBytes``), so a log tree of millions of files costs the driver gigabytes and the job tens of thousands of
tasks. Here folders are listed by tasks, and the files, dealt by path, are read by tasks: the driver knows the folders only.
Contents stay bytes; which files count and where lines end is as in Spark's text source.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.sources.documents import open_folder

#: bytes of a file that are read together; the lines of a longer file are read in several places
SPLIT = 16 << 20
#: rows and bytes of a record batch
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20


def arrow_opens(spark: SparkSession, path: str) -> bool:
    """Whether Arrow opens the store of ``path`` (an absolute path or a URI); other stores only Spark's own readers reach."""
    if "://" not in path and not path.startswith("file:/"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        if not path.startswith("/") or not default.startswith("file:"):
            return False
    try:
        open_folder(path)
    except (pa.ArrowException, OSError):
        return False
    return True


@lru_cache(maxsize=64)
def _store(start: str) -> fs.FileSystem:
    return open_folder(start + "/")[0]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """``open_folder``, with one connection a store."""
    if "://" in path and not path.startswith("file:"):
        return _store(re.match(r"[^:]+://[^/]*", path)[0]), open_folder(path)[1]
    return open_folder(path)


def _counts(info: fs.FileInfo) -> bool:
    """The files Spark's sources read: not empty, not hidden."""
    name = info.base_name
    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    return info.type == fs.FileType.File and info.size > 0 and not hidden


def _tasks(spark: SparkSession) -> int:
    """Tasks that read files, two a core: the bytes of the names, by which Spark would choose, say little about the work, and a task
    streams what it reads, so it may hold any number of files."""
    return 2 * spark.sparkContext.defaultParallelism


def read_whole_files(paths: DataFrame) -> DataFrame:
    """(path, content, mtime) of the files at ``paths`` (a column ``path``); paths without a file are skipped."""
    def read(batches):
        for b in batches:
            out, size = [], 0
            for path in b.column(0).to_pylist():
                files, at = _opened(path)
                info = files.get_file_info(at)
                if _counts(info):
                    with files.open_input_file(at) as f:
                        out.append((path, f.read(), info.mtime_ns // 1_000_000))
                    size += info.size
                if size > BATCH_BYTES:
                    yield whole(out)
                    out, size = [], 0
            if out:
                yield whole(out)

    def whole(rows):
        kinds = (pa.string(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["path", "content", "ms"])

    dealt = paths.select("path").where("path IS NOT NULL").distinct().repartition(_tasks(paths.sparkSession), "path")
    return dealt.mapInArrow(read, "path string, content binary, ms long").select(
        "path", F.col("content").cast("string").alias("content"), F.timestamp_millis("ms").alias("mtime"))


def lines_from(f, start: int, size: int, split: int) -> list[bytes]:
    """The lines of an open file of ``size`` bytes that begin in its bytes start to start + split - 1. Places are told apart by line
    feeds, so a carriage return before one is not cut off."""
    if size <= split:
        data = f.read()
    else:
        f.seek(max(0, start - 1))
        data = f.read(split + (start > 0))
        if start:
            data = data[data.find(b"\n") + 1:] if b"\n" in data else b""
        if data and not data.endswith(b"\n"):
            parts = [data]
            while more := f.read(min(split, 1 << 20)):
                parts.append(more[:more.find(b"\n") + 1] or more)
                if parts[-1].endswith(b"\n"):
                    break
            data = b"".join(parts)
    if start == 0:
        data = data.removeprefix(b"\xef\xbb\xbf")
    return data.splitlines()


def read_log_lines(spark: SparkSession, root: str, row_bits: int, split: int = SPLIT) -> DataFrame | None:
    """(file_path, line_no, value) of the lines of ``<root>/<folder>/<name>.jsonl``; ``line_no`` ascends in file order, from 1 in each
    place of ``split`` bytes, the place above ``row_bits``. None: there is no folder."""
    root = root.rstrip("/")
    files, base = open_folder(root)
    folders = [(x.base_name,) for x in files.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.type == fs.FileType.Directory]
    if not folders:
        return None

    def listed(batches):
        files, base = open_folder(root)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = [x for x in files.get_file_info(fs.FileSelector(f"{base}/{folder}", allow_not_found=True))
                         if x.base_name.endswith(".jsonl") and _counts(x)]
                rows = [(f"{folder}/{x.base_name}", start, x.size) for x in found for start in range(0, x.size, split)]
                for i in range(0, len(rows), BATCH_ROWS):
                    cols = zip(*rows[i:i + BATCH_ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()))],
                                                     names=["name", "start", "size"])

    def read(batches):
        files, base = open_folder(root)
        for b in batches:
            names, numbers, values, held = [], [], [], 0
            for name, start, size in zip(*(c.to_pylist() for c in b.columns)):
                with files.open_input_file(f"{base}/{name}") as f:
                    lines = lines_from(f, start, size, split)
                names += [f"{root}/{name}"] * len(lines)
                first = (start // split << row_bits) + 1
                numbers += range(first, first + len(lines))
                values += lines
                held += min(size, split)
                if len(values) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield batch(names, numbers, values)
                    names, numbers, values, held = [], [], [], 0
            if values:
                yield batch(names, numbers, values)

    def batch(names, numbers, values):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(values, pa.binary())],
                                          names=["file_path", "line_no", "value"])

    days = spark.createDataFrame(folders, "folder string")
    places = days.mapInArrow(listed, "name string, start long, size long").repartition(_tasks(spark), "name", "start")
    return places.mapInArrow(read, "file_path string, line_no long, value binary").withColumn("value", F.col("value").cast("string"))
