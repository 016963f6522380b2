"""A writer of document files that takes part in Spark's commit protocol (Python Data Source).

``df.select("path", "content").write.format("lumenlog_documents").mode("append").save(folder)`` writes one file per row. Tasks stage their
files in a hidden folder beside the documents; only what committed tasks staged is moved to its place, when the whole job commits.
A task attempt that fails, or is lost, or runs twice, leaves no document; a job that fails removes all it staged.
``save_documents`` has the moves done by tasks too, so that the driver only handles a line per task, however many documents there are.

Folders are paths or URIs of any file system that Arrow opens (local mounts, hdfs, viewfs, s3, gs).
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: moves under way at once in a process, where a move is a call to another machine
MOVES = 16
#: documents that one task moves at a time
MOVED_TOGETHER = 10_000
MANIFEST = "manifest"
#: in the staging folder: the folders of the committed task attempts, where tasks are to move the documents
COMMITTED = "committed"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    if folder.startswith("file:///"):
        return fs.LocalFileSystem(), unquote(folder[len("file://"):])
    if folder.startswith("file:/"):  # a Hadoop path, not escaped
        return fs.LocalFileSystem(), folder[len("file:"):]
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def relative(path: str | None) -> str:
    """A document's path below the folder; paths that lead out of it are refused."""
    parts = (path or "").split("/")
    if not path or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a path below the folder: {path!r}")
    return path


@dataclass
class Staged(WriterCommitMessage):
    """The folder of a committed task attempt, with its manifest."""
    folder: str
    documents: int


def move_staged(files: fs.FileSystem, base: str, folder: str, first: int = 0, end: int | None = None) -> int:
    """Move documents first to end - 1 of a staged folder to their places below ``base``; those an earlier attempt has moved stay there."""
    with files.open_input_stream(f"{folder}/{MANIFEST}") as lines:
        paths = [json.loads(x) for x in lines.readall().decode("utf-8").splitlines()[first:end]]
    for parent in sorted({p.rsplit("/", 1)[0] for p in paths if "/" in p}):
        files.create_dir(f"{base}/{parent}", recursive=True)

    def move(task):
        source, target = f"{folder}/{task[0]}", f"{base}/{task[1]}"
        try:
            files.move(source, target)
        except OSError:
            at, to = files.get_file_info([source, target])
            if to.type != fs.FileType.File:
                raise
            if at.type == fs.FileType.File:  # a file system whose move does not replace
                files.delete_file(target)
                files.move(source, target)

    tasks = enumerate(paths, first)
    if isinstance(files, fs.LocalFileSystem):  # threads would only wait for each other
        for task in tasks:
            move(task)
    else:
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(move, tasks))
    return len(paths)


def clear_staging(folder: str, staging: str) -> None:
    files, base = open_folder(folder)
    if files.get_file_info(f"{base}/{staging}").type == fs.FileType.Directory:
        files.delete_dir(f"{base}/{staging}")


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, staging: str | None = None):
        """With a ``staging`` folder of its own the caller moves the documents: a commit then only lists the committed attempts there."""
        self.folder = folder.rstrip("/")
        self.listed_only = staging is not None
        self.staging = staging or f".staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        files, base = open_folder(self.folder)
        own = f"{base}/{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        files.create_dir(own, recursive=True)
        n = 0
        try:
            with files.open_output_stream(f"{own}/{MANIFEST}") as manifest:
                for batch in iterator:
                    for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                        manifest.write((json.dumps(relative(path)) + "\n").encode("utf-8"))
                        with files.open_output_stream(f"{own}/{n}") as out:
                            out.write((content or "").encode("utf-8"))
                        n += 1
        except BaseException:
            files.delete_dir(own)
            raise
        return Staged(own, n)

    def commit(self, messages):
        files, base = open_folder(self.folder)
        staged = [m for m in messages if m is not None and m.documents]
        if self.listed_only:
            files.create_dir(f"{base}/{self.staging}", recursive=True)
            with files.open_output_stream(f"{base}/{self.staging}/{COMMITTED}") as out:
                out.write(json.dumps([[m.folder, m.documents] for m in staged]).encode("utf-8"))
            return
        for m in staged:
            move_staged(files, base, m.folder)
        clear_staging(self.folder, self.staging)

    def abort(self, messages):
        clear_staging(self.folder, self.staging)


class DocumentSource(DataSource):
    @classmethod
    def name(cls):
        return "lumenlog_documents"

    def schema(self):
        return "path string, content string"

    def writer(self, schema, overwrite):
        return DocumentWriter(self.options["path"], self.options.get("staging"))


def save_documents(docs: DataFrame, folder: str, together: int = MOVED_TOGETHER) -> None:
    """Write (path, content) documents below ``folder``: staged by one job's tasks, moved by another's."""
    spark = docs.sparkSession
    spark.dataSource.register(DocumentSource)
    folder, staging = folder.rstrip("/"), f".staging-{uuid.uuid4().hex}"
    try:
        docs.select("path", "content").write.format(DocumentSource.name()).option("staging", staging).mode("append").save(folder)
        files, base = open_folder(folder)
        with files.open_input_stream(f"{base}/{staging}/{COMMITTED}") as listed:
            staged = json.loads(listed.readall())

        def move(batches):
            files, base = open_folder(folder)
            for b in batches:
                n = [move_staged(files, base, *part) for part in zip(*(c.to_pylist() for c in b.columns))]
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["moved"])

        parts = [(own, first, min(first + together, n)) for own, n in staged for first in range(0, n, together)]
        if parts:
            spark.createDataFrame(parts, "own string, first long, end long").mapInArrow(move, "moved long").agg(F.sum("moved")).first()
    finally:
        clear_staging(folder, staging)
