"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.session import checkpoint_dir


_MODEL: dict = {}


def worker_model(key, build):
    """``build()``, kept in this process for as long as ``key`` is asked for. A process holds one model at a time: workers are
    reused by later stages, and what earlier ones held is given back first."""
    if key not in _MODEL:
        drop_models()
        _MODEL[key] = build()
    return _MODEL[key]


def drop_models() -> None:
    """Free the model this process holds, if any, and return its memory to the system."""
    if _MODEL:
        _MODEL.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """``_id``, ``_th``: the identity of a row in joins. Rows that share a doc_id (or have none) are told
    apart by their text; rows equal in both are the same document given twice, and get the same result."""
    text = whole_text(text_col)
    return [F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit("no id"), text)).alias("_id"),
            F.hash(F.col(id_col).isNull(), text).alias("_th")]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the cluster's shared folder and read it again: computed once, and a
    lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files behind the tables written so far. Spark deletes them once the driver has collected the plans they
    belong to as garbage, which it may not do by itself before the disks are full. Listeners hold a plan for a
    moment after its job, hence the repetition."""
    for _ in range(3):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def groups_by_size(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the groups (h, g) of up to ``limit`` rows, and those of larger ones (None: there are none)."""
    hot = materialize(rows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit).select("h", "g"), "hot")
    if hot.isEmpty():
        return rows, None
    return rows.join(hot, ["h", "g"], "left_anti"), rows.join(hot, ["h", "g"], "left_semi")


def sorted_groups(rows: DataFrame, solve, emit, schema: str) -> DataFrame:
    """``solve`` over each group (h, g) of ``rows`` (h first, g last): it gets the group's columns as lists and returns tuples, which
    ``emit`` turns into record batches. Groups are of bounded size; a task reads its sorted partition as a stream."""
    def run(batches):
        held, key, done = None, None, []
        for b in batches:
            for row in zip(*(col.to_pylist() for col in b.columns)):
                if (row[0], row[-1]) != key:
                    if key is not None:
                        done.extend(solve(held))
                    key, held = (row[0], row[-1]), [[] for _ in row]
                    if len(done) > 10_000:
                        yield emit(done)
                        done = []
                for col, v in zip(held, row):
                    col.append(v)
        if key is not None:
            done.extend(solve(held))
        if done:
            yield emit(done)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "h", "g").sortWithinPartitions("h", "g").mapInArrow(run, schema)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b: long), for every node of an edge.

    Alternating large-star and small-star rounds; each is an aggregation (with map-side combine) and an
    equi-join, so a node with very many neighbours is combined early and split by the skew join. Every
    round ends in a table in the shared folder."""
    cur = materialize(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").selectExpr("b AS a", "m AS b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").selectExpr("b AS a", "m AS b")
                 .union(low.selectExpr("a", "m AS b")).distinct())
        cur = materialize(small.selectExpr("greatest(a, b) AS a", "least(a, b) AS b"), "cc")
        stamp = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if stamp == seen:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = stamp
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
