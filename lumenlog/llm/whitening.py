"""Embedding whitening by an exact characteristic polynomial.

1. One pass gives the integer scatter matrix n * sum(x x') - S S' of the scaled vectors, exactly: tasks emit their sums in limbs, Spark
   adds them per matrix entry.
2. Tasks take primes and return the matrix's characteristic polynomial modulo each; the driver joins the coefficients and isolates the
   roots. Tasks take roots and return eigenvectors. All this is as large as the dimension asks for, whatever the number of rows.
3. A second pass projects all vectors and sums the products of the results, which gives the error against the identity; the last
   one returns them.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.charpoly import by_remainders, charpoly_mod, null_vectors, primes_for, top_roots

LIMB, LIMBS = 40, 5
#: scaled entries beyond this are taken as this
LARGEST = float(1 << 62)


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors, their sums per dimension, and per component: eigenvalue, share of the variance, unit eigenvector."""
    n: int
    sums: list[int]
    values: list[float]
    explained: list[float]
    vectors: list[list[float]]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector): rows with a vector of finite entries."""
    finite = F.forall("_v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")).where(
        F.col("_v").isNotNull() & finite)


def scaled(column: pa.Array, d: int, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
    return np.clip(x, -LARGEST, LARGEST).astype(np.int64).reshape(-1, d)


def products(x: np.ndarray) -> np.ndarray:
    """x' x with Python integers where 64 bits could be too few."""
    top = int(np.abs(x).max(initial=0))
    if top * top * max(1, len(x)) < 1 << 53:  # doubles are exact up to there
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    big = x.astype(object)
    return big.T @ big


def limbs(value: int) -> list[int]:
    return [(value >> LIMB * k) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)] + [value >> LIMB * (LIMBS - 1)]


def scatter(rows: DataFrame, d: int, scale: float) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, sums of products) of the scaled vectors of dimension d, exact."""
    def run(batches):
        n, sums, squares = 0, np.zeros(d, object), np.zeros((d, d), object)
        for b in batches:
            x = scaled(b.column(0), d, scale)
            n += len(x)
            small = int(np.abs(x).max(initial=0)) * max(1, len(x)) < 1 << 62
            sums = sums + (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)
            squares = squares + products(x)
        if n:
            got = [(-1, -1, n), *[(i, -1, int(sums[i])) for i in range(d)],
                   *[(i, j, int(squares[i, j])) for i in range(d) for j in range(i, d)]]
            cols = [[g[0] for g in got], [g[1] for g in got], *zip(*[limbs(g[2]) for g in got])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    names = ["i", "j", *[f"l{k}" for k in range(LIMBS)]]
    parts = rows.select("_v").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    total = parts.groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names[2:]])
    n, sums, squares = 0, [0] * d, [[0] * d for _ in range(d)]
    for r in total.toLocalIterator():  # (d + 1) * (d + 2) / 2 rows
        value = sum(int(r[f"l{k}"]) << LIMB * k for k in range(LIMBS))
        if r["i"] < 0:
            n = value
        elif r["j"] < 0:
            sums[r["i"]] = value
        else:
            squares[r["i"]][r["j"]] = squares[r["j"]][r["i"]] = value
    return n, sums, squares


def over_tasks(spark: SparkSession, items: list, work, schema: str) -> list:
    """``work(item)`` -> record batch, in tasks; ``items`` and results are bounded by the dimension."""
    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield work(items[i])

    n = max(1, min(len(items), spark.sparkContext.defaultParallelism))
    return list(spark.range(0, len(items), 1, n).mapInArrow(run, schema).toLocalIterator())


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """The characteristic polynomial of a positive semidefinite integer matrix, highest power first."""
    def work(p):
        return pa.RecordBatch.from_arrays([pa.array([p]), pa.array([charpoly_mod(matrix, p)])], names=["p", "c"])

    primes = primes_for(sum(matrix[i][i] for i in range(len(matrix))), len(matrix))
    return by_remainders((r["p"], r["c"]) for r in over_tasks(spark, primes, work, "p long, c array<bigint>"))


def fit(rows: DataFrame, d: int, components: int, scale: float) -> Whitening:
    """The exact fit on all rows (``_v``: vectors of dimension d)."""
    spark = rows.sparkSession
    n, sums, squares = scatter(rows, d, scale)
    matrix = [[n * squares[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    roots = top_roots(polynomial(spark, matrix), components)

    def work(item):
        at, root, count = item
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([null_vectors(matrix, root, count)])], names=["at", "v"])

    found = over_tasks(spark, [(i, root, count) for i, (root, count) in enumerate(roots)], work, "at long, v array<array<double>>")
    vectors = [v for r in sorted(found, key=lambda r: r["at"]) for v in r["v"]][:components]
    values = [Fraction(root, 1 << 96) for root, count in roots for _ in range(count)][:components]
    trace = sum(matrix[i][i] for i in range(d))
    return Whitening(n, sums, [float(v / n / n) for v in values], [float(v / trace) for v in values], vectors)


def whiten(vectors: DataFrame, components: int = 32, scale: float = 64.0, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(``id_col``, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    A vector x is floor(scale * entries), as integers; a constant added to all entries changes nothing. Components are the eigenvectors of
    the exact covariance (divisor n), by falling eigenvalue e, with a positive largest entry: whitened = (x - mean) . component / sqrt(e).
    ``deviation`` (decimal): the sum over dimensions of (n * x - S)^2, S the sums; null where it has more than 38 digits.
    ``explained``: e / trace. ``identity_error``: largest absolute entry of the whitened values' covariance less the identity, from the values.

    Vectors that are null or hold null or non-finite entries have no row. Vectors of another length than most (of equally frequent
    lengths the greatest counts) are in no common space and have none either. Components without variance are left out, so fewer
    than ``components`` may come, or none (no usable vector, equal vectors, empty vectors, an empty table). Equal eigenvalues have
    orthogonal components. Repeated rows count as often as they come; null and repeated ids get rows each. Other columns
    are ignored. Scaled entries beyond 2^62 are taken as 2^62.

    The work of the fit beside the passes grows with the dimension only, as about its fourth power."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double"
    rows = usable(vectors, id_col, vector_col)
    most = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    w = fit(rows.where(F.size("_v") == d), d, components, scale) if d else None
    if w is None or not w.vectors:
        return spark.createDataFrame([], schema + ", identity_error double")
    rows = rows.where(F.size("_v") == d)
    basis = (np.array(w.vectors) / np.sqrt(w.values)[:, None]).T / w.n
    k = len(w.vectors)

    def centred(x):
        """n * x - S: in 64 bits where that is enough."""
        top = int(np.abs(x).max(initial=0)) * w.n + max(map(abs, w.sums))
        return (x * w.n - np.array(w.sums, np.int64), top) if top < 1 << 62 else (x.astype(object) * w.n - np.array(w.sums, object), top)

    def covariance(batches):
        total = np.zeros((k + 1, k))
        for b in batches:
            y = centred(scaled(b.column(0), d, scale))[0].astype(np.float64) @ basis
            total[:k] += y.T @ y
            total[k] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1), k)), pa.array(np.tile(np.arange(k), k + 1)),
                                          pa.array(total.ravel())], names=["i", "j", "s"])

    sums = np.zeros((k + 1, k))
    for r in rows.select("_v").mapInArrow(covariance, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        sums[r["i"], r["j"]] = r["s"] / w.n  # (k + 1) * k rows
    error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())

    def emit(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                m = part.num_rows
                y, top = centred(scaled(part.column(1), d, scale))
                if top * top * d < 1 << 63:
                    deviation = pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    exact = [sum(v * v for v in r) for r in y.astype(object).tolist()]
                    deviation = pa.array([v if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)),
                    deviation.take(each), pa.array((y.astype(np.float64) @ basis).ravel()), pa.array(np.tile(w.explained, m))], names=names)

    names = [id_col, "component", "n", "deviation", "whitened", "explained"]
    return rows.mapInArrow(emit, schema).withColumn("identity_error", F.lit(error))
