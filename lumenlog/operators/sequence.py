"""Order-sensitive per-session operations that stay parallel inside a hot session.

The reference walks each session file in order. A plain
``Window.partitionBy(session)`` would put a whole session into one task, which
breaks when one session holds a large share of all rows. These helpers split
each session into fixed-width chunks of the ordering key
(``chunk = order >> bits``) and run a two-level scan:

1. a per-chunk summary (partial-aggregated, so a hot chunk costs one row),
2. a window over the chunk summaries of a session (rows = chunks, tiny),
3. a row-level window partitioned by (session, chunk), joined with (2).

Every task then sees at most ``2**bits`` rows of one session. ``order`` must be
an integral column, unique within the partition (line numbers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 16  # 65,536 rows of one session per window partition at most


def chunk_bits(bits: int | None = None) -> int:
    return CHUNK_BITS if bits is None else bits  # read at call time (tests shrink it)


def _with_chunk(df: DataFrame, order: str, bits: int | None) -> DataFrame:
    b = chunk_bits(bits)
    return df.withColumn("_chunk", F.shiftright(F.col(order).cast("bigint"), b))


def carry_forward(df: DataFrame, part: list[str], order: str, value: str, out: str,
                  bits: int | None = None) -> DataFrame:
    """``out`` = last non-null ``value`` at or before the row, in ``order`` within ``part``."""
    d = _with_chunk(df, order, bits)
    keys = [*part, "_chunk"]
    summ = d.groupBy(*keys).agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias("_cf_last"))
    w_prev = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*keys, F.last("_cf_last", ignorenulls=True).over(w_prev).alias("_cf_in"))
    w_row = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (d.join(summ, keys, "left")
             .withColumn(out, F.coalesce(F.last(F.col(value), ignorenulls=True).over(w_row), F.col("_cf_in")))
             .drop("_chunk", "_cf_in"))


def carry_many(df: DataFrame, part: list[str], order: str, values: dict[str, str], backwards: bool = False,
               bits: int | None = None) -> DataFrame:
    """W2 for several columns in one pass: each ``out`` = last non-null value of its column at or before the row
    (``backwards``: first at or after it), in ``order`` within ``part``. An output may replace a column of its name."""
    d = _with_chunk(df, order, bits)
    keys = [*part, "_chunk"]
    pick = F.min_by if backwards else F.max_by
    summ = d.groupBy(*keys).agg(*[pick(F.col(v), F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_cm_{o}") for o, v in values.items()])
    chunk, row = (F.desc("_chunk"), F.desc(order)) if backwards else (F.asc("_chunk"), F.asc(order))
    w_prev = Window.partitionBy(*part).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*keys, *[F.last(f"_cm_{o}", ignorenulls=True).over(w_prev).alias(f"_cm_{o}") for o in values])
    w_row = Window.partitionBy(*keys).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(summ, keys, "left").withColumns(
        {o: F.coalesce(F.last(F.col(v), ignorenulls=True).over(w_row), F.col(f"_cm_{o}")) for o, v in values.items()})
    return out.drop("_chunk", *[f"_cm_{o}" for o in values])


def next_row(df: DataFrame, part: list[str], order: str, cols: list[str], out: str,
             bits: int | None = None) -> DataFrame:
    """``out`` = struct of ``cols`` of the next row in ``order`` within ``part`` (null on the last row)."""
    d = _with_chunk(df, order, bits)
    keys = [*part, "_chunk"]
    payload = F.struct(*[F.col(c) for c in cols])
    summ = d.groupBy(*keys).agg(F.min_by(payload, F.col(order)).alias("_nx_first"))
    w_chunks = Window.partitionBy(*part).orderBy("_chunk")
    summ = summ.select(*keys, F.lead("_nx_first").over(w_chunks).alias("_nx_next_chunk"))
    w_row = Window.partitionBy(*keys).orderBy(order)
    return (d.join(summ, keys, "left")
             .withColumn(out, F.coalesce(F.lead(payload).over(w_row), F.col("_nx_next_chunk")))
             .drop("_chunk", "_nx_next_chunk"))


def dense_position(df: DataFrame, part: list[str], order: str, out: str = "pos",
                   bits: int | None = None) -> DataFrame:
    """``out`` = 1-based rank of the row in ``order`` within ``part`` (ROW_NUMBER, exact)."""
    d = _with_chunk(df, order, bits)
    keys = [*part, "_chunk"]
    summ = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_dp_n"))
    w_prev = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*keys, F.coalesce(F.sum("_dp_n").over(w_prev), F.lit(0)).alias("_dp_off"))
    w_row = Window.partitionBy(*keys).orderBy(order)
    return (d.join(summ, keys, "left")
             .withColumn(out, (F.col("_dp_off") + F.row_number().over(w_row)).cast("bigint"))
             .drop("_chunk", "_dp_off"))


def first_n(df: DataFrame, part: list[str], order: list, n: int, rank_col: str = "rk") -> DataFrame:
    """Rows ranked 1..n per ``part`` (W6/W7/O7). Spark plans a partial
    WindowGroupLimit before the exchange, so at most n rows per group and
    map task are shuffled, even for a hot group."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def ordered_distinct(df: DataFrame, part: list[str], value: str, order: list[str], out: str,
                     limit: int | None = None) -> DataFrame:
    """Per ``part``, the distinct ``value``s in first-seen order as an array.

    First occurrence per value is a partial aggregate (min of the order key);
    only distinct values reach the final collect. ``limit`` keeps the first n.
    """
    firsts = df.groupBy(*part, value).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_od_first"))
    if limit is not None:
        firsts = first_n(firsts, part, ["_od_first", value], limit, "_od_rk").drop("_od_rk")
    return firsts.groupBy(*part).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("_od_first").alias("o"), F.col(value).alias("v")))),
                    lambda s: s["v"]).alias(out))
