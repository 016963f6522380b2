"""Match counts over a session's texts as if joined with single spaces, without joining them.

Where no match can span a joint (most patterns: words), the count is the sum of the messages' own counts, a plain aggregate. For other patterns
every message is summed up on its own (``operators.automaton``): a few characters of head and tail and a count. Only these
are exchanged. They are composed in order, first inside chunks of a session, then over its chunks, so a hot session
stays parallel and no row holds more than the cut heads and tails of a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.operators.automaton import Running, automaton
from lumenlog.operators.sequence import chunk_bits

FLAGS = "(?iud)"
#: characters of heads and tails in one record batch
BATCH_CHARS = 1 << 20

Sequence_ = tuple[Column, Column, dict[str, str]]


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += size(r)
        if chars > BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _summaries(messages: DataFrame, key: str, sequences: list[Sequence_], crossing: list[tuple[int, str]]) -> DataFrame:
    """(key, p, ord, head, n, tail): the summary of each text that belongs to the sequence of pattern p."""
    ords = [F.when(cond, order.cast("bigint")).alias(f"_o{i}") for i, (cond, order, _) in enumerate(sequences)]
    used = sorted({i for i, _ in crossing})
    d = messages.select(F.col(key).cast("string").alias("key"), F.col("content_text").alias("text"), *[ords[i] for i in used])
    d = d.where(F.coalesce(*[F.col(f"_o{i}") for i in used]).isNotNull())
    schema = pa.schema([("key", pa.string()), ("p", pa.int32()), ("ord", pa.int64()), ("head", pa.string()), ("n", pa.int64()), ("tail", pa.string())])
    at = {i: 2 + j for j, i in enumerate(used)}

    def run(batches):
        machines = [(p, at[i], automaton(text)) for p, (i, text) in enumerate(crossing)]

        def each():
            for row in _rows(batches):
                for p, o, machine in machines:
                    if row[o] is not None:
                        yield row[0], p, row[o], *machine.summary(row[1])
        return _in_batches(each(), schema, lambda r: 32 + len(r[3]) + len(r[5] or ""))

    return d.mapInArrow(run, "key string, p int, ord bigint, head string, n bigint, tail string")


def _folded(rows: DataFrame, patterns: list[str], part: list[str], order: str) -> DataFrame:
    """One summary per ``part`` (key and p first), of its rows in ``order``."""
    schema = pa.schema([("key", pa.string()), ("p", pa.int32())] + [(c, pa.int64()) for c in part[2:]]
                       + [("head", pa.string()), ("n", pa.int64()), ("tail", pa.string())])
    k = len(part)

    def run(batches):
        machines = [automaton(p) for p in patterns]

        def each():
            group, running = None, None
            for row in _rows(batches):
                if row[:k] != group:
                    if running is not None:
                        yield *group, *running.summary()
                    group, running = row[:k], Running(machines[row[1]])
                running.add(row[-3:])
            if running is not None:
                yield *group, *running.summary()
        return _in_batches(each(), schema, lambda r: 32 + len(r[-3]) + len(r[-1] or ""))

    by = rows.select(*part, order, "head", "n", "tail").repartition(*part).sortWithinPartitions(*part, order)
    return by.mapInArrow(run, ", ".join(["key string, p int", *[f"{c} bigint" for c in part[2:]], "head string, n bigint, tail string"]))


def joined_counts(messages: DataFrame, key: str, sequences: list[Sequence_]) -> DataFrame:
    """Per ``key``: matches of the patterns of each sequence (condition, integral order, name -> pattern) over its ``content_text``s, joined
    by spaces in that order; null where there is no text. Patterns are case-insensitive; those that the automaton refuses raise
    ValueError here."""
    named = [(i, name, p) for i, (_, _, pats) in enumerate(sequences) for name, p in pats.items()]
    crossing = [(i, name, p) for i, name, p in named if automaton(p).crosses]
    plain = [F.sum(F.when(sequences[i][0], F.regexp_count("content_text", F.lit(FLAGS + p)))).cast("bigint").alias(name)
             for i, name, p in named if (i, name, p) not in crossing]
    own = messages.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), *plain).drop("_rows")
    if not crossing:
        return own
    rows = _summaries(messages, key, sequences, [(i, p) for i, _, p in crossing])
    patterns = [p for _, _, p in crossing]
    chunks = _folded(rows.withColumn("chunk", F.shiftright("ord", chunk_bits())), patterns, ["key", "p", "chunk"], "ord")
    whole = _folded(chunks, patterns, ["key", "p"], "chunk")
    schema = pa.schema([("key", pa.string()), ("p", pa.int32()), ("hits", pa.int64())])

    def totals(batches):
        machines = [automaton(p) for p in patterns]
        return _in_batches(((k, p, machines[p].total((h, n, t))) for k, p, h, n, t in _rows(batches)), schema, lambda r: 32)

    hits = whole.mapInArrow(totals, "key string, p int, hits bigint").groupBy(F.col("key").alias(key)).agg(
        *[F.max(F.when(F.col("p") == j, F.col("hits"))).alias(name) for j, (_, name, _) in enumerate(crossing)])
    return own.join(hits, key, "left")
