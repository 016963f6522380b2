"""Suffix-array dedup of byte strings: remove what is covered by a string of ``width`` bytes that also starts elsewhere.

1. Every text is cut into runs of windows by anchors (anchors.py). Anchors are counted; a window whose anchor occurs once in
   the corpus cannot repeat. Only hashes are shuffled for this.
2. Runs whose anchor repeats with one and the same context repeat as a whole.
3. Otherwise the distinct contexts of an anchor, each once with its number of occurrences, go to one task, where a suffix
   array (suffix_array.py) brings equal windows next to each other. Anchors with very many distinct contexts are split by
   ever longer prefixes of their windows first, so no group grows with the corpus.
4. The repeated windows of each document, as runs, are joined to its text and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.anchors import runs_of_many
from lumenlog.llm.common import groups_by_size, materialize, row_key, sorted_groups, whole_text
from lumenlog.llm.suffix_array import suffix_array

WIDTH = 200
#: bytes of an anchor, as a share of the width
ANCHOR_SHARE = 0.5
#: distinct contexts of one anchor that one task sorts together
GROUP_LIMIT = 4000


def _runs_of(batches, width: int, k: int) -> Iterator[tuple]:
    """Per batch of (_id, _th, text): the arrays (row, h, c, start, n, p) of all runs."""
    for b in batches:
        raw = [np.frombuffer((t or "").encode("utf-8"), np.uint8).astype(np.uint64) for t in b.column(2).to_pylist()]
        found = list(runs_of_many(raw, width, k))
        if found:
            yield (b, *(np.concatenate(x) for x in zip(*found)))


def occurrences(docs: DataFrame, width: int, k: int) -> DataFrame:
    """(h, c, _id, _th, start, np): the runs of all texts; np = windows * 65536 + place of the anchor in the context."""
    def run(batches):
        for b, row, h, c, start, n, p in _runs_of(batches, width, k):
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), b.column(0).take(at), b.column(1).take(at),
                 pa.array(start.astype(np.int32)), pa.array((n * 65536 + p).astype(np.int32))], names=["h", "c", "_id", "_th", "start", "np"])
    return docs.mapInArrow(run, "h long, c long, _id long, _th int, start int, np int")


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def repeated_windows(contexts: list[tuple[bytes, int, int]], width: int, k: int) -> list[np.ndarray]:
    """For (context, occurrences, place of the anchor), distinct contexts of one anchor: which of each context's windows start
    anywhere else too. All windows hold the anchor, the same ``k`` bytes, so one symbol stands for it in the suffix array."""
    flags = [np.full(len(x) - width + 1, many > 1) for x, many, _ in contexts]
    if len(contexts) == 1 or all(f[0] for f in flags):
        return flags
    text, owner, begin = [], [], []
    for number, (x, _, p) in enumerate(contexts):
        begin.append(len(text))
        text += [c + 1 for c in x[:p]]
        text.append(257)
        text += [c + 1 for c in x[p + k:]]
        text.append(0)
        windows = len(x) - width + 1  # all start before the anchor, or with it
        owner += [number] * windows + [-1] * (len(text) - begin[-1] - windows)  # -1: no window starts here
    before = None  # the last window in suffix order: equal windows are neighbours
    for i in suffix_array(text):
        number = owner[i]
        if number < 0:
            continue
        at = i - begin[number]
        window = contexts[number][0][at:at + width]
        if before is not None and before[0] == window:
            flags[number][at] = flags[before[1]][before[2]] = True
        before = (window, number, at)
    return flags


def _cut(texts: DataFrame, width: int) -> DataFrame:
    """(h, c, ctx, many, p): the contexts of the runs in ``spans`` with the anchor's place, equal ones of a batch together."""
    def run(batches):
        for b in batches:
            seen: dict[tuple[int, int], list] = {}
            for t, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = t.encode("utf-8")
                for s in spans:
                    key = (s["h"], s["c"])
                    if key in seen:
                        seen[key][1] += 1
                    else:
                        seen[key] = [raw[s["start"]:s["start"] + (s["np"] >> 16) - 1 + width], 1, s["np"] & 65535]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.int64()),
                 pa.array([v[0] for v in seen.values()], pa.binary()), pa.array([v[1] for v in seen.values()], pa.int64()),
                 pa.array([v[2] for v in seen.values()], pa.int32())], names=["h", "c", "ctx", "many", "p"])
    return texts.mapInArrow(run, "h long, c long, ctx binary, many long, p int")


def _windows(contexts: DataFrame, width: int, prefix: int) -> DataFrame:
    """Each window as a context of its own (column ``at`` tells where), keyed by its first ``prefix`` bytes."""
    def run(batches):
        for b in batches:
            out: list[tuple] = []
            h, c, x, many, p, at = (col.to_pylist() for col in b.columns)
            for i in range(b.num_rows):
                for j in range(len(x[i]) - width + 1):
                    w = x[i][j:j + width]
                    key = np.uint64(xxhash.xxh64_intdigest(w[:prefix], prefix)).view(np.int64)
                    out.append((h[i], c[i], w, many[i], p[i] - j, at[i] + j, int(key)))
            yield pa.RecordBatch.from_arrays([pa.array(list(col), kind) for col, kind in zip(
                zip(*out) if out else [()] * 7, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))],
                names=["h", "c", "ctx", "many", "p", "at", "g"])
    return contexts.mapInArrow(run, "h long, c long, ctx binary, many long, p int, at int, g long")


def _solve(groups: DataFrame, width: int, k: int) -> DataFrame:
    """(h, c, at, len, bits): the repeated windows of the contexts in groups (h, g)."""
    def solve(rows):
        distinct: dict[bytes, int] = {}
        place = dict(zip(rows[2], rows[4]))
        for x, many in zip(rows[2], rows[3]):
            distinct[x] = distinct.get(x, 0) + many
        flags = dict(zip(distinct, repeated_windows([(x, many, place[x]) for x, many in distinct.items()], width, k)))
        return [(h, c, at, flags[x]) for h, c, x, at in zip(rows[0], rows[1], rows[2], rows[5])]

    def emit(done):
        h, c, at, flags = (list(x) for x in zip(*done))
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(at, pa.int32()), pa.array(
            [len(f) for f in flags], pa.int32()), pa.array([bits(f) for f in flags], pa.binary())], names=["h", "c", "at", "len", "bits"])

    return sorted_groups(groups.select("h", "c", "ctx", "many", "p", "at", "g"), solve, emit, "h long, c long, at int, len int, bits binary")


def solve_contexts(contexts: DataFrame, width: int, k: int, group_limit: int) -> DataFrame:
    """(h, c, at, len, bits) for all contexts (h, c, ctx, many, p): small anchors whole, the windows of others by a prefix, and
    the windows of prefixes that are too frequent by themselves."""
    whole, hot = groups_by_size(contexts.withColumns({"at": F.lit(0), "g": F.lit(0).cast("long")}), group_limit)
    out = _solve(whole, width, k)
    if hot is None:
        return out
    windows = materialize(_windows(hot.select("h", "c", "ctx", "many", "p", "at"), width, width * 6 // 10), "windows")
    total = windows.groupBy("h", "g", "ctx").agg(F.sum("many").alias("total"))  # combined before the shuffle
    windows = windows.join(total, ["h", "g", "ctx"]).select("h", "c", "ctx", F.col("total").alias("many"), "p", "at", "g")
    some, rest = groups_by_size(windows, group_limit)
    out = out.union(_solve(some, width, k))
    if rest is None:
        return out
    return out.union(rest.select("h", "c", "at", F.lit(1).alias("len"), F.when(F.col("many") > 1, F.unhex(F.lit("80"))).otherwise(F.unhex(F.lit("00"))).alias("bits")))


def repeated_runs(docs: DataFrame, width: int, k: int, group_limit: int) -> tuple[DataFrame, DataFrame]:
    """(texts, flags) with texts (_id, _th, _t, spans) of the documents that may repeat, spans (start, np, h, c, mixed), and flags
    (h, c, at, len, bits) for the mixed ones."""
    found = occurrences(docs, width, k)
    anchors = found.groupBy("h").agg(F.count(F.lit(1)).alias("many"), F.min("c").alias("lo"), F.max("c").alias("hi")).where(
        "many > 1").select("h", F.expr("lo <> hi").alias("mixed"))
    hits = found.join(materialize(anchors, "anchors"), "h")
    spans = hits.groupBy("_id", "_th").agg(F.collect_set(F.struct("start", "np", "h", "c", "mixed")).alias("spans"))
    texts = materialize(docs.join(spans, ["_id", "_th"]), "texts")
    mixed = F.filter("spans", lambda s: s["mixed"])
    contexts = _cut(texts.select("_t", mixed.alias("m")).where("size(m) > 0"), width)
    contexts = materialize(contexts.groupBy("h", "c").agg(F.first("ctx").alias("ctx"), F.sum("many").alias("many"), F.first("p").alias("p")), "contexts")
    return texts, solve_contexts(contexts, width, k, group_limit)


def removed_runs(texts: DataFrame, flags: DataFrame) -> DataFrame:
    """(_id, _th, known): the answers (start, at, len, bits) for the mixed runs of each document."""
    want = texts.select("_id", "_th", F.inline(F.filter("spans", lambda s: s["mixed"])))
    return want.join(flags, ["h", "c"]).groupBy("_id", "_th").agg(
        F.collect_set(F.struct("start", "at", "len", "bits")).alias("known"))


def cut_out(raw: bytes, whole: list[tuple[int, int]], known: list[tuple[int, int, int, bytes]], width: int) -> tuple[int, int, bytes]:
    """(removed bytes, maximal removed runs, the rest). whole: runs of windows (start, n) that repeat; known: flagged windows."""
    step = np.zeros(len(raw) + 1, np.int64)
    for start, n in whole:
        step[start] += 1
        step[start + n - 1 + width] -= 1
    for start, at, size, packed in known:
        on = np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), count=size)) + start + at
        np.add.at(step, on, 1)
        np.add.at(step, on + width, -1)
    gone = np.cumsum(step[:-1]) > 0
    n_runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), n_runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, width: int = WIDTH, group_limit: int = GROUP_LIMIT, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary; null if nothing was removed): a row per row of ``docs``.

    Each byte covered by a string of ``width`` bytes that also starts anywhere else (in any document, the same one included, also
    overlapping) is removed; strings are judged on the input. Null text is empty; texts shorter than ``width`` keep all;
    repeated rows are copies of each other, also if they share a doc_id; rows without doc_id are told apart by
    their text; an empty table gives an empty result; other columns are ignored."""
    keyed = docs.select(*row_key(id_col, text_col), whole_text(text_col).alias("_t"))
    texts, flags = repeated_runs(keyed, width, max(1, int(width * ANCHOR_SHARE)), group_limit)
    known = removed_runs(texts, flags)
    whole = F.transform(F.filter("spans", lambda s: ~s["mixed"]), lambda s: F.struct(s["start"], F.shiftright(s["np"], 16).alias("n")))
    todo = texts.dropDuplicates(["_id", "_th"]).select("_id", "_th", "_t", whole.alias("whole")).join(
        known, ["_id", "_th"], "left")

    def run(batches):
        for b in batches:
            out = []
            for t, w, known in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                out.append(cut_out(t.encode("utf-8"), [tuple(x.values()) for x in w], [tuple(x.values()) for x in known or ()], width))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                 pa.array([x[2] for x in out], pa.binary()), pa.array([sha256(x[2]).hexdigest() for x in out], pa.string())],
                names=["_id", "_th", "r", "s", "kept", "sha"])

    cleaned = todo.mapInArrow(run, "_id long, _th int, r long, s long, kept binary, sha string").where("r > 0")
    text = whole_text(text_col)
    return (docs.select(*row_key(id_col, text_col), F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                        F.sha2(text, 256).alias("same")).join(cleaned, ["_id", "_th"], "left")
            .select("doc_id", "n_bytes", F.coalesce("r", F.lit(0)).alias("n_removed"), F.coalesce("s", F.lit(0)).alias("n_spans"),
                    F.coalesce("sha", "same").alias("kept_sha256"), "kept"))
