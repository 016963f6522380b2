"""Substring dedup with prefix-partitioned suffix trees over words: remove what an earlier document already says.

1. Every text is cut into runs of word windows by anchors (anchors.py). An anchor that only one document has rules its windows out;
   only hashes are shuffled for this.
2. Where all contexts of an anchor are the same, the least doc_id that has it decides.
3. Otherwise the distinct contexts of an anchor, each with the least doc_id that has it, go to one task, which builds the
   suffix tree of their windows down to the window's depth. An internal node at that depth is a repeat, and the least doc_id
   below it decides. Prefixes vary in length so that every tree fits in memory: an anchor with very many contexts is
   split by the first words of its windows, and a prefix that is still too frequent by the whole window.
4. The windows that lose, as runs, are joined to the texts of their documents and cut out.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.anchors import _tables, mix, runs_of_many
from lumenlog.llm.common import groups_by_size, materialize, release_shuffles, row_key, sorted_groups, whole_text

WIDTH = 13
#: words of an anchor, as a share of the width: shorter ones are fewer (2 in 14 - k words) but shared by more texts
ANCHOR_SHARE = 0.32
#: words of the first prefix that splits a large anchor, as a share of the width
PREFIX_SHARE = 0.6
#: distinct contexts of one anchor that one task holds in a tree (about 100 MB)
GROUP_LIMIT = 50_000
#: bytes of texts that are hashed together
GROUP_BYTES = 1 << 20
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8").split()


def word_symbols(texts: list[str | None]) -> list[np.ndarray]:
    """The words of each text as 64-bit hashes. Texts are laid side by side and hashed together, GROUP_BYTES at a time; one that
    is longer than that is taken word by word."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for raw in ((t or "").encode("utf-8") for t in texts):
        if held and size + len(raw) > GROUP_BYTES:
            out += _hashed(held)
            held, size = [], 0
        if len(raw) > GROUP_BYTES:
            words = raw.split()
            known = {w: _hashed([w])[0][0] for w in set(words)}
            out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        else:
            held.append(raw)
            size += len(raw) + 1
    return out + _hashed(held)


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    if not texts:
        return []
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    blank = BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # a word begins, ends, begins, ...
    start, end = edge[::2], edge[1::2]
    up, down = _tables(len(raw) + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], dtype=np.uint64)])
    h = mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    begin = np.cumsum([1] + [len(t) + 1 for t in texts])
    at = np.searchsorted(start, begin).tolist()
    return [h[a:b] for a, b in zip(at, at[1:])]


def occurrences(docs: DataFrame, width: int, k: int, places: bool = True) -> DataFrame:
    """(h, c, _id, _th, at): the runs of all texts, at = first window * 65536 + windows; without ``places`` (h, c, _id) only."""
    def run(batches):
        for b in batches:
            texts = word_symbols(b.column(2).to_pylist())
            found = list(runs_of_many(texts, width, k))
            if found:
                row, h, c, start, n, _ = (np.concatenate(x) for x in zip(*found))
                at = pa.array(row)
                c = c if places else c >> np.uint64(16)  # counted only: 48 bits tell an anchor's contexts apart
                cols = [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), b.column(0).take(at)]
                if places:
                    cols += [b.column(1).take(at), pa.array(start.astype(np.int64) * 65536 + n)]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "c", "_id", "_th", "at"][:len(cols)])
    return docs.mapInArrow(run, "h long, c long, _id long" + ", _th int, at long" * places)


def window_owners(contexts: list[tuple[list[bytes], int]], width: int) -> list[np.ndarray]:
    """For (words, doc_id) pairs: the least doc_id that has each of a context's windows. The suffix tree of all windows is
    built from the root, node by node; a node's edge is as long as its suffixes agree, and only nodes of two or more
    suffixes go deeper, so the work ends where suffixes are unique or ``width`` words deep."""
    low = [np.full(len(x) - width + 1, doc) for x, doc in contexts]
    nodes = [([(i, j) for i, f in enumerate(low) for j in range(len(f))], 0)]
    while nodes:
        suffixes, depth = nodes.pop()
        if depth >= width:  # a deep internal node: a repeat
            least = min(low[i][j] for i, j in suffixes)
            for i, j in suffixes:
                low[i][j] = least
            continue
        children: dict[bytes, list[tuple[int, int]]] = {}
        for i, j in suffixes:
            children.setdefault(contexts[i][0][j + depth], []).append((i, j))
        for below in children.values():
            if len(below) < 2:
                continue
            edge, (i0, j0) = depth + 1, below[0]
            first = contexts[i0][0]
            while edge < width and all(contexts[i][0][j + edge] == first[j0 + edge] for i, j in below):
                edge += 1
            nodes.append((below, edge))
    return low


def _cut(texts: DataFrame, width: int) -> DataFrame:
    """(h, c, ctx, low): the contexts of the runs in ``spans``; ctx: its words joined by a space."""
    def run(batches):
        for b in batches:
            seen: dict[tuple[int, int], list] = {}
            for doc, t, spans in zip(*(x.to_pylist() for x in b.columns)):
                words = words_of(t)
                for s in spans:
                    key = (s["h"], s["c"])
                    if key in seen:
                        seen[key][1] = min(doc, seen[key][1])
                    else:
                        seen[key] = [b" ".join(words[s["start"]:s["start"] + s["n"] - 1 + width]), doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.int64()),
                 pa.array([v[0] for v in seen.values()], pa.binary()), pa.array([v[1] for v in seen.values()], pa.int64())],
                names=["h", "c", "ctx", "low"])
    return texts.mapInArrow(run, "h long, c long, ctx binary, low long")


def _windows(contexts: DataFrame, width: int, prefix: int) -> DataFrame:
    """Each window as a context of its own, keyed by its first ``prefix`` words."""
    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for h, c, x, low, at in zip(*(col.to_pylist() for col in b.columns)):
                words = x.split()
                for j in range(len(words) - width + 1):
                    key = np.uint64(xxhash.xxh64_intdigest(b" ".join(words[j:j + prefix]), prefix)).view(np.int64)
                    out.append((h, c, b" ".join(words[j:j + width]), low, at + j, int(key)))
            yield pa.RecordBatch.from_arrays([pa.array(list(col), kind) for col, kind in zip(
                zip(*out) if out else [()] * 6, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()))],
                names=["h", "c", "ctx", "low", "at", "g"])
    return contexts.mapInArrow(run, "h long, c long, ctx binary, low long, at int, g long")


def _solve(groups: DataFrame, width: int) -> DataFrame:
    """(h, c, at, lows): the least doc_id of each window of the contexts in groups (h, g)."""
    def solve(rows):
        distinct: dict[bytes, int] = {}
        for x, low in zip(rows[2], rows[3]):
            distinct[x] = min(low, distinct.get(x, low))
        found = dict(zip(distinct, window_owners([(x.split(), low) for x, low in distinct.items()], width)))
        return list(zip(rows[0], rows[1], rows[4], (found[x].tolist() for x in rows[2])))

    def emit(done):
        h, c, at, lows = (list(x) for x in zip(*done))
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(at, pa.int32()),
                                           pa.array(lows, pa.list_(pa.int64()))], names=["h", "c", "at", "lows"])

    return sorted_groups(groups.select("h", "c", "ctx", "low", "at", "g"), solve, emit, "h long, c long, at int, lows array<long>")


def solve_contexts(contexts: DataFrame, width: int, group_limit: int) -> DataFrame:
    """(h, c, at, lows) for all contexts (h, c, ctx, low)."""
    whole, hot = groups_by_size(contexts.withColumns({"at": F.lit(0), "g": F.lit(0).cast("long")}), group_limit)
    out = _solve(whole, width)
    if hot is None:
        return out
    windows = materialize(_windows(hot.select("h", "c", "ctx", "low", "at"), width, max(1, int(width * PREFIX_SHARE))), "windows")
    least = windows.groupBy("h", "g", "ctx").agg(F.min("low").alias("least"))  # combined before the shuffle
    windows = windows.join(least, ["h", "g", "ctx"]).select("h", "c", "ctx", F.col("least").alias("low"), "at", "g")
    some, rest = groups_by_size(windows, group_limit)
    out = out.union(_solve(some, width))
    return out if rest is None else out.union(rest.select("h", "c", "at", F.array("low").alias("lows")))


def cut_out(words: list[bytes], windows: np.ndarray, width: int) -> tuple[int, bytes]:
    """(removed words, the rest joined by a space)."""
    step = np.zeros(len(words) + 1, np.int64)
    windows = np.unique(windows)
    step[windows] += 1
    step[windows + width] -= 1
    gone = np.cumsum(step[:-1]) > 0
    return int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def remove_repeats(docs: DataFrame, width: int = WIDTH, group_limit: int = GROUP_LIMIT, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (binary: the words that stay, joined by a space): a row per row of ``docs``.

    Each word covered by a window of ``width`` words whose sequence also starts in a document with a smaller doc_id is removed;
    windows are judged on the input. Null text has no words; texts shorter than ``width`` words keep all; rows that share
    a doc_id do not cost each other anything and are told apart by their text; a row without doc_id has no place
    in the order: it loses nothing and costs no other row anything; an empty table gives an empty result; other
    columns are ignored."""
    keyed = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("_t"))
    known_id = keyed.where("doc_id IS NOT NULL").select("_id", "_th", "_t")
    k = max(1, int(width * ANCHOR_SHARE))
    anchors = occurrences(known_id, width, k, places=False).groupBy("h").agg(F.min("_id").alias("low"), F.max("_id").alias("high"), F.min("c").alias("a"), F.max("c").alias("b")).where(
        "low < high").select("h", "low", F.expr("a <> b").alias("mixed"))
    anchors = materialize(anchors, "anchors")
    release_shuffles(docs.sparkSession)
    hits = occurrences(known_id, width, k).join(anchors, "h").where("mixed OR _id > low")
    # where all contexts are the same the hashes have done their work
    hashes = [F.when(F.col("mixed"), F.col(x)).alias(x) for x in ("h", "c")]
    spans = hits.groupBy("_id", "_th").agg(F.collect_set(F.struct(
        F.expr("CAST(at div 65536 AS INT)").alias("start"), F.expr("CAST(at % 65536 AS INT)").alias("n"), *hashes, "mixed")).alias("spans"))
    # written before the texts are shuffled: the occurrences' shuffle files, the largest of all, are gone by then
    spans = materialize(spans, "spans")
    release_shuffles(docs.sparkSession)
    texts = materialize(known_id.join(spans, ["_id", "_th"]), "texts")
    release_shuffles(docs.sparkSession)

    mixed = F.filter("spans", lambda s: s["mixed"])
    contexts = _cut(texts.select("_id", "_t", mixed.alias("m")).where("size(m) > 0"), width)
    contexts = materialize(contexts.groupBy("h", "c").agg(F.first("ctx").alias("ctx"), F.min("low").alias("low")), "contexts")
    release_shuffles(docs.sparkSession)
    lows = solve_contexts(contexts, width, group_limit)
    lost = (texts.select("_id", "_th", F.inline(mixed)).join(lows, ["h", "c"])
            .select("_id", "_th", (F.col("start") + F.col("at")).alias("start"), F.transform("lows", lambda x: x < F.col("_id")).alias("on"))
            .where("exists(on, x -> x)").groupBy("_id", "_th").agg(F.collect_set(F.struct("start", "on")).alias("known")))
    whole = F.transform(F.filter("spans", lambda s: ~s["mixed"]), lambda s: F.struct(s["start"], s["n"]))
    todo = texts.select("_id", "_th", "_t", whole.alias("whole")).dropDuplicates(["_id", "_th"]).join(lost, ["_id", "_th"], "left")

    def cut(batches):
        for b in batches:
            out = []
            for t, full, known in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                at = [np.arange(x["start"], x["start"] + x["n"]) for x in full]
                at += [x["start"] + np.flatnonzero(x["on"]) for x in known or ()]
                out.append(cut_out(words_of(t), np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64), width))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())],
                names=["_id", "_th", "r", "kept"])

    def plain(batches):
        for b in batches:
            words = [words_of(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([len(w) for w in words], pa.int64()),
                 pa.array([sha256(b" ".join(w)).hexdigest() for w in words], pa.string())], names=["_id", "_th", "doc_id", "n_words", "same"])

    cleaned = todo.mapInArrow(cut, "_id long, _th int, r long, kept binary").where("r > 0")
    return (keyed.mapInArrow(plain, "_id long, _th int, doc_id long, n_words long, same string")
            .join(cleaned, ["_id", "_th"], "left").select(
                "doc_id", "n_words", F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("r", F.lit(0))).cast("long").alias("n_removed"),
                F.when(F.col("doc_id").isNotNull() & F.col("r").isNotNull(), F.sha2("kept", 256)).otherwise(F.col("same")).alias("kept_sha256"),
                F.when(F.col("doc_id").isNotNull(), F.col("kept")).alias("kept")))
