"""SimHash near-dedup: a binary trie self-join over distinct fingerprints.

1. One pass over the texts gives a 64-bit fingerprint per document; equal ones collapse.
2. Two fingerprints within d bits agree on at least one of d + 1 bit blocks, so the trie is dealt by
   (block, value). Inside a task all its groups are walked at once, level by level, as pairs of trie
   nodes (ranges of the sorted keys): each pair carries the bits that differ so far and is dropped beyond
   the budget. Pairs whose leaves already hang together are dropped too, so a group of m near copies costs a
   spanning tree, not m * m links.
3. A (block, value) with very many fingerprints is split into pairs of second-level nodes.
4. The links (a forest per task) meet in distributed connected components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import connected_components, drop_models, materialize, row_key

BITS = 64
#: fingerprints of one (block, value) that one task walks; larger groups are dealt by pairs of sub-nodes
GROUP_LIMIT = 1_000_000
SUB_BITS = 8
#: trie node pairs held at once
FRONTIER = 1 << 20
CHUNK = 1 << 16
U1 = np.uint64(1)


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the ``width``-word shingles, repeats included. A-Z are lower-cased, words are runs without
    ASCII white space; a shorter text is one shingle; no word at all gives 0. Linear in the text."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII rules for both
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    stops = ends[width - 1:] if len(words) >= width else ends[-1:]
    ones = np.zeros(BITS, np.int64)
    start, digest = 0, xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):  # bounded memory for very long texts
        hashes = []
        for i, stop in zip(range(at, min(at + CHUNK, n)), stops[at:at + CHUNK].tolist()):
            hashes.append(digest(joined[start:stop], 42))
            start += len(words[i]) + 1
        raw = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _id, _th, fp): fp is the fingerprint as a signed 64-bit integer, _id and _th are the row's identity."""
    def run(batches):
        drop_models()
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(3).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps)], names=["doc_id", "_id", "_th", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, _id long, _th int, fp long")


def blocks_of(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the max_bits + 1 blocks."""
    cuts = [BITS * i // (max_bits + 1) for i in range(max_bits + 2)]
    return list(zip(cuts, np.diff(cuts).tolist()))


def trie_links(keys: np.ndarray, roots: np.ndarray, budget: int, depth: int) -> np.ndarray:
    """Pairs of positions in ``keys``, a spanning forest of the links within ``budget`` bits.

    ``keys`` (uint64) are sorted inside every root; the first ``depth`` bits are settled. ``roots``: rows
    (lo1, hi1, lo2, hi2, differing bits so far); a node paired with itself has equal ranges."""
    n = len(keys)
    label = np.arange(n)
    # zeros[d][i]: keys before i whose bit d is 0; made as a level is first needed
    zeros: dict[int, np.ndarray] = {}

    def split(d, lo, hi):
        if d not in zeros:
            bit = (keys >> np.uint64(BITS - 1 - d)) & U1
            zeros[d] = np.concatenate([[0], np.cumsum(bit == 0)])
        return lo + zeros[d][hi] - zeros[d][lo]

    links = []
    stack = [(depth, roots)]
    changes = np.arange(n)  # label changes up to i: equal at both ends of a range that hangs together
    while stack:
        d, p = stack.pop()
        if len(p) > FRONTIER:  # bounded memory: one half after the other
            stack += [(d, p[len(p) // 2:]), (d, p[:len(p) // 2])]
            continue
        one = (changes[p[:, 1] - 1] == changes[p[:, 0]]) & (changes[p[:, 3] - 1] == changes[p[:, 2]])
        p = p[~(one & (label[p[:, 0]] == label[p[:, 2]]))]
        if not len(p):
            continue
        if d == BITS:
            a, b = p[:, 0], p[:, 2]
            # leaves can repeat a link that an earlier pair of this chunk made: keep a forest
            keep, label = forest(a, b, label)
            links.append(np.stack([a[keep], b[keep]], axis=1))
            changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            continue
        l1, h1, l2, h2, diff = p.T
        m1, m2 = split(d, l1, h1), split(d, l2, h2)
        own = l1 == l2
        more = diff + 1
        kids = [np.stack(x, axis=1) for x in ((l1, m1, l2, m2, diff), (m1, h1, m2, h2, diff), (l1, m1, m2, h2, more))]
        cross = np.stack((m1, h1, l2, m2, more), axis=1)[~own]
        kids = np.concatenate([*kids, cross])
        ok = (kids[:, 4] <= budget) & (kids[:, 1] > kids[:, 0]) & (kids[:, 3] > kids[:, 2])
        ok &= (kids[:, 0] != kids[:, 2]) | (kids[:, 1] - kids[:, 0] > 1)  # a single key paired with itself
        if ok.any():
            stack.append((d + 1, kids[ok]))
    return np.concatenate(links) if links else np.zeros((0, 2), np.int64)


def forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the links (a, b) join two parts, in turn, and the new labels. Each round every part takes
    one link to a smaller part."""
    label = label.copy()
    kept = np.zeros(len(a), bool)
    while True:
        x, y = label[a], label[b]
        open_ = np.flatnonzero(x != y)
        if not len(open_):
            return kept, label
        hi, lo = np.maximum(x[open_], y[open_]), np.minimum(x[open_], y[open_])
        _, at = np.unique(hi, return_index=True)  # one link per larger part: no cycle, as labels only fall
        kept[open_[at]] = True
        parent = np.arange(len(label))
        parent[hi[at]] = lo[at]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def fingerprint_links(fps: DataFrame, max_bits: int = 4, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) with at most ``max_bits`` differing bits;
    a spanning forest of them per task, with the same components as all of them."""
    blocks = blocks_of(max_bits)
    ublock = F.array(*[F.struct(F.lit(i).alias("i"), F.expr(
        f"shiftrightunsigned(fp, {BITS - at - w}) & {(1 << w) - 1}L").alias("v"),
        # the bits after the block, wrapping round
        F.expr(f"shiftrightunsigned(shiftleft(fp, {(at + w) % BITS}) | shiftrightunsigned(fp, {(BITS - at - w) % BITS}), "
               f"{BITS - SUB_BITS})" if (at + w) % BITS else f"shiftrightunsigned(fp, {BITS - SUB_BITS})").alias("sub"))
        for i, (at, w) in enumerate(blocks)])
    dealt = fps.select("fp", F.explode(ublock).alias("_b")).select("fp", "_b.*")
    hot = dealt.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_limit)
    masks = [m for m in range(1 << SUB_BITS) if bin(m).count("1") <= max_bits]
    pair = F.transform(F.array(*map(F.lit, masks)), lambda m: F.expr("sub").bitwiseXOR(m))
    part = F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(
        F.transform(pair, lambda q: F.least(F.col("sub"), q).cast("int") * (1 << SUB_BITS) + F.greatest(F.col("sub"), q).cast("int")))
    dealt = dealt.join(hot, ["i", "v"], "left").select("i", "v", F.explode(part).alias("part"), "fp")

    def run(batches):
        held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) for b in batches if b.num_rows]
        if not held:
            return
        rows = np.concatenate(held)
        i, part = rows[:, 0], rows[:, 2]
        fp = rows[:, 3].astype(np.int64).view(np.uint64)
        for k, (at, w) in enumerate(blocks):
            mine = i == k
            if not mine.any():
                continue
            f, v, q = fp[mine], rows[mine, 1], part[mine]
            turn = np.uint64(at)  # the block first: every group is then one trie node at depth w
            key = (f << turn) | (f >> np.uint64(BITS - at)) if at else f
            order = np.lexsort((key, q, v))
            f, v, q, key = f[order], v[order], q[order], key[order]
            cut = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (q[1:] != q[:-1])]))
            ends = np.append(cut[1:], len(f))
            roots = []
            for lo, hi, p in zip(cut.tolist(), ends.tolist(), q[cut].tolist()):
                if hi - lo < 2:
                    continue
                if p < 0 or (p >> SUB_BITS) == (p & ((1 << SUB_BITS) - 1)):
                    roots.append((lo, hi, lo, hi, 0))
                else:  # two second-level nodes that differ: both halves of the range, sorted by their bits
                    sub = (key[lo:hi] >> np.uint64(BITS - w - SUB_BITS)) & np.uint64((1 << SUB_BITS) - 1)
                    mid = lo + int(np.searchsorted(sub, p & ((1 << SUB_BITS) - 1)))
                    if lo < mid < hi:
                        roots.append((lo, mid, mid, hi, 0))
            if roots:
                got = trie_links(key, np.array(roots, np.int64), max_bits, w)
                if len(got):
                    x, y = f[got[:, 0]].view(np.int64), f[got[:, 1]].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "i", "v", "part").mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 4, max_bits: int = 4, group_limit: int = GROUP_LIMIT,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of ``docs``.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked; component_id is the smallest
    doc_id reachable over links. Null and empty texts have fingerprint zero and are linked like any other.
    Rows without doc_id have a fingerprint and link others, but never name a component (null where no row of it has a
    doc_id). Repeated rows get the same result each. An empty table gives an empty result; other
    columns are ignored."""
    of = _with_roots(docs, width, max_bits, group_limit, id_col, text_col)
    # written, so that both sides of the next join are plain exchanges and a large component can be split there
    first = materialize(of.groupBy("root").agg(F.min("doc_id").alias("component_id")), "first")
    return of.join(first, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_roots(docs: DataFrame, width: int, max_bits: int, group_limit: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, _id, _th, fp, root): the rows of ``docs`` with the smallest fingerprint they hang together with."""
    fps = materialize(fingerprints(docs, width, id_col, text_col), "fps")
    roots = connected_components(fingerprint_links(fps.select("fp").distinct(), max_bits, group_limit))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def representatives(docs: DataFrame, width: int = 4, max_bits: int = 4, group_limit: int = GROUP_LIMIT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, unchanged: that of the smallest id (rows without one last), of rows that share it that
    of the smallest digest of the text, and one of equal rows (which one is open: they are told apart by other columns only).

    Null, empty and repeated texts, missing and repeated ids and an empty table follow simhash_groups()."""
    of = _with_roots(docs, width, max_bits, group_limit, id_col, text_col)
    alike = of.groupBy("root", "doc_id", "_id", "_th").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_id", "_th", "n")
    best = materialize(alike.groupBy("root").agg(F.min(order).alias("k")).select("k._id", "k._th", "k.n"), "best")
    kept = docs.withColumn("_row", F.struct("*")).select("_row", *row_key(id_col, text_col)).join(best, ["_id", "_th"])
    if best.where("n > 1").isEmpty():
        return kept.select("_row.*")
    return kept.where("n = 1").select("_row.*").unionByName(kept.where("n > 1").dropDuplicates(["_id", "_th"]).select("_row.*"))
