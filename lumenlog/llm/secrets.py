"""Secret scan with multipart credential linking.

One pass over the texts finds the base spans (assigned secrets, access keys, long hex strings) and weaker parts: client or
user identifiers, short tokens, endpoints. Weak parts are reported only where complementary parts co-occur: parts become rows
and an interval join inside their scope (document, then buckets of the scope's width, so a document with many parts is split)
finds what lies within ``scope`` characters. Starts of one kind are distinct, so a bucket holds a bounded number of parts.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import materialize, row_key, whole_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of at least 24
#: weak parts
IDENTITY = re.compile(r"""\b(?:client_?id|account_?id|access_?key_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.I | re.A)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
ENDPOINT = re.compile(r"""\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s?ftp|s3)://[^\s"'<>]+"""
                      r"|(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?(?!\w)"
                      r"|(?<![\w.@-])(?:[a-z0-9-]+\.)+(?:com|net|org|io|dev|cloud|local)(?::[0-9]+)?\b", re.A)
KINDS = ["assign", "access", "hex", "identity", "token", "endpoint"]
ROLES = {"assign": "secret", "access": "identity", "hex": "secret", "identity": "identity", "token": "secret", "endpoint": "endpoint"}
SCOPE = 200


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), by start and kind; code points, end exclusive."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def weak_parts(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Parts that are no evidence by themselves, without those that overlap a base span or a stronger part."""
    found = [(m.start(), "identity", m.end()) for m in IDENTITY.finditer(text)]
    found += [(m.start(), "endpoint", m.end()) for m in ENDPOINT.finditer(text)]
    found += [(m.start(), "token", m.end()) for m in TOKEN.finditer(text)
              if re.search(r"[0-9]", m.group()) and re.search(r"[A-Za-z]", m.group())]
    order = sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))
    out, taken, at = [], sorted((a, b) for a, _, b in base), 0
    reach = -1
    for a, kind, b in order:
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= reach and not (at < len(taken) and taken[at][0] < b):
            out.append((a, kind, b))
            reach = b
    return out


def spans_text(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _id, _th, n_assign, n_access, n_hex, base_sha256, base, weak (arrays of start, kind, end): one row per row."""
    part = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches):
        def rows(found):
            return pa.array([[dict(zip(("start", "kind", "end"), x)) for x in f] for f in found], part)
        for b in batches:
            texts = b.column(3).to_pylist()
            base = [base_spans(t) for t in texts]
            weak = [weak_parts(t, f) for t, f in zip(texts, base)]
            counts = [pa.array([sum(x[1] == k for x in f) for f in base], pa.int64()) for k in KINDS[:3]]
            digest = [sha256(spans_text(f).encode()).hexdigest() for f in base]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *counts, pa.array(digest, pa.string()), rows(base), rows(weak)], names=[
                "doc_id", "_id", "_th", "n_assign", "n_access", "n_hex", "base_sha256", "base", "weak"])

    spans = "array<struct<start:bigint,kind:string,end:bigint>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), whole_text(text_col).alias("_t")).mapInArrow(
        run, f"doc_id long, _id long, _th int, n_assign long, n_access long, n_hex long, base_sha256 string, base {spans}, weak {spans}")


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(_id, _th, linked): the weak parts with complementary parts at most ``scope`` characters away. A token needs an
    identity or an endpoint, an identity a secret, an endpoint both an identity and a secret."""
    key = ["_id", "_th"]
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])

    def rows(col):
        return found.select(*key, F.inline(col)).distinct()
    weak = rows("weak").withColumn("b", F.expr(f"explode(sequence(start div {scope} - 1, end div {scope} + 1))"))
    parts = rows("base").union(rows("weak")).select(
        *key, F.col("start").alias("s"), F.col("end").alias("e"), role[F.col("kind")].alias("role"),
        # a long part lies in every bucket it touches
        F.expr(f"explode(sequence(start div {scope}, (end - 1) div {scope}))").alias("b"))
    near = weak.join(parts, [*key, "b"]).where((F.col("s") <= F.col("end") + scope) & (F.col("start") <= F.col("e") + scope))
    has = {r: F.max(F.col("role") == r).alias(r) for r in ("identity", "secret", "endpoint")}
    rule = ("CASE kind WHEN 'token' THEN identity OR endpoint WHEN 'identity' THEN secret ELSE identity AND secret END")
    return (near.groupBy(*key, "start", "kind", "end").agg(*has.values()).where(rule)
            .groupBy(*key).agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked")))


def secret_scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of ``docs``.

    ``spans``: kind:start:end of the base spans and of the linked weak parts, by start, then kind. Null and empty texts have none.
    Repeated rows get the same result each, rows without doc_id are told apart by their text, an empty table gives an empty
    result, other columns are ignored."""
    found = materialize(scan(docs, id_col, text_col), "parts")  # spans only, no text
    order = F.array(*map(F.lit, KINDS))
    spans = F.concat("base", F.coalesce("linked", F.slice("weak", 1, 0)))
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("a"), F.array_position(order, s["kind"]).alias("n"), s["end"].alias("e"), s["kind"].alias("k"))))
    text = F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["e"].cast("string"))), ",")
    return found.join(link(found, scope), ["_id", "_th"], "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"))
