"""Lempel-Ziv phrase fingerprints.

A text is parsed left to right into dictionary phrases (the longest phrase seen so far
plus one character, LZ78 over UTF-8 bytes of whole texts).  The set of phrases is hashed
and its ``SIZE`` smallest hash values are the signature; likeness of two signatures is
the bottom-k estimate of the Jaccard index of the phrase sets, which follows shared
compressible content.  A signature of fewer values than ``SIZE`` is the whole set, so
its likeness is exact.

Defined cases: null and empty texts have no phrase and the fingerprint "" (likeness 1 to
each other, 0 to others); equal texts have equal fingerprints; in ``op3`` rows are
ordered by (doc_id, text), null ids first, and the next of the last row is the first
(a single row is its own next); extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SIZE = 128
RANGE_BYTES, MOST_RANGES = 64 << 20, 20_000  # text of a range, unless that made more ranges than these


class Parse:
    """LZ78 parse state of a byte string that can be continued from any byte."""

    __slots__ = ("ends", "known", "node", "at")

    def __init__(self):
        self.known: dict[int, int] = {}
        self.ends: list[int] = []
        self.node = 0
        self.at = 0

    def feed(self, data: bytes) -> None:
        known, node, ends, at = self.known, self.node, self.ends, self.at
        get, end = known.get, ends.append
        for i, b in enumerate(data, at + 1):
            key = node << 8 | b
            node = get(key)
            if node is None:
                end(i)
                known[key] = len(ends)
                node = 0
        self.node, self.at = node, at + len(data)


def signature(data: np.ndarray, ends: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The smallest 32-bit hashes of the phrases that end at ``ends`` (the open rest is the last phrase)."""
    if not len(data):
        return np.zeros(0, np.uint32)
    if not len(ends) or ends[-1] < len(data):
        ends = np.append(ends, len(data))
    starts = np.concatenate([[0], ends[:-1]])
    h = (C.span_hash(data, starts, ends) >> np.uint64(32)).astype(np.uint32)
    return np.unique(h)[:size]


def text_of(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Bottom-k estimate of the Jaccard index; 1 for two empty signatures."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:size]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right")) / len(union)


def _parse(data: bytes) -> tuple[Parse, np.ndarray]:
    p = Parse()
    p.feed(data)
    return p, np.array(p.ends, np.int64)


def fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, fingerprint of every whole text."""

    def run(batches):
        for b in C.chunks(batches):
            out = []
            for t in b.column(1).to_pylist():
                raw = (t or "").encode()
                out.append(text_of(signature(np.frombuffer(raw, np.uint8), _parse(raw)[1], size)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return C.columns_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _signed(text: str, follower: str, size: int):
    """(signature, edited text's bytes, edited signature): the edit keeps the first characters,
    so the parse of the kept part is run once and continued for both texts."""
    n = len(text)
    cut = n - n // 4
    head, tail, new = text[:cut].encode(), text[cut:].encode(), follower[: n // 4].encode()
    p = Parse()
    p.feed(head)
    known, ends, node = dict(p.known), list(p.ends), p.node
    p.feed(tail)
    whole = signature(np.frombuffer(head + tail, np.uint8), np.array(p.ends, np.int64), size)
    p.known, p.ends, p.node, p.at = known, ends, node, len(head)
    p.feed(new)
    edited = head + new
    return whole, edited, signature(np.frombuffer(edited, np.uint8), np.array(p.ends, np.int64), size)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Fingerprints of each text, its edit by the next document, and their likeness.

    Documents are range-partitioned by doc_id; each range also gets the first document of
    the next non-empty one (the last gets the first of all), so a next document is at hand
    without a global sort in one task.
    """
    spark = docs.sparkSession
    d = C.columns_of(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = min(max(C.parts(spark, 12), total // RANGE_BYTES), MOST_RANGES)
    edges = d.select("k").agg(F.percentile_approx("k", F.array(*[F.lit(i / n) for i in range(1, n)]), 10000)).first()[0]
    edges = sorted(set(edges or []))  # at most n ids
    part = C.below(edges, F.col("k"), strict=True)
    first = {r.p: r.k for r in d.select(part.alias("p"), "k").groupBy("p").agg(F.min("k").alias("k")).collect()}  # one row per range
    if not first:
        return spark.createDataFrame([], OUT)
    full = sorted(first)
    before = {first[p]: full[i - 1] for i, p in enumerate(full)}  # the first id of a range also goes to the range before
    extra = F.create_map(*[F.lit(v) for kv in before.items() for v in kv])[F.col("k")]
    dealt = d.withColumn("p", part).withColumn("q", F.explode(F.array_compact(F.array(F.struct(F.col("p").alias("p"), F.lit(0).alias("guest")), F.when(extra.isNotNull(), F.struct(extra.alias("p"), F.lit(1).alias("guest")))))))
    dealt = dealt.select("q.p", "q.guest", "k", "doc_id", "text")
    ranges = max(full) + 1
    own = C.labels(spark, ranges, ranges).tolist()  # a range to each task; a plain hash would give some several
    dealt = dealt.withColumn("p", F.get(F.expr(f"array({', '.join(map(str, own))})"), F.col("p")))
    dealt = dealt.repartition(ranges, "p").sortWithinPartitions("p", "guest", "k", "text")

    def run(batches):
        held = None  # the row that waits for its next
        part_no, guests = None, 0
        rows: list[list] = [[] for _ in range(7)]

        def put(row, follower, sig_next=None):
            doc, text = row
            whole, edited, sig2 = _signed(text, follower, size)
            return whole, (doc, len(text), hashlib.sha256(edited).hexdigest(), text_of(whole), text_of(sig2), likeness(whole, sig2, size))

        ready = None  # finished but for near_next: (signature, values)

        def emit(values, near):
            for c, v in zip(rows, (*values, near), strict=True):
                c.append(v)

        def flush():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [x.split()[0] for x in OUT.split(", ")])
            for c in rows:
                c.clear()
            return b

        for b in C.chunks(batches, "text"):
            for p, guest, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if p != part_no:
                    part_no, held, ready, guests = p, None, None, 0
                if guest and guests:
                    continue  # further rows of the same first id
                guests += guest
                if held is not None:
                    sig, values = put(held, text)
                    if ready is not None:
                        emit(ready[1], likeness(ready[0], sig, size))
                    ready = (sig, values)
                held = (doc, text)
                if guest:
                    raw = text.encode()
                    sig = signature(np.frombuffer(raw, np.uint8), _parse(raw)[1], size)
                    if ready is not None:
                        emit(ready[1], likeness(ready[0], sig, size))
                    ready = held = None
            yield flush()

    return dealt.mapInArrow(run, OUT)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(C.table(spark, sf_dir, "documents"))
