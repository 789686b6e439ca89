"""Sequence packing: shortest-pack-first over the length histogram.

A document becomes its token ids and an end id.  It is cut into full pieces of
``width`` tokens and one rest, so only a histogram of at most ``width`` lengths
decides the packing: lengths are placed longest first, each into the open pattern
with the least room that still fits being opened last (shortest pack first), with
counts of packs per pattern and never one object per document.  Patterns come back
to the pieces by rank within their length.

Defined cases: a null or empty text is one piece (the end id); equal texts and
repeated rows are packed as separate pieces; a null doc_id is kept; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import tokens

WIDTH, END_ID = 2048, 1
PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def spfhp(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, list[int]]]:
    """Packs for a histogram of lengths: [(how often, lengths of the pattern longest first)].

    Lengths are placed longest first.  Open patterns are kept by their free room; a
    length goes to the patterns whose room is largest (the shortest packs), as often as
    both last, else opens new packs.  Work depends on the number of lengths, not documents.
    """
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        fits = max((r for r in room if r >= length and room[r]), default=None)
        while left and fits is not None:
            n, pattern = room[fits].pop()
            take = min(n, left)
            if n > take:
                room[fits].append((n - take, pattern))
            room[fits - length].append((take, [*pattern, length]))
            left -= take
            fits = max((r for r in room if r >= length and room[r]), default=None)
        if left:
            room[width - length].append((left, [length]))
    merged: Counter = Counter()
    for packs in room.values():
        for n, pattern in packs:
            merged[tuple(pattern)] += n
    return [(n, list(p)) for p, n in sorted(merged.items(), reverse=True)]


def slots(packs: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence_id, offset) of each place of each pattern."""
    used: Counter = Counter()
    out, seq = [], 0
    for n, pattern in packs:
        at = 0
        for length in pattern:
            out.append((length, used[length], n, seq, at))
            used[length] += n
            at += length
        seq += n
    return out


def pieces(docs: DataFrame, path: str, width: int = WIDTH, with_ids: bool = False) -> DataFrame:
    """One row per piece: a document's ids plus the end id, cut at every ``width`` tokens."""

    def cut_up(batches):
        encode = tokens.encoder(path)
        end = END_ID.to_bytes(4, "little")
        for b in C.chunks(batches, limit=4 << 20):
            cols: list[list] = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                total = len(ids) // 4
                for start in range(0, total, width):
                    own = ids[4 * start : 4 * (start + width)]
                    for c, v in zip(cols, (doc, start, len(own) // 4, zlib.crc32(own), total, own if with_ids else None), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    return C.columns_of(docs, "doc_id", "text").mapInArrow(cut_up, PIECE + ", ids binary" * with_ids)


def pack(docs: DataFrame, path: str | None = None, width: int = WIDTH, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset; with_ids adds the token ids (uint32, little-endian).

    The histogram (at most ``width`` rows) is the only thing the driver sees.  Ranks
    within a length are dealt without gathering a length in one task: pieces of a length
    are numbered inside hash buckets and bucket counts give the offsets, so a length
    that a third of all pieces share spreads over all buckets.
    """
    spark = docs.sparkSession
    p = C.cut(pieces(docs, path or tokens.default_path(), width, with_ids), "pieces")
    buckets = C.parts(spark, 16)
    p = p.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = p.groupBy("length", "_b").agg(F.count("*").alias("n"))
    by_length = W.partitionBy("length").orderBy("_b")  # at most `buckets` rows each
    counts = C.cut(counts.withColumn("_before", F.sum("n").over(by_length) - F.col("n")), "lengths")
    hist = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= width rows
    places = slots(spfhp(hist, width))
    places = spark.createDataFrame(places, "length int, first long, times long, seq long, offset int")
    ranked = p.withColumn("_i", F.row_number().over(W.partitionBy("_b", "length").orderBy("doc_id", "start")))
    ranked = ranked.join(counts.drop("n"), ["length", "_b"]).withColumn("_rank", F.col("_before") + F.col("_i") - 1)
    # a place is found by the range of ranks it holds; places are few (patterns x lengths)
    lists = places.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "times", "seq", "offset"))).alias("places"))
    spot = F.element_at(F.filter("places", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["first"] + s["times"])), 1)
    out = ranked.join(F.broadcast(lists), "length").withColumn("_s", spot)
    cols = ["doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens"]
    return out.select(*cols, (F.col("_s.seq") + F.col("_rank") - F.col("_s.first")).alias("sequence_id"), F.col("_s.offset").cast("long").alias("offset"), *["ids"] * with_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
