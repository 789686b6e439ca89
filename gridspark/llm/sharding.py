"""Sharding by a K-d tree over document metadata, balanced in bytes.

A node of the tree holds a run of shards.  It is split at the weighted median (by
bytes, in the ratio of the shards on each side) of the metadata dimension in which it
is widest, all nodes of a level at once, until each leaf is one shard.  Medians are
exact: a histogram per node is refined until its bin holds one value, then ties are
split the same way by a row number, so a source that holds a third of all rows is cut
like any other.  Only histograms (nodes x bins) reach the driver.

DataFrame functions only.  Defined cases: a null text has 0 bytes (size 16, crc 0);
null metadata sorts first; equal texts and repeated rows are separate rows and may part;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

SHARDS, BINS, OVERHEAD = 40, 1024, 16
DIMS = ["d_id", "d_chars", "d_source", "d_lang"]


def _order(col: str) -> F.Column:
    """The first seven bytes of a string as a number that keeps their order."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(col), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long"), F.lit(-1))


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A literal table of a few rows."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(f'{v}L' for v in r) + ')' for r in rows)} AS t({names})")


def _medians(t: DataFrame, nodes: dict[int, tuple[int, int, int, float]], bins: int) -> dict[int, tuple[int, int, int]]:
    """For node -> (dimension, low, high, bytes wanted left): (dimension, value, row number) of its last row left.

    Rows up to (value, row number) in order go left.  One pass over t refines all nodes.
    """
    spark = t.sparkSession
    open_ = {k: {"dim": d, "lo": lo, "hi": hi, "want": want, "tie": None} for k, (d, lo, hi, want) in nodes.items()}
    done: dict[int, tuple[int, int, int]] = {}
    while open_:
        state = _values(spark, [(k, s["dim"], s["lo"], s["hi"], int(s["tie"] is not None), s["tie"] or 0) for k, s in open_.items()], "node, dim, lo, hi, tied, tie")
        v = F.element_at(F.array(*DIMS), F.col("dim").cast("int") + 1)
        rows = t.join(F.broadcast(state), "node").withColumn("v", v).where((F.col("tied") == 0) | (F.col("v") == F.col("tie")))
        rows = rows.withColumn("v", F.when(F.col("tied") == 1, F.col("u")).otherwise(F.col("v"))).where("v between lo and hi")
        width = F.expr("greatest(1L, (hi - lo) div %d + 1)" % bins)
        hist = rows.groupBy("node", ((F.col("v") - F.col("lo")) / width).cast("int").alias("bin")).agg(F.sum("size").alias("w"), F.min("v").alias("a"), F.max("v").alias("b"))
        by: dict[int, list] = {}
        for r in hist.collect():  # at most nodes x bins rows
            by.setdefault(r.node, []).append((r.a, r.b, r.w))
        for k, found in by.items():
            s, left = open_[k], 0
            for a, b, w in sorted(found):
                if left + w >= s["want"] or (a, b, w) == max(found):
                    break
                left += w
            s["want"] -= left
            if a == b and s["tie"] is None:
                s.update(tie=a, lo=s["u"][0] if "u" in s else 0, hi=(1 << 62))
            elif a == b:
                # the row itself goes where it brings the left side nearer to its share
                done[k] = (s["dim"], s["tie"], a if s["want"] * 2 >= w else a - 1)
            else:
                s["lo"], s["hi"] = a, b
        open_ = {k: s for k, s in open_.items() if k not in done and k in by}
    return done


def kd_shards(docs: DataFrame, shards: int = SHARDS, bins: int = BINS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of documents."""
    spark = docs.sparkSession
    text = F.encode(F.col("text"), "UTF-8")
    t = docs.select(
        F.col("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long").alias("d_id"), F.coalesce(F.length("text"), F.lit(-1)).cast("long").alias("d_chars"),
        _order("source").alias("d_source"), _order("lang").alias("d_lang"), F.lit(0).cast("long").alias("node"),
    )
    t = C.cut(t.withColumn("size", F.col("bytes") + OVERHEAD).drop("bytes").withColumn("u", F.monotonically_increasing_id()), "kd")
    count = {0: shards}
    span: dict[int, int] = {}
    while any(n > 1 for n in count.values()):
        ends = [f(d).alias(f"{d}_{n}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]
        stats = {r.node: r for r in t.groupBy("node").agg(F.sum("size").alias("w"), *ends).collect()}  # one row per node
        span = span or {i: max(1, stats[0][f"{d}_hi"] - stats[0][f"{d}_lo"]) for i, d in enumerate(DIMS) if stats}
        wanted = {}
        for k, n in count.items():
            if n > 1 and k in stats:
                wide = [(stats[k][f"{d}_hi"] - stats[k][f"{d}_lo"]) / span[i] for i, d in enumerate(DIMS)]
                i = max(range(len(DIMS)), key=lambda j: (wide[j], -j))
                wanted[k] = (i, stats[k][f"{DIMS[i]}_lo"], stats[k][f"{DIMS[i]}_hi"], stats[k].w * (n // 2) / n)
        found = _medians(t, wanted, bins)
        count = {a: b for k, n in count.items() for a, b in ([(k, n // 2), (k + n // 2, n - n // 2)] if n > 1 else [(k, n)])}
        if not found:
            break
        splits = _values(spark, [(k, d, v, u, next(b for b in sorted(count) if b > k)) for k, (d, v, u) in found.items()], "node, dim, at, row, other")
        v = F.element_at(F.array(*DIMS), F.col("dim").cast("int") + 1)
        right = (v > F.col("at")) | ((v == F.col("at")) & (F.col("u") > F.col("row")))
        moved = t.join(F.broadcast(splits), "node", "left").withColumn("node", F.when(right, F.col("other")).otherwise(F.col("node")))
        t = C.cut(moved.drop("dim", "at", "row", "other"), "kd")
    buckets = C.parts(spark, 16)
    t = t.withColumn("b", F.pmod(F.xxhash64("u"), F.lit(buckets)))
    counts = t.groupBy("node", "b").agg(F.count("*").alias("n"))  # shards x buckets rows
    counts = counts.withColumn("before", F.sum("n").over(W.partitionBy("node").orderBy("b")) - F.col("n")).drop("n")
    slot = F.row_number().over(W.partitionBy("node", "b").orderBy("u")) + F.col("before") - 1
    return t.join(F.broadcast(counts), ["node", "b"]).select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
