"""Shared helpers of the training-data operators.

Everything here is bounded by a batch of one task: no helper gathers a corpus on
the driver.  Work that has to be cut from its lineage is written as Parquet into
the folder named by ``spark.checkpoint.dir`` (shared by driver and executors).
"""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INV = pow(_BASE, -1, 1 << 64)


ARROW_BYTES = 4 << 20  # of a batch on its way to Python and back


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's default bound on the bytes of an Arrow batch; a bound set by the user is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB"):
        spark.conf.set(key, str(ARROW_BYTES))


def trim() -> None:
    """Give memory that this process has freed back to the system, so that an idle Python worker stays small."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(run):
    """A function for mapInArrow that trims its worker when its task's rows are out."""

    def call(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return call


def lean_table(run):
    """A function of one table for applyInArrow that trims its worker after a table of 1 MB or more."""

    def call(t):
        out = run(t)
        if t.nbytes >= 1 << 20:
            trim()
        return out

    return call


def lean_tables(run):
    """The same for a function of two tables."""

    def call(left, right):
        out = run(left, right)
        if left.nbytes + right.nbytes >= 1 << 20:
            trim()
        return out

    return call


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's spark.checkpoint.dir.

    Only where that is unset (tests on a local master) a temporary folder is made
    and set for the rest of the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
        root = getattr(spark, "_gridspark_dir", None)
        if not root:
            root = spark._gridspark_dir = "file://" + tempfile.mkdtemp(prefix="gridspark-")
    return root


def own_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; it goes when the driver's process ends (not when it is killed)."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def cut(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write go as soon as it has ended, as nothing reads them again.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = own_path(spark, label)
    done = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(done)
    spark.conf.set(done, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(done, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that df has not (names are compared without case)."""
    held, name = {c.lower() for c in df.columns}, base
    while name.lower() in held:
        name += "_"
    return name


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def labels(spark: SparkSession, n: int, k: int | None = None) -> np.ndarray:
    """n distinct ints that a shuffle on them deals evenly to its k partitions (those of the session).

    A hash deals a few buckets unevenly; where there are many to a partition any ints do.
    """
    k = k or parts(spark)
    if n > 8 * k:
        return np.arange(n, dtype=np.int32)
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(k))
    rank = F.row_number().over(W.partitionBy("p").orderBy("id"))
    rows = spark.range(64 + 24 * n).select("id", at.alias("p")).select("id", "p", rank.alias("r"))
    return np.array([r.id for r in rows.orderBy("r", "p").limit(n).collect()], np.int32)


def below(edges: list, key: F.Column, strict: bool = False) -> F.Column:
    """How many of the sorted edges are at or below the key (strict: below): a search in two steps."""
    if not edges:
        return F.lit(0)
    step = max(1, math.isqrt(len(edges)))
    groups = [edges[i : i + step] for i in range(0, len(edges), step)]
    under = lambda a: F.size(F.filter(a, lambda e: e < key if strict else e <= key))
    g = F.greatest(under(F.array(*[F.lit(x[0]) for x in groups])), F.lit(1)) - 1
    return (g * step + under(F.get(F.array(*[F.array(*[F.lit(e) for e in x]) for x in groups]), g))).cast("int")


def input_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of a scan (file bytes for Parquet)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def columns_of(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, so clashing extra columns of the input cannot interfere."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def repeats(df: DataFrame, col: str) -> bool:
    """Whether a value of the column stands in several rows (null aside)."""
    own = columns_of(df, col).where(F.col(col).isNotNull())
    return bool(own.groupBy(col).count().where("count > 1").limit(1).count())


def chunks(batches: Iterator[pa.RecordBatch], text_col: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of about ``limit`` text bytes (at least one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(text_col))
        size = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes, offsets with one more entry than rows); a null counts as empty."""
    col = pa.compute.fill_null(col.cast(pa.large_string()), "")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8, off[-1] - off[0], off[0]), off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; kept and grown as needed."""
    if len(_pow[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for k, b in enumerate((_BASE, _INV)):
            f = np.full(m, b, np.uint64)
            f[0] = 1
            _pow[k] = np.multiply.accumulate(f)
    return _pow[0][:n], _pow[1][:n]


SEGMENT = 1 << 18  # bytes hashed at a time, so that tables of powers stay small


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[s:e] for each pair; equal bytes give equal hashes anywhere."""
    if len(data) <= 2 * SEGMENT or not len(starts):
        return _span_hash(data, starts, ends)
    o = np.argsort(starts, kind="stable") if (starts[1:] < starts[:-1]).any() else slice(None)
    s, e = starts[o], ends[o]
    edge = np.searchsorted(s, np.arange(0, len(data) + SEGMENT, SEGMENT))
    h = np.empty(len(s), np.uint64)
    for k, (i, j) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        if j > i:
            base = k * SEGMENT
            h[i:j] = _span_hash(data[base : e[i:j].max()], s[i:j] - base, e[i:j] - base)
    out = np.empty_like(h)
    out[o] = h
    return out


def _span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, inv = powers(len(data) + 1)
    pre = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=pre[1:])
    h = (pre[ends] - pre[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _MIX1)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row) of runs without ASCII white space; none crosses rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = ~_SPACE[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    cut_at = off[1:-1]
    cut_at = cut_at[(cut_at > 0) & (cut_at < len(data))]
    first[cut_at] = w[cut_at]
    last[cut_at - 1] = w[cut_at - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every lower-cased (A-Z) word, words before each row)."""
    s, e, before = word_spans(data, off)
    return (span_hash(_LOWER[data], s, e) if len(s) else np.zeros(0, np.uint64)), before


def shingle_sets(col: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its k-word shingles.

    With fewer than k words the whole sequence is the one shingle; without words
    (or with a null) the set is empty.
    """
    data, off = flat_bytes(col)
    h, before = word_hashes(data, off)
    if not len(h):
        return [np.zeros(0, np.uint64)] * len(col)
    mult = [np.uint64(pow(_BASE, 2 * i + 3, 1 << 64)) for i in range(k)]
    n = len(h) - k + 1
    roll = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        roll += h[i : i + n] * mult[i]
    roll = mix(roll)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(roll[a : b - k + 1]))
        elif b > a:
            v = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for i in range(a, b):
                    v = v + h[i] * mult[i - a]
            out.append(mix(np.array([v], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def id_filter(ids: DataFrame, col: str, bits: int = 1 << 23) -> bytes:
    """A Bloom filter of fixed size over a column of longs, for pruning a scan before a join.

    Its size does not depend on the data (1 MB); where it fills up it only stops
    pruning, the join behind it stays exact.
    """

    def build(batches):
        f = np.zeros(bits, bool)
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for s in (1, 2, 3):
                f[(mix(v * np.uint64(2 * s + 1) + np.uint64(s)) % np.uint64(bits)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(f).tobytes()], pa.binary())], ["f"])

    n = max(1, min(8, ids.sparkSession.sparkContext.defaultParallelism))
    rows = columns_of(ids, col).coalesce(n).mapInArrow(lean(build), "f binary").collect()  # at most 8 rows of 1 MB
    f = np.zeros(bits // 8, np.uint8)
    for r in rows:
        f |= np.frombuffer(r.f, np.uint8)
    return f.tobytes()


def maybe_in(filt: np.ndarray, ids: np.ndarray) -> np.ndarray:
    v = ids.astype(np.int64).view(np.uint64)
    ok = np.ones(len(v), bool)
    for s in (1, 2, 3):
        p = (mix(v * np.uint64(2 * s + 1) + np.uint64(s)) % np.uint64(len(filt) * 8)).astype(np.int64)
        ok &= (filt[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
    return ok


SMALL_GRAPH = 1 << 20  # edges: 16 MB in one task


def _small_components(batches):
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    u, v = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in (0, 1))
    node = np.unique(np.concatenate([u, v]))
    u, v = np.searchsorted(node, u), np.searchsorted(node, v)
    root = np.arange(len(node))
    while True:  # hook the larger root of an edge under the smaller, then point every node at its root
        p, q = root[u], root[v]
        if (p == q).all():
            break
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(node[root], pa.int64())], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL_GRAPH) -> DataFrame:
    """(node, component): smallest node reachable over undirected edges; nodes without edges are absent.

    A graph counted at no more than ``small`` edges is one task's union-find.  Else
    alternating large-star and small-star rounds; every round is one shuffle per star
    with partial aggregation, written to the shared folder, until the edges stop changing.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e, "cc")
    if e.count() <= small:
        return e.coalesce(1).mapInArrow(lean(_small_components), "node long, component long")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("lo")).withColumn("m", F.least("u", "lo"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct(), "cc")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == last:
            break
        last = now
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
