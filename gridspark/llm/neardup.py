"""MinHash near-dedup with bottom-k sketches from one hash function.

1. A document's set is its distinct five-word shingles (64-bit hashes).  Equal sets form a
   class; its smallest doc_id stands for it, so copies cost one row, not pairs.
2. Each class keeps the ``K`` smallest hash values (the whole set if it is no larger).
3. Retained values are ordered by (how many sketches hold them, value).  Two sets with
   J >= t share at least ``need`` retained values (exactly for whole sets, up to six
   standard deviations for sketches), so each class is entered in the inverted lists
   of only its rarest values, ``size - need + 1`` of them; frequent passages rarely count.
4. Short lists give pairs.  A long list (over ``LONG``) gives only links to its pivot, the
   member with the most frequent values, dealt out by a bounded table of long lists.
5. Pairs are filtered by size and by the union-sketch estimate, then verified on full sets.
6. Verified links are joined to components.  Long lists whose members are still in
   several components are compared completely on full sets, in blocks, inside tasks;
   only links that join components leave a task.  So no link that joins components is
   lost to a cap, and no group's pairs are ever written out.

Defined cases: null, empty and word-less texts have the empty set and are linked with
nothing; with fewer than five words the sequence is the one shingle; a null doc_id is its
own component (null) and kept; repeated rows of one doc_id are one document (each row is
returned); ties go to the smallest doc_id; extra columns are ignored by ``near_groups``
and kept by ``drop_near``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

K, LONG, MAX_LONG_LISTS = 64, 16, 1 << 17
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 1024


def needed(n: int, k: int, num: int, den: int) -> int:
    """Retained values that any partner with J >= num/den shares with a set of n (six sigma for sketches)."""
    t = num / den
    if n * den <= k * num:  # no partner can be larger than k: all sketches involved are whole sets
        return max(1, math.ceil(n * num / den - 1e-9))
    m = min(n, k)
    return max(1, int(t * m - 6 * math.sqrt(t * (1 - t) * m)))


def class_rows(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), key (16-byte digest of the set), sketch (k smallest values)."""

    def run(batches):
        for b in C.chunks(batches):
            sets = C.shingle_sets(b.column(1))
            key = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array([s[:k].tobytes() for s in sets], pa.binary())], ["doc_id", "n", "key", "sketch"])

    return C.columns_of(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(C.lean(run), "doc_id long, n long, key binary, sketch binary")


def _u64(b) -> np.ndarray:
    return np.frombuffer(b, np.uint64)


def frequent_values(reps: DataFrame) -> DataFrame:
    """(value, df) of the retained values in at least LONG sketches, at most MAX_LONG_LISTS of the most frequent.

    The table only fixes the order of values and which lists are dealt by pivot; a long
    list outside it is found and treated the same way in its task.
    """

    def values(batches):
        for b in batches:
            v, c = np.unique(_u64(b"".join(b.column(0).to_pylist())), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c.astype(np.int32))], ["value", "c"])

    df = reps.select("sketch").mapInArrow(C.lean(values), "value long, c int").groupBy("value").agg(F.sum("c").alias("df"))
    return df.where(F.col("df") >= LONG).orderBy(F.desc("df"), "value").limit(MAX_LONG_LISTS)


def _prefixes(batch, order_v, order_df, k, num, den):
    """(row of each entry, value, is long, centrality of the row) for a batch of (doc_id, n, sketch)."""
    n = batch.column(1).to_numpy()
    size = np.array([len(x.as_buffer()) // 8 for x in batch.column(2)], np.int64)
    v = _u64(b"".join(batch.column(2).to_pylist()))
    row = np.repeat(np.arange(len(n)), size)
    df = np.zeros(len(v), np.int64)
    if len(order_v):
        at = np.minimum(np.searchsorted(order_v, v), len(order_v) - 1)
        df = np.where(order_v[at] == v, order_df[at], 0)
    o = np.lexsort((v, df, row))
    row, v, df = row[o], v[o], df[o]
    pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    lim = np.array([s - needed(int(m), k, num, den) + 1 for s, m in zip(size, n, strict=True)], np.int64)
    central = np.bincount(row, df, len(n)).astype(np.int64)
    keep = pos < lim[row]
    return row[keep], v[keep], df[keep] > 0, central


def entries(reps: DataFrame, order: tuple[np.ndarray, np.ndarray], k: int, num: int, den: int) -> DataFrame:
    """The inverted index: value, doc_id, n, long (dealt by pivot), central."""
    held = reps.sparkSession.sparkContext.broadcast(order)  # at most MAX_LONG_LISTS values

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            row, v, is_long, central = _prefixes(b, *held.value, k, num, den)
            doc, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            cols = [v.view(np.int64), doc[row], n[row], is_long, central[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["value", "doc_id", "n", "long", "central"])

    return reps.select("doc_id", "n", "sketch").mapInArrow(C.lean(run), "value long, doc_id long, n long, long boolean, central long")


def list_pairs(v: np.ndarray, d: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Distinct pairs (2 rows) of the lists of at most LONG members; rows are sorted by value, then document."""
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    size = np.diff(np.r_[start, len(v)])
    first, length = np.repeat(start, size), np.repeat(size, size)
    i = np.arange(len(v))
    found = []
    for gap in range(1, LONG):
        x = np.flatnonzero((length > gap) & (length <= LONG) & (i + gap < first + length))
        y = x + gap
        fit = (np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num) & (d[x] != d[y])
        found.append(np.stack([d[x[fit]], d[y[fit]]]))
    p = np.concatenate(found, 1)
    p = p[:, np.lexsort(p)]
    return p[:, np.r_[True, (p[:, 1:] != p[:, :-1]).any(0)][: p.shape[1]]]


def short_pairs(index: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a < b) of the lists outside the table; kind 1 rows are members (value a, doc b) of a list found long.

    Lists stream by in the order of their values; only the one that a batch cuts is
    carried, and of a list known to be long nothing but its value.
    """
    n = C.parts(index.sparkSession, 8)

    def rows(a, b, kind):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "kind"])

    def settled(v, d, n):
        size = np.diff(np.r_[np.flatnonzero(np.r_[True, v[1:] != v[:-1]]), len(v)])
        big = np.repeat(size, size) > LONG
        if big.any():
            yield rows(v[big], d[big], 1)
        if not big.all():
            p = list_pairs(v[~big], d[~big], n[~big], num, den)
            yield rows(p[0], p[1], 0)

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        known = None  # value of a long list whose first members are out
        for b in batches:
            if not b.num_rows:
                continue
            v, d, n = (np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held))
            if known is not None:
                k = int(np.searchsorted(v, known, "right"))
                if k:
                    yield rows(v[:k], d[:k], 1)
                v, d, n = v[k:], d[k:], n[k:]
                if not len(v):
                    held = [v, d, n]
                    continue
                known = None
            k = int(np.searchsorted(v, v[-1], "left"))
            if k:
                yield from settled(v[:k], d[:k], n[:k])
            if len(v) - k > LONG:
                yield rows(v[k:], d[k:], 1)
                known, k = v[-1], len(v)
            held = [v[k:], d[k:], n[k:]]
        if len(held[0]):
            yield from settled(*held)

    own = index.where("not long").select("value", "doc_id", "n").repartition(n, "value").sortWithinPartitions("value", "doc_id")
    return own.mapInArrow(C.lean(run), "a long, b long, kind int")


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    """(shared, size) of the bottom-k sketch of the union of two sketches."""
    u = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return (int(np.searchsorted(both, u[-1], "right")), len(u)) if len(u) else (0, 0)


def _join_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    s = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    t = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    return pairs.join(s, "a").join(t, "b").select("a", "b", "na", "nb", "sa", "sb")


def likely(pairs: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs whose union sketch does not rule out J >= num/den (six sigma; exact for whole sets)."""
    t = num / den
    filt = np.frombuffer(C.id_filter(pairs.select(F.explode(F.array("a", "b")).alias("i")), "i"), np.uint8)
    held = reps.sparkSession.sparkContext.broadcast(filt)

    def mine(batches):
        for b in batches:
            yield b.filter(pa.array(C.maybe_in(held.value, b.column(0).to_numpy())))

    def run(batches):
        for b in batches:
            keep = []
            for na, nb, sa, sb in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                if max(na, nb) <= k:  # whole sets
                    keep.append(linked(_u64(sa), _u64(sb), num, den))
                    continue
                same, size = union_estimate(_u64(sa), _u64(sb), k)
                keep.append(same >= t * size - 6 * math.sqrt(t * (1 - t) * size))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = reps.select("doc_id", "n", F.col("sketch").alias("s")).mapInArrow(C.lean(mine), "doc_id long, n long, s binary")
    return _join_sets(pairs, sets).mapInArrow(C.lean(run), "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, n, s (sorted 64-bit hashes) of the documents whose id is in ``wanted`` (column i).

    The scan is pruned by a filter of fixed size before any shuffle; the exact join follows.
    """
    filt = np.frombuffer(C.id_filter(wanted, "i"), np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(filt)

    def run(batches):
        for b in C.chunks(batches):
            b = b.filter(pa.array(C.maybe_in(held.value, b.column(0).to_numpy())))
            if b.num_rows:
                sets = C.shingle_sets(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "s"])

    sets = C.columns_of(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(C.lean(run), "doc_id long, n long, s binary")
    return sets.join(wanted.select(F.col("i").alias("doc_id")).distinct(), "doc_id", "left_semi")


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same > 0 and same * den >= num * (len(a) + len(b) - same)


def verify(pairs: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    def run(batches):
        for b in batches:
            keep = [linked(_u64(x), _u64(y), num, den) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = C.cut(full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("i"))), "sets")
    return _join_sets(pairs, sets).mapInArrow(C.lean(run), "a long, b long")


def block_links(ids: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int, step: int = 256) -> list[tuple[int, int]]:
    """Links between members of ``left`` and ``right`` (index arrays) that join components.

    Intersections of a block are counted by a product of 0/1 matrices over the values
    that at least two members hold; found links merge components at once, so at most one
    link fewer than the members comes out.
    """
    root = {c: c for c in comp.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    flat.sort()
    again = flat[1:] == flat[:-1]
    again[1:] &= ~again[:-1]  # only the second of each run
    common = flat[1:][again]
    del flat, again
    col = []  # of each member: its values that others hold too, by their number
    for s in sets:
        at = np.searchsorted(common, s)
        at[at == len(common)] = 0
        col.append(at[common[at] == s].astype(np.int32) if len(common) else np.zeros(0, np.int32))
    out = []

    def matrix(rows, cols_used):
        m = np.zeros((len(rows), len(cols_used)), np.float32)
        for r, i in enumerate(rows):
            c = col[i]
            p = np.searchsorted(cols_used, c)
            ok = (p < len(cols_used)) & (cols_used[np.minimum(p, len(cols_used) - 1)] == c)
            m[r, p[ok]] = 1
        return m

    for x in range(0, len(left), step):
        rx = left[x : x + step]
        for y in range(0, len(right), step):
            ry = right[y : y + step]
            if len({find(c) for c in comp[np.r_[rx, ry]].tolist()}) < 2:
                continue
            cx = np.unique(np.concatenate([col[i] for i in rx]))
            cy = np.unique(np.concatenate([col[i] for i in ry]))
            both = np.intersect1d(cx, cy, assume_unique=True)
            same = np.zeros((len(rx), len(ry)), np.float32)
            for z in range(0, len(both), 8192):
                used = both[z : z + 8192]
                same += matrix(rx, used) @ matrix(ry, used).T
            union = size[rx][:, None] + size[ry][None, :] - same
            for i, j in zip(*np.nonzero((same > 0) & (same * den >= num * union)), strict=True):
                p, q = find(int(comp[rx[i]])), find(int(comp[ry[j]]))
                if p != q:
                    root[p] = q
                    out.append((int(ids[rx[i]]), int(ids[ry[j]])))
    return out


def rest_links(members: DataFrame, comp: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """Links that join components inside long lists (value, doc_id), compared completely in blocks."""
    spark = docs.sparkSession
    m = members.join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    m = C.cut(m, "members")
    open_ = m.groupBy("value").agg(F.count("*").alias("c"), F.sum("n").alias("total"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("h")).where("lo <> hi")
    # lists with the same members need one comparison
    open_ = open_.groupBy("h", "c", "total").agg(F.min("value").alias("value"))
    blocks = F.greatest(F.ceil(F.col("total") * 8 / BLOCK_BYTES), F.ceil(F.col("c") / BLOCK_ROWS)).cast("int")
    m = m.join(open_.select("value", blocks.alias("nb")), "value").withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int"))
    if m.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    sets = C.cut(full_sets(docs, m.select(F.col("doc_id").alias("i"))), "sets")
    m = m.select("value", "doc_id", "component", "blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    m = m.withColumns({"x": F.least("blk", "o"), "y": F.greatest("blk", "o")}).drop("o")
    rows = m.join(sets, "doc_id").select("value", "x", "y", "doc_id", "component", "blk", "s")

    def run(t: pa.Table) -> pa.Table:
        ids, comp, blk = (t.column(c).to_numpy() for c in ("doc_id", "component", "blk"))
        own = [_u64(s) for s in t.column("s").to_pylist()]
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        out = block_links(ids, comp, own, np.flatnonzero(blk == x), np.flatnonzero(blk == y), num, den)
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("value", "x", "y").applyInArrow(C.lean_table(run), "a long, b long")


def near_groups(docs: DataFrame, num: int = 4, den: int = 5, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id of every row (exact components of J >= num/den).

    Rows that repeat a doc_id are one document with several texts, linked by any of them.
    """
    if not C.repeats(docs, "doc_id"):
        return _groups(docs, num, den, k)
    # any distinct numbers do, as the smallest doc_id is sought afterwards; writing them fixes them
    own = C.columns_of(docs, "doc_id", "text").withColumn("_i", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()))
    own = C.cut(own, "numbered")
    found = C.cut(_groups(own.select(F.col("_i").alias("doc_id"), "text"), num, den, k), "groups")
    ids = own.where("_i is not null").select("_i", F.col("doc_id").alias("d"))
    named = found.join(ids, found.doc_id == ids._i, "left").select("d", "n_shingles", "component_id")
    named = named.join(ids.select(F.col("_i").alias("component_id"), F.col("d").alias("e")), "component_id", "left").select("d", "n_shingles", "e")
    comp = C.components(named.where("d <> e").select(F.col("d").alias("a"), F.col("e").alias("b")))
    return named.join(comp.select(F.col("node").alias("d"), "component"), "d", "left").select(F.col("d").alias("doc_id"), "n_shingles", F.coalesce("component", "d").alias("component_id"))


def _groups(docs: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """near_groups of documents whose ids do not repeat."""
    spark = docs.sparkSession
    rows = C.cut(class_rows(docs, k), "classes")
    firsts = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"))
    firsts = C.cut(firsts, "firsts")
    ids = firsts.select(F.col("rep").alias("doc_id"))
    reps = C.cut(rows.where("n > 0").join(ids, "doc_id", "left_semi"), "reps")
    table = frequent_values(reps).collect()  # at most MAX_LONG_LISTS pairs of numbers
    pairs = sorted((r.value & (2**64 - 1), r.df) for r in table)
    order = (np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64))
    index = C.cut(entries(reps, order, k, num, den), "index")
    short = C.cut(short_pairs(index, num, den), "short")
    long_ = index.where("long").select("value", "doc_id", "n", "central")
    pivot = long_.groupBy("value").agg(F.max(F.struct("central", F.bitwise_not("doc_id").alias("d"), "n")).alias("p"))
    star = long_.join(F.broadcast(pivot), "value").select(F.bitwise_not("p.d").alias("q"), "doc_id", "n", F.col("p.n").alias("m"))
    star = star.where((F.col("q") != F.col("doc_id")) & (F.least("n", "m") * den >= F.greatest("n", "m") * num))
    star = star.select(F.least("q", "doc_id").alias("a"), F.greatest("q", "doc_id").alias("b"))
    found = short.where("kind = 1").select(F.col("a").alias("value"), F.col("b").alias("doc_id"))
    hub = found.groupBy("value").agg(F.min("doc_id").alias("q"))
    star2 = found.join(hub, "value").where("q <> doc_id").select(F.col("q").alias("a"), F.col("doc_id").alias("b"))
    pairs = C.cut(short.where("kind = 0").select("a", "b").unionByName(star).unionByName(star2).distinct(), "pairs")
    pairs = C.cut(likely(pairs, reps, k, num, den), "likely")
    links = C.cut(verify(pairs, docs, num, den), "links")
    comp = C.cut(C.components(links), "comp")
    members = long_.select("value", "doc_id", "n").unionByName(found.join(reps.select("doc_id", "n"), "doc_id").select("value", "doc_id", "n")).distinct()
    more = C.cut(rest_links(members, comp, docs, num, den), "links")
    comp = C.cut(C.components(links.unionByName(more)), "comp")
    by_class = firsts.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = rows.join(by_class, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    nothing = C.columns_of(docs, "doc_id", "text").where("doc_id is null")
    none = class_rows(nothing.select(F.lit(0).cast("long").alias("doc_id"), "text"), 1).select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(none)


def drop_near(docs: DataFrame, num: int = 4, den: int = 5, k: int = K) -> DataFrame:
    """docs without near duplicates: of each component the smallest doc_id stays, all columns kept."""
    groups = near_groups(docs, num, den, k).where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    gone = C.fresh(docs, "gone")
    found = C.cut(groups.withColumnRenamed("doc_id", gone), "gone")
    return docs.join(found, F.col("doc_id") == F.col(gone), "left_anti")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(C.table(spark, sf_dir, "documents"), 85, 100)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
