"""Toxicity: character n-gram linear classifier on naive Bayes log-count ratios.

Features are the presence of hashed character n-grams of the lower-cased text.  Each
is scaled by its log-count ratio r = log((p + a) / (q + b)) between toxic and other
labelled documents; a logistic regression is fitted on the scaled features.  Fitting
runs in one executor task on a bounded sample of labelled rows (``max_rows``,
``max_bytes`` of whole texts, dealt by a hash of doc_id; toxic rows come first, up to half of
a bound that others fill too); scoring covers every whole text in Arrow batches.

Defined cases: null and empty texts have no features, so their score is the
intercept's; labels that are null are left out and of several labels of a document the
largest counts; without any toxic label every score is 0; equal texts score equally;
repeated rows are scored each; extra columns are ignored by ``score`` and kept by
``reject``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

NGRAMS = (3, 4, 5, 6)
BITS = 20
MAX_FEATURES = 1 << 15
MAX_ROWS, MAX_BYTES = 6000, 24 << 20
FOLDS, HELD_OUT = 5, 0


@dataclass
class Model:
    ngrams: tuple = NGRAMS
    bits: int = BITS
    slot: np.ndarray = field(default_factory=lambda: np.full(1 << BITS, -1, np.int32))  # bucket -> feature
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = -np.inf


def _grams(col: pa.Array, ngrams=NGRAMS, bits: int = BITS):
    """For each n: (row of each n-gram, its bucket); n-grams never cross rows."""
    low = pa.compute.utf8_lower(pa.compute.fill_null(col.cast(pa.large_string()), ""))
    texts = low.to_pylist()
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    h = np.full(len(c), 0x811C9DC5, np.uint32)
    for k in range(1, max(ngrams) + 1):
        if len(c) < k:
            return
        h = h[: len(c) - k + 1] * np.uint32(0x01000193) + c[k - 1 :] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if k in ngrams:
            same = row[: len(h)] == row[k - 1 :]
            b = (h * np.uint32(0x85EBCA6B) + np.uint32(k)) >> np.uint32(32 - bits)
            yield row[: len(h)][same], b[same].astype(np.int64)


def _present(col: pa.Array, slot: np.ndarray, bits: int, ngrams) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of the selected features."""
    found = []
    for row, b in _grams(col, ngrams, bits):
        f = slot[b]
        hit = np.flatnonzero(f >= 0)
        found.append((row[hit].astype(np.int64) << 32) | f[hit])
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> 32, keys & 0xFFFFFFFF


def fit(texts: list[str], labels: list[int], ngrams=NGRAMS, bits: int = BITS, most: int = MAX_FEATURES, rounds: int = 150) -> Model:
    y = np.array(labels, np.float64)
    model = Model(tuple(ngrams), bits, np.full(1 << bits, -1, np.int32))
    if not len(y) or not y.any():
        return model
    batches = [pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]
    count = np.zeros((2, 1 << bits), np.float32)
    at, parts = 0, list(C.chunks(iter(batches), limit=1 << 18))
    for part in parts:
        lab = y[at : at + part.num_rows]
        keys = np.unique(np.concatenate([(row.astype(np.int64) << bits) | b for row, b in _grams(part.column(0), ngrams, bits)] or [np.zeros(0, np.int64)]))
        row, b = keys >> bits, keys & ((1 << bits) - 1)
        for k in (0, 1):
            count[k] += np.bincount(b[lab[row] == k], minlength=1 << bits)
        at += part.num_rows
    pos, neg = y.sum(), (1 - y).sum()
    ratio = np.log((count[1] + 1) / (pos + 2)) - np.log((count[0] + 1) / (neg + 2))
    seen = count.sum(0)
    strength = np.where(seen >= 3, np.abs(ratio) * np.sqrt(np.maximum(count[1], count[0] * pos / max(neg, 1))), 0)
    chosen = np.argsort(-strength, kind="stable")[:most]
    chosen = np.sort(chosen[strength[chosen] > 0])
    model.slot[chosen] = np.arange(len(chosen), dtype=np.int32)
    scale = ratio[chosen]
    pairs, at = [], 0
    for part in parts:
        r, f = _present(part.column(0), model.slot, bits, ngrams)
        pairs.append((slice(at, at + part.num_rows), r.astype(np.int32), f.astype(np.int32)))
        at += part.num_rows
    w, b0 = np.zeros(len(chosen)), float(np.log((pos + 0.5) / (neg + 0.5)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    balance = np.where(y == 1, len(y) / (2 * pos), len(y) / max(1, 2 * neg))
    for t in range(1, rounds + 1):  # Adam on the full bounded sample
        v0 = scale * w
        z = np.concatenate([np.bincount(r, v0[f], own.stop - own.start) for own, r, f in pairs]) + b0
        err = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g, gb = scale * sum(np.bincount(f, err[own][r], len(w)) for own, r, f in pairs) + 1e-5 * w, err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.01 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b0 -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    model.weight, model.bias = (w * scale).astype(np.float32), b0
    return model


def predict(model: Model, col: pa.Array) -> np.ndarray:
    if not np.isfinite(model.bias):
        return np.zeros(len(col))
    row, f = _present(col, model.slot, model.bits, model.ngrams)
    z = np.bincount(row, model.weight[f], len(col)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fold(doc_id, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on a bounded sample of the rows whose fold is not held out."""
    ok = C.columns_of(labels, "doc_id", "toxic").where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("toxic").isNotNull())
    ok = ok.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    bad = F.col("toxic") > 0
    some = ok
    if (keep := _shares(ok, F.lit(1), max_rows)) is not None:
        some = ok.where(F.col("u") < F.when(bad, keep[0]).otherwise(keep[1])).orderBy(bad.desc(), "u", "doc_id").limit(max_rows)  # the documented bound
    texts = C.columns_of(docs, "doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id")
    size = C.cut(texts.dropDuplicates(["doc_id"]).withColumn("b", F.octet_length("text")), "labelled")
    if (least := _shares(size, F.col("b"), max_bytes)) is not None:
        top = {r.bad: r.u for r in size.groupBy(bad.alias("bad")).agg(F.max("u").alias("u")).collect()}
        at = [int(x / (1 << 20) * (top.get(k, 0) + 1)) for k, x in ((True, least[0]), (False, least[1]))]
        size = size.where(F.col("u") < F.when(bad, at[0]).otherwise(at[1]))

    def run(batches):
        texts, labels = [], []
        for part in batches:
            texts += part.column(0).to_pylist()
            labels += part.column(1).to_pylist()
        m = fit(texts, [int(x) for x in labels])
        yield pa.RecordBatch.from_arrays([pa.array([np.flatnonzero(m.slot >= 0).astype(np.int32).tobytes()]), pa.array([m.weight.tobytes()]), pa.array([float(m.bias)])], ["chosen", "weight", "bias"])

    one = size.select("text", "toxic", "u", "doc_id").coalesce(1).sortWithinPartitions("u", "doc_id").select("text", "toxic")
    model = Model()
    for r in one.mapInArrow(C.lean(run), "chosen binary, weight binary, bias double").collect():  # one row: at most MAX_FEATURES numbers
        chosen = np.frombuffer(r.chosen, np.int32)
        model.slot[chosen] = np.arange(len(chosen), dtype=np.int32)
        model.weight, model.bias = np.frombuffer(r.weight, np.float32), r.bias
    return model


def _shares(rows: DataFrame, size, bound: int) -> tuple[int, int] | None:
    """Shares, in 2^20ths, of toxic and other rows that keep a sum under the bound; None where all fit."""
    total = {r.bad: r.n or 0 for r in rows.groupBy((F.col("toxic") > 0).alias("bad")).agg(F.sum(size).alias("n")).collect()}
    one, other = total.get(True, 0), total.get(False, 0)
    if one + other <= bound:
        return None
    room = min(one, max(bound / 2, bound - other))
    return tuple(int((1 << 20) * min(1.0, part / max(1, n))) for part, n in ((room, one), (bound - room, other)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # a fixed number of features: under 5 MB

    def run(batches):
        for b in C.chunks(batches, limit=1 << 18):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(predict(held.value, b.column(1)), pa.float64())], ["doc_id", "score"])

    return C.columns_of(docs, "doc_id", "text").mapInArrow(C.lean(run), "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under the threshold, all columns kept."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in C.chunks(batches, limit=1 << 18):
            keep = predict(held.value, b.column(at)) < threshold
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(C.lean(run), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = train(docs, C.table(spark, sf_dir, "labels"))
    out = score(docs, model)
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
