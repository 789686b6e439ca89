"""Language ID: a byte convolutional network, trained in numpy.

Input are windows of ``LENGTH`` bytes of the lower-cased UTF-8 text.  Filters of
several widths over one-hot bytes (so a filter is a table of byte weights per offset),
max pooling over the window, ReLU and softmax.  It is trained with Adam on all windows of
a bounded sample of labelled documents (``MAX_DOCS`` and about ``MAX_BYTES`` of whole texts
a language, dealt by a hash of doc_id).  A document's prediction is the mean of the class probabilities
over all windows of its whole text, weighted by their bytes.

Defined cases: a null text or one without any letter gets ``und`` with score 0;
without a labelled language every prediction is ``und``; equal texts get equal
predictions; repeated rows are predicted each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .toxicity import fold

LENGTH, WIDTHS, FILTERS = 128, (2, 3, 4), 8
MAX_DOCS, MAX_BYTES = 400, 256 << 10
FOLDS, HELD_OUT = 4, 2
WIDE = max(WIDTHS)


@dataclass
class Net:
    langs: list
    conv: np.ndarray  # (offset, byte, filter)
    bias: np.ndarray
    dense: np.ndarray  # (filter, class)
    out: np.ndarray


def windows(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded by zeros incl. the filters' overhang, row of each, its bytes)."""
    n = np.diff(off)
    per = -(-n // length)
    row = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    size = np.minimum(length, n[row] - k * length)
    at = (off[:-1][row] + k * length)[:, None] + np.arange(length + WIDE - 1)
    live = np.arange(length + WIDE - 1) < np.minimum(length + WIDE - 1, (n[row] - k * length))[:, None]
    x = np.where(live, data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)
    return x, row, size


def _conv(net: Net, x: np.ndarray) -> np.ndarray:
    """(window, position, filter) responses before pooling."""
    length = x.shape[1] - WIDE + 1
    y = np.take(net.conv[0], x[:, :length], axis=0)
    for k in range(1, WIDE):
        y += np.take(net.conv[k], x[:, k : k + length], axis=0)
    return y


def probabilities(net: Net, x: np.ndarray, batch: int = 256) -> np.ndarray:
    out = np.empty((len(x), len(net.langs)), np.float32)
    for i in range(0, len(x), batch):
        h = np.maximum(_conv(net, x[i : i + batch]).max(1) + net.bias, 0)
        z = h @ net.dense + net.out
        z = np.exp(z - z.max(1, keepdims=True))
        out[i : i + batch] = z / z.sum(1, keepdims=True)
    return out


def fit(x: np.ndarray, y: np.ndarray, langs: list, epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    f = FILTERS * len(WIDTHS)
    mask = np.zeros((WIDE, 1, f), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
    net = Net(list(langs), (rng.normal(0, 0.3, (WIDE, 256, f)) * mask).astype(np.float32), np.zeros(f, np.float32), rng.normal(0, 0.3, (f, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [net.conv, net.bias, net.dense, net.out]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            own = order[i : i + batch]
            xb, yb = x[own], y[own]
            resp = _conv(net, xb)
            top = resp.argmax(1)  # (window, filter)
            h0 = np.take_along_axis(resp, top[:, None], 1)[:, 0] + net.bias
            h = np.maximum(h0, 0)
            z = h @ net.dense + net.out
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), yb] -= 1
            p /= len(own)
            dh = (p @ net.dense.T) * (h0 > 0)
            g_conv = np.zeros_like(net.conv)
            filt = np.broadcast_to(np.arange(f), top.shape)
            for k in range(WIDE):
                byte = np.take_along_axis(xb, top + k, 1).astype(np.int64)
                g_conv[k] = np.bincount((byte * f + filt).ravel(), dh.ravel(), 256 * f).reshape(256, f)
            grads = [g_conv * mask, dh.sum(0), h.T @ p, p.sum(0)]
            t += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(q.dtype)
    return net


def train(docs: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Net | None:
    """Fit on a bounded sample of documents outside the held-out fold with a language."""
    ok = C.columns_of(docs, "doc_id", "text", "lang").where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & (F.length("text") > 0))
    ok = ok.withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    sizes = ok.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"), F.min("u").alias("u")).collect()  # one row per language
    if not sizes:
        return None
    langs = sorted(r["lang"] for r in sizes)
    # whole documents below a mark on the hash; the first of a language is always among them
    share = {r.lang: max(r.u, int((1 << 20) * min(1.0, max_docs / r.n, max_bytes / r.b))) for r in sizes}
    share = F.create_map(*[F.lit(v) for kv in share.items() for v in kv])
    some = ok.where(F.col("u") <= share[F.col("lang")])

    def cut_up(batches):
        for b in C.chunks(batches):
            x, row, _ = windows(*C.flat_bytes(pa.compute.utf8_lower(b.column(0))))
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row)), pa.array([w.tobytes() for w in x], pa.binary())], ["lang", "u", "x"])

    rows = some.select("text", "lang", "u").mapInArrow(cut_up, "lang string, u long, x binary").orderBy("u", "x").collect()  # the documented bound
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.uint8).reshape(len(rows), -1)
    at = {v: i for i, v in enumerate(langs)}
    return fit(x, np.array([at[r.lang] for r in rows]), langs)


def predict(net: Net, col: pa.Array) -> tuple[list, np.ndarray]:
    low = pa.compute.utf8_lower(pa.compute.fill_null(col.cast(pa.large_string()), ""))
    letters = pa.compute.match_substring_regex(low, r"\p{L}").to_numpy(zero_copy_only=False)
    data, off = C.flat_bytes(low)
    x, row, size = windows(data, off)
    total = np.zeros((len(col), len(net.langs)))
    if len(row):
        p = probabilities(net, x) * size[:, None]
        for c in range(p.shape[1]):
            total[:, c] = np.bincount(row, p[:, c], len(col))
    n = np.maximum(np.diff(off), 1)
    best = total.argmax(1)
    lang = [net.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
    return lang, np.where(letters, np.clip(total.max(1) / n, 0, 1), 0.0)


def identify(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    if net is None:
        return C.columns_of(docs, "doc_id").select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(net)  # about 100 kB

    def run(batches):
        for b in C.chunks(batches, limit=1 << 19):
            lang, p = predict(held.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(p, pa.float64())], ["doc_id", "lang_pred", "score"])

    return C.columns_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
