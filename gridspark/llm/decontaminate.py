"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max bounds.

The index holds the benchmark (checked to be under ``MAX_INDEX`` bytes, else it is split
and the documents are searched once per part, with the weights of one index).  Its lists are
sparse: at most some 40 bytes a word of text.  Items are cut into entries of at most
``ENTRY`` words; an entry's impacts are its BM25 term weights over its score against itself,
so one threshold serves all.  Each training text is cut into passages of 2 * ENTRY words
that overlap by ENTRY, so an entry that stands in a text stands whole in a passage.  Each
passage is a query: the sum of its terms' upper bounds decides whether any entry can reach
the threshold (WAND), block maxima decide which blocks of entries can (block-max), and
only those are scored; all entries at or over the threshold are retrieved.  Retrieved
items are verified on the whole text: the share of the question's five-word shingles and
of the answer's that the document holds, both at least ``OVERLAP``.

Words are runs without white space or ASCII punctuation, lower-cased.  Without question and answer columns
the answer of an item is its last sentence and the question what stands before (with one
sentence both are the whole text).

Defined cases: null, empty and word-less texts and items match nothing; items with
fewer than five words are compared as one shingle of their words; equal items are all
reported; repeated rows are judged each; an empty benchmark finds nothing; null ids are
kept; extra columns are ignored by ``leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ENTRY, BLOCK = 64, 32
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
K1, B = 1.2, 0.75
MAX_INDEX = 16 << 20

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words before each row) of a text column."""
    data, off = C.flat_bytes(pa.compute.utf8_lower(pa.compute.fill_null(col.cast(pa.large_string()), "")))
    data = _CLEAN[data]
    s, e, before = C.word_spans(data, off)
    return (C.span_hash(data, s, e) if len(s) else np.zeros(0, np.uint64)), before


def shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += h[i : i + n] * np.uint64(pow(C._BASE, 2 * i + 3, 1 << 64))
    return C.mix(out)


@dataclass
class Lists:
    """Inverted lists: key[start[t] : start[t + 1]] and value of term t, keys rising."""

    start: np.ndarray
    key: np.ndarray
    value: np.ndarray

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[terms], self.start[terms + 1]
        at = np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange((b - a).sum())
        return self.key[at], self.value[at]


@dataclass
class Impacts(Lists):
    blocks: int

    def __getitem__(self, at: tuple) -> np.ndarray:
        """[blocks, terms] of the dense (block, term, entry of the block) form."""
        out = np.zeros((len(at[1]), self.blocks * BLOCK), np.float32)
        for k, t in enumerate(at[1]):
            own = slice(self.start[t], self.start[t + 1])
            out[k, self.key[own]] = self.value[own]
        return out.reshape(len(at[1]), self.blocks, BLOCK).swapaxes(0, 1)[at[0]]


@dataclass
class Index:
    items: np.ndarray  # item_id of each entry
    vocab: np.ndarray  # sorted word hashes
    top: np.ndarray  # largest impact of each term; a last 0 for unknown words
    block_top: Lists  # term -> blocks
    impact: Impacts  # term -> entries
    parts: dict  # item_id -> list of (question shingles, their k, answer shingles, their k)


def split_answer(text: str) -> tuple[str, str]:
    t = text.strip()
    cuts = [m.end() for m in re.finditer(r"[.?!\n]\s+", t)]
    return (t[: cuts[-1]], t[cuts[-1] :]) if cuts else (t, t)


def entries(h: np.ndarray) -> list[np.ndarray]:
    """A text's word hashes in entries of at most ENTRY words."""
    n = -(-len(h) // ENTRY)
    return [h[len(h) * i // n : len(h) * (i + 1) // n] for i in range(n)]


@dataclass
class Counts:
    """What BM25 weights need of all entries, whichever part holds them."""

    n: int = 0
    words: int = 0
    vocab: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    df: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, rows: list[tuple]) -> Counts:
        own = [e for r in rows for e in entries(hashes(pa.array([r[3]], pa.string()))[0])]
        self.n, self.words = self.n + len(own), self.words + sum(map(len, own))
        v, c = np.unique(np.concatenate([np.unique(e) for e in own]), return_counts=True) if own else (self.vocab[:0], self.df[:0])
        both, at = np.unique(np.concatenate([self.vocab, v]), return_inverse=True)
        self.vocab, self.df = both, np.bincount(at, np.concatenate([self.df, c]), len(both)).astype(np.int64)
        return self


def build(rows: list[tuple], counts: Counts | None = None) -> Index:
    """rows: (item_id, question, answer, text); counts are of all items where rows are a part."""
    counts = counts or Counts().add(rows)
    words, items, parts = [], [], {}
    for item, q, a, text in rows:
        h, _ = hashes(pa.array([text], pa.string()))
        if not len(h):
            continue
        sides = []
        for side in (q, a):
            x, _ = hashes(pa.array([side], pa.string()))
            x = x if len(x) else h
            k = min(SHINGLE, len(x))
            sides += [np.unique(shingles(x, k)), k]
        parts.setdefault(item, []).append(tuple(sides))
        for e in entries(h):
            words.append(e)
            items.append(item)
    vocab = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    n, t = len(words), len(vocab)
    df = counts.df[np.searchsorted(counts.vocab, vocab)]
    idf = np.log(1 + (counts.n - df + 0.5) / (df + 0.5))
    mean = counts.words / counts.n if counts.n else 1.0
    terms, weights = [], []
    for own in words:
        v, tf = np.unique(np.searchsorted(vocab, own), return_counts=True)
        w = idf[v] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / mean))
        terms.append(v)
        weights.append((w / w.sum()).astype(np.float32))
    entry = np.repeat(np.arange(n), [len(v) for v in terms])
    term, weight = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((terms, np.int64), (weights, np.float32)))
    order = np.lexsort((entry, term))
    term, entry, weight = term[order], entry[order].astype(np.int32), weight[order]
    start = lambda x: np.searchsorted(x, np.arange(t + 2))
    new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (entry[1:] // BLOCK != entry[:-1] // BLOCK)][: len(term)])
    block_top = Lists(start(term[new]), entry[new] // BLOCK, np.maximum.reduceat(weight, new) if n else weight)
    top = np.zeros(t + 1, np.float32)
    np.maximum.at(top, term, weight)
    return Index(np.array(items, np.int64), vocab, top, block_top, Impacts(start(term), entry, weight, max(1, -(-n // BLOCK))), parts)


def search(ix: Index, terms: np.ndarray, threshold: float = THRESHOLD) -> dict[int, float]:
    """item -> best score over the passages of a text (term numbers of its words, -1 unknown) at or over the threshold."""
    t = len(ix.vocab)
    terms = np.where(terms < 0, t, terms).astype(np.int32)
    n = max(1, -(-max(len(terms) - ENTRY, 1) // ENTRY))
    padded = np.full((n + 1) * ENTRY, t, np.int32)
    padded[: len(terms)] = terms
    q = np.concatenate([padded[:-ENTRY].reshape(n, ENTRY), padded[ENTRY:].reshape(n, ENTRY)], 1)
    first_pass = ix.top[q].sum(1)  # repeated words counted again: still an upper bound
    q = q[first_pass >= threshold]
    if not len(q):
        return {}
    q.sort(axis=1)
    q[:, 1:][q[:, 1:] == q[:, :-1]] = t
    q = q[ix.top[q].sum(1) >= threshold]
    found: dict[int, float] = {}
    for p in q:
        p = p[p < t]
        block, most = ix.block_top.of(p)
        live = np.bincount(block, most, ix.impact.blocks) >= threshold - 1e-6
        if not live.any():
            continue
        entry, weight = ix.impact.of(p)
        hit = live[entry // BLOCK]
        s = np.bincount(entry[hit], weight[hit], len(ix.items))
        for e in np.flatnonzero(s >= threshold - 1e-6).tolist():
            item = int(ix.items[e])
            found[item] = max(found.get(item, 0.0), float(s[e]))
    return found


def _share(want: np.ndarray, k: int, h: np.ndarray, kept: dict) -> float:
    if k not in kept:
        kept[k] = np.unique(shingles(h, k))
    have = kept[k]
    if not len(have):
        return 0.0
    at = np.minimum(np.searchsorted(have, want), len(have) - 1)
    return float((have[at] == want).mean())


def judge(ix: Index, col: pa.Array, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[list[int], int, float, float, float]]:
    """Per text: (leaked items, items retrieved, best score, question and answer overlap of the best)."""
    h, before = hashes(col)
    at = np.searchsorted(ix.vocab, h)
    terms = np.where(ix.vocab[np.minimum(at, max(len(ix.vocab) - 1, 0))] == h, at, -1) if len(ix.vocab) else np.full(len(h), -1)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        found = search(ix, terms[a:b], threshold) if b > a and len(ix.vocab) else {}
        kept: dict = {}
        hits, best = [], (0.0, 0.0)
        for item in sorted(found):
            for q, kq, w, kw in ix.parts[item]:
                both = _share(q, kq, h[a:b], kept), _share(w, kw, h[a:b], kept)
                best = max(best, both, key=lambda x: (min(x), x))
                if min(both) >= overlap - 1e-12:
                    hits.append(item)
                    break
        out.append((hits, len(found), max(found.values(), default=0.0), *best))
    return out


def indexes(bench: DataFrame, max_bytes: int = MAX_INDEX) -> Iterator[Index]:
    """Indexes of parts of the benchmark, each of at most about max_bytes of text, one at a time."""
    names = bench.columns
    q, a = (F.col("question"), F.col("answer")) if {"question", "answer"} <= set(names) else (F.lit(None).cast("string"),) * 2
    b = bench.select("item_id", q.alias("q"), a.alias("a"), "text").where("item_id is not null and text is not null")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // max_bytes))

    def rows(i):  # one part unless the benchmark is larger than the bound; an item's rows stay together
        part = b.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) if n > 1 else b
        return [(r.item_id, *((r.q, r.a) if r.q and r.a else split_answer(r.text)), r.text) for r in sorted(part.collect(), key=lambda r: (r.item_id, r.text))]

    if n == 1:
        yield build(rows(0))
        return
    counts = Counts()
    for i in range(n):
        counts.add(rows(i))
    for i in range(n):
        yield build(rows(i), counts)


OUT = "doc_id long, contaminated boolean, item_ids array<long>, n_retrieved int, best_score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per document: the items it leaks, and figures of the search."""
    d = C.columns_of(docs, "doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    sc = docs.sparkSession.sparkContext
    found = []
    for ix in indexes(bench):
        held = sc.broadcast(ix)  # at most MAX_INDEX of text

        def run(batches, held=held):
            for b in C.chunks(batches):
                rows = judge(held.value, b.column(1), threshold, overlap)
                hits, n, score, q, a = zip(*rows, strict=True)
                cols = [b.column(0), pa.array([bool(x) for x in hits]), pa.array(hits, pa.list_(pa.int64())), pa.array(n, pa.int32()), pa.array(score, pa.float64()), pa.array(q, pa.float64()), pa.array(a, pa.float64()), b.column(2)]
                yield pa.RecordBatch.from_arrays(cols, [*(x.split()[0] for x in OUT.split(", ")), "_row"])

        found.append(d.mapInArrow(C.lean(run), OUT + ", _row long"))
    if len(found) == 1:
        return found[0].drop("_row")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    best = F.max_by(F.struct("question_overlap", "answer_overlap"), F.least("question_overlap", "answer_overlap"))
    out = out.groupBy("doc_id", "_row").agg(F.max("contaminated").alias("contaminated"), F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.sum("n_retrieved").cast("int").alias("n_retrieved"), F.max("best_score").alias("best_score"), best.alias("_b"))
    return out.select("doc_id", "contaminated", "item_ids", "n_retrieved", "best_score", F.col("_b.question_overlap").alias("question_overlap"), F.col("_b.answer_overlap").alias("answer_overlap"))


def drop_leaks(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """docs without the rows that leak an item, all columns kept."""
    at = docs.columns.index("text")
    for ix in indexes(bench):
        held = docs.sparkSession.sparkContext.broadcast(ix)

        def run(batches, held=held):
            for b in C.chunks(batches):
                rows = judge(held.value, b.column(at), threshold, overlap)
                yield b.filter(pa.array([not r[0] for r in rows], pa.bool_()))

        docs = docs.mapInArrow(C.lean(run), docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
