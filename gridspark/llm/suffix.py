"""Exact substring dedup by prefix-free parsing into phrases and a bounded-depth corpus order.

Every byte covered by a ``DEPTH``-byte string that also starts in a document with a
smaller doc_id is removed.

* Triggers: a rolling hash of ``WORD`` bytes runs over each document; the places where it
  is smallest among the ``DEPTH - WORD + 1`` words of some ``DEPTH``-byte window are the
  triggers.  They depend on content alone, so equal strings are cut alike, no phrase
  between two triggers is a prefix of another, and every window holds a whole trigger.
* Dictionary: a trigger with its surroundings (the phrases beside it, as far as a window
  with this trigger reaches) is a dictionary entry.  A first shuffle brings (trigger, entry)
  hashes together: an entry that a smaller document has too is covered as a whole, and
  entries whose trigger occurs nowhere else are unique; neither needs its bytes compared.
* Order: what is left are the edges of repeats, a few per repeat.  The bytes of these
  entries meet by trigger; the left phrases (reversed) and the right phrases are
  suffix-sorted with their common prefix lengths, and the two orders combine into the order
  of all windows around the trigger at depth ``DEPTH``: windows are equal exactly if their
  left and right classes are.  The smallest document of each class covers the others.

Shuffles carry byte blobs per (block, hash bucket), not rows per position.  Equal entries
of a block collapse before the shuffle, so a passage in a third of all documents costs one
entry per block.  A trigger with many distinct entries in some block (``HOT_BLOCK`` or a
quarter of a bucket's share) sends those to buckets by the entry and only word of itself to
its own; it is hot then, as is one met by more than ``HOT`` entries: its windows go to
buckets by their own hash instead of meeting in one task.

Defined cases: null and empty texts have no bytes; matches never cross documents; a
null doc_id is kept whole and covers nothing; rows with one doc_id are one document of
several texts (matches cross neither, and they never cover each other); texts shorter than
``DEPTH`` are kept; ``dedup_text`` drops bytes left over at a cut character, as they are no
longer valid UTF-8; extra columns are ignored by ``removed`` and kept by ``dedup_text``.
Entries and windows are compared by hashes: two different ones pass as equal only where
all of at least 88 bits of independent hashes agree, odds under 1 in 10^9 for 10^8 entries
of one trigger.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

DEPTH, WORD = 50, 20
BLOCK = 4 << 20  # text bytes of a block before the first shuffle
GROUP, BUCKET = 4 << 20, 8 << 20  # text bytes of a group of documents and behind a bucket of triggers
HOT = 20_000
HOT_BLOCK = 8  # distinct entries of one trigger in a block, at least, that make it hot
BLOB = "bucket int, kind int, data binary"
EMPTY = -1


def _slide(a: np.ndarray, w: int, f) -> np.ndarray:
    m, k = a, 1
    while k * 2 <= w:
        m = f(m[:-k], m[k:])
        k *= 2
    if k < w:
        d = w - k
        m = f(m[:-d], m[d:])
    return m


def _rolling(data: np.ndarray, w: int) -> np.ndarray:
    """64-bit hash of each w-byte word; equal words have equal hashes."""
    p, inv = C.powers(len(data) + 1)
    pre = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(C._BYTE[data] * p[: len(data)], out=pre[1:])
    return C.mix((pre[w:] - pre[:-w]) * inv[: len(data) - w + 1])


def triggers(data: np.ndarray, off: np.ndarray, depth: int = DEPTH, word: int = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in data, word hash) of the triggers of a run of documents."""
    parts = []
    for a in range(0, max(len(data), 1), C.SEGMENT):  # long data in segments that see a window beyond their edges
        lo, hi = max(0, a - depth), min(len(data), a + C.SEGMENT + depth)
        row, at, h = _triggers(data[lo:hi], np.clip(off, lo, hi) - lo, depth, word)
        at = at + lo
        own = (at >= a) & (at < a + C.SEGMENT)
        parts.append((row[own], at[own], h[own]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _triggers(data: np.ndarray, off: np.ndarray, depth: int, word: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(data) < depth:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    h = _rolling(data, word)
    key = (h >> np.uint64(32)).astype(np.uint32)
    span = depth - word + 1
    low = _slide(key, span, np.minimum)  # of the window that starts here
    ends = off[1:]
    row_of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = np.arange(len(low)) + depth <= ends[row_of[: len(low)]]
    # a word is a trigger if it is the smallest of a window inside its document
    low = np.where(inside, low.astype(np.int64), -1)
    padded = np.concatenate([np.full(span - 1, -1, np.int64), low, np.full(span - 1, -1, np.int64)])
    best = _slide(padded, span, np.maximum)[: len(key)]
    at = np.flatnonzero(best == key)
    # the best window's minimum may belong to another document's word only if no window inside holds it
    return row_of[at], at, h[at]


def surroundings(data, off, row, at, depth: int = DEPTH, word: int = WORD) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in data of what windows with the trigger at ``at`` can reach inside its document."""
    reach = depth - word
    return np.maximum(off[row], at - reach), np.minimum(off[row + 1], at + word + reach)


def _planes(a: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each number, byte by byte apart, so that equal high bytes compress."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unplanes(raw: memoryview, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T
    return out.view("<u8").ravel()


def encode(doc: np.ndarray, *cols: tuple[np.ndarray, int]) -> bytes:
    """Rows in document order as one byte string: ids with run lengths, then each column in planes."""
    new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[new, len(doc)])
    head = np.array([len(doc), len(new)], "<i8").tobytes()
    return head + doc[new].astype("<i8").tobytes() + runs.astype("<u4").tobytes() + b"".join(_planes(c, s) for c, s in cols)


def decode(raw: bytes, sizes: tuple[int, ...]) -> list[np.ndarray]:
    n, k = np.frombuffer(raw, "<i8", 2)
    doc = np.repeat(np.frombuffer(raw, "<i8", k, 16), np.frombuffer(raw, "<u4", k, 16 + 8 * k))
    at, out = 16 + 12 * int(k), [doc]
    for s in sizes:
        out.append(_unplanes(memoryview(raw)[at:], int(n), s))
        at += int(n) * s
    return out


def _stack(blobs: list, sizes: tuple[int, ...]) -> list[np.ndarray]:
    ends = np.cumsum([0, *(int.from_bytes(b[:8], "little") for b in blobs)]).tolist()
    out = [np.zeros(ends[-1], np.int64)] + [np.zeros(ends[-1], np.uint64) for _ in sizes]
    for b, i, j in zip(blobs, ends[:-1], ends[1:], strict=True):  # into place, so that no row is held twice
        for c, part in zip(out, decode(b, sizes), strict=True):
            c[i:j] = part
    return out


def _blobs(t: pa.Table, kind: int) -> list:
    return t.filter(pa.compute.equal(t.column("kind"), kind)).column("data").to_pylist()


def _smallest(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, class of each row in that order, smallest doc of each class)."""
    o = np.lexsort((doc, *keys[::-1]))
    new = np.zeros(len(o), bool)
    new[:1] = True
    for k in keys:
        s = k[o]
        new[1:] |= s[1:] != s[:-1]
    return o, np.cumsum(new) - 1, doc[o][new]


def bucket_of(h: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return buckets[(h % np.uint64(len(buckets))).astype(np.int64)]


def _present(b: np.ndarray):
    """(bucket, rows in their order) of each bucket that has rows."""
    if len(b):
        o = np.argsort(b, kind="stable")
        first = np.flatnonzero(np.r_[True, b[o][1:] != b[o][:-1]])
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(o)], strict=True):
            yield int(b[o[i]]), o[i:j]


def _rows(bucket, kind, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


def _deal(groups: int, kind: int, doc: np.ndarray, *cols: tuple[np.ndarray, int]) -> list[tuple[int, int, bytes]]:
    """Blobs by group of documents."""
    own = np.argsort(doc, kind="stable")
    doc, cols = doc[own], [(c[own], s) for c, s in cols]
    return [(k, kind, encode(doc[i], *((c[i], s) for c, s in cols))) for k, i in _present(group_of(doc, groups))]


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents of each doc_id; ``group_col`` is the same in SQL."""
    u = doc.astype(np.int64).view(np.uint64)
    return np.mod((u ^ (u >> np.uint64(15)) ^ (u >> np.uint64(31))).view(np.int64), groups)


def group_col(groups: int) -> F.Column:
    d = F.col("doc_id").cast("long")
    x = d.bitwiseXOR(F.shiftrightunsigned(d, 15)).bitwiseXOR(F.shiftrightunsigned(d, 31))
    return F.pmod(x, F.lit(groups)).cast("int")


ENTRY = (5, 6, 4)  # bytes of trigger hash (beyond its bucket), entry hash, position
SPAN = (4, 4)  # start, length
WHOLE = (4,)  # position
ASK = (4, 1)  # position, whether its trigger is hot
WINDOW = (8, 4)  # hash, start
MASK = (4, 4)  # position, windows covered (bit L: the window that starts L bytes before the trigger)


def entries(docs: DataFrame, buckets: np.ndarray, depth: int = DEPTH, word: int = WORD) -> DataFrame:
    """Blobs by bucket of the trigger hash: kind 0 dictionary entries, kind 1 spans covered within the block.

    Kind 5 are entries of triggers that are hot in the block, by bucket of trigger and entry;
    kind 6 names these triggers to their own buckets.
    docs: doc_id, text and the bytes that earlier rows of the doc_id hold; positions count from its first row.
    """

    def emit(parts):
        doc, at, end, pos, h, e = (np.concatenate(c) for c in zip(*parts, strict=True))
        o, cls, low = _smallest([h, e], doc)
        covered = np.zeros(len(doc), bool)
        covered[o] = doc[o] > low[cls]
        keep = np.flatnonzero(~covered)
        out = []
        word, times = np.unique(h[keep], return_counts=True)
        word = word[times >= max(HOT_BLOCK, len(keep) // (4 * len(buckets)))]
        at_word = np.minimum(np.searchsorted(word, h[keep]), max(len(word) - 1, 0))
        hot = word[at_word] == h[keep] if len(word) else np.zeros(len(keep), bool)
        for kind, own, b in ((0, keep[~hot], h[keep[~hot]]), (5, keep[hot], C.mix(h[keep[hot]] ^ e[keep[hot]]))):
            for k, s in _present(bucket_of(b, buckets)):
                i = own[s]
                out.append((k, kind, encode(doc[i], (h[i] >> np.uint64(24), 5), (e[i], 6), (pos[i], 4))))
        for k, s in _present(bucket_of(word, buckets)):
            out.append((k, 6, encode(np.zeros(len(s), np.int64), (word[s] >> np.uint64(24), 5))))
        i = np.flatnonzero(covered)
        if len(i):
            out.append((int(bucket_of(h[i[:1]], buckets)[0]), 1, encode(doc[i], (at[i], 4), (end[i] - at[i], 4))))
        return _rows(*zip(*out, strict=True)) if out else None

    def run(batches):
        parts, size = [], 0
        for b in C.chunks(batches):
            b = b.take(pa.compute.sort_indices(b.column(0)))
            data, off = C.flat_bytes(b.column(1))
            row, at, h = triggers(data, off, depth, word)
            if len(row):
                s, e = surroundings(data, off, row, at, depth, word)
                shape = ((at - s) * 256 + (e - at)).astype(np.uint64)
                doc, zero = b.column(0).to_numpy()[row], (off[:-1] - b.column(2).to_numpy())[row]
                parts.append((doc, s - zero, e - zero, (at - zero).astype(np.uint64), h, C.mix(C.span_hash(data, s, e) + shape)))
            size += len(data)
            if size >= BLOCK and parts:
                if (r := emit(parts)) is not None:
                    yield r
                parts, size = [], 0
        if parts and (r := emit(parts)) is not None:
            yield r

    return docs.mapInArrow(C.lean(run), BLOB)


def settle(blobs: DataFrame, groups: int) -> DataFrame:
    """Per bucket: blobs by group of documents, kind 0 requests for bytes, kind 1 covered spans, kind 4 triggers with all they reach covered."""

    def run(t: pa.Table) -> pa.Table:
        doc, h, e, pos = _stack(_blobs(t, 0), ENTRY)
        sdoc, start, length = _stack(_blobs(t, 1), SPAN)
        out = _deal(groups, 1, sdoc, (start, 4), (length, 4))
        _, named = _stack(_blobs(t, 6), (5,))
        hdoc, hh, he, hpos = _stack(_blobs(t, 5), ENTRY)
        if len(hdoc):
            o, cls, low = _smallest([hh, he], hdoc)
            covered = hdoc[o] > low[cls]
            out += _deal(groups, 4, hdoc[o[covered]], (hpos[o[covered]], 4))
            i = o[~covered]
            out += _deal(groups, 0, hdoc[i], (hpos[i], 4), (np.ones(len(i), np.uint64), 1))
        if len(doc):
            o, cls, low = _smallest([h, e], doc)
            del e  # a bucket's columns are the most a worker holds, so each goes as soon as it is in order
            d = doc[o]
            del doc
            hs = h[o]
            del h
            p = pos[o]
            del pos, o
            covered = d > low[cls]
            new_h = np.r_[True, hs[1:] != hs[:-1]]
            word = np.cumsum(new_h) - 1
            # of each trigger: its distinct entries, smallest and largest of their first documents
            first = np.r_[True, cls[1:] != cls[:-1]]
            n = np.bincount(word[first])
            lo = np.full(len(n), np.iinfo(np.int64).max)
            hi = np.full(len(n), np.iinfo(np.int64).min)
            np.minimum.at(lo, word[first], d[first])
            np.maximum.at(hi, word[first], d[first])
            hot = (n > HOT) | np.isin(hs[new_h], named)
            ask = ~covered & (hot | ((n > 1) & (lo < hi)))[word]
            i = np.flatnonzero(ask)
            out += _deal(groups, 0, d[i], (p[i], 4), (hot[word[i]].astype(np.uint64), 1))
            i = np.flatnonzero(covered)
            out += _deal(groups, 4, d[i], (p[i], 4))
        return pa.Table.from_batches([_rows(*zip(*out, strict=True)) if out else _rows([], [], [])])

    return blobs.groupBy("bucket").applyInArrow(C.lean_table(run), BLOB)


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of fixed-depth byte rows, and the common prefix of each with the one before it."""
    n, d = rows.shape
    wide = np.zeros((n, -(-d // 8) * 8), np.uint8)
    wide[:, :d] = rows
    keys = wide.view(">u8")
    o = np.lexsort([keys[:, k] for k in range(keys.shape[1] - 1, -1, -1)])
    s = rows[o]
    differ = s[1:] != s[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), d)
    return o, np.r_[0, lcp] if n else lcp


def _classes(o: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """The class of each row among rows with the same first ``depth`` bytes."""
    out = np.empty(len(o), np.int64)
    c = lcp < depth
    c[:1] = True
    out[o] = np.cumsum(c) - 1
    return out


def covered_windows(doc: np.ndarray, left: np.ndarray, right: np.ndarray, left_n: np.ndarray, right_n: np.ndarray, depth: int = DEPTH, word: int = WORD) -> np.ndarray:
    """Bit L of each row: its window that starts L bytes before the trigger is in a smaller document.

    left: the phrases before the trigger, reversed; right: the trigger and what follows.
    """
    reach = depth - word
    lo, ll = _order(left)
    ro, rl = _order(right)
    mask = np.zeros(len(doc), np.uint64)
    for k in range(reach + 1):  # bytes left of the trigger
        ok = np.flatnonzero((k <= left_n) & (reach - k <= right_n))
        if not len(ok):
            continue
        key = _classes(lo, ll, k)[ok] * len(doc) + _classes(ro, rl, word + reach - k)[ok]
        o, cls, low = _smallest([key], doc[ok])
        hit = ok[o[doc[ok][o] > low[cls]]]
        mask[hit] |= np.uint64(1 << k)
    return mask


class _Corpus:
    """A group of documents: their rows in order of doc_id and place, as bytes with offsets."""

    def __init__(self, t: pa.Table):
        """t: doc_id, bytes of earlier rows of the doc_id, text."""
        t = t.rename_columns(["doc_id", "base", "text"]).combine_chunks().sort_by([("doc_id", "ascending"), ("base", "ascending")])
        self.data, self.off = C.flat_bytes(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()))
        self.ids = t.column("doc_id").to_numpy()

    def places(self, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in data, row) of positions in documents."""
        at = self.off[np.searchsorted(self.ids, doc)] + pos.astype(np.int64)
        return at, np.searchsorted(self.off, at, "right") - 1

    def position(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        return at - self.off[np.searchsorted(self.ids, self.ids[row])]


def gather(docs: DataFrame, asked: DataFrame, buckets: np.ndarray) -> DataFrame:
    """The bytes asked for, by bucket of their trigger (kind 0), or windows of hot triggers by their own hash (kind 2).

    docs: group, doc_id, bytes of earlier rows of the doc_id, text.
    """
    reach = DEPTH - WORD

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, pos, hot = _stack(_blobs(right, 0), ASK)
        out = []
        if len(doc) and left.num_rows:
            own = _Corpus(left.drop_columns(left.column_names[0]))
            data, off, ids = own.data, own.off, own.ids
            at, row = own.places(doc, pos)
            s, e = surroundings(data, off, row, at, DEPTH, WORD)
            h = C.span_hash(data, at, at + WORD)
            cold = np.flatnonzero(hot == 0)
            o = cold[np.argsort(h[cold], kind="stable")]  # like triggers stand together and compress
            for k, i in _present(bucket_of(h[o], buckets)):
                i = o[i]
                where = at[i][:, None] + np.arange(-reach, WORD + reach)
                ok = (where >= s[i][:, None]) & (where < e[i][:, None])
                span = np.where(ok, data[np.clip(where, 0, len(data) - 1)], 0).astype(np.uint8)
                head = np.array([len(i)], "<i8").tobytes() + doc[i].astype("<i8").tobytes() + pos[i].astype("<u4").tobytes()
                out.append((k, 0, head + (at - s)[i].astype(np.uint8).tobytes() + (e - at - WORD)[i].astype(np.uint8).tobytes() + span.tobytes()))
            i = np.flatnonzero(hot)
            if len(i):
                start = s[i][:, None] + np.arange(reach + 1)
                ok = start + DEPTH <= e[i][:, None]
                r, start = np.broadcast_to(row[i][:, None], ok.shape)[ok], start[ok]
                place, first = np.unique(start, return_index=True)
                r = r[first]
                w = C.span_hash(data, place, place + DEPTH)
                o, cls, low = _smallest([w], ids[r])
                gone = np.zeros(len(place), bool)
                gone[o] = ids[r][o] > low[cls]
                where = own.position(place, r)
                j = np.flatnonzero(gone)
                if len(j):
                    out.append((int(bucket_of(w[j[:1]], buckets)[0]), 1, encode(ids[r[j]], (where[j], 4), (np.full(len(j), DEPTH), 4))))
                j = np.flatnonzero(~gone)
                for k, q in _present(bucket_of(w[j], buckets)):
                    q = j[q]
                    out.append((k, 2, encode(ids[r[q]], (w[q], 8), (where[q], 4))))
        return pa.Table.from_batches([_rows(*zip(*out, strict=True)) if out else _rows([], [], [])])

    return docs.groupBy(docs.columns[0]).cogroup(asked.groupBy("bucket")).applyInArrow(C.lean_tables(run), BLOB)


def compare(blobs: DataFrame, groups: int) -> DataFrame:
    """Covered windows of the asked entries, by group of documents: kind 1 spans, kind 3 masks."""
    reach = DEPTH - WORD
    size = 14 + DEPTH + reach

    def run(t: pa.Table) -> pa.Table:
        out = []
        sdoc, start, length = _stack(_blobs(t, 1), SPAN)
        out += _deal(groups, 1, sdoc, (start, 4), (length, 4))
        parts = []
        for raw in _blobs(t, 0):
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            at = 8
            cols = []
            for kind, k in (("<i8", 8), ("<u4", 4), ("u1", 1), ("u1", 1)):
                cols.append(np.frombuffer(raw, kind, n, at))
                at += n * k
            parts.append((*cols, np.frombuffer(raw, np.uint8, n * (size - 14), at).reshape(n, size - 14)))
        if parts:
            doc, pos, ln, rn, span = (np.concatenate(c) for c in zip(*parts, strict=True))
            mask = covered_windows(doc, span[:, :reach][:, ::-1], span[:, reach:], ln, rn)
            i = np.flatnonzero(mask)
            out += _deal(groups, 3, doc[i], (pos[i].astype(np.uint64), 4), (mask[i], 4))
        doc, w, start = _stack(_blobs(t, 2), WINDOW)
        if len(doc):
            o, cls, low = _smallest([w], doc)
            i = o[doc[o] > low[cls]]
            out += _deal(groups, 1, doc[i], (start[i], 4), (np.full(len(i), DEPTH), 4))
        return pa.Table.from_batches([_rows(*zip(*out, strict=True)) if out else _rows([], [], [])])

    return blobs.groupBy("bucket").applyInArrow(C.lean_table(run), BLOB)


def _covered(own: _Corpus, right: pa.Table) -> np.ndarray:
    """Whether each byte of a group of documents is covered."""
    delta = np.zeros(len(own.data) + 1, np.int32)
    reach = DEPTH - WORD

    def add(start, end):
        np.add.at(delta, start, 1)
        np.subtract.at(delta, end, 1)

    if len(own.ids):
        doc, start, length = _stack(_blobs(right, 1), SPAN)
        if len(doc):
            at, _ = own.places(doc, start)
            add(at, at + length.astype(np.int64))
        doc, pos = _stack(_blobs(right, 4), WHOLE)
        if len(doc):
            at, row = own.places(doc, pos)
            add(*surroundings(own.data, own.off, row, at, DEPTH, WORD))
        doc, pos, mask = _stack(_blobs(right, 3), MASK)
        for k in range(reach + 1):
            i = np.flatnonzero(mask >> np.uint64(k) & np.uint64(1))
            if len(i):
                at, _ = own.places(doc[i], pos[i])
                add(at - k, at - k + DEPTH)
    np.cumsum(delta, out=delta)
    return delta[:-1] > 0


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _rewrite(docs: DataFrame, spans: DataFrame, extra: list[str] | None) -> DataFrame:
    """Figures of every row, or with ``extra`` these columns with what is kept of the text.

    docs: group, bytes of earlier rows of the doc_id, then doc_id, text and the rest.
    """
    group, base = docs.columns[:2]
    schema = docs.select(*(F.col(f"`{c}`") for c in extra)).schema if extra else OUT

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks().sort_by([("doc_id", "ascending"), (base, "ascending")])
        own = _Corpus(left.select(["doc_id", base, "text"]))
        data, off = own.data, own.off
        gone = _covered(own, right)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = off[1:-1][off[1:-1] < len(data)]
        edge[inner] = gone[inner]
        removed, spans_n = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)])[off] for x in (gone, edge))
        cols: list[list] = [[], [], [], [], []]
        texts = []
        for k, d in enumerate(own.ids.tolist()):
            a, b = off[k], off[k + 1]
            raw = data[a:b][~gone[a:b]].tobytes() if removed[k + 1] > removed[k] else data[a:b].tobytes()
            if extra:
                texts.append(raw.decode(errors="ignore"))
            else:
                for c, v in zip(cols, (d, int(b - a), int(removed[k + 1] - removed[k]), int(spans_n[k + 1] - spans_n[k]), hashlib.sha256(raw).hexdigest()), strict=True):
                    c.append(v)
        if extra:
            out = left.select(extra)
            at = out.schema.get_field_index("text")
            null = left.column("text").is_null().to_pylist()
            texts = [None if z else t for t, z in zip(texts, null, strict=True)]
            return out.set_column(at, "text", pa.array(texts, out.schema.field("text").type))
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.groupBy(group).cogroup(spans.groupBy("bucket")).applyInArrow(C.lean_tables(run), schema)


def _spans(docs: DataFrame, groups: int, buckets: int) -> DataFrame:
    """All covered spans (kinds 1, 3 and 4) by group of documents."""
    group, base = docs.columns[:2]
    labels = C.labels(docs.sparkSession, buckets)
    first = C.cut(settle(entries(docs.select("doc_id", "text", base), labels), groups), "settled")
    more = C.cut(compare(gather(docs.select(group, "doc_id", base, "text"), first.where("kind = 0"), labels), groups), "compared")
    return first.where("kind <> 0").unionByName(more)


def _prepared(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows with a doc_id after two internal columns, and the numbers of groups and buckets for their bytes.

    The columns, of names that docs has not: the group of the doc_id, and the bytes of the rows
    before this one of the same doc_id (0 unless an id repeats), in order of their texts.
    """
    spark = docs.sparkSession
    group, base = C.fresh(docs, "g"), C.fresh(docs, "base")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    own = docs.where("doc_id is not null")
    before = F.lit(0).cast("long")
    again = C.repeats(docs, "doc_id")
    if again:
        before = F.coalesce(F.sum(size).over(W.partitionBy("doc_id").orderBy("text").rowsBetween(W.unboundedPreceding, -1)), before)
    total = own.agg(F.sum(size)).first()[0] or 0
    groups = max(C.parts(spark, 4), -(-total // GROUP)) | 1
    buckets = max(C.parts(spark, 4), -(-total // BUCKET))
    own = own.select(group_col(groups).alias(group), before.alias(base), *(F.col(f"`{c}`") for c in docs.columns))
    return (C.cut(own, "numbered") if again else own), groups, buckets


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs = C.columns_of(docs, "doc_id", "text")
    d, groups, buckets = _prepared(docs)
    out = _rewrite(d, _spans(d, groups, buckets), None)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    sha = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return out.unionByName(docs.where("doc_id is null").select("doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), sha.alias("kept_sha256")))


def dedup_text(docs: DataFrame) -> DataFrame:
    """docs with repeated spans removed from text (null texts stay null); all columns kept."""
    d, groups, buckets = _prepared(docs)
    return _rewrite(d, _spans(d, groups, buckets), docs.columns).unionByName(docs.where("doc_id is null"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(C.table(spark, sf_dir, "documents"))
