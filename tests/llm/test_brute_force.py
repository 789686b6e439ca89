"""Sharding, toxicity, language and page pairing against plain loops."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridspark.llm import language, pages, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def split(rows, shards, span):
    """K-d splits of rows (dimensions, row number, size) at the weighted median of the widest dimension."""
    if shards == 1 or not rows:
        return [rows]
    lo, hi = (tuple(f(r[0][k] for r in rows) for k in range(4)) for f in (min, max))
    dim = max(range(4), key=lambda k: ((hi[k] - lo[k]) / span[k], -k))
    want = sum(r[2] for r in rows) * (shards // 2) / shards
    order = sorted(rows, key=lambda r: (r[0][dim], r[1]))
    left, at = 0, 0
    while at < len(order) - 1 and left + order[at][2] < want:
        left, at = left + order[at][2], at + 1
    cut = at + ((want - left) * 2 >= order[at][2])  # the row at the median goes where it brings the left nearer
    return [*split(order[:cut], shards // 2, span), *split(order[cut:], shards - shards // 2, span)]


@pytest.mark.parametrize(("shards", "bins"), [(8, 1024), (5, 3)])
def test_shards_are_those_of_plain_medians(spark, shards, bins):
    rng = random.Random(shards)
    rows = [(rng.randrange(400), "x" * rng.choice([0, 3, rng.randrange(300)]), rng.choice(["en", "de", None]), "hot" if rng.random() < 0.4 else rng.choice("abcdef"), 0) for _ in range(500)]
    rows += [(None, None, None, None, None)] * 3 + [(5, "é" * 4000, "en", "hot", 0)]
    out = sharding.kd_shards(spark.createDataFrame(rows, DOCS).coalesce(1), shards, bins).toPandas()

    def number(s):
        return -1 if s is None else int.from_bytes(s.encode()[:7].ljust(7, b"\0"), "big")

    # rows of one partition are numbered in their order
    plain = [((-1 if i is None else i, -1 if t is None else len(t), number(s), number(g)), k, len((t or "").encode()) + 16) for k, (i, t, g, s, _) in enumerate(rows)]
    span = [max(1, max(r[0][k] for r in plain) - min(r[0][k] for r in plain)) for k in range(4)]
    want = [sorted((rows[r[1]][0] or -1, r[2], zlib.crc32((rows[r[1]][1] or "").encode())) for r in part) for part in split(plain, shards, span)]
    got = [sorted((int(r.doc_id) if r.doc_id else -1, int(r.size), int(r.text_crc32)) for r in out[out["shard"] == k].fillna({"doc_id": -1}).itertuples()) for k in range(shards)]
    assert got == want


def plain_buckets(text, bits, ngrams):
    """Hash buckets of the n-grams of a text, one at a time."""
    found, text = set(), text.lower()
    for n in ngrams:
        for at in range(len(text) - n + 1):
            h = 0x811C9DC5
            for c in text[at : at + n]:
                h = (h * 0x01000193 + ord(c) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            found.add(((h * 0x85EBCA6B + n) & 0xFFFFFFFF) >> (32 - bits))
    return found


def test_toxicity_scores_are_plain_sums(spark):
    rng = random.Random(1)
    bad, fine = ["you fool", "stupid ÄSS", "rotten swine"], ["nice day", "good work", "über fein"]
    texts = [" ".join(rng.choice(bad if k % 2 else fine) for _ in range(rng.randint(1, 5))) for k in range(60)]
    model = toxicity.fit(texts, [k % 2 for k in range(60)])
    # log-count ratios: presence of an n-gram in documents of either label, one added to each
    sets = [plain_buckets(t, model.bits, model.ngrams) for t in texts]
    for b in rng.sample(sorted(np.flatnonzero(model.slot >= 0).tolist()), 20):
        p, q = (sum(b in s for s in sets[k::2]) for k in (1, 0))
        ratio = math.log((p + 1) / 32) - math.log((q + 1) / 32)
        assert p + q >= 3 and np.sign(ratio) == np.sign(model.weight[model.slot[b]]) or abs(model.weight[model.slot[b]]) < 1e-6
    own = [*texts, "", "ab", "Fool" * 50, "a nice fool"]
    d = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate([*own, None])], DOCS)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    for k, t in enumerate([*own, ""]):
        z = model.bias + sum(float(model.weight[model.slot[b]]) for b in plain_buckets(t, model.bits, model.ngrams) if model.slot[b] >= 0)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_language_scores_are_plain_means(spark):
    rows = [(k, ("the cat sat on the mat " if k % 2 else "der hund und die katze ") * (1 + k % 9), "en" if k % 2 else "de", "s", 1) for k in range(40)]
    net = language.train(spark.createDataFrame(rows, DOCS))
    texts = ["the dog", "DIE KATZE " * 40, "12", "", "ä", "x" * 129]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS), net).collect()}
    for k, t in enumerate(texts):
        if not any(c.isalpha() for c in t):
            assert got[k] == ("und", 0.0)
            continue
        raw, mean = t.lower().encode(), np.zeros(2)
        for at in range(0, len(raw), language.LENGTH):
            seen = raw[at : at + language.LENGTH + language.WIDE - 1].ljust(language.LENGTH + language.WIDE - 1, b"\0")
            top = [max(sum(net.conv[o, seen[p + o], f] for o in range(language.WIDE)) for p in range(language.LENGTH)) + net.bias[f] for f in range(len(net.bias))]
            z = np.maximum(top, 0) @ net.dense + net.out
            mean += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(raw[at : at + language.LENGTH])
        mean /= len(raw)
        assert got[k][0] == net.langs[int(mean.argmax())] and got[k][1] == pytest.approx(mean.max(), abs=1e-4)


def plain_pairing(rows, reach):
    """Text of every page by looking at all pages of its host: the nearest in steps, then the nearest unlike one before or after."""
    out = {}
    for at, (pid, _, own) in enumerate(rows):
        mine = pages.article(own)
        near = [j for d in range(1, reach + 1) for j in (at - d, at + d)] + list(range(at - reach - 1, -1, -1)) + list(range(at + reach + 1, len(rows)))
        same = next((s for j in near if 0 <= j < len(rows) and (s := pages.compare(mine, rows[j][2])) is not None), set())
        out[pid] = pages.without(mine, same)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pages_pair_with_the_nearest_unlike(spark, seed):
    rng = random.Random(seed)
    bodies = [" ".join(f"w{k}x{n}" for n in range(12)) + "." for k in range(6)]  # unlike each other, so to be a copy is transitive
    head, foot = ["Acme news", "Acme sport", "Acme weather"], ["All rights reserved", "Imprint"]
    shown = []
    for k in range(60):
        body = shown[-1][1] if shown and rng.random() < 0.6 else rng.choice(bodies)
        shown.append((f"http://h.x/{k:03}", body, f"<div><p>{rng.choice(head)}</p><p>{body}</p><p>{rng.choice(foot)}</p></div>"))
    rows = [(k, u, pages.lines(h)) for k, (u, _, h) in enumerate(shown)]
    want = plain_pairing(rows, pages.REACH)
    got = {pid: text for pid, _, text in pages.differenced(((*r, 0) for r in rows))}
    assert got == want
    d = spark.createDataFrame([(k, u, h) for k, (u, _, h) in enumerate(shown)], "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in pages.extract_pages(d.withColumn("at", F.lit(0)), least=1000).collect()}
    assert whole == want
    assert pages.extract_pages(d.limit(0)).count() == 0
