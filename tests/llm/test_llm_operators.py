"""The ten training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridspark.llm import common as C
from gridspark.llm import decontaminate, fingerprint, language, neardup, packing, pages, queries, rollups, sharding, suffix, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(300)]


def frame(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    d = spark.createDataFrame(rows, DOCS)
    # extra columns that clash with the operators' own names
    return d.withColumns({"g": F.lit("x"), "_id": F.lit("y"), "k": F.lit(None).cast("int"), "value": F.lit(1.5)}) if extra else d


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=3):
    """Copies, near copies, shared passages, empty, null, tiny and long texts."""
    rng = random.Random(seed)
    base, passage = prose(rng, 120), prose(rng, 30)
    out = [prose(rng, rng.randint(1, 150)) for _ in range(30)]
    for _ in range(40):  # one large group of near copies
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w))
    out += [base] * 5 + [passage + " " + prose(rng, 60) for _ in range(25)] + ["", None, "one", "a b c", "  \n ", prose(rng, 3000), base.upper()]
    rng.shuffle(out)
    return [(7 * i + 3, t) for i, t in enumerate(out)]


# ---- 1 -----------------------------------------------------------------------------------


def test_sharding_balances_bytes_and_numbers_rows(spark):
    rows = [*corpus(), *corpus(5)]  # repeated ids too
    out = sharding.kd_shards(frame(spark, rows, True), 8).toPandas()
    assert len(out) == len(rows) and set(out["shard"]) == set(range(8))
    size = out.groupby("shard")["size"].sum()
    assert out["size"].sum() == sum(len((t or "").encode()) + 16 for _, t in rows)
    assert size.max() - size.min() <= 2 * out["size"].max()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    crc = {i: set() for i, _ in rows}
    for i, t in rows:
        crc[i].add(zlib.crc32((t or "").encode()))
    assert all(r.text_crc32 in crc[r.doc_id] for r in out.itertuples())


def test_sharding_odd_inputs(spark):
    empty = frame(spark, []).limit(0)
    assert sharding.kd_shards(empty, 4).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None)] * 6, DOCS)
    out = sharding.kd_shards(one, 3).toPandas()
    assert out.groupby("shard").size().tolist() == [2, 2, 2]


# ---- 2 -----------------------------------------------------------------------------------


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    encode = tokens.encoder(tokens.default_path())
    for text in [*(x or "" for _, x in corpus()), "a  b\n\n c\t\t'tis it's <|endoftext|> ünï  ", "   ", "　 a", "日本語 text 123,456 —", "x" * 3000, "hello <|endoftext|> you", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n<|endoftext"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(encode("hello <|endoftext|> you"), "<u4")


def test_spfhp_places_everything():
    h = Counter(random.Random(1).choices(range(1, 65), k=5000))
    packs = packing.spfhp(h, 64)
    placed = Counter()
    for n, p in packs:
        assert sum(p) <= 64
        for length in p:
            placed[length] += n
    assert placed == h
    used, room = sum(k * v for k, v in h.items()), 64 * sum(n for n, _ in packs)
    assert used / room > 0.97
    assert packing.spfhp({}, 64) == []


def test_packing_round_trip(spark):
    rows = corpus()
    out = packing.pack(frame(spark, rows, True), width=64, with_ids=True).toPandas()
    encode = tokens.encoder(tokens.default_path())
    whole = {i: encode(t) + (1).to_bytes(4, "little") for i, t in rows}
    for i, g in out.groupby("doc_id"):
        g = g.sort_values("start")
        assert b"".join(bytes(x) for x in g["ids"]) == whole[i]
        assert (g["ids_crc32"] == [zlib.crc32(bytes(x)) for x in g["ids"]]).all() and (g["doc_tokens"] == len(whole[i]) // 4).all()
    assert set(out["doc_id"]) == set(whole)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 64
    assert packing.pack(frame(spark, []).limit(0), width=64).count() == 0


# ---- 3 -----------------------------------------------------------------------------------


def phrases(data: bytes) -> set:
    found, cur = set(), b""
    for k in range(len(data)):
        cur += data[k : k + 1]
        if cur not in found:
            found.add(cur)
            cur = b""
    return found | ({cur} if cur else set())


def test_fingerprints_against_phrase_sets(spark):
    rows = sorted(corpus())
    out = fingerprint.compare_with_next(frame(spark, rows, True), size=1 << 16).toPandas().set_index("doc_id")
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        r = out.loc[i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        a, b, c = (phrases(x.encode()) for x in (t, edited, nxt))
        jac = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert r.near_edited == pytest.approx(jac(a, b), abs=1e-3) and r.near_next == pytest.approx(jac(a, c), abs=1e-3)
    same = fingerprint.fingerprints(frame(spark, [(1, "abc abc"), (2, "abc abc"), (3, None)])).toPandas().set_index("doc_id")["fingerprint"]
    assert same[1] == same[2] != same[3] == ""
    one = fingerprint.compare_with_next(frame(spark, [(5, "abcd")])).first()
    assert one.near_next == 1.0
    assert fingerprint.compare_with_next(frame(spark, []).limit(0)).count() == 0


# ---- 4 -----------------------------------------------------------------------------------

CASES = {
    "<nav>Menu</nav><article><h1>T</h1><p>One &amp; two\n three.<br>four<p>Five.</article><footer>c</footer>": "T One & two three. four Five.",
    "<body><div class='comments'><p>hi</p></div><div id=sidebar>x</div><main><p>Text</p><script>var a='</p>';</script><form>f</form></main>": "Text",
    "<p>a<p>b<ul><li>c<li>d</ul>": "a b c d",
    "<article><aside>x</aside><p class=\"lead\">A&nbsp;B</p><div class='ad-box'>buy</div></article>": "A B",
    "<article><p>x <!-- no > --> y</p><div hidden>z</div></article>": "x y",
    "plain &lt;text&gt;": "plain <text>", "": "", "<p>open": "open", "<article></article>": "",
    '<div class="content has-sidebar"><p>Hello world.</p></div>': "Hello world.", '<div class="layout no-sidebar"><p>Hello world.</p></div>': "Hello world.",
    '<div id="side-story"><p>Hello world.</p></div>': "Hello world.", '<div class="tags-and-notes">Hello world.</div>': "Hello world.",
    '<article><div class="related-work">Hello world.</div></article>': "Hello world.", '<article><div class="article-header"><h1>T</h1></div><p>A.</p></article>': "T A.",
    '<div class="sidebar"><h1>T</h1><p>The whole page stands in here.</p></div><p>x</p>': "T The whole page stands in here. x", '<div class="menu"><main>A.</main><div class="menu">m</div></div>': "A.",
    '<h1>T</h1><p>A longer text than the rest.</p><div class="sidebar">x</div><div class="site-footer">y</div><div id="reader_comments">z</div><div class="ad-300x250">b</div><span class="cookie-notice">c</span>': "T A longer text than the rest.",
    '<p>Short.</p><div class="comments"><p>A reader says far more than the article itself does.</p></div>': "Short.",
}


@pytest.mark.parametrize("html", CASES)
def test_main_text(html):
    assert pages.extract(pages.lines(html), []) == CASES[html]


def test_differencing_drops_shared_lines_and_keeps_copies(spark):
    page = lambda body: f"<div><p>Acme news portal</p><p>{body}</p><p>All rights reserved</p></div>"
    rows = [(1, "http://h.x/a/1", page("First story is about a river and its long way to the sea and back again.")), (2, "http://h.x/a/2", page("Second story is about a mountain with snow on it all through the summer.")), (3, "http://other/a", page("Alone on this host.")), (4, "http://c.x/1", page("A copied story.")), (5, "http://c.x/2", page("A copied story.")), (6, None, None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))
    got = {r.page_id: r.text for r in pages.extract_pages(d.coalesce(1)).collect()}
    assert got[1].startswith("First") and got[1].endswith("again.") and got[2].startswith("Second")
    assert got[3].startswith("Acme") and "A copied story." in got[4] and got[6] == ""


def test_template_that_outweighs_the_text_goes():
    page = lambda *body: pages.lines("".join(f"<div>{x}</div>" for x in ("Home | News | Sport | Weather | Travel", *body, "All rights reserved by Acme Media Ltd.", "Imprint | Terms of use | Privacy | Jobs")))
    assert pages.extract(page("A short story."), [page("Other tidings.")]) == "A short story."
    assert pages.extract(page("Story number 1"), [page("Story number 2")]) == "Story number 1"
    long = "A river ran through the long valley and turned north at the old mill."
    whole = " ".join(x[0] for x in page(long))
    for copy in (page(long), page(long.replace("old", "new"))):
        assert pages.extract(page(long), [copy]) == whole  # copies say nothing
        assert pages.extract(page(long), [copy, page("Other tidings.")]) == long
    prose = [long, long.replace("river", "road") + " It did.", long.upper() + "!"]
    dated = [page(f"Posted {d} May", *prose) for d in (3, 4)]
    assert prose[1] in pages.extract(dated[0], dated[1:]) and prose[1] in pages.extract(dated[0], [page("Posted 3 May", *prose, "More.")])


@pytest.mark.parametrize("unlike", ["first", "last", "middle", "none"])
def test_runs_of_copies_meet_an_unlike_page(spark, unlike):
    page = lambda body: f"<div><p>Acme news portal</p><p>{body}</p><p>All rights reserved</p></div>"
    n, at = 21, {"first": 0, "last": 20, "middle": 10, "none": -1}[unlike]
    rows = [(k, f"http://h.x/{k:03}", page("Other tidings." if k == at else "A copied story.")) for k in range(n)]
    rows += [(k + 100, f"http://i.x/{k:03}", page("A copied story.")) for k in range(9)]  # another host lends no page
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract_pages(d).collect()}
    whole = "Acme news portal A copied story. All rights reserved"
    assert len(got) == len(rows) and all(got[k + 100] == whole for k in range(9))
    assert all(got[k] == ("Other tidings." if k == at else whole if at < 0 else "A copied story.") for k in range(n))


@pytest.mark.parametrize("least", [2, 7, 1000])
def test_ranges_do_not_change_the_text(spark, least):
    page = lambda body: f"<div><p>Acme news portal</p><p>{body}</p><p>All rights reserved</p></div>"
    bodies = [f"Tidings {k} of the {w}." for k, w in enumerate(WORDS[:12])] + ["A copied story."] * 30 + ["The end."]
    rows = [(k, f"http://h.x/{k:03}", page(b)) for k, b in enumerate(bodies)] + [(100 + k, f"http://{h}.x/1", page("Alone.")) for k, h in enumerate("abcxyz")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in pages.extract_pages(d, least=least).collect()]
    assert sorted(got) == [*enumerate(bodies), *((100 + k, "Acme news portal Alone. All rights reserved") for k in range(6))]
    assert pages.extract_pages(d.limit(0), least=least).count() == 0


def test_lcs_matches_dynamic_programming():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert len(pages.shared(a, b)) == t[-1][-1]


# ---- 5 -----------------------------------------------------------------------------------


def brute_removed(rows):
    seen, own, last, out = set(), set(), None, {}
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        if i != last:  # only a smaller doc_id covers
            seen |= own
            own, last = set(), i
        b = (t or "").encode()
        grams = [b[k : k + 50] for k in range(len(b) - 49)]
        cover = np.zeros(len(b) + 1, int)
        for k, g in enumerate(grams):
            if g in seen:
                cover[k] += 1
                cover[min(k + 50, len(b))] -= 1
        own.update(grams)
        gone = np.cumsum(cover[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        out.setdefault(i, []).append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "in_block"), [(20_000, 8), (2, 1000), (20_000, 2)])
def test_suffix_dedup_is_exact(spark, monkeypatch, hot, in_block):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "HOT_BLOCK", in_block)
    if in_block == 2:
        monkeypatch.setattr(suffix, "BUCKET", 1000)
    rng = random.Random(9)
    shared = [prose(rng, 25) for _ in range(4)]
    rows = [*corpus(), *[(1000 + k, prose(rng, rng.randint(0, 20)) + rng.choice(shared)[: rng.randint(40, 90)] + prose(rng, 5)) for k in range(60)], (5000, "a" * 400), (5001, "b" + "a" * 120), (5002, "é" * 60), (5003, "xé" * 3 + "é" * 50)]
    out = suffix.removed(frame(spark, rows, True)).collect()
    want = brute_removed(rows)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == sorted((i, *v) for i, vs in want.items() for v in vs)


def test_suffix_dedup_small_blocks_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 2000)
    monkeypatch.setattr(suffix, "GROUP", 1500)
    monkeypatch.setattr(suffix, "BUCKET", 4000)
    rows = [*corpus(), *corpus()[:20], (1, prose(random.Random(1), 40))]
    out = suffix.removed(frame(spark, rows)).collect()
    want = brute_removed(rows)
    assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in out) == sorted((i, v[1], v[3]) for i, vs in want.items() for v in vs)


class Frame:
    """Stands for a DataFrame and keeps the function it is given."""

    def groupBy(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self

    applyInArrow = mapInArrow


def test_a_full_bucket_is_settled_in_80_mb():
    rng, size = np.random.default_rng(3), 4096
    rows = [bytes(r).decode() for r in rng.integers(97, 123, (suffix.BUCKET // size, size), np.uint8)]
    rows += rows[:40]
    docs = pa.table([range(len(rows)), rows, [0] * len(rows)], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("base", pa.int64())]))
    blobs = pa.Table.from_batches(list(suffix.entries(Frame(), np.zeros(1, np.int32)).run(iter(docs.to_batches()))))
    settle = suffix.settle(Frame(), 5).run
    tracemalloc.start()
    try:
        out = settle(blobs)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    twice = suffix._stack(suffix._blobs(out, 4), suffix.WHOLE)[0]
    assert {*twice.tolist()} == {*range(len(rows) - 40, len(rows))}
    assert peak < 80, peak


def test_suffix_dedup_odd_inputs(spark):
    d = spark.createDataFrame([(None, "x" * 80, "en", "s", 80), (1, None, None, None, None), (2, "x" * 80, "en", "s", 80)], DOCS)
    got = {r.doc_id: r.n_removed for r in suffix.removed(d).collect()}
    assert got == {None: 0, 1: 0, 2: 0}
    kept = {r.doc_id: r.text for r in suffix.dedup_text(d.withColumn("g", F.lit(4))).collect()}
    assert kept[1] is None and kept[2] == "x" * 80
    assert suffix.removed(frame(spark, []).limit(0)).count() == 0


def test_rows_of_one_id_never_cover_each_other(spark):
    big, text = 5 * 10**18, prose(random.Random(2), 30)
    rows = [(7, text), (7, text), (big, "x" + text + "y"), (big, text), (big, None), (big, ""), (-big, "é" * 20)]
    d = frame(spark, rows, True)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removed(d).collect())
    assert got == sorted((i, *v) for i, vs in brute_removed(rows).items() for v in vs)
    assert {r[2] for r in got if r[0] == 7} == {0} and max(r[2] for r in got) > 0


def test_clashing_columns_stay(spark):
    text = prose(random.Random(2), 30)
    d = spark.createDataFrame([(5 * 10**18, text, 777, "i", "o", 3), (5 * 10**18, text, 778, "j", "p", 4), (1, text, 779, None, None, 5)], "doc_id long, text string, g int, _id string, _gone string, base int")
    key = ["doc_id", "g", "_id", "_gone", "base"]
    want = sorted(map(tuple, d.select(key).collect()), key=str)
    out = suffix.dedup_text(d)
    assert out.columns == d.columns and sorted(map(tuple, out.select(key).collect()), key=str) == want
    assert {r.g: r.text for r in out.collect()} == {777: "", 778: "", 779: text}
    kept = neardup.drop_near(d)
    assert kept.columns == d.columns and [tuple(r) for r in kept.select(key).collect()] == [x for x in want if x[0] == 1]
    low = spark.createDataFrame([(-(1 << 63), text), ((1 << 63) - 1, text), ((1 << 63) - 1, text)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_groups(low).collect()} == {(-(1 << 63), -(1 << 63)), ((1 << 63) - 1, -(1 << 63))}


def test_long_text_has_the_triggers_of_its_segments(monkeypatch):
    rng = random.Random(5)
    data, off = C.flat_bytes(pa.array([prose(rng, n) for n in (900, 3, 0, 400, 2000)]))
    whole = suffix.triggers(data, off)
    hashed = C.span_hash(data, *(x := np.sort(np.random.default_rng(1).integers(0, len(data), (2, 500)), 0)))
    monkeypatch.setattr(C, "SEGMENT", 256)
    assert all((a == b).all() for a, b in zip(whole, suffix.triggers(data, off), strict=True))
    assert (hashed == C.span_hash(data, *x)).all()


# ---- 6 -----------------------------------------------------------------------------------


def brute_groups(rows, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (find(i), {len(s) for s in sets[i]}) for i in ids}


@pytest.mark.parametrize(("num", "den", "k"), [(85, 100, 64), (4, 5, 64), (85, 100, 32)])
def test_near_groups_are_exact(spark, num, den, k):
    rows = corpus(11)
    want = brute_groups(rows, num, den)
    got = neardup.near_groups(frame(spark, rows, True), num, den, k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.doc_id][0] and r.n_shingles in want[r.doc_id][1], r


def test_near_groups_odd_inputs(spark):
    rows = [*corpus(11)[:30], *corpus(12)[:30]]  # repeated ids with other texts
    want = brute_groups(rows, 85, 100)
    assert all(r.component_id == want[r.doc_id][0] for r in neardup.near_groups(frame(spark, rows), 85, 100).collect())
    d = spark.createDataFrame([(None, "a b c d e f", "en", "s", 1), (4, "a b c d e f", None, None, None), (2, "A B C D E F", "en", "s", 1)], DOCS)
    got = {r.doc_id: r.component_id for r in neardup.near_groups(d).collect()}
    assert got == {None: None, 4: 2, 2: 2}
    assert sorted(r.doc_id or -1 for r in neardup.drop_near(d).collect()) == [-1, 2]
    assert neardup.near_groups(frame(spark, []).limit(0)).count() == 0


def test_streamed_lists_give_all_pairs(spark):
    """Lists that batches cut, among them long ones, against a plain loop."""
    rng = random.Random(3)
    rows = [(v, d, rng.randint(8, 12), False, 0) for v in range(60) for d in rng.sample(range(500), rng.choice([1, 2, 5, 16, 17, 90]))]
    d = spark.createDataFrame(rows, "value long, doc_id long, n long, long boolean, central long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        got = neardup.short_pairs(d, 4, 5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs, members = set(), set()
    for v in range(60):
        own = sorted((r[1], r[2]) for r in rows if r[0] == v)
        if len(own) > neardup.LONG:
            members |= {(v, x) for x, _ in own}
        else:
            pairs |= {(a, b) for i, (a, m) in enumerate(own) for b, n in own[i + 1 :] if min(m, n) * 5 >= max(m, n) * 4}
    assert {(r.a, r.b) for r in got if r.kind == 0} == pairs
    assert sorted((r.a, r.b) for r in got if r.kind == 1) == sorted(members)


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_components_against_union_find(spark, small):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_id_filter_never_loses(spark):
    ids = spark.range(0, 5000, 3)
    f = np.frombuffer(C.id_filter(ids, "id"), np.uint8)
    assert C.maybe_in(f, np.arange(0, 5000, 3)).all() and C.maybe_in(f, np.arange(1, 5000, 3)).mean() < 0.01


# ---- 7 -----------------------------------------------------------------------------------


def bench_rows(rng, n=12):
    return [(i, prose(rng, rng.randint(8, 40)).capitalize() + ". " + prose(rng, rng.randint(2, 12)).capitalize() + ".") for i in range(n)]


def test_retrieval_equals_scoring_everything():
    rng = random.Random(8)
    rows = [(i, *decontaminate.split_answer(t), t) for i, t in bench_rows(rng, 70)]
    ix = decontaminate.build(rows)
    texts = [prose(rng, 200) for _ in range(20)] + [prose(rng, 90) + " " + rng.choice(rows)[3] + " " + prose(rng, 90) for _ in range(20)]
    for t in texts:
        h, _ = decontaminate.hashes(pa.array([t]))
        at = np.searchsorted(ix.vocab, h)
        terms = np.where(ix.vocab[np.minimum(at, len(ix.vocab) - 1)] == h, at, -1)
        n = max(1, math.ceil(max(len(terms) - 64, 1) / 64))
        want = defaultdict(float)
        for p in range(n):
            own = np.unique(terms[p * 64 : p * 64 + 128])
            s = ix.impact[:, own[own >= 0]].sum(1).ravel()[: len(ix.items)]
            for e in np.flatnonzero(s >= decontaminate.THRESHOLD - 1e-6):
                want[int(ix.items[e])] = max(want[int(ix.items[e])], float(s[e]))
        got = decontaminate.search(ix, terms)
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in got)


@pytest.mark.parametrize("bound", [1 << 24, 600])
def test_leaks_found_clean_left_alone(spark, monkeypatch, bound):
    rng = random.Random(8)
    items = bench_rows(rng)
    clean = [(i, prose(rng, rng.randint(0, 300))) for i in range(20)] + [(90, ""), (91, None)]
    dirty = [(100 + i, prose(rng, rng.randint(0, 150)) + " " + t.upper() * (i % 2) + t * (1 - i % 2) + " " + prose(rng, 50)) for i, t in items]
    half = [(200 + i, prose(rng, 60) + " " + decontaminate.split_answer(t)[1]) for i, t in items]  # the answer alone is no leak
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate.indexes, "__defaults__", (bound,))
    d = frame(spark, clean + dirty + half, True)
    got = {r.doc_id: r.item_ids for r in decontaminate.leaks(d, b).collect() if r.contaminated}
    assert got == {100 + i: [i] for i, _ in items}
    kept = {r.doc_id for r in decontaminate.drop_leaks(d, b).collect()}
    assert kept == {i for i, _ in clean + half}
    assert decontaminate.leaks(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.leaks(d.limit(0), b).count() == 0


def test_parts_score_as_one_index(spark, monkeypatch):
    rng = random.Random(9)
    items = bench_rows(rng, 40)
    docs = frame(spark, [(i, prose(rng, 20) + " " + " ".join(t.split()[: rng.randint(3, 60)]) + " " + prose(rng, 20)) for i, t in items])
    b = spark.createDataFrame([*items, (3, items[7][1])], "item_id long, text string")
    out = []
    for bound in (1 << 24, 700):
        monkeypatch.setattr(decontaminate.indexes, "__defaults__", (bound,))
        out.append({r.doc_id: (r.contaminated, r.item_ids, r.n_retrieved, round(r.best_score, 5)) for r in decontaminate.leaks(docs, b).collect()})
    assert out[0] == out[1] and sum(v[2] for v in out[0].values()) > 10


def test_index_grows_with_its_words():
    rng = random.Random(4)
    words = lambda k: " ".join(f"x{rng.randrange(20_000)}" for _ in range(k))
    ix = decontaminate.build([(i, "", "", words(60)) for i in range(3000)])
    held = [ix.vocab, ix.top, *(getattr(x, k) for x in (ix.impact, ix.block_top) for k in ("start", "key", "value"))]
    assert sum(a.nbytes for a in held) < 40 * 60 * 3000


# ---- 8, 10 -------------------------------------------------------------------------------


def auc(score, y):
    o = np.argsort(score, kind="stable")
    rank = np.empty(len(o))
    rank[o] = np.arange(1, len(o) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    out = queries.QUERIES["op8_toxicity"](spark, d).toPandas()
    lab = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    t = out.merge(lab, on="doc_id")
    t = t[t["held_out"]]
    assert len(out) == 10_000 and out["score"].between(0, 1).all() and ((out["score"] >= 0.5) == (out["predicted"] == 1)).all()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()
    # about 40 % of this table's toxic rows hold no word that another row teaches
    assert auc(t["score"].to_numpy(), t["toxic"].to_numpy()) > 0.8 and (t["predicted"] == t["toxic"]).mean() > 0.93
    assert t[t["predicted"] == 1]["toxic"].mean() > 0.95


def test_toxicity_odd_inputs(spark):
    d = frame(spark, [(1, None), (2, ""), (3, "fine words here"), (3, "fine words here")], True)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(d, none)
    assert [r.score for r in toxicity.score(d, model).collect()] == [0.0] * 4
    assert toxicity.reject(d, model).count() == 4 and toxicity.score(d.limit(0), model).count() == 0
    own = toxicity.fit(["you idiot"] * 5 + ["nice day"] * 5, [1] * 5 + [0] * 5)
    p = toxicity.predict(own, pa.array(["idiot", "nice", None]))
    assert p[0] > 0.5 > p[1]


def test_toxicity_keeps_rare_toxic_rows(spark):
    rng = random.Random(6)
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5]
    bad = set(ids[::100])
    d = frame(spark, [(i, prose(rng, 30) + (" grobian" if i in bad else "")) for i in ids])
    labels = spark.createDataFrame([(i, int(i in bad)) for i in ids], "doc_id long, toxic int")
    for bounds in ({"max_rows": 40}, {"max_bytes": 6000}):
        model = toxicity.train(d, labels, **bounds)
        p = toxicity.predict(model, pa.array(["grobian", prose(rng, 30)]))
        assert p[0] > 0.5 > p[1]
    assert toxicity.MAX_FEATURES == 1 << 15


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = queries.QUERIES["op10_language"](spark, d).toPandas()
    t = out.merge(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(out) == 1000 and (t["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in t["doc_id"]]).all()
    assert (t[t["held_out"]]["lang_pred"] == t[t["held_out"]]["lang"]).mean() > 0.97


def test_language_sample_is_bounded_by_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "fit", lambda x, y, langs: seen.append((x.copy(), len(y), langs)))
    rows = [(k, ("ab " * 400) if k % 3 else "der hund", "en" if k % 3 else "de", "s", 1) for k in range(300)]
    language.train(spark.createDataFrame(rows, DOCS), max_docs=50, max_bytes=20_000)
    x, n, langs = seen.pop()
    long = -(-1200 // language.LENGTH)  # all windows of each whole text
    assert langs == ["de", "en"] and 0 < (n - int((x[:, 0] == ord("d")).sum())) <= 2 * long * 20_000 // 1200
    language.train(spark.createDataFrame(rows[1:2], DOCS), max_docs=50, max_bytes=1)
    assert seen.pop()[1] == long  # never fewer than one document

def test_language_odd_inputs(spark):
    rows = [(k, "the cat sat on the mat and the dog" if k % 2 else "der hund und die katze sind nicht da", "en" if k % 2 else "de", "s", 1) for k in range(40)]
    d = spark.createDataFrame([*rows, (100, None, "en", "s", 0), (101, "12 34!", None, "s", 0), (102, "", "de", "s", 0)], DOCS)
    net = language.train(d)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(d, net).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[1][0] == "en" and got[2][0] == "de"
    assert language.train(d.where("lang is null")) is None
    assert language.identify(d, None).where("lang_pred <> 'und'").count() == 0


def test_convolution_matches_a_plain_loop():
    rng = np.random.default_rng(0)
    net = language.fit(rng.integers(0, 256, (20, language.LENGTH + 3)).astype(np.uint8), rng.integers(0, 2, 20), ["a", "b"], epochs=1)
    x = rng.integers(0, 256, (2, language.LENGTH + 3)).astype(np.uint8)
    want = np.array([[max(sum(net.conv[k, row[p + k], f] for k in range(language.WIDE)) for p in range(language.LENGTH)) for f in range(net.conv.shape[2])] for row in x])
    assert np.allclose(language._conv(net, x).max(1), want, atol=1e-4)


# ---- 9 -----------------------------------------------------------------------------------


def test_rollup_batches(spark, tmp_path):
    e = lambda rows: spark.createDataFrame(rows, "action string, source string, lang string, tokenizer string, n_tokens long, n_chars long, old_tokenizer string, old_tokens long, old_chars long")
    store = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert store.totals().count() == 0
    first = e([("insert", "a", "en", "t1", 10, 40, None, None, None), ("insert", "a", "en", "t1", 5, 20, None, None, None), ("insert", None, None, "t1", 7, 9, None, None, None)])
    assert store.apply("1", first) and not store.apply("1", first)
    assert store.apply("2", e([("revise", "a", "en", "t2", 12, 40, "t1", 10, 40), ("delete", "a", "en", "t1", 5, 20, None, None, None)]))
    store.apply("3", first.limit(0))
    want = {("a", "en", "t2"): (1, 12, 40), (None, None, "t1"): (1, 7, 9)}
    read = lambda: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens, r.chars) for r in store.totals().collect()}
    assert read() == want
    assert store.compact("all") and read() == want and not store.apply("1", first)
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["fold=all"]
    assert not store.compact("all") and read() == want  # a known id
    assert store.apply("2b", first) and store.compact("2") and not store.apply("2", first)  # the id of a batch names another fold
    want[("a", "en", "t1")] = (2, 15, 60)
    want[(None, None, "t1")] = (2, 14, 18)
    assert read() == want and store.committed() == ["1", "2", "2b", "3"] and store.apply("2c", e([("delete", "a", "en", "t1", 10, 40, None, None, None), ("delete", "a", "en", "t1", 5, 20, None, None, None), ("delete", None, None, "t1", 7, 9, None, None, None)]))
    want = {("a", "en", "t2"): (1, 12, 40), (None, None, "t1"): (1, 7, 9)}
    half = tmp_path / "r" / "batch=4"
    half.mkdir()  # a job that died before its marker
    assert read() == want and store.apply("4", first) and read()[("a", "en", "t1")] == (2, 15, 60)


@pytest.mark.parametrize("step", ["rows", "replaces", "sweep", "part of the sweep"])
def test_compaction_survives_a_kill(spark, tmp_path, monkeypatch, step):
    import shutil

    e = lambda n: spark.createDataFrame([("insert", "a", "en", "t1", n, n, None, None, None)], "action string, source string, lang string, tokenizer string, n_tokens long, n_chars long, old_tokenizer string, old_tokens long, old_chars long")
    store = rollups.Rollup(spark, f"file://{tmp_path}/r")
    store.apply("1", e(10))
    store.compact("f0")
    store.apply("2", e(5))
    read = lambda s: [(r.docs, r.tokens) for r in s.totals().collect()]

    def killed(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(rollups.Rollup, "sweep", killed)
    with pytest.raises(KeyboardInterrupt):
        store.compact("f1")
    monkeypatch.undo()
    at = tmp_path / "r"
    if step in ("rows", "replaces"):  # died before the marker of that part
        for part in ("rows", "replaces")[("rows", "replaces").index(step) :]:
            shutil.rmtree(at / "fold=f1" / part) if part != step else (at / "fold=f1" / part / "_SUCCESS").unlink()
    elif step == "part of the sweep":
        shutil.rmtree(at / "fold=f0" / "replaces")
        (at / "batch=2" / "_SUCCESS").unlink()
    again = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert read(again) == [(2, 15)] and not again.apply("1", e(10)) and not again.apply("2", e(5))
    again.compact("f1")
    assert read(again) == [(2, 15)] and not again.apply("1", e(10)) and not again.apply("2", e(5))
    again.sweep()
    assert sorted(p.name for p in at.iterdir()) == ["fold=f1"] and read(again) == [(2, 15)]


def test_copies_leave_one_row(spark):
    rows = [(5, "a b c", "en", "s"), (3, "a b c", "de", "s"), (3, "a b c", "de", "s"), (None, "a b c", None, None), (None, "only", None, "s"), (None, "only", None, "s"), (7, None, "en", "t"), (6, "", "en", "t")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"h": F.lit(1), "n": F.lit("x"), "times": F.lit(3)})
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens, r.chars) for r in rollups.count_documents(d).collect()}
    assert {k[:2]: v for k, v in got.items() if k[2] == "words-2"} == {("s", "de"): (1, 3, 5), ("s", None): (1, 1, 4), ("t", "en"): (1, 0, 0)}
    assert rollups.count_documents(d.limit(0)).count() == 0


def test_token_counts_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in queries.QUERIES["op9_token_counts"](spark, d).collect()}
    encode, want, seen = tokens.encoder(tokens.default_path()), defaultdict(lambda: [0, 0]), set()
    for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect():
        if r.text in seen:
            continue
        seen.add(r.text)
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", r.text) if any(c.isalpha() for c in x)]
        for t, n in (("byte_bpe_50k", len(encode(r.text)) // 4), ("words-2", len(w))):
            want[(r.source, r.lang, t)][0] += 1
            want[(r.source, r.lang, t)][1] += n
    assert got == {k: tuple(v) for k, v in want.items()}


# ---- pipeline ----------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.01"
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs.toPandas().set_index("doc_id")]
    for name, stage in P.STAGES[:-1]:
        docs = C.cut(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        steps.append(docs.toPandas().set_index("doc_id"))
    full, clean, near, cutted, last = steps
    lab = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    tox = lab[lab == 1].index
    assert len(set(tox) - set(clean.index)) > 0.9 * len(tox) and len(set(lab[lab == 0].index) - set(clean.index)) < 0.05 * (lab == 0).sum()
    want = brute_groups(list(clean["text"].items()), 4, 5)
    assert set(near.index) == {i for i, (c, _) in want.items() if c == i}
    gone = brute_removed(list(near["text"].items()))
    assert all(hashlib.sha256(t.encode()).hexdigest() == gone[i][0][3] for i, t in cutted["text"].items() if t.isascii())
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()["text"]

    def grams(t, k):
        w = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())
        return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}

    def leaks(t, q):
        for side in decontaminate.split_answer(q):
            k = min(5, len(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", side)))
            want = grams(side, k)
            if not want or len(want & grams(t, k)) < 0.8 * len(want):
                return False
        return True

    leaking = {i for i, t in cutted["text"].items() if any(leaks(t, q) for q in items)}
    assert set(last.index) == set(cutted.index) - leaking
    out = P.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(out["doc_id"]) == set(last.index) and out.groupby("sequence_id")["length"].sum().max() <= 2048
