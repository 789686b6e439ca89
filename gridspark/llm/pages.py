"""Main text of HTML pages: nearest-URL page differencing.

Pages of a host are ordered by URL path, and each page is paired with its nearest
neighbours in that order.  A page becomes a list of text lines (one per block, with the
region of the page it stands in); the lines of a pair are aligned by their longest
common subsequence and shared lines are template, so they are deleted.  Regions that
HTML itself marks as not being the article (nav, footer, aside, form, script, elements
whose class or id names a menu, advert, comment, notice, ... unless they wrap the page's
text) are dropped beforehand, as neighbours may show different adverts.  Inside an <article> or <main>, a shared line
counts as template only when it is no sentence (no closing punctuation) and is not the
page's heading.  A copy of the page says nothing about the template, so the next nearest
is used: a neighbour is a copy when nothing is left unshared on either side, when what is
left is one text with edits, or when the sentences are the same.

Defined cases: null or empty html gives "" ; a null URL is a host of its own with no
neighbours but its like; equal pages keep their text; repeated rows are extracted each;
very long pages are processed whole; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html as H
import itertools
import pickle
import re
import tempfile
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RANGE_BYTES, MOST_RANGES = 64 << 20, 20_000  # html of a range, unless that made more ranges than these
REACH = 3  # neighbours looked at on either side before the carried one
EDITED = 8  # words from which two rests can be one text with edits
# HTML element names by role.
SKIP = frozenset("script style noscript template head title nav header footer aside form button select option textarea input iframe object embed svg canvas audio video menu dialog map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BODY = frozenset("article main".split())
CLOSES_P = BLOCK - {"br"}
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template")
# Names in class, id or role of what is not the article, ...
NOT_ARTICLE = frozenset("ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsors sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs footer foot masthead topbar toolbar comment comments commentlist disqus respond reply replies cookie cookies consent gdpr newsletter subscribe signup login pagination pager copyright contentinfo complementary".split())
# ... of what is not unless it holds most of the page's text, ...
PERHAPS = frozenset("header sidebar side aside notice popup modal overlay search share sharing social related recommend recommended recommendations widget widgets tags skip hidden".split())
# ... and parts of compound names that say only where or how it stands ("site-footer", "ad-box-2").
BESIDE = frozenset("site main page top bottom left right center list box bar block section area container wrapper wrap inner outer item items link links button buttons panel unit slot row col column global primary secondary sub mini mobile desktop fixed sticky form title text module group zone holder the my our user reader post article entry".split())
TITLED = frozenset("post article entry".split())
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<!--.*?(?:-->|\Z)|<[!?][^>]*>""", re.S)
SPACES = re.compile(r"\s+")
SENTENCE = re.compile(r"[.!?…。！？][\"'”’)\]]*$")


@functools.lru_cache(4096)
def _named(value: str) -> int:
    """2 if a class, id or role names what is not the article, 1 if perhaps, else 0.

    A name counts as a whole: each of its hyphened parts is such a word or says where it
    stands, so "has-sidebar", "side-story" or "related-work" name nothing.
    """
    most = 0
    for name in value.lower().split():
        parts = [x for x in re.split(r"[-_]+", name) if x and not re.fullmatch(r"[0-9x]+", x)]
        words = [x for x in parts if x in NOT_ARTICLE or x in PERHAPS]
        if words and all(x in BESIDE or x in words for x in parts) and not ("header" in words and TITLED & set(parts)):
            most = max(most, 2 if any(x in NOT_ARTICLE for x in words) else 1)
    return most


def _skipped(tag: str, attrs: str) -> int:
    """3 for a region that HTML itself marks as no text of the page, else what its names say."""
    if tag in SKIP:
        return 3
    most = 0
    for name, a, b, c in ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value.lower())):
            return 3
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            most = max(most, _named(value))
    return most


@dataclass
class _Region:
    """An element whose names say that it is not the article."""

    outer: _Region | None
    sure: bool
    size: int = 0  # characters of text in it
    heading: bool = False  # whether it holds a first heading
    main: bool = False
    drop: bool | None = None

    def dropped(self, total: int) -> bool:
        """A wrapper around the article is none of these, whatever it is called."""
        if self.drop is None:
            most = self.size * 2 > total
            own = not (self.main or (most and (self.heading or not self.sure)))
            self.drop = own or (self.outer is not None and self.outer.dropped(total))
        return self.drop


def lines(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, inside the article, is a heading) of each block outside skipped regions, in page order."""
    out: list[tuple[str, bool, bool, _Region | None]] = []
    if not page:
        return []
    stack: list[tuple[str, int, _Region | None]] = []  # (tag, whether it began a skipped region, region around it)
    buf: list[str] = []
    region: _Region | None = None
    skipping = body = 0
    heading = False
    pos, lower = 0, None

    def flush():
        if buf:
            t = SPACES.sub(" ", H.unescape("".join(buf))).strip()
            buf.clear()
            if t:
                out.append((t, body > 0, heading, region))
                at = region
                while at:
                    at.size += len(t)
                    at = at.outer

    def leave(k):
        nonlocal skipping, body, heading, region
        while len(stack) > k:
            tag, skips, around = stack.pop()
            if tag in BLOCK or region is not around:
                flush()
            region = around
            skipping -= skips
            body -= tag in BODY
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = False

    while True:
        m = TAG.search(page, pos)
        if not skipping:
            buf.append(page[pos : m.start() if m else len(page)])
        if not m:
            break
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break  # a stray inline end tag closes no block
            else:
                if tag == "p" and not skipping:
                    flush()
            continue
        if tag in BLOCK and not skipping:
            flush()
        if tag in CLOSES_P or tag == "p":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    leave(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            like = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[tag]
            stop = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in like:
                    leave(k)
                    break
                if stack[k][0] in stop:
                    break
        if tag in RAW:
            lower = lower or page.lower()
            end = lower.find(f"</{tag}", pos)
            pos = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        skips = _skipped(tag, m[3])
        stack.append((tag, int(skips == 3), region))
        if 0 < skips < 3 and not skipping:
            flush()
            region = _Region(region, skips == 2)
        skipping += skips == 3
        body += tag in BODY
        at = region if not skipping and tag in ("h1", "main") else None
        while at:
            at.heading, at.main = at.heading or tag == "h1", at.main or tag == "main"
            at = at.outer
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = True
    flush()
    total = sum(len(x[0]) for x in out)
    return [x[:3] for x in out if x[3] is None or not x[3].dropped(total)]


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions of a that are in a longest common subsequence of the lines a and b.

    Hunt-Szymanski: work follows the number of matching pairs, not len(a) * len(b).
    """
    where: dict[str, list[int]] = {}
    for j, t in enumerate(b):
        where.setdefault(t, []).append(j)
    import bisect

    ends: list[int] = []
    links: list[tuple] = []
    for i, t in enumerate(a):
        for j in reversed(where.get(t, ())):
            k = bisect.bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    found, link = set(), links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def compare(own: list[tuple[str, bool, bool]], other: list[tuple[str, bool, bool]]) -> set[int] | None:
    """Positions of own that other shares, or None where other is a copy and so says nothing about the template.

    How much is shared does not make a copy, as a template may outweigh the text: what
    counts is the rest on both sides and, as sentences of a marked article are text, those.
    """
    texts = [x[0] for x in own]
    same = shared(texts, [x[0] for x in other])
    rest = [x for i, x in enumerate(own) if i not in same]
    held = Counter(texts[i] for i in same)
    marked = bool(own) and own[0][1] and all(x[1] for x in own)
    rest2 = []
    for x in other:
        if held[x[0]]:
            held[x[0]] -= 1
        elif x[1] or not marked or not any(y[1] for y in other):
            rest2.append(x)
    if not rest and not rest2:
        return None
    said = lambda rows: sum(len(x[0]) for x in rows if SENTENCE.search(x[0]))
    both = said(own[i] for i in same)
    if marked and both * 2 > said(own):
        return None
    if (not rest or not rest2 or not (said(rest) or said(rest2))) and both * 2 > sum(map(len, texts)):
        return None  # the same sentences; a line was added, or a date or counter differs
    a, b = (Counter(" ".join(x[0] for x in r).split()) for r in (rest, rest2))
    if min(a.total(), b.total()) >= EDITED and (a & b).total() * 4 >= max(a.total(), b.total()) * 3:
        return None  # the rest is one text with edits
    return same


def article(own: list[tuple[str, bool, bool]]) -> list[tuple[str, bool, bool]]:
    """In a page with a marked article, what is outside is not the article."""
    return [x for x in own if x[1]] if any(x[1] for x in own) else own


def without(own: list[tuple[str, bool, bool]], same: set[int]) -> str:
    """The text of a page without its template lines."""
    drop = {i for i in same if not own[i][1] or not (own[i][2] or SENTENCE.search(own[i][0]))}
    return " ".join(x[0] for i, x in enumerate(own) if i not in drop)


def extract(own: list[tuple[str, bool, bool]], near: list[list[tuple[str, bool, bool]]]) -> str:
    """The main text of a page, given the lines of its nearest neighbours, nearest first."""
    own = article(own)
    return without(own, next((same for other in near if (same := compare(own, other)) is not None), set()))


@dataclass
class _Page:
    id: int | None
    url: str | None
    guest: int  # 1 for a page of an adjoining range, which is no row of this one
    lines: list  # of the whole page
    own: list  # of its article
    before: list | None = None  # lines of the nearest earlier page that is no copy
    same: set[int] | None = None  # what the page just before shares


class _Waiting:
    """Pages that have met only copies; on disk over 32 MB, as a host may be one long run of copies."""

    def __init__(self):
        self.file, self.n, self.last = tempfile.SpooledTemporaryFile(32 << 20), 0, None

    def add(self, page: _Page):
        pickle.dump(page, self.file)
        self.n, self.last = self.n + 1, page

    def take(self):
        self.file.seek(0)
        for _ in range(self.n):
            yield pickle.load(self.file)
        self.file.close()


def differenced(rows, reach: int = REACH):
    """(page_id, url, text) of rows (page_id, url, lines, guest) of one host in the order of their paths.

    A page whose ``reach`` neighbours on either side are copies uses the nearest earlier
    page that is none, carried along the order; without one it waits for the next unlike page.
    """
    window: list[_Page] = []  # done pages, the current, pages ahead
    at = 0
    waiting = _Waiting()

    def finish():
        page = window[at]
        same = None
        for d in range(1, reach + 1):
            for j in (at - d, at + d):
                if same is None and 0 <= j < len(window):
                    same = page.same if j == at - 1 else compare(page.own, window[j].lines)
        if same is None and page.before:
            same = compare(page.own, page.before)
        page.before = page.before if at + 1 == len(window) else None  # only the newest page hands it on
        if page.guest:
            return
        if same is None:
            page.before = None
            waiting.add(page)
        else:
            yield page.id, page.url, without(page.own, same)

    for pid, url, own, guest in rows:
        page = _Page(pid, url, guest, own, article(own))
        if window:
            last = window[-1]
            page.same = compare(page.own, last.lines)
            page.before = last.before if page.same is None else last.lines
        window.append(page)
        if waiting.n and compare(waiting.last.own, page.lines) is not None:
            held, waiting = waiting, _Waiting()
            for x in held.take():
                same = compare(x.own, page.lines)
                if same is None:
                    waiting.add(x)
                else:
                    yield x.id, x.url, without(x.own, same)
        if len(window) - at > reach:
            yield from finish()
            at += 1
        if at > reach:
            window.pop(0)
            at -= 1
    while at < len(window):
        yield from finish()
        at += 1
    for x in waiting.take():
        yield x.id, x.url, without(x.own, set())


def order_key(url: F.Column) -> F.Column:
    """host, a separator and the path: pages of a host are together, ordered by path."""
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1))
    return F.concat(host, F.lit("\u0001"), F.regexp_extract(bare, r"^[^/?#]*(.*)$", 1))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["page_id", "url", "text"])


def _guests(found: dict[int, dict], reach: int) -> dict[str, list[int]]:
    """Key of a page -> ranges it visits; found: for each range its first and last pages and its nearest unlike ones.

    A range gets the ``reach`` nearest pages on either side and the nearest page that does
    not repeat the nearest, though whole ranges of one repeated page lie between.
    """
    out: dict[str, set[int]] = {}
    for way, near, unlike in ((1, "lasts", "unlike_last"), (-1, "firsts", "unlike_first")):
        held: list[tuple] = []  # (key, host, hash), nearest first
        far: tuple | None = None
        for p in sorted(found)[::way]:
            for x in [*held, *([far] if far else [])]:
                out.setdefault(x[0], set()).add(p)
            own = [tuple(x) for x in found[p][near]]
            mine = found[p][unlike]
            if mine is not None:
                far = tuple(mine)
            elif not (held and held[0][1] == own[0][1]):
                far = None  # another host
            elif held[0][2] != own[0][2]:
                far = held[0]
            held = [*own, *held][:reach]
    return {x: sorted(t) for x, t in out.items()}


def extract_pages(pages: DataFrame, reach: int = REACH, least: int = 64) -> DataFrame:
    """page_id, url, text of every page.

    Pages are dealt by ranges of (host, path), so a host with a third of all pages spreads
    over many tasks; ranges hold ``least`` pages or more on average.  Neighbours are the
    ``reach`` pages on either side and, where these are copies, the nearest page that is
    none.  Each range also gets the nearest pages of the adjoining ones as guests.
    """
    spark = pages.sparkSession
    whole = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length("html").cast("long")).alias("b")).first()
    n = max(1, min(max(C.parts(spark, 12), (whole.b or 0) // RANGE_BYTES), whole.n // least, MOST_RANGES))
    p = C.columns_of(pages, "page_id", "url", "html").withColumn("key", F.coalesce(order_key(F.col("url")), F.lit("")))
    p = p.withColumn("at", F.concat("key", F.lit("\u0001"), F.coalesce(F.lpad(F.col("page_id").cast("string"), 20, "0"), F.lit(""))))
    sample = sorted(r.at for r in p.select("at").orderBy(F.xxhash64("at")).limit(20 * n).collect()) if n > 1 else []
    edges = sorted({sample[len(sample) * k // n] for k in range(1, n)} if sample else set())  # fewer than n keys
    p = p.withColumn("p", C.below(edges, F.col("at")))
    if edges:
        host = F.substring_index("at", "\u0001", 1)
        one = F.array_sort(F.collect_list(F.struct("at", host.alias("host"), F.xxhash64("html").alias("h"))))
        unlike = lambda ref: F.filter("x", lambda y: (y["host"] == ref["host"]) & (y["h"] != ref["h"]))
        first, last = F.get("x", F.lit(0)), F.element_at("x", -1)
        x = p.groupBy("p").agg(one.alias("x")).select("p", F.slice("x", 1, reach).alias("firsts"), F.slice(F.reverse("x"), 1, reach).alias("lasts"), F.get(unlike(first), F.lit(0)).alias("unlike_first"), F.try_element_at(unlike(last), F.lit(-1)).alias("unlike_last"))
        visits = _guests({r.p: r.asDict() for r in x.collect()}, reach)  # a few keys a range
        g = spark.createDataFrame(list(visits.items()) or [("", [])], "at string, to array<int>")
        p = p.join(F.broadcast(g), "at", "left")
    else:
        p = p.withColumn("to", F.lit(None).cast("array<int>"))
    goes = F.concat(F.array(F.struct(F.col("p").alias("p"), F.lit(0).alias("guest"))), F.transform(F.coalesce("to", F.array().cast("array<int>")), lambda t: F.struct(t.alias("p"), F.lit(1).alias("guest"))))
    p = p.select("page_id", "url", "html", "key", "at", F.explode(goes).alias("q")).select("page_id", "url", "html", "key", "q.guest", "q.p", "at")
    ranges = len(edges) + 1
    own = C.labels(spark, ranges, ranges).tolist()  # a range to each task; a plain hash would give some several
    p = p.withColumn("p", F.get(F.expr(f"array({', '.join(map(str, own))})"), F.col("p")))
    p = p.repartition(ranges, "p").sortWithinPartitions("p", "at")

    def run(batches):
        def rows():
            for b in C.chunks(batches, "html"):
                for pid, url, page, key, guest, part in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                    yield (part, key.split("\u0001", 1)[0]), (pid, url, lines(page), guest)

        out: list[tuple] = []
        size = 0
        for _, group in itertools.groupby(rows(), lambda r: r[0]):
            for row in differenced((r[1] for r in group), reach):
                out.append(row)
                size += len(row[2])
                if size > 1 << 20:
                    yield _batch(out)
                    out, size = [], 0
        yield _batch(out)

    return p.mapInArrow(run, "page_id long, url string, text string")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(C.table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
