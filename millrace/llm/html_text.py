"""HTML extraction by differencing pages whose urls are nearest.

A page is cut into blocks (text lines) at block-level tags. Pages of a host are
sorted by url path; each is paired with the ``near`` nearest differing pages on
either side, its lines are aligned with theirs by longest common subsequence,
and shared lines are marked. What a page declares of itself settles the rest:

* lines in a declared article (``article``, ``main``) stay, as articles quote each other, but for elements in it that are
  no content by tag (``form``, ``aside``) or by a whole class or id (``ad``, ``comments``); parts of class names decide nothing there;
* lines in declared boilerplate (menus, headers, footers, asides, forms,
  notices, adverts, comments, by tag, class, id or role) go if one paired page
  shares them, and even if none does;
* of all others those go that at least two of the paired pages share, or the
  only paired page. A page all of whose lines would go so keeps them: it then is a copy.

Hosts of any size are spread over tasks: pages are dealt to parts, ranges of
(host, path, page id, hash of the html) with bounds from a sample that affects
no row of the result, and a first pass over short rows tells which pages on either side of a part
are neighbours of its pages; these are sent to it as well. So every page meets
its true neighbours whatever the number of parts. Tasks stream pages in order
and hold a few at a time; equal rows are dealt to several parts.

Defined cases: null or empty html gives an empty text; a null url is an empty
host and path; equal paths are ordered by page id, then by hash; unclosed
elements end with the element around them, tags that never close are text; repeated rows and pages with equal
lines are extracted alike and never difference each other; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.lines import common
from millrace.llm.common import slices
from millrace.llm.urls import split_url

#: Where a line stands.
PLAIN, ARTICLE, BOILERPLATE = 0, 1, 2
#: Parts of pages at most, and bounds drawn for each.
MAX_PARTS, DRAWN = 20_000, 4
#: Longer paths are no bounds.
BOUND_CHARS = 500

# HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object".split())
DROPPED = frozenset("nav footer aside form button select dialog menu head".split()) | RAW
MAIN = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
# Words in class, id or role that mark boilerplate.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget header masthead footer foot toolbar skip "
    "comment comments commentlist disqus replies reply discussion respond related recommended share sharing social tags".split()
)
# Whole classes or ids that mark boilerplate even inside a declared article, on elements that are no inline ones.
MARKED_WHOLE = frozenset("ad ads advert adverts advertisement advertising sponsored comment comments commentlist comment-list disqus_thread replies newsletter cookie-notice sidebar".split())
NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
ATTRIBUTES = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+""")
#: Tags whose quotes do not close, after which a page's quotes are no longer looked at.
BAD_QUOTES = 100
MARK = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
SPLIT = re.compile(r"[^A-Za-z0-9]+")


def is_marked(attributes: str) -> bool:
    """Whether class, id or role name boilerplate."""
    if "=" not in attributes:
        return bool(attributes) and bool(HIDDEN.search(attributes))
    for m in MARK.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if any(w.lower() in MARKED for w in SPLIT.split(value)) or any(w.lower() in MARKED for w in SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value))):
            return True
    return bool(HIDDEN.search(attributes))


def is_marked_inside(attributes: str) -> bool:
    """Whether a whole class or id names what is no part of an article that it stands in."""
    if "=" not in attributes:
        return bool(attributes) and bool(HIDDEN.search(attributes))
    return any(w.lower() in MARKED_WHOLE for m in MARK.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").split()) or bool(HIDDEN.search(attributes))


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Begin, end, whether it closes, name (empty: a comment) and attributes of all markup; a caller may send where to go on.

    Every character is looked at a bounded number of times: a tag whose quotes do
    not close ends at the next ``>``, and after many of these quotes count no more.
    """
    at, bad = 0, 0
    while (start := page.find("<", at)) >= 0:
        name = NAME.match(page, start)
        if name is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                end = len(page) if end < 0 else end + 3
            elif page[start + 1 : start + 2] in ("!", "?"):
                end = page.find(">", start) + 1
                if not end:
                    return
            else:
                at = start + 1
                continue
            moved = yield start, end, False, "", ""
        else:
            stop = ATTRIBUTES.match(page, name.end()).end() if bad < BAD_QUOTES else len(page)
            if stop == len(page):
                bad += 1
            if not page.startswith(">", stop):
                stop = page.find(">", name.end())
                if stop < 0:
                    return
            end = stop + 1
            moved = yield start, end, bool(name[1]), name[2].lower(), page[name.end() : stop]
        at = end if moved is None else moved


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, zone) of a page's blocks in order."""
    out: list[tuple[str, int]] = []
    seen: list[str] = []  # of the open block
    hidden: list[str] = []  # of the open block, in declared boilerplate
    stack: list[tuple[str, bool, bool]] = []  # name, is boilerplate, is an article
    opened: Counter[str] = Counter()  # names on the stack
    dropped = mains = 0

    def close() -> None:
        for parts, zone in ((seen, ARTICLE if mains else PLAIN), (hidden, BOILERPLATE)):
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    out.append((text, zone))
                parts.clear()

    def pop() -> str:
        nonlocal dropped, mains
        name, drops, is_main = stack.pop()
        opened[name] -= 1
        dropped -= drops
        mains -= is_main
        return name

    at, found = 0, tags(page)
    tag = next(found, None)
    while tag is not None:
        start, end, closes, name, attributes = tag
        if start > at:
            (hidden if dropped else seen).append(page[at:start])
        at, moved = end, None
        if name and name not in INLINE:
            if name == "br":
                (hidden if dropped else seen).append("\n")
            else:
                close()
        if not name:
            pass
        elif closes:
            if opened[name]:
                while pop() != name:
                    pass
        elif name in VOID or attributes.endswith("/"):
            pass
        elif name in RAW:
            last = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
            at = moved = last.end() if last else len(page)
        else:
            is_main = name in MAIN and not dropped
            if mains:
                marked = name not in INLINE and is_marked_inside(attributes)
            else:
                marked = name not in ("html", "body") and is_marked(attributes)
            drops = name in DROPPED or (name == "header" and not mains) or marked
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
                pop()
            stack.append((name, drops, is_main and not drops))
            opened[name] += 1
            dropped += drops
            mains += is_main and not drops
        try:
            tag = found.send(moved)
        except StopIteration:
            tag = None
    if at < len(page):
        (hidden if dropped else seen).append(page[at:])
    close()
    return out


@dataclass
class Page:
    lines: list[str]
    zones: tuple[int, ...]
    shares: np.ndarray
    met: int = 0

    @classmethod
    def of(cls, page: str | None) -> Page:
        found = blocks(page or "")
        return cls([t for t, _ in found], tuple(z for _, z in found), np.zeros(len(found), np.int64))

    @property
    def line_key(self) -> bytes:
        return xxhash.xxh128_digest("\n".join(self.lines).encode("utf-8", "surrogatepass"))

    def against(self, other: list[str]) -> None:
        """Count the lines shared with a neighbour."""
        self.shares += common(self.lines, other)
        self.met += 1

    def deleted(self) -> np.ndarray:
        """Lines that differencing deletes."""
        zones = np.array(self.zones, int)
        return (self.shares >= np.where(zones == BOILERPLATE, 1, min(2, max(self.met, 1)))) & (zones != ARTICLE)

    def text(self) -> str:
        kept = [(t, gone) for t, z, gone in zip(self.lines, self.zones, self.deleted(), strict=True) if z != BOILERPLATE]
        return " ".join([t for t, gone in kept if not gone] or [t for t, _ in kept])


class Run:
    """Pages one after another with equal lines: one page for each kind of zones, and whose it is."""

    def __init__(self, key: bytes, lines: list[str]):
        self.key, self.lines, self.groups = key, lines, {}


class Pairing:
    """Pages in order of host and path go in; done ones come out as (page, ids and urls)."""

    def __init__(self, near: int):
        self.near, self.host = near, None
        self.runs: deque[Run] = deque()  # of the host: the last, and 2 near before it

    def add(self, host: str, page: Page, owner: tuple | None) -> list[tuple[Page, list[tuple]]]:
        """``owner`` is (page id, url), or None for a page that is a neighbour only."""
        done: list = []
        if host != self.host:
            done, self.host = self.flush(), host
        key = page.line_key
        if not self.runs or self.runs[-1].key != key:
            self.runs.append(Run(key, page.lines))
            for earlier in list(self.runs)[-1 - self.near : -1]:
                for other, _ in earlier.groups.values():
                    other.against(page.lines)
            if len(self.runs) > self.near + 1:
                settled = self.runs[-2 - self.near]
                done += settled.groups.values()
                settled.groups = {}
            if len(self.runs) > 2 * self.near + 1:
                self.runs.popleft()
        if owner is not None:
            groups = self.runs[-1].groups
            if page.zones not in groups:
                for earlier in list(self.runs)[-1 - self.near : -1]:
                    page.against(earlier.lines)
                groups[page.zones] = (page, [])
            groups[page.zones][1].append(owner)
        return done

    def flush(self) -> list[tuple[Page, list[tuple]]]:
        done = [group for run in self.runs for group in run.groups.values()]
        self.runs.clear()
        return done


class Parts:
    """Deals pages to ranges of (host, path, page id, hash)."""

    def __init__(self, bounds: list[tuple]):
        self.bounds, self.count = sorted(bounds), 0

    def of(self, host: str, path: str, page_id: int | None, mixed: int) -> int:
        key = bound(host, path, page_id, mixed)
        low, high = bisect.bisect_left(self.bounds, key), bisect.bisect_right(self.bounds, key)
        if high > low:  # equal rows, dealt in turn to all parts that may hold them
            self.count += 1
            return low + (self.count + TaskContext.get().partitionId()) % (high - low + 1)
        return low


def bound(host: str, path: str, page_id: int | None, mixed: int) -> tuple:
    return host, path, page_id is not None, page_id or 0, mixed


def row_key(host: str, path: str, page_id: int | None, mixed: int) -> int:
    return xxhash.xxh64_intdigest(repr((host, path, page_id, mixed)).encode("utf-8", "surrogatepass")) >> 1


def carried(ends: dict[int, list[list[tuple]]], near: int) -> dict[int, list[int]]:
    """Row key to the parts that need the row beside their own.

    ``ends`` has by part its first and its last ``near + 1`` runs in order, as
    (host, line key, row key).
    """
    out: dict[int, list[int]] = {}
    numbers = sorted(ends)
    for forth in (False, True):
        order = numbers if forth else numbers[::-1]
        for at, part in enumerate(order):
            # From the part's own edge outwards over the parts before (or behind) it.
            own = ends[part][1][-1] if forth else ends[part][0][0]
            last, found = own[:2], 0
            for other in order[at + 1 :]:
                first, final = ends[other]
                for host, key, row in first if forth else final[::-1]:
                    if host != own[0] or found == near:
                        break
                    if (host, key) != last:
                        last, found = (host, key), found + 1
                        out.setdefault(row, []).append(part)
                if host != own[0] or found == near:
                    break
    return out


def extract(pages: DataFrame, near: int = 2, part_pages: int = 128) -> DataFrame:
    """``page_id, url, text, n_chars, n_lines, n_deleted`` of every page.

    ``n_lines`` counts a page's lines, ``n_deleted`` those that differencing
    deletes, boilerplate included.
    """
    spark = pages.sparkSession
    typed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = split_url(typed).select("page_id", "url", "host", "path", F.xxhash64("html").alias("mixed"), "html")
    total = typed.select("page_id").count()
    n_parts = max(1, min(MAX_PARTS, -(-total // part_pages)))
    sample = found.filter(F.length("path") <= BOUND_CHARS).select("host", "path", "page_id", "mixed").sample(min(1.0, DRAWN * n_parts / max(total, 1)), seed=5).collect() if n_parts > 1 else []
    drawn = sorted(bound(*r) for r in sample)
    bounds = [drawn[k * len(drawn) // n_parts] for k in range(1, n_parts)] if drawn else []
    everywhere = spark.sparkContext.broadcast(bounds)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(everywhere.value)
        for batch in slices(batches, 5):
            rows = []
            for page_id, _, host, path, mixed, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((parts.of(host, path, page_id, mixed), host, path, page_id, mixed, Page.of(source).line_key))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "host", "path", "page_id", "mixed", "lines"])

    order = ["part", "host", "path", "page_id", "mixed"]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, tail = None, [], deque(maxlen=near + 1)
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([part] * 2, pa.int32()), pa.array([False, True]), pa.array([[list(map(str, r)) for r in x] for x in (head, tail)], pa.list_(pa.list_(pa.string())))], names=["part", "last", "runs"])
        for batch in batches:
            for number, host, path, page_id, mixed, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != part:
                    if part is not None:
                        yield pack()
                    part, head, tail = number, [], deque(maxlen=near + 1)
                run = (xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass")), xxhash.xxh64_intdigest(lines))
                if not tail or tail[-1][:2] != run:
                    run += (row_key(host, path, page_id, mixed),)
                    tail.append(run)
                    if len(head) <= near:
                        head.append(run)
        if part is not None:
            yield pack()

    wanted: dict[int, list[int]] = {}
    if bounds:
        light = found.mapInArrow(short, "part int, host string, path string, page_id bigint, mixed bigint, lines binary").repartition("part").sortWithinPartitions(*order)
        by_part: dict[int, list] = {}
        for r in light.mapInArrow(ends, "part int, last boolean, runs array<array<string>>").toLocalIterator():  # 2 rows a part
            by_part.setdefault(r.part, [None, None])[r.last] = [tuple(map(int, x)) for x in r.runs]
        wanted = carried(by_part, near)
    also = spark.sparkContext.broadcast(wanted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sent = Parts(everywhere.value), set()
        for batch in slices(batches, 5):
            rows, owns, takes = [], [], []
            for i, (page_id, host, path, mixed) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True)):
                own = parts.of(host, path, page_id, mixed)
                rows.append(own)
                owns.append(True)
                takes.append(i)
                if also.value and (key := row_key(host, path, page_id, mixed)) in also.value and key not in sent:
                    sent.add(key)
                    for part in also.value[key]:
                        rows.append(part)
                        owns.append(False)
                        takes.append(i)
            taken = batch.take(pa.array(takes)) if len(takes) > batch.num_rows else batch
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(owns), *taken.columns], names=["part", "owned", *batch.schema.names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pairing = None, Pairing(near)

        def pack(done: list[tuple[Page, list[tuple]]]) -> Iterator[pa.RecordBatch]:
            for page, owners in done:
                text, gone = page.text(), int(page.deleted().sum())
                step = max(1, (1 << 20) // (len(text) + 1))
                for k in range(0, len(owners), step):
                    ids, links = zip(*owners[k : k + step], strict=True)
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(links, pa.string()), pa.array([text] * n, pa.string()), pa.array([len(text)] * n, pa.int64()), pa.array([len(page.lines)] * n, pa.int64()), pa.array([gone] * n, pa.int64())],
                        names=["page_id", "url", "text", "n_chars", "n_lines", "n_deleted"],
                    )

        for batch in slices(batches, 7):
            done: list = []
            for number, owned, page_id, url, host, source in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 7)), strict=True):
                if number != part:
                    done += pairing.flush()
                    part = number
                done += pairing.add(host, Page.of(source), (page_id, url) if owned else None)
            yield from pack(done)
        yield from pack(pairing.flush())

    dealt = found.mapInArrow(deal, "part int, owned boolean, page_id bigint, url string, host string, path string, mixed bigint, html string")
    ordered = dealt.repartition("part").sortWithinPartitions(*order)
    return ordered.mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint, n_lines bigint, n_deleted bigint")
