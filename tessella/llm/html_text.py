"""Main text of web pages: markup is read into lines, and lines that the nearest-URL page of the host shares are deleted."""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._base import ship, small_batches, stored, table

CHUNK_PAGES = 400  # pages of a host that are compared in one task; larger hosts are cut into ranges of the path order
EDGE = 6  # distinct contents on either side of a range that are sent to it from its neighbours
COPY_SHARE = 0.6  # a neighbour that shares more of a page's own characters is a copy of it, and the next nearest is asked
COMMON = 5  # a line that so many distinct contents of a host have is no page's own
FULL = 20  # a host of so many distinct contents is not taken for near copies of one article
OWN_SHARE = 0.05  # a page of fewer own characters may be one of many near copies

#: Elements whose content is not text, read up to their end tag.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|textarea|select|button|title"
#: Elements that hold no article text.
SKIPPED = frozenset("nav footer aside form dialog menu head fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption caption".split())
#: Names (class, id or role) of what the contract leaves out whose text may be another on each page, so that no pair of pages tells.
NAMES = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies footer menu nav navbar navigation newsletter notice notices popup sidebar sponsored toolbar".split())
#: Words that may follow them in a name.
BOXES = frozenset("area bar block body box container holder inner item left list outer right section slot thread wrap wrapper".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.I | re.S,
)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def named(value: str, names: frozenset[str]) -> bool:
    """Whether a class, id or role ends in one of the names, but for words of BOXES: "ad", "adBox", "user-comments", not "comment-free" or "share-of-market"."""
    for name in value.split():
        words = [w.lower() for w in WORD.findall(name)]
        while len(words) > 1 and words[-1] in BOXES:
            words.pop()
        if words and words[-1] in names:
            return True
    return False


def _marked(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is a menu, header, notice, advert, hidden or the like by its name or attributes."""
    if tag in SKIPPED or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("html", "body", "article", "main") and "comment" not in attrs.lower():
        return False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id", "role") and (named(value, NAMES) or not in_article and tag in ("div", "section") and named(value, frozenset({"header"}))):
            return True
    return False


def page_lines(page: str) -> list[tuple[str, bool, bool, bool]]:
    """(line, in an article, prose, marked) of each block that has text, in page order; marked: as a menu, advert and the like."""
    lines: list[tuple[str, bool, bool, bool]] = []
    stack: list[tuple[str, bool]] = []  # open elements; whether text in them is marked
    parts: list[str] = []
    articles = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            kind = next((t for t, _ in reversed(stack) if t not in INLINE), "")
            lines.append((text, articles > 0, kind in PROSE, bool(stack and stack[-1][1])))

    def close(to: int) -> None:
        nonlocal articles
        while len(stack) > to:
            tag = stack[-1][0]
            if tag not in INLINE:
                flush()
            articles -= tag in ("article", "main")
            stack.pop()

    def text(piece: str) -> None:
        if piece:
            parts.append(piece)

    at = 0
    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if stack[i][1] and not (i and stack[i - 1][1]):
                        flush()
                    close(i)
                    break
            continue
        if tag in VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph; an item ends an open item
                t = stack[i][0]
                if t == "p" or t == tag and tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                    close(i)
                    break
                if t not in INLINE and t not in PROSE:
                    break
        skip = bool(stack and stack[-1][1]) or _marked(tag, m["attrs"] or "", articles > 0)
        if not (m["attrs"] or "").endswith("/") or tag in PROSE:
            if skip and not (stack and stack[-1][1]):
                flush()  # marked text is a line of its own
            stack.append((tag, skip))
            articles += tag in ("article", "main")
    text(page[at:])
    close(0)
    flush()
    return lines


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Indexes of a's lines in a longest common subsequence with b (bit-parallel: a row of whole-number operations for each line of b)."""
    both = set(a) & set(b)
    if not both:
        return set()
    at_a = [i for i, x in enumerate(a) if x in both]
    b = [x for x in b if x in both]
    at: dict[str, int] = {}
    for j, i in enumerate(at_a):
        at[a[i]] = at.get(a[i], 0) | 1 << j
    full = (1 << len(at_a)) - 1
    v, rows = full, [full]
    for x in b:
        u = v & at[x]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # a zero bit j in row r: the common length grows from j to j + 1 letters of a against r lines of b
    found = set()
    r, j = len(b), len(at_a) - 1
    while r > 0 and j >= 0:
        if rows[r] >> j & 1:
            j -= 1
        elif not rows[r - 1] >> j & 1:
            r -= 1
        else:
            found.add(at_a[j])
            r, j = r - 1, j - 1
    return found


def content(lines: list[str]) -> int:
    """A hash of a page's lines; pages of equal lines have equal content."""
    return int.from_bytes(hashlib.blake2b("\n".join(lines).encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _common_from(lengths: list[int], having: list[int], n: int) -> tuple[int, bool]:
    """From how many of the n distinct contents on a page's line is not its own, and whether that is the usual number.

    Usually COMMON, on small hosts more than 3/4 of the contents. If that leaves the page next to nothing of its own it
    may be one of many near copies; then the number is the least that leaves it something.
    """
    usual = least = min(COMMON, 3 * n // 4 + 1)
    while least <= n and sum(x for x, k in zip(lengths, having, strict=True) if k < least) < OWN_SHARE * sum(lengths):
        least = min((k for k in having if k >= least), default=n) + 1
    return least, least == usual


def difference(pages: list[tuple[str, list[tuple]]], host: tuple[int, Callable[[str], int]] | None = None) -> list[set[int]]:
    """For pages of one host, (path, lines) in order of path: the indexes of each page's lines that are the site's frame.

    host: the number of the host's distinct contents and, for a line, how many of them have it (numbers below COMMON
    may be given as 0); counted from pages if left out. The frame is what the nearest neighbour shares that is no
    copy, and, on a host of FULL contents, what nearly all have. A copy shares most of the characters of the page's own lines, which few contents have; so there are at most
    4 of them, and the EDGE nearest distinct contents on either side are enough. If all are copies, or the page has
    next to nothing of its own, the frame is the lines that many contents have. With one other content there is no
    third to tell by, and a neighbour that shares most of the whole page is a copy. Articles may quote each other, so a
    shared paragraph or heading inside an article element is frame only if most of the host's contents have it, COMMON at least.
    """
    out = []
    texts = [[x[0] for x in lines] for _, lines in pages]
    contents = [content(x) for x in texts]
    if host is None:
        distinct = dict(zip(contents, texts, strict=True))
        host = len(distinct), Counter(x for t in distinct.values() for x in set(t)).__getitem__
    n, having = host
    for i, (path, lines) in enumerate(pages):
        counts = [having(x) for x in texts[i]]
        sure = {x for x, k in enumerate(counts) if n >= FULL and k >= n - n // 10}  # lines of nearly all contents
        lengths = [0 if x in sure else len(text) for x, text in enumerate(texts[i])]
        least, usual = _common_from(lengths, counts, n) if n > 2 else (n + 1, True)
        own = [x if k < least else 0 for x, k in zip(lengths, counts, strict=True)]
        drop = {x for x, k in enumerate(counts) if k >= least}
        lo, hi = i - 1, i + 1
        asked = {contents[i]}  # equal pages tell nothing new
        while usual and sum(lengths) and (lo >= 0 or hi < len(pages)):
            near = [len(commonprefix([path, pages[j][0]])) if 0 <= j < len(pages) else -1 for j in (lo, hi)]
            j = lo if near[0] >= near[1] else hi
            lo, hi = (lo - 1, hi) if j == lo else (lo, hi + 1)
            if contents[j] in asked:
                continue
            asked.add(contents[j])
            same = shared_lines(texts[i], texts[j])
            if sum(own[x] for x in same) <= COPY_SHARE * sum(own):
                drop = same
                break
        out.append({x for x in drop | sure if not (lines[x][1] and lines[x][2]) or counts[x] >= max(COMMON, n // 2 + 1)})
    return out


def _trimmed(newest: list[tuple[int, int]], older: dict[int, int]) -> dict[int, int]:
    """Content -> row of the EDGE nearest distinct contents: those of the nearer range first, then the older ones."""
    out = dict(newest)
    for k, v in older.items():
        out.setdefault(k, v)
    return dict(list(out.items())[:EDGE])


def range_of(starts: list[tuple[str, str, int]], key: tuple[str, str, int]) -> tuple[int, int]:
    """First and end of the ranges a row may be in: one, but for equal rows that fill ranges of their own."""
    lo, hi = bisect_left(starts, key), bisect_right(starts, key)
    return (lo, hi) if lo < hi else (hi - 1, hi)


def ranges(rows: DataFrame, chunk_pages: int) -> tuple[dict[str, list[tuple[str, str, int]]], dict[int, list[int]]]:
    """For rows(host, path, url, row, content): where each host's ranges of the order (path, url, row) begin, and row -> the ranges it is sent to besides its own.

    A range is sent the nearest EDGE distinct contents before and after it, from however far. Only the ends of ranges
    come to the driver: 2 * EDGE pairs of numbers and one key for each.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        first: dict[int, int] = {}
        last: dict[int, int] = {}
        host, n = None, 0

        def end() -> None:
            if n:
                done[-1] |= {"first": [{"c": c, "r": r} for c, r in first.items()], "last": [{"c": c, "r": r} for c, r in reversed(last.items())]}
            first.clear()
            last.clear()

        for b in batches:
            for r in b.to_pylist():
                if r["host"] != host or n == chunk_pages:
                    end()
                    host, n = r["host"], 0
                    done.append({k: r[k] for k in ("host", "path", "url", "row")})
                n += 1
                c = r["content"]
                if len(first) < EDGE:
                    first.setdefault(c, r["row"])
                last.pop(c, None)
                last[c] = r["row"]
                if len(last) > EDGE:
                    del last[next(iter(last))]
        end()
        pairs = pa.list_(pa.struct([("c", pa.int64()), ("r", pa.int64())]))
        yield pa.RecordBatch.from_pylist(done, pa.schema([("host", pa.string()), ("path", pa.string()), ("url", pa.string()), ("row", pa.int64()), ("first", pairs), ("last", pairs)]))

    order = ["host", "path", "url", "row"]
    pairs = "array<struct<c:long,r:long>>"
    got = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, f"host string, path string, url string, row long, first {pairs}, last {pairs}").collect()
    by_host: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r.host, r.path, r.url, r.row)):
        by_host.setdefault(r.host, []).append(r)
    sent: dict[int, list[int]] = {}
    for parts in by_host.values():
        for turn, far in ((list(enumerate(parts)), "last"), (list(enumerate(parts))[::-1], "first")):
            seen: dict[int, int] = {}
            for at, r in turn:
                for row in seen.values():
                    sent.setdefault(row, []).append(at)
                seen = _trimmed([(x.c, x.r) for x in r[far]], seen)
    return {h: [(r.path, r.url, r.row) for r in parts] for h, parts in by_host.items()}, sent


def _closed(lines: list[str]) -> bytes:
    """A page's lines as they are shuffled: squeezed page by page, which takes less room than a shuffle's own blocks do."""
    return zlib.compress(json.dumps(lines, ensure_ascii=False).encode())


def _opened(data: bytes) -> list[str]:
    return json.loads(zlib.decompress(data))


def main_text(pages: DataFrame, *, chunk_pages: int = CHUNK_PAGES) -> DataFrame:
    """The main text of every page: page_id, url, text.

    pages: page_id, url, html; other columns are ignored. Blocks of a page are lines, menus and all: character
    references decoded, white space turned into one space. Pages of a host are put in order of URL path and each is
    compared with its nearest neighbour: the longest common subsequence of their lines is the site's frame and is
    deleted. A neighbour that shares most of what few other pages of the host have is a copy of it and tells nothing;
    the next nearest is asked (see difference). What is left and differs from page to page, but lies in an element that
    the markup names as menu, header, footer, sidebar, notice, advert, form or comments (nav, header, footer, aside,
    form; NAMES), goes too. If lines in an article element are left, the text is those; else all that are left. Lines are
    joined by a line feed.

    Hosts of more than chunk_pages pages are cut into ranges of that order, so no task holds a host of any size; a
    range is also given the EDGE nearest distinct contents on either side, so that a page at its end meets its true
    neighbours. Null or invalid URLs belong to no host and their pages are
    compared with none. Null or empty html gives an empty text. Rows that repeat stay. An empty table gives an empty
    result.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    rows = rows.select("page_id", "url", "html", "host", F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"))

    kind = dict(rows.dtypes)["page_id"]
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))  # of the URLs alone
    large = stored(sizes.where((F.col("n") > chunk_pages) | (F.col("host") == "")), "page-hosts")
    # a host in it has more than chunk_pages pages; a broadcast only while it is a small table
    large = F.broadcast(large) if large.count() <= 100_000 else large
    rows = rows.withColumn("row", F.xxhash64("page_id", "html")).join(large, "host", "left")
    n_chunks = F.ceil(F.coalesce("n", F.lit(1)) / chunk_pages)
    rows = rows.select("page_id", "url", "html", "host", "path", "row", F.pmod(F.xxhash64("page_id"), n_chunks).cast("int").alias("lone"), F.col("n").isNotNull().alias("large"))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[x[0] for x in page_lines(x)] for x in b.column(4).to_pylist()]
            keys = [[content([h, x]) for x in set(lines)] for h, lines in zip(b.column(0).to_pylist(), got, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([content(x) for x in got], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["host", "path", "url", "row", "content", "lines"])

    keys = rows.where(F.col("large") & (F.col("host") != "")).select("host", "path", "url", "row", "html")
    keys = stored(keys.mapInArrow(contents, "host string, path string, url string, row long, content long, lines array<long>"), "page-keys")
    starts, sent = ranges(keys.drop("lines"), chunk_pages)
    n_contents = {r[0]: r[1] for r in keys.select("host", "content").distinct().groupBy("host").count().collect()}  # of large hosts
    edges = pages.sparkSession.sparkContext.broadcast((starts, sent, n_contents))
    least = min(COMMON, min((3 * n // 4 + 1 for n in n_contents.values() if n > 2), default=COMMON))
    common = keys.dropDuplicates(["host", "content"]).select(F.explode("lines").alias("line")).groupBy("line").count().where(F.col("count") >= least)

    def lines_of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = edges.value[0]
        for b in batches:
            found: dict[tuple[str, int, int], None] = {}
            for h, p, u, r, lines in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lo, hi = range_of(starts[h], (p, u, r))
                found |= dict.fromkeys((h, at, x) for at in range(lo, hi) for x in lines)
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["host", "chunk", "line"])

    known = keys.select("host", "path", "url", "row", "lines").mapInArrow(lines_of_ranges, "host string, chunk int, line long").distinct().join(common, "line")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sent, _ = edges.value
        for b in batches:
            url, page, host, path, row, lone = (b.column(i).to_pylist() for i in range(1, 7))
            took, chunk, own = [], [], []
            for i, (h, p, u, r) in enumerate(zip(host, path, url, row, strict=True)):
                at = lone[i] if h == "" else 0
                if h in starts:
                    lo, hi = range_of(starts[h], (p, u, r))
                    at = lo + i % (hi - lo)
                    for other in sent.get(r, ()):
                        if other != at:
                            took.append(i)
                            chunk.append(other)
                            own.append(False)
                took.append(i)
                chunk.append(at)
                own.append(True)
            got = [page_lines(x) for x in page]
            cols = [pa.array([_closed([x[0] for x in lines]) for lines in got], pa.binary()), pa.array([bytes(x[1] + 2 * x[2] + 4 * x[3] for x in lines) for lines in got], pa.binary())]
            whole = pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), b.column(5), *cols], names=["page_id", "url", "host", "path", "row", "lines", "flags"])
            whole = whole.take(pa.array(took, pa.int64()))
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(chunk, pa.int32()), pa.array(own, pa.bool_())], names=[*whole.schema.names, "chunk", "own"])

    keyed = rows.drop("large").mapInArrow(parse, f"page_id {kind}, url string, host string, path string, row long, lines binary, flags binary, chunk int, own boolean")

    def compare(group: pa.Table, common: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        name = rows[0]["host"]
        n = edges.value[2].get(name)  # None: a host of one range, whose pages are all here
        counts = dict(zip(common.column("line").to_pylist(), common.column("count").to_pylist(), strict=True))
        having = None if n is None else (n, lambda x: counts.get(content([name, x]), 0))
        rows.sort(key=lambda r: (r["path"], r["url"] or "", r["row"]))
        lines = [[(x, bool(f & 1), bool(f & 2), bool(f & 4)) for x, f in zip(_opened(r["lines"]), r["flags"], strict=True)] for r in rows]
        drops = difference([(r["path"], x) for r, x in zip(rows, lines, strict=True)], having) if name else [set()] * len(rows)
        texts = []
        for own, drop in zip(lines, drops, strict=True):
            left = [x for i, x in enumerate(own) if i not in drop and not x[3]]
            texts.append("\n".join(x[0] for x in ([x for x in left if x[1]] or left)))
        texts = [x for r, x in zip(rows, texts, strict=True) if r["own"]]
        rows = [r for r in rows if r["own"]]
        return pa.table({"page_id": pa.array([r["page_id"] for r in rows], group.schema.field("page_id").type), "url": pa.array([r["url"] for r in rows], pa.string()), "text": pa.array(texts, pa.string())})

    return keyed.groupBy("host", "chunk").cogroup(known.groupBy("host", "chunk")).applyInArrow(compare, f"page_id {kind}, url string, text string")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


ship(__name__)
