"""Main-text extraction: markup rules and nearest-URL page differencing.

Each page is cut into blocks of text.  Markup rules flag menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and comments.  Pages are then paired with the page of nearest URL path on their host,
their blocks are aligned by a longest common subsequence (LCS), and shared blocks are deleted.

On pages whose menus and footers differ from page to page while articles share whole lines (licences,
quotations), differencing alone errs both ways.  So flagged blocks always go, and a block inside an explicit
``article`` or ``main`` element stays even when shared; differencing decides on all others, with such an
element on the page or without.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
SKIP = frozenset("nav header footer aside form button select menu dialog head object audio video canvas fieldset".split())
CONTENT = frozenset(("article", "main"))
#: Words in class, id or role that mark furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo|sidebar|side-bar|widget|menu|navbar|navigation|nav|"
    r"breadcrumbs?|footer|header|masthead|cookies?|consent|notice|gdpr|popup|modal|overlay|newsletter|subscribe|"
    r"signup|comments?|comment-list|disqus|respond|replies|reply|share|sharing|social|related|recommended|"
    r"pagination|pager|toolbar|search|login|complementary|contentinfo|alert)(?:$|[\s_-])",
    re.I,
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|"
    r"<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|"
    r"<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[A-Za-z/])[^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: Pages of a part of the order by URL, and the most parts; the neighbours of pages at an edge are carried over.
FOLDER_PAGES, MOST_PARTS = 500, 4096
#: A neighbour that shares more of a page's article (without one: of its undecided text) is a copy, and deletes nothing.
COPY_SHARE = 0.5

FLAGGED, OPEN, ARTICLE = 0, 1, 2


def blocks(html: str | None) -> tuple[list[str], list[int]]:
    """Texts of all blocks in page order, and for each FLAGGED, OPEN or ARTICLE.

    Unclosed elements end with their parent, stray end tags are ignored, an ``article`` or ``main`` ends
    furniture left open, and a tag or comment cut off by the page's end is dropped.
    """
    lines: list[str] = []
    kinds: list[int] = []
    if not html:
        return lines, kinds
    stack: list[tuple[str, bool, bool]] = []
    opened: Counter[str] = Counter()  # how many of a name are open, and where the open blocks are: nothing is searched
    where: list[int] = []
    piece: list[str] = []
    flagged = inside = 0

    def flush() -> None:
        if piece:
            text = " ".join(entities.unescape("".join(piece)).split())
            piece.clear()
            if text:
                lines.append(text)
                kinds.append(FLAGGED if flagged else ARTICLE if inside else OPEN)

    def pop() -> None:
        nonlocal flagged, inside
        name, bad, main = stack.pop()
        opened[name] -= 1
        if name in BLOCK:
            where.pop()
        flagged -= bad
        inside -= main

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            piece.append(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            piece.append("\n")
        if tag in BLOCK:
            flush()
        if m["close"]:
            if opened[tag]:
                while stack[-1][0] != tag:
                    if stack[-1][0] in BLOCK:
                        flush()
                    pop()
                pop()
        elif tag not in VOID and not (m["attrs"] or "").endswith("/"):
            if tag in BLOCK and where and stack[where[-1]][0] == "p":  # a block ends an open paragraph
                at_p = where[-1]
                while len(stack) > at_p:
                    pop()
            if flagged and (tag in CONTENT or tag == "body"):
                for i, (name, bad, main) in enumerate(stack):
                    flagged -= bad
                    stack[i] = (name, False, main)
            bad = tag in SKIP
            if not bad and tag not in CONTENT and m["attrs"] and tag not in ("html", "body"):
                bad = any(FURNITURE.search("".join(x)) for x in NAMED.findall(m["attrs"]))
            if tag in BLOCK:
                where.append(len(stack))
            opened[tag] += 1
            stack.append((tag, bad, tag in CONTENT))
            flagged += bad
            inside += tag in CONTENT
    if at < len(html):
        piece.append(html[at:])
    flush()
    return lines, kinds


def shared(a: list[str], b: list[str]) -> list[bool]:
    """Which items of ``a`` lie on a longest common subsequence with ``b``.

    Bit-parallel: one row of the alignment is one integer of ``len(b)`` bits.  Equal ends are cut off first.  Only
    every so many rows are kept, about the square root, and those between are made again on the way back.
    """
    out = [False] * len(a)
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        out[lo] = True
        lo += 1
    hi_a, hi_b = len(a), len(b)
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
        out[hi_a] = True
    there: dict[str, int] = {}
    for j in range(lo, hi_b):
        there[b[j]] = there.get(b[j], 0) | 1 << (j - lo)
    own = [i for i in range(lo, hi_a) if a[i] in there]
    if not own:
        return out
    full = (1 << (hi_b - lo)) - 1

    def below(row: int, some: list[int]) -> Iterator[int]:
        """Rows of the alignment after ``row``, one for each of the items."""
        for i in some:
            match = row & there[a[i]]
            row = ((row + match) | (row - match)) & full
            yield row

    step = max(1, math.isqrt(len(own)))
    starts, row = [full], full
    for k in range(0, len(own), step):
        for row in below(row, own[k : k + step]):  # noqa: B007
            pass
        starts.append(row)
    j = hi_b - lo
    for block in range((len(own) - 1) // step, -1, -1):
        some = own[block * step : (block + 1) * step]
        rows = [starts[block], *below(starts[block], some)]
        for k in range(len(some), 0, -1):
            # a zero bit marks a step of the alignment; the item is used where its row makes a new one
            now, before = (~rows[x] & ((1 << j) - 1) for x in (k, k - 1))
            if now.bit_count() > before.bit_count():
                out[some[k - 1]] = True
                j = (now & there[a[some[k - 1]]]).bit_length() - 1  # the last step that the item makes
    return out


def decide(lines: list[str], kinds: list[int], other: list[str] | None) -> tuple[list[str], int]:
    """The lines kept, given the neighbour's lines, and how many were deleted as shared."""
    alike = shared(lines, other) if other else [False] * len(lines)
    told = ARTICLE if ARTICLE in kinds else OPEN  # what tells a copy: the article's text, or else all undecided text
    size = sum(len(x) for x, k in zip(lines, kinds) if k == told)
    common = sum(len(x) for x, k, s in zip(lines, kinds, alike) if k == told and s)
    copy = common > COPY_SHARE * size
    kept, gone = [], 0
    for x, k, s in zip(lines, kinds, alike):
        if k == ARTICLE or (k == OPEN and (copy or not s)):
            kept.append(x)
        elif s and not copy:
            gone += 1
    return kept, gone


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; a null or odd URL gives empty strings."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return host, F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")


def edges(spots: DataFrame, rows: int) -> tuple[list[str], list[str]]:
    """First and last ``spot`` of each part, when all are ordered and cut into parts of about ``rows``."""
    n = max(1, min(-(-spots.count() // rows), MOST_PARTS))
    dealt = spots.repartitionByRange(n, "spot").groupBy(F.spark_partition_id().alias("part"))
    ends = sorted((r["lo"], r["hi"]) for r in dealt.agg(F.min("spot").alias("lo"), F.max("spot").alias("hi")).collect())
    return [lo for lo, _ in ends], [hi for _, hi in ends]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", folder_pages: int = FOLDER_PAGES) -> DataFrame:
    """One row per page: key, url, ``text`` (blocks joined by an empty line), ``n_chars``, ``n_shared_lines``.

    A null or empty page has an empty text; a null URL is compared with others of none; repeated rows are
    compared with each other, and as copies delete nothing.  Pages are sorted by URL path within their host,
    and each is compared with the neighbour whose path shares the longer prefix (the earlier at a tie).
    The order is cut into parts of about ``folder_pages`` pages, and the pages at a cut go to both sides, so
    no task holds a host's pages and the result doesn't depend on the cuts; a task holds three pages at a time.
    Columns not named aren't read.
    """
    kind, id_type = pages.schema[key].dataType.simpleString(), to_arrow_type(pages.schema[key].dataType)
    host, path = url_parts(F.col("url"))
    spot = F.concat_ws("\0", host, path, F.coalesce("url", F.lit("")), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    firsts, lasts = edges(pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url")).select(spot.alias("spot")), folder_pages)

    def parts(spot: str) -> list[int]:
        """The part of a page, and at its edge the part next to it."""
        p = max(bisect_right(firsts, spot) - 1, 0)
        return [p] + [p - 1] * (p > 0 and spot == firsts[p]) + [p + 1] * (p + 1 < len(firsts) and spot == lasts[p])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple] = []
            size = 0

            def out(got: list[tuple], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                at, part, guest, lines, kinds = zip(*got)
                rows = batch.drop_columns(["html"]).take(pa.array(at))
                rows = rows.append_column("part", pa.array(part, pa.int64())).append_column("guest", pa.array(guest, pa.bool_()))
                rows = rows.append_column("lines", pa.array(lines, pa.list_(pa.string())))
                return rows.append_column("kinds", pa.array(kinds, pa.list_(pa.int32())))

            for i, (page, spot) in enumerate(zip(batch.column("html"), batch.column("spot"))):
                lines, kinds = blocks(page.as_py())
                for k, part in enumerate(parts(spot.as_py())):
                    got.append((i, part, k > 0, lines, kinds))
                    size += sum(map(len, lines))
                if size > 4 << 20:
                    yield out(got)
                    got, size = [], 0
            if got:
                yield out(got)

    keyed = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    keyed = keyed.select("page_id", "url", spot.alias("spot"), "html")
    schema = f"page_id {kind}, url string, spot string, part long, guest boolean, lines array<string>, kinds array<int>"
    parsed = keyed.mapInArrow(parse, schema)
    ordered = parsed.repartition("part").sortWithinPartitions("part", "spot")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}

        def nearest(before: dict | None, row: dict, after: dict | None) -> dict | None:
            host, path = row["spot"].split("\0")[:2]
            near = [x for x in (before, after) if x and x["part"] == row["part"] and x["spot"].split("\0")[0] == host]
            return max(near, key=lambda x: len(commonprefix([x["spot"].split("\0")[1], path])), default=None)

        def result(before: dict | None, row: dict, after: dict | None) -> tuple:
            other = nearest(before, row, after)
            kept, gone = decide(row["lines"] or [], row["kinds"] or [], other["lines"] if other else None)
            text = "\n\n".join(kept)
            return row["page_id"], row["url"], text, len(text), gone

        def batched(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out), (id_type, pa.string(), pa.string(), pa.int64(), pa.int64()))],
                names=["page_id", "url", "text", "n_chars", "n_shared_lines"],
            )

        out: list[tuple] = []
        size, before, row = 0, None, None
        for after in rows():
            if row is not None and not row["guest"]:
                out.append(result(before, row, after))
                size += out[-1][3]
                if size > 4 << 20 or len(out) >= 2000:
                    yield batched(out)
                    out, size = [], 0
            before, row = row, after
        if row is not None and not row["guest"]:
            out.append(result(before, row, None))
        if out:
            yield batched(out)

    return ordered.mapInArrow(compare, f"page_id {kind}, url string, text string, n_chars long, n_shared_lines long")
