"""Main text of web pages by differencing against the pages with the nearest URLs.

Pages of a host stand in order of their URL path, so a page's neighbours are the
pages most likely made from the same template.  The text lines of two neighbours are
aligned by their longest common subsequence; aligned lines come from the template
and are deleted.  What markup says outright has the last word: text inside elements
for menus, footers, forms and the like goes even if no neighbour repeats it, and
text inside the article element stays even if a neighbour repeats it.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bounded_batches, multipliers, settle, splitmix
from .neighbours import next_edges
from .ordered import code_points

#: States of text: in an article; outside; left out; left out unless an article turns up inside
#: while the rest of the page has none; in such an article.
MAIN, OPEN, DROP, LAYOUT, SPARE = 1, 0, -1, -2, -3

DROP_TAGS = frozenset(
    "nav footer aside button select option datalist dialog menu noscript template iframe object "
    "embed svg canvas audio video map head".split())
RAW_TAGS = frozenset("script style title textarea xmp noembed noframes".split())
MAIN_TAGS = frozenset(("article", "main"))
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of the key closes open elements of the value, up to the nearest list, table or division.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
#: Words in a class or id that name page furniture.
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "sidebar sidebars rail nav navbar navigation navmenu menu menus topbar breadcrumb breadcrumbs pagination "
    "pager footer footers comment comments commentlist respond disqus share sharing social related "
    "recommended recommendations widget widgets toolbar login search skip".split())
#: The same outside an article, where they may not name parts of the article itself.
PAGE_WORDS = frozenset("header headers masthead banner banners logo branding tagline".split())

#: The words among these that never stand for a layout around an article.
CLOSED_WORDS = frozenset(
    "comment comments commentlist respond disqus related recommended recommendations".split())
#: Whole class or id names of what holds the text of a page.
CONTENT_NAMES = frozenset(
    "content article main post entry main-content page-content post-content entry-content article-content "
    "article-body post-body entry-body".split())
#: Names that start or end so tell what a layout has or which topic a text belongs to.
MODIFIER = re.compile(r"^(?:no|not|has|is|with|without|category|tag|topic)[-_]|[-_](?:open|closed|enabled|disabled)$")
#: Words that may stand beside page furniture in the id of an element inside an article.
FILL_WORDS = frozenset(
    "list box wrap wrapper container section area block bar thread links posts icons buttons the site page form "
    "message top bottom left right main".split())

_TAG = re.compile(r"<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HEADING = re.compile(r"h[1-6]\Z")


def _words(names: list[str]) -> set[str]:
    return {w.lower() for n in names if not MODIFIER.search(n.lower()) for w in _WORD.findall(n)}


def _furniture(tag: str, classes: list[str], name: str, state: int) -> set[str]:
    """Words of an element's class and id that name page furniture."""
    if any(c.lower() in CONTENT_NAMES for c in [*classes, name]):
        return set()
    found = _words(classes)
    if state in (MAIN, SPARE):
        # Ids inside an article are mostly link targets: furniture only if they say nothing else.
        own = _words([name])
        if _HEADING.match(tag):
            return set()
        return found & DROP_WORDS | (own & DROP_WORDS if own <= DROP_WORDS | FILL_WORDS else set())
    return (found | _words([name])) & (DROP_WORDS | PAGE_WORDS)


def _state(tag: str, attributes: str, state: int) -> int:
    if state == DROP or tag in DROP_TAGS:
        return DROP
    inside = state in (MAIN, SPARE)
    if tag == "header" and not inside:
        return DROP
    article, closed, layout = tag in MAIN_TAGS, False, tag == "form"
    if "=" in attributes or "hidden" in attributes:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        bare = _ATTRIBUTE.sub(" ", attributes).lower().split()
        if "hidden" in found or "hidden" in bare or found.get("aria-hidden") == "true":
            return DROP
        role = found.get("role", "").lower()
        if role in DROP_ROLES:
            return DROP
        article = article or role in ("main", "article")
        layout = layout or role == "form"
        if tag not in ("body", "html", "main"):
            words = _furniture(tag, found.get("class", "").split(), found.get("id", ""), state)
            closed, layout = bool(words & CLOSED_WORDS), layout or bool(words)
    if closed or inside and layout:
        return DROP
    if article and not inside:
        return SPARE if layout or state == LAYOUT else MAIN
    return LAYOUT if layout else state


def text_lines(page: str) -> list[tuple[str, int]]:
    """Text blocks of a page in order, each ``MAIN`` or ``OPEN``; dropped text is left out.

    An article that a class, an id or a form around it calls page furniture stays where the
    page has no other, unless these speak of comments or related texts.
    """
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    state, block, at, size = OPEN, OPEN, 0, len(page)

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append((text, block))
        parts.clear()

    while at < size:
        m = _TAG.search(page, at)
        if state not in (DROP, LAYOUT):
            block = state if not parts else max(block, state)
            parts.append(page[at:m.start() if m else size])
        if m is None:
            break
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = size if end < 0 else end + 3
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in INLINE_TAGS and parts:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    state = stack[i][1]
                    del stack[i:]
                    break
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = size if end is None else end.end()
            continue
        if tag == "br" and state not in (DROP, LAYOUT):
            parts.append(" ")
        if tag not in INLINE_TAGS:
            closes = CLOSES.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == "p" or name in closes:
                    state = stack[i][1]
                    del stack[i:]
                elif name not in INLINE_TAGS:
                    break
        if tag not in VOID_TAGS and not m[3].endswith("/"):
            stack.append((tag, state))
            state = _state(tag, m[3], state)
    flush()
    spare = not any(s == MAIN for _, s in lines)
    return [(t, MAIN if s == SPARE else s) for t, s in lines if s != SPARE or spare]


def line_hash(text: str) -> int:
    points = code_points(text)
    total = (splitmix(points) * multipliers(len(points))).sum(dtype=np.uint64)
    return int(splitmix(np.array([total]))[0] >> np.uint64(1))


def aligned(a: list[int], b: list[int]) -> set[int]:
    """Places of ``a`` that lie on a longest common subsequence with ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = set(range(head)) | set(range(len(a) - tail, len(a)))
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    both = set(a) & set(b)
    places = [i for i, v in enumerate(a) if v in both]
    found = _longest([a[i] for i in places], [v for v in b if v in both])
    return out | {places[i] + head for i in found}


#: Bits that the table of one alignment may take; larger ones are halved first.
TABLE_BITS = 1 << 22


def _masks(b: list[int]) -> dict[int, int]:
    where = defaultdict(list)
    for j, value in enumerate(b):
        where[value].append(j)
    out = {}
    for value, places in where.items():
        row = bytearray(len(b) // 8 + 1)
        for j in places:
            row[j >> 3] |= 1 << (j & 7)
        out[value] = int.from_bytes(row, "little")
    return out


def _next_row(row: int, mask: int, full: int) -> int:
    hit = row & mask
    return ((row + hit) | (row - hit)) & full


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``."""
    full, match = (1 << len(b)) - 1, _masks(b)
    row = full
    for value in a:
        row = _next_row(row, match.get(value, 0), full)
    bits = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    zeros = 1 - np.unpackbits(bits, bitorder="little")[:len(b)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(zeros)])


def _longest(a: list[int], b: list[int]) -> list[int]:
    """Places of ``a`` on a longest common subsequence with ``b``, in linear space.

    ``a`` is cut in half and ``b`` where the two halves align best, until a table of bit
    rows is small.
    """
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append(a0)
        elif (a1 - a0) * (b1 - b0) <= TABLE_BITS:
            out += [a0 + i for i in _by_bits(a[a0:a1], b[b0:b1])]
        else:
            mid = (a0 + a1) // 2
            ahead = _lengths(a[a0:mid], b[b0:b1])
            behind = _lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
            cut = b0 + int(np.argmax(ahead + behind))
            todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def _by_bits(a: list[int], b: list[int]) -> list[int]:
    """The same from a table with one row of bits per line of ``a``."""
    full, match = (1 << len(b)) - 1, _masks(b)
    rows = [full]
    for value in a:
        rows.append(_next_row(rows[-1], match.get(value, 0), full))
    out, i, j = [], len(a), len(b)

    def best(i: int, j: int) -> int:
        low = (1 << j) - 1
        return j - (rows[i] & low).bit_count()

    while i and j:
        if best(i - 1, j) == best(i, j):
            i -= 1
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out


class _Page:
    __slots__ = ("page_id", "url", "host", "lines", "codes", "shared")

    def __init__(self, page_id, url, host, lines, codes=None):
        self.page_id, self.url, self.host, self.lines = page_id, url, host, lines
        self.codes = codes if codes is not None else [line_hash(t) for t, _ in lines]
        self.shared: set[int] = set()

    def against(self, host: str | None, codes: list[int]) -> None:
        """Mark lines shared with a page of the same host, unless that page is a copy.

        It is one if nothing else would stay, or if less than a quarter of the text
        outside articles would and most of the shared text stands in lines of ten words
        or more.
        """
        if not host or host != self.host:
            return
        shared = aligned(self.codes, codes)
        loose = [i for i, (_, state) in enumerate(self.lines) if state == OPEN]
        if len(loose) == len(self.lines) and shared.issuperset(loose):
            return
        sizes = {i: len(self.lines[i][0]) for i in loose}
        gone = sum(n for i, n in sizes.items() if i in shared)
        prose = sum(n for i, n in sizes.items() if i in shared and self.lines[i][0].count(" ") >= 9)
        if 4 * gone <= 3 * sum(sizes.values()) or 2 * prose <= gone:
            self.shared |= shared

    def text(self) -> str:
        kept = [t for i, (t, state) in enumerate(self.lines) if state == MAIN or i not in self.shared]
        return "\n\n".join(kept)


RESULT = "page_id long, url string, text string, n_chars long"
EDGED = (RESULT + ", part int, first boolean, host string, lines array<string>, states array<int>, "
         "shared array<int>, codes array<long>")
_TYPES = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64(),
          "part": pa.int32(), "first": pa.bool_(), "host": pa.string(), "lines": pa.list_(pa.string()),
          "states": pa.list_(pa.int32()), "shared": pa.list_(pa.int32()), "codes": pa.list_(pa.int64())}


LINED = "host string, path string, url string, page_id long, lines binary, part int"
KEYS = ("host", "path", "url", "page_id")
#: Keys sampled for each range of the order.
SAMPLE = 20


def _rows(lines: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    columns = list(zip(*lines, strict=True)) if lines else [[]] * len(names)
    return pa.record_batch({n: pa.array(c, _TYPES[n]) for n, c in zip(names, columns, strict=True)})


def _parse(bounds: list[tuple]):
    """Pages to ``LINED`` rows: compressed lines, and the part between ``bounds`` a page belongs to."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            keys = [batch[c].to_pylist() for c in KEYS]
            lines = [zlib.compress(json.dumps(list(zip(*text_lines(page), strict=True)) or [[], []]).encode(), 1)
                     for page in batch["html"].to_pylist()]
            places = [tuple((v is not None, v) for v in row) for row in zip(*keys, strict=True)]
            yield pa.record_batch({
                **{c: pa.array(k, _TYPES.get(c, pa.string())) for c, k in zip(KEYS, keys, strict=True)},
                "lines": pa.array(lines, pa.binary()),
                "part": pa.array([bisect_right(bounds, p) for p in places], pa.int32())})
    return run


def _bounds(rows: DataFrame, parts: int) -> list[tuple]:
    """At most ``parts - 1`` keys that cut ``rows`` into ranges of about equal size.

    They come from a sample of keys alone, about ``SAMPLE`` for each range, so that no page
    is parsed twice.  Where the cuts lie changes no result.
    """
    n = rows.count()
    keys = rows.select(*KEYS)
    if n > SAMPLE * parts:
        keys = keys.sample(SAMPLE * parts / n, seed=1)
    found = sorted(tuple((v is not None, v) for v in row) for row in keys.toLocalIterator())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def _beside(batches: Batches) -> Batches:
    before, part, lead = None, None, None

    def plain(page: _Page) -> tuple:
        text = page.text()
        return page.page_id, page.url, text, len(text), None, None, None, None, None, None, None

    def edge(page: _Page, first: bool | None) -> tuple:
        return (page.page_id, page.url, None, None, part, first, page.host, [t for t, _ in page.lines],
                [s for _, s in page.lines], sorted(page.shared), page.codes)

    for batch in batches:
        done = []
        for page_id, url, host, packed, part in zip(*(
                batch[c].to_pylist() for c in ("page_id", "url", "host", "lines", "part")), strict=True):
            page = _Page(page_id, url, host, list(zip(*json.loads(zlib.decompress(packed)), strict=True)))
            if before is not None:
                before.against(page.host, page.codes)
                page.against(before.host, before.codes)
                done.append(edge(before, True) if before is lead else plain(before))
            else:
                lead = page
            before = page
        yield _rows(done, EDGED)
    if before is not None:
        yield _rows([edge(before, None if before is lead else False)], EDGED)


def _ends(batches: Batches) -> Batches:
    for batch in batches:
        done = []
        for page_id, url, host, lines, states, shared, codes, *others in zip(*(batch[c].to_pylist() for c in (
                "page_id", "url", "host", "lines", "states", "shared", "codes",
                "host_a", "codes_a", "host_b", "codes_b")), strict=True):
            page = _Page(page_id, url, host, list(zip(lines, states, strict=True)), codes)
            page.shared.update(shared)
            for other, codes_ in (others[:2], others[2:]):
                page.against(other, codes_ or [])
            text = page.text()
            done.append((page_id, url, text, len(text)))
        yield _rows(done, RESULT)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``).

    A null html counts as empty; a page whose URL is null or has no host is paired
    with none.  Pages of one URL are neighbours, in order of ``page_id``.  A
    neighbour that repeats all or nearly all text of a page without article is a copy,
    not a template, and deletes nothing.  What is shuffled are the compressed lines.
    """
    url = F.coalesce("url", F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][-+.\w]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), r"^www\.", "")
    rows = bounded_batches(pages).select(
        "page_id", "url", host.alias("host"), F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1).alias("path"),
        F.coalesce("html", F.lit("")).alias("html"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = rows.mapInArrow(_parse(_bounds(rows, parts)), LINED).repartitionById(parts, F.col("part"))
    ordered = lined.sortWithinPartitions(*KEYS, "lines").select("page_id", "url", "host", "lines", "part")
    beside = settle(ordered.mapInArrow(_beside, EDGED), "beside")
    inside = beside.where("part is null").select("page_id", "url", "text", "n_chars")
    edges = settle(next_edges(beside.where("part is not null").drop("text", "n_chars")), "edges")

    def beyond(step: int, which: str, name: str) -> DataFrame:
        return edges.where(which).select(
            (F.col("place") + step).alias(f"place_{name}"), F.col("host").alias(f"host_{name}"),
            F.col("codes").alias(f"codes_{name}"))

    opens, closes = "first is null or first", "first is null or not first"
    whole = edges.join(
        beyond(1, closes, "a"), F.expr(f"({opens}) and place = place_a"), "left").join(
        beyond(-1, opens, "b"), F.expr(f"({closes}) and place = place_b"), "left")
    return inside.union(bounded_batches(whole).mapInArrow(_ends, RESULT))
