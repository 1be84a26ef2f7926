"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element.  A line's size is the
number of its characters outside links, so lists of links weigh nothing.  The
line-block distribution is the sum of sizes over ``WINDOW`` lines.  It surges
where a window reaches the page's threshold and dives where it falls below;
the lines between, trimmed to those that weigh a window's share themselves, are a
page's core.  The threshold is ``SHARE`` of the page's largest window, at most
``SURGE`` characters, so that a teaser or a notice beside an article doesn't
surge, while each stretch of running text does, however long others are.

Surges and dives belong to a container that has a full window itself, so a
footer that follows the last paragraph is no part of its run.  The points are
then moved to the bounds of the containers (div, section, article, table cell,
body) that hold the core, so that a short headline or last paragraph isn't lost:
a container whose own paragraphs are in the core is kept whole, so is an article
around it, and of one that only holds such containers, what lies between them.
No element is text for its name alone: an article without a surge isn't kept.

Some elements leave blank lines, whatever they hold: scripts, styles, forms,
menus, footers and asides by their tags, and those whose class, id or role says
that they are adverts, sidebars, notices, comments and the like.  A name is
believed only where the page bears it out: not that of an element that holds an
article, not an ambiguous one ("social", "related") beside other words or over
most of the page's text, and in an element that is never closed only up to the
next container.

Defined results: a null or empty page has the empty text; so has one without
text outside of what is left out; repeated rows give repeated results; other
columns are ignored; a page is never cut short.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Of the page's largest window, what a window must reach; and the most that this asks for, in characters.
SHARE, SURGE = 0.25, 240

#: Elements that are open at once; in what is nested deeper, each next element replaces the last, as in browsers.
DEPTH = 512

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<end>>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_SPACE = re.compile(r"[\s ]+")

RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object audio video canvas select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("html body div section article main center td details hgroup header footer aside nav form".split())
HEADING = frozenset("h1 h2 h3".split())
LEFT_OUT = frozenset("head nav aside footer form button menu dialog fieldset input label".split())
ARTICLE = frozenset(("article", "main"))
#: Words of classes, ids and roles that say an element isn't article text.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice newsletter subscribe signup login comment comments replies disqus respond pagination pager complementary contentinfo".split()
)
#: Such words that may as well name a subject; they count beside words of their kind only.
AMBIGUOUS = frozenset("social share sharing side related recommended recommendations widget notification alert popup modal overlay subscription search tags copyright disclaimer skip hidden".split())
FILLER = frozenset("links link list box bar block blocks area panel wrapper container inner section item items posts post articles article button buttons icon icons media content left right top bottom small main site page the to us by".split())
#: Words before a name that make it another: a page with a sidebar isn't one.
NOT_NAMED = frozenset("has with no without is not hide show".split())


def _attributes(attrs: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}


def naming(tag: str, attrs: str) -> str | None:
    """``sure``, ``named`` or ``ambiguous`` if an element's class, id or role says that it isn't article text."""
    if not attrs or tag in ("html", "body"):
        return None
    found = _attributes(attrs)
    if "hidden" in found or found.get("aria-hidden") == "true" and tag not in CONTAINER:
        return "sure"
    out = None
    for k in ("class", "id", "role"):
        for name in found.get(k, "").lower().split():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            if any(w in NAMED and not (i and words[i - 1] in NOT_NAMED) for i, w in enumerate(words)):
                return "named"
            if any(w in AMBIGUOUS for w in words):
                beside = [w for x in found.get(k, "").lower().split() for w in re.split(r"[^a-z]+", x) if w]
                if all(w in AMBIGUOUS or w in FILLER for w in beside):
                    out = "ambiguous"
        if k != "role" and tag in ("div", "section") and {"header", "site-header", "page-header"} & set(found.get(k, "").lower().split()):
            out = "header"
    return out


class Page:
    """A page as lines of text pieces, and its elements as far as they matter."""

    def __init__(self, page: str):
        #: Elements: (tag, parent, what says that it is no article text); zone: the nearest such element.
        self.tag, self.parent, self.why, self.closed, self.holds_article, self.zone = ["#"], [-1], [None], [True], [False], [-1]
        self.begins = [0]  # the first line after an element's start
        #: Lines: pieces (text, zone, in a link), the nearest block element, whether a heading.
        self.lines: list[tuple[list[tuple[str, int, bool]], int, bool]] = []
        self.open_until: dict[int, int] = {}  # of zones that are never closed: the first line that isn't in them
        self._read(page)

    def _read(self, page: str) -> None:
        stack: list[int] = [0]
        pieces: list[tuple[str, int, bool]] = []
        block = 0
        link_at = -1  # depth of the open link
        n_articles = 0
        at, n = 0, len(page)

        def flush() -> None:
            if pieces:
                if any(not t.isspace() for t, _, _ in pieces):
                    self.lines.append((pieces.copy(), block, any(self.tag[e] in HEADING for e in stack)))
                pieces.clear()

        def nearest_block() -> int:
            return next(e for e in reversed(stack) if e == 0 or self.tag[e] in BLOCK)

        def close(depth: int, said: bool) -> None:
            nonlocal link_at, n_articles, block
            for k, e in enumerate(stack[depth:]):
                self.closed[e] = said and k == 0
                n_articles -= self.tag[e] in ARTICLE
            del stack[depth:]
            if link_at >= depth:
                link_at = -1
            block = nearest_block()

        while at < n:
            m = _TOKEN.search(page, at)
            if m is None:
                pieces.append((page[at:], self.zone[stack[-1]], link_at >= 0))
                break
            if m.start() > at:
                pieces.append((page[at : m.start()], self.zone[stack[-1]], link_at >= 0))
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    pieces.append((html.escape(m[0][9:].removesuffix("]]>")), self.zone[stack[-1]], link_at >= 0))
                continue
            if m["close"]:
                if tag in BLOCK:
                    flush()
                depth = next((k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == tag), None)
                if depth is not None:
                    close(depth, True)
                continue
            if tag in RAW and not m["attrs"].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    pieces.append((" ", self.zone[stack[-1]], link_at >= 0))
                continue
            if tag in BLOCK:
                flush()
                open_tags = [self.tag[e] for e in stack]
                if tag in open_tags:  # what HTML closes without saying so
                    last = len(open_tags) - 1 - open_tags[::-1].index(tag)
                    scope = {"p": {"p"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}.get(tag)
                    if scope is not None and not set(open_tags[last + 1 :]) & (BLOCK | scope):
                        close(last, True)
                elif tag == "body" and "head" in open_tags:
                    close(open_tags.index("head"), True)
            if len(stack) > DEPTH:
                close(DEPTH, False)
            e = len(self.tag)
            why = "sure" if tag in LEFT_OUT else "header" if tag == "header" else naming(tag, m["attrs"])
            if tag in ARTICLE:  # marks what is around it
                for x in stack:
                    self.holds_article[x] = True
            if why == "header" and n_articles:
                why = None
            if tag in CONTAINER or tag in HEADING or tag == "p":
                for x in stack:  # where a zone that is never closed ends, should it be one
                    if self.why[x] and x not in self.open_until and (tag in CONTAINER or self.begins[x] < len(self.lines)):
                        self.open_until[x] = len(self.lines)
            self.tag.append(tag)
            self.begins.append(len(self.lines))
            self.parent.append(stack[-1])
            self.why.append(why)
            self.closed.append(False)
            self.holds_article.append(False)
            self.zone.append(e if why else self.zone[stack[-1]])
            n_articles += tag in ARTICLE
            if tag == "a" and link_at < 0:
                link_at = len(stack)
            elif tag == "a":
                link_at = -1
                close(next(k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == "a"), False)
                self.parent[e] = stack[-1]
                link_at = len(stack)
            stack.append(e)
            if tag in BLOCK:
                block = e
        flush()

    def _believed(self) -> list[bool]:
        """Of each element whether what says that it is no article text holds."""
        mass = [0] * len(self.tag)
        for pieces, _, _ in self.lines:
            for text, zone, linked in pieces:
                if not linked:
                    size = len("".join(text.split()))
                    mass[0] += size
                    while zone > 0:
                        mass[zone] += size
                        zone = self.zone[self.parent[zone]]
        named = [self.tag[e] == "form" or why != "sure" for e, why in enumerate(self.why)]
        most = [2 * m > mass[0] and (why == "ambiguous" or tag == "form") for m, why, tag in zip(mass, self.why, self.tag, strict=True)]
        return [bool(why) and not (named[e] and self.holds_article[e]) and not most[e] for e, why in enumerate(self.why)]

    def blocks(self) -> Iterator[tuple[str, int, int, bool]]:
        """Text, size, nearest block element and whether a heading, of each line; blank where it is left out."""
        believed = self._believed()

        def gone(zone: int, line: int) -> bool:
            while zone > 0:
                if believed[zone] and (self.closed[zone] or line < self.open_until.get(zone, line + 1)):
                    return True
                zone = self.zone[self.parent[zone]]
            return False

        for k, (pieces, block, heading) in enumerate(self.lines):
            kept = [(t, linked) for t, zone, linked in pieces if zone <= 0 or not gone(zone, k)]
            text = _SPACE.sub(" ", html.unescape("".join(t for t, _ in kept))).strip()
            links = len(_SPACE.sub(" ", html.unescape("".join(t for t, linked in kept if linked))).strip())
            yield text, max(len(text) - links, 0), block, heading


def core_lines(sizes: list[int], places: list[int], window: int = WINDOW, share: float = SHARE, surge: int = SURGE) -> list[bool]:
    """The lines between surges and dives of the line-block distribution.

    Each run is trimmed to lines that weigh a window's share, in places (the line's container) that have a
    window of weight of their own.
    """
    n = len(sizes)
    sums, total = [], 0  # sums[k]: lines k-window+1 .. k
    for k in range(n + window - 1):
        total += (sizes[k] if k < n else 0) - (sizes[k - window] if k >= window else 0)
        sums.append(total)
    most = max(sums, default=0)
    if not most:
        return [False] * n
    least = min(share * most, surge)
    alone: dict[int, list[int]] = {}
    for size, place in zip(sizes, places, strict=True):
        alone.setdefault(place, []).append(size)
    bare = {place for place, own in alone.items() if max(sum(own[k : k + window]) for k in range(len(own))) < least}
    weak = [size * window < least or place in bare for size, place in zip(sizes, places, strict=True)]
    out = [False] * n
    k = 0
    while k < len(sums):
        if sums[k] < least:
            k += 1
            continue
        a = k
        while k < len(sums) and sums[k] >= least:
            k += 1
        low, high = max(a - window + 1, 0), min(k, n)  # from the first line of the first window to the last of the last
        while low < high and weak[low]:
            low += 1
        while high > low and weak[high - 1]:
            high -= 1
        out[low:high] = [True] * (high - low)
    return out


def main_text(page: str | None, window: int | None = WINDOW) -> str:
    """Text between surge and dive points, which lie at the bounds of containers; ``window`` None takes all lines that aren't left out."""
    if not page:
        return ""
    read = Page(page)
    lines = list(read.blocks())
    if window is None:
        return "\n".join(t for t, _, _, _ in lines if t)
    # the containers around each line, outermost first
    around: dict[int, list[int]] = {0: [0]}

    def path(e: int) -> list[int]:
        if e not in around:
            above = path(read.parent[e])
            around[e] = [*above, e] if read.tag[e] in CONTAINER else above
        return around[e]

    paths = [path(block) for _, _, block, _ in lines]
    core = core_lines([size for _, size, _, _ in lines], [p[-1] for p in paths], window)
    if not any(core):
        return ""
    stays = [False] * len(lines)

    def bounds(e: int) -> bool:
        """Whether a container is an article, or a main element without any."""
        return read.tag[e] == "article" or read.tag[e] == "main" and not read.holds_article[e]

    def settle(low: int, high: int, depth: int) -> None:
        """Marks what stays of the lines low .. high-1, which share a container at ``depth`` of their paths."""
        cores = [k for k in range(low, high) if core[k]]
        if not cores:
            return
        while not bounds(paths[cores[0]][depth]) and all(len(paths[k]) > depth + 1 for k in cores) and len({paths[k][depth + 1] for k in cores}) == 1:
            depth += 1  # down to the least container that holds all of the core
        inner = paths[cores[0]][depth]
        low = next(k for k in range(low, high) if len(paths[k]) > depth and paths[k][depth] == inner)
        high = 1 + max(k for k in range(low, high) if len(paths[k]) > depth and paths[k][depth] == inner)
        own = any(len(paths[k]) == depth + 1 for k in cores)
        tag = read.tag[inner]
        if bounds(inner) or own and tag not in ("body", "html", "#"):
            stays[low:high] = [True] * (high - low)
            return
        weight: dict[int, int] = {}  # of the containers within
        for k in range(low, high):
            if len(paths[k]) > depth + 1:
                weight[paths[k][depth + 1]] = weight.get(paths[k][depth + 1], 0) + lines[k][1]
        for k in range(cores[0], cores[-1] + 1):
            stays[k] = len(paths[k]) == depth + 1 or weight[paths[k][depth + 1]] > 0  # lists of links between them don't
        # containers at both ends may reach beyond the core
        for k in (cores[0], cores[-1]):
            if len(paths[k]) > depth + 1:
                part = [x for x in range(low, high) if len(paths[x]) > depth + 1 and paths[x][depth + 1] == paths[k][depth + 1]]
                settle(part[0], part[-1] + 1, depth + 1)

    settle(0, len(lines), 0)
    # a headline right before the text belongs to it, unless the text has its own
    first = stays.index(True)
    before = [k for k in range(first) if lines[k][0]]
    if before and lines[before[-1]][3] and not lines[first][3]:
        stays[before[-1]] = True
    return "\n".join(t for k, (t, _, _, _) in enumerate(lines) if stays[k] and t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
