"""Main text of pages by consensus host paths.

Every page is read into its containers (elements that hold blocks of text), each named by its
path of tags and classes, with digits generalised, so that pages made by one template agree.
A container is scored by the text of its own blocks, less what lies in links; menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments score nothing.
Each page votes for its best path; votes are summed per host in Spark, so a host with a third
of all pages is a few counters. Then every page is read again with its host's winning path: all
containers of that path, in page order, give the text. A page without that path uses its own
best one; where no container scores, all remaining blocks count.

An element is beside the article by its tag, its role, or a class or id: a word of SIDE_WORDS
that is the whole name, its last part (``site-footer``) or its first part before a word for a
place (``ad-slot``). Names that only tell about such parts (``has-sidebar``, ``ad-free``) do not
count. What holds the main element, or most of the page's text where this is most of the text
of article elements or where hardly any text is outside such parts, is not beside for its names
or for being a form; what holds reader comments is.

A block is a paragraph, heading, list item, cell or the like; line breaks inside are spaces.
White space becomes single spaces, blocks are joined by one line end, nothing is cut. The work
grows with the length of a page, however deep its elements are nested.

Defined cases: null and empty html give an empty text; a null url is on the host ''; pages cut
off in a tag, comment or script end there; unclosed elements end with their container; repeated
rows give repeated results; an empty table gives no rows; further columns are ignored; ties
between paths go to the first in alphabetical order.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import pinned

# How HTML treats its elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg iframe object".split())
BLOCKS = set(
    "p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th caption figcaption summary address "
    "div section article main body ul ol dl table tr tbody thead tfoot figure details html "
    "header footer nav aside form fieldset center hgroup".split()
)
CONTAINERS = set("body main article section div td blockquote center".split())
#: An open paragraph, item or cell ends where one of these begins.
ENDS_P = BLOCKS - set("html body".split())
LISTED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = set("ul ol dl table select".split())
SIDE_TAGS = set("nav aside footer form button select dialog menu head label fieldset".split()) | RAW
SIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner promo promoted promotion sponsor "
    "sponsored nav navbar navigation menu menubar submenu breadcrumb breadcrumbs sidebar side "
    "aside footer foot header masthead topbar toolbar notice notices cookie cookies consent gdpr "
    "popup modal overlay newsletter subscribe subscription signup login search share sharing "
    "social related recommended recommendations comment comments discussion respond replies "
    "reply disqus widget widgets pagination pager copyright legal hidden skip tags".split()
)
#: Of these, what holds the readers' words; it is beside however much it holds.
READERS = set("comment comments discussion respond replies reply disqus".split())
#: Names with one of these tell about a part elsewhere, or of its absence.
ABOUT = set(
    "has have no not non with without is show hide use enable enabled disable disabled free on off "
    "open closed active inactive ready supported allowed".split()
)
#: After a side word, these name the part itself (``ad-slot``, ``footer-links``).
PLACES = set(
    "area bar block bottom box button buttons column container content form group holder icons "
    "inner item items left link links list outer panel posts right row section slot thread top "
    "unit wrap wrapper zone".split()
)
SIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
REST = 0.1  # share of the text around a container that is not left out
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)(?:>|\Z)"
    r"|</?[A-Za-z][^>]*\Z",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MOST = 0.5  # of a page's text, for elements that are beside by name only


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE)


def _name_kind(named: str) -> str:
    """What a class or id tells: 'readers', 'side' or nothing ('')."""
    parts = [word.lower() for word in _WORD.findall(named)]
    if not parts or not ABOUT.isdisjoint(parts):
        return ""
    word = parts[-1]
    if word not in SIDE_WORDS:
        word = parts[0] if word in PLACES else ""
    return "readers" if word in READERS else "side" if word in SIDE_WORDS else ""


_name_kind = functools.lru_cache(1 << 14)(_name_kind)


def _side(tag: str, attributes: dict[str, str], in_main: bool) -> str:
    """Why an element is beside the article: 'always', 'readers', 'side', or '' if it is not."""
    if tag == "form":
        return "side"
    if tag in SIDE_TAGS or (tag == "header" and not in_main):
        return "always"
    if "hidden" in attributes or attributes.get("role", "").lower() in SIDE_ROLES:
        return "always"
    if tag in ("html", "body", "article", "main"):
        return ""
    kinds = set()
    for named in (*attributes.get("class", "").split(), attributes.get("id", "")):
        if not (in_main and "header" in named.lower()):
            kinds.add(_name_kind(named))
    return "readers" if "readers" in kinds else "side" if "side" in kinds else ""


def _step(tag: str, attributes: dict[str, str]) -> str:
    names = sorted({_DIGITS.sub("N", c) for c in attributes.get("class", "").lower().split()})
    return ".".join([tag, *names]).replace("/", "|")


class _Beside:
    """An element that may be beside the article, within another one (or the page, the first)."""

    __slots__ = ("outer", "readers", "own", "text", "articles", "n_articles", "main", "out")

    def __init__(self, outer: _Beside | None, readers: bool):
        self.outer, self.readers = outer, readers
        self.own = 0  # characters outside links, and outside inner ones of these elements
        self.text = 0  # the same with inner ones, but for readers' words
        self.articles = 0  # of these, in article and main elements that begin inside
        self.n_articles = 0
        self.main = self.out = False

    def judge(self, page: _Beside) -> None:
        """Whether what it holds is left out; the one around it has been judged before."""
        around = self.outer
        whole = self.text > MOST * around.text and around.own < REST * around.text
        whole &= self.n_articles == around.n_articles
        most = self.text > MOST * page.text and self.articles > MOST * page.articles
        holds = not self.readers and (self.main or most or whole)
        self.out = self.outer.out or not holds


class _Open:
    """An open element: its container's path, what it is beside by, and where its article began."""

    __slots__ = ("tag", "path", "beside", "always", "article")

    def __init__(self, tag, path, beside, always, article):
        self.tag, self.path, self.beside = tag, path, beside
        self.always, self.article = always, article


class Page:
    """The blocks of a page in order, as (path, text, characters in links), and its paths.

    A path is a number; its container is the last step, and paths have greater numbers than the
    ones around them, so that sums over all containers within others are one pass.
    """

    def __init__(self):
        self.blocks: list[tuple[int, str, int]] = []
        self.steps, self.outer = [""], [0]
        self.first_article, self.first_main = [0], [0]  # outermost of the path, or 0
        self.numbers: dict[tuple[int, str], int] = {}

    def path(self, outer: int, tag: str, step: str) -> int:
        key = outer, step
        if key not in self.numbers:
            self.numbers[key] = own = len(self.steps)
            self.steps.append(step)
            self.outer.append(outer)
            for firsts, wanted in ((self.first_article, "article"), (self.first_main, "main")):
                firsts.append(firsts[outer] or (own if tag == wanted else 0))
        return self.numbers[key]

    def name(self, path: int) -> str:
        steps = []
        while path:
            steps.append(self.steps[path])
            path = self.outer[path]
        return "".join("/" + step for step in reversed(steps))

    def find(self, name: str) -> int | None:
        path = 0
        for step in name.split("/")[1:]:
            path = self.numbers.get((path, step))
            if path is None:
                return None
        return path

    def within(self, path: int | None) -> list[tuple[int, str, int]]:
        """The blocks in containers of a path; all of them for None."""
        if not path:
            return self.blocks
        inside = [False] * len(self.steps)
        inside[path] = True
        for own in range(path + 1, len(inside)):
            inside[own] = inside[self.outer[own]]
        return [block for block in self.blocks if inside[block[0]]]

    def best(self) -> int | None:
        """The path with the highest score; one in an article or main element beats the others.

        A container scores the characters outside links of its own blocks, and half of the score
        of its inner containers, so that the element around the paragraphs of an article wins.
        Of nested articles the outer one is taken. Elsewhere a container gives way to the nearest
        one around it that adds text of its own, such as a headline, or in which other containers,
        such as further sections, hold a relevant share; nothing is taken from outside a main
        element, and the whole page only for such a share.
        """
        owned = [0] * len(self.steps)
        for path, text, linked in self.blocks:
            owned[path] += max(0, len(text) - 2 * linked)
        total, scores = owned.copy(), [float(n) for n in owned]
        for path in range(len(owned) - 1, 0, -1):
            total[self.outer[path]] += total[path]
            scores[self.outer[path]] += scores[path] / 2
        for path in range(1, len(scores)):
            scores[path] *= 4 if self.first_article[path] or self.first_main[path] else 1
        top = max(scores[1:], default=0)
        if not top:
            return None
        tied = [path for path in range(1, len(scores)) if scores[path] == top]
        path = tied[0] if len(tied) == 1 else min(tied, key=self.name)
        if self.first_article[path]:
            return self.first_article[path]
        main = self.first_main[path]
        own, above = total[path], path
        while above and above != main:
            above = self.outer[above]
            page = above == 0 or self.steps[above].split(".")[0] == "body"
            if own <= (1 - REST) * total[above] or (owned[above] and not page):
                path, own = above, total[above]
            if page:
                break
        return path


class _Reader:
    """Open elements and the block being read."""

    def __init__(self):
        self.page = Page()
        self.all = _Beside(None, False)
        self.beside = [self.all]
        self.stack = [_Open("", 0, self.all, False, None)]
        self.counts: Counter[str] = Counter()  # open elements by tag
        #: Pieces of text with the element that they may be beside by, and whether in a link.
        self.parts: list[tuple[str, _Beside, bool]] = []
        self.read: list[tuple[int, list[tuple[str, _Beside, bool]]]] = []

    def add(self, text: str) -> None:
        top = self.stack[-1]
        if top.always:
            return
        linked = self.counts["a"] > 0
        self.parts.append((text, top.beside, linked))
        if not linked:
            n = len(text.strip())
            top.beside.own += n
            if top.article:
                top.article.articles += n

    def flush(self) -> None:
        if self.parts:
            self.read.append((self.stack[-1].path, self.parts))
            self.parts = []

    def pop(self, depth: int) -> None:
        for element in self.stack[depth:]:
            self.counts[element.tag] -= 1
        del self.stack[depth:]

    def find(self, tags: set[str], stop: set[str]) -> int:
        """Depth of the innermost of ``tags`` above any of ``stop``, or 0."""
        if not any(self.counts[tag] for tag in tags):
            return 0
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in tags:
                return depth
            if tag in stop:
                return 0
        return 0

    def close(self, tag: str) -> None:
        if self.stack[-1].tag == tag:
            depth = len(self.stack) - 1
        else:
            # A stray end of an inline element does not close what holds it.
            depth = self.find({tag}, set() if tag in BLOCKS else CONTAINERS)
        if depth:
            if tag in BLOCKS:
                self.flush()
            self.pop(depth)

    def open(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.add(" ")
            return
        if tag in BLOCKS:
            self.flush()
            if tag in ENDS_P and (depth := self.find({"p"}, CONTAINERS)):
                self.pop(depth)
        if tag in LISTED and (depth := self.find(LISTED[tag], LISTS)):
            self.pop(depth)
        if tag in VOID or (rest.endswith("/") and tag not in BLOCKS):
            return
        top = self.stack[-1]
        attributes: dict[str, str] = {}
        if rest and not rest.isspace():
            for m in _ATTRIBUTE.finditer(rest):
                attributes[m[1].lower()] = html_lib.unescape(m[2] or m[3] or m[4] or "")
            if "hidden" in rest.lower().split():
                attributes["hidden"] = ""
        why = _side(tag, attributes, top.article is not None)
        beside, article, path = top.beside, top.article, top.path
        if why in ("side", "readers"):
            beside = _Beside(beside, why == "readers")
            self.beside.append(beside)
        if tag in ("article", "main"):
            if article is None:
                article = beside
                article.n_articles += 1
            beside.main |= tag == "main"
        if tag in CONTAINERS:
            path = self.page.path(path, tag, _step(tag, attributes))
        self.counts[tag] += 1
        self.stack.append(_Open(tag, path, beside, top.always or why == "always", article))

    def finish(self) -> Page:
        self.flush()
        for own in reversed(self.beside):
            own.text += own.own
            if own.outer and not own.readers:
                own.outer.text += own.text
                own.outer.articles += own.articles
                own.outer.n_articles += own.n_articles
                own.outer.main |= own.main
        for own in self.beside[1:]:
            own.judge(self.all)
        for path, parts in self.read:
            kept = [(text, linked) for text, beside, linked in parts if not beside.out]
            text = " ".join(html_lib.unescape("".join(text for text, _ in kept)).split())
            if text:
                links = sum(len(text) for text, linked in kept if linked)
                self.page.blocks.append((path, text, links))
        return self.page


def read_page(html: str) -> Page:
    """A page without what is beside its article."""
    reader = _Reader()
    at, n = 0, len(html)
    while at < n:
        found = _TOKEN.search(html, at)
        end = found.start() if found else n
        if end > at:
            reader.add(html[at:end])
        if not found:
            break
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            reader.close(tag)
        elif tag in RAW:
            if not found[0].endswith("/>"):
                close = _raw_end(tag).search(html, at)
                at = close.end() if close else n
        else:
            reader.open(tag, found[3])
    return reader.finish()


def extract(html: str, name: str | None = None) -> str:
    """Text of a page by a path's name, or by its own best one where it has none of that path."""
    page = read_page(html)
    path = None if name is None else page.find(name)
    if path is None or not page.within(path):
        path = page.best()
    return "\n".join(text for _, text, _ in page.within(path))


def _pages(pages: DataFrame) -> DataFrame:
    url = pages["url"].cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))
    return pages.select(
        pages["page_id"].cast("bigint").alias("page_id"),
        url.alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"),
        host.alias("host"),
    )


def votes(pages: DataFrame) -> DataFrame:
    """host, path, score: each page's best path, one row per path and batch."""
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.float64())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                own = read_page(page.as_py())
                path = own.best()
                if path is not None:
                    # One page is one vote, of as much weight as its path has of the text.
                    inside = sum(len(text) for _, text, _ in own.within(path))
                    key = host, own.name(path)
                    whole = sum(len(text) for _, text, _ in own.blocks)
                    sums[key] = sums.get(key, 0.0) + round(inside / whole, 3)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in sums], pa.string()),
                    pa.array([k[1] for k in sums], pa.string()),
                    pa.array(list(sums.values()), pa.float64()),
                ],
                schema=schema,
            )

    return pages.select("host", "html").mapInArrow(vote, "host string, path string, score double")


def consensus(pages: DataFrame) -> DataFrame:
    """host, path: the winning path of each host."""
    total = votes(pages).groupBy("host", "path").agg(
        F.sum(F.round(F.col("score") * 1000).cast("bigint")).alias("score")
    )
    best = F.min(F.struct((-F.col("score")).alias("score"), "path"))
    return total.groupBy("host").agg(best.alias("best")).select("host", "best.path")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = _pages(pages)
    winners = pinned(consensus(rows), "host_paths")
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("text", pa.string()),
            ("n_chars", pa.int64()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                extract(page.as_py(), path)
                for page, path in zip(batch.column("html"), batch.column("path").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url").cast(pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                schema=schema,
            )

    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")
