"""Main text of web pages: paragraphs pass points to their ancestors, the best container is kept."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttide.llm.common import small_batches

# Characters below which a block passes no points, and levels that points climb.
LEAST_CHARS, LEVELS = 25, 5
# A sibling of the best container is kept from this share of its score, and this score, on.
SIBLING_SHARE, SIBLING_SCORE = 0.2, 10.0
# Share of link text beyond which a list or table is a menu; inside an article, where such a list
# must also have so many blocks, and a table is none.
MOST_LINKS, ALL_LINKS, MENU_BLOCKS = 0.5, 0.9, 2

_NAME_OF = re.compile(r"[A-Za-z][^\s/>]*")
_PLAIN = re.compile("[^>\"']*")
_ATTR = re.compile(r"([A-Za-z][\w-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_COMMA = re.compile("[,،，、;]")
_SENTENCE_END = re.compile("[.!?\u2026\u3002\uff01\uff1f\u061f][\"'\u201d\u2019\u00bb)]*$")
_NAME = re.compile(r"[\s_-]+")

_RAW = frozenset("script style title textarea xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Blocks whose points go to their parent; others keep the points of text of their own.
_PARAGRAPHS = _HEADINGS | frozenset("p pre li dd dt td th figcaption caption summary address".split())
_NOISE_TAGS = frozenset("nav aside footer form dialog menu search".split())
# Tags that hold no text of the page.
_NO_TEXT_TAGS = frozenset(
    "head noscript template iframe object canvas svg annotation annotation-xml video audio map button select option "
    "datalist".split()
)
_NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form "
    "toolbar tablist".split()
)
# Words of class and id that mark what is not the article.
_NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promos "
    "promotion banner nav navbar navigation menu menus submenu sidebar breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription signup login comment comments commentlist commenting disqus reply "
    "replies respond footer masthead topbar share sharing social related recommended "
    "recommendations trending pagination pager widget widgets toolbar skip hidden".split()
)
# Parts of a name that say nothing of what it names. Inside an article a class marks noise only when
# all other parts of it do.
_EMPTY_NAMES = frozenset(
    "post posts article entry content box bar list block container wrap wrapper inner outer section "
    "area link links button buttons icon icons item items title header top bottom left right site "
    "page main story module panel group row col".split()
)
_HEADER_NAMES = frozenset(["header"])
_GOOD_NAMES = frozenset("article body content entry main post story text blog".split())
_WEIGHTS = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0}
# Tags that a start tag closes, up to the nearest of the listed holders.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
_P_HOLDERS = ("td", "th", "button", "object", "caption")


class _Node:
    __slots__ = ("tag", "parent", "skip", "heads", "points", "chars", "linked", "prose", "keep", "bonus", "at")

    def __init__(self, tag, parent, skip, heads, bonus=0.0, at=-1):
        self.tag, self.parent, self.skip, self.heads = tag, parent, skip, heads
        self.points, self.chars, self.linked, self.prose, self.keep = 0.0, 0, 0, 0, False
        self.bonus, self.at = bonus, at

    def score(self) -> float:
        if not self.points:
            return 0.0
        return (self.points + self.bonus) * (1 - self.linked / self.chars if self.chars else 1)


class _Tags:
    """Markup of a page from left to right, each character looked at a bounded number of times.

    A > between quotes does not end a tag. After a quote that is never closed, quotes of any kind
    hide nothing any more.
    """

    def __init__(self, source: str):
        self._source, self._quotes = source, True

    def _end(self, at: int) -> int:
        """The place of the > that ends the tag around ``at``; -1 for none."""
        p = at
        while self._quotes:
            p = _PLAIN.match(self._source, p).end()
            if p == len(self._source):
                self._quotes = False
            elif self._source[p] == ">":
                return p
            else:
                p = self._source.find(self._source[p], p + 1) + 1
                self._quotes = p > 0
        return self._source.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """(start, past, name, attributes, whether it is an end tag) of what comes next; the name of
        comments and declarations is empty."""
        source = self._source
        while True:
            start = source.find("<", at)
            if start < 0:
                return None
            if source.startswith("<!--", start):
                past = source.find("-->", start + 4)
                return start, len(source) if past < 0 else past + 3, "", "", False
            if source[start + 1 : start + 2] in ("!", "?"):
                past = source.find(">", start)
                return start, len(source) if past < 0 else past + 1, "", "", False
            ending = source[start + 1 : start + 2] == "/"
            name = _NAME_OF.match(source, start + 1 + ending)
            if name is None:
                at = start + 1
                continue
            past = self._end(name.end())
            if past < 0:  # no > is left, and so no tag
                return None
            return start, past + 1, name[0].lower(), source[name.end() : past], ending


class _Page:
    """Blocks of text in page order, each with the block element that holds it.

    Elements that look like noise are skipped, but for those that start at the places in ``kept``.
    Without ``kept`` none is: each has a node that holds the place. Open elements are found by the
    places that each tag has among them.
    """

    def __init__(self, source: str, kept: frozenset[int] | None = None):
        self._kept = kept
        self.root = _Node("html", None, False, False)
        self.nodes, self.blocks = [self.root], []
        self._open: list[tuple[str, _Node]] = []
        self._places: dict[str, list[int]] = {}
        self._run: list[tuple[str, bool]] = []
        self._links = 0
        tags, at = _Tags(source), 0
        while True:
            found = tags.next(at)
            if found is None:
                self._text(source[at:])
                break
            start, past, name, attributes, ending = found
            if start > at:
                self._text(source[at:start])
            at = past
            if not name:
                continue
            if ending:
                self._end(name)
            elif name in _RAW:
                close = re.compile(f"</{name}(?![a-z0-9])", re.IGNORECASE).search(source, at)
                end = source.find(">", close.end()) if close else -1
                at = len(source) if end < 0 else end + 1
            else:
                self._start(name, attributes, start)
        self._flush()

    @property
    def _node(self) -> _Node:
        return self._open[-1][1] if self._open else self.root

    def _text(self, text: str) -> None:
        if not self._node.skip and text:
            self._run.append((text, self._links > 0))

    def _flush(self) -> None:
        if not self._run:
            return
        run, self._run = self._run, []
        text = "".join(x for x, _ in run)
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if not text:
            return
        node = self._holder()
        lead = node.tag == "p" and len(text) >= LEAST_CHARS and _SENTENCE_END.search(text[-4:])
        if node.heads and node.tag not in _HEADINGS and not lead:
            return
        linked = sum(len(x) for x, link in run if link)
        linked = min(len(text), len(" ".join("".join(x for x, k in run if k).split()))) if linked else 0
        self.blocks.append((node, text, linked))

    def _holder(self) -> _Node:
        node = self._node
        while node.tag not in _BLOCK and node.at < 0 and node.parent is not None:
            node = node.parent
        return node

    def _last(self, tags) -> int:
        """The place of the innermost open element with one of these tags; -1 for none."""
        return max((self._places[t][-1] for t in tags if self._places.get(t)), default=-1)

    def _push(self, tag: str, node: _Node) -> None:
        for kind in (tag, "*block") if tag in _BLOCK else (tag,):
            self._places.setdefault(kind, []).append(len(self._open))
        self._open.append((tag, node))

    def _pop(self) -> None:
        tag, _ = self._open.pop()
        if tag:
            for kind in (tag, "*block") if tag in _BLOCK else (tag,):
                self._places[kind].pop()
            self._links -= tag == "a"

    def _pop_to(self, tags, holders) -> None:
        i = self._last(tags)
        if i >= 0 and i >= self._last(holders):
            self._cut(i)

    def _cut(self, i: int) -> None:
        self._flush()
        while len(self._open) > i:
            self._pop()
        self._drop_closed()

    def _drop_closed(self) -> None:
        while self._open and not self._open[-1][0]:
            self._pop()

    def _start(self, name: str, attributes: str, at: int) -> None:
        block = name in _BLOCK
        if name in _VOID:
            if name == "hr":
                self._flush()
            elif name == "br":
                self._text(" ")
            return
        if block:
            self._flush()
            if name in ("html", "body") and attributes.strip() == "" and name == "html":
                return
            self._pop_to(("p",), _P_HOLDERS)
            if name in _HEADINGS:
                self._pop_to(tuple(_HEADINGS), ("div", "section", "article", "body", "td"))
            if name in _CLOSES:
                self._pop_to(*_CLOSES[name])
        parent = self._node
        skip, heads, bonus, marked = parent.skip, parent.heads, 0.0, False
        if not skip:
            skip, noise, header, bonus = self._judge(name, attributes, block)
            if header:
                inside = self._last(("article", "main")) >= 0
                heads, noise = heads or inside, noise or not inside
            marked = noise and not skip and self._kept is None
            skip = skip or noise and self._kept is not None and at not in self._kept
            if marked:
                self._flush()
        if name == "a":
            self._links += 1
        if block or marked or skip != parent.skip:
            if skip != parent.skip and not block:
                node = _Node(name, parent, skip, heads)
            else:
                node = _Node(name, self._block_parent(parent), skip, heads, bonus, at if marked else -1)
                self.nodes.append(node)
            self._push(name, node)
        else:
            self._push(name, parent)

    def _block_parent(self, node: _Node) -> _Node:
        while node.tag not in _BLOCK and node.at < 0 and node.parent is not None:
            node = node.parent
        return node

    def _judge(self, name: str, attributes: str, block: bool) -> tuple[bool, bool, bool, float]:
        """Whether an element is not shown, whether it looks like noise, is a header, its weight."""
        bonus = _WEIGHTS.get(name, 0.0)
        if name in _NO_TEXT_TAGS:
            return True, False, False, 0.0
        noise, header = name in _NOISE_TAGS, name == "header"
        if not attributes or name in ("html", "body", "main"):
            return False, noise, header, bonus
        names: list[str] = []
        inside = self._last(("article", "main")) >= 0
        named = False
        for key, a, b, c in _ATTR.findall(attributes):
            key, value = key.lower(), (a or b or c).lower()
            if key in ("class", "id"):
                names += _NAME.split(value.strip())
                if not (key == "id" and name in _PARAGRAPHS):  # there an anchor
                    whole = [set(_NAME.split(x)) - _EMPTY_NAMES for x in value.split()]
                    named = named or any(x and x <= _NOISE_NAMES for x in whole)
            elif key == "role" and value in _NOISE_ROLES:
                noise = True
            elif key == "hidden" and value != "until-found":
                return True, False, False, 0.0
            elif key == "aria-hidden" and value == "true":
                return True, False, False, 0.0
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, False, False, 0.0
            elif key == "itemprop" and value == "articlebody":
                bonus += 25.0
        found = set(names)
        if noise or (named if inside else found & _NOISE_NAMES):
            return False, True, False, bonus + (15.0 if found & _GOOD_NAMES else 0.0)
        if block and found & _HEADER_NAMES and name not in ("article", *_HEADINGS):
            header = True
        return False, False, header, bonus + (15.0 if found & _GOOD_NAMES else 0.0)

    def _end(self, name: str) -> None:
        if name == "br":
            self._text(" ")
        if name in _VOID:
            return
        i = self._last((name,))
        if i < 0 or name not in _BLOCK and self._last(("*block",)) > i:
            return
        if name in _BLOCK or self._open[i][1].at >= 0:
            self._cut(i)
            return
        # Closed in the middle: its place stays, without a tag, until all above it is closed.
        self._places[name].pop()
        self._links -= name == "a"
        self._open[i] = ("", self._open[i][1])
        self._drop_closed()


def _score(page: _Page) -> None:
    """Points climb from each block; text and link text are summed over each subtree."""
    for node, text, linked in page.blocks:
        node.chars += len(text)
        node.linked += linked
        if len(text) < LEAST_CHARS or node.tag in _HEADINGS:
            continue
        node.prose += len(text) - linked
        points = 1 + len(_COMMA.findall(text)) + min(len(text) // 100, 3)
        points *= 1 - linked / len(text)
        up = node.parent if node.tag in _PARAGRAPHS and node.parent is not None else node
        for level in range(LEVELS):
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            if up.parent is None:
                break
            up = up.parent
    for node in reversed(page.nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.prose += node.prose


def _best(page: _Page) -> _Node | None:
    scored = [x for x in page.nodes if not x.skip and x.points > 0 and x.tag not in _PARAGRAPHS]
    return max(scored, key=_Node.score, default=None)


def _not_noise(page: _Page) -> frozenset[int]:
    """Where elements start that look like noise, yet hold the article.

    ``page`` skips none. An element stays that holds a main, or most of the page's paragraph text;
    one that holds the best container or the longest article stays if it has more such text than
    stands outside of all noise.
    """
    outside, noisy = page.root.prose, set()
    for node in page.nodes[1:]:
        if id(node.parent) in noisy:
            noisy.add(id(node))
        elif node.at >= 0:
            noisy.add(id(node))
            outside -= node.prose
    kept = {x.at for x in page.nodes if x.at >= 0 and 2 * x.prose > page.root.prose}
    articles = [x for x in page.nodes if x.tag == "article"]
    wanted = [(x, 0) for x in page.nodes if x.tag == "main" and x.prose]
    wanted += [(x, outside) for x in (_best(page), max(articles, key=lambda x: x.prose, default=None)) if x]
    seen = set()
    for node, least in wanted:
        while node is not None and (id(node), least) not in seen:
            seen.add((id(node), least))
            if node.at >= 0 and node.prose > least:
                kept.add(node.at)
            node = node.parent
    return frozenset(kept)


def _choose(page: _Page) -> None:
    """Mark the best container, lifted to the article around it, and its good siblings."""
    best = _best(page)
    if best is None:
        around = [x for x in page.nodes if x.tag in ("article", "main") and not x.skip and x.chars]
        best = max(around, key=lambda x: x.chars - x.linked, default=page.root)
    top, lifted = best, best.tag in ("article", "main")
    while top.parent is not None and not lifted:
        top = top.parent
        if top.tag in ("article", "main"):
            best, lifted = top, True
    best.keep = True
    # Beside an article that no main or article holds, short paragraphs must end a sentence.
    strict, up = lifted, best.parent
    while strict and up is not None:
        strict, up = up.tag not in ("article", "main"), up.parent
    ends = {id(node) for node, text, _ in page.blocks if strict and _SENTENCE_END.search(text[-4:])}
    limit = max(SIBLING_SCORE, SIBLING_SHARE * best.score())
    for node in page.nodes:
        if node.parent is not best.parent or node is best or node.skip or not node.chars:
            continue
        share = node.linked / node.chars
        plain = node.tag == "p" and (
            share < 0.25 if node.chars > 80 else not share and (not strict or id(node) in ends)
        )
        heading = node.tag in _HEADINGS and not share
        node.keep = node.score() >= limit or plain or heading


def _is_menu(node: _Node, inside: bool, blocks: int) -> bool:
    if not node.chars or node.tag not in ("ul", "ol", "table", "dl"):
        return False
    if inside:
        return node.tag != "table" and blocks >= MENU_BLOCKS and node.linked > ALL_LINKS * node.chars
    return node.linked > MOST_LINKS * node.chars


def main_text(source: str | None) -> str:
    """The article of one page, its blocks joined by line breaks; empty for none."""
    if not source:
        return ""
    page = _Page(source)
    _score(page)
    if any(x.at >= 0 for x in page.nodes):
        page = _Page(source, _not_noise(page))
        _score(page)
    _choose(page)
    sizes: dict[int, int] = {}
    for node, *_ in page.blocks:
        sizes[id(node)] = sizes.get(id(node), 0) + 1
    for node in reversed(page.nodes):
        if node.parent is not None:
            sizes[id(node.parent)] = sizes.get(id(node.parent), 0) + sizes.get(id(node), 0)
    menus, inside = set(), set()
    for node in page.nodes:
        parent = node.parent
        if parent is None:
            continue
        node.keep = node.keep or parent.keep
        if node.tag in ("article", "main") or id(parent) in inside:
            inside.add(id(node))
        if id(parent) in menus or _is_menu(node, id(node) in inside, sizes.get(id(node), 0)):
            menus.add(id(node))
    return "\n".join(
        text
        for node, text, _ in page.blocks
        if node.keep and id(node) not in menus
    )


def extract(pages: DataFrame) -> DataFrame:
    """The columns of ``pages`` but html, with ``text`` and ``n_chars``.

    ``pages`` needs html. Text inside a block has its character references decoded and its white
    space turned into single spaces; blocks stand in page order. Null, empty and text-free pages
    give an empty text of 0 characters. Rows are independent, so repeated rows give equal texts;
    columns named text or n_chars are replaced.
    """
    small_batches(pages.sparkSession)
    kept = pages.drop("text", "n_chars")
    others = [f for f in kept.schema.fields if f.name != "html"]

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(f.name) for f in others],
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                [*[f.name for f in others], "text", "n_chars"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    spread = kept.select(*[F.col(f"`{f.name}`") for f in others], "html")
    return spread.mapInArrow(run, f"{schema}{', ' if schema else ''}text string, n_chars long")
