"""Main text of web pages: containers are scored page by page, hosts vote on the paths, pages are read by the winners.

1. Each page is parsed into a tree by a forgiving tokenizer. Every container is scored by its paragraphs' words, links and
   sentences; the best one names the page's generalised path: the tags and stable class names from the root down.
2. In Spark, the pages of a host vote: per host and path the votes, weighted by how clearly the container won, are summed. A path
   wins a host if it has the largest sum; votes are aggregated before they are shuffled, so a host may hold any share.
3. Every page is extracted anew by its host's winning path, if the page has such a container of at least half the best one's
   worth, else by its own best. The texts of all such containers are kept from the only parse. Blocks within
   a container that are menus, headers, footers, sidebars, notices, adverts, forms or reader comments are left out. What a
   class or id says counts by itself if it can only mean such a part. Words that have ordinary meanings too ("legal",
   "popular", "related") need all of the name to be of that kind, and never take prose out of the article: a paragraph, or
   a block of ``PROSE`` words or more that are hardly links.

Defined results: a null or empty html, and a page without any text in its container, give the empty text; a null or broken
url votes under the empty host; of paths with equal votes the last by name wins; elements of unknown names hold text like
others; stray quotes and unclosed tags, comments and quotations end where a browser ends them; pages of any length and
nesting are read whole; pages repeated are extracted row by row; an empty table gives an empty result; extra columns are
ignored, whatever their names. What a browser shows only where it can't show an element itself (``object``, ``canvas``,
``video``, ``iframe``, ``noscript``), and a closed dialog, is no text of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialise

#: Fixed values of HTML: elements without an end tag, with raw text, that start a block, and that close an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul br".split())
CLOSES_P = BLOCK - frozenset("br body html caption dd dt li option optgroup td th tr tbody thead tfoot".split())
#: Of those that end implicitly: the open elements that a start tag ends, and where the search for them stops.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
#: Elements that never hold main text, and roles and class or id words that mark such parts.
DROPPED = frozenset("script style nav header footer aside form noscript template iframe svg button select textarea input object embed canvas audio video menu head title datalist noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toolbar "
    "masthead topbar footer bottombar colophon sidebar widget widgets cookie cookies consent gdpr notice notices popup modal paywall "
    "newsletter subscribe signup login comment comments respond replies disqus sharing tagcloud".split()
)
WEAK = frozenset(
    "promoted promotion banner skip header copyright legal aside rail related recommended recommendations trending popular teaser notification alert overlay "
    "subscription form search discussion social share follow tags".split()
)
#: Words that say where or how a part stands, nothing of what it holds.
PLACES = frozenset(
    "site page top global primary secondary left right bottom main inner outer box bar list links link block wrap wrapper container section area buttons button icons icon "
    "items item posts post articles stories panel group row col column title text js".split()
)
PARAGRAPHS = frozenset("p li td dd dt blockquote pre figcaption caption summary address span font small label u s q cite code sub sup abbr time mark math".split())
#: Words from which on a block that is hardly made of links is prose, and the share of words in links that a block of links has.
PROSE, LINKED = 30, 0.3
#: Names that only say what a layout has beside its main text.
WITH = re.compile(r"(?<![a-z])(?:has|with|no|without)[-_]\w+(?:-\w+)*")
#: Class words that speak for a container whatever else it is called.
MAIN = re.compile(r"(?<![a-z])(?:article|content|main|post|story|entry|body|text|prose)(?![a-z])")

#: A quote has a meaning only after an equals sign; one without an end has none.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^>=]|=)*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
SPACE = re.compile(r"\s+")
#: Most hosts whose winning paths (some 100 bytes each) are broadcast.
BROADCAST_HOSTS = 100_000
NAMES = ["page_id", "url", "host", "first", "weight", "paths", "places", "texts"]


class Node:
    """An element. Children are elements and texts in page order."""

    __slots__ = ("children", "known", "marks", "parent", "tag")

    def __init__(self, tag: str, marks: dict[str, str], parent: Node | None):
        self.tag, self.marks, self.parent = tag, marks, parent
        self.children: list[Node | str] = []
        self.known: bool | None = None

    def noise(self) -> bool:
        """Whether the element and all in it is no main text."""
        if self.known is None:
            self.known = self._noise()
        return self.known

    def _noise(self) -> bool:
        if self.tag in DROPPED:
            # an article's own header holds its headline, not the site's menu
            return not (self.tag == "header" and any(p.tag in ("article", "main") for p in self.above()))
        if self.tag == "dialog" and "open" not in self.marks:
            return True
        if not self.marks:
            return False
        if "hidden" in self.marks or self.marks.get("aria-hidden") == "true" or self.marks.get("role", "") in ROLES:
            return True
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", self.marks.get("style", "")):
            return True
        if self.tag in ("html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "b", "i", "em", "strong", "a"):
            return False
        name = f"{self.marks.get('class', '')} {self.marks.get('id', '')}"
        name = WITH.sub(" ", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        weak = False
        for token in name.split():
            words = [w for w in re.split(r"[^a-z]+", token) if w]
            strong = STRONG.intersection(words)
            if strong and (len(words) == 1 or self.tag not in PARAGRAPHS):
                return True
            weak = weak or bool(WEAK.intersection(words)) and all(w in WEAK or w in PLACES or w in STRONG for w in words)
        if not weak:
            return False
        words, linked = self.size()
        links = linked > LINKED * words
        if self.tag in PARAGRAPHS or any(x.tag in ("article", "main") for x in self.above()):
            return links or self.tag not in PARAGRAPHS and words < PROSE
        return True

    def size(self) -> tuple[int, int]:
        """Words of the element, and those of them in links."""
        words = linked = 0
        stack: list[tuple[Node, bool]] = [(self, False)]
        while stack:
            node, link = stack.pop()
            link = link or node.tag == "a"
            for child in node.children:
                if isinstance(child, str):
                    n = len(child.split())
                    words, linked = words + n, linked + n * link
                elif child.tag not in RAW:
                    stack.append((child, link))
        return words, linked

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def step(self) -> str:
        """The element in a generalised path: its tag and class words without digits."""
        names = sorted({c.lower() for c in self.marks.get("class", "").split() if not any(map(str.isdigit, c))})
        return ".".join([self.tag, *names])


def parse(page: str) -> Node:
    """The page's tree. Ill-nested and unclosed tags end where a browser would about end them."""
    root = node = Node("html", {}, None)
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            node.children.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            node.children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                node.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            up = node
            while up is not None and up.tag != tag:
                # an inline end tag doesn't reach over a block
                up = None if tag not in BLOCK and up.tag in BLOCK else up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            elif tag == "p":
                node.children.append(Node("p", {}, node))
            continue
        if tag in CLOSES_P:
            up = node
            while up is not None and up.tag not in BLOCK:
                up = up.parent
            if up is not None and up.tag == "p" and up.parent is not None:
                node = up.parent
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            up = node
            while up is not None and up.tag not in stops:
                if up.tag in ends and up.parent is not None:
                    node = up.parent
                up = up.parent
        marks = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] else {}
        if tag in ("html", "body") and any(p.tag == tag for p in [node, *node.above()] if p.parent is not None or tag == "html"):
            continue
        new = Node(tag, marks, node)
        node.children.append(new)
        if tag in VOID or m[3].endswith("/") and tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            new.children.append(page[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        node = new
    return root


def blocks(node: Node) -> list[str]:
    """The texts of the node's blocks in page order, white space made one, without noise."""
    found, now = [], []

    def end() -> None:
        text = SPACE.sub(" ", "".join(now)).strip()
        if text:
            found.append(text)
        now.clear()

    # a stack, since pages may be nested deeper than Python calls may be
    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        at, i = stack.pop()
        if i == 0 and at.tag in BLOCK:
            end()
        if i == len(at.children):
            if at.tag in BLOCK:
                end()
            continue
        stack.append((at, i + 1))
        child = at.children[i]
        if isinstance(child, str):
            now.append(child)
        elif child.tag in VOID:
            if child.tag in BLOCK:
                end()
        elif not child.noise():
            stack.append((child, 0))
    end()
    return found


def _path(node: Node) -> str:
    return "/".join(x.step() for x in reversed([node, *node.above()]))


def candidates(root: Node) -> dict[str, tuple[float, list[Node]]]:
    """The containers of each path in page order, and the best one's score: where several win over the element around them,
    their texts are one text; else that element's text holds theirs.

    A container is worth the sum, over its own paragraphs and headings, of what they hold beyond links; it hands 0.6
    of it on to its parent, 0.36 to the next, so the closest element around the whole text wins. Elements that
    stand for main text by name weigh more.
    """
    score: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, link = stack.pop()
        link = link or node.tag == "a"
        own = 0.0
        for child in node.children:
            if isinstance(child, str):
                words = len(child.split())
                own += words * (0.1 if link else 1.0) + 2.0 * (not link) * sum(child.count(c) for c in ".,;:!?")
            elif child.tag not in VOID and not child.noise():
                stack.append((child, link))
        if own:
            up: Node | None = node
            while up is not None and (up.tag not in BLOCK or up.tag in ("p", "li", "td", "tr", "tbody", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "dt", "dd")):
                up = up.parent
            share = 1.0
            while up is not None and share > 0.01:
                score[id(up)] = score.get(id(up), 0.0) + own * share
                nodes[id(up)] = up
                share *= 0.6
                up = up.parent
    best: dict[str, tuple[float, list[Node]]] = {}
    for k, node in reversed(nodes.items()):  # they were met from the page's end on; those of one path never hold each other
        named = node.tag in ("article", "main") or node.marks.get("role") in ("main", "article") or node.marks.get("itemprop") == "articleBody"
        worth = score[k] * (2.0 if named else 1.3 if MAIN.search(f"{node.marks.get('class', '')} {node.marks.get('id', '')}".lower()) else 1.0)
        worth *= 0.5 if node.tag in ("html", "body") else 1.0
        path = _path(node)
        before, same = best.get(path, (0.0, []))
        same.append(node)
        best[path] = (max(before, worth), same)
    return best


def readings(page: str | None) -> tuple[str | None, float, list[tuple[str, str]]]:
    """The page's vote, a path and its weight by how clearly it won, and the texts by path of all containers of half the
    best one's worth or more, the best first."""
    tree = candidates(parse(page or ""))
    found = sorted((-w, p) for p, (w, _) in tree.items())
    if not found:
        return None, 0.0, []
    best = -found[0][0]
    second = -found[1][0] if len(found) > 1 else 0.0
    return found[0][1], 1 - 0.5 * second / best, [(p, "\n".join(x for node in tree[p][1] for x in blocks(node))) for w, p in found if -w >= 0.5 * best]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                first, weight, paths, places, texts = [], [], [], [], []
                for page in part.column("html"):
                    path, w, found = readings(page.as_py())
                    own = list(dict.fromkeys(t for _, t in found))
                    first.append(path)
                    weight.append(w)
                    paths.append([p for p, _ in found])
                    places.append([own.index(t) for _, t in found])
                    texts.append(own)
                cols = [pa.array(first, pa.string()), pa.array(weight, pa.float64()), pa.array(paths, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host")), *cols], NAMES)

    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, host string, first string, weight double, paths array<string>, places array<int>, texts array<string>"
    rows = materialise(pages.select("page_id", "url", "html", host.alias("host")).mapInArrow(parsed, schema), "readings")
    votes = rows.filter("first is not null").groupBy("host", F.col("first").alias("path")).agg(F.round(F.sum("weight"), 6).alias("votes"))
    won = materialise(votes.groupBy("host").agg(F.max(F.struct("votes", "path"))["path"].alias("path")), "paths")
    # the texts are shuffled only if there are too many hosts to send to every executor
    joined = rows.join(F.broadcast(won) if won.count() <= BROADCAST_HOSTS else won, "host", "left")
    # the winner's text if the page has it, else the first: that of the page's own best container
    place = F.coalesce(F.get("places", F.array_position("paths", F.col("path")).cast("int") - 1), F.lit(0))
    text = F.coalesce(F.get("texts", place), F.lit(""))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
