"""Main-text extraction from HTML by minimum-cut labelling.

A page becomes a sequence of text blocks with their place in the DOM.  Labelling blocks as content or boilerplate costs

* for each block, what a linear classifier of its features says against the label (terminal capacities), and
* for each pair of neighbours that get different labels, a smoothness cost: neighbours in page order, less if their
  sections differ, and neighbours among the blocks of one DOM parent.

The labelling of least cost is a minimum cut, found by maximum flow.  Blocks whose own cost
outweighs all their smoothness edges have the same label in every minimum cut; they are fixed first and their
edges become costs of their neighbours, so the flow runs on the few that are left.

What is never content has no block: scripts, styles, templates, form controls, the title, comments.  A head has no text besides;
its end tag may be missing, and what cannot be in a head is in the body.

Elements around a block weigh by their tag and by the names in class, id and role.  Names often describe a page's layout ("right-sidebar", "main-nav-wrap")
or its subjects ("category-reviews"), so a name is judged with its element's role.  The *region* of a page is its ``main``, or else its ``article`` with most text, or else the
page.  What holds the region, or half of its text (comments and the like not counted), is a wrapper: names of layout count for little there, and so does a form.  Names of
reader comments, related items, adverts and consent count everywhere, names of subjects and of what else a page has nowhere.

Edge cases: null or empty html gives an empty text; unclosed or stray tags are repaired as browsers do in the main; a page
without blocks or without content gives an empty text; on equal cost a block is boilerplate; rows that repeat are extracted
each; extra columns are not carried; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import map_batches

_HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video textarea select datalist button title".split())
#: Comments, data sections, beginnings of tags, declarations.
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)|(?P<other><[!?/])", re.S | re.I)
_PLAIN = re.compile(r"[^<>\"']*")
_TO_END = re.compile(r"[^<>]*>")
_END_OF = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _HIDDEN}
#: Without an end tag these take the rest of the page, as in browsers; of the others only the tag itself goes.
_RAW = frozenset("script style textarea title iframe".split())
#: Attributes, their values with them, so that what a value holds is not read as an attribute.
_ATTR = re.compile(r"([^\s/\"'=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_READ = frozenset(("class", "id", "role", "aria-label", "hidden", "style"))

#: Elements that stay inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr nobr img".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end when another of their kind begins in the same parent.
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}, "option": {"option"}}
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
                   "ol pre section table ul p".split())
#: Where the search for an element to end stops.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "p": {"td", "th", "li"}}

#: Classifier weights of the elements around a block, in favour of content.
ELEMENT_WEIGHTS = {"article": 4.0, "main": 3.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "header": -4.0, "menu": -7.0,
                   "dialog": -9.0, "fieldset": -6.0, "address": -1.0, "blockquote": 0.5, "figcaption": -0.5, "p": 1.0, "pre": 1.0,
                   "h1": 1.5, "h2": 1.0, "h3": 0.5, "li": -0.5, "a": -0.5}
#: The same for words in class, id and role: what names a layout, what names something that is never the article, and what names content.
LAYOUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:banner|notices?|alerts?|subscri\w*|sidebar|side|menus?|nav\w*|breadcrumbs?|footer|foot|header|masthead|topbar|toolbar|share|sharing|social|"
    r"widgets?|overlay|login|signup|search\w*|pagination|pager|tags?|legal|disclaimer|skip|complementary|contentinfo|navigation|promo\w*)(?=$|[\s_-])", re.I)
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|sponsor\w*|cookie\w*|consent|gdpr|newsletter|comments?|commentlist|disqus|repl(?:y|ies)|respond|"
    r"related|recommend\w*|popup|modal|copyright|dialog|reviews?|discussion|user-content)(?=$|[\s_-])", re.I)
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|story|main|body|text|prose)(?=$|[\s_-])", re.I)
BAD_WEIGHT, GOOD_WEIGHT, WRAPPER_WEIGHT = -8.0, 2.0, -0.5
CLEARLY_BAD = -4.0
#: Names that only say what else a page has, or in what state it is.
_MENTIONS = re.compile(r"(?:^|(?<=\s))(?:\S*[_-])?(?:has|with|no|without|not)[_-]\S+|(?:^|(?<=\s))\S+[_-](?:open|closed|enabled|disabled|active|inactive)(?=\s|$)", re.I)
#: Names of a post's subjects, beside names that say it is a post.
_SUBJECTS = re.compile(r"(?:^|(?<=\s))(?:category|tag|type|status|format|term|author)-\S+", re.I)
_POST = re.compile(r"(?:^|\s)(?:h?entry|post|article|type-\S+|status-\S+)(?=\s|$)", re.I)
#: On an article, layout and state names say how it is shown; only a whole name tells what it is.
_ARTICLE_IS = re.compile(r"(?:^|\s)(?:comment|reply|review|teaser|related|promo|ad|advert\w*|sponsored|widget|comment-\S+|related-\S+|ad-\S+)(?=\s|$)", re.I)
#: Share of the region's text that makes an element its wrapper.
WRAPPER_SHARE = 0.5
#: Tags that never wrap an article.
_NEVER_WRAP = frozenset("nav aside footer menu dialog".split())

#: Smoothness of neighbours in page order, across sections, and under one parent.
NEXT, NEXT_APART, SIBLING = 1.0, 0.25, 0.75
_SECTIONS = frozenset("article main nav footer aside form header section dialog menu".split())
_BODIES = frozenset(("tbody", "thead", "tfoot"))


class Block:
    __slots__ = ("pieces", "linked", "length", "weight", "section", "parent", "element")

    def __init__(self, element, section, parent):
        self.pieces, self.linked, self.length, self.weight = [], 0, 0, 0.0
        self.element, self.section, self.parent = element, section, parent


class Element:
    __slots__ = ("tag", "parent", "weight", "name", "hidden", "text", "region")

    def __init__(self, tag, parent, weight=0.0, name="", hidden=False):
        self.tag, self.parent, self.weight, self.name, self.hidden = tag, parent, weight, name, hidden
        self.text, self.region = 0, False


def _names(attrs: str) -> tuple[str, bool]:
    """Words of class, id and role, and whether the element is hidden."""
    words, hidden = [], False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name not in _READ:
            continue
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif name != "style":
            words.append(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value))
    return " ".join(words), hidden


def _tag_end(page: str, at: int, failed: set[int]) -> int:
    """Where the tag with attributes from ``at`` on ends, or -1 if it meets ``<`` or the end of the page first.

    Attributes may hold anything in quotes, of any length.  ``failed`` keeps the quotes from which no end is found, so that no text is read twice.
    """
    quotes = []
    while True:
        at = _PLAIN.match(page, at).end()
        sign = page[at: at + 1]
        if sign == ">":
            return at + 1
        if sign in ("", "<") or at in failed:
            break
        quotes.append(at)
        at = page.find(sign, at + 1) + 1
        if not at:
            break
    failed.update(quotes)
    return -1


def _tokens(page: str):
    """``start, end, cdata, tag, closes, hides, attrs`` of all that is not text; a hidden element is one token."""
    at, failed, endless = 0, set(), set()
    while m := _MARK.search(page, at):
        start, at, tag, attrs = m.start(), m.end(), (m["tag"] or "").lower(), None
        if not tag:
            if m["other"]:
                at = page.find(">", at) + 1 or len(page)
            yield start, at, m["cdata"], "", False, False, None
            continue
        end = _tag_end(page, at, failed)
        if end >= 0:
            attrs = page[at: end - 1]
        elif short := _TO_END.match(page, at):  # quotes that are not closed
            end = short.end()
        elif m["close"]:
            end = page.find(">", at) + 1 or len(page)
            tag = ""
        else:
            continue  # what is not closed ends at the next "<" and is text
        at = end
        hides = tag in _HIDDEN and not m["close"]
        if hides and not (tag in ("svg", "math") and attrs and _closes_itself(attrs)):
            last = None if tag in endless else _END_OF[tag].search(page, at)
            if last:
                at = page.find(">", last.end()) + 1 or len(page)
            else:
                endless.add(tag)  # no end further on either
                at = len(page) if tag in _RAW else at
        yield start, at, None, tag, bool(m["close"]), hides, attrs


def _closes_itself(attrs: str) -> bool:
    """Whether the tag ends in ``/>``; a slash that ends a value without quotes belongs to the value."""
    if not attrs.endswith("/"):
        return False
    last = attrs[max(attrs.rfind(x) for x in " \t\n\f\r\"'") + 1:]
    return "=" not in last and not attrs[: len(attrs) - len(last)].rstrip().endswith("=")


def _around(weight: float, more: float) -> float:
    """Weight inside an element: clearly bad surroundings undo good ones outside and are not undone inside."""
    if more <= CLEARLY_BAD:
        return min(weight, 0.0) + more
    return weight + (min(more, 0.0) if weight <= CLEARLY_BAD else more)


def _judged(tag: str, names: str) -> str:
    """``bad``, ``layout``, ``good`` or nothing, for the names of an element."""
    names = _MENTIONS.sub(" ", names)
    if tag in ("article", "main"):
        return "bad" if _ARTICLE_IS.search(names) else "good"
    if _POST.search(names):
        names = _SUBJECTS.sub(" ", names)
    if BAD_NAMES.search(names):
        return "bad"
    if LAYOUT_NAMES.search(names):
        return "layout"
    return "good" if GOOD_NAMES.search(names) else ""


def _weigh(elements: list[Element]) -> list[float]:
    """Weight of all that is around the text of each element (parents come before children)."""
    apart = [False] * len(elements)  # text that is no part of what wrappers hold
    for i, e in enumerate(elements[1:], 1):
        e.hidden = e.hidden or elements[e.parent].hidden
        apart[i] = apart[e.parent] or e.hidden or e.name == "bad" or e.tag in _NEVER_WRAP
        e.text = 0 if apart[i] else e.text
    for e in reversed(elements[1:]):
        elements[e.parent].text += e.text
    whole = [e for e in elements if e.tag == "main" and e.text] or [e for e in elements if e.tag == "article" and e.name != "bad" and e.text] or elements[:1]
    region = max(whole, key=lambda e: e.text)
    holds = region
    while True:
        holds.region = True
        if holds.parent < 0:
            break
        holds = elements[holds.parent]
    inside, weights = [False] * len(elements), [0.0] * len(elements)
    for i, e in enumerate(elements):
        inside[i] = e is region or e.parent >= 0 and inside[e.parent]
        if not i:
            continue
        wrapper = e.tag not in _NEVER_WRAP and (e.region or inside[i] and e.text >= WRAPPER_SHARE * region.text > 0)
        weight = weights[e.parent]
        if not (wrapper and e.tag == "form"):
            weight = _around(weight, e.weight)
        if e.hidden and not elements[e.parent].hidden or e.name == "bad":
            weight = _around(weight, BAD_WEIGHT)
        elif e.name == "layout":
            weight = weight + WRAPPER_WEIGHT if wrapper else _around(weight, BAD_WEIGHT)
        elif e.name == "good" and e.tag not in ("article", "main"):
            weight = _around(weight, GOOD_WEIGHT)
        weights[i] = weight
    return weights


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    blocks: list[Block] = []
    elements = [Element("", -1)]
    # an open element: tag, its number, section number, number of the element that holds blocks, inside a link
    stack = [("", 0, 0, 0, False)]
    # where in the stack each tag is open, and elements that are not inline (those of tables' bodies apart)
    opened: dict[str, list[int]] = {}
    holders: list[int] = [0]
    bodies: list[int] = []
    current: Block | None = None

    def text(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if "&" in raw:
            raw = html.unescape(raw)
        if current is None:
            if not raw.strip():
                return
            current = Block(stack[-1][1], stack[-1][2], stack[-1][3])
            blocks.append(current)
        current.pieces.append(raw)
        n = len(raw)
        current.length += n
        elements[stack[-1][1]].text += len(raw.strip())
        if stack[-1][4]:
            current.linked += n

    def close_to(at: int) -> None:
        nonlocal current
        for e in reversed(stack[at:]):
            opened[e[0]].pop()
            if e[0] not in INLINE:
                current = None
                (bodies if e[0] in _BODIES else holders).pop()
        del stack[at:]

    def last(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    at = 0
    for start, end, cdata, tag, closes, hides, attrs in _tokens(page):
        text(page[at:start])
        at = end
        if cdata:
            text(cdata)
            continue
        if not tag:
            continue
        if hides:
            if tag in ("title", "button", "select", "textarea"):
                current = None
            continue
        if closes:
            if not opened.get(tag):
                if tag not in INLINE:
                    current = None
            elif tag not in INLINE or opened[tag][-1] > max(holders[-1], bodies[-1] if bodies else 0):
                close_to(opened[tag][-1])  # an end tag in a line does not end blocks
            continue
        if tag not in INLINE:
            current = None
        if tag in VOID or tag == "head":  # what a head shows is hidden by itself; anything else there belongs to the body
            continue
        ends = SELF_ENDING.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        if ends:
            ended = last(ends)
            if ended and ended >= holders[-1] and ended > last(SCOPES.get(tag, ())):
                close_to(ended)
        _, parent, section, holder, link = stack[-1]
        number = len(elements)
        element = Element(tag, parent)
        if tag != "header" or not (opened.get("article") or opened.get("main")):  # the head of an article belongs to it
            element.weight = ELEMENT_WEIGHTS.get(tag, 0.0)
        if attrs and tag not in ("html", "body"):
            names, element.hidden = _names(attrs)
            element.name = _judged(tag, names) if names else ""
        elements.append(element)
        if tag not in INLINE:
            (bodies if tag in _BODIES else holders).append(len(stack))
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, number, number if tag in _SECTIONS else section, holder if tag in INLINE else number, link or tag == "a"))
    text(page[at:])
    weights = _weigh(elements)
    for b in blocks:
        b.weight = weights[b.element]
    return blocks


def content_score(block: Block, text: str) -> float:
    """The classifier: positive for content."""
    score = block.weight - 0.1
    score += min(len(text) / 80.0, 2.0)
    score -= 4.0 * block.linked / max(block.length, 1)
    if text[-1:] in ".!?:\"'”»…)" and len(text) > 30:
        score += 0.5
    if "©" in text or re.search(r"all rights reserved|cookies?\b.{0,40}\b(?:accept|policy)", text, re.I):
        score -= 3.0
    return score


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT if blocks[i - 1].section == b.section else NEXT_APART))
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: ``scores`` pay for content (positive) or boilerplate (negative), ``edges`` for differing labels."""
    n = len(scores)
    scores = list(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # blocks whose own cost decides
        i = todo.popleft()
        if label[i] is not None or abs(scores[i]) <= sum(near[i].values()) and near[i]:
            continue
        label[i] = scores[i] > 0
        for j, w in near[i].items():
            scores[j] += w if label[i] else -w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _source_side(rest, scores, near), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _source_side(nodes: list[int], scores: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Blocks on the content side of a minimum cut: those that the source still reaches when no more flow fits."""
    place = {v: i for i, v in enumerate(nodes)}
    s, t = len(nodes), len(nodes) + 1
    room: list[dict[int, float]] = [{} for _ in range(len(nodes) + 2)]
    for i, v in enumerate(nodes):
        if scores[v] > 0:
            room[s][i] = scores[v]
            room[i][s] = 0.0
        elif scores[v] < 0:
            room[i][t] = -scores[v]
            room[t][i] = 0.0
        for u, w in near[v].items():
            room[i][place[u]] = w
    tiny = 1e-9
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for v, r in room[u].items():
                if r > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if t not in level:
            return [i in level for i in range(len(nodes))]
        ways = [iter(list(r)) for r in room]
        path = [s]
        while path:  # flow along shortest paths until none is left
            u = path[-1]
            if u == t:
                push = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    room[a][b] -= push
                    room[b][a] = room[b].get(a, 0.0) + push
                cut = next(i for i, (a, b) in enumerate(zip(path, path[1:], strict=False)) if room[a][b] <= tiny)
                del path[cut + 1:]
                continue
            for v in ways[u]:
                if level.get(v) == level[u] + 1 and room[u].get(v, 0.0) > tiny:
                    path.append(v)
                    break
            else:
                path.pop()


def main_text(page: str | None) -> str:
    """Text of the content blocks, each with single spaces, joined by single spaces."""
    if not page:
        return ""
    blocks, texts = [], []
    for b in blocks_of(page):
        joined = " ".join("".join(b.pieces).split())
        if joined:
            blocks.append(b)
            texts.append(joined)
    if not blocks:
        return ""
    labels = minimum_cut([content_score(b, x) for b, x in zip(blocks, texts, strict=True)], edges_of(blocks))
    return " ".join(x for x, keep in zip(texts, labels, strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in ``keep`` with ``text`` and ``n_chars`` (code points) for every row."""
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=schema.names)

    return map_batches(pages.select(*keep, F.col(html_col).cast("string").alias(html_col)), run, schema)
