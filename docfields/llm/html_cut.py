"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks with their place in the element tree. A
classifier gives each block a cost for being content and one for being
boilerplate; these are the capacities to the two terminals. Edges between
neighbouring blocks, stronger the closer they stand in the tree, make labels
smooth. The minimum cut is the cheapest labelling; its source side is the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame

from docfields.llm.common import arrow_map, prepare, renamed, slices

# Element kinds. Fixed values.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr br img input".split())
#: Their content is no text of the page.
SKIPPED = set("script style noscript template iframe svg math head title textarea select button object canvas audio "
              "video map datalist".split())
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
#: What can stand in a head; other elements end it.
IN_HEAD = set("head base basefont bgsound link meta title style script noscript noframes template".split())
#: Boilerplate by meaning.
CHROME = set("nav footer aside form dialog menu".split())
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
               "pre section table ul figure".split())
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}, "option": {"option"}}
#: Elements that end a skipped one without an end tag of its own.
ENDS_SKIPPED = (CLOSES_P | set(CLOSES_SAME) | {"body", "head"}) - {"option"}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form "
            "status tablist".split())
#: Parts of class and id names that mark boilerplate, and that mark content.
BOILER = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
             "banner sidebar sidebars side rail nav navbar navigation navi menu menus breadcrumb breadcrumbs crumbs footer foot "
             "bottombar topbar header masthead cookie cookies consent gdpr privacy notice notices notification alert "
             "popup modal overlay lightbox newsletter subscribe subscription signup signin login register share "
             "sharing social follow related recommended recommendations trending popular comments comment respond "
             "disqus replies reply discussion toolbar pagination pager pagenav widget widgets copyright legal "
             "search skip tags taglist teaser teasers outbrain taboola paywall feedback rating "
             "disclaimer backlink adsbox adslot adbox commentlist".split())
DISCUSSION = set("comment comments commentlist respond disqus replies reply discussion".split())
#: Never wrappers; others are, with more than this share of the page's text.
NEVER_WRAPS, WRAPS = {"nav", "footer", "aside", "header"}, 0.6
GOOD = set("article content post entry story body text main".split())
#: Logits of the classifier.
IN_MAIN, IN_OTHER, NO_MAIN, IN_CHROME, IN_CLASS, IN_GOOD = 4.0, -3.0, 0.0, -14.0, -9.0, 1.5
LINKED, WORDS, SENTENCE, HEADING, NOTICE = -5.0, 0.5, 0.8, 1.5, -3.0
#: Smoothness: between neighbours, and by closeness in the tree.
ADJACENT, SIBLING = 0.25, 0.5

OPENING = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: The rest of a tag, quoted values whole; possessive, so that a failure costs one pass.
REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ENDS = {"<!--": re.compile(r"--!?>"), "<![CDATA[": re.compile(r"\]\]>")}
#: Tags of a page whose quotes may never close; from then on quotes count for nothing.
ODD_QUOTES = 64
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
END_OF_SENTENCE = re.compile(r"""[.!?…。！？]["'»”’)\]]*$""")
RIGHTS = re.compile(r"©|all rights reserved|^copyright\b", re.IGNORECASE)


class Element:
    __slots__ = ("tag", "parent", "depth", "chrome", "boiler", "good", "chars", "holds_main", "holds_title", "in_main", "discussion", "verdict")

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.chars, self.verdict = 0, 0.0
        self.holds_main = self.holds_title = self.in_main = False
        found = {}
        if attributes and not attributes.isspace():
            for name, value in ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
        role = found.get("role", "").lower()
        hidden = ("hidden" in found or found.get("aria-hidden") == "true"
                  or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE))
        self.chrome = tag in CHROME or role in ROLES or bool(hidden)
        names = {p.lower() for p in NAME_PART.findall(f"{found.get('class', '')} {found.get('id', '')}")}
        self.boiler = tag not in ("html", "body") and bool(names & BOILER)
        self.discussion = bool(names & DISCUSSION)
        self.good = bool(names & GOOD) or tag in ("article", "main") or role in ("main", "article")


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: float):
        self.text, self.element, self.linked = text, element, linked


def tags_of(page: str) -> tuple[list[tuple[int, int, str, bool, str]], int]:
    """Start, end, name (none for comments), whether it closes, and attributes
    of each tag, a raw element being one tag up to its own end; and where the
    page's text ends (a tag that never ends takes the rest). A tag whose quotes
    never close ends at the next ``>``. Linear in the page."""
    out, at, n, foreign, odd = [], 0, len(page), 0, 0
    while m := OPENING.search(page, at):
        start = m.start()
        if m[2] is None:
            closed = ENDS[m[0]].search(page, m.end()) if m[0] in ENDS else None
            at = closed.end() if closed else n if m[0] in ENDS else page.find(">", m.end()) + 1
            if not at:
                return out, start
            out.append((start, at, "", False, ""))
            continue
        rest = REST.match(page, m.end()) if odd < ODD_QUOTES else None
        if rest is None:
            odd += 1
            end = page.find(">", m.end())
            if end < 0:
                return out, start
            attributes, at = page[m.end():end], end + 1
        else:
            attributes, at = rest[1], rest.end()
        tag, closing = m[2].lower(), bool(m[1])
        single = attributes.rstrip().endswith("/")
        if tag in ("svg", "math") and not single:
            foreign = max(0, foreign + (-1 if closing else 1))
        if tag in RAW and not closing and not (foreign and single):
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
        out.append((start, at, tag, closing, attributes))
    return out, n


def skipped_ends(tags: list[tuple[int, int, str, bool, str]]) -> dict[int, int]:
    """Number of the end tag of each skipped element that has one."""
    out: dict[int, int] = {}
    unclosed: dict[str, list[int]] = {}
    for i, (_, _, tag, closing, attributes) in enumerate(tags):
        if tag in SKIPPED and tag not in RAW:
            if not closing:
                if not attributes.rstrip().endswith("/"):
                    unclosed.setdefault(tag, []).append(i)
            elif unclosed.get(tag):
                out[unclosed[tag].pop()] = i
    return out


def end_of_head(tags: list[tuple[int, int, str, bool, str]], i: int, ends: dict[int, int], size: int) -> tuple[int, int]:
    """The first tag after a head whose content begins with tag ``i``, and the
    place where the page goes on. Its end tag is optional, so elements that
    cannot stand in a head end it too."""
    while i < len(tags):
        start, end, tag, closing, _ = tags[i]
        if closing and tag == "head":
            return i + 1, end
        if tag and (tag in ("body", "html") if closing else tag not in IN_HEAD):
            return i, start
        i = ends.get(i, i) + 1 if tag == "template" and not closing else i + 1
    return i, size


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """Text blocks in page order, and the elements. Unclosed and stray tags
    are taken as browsers take them; a cut-off tag at the end is no text."""
    root = Element("", None, "")
    elements, blocks, stack = [root], [], [root]
    parts: list[tuple[str, bool]] = []
    links, at, i = 0, 0, 0
    tags, last = tags_of(page)
    ends = skipped_ends(tags)
    opened: Counter = Counter()  # open elements by name

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = sum(len(p) for p, inside in parts if inside)
                blocks.append(Block(text, stack[-1], linked / max(1, sum(len(p) for p, _ in parts))))
            parts = []

    while True:
        start, end, tag, closing, attributes = tags[i] if i < len(tags) else (last, last, "", False, "")
        text = page[at:start]
        if text:
            parts.append((text, links > 0))
        if i >= len(tags):
            break
        at, i = end, i + 1
        if not tag or not closing and tag in RAW:
            continue
        if not closing and tag in SKIPPED:
            if attributes.rstrip().endswith("/"):
                continue
            if tag == "head":
                i, at = end_of_head(tags, i, ends, len(page))
            elif i - 1 in ends:
                i = ends[i - 1] + 1
                at = tags[i - 1][1]
            else:
                # without an end tag: up to a block, or the end of an element around it
                while i < len(tags) and not (opened[tags[i][2]] if tags[i][3] else tags[i][2] in ENDS_SKIPPED):
                    i += 1
                at = tags[i][0] if i < len(tags) else len(page)
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(("\n", links > 0))
            elif tag == "a":
                links = max(0, links + (-1 if closing else 1)) if closing else 1
            continue
        flush()
        links = 0
        if closing:
            while opened[tag]:
                gone = stack.pop().tag
                opened[gone] -= 1
                if gone == tag:
                    break
            continue
        if tag in CLOSES_P or tag in CLOSES_SAME:
            for ended in ({"p"}, CLOSES_SAME.get(tag, {"p"})):
                if stack[-1].tag in ended:
                    opened[stack.pop().tag] -= 1
        if tag not in VOID:
            element = Element(tag, stack[-1], attributes)
            elements.append(element)
            stack.append(element)
            opened[tag] += 1
    flush()
    return blocks, elements


def mark_main(blocks: list[Block], elements: list[Element]) -> bool:
    """Find the main element and what holds it; whether there is one. Elements
    stand after those that hold them, so each pass goes up or down the list."""
    for b in blocks:
        b.element.chars += len(b.text)
    for e in reversed(elements):
        if e.parent:
            e.parent.chars += e.chars
    total = sum(len(b.text) for b in blocks)
    for e in elements:
        # a wrapper around the page, whatever its name
        if e.tag not in NEVER_WRAPS and not e.discussion and e.chars > WRAPS * total:
            e.holds_main = True
        if e.tag == "h1":
            x = e.parent
            while x and not x.holds_title:
                x.holds_title = True
                x = x.parent
    outside: set[int] = set()  # elements in something that is no content
    mains, articles = [], []
    for e in elements:
        out = (e.chrome or e.boiler) and not (e.holds_main or e.holds_title and e.tag not in NEVER_WRAPS)
        if e.parent and id(e.parent) in outside:
            out = True
        elif e.tag == "article" and e.chars and not e.boiler:
            articles.append(e)
        if out:
            outside.add(id(e))
        if e.tag == "main" and e.chars:
            mains.append(e)
    best = max(articles, key=lambda e: e.chars, default=None) or max(mains, key=lambda e: e.chars, default=None)
    if best is None:
        return False
    best.in_main = True
    x = best
    while x:
        x.holds_main = True
        x = x.parent
    for e in elements:
        e.in_main = e.in_main or bool(e.parent and e.parent.in_main)
    return True


def judge(elements: list[Element]) -> None:
    """Each element's ``verdict``, the logit that its place in the tree gives:
    the worst evidence of all elements around, but for those that hold the main
    element itself."""
    for e in elements:
        above = e.parent.verdict if e.parent else 0.0
        own = 0.0
        if not e.holds_main:
            if e.chrome or e.tag == "header" and not e.in_main:
                own = IN_CHROME
            elif e.boiler:
                own = IN_CLASS
        e.verdict = min(above, own)
        if not e.verdict and e.good and not above:
            e.verdict = IN_GOOD
        elif own == 0.0:
            e.verdict = above


def logit(b: Block, has_main: bool) -> float:
    e = b.element
    words = b.text.count(" ") + 1
    x = e.verdict + (IN_MAIN if e.in_main else IN_OTHER if has_main else NO_MAIN)
    x += LINKED * b.linked * (0.3 if words >= 40 else 0.5 if e.in_main else 1)
    x += WORDS * (math.log2(words) - 2.5) if not e.in_main else 0.0
    if END_OF_SENTENCE.search(b.text):
        x += SENTENCE
    if e.tag in ("h1", "h2", "h3"):
        x += HEADING
    if RIGHTS.search(b.text) and words < 40:
        x += NOTICE
    return x


def costs(x: float) -> tuple[float, float]:
    """Negative log-likelihoods of content and of boilerplate."""
    return math.log1p(math.exp(-x)) if x > -30 else -x, math.log1p(math.exp(x)) if x < 30 else x


def distance(a: Element, b: Element) -> int:
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def min_cut(content: list[float], boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the cheapest cut (True: content), by blocking flows.

    ``content[i]``: cost of calling i content (capacity to the sink);
    ``boiler[i]``: of calling it boilerplate (capacity from the source).
    """
    n = len(content)
    source, sink = n, n + 1
    ends: list[int] = []
    room: list[float] = []
    of: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: float, back: float) -> None:
        of[a].append(len(ends))
        ends.append(b)
        room.append(forth)
        of[b].append(len(ends))
        ends.append(a)
        room.append(back)

    for i in range(n):
        through = min(content[i], boiler[i])
        link(source, i, boiler[i] - through, 0.0)
        link(i, sink, content[i] - through, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for k in of[a]:
                if room[k] > least and level[ends[k]] < 0:
                    level[ends[k]] = level[a] + 1
                    todo.append(ends[k])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[k] for k in path)
                for k in path:
                    room[k] -= flow
                    room[k ^ 1] += flow
                # back to the start of the first full edge
                i = next(i for i, k in enumerate(path) if room[k] <= least)
                a = ends[path[i] ^ 1]
                del path[i:]
                continue
            while turn[a] < len(of[a]):
                k = of[a][turn[a]]
                if room[k] > least and level[ends[k]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(of[a]):
                path.append(of[a][turn[a]])
                a = ends[path[-1]]
            elif path:
                level[a] = -1
                k = path.pop()
                a = ends[k ^ 1]
            else:
                break


def main_text(page: str | None) -> str:
    """Content blocks of a page, joined by line feeds."""
    if not page:
        return ""
    blocks, elements = blocks_of(page)
    if not blocks:
        return ""
    has_main = mark_main(blocks, elements)
    judge(elements)
    pairs = [costs(logit(b, has_main)) for b in blocks]
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT / (1 + distance(blocks[i - 1].element, b.element))))
        # the block before it under the same parent
        parent = id(b.element.parent)
        if parent in last:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    kept = min_cut([c for c, _ in pairs], [c for _, c in pairs], edges)
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    Null or empty html gives an empty text; null ids and urls stay; repeated
    rows and empty tables pass through; other columns are not looked at.
    """
    prepare(pages.sparkSession)
    src = renamed(pages, page_id=id_col, url=url_col, html=html_col)

    def run(batch: pa.RecordBatch):
        raw = batch.column(2).to_pylist()
        for a, b in slices(raw):
            texts = [main_text(h) for h in raw[a:b]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(src, run, f"page_id {src.schema['page_id'].dataType.simpleString()}, "
                               f"url {src.schema['url'].dataType.simpleString()}, text string, n_chars long")
