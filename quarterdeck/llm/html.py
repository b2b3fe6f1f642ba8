"""Operator 3: main text of web pages by tag-path ratios.

A page is read into blocks: runs of text between block-level tags, each with its root-to-leaf tag path. A step of a
path is the tag, for containers (div, section, article and the like) with its classes, and a flag where class, id
or role names boilerplate. Over a page, text length, punctuation and link text are summed per path and divided by
the path's blocks (text to tag path ratio). Both ratios are smoothed over paths in page order, between paths of one
container or of a container or of a container and the one around it; they are fused by product and reduced by the share of link
text and by the path's weight (STRONG where a step is named as boilerplate, WEAK where a name only contains such a
word). A heading takes the score of the path that it heads, whatever its own class. Content paths are those over THRESHOLD of the best one, and in
the region of that one those the root of whose score is, so that a paragraph a tenth as long as the others still counts.

Content nodes are the containers at least half of whose own text is on content paths; all blocks of theirs are
returned. So are those of containers inside them that are neither named as boilerplate nor mostly links: those in an
article with a content node, and those around which a content node has text of its own.

Elements that are boilerplate by their tag (nav, footer, aside, form, script, a header outside of the article
and so on) are read but never count.

A page is one row, so this is a map without a shuffle. Time and memory are linear in the page: a path is a node of a
tree of steps, and the places of the open elements are kept by tag, so that no end tag searches them.

Defined results: null, empty and text-free pages give an empty text and n_chars 0; null page_id and url are kept;
repeated rows get a row each; broken markup is read as browsers do in the common cases (unclosed
p, li, b; stray end tags; a tag cut off at the end); of equal scores the longer path and then the first one is
best; no pages give no rows; other columns are ignored.
"""

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.1
SMOOTHING = 0.25
#: Weight of a path with a step that class, id or role name as boilerplate, or with a class that holds such a word.
STRONG, WEAK = 1e-6, 0.5

EXTRACTED = "page_id long, url string, text string, n_chars long"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
#: A tag whose quotes don't match ends at the next ">".
_LENIENT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>(?:(?!)(.))?")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?]")
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>?", re.I) for x in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_SCOPE = frozenset("ul ol dl table article section div body html select".split())
#: Elements that are never content.
_DROPPED = frozenset("head nav footer aside form script style noscript iframe object svg canvas template button select textarea title dialog menu audio video map math".split())
#: Words of class, id and role that name boilerplate.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion teaser teasers banner cookie cookies notice notices consent gdpr popup modal overlay "
    "menu menus nav navbar navigation breadcrumb breadcrumbs masthead header footer sidebar aside complementary contentinfo widget widgets share sharing social related recommended "
    "comment comments commentlist disqus reply replies respond newsletter subscribe subscription signup login search pagination pager toolbar alert disclaimer copyright".split()
)
#: First words of a class that speak of a part of the element, or of a part of the article; last words that tell a state.
_OF_PART = frozenset("has with without no entry post article story content main hero".split())
_STATE = frozenset("enabled disabled open closed active visible on off".split())
#: Words that stand beside a mark in the name of boilerplate; a mark beside any other word names a subject (related-work, menu-of-the-day).
_PARTS = frozenset(
    "box boxes bar bars list lists item items wrap wrapper container inner outer area block blocks section group row col column grid panel card cards slot unit zone region link links button buttons icon icons form field "
    "top bottom left right site page global main primary secondary mobile desktop sticky fixed post posts entry article articles story stories thread body content text js module component the".split()
)
#: Marks of readers' comments.
_REPLIES = frozenset("comment comments commentlist disqus reply replies respond".split())
_ROOTS = frozenset(("article", "main"))
_CONTAINERS = frozenset("html body div section article main td th center details".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


@lru_cache(1 << 14)
def _attributes(text: str, anchored: bool = False) -> tuple[str, float, bool]:
    """(classes without digits, weight, hidden) of a tag's attributes; the id of a part of an article is an anchor (anchored) and names no boilerplate but readers' comments."""
    classes, weight = "", 1.0
    for name, value in _ATTRIBUTE.findall(text):
        value = value.strip("\"'").lower()
        if name.lower() == "class":
            classes = ".".join(re.sub(r"[\d_-]+", "", value).split())
        for token in value.split():
            words = [x for x in re.split(r"[^a-z]+", token) if x]
            if not (_REPLIES if anchored and name.lower() == "id" else _MARKS).isdisjoint(words):
                named = words[0] in _MARKS or words[0] not in _OF_PART and words[-1] in _MARKS
                named = named and words[-1] not in _STATE and all(x in _MARKS or x in _PARTS for x in words)
                weight = min(weight, STRONG if named else WEAK)
    return classes, weight, bool(re.search(r"\shidden(?=[\s=]|\Z)|aria-hidden\s*=\s*[\"']?true", text, re.I))


class Paths:
    """The tree of a page's tag paths; a path is the number of its last step."""

    def __init__(self):
        self.number: dict[tuple[int, str], int] = {}
        self.tag, self.container, self.around, self.weight, self.article = [""], [0], [0], [1.0], [-1]

    def step(self, parent: int, tag: str, classes: str, weight: float) -> int:
        nested = tag == "article" and self.article[parent] >= 0  # an article in an article is a reader's comment
        weight = STRONG if nested else 1.0 if tag in ("html", "body") or tag in _HEADINGS else weight
        key = (parent, f"{tag}.{classes}!{weight}" if tag in _CONTAINERS else f"{tag}!{weight}")
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.tag)
            own = tag in _CONTAINERS and not (tag in ("td", "th") and self.article[parent] >= 0) or weight == STRONG
            self.tag.append(tag)
            self.container.append(found if own else self.container[parent])
            self.around.append(self.container[parent] if own else self.around[parent])
            self.weight.append(min(weight, self.weight[parent]))
            self.article.append(found if tag == "article" and not nested else self.article[parent])
        return found


def blocks(page: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """The page's paths and (path, text, characters of link text) of every block that no tag makes boilerplate, in page order."""
    out: list[tuple[int, str, int]] = []
    paths = Paths()
    stack: list[tuple[str, int, bool]] = []  # tag, path, dropped
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack, by tag
    solid: list[int] = []  # places of elements that are not inline
    scopes: list[int] = []
    parts: list[str] = []
    path = links = dropped = 0

    def closed() -> None:
        nonlocal links
        if parts:
            if text := " ".join(unescape("".join(parts)).split()):
                out.append((path, text, links))
            parts.clear()
        links = 0

    def close(k: int) -> None:
        nonlocal dropped
        while len(stack) > k:
            tag, _, gone = stack.pop()
            opened[tag].pop()
            dropped -= gone
            for places in (solid, scopes):
                if places and places[-1] == len(stack):
                    places.pop()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if m[4] == "<" and re.match(r"/?[a-zA-Z]", page[at + 1 : at + 3]):
            m = _LENIENT.match(page, at)
            if m is None:  # a tag that the page's end cuts off
                break
        at = m.end()
        text = m[4]
        if text is not None:
            if not dropped:
                if not parts:
                    path = stack[-1][1] if stack else 0
                parts.append(text)
                if opened["a"]:
                    links += len(text)
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        inline = tag in _INLINE
        if not inline:
            if tag == "br":
                parts.append(" ") if parts else None
            else:
                closed()
        if m[1]:
            own = opened[tag][-1] if opened[tag] else -1
            if own >= 0 and not (inline and solid and solid[-1] > own):
                close(own)
            continue
        if tag in _CLOSES_P:
            if solid and stack[solid[-1]][0] == "p":
                close(solid[-1])
        elif tag in _CLOSES:
            inside = scopes[-1] if scopes else -1
            first = [places[k] for x in _CLOSES[tag] if (k := bisect_right(places := opened[x], inside)) < len(places)]
            if first:
                close(min(first))
        if tag in _RAW:
            m = _RAW_END[tag].search(page, at)
            at = m.end() if m else end
            continue
        if tag in _VOID or m[3].endswith("/") and tag in ("svg", "path", "use"):
            continue
        classes, weight, hidden = _attributes(m[3], tag == "section" and bool(opened["article"])) if m[3] else ("", 1.0, False)
        gone = tag in _DROPPED or tag == "header" and not (opened["article"] or opened["main"]) or hidden and tag not in ("html", "body")
        parent = stack[-1][1] if stack else 0
        opened[tag].append(len(stack))
        if not inline:
            solid.append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append((tag, parent if inline and weight != STRONG else paths.step(parent, tag, classes, weight), gone))
        dropped += gone
    closed()
    return paths, out


def scores(paths: Paths, found: list[tuple[int, str, int]]) -> tuple[dict[int, float], dict[int, list[float]]]:
    """Fused ratio of each path with text, and its sums of text, punctuation, link text and blocks."""
    sums: dict[int, list[float]] = {}
    for path, text, links in found:
        s = sums.setdefault(path, [0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(_PUNCTUATION.findall(text))
        s[2] += min(links, len(text))
        s[3] += 1
    order = list(sums)
    length = [s[0] / s[3] for s in sums.values()]
    marks = [(s[1] + 1) / s[3] for s in sums.values()]

    def near(i: int, j: int) -> bool:
        """Neighbours in page order that a reader takes for one text: of one container, or of one and the next one around it."""
        if not 0 <= j < len(order):
            return False
        a, b = paths.container[order[i]], paths.container[order[j]]
        return a == b or (paths.around[a] == b or paths.around[b] == a) and paths.weight[a] == paths.weight[b]

    def smooth(x: list[float]) -> list[float]:
        return [(1 - 2 * SMOOTHING) * x[k] + SMOOTHING * (x[k - 1] if near(k, k - 1) else x[k]) + SMOOTHING * (x[k + 1] if near(k, k + 1) else x[k]) for k in range(len(x))]

    fused = {p: a * b * max(1 - s[2] / s[0], 0.01) * paths.weight[p] for (p, s), a, b in zip(sums.items(), smooth(length), smooth(marks), strict=True)}
    for k in range(len(order) - 2, -1, -1):
        p, after = order[k], order[k + 1]
        if paths.tag[p] in _HEADINGS and paths.weight[p] == paths.weight[after]:
            inner = paths.container[after]
            for _ in range(8):
                if inner == paths.container[p]:
                    fused[p] = max(fused[p], fused[after])
                    break
                inner = paths.around[inner]
    return fused, sums


def main_text(page: str) -> str:
    """The text of a page's content nodes, joined by one space."""
    paths, found = blocks(page)
    if not found:
        return ""
    fused, sums = scores(paths, found)
    # the fused ratio falls with the square of a block's length, its root in proportion to it: many paragraphs outweigh one long notice
    best = max(fused, key=lambda p: (fused[p] ** 0.5 * sums[p][3], sums[p][0]))
    region = (paths.container[best], paths.around[paths.container[best]])

    def least(p: int) -> float:
        """Of the best ratio: its root's share in the region of the best path (its container, those inside, beside and around it), elsewhere its own."""
        c = paths.container[p]
        return fused[best] * (THRESHOLD**2 if c in region or paths.around[c] in region else THRESHOLD)

    total: dict[int, list[float]] = {}  # of a container: its own text, that on content paths, and link text
    for p, s in sums.items():
        t = total.setdefault(paths.container[p], [0, 0, 0])
        t[0] += s[0]
        t[1] += s[0] if fused[p] >= least(p) else 0
        t[2] += s[2]
    content = {c for c, t in total.items() if 2 * t[1] >= t[0]}
    articles = {paths.article[c] for c in content}
    own = set(content)  # with text of their own
    for c in sorted(set(range(len(paths.tag))) - own):  # a step's number is larger than those of the steps before it
        if paths.container[c] != c:
            continue
        around = paths.around[c]
        plain = paths.weight[c] >= WEAK * paths.weight[around] and 2 * total.get(c, (1, 0, 0))[2] < total.get(c, (1, 0, 0))[0]
        if plain and (around in own or paths.article[c] >= 0 and paths.article[c] in articles):
            own.add(c)
            content.add(c)
    return " ".join(text for p, text, _ in found if paths.container[p] in content)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(extract, EXTRACTED)
