"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf path of tags (and class names). For each path the length and the punctuation of its
nodes are summed and divided by their number; nodes get their path's ratios, which are smoothed along the page and fused
by multiplying, with a prior for what lies in article or main. The nodes of paths whose mean is over a threshold are the
text, wherever they stand, with the headings of sections that have some of it, and lists, tables and quotations beside it
that aren't mostly links. Elements that HTML or their names mark as navigation, notices, adverts, forms, comments and the
like have no nodes at all; a name alone doesn't count where the element holds most of the page. Paths are numbered, and an
element keeps what it inherits, so that deeply nested pages take memory in proportion to their length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import plus

#: Weights of the smoothing, for nodes up to two places away.
SMOOTH = (0.05, 0.25, 0.4, 0.25, 0.05)
#: A path is content from this fraction of the mean fused ratio of a page's characters on.
THRESHOLD = 0.25
#: What the ratios in article and main are multiplied by.
PRIOR = 4.0
#: An element marked by its name alone isn't noise from this share of the page's text on.
WRAPPER = 0.75

#: Fixed values, by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "title")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: A start tag ends an open element of these, up to the nearest element that holds it.
ENDS = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    **{t: ("p",) for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()},
}
SCOPE = frozenset("html body div article section main aside nav table ul ol dl td th blockquote form fieldset header footer".split())
#: Elements, roles and words in classes or ids that mark what isn't the article.
NOISE = frozenset("nav footer aside form button select menu dialog head".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar widget "
    "footer comment comments disqus reply replies respond cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup login "
    "share sharing related recommended recommendations pagination pager copyright disclaimer".split()
)
#: Words that mark only together with words for places and boxes, as in site-header, but not in entry-header.
VAGUE_WORDS = frozenset("header masthead aside alert overlay social legal search form toolbar".split())
BOX_WORDS = frozenset("site page top bottom main left right box bar block section area wrap wrapper container inner outer icons links list item items".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BESIDE = frozenset("ul ol dl table blockquote pre figure".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Za-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


class Element:
    __slots__ = ("parent", "tag", "noise", "outer", "path", "block", "article", "link", "beside", "depth")

    def __init__(self, parent: Element | None, tag: str, noise: bool, named: bool, path: int):
        self.parent, self.tag, self.noise, self.path = parent, tag, noise, path
        self.depth = parent.depth + 1 if parent else 0
        # the nearest element from this one up that its name marks
        self.outer = self if named else parent.outer if parent else None
        self.block = self if parent is None or tag not in INLINE else parent.block
        self.article = tag in ("article", "main") or parent is not None and parent.article
        self.link = tag == "a" or parent is not None and parent.link
        # the outermost list, table or quotation around it
        self.beside = parent.beside if parent and parent.beside else self if tag in BESIDE else None


def _marks(names: str, article: bool) -> bool:
    for name in names.lower().split():
        words = set(_WORD.findall(name))
        if words & NOISE_WORDS:
            return True
        vague = words & VAGUE_WORDS
        if vague and words <= VAGUE_WORDS | BOX_WORDS and not (article and vague <= {"header", "masthead"}):
            return True
    return False


def _element(parent: Element, tag: str, attributes: str, paths: dict[tuple[int, str], int]) -> Element:
    noise, label = parent.noise or tag in NOISE or tag == "header" and not parent.article, tag
    named, seen = False, set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name in seen:
            continue
        seen.add(name)
        if name in ("class", "id"):
            label += "." + value if name == "class" else ""
            named = named or tag not in ("html", "body", "article", "main") and _marks(value, parent.article)
        elif name == "role":
            noise = noise or value.lower() in NOISE_ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            noise = True
    path = parent.path if tag in INLINE else paths.setdefault((parent.path, label), len(paths) + 1)
    return Element(parent, tag, noise, named, path)


def nodes(page: str) -> Iterator[tuple[Element, int, str]]:
    """Element, number of the block and text of each text node outside of raw elements, in page order."""
    here, paths = Element(None, "", False, False, 0), {}
    block, at = 0, 0
    still: dict[str, int] = {}  # start tags less end tags that found theirs: at least the open elements of each name

    for m in [*_TOKEN.finditer(page), None]:
        if text := page[at : m.start() if m else len(page)]:
            yield here, block, text
        if m is None:
            break
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag == "br":
            yield here, block, " "
            continue
        if tag not in INLINE:
            block += 1
        if not m[2]:
            closed = here
            while closed.parent and any(still.get(x) for x in ENDS.get(tag, ())):
                if closed.tag in ENDS[tag]:
                    here = closed.parent
                    break
                if closed.tag in SCOPE:
                    break
                closed = closed.parent
            if tag not in VOID:
                here = _element(here, tag, m[4], paths)
                still[tag] = still.get(tag, 0) + 1
        elif still.get(tag):
            e = here
            while e.parent and e.tag != tag and not (tag in INLINE and e.tag not in INLINE):
                e = e.parent
            if e.parent and e.tag == tag:
                here = e.parent
                still[tag] -= 1


def main_text(page: str) -> str:
    found = [(e, b, entities.unescape(t)) for e, b, t in nodes(page) if not e.noise]
    cut = _cut([(e, b, t.strip()) for e, b, t in found if t.strip()])
    kept = [(e, b, t) for e, b, t in found if id(e.outer) not in cut]
    full = [(e, b, t.strip()) for e, b, t in kept if t.strip()]
    if not full:
        return ""
    chosen = _content(full)
    blocks: dict[int, list[str]] = {}
    for _, b, t in kept:
        if b in chosen:
            blocks.setdefault(b, []).append(t)
    return "\n".join(x for x in (" ".join("".join(parts).split()) for parts in blocks.values()) if x)


def _cut(full: list[tuple[Element, int, str]]) -> set[int]:
    """Elements marked by name, or in such; not counted are those that hold most of a page's text, in several blocks, and leave no text of articles out."""
    total = sum(len(t) for *_, t in full)
    articles = sum(len(t) for e, _, t in full if e.article)
    held: dict[int, list] = {}  # the element, its text, that in articles, its first and last block
    for e, b, t in full:
        x = e.outer
        while x and id(x) not in held:
            held[id(x)] = [x, 0, 0, b, b]
            x = x.parent.outer
        if e.outer:
            h = held[id(e.outer)]
            h[1], h[2], h[4] = h[1] + len(t), h[2] + (len(t) if e.article else 0), b
    inner_first = sorted(held.values(), key=lambda h: -h[0].depth)
    for e, n, inside, first, last in inner_first:
        if e.parent.outer:
            h = held[id(e.parent.outer)]
            h[1], h[2], h[3], h[4] = h[1] + n, h[2] + inside, min(h[3], first), max(h[4], last)
    out: set[int] = set()
    for e, n, inside, first, last in reversed(inner_first):
        spared = n >= WRAPPER * total and inside == articles and first < last
        if not spared or id(e.parent.outer) in out:
            out.add(id(e))
    return out


def ratios(full: list[tuple[Element, str]]) -> dict[int, float]:
    """The fused, smoothed ratio of each path: characters and punctuation marks a node."""
    sums: dict[int, list[float]] = {}
    for e, t in full:
        s = sums.setdefault(e.path, [0, 0, 0])
        s[0] += len(t)
        s[1] += len(_PUNCTUATION.findall(t))
        s[2] += 1
    raw = [(sums[e.path][0] / sums[e.path][2], sums[e.path][1] / sums[e.path][2]) for e, _ in full]
    # smoothing lifts short nodes among long ones, but doesn't lower a long one among short ones
    smooth = [[max(raw[i][j], sum(w * raw[min(max(i + k - 2, 0), len(raw) - 1)][j] for k, w in enumerate(SMOOTH))) for j in (0, 1)] for i in range(len(raw))]
    out: dict[int, list[float]] = {}
    for (e, _), (length, marks) in zip(full, smooth, strict=True):
        out.setdefault(e.path, []).append(length * (marks + 0.1))
    return {p: sum(v) / len(v) for p, v in out.items()}


def _content(full: list[tuple[Element, int, str]]) -> set[int]:
    """The blocks that are text."""
    headed, full = full, [x for x in full if x[0].block.tag not in HEADINGS]
    if not full:
        return {b for _, b, _ in headed}
    score = ratios([(e, t) for e, _, t in full])
    for e in {e.path: e for e, *_ in full}.values():
        if e.article:
            score[e.path] *= PRIOR
    mean = sum(score[e.path] * len(t) for e, _, t in full) / sum(len(t) for *_, t in full)
    chosen = {b for e, b, _ in full if score[e.path] >= THRESHOLD * mean}

    # lists and the like next to chosen blocks
    places = {id(x) for e, b, _ in full if b in chosen for x in (e.block, e.block.parent) if x}
    groups: dict[int, list] = {}
    for e, b, t in full:
        top = e.block.beside
        if top:
            g = groups.setdefault(id(top), [top, 0, 0, []])
            g[1] += len(t)
            g[2] += len(t) if e.link else 0
            g[3].append(b)
    for top, size, links, blocks in groups.values():
        if id(top.parent) in places and 2 * links < size:
            chosen.update(blocks)

    # a heading is text if its section, up to the next of its level or above, has some
    follows = [False] * len(HEADINGS)
    for e, b, _ in reversed(headed):
        if (tag := e.block.tag) in HEADINGS:
            level = HEADINGS.index(tag)
            if follows[level]:
                chosen.add(b)
            follows[level:] = [False] * (len(HEADINGS) - level)
        elif b in chosen:
            follows = [True] * len(HEADINGS)
    return chosen


def extracted(pages: DataFrame, html: str = "html", column: str = "main_text") -> DataFrame:
    """pages with a column of the main text: blocks in page order joined by one line feed, white space in a block one space.

    Character references are decoded. Null, empty and text-free pages give an empty text; malformed markup is read as far
    as it goes: an unclosed tag or comment ends with the page. Pages that repeat give the same; a column of pages named
    like the new one is replaced.
    Pages of any length are read whole, one at a time.
    """
    base = pages.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != column]
            texts = [main_text(p.as_py() or "") for p in batch.column(html)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, column])

    return base.mapInArrow(run, plus(base, column, "string"))


def op9_tag_path_ratios(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages, column="text").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
