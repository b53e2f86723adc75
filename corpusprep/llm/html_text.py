"""Main text of web pages by tag-path ratios.

Text length and punctuation are summed for every root-to-leaf tag path of a page.  Each text
block carries the ratios of its path (characters and punctuation a node); the ratios are smoothed
along the page, fused, and paths above the mean threshold are content.  The article is found from the
root down along the elements with most of the content's weight; what stands beside them stays where it is
a heading, running text or on content paths, and all blocks of an ``article`` do, but for menus, notices
and the like and runs of short links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and attribute names of HTML and of common page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img".split()
)
DROPPED = frozenset(
    "head nav footer aside form button select option textarea iframe object svg canvas dialog menu audio video map "
    "noscript template fieldset title".split()
)
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption summary address".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"thead", "tbody"},
}
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs masthead footer cookie cookies consent notice notification gdpr popup modal "
    "overlay newsletter subscribe subscription signup comment comments disqus reply replies respond related recommended "
    "recommendations share sharing social widget toolbar login search pagination pager copyright disclaimer skip hidden "
    "alert".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RUNNING = HEADINGS | frozenset("p blockquote pre figure table ul ol dl".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
# Of them, words that win over layout words in the same slug, but for "has-sidebar" and the like.
PLAIN = frozenset(
    "comment comments disqus reply replies respond footer sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie "
    "cookies gdpr newsletter".split()
)
BESIDE = frozenset("has with no without layout".split())
CONTENT = frozenset("content article main post entry story page wrapper container layout body text with has".split())

# A tag ends at the first ">" outside a quoted value; a quote without a second one is no quote.
_ATTRIBUTES = r"(?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+"
_COMMENT = r"!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/(?![a-zA-Z])[^>]*+(?:>|\Z)"
_TOKEN = re.compile(rf"<(?:(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|{_COMMENT}|(/?[a-zA-Z]))", re.S)
# For the rest of a page where a tag has no such end.
_PLAIN_TOKEN = re.compile(rf"<(?:(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|{_COMMENT})", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in "script style textarea title iframe xmp noembed".split()}
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")


KEPT, DOUBTFUL, NAMED, GONE = range(4)  # an element's marks, the strongest of it and those around it


def _mark(tag: str, attributes: str, inside_article: bool) -> int:
    """What an element's attributes say: ``GONE`` for hidden parts and roles, ``NAMED`` for a slug that
    plainly names furniture, ``DOUBTFUL`` for one that has a word of it."""
    mark = KEPT
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return GONE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return GONE
        if name == "role" and value.lower() in ROLES:
            return GONE
        if name == "class" or name == "id" and tag not in HEADINGS:
            for word in value.split():
                parts = {p.lower() for p in _PARTS.findall(word)}
                if parts & PLAIN and not parts & BESIDE:
                    # An id is often made from a heading: there a word that is neither leaves doubt.
                    mark = max(mark, NAMED if name == "class" or parts <= FURNITURE | CONTENT else DOUBTFUL)
                elif parts & FURNITURE and not parts & CONTENT and not parts & BESIDE:
                    mark = max(mark, NAMED if name == "class" and parts <= FURNITURE else DOUBTFUL)
                elif not inside_article and "header" in parts and not parts & CONTENT:
                    mark = max(mark, NAMED)
    return mark


class Page:
    """Blocks of a page in order, each with its path, element, text and links, and the elements' marks.

    A path is a number, made from its parent's and a tag.  An open element's stack entry holds what texts
    inside it need, so that the time is linear in the page, however deep its elements lie.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.mark = [-1], ["#"], [KEPT]
        self.marked = [0]  # the innermost marked element from each one outwards, 0 for none
        self.blocks: list[dict] = []
        self._paths: dict[tuple[int, str], int] = {}
        # Element, path, stack place of the innermost element that is no inline one, inside an article, inside a link.
        self._stack = [(0, 0, 0, False, False)]
        self._places: dict[str, list[int]] = {}  # of each tag's open elements in the stack
        self._open: dict | None = None
        self._n_blocks = 0
        self._scan(source)
        self._flush()

    def _scan(self, source: str) -> None:
        at, token, endless = 0, _TOKEN, set()
        while found := token.search(source, at):
            if found.start() > at:
                self._text(source[at : found.start()])
            if token is _TOKEN and found[4]:
                at, token = found.start(), _PLAIN_TOKEN
                continue
            at = found.end()
            if not found[2]:
                continue
            tag = found[2].lower()
            if found[1]:
                self._close(tag)
                continue
            if tag in _RAW_END and tag not in endless:
                end = _RAW_END[tag].search(source, at)
                if end or tag in ("script", "style"):
                    at = end.start() if end else len(source)
                    continue
                endless.add(tag)
            self._begin(tag, found[3])
        if at < len(source):
            self._text(source[at:])

    def _flush(self, whole: bool = True) -> None:
        """Ends the open block, or only its part before a change of marks."""
        if self._open is not None:
            block, self._open = self._open, None
            raw = "".join(block["text"])
            block["text"] = " ".join(raw.split())
            block["spaced"] = raw[:1].isspace(), raw[-1:].isspace()
            if block["text"]:
                self.blocks.append(block)
        self._n_blocks += whole

    def _text(self, raw: str) -> None:
        element, path, outer, _, linked = self._stack[-1]
        marked = self.marked[element]
        text = html.unescape(raw) if "&" in raw else raw
        if self._open is not None and marked != self._open["marked"]:
            self._flush(whole=False)
        if self._open is None:
            if not text or text.isspace() and not (self.blocks and self.blocks[-1]["block"] == self._n_blocks):
                return
            holder = self._stack[outer][0]
            self._open = {"text": [], "path": path, "element": holder, "marked": marked, "linked": 0, "block": self._n_blocks}
        self._open["text"].append(text)
        if linked:
            self._open["linked"] += len(text.strip())

    def _pop(self, to: int) -> None:
        for element, *_ in reversed(self._stack[to:]):
            self._places[self.tag[element]].pop()
        del self._stack[to:]

    def _begin(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "br":
                if self._open is not None:
                    self._open["text"].append(" ")
                return
        else:
            self._flush()
            if tag == "body":  # ends the head, whether or not that was closed
                for head in ("head", "title"):
                    if self._places.get(head):
                        self._pop(self._places[head][0])
            # A new block ends an open paragraph; items end their like in the same list or table.
            ends = CLOSES.get(tag, ())
            at = self._stack[-1][2]
            while at > 0:
                open_tag, before = self.tag[self._stack[at][0]], self._stack[at - 1][2]
                if open_tag == "p" or open_tag in ends:
                    self._pop(at)
                    if open_tag == "p" and not ends:
                        break
                elif not (ends and open_tag in ("td", "th", "dd", "dt")):
                    break
                at = before
        if tag in VOID:
            return
        element, path, outer, article, linked = self._stack[-1]
        article = article or tag in ("article", "main")
        mark = KEPT
        if tag not in ("html", "body", "main", "article"):
            mark = GONE if tag in DROPPED or tag == "header" and not article else _mark(tag, attributes, article) if attributes else KEPT
        new = len(self.tag)
        self.parent.append(element)
        self.tag.append(tag)
        self.mark.append(mark)
        self.marked.append(new if mark else self.marked[element])
        path = self._paths.setdefault((path, tag), len(self._paths) + 1)
        place = len(self._stack)
        self._places.setdefault(tag, []).append(place)
        self._stack.append((new, path, outer if tag in INLINE else place, article, linked or tag == "a"))

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        places = self._places.get(tag)
        # An inline element is ended inside its block only.
        if places and (tag not in INLINE or places[-1] > self._stack[-1][2]):
            self._pop(places[-1])


def path_scores(blocks: list[dict]) -> np.ndarray:
    """The fused, smoothed ratio of each block's path."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b["path"], [0, 0, 0])
        s[0] += max(0, len(b["text"]) - 2 * b["linked"])
        s[1] += len(_PUNCTUATION.findall(b["text"]))
        s[2] += 1
    text = np.array([sums[b["path"]][0] / sums[b["path"]][2] for b in blocks])
    marks = np.array([sums[b["path"]][1] / sums[b["path"]][2] for b in blocks])
    kernel = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    smooth = lambda x: np.convolve(np.pad(x, 2), kernel, "valid") / np.convolve(np.pad(np.ones(len(x)), 2), kernel, "valid")
    return np.sqrt(smooth(text) * (1 + smooth(marks)) * text)


def unmarked(page: Page) -> list[dict]:
    """The blocks outside of furniture.

    A slug that names furniture counts unless its element has four fifths of the page's text.  A
    doubtful one counts unless its element has a twentieth of the text, half of that or more on
    paths above the mean ratio.
    """
    outer = lambda e: page.marked[page.parent[e]]
    furniture = [e for e in range(1, len(page.tag)) if page.mark[e]]  # outer ones come first

    def outside(blocks: list[dict], gone: set[int]) -> list[dict]:
        for e in furniture:
            if outer(e) in gone:
                gone.add(e)
        return [b for b in blocks if b["marked"] not in gone]

    blocks = outside(page.blocks, {e for e in furniture if page.mark[e] == GONE})
    if not any(b["marked"] for b in blocks):
        return blocks
    own = lambda b: max(0, len(b["text"]) - b["linked"])

    def without(blocks: list[dict], mark: int, released) -> list[dict]:
        sums = {e: np.zeros(2) for e in furniture}
        score = path_scores(blocks)
        for b, high in zip(blocks, score >= score.mean() if len(score) else []):
            if b["marked"]:
                sums[b["marked"]] += [own(b), own(b) * high]
        for e in reversed(furniture):
            if outer(e):
                sums[outer(e)] += sums[e]
        whole = sum(map(own, blocks))
        return outside(blocks, {e for e in furniture if page.mark[e] == mark and not released(*sums[e], whole)})

    blocks = without(blocks, NAMED, lambda text, above, whole: text > 0.8 * whole)
    return without(blocks, DOUBTFUL, lambda text, above, whole: text >= 0.05 * whole and text > 0 and above >= 0.5 * text) if blocks else []


def link_runs(blocks: list[dict]) -> list[bool]:
    """Whether each block is of a run of three or more blocks, over 60 % links each, on one path whose
    sums are low: under 25 characters a block, links included, and under one mark for two blocks."""
    sums: dict[int, list[int]] = {}
    for b in blocks:
        s = sums.setdefault(b["path"], [0, 0, 0])
        s[0] += len(b["text"])
        s[1] += len(_PUNCTUATION.findall(b["text"]))
        s[2] += 1
    low = {path for path, (text, marks, n) in sums.items() if text < 25 * n and 2 * marks < n}
    out: list[bool] = []
    key = lambda b: b["path"] if b["path"] in low and b["linked"] > 0.6 * len(b["text"]) else None
    for path, run in groupby(blocks, key):
        n = len(list(run))
        out += [path is not None and n >= 3] * n
    return out


def article_blocks(page: Page, blocks: list[dict]) -> list[dict]:
    """The blocks of the article.

    From the root down to the child with four fifths of the content's weight, until there is none or an
    ``article`` is reached.  What stands beside that child stays if its text is mostly on content paths.
    Below ``body``, headings, paragraphs and unlinked lists beside it stay too; at ``body`` headings do if
    the child has none of the first degree.  Outside of an ``article`` or ``main`` on this way, only
    such a heading stays.
    """
    score = path_scores(blocks)
    content = score >= score.mean() * 0.5
    n = len(page.tag)
    # Of each element and what is inside: weight, characters, those on content paths, those of links, top headings.
    sums = np.zeros((n, 5))
    for b, s, c in zip(blocks, score, content):
        size = len(b["text"])
        sums[b["element"]] += [s * c, size, size * c, b["linked"], page.tag[b["element"]] == "h1"]
    children: dict[int, list[int]] = {}
    for e in range(n - 1, 0, -1):
        sums[page.parent[e]] += sums[e]
        children.setdefault(page.parent[e], []).append(e)
    way = [0]
    while page.tag[way[-1]] != "article":
        heavy = [e for e in children.get(way[-1], ()) if sums[e, 0] >= 0.8 * sums[0, 0] and page.tag[e] not in TEXT_TAGS | INLINE]
        if not heavy:
            break
        way.append(heavy[0])
    named = next((i for i, e in enumerate(way) if page.tag[e] in ("article", "main")), 0)

    def beside(step: int, e: int) -> bool:
        """Whether an element beside the way stays."""
        inner = way[step + 1]
        _, size, on_paths, linked, _ = sums[e]
        if not size:
            return False
        if page.tag[e] in HEADINGS and not sums[inner, 4]:
            return True
        if step < named:
            return False
        if on_paths > 0.5 * size and linked < 0.5 * size:
            return True
        return page.tag[way[step]] not in ("#", "html", "body") and page.tag[e] in RUNNING and linked < 0.5 * size

    inside = np.zeros(n, bool)
    inside[way[-1]] = True
    own_text = set()  # elements of the way whose own text stays
    for step, e in enumerate(way[:-1]):
        for other in children[e]:
            if other != way[step + 1]:
                inside[other] = beside(step, other)
        if step >= named and page.tag[e] not in ("#", "html", "body"):
            own_text.add(e)
    on_way = set(way[:-1])
    for e in range(1, n):
        if page.parent[e] not in on_way:
            inside[e] |= inside[page.parent[e]]
    loose = lambda b, c: b["element"] in own_text or b["element"] in on_way and c and not named
    return [b for b, c in zip(blocks, content) if inside[b["element"]] or loose(b, c)]


def main_blocks(source: str) -> list[str]:
    """The article's blocks in page order."""
    page = Page(source)
    blocks = unmarked(page)
    if not blocks:
        return []
    blocks = article_blocks(page, blocks)
    blocks = [b for b, menu in zip(blocks, link_runs(blocks)) if not menu]
    out: list[str] = []
    for before, b in zip([None, *blocks], blocks):
        if before is not None and before["block"] == b["block"]:  # a marked part between them went
            out[-1] += (" " if before["spaced"][1] or b["spaced"][0] else "") + b["text"]
        else:
            out.append(b["text"])
    return out


def main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """Adds ``main_text`` and ``n_blocks`` to every row.

    The blocks of the article, character references decoded, white space inside a block one space,
    joined by one line feed.  Null, empty and textless pages give the empty string; a page of plain
    text is one block.  Columns of these names are replaced, others stay whatever their names.
    """
    others = [c for c in pages.columns if c not in ("main_text", "n_blocks")]
    names = [f"_c{i}" for i in range(len(others))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [main_blocks(x) if x else [] for x in part.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.select(names).columns, pa.array(["\n".join(b) for b in found], pa.string()), pa.array([len(b) for b in found], pa.int64())],
                    names=[*names, "main_text", "n_blocks"],
                )

    slim = pages.select(*[pages[c].alias(n) for c, n in zip(others, names)], pages[column].alias("_html"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    made = slim.mapInArrow(work, f"{schema}, main_text string, n_blocks bigint")
    return made.withColumnsRenamed(dict(zip(names, others)))
