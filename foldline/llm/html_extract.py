"""Main text of web pages by tree scoring.

A page becomes a tree (void elements, omitted end tags of the block elements, raw text of
scripts and styles, comments).  Elements that never hold an article's text (navigation, forms,
scripts and the like, hidden ones) are taken out.  Each paragraph gives 1 point, 1 for each
comma and 1 for each 100 characters up to 3, to its parent and half of that to its
grandparent.  What lies in a box whose class or id names an advert, a notice, a side bar,
comments and the like (whole names) counts LIGHT only, unless the box holds most of the
page's text.  A container's points are discounted by its link density.  The best container (of equals the
first) is kept, with those of its siblings that score a fifth as well or are paragraphs of their own
weight; inside, light boxes and lists and boxes that are mostly links are dropped.  Where that
leaves little, names count for nothing but comments, and then not at all.  A page that marks
its article (one ``article`` or ``main`` element with most of the points) has that as its
container.

Text is joined by block: character references decoded, white space in a block turned into
one space, blocks joined by one space.

The parser looks at each character a bounded number of times: what a tag closes is found from
the places of open elements by name, not by walking up, and a search that once met the page's
end is not made again.  So broken and very long pages take time in proportion to their length.

Defined results: null and empty pages, and pages without text outside what is dropped,
give the empty string.  A tag that never ends is text, so is a ``<`` that begins none.  A quote
that is never closed does not hide the tag's end.  Rows that repeat a page are extracted
each; an empty table gives an empty result.  Columns besides the page and the named keys are
not read, whatever their names.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea title canvas audio video select".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("br body html li dd dt td th tr tbody thead tfoot summary legend figcaption".split())
DROPPED = frozenset("head nav footer aside form button dialog menu fieldset label".split())
#: What gives points, and which of it holds its own text's points.
PARAGRAPHS = frozenset("p pre td blockquote li div section article main".split())
BOXES = frozenset("div section article main".split())
#: An element that ends open ones of these names, up to the named container.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_COMMENTS = r"comments?|commentlist|disqus|replies|respond"
_OTHERS = (
    r"ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|rail|widget|related|recommended|trending|popular|share|sharing|social|footer|masthead|site-?header|page-?header|pagination|pager|tags?|skip|toolbar|search|copyright|legal|disclaimer"
)
_BEFORE, _AFTER = r"site|page|post|entry|article|main|global|primary|secondary|left|right|top|bottom", r"list|box|bar|area|links?|buttons?|posts|items?|left|right|top|bottom|form|section|container|wrapper|wrap"
#: A class or id of such words only, with their places or forms and a number ("cookie-banner",
#: "site-nav", "ad-1"); "has-sidebar" or "tag-python" say something about other things.
UNLIKELY, COMMENTS = (re.compile(rf"(?:(?:{_BEFORE})[_-])?(?:{words})(?:[_-](?:{_COMMENTS}|{_OTHERS}|{_AFTER}))*[_-]?\d*", re.I) for words in (_OTHERS, _COMMENTS))
#: What a paragraph's points count inside a box named so.
LIGHT = 0.02
#: Without an article or main element elsewhere, a box named so counts in full all the same if it holds
#: more than MOST of the page's text outside links and comments; a result of less than LEAST of it is tried again.
MOST, LEAST = 0.5, 0.25
UNLIKELY_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form".split())
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: Up to a tag's end or to a quoted value in it.
_INNER = re.compile(r"[^>=]*+(?:>|=\s*+[\"']?)")
_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
_ATTR = re.compile(r"""(?<![^\s/"'>])([^\s=/>"']++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")
#: An end tag of an element that is no block does not reach beyond these.
LIMITS = frozenset("p li td div article section".split())


class Node:
    __slots__ = ("name", "parent", "kids", "points", "attrs", "weight", "chars", "linked", "commas", "own_chars", "own_commas")

    def __init__(self, name: str, parent: Node | None, attrs: dict[str, str]):
        self.name, self.parent, self.attrs = name, parent, attrs
        self.kids: list[Node | str] = []
        self.weight = 1.0
        self.points, self.chars, self.linked, self.commas, self.own_chars, self.own_commas = 0.0, 0, 0, 0, 0, 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if "=" in text else {}


class _Open:
    """The open elements, outermost first, and their depths by name, of blocks and of LIMITS."""

    def __init__(self):
        self.stack, self.by, self.blocks, self.limits = [Node("#root", None, {})], {}, [0], [0]

    def push(self, n: Node) -> None:
        depth = len(self.stack)
        self.stack.append(n)
        self.by.setdefault(n.name, []).append(depth)
        if n.name in BLOCK:
            self.blocks.append(depth)
        if n.name in LIMITS:
            self.limits.append(depth)

    def cut(self, depth: int) -> None:
        """Ends the element of that depth and all inside it."""
        while len(self.stack) > depth:
            self.by[self.stack.pop().name].pop()
        for places in (self.blocks, self.limits):
            while places[-1] >= depth:
                places.pop()

    def end_tag(self, name: str) -> None:
        places = self.by.get(name)
        if places and (name in BLOCK or places[-1] > self.limits[-1]):
            self.cut(places[-1])

    def start_tag(self, name: str) -> None:
        """Ends what the element's start tag ends."""
        if name in CLOSES_P:
            if self.stack[self.blocks[-1]].name == "p":
                self.cut(self.blocks[-1])
        elif name in ENDS:
            ended, within = ENDS[name]
            floor = max((self.by[x][-1] for x in within if self.by.get(x)), default=0)
            found = [places[i] for x in ended if (places := self.by.get(x)) and (i := bisect_right(places, floor)) < len(places)]
            if found:
                self.cut(min(found))


class _Tags:
    """Finds tags from left to right."""

    def __init__(self, page: str):
        self.page, self.last, self.unquoted, self.endless = page, page.rfind(">"), False, set()

    def close(self, at: int) -> int:
        """Where a tag ends (its ``>``) whose name ends at ``at``; quoted values are passed over
        as long as all quotes on the way are closed."""
        page, i = self.page, at
        while not self.unquoted:
            m = _INNER.match(page, i)
            if m is None:
                self.unquoted = True
            elif m[0][-1] == ">":
                return m.end() - 1
            elif m[0][-1] in "\"'":
                i = page.find(m[0][-1], m.end()) + 1
                self.unquoted = not i
            else:
                i = m.end()
        return page.find(">", at)

    def raw_end(self, name: str, at: int) -> int:
        """Where the raw text of an element that begins at ``at`` ends, -1 if it does not."""
        m = None if name in self.endless else _END[name].search(self.page, at)
        if m is None:
            self.endless.add(name)
            return -1
        return m.end()


def parse(page: str) -> Node:
    """The page's tree; names in lower case, text as it stands."""
    tags, open_ = _Tags(page), _Open()
    done = at = 0
    while (begin := page.find("<", at)) >= 0:
        m = None
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4) + 3
            end = end if end > 2 else len(page)
        elif begin > tags.last:
            at = begin + 1
            continue
        elif page[begin + 1] in "!?":
            end = page.find(">", begin) + 1
        elif m := _NAME.match(page, begin + 1):
            end = tags.close(m.end()) + 1
        else:
            at = begin + 1
            continue
        if begin > done:
            open_.stack[-1].kids.append(page[done:begin])
        done = at = end
        if m is None:
            continue
        name, inner = m[0].lower(), page[m.end() : end - 1]
        if name[0] == "/":
            open_.end_tag(name[1:])
            continue
        open_.start_tag(name)
        new = Node(name, open_.stack[-1], _attributes(inner))
        new.parent.kids.append(new)
        if name in RAW:
            stop = tags.raw_end(name, end)
            done = at = stop if stop >= 0 else end if inner.endswith("/") else len(page)
        elif name not in VOID and not inner.endswith("/"):
            open_.push(new)
    if page[done:]:
        open_.stack[-1].kids.append(page[done:])
    return open_.stack[0]


def _unlikely(n: Node, in_article: bool) -> bool:
    if n.name in RAW or n.name in DROPPED or n.name in VOID and n.name != "br":
        return True
    if n.name in ("html", "body", "article", "main"):
        return False
    if n.name == "header" and not in_article:  # an article's is kept for its headings
        return True
    a = n.attrs
    return bool(a) and ("hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in UNLIKELY_ROLES or "display:none" in a.get("style", "").replace(" ", "").lower())


def _named(n: Node) -> str:
    """What class and id say of an element: "comments", "unlikely" or nothing."""
    if not n.attrs or n.name in ("html", "body", "article", "main"):
        return ""
    given = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".split()
    return "comments" if any(map(COMMENTS.fullmatch, given)) else "unlikely" if any(map(UNLIKELY.fullmatch, given)) else ""


def _walk(root: Node, light: tuple[str, ...]) -> tuple[list[Node], float]:
    """All elements but the unlikely ones (these are cut off), in page order, with the weight
    that their boxes' names give them; and the characters outside links and comments if any
    weighs less and no article is marked outside, else 0."""
    out, stack = [], [(root, False)]
    while stack:
        n, in_article = stack.pop()
        out.append(n)
        in_article = in_article or n.name in ("article", "main")
        n.kids = [k for k in n.kids if isinstance(k, str) or not _unlikely(k, in_article)]
        stack += [(k, in_article) for k in reversed(n.kids) if not isinstance(k, str)]
    named = {id(n): what for n in out if (what := _named(n)) in light and what}
    if not named:
        return out, 0
    size: dict[int, int] = {}
    for n in reversed(out):
        own = sum(len(k.strip()) if isinstance(k, str) else size[id(k)] for k in n.kids)
        size[id(n)] = 0 if n.name == "a" or named.get(id(n)) == "comments" else own
    inside: set[int] = set()
    for n in out:
        if id(n) in named or n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
    # A page that marks its article elsewhere needs nothing of what is named.
    marked = any(n.name in ("article", "main") and id(n) not in inside and size[id(n)] for n in out)
    whole = 0 if marked else size[id(root)]
    some = False
    for n in out:
        n.weight = n.parent.weight if n.parent is not None else 1.0
        if id(n) in named and not (whole and named[id(n)] == "unlikely" and size[id(n)] > whole * MOST):
            n.weight *= LIGHT
            some = True
    return out, whole if some else 0


def _blocks(n: Node) -> list[str]:
    """The texts of a subtree's blocks, in page order."""
    out, held = [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(text)

    stack: list = [n]
    while stack:
        k = stack.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            held.append(k)
        else:
            if k.name in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(k.kids)
    flush()
    return out


def _density(n: Node) -> float:
    return n.linked / n.chars if n.chars else 0.0


def main_text(page: str | None) -> str:
    """The page's main text (see the module's text)."""
    if not page:
        return ""
    text, whole = _scored(page, ("comments", "unlikely"))
    if whole and len(text) < whole * LEAST:
        text = max(text, _scored(page, ("comments",))[0], key=len)
    return text or _scored(page, ())[0]


def _scored(page: str, light: tuple[str, ...]) -> tuple[str, float]:
    """The best container's text if boxes of such names weigh little, and _walk's measure."""
    root = parse(page)
    nodes, total = _walk(root, light)
    for n in reversed(nodes):
        for k in n.kids:
            if isinstance(k, str):
                size, commas = len(k.strip()), k.count(",")
                n.own_chars += size
                n.own_commas += commas
            else:
                size, commas = k.chars, k.commas
                n.linked += k.linked
                if k.name not in BLOCK:
                    n.own_chars += k.own_chars
                    n.own_commas += k.own_commas
            n.chars += size
            n.commas += commas
        if n.name == "a":
            n.linked = n.chars
    scored: list[Node] = []
    for n in nodes:
        if n.name in PARAGRAPHS and n.parent is not None:
            box = n.name in BOXES
            chars, commas = (n.own_chars, n.own_commas) if box or n.name in ("td", "li", "blockquote") else (n.chars, n.commas)
            if not chars or box and chars < 25:
                continue
            points = (1 + commas + min(chars // 100, 3)) * (1 - _density(n)) * n.weight
            holder = n if box else n.parent
            for up, share in ((holder, 1.0), (holder.parent, 0.5)):
                if up is not None:
                    if not up.points:
                        scored.append(up)
                    up.points += points * share
    if not scored:
        return " ".join(_blocks(_pruned(root, False))), total
    final = {id(n): n.points * (1 - _density(n)) for n in scored}
    best = max((n for n in nodes if id(n) in final), key=lambda n: final[id(n)])
    marked = [n for n in nodes if n.name == "article"] or [n for n in nodes if n.name == "main"]
    if marked:
        whole = max(marked, key=lambda n: n.chars)
        up = best
        while up is not None and up is not whole:
            up = up.parent
        if up is whole or whole.chars * 2 > best.chars:
            best = whole
    keep = [best]
    if best.name not in ("article", "main") and best.parent is not None:
        bar = max(10.0, final.get(id(best), 0.0) * 0.2)
        keep = []
        for k in best.parent.kids:
            if isinstance(k, str):
                continue
            if k is best or final.get(id(k), 0.0) >= bar or k.name == "p" and k.chars > 80 and _density(k) < 0.25 or k.name in ("h1", "h2") and _density(k) < 0.25:
                keep.append(k)
    return " ".join(t for k in keep if k.weight >= best.weight for t in _blocks(_pruned(k, True))), total


def _pruned(top: Node, links: bool) -> Node:
    """top without the light boxes in it, nor (links) lists and boxes that are mostly links."""
    stack = [top]
    while stack:
        n = stack.pop()
        n.kids = [k for k in n.kids if isinstance(k, str) or not (k.weight < top.weight or links and k.name in ("ul", "ol", "div", "section", "table") and k.linked and _density(k) > 0.5)]
        stack += [k for k in n.kids if not isinstance(k, str)]
    return top


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x) for x in b.column("html").to_pylist()]
        keep = [i for i, f in enumerate(b.schema) if f.name != "html"]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(b.schema[i].name for i in keep), "text", "n_chars"])


def extract(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """The ``keys`` columns, text and n_chars (its code points) of every page."""
    rows = pages.select(*keys, F.col(html_col).cast("string").alias("html"))
    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "html")
    return rows.mapInArrow(_extract, f"{shape}text string, n_chars long")
