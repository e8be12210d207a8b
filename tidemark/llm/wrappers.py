"""HTML extraction by union-free wrappers, inferred for each host (operator 1).

A page becomes a tree of tokens: elements (tag with class and id, names with digits dropped) and text. Pages of a host
are aligned one after another with the host's wrapper so far. Where they differ, the mismatch is resolved without
unions: text that differs becomes a slot, elements on one side only become optional, and neighbours (or runs of up to
four elements) that repeat become one repeated group. Parts of one tag and name (bare divs, say) are neighbours of one
group, or are aligned, only if they hold like elements. Each part of the wrapper knows how much text and linked text it
holds over all pages, and each text the few strings that are frequent there, so template words are known within a
repeated group, too. Partial wrappers of parts of a host are merged by the same alignment, so a host of any size is
spread over tasks and every task holds one wrapper at a time; a part with very many different optional children
(generated class names) is generalised to one repeated group a tag, which bounds the wrapper.

From a finished wrapper one region is the article: the smallest part that holds the text that varies from page to page
and isn't linked, with its headings. ``article`` and ``main`` elements decide where they hold at least half of that
text, or where a host has too few pages to compare. What is around an article is known by tag and role, and by class
and id names that consist of such words; a name is overruled if most of the host's varying text is within. Each page is
aligned with its host's wrapper, and the text of the region is taken, whole, but for notices that open or close the
region: short strings that say so (share bars, calls to subscribe) and stand there on most pages of the host. A string
that only repeats (a line of the author, a desk's name) stays, on hosts of any size.

Results defined for odd input: null html gives empty text; a null or odd url belongs to the host ''; null and
repeated page_ids are extracted row by row; a page whose text is mostly links and where nothing is called an article
(an index) has none and gives empty text; broken markup never fails and loses no text (unclosed elements end with
their parent, elements nested deeper than DEEPEST count as that deep, a tag or comment that the page doesn't close is
text or lasts to its end, as in browsers); a page of any length is read whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, materialize, read_table

#: A comment, declaration or tag; attributes may hold '>' in quotes.
TOKEN = re.compile(r"<!---?>|<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
#: Tags with an unclosed quote, after which quotes in tags no longer count on a page.
MOST_UNCLOSED = 100
#: Their content is no markup.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
ATTRIBUTE = re.compile(r"""(?<![\w:-])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FOREIGN = {"svg", "math"}
#: Elements that end a paragraph, and those that bound a block of text; all others, also unknown ones, run on.
ENDS_P = {"address", "article", "aside", "blockquote", "body", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul", "dt", "dd"}
BLOCK = ENDS_P | {"html", "head", "br", "tr", "td", "th", "caption", "thead", "tbody", "tfoot", "option", "optgroup", "legend", "video", "audio", "picture", "frame", "frameset", "textarea", "title"} | {"noscript", "template", "canvas", "object", "select", "iframe"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag of the key ends these open elements.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: ... which stay open beyond these.
BARRIER = {"ul", "ol", "dl", "table", "tbody", "thead", "div", "article", "section", "main", "body", "nav", "aside", "footer", "header", "form"}
AROUND_TAGS = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset", "noscript", "template", "svg", "canvas", "object", "select", "datalist"} | RAW
AROUND_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
#: A class or id names something around the article if it has a word of these ...
AROUND_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "sidebar", "rail", "menu", "nav", "navbar", "navigation",
    "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "social", "share", "sharing",
    "related", "recommended", "recommendations", "comment", "comments", "disqus", "respond", "reply", "replies", "footer", "widget", "toolbar", "pagination", "pager", "login", "search", "copyright", "skip",
}
#: ... and no word but these besides.
NEUTRAL_WORDS = {"area", "article", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "container", "content", "float", "form", "global", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "news", "page", "panel", "post", "posts", "right", "section", "site", "slot", "stories", "text", "thread", "top", "unit", "wrap", "wrapper"}
COMMENT_WORDS = {"comment", "comments", "disqus", "respond", "reply", "replies"}
HEAD_WORDS = {"header", "masthead", "topbar", "head"}
#: A short block at an end of the article that most pages of a host have is a notice if it has one of these words.
CALL_WORDS = {"share", "subscribe", "newsletter", "advertisement", "cookies", "login", "signup", "follow", "print", "comment", "comments", "related"}
MOST_CALL = 8
DEEPEST = 200
#: Parts of one sig are told apart by what they hold: neighbours are one group from ALIKE, parts of two pages may be aligned from MEET.
PARTS = {"div", "section", "article", "main", "aside", "header", "footer", "nav", "form", "center"}
ALIKE, MEET = 0.6, 0.3
WRAPPERS = "host string, wrapper string"
#: Wrappers go to every task while all of them together are this small, else by a join on the host; what comes out is the same.
MOST_BROADCAST = 8 << 20
#: Pages from which a host can be compared; part of them that a template string is on at least; part of a region's text that varies if its pages are different articles.
TEMPLATE_PAGES, TEMPLATE_PART, VARYING_PART = 3, 0.6, 0.8
#: Frequent strings that a text of a wrapper remembers, and children of a wrapper's part before they are generalised.
OFTEN, MOST_KIDS = 32, 200
HOST = r"^[a-zA-Z][a-zA-Z0-9_+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)"


class Node:
    """An element or text of a page or wrapper. ``n`` pages (or repeats) were seen, with ``chars`` of text, ``linked`` of it in links; ``often``: frequent strings of a text, by hash."""

    __slots__ = ("sig", "kind", "kids", "n", "chars", "linked", "optional", "repeated", "text", "often", "held")

    def __init__(self, sig: str, kind: str = "", kids=None, n=1, chars=0, linked=0, optional=False, repeated=False, text=None, often=None):
        self.sig, self.kind, self.kids, self.n, self.chars, self.linked = sig, kind, kids if kids is not None else [], n, chars, linked
        self.optional, self.repeated, self.text, self.often, self.held = optional, repeated, text, often, None

    @property
    def tag(self) -> str:
        return self.sig.partition(".")[0]

    def dump(self):
        """As lists; strings that can't be frequent any more are left out."""
        if self.often is not None and self.n > 4 * OFTEN:
            self.often = {h: n for h, n in self.often.items() if n > self.n // (4 * OFTEN)}
        return [self.sig, self.kind, self.n, self.chars, self.linked, int(self.optional) + 2 * int(self.repeated), self.text, self.often, [k.dump() for k in self.kids]]

    @classmethod
    def load(cls, x):
        return cls(x[0], x[1], [cls.load(k) for k in x[8]], x[2], x[3], x[4], bool(x[5] & 1), bool(x[5] & 2), x[6], x[7])


def string_hash(text: str) -> str:
    """A hash of a string, and its length."""
    return f"{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=6).hexdigest()}.{len(text)}"


def _around(name: str) -> bool:
    words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)}
    return bool(words & AROUND_WORDS) and words <= AROUND_WORDS | NEUTRAL_WORDS


def _element(tag: str, attributes: str) -> Node:
    """kind: 'x' around the article by tag or role, 'c' by its names, 'h' a page's head part unless within the article, 'a' article, 'm' main, '' any other."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = f"{found.get('class', '')} #{found.get('id', '')}".split() if found.get("id") else found.get("class", "").split()
    role, kind = found.get("role", "").lower(), ""
    if tag in ("html", "body"):
        pass
    elif tag in AROUND_TAGS or role in AROUND_ROLES or ("hidden" in found and tag != "a") or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        kind = "x"
    elif any(map(_around, names)):
        kind = "c"
    elif tag == "article" or role == "article" or found.get("itemprop", "").lower() == "articlebody":
        kind = "a"
    elif tag == "main" or role == "main":
        kind = "m"
    elif tag == "header" or any({w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", x)} & HEAD_WORDS for x in names):
        kind = "h"
    return Node(".".join([tag, *sorted({x for x in names if not re.search(r"\d", x)}), *([f"!{kind}"] if kind else [])]), kind)


def parse(page: str) -> Node:
    """The tree of a page; text stands as nodes of sig '#'."""
    root = Node("")
    stack: list[tuple[str, Node]] = [("", root)]
    at = unclosed = 0

    def put(raw: str) -> None:
        if raw:
            stack[-1][1].kids.append(Node("#", text=" " if raw.isspace() else html_lib.unescape(raw)))

    look = 0
    while (i := page.find("<", look)) >= 0:
        m = TOKEN.match(page, i) if unclosed < MOST_UNCLOSED else LOOSE.match(page, i)
        if m is None:
            if page.find(">", i) < 0:
                break
            if (m := LOOSE.match(page, i)) is not None:
                unclosed += 1
        if m is None:
            look = i + 1
            continue
        put(page[at:i])
        at = look = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1][1].kids.append(Node("#", text=m[0][9:].removesuffix("]]>")))
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in BARRIER and (tag not in BLOCK or tag in ("p", "li")):
                    break
            continue
        ended = ENDS.get(tag) or ({"p"} if tag in ENDS_P else None)
        if ended:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ended:
                    del stack[k:]
                    break
                if stack[k][0] in BARRIER:
                    break
        node = _element(tag, m[3] or "")
        stack[-1][1].kids.append(node)
        if tag in RAW:  # to its end tag, or the page's end
            end = RAW_END[tag].search(page, at)
            at = look = len(page) if end is None else end.start()
        elif tag not in VOID and not ((m[3] or "").endswith("/") and (tag in FOREIGN or stack[-1][0] in FOREIGN)):
            stack.append((tag, node if len(stack) < DEEPEST else stack[-1][1]))
    put(page[at:])
    return root


def _holds(node: Node) -> frozenset[str]:
    """What a part mostly holds, two levels deep: tags of blocks, links and text, however often; the same for a page and its wrapper."""
    if node.held is None:

        def kept(of: Node) -> list[Node]:
            return [k for k in of.kids if (k.text is None or not k.text.isspace() if k.sig == "#" else k.tag == "a" or k.tag in BLOCK - VOID) and 2 * k.n >= of.n]

        node.held = frozenset(x for k in kept(node) for x in (k.tag, *(f"{k.tag} {c.tag}" for c in kept(k))))
    return node.held


def likeness(a: Node, b: Node) -> float:
    """1 for parts that hold the same, 0 for parts that share nothing; other elements and texts of one sig are always alike."""
    if a.tag not in PARTS:
        return 1.0
    x, y = _holds(a), _holds(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def fold(page: Node) -> Node:
    """The page as a wrapper of its own: counts of text, neighbours that repeat as one group. A string counts once a page."""
    out = _fold(page, False)
    todo = [out]
    while todo:
        node = todo.pop()
        if node.often is not None:
            node.often = dict.fromkeys(node.often, 1)
        todo += node.kids
    return out


def _fold(node: Node, link: bool) -> Node:
    link = link or node.tag == "a"
    kids: list[Node] = []
    for k in node.kids:
        if k.sig == "#":
            text = " ".join(k.text.split())
            if not text:
                continue
            new = Node("#", chars=len(text), linked=len(text) if link else 0, text=text if len(text) <= 200 else None, often={string_hash(text): 1})
        else:
            new = _fold(k, link)
        if kids and kids[-1].sig == new.sig and likeness(kids[-1], new) >= ALIKE:
            kids[-1] = merge(kids[-1], new)
            kids[-1].repeated = True
        else:
            kids.append(new)
    for size in range(2, 5):
        if len(kids) < 2 * size:
            break
        i, kept, last = 0, [], len(kids) - size
        while i <= last:
            if i < size or kids[i].sig != kept[-size].sig:
                kept.append(kids[i])
                i += 1
                continue
            run = kids[i : i + size]
            if all(x.sig == y.sig and likeness(x, y) >= ALIKE for x, y in zip(kept[-size:], run, strict=True)):
                for j in range(size):
                    kept[j - size] = merge(kept[j - size], run[j])
                    kept[j - size].repeated = True
                i += size
            else:
                kept.append(kids[i])
                i += 1
        kids = kept + kids[i:]
    return Node(node.sig, node.kind, kids, 1, sum(k.chars for k in kids), sum(k.linked for k in kids))


def merge(a: Node, b: Node) -> Node:
    """Align two nodes of one sig."""
    often = None
    if a.often is not None and b.often is not None:
        often = dict(a.often)
        for h, n in b.often.items():
            often[h] = often.get(h, 0) + n
        if len(often) > 2 * OFTEN:  # counts may be too small by part of n, never too large
            cut = sorted(often.values(), reverse=True)[OFTEN]
            often = {h: n - cut for h, n in often.items() if n > cut}
    text = a.text if a.text == b.text else None
    return Node(a.sig, a.kind, align(a.kids, b.kids), a.n + b.n, a.chars + b.chars, a.linked + b.linked, a.optional or b.optional, a.repeated or b.repeated, text, often)


def _general(kids: list[Node]) -> list[Node]:
    """One optional, repeated group for each tag and kind, in order of their first."""
    found: dict[tuple[str, str], Node] = {}
    for k in kids:
        k.sig = k.sig if k.sig == "#" else f"{k.tag}.*{k.kind}"
        key = (k.sig, k.kind)
        found[key] = merge(found[key], k) if key in found else k
        found[key].optional = found[key].repeated = True
    return list(found.values())


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """Align two sequences by a longest common subsequence of sigs; what stands on one side only becomes optional. Parts whose sig is there more than once are aligned by what they hold."""
    general = {k.sig: i for i, k in enumerate(a) if ".*" in k.sig} | {k.sig: i for i, k in enumerate(b) if ".*" in k.sig}
    if general or len(a) > MOST_KIDS or len(b) > MOST_KIDS:
        if not general or any(k.sig != "#" and ".*" not in k.sig for k in (*a, *b)) or [k.sig for k in a] != [k.sig for k in b]:
            return _general([*a, *b])
    sa, sb = [k.sig for k in a], [k.sig for k in b]
    often = {s for side in (sa, sb) if len(set(side)) < len(side) for s, n in Counter(side).items() if n > 1 and s.partition(".")[0] in PARTS}

    def gain(x: Node, y: Node) -> float:
        """What aligning two elements of one sig is worth."""
        like = likeness(x, y) if x.sig in often else 1
        return like if like >= MEET else 0

    lo, hi, most = 0, 0, min(len(a), len(b))
    while lo < most and sa[lo] == sb[lo] and (not often or gain(a[lo], b[lo]) == 1):
        lo += 1
    while hi < most - lo and sa[-1 - hi] == sb[-1 - hi] and (not often or gain(a[-1 - hi], b[-1 - hi]) == 1):
        hi += 1
    head = [merge(x, y) for x, y in zip(a[:lo], b[:lo], strict=True)]
    tail = [merge(x, y) for x, y in zip(a[len(a) - hi :], b[len(b) - hi :], strict=True)]
    a, b, sa, sb = a[lo : len(a) - hi], b[lo : len(b) - hi], sa[lo : len(a) - hi], sb[lo : len(b) - hi]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    worth: dict[tuple[int, int], float] = {}
    for i in range(n - 1, -1, -1):
        row, under, sig = best[i], best[i + 1], sa[i]
        for j in range(m - 1, -1, -1):
            down, right = under[j], row[j + 1]
            row[j] = down if down >= right else right
            if sig == sb[j]:
                g = worth[i, j] = gain(a[i], b[j]) if often else 1
                if g and under[j + 1] + g > row[j]:
                    row[j] = under[j + 1] + g
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and worth.get((i, j)) and best[i][j] == best[i + 1][j + 1] + worth[i, j]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            a[i].optional = True
            out.append(a[i])
            i += 1
        else:
            b[j].optional = True
            out.append(b[j])
            j += 1
    return head + out + tail


def shape(wrapper: Node) -> str:
    """The wrapper as a union-free regular expression, for people and tests."""
    if wrapper.sig == "#":
        inner = "#SLOT" if wrapper.text is None else wrapper.text
    else:
        inner = f"<{wrapper.sig}>" + "".join(shape(k) for k in wrapper.kids)
    if wrapper.repeated:
        return f"({inner})" + ("*" if wrapper.optional else "+")
    return f"({inner})?" if wrapper.optional else inner


def _template(part: Node, pages: int) -> set[str]:
    """Hashes of the strings that a text of the wrapper has on most pages."""
    if pages < TEMPLATE_PAGES or part.often is None:
        return set()
    return {h for h, n in part.often.items() if n >= TEMPLATE_PART * pages}


def mark_region(wrapper: Node) -> None:
    """Set kind 'r' on the parts whose text is the article; their texts of kind 't' hold template strings (in ``often``)."""
    pages = wrapper.n

    def mass(node: Node, varying: bool = True, around: str = "xc") -> int:
        """Unlinked text, or of it what varies from page to page."""
        if node.kind and node.kind in around:
            return 0
        if node.sig == "#":
            known = sum(node.often[h] * int(h.partition(".")[2]) for h in _template(node, pages)) if varying else 0
            return max(node.chars - node.linked - known, 0)
        return sum(mass(k, varying, around) for k in node.kids)

    whole, vary = mass(wrapper, False, "x"), mass(wrapper, True, "x")
    varying = pages >= TEMPLATE_PAGES and vary > (1 - VARYING_PART) * whole  # else copies of few articles

    def find(node: Node, kind: str, below: str = "xc") -> list[Node]:
        if node.kind == kind:
            return [node]
        return [y for k in node.kids if not (k.kind and k.kind in below) for y in find(k, kind, below)]

    any_named = bool(find(wrapper, "a", "x") or find(wrapper, "m", "x"))

    def overrule(node: Node) -> None:
        """A name is no sign of what is around if it has the only article within, or most of a host's text where nothing is called an article."""
        for k in node.kids:
            if k.kind == "c" and not COMMENT_WORDS & {w.lower() for w in re.findall(r"[A-Za-z]+", k.sig)}:
                inner = sum(mass(c, varying, "x") for c in k.kids)
                all_of_it = vary if varying else whole
                within = find(Node("", kids=k.kids), "a", "x") or find(Node("", kids=k.kids), "m", "x")
                if (within and not find(wrapper, "a") and not find(wrapper, "m")) or (not any_named and inner * (2 if pages >= TEMPLATE_PAGES else 1.25) > all_of_it):
                    k.kind = ""
            if k.kind != "x":
                overrule(k)

    overrule(wrapper)

    def titled(node: Node) -> bool:
        return node.kind not in ("x", "c", "h") and ((node.tag in HEADINGS and mass(node, varying) > 0) or any(map(titled, node.kids)))

    total = mass(wrapper, varying)
    articles, mains = find(wrapper, "a"), find(wrapper, "m")
    held = [sum(mass(k, varying) for k in group) for group in (articles, mains)]
    named = articles if articles and 2 * held[0] >= held[1] else mains
    if named and (2 * max(held) >= total or pages < TEMPLATE_PAGES) and (max(held) or not total):
        region = named
    else:
        node = wrapper
        while True:
            kids = [k for k in node.kids if k.kind not in ("x", "c", "h") and k.tag not in VOID | HEADINGS | {"p", "#", "ul", "ol", "table", "blockquote", "a"}]
            top = max(kids, key=lambda k: mass(k, varying), default=None)
            if top is None or top.repeated or not mass(top, varying):
                break
            rest = [k for k in node.kids if k is not top and k.kind not in ("x", "c", "h")]
            if 2 * sum(mass(k, varying) for k in rest) > mass(top, varying) or any(titled(k) or (k.tag in ("p", "#") and mass(k, varying)) for k in rest):
                break
            node = top
        region = [node]
    for node in region:
        node.kind = "r"

    def lead(node: Node) -> bool:
        """Nothing that holds the region is left out for its name."""
        found = node.kind == "r" or any([lead(k) for k in node.kids if k.kind != "x"])
        if found and node.kind != "r":
            node.kind = ""
        return found

    lead(wrapper)
    inside, all_inside = (sum(sum(mass(c, v) for c in node.kids) for node in region) for v in (True, False))
    if pages >= TEMPLATE_PAGES and inside >= VARYING_PART * all_inside:
        for node in region:
            for part in _walk(node):
                if part.sig == "#" and (often := _template(part, pages)):
                    part.kind, part.often = "t", dict.fromkeys(often, 1)


def _walk(node: Node):
    """The parts below, but for headings and what is around."""
    for k in node.kids:
        if k.kind not in ("x", "c") and k.tag not in HEADINGS:
            yield k
            yield from _walk(k)


def _calls(block: str) -> bool:
    """A short block that says it is a notice: a share bar, a call to subscribe."""
    said = re.findall(r"[a-z]+", block.lower())
    return len(said) <= MOST_CALL and bool(CALL_WORDS & set(said))


def extract(page: Node, wrapper: Node | None) -> str:
    """The article's text of a parsed page, by its host's wrapper; by a wrapper of the page alone if it doesn't fit. A page whose text is mostly links, and that calls nothing an article, has none."""
    if wrapper is not None and (text := _article(page, wrapper)):
        return text
    own = fold(page)
    mark_region(own)
    return _article(page, own)


def _article(page: Node, wrapper: Node) -> str:
    parts: list[tuple[str | None, bool]] = []
    counts = [0, 0]
    _take(page, wrapper, wrapper.kind == "r", parts, counts)
    if 2 * counts[1] > counts[0] and not any(k.kind in ("a", "m") for k in _walk(page)):
        return ""
    blocks: list[tuple[str, bool]] = []
    block: list[str] = []
    template = True
    for text, known in [*parts, (None, True)]:
        if text is not None:
            block.append(text)
            template &= known or text.isspace()
        elif block:
            if words := " ".join("".join(block).split()):
                blocks.append((words, template))
            block, template = [], True
    while blocks and blocks[0][1] and _calls(blocks[0][0]):
        blocks.pop(0)
    while blocks and blocks[-1][1] and _calls(blocks[-1][0]):
        blocks.pop()
    return " ".join(words for words, _ in blocks)


def _take(page: Node, wrapper: Node | None, inside: bool, parts: list[tuple[str | None, bool]], counts: list[int], link: bool = False) -> None:
    """Text of the region, with whether it is a template string; None between blocks. ``counts``: its characters, and those in links."""
    at = 0
    places: dict[str, list[int]] = {}
    if wrapper is not None:
        for i, k in enumerate(wrapper.kids):
            places.setdefault(k.sig, []).append(i)
    for k in page.kids:
        match = None
        if wrapper is not None:
            found = places.get(k.sig) or places.get(f"{k.tag}.*{k.kind}")
            if found:  # that which holds most like it; of equal ones the next; a repeated group starts over
                if len(found) > 1 and k.tag in PARTS:
                    at = max(found, key=lambda i: (likeness(wrapper.kids[i], k), i >= at, -i))
                else:
                    at = next((i for i in found if i >= at), found[0])
                match = wrapper.kids[at]
        if k.sig == "#":
            if inside:
                known = match is not None and match.kind == "t" and string_hash(" ".join(k.text.split())) in match.often
                parts.append((k.text, known))
                size = len(k.text.strip())
                counts[0] += size
                counts[1] += size if link else 0
            continue
        kind = match.kind if match is not None else k.kind
        if kind in ("x", "c") or (kind == "h" and not inside):
            continue
        block = k.tag in BLOCK
        if block:
            parts.append((None, True))
        _take(k, match, inside or kind == "r", parts, counts, link or k.tag == "a")
        if block:
            parts.append((None, True))


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of ``pages`` (host, html): each task aligns its pages of a host, then partial wrappers are merged, in two steps and always one at a time."""

    def partial(batches):
        held: dict[str, Node] = {}
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                if not (page := page.as_py()):
                    continue
                new = fold(parse(page))
                held[host] = merge(held[host], new) if host in held else new
                if len(held) >= 1000:
                    yield send(held)
                    held = {}
        if held:
            yield send(held)

    def send(held):
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array([json.dumps(w.dump()) for w in held.values()], pa.string())], schema=arrow_type(WRAPPERS))

    def join(batches):
        host, kept = None, None
        for batch in batches:
            for h, w in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                new = Node.load(json.loads(w))
                if h != host and kept is not None:
                    yield send({host: kept})
                    kept = None
                host, kept = h, new if kept is None else merge(kept, new)
        if kept is not None:
            yield send({host: kept})

    parts = pages.select("host", "html").mapInArrow(partial, WRAPPERS).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(64)))
    once = parts.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper").mapInArrow(join, WRAPPERS)
    return materialize(once.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(join, WRAPPERS), "wrappers")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    wrappers = infer(rows)
    out = "page_id long, url string, text string, n_chars long"
    small = wrappers.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0)).alias("b")).first()["b"] <= MOST_BROADCAST
    known = {r["host"]: r["wrapper"] for r in wrappers.collect()} if small else {}

    def run(batches):
        ready: dict[str, Node | None] = {}

        def wrapper_of(key: str, text: str | None) -> Node | None:
            if key not in ready:
                if len(ready) >= 2000:
                    ready.clear()
                ready[key] = None
                if text is not None:
                    ready[key] = w = Node.load(json.loads(text))
                    mark_region(w)
            return ready[key]

        for batch in batches:
            hosts = batch.column("host").to_pylist()
            given = batch.column("wrapper").to_pylist() if "wrapper" in batch.schema.names else None
            texts = []
            for i, host in enumerate(hosts):
                page = batch.column("html")[i].as_py()
                texts.append(extract(parse(page), wrapper_of(host, given[i] if given else known.get(host))) if page else "")
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow_type(out))

    if not small:
        rows = rows.join(wrappers, "host", "left")
    return rows.mapInArrow(run, out)


def op1_wrapper_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
