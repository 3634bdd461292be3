"""Main text of web pages by wrappers inferred for each host.

A page is a stream of tokens: opening tags with their first class, closing tags and
texts; inline tags are parts of texts.  Streams of one host are aligned one after
another, in order.  Where two streams differ, the mismatch is resolved: texts
become a text slot; what one side has before the two meet again is optional; equal
neighbours, and runs of up to ``PERIOD`` elements that follow themselves, are a repeated
group.  The result, a regular expression without unions, is the host's wrapper.
Alignment is a fold that can be combined, so each task folds its own pages and the
partial wrappers of a host are folded in two steps; no task ever holds a host's pages.

A slot carries what its pages held: up to ``CONSTANT`` distinct contents of pages (so
copies of a page count once), characters, characters inside links, and the range of
the texts' hashes (equal ends: the text never changes).  Slots decide: a text that
never changes in ``CONSTANT`` distinct contents is template, and so is a list of the same
links on all of them; a slot made of links in
a repeated group is a menu (a block of plain text in it stays, and so does a lone
linked heading).  What stands in the flow of a container's text is part of it: a heading
that all pages have between two contents, and a list of differing links behind the first.  Inside an article only the signs below count, and the slot where
those are weak.

Signs of boilerplate that need no wrapper are tags (menus, headers, footers, asides,
forms, scripts), attributes (roles, hidden) and class names.  A class or id is such a
name if it is made of names of page furniture and words for places and boxes only, so
``site-footer`` is one, ``has-sidebar`` and ``legal-history`` are none.  Names are
overruled by the slots: inside an article weak names count only where the slot never
changes or is made of links; on a page without an article, an element of such a name
whose texts are no links, change, and hold ``LONG`` characters and twice what the page
has without such names, is main text.  Names of comments and teasers are firm: they
are overruled only if the page has no other text.

Extraction reads every page whole and follows the wrapper: repeated groups take any
number of rounds and optional groups may be missing, so a page with other numbers
finds its slots too.  Texts whose slot is content make up the blocks; a block ends at
any block-level tag, and ``br`` is a blank.  If a page has such texts inside ``article`` or ``main``,
only those count on this page; pages of another template keep theirs.  A text without
a slot is judged by its signs alone.

Wrappers stay small: elements below ``DEEP`` levels belong to the level above, numbers
in class names are one number, and where a group has more than ``WIDE`` members classes and then
places are left out.  This makes slots coarser; it drops no text.

Defined cases: a null or empty page has no text; quotes open an attribute's value only
right after ``=``, and one that nothing closes is a character like others; a comment ends
at ``-->`` or ``--!>``, else with the page; a page that has nothing but texts under
boilerplate names keeps the surest of them that are no links; stray closing tags are skipped; an
element that is never closed is no boilerplate by its tag; only script, style,
textarea and title are raw text (unclosed: to the end); very long and very deep pages
are read in time linear in their length; a null url belongs to the host of the empty
name; repeated rows each give a row; an empty table gives no rows; other columns are
ignored.  The order in which pages meet may move an optional group's place, so
another partitioning may judge a text by another slot.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import HOT, ship_package, stored

#: Distinct contents of pages in which an unchanging text outside an article is boilerplate.
CONSTANT = 3
#: Share of link characters from which a slot is a menu.
LINKS = 0.8
#: Characters of a page from which texts under a boilerplate name may be its main text.
LONG = 100
#: Elements of a repeated group at most.
PERIOD = 3
#: Levels of elements, and members of a group, that a wrapper tells apart.
DEEP, WIDE = 48, 96
#: Hosts whose partial wrappers a task holds at a time.
HOSTS = 1000
#: Parts that a host's partial wrappers are folded in first.
PARTS = 32
#: Bytes of wrappers up to which they are broadcast.
SMALL = 64 << 20

# fixed values: names of the HTML standard
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "math", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
DROP_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "template", "svg", "iframe", "canvas", "head", *RAW}
TAGS = CLOSES_P | INLINE | DROP_TAGS | VOID | set(SAME) | {"html", "tbody", "thead", "tfoot", "caption", "summary", "object", "noscript", "picture", "video", "audio", "center"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
# fixed values: words of class names
#: What holds other people's texts, or teasers that are articles themselves.
FIRM = set("comment comments replies reply respond disqus related recommended recommendations".split())
STRONG = set(
    "ad ads advert adverts advertisement advertisements advertising adslot adbox sponsor sponsors sponsored cookie cookies consent gdpr newsletter"
    " newsletters popup popups modal modals overlay overlays nav navs navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars share"
    " sharing social footer footers masthead topbar toolbar pagination pager subscribe subscription signup login".split()
)
#: A page's header is furniture, the header of an article, post or section is none.
HEADERS, OWN = {"header", "headers"}, {"article", "articles", "post", "posts", "content", "section", "text", "stories", "panel"}
WEAK = HEADERS | set("alert alerts notice notices promo promos promotion promotions banner banners widget widgets search copyright legal hidden".split())
PHRASES = {"site-header", "page-header", "global-header", "top-bar", "side-bar", "skip-link", "skip-links"}
PLACES = set(
    "site page main global mobile top bottom left right primary secondary area list link links item items box boxes block blocks bar container"
    " wrapper wrap section panel content inner outer slot unit text button buttons form icon icons row col column group post posts article articles"
    " stories news".split()
)
#: Kinds of texts: without a sign of boilerplate, under a weak, a strong or a firm name, under a tag or attribute.
CLEAN, WEAKLY, NAMED, FIRMLY, HARD = range(5)
#: Comments, declarations and tags by the states of the standard's tag reader: a quote opens a value only right after ``=``.
#: A quote that nothing closes is an ordinary character, so it takes no text with it.
VALUE = r"""\s*(?:"[^"]*"|'[^']*'|[^\s>]*)"""
TOKEN = re.compile(rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*(?:[^>=]++|={VALUE})*+(?:>|\Z)""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
FIRST = re.compile(r"[\w-]+")
BLANK = re.compile(r"\s+")
TEXT = "#"


def name_level(name: str) -> int:
    """How surely a class or id names page furniture."""
    if name.lower() in PHRASES:
        return NAMED
    words = [w.lower() for w in WORDS.findall(name)]
    if not HEADERS.isdisjoint(words) and not OWN.isdisjoint(words):
        return CLEAN
    level = CLEAN
    for w in words:
        own = FIRMLY if w in FIRM else NAMED if w in STRONG else WEAKLY if w in WEAK else CLEAN
        if not own and w not in PLACES:
            return CLEAN
        level = max(level, own)
    return level


def named_values(attributes: str) -> Iterator[tuple[str, str]]:
    """Names in lower case and values of a tag's attributes; the first of a name counts."""
    seen = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        if (name := name.lower()) not in seen:
            seen.add(name)
            yield name, next((v for v in values if v), "")


def _level(tag: str, attributes: str, inside: bool, closed: bool) -> int:
    """How surely an element is boilerplate by its tag and attributes.

    A ``header`` inside an article holds the article's own heading.
    """
    if tag in DROP_TAGS and closed and not (tag == "header" and inside):
        return HARD
    level = CLEAN
    for name, value in named_values(attributes):
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in DROP_ROLES):
            return HARD
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return HARD
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            level = max(level, *map(name_level, value.split()), CLEAN)
    return level


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text) with kind open, close or text; texts of raw elements are left out."""
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        got = m.group()
        name = NAME.match(got)
        if name is None:
            continue
        tag = name[1].lower()
        if got.startswith("</"):
            yield "close", tag, ""
            continue
        yield "open", tag, got[name.end() :].removesuffix(">")
        if tag in RAW and not got.endswith("/>"):
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else n
            if not end:
                yield "close", tag, ""


def closed_elements(stream: list[tuple[str, str, str]]) -> set[int]:
    """Places of the opening tags that have a closing tag of their own."""
    waiting: dict[str, list[int]] = {}
    found = set()
    for k, (kind, tag, _) in enumerate(stream):
        if kind == "open":
            waiting.setdefault(tag, []).append(k)
        elif kind == "close" and waiting.get(tag):
            found.add(waiting[tag].pop())
    return found


def label_of(tag: str, attributes: str) -> str:
    """An element in a wrapper: its tag and first class; numbers are one, and so are tags that HTML lacks."""
    tag = tag if tag in TAGS else "other"
    if "class" not in attributes.lower():
        return tag
    first = FIRST.search(next((v for n, v in named_values(attributes) if n == "class"), ""))
    return f"{tag}.{re.sub(r'[0-9]+', '0', first[0])}" if first else tag


def texts(page: str, root, enter: Callable, leave: Callable | None = None) -> Iterator[tuple]:
    """(node, level, box, in an article, in a link, block number, text) of each text.

    ``enter(node, label)`` gives the node of an element inside ``node``, and
    ``leave(parent, node)`` is told that it ends.  A block number changes at each block-level
    tag; a text without a letter or sign is a blank with node None.  The box is the number of the
    innermost element with a sign of boilerplate, 0 if the level is ``CLEAN``.  An article below a name is
    no part of the named block, unless that name is firm; a ``main`` never is.
    """
    stream = list(tokens(page))
    closed = closed_elements(stream)
    # tag, node, level, in an article, in a link, box, whether the node is its own
    bottom = ("", root, CLEAN, False, False, 0, False)
    stack: list[tuple] = []
    opened: dict[str, int] = {}
    block = boxes = depth = 0

    def cut(k: int) -> None:
        nonlocal depth
        while len(stack) > k:
            tag, node, *_, own = stack.pop()
            opened[tag] -= 1
            if own:
                depth -= 1
                if leave:
                    leave(stack[-1][1] if stack else root, node)

    for at, (kind, tag, rest) in enumerate(stream):
        top = stack[-1] if stack else bottom
        if kind == "text":
            if rest.strip():
                yield top[1], top[2], top[5], top[3], top[4], block, rest
            else:
                yield None, HARD, 0, False, False, block, " "
            continue
        if tag not in INLINE:
            block += 1
        if kind == "close":
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                cut(k)
            continue
        if tag in CLOSES_P and opened.get("p"):
            k = len(stack) - 1
            while k > 0 and stack[k][0] in INLINE:
                k -= 1
            if stack[k][0] == "p":
                cut(k)
        if any(opened.get(t) for t in SAME.get(tag, ())):
            for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEP), -1):
                if stack[k][0] in SAME[tag]:
                    cut(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        top = stack[-1] if stack else bottom
        if tag == "br":
            yield None, HARD, 0, False, False, block, " "
        if tag in VOID:
            continue
        inside = top[3] or tag in ("article", "main")
        above, box = top[2], top[5]
        if not top[3] and above <= {"article": NAMED, "main": FIRMLY}.get(tag, CLEAN):
            above, box = CLEAN, 0
        level = _level(tag, rest, top[3], at in closed)
        if level:
            boxes += 1
            above, box = max(above, level), boxes
        node, own = top[1], tag not in INLINE and depth < DEEP
        if own:
            node = enter(node, label_of(tag, rest))
            depth += 1
        stack.append((tag, node, above, inside, top[4] or tag == "a", box, own))
        opened[tag] = opened.get(tag, 0) + 1
    cut(0)


# A wrapper is [label, repeated, optional, slot, children, mark]; the label of a text
# is "#", and only texts have a slot: [distinct contents, characters, link characters,
# least hash, largest hash, least sum, largest sum]; a sum is that of the hashes of one page's
# texts in the slot, and there is one of them while a page is read.  A mark is 1 where a repeated group of several elements
# begins, 2 where it ends.


def shape(page: str) -> list:
    """The wrapper of one page: its stream with repeated groups folded."""
    root = ["", False, False, None, [], 0]
    own, every = 0, 0  # hashes of the page's own texts, and of all

    def enter(_: list, label: str) -> list:
        return [label, False, False, None, [], 0]

    def leave(parent: list, node: list) -> None:
        push(parent[4], node)
        if len(parent[4]) > 2 * WIDE:
            parent[4] = narrow(parent[4])

    for node, level, _, _, linked, _, text in texts(page, root, enter, leave):
        if node is None:
            continue
        n, crc = len(text.strip()), zlib.crc32(" ".join(text.split()).encode("utf-8", "replace"))
        every = zlib.crc32(crc.to_bytes(4), every)
        if level == CLEAN and not linked:
            own = zlib.crc32(crc.to_bytes(4), own)
        push(node[4], [TEXT, False, False, [[], n, n if linked else 0, crc, crc, crc], [], 0])
    root[4] = narrow(root[4])
    todo = [root]
    while todo:
        w = todo.pop()
        if w[3]:
            w[3][0] = [own or every]
            w[3].append(w[3][5])
        todo += w[4]
    return root


def push(members: list[list], new: list) -> None:
    """Appends a member; a copy of what stands before becomes a repeated group with it."""
    if members and members[-1][0] == new[0] and members[-1][5] != 1:
        last = members[-1]
        members[-1] = align(last, new)
        members[-1][1:3] = True, last[2] and new[2]
        members[-1][5] = last[5] or new[5]
        return
    members.append(new)
    for k in range(2, PERIOD + 1):
        if len(members) < 2 * k or any(a[0] != b[0] for a, b in zip(members[-k:], members[-2 * k : -k], strict=True)):
            continue
        if any(m[5] for m in members[-k:]):
            continue
        marks = [m[5] for m in members[-2 * k : -k]]
        if any(marks) and marks != [1, *[0] * (k - 2), 2]:
            continue
        both = [align(a, b) for a, b in zip(members[-2 * k : -k], members[-k:], strict=True)]
        del members[-2 * k :]
        for j, m in enumerate(both):
            m[5] = 1 if j == 0 else 2 if j == k - 1 else 0
        members += both
        return


def narrow(members: list[list]) -> list[list]:
    """Fewer members where there are more than ``WIDE``: first without classes, then without places."""
    if len(members) > WIDE:
        out: list[list] = []
        for m in members:
            push(out, [m[0].split(".")[0], *m[1:5], 0])
        members = out
    if len(members) > WIDE:
        by: dict[str, list] = {}
        for m in members:
            m = align(by[m[0]], m) if m[0] in by else m
            by[m[0]] = [m[0], True, True, *m[3:5], 0]
        members = list(by.values())
        if len(members) > 1:  # any of them, in any order
            members[0][5], members[-1][5] = 1, 2
    return members


def align(a: list, b: list) -> list:
    """The wrapper that fits whatever ``a`` or ``b`` fits."""
    slot = a[3] or b[3]
    if a[3] and b[3]:
        s, t = a[3], b[3]
        slot = [s[0] if s[0] == t[0] else sorted({*s[0], *t[0]})[:CONSTANT], s[1] + t[1], s[2] + t[2], min(s[3], t[3]), max(s[4], t[4])]
        slot += [s[5] + t[5]] if len(s) == 6 else [min(s[5], t[5]), max(s[6], t[6])]
    left, right = a[4], b[4]
    if [(c[0], c[5]) for c in left] == [(c[0], c[5]) for c in right]:
        members = [align(c, d) for c, d in zip(left, right, strict=True)]
    else:
        members = narrow(_matched(left, right))
    return [a[0], a[1] or b[1], a[2] or b[2], slot, members, a[5]]


def _matched(left: list[list], right: list[list]) -> list[list]:
    """Members of both sides in one order.

    At a mismatch the side whose next member the other one meets sooner waits, and what
    the other has before it is optional.
    """
    places: list[dict[str, list[int]]] = [{}, {}]
    for at, side in zip(places, (left, right), strict=True):
        for k, m in enumerate(side):
            at.setdefault(m[0], []).append(k)

    def ahead(side: int, label: str, start: int) -> int | None:
        at = places[side].get(label, [])
        k = bisect_left(at, start)
        return at[k] if k < len(at) else None

    met: list[list] = []
    spans: list[tuple[int, int]] = []  # groups of either side, as places in ``met``
    begun = [0, 0]

    def take(m: list, *marks: tuple[int, int]) -> None:
        for side, mark in marks:
            if mark == 1:
                begun[side] = len(met)
            elif mark == 2:
                spans.append((begun[side], len(met)))
        met.append([*m[:5], 0])

    def skip(side: int, members: list[list]) -> None:
        for m in members:
            take([m[0], m[1], True, *m[3:]], (side, m[5]))

    i = j = 0
    while i < len(left) and j < len(right):
        if left[i][0] == right[j][0]:
            take(align(left[i], right[j]), (0, left[i][5]), (1, right[j][5]))
            i, j = i + 1, j + 1
            continue
        x, y = ahead(0, right[j][0], i), ahead(1, left[i][0], j)
        if x is None and y is None:
            skip(0, left[i : i + 1])
            skip(1, right[j : j + 1])
            i, j = i + 1, j + 1
        elif y is None or (x is not None and x - i <= y - j):
            skip(0, left[i:x])
            i = x
        else:
            skip(1, right[j:y])
            j = y
    skip(0, left[i:])
    skip(1, right[j:])
    # groups that overlap are one group, whose rounds may lack what not all of them hold
    joined: list[list[int]] = []  # first, last, and the range that all have
    for first, last in sorted(spans):
        if joined and first <= joined[-1][1]:
            now = joined[-1]
            joined[-1] = [now[0], max(now[1], last), max(now[2], first), min(now[3], last)]
        else:
            joined.append([first, last, first, last])
    out: list[list] = []
    done = 0
    for first, last, low, high in joined:
        for m in met[done:first]:
            push(out, m)
        for k in range(first, last + 1):
            met[k][2] = met[k][2] or not low <= k <= high
        met[first][5], met[last][5] = 1, 2
        out += met[first : last + 1]
        done = last + 1
    for m in met[done:]:
        push(out, m)
    return out


def expression(w: list) -> str:
    """A wrapper in the usual notation, for people."""
    inner = ""
    for c in w[4]:
        inner += ("(" if c[5] == 1 else "") + expression(c) + (")+" if c[5] == 2 else "")
    body = "#TEXT" if w[0] == TEXT else f"<{w[0]}>{inner}</>" if w[0] else inner
    return f"({body}){'*' if w[1] and w[2] else '+' if w[1] else '?'}" if w[1] or w[2] else body


def judged(wrapper: list) -> list:
    """A wrapper for extraction: slots become True for content, False for texts that never change.

    Menus are None, and the empty text if they never change either.
    """

    def one(w: list, grouped: bool) -> list:
        slot = None
        if w[3]:
            contents, n, linked, low, high, least, most = w[3]
            same = len(contents) >= CONSTANT and (low == high or (least == most and linked >= LINKS * n))
            menu = linked >= LINKS * n and (w[1] or grouped)
            slot = "" if menu and same else None if menu else not same
        members, within = [], False
        for c in w[4]:
            within = within or c[5] == 1
            members.append(one(c, w[1] or grouped and w[5] == 0 or within))
            within = within and c[5] != 2
        flowing(members)
        return [w[0], w[1], w[2], slot, members, w[5]]

    return one(wrapper, False)


#: Elements that stand in a text's flow, side by side in the container that holds it.
FLOW = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "blockquote", "pre", "figure", TEXT}


def verdicts(w: list) -> set:
    """Verdicts of the slots in a judged wrapper."""
    return ({w[3]} if w[0] == TEXT else set()).union(*map(verdicts, w[4]))


def kept_whole(w: list) -> None:
    """All slots of a judged wrapper become content."""
    if w[0] == TEXT:
        w[3] = True
    for c in w[4]:
        kept_whole(c)


def flowing(members: list[list]) -> None:
    """What stands in the flow of a container's text is part of it.

    Behind the first content, a list of links that differ from page to page is part of the
    text (references), no menu; and between two contents an unchanging text is too (a
    heading such as Summary).
    """
    flow = [(m, verdicts(m)) for m in members if m[0].split(".")[0] in FLOW]
    first = next((k for k, (_, v) in enumerate(flow) if True in v), None)
    if first is None:
        return
    for k, (m, v) in enumerate(flow):
        if k > first and None in v and v <= {None, True}:
            kept_whole(m)
            flow[k] = (m, {True})
    last = max(k for k, (_, v) in enumerate(flow) if True in v)
    for m, v in flow[first + 1 : last]:
        if v == {False}:
            kept_whole(m)


class Follower:
    """A judged wrapper with the places of its labels, to be followed by pages."""

    def __init__(self, w: list):
        self.label, self.repeated, self.content = w[0], w[1], w[3]
        self.members = [Follower(c) for c in w[4]]
        self.at: dict[str, list[int]] = {}
        self.needed = [0]  # members before each that are not optional
        self.group: list[tuple[int, int]] = []  # first and last member of the group around each
        begun = None
        for k, c in enumerate(w[4]):
            self.at.setdefault(c[0], []).append(k)
            self.needed.append(self.needed[-1] + (not c[2]))
            self.group.append((k, k))
            begun = k if c[5] == 1 else begun
            if c[5] == 2 and begun is not None:
                self.group[begun:] = [(begun, k)] * (k + 1 - begun)
                begun = None

    def step(self, now: int, label: str) -> int | None:
        """The member with this label that comes after member ``now`` (-1: none yet)."""
        at = self.at.get(label)
        if at is None:
            at = self.at.get(label.split(".")[0])
            if at is None:
                return None
        k = bisect_right(at, now)
        later = at[k] if k < len(at) else None
        if now < 0:
            return later
        first, last = self.group[now]
        same = at[k - 1] if k and at[k - 1] == now else None
        if same is not None and self.members[now].repeated:
            return now
        if later is not None and later <= last:
            return later
        if first < last:  # the next round of a repeated group
            k = bisect_left(at, first)
            if k < len(at) and at[k] <= now:
                return at[k]
        if later is not None and self.needed[later] == self.needed[now + 1]:
            return later
        return same if same is not None else later if later is not None else at[-1]


def main_text(page: str | None, wrapper: Follower | None) -> str:
    """Blocks of the content slots, in page order, one line each."""

    def enter(state: list, label: str) -> list:
        follower, now = state
        found = follower.step(now, label) if follower else None
        if found is None:
            return [None, -1]
        state[1] = found
        return [follower.members[found], -1]

    rows, size_of = [], {}  # block: characters, and those inside links
    for state, level, box, inside, linked, block, text in texts(page or "", [wrapper, -1], enter):
        if state is None:
            rows.append((True, HARD, 0, False, block, " "))
            continue
        slot = enter(state, TEXT)[0]
        size = size_of.setdefault(block, [0, 0])
        size[0] += len(text.strip())
        size[1] += len(text.strip()) if linked else 0
        rows.append((slot.content if slot else True, level, box, inside, block, text))
    found: list[tuple[int, int, bool, int, str]] = []  # level, box, in an article, block, text
    sums: dict[tuple[int, int, bool], int] = {}
    plain: dict[tuple[int, int], int] = {}  # characters outside links of a box
    for good, level, box, inside, block, text in rows:
        if text == " ":
            found.append((HARD, 0, False, block, " "))
            continue
        if good is None:
            good = size_of[block][1] < LINKS * size_of[block][0]
        if inside and level == WEAKLY and good:
            level, box = CLEAN, 0
        if not (good or (inside and level == CLEAN)):
            level = HARD
        kind = level, box, inside
        sums[kind] = sums.get(kind, 0) + len(text.strip())
        if level < HARD and size_of[block][1] < LINKS * size_of[block][0]:
            plain[level, box] = plain.get((level, box), 0) + len(text.strip())
        found.append((*kind, block, text))
    within = any(level == CLEAN and inside for level, _, inside in sums)
    clean = sum(n for (level, _, _), n in sums.items() if level == CLEAN)
    main = {0}  # boxes that are content: the clean one, and what is overruled
    for overruled, enough in (((WEAKLY, NAMED), 2 * clean), ((FIRMLY,), 0)):
        size: dict[int, int] = {}
        for (level, box, _), n in sums.items():
            if level in overruled:
                size[box] = size.get(box, 0) + n
        least = max(LONG, enough + 1, max(size.values(), default=0) / 2)
        if not within and len(main) == 1 and (NAMED in overruled or not clean):
            main |= {box for box, n in size.items() if n >= least}
    if not within and not clean and len(main) == 1 and plain:  # nothing else is there: the surest of what is named
        surest = min(level for level, _ in plain)
        most = max(n for (level, _), n in plain.items() if level == surest)
        main |= {box for (level, box), n in plain.items() if level == surest and n >= most / 2}
    blocks: list[str] = []
    parts: list[str] = []
    now = None
    for level, box, inside, block, text in found:
        if text == " ":
            if block == now:
                parts.append(" ")
            continue
        if block != now:
            blocks.append("".join(parts))
            parts, now = [], block
        if level < HARD and box in main and (inside or not within):
            parts.append(text)
    blocks.append("".join(parts))
    lines = (BLANK.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper``: each host's wrapper with its slots judged, as JSON."""
    ship_package(pages.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([json.dumps(w) for w in found.values()])], names=["host", "wrapper"])
            found.clear()
            return out

        for batch in batches:
            for host, page in zip(batch["host"].to_pylist(), batch["html"], strict=True):
                new = shape(page.as_py() or "")
                found[host] = align(found[host], new) if host in found else new
                if len(found) >= HOSTS:
                    yield sent()
        if found:
            yield sent()

    def merge(batches: Iterator[pa.RecordBatch], close: Callable = lambda w: w) -> Iterator[pa.RecordBatch]:
        """Rows sorted by host: one row for each."""
        host, now = None, None
        for batch in batches:
            out: list[tuple[str, str]] = []
            for h, w in zip(batch["host"].to_pylist(), batch["wrapper"].to_pylist(), strict=True):
                if h == host:
                    now = align(now, json.loads(w))
                else:
                    if host is not None:
                        out.append((host, json.dumps(close(now))))
                    host, now = h, json.loads(w)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["host", "wrapper"])
        if host is not None:
            yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([json.dumps(close(now))])], names=["host", "wrapper"])

    kinds = "host string, wrapper string"
    parts = pages.mapInArrow(fold, kinds)
    parts = parts.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)))
    parts = parts.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").select("host", "wrapper").mapInArrow(merge, kinds)
    return parts.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(lambda b: merge(b, judged), kinds)


def with_wrappers(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with their host's wrapper: those of hosts with ``HOT`` pages or more where they are, others by a shuffle.

    There is one such host for ``HOT`` pages at most, so few wrappers are broadcast.
    """
    hot = stored(pages.groupBy("host").count().filter(F.col("count") >= HOT).select("host"), "hot")
    few = F.broadcast(found.join(F.broadcast(hot), "host", "left_semi"))
    rest = pages.join(F.broadcast(hot), "host", "left_anti").join(found, "host", "left")
    return pages.join(F.broadcast(hot), "host", "left_semi").join(few, "host", "left").unionByName(rest)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    Wrappers are sent to each worker once if they have ``SMALL`` bytes at most; beyond
    that each page is joined to its own, and pages of large hosts are not shuffled.
    """
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    found = stored(wrappers(own.select("host", "html")), "wrappers")
    size = found.agg(F.sum(F.length("wrapper") + F.length("host") + 64)).first()[0] or 0
    sent = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in found.collect()}) if size <= SMALL else None
    joined = own.withColumn("wrapper", F.lit(None).cast("string")) if sent else with_wrappers(own, found)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Follower | None] = {}
        held = 0
        for batch in batches:
            out = []
            for page, host, wrapper in zip(batch["html"], batch["host"].to_pylist(), batch["wrapper"], strict=True):
                if host not in known:
                    text = sent.value.get(host) if sent else wrapper.as_py()
                    if held > SMALL // 8:
                        known, held = {}, 0
                    known[host], held = Follower(json.loads(text)) if text else None, held + len(text or "")
                out.append(main_text(page.as_py(), known[host]))
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return joined.select("page_id", "url", "html", "host", "wrapper").mapInArrow(
        rows, "page_id long, url string, text string, n_chars long"
    )


def op7_host_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
