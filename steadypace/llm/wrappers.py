"""Union-free wrappers of one host's pages, inferred by aligning their token streams.

A page becomes a stream of balanced tags and text. Two streams are aligned from left to right: equal tags
match and are aligned inside; equal texts stay template text and different ones become a text slot; a tag
that repeats right after itself is folded into a repeated group; and where the streams differ, the part
found in one only becomes an optional group. The result is again a stream of that kind, with no union in
it, so pages, and wrappers of parts of a host, are aligned one after the other in any number.

A node is a list [label, kind, children, chars, pages]: kind is one of "1", "?", "+", "*"; a text child is
["#", kind, hash of the template text or None for a slot, chars seen, pages].
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter

# HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small "
                   "span strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mspace mfrac msqrt "
                   "mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom menclose".split())
RAW = frozenset("script style noscript template iframe textarea title select annotation annotation-xml".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 "
                   "h4 h5 h6 header hr main nav ol p pre section table ul".split())
FLOW = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())
ASIDE_TAGS = frozenset("nav footer aside form button dialog menu head".split()) | RAW
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners promo promos promotion sponsor "
    "sponsored sponsors cookie cookies consent gdpr notice notices alert alerts sidebar sidebars aside menu "
    "menus nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended comment "
    "comments discussion disqus respond reply replies newsletter subscribe subscription signup footer footers "
    "popup modal overlay login search toolbar pagination pager widget masthead topbar copyright".split())
BEFORE = frozenset(
    "site page main primary secondary tertiary top bottom left right global head header mobile desktop user post "
    "article entry blog google gpt dfp inline sticky fixed floating side email js wp block the".split())
AFTER = frozenset(
    "bar box wrap wrapper container block area list item items link links button buttons btn section panel slot "
    "unit inner outer left right top bottom main primary secondary title heading header icon icons toggle "
    "posts stories articles media message group row col column zone space place placeholder rail tray strip "
    "form field input this thread".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
MARKS = ASIDE_ROLES | {"main", "articlebody"}
MOST_CHILDREN = 64
DEEPEST = 200  # elements further down have no node of their own
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?)*+)>?", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def parse(page: str, words: frozenset | None = None) -> list:
    """The page as a root node of nested [label, children]; texts are strings. Inline tags leave no trace,
    elements of no text content are dropped, missing end tags are filled in. Only class words among
    ``words`` are in labels; all are if that is None. What lies deeper than ``DEEPEST`` elements goes, in its order,
    to its ancestor at that depth, asides excepted; so no step after this one meets a deeper tree."""
    root: list = ["", []]
    stack, at = [root], 0
    opened: Counter = Counter()

    def close(depth: int) -> None:
        opened.subtract(_tag(n[0]) for n in stack[depth:])
        if len(stack) > DEEPEST:
            _text(stack[max(depth - 1, 0)], " ")
        del stack[depth:]

    for token in _TOKEN.finditer(page):
        if token.start() < at:
            continue
        if token.start() > at:
            _text(stack[-1], page[at : token.start()])
        at = token.end()
        if token["cdata"] is not None:
            _text(stack[-1], token["cdata"])
        if token["tag"] is None:
            continue
        tag = token["tag"].lower()
        if tag in RAW:
            if not token["close"] and not token["rest"].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br" or tag in VOID:
            _text(stack[-1], " ")
            continue
        if tag in INLINE and not token["close"] and not _aside(tag, token["rest"]):
            stack[-1][1].append(None)  # keeps texts on both sides together
            continue
        if token["close"]:
            if opened[tag] > 0:
                close(next(d for d in range(len(stack) - 1, 0, -1) if _tag(stack[d][0]) == tag))
            continue
        closes = CLOSES.get(tag, ()) or ({"p"} if tag in BLOCKS else ())
        if tag in BLOCKS and tag != "p":
            closes = set(closes) | {"p"}
        while len(stack) > 1 and _tag(stack[-1][0]) in closes:
            close(len(stack) - 1)
        node = [_label(tag, token["rest"], words), []]
        if len(stack) <= DEEPEST:
            stack[-1][1].append(node)
        elif not is_aside(node[0]):
            _text(stack[-1], " ")
            node[1] = stack[-1][1]
        if not token["rest"].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if at < len(page):
        _text(stack[-1], page[at:])
    return root


def _label(tag: str, rest: str, words: frozenset | None = None) -> str:
    """Tag, marks and class words. Ids are often a page's own: they only tell an aside, whose class words
    are left out too."""
    names = _attributes(rest)
    if not names:
        return tag
    marks = {name for name in names if name[0] == "@"}
    if is_aside(" ".join([tag, *(name.lstrip("#") or "#" for name in names - marks)])):
        return " ".join([tag, *sorted(marks), "@named"])
    kept = {name for name in names - marks if name[0] != "#" and (words is None or name in words)}
    return " ".join([tag, *sorted(marks | kept)])


def _attributes(rest: str) -> set[str]:
    """Class words, ids after "#", and marks after "@"; numbers vary from page to page and are left out."""
    if "=" not in rest and "hidden" not in rest.lower():
        return set()
    out = set()
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            out.add("@hidden")
        elif name in ("role", "itemprop"):
            out.update(f"@{w}" for w in value.split() if w in MARKS)
        elif name == "id":
            out.update(f"#{w}" for w in _words(value))
        else:
            out.update(w for w in _words(value) if w[0] not in "@#")
    return out


def _words(value: str) -> list[str]:
    return re.sub(r"\d+", "", value.lower()).split()


def class_words(page: str) -> set[str]:
    """Words that labels of the page may have."""
    return {w for value in _CLASS.findall(page) for w in _words(value.strip("\"'"))}


def _aside(tag: str, rest: str) -> bool:
    return is_aside(_label(tag, rest))


def is_aside(label: str) -> bool:
    """Whether an element's name or attributes say it is not the article. The whole page is never an aside,
    and class words and ids alone do not make one of main and article."""
    tag, *names = label.split(" ")
    if tag in ASIDE_TAGS:
        return True
    if tag in ("html", "body"):
        return False
    for name in names:
        if name in ("@hidden", "@named") or (name[0] == "@" and name[1:] in ASIDE_ROLES):
            return True
        if name[0] != "@" and tag not in ("main", "article") and _names_aside(name):
            return True
    return False


def _names_aside(name: str) -> bool:
    """Whether a class word or id is an aside word, alone or between words that say where it is or what it
    is made of: "site-footer", "ad-box", "comment-list", but not "no-sidebar", "comments-open", "ad-free"."""
    parts = [part for part in re.split(r"[-_:]+", name) if part]
    while parts and parts[0] not in ASIDE_NAMES and parts[0] in BEFORE:
        del parts[0]
    if not parts or parts[0] not in ASIDE_NAMES:
        return False
    return all(part in ASIDE_NAMES or part in AFTER for part in parts)


def _text(node: list, text: str) -> None:
    children = node[1]
    if children and isinstance(children[-1], str):
        children[-1] += text
    elif len(children) > 1 and children[-1] is None and isinstance(children[-2], str):
        children.pop()
        children[-1] += text
    elif text.strip() or (children and children[-1] is None):
        while children and children[-1] is None:
            children.pop()
        if children and isinstance(children[-1], str):
            children[-1] += text
        else:
            children.append(text)


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def wrapper_of(node: list) -> list:
    """The wrapper of a single page: repeated neighbours folded, asides left out."""
    children: list = []
    for child in node[1]:
        if child is None or (not isinstance(child, str) and is_aside(child[0])):
            continue
        if isinstance(child, str):
            text = clean(child)
            if not text:
                continue
            new = ["#", "1", zlib.crc32(text.encode()), len(text), 1]
        else:
            new = wrapper_of(child)
        if children and children[-1][0] == new[0] != "#":
            children[-1] = _merge(children[-1], new, True)
            children[-1][1], children[-1][4] = "+", 1
        else:
            children.append(new)
    children = _folded(children, True)
    return [node[0], "1", children, sum(c[3] for c in children), 1]


def _kind(a: str, b: str) -> str:
    many, maybe = a in "+*" or b in "+*", a in "?*" or b in "?*"
    return ("*" if maybe else "+") if many else ("?" if maybe else "1")


def _optional(node: list) -> list:
    return [node[0], _kind(node[1], "?"), *node[2:]]


def _merge(a: list, b: list, one_page: bool = False) -> list:
    """Texts of one page become one text together; different texts of two pages become a slot."""
    if a[0] == "#":
        text = a[2] if a[2] == b[2] else None
        if one_page and a[2] is not None and b[2] is not None:
            text = (31 * a[2] + b[2]) & 0xFFFFFFFF
        return ["#", _kind(a[1], b[1]), text, a[3] + b[3], a[4] + b[4]]
    return [a[0], _kind(a[1], b[1]), align(a[2], b[2], one_page), a[3] + b[3], a[4] + b[4]]


def _folded(children: list, one_page: bool) -> list:
    """Long streams lose the order of their elements: those of one label become one repeated group, so a
    stream has at most ``MOST_CHILDREN`` elements or one for each label."""
    if len(children) <= MOST_CHILDREN:
        return children
    groups: dict[str, list] = {}
    for child in children:
        if child[0] in groups:
            pages = max(groups[child[0]][4], child[4])
            groups[child[0]] = _merge(groups[child[0]], child, one_page)
            groups[child[0]][1], groups[child[0]][4] = _kind(groups[child[0]][1], "+"), pages
        else:
            groups[child[0]] = child
    return list(groups.values())


def align(a: list, b: list, one_page: bool = False) -> list:
    """Align two streams; what only one of them has becomes optional."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i][0] == b[j][0]:
            out.append(_merge(a[i], b[j], one_page))
            i, j = i + 1, j + 1
            continue
        in_a = next((k for k in range(i + 1, len(a)) if a[k][0] == b[j][0]), None)
        in_b = next((k for k in range(j + 1, len(b)) if b[k][0] == a[i][0]), None)
        if in_a is not None and (in_b is None or in_a - i <= in_b - j):
            out.extend(map(_optional, a[i:in_a]))
            i = in_a
        elif in_b is not None:
            out.extend(map(_optional, b[j:in_b]))
            j = in_b
        else:
            out.append(_optional(a[i]))
            out.append(_optional(b[j]))
            i, j = i + 1, j + 1
    return _folded(out + [_optional(n) for n in a[i:]] + [_optional(n) for n in b[j:]], one_page)


def combine(a: list, b: list) -> list:
    """Two wrappers of one host: [pages, root]."""
    return [a[0] + b[0], _merge(a[1], b[1])]


def region(wrapper: list) -> tuple[list[str]]:
    """Where the article is: the labels from the root down to the smallest element that holds all of it.
    Template texts in it, as copies of one page and headings that a host repeats, are text like any other.

    The article is every article and main element, and outside them every heading and paragraph that is in
    no aside. A text outside both, as the site's name in a plain element, is the frame's if it is the same on
    all pages while the other texts differ; else it counts for the article too. A header of the whole page
    is frame."""
    sure: list[list[str]] = []
    plain: list[tuple[list[str], bool]] = []
    varied = _places(wrapper[1], [], False, sure, plain)
    places = sure + [path for path, differs in plain if differs or not varied]
    path = list(places[0]) if places else []
    for other in places[1:]:
        same = 0
        while same < min(len(path), len(other)) and path[same] == other[same]:
            same += 1
        del path[same:]
    return (path,)


def _places(node: list, path: list[str], inside: bool, sure: list, plain: list) -> bool:
    """Collect the paths of the article's elements and of plain texts outside them; returns whether a text of
    the article differs between pages."""
    varied = False
    for child in node[2]:
        if child[0] == "#":
            if not inside:
                plain.append((path, child[2] is None))
            varied |= inside and child[2] is None
        elif not is_aside(child[0]) and not (_in_frame(path) and _tag(child[0]) == "header"):
            here = [*path, child[0]]
            marked = _marked(child[0])
            starts = not inside and (marked or _tag(child[0]) in FLOW)
            if starts and child[3]:
                sure.append(here if marked else path)
            varied |= _places(child, here, inside or starts, sure, plain)
    return varied


def _tag(label: str) -> str:
    return label.split(" ")[0]


def _marked(label: str) -> bool:
    tag, *names = label.split(" ")
    return tag in ("article", "main") or "@main" in names or "@articlebody" in names


def _in_frame(path: list[str]) -> bool:
    """Whether the path has not left the whole page."""
    return all(_tag(label) in ("html", "body") for label in path)


def extract(page: list, path: list[str], named: bool = True) -> str | None:
    """Text blocks of the region in page order; None if the page has no such region. Unless ``named``, only
    tags tell what is an aside."""
    nodes = [page]
    for label in path:
        nodes = [c for n in nodes for c in n[1] if isinstance(c, list) and c[0] == label]
    if not nodes:
        return None
    blocks: list[str] = []
    for node in nodes:
        _blocks(node, blocks, _in_frame(path), named)
    return " ".join(blocks)


def own_text(page: list) -> str:
    """Text of a page by itself: of its own region or, if that is empty, of all that its tags do not
    call an aside."""
    return extract(page, *region([1, wrapper_of(page)])) or extract(page, [], named=False) or ""


def _blocks(node: list, out: list[str], outside: bool, named: bool) -> None:
    for child in node[1]:
        if child is None:
            continue
        if isinstance(child, str):
            text = clean(child)
            if text:
                out.append(text)
        elif not is_aside(child[0] if named else _unnamed(child[0])) and not (outside and _tag(child[0]) == "header"):
            _blocks(child, out, outside and _tag(child[0]) in ("html", "body"), named)


def _unnamed(label: str) -> str:
    return " ".join(w for i, w in enumerate(label.split(" ")) if not i or (w[0] == "@" and w != "@named"))
