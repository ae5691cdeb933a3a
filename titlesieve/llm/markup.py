"""Text lines of a page's markup with a guess at what each is; plain Python for one page."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Words in class, id or role that mark page furniture, and element names (fixed values).
FURNITURE_WORDS = frozenset("""
ad ads advert adverts advertisement adsense advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
notice notices popup modal overlay dialog alert sidebar aside complementary menu menubar nav navbar navigation breadcrumb
breadcrumbs related recommended share sharing social newsletter subscribe subscription signup login search widget pagination
pager toolbar form skip
""".split())
PAGE_ENDS = frozenset("header footer masthead contentinfo colophon".split())
REMARK_WORDS = frozenset("comment comments reply replies disqus respond discussion".split())
FURNITURE_TAGS = frozenset("nav aside form button select menu dialog fieldset datalist".split())
END_TAGS = frozenset("header footer".split())
RAW_TAGS = frozenset("script style title textarea iframe noscript template svg math object canvas audio video xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset("""
address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th
thead tr ul
""".split())
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th article main".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|</?[a-zA-Z!][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[^a-z0-9]+")

FURNITURE, OPEN, PROSE = 0, 1, 2


class Line(NamedTuple):
    text: str
    kind: int  # FURNITURE: never main text; OPEN: main text unless shared, also outside a marked article; PROSE: paragraph of one


class _Element(NamedTuple):
    name: str
    drop: str  # "", "furniture" or "remark"
    main: int  # 2 inside an article, 1 inside a main element


def _dropped(name: str, attributes: str, inside: bool) -> str:
    if name in FURNITURE_TAGS or (name in END_TAGS and not inside):
        return "furniture"
    if not attributes:
        return ""
    words: set[str] = set()
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            words.update(_PART.split(value))
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return "furniture"
    if words & REMARK_WORDS:
        return "remark"
    return "furniture" if words & FURNITURE_WORDS or (words & PAGE_ENDS and not inside) else ""


def lines(page: str) -> list[Line]:
    """Blocks of the page in order. White space in a block is one space, character references are decoded.
    Unclosed and stray tags are tolerated: an end tag closes up to its own start tag if there is one, and an
    article that starts inside open furniture ends it."""
    stack: list[_Element] = [_Element("", "", 0)]
    found: list[tuple[str, str, int, int, str]] = []  # text, drop, main, characters in links, element
    parts: list[str] = []
    linked, at, link = 0, 0, False

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            top = next((e for e in reversed(stack) if e.name in BLOCK_TAGS), stack[-1])
            found.append((text, stack[-1].drop, stack[-1].main, linked, top.name))
        parts.clear()
        linked = 0

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue  # inside raw text
        if m.start() > at:
            parts.append(page[at:m.start()])
            linked += link * (m.start() - at)
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends = bool(m[1] or m[4])
        if name == "br":
            parts.append(" ")
        if name == "a":
            link = not ends
        if name in BLOCK_TAGS:
            close()
        if ends:
            if any(e.name == name for e in stack[1:]):
                while stack.pop().name != name:
                    pass
        elif name in RAW_TAGS:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID_TAGS:
            top = stack[-1]
            if name == "p":  # a paragraph ends the one before it
                while stack[-1].name in ("p", "b", "i", "em", "strong", "span", "a", "u", "small", "font"):
                    stack.pop()
                top = stack[-1]
            drop = _dropped(name, m[3] or m[6] or "", top.main > 0)
            if name in ("article", "main") and not drop and top.drop == "furniture":
                stack.append(_Element(name, "", 2 if name == "article" else 1))
            else:
                main = max(top.main, 2 if name == "article" else 1 if name == "main" else 0)
                stack.append(_Element(name, top.drop or drop, main))
    if at < len(page):
        parts.append(page[at:])
    close()
    level = max((main for _, drop, main, _, _ in found if not drop), default=0)
    out = []
    for text, drop, main, chars, name in found:
        if drop or (level == 0 and 2 * chars > len(text)):
            out.append(Line(text, FURNITURE))
        else:
            out.append(Line(text, PROSE if level and main == level and name in PROSE_TAGS else OPEN))
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places of ``a`` on a longest common subsequence with ``b``. Rows of the table are bits of integers."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)  # bit j clear: the best length grows from b[:j] to b[:j + 1]
    out, i, j = set(), len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.add(i)
    return out
