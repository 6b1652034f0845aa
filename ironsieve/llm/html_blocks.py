"""Leaf blocks of a page's DOM, with what surrounds them. No tree is kept: one pass with a stack of open elements."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<[!?][^>]*+>|</[^A-Za-z>][^>]*+>|</>|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|(?P<text>[^<]++|<(?![A-Za-z/!?]))""",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|style|itemprop|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Elements that repeat in tables and lists, too.
_NO_ITEM = {"tr", "td", "th", "tbody", "table", "ul", "ol", "dl", "p", "body", "html"}
#: Elements whose content is no markup; unclosed, they last to the end of the page, as in HTML.
RAW = {"script", "style", "textarea", "iframe", "title"}
#: Elements that a block inside them ends, as in HTML.
ENDED_BY_BLOCKS = ("svg", "select")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "html head body p div section article main nav header footer aside form fieldset figure figcaption ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption blockquote pre h1 h2 h3 h4 h5 h6 hr address details summary center dialog "
    "option optgroup button label menu noscript template svg select".split()
)
_IN_SELECT = {"option", "optgroup", "select", "svg"}
#: What an open element says about the text below it: by tag, and by words in its class, id or role.
TAGS = "article main nav header footer aside form li table h p a figure blockquote pre button section div dialog figcaption dl svg select noscript template".split()
WORDS = {
    "content": r"article|content|post|entry|story|body|text|prose|main",
    "ad": r"ads?|advert\w*|sponsor\w*|promo\w*|adsbygoogle|dfp",
    "menu": r"nav\w*|menu\w*|breadcrumbs?|toc|pag\w+|tabs?|tags?",
    "head": r"header|masthead|topbar|logo|branding|hero",
    "foot": r"footer|copyright|colophon|legal|bottom|contentinfo",
    "side": r"complementary|side\w*|aside|widgets?|related|recommend\w*|rail|more|teasers?",
    "comment": r"comments?|replies|reply|disqus|respond|discussion|reviews?|reader\w*",
    "notice": r"cookies?|consent|notice|alert|modal|popup|subscri\w+|newsletter|gdpr|overlay|signup|banner|toast|warning",
    "share": r"share\w*|social|follow|sharing",
    "form": r"search|login|forms?|contact|poll",
    "meta": r"byline|meta|author|date|caption|credit",
    "hidden": r"hidden|invisible|none",
}
_CUES = [(len(TAGS) + i, re.compile(rf"(?:^|[\s_:-])(?:{w})(?:$|[\s_:-])", re.I)) for i, w in enumerate(WORDS.values())]
N_CUES = len(TAGS) + len(WORDS)
_TAG_BIT = {t: 1 << i for i, t in enumerate(TAGS)} | {f"h{i}": 1 << TAGS.index("h") for i in range(1, 7)}
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


@dataclass
class Block:
    """``up``: the element around the block's own; ``item``: the nearest element around the text that has a like sibling
    and holds several blocks, 0 if none."""

    text: str
    cues: int
    link: float
    tag: str
    own: int = 0
    up: int = 0
    item: int = 0


def _cues(tag: str, attrs: str) -> int:
    out = _TAG_BIT.get(tag, 0)
    if attrs:
        if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs):
            out |= 1 << (N_CUES - 1)
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    out |= 1 << (N_CUES - 1)
            elif name == "aria-hidden":
                out |= (1 << (N_CUES - 1)) * (value.lower() == "true")
            else:
                value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value)
                for bit, words in _CUES:
                    if words.search(value):
                        out |= 1 << bit
    return out


def blocks(page: str | None) -> list[Block]:
    """The page's text by leaf blocks: references decoded, white space folded to one space, empty blocks left out."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    likes: Counter[tuple] = Counter()  # elements by parent, tag and class
    like_of: list[tuple] = [()]
    parents = [0]
    opened: dict[str, int] = {}
    parts: list[str] = []
    cues = linked = total = 0
    tag, own_element = "", 0
    memo: dict[tuple[str, str], tuple[int, str]] = {}
    unclosed: set[str] = set()  # no end tag of that name follows

    def flush():
        nonlocal parts, linked, total
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, cues, linked / max(1, total), tag, own_element, parents[own_element]))
            parts, linked, total = [], 0, 0

    def pop(names) -> None:
        while len(stack) > 1:
            name = stack.pop()[0]
            opened[name] -= 1
            if name in names:
                return

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        if m is None:  # an unclosed tag: what is left is no text
            break
        at = m.end()
        text = m["text"]
        if text is not None:
            if not parts:
                if text.isspace():
                    continue
                cues = stack[-1][1]
                tag, own_element = next(((t, e) for t, _, e in reversed(stack) if t in BLOCK), ("", 0))
            parts.append(text)
            total += len(text)
            linked += len(text) * bool(opened.get("a"))
            continue
        name = m["tag"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            if parts:
                parts.append(" ")
            continue
        if name in BLOCK:
            flush()
        if m["end"]:
            if opened.get(name):
                pop({name})
            continue
        attrs = m["attrs"]
        if name in RAW:
            end = None if name in unclosed else re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end is None and opened.get("svg"):  # there, it is no raw text
                unclosed.add(name)
                continue
            at = end.end() if end else size
            continue
        for host in ENDED_BY_BLOCKS:
            if opened.get(host) and name in BLOCK and name not in _IN_SELECT:
                pop({host})
        if name in VOID or attrs.endswith("/") and (name not in BLOCK or name == "svg"):
            continue
        close = _CLOSES.get(name)
        if close and any(opened.get(c) for c in close):
            # only up to the nearest list, table or container
            for depth in range(len(stack) - 1, 0, -1):
                t = stack[depth][0]
                if t in close:
                    pop({t})
                    break
                if t in BLOCK and t not in close:
                    break
        known = memo.get((name, attrs))
        if known is None:
            named = _CLASS.search(attrs) if attrs else None
            known = memo[name, attrs] = _cues(name, attrs), named[1].strip("\"'") if named else ""
        like = (stack[-1][2], name, known[1])
        likes[like] += 1
        stack.append((name, stack[-1][1] | known[0], len(parents)))
        parents.append(like[0])
        like_of.append(like)
        opened[name] = opened.get(name, 0) + 1
    flush()
    held = [0] * len(parents)
    for b in out:
        held[b.own] += 1
    for e in range(len(parents) - 1, 0, -1):
        held[parents[e]] += held[e]
    item = [0] * len(parents)
    for e in range(1, len(parents)):
        fine = held[e] > 1 and likes[like_of[e]] > 1 and like_of[e][1] not in _NO_ITEM
        item[e] = e if fine else item[parents[e]]
    for b in out:
        b.item = item[b.own]
    return out
