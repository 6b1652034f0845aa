"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page's leaf blocks form a chain; each is content or not. Features are what a block's ancestors say (tags, and words in
class, id and role), its text (length, links, marks, the words of short blocks), and where it stands: next to link lists
or long text, how far below a heading and below which, beside the page's longest text, in repeated structures like
threads. Weights and transitions are fitted to labelled pages by maximum likelihood (forward-backward, AdaGrad); the
best labelling is found by Viterbi. Labelled pages are either given as (page, content texts) or composed here in the
``LAYOUTS``, from tag soup with telling classes to bare tables; always the same ones.

Blocks are joined in page order by one newline. ``<br>`` is white space; scripts, styles, titles, text areas, inline
frames and comments in the markup have no text, nothing else is skipped: ``noscript``, ``template``, ``svg`` and ``select`` hold
blocks like other elements, which the field judges. Nulls: null or empty html has the empty text. Broken markup is read
as far as it goes: an unclosed tag ends the page, an unclosed script too, as in HTML; other unclosed elements end with
their parents. Rows are independent: repeated rows give the same text. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ironsieve.llm.html_blocks import N_CUES, TAGS, WORDS, Block, blocks
from ironsieve.llm.textvec import portions

_TEXT = 50
_MAIN = 1 << TAGS.index("article") | 1 << TAGS.index("main")
N_FEATURES = N_CUES + _TEXT
_ASIDE = sum(1 << len(TAGS) + list(WORDS).index(x) for x in ("ad", "side", "comment", "notice", "foot", "form", "hidden"))
EPOCHS, RATE, DECAY, PAGES, BATCH = 12, 0.4, 1e-4, 700, 8
#: Words that short blocks outside of articles are made of, and headings of such parts.
_CHROME = ("©", "copyright", "all rights", "privacy", "terms of", "imprint", "powered by")
_PLEA = ("cookie", "subscribe", "sign up", "signed up", "sign in", "signed in", "log in", "login", "newsletter", "advertisement", "sponsored")
_BAR = re.compile(r"[|·›]")
_OTHER_PART = re.compile(r"^\W*(?:\d+\W+)?(?:comments?|repl(?:y|ies)|responses?|discussion|leave a|related|recommended|see also|more from|read next|share|follow|newsletter|about us|contact|categories|archives?|tags|search|menu|navigation|popular|latest)\b", re.I)


def features(found: Sequence[Block]) -> list[list[int]]:
    """For every block of a page, the numbers of its features that hold."""
    n, base = len(found), N_CUES
    words = [b.text.count(" ") + 1 for b in found]
    listed = [b.link >= 0.9 for b in found]
    long = [w >= 20 and b.link < 0.4 for w, b in zip(words, found, strict=True)]
    framed = any(b.cues & _MAIN for b in found)
    able = [b.link < 0.4 and (bool(b.cues & _MAIN) or not framed) and not b.cues & _ASIDE for b in found]
    tallest = max(range(n), key=lambda k: words[k] * able[k], default=0)
    opens: dict[int, int] = {}
    for k, b in enumerate(found):
        opens.setdefault(b.item, k)
    out, since, other = [], -1, False
    for k, b in enumerate(found):
        f = [i for i in range(N_CUES) if b.cues >> i & 1]
        text, w, tag = b.text, words[k], b.tag
        heading = tag[:1] == "h" and tag[1:].isdigit()
        if heading or w < 5 and _OTHER_PART.search(text):
            since, other = 0, bool(w < 8 and _OTHER_PART.search(text))
        f.append(base + (0 if w < 3 else 1 if w < 8 else 2 if w < 20 else 3 if w < 60 else 4))
        f.append(base + 5 + (0 if b.link == 0 else 1 if b.link < 0.4 else 2 if b.link < 0.9 else 3))
        f.append(base + 9 + (0 if text[-1] in ".!?\"'”»…" else 1 if text[-1] in ":," else 2))
        inside, low = bool(b.cues & _MAIN), text.lower()
        if inside and tag == "p":
            f.append(base + 46)
        if not inside and w < 8 and not heading and text[-1] not in ".!?":
            f.append(base + (47 if k == 0 else 48))
        if any(x in low for x in _CHROME):
            f.append(base + (42 if inside else 12))
        if w < 12 and _BAR.search(text):
            f.append(base + (43 if inside else 13))
        if any(x in low for x in _PLEA):
            f.append(base + (44 if inside else 14))
        f.append(base + 15 + min(3, 4 * k // n))
        if text.count(", ") >= 2:
            f.append(base + 19)
        f.append(base + (20 if tag == "p" else 21 if heading else 22 if tag in ("li", "td", "th", "dt", "dd") else 23))
        if k and listed[k - 1]:
            f.append(base + 24)
        if k + 1 < n and listed[k + 1]:
            f.append(base + 25)
        if k and long[k - 1]:
            f.append(base + 26)
        if k + 1 < n and long[k + 1]:
            f.append(base + 27)
        if b.item:
            first = found[opens[b.item]]
            f.append(base + (30 if first.link >= 0.9 else 29 if first.tag[:1] == "h" else 28))
        f.append(base + (31 if since < 0 else 32 if since < 3 else 33 if since < 9 else 34))
        if other:
            f.append(base + 35)
        if w < 8 and _OTHER_PART.search(text):
            f.append(base + (45 if inside else 36))
        if framed and not inside:
            f.append(base + 37)
        best = found[tallest]
        f.append(base + (38 if b.up == best.up else 39 if b.own == best.up or b.up == best.own else 40))
        if tag == "h1":
            f.append(base + 41)
        if k == tallest and w >= 15:
            f.append(base + 49)
        out.append(f)
        since += since >= 0
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _grids(pages: Sequence[tuple[list[list[int]], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page x block x feature, page x block x state, blocks): what holds in some pages, filled up to equal length."""
    size = np.array([len(page) for page, _ in pages])
    x, own = np.zeros((len(pages), size.max(), N_FEATURES), np.float32), np.zeros((len(pages), size.max(), 2))
    at = [(i, k, f) for i, (page, _) in enumerate(pages) for k, block in enumerate(page) for f in block]
    np.add.at(x, tuple(np.array(at).T), 1)
    for i, (_, labels) in enumerate(pages):
        own[i, np.arange(size[i]), labels] = 1
    return x, own, size


@dataclass
class Field:
    """Emission weights (feature x state) and transitions (from x to); state 1 is content."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, page: Sequence[list[int]]) -> list[int]:
        """The most likely labels (Viterbi); ties go to not content."""
        if not page:
            return []
        # with two states only differences matter
        score = (self.emit[:, 1] - self.emit[:, 0]).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        back = []
        a, b = 0.0, 0.0
        for k, f in enumerate(page):
            e = sum([score[i] for i in f])
            if k:
                to0, to1 = (a + m00, b + m10), (a + m01, b + m11)
                back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
                a, b = max(to0), max(to1)
            b += e
        state = int(b > a)
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]

    def gradient(self, pages: Sequence[tuple[list[list[int]], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood of some pages: observed less expected counts, by forward and backward sums."""
        return self._gradient(*_grids(pages))

    def _gradient(self, x: np.ndarray, own: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, most = len(size), int(size.max())
        e = x @ self.emit
        there = np.arange(most)[None, :] < size[:, None]
        fore, aft = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        fore[:, 0] = e[:, 0]
        for k in range(1, most):
            fore[:, k] = e[:, k] + _lse(fore[:, k - 1, :, None] + self.move, 1)
        for k in range(most - 2, -1, -1):
            step = _lse(self.move + (e[:, k + 1] + aft[:, k + 1])[:, None, :], 2)
            aft[:, k] = np.where(there[:, k + 1, None], step, 0)
        total = _lse(fore[np.arange(n), size - 1], 1)[:, None, None]
        off = (own - np.exp(fore + aft - total)) * there[:, :, None]
        emit = x.reshape(-1, N_FEATURES).T @ off.reshape(-1, 2)
        pair = np.exp(fore[:, :-1, :, None] + self.move + (e + aft)[:, 1:, None, :] - total[..., None])
        seen = own[:, :-1, :, None] * own[:, 1:, None, :]
        return emit, ((seen - pair) * there[:, 1:, None, None]).sum(axis=(0, 1))


def fit(pages: Sequence[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS) -> Field:
    """The mean of the weights after each batch of the second half of the epochs."""
    field = Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    seen = [np.full_like(field.emit, 1e-6), np.full_like(field.move, 1e-6)]
    pages = [x for x in pages if x[0]]
    batches = [_grids(pages[at : at + BATCH]) for at in range(0, len(pages), BATCH)]
    mean, steps = [np.zeros_like(field.emit), np.zeros_like(field.move)], 0
    for epoch in range(epochs):
        for batch in batches:
            for weight, sum_, grad in zip((field.emit, field.move), seen, field._gradient(*batch), strict=True):
                grad = grad / len(batch[2]) - DECAY * weight
                sum_ += grad * grad
                weight += RATE * grad / np.sqrt(sum_)
            if 2 * epoch >= epochs:
                steps += 1
                for sum_, weight in zip(mean, (field.emit, field.move), strict=True):
                    sum_ += weight
    return Field(mean[0] / steps, mean[1] / steps) if steps else field


def labelled(page: str, content: set[str]) -> tuple[list[list[int]], list[int]]:
    """Features and labels of a page whose content blocks' texts are known."""
    found = blocks(page)
    return features(found), [int(b.text in content) for b in found]


#: How composed pages are laid out: which element and class a part gets, and how the parts stand together.
LAYOUTS = ("semantic", "semantic", "classes", "hashed", "bare", "table", "flat", "font", "sections", "roles", "scripted", "nested", "listed", "semantic")
_KINDS = {
    "menu": ("nav nav div ul", "menu nav navbar main-nav breadcrumbs", "navigation"),
    "top": ("header header div", "header masthead site-header topbar", "banner"),
    "foot": ("footer footer div", "footer site-footer copyright", "contentinfo"),
    "side": ("aside aside div section", "sidebar related widget side-bar recommended", "complementary"),
    "advert": ("div div aside section", "ad ads advert sponsored promo ad-slot", "complementary"),
    "notice": ("div div section dialog", "cookie-notice consent notice newsletter alert popup cookie-banner subscribe", "alert"),
    "comments": ("section div ol div", "comments comment-list discussion replies reader-comments", "feed"),
    "article": ("article article article main div section", "content post entry-content article-body story main-content", "main"),
}


def compose_pages(count: int = PAGES, seed: int = 20, layouts: Sequence[str] = LAYOUTS) -> Iterator[tuple[str, set[str]]]:
    """Pages put together from parts of known kind, with the texts of their content blocks, layouts in turn."""
    r = random.Random(seed)
    syllables = "an be cor da el fi gon ha im jo ka lu men no or pa qui re sol ta un ver wa xi yo ze".split()
    unique, layout = [0], [""]

    def words(low: int, high: int) -> str:
        unique[0] += 1
        w = ["".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(r.randint(low, high))]
        w[0] = w[0].capitalize() + str(unique[0])
        for i in range(9, len(w), 9):
            w[i] += r.choice([",", ",", "."])
        return " ".join(w)

    def sentence(low: int, high: int) -> str:
        return words(low, high) + r.choice([".", ".", ".", "!", "?", ""])

    def link(low: int, high: int) -> str:
        return f'<a href="/{r.randrange(99)}">{words(low, high)}</a>'

    def some(low: int, high: int, one) -> str:
        return "".join(one() for _ in range(r.randint(low, high)))

    def hashed() -> str:
        return "".join(r.choices("abcdefgxyz", k=2)) + "".join(r.choices("0123456789abcdef", k=r.randint(3, 6)))

    def part(kind: str, inner: str) -> str:
        """A part in the element that the page's layout gives it."""
        tags, names, role = _KINDS[kind]
        how = layout[0]
        if how == "semantic":
            tag = r.choice(tags.split())
            named = kind in ("advert", "comments") or tag == "div" or r.random() < 0.6
            return f'<{tag} {r.choice(["class", "id", "class"])}="{r.choice(names.split())}">{inner}</{tag}>' if named else f"<{tag}>{inner}</{tag}>"
        if how in ("classes", "scripted") or how == "nested" and r.random() < 0.3:
            return f'<div class="{r.choice(names.split())}">{inner}</div>'
        if how == "roles":
            return f'<div role="{role}">{inner}</div>'
        if how == "table":
            return f"<tr><td{r.choice(['', ' colspan=2', ' valign=top'])}>{inner}</td></tr>"
        if how == "flat":
            return f"{inner}{r.choice(['<hr>', ''])}"
        if how == "font":
            return f"<center>{inner}</center>" if kind != "article" and r.random() < 0.5 else f"<div align=left><font>{inner}</font></div>"
        if how == "sections":
            return f"<section>{inner}</section>"
        if how == "listed":
            return f"<li>{inner}</li>"
        if how == "nested":
            return f"<div><div><div>{inner}</div></div></div>"
        return f'<div class="{hashed()}">{inner}</div>' if how == "hashed" else f"<div>{inner}</div>"

    def menu() -> str:
        kind = r.random()
        if kind < 0.3 or layout[0] in ("font", "table", "flat") and kind < 0.7:
            bar = r.choice([" | ", " · ", " › "])
            inner = bar.join(r.choice([link(1, 2), link(1, 2), words(1, 2)]) if kind < 0.2 else link(1, 3) for _ in range(r.randint(2, 6)))
            inner = r.choice(["<p>{}</p>", "{}", "<small>{}</small>"]).format(inner)
        elif kind < 0.8:
            inner = f"<ul>{some(2, 8, lambda: f'<li>{link(1, 3)}</li>')}</ul>"
        else:
            inner = some(2, 6, lambda: f"<span>{link(1, 3)}</span>")
        return part("menu", inner)

    def plain_menu() -> str:
        """Names without links, which only their shape tells."""
        return part("menu", r.choice([" | ", " · ", " - "]).join(words(1, 2) for _ in range(r.randint(2, 5))))

    def top() -> str:
        return part("top", f"<div>{words(1, 4)}</div>" + r.choice(["", f"<p>{words(3, 9)}</p>"])) + menu() * (r.random() < 0.3)

    def foot() -> str:
        year = f"{r.choice(['Copyright', '&copy;', 'Copyright &copy;'])} {r.randint(1998, 2026)} {words(1, 3)}"
        return part("foot", r.choice([f"<p>{year}</p>", f"<p>&copy; {words(2, 9)}</p>", year, f"&copy; {words(1, 4)} &middot; {sentence(3, 25)}", sentence(4, 30) + " All rights reserved.", f"<ul>{some(2, 6, lambda: f'<li>{link(1, 3)}</li>')}</ul><p>{year}. {sentence(2, 30)}</p>"]))

    def side() -> str:
        name = r.choice([words(1, 4), "Related " + words(1, 2), "Popular", "See also", "Archives"])
        teasers = some(2, 4, lambda: f"<div><h4>{link(2, 6)}</h4><p>{sentence(4, 25)}</p></div>")
        return part("side", f"<h3>{name}</h3>" * (r.random() < 0.6) + r.choice([f"<ul>{some(2, 7, lambda: f'<li>{link(1, 6)}</li>')}</ul>", f"<p>{sentence(5, 40)}</p>", f"<div>{sentence(4, 25)}</div>", teasers]) if layout[0] in ("semantic", "classes", "roles", "scripted") else f"<h3>{name}</h3>" + r.choice([f"<ul>{some(2, 7, lambda: f'<li>{link(1, 6)}</li>')}</ul>", teasers]))

    def advert() -> str:
        inner = r.choice([sentence(3, 30), f"<p>{sentence(3, 40)}</p>", f'<a href="/buy">{words(2, 9)}</a>'])
        if layout[0] not in ("semantic", "classes", "scripted"):
            inner = r.choice([f'<a href="/buy">{words(2, 9)}</a>', f"<p>Advertisement</p><p><a href=/x>{sentence(3, 20)}</a></p>", f"<small>Sponsored</small><div>{link(3, 9)}</div>"])
        return part("advert", inner)

    def notice() -> str:
        plea = r.choice(["We use cookies. ", "Subscribe to our newsletter. ", "Sign in to read more. ", "This site uses cookies, "])
        told = layout[0] in ("semantic", "classes", "scripted") and r.random() < 0.5
        return part("notice", ("" if told else f"<p>{plea}") + sentence(4, 30) + r.choice(["", f"<button>{words(1, 2)}</button>"]))

    def form() -> str:
        choices = f"<select>{some(2, 5, lambda: f'<option>{words(1, 3)}')}</select>" if r.random() < 0.5 else ""
        return f'<form{r.choice(["", " class=search", " id=contact"])}><label>{words(1, 3)}</label><input name=q>{choices}<button>{words(1, 2)}</button>' + r.choice(["", f"<p>{sentence(3, 20)}</p>"]) + "</form>"

    def comments() -> str:
        name = r.choice([words(1, 3), "Comments", f"{r.randint(1, 90)} Comments", "Replies", "Discussion", "Leave a reply"])
        tag, own = r.choice(["div", "div", "li", "section"]), f' class="{hashed()}"' if layout[0] == "hashed" or r.random() < 0.4 else ""
        head = r.choice([lambda: f"<b>{words(1, 2)}</b><p>", lambda: f"<div>{words(1, 3)}</div><p>", lambda: f"<h5>{words(1, 2)}</h5><span>{r.randint(1, 28)}.{r.randint(1, 12)}.2020</span><p>", lambda: f"<p>{words(1, 2)} wrote:</p><p>"])
        told = layout[0] in ("semantic", "classes") and r.random() < 0.2
        if told:
            thread = some(1, 4, lambda: r.choice([f"<li><p>{sentence(3, 50)}</p></li>", f'<div class="comment"><b>{words(1, 2)}</b><p>{sentence(3, 50)}</p></div>', f"<p>{sentence(3, 50)}</p>"]))
        else:
            thread = some(2, 6, lambda: f"<{tag}{own}>{head()}{sentence(3, 60)}</p></{tag}>")
        thread = f"<h3>{name}</h3>" * (r.random() < 0.6) + thread
        return f"<div{own}>{thread}</div>" if layout[0] in ("semantic", "classes") and not told else part("comments", thread)

    def icon() -> str:
        return r.choice(['<svg class="icon"/>', f"<svg><title>{words(1, 2)}</title><path d=x /></svg>", f"<svg><text>{words(1, 2)}</text></svg>", f"<noscript>{sentence(3, 9)}</noscript>" if r.random() < 0.3 else ""])

    for number in range(count):
        layout[0] = layouts[number % len(layouts)]
        content: set[str] = set()

        piped = r.random() < 0.3 and layout[0] in ("semantic", "classes")  # prose with bars between its words

        def own(text: str, content=content, piped=piped) -> str:
            text = text.replace(" ", " | ") if piped else text
            content.add(text)
            return text

        def body_part() -> str:
            kind = r.random()
            if kind < 0.07 and layout[0] in ("semantic", "classes", "scripted", "roles"):  # what footers say, in an article
                return f"<p>{own(r.choice(['All rights reserved.', f'Copyright 2020 {words(1, 3)}.', f'Released under the {words(1, 2)} License.', 'Subscribe to our newsletter.', f'Comments {words(1, 2)}']))}</p>"
            if kind < 0.68:
                text = own(sentence(1, r.choice([8, 40, 120])))
                if layout[0] in ("font", "bare", "hashed") and r.random() < 0.5:
                    return f"<div>{text}</div>"
                return r.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>", f"<p>{text}</p>"])
            if kind < 0.78:
                return f"<h{(n := r.randint(2, 4))}>{own(words(1, 8))}</h{n}>"
            if kind < 0.86:
                return f"<ul>{some(1, 4, lambda: f'<li>{own(sentence(1, 20))}</li>')}</ul>"
            if kind < 0.9:
                return f"<blockquote>{own(sentence(4, 40))}</blockquote>"
            if kind < 0.93:
                return f"<pre>{own(words(3, 20))}</pre>"
            if kind < 0.96:
                return f"<table>{some(1, 3, lambda: f'<tr><td>{own(words(1, 5))}</td><td>{own(words(1, 5))}</td></tr>')}</table>"
            return f"<figure><img src=x><figcaption>{own(words(3, 12))}</figcaption></figure>"

        title = own(words(1, 12) + r.choice(["", "", ".", ".***", "&&&"]))
        inner = f"<h1>{title}</h1>" if r.random() < 0.85 else ""
        told = layout[0] in ("semantic", "classes", "roles", "scripted", "sections")
        if not told:  # nothing but the text tells
            inner += f"<p>{own(sentence(25, 120))}</p>"
        short = r.random() < 0.15 and layout[0] in ("semantic", "classes", "roles")  # a word or two
        if short:
            inner += f"<p>{r.choice([title, own(words(1, 3) + r.choice(['.', '', '***', '&&&', '.###']))])}</p>"
        for _ in range(0 if short else r.randint(int(told), r.choice([2, 9, 14]))):
            inner += f"<section><h2>{own(words(1, 6))}</h2>{some(1, 3, body_part)}</section>" if layout[0] == "sections" and r.random() < 0.5 else body_part()
            if r.random() < 0.1:
                inner += r.choice([advert, side, notice, form])() if layout[0] in ("semantic", "classes") else r.choice([advert, form])() if layout[0] not in ("table", "listed") else ""
        if r.random() < 0.3 and layout[0] not in ("table", "listed"):
            inner += comments()
        article = part("article", inner)
        if layout[0] == "scripted":
            article = r.choice(["<noscript>{}</noscript>", "<template>{}</template>", "<div>{}</div>"]).format(article)
        if layout[0] == "semantic" and article.startswith("<article") and r.random() < 0.3:
            article = f"<main>{article}</main>"
        bare = layout[0] not in ("semantic", "classes", "roles")
        before = some(1, 4, lambda: r.choice([menu, menu, top, top, advert, notice, form, side, *[plain_menu] * (2 * bare)])())
        after = some(0, 3, lambda: r.choice([foot, side, comments, menu, advert, notice, form])()) + foot() * (r.random() < 0.9)
        if short:
            before += part("advert", sentence(12, 40))
        if r.random() < 0.3:
            before = icon() + before
        whole = f"{before}{article}{after}"
        if layout[0] == "table":
            whole = f"<table>{whole}</table>"
        elif layout[0] == "listed":
            whole = f"<ul>{whole}</ul>"
        yield f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title><script>var t='</p>';</script></head><body>{whole}</body></html>", content


@functools.cache
def composed_field() -> Field:
    """The field fitted to the composed pages."""
    return fit([labelled(page, content) for page, content in compose_pages()])


def main_text(field: Field, page: str | None) -> str:
    found = blocks(page)
    labels = field.decode(features(found))
    return "\n".join(b.text for b, keep in zip(found, labels, strict=True) if keep)


def extract_main_text(
    pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars) for every row of ``pages``."""
    held = pages.sparkSession.sparkContext.broadcast(field or composed_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(held.value, x) for _, pages in portions(b.column(2)) for x in pages]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                [id_col, url_col, "text", "n_chars"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long"
    )
