"""Main-text extraction (operator 1) by a recurrent block labeller.

A page is cut into leaf blocks: the text between borders of block elements, with the path of open elements above it.
Each block is read as a vector of its tag path (hashed names, classes and ids), of its hashed words and of a few plain
measures (length, share of linked text, punctuation, digits). A bidirectional LSTM in numpy runs over the whole sequence
of a page's blocks and says of each whether it belongs to the article, so every block is judged in the context of the
whole document.

The model is trained here, at the start, from pages that ``training_page`` makes up: layouts, class names and
languages of many kinds around invented prose, with their true labels (a fixed seed, so every run has the same
model). It is a few hundred kilobytes and is sent to the executors once.

Text: character references decoded, white space inside a block turned into one space, blocks trimmed and joined in page
order by two line feeds; scripts, styles, templates and comments have no text; ``br`` is white space.

Defined cases: null or empty html, and html without an article, give an empty text with n_chars 0; broken markup is
read as browsers do in spirit: unclosed paragraphs and list items close themselves, stray end tags are ignored, a head
ends at the first text or element that doesn't belong there, an element without text of its own (noscript, select, object,
svg, ...) that is never closed hides nothing; only a script or style that is never closed takes the rest of the page, as
it does in browsers. A page without any markup is one block; very long and deep pages take time and memory in
proportion to their length (the LSTM runs over segments with its states carried over); equal probabilities need no
order; repeated rows are read each. Only page_id, url and html are read.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, pieces, table

PATH, WORDS, PLAIN, HIDDEN = 192, 32, 10, 24
INPUTS = PATH + WORDS + PLAIN
PAGES, EPOCHS, SEED = 2500, 8, 11
#: Shrinks weights at each step, and the share of pages whose words or names are hidden: layouts count, not vocabulary.
DECAY, HIDE_WORDS, HIDE_NAMES = 1e-4, 0.3, 0.01

_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[/!?])")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
#: Elements whose content is no text of the page; those of the second set break a block, the third swallow a page that doesn't end them.
_HIDDEN = {"script", "style", "template", "noscript", "svg", "math", "iframe", "object", "textarea", "select", "title"}
_BREAKING, _SWALLOWING = {"script", "style", "template", "title"}, {"script", "style"}
_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "link", "meta"}
#: An element of the left closes open ones of the right.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    """An open block element under its parent, with the hashed names of both: a block costs one link, however deep."""

    __slots__ = ("up", "element", "own", "open")

    def __init__(self, up: Node | None, element: str) -> None:
        self.up, self.element = up, element
        self.own = 0
        for w in set(_NAME.findall(element)):
            self.own |= 1 << _name_bucket[w]
        self.open = self.own | (up.open if up else 0)


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node | None, text: str, linked: int) -> None:
        self.node, self.text, self.linked = node, text, linked

    @property
    def path(self) -> tuple[str, ...]:
        """The open block elements, outermost first."""
        out, node = [], self.node
        while node:
            out.append(node.element)
            node = node.up
        return tuple(reversed(out))


def tags_of(html: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, stop, closing, name, attributes) of each tag in order (no name: a comment or declaration), in linear time.
    Resumes where the receiver sends it. Quotes guard ``>`` until one is never closed; from there on they don't."""
    at, loose = 0, False
    while True:
        m = _OPEN.search(html, at)
        if not m:
            return
        name, after = m.group(2), m.end()
        if name is None and m.group().endswith("--"):
            end = html.find("-->", after)
            stop = len(html) if end < 0 else end + 3
        else:
            end = -1
            if name is not None and not loose:
                end = _ATTRIBUTES.match(html, after).end()
                if not html.startswith(">", end):
                    end, loose = -1, True
            end = end if end >= 0 else html.find(">", after)
            if end < 0:
                return
            stop = end + 1
        at = (yield m.start(), stop, bool(m.group(1)), name and name.lower(), html[after : stop - 1]) or stop


class _Ends:
    """Where an element's end tags are, looked up once for each name."""

    def __init__(self, html: str) -> None:
        self.html, self.found = html, {}

    def after(self, name: str, at: int) -> int:
        """The place behind the first end tag from ``at`` on; -1 if there is none."""
        if name not in self.found:
            self.found[name] = [(m.start(), m.end()) for m in re.compile(rf"</{name}\s*>", re.I).finditer(self.html)]
        own = self.found[name]
        k = bisect_left(own, (at, 0))
        return own[k][1] if k < len(own) else -1


def blocks_of(html: str) -> list[Block]:
    """The leaf blocks of a page, in order, in time in proportion to its length."""
    out: list[Block] = []
    stack: list[tuple[str, Node | None, int]] = []  # (tag, innermost block element, place of that in the stack)
    parts: list[str] = []
    open_tags: Counter = Counter()
    ends, linked, at, head = _Ends(html), 0, 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(stack[-1][1] if stack else None, text, linked))
        linked = 0

    def close(k: int) -> None:
        for t, _, _ in stack[k:]:
            open_tags[t] -= 1
        del stack[k:]

    tags, resume = tags_of(html), None
    while True:
        try:
            start, stop, closing, name, attributes = tags.send(resume)
        except StopIteration:
            break
        resume = None
        if start > at:
            piece = html[at:start]
            head = head and not piece.strip()
            if not head:
                parts.append(piece)
                linked += len(piece) if open_tags["a"] else 0
        at = stop
        if name is None:
            continue
        if name in _HIDDEN and not closing:
            if name in _BREAKING:
                flush()
            if not attributes.endswith("/"):
                end = ends.after(name, stop)
                if end >= 0 or name in _SWALLOWING:
                    at = resume = end if end >= 0 else len(html)
            head = head and name in _HEAD
            continue
        if name == "head":
            head = not closing
            flush()
            continue
        head = head and (closing or name in _HEAD)
        if name == "br":
            parts.append(" ")
            continue
        if name not in _INLINE:
            flush()
        if closing:
            if open_tags[name]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name in _VOID:
            continue
        if name not in _INLINE and stack and stack[-1][2] >= 0:
            top = stack[-1][2]
            over, closes = stack[top][0], _CLOSES.get(name)
            if over == "p" or over in _HEADINGS and name in _HEADINGS or closes and over in closes:
                close(top)
        if attributes.endswith("/"):
            continue
        up, top = stack[-1][1:] if stack else (None, -1)
        if name not in _INLINE:
            names = _NAMED.findall(attributes) if "=" in attributes else ()
            up, top = Node(up, f"{name} {' '.join(x for n in names for x in n if x).lower()}" if names else name), len(stack)
        stack.append((name, up, top))
        open_tags[name] += 1
    if at < len(html) and not (head and not html[at:].strip()):
        parts.append(html[at:])
        linked += len(html) - at if open_tags["a"] else 0
    flush()
    return out


class _Buckets(dict):
    """crc32 of a word, modulo; bounded."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        k = self[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % self.n
        return k


_name_bucket = _Buckets(PATH // 2)


def _bits(values: list[int]) -> np.ndarray:
    """Whole numbers of PATH // 2 bits as rows of noughts and ones."""
    size = PATH // 16
    raw = np.frombuffer(b"".join(v.to_bytes(size, "little") for v in values), np.uint8).reshape(-1, size)
    return np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)


class Reader:
    """Blocks as vectors."""

    def __init__(self) -> None:
        self.words = _Buckets(WORDS)

    def page(self, blocks: list[Block], first: int = 0, of: int | None = None) -> np.ndarray:
        """One row a block; these are blocks ``first``... of a page of ``of``. The path's first half has the names of the
        element nearest to the text, the second half the names of all that are open."""
        n = len(blocks)
        x = np.zeros((n, INPUTS), np.float32)
        if not n:
            return x
        owner, bucket, plain = [], [], []
        for k, b in enumerate(blocks):
            own = b.text.lower().split()
            bucket += [self.words[w] for w in own]
            owner += [k] * len(own)
            t, size = b.text, len(b.text)
            stops = t.count(".") + t.count("!") + t.count("?") + t.count("。")
            plain.append((min(len(own), 200) / 50, np.log1p(size) / 5, min(1.0, b.linked / size), min(stops / 3, 2.0), min(10 * t.count(",") / size, 0.5), t[-1] in ".!?:;\"'”。", t[0].isupper(), len(own) < 4, sum(map(t.count, "©»›·")) > 0, (first + k + 1) / (of or n)))
        x[:, : PATH // 2] = _bits([b.node.own if b.node else 0 for b in blocks])
        x[:, PATH // 2 : PATH] = _bits([b.node.open if b.node else 0 for b in blocks])
        x[:, PATH + WORDS :] = plain
        hashed = np.bincount(np.array(owner) * WORDS + np.array(bucket), minlength=n * WORDS).reshape(n, WORDS)
        x[:, PATH : PATH + WORDS] = hashed / np.maximum(1, np.sqrt((hashed**2).sum(axis=1, keepdims=True)))
        return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """A bidirectional LSTM over a page's blocks and a logistic output. Weights: w[direction] (inputs + hidden + 1 by
    4 x hidden: input, forget, output gate and candidate), out (2 x hidden + 1)."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        rows = INPUTS + HIDDEN + 1
        self.w = [(rng.standard_normal((rows, 4 * HIDDEN)) * 0.12).astype(np.float32) for _ in range(2)]
        for w in self.w:
            w[-1, HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        self.out = (rng.standard_normal(2 * HIDDEN + 1) * 0.2).astype(np.float32)

    def _run(self, w: np.ndarray, x: np.ndarray, alive: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x[step, page, inputs] -> h[step, page, hidden]; ``alive[step]`` pages (the first ones) have this step."""
        steps, pages = x.shape[:2]
        gates = x.reshape(-1, INPUTS) @ w[:INPUTS] + w[-1]
        gates = gates.reshape(steps, pages, -1)
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        recurrent = w[INPUTS:-1]
        for t in range(steps):
            n = alive[t]
            z = gates[t, :n] + h[:n] @ recurrent
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new = f * c[:n] + i * g
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((n, h[:n].copy(), c[:n].copy(), i, f, o, g, tanh))
            c[:n] = new
            h[:n] = o * tanh
            out[t, :n] = h[:n]
        return out

    @staticmethod
    def _pack(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pages (longest first) forward and backward, and how many are alive at each step."""
        n = np.array([len(p) for p in pages])
        x, back = np.zeros((n.max(), len(pages), INPUTS), np.float32), np.zeros((n.max(), len(pages), INPUTS), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], back[: len(p), k] = p, p[::-1]
        return x, back, (n[None, :] > np.arange(n.max())[:, None]).sum(axis=1), n

    def predict(self, pages: list[np.ndarray], cells: int = 3000) -> list[np.ndarray]:
        """Probability that each block of each page is article text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: -len(pages[k]))
        at = 0
        while at < len(order):
            own = order[at : at + max(1, cells // len(pages[order[at]]))]
            at += len(own)
            x, back, alive, n = self._pack([pages[k] for k in own])
            h, r = self._run(self.w[0], x, alive), self._run(self.w[1], back, alive)
            for j, k in enumerate(own):
                both = np.concatenate((h[: n[j], j], r[: n[j], j][::-1]), axis=1)
                out[k] = _sigmoid(both @ self.out[:-1] + self.out[-1])
        return out

    def predict_long(self, reader: Reader, blocks: list[Block], steps: int = 3000) -> np.ndarray:
        """``predict`` for one page of any length, in segments of ``steps`` blocks: states are carried over both ways, and
        only the hidden values of all blocks are held."""
        n = len(blocks)
        hidden = np.zeros((n, 2 * HIDDEN), np.float32)
        spans = [(a, min(a + steps, n)) for a in range(0, n, steps)]
        for side, order in enumerate((spans, spans[::-1])):
            h, c, recurrent = np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), self.w[side][INPUTS:-1]
            for a, b in order:
                gates = reader.page(blocks[a:b], a, n) @ self.w[side][:INPUTS] + self.w[side][-1]
                out = hidden[a:b, side * HIDDEN : (side + 1) * HIDDEN]
                for t in range(b - a - 1, -1, -1) if side else range(b - a):
                    z = gates[t] + h @ recurrent
                    s = _sigmoid(z[: 3 * HIDDEN])
                    c = s[HIDDEN : 2 * HIDDEN] * c + s[:HIDDEN] * np.tanh(z[3 * HIDDEN :])
                    h = s[2 * HIDDEN :] * np.tanh(c)
                    out[t] = h
        return _sigmoid(hidden @ self.out[:-1] + self.out[-1])

    def label(self, reader: Reader, found: list[list[Block]], steps: int = 3000) -> list[np.ndarray]:
        """Probabilities for the blocks of pages; long pages one by one."""
        short = [k for k, own in enumerate(found) if len(own) <= steps]
        out = [np.zeros(0)] * len(found)
        for at in range(0, len(short), 200):
            own = short[at : at + 200]
            for k, p in zip(own, self.predict([reader.page(found[k]) for k in own], steps)):
                out[k] = p
        for k, own in enumerate(found):
            if len(own) > steps:
                out[k] = self.predict_long(reader, own, steps)
        return out

    def gradient(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> list[np.ndarray]:
        """Of the mean log loss over all blocks, for (w[0], w[1], out)."""
        order = sorted(range(len(pages)), key=lambda k: -len(pages[k]))
        pages, labels = [pages[k] for k in order], [labels[k] for k in order]
        x, back, alive, n = self._pack(pages)
        kept: list[list] = [[], []]
        h = [self._run(self.w[0], x, alive, kept[0]), self._run(self.w[1], back, alive, kept[1])]
        dh = [np.zeros_like(h[0]), np.zeros_like(h[1])]
        dout, total = np.zeros_like(self.out), n.sum()
        for j, y in enumerate(labels):
            both = np.concatenate((h[0][: n[j], j], h[1][: n[j], j][::-1]), axis=1)
            d = (_sigmoid(both @ self.out[:-1] + self.out[-1]) - y) / total
            dout[:-1] += d @ both
            dout[-1] += d.sum()
            dh[0][: n[j], j] = d[:, None] * self.out[:HIDDEN]
            dh[1][: n[j], j] = (d[:, None] * self.out[HIDDEN:-1])[::-1]
        grads = []
        for side, inputs in enumerate((x, back)):
            w, g = self.w[side], np.zeros_like(self.w[side])
            dn, dc = np.zeros((len(pages), HIDDEN), np.float32), np.zeros((len(pages), HIDDEN), np.float32)
            for t in range(len(alive) - 1, -1, -1):
                m, h0, c0, i, f, o, cand, tanh = kept[side][t]
                d = dh[side][t, :m] + dn[:m]
                c = dc[:m] + d * o * (1 - tanh**2)
                dz = np.concatenate((c * cand * i * (1 - i), c * c0 * f * (1 - f), d * tanh * o * (1 - o), c * i * (1 - cand**2)), axis=1)
                g[:INPUTS] += inputs[t, :m].T @ dz
                g[INPUTS:-1] += h0.T @ dz
                g[-1] += dz.sum(axis=0)
                dn[:m], dc[:m] = dz @ w[INPUTS:-1].T, c * f
            grads.append(g)
        return [*grads, dout]


# -- pages to learn from ---------------------------------------------------------------------------------------------

_MAIN = ["article", "main", "div content", "div post", "div entry", "div story", "div article", "div text", "section article", "div body", "div main", "article post", "div container", "div", "td content", "article", "article entry"]
_BOILER = {
    "menu": ["nav", "nav menu", "div menu", "ul nav", "div navbar", "div navigation", "div topbar", "div breadcrumb", "header", "header nav"],
    "header": ["header", "div header", "div masthead", "div top", "div banner", "header site"],
    "side": ["aside", "aside sidebar", "div sidebar", "div widget", "div related", "section related", "div rail", "div recommended", "div trending", "div more"],
    "ad": ["div ad", "div ads", "div advert", "div promo", "div sponsor", "div sponsored", "aside ad", "div banner", "ins ad", "div advertisement"],
    "notice": ["div cookie", "div notice", "div consent", "div modal", "div alert", "div gdpr", "section notice", "div popup", "div overlay", "div paywall"],
    "form": ["form", "form search", "form login", "div newsletter", "form subscribe", "div signup", "form comment"],
    "comments": ["section comments", "div comments", "div comment", "ul comments", "div replies", "div discussion", "ol commentlist", "aside comments", "div responses"],
    "footer": ["footer", "div footer", "div copyright", "footer site", "div legal", "div bottom", "div colophon"],
    "share": ["div share", "div social", "ul tags", "div meta", "div byline", "div pagination", "div toolbar"],
}
_SAID = {
    "menu": "Home News About Contact Sports Login Products Start Accueil Inicio Kontakt".split(),
    "notice": "We use cookies to improve your experience. Accept all cookies|This site uses cookies, see our privacy policy.|Wir verwenden Cookies. Alle akzeptieren|Subscribe to read the full story.".split("|"),
    "footer": "© 2024 All rights reserved.|Terms of use · Privacy|Impressum | Datenschutz|Copyright the authors.".split("|"),
    "form": "Sign up for our newsletter|Your email|Search|Submit|Password|Leave a reply".split("|"),
    "share": "Share this|Tweet|By the editors|Tags:|Next page|3 min read".split("|"),
    "comments": "Comments|Reply|12 comments|Report".split("|"),
    "side": "Related articles|Most read|You may also like|Archive".split("|"),
    "ad": "Advertisement|Sponsored|Buy now|Special offer!".split("|"),
    "header": "The Daily|Your trusted source|Menu".split("|"),
}


#: Odd kinds of prose that whole articles are made of.
_STYLES = ["plain", "plain", "marks", "loud", "same", "bars"]


class _Writer:
    """Makes up a page: html and, block by block, whether it is article text."""

    def __init__(self, rng: random.Random) -> None:
        self.rng, self.html, self.labels = rng, [], []
        self.style = rng.choice(_STYLES) if rng.random() < 0.25 else "plain"
        self.syllables = ["".join(rng.choice("bcdfghklmnprstvwzéäñ") + rng.choice("aeiouéèöó") for _ in range(rng.randint(1, 2))) + rng.choice(["", "n", "r", "s", "t", ""]) for _ in range(60)]

    def word(self) -> str:
        return "".join(self.rng.choice(self.syllables) for _ in range(self.rng.choice((1, 1, 2, 2, 3))))

    def prose(self, sentences: int) -> str:
        out = []
        if self.rng.random() < 0.02:
            self.style = self.rng.choice(_STYLES)
        for _ in range(sentences):
            words = [self.word() + ("," if self.rng.random() < 0.08 else "") for _ in range(self.rng.choice((1, 2, 4, 9, 16)))]
            if self.style == "marks":
                words = [w + self.rng.choice(["###", "&&&", "%%%", "$$$", "***"]) for w in words]
            elif self.style == "loud":
                words = [w.upper() + "!!" for w in words]
            elif self.style == "same":
                words = words[:1] * len(words)
            out.append((" | " if self.style == "bars" else " ").join(words).capitalize() + self.rng.choice(["."] * 6 + ["?", "!", " |", ""]))
        return " ".join(out)

    def open(self, kind: str) -> str:
        tag, *names = kind.split()
        self.html.append(f'<{tag} {self.rng.choice(("class", "class", "id"))}="{" ".join(names)}{self.rng.choice(("", "", " wide", "-box", " c1", " block"))}">' if names else f"<{tag}>")
        return tag

    def say(self, text: str, main: bool, inside: str = "") -> None:
        text = escape(text)
        if self.rng.random() < 0.1 and " " in text:
            a, b = text.split(" ", 1)
            text = f"<b>{a}</b> {b}" if self.rng.random() < 0.6 else f'<a href="/x">{a}</a> {b}'
        close = f"</{inside}>" if inside and not (inside in ("p", "li") and self.rng.random() < 0.15) else ""
        self.html.append((f"<{inside}>" if inside else "") + text + close)
        self.labels.append(main)

    def boiler(self, kind: str) -> None:
        r = self.rng
        tag = self.open(r.choice(_BOILER[kind])) if r.random() < 0.93 else self.open(r.choice(["div", "section"]))
        said = _SAID[kind]
        if kind == "menu" or kind == "side" and r.random() < 0.6:
            if kind == "side" and r.random() < 0.7:
                self.say(r.choice(said), False, r.choice(["h3", "h4", "p", "div"]))
            lists = r.random() < 0.8
            if lists:
                self.html.append("<ul>")
            for _ in range(r.randint(2, 9)):
                text = r.choice(said) if r.random() < 0.3 and kind == "menu" else " ".join(self.word() for _ in range(r.choice((1, 1, 1, 2, 6))))
                self.html.append(f'<li><a href="/{r.random()}">{escape(text)}</a></li>' if lists else f'<div><a href="/{r.random()}">{escape(text)}</a></div>')
                self.labels.append(False)
            if lists:
                self.html.append("</ul>")
        elif kind == "comments":
            if r.random() < 0.8:
                self.say(r.choice(said), False, r.choice(["h2", "h3", "div"]))
            for _ in range(r.randint(1, 5)):
                inner = self.open(r.choice(["div comment", "li comment", "div", "article comment", "div reply"]))
                if r.random() < 0.6:
                    self.say(self.word().capitalize(), False, r.choice(["h4", "div"]))
                for _ in range(r.randint(1, 2)):
                    self.say(self.prose(r.randint(1, 5)), False, r.choice(["p", "p", "div"]))
                self.html.append(f"</{inner}>")
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                self.say(r.choice(said) if r.random() < 0.7 else self.prose(1), False, r.choice(["p", "div", "h3", "button"]))
        else:
            for _ in range(r.randint(1, 3)):
                text = r.choice(said) if r.random() < 0.5 else self.prose(r.randint(1, 3))
                self.say(text, False, r.choice(["p", "p", "div", "span", "h3", "h2"]) if r.random() < 0.75 and kind != "share" else r.choice(["p", "div"]))
                if self.html[-1].startswith("<span"):
                    self.html.append("<div></div>")  # a border, so that the next text is a block of its own
        self.html.append(f"</{tag}>")

    def article(self) -> None:
        r = self.rng
        kind = r.choice(_MAIN)
        tags = [self.open(kind)]
        while r.random() < 0.25:
            tags.append(self.open(r.choice(["div", "section", "div inner", "div text", "div body"])))
        if r.random() < 0.8:
            self.say(self.prose(1).rstrip(".?!"), True, r.choice(["h1", "h1", "h2"]))
        bare = r.random() < 0.08
        for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 14, 25))) if r.random() < 0.97 else ():
            x = r.random()
            if x < 0.84:
                self.say(self.prose(r.choice((1, 1, 1, 2, 4, 8))), True, "p" if not bare else "div")
            elif x < 0.89:
                self.say(self.prose(1).rstrip(".?!"), True, r.choice(["h2", "h3"]))
            elif x < 0.93:
                self.html.append("<ul>")
                for _ in range(r.randint(1, 4)):
                    self.say(self.prose(1), True, "li")
                self.html.append("</ul>")
            elif x < 0.96:
                self.say(self.prose(r.randint(1, 3)), True, "blockquote")
            elif x < 0.98:
                self.boiler(r.choice(["ad", "share", "side", "form"]))
            else:
                self.html.append("<p><b>" + escape(self.prose(1)) + "<br>")
                self.labels.append(True)
                self.say(self.prose(2), True, "p")
        if len(self.labels) == 0 or not self.labels[-1]:
            self.say(self.prose(2), True, "p")
        for tag in reversed(tags):
            self.html.append(f"</{tag}>")

    def page(self) -> tuple[str, list[bool]]:
        r = self.rng
        self.html.append(f"<!DOCTYPE html><html><head><title>{escape(self.prose(1))}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
        if r.random() < 0.04:
            self.html = ["<html><body>"]
            for _ in range(r.randint(1, 5)):
                self.say(self.prose(r.randint(1, 6)), True, "p")
            return "".join(self.html), self.labels
        wrap = self.open(r.choice(["div wrapper", "div page", "div", "div container"])) if r.random() < 0.35 else ""
        for kind in ("header", "menu", "notice", "ad", "side"):
            if r.random() < {"header": 0.45, "menu": 0.8, "notice": 0.25, "ad": 0.5, "side": 0.15}[kind]:
                self.boiler(kind)
        if r.random() < 0.97:
            self.article()
        for kind in ("share", "ad", "comments", "side", "form", "notice", "footer"):
            if r.random() < {"share": 0.3, "ad": 0.25, "comments": 0.4, "side": 0.4, "form": 0.25, "notice": 0.1, "footer": 0.85}[kind]:
                self.boiler(kind)
        if wrap:
            self.html.append(f"</{wrap}>")
        self.html.append("</body></html>" if r.random() < 0.9 else "")
        return "".join(self.html), self.labels


def training_page(seed: int) -> tuple[list[Block], np.ndarray]:
    """Blocks of a made-up page and their labels; a page whose markup merged blocks is made up anew."""
    while True:
        html, labels = _Writer(random.Random(seed)).page()
        blocks = blocks_of(html)
        if len(blocks) == len(labels):
            return blocks, np.array(labels, np.float32)
        seed += 1_000_003


def _hidden(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A page's vectors, at times without its words or without some names."""
    words, names = rng.random(2)
    if words >= HIDE_WORDS and names >= HIDE_NAMES:
        return x
    x = x.copy()
    if words < HIDE_WORDS:
        x[:, PATH : PATH + WORDS] = 0
    if names < HIDE_NAMES:
        x[:, :PATH] *= np.tile(rng.random(PATH // 2) < 0.6, 2)
    return x


@lru_cache(maxsize=2)
def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """Adam on made-up pages; the same seed gives the same model, made once in a driver's life."""
    reader, model = Reader(), Labeller(seed)
    made = [training_page(seed * 100_000 + k) for k in range(pages)]
    made = [(b, y) for b, y in made if b]
    x, y = [reader.page(b) for b, _ in made], [y for _, y in made]
    params = [model.w[0], model.w[1], model.out]
    m, v, step, size = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, 30
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        by_length = sorted(rng.permutation(len(x)).tolist(), key=lambda k: len(x[k]))
        groups = [by_length[at : at + size] for at in range(0, len(by_length), size)]
        rng.shuffle(groups)
        rate = 0.012 * 0.7**epoch
        for own in groups:
            step += 1
            for p, g, a, b in zip(params, model.gradient([_hidden(x[k], rng) for k in own], [y[k] for k in own]), m, v):
                a[:], b[:] = 0.9 * a + 0.1 * g, 0.995 * b + 0.005 * g * g
                p *= 1 - DECAY
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.995**step)) + 1e-7)
    return model


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks and n_kept for each row of ``pages``."""
    bounded_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model or train())  # some 100 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, reader = sent.value, Reader()
        for batch in batches:
            for part in pieces(batch, "html"):
                found = [blocks_of(h) if h else [] for h in part.column("html").to_pylist()]
                labels = labeller.label(reader, found)
                kept = [[b.text for b, p in zip(own, probability) if p >= 0.5] for own, probability in zip(found, labels)]
                texts = ["\n\n".join(k) for k in kept]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int64()), pa.array([len(k) for k in kept], pa.int64())],
                    ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_kept long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
