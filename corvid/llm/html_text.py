"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its text blocks. A block is seen as a vector: hashed tags, classes and ids of its path,
the shares of its hashed words, and a few others (links, stops, length). A bidirectional LSTM reads a page's vectors in both directions
and gives each block its probability of being main text, so a block is judged with the whole page around it.

The network is trained here, on pages that a seeded generator writes with their labels: articles in many kinds of
markup, among menus, headers, sidebars, notices, adverts, forms, comments and footers. Its words are made up but for
stock phrases of the frame around articles. Its names for things are the common ones of web pages, or mean nothing at all.
The weights are kept beside this module; ``python -m corvid.llm.html_text`` trains them again.
"""

from __future__ import annotations

import functools
import hashlib
import html
import math
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_BINS, WORD_BINS, EXTRA = 96, 48, 8
WIDTH = PATH_BINS + WORD_BINS + EXTRA
HIDDEN = 16

# Elements that never close, those whose content is no text (to the page's end where they stay open), those
# that can stand in a head, and those that stay inside a block.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NO_TEXT = "script|style"
_IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr object canvas noscript math annotation menclose mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
#: Elements whose open paragraph ends where they start.
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_LETTER, _NAME_END = re.compile(r"[a-zA-Z]"), re.compile(r"[\s/>]")
_RAW = {tag: (re.compile(rf"{tag}\b", re.I), re.compile(rf"</{tag}\s*>", re.I)) for tag in _NO_TEXT.split("|")}
_MARK, _ANGLE, _TITLE_END, _HEAD_END = re.compile(r"[>\"']"), re.compile(">"), re.compile(r"</title\s*>", re.I), re.compile(r"</head\b|<body\b", re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"\w+")


class _Scanner:
    """Where tags end in a page. What was searched once is not searched again, so that unclosed tags, quotes and titles take linear time."""

    def __init__(self, page: str):
        self.page, self.found, self.dead = page, {}, set()

    def next(self, pattern: re.Pattern, at: int) -> re.Match | None:
        """The first match at or behind a place; places must not fall but by what one tag looks ahead."""
        known = self.found.get(pattern)
        if known is None or at < known[0] or (known[1] is not None and known[1].start() < at):
            known = self.found[pattern] = (at, pattern.search(self.page, at))
        return known[1]

    def tag_end(self, at: int) -> int:
        """Behind the ``>`` that ends a tag, quoted ones left out; -1 if there is none."""
        seen, page = [], self.page
        m = self.next(_MARK, at)
        while m is not None and m.start() not in self.dead:
            if m[0] == ">":
                return m.end()
            seen.append(m.start())
            close = page.find(m[0], m.end())
            m = _MARK.search(page, close + 1) if close >= 0 else None
        self.dead.update(seen)
        return -1

    def piece(self, at: int) -> tuple[int, str | None, bool, str]:
        """(end, name of a tag or null, whether it is an end tag, what stands in it) of the text, tag or comment at a place."""
        page, n = self.page, len(self.page)
        if page[at] != "<":
            end = page.find("<", at)
            return (n if end < 0 else end), None, False, ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return (n if end < 0 else end + 3), None, False, ""
        for starts, ends in _RAW.values():
            if m := starts.match(page, at + 1):
                if (open_ := self.tag_end(m.end())) >= 0:
                    close = self.next(ends, open_)
                    return (n if close is None else close.end()), None, False, ""
        closing = page.startswith("/", at + 1)
        begin = at + 1 + closing
        if _LETTER.match(page, begin):
            stop = self.next(_NAME_END, begin)
            named = n if stop is None else stop.start()
            if (end := self.tag_end(named)) >= 0:
                return end, page[begin:named], closing, page[named : end - 1]
        if page[at + 1 : at + 2] in ("!", "?", "/") and at + 1 < n and (m := self.next(_ANGLE, at + 2)):
            return m.end(), None, False, ""
        return at + 1, None, False, ""

    def title_end(self, at: int) -> int:
        """Behind the rest of a title; an open one ends before the next tag."""
        close, head = self.next(_TITLE_END, at), self.next(_HEAD_END, at)
        if close is not None and (head is None or close.start() < head.start()):
            return close.end()
        end = self.page.find("<", at)
        return len(self.page) if end < 0 else end


def blocks_of(page: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """(path names, text, share of characters in links) of each text block of a page, in order.

    A page begins in its head, which ends at its end tag, at the body, or at text or an element that cannot stand in it.
    """
    out: list = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter = Counter()
    text: list[str] = []
    linked, path, in_link = 0, (), 0
    in_head = True

    def close() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append((path, whole, min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    def pop_to(at: int) -> None:
        nonlocal in_link
        for name, _ in stack[at:]:
            opened[name] -= 1
            in_link -= name == "a"
        del stack[at:]

    page, at_char = page or "", 0
    scanner = _Scanner(page)
    while at_char < len(page):
        began = at_char
        at_char, name, closing, rest = scanner.piece(began)
        if name is None:
            piece = page[began:at_char]
            if piece[0] != "<" or piece == "<":
                if in_head and not piece.strip(" \t\n\f\r\ufeff"):
                    continue
                in_head = False
                if not text:
                    path = tuple(x for tag, names in stack for x in (tag, *names))
                text.append(html.unescape(piece))  # a reference never goes on behind a tag
                if in_link:
                    linked += len(piece.strip())
            continue
        name = name.lower()
        if name == "title" and not closing and not opened["svg"]:
            at_char = scanner.title_end(at_char)
            continue
        if in_head:
            in_head = name in _IN_HEAD and not (closing and name == "head")
            if in_head and name != "html":
                continue
        if name == "head":
            continue
        if closing:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None) if opened[name] else None
            if name not in _INLINE:
                close()
            if at is not None:
                pop_to(at)
        else:
            if name in _INLINE:
                if name == "br" and text:
                    text.append(" ")
            else:
                close()
                if name in _ENDS_P:
                    at = next((k for k, (tag, _) in enumerate(stack) if tag == "p"), None) if opened["p"] else None
                    if at is not None:
                        pop_to(at)
                if name in _SAME and stack and stack[-1][0] in _SAME[name]:
                    pop_to(len(stack) - 1)
            if name not in _VOID:
                names = tuple(w for g in _NAMED.findall(rest) for w in _WORD.findall(re.sub(r"[-_]|(?<=[a-z])(?=[A-Z])", " ", g[0] or g[1] or g[2]).lower())) if rest else ()
                if rest and _HIDDEN.search(rest):
                    names += ("hidden",)
                stack.append((name, names))
                opened[name] += 1
                in_link += name == "a"
    close()
    return out


class _Memo(dict):
    """A bounded memory of a function's results; it travels to executors without them."""

    def __init__(self, function, size: int):
        super().__init__()
        self.function, self.size = function, size

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
        self[key] = value = self.function(key)
        return value

    def __reduce__(self):
        return _Memo, (self.function, self.size)


def _bin(kind: str, word: str, bins: int) -> int:
    return zlib.crc32(f"{kind}:{word}".encode("utf-8", "surrogatepass")) % bins


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    x = np.zeros(PATH_BINS, np.float32)
    for name in path:
        x[_bin("path", name, PATH_BINS)] = 1
    if path:
        x[_bin("leaf", path[-1], PATH_BINS)] += 1
    return x


def _word_bin(word: str) -> int:
    return _bin("word", word.strip(".,;:!?©·|"), WORD_BINS)


_PATHS, _WORDS = _Memo(_path_vector, 20_000), _Memo(_word_bin, 200_000)


def vectors_of(blocks: list) -> np.ndarray:
    x = np.zeros((len(blocks), WIDTH), np.float32)
    for k, (path, text, linked) in enumerate(blocks):
        x[k, :PATH_BINS] = _PATHS[path]
        words = text.lower().split(" ")
        n = len(words)
        x[k, PATH_BINS:-EXTRA] = np.bincount(list(map(_WORDS.__getitem__, words)), minlength=WORD_BINS) * (2 / n)
        x[k, -EXTRA:] = (linked, min(math.log1p(n) / 5, 1.5), n < 4, text[-1] in ".!?", text[0] == "©", min(text.count(".") / n, 1), k / len(blocks), len(blocks) < 6)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """One LSTM a direction over padded pages, and a logistic output; trained by Adam through time."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[d + "x"] = (r.standard_normal((WIDTH, 4 * HIDDEN)) * 0.1).astype(np.float32)
            self.p[d + "h"] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
            self.p[d + "b"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[d + "b"][HIDDEN : 2 * HIDDEN] = 1
        self.p["o"] = (r.standard_normal(2 * HIDDEN) * 0.2).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        z, (n, steps, _), H = x @ self.p[d + "x"] + self.p[d + "b"], x.shape, HIDDEN
        h, c, out, kept = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32), np.zeros((n, steps, H), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[:, t] + h @ self.p[d + "h"]
            s, u, m = _sigmoid(g[:, : 3 * H]), np.tanh(g[:, 3 * H :]), mask[:, t, None]
            new_c = (s[:, H : 2 * H] * c + s[:, :H] * u) * m
            tc = np.tanh(new_c)
            new_h = s[:, 2 * H :] * tc * m
            if keep:
                kept.append((t, h, c, s, u, tc, m))
            h, c = new_h, new_c
            out[:, t] = h
        return out, kept

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(d, x, mask, False)[0] for d in "fb"], 2)
        return _sigmoid(both @ self.p["o"] + self.p["c"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        H, g = HIDDEN, {k: np.zeros_like(v) for k, v in self.p.items()}
        runs = {d: self._run(d, x, mask, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], 2)
        e = (_sigmoid(both @ self.p["o"] + self.p["c"]) - y) * mask / mask.sum()
        g["o"], g["c"] = np.einsum("nt,nth->h", e, both), np.array([e.sum()], np.float32)
        for k, d in enumerate("fb"):
            up = e[:, :, None] * self.p["o"][k * H : (k + 1) * H]
            dz, dh, dc = np.zeros((*x.shape[:2], 4 * H), np.float32), np.zeros((len(x), H), np.float32), np.zeros((len(x), H), np.float32)
            for t, h, c, s, u, tc, m in reversed(runs[d][1]):
                dh = (dh + up[:, t]) * m
                dc = (dc + dh * s[:, 2 * H :] * (1 - tc**2)) * m
                ds = np.concatenate([dc * u, dc * c, dh * tc], 1) * s * (1 - s)
                dz[:, t] = np.concatenate([ds, dc * s[:, :H] * (1 - u**2)], 1)
                g[d + "h"] += h.T @ dz[:, t]
                dh, dc = dz[:, t] @ self.p[d + "h"].T, dc * s[:, H : 2 * H]
            g[d + "x"] = np.tensordot(x, dz, ([0, 1], [0, 1]))
            g[d + "b"] = dz.sum((0, 1))
        return g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, WIDTH), np.float32), np.zeros((len(pages), steps), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
    return x, mask


# Phrases that frames of pages hold, in several languages.
STOCK = [
    "All rights reserved.", "All rights reserved by the publisher.", "Privacy policy", "Terms of use", "Terms and conditions", "Contact us", "About us", "Subscribe to our newsletter", "Follow us", "Read more", "Related articles", "Share this", "Back to top", "Sign in", "Log in", "Search", "Home", "Menu", "Copyright 2024",
    "We use cookies to improve your experience.", "By using this site you agree to our use of cookies.", "Accept all", "Skip to content", "Advertisement", "Sponsored", "Leave a comment", "Most popular", "Alle Rechte vorbehalten.", "Impressum", "Datenschutz", "Kontakt", "Wir verwenden Cookies.", "Tous droits réservés.", "Mentions légales",
    "Politique de confidentialité", "Nous utilisons des cookies.", "Todos los derechos reservados.", "Aviso legal", "Política de privacidad", "Usamos cookies.",
]


def made_page(r: np.random.Generator) -> tuple[str, list[str]]:
    """A page and the texts of its main blocks."""
    pick = lambda *xs: xs[r.integers(len(xs))]
    syllables = [a + b for a in "b d f g k l m n p r s t v z th ch sh é ü".split() for b in "a e i o u en er an on".split()]
    word = lambda: "".join(syllables[k] for k in r.integers(len(syllables), size=r.integers(1, 4)))
    words = lambda a, b: [word() for _ in range(r.integers(a, b))]
    mark = pick("", "", "", "!!", "%%%", "###", "***", "$$$")
    meaningless = r.random() < 0.2  # names tell nothing, and all is in div elements
    code = lambda: pick("c", "css-", "sc-", "x", "el", "b_", "t") + "".join(pick(*"0123456789abcdef") for _ in range(r.integers(1, 6)))

    def sentence(a: int = 4, b: int = 16) -> str:
        w = [x + mark if mark and r.random() < 0.8 else x for x in words(a, b)]
        return " ".join(w).capitalize() + pick(".", ".", ".", "?", "")

    def prose() -> str:
        return " ".join(sentence() for _ in range(r.integers(1, pick(2, 3, 9))))

    def inner(t: str) -> str:
        t = html.escape(t, quote=False)
        return pick("{}", "{}", "{}", "<b>{}</b>", "<em>{}</em>", "{}<br>", "<span>{}</span>", "<a href='#'>{}</a>").format(t) if r.random() < 0.3 else t

    main: list[str] = []

    def body(tag: str, t: str) -> str:
        main.append(t)
        return f"<{tag}>{inner(t)}" + ("" if tag == "p" and r.random() < 0.15 else f"</{tag}>")

    def named(tag: str, *names: str) -> tuple[str, str]:
        kind = pick("class", "class", "id")
        if meaningless:
            return f'<div {kind}="{code()}">', "</div>"
        name = pick(*names)
        return f'<{tag} {kind}="{pick(name, name + "-" + word(), "site-" + name, "main " + name if tag == "div" and name == "content" else name)}">', f"</{tag}>"

    def links(n: int) -> str:
        return pick("<ul>{}</ul>", "{}", "<ol>{}</ol>").format("".join(pick("<li><a href='/{0}'>{0}</a></li>", "<li><a href='/'>{0}</a>", "<a href='/'>{0}</a> | ").format(pick(word().capitalize() + pick("", ","), " ".join(words(1, 4)))) for _ in range(n)))

    def wrapped(tag: str, names: tuple, content: str) -> str:
        a, b = pick((f"<{tag}>", f"</{tag}>"), named("div", *names)) if tag != "div" and not meaningless else named("div", *names)
        return a + content + b

    def boilerplate(kind: str) -> str:
        short, prose_ = sentence(2, 9), prose()
        if r.random() < (0.7 if meaningless else 0.2):
            short, prose_ = pick(*STOCK), " ".join(pick(*STOCK) for _ in range(r.integers(1, 4)))
        if kind == "nav":
            return wrapped("nav", ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc"), links(r.integers(2, 9)))
        if kind == "header":
            return wrapped("header", ("header", "masthead", "banner", "top", "logo"), pick(f"<h1>{short}</h1>", f"<p>{short}</p>", short, f"<a href='/'>{short}</a>") + (links(3) if r.random() < 0.4 else ""))
        if kind == "footer":
            return wrapped("footer", ("footer", "copyright", "colophon", "bottom", "legal"), pick("&copy; {} &middot; {}", "<p>&copy; {}. {}</p>", "<p>{}</p><p>{}</p>", "{} {}", "<small>{} | {}</small>").format(pick("m." + word() + ".com", "2024 " + word(), short), pick(prose_, short)) + (links(3) if r.random() < 0.3 else ""))
        if kind == "aside":
            return wrapped("aside", ("sidebar", "aside", "related", "widget", "recommended", "trending", "popular", "teaser", "newsletter", "author", "tags"), pick(f"<h3>{short}</h3>", "") + pick(links(r.integers(2, 6)), f"<p>{prose_}</p>", f"<p>{prose_}</p><p>{short}</p>"))
        if kind == "ad":
            return wrapped("div", ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"), pick(prose_, short, f"<p>{prose_}</p>", f"<a href='/'>{short}</a>"))
        if kind == "notice":
            return wrapped("div", ("notice", "cookie", "consent", "alert", "gdpr", "popup", "modal", "subscribe", "paywall", "banner"), pick(prose_, f"<p>{prose_}</p>", f"<p>{prose_}</p><button>{word()}</button>", f"<span>{short}</span>"))
        if kind == "form":
            return pick(wrapped("form", ("form", "search", "login", "signup", "subscribe"), f"<label>{short}</label><input><button>{word()}</button>"), f"<form><p>{short}</p><input type='text'><button>{word()}</button></form>")
        if kind == "share":
            return wrapped("div", ("share", "social", "meta", "byline", "tags", "pagination", "tools"), pick(links(3), short))
        return wrapped("section", ("comments", "comment", "replies", "discussion", "reviews", "disqus", "responses"), pick(f"<h2>{short}</h2>", f"<h3>{word()}</h3>", "") + "".join(pick("<div class='comment'><p>{}</p></div>", "<li>{}</li>", "<p>{}</p>", "<div class='reply'><b>{}</b></div>", "<article class='comment'><p>{}</p></article>").format(pick(prose(), sentence())) for _ in range(r.integers(1, 6))))

    def article() -> str:
        parts = [body(pick("h1", "h1", "h2"), sentence(2, 9))] if r.random() < 0.85 else []
        for _ in range(r.integers(1, pick(4, 8, 16))):
            k = r.random()
            if k < 0.78:
                parts.append(body("p", pick(prose(), prose(), prose(), prose(), sentence(1, 3))))
            elif k < 0.84:
                parts.append(body(pick("h2", "h3"), sentence(2, 7)))
            elif k < 0.89:
                parts.append("<ul>" + "".join(body("li", sentence()) for _ in range(r.integers(1, 5))) + "</ul>")
            elif k < 0.92:
                parts.append("<table><tr>" + "".join(body("td", sentence(1, 4)) for _ in range(r.integers(1, 4))) + "</tr></table>")
            elif k < 0.95:
                parts.append("<blockquote>" + body("p", prose()) + "</blockquote>")
            elif k < 0.97:
                parts.append(body("pre", sentence()))
            else:
                parts.append(boilerplate(pick("share", "form") if meaningless else pick("ad", "aside", "share", "notice", "form")))
        if r.random() < 0.3:
            parts.insert(0, "<b>")
        if meaningless:
            a, b = pick(named("div", ""), ("", ""), ("<main>", "</main>"), ("<div>", "</div>"))
            return a + "".join(parts) + b
        a, b = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<section>", "</section>"), ("<div>", "</div>"), ("", ""), named("div", "content", "article", "post", "entry", "story", "main", "body", "text", "page"), named("section", "content", "article", "post"))
        return a + "".join(parts) + b

    def some(p: float, *kinds: str) -> str:
        if meaningless:  # without names, prose of readers, adverts and teasers reads as the article's does
            kinds = tuple({"comments": "share", "ad": "share", "aside": "nav", "notice": "form"}.get(k, k) for k in kinds)
        return "".join(boilerplate(pick(*kinds)) for _ in range(r.integers(1, 3))) if r.random() < p else ""

    page = some(0.4, "header") + some(0.75, "nav") + some(0.3, "notice", "form") + some(0.5, "ad") + some(0.15, "aside")
    page += article() + some(0.2, "share") + some(0.35, "comments") + some(0.3, "aside", "ad") + some(0.2, "form", "notice") + some(0.75, "footer") + some(0.1, "notice", "nav")
    a, b = pick(("", ""), ("", ""), named("div", "page", "wrapper", "container"), ("<div>", "</div>"))
    return f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{}}</style></head><body>{a}{page}{b}</body></html>", main


def made_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of generated pages; a block is main if it is one of the page's main texts."""
    out, r = [], np.random.default_rng(seed)
    while len(out) < n:
        page, main = made_page(r)
        blocks, left = blocks_of(page), {" ".join(t.split()) for t in main}
        if blocks:
            out.append((vectors_of(blocks), np.array([t in left for _, t, _ in blocks], np.float32)))
    return out


#: Where the trained weights are, and the SHA-256 of their numbers in order of name.
WEIGHTS, CHECKSUM = os.path.join(os.path.dirname(os.path.abspath(__file__)), "html_text_weights.npz"), "5edd2829b5352adda940f2cf58a164c3481666ba9c3fea8ed66a11ca31c5503f"


def checksum(weights: dict) -> str:
    return hashlib.sha256(b"".join(np.ascontiguousarray(weights[k], "<f4").tobytes() for k in sorted(weights))).hexdigest()


@functools.lru_cache(1)
def kept() -> BiLSTM:
    """The model with the weights kept beside this module; ValueError where they are not those that were written."""
    with np.load(WEIGHTS) as found:
        weights = {k: found[k] for k in found.files}
    if checksum(weights) != CHECKSUM:
        raise ValueError(f"{WEIGHTS} does not hold the trained weights; train them again")
    model = BiLSTM(0)
    model.p = weights
    return model


def trained(pages: int = 2500, epochs: int = 12, seed: int = 1, batch: int = 32, rate: float = 0.01) -> BiLSTM:
    rows, model, r = made_pages(pages, seed), BiLSTM(seed), np.random.default_rng(seed)
    m, v, n = {k: np.zeros_like(p) for k, p in model.p.items()}, {k: np.zeros_like(p) for k, p in model.p.items()}, 0
    rows.sort(key=lambda row: len(row[1]))
    starts = np.arange(0, len(rows), batch)
    for epoch in range(epochs):
        for s in r.permutation(starts):
            part = rows[s : s + batch]
            x, mask = padded([p[0] for p in part])
            y = np.zeros_like(mask)
            for k, p in enumerate(part):
                y[k, : len(p[1])] = p[1]
            n += 1
            step = rate * (0.5 ** (epoch / 4))
            for k, g in model.gradients(x, mask, y).items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                model.p[k] -= step * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)
    return model


def _extract(model: BiLSTM, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, texts = batch.column(2), [""] * len(batch)
            waiting: list[tuple[int, list, np.ndarray]] = []

            def settle(waiting: list = waiting, texts: list = texts) -> None:
                waiting.sort(key=lambda w: len(w[1]))
                k = 0
                while k < len(waiting):
                    stop = k + 1
                    while stop < len(waiting) and len(waiting[stop][1]) * (stop + 1 - k) <= 4096 and len(waiting[stop][1]) <= 1.3 * len(waiting[k][1]) + 4:
                        stop += 1
                    scores = model.scores(*padded([w[2] for w in waiting[k:stop]]))
                    for (i, blocks, _), s in zip(waiting[k:stop], scores):
                        texts[i] = "\n\n".join(b[1] for b, p in zip(blocks, s) if p >= 0.5)
                    k = stop
                waiting.clear()

            size = 0
            for i in range(len(batch)):
                blocks = blocks_of(column[i].as_py())
                if blocks:
                    waiting.append((i, blocks, vectors_of(blocks)))
                    size += len(blocks)
                    if size >= at_once:
                        settle()
                        size = 0
            settle()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: BiLSTM | None = None, at_once: int = 20_000) -> DataFrame:
    """One row per row of ``pages``: id, url, text (main blocks joined by an empty line), n_chars.

    A null or empty page, or one without main blocks, gives the empty text. Repeated rows and null ids each get their
    row; other columns are ignored, whatever their names. No rows give no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(_extract(model or kept(), at_once), "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


if __name__ == "__main__":
    model = trained()
    np.savez_compressed(WEIGHTS, **model.p)
    print(checksum(model.p))
