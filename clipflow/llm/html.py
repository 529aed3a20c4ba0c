"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its blocks: stretches of text between block-level tags. A bidirectional LSTM reads for
each block the vectors of its tag path and of its words and says whether it belongs to the article, with the
whole page before and after it as context. It is trained on pages invented here, whose blocks are known.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements that do not end a block. All others do, but for ``br``, which is white space.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var wbr br img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea select title".split())
#: A start tag of the key's element ends open elements of these kinds, up to the nearest of the limits.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
#: What tells that an element is not shown.
UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

PATHS, WORDS, SIZE, HIDDEN = 512, 512, 12, 16
#: Invented pages to learn from, a third of them of the other make, and passes over them.
TRAINING_PAGES = 1050
EPOCHS = 14
#: Share of blocks whose words are blanked in training.
BLANKED = 0.4
#: Pages labelled at a time.
BATCH_PAGES = 64

Block = tuple[list[str], str, int]
TEXTS = "page_id bigint, url string, text string, n_chars bigint"


# ---------------------------------------------------------------- blocks


def blocks(page: str) -> list[Block]:
    """Tag path, text and number of link characters of every block with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    linked = [0]

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(([t for _, tokens in stack for t in tokens], text, linked[0]))
        parts.clear()
        linked[0] = 0

    def add(text: str) -> None:
        parts.append(text)
        if links[0]:
            linked[0] += len(text)

    def close(name: str, limits: tuple = ()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in limits:
                return
            if stack[i][0] == name:
                del stack[i:]
                return

    links = [0]
    at = 0
    while (token := TOKEN.search(page, at)) is not None:
        add(page[at:token.start()])
        at = token.end()
        if token[2] is None:
            continue
        name, end = token[2].lower(), bool(token[1])
        if name in RAW and not end:
            flush()
            if not token[0].endswith("/>"):
                closing = re.compile(f"</{name}(?![^\\s/>])[^>]*>", re.I).search(page, at)
                at = closing.end() if closing else len(page)
            continue
        if name == "br":
            add(" ")
            continue
        if name in INLINE:
            if name == "a":
                links[0] = 0 if end else 1
            continue
        flush()
        if end:
            if any(name == s[0] for s in stack):
                close(name)
            links[0] = 0
            continue
        if name in CLOSES:
            kinds, limits = CLOSES[name]
            for kind in kinds.split():
                close(kind, limits)
        else:
            close("p", ("article", "section", "div", "td", "li", "blockquote", "form", "main", "aside"))
        if name not in VOID:
            tokens = [name]
            for m in NAMED.finditer(token[3]):
                value = m[2] or m[3] or m[4] or ""
                tokens += [f"{m[1].lower()}={v}" for v in re.split(r"[^a-z0-9]+", value.lower()) if v]
            if UNSEEN.search(token[3]):
                tokens.append("unseen")
            stack.append((name, tokens))
    add(page[at:])
    flush()
    return out


# ---------------------------------------------------------------- features


def _bucket(text: str, n: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % n


@lru_cache(maxsize=50_000)
def _path_bucket(token: str) -> int:
    return _bucket(token, PATHS)


@lru_cache(maxsize=50_000)
def _word_bucket(word: str) -> int:
    return _bucket(word, WORDS)


def featured(sequence: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """Per block the buckets of its path, of its words, and length and share of links."""
    paths = [[_path_bucket(t) for t in path] or [0] for path, _, _ in sequence]
    words = [[_word_bucket(w.lower()) for w in text.split()] for _, text, _ in sequence]
    numbers = np.array([[np.log1p(len(t)) / 5, min(1.0, n / len(t)), t[-1:] in ".!?…", 1.0] for _, t, n in sequence])
    return paths, words, numbers.reshape(-1, 4)


def _means(table: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    flat = np.concatenate([np.array(r) for r in rows])
    starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
    return np.add.reduceat(table[flat], starts, axis=0) / np.array([[len(r)] for r in rows])


# ---------------------------------------------------------------- model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Bidirectional LSTM over the blocks of pages, in numpy."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        width = 2 * SIZE + 4
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {
            "paths": rng.normal(0, 0.3, (PATHS, SIZE)), "words": rng.normal(0, 0.1, (WORDS, SIZE)),
            "out": draw(2 * HIDDEN, 1), "bias": np.zeros(1),
        }
        for side in "fb":
            self.p |= {f"{side}x": draw(width, 4 * HIDDEN), f"{side}h": draw(HIDDEN, 4 * HIDDEN), f"{side}c": np.zeros(4 * HIDDEN)}
            self.p[f"{side}c"][HIDDEN:2 * HIDDEN] = 1.0  # remember at first

    def inputs(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Padded input (time, page, feature) and mask (time, page)."""
        n = max(len(f[2]) for f in pages)
        x = np.zeros((n, len(pages), 2 * SIZE + 4))
        mask = np.zeros((n, len(pages)))
        for k, (paths, words, numbers) in enumerate(pages):
            x[:len(numbers), k] = np.concatenate([_means(self.p["paths"], paths), _means(self.p["words"], words), numbers], axis=1)
            mask[:len(numbers), k] = 1
        return x, mask

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        h = np.zeros((x.shape[1], HIDDEN))
        c = np.zeros_like(h)
        hs, steps = np.zeros((*x.shape[:2], HIDDEN)), []
        ahead = x @ self.p[f"{side}x"] + self.p[f"{side}c"]
        for t in (range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)):
            z = ahead[t] + h @ self.p[f"{side}h"]
            gates = _sigmoid(z[:, :3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            new = f * c + i * g
            th = np.tanh(new)
            if keep:
                steps.append((t, i, f, o, g, c, h, th, m))
            # behind its end a page keeps the state it had
            c = m * new + (1 - m) * c
            h = m * (o * th) + (1 - m) * h
            hs[t] = h
        return hs, steps

    def probabilities(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        forward, f_steps = self._run("f", x, mask, keep)
        backward, b_steps = self._run("b", x, mask, keep)
        both = np.concatenate([forward, backward], axis=2)
        p = _sigmoid(both @ self.p["out"] + self.p["bias"])[:, :, 0]
        return (p, both, f_steps, b_steps) if keep else p

    def gradients(self, pages: list[tuple], labels: list[list[int]]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over blocks and its gradients by backpropagation through time."""
        x, mask = self.inputs(pages)
        p, both, f_steps, b_steps = self.probabilities(x, mask, keep=True)
        y = np.zeros_like(mask)
        for k, own in enumerate(labels):
            y[:len(own), k] = own
        n = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n
        d = (mask * (p - y) / n)[:, :, None]
        g = {name: np.zeros_like(v) for name, v in self.p.items()}
        g["out"] = np.einsum("tpk,tpo->ko", both, d)
        g["bias"] = d.sum(axis=(0, 1))
        d_both = d @ self.p["out"].T
        dx = np.zeros_like(x)
        for side, steps, part in (("f", f_steps, d_both[:, :, :HIDDEN]), ("b", b_steps, d_both[:, :, HIDDEN:])):
            dh, dc = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
            for t, i, f, o, u, c, h, th, m in reversed(steps):
                dh = dh + part[t]
                dh_new, dc_new = m * dh, m * dc
                do = dh_new * th
                dc_new = dc_new + dh_new * o * (1 - th * th)
                dz = np.concatenate([
                    dc_new * u * i * (1 - i), dc_new * c * f * (1 - f), do * o * (1 - o), dc_new * i * (1 - u * u)
                ], axis=1)
                g[f"{side}x"] += x[t].T @ dz
                g[f"{side}h"] += h.T @ dz
                g[f"{side}c"] += dz.sum(axis=0)
                dx[t] += dz @ self.p[f"{side}x"].T
                dh = (1 - m) * dh + dz @ self.p[f"{side}h"].T
                dc = (1 - m) * dc + dc_new * f
        for k, (paths, words, numbers) in enumerate(pages):
            for t in range(len(numbers)):
                np.add.at(g["paths"], paths[t], dx[t, k, :SIZE] / len(paths[t]))
                np.add.at(g["words"], words[t], dx[t, k, SIZE:2 * SIZE] / len(words[t]))
        return loss, g

    def fit(self, pages: list[tuple], labels: list[list[int]], epochs: int, rate: float = 0.01, batch: int = 25, seed: int = 1) -> None:
        """Adam over shuffled batches, with steps that fall evenly to a tenth."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            falling = rate * (1 - 0.9 * epoch / epochs)
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                own = order[at:at + batch]
                # words are blanked now and then, so that paths and neighbours must do
                blanked = [
                    (paths, [[0] if rng.random() < BLANKED else w for w in words], numbers)
                    for paths, words, numbers in (pages[k] for k in own)
                ]
                _, g = self.gradients(blanked, [labels[k] for k in own])
                step += 1
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    mean[k] = 0.9 * mean[k] + 0.1 * v
                    square[k] = 0.999 * square[k] + 0.001 * v * v
                    self.p[k] -= falling * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)

    def label(self, sequences: list[list[Block]]) -> list[np.ndarray]:
        """Per page which blocks belong to the article. Pages of like length share a batch."""
        out = [np.zeros(0, bool)] * len(sequences)
        order = sorted((k for k, s in enumerate(sequences) if s), key=lambda k: len(sequences[k]))
        for at in range(0, len(order), BATCH_PAGES):
            own = order[at:at + BATCH_PAGES]
            p = self.probabilities(*self.inputs([featured(sequences[k]) for k in own]))
            for column, k in enumerate(own):
                out[k] = p[:len(sequences[k]), column] > 0.5
        return out


# ---------------------------------------------------------------- invented pages


class _Page:
    """Writes a page and remembers which of its blocks are article."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.html: list[str] = []
        self.labels: list[int] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        sounds = "th er in on an re ed nd ha en es or ti le de la un ie ch ou que ment ación sch ung ge".split()
        words = ["".join(r.choices(sounds, k=r.choice((1, 1, 2, 2, 3)))) for _ in range(r.randint(low, high))]
        text = " ".join(words)
        return text[:1].upper() + text[1:] + r.choice((".", ".", ".", "", "!", "?"))

    def block(self, tag: str, text: str, label: int, attributes: str = "") -> None:
        end = "" if tag in ("p", "li") and self.r.random() < 0.15 else f"</{tag}>"
        if self.r.random() < 0.15:
            text = f"<b>{text}" + ("<br>" if self.r.random() < 0.5 else "</b>")
        self.html.append(f"<{tag}{attributes}>{text}{end}")
        self.labels.append(label)

    def inside(self, tag: str, names: str, content) -> None:
        name = self.r.choice(names.split("|"))
        attribute = f' {self.r.choice(("class", "class", "id"))}="{name}"' if name else ""
        self.html.append(f"<{tag}{attribute}>")
        content()
        self.html.append(f"</{tag}>")

    def links(self) -> None:
        self.html.append("<ul>")
        for _ in range(self.r.randint(2, 9)):
            self.block("li", f'<a href="/x">{self.words(1, 3)}</a>', 0)
        self.html.append("</ul>")

    def junk(self, kind: str) -> None:
        r = self.r
        text = lambda: self.words(2, 30)
        if kind == "ad":
            tag, names = r.choice((("div", "ad|ads|advert|banner|sponsor|promo|sponsored|advertisement"), ("aside", "ad|promo|")))
            self.inside(tag, names, lambda: (self.html.append(self.words(2, 30)), self.labels.append(0)))
        elif kind == "menu":
            tag, names = r.choice((("nav", "|menu|nav"), ("div", "menu|nav|navigation|navbar|topnav|breadcrumb"), ("ul", "menu|nav")))
            self.inside(tag, names, self.links)
        elif kind == "header":
            tag, names = r.choice((("header", "|site-header|top"), ("div", "header|masthead|topbar|site-header")))
            self.inside(tag, names, lambda: [self.block(r.choice(("p", "h1", "div")), text(), 0) for _ in range(r.randint(1, 2))])
        elif kind == "footer":
            tag, names = r.choice((("footer", "||footer|site-footer"), ("div", "footer|copyright|site-footer|legal")))

            def content():
                if r.random() < 0.6:
                    self.html.append(r.choice(("&copy; ", "© 2020 ", "")) + self.words(2, 30))
                    self.labels.append(0)
                else:
                    for _ in range(r.randint(1, 3)):
                        self.block("p", text(), 0)

            self.inside(tag, names, content)
        elif kind == "sidebar":
            tag, names = r.choice((("aside", "|sidebar|related"), ("div", "sidebar|related|widget|recent|side|trending|popular|tags|share|social")))

            def content():
                self.block(r.choice(("h3", "h2", "p")), self.words(1, 4), 0)
                self.links() if r.random() < 0.6 else [self.block("p", text(), 0) for _ in range(r.randint(1, 4))]

            self.inside(tag, names, content)
        elif kind == "notice":
            self.inside("div", "cookie|notice|consent|gdpr|popup|modal|newsletter|subscribe|alert|cookie-banner|paywall", lambda: (
                self.block("p", r.choice(("We use cookies. ", "Subscribe now. ", "")) + text(), 0)
            ))
        elif kind == "form":
            self.inside("form", "|search|login|newsletter|contact", lambda: (
                self.block(r.choice(("p", "div")), self.words(1, 8), 0), self.block("button", self.words(1, 2), 0)
            ))
        elif kind == "comments":
            tag = r.choice(("section", "div", "div", "ol"))

            def content():
                self.block(r.choice(("h2", "h3")), r.choice(("Comments", "3 comments", "Kommentare", self.words(1, 2))), 0)
                for _ in range(r.randint(1, 5)):
                    self.inside(r.choice(("div", "article", "li")), "comment|comment-body|reply|comment-content", lambda: [
                        self.block("p", self.words(3, 60), 0) for _ in range(r.randint(1, 3))
                    ])

            self.inside(tag, "comments|comment-list|responses|discussion|disqus|reader-comments", content)

    def article(self) -> None:
        r = self.r
        self.block("h1", self.words(2, 12), 1)
        for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
            roll = r.random()
            if roll < 0.72:
                self.block("p", self.words(*r.choice(((1, 1), (1, 6), (5, 40), (20, 120), (20, 120)))), 1)
            elif roll < 0.8:
                self.block(r.choice(("h2", "h3")), self.words(1, 8), 1)
            elif roll < 0.86:
                self.html.append("<ul>")
                for _ in range(r.randint(1, 5)):
                    self.block("li", self.words(1, 20), 1)
                self.html.append("</ul>")
            elif roll < 0.92:
                self.block(r.choice(("blockquote", "pre", "figcaption", "td")), self.words(3, 40), 1)
            else:
                self.junk(r.choice(("ad", "sidebar", "notice", "form")))

    def write(self) -> tuple[str, list[int]]:
        r = self.r
        self.html.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
        for kind in ("notice", "header", "menu", "ad", "form"):
            if r.random() < (0.75 if kind == "menu" else 0.4):
                self.junk(kind)
        tag, names = r.choice((
            ("article", "||post|entry"), ("article", "||story"), ("main", "|content|main"),
            ("div", "content|post|entry|article|main|story|post-content|article-body|text|body"),
            ("section", "content|article|post|main"),
        ))
        outer = r.random() < 0.3
        if outer:
            self.html.append(f'<div class="{r.choice(("wrapper", "container", "page", "row", "content", "main"))}">')
            if r.random() < 0.4:
                self.junk("sidebar")

        def content():
            self.article()
            if r.random() < 0.2:
                self.junk(r.choice(("comments", "sidebar", "ad")))

        self.inside(tag, names, content)
        for kind in ("comments", "sidebar", "form", "ad"):
            if r.random() < 0.3:
                self.junk(kind)
        if outer:
            self.html.append("</div>")
        if r.random() < 0.85:
            self.junk("footer")
        self.html.append("</body></html>")
        return "".join(self.html), self.labels


#: Words of menus, notices and footers.
PHRASES = (
    "Home|News|Sport|Contact|About us|Log in|Sign in|Register|Subscribe|Search|Next|Previous|Back|Top|Archive|Links|Help|Privacy policy|"
    "Terms of service|Cookie settings|All rights reserved|Copyright 2004|Most popular|Most viewed|Latest|Read more|Related|More from us|"
    "Share|Share on social media|Print|Advertisement|Sponsored|Follow us|Newsletter|Sign up for updates|Page last updated 2 May|"
    "Powered by|Visitors: 3812|Comments|Reply|Post a comment|Kontakt|Impressum|Datenschutz|Anmelden|Mehr|Accueil|Mentions légales|Inicio"
).split("|")


class _ForeignPage(_Page):
    """A page of another make: laid out by tables or boxes, names that say nothing or none, lists, line breaks, unseen blocks."""

    def words(self, low: int, high: int) -> str:
        r = self.r
        letters = "eeeettaaooiinnsshhrrddlluucmfywgpbvkäéñ"
        words = ["".join(r.choices(letters, k=r.choice((1, 2, 3, 3, 4, 5, 6, 7, 9)))) for _ in range(r.randint(low, high))]
        if r.random() < 0.15:
            words.append(str(r.randint(1, 2000)))
        text = " ".join(words)
        return text[:1].upper() + text[1:]

    def sentences(self, n: int) -> str:
        return " ".join(self.words(5, 22) + self.r.choice("....!?") for _ in range(n))

    def name(self) -> str:
        r = self.r
        roll = r.random()
        if roll < 0.4:
            return ""
        if roll < 0.5:
            return r.choice((" width=150", " valign=top", " align=center", " bgcolor=white"))
        return f' {r.choice(("class", "class", "id"))}="{"".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789-", k=r.randint(1, 7)))}"'

    def put(self, tag: str, text: str, label: int, attributes: str | None = None) -> None:
        self.html.append(f"<{tag}{self.name() if attributes is None else attributes}>{text}</{tag.split()[0]}>")
        self.labels.append(label)

    def phrase(self) -> str:
        return self.r.choice(PHRASES) if self.r.random() < 0.6 else self.words(1, 4)

    def anchors(self, n: int) -> str:
        gap = self.r.choice((" | ", " - ", " ", "<br>", " &middot; "))
        return gap.join(f"<a href=/{i}>{self.phrase()}</a>" for i in range(n))

    def rest(self, tags: str) -> None:
        """Something that is not article."""
        r = self.r
        kind = r.random()
        tag = r.choice(tags.split())
        if kind < 0.4:
            head = f"<b>{self.phrase()}</b><br>" if r.random() < 0.3 else ""
            self.put(tag, head + self.anchors(r.randint(1, 7)), 0)
        elif kind < 0.65:
            self.put(tag, r.choice((" ", " - ", ". ")).join(r.choice(PHRASES) for _ in range(r.choice((1, 1, 2, 3)))), 0)
        elif kind < 0.75:
            self.put(r.choice((tag, "h3", "h4")), r.choice(PHRASES), 0)
            for _ in range(r.randint(1, 5)):
                self.put(tag, f"<a href=/x>{self.words(2, 8)}</a>", 0)
        elif kind < 0.85:
            self.put(r.choice((tag, "h3")), r.choice(("Comments", "Post a comment", "Reply", "Responses", "Discussion")), 0)
            for _ in range(r.randint(1, 4)):
                self.put(tag, f"{self.words(1, 1)} {r.choice(('says', 'wrote', 'said'))}: {self.words(2, 15)}", 0)
        else:
            self.put(r.choice(("small", "center", "address", "div", "p")), f"{r.choice(PHRASES)}{r.choice((', ', ' ', '. '))}{self.words(1, 6)}", 0)

    def unseen(self) -> None:
        mark = self.r.choice((" hidden", ' style="display:none"', ' style="color:red; visibility: hidden"', ' aria-hidden="true"', ' hidden=""'))
        self.put(self.r.choice(("p", "div", "section")), self.sentences(self.r.randint(1, 2)), 0, mark)

    def body(self) -> None:
        r = self.r
        title = self.words(2, 9)
        self.put(r.choice(("h1", "h1", "h2", "h3", "div", "p")), r.choice((title, title, f"<font size=5>{title}</font>", f"<b>{title}</b>")), 1)
        if r.random() < 0.25:
            self.rest("p div")
        tag = r.choice(("p", "p", "p", "div"))
        names = self.name()
        for _ in range(r.randint(1, 7)):
            roll = r.random()
            if roll < 0.6:
                end = "" if tag == "p" and r.random() < 0.3 else f"</{tag}>"
                gap = "<br><br>" if r.random() < 0.15 else " "
                link = f' <a href="/y">{self.words(1, 3)}</a> {self.words(2, 6)}.' if r.random() < 0.15 else ""
                self.html.append(f"<{tag}{names}>{gap.join(self.sentences(1) for _ in range(r.randint(1, 4)))}{link}{end}")
                self.labels.append(1)
            elif roll < 0.68:
                self.put(r.choice(("h2", "h3", "h4", tag)), self.words(1, 7), 1)
            elif roll < 0.82:
                outer, inner = r.choice((("ul", ("li",)), ("ul", ("li",)), ("ol", ("li",)), ("dl", ("dt", "dd"))))
                self.html.append(f"<{outer}>")
                for _ in range(r.randint(2, 5)):
                    for item in inner:
                        text = r.choice((self.words(1, 7), f"{self.words(1, 2)}: {r.randint(2, 900)} {self.words(1, 1)}", self.sentences(1)))
                        self.html.append(f"<{item}>{text}" + ("" if r.random() < 0.4 else f"</{item}>"))
                        self.labels.append(1)
                self.html.append(f"</{outer}>")
            elif roll < 0.87:
                self.put(r.choice(("blockquote", "pre")), self.sentences(r.randint(1, 2)), 1)
            elif roll < 0.93:
                self.unseen()
            else:
                self.put(r.choice(("div", "p")), r.choice(PHRASES), 0)
        self.html.append(f"<{tag}{names}>{self.sentences(r.randint(1, 3))}</{tag}>")
        self.labels.append(1)

    def some(self, tags: str, most: int) -> None:
        for _ in range(self.r.randint(0, most)):
            self.rest(tags)

    def write(self) -> tuple[str, list[int]]:
        r = self.r
        add = self.html.append
        add("<html><body>")
        make = r.random()
        if make < 0.35:
            add(f"<table{self.name()}>")
            if r.random() < 0.7:
                add("<tr>")
                self.rest("td")
                add("</tr>")
            add("<tr>")
            if r.random() < 0.5:
                self.rest("td")
            add(f"<td{self.name()}>")
            self.body()
            add("</td>")
            if r.random() < 0.5:
                self.rest("td")
            add("</tr>")
            if r.random() < 0.5:
                add("<tr>")
                self.rest("td")
                add("</tr>")
            add("</table>")
            self.some("center p div", 1)
        elif make < 0.6:
            if r.random() < 0.6:
                self.some("p center div", 2)
                self.body()
            else:
                self.body()
            self.some("p center div address", 3)
        else:
            inside = r.choice(("div", "div", "section", "main"))
            for _ in range(r.randint(0, 2)):
                add(f"<div{self.name()}>")
                self.rest("div span p")
                add("</div>")
            add(f"<{inside}{self.name()}>")
            self.body()
            add(f"</{inside}>")
            for _ in range(r.randint(0, 3)):
                add(f"<div{self.name()}>")
                self.rest("div p")
                add("</div>")
        add("</body></html>")
        return "".join(self.html), self.labels


def invented(n: int, seed: int = 0, foreign: bool = False) -> list[tuple[str, list[int]]]:
    """Pages and the labels of their blocks."""
    return [(_ForeignPage if foreign else _Page)(seed * 1_000_003 + k).write() for k in range(n)]


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS) -> Labeller:
    """The labeller after ``epochs`` passes over ``pages`` invented pages."""
    known = [(blocks(page), labels) for page, labels in invented(pages - pages // 3) + invented(pages // 3, foreign=True)]
    known = [(b, labels) for b, labels in known if len(b) == len(labels)]
    model = Labeller()
    model.fit([featured(b) for b, _ in known], [labels for _, labels in known], epochs)
    return model


def main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row: the blocks of the article, two line feeds between them.

    Inside a block white space is one space; character references are decoded. NULL or empty html has the empty
    text. Rows that repeat an id stay rows of their own; other columns are not read.
    """
    model = trained() if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sequences = [blocks(v.as_py() or "") for v in batch.column(2)]
                texts = [
                    "\n\n".join([text for (_, text, _), main in zip(s, own) if main])
                    for s, own in zip(sequences, model.label(sequences))
                ]
                yield pa.record_batch(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, TEXTS)
