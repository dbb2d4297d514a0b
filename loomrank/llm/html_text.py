"""Main text of HTML pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, each with the path of open
elements. A numpy bidirectional LSTM reads a vector of hashed tag-path and word features for every leaf and
labels all leaves with the context of the whole document. It is trained here, on pages made by rule.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.llm.common import map_batches

#: Hashed path and word features, plain features, LSTM cells a direction.
PATH, WORDS, PLAIN, CELLS = 96, 64, 6, 20
#: Training pages and passes.
PAGES, PASSES = 640, 26
#: Leaves of one padded batch at most.
BATCH_LEAVES = 1 << 14
# Fixed values of HTML: elements that end a run of text, that hold no page text, and that have no end tag.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style noscript template textarea title head svg math canvas object".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that an opening block tag closes by implication.
IMPLIED = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# Fixed values of HTML: elements whose content is plain characters up to their end tag.
RAW = frozenset("script style textarea title iframe noframes xmp".split())
#: What may follow in a tag: its end, or a value in quotes.
STOP = re.compile(r"""[>]|=[ \t\n\f\r]*(["'])""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
UNSEEN = re.compile(r"""style\s*=\s*["']?[^"'>]*(?:display\s*:\s*none|visibility\s*:\s*hidden)|aria-hidden\s*=\s*["']?true""", re.I)
BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
PART = re.compile(r"[a-z]+")
#: Open elements of a path that features are made of, the innermost; characters of a tag's attributes that are looked at.
DEPTH, ATTRIBUTES = 64, 1 << 16


class Tags:
    """Tags of a page one by one, in time that grows with its length: what isn't found once isn't looked for again."""

    def __init__(self, page: str):
        self.page = page
        self.gone: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def end_of(self, at: int) -> int:
        """Place of the ``>`` that ends a tag; a quote that is never closed doesn't count."""
        while m := STOP.search(self.page, at):
            if m[0] == ">":
                return m.start()
            closed = self.find(m[1], m.end())
            at = closed + 1 if closed >= 0 else m.end()
        return len(self.page)

    def after_raw(self, name: str, at: int) -> int:
        """Place of the end tag of an element of plain characters; the page's end without one."""
        if name in self.gone:
            return len(self.page)
        m = RAW_ENDS[name].search(self.page, at)
        if not m:
            self.gone.add(name)
        return m.start() if m else len(self.page)

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """Start and end of each tag or comment, its name in lower case ('' for comments), whether it is an end tag, its attributes."""
        page, at = self.page, 0
        while (start := self.find("<", at)) >= 0:
            mark = page[start + 1 : start + 2]
            if mark == "!" or mark == "?":
                end = self.find("-->", start + 4) if page.startswith("<!--", start) else self.find(">", start)
                at = len(page) if end < 0 else end + (3 if page.startswith("<!--", start) else 1)
                yield start, at, "", False, ""
                continue
            ending = mark == "/"
            m = NAME.match(page, start + 1 + ending)
            if not m:
                at = start + 1
                continue
            stop = self.end_of(m.end())
            name, at = m[0].lower(), min(stop + 1, len(page))
            yield start, at, name, ending, page[m.end() : min(stop, m.end() + ATTRIBUTES)]
            if name in RAW and not ending:
                at = self.after_raw(name, at)
                yield at, at, "", False, ""


RAW_ENDS = {n: re.compile(f"</{n}(?=[\\s/>])", re.I) for n in RAW}


def unseen(name: str, attributes: str) -> bool:
    """Whether an element is never shown."""
    if name in HIDDEN:
        return True
    low = attributes.lower()
    if "hidden" not in low and "none" not in low:
        return False
    return bool(UNSEEN.search(attributes) or BARE_HIDDEN.search(QUOTED.sub('""', attributes)))


def leaves(page: str | None) -> list[tuple[tuple[str, ...], str, int, int]]:
    """Leaf blocks in page order: path of open elements, text with white space collapsed, characters in links, tags inside.

    Character references are decoded; a line break is white space; unclosed and misnested tags are tolerated. What is
    never shown (``HIDDEN`` elements, ``hidden``, ``aria-hidden``, ``display:none``) is no text.
    """
    out: list[tuple[tuple[str, ...], str, int, int]] = []
    #: open block elements and open unseen elements: name, label, whether unseen
    stack: list[tuple[str, str, bool]] = []
    opened: Counter[str] = Counter()
    run: list[str] = []
    linked = tags = in_link = dark = 0
    path: tuple[str, ...] = ()
    page = page or ""

    def close() -> None:
        nonlocal linked, tags
        if run:
            if text := " ".join(html.unescape("".join(run)).split()):
                out.append((path, text, linked, tags))
            run.clear()
        linked = tags = 0

    def text_at(a: int, b: int) -> None:
        nonlocal linked
        if a < b and not dark and not raw:
            run.append(page[a:b])
            if in_link:
                linked += b - a

    def pop() -> None:
        nonlocal dark
        name, _, is_unseen = stack.pop()
        opened[name] -= 1
        dark -= is_unseen

    def push(name: str, label: str, is_unseen: bool) -> None:
        nonlocal dark
        stack.append((name, label, is_unseen))
        opened[name] += 1
        dark += is_unseen

    at, raw = 0, False
    for start, end, name, ending, attributes in Tags(page):
        text_at(at, start)
        at = end
        raw = not ending and name in RAW
        if not name or raw:
            continue
        if name == "body" and not ending:
            while opened["head"]:
                pop()
        block = name in BLOCKS
        if block:
            close()
        if ending:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name not in VOID:
            if block:
                gone = IMPLIED.get(name, frozenset()) | ({"p"} if name in ENDS_P else frozenset())
                while stack and stack[-1][0] in gone:
                    pop()
            is_unseen = unseen(name, attributes) and not attributes.endswith("/")
            if block or is_unseen:
                names = " ".join(x for t in NAMES.findall(attributes) for x in t if x) if attributes else ""
                push(name, f"{name} {names}".lower(), is_unseen)
        if block:
            path = tuple(s[1] for s in stack[-DEPTH:] if s[0] in BLOCKS)
        elif name == "br":
            if not dark:
                run.append(" ")
        elif name == "a":
            in_link = 0 if ending else 1
            tags += 1
        else:
            tags += 1
    text_at(at, len(page))
    close()
    return out


@lru_cache(maxsize=20_000)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed names of the open elements and of the letters' runs in their classes, ids and roles; the innermost twice."""
    v = np.zeros(PATH, np.float32)
    for depth, step in enumerate(reversed(path)):
        name, _, rest = step.partition(" ")
        keys = ["t:" + name] + (["leaf:" + name] if not depth else [])
        keys += ["n:" + p for p in PART.findall(rest)]
        for k in keys:
            v[xxhash.xxh32_intdigest(k) % PATH] = 1.0
    return v


@lru_cache(maxsize=100_000)
def word_place(word: str) -> int:
    return xxhash.xxh32_intdigest(word) % WORDS


def vector(leaf: tuple[tuple[str, ...], str, int, int], i: int, n: int, longest: int) -> np.ndarray:
    path, text, linked, tags = leaf
    v = np.zeros(PATH + WORDS + PLAIN, np.float32)
    v[:PATH] = path_vector(path)
    at = np.array([word_place(w) for w in text.lower().split()])
    counts = np.bincount(at, minlength=WORDS)
    v[PATH : PATH + WORDS] = counts / (3 + np.sqrt((counts * counts).sum()))  # the words of short blocks say little
    size = len(text)
    v[PATH + WORDS :] = (np.log1p(size) / 6, min(1.0, linked / max(1, size)), min(1.0, tags / 8), i / max(1, n), float(text[-1] in ".!?"), size / max(1, longest))
    return v


def vectors(page: list[tuple[tuple[str, ...], str, int, int]]) -> np.ndarray:
    longest = max(len(x[1]) for x in page)
    return np.stack([vector(x, i, len(page), longest) for i, x in enumerate(page)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """One LSTM forwards and one backwards; both states of a leaf meet in a logistic output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        d = PATH + WORDS + PLAIN
        self.p = {}
        for s in "fb":
            self.p["x" + s] = rng.normal(0, d**-0.5, (d, 4 * CELLS)).astype(np.float32)
            self.p["h" + s] = rng.normal(0, CELLS**-0.5, (CELLS, 4 * CELLS)).astype(np.float32)
            self.p["c" + s] = np.concatenate([np.zeros(CELLS), np.ones(CELLS), np.zeros(2 * CELLS)]).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.2, (2 * CELLS + d, 1)).astype(np.float32)
        self.p["q"] = np.zeros(1, np.float32)

    def states(self, x: np.ndarray, mask: np.ndarray, s: str, trace: list | None = None) -> np.ndarray:
        """Hidden states, time first; padded steps carry the state through."""
        t, n, _ = x.shape
        gates = (x.reshape(t * n, -1) @ self.p["x" + s]).reshape(t, n, -1) + self.p["c" + s]
        h, c = np.zeros((n, CELLS), np.float32), np.zeros((n, CELLS), np.float32)
        out = np.zeros((t, n, CELLS), np.float32)
        for i in range(t) if s == "f" else range(t - 1, -1, -1):
            g = gates[i] + h @ self.p["h" + s]
            a = sigmoid(g[:, : 3 * CELLS])
            z = np.tanh(g[:, 3 * CELLS :])
            new_c = a[:, CELLS : 2 * CELLS] * c + a[:, :CELLS] * z
            tc = np.tanh(new_c)
            m = mask[i][:, None]
            if trace is not None:
                trace.append((i, h, c, a, z, tc, m))
            h, c = np.where(m, a[:, 2 * CELLS :] * tc, h), np.where(m, new_c, c)
            out[i] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray, traces: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([self.states(x, mask, "f", traces and traces[0]), self.states(x, mask, "b", traces and traces[1]), x], 2)
        return both, both @ self.p["o"][:, 0] + self.p["q"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        traces: tuple[list, list] = ([], [])
        # an empty trace list is false
        both = np.concatenate([self.states(x, mask, "f", traces[0]), self.states(x, mask, "b", traces[1]), x], 2)
        d = (sigmoid(both @ self.p["o"][:, 0] + self.p["q"][0]) - y) * mask / mask.sum()
        grad = {"o": (both * d[..., None]).sum((0, 1))[:, None], "q": np.array([d.sum()])}
        for k, s in enumerate("fb"):
            dout = d[..., None] * self.p["o"][k * CELLS : (k + 1) * CELLS, 0]
            dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
            dg = np.zeros((*dout.shape[:2], 4 * CELLS), np.float32)
            gh = np.zeros_like(self.p["h" + s])
            for i, h, c, a, z, tc, m in reversed(traces[k]):
                dh = dh + dout[i]
                i_, f_, o_ = a[:, :CELLS], a[:, CELLS : 2 * CELLS], a[:, 2 * CELLS :]
                dnew = np.where(m, dc + dh * o_ * (1 - tc * tc), 0)
                ga = np.concatenate([dnew * z, dnew * c, np.where(m, dh * tc, 0)], 1) * a * (1 - a)
                g = np.concatenate([ga, dnew * i_ * (1 - z * z)], 1)
                dg[i] = g
                gh += h.T @ g
                dh = np.where(m, g @ self.p["h" + s].T, dh)
                dc = np.where(m, dnew * f_, dc)
            flat = dg.reshape(-1, 4 * CELLS)
            grad |= {"x" + s: x.reshape(-1, x.shape[2]).T @ flat, "h" + s: gh, "c" + s: flat.sum(0)}
        return grad

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each leaf of each page; pages of like length are padded together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(pages[order[to]]) <= BATCH_LEAVES:
                to += 1
            part = order[at:to]
            x, mask, _ = padded([pages[i] for i in part])
            p = sigmoid(self.scores(x, mask)[1])
            for k, i in enumerate(part):
                out[i] = p[: len(pages[i]), k]
            at = to
        return out


def padded(pages: list[np.ndarray], labels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, n = max(map(len, pages)), len(pages)
    x, mask, y = np.zeros((t, n, pages[0].shape[1]), np.float32), np.zeros((t, n), bool), np.zeros((t, n), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
        if labels is not None:
            y[: len(p), k] = labels[k]
    return x, mask, y


# Names that sites give to the parts of a page, main text first.
MAIN_NAMES = ["article", "post", "entry", "content", "story", "body", "main", "text", "article-body", "post-content", "entry-content", "story-body"]
OTHER_NAMES = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "topnav", "pagination", "toc"],
    "header": ["header", "masthead", "banner", "branding", "site-header"],
    "footer": ["footer", "copyright", "site-footer", "legal", "bottom"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "side"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"],
    "notice": ["cookie", "cookies", "notice", "consent", "gdpr", "newsletter", "subscribe", "popup", "modal", "alert"],
    "comments": ["comments", "comment", "comment-list", "replies", "discussion", "disqus", "responses"],
    "form": ["search", "login", "signup", "contact", "newsletter", "form"],
    "share": ["share", "social", "follow", "byline", "tags", "meta"],
}
PHRASES = {
    "footer": ["© 2024 all rights reserved", "&copy; example.com &middot; privacy policy", "terms of use", "contact us"],
    "notice": ["We use cookies to improve your experience.", "Accept all", "Subscribe to our newsletter"],
    "comments": ["Reply", "3 comments", "Great post, thanks!", "Leave a comment"],
    "ad": ["Advertisement", "Sponsored", "Buy now"],
    "share": ["Share", "Tweet", "By the editor", "Tags:"],
    "aside": ["Related articles", "Most read", "Read more"],
    "form": ["Search", "Name", "E-mail", "Submit"],
}


class PageMaker:
    """Pages by rule with the label of each leaf: an article among navigation, adverts, notices, comments and the like."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        syllables = ["th", "en", "er", "ing", "on", "re", "an", "ti", "ou", "le", "es", "de", "la", "ch", "ein", "zu", "ar", "os"]
        self.words = ["".join(self.rng.choice(syllables, self.rng.integers(1, 4))) for _ in range(3000)]

    def one(self, options: list):
        return options[self.rng.integers(len(options))]

    def text(self, least: int, most: int) -> str:
        return " ".join(self.one(self.words) for _ in range(self.rng.integers(least, most + 1)))

    def other(self, kind: str) -> str:
        name = self.one(OTHER_NAMES[kind])
        phrase = [self.one(PHRASES[kind])] if kind in PHRASES and self.rng.random() < 0.6 else []
        r = self.rng.random
        if kind in ("nav", "aside", "header") and r() < 0.6:
            body = "<ul>" + "".join(f'<li><a href="/{i}">{self.text(1, 4)}</a></li>' for i in range(self.rng.integers(2, 9))) + "</ul>"
        elif kind == "comments":
            body = "".join(f'<div class="{self.one(["comment", "reply", "c"])}"><p>{self.text(3, 40)}.</p></div>' if r() < 0.5 else f"<p>{self.text(3, 40)}.</p>" for _ in range(self.rng.integers(1, 5)))
        elif kind == "form":
            body = f"<label>{self.text(1, 2)}</label><button>{self.text(1, 2)}</button>" + (f"<p>{self.text(2, 12)}</p>" if r() < 0.5 else "")
        else:
            body = "".join(f"<p>{self.text(2, 30)}.</p>" if r() < 0.5 else self.text(2, 30) + "." for _ in range(self.rng.integers(1, 3)))
        body = "".join(f"<p>{p}</p>" if r() < 0.5 else p + " " for p in phrase) + body
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and r() < 0.7 else "section" if kind == "comments" and r() < 0.3 else "div"
        given = f' {self.one(["class", "id"])}="{name}"' if tag in ("div", "section") or r() < 0.4 else ""
        return f"<{tag}{given}>{body}</{tag}>"

    def article(self) -> str:
        r = self.rng.random
        parts = [f"<h1>{self.text(2, 9)}</h1>"] if r() < 0.85 else []
        for _ in range(self.rng.integers(1, 12)):
            kind = r()
            if kind < 0.08:
                parts.append(f"<h{self.rng.integers(2, 5)}>{self.text(1, 7)}</h2>")
            elif kind < 0.16:
                parts.append("<ul>" + "".join(f"<li>{self.text(1, 14)}</li>" for _ in range(self.rng.integers(1, 5))) + "</ul>")
            elif kind < 0.2:
                parts.append(f"<blockquote>{self.text(3, 30)}.</blockquote>")
            elif kind < 0.23:
                parts.append("<table>" + "".join(f"<tr><td>{self.text(1, 3)}</td><td>{self.text(1, 3)}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.3:
                parts.append(f"<p><b>{self.text(1, 12)}.<br><p>{self.text(3, 60)}.</p>")
            elif kind < 0.36:  # an article may quote what elsewhere is boilerplate
                parts.append(f"<p>{self.one(PHRASES[self.one(list(PHRASES))])} {self.text(0, 12)}</p>")
            elif kind < 0.41:
                parts.append(f'<p>{self.text(2, 20)} <a href="/x">{self.text(1, 4)}</a> {self.text(2, 20)}.</p>')
            else:
                parts.append(f"<p>{self.text(1, 110) if r() < 0.85 else ' | '.join(self.text(1, 3) for _ in range(self.rng.integers(1, 20)))}{self.one(['.', '', '!', '|', ' %%%', '&amp;'])}</p>")
        return "".join(parts)

    def page(self) -> tuple[str, list[int]]:
        """A page and the label of each of its leaves."""
        r = self.rng.random
        before = [k for k in ("notice", "header", "nav", "ad", "form") if r() < {"nav": 0.85, "ad": 0.4}.get(k, 0.3)]
        after = [k for k in ("share", "aside", "comments", "form", "ad", "footer") if r() < {"footer": 0.85}.get(k, 0.3)]
        main, tag = self.article(), self.one(["article", "article", "main", "div"])
        given = f' {self.one(["class", "id"])}="{self.one(MAIN_NAMES)}"' if tag == "div" or r() < 0.3 else ""
        inside = [k for k in ("ad", "share", "aside", "nav") if r() < 0.08]
        cut = main.find("</p>") + 4 if inside else 0
        pieces = [(self.other(k), 0) for k in before]
        pieces += [(f"<{tag}{given}>{main[:cut]}", 1), *[(self.other(k), 0) for k in inside], (main[cut:] + f"</{tag}>", 1)]
        pieces += [(self.other(k), 0) for k in after]
        marks = []
        shell = self.one(["", "", '<div class="wrapper">', '<div id="page"><div class="container">'])
        whole = f"<html><head><title>{self.text(2, 6)}</title><style>p{{}}</style></head><body>{shell}"
        for piece, label in pieces:
            before_n = len(leaves(whole))
            whole += piece
            marks += [label] * (len(leaves(whole)) - before_n)
        return whole + ("</body></html>" if r() < 0.9 else ""), marks


def dimmed(features: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Some names of a page and half its leaves' words are hidden in training, so that no single one decides."""
    f = np.where(rng.random(features.shape[1]) < 0.08, 0, features).astype(np.float32)
    f[rng.random(len(f)) < 0.5, PATH : PATH + WORDS] = 0
    f[:, PATH + WORDS :] *= rng.random((len(f), PLAIN)) > 0.15
    return f


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, passes: int = PASSES, seed: int = 11) -> BiLstm:
    """The labeller, fitted on pages made by rule; a seed gives the same weights each time."""
    maker, rng = PageMaker(seed), np.random.default_rng(seed)
    made = [maker.page() for _ in range(pages)]
    data = [(vectors(x), np.array(y, np.float32)) for p, y in made if (x := leaves(p)) and len(x) == len(y)]
    net = BiLstm()
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    step = 0
    for done in range(passes):
        order = sorted(range(len(data)), key=lambda i: len(data[i][0]) + 6 * rng.random())
        batches = [order[i : i + 32] for i in range(0, len(order), 32)]
        for k in rng.permutation(len(batches)):
            part = [data[i] for i in batches[k]]
            x, mask, y = padded([dimmed(f, rng) for f, _ in part], [t for _, t in part])
            step += 1
            rate = 0.01 * (1 - done / passes) + 0.0005
            for key, g in net.gradients(x, mask, y).items():
                m[key] = 0.9 * m[key] + 0.1 * g
                v[key] = 0.999 * v[key] + 0.001 * g * g
                net.p[key] = (net.p[key] - rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def main_text(pages: DataFrame) -> DataFrame:
    """One row a page: ``page_id, url, text, n_chars, n_blocks, n_main``.

    A null or empty page gives the empty text. Blocks of the main text come in page order, joined by two line
    feeds; nothing is cut. Repeated rows come back repeated; an empty table gives none; only the three named
    columns are read.
    """
    net = pages.sparkSession.sparkContext.broadcast(trained().p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = BiLstm()
        labeller.p = net.value
        for b in batches:
            found = [leaves(h) for h in b.column("html").to_pylist()]
            labels = labeller.label([vectors(x) if x else np.zeros((0, 1), np.float32) for x in found])
            texts = ["\n\n".join(x[1] for x, p in zip(f, ps, strict=True) if p >= 0.5) for f, ps in zip(found, labels, strict=True)]
            cols = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([int((p >= 0.5).sum()) for p in labels], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
