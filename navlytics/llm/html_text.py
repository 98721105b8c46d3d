"""Main-text extraction from HTML by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks: runs of inline content under one block element, each with its ancestor tags, their class and id
words, and its text. Features of a block come from both; a chain over the blocks in page order (main text or not) is trained on
labelled pages by maximum likelihood and decoded by Viterbi.

The labelled pages are written by ``labelled_page``: layouts drawn from a seed with every block's label known. They are the training
set of the model and nothing else; given pages are only decoded.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas select option textarea noembed noframes datalist".split())
#: Start tags that end an open element of the second group, as the standard's optional end tags say.
_P_ENDERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav "
    "ol p pre section table ul search".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset({"ul", "ol", "dl", "table", "article", "section", "div", "aside", "nav", "body", "main", "footer", "header", "td", "th"})

# a quote opens a value only directly after its =; elsewhere inside a tag it is a character
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]*))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """One leaf block: its text, ancestors from the root on (tag, class/id words), characters inside links, and whether it is hidden."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    link_chars: int = 0


@dataclass
class _Open:
    tag: str
    words: tuple[str, ...]
    hidden: bool


@dataclass
class _Run:
    parts: list[str] = field(default_factory=list)
    link: int = 0


def _marks(attrs: str) -> tuple[tuple[str, ...], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    words, hidden = [], False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), html.unescape(a or b or c)
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words += _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
    return tuple(words), hidden


def blocks(page: str) -> list[Block]:
    """The visible leaf blocks of a page in order. Broken markup is read as far as it makes sense; nothing raises."""
    out: list[Block] = []
    stack: list[_Open] = []
    run = _Run()

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(run.parts)).strip()
        if text:
            out.append(Block(text, tuple((o.tag, o.words) for o in stack), run.link))
        run.parts, run.link = [], 0

    def close(to: int) -> None:
        if any(o.tag not in INLINE for o in stack[to:]):
            flush()
        del stack[to:]

    def add(raw: str) -> None:
        if raw and not (stack and stack[-1].hidden):
            text = html.unescape(raw)
            run.parts.append(text)
            if any(o.tag == "a" for o in stack):
                run.link += len(text.strip())

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br" or tag == "p" and not any(o.tag == "p" for o in stack):
                run.parts.append(" ") if tag == "br" else flush()
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        words, hidden = _marks(m[3])
        hidden |= tag in HIDDEN or bool(stack and stack[-1].hidden)
        if tag == "body":  # what an unclosed head holds ends here
            close(next((i for i, o in enumerate(stack) if o.tag == "head"), len(stack)))
            hidden = tag in HIDDEN or bool(stack and stack[-1].hidden)
        if tag in _P_ENDERS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in _SCOPES:
                    break
        if tag in _ENDS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in _ENDS[tag]:
                    close(i)
                    break
                if stack[i].tag in _SCOPES - _ENDS[tag]:
                    break
        if tag not in INLINE:
            flush()
        if tag == "br":
            run.parts.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if not hidden:
                stack.append(_Open(tag, words, hidden))
                add(page[at:stop])
                close(len(stack) - 1)
            gt = page.find(">", stop) if end else -1
            at = gt + 1 if gt >= 0 else len(page)
            continue
        if m[3].rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        stack.append(_Open(tag, words, hidden))
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features of each block: ancestor tags, class and id words, shape of the text, place in the page."""
    rows = []
    n = len(found)
    for i, b in enumerate(found):
        tags = [t for t, _ in b.path]
        names = {f"in:{t}" for t in tags if t not in INLINE} | {f"word:{w}" for _, ws in b.path for w in ws}
        leaf = next((t for t in reversed(tags) if t not in INLINE), "none")
        size = len(b.text)
        link = b.link_chars / size
        names |= {f"leaf:{leaf}", f"size:{min(8, size.bit_length())}", f"link:{0 if not link else 1 if link < 0.5 else 2}",
                  f"stop:{b.text[-1] in '.!?…。'}", f"depth:{min(8, sum(t not in INLINE for t in tags))}", f"leaf-size:{leaf}:{min(8, size.bit_length())}"}
        if b.text[0] == "©" or "©" in b.text:
            names.add("copyright")
        names.add("first" if i == 0 else "last" if i == n - 1 else "middle")
        rows.append(sorted(names))
    return rows


@dataclass(frozen=True)
class Chain:
    """Weights of features by state (0: other, 1: main text), of transitions, and of the first state."""

    weights: dict[str, tuple[float, float]]
    moves: np.ndarray
    start: np.ndarray

    def decode(self, rows: list[list[str]]) -> list[bool]:
        """The most likely states (Viterbi); ties go to main text, so that no text is lost by one."""
        if not rows:
            return []
        e = np.array([[sum(self.weights.get(f, (0.0, 0.0))[s] for f in r) for s in (0, 1)] for r in rows])
        score, back = self.start + e[0], []
        for x in e[1:]:
            step = score[:, None] + self.moves
            prev = np.where(step[1] >= step[0], 1, 0)
            back.append(prev)
            score = step[prev, [0, 1]] + x
        state = int(score[1] >= score[0])
        out = [state]
        for prev in reversed(back):
            state = int(prev[state])
            out.append(state)
        return [s == 1 for s in reversed(out)]


def train(pages: list[tuple[list[list[str]], list[bool]]], rounds: int = 60, rate: float = 0.5, penalty: float = 1e-3) -> Chain:
    """Maximum likelihood with a squared penalty, by gradient steps with a running scale per weight (AdaGrad); forward-backward gives the expectations."""
    index = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for r in rows for f in r}))}
    w, moves, start = np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)
    scale = [np.full_like(a, 1e-8) for a in (w, moves, start)]
    data = []
    for rows, labels in pages:
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        data.append((at, np.array([index[f] for r in rows for f in r]), np.array(labels, int), len(rows)))
    for _ in range(rounds):
        grads = [-penalty * w * len(data), np.zeros((2, 2)), np.zeros(2)]
        for at, ids, y, n in data:
            e = np.zeros((n, 2))
            np.add.at(e, at, w[ids])
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = start + e[0]
            for i in range(1, n):
                fwd[i] = np.logaddexp(fwd[i - 1, 0] + moves[0], fwd[i - 1, 1] + moves[1]) + e[i]
            for i in range(n - 2, -1, -1):
                x = bwd[i + 1] + e[i + 1]
                bwd[i] = np.logaddexp(moves[:, 0] + x[0], moves[:, 1] + x[1])
            z = np.logaddexp(*fwd[-1])
            p = np.exp(fwd + bwd - z)
            miss = np.eye(2)[y] - p
            np.add.at(grads[0], ids, miss[at])
            grads[2] += miss[0]
            for i in range(1, n):
                grads[1][y[i - 1], y[i]] += 1
                grads[1] -= np.exp(fwd[i - 1][:, None] + moves + (e[i] + bwd[i])[None] - z)
        for a, g, s in zip((w, moves, start), grads, scale):
            s += g * g
            a += rate * g / np.sqrt(s)
    return Chain({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, moves, start)


def labelled_page(seed: int) -> tuple[str, list[bool]]:
    """A page drawn from layouts as they are common on the web, and the label of each of its blocks."""
    r = random.Random(seed)
    out: list[str] = []
    labels: list[bool] = []

    def words(lo: int, hi: int, stop: bool = True) -> str:
        text = " ".join("".join(r.choice("abcdefghilmnoprstuvéü") for _ in range(r.randint(2, 9))) for _ in range(r.randint(lo, hi)))
        return text.capitalize() + ("." if stop else "")

    def put(tag: str, text: str, label: bool, attrs: str = "") -> None:
        out.append(f"<{tag}{attrs}>{text}</{tag}>")
        labels.append(label)

    def name(*choices: str) -> str:
        return f' {r.choice(("class", "class", "id"))}="{r.choice(choices)}"'

    def links(n: int) -> None:
        out.append("<ul>")
        for _ in range(n):
            put("li", f'<a href="/{r.randrange(999)}">{words(1, 3, False)}</a>', False)
        out.append("</ul>")

    def menu() -> None:
        tag = r.choice(("nav", "nav", "div"))
        out.append(f"<{tag}" + (name("menu", "nav", "navbar", "main-menu", "navigation", "breadcrumbs", "topnav") if tag == "div" or r.random() < 0.4 else "") + ">")
        links(r.randint(2, 8))
        out.append(f"</{tag}>")

    def advert() -> None:
        tag = r.choice(("div", "div", "aside", "section", "p"))
        put(tag, words(3, 30), False, name("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot"))

    def notice() -> None:
        put(r.choice(("div", "section", "p")), words(5, 30), False, name("cookie", "cookie-notice", "consent", "notice", "gdpr", "newsletter", "subscribe", "alert", "popup", "disclaimer"))

    def header() -> None:
        tag = r.choice(("header", "header", "div"))
        out.append(f"<{tag}" + (name("header", "site-header", "masthead", "top", "logo") if tag == "div" or r.random() < 0.4 else "") + ">")
        put(r.choice(("h1", "div", "p", "a")), words(1, 5, False), False)
        if r.random() < 0.5:
            put("p", words(3, 10), False)
        out.append(f"</{tag}>")
        if labels and out[-2].startswith("<a"):
            pass

    def sidebar() -> None:
        tag = r.choice(("aside", "aside", "div"))
        out.append(f"<{tag}" + (name("sidebar", "related", "widget", "recommended", "popular", "side", "share", "social", "tags", "author") if tag == "div" or r.random() < 0.4 else "") + ">")
        put(r.choice(("h2", "h3", "h4")), words(1, 4, False), False)
        if r.random() < 0.5:
            links(r.randint(1, 5))
        for _ in range(r.randint(0, 2)):
            put("p", words(3, 30), False)
        out.append(f"</{tag}>")

    def form() -> None:
        out.append("<form>")
        if r.random() < 0.7:
            put(r.choice(("label", "p", "div")), words(1, 6, False), False)
        put("button", words(1, 2, False), False)
        out.append("</form>")

    def comments() -> None:
        tag = r.choice(("section", "div", "div", "ol", "ul"))
        inner = "li" if tag in ("ol", "ul") else r.choice(("div", "article", "p"))
        out.append(f"<{tag}" + name("comments", "comment-list", "reader-comments", "discussion", "responses", "replies") + ">")
        if tag not in ("ol", "ul") and r.random() < 0.6:
            put(r.choice(("h2", "h3")), words(1, 3, False), False)
        for _ in range(r.randint(1, 5)):
            if inner == "p":
                put("p", words(3, 50), False, name("comment", "reply") if r.random() < 0.5 else "")
            else:
                out.append(f"<{inner}" + (name("comment", "comment-body", "reply") if r.random() < 0.7 else "") + ">")
                if r.random() < 0.5:
                    put(r.choice(("b", "p", "div")) if False else "div", words(1, 3, False), False, name("author", "meta", "comment-author") if r.random() < 0.5 else "")
                put("p", words(3, 50), False)
                out.append(f"</{inner}>")
        out.append(f"</{tag}>")

    def footer() -> None:
        tag = r.choice(("footer", "footer", "footer", "div"))
        attrs = name("footer", "site-footer", "copyright", "legal", "bottom") if tag == "div" or r.random() < 0.3 else ""
        if r.random() < 0.5:
            put(tag, "&copy; " + words(2, 20), False, attrs)
        else:
            out.append(f"<{tag}{attrs}>")
            if r.random() < 0.5:
                links(r.randint(1, 5))
            put("p", ("&copy; " if r.random() < 0.7 else "") + words(2, 20), False)
            out.append(f"</{tag}>")

    def article() -> None:
        wrap = r.choice((("article", ""), ("article", ""), ("main", ""), ("div", name("content", "article", "post", "entry-content", "main", "story", "article-body", "text", "page")),
                         ("section", name("content", "article", "post")), ("div", "")))
        nested = r.random() < 0.3
        out.append(f"<{wrap[0]}{wrap[1]}>" + ("<div>" if nested else ""))
        if r.random() < 0.8:
            if r.random() < 0.15:
                out.append("<header>")
                put("h1", words(2, 12, r.random() < 0.3), True)
                out.append("</header>")
            else:
                put(r.choice(("h1", "h1", "h2")), words(1, 12, r.random() < 0.3), True)
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12, 20))):
            kind = r.random()
            if kind < 0.72:
                text = words(*r.choice(((1, 3), (4, 12), (10, 40), (40, 120), (40, 120))), stop=r.random() < 0.9)
                if r.random() < 0.15:
                    text += f' <a href="/x">{words(1, 4, False)}</a> {words(2, 9)}'
                put("p", text, True)
            elif kind < 0.80:
                put(r.choice(("h2", "h3")), words(1, 8, False), True)
            elif kind < 0.87:
                put(r.choice(("blockquote", "pre", "figcaption", "div", "dd")), words(3, 40), True)
            elif kind < 0.93:
                out.append(f"<{(t := r.choice(('ul', 'ol')))}>")
                for _ in range(r.randint(1, 5)):
                    put("li", words(1, 15, r.random() < 0.5), True)
                out.append(f"</{t}>")
            elif kind < 0.96:
                out.append("<table><tr>")
                for _ in range(r.randint(1, 4)):
                    put("td", words(1, 4, False), True)
                out.append("</tr></table>")
            else:
                r.choice((advert, advert, notice, sidebar, form))()
        out.append(("</div>" if nested else "") + f"</{wrap[0]}>")

    for part in (header, menu, advert, notice, sidebar):
        if r.random() < (0.7 if part is menu else 0.35):
            part()
    article()
    for part in (advert, form, comments, sidebar, notice, menu, footer):
        if r.random() < (0.8 if part is footer else 0.3):
            part()
    body = f'<body{name("page", "home", "single") if r.random() < 0.2 else ""}>' + "".join(out)
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head>{body}" + ("</body></html>" if r.random() < 0.9 else ""), labels


#: Labelled pages that the model is trained on, and the first seed.
TRAINING_PAGES, FIRST_SEED = 500, 1000


@functools.cache
def model() -> Chain:
    """The chain trained on the labelled pages; a few seconds, once on the driver."""
    pages = []
    for seed in range(FIRST_SEED, FIRST_SEED + TRAINING_PAGES):
        page, labels = labelled_page(seed)
        found = blocks(page)
        if len(found) == len(labels):
            pages.append((features(found), labels))
    return train(pages)


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, main in zip(found, chain.decode(features(found))) if main)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row, from the whole page; null or text-free pages give an empty text.

    Repeated rows and null ids are kept; other columns are not read. An empty table gives an empty one.
    """
    share = pages.sparkSession.sparkContext.broadcast(model())  # some hundred weights
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = share.value
        for b in batches:
            text = [main_text(x, chain) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                             [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, F.col(body_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long")
