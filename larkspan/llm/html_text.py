"""Main text of web pages: a linear-chain conditional random field over a page's leaf blocks.

A page becomes the sequence of its leaf blocks - stretches of text between
block-level tags - with the tags and the class, id and role words of their
ancestors. Features of these and of the text weigh the labels ``main`` and
``other``; Viterbi decoding picks the best sequence. The weights are learnt by
maximum likelihood (forward-backward, AdaGrad) from TRAINING_PAGES labelled
pages, which labelled_page() makes by rule from the usual ways of marking up
articles and what surrounds them; the words in them are random, so no weight
can rest on a site's vocabulary.

Defined results: null or empty html, or a page without main text, gives an empty
text. Scripts, styles, comments, titles and other raw elements are never text.
Unclosed and stray tags are tolerated. Every input row gives one output row.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import small_batches, table

TRAINING_PAGES, EPOCHS, SEED = 2500, 6, 11

RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "form", "aside", "nav", "footer", "header", "blockquote"}
MARKUP = re.compile(r"<(?:!--|/?[a-zA-Z]|[!?/])")
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"""['">]""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Za-z]+")


class Tags:
    """Finds a page's tags from left to right; quoted attributes can have any length and hold any sign but their quote.

    Positions between attributes from which no end is reached are remembered,
    and a quote after which there is no other ends a search at once, so that a
    page takes time in proportion to its length, whatever quotes it leaves open.
    """

    def __init__(self, page: str) -> None:
        self.page, self.dead = page, set()
        self.last = {c: page.rfind(c) for c in "'\">"}

    def after(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """Start, end, whether it closes, name and attributes of the next tag. Without a name: a comment's opening (end is start + 4), a declaration, or a tag whose quotes don't close, up to the next >."""
        page = self.page
        while (m := MARKUP.search(page, at)) is not None:
            start = m.start()
            if m[0] == "<!--":
                return start, m.end(), False, None, ""
            if start > self.last[">"]:  # only comments can follow
                at = page.find("<!--", start)
                if at < 0:
                    return None
                continue
            m = TAG_NAME.match(page, start)
            if m is not None:
                # the longest name; a quote in it opens an attribute only where the tag has no end otherwise
                cut = m.end()
                while cut > m.start(2):
                    end = self.end(cut)
                    if end >= 0:
                        return start, end, bool(m[1]), page[m.start(2) : cut], page[cut : end - 1]
                    cut = max(page.rfind("'", m.start(2), cut), page.rfind('"', m.start(2), cut))
            return start, page.find(">", start) + 1, False, None, ""
        return None

    def end(self, at: int) -> int:
        """The end of the tag whose attributes go on at at, or -1."""
        page, passed = self.page, []
        while at not in self.dead:
            passed.append(at)
            m = QUOTE_OR_END.search(page, at)
            if m is None:
                break
            if m[0] == ">":
                return m.end()
            if m.start() == self.last[m[0]]:
                break
            at = page.index(m[0], m.end()) + 1
        self.dead.update(passed)
        return -1


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: tuple, text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


class Open:
    """The open elements, with their numbers by tag, so that a tag which isn't open costs no search."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple]] = []
        self.blocks: list[tuple[str, tuple]] = []  # those that aren't inline
        self.n: dict[str, int] = {}

    def push(self, tag: str, names: tuple) -> None:
        self.stack.append((tag, names))
        self.n[tag] = self.n.get(tag, 0) + 1
        if tag not in INLINE:
            self.blocks.append((tag, names))

    def cut(self, k: int) -> None:
        for tag, _ in self.stack[k:]:
            self.n[tag] -= 1
            if tag not in INLINE:
                self.blocks.pop()
        del self.stack[k:]

    def close(self, tags: set[str], until: set[str] | None = None, inline_only: bool = False) -> None:
        """Closes the innermost of tags and what is open in it, unless one of until, or with inline_only any block, is met first."""
        if not any(self.n.get(t) for t in tags):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[k][0]
            if tag in tags:
                self.cut(k)
                return
            if (until is not None and tag in until) or (inline_only and tag not in INLINE):
                return


def leaf_blocks(page: str) -> list[Block]:
    """A block's path has (tag, names) of each ancestor, from the outside."""
    out: list[Block] = []
    open_ = Open()
    held: list[str] = []
    linked, path, blank = 0, (), True
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked, blank
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(path, text, linked))
            held.clear()
        linked, blank = 0, True

    def add(raw: str) -> None:
        nonlocal path, linked, blank
        text = html.unescape(raw) if "&" in raw else raw
        if blank:
            path = tuple(open_.blocks)
            blank = not text.strip()
        held.append(text)
        if open_.n.get("a"):
            linked += len(text)

    tags = Tags(page)
    while at < n:
        found = tags.after(at)
        if found is None:
            add(page[at:])
            break
        start, end, closing, name, attributes = found
        if start > at:
            add(page[at:start])
        at = end
        if name is None:
            if page.startswith("<!--", start):
                end = page.find("-->", at)
                at = n if end < 0 else end + 3
            continue
        tag = name.lower()
        if closing:
            if tag not in INLINE:
                flush()
            open_.close({tag}, inline_only=tag in INLINE)
            continue
        if tag in RAW:
            flush()
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = n if end is None else end.end()
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            if tag not in ("tr", "td", "th", "dt", "dd", "li"):
                open_.close({"p"}, SCOPES)  # an open paragraph ends here
            if tag in CLOSES:
                open_.close(CLOSES[tag], {"ul", "ol", "dl", "table"})
        names = tuple(dict.fromkeys(w.lower() for a in NAMES.findall(attributes) for w in PART.findall("".join(a)))) if attributes else ()
        if not (attributes.endswith("/") and tag not in INLINE):
            open_.push(tag, names)
    flush()
    return out


@lru_cache(maxsize=100_000)
def path_features(path: tuple) -> tuple[str, ...]:
    out = {"bias"}
    for tag, names in path:
        out.add(f"in {tag}")
        out.update(f"name {x}" for x in names)
    if path:
        out.add(f"own {path[-1][0]}")
        out.update(f"near {t}" for t, _ in path[-2:-1])
    return tuple(sorted(out))


def text_features(b: Block) -> list[str]:
    n = len(b.text)
    out = [f"length {min(8, n.bit_length())}", f"links {math.ceil(3 * min(1.0, b.linked / n))}"]
    if b.text[-1] in ".!?:;\"'”)":
        out.append("ends")
    if "©" in b.text:
        out.append("copyright")
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    return [[*path_features(b.path), *text_features(b)] for b in blocks]


class Field:
    """weights: of label main against other, by feature; moves[a][b]: from label a to b; first: of main at the start."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.moves, self.first = [[0.0, 0.0], [0.0, 0.0]], 0.0

    def scores(self, rows: list[list[str]]) -> list[float]:
        w = self.weights
        return [sum([w.get(f, 0.0) for f in r]) for r in rows]

    def viterbi(self, s: list[float]) -> list[int]:
        (m00, m01), (m10, m11) = self.moves
        a, b, back = 0.0, s[0] + self.first, []
        for x in s[1:]:
            from0, from1 = (a + m00 >= b + m10), (a + m01 > b + m11)
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + m00 if from0 else b + m10), (a + m01 if from1 else b + m11) + x
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def marginals(self, s: list[float]) -> tuple[list[float], list[list[float]]]:
        """P(main) of each block, and the expected counts of moves."""
        e = [[math.exp(x) for x in r] for r in self.moves]
        u = [(1.0, math.exp(max(-30.0, min(30.0, x)))) for x in s]
        f = [[u[0][0], u[0][1] * math.exp(self.first)]]
        f[0] = [x / sum(f[0]) for x in f[0]]
        for k in range(1, len(s)):
            r = [(f[-1][0] * e[0][y] + f[-1][1] * e[1][y]) * u[k][y] for y in (0, 1)]
            z = sum(r)
            f.append([x / z for x in r])
        b, p, moves = [1.0, 1.0], [0.0] * len(s), [[0.0, 0.0], [0.0, 0.0]]
        for k in range(len(s) - 1, -1, -1):
            g = [f[k][y] * b[y] for y in (0, 1)]
            p[k] = g[1] / sum(g)
            if k:
                pair = [[f[k - 1][x] * e[x][y] * u[k][y] * b[y] for y in (0, 1)] for x in (0, 1)]
                z = sum(map(sum, pair))
                for x in (0, 1):
                    for y in (0, 1):
                        moves[x][y] += pair[x][y] / z
                b = [sum(e[x][y] * u[k][y] * b[y] for y in (0, 1)) for x in (0, 1)]
                z = sum(b)
                b = [x / z for x in b]
        return p, moves


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """pages: features and labels of each page's blocks."""
    field, seen = Field(), {}

    def step(key, gradient: float, value: float) -> float:
        gradient -= decay * value
        seen[key] = seen.get(key, 1e-2) + gradient * gradient
        return value + rate * gradient / math.sqrt(seen[key])

    order = random.Random(SEED)
    for _ in range(epochs):
        for rows, labels in order.sample(pages, len(pages)):
            if not rows:
                continue
            p, expected = field.marginals(field.scores(rows))
            gradient: dict[str, float] = {}
            for r, y, q in zip(rows, labels, p, strict=True):
                for f in r:
                    gradient[f] = gradient.get(f, 0.0) + y - q
            for f, g in gradient.items():
                field.weights[f] = step(f, g, field.weights.get(f, 0.0))
            field.first = step("first", labels[0] - p[0], field.first)
            for a in (0, 1):
                for b in (0, 1):
                    n = sum(1 for x, y in zip(labels, labels[1:], strict=False) if (x, y) == (a, b))
                    field.moves[a][b] = step((a, b), n - expected[a][b], field.moves[a][b])
    return field


#: Ways of marking up what isn't the article: tags, and words for classes and ids.
OTHER = {
    "menu": (["nav", "div", "ul", "header"], "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager links skip"),
    "header": (["header", "div"], "header masthead site top logo branding hero tagline"),
    "footer": (["footer", "div"], "footer bottom colophon copyright legal imprint credits"),
    "side": (["aside", "div", "section"], "sidebar aside side widget related recommended popular trending tags rail archive more"),
    "ad": (["div", "aside", "section"], "ad ads advert adverts advertisement sponsor sponsored promo promotion banner commercial"),
    "notice": (["div", "section", "aside", "dialog"], "notice cookie cookies consent gdpr alert popup modal overlay warning paywall message"),
    "form": (["form", "div"], "form login search newsletter subscribe signup register contact share social"),
    "comments": (["div", "section", "ol", "ul", "aside"], "comment comments discussion replies reply respond reader responses thread feedback disqus"),
}
MAIN = (["article", "main", "div", "section"], "article content post entry story main body text page")
SYLLABLES = "ka lo mi ren tu sol va deth or pin qua zem fi bru nat".split()


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page's html and, in the order of its blocks, 1 for main text."""
    labels: list[int] = []
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence(a: int = 1, b: int = 40) -> str:
        return words(a, b).capitalize() + rng.choice([".", ".", ".", "!", "?", "", " ###", " |"])

    def attributes(names: str) -> str:
        if rng.random() < 0.25:
            return ""
        name = "-".join(rng.sample(names.split(), k=min(rng.randint(1, 2), len(names.split()))))
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def text(y: int, inner: str) -> str:
        labels.append(y)
        if rng.random() < 0.15:
            inner = f"<b>{inner}</b>" if rng.random() < 0.5 else f"{inner} <a href='/{word()}'>{word()}</a>"
        return inner

    def linked(y: int) -> str:
        labels.append(y)
        return f'<a href="/{word()}">{words(1, 3)}</a>'

    def other(kind: str, inside: bool = False) -> str:
        tags, names = OTHER[kind]
        tag = rng.choice(tags[:1] if inside and kind in ("menu", "form", "footer") else tags)
        named = attributes(names) if tag in ("nav", "header", "footer", "aside", "form", "dialog") else f' {rng.choice(["class", "class", "id"])}="{rng.choice(names.split())}"'
        body = ""
        shape = {"menu": 0, "header": rng.choice([0, 1, 2]), "comments": rng.choice([2, 3, 3]), "form": 4}.get(kind, rng.randint(0, 3))
        if shape == 0:
            body = "<ul>" + "".join(f"<li>{linked(0)}</li>" for _ in range(rng.randint(1, 7))) + "</ul>"
        elif shape == 1:
            body = text(0, sentence(1, 20))
        elif shape == 2:
            body = "".join(f"<{t}>{text(0, sentence())}</{t}>" for t in rng.choices(["p", "p", "p", "div", "h2", "h3", "h4", "li"], k=rng.randint(1, 5)))
        elif shape == 3:
            body = "".join(f"<div{attributes(names)}><p>{text(0, sentence())}</p></div>" for _ in range(rng.randint(1, 4)))
        else:
            body = f"<label>{text(0, words(1, 3))}</label><br><input name=q><p>{text(0, sentence(1, 8))}</p><button>{text(0, words(1, 2))}</button>"
        if kind == "footer" and rng.random() < 0.5:
            body += f"<p>{text(0, '&copy; ' + words(1, 6))}</p>"
        return f"<{tag}{named}>{body}</{tag}>"

    def article() -> str:
        tag = rng.choices(MAIN[0], [6, 2, 2, 1])[0]
        named = attributes(MAIN[1]) if tag in ("article", "main") else f' class="{rng.choice(MAIN[1].split())}"'
        body = f"<h1>{text(1, sentence(1, 12))}</h1>" if rng.random() < 0.8 else ""
        for _ in range(rng.randint(1, 9)):
            t = rng.choices(["p", "h2", "h3", "ul", "blockquote", "pre", "div", "table", "bare", "open"], [14, 2, 1, 1, 1, 1, 1, 1, 1, 2])[0]
            if t == "ul":
                body += "<ul>" + "".join(f"<li>{text(1, sentence(1, 12))}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
            elif t == "table":
                body += "<table><tr>" + "".join(f"<td>{text(1, words(1, 3))}</td>" for _ in range(rng.randint(1, 4))) + "</tr></table>"
            elif t == "bare":
                body += f"</p><hr>{text(1, sentence())}<hr>"
            elif t == "open":
                body += f"<p><b>{text(1, sentence())}<br>"
            elif t == "blockquote":
                body += f"<blockquote><p>{text(1, sentence())}</p></blockquote>"
            else:
                body += f"<{t}>{text(1, sentence())}</{t}>"
            if rng.random() < 0.07:
                body += other(rng.choice(["ad", "side", "form", "notice", "menu"]), inside=True)
        if rng.random() < 0.15:
            body += other("comments", inside=True)
        return f"<{tag}{named}>{body}</{tag}>"

    parts = [other(k) for k in rng.choices(["menu", "header", "ad", "notice", "form"], k=rng.randint(0, 3))]
    parts.append(article())
    parts += [other(k) for k in rng.choices(["side", "ad", "comments", "comments", "footer", "footer", "form", "notice", "menu"], k=rng.randint(0, 4))]
    inner = "".join(parts)
    if rng.random() < 0.3:
        inner = f'<div class="{rng.choice(["wrapper", "container", "page", "site", "layout"])}">{inner}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{inner}</body></html>", labels


@lru_cache(maxsize=1)
def trained_field(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Field:
    rng, samples = random.Random(seed), []
    for _ in range(pages):
        page, labels = labelled_page(rng)
        rows = features(leaf_blocks(page))
        if len(rows) != len(labels):
            raise AssertionError("a labelled page and its blocks disagree")
        samples.append((rows, labels))
    return train(samples, epochs)


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page or "")
    if not blocks:
        return ""
    labels = field.viterbi(field.scores(features(blocks)))
    return "\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extracted(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """pages with text and n_chars in place of html."""
    small_batches(pages.sparkSession)
    field = field or trained_field()

    @F.pandas_udf("string")
    def text(html_: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, field) for x in html_], dtype=object)

    out = pages.withColumn("text", text("html"))
    return out.withColumn("n_chars", F.length("text").cast("long")).drop("html")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
