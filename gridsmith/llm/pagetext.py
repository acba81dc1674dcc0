"""Main text of web pages by maximum-scoring subsequence.

A page is read as a sequence of text runs and tags.  A run's words score positive
or negative, 2 p - 1 each, where p is the probability that such words are main
text; tags score negative by their name.  One linear scan finds the contiguous
region with the greatest sum.  If it lies within an element of a kind that hardly
ever holds anything but main text (an article), it grows to that element, so that a
short last paragraph or what follows a form is not lost.  The runs inside the region
whose words score positive are the main text.

Weights are learned from labelled pages (``labelled_pages``: random layouts whose
main text is marked): a logistic regression over structure alone, the nearest
block's name, the elements around it, the length of the block and its share of
links; and for each tag its share of occurrences outside main text.  Class names and
ids play no part.

Output: character references decoded, white space inside a block made one space,
blocks joined in page order by a blank line.  Null and empty pages, and pages
without a positive region, have the text "".  Broken markup is read leniently: an
unclosed tag at the end is dropped, an unclosed comment, script or style runs to
the end, a stray end tag closes nothing.  Pages of any length are read whole;
repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm.arrowmap import arrow_map, table

#: Markup, in the order in which it is tried at a "<".
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript|svg|textarea|select|iframe|object|canvas)(?![\w:-])[^>]*(?:>|\Z).*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:\s+|/|[^\s\"'<>=/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)*)[^>]*(?:>|\Z)",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr button input label b bdi bdo cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag of the key closes when they are open and nearest.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "body": {"head"}}
BLOCKS_CLOSE_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Bounds of the classes of block length in words, and of a block's share of linked words.
LENGTHS, LINKED = (1, 3, 8, 20, 50), (0.0, 0.3, 0.7)
PAGES, SEED = 400, 11
ROUNDS, RATE, L2 = 400, 0.5, 1e-3
TAG_LEAST, TAG_SCALE, INLINE_SCALE, HOLDS = 0.01, 6.0, 0.3, 0.95


class Run:
    """A text run: its place among the items, the elements around it, and its block."""

    __slots__ = ("text", "words", "around", "block", "at")

    def __init__(self, text: str, around: tuple[tuple[str, int], ...], block: int, at: int):
        self.text, self.around, self.block, self.at = text, around, block, at
        self.words = len(text.split())


def items(page: str) -> list[Run | tuple[str, bool]]:
    """Runs and tags (name, whether it parts blocks) in page order.  Around a run are (name, serial number) of its open elements."""
    stack: list[tuple[str, int]] = []
    out: list[Run | tuple[str, bool]] = []
    block = serial = at = 0
    around: tuple[tuple[str, int], ...] = ()
    for m in MARKUP.finditer(page):
        if m.start() > at:
            out.append(Run(page[at : m.start()], around, block, at))
        at = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
        elif name not in VOID:
            closing = CLOSES.get(name, set()) | ({"p"} if name in BLOCKS_CLOSE_P else set())
            if closing:
                # inline elements left open inside the block that closes go with it
                k = len(stack)
                while k and stack[k - 1][0] in INLINE:
                    k -= 1
                if k and stack[k - 1][0] in closing:
                    del stack[k - 1 :]
            serial += 1
            stack.append((name, serial))
        around = tuple(stack)
        parts = name not in INLINE and name != "br"
        block += parts
        out.append((name, parts))
    if at < len(page):
        out.append(Run(page[at:], around, block, at))
    return out


def _class_of(value: float, bounds: tuple[float, ...]) -> int:
    return sum(value > b for b in bounds)


def features(run: Run, length: int, linked: float) -> list[str]:
    """What a run's words are judged by: its nearest block, the elements around, and its block's length and share of links."""
    names = {n for n, _ in run.around}
    block = next((n for n, _ in reversed(run.around) if n not in INLINE), "")
    return [f"block {block}", *sorted(f"in {n}" for n in names), f"length {_class_of(length, LENGTHS)}", f"linked {_class_of(linked, LINKED)}"]


def blocks_of(seq: list[Run | tuple[str, bool]]) -> dict[int, tuple[int, float]]:
    """Words and share of linked words of each block."""
    words, linked = Counter(), Counter()
    for x in seq:
        if isinstance(x, Run):
            words[x.block] += x.words
            if any(n in ("a", "button", "label") for n, _ in x.around):
                linked[x.block] += x.words
    return {b: (n, linked[b] / n if n else 0.0) for b, n in words.items()}


# Labelled pages: random layouts; what is between the marks is main text.
MARKS = ("<!--[-->", "<!--]-->")


def _layout(rng: random.Random) -> str:
    """One page: a main text in one of several structures, other parts around it and sometimes inside it, classes without meaning."""
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.choice((1, 2, 2, 3))))
    say = lambda lo, hi: (" ".join(word() for _ in range(rng.randint(lo, hi))) + rng.choice(".. !?")).strip().capitalize()
    link = lambda lo=1, hi=3: f'<a href="/{word()}">{say(lo, hi)}</a>'
    named = lambda tag: f'<{tag} class="{word()}">' if rng.random() < 0.5 else f"<{tag}>"
    within = lambda tag, *parts: named(tag) + "".join(parts) + f"</{tag}>"
    many = lambda lo, hi, make: "".join(make() for _ in range(rng.randint(lo, hi)))

    def prose() -> str:
        text = say(1, 6) if rng.random() < 0.15 else say(8, 90)
        if rng.random() < 0.3:
            at = text.find(" ", len(text) // 2) + 1
            text = text[:at] + rng.choice(("<b>{}</b> ", "<i>{}</i> ", "<br>{} ", "<b>{} ", '<a href="/x">{}</a> ')).format(word()) + text[at:]
        return text

    def piece(direct: bool) -> str:
        kind = rng.random()
        if kind < 0.72:
            return within("div" if direct else "p", prose())
        if kind < 0.82:
            return within(rng.choice(("h2", "h3", "h4")), say(1, 7))
        if kind < 0.9:
            return within(rng.choice(("ul", "ol")), many(2, 5, lambda: within("li", say(2, 25))))
        if kind < 0.94:
            return within("blockquote", within("p", prose()))
        if kind < 0.97:
            return within("table", many(1, 4, lambda: within("tr", within("td", say(1, 4)), within("td", say(1, 9)))))
        return within("figure", '<img src="/m.png">', within("figcaption", say(2, 9))) if rng.random() < 0.5 else within("pre", say(4, 20))

    outer = [
        lambda: within("nav", within("ul", many(1, 8, lambda: within("li", link() if rng.random() < 0.8 else say(1, 2))))),
        lambda: within("div", many(3, 8, lambda: link() + " ")),
        lambda: within("header", link(), within("p", say(2, 8))),
        lambda: within("footer", within("p", say(3, 14)), many(0, 4, link)) if rng.random() < 0.6 else within("footer", say(2, 12)),
        lambda: within("aside", within("h3", say(1, 4)), within("ul", many(2, 6, lambda: within("li", link(2, 9))))),
        lambda: within("aside", within("p", say(4, 25))),
        lambda: within("form", within("label", say(1, 4)), "<input>", within("button", say(1, 2))),
        lambda: within("section", within("h3", say(1, 2)), many(2, 6, lambda: within("div", within("p", link(1, 2)), within("p", say(2, 25))))),
        lambda: within("ol", many(2, 6, lambda: within("li", link(1, 2), within("p", say(2, 25))))),
    ]
    advert = lambda: within("div", rng.choice((say(3, 20), link(3, 9))))
    direct = rng.random() < 0.1
    if rng.random() < 0.1:  # no main text at all
        return "".join(rng.choice(outer)() for _ in range(rng.randint(1, 3)))
    if rng.random() < 0.25:  # a short text alone
        text = MARKS[0] + (say(2, 12) if rng.random() < 0.2 else within(rng.choice(("p", "p", "div")), say(2, 12))) + many(0, 2, lambda: within("p", prose())) + MARKS[1]
        return rng.choice(("{}", "{}", "<html><body>{}</body></html>")).format(text)
    body = [within("h1", say(1, 12)), *(piece(direct) for _ in range(rng.randint(3, 14)))]
    for part in outer[5:8] + [advert]:  # what interrupts a text
        if rng.random() < 0.06:
            at = rng.randrange(1, len(body))
            body[at:at] = [MARKS[1] + part() + MARKS[0]]
    text = MARKS[0] + "".join(body) + MARKS[1]
    frame = rng.random()
    if frame < 0.2:  # sections of a text
        cut = rng.randrange(1, len(body) + 1)
        text = MARKS[0] + within("section", *body[:cut]) + (within("section", *body[cut:]) if body[cut:] else "") + MARKS[1]
    frame = rng.random()
    text = within("article", text) if frame < 0.5 else within("main", within("div", text)) if frame < 0.7 else within("div", text) if frame < 0.9 else text
    before = [advert() if rng.random() < 0.4 else rng.choice(outer[:4])() for _ in range(rng.randint(0, 4))]
    after = [advert() if rng.random() < 0.15 else rng.choice(outer)() for _ in range(rng.randint(0, 4))]
    return f"<html><head><title>{say(1, 8)}</title></head><body>{''.join(before)}{text}{''.join(after)}</body></html>"


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> list[str]:
    rng = random.Random(seed)
    return [_layout(rng) for _ in range(pages)]


class Weights:
    """A bias and weights of features for words; scores of tags; elements that hold main text alone."""

    def __init__(self, bias: float, words: dict[str, float], tags: dict[str, float], holders: frozenset[str]):
        self.bias, self.words, self.tags, self.holders = bias, words, tags, holders


def learn(pages: list[str]) -> Weights:
    """Weights from pages with marks.  Runs count by their number of words, to the power 1/2."""
    rows, labels, sizes, index = [], [], [], {}
    tags, held, all_words = (Counter(), Counter()), (Counter(), Counter()), 0
    for page in pages:
        spans, plain, state = [], "", False
        for part in re.split("(" + "|".join(map(re.escape, MARKS)) + ")", page):
            if part in MARKS:
                state = part == MARKS[0]
            else:
                spans.append((len(plain), state))
                plain += part
        seq = items(plain)
        found = [m for m in MARKUP.finditer(plain) if m[3] is not None]
        starts = np.array([a for a, _ in spans])
        inside = lambda at: spans[int(np.searchsorted(starts, at, side="right")) - 1][1]  # noqa: E731, B023
        for m in found:
            tags[inside(m.start())][m[3].lower()] += 1
        blocks = blocks_of(seq)
        for x in seq:
            if isinstance(x, Run) and x.words:
                fs = features(x, *blocks[x.block])
                rows.append([index.setdefault(f, len(index)) for f in fs])
                labels.append(float(inside(x.at)))
                sizes.append(x.words**0.5)
                for n in {n for n, _ in x.around}:
                    held[inside(x.at)][n] += x.words
    width = len(index)
    flat = np.array([j for r in rows for j in r], np.int64)
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    y, size = np.array(labels), np.array(sizes)
    size /= size.sum() or 1.0
    w, bias, g_w, g_b = np.zeros(width), 0.0, np.full(width, 1e-8), 1e-8
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row_of, w[flat], minlength=len(rows)))))
        d = (y - p) * size
        d_w, d_b = np.bincount(flat, d[row_of], minlength=width) - L2 * w / width, d.sum()
        g_w, g_b = g_w + d_w**2, g_b + d_b**2
        w, bias = w + RATE * d_w / np.sqrt(g_w), bias + RATE * d_b / np.sqrt(g_b)
    share = {t: (tags[0][t] + 1) / (tags[0][t] + tags[1][t] + 2) for t in tags[0].keys() | tags[1].keys()}
    holders = frozenset(n for n in held[1] if held[1][n] >= HOLDS * (held[0][n] + held[1][n]) and n not in INLINE and share.get(n, 0) > 0.5)
    return Weights(float(bias), {f: float(w[j]) for f, j in index.items()}, {t: -(TAG_LEAST + (INLINE_SCALE if t in INLINE else TAG_SCALE) * s**3) for t, s in share.items()}, holders)


@cache
def default_weights() -> Weights:
    return learn(labelled_pages())


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous part with the greatest sum, in one pass; empty if no sum is positive."""
    total = best = 0.0
    start, span = 0, (0, 0)
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


class Extractor:
    def __init__(self, weights: Weights | None = None):
        self.weights = weights or default_weights()
        self.unknown_tag = -(TAG_LEAST + TAG_SCALE / 8)

    def scores(self, seq: list[Run | tuple[str, bool]]) -> tuple[list[float], list[float]]:
        """The score of each item, and of each word of a run (0 for tags)."""
        w, blocks, known = self.weights, blocks_of(seq), {}
        total, each = [], []
        for x in seq:
            if not isinstance(x, Run):
                total.append(w.tags.get(x[0], self.unknown_tag))
                each.append(0.0)
                continue
            key = (x.around, x.block)
            if key not in known:
                z = w.bias + sum(w.words.get(f, 0.0) for f in features(x, *blocks[x.block]))
                known[key] = float(np.tanh(z / 2))  # 2 p - 1
            total.append(known[key] * x.words)
            each.append(known[key])
        return total, each

    def region(self, seq: list[Run | tuple[str, bool]], total: list[float]) -> tuple[int, int]:
        """The best region, grown to the outermost element around all its runs that holds main text alone."""
        start, end = best_region(total)
        inner = [x.around for x in seq[start:end] if isinstance(x, Run) and x.words]
        if not inner:
            return start, end
        for element in inner[0]:
            if element[0] in self.weights.holders and all(element in a for a in inner):
                own = [i for i, x in enumerate(seq) if isinstance(x, Run) and element in x.around]
                return min(start, own[0]), max(end, own[-1] + 1)
        return start, end

    def main_text(self, page: str) -> str:
        seq = items(page)
        total, each = self.scores(seq)
        start, end = self.region(seq, total)
        blocks, now = [], []
        for x, score in [*zip(seq[start:end], each[start:end], strict=True), (("", True), 0.0)]:
            if isinstance(x, Run):
                if score > 0:
                    now.append(x.text)
            elif x[1]:
                if now and (text := " ".join(html.unescape("".join(now)).split())):
                    blocks.append(text)
                now = []
            elif x[0] == "br":  # white space inside its block
                now.append(" ")
        return "\n\n".join(blocks)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page; no shuffle.  The weights are learned once, on the driver."""
    weights = weights or default_weights()

    def make():
        main_text = Extractor(weights).main_text

        def apply(keys, urls, pages):
            texts = [main_text(p) if p else "" for p in pages]
            return keys, urls, texts, [len(t) for t in texts]

        return apply

    columns = [F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")]
    return arrow_map(df.select(*columns), {"page_id": "long", "url": "string", "text": "string", "n_chars": "long"}, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every page's main text."""
    return extract(table(spark, sf_dir, "pages"))
