"""Main text of web pages by a conditional random field over the leaf blocks of their markup.

A page becomes the list of its blocks: stretches of text between tags that open or close a block. A block's features are
the tags, class and id words of the elements around it, and shape, links and place of its text. A linear chain
of two states, main text and the rest, is trained by maximum likelihood on labelled pages and decoded by Viterbi.

Pages carry no labels, so they are made from a bounded sample (``SAMPLE`` pages): blocks inside ``article`` or ``main``
and not inside an element that says it is something else are main text. Each labelled page is also rebuilt with other
markup, with its article in a plain container and with menus, side bars, notices, forms and comments around and inside
it, so that the model does not depend on one tag. Every page is parsed whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 250

# Fixed values of HTML: elements whose content is not text, elements that begin a block, elements without content.
RAW = "script|style|title|textarea|noscript|template|iframe|svg|math|select|button|object|audio|video|canvas"
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
TO_THE_END = frozenset("script style title textarea iframe".split())  # of the first kind: raw text, which unclosed goes on to the end of the page
SELF_CLOSED = frozenset(["svg", "math"])  # of the first kind: complete with "/>"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {  # an opening tag ends these, up to the container
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
APART = frozenset("nav aside footer header form dialog menu".split())
APART_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer footer form header legal login menu nav "
    "navbar navigation newsletter notice pagination popup promo promoted recommended related reply replies share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget".split()
)
MAIN_WORDS = "article body content entry main post story text page".split()

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][a-z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|([^<]+|<)",
    re.I | re.S | re.A,
)
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I | re.A) for name in RAW.split("|")}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z0-9]+")
Block = tuple[tuple[str, ...], str, int]  # features of the elements around it, text, characters in links


@lru_cache(maxsize=1 << 14)
def _element(tag: str, attributes: str) -> tuple[str, ...]:
    words = []
    if "=" in attributes:
        for found in _NAMES.findall(attributes):
            words += [w for w in _SPLIT.split("".join(found).lower()) if w]
    return ("t:" + tag, *("c:" + w for w in dict.fromkeys(words)))


def blocks(page: str | None) -> tuple[list[Block], str]:
    """The blocks of a page in order, and its title."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    around: tuple[str, ...] = ()
    text: list[str] = []
    in_link, linked, title = 0, 0, ""

    def close() -> None:
        nonlocal linked
        if text:
            joined = "".join(text)
            if "&" in joined:
                joined = html.unescape(joined)
            joined = _SPACE.sub(" ", joined).strip()
            if joined:
                out.append((around, joined, linked))
            text.clear()
        linked = 0

    page, at, unclosed = page or "", 0, set()
    while match := _TOKEN.match(page, at):
        at = match.end()
        raw, raw_attributes, end, tag, attributes, end2, tag2, attributes2, plain = match.groups()
        if plain is not None:
            text.append(plain)
            if in_link:
                linked += len(plain)
            continue
        if raw is not None:
            raw = raw.lower()
            if raw in SELF_CLOSED and raw_attributes.endswith("/"):
                continue
            ended = None if raw in unclosed else _END[raw].search(page, at)
            if ended is None:
                unclosed.add(raw)  # nor is there an end for later ones
                if raw not in TO_THE_END:
                    continue
            inside, at = (page[at : ended.start()], ended.end()) if ended else (page[at:], len(page))
            if raw == "title" and not title:
                title = _SPACE.sub(" ", html.unescape(inside)).strip()
            continue
        if tag is None:
            end, tag, attributes = end2, tag2, attributes2
            if tag is None:
                continue
        tag = tag.lower()
        if tag not in BLOCK:
            if tag == "a":
                in_link = 0 if end else 1
            elif tag == "br":
                text.append(" ")
            continue
        close()
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in CLOSES:
                ended, within = CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in within:
                        break
                    if stack[i][0] in ended:
                        del stack[i:]
                        break
            if tag not in VOID:
                parent = stack[-1][1] if stack else ()
                stack.append((tag, tuple(dict.fromkeys((*parent, *_element(tag, attributes))))))
        around = (*stack[-1][1], "l:" + stack[-1][0]) if stack else ()
    close()
    return out, title


def text_features(text: str, linked: int, title: str, place: int, count: int) -> tuple[str, ...]:
    """Features of a block's text: length, links, how it ends, signs, title, place."""
    words = text.count(" ") + 1
    share = linked / len(text)
    out = [
        f"w:{min(words.bit_length(), 7)}",
        "k:none" if not linked else "k:some" if share < 0.5 else "k:most",
        "e:stop" if text[-1] in ".!?…\"'”»:;" else "e:open",
    ]
    if "©" in text or "®" in text:
        out.append("s:right")
    if "|" in text or "›" in text or "»" in text:
        out.append("s:bar")
    if title and (text == title or (len(title) > 5 and text.startswith(title))):
        out.append("h:title")
    if place == 0:
        out.append("p:first")
    if place == count - 1:
        out.append("p:last")
    return tuple(out)


def _weak_label(around: tuple[str, ...]) -> int:
    tags, words = {f[2:] for f in around if f[0] == "t"}, {f[2:] for f in around if f[0] == "c"}
    return int(bool(tags & {"article", "main"}) and not tags & APART and not words & APART_WORDS)


Sequence = list[tuple[tuple[str, ...], int]]  # features and label of each block


def _features(page: list[Block], title: str) -> list[tuple[str, ...]]:
    return [(*around, *text_features(text, linked, title, i, len(page))) for i, (around, text, linked) in enumerate(page)]


def _rebuilt(page: list[Block], labels: list[int], title: str, others: list[str], random: np.random.Generator) -> Sequence:
    """The page's main text in other markup, with other parts around and inside it that are filled with texts of other pages."""
    shell = ("t:html", "t:body")

    def some(low: int, high: int) -> list[str]:
        return [others[random.integers(len(others))] for _ in range(random.integers(low, high))] if others else []

    def words(found: list[str]) -> list[tuple[str, int]]:
        cut = [" ".join(t.split(" ")[: random.integers(1, 5)]) for t in found]
        return [(t, len(t)) for t in cut]

    def sentences(found: list[str]) -> list[tuple[str, int]]:
        return [(t, 0) for t in found]

    def part(tags: list[str], names: list[str], last: str, texts: list[tuple[str, int]]) -> list[tuple[Block, int]]:
        around = tuple(dict.fromkeys((*shell, *("t:" + t for t in tags), *("c:" + n for n in names), "t:" + last, "l:" + last)))
        return [((around, t, n), 0) for t, n in texts if t]

    def pick(*choices):
        return choices[random.integers(len(choices))]

    built: list[tuple[Block, int]] = []
    built += part([pick("header", "div")], [pick("header", "banner", "top", "site")], "div", words(some(1, 3)))
    built += part([pick("nav", "div"), "ul"], [pick("nav", "menu", "navigation", "navbar", "breadcrumb")], "li", words(some(3, 8)))
    built += part(["div"], [pick("cookie", "notice", "disclaimer", "popup", "banner", "newsletter")], pick("div", "p"), sentences(some(0, 2)))
    built += part([pick("div", "aside", "section")], [pick("ad", "ads", "advert", "sponsored", "promo")], pick("div", "p"), sentences(some(0, 2)))
    holder = [pick("div", "section", "article", "main", "td")]
    names = [pick(*MAIN_WORDS, "") for _ in range(random.integers(0, 3))]
    main = [(b, 1) for b, y in zip(page, labels) if y]
    own = []
    for (around, text, linked), _ in main:
        last = around[-1][2:] if around else "p"
        kept = tuple(dict.fromkeys((*shell, *("t:" + t for t in holder), *("c:" + n for n in names if n), "t:" + last, "l:" + last)))
        own.append(((kept, text, linked), 1))
    at = int(random.integers(len(own) + 1))
    within = part([*holder, pick("div", "aside")], [*[n for n in names if n], pick("ad", "related", "share", "sponsored", "newsletter", "widget")], pick("div", "p", "li"), sentences(some(0, 2)))
    built += own[:at] + within + own[at:]
    inside = holder if random.random() < 0.5 else []
    built += part([*inside, pick("section", "div", "ol")], [pick("comments", "comment", "replies")], pick("p", "li", "div"), sentences(some(0, 5)))
    built += part([pick("aside", "div")], [pick("sidebar", "related", "widget", "recommended")], pick("li", "p", "div"), pick(words, sentences)(some(0, 5)))
    built += part(["form"], [pick("form", "login", "subscribe", "signup", "search")], pick("div", "p", "legend"), words(some(0, 3)))
    built += part([pick("footer", "div")], [pick("footer", "legal", "copyright")], pick("div", "p", "footer"), sentences(some(1, 3)))
    return list(zip(_features([b for b, _ in built], title), [y for _, y in built]))


def labelled_sequences(pages: list[str], seed: int = 9, rebuilt: int = 2) -> list[Sequence]:
    """Training sequences of some pages: as they are, where weak labels tell main text from the rest, and rebuilt."""
    random, parsed = np.random.default_rng(seed), []
    for page in pages:
        found, title = blocks(page)
        labels = [_weak_label(around) for around, _, _ in found]
        if any(labels):
            parsed.append((found, labels, title))
    others = [t for found, _, _ in parsed for _, t, _ in found]
    out: list[Sequence] = []
    for found, labels, title in parsed:
        out.append(list(zip(_features(found, title), labels)))
        out += [_rebuilt(found, labels, title, others, random) for _ in range(rebuilt)]
    return [s for s in out if s]


class Chain:
    """Weights of features for main text against the rest, scores of neighbouring states, and of the first state."""

    def __init__(self, weights: dict[str, float], step: np.ndarray, first: np.ndarray):
        self.weights, self.step, self.first = weights, step, first

    def decode(self, emissions: list[float]) -> list[int]:
        """The best states, by Viterbi; ties go to the rest."""
        (s00, s01), (s10, s11) = self.step.tolist()
        f0, f1 = self.first.tolist()
        if not emissions:
            return []
        back = []
        a, b = f0, f1 + emissions[0]
        for e in emissions[1:]:
            to0, to1 = b + s10 > a + s00, b + s11 > a + s01
            back.append((to0, to1))
            a, b = (b + s10 if to0 else a + s00), (b + s11 if to1 else a + s01) + e
        state = int(b > a)
        out = [state]
        for to0, to1 in reversed(back):
            state = int(to1 if state else to0)
            out.append(state)
        return out[::-1]


def train_chain(sequences: list[Sequence], rounds: int = 100, rate: float = 0.1, ridge: float = 1e-3) -> Chain:
    """Maximum likelihood with forward and backward sums over all sequences at once, by Adam."""
    if not sequences:
        return Chain({}, np.zeros((2, 2)), np.array([1.0, 0.0]))
    names: dict[str, int] = {}
    n, longest = len(sequences), max(map(len, sequences))
    cell, feature = [], []
    y, mask = np.zeros((n, longest), dtype=np.int64), np.zeros((n, longest), dtype=bool)
    for i, sequence in enumerate(sequences):
        for t, (found, label) in enumerate(sequence):
            y[i, t], mask[i, t] = label, True
            for name in found:
                cell.append(i * longest + t)
                feature.append(names.setdefault(name, len(names)))
    cell, feature = np.array(cell), np.array(feature)
    theta = np.zeros(len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    both = mask[:, 1:] & mask[:, :-1]
    seen = np.zeros(6)
    np.add.at(seen, (y[:, :-1] * 2 + y[:, 1:])[both], 1)
    np.add.at(seen, 4 + y[:, 0], 1)
    cells = mask.sum()
    for round_ in range(1, rounds + 1):
        step, first = theta[-6:-2].reshape(2, 2), theta[-2:]
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = np.bincount(cell, weights=theta[feature], minlength=n * longest).reshape(n, longest)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = first + e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(forward[:, t - 1, :1] + step[0], forward[:, t - 1, 1:] + step[1]) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = backward[:, t + 1] + e[:, t + 1]
            new = np.logaddexp(ahead[:, :1] + step[:, 0], ahead[:, 1:] + step[:, 1])
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        p1 = np.exp(np.clip(forward[:, :, 1] + backward[:, :, 1] - total[:, None], -700, 0)) * mask
        pairs = np.exp(np.clip(forward[:, :-1, :, None] + step + (e + backward)[:, 1:, None, :] - total[:, None, None, None], -700, 0)) * both[:, :, None, None]
        gradient = np.empty_like(theta)
        gradient[:-6] = np.bincount(feature, weights=((p1 - y) * mask).ravel()[cell], minlength=len(names))
        gradient[-6:-2] = pairs.sum(axis=(0, 1)).ravel() - seen[:4]
        gradient[-2:] = np.array([n - p1[:, 0].sum(), p1[:, 0].sum()]) - seen[4:]
        gradient = gradient / cells + ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta - rate * (m / (1 - 0.9**round_)) / (np.sqrt(v / (1 - 0.99**round_)) + 1e-4)
    weights = {name: float(theta[i]) for name, i in names.items()}
    return Chain(weights, theta[-6:-2].reshape(2, 2), theta[-2:])


class Extractor:
    """Main text of pages by a trained chain; scores of surroundings are remembered."""

    def __init__(self, chain: Chain):
        self.chain, self.memo = chain, {}

    def __call__(self, page: str | None) -> str:
        found, title = blocks(page)
        weights, memo, scores = self.chain.weights, self.memo, []
        if len(memo) > 1 << 16:
            memo.clear()
        for i, (around, text, linked) in enumerate(found):
            score = memo.get(around)
            if score is None:
                score = memo[around] = sum(weights.get(f, 0.0) for f in around)
            scores.append(score + sum(weights.get(f, 0.0) for f in text_features(text, linked, title, i, len(found))))
        return " ".join(b[1] for b, state in zip(found, self.chain.decode(scores)) if state)


def train(pages: DataFrame, sample: int = SAMPLE) -> Chain:
    """A chain from the ``sample`` different pages with the smallest hashes among those that have an article or main element.

    Tasks send hashes to choose from; only the chosen pages are fetched, once each. Of pages that share a hash the least stays.
    """
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]")).select("html", F.xxhash64("html").alias("_h"))
    hashes = [r["_h"] for r in marked.select("_h").distinct().orderBy("_h").limit(sample).collect()]
    if not hashes:
        return train_chain(labelled_sequences([]))
    chosen = marked.where((F.col("_h") <= hashes[-1]) & F.col("_h").isin(hashes)).groupBy("_h").agg(F.min("html").alias("html"))
    return train_chain(labelled_sequences([r["html"] for r in chosen.orderBy("_h").collect()]))


def extract(pages: DataFrame, chain: Chain) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages`` (page_id, url, html).

    A null or empty page, one without text and one without main text give an empty text. Character references are
    decoded, white space inside a block is one space, blocks are joined in page order by one space; nothing else is
    changed or cut. Repeated rows stay. Broken markup is read as far as it goes: an unclosed comment,
    script, style, title, textarea or iframe ends with the page, of other unclosed elements only the tag is left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Extractor(chain)
        for frame in frames:
            texts = [of(p) for p in frame["html"]]
            yield pd.DataFrame({"_id": frame["_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(F.col("page_id").cast("string").alias("_id"), "url", "html")  # pandas has no whole numbers with nulls
    return rows.mapInPandas(run, "_id string, url string, text string, n_chars bigint").select(F.col("_id").cast(kind).alias("page_id"), "url", "text", "n_chars")
