"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

``blocks`` walks the markup and cuts the visible text into leaf blocks, each with the tags
and class or id words of its ancestors. A block's features are those and a few traits of its
text (length, share of link text, sentence marks, ...). The chain has two labels, main
text and the rest; weights of features per label and of label pairs are trained by
gradient ascent on the log-likelihood (forward-backward over padded pages) of the labelled
pages that ``labelled_pages`` writes, and pages are decoded by Viterbi.

Inside a block white space becomes one blank; blocks are joined by a line break. Nothing
else is dropped or cut.

Rows: null or empty html gives an empty text. Markup that is broken, never closed or
nested deeply is read as far as it goes. Null ids and urls stay null, repeated rows stay.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from payflow.llm.labelled_pages import MARK, labelled_pages

INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
             "span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style head title template noscript svg iframe object canvas".split())
#: An opening tag also ends these open elements, if one is nearer than the stop list.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
STOPS = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "main", "body"}

NAME, DIGIT = re.compile(r"[a-z]+"), re.compile(r"\d")
STEPS, RATE, DECAY = 120, 0.2, 1e-3
TRAINING_PAGES = 400


class Blocks(HTMLParser):
    """Collects (text, features, label) of the leaf blocks; labels only where ``MARK`` is set. Features of the open
    elements are counted as they open and close, so a block costs its own features however deep it lies;
    with ``known`` only those features are kept."""

    def __init__(self, known: Collection[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.known = known
        self.open: list[tuple[str, list[str], str | None]] = []      # tag, its features, label in force
        self.tags: Counter[str] = Counter()
        self.above: dict[str, int] = {}
        self.parents: list[str] = []
        self.text: list[str] = []
        self.linked = self.link_depth = self.unseen = 0
        self.out: list[tuple[str, list[str], str | None]] = []

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
            self._close_implied(tag)
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        own, label = [f"tag {tag}"] if tag not in ("html", "body") else [], self.open[-1][2] if self.open else None
        if attrs:
            got = dict(attrs)
            own += [f"name {w}" for k in ("class", "id", "role") if got.get(k) for w in NAME.findall(got[k].lower())]
            label = got.get(MARK, label)
        if self.known is not None:
            own = [f for f in own if f in self.known]
        self.open.append((tag, own, label))
        self.tags[tag] += 1
        for f in own:
            self.above[f] = self.above.get(f, 0) + 1
        if tag not in INLINE:
            self.parents.append(tag)
        self.unseen += tag in UNSEEN
        self.link_depth += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        if not self.tags[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._cut(i)
                break
            if tag in INLINE and self.open[i][0] not in INLINE:
                break                                   # an inline end tag does not end a block

    def handle_data(self, data):
        if not self.unseen:
            self.text.append(data)
            if self.link_depth:
                self.linked += len(data.strip())

    def close(self):
        super().close()
        self.flush()

    def _cut(self, i: int) -> None:
        for tag, own, _ in self.open[i:]:
            self.unseen -= tag in UNSEEN
            self.link_depth -= tag == "a"
            self.tags[tag] -= 1
            for f in own:
                self.above[f] -= 1
                if not self.above[f]:
                    del self.above[f]
            if tag not in INLINE:
                self.parents.pop()
        del self.open[i:]

    def _close_implied(self, tag: str) -> None:
        ends = CLOSES.get(tag, set()) | {"p"}           # any block-level tag ends an open paragraph
        if not any(self.tags[t] for t in ends):
            return None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in ends:
                return self._cut(i)
            if self.open[i][0] in STOPS:
                return None

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                parent = self.parents[-1] if self.parents else ""
                self.out.append((text, features(text, self.above, parent, self.linked), self.open[-1][2] if self.open else None))
            self.text.clear()
            self.linked = 0


def features(text: str, above: Iterable[str], parent: str, linked: int) -> list[str]:
    out = [f"parent {parent}"]
    n = len(text)
    out.append(f"length {min(9, n.bit_length())}")
    out.append(f"linked {min(3, 4 * linked // (n + 1))}")
    out.append(f"ends {'stop' if text[-1] in '.!?' else 'mark' if not text[-1].isalnum() else 'letter'}")
    out.append(f"stops {min(3, text.count('. ') + text.count('? ') + text.count('! '))}")
    if "\N{COPYRIGHT SIGN}" in text:
        out.append("copyright sign")
    if len(DIGIT.findall(text)) * 5 > n:
        out.append("many digits")
    return ["always", *sorted([*out, *above])]


def blocks(html: str | None, known: Collection[str] | None = None) -> list[tuple[str, list[str], str | None]]:
    parser = Blocks(known)
    parser.feed(html or "")
    parser.close()
    return parser.out


class Crf:
    """Two-label chain: ``weights`` (feature, label), ``pairs`` (label, next label), ``ends`` (first, last label)."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, pairs: np.ndarray, ends: np.ndarray):
        self.pairs, self.ends = pairs, ends
        self.of = {f: tuple(weights[i].tolist()) for f, i in index.items()}

    def decode(self, page: list[list[str]]) -> list[bool]:
        """Viterbi: for each block of a page whether it is main text."""
        (p00, p01), (p10, p11) = self.pairs.tolist()
        (rest, main), (last_rest, last_main) = self.ends.tolist()
        back = []
        for k, found in enumerate(page):
            if k:
                from_rest, from_main = rest + p00 >= main + p10, rest + p01 >= main + p11
                back.append((not from_rest, not from_main))
                rest, main = (rest + p00 if from_rest else main + p10), (rest + p01 if from_main else main + p11)
            for f in found:
                w = self.of.get(f)
                if w:
                    rest += w[0]
                    main += w[1]
        label = main + last_main > rest + last_rest
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1] if page else []


def train(pages: list[list[tuple[list[str], bool]]]) -> Crf:
    """Maximum likelihood (Adam, L2) over labelled pages of (features, is main text)."""
    pages = [p for p in pages if p]
    index = {f: i for i, f in enumerate(sorted({f for p in pages for own, _ in p for f in own}))}
    n, t = len(pages), max(map(len, pages))
    x = np.zeros((n, t, len(index)), dtype=np.float32)
    y = np.zeros((n, t), dtype=int)
    on = np.zeros((n, t), dtype=bool)
    for i, p in enumerate(pages):
        for j, (own, label) in enumerate(p):
            x[i, j, [index[f] for f in own]] = 1
            y[i, j], on[i, j] = label, True
    size = on.sum(axis=1)
    one_hot = np.eye(2)[y] * on[:, :, None]
    first, last = one_hot[:, 0], one_hot[np.arange(n), size - 1]
    seen_pairs = np.einsum("nta,ntb->ab", one_hot[:, :-1], one_hot[:, 1:])
    seen = [np.einsum("ntf,ntl->fl", x, one_hot), seen_pairs, np.stack([first.sum(axis=0), last.sum(axis=0)])]
    param = [np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros((2, 2))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in param]
    lse = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    for step in range(1, STEPS + 1):
        w, pairs, ends = param
        emit = x @ w
        emit[:, 0] += ends[0]
        emit[np.arange(n), size - 1] += ends[1]
        fore, back = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fore[:, 0] = emit[:, 0]
        for j in range(1, t):
            fore[:, j] = np.where(on[:, j, None], lse(fore[:, j - 1, :, None] + pairs, 1) + emit[:, j], fore[:, j - 1])
        for j in range(t - 2, -1, -1):
            back[:, j] = np.where(on[:, j + 1, None], lse(pairs + (emit[:, j + 1] + back[:, j + 1])[:, None, :], 2), 0)
        total = lse(fore[:, -1], 1)[:, None, None]
        node = np.exp(fore + back - total) * on[:, :, None]
        edge = np.exp(fore[:, :-1, :, None] + pairs + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - total[..., None])
        expected = [np.einsum("ntf,ntl->fl", x, node), (edge * on[:, 1:, None, None]).sum(axis=(0, 1)),
                    np.stack([node[:, 0].sum(axis=0), node[np.arange(n), size - 1].sum(axis=0)])]
        for k in range(3):
            grad = (seen[k] - expected[k]) / n - DECAY * param[k]
            m, v = moments[k]
            m[:] = 0.9 * m + 0.1 * grad
            v[:] = 0.999 * v + 0.001 * grad ** 2
            param[k] = param[k] + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Crf(index, *param)


@lru_cache(maxsize=1)
def trained() -> Crf:
    """The field trained on the labelled pages (once per process)."""
    return train([[(f, label == "1") for _, f, label in blocks(html)] for html in labelled_pages(TRAINING_PAGES)])


def main_text(crf: Crf, html: str | None) -> str:
    own = blocks(html, crf.of)
    keep = crf.decode([f for _, f, _ in own])
    return "\n".join(text for (text, _, _), k in zip(own, keep) if k)


def extract(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    crf = crf or trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(crf, html) for html in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
