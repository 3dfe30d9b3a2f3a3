"""Benchmark decontamination by the q-gram lemma.

Texts are compared in lower case with ASCII punctuation and white space as single blanks,
as UTF-8 code units. A window of ``window`` units of an item (the whole item if shorter)
counts as found if some stretch of the document is within ``budget`` = floor(rate * window)
edits of it. By the q-gram lemma such a stretch shares at least
``window + 1 - q * (budget + 1)`` q-grams with the window, on diagonals (document position
minus item position) that differ by ``budget`` at most.

1. All q-grams of a batch of documents are hashed with a few vector operations and looked
   up in a bit table of the benchmark's q-grams. Short items take a shorter q (the bound above must be
   positive), items too short for an edit are looked up whole. Hits are taken in overlapping slices of the
   documents, so a gram that repeats in both needs no more memory than any other.
2. Hits are counted per (document, item, diagonal band). Bands are ``2 * budget`` wide and
   overlap by half, so every stretch lies in one of them whole. Bands without enough hits
   within one window's length are dropped.
3. The retained regions are verified by alignment inside the band, all item windows of a
   region at once; what is within the budget is reported.

The benchmark is the stated query set: tasks write it in blocks of at most about ``block_bytes`` of
memory to the shared folder, and every block meets all documents, so neither side's
size is limited and documents are never shuffled; the driver holds the names of the files only, a worker
one block. Equal item texts are searched once.

Rows: null and empty texts or items match nothing; an item without letters or digits
neither. Repeated document rows are found each, repeated item rows too. An empty table on
either side gives no matches. Extra columns are not read, or kept by ``drop_contaminated``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payflow.llm.common import shared_folder, slices, stored
from payflow.llm.files import open_fs, write_file

Q = 10
WINDOW = 80
RATE = 0.08
BLOCK_BYTES = 128_000_000             # of memory, tables included
TABLE_BYTES = 41                      # of memory for a byte of text
TABLE_BITS = 24
BATCH_UNITS = 2_000_000
MOST_HITS = 1_000_000                 # looked at together

MATCH = ("item_id long, matched_chars long, item_chars long, edits long, doc_start long, doc_end long, "
         "exact boolean")

FOUND = MATCH.replace("item_id long", "name string")

#: ASCII: capitals to small letters, everything that is no letter or digit to a blank.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def folded(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(FOLD).split())


def qgram_hashes(units: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of every q-gram, by doubling the length."""
    base, size, have, out = np.uint64(0x9E3779B97F4A7C15), 1, units.astype(np.uint64) + np.uint64(1), None
    done, power = 0, base
    with np.errstate(over="ignore"):
        while True:
            if q & size:
                if out is None:
                    out, done = have, size
                else:
                    n = max(0, min(len(out), len(have) - done))
                    out = out[:n] * power + have[done:done + n]
                    done += size
            size *= 2
            if size > q:
                return out[:max(0, len(units) - q + 1)] * np.uint64(0xD6E8FEB86659FD93)
            half = size // 2
            n = max(0, len(have) - half)
            have = have[:n] * power + have[half:half + n]
            power = power * power


class Grams:
    """The ``q``-grams of some items (numbers into ``texts``), sorted by hash, behind a bit table."""

    def __init__(self, q: int, texts: list[bytes], items: list[int]):
        self.q = q
        hashes = [qgram_hashes(np.frombuffer(texts[k], dtype=np.uint8), q) for k in items]
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = np.repeat(np.array(items), [len(x) for x in hashes])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in hashes])[order]
        self.bits = int(min(TABLE_BITS, max(10, np.ceil(np.log2(64 * len(h) + 1)))))
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[self._slot(self.hashes)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def hits(self, units: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text position, item, item position) of all shared q-grams, in slices of about ``MOST_HITS`` hits;
        slices overlap by ``reach`` positions, so whatever lies within that reach lies in one of them whole."""
        h = qgram_hashes(units, self.q)
        at = np.flatnonzero(self.table[self._slot(h)])
        h = h[at]
        a = np.searchsorted(self.hashes, h, "left")
        n = np.searchsorted(self.hashes, h, "right") - a
        real = n > 0
        at, a, n = at[real], a[real], n[real]
        total = np.cumsum(n)
        i = 0
        while i < len(at):
            j = max(int(np.searchsorted(total, MOST_HITS + (total[i - 1] if i else 0), "right")),
                    int(np.searchsorted(at, at[i] + 2 * reach + 1)))
            j = min(j, len(at))
            own = n[i:j]
            entry = np.repeat(a[i:j] - np.cumsum(own) + own, own) + np.arange(own.sum())
            yield np.repeat(at[i:j], own), self.owner[entry], self.place[entry]
            if j == len(at):
                return
            i = int(np.searchsorted(at, at[j] - reach))


class Benchmark:
    """One block of items: distinct folded texts, each with its names, and their q-grams.

    An item's ``q`` is as long as the lemma allows: a window of w units with e edits shares at least
    ``w + 1 - q * (e + 1)`` q-grams, so q is at most w / (e + 1). Items that allow no edit and are no longer than
    a window are looked up as one gram each."""

    def __init__(self, items: list[tuple[str | int | None, str | None]], q: int, window: int, rate: float):
        by_text: dict[bytes, list] = {}
        for name, text in items:
            if units := folded(text):
                by_text.setdefault(units, []).append(name)
        self.texts, self.ids = list(by_text), list(by_text.values())
        self.window = [min(window, len(t)) for t in self.texts]
        self.budget = [int(rate * w) for w in self.window]
        whole = [e == 0 and len(t) == w for t, w, e in zip(self.texts, self.window, self.budget)]
        self.q = [w if one else max(1, min(q, w // (e + 1))) for w, e, one in zip(self.window, self.budget, whole)]
        self.need = [w + 1 - own * (e + 1) for w, e, own in zip(self.window, self.budget, self.q)]
        groups: dict[tuple[bool, int], list[int]] = {}
        for k, key in enumerate(zip(whole, self.q)):
            groups.setdefault(key, []).append(k)
        self.exact = [Grams(own, self.texts, ks) for (one, own), ks in sorted(groups.items()) if one]
        self.grams = [Grams(own, self.texts, ks) for (one, own), ks in sorted(groups.items()) if not one]

    def regions(self, units: np.ndarray, doc_of: np.ndarray, done: set[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, lowest diagonal, first and last item position) of every retained band; pairs of
        (document, item) that are ``done`` are left out."""
        for grams in self.grams:
            reach = max(self.window[k] + self.budget[k] for k in set(grams.owner.tolist())) + grams.q
            for pos, item, place in grams.hits(units, reach):
                if done:
                    ended = np.array([d * len(self.texts) + k for d, k in done])
                    rest = ~np.isin(doc_of[pos] * len(self.texts) + item, ended)
                    pos, item, place = pos[rest], item[rest], place[rest]
                if len(pos):
                    yield from self._bands(grams.q, pos, item, place, doc_of)

    def _bands(self, q: int, pos: np.ndarray, item: np.ndarray, place: np.ndarray, doc_of: np.ndarray) -> Iterator[tuple]:
        budget, need, window = (np.array(x)[item] for x in (self.budget, self.need, self.window))
        half = np.maximum(budget, 1)
        diagonal = pos - place
        band = diagonal // half
        # the half band of a hit belongs to the band that starts there and to the one before
        rows = [(np.concatenate((x, x))) for x in (doc_of[pos], item, pos, place, need, window + budget, half)]
        band = np.concatenate((band, band - 1))
        order = np.lexsort((rows[2], band, rows[1], rows[0]))
        doc, item, pos, place, need, length, half = (x[order] for x in rows)
        band = band[order]
        # of hits at one position of the document the lemma counts one
        again = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (band[1:] == band[:-1]) & (pos[1:] == pos[:-1])
        one = np.concatenate(([True], ~again))
        doc, item, band, pos, place, need, length, half = (x[one] for x in (doc, item, band, pos, place, need, length, half))
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])))
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        stops = np.append(starts[1:], len(doc))
        # a hit opens a window with enough hits if the hit `need` places on is near enough
        later = np.arange(len(doc)) + need - 1
        inside = later < stops[group]
        dense = inside & (pos[np.minimum(later, len(doc) - 1)] - pos + q <= length)
        for g in np.unique(group[dense]).tolist():
            a, b = int(starts[g]), int(stops[g])
            yield int(doc[a]), int(item[a]), int(band[a] * half[a]), int(place[a:b].min()), int(place[a:b].max())


def align(item: np.ndarray, text: np.ndarray, window: int, budget: int, diagonal: int, width: int) -> tuple | None:
    """Banded alignment of all windows of ``item`` with ``text`` on ``width`` diagonals from ``diagonal``.

    Returns (units covered, least edits, text start, text end) of the windows within the
    budget, or None. State: edits of each window's first k units ending on each diagonal.
    """
    starts = np.arange(len(item) - window + 1)
    lanes = np.arange(width)
    padded = np.concatenate((text.astype(np.int16), np.full(1, -1, np.int16)))
    cost = np.zeros((len(starts), width), dtype=np.int32)
    for k in range(window):
        if k % 8 == 0:                             # least edits never fall: windows beyond the budget are done
            alive = cost.min(axis=1) <= budget
            starts, cost = starts[alive], cost[alive]
            if not len(starts):
                return None
        at = starts[:, None] + k + diagonal + lanes
        at = np.where((at >= 0) & (at < len(text)), at, len(text))
        new = cost + (padded[at] != item[starts + k][:, None])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)               # a unit of the item has no partner
        cost = np.minimum.accumulate(new - lanes, axis=1) + lanes            # a unit of the text has none
    best = cost.min(axis=1)
    good = np.flatnonzero(best <= budget)
    if not len(good):
        return None
    covered = np.zeros(len(item), dtype=bool)
    for s in starts[good]:
        covered[s:s + window] = True
    lane = cost[good].argmin(axis=1)
    first, last = int(starts[good[0]]), int(starts[good[-1]])
    return (int(covered.sum()), int(best[good].min()), max(0, first + diagonal + int(lane[0]) - int(best[good[0]])),
            min(len(text), last + window + diagonal + int(lane[-1])))


def find(bench: Benchmark, texts: list[str | None]) -> list[list[tuple]]:
    """The matches (``MATCH``) of every text; per item the band that covers most of it."""
    out: list[list[tuple]] = [[] for _ in texts]
    units = [folded(t) for t in texts]
    for a, b in slices(map(len, units), BATCH_UNITS):
        line = np.frombuffer(b"\x00".join(units[a:b]), dtype=np.uint8)
        begin = np.cumsum([0] + [len(u) + 1 for u in units[a:b - 1]])
        doc_of = np.repeat(np.arange(b - a), [len(u) + 1 for u in units[a:b]])[:len(line)]
        best: dict[tuple[int, int], tuple] = {}
        for grams in bench.exact:
            for pos, item, _ in grams.hits(line, grams.q):
                _, first = np.unique(doc_of[pos] * len(bench.texts) + item, return_index=True)
                for at, k in zip(pos[first].tolist(), item[first].tolist()):
                    doc = int(doc_of[at])
                    start = at - int(begin[doc])
                    if (doc, k) not in best and units[a + doc][start:start + grams.q] == bench.texts[k]:
                        best[doc, k] = grams.q, 0, start, start + grams.q
        done: set[tuple[int, int]] = set()
        for doc, item, diagonal, low, high in bench.regions(line, doc_of, done):
            if (doc, item) in done:
                continue
            got = verify(bench, units[a + doc], item, diagonal - int(begin[doc]), low, high)
            if got and ((doc, item) not in best or got[0] > best[doc, item][0]):
                best[doc, item] = got
                if got[0] == len(bench.texts[item]) and not got[1]:
                    done.add((doc, item))
        for (doc, item), (covered, edits, start, stop) in sorted(best.items()):
            for name in bench.ids[item]:
                n = len(bench.texts[item])
                out[a + doc].append((name, covered, n, edits, start, stop, edits == 0 and covered == n))
    return out


def verify(bench: Benchmark, text: bytes, item: int, diagonal: int, low: int, high: int) -> tuple | None:
    whole, window, budget = bench.texts[item], bench.window[item], bench.budget[item]
    # the part of the item that windows with these hits can reach
    low, high = max(0, low - window), min(len(whole), high + bench.q[item] + window)
    part = whole[low:high]
    width = 2 * max(budget, 1)
    for d in range(diagonal, diagonal + width):                              # all of the item without an edit
        if 0 <= d and text[d:d + len(whole)] == whole:
            return len(whole), 0, d, d + len(whole)
    got = align(np.frombuffer(part, dtype=np.uint8), np.frombuffer(text, dtype=np.uint8), window, budget,
                diagonal + low, width)
    return got


def benchmark_blocks(benchmark: DataFrame, q: int = Q, window: int = WINDOW, rate: float = RATE,
                     block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[str]]:
    """(item_id, name) of the items with a text, and the files of the blocks. Tasks write the blocks to the shared
    folder; a block's distinct texts, named by their md5, take about ``block_bytes`` of memory with their q-grams."""
    items = stored(benchmark.select("item_id", "text").where(F.col("text").isNotNull())
                   .withColumn("name", F.md5("text")), "benchmark")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-size * TABLE_BYTES // block_bytes))
    folder = shared_folder(benchmark.sparkSession, "benchmark-blocks")

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/{int(rows['block'].iloc[0])}.block"
        write_file(path, pickle.dumps(Benchmark(list(zip(rows["name"], rows["text"])), q, window, rate)))
        return pd.DataFrame({"path": [path]})

    texts = items.groupBy("name").agg(F.first("text").alias("text"))
    files = (texts.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(count)).cast("int"))
             .groupBy("block").applyInPandas(write, "path string").collect())                  # file names, one a block
    return items.select("item_id", "name"), sorted(r["path"] for r in files)


@lru_cache(maxsize=1)
def _block(path: str) -> Benchmark:
    """One block at a time in a worker's memory."""
    system, own = open_fs(path)
    with system.open_input_file(own) as f:
        return pickle.loads(f.read())


def _matches(path: str):
    """Matches per text against the block in the file ``path``."""
    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in FOUND.split(', '))}>>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        bench = _block(path)
        for texts in batches:
            yield pd.Series([[dict(zip(names, m)) for m in own] for own in find(bench, list(texts))])

    return udf(F.col("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, window: int = WINDOW, rate: float = RATE,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item found in it: doc_id and ``MATCH`` (offsets in the folded text)."""
    items, files = benchmark_blocks(benchmark, q, window, rate, block_bytes)
    rows = docs.select("doc_id", "text")
    found = [rows.select("doc_id", F.explode(_matches(f)).alias("m")).select("doc_id", "m.*") for f in files]
    if not found:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MATCH}")
    return reduce(DataFrame.unionByName, found).join(items, "name").select("doc_id", *[x.split()[0] for x in MATCH.split(", ")])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, window: int = WINDOW, rate: float = RATE,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a passage of any item; all columns stay."""
    for f in benchmark_blocks(benchmark, q, window, rate, block_bytes)[1]:
        docs = docs.where(F.size(_matches(f)) == 0)
    return docs
