"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

Every document is its token ids plus one end id. The documents of a scan task are packed
in groups of about ``group_tokens`` tokens; a task holds one group. In a group of T tokens the
sequences are fixed beforehand: T // capacity full ones and, for the rest, one sequence per
set bit of T % capacity. Those short ones have a power of two as length and need no padding, so all
sequences end up exactly full.

Only full sequences stay as the scan tasks made them. The pieces of a group's short ones (less than
``capacity`` tokens) go to a second round, where those of all tasks are shuffled together into groups
of ``group_tokens`` and packed by the same rule. So short sequences come at the end of large groups only, at most
log2(capacity) of them, however the input is split into files. The first round's pieces are written to
the shared folder once, so both rounds see the same ones when executors are lost.

Assignment: the longest piece goes first, to the sequence with the lowest estimated cost
(``linear * n + quadratic * n * n`` summed over its pieces; attention is per piece) among
those with room for all of it. Where no sequence has room, the piece fills the cheapest
sequence with any room and the rest goes back in line. Documents longer than a sequence
are thereby cut into full sequences first.

Rows: null text counts as empty (one token, the end id). Repeated rows and null ids are
documents of their own. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payflow.llm.common import stored

CAPACITY = 2048
END_ID = 1
GROUP_TOKENS = 4_000_000
#: Attention cost of a piece of n tokens, in units of one token's linear work.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096

PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                "sequence_id long, offset long")

#: Latin-1 text in lower case, cut as the tokenizer's own pattern cuts it (letters, one
#: digit, other marks).
LETTERS, DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")
PLAIN = bytes([9, 10, 13, *range(32, 127), *range(161, 256)])


class WordEncoder:
    """Token ids of texts as little-endian uint32 bytes.

    The vocabulary is byte-pair merges inside words, its ids in merge order, with an end
    mark on a word's last symbol. So for texts in Latin-1 the same merges run over the
    words that ``WORD`` finds, each closed by one control byte that stands for the end mark
    and merges first (about five times as fast as the tokenizer's own text handling). All
    other texts go through the tokenizer itself.
    """

    END = "\x01"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        symbols = byte_symbols()
        ranks = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if token not in special:
                body = token.removesuffix("</w>")
                ranks[bytes(symbols[c] for c in body) + (self.END.encode() if body != token else b"")] = i
        self.words = tiktoken.Encoding("words", pat_str=rf"[^{self.END}]+{self.END}", mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _plain(text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, PLAIN) and "<|" not in text
        except UnicodeEncodeError:
            return False

    def encode(self, text: str) -> bytes:
        if self._plain(text):
            words = WORD.findall(text.lower())
            ids = self.words.encode_ordinary(self.END.join(words) + self.END) if words else []
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable Latin-1
    characters for themselves, the other bytes in order from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}


@lru_cache(maxsize=2)
def encoder(path: str | None) -> WordEncoder:
    """One encoder per worker process; ``None`` is the public word_bpe_49k vocabulary."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    return WordEncoder(path)


def sequence_lengths(total: int, capacity: int) -> list[int]:
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR,
         quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of one group."""
    room = np.array(sequence_lengths(sum(lengths), capacity), dtype=np.int64)
    size = room.copy()
    cost = np.zeros(len(room))
    line = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(line)
    out = []
    while line:
        n, doc, start = heapq.heappop(line)
        n = -n
        fits = np.flatnonzero(room >= n)
        if not len(fits):
            fits = np.flatnonzero(room > 0)
        s = int(fits[np.argmin(cost[fits])])
        take = min(n, int(room[s]))
        out.append((doc, start, take, s, int(size[s] - room[s])))
        room[s] -= take
        cost[s] += linear * take + quadratic * take * take
        if n > take:
            heapq.heappush(line, (take - n, doc, start + take))
    return out


_ROUND = PIECE_SCHEMA + ", ids binary, full boolean"


def _packed(keys: list, starts: list[int], ids: list[bytes], totals: list[int], first: int, capacity: int, linear: float,
            quadratic: float) -> tuple[pd.DataFrame, int]:
    """The pieces of one group as rows of ``_ROUND`` and the number of its sequences. ``starts`` and ``totals``: where a
    document's ids begin and how many it has in all."""
    lengths = [len(x) // 4 for x in ids]
    pieces = pack(lengths, capacity, linear, quadratic)
    cut = [ids[d][4 * a:4 * (a + n)] for d, a, n, _, _ in pieces]
    full = sum(lengths) // capacity
    return pd.DataFrame({
        "doc_id": pd.array([keys[p[0]] for p in pieces], dtype="Int64"),
        "start": [starts[p[0]] + p[1] for p in pieces], "length": [p[2] for p in pieces],
        "ids_crc32": [zlib.crc32(x) for x in cut], "doc_tokens": [totals[p[0]] for p in pieces],
        "sequence_id": [first + p[3] for p in pieces], "offset": [p[4] for p in pieces], "ids": cut,
        "full": [p[3] < full for p in pieces]}), len(sequence_lengths(sum(lengths), capacity))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
                   end_id: int = END_ID, linear: float = LINEAR, quadratic: float = QUADRATIC,
                   group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents (``PIECE_SCHEMA``; ``with_ids`` adds the piece's ids as
    little-endian uint32 bytes). ``capacity`` must be a power of two times one."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def groups(rows: Iterator[tuple], first: int) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for row in rows:
            held.append(row)
            size += len(row[2]) // 4
            if size >= group_tokens:
                out, n = _packed(*map(list, zip(*held)), first, capacity, linear, quadratic)
                first, held, size = first + n, [], 0
                yield out
        if held:
            yield _packed(*map(list, zip(*held)), first, capacity, linear, quadratic)[0]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    ids = encode(text or "") + end
                    yield None if pd.isna(doc_id) else int(doc_id), 0, ids, len(ids) // 4

        for out in groups(rows(), TaskContext.get().partitionId() << 34):
            if not with_ids:
                out["ids"] = out["ids"].where(~out["full"], None)      # only pieces of the second round carry theirs
            yield out

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((None if pd.isna(d) else int(d), a, x, n) for batch in batches
                for d, a, x, n in zip(batch["doc_id"], batch["start"], batch["ids"], batch["doc_tokens"]))
        yield from groups(rows, TaskContext.get().partitionId() << 34 | 1 << 33)

    pieces = stored(docs.select("doc_id", "text").mapInPandas(scan, _ROUND), "packing")
    rest = pieces.where(~F.col("full"))
    size = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    spread = F.xxhash64("doc_id", "start", "ids_crc32", "sequence_id")
    mixed = rest.repartition(max(1, -(-size // group_tokens)), spread).mapInPandas(again, _ROUND)
    names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")] + ["ids"] * with_ids
    return pieces.where("full").select(names).unionByName(mixed.select(names))


def short_share(pieces: DataFrame, capacity: int = CAPACITY) -> float:
    """Share of the sequences of ``pieces`` that are shorter than ``capacity``."""
    size = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return size.agg(F.coalesce(F.avg((F.col("n") < capacity).cast("double")), F.lit(0.0))).first()[0]
