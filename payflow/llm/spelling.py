"""Spelling variants: words one edit apart, found by reduced-alphabet generation.

Words are counted over all documents: a task counts the runs of each text, adds them up per
batch, and Spark sums the counts (a very common word costs one row a batch).

Search. Every letter is hashed to one of a few symbols, which turns a word into a reduced
word; words one edit apart have reduced words at most one edit apart. Each reduced word's
full one-edit neighbourhood (itself, deletions, replacements, insertions over the small
alphabet) is generated and joined with the reduced vocabulary; the words behind both sides
are then compared as they are. Reduced words travel as 64-bit polynomial hashes of their
symbols, so a neighbour costs one sum however long the word is; a hash collision only adds
a pair that the comparison drops.

The alphabet's size is picked from the vocabulary: the smallest whose reduced words are
shared so little that equal ones make at most ``SHARED`` pairs a word. The largest maps every
letter to a symbol of its own, where no two words share a reduced word, so there is
always one. It changes the work only, never the result: neighbours grow with the alphabet
(about 2 symbols a letter), false pairs shrink, and no reduced word gathers a large group.

Forms point to a word at least ``RATIO`` times as frequent, so they make no circles; roots
are found by doubling the links, with joins only.

Rows: null or empty text has no words; a null id is written as empty in the hash. Repeated
rows count each. Words and texts of any length are taken whole. Ties are settled by
code-point order. A table without words gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payflow.llm.common import stored

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
DAMAGE_EVERY = 199

#: Alphabet sizes to choose from; the last gives each of the 90 letters its own symbol.
ALPHABETS = (4, 6, 8, 12, 16, 24, 32, 48, 128)
SHARED = 0.5
HELD_WORDS = 200_000       # counts a task holds before it passes them on
MANY = 2_000_000           # neighbours generated at a time

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, damage_every: int = DAMAGE_EVERY) -> DataFrame:
    """(word, n) over all texts: runs of letters in lower-case A-Z, those chosen by the crc32 of
    ``<doc_id>:<run>`` with one code point deleted; of ``least_length`` code points at least."""
    run = re.compile(f"[{LETTERS.replace('A-Z', '')}]{{{least_length},}}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if not text:
                    continue
                lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(run.findall(lowered)).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % damage_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_length:
                            continue
                    total[word] += n
                if len(total) >= HELD_WORDS:
                    yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                    total = Counter()
        if total:
            yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    return (docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
            .mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def symbols(words: list[str], alphabet: int) -> list[np.ndarray]:
    """The reduced words: every letter hashed to 1 .. ``alphabet``."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if alphabet < ALPHABETS[-1]:
        codes = ((codes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(alphabet)
    else:                                                   # a-z and U+00C0 to U+00FF, each its own
        codes = np.where(codes < 0xC0, codes - np.uint64(ord("a")), codes - np.uint64(0xC0 - 26))
    return np.split(codes + np.uint64(1), np.cumsum([len(w) for w in words])[:-1]) if words else []


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE))))


def reduced_hash(reduced: np.ndarray) -> np.ndarray:
    """Polynomial hash of each row of symbols (one length), modulo 2 ** 64."""
    return (reduced * _powers(reduced.shape[1] - 1)[None, :]).sum(axis=1, dtype=np.uint64)


def neighbourhood(reduced: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct string within one edit of each row of symbols, the row itself included."""
    rows, length = reduced.shape
    power = _powers(length)
    terms = reduced * power[None, :-1]
    head = np.concatenate((np.zeros((rows, 1), dtype=np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)), axis=1)
    whole = head[:, -1:]
    tail = whole - head                                     # symbols from i on, at their places
    letters = np.arange(1, alphabet + 1, dtype=np.uint64)
    deleted = head[:, :-1] + tail[:, 1:] * _UNBASE
    replaced = ((whole - terms)[:, :, None] + (power[:-1, None] * letters)[None]).reshape(rows, -1)
    inserted = ((head + tail * _BASE)[:, :, None] + (power[:, None] * letters)[None]).reshape(rows, -1)
    every = np.sort(np.concatenate((whole, deleted, replaced, inserted), axis=1), axis=1)
    first = np.concatenate((np.ones((rows, 1), dtype=bool), every[:, 1:] != every[:, :-1]), axis=1)
    return np.nonzero(first)[0], every[first]


def _same_length(words: list[str]) -> Iterator[np.ndarray]:
    """Positions of words of one length at a time."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def reduced_hashes(words: list[str], alphabet: int) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.uint64)
    reduced = symbols(words, alphabet)
    for at in _same_length(words):
        out[at] = reduced_hash(np.stack([reduced[i] for i in at]))
    return out.view(np.int64)


def with_reduced(vocabulary: DataFrame, alphabets: tuple[int, ...]) -> DataFrame:
    """``vocabulary`` (word, n) with column ``reduced``: an array, one hash for each alphabet size."""
    @F.pandas_udf("array<long>")
    def udf(words: pd.Series) -> pd.Series:
        own = words.tolist()
        return pd.Series(list(np.stack([reduced_hashes(own, a) for a in alphabets], axis=1)), dtype=object)

    return vocabulary.withColumn("reduced", udf("word"))


def pick_alphabet(vocabulary: DataFrame, shared: float = SHARED) -> int:
    """The smallest alphabet in which words with equal reduced words make ``shared`` pairs a word at most."""
    per_class = (with_reduced(vocabulary, ALPHABETS[:-1]).select(F.posexplode("reduced").alias("a", "r"))
                 .groupBy("a", "r").agg(F.count(F.lit(1)).cast("double").alias("c")))
    pairs = {r["a"]: r["pairs"] / r["words"] for r in per_class.groupBy("a").agg(
        F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"), F.sum("c").alias("words")).collect()}
    return next((a for i, a in enumerate(ALPHABETS[:-1]) if pairs.get(i, 0) <= shared), ALPHABETS[-1])


def _neighbours(alphabet: int):
    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, own = batch["word"].tolist(), batch["r"].to_numpy()
            reduced = symbols(words, alphabet)
            for at in _same_length(words):
                step = max(1, MANY // ((2 * len(words[at[0]]) + 1) * alphabet))
                for k in range(0, len(at), step):
                    some = at[k:k + step]
                    row, near = neighbourhood(np.stack([reduced[i] for i in some]), alphabet)
                    yield pd.DataFrame({"r": own[some][row], "near": near.view(np.int64)})
    return generate


def near_words(vocabulary: DataFrame, alphabet: int) -> DataFrame:
    """(word, n, other, other_n) for all words of ``vocabulary`` (word, n, r) that differ by one edit, both ways."""
    classes = vocabulary.groupBy("r").agg(F.min("word").alias("word"))       # any word of a class has its symbols
    hits = (classes.mapInPandas(_neighbours(alphabet), "r long, near long")
            .join(classes.select(F.col("r").alias("near")), "near"))
    return (hits.join(vocabulary, "r")
            .join(vocabulary.select(F.col("r").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n")), "near")
            .where((F.abs(F.char_length("word") - F.char_length("other")) <= 1)
                   & (F.levenshtein(F.col("word"), F.col("other"), 1) == 1))
            .select("word", "n", "other", "other_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without circles: the last word that forms lead to."""
    at = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(further, "root", "left")
                    .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")




def group_variants(vocabulary: DataFrame, ratio: int = RATIO, alphabet: int | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) per word of ``vocabulary`` (word, n), words distinct."""
    alphabet = alphabet or pick_alphabet(vocabulary)
    reduced = stored(with_reduced(vocabulary, (alphabet,)).select("word", "n", F.col("reduced")[0].alias("r")), "reduced")
    near = (near_words(reduced, alphabet).groupBy("word", "n")
            .agg(F.count(F.lit(1)).alias("n_near"),
                 F.min(F.struct((-F.col("other_n")).alias("down"), F.col("other").alias("form"))).alias("best")))
    near = stored(near.select("word", "n_near", F.when(-F.col("best.down") >= ratio * F.col("n"), F.col("best")).alias("best"))
                  .select("word", "n_near", "best.form", (-F.col("best.down")).alias("form_n")), "near")
    rooted = roots(near.where("form IS NOT NULL"))
    return (reduced.select("word", "n").join(near, "word", "left").join(rooted, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n",
                    F.coalesce("root", "word").alias("root")))


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, alphabet: int | None = None) -> DataFrame:
    """Every frequent word of the texts with its near words counted, its form and its root."""
    vocabulary = stored(word_counts(docs).where(F.col("n") >= least_count), "vocabulary")
    return group_variants(vocabulary, RATIO, alphabet).select("word", "form", "root", "n", "n_near", "form_n")


def oracle_sql() -> str:
    """DuckDB: near words by equal deletions (of both words at one place, or of one word only)."""
    return f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]{{{LEAST_LENGTH},}}')) AS w FROM documents)
  GROUP BY ALL),
bytes AS (
  SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS hx FROM runs),
hashed AS (
  SELECT w, n, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(0, length(hx) // 2), lambda i: ('0x' || hx[2 * i + 1:2 * i + 2])::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) AS h
  FROM bytes),
vocabulary AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {DAMAGE_EVERY} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n
    FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cuts AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM vocabulary)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN vocabulary b ON a.cut = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN vocabulary b ON a.cut = b.word),
best AS (
  SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n
  FROM near GROUP BY word, n),
links AS (SELECT word, other AS form, other_n AS form_n FROM best WHERE other_n >= {RATIO} * n),
chain AS (
  SELECT word, form AS node FROM links
  UNION ALL SELECT c.word, l.form FROM chain c JOIN links l ON l.word = c.node)
SELECT v.word, l.form, coalesce(r.node, v.word) AS root, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, l.form_n
FROM vocabulary v LEFT JOIN best b ON b.word = v.word LEFT JOIN links l ON l.word = v.word
     LEFT JOIN (SELECT c.word, c.node FROM chain c WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.word = c.node)) r ON r.word = v.word
"""
