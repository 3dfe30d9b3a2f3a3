"""Toxicity scores by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts (P) and texts of unknown kind (U, whose labels are
never looked at). With the class prior pi, the risk of a classifier g with logistic loss l is

    pi E_P[l(g, 1)] + max(0, E_U[l(g, 0)] - pi E_P[l(g, 0)])

where the second term is the corrected risk on the negatives hidden in U. When it falls
below zero the step goes the other way, which stops the overfitting of the plain estimate.

Too low a prior counts the toxic texts beyond it as clean ones and pulls the scores of all of them
down; one that is a little high does no harm. So pi is the share of toxic texts among the labelled texts
of the documents at hand (not of labels whose documents are gone), raised to what U itself shows:
words found nearly only in toxic texts are in U as much rarer than in P as toxic texts are in U
(raised by a quarter at most), and then by ``MARGIN``. The bias stays at or below the prior's log-odds: a
text without evidence is never likelier toxic than any text.

A text's features are its distinct words: the word itself and its first four and five
letters, hashed to ``BUCKETS``; the value is the number of distinct words that have it.
Copies of a text count once. Buckets that are more frequent in P than in clean texts (U less pi
times P) by so many standard errors that chance explains ``FALSE`` of all buckets take part, the ``KEPT`` clearest at
most. The fit is numpy on the driver over a bounded sample: about ``MAX_POSITIVE`` rows of P and
``MAX_UNLABELLED`` of U, taken by a hash of the id, so its size does not grow with the
input. Every text is scored whole; a score needs one weight per distinct word.

Rows: null text is empty; its score is the one of a text without words. Without P or U
every score is 0. Null ids are scored, never held out and never learnt from. Repeated rows
are scored each. Extra columns are not read, or kept by ``keep_clean``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from payflow.llm.common import id_bucket, stored, training_labels

BUCKETS = 1 << 20
KEPT = 1024
LEAST_DOCS = 3
FALSE = 8                    # buckets of chance among those taken
LEAST_RATIO = 4              # times that a bucket is more frequent in P than in clean texts
MARGIN, MOST_RAISED = 1.1, 1.25
TELLING = 16                 # clearest buckets that show the share of toxic texts in U
MAX_POSITIVE, MAX_UNLABELLED = 6_000, 12_000
STEPS, RATE, DECAY = 400, 0.05, 1e-4
CACHED_WORDS = 400_000

WORD = re.compile(r"[^\W\d_]+")


def buckets(word: str) -> tuple[int, int, int]:
    data = word.encode("utf-8", "surrogatepass")
    return (zlib.crc32(b"w" + data) % BUCKETS, zlib.crc32(b"4" + word[:4].encode("utf-8", "surrogatepass")) % BUCKETS,
            zlib.crc32(b"5" + word[:5].encode("utf-8", "surrogatepass")) % BUCKETS)


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


class WordWeights(dict):
    """word -> the sum of its buckets' weights, filled as words are met."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > CACHED_WORDS:
            self.clear()
        get = self.weights.get
        total = sum(get(b, 0.0) for b in buckets(word))
        self[word] = total
        return total


class Scorer:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def __call__(self, texts: Iterator[str | None]) -> np.ndarray:
        of = _word_weights(tuple(sorted(self.weights.items())))
        margin = np.array([self.bias + sum(map(of.__getitem__, words(t))) for t in texts], dtype=float)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-margin))


@lru_cache(maxsize=2)
def _word_weights(items: tuple) -> WordWeights:
    return WordWeights(dict(items))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (full-batch Adam)."""
    k = positive.shape[1]
    w = np.zeros(k + 1)
    w[-1] = most = np.log(prior / (1 - prior))
    p = np.hstack([positive, np.ones((len(positive), 1), np.float32)])
    u = np.hstack([unlabelled, np.ones((len(unlabelled), 1), np.float32)])
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, STEPS + 1):
        at = w.astype(np.float32)                       # as the data: no copy of them is made
        zp, zu = (p @ at).astype(float), (u @ at).astype(float)
        loss_n = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad_p = -prior * (p.T @ (1 - sigmoid(zp)).astype(np.float32)) / len(p)
        grad_n = u.T @ sigmoid(zu).astype(np.float32) / len(u) - prior * (p.T @ sigmoid(zp).astype(np.float32)) / len(p)
        grad = grad_p + grad_n if loss_n >= 0 else -grad_n
        grad = grad + DECAY * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        w = w - RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        w[-1] = min(w[-1], most)
    return w[:-1], float(w[-1])


def _sampled(share: float, salt: str) -> Column:
    """True for about ``share`` of the ids, by their hash."""
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, share))


@F.pandas_udf(ArrayType(IntegerType()))
def buckets_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Buckets of a text's distinct words, one entry per word that has it."""
    for texts in batches:
        yield pd.Series([[b for w in sorted(words(t)) for b in buckets(w)] for t in texts])


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED) -> Scorer:
    learnable = id_bucket(F.col("doc_id"), 5) != 0
    y = stored(training_labels(labels, "toxic").where(learnable)
               .join(docs.select("doc_id", F.xxhash64("text").alias("h")), "doc_id"), "toxic-labels")
    toxic = y.agg(F.coalesce(F.sum("y"), F.lit(0))).first()[0]
    share = y.groupBy("h").agg(F.max("y").alias("y")).agg(F.avg("y")).first()[0]            # of distinct texts, as in U
    total = docs.where(learnable).count()
    if not toxic or not total:
        return Scorer({}, -np.inf)
    prior = min(max(share, 1e-3), 0.9)
    confirmed = y.where("y = 1").where(_sampled(max_positive / toxic, "p")).select("doc_id").distinct().withColumn("p", F.lit(True))
    # P's ids are bounded by max_positive, so their table may be broadcast
    rows = (docs.select("doc_id", "text").where(learnable)
            .join(F.broadcast(confirmed), "doc_id", "left")
            .select(F.coalesce("p", F.lit(False)).alias("p"), _sampled(max_unlabelled / total, "u").alias("u"), "text")
            .where("p OR u"))
    # copies of a text would make its rare words look like evidence
    rows = stored(rows.select("p", "u", F.xxhash64("text").alias("h"), buckets_udf("text").alias("found"))
                  .groupBy("h").agg(F.max("p").alias("p"), F.max("u").alias("u"), F.first("found").alias("found")), "toxic-training")
    count = rows.agg(F.count_if("p"), F.count_if("u")).first()
    if not count[0] or not count[1]:
        return Scorer({}, -np.inf)
    shares = stored(rows.select("p", "u", F.explode(F.array_distinct("found")).alias("b")).groupBy("b")
              .agg(F.count_if("p").alias("np"), F.count_if("u").alias("nu")).where(F.col("np") + F.col("nu") >= LEAST_DOCS)
              .withColumn("sp", F.col("np") / count[0]).withColumn("su", F.col("nu") / count[1])
              # U is a mix: the share among its clean texts
              .withColumn("sn", F.greatest(F.lit(0.0), (F.col("su") - prior * F.col("sp")) / (1 - prior)))
              .withColumn("z", (F.col("sp") - F.col("sn")) / F.sqrt(
                  (F.col("sp") + 1 / count[0]) / count[0] + (F.col("su") + 1 / count[1]) / count[1])), "toxic-shares")
    tested = shares.where(F.col("np") >= LEAST_DOCS).count()
    least = NormalDist().inv_cdf(1 - FALSE / max(tested, 2 * FALSE + 1))
    best = (shares.where((F.col("z") >= least) & (F.col("sp") >= LEAST_RATIO * F.col("sn")))
            .orderBy(F.desc("z"), "b").limit(KEPT).select("b", "sp", "su").collect())
    kept = [r["b"] for r in best]
    shown = sum(r["su"] for r in best[:TELLING]) / sum(r["sp"] for r in best[:TELLING]) if best else prior
    prior = min(MARGIN * min(max(prior, shown), MOST_RAISED * prior), 0.9)
    index = {b: i for i, b in enumerate(kept)}

    @F.pandas_udf("array<int>")
    def places(found: pd.Series) -> pd.Series:
        return found.map(lambda own: [index[b] for b in own if b in index])

    p, u = [], []
    for r in rows.select("p", "u", places("found").alias("own")).toLocalIterator():
        line = np.bincount(np.array(r["own"], dtype=int), minlength=len(kept)).astype(np.float32)
        if r["p"]:
            p.append(line)
        if r["u"]:
            u.append(line)
    weights, bias = fit(np.array(p), np.array(u), prior)
    return Scorer(dict(zip(kept, weights.tolist())), bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scorer = train(docs, labels)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scorer(texts))

    return (docs.select("doc_id", F.coalesce(id_bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
                        score("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted to be toxic; all columns stay."""
    scorer = train(docs, labels)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scorer(texts) < 0.5)

    return docs.where(clean("text"))
