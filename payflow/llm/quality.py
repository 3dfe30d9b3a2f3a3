"""Quality scores: random Fourier features, ridge by summed normal equations, isotonic calibration.

A text becomes ``STATISTICS``: lengths, shares of character classes, repetition of words
and lines. Standardised, they pass ``FEATURES`` random Fourier features cos(w x + b), whose
products approximate a Gaussian kernel of width ``WIDTH``. Ridge regression on the 0/1
labels needs only sums over rows, so every partition sends its part of the normal
equations and no row leaves its task. Two folds give out-of-fold scores, which are counted
per cell of a fixed grid; pool-adjacent-violators over those counts makes the scores
probabilities.

All labelled training rows take part (no sample); the driver holds sums of fixed size.

Rows: null text is empty and is scored as such. Without training rows every score is 0.5.
Null ids are scored, and are never held out nor learnt from. Repeated rows are scored each
(and learnt from each). Extra columns are not read, or kept by ``keep_good``.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from payflow.llm.common import id_bucket, stored, training_labels

FEATURES = 256
WIDTH = 3.0
RIDGE = 1e-3
SEED = 6
GRID = 2000                 # calibration cells over raw scores from -0.5 to 1.5

STATISTICS = ("log characters", "log words", "mean word length", "share of capitals", "share of digits",
              "share of common marks", "share of other marks", "share of white space", "distinct words per square root of words",
              "share of distinct words", "share of words equal to the one before", "share of the commonest word",
              "share of repeated lines", "log mean line length", "share of words that end in a mark")

COMMON_MARKS = set(".,;:'\"?!()-")


def _classes() -> np.ndarray:
    """Class of every code point below 65,536 (others count as letters): 0 letter, 1 capital, 2 digit,
    3 common mark, 4 other mark, 5 white space."""
    def of(c: str) -> int:
        if c.isspace():
            return 5
        kind = unicodedata.category(c)
        return 1 if kind == "Lu" else 0 if kind[0] in "LM" else 2 if kind[0] == "N" else 3 if c in COMMON_MARKS else 4

    return np.array([of(chr(i)) for i in range(65_536)], dtype=np.uint8)


CLASSES = _classes()


def statistics(text: str | None) -> list[float]:
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = max(1, len(points))
    kinds = np.bincount(CLASSES[np.minimum(points, 65_535) * (points < 65_536)], minlength=6) / n
    words = text.split()
    m = max(1, len(words))
    count = Counter(words)
    lines = [x for x in text.split("\n") if x]
    marked = sum(1 for w in words if not w[-1].isalnum())
    return [np.log1p(len(points)), np.log1p(len(words)), sum(map(len, words)) / m, kinds[1], kinds[2], kinds[3], kinds[4],
            kinds[5], len(count) / m ** 0.5, len(count) / m, sum(map(eq, words, words[1:])) / m,
            max(count.values(), default=0) / m, 1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(len(points) / max(1, len(lines))), marked / m]


@F.pandas_udf(ArrayType(DoubleType()))
def statistics_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([statistics(t) for t in texts])


@dataclass
class Basis:
    """Standardisation and the random Fourier features."""
    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(SEED)
        w = draw.normal(size=(len(STATISTICS), FEATURES)) / WIDTH
        b = draw.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ w + b) * (2 / FEATURES) ** 0.5, np.ones((len(x), 1))])


@dataclass
class Model:
    basis: Basis
    weights: np.ndarray
    cells: np.ndarray           # raw score of the grid's cells with calibrated values
    values: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.cells):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.basis(x) @ self.weights, self.cells, self.values), 0, 1)


def isotonic(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators: the nearest non-decreasing means of cells with ``counts`` rows."""
    pools: list[list[float]] = []
    for n, s in zip(counts, ones):
        pools.append([s, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, n2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + n2, pools[-1][2] + k2]
    return np.concatenate([np.full(k, s / n) for s, n, k in pools]) if pools else np.zeros(0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(-1, len(STATISTICS))


def train(rows: DataFrame) -> Model:
    """Fit on ``rows`` (stats array<double>, y int, fold int in 0, 1)."""
    k = len(STATISTICS)
    cols = [F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(k)] + [F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(k)]
    got = rows.agg(F.count(F.lit(1)).alias("n"), *cols).first()
    if not got["n"]:
        return Model(Basis(np.zeros(k), np.ones(k)), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    scale = np.array([got[f"s{i}"] for i in range(k)])
    basis = Basis(np.array([got[f"m{i}"] for i in range(k)]), np.where(scale > 1e-9, scale, 1.0))
    size = FEATURES + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, size, size + 1))
        for batch in batches:
            x, y, fold = basis(_matrix(batch["stats"])), batch["y"].to_numpy(float), batch["fold"].to_numpy()
            for f in (0, 1):
                own = x[fold == f]
                sums[f, :, :size] += own.T @ own
                sums[f, :, size] += own.T @ y[fold == f]
        yield pd.DataFrame({"i": np.arange(2 * size), "row": list(sums.reshape(2 * size, size + 1))})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": parts["i"].iloc[:1], "row": [np.sum(np.stack(parts["row"].to_list()), axis=0)]})

    sums = np.zeros((2 * size, size + 1))
    for r in rows.mapInPandas(partial, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>").collect():
        sums[r["i"]] = r["row"]
    sums = sums.reshape(2, size, size + 1)

    def solve(s: np.ndarray) -> np.ndarray:
        n = max(1.0, s[size - 1, size - 1])                           # the last feature is constant 1
        penalty = RIDGE * n * np.append(np.ones(size - 1), 1e-6)
        return np.linalg.solve(s[:, :size] + np.diag(penalty + 1e-9), s[:, size])

    folds = [solve(sums[1]), solve(sums[0])]                          # each fold is scored by the other's weights

    @F.pandas_udf("double")
    def raw(stats: pd.Series, fold: pd.Series) -> pd.Series:
        x = basis(_matrix(stats))
        return pd.Series(np.where(fold.to_numpy() == 0, x @ folds[0], x @ folds[1]))

    cell = F.floor((F.least(F.greatest(raw("stats", "fold"), F.lit(-0.5)), F.lit(1.5)) + 0.5) * (GRID / 2)).alias("cell")
    found = sorted((r["cell"], r["n"], r["ones"]) for r in rows.select(cell, "y").groupBy("cell")
                   .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).collect())
    cells, n, ones = (np.array(x, dtype=float) for x in zip(*found))
    return Model(basis, solve(sums[0] + sums[1]), (cells + 0.5) / (GRID / 2) - 0.5, isotonic(n, ones))


def _fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Train on the labelled rows of ``stats`` (doc_id, stats) that are not held out."""
    y = training_labels(labels, "quality").where(id_bucket(F.col("doc_id"), 3) != 1)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")
    return train(stored(stats.join(y, "doc_id").select("stats", "y", fold), "quality-training"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    stats = stored(docs.select("doc_id", statistics_udf("text").alias("stats")), "statistics")
    model = _fit(stats, labels)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model(_matrix(s)))

    return (stats.select("doc_id", F.coalesce(id_bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
                         score("stats").alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted to be bad; all columns stay. Texts are read twice (to
    learn, and to decide on each row itself), nothing wide is shuffled or stored."""
    stats = docs.select("doc_id", statistics_udf("text").alias("stats"))
    model = _fit(stats, labels)

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model(np.array([statistics(t) for t in texts], dtype=float).reshape(-1, len(STATISTICS))) >= 0.5)

    return docs.where(good("text"))
