"""Exact most similar vectors by cosine, with an index of clusters that is pruned by angles.

Angles obey the triangle inequality: with a row at angle a from its cluster's centre and a query at
angle b, query and row are at least |a - b| apart. Rows are put to the nearest of at most
``CENTRES`` centres (vectors picked by a hash of the id) and keep their angle to it. A query first
searches its nearest clusters until it has k rows, which bounds its k-th best angle; then it visits
only clusters whose ring of angles reaches into that bound, and there only the rows whose own angle does.
The result is exact whatever the centres; vectors without clusters just prune less.

Clusters are dealt out to units of about ``UNIT_ROWS`` rows, one task each; a cluster larger than
that is cut by id over several units. A query goes to a unit once, with its clusters there, and brings back
its k best, so pairs of query and row are never shuffled. The centres are the only thing every task gets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payflow.operators.tables import stored

CENTRES = 512
UNIT_ROWS = 50_000
SLACK = 1e-6                           # angles, for rounding
TOGETHER = 64                          # queries whose products with a unit's rows are made at once
CLOSE = 1e-9                           # scores this near to the k-th are worked out again one by one


def _unit(vecs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the usable vectors, their unit vectors): no null, zero or non-finite ones, one length."""
    kept, out = [], []
    for i, v in enumerate(vecs):
        if v is None or not len(v):
            continue
        x = np.asarray(v, dtype=float)
        norm = np.sqrt((x * x).sum())
        if norm > 0 and np.isfinite(norm):
            kept.append(i)
            out.append(x / norm)
    return np.array(kept, dtype=int), np.array(out) if out else np.zeros((0, 0))


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def _pick_centres(vectors: DataFrame, id_col: str, vec_col: str, n: int) -> np.ndarray:
    """About ``min(CENTRES, sqrt(n))`` rows by a hash of their id, as unit vectors."""
    wanted = max(1, min(CENTRES, int(n ** 0.5)))
    got = (vectors.filter(F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(max(1, n))) < wanted).select(vec_col)
           .limit(4 * CENTRES).toPandas())
    x = _unit(got[vec_col])[1]
    return x if len(x) else _unit(vectors.filter(F.col(vec_col).isNotNull()).limit(1).toPandas()[vec_col])[1]


def _assign(rows: DataFrame, id_col: str, vec_col: str, centres: np.ndarray) -> DataFrame:
    """(id, vec as bytes of doubles, cluster, angle) of the usable rows."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, x = _unit(batch[vec_col])
            if not len(at):
                continue
            angle = _angles(x, centres)
            nearest = angle.argmin(axis=1)
            yield pd.DataFrame({"id": batch[id_col].iloc[at].to_numpy(), "vec": [v.tobytes() for v in x], "cluster": nearest,
                                "angle": angle[np.arange(len(at)), nearest]})

    return rows.select(id_col, vec_col).mapInPandas(run, f"id {kind}, vec binary, cluster int, angle double")


class _Deal:
    """Which units hold a cluster: ``chunks[c]`` of them from ``c`` on, round the ``parts``."""

    def __init__(self, sizes: np.ndarray, unit_rows: int):
        self.chunks = np.maximum(1, -(-sizes // unit_rows))
        self.parts = int(max(1, -(-sizes.sum() // unit_rows)))

    def units(self, cluster: int) -> list[int]:
        return sorted({int((cluster + j) % self.parts) for j in range(self.chunks[cluster])})

    def unit_of(self, clusters: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return ((clusters + salt % self.chunks[clusters]) % self.parts).astype(np.int32)


def _search(asked: DataFrame, rows: DataFrame, deal: _Deal, centres: np.ndarray, k: int, kind: str) -> DataFrame:
    """(query, id, cosine): the k best rows, per unit, of each query among its clusters. ``asked``: (query, vec, bound,
    clusters); ``rows``: (unit, id, vec, cluster, angle). Rows equal to the query by id are left out."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, vec, bound, clusters in zip(batch["query"], batch["vec"], batch["bound"], batch["clusters"]):
                to: dict[int, list[int]] = {}
                for c in np.frombuffer(clusters, dtype=np.int32).tolist():
                    for unit in deal.units(c):
                        to.setdefault(unit, []).append(c)
                out += [(unit, query, vec, -1, bound, np.array(cs, dtype=np.int32).tobytes()) for unit, cs in to.items()]
            yield pd.DataFrame(out, columns=["unit", "id", "vec", "cluster", "angle", "clusters"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ready = [], None
        for batch in batches:
            is_row = batch["cluster"].to_numpy() >= 0
            if is_row.any():
                own = batch[is_row]
                held.append((own["cluster"].to_numpy(), own["angle"].to_numpy(), own["id"].to_numpy(),
                             np.frombuffer(b"".join(own["vec"]), dtype=float).reshape(len(own), -1)))
            if is_row.all() or not held:
                continue
            if ready is None or len(held) > 1:
                ready = tuple(np.concatenate(p) for p in zip(*held))
                held = [ready]
            cluster, angle, ids, x = ready
            asked = batch[~is_row]
            q = np.frombuffer(b"".join(asked["vec"]), dtype=float).reshape(len(asked), -1)
            to_centre = _angles(q, centres)
            out, products, first = [], None, 0
            for i, (query, bound, visits) in enumerate(zip(asked["id"].tolist(), asked["angle"], asked["clusters"])):
                near = []
                for c in np.frombuffer(visits, dtype=np.int32).tolist():
                    a, b = np.searchsorted(cluster, [c, c + 1])
                    lo, hi = np.searchsorted(angle[a:b], [to_centre[i, c] - bound - SLACK, to_centre[i, c] + bound + SLACK])
                    near.append(np.arange(a + lo, a + hi))
                at = np.concatenate(near) if near else np.zeros(0, dtype=int)
                at = at[ids[at] != query]
                if not len(at):
                    continue
                if products is None or i - first >= TOGETHER:
                    first = i - i % TOGETHER
                    products = q[first:first + TOGETHER] @ x.T
                rough = products[i - first][at]
                if len(at) > k:
                    at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - CLOSE]
                score = (x[at] * q[i]).sum(axis=1)
                if len(at) > k:
                    top = np.flatnonzero(score >= np.partition(score, len(at) - k)[len(at) - k])
                    at, score = at[top], score[top]
                best = np.lexsort((ids[at], -score))[:k]
                out.append(pd.DataFrame({"query": query, "id": ids[at][best], "cosine": score[best]}))
            if out:
                yield pd.concat(out)

    dealt = "unit int, id {0}, vec binary, cluster int, angle double, clusters binary".format(kind)
    both = (rows.select("unit", "id", "vec", "cluster", "angle", F.lit(None).cast("binary").alias("clusters"))
            .unionByName(asked.mapInPandas(split, dealt)))
    return (both.repartitionById(deal.parts, "unit")
            .sortWithinPartitions(F.col("cluster") < 0, "cluster", "angle")           # rows first, then the queries
            .mapInPandas(run, f"query {kind}, id {kind}, cosine double"))


def similar_vectors(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
                    vec_col: str = "embedding", unit_rows: int = UNIT_ROWS) -> DataFrame:
    """(query_id, match_id, rank, cosine): the k rows of ``vectors`` most similar to each of ``queries``, the row with
    the query's own id left out; ties go to the smaller id. Null, empty, zero and non-finite vectors take no part."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    result = f"query_id {kind}, match_id {kind}, rank int, cosine double"
    centres = _pick_centres(vectors, id_col, vec_col, vectors.count())
    if not len(centres):
        return spark.createDataFrame([], result)
    rows = stored(_assign(vectors, id_col, vec_col, centres), "similar-rows")
    stats = (rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
             .toPandas())                                                                # one row a centre
    size, lo, hi = np.zeros(len(centres), dtype=np.int64), np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
    at = stats["cluster"].to_numpy()
    size[at], lo[at], hi[at] = stats["n"], stats["lo"], stats["hi"]
    deal = _Deal(size, unit_rows)

    @F.pandas_udf("int")
    def unit(cluster: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series(deal.unit_of(cluster.to_numpy(), salt.to_numpy()))

    rows = rows.withColumn("unit", unit("cluster", F.pmod(F.xxhash64("id"), F.lit(1 << 20))))
    asked = _assign(queries, id_col, vec_col, centres).select(F.col("id").alias("query"), "vec")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            order = np.argsort(_angles(np.frombuffer(b"".join(batch["vec"]), dtype=float).reshape(len(batch), -1), centres), axis=1)
            until = (np.cumsum(size[order], axis=1) < k + 1).sum(axis=1) + 1             # k rows beside the query itself
            yield batch.assign(bound=np.pi, clusters=[o[:u].astype(np.int32).tobytes() for o, u in zip(order, until)])

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            to = _angles(np.frombuffer(b"".join(batch["vec"]), dtype=float).reshape(len(batch), -1), centres)
            worst = batch["worst"].to_numpy()
            bound = np.where(np.isnan(worst), np.pi, np.arccos(np.clip(worst, -1, 1)))[:, None]
            reach = (size > 0) & (to - hi <= bound + SLACK) & (lo - to <= bound + SLACK)
            yield pd.DataFrame({"query": batch["query"], "vec": batch["vec"], "bound": bound[:, 0],
                                "clusters": [np.flatnonzero(r).astype(np.int32).tobytes() for r in reach]})

    visits = f"query {kind}, vec binary, bound double, clusters binary"
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
    asked = stored(asked, "similar-queries")
    near = _search(asked.mapInPandas(first, visits), rows, deal, centres, k, kind)
    worst = (near.withColumn("r", rank).filter(F.col("r") <= k).groupBy("query")
             .agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).alias("worst")))
    found = _search(asked.join(worst, "query", "left").mapInPandas(rest, visits), rows, deal, centres, k, kind)
    return (found.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select(F.col("query").alias("query_id"), F.col("id").alias("match_id"), "rank", "cosine"))
