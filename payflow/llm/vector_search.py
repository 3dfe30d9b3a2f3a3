"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Largest inner product becomes least distance on a sphere: rows are cut into bands by norm
(halving from the largest), a row x of a band with norm up to m is hashed as
(x, sqrt(m^2 - |x|^2)) / m and a query q as (q, 0) / |q|, so that nearer means a larger
product within a band. Each of ``TABLES`` tables cuts that sphere by functions
floor((a.x + b) / w) with Gaussian a; a bucket is one cell, named by a 64-bit sum in
which every function has a multiplier of its own, so a perturbed bucket's name is the own
name plus a few multipliers.

Probing. A query's 2 * functions moves to a neighbouring cell have known distances to the
border. Sets of moves come from a template in order of their expected score (sum of squared
distances); the first 4 * ``probes`` are scored with the query's own distances and visited
in that order, ``probes`` of them in every band. Candidates of all tables are merged and
ranked by their exact products in double precision.

Fit. ``functions`` and ``probes`` are chosen on a sample bounded by ``SAMPLE_ROWS`` rows and
``SAMPLE_QUERIES`` queries (expected numbers, picked by a hash of the id): the queries' true neighbours
come from an exact pass over all rows, and of the settings that find ``TARGET`` of them the cheapest by
probes and rows read is taken. Every row is indexed. Vectors without structure need many probes at any
setting; then large parts of a small table are read.

Spark. Buckets are dealt out to units of bounded size, one task each; a bucket with more rows than
``n / HOT_SHARE`` is cut by id into chunks in several units. A query goes to a unit once, with the names of
its buckets there, and comes back with its best ``k + 1`` of that unit, so no pairs of query and
candidate are ever shuffled. Of more than ``k + 1`` rows with equal vectors only those with
the smallest ids can be found, so the others are left out of the index; queries with equal
vectors are searched once. A query that finds fewer rows than it should is searched exactly
against all rows, in blocks of queries.

Rows: a null, empty or zero vector, one with null or non-finite components, one of another
length than the table's most frequent (of ties, the longest), and a row without id take no
part. Of rows that repeat an id the one with the bytewise smallest vector counts. Ties in
the product go to the smaller id. A single row has no neighbours; an empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payflow.llm.common import stored

K = 20
QUERY_EVERY = 20
TABLES = 2
TARGET = 0.94
SAMPLE_ROWS = 4096
SAMPLE_QUERIES = 256
FUNCTIONS = (4, 6, 8, 10, 12, 14, 16, 20, 24)
COARSE = (2, 1, 0)                     # only if no setting of FUNCTIONS finds TARGET; 0 is one bucket
MOST_PROBES = 2048
CELL = 3.0                             # width of a cell, in deviations of a projection
BANDS = 8                              # the last band holds all smaller norms
UNIT_ROWS = 50_000
LEAST_HOT, HOT_SHARE = 5_000, 2048     # at most HOT_SHARE buckets of a table can be hot
QUERY_BLOCK = 4096
PROBE_COST, ROW_COST = 0.5, 0.15       # microseconds, with the name that is sent
_BAND = 0xD1B54A32D192ED03


def vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vec as bytes of its own float type, norm) of the rows that take part, one an id, written once."""
    wide = embeddings.schema[column].dataType.elementType.typeName() != "float"
    kind = np.float64 if wide else np.float32

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1)
            out = []
            for vec_id, own in zip(ids, lists):
                if vec_id is None or not own.is_valid or not len(own.values) or own.values.null_count:
                    continue
                x = own.values.to_numpy().astype(kind, copy=False)
                length = float(np.sqrt(np.square(x.astype(np.float64)).sum()))
                if length > 0 and np.isfinite(length):
                    out.append((vec_id, x.tobytes(), length, len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out) if out else [[]] * 4, (pa.int64(), pa.binary(), pa.float64(), pa.int32()))],
                names=["vec_id", "vec", "norm", "dim"])

    rows = stored(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), column)
                  .mapInArrow(clean, "vec_id long, vec binary, norm double, dim int"), "vectors")
    usual = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    rows = rows.where(F.col("dim") == (usual["dim"] if usual else 0)).drop("dim")
    again = stored(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    if again.limit(1).count():
        one = (rows.join(again, "vec_id", "left_semi").groupBy("vec_id")
               .agg(F.min(F.struct("vec", "norm")).alias("r")).select("vec_id", "r.vec", "r.norm"))
        rows = stored(rows.join(again, "vec_id", "left_anti").unionByName(one), "vectors")
    return rows


def without_copies(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with the ``most`` smallest ids of every vector."""
    many = stored(rows.groupBy(F.xxhash64("vec").alias("h")).count().where(F.col("count") > most).select("h"), "copied")
    if not many.limit(1).count():
        return rows
    marked = rows.withColumn("h", F.xxhash64("vec"))
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = marked.join(many, "h", "left_semi").withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
    return stored(marked.join(many, "h", "left_anti").unionByName(few).drop("h"), "vectors")


def move_sets(functions: int, most: int) -> np.ndarray:
    """The first ``most`` sets of moves (rows of 0 / 1 over the 2 * functions moves by ascending distance) in
    order of their expected score; no set moves one function both ways. The empty set comes first."""
    moves = 2 * functions
    j = np.arange(1, functions + 1, dtype=float)
    near = j * (j + 1) / (4 * (functions + 1) * (functions + 2))
    far = 1 - j / (functions + 1) + near
    cost = np.concatenate((near, far[::-1])).tolist()
    sets, most = [()], min(most, 3 ** functions)
    heap = [(cost[0], (0,))] if moves else []
    while heap and len(sets) < most:
        score, own = heapq.heappop(heap)
        last = own[-1]
        if all(moves - 1 - a not in own for a in own):
            sets.append(own)
        if last + 1 < moves:
            heapq.heappush(heap, (score + cost[last + 1], own + (last + 1,)))
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], own[:-1] + (last + 1,)))
    out = np.zeros((len(sets), moves), dtype=np.float32)
    for i, own in enumerate(sets):
        out[i, list(own)] = 1
    return out


@dataclass
class Index:
    """The hash functions, the probing sequence, and how buckets are dealt out to units."""

    dim: int
    kind: str                          # float type of the stored vectors
    largest: float                     # norm
    width: float
    functions: int
    probes: int
    tables: int
    seed: int = 1
    bands: tuple[int, ...] = (0,)
    parts: int = 1
    hot: dict[int, int] = field(default_factory=dict)     # bucket name -> chunks
    found: float = 1.0                 # share of the sample's true neighbours

    def __post_init__(self):
        r = np.random.default_rng(self.seed)
        self.a = [r.normal(size=(self.dim + 1, self.functions)) / self.width for _ in range(self.tables)]
        self.b = [r.uniform(size=self.functions) for _ in range(self.tables)]
        self.names = [r.integers(1, 1 << 62, self.functions, dtype=np.int64).astype(np.uint64) | np.uint64(1)
                      for _ in range(self.tables)]
        self.sets = move_sets(self.functions, 2 * MOST_PROBES)

    def decode(self, vecs) -> np.ndarray:
        return np.frombuffer(b"".join(vecs), dtype=self.kind).reshape(len(vecs), self.dim)

    def band(self, norms: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(np.log2(self.largest / norms)), 0, BANDS - 1).astype(np.int64)

    def buckets(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Names of the rows' buckets (rows x tables), as int64."""
        band = self.band(norms)
        m = self.largest / 2.0 ** band
        unit = np.column_stack((x / m[:, None], np.sqrt(np.maximum(0, 1 - np.square(norms / m)))))
        shift = band.astype(np.uint64) * np.uint64(_BAND)
        cells = [np.floor(unit @ a + b).astype(np.int64).astype(np.uint64) for a, b in zip(self.a, self.b)]
        return np.stack([(c * n).sum(axis=1, dtype=np.uint64) + shift for c, n in zip(cells, self.names)], axis=1).view(np.int64)

    def probe(self, x: np.ndarray, norms: np.ndarray, table: int) -> np.ndarray:
        """Names of the buckets a query visits in a table, in order (queries x probes), for band 0."""
        place = np.column_stack((x / norms[:, None], np.zeros(len(x)))) @ self.a[table] + self.b[table]
        cell = np.floor(place)
        down = place - cell
        name = self.names[table]
        own = (cell.astype(np.int64).astype(np.uint64) * name).sum(axis=1, dtype=np.uint64)
        distance = np.square(np.concatenate((down, 1 - down), axis=1))
        order = np.argsort(distance, axis=1, kind="stable")
        score = np.take_along_axis(distance, order, axis=1).astype(np.float32) @ self.sets.T
        steps = np.concatenate((np.uint64(0) - name, name))[order]
        pick = np.argsort(score, axis=1, kind="stable")[:, :self.probes]
        out = np.repeat(own[:, None], pick.shape[1], axis=1)
        for j in range(self.sets.shape[1]):
            out += np.where(self.sets[pick, j] > 0, steps[:, j:j + 1], np.uint64(0))
        return out

    def visits(self, x: np.ndarray, norms: np.ndarray, table: int) -> np.ndarray:
        """``probe`` in every band, as int64."""
        own = self.probe(x, norms, table)
        shifts = [np.uint64(b * _BAND % (1 << 64)) for b in self.bands]
        return np.concatenate([own + s for s in shifts], axis=1).view(np.int64)

    def part(self, names: np.ndarray, chunk) -> np.ndarray:
        mixed = (names.view(np.uint64) ^ (names.view(np.uint64) >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (((mixed >> np.uint64(33)) + np.asarray(chunk).astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, products) of the k rows with the largest product, ties to the smaller id. Products are summed
    in one fixed order, so equal vectors have equal ones."""
    rough = x @ q
    if len(ids) > k:
        least = np.partition(rough, len(ids) - k)[len(ids) - k]
        slack = 1e-12 * max(1e-300, float(np.abs(q).sum() * np.abs(x).max()))
        keep = np.flatnonzero(rough >= least - slack)
        x, ids = x[keep], ids[keep]
    exact = (x * q).sum(axis=1)
    order = np.lexsort((ids, -exact))[:k]
    return ids[order], exact[order]


_FOUND = "query long, vec_id long, score double"


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(query, near): the k best (rank, vec_id, score) of each query, candidates of several tables once."""
    rank = F.dense_rank().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k).dropDuplicates(["query", "rank"])
            .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near")))


def exact_nearest(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, kind: str, k: int) -> DataFrame:
    """(query, near) of one block of queries against all rows: every task keeps k a query."""
    q = queries.astype(np.float64)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros((0, q.shape[1]))) for _ in ids]
        for batch in batches:
            x = np.frombuffer(b"".join(batch["vec"]), dtype=kind).reshape(len(batch), -1).astype(np.float64)
            own = batch["vec_id"].to_numpy()
            rough = x @ q.T
            for i in range(len(ids)):
                cut = np.arange(len(own))
                if len(own) > k:
                    least = np.partition(rough[:, i], len(own) - k)[len(own) - k]
                    cut = np.flatnonzero(rough[:, i] >= least - 1e-12 * max(1e-300, np.abs(q[i]).sum() * np.abs(x).max()))
                both, wide = np.concatenate((held[i][0], own[cut])), np.concatenate((held[i][1], x[cut]))
                best, _ = _best(q[i], wide, both, k)
                at = {v: j for j, v in enumerate(both.tolist())}
                held[i] = best, wide[[at[v] for v in best.tolist()]]
        for i, (best, wide) in enumerate(held):
            yield pd.DataFrame({"query": int(ids[i]), "vec_id": best, "score": (wide * q[i]).sum(axis=1)})

    return _merged(rows.select("vec_id", "vec").mapInPandas(scan, _FOUND), k)


def _sampled(rows: DataFrame, count: int, n: int, seed: int) -> DataFrame:
    """About ``count`` of ``n`` rows, picked by a hash of the id."""
    return rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(max(1, n))) < count)


def _arrays(rows: DataFrame, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = rows.select("vec_id", "vec", "norm").toPandas()
    return got["vec_id"].to_numpy(), index.decode(got["vec"].tolist()).astype(np.float64), got["norm"].to_numpy()


def fit(rows: DataFrame, queries: DataFrame, kind: str, k: int = K, tables: int = TABLES, target: float = TARGET,
        sample_rows: int = SAMPLE_ROWS, sample_queries: int = SAMPLE_QUERIES) -> Index:
    """An index over ``rows`` (vec_id, vec, norm) whose settings find ``target`` of a sample's true neighbours."""
    n, largest, smallest, dim = rows.agg(F.count(F.lit(1)), F.max("norm"), F.min("norm"), F.max(F.octet_length("vec"))).first()
    index = Index(dim // np.dtype(kind).itemsize, kind, largest, 1.0, 0, 1, tables)
    index.bands = tuple(range(int(index.band(np.array([smallest]))[0]) + 1))
    q_ids, q, q_norms = _arrays(_sampled(queries, sample_queries, queries.count(), 3), index)
    if not len(q_ids):                                      # a sample by hash may be empty where there are few queries
        q_ids, q, q_norms = _arrays(queries.limit(sample_queries), index)
    _, x, norms = _arrays(_sampled(rows, sample_rows, n, 5), index)
    if not len(x):
        x, norms = q, q_norms
    m = largest / 2.0 ** index.band(norms)
    index.width = CELL * float(np.sqrt(np.sum(np.var(x / m[:, None], axis=0)))) or 1.0
    truth = [(r["query"], near["vec_id"]) for r in exact_nearest(rows, q_ids, q, kind, k + 1).collect()
             for near in r["near"] if near["vec_id"] != r["query"]]
    wanted = rows.sparkSession.createDataFrame([(v,) for v in sorted({v for _, v in truth})], "vec_id long")
    n_ids, near, n_norms = _arrays(rows.join(F.broadcast(wanted), "vec_id"), index)    # sample_queries * k rows at most
    at_q, at_n = {v: i for i, v in enumerate(q_ids.tolist())}, {v: i for i, v in enumerate(n_ids.tolist())}
    pairs = tuple(np.array([at[v[j]] for v in truth], dtype=np.int64) for j, at in enumerate((at_q, at_n)))
    best, cost = None, np.inf
    for functions in FUNCTIONS + COARSE:
        if functions in COARSE and best is not None:
            break
        tried = replace(index, functions=functions, probes=min(MOST_PROBES, 3 ** functions))
        found, read = _curves(tried, (q, q_norms), (near, n_norms), pairs, (x, norms))
        if found[-1] < target and functions:
            continue
        probes = int(np.argmax(found >= target)) + 1
        spent = probes * tables * len(index.bands) * PROBE_COST + read[probes - 1] * n * ROW_COST
        if spent < cost:
            best, cost = replace(tried, probes=probes, found=float(found[probes - 1])), spent
    return best


def _curves(index: Index, queries: tuple, near: tuple, pairs: tuple, rows: tuple) -> tuple[np.ndarray, np.ndarray]:
    """By number of probes: the share of the true neighbours in a visited bucket, the share of all rows read."""
    far = index.probes
    first = np.full(len(pairs[0]), far)
    read = np.full((len(queries[0]), len(rows[0])), far, dtype=np.int32)
    their, own = index.buckets(*near), index.buckets(*rows)
    for t in range(index.tables):
        visits = index.visits(*queries, t)
        for i in range(len(visits)):
            order = np.argsort(visits[i], kind="stable")
            mine = pairs[0] == i
            first[mine] = np.minimum(first[mine], _place(visits[i], order, their[pairs[1][mine], t], far))
            read[i] = np.minimum(read[i], _place(visits[i], order, own[:, t], far))
    share = lambda at: np.cumsum(np.bincount(at.ravel(), minlength=far + 1)[:far]) / max(1, at.size)
    return share(first) if len(first) else np.ones(far), share(read)


def _place(visits: np.ndarray, order: np.ndarray, values: np.ndarray, far: int) -> np.ndarray:
    """Which visit of a band each of ``values`` gets, ``far`` if none."""
    at = np.minimum(np.searchsorted(visits, values, sorter=order), len(visits) - 1)
    return np.where(visits[order[at]] == values, order[at] % far, far)


def deal(rows: DataFrame, index: Index, n: int, tasks: int) -> Index:
    """``index`` with its number of units a table and its hot buckets."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = index.buckets(index.decode(batch["vec"].tolist()), batch["norm"].to_numpy())
            for t in range(index.tables):
                name, c = np.unique(names[:, t], return_counts=True)
                yield pd.DataFrame({"t": t, "name": name, "c": c})

    most = max(LEAST_HOT, n // HOT_SHARE)
    counts = rows.select("vec", "norm").mapInPandas(count, "t int, name long, c long").groupBy("t", "name").agg(F.sum("c").alias("c"))
    hot = {r["name"]: -(-r["c"] // most) for r in counts.where(F.col("c") > most).collect()}
    parts = max(-(-n // UNIT_ROWS), min(-(-tasks // index.tables), -(-n // 2_000)), 1)
    return replace(index, parts=parts, hot=hot)


_DEALT = "unit int, query boolean, id long, name long, vec binary, visits binary"


def _deal_rows(index: Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = index.buckets(index.decode(batch["vec"].tolist()), batch["norm"].to_numpy())
            ids = batch["vec_id"].to_numpy()
            salt = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            for t in range(index.tables):
                own = np.ascontiguousarray(names[:, t])
                chunks = np.array([index.hot.get(v, 1) for v in own.tolist()], dtype=np.uint64)
                yield pd.DataFrame({"unit": t * index.parts + index.part(own, salt % chunks), "query": False, "id": ids,
                                    "name": own, "vec": batch["vec"], "visits": None})
    return run


def _deal_queries(index: Index):
    step = max(1, 500_000 // (index.probes * len(index.bands)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, norms, ids = index.decode(batch["vec"].tolist()), batch["norm"].to_numpy(), batch["vec_id"].to_numpy()
            for k in range(0, len(ids), step):
                for t in range(index.tables):
                    yield split(ids[k:k + step], batch["vec"].to_numpy()[k:k + step],
                                index.visits(x[k:k + step], norms[k:k + step], t), t)

    def split(ids: np.ndarray, vecs: np.ndarray, visits: np.ndarray, t: int) -> pd.DataFrame:
        who = np.repeat(np.arange(len(ids)), visits.shape[1])
        names, chunk = visits.ravel(), np.zeros(visits.size, dtype=np.int64)
        if index.hot:
            chunks = np.array([index.hot.get(v, 1) for v in names.tolist()])
            who, names = np.repeat(who, chunks), np.repeat(names, chunks)
            chunk = np.arange(len(names)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        to = who * index.parts + index.part(names, chunk)
        order = np.lexsort((names, to))
        to, names = to[order], names[order]
        starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        cuts = np.append(starts, len(to))
        own = to[starts] // index.parts
        return pd.DataFrame({"unit": t * index.parts + to[starts] % index.parts, "query": True, "id": ids[own], "name": 0,
                             "vec": vecs[own], "visits": [names[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]})
    return run


def _search(index: Index, k: int):
    """Rows of one unit, ordered by bucket, then its queries."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, names, ids, x = [], None, None, None
        for batch in batches:
            is_query = batch["query"].to_numpy()
            if not is_query.all():
                own = batch[~is_query]
                held.append((own["name"].to_numpy(), own["id"].to_numpy(), index.decode(own["vec"].tolist())))
            if not is_query.any() or not held:
                continue
            if names is None or len(held) > 1:
                names, ids, x = (np.concatenate(p) for p in zip(*held))
                held = [(names, ids, x)]
            asked = batch[is_query]
            q = index.decode(asked["vec"].tolist()).astype(np.float64)
            out = []
            for i, (who, visits) in enumerate(zip(asked["id"].tolist(), asked["visits"])):
                wanted = np.unique(np.frombuffer(visits, dtype=np.int64))
                a, b = np.searchsorted(names, wanted), np.searchsorted(names, wanted, side="right")
                size = b - a
                total = int(size.sum())
                if not total:
                    continue
                rows = np.repeat(a - np.cumsum(size) + size, size) + np.arange(total)
                best, score = _best(q[i], x[rows].astype(np.float64), ids[rows], k)
                out.append((np.full(len(best), who), best, score))
            if out:
                yield pd.DataFrame(dict(zip(("query", "vec_id", "score"), (np.concatenate(c) for c in zip(*out)))))
    return run


def search(queries: DataFrame, rows: DataFrame, index: Index, k: int) -> DataFrame:
    """(query, near) with the k best rows found for each of ``queries`` (vec_id, vec, norm)."""
    dealt = (rows.select("vec_id", "vec", "norm").mapInPandas(_deal_rows(index), _DEALT)
             .unionByName(queries.select("vec_id", "vec", "norm").mapInPandas(_deal_queries(index), _DEALT)))
    found = (dealt.repartitionById(index.tables * index.parts, "unit").sortWithinPartitions("query", "name")
             .mapInPandas(_search(index, k), _FOUND))
    return _merged(found, k)


def nearest_neighbours(rows: DataFrame, chosen: Column, kind: str, k: int = K, tables: int = TABLES,
                       target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``rows`` where ``chosen``."""
    result = "query_id long, rank int, vec_id long, score double"
    n = rows.count()
    asked = rows.where(chosen)
    if not asked.limit(1).count():
        return rows.sparkSession.createDataFrame([], result)
    named = asked.groupBy("vec").agg(F.min("vec_id").alias("first"))
    members = stored(asked.join(named, "vec").select("vec_id", "first", "vec", "norm"), "queries")
    unique = members.where(F.col("vec_id") == F.col("first")).select("vec_id", "vec", "norm")
    kept = without_copies(rows, k + 1)
    index = deal(kept, fit(kept, unique, kind, k, tables, target), n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lists = stored(search(unique, kept, index, k + 1), "found")
    short = stored(unique.join(lists.where(F.size("near") >= min(k + 1, n)).select(F.col("query").alias("vec_id")),
                               "vec_id", "left_anti"), "short")
    whole = lists.join(short.select(F.col("vec_id").alias("query")), "query", "left_anti")
    blocks = -(-short.count() // QUERY_BLOCK)
    for i in range(blocks):
        ids, x, _ = _arrays(short.where(F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(blocks)) == i), index)
        if len(ids):
            whole = whole.unionByName(exact_nearest(kept, ids, x, kind, k + 1))
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (members.select(F.col("vec_id").alias("query_id"), F.col("first").alias("query")).join(whole, "query")
            .select("query_id", F.posexplode(near).alias("p", "x"))
            .select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score"))


def nearest(embeddings: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """The k nearest rows of every row whose vec_id is divisible by ``every``."""
    kind = "<f4" if embeddings.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    return nearest_neighbours(vectors(embeddings), F.col("vec_id") % every == 0, kind, k)
