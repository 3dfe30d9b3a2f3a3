"""SimHash fingerprints and near-duplicate groups by a Gray-order hierarchical index.

Fingerprint: XXH64 (seed 42) of every word shingle, repeats included; a bit is 1 if it is
set in over half of the hashes. Two fingerprints link at ``distance`` or fewer differing
bits; groups are the connected components of those links.

Candidate search. ``distance + 1`` orders of the distinct fingerprints are indexed; order
i rotates the fingerprint so that its i-th block of bits leads. Linked fingerprints differ
in at most ``distance`` bits, so they agree on one whole block and meet below the same top
node of that order. Below a top node the fingerprints are sorted by Gray rank (neighbours
then share most bits), cut into leaves, and every inner node keeps the masked pattern of
the bits that all its members share and that its ancestors have not compared yet. A search
adds up the differences from the top down and drops a whole group once they exceed
``distance``, or once all its members already belong to the searcher's component, so a
dense group of near copies costs about one pass and never emits its pairs: a node returns
one row (member, smallest linked member) per member.

Skew: exact copies collapse into one fingerprint before the search. A top node with more
than ``node_rows`` fingerprints is cut into chunks and every pair of chunks is searched by
a task of its own, so all links are found with bounded memory. Top nodes must not grow with
the input, or the pairs of their chunks would: ``blocks`` (narrower blocks, of which any
``blocks - distance`` agree and lead an order together) is picked from the counted number of distinct
fingerprints, so that an even top node stays well below ``node_rows``. It changes the work, not the result.

Rows: null text is empty; a text without words has fingerprint zero, which links like any
other. Null ids never name a component (a group of only null ids gets null). Repeated rows
stay. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payflow.llm.common import stored
from payflow.llm.graph import connected_components

SHINGLE_WORDS = 4
DISTANCE = 4
BITS = 64
NODE_ROWS = 20_000
LEAF, FAN = 16, 8


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1]))[:len(tokens) - words + 1].tolist()
    stops = (ends - 1)[words - 1:].tolist()
    one = xxhash.xxh64_digest
    hashes = b"".join([one(line[a:b], 42) for a, b in zip(starts, stops)])
    n = len(starts)
    ones = np.zeros(BITS, dtype=np.int64)
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8)
    for k in range(0, n, 65_536):
        ones += np.unpackbits(rows[k:k + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, name: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with the fingerprint as a signed long column ``name``."""
    @F.pandas_udf("long")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(name, udf(F.col("text")))


def hex16(col: Column) -> Column:
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each uint64 code word in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def block_masks(distance: int, blocks: int) -> list[int]:
    """The bit masks of every order's leading blocks: any ``blocks - distance`` of the blocks."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    one = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    return [sum(c) for c in combinations(one, blocks - distance)]


def pick_blocks(n: int, distance: int = DISTANCE, node_rows: int = NODE_ROWS) -> int:
    """The fewest blocks whose orders' leading bits cut ``n`` fingerprints into top nodes of ``node_rows`` / 4 at most."""
    most = 2 * distance + 1
    return next((b for b in range(distance + 1, most) if n >> (BITS // b * (b - distance)) <= node_rows // 4), most)


class GrayIndex:
    """Fingerprints in Gray order below a hierarchy of shared masked bit patterns."""

    def __init__(self, prints: np.ndarray):
        self.order = np.argsort(gray_rank(prints), kind="stable")
        self.prints = prints[self.order]
        all_ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        starts = np.arange(0, len(prints), LEAF)
        ands = np.bitwise_and.reduceat(self.prints, starts)
        ors = np.bitwise_or.reduceat(self.prints, starts)
        levels = []
        while True:
            levels.append((starts, ands & ors, ~(ands ^ ors) & all_ones))
            if len(starts) == 1:
                break
            k = np.arange(0, len(starts), FAN)
            starts, ands, ors = starts[k], np.bitwise_and.reduceat(ands, k), np.bitwise_or.reduceat(ors, k)
        self.levels = []
        above = np.zeros(1, dtype=np.uint64)
        for starts, pattern, shared in reversed(levels):       # top first; a node compares what its parent has not
            parents = np.arange(len(starts)) // FAN if self.levels else np.zeros(len(starts), dtype=int)
            self.levels.append((starts, pattern, shared & ~above[parents]))
            above = shared
        self.leaf_shared = above

    def components(self, distance: int) -> np.ndarray:
        """For each fingerprint (input order) the position of its component's first member in Gray order."""
        n = len(self.prints)
        label = np.arange(n)
        step = max(1, 2_000_000 // n)
        member = np.arange(LEAF)
        for q0 in range(0, n, step):
            mine = np.arange(q0, min(n, q0 + step))
            q, node, diff = mine, np.zeros(len(mine), dtype=int), np.zeros(len(mine), dtype=np.int64)
            for depth, (starts, pattern, shared) in enumerate(self.levels):
                if depth:
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    q, diff = np.repeat(q, FAN), np.repeat(diff, FAN)
                    real = node < len(starts)
                    q, node, diff = q[real], node[real], diff[real]
                low = np.minimum.reduceat(label, starts)
                high = np.maximum.reduceat(label, starts)
                diff = diff + np.bitwise_count((self.prints[q] ^ pattern[node]) & shared[node])
                last = np.append(starts[1:], n)[node]
                keep = (diff <= distance) & (last > q) & ~((low[node] == high[node]) & (low[node] == label[q]))
                q, node, diff = q[keep], node[keep], diff[keep]
            at = (self.levels[-1][0][node][:, None] + member).ravel()
            q, diff = np.repeat(q, LEAF), np.repeat(diff, LEAF)
            rest = np.repeat(~self.leaf_shared[node], LEAF)
            real = (at < n) & (at > q)
            q, at, diff, rest = q[real], at[real], diff[real], rest[real]
            near = diff + np.bitwise_count((self.prints[q] ^ self.prints[at]) & rest) <= distance
            label = _merge(label, q[near], at[near])
        out = np.empty(n, dtype=int)
        out[self.order] = self.order[label]
        return out


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest position) after adding the links a-b."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        label = root[label]
    return label


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int | None = None,
          node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges (a, b) over the distinct fingerprints ``prints.fp`` whose components are those of all links."""
    masks = block_masks(distance, blocks or pick_blocks(prints.count(), distance, node_rows))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed]))
                         .alias("ord", "top"))
    sizes = rows.groupBy("ord", "top").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = (rows.join(sizes, ["ord", "top"])
            .withColumn("chunks", F.ceil(F.col("n") / node_rows).cast("int"))
            .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
            # a chunk meets every other chunk of its node once, and itself
            .withColumn("pair", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
                F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                            lambda j: F.least(j, F.col("chunk")) * F.col("chunks") + F.greatest(j, F.col("chunk")))))))
    keys = ["ord", "top", "pair"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = batch[keys].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            if done:
                yield of(batch["fp"].to_numpy()[:done], [0, *cuts.tolist()])
            held = batch.iloc[done:].reset_index(drop=True)
        if held is not None and len(held):
            yield of(held["fp"].to_numpy(), [0, len(held)])

    def of(fps: np.ndarray, cuts: list[int]) -> pd.DataFrame:
        a, b = [], []
        for i, j in zip(cuts, cuts[1:]):
            own = fps[i:j]
            first = GrayIndex(own.view(np.uint64)).components(distance)
            other = first != np.arange(j - i)
            a.append(own[other])
            b.append(own[first[other]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return (rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
            .mapInPandas(search, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = DISTANCE,
                    blocks: int | None = None, node_rows: int = NODE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``."""
    rows = stored(with_fingerprint(docs.select("doc_id", "text"), "fp", words).select("doc_id", "fp"), "prints")
    named = components(rows, distance, blocks, node_rows)
    return (rows.join(named.select("fp", "component_id"), "fp")
            .select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id"))


def components(rows: DataFrame, distance: int = DISTANCE, blocks: int | None = None,
               node_rows: int = NODE_ROWS) -> DataFrame:
    """(fp, first_id, root, component_id) per distinct fingerprint of ``rows`` (doc_id, fp):
    its smallest doc_id, and its component's smallest linked fingerprint and doc_id."""
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(links(prints, distance, blocks, node_rows))
    rooted = (prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("component", "fp")))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(named, "root").select("fp", "first_id", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = DISTANCE,
                         blocks: int | None = None, node_rows: int = NODE_ROWS) -> DataFrame:
    """Of every group the row with the smallest doc_id, with all columns of ``docs``; of rows
    that repeat that id and fingerprint, one. A group of only null ids keeps one row."""
    columns, fp, key = docs.columns, "fp_", "id_"
    while {fp, key} & set(columns):
        fp, key = fp + "_", key + "_"
    rows = stored(with_fingerprint(docs, fp, words), "documents")
    named = components(rows.select("doc_id", F.col(fp).alias("fp")), distance, blocks, node_rows)
    keepers = stored(named.where(F.col("first_id").eqNullSafe(F.col("component_id")))
                     .groupBy("root").agg(F.min(F.struct("first_id", "fp")).alias("k"))
                     .select(F.col("k.first_id").alias(key), F.col("k.fp").alias(fp)), "keepers")
    known = (rows.withColumn(key, F.col("doc_id")).join(keepers.where(F.col(key).isNotNull()), [key, fp])
             .dropDuplicates([key, fp]))
    nameless = (rows.where(F.col("doc_id").isNull()).join(keepers.where(F.col(key).isNull()).select(fp), fp)
                .dropDuplicates([fp]))
    return known.select(columns).unionByName(nameless.select(columns))
