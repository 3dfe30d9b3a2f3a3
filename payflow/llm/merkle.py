"""Document fingerprints: a Merkle tree over sections, paragraphs and chunks.

A text is cut at line breaks into paragraphs. A section ends after an empty paragraph or
after one whose digest starts with a low byte (content-defined, about every 16th), so an
edit moves only the borders near it. Section digests hash their paragraphs' digests, the
root hashes the sections': roots are equal exactly for equal texts. Below a paragraph the
leaves are content-defined chunks, by one rule for texts of every length and script: a cut
after a word (white space follows) whose last bytes hash low, about every other word, and, where no white space
comes for ``RUN_BYTES``, after a byte at which the last four bytes hash low (Chinese and Japanese text, minified code).
Every cut depends on the bytes just before it only, so an edit changes the leaves it touches and no others.

The fingerprint is a string: root, ``:``, then the sections joined by ``;`` as
``digest=paragraph,paragraph``, a paragraph being its leaves' 8-digit hashes. ``likeness`` is the share of
leaves that two fingerprints have in common (twice the shared number over the sum; 1 for equal
roots). ``first_difference`` descends only branches whose digests differ.
The query's columns are computed on the entire digests (64 bits a leaf, SHA-256 a paragraph),
not on the shortened ones of the string.

Neighbours in descending doc_id order are found without a one-task window: rows are cut
into ranges of ids, every range is sorted by its task, and the first row of each range is
also sent to the range before it (the last range gets the very first row). Text is moved
once, and only two rows are held at a time.

Rows: null text is empty. Null ids come last; rows with the same id are ordered by their
text. A single document is its own next one. An empty table gives no rows. Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTION_BYTE = 16          # a paragraph digest whose first byte is below this closes a section
CHUNK_MASK = 1             # one word in two ends a chunk
RUN_BYTES = 24             # so long without white space, one byte in ``RUN_MASK + 1`` does
RUN_MASK = 31
CHUNK_BYTES = 512          # chunks without any such byte (runs of one letter) are cut at this length
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LEAF_BYTES = 4             # of a leaf's 8 bytes, those in the fingerprint string

SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, edited_paragraph long")


def _cuts(marks: np.ndarray) -> list[int]:
    """Where chunks end: positions of the white space that follows them, or of the first byte after them."""
    n = len(marks)
    before = np.concatenate((np.zeros(4, dtype=np.uint32), marks.astype(np.uint32)))       # before[i + 4] is marks[i]
    blank = BLANK[marks]
    at = np.flatnonzero(blank)
    mix = before[at + 3] * 2654435761 + before[at + 2] * 40503 + before[at + 1] * 10007
    cuts = at[((mix >> 13) & CHUNK_MASK == 0) | (marks[at] == 10)]
    gaps = np.diff(np.concatenate(([-1], at, [n])))
    if (gaps > RUN_BYTES).any():
        places = np.arange(n)
        last = np.maximum.accumulate(np.where(blank, places, -1))
        far = np.flatnonzero(places - last > RUN_BYTES)
        mix = before[far + 3] * 2654435761 + before[far + 2] * 40503 + before[far + 1] * 10007 + before[far] * 73856093
        cuts = np.union1d(cuts, far[(mix >> 13) & RUN_MASK == 0])
    return cuts.tolist()


class Tree:
    """Merkle tree of one text: ``root`` (hex), ``sections`` [(hex, [paragraph leaves])],
    ``digests`` [(digest, [paragraph digest])] of the same in full, and a leaf count."""

    __slots__ = ("root", "sections", "digests", "leaves")

    def __init__(self, text: str):
        data = text.encode("utf-8", "surrogatepass")
        cuts = _cuts(np.frombuffer(data, dtype=np.uint8))
        leaf, whole = xxhash.xxh3_64_digest, hashlib.sha256
        sections, digests, root, leaves = [], [], whole(), []
        section, paragraphs, marked, chunks = whole(), [], [], []
        start = line = 0
        for stop in [*cuts, len(data)]:
            if stop > start:
                if stop - start > CHUNK_BYTES:
                    chunks += [leaf(data[i:min(i + CHUNK_BYTES, stop)]) for i in range(start, stop, CHUNK_BYTES)]
                else:
                    chunks.append(leaf(data[start:stop]))
            last = stop == len(data)
            if last or data[stop] == 10:
                digest = whole(data[line:stop]).digest()
                section.update(digest)
                marked.append(digest)
                paragraphs.append(_hex(chunks))
                leaves += chunks
                chunks = []
                if last or stop == line or digest[0] < SECTION_BYTE:
                    sections.append((section.hexdigest()[:8], paragraphs))
                    digests.append((section.digest(), marked))
                    root.update(section.digest())
                    section, paragraphs, marked = whole(), [], []
                line = stop + 1
            start = stop + 1 if last or BLANK[data[stop]] else stop
        self.root, self.sections, self.digests = root.hexdigest()[:32], sections, digests
        self.leaves = Counter(leaves)

    def __str__(self) -> str:
        return f"{self.root}:" + ";".join(f"{d}={','.join(p)}" for d, p in self.sections)


def _hex(leaves: list[bytes]) -> str:
    return b"".join([x[:LEAF_BYTES] for x in leaves]).hex()


def parse(fingerprint: str) -> tuple[str, list[tuple[str, list[str]]]]:
    root, body = fingerprint.split(":")
    return root, [(s[:8], s[9:].split(",")) for s in body.split(";")]


def shared(a: Counter, b: Counter, equal: bool) -> float:
    """Common share of two leaf counts."""
    if equal:
        return 1.0
    total = a.total() + b.total()
    return 2.0 * (a & b).total() / total if total else 1.0


def likeness(a: str, b: str) -> float:
    """Share of common leaves of two fingerprint strings, 0 to 1."""
    step = 2 * LEAF_BYTES
    leaves = lambda f: Counter(p[i:i + step] for _, ps in parse(f)[1] for p in ps for i in range(0, len(p), step))
    return shared(leaves(a), leaves(b), parse(a)[0] == parse(b)[0])


def first_difference(a: tuple[str, list], b: tuple[str, list]) -> int | None:
    """Number (from 0) of the first paragraph that differs, None for equal roots."""
    if a[0] == b[0]:
        return None
    before = 0
    for (da, pa), (db, pb) in zip(a[1], b[1]):
        if da != db:
            same = next((i for i, (x, y) in enumerate(zip(pa, pb)) if x != y), min(len(pa), len(pb)))
            return before + same
        before += len(pa)
    return before


def _range_of(doc_id: Column, bounds: list[int], fan: int = 32) -> Column:
    """How many of the ascending ``bounds`` are above the id, found in two short steps; null ids come last."""
    down = sorted(bounds, reverse=True)
    if not down:
        return F.lit(0)
    every = F.array(*[F.lit(x).cast("long") for x in down])
    coarse = F.array(*[F.lit(x).cast("long") for x in down[fan - 1::fan]]).cast("array<long>")
    skip = F.size(F.filter(coarse, lambda b: b > doc_id))
    fine = F.size(F.filter(F.slice(every, skip * fan + 1, fan), lambda b: b > doc_id))
    return F.when(doc_id.isNull(), F.lit(len(down))).otherwise(skip * fan + fine).cast("int")


def edited_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last half of its code points
    replaced by as many first ones of the next document), and their likeness."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    bounds = sorted(set(cut or []))
    rows = rows.withColumn("part", _range_of(F.col("doc_id"), bounds))
    # one row per range (a bounded number): its first id, and the range that comes before it
    firsts = sorted((r["part"], r["first"]) for r in rows.select("part", "doc_id").groupBy("part")
                    .agg(F.max("doc_id").alias("first")).collect())
    before = [(p, first, firsts[i - 1][0]) for i, (p, first) in enumerate(firsts)]
    if not before:
        return spark.createDataFrame([], SCHEMA)
    edges = spark.createDataFrame(before, "part int, first_id long, before int")
    rows = (rows.join(F.broadcast(edges), "part")
            .select("doc_id", "text", F.explode(F.when(
                F.col("doc_id").eqNullSafe(F.col("first_id")),
                F.array(F.struct(F.col("part"), F.lit(0).alias("extra")),
                        F.struct(F.col("before").alias("part"), F.lit(1).alias("extra"))))
                .otherwise(F.array(F.struct(F.col("part"), F.lit(0).alias("extra"))))).alias("at"))
            .select("doc_id", "text", "at.part", "at.extra"))
    # ranges hold about as many rows each, so dealing them out in order loads the tasks evenly
    rows = rows.repartitionByRange("part").sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), "text")
    return rows.mapInPandas(_edit, SCHEMA)


def _edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by (part, extra, descending id): each row but the extra ones, with the row after it."""
    part, held, ended = None, None, False
    for batch in batches:
        out = []
        for doc_id, text, p, extra in zip(batch["doc_id"], batch["text"], batch["part"], batch["extra"]):
            if p != part:
                part, held, ended = p, None, False
            if ended:
                continue                       # more rows with the first id of the next range
            text = text or ""
            own = (doc_id, text, Tree(text))
            if held is not None:
                out.append(_row(held, own))
            held, ended = own, bool(extra)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype(
            {"doc_id": "Int64", "n_chars": "int64", "edited_paragraph": "Int64", "near_edited": "float64", "near_next": "float64"})


def _row(own: tuple, following: tuple) -> tuple:
    doc_id, text, tree = own
    half = len(text) // 2
    edited = text[:len(text) - half] + following[1][:half]
    new = Tree(edited) if edited != text else tree
    return (None if pd.isna(doc_id) else int(doc_id), len(text),
            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(tree), str(new),
            shared(tree.leaves, new.leaves, tree.root == new.root),
            shared(tree.leaves, following[2].leaves, tree.root == following[2].root),
            first_difference((tree.root, tree.digests), (new.root, new.digests)))
