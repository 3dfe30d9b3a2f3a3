"""Merkle manifest of a dataset: concatenated level strings in aligned blocks.

A row's leaf is the SHA-256 (lowercase hex) of its columns, each written as ``-`` if null,
else as UTF-8 byte count, ``:``, value. Inside a group (``lang``) the leaves ascend by the
key; every ``fan`` consecutive nodes (a last run may be shorter, even one node) hash to
their parent until one node, the group's subroot, is left. The subroots, in order of the
group (null first, bytewise), are hashed to the root in the same way.

Leaves are cut into aligned blocks of ``fan ** levels``. A block keeps each of its levels as
one hex string: parents are the hashes of its fixed-width substrings, and a leaf's siblings
in a level are the substrings that flank its node inside the run. Block tops are the leaves
of the next tier, cut into blocks the same way, so n leaves need log(n) / levels tiers; the
group's only block in a tier stops at its one node. Proofs come back down the tiers: every
join pairs blocks one to one, and a block's leaves leave it only at the end, so no group is
gathered, however much of the table it holds. Positions come from a range partitioning
on (group, key), which splits a hot group over tasks.

``build`` writes the blocks (the manifest) to the shared folder; ``proofs`` derives each
leaf's path from them, ``fold`` recomputes a root from a leaf and its path, and ``changed``
compares two manifests, opening only the blocks whose tops differ.

Rows: null columns hash as ``-``; a null key comes first in its group; rows of one key are
ordered by their leaves; rows that repeat wholly are leaves of their own. Text of any length is hashed
as a whole. A group of one row has its leaf as subroot and adds no siblings. An empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payflow.llm.common import stored
from payflow.operators.ranks import global_row_number, group_row_number

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 2
LEVELS = 8                 # a block holds FAN ** LEVELS nodes of its lowest level
HEX = 64
TAMPER_EVERY = 7

PATH = "array<struct<before:string,after:string>>"


def sha(col: Column) -> Column:
    return F.sha2(col, 256)


def encoded(col: Column) -> Column:
    """One column in a leaf's input: ``-`` if null, else byte count, colon, value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return sha(F.concat(*[encoded(c) for c in columns]))


def group_name(col: Column) -> Column:
    """The group as a string that is never null and sorts null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


@dataclass
class Manifest:
    """``tiers``: blocks (g, block, n, items, levels, top) from the leaves up, one block a group in
    the last; ``groups``: blocks of the group roots in the same form (their g is empty)."""

    tiers: list[DataFrame]
    groups: list[DataFrame]
    fan: int


def _powers(fan: int, upto: int) -> list[int]:
    return [fan ** j for j in range(upto)]


def _parents(level: Column, fan: int) -> Column:
    """The level above: hashes of the fixed-width runs of ``fan`` nodes."""
    width = HEX * fan
    runs = F.sequence(F.lit(0), ((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda i: sha(F.substring(level, i * width + 1, F.lit(width)))), "")


def _blocks(nodes: DataFrame, fan: int, levels: int, name: str) -> DataFrame:
    """Aligned blocks of nodes (g, pos from 0, node, n in the group, payload)."""
    size = fan ** levels
    short = F.size(F.filter(F.array(*[F.lit(p) for p in _powers(fan, levels)]), lambda p: p < F.col("n")))
    blocks = (nodes.groupBy("g", "n", F.floor(F.col("pos") / size).cast("long").alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("pos", "node", "payload"))).alias("items")))
    lowest = F.array_join(F.transform("items", lambda x: x["node"]), "")
    steps = F.slice(F.array(*[F.lit(j) for j in range(levels)]), F.lit(1), short)
    every = F.aggregate(steps, F.array(lowest),
                        lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1), fan))))
    return stored(blocks.withColumn("levels", every).withColumn("top", F.element_at("levels", -1)), name)


def _climb(nodes: DataFrame, most: int, fan: int, levels: int, name: str) -> list[DataFrame]:
    """Tiers of blocks over ``nodes`` whose largest group has ``most`` nodes."""
    tiers, size = [], fan ** levels
    while True:
        blocks = _blocks(nodes, fan, levels, f"{name}-{len(tiers)}")
        tiers.append(blocks)
        if most <= size:
            return tiers
        most = -(-most // size)
        nodes = blocks.select("g", F.col("block").alias("pos"), F.col("top").alias("node"),
                              F.ceil(F.col("n") / size).cast("long").alias("n"), F.lit(None).cast("string").alias("payload"))


def build(leaves: DataFrame, key: str, fan: int = FAN, levels: int = LEVELS) -> Manifest | None:
    """Manifest over ``leaves`` (g, ``key``, node, payload columns in a struct or value ``payload``);
    None for an empty table. Leaves of a group ascend by ``key``, then by their hash."""
    leaves = stored(leaves, "leaves")
    counts = stored(leaves.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "groups")
    most, groups = counts.agg(F.max("n"), F.count(F.lit(1))).first()
    if not groups:
        return None
    placed = (group_row_number(leaves, ["g"], [key, "node"], "at").select("g", (F.col("at") - 1).alias("pos"), "node", "payload"))
    # the counts go to a few blocks' worth of rows a group: a plain join, the planner broadcasts them if they are small
    tiers = _climb(placed.join(counts, "g"), most, fan, levels, "tier")
    tops = (global_row_number(tiers[-1].select(F.col("g").alias("of"), F.col("top").alias("node")), ["of"], "at")
            .select(F.lit("").alias("g"), (F.col("at") - 1).alias("pos"), "node",
                    F.lit(groups).cast("long").alias("n"), F.col("of").alias("payload")))
    return Manifest(tiers, _climb(tops, groups, fan, levels, "groups"), fan)


def _paths(blocks: DataFrame, above: DataFrame | None, fan: int) -> DataFrame:
    """(g, pos, node, payload, path, top nodes above) per item of ``blocks``: the flanking
    substrings in every level of the block, followed by the block's own path ``above``."""
    def siblings(i: Column) -> Column:
        def flank(level: Column, j: Column) -> Column:
            p = F.floor(i / F.element_at(powers, j + 1)).cast("int")
            at = F.pmod(p, F.lit(fan))
            return F.struct(F.substring(level, (p - at) * HEX + 1, at * HEX).alias("before"),
                            F.substring(level, (p + 1) * HEX + 1, (fan - 1 - at) * HEX).alias("after"))
        return F.transform(F.slice(F.col("levels"), F.lit(1), F.size("levels") - 1), flank)

    powers = F.array(*[F.lit(p) for p in _powers(fan, LEVELS + 24) if p < 1 << 31])
    if above is not None:
        blocks = blocks.join(above.select("g", F.col("pos").alias("block"), F.col("path").alias("up"), "subroot", "root"),
                             ["g", "block"])
    else:
        blocks = blocks.withColumns({"up": F.array().cast(PATH), "subroot": F.col("top"), "root": F.col("top")})
    rows = F.transform("items", lambda x, i: F.struct(
        x["pos"].alias("pos"), x["node"].alias("node"), x["payload"].alias("payload"),
        F.concat(siblings(i), F.col("up")).alias("path")))
    return blocks.select("g", "subroot", "root", F.explode(rows).alias("r")).select("g", "r.*", "subroot", "root")


def proofs(manifest: Manifest) -> DataFrame:
    """(g, pos, node, payload, path, subroot, root) per leaf."""
    above = None
    for blocks in reversed(manifest.groups):
        above = _paths(blocks, above, manifest.fan)
    top = above.select(F.col("payload").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root")
    for blocks in reversed(manifest.tiers):
        top = _paths(blocks, top, manifest.fan)
    return top


def proof_text(path: Column) -> Column:
    """The siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: sha(F.concat(s["before"], node, s["after"])))


def changed(old: Manifest, new: Manifest) -> DataFrame:
    """(g, pos, old_node, new_node) of the leaves that differ by position, null where one side has
    none; only blocks whose tops differ are opened."""
    side = lambda m, name: m.tiers[0].select("g", "block", F.col("top").alias(f"{name}_top"), F.col("items").alias(name))
    pairs = (side(old, "old").join(side(new, "new"), ["g", "block"], "full")
             .where(~F.col("old_top").eqNullSafe(F.col("new_top"))))
    opened = lambda name: pairs.select("g", F.explode(name).alias("x")).select(
        "g", "x.pos", F.col("x.node").alias(f"{name}_node"))
    return (opened("old").join(opened("new"), ["g", "pos"], "full")
            .where(~F.col("old_node").eqNullSafe(F.col("new_node"))))


def document_leaves(docs: DataFrame, tamper_every: int = TAMPER_EVERY) -> DataFrame:
    """(g, doc_id, node, payload (doc_id, given)): ``given`` is the leaf of the row as tampered with,
    null for the others. Tampering adds 1 to n_chars where ``tamper_every`` divides the id's crc32."""
    columns = {c: F.col(c) for c in COLUMNS}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper_every == 0
    given = F.when(hit, leaf_hash(list({**columns, "n_chars": F.col("n_chars") + 1}.values())))
    return docs.select(group_name(F.col("lang")).alias("g"), "doc_id", leaf_hash(list(columns.values())).alias("node"),
                       F.struct(F.col("doc_id").cast("long").alias("doc_id"), given.alias("given")).alias("payload"))


def dataset_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Each document's leaf, roots, proof digest, and the root recomputed from the tampered rows."""
    manifest = build(document_leaves(docs), "doc_id", FAN, levels)
    if manifest is None:
        return docs.sparkSession.createDataFrame([], (
            "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"))
    rows = proofs(manifest).select(
        "payload.doc_id", F.col("node").alias("leaf"), "subroot", "root", sha(proof_text(F.col("path"))).alias("proof_sha256"),
        fold(F.coalesce("payload.given", "node"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql() -> str:
    """DuckDB: nodes level by level in a recursive query, then every path folded step by step."""
    enc = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR)))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: "sha256(" + " || ".join(enc(n if c == "n_chars" else c) for c in COLUMNS) + ")"
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("n_chars")} AS leaf, {leaf("(n_chars + 1)")} AS forged,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))) AS crc
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n
  FROM base),
nodes AS (
  SELECT 0 AS level, g, pos AS p, leaf AS node, n FROM placed
  UNION ALL
  SELECT max(level) + 1, g, p // 2, sha256(string_agg(node, '' ORDER BY p)), (max(n) + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY g, p // 2),
subroots AS (
  SELECT g, node AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS gp, count(*) OVER () AS gn FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, gp AS p, subroot AS node, gn AS n FROM subroots
  UNION ALL
  SELECT max(level) + 1, p // 2, sha256(string_agg(node, '' ORDER BY p)), (max(n) + 1) // 2
  FROM tops WHERE n > 1 GROUP BY p // 2),
steps AS (
  SELECT l.g, l.pos, m.level AS lvl, CASE WHEN m.p % 2 = 1 THEN s.node ELSE '' END AS lead_,
         CASE WHEN m.p % 2 = 0 THEN coalesce(s.node, '') ELSE '' END AS trail_
  FROM placed l JOIN nodes m ON m.g = l.g AND m.p = l.pos >> m.level AND m.n > 1
       LEFT JOIN nodes s ON s.g = m.g AND s.level = m.level AND s.p = xor(m.p, 1)
  UNION ALL
  SELECT l.g, l.pos, 1000 + m.level, CASE WHEN m.p % 2 = 1 THEN s.node ELSE '' END,
         CASE WHEN m.p % 2 = 0 THEN coalesce(s.node, '') ELSE '' END
  FROM placed l JOIN subroots r ON r.g = l.g JOIN tops m ON m.p = r.gp >> m.level AND m.n > 1
       LEFT JOIN tops s ON s.level = m.level AND s.p = xor(m.p, 1)),
paths AS (
  SELECT g, pos, list(lead_ ORDER BY lvl) AS b, list(trail_ ORDER BY lvl) AS a, string_agg(lead_ || trail_, '' ORDER BY lvl) AS proof
  FROM steps GROUP BY g, pos),
folded AS (
  SELECT l.doc_id, l.leaf, l.g, coalesce(t.b, []) AS b, coalesce(t.a, []) AS a, coalesce(t.proof, '') AS proof, 1 AS i,
         CASE WHEN xor(l.crc, 4294967295::BIGINT) % 7 = 0 THEN l.forged ELSE l.leaf END AS node
  FROM placed l LEFT JOIN paths t ON t.g = l.g AND t.pos = l.pos
  UNION ALL
  SELECT doc_id, leaf, g, b, a, proof, i + 1, sha256(b[i] || node || a[i]) FROM folded WHERE i <= len(b))
SELECT f.doc_id, f.leaf, r.subroot, t.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = t.node AS verified
FROM folded f JOIN subroots r ON r.g = f.g JOIN tops t ON t.n = 1
WHERE f.i = len(f.b) + 1
"""
