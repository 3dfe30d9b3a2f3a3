import hashlib
import zlib

import pytest

from payflow.llm import manifest


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(doc_id, source, lang, n_chars, text):
    return _h("".join(_enc(v) for v in (doc_id, source, lang, n_chars, text)))


def _tree(nodes, fan=2):
    """(root, siblings of every node as (before, after) per level), by plain lists."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = p - p % fan
            paths[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1:run + fan])))
        place = [p // fan for p in place]
        nodes = [_h("".join(nodes[i:i + fan])) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def _fold(leaf, path):
    for before, after in path:
        leaf = _h(before + leaf + after)
    return leaf


def _brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    groups = {}
    for doc_id, text, lang, source, n in rows:
        leaf = _leaf(doc_id, source, lang, n, text)
        given = leaf
        if doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
            given = _leaf(doc_id, source, lang, n + 1, text)
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, doc_id, given))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = _tree([x[2] for x in groups[g]])
    root, tops = _tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for (_, _, leaf, doc_id, given), path in zip(groups[g], trees[g][1]):
            path = path + top
            folded = _fold(given, path)
            out.append((doc_id, leaf, trees[g][0], root, _h("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


def _rows(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, g string, node string, pos int")


def _got(spark, rows, levels):
    got = manifest.dataset_manifest(_rows(spark, rows), levels)
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("sizes, levels", [((1,), 3), ((2, 1), 1), ((37, 5, 8), 2), ((16, 33), 4)])
def test_like_plain_trees(spark, sizes, levels):
    rows, i = [], 0
    for k, n in enumerate(sizes):
        for _ in range(n):
            i += 1
            rows.append((i * 3, f"text {i}", ["en", "de", None][k], f"s{i % 4}", i))
    assert _got(spark, rows, levels) == _brute(rows)


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (7, "a" * 300_000, "é", None, 300_000), (7, "b", "é", "s", None),
            (7, "b", "é", "s", None), (8, "漢字 \U0001F600", "en", "s", 4), (-5, "x", "en", "s", 1), (20, "t", "en", "s", 1)]
    assert _got(spark, rows, 1) == _brute(rows)
    assert _got(spark, [], 3) == []


def test_tampered_rows_fail_and_others_hold(spark):
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(60)]
    got = {r[0]: r for r in _got(spark, rows, 3)}
    for i in range(60):
        assert got[i][6] == (zlib.crc32(str(i).encode()) % 7 != 0)


def test_wider_runs(spark):
    names = [_h(str(i)) for i in range(23)]
    leaves = spark.createDataFrame([("g", i, n, str(i)) for i, n in enumerate(names)], "g string, k long, node string, payload string")
    got = manifest.proofs(manifest.build(leaves, "k", fan=3, levels=2)).orderBy("pos").collect()
    root, paths = _tree(names, 3)
    assert [[(s["before"], s["after"]) for s in r["path"]] for r in got] == paths and {r["root"] for r in got} == {root}


def test_changed_opens_only_differing_blocks(spark):
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(40)]
    other = [(i, "edited" if i == 17 else t, g, s, n) for i, t, g, s, n in rows] + [(40, "new", "en", "s", 2)]
    old, new = (manifest.build(manifest.document_leaves(_rows(spark, r)), "doc_id", 2, 2) for r in (rows, other))
    assert sorted(r["pos"] for r in manifest.changed(old, new).collect()) == [17, 40]
