import random
import re

import numpy as np
import xxhash

from payflow.llm import simhash as S
from payflow.llm.graph import connected_components


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance):
    label = list(range(len(prints)))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance
    while True:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(prints))]
        if new == label:
            return label
        label = new


def clustered(seed, n):
    """Random fingerprints, chains and dense clusters of near ones."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    for base in out[:5]:
        x = base
        for _ in range(40):
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 5)))
            out.append(x)
        out += [base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(60)]
    return np.array(sorted(set(out)), dtype=np.uint64)


def test_index_equals_brute_force():
    for seed, n in ((1, 10), (2, 400), (3, 3)):
        prints = clustered(seed, n)
        for distance in (0, 1, 4, 7):
            got = S.GrayIndex(prints).components(distance)
            want = brute_components(prints, distance)
            assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))
    assert S.GrayIndex(np.array([5], dtype=np.uint64)).components(4).tolist() == [0]


def test_links_and_components_over_spark(spark):
    prints = clustered(7, 300)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    want = brute_components(prints, 4)
    index = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    for blocks, rows in ((None, 20_000), (7, 20_000), (None, 2)):      # node_rows=2: every node is cut into pairs of chunks
        roots = {r["node"]: r["component"] for r in connected_components(S.links(df, 4, blocks, rows)).collect()}
        got = [roots.get(int(x), int(x)) for x in prints.view(np.int64)]
        assert len(set(zip([index[g] for g in got], want))) == len(set(want)) == len(set(got))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(900, 901), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(501)}, 900: 900, 901: 900}


def test_rows_equal_brute_force(docs_of, prose, odd):
    base = prose(300, 1).split()
    docs = odd + [(100 + i, " ".join(base[:-1 - i % 3])) for i in range(12)] + [(200 + i, prose(40, i)) for i in range(40)]
    docs += [(300, "A B c\x1fd e"), (301, "a\x0bb\x0cc D e f"), (302, prose(20_000, 5)), (None, "lonely words here to see"), (None, "lonely words here to see")]
    got = S.near_duplicates(docs_of(docs)).collect()
    prints = np.array([plain_fingerprint(t) for _, t in docs], dtype=np.uint64)
    label = brute_components(prints, 4)
    want = []
    for (doc, _), fp, own in zip(docs, prints, label):
        ids = [d for (d, _), x in zip(docs, label) if x == own and d is not None]
        want.append((doc, f"{int(fp):016x}", min(ids, default=None)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)

    df = docs_of(docs)
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert len(rows) == len(set(label))
    assert {r["doc_id"] for r in rows} == {w[2] for w in want}


def test_empty(docs_of):
    assert S.near_duplicates(docs_of([])).count() == 0 and S.drop_near_duplicates(docs_of([])).count() == 0


def test_blocks_grow_with_the_number_of_prints():
    picked = [S.pick_blocks(n) for n in (0, 10**4, 10**7, 10**9, 10**11, 10**13)]
    assert picked == sorted(picked) and picked[0] == 5 and picked[3] > 5
    for n, b in zip((10**7, 10**9, 10**11), picked[2:]):
        leading = min(bin(m).count("1") for m in S.block_masks(4, b))
        assert n / 2**leading <= S.NODE_ROWS
