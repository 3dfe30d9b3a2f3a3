import zlib

import numpy as np
import pytest

from payflow.llm import packing as P

HARD = ["it's <|endoftext|>   x", "a''s b'll 3½² ''' É\x1c\x85 Σς İ it'S", "  ", "don't 's.'s", "­ soft x y", "a\x01b", "a" * 9000, "..." * 2000,
        "x²³9 ª º µ ß ÿ × ÷ §", "é é ﬁ", "tab\tnew\nline\rx", " nbsp"]


@pytest.fixture(scope="module")
def encoder():
    return P.encoder(None)


def test_ids_equal_the_tokenizer(encoder, prose):
    for text in [*HARD, prose(3000, 1), prose(50, 2).upper(), ", ".join(prose(60, 3).split())]:
        want = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.encode(text) == want, text[:40]


def test_pieces_cover_every_id_once(docs_of, encoder, prose, odd):
    docs = odd + [(50 + i, prose(4 ** (i % 7), i)) for i in range(40)] + [(200 + i, t) for i, t in enumerate(HARD)]
    for group in (P.GROUP_TOKENS, 3000):
        got = P.pack_documents(docs_of(docs), group_tokens=group, with_ids=True).toPandas()
        want = {}
        for doc, text in docs:
            want.setdefault(doc, []).append(encoder.encode(text or "") + np.array([1], "<u4").tobytes())
        for doc, own in got.groupby(got["doc_id"].astype(object).where(got["doc_id"].notna(), None), dropna=False):
            doc = None if doc != doc or doc is None else doc
            if len(want[doc]) > 1:
                continue                                             # repeated ids: told apart by no column
            ids = want[doc][0]
            own = own.sort_values("start")
            assert b"".join(own["ids"]) == ids and (own["doc_tokens"] == len(ids) // 4).all()
            assert (own["start"] == own["length"].cumsum() - own["length"]).all()
        assert got["length"].sum() == sum(len(x) // 4 for xs in want.values() for x in xs)
        assert (got["ids_crc32"] == got["ids"].map(zlib.crc32)).all() and (got["length"] > 0).all()
        for _, own in got.sort_values("offset").groupby("sequence_id"):
            assert (own["offset"] == own["length"].cumsum() - own["length"]).all()
            n = int(own["length"].sum())
            assert n <= P.CAPACITY and n & (n - 1) == 0              # full, or a power of two: no padding at all
    assert P.pack_documents(docs_of([])).count() == 0


def test_costs_are_balanced():
    r = np.random.default_rng(1)
    lengths = r.integers(1, 1500, 4000).tolist()
    pieces = P.pack(lengths)
    cost = np.zeros(1 + max(p[3] for p in pieces))
    fill = np.zeros(len(cost), dtype=int)
    for _, _, n, s, _ in pieces:
        cost[s] += P.LINEAR * n + P.QUADRATIC * n * n
        fill[s] += n
    in_order = [sum(lengths[i:i + 3]) for i in range(0, len(lengths), 3)]
    assert (fill[:-11] == P.CAPACITY).all() and sum(fill) == sum(lengths)
    plain = np.zeros(len(cost))                                       # the same documents cut in order
    at = 0
    for n in lengths:
        while n:
            s, room = at // P.CAPACITY, P.CAPACITY - at % P.CAPACITY
            take = min(n, room)
            plain[min(s, len(plain) - 1)] += P.LINEAR * take + P.QUADRATIC * take * take
            at, n = at + take, n - take
    full = fill == P.CAPACITY
    assert cost[full].std() < plain[full].std() and len(in_order)


def plain_pack(lengths, capacity=P.CAPACITY):
    """The stated rule by plain loops: (document, start, length, sequence) in the order of assignment."""
    total = sum(lengths)
    room = [capacity] * (total // capacity) + [1 << b for b in range(20, -1, -1) if total % capacity >> b & 1]
    cost, out = [0.0] * len(room), []
    line = [(n, d, 0) for d, n in enumerate(lengths) if n]
    while line:
        line.sort(key=lambda x: (-x[0], x[1], x[2]))
        n, d, start = line.pop(0)
        able = [s for s in range(len(room)) if room[s] >= n] or [s for s in range(len(room)) if room[s]]
        s = min(able, key=lambda s: (cost[s], s))
        take = min(n, room[s])
        out.append((d, start, take, s))
        room[s] -= take
        cost[s] += P.LINEAR * take + P.QUADRATIC * take * take
        if n > take:
            line.append((n - take, d, start + take))
    return out


def test_assignment_like_the_stated_rule():
    r = np.random.default_rng(2)
    for lengths in ([1], [2048], [2049, 1], [700, 700, 700], r.integers(1, 900, 60).tolist(), [5000, 3, 3, 2048, 77]):
        assert [p[:4] for p in P.pack(lengths)] == plain_pack(lengths)


def test_many_small_files_give_few_short_sequences(spark, docs_of, prose):
    docs = [(i, prose(90, i)) for i in range(300)]
    split, whole = docs_of(docs).repartition(60, "doc_id"), docs_of(docs).coalesce(1)
    packed = {}
    for name, df in (("split", split), ("whole", whole)):
        got = P.pack_documents(df).toPandas()
        size = got.groupby("sequence_id")["length"].sum()
        assert ((size & (size - 1)) == 0).all() and size.max() == P.CAPACITY
        assert (size < P.CAPACITY).sum() <= 11 and got["length"].sum() == got.drop_duplicates("doc_id")["doc_tokens"].sum()
        packed[name] = len(size)
    assert abs(packed["split"] - packed["whole"]) <= 11
    assert P.short_share(P.pack_documents(split)) < 0.5
