import numpy as np
import pytest

from payflow.llm import vector_search as vs

SCHEMA = "vec_id long, embedding array<float>, label int, norm string, query string, unit int"


def _rows(spark, items):
    return spark.createDataFrame([(i, v, 0, "n", "q", 1) for i, v in items], SCHEMA)


def _brute(items, k=20, every=20):
    kept = {}
    for i, v in items:
        if i is None or v is None or not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        x = np.array(v, dtype=np.float32)
        if i not in kept or x.tobytes() < kept[i].tobytes():
            kept[i] = x
    ids = np.array(sorted(kept))
    x = np.array([kept[i] for i in ids], dtype=np.float64)
    out = {}
    for q in ids[ids % every == 0]:
        score = (x * kept[q].astype(np.float64)).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def _got(frame, **options):
    out = {}
    for r in sorted(vs.nearest(frame, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def _recall(got, wanted):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in wanted.items())
    return hits / sum(map(len, wanted.values()))


def _check(got, wanted, least=0.9):
    assert got.keys() == wanted.keys() and _recall(got, wanted) >= least
    for q, near in got.items():
        assert len(near) == len(wanted[q]) and near == sorted(near, key=lambda p: (-p[1], p[0]))


@pytest.mark.parametrize("seed, spread", [(1, 0.0), (2, 1.0)])
def test_recall_on_random_vectors_and_norms(spark, seed, spread):
    r = np.random.default_rng(seed)
    x = r.normal(size=(3000, 16)) * np.exp(spread * r.normal(size=(3000, 1)))
    items = [(i * 2 + 1 if i % 7 else i * 20, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    got, wanted = _got(_rows(spark, items)), _brute(items)
    _check(got, wanted)
    exact = {q: dict(w) for q, w in wanted.items()}
    assert all(abs(s - exact[q][i]) < 1e-9 for q, near in got.items() for i, s in near if i in exact[q])


def test_clusters_read_few_rows(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(200, 32)) * 3
    x = (centres[r.integers(200, size=8000)] + r.normal(size=(8000, 32)) * 0.2).astype(np.float32)
    items = list(enumerate(x.tolist()))
    frame = _rows(spark, items)
    _check(_got(frame), _brute(items))
    rows = vs.vectors(frame)
    index = vs.fit(rows, rows.where("vec_id % 20 = 0"), "<f4")
    x64, norms = x.astype(np.float64), np.linalg.norm(x.astype(np.float64), axis=1)
    names = index.buckets(x64, norms)
    visits = index.visits(x64[::20], norms[::20], 0)
    assert index.found >= vs.TARGET and np.mean([np.isin(names[:, 0], v).mean() for v in visits]) < 0.4


def test_a_third_are_copies(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(2000, 8)).astype(np.float32)
    x[::3] = x[0]
    items = list(enumerate(x.tolist()))
    got, wanted = _got(_rows(spark, items)), _brute(items)
    _check(got, wanted)
    copies = [q for q in got if q % 3 == 0]
    assert all([i for i, _ in got[q]] == [i for i, _ in wanted[q]] for q in copies)      # ties to the smaller id


def test_a_hot_bucket_is_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(vs, "LEAST_HOT", 50)
    monkeypatch.setattr(vs, "HOT_SHARE", 20)
    r = np.random.default_rng(5)
    x = np.ones((1500, 6)) + r.normal(size=(1500, 6)) * np.where(np.arange(1500) % 3 == 0, 1.0, 1e-3)[:, None]
    items = list(enumerate(x.astype(np.float32).tolist()))
    _check(_got(_rows(spark, items)), _brute(items))
    rows = vs.vectors(_rows(spark, items))
    index = vs.deal(rows, vs.fit(rows, rows.where("vec_id % 20 = 0"), "<f4"), 1500, 16)
    assert index.hot and max(index.hot.values()) > 1


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    items = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (None, [1.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]),
             (5, [inf, 1.0]), (6, [1.0, None]), (8, [0.5, 0.5]), (8, [0.25, 0.5]), (8, [0.25, 0.5]), (9, [-1.0, -1.0]), (40, [1.0, 0.0])]
    assert _got(_rows(spark, items + [(7, [1.0, 1.0, 1.0])])) == _brute(items)
    assert _got(_rows(spark, [])) == {} and _got(_rows(spark, [(1, [1.0, 2.0])])) == {} and _got(_rows(spark, [(20, [1.0, 2.0])])) == {}
    assert _got(_rows(spark, [(20, [1.0, 2.0]), (41, [1.0, 2.0])])) == {20: [(41, 5.0)]}


def test_queries_with_too_few_found_are_searched_exactly(spark, monkeypatch):
    r = np.random.default_rng(6)
    items = list(enumerate(r.normal(size=(400, 12)).astype(np.float32).tolist()))
    one = vs.fit
    monkeypatch.setattr(vs, "fit", lambda *a, **k: vs.replace(one(*a, **k), functions=24, probes=1))
    got, wanted = _got(_rows(spark, items)), _brute(items)
    assert _recall(got, wanted) == 1.0 and all([i for i, _ in got[q]] == [i for i, _ in wanted[q]] for q in wanted)


def test_move_sets_ascend_and_move_no_function_both_ways():
    sets = vs.move_sets(5, 200)
    j = np.arange(1, 6)
    near = j * (j + 1) / (4 * 6 * 7)
    cost = np.concatenate((near, (1 - j / 6 + near)[::-1]))
    assert len(sets) == 200 and len(np.unique(sets, axis=0)) == 200 and not sets[0].any()
    assert (np.diff(sets @ cost) > -1e-6).all() and not (sets * sets[:, ::-1]).any()
    assert len(vs.move_sets(3, 10_000)) == 27 and len(vs.move_sets(0, 5)) == 1
