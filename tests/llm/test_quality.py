import random
import zlib

import numpy as np

from payflow.llm import quality as Q


def corpus(prose, n=240):
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        text = prose(20 + 7 * (i % 30), i)
        if not good:
            text = random.Random(i).choice([text.upper().replace(" ", "!! "), " ".join(w + " " + w for w in text.split() for _ in range(4)),
                                            text.replace(" ", "%%% ")])
        docs.append((i, text))
        if i % 5:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_contract(spark, docs_of, prose, odd):
    docs, labels = corpus(prose)
    lab = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (99_999, 0, 0)], "doc_id long, quality int, toxic int")
    odd = [(None if i is None else i + 1000, t) for i, t in odd]
    got = Q.quality_scores(docs_of(docs + odd), lab).toPandas()
    assert len(got) == len(docs) + len(odd) and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()
    held = got["doc_id"].map(lambda i: i == i and zlib.crc32(str(int(i)).encode()) % 3 == 1)
    assert (held == got["held_out"]).all()
    truth = {i: int(i % 3 != 0) for i, _ in docs}
    own = got[got["held_out"] & got["doc_id"].isin(truth)]
    assert (own["predicted"] == own["doc_id"].map(truth)).mean() > 0.95


def test_held_out_labels_do_not_matter(spark, docs_of, prose):
    docs, labels = corpus(prose, 90)
    schema = "doc_id long, quality int, toxic int"
    a = Q.quality_scores(docs_of(docs), spark.createDataFrame(labels, schema)).toPandas().sort_values("doc_id")
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    b = Q.quality_scores(docs_of(docs), spark.createDataFrame(turned, schema)).toPandas().sort_values("doc_id")
    assert np.allclose(a["score"], b["score"])


def test_filter_empty_tables_and_no_labels(spark, docs_of, prose, odd):
    schema = "doc_id long, quality int, toxic int"
    docs, labels = corpus(prose, 90)
    df, lab = docs_of(docs + odd), spark.createDataFrame(labels, schema)
    kept = Q.keep_good(df, lab)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()
    none = spark.createDataFrame([], schema)
    assert Q.keep_good(df, none).count() == df.count()                # every score is 0.5
    assert set(Q.quality_scores(df, none).toPandas()["score"]) == {0.5}
    assert Q.quality_scores(docs_of([]), lab).count() == 0 and Q.keep_good(docs_of([]), lab).count() == 0


def test_normal_equations_and_isotonic_are_the_plain_ones(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, len(Q.STATISTICS)))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(int)
    rows = spark.createDataFrame([(a.tolist(), int(b), i % 2) for i, (a, b) in enumerate(zip(x, y))], "stats array<double>, y int, fold int")
    model = Q.train(rows.repartition(7))
    z = Q.Basis(x.mean(axis=0), x.std(axis=0))(x)
    penalty = Q.RIDGE * len(x) * np.append(np.ones(Q.FEATURES), 1e-6) + 1e-9
    plain = np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y)
    assert np.allclose(z @ model.weights, z @ plain, atol=1e-6)
    n, s = np.array([2.0, 1, 1, 4]), np.array([1.0, 1, 0, 3])
    assert np.allclose(Q.isotonic(n, s), [0.5, 0.5, 0.5, 0.75]) and (np.diff(model.values) >= 0).all()


def test_features_approximate_the_kernel():
    r = np.random.default_rng(1)
    x = r.normal(size=(40, len(Q.STATISTICS)))
    z = Q.Basis(np.zeros(x.shape[1]), np.ones(x.shape[1]))(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * Q.WIDTH ** 2))
    assert np.abs(z @ z.T - exact).mean() < 0.06
