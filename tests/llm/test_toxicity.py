import random
import zlib

import numpy as np

from payflow.llm import toxicity as T

INSULTS = ["gnarf", "blurgh", "snotzel", "krumbat"]
SCHEMA = "doc_id long, quality int, toxic int"


def corpus(prose, n=600):
    docs, labels = [], []
    for i in range(n):
        words, toxic = prose(20 + 5 * (i % 20), i).split(), i % 5 == 0
        if toxic:
            for w in random.Random(i).choices(INSULTS, k=3):
                words.insert(random.Random(i + 1).randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_contract(spark, docs_of, prose, odd):
    docs, labels = corpus(prose)
    labels += [(None, 1, 1), (3, 1, None), (99_999, 0, 1)]
    lab = spark.createDataFrame(labels, SCHEMA)
    odd = [(None if i is None else i + 1000, t) for i, t in odd]
    got = T.toxicity_scores(docs_of(docs + odd), lab).toPandas()
    assert len(got) == len(docs) + len(odd) and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()
    held = got["doc_id"].map(lambda i: i == i and zlib.crc32(str(int(i)).encode()) % 5 == 0)
    assert (held == got["held_out"]).all()
    own = got[got["held_out"] & (got["doc_id"] < len(docs))]
    assert (own["predicted"] == (own["doc_id"] % 5 == 0)).mean() > 0.97
    assert not got[got["doc_id"].isna() | (got["doc_id"] >= 1000)]["predicted"].any()

    turned = [(i, q, 1 - t if i and zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    again = T.toxicity_scores(docs_of(docs + odd), spark.createDataFrame(turned, SCHEMA)).toPandas()
    assert np.allclose(got["score"], again["score"])                  # labels of held-out rows do not matter


def test_filter_empty_tables_and_no_labels(spark, docs_of, prose, odd):
    docs, labels = corpus(prose, 200)
    df, lab = docs_of(docs + odd), spark.createDataFrame(labels, SCHEMA)
    kept = T.keep_clean(df, lab)
    assert kept.columns == df.columns and len(odd) < kept.count() < df.count()
    none = spark.createDataFrame([], SCHEMA)
    assert T.keep_clean(df, none).count() == df.count() and set(T.toxicity_scores(df, none).toPandas()["score"]) == {0.0}
    assert T.toxicity_scores(docs_of([]), lab).count() == 0 and T.keep_clean(docs_of([]), lab).count() == 0


def test_risk_recovers_a_hidden_class():
    r = np.random.default_rng(0)
    hidden = r.random(4000) < 0.2
    u = np.where(hidden[:, None], r.normal(1.5, 1, (4000, 4)), r.normal(-1.5, 1, (4000, 4))).astype(np.float32)
    p = r.normal(1.5, 1, (500, 4)).astype(np.float32)
    w, b = T.fit(p, u, 0.2)
    assert ((u @ w + b > 0) == hidden).mean() > 0.97


def test_recall_holds_with_many_copies_and_when_documents_are_gone(spark, docs_of, prose):
    docs, labels = corpus(prose, 500)
    copies = [(10_000 + i, docs[i % 7][1]) for i in range(1500)]                # seven texts, two of them toxic
    labels += [(10_000 + i, 1, int(i % 7 in (0, 5))) for i in range(0, 1500, 2)]
    gone = [(50_000 + i, 0, 0) for i in range(600)]                             # labels of documents that an earlier stage dropped
    lab = spark.createDataFrame(labels + gone, SCHEMA)
    got = T.toxicity_scores(docs_of(docs + copies), lab).toPandas()
    own = got[got["held_out"] & (got["doc_id"] < 500)]
    toxic = own["doc_id"] % 5 == 0
    assert own[toxic]["predicted"].mean() >= 0.95 and own[~toxic]["predicted"].mean() <= 0.05


def test_recall_on_a_small_sample(spark, docs_of, prose):
    docs, labels = corpus(prose)
    df, lab = docs_of(docs), spark.createDataFrame(labels, SCHEMA)
    scorer = T.train(df, lab, max_positive=60, max_unlabelled=150)
    held = [(i, t) for i, t in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    caught = scorer([t for _, t in held]) >= 0.5
    toxic = np.array([i % 5 == 0 for i, _ in held])
    assert caught[toxic].mean() >= 0.9 and caught[~toxic].mean() <= 0.05


def _plain_risk(p, u, prior, w, b):
    """The risk and whether its corrected part is below zero, by plain loops."""
    import math
    loss = lambda z, y: math.log1p(math.exp(-abs(z))) + max(0.0, -z if y else z)
    margin = lambda x: b + sum(wi * xi for wi, xi in zip(w, x))
    positive = sum(loss(margin(x), 1) for x in p) / len(p)
    hidden = sum(loss(margin(x), 0) for x in u) / len(u) - prior * sum(loss(margin(x), 0) for x in p) / len(p)
    return prior * positive, hidden


def test_fit_like_plain_descent_with_numeric_gradients(monkeypatch):
    r = np.random.default_rng(1)
    p, u = r.poisson(1.0, (12, 3)).astype(np.float32), r.poisson(0.3, (30, 3)).astype(np.float32)
    prior = 0.25
    monkeypatch.setattr(T, "STEPS", 25)
    w, b = T.fit(p, u, prior)
    x = np.zeros(4)
    x[-1] = most = np.log(prior / (1 - prior))
    first, second = np.zeros(4), np.zeros(4)
    for step in range(1, 26):
        below = _plain_risk(p, u, prior, x[:-1], x[-1])[1] < 0
        value = lambda v: -_plain_risk(p, u, prior, v[:-1], v[-1])[1] if below else sum(_plain_risk(p, u, prior, v[:-1], v[-1]))  # noqa: B023, E731
        g = np.array([(value(x + e) - value(x - e)) / 2e-5 for e in np.eye(4) * 1e-5]) + T.DECAY * np.append(x[:-1], 0)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x = x - T.RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        x[-1] = min(x[-1], most)
    assert np.allclose(np.append(w, b), x, atol=2e-3)


def test_scorer_is_a_plain_sum_over_distinct_words(prose):
    text = prose(20_000, 5) + " gnarf GNARF"
    weights = {b: (-1) ** i * 0.01 for i, b in enumerate(sorted({b for w in T.words(text) for b in T.buckets(w)})[:500])}
    weights[T.buckets("gnarf")[0]] = 0.7
    for t in (text, "", None, "gnarf gnarf"):
        margin = -0.3 + sum(weights.get(b, 0.0) for w in set(T.WORD.findall((t or "").lower())) for b in T.buckets(w))
        assert abs(T.Scorer(weights, -0.3)([t])[0] - 1 / (1 + np.exp(-margin))) < 1e-9
