"""Checks, privacy helpers, mart maintenance, similarity and streaming helpers on small inputs."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from payflow.operators.checks import check_append_only, require_parent, rule_violations, store_failures
from payflow.plans import ml as ML
from payflow.plans import privacy as P
from payflow.plans.enrichment import refresh_agg, segment_migrations
from payflow.streaming import jobs as SJ


def test_require_parent_and_append_only(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    parent = spark.createDataFrame([(1,), (3,)], "k long")
    ok, orphans = require_parent(child, parent, "k")
    assert sorted(r.k for r in ok.collect()) == [1, 3] and [r.k for r in orphans.collect()] == [2]
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "k long, v string")
    got = sorted((r.k, r.problem) for r in check_append_only(child, new, "k").collect())
    assert got == [(2, "modified"), (3, "deleted")]


def test_rule_violations_and_store_failures(spark, tmp):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id long, amount int")
    rules = {"amount_positive": F.col("amount") > 0, "id_small": F.col("id") < 3}
    got = {r.rule: r.violations for r in rule_violations(df, rules).collect()}
    assert got == {"amount_positive": 2, "id_small": 1}         # null fails the rule
    store_failures(df, rules, os.path.join(tmp, "fail"))
    f = spark.read.parquet(os.path.join(tmp, "fail"))
    assert sorted((r.rule, r.id) for r in f.collect()) == [("amount_positive", 2), ("amount_positive", 3),
                                                            ("id_small", 3)]


def test_privacy_helpers(spark):
    a = spark.createDataFrame([("ana", "read"), ("bob", "write")], "user string, grant string")
    e = spark.createDataFrame([("ana", "read"), ("cy", "read")], "user string, grant string")
    assert sorted((r.user, r.diff) for r in P.grants_diff(a, e, ["user", "grant"]).collect()) == \
        [("bob", "excess"), ("cy", "missing")]
    df = spark.createDataFrame([(1,), (2,)], "customer_id long")
    assert [r.customer_id for r in P.exclude_opted_out(df, spark.createDataFrame([(2,)], "customer_id long"))
            .collect()] == [1]
    t = spark.createDataFrame([("a@b.c", "1.2.3.4", "x")], "email string, ip_address string, note string")
    inv = {r.column: (r.pii_name, r.email_like_values) for r in P.pii_inventory({"t": t}).collect()}
    assert inv == {"email": (True, 1), "ip_address": (True, 0), "note": (False, 0)}


def test_segment_migrations_and_refresh(spark, tmp):
    d0 = dt.date(2024, 1, 1)
    dim = spark.createDataFrame([(1, "low_value", d0, None, True), (2, "mid_value", d0, None, True)],
                                "customer_id long, segment string, scd_start date, scd_end date, is_current boolean")
    now = spark.createDataFrame([(1, "high_value"), (2, "mid_value")], "customer_id long, segment string")
    mig = [(r.customer_id, r.from_segment, r.to_segment) for r in segment_migrations(dim, now, "2024-02-01").collect()]
    assert mig == [(1, "low_value", "high_value")]
    fact = spark.createDataFrame([(20240101, 1.0, dt.datetime(2024, 1, 3)), (20240102, 2.0, dt.datetime(2024, 1, 3)),
                                  (20240103, 4.0, dt.datetime(2024, 1, 3))], "date_sk int, v double, loaded_at timestamp_ntz")
    path = os.path.join(tmp, "agg")
    agg = lambda f: f.groupBy("date_sk").agg(F.sum("v").alias("v"))
    agg(fact).write.partitionBy("date_sk").parquet(path)
    late = fact.unionByName(spark.createDataFrame([(20240103, 10.0, dt.datetime(2024, 1, 3))], fact.schema))
    refresh_agg(late, agg, path, days=2)
    got = {r.date_sk: r.v for r in spark.read.parquet(path).collect()}
    assert got == {20240101: 1.0, 20240102: 2.0, 20240103: 14.0}
    gone = late.filter("date_sk <> 20240102")                         # a day of the window became empty
    refresh_agg(gone, agg, path, days=2)
    spark.catalog.refreshByPath(path)
    assert {r.date_sk: r.v for r in spark.read.parquet(path).collect()} == {20240101: 1.0, 20240103: 14.0}


def _nearest(items, queries, k):
    ids, x = np.array([i for i, _ in items]), np.array([v for _, v in items], dtype=float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    own = dict(zip(ids.tolist(), x))
    out = {}
    for q in queries:
        s = (x * own[q]).sum(axis=1)
        out[q] = [(int(ids[j]), round(float(s[j]), 9)) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


@pytest.mark.parametrize("kind, unit_rows", [("random", 50_000), ("random", 40), ("clusters", 60), ("one", 50)])
def test_similar_vectors_matches_brute_force(spark, kind, unit_rows):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(600, 8))
    if kind == "clusters":
        vecs = rng.normal(size=(12, 8))[rng.integers(12, size=600)] * 4 + vecs * 0.1
    if kind == "one":                                                # a third are one vector
        vecs[::3] = vecs[0]
    items = list(enumerate(vecs.tolist()))
    odd = [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8)]
    df = spark.createDataFrame(items + odd, "vec_id long, embedding array<double>").repartition(5)
    got: dict = {}
    for r in ML.similar_vectors(df, df.filter(F.col("vec_id") % 20 == 0), k=3, unit_rows=unit_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.match_id, round(r.cosine, 9)))
    assert got == _nearest(items, range(0, 600, 20), 3)


def test_similar_vectors_prune_clusters_and_small_tables(spark):
    from payflow.operators import similar
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in similar.similar_vectors(few, few, k=5).orderBy("query_id").collect()] == [(0, 1, 1), (1, 0, 1)]
    assert similar.similar_vectors(few.limit(0), few.limit(0)).count() == 0
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    vecs = centres[rng.integers(40, size=4000)] * 5 + rng.normal(size=(4000, 16)) * 0.05
    df = spark.createDataFrame(list(enumerate(vecs.tolist())), "vec_id long, embedding array<double>")
    seen = {}
    search = similar._search

    def counting(asked, *rest):
        seen[len(seen)] = asked.select(F.sum(F.octet_length("clusters") / 4)).first()[0]
        return search(asked, *rest)

    similar._search = counting
    try:
        similar.similar_vectors(df, df.filter("vec_id % 50 = 0")).count()
    finally:
        similar._search = search
    assert seen[1] < 80 * 63 / 4                                     # of all clusters, most are never opened


def _auc(score, label):
    p, n = score[label], score[~label]
    return ((p[:, None] > n[None]).sum() + 0.5 * (p[:, None] == n[None]).sum()) / (len(p) * len(n))


def test_permutation_importance_equals_a_plain_one(spark):
    rng = np.random.default_rng(5)
    n = 120
    a, b, flag = rng.normal(size=n), rng.integers(0, 5, size=n), rng.random(n) < 0.4
    label = a + 0.3 * b + rng.normal(size=n) > 0.8
    ids = rng.permutation(10_000)[:n] * 1_000_003
    df = spark.createDataFrame([(int(i), float(x), int(y), bool(z), bool(t)) for i, x, y, z, t in zip(ids, a, b, flag, label)],
                               "transaction_id long, a double, b long, flag boolean, label boolean").repartition(5)
    score = lambda d: d.withColumn("score", 1 / (1 + F.exp(-(F.col("a") + 0.3 * F.col("b") + 0.1 * F.col("flag").cast("int")))))
    got = {r.feature: tuple(r)[1:] for r in ML.permutation_importance(df, ["a", "b", "flag"], score, repeats=4, seed=3).collect()}
    order = np.argsort(ids)
    cols = {"a": a[order], "b": b[order], "flag": flag[order]}
    ids, label = ids[order], label[order]
    plain = lambda c: _auc(np.round(1 / (1 + np.exp(-(c["a"] + 0.3 * c["b"] + 0.1 * c["flag"]))), 4), label)
    base = plain(cols)
    for f in cols:
        drops = []
        for r in range(4):
            m = 2_654_435_761 + 2 * (104_729 * r + 15_485_863 * 3)
            dealt = np.argsort([int(x) * m % 2**32 for x in ids], kind="stable")
            drops.append(base - plain({**cols, f: cols[f][dealt]}))
        assert np.allclose(got[f], (base, np.mean(drops), np.std(drops, ddof=1)), atol=2e-6)
    assert got["a"][1] > got["flag"][1]


def test_model_importance_scores_no_row_anew_for_each_feature(spark, monkeypatch):
    from types import SimpleNamespace
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    rng = np.random.default_rng(8)
    n = 300
    x = {f: rng.normal(size=n).round(1) if i % 3 else rng.integers(0, 3, n).astype(float) for i, f in enumerate(ML.FEATURES)}
    x["velocity_score"] = np.zeros(n)                                              # no tree uses it
    y = (x["amount_zscore"] + x["geo_mismatch"] + 0.5 * rng.normal(size=n) > 1).astype(float)
    rows = [(int(i) * 7_919, *[None if f == "geo_mismatch" and i % 11 == 0 else float(x[f][i]) for f in ML.FEATURES], float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "transaction_id long, " + ", ".join(f"{f} double" for f in ML.FEATURES) + ", y double").repartition(3)
    model = Pipeline(stages=[VectorAssembler(inputCols=ML.FEATURES, outputCol="x", handleInvalid="keep"),
                             GBTClassifier(featuresCol="x", labelCol="y", maxIter=12, maxDepth=4, stepSize=0.3, seed=4)]).fit(df.fillna(0.0))
    scored = []
    transform = lambda d: scored.append(1) or model.transform(d)
    monkeypatch.setattr(ML, "fitted_model", lambda *a: (SimpleNamespace(transform=transform, stages=model.stages), df))
    got = {r.feature: tuple(r)[1:] for r in ML.model_importance(df).collect()}
    assert not scored
    plain = ML.permutation_importance(df.withColumn("label", F.col("y") == 1), ML.FEATURES, lambda d: model.transform(d).withColumn(
        "score", vector_to_array("probability")[1]))
    assert got == {r.feature: tuple(r)[1:] for r in plain.collect()} and len(got) == 11
    assert got["amount_zscore"][1] > 0 and got["velocity_score"][1:] == (0, 0)


def test_tree_tables_follow_the_trees():
    from payflow.operators import trees
    text = """GBTClassificationModel: uid = g, numTrees=2, numClasses=2, numFeatures=3
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 2 <= 1.0E-4)
      Predict: -1.0
     Else (feature 2 > 1.0E-4)
      Predict: 2.0
    Else (feature 0 > 0.5)
     If (feature 0 <= 3.0)
      Predict: 4.0
     Else (feature 0 > 3.0)
      Predict: 8.0
  Tree 1 (weight 0.1):
    Predict: 5.0
"""
    t = trees.TreeTables(trees.read_trees(text), 3)
    values = [np.array([0.5, 0.0, 3.0, np.nan]), np.zeros(4), np.array([1e-4, np.nan, 0.0, 0.0])]
    own = [t.bins(f, v) for f, v in enumerate(values)]
    base, swapped = t.margins(own, [np.zeros(4, int)] * 3)                         # donors below all thresholds
    assert base.tolist() == [-0.5, 2.5, 4.5, 8.5] and sorted(swapped) == [0, 2]
    assert swapped[0].tolist() == [-0.5, 2.5, -0.5, -0.5] and swapped[2].tolist() == [-0.5, -0.5, 4.5, 8.5]
    assert trees.rounded(np.array([0.12345, 0.00005, 0.123449, 1.0])).tolist() == [1235, 1, 1234, 10000]


def test_methods_per_merchant_and_segment(spark):
    from types import SimpleNamespace
    customers = [(i, "x" if i < 6 else "y") for i in range(12)] + [(99, "z")]
    pays = [(c, 1, 1) for c in range(6) for _ in range(4)] + [(c, 1, 2) for c in range(6, 12) for _ in range(4)] + [(0, 2, 3)]
    v = SimpleNamespace(
        customers=spark.createDataFrame(customers, "customer_id long, market_segment string"),
        merchants=spark.createDataFrame([(1,), (2,), (3,)], "merchant_id long"),
        payment_methods=spark.createDataFrame([(1, "card"), (2, "wallet"), (3, "bank_transfer")], "payment_method_id long, type string"),
        tx=spark.createDataFrame([(c, m, p, "succeeded", 100) for c, m, p in pays],
                                 "customer_id long, merchant_id long, payment_method_id long, status string, amount long"))
    got = {(r.merchant_id, r.market_segment): (r.methods, r.source) for r in ML.recommend_by_merchant_segment(v).collect()}
    assert len(got) == 9 and all(1 <= len(m) <= 3 for m, _ in got.values())
    assert got[1, "x"][0][0] == "card" and got[1, "y"][0][0] == "wallet" and got[1, "x"][1] == got[2, "x"][1] == "factors"
    fall = {(r.merchant_id, r.market_segment): (r.methods, r.source) for r in ML.merchant_segment_fallback(v).collect()}
    assert fall[2, "y"] == (["bank_transfer"], "merchant") and fall[3, "x"][1] == "segment" and fall[3, "z"][1] == "all"
    assert fall[1, "x"] == (["card"], "pair") and {got[k] == fall[k] for k in got if got[k][1] != "factors"} == {True}


def test_feature_skew(spark):
    off = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, f double")
    on = spark.createDataFrame([(1, 1.0), (2, 2.5)], "id long, f double")
    r = ML.feature_skew(off, on, "id", ["f"]).collect()[0]
    assert r.skew_rate == 0.5 and not r.ok


def test_dedupe_velocity_and_orphans_streams(spark, tmp):
    base = dt.datetime(2024, 1, 1)
    src = os.path.join(tmp, "ev")
    rows = [(1, 11, base), (1, 11, base + dt.timedelta(seconds=5)), (2, 21, base + dt.timedelta(minutes=1))]
    spark.createDataFrame(rows, "transaction_id long, lsn long, ingested_at timestamp").write.parquet(src)
    s = spark.readStream.schema("transaction_id long, lsn long, ingested_at timestamp").parquet(src)
    q = (SJ.dedupe_stream(s, ["transaction_id", "lsn"]).writeStream.format("memory").queryName("dd")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert spark.sql("select count(*) c from dd").collect()[0].c == 2
    vsrc = os.path.join(tmp, "pay")
    spark.createDataFrame([(7, base + dt.timedelta(minutes=m)) for m in (0, 10, 20)] + [(7, base + dt.timedelta(hours=5))],
                          "customer_id long, created_at timestamp").write.parquet(vsrc)
    vs = spark.readStream.schema("customer_id long, created_at timestamp").parquet(vsrc)
    q = (SJ.velocity_stream(vs).writeStream.format("memory").queryName("vel").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert spark.sql("select max(payments) m from vel").collect()[0].m == 3
    csrc, psrc = os.path.join(tmp, "child"), os.path.join(tmp, "parent")
    spark.createDataFrame([(1, base), (2, base), (3, base + dt.timedelta(hours=6))], "k long, ts timestamp").write.parquet(csrc)
    spark.createDataFrame([(1, base + dt.timedelta(minutes=5)), (3, base + dt.timedelta(hours=6))],
                          "k long, pts timestamp").write.parquet(psrc)
    c = spark.readStream.schema("k long, ts timestamp").parquet(csrc)
    p = spark.readStream.schema("k long, pts timestamp").parquet(psrc)
    q = (SJ.hold_orphans(c, p, "k", "ts", "pts").writeStream.format("memory").queryName("orph").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.k: r.orphan for r in spark.sql("select * from orph").collect()}
    assert got.get(1) is False and got.get(2) is True


def test_similar_vectors_work_out_few_scores_one_by_one(spark, monkeypatch):
    """Rows are ruled out by products of many queries at once; without that, every query copies every row it visits."""
    from payflow.operators import similar
    monkeypatch.setattr(similar, "TOGETHER", 3)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    x[100:140] = x[7]                                                    # ties at the k-th place
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in similar.similar_vectors(df, df.filter("vec_id % 10 = 7 or vec_id < 10"), k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.match_id)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q, ids in got.items():
        score = (u * u[q]).sum(axis=1)
        assert ids == [i for i in np.lexsort((np.arange(300), -score.round(12))) if i != q][:4]
    assert len(got) == 39
