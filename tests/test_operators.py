"""Operators against brute-force answers on small hand-built inputs (ties, nulls, hot keys)."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from payflow.operators.aggregates import histogram_percentile
from payflow.operators.fold import greedy_cap
from payflow.operators.ranks import global_row_number, ntile, rank_deciles
from payflow.operators.scd2 import scd2_apply, scd2_as_of, versions_from_snapshots
from payflow.operators.topk import first_k_by
from payflow.operators.windows import count_in_range, latest_per_key, prior_count, seen_before


def test_global_row_number_matches_sort(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 20)) for i in range(500)]          # many ties on v
    df = spark.createDataFrame(rows, "id long, v int").repartition(7)
    out = global_row_number(df, ["v", "id"], "rn", num_partitions=5).toPandas()
    exp = sorted(rows, key=lambda r: (r[1], r[0]))
    got = out.sort_values("rn")[["id", "v"]].itertuples(index=False, name=None)
    assert list(got) == exp
    assert sorted(out.rn) == list(range(1, 501))


def test_ntile_matches_sql_definition(spark):
    for n in (1, 7, 10, 23, 101):
        df = spark.createDataFrame([(i, float(i % 13)) for i in range(n)], "id long, v double")
        got = ntile(df, ["v", "id"], 10, "t").orderBy("v", "id").select("t").toPandas().t.tolist()
        exp = spark.createDataFrame([(i, float(i % 13)) for i in range(n)], "id long, v double") \
            .selectExpr("ntile(10) over (order by v, id) as t", "v", "id").orderBy("v", "id").toPandas().t.tolist()
        assert got == exp


def test_rank_deciles_match_pandas_qcut(spark):
    vals = [float(x) for x in np.random.default_rng(3).integers(0, 50, 196)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    got = rank_deciles(df, ["v", "id"], 10, "d").toPandas().set_index("id").d.sort_index()
    s = pd.Series(vals)
    exp = pd.qcut(s.rank(method="first"), 10, labels=False) + 1
    assert (got.values == exp.values).all()
    seg = pd.Series(np.where(exp >= 9, "high", np.where(exp >= 5, "mid", "low")))
    assert (seg == "high").sum() == 39 and (seg == "mid").sum() == 78     # 196 spenders: 39 / 78 / 79


def _brute_count(rows, lookback, include_current=True):
    out = {}
    for i, k, t in rows:
        out[i] = sum(1 for j, k2, t2 in rows if k2 == k and t - lookback <= t2 <= t
                     and (include_current or (t2, j) < (t, i)))
    return out


def test_count_in_range_hot_key_and_boundaries(spark):
    base = dt.datetime(2024, 1, 1)
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        key = 0 if i % 3 else rnd.randint(1, 5)              # key 0 holds two thirds of the rows
        rows.append((i, key, base + dt.timedelta(minutes=rnd.randint(0, 3000))))
    rows.append((1000, 0, base + dt.timedelta(minutes=60)))   # exact 1 h boundary
    rows.append((1001, 0, base))
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz")
    got = count_in_range(df, ["k"], "ts", 3600, "n", bucket_s=4 * 3600).toPandas().set_index("id").n.to_dict()
    exp = _brute_count(rows, dt.timedelta(hours=1))
    assert got == exp


def test_prior_count_excludes_self_and_later_peers(spark):
    base = dt.datetime(2024, 1, 1, 12)
    rows = [(1, 7, base), (2, 7, base), (3, 7, base + dt.timedelta(minutes=30)),
            (4, 7, base + dt.timedelta(hours=1)), (5, 7, base + dt.timedelta(hours=2, seconds=1)), (6, 8, base)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz")
    got = prior_count(df, ["k"], "ts", "id", 3600, "p").toPandas().set_index("id").p.to_dict()
    assert got == {1: 0, 2: 1, 3: 2, 4: 3, 5: 0, 6: 0}


def test_seen_before_and_latest_per_key(spark):
    rows = [(1, "a", "mobile", 1), (2, "a", "mobile", 2), (3, "a", "desktop", 3), (4, "b", "mobile", 1)]
    df = spark.createDataFrame(rows, "id long, c string, dev string, t long")
    got = seen_before(df, ["c", "dev"], "t", "id", "seen").toPandas().set_index("id").seen.to_dict()
    assert got == {1: False, 2: True, 3: False, 4: False}
    lp = latest_per_key(df, ["c"], [F.col("t")]).toPandas().set_index("c").id.to_dict()
    assert lp == {"a": 3, "b": 4}


def test_first_k_by(spark):
    rows = [("s", 3, "c"), ("s", 1, "a"), ("s", 2, "b"), ("t", 5, "x")]
    df = spark.createDataFrame(rows, "g string, ts long, msg string")
    got = {r.g: r.m for r in first_k_by(df, ["g"], ["ts"], "msg", 2, "m").collect()}
    assert got == {"s": ["a", "b"], "t": ["x"]}


def test_histogram_percentiles(spark):
    vals = list(np.random.default_rng(1).integers(0, 300, 997))
    df = spark.createDataFrame([("a", int(v)) for v in vals] + [("b", None)], "g string, x int")
    disc = histogram_percentile(df, ["g"], "x", 0.95, "disc", "p").collect()[0].p
    sv = sorted(vals)
    assert disc == sv[int(np.ceil(0.95 * len(sv))) - 1]
    fl = histogram_percentile(df, ["g"], "x", 0.95, "floor", "p").collect()[0].p
    assert fl == sv[int(np.floor(0.95 * len(sv)))]


def test_greedy_cap_rejected_items_do_not_count(spark):
    rows = [(1, 1, Decimal("60.00"), Decimal("100.00")), (1, 2, Decimal("50.00"), Decimal("100.00")),
            (1, 3, Decimal("40.00"), Decimal("100.00")), (2, 1, Decimal("10.00"), Decimal("10.00"))]
    df = spark.createDataFrame(rows, "k long, seq long, amt decimal(14,2), cap decimal(14,2)")
    got = {(r.k, r.seq): r.accepted for r in greedy_cap(df, "k", ["seq"], "amt", "cap", []).collect()}
    assert got == {(1, 1): True, (1, 2): False, (1, 3): True, (2, 1): True}   # equal to the remaining: accepted


def _greedy(rows):
    """Decisions by a plain loop: (key, seq) -> (accepted, total)."""
    used, out = {}, {}
    for k, seq, a, cap in sorted(rows, key=lambda r: (r[0], r[1])):
        fits = a is not None and used.get(k, 0) + a <= cap
        used[k] = used.get(k, 0) + (a if fits else 0)
        out[k, seq] = (fits, used[k])
    return out


@pytest.mark.parametrize("chunk", [25, 50_000])
def test_greedy_cap_like_a_plain_loop_with_hot_keys(spark, chunk):
    r = np.random.default_rng(chunk)
    rows = []
    for k, n, cap in ((1, 90, 60), (2, 60, 500), (3, 4, 10), (4, 1, 0), (5, 40, 0), (6, 70, 35)):
        low = -2 if k == 6 else 1                                     # key 6 gives room back now and then
        rows += [(k, i, Decimal(int(r.integers(low, 12))), Decimal(cap)) for i in r.permutation(n).tolist()]
    rows.append((3, 99, None, Decimal(10)))
    df = spark.createDataFrame([(k, int(i), a, c) for k, i, a, c in rows], "k long, seq long, amt decimal(14,2), cap decimal(14,2)")
    got = {(x.k, x.seq): (x.accepted, x.accepted_total_after) for x in greedy_cap(df, "k", ["seq"], "amt", "cap", [], chunk).collect()}
    assert got == _greedy(rows)
    assert greedy_cap(df.limit(0), "k", ["seq"], "amt", "cap", [], chunk).count() == 0


def test_greedy_cap_one_payment_with_many_requests(spark):
    n = 120_000
    df = spark.range(n).select(F.lit("p").alias("k"), F.col("id").alias("seq"), ((F.col("id") * 7919) % 1000 + 1).cast("decimal(14,2)").alias("amt"),
                               F.lit(Decimal(250_000)).cast("decimal(14,2)").alias("cap"))
    got = greedy_cap(df, "k", ["seq"], "amt", "cap", [], 20_000)
    used, accepted = 0, 0
    for i in range(n):
        a = (i * 7919) % 1000 + 1
        if used + a <= 250_000:
            used, accepted = used + a, accepted + 1
    assert tuple(got.agg(F.count_if("accepted"), F.max("accepted_total_after"), F.count("*")).first()) == (accepted, used, n)


def test_frame_sums_are_exact(spark):
    from payflow.operators.windows import COUNT, frame_sum, multi_range_frame_aggs
    r = np.random.default_rng(4)
    rows = [(int(r.integers(3)), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(r.integers(600))), Decimal(int(r.integers(1, 10**9))) / 100)
            for _ in range(300)] + [(0, dt.datetime(2024, 1, 1), None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, k int, ts timestamp_ntz, amt decimal(14,2)")
    got = multi_range_frame_aggs(df, ["k"], "ts", {"s": (3600, True, frame_sum("amt")), "p": (1800, False, frame_sum("amt")),
                                                   "n": (3600, True, COUNT)}, bucket_s=7200).collect()
    for g in got:
        inside = lambda lo, incl: [a or 0 for k, t, a in rows if k == g.k and (g.ts - t).total_seconds() <= lo  # noqa: E731, B023
                                   and (t <= g.ts if incl else t < g.ts)]  # noqa: B023
        assert (g.s, g.p, g.n) == (sum(inside(3600, True)), sum(inside(1800, False)), len(inside(3600, True)))
    assert len(got) == len(rows)


def test_scd2_versions_apply_and_as_of(spark):
    snaps = spark.createDataFrame(
        [(1, "saas", dt.date(2024, 1, 1)), (1, "saas", dt.date(2024, 2, 1)), (1, "retail", dt.date(2024, 3, 1)),
         (2, "travel", dt.date(2024, 1, 1))], "id long, category string, snapshot_date date")
    v = versions_from_snapshots(snaps, "id", ["category"], "snapshot_date").toPandas().sort_values(["id", "scd_start"])
    assert v[["id", "category", "is_current"]].values.tolist() == [[1, "saas", False], [1, "retail", True],
                                                                   [2, "travel", True]]
    dim = versions_from_snapshots(snaps, "id", ["category"], "snapshot_date")
    snap = spark.createDataFrame([(1, "retail"), (2, "gaming"), (3, "food")], "id long, category string")
    once = scd2_apply(dim, snap, "id", ["category"], "2024-04-01")
    twice = scd2_apply(once, snap, "id", ["category"], "2024-04-01")
    key = ["id", "scd_start"]
    assert once.toPandas().sort_values(key).values.tolist() == twice.toPandas().sort_values(key).values.tolist()
    assert once.filter("is_current").count() == 3
    facts = spark.createDataFrame([(1, dt.date(2024, 2, 15)), (1, dt.date(2024, 3, 1)), (2, dt.date(2023, 12, 1))],
                                  "id long, d date")
    drop = scd2_as_of(facts, once.withColumn("sk", F.concat_ws("-", "id", "category")), "id", F.col("d"), ["sk"])
    assert sorted(r.sk for r in drop.collect()) == ["1-retail", "1-saas"]      # before first version: dropped
    latest = scd2_as_of(facts, once.withColumn("sk", F.concat_ws("-", "id", "category")), "id", F.col("d"), ["sk"],
                        on_miss="latest")
    assert sorted(r.sk for r in latest.collect()) == ["1-retail", "1-saas", "2-gaming"]


def test_group_row_number_splits_hot_group(spark):
    from payflow.operators.ranks import group_row_number
    rnd = random.Random(9)
    rows = [(0 if i % 4 else rnd.randint(1, 3), i, rnd.randint(0, 50)) for i in range(600)]   # group 0 is hot
    df = spark.createDataFrame(rows, "g long, id long, t long").repartition(5)
    got = group_row_number(df, ["g"], ["t", "id"], "rn", num_partitions=6).toPandas()
    exp = pd.DataFrame(rows, columns=["g", "id", "t"]).sort_values(["g", "t", "id"])
    exp["rn"] = exp.groupby("g").cumcount() + 1
    m = got.merge(exp, on=["g", "id", "t"], suffixes=("", "_e"))
    assert len(m) == 600 and (m.rn == m.rn_e).all()


def test_chunked_string_agg_bounds_each_row(spark):
    from payflow.operators.lists import chunked_string_agg
    rows = [(1, i) for i in range(2500)] + [(2, 7), (2, 3)]
    df = spark.createDataFrame(rows, ["g", "v"]).repartition(4)
    out = chunked_string_agg(df, ["g"], F.col("v"), "ids", chunk=1000).collect()
    by_g = {}
    for r in out:
        by_g.setdefault(r["g"], {})[r["id_chunk"]] = r["ids"].split(", ")
    assert sorted(by_g[1]) == [0, 1, 2] and [len(by_g[1][c]) for c in range(3)] == [1000, 1000, 500]
    # chunks concatenated in chunk order are the whole list in string order, each value once
    whole = [s for c in range(3) for s in by_g[1][c]]
    assert whole == sorted(str(i) for i in range(2500))
    assert by_g[2] == {0: ["3", "7"]}


def test_scd2_as_of_latest_fills_gaps_with_current(spark):
    D = dt.date
    dim = spark.createDataFrame(
        [(5, "A", D(2024, 1, 1), D(2024, 2, 1), False), (5, "B", D(2024, 3, 1), D(2024, 4, 1), False),
         (6, "C", D(2024, 1, 1), D(2024, 2, 1), False), (6, "D", D(2024, 3, 1), None, True)],
        "id long, sk string, scd_start date, scd_end date, is_current boolean")
    facts = [(1, 5, D(2023, 12, 1)), (2, 5, D(2024, 2, 15)), (3, 5, D(2024, 5, 1)), (4, 5, D(2024, 3, 10)),
             (5, 6, D(2023, 1, 1)), (6, 6, D(2024, 2, 10)), (7, 6, D(2024, 1, 5)), (8, 7, D(2024, 1, 5))]
    f = spark.createDataFrame(facts, "fid long, id long, d date")
    got = {r.fid: r.sk for r in scd2_as_of(f, dim, "id", F.col("d"), ["sk"], on_miss="latest").collect()}
    # version valid on the day, else the current version, else null (no current / unknown key)
    assert got == {1: None, 2: None, 3: None, 4: "B", 5: "D", 6: "D", 7: "C", 8: None}


def test_distinct_count_frame_matches_brute_force(spark):
    from payflow.operators.windows import COUNT, distinct_count, multi_range_frame_aggs
    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        k = 0 if i % 3 else rnd.randint(1, 4)                       # key 0 is hot
        t = base + dt.timedelta(hours=rnd.randint(0, 24 * 20))      # many equal instants
        rows.append((i, k, t, rnd.choice(["A", "B", "C", "D", None])))
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, c string")
    L = 3 * 86400
    got = multi_range_frame_aggs(df, ["k"], "ts", {"d": (L, True, distinct_count("c")), "n": (L, True, COUNT)},
                                 bucket_s=4 * 86400).toPandas().set_index("id")
    for i, k, t, _ in rows:
        inside = [r for r in rows if r[1] == k and t - dt.timedelta(seconds=L) <= r[2] <= t]
        assert got.loc[i, "d"] == len({r[3] for r in inside if r[3] is not None}), i
        assert got.loc[i, "n"] == len(inside), i


def test_frame_counts_use_running_sums_not_sliding_frames(spark):
    """Counts and distinct counts over range frames must stay linear: the executed plan
    has no sliding RANGE frame (lower bound = a fixed offset) for them."""
    import re
    from payflow.plans.bindings import Views
    from payflow.plans.features import fraud_features
    from payflow.plans.reports_oltp import attempts
    sliding = re.compile(r"RangeFrame, -\d+")
    v = Views(spark, "/root/testdata/sf0.001")
    counts = count_in_range(attempts(v), ["customer_id", "merchant_id"], "created_at", 6 * 3600, "n")
    assert not sliding.findall(counts._jdf.queryExecution().executedPlan().toString())
    plan = fraud_features(v)._jdf.queryExecution().executedPlan().toString()
    assert not sliding.findall(plan)                # sums too (the 30-day average)


def test_running_sums_equal_a_window(spark):
    import random

    from payflow.operators.ranks import dense_key, global_running_sums
    r = random.Random(4)
    rows = [(x / 7, r.randint(0, 9)) for x in r.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "x double, n long")
    got = {t.x: (t.run, t.total) for t in global_running_sums(df, [F.col("x").desc()], {"n": ("run", "total")}, 7).collect()}
    total = run = 0
    total = sum(n for _, n in rows)
    for x, n in sorted(rows, reverse=True):
        run += n
        assert got[x] == (run, total)
    assert dict(dense_key(df, ["x"], "k").dtypes)["k"] == "bigint"       # keys do not wrap past 2^31


def test_frames_are_whole_across_batches_nulls_and_equal_times(spark, monkeypatch):
    """A group longer than the rows worked on together, equal times at the cut, null keys, times, values and amounts."""
    from payflow.operators import windows as W
    monkeypatch.setattr(W, "FRAME_ROWS", 7)
    rnd = random.Random(9)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice(["a", "a", "a", "b", None]), None if i % 37 == 0 else base + dt.timedelta(hours=rnd.randint(0, 150)),
             rnd.choice(["x", "y", "z", None]), None if i % 11 == 0 else Decimal(rnd.randint(-10**13, 10**13)) / 100) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, c string, amt decimal(16,2)").coalesce(1)
    frames = {"n1": (3600, False, W.COUNT), "n9": (9 * 3600, True, W.COUNT), "s": (30 * 3600, True, W.frame_sum("amt")),
              "d": (20 * 3600, True, W.distinct_count("c"))}
    out = W.multi_range_frame_aggs(df, ["k"], "ts", frames, bucket_s=60 * 3600, peer_order="id")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()          # one pass, no copies of the rows as events
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, k, t, _, _ in rows:
        def inside(hours, now=True, k=k, t=t):
            return [r for r in rows if t and r[1] == k and r[2] and t - dt.timedelta(hours=hours) <= r[2] and (r[2] <= t if now else r[2] < t)]
        peers = sum(r[1] == k and r[2] == t and r[0] <= i for r in rows)
        g = got[i]
        assert (g.n1, g.n9, g.s, g.d, g._peer_rn) == (
            len(inside(1, False)), len(inside(9)), sum((r[4] or 0 for r in inside(30)), Decimal(0)),
            len({r[3] for r in inside(20)} - {None}), peers), i
