"""Fraud model evaluation, policy tables, training, and recommendation inputs.

Curves are computed over the *distinct scores* (probabilities with 4 decimals, so at
most 10 001 points whatever the row count): a partial aggregate per score, then
running sums over that small table. Ties move together, as in the step-function
definition of average precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payflow.operators.ranks import dense_key, global_row_number, global_running_sums, group_row_number
from payflow.operators.similar import similar_vectors
from payflow.operators.tables import stored
from payflow.operators.trees import read_trees, swap_counts
from payflow.plans.bindings import Views
from payflow.plans.features import weighted_score
from payflow.functions import risk_level

FEATURES = ["amount_zscore", "transactions_last_1h", "transactions_last_24h", "avg_amount_30d",
            "distinct_countries_30d", "geo_mismatch", "night_transaction", "velocity_score",
            "device_seen_before", "shared_card_fingerprint", "ip_reputation_score"]


def labeled(feats: DataFrame) -> DataFrame:
    """Rows with a known label: (transaction_id, score, label, risk_level, action)."""
    return (feats.filter(F.col("label.is_fraud").isNotNull())
            .select("transaction_id", F.col("prediction.fraud_probability").alias("score"),
                    F.col("label.is_fraud").alias("label"), F.col("prediction.risk_level").alias("risk_level"),
                    F.col("prediction.action_taken").alias("action")))


def score_table(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Per distinct score (descending): tp, fp at that score and cumulative counts. The running
    sums are distributed, so the number of distinct scores is not limited."""
    g = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label)).alias("tp"),
                                                        F.count_if(~F.col(label)).alias("fp"))
    return global_running_sums(g, [F.col("threshold").desc()], {"tp": ("cum_tp", "P"), "fp": ("cum_fp", "N")})


def pr_curve(df: DataFrame) -> DataFrame:
    """Precision and recall at every distinct threshold."""
    t = score_table(df)
    return t.select("threshold", F.col("cum_tp").alias("tp"), F.col("cum_fp").alias("fp"),
                    F.round(F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp")), 6).alias("precision"),
                    F.round(F.col("cum_tp") / F.col("P"), 6).alias("recall"))


def auc_summary(df: DataFrame, min_precision: float = 0.8) -> DataFrame:
    """Average precision (step sum), ROC AUC (ties count one half), recall at precision >= p."""
    t = score_table(df)
    prec = F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    neg_below = F.col("N") - F.col("cum_fp")
    return t.agg(
        F.round(F.sum(F.col("tp") * prec) / F.first("P"), 4).alias("auc_pr"),
        F.round(F.sum(F.col("tp") * (neg_below + F.col("fp") / 2.0)) / (F.first("P") * F.first("N")), 4)
        .alias("auc_roc"),
        F.round(F.coalesce(F.max(F.when(prec >= min_precision, F.col("cum_tp") / F.col("P"))), F.lit(0.0)), 4)
        .alias("recall_at_precision"),
        F.first("P").alias("positives"), F.first("N").alias("negatives"))


def policy_table(df: DataFrame) -> DataFrame:
    """Per action: labeled rows, frauds, precision %."""
    return (df.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("frauds"))
            .withColumn("precision_pct", F.bround(F.col("frauds") * 100.0 / F.col("n"), 1)))


def classification_report(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Confusion counts and precision / recall / F1 at one threshold."""
    pred = F.col("score") >= threshold
    c = df.agg(F.count_if(pred & F.col("label")).alias("tp"), F.count_if(pred & ~F.col("label")).alias("fp"),
               F.count_if(~pred & F.col("label")).alias("fn"), F.count_if(~pred & ~F.col("label")).alias("tn"))
    p = F.col("tp") / (F.col("tp") + F.col("fp"))
    r = F.col("tp") / (F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn", F.lit(threshold).alias("threshold"),
                    F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
                    F.round(2 * p * r / (p + r), 4).alias("f1"))


def champion_challenger(feats: DataFrame) -> DataFrame:
    """The deployed score vs the reference weighted logit on the same labeled rows."""
    flat = feats.select("transaction_id", "features.*", F.col("prediction.fraud_probability").alias("champion"),
                        F.col("label.is_fraud").alias("label"))
    both = flat.withColumn("challenger", weighted_score(flat)).filter(F.col("label").isNotNull())
    hc = lambda c: risk_level(F.col(c)).isin("high", "critical")
    agree = F.round(F.avg((risk_level(F.col("champion")) == risk_level(F.col("challenger"))).cast("double")) * 100, 2)
    names = ("champion", "challenger")
    # one pass over the features for both models
    one = both.agg(F.count(F.lit(1)).alias("labeled"), agree.alias("agreement_pct"),
                   *[F.count_if(hc(n)).alias(f"{n}_flagged") for n in names],
                   *[F.count_if(hc(n) & F.col("label")).alias(f"{n}_frauds") for n in names])
    rows = one.select("labeled", "agreement_pct", F.inline(F.array(*[
        F.struct(F.lit(n).alias("model_version"), F.col(f"{n}_flagged").alias("flagged"),
                 F.col(f"{n}_frauds").alias("flagged_frauds")) for n in names])))
    return rows.withColumn(
        "precision_pct", F.round(F.col("flagged_frauds") * 100.0 / F.col("flagged"), 2))


def training_set(feats: DataFrame) -> DataFrame:
    """Mature labeled rows with their features (the model input)."""
    return (feats.filter(F.col("label.is_fraud").isNotNull())
            .select("transaction_id", "computed_at", "features.*", F.col("label.is_fraud").alias("is_fraud"),
                    F.col("label.source").alias("label_source")))


def training_set_summary(feats: DataFrame) -> DataFrame:
    return (training_set(feats).groupBy("label_source")
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_fraud").alias("frauds")))


def stratified_split(df: DataFrame, label: str, key: str, train_pct: int = 70) -> tuple[DataFrame, DataFrame]:
    """Deterministic stratified split: a hash of the key per class puts ~train_pct % of each
    class in training (no sampling state, reproducible after a recompute)."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.col(label)), F.lit(100))
    return df.filter(bucket < train_pct), df.filter(bucket >= train_pct)


def train_fraud_model(feats: DataFrame, max_iter: int = 200, max_depth: int = 4, step: float = 0.05,
                      subsample: float = 0.9, seed: int = 42):
    """Boosted trees with class weighting (positives weighted by the class ratio)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    ts = training_set(feats)
    data = ts.select("transaction_id", *[F.col(c).cast("double").alias(c) for c in FEATURES],
                     F.col("is_fraud").cast("double").alias("y"))
    train, test = stratified_split(data, "y", "transaction_id")
    ratio = train.agg((F.count_if(F.col("y") == 0) / F.greatest(F.count_if(F.col("y") == 1), F.lit(1)))
                      .alias("r")).scalar()
    train = train.withColumn("w", F.when(F.col("y") == 1, ratio).otherwise(F.lit(1.0)))
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="x", handleInvalid="keep"),
        GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=max_iter, maxDepth=max_depth,
                      stepSize=step, subsamplingRate=subsample, seed=seed)])
    model = pipe.fit(train)
    return model, test


def model_evaluation(feats: DataFrame, max_iter: int = 200, key: str = "default") -> DataFrame:
    """Train, score the held-out rows, and report AUC-PR / AUC-ROC / recall at P >= 0.8."""
    from pyspark.ml.functions import vector_to_array
    model, test = fitted_model(feats, key, max_iter)
    scored = model.transform(test).select(
        vector_to_array("probability")[1].alias("score"), (F.col("y") == 1).alias("label"))
    return auc_summary(scored)


def feature_importance(feats: DataFrame, max_iter: int = 200, key: str = "default") -> DataFrame:
    """Global importance of each feature from the fitted ensemble (gain based; a
    re-aim of per-row SHAP values, which need a tree-explainer library). Permutation importance of
    any scorer: ``permutation_importance``."""
    model, _ = fitted_model(feats, key, max_iter)
    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = feats.sparkSession
    return spark.createDataFrame(list(zip(FEATURES, [float(x) for x in imp])), "feature string, importance double")


def shuffle_key(id_col: Column, repeat: int, seed: int = 1) -> Column:
    """Order of the rows in one permutation: the id times an odd number of its own, modulo 2^32."""
    return F.pmod(id_col * F.lit(2_654_435_761 + 2 * (104_729 * repeat + 15_485_863 * seed)), F.lit(2**32))


def grouped_auc(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc): ROC AUC per group, ties counting one half, from counts per distinct score (with 4 decimals
    at most 10 001 a group, whatever the number of rows)."""
    return counted_auc(rows.groupBy(*by, "score").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n")), by)


def counted_auc(hist: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc) from rows (by, score, p, n), one per distinct score."""
    below = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    return hist.groupBy(*by).agg((F.sum(F.col("p") * (2 * F.col("below") + F.col("n"))) / (2 * F.sum("p") * F.sum("n"))).alias("auc"))


def permutation_importance(rows: DataFrame, features: list[str], score: Callable[[DataFrame], DataFrame] | None, key: str = "transaction_id",
                           label: str = "label", repeats: int = 3, seed: int = 1,
                           counts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """How much the ROC AUC of ``score`` (adds a column ``score``, rounded here to 4 decimals) falls when one
    feature's values are dealt out anew among the rows: (feature, base_auc, mean_drop, spread over the repeats).

    All permutations are made in one pass: rows are numbered by ``key`` once and in an order of its own for every repeat;
    row and donor meet on equal numbers, and each feature in turn is taken from the donor. The numbering
    splits its groups over tasks, so no column is gathered.

    A scorer that knows which part of its score a feature changes can give ``counts`` in place of ``score``: from each row
    with its donor of repeat ``_r`` (``_new_`` and the feature's name), rows (_f, _r, score, p, n) for all features at once."""
    base = stored(global_row_number(rows.select(key, label, *features), [key], "_at"), "permutation-rows")
    deals = F.array(*[F.struct(F.lit(r).alias("_r"), shuffle_key(F.col(key), r, seed).alias("_h")) for r in range(repeats)])
    dealt = base.select(key, *[F.col(f).alias(f"_new_{f}") for f in features], F.explode(deals).alias("d")).select("*", "d.*").drop("d")
    dealt = group_row_number(dealt, ["_r"], ["_h", key], "_at").drop(key, "_h")
    pairs = base.join(dealt, "_at")
    if counts:
        hist = counts(pairs.select("_r", F.col(label).alias("label"), *features, *[f"_new_{f}" for f in features]))
        auc = counted_auc(hist.groupBy("_f", "_r", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), ["_f", "_r"])
    else:
        which = F.explode(F.array(*[F.lit(i) for i in range(len(features))])).alias("_f")
        swapped = pairs.select("*", which).withColumns({
            f: F.when(F.col("_f") == i, F.col(f"_new_{f}")).otherwise(F.col(f)) for i, f in enumerate(features)})
        every = score(base.withColumns({"_f": F.lit(-1), "_r": F.lit(0)}).select("_f", "_r", label, *features)
                      .unionByName(swapped.select("_f", "_r", label, *features)))
        auc = grouped_auc(every.select("_f", "_r", F.round("score", 4).alias("score"), F.col(label).alias("label")), ["_f", "_r"])
    auc = stored(auc, "permutation-auc")                                # features x repeats rows
    names = F.array(*[F.lit(f) for f in features])
    drop = F.col("base_auc") - F.col("auc")
    return (auc.filter("_f >= 0").withColumn("base_auc", auc.filter("_f < 0").select("auc").scalar())
            .groupBy(F.element_at(names, F.col("_f") + 1).alias("feature"))
            .agg(F.round(F.first("base_auc"), 6).alias("base_auc"), F.round(F.avg(drop), 6).alias("mean_drop"),
                 F.round(F.stddev_samp(drop), 6).alias("spread")))


def reference_importance(feats: DataFrame) -> DataFrame:
    """Permutation importance of the reference weighted score on the labelled rows."""
    rows = feats.filter(F.col("label.is_fraud").isNotNull()).select("transaction_id", "features.*", F.col("label.is_fraud").alias("label"))
    return permutation_importance(rows, FEATURES, lambda df: df.withColumn("score", weighted_score(df)))


def model_importance(feats: DataFrame, max_iter: int = 200, key: str = "default", repeats: int = 3) -> DataFrame:
    """Permutation importance of the fitted ensemble on its held-out rows. A row is scored from its
    own and its donor's values for all features at once, and only the trees that use a feature are looked up anew."""
    model, test = fitted_model(feats, key, max_iter)
    rows = test.withColumn("label", F.col("y") == 1)
    return permutation_importance(rows, FEATURES, None, repeats=repeats, counts=lambda pairs: tree_counts(model.stages[-1], pairs, FEATURES))


def tree_counts(ensemble, pairs: DataFrame, features: list[str]) -> DataFrame:
    """``counts`` of ``permutation_importance`` for a binary boosted ensemble over ``features`` in this order (nulls as NaN)."""
    sides = [F.col(f"{prefix}{f}").cast("double").alias(f"_{kind}_{i}")
             for kind, prefix in (("own", ""), ("new", "_new_")) for i, f in enumerate(features)]
    run = swap_counts(read_trees(ensemble.toDebugString), len(features))
    return (pairs.filter(F.col("label").isNotNull()).select("_r", "label", *sides)
            .mapInArrow(run, "_f int, _r int, score double, p long, n long"))


# ----------------------------------------------------------------------------- recommendation inputs
def interaction_matrix(v: Views) -> DataFrame:
    """Customer x payment type, weighted by conversion and amount."""
    t = v.tx.join(v.payment_methods.select("payment_method_id", "type"), "payment_method_id")
    ok = F.col("status") == "succeeded"
    g = (t.groupBy("customer_id", "type")
         .agg(F.count(F.lit(1)).alias("payments"), F.count_if(ok).alias("conversions"),
              F.sum(F.when(ok, F.col("amount")).otherwise(0)).alias("_amt")))
    return (g.withColumn("succeeded_amount", F.col("_amt").cast("double"))
            .withColumn("weight", F.round(F.col("conversions") / F.col("payments")
                                          * F.log1p(F.col("_amt").cast("double")), 6)).drop("_amt"))


def recommend_methods(v: Views, k: int = 3, rank: int = 2, seed: int = 7) -> DataFrame:
    """Implicit-feedback ALS on the interaction matrix; top-k payment types per customer. Customers
    that ALS gives none (no payments) get their market segment's types, most converted first, or
    all customers' types where the segment has no payments.

    ALS takes 32-bit ids only, so customers are numbered densely for it; more than 2^31 - 1
    customers with payments fail instead of wrapping."""
    im = interaction_matrix(v).filter(F.col("customer_id").isNotNull())
    types = F.array(*[F.lit(t) for t in ("card", "bank_transfer", "wallet")])
    im = im.withColumn("item", F.array_position(types, F.col("type")).cast("int"))
    # the factor rank cannot exceed the number of items (3 payment types), or the
    # per-user normal equations become singular
    if rank > 3:
        raise ValueError(f"rank {rank}: there are only 3 payment types")
    model, users = _factors(im, rank, seed)
    recs = (model.recommendForAllUsers(k).join(users, "user")
            .select("customer_id", F.transform("recommendations", lambda r: F.element_at(types, r["item"])).alias("methods")))
    everyone = v.customers.select("customer_id", "market_segment")
    seen = im.join(everyone, "customer_id", "left")
    return (everyone.select("customer_id").union(users.select("customer_id")).distinct()
            .join(everyone, "customer_id", "left").join(recs, "customer_id", "left")
            .join(F.broadcast(_most_converted(seen, ["market_segment"], "_segment", k)), "market_segment", "left")   # one row per segment
            .crossJoin(F.broadcast(_most_converted(seen, [], "_all", k)))
            .select("customer_id", F.coalesce("methods", "_segment", "_all").alias("methods")))


def _factors(im: DataFrame, rank: int, seed: int):
    """(ALS model, customers' dense numbers) on the interaction matrix with its column ``item``."""
    from pyspark.ml.recommendation import ALS
    number = F.when(F.col("_n") < 2**31, F.col("_n").cast("int")).otherwise(
        F.raise_error(F.lit("more customers than ALS has ids")).cast("int"))
    users = dense_key(im.select("customer_id").distinct(), ["customer_id"], "_n").select("customer_id", number.alias("user"))
    als = ALS(userCol="user", itemCol="item", ratingCol="weight", implicitPrefs=True,
              rank=rank, regParam=0.1, maxIter=10, seed=seed, coldStartStrategy="drop")
    return als.fit(im.join(users, "customer_id")), users


def _most_converted(seen: DataFrame, by: list[str], name: str, k: int) -> DataFrame:
    """The k types with most conversions per group, ties by name."""
    g = seen.groupBy(*by, "type").agg(F.sum("conversions").alias("_c"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("_c")).alias("_c"), "type")))     # at most three types
    return g.groupBy(*by).agg(F.slice(order["type"], 1, k).alias(name))


def _merchant_segments(v: Views) -> DataFrame:
    """Every merchant with every market segment of the customers (a handful of names)."""
    names = v.customers.filter("market_segment IS NOT NULL").agg(F.array_sort(F.collect_set("market_segment"))).scalar()
    return v.merchants.select("merchant_id", F.explode(names).alias("market_segment"))


def _merchant_payments(v: Views) -> DataFrame:
    return (v.tx.join(v.payment_methods.select("payment_method_id", "type"), "payment_method_id")
            .join(v.customers.select("customer_id", "market_segment"), "customer_id")
            .select("merchant_id", "market_segment", "customer_id", "type", (F.col("status") == "succeeded").cast("long").alias("conversions")))


def merchant_segment_fallback(v: Views, k: int = 3) -> DataFrame:
    """The payment types a (merchant, segment) gets without factors: its own most converted ones, else the
    merchant's, else the segment's, else everyone's; ``source`` says which."""
    seen = _merchant_payments(v)
    out = (_merchant_segments(v)
           .join(_most_converted(seen, ["merchant_id", "market_segment"], "_pair", k), ["merchant_id", "market_segment"], "left")
           .join(_most_converted(seen, ["merchant_id"], "_merchant", k), "merchant_id", "left")
           .join(F.broadcast(_most_converted(seen, ["market_segment"], "_segment", k)), "market_segment", "left")
           .crossJoin(F.broadcast(_most_converted(seen, [], "_all", k))))
    source = (F.when(F.col("_pair").isNotNull(), "pair").when(F.col("_merchant").isNotNull(), "merchant")
              .when(F.col("_segment").isNotNull(), "segment").otherwise("all"))
    return out.select("merchant_id", "market_segment", F.coalesce("_pair", "_merchant", "_segment", "_all").alias("methods"),
                      source.alias("source"))


def recommend_by_merchant_segment(v: Views, k: int = 3, rank: int = 2, seed: int = 7) -> DataFrame:
    """Top-k payment types of every merchant x market segment. The factor vectors of the segment's customers who
    paid the merchant are averaged (each customer once) and types ranked by their dot product with the
    average; a pair without such customers takes ``merchant_segment_fallback``. ``source`` is factors or the fallback's."""
    types = ["card", "bank_transfer", "wallet"]
    im = interaction_matrix(v).filter(F.col("customer_id").isNotNull())
    im = im.withColumn("item", F.array_position(F.array(*[F.lit(t) for t in types]), F.col("type")).cast("int"))
    model, users = _factors(im, rank, seed)
    factors = model.userFactors.join(users, F.col("id") == F.col("user")).select("customer_id", "features")
    pairs = _merchant_payments(v).select("merchant_id", "market_segment", "customer_id").distinct()
    mean = (pairs.join(factors, "customer_id").groupBy("merchant_id", "market_segment")
            .agg(F.array(*[F.avg(F.col("features")[i].cast("double")) for i in range(rank)]).alias("mean")))
    items = {r["id"]: r["features"] for r in model.itemFactors.collect()}            # at most three payment types
    scored = F.array(*[F.struct((-sum((F.col("mean")[i] * F.lit(float(x)) for i, x in enumerate(f)), F.lit(0.0))).alias("s"),
                                F.lit(types[item - 1]).alias("type")) for item, f in sorted(items.items())])
    best = mean.select("merchant_id", "market_segment", F.slice(F.array_sort(scored)["type"], 1, k).alias("_own"))
    return (merchant_segment_fallback(v, k).join(best, ["merchant_id", "market_segment"], "left")
            .select("merchant_id", "market_segment", F.coalesce("_own", "methods").alias("methods"),
                    F.when(F.col("_own").isNotNull(), "factors").otherwise(F.col("source")).alias("source")))


def joined_methods(df: DataFrame) -> DataFrame:
    return df.withColumn("methods", F.array_join("methods", ","))


def canary_assignment(v: Views, pct: int = 5) -> DataFrame:
    """Deterministic canary arm per merchant: multiplicative hash of the id mod 100."""
    h = (F.col("merchant_id") * F.lit(2654435761) % F.lit(4294967296)) % 100
    return v.merchants.select("merchant_id", h.alias("bucket"),
                              F.when(h < pct, "canary").otherwise("control").alias("arm"))


def recommendation_uplift(v: Views) -> DataFrame:
    """Conversion of payments whose customer saw recommendations (arm B, by hash of
    the customer) vs not (arm A), per merchant."""
    t = v.tx
    arm = F.when((F.col("customer_id") * F.lit(2654435761) % F.lit(4294967296)) % 2 == 0, "A").otherwise("B")
    g = t.groupBy("merchant_id").agg(
        F.count_if(arm == "A").alias("n_a"), F.count_if((arm == "A") & (F.col("status") == "succeeded")).alias("conv_a"),
        F.count_if(arm == "B").alias("n_b"), F.count_if((arm == "B") & (F.col("status") == "succeeded")).alias("conv_b"))
    ra = F.col("conv_a") / F.col("n_a")
    rb = F.col("conv_b") / F.col("n_b")
    return g.select("merchant_id", "n_a", "conv_a", "n_b", "conv_b", F.round(ra * 100, 3).alias("rate_a_pct"),
                    F.round(rb * 100, 3).alias("rate_b_pct"), F.round((rb - ra) * 100, 3).alias("uplift_pts"))


# ----------------------------------------------------------------------------- N12 cache, N18, N23
_models: dict = {}
MODELS_KEPT = 4                        # the oldest goes when another is fitted


def fitted_model(feats: DataFrame, key: str, max_iter: int = 200):
    """One fit per (application, input) shared by evaluation and importance."""
    k = (feats.sparkSession.sparkContext.applicationId, key, max_iter)
    if k not in _models:
        while len(_models) >= MODELS_KEPT:
            _models.pop(next(iter(_models)))
        _models[k] = train_fraud_model(feats, max_iter=max_iter)
    return _models[k]


def feature_skew(offline: DataFrame, online: DataFrame, key: str, cols: list[str], tol: float = 0.001) -> DataFrame:
    """Per feature, share of rows whose online value differs from the offline one by
    more than ``tol`` (relative); the target is < 0.1 %."""
    j = offline.select(key, *[F.col(c).cast("double").alias(f"off_{c}") for c in cols]) \
        .join(online.select(key, *[F.col(c).cast("double").alias(f"on_{c}") for c in cols]), key)
    aggs = []
    for c in cols:
        a, b = F.col(f"off_{c}"), F.col(f"on_{c}")
        bad = ~a.eqNullSafe(b) & (F.abs(a - b) > tol * F.greatest(F.abs(a), F.lit(1e-12)))
        aggs.append(F.avg(F.coalesce(bad, F.lit(True)).cast("double")).alias(c))
    agg = j.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("skew_rate")) for c in cols])
    return agg.select(F.inline(arr)).withColumn("ok", F.col("skew_rate") < 0.001)


def similar_embeddings(spark: SparkSession, sf_dir: str, k: int = 5, every: int = 50) -> DataFrame:
    """The k embeddings most similar to each whose id is divisible by ``every``."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = similar_vectors(e, e.filter(F.col("vec_id") % every == 0), k)
    return out.withColumn("cosine", F.round("cosine", 6))
