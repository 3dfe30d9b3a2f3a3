"""The pipeline against its stages computed by plain Python on a small corpus, and the entry's guard."""

import sys

import numpy as np

SF = "/root/testdata/sf0.001"


def test_run_equals_stages_by_brute_force(spark):
    import corpus_pipeline
    from payflow.llm import decontaminate, packing, quality, simhash, toxicity
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    left = [r for r in rows if r[0] in good]
    scorer = toxicity.train(docs.where(docs["doc_id"].isin([i for i, _ in left])), labels)
    left = [r for r, s in zip(left, scorer([t for _, t in left])) if s < 0.5]
    prints = np.array([simhash.fingerprint(t) for _, t in left], dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.array([i for i, _ in left])
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    left = [r for r, own in zip(left, label) if r[0] == own]
    folded = [decontaminate.folded(t) for _, t in items]
    left = [r for r in left if not any(f in decontaminate.folded(r[1]) for f in folded)]
    encode = packing.encoder(None).encode
    want = {i: len(encode(t)) // 4 + 1 for i, t in left}
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == want
    assert len(want) < len(rows)


def test_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema, name


def _folder(spark, path, docs, labels, items):
    """Tables of a small corpus, with extra columns whose names the operators use."""
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, 0.5) for i, t in docs],
                          "doc_id long, text string, lang string, source string, n_chars long, fp string, y int, score double"
                          ).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows_through_all_stages(spark, tmp_path, prose, odd):
    import corpus_pipeline
    passage = prose(40, 900)
    docs = odd + [(100 + i, prose(30 + i, i)) for i in range(40)] + [(300, prose(30, 1)), (300, prose(30, 1)), (301, prose(9_000, 77)),
                                                                     (302, prose(20, 5) + " " + passage), (None, None), (303, None)]
    sf = _folder(spark, tmp_path, docs, [], [(1, passage), (None, None), (2, "")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = spark.read.parquet(f"{sf}/documents.parquet")
        assert stage(spark, own, sf).schema == own.schema, name
    got = corpus_pipeline.run(spark, sf).toPandas()
    kept = set(got["doc_id"].dropna().astype(int))
    assert {100 + i for i in range(40) if i != 1} <= kept and 301 in kept and 302 not in kept
    assert len(kept & {101, 300}) >= 1 and (got[got["doc_id"] == 300].groupby("start").size() == 1).all()
    whole = got.groupby("doc_id")["length"].sum()
    assert (whole == got.drop_duplicates("doc_id").set_index("doc_id")["doc_tokens"].loc[whole.index]).all()
    empty = [d for d, t in docs if d is not None and not (t or "").split()]
    assert len(kept & set(empty)) == 1                                # empty texts are near duplicates of each other


def test_empty_tables_through_all_stages(spark, tmp_path, prose):
    import corpus_pipeline
    none = _folder(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, none).count() == 0
    few = [(i, prose(40, i)) for i in range(12)]
    bare = _folder(spark, tmp_path / "bare", few, [], [])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, bare).collect()} == set(range(12))
    only = _folder(spark, tmp_path / "only", [], [(1, 1, 0), (2, 0, 1)], [(1, prose(30, 3))])
    assert corpus_pipeline.run(spark, only).count() == 0


def test_entry_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry
    assert "op8_simhash" in entry.queries() and "pipeline" in entry.queries() and "op5_licenses" in entry.oracle_sql()
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("payflow.llm")]:
        monkeypatch.delitem(sys.modules, name)
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "payflow.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    assert not [q for q in entry.queries() if q.startswith("op")] and "pipeline" not in entry.queries()
