import random

from payflow.llm import decontaminate as D


def edits(pattern: bytes, text: bytes) -> int:
    """Least edits of pattern against any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items):
    """(doc, item) pairs with some item window within the budget, by full alignment."""
    out = set()
    for doc, text in docs:
        t = D.folded(text)
        for item, passage in items:
            p = D.folded(passage)
            w = min(D.WINDOW, len(p))
            if p and any(edits(p[s:s + w], t) <= int(D.RATE * w) for s in range(0, len(p) - w + 1, 3)):
                out.add((doc, item))
    return out


def damaged(text, n, seed):
    r, out = random.Random(seed), list(text)
    for _ in range(n):
        k = r.randrange(len(out))
        out[k:k + 1] = r.choice([[], ["q"], [out[k], "z"]])
    return "".join(out)


def cases(prose):
    items = [(i, prose(14 + i, 100 + i)) for i in range(4)] + [(None, prose(20, 300)), (50, ""), (51, None), (52, "...")]
    docs = []
    for k, n in enumerate((0, 0, 2, 4, 6)):
        passage = items[k % 4][1]
        docs.append((60 + k, prose(30, k) + ".\n" + damaged(passage.upper() if k == 1 else passage, n, k) + "! " + prose(25, 50 + k)))
    docs += [(70, prose(200, 7)), (71, items[0][1][:40]), (72, prose(5, 9) + " " + items[3][1][10:110]), (73, prose(3, 1) + items[4][1])]
    return docs, items


def test_equals_full_alignment(spark, docs_of, prose, odd):
    docs, items = cases(prose)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs_of(docs + odd), bench).collect()}
    want = brute(docs, items)
    assert want <= got and {d for d, _ in got} == {d for d, _ in want}
    assert {60, 61, 72, 73} <= {d for d, _ in got} and not {70, 71} & {d for d, _ in got}
    blocks = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs_of(docs), bench, block_bytes=150).collect()}
    assert blocks == got                                              # the benchmark in several blocks


def test_exact_spans(spark, docs_of, prose):
    item = prose(30, 5)
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    rows = D.contaminated(docs_of([(1, prose(9, 2) + " " + item), (1, prose(9, 2) + " " + item), (2, prose(9_000, 3))]), bench).collect()
    assert sorted(r["item_id"] for r in rows) == [1, 1, 2, 2]
    for r in rows:
        assert r["exact"] and r["edits"] == 0 and r["matched_chars"] == r["item_chars"] == r["doc_end"] - r["doc_start"]


def test_filter_keeps_columns_and_clean_rows(spark, docs_of, prose, odd):
    docs, items = cases(prose)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(docs + odd)
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    bad = {d for d, _ in brute(docs, items)}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, _ in docs + odd if d not in bad), key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.drop_contaminated(df, none).count() == df.count() and D.contaminated(df, none).count() == 0
    assert D.contaminated(docs_of([]), bench).count() == 0


def test_items_of_every_length(prose):
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    for n in range(1, 81):
        item = "".join(r.choices(letters, k=n))
        bench = D.Benchmark([(1, item)], D.Q, D.WINDOW, D.RATE)
        budget = bench.budget[0]
        spots = r.sample(range(n), budget)
        edited = "".join("#" if i in spots else c for i, c in enumerate(item)).replace("#", "%s") % tuple(
            r.choice([x for x in letters if x != item[i]]) for i in sorted(spots))
        worse = "".join(chr(ord("A") + i % 26) for i in range(n)).lower()[::-1]
        texts = [f"{prose(8, n)} {item}", f"{prose(8, n)} {edited} {prose(5, n)}", item, prose(8, n) if n > 12 else "...", worse if n > 30 else ""]
        found = [bool(m) for m in D.find(bench, texts)]
        assert found[:3] == [True, True, True] and found[3:] == [False, False], n


def test_runs_and_repeats_need_bounded_hits(monkeypatch):
    monkeypatch.setattr(D, "MOST_HITS", 20_000)
    run, mixed = "a" * 400, "a" * 150 + "bcdefghij" + "a" * 150
    bench = D.Benchmark([(1, run), (2, mixed), (3, "0" * 200)], D.Q, D.WINDOW, D.RATE)
    sizes = []
    bands = D.Benchmark._bands
    monkeypatch.setattr(D.Benchmark, "_bands", lambda self, q, pos, *rest: sizes.append(len(pos)) or bands(self, q, pos, *rest))
    texts = ["x " + "a" * 700 + " y", "a" * 60, "0 " * 1_000, "bcd " + mixed]
    found = [{m[0] for m in own} for own in D.find(bench, texts)]
    assert found[0] == {1, 2} and found[1] == set() and found[2] == set() and found[3] >= {1, 2}
    assert len(sizes) > 4 and max(sizes) < 2 * 97 * 700


def test_slices_find_what_one_slice_finds(prose, monkeypatch):
    docs, items = cases(prose)
    bench = D.Benchmark(items, D.Q, D.WINDOW, D.RATE)
    texts = [t for _, t in docs] * 3
    whole = D.find(bench, texts)
    monkeypatch.setattr(D, "MOST_HITS", 50)
    pairs = lambda found: [{m[0] for m in own} for own in found]
    assert pairs(D.find(bench, texts)) == pairs(whole)
