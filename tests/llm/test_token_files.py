import numpy as np

from payflow.llm import token_files as T


def test_scan_stitches_blocks(spark, tmp):
    r = np.random.default_rng(1)
    want = set()
    import os
    os.makedirs(f"{tmp}/f")
    for k, n in enumerate((0, 1, 7, 1000, 4096, 5003)):
        ids = r.integers(0, 5, n).astype("<u2")
        if k == 4:
            ids[:] = 1                                               # no separator in a whole file
        if k == 3:
            ids[-1] = 0
        ids.tofile(f"{tmp}/f/x{k}.u16")
        start = ordinal = 0
        for end in np.flatnonzero(ids == 0):
            want.add((f"x{k}.u16", ordinal, start, int(end) - start, True))
            start, ordinal = int(end) + 1, ordinal + 1
        if start < n:
            want.add((f"x{k}.u16", ordinal, start, n - start, False))
    for block in (1, 13, 1 << 20):
        got = T.scan(spark, f"file://{tmp}/f", end_id=0, block_tokens=block)
        rows = [tuple(x) for x in got.select("file", "ordinal", "start", "n_tokens", "terminated").collect()]
        assert len(rows) == len(want) and set(rows) == want


def test_counts_equal_the_tokenizer(docs_of, prose, odd):
    docs = odd + [(20 + i, prose(3 ** i, i)) for i in range(8)] + [(40, "<|endoftext|> is text")]
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in T.document_token_counts(docs_of(docs)).collect()), key=str)
    encode = T.encoding(None).encode_ordinary
    assert got == sorted(((d, len(encode(t or ""))) for d, t in docs), key=str)
    assert T.document_token_counts(docs_of([])).count() == 0
