import re
import zlib
from collections import Counter

import numpy as np
import pytest

from payflow.llm import spelling


def _distance_one(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying all."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def _brute(docs, least=5):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= least}
    rows, form = {}, {}
    for w, n in words.items():
        near = [(-m, o) for o, m in words.items() if _distance_one(w, o)]
        best = min(near, default=None)
        if best and -best[0] >= 5 * n:
            form[w] = best[1]
        rows[w] = [len(near)]
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, rows[w][0], words[form[w]] if w in form else None))
    return sorted(out)


def _got(docs, alphabet=None):
    return sorted(tuple(r) for r in spelling.spelling_variants(docs, alphabet=alphabet).collect())


def _corpus(seed=1):
    r = np.random.default_rng(seed)
    base = ["".join(r.choice(list("abeioérst"), size=r.integers(6, 10))) for _ in range(60)]
    words = []
    for w in base:
        times = int(r.choice([5, 30, 200]))
        words += [w] * times
        for _ in range(3):                                   # variants of variants, of falling counts
            at = int(r.integers(len(w)))
            w = [w[:at] + w[at + 1:], w[:at] + "a" + w[at:], w[:at] + "o" + w[at + 1:]][int(r.integers(3))]
            times = max(1, times // 6)
            words += [w] * times
    r.shuffle(words)
    return [(i, " ".join(words[i * 40:i * 40 + 40]).replace("abe", "AbE")) for i in range(len(words) // 40 + 1)]


@pytest.mark.parametrize("alphabet", [None, 2, 6, 128])
def test_like_all_pairs(docs_of, alphabet):
    docs = _corpus()
    got = _got(docs_of(docs), alphabet)
    assert got == _brute(docs) and any(r[1] for r in got) and any(r[1] and r[2] != r[1] for r in got)


def test_odd_rows(docs_of, odd):
    words = [(None, "Àbcdef-abcdef ×abcdef÷ ABCDEF"), (3, "abcdef1abcdef"), (4, "x" * 30_000)] * 6
    docs = odd + words
    assert _got(docs_of(docs)) == _brute(docs)
    assert _got(docs_of([])) == [] and _got(docs_of([(1, "short wörd")])) == []


def test_damage_by_crc32(docs_of):
    docs = [(i, " ".join(["retionation", "tlandering", "élementées"] * 5)) for i in range(400)]
    got = _got(docs_of(docs))
    assert got == _brute(docs) and len(got) > 3


def test_neighbourhood_is_every_string_one_edit_away():
    word = np.array([[1, 2, 2, 3]], dtype=np.uint64)
    own, letters = tuple(word[0].tolist()), (1, 2, 3)
    every = {own} | {own[:i] + own[i + 1:] for i in range(4)} | {own[:i] + (c,) + own[i + 1:] for i in range(4) for c in letters}
    every |= {own[:i] + (c,) + own[i:] for i in range(5) for c in letters}
    wanted = {int(spelling.reduced_hash(np.array([s], dtype=np.uint64))[0]) for s in every}
    assert set(spelling.neighbourhood(word, 3)[1].tolist()) == wanted and len(wanted) == len(every)


def test_words_with_one_reduced_form_take_a_larger_alphabet(spark):
    # equal under few symbols: the alphabet grows until equal reduced words make few pairs
    r = np.random.default_rng(2)
    words = sorted({"".join(r.choice(list("abcdefgh"), size=6)) for _ in range(3000)})
    vocabulary = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    few, picked = spelling.ALPHABETS[0], spelling.pick_alphabet(vocabulary)
    shared = lambda a: len(words) - len(set(spelling.reduced_hashes(words, a).tolist()))
    assert picked > few and shared(picked) < shared(few) and shared(128) == 0


def test_hub_word_and_long_chain(spark):
    chain = ["abcdef" + "x" * i for i in range(8)]
    hub = [("abcdef"[:i] + c + "abcdef"[i:], 5) for i in range(7) for c in "mnopqrstuvwyz"]
    vocabulary = spark.createDataFrame([(w, 5 ** (9 - i)) for i, w in enumerate(chain)] + sorted(set(hub)), "word string, n long")
    got = {r["word"]: r for r in spelling.group_variants(vocabulary).collect()}
    assert {got[w]["root"] for w in chain} == {"abcdef"} and got["abcdef"]["n_near"] == len(set(hub)) + 1
    assert all(got[w]["form"] == "abcdef" for w, _ in hub)
