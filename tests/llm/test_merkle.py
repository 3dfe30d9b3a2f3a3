import hashlib
import random
from collections import Counter

from payflow.llm import merkle


def plain_leaves(text):
    """The chunks of a text by the stated rule, byte by byte, as a list of byte strings."""
    data, out, start, blank = text.encode(), [], 0, -1
    at = lambda i: data[i] if i >= 0 else 0
    for i, c in enumerate(data):
        mix3 = at(i - 1) * 2654435761 + at(i - 2) * 40503 + at(i - 3) * 10007
        if c in b"\t\n\x0b\x0c\r ":
            blank = i
            if c == 10 or (mix3 % 2**32 >> 13) & 1 == 0:
                out.append(data[start:i])
                start = i + 1
        elif i - blank > 24 and ((mix3 + at(i - 4) * 73856093) % 2**32 >> 13) & 31 == 0:
            out.append(data[start:i])
            start = i
    out.append(data[start:])
    return [c[k:k + 512] for c in out for k in range(0, len(c), 512)]      # empty chunks give none


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = Counter(plain_leaves(a)), Counter(plain_leaves(b))
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 1.0


def plain_fingerprint(text):
    """Root and sections from paragraphs by plain lists."""
    paragraphs = text.encode().split(b"\n")
    sections, own = [], []
    for k, p in enumerate(paragraphs):
        own.append(p)
        if k == len(paragraphs) - 1 or p == b"" or hashlib.sha256(p).digest()[0] < 16:
            sections.append(own)
            own = []
    digest = lambda ps: hashlib.sha256(b"".join(hashlib.sha256(p).digest() for p in ps))
    root = hashlib.sha256(b"".join(digest(ps).digest() for ps in sections)).hexdigest()[:32]
    return root, [(digest(ps).hexdigest()[:8], len(ps)) for ps in sections]


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t in order]
    out = []
    for i, (doc, _) in enumerate(order):
        text, after = texts[i], texts[(i + 1) % len(order)]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_fingerprint(text), plain_fingerprint(edited),
                    round(plain_likeness(text, edited), 9), round(plain_likeness(text, after), 9)))
    return sorted(out, key=repr)


def shape(fingerprint):
    root, sections = merkle.parse(fingerprint)
    return root, [(d, len(ps)) for d, ps in sections]


def run(docs, ranges):
    got = merkle.edited_fingerprints(docs, ranges).drop("edited_paragraph").collect()
    return sorted(((*r[:3], shape(r[3]), shape(r[4]), round(r[5], 9), round(r[6], 9)) for r in got), key=repr)


def test_equals_brute_force_over_any_ranges(docs_of, prose, odd):
    rows = odd + [(100 + 3 * i, prose(5 + 40 * (i % 7), i)) for i in range(60)] + [(5000, prose(20_000, 1)), (-4, "minus\nlines\n\nhere"),
                   (6000, "漢字かな交じり文" * 90 + "終"), (6001, "x=1;" * 300), (6002, "a" * 3000), (6003, prose(80, 3).replace(" ", "\t"))]
    want = brute(rows)
    for ranges in (2, 7, 64):
        assert run(docs_of(rows), ranges) == want


def test_single_and_empty(docs_of):
    (r,) = merkle.edited_fingerprints(docs_of([(1, "ab cd")])).collect()
    assert (r["near_next"], r["edited_sha256"]) == (1.0, hashlib.sha256(b"ab ab").hexdigest())
    assert merkle.edited_fingerprints(docs_of([])).count() == 0


def test_roots_and_branches(prose):
    lines = [prose(12, i) for i in range(80)]
    a = str(merkle.Tree("\n".join(lines)))
    changed = lines[:50] + [prose(12, 999)] + lines[51:]
    b = str(merkle.Tree("\n".join(changed)))
    assert a == str(merkle.Tree("\n".join(lines))) and merkle.likeness(a, a) == 1.0
    assert a.split(":")[0] != b.split(":")[0] and 0.9 < merkle.likeness(a, b) < 1
    assert merkle.first_difference(merkle.parse(a), merkle.parse(b)) == 50
    assert merkle.first_difference(merkle.parse(a), merkle.parse(a)) is None
    moved = {d for d, _ in merkle.parse(a)[1]} & {d for d, _ in merkle.parse(b)[1]}
    assert len(moved) >= len(merkle.parse(a)[1]) - 2                  # only sections near the edit differ
    assert merkle.likeness(str(merkle.Tree("")), str(merkle.Tree(""))) == 1.0


def test_one_rule_at_every_length(docs_of, prose):
    for seed in range(15):
        for n in (60, 120, 240, 480):
            text = prose(100, seed)[:n]
            cut = text[:n * 5 // 6].rsplit(" ", 1)[0]                     # the same without its last words
            assert merkle.likeness(str(merkle.Tree(text)), str(merkle.Tree(cut))) > (0.5 if n > 100 else 0.25)
        long, shorter = prose(60, seed)[:300], prose(60, seed + 50)[:40]
        rows = merkle.edited_fingerprints(docs_of([(2, long), (1, shorter)]), 2).collect()
        (r,) = [r for r in rows if r["doc_id"] == 2]                  # the edited text has 190 bytes
        assert r["near_edited"] > 0.3


def test_texts_without_blanks(docs_of, prose):
    like = lambda a, b: merkle.likeness(str(merkle.Tree(a)), str(merkle.Tree(b)))
    r = random.Random(2)
    chinese = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(3000))
    other = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(3000))
    tabs = prose(500, 1).replace(" ", "\t")
    code = "".join(f"var a{r.randrange(999)}={r.randrange(999)};".replace(" ", "_") for _ in range(300))
    for text in (chinese, tabs, code):
        assert like(text, "z" + text) > 0.9 and like(text, text[:700] + "q" + text[700:]) > 0.9
    assert like(chinese, other) < 0.05
    rows = merkle.edited_fingerprints(docs_of([(9, chinese), (8, other), (7, tabs), (6, prose(500, 2).replace(" ", "\t"))])).collect()
    assert all(0.4 < x["near_edited"] < 0.6 for x in rows)


def test_long_unrelated_texts_share_nothing(docs_of):
    import random
    words = lambda seed: " ".join("".join(c) for c in zip(*[iter(random.Random(seed).choices("abcdefghijklmnop", k=400_000))] * 8))
    a, b = words(1), words(2)
    assert merkle.likeness(str(merkle.Tree(a)), str(merkle.Tree(b))) < 0.001
    rows = merkle.edited_fingerprints(docs_of([(2, a), (1, b)]), 2).collect()
    assert {round(r["near_next"], 3) for r in rows} == {0.0} and all(0.49 < r["near_edited"] < 0.51 for r in rows)


def test_first_difference_sees_blanks(docs_of):
    lines = ["one two", "three  four", "five six"]
    (r,) = [r for r in merkle.edited_fingerprints(docs_of([(2, "\n".join(lines)), (1, "x")])).collect() if r["doc_id"] == 2]
    assert r["edited_paragraph"] == 1
    a, b = (merkle.Tree("\n".join(x)) for x in (lines, [lines[0], "three four", lines[2]]))
    assert merkle.first_difference((a.root, a.digests), (b.root, b.digests)) == 1
