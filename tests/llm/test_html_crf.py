import itertools
import random

import numpy as np

from payflow.llm import html_crf as H
from payflow.llm.labelled_pages import labelled_pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/x">Home</a></li><li><a href="/y">News</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy this now.</div><article><h1>Caf&eacute;   &lt;b&gt;</h1><p><b>First&nbsp;one.<br><p>Second <a href="#">linked</a>
 text &#x41;.</p><div class="ad">Buy this too.</div><ul><li>point one<li>point two</ul></article>
<section class="comments"><p>Nice story, thanks!</p></section><form><label>Mail</label><button>Send</button></form>
<footer>&copy; site</footer></body></html>"""


def test_main_text_of_a_page():
    assert H.main_text(H.trained(), PAGE) == "Café <b>\nFirst one.\nSecond linked text A.\npoint one\npoint two"


def test_held_out_layouts():
    crf, wrong, total = H.trained(), 0, 0
    for html in labelled_pages(150, first=50_000):
        own = H.blocks(html)
        keep = crf.decode([f for _, f, _ in own])
        wrong += sum(k != (label == "1") for k, (_, _, label) in zip(keep, own))
        total += len(own)
    assert wrong / total < 0.01


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(3)
    names = [f"f{i}" for i in range(6)]
    crf = H.Crf({n: i for i, n in enumerate(names)}, r.normal(size=(6, 2)), r.normal(size=(2, 2)), r.normal(size=(2, 2)))
    for seed in range(20):
        page = [random.Random(seed * 50 + k).sample(names + ["unknown"], 3) for k in range(1 + seed % 7)]

        def score(path):
            s = crf.ends[0][path[0]] + crf.ends[1][path[-1]] + sum(crf.pairs[a][b] for a, b in zip(path, path[1:]))
            return s + sum(crf.of[f][y] for y, own in zip(path, page) for f in own if f in crf.of)

        best = max(itertools.product((0, 1), repeat=len(page)), key=score)
        assert tuple(map(int, crf.decode(page))) == best


def test_odd_pages(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "v", "<p>unclosed <b>tags", "t"), (3, "w", "<div>" * 3000 + "deep", "t"),
            (4, "x", "plain words only", "t"), (4, "x", "plain words only", "t"), (5, "y", "<article><p>" + "word " * 60_000 + "</p></article>", "t"),
            (6, "z", "<!-- never closed <p>x", "t"), (7, "q", "<![CDATA[x]]><p", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(df).toPandas()
    assert len(got) == len(rows) and (got["text"].str.len() == got["n_chars"]).all()
    assert got.set_index("url")["n_chars"][["u", "y"]].tolist() == [0, 5 * 60_000 - 1]
    assert H.extract(df.limit(0)).count() == 0


def test_deep_and_unclosed_pages_cost_their_length():
    import time
    crf = H.trained()
    for html in ("<div>x" * 50_000, "<div>" * 30_000 + "x" + "</span></em></div>" * 30_000, "<center><b>y " * 30_000 + "</i>" * 30_000,
                 "<p>one. two. " * 30_000, "".join(f"<div class=c{i}>x" for i in range(20_000))):
        began = time.process_time()
        H.main_text(crf, html)
        assert time.process_time() - began < 8


def test_digits_are_counted_in_the_whole_block():
    found = lambda text: H.blocks(f"<p>{text}</p>")[0][1]
    assert "many digits" in found("word " * 60 + "123456789 " * 60) and "many digits" not in found("123 " * 40 + "words only here " * 60)


def test_known_features_do_not_change_the_result():
    crf = H.trained()
    for html in H.labelled_pages(30):
        own = H.blocks(html)
        assert H.main_text(crf, html) == "\n".join(t for (t, _, _), k in zip(own, crf.decode([f for _, f, _ in own])) if k)
