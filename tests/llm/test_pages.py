from __future__ import annotations

import html as characters
import itertools
import re

import numpy as np
import pytest

from wardbook.llm import layouts, pages

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model():
    return pages.default_model()


@pytest.fixture(scope="module")
def random_chain():
    rng = np.random.default_rng(3)
    return pages.Model({}, rng.normal(size=(2, 2)), rng.normal(size=(2, 2, 2)))


def chain_score(labels, scores, same, model):
    """The score of one sequence of labels, term by term."""
    total = model.ends[0][labels[0]] + model.ends[1][labels[-1]]
    total += sum(s for s, label in zip(scores, labels, strict=True) if label)
    for t in range(1, len(labels)):
        total += model.steps[same[t]][labels[t - 1]][labels[t]]
    return total


@pytest.mark.parametrize("count", [1, 2, 3, 6, 9])
def test_viterbi_finds_the_best_of_all_sequences(random_chain, count):
    rng = np.random.default_rng(count)
    for _ in range(20):
        scores, same = rng.normal(size=count) * 2, rng.integers(0, 2, count)
        best = max(itertools.product([0, 1], repeat=count), key=lambda y: chain_score(y, scores, same, random_chain))
        assert pages.viterbi(scores, same, random_chain).tolist() == list(best)
    assert pages.viterbi(np.zeros(0), np.zeros(0, int), random_chain).tolist() == []


def test_likelihood_and_gradients_against_all_sequences(random_chain):
    rng = np.random.default_rng(5)
    sizes = np.array([5, 1, 3])
    scores, same = rng.normal(size=(3, 5)), rng.integers(0, 2, (3, 5))
    labels = rng.integers(0, 2, (3, 5)) * (np.arange(5) < sizes[:, None])

    def wanted(scores, ends, steps):
        model = pages.Model({}, ends, steps)
        total = 0
        for k, n in enumerate(sizes):
            every = [chain_score(y, scores[k][:n], same[k], model) for y in itertools.product([0, 1], repeat=int(n))]
            total += chain_score(labels[k][:n], scores[k][:n], same[k], model) - np.log(np.sum(np.exp(every)))
        return total / 3

    value, *slopes = pages.log_likelihood(scores, same, labels, sizes, random_chain.ends, random_chain.steps)
    assert np.isclose(value, wanted(scores, random_chain.ends, random_chain.steps))
    parts = [scores, random_chain.ends, random_chain.steps]
    for which, slope in enumerate(slopes):
        for at in np.ndindex(parts[which].shape):
            moved = [p.copy() for p in parts]
            moved[which][at] += 1e-6
            assert np.isclose(slope[at], (wanted(*moved) - wanted(*parts)) / 1e-6, atol=1e-4)


def test_held_out_layouts(model):
    right = total = 0
    for page in layouts.labelled_pages(200, seed=77):
        wanted = [layouts.MAIN in b.text for b in pages.leaf_blocks(page)]
        _, found = pages.label_blocks(page.replace(layouts.MAIN, "").replace(layouts.OTHER, ""), model, {})
        right += int((found == wanted).sum())
        total += len(wanted)
    assert right / total >= 0.99


def plain_main_text(html):
    """The article of the test tables' pages, read off their only layout."""
    article = re.search("<article>(.*?)</article>", html, re.S)[1]
    blocks = [characters.unescape(re.sub("<[^>]*>", " ", b)) for b in re.split("</?(?:p|h1)>", article)]
    return "\n\n".join(" ".join(b.split()) for b in blocks if b.split())


def test_pages_of_the_test_table(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/pages.parquet").collect()
    found = pages.op11_main_text(spark, small_dir).collect()
    assert sorted((r["page_id"], r["url"], r["text"]) for r in found) == sorted(
        (r["page_id"], r["url"], plain_main_text(r["html"])) for r in rows
    )
    assert all(r["n_chars"] == len(r["text"]) for r in found)


SITE = """<!DOCTYPE html><html><head><title>Site</title><style>p {}</style><script>if (a < b) "<p>no</p>";</script></head>
<body><div class="cookie-banner">We use cookies.</div><header class="site-header"><a href="/">Site</a></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="post-content"><h1>A  headline&nbsp;of
the story</h1><p>Fish &amp; chips &#8212; the <b>first</b> paragraph<br>is here.<div class="ad"><p>Buy this thing, now.</p></div>
<p>The second one, <a href="x">with a link</a>, follows.<!-- <p>not this</p> --><form><p>Sign up for news.</p><button>Go</button></form>
<blockquote>Quoted words are main text, too.</blockquote></div>
<aside class="sidebar"><p>Some other story, teased here.</p></aside>
<section id="comments"><h3>Comments</h3><p>A reader says that this is all wrong.</p></section>
<footer>&copy; Site</footer></body></html>"""

WANTED = [
    "A headline of the story",
    "Fish & chips — the first paragraph is here.",
    "The second one, with a link, follows.",
    "Quoted words are main text, too.",
]


def test_odd_pages(spark, model):
    deep = "<div>" * 5000 + "</span>" * 5000 + "<p>" + "deep words, in a long line. " * 5 + "</p>"
    long = "<article>" + "<p>A sentence of the long page, again.</p>" * 20000 + "</article>"
    rows = [
        (1, "u", SITE),
        (1, "u", SITE),
        (2, None, None),
        (None, "v", ""),
        (3, "", "<p"),
        (4, "w", "<script>never ends"),
        (5, "w", "<article><p>Cut off in the middle of a"),
        (6, "w", deep),
        (7, "w", long),
        (8, "w", "<nav>a</nav><!-- <article><p>Hidden text of some length.</p>"),
        (9, "w", " \t\n "),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", text string, blocks string")
    found = pages.main_text(frame, model).collect()
    assert len(found) == len(rows) and found[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    texts = sorted((str(r["page_id"]), r["url"] or "", r["text"]) for r in found)
    by_id = {i: t for i, _, t in texts}
    assert [t for i, _, t in texts if i == "1"] == ["\n\n".join(WANTED)] * 2
    assert [by_id[i] for i in ("2", "None", "4", "8", "9")] == [""] * 5
    assert by_id["5"] == "Cut off in the middle of a"
    assert by_id["6"].startswith("deep words") and by_id["7"].count("\n\n") == 19999
    assert pages.main_text(spark.createDataFrame([], SCHEMA), model).count() == 0
