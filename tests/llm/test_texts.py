import random
from collections import Counter

import numpy as np
import pytest

from kredenz.llm.html_text import extract, main_text
from kredenz.llm.toxicity import Chain, chain, fit, held_out, score_toxicity, toxicity
from tests.llm.fixtures import documents, words

ARTICLE = "<article><h1>Title here</h1><p>First   paragraph\nof some length, &amp; more.<br>Line <b>two</b>.<p>Sh is.</article>"
WANT = "Title here First paragraph of some length, & more. Line two. Sh is."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><a href=x>Menu entry</a></nav>{ARTICLE}<footer>&copy; host</footer></body></html>",
        f"<body><header><h1>Site</h1></header><div class='ad'>Buy now</div>{ARTICLE}<aside>Side text here</aside>",
        f"<BODY><script>var t='</p><p>no';</script><style>p{{}}</style>{ARTICLE}<form>Name <input></form>",
        f"<body><div id=cookie-notice>We use cookies, many of them indeed, and more text still.</div><div id=main>{ARTICLE}</div>",
        f"<body>{ARTICLE}<section class='comments'><article class=comment><p>I disagree strongly with this one.</p></article></section>",
        f"<body><div class='content with-sidebar'>{ARTICLE}</div><div class=sidebar><ul><li><a>One</a><li><a>Two</a></ul></div>",
        f"{ARTICLE}",
        f"<!-- <p>no</p> --><!DOCTYPE html>{ARTICLE}<!-- unclosed <p>no",
    ],
)
def test_article_alone(page):
    assert main_text(page) == WANT


def test_pages_without_article():
    assert main_text(None) == main_text("") == main_text("<body><nav>x</nav></body>") == main_text("<p></p>") == ""
    assert main_text("just  text\n&lt;b&gt;") == "just text <b>"
    assert main_text("<p>a < b and c</p><p>unclosed <i>x") == "a < b and c unclosed x"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    long = "word " * 100_000
    assert main_text(f"<body><article><p>{long}</p><p>end</article>") == " ".join(long.split()) + " end"


STORY = "<p>The first sentence of the story is long enough to count, with some words.</p><p>The second one follows, and a third.</p>"
TOLD = "The first sentence of the story is long enough to count, with some words. The second one follows, and a third."


@pytest.mark.parametrize(
    "inner",
    [
        f'<div class="layout has-sidebar">{STORY}</div>',
        f'<div class="layout has-sidebar"><div class="sidebar"><a href=x>One</a> two</div>{STORY}</div>',
        f'<div class="post with-comments">{STORY}</div>',
        f'<div id="research share-story">{STORY}</div>',
        f'<div class="no-js-overlay content">{STORY}</div>',
        f"<form><article>{STORY}</article></form>",
        f"<form>{STORY}</form>",
        f'<main><div class="comments">{STORY}</div></main>',
        f"<article>{STORY}</article><div class=comments>" + "<p>A reader says a lot about all of it, and more.</p>" * 9 + "</div>",
        f"<article>{STORY}</article><article class=comment>{STORY}</article>",
    ],
)
def test_names_weigh_and_do_not_decide(inner):
    page = f"<html><body><nav><a href=x>Home</a><a href=y>News</a></nav>{inner}<footer>All rights kept</footer></body></html>"
    assert main_text(page) == TOLD


def test_articles_beside_each_other():
    assert main_text(f"<body><article>{STORY}</article><article>{STORY}</article><div class=ad>Buy</div>") == f"{TOLD} {TOLD}"


@pytest.mark.parametrize("unit", ["<a ", '<a x="', "<a x='", "<!", "<b>", "</x>", "<li>", "<body>", "<p><b>", "<a \"<a '>\" ", '<a x="b>" ', "<", "<form>"])
@pytest.mark.parametrize("end", ["", ">", "\">"])
def test_time_is_in_proportion_to_the_page(unit, end):
    import time

    def seconds(n):
        began = time.process_time()
        main_text((unit * (n // len(unit) + 1))[:n] + end)
        return time.process_time() - began

    assert seconds(200_000) < 4 * max(0.1, seconds(100_000))


def test_extract_keeps_every_page(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", f"<body>{ARTICLE}"), (3, "u", f"<body>{ARTICLE}"), (None, "u", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text")
    got = Counter(map(tuple, extract(table).collect()))
    assert got == Counter([(1, "u", "", 0), (2, None, "", 0), (3, "u", WANT, len(WANT)), (3, "u", WANT, len(WANT)), (None, "u", "x", 1)])
    assert extract(table.limit(0)).count() == 0


def test_extract_of_the_pages_table(spark, folder):
    import html
    import re

    pages = spark.read.parquet(f"{folder}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        text = html.unescape(re.sub(r"<[^>]*>", " ", inner))
        want[r.page_id] = " ".join(text.split())
    got = {r.page_id: " ".join(r.text.split()) for r in extract(pages).collect()}
    assert got == want


def test_chain_equals_a_plain_recursion():
    dice = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 129, 5000):
        m = dice.random((n, 2, 2)) + 0.01
        v, want = np.array([0.5, 0.5]), []
        for x in m:
            v = v @ x
            v = v / v.sum()
            want.append(v)
        assert np.allclose(chain(m), want)


def test_marginals_equal_all_tag_sequences():
    from itertools import product

    dice = np.random.default_rng(2)
    model = Chain(np.zeros(4), 0.0, dice.normal(size=(2, 2)), dice.normal(size=2))
    score, offsets = dice.normal(size=11), np.array([0, 5, 5, 6, 11])
    got = model.marginals(score, offsets)
    for a, z in zip(offsets, offsets[1:]):
        total, toxic = 0.0, np.zeros(z - a)
        for tags in product((0, 1), repeat=int(z - a)):
            if tags:
                w = model.start[tags[0]] + sum(model.moves[x, y] for x, y in zip(tags, tags[1:])) + sum(s for s, t in zip(score[a:z], tags) if t)
                total += np.exp(w)
                toxic += np.exp(w) * np.array(tags)
        if z > a:
            assert np.allclose(got[a:z], toxic / total)


def labelled(spark, n=600):
    dice = random.Random(4)
    bad = ["vile", "rotten", "nasty", "filthy"]
    rows, labels = [], []
    for k in range(n):
        own = words(dice, dice.randint(5, 120))
        toxic = k % 6 == 0
        if toxic:
            for _ in range(dice.randint(1, 4)):
                own.insert(dice.randrange(len(own) + 1), dice.choice(bad) + dice.choice(["", ",", "."]))
        rows.append((k, " ".join(own), "en", "s", 0, 0.0, ""))
        labels += [(k, int(toxic))] * (1 if k % 4 else 2)
    rows += [(n, None, None, None, 0, 0.0, ""), (n + 1, "", None, None, 0, 0.0, ""), (n + 2, "vile " * 50_000, None, None, 0, 0.0, ""), (None, "vile", None, None, 0, 0.0, "")]
    return rows, documents(spark, rows), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")


def test_held_out_documents_are_told_apart(spark):
    rows, docs, labels = labelled(spark)
    got = toxicity(docs, labels)
    found = got.withColumn("held", held_out(got.doc_id)).collect()
    assert len(found) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    tested = [r for r in found if r.held and r.doc_id < 600]
    assert len(tested) > 60
    assert all((r.score >= 0.5) == (r.doc_id % 6 == 0) for r in tested)
    by_id = {r.doc_id: r for r in found}
    assert by_id[602].score >= 0.5 and by_id[None].score >= 0.5 and by_id[600].score == by_id[601].score < 0.5
    for r in tested:
        for s in r.spans:
            assert any(b in texts[r.doc_id][s.start : s.stop] for b in ("vile", "rotten", "nasty", "filthy"))
        assert bool(r.spans) == (r.doc_id % 6 == 0)


def test_labels_of_one_kind_or_none(spark):
    _, docs, labels = labelled(spark, 40)
    for none in (labels.where("toxic = 0"), labels.limit(0)):
        assert {r.score for r in toxicity(docs, none).collect()} == {0.0}
    assert fit([]) is None and score_toxicity(docs.limit(0), None).count() == 0
