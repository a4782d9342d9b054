import html
import random
import re
import time
from collections import Counter

import plain_pages

from coterie.llm import htmltext
from coterie.llm.dom import Page


def article(source):
    """Brute force for pages with one article element of headings and paragraphs."""
    inside = source[source.index("<article>") + 9 : source.index("</article>")]
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<(?:/?p|br|/?h1)[^>]*>", inside)]
    return "\n".join(x for x in lines if x)


def test_table_pages_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = htmltext.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_held_out_generated_pages():
    rng, exact = random.Random(1234), 0
    for _ in range(200):
        before, main, after = htmltext.generated_page(rng)
        clean = Page(re.sub("\x00.*?\x01", "", main, flags=re.S))
        source = "<html><head><title>t</title></head><body>" + before + re.sub("[\x00\x01]", "", main) + after + "</body></html>"
        exact += htmltext.main_texts([source], htmltext.model())[0] == clean.text([True] * len(clean.tag))
    assert exact >= 185


def test_decoding_is_consistent():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        parent = [-1] + [int(rng.integers(0, k)) for k in range(1, 9)]
        odds = rng.standard_normal(9)
        keep = htmltext.decode(parent, odds)
        best = max(
            sum(odds[k] for k in range(1, 9) if bits >> k & 1)
            for bits in range(1, 512, 2)
            if all(not bits >> k & 1 or bits >> parent[k] & 1 for k in range(1, 9))
        )
        assert abs(sum(odds[k] for k in range(1, 9) if keep[k]) - best) < 1e-9


def test_cases(spark):
    body = "Some words, and more words of the story that goes on. " * 5
    page = f"<html><body><nav><a href='/'>Home</a></nav><article><h1>T&eacute;\n x</h1><p>{body}<p>a&nbsp;b &lt;c&gt;<script>var x='<p>no</p>'</script><!-- no --></article><footer>foot</footer></body></html>"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, "u", None, 1), (2, "u", "", 1), (3, None, page, 1), (3, None, page, 1), (None, "u", "<p", 1), (4, "u", deep, 1), (5, "u", '<a href="' * 2000, 1), (6, "u", "<article><p>" + "long words. " * 50000, 1)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[3] == "Té x\n" + " ".join(body.split()) + "\na b <c>"
    assert by[6] == ("long words. " * 50000).strip()
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_without_names():
    """Unclassed pages in ordinary words, from another source than the training pages."""
    own = plain_pages.pages(240)
    assert len(own) >= 200
    blocks = lost = 0
    for source, want, junk in own:
        got = htmltext.main_texts([source], htmltext.model())[0].split("\n")
        blocks += len(want)
        lost += sum((Counter(want) - Counter(got)).values())
        assert not [x for x in junk if x in got and x not in want]
    assert lost <= 0.02 * blocks


def test_hostile_pages_take_linear_time():
    for part, n in (('<a href="', 115_000), ("<div>", 100_000), ("<title>", 150_000), ("<button>x<p>", 85_000), ("<!--", 260_000)):
        began = time.time()
        page = Page(part * n + "</section>" * 50_000)
        assert time.time() - began < 4, part
        assert len(page.parent) == len(page.tag)
    began = time.time()
    Page("<table>" + "<div>" * 60_000 + "<td></td>" * 60_000)
    assert time.time() - began < 5


def test_unclosed_controls_cost_no_text():
    body = "Some words, and more words of the story that goes on. " * 3
    for start in ("<button>", "<select>", "<svg>", "<video>", "<object data='x'>"):
        source = f"<html><body><ul><li><a href='/'>Home</a></ul><article><h1>The title of it</h1><p>{body}</p>{start}<p>{body}</p><p>Last {body}</p></article></body></html>"
        assert htmltext.main_texts([source], htmltext.model())[0].split("\n") == ["The title of it", body.strip(), body.strip(), "Last " + body.strip()], start
    inside = f"<article><h1>The title of it</h1><p>{body}<button>Share</button> and <math>x = 1</math></p><p>{body}</p></article>"
    assert htmltext.main_texts([inside], htmltext.model())[0].split("\n")[1] == body + "and x = 1"
