import random
import re
import time
from html import unescape

import numpy as np
import pytest

from reviewloom.llm import html_extract as he

PAGES = "page_id BIGINT, url STRING, html STRING, text STRING"
SF = "/root/testdata/sf0.001"


def article_text(html):
    """The blocks of the one article of a test page, by plain string work."""
    inner = html.split("<article>")[1].split("</article>")[0]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    blocks = [" ".join(unescape(b).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def trees(spark):
    return he.fit(spark.read.parquet(f"{SF}/pages.parquet").select("html"))


def test_query_gives_whole_articles(spark):
    from reviewloom.llm.queries import op10_boosted_tree_extraction

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = op10_boosted_tree_extraction(spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.text == article_text(pages[r.page_id].html) and r.n_chars == len(r.text)
        assert r.url == pages[r.page_id].url


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdeilmnorst", k=rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


def made(rng, shell):
    body = [sentence(rng, rng.randint(15, 60)) for _ in range(rng.randint(3, 8))]
    inner = "".join(f"<p>{x}</p>\n" for x in body)
    return shell.format(body=inner, line=sentence(rng, 8), other=f"<p>{sentence(rng, 30)}</p><p>{sentence(rng, 12)}</p>"), body


SHELLS = [
    '<body><header><h2>Site</h2></header><nav><a href="/">Home</a> <a href="/x">More</a></nav><div class="post-content">{body}</div><div id="comments"><h3>2 replies</h3>{other}</div><footer>{line}</footer>',
    '<div id="page"><div class="menu"><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><main>{body}<div class="ad-box">{line}</div></main><aside>{other}</aside><div class="cookie-notice">{line}</div></div>',
    '<article>{body}<form action=x><label>{line}</label><input name=a><button>Send</button></form></article><section class="comments"><ol><li>{other}</li><li>{other}</li></ol></section>',
    '<div><div class="sidebar">{other}</div><div class="article-body">{body}<div class="related"><ul><li><a href=q>{line}</a></ul></div></div></div><div class="newsletter">{line}</div>',
]


@pytest.mark.parametrize("shell", range(len(SHELLS)))
def test_other_layouts(trees, shell):
    rng, right, total = random.Random(shell), 0, 0
    for _ in range(30):
        html, body = made(rng, SHELLS[shell])
        page = he.parse(html)
        found = he.decode(page, trees.odds(he.features(page)))
        total += len(set(body) | set(found))
        right += len(set(body) & set(found))
    assert right / total > 0.9


def test_trees_are_those_of_the_library(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    rows = rng.normal(size=(400, 5))
    label = (rows[:, 0] * rows[:, 1] + rows[:, 2] > 0).astype(float)
    df = spark.createDataFrame([(x.tolist(), float(y)) for x, y in zip(rows, label)], "row ARRAY<DOUBLE>, label DOUBLE")
    model = GBTClassifier(maxIter=6, maxDepth=he.DEPTH, seed=1).fit(df.select(array_to_vector("row").alias("features"), "label"))
    trees = he.Trees.read(model.toDebugString)
    sure = model.transform(df.select(array_to_vector("row").alias("features"), "row")).select("row", F.col("probability")).collect()
    odds = trees.odds(np.array([r.row for r in sure]))
    assert np.allclose([r.probability[1] for r in sure], 1 / (1 + np.exp(-odds)))


def test_decoding_never_keeps_a_node_without_its_parent():
    page = he.parse("<div><p>one</p><section><p>two</p><p>three</p></section></div>")
    odds = np.zeros(len(page.tags))
    for seed in range(200):
        odds = np.random.default_rng(seed).normal(size=len(page.tags)) * 2
        found = he.decode(page, odds)
        value = {t: odds[n] for n, t, _ in page.runs}
        div, section = page.tags.index("div"), page.tags.index("section")
        best = max(odds[section] + sum(max(0, value[t]) for t in ("two", "three")), 0)
        total = odds[div] + max(0, value["one"]) + best
        kept = total > 0 and odds[0] + total > 0
        wanted = [t for t in ("one", "two", "three") if kept and value[t] > 0 and (t == "one" or best > 0)]
        assert found == wanted or not (odds[0] + max(total, 0) > 0)


@pytest.mark.parametrize("html, blocks", [
    ("", []), ("plain &amp; simple &#233;&hellip;", ["plain & simple é…"]), ("a<br>b<b> c</b>\n\t d", ["a b c d"]),
    ("<p>one<p>two<div>three</p>four", ["one", "two", "three", "four"]), ("x<script>var a='</p>';</script>y<!-- z -->", ["xy"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]), ("<p>open <b>bold", ["open bold"]),
    ("</div></p>stray</b> <i>t</i>", ["stray t"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("a < b &am c &notit; \x00d", ["a < b &am c ¬it; d"]), ("<p " + "x" * 50, []), ("<style>p{}</style><title>t</title>", [])])
def test_parsing(html, blocks):
    assert [text for _, text, _ in he.parse(html).runs] == blocks


@pytest.mark.parametrize("n", [900, 1500])
def test_share_of_siblings_with_the_same_tag(n):
    page = he.parse("<main>" + "<p>some text</p>" * n + "<div>advert</div></main>")
    share = he.features(page)[:, 14]
    assert share[page.tags.index("div")] == pytest.approx(1 / (n + 1))
    assert share[page.tags.index("p")] == pytest.approx(n / (n + 1))


def test_odd_rows(spark, trees):
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><p>Some text here.</p></article>", None), (3, "v", deep, None),
            (3, "v", deep, None), (4, "w", "<p>" + "word " * 300_000, None)]
    for model in (trees, None):
        found = he.extract(spark.createDataFrame(rows, PAGES).repartition(2), model).collect()
        assert sorted(str(r.page_id) for r in found) == sorted(str(r[0]) for r in rows)
        by_id = {r.page_id: r for r in found}
        assert by_id[1].text == "" and by_id[2].n_chars == 0
    assert by_id[None].text == "Some text here." and by_id[4].n_chars == 5 * 300_000 - 1
    assert he.extract(spark.createDataFrame([], PAGES), None).collect() == []
    assert he.fit(spark.createDataFrame([(None,), ("<p>x</p>",)], "html STRING")) is None


def shown(html):
    return [text for _, text, _ in he.parse(html).runs]


def test_marked_sections_and_hidden_elements():
    assert shown("<p>a</p><![foo]>b") == ["a", "b"]
    assert shown("<![ foo [x]]><p>a") == ["]>a"] or shown("<![ foo [x]]><p>a")[-1] == "a"
    assert shown("<p>a<![&nbsp;>b") == ["ab"]
    assert shown("<p>a <math><mi>x</mi></math> b <object>c</object></p>") == ["a x b c"]
    assert shown("<p>a<iframe src='u'><p>b</p>") == ["a", "b"]
    assert shown("<p>a<iframe>hidden</iframe>b</p>") == ["ab"]
    assert shown("<p>a<svg><svg>t</svg>leak</svg>b</p>") == ["ab"]
    assert shown("<p>a<svg/>b</p>") == ["ab"]


def test_made_pages_do_not_crash():
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<![", "<!", "<!--", "-->", "]]>", "<![CDATA[", "<![if x]>", "<?", ">", "<", "</", "<b>",
             "</div>", "<div class='ad'>", "<svg>", "</svg>", "<iframe>", "<script>", "</script>", "&nbsp;", "&#x110000;",
             "&amp", "text ", "'", '"', "=", "<a href=x>", "</a>", "<li>", "<td>", "<table>", "<title>", "\x00", "é", "<textarea>"]
    for _ in range(20_000):
        page = he.parse("".join(rng.choices(parts, k=rng.randrange(1, 25))))
        assert len(page.tags) == len(page.parents) == len(page.tokens)


@pytest.mark.parametrize("part", ["<b>x", "<p>x", "<i>x</p>", "<div><b>x</i>", "<li>x", "<iframe>x", "<td>x</b>"])
def test_parsing_is_linear(part):
    begin = time.perf_counter()
    he.parse(part * 100_000)
    assert time.perf_counter() - begin < 20
