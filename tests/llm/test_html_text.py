import html
import itertools
import re

import numpy as np
import pytest

from kohorta.llm import html_text as H

W = H.PRIOR


def test_minimum_cut_equals_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        keep, drop = rng.random(n) * 3, rng.random(n) * 3
        edges = [(i, j, float(rng.random() * 2)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(label):
            own = sum(keep[i] if x else drop[i] for i, x in enumerate(label))
            return own + sum(w for i, j, w in edges if label[i] != label[j])

        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert cost(H.minimum_cut(keep.tolist(), drop.tolist(), edges)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="search-page"><header><h1>Site</h1></header><nav><ul><li><a href=/x>Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, as all the others do.</p></div>
<div class="ad">Buy now.</div><main><article class=post><header class="entry-header"><h1>Big &amp; old&nbsp;
news</h1></header><p>First <b>bold<br>line</b>.<p>Second &lt;p&gt; &#233; &am x < 3</p><ul><li>item</li></ul>
<blockquote>quoted</blockquote><table><tr><td>cell</table><aside><p>An aside of many words, long enough.</p></aside>
<form><input value=1><p>Your mail, please, to hear of all our news.</p></form>
<div hidden>secret</div><noscript>none</noscript></article>
<section id="comments"><article class="comment"><p>First! Great article, thanks a lot for it.</p></article></section>
</main><div class="sidebar"><p>Popular posts of this week, and of the last one.</p></div>
<footer>&copy; all</footer><script>unclosed"""


def test_article_without_the_rest():
    want = ["Big & old news", "First bold line.", "Second <p> é &am x < 3", "item", "quoted", "cell"]
    assert H.main_text(PAGE, W).split("\n") == want


def test_page_without_hints():
    body = "".join(f"<div><a href=/{i}>link {i}</a></div>" for i in range(6))
    text = "A long paragraph, with commas, full stops. It goes on for some time, as text does, and then it ends."
    page = f"<body>{body}<div>{text}</div><div>Short, but inside.</div><div>{text}</div>{body}"
    assert H.main_text(page, W).split("\n") == [text, "Short, but inside.", text]


@pytest.mark.parametrize("page", [None, "", " \n", "<", "<<<>>", "<p", "<!-- open", "<script>", "</p></b>", "<a href='x>y", "&#x110000;&#0;", "<p/><br/><x:y z=\"1>"])
def test_broken_pages(page):
    assert isinstance(H.main_text(page, W), str)


def test_long_and_deep_pages():
    flat = "<article>" + "<p>word, word.</p>" * 30_000
    assert H.main_text(flat, W).count("\n") == 29_999
    assert H.main_text("<article>" + "<div>" * 20_000 + "deep, deep text", W) == "deep, deep text"


def expected(page):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", inner.group(1) if inner else "")
    clean = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", "", p))).strip() for p in parts)
    return "\n".join(p for p in clean if p)


def test_query_on_the_given_pages(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in H.query(spark, small).collect():
        assert r.text == expected(pages[r.page_id]) and r.n_chars == len(r.text)


def test_frame_edges(spark):
    rows = [(None, None, None), (1, "u", ""), (2, "u", PAGE), (2, "u", PAGE)]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, text int")
    out = H.extract(pages, H.train(pages), pages.columns[:2]).collect()
    assert sorted(len(r.text) > 0 for r in out) == [False, False, True, True]
    assert H.extract(pages.limit(0), H.train(pages.limit(0))).count() == 0


def test_training_uses_text_features(spark, small):
    weights = H.train(spark.read.parquet(f"{small}/pages.parquet"))
    assert weights.shape == (H.FEATURES,) and weights[2] < 0 < weights[5]


@pytest.mark.parametrize("page, want", [
    ("<p>One <svg width=1 /> two.</p><p>Three.</p>", "One two.\nThree."),
    ("<p>One <math/> two.</p><p>Three.</p>", "One two.\nThree."),
    ("<p>One.</p><div><object data=x>no</div><p>Two.</p>", "One.\nTwo."),
    ("<p>One <video src=x>no<p>Two.</p><p>Three.</p>", "One\nTwo.\nThree."),
    ("<div><p>One.</p><audio><p>no</p></div><p>Two.</p>", "One.\nTwo."),
    ("<p>One <svg><svg><text>no</text></svg><text>no</text></svg> two.</p>", "One two."),
    ("<p>One <svg><title/><path/></svg> two.</p><p>Three.</p>", "One two.\nThree."),
    ("<p>One <select><option>no<option>no</select> two.</p>", "One two."),
    ("<p>One.</p><div><select><option>no</div><p>Two.</p>", "One.\nTwo."),
    ("<p>One.</p><template><div>no</div></template><p>Two.</p>", "One.\nTwo."),
])
def test_unseen_elements_end(page, want):
    assert H.main_text(f"<article>{page}</article>", W) == want


@pytest.mark.parametrize("names", ["layout has-sidebar", "no-sidebar", "search-page", "widget", "content-sidebar-wrap"])
@pytest.mark.parametrize("inner", ["article", "main", "div class=entry-content"])
def test_article_inside_a_flagged_wrapper(names, inner):
    side = "<div class=sidebar><p>Popular posts of this week, and of the last one.</p></div>"
    nav = "<nav><article><p>Not an article, but a long menu entry.</p></article></nav>"
    said = "<div class=comments><article><p>Great article, thanks a lot for it.</p></article></div>"
    page = f"<div class='{names}'>{nav}{side}<{inner}><p>The text, in whole.</p>{side}</{inner.split()[0]}>{said}</div>"
    assert H.main_text(page, W) == "The text, in whole."


@pytest.mark.parametrize("names", ["layout has-sidebar", "no-sidebar", "search-page"])
def test_layout_names_say_nothing_about_the_text(names):
    text = "A long paragraph, with commas, full stops. It goes on for some time, as text does, and then it ends."
    assert H.main_text(f"<div class='{names}'><p>{text}</p></div>", W) == text


@pytest.mark.parametrize("page", [
    '<article><div class="md:block hidden lg:flex"><p>The text.</p></div></article>',
    '<main><div data-id="nav-12" data-class=sidebar><p>The text.</p></div></main>',
    '<form id="aspnetForm"><div id="content"><article><p>The text.</p></article></div></form>',
    "<nav><ul><li><a href=x>Home</a></ul><main><p>The text.</p></main>",
    "<nav><a href=x>Home</a><article><p>The text.</p></article>",
    '<article><p>The text.</p><p hidden>no</p><p aria-hidden="true">no</p><p style="color:red; display: none">no</p></article>',
])
def test_attributes_wrappers_and_open_elements(page):
    assert H.main_text(page, W).split("\n")[-1] == "The text." and ">no<" not in H.main_text(page, W)


def test_blocks_outvote_a_name_but_not_a_seed():
    text = "A long paragraph, with commas, full stops. It goes on for some time, as text does, and then it ends."
    many = f"<p>{text}</p>" * 60
    assert H.main_text(f"<div class=sidebar>{many}</div>", W).count("\n") == 59
    assert H.main_text(f"<div class=sidebar><p>{text}</p></div>", W) == ""
    assert H.main_text(f"<aside>{many}</aside><div class=comments>{many}</div>", W) == ""


def test_the_cut_decides_against_the_text_of_a_block():
    page = "<main><ul><li><a href=x>One</a></li></ul><p>The text, in whole, as it is, of some length.</p></main>"
    blocks = H.page_blocks(page)
    assert H.log_odds(blocks, W)[0] < 0 and H.content_labels(blocks, W) == [True, True]


def hidden_names(page):
    page = re.sub(r"<(/?)(article|main|nav|aside|form|footer|header|menu|section)\b", r"<\1div", page)
    return re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_pages_without_any_name(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    weights = H.train(pages)
    right = wrong = missed = 0
    for r in pages.collect():
        named, bare = H.page_blocks(r.html), H.page_blocks(hidden_names(r.html))
        assert [b.text for b in named] == [b.text for b in bare] and all(b.region is None for b in bare)
        for b, got in zip(named, H.content_labels(bare, weights), strict=True):
            right += got and b.region.vote > 0
            wrong += got and b.region.vote < 0
            missed += not got and b.region.vote > 0
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_many_blocks_without_names():
    page = "".join(f"<p>{'word, some text here. ' * (1 + i % 9)}</p>" for i in range(20_000))
    assert H.main_text(page, W).count("\n") == 19_999
