"""Main-text extraction against known articles and brute-force cuts; the pipeline stage by stage."""

import html
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketlens.llm import mincut_html, queries, secret_ledger
from marketlens.llm.common import read_table, written

from conftest import SF_SMALL
from test_similarity_operators import brute_components, brute_cut
from test_text_operators import brute_spans


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 9)
        scores = [rng.choice([-2, -1, -0.5, 0, 0.5, 1, 2.5]) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([0.25, 0.75, 1.0])) for _ in range(rng.randint(0, 12))]

        def cost(labels):
            own = sum(max(s, 0) if not x else max(-s, 0) for s, x in zip(scores, labels))
            return own + sum(w for a, b, w in edges if labels[a] != labels[b])
        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(mincut_html.minimum_cut(scores, edges)) == pytest.approx(best)


def test_pages_give_their_articles(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in queries.op6_mincut_html(spark, sf).collect()}
    pages = read_table(spark, sf, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        inside = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inside)).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div class="cookie-notice">We use cookies. Accept all of the policy now please.</div>
<div id="sidebar"><h3>Related</h3><p>Some long sidebar text that goes on for a while and has punctuation, too. Indeed it has.</p></div>
<main><article><header><h1>Real title</h1></header><p>First para &amp; more text that is long enough.<p>Second <a href="x>y">link</a> para, with&nbsp;more.
<ul><li>Item one<li>Item <b>two</b></ul><table><tr><td>a<td>b</table><div class="ad-banner">Buy now!</div>
<form><label>Email</label><input><button>Go</button></form><section class="comments"><h2>Comments</h2>
<p>Reader says this is great and long enough to look like text.</p></section></article></main>
<aside><p>Aside text that is long, long, long, long, long, long, long, long.</p></aside><footer>&copy; me</footer><script>var x="<p>no</p>"</script>"""


def test_parts_of_a_page():
    assert mincut_html.main_text(PAGE) == ("Real title First para & more text that is long enough. Second link para, with more. "
                                           "Item one Item two a b")


def test_html_edge_cases(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, "t"), (2, "u", "", "t"), (2, "u", "", "t"), (None, None, "<p>x<", "t"), (5, "u", "<script>only()</script><!-- c", "t"),
         (6, "u", "<article><p>" + "word " * 50_000, "t"), (7, "u", "plain text without any markup at all, but long enough.", "t")],
        "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in mincut_html.extract(pages).collect()}
    assert [rows[i].text for i in (1, 2, None, 5)] == ["", "", "x<", ""] and rows[6].n_chars == 249_999
    assert rows[7].text.startswith("plain text") and mincut_html.extract(pages.limit(0)).count() == 0
    for bad in ("<b>x" * 3000, '<a href="' * 3000, "<" * 5000, "<div><p>w " * 3000, '<a "<a" ' * 3000):
        mincut_html.main_text(bad)  # in time


PARAGRAPHS = ["First paragraph of the article, long enough to be text of its own.", "Second paragraph goes on with more of the story.", "Third and last one ends."]
ARTICLE = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
SIDEBAR = "<div class='sidebar'><h3>Latest</h3><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></div>"
COMMENTS = ("<section id='comments'><h2>Comments</h2><article class='comment'><p>Great article, I loved all of it and want more.</p></article><article class=comment><p>Me "
            "too, this is a long comment by a reader who has much to say, indeed a lot more than the article itself has, with words and sentences. And more. And "
            "still more.</p></article></section>")


@pytest.mark.parametrize("names", ["post type-post status-publish category-news tag-politics", "page right-sidebar", "layout-sidebar-right", "page-with-sidebar",
                                   "content-sidebar", "hentry category-reviews", "entry search-result", "main-nav-wrap", "single comments-open header-active"])
@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_articles_survive_ordinary_names(names, tag):
    for inner in (ARTICLE, ARTICLE if tag == "article" else f"<article>{ARTICLE}</article>"):
        for extra in ("", SIDEBAR, COMMENTS, SIDEBAR + COMMENTS):
            for outer in ("{}", "<main>{}</main>", "<form id='aspnetForm'>{}</form>"):
                for page in (f"<{tag} class='{names}'>{inner}</{tag}>{extra}", f"<{tag} class='{names}'>{inner}{extra}</{tag}>"):
                    whole = f"<body><nav><a href=x>Home</a></nav>{outer.format(page)}<footer>© 2020 Site. All rights reserved.</footer></body>"
                    assert mincut_html.main_text(whole) == " ".join(PARAGRAPHS)


def test_names_of_parts_still_count():
    for part in ("<div class='article-sidebar'>{}</div>", "<aside class=content>{}</aside>", "<div class='post-comments'>{}</div>", "<div class='related-posts'>{}</div>",
                 "<div id=search-box>{}</div>", "<div class='cookie-bar'>{}</div>", "<form>{}</form>", "<article class='teaser related-article'>{}</article>"):
        for page in (f"<article>{ARTICLE}</article>" + part, f"<article>{ARTICLE}{part}</article>", f"<main>{part}<div>{ARTICLE}</div></main>"):
            assert mincut_html.main_text("<body>" + page.format("<p>Here is something else, long enough to look like text.</p>")) == " ".join(PARAGRAPHS)


def test_unclosed_controls_and_deep_nesting():
    for tag in ("button", "select", "object", "canvas", "video", "datalist", "svg"):
        assert mincut_html.main_text(f"<body><article>{ARTICLE}<{tag}></article>") == " ".join(PARAGRAPHS)
    assert mincut_html.main_text(f"<body><article>{ARTICLE}<script>x {ARTICLE}") == " ".join(PARAGRAPHS)
    start = time.process_time()
    for bad in ("<div>" * 20_000, "<b>" * 20_000 + "<p>x" * 3000, "<button>" * 20_000, "<object>" * 20_000, "<b><div>" * 10_000 + "</b>" * 10_000, "<li><b>" * 10_000,
                "<table><tr><td>" * 7000, "<div class='" + "a-" * 20_000 + "'>", "<span>" * 20_000 + "</div>" * 20_000):
        mincut_html.main_text(bad + ARTICLE)
    assert time.process_time() - start < 15


LONG = "This is a sentence of an article that is long enough to be content."


def test_head_without_end_tag():
    for head in ("<head>", "<head><title>t</title>", "<head lang=en><meta charset=utf-8><title>t</title><style>p{}</style>"):
        for body in ("<body>", ""):
            assert mincut_html.main_text(f"<html>{head}{body}<article><p>{LONG}</p></article></html>") == LONG


def test_self_closed_drawings():
    for drawing in ('<svg class="icon"/>', "<svg />", "<math/>", '<svg viewBox="0 0 1 1" />', "<svg><path/>no</svg>"):
        assert mincut_html.main_text(f"<body><article><p>{LONG}</p>{drawing}<p>{LONG}</p></article><svg><path/></svg></body>") == f"{LONG} {LONG}"


def test_long_attributes():
    long = "{&quot;a&quot;: &lt;1}, class='x' hidden " * 500
    assert len(long) > 20_000
    bad = f'<div data-state="{long}" class="sidebar"><p>{LONG} Not here.</p></div>'
    framed = f'<iframe srcdoc="<p>{long}</p>"><p>Inside {LONG}</p></iframe>'
    good = f'<article data-props="{long}"><p title="<nav class=x>">{LONG}</p></article>'
    assert mincut_html.main_text(f"<body>{bad}{framed}{good}<svg data-x='{long}'><text>{LONG}</text></svg>{bad}</body>") == LONG
    assert mincut_html.main_text(f"<body><article><p>{LONG}</p><svg width=1/>no</svg><svg d='{long}'/><p>{LONG}</p></article>") == f"{LONG} {LONG}"
    for bad in ('<a "x\' ' * 30_000, "<a b='" * 30_001, '<a b="c" ' * 30_000, "<a \"<b '\"" * 30_000, "</script " * 30_000, "<script></script " * 30_000,
                "<p a='" + '<b "' * 30_000):
        mincut_html.main_text(bad)  # in time


# pipeline

@pytest.fixture(scope="module")
def steps(spark):
    docs, out = read_table(spark, SF_SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF_SMALL), name)
        out.append((before, docs))
    return out


def test_stages(steps, spark):
    names = read_table(spark, SF_SMALL, "documents").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "secrets", "packing"]
    assert all(after.columns == names for _, after in steps[:-1])
    assert all(after.schema["n_chars"].dataType == before.schema["n_chars"].dataType for before, after in steps[:-1])


def test_quality_stage_keeps_good_documents(steps, spark):
    before, after = steps[0]
    labels = read_table(spark, SF_SMALL, "labels")
    kept = {r.doc_id for r in after.collect()}
    rows = [(r.quality, r.doc_id in kept) for r in labels.join(before, "doc_id", "left_semi").collect()]
    assert sum(k for q, k in rows if q) >= 0.97 * sum(q for q, _ in rows)
    assert sum(k for q, k in rows if not q) <= 0.2 * sum(not q for q, _ in rows)
    assert after.exceptAll(before).count() == 0


def test_near_duplicate_stage_equals_brute_force(steps):
    before, after = steps[1]
    want = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want) and after.exceptAll(before).count() == 0


def test_repeat_stage_equals_brute_force(steps):
    import hashlib
    before, after = steps[2]
    want = {i: sha for i, _, _, _, sha in brute_cut([(r.doc_id, r.text) for r in before.collect()], 50)}
    rows = after.collect()
    assert len(rows) == before.count()
    whole = [r for r in rows if "�" not in r.text and hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id]]
    assert len(whole) >= 0.9 * len(rows)  # the others lost bytes of characters that were cut in two
    assert all(r.n_chars == len(r.text) for r in rows)


def test_secret_stage_leaves_none(steps):
    before, after = steps[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.n_chars == len(r.text) and brute_spans(r.text) == ""
        assert r.text == texts[r.doc_id] or brute_spans(texts[r.doc_id])


def test_packing_stage_and_run(steps, spark):
    before, after = steps[4]
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before.collect())
    assert after.agg(F.sum("n_tokens")).first()[0] == words
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_SMALL).collect()), key=str) == sorted(map(tuple, after.collect()), key=str)


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls everywhere, repeated rows, empty texts, clashing extra columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, keep string, n_bytes long, component_id long"
    rows = [(1, None, None, None, None, "a", None, 1, 2), (2, "", "en", "s", 0, None, "b", 1, 2), (3, "x y z " * 30, "en", "s", 9, "k", "k", 1, 2),
            (3, "x y z " * 30, "en", "s", 9, "k", "k", 1, 2), (4, "token=abcdefghi " + "w " * 3000, "de", None, 5, "k", "k", 1, 2), (None, "lost id", "en", "s", 7, "k", "k", 1, 2)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, str(tmp_path)), name)
            if name != "packing":
                assert docs.columns == names
        assert (docs.count() > 0) == bool(data)
        if data:
            assert docs.where("doc_id = 3").count() == 1 and docs.where("doc_id is null").count() == 1


def test_near_copy_without_an_id_goes(spark):
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(5, text), (None, text + " more"), (None, None), (6, "another one"), (6, text + " again")], "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF_SMALL).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(5, text), (None, None), (6, "another one")]))


def test_guard_is_in_the_entry_only():
    for path in ("corpus_pipeline.py", *(f"marketlens/llm/{m}.py" for m in ("queries", "common", "jaccard_trie"))):
        with open(__file__.replace("tests/llm/test_html_and_pipeline.py", path)) as f:
            assert "ImportError" not in f.read()
    assert secret_ledger.BASE_RULES[0].version == "assign@1"
