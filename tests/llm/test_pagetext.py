import html
import re

from pyspark.sql import functions as F

from reviewmill.llm import pagetext
from reviewmill.llm.queries import op5_pagetext

TREE = pagetext.trained()


def test_query_equals_the_article_of_every_page(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op5_pagetext(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_parts_of_a_page():
    page = """<!doctype html><html><head><title>t</title><style>p{a:b}</style></head><body class="has-sidebar">
    <header id="site-header"><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul>
    <div class="cookie-notice">We use cookies. <button>OK</button></div>
    <main><div class="post-body"><header><h1>Head &amp; line</h1></header><p>First paragraph with <b>bo</b>ld words,&nbsp;and
    a <a href="x>y">link</a>.<p>Short.<div class="advert">Buy now</div><!-- hidden > --><p>Second &#233;nd.</p>
    <form><label>Name</label><input name=a></form></div>
    <section id="comments"><h3>Comments</h3><article class="comment"><p>A long remark of some reader that goes on for many
    words without any link at all, and on</p></article></section></main>
    <aside>Some long text beside the article with many words and no links at all, really</aside><footer>&copy; foot</footer>"""
    assert pagetext.main_text(page, TREE) == "Head & line First paragraph with bold words, and a link. Short. Second énd."


def test_hints_in_class_and_id():
    long = "A paragraph of the text that has quite a few words in it, more than twelve of them for certain."
    kept = [f'<div class="{c}"><p>{long}</p><p>Short.</p></div>' for c in ("article-body", "postContent", "content has-sidebar", "entry_content")]
    gone = [f'<div {a}><p>{long}</p></div>' for a in (
        'class="main-menu"', 'id=site_footer', 'class="promo-box"', 'id="cookieNotice"', 'class="post-comments"', "hidden", 'style="display:none"',
        'aria-hidden="true"', 'role="complementary"')]
    for k in kept:
        for g in gone:
            assert pagetext.main_text(f"<body>{g}{k}{g}</body>", TREE) == f"{long} Short.", (k, g)
    assert pagetext.main_text(f'<div class="article-header"><h1>Head</h1></div><div class="article-body"><p>{long}</p></div>', TREE) == f"Head {long}"


def test_pages_without_marks():
    long = "A paragraph of the text that has quite a few words in it, more than twelve of them for certain."
    page = f"<ul><li><a>Home</a><li><a>News</a></ul><h1>About things</h1><p>{long}</p><p>Short.</p><p>{long}</p><div><a>Imprint</a></div>"
    assert pagetext.main_text(page, TREE) == f"About things {long} Short. {long}"


def test_broken_markup_never_fails():
    for page in ("", "<", "<<<>>>", "a < b", "<p", "<!--", "<script>x", "</div></p>", "<a href='x", "&#xZZ; &am", "<p>&lt;p&gt;", "\x00<p>퟿"):
        assert isinstance(pagetext.main_text(page, TREE), str)
    assert [b.text for b in pagetext.blocks("<script>var t='</p>'</script><p>a < b</p>x")] == ["a < b", "x"]


def test_hard_rows(spark, nothing):
    long = "<article>" + "<p>word and more words</p>" * 50_000 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>"), (4, "u", long), (4, "u", long), (None, "v", "<article><p>text</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("key", F.lit(1))
    got = pagetext.extract(pages).collect()
    assert sorted((str(r.key), r.url, len(r.text)) for r in got if r.url) == [
        ("2", "u", 0), ("3", "u", 0), ("4", "u", 50_000 * 20 - 1), ("4", "u", 50_000 * 20 - 1), ("None", "v", 4)]
    assert [r.text for r in got if r.url is None] == [""]
    empty = nothing.select(F.col("doc_id").alias("page_id"), F.col("key").alias("url"), F.col("text").alias("html"))
    assert pagetext.extract(empty).count() == 0


LONG = "A paragraph of the text that has quite a few words in it, more than twelve of them for certain."


def test_hidden_elements_without_an_end_take_nothing_with_them():
    for inside in ("<svg/>", "<svg viewBox='0 0 1 1'/>", "<math/>", "<button>", "<select>", "<button-group></button-group>",
                   "<video-player src=x>", "<object data=x>", "<template/>", "<svg>", "<audio src=x>", "</button>", "<canvas/>"):
        page = f"<article><p>{LONG}{inside}<p>Another one. {LONG}</article>"
        assert pagetext.main_text(page, TREE) == f"{LONG} Another one. {LONG}", inside
    assert pagetext.main_text(f"<nav><svg/></nav><article><p>{LONG}</p></article>", TREE) == LONG


def test_hidden_elements_end_at_their_end_tag():
    for inside in ("<svg><text>drawn</text></svg>", "<button>Share</button>", "<select><option>one<option>two</select >",
                   "<SCRIPT>var a = '<p>';</SCRIPT>", "<style>p {}</style>", "<video><p>No video here</p></video>",
                   "<button>one</button><button>two</button>"):
        page = f"<article><p>{LONG}</p>{inside}<p>Another one. {LONG}</article>"
        assert pagetext.main_text(page, TREE) == f"{LONG} Another one. {LONG}", inside
    # what holds no markup goes on to the end without its end tag
    assert pagetext.main_text(f"<article><p>{LONG}</p><script>if (a < b) <p>{LONG}</p>", TREE) == LONG


def test_formulas_are_text_of_the_article():
    page = f"<article><p>{LONG} Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be given.</p></article>"
    assert pagetext.main_text(page, TREE) == f"{LONG} Let x=1 be given."


def test_many_open_hidden_elements_take_no_square_time():
    import time

    page = f"<article><p>{LONG}</p>" + "<button>" * 20_000 + "<svg>" * 20_000 + f"<p>{LONG}</article>"
    start = time.process_time()
    assert pagetext.main_text(page, TREE) == f"{LONG} {LONG}"
    assert time.process_time() - start < 5


def test_names_that_mislead_do_not_empty_a_page():
    for name in ("related-work", "share-price", "social-science", "alert-fatigue", "story-footer", "popup-store", "notice", "search"):
        page = f'<nav><a href=/>Home</a></nav><div class="{name}"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><footer>foot</footer>'
        assert pagetext.main_text(page, TREE) == f"Title {LONG} {LONG}", name
