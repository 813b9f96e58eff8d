import html
import re

from stallscope.llm.html_text import TAG, WORD, extract, learn, op1_html_text, pieces
from tests.llm import edges

WEIGHTS = {"": WORD}


def test_parts_without_content_are_left_out():
    page = """<!doctype html><html><head><title>Head</title><style>p{}</style></head><body class="no-sidebar">
    <header class="site-header"><h1>Site</h1></header><nav><ul><li><a>Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies a lot here</div>
    <main><article><h1>The title</h1><p>First para<b>graph</b> with &amp; and&nbsp;&#233;.<br>Second line
       here</p><aside>More to read elsewhere</aside><script>var x="</p>";</script><!-- a > b -->
    <p>Third <a href="x>y">one</a> is the end of it.</p><form><input name=q><p>search me</p></form>
    <ul><li>Item one of list</li><li>Item two of list</li></ul></article></main>
    <section id="comments"><p>Nice post my friend</p></section><div class="adBanner">Buy this thing now</div>
    <footer>Copyright words</footer></body></html>"""
    assert extract(page, WEIGHTS) == "The title First paragraph with & and é. Second line here Third one is the end of it. Item one of list Item two of list"


def test_region_is_the_best_contiguous_one():
    tags = "<td>" * 9
    page = f"<p>few words</p>{tags}<p>this part holds more words than the other part</p>{tags}<p>last</p>"
    assert extract(page, WEIGHTS) == "this part holds more words than the other part"
    # Against all parts of all sums.
    parts = [(1 - 2 * bool(t)) * (-TAG if t else WORD * len(x.split())) for t, x, _, _ in pieces(page)]
    best = max((sum(parts[a:b]), a, b) for a in range(len(parts)) for b in range(a + 1, len(parts) + 1))
    assert best[0] == 9 * WORD


def test_long_parts_without_content_inside_an_article():
    first, last = " ".join(["first"] * 60), " ".join(["last"] * 80)
    words = "word " * 100
    links = "<ul>" + "<li><a href=x>a link</a></li>" * 100 + "</ul>"
    for weights in (WEIGHTS, {"": 0.5, "aside": -3.0, "form": -3.0, "div": -3.0, "li": -3.0, "a": -3.0}):
        for inner in (words, links, f"<div>{links}</div>"):
            for part in (f"<aside>{inner}</aside>", f"<form>{inner}</form>", f"<div class=comments>{inner}</div>", f"<div class='ad'>{inner}</div>"):
                assert extract(f"<nav>{links}</nav><article><p>{first}</p>{part}<p>{last}</p></article><footer>{words}</footer>", weights) == f"{first} {last}"
                assert extract(f"<body><p>{first}</p>{part}<p>{last}</p></body>", weights) == f"{first} {last}"


def test_marks_name_the_element_itself():
    text = "Words of the content that must not be lost"
    for start in ("div class='content no-sidebar'", "div class='container with-nav'", "div class=\"layout has-sidebar\"", "h2 id='legal'", "section id='related'", "div class='article-header'", "div class='entry-header clearfix'", "div class=search-results", "h1 class=header"):
        tag = start.split()[0]
        assert extract(f"<body><{start}>{text}</{tag}></body>", WEIGHTS) == text, start
        assert extract(f"<article><p>{text}</p><{start}>{text}</{tag}><p>{text}</p></article>", WEIGHTS) == " ".join([text] * 3), start
    assert extract(f"<article><div class='article-header'><h1>Title here</h1></div><p>{text}</p></article>", WEIGHTS) == f"Title here {text}"
    marks = ("class=ad", "class='ad-300x250'", "class=adBanner", "class='box related-posts'", "id=comments", "class='main-nav'", "class='site-footer'", "class='page-header'", "id='cookie-bar'", "role=navigation", "class='sidebar-content'", "class='share-buttons'", "id=disqus_thread")
    for mark in marks:
        assert extract(f"<body><p>{text}</p><div {mark}>not this</div><p>{text}</p></body>", WEIGHTS) == f"{text} {text}", mark


def test_elements_without_end_tags():
    text = "Words of the content that must not be lost"
    for page in (
        f"<p class=ad>buy this<p>{text}</p>",
        f"<article><p class=ad>buy this<p>{text}</p><p>{text}</p></article><p>x",
        f"<article><p class=ad>buy this<div>{text}</div></article>",
        f"<article><p class=ad>buy <b>this<h2>{text}</h2></article>",
        f"<article><div><p class=ad>buy this</div>{text}</article>",
        f"<ul><li class=notice>a notice<ul><li>inside it<li>too</ul><li>{text}</ul>",
        f"<ul><li class=notice>a notice</ul>{text}",
        f"<table><tr><td class=ad>buy this<table><tr><td>inside<td>it</table><td>{text}</table>",
        f"<table><tr><td class=ad>buy this<tr><td>{text}</table>",
        f"<dl><dt>{text}<dd class=ad>buy this<dt>{text}</dl>",
        f"<div><div class=ad>a <aside>b</b></aside> c</div>{text}</div>",
        f"<nav><p>menu<p>more</nav>{text}",
        f"<html><head><meta charset=utf-8><title>t</title><script>x='<p>'</script><body><p>{text}</p></body>",
        f"<html><head><title>t</title><p>{text}</p>",
        f"<p><svg viewBox='0 0 1 1'/></p><p>{text}</p>",
        f"<p><svg><path d=x></p><p>{text}</p>",
        f"<math/><p>{text}</p>",
    ):
        got = extract(page, WEIGHTS)
        assert text in got and got.replace(text, "").strip() in ("", "x"), page
    assert extract(f"<p>{text}<svg><title>t</title><text>drawn</text></svg>s</p>", WEIGHTS) == text + "s"
    # Time grows with the page alone.
    assert extract("<section><td>" + "<div><b>" * 60_000 + "</section></i>" * 60_000 + text, WEIGHTS) == text


def test_forms_around_pages_and_attributes_that_only_look_like_marks():
    text = "Words of the content that must not be lost, " * 5
    text = " ".join(text.split())
    page = f"<nav>menu here</nav><div class=content><h1>Title</h1><p>{text}</p></div><footer>the foot</footer>"
    for form in ("<form id=aspnetForm method=post action='./'><input type=hidden name=__VIEWSTATE value='x'>", "<form>", "<form><input type='text' name=q>"):
        assert extract(f"<body>{form}{page}</form></body>", WEIGHTS) in (text, f"Title {text}"), form  # as the scan weighs the heading
        assert extract(f"<body>{form}<p>{text}</p>", WEIGHTS) == text
    questions = "<form>Your name <input name=a> your mail <input name=b> what you say <textarea>none</textarea><button>Send it off</button></form>"
    assert extract(f"<article><p>{text}</p>{questions}<p>{text}</p></article>", WEIGHTS) == f"{text} {text}"
    for start in ("a title='a hidden gem'", "p title='the hidden valley'", "p data-id='comments'", "p data-role=banner", "div class='flex hidden lg:flex'", "p aria-label='style: hidden; display:none'", "p hidden=false", "p data-hidden"):
        tag = start.split()[0]
        assert extract(f"<p>{text}</p><{start}>kept as well</{tag}>", WEIGHTS).endswith("kept as well"), start
    for start in ("p hidden", "div style='color:red; display : none'", "div aria-hidden=true", "div class=hidden", "p HIDDEN=''", "div id='comments"):
        tag = start.split()[0]
        assert "gone" not in extract(f"<p>{text}</p><{start}>gone</{tag}>", WEIGHTS), start


def test_articles_inside_what_is_no_content_belong_to_it():
    text = " ".join("Words of the content that must not be lost" for _ in range(4))
    teaser = "<article><h3>Read this too</h3><p>a teaser</p></article>"
    for start, end in (("<aside>", "</aside>"), ("<div class=sidebar><div>", "</div></div>"), ("<footer>", "</footer>"), ("<section class=comments>", "</section>")):
        assert extract(f"<main><p>{text}</p></main>{start}{teaser}{teaser}{end}", WEIGHTS) == text, start
        assert extract(f"<p>{text}</p>{start}{teaser}{end}<p>{text}</p>", WEIGHTS) == f"{text} {text}", start
    assert extract(f"<aside>never closed <article><p>{text}</p></article>", WEIGHTS) == text
    assert extract("<aside><article>" * 20_000 + "</aside>" + text, WEIGHTS) == ""  # in the second aside, which has no end
    assert extract("<form>" * 40_000 + "<p>" + text, WEIGHTS) == text


def test_broken_markup():
    assert extract(None, WEIGHTS) == extract("", WEIGHTS) == extract("<p></p>", WEIGHTS) == ""
    assert extract("just text", WEIGHTS) == "just text"
    assert extract("a < b and <3 &lt;tag&gt; &notanentity; &#x110000;", WEIGHTS).startswith("a < b and <3 <tag>")
    assert extract('<p title="open>text here <b>bold', WEIGHTS) is not None
    assert extract("<nav>menu words<article><p>content words here</p></article>", WEIGHTS) == "content words here"
    assert extract("<p>words <script>never closed", WEIGHTS) == "words"
    assert len(extract("<p>" + "word " * 300_000, WEIGHTS)) == 5 * 300_000 - 1
    assert extract("<" * 100_000, WEIGHTS) == "<" * 100_000


def test_pages_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op1_html_text(spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        article = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.DOTALL)[1]
        plain = re.sub("<(?!/?b>)[^>]*>", " ", article).replace("<b>", "").replace("</b>", "")
        assert r.text == " ".join(html.unescape(plain).split())
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_weights(spark):
    w = learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert w[""] > 0 and all(x < 0 for f, x in w.items() if f)
    assert w["nav"] < w["p"] and w["li"] < w["p"]
    assert learn(spark.createDataFrame([("<p>x</p>",)], "html string")) == {"": WORD}


def test_awkward_rows(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (2, None, "<p>x y"), (None, "v", "<p>x"), (5, "w", "<article>" + "<p>word</p>" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", edges.F.lit("clash"))
    got = sorted((r.text, r.n_chars, r.page_id or 0) for r in op1_html_text(spark, edges.saved(df, tmp_path, "pages")).collect())
    assert [(n, i) for _, n, i in got] == [(0, 1), (0, 2), (20_000 * 5 - 1, 5), (1, 0), (3, 2)]
    assert op1_html_text(spark, edges.saved(df.limit(0), tmp_path / "none", "pages")).count() == 0
