import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webspin.functions import dom as D
from webspin.functions.dom import FlatPage
from webspin.operators import html as H

SIMPLE = """<html><head><title>Simple Test Page</title>
<meta name="description" content="A short page used to check metadata extraction works.">
<meta name="author" content="Jane Writer"></head>
<body><h1>Main Heading Here</h1><p>First paragraph with enough text to count.</p>
<p>Second paragraph, also long enough.</p></body></html>"""

COMPLEX = """<html><head><title>Complex Article</title>
<meta name="keywords" content="spark, data, pipelines, ab">
<meta property="article:published_time" content="2024-03-05T10:00:00Z"></head>
<body><header><nav><a href="/home">Home</a></nav></header>
<main><article class="post-content"><h1>Deep Dive Into Pipelines</h1>
<div class="author">By Sam Author</div><time datetime="2024-03-05">March 5, 2024</time>
<p>""" + "Pipelines move data between systems. " * 20 + """</p>
<p><a href="/next">next</a> <a href="https://other.org/x">other</a> <img src="/i.png" width="300" height="200">
<img src="/tiny.png" width="10" height="10"><img src="/nosize.png"></p></article></main>
<aside class="sidebar">Related links that should vanish</aside>
<div class="ad-banner">Buy things now please</div>
<footer>Footer text here</footer><script>var x = "</p>";</script><style>p{}</style>
<!-- a comment --></body></html>"""

MALFORMED = "<html><body><div><p>Unclosed paragraph <b>bold<p>another para text here</div></body>"


PAGES = [(1, "https://blog.example.com/post/1", COMPLEX), (2, "https://www.example.com/a", SIMPLE), (3, "https://x.org/", MALFORMED), (4, "https://x.org", ""), (5, None, None)]


@pytest.fixture(scope="module")
def records(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return {r.page_id: r for r in H.extract_pages(df).collect()}


def pruned(html):
    page = FlatPage(html)
    return page.rows(page.without(**H.PRUNED), True)


def test_prune_removes_boilerplate():
    nodes, _, elements, _ = pruned(COMPLEX)
    assert not {e["tag"] for e in elements} & {"nav", "aside", "footer", "script", "style", "header"}
    text = " ".join(nodes)
    assert "Related links" not in text and "Buy things" not in text and "a comment" not in text


def test_prune_rules_edge_cases():
    html = ("<body><div class='page-header-x'>Header block text here</div>"
            "<div class='shadow'>Shadowed block of text</div>"
            "<div id='sidebar-1'>first sidebar text</div><div id='sidebar-2'>second sidebar text</div>"
            "<div class='main'>Kept content block here</div><p>tiny</p></body>")
    text = " ".join(pruned(html)[0])
    assert "Header block" not in text          # 'header' class word
    assert "Shadowed" not in text              # 'ad' is a substring of 'shadow'
    assert "first sidebar" not in text and "second sidebar" in text  # ids: first match only
    assert "Kept content" in text and "tiny" not in text             # blocks under 5 chars go


def test_simple_record(records):
    r = records[2]
    assert r.title == "Simple Test Page"
    assert r.description == "A short page used to check metadata extraction works."
    assert r.author == "Jane Writer" and r.domain == "example.com" and r.extraction_errors == []


def test_complex_record(records):
    r = records[1]
    assert r.title == "Complex Article" and r.word_count > 100
    assert r.main_content.startswith("Deep Dive Into Pipelines")
    assert r.publish_date == "2024-03-05T10:00:00Z"
    assert r.keywords == ["data", "pipelines", "spark"]
    assert r.author == "By Sam Author"
    assert "https://blog.example.com/next" in r.links and "https://other.org/x" in r.links
    assert "https://blog.example.com/home" not in r.links
    assert r.images == ["https://blog.example.com/i.png", "https://blog.example.com/nosize.png"]
    assert r.content_type == "article"


def test_malformed_and_empty_records(records):
    assert "another para text" in records[3].main_content
    assert records[4].title == "" and records[4].extraction_success is False and records[5].soup_elements == 0


def test_fallbacks_and_priorities(spark):
    rows = [(1, "https://a.org", "<html><head><title>Page Title Here</title><meta property='og:title' content='OG'></head></html>"),
            (2, "https://a.org", "<h1>Head</h1><h2 class=title>Second headline</h2><title>abc</title>"),
            (3, "https://docs.a.org", "<body><div class='text'><p>" + "One sentence here. " * 30 + "</p></div><div class='text nav2'>" + "Other words! " * 40 + "</div><img src=a.png width=99 height=200><img src='b.png' width='x' height=3></body>"),
            (4, "https://a.org/x/", "<p>plain body words</p><a href='../../u?q=1#f'>up</a><a href='mailto:x'>m</a>"),
            (5, "https://github.com/a/b", "<body><h1>Code</h1><div id=readme>" + "Read this. " * 9 + "</div><article>" + "Not this one. " * 30 + "</article></body>")]
    got = {r.page_id: r for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].title == "Page Title Here"   # the text attribute is tried first: og:title never wins
    assert got[2].title == "Second headline"   # h1 is too short, so is the title element
    assert got[3].content_type == "documentation" and got[3].main_content.startswith("One sentence")  # the other block's class counts against it
    assert got[3].images == ["https://docs.a.org/b.png"]
    assert got[4].links == ["https://a.org/u?q=1#f"] and got[4].main_content == ""
    assert got[5].main_content.startswith("Read this.") and got[5].title == "Code"  # the domain's rules replace the general ones


def test_user_rules(spark):
    pages = spark.createDataFrame([(1, "https://my.site/1", "<title>General title</title><b class=own>Own title</b><i data-w='Me'>x</i>"),
                                   (2, "https://other.site/1", "<title>General title</title><b class=own>Own title</b>")], "page_id long, url string, html string")
    more = spark.createDataFrame([("my.site", "title", 0, ".own", None, ["text"], 1, 99), ("my.site", "author", 0, "[data-w]", "b", ["data-w"], 1, 99), ("my.site", "author", 1, "i[data-w]", None, ["data-w"], 1, 99)], H.RULE)
    got = {r.page_id: r for r in H.extract_pages(pages, rules=H.rules_table(spark).unionByName(more)).collect()}
    assert (got[1].title, got[1].author, got[2].title, got[2].author) == ("Own title", "Me", "General title", "")
    by = H.rules_for(pages, H.rules_table(spark).unionByName(more)).where("field = 'title'").groupBy("page_id").agg(F.collect_list("selector").alias("s")).collect()
    assert {r.page_id: r.s for r in by}[1] == [".own"] and len({r.page_id: r.s for r in by}[2]) == len(H.RULES["title"][0])


def test_block_scores(spark):
    html = ("<body><article class='post body-x'>" + "A sentence. " * 20 + "</article><div class='menu content'>short</div><section><p>x</p></section></body>")
    rows = {(r.tag, r.block_no): r for r in H.score_blocks(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).collect()}
    score = {t: r.score for (t, _), r in rows.items()}
    n = len(("A sentence. " * 20).strip())
    assert score["article"] == pytest.approx(min(n / 1000, 0.4) + 0.2 * 0 + min(19 / 50, 0.2) + 0.2 + 0.15 + 0.1, abs=1e-6)
    assert score["div"] == pytest.approx(0.1 - 0.2 + 0.05 + 0.1, abs=1e-6) and score["section"] == pytest.approx(0.25) and score["p"] == 0
    assert [t for (t, _), r in rows.items() if r.is_best] == ["article"]


def test_text_helpers(spark):
    df = spark.createDataFrame([(1, "u", '<p>See <a href="/doc">docs</a></p><script>x()</script>'), (2, "u", COMPLEX), (3, "u", None), (4, "u", "<div>" * 3000 + "deep"),
                                (5, "u", "<footer><div>" + "in the footer " * 9 + "</div></footer><div>out</div>")], "page_id long, url string, html string")
    text = {r.page_id: r.text for r in H.html_to_text(df, preserve_links=True).collect()}
    assert text[1] == "See docs [/doc]" and text[3] == "" and text[4] == "deep"
    main = {r.page_id: r.main_text for r in H.main_block(df).collect()}
    assert main[2].startswith("Deep Dive Into Pipelines") and main[4] == "deep" and main[5].startswith("in the footer")


def test_unclosed_pages_stay_linear():
    import time

    took = []
    for n in (4000, 16000):
        t0 = time.process_time()
        page = FlatPage("<p>some words here" * n)
        page.rows(page.without(**H.PRUNED), True)
        took.append(time.process_time() - t0)
    assert took[1] < 12 * took[0]


def test_serp_html(spark):
    html = ('<div class="result"><h2><a href="/l/?kh=-1&amp;uddg=https%3A%2F%2Fa.org%2Fp">Title &amp; more</a></h2>'
            '<span class="result__snippet">The snippet</span></div>'
            '<div class="result"><h2>No link</h2></div>'
            '<div class="result"><h3>Third</h3><a href="https://b.org">x</a><div>text</div></div>')
    df = spark.createDataFrame([("q", html), ("none", "<p>no results</p>"), ("null", None)], "query string, html string")
    assert [tuple(r) for r in H.parse_serp_html(df).collect()] == [("q", 1, "Title & more", "https://a.org/p", "The snippet"), ("q", 3, "Third", "https://b.org", "text")]
    assert H.parse_serp_html(df, max_results=2).count() == 1        # the cut comes before the checks
    marked = spark.createDataFrame([("q", '<div data-testid="result"><h2>T</h2><a href="http://c.org">c</a></div>')], "query string, html string")
    assert [tuple(r)[:4] for r in H.parse_serp_html(marked).collect()] == [("q", 1, "T", "http://c.org")]
    tool = '<div class="web-result"><a href="/raw"> T <b>x</b></a><div class="snippet"> s </div></div><div class="result">no link</div><div class="result__body"><a href="u">' + "t" * 300 + "</a></div>"
    got = [tuple(r) for r in H.parse_serp_html(spark.createDataFrame([("q", tool)], "query string, html string"), style="tool").collect()]
    assert got == [("q", 1, "Tx", "/raw", "s"), ("q", 2, "t" * 200, "u", "")]
    bing = '<li class="b_algo"><h2><a href="http://c.org">C</a></h2><div class="b_caption">cap</div></li><li class=b_algo><h2>none</h2></li><li class="b_algo"><h2><a>D</a></h2><p>x</p></li>'
    got = [tuple(r) for r in H.parse_serp_html(spark.createDataFrame([("q", bing)], "query string, html string"), style="bing").collect()]
    assert got == [("q", 1, "C", "http://c.org", "cap"), ("q", 2, "D", "", "x")]


def elements_of(html, selector):
    page = FlatPage(html)
    return [page.attrs[i].get("id") or page.tags[i] for i in D.Selectors((selector,)).match(page, bytearray(len(page.tags)))[0]]


def test_selectors():
    html = ("<div id=a class='x y'><section id=b><p id=c lang=en-GB>1</p><p id=d>2</p></section><p id=e title='two words'>3</p></div>"
            "<p id=f class=y>4</p><ul id=g><li id=h><a id=i href='https://q.org/z.pdf'>5</a></li><li id=j></li></ul>")
    for selector, want in {
        "p": "cdef", ".y": "af", ".x.y": "a", "div.x#a": "a", "div p": "cde", "div > p": "e", "div>section>p": "cd", "div section p": "cd", "section > p:first-of-type": "c",
        "p:first-child": "c", "#f, #h a , section": "bfi", "[title]": "e", "[title~='two']": "e", "p[lang|=en]": "c", "[href^='https:'][href$=\".pdf\"]": "i", "a[href*=q.org]": "i",
        "*": "abcdefghij", "ul li > a": "i", "div > div": "", ".X": "", "[title='two']": "", "section p, p": "cdef",
    }.items():
        assert elements_of(html, selector) == list(want), selector
    for wrong in ("p:hover", "a + b", "a ~ b", "> p", "p >", "p,", "[x", "a::b", "p p:not(.x)", "..x", ""):
        with pytest.raises(ValueError, match="selector not understood"):
            D.parse_selector(wrong)
    assert D.inside("a, b > c", "x, [t='1,2']") == "x a, x b > c, [t='1,2'] a, [t='1,2'] b > c"


def test_user_rules_of_many_parts(spark):
    html = "<title>General title</title><div class=card><h2><b>No</b></h2><section><h2><i>Deep title</i></h2></section></div><p class=by>Someone Else</p>"
    pages = spark.createDataFrame([(1, "https://my.site/1", html), (2, "https://other.site/1", html)], "page_id long, url string, html string")
    more = spark.createDataFrame([("my.site", "title", 0, ".card > section i", None, ["text"], 1, 99), ("*", "author", 9, "article .by, p.by", None, ["text"], 1, 99)], H.RULE)
    got = {r.page_id: r for r in H.extract_pages(pages, rules=H.rules_table(spark).unionByName(more)).collect()}
    assert (got[1].title, got[2].title, got[1].author) == ("Deep title", "General title", "Someone Else")
    wrong = spark.createDataFrame([("my.site", "title", 0, "p:hover", None, ["text"], 1, 99)], H.RULE)
    with pytest.raises(Exception, match="selector not understood"):
        H.page_fields(pages, ["title"], H.rules_table(spark).unionByName(wrong)).collect()


def test_select_elements(spark):
    pages = spark.createDataFrame([(1, "u", "<ul><li>a<li class=k>b <i>c</i></ul>"), (2, "u", None)], "page_id long, url string, html string")
    got = sorted(map(tuple, H.select_elements(pages, ["li > i", "li.k"]).select("page_id", "selector", "tag", "text").collect()))
    assert got == [(1, "li > i", "i", "c"), (1, "li.k", "li", "bc")]


def test_nesting_stays_linear():
    import time

    def page(n):
        flat = FlatPage("".join(f"<div class='c{i}' id='i{i}'>word " for i in range(n)))
        gone = flat.without(**H.PRUNED)
        _, _, elements, number = flat.rows(gone, True)
        hits = D.rule_hits(flat, gone, [r for f in H._as_dicts(H._built_in())["*"].values() for r in f], elements, number)
        return sum(len(str(x)) for x in elements + hits)
    took, size = [], []
    for n in (1000, 4000, 16000):
        t0 = time.process_time()
        size.append(page(n))
        took.append(time.process_time() - t0)
    assert size[1] < 5 * size[0] and size[2] < 5 * size[1] and took[2] < 12 * took[1]


def test_arrays_of_large_pages_are_handed_on(spark):
    made = {}

    class Pages:
        columns = ["url", "html"]

        def select(self, *_):
            return self

        def mapInArrow(self, fn, schema):
            made["fn"] = fn
            return self
    D.page_arrays(Pages())
    rows = pa.RecordBatch.from_pydict({"page_id": list(range(30)), "url": ["u"] * 30, "html": ["<p>" + "word " * 20_000 + "</p>"] * 30, "host": pa.nulls(30, pa.string()), "own": pa.nulls(30, pa.list_(pa.string()))})
    held = [b.num_rows for b in made["fn"](iter([rows]))]
    assert sum(held) == 30 and max(held) <= 3  # 100,000 characters each
