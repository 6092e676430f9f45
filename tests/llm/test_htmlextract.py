from judgeloom.llm import htmlextract

BODY = "<article class='post'><h1>Title &amp; more</h1><p>First  para\n<b>bold</b>graph.<p>Second &eacute;&#x41;&nbsp;one<br>line</p><ul><li>one<li>two</ul><div class='ad'>Buy!</div><table><tr><td>c1<td>c2</table></article>"
WANT = "Title & more\n\nFirst para boldgraph.\n\nSecond éA one line\n\none\n\ntwo\n\nc1\n\nc2"
FRAME = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/x'>x</a></ul></nav><div class='cookie-notice'>We use cookies</div><!-- <p>no</p> -->{}<section class='comments'><p>Reader says something quite long, longer than the article itself, and goes on and on and on and on and on.</p></section><aside>side</aside><form><p>f</p><input></form><div style='display: none'>x</div><footer>&copy; f</footer></body></html>"


def test_main_text_by_hand():
    assert htmlextract.main_text(FRAME.format(BODY), []) == WANT
    assert htmlextract.main_text(FRAME.format(BODY)[:-30], []) == WANT
    assert htmlextract.main_text("", []) == "" and htmlextract.main_text("<p>", []) == ""
    assert htmlextract.main_text("just text < 3 &lt;b>", []) == "just text < 3 <b>"
    assert htmlextract.main_text("<p>a<!-- never closed <p>b</p>", []) == "a"
    assert htmlextract.main_text("<div><p title='a > b'>x</p><script>if (a</script ><p>y</div>", []) == "x\n\ny"
    assert htmlextract.main_text("<p>" * 3000 + "deep" + "<div>" * 3000 + "er", []).startswith("deep")


def test_nothing_of_the_article_is_dropped(spark):
    long = "Body text of the story. " * 40
    body = long.strip()
    pages = {
        "nested": (f"<article><h1>Title</h1><p>Lead.</p><div class='content'><p>{long}</p></div><p>After.</p></article><div class='more'><p>Else.</p></div>", ["Title", "Lead.", body, "After."]),
        "sections": (f"<main><section class='a'><p>{long}</p></section><section class='b'><p>Short.</p></section></main>", [body, "Short."]),
        "main around article": (f"<main><h1>Title</h1><article><div class='x'><div class='y'><p>{long}</p></div></div><div class='z'><p>End.</p></div></article></main>", ["Title", body, "End."]),
        "no article": (f"<div id='wrap'><h1>Title</h1><p>Lead.</p><p><a href='/'>only a link</a></p><div class='content'><p>{long}</p></div><section class='b'><blockquote>Said.</blockquote></section><p>After.</p><div class='more'><p>Else.</p></div></div>", ["Title", "Lead.", body, "Said.", "After."]),
        "bare sections": (f"<section class='a'><p>{long}</p></section><section class='b'><p>Short.</p></section>", [body, "Short."]),
        "boilerplate inside": (f"<article><div class='share'>Share!</div><div class='content'><p>{long}</p></div><footer>f</footer></article>", [body]),
    }
    for name, (page, want) in pages.items():
        assert htmlextract.main_text(page, []) == "\n\n".join(want), name
    for name, (page, want) in pages.items():
        rows = spark.createDataFrame([(i, f"http://h.test/{i}", page) for i in range(5)], "page_id long, url string, html string")
        assert {r["text"] for r in htmlextract.extract(rows).collect()} == {"\n\n".join(want)}, name


def test_consensus_decides(spark):
    """A short article loses on its own page to a long teaser list, and is found by its host's path."""
    short = "<div id='wrap'><div class='story s1'><p>Tiny.</p></div><div class='more'><p>A teaser that is very much longer than the story and would win here alone.</p></div></div>"
    page = lambda k: f"<div id='wrap'><div class='story s{k}'><p>{'Long story text. ' * 30}</p></div><div class='more'><p>Teaser.</p></div></div>"
    rows = [(i, f"http://h.test/{i}", page(i)) for i in range(30)] + [(100, "http://h.test/100", short), (101, "http://other.test/", short), (102, None, None), (103, "http://h.test/e", ""), (104, "http://h.test/z", "<p>lone"), (104, "http://h.test/z", "<p>lone")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in htmlextract.extract(pages).collect()}
    assert htmlextract.extract(pages).count() == len(rows)
    assert got[100]["text"] == "Tiny." and got[101]["text"].startswith("A teaser") and got[0]["text"] == ("Long story text. " * 30).strip()
    assert got[102]["text"] == got[103]["text"] == "" and got[104]["text"] == "lone" and got[104]["n_chars"] == 4
    assert htmlextract.extract(pages.limit(0)).count() == 0


def test_generated_pages(spark):
    """On the synthetic pages the article element is the main text; compare with cutting it out."""
    import html
    import os
    import re

    import pytest

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no synthetic pages here")
    pages = spark.read.parquet(path)
    got = {r["page_id"]: r["text"] for r in htmlextract.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", inner)]
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)


def test_words_of_classes_dont_decide_alone():
    body = "A sentence of the story that says something of its own. " * 4
    said = body.strip()
    whole = {
        "class of an article": (f"<article class='post share-price'><p>{body}</p></article>", [said]),
        "class of a main": (f"<main class='legal-text'><p>{body}</p></main>", [said]),
        "title": (f"<article><div class='entry-header'><h1>Title</h1></div><p>{body}</p></article>", ["Title", said]),
        "another word beside": (f"<article><div class='promo-free'><p>First.</p></div><p>{body}</p></article>", ["First.", said]),
        "around an article": (f"<div class='header-legal side'><article><p>{body}</p></article></div>", [said]),
        "nothing else there": (f"<div class='banner'><p>{body}</p></div>", [said]),
        "mostly links": (f"<article><p>{body}</p><div class='share-price'><a href=x>Tell all your friends</a></div></article>", [said]),
        "sure words": (f"<article><p>{body}</p><div class='post-comments'><p>{body * 3}</p></div><div class='cookie-text'>Cookies!</div><div class='ad-slot'>Buy!</div></article>", [said]),
        "comments as articles": (f"<article><p>{body}</p></article><section class='comments'><article><p>{body * 3}</p></article></section>", [said]),
        "alone": (f"<div class='legal'>Rights.</div><div id='header'>Site</div><article><p>{body}</p></article>", [said]),
    }
    for name, (page, want) in whole.items():
        assert htmlextract.main_text(page, []) == "\n\n".join(want), name


def test_long_paths_and_very_long_pages():
    deep = "".join(f"<div class='level-with-a-long-name-{chr(97 + k % 26)}'>" for k in range(60))
    page = lambda last: f"{deep}<div class='{last}'><p>{'Words of the text. ' * 20}</p></div>"
    one, two = htmlextract.best_path(page("one")), htmlextract.best_path(page("two"))
    assert one != two and len(one) <= htmlextract.PATH_CHARS
    text = "A paragraph of the very long page. " * 30
    got = htmlextract.main_text("<article>" + f"<p>{text}</p>" * 3000 + "</article>", [])
    assert got == "\n\n".join([text.strip()] * 3000)


def test_class_words_and_tags_inside_an_article_take_no_text():
    body = "A sentence of the story that says something of its own. " * 4
    said = body.strip()
    inside = lambda part: f"<article><p>{body}</p>{part}</article>"
    kept = ["<section class='related-work'><p>X.</p></section>", "<div class='social-history'><p>X.</p></div>", "<p class='comment'>X.</p>", "<div class='menu-planning'><p>X.</p></div>", "<div class='modal-verbs'>X.</div>"]
    kept += ["<div id='overlay-networks'>X.</div>", "<div class='subscription-model'>X.</div>", "<p class='sponsored-bill'>X.</p>", "<aside>X.</aside>", "<p class='notice'>X.</p>", "<header><h2>X.</h2></header>", "<li class='ad'>X."]
    for part in kept:
        assert htmlextract.main_text(inside(part), []) == f"{said}\n\nX.", part
    gone = ["<div class='related-posts'><p>X.</p></div>", "<div class='ad'>X.</div>", "<section class='comments'><p>X.</p></section>", "<aside><a href='/'>X.</a></aside>", "<aside><p>X.</p><input name=q></aside>", "<footer>X.</footer>", "<nav>X.</nav>"]
    gone += ["<form><p>X.</p><input name=q></form>", "<div class='related-work'><a href=x>X.</a></div>", "<div class='cookie-notice'>X.</div>", "<div class='newsletter-signup'><p>X.</p></div>", "<header><a href='/'>X.</a></header>"]
    for part in gone:
        assert htmlextract.main_text(inside(part), []) == said, part
    assert htmlextract.main_text(f"<article><header><h1>Title</h1></header><p>{body}</p></article>", []) == f"Title\n\n{said}"
    assert htmlextract.main_text(f"<header><h1>Site</h1></header><article><p>{body}</p></article>", []) == said
    for frame in ("<body><form action='/' id='aspnetForm'>{}<input type=hidden></form></body>", "<header>{}</header>", "<form><nav>a b</nav>{}</form><div>small print</div>"):
        assert said in htmlextract.main_text(frame.format(f"<div class='content'><p>{body}</p></div>"), []), frame
    assert htmlextract.main_text(f"<form><article><p>{body}</p></article></form>", []) == said


def test_unclosed_and_unmatched_tags_take_no_time():
    import time

    began = time.time()
    assert htmlextract.main_text("<article><p>x" + "<b>" * 200_000 + "</i>" * 3000 + "y</article>", []) == "xy"
    assert htmlextract.main_text("<article><table><tr><td>" + "<b>" * 50_000 + "<td>z" * 3000, []).count("z") == 3000
    assert htmlextract.main_text("<div><article>" * 2000 + "deep", []) == "deep"
    assert time.time() - began < 30


def test_no_pages(spark):
    assert htmlextract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
