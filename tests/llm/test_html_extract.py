"""Page extraction on written pages."""

from docscope.llm import html_extract as H

LONG = "These are many plain words of an article that says something at length . " * 6


def page(inside, before="", after=""):
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{before}"
            f"<article>{inside}</article>{after}</body></html>")


NAV = "<nav><ul>" + "".join(f"<li><a href='/{i}'>item {i}</a></li>" for i in range(8)) + "</ul></nav>"
FOOT = "<footer>&copy; someone and some more words here to count</footer>"


def weights():
    return H.train([page(f"<h1>Head</h1><p>{LONG}</p><p>Short.</p>", NAV + "<div class='ad'>Buy this now and here</div>",
                         FOOT)] * 5)


def test_article_without_boilerplate():
    inside = (f"<h1>Title &amp; more</h1><p>{LONG}<br><p>second\n  <b>bold</b> &lt;x&gt;</p>"
              "<div class='share-buttons'>share me</div><aside>aside words</aside><form>name <input></form>"
              "<script>var t='</p> words'</script><!-- a comment --><p>End.</p>"
              "<section id='comments'><p>a reader says many words here</p></section>")
    got = H.extract(page(inside, NAV, FOOT), weights())
    assert got == f"Title & more\n{LONG.strip()}\nsecond bold <x>\nEnd."


def test_page_without_article_element():
    html = (f"<body>{NAV}<div class='cookie-notice'>We use cookies</div><div class='text'><p>{LONG}</p><p>Tail.</p></div>"
            f"<div class='sidebar'>Other pages you like</div>{FOOT}</body>")
    assert H.extract(html, weights()) == f"{LONG.strip()}\nTail."


def test_unclosed_stray_and_long():
    w = weights()
    assert H.extract("<article><p><b>one two<p>three</div></p>four", w).split("\n") == ["one two", "three", "four"]
    big = "<p>" + "word " * 40_000 + "</p>"
    assert len(H.extract(page(big * 3), w)) == 3 * (40_000 * 5 - 1) + 2
    deep = "<div>" * 5_000 + "deep words here" + "</div>" * 5_000
    assert H.extract(page(deep), w) == "deep words here"
    assert H.extract("a < b and <3 more", w) == "a < b and <3 more"


def test_layout_classes_and_slug_ids_name_no_boilerplate():
    w = weights()
    text = f"<p>{LONG}</p><p>Tail.</p>"
    want = f"{LONG.strip()}\nTail."
    for html in (f"<html class='no-social'><body class='right-sidebar has-cookie-notice'>{NAV}<article>{text}</article>{FOOT}</body>",
                 f"<body><main class='content has-sidebar'>{text}</main><div class='right-sidebar'>Other pages</div></body>",
                 page(text).replace("<article>", "<article class='post category-social'>"),
                 f"<body><div class='container sidebar'>{text}</div><div class='widget'>few words</div></body>",
                 f"<body><div class='has-sidebar category-social'>{text}</div></body>"):
        assert H.extract(html, w) == want, html
    inside = (f"<h2 id='social-impact'>Impact</h2><p>{LONG}</p><section id='discussion'><h2 id='share' class='header'>"
              "Discussion</h2><p id='share-prices'>Shares fell.</p></section><div id='social-security'>Pensions</div>"
              "<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p>")
    assert H.extract(page(inside, NAV, FOOT), w) == (
        f"Impact\n{LONG.strip()}\nDiscussion\nShares fell.\nPensions\nSo x=2 holds.")


def test_boilerplate_by_whole_token_or_head_noun():
    w = weights()
    names = ["ad-slot", "ad ad--large", "share-buttons", "shareButtons", "social-links", "left-sidebar", "sidebar-1",
             "related-posts", "post-navigation", "comments-area", "reader-comments", "cookie-notice", "page-footer",
             "newsletter-signup-form", "footer-widgets", "sidebar__list"]
    for n in names:
        for attribute in ("class", "id"):
            got = H.extract(page(f"<p>{LONG}</p><div {attribute}='{n}'>left out</div><p>End.</p>", NAV, FOOT), w)
            assert got == f"{LONG.strip()}\nEnd.", (attribute, n)
    comments = f"<section id='reader-comments'><p>{LONG * 20}</p></section>"
    assert H.extract(f"<body><div><p>{LONG}</p></div>{comments}</body>", w) == LONG.strip()
    assert H.extract("<body><div class='ad'>Buy this now</div></body>", w) == ""


def test_implied_end_tags_end_boilerplate():
    w = weights()
    first = f"<p>{LONG}</p>"
    for inside, want in {
        "<p class='ad'>Buy now<p>Article text<p>goes on": "Article text\ngoes on",
        "<p class='ad'>Buy <span class='share'>now<div>Article text</div>": "Article text",
        "<p class='ad'>Buy now<hr>Article text": "Article text",
        "<ul><li class='share'>a<li>b<li class='share'><p>c</p><div>d<li>e</ul>f": "b\ne\nf",
        "<ul><li class='share'>a<ul><li>x</li></li><li>y</ul><li>b</ul>": "b",
        "<ul><li>a<ul></li><li class='ad'>x</ul>b<li>c</ul>": "a\nb\nc",
        "<dl><dt class='ad'>a<dd>b<dd class='ad'>c<dt>d</dl>": "b\nd",
        "<table><tr class='ad'><td>a<tr><td class='ad'>b<td>c<th>d<tbody class='ad'><tr><td>e<tbody><tr><td>f</table>g":
            "c\nd\nf\ng",
        "<table><tr><td class='ad'><table><tr><td>a<tr><td>b</table>c<td>d</table>": "d",
        "<datalist><option class='ad'>a<option>b</datalist>": "b",
        "<ul><li>a<table><tr><td>b</li></p><p class='ad'>c<td>d</table></ul>e": "a\nb\nd\ne",
    }.items():
        assert H.extract(page(first + inside, NAV, FOOT), w) == f"{LONG.strip()}\n{want}", inside


def test_quotes_count_only_as_attribute_values():
    w = weights()
    for inside, want in {
        """<p><a href="x"">two</a> words""": "two words",
        "<p title=it's>One two three.</p><p>four it's six.</p>": "One two three.\nfour it's six.",
        "<p title='a > b' class=x>One</p>": "One",
        '<p title = "a > b"class="x">One</p>': "One",
        "<p ' >One</p><p \" x>two</p>": "One\ntwo",
        "<p title=a/b/>One</p>": "One",
        "a<!-->b<!--->c<!-- x --!>d<!---->e": "abcde",
        "a<![CDATA[ x > y ]]>b<? z ?>c</ q>d</>e": "abcde",
        "a <1 b <= c < d": "a <1 b <= c < d",
        "<svg><path d='>'/></svg>a<SCRIPT>x</p></scripty>y</Script >b": "ab",
    }.items():
        html = page(f"<p>{LONG}</p>{inside}", NAV, FOOT)
        assert H.extract(html, w) == f"{LONG.strip()}\n{want}", inside
    # a quote that never closes starts no value; a tag that never ends is no text
    assert H.extract(f"<article><p>{LONG}</p><p title=\"x>One</p>two", w) == f"{LONG.strip()}\nOne\ntwo"
    assert H.extract(f"<article><p>{LONG}</p>One <a href='x", w) == f"{LONG.strip()}\nOne"


def test_scan_is_linear():
    import time

    w, n = weights(), 1_000_000
    for unit in ("<a ", "<", "</", "<!", "<![CDATA[", "<a b='", "<a b=\"'", "<script", "<p '\">", "<!--", "&", "</script "):
        body = unit * (n // len(unit))
        for html in (body, f"<article>{body}</article>", f"<script>{body}"):
            start = time.perf_counter()
            H.extract(html, w)
            assert time.perf_counter() - start < 10, unit


def test_deep_pages_are_linear():
    import time

    start = time.perf_counter()
    got = H.extract("<div>a b c d e f g h i j k l " * 30_000, {"": 1.0, "*": -0.5})
    assert time.perf_counter() - start < 20 and got.count("\n") == 29_999


def test_parts_of_the_page_outside_the_run_are_left_out():
    body = f"<div id=top>Home About</div><div><p>{LONG}</p><p>Tail.</p></div><div>{LONG}</div><div>Contact</div>"
    got = H.extract(f"<body>{body}</body>", {"": 1.0, "*": -2.0})
    assert got == f"{LONG.strip()}\nTail.\n{LONG.strip()}"


def test_best_run_equals_brute_force():
    import itertools
    import random

    rng = random.Random(0)
    for _ in range(200):
        s = [rng.choice([-2.0, -1.0, 0.0, 1.0, 3.0]) for _ in range(rng.randint(0, 12))]
        a, b = H.best_run(s)
        best = max([sum(s[i:j]) for i, j in itertools.combinations(range(len(s) + 1), 2)], default=0.0)
        assert sum(s[a:b]) == max(best, 0.0)


def test_rows(spark):
    rows = [(1, "u", page(f"<p>{LONG}</p>"), "x"), (1, "u", page(f"<p>{LONG}</p>"), "x"), (2, None, None, "x"),
            (3, "v", "", "x"), (None, "w", "<nav>only menu</nav>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in H.extract_pages(df).collect())
    t = LONG.strip()
    assert got == [(0, "w", "", 0), (1, "u", t, len(t)), (1, "u", t, len(t)), (2, "", "", 0), (3, "v", "", 0)]
    assert H.extract_pages(df.limit(0)).count() == 0
