"""Golden cases for the page parser (semantics the driver pages lack)."""

from docscope.operators.parse import parse_html

FILLER = "word " * 40  # 200 characters of text


def page(body, head="<title>T</title>"):
    return f"<html><head>{head}</head><body>{body}</body></html>"


def test_title_and_meta_lookup():
    html = page("<h1>Head</h1>", head=(
        "<title> A | B </title>"
        '<meta property="og:url" content=" https://x/y ">'
        '<meta name="Version_Number" content="">'
        '<meta property="Version_Number" content="9.4">'
        '<meta name="contentType" content="task">'))
    p = parse_html(html)
    assert p["title_raw"] == " A | B "
    assert p["h1"] == "Head"
    metas = [(m["attr"], m["name"], m["content"]) for m in p["metas"]]
    assert ("property", "og:url", " https://x/y ") in metas
    assert ("name", "Version_Number", "") in metas


def test_selector_order_and_threshold():
    short_main = "<main>too short</main>"
    art = f"<article><p>{FILLER}</p></article>"
    p = parse_html(page(short_main + art))
    assert p["content_node"] == "article"
    assert p["text"] == FILLER.strip()
    p2 = parse_html(page(f"<div class='x content'>{FILLER}</div>"))
    assert p2["content_node"] == "div.content"
    p3 = parse_html(page("<article>short</article><p>rest</p>"))
    assert p3["content_node"] == "body"
    assert p3["text"] == "short rest"


def test_boilerplate_removal_nested_and_substring_class():
    body = (f"<article><p>{FILLER}</p><nav>menu</nav>"
            "<div class='Sidebar x'><p>side <b>bold</b></p></div>"
            "<span class='protocol'>proto</span>"
            "<form><input name=q>f</form><noscript>ns</noscript>"
            "<script>var a='</p>';</script><p>tail</p></article>")
    p = parse_html(page(body))
    assert p["text"] == FILLER.strip() + " tail"
    html = "".join(x["value"] for x in p["parts"])
    assert "menu" not in html and "side" not in html and "proto" not in html
    assert "tail" in html


def test_unclosed_and_void_elements():
    body = f"<article><p><b>{FILLER}<br><p>inner</p><img src='a.png'><p>last</article><p>after"
    p = parse_html(page(body))
    assert p["content_node"] == "article"
    assert p["text"].endswith("inner last")
    assert [x for x in p["parts"] if x["kind"] == "src"] == [{"kind": "src", "value": "a.png"}]


def test_parts_cut_at_links():
    body = f"<article><p>{FILLER}<a class=k href=\"/en/x?a=1&amp;b=2#f\">go</a></p></article>"
    p = parse_html(page(body))
    kinds = [x["kind"] for x in p["parts"]]
    assert kinds == ["html", "href", "html"]
    assert p["parts"][1]["value"] == "/en/x?a=1&b=2#f"


def test_comments_and_entities():
    p = parse_html(page(f"<article><!-- c --><p>{FILLER}&amp; &copy;</p></article>"))
    assert p["text"].endswith("& ©")
    assert "c" not in p["text"].split()


def test_no_title_falls_back(spark):
    from pyspark.sql import functions as F

    from docscope.functions.text import clean_title
    from docscope.operators.parse import parse_pages
    rows = [(1, page("<h1> Hello <i>x</i> </h1>", head="")),
            (2, page("x", head="<title>Name | Site (last updated 2024)</title>")),
            (3, page("x", head="<title>Guide (last updated May 1)</title>")),
            (4, page("x", head=""))]
    df = spark.createDataFrame(rows, "id int, html string")
    out = parse_pages(df).select("id", clean_title(F.col("page.title_raw"), F.col("page.h1")).alias("t"))
    got = dict((r.id, r.t) for r in out.collect())
    assert got == {1: "Hellox", 2: "Name", 3: "Guide", 4: "Untitled"}


def test_topic_record_from_metas(spark):
    from pyspark.sql import functions as F

    from docscope.functions import urls as U
    from docscope.operators.parse import parse_pages
    from docscope.operators.publish import topic_records
    head = ("<title>Stats | Docs</title>"
            '<meta property="og:url" content=" https://d/en/p/canonical ">'
            '<meta name="Version_Number" content="">'
            '<meta property="Version_Number" content="9.4">'
            '<meta property="contentType" content="reference">'
            '<meta name="lastModifiedISO" content="2024-05-01T10:00:00.000Z">')
    url = "https://d/en/p/search/stats"
    df = spark.createDataFrame([(url, page(f"<main><p>{FILLER}</p></main>", head=head))], "url string, html string")
    plan = df.select(U.topic_id("url").alias("id"), "url", "html", F.lit("p").alias("pid"),
                     F.lit("P").alias("product_title"), F.lit("p").alias("root_path"),
                     U.url_path("url").alias("path"), U.version_segments(U.url_path("url")).alias("segs"),
                     F.lit(0).alias("pord"), F.lit(0).cast("long").alias("uord"))
    r = topic_records(parse_pages(plan, "html")).collect()[0]
    assert r.url == "https://d/en/p/canonical"        # og:url by property
    assert r.version == ""                            # empty name match is not retried by property
    assert r.content_type == "reference"
    assert r.last_modified == "2024-05-01T10:00:00.000Z"
    assert r.title == "Stats" and r.section == "search" and list(r.breadcrumb) == ["search", "stats"]
    assert r.content_node == "main" and r.file == r.id + ".html"


def test_no_page_breaks_the_parser():
    p = parse_html("<article>ok</article><![foo bar")
    assert p["text"].startswith("ok")
    deep = "<div>" * 3000 + "word " * 60 + "</div>" * 1500
    for body in (deep, "<b>" * 3000 + "x", "<p>" * 3000, "</p>" * 3000):
        parsed = parse_html(page(f"<article>{body}</article>"))
        assert parsed["error"] is None
    assert parse_html(page(f"<article>{deep}</article>"))["content_node"] == "article"


def test_tokenizer_errors_are_reported(monkeypatch):
    from docscope.operators import parse as P

    def broken(self, tag, attrs):
        raise AssertionError("no")

    monkeypatch.setattr(P._TreeBuilder, "handle_startendtag", broken)
    p = parse_html("<p>before</p><br/>after")
    assert p["error"] == "AssertionError: no" and p["text"] == "before"


def test_attribute_spans_and_repeated_attributes():
    body = (f"<article><p>{FILLER}<a title='see href=abc' href='/x'>one</a><a href=/y href='/z'>two</a>"
            "<a href>three</a><a data-href='/no'>four</a><img alt=a src = 'p.png'/></p></article>")
    p = parse_html(page(body))
    assert [x["value"] for x in p["parts"] if x["kind"] != "html"] == ["/x", "/z", "", "p.png"]
    html = "".join(x["value"] if x["kind"] == "html" else '"' + x["value"] + '"' for x in p["parts"])
    assert "title='see href=abc' href=\"/x\"" in html and '<a href="">three' in html
