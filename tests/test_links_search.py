"""Link/image rewriting over parts, and search-side operators."""

from pyspark.sql import functions as F

from docscope.operators import links as L
from docscope.operators import publish as PB
from docscope.operators import search as S
from docscope.operators.parse import parse_pages

FILLER = "word " * 40


def test_rewrite_parts_links_and_images(spark):
    html = ("<html><body><article><p>" + FILLER +
            "<a href='../b/t2#s'>in plan</a><a href='/en/p/miss'>miss</a><a href='#top'>self</a>"
            "<img src='img/pic.png'><img src='https://cdn.example.org/x'></p></article></body></html>")
    df = spark.createDataFrame([("i1", "https://d/en/p/a/t1", html)], "id string, url string, html string")
    parsed = parse_pages(df).select("id", "url", F.col("url").alias("crawl_url"), F.col("page.parts").alias("parts"),
                                    F.lit("T").alias("title"), F.lit("i1.html").alias("file"))
    planned = spark.createDataFrame([("https://d/en/p/b/t2",), ("https://d/en/p/a/t1",)], "url string")
    manifest = L.asset_manifest(parsed, spark.createDataFrame([("https://d/en/p/a/img/pic.png",)], "abs_url string"))
    out = L.rewrite_parts(parsed, planned, manifest)
    doc = PB.topic_docs(out).collect()[0].html_doc
    from docscope.functions.urls import topic_id  # noqa: F401
    import hashlib
    h = lambda u: hashlib.sha1(u.encode()).hexdigest()[:16]
    assert f'href="{h("https://d/en/p/b/t2")}.html#s"' in doc
    assert 'href="/en/p/miss"' in doc
    assert f'href="{h("https://d/en/p/a/t1")}.html#top"' in doc
    assert f'src="../assets/{h("https://d/en/p/a/img/pic.png")}.png"' in doc
    assert 'src="https://cdn.example.org/x"' in doc
    m = {r.abs_url: (r.file, r.available) for r in manifest.collect()}
    assert m["https://cdn.example.org/x"] == (h("https://cdn.example.org/x") + ".img", False)


def index(spark):
    rows = [("a", "Install Guide", "p", "P", "9.4", "a.html", "how to install", 0, 1),
            ("b", "Search", "p", "P", "", "b.html", "searching INSTALL", 0, 2),
            ("c", "Other", "q", "", None, "c.html", None, 1, 0)]
    return spark.createDataFrame(rows, "id string, title string, product string, product_title string, "
                                       "version string, file string, text string, pord int, uord long")


def test_substring_search_and_short_query(spark):
    idx = index(spark)
    assert S.substring_hits(idx, " i ") is None
    hits = S.first_in_index_order(S.substring_hits(idx, " inSTall "), 1).collect()
    assert [r.id for r in hits] == ["a"]


def test_facets_sum_to_total_and_normalise(spark):
    idx = S.normalise(index(spark))
    facet = S.facet_counts(idx, "product_title").collect()
    assert sum(r["count"] for r in facet) == idx.count()
    assert {r.product_title for r in facet} == {"P", "Other"}
    assert {r.version for r in idx.collect()} == {"9.4", "—"}


def test_keyword_filter_wildcards(spark):
    ev = index(spark).withColumnRenamed("text", "body")
    assert {r.id for r in S.keyword_filter(ev, ["INST*"]).collect()} == {"a", "b"}
    assert {r.id for r in S.keyword_filter(ev, ["install", "guide"]).collect()} == {"a"}
    assert S.keyword_filter(ev, ["*"]).count() == 3
    assert S.facet_filter(ev, product_title="p", version="*").count() == 2


def test_paginate_and_version_ranks(spark):
    nav = spark.createDataFrame(
        [("P", v, "t", f"{v}.html", "", 0, i) for i, v in enumerate(["9.4", "9.10", "—", "9.4.0", "10.0"])],
        "product_title string, version string, title string, file string, section string, pord int, uord long")
    r = S.version_ranks(nav).orderBy("vrank").collect()
    assert [x.version for x in r] == ["10.0", "9.10", "9.4", "9.4.0", "—"]
    page = S.paginate(nav, ["uord"], 1, 2).collect()
    assert [x.uord for x in page] == [2, 3]


def test_group_rank_matches_window(spark):
    from pyspark.sql import Window

    from docscope.operators.ranking import first_in_group, group_rank
    rows = [("big" if i % 3 else f"g{i % 5}", f"s{(i * 7) % 4}", f"t{(i * 13) % 17}", f"f{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, s string, t string, f string")
    got = {(r.f, r.rank) for r in group_rank(df, ["g"], ["s", "t", "f"], partitions=7).collect()}
    w = Window.partitionBy("g").orderBy("s", "t", "f")
    want = {(r.f, r.rank) for r in df.withColumn("rank", F.row_number().over(w)).collect()}
    assert got == want
    firsts = {r.f for r in first_in_group(df, ["g", "s"], ["t", "f"]).where("is_first").collect()}
    w2 = Window.partitionBy("g", "s").orderBy("t", "f")
    assert firsts == {r.f for r in df.withColumn("n", F.row_number().over(w2)).where("n = 1").collect()}


def test_keyset_pages_equal_offset_pages(spark):
    rows = [(f"s{i % 4}", f"l{i % 3}", i) for i in range(53)]
    df = spark.createDataFrame(rows, "source string, lang string, doc_id int")
    order = ["source", "lang", "doc_id"]
    key, pages = ("", "", -1), []
    while True:
        page = [tuple(r) for r in S.page_after(df, order, key, 10).collect()]
        if not page:
            break
        pages.append(page)
        key = page[-1]
    for i, page in enumerate(pages):
        assert page == [tuple(r) for r in S.paginate(df, order, i, 10).collect()]
    assert sum(map(len, pages)) == 53
