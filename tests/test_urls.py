"""Differential tests of the native URL/version functions against Python."""

import hashlib
import os
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from docscope.functions import urls as U

BASES = ["https://h.example.com/en/core/9.4/admin/t1", "https://h.example.com/en/core/",
         "http://h.example.com/a/b/c?x=1#f", "https://h.example.com", "https://h.example.com/a/b/"]
REFS = ["", "t2", "./t2", "../x", "../../y/z", "/root/p", "//other.org/q", "#frag", "?q=2",
        "a/./b/../c", "https://abs.example.org/p", "..", ".", "mailto:x@y", "x?y#z", "../../../../up"]


def test_resolve_url_matches_urljoin(spark):
    pairs = [(b, r) for b in BASES for r in REFS]
    df = spark.createDataFrame(pairs, "b string, r string")
    got = [(x.b, x.r, x.u) for x in U.with_resolved_url(df, "b", "r", "u").select("b", "r", "u").collect()]
    bad = [(b, r, u, urljoin(b, r)) for b, r, u in got if u != urljoin(b, r)]
    assert not bad, bad[:5]


def test_path_id_ext_match_python(spark):
    urls = ["https://h/en/a/b.html?x#y", "http://h/p;params", "https://h/en/9.4/x/", "https://h",
            "https://h/a/.hidden", "https://h/img/pic.jpeg2000", "https://h/a b|c/d.png"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(
        "u", U.url_path("u").alias("p"), U.topic_id("u").alias("id"), U.asset_file("u").alias("f"))
    for r in df.collect():
        assert r.p == urlparse(r.u).path, r.u
        assert r.id == hashlib.sha1(r.u.encode()).hexdigest()[:16]
        ext = os.path.splitext(urlparse(r.u).path)[1][:5] or ".img"
        assert r.f == r.id + ext, r.u


def test_version_order_matches_tuples(spark):
    vs = ["9.4", "9.4.0", "9.10", "10.0", "10.0.1", "9.4.2", "1.2"]
    df = spark.createDataFrame([(v,) for v in vs], "v string").orderBy(F.desc(U.version_key("v")))
    got = [r.v for r in df.collect()]
    assert got == sorted(vs, key=lambda v: tuple(int(p) for p in v.split(".")), reverse=True)


def test_breadcrumb(spark):
    cases = [("https://h/en/flow/onsite/9.4/admin/t1", "flow/onsite", ["9.4", "admin", "t1"]),
             ("https://h/en/core/", "/core/", []),
             ("https://h/en/core-extra/x", "core", ["core-extra", "x"]),
             ("https://h/fr/core/x", "core", ["fr", "core", "x"])]
    df = spark.createDataFrame([(u, r) for u, r, _ in cases], "u string, r string")
    got = [r.c for r in df.select(U.breadcrumb("u", "r").alias("c")).collect()]
    assert got == [c for _, _, c in cases]


def test_html_escape(spark):
    df = spark.createDataFrame([("a&b<c>\"",), (None,)], "t string")
    got = [r.e for r in df.select(U.html_escape("t").alias("e")).collect()]
    assert got == ["a&amp;b&lt;c&gt;\"", ""]


def test_resolve_url_random_pairs(spark):
    """Generated references (dot segments, empty segments, queries,
    fragments, network paths) agree with urllib on every pair."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    seg = st.sampled_from(["a", "b", "..", ".", "", "x.html", "9.4"])
    path = st.lists(seg, min_size=0, max_size=5).map("/".join)
    ref = st.tuples(st.sampled_from(["", "/", "//h2.example.org/"]), path,
                    st.sampled_from(["", "?q=1", "?"]), st.sampled_from(["", "#f", "#"])).map("".join)
    base = st.tuples(path, st.sampled_from(["", "?b=2"])).map(lambda t: "https://h.example.com/" + t[0] + t[1])
    pairs = []

    @settings(max_examples=300, suppress_health_check=list(HealthCheck), database=None, derandomize=True)
    @given(base, ref)
    def collect(b, r):
        pairs.append((b, r))

    collect()
    df = spark.createDataFrame(pairs, "b string, r string")
    got = [(x.b, x.r, x.u) for x in U.with_resolved_url(df, "b", "r", "u").select("b", "r", "u").collect()]
    bad = [(b, r, u, urljoin(b, r)) for b, r, u in got if u != urljoin(b, r)]
    assert not bad, bad[:5]
