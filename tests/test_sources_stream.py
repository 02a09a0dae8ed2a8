"""Sitemap/robots sources on literal files; feed stream = batch; merge."""

import os

import pytest
from pyspark.sql import functions as F

from docscope.sources import sitemaps as SM

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_sitemap_expand_with_cycle_duplicate_and_malformed(spark, tmp_dir):
    site = os.path.join(tmp_dir, "site")
    u = lambda n: "file:" + os.path.join(site, n)
    write(f"{site}/index.xml", f"<?xml version='1.0'?><sitemapindex {NS}><sitemap><loc> {u('a.xml')} </loc></sitemap>"
                               f"<sitemap><loc>{u('sub.xml')}</loc></sitemap><sitemap><loc>{u('a.xml')}</loc></sitemap>"
                               f"<sitemap><loc>{u('missing.xml')}</loc></sitemap></sitemapindex>")
    write(f"{site}/sub.xml", f"<sm:sitemapindex xmlns:sm='http://www.sitemaps.org/schemas/sitemap/0.9'>"
                             f"<sm:sitemap><sm:loc>{u('index.xml')}</sm:loc></sm:sitemap>"
                             f"<sm:sitemap><sm:loc>{u('b.xml')}</sm:loc></sm:sitemap></sm:sitemapindex>")
    write(f"{site}/a.xml", f"<urlset {NS}><url><loc> https://d/en/p/1 </loc></url><url><loc></loc></url>"
                           f"<url><loc>https://d/en/p/2</loc></url></urlset>")
    write(f"{site}/b.xml", f"<urlset {NS}><url><loc>https://d/en/p/2</loc></url></urlset>")
    write(f"{site}/bad.xml", "not xml at all")
    files = SM.sitemap_files(spark, site)
    kinds = {r.url.rsplit("/", 1)[1]: r.kind for r in files.collect()}
    assert kinds == {"index.xml": "index", "sub.xml": "index", "a.xml": "leaf", "b.xml": "leaf", "bad.xml": "malformed"}
    roots = spark.createDataFrame([(u("index.xml"),)], "url string")
    visited = SM.expand(spark, roots, files)
    names = sorted(r.url.rsplit("/", 1)[1] for r in visited.collect())
    assert names == ["a.xml", "b.xml", "index.xml", "sub.xml"]
    urls = [(r.ord, r.url) for r in SM.leaf_urls(visited, files).orderBy("ord").collect()]
    assert urls == [(0, "https://d/en/p/1"), (1, "https://d/en/p/2"), (2, "https://d/en/p/2")]


LEAF = f"<urlset {NS}><url><loc>https://d/{{}}?a=1&amp;b=2</loc></url></urlset>"


@pytest.mark.parametrize("name,text,kind", [
    ("pi", "<?xml version='1.0'?>\n<?xml-stylesheet type='text/xsl' href='s.xsl'?>\n" + LEAF, "leaf"),
    ("bom", "\ufeff<?xml version='1.0'?>" + LEAF, "leaf"),
    ("comments", "<!-- one\n <urlset> two -->\n<!-- three -->" + LEAF + "<!-- end -->", "leaf"),
    ("doctype", "<!DOCTYPE urlset>\n" + LEAF, "leaf"),
    ("truncated", LEAF[:-12], "malformed"),
    ("cut", f"<urlset {NS}><url><loc>https://d/1</loc></url><url><loc>https://d/2", "malformed"),
    ("mismatch", "<urlset><url><loc>https://d/1</url></loc></urlset>", "malformed"),
    ("blank", "\n ", "malformed")])
def test_sitemap_prolog_and_malformed(spark, tmp_dir, name, text, kind):
    write(f"{tmp_dir}/s/{name}.xml", text.format(name) if "{}" in text else text)
    r = SM.sitemap_files(spark, f"{tmp_dir}/s").first()
    assert r.kind == kind
    assert r.locs == ([f"https://d/{name}?a=1&b=2"] if kind == "leaf" else [])


def test_expansion_has_no_depth_limit(spark, tmp_dir):
    files = spark.createDataFrame(
        [(f"s{i}", "index", [f"s{i + 1}"], []) for i in range(70)] + [("s70", "leaf", [], ["https://d/deep"])],
        "url string, kind string, children array<string>, locs array<string>")
    roots = spark.createDataFrame([("s0", 1)], "url string, ord int")
    visited = SM.expand(spark, roots, files)
    assert visited.agg(F.max("depth")).first()[0] == 70
    assert [r.url for r in SM.leaf_urls(visited, files).collect()] == ["https://d/deep"]


def test_candidate_roots(spark, tmp_dir):
    files = spark.createDataFrame([("https://d/sitemap_index.xml",), ("https://d/s2.xml",), ("https://d/sitemap.xml",)],
                                  "url string")
    write(f"{tmp_dir}/robots.txt", "Sitemap: https://d/s2.xml\r\nSitemap: https://d/sitemap_index.xml")
    got = [r.url for r in SM.candidate_roots(spark, f"{tmp_dir}/robots.txt", files, "https://d").orderBy("ord").collect()]
    assert got == ["https://d/s2.xml", "https://d/sitemap_index.xml", "https://d/sitemap.xml"]


def test_robots_roots(spark, tmp_dir):
    p = os.path.join(tmp_dir, "robots.txt")
    write(p, "User-agent: *\nSITEMAP: https://d/s1.xml \nsitemap:https://d/s2.xml\nSitemap: https://d/s1.xml\n")
    got = [(r.url, r.ord) for r in SM.robots_roots(spark, p, "https://d/sitemap.xml").orderBy("ord").collect()]
    assert got == [("https://d/s1.xml", 1), ("https://d/s2.xml", 2)]
    q = os.path.join(tmp_dir, "robots2.txt")
    write(q, "User-agent: *\n")
    assert [r.url for r in SM.robots_roots(spark, q, "https://d/sitemap.xml").collect()] == ["https://d/sitemap.xml"]


def test_stream_equals_batch_and_merge(spark, tmp_dir):
    from docscope.operators.publish import EVENT_FIELDS
    from docscope.sources.feed import write_decoy
    from docscope.sources.feed import read_feed, write_feed
    from docscope.streaming.ingest import ingest_stream
    rows = [tuple(f"{f}{i}" for f in EVENT_FIELDS[:-2]) + (f"f{i % 3}", "bödy\r\nx") for i in range(9)]
    ev = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in EVENT_FIELDS))
    feed = os.path.join(tmp_dir, "feed")
    write_feed(ev, feed)
    write_decoy(spark, feed)
    batch = read_feed(spark, feed).drop("source")
    q = ingest_stream(spark, feed, os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "ck"))
    q.awaitTermination()
    streamed = spark.read.parquet(os.path.join(tmp_dir, "t")).select(*EVENT_FIELDS)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect())) == sorted(rows)
    # the undated rows of the stream are dated by their file
    undated = spark.read.parquet(os.path.join(tmp_dir, "t"))
    assert undated.where("_time is null").count() == 0


def _feed(spark, path, rows):
    """``rows``: {file: title} written as one delivery."""
    from docscope.operators.publish import EVENT_FIELDS
    from docscope.sources.feed import write_feed
    values = [tuple({"file": f, "title": t}.get(c, "x") for c in EVENT_FIELDS) for f, t in rows.items()]
    write_feed(spark.createDataFrame(values, ", ".join(f"{f} string" for f in EVENT_FIELDS)), path)


def _titles(df):
    rows = df.select("file", "title", "run").collect()
    assert len({r.file for r in rows}) == len(rows)
    return {r.file: (r.title, r.run) for r in rows}


@pytest.mark.parametrize("kind", ["append", "state"])
def test_newest_run_wins_over_redeliveries(spark, tmp_dir, kind):
    """Every delivery is drained by a restart on the same checkpoint."""
    from docscope.streaming.ingest import latest_stream, upsert_stream
    feed, table, ck = (os.path.join(tmp_dir, x) for x in ("feed", "table", "ck"))

    def drain():
        if kind == "append":
            return _titles(upsert_stream(spark, f"{feed}/*/*", table, ck))
        return _titles(latest_stream(spark, f"{feed}/*/*", table, ck, ["title", "url"]))

    _feed(spark, f"{feed}/a/run0", {f"k{i}": "old" for i in range(9)})
    assert drain() == {f"k{i}": ("old", 0) for i in range(9)}
    _feed(spark, f"{feed}/a/run2", {"k1": "new", "k20": "first"})
    want = {f"k{i}": ("old", 0) for i in range(9)} | {"k1": ("new", 2), "k20": ("first", 2)}
    assert drain() == want
    _feed(spark, f"{feed}/b/run2", {"k1": "new", "k20": "first"})  # delivered again
    _feed(spark, f"{feed}/b/run1", {"k1": "late", "k2": "late"})  # an older run comes late
    want["k2"] = ("late", 1)
    assert drain() == want
    assert drain() == want  # nothing new


def test_state_holds_one_row_per_topic(spark, tmp_dir):
    from docscope.streaming.ingest import latest_stream
    feed, table, ck = (os.path.join(tmp_dir, x) for x in ("feed", "table", "ck"))
    for again in range(3):
        _feed(spark, f"{feed}/{again}/run1", {f"k{i}": "t" for i in range(7)})
        assert latest_stream(spark, f"{feed}/*/*", table, ck, ["title", "url"]).count() == 7
    state = spark.read.format("statestore").load(ck)
    assert state.count() == 7


def test_upsert_stream_restart_returns_the_same_version(spark, tmp_dir):
    from docscope.operators.publish import EVENT_FIELDS
    from docscope.sources.feed import write_feed
    from docscope.streaming.ingest import upsert_stream
    feed, table, ck = (os.path.join(tmp_dir, x) for x in ("feed", "table", "ck"))
    rows = [tuple(f"{f}{i}" for f in EVENT_FIELDS) for i in range(5)]
    write_feed(spark.createDataFrame(rows, ", ".join(f"{f} string" for f in EVENT_FIELDS)), f"{feed}/run0")
    first = sorted(map(str, upsert_stream(spark, f"{feed}/*", table, ck).collect()))
    again = sorted(map(str, upsert_stream(spark, f"{feed}/*", table, ck).collect()))
    assert len(first) == 5 and first == again


def test_ndjson_files_are_read(spark, tmp_dir):
    from docscope.sources.feed import read_feed
    write(f"{tmp_dir}/f/a.ndjson", '{"url": "u", "title": "t"}\n')
    write(f"{tmp_dir}/f/b.json", '{"url": "v", "title": "t"}\n')
    write(f"{tmp_dir}/f/c.txt", '{"url": "w", "title": "t"}\n')
    assert sorted(r.url for r in read_feed(spark, f"{tmp_dir}/f").collect()) == ["u", "v"]


def test_undated_events_pass_time_filters(spark):
    from docscope.functions.times import event_or_ingest_time
    from docscope.operators.retention import keep_by_age, keep_by_size
    df = spark.createDataFrame([(1, "2020-01-01T00:00:00Z"), (2, ""), (3, "no date"), (4, None)], "id int, t string")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    dated = df.withColumn("_time", event_or_ingest_time("t", now))
    assert [r.id for r in dated.where(F.col("_time") >= "2024-01-01").orderBy("id").collect()] == [2, 3, 4]
    assert sorted(r.id for r in keep_by_age(dated, "_time", now, 86_400).collect()) == [2, 3, 4]
    from docscope.functions.times import event_time
    raw = df.withColumn("_time", event_time("t"))
    assert sorted(r.id for r in keep_by_age(raw, "_time", now, 86_400).collect()) == [2, 3, 4]
    assert sorted(r.id for r in keep_by_size(raw, "_time", F.lit(600_000), 2).collect()) == [2, 3, 4]


def test_monitor_picks_up_files_arriving_later(spark, tmp_dir):
    """A running ingest (processing-time trigger) takes files written after it
    started; each file is ingested once, the decoy never."""
    from docscope.operators.publish import EVENT_FIELDS
    from docscope.sources.feed import write_decoy, write_feed
    from docscope.streaming.ingest import ingest_stream

    def batch(run, n):
        rows = [tuple(f"{f}{run}-{i}" for f in EVENT_FIELDS[:-2]) + (f"f{run}-{i}", "b") for i in range(n)]
        return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in EVENT_FIELDS))

    feed, table = os.path.join(tmp_dir, "feed"), os.path.join(tmp_dir, "table")
    write_feed(batch(0, 4), os.path.join(feed, "run0"))
    q = ingest_stream(spark, os.path.join(feed, "*"), table, os.path.join(tmp_dir, "ck"), available_now=False)
    try:
        q.processAllAvailable()
        assert spark.read.parquet(table).count() == 4
        write_feed(batch(1, 3), os.path.join(feed, "run1"))
        write_decoy(spark, os.path.join(feed, "run1"))
        q.processAllAvailable()
        files = sorted(r.file for r in spark.read.parquet(table).collect())
        assert files == sorted([f"f0-{i}" for i in range(4)] + [f"f1-{i}" for i in range(3)])
    finally:
        q.stop()


def test_sitemap_namespace(spark, tmp_dir):
    """Only files whose root is in the sitemap namespace, by default or by prefix, name URLs."""
    ns = "http://www.sitemaps.org/schemas/sitemap/0.9"
    files = {"a": f"<urlset xmlns='{ns}'><url><loc>u1</loc></url></urlset>",
             "b": f'<s:urlset xmlns="x" xmlns:s = "{ns}"><s:url><s:loc>u2</s:loc></s:url></s:urlset>',
             "c": "<urlset xmlns='http://example.org/other'><url><loc>u3</loc></url></urlset>",
             "d": "<urlset><url><loc>u4</loc></url></urlset>",
             "e": f"<s:urlset xmlns='{ns}' xmlns:s='x'><s:url><s:loc>u5</s:loc></s:url></s:urlset>"}
    for name, text in files.items():
        write(f"{tmp_dir}/s/{name}.xml", text)
    got = {r.url[-5]: (r.kind, list(r.locs)) for r in SM.parsed_site(spark, f"{tmp_dir}/s", f"{tmp_dir}/out").collect()}
    assert got == {"a": ("leaf", ["u1"]), "b": ("leaf", ["u2"]), "c": ("leaf", []), "d": ("leaf", []), "e": ("leaf", [])}
