"""Plan-shape guards and operator details the registered data does not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMOKE


def _plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["substring_search", "run_totals", "retention_age", "link_rewrite",
                                  "coverage", "newest_versions", "section_breaks", "topic_docs"])
def test_no_cartesian_products(spark, name):
    from docscope.plans.queries import QUERIES
    plan = _plan_text(QUERIES[name](spark, SF_SMOKE))
    assert "CartesianProduct" not in plan


def test_page_side_is_not_broadcast(spark):
    """The HTML side of the plan/page join is shuffled, never broadcast on an
    estimate; the plan side is partitioned by URL once."""
    from docscope.plans import corpus as C
    plan = _plan_text(C.topics(spark, SF_SMOKE))
    assert "SortMergeJoin [url" in plan
    assert "BroadcastHashJoin [url" not in plan


def test_size_retention_cutoff(spark):
    from docscope.operators.retention import day_sizes, keep_by_size, size_cutoff
    rows = [(i, dt.datetime(2024, 1, 1 + i % 5, 12), "x" * (10 * (1 + i % 5))) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, payload string")
    size = F.length("payload")
    days = {r.day.day: (r.bytes, r.cum_bytes, r.kept)
            for r in size_cutoff(day_sizes(df, "ts", size), 900).collect()}
    # newest day first: 500, then 400 (900 total) kept; 300 more exceeds the cap
    assert days[5] == (500, 500, True) and days[4] == (400, 900, True) and days[3][2] is False
    kept = keep_by_size(df, "ts", size, max_mb=0)
    assert kept.count() == 0


def test_age_retention(spark):
    from docscope.operators.retention import keep_by_age
    # 315,360,000 s = 3,650 days: 2014-01-03 is the oldest day kept
    rows = [(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2014, 1, 3)), (3, dt.datetime(2014, 1, 2))]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    now = F.lit(dt.datetime(2024, 1, 1))
    assert sorted(r.id for r in keep_by_age(df, "ts", now).collect()) == [1, 2]


def test_nav_tree_blocks_are_bounded_and_ordered(spark):
    from docscope.operators.publish import nav_tree
    rows = [("P", "9.4", f"t{i}", f"f{i}.html", "s", "", 0, i) for i in range(25)]
    topics = spark.createDataFrame(rows, "product_title string, version string, title string, file string, "
                                         "section string, x string, pord int, uord long")
    out = nav_tree(topics, block=10).orderBy("block").collect()
    assert [len(r.leaves) for r in out] == [10, 10, 5]
    assert [leaf.file for r in out for leaf in r.leaves] == [f"f{i}.html" for i in range(25)]


def test_nav_map_is_nested_bounded_and_read_back(spark, tmp_path):
    from docscope.operators.publish import nav_leaves, nav_map, read_nav, write_nav
    rows = [("P", ["9.4", "", "10.0"][i % 3], f"t{i}", f"f{i}.html", None if i == 4 else "s", 0, 40 - i)
            for i in range(25)]
    rows += [("Q", "9.4", "q", "q.html", "s", 1, 7)]
    topics = spark.createDataFrame(rows, "product_title string, version string, title string, file string, "
                                         "section string, pord int, uord long")
    write_nav(topics, f"{tmp_path}/nav", 10)
    nav = read_nav(spark, f"{tmp_path}/nav")
    assert nav.schema.simpleString() == nav_map(topics, 10).schema.simpleString()
    chunks = {(r.product_title, r.chunk): r.versions for r in nav.collect()}
    assert sorted((p, c, sum(map(len, v.values()))) for (p, c), v in chunks.items()) == [
        ("P", 0, 10), ("P", 1, 10), ("P", 2, 5), ("Q", 0, 1)]
    want: dict = {}  # a map filled in arrival order
    for p, v, t, f, s, *_ in sorted(rows, key=lambda r: r[5:]):
        want.setdefault(p, {}).setdefault(v or "—", []).append((t, f, s))
    assert {p: [x[1:] for x in sorted((r.pos, r.version, r.title, r.file, r.section) for r in got)]
            for p, got in _by_product(nav_leaves(nav, 10)).items()} == {
        p: [(v, *leaf) for v, leaves in vs.items() for leaf in leaves] for p, vs in want.items()}
    assert nav_leaves(nav_map(topics.limit(0))).count() == 0


def _by_product(leaves):
    out: dict = {}
    for r in leaves.collect():
        out.setdefault(r.product_title, []).append(r)
    return out


def test_coverage_report_document(spark):
    from docscope.operators.coverage import coverage, report_document
    cat = spark.createDataFrame([(0, "a", "A"), (1, "b", "B")], "ord int, pid string, title string")
    planned = spark.createDataFrame([("a",), ("a",), ("b",)], "pid string")
    stored = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("c", "w")], "product string, id string")
    rep = coverage(cat, planned, stored)
    got = {r.id: (r.online_count, r.local_count, r.missing_count) for r in rep.collect()}
    assert got == {"a": (2, 3, 0), "b": (1, 0, 1)}
    doc = report_document(rep, F.lit("2024-01-01T00:00:00Z")).collect()[0]
    assert doc.updates_available is True and [p.id for p in doc.products] == ["a", "b"]


def test_time_range_open_bounds(spark):
    from docscope.operators.search import time_range
    rows = [(1, dt.datetime(2020, 1, 1)), (2, dt.datetime(2024, 5, 1)), (3, dt.datetime(2030, 1, 1))]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    assert time_range(df, "ts").count() == 3
    assert [r.id for r in time_range(df, "ts", "2024-01-01").collect()] == [2, 3]
    assert [r.id for r in time_range(df, "ts", None, "2024-05-01 00:00:00").collect()] == [1]


def test_hot_link_target(spark):
    """A target that a third of all links name is one row of the looked-up side."""
    from docscope.functions.urls import topic_id
    from docscope.operators.links import rewrite_links
    links = spark.range(3000).select(
        F.col("id").alias("src_id"), F.lit(0).alias("pos"), F.lit("h").alias("href"),
        F.when(F.col("id") % 3 == 0, "https://d/home#a").otherwise(
            F.concat(F.lit("https://d/k"), F.col("id") % 50)).alias("abs_url"))
    planned = spark.createDataFrame([("https://d/home",), ("https://d/home",), ("https://d/k1",)], "url string")
    out = rewrite_links(links, planned)
    assert _plan_text(out).count("SortMergeJoin") == 1
    ids = {u: spark.range(1).select(topic_id(F.lit(u))).first()[0] for u in ("https://d/home", "https://d/k1")}
    got = {r.src_id: r.new_href for r in out.collect()}
    assert len(got) == 3000
    for i, new in got.items():
        assert new == (ids["https://d/home"] + ".html#a" if i % 3 == 0 else
                       ids["https://d/k1"] + ".html" if i % 50 == 1 else "h")


def test_counts_come_from_footers(spark, tmp_dir):
    from docscope.plans.queries import QUERIES
    from docscope.sources.tables import stored_rows
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.range(1000).selectExpr("id", "repeat('x', 50) AS t").repartition(4).write.parquet(f"{tmp_dir}/t")
    out = stored_rows(spark, f"{tmp_dir}/t")
    assert "PushedAggregation: [COUNT(*)]" in _plan_text(out) and out.first().total == 1000
    spark.range(0).write.parquet(f"{tmp_dir}/none")
    assert stored_rows(spark, f"{tmp_dir}/none").first().total == 0
    assert "PushedAggregation: [COUNT(*)]" in _plan_text(QUERIES["total_topics"](spark, SF_SMOKE))
    assert _plan_text(QUERIES["run_totals"](spark, SF_SMOKE)).count("PushedAggregation: [COUNT(*)]") == 3
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before


def test_lookup_skips_row_groups_by_bloom_filter(spark, tmp_dir):
    """A file name that no row group holds, though every row group's range does: no row is read."""
    from docscope.plans.corpus import _write_topics
    df = spark.range(40000).select(F.concat(F.sha1(F.col("id").cast("string")), F.lit(".html")).alias("file"))
    _write_topics(df.repartition(2), f"{tmp_dir}/t")
    df.repartition(2).write.parquet(f"{tmp_dir}/plain")

    def scanned(path):
        hit = spark.read.parquet(path).where(F.col("file") == "8000.html")
        assert hit.count() == 0
        executed = hit._jdf.queryExecution().executedPlan()
        hit.collect()
        leaf = executed.collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value()

    assert scanned(f"{tmp_dir}/t") == 0 and scanned(f"{tmp_dir}/plain") > 0


def test_topic_lists_in_locale_order(spark):
    from docscope.operators.search import ranked_list, section_breaks
    titles = ["zoo", "Éclair", "eclair", "Apple", "apple", "Zoo", "éclair", "_x", "ärger", "b"]
    rows = [("P", "1", t, f"{i}.html", s) for s in ("b", "Á", "a", None) for i, t in enumerate(titles)]
    nav = spark.createDataFrame(rows, "product_title string, version string, title string, file string, section string")
    lists = sorted(section_breaks(nav).collect(), key=lambda r: r.item_rank)
    assert [r.item_rank for r in lists] == list(range(1, 41))
    assert [r.section for r in lists[::10]] == ["", "a", "Á", "b"]
    assert [r.title for r in lists[:10]] == ["_x", "apple", "Apple", "ärger", "b", "eclair", "éclair", "Éclair", "zoo", "Zoo"]
    assert [r.is_break for r in lists] == [i % 10 == 0 for i in range(40)]
    twice = nav.where("section = 'a'").unionByName(nav.where("section = 'a'"))
    assert sorted(r.item_rank for r in ranked_list(twice).collect()) == list(range(1, 21))


def test_planning_has_one_equi_join_and_bodies_are_not_shuffled(spark):
    from conftest import SF_SMOKE
    from docscope.plans import corpus as C

    def executed(df):
        return df._jdf.queryExecution().executedPlan().toString()

    plan = executed(C.plan(spark, SF_SMOKE))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    build = executed(C.topics(spark, SF_SMOKE))
    assert "NestedLoop" not in build and "MapInPandas" not in build and "html#" not in build


def _by_day(spark, path):
    from docscope.operators.retention import write_by_day
    rows = [(i, None if i % 11 == 0 else dt.datetime(2024, 1, 1 + i % 9, i % 24), "x" * (i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, payload string")
    write_by_day(df, path)
    return df, spark.read.parquet(path)


def test_day_partitions_keep_what_the_rows_keep(spark, tmp_dir):
    from docscope.operators import retention as R
    df, stored = _by_day(spark, tmp_dir + "/days")
    now, size = F.lit(dt.datetime(2024, 1, 9, 20)).cast("timestamp_ntz"), F.length("payload") + F.lit(1)
    for seconds in (0, 3600, 100_000, 9 * 86_400):
        want = sorted(r.id for r in R.keep_by_age(df, "ts", now, seconds).collect())
        assert sorted(r.id for r in R.keep_days_by_age(stored, "ts", now, seconds).collect()) == want
    for cap in (0, 20, 75, 160, 300, 800, 10_000):
        days = R.size_cutoff(R.day_sizes(df, "ts", size), cap).where("kept").select("day")
        want = sorted(r.id for r in df.join(days, F.to_date("ts").eqNullSafe(days["day"]), "left_semi").collect())
        assert sorted(r.id for r in R.keep_days_by_size(stored, "ts", size, cap).collect()) == want, cap


@pytest.mark.parametrize("name", ["retention_age", "retention_size_rows"])
def test_retention_prunes_partitions(spark, name):
    from docscope.plans.queries import QUERIES
    scans = [x for x in _plan_text(QUERIES[name](spark, SF_SMOKE)).splitlines() if "FileScan" in x]
    assert any("PartitionFilters: []" not in x and "day#" in x.split("PartitionFilters:")[1] for x in scans)


def test_dropped_days_lose_their_files(spark, tmp_dir):
    import os
    from docscope.operators.retention import drop_days
    _, stored = _by_day(spark, tmp_dir + "/days")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS drop_test LOCATION '{tmp_dir}/db'")
    stored.write.partitionBy("day").format("parquet").saveAsTable("drop_test.events")
    want = stored.where("day >= DATE'2024-01-04' or day is null").count()
    assert drop_days(spark, "drop_test.events", dt.date(2024, 1, 4)) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert spark.table("drop_test.events").count() == want
    left = sorted(x for x in os.listdir(f"{tmp_dir}/db/events") if x.startswith("day="))
    assert left[0] == "day=2024-01-04" and any("HIVE_DEFAULT" in x for x in left)
    assert drop_days(spark, "drop_test.events", dt.date(2024, 1, 4)) == []
    spark.sql("DROP DATABASE drop_test CASCADE")


def test_replacement_is_seen_whole_or_not_at_all(spark):
    from docscope.operators.swap import opened, publish
    publish(spark.range(5).withColumn("v", F.lit("old")), "swap_test")
    reader = opened(spark, "swap_test")
    publish(spark.range(7).withColumn("v", F.lit("new")).withColumn("more", F.lit(1)), "swap_test")
    assert reader.count() == 5 and {r.v for r in reader.collect()} == {"old"}
    assert opened(spark, "swap_test").count() == 7 and "more" in opened(spark, "swap_test").columns
    broken = spark.range(9).withColumn("v", F.when(F.col("id") == 8, F.raise_error(F.lit("killed"))).otherwise("x"))
    with pytest.raises(Exception, match="killed"):
        publish(broken, "swap_test")
    assert opened(spark, "swap_test").count() == 7
    spark.sql("DROP VIEW swap_test")


def test_size_retention_cuts_and_keeps_at_every_scale(spark):
    from docscope.plans.queries import QUERIES
    for sf in (SF_SMOKE, SF_SMOKE.replace("0.001", "0.1")):
        kept = QUERIES["retention_size_rows"](spark, sf).count()
        assert 0 < kept < spark.read.parquet(f"{sf}/events.parquet").count()
