"""Planning: theta join, newest-N, dedup, incremental."""

import pytest
from pyspark.sql import functions as F

from docscope.operators import plan as PL
from docscope.plans import fixtures as FX
from docscope.sources.catalog import typed_catalog

URLS = ["https://d/en/p/9.3/a", "https://d/en/p/9.4/a", "https://d/en/p/10.0/a", "https://d/en/p/9.10/b",
        "https://d/en/p/x", "https://d/en/p", "https://d/en/p/10.0/9.3/c", "https://d/en/p/ja/10.0/z",
        "https://d/en/p-extra/10.0/a", "https://d/en/p/old-stuff/1.0/q"]


def plan_for(spark, versions, exclude=""):
    urls = spark.createDataFrame([(u, i) for i, u in enumerate(URLS)], "url string, uord long")
    cat = typed_catalog(FX.catalog_raw(spark, [("p", "P", "/p/", versions, exclude)]))
    return PL.build_plan(urls, cat)


def urls_of(df):
    return sorted(r.url for r in df.select("url").collect())


# what each ``versions`` value keeps of URLS, written out by hand
UNVERSIONED = ["https://d/en/p", "https://d/en/p/x"]
NEWEST = {
    "0": UNVERSIONED,
    "1": ["https://d/en/p/10.0/a", *UNVERSIONED],
    "2": ["https://d/en/p/10.0/a", "https://d/en/p/9.10/b", *UNVERSIONED],
    "3": ["https://d/en/p/10.0/a", "https://d/en/p/9.10/b", "https://d/en/p/9.4/a", *UNVERSIONED],
    "all": ["https://d/en/p/10.0/9.3/c", "https://d/en/p/10.0/a", "https://d/en/p/9.10/b", "https://d/en/p/9.3/a",
            "https://d/en/p/9.4/a", "https://d/en/p/old-stuff/1.0/q", *UNVERSIONED],
}


@pytest.mark.parametrize("versions,expected", [
    ("0", "0"), ("1", "1"), ("2", "2"), ("3", "3"), ("all", "all"), ("none", "1"), ("", "1"), (" 02 ", "2"),
    ("ALL", "all")])
def test_newest_versions(spark, versions, expected):
    assert urls_of(plan_for(spark, versions)) == sorted(NEWEST[expected])


def test_exclusion_list(spark):
    assert urls_of(plan_for(spark, "all", "[old-stuff, zzz]")) == sorted(
        u for u in NEWEST["all"] if "old-stuff" not in u)


def test_newest_is_monotone(spark):
    sizes = [plan_for(spark, str(n)).count() for n in range(0, 5)]
    assert sizes == sorted(sizes)


def test_invalid_versions_fail(spark):
    with pytest.raises(Exception):
        plan_for(spark, "latest").collect()


def test_dedup_last_wins_at_first_position(spark):
    plan = spark.createDataFrame(
        [("a", "A", 0, 5, "u1"), ("b", "B", 1, 2, "u1"), ("a", "A", 0, 7, "u2")],
        "pid string, product_title string, pord int, uord long, url string")
    got = {r.url: (r.pid, r.pord, r.uord) for r in PL.dedup_by_id(plan).collect()}
    assert got == {"u1": ("b", 0, 5), "u2": ("a", 0, 7)}


def test_incremental_and_limit(spark):
    p = plan_for(spark, "all")
    stored = PL.dedup_by_id(plan_for(spark, "1")).select("id")
    todo = urls_of(PL.incremental_todo(p, stored))
    assert set(todo) == set(urls_of(p)) - set(urls_of(plan_for(spark, "1")))
    assert [r.url for r in PL.plan_limit(p, 2).collect()] == [URLS[0], URLS[1]]


def test_full_equals_incremental_after_merge(spark):
    from docscope.streaming.ingest import merge_topics
    full = PL.dedup_by_id(plan_for(spark, "all")).select("id", "url")
    stored = PL.dedup_by_id(plan_for(spark, "1")).select("id", "url").withColumn("run", F.lit(0))
    todo = PL.incremental_todo(full, stored.select("id")).withColumn("run", F.lit(1))
    merged = merge_topics(stored, todo)
    full_ids = {r.id for r in full.collect()}
    merged_ids = {r.id for r in merged.collect()}
    # every planned topic is present after the merge; stored ones stay
    assert full_ids <= merged_ids
    assert merged_ids == full_ids | {r.id for r in stored.collect()}


def test_catalog_typing(spark):
    # an empty value stays empty (newest-N reads it as 1); a missing one takes the default
    raw = [("a", "", "/x/", "", ""), ("b", "B", "y", "007", "[p, , q]"), ("c", "C", "z/", "ALL", "[]"),
           ("d", "D", "w", "None", "solo"), ("e", "E", "v", "latest", "[ r ]"), ("f", "F", "u", None, None)]
    got = {r.pid: (r.title, r.root_path, r.versions, list(r.exclude))
           for r in typed_catalog(FX.catalog_raw(spark, raw)).collect()}
    assert got == {"a": ("a", "x", "", []), "b": ("B", "y", "7", ["p", "q"]), "c": ("C", "z", "all", []),
                   "d": ("D", "w", "none", ["solo"]), "e": ("E", "v", "latest", ["r"]), "f": ("F", "u", "2", [])}
