"""Crawl planning: URLs x product catalog -> filtered, version-pruned plan.

Shapes:
  urls     (url string, uord bigint)           sitemap order
  catalog  typed catalog (sources.catalog)     tens of rows
  plan     (pid, product_title, root_path, versions, pord, uord, url, path, segs)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscope.functions import urls as U
from docscope.sources.catalog import keep_count

# Locale sections never planned (fixed value).
LOCALE_MARKERS = ["/ja-jp/", "/ja/"]


def _match_condition(url, path, root, exclude):
    under = path.startswith(F.concat(F.lit("/en/"), root, F.lit("/")))
    landing = F.regexp_replace(path, "/+$", "").endswith(F.concat(F.lit("/en/"), root))
    excluded = F.exists(exclude, lambda x: F.contains(url, x))
    locale = F.lit(False)
    for m in LOCALE_MARKERS:
        locale = locale | F.contains(url, F.lit(m))
    return (under | landing) & ~excluded & ~locale


def product_urls(urls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every (product, url) pair whose URL lies under the product root (or is its
    landing page), contains no excluded substring and is not a locale copy.

    A URL may match several products. One plan for every catalog size: each URL's
    candidate roots (runs of segments after an ``en`` segment) are equi-joined
    with the catalog - a broadcast hash join while the catalog's measured size
    allows it, a shuffled one beyond - and the match is checked on the pairs.
    """
    u = urls.withColumn("path", U.url_path("url"))
    c = catalog.select(F.col("pid"), F.col("title").alias("product_title"), "root_path",
                       "versions", F.col("ord").alias("pord"), "exclude")
    # candidate roots: every run of segments after an "en" segment
    parts = F.split(F.col("path"), "/")
    cands = F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.when(F.element_at(parts, i) == "en", F.transform(
            F.sequence(i + 1, F.greatest(F.size(parts), i + 1)),
            lambda j: F.array_join(F.slice(parts, i + 1, j - i), "/")))
        .otherwise(F.array().cast("array<string>"))))
    uc = u.withColumn("cand", F.explode(F.array_distinct(cands)))
    j = (uc.join(c, uc["cand"] == c["root_path"])
         .where(_match_condition(F.col("url"), F.col("path"), F.col("root_path"), F.col("exclude")))
         .drop("cand"))
    return j.withColumn("segs", U.version_segments(F.col("path"))).drop("exclude")


def _newer_first(a, b):
    """Comparator: larger version key first; equal keys by string, descending."""
    ka, kb = U.version_key(a), U.version_key(b)
    return (F.when(ka > kb, F.lit(-1)).when(ka < kb, F.lit(1))
            .when(a > b, F.lit(-1)).when(a < b, F.lit(1)).otherwise(F.lit(0)))


def allowed_versions(matched: DataFrame) -> DataFrame:
    """(pid, allow array<string>): the N newest distinct version strings per
    product among its matched URLs.

    One aggregate: the distinct versions of a product form a small set (its
    releases), whatever the URL count, and are collected with partial
    aggregation before the shuffle; they are then sorted newest first inside
    the array and cut to N."""
    v = matched.select("pid", "versions", F.explode("segs").alias("seg"))
    g = (v.groupBy("pid", "versions").agg(F.collect_set("seg").alias("found"))
         .withColumn("n", keep_count("versions")))
    return (g.where(F.col("n").isNotNull())
            .select("pid", F.slice(F.array_sort("found", _newer_first), F.lit(1), F.col("n")).alias("allow")))


def _version_allowed(segs, versions, allow):
    """All version segments allowed (true when unversioned or ``all``); an
    invalid ``versions`` value fails the job, as in the reference."""
    keep = (versions == "all") | F.forall(
        segs, lambda x: F.array_contains(F.coalesce(allow, F.array().cast("array<string>")), x))
    checked = keep_count(versions)
    return keep & (checked.isNull() | (checked >= 0))


def newest_versions(matched: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """Keep unversioned URLs and those whose version segments are all among the
    product's N newest versions (``all`` keeps everything)."""
    allow = allowed_versions(matched) if allow is None else allow
    j = matched.join(allow, "pid", "left")  # broadcast only if its measured size allows
    return j.where(_version_allowed(F.col("segs"), F.col("versions"), F.col("allow"))).drop("allow")


def build_plan(urls: DataFrame, catalog: DataFrame) -> DataFrame:
    return newest_versions(product_urls(urls, catalog))


def plan_limit(plan: DataFrame, n: int) -> DataFrame:
    """First ``n`` planned pairs in plan order (product order, then URL order);
    0 keeps all."""
    return plan if not n else plan.orderBy("pord", "uord").limit(n)


def dedup_by_id(plan: DataFrame) -> DataFrame:
    """One row per topic: the last planned pair wins, placed at the first
    pair's position (``pord``/``uord`` of the first occurrence).

    Topics are keyed by a function of the URL, so grouping is by URL: the
    result is then hash-partitioned by URL, the key of the following join to
    the pages, which reuses that partitioning instead of shuffling the plan
    again. The aggregate is partial before the shuffle, so a URL listed many
    times costs one row per task."""
    p = plan.withColumn("o", F.struct("pord", "uord"))
    cols = [c for c in p.columns if c not in ("url", "o", "pord", "uord")]
    g = p.groupBy("url").agg(F.max_by(F.struct(*cols), "o").alias("last"), F.min("o").alias("first"))
    return g.select(U.topic_id("url").alias("id"), "url", "last.*",
                    F.col("first.pord").alias("pord"), F.col("first.uord").alias("uord"))


def incremental_todo(plan: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Planned topics not stored yet (anti join on id)."""
    p = plan if "id" in plan.columns else plan.withColumn("id", U.topic_id("url"))
    return p.join(stored_ids.select("id"), "id", "left_anti")
