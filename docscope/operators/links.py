"""Link and image rewriting over the ``parts`` of parsed pages, natively.

Links: an anchor's absolute URL (resolved against the topic URL) without its
fragment is looked up in the planned URL set; a hit becomes ``<id>.html`` +
fragment, a miss keeps the original ``href``. Images: the absolute image URL
is looked up in the asset manifest; available -> ``../assets/<file>``, else
the absolute URL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscope.functions import urls as U


def rewrite_links(links: DataFrame, planned_urls: DataFrame) -> DataFrame:
    """``links(src_id, pos, href, abs_url)`` -> adds ``new_href``.

    One left join with the distinct planned URLs: a target that many pages link to
    (say, the home page) has one row there, and adaptive execution splits the link
    rows of a skewed partition over many tasks.
    """
    lk = links.withColumn("key", U.url_key("abs_url")).withColumn("frag", U.url_fragment("abs_url"))
    hits = planned_urls.select(F.col("url").alias("key")).distinct().withColumn("hit", F.lit(True))
    j = lk.join(hits, "key", "left")
    new = F.when(F.col("hit"), F.concat(U.topic_id("key"), F.lit(".html"), F.col("frag"))).otherwise(F.col("href"))
    return j.select("src_id", "pos", "href", new.alias("new_href"))


def link_parts(topics: DataFrame) -> DataFrame:
    """One row per rewritable attribute of each topic: (id, base, pos, kind, value)."""
    return (topics.select("id", F.col("url").alias("base"), F.col("crawl_url"),
                          F.posexplode("parts").alias("pos", "p"))
            .where(F.col("p.kind") != "html")
            .select("id", "base", "crawl_url", "pos", F.col("p.kind").alias("kind"), F.col("p.value").alias("value")))


def asset_manifest(topics: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """Distinct absolute image URLs (resolved against the crawled URL) with
    their local file name and availability (from ``available(abs_url)``, the
    fetched assets; all unavailable when None)."""
    imgs = U.with_resolved_url(link_parts(topics).where(F.col("kind") == "src"), "crawl_url", "value", "abs_url")
    imgs = imgs.select("abs_url").distinct()
    m = imgs.withColumn("file", U.asset_file("abs_url"))
    if available is None:
        return m.withColumn("available", F.lit(False))
    a = available.select("abs_url").distinct().withColumn("available", F.lit(True))
    return m.join(a, "abs_url", "left").withColumn("available", F.coalesce("available", F.lit(False)))


def rewrite_parts(topics: DataFrame, planned_urls: DataFrame, manifest: DataFrame) -> DataFrame:
    """Topics with ``parts`` values rewritten (links by plan, images by
    manifest). Only the rewritten attributes travel through the joins; they
    return to their topic as a small ``pos -> value`` map joined on ``id``."""
    lp = link_parts(topics)
    links = U.with_resolved_url(lp.where(F.col("kind") == "href"), "base", "value", "abs_url").select(
        F.col("id").alias("src_id"), "pos", F.col("value").alias("href"), "abs_url")
    new_links = rewrite_links(links, planned_urls).select(F.col("src_id").alias("id"), "pos",
                                                          F.col("new_href").alias("new"))
    imgs = (U.with_resolved_url(lp.where(F.col("kind") == "src"), "crawl_url", "value", "abs_url")
            .select("id", "pos", "abs_url")
            .join(manifest.select("abs_url", "file", "available"), "abs_url", "left")
            .select("id", "pos", F.when(F.col("available"), F.concat(F.lit("../assets/"), F.col("file")))
                    .otherwise(F.col("abs_url")).alias("new")))
    changes = (new_links.unionByName(imgs).groupBy("id")
               .agg(F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("chg")))
    out = topics.join(changes, "id", "left")
    parts = F.transform("parts", lambda p, i: F.struct(
        p["kind"].alias("kind"),
        F.coalesce(F.try_element_at(F.col("chg"), i), p["value"]).alias("value")))
    return out.withColumn("parts", F.when(F.col("chg").isNull(), F.col("parts")).otherwise(parts)).drop("chg")
