"""The corpus build as one Spark plan, and its published tables.

discover (sitemap URLs) -> plan (prefix join + filters + newest-N) -> dedup by id
-> join the parsed pages on URL -> topic records. Pages are parsed once (mapInPandas)
where they are scanned.

``published(spark, sf_dir)`` writes the topic records once per application to
the shared work folder and returns them read back, so every query over the
corpus reads a materialised table (as the reference's queries read the files
its build job wrote) instead of re-parsing pages.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.operators import parse as P
from docscope.operators import plan as PL
from docscope.operators import publish as PB
from docscope.operators import textindex as TI
from docscope.operators.retention import write_by_day
from docscope.plans import fixtures as FX
from docscope.session import work_dir
from docscope.sources.catalog import typed_catalog
from docscope.sources.tables import stored_rows, table


def catalog(spark: SparkSession, rows=None) -> DataFrame:
    return typed_catalog(FX.catalog_raw(spark, FX.CATALOG_RAW if rows is None else rows))


def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered URL list in sitemap order (``uord``)."""
    return FX.doc_urls(spark, sf_dir).select(F.col("doc_url").alias("url"), F.col("page_id").alias("uord"))


def crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages keyed by the URL they were fetched from, with the
    response content type; only ``text/html`` responses are parsed."""
    pages = FX.with_doc_url(FX.rich_pages(table(spark, sf_dir, "pages").select("page_id", "html")))
    return pages.select("page_id", F.col("doc_url").alias("url"), "html", "content_type")


def html_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("content_type").contains("text/html"))


def plan(spark: SparkSession, sf_dir: str, catalog_rows=None) -> DataFrame:
    return PL.build_plan(sitemap_urls(spark, sf_dir), catalog(spark, catalog_rows))


def topics(spark: SparkSession, sf_dir: str, catalog_rows=None, limit: int = 0) -> DataFrame:
    """Lazy topic records of a full build: the published plan joined to the pages,
    which are parsed once, where they are scanned; no HTML body is shuffled."""
    planned = PL.dedup_by_id(PL.plan_limit(published_plan(spark, sf_dir, catalog_rows), limit))
    pages = published_pages(spark, sf_dir)
    return PB.topic_records(planned.join(html_pages(pages).select("url", "page"), "url"))


_PUBLISHED: dict[tuple, str] = {}


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _write_topics(df: DataFrame, path: str) -> None:
    """Topics with a Bloom filter on ``file``: a lookup skips the row groups whose range of ids
    holds the key but which do not have it."""
    (df.write.mode("overwrite").option("parquet.bloom.filter.enabled#file", "true")
     .option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path))


def stored_total(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One row, ``total``: the rows of the published ``topics``, ``search_index`` or ``plan``,
    from the files' footers."""
    {"topics": published, "search_index": published_index, "plan": published_plan}[name](spark, sf_dir)
    return stored_rows(spark, _PUBLISHED[(spark.sparkContext.applicationId, name, sf_dir.rstrip("/"), repr(None))])


def _publish(spark: SparkSession, name: str, key: tuple, build, write=_write) -> DataFrame:
    """Write ``build()`` once per application under the shared work folder and
    return the table read back."""
    k = (spark.sparkContext.applicationId, name) + key
    path = _PUBLISHED.get(k)
    if path is None:
        digest = hashlib.sha1(repr(k).encode()).hexdigest()[:16]
        path = f"{work_dir(spark)}/corpus-{digest}/{name}"
        write(build(), path)
        _PUBLISHED[k] = path
    return spark.read.parquet(path)


def published(spark: SparkSession, sf_dir: str, catalog_rows=None) -> DataFrame:
    """Topic records (with full text and HTML parts), written once per
    application. Each file is sorted by ``id`` (a per-task sort, no shuffle), so
    Parquet row-group statistics let a lookup by ``id``/``file`` skip all but
    one row group per file."""
    key = (sf_dir.rstrip("/"), repr(catalog_rows))
    return _publish(spark, "topics", key,
                    lambda: topics(spark, sf_dir, catalog_rows).sortWithinPartitions("id"), _write_topics)


def published_index(spark: SparkSession, sf_dir: str, catalog_rows=None) -> DataFrame:
    """The search index (1200-character excerpts), published beside the topics
    so searches scan excerpts, not whole texts."""
    key = (sf_dir.rstrip("/"), repr(catalog_rows))
    return _publish(spark, "search_index", key,
                    lambda: PB.search_index(published(spark, sf_dir, catalog_rows)))


def token_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary, postings) of the topics' titles and bodies."""
    key = (sf_dir.rstrip("/"),)
    postings = _publish(spark, "topic_tokens", key, lambda: TI.token_postings(
        published(spark, sf_dir).select("id", "title", F.col("text").alias("body")), "id", ["title", "body"]),
        TI.write_postings)
    return _publish(spark, "topic_dictionary", key, lambda: TI.token_dictionary(postings)), postings


def gram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-gram postings of the search index's titles and excerpts."""
    return _publish(spark, "topic_grams", (sf_dir.rstrip("/"),), lambda: TI.gram_postings(
        published_index(spark, sf_dir), "id", ["title", "text"]), TI.write_postings)


def document_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary, postings) of the whole texts and sources of ``documents``."""
    key = (sf_dir.rstrip("/"),)
    postings = _publish(spark, "document_tokens", key, lambda: TI.token_postings(
        table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body")),
        "doc_id", ["title", "body"]), TI.write_postings)
    return _publish(spark, "document_dictionary", key, lambda: TI.token_dictionary(postings)), postings


def published_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table partitioned by day."""
    return _publish(spark, "events", (sf_dir.rstrip("/"),), lambda: table(spark, sf_dir, "events"), write_by_day)


def published_plan(spark: SparkSession, sf_dir: str, catalog_rows=None) -> DataFrame:
    """The crawl plan (product, URL, order, path, version segments) of one
    catalog state, written once per application: the coverage, incremental,
    totals and link queries consume it instead of re-planning from the URL
    table each time."""
    key = (sf_dir.rstrip("/"), repr(catalog_rows))
    return _publish(spark, "plan", key, lambda: plan(spark, sf_dir, catalog_rows))


def published_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every crawled page parsed once (``page_id``, ``url``, ``content_type``, ``page``
    struct), written once per application for the topics and the page-level queries."""
    key = (sf_dir.rstrip("/"),)
    return _publish(spark, "pages", key, lambda: P.parse_pages(crawled_pages(spark, sf_dir), "html"))


def publish_all(spark: SparkSession, sf_dir: str, previous_rows=None) -> None:
    """The whole build for a data set: plans of the current and the previous
    catalog state, the topic records of both runs, the search index, the text indexes, the events by day and the parsed pages."""
    from docscope.plans.fixtures import CATALOG_RAW_PREVIOUS
    prev = CATALOG_RAW_PREVIOUS if previous_rows is None else previous_rows
    published_pages(spark, sf_dir)
    published_plan(spark, sf_dir)
    published_plan(spark, sf_dir, prev)
    published(spark, sf_dir)
    published_index(spark, sf_dir)
    token_index(spark, sf_dir)
    gram_index(spark, sf_dir)
    document_index(spark, sf_dir)
    published_events(spark, sf_dir)
    published(spark, sf_dir, prev)
