"""Derived inputs for the corpus operators, computed by Spark from the driver's
tables so their size follows the data.

* ``doc_urls``  - a documentation URL for every page (product root, version
  segments, locale, excluded sections, landing pages, a root-prefix trap).
* ``catalog``   - the product catalog, raw values as in a configuration file,
  typed by ``sources.catalog.typed_catalog``.
* ``doc_links`` - five links per page (absolute, with fragment, root-relative,
  fragment-only, external) pointing at another page's documentation URL.
* ``rich_pages`` - page source with meta tags, a sidebar, links, images and
  response types.
* ``topics_fx`` - topic fields with empty strings, nulls and both timestamp
  shapes, for facet, normalisation and event-time operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.session import local_df
from docscope.sources.tables import table

# The documentation host and the catalog the derived URLs are
# laid out for (pid, title, root_path, versions, exclude_path_contains).
DOC_HOST = "https://docs.example.com"
CATALOG_RAW = [
    ("core", "Core", "core", "2", ""),
    ("cloud", "Cloud", "cloud", "1", ""),
    ("suite", "Suite", "suite-8", "all", ""),
    ("ops", "Ops", "ops", "2", "[legacy-cloud]"),
    ("flow", "Flow", "flow/onsite", "none", "[legacy-cloud]"),
]
# The same catalog one configuration change earlier (fewer versions, no "suite"):
# what a previous run stored, for incremental planning.
CATALOG_RAW_PREVIOUS = [
    ("core", "Core", "core", "1", ""),
    ("cloud", "Cloud", "cloud", "1", ""),
    ("ops", "Ops", "ops", "1", "[legacy-cloud]"),
    ("flow", "Flow", "flow/onsite", "none", "[legacy-cloud]"),
]

_DOC_URL = f"""
concat('{DOC_HOST}/en/', root, '/',
  case when page_id < 6 then '' else concat(
    case when page_id % 17 = 0 then 'ja/' else '' end,
    case when ver = '' then '' else concat(ver, '/') end,
    case when page_id % 23 = 0 then '9.4/' else '' end,
    case when page_id % 19 = 0 then 'legacy-cloud' else section end,
    '/t', cast(page_id as string)) end)"""
_ROOT = """case page_id % 6 when 0 then 'core' when 1 then 'cloud' when 2 then 'suite-8'
    when 3 then 'ops' when 4 then 'flow/onsite' else 'core-extra' end"""
_VER = """case (page_id div 6) % 7 when 0 then '9.3' when 1 then '9.4' when 2 then '10.0'
    when 3 then '9.4.2' when 4 then '10.0.1' when 5 then '9.10' else '' end"""
_SECTION = """case (page_id div 42) % 4 when 0 then 'admin' when 1 then 'search'
    when 2 then 'install' else 'release-notes' end"""


def with_doc_url(pages: DataFrame) -> DataFrame:
    """Add ``doc_url`` to any frame with ``page_id`` (narrow: no shuffle)."""
    return (pages.withColumn("root", F.expr(_ROOT)).withColumn("ver", F.expr(_VER))
            .withColumn("section", F.expr(_SECTION))
            .withColumn("doc_url", F.expr(_DOC_URL)).drop("root", "ver", "section"))


# Page source of the documentation site, derived from every page: meta tags, a
# removable sidebar, a link whose tag also holds the text "href=", an image. The
# expressions below are the same in both engines.
SIDEBAR = '<div class="sidebar x">side note</div>'
META_VERSION = "concat('m', cast(page_id % 5 as varchar(20)))"
META_TYPE = "case page_id % 3 when 0 then 'task' when 1 then 'reference' else '' end"
META_MODIFIED = ("case when page_id % 4 = 3 then '' else concat('2024-', lpad(cast(1 + page_id % 12 as varchar(20)), 2, '0'), "
                 "'-', lpad(cast(1 + page_id % 28 as varchar(20)), 2, '0'), 'T00:00:00.000Z') end")
_METAS = f"""concat('<meta charset="utf-8"><meta name="Version_Number" content="', {META_VERSION},
  '"><meta name="contentType" content="', {META_TYPE}, '">', case when page_id % 4 = 3 then '' else concat(
  '<meta property="lastModifiedISO" content="', {META_MODIFIED}, '">') end)"""
_EXTRA = """concat('<p>See <a title="a href=b" href="', case page_id % 3 when 0 then '/en/core/'
  when 1 then concat('/en/core/#s', cast(page_id as varchar(20))) else 'https://other.example.org/x' end,
  '">the topic</a> <img alt="i" src="/img/p', cast(page_id % 50 as varchar(20)), '.png"></p>')"""
RICH_HTML = f"""replace(replace(html, '<meta charset="utf-8">', {_METAS}), '<article>', concat('<article>{SIDEBAR}', {_EXTRA}))"""
#: Response types: some pages are no HTML and are not captured.
CONTENT_TYPE = "case when page_id % 29 = 28 then 'application/pdf' else 'text/html; charset=utf-8' end"


def rich_pages(pages: DataFrame) -> DataFrame:
    """Pages as the site serves them: ``html`` and ``content_type`` by page (narrow)."""
    return pages.withColumn("html", F.expr(RICH_HTML)).withColumn("content_type", F.expr(CONTENT_TYPE))


#: Pages whose image the asset download has fetched.
FETCHED = "{id} % 50 % 3 = 0"


def fetched_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(abs_url): the images that have been fetched."""
    pages = table(spark, sf_dir, "pages").where(FETCHED.format(id="page_id"))
    return pages.select(F.expr(f"concat('{DOC_HOST}/img/p', cast(page_id % 50 as string), '.png')")
                        .alias("abs_url")).distinct()


def doc_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_doc_url(table(spark, sf_dir, "pages").select("page_id")).select("page_id", "doc_url")


def catalog_raw(spark: SparkSession, rows=None) -> DataFrame:
    rows = CATALOG_RAW if rows is None else rows
    return local_df(spark, [(i, *r) for i, r in enumerate(rows)],
                    "ord int, pid string, title string, root_path string, versions string, exclude string")


def doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_id, pos, href): the link targets are other pages' doc URLs."""
    urls = doc_urls(spark, sf_dir)
    # page count as a scalar subquery (evaluated once, no join)
    n = table(spark, sf_dir, "pages").agg(F.count(F.lit(1))).scalar()
    src = urls.withColumn("tgt_id", (F.col("page_id") * 7 + 3) % n)
    tgt = urls.select(F.col("page_id").alias("tgt_id"), F.col("doc_url").alias("tgt_url"))
    pairs = src.join(tgt, "tgt_id").select(F.col("page_id").alias("src_id"), "doc_url", "tgt_url")
    k = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos")
    return pairs.select("src_id", "doc_url", "tgt_url", k).select(
        "src_id", "doc_url", "pos",
        F.expr("""case pos when 0 then tgt_url
                  when 1 then concat(tgt_url, '#s', cast(src_id as string))
                  when 2 then substring(tgt_url, 25)
                  when 3 then '#top'
                  else 'https://other.example.org/x' end""").alias("href"))


def topics_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_urls(spark, sf_dir).select(
        "page_id",
        F.substring(F.sha1(F.col("doc_url")), 1, 16).alias("id"),
        F.col("doc_url").alias("url"),
        F.expr("case page_id % 4 when 0 then 'Core' when 1 then 'Cloud' when 2 then '' "
               "else null end").alias("product_title"),
        F.expr("case page_id % 5 when 0 then '' when 1 then 'task' when 2 then 'reference' "
               "when 3 then 'task' else null end").alias("content_type"),
        F.expr(_VER).alias("version"),
        F.expr("concat('2024-', lpad(cast(1 + page_id % 12 as string), 2, '0'), '-', "
               "lpad(cast(1 + page_id % 28 as string), 2, '0'), 'T00:00:00', "
               "case when page_id % 5 = 0 then 'Z' else '.000Z' end)").alias("last_modified"),
    )
