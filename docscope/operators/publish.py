"""Topic records and the published datasets (search index, event feed, nav,
topic documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscope.functions import text as X
from docscope.functions import urls as U
from docscope.operators.ranking import group_rank

# Field names and order of the published records.
TOPIC_FIELDS = ["id", "url", "title", "product", "product_title", "version", "content_type",
                "section", "breadcrumb", "last_modified", "file"]
SEARCH_FIELDS = ["id", "title", "product", "product_title", "version", "file", "text"]
EVENT_FIELDS = ["url", "title", "product", "product_title", "version", "content_type", "section",
                "last_modified", "file", "body"]
EVENT_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in EVENT_FIELDS])
NAV_LEAF = T.StructType([T.StructField(f, T.StringType()) for f in ("title", "file", "section")])

# Meta tags read from a page (og:url, version, content type,
# last modified), and the topic document shell around the cleaned article HTML.
META_NAMES = ["og:url", "Version_Number", "contentType", "lastModifiedISO"]
DOC_HEAD = ("<!doctype html><html><head><meta charset='utf-8'>"
            "<meta name='viewport' content='width=device-width,initial-scale=1'>"
            "<link rel='stylesheet' href='../assets/topic.css'>")


def topic_records(parsed: DataFrame) -> DataFrame:
    """Topic record per parsed planned page.

    Input: plan columns (``id``, ``url`` crawled, ``path``, ``segs``, ``pid``,
    ``product_title``, ``root_path``, ``pord``, ``uord``) + ``page`` struct
    from ``parse_pages``. ``url`` becomes ``og:url`` when present; ``id`` and
    ``file`` stay from the crawled URL. ``version``: first URL version segment,
    else the ``Version_Number`` meta, else ``""``.

    Staged in two projections so each lookup is evaluated once per row.
    """
    m = F.col("page.metas")
    staged = parsed.select(
        "id", "url", "pid", "product_title", "segs", "pord", "uord", "page",
        U.path_breadcrumb(F.col("path"), F.col("root_path")).alias("_crumbs"),
        *[X.meta_entry(m, n).alias(f"_m{i}") for i, n in enumerate(META_NAMES)])
    return staged.select(
        "id",
        F.coalesce(F.nullif(X.meta_content("_m0"), F.lit("")), F.col("url")).alias("url"),
        X.clean_title(F.col("page.title_raw"), F.col("page.h1")).alias("title"),
        F.col("pid").alias("product"),
        "product_title",
        F.coalesce(F.try_element_at("segs", F.lit(1)), X.meta_content("_m1")).alias("version"),
        X.meta_content("_m2").alias("content_type"),
        U.first_or_empty("_crumbs").alias("section"),
        # the reference's section of a versioned topic is its version; the
        # first breadcrumb that is not a version names the section itself
        U.first_or_empty(F.filter("_crumbs", lambda x: ~x.rlike(U.VERSION_SEGMENT))).alias("section_name"),
        F.col("_crumbs").alias("breadcrumb"),
        X.meta_content("_m3").alias("last_modified"),
        F.concat(F.col("id"), F.lit(".html")).alias("file"),
        F.col("url").alias("crawl_url"),
        F.col("page.content_node").alias("content_node"),
        F.col("page.text").alias("text"),
        F.col("page.parts").alias("parts"),
        "pord", "uord",
    )


def search_index(topics: DataFrame) -> DataFrame:
    return topics.select("id", "title", "product", "product_title", "version", "file",
                         X.excerpt("text").alias("text"), "pord", "uord")


def event_rows(topics: DataFrame) -> DataFrame:
    """Event feed rows: no ``id``/``breadcrumb``; full text as ``body``."""
    return topics.select(*EVENT_FIELDS[:-1], F.col("text").alias("body"))


def nav_rows(topics: DataFrame) -> DataFrame:
    """Flat navigation rows: product title -> version (``—`` if none) -> leaf."""
    return topics.select("product_title", X.or_default("version", X.UNVERSIONED).alias("version"),
                         "title", "file", "section", "pord", "uord")


# Leaves per navigation chunk: a product/version list is published in blocks
# of consecutive sitemap positions so no single group grows with the corpus.
NAV_BLOCK = 10_000


def nav_tree(topics: DataFrame, block: int = NAV_BLOCK) -> DataFrame:
    """Nested navigation in bounded pieces: one row per (product title, version,
    block of sitemap positions) with its leaves in arrival order. Reading the
    rows ordered by (product_title, first, version, block) gives the nested
    map product -> version -> leaves of the published navigation file."""
    rows = nav_rows(topics).withColumn("block", F.struct("pord", (F.col("uord") / block).cast("long").alias("b")))
    leaf = F.struct("pord", "uord", "title", "file", "section")
    return (rows.groupBy("product_title", "version", "block")
            .agg(F.sort_array(F.collect_list(leaf)).alias("l"))
            .select("product_title", "version", "block",
                    F.transform("l", lambda x: F.struct(x["title"].alias("title"), x["file"].alias("file"),
                                                        x["section"].alias("section"))).alias("leaves")))


# Leaves in one row of the navigation map; part of the format, whatever the corpus' size.
NAV_CHUNK = 5_000
NAV_SCHEMA = T.StructType([
    T.StructField("product_title", T.StringType()), T.StructField("chunk", T.LongType()),
    T.StructField("versions", T.MapType(T.StringType(), T.ArrayType(NAV_LEAF)))])


def nav_map(topics: DataFrame, chunk: int = NAV_CHUNK) -> DataFrame:
    """The navigation map product -> version -> leaves: a product's versions in order of their
    first leaf, the leaves of each in arrival order. A product's leaves are numbered in that order
    (by ranges, no product is one task) and every ``chunk`` of them is one row, so that a map
    holds at most so many leaves; a version that crosses chunks goes on in the next row's map.
    Product titles are not null (the catalog's are typed)."""
    rows = nav_rows(topics)
    order = ["pord", "uord", "file"]
    first = rows.groupBy("product_title", "version").agg(F.min(F.struct(*order)).alias("first"))
    placed = (rows.alias("r").join(first.alias("f"), (F.col("r.product_title") == F.col("f.product_title"))
                                   & (F.col("r.version") == F.col("f.version")))
              .select("r.*", *[F.col(f"f.first.{c}").alias(f"v{c}") for c in order]))
    ranked = group_rank(placed, ["product_title"], [*[f"v{c}" for c in order], *order], "pos")
    # one exchange serves both groupings: equal (product, chunk) lie together
    dealt = ranked.withColumn("chunk", F.floor((F.col("pos") - 1) / chunk)).repartition("product_title", "chunk")
    leaves = dealt.groupBy("product_title", "chunk", "version").agg(
        F.sort_array(F.collect_list(F.struct("pos", "title", "file", "section"))).alias("l"))
    versions = leaves.groupBy("product_title", "chunk").agg(F.sort_array(F.collect_list(F.struct(
        F.col("l")[0]["pos"].alias("at"), "version",
        F.transform("l", lambda x: x.dropFields("pos")).alias("leaves")))).alias("v"))
    return versions.select("product_title", "chunk", F.map_from_entries(
        F.transform("v", lambda x: x.dropFields("at"))).alias("versions"))


def write_nav(topics: DataFrame, path: str, chunk: int = NAV_CHUNK) -> None:
    nav_map(topics, chunk).write.mode("overwrite").json(path)


def read_nav(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NAV_SCHEMA).json(path)


def nav_leaves(nav: DataFrame, chunk: int = NAV_CHUNK) -> DataFrame:
    """The leaves of a navigation map, each with its place in its product's list (from 0)."""
    sizes = F.transform(F.map_values("versions"), lambda x: F.size(x))
    lists = nav.withColumn("sizes", sizes).select(
        "product_title", "chunk", "sizes", F.posexplode("versions").alias("v", "version", "leaves"))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("v")), F.lit(0), lambda a, n: a + n)
    return lists.select("product_title", "chunk", "version", before.alias("before"),
                        F.posexplode("leaves").alias("i", "l")).select(
        "product_title", "version", "l.title", "l.file", "l.section",
        (F.col("chunk") * chunk + F.col("before") + F.col("i")).alias("pos"))


def topic_docs(topics: DataFrame) -> DataFrame:
    """Complete HTML document per topic (``html_doc``), named by ``file``."""
    body = F.array_join(F.transform("parts", lambda p: F.when(
        p["kind"] == "html", p["value"]).otherwise(F.concat(F.lit('"'), U.html_escape(p["value"], quote=True),
                                                            F.lit('"')))), "")
    return topics.select("id", "file", F.concat(
        F.lit(DOC_HEAD), F.lit("<title>"), U.html_escape("title"), F.lit("</title></head>"),
        F.lit("<body><article class='topic'>"), body, F.lit("</article></body></html>")).alias("html_doc"))
