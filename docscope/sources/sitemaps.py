"""Sitemap and robots.txt sources.

* ``robots_roots``   - ``Sitemap:`` lines (any case) of robots files, value after
  the first ``:`` trimmed, in order of first appearance (file path, then line).
* ``candidate_roots`` - robots lines first, then the well-known sitemap files
  that exist, else the default root.
* ``sitemap_files``  - every sitemap file: root tag kind (index/leaf),
  ``sitemap/loc`` children and ``url/loc`` values; a file that is not well-formed
  is ``malformed`` as a whole and has neither.
* ``expand``         - transitive closure from the roots over index files with
  a visited set (cycles end), as deep as the indexes go; ``path`` gives each
  visited file a stable position.
* ``leaf_urls``      - ``url/loc`` of the visited leaf files with a stable ``ord``
  (root, file, position), by joining the one read; nothing is collected.
* ``write_site``     - publishes sitemap/robots files for a URL table (Spark XML
  and text writers), as the documentation site does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docscope.operators.ranking import group_rank
from docscope.session import local_df

# The sitemap namespace, the well-known sitemap files (the first is
# the default root), and the protocol's limit of URLs per sitemap file.
SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
CANDIDATES = ("/sitemap.xml", "/sitemap_index.xml")
DEFAULT_ROOT = CANDIDATES[0]
MAX_URLS_PER_FILE = 50_000

_XML = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>, _corrupt_record string"
_XML_OPTIONS = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt_record"}
# the root element's name after any byte-order mark, declarations, instructions,
# comments and document type, in any number and order
_ROOT_TAG = r"(?s)^\x{FEFF}?(?:\s++|<\?.*?\?>|<!--.*?-->|<![A-Za-z][^>]*>)*+<([A-Za-z_][\w:.-]*)([^>]*)"
_DECLARED = r"""\sxmlns(?::[\w.-]+)?\s*=\s*(?:"[^"]*"|'[^']*')"""


def robots_roots(spark: SparkSession, robots_path: str, default_root: str) -> DataFrame:
    """(url, ord): distinct sitemap roots of the robots files in order of first
    appearance; ``default_root`` if they name none. Files are read whole, so a
    line's position is its own, however the files are split."""
    lines = (spark.read.text(robots_path, wholetext=True)
             .select(F.col("_metadata.file_path").alias("f"),
                     F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line", "value")))
    roots = (lines.where(F.lower(F.col("value")).startswith("sitemap:"))
             .select(F.trim(F.regexp_extract("value", r"^[^:]*:(.*)$", 1)).alias("url"),
                     F.struct("f", "line").alias("o")))
    found = roots.groupBy("url").agg(F.min("o").alias("o"))
    if found.isEmpty():
        return local_df(spark, [(default_root, 1)], "url string, ord int")
    # ranks over the distinct roots only
    return found.select("url", F.dense_rank().over(Window.orderBy("o")).alias("ord"))


def candidate_roots(spark: SparkSession, robots_path: str, files: DataFrame, base: str) -> DataFrame:
    """(url, ord): robots roots, then those well-known files below ``base`` that are
    among ``files``; the default root if there is neither."""
    known = [(base + c, i) for i, c in enumerate(CANDIDATES)]
    named = robots_roots(spark, robots_path, known[0][0]).select("url", F.lit(0).alias("g"), "ord")
    there = (local_df(spark, known, "url string, ord int").join(files.select("url"), "url", "left_semi")
             .select("url", F.lit(1).alias("g"), "ord"))
    first = named.unionByName(there).groupBy("url").agg(F.min(F.struct("g", "ord")).alias("o"))
    return first.select("url", F.row_number().over(Window.orderBy("o")).alias("ord"))


def sitemap_files(spark: SparkSession, site_dir: str) -> DataFrame:
    """(url, kind, children, locs): one row per XML file under ``site_dir``; kind is
    ``index`` when the root tag ends with ``sitemapindex``, ``leaf`` for any
    other root tag, ``malformed`` when the file is not well-formed. A file whose root is
    not in the sitemap namespace names no URLs. Every consumer of this plan reads the
    files again; ``parsed_site`` reads them once."""
    raw = (spark.read.option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.xml").text(site_dir, wholetext=True)
           .select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("content")))
    parsed = raw.select("url", F.regexp_extract("content", _ROOT_TAG, 1).alias("tag"),
                        F.regexp_extract("content", _ROOT_TAG, 2).alias("declared"),
                        F.from_xml(F.regexp_replace("content", r"^\x{FEFF}", ""), _XML, _XML_OPTIONS).alias("x"))

    prefix = F.regexp_extract("tag", r"^([^:]*):", 1)
    known = F.exists(F.regexp_extract_all("declared", F.lit(_DECLARED), F.lit(0)), lambda d: (
        (F.regexp_extract(d, r"^\sxmlns:?([\w.-]*)", 1) == prefix)
        & (F.regexp_extract(d, "[\"'](.*)[\"']", 1) == SITEMAP_NS)))

    def texts(name):
        values = F.transform(F.col(f"x.{name}"), lambda e: F.trim(e["loc"]))
        return F.coalesce(F.when(known, F.filter(values, lambda v: v.isNotNull() & (v != ""))),
                          F.array().cast("array<string>"))

    return parsed.select(
        "url",
        F.when((F.col("tag") == "") | F.col("x._corrupt_record").isNotNull(), F.lit("malformed"))
        .when(F.lower("tag").endswith("sitemapindex"), F.lit("index")).otherwise(F.lit("leaf")).alias("kind"),
        texts("sitemap").alias("children"), texts("url").alias("locs"))


def parsed_site(spark: SparkSession, site_dir: str, out_dir: str) -> DataFrame:
    """``sitemap_files`` of the site, written to ``out_dir`` and read back: the roots, every
    level of the expansion and the leaf scan read their columns of that table."""
    sitemap_files(spark, site_dir).write.mode("overwrite").parquet(out_dir)
    return spark.read.parquet(out_dir)


def expand(spark: SparkSession, roots: DataFrame, files: DataFrame) -> DataFrame:
    """Visited sitemap files (url, kind, depth, path) reachable from ``roots``.

    One round per level, until a level brings no new file: the frontier minus
    the visited set is looked up in ``files``; index children form the next
    frontier. A file listed twice or in a cycle is visited once, at its first
    path (root position, then child positions) of the least depth. Each level
    is checkpointed once (shared checkpoint folder)."""
    levels: list[DataFrame] = []
    order = F.col("ord") if "ord" in roots.columns else F.lit(1)
    frontier = roots.select("url", F.array(order.cast("int")).alias("path"))
    while True:
        new = frontier.groupBy("url").agg(F.min("path").alias("path"))
        for seen in levels:
            new = new.join(seen.select("url"), "url", "left_anti")
        fetched = new.join(files.select("url", "kind", "children"), "url").withColumn(
            "depth", F.lit(len(levels))).checkpoint(eager=True)
        if fetched.isEmpty():
            break
        levels.append(fetched)
        frontier = fetched.where(F.col("kind") == "index").select(
            "path", F.posexplode("children").alias("pos", "url")).select(
            "url", F.concat("path", F.array("pos")).alias("path"))
    visited = local_df(spark, [], "url string, kind string, depth int, path array<int>")
    for level in levels:
        visited = visited.unionByName(level.select("url", "kind", "depth", "path"))
    return visited


def leaf_urls(visited: DataFrame, files: DataFrame) -> DataFrame:
    """(url, sitemap, ord): ``url/loc`` values of the visited leaf files; ``ord``
    counts from 0 by depth, path and position in the file."""
    rows = (visited.where(F.col("kind") == "leaf").select("url", "depth", "path")
            .join(files.select("url", "locs"), "url")
            .select(F.col("url").alias("sitemap"), "depth", "path", F.posexplode("locs").alias("pos", "url"))
            .withColumn("g", F.lit(0)))
    ranked = group_rank(rows, ["g"], ["depth", "path", "sitemap", "pos"], "ord")
    return ranked.select("url", "sitemap", (F.col("ord") - 1).alias("ord"))


def write_site(urls: DataFrame, out_dir: str) -> None:
    """Leaf sitemaps per top-level folder, an index of them, and robots.txt.

    ``urls`` has (url, folder, pos). A folder's URLs are cut into chunks of
    consecutive positions holding at most 50,000 URLs, one file each, so a
    large folder is written by many tasks and no file exceeds the protocol
    limit."""
    spark = urls.sparkSession
    leaf_dir = f"{out_dir}/leaf"
    chunk = F.floor(F.col("pos") / MAX_URLS_PER_FILE).cast("long")
    (urls.select(F.col("url").alias("loc"), "folder", chunk.alias("chunk"))
     .repartition("folder", "chunk").write.mode("overwrite")
     .partitionBy("folder", "chunk").format("xml").option("rowTag", "url")
     .option("rootTag", f'urlset xmlns="{SITEMAP_NS}"').save(leaf_dir))
    leaves = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml")
              .text(leaf_dir).select(F.col("_metadata.file_path").alias("loc")).distinct())
    index_dir = f"{out_dir}/index"
    (leaves.write.mode("overwrite").format("xml").option("rowTag", "sitemap")
     .option("rootTag", f'sitemapindex xmlns="{SITEMAP_NS}"').save(index_dir))
    indexes = (spark.read.option("pathGlobFilter", "*.xml").text(index_dir)
               .select(F.col("_metadata.file_path").alias("p")).distinct())
    robots = indexes.select(F.explode(F.array(
        F.concat(F.lit("Sitemap: "), F.col("p")),
        F.concat(F.lit("SITEMAP:   "), F.col("p"), F.lit("  ")))).alias("value"))
    other = local_df(spark, [("User-agent: *",), ("Disallow: /search",)], "value string")
    other.unionByName(robots).coalesce(1).write.mode("overwrite").text(f"{out_dir}/robots")
