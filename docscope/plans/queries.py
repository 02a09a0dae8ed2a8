"""Registered queries: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and the
DuckDB oracle ``ORACLE[name]`` computing the same rows.

Every query reads the driver's tables (or data Spark derives from them) in
full. Limits appear only where they are the feature (search hit cap, plan
limit, result pages).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docscope.functions import text as X
from docscope.functions import urls as U
from docscope.operators import coverage as CV
from docscope.operators import plan as PL
from docscope.operators import publish as PB
from docscope.operators import search as S
from docscope.operators import textindex as TI
from docscope.plans import corpus as C
from docscope.plans import fixtures as FX
from docscope.plans.oracle import PATH_RE, sql
from docscope.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Fixed parameters of the registered queries.
SEARCH_QUERY = "ing"
KEYWORDS = ["the", "of"]
PLAN_LIMIT = 50
RESULT_PAGE = 1
BROWSE_PRODUCT, BROWSE_VERSION = "Suite", "9.4"
FACET_CATEGORY = "Core"
FACET_CONTENT_TYPE = "task"
LOOKUP_URL = "https://docs.example.com/en/core/"


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _topics(spark, sf):
    return C.published(spark, sf)


# --------------------------------------------------------------------------- #
# URL functions and derived views
# --------------------------------------------------------------------------- #
@register("topic_ids", sql("SELECT page_id, doc_url, substring(sha1(doc_url), 1, 16) AS id FROM doc_urls",
                           "doc_urls"))
def q_topic_ids(spark, sf):
    return FX.doc_urls(spark, sf).select("page_id", "doc_url", U.topic_id("doc_url").alias("id"))


@register("url_parts", f"""SELECT page_id, url,
  regexp_replace(regexp_extract(url, '{PATH_RE}', 1), ';[^/]*$', '') AS path,
  split_part(url, '#', 1) AS url_key,
  substring(url, length(split_part(url, '#', 1)) + 1) AS fragment
FROM pages""")
def q_url_parts(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", "url", U.url_path("url").alias("path"), U.url_key("url").alias("url_key"),
        U.url_fragment("url").alias("fragment"))


@register("version_segments", sql("""SELECT page_id, doc_url,
  array_to_string(list_filter(string_split(path, '/'), lambda x: regexp_matches(x, '^[0-9]+[.][0-9]+([.][0-9]+)?$')), ',') AS segs
FROM (SELECT page_id, doc_url, u.path FROM doc_urls JOIN u ON u.url = doc_urls.doc_url) q""", "doc_urls", "u"))
def q_version_segments(spark, sf):
    d = FX.doc_urls(spark, sf)
    return d.select("page_id", "doc_url",
                    F.array_join(U.version_segments(U.url_path("doc_url")), ",").alias("segs"))


@register("version_order", sql("""SELECT version, dense_rank() OVER (ORDER BY
  list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER)) DESC) AS vrank
FROM (SELECT DISTINCT unnest(list_filter(string_split(path, '/'), lambda x: regexp_matches(x, '^[0-9]+[.][0-9]+([.][0-9]+)?$'))) AS version FROM u) q""",
                               "u"))
def q_version_order(spark, sf):
    """Pipeline version order over every version seen in the sitemap; the rank
    runs over distinct versions only."""
    v = (FX.doc_urls(spark, sf).select(F.explode(U.version_segments(U.url_path("doc_url"))).alias("version"))
         .distinct())
    return v.withColumn("vrank", F.dense_rank().over(Window.orderBy(F.desc(U.version_key("version")))))


@register("breadcrumbs", sql("""SELECT pid, url, array_to_string(crumbs, '/') AS breadcrumb, coalesce(crumbs[1], '') AS section
FROM (SELECT pid, url, CASE WHEN list_slice(p, 1, len(rs)) = rs THEN list_slice(p, len(rs) + 1, len(p)) ELSE p END AS crumbs
  FROM (SELECT pid, url, string_split(root_path, '/') AS rs,
          CASE WHEN len(p0) > 0 AND p0[1] = 'en' THEN list_slice(p0, 2, len(p0)) ELSE p0 END AS p
        FROM (SELECT pid, url, root_path, list_filter(string_split(path, '/'), lambda x: x <> '') AS p0 FROM m) a) b) c""",
                             "m"))
def q_breadcrumbs(spark, sf):
    m = PL.product_urls(C.sitemap_urls(spark, sf), C.catalog(spark))
    cr = m.select("pid", "url", U.path_breadcrumb(F.col("path"), F.col("root_path")).alias("c"))
    return cr.select("pid", "url", F.array_join("c", "/").alias("breadcrumb"), U.first_or_empty("c").alias("section"))


@register("asset_names", """SELECT page_id, url, substring(sha1(url), 1, 16) ||
  coalesce(nullif(left(regexp_extract(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''),
    '[^/.][^/]*?(\\.[^./]*)$', 1), 5), ''), '.img') AS file
FROM pages""")
def q_asset_names(spark, sf):
    """Local asset file name for every page URL taken as an image address."""
    return table(spark, sf, "pages").select("page_id", "url", U.asset_file("url").alias("file"))


@register("html_escape", sql("""SELECT page_id, replace(replace(replace(coalesce(title_raw, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped
FROM parsed""", "parsed"))
def q_html_escape(spark, sf):
    p = C.published_pages(spark, sf)
    return p.select("page_id", U.html_escape(F.col("page.title_raw")).alias("escaped"))


# --------------------------------------------------------------------------- #
# Planning
# --------------------------------------------------------------------------- #
@register("product_urls", sql("SELECT pid, product_title, url FROM m", "m"))
def q_product_urls(spark, sf):
    return PL.product_urls(C.sitemap_urls(spark, sf), C.catalog(spark)).select("pid", "product_title", "url")


@register("product_urls_prefix_join", sql("SELECT pid, product_title, url FROM m", "m"))
def q_product_urls_prefix_join(spark, sf):
    """The match through the equi-join on candidate root prefixes, under its own key."""
    return PL.product_urls(C.sitemap_urls(spark, sf), C.catalog(spark)).select("pid", "product_title", "url")


@register("locale_filter", sql("""SELECT page_id, doc_url, contains(doc_url, '/ja-jp/') OR contains(doc_url, '/ja/') AS is_locale
FROM doc_urls""", "doc_urls"))
def q_locale_filter(spark, sf):
    d = FX.doc_urls(spark, sf)
    loc = F.lit(False)
    for m in PL.LOCALE_MARKERS:
        loc = loc | F.contains(F.col("doc_url"), F.lit(m))
    return d.select("page_id", "doc_url", loc.alias("is_locale"))


@register("product_versions", sql("SELECT DISTINCT pid, unnest(segs) AS version FROM m", "m"))
def q_product_versions(spark, sf):
    m = PL.product_urls(C.sitemap_urls(spark, sf), C.catalog(spark))
    return m.select("pid", F.explode("segs").alias("version")).distinct()


@register("newest_versions", sql("SELECT pid, url FROM plan", "plan"))
def q_newest_versions(spark, sf):
    return C.plan(spark, sf).select("pid", "url")


@register("plan_limit", sql(f"SELECT pid, url, pord, uord FROM plan ORDER BY pord, uord LIMIT {PLAN_LIMIT}", "plan"))
def q_plan_limit(spark, sf):
    return PL.plan_limit(C.plan(spark, sf), PLAN_LIMIT).select("pid", "url", "pord", "uord")


@register("dedup_topics", sql("SELECT id, pid, url, pord, uord FROM planned", "planned"))
def q_dedup_topics(spark, sf):
    return PL.dedup_by_id(C.plan(spark, sf)).select("id", "pid", "url", "pord", "uord")


@register("incremental_todo", sql("""SELECT id, pid, url FROM planned
WHERE id NOT IN (SELECT id FROM prev_planned)""", "planned", "prev_planned"))
def q_incremental_todo(spark, sf):
    new = PL.dedup_by_id(C.published_plan(spark, sf))
    stored = PL.dedup_by_id(C.published_plan(spark, sf, FX.CATALOG_RAW_PREVIOUS))
    return PL.incremental_todo(new, stored).select("id", "pid", "url")


@register("union_urls", sql(f"""SELECT doc_url AS url, 'topics' AS sitemap FROM doc_urls
UNION ALL
SELECT DISTINCT concat('{FX.DOC_HOST}/en/', array_to_string(list_slice(string_split(path, '/'), 3, 3), '/'), '/') AS url, 'landing' AS sitemap
FROM u""", "doc_urls", "u"))
def q_union_urls(spark, sf):
    """Bag union of two leaf sitemaps: all topic URLs, and one landing URL per
    top-level product folder (these repeat some topic URLs)."""
    d = FX.doc_urls(spark, sf)
    topics = d.select(F.col("doc_url").alias("url"), F.lit("topics").alias("sitemap"))
    folder = F.element_at(F.split(U.url_path("doc_url"), "/"), 3)
    landing = (d.select(F.concat(F.lit(f"{FX.DOC_HOST}/en/"), folder, F.lit("/")).alias("url")).distinct()
               .withColumn("sitemap", F.lit("landing")))
    return topics.unionByName(landing)


# --------------------------------------------------------------------------- #
# Parse and publish
# --------------------------------------------------------------------------- #
@register("pages_html", sql("""SELECT pl.id, pl.url, length(p.html) AS n_chars
FROM planned pl JOIN doc_urls d ON d.doc_url = pl.url JOIN rich p ON p.page_id = d.page_id
WHERE p.content_type LIKE 'text/html%'""", "planned", "doc_urls", "rich"))
def q_pages_html(spark, sf):
    p = PL.dedup_by_id(C.published_plan(spark, sf))
    pages = C.html_pages(C.crawled_pages(spark, sf))
    return p.join(pages, "url").select("id", "url", F.length("html").alias("n_chars"))


@register("page_titles", sql("SELECT page_id, title FROM parsed", "parsed"))
def q_page_titles(spark, sf):
    p = C.published_pages(spark, sf)
    return p.select("page_id", X.clean_title(F.col("page.title_raw"), F.col("page.h1")).alias("title"))


@register("page_text", sql("SELECT page_id, text FROM parsed", "parsed"))
def q_page_text(spark, sf):
    p = C.published_pages(spark, sf)
    return p.select("page_id", F.col("page.text").alias("text"))


@register("main_content", sql("SELECT page_id, content_node, length(text) AS n_chars FROM parsed", "parsed"))
def q_main_content(spark, sf):
    p = C.published_pages(spark, sf)
    return p.select("page_id", F.col("page.content_node").alias("content_node"),
                    F.length("page.text").alias("n_chars"))


_META_ATTR = """regexp_extract(tag, '\\s{a}\\s*=\\s*"([^"]*)"', 1)"""


@register("page_meta", sql(f"""SELECT page_id, 'name' AS attr, {_META_ATTR.format(a='name')} AS name, {_META_ATTR.format(a='content')} AS content
FROM m WHERE regexp_matches(tag, '\\sname\\s*=')
UNION ALL
SELECT page_id, 'property' AS attr, {_META_ATTR.format(a='property')} AS name, {_META_ATTR.format(a='content')} AS content
FROM m WHERE regexp_matches(tag, '\\sproperty\\s*=')""".replace("FROM m WHERE", "FROM (SELECT page_id, "
    "unnest(regexp_extract_all(html, '(?i)<meta\\b[^>]*>')) AS tag FROM rich) m WHERE"), "rich"))
def q_page_meta(spark, sf):
    """Meta tags of every page (name/property, content)."""
    p = C.published_pages(spark, sf)
    return p.select("page_id", F.explode("page.metas").alias("m")).select(
        "page_id", "m.attr", "m.name", "m.content")


@register("topic_records", sql("""SELECT id, url, title, product, product_title, version, content_type, section,
  array_to_string(breadcrumb, '/') AS breadcrumb, last_modified, file, section_name FROM topics""", "topics"))
def q_topic_records(spark, sf):
    t = _topics(spark, sf)
    return t.select(*[F.array_join("breadcrumb", "/").alias("breadcrumb") if c == "breadcrumb" else F.col(c)
                      for c in PB.TOPIC_FIELDS], "section_name")


@register("search_index", sql("""SELECT id, title, product, product_title, version, file, left(text, 1200) AS text
FROM topics""", "topics"))
def q_search_index(spark, sf):
    return C.published_index(spark, sf).select(*PB.SEARCH_FIELDS)


@register("ndjson_rows", sql("""SELECT url, title, product, product_title, version, content_type, section,
  last_modified, file, text AS body FROM topics""", "topics"))
def q_ndjson_rows(spark, sf):
    return PB.event_rows(_topics(spark, sf))


@register("nav_rows", sql("SELECT product_title, version, title, file, section FROM nav", "nav"))
def q_nav_rows(spark, sf):
    return PB.nav_rows(_topics(spark, sf)).drop("pord", "uord")


@register("nav_tree")
def q_nav_tree(spark, sf):
    return PB.nav_tree(_topics(spark, sf))


_DOC_HEAD_SQL = PB.DOC_HEAD.replace("'", "''")


@register("topic_docs", sql(f"""SELECT id, file, concat('{_DOC_HEAD_SQL}', '<title>', replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</title></head>',
  '<body><article class=''topic''>', body_html, '</article></body></html>') AS html_doc FROM topics""", "topics"))
def q_topic_docs(spark, sf):
    return PB.topic_docs(_topics(spark, sf))


# --------------------------------------------------------------------------- #
# Search side
# --------------------------------------------------------------------------- #
@register("total_topics", sql("SELECT count(*) AS total FROM topics", "topics"))
def q_total_topics(spark, sf):
    return C.stored_total(spark, sf, "topics")


@register("substring_search", sql(f"""SELECT row_number() OVER (ORDER BY pord, uord) AS hit_rank, id, title, product_title, version, file,
  product_title || CASE WHEN version <> '' THEN ' · v' || version ELSE '' END AS tag,
  (SELECT count(*) FROM topics WHERE contains(lower(title), '{SEARCH_QUERY}') OR contains(lower(coalesce(left(text, 1200), '')), '{SEARCH_QUERY}')) AS total_hits
FROM (SELECT * FROM topics WHERE contains(lower(title), '{SEARCH_QUERY}') OR contains(lower(coalesce(left(text, 1200), '')), '{SEARCH_QUERY}')
      ORDER BY pord, uord LIMIT 200) h""", "topics"))
def q_substring_search(spark, sf):
    hits = TI.substring_search(C.published_index(spark, sf), "id", C.gram_index(spark, sf), SEARCH_QUERY,
                               ["title", "text"])
    total = hits.agg(F.count(F.lit(1))).scalar()  # the true count, beside the capped list
    top = S.first_in_index_order(hits)
    w = Window.orderBy("pord", "uord")  # over at most 200 rows
    return top.select(
        F.row_number().over(w).alias("hit_rank"), "id", "title", "product_title", "version", "file",
        X.hit_tag("product_title", "version").alias("tag"), total.alias("total_hits"))


def _events(spark, sf):
    return PB.event_rows(_topics(spark, sf))


def _keyword_hits(spark, sf):
    """The topics that hold all keywords, by index."""
    topics = _topics(spark, sf).withColumnRenamed("text", "body")
    return TI.keyword_search(topics, "id", *C.token_index(spark, sf), KEYWORDS, ["title", "body"])


_KW_WHERE = " AND ".join(f"(title ILIKE '%{t}%' OR text ILIKE '%{t}%')" for t in KEYWORDS)


@register("keyword_search", sql(f"""SELECT coalesce(nullif(product_title, ''), 'Other') AS product_title, title,
  coalesce(nullif(version, ''), '—') AS version, content_type, url
FROM topics WHERE {_KW_WHERE}""", "topics"))
def q_keyword_search(spark, sf):
    ev = S.normalise(_keyword_hits(spark, sf), ("product_title", "version"))
    return ev.select("product_title", "title", "version", "content_type", "url").orderBy("product_title", "title")


@register("page_of_results", sql(f"""SELECT product_title, title, version, content_type, url FROM (
  SELECT coalesce(nullif(product_title, ''), 'Other') AS product_title, title,
    coalesce(nullif(version, ''), '—') AS version, content_type, url
  FROM topics WHERE {_KW_WHERE}) q
ORDER BY product_title, title, url LIMIT {S.PAGE_SIZE_TABLE} OFFSET {RESULT_PAGE * S.PAGE_SIZE_TABLE}""", "topics"))
def q_page_of_results(spark, sf):
    ev = S.normalise(_keyword_hits(spark, sf), ("product_title", "version"))
    return S.paginate(ev.select("product_title", "title", "version", "content_type", "url"),
                      ["product_title", "title", "url"], RESULT_PAGE, S.PAGE_SIZE_TABLE)


# topic lists stand in the root locale's order
_LIST_ORDER = "icu_sort_key(section, 'und'), section, icu_sort_key(title, 'und'), title, file"


@register("browse", sql(f"""SELECT title, file, section, row_number() OVER (ORDER BY {_LIST_ORDER}) AS item_rank
FROM nav WHERE product_title = '{BROWSE_PRODUCT}' AND version = '{BROWSE_VERSION}'""", "nav"))
def q_browse(spark, sf):
    nav = PB.nav_rows(_topics(spark, sf))
    b = S.browse(nav, BROWSE_PRODUCT, BROWSE_VERSION)
    # one (product, version) list, ranked in topic-list order
    return S.ranked_list(b).select("title", "file", "section", "item_rank")


_BKEY = """list_concat(list_transform(string_split(version, '.'), lambda x: coalesce(TRY_CAST(x AS INTEGER), 0)),
  list_transform(range(greatest(0, 3 - len(string_split(version, '.')))), lambda x: 0))"""


@register("browse_versions", sql(f"""SELECT product_title, version,
  row_number() OVER (PARTITION BY product_title ORDER BY {_BKEY} DESC, fp, fu) AS vrank
FROM (SELECT product_title, version, min(pord) AS fp, arg_min(uord, pord * 1000000000000 + uord) AS fu
      FROM nav GROUP BY product_title, version) q""", "nav"))
def q_browse_versions(spark, sf):
    return S.version_ranks(PB.nav_rows(_topics(spark, sf))).select("product_title", "version", "vrank")


@register("default_version", sql(f"""SELECT product_title, version AS default_version FROM (
  SELECT product_title, version,
    row_number() OVER (PARTITION BY product_title ORDER BY {_BKEY} DESC, fp, fu) AS vrank
  FROM (SELECT product_title, version, min(pord) AS fp, arg_min(uord, pord * 1000000000000 + uord) AS fu
        FROM nav GROUP BY product_title, version) q) r WHERE vrank = 1""", "nav"))
def q_default_version(spark, sf):
    r = S.version_ranks(PB.nav_rows(_topics(spark, sf)))
    return r.where(F.col("vrank") == 1).select("product_title", F.col("version").alias("default_version"))


@register("version_labels", sql("""SELECT DISTINCT product_title, version,
  CASE WHEN version = '—' THEN 'Unversioned' ELSE 'v' || version END AS label
FROM nav""", "nav"))
def q_version_labels(spark, sf):
    nav = PB.nav_rows(_topics(spark, sf))
    return nav.select("product_title", "version").distinct().withColumn("label", X.version_label("version"))


@register("section_breaks", sql(f"""SELECT product_title, version, title, file, section,
  lag(section) OVER w IS NULL OR lag(section) OVER w <> section AS is_break,
  CASE WHEN section = '' THEN 'General' ELSE section END AS heading,
  row_number() OVER w AS item_rank
FROM nav WINDOW w AS (PARTITION BY product_title, version ORDER BY {_LIST_ORDER})""", "nav"))
def q_section_breaks(spark, sf):
    return S.section_breaks(PB.nav_rows(_topics(spark, sf)))


@register("hits_in_nav", sql(f"""SELECT h.id, h.product_title, coalesce(nullif(h.version, ''), '—') AS version FROM
  (SELECT * FROM topics WHERE contains(lower(title), '{SEARCH_QUERY}') OR contains(lower(coalesce(left(text, 1200), '')), '{SEARCH_QUERY}')
   ORDER BY pord, uord LIMIT 200) h
WHERE h.product_title IN (SELECT product_title FROM prev_topics)""", "topics", "prev_topics"))
def q_hits_in_nav(spark, sf):
    hits = S.first_in_index_order(S.substring_hits(C.published_index(spark, sf), SEARCH_QUERY))
    # the navigation of the previous run, which lacks a product that the index has
    nav = PB.nav_rows(C.published(spark, sf, FX.CATALOG_RAW_PREVIOUS))
    nav_products = nav.select("product_title").distinct()
    return (hits.join(nav_products, "product_title", "left_semi")
            .select("id", "product_title", X.or_default("version", X.UNVERSIONED).alias("version")))


@register("topic_lookup", sql(f"""SELECT id, title, product_title, file FROM topics
WHERE file = substring(sha1('{LOOKUP_URL}'), 1, 16) || '.html'""", "topics"))
def q_topic_lookup(spark, sf):
    t = _topics(spark, sf)
    f = F.concat(U.topic_id(F.lit(LOOKUP_URL)), F.lit(".html"))
    return t.where(F.col("file") == f).select("id", "title", "product_title", "file")


@register("product_order", sql("""SELECT product_title, min(pord) AS first_pord, min(pord * 1000000000000 + uord) AS first_pos
FROM nav GROUP BY product_title""", "nav"))
def q_product_order(spark, sf):
    nav = PB.nav_rows(_topics(spark, sf))
    return nav.groupBy("product_title").agg(
        F.min("pord").alias("first_pord"),
        F.min(F.col("pord").cast("long") * F.lit(1000000000000) + F.col("uord")).alias("first_pos"))


# --------------------------------------------------------------------------- #
# Facets and normalisation (topic fixture with empty and missing fields)
# --------------------------------------------------------------------------- #
@register("normalised_fields", sql("SELECT page_id, category, product_title, content_type, version FROM fx_norm",
                                   "fx_norm"))
def q_normalised_fields(spark, sf):
    return S.normalise(FX.topics_fx(spark, sf)).select("page_id", "category", "product_title",
                                                        "content_type", "version")


def _facet(field):
    return sql(f"""SELECT {field}, count(*) AS count FROM (SELECT product_title AS category, * FROM topics_fx) q
WHERE {field} IS NOT NULL AND {field} <> '' GROUP BY {field}""", "topics_fx")


@register("facet_category", _facet("category"))
def q_facet_category(spark, sf):
    fx = FX.topics_fx(spark, sf).withColumn("category", F.col("product_title"))
    return S.facet_order(S.facet_counts(fx, "category"), "category")


@register("facet_content_type", _facet("content_type"))
def q_facet_content_type(spark, sf):
    return S.facet_order(S.facet_counts(FX.topics_fx(spark, sf), "content_type"), "content_type")


@register("facet_product", _facet("product_title"))
def q_facet_product(spark, sf):
    return S.facet_order(S.facet_counts(FX.topics_fx(spark, sf), "product_title"), "product_title")


@register("facet_version", sql(f"""SELECT version, count(*) AS count FROM topics_fx
WHERE product_title ILIKE '{FACET_CATEGORY}' AND version IS NOT NULL AND version <> '' GROUP BY version""",
                               "topics_fx"))
def q_facet_version(spark, sf):
    fx = FX.topics_fx(spark, sf).withColumn("category", F.col("product_title"))
    return S.version_facet(fx, FACET_CATEGORY).orderBy(F.desc(U.version_key("version")))


@register("facet_filter", sql(f"""SELECT page_id, category, title_url, version, content_type FROM (
  SELECT page_id, category, url AS title_url, version, content_type FROM fx_norm) q
WHERE category ILIKE '{FACET_CATEGORY}' AND content_type ILIKE '{FACET_CONTENT_TYPE}'""", "fx_norm"))
def q_facet_filter(spark, sf):
    fx = S.normalise(FX.topics_fx(spark, sf))
    sel = S.facet_filter(fx, category=FACET_CATEGORY, content_type=FACET_CONTENT_TYPE, version="*")
    return sel.select("page_id", "category", F.col("url").alias("title_url"), "version", "content_type")


# --------------------------------------------------------------------------- #
# Links
# --------------------------------------------------------------------------- #
def _resolved_links(spark, sf):
    links = FX.doc_links(spark, sf)
    return U.with_resolved_url(links, "doc_url", "href", "abs_url").select("src_id", "pos", "href", "abs_url")


@register("resolve_links", sql("""SELECT src_id, pos, href, CASE
  WHEN starts_with(href, '#') THEN split_part(doc_url, '#', 1) || href
  WHEN starts_with(href, '/') THEN 'https://docs.example.com' || href
  ELSE href END AS abs_url FROM doc_links""", "doc_links"))
def q_resolve_links(spark, sf):
    return _resolved_links(spark, sf)


@register("link_rewrite", sql("""SELECT l.src_id, l.pos, l.href,
  CASE WHEN p.url IS NOT NULL THEN p.id || '.html' || substring(l.abs_url, length(split_part(l.abs_url, '#', 1)) + 1)
       ELSE l.href END AS new_href
FROM (SELECT src_id, pos, href, CASE
  WHEN starts_with(href, '#') THEN split_part(doc_url, '#', 1) || href
  WHEN starts_with(href, '/') THEN 'https://docs.example.com' || href
  ELSE href END AS abs_url FROM doc_links) l
LEFT JOIN (SELECT DISTINCT url, substring(sha1(url), 1, 16) AS id FROM plan) p ON p.url = split_part(l.abs_url, '#', 1)""",
                             "doc_links", "plan"))
def q_link_rewrite(spark, sf):
    from docscope.operators.links import rewrite_links
    return rewrite_links(_resolved_links(spark, sf), C.published_plan(spark, sf).select("url"))


# --------------------------------------------------------------------------- #
# Coverage and run totals
# --------------------------------------------------------------------------- #
def _captured(spark, sf, catalog_rows=None):
    """Topics a run captured: its deduplicated plan joined to the HTML pages."""
    p = PL.dedup_by_id(C.published_plan(spark, sf, catalog_rows))
    pages = C.html_pages(C.crawled_pages(spark, sf)).select("url")
    return p.join(pages, "url", "left_semi")


def _coverage(spark, sf):
    cat = C.catalog(spark)
    stored = _captured(spark, sf, FX.CATALOG_RAW_PREVIOUS).select("id", F.col("pid").alias("product"))
    return CV.coverage(cat, C.published_plan(spark, sf), stored)


_COVERAGE_SQL = """SELECT c.pid AS id, c.title, coalesce(o.n, 0) AS online_count, coalesce(l.n, 0) AS local_count,
  greatest(0, coalesce(o.n, 0) - coalesce(l.n, 0)) AS missing_count
FROM catalog c
LEFT JOIN (SELECT pid, count(*) AS n FROM plan GROUP BY pid) o ON o.pid = c.pid
LEFT JOIN (SELECT product AS pid, count(*) AS n FROM prev_topics GROUP BY product) l ON l.pid = c.pid"""


@register("coverage", sql(_COVERAGE_SQL, "catalog", "plan", "prev_topics"))
def q_coverage(spark, sf):
    return _coverage(spark, sf).select("id", "title", "online_count", "local_count", "missing_count")


@register("coverage_summary", sql(f"""SELECT bool_or(missing_count > 0) AS updates_available, count(*) AS products,
  sum(missing_count) AS missing_total FROM ({_COVERAGE_SQL}) r""", "catalog", "plan", "prev_topics"))
def q_coverage_summary(spark, sf):
    return CV.coverage_summary(_coverage(spark, sf))


@register("coverage_keys", sql("""SELECT pid, count(*) AS missing_keys FROM planned
WHERE id NOT IN (SELECT id FROM prev_topics) GROUP BY pid""", "planned", "prev_topics"))
def q_coverage_keys(spark, sf):
    planned = PL.dedup_by_id(C.published_plan(spark, sf))
    stored = _captured(spark, sf, FX.CATALOG_RAW_PREVIOUS)
    return CV.coverage_keys(planned, stored)


@register("run_totals", sql("""SELECT (SELECT count(*) FROM doc_urls) AS urls_in_sitemaps,
  (SELECT count(*) FROM plan) AS planned,
  (SELECT count(*) FROM topics) AS captured,
  CASE WHEN (SELECT count(*) FROM planned) > 0 THEN CAST(round(100.0 * (SELECT count(*) FROM topics) / (SELECT count(*) FROM planned)) AS BIGINT) ELSE 0 END AS progress_pct,
  (SELECT count(*) FROM topics) AS topic_count""", "doc_urls", "plan", "planned", "topics"))
def q_run_totals(spark, sf):
    count = F.count(F.lit(1))
    planned = PL.dedup_by_id(C.published_plan(spark, sf))
    t = spark.range(1).select(
        C.sitemap_urls(spark, sf).agg(count).scalar().alias("urls_in_sitemaps"),
        C.stored_total(spark, sf, "plan").scalar().alias("planned"),
        planned.agg(count).scalar().alias("topics_planned"),
        C.stored_total(spark, sf, "topics").scalar().alias("captured"),
        C.stored_total(spark, sf, "search_index").scalar().alias("indexed"))
    # done: the planned topics that were captured (responses that are no HTML are not);
    # the stored count falls back to the search index size when unset
    return t.select("urls_in_sitemaps", "planned", "captured",
                    CV.progress_pct(F.col("captured"), F.col("topics_planned")).alias("progress_pct"),
                    F.coalesce(F.nullif(F.col("captured"), F.lit(0)), F.col("indexed")).alias("topic_count"))


@register("run_totals_repeat", sql("""SELECT * FROM (WITH todo AS (SELECT id, url FROM planned WHERE id NOT IN (SELECT id FROM topics)),
  got AS (SELECT t.id FROM todo t JOIN doc_urls d ON d.doc_url = t.url JOIN parsed p ON p.page_id = d.page_id AND p.is_html)
SELECT (SELECT count(*) FROM todo) AS planned,
  (SELECT count(*) FROM got) AS captured,
  CASE WHEN (SELECT count(*) FROM todo) > 0 THEN CAST(round(100.0 * (SELECT count(*) FROM got) / (SELECT count(*) FROM todo)) AS BIGINT) ELSE 0 END AS progress_pct,
  coalesce(nullif((SELECT count(*) FROM got), 0), (SELECT count(*) FROM topics)) AS topic_count) t""", "planned", "topics"))
def q_run_totals_repeat(spark, sf):
    """Totals of a run over an unchanged catalog: what is still to do are responses that are no
    HTML, nothing is captured, so the stored count falls back to the search index."""
    count = F.count(F.lit(1))
    todo = PL.incremental_todo(PL.dedup_by_id(C.published_plan(spark, sf)), _topics(spark, sf).select("id"))
    got = C.html_pages(C.published_pages(spark, sf)).select("url").join(todo.select("url"), "url", "left_semi")
    t = spark.range(1).select(todo.agg(count).scalar().alias("planned"), got.agg(count).scalar().alias("captured"),
                              C.stored_total(spark, sf, "search_index").scalar().alias("indexed"))
    return t.select("planned", "captured", CV.progress_pct(F.col("captured"), F.col("planned")).alias("progress_pct"),
                    F.coalesce(F.nullif(F.col("captured"), F.lit(0)), F.col("indexed")).alias("topic_count"))


# --------------------------------------------------------------------------- #
# Event time, retention, JSON, re-delivery
# --------------------------------------------------------------------------- #
TIME_FROM, TIME_TO = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


@register("event_time", sql("""SELECT page_id, last_modified,
  coalesce(try_strptime(last_modified, '%Y-%m-%dT%H:%M:%S.%gZ'), try_strptime(last_modified, '%Y-%m-%dT%H:%M:%SZ')) AS _time,
  strftime(coalesce(try_strptime(last_modified, '%Y-%m-%dT%H:%M:%S.%gZ'), try_strptime(last_modified, '%Y-%m-%dT%H:%M:%SZ')), '%Y-%m-%d') AS updated
FROM topics_fx""", "topics_fx"))
def q_event_time(spark, sf):
    from docscope.functions.times import day, event_time
    fx = FX.topics_fx(spark, sf).select("page_id", "last_modified", event_time("last_modified").alias("_time"))
    return fx.withColumn("updated", day("_time"))


@register("time_range", f"""SELECT event_id, ts, event_type FROM events
WHERE ts >= TIMESTAMP '{TIME_FROM}' AND ts < TIMESTAMP '{TIME_TO}'""")
def q_time_range(spark, sf):
    return S.time_range(table(spark, sf, "events"), "ts", TIME_FROM, TIME_TO).select("event_id", "ts", "event_type")


# a retention that cuts the given events at every scale: age in seconds, size as a share of all bytes
RETENTION_SECONDS = 5 * 86_400
RETENTION_SHARE = 3


@register("retention_age", f"""SELECT event_id, ts FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {RETENTION_SECONDS} SECOND""")
def q_retention_age(spark, sf):
    """The events of the last days, from the day-partitioned table: older days are not read."""
    from docscope.operators.retention import keep_days_by_age
    ev = C.published_events(spark, sf)
    now = ev.agg(F.max("ts")).scalar()  # reference time: the newest event
    return keep_days_by_age(ev, "ts", now, RETENTION_SECONDS).select("event_id", "ts")


_EVENT_BYTES = "strlen(event_type) + strlen(props) + 32"


_DAY_SIZES_SQL = f"""SELECT day, bytes, sum(bytes) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_bytes,
  sum(bytes) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    <= (SELECT CAST(sum({_EVENT_BYTES}) AS BIGINT) // {RETENTION_SHARE} FROM events) AS kept
FROM (SELECT CAST(ts AS DATE) AS day, CAST(sum({_EVENT_BYTES}) AS BIGINT) AS bytes FROM events GROUP BY 1) d"""


def _event_bytes():
    return F.octet_length("event_type") + F.octet_length("props") + F.lit(32)


def _size_cap(ev):
    return ev.agg(F.floor(F.sum(_event_bytes()) / RETENTION_SHARE)).scalar()


@register("retention_size", _DAY_SIZES_SQL)
def q_retention_size(spark, sf):
    from docscope.operators.retention import day_sizes, size_cutoff
    ev = C.published_events(spark, sf)
    return size_cutoff(day_sizes(ev, "ts", _event_bytes()), _size_cap(ev))


_SIZE_ROWS_SQL = f"""SELECT event_id, ts FROM events
WHERE CAST(ts AS DATE) IN (SELECT day FROM ({_DAY_SIZES_SQL}) s WHERE kept)"""


@register("retention_size_rows", _SIZE_ROWS_SQL)
def q_retention_size_rows(spark, sf):
    """The events of the newest days that fit the size cap; other days are not read."""
    from docscope.operators.retention import keep_days_by_size
    ev = C.published_events(spark, sf)
    return keep_days_by_size(ev, "ts", _event_bytes(), _size_cap(ev)).select("event_id", "ts")


@register("retention_drop", _SIZE_ROWS_SQL)
def q_retention_drop(spark, sf):
    """The event table as a catalog table by day, after the days that don't fit the size cap have been
    dropped with their files."""
    from docscope.operators.retention import day_sizes, drop_days, oldest_kept_day
    from docscope.session import work_dir
    ev = C.published_events(spark, sf)
    name = f"retained.{_scratch(spark, 'events').rsplit('/', 1)[-1].replace('-', '_')}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS retained LOCATION '{work_dir(spark)}/retained'")
    ev.hint("rebalance", F.col("day")).write.partitionBy("day").format("parquet").saveAsTable(name)
    oldest = oldest_kept_day(day_sizes(spark.table(name), "ts", _event_bytes()), _size_cap(ev)).first()["day"]
    drop_days(spark, name, oldest)
    return spark.table(name).select("event_id", "ts")


@register("feed_times", sql("""SELECT file, last_modified <> '' AS dated, true AS has_time FROM topics""", "topics"))
def q_feed_times(spark, sf):
    """Which feed events carry a time, and that all have one once ingested."""
    from docscope.functions.times import event_or_ingest_time, event_time
    from docscope.sources.feed import read_feed, write_feed
    path = _scratch(spark, "feed")
    write_feed(_events(spark, sf), path)
    feed = read_feed(spark, path)
    return feed.select("file", event_time("last_modified").isNotNull().alias("dated"),
                       event_or_ingest_time("last_modified", F.current_timestamp()).isNotNull().alias("has_time"))


@register("parse_errors", "SELECT page_id, false AS failed FROM pages")
def q_parse_errors(spark, sf):
    """Whether the parser gave up on a page before its end."""
    return C.published_pages(spark, sf).select("page_id", F.col("page.error").isNotNull().alias("failed"))


@register("json_roundtrip", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  to_json({'event_type': event_type, 'k': CAST(json_extract(props, '$.k') AS BIGINT)}) AS encoded
FROM events""")
def q_json_roundtrip(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("p"))
    return ev.select("event_id", F.col("p.k").alias("k"),
                     F.to_json(F.struct("event_type", F.col("p.k").alias("k"))).alias("encoded"))


@register("latest_events", """SELECT user_id, event_id, ts, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) q WHERE rn = 1""")
def q_latest_events(spark, sf):
    from docscope.streaming.ingest import latest_per_key
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return latest_per_key(ev, ["user_id"], ["ts", "event_id"])


@register("incremental_merge", sql("""SELECT id, pid AS product, url, run FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY run DESC) AS rn FROM (
    SELECT id, pid, url, 0 AS run FROM prev_planned
    UNION ALL SELECT id, pid, url, 1 AS run FROM planned) u) q WHERE rn = 1""", "planned", "prev_planned"))
def q_incremental_merge(spark, sf):
    from docscope.streaming.ingest import merge_topics
    stored = (PL.dedup_by_id(C.published_plan(spark, sf, FX.CATALOG_RAW_PREVIOUS))
              .select("id", "pid", "url").withColumn("run", F.lit(0)))
    new = PL.dedup_by_id(C.published_plan(spark, sf)).select("id", "pid", "url").withColumn("run", F.lit(1))
    return merge_topics(stored, new).select("id", F.col("pid").alias("product"), "url", "run")


# --------------------------------------------------------------------------- #
# Published files read back: feed (batch and stream), navigation JSON, sitemaps
# --------------------------------------------------------------------------- #
def _scratch(spark, name):
    import uuid

    from docscope.session import work_dir
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_NDJSON_SQL = sql("""SELECT url, title, product, product_title, version, content_type, section,
  last_modified, file, text AS body FROM topics""", "topics")


@register("events_feed", _NDJSON_SQL)
def q_events_feed(spark, sf):
    from docscope.sources.feed import read_feed, write_feed
    path = _scratch(spark, "feed")
    write_feed(_events(spark, sf), path)
    return read_feed(spark, path).drop("source")


@register("stream_feed", _NDJSON_SQL)
def q_stream_feed(spark, sf):
    """Feed files (plus a non-feed decoy file) drained by a file-source stream
    with ``availableNow`` into a Parquet table, read back."""
    from docscope.sources.feed import write_decoy
    from docscope.sources.feed import write_feed
    from docscope.streaming.ingest import ingest_stream
    from docscope.operators.publish import EVENT_FIELDS
    feed, out = _scratch(spark, "feed"), _scratch(spark, "ingest")
    write_feed(_events(spark, sf), feed)
    write_decoy(spark, feed)
    q = ingest_stream(spark, feed, f"{out}/table", f"{out}/_checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/table").select(*EVENT_FIELDS)


@register("nav_flatten", sql("SELECT product_title, version, title, file, section FROM nav", "nav"))
def q_nav_flatten(spark, sf):
    return _written_nav(spark, sf).drop("pos")


@register("nav_nested", sql("""SELECT product_title, version, title, file, section,
  row_number() OVER (PARTITION BY product_title ORDER BY first.p, first.u, first.f, pord, uord, file) - 1 AS pos
FROM (SELECT *, min({'p': pord, 'u': uord, 'f': file}) OVER (PARTITION BY product_title, version) AS first FROM nav)""",
                            "nav"))
def q_nav_nested(spark, sf):
    """The written navigation map product -> version -> leaves read back, with each leaf's place."""
    return _written_nav(spark, sf)


def _written_nav(spark, sf):
    path = _scratch(spark, "nav")
    PB.write_nav(_topics(spark, sf), path)
    return PB.nav_leaves(PB.read_nav(spark, path))


_SITES: dict[tuple, str] = {}


def _site(spark, sf):
    """Sitemap and robots files of the documentation URLs, written once per
    application (the site the discovery queries read)."""
    from docscope.sources.sitemaps import write_site
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _SITES:
        d = FX.doc_urls(spark, sf)
        out = _scratch(spark, "site")
        write_site(d.select(F.col("doc_url").alias("url"),
                            F.element_at(F.split(U.url_path("doc_url"), "/"), 3).alias("folder"),
                            F.col("page_id").alias("pos")), out)
        _SITES[key] = out
    return _SITES[key]


_PARSED: dict[str, str] = {}


def _sitemap_table(spark, site):
    """The site's sitemap files, parsed and written once per application."""
    from docscope.sources.sitemaps import parsed_site
    if site not in _PARSED:
        out = _scratch(spark, "sitemaps")
        parsed_site(spark, site, out)
        _PARSED[site] = out
    return spark.read.parquet(_PARSED[site])


def _discovered(spark, sf):
    """(files, visited): the site's sitemap files and those reached from its roots."""
    from docscope.sources.sitemaps import candidate_roots, expand
    out = _site(spark, sf)
    files = _sitemap_table(spark, out)
    return files, expand(spark, candidate_roots(spark, f"{out}/robots", files, FX.DOC_HOST), files)


# the site has one index per write task, all named in robots.txt twice, and one leaf
# file per folder and chunk; file names are unknown to SQL, counts are not
@register("robots_sitemaps", sql("""SELECT 'index' AS kind, 1 AS first, true AS gapless, count(*) AS n_children FROM (
  SELECT DISTINCT string_split(doc_url, '/')[5], page_id // 50000 FROM doc_urls) f""", "doc_urls"))
def q_robots_sitemaps(spark, sf):
    """The site's sitemap roots by kind: their positions, and the leaf files they name."""
    from docscope.sources.sitemaps import candidate_roots
    out = _site(spark, sf)
    files = _sitemap_table(spark, out)
    roots = candidate_roots(spark, f"{out}/robots", files, FX.DOC_HOST)
    return roots.join(files.select("url", "kind", F.size("children").alias("n")), "url").groupBy("kind").agg(
        F.min("ord").alias("first"), (F.max("ord") == F.count_distinct("ord")).alias("gapless"),
        F.sum("n").alias("n_children"))


@register("sitemap_expand", sql("""SELECT 0 AS depth, 'index' AS kind, '' AS folder, 1 AS n_files
UNION ALL SELECT 1, 'leaf', string_split(doc_url, '/')[5], CAST(count(DISTINCT page_id // 50000) AS BIGINT)
FROM doc_urls GROUP BY ALL""", "doc_urls"))
def q_sitemap_expand(spark, sf):
    """Visited sitemap files by depth, kind and the folder that a leaf covers."""
    _, visited = _discovered(spark, sf)
    folder = F.regexp_extract("url", "/folder=([^/]*)/", 1)
    return visited.groupBy("depth", "kind", folder.alias("folder")).agg(F.count(F.lit(1)).alias("n_files"))


@register("sitemap_urls", sql("SELECT doc_url AS url FROM doc_urls", "doc_urls"))
def q_sitemap_urls(spark, sf):
    from docscope.sources.sitemaps import leaf_urls
    files, visited = _discovered(spark, sf)
    return leaf_urls(visited, files).select("url")


@register("plan_from_sitemaps", ORACLE["newest_versions"])
def q_plan_from_sitemaps(spark, sf):
    """Newest-N planning from the discovered URLs instead of the URL table."""
    from docscope.sources.sitemaps import leaf_urls
    files, visited = _discovered(spark, sf)
    urls = leaf_urls(visited, files).select("url", F.col("ord").alias("uord"))
    return PL.build_plan(urls, C.catalog(spark)).select("pid", "url")


@register("asset_manifest", sql("""SELECT abs_url, substring(sha1(abs_url), 1, 16) ||
  coalesce(nullif(left(regexp_extract(regexp_replace(regexp_extract(abs_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''),
    '[^/.][^/]*?(\\.[^./]*)$', 1), 5), ''), '.img') AS file,
  abs_url IN (SELECT concat('""" + FX.DOC_HOST + """/img/p', CAST(page_id % 50 AS VARCHAR), '.png') FROM pages
    WHERE """ + FX.FETCHED.format(id="page_id") + """) AS available
FROM (SELECT DISTINCT concat('""" + FX.DOC_HOST + """', unnest(regexp_extract_all(body_html, '<img\\b[^>]*\\ssrc\\s*=\\s*"(/[^"]*)"', 1))) AS abs_url
      FROM topics) i""", "topics"))
def q_asset_manifest(spark, sf):
    from docscope.operators.links import asset_manifest
    return asset_manifest(_topics(spark, sf), FX.fetched_assets(spark, sf))


# --------------------------------------------------------------------------- #
# Search and facets at size: the documents table as an indexed feed
# (whole texts; source and language as facet fields)
# --------------------------------------------------------------------------- #
DOC_KEYWORDS = ["the", "and"]


def _documents_feed(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.col("source").alias("product_title"), F.col("lang").alias("version"),
                    F.col("source").alias("title"), F.col("text").alias("body"), "n_chars")


def _document_hits(spark, sf):
    """The documents that hold all keywords, by index."""
    return TI.keyword_search(_documents_feed(spark, sf), "doc_id", *C.document_index(spark, sf), DOC_KEYWORDS,
                             ["title", "body"])


_DOC_KW_WHERE = " AND ".join(f"(source ILIKE '%{t}%' OR text ILIKE '%{t}%')" for t in DOC_KEYWORDS)


@register("documents_keyword_search", f"""SELECT doc_id, coalesce(nullif(source, ''), 'Other') AS product_title,
  coalesce(nullif(lang, ''), '—') AS version, n_chars FROM documents WHERE {_DOC_KW_WHERE}""")
def q_documents_keyword_search(spark, sf):
    """Every keyword in the whole text (or source), case-insensitive."""
    hits = _document_hits(spark, sf)
    return S.normalise(hits, ("product_title", "version")).select("doc_id", "product_title", "version", "n_chars")


@register("documents_page_of_results", f"""SELECT doc_id, source, lang FROM documents WHERE {_DOC_KW_WHERE}
ORDER BY source, lang, doc_id LIMIT {S.PAGE_SIZE_DOCS} OFFSET {3 * S.PAGE_SIZE_DOCS}""")
def q_documents_page_of_results(spark, sf):
    hits = _document_hits(spark, sf)
    return S.paginate(hits.select("doc_id", F.col("product_title").alias("source"), F.col("version").alias("lang")),
                      ["source", "lang", "doc_id"], 3, S.PAGE_SIZE_DOCS)


@register("documents_facet_source", """SELECT source, count(*) AS count FROM documents
WHERE source IS NOT NULL AND source <> '' GROUP BY source""")
def q_documents_facet_source(spark, sf):
    return S.facet_order(S.facet_counts(table(spark, sf, "documents"), "source"), "source")


@register("documents_facet_lang", """SELECT lang, count(*) AS count FROM documents
WHERE lang IS NOT NULL AND lang <> '' GROUP BY lang""")
def q_documents_facet_lang(spark, sf):
    return S.facet_order(S.facet_counts(table(spark, sf, "documents"), "lang"), "lang")


@register("asset_rewrite", ORACLE["topic_docs"].replace("body_html, '</article>", f"""replace(CASE WHEN {FX.FETCHED.format(id="uord")}
  THEN replace(body_html, concat('src="/img/p', CAST(uord % 50 AS VARCHAR), '.png"'),
    concat('src="../assets/', substring(sha1(concat('{FX.DOC_HOST}/img/p', CAST(uord % 50 AS VARCHAR), '.png')), 1, 16), '.png"'))
  ELSE replace(body_html, 'src="/img/', 'src="{FX.DOC_HOST}/img/') END, 'href="/en/core/', concat('href="', substring(sha1('{FX.DOC_HOST}/en/core/'), 1, 16), '.html')),
  '</article>"""))
def q_asset_rewrite(spark, sf):
    """Topic documents after link and image rewriting over the published
    topics: links against the plan, images against the asset manifest."""
    from docscope.operators.links import asset_manifest, rewrite_parts
    t = _topics(spark, sf)
    out = rewrite_parts(t, C.published_plan(spark, sf).select("url"), asset_manifest(t, FX.fetched_assets(spark, sf)))
    return PB.topic_docs(out)


@register("coverage_report")
def q_coverage_report(spark, sf):
    """The nested coverage report, written as JSON and read back."""
    from docscope.functions.times import now_iso
    path = _scratch(spark, "report")
    report = CV.report_document(_coverage(spark, sf), now_iso())
    CV.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@register("stream_upsert", sql("""SELECT url, title, product, product_title, version, content_type, section,
  last_modified, file, body, run FROM (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY run DESC) AS rn FROM (
    SELECT url, title, product, product_title, version, content_type, section, last_modified, file,
      text AS body, 0 AS run FROM prev_topics
    UNION ALL
    SELECT url, title, product, product_title, version, content_type, section, last_modified, file,
      text AS body, 1 AS run FROM topics) u) q WHERE rn = 1""", "topics", "prev_topics"))
def q_stream_upsert(spark, sf):
    """Feeds of two runs (previous and current catalog) appended to one table by a
    file stream; per topic file, the newest run wins."""
    from docscope.streaming.ingest import upsert_stream
    feed, out = _two_runs(spark, sf), _scratch(spark, "upsert")
    return upsert_stream(spark, f"{feed}/*/*", f"{out}/table", f"{out}/_checkpoint").drop("source")


def _two_runs(spark, sf):
    """Feed folder with the deliveries of the previous and the current run."""
    from docscope.sources.feed import write_feed
    feed = _scratch(spark, "feeds")
    write_feed(PB.event_rows(C.published(spark, sf, FX.CATALOG_RAW_PREVIOUS)), f"{feed}/first/run0")
    write_feed(_events(spark, sf), f"{feed}/first/run1")
    return feed


@register("stream_latest", sql("""SELECT file, run, url, title, product, version, last_modified FROM (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY run DESC) AS rn FROM (
    SELECT file, 0 AS run, url, title, product, version, last_modified FROM prev_topics
    UNION ALL SELECT file, 1, url, title, product, version, last_modified FROM topics) u) q WHERE rn = 1""",
                               "topics", "prev_topics"))
def q_stream_latest(spark, sf):
    """One row per topic from keyed state on the stream, though the newest run and then the
    previous one are delivered again after the first drain."""
    from docscope.sources.feed import write_feed
    from docscope.streaming.ingest import latest_stream
    feed, out = _two_runs(spark, sf), _scratch(spark, "latest")
    columns = ["url", "title", "product", "version", "last_modified"]
    latest_stream(spark, f"{feed}/*/*", f"{out}/table", f"{out}/_checkpoint", columns)
    write_feed(_events(spark, sf), f"{feed}/again/run1")
    write_feed(PB.event_rows(C.published(spark, sf, FX.CATALOG_RAW_PREVIOUS)), f"{feed}/again/run0")
    return latest_stream(spark, f"{feed}/*/*", f"{out}/table", f"{out}/_checkpoint", columns)


@register("atomic_replace", sql("""SELECT id, url, 1 AS run, (SELECT count(*) FROM prev_planned) AS before
FROM planned""", "planned", "prev_planned"))
def q_atomic_replace(spark, sf):
    """The plan published over the previous one: the new rows, beside the count that a reader who
    opened the old version still gets."""
    from docscope.operators.swap import opened, publish
    name = _scratch(spark, "plan").rsplit("/", 1)[-1].replace("-", "_")
    publish(PL.dedup_by_id(C.published_plan(spark, sf, FX.CATALOG_RAW_PREVIOUS)).select("id", "url", F.lit(0).alias("run")),
            name)
    old = opened(spark, name)
    publish(PL.dedup_by_id(C.published_plan(spark, sf)).select("id", "url", F.lit(1).alias("run")), name)
    return opened(spark, name).withColumn("before", old.agg(F.count(F.lit(1))).scalar())


@register("document_table", sql(f"""SELECT * FROM (SELECT coalesce(nullif(product_title, ''), 'Other') AS category, title,
  coalesce(nullif(version, ''), '—') AS version, coalesce(nullif(content_type, ''), 'Other') AS content_type,
  left(last_modified, 10) AS updated, CAST(NULL AS VARCHAR) AS pdf_file, url FROM topics) t
ORDER BY category, title, url LIMIT {S.PAGE_SIZE_TABLE} OFFSET {S.PAGE_SIZE_TABLE}""", "topics"))
def q_document_table(spark, sf):
    """The second page of the document result table, by category and title;
    topics have no PDF of their own."""
    from docscope.functions.times import day, event_time
    t = _topics(spark, sf).withColumn("category", F.col("product_title"))
    t = S.normalise(t, ("category", "version", "content_type")).select(
        "category", "title", "version", "content_type",
        F.coalesce(day(event_time("last_modified")), F.lit("")).alias("updated"),
        F.lit(None).cast("string").alias("pdf_file"), "url")
    return S.paginate(t, ["category", "title", "url"], 1, S.PAGE_SIZE_TABLE)


@register("topics_facet_type", sql("""SELECT content_type, count(*) AS count FROM topics
WHERE content_type <> '' GROUP BY content_type""", "topics"))
def q_topics_facet_type(spark, sf):
    """Content types of the published topics."""
    return S.facet_order(S.facet_counts(_topics(spark, sf), "content_type"), "content_type")


# a key inside the data's range: the page after it is a deep page
PAGE_AFTER_KEY = ("src5", "es", 0)


@register("documents_page_after", f"""SELECT doc_id, source, lang FROM documents WHERE {_DOC_KW_WHERE}
  AND (source, lang, doc_id) > ('{PAGE_AFTER_KEY[0]}', '{PAGE_AFTER_KEY[1]}', {PAGE_AFTER_KEY[2]})
ORDER BY source, lang, doc_id LIMIT {S.PAGE_SIZE_DOCS}""")
def q_documents_page_after(spark, sf):
    """Keyset pagination: the result page following a (source, lang, doc_id) key."""
    hits = _document_hits(spark, sf)
    rows = hits.select("doc_id", F.col("product_title").alias("source"), F.col("version").alias("lang"))
    return S.page_after(rows, ["source", "lang", "doc_id"], PAGE_AFTER_KEY, S.PAGE_SIZE_DOCS)


@register("nav_tree_files", sql(f"""SELECT product_title, version, pord AS block_pord, uord // {PB.NAV_BLOCK} AS block,
  string_agg(file, ',' ORDER BY pord, uord) AS files, count(*) AS n_leaves
FROM nav GROUP BY product_title, version, pord, uord // {PB.NAV_BLOCK}""", "nav"))
def q_nav_tree_files(spark, sf):
    """The bounded navigation tree, one row per (product, version, block) with
    its leaf files in arrival order."""
    t = PB.nav_tree(_topics(spark, sf))
    return t.select("product_title", "version", F.col("block.pord").alias("block_pord"),
                    F.col("block.b").alias("block"),
                    F.array_join(F.transform("leaves", lambda x: x["file"]), ",").alias("files"),
                    F.size("leaves").cast("long").alias("n_leaves"))


@register("coverage_report_products", sql(f"""SELECT row_number() OVER (ORDER BY c.ord) - 1 AS pos, r.id, r.title,
  r.online_count, r.local_count, r.missing_count,
  (SELECT bool_or(missing_count > 0) FROM ({_COVERAGE_SQL}) x) AS updates_available
FROM ({_COVERAGE_SQL}) r JOIN catalog c ON c.pid = r.id""", "catalog", "plan", "prev_topics"))
def q_coverage_report_products(spark, sf):
    """The written coverage report read back: its product list in catalog
    order, with the document's ``updates_available`` flag."""
    from docscope.functions.times import now_iso
    path = _scratch(spark, "report")
    report = CV.report_document(_coverage(spark, sf), now_iso())
    CV.write_report(report, path)
    doc = spark.read.schema(report.schema).json(path)
    return doc.select("updates_available", F.posexplode("products").alias("pos", "p")).select(
        F.col("pos").cast("long").alias("pos"), "p.id", "p.title", "p.online_count", "p.local_count",
        "p.missing_count", "updates_available")
