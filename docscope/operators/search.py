"""Query-side operators over the published tables: normalisation, facets,
keyword and substring search, browsing, version order, pagination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscope.functions import text as X
from docscope.functions import urls as U

# Defaults of absent fields and result limits/page sizes.
OTHER = "Other"
GENERAL = "General"
SEARCH_HITS_MAX = 200
MIN_QUERY_CHARS = 2
PAGE_SIZE_DOCS = 20
PAGE_SIZE_TABLE = 25
#: Order of topic lists.
COLLATION = "UNICODE"


def normalise(df: DataFrame, fields=("category", "content_type", "product_title", "version")) -> DataFrame:
    """NULL/empty ``category`` (= product title when absent), ``content_type``
    and ``product_title`` -> ``Other``; ``version`` -> ``—``. ``fields`` picks
    which of them a view normalises."""
    out = df
    if "category" in fields and "category" not in out.columns and "product_title" in out.columns:
        out = out.withColumn("category", F.col("product_title"))
    for c in ("category", "content_type", "product_title"):
        if c in fields and c in out.columns:
            out = out.withColumn(c, X.or_default(c, OTHER))
    if "version" in fields and "version" in out.columns:
        out = out.withColumn("version", X.or_default("version", X.UNVERSIONED))
    return out


def facet_counts(df: DataFrame, field: str) -> DataFrame:
    """``count by field`` ordered by count descending, then value; rows
    without the field (NULL or empty) are not counted. Partial aggregation
    runs before the shuffle, so a dominant value costs one row per task."""
    return (df.where(F.col(field).isNotNull() & (F.col(field) != ""))
            .groupBy(field).agg(F.count(F.lit(1)).alias("count")))


def facet_order(counts: DataFrame, field: str) -> DataFrame:
    return counts.orderBy(F.desc("count"), F.asc(field))


def _like_pattern(value: str) -> str:
    v = value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return v.replace("*", "%")


def facet_filter(df: DataFrame, **selected: str) -> DataFrame:
    """Conjunction of ``field = value`` (case-insensitive, ``*`` wildcard);
    a value of ``*`` selects everything."""
    out = df
    for field, value in selected.items():
        if value is None or value == "*":
            continue
        out = out.where(F.col(field).ilike(_like_pattern(value)))
    return out


def field_exists(df: DataFrame, field: str) -> DataFrame:
    return df.where(F.col(field).isNotNull() & (F.col(field) != ""))


def version_facet(df: DataFrame, category: str = "*") -> DataFrame:
    """Versions of the selected product with counts, newest first."""
    sel = field_exists(facet_filter(df, category=category), "version")
    return sel.groupBy("version").agg(F.count(F.lit(1)).alias("count"))


def keyword_filter(df: DataFrame, terms: list[str], fields=("title", "body")) -> DataFrame:
    """Every term must occur (case-insensitive, ``*`` wildcard) in one of the
    fields; an empty list or ``["*"]`` keeps all rows."""
    cond: Column = F.lit(True)
    for t in terms:
        if t in ("", "*"):
            continue
        pat = "%" + _like_pattern(t) + "%"
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.col(f), F.lit("")).ilike(pat)
        cond = cond & hit
    return df.where(cond)


def substring_hits(index: DataFrame, q: str) -> DataFrame | None:
    """Index rows whose lower-cased title or text contains the lower-cased,
    trimmed query; None when the query is shorter than two characters (the
    caller browses instead)."""
    q = (q or "").strip()
    if len(q) < MIN_QUERY_CHARS:
        return None
    ql = F.lower(F.lit(q))
    return index.where(F.contains(F.lower(F.col("title")), ql)
                       | F.contains(F.lower(F.coalesce(F.col("text"), F.lit(""))), ql))


def first_in_index_order(hits: DataFrame, n: int = SEARCH_HITS_MAX) -> DataFrame:
    """First ``n`` hits in index order (a top-k, not a full sort)."""
    return hits.orderBy("pord", "uord").limit(n)


def paginate(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """Rows ``page*size`` .. ``page*size+size-1`` of ``df`` in ``order``."""
    return df.orderBy(*order).offset(page * size).limit(size)


def time_range(df: DataFrame, ts: str, earliest=None, latest=None) -> DataFrame:
    """Rows with ``earliest <= ts < latest``; an open bound (None) is no bound,
    so earliest 0 and an empty latest select all time. A pushed-down range
    predicate on the scan."""
    cond = F.lit(True)
    if earliest is not None:
        cond = cond & (F.col(ts) >= F.lit(earliest).cast(df.schema[ts].dataType))
    if latest is not None:
        cond = cond & (F.col(ts) < F.lit(latest).cast(df.schema[ts].dataType))
    return df.where(cond)


def page_after(df: DataFrame, order: list[str], after: tuple, size: int) -> DataFrame:
    """Keyset page: the ``size`` rows that follow the key ``after`` in
    ``order`` (ascending, a unique key). Unlike an offset, a deep page costs
    no more than the first: each task keeps ``size`` rows."""
    key = F.struct(*[F.col(c) for c in order])
    last = F.struct(*[F.lit(v).alias(c) for c, v in zip(order, after)])
    return df.where(key > last).orderBy(*order).limit(size)


def browse(nav_rows: DataFrame, product_title: str, version: str) -> DataFrame:
    return nav_rows.where((F.col("product_title") == product_title) & (F.col("version") == version))


def version_ranks(nav_rows: DataFrame) -> DataFrame:
    """Browser version order per product: padded numeric key descending, ties
    in first-appearance order. Ranks run over distinct (product, version)
    pairs, a set that does not grow with the topic count."""
    v = nav_rows.groupBy("product_title", "version").agg(F.min(F.struct("pord", "uord")).alias("first"))
    w = Window.partitionBy("product_title").orderBy(F.desc(U.browse_version_key("version")), "first")
    return v.withColumn("vrank", F.row_number().over(w))


def section_breaks(nav_rows: DataFrame) -> DataFrame:
    """Topic lists in (section, title) order (see ``ranked_list``) with a heading flag on the
    first topic of each section and the position in the list. Neither step puts a
    whole (product, version) list in one task (see ``ranking``)."""
    from docscope.operators.ranking import first_in_group
    rows = nav_rows.select("product_title", "version", "title", "file",
                           F.coalesce(F.col("section"), F.lit("")).alias("section"))
    flagged = first_in_group(ranked_list(rows), ["product_title", "version", "section"], ["item_rank"], "is_break")
    return flagged.select(
        "product_title", "version", "title", "file", "section", "is_break",
        F.when(F.col("section") == "", F.lit(GENERAL)).otherwise(F.col("section")).alias("heading"),
        "item_rank")


def ranked_list(nav_rows: DataFrame) -> DataFrame:
    """Topic lists by (product, version) with each topic's position by section and title, both in
    the root locale's order (accents and case decide only between otherwise equal words);
    what that holds equal stands in binary order, then by file."""
    from docscope.operators.ranking import group_rank
    keyed = nav_rows.withColumns({"_section": F.collate("section", COLLATION), "_title": F.collate("title", COLLATION)})
    ranked = group_rank(keyed, ["product_title", "version"], ["_section", "section", "_title", "title", "file"],
                        "item_rank")
    return ranked.drop("_section", "_title")
