"""URL, id and version column functions (all native Spark expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a version path segment is two or three dot-separated numbers.
VERSION_SEGMENT = r"^[0-9]+[.][0-9]+([.][0-9]+)?$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def topic_id(url) -> Column:
    """First 16 hex digits of the SHA-1 of the UTF-8 URL."""
    return F.substring(F.sha1(F.encode(_c(url), "UTF-8")), 1, 16)


def url_path(url) -> Column:
    """Path component: after scheme://host, before ``?``/``#``, ``;params`` of the
    last segment removed. A URL without scheme is all path."""
    u = _c(url)
    with_host = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    no_host = F.regexp_extract(u, r"^([^?#]*)", 1)
    p = F.when(u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), with_host).otherwise(no_host)
    return F.regexp_replace(p, r";[^/]*$", "")


def url_key(url) -> Column:
    """URL without fragment (text before the first ``#``)."""
    return F.substring_index(_c(url), "#", 1)


def url_fragment(url) -> Column:
    """Fragment including ``#``, or empty."""
    u = _c(url)
    return F.substring(u, F.length(url_key(u)) + 1, F.lit(1 << 30))


def version_segments(path) -> Column:
    return F.filter(F.split(_c(path), "/"), lambda x: x.rlike(VERSION_SEGMENT))


def version_key(v) -> Column:
    """Integer tuple of a version string; compares like Python tuples."""
    return F.transform(F.split(_c(v), "[.]"), lambda x: x.cast("int"))


def browse_version_key(v) -> Column:
    """Browser order key: parts as numbers (non-numeric 0), padded to three."""
    k = F.transform(F.split(_c(v), "[.]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.concat(k, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(3) - F.size(k))))


def path_parts(path) -> Column:
    return F.filter(F.split(_c(path), "/"), lambda x: x != "")


def breadcrumb(url, root_path) -> Column:
    """Non-empty path parts, minus a leading ``en``, minus the root's segments
    when they are a prefix."""
    return path_breadcrumb(url_path(url), root_path)


def path_breadcrumb(path, root_path) -> Column:
    """``breadcrumb`` from an already extracted path."""
    p = path_parts(path)
    p = F.when(F.try_element_at(p, F.lit(1)) == "en", F.slice(p, 2, F.lit(1 << 20))).otherwise(p)
    rs = F.split(F.regexp_replace(_c(root_path), r"^/+|/+$", ""), "/")
    return F.when(F.slice(p, F.lit(1), F.size(rs)) == rs,
                  F.slice(p, F.size(rs) + 1, F.lit(1 << 20))).otherwise(p)


def first_or_empty(arr) -> Column:
    return F.coalesce(F.try_element_at(_c(arr), F.lit(1)), F.lit(""))


def html_escape(t, quote: bool = False) -> Column:
    """``&`` first, then ``<`` and ``>``; null becomes ``""``."""
    x = F.coalesce(_c(t).cast("string"), F.lit(""))
    x = F.replace(x, F.lit("&"), F.lit("&amp;"))
    x = F.replace(x, F.lit("<"), F.lit("&lt;"))
    x = F.replace(x, F.lit(">"), F.lit("&gt;"))
    if quote:
        x = F.replace(x, F.lit('"'), F.lit("&quot;"))
    return x


def asset_file(abs_url) -> Column:
    """Local asset name: id of the absolute URL + path extension (max 5 chars,
    dot included) or ``.img``."""
    ext = F.left(F.regexp_extract(url_path(abs_url), r"[^/.][^/]*?(\.[^./]*)$", 1), F.lit(5))
    return F.concat(topic_id(abs_url), F.coalesce(F.nullif(ext, F.lit("")), F.lit(".img")))


# Fixed value: schemes whose references resolve relative to a base.
RELATIVE_SCHEMES = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
                    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]
_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"


def _drop_empty_markers(u) -> Column:
    """A URL re-assembled from its parts has no empty ``?`` or ``#``."""
    u = F.regexp_replace(u, r"^([^?#]*)\?(#|$)", "$1$2")
    return F.regexp_replace(u, r"^([^#]*)#$", "$1")


def with_resolved_url(df, base: str, ref: str, out: str):
    """Add ``out``: ``ref`` resolved against ``base`` as ``urllib.parse.urljoin``
    does it, natively.

    Path merge: base directory segments + reference segments (for a relative
    reference, empty segments between the first and the last are dropped),
    then ``.`` skipped and ``..`` removing the previous segment, with a
    trailing ``/`` when the last segment was ``.``/``..``. An empty reference
    path keeps the base path and, unless the reference has a query, the base
    query. Empty ``?``/``#`` markers are dropped; a reference with another or
    a non-hierarchical scheme is returned as it is.

    Computed in stages (one projection each), so every intermediate value is
    evaluated once per row rather than copied into a deep expression tree.
    """
    b, r0 = F.col(base), F.col(ref)
    s1 = df.withColumns({
        "_rs": F.lower(F.regexp_extract(r0, _SCHEME, 1)),
        "_bs": F.lower(F.regexp_extract(b, _SCHEME, 1)),
    })
    same = (F.col("_rs") != "") & (F.col("_rs") == F.col("_bs")) & F.col("_rs").isin(RELATIVE_SCHEMES)
    s2 = s1.withColumns({
        "_foreign": (F.col("_rs") != "") & ~same,
        # "https:x" against an https base is the relative reference "x"
        "_r1": F.when(same & ~r0.rlike(_SCHEME + "//[^/?#]"), F.regexp_replace(r0, _SCHEME, "")).otherwise(r0),
    })
    r1 = F.col("_r1")
    # "//" with an empty authority adds nothing: the rest resolves as a path
    s3 = s2.withColumns({
        "_network": r1.startswith("//") & ~r1.rlike(r"^//([/?#]|$)"),
        "_r": F.when(r1.rlike(r"^//([/?#]|$)"), F.substring(r1, 3, 1 << 30)).otherwise(r1),
    })
    r = F.col("_r")
    s4 = s3.withColumns({
        "_rp": F.regexp_extract(r, r"^([^?#]*)", 1),
        "_rq": F.regexp_extract(r, r"^[^?#]*\?([^#]*)", 1),
        "_rf": F.regexp_extract(r, r"^[^#]*(#.*)?$", 1),
        "_bparts": F.split(F.regexp_extract(b, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"),
    })
    bparts = F.col("_bparts")
    bdir = F.when(F.element_at(bparts, -1) != "", F.slice(bparts, F.lit(1), F.size(bparts) - 1)).otherwise(bparts)
    s5 = s4.withColumn("_joined", F.concat(bdir, F.split(F.col("_rp"), "/")))
    joined, n = F.col("_joined"), F.size(F.col("_joined"))
    relative_segs = F.when(n < 2, joined).otherwise(F.concat(
        F.slice(joined, 1, 1), F.filter(F.slice(joined, F.lit(2), n - 2), lambda x: x != ""),
        F.slice(joined, n, F.lit(1))))
    s6 = s5.withColumn("_segs", F.when(F.col("_rp").startswith("/"), F.split(F.col("_rp"), "/"))
                       .otherwise(relative_segs))
    segs = F.col("_segs")
    folded = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    s7 = s6.withColumn("_path", F.array_join(F.when(F.element_at(segs, -1).isin(".", ".."),
                                                    F.concat(folded, F.array(F.lit(""))))
                                             .otherwise(folded), "/"))
    path = F.col("_path")
    path = F.when(path == "", F.lit("/")).when(~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    rq = F.col("_rq")
    query = F.when(rq != "", F.concat(F.lit("?"), rq)).otherwise(F.lit(""))
    bnq = F.regexp_extract(b, r"^([^?#]*)", 1)
    bq = F.regexp_extract(b, r"^[^?#]*(\?[^#]*)?", 1)
    resolved = (F.when(r.rlike(_SCHEME + "//"), r)
                .when(F.col("_network"), F.concat(F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), r))
                .when(F.col("_rp") == "", F.concat(bnq, F.when(rq != "", query).otherwise(bq), F.col("_rf")))
                .otherwise(F.concat(F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1),
                                    path, query, F.col("_rf"))))
    s8 = s7.withColumn("_resolved", resolved)
    result = (F.when(r0 == "", b).when(F.col("_foreign"), r0)
              .otherwise(_drop_empty_markers(F.col("_resolved"))))
    tmp = ["_rs", "_bs", "_foreign", "_r1", "_network", "_r", "_rp", "_rq", "_rf", "_bparts", "_joined",
           "_segs", "_path", "_resolved"]
    return s8.withColumn(out, result).drop(*tmp)
