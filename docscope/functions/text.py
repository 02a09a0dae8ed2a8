"""Text column functions over parsed pages (native expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The title suffix pattern removed, the untitled label, the
# excerpt length of the search index and the labels used by the browser.
LAST_UPDATED = r"\s*\(last updated.*?\)\s*$"
UNTITLED = "Untitled"
EXCERPT_CHARS = 1200
UNVERSIONED = "—"
UNVERSIONED_LABEL = "Unversioned"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def clean_title(title_raw, h1) -> Column:
    """Title text up to the first ``|``, minus a trailing ``(last updated …)``;
    else the first ``h1``; else ``Untitled``."""
    t = _c(title_raw)
    first = F.element_at(F.split(strip_ws(t), r"(?U)\s*\|\s*"), 1)
    cleaned = strip_ws(F.regexp_replace(first, r"(?U)" + LAST_UPDATED, ""))
    return (F.when(t.isNotNull() & (t != ""), cleaned)
            .otherwise(F.coalesce(_c(h1), F.lit(UNTITLED))))


def meta_entry(metas, name: str) -> Column:
    """First ``meta[name=…]`` entry, else first ``meta[property=…]`` (a struct)."""
    m = _c(metas)
    by_name = F.try_element_at(F.filter(m, lambda x: (x["attr"] == "name") & (x["name"] == name)), F.lit(1))
    by_prop = F.try_element_at(F.filter(m, lambda x: (x["attr"] == "property") & (x["name"] == name)), F.lit(1))
    return F.coalesce(by_name, by_prop)


def meta_content(entry) -> Column:
    """Trimmed ``content`` of a meta entry; ``""`` when absent or empty. A
    ``name`` match with empty content is not retried by ``property``."""
    content = _c(entry)["content"]
    return F.when(content.isNotNull() & (content != ""), strip_ws(content)).otherwise(F.lit(""))


def meta_value(metas, name: str) -> Column:
    return meta_content(meta_entry(metas, name))


def excerpt(text) -> Column:
    return F.left(_c(text), F.lit(EXCERPT_CHARS))


def or_default(x, default: str) -> Column:
    """NULL or empty -> ``default``."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(default))


def version_label(v) -> Column:
    """Version picker label: ``—`` -> ``Unversioned``, else ``v`` + version."""
    return F.when(_c(v) == UNVERSIONED, F.lit(UNVERSIONED_LABEL)).otherwise(F.concat(F.lit("v"), _c(v)))


def hit_tag(product_title, version) -> Column:
    """Search hit tag: product, plus `` · v<version>`` when versioned."""
    v = _c(version)
    return F.concat(F.coalesce(_c(product_title), F.lit("")),
                    F.when(v.isNotNull() & (v != ""), F.concat(F.lit(" · v"), v)).otherwise(F.lit("")))
