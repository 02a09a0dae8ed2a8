"""Product catalog source: raw configuration values typed natively.

Scalar typing of a raw value: ``""`` stays empty, ``[a, b]`` is a list, all
digits is a number, ``all``/``none`` in any case are lower-cased keywords,
anything else is text. ``versions`` is kept as its canonical string (a number
is re-rendered without leading zeros); ``exclude`` is always a string array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: versions kept when a product names none.
DEFAULT_VERSIONS = "2"


def coerce_scalar(raw) -> Column:
    """Canonical string form of a scalar catalog value."""
    v = F.trim(raw)
    return (F.when(v.isNull(), F.lit(None))
            .when(v == "", F.lit(""))
            .when(v.rlike("^[0-9]+$"), F.coalesce(v.try_cast("decimal(38,0)").cast("string"), v))
            .when(F.lower(v).isin("all", "none"), F.lower(v))
            .otherwise(v))


def coerce_list(raw) -> Column:
    """List form: ``[a, b]`` -> [a, b] (blank items dropped), scalar -> [scalar]."""
    v = F.trim(raw)
    inner = F.regexp_extract(v, r"^\[(.*)\]$", 1)
    items = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    return (F.when(v.isNull() | (v == ""), F.array().cast("array<string>"))
            .when(v.rlike(r"^\[.*\]$"), items)
            .otherwise(F.array(v)))


def typed_catalog(raw: DataFrame, default_versions: str = DEFAULT_VERSIONS) -> DataFrame:
    """(ord, pid, title, root_path, versions, exclude) with typed values.

    ``title`` defaults to ``pid``; ``root_path`` loses its outer slashes;
    a missing ``versions`` takes ``default_versions``.
    """
    return raw.select(
        F.col("ord").cast("int").alias("ord"),
        F.col("pid"),
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("pid")).alias("title"),
        F.regexp_replace(F.trim(F.col("root_path")), r"^/+|/+$", "").alias("root_path"),
        F.coalesce(coerce_scalar(F.col("versions")), F.lit(default_versions)).alias("versions"),
        coerce_list(F.col("exclude")).alias("exclude"),
    )


def keep_count(versions) -> Column:
    """Newest-N count: ``all`` -> NULL (no filter); ``none``/empty -> 1; a number
    -> itself; any other text fails the job, as the reference's ``int()`` does."""
    v = F.col(versions) if isinstance(versions, str) else versions
    n = v.try_cast("int")
    return (F.when(v == "all", F.lit(None).cast("int"))
            .when(v.isNull() | v.isin("none", ""), F.lit(1))
            .when(n.isNotNull(), n)
            .otherwise(F.raise_error(F.concat(F.lit("invalid versions value: "), v)).cast("int")))
