"""URL columns with the rules browsers use.

References of ordinary shape are resolved by Spark expressions; only the others (escapes, dot segments,
non-ASCII text, ports, odd hosts) reach the Arrow helper. ``resolved_urls`` works on an array of references
per row, against that row's base URL, so a page's links are resolved without exploding or shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import resolve_references

# Already in canonical form but for the fragment: nothing to decode, encode, fold or drop.
PLAIN = (
    r"^https?://(?:[0-9a-z._\-]*\.)?[a-z_\-][0-9a-z_\-]*/[!$&'()*+,\-./0-9:;=@A-Z_a-z|~]*"
    r"(?:\?[!$%&()*+,\-./0-9:;=?@A-Z_a-z~]*)?(?:#.*)?\z"
)
# A path from the root of the base's host, of the same plain characters.
ROOTED = r"^/(?:[!$&'()*+,\-.0-9:;=@A-Z_a-z|~][!$&'()*+,\-./0-9:;=@A-Z_a-z|~]*)?(?:\?[!$%&()*+,\-./0-9:;=?@A-Z_a-z~]*)?(?:#.*)?\z"
DOT_SEGMENT = r"^[^?#]*/\.{1,2}(?:[/?#]|\z)"


def _ordinary(reference: Column, root: Column) -> Column:
    """The resolved URL of a plain reference, NULL for the ones that need the full rules."""
    bare = F.regexp_extract(reference, "^[^#]*", 0)
    return F.when(
        ~reference.rlike(DOT_SEGMENT),
        F.when(reference.rlike(PLAIN), bare).when(reference.rlike(ROOTED), F.concat(root, bare)),
    )


def _root(base: str | None) -> Column:
    page = F.col(base) if base else F.lit(None).cast("string")
    return F.when(page.isNotNull(), F.regexp_extract(page, "^https?://[^/?#]*", 0))


def resolved_urls(df: DataFrame, references: str, out: str, base: str | None = None) -> DataFrame:
    """Adds ``out``, an array aligned with ``references``: canonical http(s) URL without fragment, or NULL.

    ``base`` names a column with a canonical URL; without it, only absolute references resolve.
    """
    page = F.col(base) if base else F.lit(None).cast("string")
    staged = df.withColumn("_root", _root(base)).withColumn(
        "_ready", F.transform(references, lambda reference: _ordinary(reference, F.col("_root")))
    )
    left = F.filter(
        F.zip_with(references, "_ready", lambda reference, ready: F.when(ready.isNull(), reference)),
        lambda reference: reference.isNotNull(),
    )
    staged = staged.withColumn("_left", F.when(F.size(left) > 0, F.array_distinct(left)))
    staged = staged.withColumn("_found", resolve_references("_left", F.when(F.col("_left").isNotNull(), page)))
    looked_up = lambda reference: F.get(F.col("_found"), F.array_position(F.col("_left"), reference).cast("int") - 1)
    merged = F.zip_with(references, "_ready", lambda reference, ready: F.coalesce(ready, looked_up(reference)))
    return staged.withColumn(
        out, F.when(F.col("_left").isNull(), F.col("_ready")).otherwise(merged)
    ).drop("_root", "_ready", "_left", "_found")


def canonical_url(df: DataFrame, reference: str, out: str, base: str | None = None) -> DataFrame:
    """Adds ``out``: the reference as a canonical http(s) URL without fragment, or NULL."""
    page = F.col(base) if base else F.lit(None).cast("string")
    text = F.col(reference)
    staged = df.withColumn("_ready", _ordinary(text, _root(base)))
    left = F.col("_ready").isNull() & text.isNotNull()
    staged = staged.withColumn("_left", F.when(left, F.array(text))).withColumn(
        "_found", resolve_references("_left", F.when(F.col("_left").isNotNull(), page))
    )
    return staged.withColumn(out, F.coalesce("_ready", F.get("_found", F.lit(0)))).drop("_ready", "_left", "_found")


# ---- parts of a canonical URL ------------------------------------------------------------------


def url_scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?)://", 1)


def url_host(url: Column) -> Column:
    """Host name without user and port."""
    return F.regexp_extract(url, r"^https?://(?:[^/?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1)


def url_origin(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]*", 0), r"//[^/]*@", "//")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)


def bare_host(host: Column) -> Column:
    """The site a host belongs to: lower case, no final dot, no leading ``www.``."""
    return F.regexp_replace(F.regexp_replace(F.lower(host), r"\.\z", ""), r"^www\.", "")


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda part: part != "")
