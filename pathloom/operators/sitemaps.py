"""Sitemap documents: entries, statistics, lastmod lookup, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import S, decoded_text, each, parsed_date, trimmed
from ..functions.urls import resolved_urls, url_host
from .urls import host_refusal

# Where sitemaps usually are.
DEFAULT_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/wp-sitemap.xml"]
AUTO_MIN_DATED = 5
AUTO_SHARE = 0.9


def inner_texts(text: Column, tag: str) -> Column:
    """The text of each element, from its first opening tag to the first closing tag after it.

    The text is cut once at the closing tags, and a piece looked through once, so unclosed tags take linear time. What follows the last
    closing tag is no element.
    """
    opening = rf"(?is)<{tag}(?:{S}[^<>]*)?>"
    pieces = F.split(text, rf"(?i)</{tag}{S}*>", -1)
    closed = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(F.filter(closed, lambda piece: piece.rlike(opening)), lambda piece: F.regexp_extract(piece, opening + "(.*)", 1))


def _without_cdata(text: Column) -> Column:
    """CDATA sections as their contents. A section that never ends stays as it is, and is not looked for behind the last end."""
    rest = F.substring_index(text, "]]>", -1)
    front = F.substring(text, F.lit(1), F.length(text) - F.length(rest))
    return F.concat(F.regexp_replace(front, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), rest)


def _first(block: Column, tag: str) -> Column:
    return trimmed(decoded_text(_without_cdata(F.coalesce(F.get(inner_texts(block, tag), F.lit(0)), F.lit("")))))


def document_kind(xml: Column) -> Column:
    """index, urlset, or NULL for anything that is not a sitemap."""
    return F.when(xml.rlike(rf"(?i)<sitemapindex[>{S[1:-1]}]"), F.lit("index")).when(
        xml.rlike(rf"(?i)<urlset[>{S[1:-1]}]"), F.lit("urlset")
    )


def parsed_documents(docs: DataFrame) -> DataFrame:
    """(site, sitemap_url, kind, entries) with the array of (loc, lastmod); a projection, one row per sitemap."""
    kinds = docs.withColumn("kind", document_kind(F.col("xml"))).filter(F.col("kind").isNotNull())
    blocks = F.when(F.col("kind") == "index", inner_texts(F.col("xml"), "sitemap")).otherwise(inner_texts(F.col("xml"), "url"))
    cut = kinds.withColumn("_blocks", blocks)
    raw = cut.withColumn("_locs", F.transform("_blocks", lambda block: _first(block, "loc"))).withColumn(
        "_dates", F.transform("_blocks", lambda block: parsed_date(_first(block, "lastmod")))
    )
    resolved = resolved_urls(raw.drop("_blocks"), "_locs", "_urls")
    pair = lambda loc, stamp: F.struct(loc.alias("loc"), stamp.alias("lastmod"))
    usable = resolved.withColumn(
        "_entries", F.filter(F.zip_with("_urls", "_dates", pair), lambda entry: entry["loc"].isNotNull())
    ).drop("_urls", "_dates", "_locs")
    # Malformed documents: bare loc tags, wherever they stand.
    bare = F.transform(inner_texts(F.col("xml"), "loc"), lambda text: decoded_text(trimmed(_without_cdata(text))))
    needing = usable.withColumn("_bare", F.when(F.size("_entries") == 0, bare))
    fallback = resolved_urls(needing, "_bare", "_bare_urls")
    bare_entries = F.transform(
        F.filter("_bare_urls", lambda loc: loc.isNotNull()),
        lambda loc: pair(loc, F.lit(None).cast("timestamp")),
    )
    return fallback.withColumn("entries", F.coalesce(bare_entries, "_entries")).drop("_entries", "_bare", "_bare_urls")


def sitemap_entries(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(site, sitemap_url, kind, pos, loc, lastmod) from (site, sitemap_url, xml); ``keep`` columns pass through."""
    entries = each(parsed_documents(docs), "entries", "pos", "_entry", "site", "sitemap_url", *keep, "kind")
    return entries.select("site", "sitemap_url", *keep, "kind", "pos", "_entry.loc", "_entry.lastmod")


def sitemap_stats(docs: DataFrame) -> DataFrame:
    """Entries, freshness, extensions and auto-generated dates per sitemap."""
    xml = F.col("xml")
    parsed = parsed_documents(docs).select(
        "site",
        "sitemap_url",
        "kind",
        "entries",
        xml.rlike("(?i)<image:").alias("image"),
        xml.rlike("(?i)<video:").alias("video"),
        xml.rlike("(?i)<news:").alias("news"),
        xml.rlike("(?i)<xhtml:link(?![0-9A-Za-z_])").alias("hreflang"),
    )
    keys = ["site", "sitemap_url", "kind", "image", "video", "news", "hreflang"]
    per_date = (
        parsed.select(*keys, F.explode_outer("entries").alias("_entry"))
        .groupBy(*keys, F.col("_entry.lastmod").alias("_date"))
        .agg(F.count("_entry").alias("_n"))
    )
    dated = F.when(F.col("_date").isNotNull(), F.col("_n"))
    totals = per_date.groupBy(*keys).agg(
        F.sum("_n").alias("urls"),
        F.coalesce(F.sum(dated), F.lit(0)).alias("with_lastmod"),
        F.min("_date").alias("oldest_lastmod"),
        F.max("_date").alias("newest_lastmod"),
        F.count("_date").alias("distinct_lastmod"),
        F.max(dated).alias("_top"),
    )
    auto = (F.col("with_lastmod") >= AUTO_MIN_DATED) & (F.col("_top") / F.col("with_lastmod") >= AUTO_SHARE)
    return totals.withColumn("auto_lastmod", F.coalesce(auto, F.lit(False))).drop("_top")


def lastmod_lookup(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds ``lastmod`` to (site, seq, url): the last dated entry for the URL by (doc_pos, pos)."""
    dated = entries.filter(F.col("lastmod").isNotNull())
    last = dated.groupBy("site", F.col("loc").alias("url")).agg(
        F.max_by("lastmod", F.struct("doc_pos", "pos")).alias("lastmod")
    )
    return urls.join(last, ["site", "url"], "left")


def sitemap_seeds(listed: DataFrame, origins: DataFrame, with_pages: DataFrame) -> DataFrame:
    """Sitemaps to try per site: the public ones robots.txt lists, then for sites whose listed ones gave no
    page the usual places, without those already tried.

    ``listed`` (site, pos, url), ``origins`` (site, origin), ``with_pages`` (site) of sites already served.
    """
    public = listed.filter(host_refusal(url_host(F.col("url"))).isNull()).select(
        "site", F.lit(0).alias("round"), F.col("pos").cast("long").alias("pos"), "url"
    )
    usual = (
        origins.join(with_pages, "site", "left_anti")
        .select("site", "origin", F.posexplode(F.array(*[F.lit(path) for path in DEFAULT_PATHS])).alias("pos", "_path"))
        .select("site", F.lit(1).alias("round"), F.col("pos").cast("long").alias("pos"), F.concat("origin", "_path").alias("url"))
        .join(public.select("site", "url"), ["site", "url"], "left_anti")
        .select("site", "round", "pos", "url")
    )
    return public.unionByName(usual)
