"""Page contents: every job here is a projection over the pages table and shuffles nothing.

Input is (page_id, url, html) with a canonical ``url``. The heavy intermediate texts are put in
their own select so they are computed once per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.arrow import jsonld_types
from ..functions.text import each, word_count
from ..functions.urls import canonical_url, resolved_urls, url_host


def page_meta(pages: DataFrame) -> DataFrame:
    source = F.col("html")
    read = pages.select(
        "page_id",
        "url",
        "html",
        H.meta_entries(source).alias("_meta"),
        H.canonical_reference(source).alias("_canonical"),
    )
    description = H.meta_content(F.col("_meta"), "description")
    named = read.select(
        "page_id",
        "url",
        "_canonical",
        H.page_language(source).alias("lang"),
        H.title_text(source, F.col("_meta")).alias("title"),
        F.when(description != "", description)
        .otherwise(H.meta_content(F.col("_meta"), "og:description"))
        .alias("description"),
        H.meta_content(F.col("_meta"), "robots").alias("robots"),
    )
    return _resolved_canonical(named)


def _resolved_canonical(df: DataFrame) -> DataFrame:
    given = F.when(F.col("_canonical") != "", F.col("_canonical"))
    resolved = canonical_url(df.withColumn("_given", given), "_given", "_target", "url")
    return resolved.withColumn("canonical", F.coalesce("_target", "_given", F.lit(""))).drop(
        "_canonical", "_given", "_target"
    )


def with_cleaned(pages: DataFrame) -> DataFrame:
    return pages.withColumn("cleaned", H.cleaned_html(F.col("html")))


def _first_ones(items: Column, most: int | None) -> Column:
    return items if most is None else F.slice(items, 1, most)


def _cut(text: Column, most: int | None) -> tuple[Column, Column]:
    """The text, up to ``most`` characters if given, and whether that is not all of it."""
    if most is None:
        return text.alias("text"), F.lit(False).alias("text_truncated")
    return F.substring(text, 1, most).alias("text"), (F.length(text) > most).alias("text_truncated")


def page_headings(pages: DataFrame, most: int | None = None) -> DataFrame:
    """(page_id, pos, level, text), all headings or the first ``most`` of each page."""
    cleaned = with_cleaned(pages).select("page_id", H.heading_list(F.col("cleaned")).alias("_headings"))
    shown = each(cleaned, _first_ones(F.col("_headings"), most), "pos", "_heading", "page_id")
    return shown.select("page_id", "pos", "_heading.level", "_heading.text")


def with_link_counts(df: DataFrame, references: str) -> DataFrame:
    """Counts of links on the page's own host and on others, in the row itself."""
    resolved = resolved_urls(df, references, "_links", "url")
    host = lambda link: F.regexp_replace(url_host(link), r"^www\.", "")
    hosts = F.transform(F.filter("_links", lambda link: link.isNotNull()), host)
    staged = resolved.withColumn("_hosts", hosts).withColumn("_own", host(F.col("url")))
    own = F.size(F.filter("_hosts", lambda other: other == F.col("_own"))).cast("long")
    return (
        staged.withColumn("internal_links", own)
        .withColumn("external_links", F.size("_hosts").cast("long") - own)
        .drop("_links", "_hosts", "_own", references)
    )


def page_links(pages: DataFrame) -> DataFrame:
    read = with_cleaned(pages).select("page_id", "url", H.anchor_references(F.col("cleaned")).alias("_refs"))
    return with_link_counts(read, "_refs").drop("url")


def link_edges(pages: DataFrame, keep: tuple[str, ...] = ("site",)) -> DataFrame:
    """(src, pos, dst) from raw pages, honouring a base element; ``keep`` columns are passed through."""
    raw = pages.select(
        *keep,
        F.col("url").alias("src"),
        H.base_reference(F.col("html")).alias("_base_ref"),
        H.crawl_references(F.col("html")).alias("_refs"),
    )
    based = canonical_url(raw, "_base_ref", "_base_url", "src").withColumn("_against", F.coalesce("_base_url", "src"))
    links = resolved_urls(based, "_refs", "_links", "_against")
    return each(links, "_links", "pos", "dst", *keep, "src").filter(F.col("dst").isNotNull())


def page_text(pages: DataFrame, most: int | None = None) -> DataFrame:
    return _main_text(with_cleaned(pages), "page_id").select("page_id", *_cut(F.col("_text"), most))


def _main_text(cleaned: DataFrame, *keep: str) -> DataFrame:
    fragment = cleaned.select(*keep, H.main_fragment(F.col("cleaned")).alias("_fragment"))
    return fragment.select(*keep, H.readable_text(F.col("_fragment")).alias("_text"))


def page_word_count(pages: DataFrame) -> DataFrame:
    return _main_text(with_cleaned(pages), "page_id").select(
        "page_id", word_count(F.col("_text")).cast("long").alias("word_count")
    )


def page_visible_words(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", word_count(H.visible_text(F.col("html"))).cast("long").alias("visible_words"))


def page_schema_types(pages: DataFrame) -> DataFrame:
    scripts = pages.select("page_id", H.jsonld_scripts(F.col("html")).alias("_scripts"))
    types = F.coalesce(jsonld_types("_scripts"), F.array().cast("array<string>"))
    return scripts.select("page_id", types.alias("schema_types"))


def js_shell_pages(pages: DataFrame) -> DataFrame:
    """Pages built by scripts, by the crawl's rule (all visible words) and by the extraction's (main text)."""
    counted = _main_text(
        with_cleaned(pages).withColumn("_source", H.has_script_source(F.col("html"))).withColumn(
            "_visible", word_count(H.visible_text(F.col("html")))
        ),
        "page_id",
        "_source",
        "_visible",
    )
    return counted.select(
        "page_id",
        (F.col("_source") & (F.col("_visible") < H.SHELL_WORDS)).alias("shell_for_crawl"),
        (F.col("_source") & (word_count(F.col("_text")) < H.SHELL_WORDS)).alias("needs_render"),
    )


def page_contents(
    pages: DataFrame, keep: tuple[str, ...] = (), most_text: int | None = None, most_headings: int | None = None
) -> DataFrame:
    """The full record of a page: one row in, one row out, no shuffle. Whole texts unless limits are given."""
    source, cleaned = F.col("html"), F.col("cleaned")
    first = with_cleaned(pages).select(
        "page_id",
        "url",
        *keep,
        "html",
        "cleaned",
        H.meta_entries(source).alias("_meta"),
        H.canonical_reference(source).alias("_canonical"),
    )
    description = H.meta_content(F.col("_meta"), "description")
    second = first.select(
        "page_id",
        "url",
        *keep,
        "_canonical",
        H.page_language(source).alias("lang"),
        H.title_text(source, F.col("_meta")).alias("title"),
        description.alias("_description"),
        H.meta_content(F.col("_meta"), "og:description").alias("_og_description"),
        H.meta_content(F.col("_meta"), "robots").alias("robots"),
        H.heading_list(cleaned).alias("_headings"),
        H.main_fragment(cleaned).alias("_fragment"),
        H.anchor_references(cleaned).alias("_refs"),
        H.jsonld_scripts(source).alias("_scripts"),
        H.has_script_source(source).alias("_source"),
    )
    third = second.withColumn("_text", H.readable_text(F.col("_fragment"))).withColumn(
        "_types", jsonld_types("_scripts")
    )
    linked = _resolved_canonical(with_link_counts(third, "_refs"))
    level_one = F.get(F.filter("_headings", lambda heading: heading["level"] == 1), F.lit(0))["text"]
    words = word_count(F.col("_text")).cast("long")
    return linked.withColumn("word_count", words).select(
        "page_id",
        "url",
        *keep,
        "lang",
        "title",
        F.when(F.col("_description") != "", F.col("_description")).otherwise(F.col("_og_description")).alias("description"),
        "canonical",
        "robots",
        F.coalesce(level_one, F.lit("")).alias("h1"),
        _first_ones(F.col("_headings"), most_headings).alias("headings"),
        F.coalesce("_types", F.array().cast("array<string>")).alias("schema_types"),
        "word_count",
        "internal_links",
        "external_links",
        *_cut(F.col("_text"), most_text),
        (F.col("_source") & (F.col("word_count") < H.SHELL_WORDS)).alias("needs_render"),
    )
