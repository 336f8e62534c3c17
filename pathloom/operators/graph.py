"""Iterative operators: sitemap expansion, link crawl, redirect chains, and what a site's page list comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import bare_host, canonical_url, url_host, url_path
from ..plans.jump import passed_nodes, path_ends
from ..plans.scale import attach, rank_in_group
from ..plans.walk import capped_walk
from ..session import cut_lineage
from .robots import OWN_AGENT, robots_allowed
from .sitemaps import document_kind, sitemap_entries
from .urls import affiliate_path, asset_path, host_refusal


def expand_sitemaps(
    seeds: DataFrame, docs: DataFrame, max_sitemaps: int | None = None, max_urls: int | None = None, width: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From seed sitemaps (site, pos, url) and documents (site, sitemap_url, xml) to page URLs.

    Returns urls (site, position, url, lastmod), read sitemaps (site, position, sitemap_url, found) and
    per site (site, sitemaps, skipped, urls, truncated). Only index documents are walked; the urlsets
    are parsed once, at the end, and only those that were read.
    """
    index = sitemap_entries(docs.filter(document_kind(F.col("xml")) == "index"))
    public = index.filter(host_refusal(url_host(F.col("loc"))).isNull())
    edges = public.select("site", F.col("sitemap_url").alias("src"), "pos", F.col("loc").alias("dst"))
    visited, left = capped_walk(seeds, edges, max_sitemaps)
    known = docs.select("site", F.col("sitemap_url").alias("url"), F.lit(True).alias("_found"))
    read = visited.join(known, ["site", "url"], "left").select(
        "site", "position", F.col("url").alias("sitemap_url"), F.coalesce("_found", F.lit(False)).alias("found")
    )
    pages = docs.join(read.select("site", "sitemap_url", F.col("position").alias("doc_pos")), ["site", "sitemap_url"])
    placed = sitemap_entries(pages.filter(document_kind(F.col("xml")) == "urlset"), keep=("doc_pos",))
    # Place of an entry among all of the site's entries, as one integer.
    place = F.col("doc_pos") * F.lit(1 << 32) + F.col("pos")
    first = placed.groupBy("site", F.col("loc").alias("url")).agg(
        F.min(place).alias("_place"),
        F.max_by("lastmod", F.when(F.col("lastmod").isNotNull(), place)).alias("lastmod"),
    )
    extra = {"width": width} if width else {}
    ranked = rank_in_group(first, ["site"], "_place", "position", **extra)
    kept = ranked if max_urls is None else ranked.filter(F.col("position") <= max_urls)
    urls = kept.select("site", "position", "url", "lastmod")
    found = urls.groupBy("site").agg(F.count(F.lit(1)).alias("_urls"))
    summary = (
        read.groupBy("site")
        .agg(F.count(F.lit(1)).alias("sitemaps"))
        .join(left, "site", "left")
        .join(found, "site", "left")
        .select(
            "site",
            "sitemaps",
            F.coalesce("left", F.lit(0)).alias("skipped"),
            F.coalesce("_urls", F.lit(0)).alias("urls"),
            (F.coalesce("left", F.lit(0)) > 0).alias("_cut"),
        )
    )
    full = F.lit(False) if max_urls is None else F.col("urls") >= max_urls
    return urls, read, summary.select("site", "sitemaps", "skipped", "urls", (F.col("_cut") | full).alias("truncated"))


def followable(edges: DataFrame, texts: DataFrame, agent: str = OWN_AGENT) -> DataFrame:
    """Links a crawl may queue: same site, no file, no partner path, allowed by robots."""
    host, path = url_host(F.col("dst")), url_path(F.col("dst"))
    kept = cut_lineage(edges.filter((bare_host(host) == F.col("site")) & ~asset_path(path) & ~affiliate_path(path)))
    judged = robots_allowed(
        kept.withColumnRenamed("dst", "url").withColumn("seq", F.xxhash64("src", "pos")), texts, agent
    )
    return judged.filter("allowed").select("site", "src", "pos", F.col("url").alias("dst"))


def crawl_frontier(
    origins: DataFrame, reads: DataFrame, edges: DataFrame, texts: DataFrame, cap: int | None = None, agent: str = OWN_AGENT
) -> tuple[DataFrame, DataFrame]:
    """Pages reachable from each homepage by links.

    ``origins`` (site, origin), ``reads`` (site, url, final_url, ok), ``edges`` (site, src, pos, dst) with
    ``src`` the URL that was asked for, ``texts`` (site, text). Returns pages (site, position, url, depth) and per
    site (site, attempted, truncated). A cap counts attempts; pages are the final URLs of good reads on the site.
    """
    good = reads.filter(F.col("ok") & (bare_host(url_host(F.col("final_url"))) == F.col("site")))
    allowed = followable(edges.join(good.select("site", F.col("url").alias("src")), ["site", "src"], "left_semi"), texts, agent)
    homepages = origins.select(
        "site", F.lit(0).cast("long").alias("pos"), F.concat("origin", F.lit("/")).alias("url"), F.lit(0).cast("long").alias("seq")
    )
    seeds = robots_allowed(homepages, texts, agent).filter("allowed").select("site", "pos", "url")
    finals = good.select("site", "url", F.col("final_url").alias("alias"))
    visited, left = capped_walk(seeds, allowed, cap, finals)
    pages = (
        visited.join(finals, ["site", "url"])
        .groupBy("site", F.col("alias").alias("url"))
        .agg(F.min("position").alias("position"), F.min_by("level", "position").alias("depth"))
        .select("site", "position", "url", "depth")
    )
    summary = (
        visited.groupBy("site")
        .agg(F.count(F.lit(1)).alias("attempted"))
        .join(left, "site", "left")
        .select("site", "attempted", (F.coalesce("left", F.lit(0)) > 0).alias("truncated"))
    )
    return pages, summary


def resolve_redirects(starts: DataFrame, hops: DataFrame, stay_on_site: bool = False, max_hops: int | None = None) -> DataFrame:
    """Follow (url, status, location) hops from each start (url): final URL, number of hops, chain and error.

    A chain ends where it comes back to a URL it has passed (``redirect-loop``), or after ``max_hops`` if given
    (``too-many-redirects``). Where it ends depends on the hops alone, so that is worked out once per URL by doubling, in about log2 of
    the longest chain rounds; the chains of the starts are put together after that.
    """
    redirecting = hops.filter(F.col("status").between(300, 399) & F.col("location").isNotNull())
    redirecting = redirecting.groupBy("url").agg(F.min(F.struct("status", "location")).alias("_hop")).select("url", "_hop.*")
    targets = canonical_url(redirecting, "location", "_next", "url")
    host = url_host(F.col("_next"))
    hop = F.struct(F.col("url").alias("url"), "status", F.coalesce("_next", "location").alias("location")).cast("struct<url:string,status:int,location:string>")
    # A chain that stays on its site leaves it with the first hop between two sites.
    leaves = F.lit(stay_on_site) & ~bare_host(host).eqNullSafe(bare_host(url_host(F.col("url"))))
    stop = F.when(F.col("_next").isNull(), "invalid-url").when(leaves, "off-site").when(host_refusal(host).isNotNull(), "private")
    dim = cut_lineage(targets.select(F.col("url").alias("node"), hop.alias("hop"), F.col("_next").alias("next"), stop.alias("stop")))
    ends, tables = path_ends(dim.filter("stop IS NULL").select("node", "next"))

    wanted = starts.select(F.col("url").alias("start")).filter("url IS NOT NULL").distinct()
    led = attach(wanted, ends.withColumnRenamed("node", "start"), ["start"], ["start"])
    led = led.withColumn("end", F.when(F.coalesce("loop", F.lit(False)), F.col("end")).otherwise(F.coalesce("end", "start")))
    stops = dim.filter("stop IS NOT NULL").select(F.col("node").alias("end"), "stop")
    told = attach(led, stops, ["end"], ["start"]).withColumn("stop", F.when(F.col("loop"), "redirect-loop").otherwise(F.col("stop")))
    # The hop a chain stops at is part of it, unless it leads nowhere.
    told = told.withColumn("n", F.coalesce("n", F.lit(0)) + F.coalesce(F.col("stop").isin("off-site", "private").cast("long"), F.lit(0)))
    if max_hops is not None:
        max_hops = max(max_hops, 1)
        over = (F.col("n") > max_hops) | ((F.col("n") == max_hops) & ~F.col("stop").eqNullSafe("off-site"))
        told = told.withColumn("stop", F.when(over, "too-many-redirects").otherwise(F.col("stop"))).withColumn("n", F.least("n", F.lit(max_hops).cast("long")))
    told = cut_lineage(told.select("start", "end", "n", "stop"))
    longest = told.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    nodes = passed_nodes(told, tables, longest)
    chains = (
        attach(nodes, dim.select("node", "hop"), ["node"], ["start"], how="inner")
        .groupBy(F.col("start").alias("_start"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "hop"))), lambda cell: cell["hop"]).alias("chain"))
    )
    whole = told.join(chains, F.col("start") == F.col("_start"), "left")
    last = F.element_at("chain", -1)
    unmoved = F.col("stop").isNotNull() & (F.col("stop") != "invalid-url")
    found = whole.select(
        F.col("start").alias("url"),
        F.when(unmoved, last["url"]).otherwise(F.col("end")).alias("final_url"),
        "chain",
        F.when(F.col("stop") != "off-site", F.col("stop")).alias("error"),
        F.when(F.col("stop") == "off-site", last["location"]).alias("off_site"),
    )
    met = attach(starts.select("url"), found, ["url"], ["url"])
    chain = F.coalesce("chain", F.array().cast("array<struct<url:string,status:int,location:string>>"))
    return met.withColumn("chain", chain).withColumn("hops", F.size("chain").cast("long"))


def map_site(sitemap_urls: DataFrame, crawled: DataFrame) -> DataFrame:
    """(site, source, position, url): the sitemap's pages when it has any, the crawl's otherwise."""
    served = sitemap_urls.select("site").distinct()
    from_sitemap = sitemap_urls.select("site", F.lit("sitemap").alias("source"), "position", "url")
    from_links = crawled.join(served, "site", "left_anti").select("site", F.lit("crawl").alias("source"), "position", "url")
    return from_sitemap.unionByName(from_links)


def remap_choice(mapped: DataFrame) -> DataFrame:
    """Which of a site's mappings (site, attempt, url) is kept: the first, unless it found at most one page and
    a later one found more."""
    counts = mapped.groupBy("site", "attempt").agg(F.count("url").alias("n"))
    first = F.min_by("n", "attempt")
    best = F.max_by("attempt", F.struct(F.col("n"), -F.col("attempt")))
    return (
        counts.groupBy("site")
        .agg(first.alias("first_n"), F.min("attempt").alias("_first"), best.alias("_best"), F.max("n").alias("_most"))
        .select(
            "site",
            F.when(F.col("first_n") <= 1, F.col("_best")).otherwise(F.col("_first")).alias("attempt"),
            F.when(F.col("first_n") <= 1, F.col("_most")).otherwise(F.col("first_n")).alias("urls"),
        )
    )
