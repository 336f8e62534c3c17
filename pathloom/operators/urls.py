"""Projections and predicates over URL tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, trimmed
from ..functions.urls import (
    bare_host,
    canonical_url,
    path_segments,
    url_host,
    url_origin,
    url_path,
    url_query,
)
from ..plans.scale import rank_in_group

# First path words that send visitors on to partners.
AFFILIATE_WORDS = ["go", "out", "visit", "recommends", "link", "bet", "refer", "redirect", "goto", "click"]

# Endings of files that are not pages (patterns with an optional letter count as one entry).
ASSET_ENDINGS = [
    "png", "jpe?g", "gif", "webp", "avif", "svg", "ico", "bmp", "tiff?", "css", "js", "mjs", "map", "json", "xml",
    "gz", "txt", "pdf", "zip", "rar", "woff2?", "ttf", "otf", "eot", "mp3", "mp4", "m4a", "m4v", "webm", "ogg", "ogv",
    "wav", "mov", "avi", "wmv", "flv",
]

# Reasons a host is refused.
IPV6_HOST = "IP addresses in IPv6 form aren't supported. Enter the site's domain name instead."
LOCAL_HOST = "Local addresses can't be mapped. Enter a public domain, like example.com."
INTERNAL_HOST = "Internal network addresses can't be mapped. Enter a public domain, like example.com."
PRIVATE_HOST = "Private and local IP addresses can't be mapped. Enter a public domain, like example.com."
DOTLESS_HOST = "That domain is missing its ending, like .com or .co.uk. Enter the full domain."
NO_DOMAIN = "Enter a domain, like example.com."
BAD_DOMAIN = "That doesn't look like a valid domain."

# Reasons a target is not read.
BAD_URL = "Not a valid URL."
PRIVATE_TARGET = "Private and local addresses can't be read."
AFFILIATE_TARGET = "Affiliate redirect path: recorded, not requested."
ROBOTS_TARGET = "Blocked by the site's robots.txt."


def private_ipv4(a: Column, b: Column, c: Column) -> Column:
    """Whether the first three numbers of an IPv4 address put it in a non-public range."""
    return (
        a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & ((b == 168) | ((b == 0) & (c == 0))))
        | ((a == 198) & b.isin(18, 19))
    )


def ipv4_numbers(text: Column) -> Column:
    """Four numbers of a dotted quad, NULL for anything else."""
    quad = F.when(text.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z"), F.split(text, r"\."))
    numbers = F.transform(quad, lambda part: part.cast("int"))
    return F.when(F.array_max(numbers) <= 255, numbers)


def host_refusal(host: Column) -> Column:
    """Why a host name is not public, NULL when it is."""

    def reason(name: Column) -> Column:
        private = let(ipv4_numbers(name), lambda quad: private_ipv4(quad[0], quad[1], quad[2]))
        return (
            F.when(name.contains(":") | name.startswith("["), F.lit(IPV6_HOST))
            .when((name == "localhost") | name.endswith(".localhost"), F.lit(LOCAL_HOST))
            .when(name.endswith(".local") | name.endswith(".internal"), F.lit(INTERNAL_HOST))
            .when(F.coalesce(private, F.lit(False)), F.lit(PRIVATE_HOST))
            .when(~name.contains("."), F.lit(DOTLESS_HOST))
        )

    return let(F.regexp_replace(F.lower(host), r"\.\z", ""), reason)


def affiliate_path(path: Column) -> Column:
    return path.rlike(rf"(?i)^/(?:{'|'.join(AFFILIATE_WORDS)})/")


def asset_path(path: Column) -> Column:
    return path.rlike(rf"(?i)\.(?:{'|'.join(ASSET_ENDINGS)})\z")


def url_dimension(df: DataFrame, url: str = "url", base: str | None = None) -> DataFrame:
    """Canonical URL and its parts; rows that are not http(s) are dropped."""
    resolved = canonical_url(df.withColumnRenamed(url, "_raw"), "_raw", "url", base).filter(F.col("url").isNotNull())
    address = F.col("url")
    return (
        resolved.drop("_raw")
        .withColumn("origin", url_origin(address))
        .withColumn("host", url_host(address))
        .withColumn("bare_host", bare_host(F.col("host")))
        .withColumn("path", url_path(address))
        .withColumn("query", url_query(address))
        .withColumn("segments", path_segments(F.col("path")))
        .withColumn("depth", F.size("segments").cast("long"))
    )


def sites_from_input(df: DataFrame, text: str = "domain") -> DataFrame:
    """Free-text domains: the origin to map, or why the input is refused."""
    typed = trimmed(F.col(text))
    absolute = F.when(typed.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), typed).otherwise(F.concat(F.lit("https://"), typed))
    resolved = canonical_url(df.withColumn("_absolute", absolute), "_absolute", "_url")
    reason = (
        F.when(typed == "", F.lit(NO_DOMAIN))
        .when(F.col("_url").isNull(), F.lit(BAD_DOMAIN))
        .otherwise(host_refusal(url_host(F.col("_url"))))
    )
    return (
        resolved.withColumn("reject_reason", reason)
        .withColumn("origin", F.when(F.col("reject_reason").isNull(), url_origin(F.col("_url"))))
        .drop("_absolute", "_url")
    )


def screen_hosts(df: DataFrame, host: str = "host") -> DataFrame:
    return df.withColumn("reason", host_refusal(F.col(host)))


def screen_affiliate(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("affiliate", affiliate_path(url_path(F.col(url))))


def screen_assets(df: DataFrame, url: str = "url") -> DataFrame:
    return df.filter(~asset_path(url_path(F.col(url))))


def target_error(url: Column, robots_allowed: Column) -> Column:
    """First failing check of a canonical URL (NULL for one that could not be parsed)."""
    return F.coalesce(
        F.when(url.isNull(), F.lit(BAD_URL)),
        F.when(host_refusal(url_host(url)).isNotNull(), F.lit(PRIVATE_TARGET)),
        F.when(affiliate_path(url_path(url)), F.lit(AFFILIATE_TARGET)),
        F.when(~robots_allowed, F.lit(ROBOTS_TARGET)),
    )


def site_scope_items(df: DataFrame, cap: int | None = None, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Job items from (job_id, site, seq, url, pattern), and the rejected rows with a reason.

    Kept: http(s) URLs on the job's own site, first occurrence, all or the first ``cap`` per job.
    """
    resolved = canonical_url(df.withColumnRenamed("url", "raw_url"), "raw_url", "url")
    off_site = bare_host(url_host(F.col("url"))) != bare_host(F.col("site"))
    shown = F.col("raw_url")
    reason = F.when(F.col("url").isNull() & ~F.coalesce(F.col("raw_url").rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(False)),
                    F.concat(F.lit("Not a valid URL: "), shown)).when(
        F.col("url").isNull() | off_site,
        F.concat(F.lit("Only URLs on "), F.col("site"), F.lit(" can be analysed: "), shown),
    )
    checked = resolved.withColumn("reject_reason", reason)
    rejected = checked.filter(F.col("reject_reason").isNotNull()).select("job_id", "seq", "raw_url", "reject_reason")
    pattern = F.when(F.col("pattern").startswith("/"), F.col("pattern")).otherwise("/")
    first = (
        checked.filter(F.col("reject_reason").isNull())
        .groupBy("job_id", "url")
        .agg(F.min("seq").alias("seq"), F.min_by(pattern, "seq").alias("pattern"))
    )
    extra = {"width": width} if width else {}
    items = (
        rank_in_group(first, ["job_id"], "seq", "_rn", **extra)
        .filter(F.lit(True) if cap is None else F.col("_rn") <= cap)
        .select("job_id", (F.col("_rn") - 1).alias("idx"), "url", "pattern")
    )
    return items, rejected


def compact_url(url: Column, origin: Column) -> Column:
    """Path only for URLs on the origin, the URL itself otherwise."""
    on_origin = url.startswith(F.concat(origin, F.lit("/")))
    return F.when(on_origin, F.substring(url, F.length(origin) + 1, F.lit(1 << 30))).otherwise(url)


def absolute_url(url: Column, origin: Column) -> Column:
    return F.when(url.startswith("/"), F.concat(origin, url)).otherwise(url)


def compact_urls(df: DataFrame, url: str = "url", origin: str = "site_origin") -> DataFrame:
    return df.withColumn("compact", compact_url(F.col(url), F.col(origin))).withColumn(
        "restored", absolute_url(F.col("compact"), F.col(origin))
    )


def slug_of(url: Column, most: int | None = None) -> Column:
    """File name text from path and query: letters, digits and single dashes; whole, or its first ``most`` characters."""
    place = F.when(url.rlike("^https?://"), F.concat(url_path(url), url_query(url))).otherwise(url)
    dashed = F.regexp_replace(F.lower(place), "[^a-z0-9]+", "-")
    whole = F.regexp_replace(dashed, r"^-+|-+\z", "")
    cut = whole if most is None else F.substring(whole, 1, most)
    return F.when(cut == "", F.lit("home")).otherwise(cut)


def capture_slug(df: DataFrame, url: str = "url", most: int | None = None) -> DataFrame:
    return df.withColumn("slug", slug_of(F.col(url), most))


def first_seen_urls(df: DataFrame, cap: int | None = None, width: int | None = None) -> DataFrame:
    """Distinct URLs of (site, seq, url) in first-seen order, all or ``cap`` per site; ``truncated`` once a cap is reached."""
    first = df.groupBy("site", "url").agg(F.min("seq").alias("seq"))
    extra = {"width": width} if width else {}
    ranked = rank_in_group(first, ["site"], "seq", "_rn", size="_size", **extra)
    full = F.lit(False) if cap is None else F.col("_size") >= cap
    kept = ranked if cap is None else ranked.filter(F.col("_rn") <= cap)
    return kept.select("site", "seq", "url", F.col("_rn").alias("position"), full.alias("truncated"))


def common_origin(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """The origin most URLs of a site share. ``fallback`` (site, fallback_origin) wins ties, then first seen."""
    counts = (
        df.groupBy("site", url_origin(F.col("url")).alias("origin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
        .join(fallback, "site", "left")
    )
    known = F.coalesce(F.col("origin") == F.col("fallback_origin"), F.lit(False))
    best = F.max_by("origin", F.struct(F.col("n"), known, -F.col("first_seq")))
    return counts.groupBy("site").agg(best.alias("origin"), F.max("n").alias("n"))


