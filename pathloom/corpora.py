"""Tables derived from ``pages``: robots texts, sitemaps, fetch logs, jobs, links.

The stored corpus has page captures only. What the other operators read is derived from it by the SQL
below, which Spark and any other engine run alike; the derived tables grow with the pages. ``seq`` is the
order the pages were stored in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.patterns import url_patterns
from .operators.urls import url_dimension
from .plans.scale import attach, rank_in_group
from .session import pin_utc, ship_package
from .sources.pages import table

RICH_HEAD = (
    "'<meta name=\"Description\" content=\"Page ' || CAST(page_id AS VARCHAR(20)) || ' &amp; more &#8217;s\">'"
    " || '<link href=\"/c/' || CAST(page_id AS VARCHAR(20)) || '\" rel=\"alternate CANONICAL\">'"
    " || '<meta content=\"noindex\" property=\"robots\">'"
    " || '<script type=\"application/ld+json\">{{\"@type\":[\"WebPage\",\"Thing\"],\"@graph\":[{{\"@type\":\"Article\"}}],"
    "\"mainEntity\":{{\"@type\":\"Person\"}}}}</script></head>'"
)

READ_LOG = """
        SELECT page_id, site, seq, url,
               CASE WHEN page_id % 16 = 15 THEN 'https://elsewhere.example.org/landing' ELSE url END AS final_url,
               CASE page_id % 12 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 401 WHEN 3 THEN 503 WHEN 4 THEN 404 ELSE 200 END AS status,
               CASE page_id % 12 WHEN 5 THEN 'timeout' WHEN 6 THEN 'network' WHEN 7 THEN 'private' ELSE NULL END AS error_kind,
               CASE WHEN page_id % 12 = 8 THEN 'application/pdf; x=1' ELSE 'text/html; charset=utf-8' END AS content_type,
               CASE page_id % 24 WHEN 0 THEN CAST(page_id % 90 AS VARCHAR(20)) WHEN 12 THEN 'Tue, 06 Oct 2026 10:00:30 GMT'
                                 WHEN 3 THEN '-5' WHEN 15 THEN 'soon' ELSE NULL END AS retry_after,
               CASE WHEN page_id % 24 = 1 THEN 'challenge' ELSE NULL END AS cf_mitigated,
               '2026-10-06T10:00:' || lpad(CAST(page_id % 60 AS VARCHAR(20)), 2, '0') || 'Z' AS fetched_text,
               CASE WHEN page_id % 36 = 21 THEN '<html><head><title> Just a moment... </title></head></html>' ELSE html END AS body, html
        FROM {rows}"""

# Name -> SQL over earlier names, which stand in braces.
DERIVED: dict[str, str] = {
    "site_pages": """
        SELECT page_id,
               regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www[.]', '') AS site,
               page_id AS seq,
               regexp_replace(url, '#.*$', '') AS url,
               html
        FROM {pages}""",
    "pages_rich": f"""
        SELECT page_id, site, seq, url,
               CASE WHEN page_id % 10 = 9
                    THEN '<html lang="en"><head><title>App</title></head><body><div id="root"></div><script src="/app.js"></script></body></html>'
                    ELSE replace(replace(replace(html, '</head>', {RICH_HEAD}),
                         '<article>', CASE WHEN page_id % 3 = 0 THEN '<main><article>' ELSE '<article>' END),
                         '</article>', '<h2>Part &lt;1&gt;</h2><a href="https://other.example.org/x">o</a>'
                           || CASE WHEN page_id % 3 = 0 THEN '</article></main>' ELSE '</article>' END)
               END AS html
        FROM {{site_pages}}""",
    "robots_txt": """
        SELECT site, min(page_id) AS first_id, 'https://' || site AS origin,
               CASE min(page_id) % 4
                 WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /de' || chr(10) || 'Allow: /de/1' || chr(10)
                          || 'Sitemap: /sitemap.xml # main' || chr(10) || 'sitemap: https://cdn.example.org/s.xml' || chr(10) || 'Sitemap: /sitemap.xml'
                 WHEN 1 THEN 'User-agent: GPTBot' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'User-agent: CCBot' || chr(10)
                          || 'User-agent: Bytespider' || chr(10) || 'Disallow: /data' || chr(10) || 'User-agent: *' || chr(10) || 'Allow: /'
                 WHEN 2 THEN '# all' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /*.html$' || chr(10) || 'Disallow: /*page=' || chr(10)
                          || 'Crawl-delay: 5'
                 ELSE '' END AS text
        FROM {site_pages} GROUP BY site""",
    # The text of a site's https origin, and another one for its http origin. Other origins have none.
    "robots_by_origin": """
        SELECT origin, text FROM {robots_txt}
        UNION ALL SELECT 'http://' || site, CASE WHEN first_id % 2 = 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /' ELSE '' END FROM {robots_txt}""",
    "robots_responses": """
        SELECT site,
               CASE WHEN first_id % 5 = 3 THEN 404 ELSE 200 END AS status,
               CASE WHEN first_id % 6 = 5 THEN 'text/html; charset=utf-8' ELSE 'text/plain' END AS content_type,
               text AS body
        FROM {robots_txt}""",
    "sitemap_rows": """
        SELECT site, seq, 'https://' || site || '/sm' || CAST(CAST(floor(seq / 10.0) AS BIGINT) AS VARCHAR(20)) || '.xml' AS sitemap_url,
               'https://' || site || '/index' || CAST(CAST(floor(seq / 100.0) AS BIGINT) AS VARCHAR(20)) || '.xml' AS index_url,
               url AS loc,
               CASE WHEN seq % 4 = 0 THEN NULL
                    WHEN seq % 3 = 1 THEN '2026-10-06T10:00:00+00:00'
                    WHEN seq % 3 = 2 AND seq % 5 = 0 THEN '2026-0' || CAST(1 + seq % 9 AS VARCHAR(20)) || '-15T10:20+02:00'
                    WHEN seq % 5 = 1 THEN '2026/0' || CAST(1 + seq % 9 AS VARCHAR(20)) || '/15'
                    WHEN seq % 5 = 2 THEN 'March ' || CAST(1 + seq % 9 AS VARCHAR(20)) || ', 2026'
                    WHEN seq % 5 = 3 THEN CAST(1 + seq % 9 AS VARCHAR(20)) || ' Apr 2026'
                    ELSE '2026-0' || CAST(1 + seq % 9 AS VARCHAR(20)) || '-15' END AS lastmod,
               CASE WHEN seq % 4 = 0 THEN NULL
                    WHEN seq % 3 = 1 THEN '2026-10-06 10:00:00'
                    WHEN seq % 3 = 2 AND seq % 5 = 0 THEN '2026-0' || CAST(1 + seq % 9 AS VARCHAR(20)) || '-15 08:20:00'
                    WHEN seq % 5 = 2 THEN '2026-03-0' || CAST(1 + seq % 9 AS VARCHAR(20)) || ' 00:00:00'
                    WHEN seq % 5 = 3 THEN '2026-04-0' || CAST(1 + seq % 9 AS VARCHAR(20)) || ' 00:00:00'
                    ELSE '2026-0' || CAST(1 + seq % 9 AS VARCHAR(20)) || '-15 00:00:00' END AS stamp
        FROM {site_pages}""",
    "fetch_log": READ_LOG.format(rows="{site_pages}"),
    # The same log over the pages with all parts, body and page in one row.
    "rich_log": READ_LOG.format(rows="{pages_rich}"),
    "job_results": """
        SELECT attempt * 1000000000 + seq AS off, site AS job_id, url, attempt,
               CASE (page_id + attempt) % 7 WHEN 0 THEN 'r' WHEN 1 THEN 'b' WHEN 2 THEN 's' WHEN 3 THEN 'x' ELSE 'o' END AS mark,
               '2026-10-0' || CAST(1 + attempt AS VARCHAR(20)) || 'T' || lpad(CAST(CAST(floor(seq / 3600.0) AS BIGINT) % 24 AS VARCHAR(20)), 2, '0') || ':'
                 || lpad(CAST(CAST(floor(seq / 60.0) AS BIGINT) % 60 AS VARCHAR(20)), 2, '0') || ':'
                 || lpad(CAST(seq % 60 AS VARCHAR(20)), 2, '0') || 'Z' AS written_text
        FROM (SELECT site, url, page_id, seq, 0 AS attempt FROM {site_pages}
              UNION ALL SELECT site, url, page_id, seq, 1 AS attempt FROM {site_pages} WHERE page_id % 3 = 0) a
        WHERE page_id % 8 <> 5""",
    "job_ends": """
        SELECT job_id, max(written_text) AS ended_text FROM {job_results} GROUP BY job_id HAVING max(off) % 3 = 0""",
    "redirect_hops": """
        SELECT a.url, 301 AS status, b.url AS location
        FROM {site_pages} a JOIN {site_pages} b ON b.page_id = a.page_id + 1
        WHERE a.page_id % 7 <> 6""",
    "captures": """
        SELECT page_id, site, seq, url, (page_id % 6 <> 5) AS ok, 1280 AS width,
               800 + (page_id * 977) % 20000 AS height, (page_id * 4099) % 3000000 AS bytes,
               (800 + (page_id * 977) % 20000 > 16000) AS cut_short
        FROM {site_pages}""",
    "dns_answers": """
        SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
               CASE page_id % 11
                 WHEN 0 THEN '10.1.2.3' WHEN 1 THEN '::ffff:192.168.1.10' WHEN 2 THEN 'fd00::' || CAST(page_id % 10 AS VARCHAR(20))
                 WHEN 3 THEN NULL WHEN 4 THEN '2606:4700::6810:84e5' WHEN 5 THEN '172.32.0.' || CAST(page_id % 200 AS VARCHAR(20))
                 ELSE '93.184.' || CAST(page_id % 256 AS VARCHAR(20)) || '.14' END AS address
        FROM {pages}""",
}


class Corpus:
    """The derived tables of one folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        pin_utc(spark)
        ship_package(spark)
        self.spark, self.folder, self._built = spark, folder, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in DERIVED:
                text = DERIVED[name]
                needed = [other for other in ["pages", *DERIVED] if "{" + other + "}" in text]
                self._built[name] = self.spark.sql(text, **{other: self[other] for other in needed})
            elif name == "pages":
                self._built[name] = table(self.spark, self.folder, name)
            else:
                self._built[name] = getattr(self, name)()
        return self._built[name]

    def site_urls(self) -> DataFrame:
        """(site, seq, url) with canonical URLs."""
        return url_dimension(self["site_pages"].select("site", "seq", "url")).select("site", "seq", "url")

    def patterned(self) -> DataFrame:
        return url_patterns(self["site_urls"])

    def dated_patterned(self) -> DataFrame:
        """The templates with the lastmod of the sitemap rows."""
        stamps = self["sitemap_rows"].select(
            "site", "seq", F.col("stamp").cast("timestamp").alias("lastmod")
        )
        return self["patterned"].join(stamps, ["site", "seq"], "left")

    def job_items(self) -> DataFrame:
        """(job_id, idx, url, pattern, origin); a job is one site's pages in order."""
        return self["patterned"].select(
            F.col("site").alias("job_id"),
            F.col("seq").alias("idx"),
            "url",
            "pattern",
            F.concat(F.lit("https://"), "site").alias("origin"),
        )

    def sitemap_docs(self) -> DataFrame:
        """(site, sitemap_url, xml): urlsets of at most ten URLs and indexes of at most ten urlsets and themselves."""
        rows = self["sitemap_rows"]
        escaped = F.replace("loc", F.lit("&"), F.lit("&amp;"))
        dated = F.concat(F.lit("<lastmod>"), "lastmod", F.lit("</lastmod>"))
        entry = F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc>"), F.coalesce(dated, F.lit("")), F.lit("</url>"))
        in_order = lambda order, text: F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("_text")))), lambda row: row["_text"]), ""
        )
        sets = rows.groupBy("site", "sitemap_url").agg(in_order("seq", entry).alias("_body"))
        sets = sets.select(
            "site",
            "sitemap_url",
            F.concat(F.lit('<?xml version="1.0"?><urlset xmlns:image="i">'), "_body", F.lit("</urlset>")).alias("xml"),
        )
        child = F.concat(F.lit("<sitemap><loc><![CDATA["), "sitemap_url", F.lit("]]></loc></sitemap>"))
        indexes = (
            rows.groupBy("site", "index_url", "sitemap_url")
            .agg(F.min("seq").alias("seq"))
            .groupBy("site", "index_url")
            .agg(in_order("seq", child).alias("_body"))
        )
        itself = F.concat(F.lit("<sitemap><loc>"), "index_url", F.lit("</loc></sitemap>"))
        indexes = indexes.select(
            "site",
            F.col("index_url").alias("sitemap_url"),
            F.concat(F.lit("<sitemapindex>"), itself, "_body", F.lit("</sitemapindex>")).alias("xml"),
        )
        return sets.unionByName(indexes)

    def placed_pages(self) -> DataFrame:
        """(site, place, url): the pages of a site numbered from 1."""
        return rank_in_group(self["site_pages"].select("site", "seq", "url"), ["site"], "seq", "place").select(
            "site", "place", "url"
        )

    def edges(self) -> DataFrame:
        """A cyclic link graph: each page links to pages 2n, 2n+1 and 1 of its site; places with 4 mod 5 get no link."""
        placed = self["placed_pages"]
        wanted = F.posexplode(F.array(F.col("place") * 2, F.col("place") * 2 + 1, F.lit(1).cast("long")))
        links = placed.select("site", F.col("place").alias("_own"), F.col("url").alias("src"), wanted.alias("pos", "_to"))
        links = links.filter((F.col("_to") % 5 != 4) & ~((F.col("pos") == 1) & (F.col("_to") == 1)))
        targets = placed.select("site", F.col("place").alias("_to"), F.col("url").alias("dst"))
        return attach(links, targets, ["site", "_to"], ["src"], how="inner").select("site", "src", "pos", "dst")
