"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder with the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8),
BENCH_QUERIES a comma-separated choice (default: the list below; ``all`` for every query).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pathloom.catalog import QUERIES  # noqa: E402
from pathloom.session import local_session  # noqa: E402

HEADLINE = [
    "url_patterns", "pattern_groups", "pattern_placeholders", "match_pattern", "spread_sample", "title_template", "ranked_groups",
    "page_meta", "page_headings", "page_links", "page_text", "page_contents", "link_edges", "js_shell_pages",
    "robots_rules", "robots_allowed", "ai_bot_access", "screen_targets",
    "sitemap_entries", "sitemap_stats", "expand_sitemaps", "crawl_frontier", "resolve_redirects", "map_site",
    "fetch_outcome", "decode_bodies", "dns_screen", "latest_results", "job_progress", "results_lookup", "job_targets",
    "sink_contents_csv", "sink_contents_json", "stream_latest", "stream_progress", "stream_page_contents",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [name for name in chosen.split(",") if name] or HEADLINE
    spark = local_session(cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the Python workers' first use outside the timings.
    QUERIES["url_dimension"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total query time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
