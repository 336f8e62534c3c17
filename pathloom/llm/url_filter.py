"""URL filters: rules decide the URLs they fit, trust and distrust over the host graph decide the rest.

Hosts are linked by the absolute links on their pages, and with their parent domain in both directions. Trust starts at
hosts by their number of allowed pages and follows the links; distrust starts at hosts by their number of blocked pages
and follows the links backwards, to those who link to blocked hosts. Both are personalised PageRank with a fixed number of
steps. A host whose distrust exceeds its trust is blocked. Ranks are whole numbers (units of 2**-40), so sums don't
depend on their order and reruns agree. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: The mass each kind of rank starts with.
UNIT = 1 << 40
DAMPING_PERCENT = 85
STEPS = 10
#: Steps worked out between two writes of the ranks to the shared folder.
STEPS_PER_WRITE = 5
#: Keys over which the edges and pages of one host are spread in a join.
SALTS = 8
LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains where the URL's path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null and for a URL without ``://``. Only A-Z of the host are lowered."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    given = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(given, pattern, 1), _UPPER, _LOWER), F.regexp_extract(given, pattern, 2)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does. Of equally long ones the first wins."""
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        found = F.when(fits(rule), F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, host: Column, html: str) -> DataFrame:
    """Distinct (src, dst) links between hosts. ``pages`` may hold one host many times; copies meet before the shuffle."""
    target = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))))
    linked = pages.select(host.alias("src"), target.alias("dst")).withColumn("dst", F.translate("dst", _UPPER, _LOWER)).distinct()
    hosts = pages.select(host.alias("host")).distinct().union(linked.select("dst"))
    # The parents of a.b.c.org are b.c.org and c.org.
    labels = F.split("host", "[.]")
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = F.transform(F.sequence(F.lit(1), F.size("chain") - 1), lambda i: F.struct(F.get("chain", i - 1).alias("src"), F.get("chain", i).alias("dst")))
    family = hosts.filter(F.col("host").contains(".")).distinct().select(chain.alias("chain")).filter(F.size("chain") > 1).select(F.inline(pairs))
    both = family.union(family.select("dst", "src"))
    return linked.filter((F.col("src") != "") & (F.col("src") != F.col("dst"))).union(both).distinct()


def spread_trust(edges: DataFrame, seeds: DataFrame, steps: int = STEPS) -> DataFrame:
    """(host, trust, distrust) after ``steps`` steps from ``seeds`` (host, allowed, blocked: numbers of pages).

    A host splits its rank evenly among its links, rounded down; what has no link to follow is lost.
    """
    totals = seeds.agg(*[F.greatest(F.coalesce(F.sum(c), F.lit(0)), F.lit(1)).alias(c) for c in ("allowed", "blocked")]).first()
    start = cut_lineage(
        seeds.select("host", *[F.floor(F.col(c) / F.lit(float(totals[c])) * F.lit(float(UNIT))).alias(c) for c in ("allowed", "blocked")])
    )
    out, into = edges.groupBy("src").agg(F.count("*").alias("n")), edges.groupBy("dst").agg(F.count("*").alias("n"))
    forward = edges.join(out, "src").select(F.col("src").alias("from"), F.col("dst").alias("to"), "n", F.lit(True).alias("ahead"))
    back = edges.join(into, "dst").select(F.col("dst").alias("from"), F.col("src").alias("to"), "n", F.lit(False).alias("ahead"))
    ways = cut_lineage(forward.union(back).withColumn("salt", F.pmod(F.xxhash64("to"), F.lit(SALTS)).cast("int")))
    ranks = start.select("host", F.col("allowed").alias("trust"), F.col("blocked").alias("distrust"))
    none = F.lit(0).cast("long")
    for step in range(1, steps + 1):
        salted = ranks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sent = ways.join(salted, (ways["from"] == salted["host"]) & (ways["salt"] == salted["salt"])).select(
            F.col("to").alias("host"),
            F.when(F.col("ahead"), F.expr(f"trust * {DAMPING_PERCENT} div (100 * n)")).otherwise(none).alias("trust"),
            F.when(~F.col("ahead"), F.expr(f"distrust * {DAMPING_PERCENT} div (100 * n)")).otherwise(none).alias("distrust"),
        )
        again = start.select(
            "host", F.expr(f"allowed * {100 - DAMPING_PERCENT} div 100").alias("trust"), F.expr(f"blocked * {100 - DAMPING_PERCENT} div 100").alias("distrust")
        )
        ranks = sent.union(again).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if step % STEPS_PER_WRITE == 0 or step == steps:
            ranks = cut_lineage(ranks)
    return ranks


def filter_urls(pages: DataFrame, rules: list[Rule], id: str = "page_id", url: str = "url", html: str = "html", steps: int = STEPS) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``trust``, ``distrust``.

    The longest rule that fits decides; without one the host's ranks do, and a host without ranks is allowed. Null and
    odd URLs have an empty host, which no rule fits and no link reaches. Rows that repeat are judged each.
    """
    host, path = host_and_path(F.col(url))
    judged = pages.select(F.col(id).alias("id"), host.alias("host"), path.alias("path")).withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    count = lambda verdict: F.count(F.when(F.col("found.verdict") == verdict, 1))
    seeds = judged.groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked"))
    seeds = cut_lineage(seeds.filter((F.col("allowed") > 0) | (F.col("blocked") > 0)))
    ranks = spread_trust(cut_lineage(host_edges(pages, host, html)), seeds, steps)
    ranks = ranks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = judged.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
    method = F.when(F.col("distrust") > F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(ranks, ["host", "salt"], "left").select(
        F.col("id").alias(id),
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", method).alias("verdict"),
        F.coalesce("trust", F.lit(0)).alias("trust"),
        F.coalesce("distrust", F.lit(0)).alias("distrust"),
    )
