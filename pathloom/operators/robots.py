"""robots texts: rules, groups per agent, decisions per URL, access of AI crawlers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import S, each, js_number, trimmed
from ..functions.urls import resolved_urls, url_origin, url_path, url_query
from ..plans.scale import attach

# The crawlers reported on. The agent that reads pages is a parameter everywhere.
AI_CRAWLERS = ["GPTBot", "ClaudeBot", "CCBot", "Google-Extended", "PerplexityBot", "Bytespider"]
OWN_AGENT = "pathloombot"


def _lines(texts: DataFrame) -> DataFrame:
    """(site, line, field, value) of all ``field: value`` lines."""
    rows = each(texts, F.split("text", "\r?\n", -1), "line", "_raw", "site")
    bare = trimmed(F.regexp_replace("_raw", "#.*$", ""))
    shape = rf"^([A-Za-z-]+){S}*:{S}*(.*)\z"
    parsed = rows.withColumn("_bare", bare).filter(F.col("_bare").rlike(shape))
    return parsed.select(
        "site",
        "line",
        F.lower(F.regexp_extract("_bare", shape, 1)).alias("field"),
        trimmed(F.regexp_extract("_bare", shape, 2)).alias("value"),
    )


def scan_robots(responses: DataFrame, most: int | None = None) -> DataFrame:
    """Usable text per (site, status, content_type, body): empty for errors and HTML answers, else the whole text (or its
    first ``most`` characters)."""
    usable = (F.col("status") < 400) & ~F.col("content_type").rlike("(?i)text/html")
    return responses.select(
        "site", F.when(usable, F.col("body") if most is None else F.substring("body", 1, most)).otherwise(F.lit("")).alias("text")
    )


def scan_robots_sitemaps(texts: DataFrame) -> DataFrame:
    """(site, pos, url) of the sitemap lines, resolved on (site, origin, text), each URL once in order."""
    found = (
        each(texts, F.split("text", "\r?\n", -1), "line", "_raw", "site", "origin")
        .withColumn("_value", F.regexp_extract(trimmed(F.regexp_replace("_raw", "#.*$", "")), rf"(?i)^sitemap{S}*:{S}*(.*)\z", 1))
        .filter(trimmed(F.regexp_replace("_raw", "#.*$", "")).rlike(rf"(?i)^sitemap{S}*:"))
        .withColumn("_base_url", F.concat("origin", F.lit("/")))
        .withColumn("_refs", F.array("_value"))
    )
    resolved = resolved_urls(found, "_refs", "_urls", "_base_url").withColumn("url", F.get("_urls", F.lit(0)))
    once = resolved.filter(F.col("url").isNotNull()).groupBy("site", "url").agg(F.min("line").alias("line"))
    # The lines of one robots text, which is one row of the input.
    place = F.row_number().over(Window.partitionBy("site").orderBy("line")) - 1
    return once.select("site", place.alias("pos"), "url")


def robots_groups(texts: DataFrame) -> DataFrame:
    """(site, group_id, agents, rules, crawl_delay); rules are (pos, allow, path). Bounded by the text's length."""
    kept = _lines(texts).filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    by_line = Window.partitionBy("site").orderBy("line")
    names = F.col("field") == "user-agent"
    starts = names & F.coalesce(F.lag("field").over(by_line) != "user-agent", F.lit(True))
    numbered = kept.withColumn("_starts", starts.cast("int")).withColumn("group_id", F.sum("_starts").over(by_line))
    rule = F.col("field").isin("allow", "disallow") & (F.col("value") != "")
    delay = F.when(F.col("field") == "crawl-delay", js_number(F.col("value")))
    return (
        numbered.filter(F.col("group_id") > 0)
        .groupBy("site", "group_id")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.when(names, F.struct("line", F.lower("value").alias("name"))))),
                lambda agent: agent["name"],
            ).alias("agents"),
            F.array_sort(
                F.collect_list(
                    F.when(rule, F.struct("line", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path")))
                )
            ).alias("rules"),
            F.max_by(delay, F.when(delay.isNotNull(), F.col("line"))).alias("crawl_delay"),
        )
    )


def robots_rules(texts: DataFrame) -> DataFrame:
    """One row per group, agent and rule; groups without rules keep a row with NULL rule columns."""
    groups = robots_groups(texts)
    return (
        groups.select("site", "group_id", F.explode("agents").alias("agent"), "crawl_delay", "rules")
        .select("site", "group_id", "agent", "crawl_delay", F.posexplode_outer("rules").alias("rule_pos", "_rule"))
        .select(
            "site", "group_id", "agent", "rule_pos", F.col("_rule.allow").alias("allow"), F.col("_rule.path").alias("path"), "crawl_delay"
        )
    )


def _for_agent(groups: Column, token: Column) -> Column:
    """The groups naming the agent, or the ``*`` groups when none does."""
    own = F.filter(groups, lambda g: F.exists(g["agents"], lambda name: (name != "*") & token.startswith(name)))
    general = F.filter(groups, lambda g: F.array_contains(g["agents"], "*"))
    return F.when(F.size(own) > 0, own).otherwise(general)


def site_groups(texts: DataFrame) -> DataFrame:
    """All groups of a site in one array, in file order."""
    return robots_groups(texts).groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("group_id", "agents", "rules"))).alias("groups")
    )


def robots_agent_groups(texts: DataFrame, agent: str = OWN_AGENT) -> DataFrame:
    """(site, group_id) of the groups that apply to an agent."""
    chosen = _for_agent(F.col("groups"), F.lit(agent.lower()))
    return site_groups(texts).select("site", F.explode(chosen).alias("_group")).select("site", "_group.group_id")


def _prepared(rule: Column) -> Column:
    """A rule split at its wildcards once per site, so URLs are tested with plain string search."""
    anchored = rule["path"].endswith("$")
    body = F.when(anchored, F.substring(rule["path"], F.lit(1), F.length(rule["path"]) - 1)).otherwise(rule["path"])
    parts = F.split(body, r"\*", -1)
    return F.struct(
        F.length(rule["path"]).alias("size"),
        rule["allow"].alias("allow"),
        anchored.alias("anchored"),
        F.get(parts, F.lit(0)).alias("first"),
        F.slice(parts, F.lit(2), F.size(parts) - 1).alias("rest"),
    )


def agent_rules(texts: DataFrame, agent: str = OWN_AGENT) -> DataFrame:
    """(site, rules): the prepared rules for one agent."""
    chosen = F.flatten(F.transform(_for_agent(F.col("groups"), F.lit(agent.lower())), lambda g: g["rules"]))
    return site_groups(texts).select("site", F.transform(chosen, _prepared).alias("rules"))


def _end_after(path: Column, rest: Column, start: Column) -> Column:
    """Where the leftmost match of the parts in order ends; -1 when there is none."""

    def step(at: Column, part: Column) -> Column:
        found = F.call_function("locate", part, path, at + 1)
        return F.when((at < 0) | (part == ""), at).when(found == 0, F.lit(-1)).otherwise(found - 1 + F.length(part))

    return F.aggregate(rest, start, step)


def rule_matches(rule: Column, path: Column) -> Column:
    start = F.when(path.startswith(rule["first"]), F.length(rule["first"])).otherwise(F.lit(-1))
    last = F.element_at(rule["rest"], -1)
    inner = F.slice(rule["rest"], F.lit(1), F.size(rule["rest"]) - 1)
    to_the_end = F.when(F.size(rule["rest"]) == 0, path == rule["first"]).otherwise(
        path.endswith(last) & _end_after(path, inner, start).between(F.lit(0), F.length(path) - F.length(last))
    )
    return F.when(rule["anchored"], to_the_end).otherwise(_end_after(path, rule["rest"], start) >= 0)


def allowed_by(rules: Column, path: Column) -> Column:
    """Longest matching rule wins, Allow wins a tie, no rule allows; the robots file itself is always allowed."""
    hits = F.filter(rules, lambda rule: rule_matches(rule, path))
    best = F.array_max(F.transform(hits, lambda rule: F.struct(rule["size"].alias("size"), rule["allow"].alias("allow"))))
    return (path == "/robots.txt") | F.coalesce(best["allow"], F.lit(True))


def robots_allowed(urls: DataFrame, texts: DataFrame, agent: str = OWN_AGENT, by_origin: bool = False) -> DataFrame:
    """Adds ``allowed`` to (site, seq, url). A URL row meets its rules once, as one array.

    The rules are those of the URL's site in ``texts`` (site, text), or ``by_origin`` those of its own origin in ``texts``
    (origin, text): then another scheme, port or subdomain has rules of its own, and none where it has no text.
    """
    if by_origin:
        rules = agent_rules(texts.select(F.col("origin").alias("site"), "text"), agent).withColumnRenamed("site", "_origin")
        attached = attach(urls.withColumn("_origin", url_origin(F.col("url"))), rules, ["_origin"], ["seq"]).drop("_origin")
    else:
        attached = attach(urls, agent_rules(texts, agent), ["site"], ["seq"])
    tested = attached.withColumn("_path", F.concat(url_path(F.col("url")), url_query(F.col("url"))))
    return tested.withColumn("allowed", allowed_by(F.col("rules"), F.col("_path"))).drop("rules", "_path")


def ai_bot_access(texts: DataFrame) -> DataFrame:
    """Six rows per site: blocked, partly blocked or allowed, and whether the crawler has a group of its own."""
    groups = texts.select("site").join(site_groups(texts), "site", "left")
    known = F.coalesce("groups", F.array().cast(groups.schema["groups"].dataType))
    per_bot = groups.select("site", known.alias("groups"), F.explode(F.array(*[F.lit(b) for b in AI_CRAWLERS])).alias("bot"))
    token = F.lower("bot")
    chosen = F.flatten(F.transform(_for_agent(F.col("groups"), token), lambda g: g["rules"]))
    ruled = per_bot.withColumn("_rules", F.transform(chosen, _prepared)).withColumn(
        "own_group",
        F.exists("groups", lambda g: F.exists(g["agents"], lambda name: (name != "*") & token.startswith(name))),
    )
    access = (
        F.when(~allowed_by(F.col("_rules"), F.lit("/")), F.lit("blocked"))
        .when(F.exists("_rules", lambda rule: ~rule["allow"]), F.lit("partly blocked"))
        .otherwise("allowed")
    )
    return ruled.select("site", "bot", access.alias("access"), "own_group")
