"""URL templates: grouping, statistics, placeholder kinds, matching, samples and title templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import each, percent_decoded, sequence_template, shared_sequence, word_list
from ..functions.urls import path_segments, url_path
from ..plans.scale import attach, first_k, rank_by_order, rank_in_group
from ..session import cut_lineage

# Limits of the grouping rules.
MAX_LITERALS = 6
MAX_LITERAL_LENGTH = 40
MAX_LONE_WORDS = 3


def _variable(part: Column) -> Column:
    return part.rlike("[0-9]") | (F.length(part) > MAX_LITERAL_LENGTH)


def _dashed_words(part: Column) -> Column:
    return F.size(F.filter(F.split(part, "-", -1), lambda word: word != ""))


def _doubtful(part: Column) -> Column:
    """A lone first segment that only counts as a section when pages lie beneath it."""
    return _variable(part) | (_dashed_words(part) > MAX_LONE_WORDS)


def url_patterns(urls: DataFrame) -> DataFrame:
    """Adds ``pattern`` to (site, seq, url); ``url`` is canonical and ``seq`` unique within a site."""
    parted = urls.withColumn("_parts", path_segments(url_path(F.col("url"))))
    parted = parted.withColumn("_depth", F.size("_parts")).withColumn("_first", F.get("_parts", F.lit(0)))

    # Sections are looked up only for the lone segments that need it.
    sections = (
        parted.filter((F.col("_depth") > 1) & _doubtful(F.col("_first")))
        .select("site", F.col("_first").alias("_lone"))
        .distinct()
        .withColumn("_section", F.lit(True))
    )
    parted = parted.withColumn("_lone", F.when((F.col("_depth") == 1) & _doubtful(F.col("_first")), F.col("_first")))
    clear = parted.filter(F.col("_lone").isNull()).withColumn("_section", F.lit(None).cast("boolean"))
    parted = clear.unionByName(attach(parted.filter(F.col("_lone").isNotNull()), sections, ["site", "_lone"], ["seq"]))
    head = (
        F.when(F.col("_depth") == 0, F.lit(""))
        .when(F.col("_depth") == 1, F.when(F.col("_lone").isNull() | F.col("_section"), F.col("_first")).otherwise("*"))
        .otherwise(F.when(_variable(F.col("_first")), F.lit("*")).otherwise(F.col("_first")))
    )
    parted = parted.withColumn("_head", head).drop("_lone", "_section", "_first")

    # Literals per shape and position. Seven values prove that there are too many, so no more
    # than seven per group leave any partition.
    shape = ["site", "_head", "_depth"]
    counted = (
        parted.filter(F.col("_depth") > 1)
        .transform(each, F.slice("_parts", F.lit(2), F.col("_depth")), "_pos", "_value", *shape)
        .groupBy(*shape, "_pos", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    few = first_k(counted, [*shape, "_pos"], [F.col("_value")], MAX_LITERALS + 1)
    usable = F.when(~_variable(F.col("_value")) & (F.col("_n") >= 2), F.col("_value"))
    literals = (
        few.groupBy(*shape, "_pos")
        .agg(F.count(F.lit(1)).alias("_distinct"), F.collect_list(usable).alias("_words"))
        .filter((F.col("_distinct") <= MAX_LITERALS) & (F.size("_words") > 0))
        .groupBy(*shape)
        .agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_words"))).alias("_literals"))
    )
    parted = attach(parted, literals, shape, ["seq"])

    rest = F.slice("_parts", F.lit(2), F.greatest(F.col("_depth") - 1, F.lit(0)))
    named = F.transform(
        rest,
        lambda part, at: F.when(
            F.coalesce(F.array_contains(F.try_element_at(F.col("_literals"), at), part), F.lit(False)), part
        ).otherwise("*"),
    )
    pattern = F.when(F.col("_depth") == 0, F.lit("/")).otherwise(
        F.concat(F.lit("/"), F.array_join(F.concat(F.array("_head"), named), "/"))
    )
    return parted.withColumn("pattern", pattern).select(*urls.columns, "pattern")


def share_of(part: Column, whole: Column) -> Column:
    """Percent with one decimal, halves rounded up."""
    return F.floor(part / whole * F.lit(1000.0) + F.lit(0.5)).cast("double") / F.lit(10.0)


def pattern_groups(urls: DataFrame) -> DataFrame:
    """Size, share and freshness per template, from (site, url, pattern, lastmod)."""
    groups = urls.groupBy("site", "pattern").agg(
        F.count(F.lit(1)).alias("count"),
        F.max("lastmod").alias("lastmod_newest"),
        F.min("lastmod").alias("lastmod_oldest"),
        F.count("lastmod").alias("_dated"),
    )
    totals = groups.groupBy("site").agg(F.sum("count").alias("_total"))
    return attach(groups, totals, ["site"], ["pattern"]).select(
        "site",
        "pattern",
        "count",
        share_of(F.col("count"), F.col("_total")).alias("share"),
        "lastmod_newest",
        "lastmod_oldest",
        F.floor(F.col("_dated") / F.col("count") * F.lit(100.0) + F.lit(0.5)).cast("long").alias("lastmod_coverage"),
    )


def ranked_groups(groups: DataFrame) -> DataFrame:
    """Rank per site by size, then pattern."""
    return rank_by_order(groups, ["site"], [F.col("count").desc(), F.col("pattern").asc()], "rank")


def group_preview(urls: DataFrame, k: int) -> DataFrame:
    """The first ``k`` URLs of each template and how many more there are."""
    sizes = urls.groupBy("site", "pattern").agg(F.count(F.lit(1)).alias("_count"))
    shown = first_k(urls, ["site", "pattern"], [F.col("seq")], k, rank="position")
    return shown.join(sizes, ["site", "pattern"]).select(
        "site", "pattern", "position", "url", F.greatest(F.col("_count") - k, F.lit(0)).alias("more")
    )


def group_bar(groups: DataFrame) -> DataFrame:
    """Size relative to the site's largest template in percent, at least 1."""
    largest = groups.groupBy("site").agg(F.max("count").alias("_largest"))
    width = F.greatest(F.col("count") * F.lit(100.0) / F.col("_largest"), F.lit(1.0))
    return attach(groups, largest, ["site"], ["pattern"]).select("site", "pattern", "count", width.alias("bar"))


# ---- placeholder kinds -------------------------------------------------------------------------

# Shapes of the placeholder kinds.
_YEAR = "(?:19|20)[0-9]{2}"
_DAY_FIRST = rf"[0-9]{{1,2}}[-_.][0-9]{{1,2}}[-_.]{_YEAR}"
_YEAR_FIRST = rf"{_YEAR}[-_.][0-9]{{1,2}}[-_.][0-9]{{1,2}}"
DATE_IN_TEXT = rf"(?:^|[-_.])(?:{_YEAR_FIRST}|{_DAY_FIRST})(?:\z|[-_.])"
MONTH_IN_TEXT = (
    r"(?i)(?:^|[-_])(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
    rf"[-_][0-9]{{1,2}}(?:st|nd|rd|th)?[-_]{_YEAR}(?:\z|[-_])"
)
WHOLE_DATE = rf"^(?:{_YEAR}-[0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]{{1,2}}-[0-9]{{1,2}}-{_YEAR}|(?:19|20)[0-9]{{6}})\z"
HEX_ID = r"(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{12,})\z"
SLUG = r"^[\p{L}\p{N}]+(?:[-_.~][\p{L}\p{N}]+)*+\z"
PAGE_WORDS = ["page", "p", "pages", "seite", "pagina"]


def segment_kind(value: Column, previous: Column) -> Column:
    """Kind of a path segment; ``previous`` is the literal segment before it, or NULL."""
    v = F.regexp_replace(percent_decoded(value), r"(?i)\.(?:html?|php|aspx?)\z", "")
    short_number = v.rlike(r"^[0-9]{1,4}\z")
    mixed_code = (
        v.rlike(r"(?i)^[a-z0-9]{6,}\z") & v.rlike("[0-9]") & v.rlike("(?i)[a-z]") & ~v.rlike(r"(?i)^[a-z]+[0-9]{1,3}\z")
    )
    after_page = F.coalesce(F.lower(previous).isin(PAGE_WORDS), F.lit(False))
    return (
        F.when(v.rlike(WHOLE_DATE), F.lit("date"))
        .when(v.rlike(rf"^{_YEAR}\z"), F.lit("year"))
        .when(v.rlike(r"(?i)^page[-_]?[0-9]+\z") | (short_number & after_page), F.lit("page number"))
        .when(short_number, F.lit("number"))
        .when(v.rlike(r"^[0-9]{5,}\z") | v.rlike(HEX_ID) | mixed_code, F.lit("id"))
        .when(v.rlike("[-_]") & (v.rlike(DATE_IN_TEXT) | v.rlike(MONTH_IN_TEXT)), F.lit("slug with date"))
        .when(v.rlike(SLUG) & v.rlike(r"\p{L}"), F.lit("slug"))
        .otherwise("mixed")
    )


def segment_kinds(df: DataFrame, value: str = "value", previous: str = "previous") -> DataFrame:
    return df.withColumn("kind", segment_kind(F.col(value), F.col(previous)))


def pattern_placeholders(urls: DataFrame, width: int | None = None) -> DataFrame:
    """Kind and up to three examples (first, middle and last distinct value) per ``*`` position, from all URLs."""
    extra = {"width": width} if width else {}
    names = F.split(F.substring("pattern", 2, 1 << 30), "/", -1)
    cells = (
        urls.select("site", "pattern", "seq", names.alias("_names"), path_segments(url_path(F.col("url"))).alias("_parts"))
        .transform(each, "_parts", "position", "value", "site", "pattern", "seq", "_names")
        .filter(F.get("_names", F.col("position")) == "*")
    )
    place = ["site", "pattern", "position"]
    before = F.when(F.col("position") > 0, F.get("_names", F.col("position") - 1))
    # The value's kind depends on the template, not on the URL. Counts meet before the shuffle.
    values = cells.groupBy(*place, "value").agg(
        F.min("seq").alias("seq"), F.count(F.lit(1)).alias("_n"), F.first(F.when(before != "*", before), True).alias("_before")
    )
    ranked = rank_in_group(values, place, "seq", "_rn", "_distinct", **extra)
    ranked = ranked.withColumn("_kind", segment_kind(F.col("value"), F.col("_before")))
    kinds = ranked.groupBy(*place, "_kind").agg(F.sum("_n").alias("_n"))
    main = kinds.groupBy(*place).agg(F.sum("_n").alias("_all"), F.max_by("_kind", "_n").alias("_kind"), F.max("_n").alias("_most"))
    shown = (
        (F.col("_distinct") <= 3)
        | (F.col("_rn") == 1)
        | (F.col("_rn") == F.floor(F.col("_distinct") / 2) + 1)
        | (F.col("_rn") == F.col("_distinct"))
    )
    # Three values per position at most.
    examples = ranked.filter(shown).groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("_rn", "value"))).alias("_shown"))
    kind = F.when(F.col("_most") / F.col("_all") >= 0.8, F.col("_kind")).otherwise("mixed")
    return main.join(examples, place).select(*place, kind.alias("kind"), F.transform("_shown", lambda cell: cell["value"]).alias("examples"))


# ---- matching ----------------------------------------------------------------------------------


def pattern_trie(patterns: DataFrame) -> DataFrame:
    """Each beginning of each template (site, pos, pattern) once: (site, _depth, _key, _best), one trie per site and template depth.

    ``_key`` is the path from the root; ``_best`` is set where a template ends: literal segments, minus its place, the template.
    """
    named = patterns.withColumn("_names", path_segments(F.col("pattern"))).groupBy("site", "_names").agg(
        F.min("pos").alias("_pos"), F.min_by("pattern", "pos").alias("pattern")
    )
    literal = F.size(F.filter("_names", lambda name: name != "*"))
    depth = F.size("_names")
    steps = named.select(
        "site",
        "_names",
        depth.alias("_depth"),
        F.struct(literal.alias("score"), (-F.col("_pos")).alias("place"), "pattern").alias("_whole"),
        F.explode_outer(F.sequence(F.least(F.lit(1), depth), depth)).alias("_step"),
    )
    key = F.array_join(F.slice("_names", F.lit(1), F.col("_step")), "/")
    return steps.groupBy("site", "_depth", key.alias("_key")).agg(F.max(F.when(F.col("_step") == F.col("_depth"), F.col("_whole"))).alias("_best"))


def match_pattern(urls: DataFrame, patterns: DataFrame, levels: int | None = None) -> DataFrame:
    """Most specific template for (site, seq, url) among (site, pos, pattern); NULL when none matches.

    All URLs walk down the trie of their site's templates together, one depth a step: each looks up the child with its own next segment and
    the one with ``*``, by equality. Only beginnings that match go on, so the rows follow what matches, not the number of templates or of
    their wildcard layouts. Of the templates reached, the one with most literal segments wins, then the first.

    ``levels`` is the depth of the deepest template; deeper ones are left out. Without it the templates are written once to see how deep
    they are; with it nothing runs before an action.
    """
    depth = F.size(path_segments(F.col("pattern")))
    if levels is None:
        patterns = cut_lineage(patterns.select("site", "pos", "pattern"))
        levels = patterns.agg(F.coalesce(F.max(depth), F.lit(0))).first()[0]
    else:
        patterns = patterns.filter(depth <= levels)
    located = F.when(F.col("url").startswith("/"), F.regexp_extract("url", "^[^?#]*", 0)).otherwise(url_path(F.col("url")))
    trie = pattern_trie(patterns)
    parted = urls.select("site", "seq", path_segments(located).alias("_parts")).withColumn("_depth", F.size("_parts"))
    live = parted.filter(F.col("_depth") <= levels).withColumn("_key", F.lit("")).withColumn("_best", F.lit(None).cast(trie.schema["_best"].dataType))
    children = trie.withColumnRenamed("_best", "_end").withColumn("_met", F.lit(True))
    for level in range(1, max(levels, 1) + 1):
        below = lambda token: token if level == 1 else F.concat(F.col("_key"), F.lit("/"), token)  # noqa: B023, E731
        keys = F.when(F.col("_depth") >= level, F.array_distinct(F.array(below(F.get("_parts", F.lit(level - 1))), below(F.lit("*")))))
        if level == 1:
            keys = keys.otherwise(F.array(F.lit("")))
        tried = live.select("site", "seq", "_parts", "_depth", "_best", F.explode_outer(keys).alias("_key"))
        # Rows without a key arrived at an earlier depth.
        met = attach(tried, children, ["site", "_depth", "_key"], ["seq"]).filter("_met OR _key IS NULL")
        live = met.select("site", "seq", "_parts", "_depth", "_key", F.coalesce("_end", "_best").alias("_best"))
    best = live.groupBy("site", "seq").agg(F.max("_best").getField("pattern").alias("pattern"))
    return urls.join(best, ["site", "seq"], "left")


# ---- samples and titles ------------------------------------------------------------------------


def spread_sample(df: DataFrame, by: list[str], seq: str, k: int | None, width: int | None = None) -> DataFrame:
    """Up to k rows per group, spread evenly from the first to the last. None keeps every row."""
    if k is None:
        return df
    if k <= 0:
        return df.limit(0)
    extra = {"width": width} if width else {}
    ranked = rank_in_group(df, by, seq, "_rn", "_size", **extra)
    place, size = F.col("_rn") - 1, F.col("_size")
    if k == 1:
        chosen = place == 0
    else:
        spots = [F.floor(F.lit(i) * (size - 1) / F.lit(k - 1) + F.lit(0.5)) for i in range(k)]
        chosen = (size <= k) | reduce(lambda found, spot: found | (place == spot), spots, F.lit(False))
    return ranked.filter(chosen).drop("_rn", "_size")


def title_template(titles: DataFrame, k: int) -> DataFrame:
    """Shared words of the titles per template, from an even sample of (site, pattern, seq, title).

    At most k titles per group meet; the first one's words are folded with those of the others in order. NULL if fewer than two have words.
    """
    sample = spread_sample(titles.select("site", "pattern", "seq", "title"), ["site", "pattern"], "seq", k)
    return template_of_sample(sample)


def template_of_sample(sample: DataFrame) -> DataFrame:
    """``title_template`` of rows that are the sample already."""
    listed = sample.groupBy("site", "pattern").agg(F.array_sort(F.collect_list(F.struct("seq", "title"))).alias("_sample"))
    words = F.filter(F.transform("_sample", lambda row: word_list(row["title"])), lambda row: F.size(row) > 0)
    folded = listed.withColumn("_words", words).withColumn(
        "_shared", F.aggregate(F.slice("_words", F.lit(2), F.size("_words")), F.get("_words", F.lit(0)), shared_sequence)
    )
    template = F.when(F.size("_words") >= 2, sequence_template(F.col("_words"), F.col("_shared")))
    return folded.select("site", "pattern", template.alias("template"))
