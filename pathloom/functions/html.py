"""Column functions that read parts of an HTML text with regular expressions, tolerant of messy markup."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NO_WORD, S, before_last, collapsed, decoded_text, inline_text, let, trimmed, without_tags

# Elements that hold no readable text, in the order they are taken out.
SILENT = ["script", "style", "noscript", "template", "svg", "iframe"]
CHROME = ["header", "nav", "footer", "aside"]
BREAKING = (
    "p|div|section|article|li|ul|ol|tr|table|h[1-6]|blockquote|pre|dd|dt|figure|figcaption"
)
ATTRIBUTE = rf"""([a-zA-Z_:][-a-zA-Z0-9_:.]*){S}*={S}*(?:"([^"]*)"|'([^']*)'|([^{S[1:-1]}"'>]+))"""
MIN_MAIN_TEXT = 200
SHELL_WORDS = 80


def up_to_last(text: Column, closing: str) -> Column:
    """A text up to the last closing mark.

    Nothing behind the last closing mark can be part of an element, and in front of it every search for a
    closing mark ends at one. So pages with many unclosed tags take linear, not quadratic, time.
    """
    return F.regexp_extract(text, rf"(?is)^.*{closing}", 0)


def tag_body(name: str) -> str:
    """The inside of an opening tag, as a pattern: no other tag of that name begins in it. Each search for its end stops
    at the next one, so tags that never end take linear time."""
    return f"(?:(?!<{name}{NO_WORD})[^>])*"


# Opening tags of elements that never end are marked with this character while elements are searched for.
_MARK = "\x01"


def _marked(text: Column, names: Sequence[str]) -> Column:
    """Opening tags behind the last closing tag of their name, where no element can begin, made unrecognisable."""
    for name in names:
        text = let(text, _marker(name))
    return text


def _marker(name: str) -> Callable[[Column], Column]:
    def mark(whole: Column) -> Column:
        behind = lambda front: F.substring(whole, F.length(front) + 1, F.length(whole))
        opening = f"(?i)<(?={name}{NO_WORD})"
        return let(up_to_last(whole, f"</{name}{S}*>"), lambda front: F.concat(front, F.regexp_replace(behind(front), opening, "<" + _MARK)))

    return mark


def _unmarked(text: Column) -> Column:
    return F.replace(text, F.lit("<" + _MARK), F.lit("<"))


def _cut_out(text: Column, pattern: str, closing: str) -> Column:
    def cut(whole: Column) -> Column:
        blank = lambda part: F.regexp_replace(part, pattern, " ")
        return let(
            up_to_last(whole, closing),
            lambda front: F.concat(blank(front), F.substring(whole, F.length(front) + 1, F.length(whole))),
        )

    return let(text, cut)


def without_elements(html: Column, names: Sequence[str]) -> Column:
    for name in names:
        closing = f"</{name}{S}*>"
        html = _cut_out(html, rf"(?is)<{name}{NO_WORD}.*?{closing}", closing)
    return html


def cleaned_html(html: Column) -> Column:
    return without_elements(_cut_out(html, "(?s)<!--.*?-->", "-->"), SILENT)


def inner_texts(html: Column, name: str) -> Column:
    """Inner HTML of all elements of a name."""
    closing = f"</{name}{S}*>"
    return F.regexp_extract_all(
        up_to_last(html, closing), F.lit(rf"(?is)<{name}{NO_WORD}{tag_body(name)}>(.*?){closing}"), F.lit(1)
    )


def opening_tags(html: Column, name: str) -> Column:
    front = let(html, lambda whole: F.when(whole.contains(">"), F.left(whole, F.length(whole) - F.length(F.substring_index(whole, ">", -1)))).otherwise(""))
    return F.regexp_extract_all(front, F.lit(rf"(?i)<{name}{NO_WORD}[^>]*>"), F.lit(0))


def _joined(left: Column, right: Column) -> Column:
    """Texts of two capture groups, of which at most one took part in each match."""
    return F.zip_with(left, right, lambda a, b: F.concat(a, b))


def attribute_pairs(tag: Column) -> Column:
    """Names and values of a tag's attributes, last one first so that a repeated name finds the last."""
    group = lambda index: F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(index))
    joined = _joined(_joined(group(2), group(3)), group(4))
    return F.struct(
        F.reverse(F.transform(group(1), F.lower)).alias("names"), F.reverse(joined).alias("values")
    )


def attribute(pairs: Column, name: str) -> Column:
    """Value of one attribute, entities decoded; NULL when the tag does not have it."""
    return decoded_text(F.get(pairs["values"], F.array_position(pairs["names"], F.lit(name)).cast("int") - 1))


def meta_entries(html: Column) -> Column:
    """(key, content) of every meta tag in order."""

    def entry(tag: Column) -> Column:
        pairs = attribute_pairs(tag)
        key = F.coalesce(attribute(pairs, "name"), attribute(pairs, "property"), F.lit(""))
        return F.struct(F.lower(key).alias("key"), F.coalesce(attribute(pairs, "content"), F.lit("")).alias("content"))

    return F.transform(opening_tags(html, "meta"), entry)


def meta_content(entries: Column, key: str) -> Column:
    first = F.get(F.filter(entries, lambda entry: entry["key"] == key), F.lit(0))
    return F.coalesce(collapsed(first["content"]), F.lit(""))


def canonical_reference(html: Column) -> Column:
    """href of the first link tag whose rel words include canonical; NULL without one."""

    def entry(tag: Column) -> Column:
        pairs = attribute_pairs(tag)
        words = F.split(F.lower(F.coalesce(attribute(pairs, "rel"), F.lit(""))), f"{S}+")
        return F.struct(
            F.array_contains(words, "canonical").alias("chosen"), attribute(pairs, "href").alias("href")
        )

    found = F.filter(F.transform(opening_tags(html, "link"), entry), lambda link: link["chosen"])
    return F.get(found, F.lit(0))["href"]


def title_text(html: Column, entries: Column) -> Column:
    found = F.get(inner_texts(html, "title"), F.lit(0))
    return F.coalesce(inline_text(found), meta_content(entries, "og:title"))


def page_language(html: Column) -> Column:
    tag = F.regexp_extract(html, rf"(?i)<html{NO_WORD}{tag_body('html')}>", 0)
    return F.coalesce(attribute(attribute_pairs(tag), "lang"), F.lit(""))


def heading_list(cleaned: Column) -> Column:
    """All headings with text, in order: array of (level, text)."""
    marked = _marked(up_to_last(cleaned, f"</h[1-6]{S}*>"), [f"h{level}" for level in range(1, 7)])
    pattern = F.lit(rf"(?is)<h([1-6]){NO_WORD}{tag_body('h[1-6]')}>(.*?)</h\1{S}*>")

    def listed(page: Column) -> Column:
        levels = F.regexp_extract_all(page, pattern, F.lit(1))
        texts = F.transform(F.regexp_extract_all(page, pattern, F.lit(2)), lambda text: inline_text(_unmarked(text)))
        return F.zip_with(levels, texts, lambda level, text: F.struct(level.cast("int").alias("level"), text.alias("text")))

    return F.filter(let(marked, listed), lambda heading: heading["text"] != "")


def main_fragment(cleaned: Column) -> Column:
    """Inner HTML of the main element, else of the articles, else of the body without site chrome."""
    main = F.get(inner_texts(cleaned, "main"), F.lit(0))
    articles = inner_texts(cleaned, "article")
    body_pattern = rf"(?is)<body{NO_WORD}{tag_body('body')}>(.*)</body{S}*>"
    body = let(
        up_to_last(cleaned, f"</body{S}*>"),
        lambda front: F.when(front.rlike(body_pattern), F.regexp_extract(front, body_pattern, 1)).otherwise(cleaned),
    )
    long_enough = lambda fragment: F.length(inline_text(fragment)) > MIN_MAIN_TEXT
    from_articles = let(
        articles, lambda found: F.when(long_enough(F.array_join(found, " ")), F.array_join(found, "\n"))
    )
    from_main = let(main, lambda found: F.when(long_enough(found), found))
    return F.coalesce(from_main, from_articles, without_elements(body, CHROME))


def readable_text(fragment: Column) -> Column:
    """Plain text with one line per block and no blank lines."""
    broken = F.regexp_replace(fragment, rf"(?i)<br{S}*/?>", "\n")
    broken = before_last(broken, ">", lambda front: F.regexp_replace(front, rf"(?i)</?(?:{BREAKING}){NO_WORD}[^>]*>", "\n"))
    broken = F.regexp_replace(broken, rf"(?i)</t[dh]{S}*>", "\t")
    broken = without_tags(broken)
    lines = F.transform(
        F.split(decoded_text(broken), "\n", -1),
        lambda line: trimmed(F.regexp_replace(line, r"[ \t\x{00A0}]+", " ")),
    )
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def visible_text(html: Column) -> Column:
    """All text of the raw page but that of scripts, styles and drawings."""
    hidden = ["script", "style", "noscript", "template", "svg"]
    elements = rf"(?is)<({'|'.join(hidden)}){NO_WORD}.*?</\1{S}*>"
    return decoded_text(without_tags(_unmarked(F.regexp_replace(_marked(html, hidden), elements, " "))))


def jsonld_scripts(html: Column) -> Column:
    """Texts of the structured-data scripts; NULL when there are none."""
    kind = rf"""type{S}*={S}*["']?application/ld\+json["']?"""
    bodies = F.regexp_extract_all(
        up_to_last(html, f"</script{S}*>"), F.lit(rf"(?is)<script{NO_WORD}{tag_body('script')}{kind}{tag_body('script')}>(.*?)</script{S}*>"), F.lit(1)
    )
    bare = F.transform(bodies, lambda body: F.regexp_replace(body, rf"^{S}*<!\[CDATA\[|\]\]>{S}*\z", ""))
    return F.when(F.size(bare) > 0, bare)


def anchor_references(cleaned: Column) -> Column:
    """href values of the anchors that lead to pages."""
    hrefs = F.transform(opening_tags(cleaned, "a"), lambda tag: attribute(attribute_pairs(tag), "href"))
    return F.filter(
        hrefs, lambda href: href.isNotNull() & (href != "") & ~href.rlike("(?i)^(?:mailto|tel|javascript|#)")
    )


def crawl_references(html: Column) -> Column:
    """href values a link crawl follows, from the raw page."""
    pattern = F.lit(
        rf"""(?i)<a{S}{tag_body('a')}?href{S}*={S}*(?:"([^"]*)"|'([^']*)'|([^{S[1:-1]}"'>]+))"""
    )
    group = lambda index: F.regexp_extract_all(html, pattern, F.lit(index))
    joined = _joined(_joined(group(1), group(2)), group(3))
    hrefs = F.transform(joined, lambda href: decoded_text(trimmed(href)))
    return F.filter(hrefs, lambda href: (href != "") & ~href.rlike("(?i)^(?:mailto|tel|javascript|data|sms):"))


def base_reference(html: Column) -> Column:
    found = F.regexp_extract(html, rf"""(?i)<base{S}{tag_body('base')}href{S}*={S}*["']([^"']+)["']""", 1)
    return F.when(found != "", decoded_text(found))


def has_script_source(html: Column) -> Column:
    return html.rlike(rf"(?i)<script{NO_WORD}{tag_body('script')}(?<![0-9A-Za-z_])src{S}*=")
