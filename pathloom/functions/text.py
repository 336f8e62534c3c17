"""Column functions for text: browser-style white space, HTML entities, percent escapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space in the sense of ECMAScript, as a character-class body: the five control
# characters, all Unicode separators and the byte order mark.
SPACE = r"\t-\r\p{Z}\x{FEFF}"
S = f"[{SPACE}]"

# Not followed by an ASCII word character (Java's \b is Unicode-aware on older JDKs).
NO_WORD = "(?![0-9A-Za-z_])"

WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"

# The named entities that are decoded, matched without regard to case.
NAMED_ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "ndash": "–",
    "mdash": "—",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
    "hellip": "…",
    "middot": "·",
    "bull": "•",
    "copy": "©",
    "reg": "®",
    "trade": "™",
    "euro": "€",
    "pound": "£",
    "times": "×",
    "laquo": "«",
    "raquo": "»",
}

ENTITY = "(?i)&(?:#x[0-9a-f]+|#[0-9]+|[a-z][a-z0-9]*);"

# SQL lambdas: the text of a character number, of an entity, and of a whole text with its entities.
_CHARACTER = """n -> CASE WHEN n BETWEEN 1 AND 1114111 AND n NOT BETWEEN 55296 AND 57343
                          THEN decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END"""
_NUMBER = """CASE WHEN e RLIKE '^&#[xX]' THEN transform(array(ltrim('0', substring(e, 4, length(e) - 4))), h -> CASE WHEN length(h) <= 8 THEN CAST(conv(h, 16, 10) AS BIGINT) END)[0]
                  WHEN e LIKE '&#%' THEN try_cast(substring(e, 3, length(e) - 3) AS BIGINT) END"""
_ENTITY_NAMES = "map({})".format(
    ", ".join("'{}', '{}'".format(name, char.replace("'", "\\'")) for name, char in NAMED_ENTITIES.items())
)
_ENTITY_TEXT = f"""e -> coalesce(try_element_at({_ENTITY_NAMES}, lower(substring(e, 2, length(e) - 2))),
                                 transform(array({_NUMBER}), {_CHARACTER})[0], e)"""
_DECODED = f"""t -> CASE WHEN contains(t, '&')
    THEN array_join(zip_with(split(t, '{ENTITY}', -1), array_append(transform(regexp_extract_all(t, '{ENTITY}', 0), {_ENTITY_TEXT}), ''),
                             (before, entity) -> concat(before, entity)), '')
    ELSE t END"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """Strip every kind of white space, not only U+0020."""
    return F.regexp_replace(text, rf"^{S}+|(?<!{S}){S}+\z", "")


def collapsed(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{S}+", " "))


def decoded_text(text: Column) -> Column:
    """HTML entities decoded in a single pass; unknown ones stay as they are."""
    return F.get(F.call_function("transform", F.array(text), F.expr(_DECODED)), F.lit(0))


def before_last(text: Column, mark: str, change: Callable[[Column], Column]) -> Column:
    """``text`` with ``change`` applied up to its last ``mark``. Behind that no search for the mark could end."""

    def parted(whole: Column) -> Column:
        behind = F.when(whole.contains(mark), F.substring_index(whole, mark, -1)).otherwise(whole)
        return let(behind, lambda rest: F.concat(change(F.left(whole, F.length(whole) - F.length(rest))), rest))

    return let(text, parted)


def without_tags(fragment: Column) -> Column:
    """A blank for each tag."""
    return before_last(fragment, ">", lambda front: F.regexp_replace(front, "<[^>]+>", " "))


def inline_text(fragment: Column) -> Column:
    """Visible text of an HTML fragment on one line."""
    return collapsed(decoded_text(without_tags(fragment)))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def percent_encoded(text: Column, unsafe: str) -> Column:
    """UTF-8 percent escapes for each character of the class ``unsafe``."""

    def escape(char: Column) -> Column:
        octets = F.regexp_replace(F.hex(F.encode(char, "UTF-8")), "(..)", "%$1")
        return F.when(char.rlike(unsafe), octets).otherwise(char)

    return F.when(text.rlike(unsafe), F.array_join(F.transform(F.split(text, ""), escape), "")).otherwise(text)


def percent_decoded(text: Column) -> Column:
    """Escapes decoded as UTF-8; stray percent signs and plus signs stay; bad UTF-8 leaves the value as it is."""
    guarded = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(guarded), text)).otherwise(text)


def js_number(text: Column) -> Column:
    """A finite decimal number, empty text as 0, anything else NULL."""
    plain = trimmed(text)
    return F.when(plain == "", F.lit(0.0)).when(
        plain.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), plain.try_cast("double")
    )


def parsed_date(text: Column) -> Column:
    """ISO 8601, RFC 2822 or one of the common written dates as a UTC timestamp with milliseconds; anything else NULL."""
    iso = r"^[0-9]{4}(?:-[0-9]{2}(?:-[0-9]{2}(?:[T ][0-9:.]+(?:Z|[+-][0-9:]+)?)?)?)?\z"
    minutes = r"^([0-9-]{10}[T ][0-9]{2}:[0-9]{2})(Z|[+-][0-9:]+)?\z"
    weekday = f"^[A-Za-z]{{3}},{S}*"

    def read(plain: Column) -> Column:
        mail = F.regexp_replace(plain, weekday, "")
        known = lambda *shapes: F.coalesce(*[F.try_to_timestamp(mail, F.lit(shape)) for shape in shapes])
        full = F.regexp_replace(F.regexp_replace(plain, minutes, "$1:00$2"), r"([+-][0-9]{2})([0-9]{2})\z", "$1:$2")
        return (
            F.when(plain.rlike(iso), F.when(plain.rlike(r"[T ]"), full).otherwise(plain).try_cast("timestamp"))
            .when(plain.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\\z"), known("yyyy-M-d"))
            .when(plain.rlike("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}\\z"), known("yyyy/M/d"))
            .when(plain.rlike("^[A-Za-z]{3,9} [0-9]{1,2}, [0-9]{4}\\z"), known("MMMM d, yyyy", "MMM d, yyyy"))
            .when(
                plain.rlike("^[A-Za-z]{3},|^[0-9]{1,2} [A-Za-z]{3,9} "),
                known("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm z", "d MMM yyyy HH:mm Z", "d MMM yyyy", "d MMMM yyyy"),
            )
        )

    return F.date_trunc("millisecond", let(trimmed(text), read))


def iso_text(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# ---- arrays as rows ----------------------------------------------------------------------------


def each(df: DataFrame, items: Column | str, pos: str, value: str, *keep: Column | str) -> DataFrame:
    """One row per item of an array, with its place. As ``posexplode``, but Spark infers no filter from it, which would be moved below the
    steps that make the array and so work it out several times."""
    return df.select(*keep, F.posexplode_outer(items).alias(pos, value)).filter(F.col(pos).isNotNull())


# ---- word sequences ----------------------------------------------------------------------------

GAP = "{…}"


def word_list(text: Column) -> Column:
    """The words between white space; none for a NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{S}+"), lambda word: word != "")


def shared_sequence(words: Column, others: Column) -> Column:
    """The longest sequence of words that both arrays have in this order, without regard to case, as ``words`` spells it.

    ``ends[j]`` is the sequence shared by what is left of ``words`` and by ``others`` from place j on. Folding ``words`` from its last word
    on gives each word a new ``ends``, built from its last place on. Of equally long ones the one that does without the word stays.
    """
    none = F.array().cast("array<string>")
    places = F.reverse(F.transform(others, lambda word, j: F.struct(F.lower(word).alias("word"), j.alias("j"))))

    def with_word(ends: Column, word: Column) -> Column:
        def with_place(done: Column, place: Column) -> Column:
            without, later = F.get(ends, place["j"]), F.get(done, F.lit(0))
            matched = F.concat(F.array(word), F.get(ends, place["j"] + 1))
            longer = F.when(F.size(without) >= F.size(later), without).otherwise(later)
            return F.concat(F.array(F.when(F.lower(word) == place["word"], matched).otherwise(longer)), done)

        return F.aggregate(places, F.array(none), with_place)

    return F.get(F.aggregate(F.reverse(words), F.array_repeat(none, F.size(others) + 1), with_word), F.lit(0))


def filled_places(words: Column, shared: Column) -> Column:
    """Between which of the shared words (0: before the first one) an array has words of its own."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("filled"))

    def step(state: Column, word: Column) -> Column:
        met = F.lower(word) == F.lower(F.get(shared, state["at"]))
        return F.when(met, F.struct((state["at"] + 1).alias("at"), state["filled"].alias("filled"))).otherwise(
            F.struct(state["at"].alias("at"), F.array_append(state["filled"], state["at"]).alias("filled"))
        )

    return F.aggregate(words, start, step, lambda state: state["filled"])


def sequence_template(rows: Column, shared: Column) -> Column:
    """The shared words of several word arrays, with a mark where one of them has other words; NULL without shared ones."""
    filled = F.flatten(F.transform(rows, lambda words: filled_places(words, shared)))
    places = F.sequence(F.lit(0), F.size(shared))
    parts = F.transform(places, lambda at: F.array(F.when(F.array_contains(filled, at), F.lit(GAP)), F.get(shared, at)))
    return F.when(F.size(shared) > 0, F.array_join(F.flatten(parts), " "))
