"""The same results as ``queries.py`` in SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from .licenses import COPYRIGHT_LINE, EQUIVALENT, EQUIVALENT_PHRASES, HOLDER_LINE, KNOWN
from .url_filter import DAMPING_PERCENT, LINK, STEPS, UNIT

ORACLES: dict[str, str] = {}



def _canonical(text: str) -> str:
    """The canonical form of a licence text, as in ``licenses.canonical``."""
    out = f"regexp_replace({text}, '(?m){HOLDER_LINE}', '', 'g')"
    out = f"translate({out}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace({out}, '(?m){COPYRIGHT_LINE}', '', 'g')"
    out = f"trim(regexp_replace({out}, '[\\x00-\\x2A\\x2C-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ')"
    for spelling, same in (EQUIVALENT | EQUIVALENT_PHRASES).items():
        out = f"replace({out}, '{spelling}', '{same}')"
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLES["op1_license_scan"] = f"""
WITH known AS (
  SELECT DISTINCT license, sha256({_canonical("text")}) AS digest
  FROM (VALUES {", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in KNOWN)}) AS k(license, text)
), texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text FROM documents
), lines AS (
  SELECT doc_id, unnest(split(text, chr(10))) AS line FROM texts
), stated AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS statements
  FROM (SELECT doc_id, sha256({_canonical("line")}) AS digest FROM lines) JOIN known USING (digest) GROUP BY doc_id
), whole AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
  FROM (SELECT doc_id, sha256({_canonical("text")}) AS digest FROM texts) JOIN known USING (digest) GROUP BY doc_id
)
SELECT t.doc_id, sha256({_canonical("t.text")}) AS digest, coalesce(licenses, '') AS licenses, coalesce(statements, '') AS statements,
       coalesce(n, 0) AS n_statements
FROM texts t LEFT JOIN whole w ON t.doc_id = w.doc_id LEFT JOIN stated s ON t.doc_id = s.doc_id
"""

ORACLES["op4_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

_STEP = f"""
r{{now}} AS MATERIALIZED (
  SELECT host, CAST(sum(trust) AS BIGINT) AS trust, CAST(sum(distrust) AS BIGINT) AS distrust FROM (
    SELECT dst AS host, trust * {DAMPING_PERCENT} // (100 * n) AS trust, 0 AS distrust FROM ahead JOIN r{{before}} ON src = host
    UNION ALL SELECT src, 0, distrust * {DAMPING_PERCENT} // (100 * n) FROM back JOIN r{{before}} ON dst = host
    UNION ALL SELECT host, trust * {100 - DAMPING_PERCENT} // 100, distrust * {100 - DAMPING_PERCENT} // 100 FROM r0
  ) GROUP BY host
)"""

ORACLES["op6_url_filter"] = f"""
WITH RECURSIVE urls AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM urls
), judged AS (
  SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM ruled
), links AS (
  SELECT DISTINCT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{LINK.replace("'", "''")}', 1)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM urls
), up AS (
  SELECT host FROM urls UNION SELECT dst FROM links
  UNION SELECT regexp_replace(host, '^[^.]*[.]', '') FROM up WHERE len(string_split(host, '.')) > 2
), family AS (
  SELECT host AS src, regexp_replace(host, '^[^.]*[.]', '') AS dst FROM up WHERE len(string_split(host, '.')) > 2
), edges AS (
  SELECT src, dst FROM links WHERE src <> '' AND src <> dst UNION SELECT src, dst FROM family UNION SELECT dst, src FROM family
), ahead AS (
  SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM edges
), back AS (
  SELECT src, dst, count(*) OVER (PARTITION BY dst) AS n FROM edges
), r0 AS MATERIALIZED (
  SELECT host, CAST(floor(allowed / greatest(sum(allowed) OVER (), 1)::DOUBLE * {UNIT}::DOUBLE) AS BIGINT) AS trust,
         CAST(floor(blocked / greatest(sum(blocked) OVER (), 1)::DOUBLE * {UNIT}::DOUBLE) AS BIGINT) AS distrust
  FROM (SELECT host, count(*) FILTER (said = 'allow') AS allowed, count(*) FILTER (said = 'block') AS blocked FROM judged GROUP BY host)
  WHERE allowed > 0 OR blocked > 0
), {",".join(_STEP.format(now=i, before=i - 1) for i in range(1, STEPS + 1))}
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM judged j LEFT JOIN r{STEPS} r ON j.host = r.host
"""

ORACLES["op9_mixing"] = """
WITH sized AS (
  SELECT doc_id, source, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS weight
  FROM sized GROUP BY source
), caps AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size::DOUBLE) OVER () AS total, sum(weight::DOUBLE) OVER () AS weights,
         coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0.0) AS cap_before, coalesce(sum(weight::DOUBLE) OVER before, 0.0) AS weight_before
  FROM named
  WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, (total - cap_before) / (weights - weight_before) * weight > cap AS capped FROM caps
), targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap ELSE least(cap, weight *
           ((total - sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER ()) / sum(CASE WHEN NOT capped THEN weight::DOUBLE END) OVER ())) END AS target
  FROM marked
), passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM targets
), hashes AS (
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM sized GROUP BY source, h
), taken AS (
  SELECT x.source, h, (upto <= budget OR (upto - words <= budget AND upto - budget <= budget - (upto - words))) AS more
  FROM hashes x JOIN (SELECT *, target - passes * source_size AS budget FROM passes) p ON x.source IS NOT DISTINCT FROM p.source
)
SELECT s.doc_id, s.size, p.source_size, p.target, CAST(s.size * (p.passes + CASE WHEN t.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s
JOIN passes p ON s.source IS NOT DISTINCT FROM p.source
JOIN taken t ON s.source IS NOT DISTINCT FROM t.source AND s.h = t.h
"""


def _coded(name: str) -> str:
    value = f"CAST({name} AS VARCHAR)"
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE CAST(octet_length(encode({value})) AS VARCHAR) || ':' || {value} END"


def _merkle(part_levels: int = 9, top_levels: int = 4) -> str:
    """Levels are written out; ``part_levels`` of them reach 8**9 documents a part, ``top_levels`` 8**4 parts."""
    fields = ["doc_id", "source", "lang", "n_chars"]
    leaf = lambda text: "sha256(" + " || ".join([*map(_coded, fields), _coded(text)]) + ")"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        # CRC-32 with the reflected polynomial, by table, over the id's decimal digits.
        "WITH crc_table AS (SELECT list(list_reduce([CAST(i AS BIGINT)] || [CAST(0 AS BIGINT) FOR j IN range(8)], "
        "lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))",
        f"""leaves AS (SELECT doc_id, lang, {leaf("text")} AS leaf,
  CASE WHEN xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
    lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), CAST(4294967295 AS BIGINT)) % 3 = 0 THEN {leaf(small)} ELSE {leaf("text")} END AS seen
  FROM documents, crc_table)""",
        """b0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, '' AS siblings, seen AS folded, leaf AS node FROM leaves)""",
    ]
    previous = "b0"
    for level in range(part_levels):
        name = f"b{level + 1}"
        steps.append(_level(name, previous, "lang"))
        previous = name
    steps.append(
        f"""s0 AS (SELECT d.doc_id, d.leaf, d.node AS subroot, d.siblings, d.folded, d.node, CAST(p.pos AS BIGINT) AS pos FROM {previous} d
  JOIN (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM (SELECT DISTINCT lang FROM leaves)) p ON d.lang IS NOT DISTINCT FROM p.lang)"""
    )
    previous = "s0"
    for level in range(top_levels):
        name = f"s{level + 1}"
        steps.append(_level(name, previous, None))
        previous = name
    return (
        ",\n".join(steps)
        + f"\nSELECT doc_id, leaf, subroot, node AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = node AS verified FROM {previous}"
    )


def _level(name: str, previous: str, part: str | None) -> str:
    """One level up for every row: the node of its run, the siblings seen on the way and what the row folds to."""
    same = f"d.{part} IS NOT DISTINCT FROM n.{part} AND " if part else ""
    by, of = (f"{part}, ", f"PARTITION BY {part}") if part else ("", "")
    keep = "d.lang, " if part else "d.subroot, "
    return f"""{name}n AS (SELECT *, count(*) OVER ({of}) AS nodes FROM (SELECT DISTINCT {by}pos, node FROM {previous})),
{name}r AS (SELECT {by}pos // 8 AS run, any_value(nodes) AS nodes, list(node ORDER BY pos) AS members FROM {name}n GROUP BY {by}pos // 8),
{name} AS (SELECT d.doc_id, d.leaf, {keep}
  CASE WHEN n.nodes = 1 THEN d.pos ELSE d.pos // 8 END AS pos,
  CASE WHEN n.nodes = 1 THEN d.node ELSE sha256(array_to_string(n.members, '')) END AS node,
  CASE WHEN n.nodes = 1 THEN d.siblings ELSE d.siblings || array_to_string(n.members[1:d.pos % 8] || n.members[d.pos % 8 + 2:], '') END AS siblings,
  CASE WHEN n.nodes = 1 THEN d.folded
    ELSE sha256(array_to_string(n.members[1:d.pos % 8], '') || d.folded || array_to_string(n.members[d.pos % 8 + 2:], '')) END AS folded
  FROM {previous} d JOIN {name}r n ON {same}d.pos // 8 = n.run)"""


ORACLES["op12_merkle_manifest"] = _merkle()

ORACLES["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words)) AS n FROM split GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM split, range(1, 6) l(m) WHERE len(words) >= m)),
counts AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT *, string_split(phrase, ' ') AS words FROM counts WHERE m >= 2),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.m = k AND l.phrase = array_to_string(c.words[1:k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.m = c.m - k AND r.phrase = array_to_string(c.words[k + 1:], ' ')
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts),
inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM candidates s
  JOIN candidates b ON b.lang = s.lang AND b.m > s.m AND 100 * b.a >= 100 * s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
  FROM best b WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
