"""Licence scans: canonical digests of whole texts and of single statements, joined with the digests of known ones.

A text is brought to a canonical form before it is hashed: lower case, copyright lines out, spellings that licence
texts use for the same word made equal, and everything but letters, digits and plus signs one blank. Two texts match if
their canonical forms have the same SHA-256 digest; no text is compared in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_digests import KNOWN_DIGESTS

#: Words that licence texts spell in several ways, and the spelling they are brought to.
EQUIVALENT = {
    "acknowledgment": "acknowledgement",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "behaviour": "behavior",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "favour": "favor",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labour": "labor",
    "licence": "license",
    "merchantibility": "merchantability",
    "organisation": "organization",
    "practise": "practice",
    "programme": "program",
    "recognise": "recognize",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "http": "https",
    "httpss": "https",
}
#: The same for phrases. They are brought together after the words, as a line break may part them.
EQUIVALENT_PHRASES = {
    "copyright holder": "copyright owner",
    "non commercial": "noncommercial",
    "per cent": "percent",
    "sub license": "sublicense",
}
#: A line that only names who holds the copyright and when.
COPYRIGHT_LINE = r"^[^A-Za-z0-9\n©]*(?:copyright|\(c\)|©)(?:[^\n]*(?:[0-9]{4}|\(c\)|©|<year>|\[year\])[^\n]*| by [^\n]*)$|^[^A-Za-z0-9\n]*all rights reserved[. ]*$"
#: A line that only names who holds the copyright, without a year: one to twelve words after it, all of which begin with a capital, a letter beyond ASCII or ``<``. Looked
#: for before letters are lower-cased, as sentences on copyright notices or holders go on in small letters or stand in capitals alone.
HOLDER_LINE = r"^[^A-Za-z0-9\n]*[Cc]opyright:?(?: +by)?(?:,? +(?:[A-Z<]|[^\x00-\x7F])[^ \t\n,]*){1,12}[,. ]*$"
#: How often a known digest is repeated, and the document side split, so that a frequent statement spreads over tasks.
SALTS = 16

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD2 = f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

{_BSD_END}"""
_BSD3 = _BSD2.replace(
    _BSD_END,
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
    + _BSD_END,
)
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: Short licence texts, notices and statements in use, with the identifier they stand for. Long texts are in KNOWN_DIGESTS.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD2),
    ("BSD-3-Clause", _BSD3),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD3),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
]


def _spelled(line: Column) -> Column:
    """A line in lower case, without punctuation, its words in one spelling; empty if it is a copyright line. Letters beyond
    ASCII are kept as they are, so that no two of them are made equal."""
    out = F.regexp_replace(line, "(?md)" + HOLDER_LINE, "")
    out = F.translate(out, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.regexp_replace(out, "(?md)" + COPYRIGHT_LINE, "")
    out = F.trim(F.regexp_replace(out, r"[\x00-\x2A\x2C-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    for spelling, same in EQUIVALENT.items():
        out = F.replace(out, F.lit(spelling), F.lit(same))
    return out


def _phrased(text: Column) -> Column:
    for phrase, same in EQUIVALENT_PHRASES.items():
        text = F.replace(text, F.lit(phrase), F.lit(same))
    return text


def spelled_lines(text: Column) -> Column:
    """The lines of a text, each worked on once; a null is an empty text."""
    return F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"), _spelled)


def _joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda line: line != ""), " ")


def canonical(text: Column) -> Column:
    """The form of a whole text that is hashed."""
    return _phrased(_joined(spelled_lines(text)))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(license, digest), one row per licence and canonical form; empty forms are left out. Without ``known``: KNOWN and KNOWN_DIGESTS."""
    given = known if isinstance(known, DataFrame) else spark.createDataFrame(KNOWN if known is None else known, "license string, text string")
    form = canonical(F.col("text"))
    digests = given.filter(form != "").select("license", F.sha2(form, 256).alias("digest"))
    if known is None:
        digests = digests.union(spark.createDataFrame(KNOWN_DIGESTS, "license string, digest string"))
    return digests.distinct()


def scan_licenses(docs: DataFrame, known: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``digest`` (of the canonical whole text), ``licenses``, ``statements``, ``n_statements``.

    ``licenses`` are the licences whose text the whole document is, ``statements`` those that a whole line of it states,
    both sorted and without repeats; ``n_statements`` counts such lines. ``known`` comes from ``known_digests``. Null and
    empty texts match nothing, and their digest is that of the empty form; rows that repeat are judged each. Texts are
    not shuffled, only digests are joined: by broadcast if Spark finds the known ones small, else by a salted key.
    """
    rows = docs.select(F.col(id).alias("id"), F.monotonically_increasing_id().alias("row"), spelled_lines(F.col(text)).alias("lines"))
    parts = F.posexplode(F.concat(F.array(_joined(F.col("lines"))), F.col("lines"))).alias("at", "part")
    units = rows.select("id", "row", parts).select("id", "row", "at", _phrased(F.col("part")).alias("form"))
    units = units.filter((F.col("form") != "") | (F.col("at") == 0)).select("id", "row", "at", F.sha2("form", 256).alias("digest"))
    units = units.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = units.join(salted, ["digest", "salt"], "left")
    is_whole, found = F.col("at") == 0, F.col("license").isNotNull()
    return (
        met.groupBy("row")
        .agg(
            F.first("id").alias("id"),
            F.max(F.when(is_whole, F.col("digest"))).alias("digest"),
            F.array_sort(F.collect_set(F.when(is_whole, F.col("license")))).alias("licenses"),
            F.array_sort(F.collect_set(F.when(~is_whole, F.col("license")))).alias("statements"),
            F.size(F.collect_set(F.when(~is_whole & found, F.col("at")))).cast("long").alias("n_statements"),
        )
        .select(F.col("id").alias(id), "digest", "licenses", "statements", "n_statements")
    )
