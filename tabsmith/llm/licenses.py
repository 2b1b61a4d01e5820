"""Licence scan by canonical digest lookup, in DataFrame functions only.

A text is put into canonical form: ASCII lower case, copyright lines dropped, equivalent spellings made
one, everything but letters and digits turned into single blanks.  The SHA-256 of the canonical form is
looked up in the digests of known licence texts and notices by a hash join.  The units looked up
are the whole text of a document and each of its lines, so a file that is a licence and a notice line in
other text are both found.

The digests are computed from the catalogue below and read from ``license_digests`` (full texts with and
without titles and appendices), both of fixed size: whole texts meet them in a broadcast hash join, lines in
a constant set and map, so no text is shuffled.

Defined results: a null or empty text, and one that is empty in canonical form, matches nothing;
what is found depends on the text alone, so repeated rows and null ids get their text's result; other
columns are left alone.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_digests import FULL_TEXTS

_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
    "so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
    'substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.\n\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You '
    "may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in "
    'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
    "either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies.\n\n" + _DISCLAIMER
)
_0BSD = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _DISCLAIMER
)
_BSD_2, _BSD_3 = _BSD_HEAD + _BSD_TAIL, _BSD_HEAD + _BSD_NAME + _BSD_TAIL


def _titled(name: str, text: str, titles: list[str]) -> list[tuple[str, str]]:
    """A text without a title and under each of its usual ones, with "The" before them or not."""
    return [(name, text), *((name, f"{the}{t}\n\n{text}") for t in titles for the in ("", "The "))]


def _unnumbered(text: str) -> str:
    return re.sub(r"^[0-9]\. ", "* ", text, flags=re.M)


_BSD_2_TITLES = ["BSD 2-Clause License", "2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"]
_BSD_3_TITLES = ["BSD 3-Clause License", "3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License",
                 "Modified BSD License", "BSD License"]

# Texts and notices of public licences, by SPDX name.
KNOWN: list[tuple[str, str]] = [
    *_titled("MIT", _MIT, ["MIT License (MIT)", "MIT License"]),
    *_titled("ISC", _ISC, ["ISC License", "ISC License (ISC)"]),
    *_titled("ISC", _ISC.replace("and/or", "and"), ["ISC License", "ISC License (ISC)"]),
    *_titled("0BSD", _0BSD, ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)"]),
    *_titled("BSD-2-Clause", _BSD_2, _BSD_2_TITLES),
    *_titled("BSD-2-Clause", _unnumbered(_BSD_2), _BSD_2_TITLES),
    *_titled("BSD-3-Clause", _BSD_3, _BSD_3_TITLES),
    *_titled("BSD-3-Clause", _unnumbered(_BSD_3), _BSD_3_TITLES),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
]

# What after "copyright", and after "(c)" as the mark of a list item, makes a line a part of a licence's text and not a copyright line.
WORDING = [
    "act", "also", "and", "are", "claims", "disclaimer", "disclaimers", "doctrines", "for", "if", "in", "infringement", "interest", "interests",
    "is", "law", "laws", "license", "licenses", "licence", "licences", "like", "line", "notice", "notices", "holder", "holders", "of this", "on",
    "or", "owner", "owners", "ownership", "patent", "permission", "permissions", "protection", "resulting", "rights", "statement", "statements",
    "that", "the library", "the program", "the software", "those", "to", "treaty",
]
ITEMS = ["copyright", "representations", "the license", "the licenses", "the licence", "the licences", "under", "you must"]
_GAPS = r"\x00-/:-`{-\x7f"  # what separates words of lower-cased text; letters beyond ASCII belong to words


def _other_words(phrases: list[str], within: bool = False) -> str:
    """A pattern for words that do not begin with one of the phrases, without look-ahead, which the SQL has not."""
    heads = sorted({p[0] for p in phrases if p})
    ways = [f"[^{_GAPS}{''.join(h for h in heads if h != ' ')}]"]
    for h in heads:
        rest = [p[1:] for p in phrases if p[:1] == h]
        if h != " ":
            ways.append(h + _other_words(rest, True))
        elif "" not in phrases:
            ways.append(f"[{_GAPS}]+{_other_words(rest)}")
    if within and "" not in phrases and " " not in heads:
        ways.append(f"[{_GAPS}]|$")
    return f"(?:{'|'.join(ways)})"


# A copyright line of lower-cased text: the word or sign first (after comment marks) and no licence wording after it, or the reservation of rights.
COPYRIGHT_LINE = (
    rf"^[^a-z0-9]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9])|©[{_GAPS}]*[^{_GAPS}]|(?:\(c\)[{_GAPS}]*)?copyright[{_GAPS}]+{_other_words(WORDING)}"
    rf"|\(c\)[{_GAPS}]*{_other_words(ITEMS)})|^[^a-z0-9]*all rights reserved[^a-z0-9]*$"
)
OTHER = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
# Equivalent spellings of words in canonical form.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("https", "http"),
    ("v 2 0", "version 2 0"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _line_words(line: str) -> str:
    low = line.translate(str.maketrans(UPPER, LOWER))
    return "" if re.search(COPYRIGHT_LINE, low) else re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", low).strip(" ")


def _one_spelling(words: str) -> str:
    out = " " + words.replace(" ", "  ") + " "  # every word has blanks of its own, so neighbours are both replaced
    for a, b in SPELLINGS:
        out = out.replace(f" {a} ".replace(" ", "  ")[1:-1], f" {b} ".replace(" ", "  ")[1:-1])
    return out.strip(" ").replace("  ", " ")


def canonical(text: str) -> str:
    """The canonical form in Python, for the catalogue; the columns below are the same in Spark."""
    return _one_spelling(" ".join(w for w in map(_line_words, text.split("\n")) if w))


def _line_forms(text: Column) -> Column:
    """The words of every line, "" for copyright lines and lines without words."""
    low = F.split(F.translate(text, UPPER, LOWER), "\n", -1)
    words = lambda x: F.trim(F.regexp_replace(x, OTHER, " "))
    return F.transform(low, lambda x: F.when(x.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(words(x)))


def _spelled(words: Column) -> Column:
    out = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} ".replace(" ", "  ")[1:-1]), F.lit(f" {b} ".replace(" ", "  ")[1:-1]))
    return F.replace(F.trim(out), F.lit("  "), F.lit(" "))


def known_digests() -> list[tuple[str, str]]:
    """(digest, licence) of the catalogue and the full texts, one licence per digest."""
    return sorted((FULL_TEXTS | {hashlib.sha256(canonical(t).encode()).hexdigest(): name for name, t in KNOWN}).items())


def license_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: the licence that its whole text is, the number of its lines that are known notices, their licences."""
    known = known_digests()
    digest = lambda form: F.sha2(form.cast("binary"), 256)
    lines = docs.select("doc_id", _line_forms(F.coalesce("text", F.lit(""))).alias("lines"))
    whole = _spelled(F.array_join(F.filter("lines", lambda x: x != ""), " "))
    table = F.create_map(*(F.lit(x) for pair in known for x in pair))
    found = F.filter(F.transform("lines", lambda x: digest(_spelled(x))), lambda d: d.isin([d for d, _ in known]))  # a hash set
    notices = F.transform(found, lambda d: F.element_at(table, d))
    rows = lines.select("doc_id", digest(whole).alias("digest"), notices.alias("notices"))
    licenses = spark.createDataFrame(known, "digest string, license_id string")
    return rows.join(F.broadcast(licenses), "digest", "left").select(
        "doc_id",
        "license_id",
        F.size("notices").cast("long").alias("n_notice_lines"),
        F.array_join(F.array_sort(F.array_distinct("notices")), ",").alias("notice_ids"),
    )


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_spelled(words: str) -> str:
    out = f"(' ' || replace({words}, ' ', '  ') || ' ')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {_sql(f' {a} '.replace(' ', '  ')[1:-1])}, {_sql(f' {b} '.replace(' ', '  ')[1:-1])})"
    return f"replace(trim({out}, ' '), '  ', ' ')"


REPORT_SQL = f"""
with known(digest, license) as (values {', '.join(f"('{d}', '{n}')" for d, n in known_digests())}),
d as (select row_number() over () as r, doc_id, string_split(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), chr(10)) as raw from documents),
e as (select r, i, case when regexp_matches(line, {_sql(COPYRIGHT_LINE)}) then ''
                        else trim(regexp_replace(line, {_sql(OTHER)}, ' ', 'g'), ' ') end as words
      from (select r, unnest(raw) as line, unnest(range(len(raw))) as i from d)),
w as (select r, string_agg(words, ' ' order by i) filter (words <> '') as words from e group by r),
n as (select r, count(*) as n, string_agg(distinct license, ',' order by license) as ids
      from e join known on sha256({_sql_spelled('words')}) = digest group by r)
select doc_id, k.license as license_id, cast(coalesce(n.n, 0) as bigint) as n_notice_lines, coalesce(n.ids, '') as notice_ids
from d join w using (r) left join known k on sha256({_sql_spelled("coalesce(w.words, '')")}) = k.digest left join n using (r)
"""
