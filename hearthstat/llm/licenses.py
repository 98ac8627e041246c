"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: A-Z lower-cased, copyright lines dropped, runs of
punctuation and white space made one space, equivalent spellings made one.  Its SHA-256 is
looked up, by a hash join, among the digests of known licence texts in the same form.  The
whole text of a document is a unit, and so is each of its lines, since notices stand on
lines of their own.  Known texts are a table (license, text); the one that comes with the
package is small, so it is broadcast: ``KNOWN``, the whole texts in ``license_texts``, and a
line with each of the ``SPDX`` ids.

Every text of the package's table holds one of ``MARKS``; a unit without any cannot equal one,
so only units with a mark are brought to canonical form.  This loses nothing (a test holds the
table to it).  With a table of the caller's own, all units are brought to it.

Defined results: NULL and empty texts have no match; repeated rows match each for itself; a
document that consists of one line and matches is reported as text and as line; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Short licences, customary notices and their identifiers.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
KNOWN = (
    ("MIT", f"MIT License\n\n{_MIT_GRANT}\n\n{_AS_IS}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT_GRANT}\n\n{_AS_IS}"),
    ("MIT", f"{_MIT_GRANT}\n\n{_AS_IS}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_TERMS}\n\n{_BSD_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_TERMS}\n\n{_BSD_AS_IS}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_TERMS}\n\n{_BSD_NAMES}\n\n{_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD_TERMS}\n\n{_BSD_NAMES}\n\n{_BSD_AS_IS}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_AS_IS}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_AS_IS}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_AS_IS}"),
    ("Apache-2.0", _APACHE_HEADER),
    ("MPL-2.0", _MPL_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
)
# Identifiers that stand in a line of their own.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "EUPL-1.2", "GPL-1.0-only",
    "GPL-1.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only", "LGPL-2.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib",
)
# Spellings that count as the same, after punctuation has gone.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("sublicence", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("centre", "center"), ("favour", "favor"), ("fulfil", "fulfill"), ("modelled", "modeled"), ("organisation", "organization"),
    ("organise", "organize"), ("per cent", "percent"), ("recognise", "recognize"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("ver", "version"),
)
MARKS = ("licen", "permission", "redistribution")
COPYRIGHT_LINE = "(^|\n)[ \t]*(?:copyright[^\n]*(?:\\(c\\)|©|[0-9]{4})|\\(c\\)|©|all rights reserved)[^\n]*"
# ASCII punctuation and white space, typographic quotes, dashes and spaces.
PUNCTUATION = "[\\x00-\\x20!-/:-@\\x5B-\\x60{-\\x7F\u00a0\u00ab\u00bb\u2010-\u2015\u2018-\u201f\u2026]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The form in which equal licence texts are equal strings."""
    text = F.translate(text, UPPER, LOWER)
    text = F.regexp_replace(text, COPYRIGHT_LINE, "$1")
    text = F.concat(F.lit(" "), F.regexp_replace(text, PUNCTUATION, "  "), F.lit(" "))
    for other, one in SPELLINGS:  # words stand between two spaces, so neighbours don't share one
        text = F.replace(text, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {one.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(text, " +", " "))


def marked(text: Column) -> Column:
    """Whether a text holds a word without which it equals no known text."""
    low = F.translate(text, UPPER, LOWER)
    held = F.lit(False)
    for mark in MARKS:
        held = held | F.contains(low, F.lit(mark))
    return held


@functools.cache
def package_texts() -> tuple[tuple[str, str], ...]:
    """License and text of all that the package knows."""
    whole = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    texts = (*KNOWN, *((path.stem, path.read_text("utf-8")) for path in whole))
    return (*texts, *((name, f"SPDX-License-Identifier: {name}") for name in SPDX))


def known_texts(spark: SparkSession) -> DataFrame:
    """The package's table: ``license`` and ``text``."""
    pairs = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in package_texts()))
    return spark.range(1).select(F.inline(pairs))


def known_digests(known: DataFrame) -> DataFrame:
    """``license`` and ``digest`` of known texts, one row for each digest."""
    digest = F.sha2(canonical(F.col("text")), 256).alias("digest")
    return known.filter(canonical(F.col("text")) != "").select("license", digest).groupBy("digest").agg(F.min("license").alias("license"))


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """The id, ``unit`` ('text' or 'line'), ``line`` (from 0, NULL for text), ``license`` and ``digest`` of each match.

    ``known`` has ``license`` and ``text``; without it the package's table is taken.
    """
    text = F.col("_text")
    looked_up = marked if known is None else Column.isNotNull
    digests = F.broadcast(known_digests(known_texts(docs.sparkSession))) if known is None else known_digests(known)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text")).filter(looked_up(text))
    lines = F.transform(F.split("_text", "\n"), lambda line, i: F.struct(F.lit("line").alias("unit"), i.alias("line"), line.alias("body")))
    lines = F.filter(lines, lambda u: looked_up(u["body"]))
    whole = F.array(F.struct(F.lit("text").alias("unit"), F.lit(None).cast("int").alias("line"), text.alias("body")))
    units = rows.select(id_col, F.explode(F.concat(whole, lines)).alias("_u"))
    units = units.select(id_col, "_u.unit", "_u.line", F.sha2(canonical(F.col("_u.body")), 256).alias("digest"))
    return units.join(digests, "digest").select(id_col, "unit", "line", "license", "digest")


def license_sql() -> str:
    """The same in DuckDB SQL, with ``KNOWN`` only."""

    def form(text: str) -> str:
        out = f"translate({text}, '{UPPER}', '{LOWER}')"
        pattern = COPYRIGHT_LINE.replace("\n", "\\n").replace("\t", "\\t")
        out = f"regexp_replace({out}, '{pattern}', '\\1', 'g')"
        out = f"' ' || regexp_replace({out}, '{PUNCTUATION}', '  ', 'g') || ' '"
        for other, one in SPELLINGS:
            out = f"replace({out}, ' {other.replace(' ', '  ')} ', ' {one.replace(' ', '  ')} ')"
        return f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g')))"

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    return f"""
WITH known AS (SELECT {form("body")} AS digest, min(license) AS license FROM (VALUES {known}) v(license, body) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
units AS (SELECT doc_id, 'text' AS unit, CAST(NULL AS INTEGER) AS line, text AS body FROM documents
  UNION ALL SELECT doc_id, 'line', CAST(line AS INTEGER), body FROM lines)
SELECT doc_id, unit, line, license, digest FROM (SELECT doc_id, unit, line, {form("body")} AS digest FROM units
  WHERE lower(body) LIKE '%licen%' OR lower(body) LIKE '%permission%' OR lower(body) LIKE '%redistribution%') JOIN known USING (digest)
"""
