"""License scan: canonical digests of whole texts and of their lines, hash-joined to known license digests.

The known texts are those below, and the files of the folder ``licenses`` beside this module: full texts of long public
licenses, each named by its id. Any table of (license_id, text) can take their place.

Canonical form, in this order: A-Z lower-cased; lines that are copyright notices emptied (``copyright``, ``(c)`` or the
copyright sign before a year, a sign or a holder; words that go on a sentence, as in ``copyright notice``, are none);
blanks and comment signs at both ends of lines dropped; lines joined by one space, but right after a hyphen inside a word
by none; equivalent spellings unified; every run of characters that is neither a-z, 0-9 nor beyond ASCII turned into one
space; trimmed. A license text therefore matches however it is wrapped, cased, quoted, commented or attributed. Single
lines are looked up in the same form, each by itself.

The SQL of this query has the form of an earlier version, in which notices were any lines that start with
``copyright`` and spellings were unified before lines were joined. Both agree where no text depends on that.

The known licenses have one row each, so their digest table is a few kilobytes. It is broadcast only below
``BROADCAST_ROWS``; a larger table is left to an ordinary hash join.

Defined cases: a null or blank text has no canonical form and matches nothing; repeated rows count once each; a
document whose whole text is a license of one line matches in both scopes; documents without a match give no row;
an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import importlib.resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 50_000
#: words after "copyright" that go on a sentence, and those after an item's "(c)"
GOES_ON = "notices?|holders?|owners?|owned|laws?|licen[sc]es?|licen[sc]ed|licensors?|and|or|in|to|of|for|is|are|as|on|that|which|with|under|from|act|acts|protections?|permissions?|statements?|interests?|infringements?|claims?|related|rights?|treaty|treaties|status|disclaimers?|management|information|works?|ownership|grants?|shall|may|must|will|have|has|not|at|if|this|any|terms?"
ITEM = GOES_ON + "|you|your|the|a|an|all|no|each|every|it|its|use|copy|distribute|modify|accompany|convey|give|keep|provide|where|when|by|such|those|these"
NOTICE_LINE = rf"(?m)^[ \t*#/;-]*(copyright[ \t:,]*(\(c\)|©|&copy;|[0-9<\[{{])|copyright[ \t]+(?!({GOES_ON})\b)[^\s.,;:)]|\(c\)[ \t]*(copyright[ \t]*[0-9]|[0-9<\[{{©])|\(c\)[ \t]+(?!({ITEM})\b)[a-z\x{{80}}-\x{{10FFFF}}]|©)[^\n]*$"
#: the notice lines of the SQL
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(copyright|\(c\)|©)[^\n]*$"
#: pairs (pattern, replacement); the patterns mean the same in Java's and RE2's syntax
SPELLINGS = (
    (r"\blicence", "license"),
    (r"\b(authori|organi|recogni|utili|optimi|initiali)s(e|ed|es|ing|ation|ations)\b", r"$1z$2"),
    (r"https?://(www\.)?", ""),
    (r"\bversion (\d)", r"v$1"),
    (r"\bv(\d+)\.0\b", r"v$1"),
    (r"&", " and "),
    (r"\bnon-?commercial", "noncommercial"),
    (r"\bsub-?license", "sublicense"),
    (r"\bcopyright (holder|owner)s?\b", r"copyright owner"),
)

#: (id, text) of known licenses: short notices, and the shorter full texts of public licenses
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
LICENSES = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC0-1.0", "This work is dedicated to the public domain."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "All rights reserved."),
)
#: whole texts that the SQL does not have
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD_3 = BSD_2 + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZERO_BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + ISC.split("\n\n")[1]
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
WHOLE_TEXTS = (
    *((i, head + text + BSD_END) for i, title, text in (("BSD-2-Clause", "BSD 2-Clause License", BSD_2), ("BSD-3-Clause", "BSD 3-Clause License", BSD_3)) for head in ("", title + "\n\n", "All rights reserved.\n\n", title + "\n\nAll rights reserved.\n\n")),
    ("0BSD", ZERO_BSD),
    ("0BSD", "BSD Zero Clause License\n\n" + ZERO_BSD),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("Apache-2.0", APACHE_NOTICE),
    ("BSL-1.0", BSL),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + BSL),
)


def full_texts() -> tuple[tuple[str, str], ...]:
    """(id, text) of the full texts in the folder ``licenses``; texts with parts after their end are known with and without these."""
    folder = importlib.resources.files("assayframe.llm").joinpath("licenses")
    out = []
    for path in sorted(folder.iterdir(), key=lambda p: p.name):
        name, text = path.name.removesuffix(".txt"), path.read_text(encoding="utf-8")
        out.append((name, text))
        for end in ("END OF TERMS AND CONDITIONS",):
            if end in text:
                out.append((name, text[: text.index(end) + len(end)]))
                out.append((name, text[: text.index(end)]))
    return tuple(out)


#: those of SPELLINGS that can begin in one line and end in the next
ACROSS = tuple((pattern, put) for pattern, put in SPELLINGS if " " in pattern or "-?" in pattern or pattern.startswith(r"\bv("))
NOISE = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"


def spelt_lines(text: Column) -> Column:
    """A lower-cased text without notices, without blanks and comment signs at the ends of lines, with spellings unified in each line."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), NOTICE_LINE, "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?m)^[ \t\r*#/;>-]+|[ \t\r*#/]+$", ""), r"[^\S\n]+", " ")
    for pattern, put in SPELLINGS:
        out = F.regexp_replace(out, pattern, put)
    return out


def canonical_lines(spelt: Column) -> Column:
    """The canonical non-empty lines of spelt lines."""
    return F.filter(F.transform(F.split(F.regexp_replace(spelt, NOISE, " "), "\n"), lambda line: F.trim(line)), lambda line: line != "")


def canonical_whole(spelt: Column) -> Column:
    """The canonical form of spelt lines as one."""
    out = F.regexp_replace(F.regexp_replace(spelt, r"(?<=[a-z0-9]-)\n+(?=[a-z0-9])", ""), r"\s+", " ")
    for pattern, put in ACROSS:
        out = F.regexp_replace(out, pattern, put)
    return F.trim(F.regexp_replace(out, NOISE, " "))


def license_digests(spark: SparkSession, licenses=None) -> DataFrame:
    """license_id and digest of known licenses, the built-in ones unless others are given; texts with equal digests must have the same id."""
    texts = licenses = LICENSES + WHOLE_TEXTS + full_texts() if licenses is None else licenses
    if not isinstance(licenses, DataFrame):
        rows = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in licenses])
        texts = spark.range(1).select(F.inline(rows))
    whole = canonical_whole(spelt_lines(F.col("text")))
    return texts.select("license_id", whole.alias("form")).where("form <> ''").groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, licenses: DataFrame | tuple | None = None) -> DataFrame:
    """doc_id, license_id, whole (the entire text is that license) and n_lines (lines that are that license by themselves)."""
    known = license_digests(docs.sparkSession, licenses)
    if not isinstance(licenses, DataFrame) or licenses.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    # an empty form has no known digest; a filter on it would compute it twice
    spelt = docs.select("doc_id", spelt_lines(F.col("text")).alias("spelt"))
    lines = spelt.select("doc_id", canonical_lines(F.col("spelt")).alias("lines"), canonical_whole(F.col("spelt")).alias("form"))
    whole = F.struct(F.lit(True).alias("whole"), F.sha2("form", 256).alias("digest"))
    each = F.transform("lines", lambda line: F.struct(F.lit(False).alias("whole"), F.sha2(line, 256).alias("digest")))
    units = lines.select("doc_id", F.inline(F.concat(F.array(whole), each)))
    return (
        units.join(known, "digest")
        .groupBy("doc_id", "license_id")
        .agg(F.max("whole").alias("whole"), F.sum(F.when(F.col("whole"), 0).otherwise(1)).cast("bigint").alias("n_lines"))
    )


def canonical_sql(text: str) -> str:
    """DuckDB's expression for the canonical lines of the SQL."""
    out = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', '', 'g')"
    for pattern, put in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{put.replace('$', chr(92))}', 'g')"
    out = f"regexp_replace({out}, '[^a-z0-9\\n\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def oracle() -> str:
    values = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in LICENSES)
    return f"""
    WITH known AS (SELECT sha256(form) AS digest, min(license_id) AS license_id FROM (SELECT license_id, array_to_string({canonical_sql('t')}, ' ') AS form FROM (VALUES {values}) v(license_id, t)) WHERE form <> '' GROUP BY 1),
    docs AS (SELECT doc_id, {canonical_sql('text')} AS lines FROM documents WHERE text IS NOT NULL),
    units AS (SELECT doc_id, true AS whole, sha256(array_to_string(lines, ' ')) AS digest FROM docs WHERE len(lines) > 0
        UNION ALL SELECT doc_id, false, sha256(line) FROM (SELECT doc_id, unnest(lines) AS line FROM docs))
    SELECT doc_id, license_id, bool_or(whole) AS whole, CAST(sum(CASE WHEN whole THEN 0 ELSE 1 END) AS BIGINT) AS n_lines
    FROM units JOIN known USING (digest) GROUP BY 1, 2"""
