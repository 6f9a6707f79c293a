"""License scans: canonical digests of whole texts and of their lines, joined to known licenses."""

from __future__ import annotations

import pathlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Published license texts and notices, and spellings that count as equal.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_AUTHOR = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n")
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n")
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
KNOWN = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the Software.\n\n" + _WARRANTY),
    ("ISC", f"ISC License\n\n{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AUTHOR),
    ("0BSD", f"BSD Zero Clause License\n\n{_GRANT}.\n\n" + _AUTHOR),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
#: Identifiers whose ``SPDX-License-Identifier`` line is a notice.
SPDX = tuple((
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 "
    "CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 "
    "EUPL-1.1 EUPL-1.2 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later "
    "ISC LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 "
    "MPL-2.0 MS-PL MS-RL NCSA OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Unlicense UPL-1.0 WTFPL Zlib").split())
_GNU = ("This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
        "Software Foundation; either version {version} of the License, or (at your option) any later version.")
#: Header notices as published, each a paragraph however it is wrapped or set as a comment; all hold the word license.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   "You may obtain a copy of the License at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((f"{short}-{version}.0-or-later" if "." not in version else f"{short}-{version}-or-later",
       _GNU.format(what=what, name=name, version=version))
      for short, name, versions in (("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")),
                                    ("LGPL", "Library General Public License", ("2",)), ("AGPL", "Affero General Public License", ("3",)))
      for version in versions for what in ("program", "library", "file")),
)
SPELLINGS = (("licence", "license"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"),
             ("authorisation", "authorization"), ("merchantibility", "merchantability"), ("non-commercial", "noncommercial"),
             ("sub-license", "sublicense"), ("per cent", "percent"))
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright (?:\(c\)|©|[0-9])|\(c\) ?[0-9]|© ?[0-9]|all rights reserved)[^\n]*$"
SPDX_LINE = r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n*]+)"
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def _all_lines(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    return F.transform(F.split(F.regexp_replace(out, NOT_WORD, " "), "\n"), lambda line: F.trim(line))


def canonical_lines(text: Column) -> Column:
    """Lines in lower case without copyright lines, with one spelling and words parted by one space."""
    return F.filter(_all_lines(text), lambda line: line != "")


def canonical_paragraphs(text: Column) -> Column:
    """Canonical lines between lines without a word, joined by a space."""
    parts = F.split(F.array_join(_all_lines(text), "\n"), "\n\n+")
    return F.transform(parts, lambda part: F.trim(F.replace(part, F.lit("\n"), F.lit(" "))))


def published() -> tuple[tuple[str, str], ...]:
    """``KNOWN``, the full texts of ``license_texts``, also without what follows their terms, and SPDX identifier lines."""
    out = list(KNOWN)
    for file in sorted((pathlib.Path(__file__).parent / "license_texts").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        terms, end, more = text.partition("END OF TERMS AND CONDITIONS")
        out += [(file.stem, text)] + ([(file.stem, terms + end), (file.stem, terms)] if more.strip() else [])
    return (*out, *((i, f"SPDX-License-Identifier: {i}") for i in SPDX))


def digest(lines: Column) -> Column:
    """Digest of a canonical text: its lines joined, so that wrapping does not matter."""
    return F.md5(F.concat_ws(" ", lines))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license_id) of the known texts, one row per digest. The list is short and fixed by the caller."""
    rows = spark.createDataFrame([(i, t) for i, t in known], "license_id string, text string")
    return rows.select("license_id", digest(canonical_lines(F.col("text"))).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def spdx_ids(text: Column) -> Column:
    """Ids named by SPDX identifier lines, single or in expressions of OR, AND, WITH and brackets; an exception after WITH is no license."""
    def listed(expression: Column) -> Column:
        names = F.split(F.lower(expression), r"\s+(?:or|and)\s+|[()]")
        return F.transform(names, lambda name: F.element_at(ids, F.trim(F.regexp_replace(F.regexp_replace(name, r"\s+with\s.*", ""), r"\+\s*$", "-or-later"))))

    ids = F.create_map(*[F.lit(x) for i in SPDX for x in (i.lower(), i)])
    lines = F.regexp_extract_all(text, F.lit(SPDX_LINE), F.lit(1))
    return F.array_compact(F.flatten(F.transform(lines, listed)))


def license_scan(docs: DataFrame, known=KNOWN, headers=()) -> DataFrame:
    """Licenses each document is, and license notices it holds as a line of its own, ``headers`` as a paragraph.

    Returns per row: doc_id, digest (of the whole canonical text), license_id (null unless the
    whole text is a known one), n_words of the canonical text, notices (ids of known lines and of
    SPDX identifier lines, sorted, distinct, joined by commas; empty if none). Headers must hold the
    word license. Null and empty texts have the digest of the empty text and no license. Repeated
    rows stay, each with its own notices; other columns are not looked at. Whole texts are looked up
    by hash join, lines in the row itself; nothing else is shuffled.
    """
    lines = canonical_lines(F.coalesce(F.col("text"), F.lit("")))
    spark = docs.sparkSession
    names = {r.digest: r.license_id for r in known_digests(spark, (*known, *headers)).collect()}  # as many as known texts

    lined = [(i, t) for i, t in known if not t.startswith("SPDX-")]  # SPDX lines are read as expressions

    def among(digests: Column, which: list[str]) -> Column:
        return F.filter(digests, lambda d: d.isin(which))

    hits = among(F.transform("_lines", lambda line: F.md5(line)), [r.digest for r in known_digests(spark, lined).collect()])
    if headers:
        wanted = [r.digest for r in known_digests(spark, headers).collect()]
        parts = among(F.transform(canonical_paragraphs(F.col("text")), lambda part: F.md5(part)), wanted)
        hits = F.when(F.lower("text").contains("licen"), F.concat(hits, parts)).otherwise(hits)
    spdx = F.when(F.lower("text").contains("spdx-license-identifier"), spdx_ids(F.col("text")))
    rows = docs.select("doc_id", "text", lines.alias("_lines")).select(
        "doc_id", digest(F.col("_lines")).alias("digest"),
        F.aggregate("_lines", F.lit(0).cast("long"), lambda n, line: n + F.size(F.split(line, " "))).alias("n_words"),
        hits.alias("_hits"), F.coalesce(spdx, F.array().cast("array<string>")).alias("_spdx"))
    ids = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    notices = F.concat(F.transform("_hits", lambda d: F.element_at(ids, d)), "_spdx")
    rows = rows.select("doc_id", "digest", "n_words", F.array_join(F.array_sort(F.array_distinct(notices)), ",").alias("notices"))
    return rows.join(known_digests(spark, known), "digest", "left").select("doc_id", "digest", "license_id", "n_words", "notices")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT_LINE)}, '', 'g')"
    for other, one in SPELLINGS:
        out = f"replace({out}, {_quoted(other)}, {_quoted(one)})"
    return f"list_filter(list_transform(string_split(regexp_replace({out}, {_quoted(NOT_WORD)}, ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


SCAN_SQL = f"""
WITH known AS (
  SELECT md5(array_to_string({_canonical_sql('t')}, ' ')) AS digest, min(i) AS license_id
  FROM (VALUES {', '.join(f'({_quoted(i)}, {_quoted(t)})' for i, t in KNOWN)}) v(i, t) GROUP BY 1),
l AS (SELECT row_number() OVER () AS r, doc_id, {_canonical_sql("coalesce(text, '')")} AS lines FROM documents),
d AS (SELECT r, doc_id, lines, md5(array_to_string(lines, ' ')) AS digest,
             coalesce(list_sum(list_transform(lines, lambda x: len(string_split(x, ' ')))), 0)::BIGINT AS n_words FROM l),
u AS (SELECT r, md5(unnest(lines)) AS digest FROM l),
n AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM u JOIN known USING (digest) GROUP BY r)
SELECT d.doc_id, d.digest, known.license_id, d.n_words, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN known USING (digest) LEFT JOIN n USING (r)
"""
