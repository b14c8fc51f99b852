"""Licence scans by canonical digests, with DataFrame functions only.

A text is made canonical (case, copyright lines, punctuation, equivalent spellings, white space), and the MD5 of all of
it is looked up among those of known licence texts; so is that of each of its lines, for one-line notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence texts and notices, with their SPDX identifiers.
WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. " + WARRANTY
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
    "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software. 3. This notice may not be removed or altered from any source distribution."
)
BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary "
    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
BSD_3 = BSD_2 + (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission. "
)
KNOWN = {
    "MIT": [MIT, "The MIT License " + MIT, "MIT License " + MIT, "The MIT License (MIT) " + MIT, "MIT License (MIT) " + MIT, "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "ISC": [ISC, "ISC License " + ISC, "Released under the ISC License.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "Zlib": [ZLIB, "zlib License " + ZLIB, "SPDX-License-Identifier: Zlib"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "Licensed under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "BSD-3-Clause": [*(t + BSD_3 + BSD_DISCLAIMER for t in ("", "BSD 3-Clause License ", "The BSD 3-Clause License ")), "Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": [*(t + BSD_2 + BSD_DISCLAIMER for t in ("", "BSD 2-Clause License ", "The BSD 2-Clause License ")), "Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
}
# Spellings that count as the same word.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "acknowledgement": "acknowledgment",
    "favour": "favor",
    "fulfil": "fulfill",
    "judgement": "judgment",
    "organisation": "organization",
    "recognised": "recognized",
    "noncommercial": "non commercial",
    "non infringement": "noninfringement",
}
# MD5 of the canonical form of published licence texts; of those with an appendix also without it.
PUBLISHED = {
    "Apache-2.0": ["3f4bdf128d873ad53471b7e9441114d0", "bffba30efbdf372df340f85695113ed8", "07c9414201670fb13928580be37201e5"],
    "Artistic-1.0-Perl": ["6f45651e3e829ff0f6d4fc9f04384095"],
    "BSD-3-Clause": ["ddcd765ed0a3236bf96e15f76c36983a"],
    "CC0-1.0": ["93a180096f6cfcf2c0dd24f75c2eec48"],
    "GFDL-1.2": ["6fae616a2084258d6f1635920433f2e2"],
    "GFDL-1.3": ["9715992e76e496f0c0d0a6fcfb268fed"],
    "GPL-1.0": ["6c44f968a690a3e902f11333ecd8e064", "78f3b35da3d393ee93ecfeb7d20907e6", "f9bdbdf2be484ced90e5d8d884a7bed9"],
    "GPL-2.0": ["cf1d29d3f3cf5557bf161dde537bd10e", "ef5f237e7deb9b44dea91f27963744c2", "780441936713cf27e2446493797107c0"],
    "GPL-3.0": ["2f8efb555cc27a5b34eee86e72fc1749", "911c13fc9d0f569481e5c351a7c4f103", "2be49bb6cd12d910a70922606376f09b"],
    "LGPL-2.0": ["7d054715126defc8a18808a6934f14a4", "1389f4e6c9257fffaaa58a4ba72e4209", "67adee7de2991bbdb3346ca63ffc6b75"],
    "LGPL-2.1": ["519c5306e9399a753b0e3b10cc3f1fbd", "ea4739ccf5314c5f636f979cc03259e2", "8bafa4c612887b0b12bf68d7e5fe0527"],
    "LGPL-3.0": ["b31b7335bc37919e8cdd79154e04d88d"],
    "MPL-1.1": ["0cfa0216ba5b85fd867e3535679d8c15"],
    "MPL-2.0": ["35fb4d2625087f7fd780039aa7b4ebb2"],
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that starts with a copyright sign. One of up to so many characters goes; of a longer one, the statement alone: all up to a sentence's end.
MARKS, LINE = ("copyright", "(c)", "©", "all rights reserved"), 120
START = r"^[^a-z0-9(©]*(copyright|\(c\)|©|all rights reserved)"
STATEMENT = START + r".*?(all rights reserved|[^ .;]{2,}[.;]|$)[ .;]*(all rights reserved[ .;]*)?"
#: Steps (pattern, replacement) that both Java's and RE2's syntax read alike. Lines stay lines; words end up apart by one space.
PUNCTUATION = [(r"&", " and "), (r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f‘’“”«»–—]+", " ")]
BLANKS = [(r" *\n *", "\n")]
#: Licences that a caller may name; they are held by the driver and broadcast.
MOST_KNOWN = 10_000


def canonical(text: Column) -> Column:
    """Canonical lines of a text; a null text counts as empty. Texts without a copyright sign or an equivalent spelling skip those steps."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    bare = lambda x: F.when(~x.rlike(START), x).when(F.length(x) <= LINE, "").otherwise(F.regexp_replace(x, STATEMENT, ""))
    some = F.lit(False)
    for mark in MARKS:
        some = some | out.contains(mark)
    out = F.when(some, F.array_join(F.transform(F.split(out, "\n"), bare), "\n")).otherwise(out)
    for pattern, to in PUNCTUATION:
        out = F.regexp_replace(out, pattern, to)
    spelled = out
    for a, b in SPELLINGS.items():
        spelled = F.regexp_replace(spelled, rf"\b{a}\b", b)
    out = F.when(out.rlike("|".join(SPELLINGS)), spelled).otherwise(out)
    for pattern, to in BLANKS:
        out = F.regexp_replace(out, pattern, to)
    return out


def whole(lines: Column) -> Column:
    """All of a canonical text on one line."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def canonical_sql(text: str) -> str:
    """The same in SQL whose ``regexp_replace`` takes the option 'g'."""
    sql = lambda x: "'" + x.replace("'", "''") + "'" if "\n" not in x else "chr(10)"
    lines = f"string_split(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), chr(10))"
    out = f"array_to_string(list_transform({lines}, lambda x: CASE WHEN NOT regexp_matches(x, {sql(START)}) THEN x WHEN length(x) <= {LINE} THEN '' ELSE regexp_replace(x, {sql(STATEMENT)}, '') END), chr(10))"
    for pattern, to in [*PUNCTUATION, *((rf"\b{a}\b", b) for a, b in SPELLINGS.items()), *BLANKS]:
        out = f"regexp_replace({out}, {sql(pattern)}, {sql(to)}, 'g')"
    return out


def known_table(known: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    return sorted((i, t) for i, texts in (known or KNOWN).items() for t in texts)


def scan_licences(docs: DataFrame, known: dict[str, list[str]] | None = None, published: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, text_digest, license_id, notices of every row.

    text_digest: MD5 of the canonical text. license_id: the known licence whose text that is, null if none. notices: identifiers whose
    texts are lines of it, each once, in order, joined by commas; empty if none. A null, empty or blank text has the
    digest of the empty text, which is no licence. Repeated rows each come back; an empty table gives none.
    known: texts by identifier; published: digests of canonical texts by identifier; together at most ``MOST_KNOWN``.
    """
    spark = docs.sparkSession
    listed = [(i, d) for i, ds in (PUBLISHED if published is None else published).items() for d in ds]
    if len(known_table(known)) + len(listed) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} licence texts")
    texts = spark.createDataFrame(known_table(known), "license_id string, known string")
    digests = texts.select("license_id", F.md5(whole(canonical(F.col("known"))).cast("binary")).alias("text_digest"))
    digests = digests.unionByName(spark.createDataFrame(listed, "license_id string, text_digest string"))
    digests = digests.groupBy("text_digest").agg(F.min("license_id").alias("license_id"))
    # The table is as long as the lists, which are bounded above.
    by_line = F.broadcast(digests.agg(F.map_from_entries(F.collect_list(F.struct("text_digest", "license_id"))).alias("__known")))
    lines = docs.select("doc_id", canonical(F.col("text")).alias("__lines"))
    each = F.transform(F.split("__lines", "\n"), lambda x: F.try_element_at(F.col("__known"), F.md5(F.trim(x).cast("binary"))))
    found = lines.join(by_line, F.lit(True)).select(
        "doc_id",
        F.md5(whole(F.col("__lines")).cast("binary")).alias("text_digest"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(each))), ",").alias("notices"),
    )
    return found.join(F.broadcast(digests), "text_digest", "left").select("doc_id", "text_digest", "license_id", "notices")


def scan_sql(known: dict[str, list[str]] | None = None) -> str:
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in known_table(known))
    listed = ", ".join(f"('{i}', '{d}')" for i, ds in PUBLISHED.items() for d in ds)
    flat = lambda x: f"md5(trim(regexp_replace({x}, '[ \\n]+', ' ', 'g')))"
    return f"""
    WITH texts(license_id, known) AS (VALUES {rows}),
    published(license_id, text_digest) AS (VALUES {listed}),
    digests AS (SELECT text_digest, min(license_id) AS license_id FROM (SELECT {flat(canonical_sql('known'))} AS text_digest, license_id FROM texts UNION ALL SELECT text_digest, license_id FROM published) k GROUP BY 1),
    docs AS (SELECT row_number() OVER () AS r, doc_id, {canonical_sql('text')} AS lines FROM documents),
    each AS (SELECT r, md5(trim(unnest(string_split(lines, chr(10))))) AS text_digest FROM docs),
    found AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM each JOIN digests USING (text_digest) GROUP BY r)
    SELECT doc_id, {flat('lines')} AS text_digest, d.license_id, coalesce(notices, '') AS notices
    FROM docs LEFT JOIN digests d ON d.text_digest = {flat('lines')} LEFT JOIN found USING (r)"""
