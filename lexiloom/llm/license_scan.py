"""License scans: canonical digest lookup.

A text's canonical form is lower-case, without copyright lines, with equivalent spellings brought to one
(licence/license, quotation marks, dashes, http/https) and every run of punctuation and white space one
blank. Its SHA-256 is hash-joined to the digests of known licence texts. Two kinds of whole texts are looked
up: the document as a whole and each of its lines, since notices stand on lines of their own. The
known texts are a fixed list, so their table is broadcast.

Defined results: NULL and empty texts and texts of punctuation only have no canonical form and never
match; repeated rows give repeated rows; NULL doc_ids keep their row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (pattern, replacement) in order, on lower-case text. Plain enough for every regex dialect.
STEPS = [
    (r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*", "\n"),
    (r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(\n|$)", "\n"),
    (r"licence", "license"),
    (r"https?://(www\.)?", ""),
    (r"(^|[^a-z])sub-license", "${1}sublicense"),
    (r"(^|[^a-z])non-infringement", "${1}noninfringement"),
    (r"(^|[^a-z])merchantibility", "${1}merchantability"),
    (r"[^a-z0-9]+", " "),
]

#: Public licence texts and notices, by SPDX identifier.
KNOWN = {
    "MIT": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "SPDX-License-Identifier: ISC",
    ],
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "0BSD": ["SPDX-License-Identifier: 0BSD"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}


def canonical(text: str) -> str:
    """Plain-Python twin of ``canonical_column``, used for the known texts."""
    text = text.lower()
    for pattern, new in STEPS:
        text = re.sub(pattern, new.replace("${1}", r"\1"), text)
    return text.strip(" ")


def canonical_column(text: Column) -> Column:
    text = F.lower(text)
    for pattern, new in STEPS:
        text = F.regexp_replace(text, pattern, new.replace("${1}", "$1"))
    return F.trim(text)


#: Every known text holds one of these, whatever its spelling (a test checks it).
HINT = "licen[cs]e|public domain|permission"


def known_digests() -> list[tuple[str, str]]:
    return [(hashlib.sha256(canonical(t).encode()).hexdigest(), name) for name, texts in KNOWN.items() for t in texts]


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, digest, document_license, line_licenses, license_lines) of every row of ``docs`` (doc_id, text).

    digest: of the whole text's canonical form (NULL if it has none); document_license: its identifier, or
    NULL; line_licenses: identifiers of the lines that are known texts, sorted; license_lines: how many.
    """
    table = F.broadcast(docs.sparkSession.createDataFrame(known if known is not None else known_digests(), "known string, license string"))
    digest = lambda c: F.when(c != "", F.sha2(c, 256))
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    # the whole text is unit -1; a line that no known text can equal after canonicalising is left out
    word = F.lower(F.col("unit")).rlike(HINT) if known is None else F.lit(True)
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")
    units = rows.select("doc_id", "row", F.explode(lines).alias("unit")).where(word)
    hit = units.select("doc_id", "row", digest(canonical_column(F.col("unit"))).alias("known")).join(table, "known").groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("line_licenses"), F.count("*").alias("license_lines"))
    whole = rows.select("doc_id", "row", digest(canonical_column(F.coalesce("text", F.lit("")))).alias("digest"))
    found = whole.join(table.withColumnRenamed("license", "document_license"), whole["digest"] == F.col("known"), "left").drop("known")
    return found.join(hit, "row", "left").select("doc_id", "digest", "document_license", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"), F.coalesce("license_lines", F.lit(0)).cast("long").alias("license_lines"))
