"""License scans by canonical digest lookup.

A text's canonical form: A-Z lower-cased, equivalent spellings made one, lines
that state a copyright left out, everything but letters, digits and characters
beyond ASCII made a space, runs of spaces made one, none at either end. Known
licences and notices go through the same form; a SHA-256 digest of the whole form
is joined with theirs. Two kinds of text are looked up: a document's whole text,
and each of its lines, since a notice is one line of its own.

Null and empty texts have the canonical form of nothing, which matches no licence.
Repeated rows get the same result, an empty table an empty one; further columns
are not looked at. Texts that match two licences carry the one that sorts first.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import ascii_lower, broadcast_if_small, row_key, text_or_empty

# Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("recognised", "recognized"),
    ("noncommercial", "non-commercial"),
    ("non commercial", "non-commercial"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
    ("https://", "http://"),
    ("&", "and"),
]

# Lines that state a copyright, in the lower-case text.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9]|by )[^\n]*"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _bsd() -> list[tuple[str, str]]:
    """Both texts, with and without a title, "All rights reserved." and numbers."""
    found = []
    for name, n, text in (("BSD-2-Clause", 2, _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", 3, _BSD_HEAD + _BSD_NAMES + _BSD_TAIL)):
        bare = text.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
        titles = ("", f"BSD {n}-Clause License\n\n", f"The {n}-Clause BSD License\n\n")
        found += [(name, title + rights + body) for title in titles for rights in ("", "All rights reserved.\n\n") for body in (text, bare)]
    return found


def _whole_texts() -> list[tuple[str, str]]:
    """Texts too long to stand here, from files named by identifier; each also without what follows its terms."""
    found = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        found += [(path.stem, text)] + ([(path.stem, terms), (path.stem, terms + end)] if end else [])
    return found


# Whole texts and one-line notices of well-known licences, by SPDX identifier.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    *_bsd(),
    *_whole_texts(),
]


def _prepared(text: Column) -> Column:
    """Lower case and one spelling, still in lines."""
    text = ascii_lower(text)
    for found, one in SPELLINGS:
        text = F.replace(text, F.lit(found), F.lit(one))
    return text


def _flattened(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def canonical(text: Column) -> Column:
    """The canonical form of a whole text."""
    return _flattened(F.regexp_replace(_prepared(text), COPYRIGHT_LINE, "\n"))


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line of a text; that of a copyright line is empty."""
    lines = F.split(_prepared(text), "\n")
    return F.transform(lines, lambda line: _flattened(F.regexp_replace(line, COPYRIGHT_LINE, "\n")))


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license: one row for each known text; as many as the list, so it can be broadcast.

    Of identifiers whose texts have one canonical form, the least in order stands for them.
    """
    rows = spark.createDataFrame(KNOWN if known is None else known, "license string, body string")
    return rows.select(F.sha2(canonical(F.col("body")), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, text_digest, text_license (null if none), n_notices
    (lines that are a known notice), licenses (the sorted identifiers of both kinds, comma-joined).

    Lines meet the known digests where they are read; those that match are gathered
    by the row's key. Texts are never shuffled.
    """
    known = broadcast_if_small(known)
    text = text_or_empty(text_col)
    # The key is made below the explode: beside it, it would be made again for each line.
    lines = docs.select(row_key(id_col, text_col).alias("row"), canonical_lines(text).alias("all"))
    lines = lines.select("row", F.posexplode("all").alias("pos", "line")).filter("line <> ''")
    hits = lines.select("row", "pos", F.sha2("line", 256).alias("digest")).join(known, "digest")
    notices = hits.groupBy("row").agg(F.collect_set(F.struct("pos", "license")).alias("found"))
    whole = docs.select(F.col(id_col), row_key(id_col, text_col).alias("row"), F.sha2(canonical(text), 256).alias("digest")).join(known, "digest", "left")
    both = whole.join(notices, "row", "left").withColumn("found", F.coalesce("found", F.expr("filter(array(struct(0 AS pos, '' AS license)), x -> false)")))
    names = F.array_compact(F.concat(F.transform("found", lambda x: x["license"]), F.array("license")))
    return both.select(
        id_col,
        F.col("digest").alias("text_digest"),
        F.col("license").alias("text_license"),
        F.size("found").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("licenses"),
    )
