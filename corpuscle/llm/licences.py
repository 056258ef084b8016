"""Licence texts and notices in documents, by digests of canonical texts.

A text is brought into one form: lower case, no copyright lines, one spelling of words that have several, no punctuation, single
spaces. Two texts of the same form have the same digest, and digests are looked up in a table of known licences by an equi-join,
for whole documents and for each of their lines. Everything is built-in functions.
"""

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pairs of spellings; the second is kept. Whole words, after punctuation has gone.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
)
COPYRIGHT_SENTENCE = r"(^|\n)[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*?\. +(licensed|released|distributed|available|this) "
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"

# Licences by name, as notices put them.
NAMES = (
    ("MIT", "the MIT License"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "the Mozilla Public License, Version 2.0"),
    ("BSD-2-Clause", "the 2-Clause BSD License"),
    ("BSD-3-Clause", "the 3-Clause BSD License"),
    ("ISC", "the ISC License"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
)
PHRASES = (
    "Licensed under {}",
    "Released under {}",
    "Distributed under {}",
    "Available under {}",
    "This work is licensed under {}",
    "This file is licensed under {}",
    "This software is released under {}",
)
TEXTS = (
    (
        "MIT",
        """MIT License

Copyright (c) year holder

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    ),
    (
        "ISC",
        """ISC License

Copyright (c) year holder

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
""",
    ),
)


def known_texts() -> list[tuple[str, str]]:
    """Licence and text of everything known: whole licences, and notices by phrase and name."""
    notices = ((key, phrase.format(name)) for phrase, (key, name) in itertools.product(PHRASES, NAMES))
    return [*TEXTS, *notices]


def canonical(text: Column) -> Column:
    """A text in its one form; a null text is empty."""
    out = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_SENTENCE, "$1$2 "), COPYRIGHT_LINE, " ")
    named = F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("(c)")) | F.contains(out, F.lit("©"))
    out = F.when(named, plain).otherwise(out)
    out = F.concat(F.lit(" "), F.regexp_replace(out, NOT_WORD, " "), F.lit(" "))
    for other, kept in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {kept} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical(text), 256)


def known_licences(spark: SparkSession) -> DataFrame:
    """`licence, digest` of everything known, one row per digest."""
    rows = spark.createDataFrame(known_texts(), "licence string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """`doc_id, digest, licence, n_notices, notices` for every row of `docs(doc_id, text)`.

    licence is the known one whose text the whole document is, null when there is none. A notice is a line that is a known text;
    notices lists their licences, comma-joined, in order and once each. An empty text or line is nothing. Rows alike in id and
    text have the same result each; null texts are empty and null ids stay. Other columns are not read. `known` has one row per digest.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    whole = rows.select("doc_id", F.sha2("text", 256).alias("_text"), digest(F.col("text")).alias("digest"))
    whole = whole.join(known, "digest", "left")
    lines = rows.select("doc_id", F.sha2("text", 256).alias("_text"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = lines.where(F.length("line") > 0).withColumn("digest", digest(F.col("line"))).join(known, "digest")
    found = found.groupBy(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), "_text").agg(
        F.count_distinct("pos").alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"),
    )
    keyed = whole.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull()})
    return keyed.join(found, ["_id", "_none", "_text"], "left").select(
        "doc_id",
        "digest",
        "licence",
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
        F.coalesce("notices", F.lit("")).alias("notices"),
    )
