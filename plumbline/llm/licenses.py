"""Licence scan: canonical digests of whole texts (and of single lines) joined to the digests of known licences.

A text is brought to a canonical form (letter case, copyright notices, equivalent spellings, punctuation and blanks), its
SHA-256 is taken, and the digest is hash-joined to the table of known licences. The known table has a fixed size and is
broadcast; documents are not shuffled, only the few lines that hit are grouped by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import LOWER, UPPER, fold_ascii, text_or_empty

# Spellings that count as the same word, other form -> canonical form (words of ASCII letters).
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "acknowledgement": "acknowledgment",
    "authorised": "authorized",
    "favour": "favor",
    "fulfil": "fulfill",
    "organisation": "organization",
    "organisations": "organizations",
    "recognised": "recognized",
    "whilst": "while",
}

# Known licences by SPDX identifier; notices as they stand in documents, then whole short licences.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        """MIT License
Copyright (c) <year> <holders>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """ISC License
Copyright (c) <year> <holders>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Zero-Clause BSD
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
]

#: What makes a notice: copyright before a sign, a year, a <placeholder> or "by", or a sign of its own.
_MADE = r"(?:copyright[ \t:,]*(?:\(c\)|©|(?:19|20)[0-9]{2}|[<\[{]|by\b)|\(c\)[ \t:,]*(?:copyright|(?:19|20)[0-9]{2}|[<\[{])|©)"
_GRANT = r"permission (?:is hereby granted|to use)"
#: Notice lines, up to a grant on the same line; a notice inside a line if a grant follows it there; lines that only reserve rights.
_NOTICE = rf"^[^a-z0-9\n]*{_MADE}[^\n]*?(?={_GRANT}|$)|{_MADE}[^\n]{{0,500}}?(?={_GRANT})|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
_COPYRIGHT = r"^[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"  # of the SQL alone, which drops more: all lines that begin so
_NOT_WORD = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F ‐-―‘-‟…]+"
_MARK = r"(licenc|acknowledgement|authoris|favour|fulfil|organis|recognis|whilst)"


def canonical(text: Column) -> Column:
    """Canonical form with one line for each line of the text; blanks between words are single."""
    t = F.regexp_replace(fold_ascii(text), f"(?md){_NOTICE}", "")
    t = F.regexp_replace(t, _NOT_WORD, " ")
    s = t
    for other, word in SPELLINGS.items():
        s = F.regexp_replace(s, rf"(^|[ \n]){other}(?=[ \n]|$)", f"$1{word}")
    t = F.when(t.rlike(_MARK), s).otherwise(t)
    return F.trim(F.regexp_replace(t, r" *\n *", "\n"))


def whole(canon: Column) -> Column:
    return F.trim(F.regexp_replace(canon, r"[ \n]+", " "))


def known_licences(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of known texts; of texts with one digest the first name in order stays."""
    rows = spark.createDataFrame(known if known is not None else KNOWN, "license string, text string")
    rows = rows.select("license", F.sha2(whole(canonical(F.col("text"))), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, digest of the canonical text, license (null: the whole text is no known licence),
    line_licenses (the known licences that single lines name, sorted, joined by commas; empty if none).

    A null or empty text has the digest of the empty text and no licence. Rows that repeat an id share the lines found
    under that id, null ids too; an empty table gives no rows; other columns of docs are ignored.
    """
    known = F.broadcast(known.where(F.col("digest") != F.sha2(F.lit(""), 256)))  # a fixed table of this module, or one of its kind
    base = docs.select(F.col(id_col).alias("__id"), canonical(text_or_empty(text_col)).alias("c"))
    lines = base.select("__id", F.explode(F.split("c", "\n")).alias("line")).where("line <> ''")
    hits = lines.withColumn("digest", F.sha2("line", 256)).join(known, "digest")
    named = hits.groupBy("__id").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("lines"))
    named = named.withColumnRenamed("__id", "__hit")
    found = base.select("__id", F.sha2(whole(F.col("c")), 256).alias("digest")).join(known, "digest", "left")
    return found.join(named, F.col("__id").eqNullSafe(F.col("__hit")), "left").select(
        F.col("__id").alias(id_col), "digest", "license", F.coalesce("lines", F.lit("")).alias("line_licenses")
    )


def licence_sql(table: str = "documents") -> str:
    """The scan of `table` as DuckDB SQL."""
    q = lambda s: s.replace("'", "''")

    def canon(x: str) -> str:
        t = f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '(?m){q(_COPYRIGHT)}', '', 'g')"
        cls = _NOT_WORD
        for code in ("00A0", "2010", "2015", "2018", "201F", "2026"):
            cls = cls.replace(f"\\u{code}", f"\\x{{{code}}}")
        t = f"regexp_replace({t}, '{cls}', ' ', 'g')"
        for other, word in SPELLINGS.items():  # RE2 has no lookahead: twice, so that neighbours are both met
            for _ in range(2):
                t = f"regexp_replace({t}, '(^|[ \\n]){other}([ \\n]|$)', '\\1{word}\\2', 'g')"
        return f"trim(regexp_replace({t}, ' *\\n *', chr(10), 'g'), ' ')"

    values = ", ".join(f"('{n}', '{q(t)}')" for n, t in KNOWN)
    return f"""
with raw(license, text) as (values {values}),
known as (select sha256(trim(regexp_replace({canon('text')}, '[ \\n]+', ' ', 'g'), ' ')) as digest, min(license) as license from raw group by 1),
base as (select doc_id, {canon("coalesce(text, '')")} as c from {table}),
lines as (select doc_id, unnest(string_split(c, chr(10))) as line from base),
named as (select doc_id, string_agg(distinct license, ',' order by license) as l
          from lines join known on sha256(line) = digest where line <> '' group by doc_id),
found as (select doc_id, sha256(trim(regexp_replace(c, '[ \\n]+', ' ', 'g'), ' ')) as digest from base)
select f.doc_id, f.digest, k.license, coalesce(n.l, '') as line_licenses
from found f left join known k using (digest) left join named n on n.doc_id is not distinct from f.doc_id
"""
