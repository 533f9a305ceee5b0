"""Licence texts by canonical digests.

A text is put in canonical form (lower case, no copyright lines, equivalent spellings
made one, punctuation and white space as single spaces) and hashed; the digest of the entire
text is joined with those of known licences.  A second form also finds wrapped, titled and
one-line files: it drops titles at the head and copyright statements only, never a line of the body that
begins with that word.  Everything is one projection and two hash joins; the built-in
table has a fixed size and is broadcast, any other table is left to the optimizer.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that count as one, after punctuation is gone.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("per cent", "percent"),
)
#: Fixed value: a line that only states copyright.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|all rights reserved)[^\n]*$"

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
#: Texts of known licences and the usual one-line notices.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _AS_IS),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL),
    ("notice:Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("notice:MIT", "Released under the MIT License."),
    ("notice:GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("notice:CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


#: Whole texts of common licences, one file each; those with an appendix after END_OF_TERMS are known without it, too.
TEXTS = Path(__file__).with_name("license_texts")
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
#: Fixed value: how a body or notice begins that follows a copyright statement on its line.
STARTS = (
    r"permission (?:is hereby|to use)|redistribution and use|(?:licensed|released|distributed) under|everyone is permitted|the above copyright|the software is|"
    r"this (?:is free|(?:program|library|software|work) (?:is|comes|may))|gnomovision comes"
)
#: Fixed value: words after "copyright" at the head of a wrapped body line, where no holder follows.
_NO_HOLDER = (
    r"notices?|holders?|owners?|ownership|laws?|licen[cs]es?|and|or|in|on|of|for|to|is|as|are|be|may|from|that|with|if|you|under|by law|interests?|statements?|treaty|treaties|status|protection|"
    r"disclaimers?|permissions?|claims?|rights?|materials?|infringements?|resulting|doctrines?|assignments?|patents?|works?|act|terms?|conditions?|information|registration"
)
_YEAR = r"[\[<{(]?[ \t]*(?:\d{4}|yyyy|year)"
#: Fixed value: a copyright statement: with (c) or a year anywhere, with only a holder at the head of a line; it ends with the line or where a body starts.
STATEMENT = (
    rf"(?m)(?:(?:copyright[ \t:]*(?:\(c\)|©|&copy;)|(?:\(c\)|©|&copy;)[ \t]*(?:copyright\b|(?={_YEAR}))|copyright[ \t:]*(?={_YEAR}))|"
    rf"^[^\p{{L}}\p{{N}}\n]*copyright[ \t:]+(?!(?:{_NO_HOLDER})\b)(?=[\[<{{]?\p{{L}}))[^\n]*?(?=\n|\z|\b(?:{STARTS})\b)|^[^\p{{L}}\p{{N}}\n]*all rights reserved[^\p{{L}}\p{{N}}\n]*$"
)
#: Titles before the body, after punctuation is gone.
TITLES = (
    r"(?:expat |x11 )?mit license(?: mit| expat)*",
    r"isc license(?: isc)?",
    r"(?:bsd zero clause|zero clause bsd|0bsd) license(?: 0bsd)?",
    r"(?:new |simplified |modified |revised )?bsd(?: [23]| two| three)?(?: clause)?(?: new or revised| new| revised| modified| simplified)? license",
    r"(?:[23]|two|three) clause bsd license",
    r"apache license(?: version)? 2 0(?: january 2004)?(?: http www apache org licenses)?",
    r"gnu (?:lesser |library )?general public license(?: version \d(?: \d)?)?(?: (?:\d+ )?(?:june|february) \d{4})?",
    r"mozilla public license(?: version)? \d \d",
    r"unlicense",
    r"creative commons legal code cc0 1 0 universal",
)
#: What may differ within one licence, after punctuation is gone: list marks of BSD, holder of its third clause, scheme of links, addresses of the foundation.
VARIANTS = (
    (r"\bhttps\b", "http"),
    (r"\b(?:\d|[abc]) (?=redistributions (?:of source|in binary)|neither the name)", ""),
    (r"neither the names? of .{1,120}? nor the names of (?:its|their|any) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"\b\d+ (?:franklin st|temple place|mass ave)(?:\w*)(?: \w+){0,8}? 0\d{4}(?: \d{4})?(?: usa)?", ""),
    (rf"^(?:(?:the |license )?(?:{'|'.join(TITLES)})(?: |$))+", ""),
)


def _words(text: Column) -> Column:
    out = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return out


def canonical(text: Column) -> Column:
    return _words(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " "))


def body(text: Column) -> Column:
    """The text without titles at its head, copyright statements and other differences between files of one licence."""
    out = _words(F.regexp_replace(F.lower(text), STATEMENT, " "))
    for one, other in VARIANTS:
        out = F.regexp_replace(out, one, other)
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark) -> DataFrame:
    """The built-in table: license_id, text."""
    rows = list(KNOWN)
    for file in sorted(TEXTS.glob("*.txt")):
        text = file.read_text()
        rows.append((file.stem, text))
        if END_OF_TERMS in text:
            terms = text[: text.index(END_OF_TERMS)]
            rows += [(file.stem, terms), (file.stem, terms + END_OF_TERMS)]
    return spark.createDataFrame(rows, "license_id string, text string")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, license_id) for each row: the licence that the entire text is, else null.

    digest is that of the canonical text; where no licence has it, the bodies of both are compared.  A null
    text has a null digest; an empty one, or one of titles, copyright lines and punctuation only, is no licence.
    Of known licences with one digest the least license_id counts; null and blank known texts are left
    out.  Repeated rows stay.  Other columns are ignored.
    """
    spark = docs.sparkSession
    table = known_licenses(spark) if known is None else known
    text = F.col(text_col).cast("string")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("digest"), F.sha2(body(text), 256).alias("_body"))
    for i, (key, form) in enumerate((("digest", canonical), ("_body", body))):
        own = table.where(form(F.col("text")) != "").groupBy(F.sha2(form(F.col("text")), 256).alias(f"_key{i}")).agg(F.min("license_id").alias(f"_id{i}"))
        out = out.join(F.broadcast(own) if known is None else own, F.col(key) == F.col(f"_key{i}"), "left")
    return out.select("doc_id", "digest", F.coalesce("_id0", "_id1").alias("license_id"))


def _sql_canonical(text: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_LINE}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for one, other in SPELLINGS:
        out = f"replace({out}, '{one}', '{other}')"
    return out


ORACLE_SQL = f"""
WITH k AS (SELECT min(license_id) AS license_id, sha256({_sql_canonical('text')}) AS digest FROM (VALUES {', '.join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in KNOWN)}) AS v(license_id, text) GROUP BY 2),
d AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS digest FROM documents)
SELECT doc_id, d.digest, license_id FROM d LEFT JOIN k ON d.digest = k.digest
"""
