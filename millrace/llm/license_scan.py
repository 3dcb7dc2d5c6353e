"""Licence texts by canonical digest."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.work import Work

# Spellings that are replaced, one after the other, in lower-cased text.
SPELLINGS = (("licence", "license"), ("licencing", "licensing"), ("sub-licens", "sublicens"), ("non-commercial", "noncommercial"), ("favour", "favor"), ("organisation", "organization"), ("whilst", "while"), ("http://", "https://"), ("&", " and "), ("all rights reserved", " "))
# Lines of copyright, and what is not a letter or digit in ASCII.  Both engines' regular expressions read these alike.
COPYRIGHT = r"(^|\n)[\x20\t*#/]*(copyright|\(c\)|©)[^\n]*"
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MARKS_OF_LINES = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
# What typesetting puts for marks and spaces, and characters without width, which stand inside words.
TYPESET = r"[\x{A0}\x{AB}\x{B4}\x{B7}\x{BB}\x{2BC}\x{1680}\x{2000}-\x{200A}\x{200E}-\x{205F}\x{2061}-\x{206F}\x{3000}]"
WIDTHLESS = r"[\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
EITHER = r"[\x{A0}\x{AB}\x{AD}\x{B4}\x{B7}\x{BB}\x{2BC}\x{1680}\x{2000}-\x{206F}\x{3000}\x{FEFF}]"
# Lines of a licence's body that begin with the word or are its clause (c), and lines that state a copyright (year, sign or holder).
BODY = r"(^|\n)[\x20\t*#/]*(copyright[\x20\t]+(notice|holder|owner|law|licen[cs]e)|\(c\)(?![^\n]*[12][0-9]{3}))"
STATEMENT = r"(^|\n)[\x20\t*#/]*(\(c\)(?=[^\n]*[12][0-9]{3})|©|copyright(?=[^\n]*(\(c\)|©|[12][0-9]{3}))|copyright(?![\x20\t]+(notice|holder|owner|law|licen[cs]e)))[^\n]*"

# The texts of short public licences, and notices that stand for a licence as a line.
TEXTS: dict[str, str] = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
NOTICES: dict[str, str] = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "SPDX-License-Identifier: MIT": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
}
#: Whole texts that are known beside those of the SQL, and the titles that stand above a whole text.
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
FURTHER: list[tuple[str, str]] = [
    *[("BSD-2-Clause", _BSD.replace("1. R", f"{a}R").replace("2. R", f"{b}R").format("", who)) for a, b in (("1. ", "2. "), ("", "")) for who in ("HOLDER", "OWNER")],
    *[("BSD-3-Clause", _BSD.replace("1. R", f"{a}R").replace("2. R", f"{b}R").format(_NAMES.replace("3. ", c), who)) for a, b, c in (("1. ", "2. ", "3. "), ("", "", "")) for who in ("HOLDER", "OWNER")],
    ("ISC", TEXTS["ISC"].replace("and/or distribute", "and distribute")),
]
# SHA-256 of the canonical texts (without statements of copyright) of long public licences as their publishers
# wrap them, whole and, where they end with advice on how to apply them, without that.
LONG: list[tuple[str, str]] = [
    ("Apache-2.0", "ef9aa6097e8b8724e8bedf9a9a264cbc3142b55ef97f3c3f079b7aa1aeac425c"),
    ("Apache-2.0", "ed44d69699f98d45c0c3e52ef4574fb05d6045eb6e2cd0e5e3810f6177e87f84"),
    ("Artistic-1.0", "d1ce9579b2c8d32b706b421d9c42208152298e00849e57ce7da8e906ed3802f2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "f6eaf8069e6992495ee63002d3cf837d745ad9c33d0c2129f4dd67750ebe0094"),
    ("GPL-3.0", "7e1ec759902e79fd98df32aeafb56e0fcc9348cebf7b52c7a875052ac012ad4a"),
    ("LGPL-2.0", "9645df35bc8e107839fb024e61e6728ee32745a72194667211f31f7bad57b7d8"),
    ("LGPL-2.0", "5b76795361ffca92776bfb6f87f31cc8c230526d08f639d965de248bd171ca59"),
    ("LGPL-2.1", "a5875b4abd0df481e41a66665de9bea2d629872285f8f890c7ff03f4f87cb0ef"),
    ("LGPL-2.1", "e8fff5aab68f3784c88bdf6c7d677d555dbfc3274d7e0a03da4870604bf989ed"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
]
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("Expat License", "The Expat License", "MIT/Expat License", "The MIT License (Expat)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "Zero Clause BSD License (0BSD)", "BSD Zero Clause License (0BSD)"),
    "Zlib": ("The zlib/libpng License", "zlib/libpng License", "The zlib/libpng License (Zlib)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License"),
}


def canonical(text: str, copyright_lines: str = COPYRIGHT) -> str:
    """Lower case, without copyright lines and punctuation, one spelling for each word."""
    text = re.sub(copyright_lines, "\n", text.lower())
    for a, b in SPELLINGS:
        text = text.replace(a, b)
    return re.sub(MARKS, " ", text).strip(" ")


def _canonical_lines(text: F.Column, copyright_lines: str = COPYRIGHT) -> F.Column:
    """The canonical text of each line; null is empty."""
    text = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), copyright_lines, "\n")
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.transform(F.split(F.regexp_replace(text, MARKS_OF_LINES, " "), "\n"), lambda x: F.trim(x))


def _plain(text: F.Column) -> F.Column:
    """Text without characters of no width, with spaces for typeset marks and spaces."""
    return F.regexp_replace(F.regexp_replace(text, WIDTHLESS, ""), TYPESET, " ")


def _as_one(lines: F.Column) -> F.Column:
    """The canonical text of the whole, from that of its lines."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known_digests(texts: Mapping[str, str] = TEXTS, notices: Mapping[str, str] = NOTICES) -> list[tuple[str, str]]:
    """(digest, licence) of all known texts and notices."""
    both = [(text, name) for name, text in texts.items()] + list(notices.items())
    return sorted({(hashlib.sha256(canonical(text).encode()).hexdigest(), name) for text, name in both})


def whole_digests(texts: Mapping[str, str] = TEXTS, notices: Mapping[str, str] = NOTICES) -> list[tuple[str, str]]:
    """(digest, licence) of what a whole text can be: all known texts, the further ones, both with titles too, and notices."""
    found = dict(known_digests(texts, notices))
    for name, text in [*texts.items(), *FURTHER]:
        for title in ("", name, f"{name} License", f"The {name} License", f"{name} License ({name})", f"The {name} License ({name})", *TITLES.get(name, ())):
            found.setdefault(hashlib.sha256(canonical(f"{title}\n{text}", STATEMENT).encode()).hexdigest(), name)
    for name, digest in LONG:
        found.setdefault(digest, name)
    return sorted(found.items())


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: Mapping[str, str] = TEXTS, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """(doc_id, canonical_sha256, license, line_licenses, n_license_lines) for every row of ``docs``.

    ``license`` is the licence whose canonical text the whole text is, with or without a title, or is once only
    copyright statements are removed, not body lines that begin with that word; else null.  Typeset quotes, dashes and
    spaces, soft hyphens and byte order marks count as punctuation for licences and lines, not in ``canonical_sha256``.
    A line that is a known notice or text in whole counts in n_license_lines; line_licenses
    lists their licences, distinct and sorted, joined by commas.  The SQL looks only at lines that
    hold "licen", and knows neither titles, wrapped body lines nor typeset marks; where none of these matters both agree.

    Null text counts as empty and is no licence.  Null ids and repeated rows are
    reported like any other.  An empty table gives an empty result.  Other columns are
    ignored.  Digests of known texts are a fixed table of a few rows, so it is broadcast.
    """
    work = Work(docs.sparkSession, "licenses")
    known, wholes = known_digests(texts, notices), whole_digests(texts, notices)
    # only lines as long as a known text are hashed, and only known digests are kept
    sizes = sorted({len(canonical(t)) for t in [*texts.values(), *notices]} - {0})
    digests = [digest for digest, _ in known]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), _canonical_lines(text).alias("own"), text.rlike(EITHER).alias("typeset"))
    typeset = F.col("typeset")
    lines = lines.withColumn("lines", F.when(typeset, _canonical_lines(_plain(F.col("text")))).otherwise(F.col("own")))
    digest = F.sha2(_as_one(F.col("own")), 256)
    fine = F.when(F.lower("text").rlike(BODY) | typeset, F.sha2(_as_one(_canonical_lines(_plain(F.col("text")), STATEMENT)), 256))
    rows = work.keep(
        lines.select(
            "uid",
            "doc_id",
            digest.alias("canonical_sha256"),
            fine.alias("fine"),
            F.filter(F.transform(F.filter("lines", lambda x: F.length(x).isin(sizes)), lambda x: F.sha2(x, 256)), lambda x: x.isin(digests)).alias("lines"),
        ),
        "digests",
    )
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(known, "digest string, license string"))
    found = rows.select("uid", F.explode("lines").alias("digest")).join(table, "digest")
    found = found.groupBy("uid").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"), F.count("*").alias("n"))
    first = F.broadcast(spark.createDataFrame(wholes, "first string, license string"))
    second = F.broadcast(spark.createDataFrame(wholes, "second string, fine_license string"))
    whole = rows.drop("lines").join(first, F.col("canonical_sha256") == F.col("first"), "left").join(second, F.col("fine") == F.col("second"), "left")
    return whole.join(found, "uid", "left").select(
        "doc_id", "canonical_sha256", F.coalesce("license", "fine_license").alias("license"), F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines")
    )


def oracle() -> str:
    """The same as SQL."""

    def canon(text: str) -> str:
        text = f"regexp_replace(lower({text}), '{COPYRIGHT}', chr(10), 'g')"
        for a, b in SPELLINGS:
            text = f"replace({text}, '{a}', '{b}')"
        return f"trim(regexp_replace({text}, '{MARKS}', ' ', 'g'), ' ')"

    quoted = ", ".join("('{}', '{}')".format(text.replace("'", "''"), name) for text, name in [*((t, n) for n, t in TEXTS.items()), *NOTICES.items()])
    return f"""
        WITH listed(text, license) AS (VALUES {quoted}),
        known AS (SELECT DISTINCT sha256({canon("text")}) AS digest, license FROM listed),
        d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
        found AS (
            SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS names, count(*) AS n
            FROM (SELECT doc_id, sha256({canon("line")}) AS digest FROM lines WHERE contains(lower(line), 'licen')) JOIN known USING (digest) GROUP BY doc_id)
        SELECT w.doc_id, w.canonical_sha256, k.license, coalesce(f.names, '') AS line_licenses, coalesce(f.n, 0) AS n_license_lines
        FROM (SELECT doc_id, sha256({canon("text")}) AS canonical_sha256 FROM d) w
        LEFT JOIN known k ON k.digest = w.canonical_sha256 LEFT JOIN found f ON f.doc_id = w.doc_id
    """
