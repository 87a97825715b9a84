r"""Licence lookup by canonical digests.

A text is brought to a canonical form: lower case, copyright statements dropped, equivalent spellings made one, punctuation
and white space one space.  The SHA-256 of the form of a whole text, and of each of its lines, is looked up among the
digests of known licences and notices by a hash join.  Only complete texts and complete lines match.

A copyright statement starts a line and has the word with the sign, or the word or sign with a year: "(c) You must ..."
is a clause and stays.  A whole text is looked up twice, without the lines of its statements and without the statements
alone (up to the end of their sentence), so a notice behind a statement on its line is found too.

Defined cases: null and empty texts match nothing; rows that share an id count as one document; a licence that is known
twice is reported under each of its ids; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as one, by regular expression (on lower-case text), in order.
SPELLINGS = (
    (r"https?://", " "),
    (r"&", " and "),
    (r"\blicence", "license"),
    (r"\bsub-licen[cs]e", "sublicense"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bauthoris", "authoriz"),
    (r"\borganis", "organiz"),
    (r"\bfavour", "favor"),
    (r"\bwhilst\b", "while"),
    (r"\bnon-commercial", "noncommercial"),
    (r"\bper cent\b", "percent"),
    (r"\bversion ([0-9])", r"v\1"),
    (r"\bv\.? ?([0-9])", r"v\1"),
)
#: Registries that need no more words than this are searched only in texts that hold one of them (see ``anchors``).
MOST_ANCHORS = 64
#: What the spellings make of words.
_MADE = ("and", "license", "acknowledgment", "authoriz", "organiz", "favor", "while", "noncommercial", "percent")
#: How a copyright statement starts, in lower case.
_STATEMENT = r"[ \t#*/;-]*(?:copyright[ \t]*(?:©|\(c\))|(?:copyright|©|\(c\))[ \t,]*(?:by[ \t]+)?(?:19|20)[0-9]{2})"
#: Its whole line; the statement up to the end of its sentence; what often follows it.
COPYRIGHT_LINE = rf"(?dm)^{_STATEMENT}[^\n]*$"
COPYRIGHT_SENTENCE = rf"(?dm)^{_STATEMENT}[^\n.]*(?:\.[^ \t\n][^\n.]*)*(?:\.[ \t]+|\.?$)"
ALL_RIGHTS = r"(?dm)^[ \t#*/;-]*all rights reserved\.?[ \t]*$"

#: Notices by which texts say their licence in one sentence.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
}
#: Titles that may stand above a whole licence.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"),
    "Zlib": ("zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense",),
}
#: Whole licences.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
}
#: The three-clause text is the two-clause one with a clause more, before the last paragraph.
_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEXTS["BSD-3-Clause"] = "\n".join([*TEXTS["BSD-2-Clause"].split("\n")[:-1], _CLAUSE, TEXTS["BSD-2-Clause"].split("\n")[-1]])


def known(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """``(license_id, text)`` of the notices and licences above, the latter with and without a title.

    ``folder``: more licences, a text file each that is named by its id (``GPL-3.0-only.txt``); any table with the two
    columns can be searched for as well.
    """
    rows = [(k, t) for k, texts in NOTICES.items() for t in texts]
    rows += [(k, f"{title}\n{t}" if title else t) for k, t in TEXTS.items() for title in ("", *TITLES.get(k, ()))]
    found = spark.createDataFrame(rows, "license_id string, text string")
    if folder is None:
        return found
    files = spark.read.text(folder, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("license_id"), F.col("value").alias("text"))
    return found.union(files)


def _one_spelling(text: Column) -> Column:
    """From lower case without statements to the canonical form with its line breaks."""
    text = F.regexp_replace(text, ALL_RIGHTS, "")
    for pattern, one in SPELLINGS:
        text = F.regexp_replace(text, pattern, one.replace(r"\1", "$1"))
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " "), r" *\n[ \n]*", "\n")


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line breaks, without the lines of copyright statements."""
    return _one_spelling(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""))


def notice_lines(text: Column) -> Column:
    """The same without the statements alone; what follows them on their line stays."""
    return _one_spelling(F.regexp_replace(F.lower(text), COPYRIGHT_SENTENCE, " "))


def canonical(lines: Column) -> Column:
    return F.trim(F.translate(lines, "\n", " "))


def anchors(forms: list[str]) -> set[str]:
    """Words such that a text must hold one as it stands (in lower case) to have a form of these; empty if a form has none.

    A word of a form is a longest run of letters a to z.  Canonicalisation makes letters only by putting one of
    ``_MADE`` in; all else that it removes or replaces becomes white space or the end of a line, so it never joins what
    stood apart.  A run without any of ``_MADE`` therefore stands in the text itself, whatever the text.
    """
    found = set()
    for form in forms:
        own = [w for w in re.findall(r"[a-z]{4,}", form) if not any(x in w for x in _MADE)]
        if not own:
            return set()
        if not found.intersection(own):
            found.add(max(own, key=lambda w: (len(w), w)))
    return found


def units(text: Column) -> Column:
    """``array<struct<whole, u>>``: the forms of a text and of its lines."""
    plain, notices = canonical_lines(text), notice_lines(text)
    stated = F.lower(text).rlike(COPYRIGHT_LINE)
    lines = F.transform(F.split(F.when(stated, notices).otherwise(plain), "\n"), lambda x: F.struct(F.lit(False).alias("whole"), F.trim(x).alias("u")))
    whole = F.array(F.struct(F.lit(True).alias("whole"), canonical(plain).alias("u")))
    other = F.when(stated, F.array(F.struct(F.lit(True).alias("whole"), canonical(notices).alias("u"))))
    return F.concat(whole, F.coalesce(other, F.array().cast("array<struct<whole:boolean,u:string>>")), lines)


def scan(docs: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document and licence: ``whole`` (the text is the licence) and ``lines`` (lines that are a licence or notice)."""
    digest = F.sha2(canonical(canonical_lines(F.col("text"))), 256)
    registry = licences.select("license_id", digest.alias("digest")).distinct()
    # a bounded look: with more forms than this every text is searched, with the same result
    forms = [r[0] for r in licences.select(canonical(canonical_lines(F.col("text")))).distinct().limit(16 * MOST_ANCHORS + 1).collect()]
    held = sorted(anchors(forms)) if len(forms) <= 16 * MOST_ANCHORS else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    if 0 < len(held) <= MOST_ANCHORS:
        rows = rows.where(reduce(or_, [F.lower("text").contains(w) for w in held]))
    found = rows.select("id", F.explode(units(F.col("text"))).alias("x")).where("x.u <> ''")
    found = found.select("id", "x.whole", F.sha2(F.col("x.u"), 256).alias("digest")).join(registry, "digest")
    return found.groupBy("id", "license_id").agg(F.max("whole").alias("whole"), F.count_if(~F.col("whole")).alias("lines")).select(F.col("id").alias(id_col), "license_id", "whole", "lines")
