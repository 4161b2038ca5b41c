"""Licence scan by canonical digests, in DataFrame operations only.

A text is brought to a canonical form: lower case, copyright lines dropped, equivalent
spellings replaced, everything but letters and digits to single spaces. The SHA-256 of an
entire text's form is looked up among the digests of the known licences, which went through
the same function. Each line of a document is looked up as an entire text of its own as well, among
the known notices, so that a licence notice at the end of an article is found.

The known digests are a table given as a parameter; the joins broadcast it
if it has at most KNOWN_MOST rows and is left to the planner beyond that.

Defined results: a null text is an empty one; texts without a letter or digit outside copyright
lines have a null digest and match nothing; rows of one id share the notices found in any of
them, as do rows without an id; an empty table gives an empty result; further columns are ignored.

A copyright line is one that begins with the word, (c) or the sign, unless licence wording follows
the word: where a licence's text is wrapped, its lines can begin with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KNOWN_MOST = 10_000

#: Spellings that mean the same in a licence.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("favour", "favor"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("http", "https"))

#: The wording of public licences and of usual notices.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("LicenseRef-reserved", "All rights reserved."),
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSD-2-Clause", f"""{_BSD_START}

{_BSD_TWO}

{_BSD_END}"""),
    ("BSD-3-Clause", f"""{_BSD_START}

{_BSD_TWO}

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

{_BSD_END}"""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
)

#: Titles that stand above a licence's text in its published file.
TITLES = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("ISC", "ISC License"),
    ("ISC", "The ISC License"),
    ("0BSD", "BSD Zero Clause License"),
    ("0BSD", "Zero-Clause BSD"),
    ("Zlib", "zlib License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Simplified BSD License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "New BSD License"),
    ("Unlicense", "The Unlicense"),
)
#: A line that begins like a copyright line, and wording of a licence that lines can begin with as well.
_COPYRIGHT = r"(?i)^[^\p{L}\p{N}]*(copyright\b|\(c\)|\x{A9})"
_WORDING = r"(?i)^[^\p{L}\p{N}]*copyright\W+(notice|holders?|owners?|statement|licen[cs]e|laws?|and related|in the|disclaimer|interest)\b"


def canonical(text: Column) -> Column:
    """The canonical form; null if nothing is left."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(_COPYRIGHT) | x.rlike(_WORDING))
    out = F.lower(F.when(text.rlike(r"(?i)copyright|\(c\)|\x{A9}"), F.array_join(lines, "\n")).otherwise(text))
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.nullif(F.trim(out), F.lit(""))


def published() -> tuple[tuple[str, str], ...]:
    """All known (licence, text): notices, licences, and licences below each of their titles."""
    return (*NOTICES, *TEXTS, *((name, f"{title}\n\n{text}") for name, title in TITLES for own, text in TEXTS if own == name))


def known_digests(spark: SparkSession, texts: tuple | None = None) -> DataFrame:
    """(digest, licence): one row for each canonical form; of several names the first in order."""
    table = spark.createDataFrame(list(texts if texts is not None else published()), "licence string, text string")
    return table.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "licence").where("digest IS NOT NULL").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, digest, licence, n_notices, notices.

    ``licence``: that of the entire text; ``n_notices``: lines that are a known text entirely;
    ``notices``: their licences, sorted, each once, joined by a comma.
    """
    known = F.broadcast(known) if known.limit(KNOWN_MOST + 1).count() <= KNOWN_MOST else known
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    whole = base.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(known, "digest", "left")
    lines = base.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    # Never null: else the plan tests the digest for null before it computes it again for the join.
    found = lines.select("doc_id", F.coalesce(F.sha2(canonical(F.col("line")), 256), F.lit("")).alias("digest")).join(known, "digest")
    notices = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    found_id = notices.withColumnRenamed("doc_id", "found_id")
    return whole.join(found_id, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select("doc_id", "digest", "licence", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), "notices")


def op2_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licence digest and what is known by it and by its lines."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_digests(spark))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    of = lambda p: _quoted(p.replace("\\x{A9}", "©"))
    kept = f"list_filter(string_split({text}, chr(10)), lambda x: NOT regexp_matches(x, {of(_COPYRIGHT)}) OR regexp_matches(x, {of(_WORDING)}))"
    out = f"lower(array_to_string({kept}, chr(10)))"
    out = f"' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"nullif(trim({out}), '')"


ORACLE = f"""
WITH known AS (
  SELECT sha256(c) AS digest, min(licence) AS licence
  FROM (SELECT licence, {_canonical_sql("t")} AS c FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in published())}) AS k(licence, t))
  WHERE c IS NOT NULL GROUP BY ALL),
whole AS (SELECT doc_id, sha256({_canonical_sql("coalesce(text, '')")}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
found AS (SELECT doc_id, licence FROM (SELECT doc_id, sha256({_canonical_sql("line")}) AS digest FROM lines) l JOIN known USING (digest)),
notices AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM found GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.licence, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, notices
FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN notices n ON w.doc_id = n.doc_id
"""

QUERIES = {"op2_licence_digests": op2_licence_digests}
ORACLES = {"op2_licence_digests": ORACLE}
