"""License scans: canonical digest lookup (operator 1), built-in functions only.

A text's canonical form: A-Z lowered, typographic quotes and dashes taken as punctuation, runs of white
space and ASCII punctuation as one space within a line, spellings of one word made equal, lines
that only state a copyright dropped, the other lines joined by one space. The SHA-256 of that is
hash-joined with the digests of known licences; the list is fixed in this module (no more than 200
rows), so it is broadcast. Each line's own digest is looked up in the same way, which finds notices
such as "Released under the MIT License.".

Cases: a null text is empty; an empty text has the digest of '' and no licence; very long texts are taken
whole; repeated rows give repeated results; null ids stay null; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Spellings that licence texts use for one word, the second being canonical.
SPELLINGS = (
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("colour", "color"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("merchantibility", "merchantability"), ("modelling", "modeling"), ("organisation", "organization"),
    ("programme ", "program "), ("recognise", "recognize"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("non commercial", "noncommercial"), ("per cent", "percent"), ("https", "http"),
)

# Texts of licences, without their copyright lines.
TEXTS = {
    "MIT": """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """BSD Zero Clause License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

# Titles that stand above texts kept without one.
TITLES = {
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
}

# Digests of canonical long texts (whole, as published).
DIGESTS = {
    "Apache-2.0": "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
}

# Lines by which a text states its licence.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Typographic marks and what they count as; the copyright sign counts as the letter it is written with.
MARKS, PLAIN = "‘’“”–—«» ©", "''\"\"--\"\" c"
#: Everything in ASCII that is no letter, digit or end of line.
BETWEEN = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Lines that state a copyright: with a year, the sign or a holder; not running text that a wrap begins with the word.
COPYRIGHT = (
    "^(c )?copyright (.* )?[0-9]{4}( |$)|^copyright c( |$)|^c copyright( |$)|^copyright (by|the) .|^copyright .*(inc|ltd|llc|gmbh|corp|corporation|foundation|authors|contributors)( all rights reserved)?$"
    "|^c [0-9]{4}( |$)|^all rights reserved( |$)"
)


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that are not empty and do not only state a copyright."""
    t = F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + MARKS, LOWER + PLAIN), BETWEEN, " ")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def canonical(text: str) -> str:
    """The same for one known text, where the list of digests is made."""
    t = re.sub(BETWEEN, " ", text.translate(str.maketrans(UPPER + MARKS, LOWER + PLAIN)))
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    lines = [x.strip(" ") for x in t.split("\n")]
    return " ".join(x for x in lines if x and not re.search(COPYRIGHT, x))


def known() -> list[tuple[str, str]]:
    """(digest, licence) of each known text and notice; a text is known with and without its title line."""
    forms = [(n, t) for n, t in TEXTS.items()] + [(n, t.split("\n", 1)[1]) for n, t in TEXTS.items() if len(t.split("\n", 1)[0]) < 40]
    forms += [(n, f"The {t}") for n, t in TEXTS.items() if len(t.split("\n", 1)[0]) < 40] + [("MIT", "The MIT License (MIT)\n" + TEXTS["MIT"].split("\n", 1)[1])]
    forms += [(n, f"{title}\n{TEXTS[n]}") for n, titles in TITLES.items() for title in titles]
    forms += [(n, t) for n, ts in NOTICES.items() for t in ts]
    return sorted(({hashlib.sha256(canonical(t).encode()).hexdigest(): n for n, t in forms} | {d: n for n, d in DIGESTS.items()}).items())


def values() -> str:
    return ", ".join(f"('{d}', '{n}')" for d, n in known())


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the whole canonical text, its licence or null, number of notice lines and their licences."""
    spark = docs.sparkSession
    lookup = F.create_map(*[F.lit(x) for pair in known() for x in pair])
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    named = F.filter(F.transform("lines", lambda x: F.element_at(lookup, F.sha2(x, 256))), lambda x: x.isNotNull())
    found = lines.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("digest"), named.alias("named"))
    texts = spark.sql(f"SELECT * FROM VALUES {values()} AS known(digest, license)")
    return found.join(F.broadcast(texts), "digest", "left").select(
        "doc_id", "digest", "license", F.size("named").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("named")), ",").alias("notices"))


def licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"regexp_replace(translate(coalesce(text, ''), {quote(UPPER + MARKS)}, {quote(LOWER + PLAIN)}), {quote(BETWEEN)}, ' ', 'g')"
    for a, b in SPELLINGS:
        t = f"replace({t}, {quote(a)}, {quote(b)})"
    return f"""
WITH known(digest, license) AS (VALUES {values()}),
m AS (SELECT map(list(digest), list(license)) AS names FROM known),
l AS (SELECT doc_id, list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, {quote(COPYRIGHT)})) AS lines FROM documents),
n AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS digest,
        list_filter(list_transform(lines, lambda x: names[sha256(x)]), lambda x: x IS NOT NULL) AS named FROM l, m)
SELECT doc_id, n.digest, license, len(named)::BIGINT AS n_notices, coalesce(array_to_string(list_sort(list_distinct(named)), ','), '') AS notices
FROM n LEFT JOIN known USING (digest)"""


ORACLE = _sql()
