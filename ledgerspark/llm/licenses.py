"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

A document is compared in units: each line, each block of several lines (blocks end at blank lines), and the whole text
if it has several blocks. A unit's words are its runs of ASCII letters and digits in lower case; its bigrams are the set
of adjacent word pairs. With a and b bigrams, Dice is at most 2*min(a, b)/(a + b), so a template can only reach the
threshold t if b lies in [a*t/(2-t), a*(2-t)/t]; other templates are pruned before any intersection. By the same bound a match
shares at least b*t/(2-t) of a template's b bigrams, so a text without any of the template's telling words (chosen such that
fewer bigrams than that remain without them) is passed over before it is cut into units. The templates are a fixed, small
array literal: there is no join and no shuffle, and rows are independent.

Defined results: null and empty texts, and units of under two words, match nothing; every template at or above the
threshold is reported, so ties give one row each; repeated rows give repeated matches; texts are scanned whole.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Parts of public licences.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction, including without'
    " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
    " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
    " conditions: The above copyright notice and this permission notice shall be included in all copies or"
    " substantial portions of the Software."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list"
    " of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
    " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided"
    " with the distribution."
)
_BSD_NAMES = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
    " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Public licence notices and whole texts of short licences.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        ' an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for'
        " the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause line": "Licensed under the BSD 2-Clause License.",
    "BSD-2-Clause text": _BSD_TERMS + _BSD_WARRANTY,
    "BSD-3-Clause line": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause text": _BSD_TERMS + _BSD_NAMES + _BSD_WARRANTY,
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related rights.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "ISC": _ISC_GRANT,
    "ISC text": (
        _ISC_GRANT + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE'
        " INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
        " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER"
        " IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
        " PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT line": "Released under the MIT License.",
    "MIT": _MIT_GRANT,
    "MIT text": (
        _MIT_GRANT + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT'
        " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
        " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT"
        " OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable"
        " for any damages arising from the use of this software. Permission is granted to anyone to use this software for any"
        " purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following"
        " restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original"
        " software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but"
        " is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the"
        " original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}

WORD = "[A-Za-z0-9]+"
_COMMON = {"a", "an", "and", "any", "by", "for", "in", "is", "of", "or", "the", "this", "to", "with"}
BLOCK_END = r"\n[ \t\r]*\n"


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def bigrams(word_array: Column) -> Column:
    """The distinct adjacent pairs, each as 'first second'."""
    pairs = F.zip_with(
        F.slice(word_array, F.lit(1), F.size(word_array) - 1),
        F.slice(word_array, F.lit(2), F.size(word_array) - 1),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.when(F.size(word_array) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def template_bigrams(text: str) -> list[str]:
    import re

    found = [w.lower() for w in re.findall(WORD, text)]
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:], strict=False)})


def telling_words(templates: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which every matching unit holds one, as parts of its lower-case text: long ones first, as few as will do."""
    chosen: set[str] = set()
    for pairs in templates.values():
        needed = len(pairs) * threshold / (2 - threshold) - 1e-9
        left = [p.split(" ") for p in pairs]
        for word in sorted({w for p in left for w in p}, key=lambda w: (w not in chosen, -len(w), w in _COMMON, w)):
            if len(left) < needed:
                break
            chosen.add(word)
            left = [p for p in left if word not in p]
    return sorted(w for w in chosen if not any(len(o) > 3 and o != w and o in w for o in chosen))


def license_matches(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, unit (line, block, text), unit_no (from 0), unit_text, license_id, dice, shared, unit_bigrams."""
    known = {k: template_bigrams(v) for k, v in (templates or TEMPLATES).items()}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [len(b) for b in known.values()]
    table = F.array(
        *[
            F.struct(
                F.lit(k).alias("license_id"),
                F.lit(len(b)).alias("n"),
                F.array(*map(F.lit, b)).cast("array<string>").alias("bigrams"),
            )
            for k, b in sorted(known.items())
        ]
    )
    text = F.col("text")
    numbered = lambda kind, parts, when: F.transform(
        F.filter(F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("unit_no"), x.alias("unit_text"))), lambda u: when(u["unit_text"])),
        lambda u: u,
    )
    blocks = F.split(text, BLOCK_END)
    units = F.concat(
        numbered("line", F.split(text, "\n"), lambda x: F.length(x) > 0),
        numbered("block", blocks, lambda x: x.contains("\n")),
        numbered("text", F.array(text), lambda x: x.rlike(BLOCK_END)),
    )
    # A unit of w words has at most w - 1 bigrams and repeats can only lower that, so only the lower bound prunes by words.
    telling = telling_words(known, threshold)

    def told(x: Column) -> Column:
        long = [F.lower(x).contains(w) for w in telling if len(w) > 3]
        short = [w for w in telling if len(w) <= 3]
        return reduce(or_, long + ([x.rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(short)})(?![a-z0-9])")] if short else []))

    found = (
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
        .where(told(text))
        .select("doc_id", F.explode(units).alias("u"))
        .select("doc_id", "u.*")
        .where(told(F.col("unit_text")))
        .where(F.regexp_count("unit_text", F.lit(WORD)) > min(sizes) * low)
        .withColumn("found", bigrams(words(F.col("unit_text"))))
        .withColumn("unit_bigrams", F.size("found"))
        .where(F.col("unit_bigrams").between(min(sizes) * low - 1e-9, max(sizes) * high + 1e-9))
    )
    n = F.col("unit_bigrams")
    in_bounds = F.filter(table, lambda t: (t["n"] >= n * low - 1e-9) & (t["n"] <= n * high + 1e-9))
    scored = F.transform(
        in_bounds,
        lambda t: F.struct(
            t["license_id"].alias("license_id"), t["n"].alias("n"), F.size(F.array_intersect("found", t["bigrams"])).alias("shared")
        ),
    )
    dice = F.lit(2.0) * F.col("m.shared") / (n + F.col("m.n"))
    return (
        found.select("doc_id", "unit", "unit_no", "unit_text", "unit_bigrams", F.explode(scored).alias("m"))
        .where(dice >= threshold)
        .select("doc_id", "unit", "unit_no", "unit_text", "m.license_id", dice.alias("dice"), "m.shared", "unit_bigrams")
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    values = ", ".join(
        f"('{k}', {len(b)}, ['" + "', '".join(b) + "'])" for k, b in sorted((k, template_bigrams(v)) for k, v in TEMPLATES.items())
    )
    return rf"""
WITH templates(license_id, n, bigrams) AS (VALUES {values}),
blocks AS (SELECT doc_id, text, regexp_split_to_array(text, '\n[ \t\r]*\n') AS parts FROM documents WHERE text IS NOT NULL),
units AS (
    SELECT doc_id, 'line' AS unit, unnest(string_split(text, chr(10))) AS unit_text,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit_no FROM blocks
    UNION ALL
    SELECT * FROM (SELECT doc_id, 'block' AS unit, unnest(parts) AS unit_text, generate_subscripts(parts, 1) - 1 AS unit_no FROM blocks)
    WHERE contains(unit_text, chr(10))
    UNION ALL
    SELECT doc_id, 'text', text, 0 FROM blocks WHERE len(parts) > 1
),
worded AS (SELECT *, list_transform(regexp_extract_all(unit_text, '[A-Za-z0-9]+'), lambda w: lower(w)) AS w FROM units),
paired AS (
    SELECT doc_id, unit, unit_no, unit_text,
           list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS found FROM worded WHERE len(w) > 1
),
scored AS (
    SELECT p.*, license_id, n, len(list_intersect(found, bigrams)) AS shared FROM paired p JOIN templates ON true
)
SELECT doc_id, unit, CAST(unit_no AS INTEGER) AS unit_no, unit_text, license_id,
       CAST(2.0 * shared AS DOUBLE) / (len(found) + n) AS dice, CAST(shared AS INTEGER) AS shared,
       CAST(len(found) AS INTEGER) AS unit_bigrams
FROM scored WHERE CAST(2.0 * shared AS DOUBLE) / (len(found) + n) >= {threshold}
"""
