"""Licence scan: text compared with licence texts and notices by the Dice coefficient of word bigrams, in DataFrame expressions."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.session import documents, unused_names

#: Dice coefficient from which a unit of text is taken for a part of a licence, as a fraction.
DICE = (4, 5)
#: Words from which a sentence of a longer text is a template by itself.
SENTENCE_WORDS = 10

#: Licence texts, their headers for files, and notices in public use, by SPDX identifier or a name where there is none.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ],
    "LGPL-3.0": [
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.""",
    ],
    "AGPL-3.0": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "all-rights-reserved": ["All rights reserved."],
}


def _words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


@cache
def template_bigrams() -> list[tuple[str, list[str]]]:
    """(licence, distinct word bigrams) of each template: a text as a whole, its paragraphs, and its sentences that are long enough."""
    out: dict[tuple, None] = {}
    for name, texts in TEMPLATES.items():
        for text in texts:
            blocks = text.split("\n\n")
            sentences = [x for b in blocks for x in re.split(r"(?<=[.!?;])[ \t]+", b)]
            for part in [text, *(x for x in [*blocks, *sentences] if len(_words(x)) >= SENTENCE_WORDS)]:
                w = _words(part)
                out[name, tuple(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))] = None
    return [(name, list(grams)) for name, grams in out]


@cache
def anchor_words() -> list[str]:
    """Words of which any unit that reaches the coefficient with some template has one.

    A unit has at least share = dice / (2 - dice) of the template's bigrams. Words are chosen, long ones in many templates first, as few other texts have them,
    until less than that is left of each template without them.
    """
    share = DICE[0] / (2 * DICE[1] - DICE[0])
    templates = [set(b) for _, b in template_bigrams()]
    common = {"the", "of", "is", "to", "and", "this", "under", "in", "it", "or", "a", "be", "by", "you", "may", "with", "any", "that", "are", "all", "as", "at", "for", "not", "can", "use", "work", "has", "if"}

    def uncovered(words: list[str]) -> list[set[str]]:
        """What is left of the templates of which too much is left without the words, or words that have one of them in."""
        rest = [({x for x in b if not any(w in y for w in words for y in x.split())}, share * len(b)) for b in templates]
        return [b for b, need in rest if len(b) >= need]

    chosen: list[str] = []
    while open_ := uncovered(chosen):
        votes: dict[str, int] = {}
        for b in open_:
            words = {w for x in b for w in x.split()}
            for w in {w for w in words if len(w) > 1} - common or words:
                votes[w] = votes.get(w, 0) + 1
        chosen.append(min(votes, key=lambda w: (-votes[w] * len(w) ** 3, w)))
    for w in list(chosen):
        fewer = [x for x in chosen if x != w]
        if not uncovered(fewer):
            chosen = fewer
    return chosen


def _bigrams(unit: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b)))


#: What parts blocks: line ends with neither a letter nor a digit of ASCII between them, as the empty lines of a comment have.
_BLOCK_END = "\n[^A-Za-z0-9]*\n"


def scan_licenses(docs: DataFrame, anchored: bool = True) -> DataFrame:
    """``docs`` with n_matches, licenses (names found, ascending), best_license and best_dice (0 to 1) for ``text``.

    Units are the text as a whole, its lines, its blocks (what stands between empty lines, or lines of marks only) and the sentences of lines and
    of blocks, however their lines are wrapped. A unit is normalised to lower-case words of a-z and
    0-9 and compared with every template whose number of bigrams b lets the coefficient be reached: a * d / (2 - d) <= b <= a * (2 - d) / d for the
    a of the unit and the least coefficient d. Texts and units with none of the anchor words (see anchor_words) cannot reach it
    and are passed over; ``anchored=False`` compares them all the same, with the same result. n_matches counts different units that reach it.

    best_license is the name of greatest coefficient, of equal ones the least name, null if none is found; best_dice is then 0. Nulls: a null or
    empty text has no units. Repeated rows are scanned each; new columns replace those of the same names, others stay. An
    empty table gives an empty table.
    """
    made = ["n_matches", "licenses", "best_license", "best_dice"]
    d = docs.drop(*made)
    low, units, grams, hits = unused_names(d, "low", "units", "grams", "hits")
    text = F.coalesce("text", F.lit(""))
    num, den = DICE

    def has_anchor(low: Column) -> Column:
        found = F.lit(not anchored)
        for word in anchor_words():
            found |= F.contains(low, F.lit(word))
        return found

    split = lambda t: F.split(F.regexp_replace(t, "([.!?;])[ \t]+", "$1\n"), "\n")
    blocks = F.transform(F.split(text, _BLOCK_END), lambda b: F.translate(b, "\n", " "))
    all_ = F.concat(F.array(text), F.split(text, "\n"), split(text), blocks, F.flatten(F.transform(blocks, split)))
    d = d.withColumn(low, F.lower(text))  # a column of its own, so that it is made once and not for each word
    d = d.withColumn(units, F.when(has_anchor(F.col(low)), F.array_distinct(F.filter(all_, lambda u: has_anchor(F.lower(u))))))
    d = d.withColumn(grams, F.filter(F.transform(units, _bigrams), lambda g: F.size(g) > 0))
    templates = F.array(*(F.struct(F.lit(name).alias("l"), F.array(*map(F.lit, b)).alias("g")) for name, b in template_bigrams()))

    def reached(g: Column) -> Column:
        """(-coefficient, licence) of the templates that a unit is like."""
        fits = lambda t: (F.size(g) * num <= F.size(t["g"]) * (2 * den - num)) & (F.size(t["g"]) * num <= F.size(g) * (2 * den - num))
        dice = lambda t: F.size(F.array_intersect(g, t["g"])) * F.lit(2.0) / (F.size(g) + F.size(t["g"]))
        return F.filter(F.transform(F.filter(templates, fits), lambda t: F.struct((-dice(t)).alias("d"), t["l"].alias("l"))), lambda h: h["d"] <= -num / den)

    d = d.withColumn(hits, F.filter(F.transform(grams, reached), lambda h: F.size(h) > 0))
    n = F.greatest(F.coalesce(F.size(hits), F.lit(0)), F.lit(0)).cast("long")
    d = d.withColumn("n_matches", n).withColumn(hits, F.array_sort(F.flatten(hits)))
    first = F.get(hits, F.lit(0))
    return d.withColumns(
        {
            "licenses": F.coalesce(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["l"]))), F.array().cast("array<string>")),
            "best_license": first["l"],
            "best_dice": F.round(F.coalesce(-first["d"], F.lit(0.0)), 6),
        }
    ).drop(low, units, grams, hits)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence notices."""
    found = scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_matches", F.array_join("licenses", ",").alias("licenses"), "best_license", "best_dice")


def sql_op5() -> str:
    """DuckDB SQL for the same rows, without anchors: every unit is compared."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    num, den = DICE
    templates = ", ".join(f"({i}, {quote(n)}, [{', '.join(map(quote, b))}])" for i, (n, b) in enumerate(template_bigrams()))
    return f"""
WITH templates(i, name, grams) AS (VALUES {templates}),
blocks AS (SELECT doc_id, text, list_transform(string_split(regexp_replace(text, '\\n[^A-Za-z0-9]*\\n', chr(1), 'g'), chr(1)), lambda x: replace(x, chr(10), ' ')) AS bs FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, unnest(list_distinct(list_concat([text], string_split(text, chr(10)), string_split(regexp_replace(text, '([.!?;])[ \t]+', '\\1' || chr(10), 'g'), chr(10)), bs,
    flatten(list_transform(bs, lambda x: string_split(regexp_replace(x, '([.!?;])[ \t]+', '\\1' || chr(10), 'g'), chr(10))))))) AS u FROM blocks),
words AS (SELECT doc_id, u, list_filter(string_split(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM units),
grams AS (SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM words WHERE len(w) > 1),
met AS (
  SELECT doc_id, u, name, len(list_intersect(g, grams)) * 2.0::DOUBLE / (len(g) + len(grams)) AS dice FROM grams JOIN templates
  ON len(g) * {num} <= len(grams) * {2 * den - num} AND len(grams) * {num} <= len(g) * {2 * den - num}),
reached AS (SELECT * FROM met WHERE dice >= {num / den}::DOUBLE),
named AS (SELECT doc_id, count(DISTINCT u) AS n, max(dice) AS dice FROM reached GROUP BY doc_id),
listed AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses FROM (SELECT DISTINCT doc_id, name FROM reached) GROUP BY doc_id),
top AS (SELECT r.doc_id, min(r.name) AS name FROM reached r JOIN named n ON r.doc_id = n.doc_id AND r.dice = n.dice GROUP BY r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_matches, coalesce(l.licenses, '') AS licenses, t.name AS best_license, round(coalesce(n.dice, 0.0), 6)::DOUBLE AS best_dice
FROM documents d LEFT JOIN named n USING (doc_id) LEFT JOIN listed l USING (doc_id) LEFT JOIN top t USING (doc_id)
"""
