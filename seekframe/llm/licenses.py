"""License scans (5): diagonal voting between word k-grams of documents and of license templates.

1. A text is lower-cased (A-Z) and cut to words; all its rolling `GRAM`-word hashes are formed where it is read.
2. They are joined to (hash, template, position) of the templates. The hashes of the templates, a fixed list, are first
   applied as a filter, so that only matching positions leave the scan.
3. Matches are aggregated by (document, template, diagonal): diagonal = position in the text - position in the template.
4. Neighbouring diagonals (up to `DRIFT` words apart: words added or left out) that also adjoin in the text are merged
   to a span. A span is verified if it has at least `VOTES` matches (or all of a shorter template), covers enough of the
   template's words, densely, and holds the words that tell the template from its like: where a template has at most
   `TELLING` words that another one lacks, those.
5. Templates compete: of overlapping spans of different labels the one that covers most words stays, ties by its share of
   the template and then by name. A span that stays gives its template's label; its coverage is its score.

The phrases of `PHRASES` are looked up on their own and give their labels too (score 0.5 at least).

A null text has no words. Null ids are kept. Repeated rows are scanned once each. Very long texts are scanned whole; the
matches of one text are one row. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, prepare, saved, text_of

GRAM, DRIFT, GAP, VOTES, TELLING = 4, 6, 24, 3, 3
#: A verified span covers so much of its template, in so dense a stretch of text.
COVERS, DENSE = 0.4, 0.6
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Licenses, or the notices that they ask for. What follows a colon in a name tells templates of one label apart.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit:grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit:note": "Released under the MIT License.",
    "mit:file": "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache:note": "Licensed under the Apache License, Version 2.0.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "gpl:note": "This work is licensed under the GNU General Public License, version 3 or any later version.",
    "lgpl": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd:conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd:names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "isc:grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
    "cc-by:note": "Licensed under CC BY 4.0.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/.",
    "cc-by-sa:note": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/.",
    "cc-by-nc:note": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nd/4.0/.",
    "cc-by-nd:note": "Licensed under CC BY-ND 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is published under CC0 1.0 Universal, see http://creativecommons.org/publicdomain/zero/1.0/.",
}


def label_of(template: str) -> str:
    return template.split(":")[0]


def template_words(text: str) -> list[str]:
    return [x for x in re.split(NOT_WORD, text.lower()) if x]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(ascii_lower(text), NOT_WORD, " "), " "), lambda w: w != "")


def gram_hashes(words: Column, gram: int = GRAM) -> Column:
    """Hash of the gram at each word position that has one."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - gram + 1, F.lit(0)))
    return F.transform(starts, lambda _, i: F.xxhash64(F.slice(words, i + 1, gram)))


def template_grams(spark, templates: dict[str, str]) -> list[tuple[int, str, int]]:
    """(hash, template, position): a fixed list."""
    rows = spark.createDataFrame([(k, template_words(v)) for k, v in templates.items()], "template string, words array<string>").coalesce(1)
    return [tuple(r) for r in rows.select("template", F.posexplode(gram_hashes(F.col("words")))).select("col", "template", "pos").collect()]


def telling_places(templates: dict[str, str]) -> dict[str, set[int]]:
    """The places of each template's words that a template of another label, like it but for those, lacks."""
    words = {k: template_words(v) for k, v in templates.items()}
    out: dict[str, set[int]] = {k: set() for k in words}
    for k, own in words.items():
        for other in words:
            lacks = set(own) - set(words[other])
            if label_of(k) != label_of(other) and 0 < len(lacks) <= min(TELLING, len(set(own)) // 3):
                out[k].update(i for i, w in enumerate(own) if w in lacks)
    return out


def phrase_places(words: Column, phrase: str) -> Column:
    parts = phrase.split()

    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            found = found & (F.get(words, i + j) == part)
        return found

    return F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)


def spans_of(hits: list[tuple[int, int]]) -> list[dict]:
    """Matches (place in the text, diagonal) of one template -> its spans: those that adjoin on neighbouring diagonals."""
    held: list[dict] = []
    done: list[dict] = []
    for at, diagonal in sorted(hits):
        span = next((x for x in reversed(held) if abs(x["diagonal"] - diagonal) <= DRIFT), None)
        if span is None:
            span = {"text": set(), "own": set(), "votes": 0}
            held.append(span)
        span["diagonal"], span["last"] = diagonal, at
        span["votes"] += 1
        span["text"].update(range(at, at + GRAM))
        span["own"].update(range(at - diagonal, at - diagonal + GRAM))
        done += [x for x in held if at - x["last"] > GAP]
        held = [x for x in held if at - x["last"] <= GAP]
    return done + held


def verified(matches: dict[str, list[tuple[int, int]]], sizes: dict[str, int], telling: dict[str, set[int]]) -> list[tuple[str, int, int, float]]:
    """One text's matches by template -> (template, begin, finish, coverage) of the spans that are verified and win."""
    spans = []
    for template, hits in matches.items():
        size = sizes[template]
        for x in spans_of(hits):
            begin, finish, coverage = min(x["text"]), max(x["text"]) + 1, len(x["own"]) / size
            if x["votes"] >= min(VOTES, size - GRAM + 1) and coverage >= COVERS and len(x["text"]) / (finish - begin) >= DENSE and telling[template] <= x["own"]:
                spans.append((-len(x["own"]), -coverage, template, begin, finish))
    won: list[tuple[str, int, int, float]] = []
    for _, coverage, template, begin, finish in sorted(spans):
        if not any(label_of(t) != label_of(template) and begin < b and a < finish for t, a, b, _ in won):
            won.append((template, begin, finish, min(1.0, -coverage)))
    return won


def verifier(templates: dict[str, str]):
    sizes, telling = {k: len(template_words(v)) for k, v in templates.items()}, telling_places(templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, diagonals in zip(batch["row"].tolist(), batch["diagonals"]):
                matches: dict[str, list[tuple[int, int]]] = {}
                for x in diagonals:
                    matches.setdefault(x["template"], []).extend((int(p), int(x["diagonal"])) for p in x["places"])
                out += [(row, label_of(t), a, b, c) for t, a, b, c in verified(matches, sizes, telling)]
            yield pd.DataFrame(out, columns=["row", "label", "begin", "finish", "coverage"]).astype({"row": "int64", "begin": "int64", "finish": "int64", "coverage": "float64"})

    return run


def diagonal_votes(scanned: DataFrame, grams: list[tuple[int, str, int]]) -> DataFrame:
    """(row, template, diagonal, votes, places) of the matches of each document's grams with those of the templates."""
    known = scanned.sparkSession.createDataFrame(grams, "hash long, template string, own int")
    # a fixed list, so broadcasting it is bounded by the templates
    joined = scanned.select("row", F.inline("matches")).join(F.broadcast(known), "hash").withColumn("diagonal", F.col("at") - F.col("own"))
    return joined.groupBy("row", "template", "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.collect_list("at").alias("places"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scanned, spans). scanned: one row a document (row, doc_id, n_words, phrases: (label, place) of each phrase);
    spans: (row, label, begin, finish, coverage) of each verified span, in words. templates: name to text, names as in TEMPLATES."""
    spark, templates = prepare(docs.sparkSession), TEMPLATES if templates is None else templates
    grams = template_grams(spark, templates)
    hashes = sorted({h for h, _, _ in grams})
    rows = docs.select(F.col("doc_id").alias("id"), words_of(text_of()).alias("words"))
    labelled = lambda label: lambda i: F.struct(F.lit(label).alias("label"), i.alias("place"))
    places = []
    for phrase, label in PHRASES.items():
        first = phrase.split()[0]
        found = F.when((F.size("words") >= len(phrase.split())) & F.array_contains("words", first), F.transform(phrase_places(F.col("words"), phrase), labelled(label)))
        places.append(F.coalesce(found, F.array().cast("array<struct<label:string,place:int>>")))
    matches = F.filter(F.transform(gram_hashes(F.col("words")), lambda h, i: F.struct(i.alias("at"), h.alias("hash"))), lambda x: x["hash"].isin(hashes))
    scanned = rows.select(F.monotonically_increasing_id().alias("row"), "id", F.size("words").cast("long").alias("n_words"), F.concat(*places).alias("phrases"), matches.alias("matches"))
    scanned = saved(scanned, "scanned")
    votes = diagonal_votes(scanned, grams)
    spans = votes.groupBy("row").agg(F.collect_list(F.struct("template", "diagonal", "places")).alias("diagonals")).mapInPandas(verifier(templates), "row long, label string, begin long, finish long, coverage double")
    return scanned.drop("matches"), spans


def op5(docs: DataFrame) -> DataFrame:
    scanned, spans = scan_licenses(docs)
    found = spans.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base = F.transform("phrases", lambda x: x["label"])
    places = F.transform("phrases", lambda x: x["place"])
    return scanned.join(found, "row", "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.size("phrases") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )
