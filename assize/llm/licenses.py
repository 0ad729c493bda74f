"""License scans by diagonal voting.

Every text's rolling word k-gram hashes are joined to the positions of the same hashes in license
templates. A hit at word p of the text and word q of a template votes for the diagonal p - q: a copy of
the template votes along one diagonal, and with words put in or left out along neighbouring ones, which
are merged. Every hit is verified by its words, not by their hash alone. A merged span counts if the words
that verified hits cover are enough: a share of the template or, of a long one, so many words, and a share of
the span. Licenses share passages; where spans of several labels overlap, those with the most words stay.

The templates are few and fixed, so their table is broadcast; a text's hits are grouped by text, template
and diagonal, where a template's length bounds a group.

Defined results: null and empty texts have no words, no labels and score zero; repeated rows have the
same result each; an empty table gives an empty table; extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 3
#: Diagonals at most so many words apart are merged.
NEIGHBOURS = 3
#: The share of a template's words, and of a span's, that must be covered.
COVERED, DENSE = 0.7, 0.6
#: Verified words that suffice, however long the template.
ENOUGH = 30

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {1} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see https://www.gnu.org/licenses/."

# The texts of public licenses, or the notices by which longer ones are applied, by label.
TEMPLATES = {
    "mit": [
        "released under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache": [
        "licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": ["this work is licensed under the GNU General Public License, version 3", "This program " + _GNU.format("", "This program")],
    "lgpl": ["This library " + _GNU.format("Lesser ", "This library")],
    "agpl": ["This program " + _GNU.format("Affero ", "This program")],
    "bsd": [
        _BSD_HEAD + " " + _BSD_TAIL,
        _BSD_HEAD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL,
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
    "boost": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "cc-by-nc": ["licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by": ["licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
}

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(text: Column) -> Column:
    """A text's words, A-Z in lower case, with one space between them."""
    text = F.coalesce(text, F.lit(""))
    ascii_lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.trim(F.regexp_replace(ascii_lower, _GAP, " "))


def template_words(text: str) -> list[str]:
    return re.sub(_GAP, " ", text.lower()).split()


def template_grams(spark: SparkSession, k: int = K) -> DataFrame:
    """(gram, said, template, at, length, label): the k-grams of the templates by position, as hashes and as words."""
    rows = [(n, at, len(words), label, " ".join(words[at : at + k])) for n, (label, words) in enumerate((label, template_words(t)) for label, ts in TEMPLATES.items() for t in ts) for at in range(len(words) - k + 1)]
    table = spark.createDataFrame(rows, "template int, at int, length int, label string, said string")
    return table.withColumn("gram", F.xxhash64("said"))


def spans(docs: DataFrame, keys: list[str], line: str, k: int = K) -> DataFrame:
    """(keys, label, first, last, covered, coverage): verified spans of the templates in the space-joined words ``line``.

    Rows with equal ``keys`` must have equal lines; they give one set of spans.
    """
    words = docs.select(*keys, F.split(line, " ").alias("words")).where(F.size("words") >= k)
    said = F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: F.concat_ws(" ", *[F.get("words", i + j) for j in range(k)]))
    grams = words.select(*keys, F.posexplode(said).alias("pos", "words_said")).withColumn("gram", F.xxhash64("words_said"))
    hits = grams.join(F.broadcast(template_grams(docs.sparkSession, k)), "gram").where("words_said = said")
    votes = hits.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy(*keys, "template", "diagonal")
    votes = votes.agg(F.first("length").alias("length"), F.first("label").alias("label"), F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = W.partitionBy(*keys, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS, F.lit(True))
    merged = votes.withColumn("run", F.sum(apart.cast("int")).over(order)).groupBy(*keys, "template", "run")
    merged = merged.agg(F.first("length").alias("length"), F.first("label").alias("label"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + k - 1)))))
    measured = merged.withColumn("covered", covered).withColumn("coverage", F.col("covered") / F.col("length"))
    dense = F.col("covered") / (F.col("last") - F.col("first") + 1)
    enough = (F.col("coverage") >= COVERED) | (F.col("covered") >= ENOUGH)
    return measured.where(enough & (dense >= DENSE)).select(*keys, "label", "first", "last", "covered", "coverage")


def _most_words(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, more, coverage): the labels whose spans are not overlapped by one of more words of another label."""
    span = F.struct("first", "last", "covered", "label", "coverage")
    listed = found.groupBy(*keys).agg(F.collect_list(span).alias("spans"))
    beaten = lambda s: F.exists("spans", lambda o: (o["label"] != s["label"]) & (o["covered"] > s["covered"]) & (o["first"] <= s["last"]) & (o["last"] >= s["first"]))
    several = F.size(F.array_distinct(F.transform("spans", lambda s: s["label"]))) > 1
    kept = F.when(several, F.filter("spans", lambda s: ~beaten(s))).otherwise(F.col("spans"))
    labels = F.array_distinct(F.transform(kept, lambda s: s["label"]))
    return listed.select(*keys, labels.alias("more"), F.array_max(F.transform(kept, lambda s: s["coverage"])).alias("coverage"))


def _places(line: str) -> list[tuple[str, str, int, Column]]:
    """For every phrase (name, label, its words, the text cut at its places); null where there are none."""
    padded = F.concat(F.lit(" "), F.col(line), F.lit(" "))
    return [(f"cut_{n}", label, len(phrase.split()), F.when(F.contains(F.col(line), F.lit(phrase)), F.split(padded, f"(?<= ){phrase}(?= )"))) for n, (phrase, label) in enumerate(PHRASES.items())]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), plain(F.col(text_col)).alias("line"))
    keys = ["id", "text_hash"]
    gaps = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    cuts = _places("line")
    base = rows.select(*keys, F.when(F.col("line") == "", 0).otherwise(gaps(F.col("line")) + 1).alias("n_words"), *[c.alias(name) for name, _, _, c in cuts])
    number = sum((F.coalesce(F.size(name) - 1, F.lit(0)) for name, *_ in cuts), F.lit(0))
    found = lambda name: F.coalesce(F.size(name), F.lit(0)) > 1
    first = F.least(*[F.when(found(name), gaps(F.element_at(name, 1)) - 1) for name, *_ in cuts])
    last = F.greatest(*[F.when(found(name), F.col("n_words") - (gaps(F.element_at(name, -1)) - 1) - size) for name, _, size, _ in cuts])
    labels = F.array_compact(F.array(*[F.when(found(name), F.lit(label)) for name, label, *_ in cuts]))
    base = base.select(*keys, F.col("n_words").cast("long").alias("n_words"), number.cast("long").alias("n_base"), first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), F.array_sort(labels).alias("base"))
    more = _most_words(spans(rows, keys, "line"), keys)
    more = more.withColumnRenamed("id", "more_id").withColumnRenamed("text_hash", "more_hash")
    both = base.join(more, F.col("id").eqNullSafe(F.col("more_id")) & (F.col("text_hash") == F.col("more_hash")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.coalesce("coverage", F.lit(0.0)), F.lit(1.0)))
    return both.select("id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its base phrases, all labels and a score: 1 with a base label, else the best span's coverage."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
