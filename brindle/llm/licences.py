"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A text's units are its lines, and its paragraphs of several lines; every unit is weighed against every template by the
cosine of TF-IDF vectors, and one at or above THRESHOLD names the licence of its best template. Words are runs of ASCII
letters, digits and other characters than ASCII; document frequencies come from all documents, for every word.

Three passes over the texts, of which the first counts the templates' words. Then the least weight of any other word is
known (it may be in all documents), so the second can leave out units whose cosine can't reach the threshold even so; a
sum of each word's greatest possible share, without any cosine, leaves out most. What remains is listed with its other
words, by hash; the third counts in how many documents these occur (only these, if they are counted at most FEW_WORDS,
or else all words). The counts are joined to the units' words, and the cosines are made.

A licence file is a document of which licensed units cover at least FILE_SHARE of the words; it speaks for its directory.
Documents without a licence of their own take that of the nearest ancestor directory with a licence file: a document is
joined with the directories on its path by equality (those no deeper than the deepest with a file), and the deepest
wins. If a directory has several, the best score counts, then the name. Directories are broadcast only if they are
counted and few.

Nulls and edge cases: a null text has no units; a null path has no directory and inherits nothing; of templates with
equal scores the last name wins; repeated rows give repeated rows; an empty table gives an empty result; columns called
licence, score, is_file or inherited_from are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import settled, stored, table

THRESHOLD = 0.6
FILE_SHARE = 0.5
FEW = 50_000  # directories that may be broadcast
FEW_WORDS = 250_000  # words of units that the count may be limited to by broadcast

#: Licence, template (notices, headers and paragraphs of the licences' own wording).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "All rights reserved."),
)

#: Bytes to words: letters and digits stay, A-Z become lower case, other ASCII separates; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def hashed(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


@cache
def template_words() -> dict[bytes, int]:
    return {w: i for i, w in enumerate(sorted({w for _, t in TEMPLATES for w in words_of(t)}))}


def idf(df: float, total: int) -> float:
    return math.log((1 + total) / (1 + df)) + 1


class Templates:
    """TF-IDF vectors of the templates, of length 1. frequency: documents that have a word, by its id; total: all documents."""

    def __init__(self, frequency: dict[int, int], total: int):
        known = template_words()
        self.idf = np.array([idf(frequency.get(i, 0), total) for i in range(len(known))])
        self.names = [name for name, _ in TEMPLATES]
        self.vectors = np.zeros((len(TEMPLATES), len(known)))
        for k, (_, text) in enumerate(TEMPLATES):
            for w, n in Counter(words_of(text)).items():
                self.vectors[k, known[w]] = (1 + math.log(n)) * self.idf[known[w]]
        self.vectors /= np.sqrt((self.vectors**2).sum(axis=1, keepdims=True))
        # the most that one occurrence of a word can add to a unit's product with a template
        self.reach = {w: float(self.idf[i] * self.vectors[:, i].max()) for w, i in known.items()}

    def products(self, terms: list[int], counts: list[int]) -> tuple[np.ndarray, float]:
        """A unit's product with each template, and the sum of squares of its own weights of template words."""
        own = (1 + np.log(np.array(counts, float))) * self.idf[terms]
        return self.vectors[:, terms] @ own, float((own**2).sum())

    def best(self, terms: list[int], counts: list[int], others: float) -> tuple[float, str]:
        """others: the sum of squares of the weights of the unit's other words."""
        product, own = self.products(terms, counts)
        size = math.sqrt(own + others) or 1.0
        return max((x / size, name) for x, name in zip(product.tolist(), self.names, strict=True))

    def unit(self, words: list[bytes]) -> dict | None:
        """The unit's words, if its cosine with a template may reach the threshold: any other word weighs at least its 1 + log of its count."""
        known = template_words()
        count = Counter(words)
        inside = {known[w]: n for w, n in count.items() if w in known}
        others = [(hashed(w), n) for w, n in count.items() if w not in known]
        product, own = self.products(list(inside), list(inside.values()))
        if product.max() < (THRESHOLD - 1e-9) * math.sqrt(own + sum((1 + math.log(n)) ** 2 for _, n in others)):
            return None
        return {"terms": list(inside), "counts": list(inside.values()), "others": [{"word": h, "n": n} for h, n in others], "n_words": len(words)}

    def units(self, text: str | None) -> tuple[int, list[dict]]:
        """How many words a text has, and its units that may be licensed; block numbers the paragraphs, whole tells them from their lines."""
        total, out, block, reach = 0, [], 0, self.reach.get
        lines: list[tuple[list[bytes], float]] = []
        data = (text or "").encode("utf-8", "surrogatepass")

        def may(words: list[bytes], sum_of: float, distinct: int) -> bool:
            return sum_of >= (THRESHOLD - 1e-9) * math.sqrt(distinct)  # each distinct word weighs 1 or more

        for line in [*data.split(b"\n"), b""]:
            words = line.translate(_FOLD).split()
            if line.strip():
                sum_of = sum([reach(w, 0.0) for w in words])
                total += len(words)
                lines.append((words, sum_of))
                if sum_of and may(words, sum_of, 1) and may(words, sum_of, len(set(words))) and (found := self.unit(words)):
                    out.append(found | {"block": block, "whole": False})
                continue
            sum_of = sum(s for _, s in lines)
            if len(lines) > 1 and sum_of and may([], sum_of, 1):
                words = [w for own, _ in lines for w in own]
                if may(words, sum_of, len(set(words))) and (found := self.unit(words)):
                    out.append(found | {"block": block, "whole": True})
            block, lines = block + 1, []
        return total, out


def template_frequencies(docs: DataFrame, text: str) -> tuple[dict[int, int], int]:
    """In how many rows each template word occurs, by its id, and how many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, rows = template_words(), Counter(), 0
        for batch in batches:
            rows += batch.num_rows
            for x in batch.column(0):
                count.update(known.keys() & set(words_of(x.as_py())))
        ids = [known[w] for w in count]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *ids], pa.int32()), pa.array([rows, *count.values()], pa.int64())], ["id", "n"])

    found = docs.select(text).mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each template word
    counts = {r["id"]: r["n"] for r in found}
    return counts, counts.pop(-1, 0)


_UNIT = "terms:array<int>,counts:array<int>,others:array<struct<word:bigint,n:int>>,n_words:int,block:int,whole:boolean"


def scan(docs: DataFrame, templates, text: str) -> DataFrame:
    """docs without its text, with n_words and units (template words with counts, other words' hashes with counts, all words, place)."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "n_words", "units")]
    unit = pa.list_(pa.struct([("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("others", pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int32())]))), ("n_words", pa.int32()), ("block", pa.int32()), ("whole", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = templates.value
        for batch in batches:
            names = batch.schema.names
            found = [own.units(x.as_py()) for x in batch.column(names.index(text))]
            new = [pa.array([n for n, _ in found], pa.int64()), pa.array([u for _, u in found], unit)]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(f.name)) for f in kept), *new], [*(f.name for f in kept), "n_words", "units"])

    schema = type(docs.schema)([*kept])
    for f in type(docs.schema).fromDDL(f"n_words bigint, units array<struct<{_UNIT}>>"):
        schema = schema.add(f)
    return docs.mapInArrow(run, schema)


def occurrences(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(word, df) of the hashes in wanted: in how many rows of docs each word occurs."""
    spark = docs.sparkSession
    few = wanted.count() <= FEW_WORDS
    listed = spark.sparkContext.broadcast(frozenset(r["word"] for r in wanted.collect()) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, ids, count = listed.value, {}, Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64())], ["word", "n"])
            count.clear()
            return out

        for batch in batches:
            for x in batch.column(0) if only or only is None else ():
                for w in set(words_of(x.as_py())):
                    h = ids.get(w)
                    if h is None:
                        h = hashed(w)
                        h = ids[w] = h if only is None or h in only else 0
                    if h:
                        count[h] += 1
                if len(count) > FEW_WORDS:
                    yield flushed()
                if len(ids) > FEW_WORDS:
                    ids.clear()
        yield flushed()

    counted = docs.select(text).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("df"))
    return counted if few else counted.join(wanted, "word", "left_semi")


def weighted(numbered: DataFrame, docs: DataFrame, text: str, total: int) -> DataFrame:
    """numbered (_row, units) with others: per unit the sum of squares of the TF-IDF weights of words that no template has."""
    words = numbered.select("_row", F.posexplode("units").alias("_unit", "_u")).select("_row", "_unit", F.explode("_u.others").alias("_o"))
    words = words.select("_row", "_unit", F.col("_o.word").alias("word"), F.col("_o.n").alias("n"))
    df = stored(occurrences(docs, stored(words.select("word").distinct()), text))
    weight = (1 + F.log("n")) * (F.log(F.lit(1.0 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1)
    sums = words.join(df, "word", "left").groupBy("_row", "_unit").agg(F.sum(weight * weight).alias("x"))
    by_row = sums.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_unit", "x"))).alias("_sums"))
    others = F.expr("transform(units, (u, i) -> coalesce(element_at(_sums, i), 0D))")
    return numbered.join(by_row, "_row", "left").withColumn("others", others).drop("_sums")


def covered(units: list[tuple[float, dict]]) -> int:
    """The words that licensed units cover: of a paragraph all, or those of its lines."""
    whole, lines = {}, Counter()
    for _, u in units:
        if u["whole"]:
            whole[u["block"]] = u["n_words"]
        else:
            lines[u["block"]] += u["n_words"]
    return sum(whole.get(b, lines[b]) for b in whole.keys() | lines.keys())


def rated(docs: DataFrame, text: str) -> DataFrame:
    """docs without its text, with n_words, licence and score of the best unit, null below THRESHOLD, and licence_words of all units above it."""
    spark = docs.sparkSession
    templates = Templates(*(counts := template_frequencies(docs, text)))
    shared = spark.sparkContext.broadcast(templates)
    found = stored(scan(docs.drop("_row"), shared, text).withColumn("_row", F.monotonically_increasing_id()))
    some = weighted(found.where("size(units) > 0").select("_row", "units"), docs, text, counts[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            licence, score, words = [], [], []
            for units, others in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                best = [(own.best(u["terms"], u["counts"], x), u) for u, x in zip(units, others, strict=True)]
                best = [b for b in best if b[0][0] >= THRESHOLD]
                top = max((b for b, _ in best), default=(None, None))
                licence.append(top[1])
                score.append(None if top[0] is None else round(top[0], 6))
                words.append(covered(best))
            new = [pa.array(licence, pa.string()), pa.array(score, pa.float64()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], ["_row", "licence", "score", "licence_words"])

    verdicts = some.select("_row", "units", "others").mapInArrow(run, "_row bigint, licence string, score double, licence_words bigint").where("licence is not null")
    rest = found.drop("units")
    return rest.join(verdicts, "_row", "left").drop("_row").withColumn("licence_words", F.coalesce("licence_words", F.lit(0).cast("long")))


def licensed(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """docs without its text, with licence, score, is_file, inherited_from (a directory, if the licence is inherited)."""
    docs = docs.drop("licence", "score", "licence_words", "is_file", "inherited_from", "n_words", "units")
    found = settled(docs.sparkSession, lambda: rated(docs, text))
    found = found.withColumn("is_file", F.col("licence").isNotNull() & (F.col("licence_words") >= FILE_SHARE * F.col("n_words")))
    directory = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    files = found.where(F.col("is_file") & F.col(path).isNotNull()).groupBy(directory.alias("_directory"))
    speaks = files.agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("_speaks")).select("_directory", F.col("_speaks.licence").alias("_licence"))
    speaks = stored(speaks.withColumn("_depth", F.when(F.col("_directory") == "", 0).otherwise(F.size(F.split("_directory", "/")))))
    deepest, count = speaks.agg(F.max("_depth"), F.count(F.lit(1))).first()
    if count <= FEW:
        speaks = F.broadcast(speaks)
    own = found.where("licence is not null").withColumn("inherited_from", F.lit(None).cast("string"))
    bare = found.where("licence is null").select(F.monotonically_increasing_id().alias("_row"), F.struct(*found.columns).alias("_doc"), F.split(F.col(path), "/").alias("_parts"))
    above = F.expr(f"transform(sequence(0, least(size(_parts) - 1, {deepest or 0})), i -> array_join(slice(_parts, 1, i), '/'))")
    keyed = bare.withColumn("_key", F.explode_outer(F.when(F.col("_parts").isNotNull(), above)))
    met = keyed.join(speaks, F.col("_key") == F.col("_directory"), "left")
    nearest = F.max(F.when(F.col("_directory").isNotNull(), F.struct(F.length("_directory").alias("n"), "_directory", "_licence"))).alias("_best")
    taken = met.groupBy("_row").agg(F.first("_doc").alias("_doc"), nearest)
    inherited = taken.select(*(F.col("_best._licence").alias(c) if c == "licence" else F.col(f"_doc.`{c}`") for c in found.columns), F.col("_best._directory").alias("inherited_from"))
    return own.unionByName(inherited)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence; the table has no paths, so a document lies in its source's folder for its language."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt"))
    folders = (F.coalesce(c, F.lit("")) for c in ("source", "lang"))  # of a null, the folder without a name
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.lit("corpus"), *folders, name).alias("path"), "text")
    return licensed(docs).select("doc_id", "path", "licence", "score", "is_file", "inherited_from")


QUERIES = {"op6_licences": op6_licences}
ORACLE_SQL: dict = {}
