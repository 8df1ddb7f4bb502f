"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import common

WIDTH = 5
CONTAINMENT = 0.8
#: Hash functions of a MinHash signature, each a band of one row. Templates of U/2 < n <= U shingles are searched in windows of 2U that
#: begin every U, over those shingles of a text that some template has, so a template that stands in a text lies whole in a window.
#: At the containment C its Jaccard index with that window is at least C * U/2 / (2U + (1 - C) * U/2) = 0.19, so a band meets with a
#: probability of 1 - 0.81 ** 64 = 1 - 1.4e-6 or more; templates that stand whole have 0.25 or more: 1 - 1e-8.
BANDS = 64
#: Up to so many template shingles (and rows of a few of them) go to every task; a larger library is joined by shuffle.
LIBRARY = 4_000_000

#: Notices of well-known licenses, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    # whole license texts
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
]


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing A-Z; all else separates."""
    return F.filter(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", -1), lambda w: w != "")


def hashes(words: Column) -> Column:
    """64-bit hash of each run of WIDTH words."""
    return F.when(F.size(words) >= WIDTH, F.transform(F.sequence(F.lit(0), F.size(words) - WIDTH), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WIDTH)]))).otherwise(F.array().cast("array<bigint>"))


def gram(words: Column, at: Column) -> Column:
    """The shingle at a position as text. It refers to `words` once for each word, so that the optimizer doesn't put the expression that makes them into the lambda."""
    return F.concat_ws(" ", *[F.get(words, at + k) for k in range(WIDTH)])


def library(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """Rows (template, license, n, size, grams, h): distinct shingles as text and as hashes; size is log2 of the U of the size partition."""
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, license string, notice string")
    made = rows.withColumn("w", tokens(F.col("notice"))).withColumn("h", hashes(F.col("w")))
    every = F.when(F.size("h") > 0, F.transform(F.sequence(F.lit(0), F.size("h") - 1), lambda i: gram(F.col("w"), i))).otherwise(F.array().cast("array<string>"))
    out = made.select("template", "license", F.array_distinct(every).alias("grams"), F.array_distinct("h").alias("h")).withColumn("n", F.size("grams").cast("long"))
    return out.withColumn("size", F.ceil(F.log2("n")).cast("int"))


def signatures(rows: DataFrame, *by: str) -> DataFrame:
    """rows: by, size, h. Rows (by, size, band, key): the least value of the group's shingles under each of BANDS hash functions."""
    least = [F.min(F.xxhash64(F.lit(k), "h")).alias(f"m{k}") for k in range(BANDS)]
    mins = rows.groupBy(*by, "size").agg(*least)
    return mins.select(*by, "size", F.posexplode(F.array(*[f"m{k}" for k in range(BANDS)])).alias("band", "key"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """Rows (doc, template, license, n_shingles, n_shared, containment): templates whose share of shingles in a text is at least `containment`.

    templates: (license, notice) with at least WIDTH words each; template is the number in that list. Null, empty and short texts
    hold none; very long ones are searched whole. Rows of one id count as one text for the pairs they yield (the largest share).
    Empty tables give no rows.
    """
    spark = docs.sparkSession
    known = common.materialise(library(spark, TEMPLATES if templates is None else templates), "templates")
    if known.where("n = 0").limit(1).count():
        raise ValueError(f"a template needs at least {WIDTH} words")
    few = (known.agg(F.sum("n")).first()[0] or 0) <= LIBRARY
    wide = lambda df: F.broadcast(df) if few else df
    shingles = known.select("template", "size", F.explode("h").alias("h"))

    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    # outer, as a filter for empty arrays would be pushed below and put the expression of the words into every lambda
    each = texts.select("doc", "text_hash", tokens(F.col("text")).alias("w")).withColumn("hs", hashes(F.col("w"))).select("doc", "text_hash", F.posexplode_outer("hs").alias("pos", "h"))
    # only shingles that some template has go on: a window's signature over these meets a template's at least as often as over all
    met = each.join(wide(shingles.select(F.col("h").alias("t")).distinct()), F.expr("h = t")).select("doc", "text_hash", "pos", "h")
    met = common.materialise(met, "licensed")
    nth = F.row_number().over(Window.partitionBy("doc", "text_hash").orderBy("pos")) - 1
    sizes = [r["size"] for r in known.select("size").distinct().collect()]  # at most 64
    placed = met.withColumn("nth", nth).withColumn("size", F.explode(F.array(*[F.lit(k) for k in sorted(sizes)])))
    last = F.expr("cast(shiftrightunsigned(nth, size) as int)")
    windows = placed.select("doc", "text_hash", "size", "h", F.explode(F.array_distinct(F.array(last, F.greatest(last - 1, F.lit(0))))).alias("window"))
    bands = signatures(windows, "doc", "text_hash", "window")
    keys = signatures(shingles, "template").select("template", F.col("size").alias("s"), F.col("band").alias("b"), F.col("key").alias("k"))
    pairs = common.materialise(bands.join(wide(keys), F.expr("size = s and band = b and key = k")).select("doc", "text_hash", "template").distinct(), "license-pairs")

    # the texts that a band brought near a template, shingle by shingle
    near = texts.join(pairs.select(F.col("doc").alias("d"), F.col("text_hash").alias("x")).distinct(), F.expr("doc <=> d and text_hash = x"), "left_semi")
    near = near.select("doc", "text_hash", tokens(F.col("text")).alias("w")).withColumn("hs", hashes(F.col("w")))
    every = F.array_distinct(F.transform("hs", lambda _, i: gram(F.col("w"), i)))
    grams = near.select("doc", "text_hash", F.explode_outer(every).alias("gram")).distinct()
    notices = known.select(F.col("template").alias("m"), "license", "n", F.explode("grams").alias("g"))
    shared = grams.join(wide(notices), F.expr("gram = g")).groupBy("doc", "text_hash", "m", "license", "n").agg(F.count(F.lit(1)).alias("shared"))
    sure = pairs.select(F.col("doc").alias("d"), F.col("text_hash").alias("x"), "template")
    counted = shared.join(sure, F.expr("doc <=> d and text_hash = x and m = template"), "left_semi").groupBy("doc", F.col("m").alias("template"), "license", F.col("n").alias("n_shingles")).agg(F.max("shared").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_shingles")
    return counted.where(share >= containment).withColumn("containment", share)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a license notice that it holds."""
    found = scan_licenses(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("template").cast("long").alias("template_id"), "license", "n_shingles", "n_shared", F.round("containment", 9).alias("containment"))


def op2_sql() -> str:
    listed = ",\n  ".join(f"""({k}, '{name}', '{notice.replace("'", "''")}')""" for k, (name, notice) in enumerate(TEMPLATES))
    return rf"""
WITH templates(template_id, license, text) AS (VALUES
  {listed}),
words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[a-z0-9]+') AS ws FROM documents
  UNION ALL
  SELECT 't', template_id, regexp_extract_all(translate(text, '{common.UPPER}', '{common.LOWER}'), '[a-z0-9]+') FROM templates),
grams AS (
  SELECT DISTINCT kind, id, array_to_string(ws[i:i + 4], ' ') AS gram
  FROM (SELECT kind, id, ws, unnest(range(1, len(ws) - 3)) AS i FROM words)),
items AS (SELECT id, gram, count(*) OVER (PARTITION BY id) AS n FROM grams WHERE kind = 't'),
shared AS (
  SELECT g.id AS doc_id, i.id AS template_id, any_value(i.n) AS n_shingles, count(*) AS n_shared
  FROM items i JOIN grams g ON g.kind = 'd' AND g.gram = i.gram GROUP BY ALL)
SELECT doc_id, template_id::BIGINT AS template_id, license, n_shingles, n_shared, round(n_shared / n_shingles, 9) AS containment
FROM shared JOIN templates USING (template_id) WHERE n_shared / n_shingles >= 0.8
"""


OP2_SQL = op2_sql()
