"""Licence scan: Dice coefficient over word bigrams between passages and licence templates.

A passage is a line, a paragraph (lines between blank ones) of several lines, or a sentence of a line of several.
Templates are the paragraphs of licence texts, standard headers and one-line notices, version by version, so that
the version's words decide between versions. Words are runs of 0-9, a-z and non-ASCII characters of the A-Z
lower-cased text. With n distinct bigrams, only templates whose size lies within t / (2 - t) * n and
(2 - t) / t * n can reach a coefficient of t, and it must share at least t / (2 - t) of its own. So a match has one
of a template's rarest bigrams, taken so many that the others are too few for a match. Documents without any such
bigram are not cut into passages, passages without one meet no template, and all of this happens within a row: only
matches are shuffled. The template table is a fixed parameter, so its broadcast is bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, row_key, word_array

DICE = 0.75
#: One row in so many tells which bigrams of the templates are rare.
SAMPLE = 64
#: Licence identifiers with notices, headers and paragraphs of their texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", 'Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("GPL-1.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Everything but 0-9, a-z and non-ASCII characters parts words. Fixed values.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def _zipped(w: Column) -> Column:
    """Neighbouring words as structs; of a single word, that word with null."""
    rest = F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
    n = F.greatest(F.size(w) - 1, F.least(F.size(w), F.lit(1)))
    return F.slice(F.arrays_zip(w.alias("a"), rest.alias("b")), 1, n)


def bigrams(words: str) -> Column:
    """Distinct bigrams of an array of words, as texts."""
    return F.array_distinct(F.transform(_zipped(F.col(words)), lambda z: F.concat_ws("\t", z["a"], z["b"])))


def _hash(z: Column) -> Column:
    return F.xxhash64(z["a"], z["b"])


def template_bigrams(spark, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, licence, n_words, size, pairs, hashes): one row per template."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "template int, licence string, text string")
    rows = rows.select("template", "licence", word_array(ascii_lower(F.col("text")), SEPARATORS).alias("words"))
    rows = rows.select("template", "licence", F.size("words").alias("n_words"), bigrams("words").alias("pairs"), F.transform(_zipped(F.col("words")), _hash).alias("hashes"))
    return rows.select("template", "licence", "n_words", F.size("pairs").alias("size"), "pairs", "hashes")


def passages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k_id, k_hash, doc_id, kind, number, words) of all lines, paragraphs of several lines, and sentences of lines of several.

    A sentence ends where ., ! or ? is followed by space. number counts a document's passages of one kind.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), text.alias("text"))
    cut = F.transform(F.split("text", "\n"), lambda line: F.split(line, "[.!?][ \t]+"))
    parts = F.array(
        F.struct(F.lit("line").alias("kind"), F.split("text", "\n").alias("of")),
        F.struct(F.lit("paragraph").alias("kind"), F.split("text", "\n[ \t]*\n").alias("of")),
        F.struct(F.lit("sentence").alias("kind"), F.flatten(F.filter(cut, lambda line: F.size(line) > 1)).alias("of")),
    )
    each = base.select("doc_id", "k_id", "k_hash", F.explode(parts).alias("p"))
    each = each.select("doc_id", "k_id", "k_hash", F.col("p.kind").alias("kind"), F.posexplode("p.of").alias("number", "passage"))
    each = each.filter((F.col("kind") != "paragraph") | F.contains("passage", F.lit("\n")))
    return each.select("doc_id", "k_id", "k_hash", "kind", "number", word_array(ascii_lower(F.col("passage")), SEPARATORS).alias("words"))


def rare_bigrams(docs: DataFrame, table: DataFrame, text_col: str, id_col: str, dice: float) -> list[int]:
    """Hashes of bigrams of which a passage has at least one of each template that it matches.

    A match has least * size of a template's bigrams, so it has one of any size - least * size + 1 of them. The
    rarest are taken, as one row in SAMPLE of docs tells; which they are changes the work and not the result.
    """
    least = dice / (2 - dice)
    rows = [sorted(set(r.hashes)) for r in table.select("hashes").collect()]
    some = docs.filter(F.pmod(F.xxhash64(F.col(id_col), F.octet_length(F.col(text_col))), F.lit(SAMPLE)) == 0)
    words = some.select(word_array(ascii_lower(F.col(text_col)), SEPARATORS).alias("words"))
    seen = words.select(F.explode(F.transform(_zipped(F.col("words")), _hash)).alias("h")).filter(F.col("h").isin(sorted({h for r in rows for h in r})))
    count = {r.h: r["count"] for r in seen.groupBy("h").count().collect()}
    taken = set()
    for r in rows:
        need = max(1, math.ceil(least * len(r) - 1e-9))
        taken.update(sorted(r, key=lambda h: (count.get(h, 0), h))[: len(r) - need + 1])
    return sorted(taken)


def _has(words: Column, keys: list[int], single: bool) -> Column:
    """Whether one of the bigrams of an array of words, or with single one of its words, has its hash among keys."""
    def found(w: Column) -> Column:
        pair = F.exists(_zipped(w), lambda z: _hash(z).isin(keys))
        return pair | F.exists(w, lambda x: F.xxhash64(x).isin(keys)) if single else pair

    return F.exists(F.array(words), found)  # an array of one, so that the words are made once


def licence_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dice: float = DICE, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(k_id, k_hash, kind, number, licence, dice): the best template of each matching passage.

    Of equal coefficients the template that comes first wins.
    """
    table = materialize(template_bigrams(docs.sparkSession, templates).filter("size > 0"), "templates")
    least = dice / (2 - dice)
    single = not table.filter("n_words = 1").isEmpty()
    place = ["k_id", "k_hash", "kind", "number"]
    keys = rare_bigrams(docs, table, text_col, id_col, dice)
    # a passage's words stand side by side in its document too
    some = docs.filter(_has(word_array(ascii_lower(F.col(text_col)), SEPARATORS), keys, single))
    rows = passages(some, id_col, text_col).filter(_has(F.col("words"), keys, single)).select(*place, bigrams("words").alias("own"))
    rows = rows.withColumn("n", F.size("own"))
    fits = (F.col("size") >= F.col("n") * least - 1e-9) & (F.col("n") >= F.col("size") * least - 1e-9)
    found = rows.join(F.broadcast(table), fits)
    twice = F.size(F.array_intersect("own", "pairs")) * 2
    scored = found.withColumn("dice", twice / (F.col("n") + F.col("size"))).filter(F.col("dice") >= dice).select(*place, "template", "licence", "dice")
    first = F.row_number().over(Window.partitionBy(*place).orderBy(F.desc("dice"), "template"))
    return scored.withColumn("rank", first).filter("rank = 1").select(*place, "licence", "dice")


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dice: float = DICE) -> DataFrame:
    """One row per row of docs: doc_id, n_passages, licences (sorted, joined by commas), best_dice.

    n_passages counts matching passages. Without a match: 0, an empty text and null. Null and empty texts match
    nothing; repeated rows each get a row; an empty table gives an empty result. Other columns are not read.
    """
    key = ["k_id", "k_hash"]
    hits = licence_matches(docs, id_col, text_col, dice).distinct().groupBy(*key).agg(
        F.count("*").alias("n_passages"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"), F.max("dice").alias("best_dice")
    )
    base = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col))
    out = base.join(materialize(hits, "licences"), key, "left")
    return out.select("doc_id", F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.coalesce("licences", F.lit("")).alias("licences"), F.round("best_dice", 6).alias("best_dice"))
