"""License scans: Dice coefficient over word bigrams against licence templates, in DataFrames only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.llm.common import held

THRESHOLD = 0.8

# Licence texts and notices, as published.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
#: Name and template; a licence may have several.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", f"{_MIT} {_AS_IS}"),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3}"),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def _words(text: str | Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def _bigrams(words: Column) -> Column:
    """Hashes of the pairs of neighbouring words, in order; none if there are fewer than two words."""
    pair = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1))
    made = F.transform(F.sequence(F.lit(0), F.size(words) - 2), pair)
    return F.when(F.size(words) >= 2, made).otherwise(F.array().cast("array<bigint>"))


def _wanted(spark: SparkSession, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """A row for each licence with its templates ``ts``: bigrams, their number, the least shared and the most places."""
    listed = spark.createDataFrame(list(templates) or [("", "")], "license string, template string")
    split = held(held(listed, "_w", _words("template")), "_p", _bigrams(F.col("_w")))
    tb = held(split, "tb", F.array_distinct("_p")).withColumn("tn", F.size("tb")).where("tn > 0")
    least = F.ceil(F.col("tn") * (threshold / (2 - threshold)) - 1e-9).cast("int")
    most = F.floor(F.size("_p") * ((2 - threshold) / threshold) + 1e-9).cast("int")
    return tb.groupBy("license").agg(F.collect_list(F.struct("tb", "tn", least.alias("least"), most.alias("most"))).alias("ts"))


def _passages(t: Column, threshold: float) -> Column:
    """Runs of places of ``_p`` whose Dice coefficient with a template is ``threshold`` or more, as structs a, z, dice.

    The best run from a place on begins and ends with a bigram of the template. A run needs ``least`` of them, so only
    places from which as many follow within ``most`` places are gone through. A bigram counts where it is new in the run.
    """
    hits = F.filter(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: F.array_contains(t["tb"], F.get(F.col("_p"), i)))

    def longest(places: Column) -> Column:
        last = lambda i: F.get(places, i + t["least"] - 1)
        near = F.filter(F.transform(places, lambda a, i: F.struct(a.alias("a"), (last(i) - a).alias("far"))), lambda s: s["far"] < t["most"])
        return F.transform(near, lambda s: best(s["a"]))

    def best(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("s"), F.lit(0.0).alias("dice"), a.alias("z"))

        def step(state: Column, i: Column) -> Column:
            new = (F.get(F.col("_prev"), i) < a).cast("int")
            n = state["n"] + new
            s = state["s"] + new * F.array_contains(t["tb"], F.get(F.col("_p"), i)).cast("int")
            dice = (2 * s / (n + t["tn"])).cast("double")
            better = dice > state["dice"]
            return F.struct(n.alias("n"), s.alias("s"), F.when(better, dice).otherwise(state["dice"]).alias("dice"), F.when(better, i).otherwise(state["z"]).alias("z"))

        stop = F.least(a + t["most"], F.size("_p")) - 1
        return F.aggregate(F.sequence(a, stop), start, step, lambda x: F.struct(a.alias("a"), x["z"].alias("z"), x["dice"].alias("dice")))

    # the places are bound to a name by a transform over an array of one
    found = F.flatten(F.transform(F.array(hits), longest))
    return F.filter(found, lambda x: x["dice"] >= threshold)


def scan_licenses(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Pairs of a row's id and a licence named by it: ``license``, ``dice`` (the best) and ``n_units``.

    Units of a text are the whole, its lines, sentences within lines, and passages: from each
    word on, over the ends of lines too, the best run of up to (2 - t) / t times a template's bigrams. Normalised text is lower-cased runs of letters and
    digits. A unit names a licence if the Dice coefficient of the sets of word bigrams with one of its templates is
    ``threshold`` or more. ``n_units`` counts the pairs of a distinct whole, line or sentence and a template, and each
    stretch of overlapping passages that touches none of those. A licence whose template lies within another's (BSD-2
    within BSD-3) is named beside it.

    2 * shared >= t * (size + m) and shared <= size, so a template of m bigrams needs m * t / (2 - t) of them in the
    unit, and then in the text: rows are looked at more closely only for licences of which they hold as many. Units of
    one word and null or empty texts have no bigrams and name nothing. Rows that share an id are reported together; a
    null id is an id like others. Other columns are ignored; an empty table or no templates give an empty result.
    """
    wanted = _wanted(df.sparkSession, templates, threshold)
    every = wanted.agg(F.array_distinct(F.flatten(F.flatten(F.collect_list("ts.tb")))).alias("_all"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = held(df.select(F.col(id_col).alias("_id"), text.alias("_t")), "_w", _words("_t"))
    pairs = held(split, "_p", _bigrams(F.col("_w"))).drop("_w")
    some = held(pairs.crossJoin(F.broadcast(every)), "_h", F.array_intersect("_p", "_all")).drop("_all").where(F.size("_h") > 0)
    enough = F.exists("ts", lambda t: (F.size("_h") >= t["least"]) & (F.size(F.array_intersect(t["tb"], F.col("_h"))) >= t["least"]))
    rows = some.join(F.broadcast(wanted), enough).drop("_h")

    # whole, lines and sentences
    lines, sentences = F.split("_t", "\n", -1), F.split("_t", r"\n|(?<=\.)[ \t]+", -1)
    rows = held(held(rows, "_l", lines), "_s", sentences)
    rows = held(rows, "_u", F.array_distinct(F.concat(F.array("_t"), "_l", "_s")))
    rows = held(rows, "_uw", F.transform("_u", _words))
    rows = held(rows, "_ub", F.transform("_uw", lambda w: F.array_distinct(_bigrams(w)))).drop("_uw")
    dice = lambda b, t: 2 * F.size(F.array_intersect(b, t["tb"])) / (F.size(b) + t["tn"])
    rows = held(rows, "_d", F.transform("_ub", lambda b: F.filter(F.transform("ts", lambda t: dice(b, t)), lambda d: d >= threshold))).drop("_ub")
    rows = held(rows, "_hit", F.filter(F.transform("_u", lambda u, i: F.when(F.size(F.get(F.col("_d"), i)) > 0, u)), lambda u: u.isNotNull())).drop("_u")

    # passages, merged where they overlap
    placed = held(rows, "_o", F.array_sort(F.transform("_p", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    at = lambda i: F.get(F.col("_o"), i)
    last = F.transform("_o", lambda o, i: F.struct(o["i"].alias("i"), F.when(at(i - 1)["x"] == o["x"], at(i - 1)["i"]).otherwise(F.lit(-1)).alias("prev")))
    placed = held(placed, "_o", F.array_sort(last)).withColumn("_prev", F.col("_o.prev")).drop("_o")
    found = held(placed, "_f", F.array_sort(F.flatten(F.transform("ts", lambda t: _passages(t, threshold))))).drop("_prev", "ts")

    def merge(done: Column, x: Column) -> Column:
        top = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(top["a"].alias("a"), F.greatest(top["z"], x["z"]).alias("z"))))
        apart = F.concat(done, F.array(F.struct(x["a"].alias("a"), x["z"].alias("z"))))
        return F.when((F.size(done) > 0) & (x["a"] <= F.try_element_at(done, F.lit(-1))["z"]), joined).otherwise(apart)

    rows = held(found, "_m", F.aggregate("_f", F.array().cast("array<struct<a:int,z:int>>"), merge))
    for part in ("_l", "_s"):  # for each word, whether its line or sentence names the licence
        rows = held(rows, "_n", F.transform(part, lambda x: F.array_contains("_hit", x)))
        rows = held(rows, part, F.flatten(F.transform(part, lambda x, i: F.transform(_words(x), lambda _: F.get(F.col("_n"), i)))))
    touched = lambda m: F.exists(F.array("_l", "_s"), lambda named: F.array_contains(F.slice(named, m["a"] + 1, m["z"] - m["a"] + 2), True))
    alone = F.filter("_m", lambda m: ~F.array_contains("_hit", F.col("_t")) & ~touched(m))
    dices = F.concat(F.flatten("_d"), F.col("_f.dice"))
    hits = rows.select("_id", "license", F.array_max(dices).alias("dice"), (F.size(F.flatten("_d")) + F.size(alone)).alias("n")).where("dice is not null")
    return hits.groupBy(F.col("_id").alias(id_col), "license").agg(F.round(F.max("dice"), 6).alias("dice"), F.sum("n").alias("n_units"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The best coefficient of each document and licence, for the table documents.
SQL = r"""
WITH templates(license, t) AS (VALUES {rows}), numbered AS (
  SELECT license, row_number() OVER () AS k, list_filter(string_split_regex(lower(t), '[^\p{L}\p{N}]+'), lambda x: x != '') AS w FROM templates
), wanted AS (
  SELECT license, k, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM numbered WHERE len(w) > 1
), units AS (
  SELECT doc_id, unnest(list_distinct(list_concat([text], string_split(text, chr(10)),
    list_concat(string_split_regex(replace(regexp_replace(text, '\.[ \t]+', '.' || chr(10), 'g'), chr(13), chr(13)), chr(10)), [])))) AS u FROM documents
), split AS (
  SELECT doc_id, u, list_filter(string_split_regex(lower(u), '[^\p{L}\p{N}]+'), lambda x: x != '') AS w FROM units
), each AS (
  SELECT doc_id, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM split WHERE len(w) > 1
), hits AS (
  SELECT doc_id, license, 2.0 * len(list_intersect(e.b, t.b)) / (len(e.b) + len(t.b)) AS dice
  FROM each e JOIN wanted t ON len(e.b) BETWEEN len(t.b) / 1.5 - 1 AND len(t.b) * 1.5 + 1
)
SELECT doc_id, license, round(max(dice), 6) AS dice, count(*) AS n_units FROM hits WHERE dice >= 0.8 GROUP BY ALL
""".replace("{rows}", ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in TEMPLATES))
