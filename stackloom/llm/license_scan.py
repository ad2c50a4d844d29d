"""Licence scan: Dice coefficient over word bigrams between licence templates and lines, whole short texts, or any passages.

DataFrame functions only. A unit is a line of a document, or the whole document where it has several lines. Its bigrams
(a multiset) are looked up in the bigrams of the templates (a fixed table of this module), so units that share nothing
with a licence vanish in the map stage; what is shuffled is one count per unit, template and shared bigram.

Size bounds: Dice >= t needs t / (2 - t) * |T| <= |U| <= (2 - t) / t * |T|. A unit of n words has n - 1 bigrams, so units
beyond the bounds of all templates go before any bigram is made, and the others meet only templates of like size.

Passages are runs of words wherever lines end: wrapped notices, those in a longer text and those inside a long line. A best run
starts and ends with bigrams of its template (without the others at its ends it is more similar), so runs are made from pairs
of these alone, and only where as many of them lie as close together as the bounds ask.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.llm.common import free_name, table

#: Least Dice coefficient.
THRESHOLD = 0.8

# Short licence notices and statements in common use, and whole texts of the shortest licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "BSD-3-Clause": [
        "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                "to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text):
    """Lower-case ASCII letters and digits; everything else separates."""
    plain = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _bigrams(words):
    """Pairs of neighbouring words, repeated ones too."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def template_bigrams(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """(license, template, t_size, bigram, t_count), from literals; as many rows as the templates have distinct bigrams."""
    rows = [F.struct(F.lit(name).alias("license"), F.lit(i).alias("template"), F.lit(text).alias("text"))
            for name, texts in templates.items() for i, text in enumerate(texts)]
    if not rows:
        return spark.range(0).selectExpr("'' license", "0 template", "0 t_size", "'' bigram", "0L t_count")
    made = spark.range(1).select(F.inline(F.array(*rows))).withColumn("bigrams", _bigrams(_words(F.col("text"))))
    return (made.select("license", "template", F.size("bigrams").alias("t_size"), F.explode("bigrams").alias("bigram"))
            .groupBy("license", "template", "t_size", "bigram").agg(F.count("*").alias("t_count")))


def scan(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per unit and licence whose best template reaches ``threshold``.

    Returns the columns of ``docs`` but ``text``, with ``line_no`` (from 1; 0: the whole text of several lines),
    ``license``, ``template``, ``shared``, ``dice`` added (with underscores where a name is taken). Of several templates of
    a licence the best one counts, of equal ones the first. Null and empty texts, and units of a single word, match
    nothing; nor does a template of one word. Repeated rows each get their own matches.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    sizes = [len(re.findall("[a-z0-9]+", t.lower())) - 1 for ts in templates.values() for t in ts] or [0]
    ratio = (2 - threshold) / threshold
    kept = [c for c in docs.columns if c != text]
    name = {c: free_name(kept, c) for c in ("line_no", "license", "template", "shared", "dice")}
    carried = F.struct(*[F.col(c) for c in kept]) if kept else F.struct(F.lit(0))
    whole = F.filter(F.array(F.struct(F.lit(0).alias("line_no"), F.col(text).alias("unit"))),
                     lambda u: F.instr(u["unit"], "\n") > 0)
    lines = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("unit")))
    units = (docs.select(F.monotonically_increasing_id().alias("__row"), carried.alias("__kept"),
                         F.explode(F.concat(whole, lines)).alias("__u"))
             .select("__row", "__kept", F.col("__u.line_no").alias("__line"), _words(F.col("__u.unit")).alias("__words"))
             .withColumn("__size", F.size("__words") - 1)
             .filter((F.col("__size") >= max(1, min(sizes) / ratio - 1e-9)) & (F.col("__size") <= max(sizes) * ratio + 1e-9)))
    found = units.select("__row", "__kept", "__line", "__size", F.explode(_bigrams(F.col("__words"))).alias("bigram"))
    grams = template_bigrams(spark, templates)
    hits = (found.join(F.broadcast(grams), "bigram")  # the templates: a fixed, small table
            .filter((F.col("__size") >= F.col("t_size") / ratio - 1e-9) & (F.col("__size") <= F.col("t_size") * ratio + 1e-9)))
    unit = ["__row", "__line", "__size", "license", "template", "t_size"]
    shared = (hits.groupBy(*unit, "bigram", "t_count").agg(F.count("*").alias("n"), F.any_value("__kept").alias("__kept"))
              .groupBy(*unit).agg(F.sum(F.least("n", "t_count")).alias("shared"), F.any_value("__kept").alias("__kept")))
    scored = (shared.withColumn("dice", 2 * F.col("shared") / (F.col("__size") + F.col("t_size")))
              .filter(F.col("dice") >= threshold - 1e-9))
    best = (scored.groupBy("__row", "__line", "license")
            .agg(F.min_by(F.struct("template", "shared", "dice", "__kept"), F.struct(-F.col("dice"), "template")).alias("b")))
    return best.select(*[F.col(f"b.__kept.{c}").alias(c) for c in kept], F.col("__line").alias(name["line_no"]),
                       F.col("license").alias(name["license"]), F.col("b.template").alias(name["template"]),
                       F.col("b.shared").alias(name["shared"]), F.col("b.dice").alias(name["dice"]))


def passages(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None,
             threshold: float = THRESHOLD) -> DataFrame:
    """One row per licence and passage of a text in which a run of words reaches ``threshold`` with one of its templates.

    Of the runs from each word on the best one counts (of equal ones the shorter, then the first template's); overlapping
    ones of a licence are one passage. Returns the columns of ``docs`` but ``text``, with ``first_word``, ``last_word`` (of the
    passage, from 1), and ``license``, ``template``, ``shared``, ``dice`` of its best run (of equal ones the first) added,
    with underscores where a name is taken. Lines don't matter. Null and empty texts match nothing; repeated rows each get their own.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    ratio = (2 - threshold) / threshold
    kept = [c for c in docs.columns if c != text]
    name = {c: free_name(kept, c) for c in ("first_word", "last_word", "license", "template", "shared", "dice")}
    carried = F.struct(*[F.col(c) for c in kept]) if kept else F.struct(F.lit(0))
    # the id before the explode: in one select it would number the bigrams
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), carried.alias("__kept"), _bigrams(_words(F.col(text))).alias("__bigrams"))
    found = rows.select("__row", "__kept", F.posexplode("__bigrams").alias("pos", "bigram"))
    grams = template_bigrams(spark, templates)
    hits = found.join(F.broadcast(grams), "bigram")  # the templates: a fixed, small table
    # bounded by the words of a text
    own = ["__row", "license", "template", "t_size"]
    held = (hits.groupBy(*own).agg(F.any_value("__kept").alias("__kept"), F.array_sort(F.collect_list(F.struct("pos", "bigram", "t_count"))).alias("h"))
            .withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("t_size") / ratio - 1e-9)).cast("int"))
            .withColumn("most", F.floor(F.col("t_size") * ratio + 1e-9).cast("int")).filter(F.size("h") >= F.col("need")))
    starts = held.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("h") - F.col("need")))).filter(
        F.expr("get(h, i + need - 1).pos - get(h, i).pos < most"))
    runs = starts.select(*own, "__kept", "most", F.expr("get(h, i).pos").alias("start"), F.explode(F.expr("slice(h, i + 1, most)")).alias("x"))
    runs = runs.filter(F.col("x.pos") - F.col("start") < F.col("most")).select(*own, "__kept", "start", "x.pos", "x.bigram", "x.t_count")
    start = Window.partitionBy(*own, "start")
    counted = F.row_number().over(Window.partitionBy(*own, "start", "bigram").orderBy("pos")) <= F.col("t_count")
    scored = (runs.withColumn("counted", counted.cast("long")).withColumn("shared", F.sum("counted").over(start.orderBy("pos")))
              .withColumn("dice", 2 * F.col("shared") / (F.col("pos") - F.col("start") + 1 + F.col("t_size"))).filter(F.col("dice") >= threshold - 1e-9))
    order = F.struct(-F.col("dice"), "pos", "template")
    best = (scored.groupBy("__row", "license", "start").agg(F.min_by(F.struct("pos", "template", "shared", "dice", "__kept"), order).alias("b"))
            .select("__row", "license", "start", "b.*"))
    # at most one row for each word of a text
    before = Window.partitionBy("__row", "license").orderBy("start")
    ended = F.max("pos").over(before.rowsBetween(Window.unboundedPreceding, -1))
    numbered = best.withColumn("new", (ended.isNull() | (ended < F.col("start"))).cast("int")).withColumn("place", F.sum("new").over(before))
    merged = (numbered.groupBy("__row", "license", "place")
              .agg(F.min("start").alias("first"), F.max("pos").alias("last"),
                   F.min_by(F.struct("template", "shared", "dice", "__kept"), F.struct(-F.col("dice"), "start")).alias("b")))
    return merged.select(*[F.col(f"b.__kept.{c}").alias(c) for c in kept], (F.col("first") + 1).alias(name["first_word"]),
                         (F.col("last") + 2).alias(name["last_word"]), F.col("license").alias(name["license"]),
                         F.col("b.template").alias(name["template"]), F.col("b.shared").alias(name["shared"]), F.col("b.dice").alias(name["dice"]))


def op5_license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and short whole texts alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "line_no", "license", "template", "shared", F.round("dice", 9).alias("dice"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any run of words, wherever lines end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages(docs).select("doc_id", "first_word", "last_word", "license", "template", "shared", F.round("dice", 9).alias("dice"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    values = ", ".join(f"({_quoted(n)}, {i}, {_quoted(t)})" for n, ts in TEMPLATES.items() for i, t in enumerate(ts))
    words = "list_filter(string_split(regexp_replace(translate({0}, '" + UPPER + "', '" + LOWER + "'), '[^a-z0-9]+', ' ', 'g'), ' '), x -> x <> '')"
    words = words.replace("x -> ", "lambda x: ")
    return f"""
WITH templates(license, template, body) AS (VALUES {values}),
tw AS (SELECT license, template, {words.format('body')} AS w FROM templates),
tg AS (SELECT license, template, len(w) - 1 AS t_size, w[i] || ' ' || w[i + 1] AS bigram
       FROM tw, LATERAL (SELECT unnest(range(1, len(w))) AS i)),
tc AS (SELECT license, template, t_size, bigram, count(*) AS t_count FROM tg GROUP BY ALL),
bounds AS (SELECT min(t_size) / 1.5 AS least, max(t_size) * 1.5 AS most FROM tc),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS ls, text FROM documents),
units AS (
  SELECT r, doc_id, i AS line_no, ls[i] AS unit FROM d, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)
  UNION ALL SELECT r, doc_id, 0, text FROM d WHERE len(ls) > 1),
uw AS (SELECT r, doc_id, line_no, {words.format('unit')} AS w FROM units),
ug AS (SELECT r, doc_id, line_no, len(w) - 1 AS u_size, w[i] || ' ' || w[i + 1] AS bigram
       FROM (SELECT uw.* FROM uw, bounds WHERE len(w) - 1 BETWEEN least - 1e-9 AND most + 1e-9), LATERAL (SELECT unnest(range(1, len(w))) AS i)),
uc AS (SELECT r, doc_id, line_no, u_size, bigram, count(*) AS n FROM ug GROUP BY ALL),
s AS (SELECT r, doc_id, line_no, license, template, sum(least(n, t_count)) AS shared, 2.0 * sum(least(n, t_count)) / (u_size + t_size) AS dice
      FROM uc JOIN tc USING (bigram) GROUP BY r, doc_id, line_no, u_size, license, template, t_size),
best AS (SELECT *, row_number() OVER (PARTITION BY r, line_no, license ORDER BY dice DESC, template) AS k FROM s WHERE dice >= 0.8 - 1e-9)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, license, CAST(template AS INTEGER) AS template,
       CAST(shared AS BIGINT) AS shared, round(dice, 9) AS dice
FROM best WHERE k = 1"""


def _passages_sql() -> str:
    values = ", ".join(f"({_quoted(n)}, {i}, {_quoted(t)})" for n, ts in TEMPLATES.items() for i, t in enumerate(ts))
    words = "list_filter(string_split(regexp_replace(translate({0}, '" + UPPER + "', '" + LOWER + "'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
WITH templates(license, template, body) AS (VALUES {values}),
tw AS (SELECT license, template, {words.format('body')} AS w FROM templates),
tg AS (SELECT license, template, len(w) - 1 AS t_size, w[i] || ' ' || w[i + 1] AS bigram
       FROM tw, LATERAL (SELECT unnest(range(1, len(w))) AS i)),
tc AS (SELECT license, template, t_size, bigram, count(*) AS t_count FROM tg GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, {words.format('text')} AS w FROM documents),
b AS (SELECT r, doc_id, i AS pos, w[i] || ' ' || w[i + 1] AS bigram FROM d, LATERAL (SELECT unnest(range(1, len(w))) AS i)),
every AS (SELECT r, doc_id, license, template, t_size, t_count, pos, bigram, count(*) OVER (PARTITION BY r, license, template) AS n
          FROM b JOIN tc USING (bigram)),
hits AS (SELECT * FROM every WHERE n * 1.5 >= t_size - 1e-9),
runs AS (SELECT x.r, x.doc_id, x.license, x.template, x.t_size, x.pos AS start, y.pos, CASE WHEN row_number() OVER (
           PARTITION BY x.r, x.license, x.template, x.pos, y.bigram ORDER BY y.pos) <= y.t_count THEN 1 ELSE 0 END AS counted
         FROM hits x JOIN hits y ON x.r = y.r AND x.license = y.license AND x.template = y.template
           AND y.pos >= x.pos AND y.pos - x.pos + 1 <= x.t_size * 1.5 + 1e-9),
sums AS (SELECT *, sum(counted) OVER (PARTITION BY r, license, template, start ORDER BY pos) AS shared FROM runs),
scored AS (SELECT *, 2.0 * shared / (pos - start + 1 + t_size) AS dice FROM sums),
best AS (SELECT *, row_number() OVER (PARTITION BY r, license, start ORDER BY dice DESC, pos, template) AS k FROM scored WHERE dice >= 0.8 - 1e-9),
ended AS (SELECT *, max(pos) OVER (PARTITION BY r, license ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM best WHERE k = 1),
placed AS (SELECT *, sum(CASE WHEN e IS NULL OR e < start THEN 1 ELSE 0 END) OVER (PARTITION BY r, license ORDER BY start) AS place FROM ended),
ranked AS (SELECT *, min(start) OVER (PARTITION BY r, license, place) AS first_word, max(pos) OVER (PARTITION BY r, license, place) + 1 AS last_word,
             row_number() OVER (PARTITION BY r, license, place ORDER BY dice DESC, start) AS j FROM placed)
SELECT doc_id, CAST(first_word AS INTEGER) AS first_word, CAST(last_word AS INTEGER) AS last_word, license,
       CAST(template AS INTEGER) AS template, CAST(shared AS BIGINT) AS shared, round(dice, 9) AS dice
FROM ranked WHERE j = 1"""


QUERIES = {"op5_license_scan": op5_license_scan, "op5_license_lines": op5_license_lines}
SQL = {"op5_license_scan": _passages_sql(), "op5_license_lines": _sql()}
