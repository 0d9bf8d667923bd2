"""Licence scans by Dice coefficient over word bigrams.

Units are the whole text, each of its lines and each of its paragraphs of several lines, in normal form. A template is compared with a unit only
if their numbers of bigrams allow the wanted coefficient, which leaves almost every unit without any
comparison. Everything is DataFrame expressions; the templates are a fixed list.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DICE = 0.8

# Names and texts of licence notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT (notice)": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "EPL-2.0 (notice)": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0 (notice)": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD (terms)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC0 (notice)": "Released under CC0 1.0.",
    "All rights reserved": "All rights reserved.",
}


def words(text: Column) -> Column:
    """Words of the normal form: A-Z lowered, runs of ASCII letters, digits, full stops within, and all of non-ASCII."""
    plain = F.regexp_replace(common.ascii_lower(text), "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def bigrams(ws: Column) -> Column:
    """Hashes of the different word bigrams; of a single word, the word."""
    n = F.size(ws)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1)))
    return F.array_distinct(F.when(n > 1, pairs).when(n == 1, F.transform(ws, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<long>")))


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """license, tb (its bigrams), tn (their number)."""
    rows = spark.createDataFrame(list((texts or TEMPLATES).items()), "license string, body string")
    return rows.select("license", F.explode(F.transform(F.array(words(F.col("body"))), bigrams)).alias("tb")).withColumn("tn", F.size("tb"))


def anchors(texts: dict[str, str], dice: float) -> str:
    """A pattern that every unit at ``dice`` or more with any template matches.

    Such a unit has a share of dice / (2 - dice) of the template's bigrams at least. So it has one of the
    bigrams that the anchor words touch, if these touch more than the rest. Long words first: they are rarer.
    """
    chosen = set()
    for body in texts.values():
        ws = re.findall("[a-z0-9]+|[^\x00-\x7f]+", body.translate({c: c + 32 for c in range(65, 91)}))
        pairs = set(zip(ws, ws[1:])) or {(w, w) for w in ws}
        own: set[str] = set()
        for w in sorted(set(ws), key=lambda w: (w not in chosen, -len(w), w)):
            if sum(a in own or b in own for a, b in pairs) > len(pairs) * (1 - dice / (2 - dice)):
                break
            own.add(w)
        chosen |= own
    return "(?i)(?<![A-Za-z0-9])(?:" + "|".join(sorted(map(re.escape, chosen))) + ")"


def scan(docs: DataFrame, dice: float = DICE, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, dice, n_units: for each document and licence met, the best coefficient and how many units meet it.

    Units are the whole text and, if it has several, its lines, and its paragraphs (what blank lines part) of several lines; equal units of a
    document count each. A unit, however long, meets all licences at ``dice`` or more. Null and empty texts, and lines without words, meet none. Repeated
    rows of one id are one document. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = templates(spark, texts)
    bounds = known.agg(F.min("tn"), F.max("tn")).first()  # of a fixed list
    # With n and m bigrams the coefficient is at most 2 min(n, m) / (n + m).
    low, high = bounds[0] * dice / (2 - dice), bounds[1] * (2 - dice) / dice
    text = F.col(text_col)
    split = F.split(text, "\n", -1)
    paragraphs = F.split(text, "\n(?:[ \t\r]*\n)+", -1)
    several = F.when(F.size(paragraphs) > 1, F.filter(paragraphs, lambda u: u.contains("\n"))).otherwise(F.array().cast("array<string>"))
    units = F.when(F.size(split) > 1, F.concat(split, several, F.array(text))).otherwise(split)
    # Size bounds before any bigram is made: n words, d of them different, have between d - 1 and n - 1 different bigrams.
    fits = lambda ws: (F.size(ws) >= 1) & (F.greatest(F.size(ws) - 1, F.lit(1)) >= low) & (F.size(F.array_distinct(ws)) - 1 <= high)
    pattern = anchors(texts or TEMPLATES, dice)
    found = F.filter(F.transform(F.filter(units, lambda u: u.rlike(pattern)), words), fits)
    # Exploded from one expression, so that no later filter is pushed below and has it evaluated again.
    rows = docs.where(text.rlike(pattern)).select(F.col(id_col).alias("doc_id"), F.explode(F.transform(found, bigrams)).alias("ub"))
    rows = rows.withColumn("un", F.size("ub"))
    close = (2 * F.least("un", "tn") >= dice * (F.col("un") + F.col("tn")))
    sizes = known.select("license", "tb", "tn", F.explode(F.sequence(F.ceil(F.col("tn") * dice / (2 - dice)).cast("int"), F.floor(F.col("tn") * (2 - dice) / dice).cast("int"))).alias("un"))
    met = rows.join(F.broadcast(sizes), "un").where(close)  # a fixed list, by the sizes that each allows
    met = met.withColumn("dice", 2 * F.size(F.array_intersect("ub", "tb")) / (F.col("un") + F.col("tn"))).where(F.col("dice") >= dice)
    return met.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.count("*").alias("n_units"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _sql() -> str:
    fold = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    pairs = "case when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end"
    values = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in TEMPLATES.items())
    return f"""
with t as (select license, {pairs} as g from (select license, {fold.format('body')} as w from (values {values}) as v(license, body))),
u as (select doc_id, unnest(case when contains(text, chr(10)) then list_concat(list_append(string_split(text, chr(10)), text), case when regexp_matches(text, '\\n[ \\t\\r]*\\n') then list_filter(regexp_split_to_array(text, '\\n(?:[ \\t\\r]*\\n)+'), lambda p: contains(p, chr(10))) else [] end) else [text] end) as u from documents where text is not null),
ug as (select doc_id, {pairs} as g from (select doc_id, {fold.format('u')} as w from u) where len(w) > 0),
m as (select doc_id, license, 2.0 * len(list_intersect(ug.g, t.g)) / (len(ug.g) + len(t.g)) as dice from ug join t on 2 * least(len(ug.g), len(t.g)) >= {DICE} * (len(ug.g) + len(t.g)))
select doc_id, license, cast(max(dice) as double) as dice, count(*) as n_units from m where dice >= {DICE} group by all
"""


OP2_SQL = _sql()
