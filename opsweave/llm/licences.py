"""Licence scan: Dice coefficient over word bigrams against licence templates.

Lines, paragraphs and whole texts are units.  Dice over bigram multisets is
2 * common / (a + b), with a and b the units' numbers of bigrams, so a template of b
bigrams can only reach the threshold t with t / (2 - t) * b <= a <= (2 - t) / t * b.
Units outside all templates' bounds are dropped before bigrams are built, and each
remaining unit meets only the templates within its bounds.  All of it is expressions
within a row: no join and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.75

# Wording of public licences and of the notices that refer to them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
)


def _bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams with which a unit can reach the threshold."""
    ratio = threshold / (2 - threshold)
    return int(-(-n * ratio // 1)), int(n / ratio)


def template_rows(templates: Sequence[tuple[str, str]], threshold: float) -> list[tuple[str, list[str], int, int]]:
    rows = []
    for name, text in templates:
        grams = _bigrams(text)
        if grams:
            rows.append((name, grams, *size_bounds(len(grams), threshold)))
    return rows


def scan_licences(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and ``found``: (licence, dice) of each licence of a row of (doc_id, text), best first.

    A licence has the best Dice of its templates over the row's units; ties between
    licences go by name.  Null and empty texts, and texts without letters a-z or digits, find
    nothing.  Rows are independent: repeated rows and null ids give a row each.
    """
    rows = template_rows(templates, threshold)
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(low).alias("low"), F.lit(high).alias("high")) for name, grams, low, high in rows])
    low, high = min(r[2] for r in rows), max(r[3] for r in rows)
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9\n]+", " ")
    lines, paragraphs = F.split(F.col("_plain"), "\n"), F.split(F.col("_plain"), "\n *\n")
    units = F.array_distinct(F.concat(lines, F.transform(paragraphs, lambda p: F.translate(p, "\n", " ")), F.array(F.translate(F.col("_plain"), "\n", " "))))
    words = F.filter(F.transform(units, lambda u: F.split(F.trim(u), " +")), lambda w: (F.size(w) - 1).between(low, high))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1))))

    def occurrences(array: Column, gram: Column) -> Column:
        return F.size(F.filter(array, lambda x: x == gram))

    def common(a: Column, b: Column) -> Column:
        return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, g: n + F.least(occurrences(a, g), occurrences(b, g)))

    def against(unit: Column) -> Column:
        fitting = F.filter(known, lambda t: F.size(unit).between(t["low"], t["high"]))
        return F.transform(fitting, lambda t: F.struct((2.0 * common(unit, t["grams"]) / (F.size(unit) + F.size(t["grams"]))).alias("dice"), t["name"].alias("name")))

    scored = F.filter(F.flatten(F.transform(F.col("_grams"), against)), lambda s: s["dice"] >= threshold)
    names = F.array_distinct(F.transform(F.col("_scored"), lambda s: s["name"]))
    best = F.transform(names, lambda n: F.struct((-F.array_max(F.transform(F.filter(F.col("_scored"), lambda s: s["name"] == n), lambda s: s["dice"]))).alias("minus"), n.alias("name")))
    return (
        docs.select("doc_id", plain.alias("_plain"))
        .select("doc_id", grams.alias("_grams"))
        .select("doc_id", scored.alias("_scored"))
        .select("doc_id", F.transform(F.array_sort(best), lambda b: F.struct(b["name"].alias("licence"), (-b["minus"]).alias("dice"))).alias("found"))
    )


def licence_digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_licences, best licence with its Dice, and all licences in order."""
    first = F.get(F.col("found"), F.lit(0))
    return scanned.select(
        "doc_id",
        F.size("found").cast("long").alias("n_licences"),
        first["licence"].alias("best_licence"),
        F.round(first["dice"], 9).alias("best_dice"),
        F.array_join(F.transform("found", lambda f: f["licence"]), ",").alias("licences"),
    )


def oracle(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The digest in SQL, over exploded units instead of nested expressions."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({quoted(name)}, [{', '.join(map(quoted, grams))}], {low}, {high})" for name, grams, low, high in template_rows(templates, threshold))
    return rf"""
WITH templates(licence, grams, low, high) AS (VALUES {values}),
plain AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') AS p FROM documents),
units AS (
  SELECT doc_id, unnest(string_split(p, chr(10))) AS u FROM plain
  UNION SELECT doc_id, replace(unnest(string_split_regex(p, '\n *\n')), chr(10), ' ') FROM plain
  UNION SELECT doc_id, replace(p, chr(10), ' ') FROM plain),
worded AS (SELECT doc_id, string_split_regex(trim(u), ' +') AS w FROM units),
grammed AS (
  SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM worded WHERE len(w) > 1),
scored AS (
  SELECT doc_id, licence, max(CAST(2 AS DOUBLE) * list_sum(list_transform(list_intersect(g, grams),
      lambda x: least(len(list_filter(g, lambda y: y = x)), len(list_filter(grams, lambda y: y = x))))) / (len(g) + len(grams))) AS dice
  FROM grammed JOIN templates ON len(g) BETWEEN low AND high AND len(list_intersect(g, grams)) > 0
  GROUP BY doc_id, licence),
best AS (SELECT * FROM scored WHERE dice >= {threshold})
SELECT d.doc_id, count(b.licence) AS n_licences, arg_min(b.licence, (-b.dice, b.licence)) AS best_licence,
  round(max(b.dice), 9) AS best_dice, coalesce(string_agg(b.licence, ',' ORDER BY b.dice DESC, b.licence), '') AS licences
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id GROUP BY d.doc_id
"""
