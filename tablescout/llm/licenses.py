"""License scans: passages against templates by the Dice coefficient of word bigrams, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.session import small_frame

DICE = 0.8

# Notices and paragraphs of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
            "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                "Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies."),
]

_WORD = r"[\p{L}\p{N}]+"


def _bigrams(text: str):
    """Distinct pairs of neighbouring words in lower case, without punctuation."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(_WORD), F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def _templates(spark, templates) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    return small_frame(spark, rows, "template int, license string, notice string").withColumn("pairs", _bigrams("notice"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """Licences found in ``docs(doc_id, text)``: ``doc_id, license, n_passages, dice`` (the best), a row for each document and licence.

    A passage is a line, a block of lines without an empty one, or the whole text; equal passages of a text count once. It carries a licence
    if the Dice coefficient of its distinct word bigrams and a template's is ``dice`` or more. As the coefficient is at most ``2 min / (a + b)``
    of the two sizes, passages of sizes that fit no template are dropped before any bigram is compared, and others meet fitting templates only.
    Texts that are null, empty or hold no licence give no row; rows of a repeated ``doc_id`` count together; null ids are one document.
    """
    known = _templates(docs.sparkSession, templates)
    fit = dice / (2 - dice)
    sizes = sorted({r.n for r in known.select(F.size("pairs").alias("n")).distinct().collect() if r.n})  # of the templates
    bounds = " or ".join(f"size(pairs) between {fit * n - 1e-9} and {n / fit + 1e-9}" for n in sizes) or "false"
    lines, blocks = F.split("text", "\n"), F.split("text", r"\n\s*\n")
    passages = F.array_distinct(F.concat(lines, blocks, F.array("text")))
    found = docs.select("doc_id", F.explode(passages).alias("passage")).withColumn("pairs", _bigrams("passage")).where(bounds)
    found = found.select("doc_id", F.xxhash64("passage").alias("at"), F.size("pairs").alias("n"), F.explode("pairs").alias("pair"))
    marks = F.broadcast(known.select("template", "license", F.size("pairs").alias("m"), F.explode("pairs").alias("pair")))
    shared = found.join(marks, "pair").where(f"n between {fit} * m - 1e-9 and m / {fit} + 1e-9")
    shared = shared.groupBy("doc_id", "at", "n", "template", "license", "m").agg(F.countDistinct("pair").alias("both"))
    scored = shared.withColumn("dice", F.round(2 * F.col("both") / (F.col("n") + F.col("m")), 9)).where(F.col("dice") >= dice)
    return scored.groupBy("doc_id", "license").agg(F.countDistinct("at").alias("n_passages"), F.max("dice").alias("dice"))


def oracle(dice: float = DICE) -> str:
    """The same in SQL, without the bounds."""
    values = ",\n".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))

    def pairs(text):
        words = f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"
        return f"list_distinct(list_transform(generate_series(1, len({words}) - 1), lambda i: {words}[i] || ' ' || {words}[i + 1]))"

    return f"""WITH templates(template, license, notice) AS (VALUES {values}),
marks AS MATERIALIZED (SELECT template, license, len(p) AS m, unnest(p) AS pair FROM (SELECT *, {pairs("notice")} AS p FROM templates)),
passages AS (SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)) || string_split_regex(text, '\\n\\s*\\n') || [text])) AS passage FROM documents),
words AS (SELECT doc_id, passage, regexp_extract_all(lower(passage), '[\\p{{L}}\\p{{N}}]+') AS w FROM passages),
sized AS (SELECT doc_id, passage, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM words),
found AS (SELECT doc_id, passage, len(p) AS n, unnest(p) AS pair FROM sized),
scored AS (SELECT doc_id, passage, license, round(2 * count(DISTINCT pair) / (n + m), 9) AS dice FROM found JOIN marks USING (pair) GROUP BY doc_id, passage, n, template, license, m)
SELECT doc_id, license, count(DISTINCT passage) AS n_passages, max(dice) AS dice FROM scored WHERE dice >= {dice} GROUP BY doc_id, license"""
