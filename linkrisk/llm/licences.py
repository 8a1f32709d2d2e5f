"""Licence scans by Dice coefficient over word bigrams, in DataFrame functions alone.

Every line of a document, and its whole text, is normalised (lower case, runs of other characters
than a-z and 0-9 made one space) and cut into the set of its word bigrams. A template with b bigrams
can reach the coefficient t only against a set of b*t/(2-t) to b*(2-t)/t bigrams; templates outside
these bounds are pruned before any set is compared.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statements by which public licences are named or granted.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def normal_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(words: Column) -> Column:
    """The distinct bigrams of an array of words; fewer than two words have none."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(n > 1, pairs).otherwise(F.array().cast("array<string>")))


def template_bigrams(templates) -> list[tuple[str, list[str]]]:
    out = []
    for name, text in templates:
        words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        out.append((name, list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))))
    return out


def scan_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, templates=TEMPLATES) -> DataFrame:
    """Lines that match: the id, line (from 0; -1 for the whole text, which stands for its line where there is only one), licence, dice.

    Of several templates the one with the largest coefficient counts, of equal ones the first by
    licence name. Null and empty texts have no lines.
    """
    sets = template_bigrams(templates)
    low = F.lit(threshold / (2 - threshold) - 1e-9)
    lines = F.split("_text", "\n")
    units = F.concat(F.array(F.col("_text")), F.when(F.size(lines) > 1, lines).otherwise(F.array().cast("array<string>")))
    # Each explode() of one value is a barrier: the optimizer would else copy what stands below into
    # every place that reads it.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).select("_id", F.posexplode_outer(units).alias("line", "_unit"))
    rows = rows.select("_id", "line", F.explode(F.array(F.split(normal_words(F.col("_unit")), " "))).alias("_w")).where(F.size("_w") - 1 >= low * min(len(x) for _, x in sets))
    rows = rows.select("_id", "line", F.explode(F.array(bigrams(F.col("_w")))).alias("_b"))
    n = F.size("_b")
    known = F.array(*(F.struct(F.lit(k).alias("licence"), F.lit(len(x)).alias("n"), F.array(*map(F.lit, x)).alias("pairs")) for k, x in sets))
    fits = F.filter(known, lambda t: (n >= low * t["n"]) & (n * low <= t["n"]))
    scored = F.transform(fits, lambda t: F.struct((F.lit(-2.0) * F.size(F.array_intersect(t["pairs"], F.col("_b"))) / (t["n"] + n)).alias("worse"), t["licence"].alias("licence")))
    rows = rows.select("_id", "line", F.explode(F.array(F.array_min(scored))).alias("_best")).where(F.col("_best.worse") <= -threshold)
    return rows.select(
        F.col("_id").alias(id_col), (F.col("line") - 1).alias("line"), F.col("_best.licence").alias("licence"), (-F.col("_best.worse")).alias("dice")
    )


def scan_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, templates=TEMPLATES) -> DataFrame:
    """One row per id that has a match: its number of matching lines, the licence of the best line
    and its coefficient. Ties go to the first licence by name.

    Rows of one id are one document whose lines are those of all its rows, so a repeated row counts
    its matches again; rows with a null id are one document too. Null and empty texts have no match,
    texts of any length are scanned whole, an empty table gives an empty result, and other columns
    are not read, so none can clash."""
    found = scan_lines(docs, id_col=id_col, text_col=text_col, threshold=threshold, templates=templates)
    best = F.min(F.struct((-F.col("dice")).alias("worse"), F.col("licence").alias("licence")))
    return found.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_matches"), best.alias("_best")).select(
        id_col, "n_matches", F.col("_best.licence").alias("licence"), F.round(-F.col("_best.worse"), 6).alias("dice")
    )
