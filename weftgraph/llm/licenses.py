"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Everything is a DataFrame expression. A template of n shingles (five words, or all words of a shorter template) is looked for in windows of 2n shingles
that start every n/2 (rounded up), so that a notice with up to half as many words again lies in one of them. Each of
``BANDS`` bands is one MinHash: a band retrieves a template when the window's minimum is the template's. A window
that holds four fifths of a template has a Jaccard similarity of at least 0.36 with it and is missed by all 32 bands
with a probability below 1e-6. Since a band can only agree where the template's minimum itself occurs in the window, the
windows looked at are those around such shingles; documents without one cannot collide and leave at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, BANDS = 5, 32

# Short notices and opening clauses of public licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

# Notices of fewer than five words; one is a single shingle. They are numbered after TEMPLATES.
NOTICES: tuple[tuple[str, str], ...] = (("All-rights-reserved", "All rights reserved."),)


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case; null texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """64-bit hashes of all runs of k words; null texts have none."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    runs = F.transform(
        F.array(hashed),
        lambda h: F.when(
            F.size(h) >= k,
            F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return F.get(runs, F.lit(0))


def minima(of: Column) -> Column:
    """The shingle that is smallest under each band's hash function, one for each band."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)),
        lambda k: F.array_min(F.transform(of, lambda x: F.struct(F.xxhash64(x, k).alias("h"), x.alias("x"))))["x"],
    )


def template_table(spark, templates: tuple[tuple[str, str], ...] = TEMPLATES + NOTICES) -> DataFrame:
    """Number, license, words of a shingle, distinct shingles, MinHash shingles, window and step of each template.

    A template without a word raises ValueError.
    """
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    rows = rows.withColumn("k", F.least(F.lit(SHINGLE), F.size(words(F.col("text")))))
    if empty := rows.where("k = 0").select("license").collect():
        raise ValueError(f"templates without a word: {[r.license for r in empty]}")
    its = F.coalesce(*[F.when(F.col("k") == k, F.array_distinct(shingles(F.col("text"), k))) for k in range(1, SHINGLE + 1)])
    rows = rows.select("template", "license", "k", its.alias("its"))
    return rows.select(
        "*", minima(F.col("its")).alias("its_minima"), (2 * F.size("its")).alias("window"), F.ceil(F.size("its") / 2).cast("int").alias("step"),
    )


def scan_licenses(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + NOTICES, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Templates found in each document: doc_id, template, license, containment, first_word, n_windows.

    A row says that some window of the whole text holds at least ``containment`` of the template's distinct shingles:
    the largest such part, the first word of the first window that reaches it, and how many windows pass. Nulls: a
    null text holds nothing, a null id is reported as null. Rows of one id are reported together. A template of
    fewer than five words is one shingle, found only whole; a text of fewer words than a template's shingle holds none of it.
    A template without a word raises ValueError. Extra columns are not read; an empty table, or no template, gives no rows.
    """
    table = template_table(docs.sparkSession, templates)
    widths = sorted(r.k for r in table.select("k").distinct().collect()) or [SHINGLE]
    passed = None
    for k in widths:
        found = _passed(docs, table.where(F.col("k") == k), k, containment, id_col, text_col)
        passed = found if passed is None else passed.unionByName(found)
    return passed.groupBy("doc_id", "template", "license").agg(
        F.max("part").alias("containment"),
        F.min(F.struct(-F.col("part"), F.col("first_word").alias("at")))["at"].alias("first_word"),
        F.count_distinct("first_word").alias("n_windows"),
    )


def _passed(docs: DataFrame, table: DataFrame, k: int, containment: float, id_col: str, text_col: str) -> DataFrame:
    """Windows of k-word shingles that hold enough of a template of the table."""
    keys = sorted({x for r in table.select("its_minima").collect() for x in r[0]})  # templates times bands at most
    marks = table.select("*", F.explode(F.array_distinct("its_minima")).alias("mark"))
    runs = docs.select(F.col(id_col).cast("long").alias("doc_id"), shingles(F.col(text_col), k).alias("runs"))
    near = runs.where(F.exists("runs", lambda x: x.isin(keys) if keys else F.lit(False)))
    hits = near.select("doc_id", "runs", F.posexplode("runs").alias("pos", "mark")).join(F.broadcast(marks), "mark")
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - F.col("window") + 1) / F.col("step")).cast("int"))
    last = F.floor(F.col("pos") / F.col("step")).cast("int")
    windows = hits.select(
        "doc_id", "template", "license", "its", "its_minima", "runs", "window", "step", F.explode(F.sequence(first, last)).alias("nth")
    ).select(
        "doc_id", "template", "license", "its", "its_minima", (F.col("nth") * F.col("step")).alias("first_word"),
        F.slice("runs", F.col("nth") * F.col("step") + 1, F.col("window")).alias("held"),
    )
    agreed = windows.where(F.exists(F.arrays_zip(minima(F.col("held")).alias("a"), F.col("its_minima").alias("b")), lambda z: z["a"] == z["b"]))
    part = F.size(F.array_intersect("its", "held")) / F.size("its")
    return agreed.select("doc_id", "template", "license", "first_word", part.alias("part")).where(F.col("part") >= containment)
