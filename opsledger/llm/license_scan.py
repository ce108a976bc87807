"""License scan: phrase places, and text blocks that contain a license template.

Base places are runs of consecutive words equal to a phrase. The method's
labels come from an exact set-similarity join between text blocks and license
templates: a block matches when it holds at least ``containment`` of a
template's distinct words.

- Global order: the template vocabulary is ordered by document frequency over
  the whole corpus, rarest first, ties by word.
- Length filter: a block must hold at least ``need = ceil(containment * size)``
  vocabulary words.
- Prefix filter: a match shares one of the first ``size - need + 1`` words of
  the template's order; a document without one is never cut into blocks.
- Positional filter: the first shared word at places i and j leaves at most
  ``1 + min(rest of template, rest of block)`` common words.
- What is left is counted in full.

Blocks are windows of twice the longest template's words, stepping by its
length, so every run of that many words lies in some block. Null text is
empty; repeated rows are scanned one by one by a generated row key, so equal
``doc_id`` values never mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsledger.llm.common import table

# fixed values: phrases and labels of the base rule
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# fixed values: opening notices of public licenses, by label
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. "
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Characters that end a word, before lower-casing A-Z: ASCII without digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _spaced(text: Column) -> Column:
    """`` w1 w2 ... wn `` with one blank around every word; one blank for no words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BREAK, " ")), F.lit(" "))


def _words_in(spaced: Column) -> Column:
    """Number of words of a part ``w1 w2 ... wn`` that ends with a blank or is empty."""
    return (F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))).cast("long")


def base_places(spaced: Column, phrases=PHRASES) -> dict[str, Column]:
    """n_base, first_word, last_word and the array of base labels, from ``_spaced`` text.

    A pattern takes only the blank before a phrase, so overlapping places count.
    """
    any_of = "|".join(p for p, _ in phrases)
    hit = spaced.rlike(f"(?i) (?:{any_of}) ")
    count = sum((F.regexp_count(spaced, F.lit(f"(?i) (?={p} )")) for p, _ in phrases), F.lit(0))
    first = F.regexp_extract(spaced, f"(?is)^(.*?) (?={'|'.join(f'{p} ' for p, _ in phrases)})", 1)
    last = F.regexp_extract(spaced, f"(?is)^(.*) (?={'|'.join(f'{p} ' for p, _ in phrases)})", 1)
    labels = F.array_compact(F.array(*[F.when(spaced.rlike(f"(?i) {p} "), F.lit(x)) for p, x in phrases]))
    return {"n_base": F.when(hit, count).otherwise(F.lit(0)).cast("long"),
            "first_word": F.when(hit, _words_in(first)), "last_word": F.when(hit, _words_in(last)),
            "base_found": F.when(hit, labels).otherwise(F.array().cast("array<string>"))}


def template_words(text: str) -> list[str]:
    """Words of a template by the same rule (templates are ASCII)."""
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def scan(docs: DataFrame, containment: float = 0.85, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per document: n_words, base places, ``found`` (method labels) and ``best`` containment.

    Needs columns doc_id and text.
    """
    spark = docs.sparkSession
    sets = [(label, sorted(set(template_words(text)))) for label, text in templates]
    need = [math.ceil(containment * len(ws) - 1e-9) for _, ws in sets]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    span = max(len(template_words(text)) for _, text in templates)

    spaced = docs.select("doc_id", _spaced(F.col("text")).alias("_s")).withColumn("_row", F.monotonically_increasing_id())
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(F.lower("_s"), " "))
    # template words are few and known, so each document keeps only those it holds
    first = table(spaced.select(
        "doc_id", "_row", F.when(F.col("_s") == "  ", F.lit(0)).otherwise(_words_in(F.col("_s")) - 1).cast("long").alias("n_words"),
        *[c.alias(n) for n, c in base_places(F.col("_s"), phrases).items()], held.alias("_held"),
        F.when(F.size(held) >= min(need), F.col("_s")).alias("_s")), "license")
    # at most one row per template word
    seen = {r["w"]: r["n"] for r in first.select(F.explode("_held").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    ranked = [sorted(ws, key=order.index) for _, ws in sets]
    prefix = [ws[:len(ws) - n + 1] for ws, n in zip(ranked, need)]

    likely = F.lit(False)
    for ws, p, n in zip(ranked, prefix, need):
        likely = likely | (F.arrays_overlap("_held", F.array(*map(F.lit, p)))
                           & (F.size(F.array_intersect("_held", F.array(*map(F.lit, ws)))) >= n))
    words = F.array_remove(F.split(F.lower("_s"), " "), "")
    blocks = (first.filter(F.col("_s").isNotNull()).filter(likely).select("_row", words.alias("_w"))
              .select("_row", "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(span))).alias("at"))
              .select("_row", "at", F.array_intersect(F.array(*map(F.lit, order)), F.slice("_w", F.col("at") + 1, F.lit(2 * span))).alias("b")))
    # bounded by the templates given as a parameter
    lists = F.broadcast(spark.createDataFrame(
        [(w, t, i, len(ranked[t]), need[t], ranked[t], sets[t][0]) for t, p in enumerate(prefix) for i, w in enumerate(p)],
        "w string, t int, i int, size int, need int, ws array<string>, label string"))
    pairs = (blocks.select("_row", "at", "b", F.posexplode("b").alias("j", "w"))
             .filter(F.size("b") - F.col("j") >= min(need))
             .join(lists, "w")
             .filter(1 + F.least(F.col("size") - F.col("i") - 1, F.size("b") - F.col("j") - 1) >= F.col("need"))
             .dropDuplicates(["_row", "at", "t"])
             .withColumn("common", F.size(F.array_intersect("b", "ws")))
             .filter(F.col("common") >= F.col("need")))
    found = pairs.groupBy("_row").agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.col("size")).alias("best"))
    # the documents that hold a template: written, so the join knows how few or many they are
    return first.drop("_held", "_s").join(table(found, "found"), "_row", "left").drop("_row")


def license_scan(docs: DataFrame) -> DataFrame:
    """The digest of ``op8``. ``score``: 1 with a base place, else the best containment, else 0."""
    out = scan(docs.select("doc_id", "text"))
    none = F.array().cast("array<string>")
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("base_found")).alias("base_labels"),
        text(F.concat("base_found", F.coalesce("found", none))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
