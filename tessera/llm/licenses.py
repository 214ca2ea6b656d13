"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A template is a set of words; a block of text is a window of ``2 s`` words that begins at a multiple of ``s``, where
``s`` is the template's length in words rounded up to a power of two, so every stretch of a template's length lies whole
in some block. All blocks are found that hold at least ``threshold`` of a template's distinct words.

Words are ordered by how often they occur in all documents, rarest first. A block that holds ``c`` of a template's ``n``
words holds one of its first ``n - c + 1`` (prefix filter), so documents are joined with templates on those words alone;
they must hold ``c`` words of the templates (length filter), and the places of the first common word in both orders
must leave room for ``c`` (positional filter). What is left is intersected. Every occurrence carries the words around it,
so candidates are checked where they are found: texts are never shuffled; a document's counts and what was found in it
meet in one narrow row. Words outside of all templates cannot count and have no place in the order.

Cases: a null or empty text has no words; repeated rows get equal results, null ids too; very long texts are scanned
whole; a phrase or template that stands many times is counted at each place, labels once; extra columns are ignored; an
empty table gives no rows; an empty list of templates leaves the phrases.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of the base scan and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Notices by which works name their license, under the licenses' usual short names.
TEMPLATES = [
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-notice",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mit-release", "Released under the MIT License."),
    (
        "mit-notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "bsd-notice",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Distinct words of all templates together, which plans hold; more raise an error.
MAX_WORDS = 20_000
_WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text as they stand; none of a null. ``folded`` lower-cases their A-Z where it matters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def folded(word: Column) -> Column:
    return F.translate(word, _UPPER, _LOWER)


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def maybe(word: Column, wanted: Sequence[str]) -> Column:
    """Whether a word may fold to one of ``wanted``: quicker than folding it, and true for a few others too."""
    return F.lower(word).isin(*wanted)


def phrase_places(words: Column, places: Column, phrases: Sequence[tuple[str, str]] = PHRASES) -> Column:
    """Array of (label, start): every place among ``places`` where a phrase's words stand one after another."""

    def stands(i: Column, phrase: list[str]) -> Column:
        whole = F.lit(True)
        for k, w in enumerate(phrase):
            whole = whole & folded(F.get(words, i + k)).eqNullSafe(F.lit(w))
        return whole

    def found(phrase: list[str], label: str) -> Column:
        return F.transform(F.filter(places, lambda i: stands(i, phrase)), lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))

    none = F.array().cast("array<struct<label:string,start:bigint>>")
    return F.concat(none, *(found(template_words(p), label) for p, label in phrases))


def occurrences(documents: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """How often each word of a bounded ``vocabulary`` occurs in all documents."""
    each = documents.select(F.explode(F.filter(words_of(F.col("text")), lambda w: maybe(w, vocabulary))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    each = each.groupBy(folded(F.col("word")).alias("word")).agg(F.sum("n").alias("n")).where(F.col("word").isin(*vocabulary))
    return {r.word: r.n for r in each.collect()}  # one row a word


def order_templates(documents: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> tuple[list[str], list[tuple]]:
    """The vocabulary, rarest first, and (label, words in this order, needed words, step of blocks) of each template."""
    split = [(label, template_words(text)) for label, text in templates]
    vocabulary = sorted({w for _, words in split for w in words})
    if len(vocabulary) > MAX_WORDS:
        raise ValueError(f"templates hold {len(vocabulary)} distinct words; a plan takes {MAX_WORDS}")
    often = occurrences(documents, vocabulary) if vocabulary else {}
    vocabulary.sort(key=lambda w: (often.get(w, 0), w))
    rank = {w: k for k, w in enumerate(vocabulary)}
    out = []
    for label, words in split:
        own = sorted(set(words), key=rank.__getitem__)
        if own:
            out.append((label, own, needed(len(own), threshold), 1 << (len(words) - 1).bit_length()))
    return vocabulary, out


def needed(n: int, threshold: float) -> int:
    """The least number of ``n`` words whose share reaches the threshold."""
    return max(1, math.ceil(threshold * n - 1e-9))


def text_of(words: Sequence[str]) -> Column:
    """A constant array of words (words hold no spaces)."""
    return F.split(F.lit(" ".join(words)), " ")


def prefix_table(documents: DataFrame, ordered: list[tuple]) -> DataFrame:
    """(label, words, need, step, word): the first words of each template, by which blocks are looked up."""
    rows = [F.struct(F.lit(label).alias("label"), text_of(own).alias("words"), F.lit(need).alias("need"), F.lit(step).alias("step")) for label, own, need, step in ordered]
    templates = documents.sparkSession.range(1).select(F.inline(F.array(*rows)))
    return templates.select("*", F.explode(F.slice("words", F.lit(1), F.size("words") - F.col("need") + 1)).alias("word"))


def scan_licenses(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = 0.9) -> DataFrame:
    """(doc_id, n_words, base, found) of every row of ``documents`` (doc_id, text), each in order.

    ``base`` is the array of (label, start) of phrases, ``found`` that of (label, start, shared, n) of blocks: which
    template, the block's first word, and how many of the template's n distinct words it holds.
    """
    vocabulary, ordered = order_templates(documents, templates, threshold)
    lookup = sorted({w for _, own, need, _ in ordered for w in own[: len(own) - need + 1]})
    heads = sorted({template_words(p)[0] for p, _ in phrases})
    rows = documents.select("doc_id", F.monotonically_increasing_id().alias("_row"), words_of(F.col("text")).alias("_words"))
    marks = F.filter(F.transform("_words", lambda w, i: F.when(maybe(w, [*lookup, *heads]), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_places", marks)
    kind = "array<struct<word:string,at:bigint,from:bigint,around:array<string>>>"
    if ordered:
        # Each place of a word of the lookup, with the words around it; ``from`` is the place of the first of them.
        reach = 2 * max(step for *_, step in ordered)
        places = F.filter("_places", lambda i: folded(F.get("_words", i)).isin(*lookup))
        first = lambda i: F.greatest(i - reach, F.lit(0))
        near = F.transform(places, lambda i: F.struct(folded(F.get("_words", i)).alias("word"), i.cast("long").alias("at"), first(i).cast("long").alias("from"), F.transform(F.slice("_words", first(i) + 1, F.lit(2 * reach)), folded).alias("around")))
    else:
        near = F.array().cast(kind)
    # The first row of a document carries what needs no template; it stays, whatever is found.
    rows = rows.select("doc_id", "_row", F.size("_words").cast("long").alias("n_words"), F.array_sort(phrase_places(F.col("_words"), F.col("_places"), phrases)).alias("base"), near.alias("_near"))
    hits = rows.select("*", F.explode(F.concat(F.array(F.lit(None)).cast(kind), "_near")).alias("_hit")).drop("_near")
    alone = F.col("_hit").isNull()
    hits = hits.withColumn("base", F.when(alone, F.col("base"))).select("doc_id", "_row", "n_words", "base", F.col("_hit.word").alias("word"), "_hit.at", "_hit.from", "_hit.around")
    if ordered:
        hits = hits.join(F.broadcast(prefix_table(documents, ordered)), "word", "left")  # a row for each word of a prefix: MAX_WORDS bounds it
        k = F.floor(F.col("at") / F.col("step"))
        hits = hits.withColumn("_block", F.explode(F.when(k > 0, F.array(k - 1, k)).otherwise(F.array(k)))).withColumn("start", F.col("_block") * F.col("step"))
        # Those of the templates' words that the block holds, rarest first.
        block = F.slice("around", (F.col("start") - F.col("from")).cast("int") + 1, 2 * F.col("step"))
        hits = hits.withColumn("_own", F.array_intersect(text_of(vocabulary), block)).where(F.col("word").isNull() | (F.size("_own") >= F.col("need")))
        p, j = F.array_position("words", F.col("word")) - 1, F.array_position("_own", F.col("word")) - 1
        room = F.least(p, j) + F.least(F.size("words") - p, F.size("_own") - j)
        hits = hits.where(F.col("word").isNull() | (room >= F.col("need"))).withColumn("_shared", F.array_intersect("words", "_own"))
        hits = hits.where(F.col("word").isNull() | (F.size("_shared") >= F.col("need")) & (F.get("_shared", F.lit(0)) == F.col("word")))
        found = F.struct("label", "start", F.size("_shared").alias("shared"), F.size("words").alias("n"))
    else:
        found = F.lit(None).cast("struct<label:string,start:bigint,shared:int,n:int>")
    per = hits.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("base", ignorenulls=True).alias("base"), F.array_sort(F.collect_set(F.when(F.col("word").isNotNull(), found))).alias("found"))
    return per.select("doc_id", "n_words", "base", "found")
