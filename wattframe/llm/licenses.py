"""License scans: phrases word by word, and templates by an exact set-similarity join with blocks of text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: digits, letters a-z, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose words must stand one after the other, with their labels (fixed values).
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Notices of public licenses, compared as sets of words.
TEMPLATES = (
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                 "compliance with the License"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted "
              "provided that the following conditions are met"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
              "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
)

#: Share of a template's distinct words that a block must hold.
SHARE = (4, 5)
#: Distinct words of all phrases and templates together, at most: their counts pass through the driver.
MAX_WORDS = 10_000
#: Marked words that are looked at together.
RUN = 256


def split(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def needed(size: int, share: tuple[int, int]) -> int:
    """Words that a block must share with a template of ``size`` distinct words."""
    return -(-size * share[0] // share[1])


def stride(templates: Sequence[tuple[str, str]]) -> int:
    """Words from one block's start to the next; a block has twice as many, so a notice lies in one as a whole."""
    return max((len(split(text)) for _, text in templates), default=1)


def _places(marks: Column, label: str, words: list[int]) -> Column:
    """Where in ``marks`` the words stand consecutively."""

    def starts(mark, i):
        found = mark["token"] == words[0]
        for k, word in enumerate(words[1:], 1):
            later = F.get(marks, i + k)
            found = found & F.coalesce((later["token"] == word) & (later["at"] == mark["at"] + k), F.lit(False))
        return F.when(found, F.struct(F.lit(label).alias("label"), mark["at"].cast("bigint").alias("first_word")))

    return F.filter(F.transform(marks, starts), lambda place: place.isNotNull())


def scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    share: tuple[int, int] = SHARE,
) -> DataFrame:
    """``doc_id, n_words, places, blocks`` for each row of ``docs``; ``doc_id`` and ``text`` are read.

    ``places`` has ``label, first_word`` for each place where a phrase's words stand consecutively, in order.
    ``blocks`` has ``label, first_word, shared, size`` for each pair of a block and a template of ``size``
    distinct words of which the block holds ``share`` at least. A block has as many words as two of the longest
    template and starts at every such template's length.

    The join is exact. Words of the templates are ordered by how often all documents use them, the rarest first;
    a block is compared only if one of its first words in that order is among a template's first words (prefix
    filter), if it has enough of the templates' words at all (length filter) and if enough of them follow on both
    sides (position filter). Other words can't be shared and are left out when a text is read, once. The counts
    that pass through the driver are as many as the templates have words, ``MAX_WORDS`` at most. Marked words of
    a document are looked at in runs of ``RUN``, so a long text costs in proportion.

    Nulls: a null text is empty, a null ``doc_id`` stays. Repeated rows are judged each for itself, an empty table
    gives no rows, without phrases or templates their column is empty.
    """
    spark = docs.sparkSession
    vocabulary = sorted({word for _, text in (*phrases, *templates) for word in split(text)})
    if len(vocabulary) > MAX_WORDS:
        raise ValueError(f"phrases and templates have {len(vocabulary)} distinct words, {MAX_WORDS} are allowed")
    token = {word: i for i, word in enumerate(vocabulary)}

    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    rows = docs.select("doc_id", F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("_words"))
    numbered = F.transform("_words", lambda word, i: F.struct(i.alias("at"), word.alias("word")))
    known = F.filter(numbered, lambda n: n["word"].isin(vocabulary)) if vocabulary else F.slice(numbered, 1, 0)
    number = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array(F.lit(""))
    marks = F.transform(known, lambda n: F.struct(
        n["at"].alias("at"), (F.array_position(number, n["word"]) - 1).cast("int").alias("token")))
    rows = cut_lineage(rows.select(
        "doc_id", F.size("_words").cast("bigint").alias("n_words"), marks.alias("_marks"),
        F.monotonically_increasing_id().alias("_row")))

    places = [_places(F.col("_marks"), label, [token[w] for w in split(text)]) for label, text in phrases]
    no_places = F.lit(None).cast("array<struct<label:string,first_word:bigint>>")
    places = F.concat(*places) if places else F.coalesce(no_places, F.array())
    in_order = F.array_sort(F.transform(places, lambda p: F.struct(p["first_word"], p["label"])))
    places = F.transform(in_order, lambda p: F.struct(p["label"].alias("label"), p["first_word"].alias("first_word")))
    rows = rows.withColumn("places", places)
    no_blocks = F.lit(None).cast("array<struct<label:string,first_word:bigint,shared:int,size:int>>")
    if not templates:
        return rows.select("doc_id", "n_words", "places", F.coalesce(no_blocks, F.array()).alias("blocks"))

    found = _similar(spark, rows, [(label, {token[w] for w in split(text)}) for label, text in templates], len(vocabulary),
                     stride(templates), share)
    blocks = F.coalesce(F.array_sort("_blocks"), F.array())
    blocks = F.transform(blocks, lambda b: F.struct(b["label"].alias("label"), b["first_word"].alias("first_word"),
                                                    b["shared"].alias("shared"), b["size"].alias("size")))
    return rows.join(found, "_row", "left").select("doc_id", "n_words", "places", blocks.alias("blocks"))


def _similar(spark, rows: DataFrame, templates: list[tuple[str, set[int]]], n_tokens: int, step: int,
             share: tuple[int, int]) -> DataFrame:
    """``_row, _blocks``: the pairs of a block of that row and a template that share enough words."""
    used = rows.select(F.explode("_marks.token").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    often = {r.token: r.n for r in used.collect()}
    order = sorted(range(n_tokens), key=lambda t: (often.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}

    sets, index, first = [], [], set()
    for label, tokens in templates:
        ranks = sorted(rank[t] for t in tokens)
        least = needed(len(ranks), share)
        prefix = ranks[: len(ranks) - least + 1]
        first |= set(prefix)
        sets.append((label, ranks, least))
        index += [(r, i, len(sets) - 1, len(ranks), least) for i, r in enumerate(prefix)]
    fewest = min(least for _, _, least in sets)

    ranks = F.array(*(F.lit(rank[t]) for t in range(n_tokens)))
    rare = [t for t in range(n_tokens) if rank[t] in first]
    runs = F.sequence(F.lit(0), F.expr(f"CAST((size(_marks) - 1) div {RUN} AS INT)"))
    marked = rows.where(F.exists("_marks", lambda m: m["token"].isin(rare))).select("_row", "_marks", F.explode(runs).alias("_run"))
    begin = F.greatest(F.col("_run") * RUN - 2 * step, F.lit(0))
    marked = marked.select("_row", F.slice("_marks", F.col("_run") * RUN + 1, F.lit(RUN)).alias("_core"),
                           F.slice("_marks", begin + 1, F.lit(RUN + 4 * step)).alias("_near"))
    starts = F.transform(F.filter("_core", lambda m: m["token"].isin(rare)),
                         lambda m: F.array(F.floor(m["at"] / step), F.floor(m["at"] / step) - 1))
    blocks = marked.select("_row", "_near", F.explode(F.array_distinct(F.flatten(starts))).alias("_block")).where("_block >= 0")
    inside = F.filter("_near", lambda m: (m["at"] >= F.col("_block") * step) & (m["at"] < (F.col("_block") + 2) * step))
    held = F.array_sort(F.array_distinct(F.transform(inside, lambda m: F.get(ranks, m["token"]))))
    blocks = blocks.select("_row", "_block", held.alias("_held")).where(F.size("_held") >= fewest)

    lookup = spark.range(1).select(F.inline(F.array(*(
        F.struct(*(F.lit(v).alias(c) for v, c in zip(entry, ("_rank", "_i", "_template", "_size", "_least")))) for entry in index))))
    firsts = F.slice("_held", F.lit(1), F.size("_held") - fewest + 1)
    pairs = blocks.select("_row", "_block", "_held", F.posexplode(firsts).alias("_j", "_rank"))
    pairs = pairs.join(F.broadcast(lookup), "_rank").where(
        "size(_held) >= _least AND least(_size - _i, size(_held) - _j) >= _least")

    of_template = F.array(*(F.array(*map(F.lit, s)) for _, s, _ in sets))
    labels = F.array(*(F.lit(label) for label, _, _ in sets))
    shared = F.size(F.array_intersect("_held", F.get(of_template, F.col("_template"))))
    pairs = pairs.withColumn("_shared", shared).where("_shared >= _least")
    entry = F.struct((F.col("_block") * step).alias("first_word"), F.get(labels, F.col("_template")).alias("label"),
                     F.col("_shared").alias("shared"), F.col("_size").alias("size"))
    return pairs.groupBy("_row").agg(F.collect_set(entry).alias("_blocks"))
