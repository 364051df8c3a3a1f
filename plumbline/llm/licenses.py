"""License scans: every block of text that holds a license template, by an exact set-similarity join.

Texts are cut into blocks of ``BLOCK`` words, each starting half a block after the one before, so any passage of up to half
a block and a word stands whole in one of them. A block meets a template if it holds at least ``CONTAINMENT`` percent of
the template's distinct words. Words are ordered by the number of documents that hold them, rarest first, counted over all
documents. Blocks and templates meet on the words of their prefixes (so few that one must be shared), if both are long
enough, and if enough words are left after the shared positions; a pair is counted once, at its rarest common word.
Words that no template holds can't be shared, so blocks are sets of template words.

Beside the join, phrases that name a license are found where their words stand consecutively.

DataFrame functions only. Templates and phrases are parameters of at most ``MOST_WORDS`` words together, which bounds what
is broadcast; documents join what was found in them by the digest of their text, salted so that copies of one text are
spread over ``SALT`` tasks.

Defined cases: null and empty texts have no words, no labels and score 0; an empty table gives an empty result; repeated
rows each give their result, a null or repeated id included, as nothing is joined by id; long texts are cut into blocks
and read whole; ties in frequency are ordered by the word; other columns pass through, added ones get the prefix
``license_`` and replace columns of these names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a block; passages of up to BLOCK // 2 + 1 words stand whole in one.
BLOCK = 128
#: Percent of a template's distinct words that a block has to hold.
CONTAINMENT = 90
#: Words of all templates together, at most: they are broadcast.
MOST_WORDS = 20_000
#: Tasks over which documents with one and the same text are spread.
SALT = 16
#: Score of a document that names a license but holds no template.
NAMED = 0.5

#: A word of lowered text: digits, a-z and everything beyond ASCII. (The class said by what it leaves out is ten times slower.)
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: The wording of public licenses and of their customary notices.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
            "not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
)


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case; null counts as empty."""
    full = F.coalesce(text, F.lit(""))
    return F.when(full.rlike(r"[^\x00-\x7F]"), F.translate(full, _UPPER, _LOWER)).otherwise(F.lower(full))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def tokens_of(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if c in _UPPER else c for c in text))


def _literal(tokens: list[str]) -> Column:
    return F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>")


def needed(size: int, containment: int = CONTAINMENT) -> int:
    """How many of a template's ``size`` words a block has to hold."""
    return max(1, -(-size * containment // 100))


def ordered(docs: DataFrame, vocabulary: list[str], text: str = "text") -> list[str]:
    """``vocabulary`` by the number of documents holding each word, rarest first; ties by the word."""
    held = docs.select(F.explode(F.array_intersect(_literal(vocabulary), words(F.col(text)))).alias("word"))
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}  # at most MOST_WORDS rows
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def blocks(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """``keep``, block (its first word), tokens: all blocks of every text; one empty block for a text without words."""
    rows = docs.select(*keep, words(F.col(text)).alias("__words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("__words") - block // 2 - 1, F.lit(0)), F.lit(block // 2))
    cut = F.transform(starts, lambda s: F.struct(s.alias("block"), F.slice("__words", s + 1, block).alias("tokens")))
    return rows.select(*keep, F.inline(cut))


def matches(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), templates=TEMPLATES,
            containment: int = CONTAINMENT, block: int = BLOCK) -> DataFrame:
    """``keep``, block, template (its number), overlap: every block that holds ``containment`` percent of a template.

    One row per pair. Templates without words match nothing.
    """
    sets = [sorted(set(tokens_of(t))) for _, t in templates]
    vocabulary = sorted(set().union(*sets)) if sets else []
    if sum(map(len, sets)) > MOST_WORDS:
        raise ValueError(f"templates hold more than {MOST_WORDS} words")
    order = ordered(docs, vocabulary, text) if vocabulary else []
    place = {w: i for i, w in enumerate(order)}
    index = []
    for number, tokens in enumerate(sets):
        tokens = sorted(tokens, key=place.__getitem__)
        need = needed(len(tokens), containment)
        index += [F.struct(F.lit(t).alias("token"), F.lit(i).alias("i"), F.lit(number).alias("template"),
                           F.lit(need).alias("need"), _literal(tokens).alias("wanted"))
                  for i, t in enumerate(tokens[:len(tokens) - need + 1])]
    least = min((needed(len(s), containment) for s in sets if s), default=1)
    cut = blocks(docs, text, keep, block).select(*keep, "block", F.array_intersect(_literal(order), "tokens").alias("held"))
    long_enough = cut.where(F.size("held") >= least)
    prefix = F.posexplode(F.slice("held", 1, F.size("held") - least + 1)).alias("j", "token")
    heads = long_enough.select(*keep, "block", "held", prefix)
    none = "array<struct<token:string,i:int,template:int,need:int,wanted:array<string>>>"
    wanted = docs.sparkSession.range(1).select(F.inline(F.array(*index) if index else F.array().cast(none)))
    # the index has at most MOST_WORDS rows
    met = heads.join(F.broadcast(wanted), "token").where(
        (F.size("held") >= F.col("need"))
        & (F.least(F.size("wanted") - F.col("i"), F.size("held") - F.col("j")) >= F.col("need")))
    common = F.array_intersect("held", "wanted")
    return (met.withColumn("__common", common).where((F.size("__common") >= F.col("need")) & (F.col("__common")[0] == F.col("token")))
            .select(*keep, "block", "template", F.size("__common").alias("overlap")))


def _places(words_: str, phrase: str) -> Column:
    """Word numbers at which the phrase stands."""
    tokens = tokens_of(phrase)
    last = F.size(words_) - len(tokens)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def here(i):
        test = F.lit(True)
        for k, token in enumerate(tokens):
            test = test & (F.get(words_, i + k) == token)
        return test
    return F.filter(at, here)


def named(docs: DataFrame, text: str = "text", phrases=PHRASES) -> DataFrame:
    """``docs`` with ``__words``, ``__places`` (of all phrases) and ``__named`` (their labels)."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    some = "|".join(gap.join(tokens_of(p)) for p, _ in phrases)
    full = F.coalesce(F.col(text), F.lit(""))
    # words are only listed where some phrase stands, as part of other words perhaps
    rows = docs.withColumns({"__n": F.regexp_count(full, F.lit(WORD.replace("a-z", "A-Za-z"))).cast("long"),
                             "__words": F.when(full.rlike(f"(?i){some}"), words(F.col(text))).otherwise(F.array().cast("array<string>"))})
    rows = rows.withColumns({f"__p{i}": _places("__words", p) for i, (p, _) in enumerate(phrases)})
    labels = [F.when(F.size(f"__p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]
    places = F.concat(*[F.col(f"__p{i}") for i in range(len(phrases))])
    return (rows.withColumns({"__places": places, "__named": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))})
            .drop("__words", *[f"__p{i}" for i in range(len(phrases))]))


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, containment: int = CONTAINMENT) -> DataFrame:
    """``docs`` with ``license_``: n_words, n_base, first_word, last_word (of the phrases), base_labels, labels, score,
    templates (how many some block of the text meets).

    ``score`` is the largest containment of a template, ``NAMED`` for a phrase alone, 0 otherwise.
    """
    labels = [label for label, _ in templates]
    sizes = [len(set(tokens_of(t))) for _, t in templates]
    digests = docs.select(F.md5(text).alias("__key"), F.col(text).alias("__text"))
    pairs = matches(digests, "__text", ("__key",), templates, containment)
    label, size = F.get(_literal(labels), F.col("template")), F.get(F.array(*map(F.lit, sizes or [1])), F.col("template"))
    found = pairs.groupBy("__key").agg(
        F.collect_set(label).alias("__held"), F.max(F.col("overlap") / size).alias("__most"), F.size(F.collect_set("template")).alias("__met"))
    spread = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = named(docs, text).withColumns({"__key": F.md5(text), "__salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")})
    rows = rows.join(spread, ["__key", "__salt"], "left")
    all_labels = F.array_sort(F.array_distinct(F.concat("__named", F.coalesce("__held", F.array().cast("array<string>")))))
    n_base = F.size("__places").cast("long")
    out = rows.withColumns({
        "license_n_words": F.col("__n"), "license_n_base": n_base,
        "license_first_word": F.array_min("__places").cast("long"), "license_last_word": F.array_max("__places").cast("long"),
        "license_base_labels": F.array_join("__named", ","), "license_labels": F.array_join(all_labels, ","),
        "license_score": F.greatest(F.coalesce("__most", F.lit(0.0)), F.when(n_base > 0, F.lit(NAMED)).otherwise(F.lit(0.0))),
        "license_templates": F.coalesce("__met", F.lit(0)).cast("long")})
    return out.drop("__n", "__places", "__named", "__held", "__most", "__met", "__key", "__salt")
