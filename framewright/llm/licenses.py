"""License scan: an exact set-similarity join of text blocks with license templates, with DataFrame functions only.

A block is a run of ``BLOCK_LINES`` neighbouring lines of a text, one from each line on, so that notices may wrap; its
tokens are its distinct lower-case words. A block matches a template if it holds at least ``threshold`` of the template's
distinct words (containment). The join is exact:

* tokens are put in one global order, rarest in the corpus first (counted over all blocks);
* prefix filter: a match shares one of the |T| - ceil(threshold |T|) + 1 rarest words of the template;
* length filter: a block with fewer template words than ceil(threshold |T|) can't match;
* positional filter: from the shared word on, both sides must still have enough words;
* what passes is confirmed by the intersection of both sets.

Words that are in no template cannot add to a containment, so blocks keep template words only. Templates are a fixed,
bounded list of the caller (``MAX_TEMPLATES``), which bounds what is broadcast.

Besides, base phrases are found word by word anywhere in a text, line ends included.

Edge cases: null texts count as empty, with 0 words and no labels; very long texts are whole; repeated rows each get
their row; labels are those of the row's own text, under whose SHA-256 its matches are kept, so doc_ids may repeat or
be null; empty tables stay empty; only doc_id and the text are read, other columns are dropped.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases of words that stand one after another, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices as licenses ask for them, by label.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "this project is licensed under the terms of the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is licensed under the gnu lesser general public license version 2 1"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "this document is confidential and proprietary all rights reserved no part may be reproduced without written permission"),
]
MAX_TEMPLATES = 1000
BLOCK_LINES = 3


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _phrase_starts(words: Column) -> Column:
    """Array of (start, label) of the phrases in an array of words."""

    def at(i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in PHRASES.items():
            parts = phrase.split()
            same = F.lit(True)
            for k, part in enumerate(parts):
                same = same & F.coalesce(F.get(words, i + k) == part, F.lit(False))
            label = F.when(same, name).otherwise(label)
        return F.struct(i.cast("long").alias("start"), label.alias("label"))

    starts = F.filter(
        F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))),
        lambda x: x["w"].isin(*{p.split()[0] for p in PHRASES}),
    )
    return F.filter(F.transform(starts, lambda x: at(x["i"])), lambda x: x["label"].isNotNull())


def template_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """(text_sha256, line, label, containment) of every distinct text's blocks (by first line) and templates that match."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    spark = docs.sparkSession
    sets = [sorted(set(words.split())) for _, words in templates]
    need = [ceil(threshold * len(x) - 1e-9) for x in sets]
    vocabulary = sorted(set().union(*sets))
    known = F.array(*map(F.lit, vocabulary))
    safe = F.coalesce(F.col(text).cast("string"), F.lit(""))
    tokens = F.transform(F.split(safe, "\n"), lambda x: F.array_intersect(F.regexp_extract_all(_lower(x), F.lit(WORD), F.lit(0)), known))
    lines = docs.select(F.sha2(safe, 256).alias("text_sha256"), tokens.alias("lines"))
    runs = f"transform(array(lines), l -> transform(l, (x, i) -> array_distinct(flatten(slice(l, i + 1, {BLOCK_LINES})))))[0]"
    # length filter
    blocks = lines.select("text_sha256", F.posexplode(F.expr(runs)).alias("line", "tokens")).filter(F.size("tokens") >= min(need))
    blocks = stored(blocks)
    counts = blocks.select(F.explode("tokens").alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in counts.collect()}  # a row for each template word at most
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    prefixes = [
        (t, word, place, len(words), need[t])
        for t, words in enumerate(sets)
        for place, word in enumerate(sorted(words, key=order.get)[: len(words) - need[t] + 1])
    ]
    prefix = spark.createDataFrame(prefixes, "template int, token string, t_place int, t_size int, need int")
    whole = spark.createDataFrame(
        [(t, templates[t][0], words) for t, words in enumerate(sets)], "template int, label string, words array<string>"
    )
    ranks = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    ordered = F.transform(F.sort_array(F.transform("tokens", lambda w: F.struct(ranks[w].alias("rank"), w.alias("w")))), lambda x: x["w"])
    placed = blocks.withColumn("tokens", ordered).select("text_sha256", "line", "tokens", F.posexplode("tokens").alias("place", "token"))
    left = F.least(F.col("t_size") - F.col("t_place"), F.size("tokens") - F.col("place"))
    near = placed.join(F.broadcast(prefix), "token").filter((F.size("tokens") >= F.col("need")) & (left >= F.col("need")))
    # the first shared word of a pair stands for it: it has the longest rest on both sides
    near = near.groupBy("text_sha256", "line", "template", "need", "t_size").agg(F.first("tokens").alias("tokens"))
    shared = F.size(F.array_intersect("tokens", "words"))
    return (
        near.join(F.broadcast(whole), "template")
        .withColumn("shared", shared)
        .filter(F.col("shared") >= F.col("need"))
        .select("text_sha256", "line", "label", (F.col("shared") / F.col("t_size")).alias("containment"))
    )


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a base phrase,
    else the greatest containment that reached the threshold, else 0)."""
    docs = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = template_matches(docs, templates, threshold)
    found = found.groupBy("text_sha256").agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_score"))
    maybe = F.col("text").rlike("[Ll][Ii][Cc][Ee][Nn][Ss][Ee]")
    words = F.regexp_extract_all(_lower(F.col("text")), F.lit(WORD), F.lit(0))
    base = docs.select(
        "doc_id",
        F.sha2("text", 256).alias("text_sha256"),
        F.size(F.regexp_extract_all("text", F.lit(_WORD_ANY_CASE), F.lit(0))).cast("long").alias("n_words"),
        F.when(maybe, words).otherwise(F.expr("cast(array() as array<string>)")).alias("_words"),
    ).withColumn("_starts", _phrase_starts(F.col("_words")))
    base = base.select(
        "doc_id",
        "text_sha256",
        "n_words",
        F.size("_starts").cast("long").alias("n_base"),
        F.array_min(F.transform("_starts", lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform("_starts", lambda x: x["start"])).alias("last_word"),
        F.array_distinct(F.transform("_starts", lambda x: x["label"])).alias("_base"),
    )
    joined = base.join(found, "text_sha256", "left")
    none = F.expr("cast(array() as array<string>)")
    return joined.select(
        "doc_id",
        *("n_words n_base first_word last_word".split()),
        F.array_join(F.sort_array("_base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("_base", F.coalesce("_labels", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
