"""License texts and notices in documents, by an exact set-similarity join.

Templates and the blocks of documents (paragraphs) are sets of words. A block is found if it contains at least
``CONTAINED`` of a template's words. Words are ordered by their frequency in all documents, rarest first; of a template of
m words with a least overlap a, a block must have one of the m - a + 1 rarest (prefix filter), at least a words (length
filter), and after their first common word enough must be left on either side (positional filter). What passes is
counted exactly, so every block that meets the threshold is found and no other.

Besides, fixed phrases are found wherever their words stand in a row. Null and empty texts have no words and no labels.
Equal texts are joined once; repeated rows are counted each for itself. Without templates only the phrases are found.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import body, join_small, materialize, words

CONTAINED = 0.9
BLOCK = r"\n[ \t\r]*\n|(?<=[.!?:;])[ \t\r]*\n"  # an empty line, or a line's end that ends a sentence

# Phrases with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Notices and the opening sentences of public license texts, with the labels they give.
TEMPLATES = [
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "This project is licensed under the terms of the MIT license."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
                 "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-text", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                    "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                 "License as published by the Free Software Foundation"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                 "following conditions are met"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-notice", "Licensed under CC BY-SA 4.0."),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("rights-reserved", "All rights reserved."),
]


def prefixes(docs: DataFrame, templates: DataFrame, contained: float, text_col: str) -> DataFrame:
    """``tid, label, m, need, tokens`` (words by global frequency, rarest first): a row for each template."""
    own = templates.select("tid", "label", F.array_distinct(words(F.col("template"))).alias("tw")).where(F.size("tw") > 0)
    vocabulary = own.select(F.explode("tw").alias("token")).distinct()
    seen = docs.select(F.explode(words(body(text_col))).alias("token")).join(F.broadcast(vocabulary), "token").groupBy("token").count()
    ranked = own.select("tid", "label", F.explode("tw").alias("token")).join(seen, "token", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")))
    out = ranked.groupBy("tid", "label").agg(order.alias("o")).select("tid", "label", F.size("o").alias("m"), F.col("o.token").alias("tokens"))
    return out.withColumn("need", F.ceil(F.col("m") * contained - 1e-9).cast("int"))


def matching_blocks(docs: DataFrame, templates: DataFrame, contained: float = CONTAINED, text_col: str = "text") -> DataFrame:
    """``digest, block, label, containment`` of every block (numbered from 0) that meets a template's threshold."""
    table = materialize(prefixes(docs, templates, contained, text_col), "license-templates")
    held = table.collect()  # the list of templates, which the caller gave
    rank: dict[str, int] = {}
    for _, w in sorted({(i, w) for r in held for i, w in enumerate(r.tokens)}):
        rank.setdefault(w, len(rank))
    rare = sorted({w for r in held for w in r.tokens[:r.m - r.need + 1]})
    if not rare:
        return docs.select(F.md5(body(text_col)).alias("digest"), F.lit(0).alias("block"), F.lit("").alias("label"),
                           F.lit(0.0).alias("containment")).where("false")
    literal = F.array(*map(F.lit, rare))
    index = table.select("tid", "label", "m", "need", "tokens", F.posexplode(F.slice("tokens", F.lit(1), F.col("m") - F.col("need") + 1)).alias("at", "token"))
    src = docs.select(F.md5(body(text_col)).alias("digest"), body(text_col).alias("t"))
    # The rare words as plain text first: most texts have none of them anywhere.
    src = src.where(reduce(or_, (F.contains(F.lower("t"), F.lit(w)) for w in rare)))
    blocks = src.select("digest", F.posexplode(F.split("t", BLOCK)).alias("block", "b"))
    blocks = blocks.select("digest", "block", F.array_distinct(words(F.col("b"))).alias("bw"))
    blocks = blocks.withColumn("hit", F.array_intersect("bw", literal)).where(F.size("hit") > 0)
    met = blocks.select("digest", "block", "bw", F.explode("hit").alias("token")).join(F.broadcast(index), "token")
    met = met.where(F.size("bw") >= F.col("need"))  # length filter
    # In template order, a word at place i is followed by m - i - 1: what is met first must leave enough after it.
    met = met.where(F.col("m") - F.col("at") >= F.col("need"))
    met = met.dropDuplicates(["digest", "block", "tid"])
    common = F.size(F.array_intersect("tokens", "bw"))
    found = met.select("digest", "block", "label", (common / F.col("m")).alias("containment"), common.alias("n"), "need")
    return found.where("n >= need").select("digest", "block", "label", "containment")


def places(w: Column, phrase: str) -> Column:
    """Where (words from 0) the words of a phrase stand in a row."""
    parts = phrase.split(" ")
    same = lambda i: reduce(lambda a, b: a & b, (F.get(w, i + k) == p for k, p in enumerate(parts)))
    return F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)), same)


def license_scan(docs: DataFrame, templates: DataFrame, phrases: list[tuple[str, str]] = PHRASES, contained: float = CONTAINED,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``score`` is 1 where a phrase stands, else the largest containment of a template found, else 0.
    """
    blocks = matching_blocks(docs, templates, contained, text_col)
    found = materialize(blocks.groupBy("digest").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most")), "license-found")
    src = docs.select(F.col(id_col).alias("_id"), body(text_col).alias("t"))
    src = src.select("_id", F.md5("t").alias("digest"), words(F.col("t")).alias("w"), F.lower("t").alias("low"))
    none = F.array().cast("array<int>")
    at = [F.when(F.contains("low", F.lit(p.split(" ")[0])) & F.contains("low", F.lit(p.split(" ")[-1])) & (F.size("w") >= len(p.split(" "))),
                 places(F.col("w"), p)).otherwise(none) for p, _ in phrases]
    src = src.select("_id", "digest", F.size("w").cast("long").alias("n_words"), *(a.alias(f"at{i}") for i, a in enumerate(at)))
    out = join_small(src, found, "digest", "left")
    own = F.filter(F.array(*(F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases))), lambda x: x.isNotNull())
    every = F.concat(*(F.col(f"at{i}") for i in range(len(phrases))))
    out = out.select("_id", "n_words", own.alias("own"), every.alias("every"), "more", "most")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(
        F.col("_id").alias(id_col), "n_words", F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        joined(F.col("own")).alias("base_labels"),
        joined(F.concat("own", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("every") > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"))
