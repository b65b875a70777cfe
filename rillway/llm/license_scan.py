"""License scans: exact set-similarity join of text blocks with license templates.

A template is a license notice, or a tag that names a license. With ``n`` words in the longest
one, a block is a line of at most ``3 n`` words, or ``3 n`` words of the document from any word
whose place is a multiple of ``n``, whatever the line breaks: a notice however wrapped, in a line
however long, with comment marks or up to ``n`` other words in between, lies whole in one of
these, and words that stand farther apart than a block is long never count together. Windows
are only cut where the document as a whole holds enough of a template's words. Blocks and
templates are sets of words. A block matches if it holds at least ``THRESHOLD`` of a template's words. Words outside the
templates can't count towards that, so a block keeps only template words; these are ordered
by the number of documents that hold them, over all documents, rarest first. If a block of
``b`` words and a template of ``t`` share at least ``a = ceil(THRESHOLD * t)``, they share one
among the block's first ``b - a + 1`` and the template's first ``t - a + 1`` words (prefix
filter); a block with fewer than ``a`` words can't match (length filter); and a shared word
at places ``i`` and ``j`` of the two leaves at most ``1 + min(b - i, t - j)`` to share
(positional filter). What is left is verified by intersection.

Beside this, ``base`` phrases are found wherever their words stand in a row.

Defined cases: a null text counts as empty (no words, no labels, score 0); very long texts
are taken whole; repeated rows get one result each; other columns are left out; an empty
table gives an empty result. The score is 1 for a base phrase, else the largest share of a
template that a block holds, if it reached the threshold, else 0. A block that matches several
templates gives all their labels; words that tie in frequency are ordered as strings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.common import ALNUM_WORD, lower_ascii, materialise, table

#: Phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Wording of license notices, and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "licensed under the gnu gpl v2": "gpl-2",
    "this program is licensed under the gnu general public license version 2": "gpl-2",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "spdx license identifier mit": "mit",
    "spdx license identifier isc": "isc",
    "spdx license identifier apache 2 0": "apache-2",
    "spdx license identifier gpl 2 0": "gpl-2",
    "spdx license identifier gpl 3 0": "gpl-3",
    "spdx license identifier lgpl 2 1": "lgpl",
    "spdx license identifier bsd 3 clause": "bsd",
    "spdx license identifier mpl 2 0": "mpl-2",
    "spdx license identifier cc by nc 4 0": "cc-by-nc",
}
THRESHOLD = 0.9


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _cut(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(ALNUM_WORD), F.lit(0))


def _starts(words: Column, phrase: list[str]) -> Column:
    """Where ``phrase`` begins in ``words``; these are bound as a variable, so that they are cut once."""
    k = len(phrase)

    def of(w: Column) -> Column:
        at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
        return F.filter(at, lambda i: F.slice(w, i + 1, k) == _strings(phrase))

    return F.flatten(F.transform(F.array(words), of))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.cast("long").alias("word"), F.lit(label).alias("label")))


def _windows(words: Column, n: int, vocab: list[str]) -> Column:
    """The template words of each ``3 n`` words, beginning at every ``n``-th."""

    def of(w: Column) -> Column:
        at = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(n))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_intersect(F.slice(w, i + 1, 3 * n), _strings(vocab)))

    return F.flatten(F.transform(F.array(words), of))


def _blocks(docs: DataFrame, doc_id: str, text: str, base: dict[str, str], sets: dict[str, list[str]], need: dict[str, int]) -> DataFrame:
    """A thin row for each document: counts, base places, and its blocks as sets of template words."""
    vocab = sorted({w for s in sets.values() for w in s})
    longest = max(len(t.split()) for t in sets)
    lowered = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    d = docs.select(F.col(doc_id).alias("doc_id"), lowered.alias("_t"))
    places = []
    for phrase, label in base.items():
        words = phrase.split()
        # Only texts that hold the phrase are cut into words.
        near = F.col("_t").rlike(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(words))
        found = F.when(near, _starts(_cut("_t"), words)).otherwise(F.array().cast("array<int>"))
        places.append(_labelled(found, label))
    # Of each line, how many words it has and the template words among them; it is cut once.
    cut = F.transform(F.split("_t", "\n"), _cut)
    d = d.withColumn("_lines", F.transform(cut, lambda w: F.struct(F.size(w).alias("n"), F.array_intersect(w, _strings(vocab)).alias("s"))))
    d = d.withColumn("_held", F.array_distinct(F.flatten("_lines.s")))
    enough = F.lit(False)
    for t, s in sets.items():
        enough = enough | (F.size(F.array_intersect("_held", _strings(s))) >= need[t])
    short = F.transform(F.filter("_lines", lambda x: x["n"] <= 3 * longest), lambda x: x["s"])
    many = (F.size("_lines") > 1) | (F.size(short) == 0)
    windows = F.when(many & enough, _windows(_cut("_t"), longest, vocab)).otherwise(F.array().cast("array<array<string>>"))
    least = min(need.values())
    return d.select(
        "doc_id",
        F.regexp_count("_t", F.lit(ALNUM_WORD)).cast("long").alias("n_words"),
        F.concat(*places).alias("_places"),
        F.filter(F.concat(short, windows), lambda s: F.size(s) >= least).alias("_sets"),
        "_held",
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: counts, base places, labels, score."""
    sets = {t: sorted(set(t.split())) for t in templates}
    need = {t: math.ceil(threshold * len(s)) for t, s in sets.items()}
    vocab = sorted({w for s in sets.values() for w in s})
    thin = materialise(_blocks(docs, doc_id, text, base, sets, need).withColumn("_row", F.monotonically_increasing_id()))
    # One count for each template word: as many rows as the templates have words.
    counts = {r["w"]: r["n"] for r in thin.select(F.explode("_held").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pylist()}
    order = sorted(vocab, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    spark = docs.sparkSession
    rows = []
    for t, s in sets.items():
        ranked = sorted(rank[w] for w in s)
        for j, w in enumerate(ranked[: len(s) - need[t] + 1]):
            rows.append((w, templates[t], j, ranked, need[t]))
    prefix = spark.createDataFrame(rows, "_w int, _label string, _j int, _set array<int>, _need int")
    ranks = F.create_map(*[F.lit(x) for w, k in rank.items() for x in (w, k)])
    blocks = thin.select("_row", F.explode("_sets").alias("_s")).select(
        "_row", F.array_sort(F.transform("_s", lambda w: F.element_at(ranks, w))).alias("_b")
    )
    heads = blocks.select("_row", "_b", F.posexplode(F.slice("_b", 1, F.size("_b") - min(need.values()) + 1)).alias("_i", "_w"))
    b, t = F.size("_b"), F.size("_set")
    near = heads.join(F.broadcast(prefix), "_w").filter(
        (b >= F.col("_need")) & (F.col("_i") <= b - F.col("_need")) & (1 + F.least(b - 1 - F.col("_i"), t - 1 - F.col("_j")) >= F.col("_need"))
    )
    shared = F.size(F.array_intersect("_b", "_set"))
    found = near.withColumn("_shared", shared).filter(F.col("_shared") >= F.col("_need"))
    by_row = found.groupBy("_row").agg(F.collect_set("_label").alias("_labels"), F.max(F.col("_shared") / t).alias("_share"))
    words = F.transform("_places", lambda p: p["word"])
    base_labels = F.array_distinct(F.transform("_places", lambda p: p["label"]))
    joined = thin.drop("_sets", "_held").join(by_row, "_row", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.size("_places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("_labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


ORACLE = None
