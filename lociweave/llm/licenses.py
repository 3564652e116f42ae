"""License scans: an exact set-similarity join of text blocks with templates.

A block is a stretch of consecutive words, whatever lines they stand on, as long as the
template's words over ``CONTAINMENT``. It meets the template when it holds at least
``CONTAINMENT`` of the template's distinct words. Words are ordered by their frequency over
all documents, rarest first. A text with a block that meets a template shares one of
the template's first ``|T| - need + 1`` words (prefix filter), has ``need`` template
words at all (length filter), and has enough of them left after the first shared one
(positional filter); what passes is verified block by block. The template side is a
fixed parameter of a few dozen rows, so it is broadcast; texts are split once, and again
only where a template may be met.

Besides, fixed phrases are found at every place where their words stand
consecutively; those are the base labels.

Defined cases: a null or empty text has no words, no labels (empty strings) and
score 0; rows that share id and text share the method's labels, rows that share the id
alone do not; a null id is an id like any other; only the key and the text are
read, so extra columns may have any names; an empty table stays empty.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.common import ascii_lower, checked, documents, let, written

#: A word is a run of digits, lower-case letters and characters beyond ASCII.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8

#: Phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of common licenses, in their own words.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS), "")


def _template_words(text: str) -> list[str]:
    return sorted(set("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def _need(n: int, share: float) -> int:
    return math.ceil(round(share * n, 9))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


class Template(NamedTuple):
    """A template's label, its distinct words, how many of them a block needs and how many words a block has."""

    label: str
    words: list[str]
    need: int
    width: int


def prepared(templates=TEMPLATES, share: float = CONTAINMENT) -> list[Template]:
    out = []
    for label, text in templates:
        every = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        distinct = _template_words(text)
        out.append(Template(label, distinct, _need(len(distinct), share), _need(len(every), 1 / share)))
    return out


def frequencies(held: DataFrame) -> dict[str, int]:
    """In how many texts each word of ``_b`` is; a row for each word of the templates reaches the driver."""
    return {r["w"]: r["count"] for r in held.select(F.explode("_b").alias("w")).groupBy("w").count().collect()}


def candidates(held: DataFrame, templates: list[Template]) -> DataFrame:
    """(_id, _h, ts): the texts whose template words ``_b`` pass the three filters, and the numbers of the templates that they may meet."""
    vocabulary = sorted({w for t in templates for w in t.words})
    seen = frequencies(held)
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    prefix = []
    for number, t in enumerate(templates):
        by_rank = sorted(t.words, key=rank.__getitem__)
        prefix += [(w, p, number, (by_rank, t.need)) for p, w in enumerate(by_rank[: len(t.words) - t.need + 1])]
    index = held.sparkSession.createDataFrame(prefix, "token string, at int, number int, t struct<words:array<string>,need:int>")
    starts, least = sorted({p[0] for p in prefix}), min(t.need for t in templates)
    # array_intersect keeps the order of its first argument: rarest first
    some = held.filter(F.size("_b") >= least).select("_id", "_h", F.array_intersect(_strings(order), F.col("_b")).alias("_b"))
    probes = some.select("_id", "_h", "_b", F.explode(F.array_intersect(F.col("_b"), _strings(starts))).alias("_token"))
    pairs = probes.join(F.broadcast(index), F.col("_token") == F.col("token"))
    first = F.size(F.array_intersect(F.slice("t.words", F.lit(1), F.col("at")), F.col("_b"))) == 0
    left = F.least(F.size("t.words") - F.col("at"), F.size("_b") - F.array_position("_b", F.col("_token")).cast("int") + 1)
    shared = F.size(F.array_intersect("t.words", "_b"))
    return pairs.filter(first & (left >= F.col("t.need")) & (shared >= F.col("t.need"))).groupBy("_id", "_h").agg(F.collect_set("number").alias("ts"))


def _best_block(words: Column, t: Column) -> Column:
    """The most distinct words of the template ``t`` in one block; a best block starts with one of them."""
    hits = F.array_compact(F.transform(words, lambda w, i: F.when(F.array_contains(t["words"], w), F.struct(i.alias("i"), w.alias("w")))))

    def block(h: Column, a: Column, k: Column) -> Column:
        inside = F.filter(F.slice(h, k + 1, t["width"]), lambda b: b["i"] < a["i"] + t["width"])
        return F.size(F.array_distinct(F.transform(inside, lambda b: b["w"])))

    return F.coalesce(let(hits, lambda h: F.array_max(F.transform(h, lambda a, k: block(h, a, k)))), F.lit(0))


def template_matches(lowered: DataFrame, held: DataFrame, templates: list[Template]) -> DataFrame:
    """(_id, _h, label, containment) of every text of ``_t`` and template that it meets; ``held`` has the texts' template words."""
    found = written(candidates(held, templates), "candidates")
    # the filters leave few texts: only these are split again
    asked = lowered.join(checked(found.withColumnsRenamed({"_id": "_of", "_h": "_hash"})), F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_h") == F.col("_hash")))
    known = F.array(*[F.struct(F.lit(t.label).alias("label"), _strings(t.words).alias("words"), F.lit(t.need).alias("need"), F.lit(t.width).alias("width")) for t in templates])
    best = let(_words(F.col("_t")), lambda w: F.transform(F.transform("ts", lambda k: F.get(known, k)), lambda t: F.struct(t["label"].alias("label"), t["need"].alias("need"), F.size(t["words"]).alias("n"), _best_block(w, t).alias("k"))))
    met = asked.select("_id", "_h", F.explode(best).alias("m")).filter("m.k >= m.need")
    return met.select("_id", "_h", "m.label", (F.col("m.k") / F.col("m.n")).alias("containment"))


def _places(words: Column, phrase: str) -> Column:
    """Starts of ``phrase`` among ``words``."""
    parts = phrase.split(" ")
    here = lambda w, i: F.lit(True) & (w == parts[0]) & _all([F.coalesce(F.get(words, i + k), F.lit("")) == p for k, p in enumerate(parts) if k])
    found = F.array_compact(F.transform(words, lambda w, i: F.when(here(w, i), i)))
    return F.when(_all([F.array_contains(words, p) for p in parts]), found).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES, share: float = CONTAINMENT) -> DataFrame:
    """One row per row of ``docs``: the key as ``doc_id``, counts, places, labels and score."""
    known = prepared(templates, share)
    lowered = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_h"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    names = [f"_p{k}" for k in range(len(phrases))]
    vocabulary = _strings(sorted({w for t in known for w in t.words})) if known else F.array().cast("array<string>")
    split = lowered.withColumn("_w", _words(F.col("_t")))
    base = split.select("_id", "_h", F.size("_w").cast("bigint").alias("n_words"), F.array_intersect(vocabulary, F.col("_w")).alias("_b"), *[_places(F.col("_w"), p).alias(n) for n, p in zip(names, phrases, strict=True)])
    every = F.flatten(F.array(*names))
    labels = F.array_compact(F.array(*[F.when(F.size(n) > 0, F.lit(v)) for n, v in zip(names, phrases.values(), strict=True)]))
    base = written(
        base.select(
            "_id", "_h", "_b", "n_words", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("_base")
        ),
        "license-words",
    )
    if known:
        met = template_matches(lowered, base.select("_id", "_h", "_b"), known)
        met = written(met.groupBy(F.col("_id").alias("_of"), F.col("_h").alias("_hash")).agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best")), "license-labels")
        base = base.join(checked(met), F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_h") == F.col("_hash")), "left")
    else:
        base = base.withColumns({"_more": F.array().cast("array<string>"), "_best": F.lit(0.0)})
    both = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    score = F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0)))
    return base.select(F.col("_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir))


def _sql() -> str:
    held = ", ".join(f"({n}, '{t.label}', [{', '.join(repr(w) for w in t.words)}], {t.need}, {t.width})" for n, t in enumerate(prepared()))
    places, labels = [], []
    for p, v in PHRASES.items():
        parts = p.split(" ")
        places.append(" AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(parts)))
        labels.append(f"WHEN {places[-1]} THEN '{v}'")
    return rf"""
WITH t(n, label, ws, need, width) AS (VALUES {held}), d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
), a AS (
  SELECT doc_id, x, list_filter(string_split_regex(x, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda y: y <> '') AS w FROM d
), p AS (
  SELECT doc_id, i, CASE {' '.join(labels)} END AS label FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM a)
), b AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM p WHERE label IS NOT NULL GROUP BY doc_id
), h AS (
  SELECT x.doc_id, t.n, x.i, x.y FROM (SELECT doc_id, unnest(w) AS y, unnest(range(0, len(w))) AS i FROM a) x, (SELECT n, unnest(ws) AS y FROM t) t WHERE x.y = t.y
), k AS (
  SELECT h.doc_id, h.n, h.i, count(DISTINCT g.y) AS k FROM h JOIN t ON h.n = t.n JOIN h g ON g.doc_id = h.doc_id AND g.n = h.n AND g.i >= h.i AND g.i < h.i + t.width GROUP BY ALL
), m AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(k::DOUBLE / len(ws)) AS best FROM k JOIN t ON k.n = t.n WHERE k >= need GROUP BY doc_id
)
SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM a LEFT JOIN b ON a.doc_id = b.doc_id LEFT JOIN m ON a.doc_id = m.doc_id
"""


QUERIES = {"op7_licenses": op7_licenses}
ORACLE = {"op7_licenses": _sql()}
