"""License scan: exact containment join of text blocks with license templates, in DataFrame functions only.

A text is cut into blocks of `BLOCK` words that overlap by half. A block holds a template when at least `THRESHOLD` of
the template's distinct words are in it. Template words are ordered by how many documents hold them, rarest first; a
block can reach the threshold only if it has a word of the template's prefix in this order (prefix filter), enough
template words at all (length filter), and enough of them from the first common word on (positional filter). Pairs that
pass are verified by counting the common words and, where the template names its license, by that name: notices that
differ in the name alone share all other words. A name is the fewest words that no other license shares, one after
another in the block; a notice that names no license is held by its words alone. A notice of up to half a block and one
word lies whole in some block. Templates are a short fixed list; only counts of their words, one row per word, reach
the driver.

Besides, given phrases are looked up word by word (base labels).

Defined cases: a null text counts as empty: no words, no places, empty labels, score 0. Texts of any length are scanned
whole. Repeated rows get the same result each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm.common import SEPARATORS, lower_ascii, table

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
# label, words of the template, the words among them that name the license (none: empty): a block must hold these one after
# another. 'gnu' alone is LGPL's as well, 'sa' that of CC BY-NC-SA, and 'mit' is a word of "Apache License, mit".
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0", "apache"),
    ("apache-2", "you may not use this file except in compliance with the license", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ""),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used", ""),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ""),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", ""),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla"),
)
THRESHOLD = 0.8
BLOCK = 32
IndexRow = tuple[str, str, list[str], int, int, str]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def places(words: Column, phrase: str) -> Column:
    """Starts (from 0) of the phrase's words."""
    parts = phrase.split()
    present = F.size(words) >= len(parts)
    for part in parts:
        present &= F.array_contains(words, part)

    def here(i: Column) -> Column:
        equal = F.get(words, i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            equal &= F.get(words, i + j) == part
        return equal

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
    return F.when(present, starts).otherwise(F.array().cast("array<int>"))


def word_order(worded: DataFrame, templates=TEMPLATES) -> list[str]:
    """The template words by the number of documents that hold them, rarest first; ties by the word."""
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    held = worded.select(F.explode(F.array_intersect(F.col("words"), _strings(vocabulary))).alias("word"))
    counts = {r.word: r.n for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def prefix_index(order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> list[IndexRow]:
    """(prefix word, label, tokens, needed, place of the word among the tokens, name) for each template and prefix word."""
    rows = []
    for label, text, name in templates:
        tokens = sorted(set(text.split()), key=order.index)
        needed = math.ceil(threshold * len(tokens) - 1e-9)
        rows += [(word, label, tokens, needed, at, name) for at, word in enumerate(tokens[: len(tokens) - needed + 1])]
    return rows


def index_table(spark: SparkSession, index: list[IndexRow]) -> DataFrame:
    rows = [
        F.struct(F.lit(word).alias("word"), F.lit(label).alias("label"), _strings(tokens).alias("tokens"), F.lit(needed).alias("needed"), F.lit(at).alias("at"), F.lit(name).alias("name"))
        for word, label, tokens, needed, at, name in index
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def block_matches(worded: DataFrame, order: list[str], index: list[IndexRow], block: int = BLOCK) -> DataFrame:
    """row_key, label, containment of every (block, template) that meets the threshold, of (row_key, words)."""
    words, half = F.col("words"), block // 2
    prefix_words = sorted({row[0] for row in index})
    marks = F.transform(words, lambda w, i: F.when(w.isin(prefix_words), F.floor(i / half).cast("int")))
    held = F.array_distinct(F.filter(marks, lambda i: i.isNotNull()))
    # a word is in the block that starts at its half block and in the one before
    starts = F.array_distinct(F.flatten(F.transform(held, lambda i: F.array(i, F.greatest(i - 1, F.lit(0))))))
    none = F.array().cast("array<int>")
    starts = F.when(F.arrays_overlap(words, _strings(prefix_words)), starts).otherwise(none)
    blocks = worded.select("row_key", "words", F.explode(starts).alias("block"))
    blocks = blocks.select("row_key", F.slice(words, F.col("block") * half + 1, block).alias("words"))
    blocks = blocks.select("row_key", "words", F.array_intersect(_strings(order), "words").alias("held"))
    pairs = blocks.select("row_key", "words", "held", F.posexplode("held").alias("q", "word")).join(
        F.broadcast(index_table(worded.sparkSession, index)), "word"
    )
    left = F.least(F.size("tokens") - F.col("at"), F.size("held") - F.col("q"))
    pairs = pairs.where((F.size("held") >= F.col("needed")) & (left >= F.col("needed")))
    common = F.size(F.array_intersect("held", "tokens"))
    # words hold no blanks, so the joined block holds the name between blanks where its words follow each other
    spaced = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    named = (F.col("name") == "") | F.contains(spaced, F.concat(F.lit(" "), "name", F.lit(" ")))
    pairs = pairs.where(common >= F.col("needed")).where(named)
    return pairs.select("row_key", "label", (common / F.size("tokens")).alias("containment"))


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, places per phrase label, matched labels and the best containment of (doc_id, text)."""
    # rows with the same id and text share a key and a result
    text = F.coalesce("text", F.lit("")).cast("binary")
    row_key = F.concat_ws(" ", "doc_id", F.xxhash64(text), F.crc32(text))
    worded = docs.select("doc_id", row_key.alias("row_key"), words_of(F.col("text")).alias("words"))
    order = word_order(worded, templates)
    matches = block_matches(worded, order, prefix_index(order, templates, threshold), block).groupBy("row_key")
    matches = matches.agg(F.collect_set("label").alias("matched"), F.max("containment").alias("containment"))
    found = [places(F.col("words"), phrase).alias(label) for label, phrase in phrases.items()]
    base = worded.select("doc_id", "row_key", F.size("words").cast("long").alias("n_words"), F.struct(*found).alias("places"))
    return base.join(matches, "row_key", "left").select(
        "doc_id", "n_words", "places", F.coalesce("matched", F.array().cast("array<string>")).alias("matched"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    per_label = [F.col("places")[label] for label in PHRASES]
    every = F.concat(*per_label)
    base = F.filter(F.array(*(F.when(F.size(p) > 0, F.lit(label)) for label, p in zip(PHRASES, per_label, strict=True))), lambda x: x.isNotNull())
    labels = F.array_sort(F.array_distinct(F.concat(base, "matched")))
    return scanned.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.when(F.size(base) > 0, 1.0).otherwise(F.col("containment")).alias("score"),
    )


def _oracle() -> str:
    phrases = ", ".join(f"('{label}', {phrase.split()!r})" for label, phrase in PHRASES.items())
    templates = ", ".join(f"('{label}', {sorted(set(text.split()))!r}, '{name}')" for label, text, name in TEMPLATES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), phrases(label, parts) AS (VALUES {phrases}), templates(label, tokens, name) AS (VALUES {templates}),
spots AS (
  SELECT row_id, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1 : i + len(parts)] = parts)) AS spot
  FROM d JOIN phrases ON list_has_all(words, parts)
), base AS (
  SELECT row_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS base FROM spots GROUP BY row_id
), blocks AS (
  SELECT row_id, words[k * {BLOCK // 2} + 1 : k * {BLOCK // 2} + {BLOCK}] AS block
  FROM (SELECT row_id, words, unnest(range(len(words) // {BLOCK // 2} + 1)) AS k FROM d)
), matches AS (
  SELECT row_id, label, len(list_intersect(list_distinct(block), tokens)) / len(tokens) AS containment FROM blocks, templates
  WHERE name = '' OR contains(' ' || array_to_string(block, ' ') || ' ', ' ' || name || ' ')
), matched AS (
  SELECT row_id, list(DISTINCT label) AS matched, max(containment) AS containment FROM matches WHERE containment >= {THRESHOLD} GROUP BY row_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(matched, [])))), ',') AS labels,
  CASE WHEN base IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (row_id) LEFT JOIN matched USING (row_id)
"""


ORACLE = _oracle()
