"""License scans by diagonal voting.

Rolling pairs of words, hashed, meet the positions of the same pairs in license templates in
one Spark join; the words themselves are compared too, so a hash collision gives no vote. A
vote lies on the diagonal "place in the document minus place in the template". Votes are
combined per diagonal before any shuffle, as a bit mask of the template's places. A phrase is
found where a diagonal holds its whole mask. A longer notice may have words added or left out:
the masks of neighbouring diagonals are merged, and a span counts when enough of the template
was seen within a span of about its length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import lower_ascii

#: Fixed value: letters, digits and everything outside ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Own templates: notices commonly put into files and pages, at most 60 words each.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless "
        "required by applicable law or agreed to in writing software distributed under the license "
        "is distributed on an as is basis without warranties or conditions of any kind",
        "apache-2.0",
    ),
    ("released under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files to deal in the software without restriction",
        "mit",
    ),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of "
        "the gnu general public license as published by the free software foundation",
        "gpl",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
        "bsd",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mpl-2.0",
    ),
]


def template_pairs(spark: SparkSession, phrases=None, notices=None) -> DataFrame:
    """One row per pair of neighbouring words of each template: a fixed, small table."""
    rows = []
    both = [(t, label, True) for t, label in (PHRASES if phrases is None else phrases)]
    both += [(t, label, False) for t, label in (NOTICES if notices is None else notices)]
    for number, (text, label, is_phrase) in enumerate(both):
        words = re.findall(WORD, text)
        if not 2 <= len(words) <= 63:
            raise ValueError(f"a template has 2 to 63 words: {text}")
        for place, (first, second) in enumerate(zip(words, words[1:])):
            rows.append((number, label, is_phrase, len(words) - 1, place, first, second))
    schema = (
        "template int, label string, is_phrase boolean, n_pairs int, place int, t1 string, t2 string"
    )
    return spark.createDataFrame(rows, schema).withColumn("pair", F.xxhash64("t1", "t2"))


def words_of(text: Column) -> Column:
    lowered = lower_ascii(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def scan_licenses(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    phrases: list[tuple[str, str]] | None = None,
    notices: list[tuple[str, str]] | None = None,
    max_drift: int = 2,
    min_coverage: float = 0.8,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score.

    Null text counts as empty and has no words. ``n_base`` counts the places of all phrases,
    overlapping ones too; ``first_word`` and ``last_word`` are the smallest and largest start,
    null without a place. ``labels`` adds the labels of notices of which at least
    ``min_coverage`` of the word pairs stand within ``max_drift`` added or missing words;
    ``score`` is the largest such share, 1 for a phrase, 0 without a label. Rows repeated with one
    id and text get the same result; rows with one id and different texts are scanned apart.
    """
    spark = docs.sparkSession
    pairs = template_pairs(spark, phrases, notices)
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
        words_of(F.col(text)).alias("words"),
    )
    neighbours = F.zip_with(
        "words",
        F.slice("words", 2, 10**9),
        lambda a, b: F.struct(a.alias("w1"), b.alias("w2")),
    )
    rolling = keyed.select("doc_id", "text_hash", F.posexplode(neighbours).alias("at", "said"))
    rolling = rolling.select("doc_id", "text_hash", "at", "said.w1", "said.w2")
    rolling = rolling.where("w2 is not null").withColumn("pair", F.xxhash64("w1", "w2"))
    # the template table is fixed text of a few hundred rows
    votes = rolling.join(F.broadcast(pairs), "pair").where("w1 = t1 and w2 = t2")

    diagonal = (F.col("at") - F.col("place")).alias("diagonal")
    key = ["doc_id", "text_hash", "template", "label", "is_phrase", "n_pairs"]
    diagonals = votes.groupBy(*key, diagonal).agg(
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
    )
    near = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    near = near.rangeBetween(-max_drift, max_drift)
    spans = diagonals.select(
        *key,
        "diagonal",
        F.bit_count("mask").alias("own"),
        F.bit_count(F.bit_or("mask").over(near)).alias("merged"),
        (F.max("last_at").over(near) - F.min("first_at").over(near) + 1).alias("length"),
    )
    whole = F.col("is_phrase") & (F.col("own") == F.col("n_pairs"))
    coverage = F.when(F.col("is_phrase"), F.col("own") / F.col("n_pairs")).otherwise(
        F.col("merged") / F.col("n_pairs")
    )
    verified = ~F.col("is_phrase") & (coverage >= min_coverage)
    verified = verified & (F.col("length") <= F.col("n_pairs") + 2 * max_drift)
    found = (
        spans.select("*", whole.alias("base"), (whole | verified).alias("hit"), coverage.alias("share"))
        .where("hit")
        .groupBy("doc_id", "text_hash")
        .agg(
            F.count_if("base").alias("n_base"),
            F.min(F.when(F.col("base"), F.col("diagonal"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("diagonal"))).alias("last_word"),
            F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_set"),
            F.collect_set("label").alias("label_set"),
            F.max("share").alias("score"),
        )
        .withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    )
    sizes = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
        F.regexp_count(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD)).alias("n_words"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash"))

    def joined(labels: str) -> Column:
        return F.coalesce(F.array_join(F.array_sort(labels), ","), F.lit(""))

    return sizes.join(found, same, "left").select(
        "doc_id",
        F.col("n_words").cast("long"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"),
        F.col("last_word").cast("long"),
        joined("base_set").alias("base_labels"),
        joined("label_set").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
