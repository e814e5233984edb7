"""License notices found by diagonal voting.

Every rolling word k-gram of a text is hashed and joined to the positions of the
templates' k-grams.  A match votes for the diagonal (text position minus template
position); neighbouring diagonals are merged and the spans verified by how much of
the template they cover.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkgrid.llm.common import lower_ascii

K = 3
#: Phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Notices of well-known licenses and their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution noncommercial", "cc-by-nc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("all rights reserved", "all-rights-reserved"),
]
#: The template side is sent to every task only up to this many k-grams.
BROADCAST_GRAMS = 1_000_000


def words_of(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII, after A-Z became a-z."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(hashes: str, k: int = K) -> Column:
    """Hash of the k words from each position on, out of a column of word hashes; empty with fewer words."""
    starts = F.sequence(F.lit(0), F.size(hashes) - k)
    rolled = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col(hashes), i + j) for j in range(k)]))
    return F.when(F.size(hashes) >= k, rolled).otherwise(F.array().cast("array<bigint>"))


def templates(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]], k: int = K) -> DataFrame:
    """``template, label, phrase, grams, gram, at`` with one row per k-gram."""
    rows = [(i, text, label, i < len(phrases)) for i, (text, label) in enumerate([*phrases, *notices])]
    frame = spark.createDataFrame(rows, "template int, text string, label string, phrase boolean")
    frame = frame.withColumn("_h", word_hashes(words_of(F.col("text")))).withColumn("_g", gram_hashes("_h", k)).withColumn("grams", F.size("_g"))
    return frame.select("template", "label", "phrase", "grams", F.posexplode("_g").alias("at", "gram"))


def scan(docs: DataFrame, phrases: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None, k: int = K, drift: int = 3, cover: float = 0.7) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row of ``docs``.

    Base places are diagonals on which all k-grams of a phrase voted, that is, where
    its words stand one after another; phrases need at least ``k`` words.  Notices
    may be broken by a few edits: diagonals at most ``drift`` apart are merged, and
    a span counts if ``cover`` of the template's distinct k-grams voted.  ``score``
    is the best share of a template found (1 for a base place, 0 without any).
    Null and empty texts have no words; a text with fewer than ``k`` words has no
    k-gram.  Rows are told apart by a number given in the scan, so repeated rows
    each come out.  Other columns are ignored.
    """
    spark = docs.sparkSession
    known = templates(spark, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices, k)
    mark = F.xxhash64(F.lit("row"), F.lit(k))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("template", "int"), ("label", "string"), ("phrase", "boolean"), ("grams", "int"), ("at", "int"))]
    # One more row, whose hash every text gets besides its own: rows without any match stay in the join.
    known = known.unionByName(spark.range(1).select(*none, mark.alias("gram")))
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", word_hashes(words_of(F.col("text"))).alias("_h"))
    texts = texts.select("uid", "doc_id", F.size("_h").cast("long").alias("n_words"), F.concat(gram_hashes("_h", k), F.array(mark)).alias("_g"))
    rolled = texts.select("uid", "doc_id", "n_words", F.posexplode("_g").alias("pos", "gram"))
    small = known.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    votes = rolled.join(F.broadcast(known) if small else known, "gram")
    diagonals = votes.groupBy("uid", "doc_id", "n_words", "template", "label", "phrase", "grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    here = W.partitionBy("uid", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(here) > drift).cast("int"), F.lit(1))
    bands = diagonals.withColumn("_new", F.when(F.col("phrase"), F.lit(1)).otherwise(fresh)).withColumn("_band", F.sum("_new").over(here))
    spans = bands.groupBy("uid", "doc_id", "n_words", "template", "label", "phrase", "grams", "_band").agg(
        F.min("diagonal").alias("start"), (F.size(F.array_distinct(F.flatten(F.collect_list("ats")))) / F.first("grams")).alias("share"))
    base = F.col("phrase") & (F.col("share") == 1)
    found = F.when(base | (~F.col("phrase") & (F.col("share") >= cover)), F.col("label"))
    rows = spans.groupBy("uid", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(found)), ",").alias("labels"),
        F.coalesce(F.max(F.when(found.isNotNull(), F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return rows.drop("uid")
