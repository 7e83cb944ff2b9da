"""License scan by diagonal voting.

All rolling three-word grams of a text are hash-joined to the positions of the same grams in the templates. A
pair of positions lies on a diagonal (text position minus template position); a passage that follows a template
word by word puts all its grams on one diagonal, an inserted or dropped word moves the rest to a neighbouring
diagonal. Votes are counted on each diagonal, neighbouring diagonals of one template are merged into a span, and
a span is accepted by the share of the template's grams it holds.

Two kinds of template. A phrase counts only where its words stand consecutively, that is, where one diagonal has
all its grams; hash matches are confirmed on the words themselves, so no place is found by a hash collision. A
notice counts if its span covers ``coverage`` of its grams.

Defined results: a null text is an empty one, with no words and no labels; repeated rows are scanned each for
itself; very long texts stay one row until their grams are unfolded row by row; an empty table gives an empty
result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardline.llm.common import lower_ascii, text_or_empty, values

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Opening words of well-known license notices and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "licensed under the apache license version 2 0": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "under the terms of the gnu lesser general public license": "lgpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "released under the mit license": "mit",
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3


def words(text: Column) -> Column:
    """Runs of a-z, 0-9 and characters beyond ASCII, A-Z in lower case."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def _grams(tokens: Column) -> Column:
    """One struct for each position, with the word there and those after it (null behind the end)."""
    rest = [F.slice(tokens, i + 1, F.greatest(F.size(tokens) - i, F.lit(0))) for i in range(1, GRAM)]
    return F.arrays_zip(tokens.alias("w0"), *(x.alias(f"w{i}") for i, x in enumerate(rest, 1)))


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """Positions of all template grams: a table as large as the templates, whatever the texts."""
    for text in [*phrases, *notices]:
        if len(text.split()) < GRAM:
            raise ValueError(f"a template needs {GRAM} words at least: {text!r}")
    rows = [(i, label, text, exact) for i, (text, label, exact) in enumerate(
        [(t, x, True) for t, x in phrases.items()] + [(t, x, False) for t, x in notices.items()])]
    listed = values(spark, rows, ["template", "label", "phrase", "exact"])
    tokens = words(F.col("phrase"))
    at = listed.select("template", "label", "exact", F.size(tokens).alias("length"), F.posexplode(_grams(tokens)).alias("t_at", "t"))
    return at.where(f"t.w{GRAM - 1} is not null").withColumn("hash", F.xxhash64(*(f"t.w{i}" for i in range(GRAM))))


def scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    phrases: dict[str, str] = PHRASES,
    notices: dict[str, str] = NOTICES,
    coverage: float = 0.8,
    band: int = 3,
) -> DataFrame:
    """One row a document: counts and places of phrases, labels, a score and the accepted spans.

    ``coverage``: least share of a notice's grams in a span; ``band``: how many words apart two diagonals may be
    and still belong to one span. The join side that is broadcast holds the templates, whose size the caller
    fixes. Only matches and one row a document are shuffled. A passage shared by many documents adds rows for
    each of them, never pairs of documents.
    """
    spark = docs.sparkSession
    tokens = docs.select(
        F.col(id_column).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        words(text_or_empty(text_column)).alias("words"),
    )
    unfolded = tokens.select("doc_id", "row", F.size("words").cast("bigint").alias("n_words"), F.posexplode_outer(_grams(F.col("words"))).alias("at", "g"))
    hashed = unfolded.withColumn("hash", F.xxhash64(*(f"g.w{i}" for i in range(GRAM))))
    same = (hashed["hash"] == F.col("m.hash")) & (F.col(f"g.w{GRAM - 1}") == F.col(f"t.w{GRAM - 1}"))
    for i in range(GRAM - 1):
        same &= F.col(f"g.w{i}") == F.col(f"t.w{i}")
    lists = F.broadcast(templates(spark, phrases, notices).alias("m"))
    found = hashed.join(lists, same, "left").where("template is not null or coalesce(at, 0) = 0")

    # Votes on each diagonal. The row of the first position stands for the document where nothing matched.
    votes = found.groupBy("row", "doc_id", "n_words", "template", "label", "exact", "length", (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        F.count("t_at").alias("votes"), F.collect_set("t_at").alias("hit"),
        F.min("at").alias("from_at"), F.max("at").alias("to_at"),
    )
    line = W.partitionBy("row", "template").orderBy("diagonal")
    opens = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= F.when(F.col("exact"), 0).otherwise(band), 0).otherwise(1)
    spans = (
        votes.withColumn("span", F.sum(opens).over(line))
        .groupBy("row", "doc_id", "n_words", "template", "label", "exact", "length", "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("covered"),
            F.min("from_at").alias("start"),
            (F.max("to_at") + GRAM).alias("end"),
        )
    )
    share = F.col("covered") / (F.col("length") - (GRAM - 1))
    accepted = F.when(F.col("exact"), share == 1.0).otherwise(share >= coverage)
    judged = spans.withColumn("share", share).withColumn("ok", F.coalesce(accepted, F.lit(False)))
    base = F.col("ok") & F.col("exact")

    def labels(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return (
        judged.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
            labels(base).alias("base_labels"),
            labels(F.col("ok")).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).cast("double").alias("score"),
            F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "label")))).alias("spans"),
        )
        .drop("row")
    )
