"""License scan (native): a positional index over the rarest words of license templates.

1. Over all documents it is counted how many hold each template word; that gives the IDF of each.
2. A template is indexed by its ``INDEXED`` words of highest IDF, with their positions.
3. A template is likely in a file that holds its key phrases and enough of its indexed weight anywhere.  A file is
   looked up by the indexed words of all its likely templates, none left out: each position in the file joins the
   template postings of the word; ``position in file - position in template`` is the same for all
   words of a real copy, so votes are summed per (file, template, difference).
4. A template with at least ``SHARE`` of its indexed weight at one difference is a match if the
   file also holds its mandatory key phrases.

Fixed phrases (``BASE``) are found besides, everywhere in the text; their labels always stay.

Defined results: null and empty texts have no words, places or labels and score 0; repeated
rows get equal results; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgauge.llm.shared import lower_ascii, row_key, write_once

#: Fixed values of the contract: phrase -> label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: (label, template, mandatory key phrases); words as the scan cuts them.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     ["in compliance with the license"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
     ["gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ["permission is hereby granted free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc", "4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa", "4 0"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
]

INDEXED, SHARE = 8, 0.6
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _NOT_WORD), "")


def _places(phrase: str) -> Column:
    """Word positions at which the phrase starts; the array is only searched where the joined words hold it."""
    parts = phrase.split()
    match = " AND ".join(f"get(_words, i + {j}) = '{w}'" if j else f"_words[i] = '{w}'" for j, w in enumerate(parts))
    return F.when(
        F.col("_joined").contains(f" {phrase} "), F.expr(f"filter(sequence(0, size(_words) - 1), i -> {match})")
    ).otherwise(F.array().cast("array<int>"))


def template_postings(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, label, keys, word, at)"""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(
        f"({i}, {quoted(label)}, array({', '.join(map(quoted, keys))}), {quoted(text)})" for i, (label, text, keys) in enumerate(templates))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, label, keys, text)").select(
        "template", "label", "keys", F.posexplode(F.split("text", " ")).alias("at", "word"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per document row: ``_k1``, ``_k2`` (see ``row_key``), its id, n_words, n_base, first_word, last_word,
    base_labels, labels (sorted arrays) and score."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    phrases = sorted({k for _, _, keys in templates for k in keys})
    strings = lambda xs: F.array(*map(F.lit, xs))
    found = (
        docs.select(*row_key(doc_id, text), F.col(doc_id), F.col(text).alias("_text"))
        .withColumn("_words", _words(F.col("_text")))
        .withColumn("_joined", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))
    )
    # Key phrases are looked for only in texts that hold the first word of one, cheaply found with the vocabulary.
    first_pass = found.select(
        "_k1", "_k2", doc_id, F.size("_words").cast("bigint").alias("n_words"), F.array_intersect("_words", strings(vocabulary)).alias("present"),
        F.array_distinct(F.concat(*(F.when(F.col("_joined").contains(f" {p} "), F.array(F.lit(p))).otherwise(F.array().cast("array<string>")) for p in phrases))).alias("phrases"),
        *(_places(p).alias(f"base{i}") for i, p in enumerate(BASE)))
    first_pass = write_once(first_pass, "license-words")
    postings = write_once(_weighted(first_pass, template_postings(spark, templates)), "license-index")
    votes = _votes(docs, first_pass, postings, doc_id, text)
    all_places = F.concat(*(F.col(f"base{i}") for i in range(len(BASE))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"base{i}") > 0, F.lit(label)) for i, label in enumerate(BASE.values()))))
    return (
        first_pass.join(votes, ["_k1", "_k2"], "left")
        .withColumn("n_base", F.size(all_places).cast("bigint"))
        .withColumn("first_word", F.array_min(all_places).cast("bigint")).withColumn("last_word", F.array_max(all_places).cast("bigint"))
        .withColumn("base_labels", F.array_sort(F.array_distinct(labels)))
        .withColumn("labels", F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
        .withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))), 6))
        .select("_k1", "_k2", doc_id, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )


def _weighted(first_pass: DataFrame, postings: DataFrame) -> DataFrame:
    """The indexed postings, with the IDF of their words and the share of each in its template's weight."""
    n_docs = first_pass.agg(F.count(F.lit(1))).scalar()
    held = first_pass.select(F.explode("present").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("held"))
    weight = F.log((n_docs + 2) / (F.coalesce("held", F.lit(0)) + 1))
    weighted = postings.join(held, "word", "left").withColumn("weight", weight)
    best = weighted.groupBy("template", "word").agg(F.max("weight").alias("w")).groupBy("template").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("w", "word")), asc=False), 1, INDEXED).alias("top"))
    chosen = best.select("template", F.explode("top").alias("t"), F.aggregate("top", F.lit(0.0), lambda a, t: a + t["w"]).alias("total")).select(
        "template", F.col("t.word").alias("word"), (F.col("t.w") / F.col("total")).alias("share"))
    return weighted.join(chosen, ["template", "word"]).select("template", "label", "keys", "word", "at", "weight", "share")


def _votes(docs: DataFrame, first_pass: DataFrame, postings: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_k1, _k2, more, best): labels and best share of the templates found at one place of a file."""
    # The index words are few (INDEXED per template), so each row can carry them.
    index = postings.groupBy("template", "keys").agg(F.collect_set(F.struct("word", "share")).alias("words")).agg(
        F.collect_list(F.struct("keys", "words"))).scalar()
    words = postings.agg(F.collect_set("word")).scalar()
    # Votes at one place cannot weigh more than all words of the template that the file holds, and without its key phrases it is no match.
    likely = F.filter("index", lambda t: F.forall(t["keys"], lambda k: F.col("_joined").contains(F.concat(F.lit(" "), k, F.lit(" ")))) & (F.aggregate(
        t["words"], F.lit(0.0), lambda a, w: a + F.when(F.array_contains("_have", w["word"]), w["share"]).otherwise(F.lit(0.0))) >= SHARE - 1e-9))
    place = F.expr("filter(transform(_words, (w, i) -> named_struct('word', w, 'i', i)), x -> array_contains(rare, x.word))")
    spots = (
        docs.select(*row_key(doc_id, text), F.col(text).alias("_text"))
        .withColumn("index", index).withColumn("_words", _words(F.col("_text")))
        .withColumn("_have", F.array_intersect("_words", words))
        .withColumn("_joined", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))
        .withColumn("rare", F.array_distinct(F.flatten(F.transform(likely, lambda t: F.transform(t["words"], lambda w: w["word"])))))
        # An outer explode: for a plain one Spark filters empty arrays below, writing the whole search out into that filter.
        .select("_k1", "_k2", F.explode_outer(F.when(F.size("rare") > 0, place)).alias("p")).filter("p IS NOT NULL")
        .select("_k1", "_k2", "p.word", "p.i")
    )
    aligned = (
        spots.join(postings, "word").groupBy("_k1", "_k2", "template", "label", "keys", (F.col("i") - F.col("at")).alias("shift"), "word")
        .agg(F.max("share").alias("share"))
        .groupBy("_k1", "_k2", "template", "label", "keys", "shift").agg(F.sum("share").alias("share")).filter(f"share >= {SHARE}")
        .groupBy("_k1", "_k2", "template", "label", "keys").agg(F.max("share").alias("share"))
    )
    held = first_pass.filter("size(phrases) > 0").select("_k1", "_k2", "phrases").groupBy("_k1", "_k2").agg(F.first("phrases").alias("phrases"))
    sure = aligned.join(held, ["_k1", "_k2"]).filter(F.size(F.array_except("keys", "phrases")) == 0)
    return sure.groupBy("_k1", "_k2").agg(F.collect_set("label").alias("more"), F.max("share").alias("best"))
