"""License scans by diagonal voting: word k-gram hashes joined to template positions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Words in a k-gram.
K = 3

#: Diagonals that are so near, in words, belong to one span.
DRIFT = 3

#: Documents with candidate spans that are broadcast at most (about 100 bytes each).
BROADCAST_ROWS = 500_000

#: Phrases whose label is sure, as words.
PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}

#: Fixed notices of well-known licenses: label and words.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("proprietary", "all rights reserved no part of this work may be reproduced"),
]


def words(text: Column) -> Column:
    """Lower-cased words of digits, letters and everything beyond ASCII.

    lower() also turns letters beyond ASCII into others; those are word characters before and
    after, so no word begins or ends elsewhere.
    """
    return F.filter(F.split(F.lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def grams(hashes: Column) -> Column:
    """Rolling hashes of K consecutive word hashes."""
    last = F.size(hashes) - K
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(K)]))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, label, notice, many) with hash and place of each of its k-grams; its size is that of the list."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, notice string")
    rows = rows.withColumn("hashes", F.transform(F.split("notice", " "), lambda w: F.xxhash64(w)))
    rows = rows.withColumn("many", F.size("hashes")).select("template", "label", "notice", "many", F.posexplode(grams(F.col("hashes"))).alias("place", "gram"))
    return rows.coalesce(1)


def candidates(docs: DataFrame, templates: list[tuple[str, str]], coverage: float = 0.5) -> DataFrame:
    """Of docs (doc, print, body): spans (template, first, last) for each document in which enough k-grams vote for one.

    A k-gram at word p that stands at place t of a template votes for diagonal p - t.
    Diagonals within DRIFT words are one span; it needs ``coverage`` of the template's k-grams.
    """
    table = template_table(docs.sparkSession, templates)
    hashed = docs.select("doc", "print", F.transform(words(F.col("body")), lambda w: F.xxhash64(w)).alias("hashes"))
    every = hashed.select("doc", "print", F.posexplode(grams(F.col("hashes"))).alias("at", "gram"))
    votes = every.join(F.broadcast(table), "gram").withColumn("diagonal", F.col("at") - F.col("place"))
    by_diagonal = votes.groupBy("doc", "print", "template", "label", "notice", "many", "diagonal").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("place").alias("places"))
    order = Window.partitionBy("doc", "print", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT, F.lit(True))
    island = F.sum(F.col("far").cast("int")).over(order)
    merged = by_diagonal.withColumn("far", far).withColumn("island", island).groupBy("doc", "print", "template", "label", "notice", "many", "island").agg(F.min("first").alias("first"), (F.max("last") + K).alias("last"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    voted = merged.where(F.size("places") >= coverage * (F.col("many") - K + 1))
    return voted.groupBy("doc", "print").agg(F.collect_list(F.struct("label", "notice", "many", "first", "last", "places")).alias("spans"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, similarity: float = 0.9) -> DataFrame:
    """One row per document: key, n_words, base_starts, base_labels, spans (label, first, last, similarity), labels and score.

    ``base_starts`` are the words, counted from 0, where a phrase of PHRASES stands. A span
    found by its votes is verified by the edit similarity of its words, from the template's
    first to its last, to the notice. score is 1 where a phrase stands, else the best
    similarity of a verified span, else 0. Null texts are empty; documents are told apart by
    key and text, so rows that repeat both get equal results, and a null key is a key.
    """
    named = docs.select(F.col(f"`{key}`").alias("doc"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body")).withColumn("print", F.xxhash64("body"))
    found = written(candidates(named, templates), "spans").select(F.col("doc").alias("its_doc"), F.col("print").alias("its_print"), "spans")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    both = named.join(found, F.col("doc").eqNullSafe(F.col("its_doc")) & (F.col("print") == F.col("its_print")), "left")
    split = both.select("doc", "spans", words(F.col("body")).alias("words"))
    ends = F.when(F.array_contains("words", "license"), F.filter(F.transform("words", lambda w, i: F.when(w == "license", i).otherwise(-1)), lambda i: i >= 0)).otherwise(F.array().cast("array<int>"))
    ends = split.select("doc", "spans", "words", ends.alias("ends"))

    def starts(phrase: list[str]) -> Column:
        back = len(phrase) - 1
        fits = lambda i: F.coalesce(F.array_join(F.slice("words", F.greatest(i - back + 1, F.lit(1)), back), " ") == " ".join(phrase[:-1]), F.lit(False)) & (i >= back)
        return F.transform(F.filter("ends", fits), lambda i: (i - back).cast("long"))

    def checked(span: Column) -> Column:
        # a template's words lie from its first k-gram's place on; places tell how far the span's edges are from the template's
        first = F.greatest(span["first"] - F.array_min(span["places"]), F.lit(0))
        width = F.greatest(span["last"] - first, F.least(span["many"], F.size("words") - first))
        body = F.array_join(F.slice("words", first + 1, F.least(width, span["many"] + DRIFT)), " ")
        alike = 1 - F.levenshtein(body, span["notice"]) / F.greatest(F.length(body), F.length(span["notice"]))
        return F.struct(span["label"].alias("label"), first.cast("long").alias("first"), (first + F.least(width, span["many"] + DRIFT)).cast("long").alias("last"), alike.alias("similarity"))

    none = F.array().cast("array<struct<label:string,first:bigint,last:bigint,similarity:double>>")
    spans = F.filter(F.coalesce(F.transform("spans", checked), none), lambda s: s["similarity"] >= similarity)
    places = ends.select("doc", F.size("words").cast("long").alias("n_words"), spans.alias("spans"), *[starts(p).alias(f"at_{label}") for label, p in PHRASES.items()])
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"at_{label}") > 0, label) for label in PHRASES])))
    out = places.select("doc", "n_words", F.array_sort(F.concat(*[f"at_{label}" for label in PHRASES])).alias("base_starts"), base.alias("base_labels"), "spans")
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("spans", lambda s: s["label"]))))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0))
    score = F.when(F.size("base_labels") > 0, 1.0).otherwise(best)
    return out.select(F.col("doc").alias(key), "n_words", "base_starts", "base_labels", "spans", labels.alias("labels"), score.alias("score"))
