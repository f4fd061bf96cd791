"""License scans by diagonal voting; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose every place counts, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Opening sentences of public licenses, in words as WORD gives them.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("the person who associated a work with this deed has dedicated the work to the public domain", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("released under the mit license", "mit"),
)

#: SQL rows of the above: tid, base, label, text.
VALUES = ", ".join(
    f"({i}, {str(i < len(PHRASES)).upper()}, '{label}', '{text}')" for i, (text, label) in enumerate((*PHRASES, *TEMPLATES))
)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slack: int = 3, votes: int = 2, least: float = 0.6) -> DataFrame:
    """Places of license phrases and passages in whole texts.

    Every 2-gram of a document's words is hashed and joined to the grams of the templates (a fixed
    list of a few hundred rows, hence broadcast); the join also compares the gram itself. Hits vote
    for their diagonal (place in the document less place in the template). Diagonals of one template
    with ``votes`` hits or more and at most ``slack`` apart merge, so that words put in or left out
    don't break a match; a span is verified when its distinct grams are ``least`` of the template's.
    A phrase counts only whole, on one diagonal. Only hits are shuffled, once, by row.

    One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score
    (largest part of a template found; a whole phrase is 1). Null and empty texts have no words and
    score 0 with empty labels; repeated rows give a row each; other columns are ignored.
    """
    spark = docs.sparkSession
    grams = lambda words: F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    safe = lambda words: F.when(F.size(words) > 1, grams(words)).otherwise(F.array().cast("array<string>"))
    templates = (
        spark.sql(f"SELECT * FROM VALUES {VALUES} AS t(tid, base, label, phrase)")
        .withColumn("words", F.split("phrase", " "))
        .select("tid", "base", "label", (F.size("words") - 1).alias("grams"), F.posexplode(grams(F.col("words"))).alias("tpos", "template_gram"))
        .unionAll(spark.sql("SELECT * FROM VALUES (-2, FALSE, '', 0, 0, '\\u0000'), (-1, FALSE, '', 0, 0, '\\u0001')"))
        .withColumn("hash", F.xxhash64("template_gram"))
    )
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(WORD), 0)
    # after the grams of a row stands a mark that no word can be: it tells the number of words, so that each text is read once
    mark = F.when(F.size("words") > 0, F.lit("\u0001")).otherwise(F.lit("\u0000"))
    hits = (
        docs.select(F.col(id_col).alias("id"), words.alias("words")).withColumn("row", F.monotonically_increasing_id())
        .select("row", "id", F.posexplode(F.concat(safe(F.col("words")), F.array(mark))).alias("pos", "gram"))
        .withColumn("hash", F.xxhash64("gram"))
        .join(F.broadcast(templates), "hash").where("gram = template_gram")
        .select("row", "id", "tid", "base", "label", "grams", "tpos", "pos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .repartition("row")
    )
    key = ["row", "id", "tid", "base", "label", "grams"]
    diagonals = hits.groupBy(*key, "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.collect_set("tpos").alias("found"))
    held = diagonals.where(F.expr(f"tid < 0 OR (base AND votes = grams) OR (NOT base AND votes >= {votes})"))
    along = Window.partitionBy("row", "tid").orderBy("diagonal")
    apart = (F.col("tid") < 0) | F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > slack, F.lit(True))
    spans = (
        held.withColumn("opens", apart.cast("int"))
        .withColumn("band", F.sum("opens").over(along))
        .groupBy(*key, "band")
        .agg(F.min("diagonal").alias("start"), F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("covered"))
        .withColumn("part", F.when(F.col("tid") < 0, 0.0).when(F.col("base"), 1.0).otherwise(F.col("covered") / F.col("grams")))
    )
    whole = F.col("base")
    labels = lambda on: F.array_join(F.array_sort(F.collect_set(F.when(on, F.col("label")))), ",")
    return spans.groupBy("row", "id").agg(
        F.max(F.expr("CASE tid WHEN -1 THEN start + 1 WHEN -2 THEN 0 END")).cast("long").alias("n_words"),
        F.count(F.when(whole, 1)).alias("n_base"),
        F.min(F.when(whole, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("start"))).cast("long").alias("last_word"),
        labels(whole).alias("base_labels"),
        labels((F.col("tid") >= 0) & (F.col("part") >= least)).alias("labels"),
        F.max("part").alias("score"),
    ).drop("row").withColumnRenamed("id", id_col)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(len(words) - 1)) AS pos, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS gram FROM w WHERE len(words) > 1),
t0(tid, base, label, phrase) AS (VALUES {VALUES}),
t AS (SELECT tid, base, label, len(string_split(phrase, ' ')) - 1 AS grams, unnest(range(len(string_split(phrase, ' ')) - 1)) AS tpos,
        unnest(list_transform(range(1, len(string_split(phrase, ' '))), lambda i: string_split(phrase, ' ')[i] || ' ' || string_split(phrase, ' ')[i + 1])) AS gram FROM t0),
h AS (SELECT doc_id, tid, base, label, grams, tpos, pos - tpos AS diagonal FROM g JOIN t USING (gram)),
d AS (SELECT doc_id, tid, base, label, grams, diagonal, COUNT(*) AS votes FROM h GROUP BY ALL),
k AS (SELECT * FROM d WHERE CASE WHEN base THEN votes = grams ELSE votes >= 2 END),
o AS (SELECT *, CASE WHEN base OR COALESCE(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) > 3, TRUE) THEN 1 ELSE 0 END AS opens FROM k),
b AS (SELECT *, SUM(opens) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS band FROM o),
s AS (SELECT b.doc_id, b.tid, b.base, b.label, MIN(b.diagonal) AS start, CASE WHEN b.base THEN 1.0::DOUBLE ELSE COUNT(DISTINCT h.tpos)::DOUBLE / MIN(b.grams) END AS part
      FROM b JOIN h ON h.doc_id = b.doc_id AND h.tid = b.tid AND h.diagonal = b.diagonal GROUP BY b.doc_id, b.tid, b.base, b.label, b.band),
r AS (SELECT doc_id, COUNT(*) FILTER (base) AS n_base, MIN(start) FILTER (base) AS first_word, MAX(start) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (part >= 0.6) AS labels, MAX(part) AS score FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, COALESCE(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels, COALESCE(score, 0.0::DOUBLE) AS score FROM w LEFT JOIN r USING (doc_id)
"""
