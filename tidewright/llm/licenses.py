"""License scans: phrases that stand word for word, and an exact set-similarity join of text blocks with license templates.

A template of L words has a block at every place of a text: the L words that start there. It is met where some block's
word set holds at least `threshold` of the template's. Template words are ordered by how often the whole corpus holds
them. A block that meets a template of n distinct words at a = ceil(threshold * n) of them must hold one of its
n - a + 1 rarest (prefix filter), so texts are joined with templates on those words alone; a text must hold a template
words in all (length filter), and as many from the first shared one on in the template's order (positional filter).

What passes is verified over every block by a sweep. An occurrence of a word adds to a block's distinct words if the
block starts after the word's occurrence before and at most L - 1 words before this one; so it adds one to all blocks in
a range of starts, and running sums over the ranges' ends give each block's exact count. The cost follows the number of
template words in the text. All of it is DataFrame functions, and texts are split once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import alnum_words, without, written

#: Fixed values of the contract: phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices as their licenses word them, by label.
TEMPLATES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license",
    "cc-by-notice": "this work is licensed under a creative commons attribution international license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort "
        "or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
}
#: Distinct words, of all templates or of their prefixes, that may be part of the plan; more are joined as a table, with the same result.
MOST_WORDS = 50_000


def base_places(words: Column) -> list[tuple[str, Column, Column, Column]]:
    """For each phrase its label, number of places, first and last start (in words from 0, or null)."""
    # Each word has a blank of its own at either end, so neighbouring places share nothing.
    flat = F.when(F.size(words) > 0, F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))).otherwise("")
    places = []
    for phrase, label in PHRASES:
        sought = " " + phrase.replace(" ", "  ") + " "
        n = (F.length(flat) - F.length(F.replace(flat, F.lit(sought), F.lit("")))) / len(sought)
        before = lambda head: (F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))) / 2
        first = F.when(n > 0, before(F.substring_index(flat, sought, 1)))
        last = F.when(n > 0, F.size(words) - before(F.substring_index(flat, sought, -1)) - len(phrase.split()))
        places.append((label, n.cast("long"), first.cast("long"), last.cast("long")))
    return places


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "label string, text string")


def ranked_templates(templates: DataFrame, spots: DataFrame, threshold: float) -> DataFrame:
    """(tid, label, size, words, least): each template with its distinct words, the corpus' rarest first; spots holds their places as (word)."""
    counts = spots.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    rows = templates.select("tid", "label", F.size("tokens").alias("size"), F.explode(F.array_distinct("tokens")).alias("word")).join(counts, "word", "left")
    ranked = rows.groupBy("tid", "label", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "word"))).alias("r"))
    return ranked.select("tid", "label", "size", F.transform("r", lambda x: x["word"]).alias("words"), F.ceil(F.size("r") * threshold - 1e-9).cast("int").alias("least"))


def few_words(rows: DataFrame, most: int) -> list[str] | None:
    """The distinct words of a table (word), or None if there are more than `most`."""
    found = [r["word"] for r in rows.select("word").distinct().limit(most + 1).collect()]
    return found if len(found) <= most else None


def met_templates(rows: DataFrame, templates: DataFrame, threshold: float, most_words: int = MOST_WORDS) -> DataFrame:
    """(_rid, _more, _best): the labels of the templates that some block of a row meets, and the highest containment. rows has _rid and _spots."""
    ranked = written(ranked_templates(templates, rows.select(F.explode("_spots").alias("s")).select("s.word"), threshold), "ranked_templates")
    n_words = ranked.agg(F.sum(F.size("words") * F.size("words"))).first()[0] or 0
    # Templates go to every task only if their prefixes, each with its template's words, are a few million words at most.
    sent = F.broadcast if n_words <= 4_000_000 else lambda df: df
    prefixes = ranked.select("*", F.posexplode(F.slice("words", F.lit(1), F.size("words") - F.col("least") + 1)).alias("i", "word"))
    rare = few_words(prefixes, most_words)
    held = rows.where(F.size("_spots") > 0).withColumn("_held", F.array_distinct(F.transform("_spots", lambda s: s["word"])))
    if rare is not None:
        places = held.select("_rid", "_spots", "_held", F.explode(F.filter("_held", lambda w: w.isin(rare))).alias("word"))
    else:
        # Only ids and words meet the prefixes; a row's arrays join what is left of them.
        places = held.select("_rid", F.explode("_held").alias("word")).join(sent(prefixes.select("word").distinct()), "word", "left_semi").join(held.select("_rid", "_spots", "_held"), "_rid")
    pairs = places.join(sent(prefixes), "word")
    # The first of the template's words that the text holds stands for the pair, so a pair comes up once.
    shared = F.array_intersect("words", "_held")
    pairs = pairs.where((F.get(shared, F.lit(0)) == F.col("word")) & (F.size("_held") >= F.col("least")) & (F.size(F.array_intersect(F.slice("words", F.col("i") + 1, F.size("words")), "_held")) >= F.col("least")))
    found = pairs.select("_rid", "tid", F.inline("_spots")).join(sent(ranked.select("tid", "size", F.explode("words").alias("word"))), ["tid", "word"])
    before = F.lag("pos").over(W.partitionBy("_rid", "tid", "word").orderBy("pos"))
    found = found.repartition("_rid", "tid").select("_rid", "tid", "pos", F.greatest(before + 1, F.col("pos") - F.col("size") + 1).alias("start"))
    ends = found.select("_rid", "tid", F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("step")))))
    swept = ends.select("_rid", "tid", F.sum("step").over(W.partitionBy("_rid", "tid").orderBy("at")).alias("n"))
    met = swept.groupBy("_rid", "tid").agg(F.max("n").alias("n")).join(sent(ranked), "tid").where("n >= least")
    return met.groupBy("_rid").agg(F.collect_set("label").alias("_more"), F.max(F.col("n") / F.size("words")).alias("_best"))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, threshold: float = 0.8, most_words: int = MOST_WORDS) -> DataFrame:
    """The columns of docs without text, and n_words, n_base, first_word, last_word, base_labels, labels and score.

    Base labels are those of PHRASES. labels adds those of the templates (label, text; of any length, by default
    TEMPLATES) that some block meets. score is 1 where a phrase stands, else the highest containment met, else 0. Null and
    empty texts have no words and no labels; very long ones are scanned as a whole. Rows that repeat a doc_id are judged
    each by its own text; a null doc_id is scanned as any other; an empty table gives an empty one. Templates without
    label or words are left out, repeated ones count once; whether their distinct words are in the plan (up to most_words)
    or joined as a table changes no result.
    Columns beside doc_id and text pass unchanged, but those named as an added one or with a leading underscore are dropped first.
    """
    spark = docs.sparkSession
    docs = without(docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    names = [c for c in docs.columns if c != "text"]
    given = default_templates(spark) if templates is None else templates
    given = given.where("label is not null").select("label", alnum_words(F.col("text")).alias("tokens")).where(F.size("tokens") > 0).distinct()
    given = written(given.withColumn("tid", F.monotonically_increasing_id()), "license_templates")
    known = few_words(given.select(F.explode("tokens").alias("word")), most_words)
    rows = docs.withColumn("_words", alnum_words(F.col("text")))
    places = base_places(F.col("_words"))
    labels = F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for label, n, _, _ in places]))
    place = lambda w, i: F.struct(i.alias("pos"), w.alias("word"))
    # Of so many template words any word of a text may be one: all are kept, and the joins tell.
    spots = F.transform("_words", place) if known is None else F.array_compact(F.transform("_words", lambda w, i: F.when(w.isin(known), place(w, i))))
    rows = written(rows.select(
        *names, F.size("_words").cast("long").alias("n_words"), sum((n for _, n, _, _ in places), F.lit(0).cast("long")).alias("n_base"),
        F.least(*[first for _, _, first, _ in places]).alias("first_word"), F.greatest(*[last for _, _, _, last in places]).alias("last_word"),
        labels.alias("_base"), spots.alias("_spots"), F.monotonically_increasing_id().alias("_rid")), "license_words")
    found = met_templates(rows.select("_rid", "_spots"), given, threshold, most_words)
    rows = rows.drop("_spots").join(found, "_rid", "left")
    return rows.select(
        *names, "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs)


def _sql() -> str:
    phrases = ", ".join(f"(['{phrase.replace(' ', chr(39) + ',' + chr(39))}'], '{label}')" for phrase, label in PHRASES)
    templates = ", ".join(f"(string_split('{text}', ' '), '{label}')" for label, text in TEMPLATES.items())
    return rf"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), phrases(phrase, label) AS (VALUES {phrases}), templates(tokens, label) AS (VALUES {templates}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1] = phrase[1] AND words[i + 1:i + len(phrase)] = phrase)) AS pos FROM worded, phrases
), base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM places GROUP BY doc_id
), spots AS (
  SELECT doc_id, label, len(tokens) AS size, len(list_distinct(tokens)) AS n, pos, word
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM worded) w JOIN (SELECT label, tokens, unnest(list_distinct(tokens)) AS word FROM templates) t USING (word)
), blocks AS (
  SELECT a.doc_id, a.label, a.n, count(DISTINCT b.word) AS shared FROM spots a JOIN spots b ON a.doc_id = b.doc_id AND a.label = b.label AND b.pos >= a.pos AND b.pos < a.pos + a.size
  GROUP BY a.doc_id, a.label, a.n, a.pos
), met AS (
  SELECT doc_id, label, max(shared::DOUBLE / n) AS containment FROM blocks WHERE shared >= ceil(0.8 * n - 1e-9) GROUP BY doc_id, label
), all_labels AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels, max(containment) AS best FROM (
    SELECT doc_id, label, max(containment) AS containment FROM (SELECT * FROM met UNION ALL SELECT doc_id, label, 1.0 FROM places) GROUP BY doc_id, label) GROUP BY doc_id
), base_labels AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM worded w LEFT JOIN base USING (doc_id) LEFT JOIN all_labels USING (doc_id) LEFT JOIN base_labels USING (doc_id)
"""


SQL = _sql()
