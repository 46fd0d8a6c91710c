"""License scans by an exact set-similarity join.

Text blocks and license templates are sets of words. All words of templates are put in one order,
rarest in the corpus first. A block that holds the needed part of a template shares a word with
the template's prefix in that order, the block's own prefix holds that word too, and what follows
it must still suffice; these three filters find the candidates through an equality join on single
words, and the candidates are counted out exactly. A template's blocks are spans of three times its words or more at every half of
that, so that each span of one and a half times its words is within one block, wherever it begins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table

# The phrases whose places are counted, with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Wordings of license notices, with their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is distributed under the gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
     "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
     "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
     "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
     "with the software or the use or other dealings in the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
     "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
     "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "isc"),
)
# Words too common to tell a notice by; templates are compared without them.
COMMON = frozenset("a and any are by can in is it of or the this to with".split())
THRESHOLD = 0.8
#: A template's block has so many words at least, and SLACK times the template's, up to the next power of two.
LEAST_BLOCK, SLACK = 64, 3
#: Between words: ASCII other than digits and letters. A-Z count as a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return sorted(set(text.split()) - COMMON)


def block_of(text: str) -> int:
    """Words of a template's blocks. They stand at every half, so each span of half a block, one and a half times the template with all its words, is within one."""
    return max(LEAST_BLOCK, 1 << (SLACK * len(text.split()) - 1).bit_length())


def needed(n: int, threshold: float) -> int:
    """Words of a template of n that a block must hold."""
    return max(1, math.ceil(threshold * n - 1e-9))


def telling_words(text: str, threshold: float) -> list[str]:
    """Words of a template of which a block that holds the threshold's part has one at least: one more than it may lack, the longest, as these are rare."""
    words = sorted(template_words(text), key=lambda w: (-len(w), w))
    return words[: len(words) - needed(len(words), threshold) + 1]


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of given rows, as an expression."""
    names = [c.split() for c in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def words_of(text: Column) -> Column:
    """The words of a text; there may be an empty one first and one last."""
    # lower() makes an ASCII letter of one sign beyond ASCII, the Kelvin sign, which must stay what it is
    return F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å"))), BETWEEN)


def phrase_places(hits: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after the other, from hits sorted by place."""
    words = phrase.split()

    def here(i: Column) -> Column:
        test = F.get(hits, i)["w"] == words[0]
        for k, w in enumerate(words[1:], 1):
            test = test & F.coalesce((F.get(hits, i + k)["w"] == w) & (F.get(hits, i + k)["pos"] == F.get(hits, i)["pos"] + k), F.lit(False))
        return test

    places = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), here)
    return F.when(F.size(hits) > 0, F.transform(places, lambda i: F.get(hits, i)["pos"])).otherwise(F.array().cast("array<long>"))


def found_words(docs: DataFrame, vocabulary: list[str], telling: list[str]) -> DataFrame:
    """row, doc_id, n_words and hits (places and words of the vocabulary) of each document; only those with a telling word have hits."""
    words = F.transform(F.col("_words"), lambda w, i: F.struct((i - F.col("_lead")).cast("long").alias("pos"), w.alias("w")))
    some = F.arrays_overlap("_words", F.array(*map(F.lit, telling)))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("_words"))
    split = split.withColumn("_lead", (F.get("_words", F.lit(0)) == "").cast("int"))
    last = (F.size("_words") > 1) & (F.get("_words", F.size("_words") - 1) == "")
    hits = F.when(some, F.filter(words, lambda x: x["w"].isin(vocabulary))).otherwise(F.array().cast("array<struct<pos:long,w:string>>"))
    n = (F.size("_words") - F.col("_lead") - last.cast("int")).cast("long")
    return split.select(F.monotonically_increasing_id().alias("row"), "doc_id", n.alias("n_words"), hits.alias("hits"))


def similar_blocks(found: DataFrame, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """(row, label, containment) of every block that holds the threshold's part of a template; a block of some width holds the words of that width's templates only."""
    spark = found.sparkSession
    sized = [(i, label, w, len(template_words(text)), needed(len(template_words(text)), threshold), block_of(text)) for i, (text, label) in enumerate(templates) for w in template_words(text)]
    words = values(spark, sized, "template int, label string, w string, size int, need int, width int")
    single = found.select("row", F.explode("hits").alias("h")).select("row", "h.pos", "h.w").join(F.broadcast(words.select("w").distinct()), "w")
    # global order: all words of all templates, those that the corpus lacks first
    seen = single.groupBy("w").agg(F.count("*").alias("n"))
    rank = words.select("w").distinct().join(seen, "w", "left").select("w", F.row_number().over(Window.orderBy(F.coalesce("n", F.lit(0)), "w")).alias("rank"))
    ranked = cut(words.join(rank, "w").withColumn("at", F.row_number().over(Window.partitionBy("template").orderBy("rank")) - 1))
    order = ranked.select("w", "rank", "width").distinct()
    prefix = ranked.where("at <= size - need").select("rank", "width", "template", "label", "size", "need", F.col("at").alias("t_at"))
    whole = ranked.groupBy("template").agg(F.collect_list("rank").alias("t_ranks"))
    at = F.floor(F.col("pos") / (F.col("width") / 2))
    blocks = single.join(F.broadcast(order), "w").select("row", "width", F.explode(F.filter(F.array(at, at - 1), lambda b: b >= 0)).alias("block"), "rank")
    blocks = blocks.groupBy("row", "width", "block").agg(F.sort_array(F.collect_set("rank")).alias("ranks"))
    spread = blocks.select("row", "width", "block", "ranks", F.posexplode("ranks").alias("b_at", "rank"))
    long_enough = F.size("ranks") >= F.col("need")
    in_prefix = F.col("b_at") <= F.size("ranks") - F.col("need")
    can_reach = F.least("t_at", "b_at") + 1 + F.least(F.col("size") - F.col("t_at") - 1, F.size("ranks") - F.col("b_at") - 1) >= F.col("need")
    candidates = spread.join(F.broadcast(prefix), ["rank", "width"]).where(long_enough & in_prefix & can_reach).select("row", "block", "ranks", "template", "label", "size", "need").distinct()
    shared = F.size(F.array_intersect("ranks", "t_ranks"))
    return candidates.join(F.broadcast(whole), "template").where(shared >= F.col("need")).select("row", "label", (shared / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of ``docs``.

    ``score`` is the largest containment of a template in a block, 1 where a phrase stands, else 0.
    A null text is empty: no words, no labels, score 0. The tables that are broadcast have a row
    for each word of a template; none of them grows with the corpus. Empty table: no rows.
    """
    phrase_words = {w for p, _ in PHRASES for w in p.split()}
    template_vocabulary = {w for text, _ in templates for w in template_words(text)}
    telling = sorted({w for text, _ in templates for w in telling_words(text, threshold)} | {max(p.split(), key=len) for p, _ in PHRASES})
    found = cut(found_words(docs, sorted(template_vocabulary | phrase_words), telling))
    best = similar_blocks(found, list(templates), threshold).groupBy("row").agg(F.collect_set("label").alias("_own"), F.max("containment").alias("_score"))
    places = [phrase_places(F.col("hits"), p) for p, _ in PHRASES]
    based = found.select("row", "doc_id", "n_words", *[p.alias(f"_p{k}") for k, p in enumerate(places)])
    every = F.concat(*[F.col(f"_p{k}") for k in range(len(PHRASES))])
    base = F.filter(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    out = based.join(best, "row", "left").withColumn("_base", F.array_sort(F.array_distinct(base)))
    labels = F.array_sort(F.array_union("_base", F.coalesce("_own", F.array().cast("array<string>"))))
    score = F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce("_score", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the license notices of every document."""
    return scan(table(spark, sf_dir, "documents"))


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in SQL: each block against each template."""

    def places(phrase: str) -> str:
        here = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
        return f"list_transform(list_filter(range(1, len(words) + 1), lambda i: {here}), lambda i: i - 1)"

    found = ", ".join(f"{places(p)} AS p{k}" for k, (p, _) in enumerate(PHRASES))
    named = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))
    rows = ", ".join(f"({i}, '{label}', {template_words(text)}, {block_of(text)})" for i, (text, label) in enumerate(templates))
    return f"""
WITH own AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), places AS (
  SELECT doc_id, words, len(words) AS n, {found} FROM own
), based AS (
  SELECT *, list_concat(list_concat(p0, p1), list_concat(p2, p3)) AS every, list_filter([{named}], lambda x: x IS NOT NULL) AS base FROM places
), templates(template, label, need, size) AS (
  VALUES {rows}
), blocks AS (
  SELECT doc_id, size, list_slice(words, b * size // 2 + 1, b * size // 2 + size) AS block
  FROM (SELECT doc_id, size, words, unnest(range(0, greatest(1, (n + size // 2 - 1) // (size // 2)))) AS b FROM places, (SELECT DISTINCT size FROM templates))
), alike AS (
  SELECT doc_id, label, len(list_intersect(block, need)) AS shared, len(need) AS words FROM blocks JOIN templates USING (size) WHERE list_has_any(block, need)
), method AS (
  SELECT doc_id, list(DISTINCT label) AS own, max(shared / words) AS score FROM alike WHERE shared >= ceil({threshold} * words - 1e-9) GROUP BY doc_id
) SELECT b.doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(list_min(every) AS BIGINT) AS first_word, CAST(list_max(every) AS BIGINT) AS last_word,
         array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(m.own, [])))), ',') AS labels,
         CASE WHEN len(every) > 0 THEN 1.0 ELSE CAST(coalesce(m.score, 0) AS DOUBLE) END AS score
FROM based b LEFT JOIN method m ON b.doc_id = m.doc_id
"""
