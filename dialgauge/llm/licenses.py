"""License scans: exact set-similarity join of text blocks with license templates. SQL functions only.

Blocks are runs of words, whatever lines they stand on: twice as long as the longest template, one beginning every
template length, so each notice lies whole in some block however it is wrapped. A block meets a template when it holds
at least ``CONTAINED`` of the template's distinct words. All template words are put in one order, those rarest in blocks
with template words first. A block that meets a template must hold one of the first
|T| - need + 1 of its words (prefix filter), have ``need`` words at all (length filter), and from the shared word's place
on still be able to reach ``need`` (positional filter). What is left is counted exactly, so the join misses nothing.

Defined cases: a null or empty text has no words, places or labels; repeated rows get the same result; an empty table
gives no rows; a word that stands twice in a block or template counts once; columns other than id and text are not
looked at.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words, written

# Words, and the phrases that are looked for as they stand.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}
CONTAINED = 0.8
# Public license notices; the labels are the method's own.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "gpl-notice": "This work is licensed under the GNU General Public License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit-notice": "Released under the MIT License",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License",
}


def template_words(text: str) -> list[str]:
    """Distinct words of a template, lowered."""
    return sorted(set(re.findall(r"[0-9a-z]+|[^\x00-\x7F]+", text.lower())))


def need(size: int, contained: float = CONTAINED) -> int:
    return max(1, math.ceil(contained * size - 1e-9))


def block_rows(docs: DataFrame, sets: dict[str, list[str]], width: int, contained: float, text: str, id_col: str) -> DataFrame:
    """(id, words, size): a row per block that holds enough template words to meet any template: those words, and the
    number of all its distinct words.

    Blocks of 2 * ``width`` words begin every ``width`` words. A text is cut only if its words as a whole meet a template.
    """
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for ws in sets.values() for w in ws})])
    whole = F.array(*[F.struct(F.array(*map(F.lit, ws)).alias("ws"), F.lit(need(len(ws), contained)).alias("n")) for ws in sets.values()])
    fewest = min(need(len(ws), contained) for ws in sets.values())

    def reaches(known: Column) -> Column:
        return (F.size(known) >= fewest) & F.exists(whole, lambda t: F.size(F.array_intersect(known, t["ws"])) >= t["n"])

    rows = docs.select(F.col(id_col).alias("id"), words(F.lower(F.col(text)), GAP).alias("all"))
    rows = rows.where(let(F.array_intersect("all", vocabulary), reaches))
    starts = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / width).cast("int"))
    blocks = F.transform(starts, lambda k: F.array_distinct(F.slice("all", k * width + 1, 2 * width)))
    blocks = rows.select("id", F.explode(blocks).alias("all"))
    known = blocks.select("id", F.array_intersect("all", vocabulary).alias("words"), F.size("all").alias("size"))
    return known.where(F.size("words") >= fewest)


def similar(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    contained: float = CONTAINED,
    text: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """(id, label, shared, size): every block of every row that meets a template, with the words they share."""
    spark = docs.sparkSession
    sets = {label: template_words(body) for label, body in templates.items()}
    vocabulary = sorted({w for ws in sets.values() for w in ws})
    width = max(len(re.findall(WORD, body)) for body in templates.values())
    # Read twice below, and texts without a notice have no block.
    blocks = written(block_rows(docs, sets, width, contained, text, id_col), "blocks")
    # Words of the templates, so many rows: how many blocks of the corpus hold each.
    counts = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    often = {r["word"]: r["n"] for r in counts.collect()}
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    prefixes, wanted = [], []
    for label, ws in sets.items():
        ranked = sorted(ws, key=order.index)
        least = need(len(ws), contained)
        wanted.append((label, ranked, least))
        prefixes += [(w, label, at, len(ws), least) for at, w in enumerate(ranked[: len(ws) - least + 1])]
    # As many rows as the templates have words at most.
    prefix = F.broadcast(spark.createDataFrame(prefixes, "word string, label string, at int, all int, least int"))
    whole = F.broadcast(spark.createDataFrame(wanted, "label string, template array<string>, least_shared int"))
    ranked = F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("words"))
    first = sorted({p[0] for p in prefixes})
    rare = F.arrays_overlap("words", F.array(*[F.lit(w) for w in first]))
    rows = blocks.where(rare).select("id", F.monotonically_increasing_id().alias("block"), ranked.alias("words"), "size")
    met = rows.select("*", F.posexplode("words").alias("place", "word")).join(prefix, "word")
    met = met.where("size >= least")
    reach = 1 + F.least(F.col("at"), F.col("place")) + F.least(F.col("all") - F.col("at") - 1, F.size("words") - F.col("place") - 1)
    met = met.where(reach >= F.col("least"))
    pairs = met.select("id", "block", "label", "words", "size").dropDuplicates(["block", "label"])
    shared = pairs.join(whole, "label").withColumn("shared", F.size(F.array_intersect("words", "template")))
    kept = shared.where("shared >= least_shared")
    return kept.select(F.col("id").alias(id_col), "label", (F.col("shared") / F.size("template")).alias("contained"), "size")


def places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Where the phrase's words stand one after the other."""
    return F.filter(
        F.transform(
            words,
            lambda w, k: F.when(
                (w == phrase[0]) & F.lit(True), F.when(_rest(words, k, phrase), k)
            ),
        ),
        lambda k: k.isNotNull(),
    )


def _rest(words: Column, k: Column, phrase: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for step, word in enumerate(phrase[1:], 1):
        out = out & F.coalesce(F.get(words, k + step) == word, F.lit(False))
    return out


def scanned(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **similarity) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per input row.

    The score is the best containment of a template in one of the row's blocks, 1 where a phrase stands. Rows are told
    apart by number, so repeated ids keep a row each.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), body.alias("body"))
    holds = F.lower("body").contains("license")
    split = F.array_remove(F.split(F.translate("body", upper, lower), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    none = F.array().cast("array<array<int>>")
    found = F.when(holds, let(split, lambda w: F.array(*[places(w, p) for p in PHRASES.values()]))).otherwise(none)
    rows = rows.select(id_col, F.regexp_count("body", F.lit(WORD)).cast("long").alias("n_words"), found.alias("found"))
    names = list(PHRASES)
    base = F.concat(*[F.when(F.size(F.get("found", F.lit(k))) > 0, F.array(F.lit(n))).otherwise(F.array().cast("array<string>")) for k, n in enumerate(names)])
    every = F.flatten("found")
    rows = rows.select(
        id_col,
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        base.alias("base"),
    )
    # One row per id at most, and only ids with a notice.
    notices = similar(docs, text=text, id_col=id_col, **similarity).groupBy(id_col).agg(
        F.collect_set("label").alias("own"), F.max("contained").alias("best")
    )
    notices = written(notices, "notices").withColumnRenamed(id_col, "notice_id")
    joined = rows.join(notices, F.col(id_col).eqNullSafe(F.col("notice_id")), "left")
    own = F.coalesce("own", F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(
        id_col,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        score.alias("score"),
    )
