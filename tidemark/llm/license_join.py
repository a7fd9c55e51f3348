"""License scan: an exact set-similarity join of text blocks with license notices.

Blocks are the lines of a text, sets of words. A block matches a template when it holds at least
``least`` of the template's words: overlap >= c = ceil(least * |template|). Tokens are ordered by how
many blocks of the whole corpus hold them, rarest first. Any block with c common tokens holds one of
the template's first |template| - c + 1 tokens, so only those are joined (prefix filter); a block with
fewer than c template words cannot match (length filter); a first common token at places i and j
leaves at most 1 + min(what follows i, what follows j) common tokens (positional filter). What
passes is counted exactly.

Only words of some template matter to an overlap, so each block is cut to those words when it is read;
blocks with fewer of them than the smallest c leave at once. The template table is a parameter, so
what Spark broadcasts in the join is bounded by it and does not grow with the data.

Defined cases: a null text is empty; a document without words has no label, null positions and the
score 0; labels are distinct and sorted; rows are told apart by id and text, so repeated rows and
repeated or null ids give a row each; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .registry import query
from .support import row_key, stage, table, text_of

# fixed values of the contract: phrases and their labels
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs of separators within a line that are not one blank already.
UNEVEN_GAPS = r"[\x00-\x09\x0B-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F][\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*| [\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"

#: Notices by label. A parameter of ``license_scan``.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]
#: Share of a template's words that a block must hold.
LEAST = 0.8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """Lower case. Beyond A-Z it maps letters outside ASCII to such letters; the Kelvin sign, which would become a k, is set aside."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u2126")))


def template_words(templates) -> list[tuple[str, list[str]]]:
    import re

    table = str.maketrans(UPPER, LOWER)
    return [(label, sorted({w for w in re.split(SEPARATORS, text.translate(table)) if w})) for label, text in templates]


def matches(blocks: DataFrame, templates, least: float = LEAST) -> DataFrame:
    """Rows (key, line, label, template, share) of all blocks that meet the threshold.

    ``blocks`` has key, line and the distinct template words ``held`` of a block.
    """
    spark = blocks.sparkSession
    sets = template_words(templates)
    frequent = blocks.select(F.explode("held").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["token"]: r["n"] for r in frequent.collect()}  # at most one row per template word
    vocabulary = sorted({w for _, ws in sets for w in ws}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(vocabulary)}
    rows, prefixes = [], []
    for number, (label, ws) in enumerate(sets):
        need = math.ceil(least * len(ws) - 1e-9)
        ordered = sorted(rank[w] for w in ws)
        rows.append((number, label, ordered, need))
        prefixes += [(token, number, i) for i, token in enumerate(ordered[: len(ordered) - need + 1])]
    known = spark.createDataFrame(rows, "template int, label string, tokens array<int>, need int")
    prefix = spark.createDataFrame(prefixes, "token int, template int, i int").join(known, "template")
    ranks = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, rank[w])])
    ordered = blocks.select("key", "line", F.sort_array(F.transform("held", lambda w: ranks[w])).alias("held"))
    first = ordered.filter(F.arrays_overlap("held", F.lit(sorted({p[0] for p in prefixes}))))
    probes = first.select("key", "line", "held", F.posexplode("held").alias("j", "token"))
    fits = (F.size("held") >= F.col("need")) & (
        1 + F.least(F.size("tokens") - F.col("i") - 1, F.size("held") - F.col("j") - 1) >= F.col("need")
    )
    # several prefix tokens of one template can be common: the first one stands for the pair
    once = F.col("token") == F.array_min(F.array_intersect("held", "tokens"))
    hits = probes.join(prefix, "token").filter(fits & once)
    common = F.size(F.array_intersect("held", "tokens"))
    return hits.filter(common >= F.col("need")).select("key", "line", "label", "template", (common / F.size("tokens")).alias("share"))


def one_of(words: list[str]) -> str:
    """A pattern of the given words, parted by their first letters. Words hold no character that means something in a pattern."""
    by_start: dict[str, list[str]] = {}
    for w in words:
        by_start.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in sorted(by_start.items()))


def read(docs: DataFrame, templates, phrases, least: float = LEAST) -> DataFrame:
    """One row per document: counts, base matches, and its blocks cut to template words."""
    sets = template_words(templates)
    vocabulary = sorted({w for _, ws in sets for w in ws})
    smallest = min(math.ceil(least * len(ws) - 1e-9) for _, ws in sets)
    # words parted by one blank, lines by line breaks; then all on one line, a blank before and after each word
    spaced = F.concat(F.lit("\n"), F.regexp_replace(lowered(text_of()), UNEVEN_GAPS, " "), F.lit("\n"))
    flat = F.regexp_replace("spaced", r" *\n[ \n]*", " ")
    n_words = F.length("flat") - F.length(F.replace(F.col("flat"), F.lit(" "))) - 1
    # template words and line breaks alone; one pass of a pattern costs far less than a test of each word in an array
    seen = F.regexp_extract_all("spaced", F.lit(rf"\n|(?<=[ \n])(?:{one_of(vocabulary)})(?=[ \n])"), F.lit(0))
    shortest = 2 * smallest - 1  # characters of so many words

    def places(phrase: str, name: str) -> list[Column]:
        """How often a phrase stands there and the words in front of its first and last place; a line break marks each."""
        blanks = lambda part: F.length(part) - F.length(F.replace(part, F.lit(" ")))
        marked = F.col(f"m{name}")
        there = F.length(marked) > F.length("flat")
        return [
            (F.length(marked) - F.length("flat")).alias(f"c{name}"),
            F.when(there, blanks(F.substring_index(marked, "\n", 1)) - 1).alias(f"f{name}"),
            F.when(there, blanks(F.col("flat")) - 1 - blanks(F.substring_index(marked, "\n", -1))).alias(f"l{name}"),
        ]

    marks = [
        F.when(F.contains("flat", F.lit(f" {p} ")), F.regexp_replace("flat", f"(?<= )(?={p} )", "\n")).otherwise(F.col("flat")).alias(f"m{i}")
        for i, (p, _) in enumerate(phrases)
    ]
    # the text begins with a line break that is not its own
    lines = F.transform(F.split(F.array_join(seen, " "), "\n"), lambda line, i: F.struct((i - 1).alias("line"), F.trim(line).alias("words")))
    blocks = F.transform(
        F.filter(lines, lambda b: F.length(b["words"]) >= shortest),
        lambda b: F.struct(b["line"].alias("line"), F.array_distinct(F.split(b["words"], " ")).alias("held")),
    )
    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), spaced.alias("spaced"))
    rows = rows.select("doc_id", "key", flat.alias("flat"), blocks.alias("blocks")).select("*", *marks)
    return rows.select(
        "doc_id", "key", n_words.cast("long").alias("n_words"), *[c for i, (p, _) in enumerate(phrases) for c in places(p, str(i))],
        F.filter("blocks", lambda b: F.size(b["held"]) >= smallest).alias("blocks"),
    )


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, least: float = LEAST) -> DataFrame:
    seen = stage(read(docs, templates, phrases, least), "license-blocks")
    # the same row may be there twice; its blocks count and match once
    blocks = seen.filter(F.size("blocks") > 0).dropDuplicates(["key"]).select("key", F.explode("blocks").alias("b")).select("key", "b.line", "b.held")
    found = matches(blocks, templates, least).groupBy("key").agg(
        F.collect_set("label").alias("added"), F.max("share").alias("score"), F.countDistinct("line").alias("n_blocks")
    )
    each = range(len(phrases))
    n_base = sum((F.col(f"c{i}") for i in each), F.lit(0))
    base = F.array_compact(F.array(*[F.when(F.col(f"c{i}") > 0, label) for i, (_, label) in enumerate(phrases)]))
    joined = F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce("added", F.array().cast("array<string>"))))), ",")
    outer = lambda pick, columns: pick(*columns, F.lit(None).cast("int"), F.lit(None).cast("int")).cast("long")
    return seen.join(found, "key", "left").select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"), outer(F.least, [F.col(f"f{i}") for i in each]).alias("first_word"),
        outer(F.greatest, [F.col(f"l{i}") for i in each]).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        joined.alias("labels"), F.when(n_base > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
    )


def _sql() -> str:
    sets = ", ".join(f"({i}, '{label}', [{', '.join(repr(w) for w in ws)}])" for i, (label, ws) in enumerate(template_words(TEMPLATES)))
    rx = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    up = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    places = ", ".join(
        f"list_filter(range(0, greatest(len(w) - {p.count(' ')}, 0)), lambda i: array_to_string(w[i + 1 : i + {p.count(' ') + 1}], ' ') = '{p}') AS p{k}"
        for k, (p, _) in enumerate(PHRASES)
    )
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))
    return f"""
WITH t(template, label, ws) AS (VALUES {sets}),
d AS (SELECT doc_id, {up} AS low, regexp_extract_all({up}, '{rx}') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {places} FROM d),
b AS (SELECT doc_id, unnest(range(0, len(string_split(low, chr(10))))) AS line, list_distinct(regexp_extract_all(unnest(string_split(low, chr(10))), '{rx}')) AS held FROM d),
m AS (SELECT doc_id, line, label, len(list_intersect(held, ws)) AS n, len(ws) AS size FROM b, t WHERE len(list_intersect(held, ws)) >= ceil({LEAST} * len(ws) - 1e-9)),
f AS (SELECT doc_id, list(DISTINCT label) AS added, max(n::DOUBLE / size) AS score, count(DISTINCT line) AS n_blocks FROM m GROUP BY doc_id),
j AS (SELECT doc_id, n_words, flatten([{', '.join(f'p{k}' for k in range(len(PHRASES)))}]) AS every,
    list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM p)
SELECT doc_id, n_words::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(added, [])))), ','), '') AS labels,
    CASE WHEN len(every) > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score, coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM j LEFT JOIN f USING (doc_id)"""


@query("op7_license_join", _sql())
def op7_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
