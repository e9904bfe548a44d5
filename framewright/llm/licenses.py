"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

A template is a short license notice.  A block is a run of as many words as half as
many again as the template has, wherever it starts in the text and across line
breaks, so a notice that is wrapped or has some words put in is found.  A block meets
a template if it holds at least `threshold` of the template's distinct words.
The join follows the prefix-filter method: the words of the templates are ordered
by their count over all documents, rarest first; blocks and templates are sorted
arrays of those ranks.  A block that qualifies shares a rank of the template's
prefix (rarest words first), is long enough, and leaves room after the first
shared position.  So an index from prefix words to templates is asked at each such
word of a text; the length and position filters (`possible`) throw out what cannot
qualify before a block is formed, and only blocks around the rest are counted.

Everything runs inside rows (no shuffle of texts); the one aggregate is the word
count, a row for each template word.  Templates are a parameter, so every literal
is bounded by it.  Null texts count as empty.  Repeated rows, hot sources and
extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (phrase, label) — fixed values.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Share of a template's distinct words, and words of a block for each word of the template.
THRESHOLD, SPAN = 0.8, 1.5
#: (label, notice) — fixed values: short public license notices.
TEMPLATES = (
    ("notice-gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("notice-lgpl", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"),
    ("notice-apache", "Licensed under the Apache License, Version 2.0"),
    ("notice-mit", "This software is released under the MIT License"),
    ("notice-mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("notice-bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("notice-mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("notice-cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("notice-cc-by-short", "This text is available under CC BY 4.0"),
    ("notice-all-rights", "Copyright all rights reserved no part of this publication may be reproduced"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]  # distinct
    need: int  # words that a block must share
    span: int  # words of a block


def lowered(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def templates_of(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    out = []
    for label, text in templates:
        every = re.findall(WORD, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
        words = tuple(dict.fromkeys(every))
        out.append(Template(label, words, max(1, math.ceil(threshold * len(words) - 1e-9)), math.ceil(SPAN * len(every))))
    return out


def global_order(docs: DataFrame, words: list[str]) -> list[str]:
    """The given words by their number of occurrences over all documents, rarest first (ties by word)."""
    found = F.filter(F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), F.lit(0)), lambda w: w.isin(words))
    rows = docs.select(F.explode(found).alias("word")).groupBy("word").count().collect()  # at most a row for each template word
    count = {r["word"]: r["count"] for r in rows}
    return sorted(words, key=lambda w: (count.get(w, 0), w))


def possible(place: Column, n_words: Column, template: Column) -> Column:
    """The length and position filters, before any block is formed: whether a block around the place of a prefix word can hold enough of the template.

    The block of which this word is the rarest shared one has no more words than stand within its reach (length), and shares none of the
    template's words before this one in the global order (position).  A block with a rarer shared word is found at that word."""
    around = F.least(place + template["span"], n_words) - F.greatest(place - template["span"] + 1, F.lit(0))
    return F.least(around, F.size(template["words"]) - template["rank"]) >= template["need"]


def containments(words: Column, templates: list[Template], order: list[str]) -> Column:
    """Structs (label, share) of every template that some block of the words (lower-cased) meets, with its largest share near each prefix word."""
    rank = {w: i for i, w in enumerate(order)}
    index: dict[str, list[Column]] = {}
    for t in templates:
        ranked = sorted(t.words, key=rank.__getitem__)
        for i, w in enumerate(ranked[: len(ranked) - t.need + 1]):
            fields = {"label": F.lit(t.label), "need": F.lit(t.need), "span": F.lit(t.span), "rank": F.lit(i), "words": F.array(*map(F.lit, ranked))}
            index.setdefault(w, []).append(F.struct(*[c.alias(k) for k, c in fields.items()]))
    by_word = F.create_map(*[x for w, own in sorted(index.items()) for x in (F.lit(w), F.array(*own))])
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(sorted(index)), i)), lambda i: i.isNotNull())
    asked = F.flatten(F.transform(places, lambda p: F.transform(F.element_at(by_word, F.get(words, p)), lambda t: F.struct(p.alias("place"), t.alias("t")))))

    def near(x: Column) -> Column:
        """The template's ranks (from 1; 0 for other words) of the words that share a block with the prefix word."""
        first = F.greatest(x["place"] - x["t"]["span"] + 1, F.lit(0))
        around = F.slice(words, first + 1, x["place"] + x["t"]["span"] - first)
        return F.struct(F.transform(around, lambda w: F.array_position(x["t"]["words"], w).cast("int")).alias("ranks"), (x["place"] - first).alias("at"), x["t"].alias("t"))

    def best(x: Column) -> Column:
        """The largest number of template words in a block that holds the prefix word (blocks may begin with a template word)."""
        need, span = x["t"]["need"], x["t"]["span"]

        def held(start: Column) -> Column:
            block = F.array_distinct(F.filter(F.slice(x["ranks"], start + 1, span), lambda r: r > 0))
            size = F.size(block)
            return F.when(size >= need, size)

        starts = F.filter(F.sequence(F.lit(0), x["at"]), lambda s: F.get(x["ranks"], s) > 0)
        return F.array_max(F.transform(starts, held))

    hopeful = lambda x: F.size(F.array_distinct(F.filter(x["ranks"], lambda r: r > 0))) >= x["t"]["need"]
    asked = F.filter(asked, lambda x: possible(x["place"], F.size(words), x["t"]))
    found = F.transform(F.filter(F.transform(asked, near), hopeful), lambda x: F.struct(x["t"]["label"].alias("label"), (best(x) / F.size(x["t"]["words"])).alias("share")))
    return F.filter(found, lambda m: m["share"].isNotNull())


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document.

    score: 1 if a phrase occurs, else the largest share of a template that a block holds (0 if none meets the threshold)."""
    own = templates_of(templates, threshold)
    order = global_order(docs, sorted({w for t in own for w in t.words}))
    pairs = [(p.split(), label) for p, label in phrases]
    heads = sorted({p[0] for p, _ in pairs})
    words = F.col("__words")
    rows = docs.select("doc_id", lowered(F.col("text")).alias("__text"))
    rows = rows.withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
    starts = F.filter(F.transform(words, lambda w, i: F.when(w.isin(heads), i)), lambda i: i.isNotNull())
    label = lambda i: F.coalesce(*[F.when(F.slice(words, i + 1, len(p)) == F.array(*map(F.lit, p)), F.lit(name)) for p, name in pairs])
    hits = F.filter(F.transform(starts, lambda i: F.struct(i.alias("at"), label(i).alias("label"))), lambda h: h["label"].isNotNull())
    rows = rows.withColumn("__hits", hits).withColumn("__met", containments(words, own, order))
    places, base = F.transform("__hits", lambda h: h["at"]), F.transform("__hits", lambda h: h["label"])
    every = F.concat(base, F.transform("__met", lambda m: m["label"]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        "doc_id", F.size("__words").cast("long").alias("n_words"), F.size("__hits").cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(every).alias("labels"),
        F.when(F.size("__hits") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("__met", lambda m: m["share"])), F.lit(0.0))).alias("score"),
    )


def sql() -> str:
    """The same result in SQL: phrases by position, and every block that begins with a template's word against that template."""
    q = lambda s: "'" + s + "'"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda x: f"translate(coalesce({x}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    cases = " ".join(f"WHEN list_slice(words, i, i + {len(p.split()) - 1}) = [{', '.join(map(q, p.split()))}] THEN {q(label)}" for p, label in PHRASES)
    heads = ", ".join(q(p.split()[0]) for p, _ in PHRASES)
    templates = ", ".join(f"({q(t.label)}, [{', '.join(map(q, t.words))}], {t.need}, {t.span})" for t in templates_of())
    vocabulary = ", ".join(map(q, sorted({w for t in templates_of() for w in t.words})))
    return f"""
WITH d AS (SELECT doc_id, {low('text')} AS t, regexp_extract_all({low('text')}, '{word}') AS words FROM documents),
h AS (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, i, CASE {cases} END AS label
      FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d) WHERE words[i] IN ({heads})) WHERE label IS NOT NULL),
p AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id),
tpl(label, tokens, need, span) AS (VALUES {templates}),
b AS (SELECT doc_id, i, list_slice(words, i, i + {max(t.span for t in templates_of()) - 1}) AS block
      FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d) WHERE words[i] IN ({vocabulary})),
c AS (SELECT doc_id, label, max(n / len(tokens)) AS share
      FROM (SELECT doc_id, label, tokens, need, len(list_intersect(list_slice(block, 1, span), tokens)) AS n FROM b, tpl WHERE list_contains(tokens, block[1])) WHERE n >= need GROUP BY doc_id, label),
m AS (SELECT doc_id, max(share) AS share FROM c GROUP BY doc_id),
e AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM h UNION SELECT doc_id, label FROM c) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN e USING (doc_id)"""
