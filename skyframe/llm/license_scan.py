"""License scans by diagonal voting.

All runs of ``K`` words of a text (of two for a template of two words) are joined by their hash to the places where
templates hold the same run, and the words are compared. A match of a document's place with a template's place votes
for their distance, the diagonal. Votes are summed by diagonal; diagonals that are at most ``NEAR`` apart are merged,
so that words put in or left out inside a notice don't break it. A merged span is verified: it must hold
``COVERAGE`` of the template's runs, each at least once and word for word, and not be longer than one and a half times the template.
Base phrases count only where one diagonal has all their runs: there the phrase stands as it is.

Templates are fixed, so the side that is broadcast is bounded whatever the data. What is shuffled is one row per
document and one per matching place, summed before it moves; all windows are bounded by one document's size.

Defined results: a null text is empty; an empty or blank one has no words, no labels and score 0; repeated rows and rows
that share an id, or have none, give one row each; very long texts are scanned whole (places are 32-bit); labels are
distinct, in ascending order, '' if none; ``score`` is the largest share of a template's runs found in one merged
span; an empty table gives no rows; other columns of the input pass through ``scan`` unless it replaces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, documents

K = 3
NEAR = 8
COVERAGE = 0.7
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and the labels that they give.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short statements and the opening of well-known notices (64 words at most), with their labels.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _split(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Words of each text as ``w``, with the same words from the second and from the third on."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    rows = df.select(*keep, F.filter(F.split(low, GAP), lambda x: x != "").alias("__w1"))
    return rows.select(*keep, "__w1", F.slice("__w1", 2, F.size("__w1") + 1).alias("__w2"), F.slice("__w1", 3, F.size("__w1") + 1).alias("__w3"))


def rolled(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep, n_words, at, k, w1, w2, w3, h): every place of every text, once with two words and once with three.

    Runs that would reach past the end have nulls and no hash; a text without words has one row without a place.
    """
    rows = _split(df, text, keep).select(*keep, F.size("__w1").cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip("__w1", "__w2", "__w3")).alias("at", "__z"))
    rows = rows.select(*keep, "n_words", "at", F.col("__z.__w1").alias("w1"), F.col("__z.__w2").alias("w2"), F.col("__z.__w3").alias("w3"))
    two = F.struct(F.lit(2).alias("k"), F.lit(None).cast("string").alias("w3"), F.when(F.col("w2").isNotNull(), F.xxhash64("w1", "w2")).alias("h"))
    three = F.struct(F.lit(3).alias("k"), F.col("w3"), F.when(F.col("w3").isNotNull(), F.xxhash64("w1", "w2", "w3")).alias("h"))
    return rows.select(*keep, "n_words", "at", "w1", "w2", F.inline(F.array(two, three)))


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, base, runs, t_words, t_at, t_k, t1, t2, t3, t_h): every place of every template; fixed in size."""
    listed = [(label, text, True) for text, label in PHRASES.items()] + [(label, text, False) for label, text in NOTICES]
    values = ", ".join(f"({n}, '{label}', '{text}', {str(base).lower()})" for n, (label, text, base) in enumerate(listed))
    rows = rolled(spark.sql(f"SELECT * FROM VALUES {values} AS t(template, label, text, base)"), "text", ["template", "label", "base"])
    rows = rows.filter("h IS NOT NULL").filter(F.col("k") == F.least(F.lit(K), F.col("n_words")))
    names = [F.col(c).alias(f"t{c[1]}") for c in ("w1", "w2", "w3")]
    return rows.select("template", "label", "base", (F.col("n_words") - F.col("k") + 1).alias("runs"), F.col("n_words").alias("t_words"), F.col("at").alias("t_at"), F.col("k").alias("t_k"), *names, F.col("h").alias("t_h"))


def spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(keep, __row, n_words, template, label, base, start, first, last, coverage, verified): merged spans, one for each
    voted diagonal, and one row without a template for each document. ``__row`` tells input rows apart."""
    keep = docs.columns if keep is None else keep
    own = [*keep, "__row"]
    rows = rolled(docs.withColumn("__row", F.monotonically_increasing_id()), text, own)
    # a document's first place stays in any case, so that each document has a row
    head = (F.col("k") == 3) & F.coalesce(F.col("at") == 0, F.lit(True))
    same = F.expr("h = t_h AND k = t_k AND w1 = t1 AND w2 = t2 AND w3 <=> t3")
    hits = rows.filter(head | F.col("h").isNotNull()).join(F.broadcast(templates(docs.sparkSession)), same, "left").filter(head | F.col("template").isNotNull())
    hits = hits.select(*own, "n_words", "template", "label", "base", "runs", "t_words", "t_at", "at", "k", (F.col("at") - F.col("t_at")).alias("start"))
    by = [*own, "n_words", "template", "label", "base", "runs", "t_words", "start"]
    votes = hits.groupBy(*by).agg(F.bit_or(F.expr("shiftleft(1L, t_at)")).alias("mask"), F.min("at").alias("lo"), F.max(F.col("at") + F.col("k")).alias("hi"))
    near = Window.partitionBy("__row", "template").orderBy("start").rangeBetween(-NEAR, NEAR)
    merged = votes.withColumns({"__all": F.bit_or("mask").over(near), "__lo": F.min("lo").over(near), "__hi": F.max("hi").over(near)})
    one = F.bit_count("mask") == F.col("runs")
    share = F.bit_count("__all") / F.col("runs")
    found = (share >= COVERAGE) & (2 * (F.col("__hi") - F.col("__lo")) <= 3 * F.col("t_words"))
    return merged.select(
        *own, "n_words", "template", "label", "base", "start", F.when(F.col("base"), F.col("lo")).otherwise(F.col("__lo")).alias("first"),
        (F.when(F.col("base"), F.col("hi")).otherwise(F.col("__hi")) - 1).alias("last"),
        F.when(F.col("base"), F.bit_count("mask") / F.col("runs")).otherwise(share).alias("coverage"), F.when(F.col("base"), one).otherwise(found).alias("verified"),
    )


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``FIELDS`` to each document; columns of these names are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in FIELDS]
    rows = spans(docs.select(*keep, *({text} - {*keep})), text, keep)
    place = F.when(F.col("base") & F.col("verified"), F.col("start"))
    listed = lambda when: F.array_join(F.sort_array(F.collect_set(F.when(when, F.col("label")))), ",")
    first = [F.first(c).alias(c) for c in keep]
    out = rows.groupBy("__row").agg(
        *first, F.first("n_words").alias("n_words"), F.count(place).alias("n_base"), F.min(place).cast("long").alias("first_word"), F.max(place).cast("long").alias("last_word"),
        listed(F.col("base") & F.col("verified")).alias("base_labels"), listed(F.col("verified")).alias("labels"), F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
    )
    return out.drop("__row")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])


_VALUES = ", ".join(f"('{x}', '{t}', {b})" for x, t, b in [(x, t, "true") for t, x in PHRASES.items()] + [(x, t, "false") for x, t in NOTICES])
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT *, string_split(text, ' ') AS w FROM (VALUES {_VALUES}) AS t(label, text, base)),
tg AS (SELECT label, text, base, w, least({K}, len(w)) AS k, unnest(range(0, len(w) - least({K}, len(w)) + 1)) AS ta FROM t),
tk AS (SELECT label, text, base, k, ta, len(w) - k + 1 AS runs, len(w) AS tw, array_to_string(w[ta + 1 : ta + k], ' ') AS g FROM tg),
dg AS (SELECT r, w, unnest(range(0, len(w))) AS pos FROM d),
dk AS (SELECT r, pos, k, array_to_string(w[pos + 1 : pos + k], ' ') AS g FROM dg, (SELECT unnest([2, 3]) AS k) WHERE pos + k <= len(w)),
v AS (SELECT r, label, text, base, runs, tw, pos - ta AS start, bit_or(1::BIGINT << ta) AS mask, min(pos) AS lo, max(pos + dk.k) AS hi FROM dk JOIN tk ON dk.g = tk.g AND dk.k = tk.k GROUP BY ALL),
m AS (SELECT *, bit_or(mask) OVER n AS am, min(lo) OVER n AS alo, max(hi) OVER n AS ahi FROM v WINDOW n AS (PARTITION BY r, text ORDER BY start RANGE BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING)),
s AS (SELECT r, label, base, start, CASE WHEN base THEN bit_count(mask) / runs ELSE bit_count(am) / runs END AS coverage,
             CASE WHEN base THEN bit_count(mask) = runs ELSE bit_count(am) / runs >= {COVERAGE} AND 2 * (ahi - alo) <= 3 * tw END AS verified FROM m),
a AS (SELECT r, count(*) FILTER (base AND verified) AS n_base, min(start) FILTER (base AND verified) AS first_word, max(start) FILTER (base AND verified) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND verified) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS labels, max(coverage) AS score FROM s GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)
"""
QUERIES = {"op12_license_scan": op12_license_scan}
ORACLE = {"op12_license_scan": OP12_SQL}
