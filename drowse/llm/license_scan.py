"""Licence scan by a positional index of rare licence words, in DataFrame functions only.

Every template is a sequence of licence words, some of them mandatory (its key phrase). A template's weight is the sum of its
words' inverse document frequencies over the whole corpus. A place matches if the words found at their relative positions
carry at least THRESHOLD of the weight and all mandatory words stand there.

Of each template only the highest-IDF words are indexed, as postings of template and position: so many that a match, which misses less
than the rest of the weight, must hold two of them (one, where a single word outweighs that), so nothing is lost. Of a file only
words of the index are looked up. Each hit gives the start that its posting implies; the starts are sorted, so that postings which meet at
one relative position lie side by side, and only starts with as many hits as the template needs are verified, words and key phrase.

Nulls and empty texts have no words: counts 0, labels '', score 0, places null. A very long text is one row, worked in linear passes over its
words but for the sort of its hits. Labels and places are sets, so ties leave nothing open. Repeated rows give repeated rows. Other
columns of the input are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrase -> label
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Fixed values: (label, notice, key phrase that must be there)
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-2", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", "lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "affero general public license version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "names of its contributors"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "distributed under the license is distributed on an as is basis"),
    ("bsd-2-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "in no event will the authors be held liable"),
    ("bsl-1", "boost software license version 1 0", "boost software license"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2"),
]


def templates() -> list[dict]:
    """Base phrases first: all their words are mandatory."""
    out = [{"label": v, "words": k.split(), "must": [True] * len(k.split()), "base": True} for k, v in BASE.items()]
    for label, notice, phrase in NOTICES:
        words, key = notice.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        out.append({"label": label, "words": words, "must": [at <= i < at + len(key) for i in range(len(words))], "base": False})
    return out


def words_of(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS, -1), "")


def word_weights(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """IDF of each template word over all documents, in thousandths, at least 1. The result has one row per template word."""
    vocabulary = sorted({w for t in templates() for w in t["words"]})
    found = F.array_distinct(F.filter(words_of(text), lambda w: w.isin(vocabulary)))
    rows = docs.select(F.explode(F.array_append(found, F.lit(""))).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in rows}
    n = df.get("", 0)
    return {w: 1 + math.floor(1000 * math.log((n + 1) / (df.get(w, 0) + 1))) for w in vocabulary}


def rare_positions(words: list[str], weights: dict[str, int], share: float) -> tuple[list[int], int]:
    """Positions of the highest-IDF words, and how many of them every match holds. A match misses (1 - share) of the weight at most, so of the
    chosen words it holds what they weigh beyond that: two of them as soon as that is more than the heaviest, or else one."""
    order = sorted(range(len(words)), key=lambda i: (-weights[words[i]], words[i], i))
    own = [weights[words[i]] for i in order]
    missed = (1 - share) * sum(own) + 1e-6
    for need, least in ((2, own[0]), (1, 0)):
        for n in range(need, len(order) + 1):
            if sum(own[:n]) - missed > least:
                return sorted(order[:n]), need
    return sorted(order), 1


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label, start word, share)."""
    weights, known = word_weights(docs, text), templates()
    postings: dict[str, list[tuple[int, int]]] = {}
    needs = []
    for t, x in enumerate(known):
        places, need = rare_positions(x["words"], weights, 1.0 if x["base"] else THRESHOLD)
        needs.append(need)
        for q in places:
            postings.setdefault(x["words"][q], []).append((t, q))
    rare = sorted(postings)

    def literal_words(x: dict) -> Column:
        part = [F.struct(F.lit(w).alias("w"), F.lit(weights[w]).alias("weight"), F.lit(m).alias("must")) for w, m in zip(x["words"], x["must"], strict=True)]
        return F.struct(F.lit(x["label"]).alias("label"), F.lit(x["base"]).alias("base"), F.lit(sum(weights[w] for w in x["words"])).alias("total"), F.array(*part).alias("words"))

    index = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(q).alias("q")) for w in rare for t, q in postings[w]])
    known_col = F.array(*map(literal_words, known))

    def share(found: Column) -> Column:
        """Matched weight of a (template, start) pair, or -1 if a mandatory word is missing."""
        x = F.get(known_col, found["t"])
        there = F.transform(x["words"], lambda p, j: F.struct(F.when(F.get(F.col("_words"), found["start"] + j) == p["w"], p["weight"]).otherwise(0).alias("got"), p["must"].alias("must")))
        return F.aggregate(there, F.lit(0), lambda a, p: F.when((a < 0) | (p["must"] & (p["got"] == 0)), -1).otherwise(a + p["got"]))

    spots = F.transform(F.col("_words"), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    rows = docs.select(*keep, words_of(text).alias("_words")).withColumn("_hits", F.filter(spots, lambda s: s["w"].isin(rare)))
    # a template and a start as one number, so that they sort by template and lie side by side where postings meet
    starts = F.flatten(F.transform(F.col("_hits"), lambda h: F.transform(F.filter(index, lambda p: (p["w"] == h["w"]) & (p["q"] <= h["i"])), lambda p: p["t"] * F.lit(1 << 32) + (h["i"] - p["q"]))))
    rows = rows.withColumn("_starts", F.array_sort(starts))
    need = lambda c: F.get(F.array(*map(F.lit, needs)), F.shiftright(c, 32).cast("int"))
    first = lambda c, i: (i == 0) | (F.get(F.col("_starts"), i - 1) != c)
    enough_hits = lambda c, i: first(c, i) & F.coalesce(F.get(F.col("_starts"), i + need(c) - 1) == c, F.lit(False))
    rows = rows.withColumn("_pairs", F.transform(F.filter("_starts", enough_hits), lambda c: F.struct(F.shiftright(c, 32).cast("int").alias("t"), (c % F.lit(1 << 32)).cast("int").alias("start"))))
    matched = F.transform(F.col("_pairs"), lambda c: F.struct(F.get(known_col, c["t"])["label"].alias("label"), F.get(known_col, c["t"])["base"].alias("base"), c["start"].alias("start"), (share(c) / F.get(known_col, c["t"])["total"]).alias("share")))
    enough = lambda m: (m["share"] >= F.when(m["base"], 1.0).otherwise(THRESHOLD))
    rows = rows.withColumn("matches", F.filter(matched, enough)).withColumn("_base", F.filter("matches", lambda m: m["base"]))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    starts = F.transform(F.col("_base"), lambda m: m["start"].cast("long"))
    return rows.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        join(F.col("_base")).alias("base_labels"),
        join(F.col("matches")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)), 6).alias("score"),
        "matches",
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def _oracle() -> str:
    """Every template word at every place, no index: the plain form of the same definition."""
    rows = ",".join(f"({t},'{x['label']}',{x['base']},{q},'{w}',{m})" for t, x in enumerate(templates()) for q, (w, m) in enumerate(zip(x["words"], x["must"], strict=True)))
    return f"""
WITH tw(t, label, base, q, w, must) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS MATERIALIZED (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
v AS (SELECT w, count(DISTINCT r) AS df FROM p WHERE w IN (SELECT w FROM tw) GROUP BY w),
wt AS (SELECT tw.*, 1 + floor(1000 * ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (coalesce(df, 0) + 1)))::BIGINT AS weight FROM tw LEFT JOIN v USING (w)),
tot AS (SELECT t, any_value(label) AS label, any_value(base) AS base, sum(weight) AS total, count(*) FILTER (must) AS musts FROM wt GROUP BY t),
m AS (SELECT r, t, i - q AS start, sum(weight) AS got, count(*) FILTER (must) AS have FROM p JOIN wt USING (w) GROUP BY ALL),
ok AS (SELECT r, label, base, start, got / total AS share FROM m JOIN tot USING (t) WHERE have = musts AND got / total >= CASE WHEN base THEN 1.0 ELSE {THRESHOLD} END),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM ok GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0)::DOUBLE, 6) AS score FROM d LEFT JOIN g USING (r)"""


ORACLE = _oracle()
