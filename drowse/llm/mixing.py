"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells of source, language and topic. Token weights of the cells are scaled to each margin's targets in turn until every
margin is within RESIDUAL of the total, in rounds of SWEEPS sweeps; a round is one plan of window sums over the cells, which are written to
the shared folder between rounds. Margins that contradict each other (a value that only occurs with another one, say) can't all be met:
after ROUNDS rounds the last weights stand, with a warning. A document's factor is its cell's weight over its cell's tokens.

Sampling: a document is expected as often as its factor says, scaled so that RATE of the rows are drawn; it is taken as often as the whole
part, and once more with the rest as its probability, by a hash of its id. No probability is cut at 1, so the sample's expected token
shares are the raked ones.

Targets are shares of the total by value; without any, the tempered shares tokens ** TEMPERATURE. Given targets must name every value that
occurs, else ValueError; those that don't occur are left out and the others scaled to 1. The topic is the one of TOPICS whose words a
text holds most often, the first of equals, else 'general'.

Nulls in a dimension are a value of their own, ''. A null or empty text has no tokens and counts as one. A very long text is one row. A
repeated row is weighted as often as it occurs and sampled alike; a null id is sampled as ''. An empty table gives an empty result. All
columns of the input pass, under any names.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

TEMPERATURE, RATE, SEED = 0.5, 0.8, "mix"
SWEEPS, ROUNDS, RESIDUAL = 4, 8, 1e-6
CELL = ["source", "lang", "topic"]
SPACE = " \t\n\r\f"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that tell a topic; a parameter of `labelled`.
TOPICS = {
    "law": ["license", "licence", "copyright", "permission", "warranty", "liability", "patent", "court", "contract"],
    "computing": ["software", "version", "password", "token", "server", "login", "code", "api", "database"],
    "contact": ["mail", "email", "phone", "telephone", "fax", "address", "contact", "call"],
    "commerce": ["price", "buy", "sale", "order", "offer", "discount", "shop", "delivery"],
}


def tokens_of(text: Column) -> Column:
    """Words between white space, at least 1."""
    return F.greatest(F.lit(1), F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+", -1), ""))).cast("long")


def topic_of(text: Column, topics: dict[str, list[str]]) -> Column:
    words = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[^a-z]+", -1)
    told = F.filter(words, lambda w: w.isin([x for own in topics.values() for x in own]))
    # few words are left; the highest count, the first topic of equals
    count = lambda own: F.size(F.filter(told, lambda w: w.isin(own)))
    counts = [F.struct(count(own).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("topic")) for i, (name, own) in enumerate(topics.items())]
    best = F.greatest(*counts) if len(counts) > 1 else counts[0]
    return F.when(F.size(told) == 0, "general").otherwise(best["topic"])


def labelled(docs: DataFrame, text: str = "text", keep: dict[str, Column] | None = None, topics: dict[str, list[str]] = TOPICS) -> DataFrame:
    """The columns `keep`, and source, lang, topic and tokens of each document."""
    own = [c.alias(n) for n, c in (keep or {}).items()]
    return docs.select(*own, F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic_of(F.col(text), topics).alias("topic"), tokens_of(F.col(text)).alias("tokens"))


def cells_of(own: DataFrame) -> DataFrame:
    return own.groupBy(*CELL).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def _goals(cells: DataFrame, targets: dict[str, DataFrame] | None) -> DataFrame:
    """cells with w and the weight that each margin's value is to have: t_source, t_lang, t_topic."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    out = cells.withColumn("w", F.col("tokens").cast("double"))
    for d in CELL:
        margin = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), TEMPERATURE).alias("s"))
        if targets and d in targets:
            given = targets[d].select(F.col("value").alias(d), F.col("share").cast("double").alias("s"))
            lacking = margin.join(given, d, "left_anti").limit(5).collect()
            if lacking:
                raise ValueError(f"no target for {d} {sorted(r[d] for r in lacking)}")
            margin = given.join(margin.select(d), d, "left_semi")
        shares = margin.agg(F.sum("s")).first()[0] or 1.0
        out = out.join(margin.select(d, (F.col("s") / shares * total).alias(f"t_{d}")), d)
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """source, lang, topic, docs and factor (raked weight over tokens) of each cell."""
    out = materialize(_goals(cells, targets), "raked-cells")
    for _ in range(ROUNDS):
        new = out
        for _ in range(SWEEPS):
            for d in CELL:
                new = new.withColumn("w", F.col("w") * F.col(f"t_{d}") / F.greatest(F.sum("w").over(Window.partitionBy(d)), F.lit(1e-300)))
        new = materialize(new, "raked-cells")
        discard(out)
        out = new
        if residual(out) <= RESIDUAL:
            break
    else:
        warnings.warn(f"margins are off by {residual(out):.2g} of the total", stacklevel=2)
    return out.select(*CELL, "docs", (F.col("w") / F.col("tokens")).alias("factor"))


def residual(weights: DataFrame) -> float:
    """The greatest distance of a margin's weight from its target, as a share of the total."""
    total = weights.agg(F.sum("tokens")).first()[0] or 1
    apart = [weights.groupBy(d).agg(F.abs(F.sum("w") - F.first(f"t_{d}")).alias("apart")).select("apart") for d in CELL]
    return (apart[0].union(apart[1]).union(apart[2]).agg(F.max("apart")).first()[0] or 0.0) / total


def with_copies(own: DataFrame, targets: dict[str, DataFrame] | None, rate: float) -> DataFrame:
    """own (of `labelled`, with `id`) with factor, expected and copies: how often a row is drawn."""
    raked = rake(materialize(cells_of(own), "cells"), targets)
    mean = raked.agg(F.sum(F.col("factor") * F.col("docs")) / F.sum("docs")).first()[0] or 1.0
    own = own.join(raked.drop("docs"), CELL)  # the raked table's size is known: broadcast while small, else adaptive
    own = own.withColumn("expected", F.col("factor") * (rate / mean))
    return own.withColumn("copies", F.floor("expected") + (chance("id") < F.col("expected") - F.floor("expected")).cast("int"))


def chance(key: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 2**32


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, text: str = "text", key: str = "doc_id", rate: float = RATE) -> DataFrame:
    """id, source, lang, topic, tokens, factor, expected and copies of each row."""
    return with_copies(materialize(labelled(docs, text, {"id": F.col(key)}), "labelled"), targets, rate)


def resample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, text: str = "text", key: str = "doc_id", rate: float = RATE) -> DataFrame:
    """docs, each row as often as it is drawn."""
    own = labelled(docs, text, {"row": F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "id": F.col(key)})
    drawn = with_copies(own, targets, rate).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return drawn.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op7_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), *CELL, "tokens", F.round("factor", 6).alias("weight"), F.round("expected", 6).alias("expected"), "copies")


def _oracle() -> str:
    """The same definition, sweep by sweep."""
    share = lambda d: f"(SELECT {d}, pow(sum(tokens)::DOUBLE, {TEMPERATURE}) AS s FROM c GROUP BY {d})"
    margins = ",\n".join(f"m_{d} AS (SELECT {d}, s / (SELECT sum(s) FROM {share(d)}) * (SELECT sum(tokens) FROM c) AS t_{d} FROM {share(d)})" for d in CELL)
    hits = {name: f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(w) for w in own)})))" for name, own in TOPICS.items()}
    most = f"greatest({', '.join(hits.values())})"
    topic = " ".join(f"WHEN {n} = {most} THEN '{name}'" for name, n in hits.items())
    step = f"SELECT * FROM r WHERE i < {SWEEPS * ROUNDS} AND NOT (i > 0 AND i % {SWEEPS} = 0 AND apart <= {RESIDUAL})"
    for d in CELL:
        step = f"SELECT * REPLACE (w * t_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM ({step})"
    return f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z]+') AS ws,
  greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')))::BIGINT AS tokens FROM documents),
d AS MATERIALIZED (SELECT doc_id, source, lang, CASE WHEN {most} = 0 THEN 'general' {topic} END AS topic, tokens FROM t),
c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens, count(*) AS docs FROM d GROUP BY ALL),
{margins},
r(i, source, lang, topic, tokens, docs, w, t_source, t_lang, t_topic, apart) AS (
  SELECT 0, c.source, c.lang, c.topic, tokens, docs, tokens::DOUBLE, t_source, t_lang, t_topic, 1.0::DOUBLE FROM c JOIN m_source USING (source) JOIN m_lang USING (lang) JOIN m_topic USING (topic)
  UNION ALL SELECT i + 1, source, lang, topic, tokens, docs, w, t_source, t_lang, t_topic, max(greatest(p_source, p_lang, p_topic)) OVER () / (SELECT sum(tokens) FROM c)
  FROM (SELECT *, {", ".join(f"abs(sum(w) OVER (PARTITION BY {d}) - t_{d}) AS p_{d}" for d in CELL)} FROM ({step}))),
f AS MATERIALIZED (SELECT source, lang, topic, docs, w / tokens AS factor FROM r WHERE i = (SELECT max(i) FROM r)),
e AS (SELECT source, lang, topic, factor, factor * ({RATE} / (SELECT sum(factor * docs) / sum(docs) FROM f)) AS expected FROM f)
SELECT doc_id, source, lang, topic, tokens, round(factor, 6) AS weight, round(expected, 6) AS expected,
  (floor(expected) + (('0x' || substr(md5('{SEED}' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < expected - floor(expected))::INTEGER)::BIGINT AS copies
FROM d JOIN e USING (source, lang, topic)"""


ORACLE = _oracle()
