"""Which lines of a key travel on: those that may be alike to another."""

import random

import numpy as np
from pyspark.sql import functions as F

from drowse.llm import line_dedup


def made(rng, n):
    return "".join(rng.choice("abcdefghijklmnop    ") for _ in range(n))


def edited(rng, line, edits):
    s = list(line)
    for _ in range(edits):
        at = rng.randrange(len(s))
        s[at : at + 1] = rng.choice(["", "x", s[at] + "y"])
    return "".join(s)


def test_lines_that_may_be_alike_are_linked():
    """Whatever edits their budget allows, in groups with other lines, counts beyond 256 too."""
    rng = random.Random(2)
    for n in (20, 40, 96, 300, 1000, 6000):
        lines = [made(rng, n) for _ in range(5)]
        lines += [edited(rng, x, line_dedup.budget(n - n // 32 - 2)) for x in lines]
        lines = [x for x in lines if len(x) >= line_dedup.LEAST]
        sizes = np.array([len(x) for x in lines])
        first = line_dedup.may_be_alike(np.zeros(len(lines), int), sizes, line_dedup.sketches(lines))
        for i, x in enumerate(lines[5:]):
            k = line_dedup.budget(min(len(x), n))
            for j, y in enumerate(lines):
                if j != i + 5 and abs(len(x) - len(y)) <= k and line_dedup.within([x], [y], np.array([k]))[0]:
                    assert first[i + 5] == first[j]
    assert line_dedup.may_be_alike(np.array([0, 0, 1, 2, 2]), np.full(5, 50), line_dedup.sketches([c * 50 for c in "aabab"])).tolist() == [0, 0, 2, 3, 4]


def test_a_passage_alone_brings_no_lines_together(spark):
    """Lines of one passage and much else do not travel, but for the two that are alike."""
    rng = random.Random(8)
    docs = [(i, "a passage that stands at the beginning of each of these lines, " + made(rng, 400)) for i in range(60)]
    docs.append((60, docs[7][1][:200] + "?" + docs[7][1][201:]))
    own = line_dedup.renamed(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    lines = line_dedup.line_hashes(own).select("h1", "h2", "line")
    rows = line_dedup.groups(line_dedup.shared_keys(line_dedup.line_keys_twice(own)), lines).collect()
    assert {r["line"] for r in rows} == {docs[7][1], docs[60][1]}


def test_a_hot_key_in_many_batches(spark, monkeypatch):
    """Lines of a hot key go on as they come, none lost, whatever the batches."""
    monkeypatch.setattr(line_dedup, "GROUP", 4)
    rng = random.Random(4)
    docs = [(i, "the same beginning of a log line " + made(rng, rng.randrange(10, 60))) for i in range(120)]
    docs += [(200 + i, x[:-1] + "!") for i, x in docs[:40]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    own = line_dedup.renamed(df, "doc_id", "text")
    found = line_dedup.materialize(line_dedup.line_keys_twice(own), "found")
    told = lambda: {tuple(r) for r in line_dedup.lines_met(found).select("key", "h1", "n").collect()}
    whole = told()
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        for size in ("7", "100"):
            spark.conf.set(batch, size)
            assert told() == whole
    finally:
        spark.conf.set(batch, before)
    most = max(found.groupBy("key").agg(F.countDistinct("h1").alias("n")).collect(), key=lambda r: r["n"])
    assert most["n"] > 100 and sum(k == most["key"] and n == 0 for k, _, n in whole) == most["n"]


def test_pairs_told_apart_without_a_distance():
    """None that is near enough, whatever its length, and most of those with the same characters in another order."""
    rng = random.Random(5)
    for n in (20, 63, 64, 200, 500, 3000):
        lines = []
        for _ in range(12):
            base = made(rng, n)
            lines += [base, edited(rng, base, rng.randrange(1, 3 + n // 32)), base[n // 2 :] + base[: n // 2]]
        lines = [x for x in lines if len(x) >= line_dedup.LEAST]
        a, b = np.triu_indices(len(lines), 1)
        most = np.array([line_dedup.budget(min(len(lines[i]), len(lines[j]))) for i, j in zip(a, b, strict=True)])
        near = line_dedup.within([lines[i] for i in a], [lines[i] for i in b], most)
        assert not (line_dedup._too_far(a, b, lines, most) & near).any()
    lines = ["abcdefgh" * 20 + "stuvwxyz" * 20, "stuvwxyz" * 20 + "abcdefgh" * 20]
    assert line_dedup._too_far(np.array([0]), np.array([1]), lines, np.array([10])).all()
