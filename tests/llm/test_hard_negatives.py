"""Hard negatives against a plain version over all pairs; the query's SQL runs in test_operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from drowse.llm import hard_negatives as h


def plain(rows, anchors, positives=h.POSITIVES, negatives=h.NEGATIVES):
    """rows: id -> (label, integers). Every pair is scored, and all are sorted."""
    out = []
    for a in anchors:
        label, v = rows[a]
        ranked = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, k == label) for i, (k, w) in rows.items() if i != a)
        for s, i, _ in [r for r in ranked if r[2]][:positives]:
            inside = [(t, j) for t, j, same in ranked if not same and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, i, n + 1, j, -s, -t) for n, (t, j) in enumerate(inside[:negatives])]
    return sorted(out)


def vectors(seed, n, dim=6, labels=4, hot=0.0):
    """Small components, so that many scores are equal and some are 0."""
    rng = random.Random(seed)
    return {i: (0 if rng.random() < hot else rng.randrange(labels), [rng.randint(-2, 3) for _ in range(dim)]) for i in rng.sample(range(-50, 5 * n), n)}


def as_table(spark, rows):
    return spark.createDataFrame([(i, [x / h.SCALE for x in v], k) for i, (k, v) in rows.items()], "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize(("n", "hot", "block"), [(300, 0.0, 40), (300, 0.6, 64), (30, 0.0, 4096)])
def test_against_all_pairs(spark, monkeypatch, n, hot, block):
    rows = vectors(n, n, hot=hot)
    monkeypatch.setattr(h, "BLOCK", block)
    monkeypatch.setattr(h, "ANCHORS", 8)
    monkeypatch.setattr(h, "SLICE", 2)
    got = h.mine(as_table(spark, rows), F.col("vec_id") % 5 == 0)
    want = plain(rows, [i for i in rows if i % 5 == 0])
    assert want
    assert sorted(map(tuple, got.collect())) == want


def test_keys_keep_the_order():
    rng, low, high = random.Random(3), -(2**63), 2**63 - 1
    pick = lambda: rng.choice((low, -1, 0, 1, high, rng.randint(low, high)))
    keys = [(pick(), pick(), rng.random() < 0.5, pick()) for _ in range(500)]
    want = sorted(keys, key=lambda k: (k[0], -k[1], not k[2], k[3]))
    packed = sorted(h.pack(*k) for k in keys)
    assert [h.unpack(k) for k in packed] == want


def test_streaming_holds_open_windows_only():
    """A million keys of one anchor pass as an iterator; no more are read than the windows need before the first row leaves."""
    read = 0

    def keys():
        nonlocal read
        yield h.pack(0, 1_000_000, True, 1), 100
        for i in range(1_000_000):
            read += 1
            yield h.pack(0, 1_000_000 - i, False, i), 100

    got = h.windows_of(keys())
    assert next(got) == (100, 1, 1, 100_000, 1_000_000, 900_000)
    assert read < 100_010
    assert [r[2] for r in got] == list(range(2, 11))
    assert read == 1_000_000


def test_zero_and_negative_positives(spark):
    """A positive of score 0 has the rows of score 0 in its window, smaller ids too; one below 0 has none."""
    rows = {100: (1, [1, 0]), 200: (1, [0, 1]), 3: (2, [0, 5]), 5: (2, [0, -7]), 300: (1, [-4, 0]), 6: (2, [-2, 0])}
    got = h.mine(as_table(spark, rows), F.col("vec_id") == 100)
    assert sorted(map(tuple, got.collect())) == [(100, 200, 1, 3, 0, 0), (100, 200, 2, 5, 0, 0)] == plain(rows, [100])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1, "x"), (0, [1.0, 1.0], 1, "x"), (1, [1.0], 1, "x"), (2, [0.5, None], 2, "x"), (3, None, 2, "x"), (4, [nan, 1.0], 2, "x"), (5, [inf, 1.0], 2, "x"), (None, [0.5, 0.0], 2, "x"), (6, [0.5, 0.0], None, "x"), (7, [0.5, 0.0], 2, "x"), (7, [0.5, 0.0], 2, "x"), (8, [0.5], 3, "x"), (8, [0.1], 4, "x"), (9, [], 2, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string")
    got = sorted(map(tuple, h.mine(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == [(0, 1, 1, 7, 65536, 32768), (0, 1, 2, 8, 65536, 32768)]
    assert h.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert h.mine(df.where("vec_id = 1"), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_beyond_doubles(spark):
    big = 2**31
    rows = {0: (1, [big, 3]), 1: (1, [big, 1]), 2: (2, [big // 2, 1]), 4: (2, [big // 2, 2])}
    assert sorted(map(tuple, h.mine(as_table(spark, rows), F.col("vec_id") == 0).collect())) == plain(rows, [0])
    assert np.iinfo(np.int64).max > big * big
