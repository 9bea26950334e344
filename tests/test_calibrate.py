"""Rules on sums of a day."""

from itertools import accumulate, permutations

from pyspark.sql import functions as F

from drowse.operators import calibrate


def test_daily_rule_does_not_follow_the_order_of_rows(spark):
    """Days of exactly 3.0 in hundredths are not above 3, whichever rows are added first."""
    days = [d for v in ((47, 93, 95, 65), (99, 79, 36, 86), (48, 36, 21, 77, 85, 33)) for d in permutations(v)]
    assert any([*accumulate(x / 100 for x in d)][-1] > 3 for d in days)
    rows = [(i, x / 100) for i, d in enumerate(days) for x in d]
    df = spark.createDataFrame(rows, "day int, p double").coalesce(1)
    got = df.select("p", calibrate.daily_rule("p", "day").alias("x")).collect()
    assert len(got) == len(rows) and all(r["x"] == 0.8 * r["p"] for r in got)


def test_daily_rule_on_values_beyond_decimals(spark):
    rows = [(1, 3.01), (1, None), (2, float("inf")), (2, 0.5), (3, 1e20), (3, -1e20), (4, None)]
    df = spark.createDataFrame(rows, "day int, p double")
    got = {(r["day"], r["p"]): r["x"] for r in df.select("day", "p", calibrate.daily_rule("p", "day").alias("x")).collect()}
    assert got[1, 3.01] == 3.01 and got[1, None] is None and got[2, 0.5] == 0.5 and got[3, 1e20] == 0.8e20 and got[4, None] is None
