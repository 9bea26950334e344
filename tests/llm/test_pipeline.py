"""Each stage of the pipeline against a brute-force version, on the rows that the stage before left."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from drowse.llm import mixing, toxicity

from .test_operators import expected_lines, plain_classes

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    clean = STAGES["toxicity"](spark, docs, sf).cache()
    model = toxicity.train(docs, labels)
    want = {k for k, t in rows_of(docs) if toxicity.score_texts([t], model)[0] < 0.5}
    assert {k for k, _ in rows_of(clean)} == want and clean.columns == docs.columns

    once = STAGES["line dedup"](spark, clean, sf).cache()
    gone = expected_lines(rows_of(clean))
    for k, t in rows_of(clean):
        kept = "\n".join(s for i, s in enumerate((t or "").split("\n")) if (k, t, i) not in gone)
        assert dict(rows_of(once))[k] == (None if t is None else kept)
    assert once.count() == clean.count() and once.columns == docs.columns
    assert once.where(F.length("text") != F.col("n_chars")).count() <= clean.where(F.length("text") != F.col("n_chars")).count()

    single = STAGES["MinHash near-dedup"](spark, once, sf).cache()
    own = rows_of(once)
    assert sorted(k for k, _ in rows_of(single)) == sorted(set(plain_classes(own)))
    assert set(rows_of(single)) <= set(own) and single.columns == docs.columns

    mixed = STAGES["mixing"](spark, single, sf).cache()
    copies = {r["id"]: r["copies"] for r in mixing.mix(single).collect()}
    assert Counter(k for k, _ in rows_of(mixed)) == {k: n for k, n in copies.items() if n}
    assert set(rows_of(mixed)) <= set(rows_of(single)) and mixed.columns == docs.columns

    packed = STAGES["packing"](spark, mixed, sf).collect()
    firsts = Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert firsts == Counter(k for k, _ in rows_of(mixed))
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048


def test_clean_documents_stay(spark, sf):
    """Documents whose text no other one has and that no label calls toxic get through the three filtering stages."""
    docs = spark.createDataFrame([(i, f"document {i} about matter {i * 7919 % 997} and place {i * 31 % 101} with words {i * i}", "en", "a", 40) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("line dedup", "MinHash near-dedup"):
        docs = STAGES[name](spark, docs, sf)
    assert docs.count() == 50
