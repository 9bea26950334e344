"""Empty tables, nulls, repeated rows and clashing column names, for each operator and each stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from drowse.llm import catalog

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "a line without an id, long enough to count", None, "a", None), (3, "word " * 30_000, "en", "a", 150_000), (4, "Two lines of some length here\nTwo lines of some length here", "en", "b", 59), (4, "Two lines of some length here\nTwo lines of some length here", "en", "b", 59)]


@pytest.fixture(scope="module", params=["empty", "odd"])
def folder(request, spark, tmp_path_factory):
    out, rows = str(tmp_path_factory.mktemp(request.param)), [] if request.param == "empty" else ODD
    docs = spark.createDataFrame(rows, DOCS)
    vectors = spark.createDataFrame([] if not rows else [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 0), (None, [1.0], 0), (2, [float("nan"), 1.0], 1), (100, [0.5], 0)], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([] if not rows else [(1, None, None), (2, "http://x", ""), (2, "http://x", ""), (None, "http://y", "z"), (5, "::bad[", "z")], "page_id long, url string, html string")
    labels = spark.createDataFrame([] if not rows else [(1, 1, 1), (2, None, None), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("embeddings", vectors), ("pages", pages), ("labels", labels)):
        if rows:
            for c in ("k", "t", "a", "b", "doc", "pos", "line", "h1", "node", "words", "spans", "score", "length", "number", "task", "bands", "band", "label_a", "bucket", "part", "sha", "n", "record", "run", "tokens", "topic", "factor", "media", "key", "first", "asked", "place", "anchor", "positive", "page", "c0", "links", "pairs", "counts", "count"):
                df = df.withColumn(c, F.lit("other"))
        df.write.parquet(f"{out}/{name}.parquet")
    return request.param, out


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, folder, name):
    kind, path = folder
    n = catalog.QUERIES[name](spark, path).count()
    if kind == "empty":
        assert n == 0
    elif name.startswith("op12_"):
        assert n == 0  # the anchors there have no positive
    elif name.startswith(("op2_", "op3_", "op8_", "op11_")):
        assert n > 0
    else:
        assert n == len(ODD)


#: Columns that tell nothing of an id, by query: equal texts have equal values there, and a null text those of an empty one.
OF_TEXTS = {
    "op1_license_scan": ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"),
    "op4_toxicity": ("score", "predicted"),
    "op6_audio_features": ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"),
    "op10_secret_scan": ("n_assign", "n_access", "n_hex", "base_sha256", "spans"),
    "op13_token_alignment": ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"),
}


@pytest.mark.parametrize("name", sorted(OF_TEXTS))
def test_values_of_odd_texts(spark, folder, name):
    kind, path = folder
    if kind == "empty":
        return
    rows = catalog.QUERIES[name](spark, path).collect()
    told = {}
    for r in rows:
        told.setdefault(r["doc_id"], []).append(tuple(r[c] for c in OF_TEXTS[name]))
    assert {k: len(v) for k, v in told.items()} == {1: 1, 2: 2, None: 1, 3: 1, 4: 2}
    assert told[2][0] == told[2][1] == told[1][0]  # empty, empty again, null
    assert told[4][0] == told[4][1] != told[2][0] or name in ("op4_toxicity", "op10_secret_scan", "op1_license_scan")
    got = {c: v for c, v in zip(OF_TEXTS[name], told[2][0], strict=True)}
    if name == "op13_token_alignment":
        assert set(told[2][0]) == {0, ""}
        whole = dict(zip(OF_TEXTS[name], told[3][0], strict=True))
        assert whole["n_links"] == whole["n_a"] + whole["n_b"] - whole["n_groups"] > 30_000
    elif name == "op10_secret_scan":
        assert got == {"n_assign": 0, "n_access": 0, "n_hex": 0, "base_sha256": hashlib.sha256(b"").hexdigest(), "spans": ""}
    elif name == "op1_license_scan":
        assert (got["n_words"], got["n_base"], got["base_labels"], got["labels"]) == (0, 0, "", "")
        assert dict(zip(OF_TEXTS[name], told[3][0], strict=True))["n_words"] == 30_000
    elif name == "op6_audio_features":
        assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"]) == (0, 576, hashlib.sha256(b"\xff" * 576).hexdigest())
    else:
        assert 0 <= got["score"] < 0.5


def test_stages(spark, folder):
    kind, path = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    assert (corpus_pipeline.run(spark, path).count() == 0) == (kind == "empty")


def test_stages_keep_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic, lines, near, *_ = [f for _, f in corpus_pipeline.STAGES]
    a = toxic(spark, docs, sf)
    assert a.count() > 0.8 * docs.count()
    b = lines(spark, a, sf)
    assert b.count() > 0.7 * a.count()
    c = near(spark, b, sf)
    assert c.count() > 0.7 * b.count()
    assert c.select("doc_id").distinct().count() == c.count()
