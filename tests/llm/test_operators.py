"""Each corpus operator against a plain version of itself, or an exact round trip."""

import base64
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from drowse.llm import audio_features, catalog, license_scan, line_dedup, mixing, near_dup, packing, secret_scan, topk, toxicity, warc
from drowse.llm.common import whole_groups

WORDS = "the of under license version apache mit cc by nc gnu general public stone river cloud paper garden window yellow silent".split()


def texts(spark, sf):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, sf).select(*want.columns)
    key = lambda r: tuple(str(x) for x in r)
    close = lambda a, b: abs(a - b) < 1e-5 if isinstance(a, float) else a == b
    rows = list(zip(sorted(map(tuple, got.collect()), key=key), sorted(want.fetchall(), key=key), strict=True))
    assert rows
    assert all(close(x, y) for a, b in rows for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", ["op4_toxicity", "op6_audio_features", "op8_best_two_fit", "op9_weighted_minhash", "op10_secret_scan"])
def test_ids_stay_exact_beside_nulls(spark, tmp_path, name):
    """Ids that doubles can't hold, in one batch with a null id."""
    docs = [(2**53 + 1, "one text of its own"), (None, "another text"), (2**53 + 3, "a third text here"), (-(2**63), "and a fourth")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2**53 + 1, 0), (2**53 + 3, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == {k for k, _ in docs} and len(rows) == len(docs)
    if name == "op9_weighted_minhash":
        assert all(r["class_id"] == r["doc_id"] for r in rows)


def test_license_index_needs_two_postings():
    """Any match holds as many indexed words as its template needs, and nearly all templates need two."""
    rng = random.Random(2)
    needs = []
    for x in license_scan.templates():
        weights = {w: rng.choice([200, 1000, 4000, 9000]) for w in x["words"]}
        share = 1.0 if x["base"] else license_scan.THRESHOLD
        places, need = license_scan.rare_positions(x["words"], weights, share)
        needs.append(need)
        total = sum(weights[w] for w in x["words"])
        for _ in range(200):
            held = [i for i in range(len(x["words"])) if x["must"][i] or rng.random() < 0.9]
            if sum(weights[x["words"][i]] for i in held) >= share * total:
                assert len(set(held) & set(places)) >= need
        assert len(places) < len(x["words"]) or len(places) <= 3 or need == 1
    assert sum(n == 2 for n in needs) > 0.8 * len(needs)


def test_secrets_against_plain_patterns(spark, sf):
    docs = texts(spark, sf) + [(-1, None), (-2, 'Token : "abcdef" secret=a token=b AKIA' + "Z" * 16 + " " + "0af" * 9), (-3, "api_key=x.y-z=/+ password='q")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in secret_scan.scan_secrets(df).collect()}
    assign = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for k, t in docs:
        t = t or ""
        want = [(m.start(), m.end(), "assign") for m in assign.finditer(t) if len(m[1]) >= 6]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(want) == sorted(s for s in got[k] if s[2] != "markov")


def test_markov_finds_random_tokens_only(spark, sf):
    ratio = secret_scan.train_ratio(spark.read.parquet(f"{sf}/documents.parquet"))
    fresh = [base64.b64encode(hashlib.sha256(f"other {i}".encode()).digest()).decode().rstrip("=") for i in range(200)]
    plain = [f"{a}{b.capitalize()}{c.capitalize()}Handler{i}" for i, (a, b, c) in enumerate(itertools.islice(itertools.permutations(WORDS[12:], 3), 200))]
    hit = lambda s: any(k == "markov" for _, _, k in secret_scan.spans(f"x {s} y", ratio))
    assert sum(map(hit, fresh)) >= 190
    assert sum(map(hit, plain)) <= 10


def test_secrets_do_not_depend_on_ids(spark, sf):
    """Null, equal and huge ids: the same spans for each text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    told = lambda df: sorted((r["text"] or "", [(s["start"], s["end"], s["kind"]) for s in r["spans"]]) for r in secret_scan.scan_secrets(df.withColumn("doc_id", F.struct("doc_id", "text"))).select("doc_id.text", "spans").collect())
    want = told(docs)
    for key in (F.lit(None).cast("long"), F.lit(5).cast("long"), F.col("doc_id") + 2**60):
        assert told(docs.withColumn("doc_id", key)) == want
        assert (secret_scan.train_ratio(docs.withColumn("doc_id", key)) == secret_scan.train_ratio(docs)).all()


def test_markov_spans_against_plain_form(spark, sf):
    """Maximal tokens of 16 characters or more, outside the patterns' spans, whose transitions sum to the evidence, character by character."""
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(-1 - i, f"key {base64.b64encode(hashlib.sha256(bytes([i])).digest()).decode()[: 12 + i]}, and {'0af1' * 9}{i} or /a/path/of/words-{i}") for i in range(30)]
    df = df.union(spark.createDataFrame(odd, df.schema))
    ratio, letters = secret_scan.train_ratio(df), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    code = lambda c: letters.index(c) if c in letters else 64
    found = 0
    for r in secret_scan.scan_secrets(df).join(df, "doc_id").collect():
        t, want, at = r["text"] or "", [], 0
        fixed = [(s["start"], s["end"]) for s in r["spans"] if s["kind"] != "markov"]
        while at < len(t):
            end = at
            while end < len(t) and (t[end] in letters or t[end] in "_=-"):
                end += 1
            if end - at >= 16 and not any(a < end and at < z for a, z in fixed) and sum(ratio[code(x), code(y)] for x, y in zip(t[at:end], t[at + 1 : end], strict=False)) >= 16:
                want.append((at, end))
            at = max(end, at + 1)
        got = [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "markov"]
        assert got == want
        found += len(want)
    assert found > 0


def test_warc_round_trip_and_order(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 5)
    monkeypatch.setattr(warc, "RANGE", 15)
    monkeypatch.setattr(warc, "SMALL_FILE", 20)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    odd = [(100001, "http://a.example/x\r\ny", "one\r\n\r\nWARC/1.1\r\n\r\ntwo"), (100002, None, None), (100003, "http://b", ""), (100004, "http://b", "é" * 70_000), (100005, "https://www.b:8/", "é" * 70_000), (2**53 + 1, "http://c", "é"), (None, "http://c", "é"), (None, "http://d", "nobody's"), (None, "http://d", "nobody's"), (100007, "http://e", "thrice"), (100007, "http://e", "thrice"), (100007, "http://d", "thrice"), (100009, "http://e", "thrice")]
    rows = pages.union(spark.createDataFrame(odd, pages.schema))
    path = f"{spark.conf.get('spark.checkpoint.dir')}/test-warc"
    warc.write_archives(rows, path)
    runs = warc.read_runs(spark, path)
    got = warc.merge_runs(runs).collect()
    source = [(r["page_id"], (r["html"] or "").encode()) for r in rows.collect()]
    groups = {}
    for k, data in source:
        groups.setdefault(data, []).append(k)
    want = []
    for data, ids in groups.items():
        ids = sorted(ids, key=lambda k: (k is None, k or 0))
        want += [(k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if i else "response", ids[0] if i else None) for i, k in enumerate(ids)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    assert len({r["range"] for r in got}) > 2
    ordered = sorted(got, key=lambda r: (r["range"], r["place"]))
    assert [warc.order(tuple(r)) for r in ordered] == sorted(warc.order(tuple(r)) for r in got)
    for at in {r["range"] for r in got}:
        assert [r["place"] for r in ordered if r["range"] == at] == list(range(sum(r["range"] == at for r in got)))
    assert max(r["n"] for r in warc.blocks(runs, warc.boundaries(runs)).select(F.size("rows").alias("n")).collect()) <= 5


def capture_row(rng):
    return rng.randrange(50), 0, "", "", None, rng.choice("abc"), str(rng.randrange(3))


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted((capture_row(rng) for _ in range(rng.randrange(9))), key=warc.order) for _ in range(k)]
        assert [warc.order(x) for x in warc.loser_tree(runs)] == sorted(warc.order(x) for r in runs for x in r)


def test_merge_holds_a_block_of_each_run():
    """Blocks are asked for no sooner than the block before in their run is used up."""
    rng = random.Random(4)
    runs = [sorted(((rng.randrange(10**6), 0, "", "", None, "a", "") for _ in range(200)), key=warc.order) for _ in range(6)]
    blocks = [(None if i == 0 else warc.order(r[i - 1]), str(n), i + 20 >= len(r), r[i : i + 20]) for n, r in enumerate(runs) for i in range(0, len(r), 20)]
    blocks.sort(key=lambda b: (b[0] is not None, b[0] or (), b[1]))
    read = 0

    def arriving():
        nonlocal read
        for after, name, last, rows in blocks:
            read += len(rows)
            yield name, after is None, last, rows

    most = done = 0
    out = []
    for row in warc.merged(arriving()):
        out.append(row)
        done += 1
        most = max(most, read - done)
    assert out == sorted((x for r in runs for x in r), key=warc.order)
    assert most <= (len(runs) + 1) * 20


def test_topk_with_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * rng.choice([0.01, 1, 30])]) for i in range(0, 400, 4)]
    rows += [(500, None), (501, [None, 1.0]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (600, [0.0] * 8), (601, []), (602, [1.0, 2.0]), (604, [1e10] * 8), (None, [1.0] * 8)] + [rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("other"))
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, 5).collect()
    ints = {k: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (k for k in ints if k % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=False)), k) for k, v in ints.items() if k != q)[:5]
        want |= {(q, i + 1, k, -s) for i, (s, k) in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_topk_blocks_hold_a_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    m = np.floor(v * 1024).astype(int)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()}
    for q in (0, 100, 200):
        order = sorted((-int(m[q] @ m[i]), i) for i in range(300) if i != q)[:10]
        assert [got[q, i + 1] for i in range(10)] == [i for _, i in order]


def test_topk_prunes_and_stays_exact():
    """Queries near some vectors, lengths of a bucket: pairs are left out both by length and by coordinates, no result is."""
    rng = np.random.default_rng(9)
    for dim in (4, 16):
        centers = rng.normal(size=(30, dim))
        unit = centers[rng.integers(0, 30, 600)] + 0.1 * rng.normal(size=(600, dim))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        v = np.floor(unit * rng.uniform(900, 1024, 600)[:, None]).astype(np.int64)
        v = v[np.argsort(-(v.astype(float) ** 2).sum(1), kind="stable")]
        ids, seen = np.arange(600), {}
        pick = rng.choice(600, 60, replace=False)
        q, q_ids = v[pick], ids[pick]
        exact = q @ v.T
        exact[np.arange(60), pick] = -(2**62)
        floors = np.sort(exact, axis=1)[:, -10].astype(float)
        got = {}
        for i, j, s in topk.search_block(q_ids, q, floors, ids, v, 10, seen):
            got.setdefault(i, []).append((-s, j))
        for row, i in enumerate(q_ids):
            want = sorted((-int(exact[row, j]), int(j)) for j in range(600) if exact[row, j] >= floors[row])[:10]
            assert sorted(got[i])[:10] == want
        assert seen["length"] > 0 and seen["coordinates"] > 1000
        assert seen["verified"] + seen["length"] + seen["coordinates"] == 60 * 600
        assert seen["verified"] < 0.8 * 60 * 600


def test_topk_broadcasts_no_blocks(spark, sf):
    plan = topk.op3_norm_buckets(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_topk_sends_queries_only_to_useful_buckets(spark):
    parts = {topk.WIDTHS * b + 4: 2 for b in (-1, 0, 10, 40)}
    need = topk.RATIO**20
    got = spark.range(1).withColumn("need", F.lit(need)).select(F.explode(topk._useful_blocks(parts, "need")).alias("b")).select("b.*")
    assert {tuple(r) for r in got.collect()} == {(topk.WIDTHS * 40 + 4, 0), (topk.WIDTHS * 40 + 4, 1)}


def test_topk_never_overflows(spark):
    big = [(0, [4e6] * 4), (100, [4e6] * 4), (7, [-4e6, 4e6, -4e6, 4e6])]
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    with pytest.raises(Exception, match="too great"):
        topk.top_k(spark.createDataFrame([(0, [1e15]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    near = [(0, [2.5e6, 0.0]), (100, [0.0, 2.5e6]), (7, [-1.0, 2.5e6])]
    got = topk.top_k(spark.createDataFrame(near, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    m = {k: [int(np.floor(1024 * x)) for x in v] for k, v in near}
    want = {(q, i + 1, k, -s) for q in (0, 100) for i, (s, k) in enumerate(sorted((-sum(a * b for a, b in zip(m[q], m[k], strict=True)), k) for k in m if k != q))}
    assert {tuple(r) for r in got} == want


def test_toxicity_held_out(spark):
    """Figures of rows that nothing was learned from, at the size that has enough labels."""
    folder = os.environ.get("TEST_LABELS_DIR", "/root/testdata/sf0.1")
    scored = toxicity.op4_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    rows = scored.select("predicted", "toxic", "score").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) >= 0.94
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_features(word):
    """Subsequences of ORDER characters of a word with its ends, by weight: DECAY for each character skipped, up to GAP in all."""
    w, out = [0, *word, 0], Counter()
    for places in itertools.combinations(range(len(w)), toxicity.ORDER):
        skipped = places[-1] - places[0] - toxicity.ORDER + 1
        if skipped <= toxicity.GAP:
            out[tuple(w[i] for i in places)] += toxicity.DECAY**skipped
    return out


def test_the_kernel_is_the_plain_one():
    rng = random.Random(7)
    words = [bytes(rng.randrange(1, 5) for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    c, starts = toxicity._joined(words)
    norm = lambda w: max(0.5, float(toxicity.NORMS[len(w) + 2]))
    for landmark in words[:8]:
        got = toxicity.word_scores(c, starts, toxicity.features_of(landmark))
        own = plain_features(landmark)
        want = [sum(v * own[g] for g, v in plain_features(w).items()) / norm(w) / norm(landmark) for w in words]
        assert np.allclose(got, want, rtol=1e-4, atol=1e-5)


def test_toxicity_tolerates_spellings():
    words = ["table", "garden", "yellow", "window", "paper", "silent", "river", "stone", "cloud", "market"]
    rng = random.Random(1)
    sentence = lambda extra: " ".join(rng.sample([f"{rng.choice(words)}{rng.choice(['', 's', 'er', 'ing'])}" for _ in range(6)] + extra, 6 + len(extra))) + ". "
    text = lambda extra: "".join(sentence(x) for x in rng.sample([[], [], [], *[[w] for w in extra]], 3 + len(extra)))
    bad = ["idiot", "moron", "worthless"]
    docs = [text(rng.choices(bad, k=2)) for _ in range(150)] + [text([]) for _ in range(150)]
    model = toxicity.fit(docs, [1] * 150 + [0] * 150)
    odd = ["the i d i o t and m.o.r.o.n", "an idiot, a m0ron", "wor-thless Idiot", "idixot morpon", "ＩＤＩＯＴ and móron", "idi\u200bot mor\u0301on"]
    assert (toxicity.score_texts(odd, model) > 0.5).all()
    clean = [text([]), "", None, "a b c", "!!! 99", "прекрасный город и река", "河流 和 城市"]
    assert (toxicity.score_texts(clean, model) < 0.5).all()
    none = toxicity.fit(docs, [0] * 300)
    assert (toxicity.score_texts(docs[:3], none) < 1e-9).all()


def test_other_scripts_can_be_learned():
    rng = random.Random(2)
    words = ["город", "река", "камень", "бумага", "окно", "сад", "облако", "рынок"]
    text = lambda extra: ". ".join(" ".join(rng.sample(words, 4) + x) for x in ([], *[[w] for w in extra]))
    docs = [text(rng.choices(["дурак", "идиот"], k=2)) for _ in range(80)] + [text([]) for _ in range(80)]
    model = toxicity.fit(docs, [1] * 80 + [0] * 80)
    assert (toxicity.score_texts([text(["дурак", "идиот"]) for _ in range(10)], model) > 0.5).all()
    assert (toxicity.score_texts([text([]) for _ in range(10)], model) < 0.5).all()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance():
    rng = random.Random(2)
    pairs = []
    for _ in range(3000):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(40)))
        b = list(a)
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "dd"])
        pairs.append((a, "".join(b)))
    exact = np.array([distance(a, b) for a, b in pairs])
    edits = np.array([rng.randrange(1, 9) for _ in pairs])
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert (line_dedup.within(left, right, edits) == (exact <= edits)).all()
    for k in range(1, 8):
        assert (line_dedup.within(left, right, np.full(len(pairs), k)) == (exact <= k)).all()


def expected_lines(docs):
    """(document, place) of the lines that go, by all pairs. docs: (id, text), in any order. Only pairs whose lengths and characters differ by no
    more than the edits allow are worth a table of distances."""
    lines, gone = [], set()

    def alike(s, n, x, m):
        k = line_dedup.budget(min(len(s), len(x)))
        return s == x or abs(len(s) - len(x)) <= k and sum((n - m).values()) <= k and sum((m - n).values()) <= k and distance(s, x) <= k

    for has_id, k, _, t in sorted({(k is not None, k or 0, text_hash(t), t) for k, t in docs if t is not None}):
        for pos, s in enumerate(t.split("\n")):
            if any(c.isalnum() for c in s):
                n = Counter(s)
                if any(alike(s, n, x, m) for x, m in lines):
                    gone.add((k if has_id else None, t, pos))
                lines.append((s, n))
    return gone


def text_hash(text):
    """The signed hash by which documents that share an id are ordered."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


@pytest.mark.parametrize("group", [1024, 3])
def test_lines_against_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(line_dedup, "GROUP", group)
    monkeypatch.setattr(line_dedup, "RUN", 300)
    rng = random.Random(4)
    base = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 8, 12, 30, 60) for _ in range(3)]

    def edited(s):
        s = list(s)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randrange(2)] = rng.choice(["", "x", "é"])
        return "".join(s)

    docs = [(rng.choice([i, i, 2**53 + i, None]), "\n".join(edited(rng.choice(base)) for _ in range(rng.randrange(1, 5)))) for i in range(70)]
    docs += [(7, "one more\nof id 7"), (7, "of id 7\none more\nthird"), (None, "one more"), (100, None), (101, ""), (102, "short\nshort\n}\n}"), (103, "}\n")] + docs[:2]
    rows = [(k, t, i) for i, (k, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line long")
    for c in ("id", "t1", "h1", "row", "exact", "near", "first", "gone_id", "_kept"):
        df = df.withColumn(c, F.concat(F.lit("own "), F.col("line")))
    got = {r["line"]: r for r in line_dedup.dedup_lines(df, report="told").collect()}
    gone = expected_lines(docs)
    assert len(got) == len(docs) and len(gone) > 30
    for k, t, i in rows:
        lost = {p for d, x, p in gone if (d, x) == (k, t)}
        kept = None if t is None else "\n".join(s for p, s in enumerate(t.split("\n")) if p not in lost)
        assert got[i]["text"] == kept, (k, t)
        assert got[i]["told"]["n_exact"] + got[i]["told"]["n_near"] == len(lost)
        assert (got[i]["doc_id"], got[i]["row"], got[i]["_kept"]) == (k, f"own {i}", f"own {i}")


def test_alike_lines_share_a_key():
    rng = random.Random(5)
    for n in (20, 30, 39, 41, 60, 119, 121, 130, 239, 241, 267, 510, 1030):
        for _ in range(40):
            s = [rng.choice("abcdefghij ") for _ in range(n)]
            a = "".join(s)
            for _ in range(line_dedup.budget(n)):
                at = rng.randrange(len(s))
                s[at : at + 1] = rng.choice(["", "x", "xy"])
            b = "".join(s)
            if a != b and distance(a, b) <= line_dedup.budget(min(len(a), len(b))):
                keys, owner = line_dedup.line_keys([a, b])
                assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_a_passage_at_another_place_is_no_shared_key():
    rng = random.Random(11)
    made = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, first, second = made(150), made(500), made(500)
    keys, owner = line_dedup.line_keys([passage + first, second + passage])
    assert not set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
    for n in (600, 5000, 100_000):  # and keys stay in proportion to the characters
        assert len(line_dedup.line_keys([made(n)])[0]) < n / 3


def test_a_line_is_verified_with_its_most_alike_first(monkeypatch):
    """Copies of one line are a pair each, not all pairs."""
    rng, verified, within = random.Random(12), [], line_dedup.within
    monkeypatch.setattr(line_dedup, "within", lambda a, b, k: (verified.append(len(a)), within(a, b, k))[1])
    base = "".join(rng.choice("abcdefgh ") for _ in range(300))
    lines = [base] + [edited_long(rng, base, 6) for _ in range(59)]
    n = len(lines)
    rows = pd.DataFrame({"h1": range(n), "line": lines, "key": 5, "keys": [np.array([5, 7])] * n, "part": 0, "cross": False, "group": 0})
    assert line_dedup.have_earlier(rows, set()).tolist() == [False] + [True] * 59
    assert sum(verified) < 6 * n
    assert not line_dedup.have_earlier(rows.assign(keys=[np.array([3, 5])] * n), set()).any()  # they meet in the group of key 3


def test_groups_of_neighbouring_keys_stay_apart():
    """64-bit keys that are equal as doubles."""
    rows = pd.DataFrame({"key": [2**62, 2**62, 2**62 + 1, 2**62 + 2, 2**62 + 2], "v": range(5)})
    got = [g for part in whole_groups([rows.iloc[:2], rows.iloc[2:4], rows.iloc[4:]], ["key"]) for _, g in part.groupby("group")]
    assert [g["v"].tolist() for g in got] == [[0, 1], [2], [3, 4]]


def long_distance(a, b):
    """As `distance`, a row at a time in arrays."""
    y, i = np.frombuffer(b.encode("utf-32-le"), "<u4"), np.arange(len(b) + 1)
    row = i.copy()
    for n, x in enumerate(np.frombuffer(a.encode("utf-32-le"), "<u4"), 1):
        new = np.concatenate([[n], np.minimum(row[1:] + 1, row[:-1] + (y != x))])
        row = np.minimum.accumulate(new - i) + i
    return int(row[-1])


def edited_long(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        at = rng.randrange(len(s))
        s[at : at + rng.randrange(2)] = rng.choice(["", "é", "x"])
    return "".join(s)


def test_long_pairs_by_wide_bands():
    rng = random.Random(8)
    for n in (1100, 1500, 2600, 4000):
        a = "".join(rng.choice("abcdefgh ") for _ in range(n))
        k = line_dedup.budget(n)
        assert k > line_dedup.WIDE
        for edits in (0, 3, k - 1, k, k + 2, 2 * k):
            b = edited_long(rng, a, edits)
            exact = long_distance(a, b)
            assert line_dedup.within([a, b], [b, a], np.array([k, k])).tolist() == [exact <= k] * 2
            assert line_dedup.within([a], [b], np.array([max(1, exact)]))[0]
            assert exact < 32 or not line_dedup.within([a], [b], np.array([exact - 1]))[0]


def test_lines_of_any_length_against_all_pairs(spark):
    """From 20 to 4000 characters, edits about the budget: the lines that go are those of all pairs, and a 32nd of the characters may differ."""
    rng = random.Random(9)
    lines = []
    for n in (20, 33, 40, 70, 96, 130, 267, 500, 800, 1000, 1030, 1200, 1800, 2500, 4000):
        base = "".join(rng.choice("abcdefghijklmnop    ") for _ in range(n))
        lines += [base] + [edited_long(rng, base, e) for e in (1, max(1, n // 64), n // 32, n // 32 + 3)]
    docs = list(enumerate(lines))
    gone = set()
    for i, x in docs:
        for _, y in docs[:i]:
            k = max(2, min(len(x), len(y)) // 32) if min(len(x), len(y)) >= 40 else int(min(len(x), len(y)) >= 20)
            if abs(len(x) - len(y)) <= k and long_distance(x, y) <= k:
                gone.add(i)
                break
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"] for r in line_dedup.dedup_lines(df, report="told").where("told.n_near + told.n_exact > 0").collect()}
    assert got == gone
    assert len([i for i in gone if len(lines[i]) > 1100]) > 8


def test_lines_of_a_part_of_the_keys_are_dealt_at_a_time(spark, monkeypatch):
    """Each pass writes and shuffles a part of the groups, and nothing is written before that the pairs do not need."""
    rng, names, written = random.Random(3), [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name, **o: (names.append(name), written(df, name, **o))[1])
    docs = []
    for i in range(60):
        line = "".join(rng.choice("abcdefgh ") for _ in range(90)) + "x"
        docs += [(2 * i, line), (2 * i + 1, line[:40] + "?" + line[41:])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"] for r in line_dedup.dedup_lines(df, report="told").where("told.n_near > 0").collect()}
    assert got == {2 * i + 1 for i in range(60)}
    assert names.count("near-lines") == line_dedup.PASSES > 1 and "lines" not in names


def test_groups_are_bounded_by_characters(spark, monkeypatch):
    """Few, but long, lines that share a segment are blocks of CHARS characters."""
    monkeypatch.setattr(line_dedup, "CHARS", 4000)
    rng = random.Random(10)
    docs = [(i, "a beginning of thirty-six characters" + "".join(rng.choice("abcdefgh") for _ in range(900))) for i in range(40)]
    own = line_dedup.renamed(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    lines = line_dedup.line_hashes(own).select("h1", "h2", "line")
    rows = line_dedup.groups(line_dedup.shared_keys(line_dedup.line_keys_twice(own)), lines).groupBy("key", "cell", "lo", "hi").agg(F.sum(F.length("line")).alias("n")).collect()
    assert rows and max(r["n"] for r in rows) <= 3 * 2 * 4000


def test_hot_segments_are_split(spark, monkeypatch):
    """Lines that all share their beginning: no group is larger than two blocks, and pairs of lengths that can't be alike don't meet."""
    monkeypatch.setattr(line_dedup, "GROUP", 8)
    rng = random.Random(6)
    docs = [(i, "the same beginning of a log line " + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(10, 150)))) for i in range(200)]
    own = line_dedup.renamed(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    lines = line_dedup.line_hashes(own).select("h1", "h2", "line")
    rows = line_dedup.groups(line_dedup.shared_keys(line_dedup.line_keys_twice(own)), lines).select("key", "cell", "lo", "hi", F.length("line").alias("n")).collect()
    met = {}
    for r in rows:
        met.setdefault((r["key"], r["cell"], r["lo"], r["hi"]), []).append(r["n"])
    assert rows and max(len(g) for g in met.values()) <= 4 * 8
    assert all(max(g) - min(g) <= 5 or max(g) / min(g) < 1.07 for g in met.values() if len(g) > 8)
    assert sum(len(g) ** 2 for g in met.values()) < 200**2


def test_each_line_stays_in_one_document(spark, sf):
    shared = [f"a passage on {s} that several documents share" for s in ("rivers and stones", "yellow paper", "cloudy windows at night", "the garden of a silent public house")]
    docs = [(1, "\n".join(shared[:2])), (2, "\n".join([*shared[:3], "a line that only this document holds"])), (3, "\n".join(shared[2:])), (4, "\n".join(shared)), (5, shared[0] + "\nshort")]
    df = spark.createDataFrame([(*d, "en", "a", 0) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.drop_repeated_lines(spark, df, sf).collect()}
    assert sorted(s for r in got.values() for s in r["text"].split("\n") if s) == sorted({s for _, t in docs for s in t.split("\n")})
    assert set(got) == {1, 2, 3, 4, 5} and got[4]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for k, r in got.items() if k > 1) and got[1]["n_chars"] == 0


def test_audio_round_trip(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 576), (5, "words and more " * 30_000), (6, "héllo"), (2**53 + 1, "one"), (None, "two"), (2**53 + 3, "three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(0))
    media = audio_features.media_column(df)
    stored = audio_features.tensors(media)
    got = {r["doc_id"]: r for r in audio_features.features(stored).collect()}
    assert set(got) == {k for k, _ in rows}
    for k, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] == len(payload) + 44
        mel = audio_features.log_mel(np.frombuffer(payload, np.uint8))
        spans = plain_segments(mel)
        means = ",".join(str(round(float(v) * 100)) for v in mel.mean(axis=0, dtype=np.float64))
        assert r["feature"] == f"{len(mel)}:{len(spans)}:{sum(b - a for a, b in spans)}:{means}"
    assert got[1]["feature"] == got[6]["feature"] != got[4]["feature"]
    long = stored.where("doc_id = 5").collect()[0]
    column = audio_features.tensor_column(pa.array(long["tensors"], pa.list_(pa.float32())))
    assert isinstance(column.type, pa.FixedShapeTensorType)
    assert column.type.shape == [audio_features.FRAMES, audio_features.MELS]
    seconds = audio_features.HOP * audio_features.DOWN / (audio_features.RATE * audio_features.UP)
    assert long["start_s"] == [0.0, *long["end_s"][:-1]] and abs(long["end_s"][-1] - long["n_frames"] * seconds) < 1e-9
    assert len(long["tensors"]) == -(-long["n_frames"] // audio_features.FRAMES)


def plain_segments(mel):
    e = mel.mean(axis=1)
    high, low = e.mean() + 0.5 * e.std(), e.mean() - 0.25 * e.std()
    out, start = [], None
    for i, x in enumerate(e):
        if start is None and x >= high:
            start = i
        elif start is not None and x < low:
            out.append((start, i))
            start = None
    return out + ([(start, len(e))] if start is not None else [])


def test_segments_with_hysteresis():
    rng = np.random.default_rng(3)
    for _ in range(50):
        mel = np.cumsum(rng.normal(size=(rng.integers(1, 80), 4)), axis=0)
        assert audio_features.segments(mel) == plain_segments(mel)


def test_log_mel_matches_the_plain_form():
    s = np.random.default_rng(4).integers(0, 256, 1500).astype(np.uint8)
    x = (s.astype(np.float64) - 128) / 128
    h, up, down = audio_features.low_pass().astype(np.float64), audio_features.UP, audio_features.DOWN
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    y = np.convolve(wide, h)[: len(wide)][::down]
    frames = 1 + (len(x) * up // down - audio_features.FRAME) // audio_features.HOP
    turn = np.exp(-2j * np.pi * np.outer(np.arange(audio_features.FFT // 2 + 1), np.arange(audio_features.FRAME)) / audio_features.FFT)
    plain = [np.log(np.abs(turn @ (y[i * audio_features.HOP :][: audio_features.FRAME] * np.hanning(audio_features.FRAME))) ** 2 @ audio_features.mel_filters() + 1e-6) for i in range(frames)]
    assert np.abs(audio_features.log_mel(s) - np.array(plain)).max() <= 0.5 / audio_features.STEPS + 1e-3


def test_resampling_matches_the_plain_form():
    x = np.random.default_rng(1).normal(size=400).astype(np.float32)
    for up, down in ((1, 2), (2, 3), (3, 1)):
        h = audio_features.low_pass(up, down)
        wide = np.zeros(len(x) * up, np.float32)
        wide[::up] = x
        want = np.convolve(wide, h)[: len(wide)][::down]
        got = audio_features.resample(x, 0, len(want), up, down)
        assert np.allclose(got, want, atol=1e-4)
        assert np.allclose(audio_features.resample(x, 37, 60, up, down), want[37:60], atol=1e-4)


def test_log_mel_blocks_agree(monkeypatch):
    s = np.random.default_rng(2).integers(0, 256, 20_000).astype(np.uint8)
    whole = audio_features.log_mel(s)
    monkeypatch.setattr(audio_features, "BLOCK", 7)
    assert np.allclose(whole, audio_features.log_mel(s), atol=1e-3)


def margins(rows, d, weight):
    out = Counter()
    for r in rows:
        out[r[d]] += r[weight] * r["tokens"]
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def spread_documents(spark, sf):
    """Each document 20 times, under other ids: enough rows for a sample's shares to settle."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("part", F.explode(F.array(*map(F.lit, range(20)))))
    return docs.withColumn("doc_id", F.col("doc_id") * 20 + F.col("part")).drop("part")


def test_sampled_shares_meet_given_targets(spark, sf):
    target = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
    given = spark.createDataFrame([*target.items(), ("xx", 0.5)], "value string, share double")
    rows = mixing.mix(spread_documents(spark, sf), {"lang": given}).collect()
    for weight, error in (("factor", 1e-4), ("expected", 1e-4), ("copies", 0.03)):
        got = margins(rows, "lang", weight)
        assert all(abs(got[k] - v) < error for k, v in target.items()), weight
    with pytest.raises(ValueError, match="no target for lang"):
        mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), {"lang": given.where("value <> 'de'")})


def test_sampled_shares_meet_default_targets(spark, sf):
    docs = spread_documents(spark, sf)
    rows = mixing.mix(docs).collect()
    assert abs(sum(r["copies"] for r in rows) - mixing.RATE * len(rows)) < 0.05 * len(rows)
    plain = [r.asDict() | {"one": 1} for r in rows]
    for d in mixing.CELL:
        tokens = margins(plain, d, "one")
        whole = sum(v**mixing.TEMPERATURE for v in tokens.values())
        for weight, error in (("expected", 1e-4), ("copies", 0.03)):
            got = margins(rows, d, weight)
            assert all(abs(got[k] - v**mixing.TEMPERATURE / whole) < error for k, v in tokens.items()), (d, weight)


def test_a_drawn_row_keeps_its_columns(spark, sf):
    docs = [(i, "the license of a license" if i % 3 else "plain words", f"s{i % 2}", "en") for i in range(60)] + [(None, None, None, None), (7, "", "s1", "en"), (7, "", "s1", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    own = ["row", "id", "topic", "tokens", "factor", "expected", "copies", "copy", "w", "docs", "_prob"]
    out = mixing.resample(df.withColumns({c: F.concat_ws("-", F.lit(c), "doc_id") for c in own}))
    assert out.columns == [*df.columns, *own]
    assert all(r[c] == (f"{c}-{r['doc_id']}" if r["doc_id"] is not None else c) for r in out.collect() for c in own)
    times = Counter(r["doc_id"] for r in out.collect())
    want = {(r["id"], r["copies"]) for r in mixing.mix(df).collect()}
    assert {k: n for k, n in times.items() if k != 7} == {k: n for k, n in want if n and k != 7}


def test_contradicting_margins_warn(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "en"), (2, "c d", "y", "de")], "doc_id long, text string, source string, lang string")
    of = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    with pytest.warns(UserWarning, match="off by"):
        mixing.mix(docs, {"source": of({"x": 0.9, "y": 0.1}), "lang": of({"en": 0.1, "de": 0.9})}).collect()


def test_packing(spark, sf):
    exact, _ = packing._encoders("byte_bpe_50k.json")
    docs = [*texts(spark, sf), (-1, None), (-2, ""), (-3, "a b " * 5000), (-3, "a b " * 5000), (-4, "x <|endoftext|> y")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit(1))
    rows = packing.pack(df).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], set()).add((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, t in docs:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[k])
        assert [p[1] for p in pieces] == [0, *np.cumsum([p[2] for p in pieces])[:-1]]
        assert sum(p[2] for p in pieces) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for _, s, n, crc in pieces)
        assert all(n == packing.CAPACITY for _, _, n, _ in pieces[1:])
    for own in by_bin.values():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]
        assert sum(n for _, n in own) <= packing.CAPACITY
    assert len(by_bin) <= 1.02 * sum(r["length"] for r in rows) / packing.CAPACITY + 2


def test_plan_packs_all_and_swaps_for_two():
    rng = random.Random(9)
    for _ in range(50):
        sizes = {rng.randrange(1, 101): rng.randrange(1, 30) for _ in range(rng.randrange(1, 40))}
        bins = packing.plan(sizes, 100)
        used = {}
        for own, times in bins:
            assert sum(own) <= 100 and times > 0
            for s in own:
                used[s] = used.get(s, 0) + times
        assert used == sizes
    assert packing.plan({60: 1, 30: 1, 21: 1, 19: 1}, 100)[0] == ([60, 21, 19], 1)


def plain_shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def plain_weights(docs, least=1):
    """Step weights of each document's shingles, from exact document frequencies."""
    sets = [plain_shingles(t) for t in docs]
    df, n = Counter(g for s in sets for g in s), len(docs)
    idf = {g: 1 + math.log((n + 1) / (max(least, c) + 1)) / math.log(n + 2) for g, c in df.items()}
    return [{g: 2 ** (round(4 * math.log2(idf[g] * (1 + math.log2(c)))) / 4) for g, c in s.items()} for s in sets]


def plain_similarity(a, b):
    shared = sum(min(w, b[g]) for g, w in a.items() if g in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a and b else 0.0


def plain_classes(rows, least=1):
    """The smallest id of each row's class, by all pairs of texts. rows: (id, text)."""
    texts = sorted({t or "" for _, t in rows})
    weights, parent = plain_weights([t or "" for _, t in rows], least), list(range(len(texts)))
    at = {t: i for i, t in enumerate(texts)}
    own = {t or "": w for (_, t), w in zip(rows, weights, strict=True)}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        if own[texts[a]].keys() & own[texts[b]].keys() and plain_similarity(own[texts[a]], own[texts[b]]) >= 0.8 - 1e-9:
            parent[root(a)] = root(b)
    ids = {}
    for k, t in rows:
        r = root(at[t or ""])
        ids[r] = min((x for x in (ids.get(r), k) if x is not None), default=None)
    return [ids[root(at[t or ""])] for _, t in rows]


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_against_all_pairs(spark, sf, monkeypatch, small):
    if small:
        monkeypatch.setattr(near_dup, "BLOCK", 60_000)
        monkeypatch.setattr(near_dup, "RANGE", 500)
        monkeypatch.setattr(near_dup, "FLUSH", 2000)
    own = texts(spark, sf)
    rng = random.Random(8)
    rows = list(own)
    for i, (_, t) in enumerate(own[:60]):
        words = t.split(" ")
        for at in rng.sample(range(len(words)), min(len(words), rng.randrange(1, 2 + len(words) // 40))):
            words[at] = "changed"
        rows.append((2**53 + 2 * i + 1, " ".join(words)))
    rows += [(20_000, None), (20_001, ""), (20_002, "one two"), (20_003, "One two."), (20_004, own[0][1]), (20_005, own[0][1]), (20_005, own[1][1]), (20_005, "a text that is alone under this id"), (None, own[2][1]), (None, "nobody else has this"), (None, None)]
    rng.shuffle(rows)
    want = plain_classes(rows)
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, band int").withColumns({c: F.lit("own") for c in ("id", "node", "label", "h1", "row", "k")})
    got = {}
    for r in near_dup.classes(df).collect():
        got.setdefault((r["doc"], r["h1"]), set()).add(r["class_id"])
    have = [got[k, text_hash(t or "")] for k, t in rows]
    assert have == [{c} for c in want]
    assert sum(a != k for (k, _), a in zip(rows, want, strict=True)) > 40
    kept = near_dup.keep_one(df).select("doc_id", "text", "node").collect()
    assert sorted(k for k, _, _ in kept if k is not None) == sorted({c for c in want if c is not None})
    assert sum(k is None for k, _, _ in kept) == 1 and all(o == "own" for _, _, o in kept)


def test_families_in_shared_bands(spark, monkeypatch):
    """Texts of 8 families that have much in common, ids interleaved: large bands hold several classes, and each is found whole."""
    monkeypatch.setattr(near_dup, "BLOCK", 60_000)
    rng = random.Random(11)
    shared = [f"s{rng.randrange(10**6)}" for _ in range(160)]
    families = [shared + [f"f{rng.randrange(10**6)}" for _ in range(90)] for _ in range(8)]
    docs = []
    for i in range(160):
        words = list(families[i % 8])
        words[rng.randrange(250)] = f"x{i}"
        docs.append((i, " ".join(words)))
    want = plain_classes(docs)
    got = {r["doc"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[k] for k, _ in docs] == want
    assert len(set(want)) < 30


@pytest.mark.parametrize(("heavy", "range_"), [(1 << 20, 1 << 21), (1 << 20, 300), (64, 300)])
def test_document_frequencies_are_exact(spark, sf, monkeypatch, heavy, range_):
    monkeypatch.setattr(near_dup, "HEAVY", heavy)
    monkeypatch.setattr(near_dup, "RANGE", range_)
    monkeypatch.setattr(near_dup, "FLUSH", 1500)
    docs = [t for _, t in texts(spark, sf)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    rarity = near_dup.document_frequencies(near_dup.shingled(near_dup.renamed(df, "doc_id", "text")))
    exact = Counter(h for t in docs for h in near_dup.shingles(t)[0].tolist())
    floor = max(2, -(-sum(exact.values()) // heavy))
    hashes = np.array(sorted(exact), np.uint64)
    assert rarity.n == len(docs) and len(rarity.keys) <= heavy
    assert rarity.frequencies(hashes).tolist() == [c if c >= floor else floor - 1 for _, c in sorted(exact.items())]


def test_rare_shingles_weigh_alike_in_corpora_of_any_size(spark, monkeypatch):
    """Rare shingles weigh by their own document frequencies, too, where these don't fit the table that goes to the tasks."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(40)]
    docs = [" ".join([*rng.sample(common, 3), *[f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 60))], *common[:8]]) for _ in range(120)] + ["", None, "one two"]
    docs += [f"{docs[i]} more" for i in range(30)] + docs[:9]
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    told = lambda: sorted(
        [(r["id"] is None, r["id"], r["h1"], *[bytes(r[c]) for c in ("shingles", "levels")], r["bands"], bytes(r["sig"] or b"")) for r in near_dup.weighed_texts(near_dup.renamed(df, "doc_id", "text")).collect()], key=str
    )
    table_ = told()
    for name, value in (("HEAVY", 64), ("RANGE", 300), ("PACK", 500), ("PACKED", 9)):
        monkeypatch.setattr(near_dup, name, value)
    assert told() == table_
    exact = {text_hash(t or ""): sorted(w.values()) for t, w in zip(docs, plain_weights(docs), strict=True)}
    for r in table_:
        assert np.allclose(np.sort(near_dup.WEIGHT[np.frombuffer(r[4], np.uint8)]), exact[r[2]])
    assert len(table_) == len(docs)


def test_weights_of_repeated_shingles_are_not_clipped(monkeypatch):
    rarity = near_dup.Rarity(np.empty(0, np.uint64), np.empty(0, np.int64), 32, 1, 1000)
    h = np.arange(120, dtype=np.uint64) * near_dup.PRIMES[0]
    sides = [np.r_[0:60, 60:90], np.r_[0:60, 90:120]]
    counts = np.r_[np.full(60, 100), np.ones(30)].astype(np.int64)
    idf = 1 + np.log(1001 / 2) / np.log(1002)
    weights = idf * (1 + np.log2(counts))
    stated = weights[:60].sum() / (2 * weights.sum() - weights[:60].sum())
    made = [tuple(x[np.argsort(h[i])] for x in (h[i], near_dup.WEIGHT[rarity.levels(h[i], counts)])) for i in sides]
    assert stated > 0.85 and abs(near_dup.similarity(*made) - stated) < 0.02
    assert rarity.levels(h[:1], np.array([2**31 - 1]))[0] < near_dup.LEVELS
    rng = np.random.default_rng(1)
    j, slot, turn = rng.integers(0, 12, 3000), rng.integers(0, near_dup.SLOTS, 3000), rng.integers(0, near_dup.HASHES, 3000)
    plain = near_dup.least_samples(j, slot, turn)
    monkeypatch.setattr(near_dup, "TABLED", 12)
    near_dup._samples.cache_clear()
    try:
        assert (near_dup.least_samples(j, slot, turn) == plain).all()
    finally:
        near_dup._samples.cache_clear()


@pytest.mark.parametrize(("least", "most", "wanted"), [(0.8, 0.82, 1.0), (0.85, 0.9, 1.0), (0.45, 0.55, 0.0)])
def test_candidates_by_similarity(least, most, wanted):
    """Pairs of weights of many kinds: those of the threshold's similarity are candidates, but for one in 300, and agreement follows the similarity."""
    rarity = near_dup.Rarity(np.empty(0, np.uint64), np.empty(0, np.int64), 32, 1, 1000)
    rng = np.random.default_rng(7)
    found = seen = agreed = alike = 0
    while seen < 300:
        n = int(rng.integers(20, 400))
        share = int(n * rng.uniform(0.5, 0.99))
        h = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        sets = [np.r_[h[:share], h[share:n]], np.r_[h[:share], h[n : 2 * n - share]]]
        counts = 2 ** rng.integers(0, 4, 2 * n)
        levels = [rarity.levels(x, counts[np.r_[0:share, b : b + n - share]]) for x, b in zip(sets, (share, n), strict=True)]
        order = [np.argsort(x) for x in sets]
        s = near_dup.similarity(*[(x[o], near_dup.WEIGHT[j[o]]) for x, j, o in zip(sets, levels, order, strict=True)])
        if least <= s <= most:
            seen += 1
            (b1, s1), (b2, s2) = (near_dup.signature(x, j) for x, j in zip(sets, levels, strict=True))
            same = (np.frombuffer(s1, np.uint8) == np.frombuffer(s2, np.uint8)).sum()
            found += bool((b1 == b2).any()) and same >= near_dup.AGREE
            agreed, alike = agreed + same, alike + s * near_dup.HASHES
    assert abs(agreed / alike - 1) < 0.03
    assert found >= seen - 1 if wanted else found < 0.1 * seen
