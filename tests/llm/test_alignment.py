"""Token alignment against a plain version: loops over bytes, tokens by the libraries that the contract names."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from drowse.llm import alignment


def decoder():
    """Bytes of the byte-level characters."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(extra)}


def plain(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = decoder()
    bytes_a = lambda i: bytes(own[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, counts = [], Counter()
    for key, text in rows:
        told, links, n_a, n_b, groups = "", [], 0, 0, []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if b"".join(map(bytes_a, ids_a)) == b"".join(map(bytes_b, ids_b)) == (" " + text).encode():
                n_a, n_b = len(ids_a), len(ids_b)
                spans = []
                for ids, of in ((ids_a, bytes_a), (ids_b, bytes_b)):
                    at, mine = 0, []
                    for i in ids:
                        mine.append((at, at + len(of(i)), i))
                        at = mine[-1][1]
                    spans.append(mine)
                shared = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
                low = 0
                for cut in shared:
                    groups.append("|".join(",".join(str(i) for s, e, i in mine if low <= s and e <= cut) for mine in spans) if n_a < 300 else None)
                    low = cut
                j = 0
                for s, e, i in spans[0]:
                    while spans[1][j][1] <= s:
                        j += 1
                    k = j
                    while k < n_b and spans[1][k][0] < e:
                        links.append((i, spans[1][k][2]))
                        k += 1
                told = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a < 300 else None
        counts.update(links)
        out.append((key, n_a, n_b, len(groups), links, told))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(k, x, y, g, len(p), sum(counts[i] == best[i[1]] for i in p), sum(counts[i] for i in p), t) for k, x, y, g, p, t in out]


def same(got, want):
    got = [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got]
    key = lambda r: str(r[:7])
    assert len(got) == len(want)
    for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert x[:7] == y[:7]
        assert y[7] is None or x[7] == y[7]
    return True


def test_query_against_plain(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert same(alignment.op13_token_alignment(spark, sf).collect(), plain(rows))


ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "naïve café ﬁ 日本語 🙂‍"), (2**53 + 1, "has ▁ inside"), (4, "<s> <|endoftext|> </s> <0x0A>"), (5, "  two  spaces\n\n\tand tabs  "), (6, "\x00\x01 control"), (7, "word " * 3000), (-(2**63), "x" * 2000)]


@pytest.mark.parametrize("top", [1 << 20, 40, 0])
def test_odd_texts(spark, monkeypatch, top):
    """Nulls, empty and long texts, other scripts, texts that do not come back; with all, few and no pairs broadcast."""
    monkeypatch.setattr(alignment, "TOP", top)
    df = spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, row string").repartition(3)
    got = alignment.align_corpus(df).collect()
    assert same(got, plain(ODD))
    lost = {r["doc_id"]: r for r in got}[2**53 + 1]
    assert (lost["n_a"], lost["n_links"], lost["groups_sha256"]) == (0, 0, "")
    assert alignment.align_corpus(df.limit(0)).count() == 0


def test_runs_do_not_matter():
    """One run of many documents gives what runs of one give."""
    a, b = alignment.vocabularies()
    texts = [t for _, t in ODD]
    whole = alignment.align_texts(texts, a, b)
    for i, t in enumerate(texts):
        one = alignment.align_texts([t], a, b)
        assert [x[i].as_py() for x in (whole.n_a, whole.n_b, whole.n_groups, whole.told, whole.links)] == [x[0].as_py() for x in (one.n_a, one.n_b, one.n_groups, one.told, one.links)]
