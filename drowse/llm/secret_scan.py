"""Secret scan: three fixed patterns, and two character Markov models compared by log-likelihood ratio.

The models are first-order chains over the characters of tokens: one of random strings, one of ordinary identifiers. Labelled
samples train them: random strings are digests in three alphabets, ordinary ones are words and compound identifiers of a bounded
sample of documents, without what the fixed patterns find there. A token of LEAST characters or more is a span of kind `markov` if
its transitions' log-likelihood ratio sums to EVIDENCE or more, unless it overlaps a span of the fixed patterns. The sum is the
odds for random against ordinary, so a longer token needs less of each character; no rule on digits or letters stands beside it.

A null or empty text has no spans and the digest of the empty string; an empty table gives an empty result. A text is scanned whole,
in one pass for each pattern, whatever its length. Equal texts give equal spans, spans that start together are in the order of KINDS.
Repeated rows give repeated rows; other columns are ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

#: Bounds of the training sample: documents (smallest hash first), and random strings of each alphabet.
SAMPLE_DOCS, SAMPLE_RANDOM = 500, 2000
#: Documents whose hash is low enough to be looked at, for each one that is taken.
SPARE = 8
#: A token of LEAST characters is reported at this log-likelihood ratio, in nats, or more: odds of about nine million to one, as
#: ordinary tokens are that much more frequent.
LEAST, EVIDENCE = 16, 16.0
KINDS = ("assign", "access", "hex", "markov")

# The patterns
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", re.IGNORECASE | re.ASCII)
VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
WORD = re.compile(r"[A-Za-z]{3,}")
KEYWORDS = ("passw", "secret", "token", "api")
ALPHABET = 65


def _codes() -> np.ndarray:
    out = np.full(128, ALPHABET - 1, dtype=np.uint8)
    for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
        out[ord(c)] = i
    return out


CODES = _codes()


def _chain(samples: list[str]) -> np.ndarray:
    """Log probabilities of transitions, with one added count."""
    counts = np.ones((ALPHABET, ALPHABET))
    for s in samples:
        c = CODES[np.frombuffer(s.encode("ascii"), np.uint8)]
        np.add.at(counts, (c[:-1], c[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def random_strings(n: int) -> list[str]:
    """n each in hexadecimal, base64 and letters with digits, from digests of counters: the same at every run."""
    out = []
    for i in range(n):
        d = hashlib.sha256(f"sample {i}".encode()).digest()
        b = base64.b64encode(d).decode().rstrip("=")
        out += [d.hex()[:40], b, re.sub(r"[+/]", "", b)]
    return out


def identifiers(texts: list[str]) -> list[str]:
    """Words, and pairs of words in camel case, snake case and with a number behind."""
    out = []
    for t in texts:
        words = WORD.findall(t)
        out += words
        for a, b in zip(words[::2], words[1::2], strict=False):
            out += [a + b.capitalize(), f"{a}_{b}", f"{a}-{b}", f"{a}/{b}"]
        out += [f"{w}{i % 100}" for i, w in enumerate(words[:50])]
    return out


def train_ratio(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio of each transition. The sample is SAMPLE_DOCS different texts of at most 20,000 characters, smallest hash first: ids
    have no part in it. A bound on the hash, from the number of documents, leaves about SPARE times as many, so that a task sends few
    texts however many tasks there are; where nearly all documents are longer, or copies, the sample is smaller. Without any word in
    it ordinary strings count as any characters, and a warning says so."""
    low = min(2**63 - 1, -(2**63) + 2**64 * SPARE * SAMPLE_DOCS // max(1, docs.count()))
    own = docs.select(F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t")).where((F.col("h") <= low) & (F.length("t") <= 20_000))
    once = own.groupBy("h").agg(F.min("t").alias("t"))
    sample = [without(r["t"], base_spans(r["t"])) for r in once.orderBy("h").limit(SAMPLE_DOCS).collect()]
    ordinary = identifiers(sample)
    if not ordinary:
        warnings.warn("no word to train ordinary identifiers on", stacklevel=2)
    return _chain(random_strings(SAMPLE_RANDOM)) - _chain(ordinary)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """What the fixed patterns find, leftmost and without overlaps within a kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        at = 0
        while m := ASSIGN.search(text, at):
            v = VALUE.match(text, m.end())
            at = v.end() if v else m.start() + 1
            if v and v.end() - v.start() >= 6:
                found.append((m.start(), v.end(), "assign"))
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def without(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, z, _ in sorted(found):
        out.append(text[at:a])
        at = max(at, z)
    return " ".join([*out, text[at:]])


def evidence(token: str, ratio: np.ndarray) -> float:
    """Log-likelihood ratio of random against ordinary."""
    c = CODES[np.frombuffer(token.encode("ascii"), np.uint8)]
    return float(ratio[c[:-1], c[1:]].sum())


def spans(text: str, ratio: np.ndarray) -> list[tuple[int, int, str]]:
    found = base_spans(text)
    taken, i = sorted(found), 0
    reach = np.maximum.accumulate([z for _, z, _ in taken]) if taken else []  # ends so far: spans of two kinds may nest
    for m in TOKEN.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            i += 1
        if (i == 0 or reach[i - 1] <= m.start()) and evidence(m.group(), ratio) >= EVIDENCE:
            found.append((m.start(), m.end(), "markov"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", ratio: np.ndarray | None = None) -> DataFrame:
    """key, and spans: array of (start, end, kind), in order."""
    model = train_ratio(docs, text) if ratio is None else ratio

    def run(texts: list[str | None]) -> tuple[None, list[pa.Array]]:
        found = [[{"start": a, "end": z, "kind": k} for a, z, k in spans(t or "", model)] for t in texts]
        return None, [pa.array(found, kind)]

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    return map_texts(docs, key, text, lambda: run, {"spans": "array<struct<start: long, end: long, kind: string>>"})


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


# The patterns in SQL would need the models as well; the query is tested against a brute-force version.
