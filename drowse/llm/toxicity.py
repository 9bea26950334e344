"""Toxicity by a support vector machine over a gapped-subsequence string kernel, with Nystroem landmarks, trained on labelled sentences.

Kernel: two words are alike by the subsequences of ORDER characters they share (the word's ends count as characters), each
weighted by DECAY for every character skipped, up to GAP skipped in all, and divided by the norm of a word of that length. An
insult with an inserted or a missing character keeps most of its subsequences. Words are also alike by the beginnings they share, letters from
the first on, and by being the same: a stem of common syllables has no subsequence of its own. A sentence's features are the sum of its words'.
Spelling is folded first: case, accents and marks, digits that stand for letters, and single letters with spaces between; letters
beyond a to z fall into a few classes by their code.

Training, on a bounded sample of labelled documents, as multiple-instance learning: each sentence of a clean document is clean, and of a toxic
document one to WORST sentences are witnesses, which the machine itself picks. It begins with what the words' beginnings tell, by the
documents of each class that have them, so that a language with few toxic documents has its own witnesses; then the sentences of a toxic document with the highest words are its witnesses. Witnesses, each also with a character inserted in
its highest word, against sentences of clean documents, those with the highest words among them, train the next machine, until the
witnesses stay the same or ROUNDS are over. Kernel values with LANDMARKS words (of witnesses and of clean sentences) make the Nystroem
features of a linear support vector machine with squared hinge loss. As the kernel is a product of explicit sparse features, the machine
folds into one table of weights, and scoring a text costs a few look-ups per character whatever the number of landmarks.

A document scores by its WORST highest words, by what the beginnings of as many tell, and by its length, through a logistic curve fitted on the sample and
moved to the labels' odds, as the sample takes as many of the rarer class. A null or empty text, and one without
letters, scores as a text without any toxic word. A very long text is scored whole, in memory that follows its length. Without labels of
both classes each score is 0. Equal texts score alike, and repeated rows give repeated rows; language, source, id and other columns are never
inputs of a score. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, slices, table

#: Bounds of the training sample: documents of each class (smallest hash first), and the length of a training text.
SAMPLE, SAMPLE_CHARS = 1500, 8_000
ORDER, GAP, DECAY = 4, 2, 0.6
LANDMARKS, NEGATIVES, ROUNDS, RIDGE = 160, 2400, 5, 1e-3
SIDE = 32  # word end, 26 letters, classes of other letters
SPANS = [(a, b, d) for d in range(ORDER - 1, ORDER + GAP) for a, b in itertools.combinations(range(1, d), 2)]
WORST = 3  # words that a document's score looks at
CHUNK = 1 << 18
#: A word's beginnings of SHORTEST to LONGEST letters, and the whole word, are features too, of weight BEGUN each; at so many toxic documents a share is half its own.
SHORTEST, LONGEST, BEGUN, PRIOR, TELLING = 3, 16, 0.4, 3.0, 1.5


def _fold_table() -> np.ndarray:
    """0: space, 255: dropped, 1-26: letter, 27-31: another letter, by its code. By Unicode category, for the first 2 ** 16 codes."""
    out = np.full(1 << 16, 255, np.uint8)
    for i in range(1 << 16):
        kind = unicodedata.category(chr(i))
        base = unicodedata.normalize("NFKD", chr(i))[0].lower()
        if chr(i).isspace() or kind in ("Zs", "Zl", "Zp", "Pd") and i > 127:
            out[i] = 0
        elif "a" <= base <= "z":
            out[i] = ord(base) - 96
        elif kind[0] == "L":
            out[i] = 27 + i % 5
    for digit, letter in zip("013457@", "oieasta", strict=True):
        out[ord(digit)] = ord(letter) - 96
    return out


FOLD = _fold_table()
ENDS = np.array([ord(x) for x in ".!?"])


def _norms(longest: int = 512) -> np.ndarray:
    """Root of the squared weights of all subsequences of a word, by its length with both ends; longer words are extrapolated."""
    n = np.arange(longest)
    return np.sqrt(np.maximum(sum(DECAY ** (2 * (d - ORDER + 1)) * np.maximum(0, n - d) for _, _, d in SPANS), 1e-9)).astype(np.float32)


NORMS = _norms()


def fold(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, a 0 before each word; places of those zeros; text and sentence of each word. A sentence ends at a line's
    end, and at a full stop, question or exclamation mark with a space behind."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n\n".join(["", *low, ""]).encode("utf-32-le"), "<u4")
    c = np.where(codes < len(FOLD), FOLD[np.minimum(codes, len(FOLD) - 1)], np.uint8(27) + (codes % 5).astype(np.uint8)).astype(np.uint8)
    ends = np.flatnonzero((codes == 10) | (np.isin(codes, ENDS) & np.append(c[1:] == 0, True)))
    kept = np.flatnonzero(c != 255)
    c = c[kept]
    gap = np.flatnonzero(c == 0)
    gap = gap[(gap >= 2) & (gap < len(c) - 2)]
    lone = gap[(c[gap - 1] > 0) & (c[gap - 2] == 0) & (c[gap + 1] > 0) & (c[gap + 2] == 0)]
    if len(lone):
        stay = np.ones(len(c), bool)
        stay[lone] = False
        c, kept = c[stay], kept[stay]
    starts = np.flatnonzero((c[:-1] == 0) & (c[1:] > 0))
    begins = np.cumsum([2, *[len(t) + 2 for t in low]])
    at = kept[starts + 1]
    return c, starts, np.searchsorted(begins, at, side="right") - 1, np.searchsorted(ends, at)


def _subsequences(c: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Feature numbers of the subsequences from each place, by pattern of skipped characters; 0 where the word has ended. The
    zeros on both sides of a word count as its characters."""
    n = len(c)
    wide = np.concatenate([c, np.zeros(ORDER + GAP, np.uint8)]).astype(np.int32)
    shifted = [wide[:n], wide[1 : n + 1]]
    for d in range(2, ORDER + GAP):
        shifted.append(wide[d : n + d] * (shifted[-1] > 0))
    for a, b, d in SPANS:
        f = ((shifted[0] * SIDE + shifted[a]) * SIDE + shifted[b]) * SIDE + shifted[d]
        yield np.where(shifted[d - 1] > 0, f, 0), DECAY ** (d - ORDER + 1)


def word_scores(c: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sum of each word's subsequences over its norm."""
    if not len(starts):
        return np.empty(0, np.float32)
    each = np.zeros(len(c), np.float32)
    for a in range(0, len(c), CHUNK):
        part = c[a : a + CHUNK + ORDER + GAP]
        own = min(CHUNK, len(c) - a)
        for f, w in _subsequences(part):
            each[a : a + own] += np.float32(w) * weights[f[:own]]
    ends = np.append(starts[1:], len(c))
    letters = np.add.reduceat((c > 0).astype(np.int32), starts) + 2
    norm = np.where(letters < len(NORMS), NORMS[np.minimum(letters, len(NORMS) - 1)], NORMS[-1] * np.sqrt(letters / len(NORMS)))
    sums = np.add.reduceat(each, starts)
    out = np.where(ends > starts, sums / np.maximum(norm, 0.5), 0).astype(np.float32)
    if len(weights) > SIDE**ORDER:
        begun = weights[SIDE**ORDER :]
        for word, slot in _beginnings(c, starts):
            out[word] += np.float32(BEGUN) * begun[slot]
    return out


def _beginnings(c: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length, the words that have a beginning of so many letters with more behind, or that have ended there, and the feature numbers of these."""
    wide = np.concatenate([c, np.zeros(LONGEST + 2, np.uint8)])
    word, h = np.arange(len(starts)), np.zeros(len(starts), np.uint64)
    for n in range(1, LONGEST + 1):
        h = (h ^ wide[starts[word] + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        ended = wide[starts[word] + n + 1] == 0
        if n >= SHORTEST:
            yield word, ((h + ended) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)
        word, h = word[~ended], h[~ended]
        if not len(word):
            break


def features_of(word: bytes) -> np.ndarray:
    """Explicit features of a word, over its norm, as a table."""
    c = np.frombuffer(b"\0" + word + b"\0", np.uint8)
    out = np.zeros(SIDE**ORDER, np.float32)
    for f, w in _subsequences(c):
        np.add.at(out, f[f > 0], np.float32(w))
    return out / max(NORMS[min(len(word) + 2, len(NORMS) - 1)], 0.5)


def kernel_of(word: bytes) -> np.ndarray:
    """A word's two tables in one: its subsequences, then its beginnings (2 ** 20 hashed places)."""
    begun = np.zeros(1 << 20, np.float32)
    for _, slot in _beginnings(*_joined([word])):
        begun[slot] += np.float32(BEGUN)
    return np.concatenate([features_of(word), begun])


@dataclass
class Model:
    weights: np.ndarray  # of the folded machine, by subsequence and beginning
    told: np.ndarray  # what beginnings tell
    curve: np.ndarray  # of the logistic curve, by column of `_summary`, and its offset


def _svm(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset of a linear machine with squared hinge loss, classes balanced, by Newton steps."""
    z = np.hstack([z, np.ones((len(z), 1))])
    side = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    w = np.zeros(z.shape[1])
    for _ in range(30):
        active = y * (z @ w) < 1
        za, sa = z[active], side[active]
        new = np.linalg.solve((za * sa[:, None]).T @ za + RIDGE / 100 * np.eye(z.shape[1]), (za * sa[:, None]).T @ y[active])
        if np.allclose(new, w):
            break
        w = new
    return w


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    c = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
    return c, np.flatnonzero((c[:-1] == 0) & (c[1:] > 0))


@dataclass
class Sentences:
    """Distinct words of texts, the word numbers of all sentences in a row, where each sentence begins, and its text."""

    words: list[bytes]
    of: np.ndarray
    starts: np.ndarray
    text: np.ndarray

    def highest(self, values: np.ndarray) -> np.ndarray:
        """The highest of the words' values in each sentence."""
        return np.maximum.reduceat(values[self.of], self.starts)


def sentences_of(texts: list[str]) -> Sentences:
    c, starts, text, sentence = fold(texts)
    zeros, raw = np.append(np.flatnonzero(c == 0), len(c)), c.tobytes()
    ends = zeros[np.searchsorted(zeros, starts, side="right")]
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(raw[a + 1 : b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    new = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(of) else np.empty(0, np.int64)
    return Sentences(list(number), of, new, text[new])


def _told_by_beginnings(words: list[bytes], pairs: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much each word tells of toxic documents: the logit of their share, classes balanced, among documents that have its longest known
    beginning. A beginning of n letters starts from what the one of n - 1 says, and tells nothing new where it stands in the same documents.
    Also what each beginning adds to that, as a table, for words one of whose beginnings tells TELLING at least. pairs: distinct (word, document)."""
    size = np.array([min(len(w), LONGEST) for w in words])
    letters = np.zeros((len(words), LONGEST), np.uint8)
    for i, w in enumerate(words):
        letters[i, : size[i]] = np.frombuffer(w[:LONGEST], np.uint8)
    docs, scale = len(y), (y == 1).sum() / max(1, (y == 0).sum())
    node, value, counts = np.zeros(len(words), np.int64), np.full(len(words), 0.5), np.zeros((2, len(words)), np.int64)
    told = np.zeros((LONGEST + 1, len(words)), np.float32)
    for n in range(LONGEST):
        mine = np.flatnonzero(size > n)
        if not len(mine):
            break
        node[mine] = np.unique((node[mine] * SIDE + letters[mine, n]) * 2 + (size[mine] == n + 1), return_inverse=True)[1]
        own = pairs[:, size[pairs[0]] > n]
        met = np.unique(node[own[0]] * docs + own[1])
        new = np.stack([np.bincount((met // docs)[y[met % docs] == v], minlength=node[mine].max() + 1) for v in (0, 1)])[:, node[mine]]
        other = (new != counts[:, mine]).any(0)
        value[mine] = np.where(other, (new[1] + PRIOR * value[mine]) / (new[1] + scale * new[0] + PRIOR), value[mine])
        counts[:, mine] = new
        told[n + 1 :] = np.log(value / (1 - value))
    table_, telling = np.zeros(1 << 20, np.float32), np.flatnonzero(told[SHORTEST:].max(0) >= TELLING)
    if len(telling):
        told_ = told[SHORTEST - 1 :, telling]
        told_[0] = 0
        for i, (word, slot) in enumerate(_beginnings(*_joined([words[i] for i in telling]))):
            table_[slot] = told_[i + 1, word] - told_[i, word]
    return told[-1], table_


def _trained(s: Sentences, rows: np.ndarray, y: np.ndarray, swapped: list[tuple[int, int, bytes]], landmarks: list[bytes]) -> np.ndarray:
    """The machine's table of weights from sentences `rows`, through Nystroem features over landmark words. swapped: further rows, each the
    row of that number with one word (of that number) replaced by another."""
    ends = np.append(s.starts[1:], len(s.of))
    size = ends[rows] - s.starts[rows]
    at = s.of[np.repeat(s.starts[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    used, at = np.unique(at, return_inverse=True)
    row, old = np.array([r for r, _, _ in swapped], np.int64), np.searchsorted(used, [w for _, w, _ in swapped])
    c, starts = _joined([s.words[i] for i in used] + [w for _, _, w in swapped])
    y = np.concatenate([y, y[row]])
    lc, ls = _joined(landmarks)
    k, inner = np.empty((len(y), len(landmarks))), np.empty((len(landmarks), len(landmarks)))
    for i, w in enumerate(landmarks):  # one table at a time
        table_ = kernel_of(w)
        each, inner[:, i] = word_scores(c, starts, table_), word_scores(lc, ls, table_)
        whole = np.add.reduceat(each[at], np.cumsum(size) - size)
        k[:, i] = np.concatenate([whole, whole[row] - each[old] + each[len(used) :]])
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    beta = root @ _svm(k @ root, y)[:-1]
    out = np.zeros(SIDE**ORDER + (1 << 20), np.float32)
    for b, w in zip(beta, landmarks, strict=True):
        out += np.float32(b) * kernel_of(w)
    return out


def fit(texts: list[str], labels: list[int], odds: float | None = None) -> Model:
    """odds: of label 1 where the texts were drawn from, by class; None: as in `labels`."""
    y = np.array(labels)
    s = sentences_of(texts)
    toxic = y[s.text] == 1 if len(s.starts) else np.empty(0, bool)
    if not toxic.any() or toxic.all():
        return Model(np.zeros(SIDE**ORDER, np.float32), np.zeros(1 << 20, np.float32), np.array([0.0] * (2 * WORST + 1) + [-40.0]))
    c, starts = _joined(s.words)
    # means over documents that have a word, so that a copied or long document counts no more than once for it
    long = np.repeat(np.arange(len(s.starts)), np.diff(np.append(s.starts, len(s.of))))
    pairs = np.unique(np.stack([s.of, s.text[long]]), axis=1)
    word, told = _told_by_beginnings(s.words, pairs, y)
    clean, bad = np.flatnonzero(~toxic), np.flatnonzero(toxic)
    clean_words = sorted({s.words[i] for i in s.of[~toxic[long]]}, key=hash_of)[: LANDMARKS // 2]
    order, witness = np.array(sorted(clean.tolist(), key=lambda i: hash_of(b" ".join(s.words[w] for w in s.of[s.starts[i] : s.starts[i] + 8])))), None
    for i in range(ROUNDS):
        word = word_scores(c, starts, weights) if i else word
        score = s.highest(word)
        best = bad[np.lexsort((-score[bad], s.text[bad]))]
        first = np.flatnonzero(np.r_[True, s.text[best][1:] != s.text[best][:-1]])
        size = np.diff(np.append(first, len(best)))
        place, most = np.arange(len(best)) - np.repeat(first, size), np.repeat(score[best[first]], size)
        new = np.sort(best[(place == 0) | (place < WORST) & (score[best] >= 0.25 * most)])
        if witness is not None and np.array_equal(new, witness):
            break
        witness = new
        counts = np.bincount(s.of[np.isin(long, witness)], minlength=len(s.words))
        names = np.argsort(-word * np.sqrt(counts), kind="stable")[: LANDMARKS // 2]
        landmarks = list(dict.fromkeys([s.words[i] for i in names if counts[i]] + clean_words))
        negative = np.unique(np.concatenate([order[: NEGATIVES // 2], clean[np.argsort(-score[clean], kind="stable")[: NEGATIVES // 2]]]))
        rows = np.concatenate([witness, negative])
        weights = _trained(s, rows, np.where(toxic[rows], 1.0, -1.0), list(_respelled(s, witness, word)), landmarks)
    curve = _logistic(_summary(texts, weights, told), y)
    curve[-1] += math.log(odds * (y == 0).sum() / (y == 1).sum()) if odds else 0
    return Model(weights, told, curve)


def _respelled(s: Sentences, witness: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Each witness again with a character inserted in its highest word, at a place and of a kind that the word's hash gives."""
    ends = np.append(s.starts[1:], len(s.of))
    for r, i in enumerate(witness.tolist()):
        own = s.of[s.starts[i] : ends[i]]
        best = int(own[word[own].argmax()])
        w = s.words[best]
        if len(w) > 3:
            at = 1 + hash_of(w) % (len(w) - 1)
            yield r, best, w[:at] + bytes([1 + hash_of(w) // 64 % 26]) + w[at:]


def hash_of(w: bytes) -> int:
    h = 2166136261
    for x in w:
        h = (h ^ x) * 16777619 & 0xFFFFFFFF
    return h


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset of the curve, with targets drawn in a little, by damped Newton steps."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(design.shape[1]), 1e-2
    for _ in range(100):
        p = _sigmoid(design @ w)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w)), design.T @ (t - p) - ridge * w)
        w = w + step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return w


def _summary(texts: list[str | None], weights: np.ndarray, told: np.ndarray) -> np.ndarray:
    """The WORST highest word scores of each text, none below 0, as many of what beginnings tell, none below TELLING, and the logarithm of its words."""
    c, starts, text, _ = fold(texts)
    n = np.bincount(text, minlength=len(texts))
    out = np.zeros((len(texts), 2 * WORST + 1))
    first = np.zeros(len(starts), np.float32)
    for word, slot in _beginnings(c, starts):
        first[word] += told[slot]
    for at, scores in ((0, word_scores(c, starts, weights)), (WORST, first * (first >= TELLING))):
        order = np.lexsort((-scores, text))
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        top = place < WORST
        out[text[top], at + place[top]] = np.maximum(scores[order][top], 0)
    out[:, -1] = np.log1p(n) / 4
    return out


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    """In runs of texts of about CHUNK characters, so that memory follows the longest text and not the batch."""
    out, a, size = np.empty(len(texts)), 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK or i + 1 == len(texts):
            out[a : i + 1] = _sigmoid(_summary(texts[a : i + 1], model.weights, model.told) @ model.curve[:-1] + model.curve[-1])
            a, size = i + 1, 0
    return out


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """From SAMPLE documents of each class at most, none of them held out."""
    own = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & ~F.coalesce(held_out("k"), F.lit(True)))
    n = {r["y"]: r["count"] for r in own.where("y IN (0, 1)").groupBy("y").count().collect()}
    picked = [own.where(F.col("y") == v).distinct().orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(SAMPLE) for v in (0, 1)]
    picked = picked[0].union(picked[1])
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t").between(1, SAMPLE_CHARS))
    once = texts.join(F.broadcast(picked), "k").groupBy("k", "y").agg(F.min("t").alias("t"))  # an id in many rows counts once: at most 2 * SAMPLE rows
    sample = once.toPandas().sort_values(["k", "y"])
    return fit(sample["t"].tolist(), sample["y"].tolist(), n.get(1, 0) / n.get(0, 1))


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, key, text, lambda: lambda texts: (None, [pa.array(score_texts(texts, held.value))]), {"score": "double"})


def keep_clean(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """Documents below `limit`, with all their columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(score_texts(b.column(text).to_pylist(), held.value) < limit))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
