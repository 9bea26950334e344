"""Alignment of two tokenizers' tokens, in Arrow columns.

Documents go through a task in runs of about RUN characters. A run's token ids are two list arrays. Flattening them, with parent indices, and
cumulative sums of token bytes, taken again from 0 at each document, give every token's end; (document, end) is a key, and a hash join of
A's keys with B's finds the places where both end: these cut the groups. Between neighbouring ends of either kind lies exactly one A and one
B token, so a document's links are its distinct ends, and cumulative sums of "an A token ended here" name the two tokens of each. A run's
id pairs are counted by `group_by`; Spark sums these partial counts.

Links are written once, with their digests, to the shared folder. A second pass over them sums each document's counts. Counts of the most
frequent pairs, TOP at most, are broadcast; links of other pairs leave as rows and meet their counts in a join, so no table but a
bounded one is held in a task, and only rare links are shuffled. A B id's highest count is that of its most frequent A id: a table of the
vocabulary's size.

A null or empty text, and one whose tokens' bytes are not " " + text in both vocabularies (U+2581 inside, for one), has zeros and an empty
digest. A very long text is a run of its own: memory follows it. Rows are told apart by their place in the written table, so repeated rows and
equal or null ids each keep their own sums; equal texts give equal rows. Ids pass as Arrow, unchanged; other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, slices, table

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a run, documents that a pass looks at together, and pairs whose counts are broadcast at most.
RUN, TOP = 1 << 18, 1 << 20
#: Places of a document's number in a key, and of an A id in a pair.
WIDE = 32
#: How links are stored: a pair as its number in a dictionary of up to a million, compressed, in row groups that a writer holds whole.
STORED = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20), "parquet.block.size": str(16 << 20)}


@dataclass
class Vocabulary:
    """`encode` of many texts, and the bytes of each id as they stand in " " + text."""

    encode: object
    token: pa.Array
    size: pa.Array


def _vocabulary(encode: object, tokens: list[bytes]) -> Vocabulary:
    token = pa.array(tokens, pa.large_binary())
    return Vocabulary(encode, token, pc.cast(pc.binary_length(token), pa.int64()))


@lru_cache(maxsize=2)
def vocabularies(a: str = A_NAME, b: str = B_NAME) -> tuple[Vocabulary, Vocabulary]:
    """The byte-level vocabulary through its ranks in `tiktoken`, which gives the ids of `tokenizers`; and the pieces, with U+2581 for a space."""
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(public_tokenizers.path(a.replace(".json", ".tiktoken")), "rb") as f:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
    own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    special = [pieces.is_control(i) or pieces.is_unknown(i) for i in range(len(names))]
    raw = [b"" if s else bytes([int(n[3:5], 16)]) if pieces.is_byte(i) else n.replace("▁", " ").encode() for i, (n, s) in enumerate(zip(names, special, strict=True))]
    encode_a = lambda texts: [own.encode_ordinary(" " + t) for t in texts]
    return _vocabulary(encode_a, tokens), _vocabulary(lambda texts: pieces.encode(texts, num_threads=1), raw)


def lists(ids: list[list[int]]) -> pa.ListArray:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((i for own in ids for i in own), np.int64, int(sizes.sum()))
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(flat))


def spelled(ids: pa.LargeListArray, words: Vocabulary) -> pa.Array:
    """The joined bytes of each list."""
    each = pc.take(words.token, ids.flatten())
    return pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets, each), pa.scalar(b"", pa.large_binary()))


def ends(ids: pa.LargeListArray, words: Vocabulary) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Ids, parents and keys (parent, end) of all tokens: a cumulative sum of bytes, less what it was where the parent begins."""
    flat, parent = pc.list_flatten(ids), pc.cast(pc.list_parent_indices(ids), pa.int64())
    total = pc.cumulative_sum(pc.take(words.size, flat))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), total]), ids.offsets.slice(0, len(ids)))
    end = pc.subtract(total, pc.take(before, parent))
    return flat, parent, pc.add(pc.shift_left(parent, pa.scalar(WIDE, pa.int64())), end)


def _joined(items: pa.Array, cuts: pa.Array, mark: str) -> pa.Array:
    """Strings of runs of `items`, joined by a mark; each run ends where `cuts` holds."""
    at = pc.add(pc.cast(pc.indices_nonzero(cuts), pa.int64()), 1)
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int64()), at]), items), pa.scalar(mark, pa.large_string()))


@dataclass
class Aligned:
    """Of a run's documents: numbers of tokens, groups and links, the groups told, and the links' pairs as lists."""

    n_a: pa.Array
    n_b: pa.Array
    n_groups: pa.Array
    told: pa.Array
    links: pa.LargeListArray


def _per_document(parent: pa.Array, n: int) -> pa.Array:
    return pa.array(np.bincount(parent.to_numpy(), minlength=n).astype(np.int64))


def align(a: pa.LargeListArray, b: pa.LargeListArray, words_a: Vocabulary, words_b: Vocabulary) -> Aligned:
    """Both lists of a document must spell the same bytes."""
    n = len(a)
    id_a, parent_a, key_a = ends(a, words_a)
    id_b, parent_b, key_b = ends(b, words_b)
    left = pa.table({"key": key_a, "a": pa.array(np.arange(len(key_a)))})
    right = pa.table({"key": key_b, "b": pa.array(np.arange(len(key_b)))})
    both = left.join(right, "key", join_type="inner", use_threads=False)
    cut_a, cut_b = np.zeros(len(key_a), bool), np.zeros(len(key_b), bool)
    cut_a[both["a"].to_numpy()], cut_b[both["b"].to_numpy()] = True, True
    text = lambda ids: pc.cast(ids, pa.large_string())
    group = pc.binary_join_element_wise(_joined(text(id_a), pa.array(cut_a), ","), _joined(text(id_b), pa.array(cut_b), ","), pa.scalar("|", pa.large_string()))
    n_groups = _per_document(pc.filter(parent_a, pa.array(cut_a)), n)
    first = lambda sizes: pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes)])
    told = pc.binary_join(pa.LargeListArray.from_arrays(first(n_groups), group), pa.scalar(";", pa.large_string()))
    # one link for each distinct end: A's ends, and B's that A does not share
    alone = pc.filter(key_b, pa.array(~cut_b))
    key, is_a = pa.concat_arrays([key_a, alone]), np.concatenate([np.ones(len(key_a), np.int64), np.zeros(len(alone), np.int64)])
    is_b = np.concatenate([cut_a.astype(np.int64), np.ones(len(alone), np.int64)])
    order = np.argsort(key.to_numpy(), kind="stable")  # two sorted runs: a merge
    ended = lambda flags: pc.subtract(pc.cumulative_sum(pa.array(flags)), pa.array(flags))
    link_a, link_b = pc.take(id_a, ended(is_a[order])), pc.take(id_b, ended(is_b[order]))
    pair = pc.add(pc.shift_left(link_b, pa.scalar(WIDE, pa.int64())), link_a)
    parent = pc.shift_right(pc.take(key, pa.array(order)), pa.scalar(WIDE, pa.int64()))
    links = pa.LargeListArray.from_arrays(first(_per_document(parent, n)), pair)
    return Aligned(_per_document(parent_a, n), _per_document(parent_b, n), n_groups, told, links)


def align_texts(texts: list[str | None], a: Vocabulary, b: Vocabulary) -> Aligned:
    """Texts whose tokens do not spell " " + text count as without tokens."""
    known = [t or "" for t in texts]
    ids = lists(a.encode(known)), lists(b.encode(known))
    want = pa.array([(" " + t).encode() if t else b"\0" for t in known], pa.large_binary())
    good = pc.and_(pc.equal(spelled(ids[0], a), want), pc.equal(spelled(ids[1], b), want))
    good = pc.and_(good, pa.array([bool(t) for t in known]))
    if not pc.all(good, min_count=0).as_py():
        empty = pa.array([[]] * len(known), pa.large_list(pa.int64()))
        ids = tuple(_lists_again(pc.if_else(good, x, empty)) for x in ids)
    return align(*ids, a, b)


def _lists_again(x: pa.Array) -> pa.LargeListArray:
    """The same lists, offsets from 0 over their own values."""
    sizes = pc.fill_null(pc.cast(pc.list_value_length(x), pa.int64()), 0)
    return pa.LargeListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes)]), pc.list_flatten(x))


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= RUN or i + 1 == len(texts):
            yield start, i + 1
            start, size = i + 1, 0


COLUMNS = {"row": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "links": "array<long>", "pairs": "array<long>", "counts": "array<long>"}


def alignments(docs: DataFrame, text: str = "text", key: str = "doc_id", names: tuple[str, str] = (A_NAME, B_NAME)) -> DataFrame:
    """k (the key), row (a number of its own), counts of tokens, groups and links, the digest, and links as pairs (B id * 2 ** WIDE + A id). The
    first row of a run holds the run's distinct pairs and how often each occurs, too."""
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = vocabularies(*names)
        row = TaskContext.get().partitionId() << WIDE
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            for start, end in _runs(texts):
                n, got = end - start, align_texts(texts[start:end], a, b)
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in got.told.to_pylist()]
                n_links = pc.cast(pc.list_value_length(got.links), pa.int64())
                counted = pa.table({"pair": got.links.flatten()}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
                own_counts = [pa.array([counted[c].to_pylist(), *[None] * (n - 1)], pa.list_(pa.int64())) for c in ("pair", "count_all")]
                links = pc.cast(got.links, pa.list_(pa.int64()))
                columns = [batch.column(0).slice(start, n), pa.array(np.arange(row, row + n)), got.n_a, got.n_b, got.n_groups, n_links, pa.array(digests, pa.string()), links, *own_counts]
                yield pa.RecordBatch.from_arrays(columns, ["k", *COLUMNS])
                row += n

    return own.mapInArrow(run, f"k {dict(own.dtypes)['k']}, " + ", ".join(f"{n} {t}" for n, t in COLUMNS.items()))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (links that hold it, of all documents), and best: whether no pair of the same B id has a higher count."""
    each = aligned.where(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    counts = materialize(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("count")), "pair-counts")
    highest = counts.groupBy(F.shiftright("pair", WIDE).alias("b")).agg(F.max("count").alias("highest"))
    joined = counts.withColumn("b", F.shiftright("pair", WIDE)).join(F.broadcast(highest), "b")  # one row for each id of B's vocabulary
    return materialize(joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "pair-bests")


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs above the lowest level of counts that leaves TOP of them at most, sorted; levels are eighths of powers of two."""
    level = F.floor(8 * F.log2("count")).cast("int")
    levels = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # at most 8 * 63 rows
    total, least = 0, None
    for r in levels:
        total += r["count"]
        if total > TOP:
            break
        least = r["level"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    rows = counts.where(level >= least).toArrow().sort_by("pair")  # TOP rows at most
    return rows["pair"].to_numpy(), rows["count"].to_numpy(), rows["best"].to_numpy()


def _by_links(batches: Iterator[pa.RecordBatch], most: int = RUN // 2) -> Iterator[pa.RecordBatch]:
    """Slices with `most` links at most, in the last column, or one row."""
    for b in batches:
        offsets, start = b.column(b.num_columns - 1).offsets.to_numpy(), 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
            yield b.slice(start, end - start)
            start = end


def _sums(aligned: DataFrame, frequent: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """n_best and count_sum over the links of frequent pairs, and `rare`: the other links' pairs."""
    held = aligned.sparkSession.sparkContext.broadcast(frequent)
    own = aligned.select("k", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    names = [*own.columns[:-1], "n_best", "count_sum", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = held.value
        for b in _by_links(batches):
            links = b.column(b.num_columns - 1)
            offsets = links.offsets.to_numpy() - links.offsets[0].as_py()
            flat = pc.list_flatten(links)
            coded = pc.dictionary_encode(flat)  # a look-up for each distinct pair of the batch
            pairs, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            there = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = []
            for x in (best, count):
                each = np.where(there, x[at], 0).astype(np.int64)[code] if len(known) else np.zeros(len(code), np.int64)
                sums.append(np.diff(np.concatenate([[0], np.cumsum(each)])[offsets]))
            lost = ~there[code]
            sizes = np.diff(np.concatenate([[0], np.cumsum(lost)])[offsets])
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pc.filter(flat, pa.array(lost)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sums[0]), pa.array(sums[1]), rare], names)

    schema = ", ".join(f"{n} {t}" for n, t in own.dtypes[:-1]) + ", n_best long, count_sum long, rare array<long>"
    return own.mapInArrow(run, schema)


def align_corpus(docs: DataFrame, text: str = "text", key: str = "doc_id", names: tuple[str, str] = (A_NAME, B_NAME)) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each document."""
    aligned = materialize(alignments(docs, text, key, names), "alignments", **STORED)
    counts = pair_counts(aligned)
    summed = materialize(_sums(aligned, _frequent(counts)), "alignment-sums")
    discard(aligned)
    rare = summed.where(F.size("rare") > 0).select("row", F.explode("rare").alias("pair"))
    rare = rare.groupBy("pair", "row").agg(F.count(F.lit(1)).alias("n")).join(counts, "pair")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_count"))
    out = summed.join(rare, "row", "left")
    with_rare = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return out.select(F.col("k").alias(key), "n_a", "n_b", "n_groups", "n_links", with_rare("n_best", "more_best"), with_rare("count_sum", "more_count"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_corpus(table(spark, sf_dir, "documents"))
