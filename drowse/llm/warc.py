"""Web archives of pages, with revisit records, and a globally ordered index of their captures.

Records are written by Spark's text writer: a WARC record ends in two line breaks, which serve as its line separator, so the
files are plain WARC. Reading back follows Content-Length alone, so a payload may hold anything. Pages with equal payloads are
stored once: the smallest page_id is the response, the others are revisits that refer to it.

The index is an external merge. Each archive file is a capture run, sorted once, where it is read, by URL key, timestamp and page, and
written to the shared folder. Runs are cut at common range boundaries into blocks of BLOCK captures at most, and the blocks of a range
arrive at its task in the order in which a merge needs them: by the last capture of the block before. So a loser tree merges all runs of a
range as streams, with one block of each in memory, and no second sort. Ranges follow each other: (range, place) orders all captures.
Boundaries are taken over (URL key, timestamp, page) from a bounded sample, so a host or a URL with a third of all captures is many ranges.

A null html is an empty payload, a null url an empty one. Of rows with equal page_id and payload one is the response (that with the first
url), also of rows that are equal in all; the others revisit it. Rows without page_id come last; if no equal payload has a page with an id,
one of them is the response and refers_to is null. A very long page is a record of its own file of LARGE_FILE records. Equal rows give
equal captures but for that. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 0
#: Pages of up to SMALL bytes go so many to a file, larger ones LARGE_FILE: a file stays small enough to be read whole.
SMALL, SMALL_FILE, LARGE_FILE = 65_536, 1000, 4
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A page is dated by its id, in seconds after EPOCH, from the beginning again after SECONDS.
EPOCH, SECONDS = "2024-01-01 00:00:00", 100_000_000
#: Captures of a block, of a range about, and of the sample that range boundaries are taken from; boundaries at most.
BLOCK, RANGE, SAMPLE, RANGES = 128, 1 << 16, 20_000, 4096


def base32(hexadecimal: Column) -> Column:
    """Base 32 of 40 hexadecimal digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    five = lambda i: F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
    return F.concat(*[F.substring(letters, F.shiftright(five(i), s).bitwiseAND(31) + 1, F.lit(1)) for i in range(8) for s in (15, 10, 5, 0)])


def records(pages: DataFrame) -> DataFrame:
    """page_id, n (payload bytes) and record: the WARC record's text without its end."""
    own = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumns({"sha": F.sha1("html"), "n": F.octet_length("html").cast("long")})
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    groups = own.where(F.col("n") >= REVISIT_BYTES).groupBy("sha", "n").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size"))
    shared = materialize(groups.where("size > 1").select(F.col("sha").alias("s_sha"), F.col("n").alias("s_n"), "best"), "shared-payloads")
    own = own.join(shared, (F.col("sha") == F.col("s_sha")) & (F.col("n") == F.col("s_n")), "left").drop("s_sha", "s_n")
    own = own.withColumn("is_best", F.col("best").isNotNull() & order.eqNullSafe(F.col("best")))
    # rows that are equal in all: counted, and written as one response and revisits
    twins = own.where("is_best").groupBy("sha", "n").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("sha", "n")
    twins = materialize(twins, "equal-pages").withColumn("twin", F.lit(True))
    own = own.join(twins, ["sha", "n"], "left").withColumn("twin", F.coalesce("twin", F.lit(False)) & F.col("is_best"))
    once = own.where("twin").groupBy("sha", "n").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "html", "best", "is_best", "twin")], F.count(F.lit(1)).alias("size"))
    once = once.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size")))).drop("size")
    own = own.where("NOT twin").withColumn("again", F.lit(1).cast("long")).unionByName(once)
    revisit = F.col("best").isNotNull() & (~F.col("is_best") | (F.col("again") > 1))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SECONDS))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    more = F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("best.page_id")), F.lit("\r\n"))).otherwise("")
    kind = F.when(revisit, "revisit").otherwise("response")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit("\r\nWARC-Date: "), date, F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha")), F.lit("\r\n"), more, F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "))
    return own.select("page_id", "n", F.concat(head, F.octet_length(block).cast("string"), F.lit(END), block).alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    """WARC files under path/small and path/large."""
    rows = records(pages)
    for part, which, per in (("small", F.col("n") <= SMALL, SMALL_FILE), ("large", F.col("n") > SMALL, LARGE_FILE)):
        rows.where(which).select("record").write.option("lineSep", END).option("maxRecordsPerFile", per).text(f"{path}/{part}")


HEAD = re.compile(rb"^([A-Za-z-]+): ?(.*?)\r?$", re.M)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """Headers, offset and block of each record."""
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        head = {k.decode().lower(): v.decode() for k, v in HEAD.findall(data[at:body])}
        n = int(head["content-length"])
        yield head, at, data[body : body + n]
        at = body + n + 4


def url_key(url: str) -> str:
    """Host labels reversed, then path and query: com,example)/path?query. Scheme, port, fragment and leading www. go."""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def capture(head: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, ts; a response's payload must have its digest."""
    number = lambda x: None if x is None or x.endswith(":none>") else int(x[10:-1])
    at = block.index(b"\r\n\r\n") + 4
    payload, digest, kind = block[at:], head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
    size = int(dict(HEAD.findall(block[:at]))[b"Content-Length"])
    if kind == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest or len(payload) != size:
            raise ValueError(f"{head['warc-record-id']}: the payload read back differs")
    return number(head["warc-record-id"]), size, digest, kind, number(head.get("warc-refers-to")), url_key(head["warc-target-uri"]), head["warc-date"]


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts"]
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, ts string"
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
ROW = pa.struct(list(zip(COLUMNS, KINDS, strict=True)))
KEY = pa.struct([("url_key", pa.string()), ("ts", pa.string()), ("has_id", pa.bool_()), ("page_id", pa.int64())])


def order(row: tuple) -> tuple:
    return row[5], row[6], row[0] is not None, row[0] or 0


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """run and rows: the captures of each archive file, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = sorted((capture(h, block) for h, _, block in parse(data.as_py())), key=order)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]]), _listed([rows])], ["run", "rows"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", "content").mapInArrow(run, f"run string, rows array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>")


def _listed(blocks: list[list[tuple]]) -> pa.Array:
    return pa.array([[dict(zip(COLUMNS, r, strict=True)) for r in rows] for rows in blocks], pa.list_(ROW))


def _rows(listed: list[dict]) -> list[tuple]:
    return [tuple(r.values()) for r in listed]


def loser_tree(runs: Iterable[Iterable[tuple]]) -> Iterator[tuple]:
    """Merge of sorted runs: inner nodes hold the losers of their matches, so each row costs one path of matches to the root."""
    its = [iter(r) for r in runs]
    k = 1
    while k < max(1, len(its)):
        k *= 2
    its += [iter(())] * (k - len(its))
    heads = [next(i, None) for i in its]
    keys = [None if h is None else (order(h), i) for i, h in enumerate(heads)]
    beats = lambda a, b: keys[a] is not None and (keys[b] is None or keys[a] < keys[b])
    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (b, a) if beats(b, a) else (a, b)
    top = winners[1] if k > 1 else 0
    while heads[top] is not None:
        yield heads[top]
        heads[top] = next(its[top], None)
        keys[top] = None if heads[top] is None else (order(heads[top]), top)
        node = (top + k) // 2
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


def boundaries(runs: DataFrame) -> list[tuple]:
    """Keys at which ranges begin, from the captures with the smallest hashes."""
    keys = runs.select(F.explode("rows").alias("r")).select("r.url_key", "r.ts", "r.page_id")
    n = runs.agg(F.coalesce(F.sum(F.size("rows")), F.lit(0))).first()[0]
    ranges = min(RANGES, -(-n // RANGE))
    sample = keys.orderBy(F.xxhash64("url_key", "ts", "page_id"), "url_key", "ts", "page_id").limit(SAMPLE if ranges > 1 else 0).collect()
    cuts = sorted((r["url_key"], r["ts"], r["page_id"] is not None, r["page_id"] or 0) for r in sample)
    return sorted({cuts[i * len(cuts) // ranges] for i in range(1, ranges)}) if cuts else []


def blocks(runs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """range, run, after (the last key of the run's block before in that range), last (whether the run has no more there) and rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run, listed in zip(b.column("run").to_pylist(), b.column("rows"), strict=True):
                rows = _rows(listed.as_py())
                pieces: dict[int, list[tuple]] = {}
                for r in rows:
                    pieces.setdefault(bisect_right(cuts, order(r)), []).append(r)
                out = []
                for at, own in pieces.items():
                    for i in range(0, len(own), BLOCK):
                        after = None if i == 0 else dict(zip(("url_key", "ts", "has_id", "page_id"), order(own[i - 1]), strict=True))
                        out.append((at, run, after, i + BLOCK >= len(own), own[i : i + BLOCK]))
                columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate([pa.int32(), pa.string(), KEY, pa.bool_()])]
                yield pa.RecordBatch.from_arrays([*columns, _listed([o[4] for o in out])], ["range", "run", "after", "last", "rows"])

    return runs.mapInArrow(cut, f"range int, run string, after struct<url_key: string, ts: string, has_id: boolean, page_id: long>, last boolean, rows {dict(runs.dtypes)['rows']}")


def merged(arriving: Iterator[tuple[str, bool, bool, list[tuple]]]) -> Iterator[tuple]:
    """The rows of a range in order. arriving: run, whether it is the run's first block, whether it is its last, and its rows; first blocks
    come first, the others when the merge needs them, but for runs whose blocks end alike: those wait in `early`."""
    early: dict[str, list[tuple[bool, list[tuple]]]] = {}
    held = next(arriving, None)

    def stream(last: bool, rows: list[tuple], run: str) -> Iterator[tuple]:
        nonlocal held
        while True:
            yield from rows
            if last:
                return
            while not early.get(run):
                early.setdefault(held[0], []).append(held[2:])
                held = next(arriving, None)
            last, rows = early[run].pop(0)

    runs = []
    while held is not None and held[1]:
        runs.append(stream(held[2], held[3], held[0]))
        held = next(arriving, None)
    return loser_tree(runs)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in order of URL key, timestamp and page: by `range`, then `place`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arriving = ((r["range"], (r["run"], r["after"] is None, r["last"], r["rows"])) for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
        held = next(arriving, None)

        def one(at: int) -> Iterator[tuple]:
            nonlocal held
            while held is not None and held[0] == at:
                name, first, last, listed = held[1]
                held = next(arriving, None)
                yield name, first, last, _rows(listed)

        while held is not None:
            at, place = held[0], 0
            rows = merged(one(at))
            while part := list(islice(rows, 4096)):
                columns = [pa.array([r[i] for r in part], kind) for i, kind in enumerate(KINDS)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([at] * len(part), pa.int32()), pa.array(range(place, place + len(part)), pa.int64())], [*COLUMNS, "range", "place"])
                place += len(part)

    own = blocks(runs, boundaries(runs))
    return own.repartition("range").sortWithinPartitions("range", "after", "run").mapInArrow(run, f"{SCHEMA}, range int, place long")


def op2_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return merge_runs(materialize(read_runs(spark, path), "captures"))
