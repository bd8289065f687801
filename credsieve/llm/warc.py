"""WARC archives of pages, and their captures in one global order.

Writing: a page is a ``response`` record with its payload.  Of pages with one payload of
``LEAST`` bytes or more only that with the largest id is; the others are ``revisit``
records, which hold the HTTP header alone and refer to it.  Payload sizes and digests are
counted before any page moves; the pages then move once, if the list of revisits is too
long for a broadcast.  Spark's text writer writes the archives: a record is a line, the two
line breaks after a record are the line separator.

Reading: records are cut by their Content-Length from a stream of at most one record, and
the digest of a response is taken from the bytes read.

Index: an external merge.  A task sorts its captures by URL key, time, page and place into
runs of at most ``RUN``.  Splitters from a bounded sample of the keys cut the runs into
ranges; a key is unique, so one URL with very many captures is cut like any others.  A
range is merged from its runs by a loser tree in one pass; the ranges' sizes give global
positions.

Defined results: a null or empty html is an empty payload and a response; equal payloads of
one (largest) page id are responses each; a null id never is the largest unless all are,
and reads back as null; a null URL has the empty key, and white space and control
characters in one are written as %20; a null time is 1970.  Very long pages pass in one
piece.  An empty table gives an archive without records and an empty result.  Other columns
of the input are left behind, whatever their names.
"""

from __future__ import annotations

import bisect
import calendar
import hashlib
import re
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credsieve.storage import Steps, work_folder

LEAST = 1000
# Records of an archive file, and captures of a sorted run.
RECORDS = 5000
RUN = 100_000
# Captures of a range, and keys sampled to choose the ranges; neither changes the order.
RANGE = 50_000
SAMPLE = 20_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def _date(seconds: Column) -> Column:
    """ISO time in UTC, whatever the session's time zone."""
    of_day = F.pmod(seconds, F.lit(86_400))
    day = F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")).cast("string")
    return F.format_string(
        "%sT%02d:%02d:%02dZ", day, F.floor(of_day / 3600), F.floor(of_day / 60) % 60, of_day % 60
    )


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(">"))


def _record(kind: str, length: Column, payload: Column, refers_to: Column | None = None) -> Column:
    """A record without the line breaks behind it; ``length`` is that of the page's payload."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit(END)
    )
    fields = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), _name(F.col("page_id")),
        F.lit("\r\nWARC-Date: "), _date(F.col("captured")),
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7f]", "%20"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
    ]
    if refers_to is not None:
        fields += [F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _name(refers_to)]
    fields += [
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(payload)).cast("string"), F.lit(END), http, payload,
    ]
    return F.concat(*fields)


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    captured: Column | None = None,
    steps: Steps | None = None,
) -> None:
    """Gzipped archives of all pages below ``folder``; ``captured`` is in seconds of UTC."""
    steps = steps or Steps(pages.sparkSession)
    seconds = F.coalesce((captured if captured is not None else F.lit(0)).cast("long"), F.lit(0).cast("long"))
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.greatest(F.lit(FIRST_SECOND), F.least(F.lit(LAST_SECOND), seconds)).alias("captured"),
        F.sha1(html.cast("binary")).alias("digest"),
        F.octet_length(html).cast("long").alias("bytes"),
        html.alias("html"),
    )
    large = rows.where(F.col("bytes") >= LEAST).drop("html")
    # one row per payload that some page repeats, and then the pages that do
    kept = steps.write(
        large.groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_least"), F.count("*").alias("_rows"), F.count("page_id").alias("_ids"))
        .where((F.col("_least") != F.col("refers_to")) | (F.col("_rows") > F.col("_ids")) & (F.col("_ids") > 0))
        .select("digest", "bytes", "refers_to")
    )
    revisits = steps.write(large.join(kept, ["digest", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))))
    gone = revisits.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"))
    responses = rows.join(
        gone, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left_anti"
    )
    lines = responses.select(_record("response", F.col("bytes"), F.col("html")).alias("value")).unionByName(
        revisits.select(_record("revisit", F.col("bytes"), F.lit(""), F.col("refers_to")).alias("value"))
    )
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)
    steps.drop(kept, revisits)


class Bytes:
    """Bytes of a plain or gzipped file from the front, never more of them than asked for."""

    STEP = 1 << 18

    def __init__(self, content: bytes) -> None:
        self.content, self.at, self.left, self.offset = memoryview(content), 0, b"", 0
        self.gunzip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.gunzip is None:
            got, self.at = bytes(self.content[self.at : self.at + self.STEP]), self.at + self.STEP
            self.left += got
            return bool(got)
        while True:
            if self.gunzip.eof:
                rest = self.gunzip.unused_data
                self.at -= len(rest)
                if self.at >= len(self.content):
                    return False
                self.gunzip = zlib.decompressobj(31)
            chunk = self.content[self.at : self.at + self.STEP]
            if not chunk:
                return False
            self.at += len(chunk)
            if got := self.gunzip.decompress(chunk):
                self.left += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is passed; None at the end of the file."""
        searched = 0
        while (end := self.left.find(mark, searched)) < 0:
            searched = max(0, len(self.left) - len(mark))
            if not self._more():
                return None
        return self.take(end + len(mark))[:end]

    def take(self, size: int) -> bytes:
        parts, have = [self.left], len(self.left)
        while have < size:
            self.left = b""
            if not self._more():
                raise ValueError("an archive ends inside a record")
            parts.append(self.left)
            have += len(self.left)
        whole = b"".join(parts)
        out, self.left = whole[:size], whole[size:]
        self.offset += size
        return out


def read_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records of an archive file."""
    stream = Bytes(content)
    while True:
        offset = stream.offset
        header = stream.until(b"\r\n\r\n")
        if header is None:
            return
        lines = header.decode("utf-8", "replace").split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        block = stream.take(int(fields["Content-Length"]))
        stream.take(4)
        yield offset, fields, block


_SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")


def url_key(url: str) -> str:
    """Host labels from the top domain down, then path and query: ``org,example)/a?b``."""
    rest = _SCHEME.sub("", url).split("#", 1)[0]
    end = min((rest.find(c) for c in "/?" if c in rest), default=len(rest))
    host, path = rest[:end].rsplit("@", 1)[-1].lower(), rest[end:]
    host = host.removesuffix(":80").removesuffix(":443").removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (path or "/") if rest else ""


CAPTURE = "key string, url_key string, captured long, page string, type string, digest string, bytes long, refers_to string"
NAMES = [c.split()[0] for c in CAPTURE.split(", ")]


def _capture(file: str, offset: int, fields: dict[str, str], block: bytes) -> tuple:
    head, payload = block.split(b"\r\n\r\n", 1)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    if fields["WARC-Type"] == "response":
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)

    def page(field: str) -> str:
        return fields.get(field, "").removeprefix("<urn:page:").removesuffix(">")

    captured = calendar.timegm(time.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ"))
    place, name = url_key(fields.get("WARC-Target-URI", "")), page("WARC-Record-ID")
    # orders like (URL key, time, page, file, offset), numbers by size
    key = f"{place}\0{captured - FIRST_SECOND:015d}\0{len(name):04d}{name}\0{file}\0{offset:015d}"
    return key, place, captured, name or None, fields["WARC-Type"], digest, size, page("WARC-Refers-To") or None


def sorted_runs(spark: SparkSession, folder: str) -> DataFrame:
    """run, rank and the captures of all archive files: each run in the order of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, []

        def sent() -> pa.RecordBatch:
            held.sort()
            columns = [pa.array([f"{part}-{made}"] * len(held)), pa.array(range(len(held)), pa.int64())]
            columns += [pa.array(c, pa.int64() if n in ("captured", "bytes") else pa.string()) for n, c in zip(NAMES, zip(*held, strict=True), strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["run", "rank", *NAMES])

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for offset, fields, block in read_records(content.as_py()):
                    held.append(_capture(file.rsplit("/", 1)[-1], offset, fields, block))
                    if len(held) == RUN:
                        yield sent()
                        made, held = made + 1, []
        if held:
            yield sent()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(run, f"run string, rank long, {CAPTURE}")


class LoserTree:
    """Merges sorted lists: a node holds the loser of its two sides, the root's winner is next.

    The next key of a list is compared on its path to the root only.
    """

    def __init__(self, lists: list[list]) -> None:
        self.lists, self.at = lists, [0] * len(lists)
        self.heads = [(0, x[0], i) if x else (1, "", i) for i, x in enumerate(lists)]
        self.size = len(lists)
        self.losers = [0] * self.size
        # leaves are size .. 2 * size - 1; winners move up from the bottom
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.heads[a] <= self.heads[b] else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(list, index in it) in the order of the keys."""
        heads, losers = self.heads, self.losers
        winner = self.winner
        while heads and not heads[winner][0]:
            at = self.at[winner]
            yield winner, at
            at += 1
            self.at[winner] = at
            keys = self.lists[winner]
            heads[winner] = (0, keys[at], winner) if at < len(keys) else (1, "", winner)
            node = (winner + self.size) // 2
            while node:
                if heads[losers[node]] < heads[winner]:
                    winner, losers[node] = losers[node], winner
                node //= 2


def merged(runs: DataFrame) -> DataFrame:
    """The captures with range, at (position in the range) and nth (of its URL in the range).

    ``runs`` must be a written table.
    """
    spark, count = runs.sparkSession, runs.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE))
    # about SAMPLE keys, whatever the number of captures
    sample = runs.select("key")
    if count > SAMPLE:
        sample = sample.sample(SAMPLE / count, 7)
    keys = sorted(r.key for r in sample.collect())
    splitters = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bisect.bisect_right(splitters, k) for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "range"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        names, ranks, keys = (table.column(c).to_pylist() for c in ("run", "rank", "key"))
        places = table.column("url_key").to_pylist()
        of_run: dict[str, list[int]] = {}
        for i, name in enumerate(names):
            of_run.setdefault(name, []).append(i)
        pieces = [sorted(x, key=ranks.__getitem__) for x in of_run.values()]
        order = [pieces[i][at] for i, at in LoserTree([[keys[j] for j in x] for x in pieces])]
        nth, before, last = [], 0, None
        for i in order:
            before, last = (before + 1 if places[i] == last else 0), places[i]
            nth.append(before)
        out = table.take(pa.array(order, pa.int64())).drop_columns(["run", "rank"])
        out = out.append_column("at", pa.array(range(len(order)), pa.int64())).append_column("nth", pa.array(nth, pa.int64()))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    dealt = runs.mapInArrow(deal, f"run string, rank long, {CAPTURE}, range int")
    return dealt.repartitionById(ranges, "range").mapInArrow(merge, f"{CAPTURE}, range int, at long, nth long")


def capture_index(spark: SparkSession, folder: str, steps: Steps | None = None) -> DataFrame:
    """All captures of the archives with their position in the order of URL key and time, and
    their number in the history of their URL, both from 0."""
    steps = steps or Steps(spark)
    runs = steps.write(sorted_runs(spark, folder))
    rows = steps.write(merged(runs))
    steps.drop(runs)
    # one row per range; a window over them only
    ends = rows.groupBy("range").agg(
        F.count("*").alias("n"), F.min_by("url_key", "at").alias("first"), F.max_by("url_key", "at").alias("last"),
        (F.max_by("nth", "at") + 1).alias("tail"),
    )
    order = Window.orderBy("range")
    of_last = Window.partitionBy("last").orderBy("range")
    ends = ends.withColumn("so_far", F.sum("tail").over(of_last))
    carried = F.when(F.lag("last").over(order) == F.col("first"), F.lag("so_far").over(order)).otherwise(0)
    bases = ends.select(
        F.col("range"), "first",
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        carried.alias("carried"),
    )
    carry = F.when(F.col("url_key") == F.col("first"), F.col("carried")).otherwise(0)
    return rows.join(F.broadcast(bases), "range").select(
        *NAMES, (F.col("base") + F.col("at")).alias("position"), (F.col("nth") + carry).alias("capture_no")
    )


def round_trip(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    captured: Column | None = None,
    steps: Steps | None = None,
) -> DataFrame:
    """Archives of the pages, written below ``folder`` and read back: one row per page."""
    spark = pages.sparkSession
    steps = steps or Steps(spark)
    folder = folder or f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, id_col, url_col, html_col, captured, steps)
    kind = pages.schema[id_col].dataType
    found = capture_index(spark, folder, steps)
    return found.select(
        F.url_decode("page").cast(kind).alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.url_decode("refers_to").cast(kind).alias("refers_to"),
        "url_key",
        F.timestamp_seconds("captured").alias("captured_at"),
        "position",
        "capture_no",
    )
