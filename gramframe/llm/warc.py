"""WARC archives and an external merge of their index.

Records are put together as text, gathered to archives of a bounded size and written by Spark's own writer, so archives reach any store
that Spark can write and a lost executor leaves no half-written file. Payloads that occur more than once are stored once: the capture with the smallest id is a
response, the others are revisits that refer to it. Read back record by record by their Content-Length, each archive gives a run of
its captures sorted by URL key, time and id; runs meet in key ranges, where a loser tree merges them, so that the parts of the
result, one after another, hold each URL's captures in order of time.

Defined results: null html is an empty payload; a null url has no target header and the URL key ''; control characters in a url are
percent-encoded in its header; rows with equal id and payload are captures alike, all responses or all revisits, under one record id;
a null id is written as "none", is always a response and comes first in ties; ties in key and time go by id; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramframe.llm.common import cut, join_split, shared_dir, sized

INDEX = "page_id long, url string, url_key string, time string, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


@dataclass(frozen=True)
class Warc:
    """Least bytes of a payload that is stored once, bytes of an archive (a longer record has one of its own), and index rows that one task merges."""

    min_bytes: int = 0
    file_bytes: int = 16 << 20
    merge_rows: int = 200_000


def base32(hexed: Column) -> Column:
    """Base32 of hexadecimal digits, five of which make four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    one = lambda v, s: F.substring(letters, F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1))
    part = lambda i: F.conv(F.substring(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(*[one(part(i), s) for s in (15, 10, 5, 0)])), "")


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then the rest, in small letters: neighbours sort together."""
    text = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(text, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(text, r"^[a-z][a-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    return F.when(host == "", text).otherwise(F.concat(F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")), ","), F.lit(")"), rest))


def records(pages: DataFrame, p: Warc) -> DataFrame:
    """(record) of each row of (page_id, url, html, time), without the line feed that ends it."""
    rows = pages.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    ids = rows.where(F.col("bytes") >= p.min_bytes).select("page_id", "digest")
    first = cut(ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "first")
    revisits = cut(join_split(ids, first, ["digest"]).where("page_id != first").select("page_id", "digest", "first").distinct(), "revisits")
    marked = rows.join(sized(revisits), ["page_id", "digest"], "left")
    again = F.col("first").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    size = F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Date", F.col("time")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
    )
    return marked.select(F.concat(head, http, F.when(again, F.lit("")).otherwise(F.col("html")), F.lit("\r\n\r")).alias("record"))


def write_archives(pages: DataFrame, path: str, p: Warc | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time: Column | None = None) -> None:
    """Write a record of each row to archives under path. time: ISO text by UTC, such as 2024-01-31T23:59:59Z."""
    p = p or Warc()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), (F.lit("1970-01-01T00:00:00Z") if time is None else time).alias("time"))
    gathered = records(rows, p).mapInArrow(archives(p), "value string")
    gathered.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def archives(p: Warc):
    """A function for mapInArrow that joins records to whole archives, less the line feed behind the last, which the writer adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.binary()).cast(pa.string())], ["value"])
        for batch in batches:
            for record in batch.column(0).cast(pa.binary()):
                value = record.as_py()
                if held and size + len(value) > p.file_bytes:
                    yield pack()
                    held, size = [], 0
                held.append(value)
                size += len(value) + 1
        if held:
            yield pack()

    return run


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an archive."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:stop].split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
        end = stop + 4 + int(headers["content-length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield at, end + 4 - at, headers, content[stop + 4 : end]
        at = end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index rows without URL key; payloads are checked against their digests."""

    def rows(file: tuple[str, bytes]) -> Iterator[tuple]:
        name, content = file
        for at, size, headers, block in parse(content):
            http, _, payload = block.partition(b"\r\n\r\n")
            digest = headers["warc-payload-digest"].removeprefix("sha1:")
            number = lambda x: None if x.endswith(":none>") else int(x.strip("<>").rsplit(":", 1)[1])
            if headers["warc-type"] == "response":
                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"the payload at {at} of {name} is damaged")
                n = len(payload)
            else:
                n = int(http.lower().rsplit(b"content-length:", 1)[1].split(b"\r\n")[0])
            refers = headers.get("warc-refers-to")
            yield number(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-date"], name.rsplit("/", 1)[-1], at, size, n, digest, headers["warc-type"], number(refers) if refers else None

    schema = ", ".join(x for x in INDEX.split(", ") if not x.startswith("url_key"))
    found = spark.sparkContext.binaryFiles(f"{path}/part-*", spark.sparkContext.defaultParallelism).flatMap(rows)
    return spark.createDataFrame(found, schema)


class LoserTree:
    """Merges sorted runs. A node keeps the run that lost there, so the next smallest takes one comparison a level."""

    def __init__(self, runs: list[Iterator]):
        self.runs, n = [iter(r) for r in runs], len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.nodes = [-1] * n
        for k in range(n):
            self.play(k)

    def beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def play(self, k: int) -> None:
        node = (k + len(self.runs)) // 2
        while node:
            other = self.nodes[node]
            if other < 0:
                self.nodes[node] = k
                return
            if self.beats(other, k):
                self.nodes[node], k = k, other
            node //= 2
        self.nodes[0] = k

    def __iter__(self) -> Iterator:
        while self.runs and (item := self.heads[k := self.nodes[0]]) is not None:
            yield item
            self.heads[k] = next(self.runs[k], None)
            self.play(k)


def merge_index(runs: DataFrame, p: Warc) -> DataFrame:
    """Index rows in global order, with the column position: the parts' ranges follow each other and rise within."""
    columns = runs.columns
    keys = [columns.index(c) for c in ("url_key", "time", "page_id", "archive", "offset")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        key = [tuple((v is not None, v) for v in row) for row in zip(*[table.column(k).to_pylist() for k in keys])]
        starts = [0, *(i for i in range(1, len(key)) if key[i] < key[i - 1])]  # where a run of rising keys begins
        order = [i for _, i in LoserTree([((key[i], i) for i in range(a, b)) for a, b in zip(starts, [*starts[1:], len(key)])])]
        base = TaskContext.get().partitionId() << 40
        yield from table.take(pa.array(order, pa.int64())).append_column("position", pa.array(range(base, base + len(order)), pa.int64())).to_batches(10_000)

    parts = max(1, -(-runs.count() // p.merge_rows))
    return runs.repartitionByRange(parts, "url_key", "time", "page_id", "archive", "offset").mapInArrow(merge, f"{INDEX}, position long")


def index(spark: SparkSession, path: str, p: Warc | None = None) -> DataFrame:
    """The merged index of the archives under path."""
    p = p or Warc()
    found = read_archives(spark, path).withColumn("url_key", url_key(F.col("url"))).select(*[x.split()[0] for x in INDEX.split(", ")])
    return merge_index(cut(found.sortWithinPartitions("archive", "url_key", "time", "page_id", "offset"), "runs"), p)


def capture_time(page_id: Column) -> Column:
    """A time of capture for tables that have none: a second of 2024, fixed by the id."""
    return F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(page_id * 7919, F.lit(31622400))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def query(spark, sf_dir: str) -> DataFrame:
    """The index of the archives that hold all pages."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, time=capture_time(F.col("page_id")))
    first = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return index(spark, path).select(*first, "url", "url_key", "time", "archive", "offset", "length", "position")
