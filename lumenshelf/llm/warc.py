"""WARC archives and a merged capture index (operator 9).

1. ``with_revisits``: SHA-1 payload digests; of equal payloads the capture with the
   largest id is the response and the others refer to it.
2. ``write_archives``: every task sorts its captures by URL key and time and writes
   them, one gzip member per record, into WARC files on shared storage. Each file
   is therefore a locally sorted run.
3. ``read_archives``: files are read back in a stream, by their own headers.
4. ``merge_runs``: the runs' index entries are dealt to ranges of (URL key, time, id, file, place),
   and in each range a loser tree merges the k runs. Ranges in order, and rows in
   order within them, are the global capture history. A URL with a third of all
   captures spreads over many ranges, as time and id are part of the range key.

Edge cases: a null payload is an empty one; a null URL has an empty URL key; line
breaks in URLs are percent-encoded in headers; rows that repeat an id are all
written, and all of them are responses if the id is the largest of its payload.
A null id is lowest; it is written without a record number and read back as null.
Ids are any 64-bit numbers. A WARC date has a year of four digits: times before year 1
or after 9999 are written as the first or the last second of that range, and where a
table has no times, one second per id is counted round and round from ``EPOCH`` to
the end of year 9999. Extra columns are not read. Empty tables write no files and give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import new_folder
from .common import cut, drop, lookup, remove, table, tune
from .storage import SharedFile, open_read
from .url_filters import host_of, path_of

#: A file is closed and a new one begun beyond this many bytes.
FILE_BYTES = 128 << 20
#: Index entries in one range of the merge, about; the memory of one merge task.
RANGE_ROWS = 200_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: 2024-01-01; a table without capture times gets one second per id from here.
EPOCH = 1_704_067_200
#: First and last second that a WARC date can name.
FIRST_TIME, LAST_TIME = -62_135_596_800, 253_402_300_799


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1 without padding: 160 bits are four groups of 40."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), digits, BASE32)


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then path and query."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host_of(url), r"\.")), ","), F.lit(")"), path_of(url), rest)
    return F.coalesce(key, F.lit(""))


def header_url(url: Column) -> Column:
    """A URL as headers hold it: no null, line breaks percent-encoded."""
    return F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def with_revisits(captures: DataFrame) -> DataFrame:
    """Adds payload (binary), digest, refers_to to captures (id, url, ts, html)."""
    rows = captures.withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary")).drop("html")
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    first = cut(rows.groupBy("digest").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n")), "payload-digests")
    out = lookup(rows, first, "digest", "n", "inner")
    return out.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("largest")), F.col("largest"))).drop("largest", "n")


def date_of(ts: int) -> str:
    at = datetime.fromtimestamp(min(max(ts, FIRST_TIME), LAST_TIME), timezone.utc)
    return f"{at.year:04d}-{at:%m-%dT%H:%M:%SZ}"


def time_of(date: str) -> int:
    return int(datetime.strptime(date, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())


def time_of_id(number: Column) -> Column:
    return F.lit(EPOCH) + F.pmod(number, F.lit(LAST_TIME - EPOCH + 1))


def record_bytes(number: int | None, url: str, ts: int, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:capture:{'' if number is None else number}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {date_of(ts)}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:capture:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write_run(folder: str, file_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem, out, records = f"run-{TaskContext.get().partitionId():06d}", None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out, records = SharedFile(folder, stem, ".warc.gz"), 0
                out.write(_member(record_bytes(r["id"], r["url"], r["ts"], r["payload"], r["digest"], r["refers_to"])))
                records += 1
                if out.size >= file_bytes:
                    yield pa.RecordBatch.from_pydict({"file": [out.close()], "records": [records], "bytes": [out.size]})
                    out = None
        if out is not None:
            yield pa.RecordBatch.from_pydict({"file": [out.close()], "records": [records], "bytes": [out.size]})

    return write


def write_archives(captures: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes captures (id, url, ts, payload, digest, refers_to); returns the files (file, records, bytes)."""
    # runs are sorted by what a reader will find: header form of the URL, times that a date can name
    rows = captures.withColumns({"url": header_url(F.col("url")), "ts": F.greatest(F.lit(FIRST_TIME), F.least(F.lit(LAST_TIME), "ts"))})
    rows = rows.withColumn("key", url_key(F.col("url"))).sortWithinPartitions("key", "ts", "id").drop("key")
    rows = rows.select("id", "url", "ts", "payload", "digest", "refers_to")
    return cut(rows.mapInArrow(_write_run(folder, file_bytes), "file string, records long, bytes long"), "warc-files")


def _members(source, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The contents of each gzip member of a stream, one at a time."""
    z, parts = zlib.decompressobj(31), []
    while data := source.read(chunk):
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse_record(data: bytes) -> dict:
    """One record's fields; the payload's length and digest are taken from its bytes, or for a revisit from its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:capture:(-?\d+)>", fields.get(name, ""))) else None
    declared = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    return {
        "id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "ts": time_of(fields["WARC-Date"]),
        "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "declared_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload": payload if fields["WARC-Type"] == "response" else None, "payload_bytes": len(payload) if fields["WARC-Type"] == "response" else declared,
    }


_READ = "file string, seq long, id long, url string, ts long, record_type string, refers_to long, declared_digest string, payload_bytes long, payload binary"


def _read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(a, kinds[b]) for a, b in (x.split() for x in _READ.split(", "))])
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows, held = [], 0
            with open_read(uri) as source:
                for seq, data in enumerate(_members(source)):
                    rows.append(parse_record(data) | {"file": uri, "seq": seq})
                    held += len(data)
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema)


def read_archives(files: DataFrame) -> DataFrame:
    """All records of the named files, in each file's order (file, seq)."""
    n = max(1, files.count())
    return files.select("file").repartition(min(n, 4096), "file").mapInArrow(_read_runs, _READ)


class LoserTree:
    """Merges k sorted lists: each inner node keeps the loser of its match, so the next item costs log2 k comparisons."""

    def __init__(self, runs: list[list]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        self.winner = self._build(1) if runs else -1

    def _head(self, i: int):
        return self.runs[i][self.at[i]] if i >= 0 and self.at[i] < len(self.runs[i]) else None

    def _beats(self, i: int, j: int) -> bool:
        """Whether run i's head comes before run j's; an ended run loses, equal heads go by run number."""
        a, b = self._head(i), self._head(j)
        return b is None or (a is not None and (a < b or (a == b and i < j)))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return win

    def __iter__(self):
        while (item := self._head(self.winner)) is not None:
            yield item
            run = self.winner
            self.at[run] += 1
            node = (run + self.k) // 2
            while node:
                if self._beats(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def _merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    files = whole.column("file").to_pylist()
    # a null id comes first
    keys = list(
        zip(
            whole.column("url_key").to_pylist(),
            whole.column("ts").to_pylist(),
            [(-1 << 63) - 1 if x is None else x for x in whole.column("id").to_pylist()],
            range(len(files)),
            strict=True,
        ),
    )
    runs: dict[str, list] = {}
    for f, k in zip(files, keys, strict=True):
        runs.setdefault(f, []).append(k)
    order = [k[3] for k in LoserTree(list(runs.values()))]
    out = whole.take(pa.array(order)).append_column("range_id", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32()))
    out = out.append_column("range_pos", pa.array(range(len(order)), pa.int64()))
    yield from out.to_batches(max_chunksize=4096)


def merge_runs(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Index entries (file, seq, url_key, ts, id, ...) in global order: by range_id, then range_pos.

    ``index`` is a cut() table, as its rows are sampled for the ranges' bounds.
    """
    n = max(1, -(-index.count() // range_rows), int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # file and seq are the merge's own order of equal keys; with them a capture that repeats any number of times is cut into ranges too
    dealt = index.repartitionByRange(n, "url_key", "ts", "id", "file", "seq").sortWithinPartitions("file", "seq")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(_merge_range, f"{kinds}, range_id int, range_pos long")


def capture_history(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ts: Column | None = None) -> DataFrame:
    """Writes ``pages`` as WARC archives into ``folder``, reads them back and returns the merged, globally ordered index.

    Columns: url_key, ts, id, url, record_type, refers_to, payload_bytes, digest,
    file, seq, range_id, range_pos. A record whose payload doesn't have the digest
    of its header stops the job.
    """
    tune(pages.sparkSession)
    when = F.coalesce(ts if ts is not None else time_of_id(F.col(id_col).cast("long")), F.lit(EPOCH)).cast("long")
    captures = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), when.alias("ts"), F.col(html_col).alias("html"))
    files = write_archives(with_revisits(captures), folder)
    read = read_archives(files)
    real = F.when(F.col("payload").isNotNull(), base32_sha1(F.col("payload"))).otherwise(F.col("declared_digest"))
    checked = F.when(real == F.col("declared_digest"), real).otherwise(F.raise_error(F.concat(F.lit("damaged payload in "), F.col("file"))))
    index = cut(
        read.select(
            "file",
            "seq",
            url_key(F.col("url")).alias("url_key"),
            "ts",
            "id",
            "url",
            "record_type",
            "refers_to",
            "payload_bytes",
            checked.cast("string").alias("digest"),
        ),
        "capture-index",
    )
    drop(files)
    return merge_runs(index)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    merged = capture_history(table(spark, sf_dir, "pages"), folder)
    remove(spark, folder)  # the merge reads the index alone
    return merged.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('{BASE32}', 1 + (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INTEGER, 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY h) AS largest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM d
"""
