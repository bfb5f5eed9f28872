"""WARC archives: writing with revisit records, and reading in ranges by boundary-chain verification.

An archive can hold a record's magic inside a payload, so a task that starts anywhere in a file cannot trust the first
magic it sees. Each range of a file emits candidates: every offset at which a whole record parses, with the offset of its
successor, and where the chain through it leaves the range. From offset 0 of each file pointer jumping over these exits
finds the true entry of every range; only records that the chain reaches are read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAGIC, GZIP, END = b"WARC/1.", b"\x1f\x8b\x08", b"\r\n\r\n"
FILES = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("n_records", pa.int64())])
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    got = (uri or "<urn:x-page:none>")[12:-1]
    return None if got == "none" else int(got)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A record's bytes; a revisit holds the digest and length of the payload, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


class View:
    """Bytes of a file by offset, with one buffer."""

    def __init__(self, source, size: int, ahead: int = 1 << 20):
        self.source, self.size, self.ahead, self.at, self.held = source, size, ahead, 0, b""

    def get(self, a: int, b: int) -> bytes:
        b = min(b, self.size)
        if not (self.at <= a and b <= self.at + len(self.held)):
            self.source.seek(a)
            self.at, self.held = a, self.source.read(max(b - a, min(self.ahead, self.size - a)))
        return self.held[a - self.at : b - self.at]


def parse(view: View, at: int, compressed: bool) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and the successor's offset of the record at ``at``, or None if no whole record is there."""
    if compressed:
        inflate, got, pos = zlib.decompressobj(31), [], at
        try:
            while not inflate.eof:
                data = view.get(pos, pos + (1 << 16))
                if not data:
                    return None
                got.append(inflate.decompress(data))
                pos += len(data)
                if pos - at <= 1 << 16 and not b"".join(got).startswith(MAGIC):
                    return None
        except zlib.error:
            return None
        whole, end = b"".join(got), pos - len(inflate.unused_data)
    else:
        n = 1 << 12
        while (stop := (whole := view.get(at, at + n)).find(END)) < 0:
            if at + n >= view.size or n > 1 << 24:
                return None
            n *= 2
        end = -1
    stop = whole.find(END)
    if stop < 0 or not whole.startswith(MAGIC):
        return None
    try:
        lines = whole[:stop].decode().split("\r\n")[1:]
        head = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        n = int(head["content-length"])
    except (ValueError, KeyError):
        return None
    if not compressed:
        end = at + stop + 4 + n + 4
        if n < 0 or end > view.size:
            return None
        whole = view.get(at, end)
    if n < 0 or whole[stop + 4 + n :] != END:
        return None
    return head, whole[stop + 4 : stop + 4 + n], end


def write_archives(pages: DataFrame, min_bytes: int = 0, compress: bool = True, roll: int = 256 << 20, group: str = "") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the files: path, bytes, n_records.

    A null html is an empty payload. Of rows with equal payloads of at least ``min_bytes`` bytes those with the smallest
    page_id are responses, the others revisits of it; null ids come after all others, and payloads that only rows with
    null ids have are responses. Payloads are compared by SHA-1; the smallest id per digest is an aggregate, and its join
    back can be split where one payload is hot. Compressed archives have a gzip member for each record.
    """
    folder = common.new_path(pages.sparkSession, "warc", group)
    rows = common.columns(pages, "page_id", "url", "html").withColumn("html", F.coalesce(F.col("html"), F.lit("")).cast("binary")).withColumn("sha", F.unhex(F.sha1("html")))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, "sha").select("page_id", "url", "html", "first")

    def write(batches):
        from pyspark import TaskContext

        task, done, records = TaskContext.get(), [], iter(x for b in batches for x in zip(*(b.column(k) for k in range(4)), strict=True))
        more = next(records, None)
        while more is not None:
            path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}.warc{'.gz' * compress}"
            total = [0, 0]

            def fill(out):
                nonlocal more
                while more is not None and total[0] < roll:
                    page, url, html, least = (x.as_py() for x in more)
                    revisit = len(html) >= min_bytes and least is not None and least != page
                    data = record(page, url, html, least, revisit)
                    if compress:
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        data = pack.compress(data) + pack.flush()
                    out.write(data)
                    total[0] += len(data)
                    total[1] += 1
                    more = next(records, None)

            common.put_file(path, fill)
            done.append((path, *total))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], schema=FILES)

    return common.materialize(rows.mapInArrow(write, "path string, bytes long, n_records long"), "warc-files", group)


def _entry_chain(candidates: DataFrame, files: DataFrame, jumps: int, group: str) -> DataFrame:
    """(path, x): offset 0 of each file and the exits that the chain from there takes, by pointer jumping.

    Only candidates at a file's start or at some range's exit can be entries, about one a range, so few rows jump.
    """
    candidates = common.materialize(candidates, "candidates", group)
    doors = candidates.select("path", F.col("leaves").alias("offset")).union(files.select("path", F.lit(0).cast("long"))).distinct()
    jump = candidates.join(doors, ["path", "offset"], "left_semi").select("path", F.col("offset").alias("x"), F.col("leaves").alias("y"))
    jump = common.materialize(jump, "jump", group)
    reached = files.select("path", F.lit(0).cast("long").alias("x"))
    for k in range(jumps):
        reached = common.materialize(reached.union(reached.join(jump, ["path", "x"]).select("path", F.col("y").alias("x"))).distinct(), "reached", group)
        if k + 1 < jumps:
            far = jump.select("path", F.col("x").alias("y"), F.col("y").alias("z"))
            jump = common.materialize(jump.join(far, ["path", "y"]).select("path", "x", F.col("z").alias("y")), "jump", group)
    return reached


def read_archives(files: DataFrame, span: int = 8 << 20, strict: bool = True, group: str = "") -> DataFrame:
    """The records that the chains of ``files`` (path, bytes) reach, as ``RECORDS``, read in ranges of ``span`` bytes.

    ``strict`` fails on a file whose chain does not end at its last byte, as after damage; else such a file's records
    up to there are returned.
    """
    files = files.where("bytes > 0").select("path", "bytes")
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("bytes") - 1) / span).cast("long"))).alias("k"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def find(batches):
        for batch in batches:
            for path, size, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, where = common.filesystem(path)
                compressed = path.endswith(".gz")
                begin, end, magic = k * span, min(size, (k + 1) * span), GZIP if compressed else MAGIC
                with fs.open_input_file(where) as source:
                    view, found, block = View(source, size), {}, begin
                    while block < end:
                        data, at = view.get(block, min(end, block + (1 << 20)) + len(magic) - 1), -1
                        hits = []
                        while (at := data.find(magic, at + 1)) >= 0:
                            hits.append(block + at)
                        for at in hits:
                            if got := parse(view, at, compressed):
                                found[at] = got[2]
                        block += 1 << 20
                leaves: dict[int, int] = {}
                for at in sorted(found, reverse=True):
                    leaves[at] = leaves.get(found[at], found[at])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(leaves), pa.string()), pa.array(leaves.keys(), pa.int64()), pa.array(leaves.values(), pa.int64())], ["path", "offset", "leaves"])

    candidates = ranges.repartition(n, "path", "k").mapInArrow(find, "path string, offset long, leaves long")
    most = files.agg(F.max("bytes")).first()[0] or 0
    reached = _entry_chain(candidates, files, math.ceil(math.log2(max(1, math.ceil(most / span)))) + 1, group)
    if strict and (lost := files.join(reached, (files.path == reached.path) & (files.bytes == reached.x), "left_anti").select("path").first()):
        raise ValueError(f"the records of {lost[0]} end before the file does")
    entries = reached.withColumn("k", (F.col("x") / span).cast("long")).join(files, "path").where("x < bytes").select("path", "bytes", "k", "x")

    def read(batches):
        for batch in batches:
            for path, size, k, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, where = common.filesystem(path)
                with fs.open_input_file(where) as source:
                    view, out = View(source, size), []
                    while at < min(size, (k + 1) * span) and (got := parse(view, at, path.endswith(".gz"))):
                        head, block, at = got
                        page, url = _page(head.get("warc-record-id")), head.get("warc-target-uri")
                        if head["warc-type"] == "revisit":
                            out.append((page, url, int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), "revisit", _page(head["warc-refers-to"])))
                        else:
                            payload = block[block.index(END) + 4 :]
                            out.append((page, url, len(payload), digest(payload), "response", None))
                    for i in range(0, len(out), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 10_000], strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return entries.repartition(n, "path", "k").mapInArrow(read, RECORDS)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """A record for every page, written to compressed archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages)).drop("url")


