"""Deterministic sharded WARC writer and reader.

Rows are range-sorted by id into shards (cut points from a quantile sketch, as many as the table's bytes ask for, or given),
and each shard is one task of its own. A shard's writer rolls to a new file whenever the compressed size passes ``roll_bytes``. Headers and digests are generated anew from the payload, records are
gzip members of their own with no time stamp, so equal input and cut points give equal bytes. Each file is written
under a temporary name, renamed when complete, and listed in a manifest that Spark commits; only listed files count,
so what a lost executor or a second attempt leaves behind is never read.

Equal payloads: the smallest id's record is the response, the others revisit it (payloads below ``least_bytes`` never do).
Null html is an empty payload, a null url is written as the record's own name. Rows that repeat id and payload are records
of one kind. Rows without an id are left out. An empty table writes an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact
from .common import bucket_of, id_bounds, partitions, small_batches

ROLL_BYTES = 32 << 20
#: Payload bytes of a shard, at most, where rows are of like size; there are at least as many shards as shuffle partitions.
SHARD_BYTES = 256 << 20
#: Shards at most, as each is a cut point in the plan; beyond, shards grow (6 GB each at 100 TB) and roll more files.
MOST_SHARDS = 1 << 14
#: Files that a reading task takes, on average.
FILES_A_TASK = 4
#: The date of every record (WARC needs one, pages have none).
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, bytes long, records long, first_id long, last_id long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    name = f"urn:page:{page_id}"
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = answer + payload if refers_to is None else answer
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url or name, safe=":/?#[]@!$&'()*+,;=%~-._")),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


class Roller:
    """Writes records into files of about roll_bytes, each complete before it has its name."""

    def __init__(self, path: str, shard: int, roll_bytes: int):
        self.fs, self.base = opened(path)
        self.shard, self.roll_bytes, self.number, self.out = shard, roll_bytes, 0, None

    def write(self, page_id: int, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.temporary = f"{self.base}/_temporary/{uuid.uuid4().hex}"
            self.out, self.hash, self.size, self.records, self.first = self.fs.open_output_stream(self.temporary), hashlib.sha256(), 0, 0, page_id
        self.out.write(data)
        self.hash.update(data)
        self.size, self.records, self.last = self.size + len(data), self.records + 1, page_id
        if self.size >= self.roll_bytes:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            name = f"{self.shard:06d}-{self.number:05d}.warc.gz"
            self.fs.move(self.temporary, f"{self.base}/data/{name}")
            yield name, self.size, self.records, self.first, self.last, self.hash.hexdigest()
            self.number, self.out = self.number + 1, None


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, bounds: list | None = None) -> DataFrame:
    """Writes ``pages`` under ``path`` (a URI that every executor reaches); returns the committed manifest."""
    spark = pages.sparkSession
    small_batches(spark)
    filesystem, base = opened(path)
    for folder in ("data", "_temporary"):
        filesystem.create_dir(f"{base}/{folder}", recursive=True)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    if bounds is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
        bounds = id_bounds(rows, "page_id", min(MOST_SHARDS, max(partitions(spark), size // SHARD_BYTES)))
    digests = rows.select("page_id", F.unhex(F.sha1("html")).alias("sha"), F.octet_length("html").cast("long").alias("bytes"))
    found = exact.assign(digests, F.col("page_id"), ["sha", "bytes"], "min").where((F.col("__keep") < F.col("page_id")) & (F.col("bytes") >= least_bytes))
    verdicts = found.groupBy("page_id", "sha").agg(F.min("__keep").alias("refers_to"))
    # verdicts sort before the pages they belong to, so each shard needs one exchange and no join
    both = rows.withColumns({"sha": F.unhex(F.sha1("html")), "refers_to": F.lit(None).cast("long")}).unionByName(verdicts.withColumns({"url": F.lit(None).cast("string"), "html": F.lit(None).cast("string")}))
    both = both.withColumn("shard", bucket_of(F.col("page_id"), bounds).cast("int"))
    both = both.repartitionById(len(bounds) + 1, "shard")  # not by hash, which would put several shards into one task
    both = both.sortWithinPartitions("shard", "page_id", F.col("html").isNotNull(), "sha", "url").select("shard", "page_id", "sha", "refers_to", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, at, verdict, done = None, None, {}, []
        for batch in batches:
            for shard, page_id, sha, refers_to, url, html in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if roller is None or roller.shard != shard:
                    done += roller.close() if roller else []
                    roller = Roller(path, shard, roll_bytes)
                if page_id != at:
                    at, verdict = page_id, {}
                if html is None:
                    verdict[sha] = refers_to
                else:
                    done += roller.write(page_id, record(page_id, url, html.encode(), verdict.get(sha)))
        done += roller.close() if roller else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["file", "bytes", "records", "first_id", "last_id", "sha256"])

    both.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    inflate, parts, data = zlib.decompressobj(31), [], stream.read(size)
    while data:
        parts.append(inflate.decompress(data))
        data = inflate.unused_data if inflate.eof else stream.read(size)
        if inflate.eof:
            yield b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []
            data = data or stream.read(size)
    if parts and any(parts):
        raise ValueError("truncated WARC file")


def parse_record(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{digest_of(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"{fields['WARC-Record-ID']}: its block doesn't match its digest")
    answer, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in answer.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind, refers = fields["WARC-Type"], fields.get("WARC-Refers-To")
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: its payload doesn't match its digest")
    number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">"))
    return number(fields["WARC-Record-ID"]), size, digest, kind, number(refers) if refers else None, fields["WARC-Target-URI"], payload if kind == "response" else None


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the files in the manifest, with their digests verified; payload is null unless asked for."""
    manifest = spark.read.parquet(f"{path}/manifest")
    files = manifest.select("file").repartition(max(1, partitions(spark), manifest.count() // FILES_A_TASK), "file")
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = opened(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                with filesystem.open_input_stream(f"{base}/data/{name}", compression=None) as stream:
                    for raw in members(stream):
                        found = parse_record(raw)
                        held.append(found if with_payload else (*found[:-1], None))
                        size += len(raw) if with_payload else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, RECORD)
