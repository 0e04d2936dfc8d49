"""Event logs as a Spark data source, in batch and as a stream: ``spark.read.format("event_log")`` and ``spark.readStream.format("event_log")``.

A log is a file that grows, is renamed to ``<name>.prev`` when it is full, and begins anew; or a folder whose files are such generations. A
generation is known by its first line, whatever its name is now. The stream's offset says how many bytes of each generation were read, up to
the last complete line; a batch that is run again after a failure reads the same bytes, also if the file was renamed meanwhile. A
generation that is gone before it was read stops the stream, or is passed over with the option ``missing=skip``.

The source returns lines, in Arrow batches, with the generation and the byte that each begins at; ``events_of`` makes events of them on
the JVM's side. Large generations are read in parts of ``part_bytes``; a part begins after the first line end in it and ends with the line that
it begins last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import events
from .logs import char_array

LINES = "line string, generation string, at bigint"
PART_BYTES, READ_BYTES, LONGEST_FIRST_LINE = 32 << 20, 1 << 20, 1 << 20


def opened(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def generations(path: str) -> dict[str, tuple[str, int]]:
    """(path, bytes) of each generation; a file without a complete first line isn't one yet."""
    from pyarrow import fs

    system, base = opened(path)
    if system.get_file_info(base).type == fs.FileType.Directory:
        listed = [x for x in system.get_file_info(fs.FileSelector(base, recursive=True)) if x.is_file and not x.base_name.startswith((".", "_"))]
    else:
        listed = [x for x in system.get_file_info([f"{base}.prev", base]) if x.is_file]
    out = {}
    for x in sorted(listed, key=lambda x: x.path):
        with system.open_input_stream(x.path) as f:
            first, end, _ = f.read(LONGEST_FIRST_LINE).partition(b"\n")
        if end:
            out.setdefault(hashlib.sha256(first).hexdigest()[:24], (x.path, x.size))
    return out


def complete(path: str, at: str, size: int) -> int:
    """Bytes up to the end of the last complete line."""
    system, _ = opened(path)
    with system.open_input_file(at) as f:
        end = size
        while end > 0:
            begin = max(0, end - READ_BYTES)
            f.seek(begin)
            if (found := f.read(end - begin).rfind(b"\n")) >= 0:
                return begin + found + 1
            end = begin
    return 0


class Part(InputPartition):
    """Bytes of a generation; ``begin`` and ``end`` are line ends or the bounds of a part."""

    def __init__(self, generation: str, begin: int, end: int, whole: tuple[int, int]):
        self.generation, self.begin, self.end, self.whole = generation, begin, end, whole


def parts_of(generation: str, begin: int, end: int, part_bytes: int) -> list[Part]:
    return [Part(generation, a, min(end, a + part_bytes), (begin, end)) for a in range(begin, end, part_bytes)]


def lines_of(path: str, part: Part, missing: str) -> Iterator[pa.RecordBatch]:
    """The lines that begin in the part."""
    known = generations(path)
    if part.generation not in known:
        if missing == "skip":
            return
        raise FileNotFoundError(f"{path}: a generation of the log is gone before it was read")
    system, _ = opened(path)
    with system.open_input_file(known[part.generation][0]) as f:
        at = part.begin
        if part.begin > part.whole[0]:  # the line that runs into the part is the part's before
            f.seek(part.begin - 1)
            if f.read(1) != b"\n":
                at = part.whole[1]
                f.seek(part.begin)
                seen = part.begin
                while seen < part.whole[1]:
                    block = f.read(min(READ_BYTES, part.whole[1] - seen))
                    if (found := block.find(b"\n")) >= 0:
                        at = seen + found + 1
                        break
                    seen += len(block)
        f.seek(at)
        held, place = b"", at
        while at < part.whole[1] and place < part.end:
            block = f.read(min(READ_BYTES, part.whole[1] - at))
            if not block:
                break
            at += len(block)
            held += block
            texts, places = [], []
            *full, rest = held.split(b"\n")
            for line in full:
                if place < part.end:
                    texts.append(line.decode("utf-8", "replace"))
                    places.append(place)
                place += len(line) + 1
            held = rest
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([part.generation] * len(texts), pa.string()), pa.array(places, pa.int64())], names=["line", "generation", "at"])


class EventLog(DataSource):
    """Options: path, part_bytes, missing (fail or skip)."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(self.options)


class Common:
    def __init__(self, options: dict):
        self.path, self.missing = options["path"], options.get("missing", "fail")
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))

    def ends(self) -> dict[str, int]:
        return {g: complete(self.path, at, size) for g, (at, size) in generations(self.path).items()}

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return lines_of(self.path, partition, self.missing)


class Reader(Common, DataSourceReader):
    def partitions(self) -> list[Part]:
        return [p for g, end in self.ends().items() for p in parts_of(g, 0, end, self.part_bytes)]


class StreamReader(Common, DataSourceStreamReader):
    """Offsets: bytes read by generation; those of generations that are gone stay, so that an offset never falls."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.last: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        self.last = self.last | self.ends()
        return dict(self.last)

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.last = dict(end) | {g: max(n, end.get(g, 0)) for g, n in self.last.items()}
        return [p for g, n in end.items() for p in parts_of(g, int(start.get(g, 0)), int(n), self.part_bytes)]

    def commit(self, end: dict) -> None: ...


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLog)


def text_of(value: Column) -> Column:
    """A text, or the text that an array of byte numbers holds up to the first 0."""
    codes = F.from_json(F.when(F.startswith(value, F.lit("[")), value), "array<int>")
    return F.when(codes.isNotNull(), char_array(codes)).otherwise(value)


def events_of(lines: DataFrame, schema: str = events.SCHEMA, texts: tuple[str, ...] = ("comm", "parent_comm")) -> DataFrame:
    """The events of lines; lines that are no events are left out. texts: columns that may come as fixed-width byte arrays."""
    rows = lines.select(F.from_json("line", schema).alias("e")).where("e.event_id is not null and e.ts is not null").select("e.*")
    return rows.withColumns({c: text_of(F.col(c)) for c in texts if c in rows.columns})


def read_log(spark: SparkSession, path: str, since: str | None = None, schema: str = events.SCHEMA, **options) -> DataFrame:
    """Events of a log after ``since``."""
    register(spark)
    rows = events_of(spark.read.format("event_log").options(path=path, **options).load(), schema)
    return rows.where(F.col("ts") > F.lit(since).cast("timestamp")) if since else rows


def stream_log(spark: SparkSession, path: str, late: str = "10 minutes", schema: str = events.SCHEMA, **options) -> DataFrame:
    """The same as a stream, with a watermark on ts."""
    register(spark)
    return events_of(spark.readStream.format("event_log").options(path=path, **options).load(), schema).withWatermark("ts", late)
