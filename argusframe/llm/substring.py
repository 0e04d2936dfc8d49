"""Removal of repeated word sequences, with a count-min sketch that tells first which windows can't repeat.

A window is SPAN consecutive words of one document. Documents are dealt into buckets by a hash of id and text. First pass: a bucket's
distinct windows are entered in a sketch of DEPTH rows of counters, which the bucket sends as sorted counter positions, cut into blocks; the
blocks of all buckets merge by addition, and each bucket learns which of its counters are two or more. A window's estimate is its least counter, so it is never
below the number of buckets that hold the window: what is estimated once is there once, and no repeat is lost. Second pass: only windows that
are estimated repeated, or repeat within their bucket, are grouped by their words (a key of 96 bits), and all but the first place of each go.

The sketch grows with the input and is never in one place: blocks are as wide as BLOCK_WINDOWS windows need, at most, and are merged in a task each. A window that
a third of all documents hold sends one counter and one entry a bucket, so no group is hot. What goes comes back as one row for each shard and
bucket, not for each document.

Null text has no words. Rows without an id lose nothing and count for nothing. A place is (doc_id, start): rows that share an id are judged
each by their own text, and equal places don't precede each other. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import materialize, partitions
from .suffix import joined_runs, repeats_in

U = np.uint64
#: Words of a window, and rows of the sketch.
SPAN, DEPTH = 20, 2
#: Counters for each window, about, and bytes of text that hold a window on average.
COUNTERS, WINDOW_BYTES = 4, 6
#: Windows of a sketch block, and bytes of text for each shard of the second pass, at most.
BLOCK_WINDOWS, SHARD_BYTES = 1 << 25, 64 << 20
#: Bytes of text of a bucket, at least and at most: buckets grow with the corpus, so that what one sends to a block does not become tiny.
BUCKET_BYTES, MOST_BUCKET_BYTES = 4 << 20, 64 << 20
_BASE, _OTHER = U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


class Plan:
    """Sizes that follow the bytes of text."""

    def __init__(self, size: int, tasks: int):
        windows = size // WINDOW_BYTES + 1
        self.blocks = max(tasks, windows // BLOCK_WINDOWS + 1)
        self.width = 1 << max(10, (COUNTERS * windows // self.blocks).bit_length())
        self.shards = max(tasks, size // SHARD_BYTES + 1)
        bucket = min(MOST_BUCKET_BYTES, max(BUCKET_BYTES, size // (1 << 20)))
        self.buckets = size // bucket + 1


class Windows:
    """The windows of a bucket in order of their places: key, row, start and number of the first word; rows are sorted by id."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        ids, row_keys = table.column("doc_id").to_numpy(), table.column("__row").to_numpy()
        order = np.lexsort((row_keys, ids))
        once = np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(row_keys[order]) != 0)] if len(order) else order.astype(bool)
        order = order[once]  # rows that repeat id and text are one
        self.ids, self.row_keys = ids[order], row_keys[order]
        found, hashes, words = [], [], 0
        for a, _, data, offsets in textvec.chunks(table.column("text").cast(pa.large_string()).take(pa.array(order))):
            own, bounds = textvec.word_hashes(data, offsets, lower=False)
            inside = np.maximum(0, np.diff(bounds) - SPAN + 1)
            row = np.repeat(np.arange(len(inside)), inside)
            start = np.arange(len(row)) - np.repeat(np.cumsum(inside) - inside, inside)
            up, down = textvec.powers(len(own) + 1)
            sums = np.zeros(len(own) + 1, U)
            np.cumsum(own * up[:-1], out=sums[1:])
            first = bounds[:-1][row] + start
            found.append((textvec.mix((sums[first + SPAN] - sums[first]) * down[first]), row + a, start, first + words))
            hashes.append(own)
            words += len(own)
        none = np.zeros(0, np.int64)
        self.key, self.row, self.start, self.first = (np.concatenate([none.astype(k), *x]) for k, x in zip((U, *[np.int64] * 3), zip(*found, strict=True) if found else [()] * 4, strict=True))
        self.words = np.concatenate([none.astype(U), *hashes])
        if len(self.ids) > 1 and (np.diff(self.ids) == 0).any():  # places of rows that share an id interleave
            order = np.lexsort((self.start, self.ids[self.row]))
            self.key, self.row, self.start, self.first = (x[order] for x in (self.key, self.row, self.start, self.first))

    def second_key(self, which: np.ndarray) -> np.ndarray:
        """32 more bits of the windows' words, independent of their keys."""
        total = np.zeros(len(which), U)
        for j in range(SPAN):
            total = (total + textvec.mix(self.words[self.first[which] + j] ^ _OTHER)) * _BASE
        return (textvec.mix(total) >> U(32)).astype(np.uint32)


def counters(keys: np.ndarray, depth: int, plan: Plan) -> np.ndarray:
    """block << 32 | position of each key's counter in one row of the sketch."""
    spread = textvec.mix(keys ^ textvec.mix(np.full(1, depth, U)))
    return (((spread >> U(32)) % U(plan.blocks)) << U(32)) | (spread & U(plan.width - 1))


def blocks_of(sorted_counters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, first, last + 1) of sorted counters."""
    block = (sorted_counters >> U(32)).astype(np.int64)
    heads = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    return block[heads], heads, np.r_[heads[1:], len(block)].astype(np.int64)


def enter(table: pa.Table, plan: Plan) -> pa.Table:
    """One bucket's sketch: (sketch block, bucket, counters), a counter for each of its distinct windows in each row of the sketch.

    Sorted positions go as differences with their bytes apart, so that the shuffle's compression takes the zero bytes away."""
    keys = np.unique(Windows(table).key)
    blocks, sent = [], []
    for depth in range(DEPTH):
        at = np.sort(counters(keys, depth, plan))
        for block, a, b in zip(*blocks_of(at), strict=True):
            steps = np.diff((at[a:b] & U(0xFFFFFFFF)).astype(np.int64), prepend=0).astype("<u4")
            blocks.append(depth * plan.blocks + int(block))
            sent.append(steps.view(np.uint8).reshape(-1, 4).T.tobytes())
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * len(blocks), pa.int64()), "counters": pa.array(sent, pa.binary())})


def merge(table: pa.Table, plan: Plan) -> pa.Table:
    """One block of the sketch, added up over all buckets: (bucket, block, bits), a bit for each counter sent, set where the sum is two or more."""
    total, bits = np.zeros(plan.width, np.uint8), []
    positions = lambda sent: np.cumsum(np.frombuffer(sent, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64))
    sent = [x.as_py() for x in table.column("counters")]
    for x in sent:
        at, n = np.unique(positions(x), return_counts=True)
        total[at] = np.minimum(total[at] + n, 2)  # more than two need not be told apart
    for x in sent:
        bits.append(np.packbits(total[positions(x)] >= 2).tobytes())
    return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "bits": pa.array(bits, pa.binary())})


def estimated_repeated(keys: np.ndarray, told: pa.Table, plan: Plan) -> np.ndarray:
    """Of a bucket's distinct keys, those with no counter below two."""
    bits = dict(zip(told.column("block").to_pylist(), told.column("bits").to_pylist(), strict=True))
    out = np.ones(len(keys), bool)
    for depth in range(DEPTH):
        at = counters(keys, depth, plan)
        order = np.argsort(at)
        parts = [np.unpackbits(np.frombuffer(bits[depth * plan.blocks + int(block)], np.uint8), count=int(b - a)) for block, a, b in zip(*blocks_of(at[order]), strict=True)]
        out[order] &= np.concatenate([np.zeros(0, np.uint8), *parts]).astype(bool)
    return out


SECOND = "shard int, bucket long, blob binary, lost binary"
LOST = "bucket long, lost binary"
ENTRY = [("key", np.uint64), ("more", np.uint32), ("row", np.uint32), ("start", np.uint32)]


def lost_runs(ids: np.ndarray, row_keys: np.ndarray, start: np.ndarray) -> bytes:
    """(id, row key, start, stop in words) of the runs that go, packed; overlapping windows of a row are one run."""
    rows, which = np.unique(np.stack([ids, row_keys], axis=1).reshape(-1, 2), axis=0, return_inverse=True)
    which, first, stop = joined_runs(which.ravel(), start, np.full(len(start), SPAN, np.int64))
    return np.stack([rows[which, 0], rows[which, 1], first, stop], axis=1).astype(np.int64).tobytes()


def choose(table: pa.Table, told: pa.Table, plan: Plan) -> pa.Table:
    """One bucket again: a row with what repeats within it (lost), and for each shard the windows estimated repeated elsewhere (blob)."""
    found = Windows(table)
    order = np.argsort(found.key, kind="stable")
    key, row, start = found.key[order], found.row[order], found.start[order]
    first, again = repeats_in(key, found.ids[row], start)
    inner = lost_runs(found.ids[row[again]], found.row_keys[row[again]], start[again])
    asked = estimated_repeated(key[first], told, plan)
    sent = order[~again & asked[np.cumsum(first) - 1]] if len(key) else order
    shard = (textvec.mix(found.key[sent] ^ _OTHER) % U(plan.shards)).astype(np.int64)
    sent, shard = sent[by := np.argsort(shard, kind="stable")], shard[by]
    columns = {"key": found.key[sent], "more": found.second_key(sent), "row": found.row[sent], "start": found.start[sent]}
    blobs = []
    for _, a, b in zip(*blocks_of(shard.astype(U) << U(32)), strict=True):
        rows, at = np.unique(columns["row"][a:b], return_inverse=True)
        parts = [np.array([b - a, len(rows)], np.int64).tobytes(), found.ids[rows].tobytes(), found.row_keys[rows].tobytes()]
        blobs.append(b"".join(parts + [(at if n == "row" else columns[n][a:b]).astype(k).tobytes() for n, k in ENTRY]))
    shards, lost = blocks_of(shard.astype(U) << U(32))[0].tolist(), [inner] if inner else []
    n, m, bucket = len(blobs), len(lost), table.column("bucket")[0].as_py()
    return pa.table({
        "shard": pa.array(shards + [None] * m, pa.int32()), "bucket": pa.array([bucket] * (n + m), pa.int64()), "blob": pa.array(blobs + [None] * m, pa.binary()), "lost": pa.array([None] * n + lost, pa.binary()),
    })


def opened(blob: bytes) -> list[np.ndarray]:
    """key, more, doc_id, __row and start of the entries."""
    n, m = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    ids, row_keys, at, out = np.frombuffer(blob, np.int64, m, 16), np.frombuffer(blob, np.int64, m, 16 + 8 * m), 16 + 16 * m, {}
    for name, kind in ENTRY:
        out[name] = np.frombuffer(blob, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return [out["key"], out["more"], ids[out["row"]], row_keys[out["row"]], out["start"].astype(np.int64)]


def group(table: pa.Table) -> pa.Table:
    """One shard's windows, grouped exactly: (bucket, lost) of those that start earlier elsewhere."""
    found = [opened(x.as_py()) for x in table.column("blob")]
    came = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
    key, more, ids, row_keys, start = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, ids, more, key))
    same = np.cumsum(np.r_[0, (key[order][1:] != key[order][:-1]) | (more[order][1:] != more[order][:-1])])
    gone = order[repeats_in(same, ids[order], start[order])[1]]
    gone = gone[np.argsort(came[gone], kind="stable")]
    heads, buckets = np.searchsorted(came[gone], np.arange(len(found) + 1)), table.column("bucket").to_pylist()
    lost = [(bucket, lost_runs(ids[x], row_keys[x], start[x])) for bucket, a, b in zip(buckets, heads[:-1], heads[1:], strict=True) if len(x := gone[a:b])]
    return pa.table({"bucket": pa.array([x[0] for x in lost], pa.int64()), "lost": pa.array([x[1] for x in lost], pa.binary())})


def find_repeats(docs: DataFrame, plan: Plan) -> DataFrame:
    """(bucket, lost) of what goes, from (bucket, doc_id, __row, text) without null ids; a bucket may have several rows."""
    sketch = docs.groupBy("bucket").applyInArrow(lambda t: enter(t, plan), "block long, bucket long, counters binary")
    told = materialize(sketch.groupBy("block").applyInArrow(lambda t: merge(t, plan), "bucket long, block long, bits binary"), "estimates")
    parts = docs.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(lambda t, b: choose(t, b, plan), SECOND)
    parts = materialize(parts, "windows")
    found = parts.where("shard is not null").select("shard", "bucket", "blob").groupBy("shard").applyInArrow(group, LOST)
    return materialize(found.union(parts.where("lost is not null").select("bucket", "lost")), "repeats")


def apply_runs(docs: DataFrame, id_col: str, text_col: str, schema: str, finish: Callable[[pa.Table, list[np.ndarray]], pa.Table], plan: Plan | None) -> DataFrame:
    """What ``finish`` makes of each bucket's rows of ``docs`` (columns c0, c1, ...) and the runs of words (start, stop) that each of them loses."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    text, key = F.col(at[text_col]).cast("string"), F.col(at[id_col]).cast("long")
    if plan is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
        plan = Plan(size, partitions(docs.sparkSession))
    rows = docs.toDF(*names).withColumns({"doc_id": key, "__row": F.xxhash64(key, text)}).withColumn("bucket", F.pmod("__row", F.lit(plan.buckets)))
    lost = find_repeats(rows.where("doc_id is not null").select("bucket", "doc_id", "__row", F.coalesce(text, F.lit("")).alias("text")), plan)

    def run(table: pa.Table, lost: pa.Table) -> pa.Table:
        runs = np.frombuffer(b"".join(x.as_py() for x in lost.column("lost")), np.int64).reshape(-1, 4)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        heads = np.flatnonzero(np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]) if len(runs) else np.zeros(0, np.int64)
        own = {(int(x[0, 0]), int(x[0, 1])): merged(x[:, 2:]) for x in np.split(runs, heads[1:]) if len(x)}
        none = np.zeros((0, 2), np.int64)
        return finish(table, [own.get(x, none) for x in zip(table.column("doc_id").to_pylist(), table.column("__row").to_pylist(), strict=True)])

    return rows.groupBy("bucket").cogroup(lost.groupBy("bucket")).applyInArrow(run, schema)


def merged(runs: np.ndarray) -> np.ndarray:
    _, start, stop = joined_runs(np.zeros(len(runs), np.int64), runs[:, 0], runs[:, 1] - runs[:, 0])
    return np.stack([start, stop], axis=1)


def kept_words(text: str | None, runs: np.ndarray) -> tuple[int, bytes]:
    """How many words the text has, and those that stay joined by one space."""
    words = (text or "").encode().split()
    edges = [0, *runs.ravel().tolist(), len(words)]
    return len(words), b" ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, removed spans of words) of every row."""
    kind = dict(docs.dtypes)[id_col]

    def finish(table: pa.Table, runs: list[np.ndarray]) -> pa.Table:
        kept = [kept_words(t, r) for t, r in zip(table.column("c1").to_pylist(), runs, strict=True)]
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table({
            id_col: table.column("c0"), "n_words": pa.array([n for n, _ in kept], pa.int64()), "n_removed": pa.array([int((r[:, 1] - r[:, 0]).sum()) for r in runs], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for _, k in kept], pa.string()), "spans": pa.array([[{"start": a, "stop": b} for a, b in r.tolist()] for r in runs], spans),
        })

    own = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text" if id_col == text_col else text_col))
    return apply_runs(own, id_col, text_col, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,stop:long>>", finish, plan)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated words; a text that loses some has its kept words joined by one space, and a row of which none is left goes."""
    at, n = docs.columns.index(text_col), len(docs.columns)

    def finish(table: pa.Table, runs: list[np.ndarray]) -> pa.Table:
        texts = [kept_words(t, r)[1].decode() or None if len(r) else t for t, r in zip(table.column(f"c{at}").to_pylist(), runs, strict=True)]
        columns = [pa.array(texts, pa.string()) if i == at else table.column(f"c{i}") for i in range(n)]
        left = pa.array([t is not None or not len(r) for t, r in zip(texts, runs, strict=True)], pa.bool_())
        return pa.table({f"c{i}": c for i, c in enumerate(columns)}).filter(left)

    schema = ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes))
    return apply_runs(docs, id_col, text_col, schema, finish, None).toDF(*docs.columns)
