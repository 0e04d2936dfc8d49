"""Suffix-array deduplication with a logarithmic index family.

A byte goes if a string of SPAN bytes covers it that also starts earlier in the corpus (smaller id, or the same
document and an earlier start). Suffixes are indexed where every SPAN-byte string must have one: at the smallest
gram hash of each string (a minimiser), so equal strings meet at equal suffixes. An entry stands for a run of
strings with one minimiser, its context; entries are sorted by gram and context.

Corpus-wide, entries are dealt into shards by gram. In a shard each new batch is sorted into a suffix array of its
own, merge-scanned against the levels that exist, and joins them as a new level; levels of one size merge
geometrically. A context that was seen before is removed whole. Contexts that share a gram but differ are settled
string by string in a second family, over the strings' own hashes, from the texts of just those contexts. A gram with
very many contexts is not kept together: its contexts are dealt by their own hash, and then its strings by theirs.

Equal contexts in one batch meet before the shuffle, so a passage that a third of all rows hold sends one entry a
batch. Null text is empty; texts shorter than SPAN lose nothing. Rows without an id lose nothing. Rows that share an id are one
document: what stands at one place of them isn't its own repeat, and what goes goes from each of them. Other columns pass through.

The family lives for one run over one table: no level is kept afterwards, so a later batch is judged by a run over both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import materialize, maybe_in, partitions, small_batches

U = np.uint64
#: Bytes of a string, and of the grams that minimisers are chosen by.
SPAN, GRAM = 100, 32
#: Bytes of text for each shard, at most, and at least where there are fewer shards than shuffle partitions.
SHARD_BYTES, LEAST_SHARD_BYTES = 12 << 20, 1 << 20
#: A gram with so many contexts is dealt by context and string; counted are chunks where it has OFTEN contexts at least.
HOT, OFTEN = 4096, 8
#: Entries of one group of such contexts or strings, and of one blob.
GROUP_ENTRIES, BLOB_ENTRIES = 1 << 19, 60_000
ENTRY = [("gram", np.uint32), ("context", np.uint64), ("row", np.uint16), ("start", np.uint32), ("length", np.uint8)]


def repeats_in(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries sorted by key and place: which are the first of their key, and which repeat it at another place."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    first = np.r_[True, key[1:] != key[:-1]]
    head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    return first, (doc != doc[head]) | (start != start[head])


class Family:
    """Sorted levels of (key, doc, start, length, gram), each key once with its earliest place."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []
        self.later: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, key: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, gram: np.ndarray) -> None:
        """Takes a batch; what it repeats, or what is repeated by it from an earlier place, goes to ``later``."""
        order = np.lexsort((start, doc, key))
        new = [x[order] for x in (key, doc, start, length, gram)]
        if not len(order):
            return
        first, again = repeats_in(*new[:3])
        self.note(new, again)
        new = [x[first] for x in new]
        for level in self.levels:
            at = np.minimum(np.searchsorted(level[0], new[0]), len(level[0]) - 1)
            hit = level[0][at] == new[0]
            if not hit.any():
                continue
            own, old = np.flatnonzero(hit), at[hit]
            before = (new[1][own] < level[1][old]) | ((new[1][own] == level[1][old]) & (new[2][own] < level[2][old]))
            same = (new[1][own] == level[1][old]) & (new[2][own] == level[2][old])
            self.note(new, own[~before & ~same])
            self.note(level, old[before])
            for i in (1, 2):
                level[i][old[before]] = new[i][own[before]]
            new = [x[~hit] for x in new]
        if len(new[0]):
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            a, b = self.levels.pop(), self.levels.pop()
            both = [np.concatenate([x, y]) for x, y in zip(b, a, strict=True)]
            order = np.argsort(both[0], kind="stable")
            self.levels.append([x[order] for x in both])

    def note(self, of: list[np.ndarray], which: np.ndarray) -> None:
        if which.any() if which.dtype == bool else len(which):
            self.later.append((of[1][which].copy(), of[2][which].copy(), of[3][which].copy()))

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, start, length) of all that was seen earlier."""
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate([empty, *[x[i].astype(np.int64) for x in self.later]]) for i in range(3))

    def ambiguous(self) -> tuple[np.ndarray, ...]:
        """(doc, start, length, gram) of entries whose gram has other contexts too."""
        if not self.levels:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        doc, start, length, gram = (np.concatenate([x[i] for x in self.levels]).astype(np.int64) for i in range(1, 5))
        order = np.argsort(gram, kind="stable")
        same = gram[order][1:] == gram[order][:-1]
        keep = order[np.r_[False, same] | np.r_[same, False]]
        return doc[keep], start[keep], length[keep], gram[keep]


def entries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, gram, context, minimiser) of each run of strings with one minimiser."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < SPAN:
        return none
    sums = textvec.prefix_sums(data)
    _, down = textvec.powers(len(sums))
    grams = textvec.mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM])
    low = U(0xFFFFFFFF)
    least = (grams & ~low) | np.arange(len(grams), dtype=U)
    width, reached = SPAN - GRAM + 1, 1
    while reached < width:
        step = min(reached, width - reached)
        least = np.minimum(least[:-step], least[step:])
        reached += step
    at = (least & low).astype(np.int64)  # of each string's start, its minimiser
    valid = np.zeros(len(at), bool)
    row = np.zeros(len(at), np.int64)
    sizes = np.diff(offsets)
    inside = np.maximum(0, sizes - SPAN + 1)
    index = np.arange(int(inside.sum())) - np.repeat(np.cumsum(inside) - inside, inside) + np.repeat(offsets[:-1], inside)
    valid[index] = True
    row[index] = np.repeat(np.arange(len(sizes)), inside)
    begin = valid.copy()
    begin[1:] &= (at[1:] != at[:-1]) | ~valid[:-1] | (row[1:] != row[:-1])
    end = valid.copy()
    end[:-1] &= (at[1:] != at[:-1]) | ~valid[1:] | (row[1:] != row[:-1])
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    if not len(first):
        return none
    context = textvec.mix(textvec.span_hashes(sums, first, last + SPAN) + (at[first] - first).astype(U))
    return row[first], first - offsets[row[first]], last - first + SPAN, grams[at[first]], context, at[first] - first


PARTS = "shard int, blob binary, doc_id long, runs binary, gram long, n long"


def part(**columns: np.ndarray | list) -> pa.RecordBatch:
    """A batch of PARTS; columns that aren't given are null."""
    kinds = {x.split()[0]: {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in PARTS.split(", ")}
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[n], k) if n in columns else pa.nulls(size, k) for n, k in kinds.items()], names=list(kinds))


def dealt(shard: np.ndarray, doc: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """(shard, blob) of entries."""
    order = np.argsort(shard, kind="stable")
    shard, doc, columns = shard[order].astype(np.int32), doc[order], {n: x[order] for n, x in columns.items()}
    heads = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]] | (np.arange(len(shard)) % BLOB_ENTRIES == 0))
    blobs = []
    for x, y in zip(heads, np.r_[heads[1:], len(shard)], strict=True):
        used, row = np.unique(doc[x:y], return_inverse=True)
        parts = [np.array([y - x, len(used)], np.int64).tobytes(), used.astype(np.int64).tobytes()]
        blobs.append(b"".join(parts + [(row if n == "row" else columns[n][x:y]).astype(t).tobytes() for n, t in ENTRY]))
    return part(shard=shard[heads], blob=blobs)


def packed(doc: np.ndarray, *columns: np.ndarray) -> dict[str, list]:
    """doc_id and runs: each document's rows of the columns as int64, for rows sorted by document."""
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    rows = np.stack(columns, axis=1).astype(np.int64)
    return {"doc_id": doc[heads], "runs": [x.tobytes() for x in np.split(rows, heads[1:])] if len(doc) else []}


def unpacked(runs: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(runs), np.int64).reshape(-1, width)


def sample(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): a chunk's entries for a shard; (doc_id, runs): what of a document repeats within the chunk; and (gram, n) of grams with many contexts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, data, offsets in textvec.chunks(batch.column(1)):
                row, start, length, gram, context, _ = entries(data, offsets)
                if not len(row):
                    continue
                doc = ids[a:b]
                order = np.lexsort((start, doc[row], context))
                first, again = repeats_in(context[order], doc[row[order]], start[order])
                lost, kept = order[again], order[first]
                yield part(**packed(*joined_runs(doc[row[lost]], start[lost], length[lost])))
                shard, low = (gram[kept] >> U(32)) % U(shards), gram[kept] & U(0xFFFFFFFF)
                yield dealt(shard, doc[row[kept]], gram=low, context=context[kept], start=start[kept], length=length[kept])
                found, n = np.unique((shard << U(32)) | low, return_counts=True)
                yield part(gram=found[n >= OFTEN].astype(np.int64), n=n[n >= OFTEN])

    return docs.mapInArrow(run, PARTS)


def opened(blob: bytes) -> dict[str, np.ndarray]:
    n, m = np.frombuffer(blob, np.int64, 2)
    ids, at, out = np.frombuffer(blob, np.int64, m, 16), 16 + 8 * int(m), {}
    for name, kind in ENTRY:
        out[name] = np.frombuffer(blob, kind, n, at)
        at += int(n) * np.dtype(kind).itemsize
    out["doc"] = ids[out["row"]]
    return out


def joined_runs(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, stop): overlapping or touching runs of a document become one."""
    if not len(doc):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], (start + length)[order]
    base = np.cumsum(np.r_[0, doc[1:] != doc[:-1]]) << 40
    far = np.maximum.accumulate(base + stop)
    heads = np.flatnonzero(np.r_[True, base[1:] + start[1:] > far[:-1]])
    ends = far[np.r_[heads[1:] - 1, len(doc) - 1]] - base[heads]
    return doc[heads], start[heads], ends


def hot_grams(parts: DataFrame) -> np.ndarray:
    """shard << 32 | gram of the grams with very many contexts: at most one for each HOT entries, so few."""
    counts = parts.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    return np.sort(np.array([r.gram for r in counts.select("gram").collect()], np.int64))


def spread(parts: DataFrame, hot: np.ndarray, shards: int, groups: int) -> DataFrame:
    """(shard, blob) with the entries of hot grams dealt by context to shards of their own, from ``shards`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = opened(blob.as_py())
                del x["row"]
                is_hot = np.isin((shard << 32) | x["gram"].astype(np.int64), hot)
                if not is_hot.any():
                    yield part(shard=[shard], blob=[blob.as_py()])
                    continue
                held.append({n: v[is_hot] for n, v in x.items()})
                if not is_hot.all():
                    yield dealt(np.full(int((~is_hot).sum()), shard), **{n: v[~is_hot] for n, v in x.items()})
            if held:
                x = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                yield dealt(U(shards) + x["context"] % U(groups), **x)

    return parts.select("shard", "blob").mapInArrow(run, PARTS).select("shard", "blob")


SETTLED = "doc_id long, kind int, runs binary"
#: Kinds: runs that go; contexts to settle string by string, with the shard for that; contexts of hot grams.
GONE, UNSURE, HOT_ONES = 0, 1, 2


def settled_table(kind: int, doc: np.ndarray, *columns: np.ndarray) -> pa.Table:
    found = packed(doc, *columns)
    return pa.table({"doc_id": pa.array(found["doc_id"], pa.int64()), "kind": pa.array([kind] * len(found["runs"]), pa.int32()), "runs": pa.array(found["runs"], pa.binary())})


def settle_contexts(table: pa.Table, shards: int) -> pa.Table:
    """One shard: of each document the runs that go (start, stop), and the contexts that are still to be settled (start, stop, shard)."""
    family = Family()
    for blob in table.column("blob"):
        x = opened(blob.as_py())
        family.add(x["context"], x["doc"], x["start"].astype(np.int64), x["length"].astype(np.int64), x["gram"])
    out = [settled_table(GONE, *joined_runs(*family.repeated()))]
    if table.column("shard")[0].as_py() < shards:
        doc, start, length, gram = family.ambiguous()
        order = np.argsort(doc, kind="stable")
        shard = (textvec.mix(gram.astype(U)) % U(shards)).astype(np.int64)
        out.append(settled_table(UNSURE, *(x[order] for x in (doc, start, start + length, shard))))
    else:
        doc, start, length = (np.concatenate([x[i] for x in family.levels]).astype(np.int64) for i in (1, 2, 3))
        order = np.argsort(doc, kind="stable")
        out.append(settled_table(HOT_ONES, *(x[order] for x in (doc, start, start + length))))
    return pa.concat_tables(out)


def strings_of(rows: DataFrame) -> DataFrame:
    """(shard, doc_id, start, bytes) of the contexts asked for, from (doc_id, text, wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, docs, starts, cut = [], [], [], []
            for doc, text, wanted in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = (text or "").encode()
                for start, stop, shard in unpacked(wanted, 3).tolist():
                    shards.append(shard)
                    docs.append(doc)
                    starts.append(start)
                    cut.append(data[start:stop])
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(cut, pa.binary())], names=["shard", "doc_id", "start", "bytes"])

    return rows.mapInArrow(run, "shard int, doc_id long, start long, bytes binary")


def hot_strings(rows: DataFrame, groups: int) -> DataFrame:
    """(shard, blob) of the strings of the contexts asked for, dealt by string, from (doc_id, text, wanted); and (doc_id, runs) of those that repeat within a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, starts, cut = [], [], []
            for doc, text, wanted in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = (text or "").encode()
                for start, stop in unpacked(wanted, 2).tolist():
                    docs.append(doc)
                    starts.append(start)
                    cut.append(data[start:stop])
            for at in range(0, len(cut), 4096):
                keys, doc, start = string_keys(cut[at : at + 4096], np.array(docs[at : at + 4096]), np.array(starts[at : at + 4096]))
                order = np.lexsort((start, doc, keys))
                first, again = repeats_in(keys[order], doc[order], start[order])
                lost, kept = order[again], order[first]
                yield part(**packed(*joined_runs(doc[lost], start[lost], np.full(len(lost), SPAN))))
                same = np.full(len(kept), SPAN)
                yield dealt(keys[kept] % U(groups), doc[kept], gram=np.zeros(len(kept)), context=keys[kept], start=start[kept], length=same)

    return rows.mapInArrow(run, PARTS)


def settle_hot(table: pa.Table) -> pa.Table:
    """One group of hot grams' strings: (doc_id, runs) of those that start earlier elsewhere."""
    family = Family()
    for blob in table.column("blob"):
        x = opened(blob.as_py())
        family.add(x["context"], x["doc"], x["start"].astype(np.int64), x["length"].astype(np.int64), x["gram"])
    return settled_table(GONE, *joined_runs(*family.repeated())).drop_columns(["kind"])


def string_keys(cut: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc, start) of each string of the contexts."""
    sizes = np.array([len(x) for x in cut], np.int64)
    data = np.frombuffer(b"".join(cut), np.uint8)
    inside = np.maximum(0, sizes - SPAN + 1)
    shift = np.arange(int(inside.sum())) - np.repeat(np.cumsum(inside) - inside, inside)
    at = shift + np.repeat(np.cumsum(sizes) - sizes, inside)
    return textvec.span_hashes(textvec.prefix_sums(data), at, at + SPAN), np.repeat(docs, inside), np.repeat(starts, inside) + shift


def settle_strings(table: pa.Table) -> pa.Table:
    """One shard's contexts: (doc_id, runs) of the strings that start earlier elsewhere."""
    family = Family()
    for batch in table.to_batches(4096):
        keys, doc, start = string_keys(batch.column("bytes").to_pylist(), *(batch.column(c).to_numpy() for c in ("doc_id", "start")))
        family.add(keys, doc, start, np.full(len(keys), SPAN, np.int64), np.zeros(len(keys), np.int64))
    return settled_table(GONE, *joined_runs(*family.repeated())).drop_columns(["kind"])


def union_of(runs: list[bytes] | None, size: int) -> np.ndarray:
    """Maximal removed runs (start, stop) of one text of ``size`` bytes."""
    found = unpacked(runs or [], 2)
    _, start, stop = joined_runs(np.zeros(len(found), np.int64), found[:, 0], found[:, 1] - found[:, 0])
    found = np.minimum(np.stack([start, stop], axis=1), size)
    return found[found[:, 0] < found[:, 1]]


def find_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, runs) of what goes, from (doc_id, text); a document may have several rows."""
    spark, docs = docs.sparkSession, docs.where("doc_id is not null")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, size // SHARD_BYTES, min(partitions(spark), size // LEAST_SHARD_BYTES))
    both = materialize(sample(docs, shards), "entries")
    found = both.where("doc_id is not null").select("doc_id", "runs")
    dealt_out, hot = both.where("shard is not null").select("shard", "blob"), hot_grams(both)
    if len(hot):
        entries_of = both.join(F.broadcast(spark.createDataFrame([(int(x),) for x in hot], "gram long")), "gram").agg(F.sum("n")).first()[0]
        dealt_out = spread(dealt_out, hot, shards, 1 + entries_of // GROUP_ENTRIES)
    settled = materialize(dealt_out.groupBy("shard").applyInArrow(lambda table: settle_contexts(table, shards), SETTLED), "contexts")
    found = found.union(settled.where(F.col("kind") == GONE).select("doc_id", "runs"))

    def texts(kind: int) -> DataFrame:
        asked = settled.where(F.col("kind") == kind)
        rows = maybe_in(docs, "doc_id", asked).where("__maybe").select("doc_id", "text")
        return rows.join(asked.groupBy("doc_id").agg(F.collect_list("runs").alias("wanted")), "doc_id").select("doc_id", "text", "wanted")

    found = found.union(strings_of(texts(UNSURE)).groupBy("shard").applyInArrow(settle_strings, "doc_id long, runs binary"))
    if len(hot):
        strings = settled.where(F.col("kind") == HOT_ONES).agg(F.coalesce(F.sum(F.octet_length("runs")), F.lit(0))).first()[0] // 16 * (SPAN - GRAM + 1)
        parts = materialize(hot_strings(texts(HOT_ONES), 1 + strings // GROUP_ENTRIES), "strings")
        found = found.union(parts.where("doc_id is not null").select("doc_id", "runs"))
        found = found.union(parts.where("shard is not null").select("shard", "blob").groupBy("shard").applyInArrow(settle_hot, "doc_id long, runs binary"))
    return materialize(found, "repeats")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with __runs, the removed runs (packed and unmerged), or null."""
    small_batches(docs.sparkSession)
    repeats = find_repeats(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    runs = repeats.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("runs").alias("__runs"))
    rows = maybe_in(docs.withColumn("__id", F.col(id_col).cast("long")), "__id", repeats)
    touched = rows.where("__maybe").join(runs, "__id", "left")
    clean = rows.where("not __maybe").withColumn("__runs", F.lit(None).cast("array<binary>"))
    return touched.select(*docs.columns, "__runs").unionByName(clean.select(*docs.columns, "__runs"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed spans) of every row."""
    kind = dict(docs.dtypes)[id_col]
    rows = mark(docs.select(id_col, text_col), id_col, text_col)
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                cut = union_of(runs, len(data))
                edges = [0, *cut.ravel().tolist(), len(data)]
                digest = hashlib.sha256()
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    digest.update(data[a:b])
                out.append((len(data), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), digest.hexdigest(), [{"start": a, "stop": b} for a, b in cut.tolist()]))
            n, removed, spans, sha, where = zip(*out, strict=True) if out else ([],) * 5
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(where, kinds)], names=[x.strip("`") for x in (id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")])

    return rows.mapInArrow(run, schema)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what repeats cut from its texts; characters that a cut leaves incomplete go too, and rows of which nothing is left."""
    rows = mark(docs, id_col, text_col)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if runs and text:
                    data = text.encode()
                    edges = [0, *union_of(runs, len(data)).ravel().tolist(), len(data)]
                    text = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "ignore") or None
                    out.append((text, text is not None))
                else:
                    out.append((text, True))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array([x[0] for x in out], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([x[1] for x in out], pa.bool_()))

    return rows.mapInArrow(run, docs.schema)
