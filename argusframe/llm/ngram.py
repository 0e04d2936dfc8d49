"""Exact n-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows are documents, columns n-gram hashes. Documents with equal sets collapse to one node first. A product column
matters for a pair only if both documents have it among the first elements of their sets under one global order, as
many as the threshold and the set's size imply (prefix bound); columns that few or no others share there drop out.
The order puts n-grams that very many documents share last, so common passages make no product columns. Pairs below
bounds from the sizes of the two sets, or from the parity bits of their elements (a lower bound of the symmetric
difference), are discarded; the rest are counted exactly on whole sets.

Links are what components need. In rounds, each column proposes a forest of its likeliest pairs over the components
so far; the pairs are counted, links join components, and pairs that don't link aren't proposed again. A column
proposes, block by block, a fixed number of pairs a component and of these a node's likeliest are counted, so a group of many near copies never costs all its pairs. Rounds
end when no column has a pair left between two components: no link between components is skipped, and the result is
the exact partition into connected components.

Null text is empty; documents without words have an empty set and no links. Rows with one id are one document: they
share a component. Other columns are ignored. Words of any length and texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact, textvec
from .common import materialize, maybe_in, partitions, small_batches

U = np.uint64
#: Parity bits of a set: the power of two from its size up (from WIDE times its size, once few columns are left), and these
#: at least and at most. Wider ones fold onto narrower ones.
LEAST_BITS, MOST_BITS, WIDE = 512, 1 << 20, 16
#: Pairs of a component in a column, and of a node, that are taken in the first round and in later ones, the likeliest.
BEST, LATER = 2, 256
#: Counted occurrences from which an n-gram goes last in the order, and how many such n-grams the tasks are sent at most
#: (both only move work, since any one order gives the same links).
COMMON, MOST_COMMON = 200, 1 << 20
#: Rows of a column up to which all its passing pairs are proposed at once.
FEW = 16
#: The part of the hash range, from 0, in which common n-grams are looked for, and entries that a task holds of it.
LOW, HELD = U(int(0.4 * 2**64)), 1 << 19
#: Bytes of text that a task hashes at once.
CHUNK_BYTES = 1 << 20

def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in textvec.chunks(column, CHUNK_BYTES):
        yield from textvec.shingle_sets(*textvec.word_hashes(data, offsets), k)


class Heavy:
    """Counts of the hashes that come up most in one task."""

    def __init__(self):
        self.keys, self.counts, self.wait, self.size = np.zeros(0, U), np.zeros(0, np.int64), [], 0

    def add(self, found: np.ndarray) -> None:
        self.wait.append(found[: np.searchsorted(found, LOW)])
        self.size += len(self.wait[-1])
        if self.size > 2 * HELD:
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *self.wait])
        weights = np.concatenate([self.counts, np.ones(self.size, np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[at], np.add.reduceat(weights, at) if len(at) else weights
        least = 1
        while len(keys) > HELD:
            least += 1
            keep = counts >= least
            keys, counts = keys[keep], counts[keep]
        self.keys, self.counts, self.wait, self.size = keys, counts, [], 0


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, key) per document, and (hash, times) per common n-gram of a task in rows of their own."""
    schema = "own boolean, doc_id long, n long, key binary, hash long, times long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = Heavy()
        for batch in batches:
            n, keys = [], []
            for found in sets_of(batch.column(1), k):
                n.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                heavy.add(found)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(n), pa.bool_()), batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), none, none], names=names)
        heavy.settle()
        often = heavy.counts >= 4
        none = pa.nulls(int(often.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([False] * len(none), pa.bool_()), none, none, pa.nulls(len(none), pa.binary()), pa.array(heavy.keys[often].view(np.int64)), pa.array(heavy.counts[often])], names=names)

    return docs.mapInArrow(run, schema)


def parity(found: np.ndarray, times: int = 1) -> bytes:
    width = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, times * len(found) - 1).bit_length()))
    bits = np.bincount((found & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


class Parities:
    """Parity bits of many sets; ``apart`` bounds from below by how much two sets differ."""

    def __init__(self, raw: list[bytes]):
        self.width = np.array([len(x) // 8 for x in raw], np.int64)
        self.at, self.kept = np.zeros(len(raw), np.int64), {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.at[own] = np.arange(len(own))
            self.kept[w, w] = np.frombuffer(b"".join([raw[i] for i in own]), np.uint64).reshape(-1, w)

    def folded(self, w: int, to: int) -> np.ndarray:
        if (w, to) not in self.kept:
            wide = self.folded(w, 2 * to)
            self.kept[w, to] = wide[:, :to] ^ wide[:, to:]
        return self.kept[w, to]

    def apart(self, x: np.ndarray, other: Parities, y: np.ndarray, fold: int = 1) -> np.ndarray:
        """fold: so many times fewer bits are looked at, which is faster and bounds less well."""
        out = np.zeros(len(x), np.int64)
        for w in np.unique(self.width[x]).tolist():
            for v in np.unique(other.width[y]).tolist():
                own = np.flatnonzero((self.width[x] == w) & (other.width[y] == v))
                to = max(LEAST_BITS // 64, min(w, v) // fold)
                one, two = self.folded(w, to), other.folded(v, to)
                for part in np.array_split(own, 1 + len(own) * to // (1 << 20)):
                    out[part] = np.bitwise_count(one[self.at[x[part]]] ^ two[other.at[y[part]]]).sum(axis=1, dtype=np.int64)
        return out


def prefixes(docs: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """(doc_id, n, prefix, bits): the first elements under the order (common last, then by hash), and parity bits."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(common)  # at most MOST_COMMON hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = sent.value
        for batch in batches:
            n, heads, bits = [], [], []
            for found in sets_of(batch.column(1), k):
                size = len(found)
                length = size - -(-percent * size // 100) + 1 if size else 0
                if len(last):
                    at = np.minimum(np.searchsorted(last, found), len(last) - 1)
                    behind = last[at] == found
                    head = np.concatenate([found[~behind], found[behind]])[:length] if behind.any() else found[:length]
                else:
                    head = found[:length]
                n.append(size)
                heads.append(head.tobytes())
                bits.append(parity(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *[pa.array(x, pa.binary()) for x in (heads, bits)]], names=["doc_id", "n", "prefix", "bits"])

    return docs.mapInArrow(run, "doc_id long, n long, prefix binary, bits binary")


def columns_of(nodes: DataFrame) -> DataFrame:
    """(hash, n, node): the prefix elements of each node, one to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            sizes = [len(h) for h in heads]
            if sum(sizes):
                n, node = (np.repeat(batch.column(i).to_numpy(), sizes) for i in (1, 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), pa.array(n), pa.array(node)], names=["hash", "n", "node"])

    return nodes.select("node", "n", "prefix").mapInArrow(run, "hash long, n long, node long")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal first columns, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        first = batch.column(0).to_numpy()
        cut = int(np.searchsorted(first, first[-1]))
        if cut or (held and held[-1].column(0)[-1].as_py() != first[0]):
            held.append(batch.slice(0, cut))
            if not cut:
                held.pop()
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x.view(U) + U(salt)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shared_columns(columns: DataFrame) -> DataFrame:
    """The rows whose column has two nodes or more, of columns with the same nodes one: the others would propose the same pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            h = t.column(0).to_numpy()
            same = h[1:] == h[:-1]
            t = t.filter(pa.array(np.r_[False, same] | np.r_[same, False])).combine_chunks()
            if not len(t):
                continue
            h, node = t.column(0).to_numpy(), t.column(2).to_numpy()
            first = np.r_[True, h[1:] != h[:-1]]
            starts = np.flatnonzero(first)
            members = np.stack([np.add.reduceat(mixed(node, salt), starts) for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)], axis=1)
            once = np.zeros(len(starts), bool)
            once[np.unique(members, axis=0, return_index=True)[1]] = True
            lengths = np.diff(np.r_[starts, len(h)])
            marks = [pa.array(np.repeat(members[:, i].view(np.int64), lengths), mask=~first) for i in (0, 1)]
            t = t.append_column("one", marks[0]).append_column("two", marks[1])
            yield from t.filter(pa.array(np.repeat(once, lengths))).combine_chunks().to_batches()

    rows = columns.repartition(partitions(columns.sparkSession), "hash").sortWithinPartitions("hash").mapInArrow(run, "hash long, n long, node long, one long, two long")
    rows = materialize(rows, "shared")  # the marks of a column's nodes are at its first row
    once = rows.where("one is not null").groupBy("one", "two").agg(F.min("hash").alias("hash")).select("hash")
    return rows.join(once, "hash", "left_semi").select("hash", "n", "node")


def passing(x: np.ndarray, y: np.ndarray, n: np.ndarray, bits: Parities, percent: int, later: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which row pairs can link by sizes and parity bits, and their room: how much more they could differ."""
    room = n[x] + n[y] - bits.apart(x, bits, y, WIDE if later else 1) - 2 * least_overlap(n[x], n[y], percent)
    if later and len(own := np.flatnonzero(room >= 0)):
        room[own] = n[x[own]] + n[y[own]] - bits.apart(x[own], bits, y[own]) - 2 * least_overlap(n[x[own]], n[y[own]], percent)
    return room >= 0, room / np.maximum(1, n[y])


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection at which sets of these sizes link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def crossing(columns: DataFrame, bits: DataFrame, parts: DataFrame | None, rejected: DataFrame | None, percent: int) -> DataFrame:
    """(hash, a, b, room): pairs of different components that share a column, pass the bounds from sizes and parity bits and weren't
    rejected: in each column a forest over the components that such pairs connect, of the likeliest pairs."""
    spark, rows, later = columns.sparkSession, columns, parts is not None
    if parts is not None:
        rows = rows.join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("part", F.coalesce("part", "node"))
        rows = rows.join(rows.groupBy("hash").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("hash"), "hash")
    else:
        rows = rows.withColumn("part", F.col("node"))
    rows = rows.join(bits, "node")
    if rejected is not None:
        rows = rows.join(rejected.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("no")), "node", "left")
    else:
        rows = rows.withColumn("no", F.lit(None).cast("array<bigint>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            h, n, node, part = (t.column(i).to_numpy() for i in range(4))
            bits, no = Parities(t.column(4).to_pylist()), t.column(5).to_pylist()
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            ends = np.r_[starts[1:], len(h)]
            found: list[np.ndarray] = [few(h, np.repeat(ends - starts <= FEW, ends - starts), n, node, part, bits, no, percent, later)]
            for a, b in zip(starts[ends - starts > FEW], ends[ends - starts > FEW], strict=True):
                found += forest(a, b, n, node, part, bits, no, percent, later)
            x, y = np.concatenate(found, axis=1)
            _, room = passing(x, y, n, bits, percent, later)
            pairs = [pa.array(h[x]), pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y])), pa.array(room)]
            yield pa.RecordBatch.from_arrays(pairs, names=["hash", "a", "b", "room"]).filter(pa.array(node[x] != node[y]))

    rows = rows.select("hash", "n", "node", "part", "bits", "no").repartition(partitions(spark), "hash").sortWithinPartitions("hash", "n", "node")
    return rows.mapInArrow(run, "hash long, a long, b long, room double")


def likeliest(proposed: DataFrame, most: int) -> DataFrame:
    """(a, b): of each node the ``most`` likeliest pairs that were proposed."""
    pairs = proposed.groupBy("a", "b").agg(F.max("room").alias("room"))
    ends = pairs.select("*", F.explode(F.array("a", "b")).alias("u"))
    best = ends.groupBy("u").agg(F.slice(F.sort_array(F.collect_list(F.struct("room", "a", "b")), asc=False), 1, most).alias("x"))
    return best.select(F.explode("x").alias("x")).select("x.a", "x.b").distinct()


def few(h: np.ndarray, small: np.ndarray, n: np.ndarray, node: np.ndarray, part: np.ndarray, bits: Parities, no: list, percent: int, later: bool) -> np.ndarray:
    """Row pairs (2, m) of the columns with at most FEW rows that pass all bounds, for all these columns at once."""
    found = [np.zeros((2, 0), np.int64)]
    for d in range(1, FEW):
        at = np.flatnonzero((h[d:] == h[:-d]) & small[d:] & (part[d:] != part[:-d]) & (100 * n[:-d] >= percent * n[d:])) if len(h) > d else []
        if not len(at):
            continue
        found.append(np.stack([at, at + d])[:, passing(at, at + d, n, bits, percent, later)[0]])
    pairs = np.concatenate(found, axis=1)
    refused = [i for i, (x, y) in enumerate(pairs.T.tolist()) if node[y] in (no[x] or ()) or node[x] in (no[y] or ())]
    return np.delete(pairs, refused, axis=1)


def united(label: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Labels (numbers below how many there are) after the pairs' labels became one; the rows are relabelled once for all pairs."""
    up = np.arange(len(label))
    for u, v in zip(one.tolist(), two.tolist(), strict=True):
        while up[u] != u:
            up[u] = up[up[u]]
            u = up[u]
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        up[max(u, v)] = min(u, v)
    while (up[up] != up).any():
        up = up[up]
    return up[label]


def forest(a: int, b: int, n: np.ndarray, node: np.ndarray, part: np.ndarray, bits: Parities, no: list, percent: int, later: bool) -> Iterator[np.ndarray]:
    """Row pairs (2, m) of one column, rows a to b sorted by size: block by block of the product, for each component the
    likeliest pairs to another, until the block's passing pairs are all within what pairs so far connect. In later rounds few
    pairs pass and most of them don't link: what they connect counts for their own block only, so that fewer rounds are needed."""
    label = own = np.unique(part[a:b], return_inverse=True)[1]
    place = {int(x): i for i, x in enumerate(node[a:b])} if any(no[a:b]) else {}
    refused = np.array([i * (b - a) + place[y] for i, row in enumerate(no[a:b]) for y in row or () if y in place], np.int64)
    refused = np.r_[refused, refused % (b - a) * (b - a) + refused // (b - a)] if len(refused) else refused
    for i in range(a, b - 1, 256):
        j = min(i + 256, b)
        label = own.copy() if later else label
        to = a + int(np.searchsorted(n[a:b], n[j - 1] * 100 // percent, "right"))
        left, right = np.arange(i, j), np.arange(i + 1, to)
        ok = (right[None, :] > left[:, None]) & (100 * n[left][:, None] >= percent * n[right][None, :]) & (label[left - a][:, None] != label[right - a][None, :])
        x, y = np.nonzero(ok)
        if not len(x):
            continue
        x, y = left[x], right[y]
        near, room = passing(x, y, n, bits, percent, later)
        if len(refused):
            near &= ~np.isin((x - a) * (b - a) + y - a, refused)
        x, y, room = x[near], y[near], room[near]
        while len(x):
            order = np.lexsort((-room, label[y - a]))
            group = label[y[order] - a]
            heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            rank = np.arange(len(group)) - np.repeat(heads, np.diff(np.r_[heads, len(group)]))
            chosen = order[rank < (LATER if later else BEST)]
            yield np.stack([x[chosen], y[chosen]])
            label = united(label, label[x[chosen] - a], label[y[chosen] - a])
            apart = label[x - a] != label[y - a]
            x, y, room = x[apart], y[apart], room[apart]


def from_sets(docs: DataFrame, ids: DataFrame, k: int, value: Callable[[np.ndarray], bytes], most: int) -> DataFrame:
    """(doc_id, found): a value of each set, for the given ids (``most`` at most), from their texts."""
    ids = materialize(ids.distinct(), "asked", most)
    texts = maybe_in(docs, "doc_id", ids).where("__maybe").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([value(x) for x in sets_of(batch.column(1), k)], pa.binary())], names=["doc_id", "found"])

    return texts.mapInArrow(run, "doc_id long, found binary").join(ids, "doc_id", "left_semi")


def count_links(pairs: DataFrame, docs: DataFrame, k: int, percent: int, most: int) -> DataFrame:
    """(a, b, linked): the product's entries (``most`` at most) on whole sets, read again from the texts of the pairs' nodes."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    sets = from_sets(docs, ids, k, lambda x: x.tobytes(), 2 * most)
    sets = sets.dropDuplicates(["doc_id"])
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(one) > len(two):
                    one, two = two, one
                both = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return both.mapInArrow(run, "a long, b long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(id, part): the smallest id that each linked id reaches. Labels spread along links and jump; each round is written out."""
    ways = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "ways", 2 * links.count())
    n = ways.count()
    labels = materialize(ways.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("part")), "labels", n)
    while True:
        near = ways.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("part").alias("near"))
        step = labels.join(near, "id").select("id", "part", F.least("part", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("part").alias("far"))
        step = materialize(step.join(jump, "new", "left").select("id", "part", F.least("new", F.coalesce("far", "new")).alias("new")), "labels", n)
        labels = step.select("id", F.col("new").alias("part"))
        if step.where("new <> part").isEmpty():
            return labels


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` after more links: only the components at their ends are worked on."""
    part_of = lambda end: parts.withColumnsRenamed({"id": end, "part": f"{end}_part"})
    ends = links.join(part_of("a"), "a", "left").join(part_of("b"), "b", "left")
    moved = components(ends.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")))
    old = parts.join(moved.toDF("part", "to"), "part", "left").select("id", F.coalesce("to", "part").alias("part"))
    return materialize(old.union(moved.join(parts, "id", "left_anti").select("id", "part")), "parts", parts.count() + moved.count())


def link(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = materialize(profiles(docs, k), "profiles")
    own = seen.where("own").select("doc_id", "n", "key")
    often = seen.where("not own").groupBy("hash").agg(F.sum("times").alias("times")).where(F.col("times") >= COMMON).orderBy(F.desc("times"), "hash").limit(MOST_COMMON).select("hash").toPandas()
    common = np.sort(often["hash"].to_numpy(np.int64).view(U)) if len(often) else np.zeros(0, U)
    own = exact.assign(own, F.col("doc_id"), ["key", "n"]).select("doc_id", "n", F.when(F.col("n") > 0, F.col("__keep")).otherwise(F.col("doc_id")).alias("node"))
    own = materialize(own, "nodes")
    ids = own.where("n > 0 and node = doc_id").select("doc_id").distinct()
    nodes = prefixes(docs.where("doc_id is not null"), k, percent, common).join(ids, "doc_id", "left_semi").withColumnRenamed("doc_id", "node")
    nodes = materialize(nodes, "prefixes")
    columns = materialize(shared_columns(columns_of(nodes)), "columns")
    bits = nodes.select("node", "bits")
    parts = rejected = None
    while True:
        proposed = materialize(crossing(columns, bits, parts, rejected, percent), "proposed")
        if proposed.isEmpty():
            break
        # components only grow: a column without a pair to propose will never have one
        columns = materialize(columns.join(proposed.select("hash").distinct(), "hash", "left_semi"), "open", columns.count())
        first = parts is None
        judged = materialize(count_links(likeliest(proposed, BEST if first else LATER), docs, k, percent, proposed.count()), "judged")
        linked, refused = judged.where("linked"), judged.where("not linked")
        rejected = refused if rejected is None else rejected.union(refused)
        if first:
            parts = components(linked)
        elif not linked.isEmpty():
            parts = joined(parts, linked)
        if first:  # columns in question by these bits are few: only their nodes get wider ones
            unsure = crossing(columns, bits, parts, rejected, percent).select("hash").distinct()
            columns = materialize(columns.join(unsure, "hash", "left_semi"), "unsure", columns.count())
            ids = columns.select(F.col("node").alias("doc_id"))
            bits = materialize(from_sets(docs, ids, k, lambda x: parity(x, WIDE), columns.count()).toDF("node", "bits"), "wide")
    if parts is None:
        return own.select("doc_id", F.col("n").alias("n_shingles"), F.col("node").alias("component_id"))
    parts = parts.withColumnRenamed("id", "node")
    found = own.join(parts, "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("part", "node").alias("component_id"))
