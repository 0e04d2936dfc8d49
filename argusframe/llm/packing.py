"""Vector bin packing of tokenised examples into fixed-length training sequences.

Every example demands tokens, one segment and loss-bearing tokens. A sequence takes, among the pieces that fit all
three limits, the one whose demand has the largest dot product with what the sequence has left; when nothing fits
whole, a piece is cut to fill it. Each task packs the rows that it reads, so nothing is shuffled; what is left at
a task's end goes into sequences whose lengths are powers of two, which need no padding.

Nulls count as empty texts; an empty text is one piece with the end id alone; a long text is cut; repeated rows are
packed each on its own; other columns are ignored. An empty table gives no pieces. Sequence ids are unique, not
gapless, and follow how the input is split into tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, read_spec, text_chunks
from .common import small_batches

#: Examples or tokens that a task gathers before it packs them.
WINDOW_ROWS, WINDOW_TOKENS = 1024, 4 << 20


@dataclass
class Limits:
    """Of one sequence. max_loss may be lower than tokens, so that no sequence is all answers."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


@dataclass
class Packer:
    """Packs pieces (example, start, end, first loss-bearing token) of one task."""

    limits: Limits
    pool: list[tuple[int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def demand(self, piece: tuple[int, int, int, int]) -> int:
        _, start, end, loss_from = piece
        return max(0, end - max(start, loss_from))

    def longest(self, start: int, end: int, loss_from: int, tokens: int, loss: int) -> int:
        """Where the longest piece from start must end under both limits."""
        return min(end, start + tokens, max(start, loss_from) + loss)

    def add(self, example: int, n: int, loss_from: int) -> list[tuple]:
        """Takes an example; returns the sequences that it fills alone."""
        start, out = 0, []
        while n - start >= self.limits.tokens and self.longest(start, n, loss_from, self.limits.tokens, self.limits.loss) == start + self.limits.tokens:
            out.append((example, start, start + self.limits.tokens, self.sequences, 0))
            self.sequences += 1
            start += self.limits.tokens
        if n > start:
            self.pool.append((example, start, n, loss_from))
        return out

    def fill(self, tokens: int, arrays: list[np.ndarray]) -> list[tuple]:
        """One sequence of at most ``tokens`` from the pool, whose columns are the arrays (start, end, loss_from, alive)."""
        start, end, loss_from, alive = arrays
        limits, out, used = self.limits, [], 0
        segments, loss = limits.segments, limits.loss
        while tokens and segments and alive.any():
            need, losses = end - start, end - np.maximum(start, loss_from)
            np.maximum(losses, 0, out=losses)
            score = need * (tokens / limits.tokens**2) + segments / limits.segments**2 + losses * (loss / max(1, limits.loss) ** 2)
            fits = alive & (need <= tokens) & (losses <= loss)
            if segments == 1:
                fits &= need == tokens  # the last place goes to a piece that fills the sequence
            if fits.any():
                i = int(np.argmax(np.where(fits, score, -1)))
                to = int(end[i])
            else:
                i = int(np.argmax(np.where(alive, score, -1)))
                to = self.longest(int(start[i]), int(end[i]), int(loss_from[i]), tokens, loss)
                if to == start[i]:
                    break
            out.append((i, int(start[i]), to, self.sequences, used))
            loss -= max(0, to - max(int(start[i]), int(loss_from[i])))
            used, tokens, segments = used + to - int(start[i]), tokens - to + int(start[i]), segments - 1
            start[i] = to
            alive[i] = to < end[i]
        self.sequences += bool(out)
        return out

    def pack(self, last: bool) -> list[tuple]:
        """Full sequences from the pool; at last also the rest, in lengths that are powers of two."""
        if not self.pool:
            return []
        example = [p[0] for p in self.pool]
        start, end, loss_from = (np.array([p[i] for p in self.pool], np.int64) for i in (1, 2, 3))
        alive, out = np.ones(len(start), bool), []
        arrays = [start, end, loss_from, alive]
        while (left := int((end - start)[alive].sum())) and (left >= self.limits.tokens or last):
            size = self.limits.tokens if left >= self.limits.tokens else 1 << (left.bit_length() - 1)
            out += [(example[i], a, b, s, at) for i, a, b, s, at in self.fill(size, arrays)]
        self.pool = [(example[i], int(start[i]), int(end[i]), int(loss_from[i])) for i in np.flatnonzero(alive)]
        return out


def pack(docs: DataFrame, vocab_path: str, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, prompt_col: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens and, if asked
    for, ``ids`` (binary uint32). prompt_col: a text before ``text_col`` whose tokens bear no loss (instruction data)."""
    spark = docs.sparkSession
    small_batches(spark)
    spec, limits = spark.sparkContext.broadcast(read_spec(vocab_path)), limits or Limits()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (F.col(prompt_col) if prompt_col else F.lit("")).cast("string").alias("prompt"))
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"
    kind = source.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        tool, packer = encoder(spec.value), Packer(limits)
        first = TaskContext.get().partitionId() << 40
        held: dict[int, tuple] = {}
        count = 0

        def emit(pieces: list[tuple]) -> pa.RecordBatch:
            cut = [held[e][1][a:b] for e, a, b, _, _ in pieces]
            columns = [
                pa.array([held[p[0]][0] for p in pieces], to_arrow_type(kind)),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] - p[1] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64()),
                pa.array([len(held[p[0]][1]) for p in pieces], pa.int64()),
                pa.array([first + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
                pa.array([max(0, p[2] - max(p[1], held[p[0]][2])) for p in pieces], pa.int64()),
                pa.array([x.astype("<u4").tobytes() if with_ids else None for x in cut], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"])

        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1)):
                ids = tool.encode(texts)
                prompts = tool.encode([x or "" for x in batch.column(2).slice(a, b - a).to_pylist()]) if prompt_col else None
                done = []
                for j, (key, body) in enumerate(zip(batch.column(0).slice(a, b - a).to_pylist(), ids, strict=True)):
                    before = prompts[j] if prompts else body[:0]
                    held[count] = (key, np.concatenate([before, body, np.array([end_id], np.uint32)]), len(before))
                    done += packer.add(count, len(held[count][1]), len(before))
                    count += 1
                if len(packer.pool) >= WINDOW_ROWS or sum(p[2] - p[1] for p in packer.pool) >= WINDOW_TOKENS:
                    done += packer.pack(last=False)
                if done:
                    yield emit(done)
                    open_ones = {p[0] for p in packer.pool}
                    held = {k: v for k, v in held.items() if k in open_ones}
        if done := packer.pack(last=True):
            yield emit(done)

    return source.mapInArrow(run, schema)
