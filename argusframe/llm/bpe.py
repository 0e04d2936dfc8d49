"""Byte-level BPE: batched numpy merge rounds over the symbols of many words in one flat array.

Texts are cut into pre-tokens by vectorised rules over code points (letters, numbers, white space, others, and
contractions). The distinct pre-tokens of a chunk are merged together: in every round the rank of each adjacent
pair is found by binary search over the sorted keys of all merges, and each word merges its lowest-ranked pair.

Nulls count as empty; an empty text has no ids; a text of any length is one row; repeated rows each get their
row; the special token's string in a text becomes its one id, as the library does unless told otherwise.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import small_batches

U = np.uint64
NONE = np.int64(1 << 40)
LETTER, NUMBER, SPACE, OTHER = range(4)
#: Unicode white space beyond ASCII's, as the pattern's \s has it (fixed values).
WIDE_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pre-tokens of more bytes are merged where they stand; shorter ones once for all their copies.
LONG_WORD = 64
#: Distinct words that a worker remembers; beyond that it starts anew (speed only).
REMEMBERED = 1 << 20


def code_classes() -> np.ndarray:
    """The class of every code point."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    first = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    names = np.array(first)
    kinds[names == "L"], kinds[names == "N"] = LETTER, NUMBER
    kinds[[*range(9, 14), 32, *WIDE_SPACES]] = SPACE
    return kinds


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where printable, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Encoder:
    """Vocabulary and merges of a tokenizer file, with the words that this process has met."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab: dict[str, int] = model["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.size = size
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        pieces = [b""] * size
        for token, at in vocab.items():
            pieces[at] = token.encode() if token in self.special else bytes(of_letter[c] for c in token)
        for token, at in self.special.items():
            pieces[at] = token.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.kinds = code_classes()
        self.forget()

    def forget(self) -> None:
        self.known, self.known_at, self.known_len = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def pieces_of(self, joined: str, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pre-tokens begin, as code points and as bytes; firsts: where texts begin."""
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        kind = self.kinds[points]
        text_first = np.zeros(n + 1, bool)
        text_first[firsts] = True
        text_first[n] = True
        run_first = text_first[:n].copy()
        run_first[1:] |= kind[1:] != kind[:-1]
        begins = run_first.copy()
        space = kind == SPACE
        after_blank = np.zeros(n, bool)
        after_blank[1:] = (points[:-1] == 0x20) & ~text_first[1:n] & ~space[1:]
        begins &= ~after_blank
        last_space = np.zeros(n, bool)  # the last of a run of spaces before something else of the same text
        last_space[:-1] = space[:-1] & ~space[1:] & ~text_first[1:n]
        begins |= last_space
        quotes = np.flatnonzero((points == 0x27) & begins & run_first)
        quotes = quotes[quotes + 1 < n]
        quotes = quotes[~text_first[quotes + 1]]
        one = points[quotes + 1]
        two = np.where((quotes + 2 < n) & ~text_first[np.minimum(quotes + 2, n)], points[np.minimum(quotes + 2, n - 1)], 0)
        length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            length = np.where((one == ord(a)) & (two == ord(b)), 3, length)
        begins[quotes[length > 0] + 1] = False
        after = (quotes + length)[length > 0]
        after = after[after < n]
        begins[after[(kind[after] == LETTER) & ~text_first[after]]] = True
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.zeros(n + 1, np.int64)
        np.cumsum(widths, out=at[1:])
        where = np.flatnonzero(begins)
        return where, at[where]

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words in one array, and how many each has."""
        lengths = ends - starts
        word = np.repeat(np.arange(len(starts)), lengths)
        symbols = self.byte_id[data[np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)]]
        done_words, done_symbols = [], []
        while len(word):
            rank = np.full(len(word), NONE)
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[1:] == word[:-1])
            rank[:-1][hit] = self.order[at[hit]]
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[heads, len(word)])
            lowest = np.repeat(np.minimum.reduceat(rank, heads), sizes)
            over = lowest == NONE
            if over.any():
                done_words.append(word[over])
                done_symbols.append(symbols[over])
            take = (rank == lowest) & ~over
            where = np.flatnonzero(take)
            if len(where):
                fresh = np.r_[True, np.diff(where) != 1]
                offset = np.arange(len(where)) - np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
                where = where[offset % 2 == 0]
                symbols[where] = self.made[rank[where]]
            keep = ~over
            keep[where + 1] = False
            word, symbols = word[keep], symbols[keep]
        if not done_words:
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        words, found = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(words, kind="stable")
        return found[order].astype(np.uint32), np.bincount(words, minlength=len(starts))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        parts, counts = [], []
        for text in texts:
            cut = [text]
            for token, at in self.special.items():
                if token in text:
                    cut = [y for x in cut for y in ([x] if not isinstance(x, str) else [z for p in x.split(token) for z in (at, p)][1:])]
            parts += cut
            counts.append(len(cut))
        plain = [p for p in parts if isinstance(p, str)]
        coded = iter(self.encode_plain(plain))
        coded = [next(coded) if isinstance(p, str) else np.array([p], np.uint32) for p in parts]
        out, at = [], 0
        for n in counts:
            out.append(coded[at] if n == 1 else np.concatenate(coded[at : at + n]))
            at += n
        return out

    def encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.uint32)] * len(texts)
        text_at = np.cumsum(sizes) - sizes
        where, starts = self.pieces_of(joined, text_at[sizes > 0])
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        ends = np.r_[starts[1:], len(data)]
        keys = textvec.span_hashes(textvec.prefix_sums(data), starts, ends)
        long = np.flatnonzero(ends - starts > LONG_WORD)
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != unique[inside]
        if new.any():
            ids, n = self.merge(data, starts[first[new]], ends[first[new]])
            self.known_at = np.insert(self.known_at, at[new], len(self.ids) + np.cumsum(n) - n)
            self.known_len = np.insert(self.known_len, at[new], n)
            self.known = np.insert(self.known, at[new], unique[new])
            self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.known, unique)
        begin, n = self.known_at[at][inverse], self.known_len[at][inverse]
        base = self.ids
        if len(long):  # not by hash: each where it stands
            ids, m = self.merge(data, starts[long], ends[long])
            begin, n = begin.copy(), n.copy()
            begin[long], n[long] = len(base) + np.cumsum(m) - m, m
            base = np.concatenate([base, ids])
        total = int(n.sum())
        out = base[np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)]
        before = np.r_[0, np.cumsum(n)]
        cut = before[np.searchsorted(where, np.r_[text_at, len(joined)])]
        return [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.piece_len[ids]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.piece_at[ids], n)
        return self.piece_bytes[at].tobytes()


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder for each process and vocabulary."""
    key = hash(spec)
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def read_spec(path: str) -> str:
    """The vocabulary file, read on the driver; it has a fixed size (some MB) and travels with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def text_chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of rows of about ``most`` code points; null is empty."""
    texts = [x or "" for x in column.to_pylist()]
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield at, i + 1, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts), texts[at:]


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: the id, ``ids`` (array of int), ``ids_sha256`` of them as little-endian uint32, and ``decoded`` (binary)
    when ``with_text``, its hash always. No shuffle: a row is encoded where it is read."""
    spark = docs.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(vocab_path))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(spec.value)
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1)):
                ids = tool.encode(texts)
                back = [tool.decode(x) for x in ids]
                raw = [x.astype("<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                        pa.array(raw if with_text else [None] * len(raw), pa.binary()),
                        pa.array(back if with_text else [None] * len(raw), pa.binary()),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"],
                )

    return source.mapInArrow(run, schema)
