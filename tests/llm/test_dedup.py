"""Similarity join and passage removal against brute force; the pipeline's stages on a small table."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from argusframe.llm import ngram, queries, suffix, textvec
from argusframe.llm.common import maybe_in, table

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def docs_of(small):
    return duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def near(spark):
    """Chains and groups of near copies, copies, short texts, nulls, a repeated row, and a clashing column."""
    r, rows = random.Random(4), [(0, None), (1, ""), (2, "One two"), (3, "one TWO"), (4, "one"), (5, "a b c d e"), (5, "a b c d e")]
    for g in range(6):
        words = [f"w{r.randint(0, 5000)}" for _ in range(r.choice([30, 200, 1500]))]
        for _ in range(30):
            own = list(words)
            for _ in range(r.randint(0, len(words) // 30)):
                own[r.randrange(len(own))] = f"x{r.randint(0, 99999)}"
            rows.append((10 + len(rows), " ".join(own)))
    return rows, spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")


def components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j < i}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_ngram(spark, small, near):
    rows, frame = near
    for found, own, k, percent in ((queries.op5_ngram(spark, small), docs_of(small), 4, 85), (ngram.link(frame), rows, 5, 80)):
        found = found.collect()
        assert len(found) == len(own) and {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(own, k, percent)
    assert ngram.link(frame.where("false")).count() == 0


def removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"x" * 100
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(map(bool, gone)), len(re.findall(b"x+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix(spark, small):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(60, 400)))
    shared = [word() for _ in range(5)]
    rows = [(i, "".join(r.choice([r.choice(shared), word(), "ab" * r.randint(0, 150), "z" * r.randint(0, 300)]) for _ in range(r.randint(0, 6)))) for i in range(120)] + [(500, None), (501, "")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans long")
    for found, own in ((queries.op2_suffix(spark, small), docs_of(small)), (suffix.report(frame.repartition(3)), rows)):
        assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found.collect()} == removed(own)
    cut = suffix.remove(frame)
    assert cut.columns == frame.columns and suffix.report(frame.where("false")).count() == 0
    assert {x.doc_id for x in cut.where("text is null").collect()} == {500}


def test_suffix_long_run(spark):
    """One removed run may be longer than 2**20 bytes."""
    text = random.Random(5).randbytes(750_000).hex()
    rows = [(1, text), (2, text), (3, "q" * 1_500_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: (x.n_removed, [tuple(s) for s in x.spans], x.kept_sha256) for x in suffix.report(frame).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found == {1: (0, [], sha(text)), 2: (1_500_000, [(0, 1_500_000)], sha("")), 3: (1_499_999, [(1, 1_500_000)], sha("q"))}
    assert {x.doc_id: x.text for x in suffix.remove(frame).collect()} == {1: text, 3: "q"}


def test_suffix_repeated_rows(spark):
    """Rows with one id are one document, however they are dealt: no copy of a text takes all of them away."""
    text = random.Random(7).randbytes(200).hex()
    rows = [(1, text), (1, text), (2, text), (3, text), (3, None), (None, text)]
    for n in (1, 3):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        assert sorted((x.doc_id or 0, x.n_bytes, x.n_removed) for x in suffix.report(frame).collect()) == [(0, 400, 0), (1, 400, 0), (1, 400, 0), (2, 400, 400), (3, 0, 0), (3, 400, 400)]
        assert sorted((x.doc_id or 0, x.text or "") for x in suffix.remove(frame).collect()) == [(0, text), (1, text), (1, text), (3, "")]


def test_suffix_common_passage_makes_few_rows(spark):
    """A passage that all documents hold makes one row of runs a document and chunk, not one for each string."""
    r = random.Random(8)
    passage = r.randbytes(1500).hex()
    rows = [(i, r.randbytes(100).hex() + passage + r.randbytes(100).hex()) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    parts = suffix.sample(frame, 8)
    assert parts.where("doc_id is not null").count() <= len(rows) and parts.where("shard is not null").count() <= 3 * 8
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.report(frame).collect()} == removed(rows)


def test_maybe_in(spark):
    ids = spark.range(0, 40_000, 7).toDF("doc_id")
    found = maybe_in(spark.range(-1000, 40_000).toDF("k"), "k", ids).collect()
    assert all(x["__maybe"] for x in found if x.k >= 0 and x.k % 7 == 0) and np.mean([x["__maybe"] for x in found if x.k % 7]) < 0.1
    assert maybe_in(spark.range(5).toDF("k"), "k", ids.where("false")).where("__maybe").count() == 0


def test_suffix_hot_gram(spark):
    """Contexts and strings of a gram that all rows hold in different surroundings go to many groups, with the same results."""
    r = random.Random(6)
    letters = lambda n: "".join(r.choices("abcdefghijklmnop", k=n))
    gram_of = lambda s: int(textvec.mix(textvec.prefix_sums(np.frombuffer(s.encode(), np.uint8))[-1:])[0])
    phrase = min((letters(32) for _ in range(3000)), key=gram_of)
    sides = [(letters(60), letters(60)) for _ in range(5000)]
    rows = [(i, a + phrase + b) for i, (a, b) in enumerate(sides)] + [(6000 + i, letters(40) + sides[i][0][-45:] + phrase + sides[i][1][:50] + "!") for i in range(0, 400, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    parts = suffix.sample(frame, 8).cache()
    hot = suffix.hot_grams(parts)
    assert len(hot) == 1

    def sizes(blobs):
        out = defaultdict(int)
        for x in blobs.collect():
            out[x.shard] += len(suffix.opened(x.blob)["context"])
        return out

    before = sizes(parts.where("shard is not null"))
    after = sizes(suffix.spread(parts.where("shard is not null"), hot, 8, 4))
    assert sum(after.values()) == sum(before.values()) and max(before.values()) > 5000
    assert {x for x in after if x >= 8} == {8, 9, 10, 11} and max(after[x] for x in range(8, 12)) < 2000
    want = removed(rows)
    assert sum(x[1] > 0 for x in want.values()) > 100
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.report(frame).collect()} == want


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "ngram", "suffix", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = docs.collect(), stage(spark, docs, sf)
        assert after.columns == names
        rows = after.collect()
        assert 0 < len(rows) <= len(before) and {r.doc_id for r in rows} <= {r.doc_id for r in before}
        if name == "exact":
            assert len(rows) == len({r.text or "" for r in before})
        if name == "ngram":
            assert {r.doc_id for r in rows} == {b for _, b in components([(r.doc_id, r.text) for r in before], 5, 80).values()}
        docs = spark.createDataFrame(rows, after.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def test_pipeline_awkward(spark):
    """Nulls in every column, empty texts, repeated rows, columns named like results, and empty tables go through each stage."""
    sf, r = "/root/testdata/sf0.001", random.Random(12)
    text = " ".join(r.choice("the of and to in is that it for on with as are this be by".split()) for _ in range(400))
    rows = [(1, text, "en", "a", 5, 0.1, 7), (1, text, "en", "a", 5, 0.1, 7), (2, text, None, None, None, None, None), (3, None, "en", "a", 0, 0.9, 1), (4, "", "en", "a", 0, 0.9, 1), (None, text + " end", "en", "a", 1, 0.2, 2), (6, text + " x", "de", "b", 1, 0.2, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long"
    full = spark.createDataFrame(rows, schema)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after, empty = stage(spark, full, sf), stage(spark, full.where("false"), sf)
        assert after.columns == full.columns == empty.columns and empty.count() == 0
        left[name] = sorted((x.doc_id or 0, x.text or "", x.score or 0) for x in after.collect())
    assert set(left["quality"]) <= {(x[0] or 0, x[1] or "", x[5] or 0) for x in rows}
    assert left["exact"] == sorted([(0, text + " end", 0.2), (1, text, 0.1), (3, "", 0.9), (6, text + " x", 0.2)])
    assert left["ngram"] == sorted([(0, text + " end", 0.2), (1, text, 0.1), (1, text, 0.1), (3, "", 0.9), (4, "", 0.9)])
    assert [x[:2] for x in left["suffix"]] == sorted([(0, text + " end"), (1, text), (1, text), (3, ""), (4, ""), (6, " x")])
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, full, sf).select("doc_id").distinct().count() == 6 and pack(spark, full.where("false"), sf).count() == 0
