"""Filters in every order, repair of conversations and removal of repeated windows, each against brute force on awkward rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from argusframe.llm import audit, queries, repair, substring
from pyspark.sql import functions as F


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- filters in every order


def audited(docs, labels):
    """All 120 orders applied one by one."""
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = []
    for i, text, source in docs:
        t = text or ""
        w = words_of(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        fails.append((source or "", i, f))
    out = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        left = list(range(len(fails)))
        for step, f in enumerate(order, 1):
            gone = [x for x in left if fails[x][2][f]]
            left = [x for x in left if not fails[x][2][f]]
            for part in {x[0] for x in fails}:
                own = [x for x in gone if fails[x][0] == part]
                total = [x for x in fails if x[0] == part and x[2][f]]
                out[part, order, step] = [
                    sum(fails[x][0] == part for x in left), len(own), len(total) - len(own), sum(sum(x[2].values()) == 1 for x in total),
                    sum(fails[x][1] in good for x in own), sum(fails[x][1] in toxic for x in own),
                ]
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {k: (*row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def test_audit(spark):
    r = random.Random(2)
    word = lambda: r.choice(["Alpha", "beta", "gamma|", "delta", "EPS", "z#", "eta", "theta"]) + str(r.choice(["", r.randint(0, 300)]))
    docs = [(i, " ".join(word() if i % 3 else f"w{r.randint(0, 999)}" for _ in range(r.choice([0, 20, 210, 400]))), r.choice(["a", "a", "b", None, ""])) for i in range(60)]
    docs += [(100 + i, docs[r.randrange(20)][1], "b") for i in range(15)] + [(200, None, "c"), (201, "", "a"), (200, None, "c"), (None, "", "a"), (None, docs[3][1], None), (5, docs[5][1], "a"), (300, "x " * 30_000, "a")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 0), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", True) for d in docs], "doc_id long, text string, source string, part string, E boolean").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audit(frame, marks).collect()
    want = audited(docs, labels)
    assert len(found) == len(want)
    assert {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in found} == want
    assert audit.audit(frame.where("false"), marks).count() == 0


def test_audit_enters_each_set_once(spark, monkeypatch):
    """120 orders share 31 sets of filters that have a filter left."""
    kept = []
    rows = spark.createDataFrame([("a", False, True, True, False, True, False, False)], "part string, good boolean, toxic boolean, A boolean, B boolean, C boolean, D boolean, E boolean")
    own = type(rows).persist
    monkeypatch.setattr(type(rows), "persist", lambda self, *a: kept.append(1) or own(self, *a))
    from argusframe.llm.common import scratch

    path = scratch(spark, "edges")
    audit.walk(rows, "ABCDE", path)
    assert len(kept) == 31 and spark.read.parquet(path).groupBy("state").count().count() < 32


# --- repair


def damaged(rows):
    out = []
    for c, turn, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        role, text, fault = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(c, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def repaired(rows):
    """The cheapest edits by Dijkstra over (rows done, state), with the audit as the second part of the cost."""
    order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
    seen, faults = set(), []
    for _, _, role, text in order:
        last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = {x[1] for x in order if x[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(order, order[1:]))
    moves = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("3", "u"): "2", ("2", "a"): "3"}
    heap, done = [(0, "", 0, "0", ())], set()
    while heap:
        cost, letters, i, state, lines = heapq.heappop(heap)
        if i == len(order) and state in "03":
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for initial, role in (("u", "user"), ("a", "assistant")):
            if (state, initial) in moves:
                heapq.heappush(heap, (cost + 5, letters + "I", i, moves[state, initial], (*lines, f"{role}:")))
        if i < len(order):
            role, text = order[i][2:]
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, state, lines))
            if faults[i] not in ("blank", "duplicate"):
                late = 5 * (faults[i] == "truncated")
                if (state, role[:1]) in moves:
                    heapq.heappush(heap, (cost + late, letters + "K", i + 1, moves[state, role[:1]], (*lines, f"{role}:{text}")))
                for initial, other in (("u", "user"), ("a", "assistant")):
                    if (state, initial) in moves:
                        heapq.heappush(heap, (cost + late + 1, letters + "R", i + 1, moves[state, initial], (*lines, f"{other}:{text}")))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, sha("\n".join(lines)))


def digest(found):
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    rows = found.withColumn("sha", F.sha2(F.array_join(lines, "\n"), 256)).collect()
    return {x.conv_id: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, x.sha) for x in rows}


def test_repair(spark, small):
    r, rows = random.Random(9), []
    for c in range(400):
        turns = sorted(r.sample(range(30), r.randint(1, 9)))
        rows += [(c, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(["Yes.", "No!", "Why? \n", "cut", "cut off", " \t", "", None, "é漢.", "a\nb."])) for t in turns]
    rows += [(1000, None, "user", "Null turn."), (1000, None, "assistant", "Other."), (1000, 3, "user", "Yes."), (1000, 3, "user", "Yes."), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]
    rows += [(1001, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(500)] + [(1002, 0, "user", "x" * 200_000 + "."), (1003, None, "user", None)]
    real = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{small}/conversations.parquet'").fetchall()
    for own, found in ((rows, None), (real, queries.op12_repair(spark, small))):
        if found is None:
            frame = spark.createDataFrame([(*x, 1, "y") for x in own], "conv_id long, turn long, role string, text string, cost long, fault string").repartition(5)
            have = digest(repair.repair(repair.damage(frame)))
        else:
            have = {x.conv_id: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, x.repaired_sha256) for x in found.collect()}
        left = damaged(own)
        assert have == {c: repaired([x for x in left if x[0] == c]) for c in {x[0] for x in own}}
    assert repair.repair(repair.damage(frame.where("false"))).count() == 0


def test_repair_is_native(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet")
    plan = repair.repair(repair.damage(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange hashpartitioning") == 1


# --- repeated windows


def without_repeats(rows):
    first = {}
    for i, text in rows:
        w = words_of(text)
        for a in range(len(w) - 19) if i is not None else ():
            key = tuple(w[a : a + 20])
            first[key] = min(first.get(key, (i, a)), (i, a))
    out = []
    for i, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        for a in range(len(w) - 19) if i is not None else ():
            if first[tuple(w[a : a + 20])] < (i, a):
                gone[a : a + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept), kept))
    return out


@pytest.fixture(scope="module")
def repeats():
    r = random.Random(3)
    some = lambda n: [r.choice(["a", "b", "é", f"w{r.randint(0, 400)}"]) for _ in range(n)]
    shared = [some(r.choice([19, 20, 21, 55])) for _ in range(6)]
    rows = [(i, r.choice([" ", "\n", " \t"]).join(sum([r.choice([r.choice(shared), some(r.randint(0, 40)), ["x"] * r.randint(0, 45)]) for _ in range(r.randint(0, 6))], []))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n"), (3, rows[3][1]), (3, rows[4][1]), (4, None), (None, rows[5][1]), (None, None)]
    rows += [(600, " ".join(some(60_000))), (601, "q " * 50_000), (602, " ".join(["y" * 3000] * 45))]
    return rows


def test_substring(spark, small, repeats):
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in repeats], "doc_id long, text string, __row long, bucket string").repartition(3)
    key = lambda x: tuple((v is None, v) for v in x)
    want = sorted((x[:4] for x in without_repeats(repeats)), key=key)
    tiny = substring.Plan(2000, 7)
    tiny.buckets = 40
    for plan in (None, tiny):  # few counters: nearly all windows are estimated repeated, and the results stay
        assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring.report(frame, plan=plan).collect()), key=key) == want
    cut = substring.remove(frame)
    left = {x[0]: x[4] for x in without_repeats([x for x in repeats if x[0] not in (3, 4)])}
    assert cut.columns == frame.columns and substring.report(frame.where("false")).count() == 0
    texts = {x.doc_id: x.text for x in substring.remove(frame.where("doc_id not in (3, 4)")).collect()}
    assert {i: " ".join(words_of(t)) for i, t in texts.items()} == {i: t for i, t in left.items() if i in texts}
    assert set(texts) >= {i for i, t in left.items() if t and i is not None} | {500, 501}
    own = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in queries.op13_substring(spark, small).collect()) == sorted(x[:4] for x in without_repeats(own))


def test_sketch_tells_most_windows_apart(spark):
    """Windows that occur once are seldom sent to the second pass; a passage that all documents hold sends one entry a bucket."""
    r = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"w{r.randint(0, 10**6)}" for _ in range(200)] + passage)) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__row", F.xxhash64("doc_id", "text"))
    plan = substring.Plan(sum(len(t) for _, t in rows), 4)
    plan.buckets = 6
    docs = frame.withColumn("bucket", F.pmod("__row", F.lit(plan.buckets)))
    told = docs.groupBy("bucket").applyInArrow(lambda t: substring.enter(t, plan), "block long, bucket long, counters binary").groupBy("block").applyInArrow(lambda t: substring.merge(t, plan), "bucket long, block long, bits binary")
    parts = docs.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(lambda t, b: substring.choose(t, b, plan), substring.SECOND).collect()
    sent = [substring.opened(x.blob)[0] for x in parts if x.blob is not None]
    assert len(parts) <= plan.buckets * (plan.shards + 1)
    n = sum(map(len, sent))
    assert 41 * 6 <= n < 0.15 * 600 * 240


# --- pages: tags in one pass, articles that are spread over the body

PROSE = "The text of the article goes on and on. " * 12
ARTICLE = f"<h1>T</h1><p>{PROSE}</p>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body><div class="lead"><p>{PROSE[:120]}</p></div><div class="text"><p>{PROSE}</p></div></body>', f"{PROSE[:120].strip()}\n{PROSE.strip()}"),
        (f"<body>Loose words<div><p>{PROSE}</p></div>and more</body>", f"Loose words\n{PROSE.strip()}\nand more"),
        (f"<h1>T</h1><p>{PROSE}</p>", f"T\n{PROSE.strip()}"),
        (f'<article><a href="/x">{PROSE}</a></article>', PROSE.strip()),
        (f'<article>{ARTICLE}<section class="discussion"><h2>D</h2><p>We say.</p></section></article>', f"T\n{PROSE.strip()}\nD\nWe say."),
        (f'<div>{ARTICLE}<p class="legal">Law.</p></div>', f"T\n{PROSE.strip()}\nLaw."),
        (f'<div>{ARTICLE}<p class="byline">By X.</p></div>', f"T\n{PROSE.strip()}\nBy X."),
        (f"<div>{ARTICLE}<p>Let <math><mi>x</mi></math> be.</p></div>", f"T\n{PROSE.strip()}\nLet x be."),
        (f'<body><div><a href="/">home</a> <a href="/b">b</a></div><div><p>{PROSE}</p></div><div><p>{PROSE[:80]}</p><input name="q"></div></body>', PROSE.strip()),
        (f'<body><div id="w"><p>Short.</p><div class="post"><p>{PROSE}</p></div></div></body>', f"Short.\n{PROSE.strip()}"),
        (f'<p>a < b</p><p title="x>y">{PROSE}', f"a < b\n{PROSE.strip()}"),
    ],
)
def test_html_keeps_article(page, want):
    from argusframe.llm import html

    assert html.extract(page, None) == want


@pytest.mark.parametrize("bad", ['<a "x"' + '"x' * 50_000, '<a "' * 50_000, '<a ">"' * 50_000, "<a '\">" * 50_000, "<" * 100_000, "<!--" * 50_000 + ">", "<b>" * 50_000 + "<p>x", "<div>" * 30_000 + "x" + "</div>" * 30_000, "<b><hr>" * 30_000, "</x>" * 50_000])
def test_html_takes_hostile_pages(bad):
    import time

    from argusframe.llm import html

    began = time.process_time()
    html.candidates(bad), html.extract(f"<article><p>{PROSE}</p></article>{bad}", None)
    assert time.process_time() - began < 8


def test_html_body_by_consensus(spark):
    """A host whose articles lie in one element keeps to it where a page has other prose in its body; one whose articles are spread keeps all."""
    from argusframe.llm import html

    one = f'<body><div class="post"><p>{PROSE}</p></div>%s</body>'
    both = f'<body><div class="lead"><p>{PROSE[:160]}</p></div><div class="post"><p>{PROSE}</p></div></body>'
    rows = [(i, "http://a.x/", one % ("<div><p>" + PROSE[:200] + "</p></div>" if i == 3 else "")) for i in range(4)] + [(10 + i, "http://b.x/", both) for i in range(3)]
    found = {x.page_id: x.text for x in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == dict.fromkeys(range(4), PROSE.strip()) | dict.fromkeys(range(10, 13), f"{PROSE[:160].strip()}\n{PROSE.strip()}")


# --- fingerprint strings and the classifier's solver


def test_fingerprint_strings(spark, small):
    import xxhash

    def text_of(text):
        words, hashes = words_of(text), []
        for run in [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else []):
            h = 42
            for w in run:
                h = xxhash.xxh64_intdigest(w.encode(), h)
            hashes.append(h >> 1)
        low = sorted({h for h in hashes if h < (1 << 63) // 4})
        return "".join(f"{h:016x}" for h in (low or sorted(hashes)[:1]))

    docs = [(i, t or "") for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY doc_id DESC").fetchall()]
    want = {}
    for at, (i, t) in enumerate(docs):
        cut, after = len(t) // 3, docs[(at + 1) % len(docs)][1]
        edited = t[: len(t) - cut] + after[:cut]
        want[i] = (sha(edited), text_of(t), text_of(edited))
    assert {x.doc_id: (x.edited_sha256, x.fingerprint, x.edited_fingerprint) for x in queries.op10_fingerprint(spark, small).collect()} == want


def test_dual_descent_finds_the_optimum():
    """The squared hinge's optimum by dual coordinate descent is the one that Newton steps on the primal find."""
    import numpy as np

    from argusframe.llm import quality

    r = np.random.default_rng(5)
    n, d = 240, 40
    labels = (r.random(n) < 0.4).astype(int)
    rows = [np.unique(np.r_[np.flatnonzero(r.random(d) < 0.2 + 0.25 * y * (np.arange(d) < 12)), r.integers(0, d)]).astype(np.int32) for y in labels]
    model = quality.fit(rows, labels, epochs=400)
    sums = [np.bincount(np.concatenate([x for x, y in zip(rows, labels) if y == k]), minlength=d) + 1.0 for k in (0, 1)]
    ratio = np.log(sums[1] / (2 + labels.sum())) - np.log(sums[0] / (2 + n - labels.sum()))
    x = np.zeros((n, d + 1))
    for i, own in enumerate(rows):
        x[i, own] = ratio[own] / np.sqrt(len(own))
    x[:, d] = 1
    y = np.where(labels == 1, 1.0, -1.0)
    c = np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y < 0).sum()))
    keep = np.arange(n) % 5 != 0
    xs, ys, cs, w = x[keep], y[keep], c[keep], np.zeros(d + 1)
    loss = lambda w: w @ w / 2 + (cs * np.maximum(0, 1 - ys * (xs @ w)) ** 2).sum()
    for _ in range(100):
        on = ys * (xs @ w) < 1
        gradient = w - 2 * (xs[on] * (cs[on] * (ys[on] - xs[on] @ w))[:, None]).sum(axis=0)
        step = np.linalg.solve(np.eye(d + 1) + 2 * (xs[on].T * cs[on]) @ xs[on], gradient)
        w = w - step * next(t for t in (1, 0.5, 0.25, 0.1, 0.01, 0) if t == 0 or loss(w - t * step) < loss(w))
    margins = np.array([model.margin(own) for own in rows])
    assert np.abs(margins - x @ w).max() < 0.02 and loss(np.r_[model.weights[:d] / np.where(ratio == 0, 1, ratio), model.bias]) < loss(w) * 1.001
