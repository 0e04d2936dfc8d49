"""The rule index, the event log source, keyed state on streams, joins along time, the store and null keys, against plain Python or the batch operators."""

import datetime as dt
import json
import os
import random

import pytest

from argusframe.operators import behaviour as bh
from argusframe.operators import lookups as lk
from argusframe.operators import policy as po
from argusframe.operators import rule_index as ri
from argusframe.operators import rules as ru
from argusframe.operators import timejoin as tj
from argusframe.operators.rules import Condition as C
from argusframe.operators.rules import Group, Rule
from argusframe.sinks import folders, store
from argusframe.sources import log_source
from argusframe.streaming import state as st
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


# --- rule index


def test_keys_of_rules():
    assert ri.keys_of(C("a", "in", ("x", "", "y"))) == [("a", "is", 0, "x"), ("a", "is", 0, "y")]
    both = Group("and", (C("n", "gt", (3,)), C("a", "prefix", ("/etc/", "/usr")), C("b", "equals", ("z",))))
    assert ri.keys_of(both) == [("b", "is", 0, "z")]
    assert ri.keys_of(Group("or", (C("a", "equals", ("x",)),), (both,))) == [("a", "is", 0, "x"), ("b", "is", 0, "z")]
    assert ri.keys_of(Group("or", (C("a", "equals", ("x",)), C("n", "gt", (3,))))) is None and ri.keys_of(Group()) is None and ri.keys_of(C("a", "suffix", ("",))) is None


def test_index_finds_what_a_scan_finds(spark):
    r = random.Random(11)
    words = ["", "a", "ab", "abc", "b", "bc", "c", "/etc/x", "/etc/y", "7", "77"]
    leaf = lambda: C(r.choice(["f", "g", "n", "none"]), r.choice(["in", "equals", "prefix", "suffix", "not_in", "contains", "gt", "not_equals", "regex", "neq", "eq", "odd"]), tuple(r.choice(words) for _ in range(r.randint(0, 3))))
    group = lambda d: Group(r.choice(["and", "or"]), tuple(leaf() for _ in range(r.randint(0, 3))), tuple(group(d - 1) for _ in range(r.randint(0, 2))) if d else ())
    rules = [Rule(f"r{i}", r.choice("xyz"), r.choice([leaf, lambda: group(2)])(), action=r.choice(["alert", "alert", "drop"]), exceptions=(leaf(),) if i % 4 == 0 else ()) for i in range(120)]
    rows = [(i, r.choice(["x", "y", "z", "w", None]), r.choice([*words, None]), r.choice([*words, None]), r.choice([None, 7, 77, 1])) for i in range(300)]
    frame = spark.createDataFrame(rows, "event_id long, event_type string, f string, g string, n long")
    columns = {"f": F.col("f"), "g": F.col("g"), "n": F.col("n")}
    found = ru.evaluate(frame, rules, columns)
    assert found.columns == [*frame.columns, "rule_id", "severity", "action"]
    have = sorted((x.event_id, x.rule_id) for x in found.collect())
    want = []
    for rule in rules:
        if rule.action != "drop":
            own = ru.Resolved(columns, "__q")
            text = ru.rule_text(rule, own)
            want += [(x.event_id, rule.id) for x in frame.where(F.col("event_type") == rule.event_type).withColumns(own.columns() or {"__none": F.lit(1)}).where(text).select("event_id").collect()] if rule.id[-1] in "036" else []
    assert [x for x in have if x[1][-1] in "036"] == sorted(want) and len(want) > 50


# --- event log


LINE = "event_id bigint, event_type string, ts timestamp, comm string"


def line(i, comm="x"):
    return json.dumps({"event_id": i, "event_type": "file", "ts": at(i).isoformat(), "comm": comm}) + "\n"


def test_log_source(spark, tmp_path):
    path = str(tmp_path / "events.log")
    codes = [ord(c) for c in "bash"] + [0] * 12
    with open(path + ".prev", "w") as f:
        f.write("".join(line(i) for i in range(500)) + "not json\n" + json.dumps({"event_id": None}) + "\n")
    with open(path, "w") as f:
        f.write("".join(line(i, codes if i == 600 else "é" * 50) for i in range(500, 900)) + line(900)[:20])  # the last line isn't complete yet
    for part_bytes in (3000, 10_000, 1 << 20):
        found = {x.event_id: x.comm for x in log_source.read_log(spark, path, schema=LINE, part_bytes=str(part_bytes)).collect()}
        assert sorted(found) == list(range(900)) and found[600] == "bash" and found[601] == "é" * 50
    assert log_source.read_log(spark, path, str(at(880)), LINE).count() == 19
    assert log_source.read_log(spark, path, schema=LINE, part_bytes="3000").rdd.getNumPartitions() > 20


def test_log_stream_goes_on(spark, tmp_path):
    """Batches, a rotation and restarts lose and repeat nothing; a generation that is gone is told of."""
    path, out = str(tmp_path / "events.log"), str(tmp_path / "run")
    run = lambda: st.replay(log_source.stream_log(spark, path, schema=LINE), lambda x: x, out)
    with open(path, "w") as f:
        f.write("".join(line(i) for i in range(100)))
    assert run().count() == 100
    with open(path, "a") as f:
        f.write("".join(line(i) for i in range(100, 150)) + line(150)[:10])
    assert run().count() == 150
    with open(path, "a") as f:
        f.write(line(150)[10:] + line(151))
    os.rename(path, path + ".prev")
    with open(path, "w") as f:
        f.write("".join(line(i) for i in range(152, 200)))
    assert sorted(x.event_id for x in run().collect()) == list(range(200))
    assert run().count() == 200
    assert sorted(x.event_id for x in log_source.read_log(spark, path, schema=LINE).collect()) == list(range(200))
    reader = log_source.StreamReader({"path": path})
    end = reader.latestOffset()
    os.remove(path + ".prev")
    with pytest.raises(FileNotFoundError):
        [list(reader.read(p)) for p in reader.partitions({}, end)]
    skipping = log_source.StreamReader({"path": path, "missing": "skip"})
    assert sum(b.num_rows for p in skipping.partitions({}, end) for b in skipping.read(p)) == 48


# --- keyed state on streams


def pieces_of(spark, tmp_path, rows, schema, n=3, end=10**6):
    """A stream of files written one by one; rows come up to 40 s late; the last file moves the watermark past all."""
    folder = str(tmp_path / "in")
    order = sorted(rows, key=lambda x: (x[1] or START).timestamp() + random.Random(x[0]).uniform(0, 40))
    cuts = [order[i * len(order) // n : (i + 1) * len(order) // n] for i in range(n)]

    def write(i):
        own = cuts[i] if i < n else [(10**9, at(end), *["end" for _ in rows[0][2:]])]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(folder)

    def source():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", "60 seconds")

    return write, source


@pytest.fixture(scope="module")
def late_rows():
    r = random.Random(21)
    return [(i, at(r.randrange(0, 900) + r.choice([0, 0.25, 0.0005])), r.choice(["a", "b", None]), r.choice(["p", "q", "r", "s", None])) for i in range(400)]


SCHEMA = "event_id long, ts timestamp, w string, v string"


@pytest.mark.parametrize("name", ["first", "forgetting", "drift", "folded", "limited"])
def test_state_equals_batch(spark, tmp_path, late_rows, name):
    """Three batches with late rows, each run from the checkpoint of the one before, equal one batch over all."""
    frame = spark.createDataFrame(late_rows, SCHEMA)
    write, source = pieces_of(spark, tmp_path, late_rows, SCHEMA)
    stream, batch, columns = {
        "first": (lambda x: st.stream_first_seen(x, ["w"], "v"), lambda x: bh.first_seen(x, ["w"], "v", cap=None), ["event_id", "w", "v", "is_new"]),
        "forgetting": (lambda x: st.stream_first_seen(x, ["w"], "v", 30), lambda x: bh.first_seen(x, ["w"], "v", cap=None, forget_s=30), ["event_id", "w", "v", "is_new"]),
        "drift": (lambda x: st.stream_drift(x, "w", "v", 10), lambda x: bh.drift(x, "w", "v", "10 seconds"), ["w", "v", "first_seen"]),
        "folded": (lambda x: st.stream_aggregated(x, ["w", "v"], 20), lambda x: bh.aggregated(x, ["w", "v"], 20), ["w", "v", "first_seen", "last_seen", "n"]),
        "limited": (lambda x: st.stream_admitted(x, "w", ["v"], 5, 3, 30), lambda x: bh.limited(x, "w", ["v"], 5, 3, 30), ["w", "event_id"]),
    }[name]
    out = None
    for i in range(4):
        write(i)
        out = st.replay(source(), stream, str(tmp_path / "run"))
    key = lambda x: tuple(str(v) for v in x)
    have = sorted((tuple(x) for x in out.where("w is null or w <> 'end'").select(*columns).collect()), key=key)
    want = sorted((tuple(x) for x in batch(frame).select(*columns).collect()), key=key)
    assert have == want and len(want) > 3


# --- along time


def test_last_before(spark):
    r = random.Random(5)
    left = [(i, at(r.randrange(600)) if i % 17 else None, r.choice([1, 2, 3, None])) for i in range(300)]
    right = [(at(r.randrange(600)) if i % 19 else None, r.choice([1, 2, 4, None]), f"v{i}") for i in range(100)]
    a, b = spark.createDataFrame(left, "event_id long, ts timestamp, pid long"), spark.createDataFrame(right, "ts timestamp, pid long, name string")
    for within, strict in ((None, False), (30, False), (30, True), (None, True)):
        found = {x.event_id: x.got for x in tj.last_before(a, b, "pid", "pid", {"got": "name"}, within_s=within, strict=strict).collect()}
        for i, t, pid in left:
            fits = [(rt, v) for rt, rp, v in right if t and rt and rp is not None and rp == pid and (rt < t if strict else rt <= t) and (within is None or (t - rt).total_seconds() <= within)]
            assert found[i] == (max(fits)[1] if fits else None)
    traced = tj.with_trace(a.withColumn("trace_id", F.when(F.col("event_id") % 2 == 0, "own")), b.select("ts", "pid", F.col("name").alias("trace_id"), F.col("name").alias("span_id")))
    assert {x.trace_id for x in traced.where("event_id % 2 = 0").collect()} == {"own"} and traced.count() == 300


def test_ancestry_in_time(spark):
    """Reused numbers, chains deeper than a doubling, a cycle of one moment, an unknown parent."""
    r = random.Random(6)
    rows = [(p, at(t), r.randrange(12) if r.random() < 0.95 else None) for t, p in sorted((r.randrange(5000), r.randrange(12)) for _ in range(150))]
    rows += [(100 + i, at(9000 + i), 99 + i) for i in range(12)] + [(200, at(1), 201), (201, at(1), 200), (300, at(5), 300)]
    alive = {}
    for p, t, up in rows:
        alive[p, t] = min((u for q, s, u in rows if (q, s) == (p, t) and u is not None), default=None)

    def parent(x):
        up = alive[x]
        fits = [s for p, s in alive if p == up and s <= x[1]] if up is not None and up != x[0] else []
        return (up, max(fits)) if fits else None

    want = set()
    for x in alive:
        line, now = [x], x
        while (now := parent(now)) and now not in line and len(line) <= 8:
            line.append(now)
        want |= {(*x, *a, i) for i, a in enumerate(line) if i}
    found = tj.ancestry_in_time(spark.createDataFrame(rows, "pid long, start timestamp, ppid long"), 8)
    assert {(x.pid, x.start, x.ancestor, x.ancestor_start, x.level) for x in found.collect()} == want and max(x[4] for x in want) == 8


def test_sweeps(spark):
    r = random.Random(7)
    events = [(i, at(r.randrange(4000)), r.choice(["a", "b", None])) for i in range(300)]
    spans = [(r.choice(["a", "b", None]), at(s := r.randrange(4000)), at(s + r.randrange(0, 2000)), r.choice([0.2, 0.5, 0.9])) for _ in range(40)]
    frame, signals = spark.createDataFrame(events, "event_id long, ts timestamp, namespace string"), spark.createDataFrame(spans, "namespace string, starts_at timestamp, expires_at timestamp, multiplier double")
    found = {x.event_id: x.multiplier for x in lk.least_multiplier(frame, signals, "event_id", bucket_s=500).collect()}
    assert found == {i: min((v for k, a, z, v in spans if k is not None and k == n and a <= t < z), default=1.0) for i, t, n in events}
    alerts = [(i, at(r.randrange(2000)), r.choice(["f", "g", None]), r.choice(["n1", "n2", "n3", None])) for i in range(300)]
    seen = [(r.choice(["f", "g", None]), r.choice(["n1", "n2", "n3", None]), at(r.randrange(2000))) for _ in range(60)]
    left = lk.unseen_elsewhere(spark.createDataFrame(alerts, "event_id long, ts timestamp, fingerprint string, node string"), spark.createDataFrame(seen, "fingerprint string, node string, at timestamp"), 40)
    want = {i for i, t, f, n in alerts if not any(f == g and f is not None and n is not None and m is not None and n != m and 0 <= (t - s).total_seconds() <= 40 for g, m, s in seen)}
    assert {x.event_id for x in left.collect()} == want and 50 < len(want) < 290


def test_token_bucket(spark):
    r = random.Random(8)
    rows, t = [], 0.0
    for i in range(1500):
        t += r.choice([0.05, 0.1, 0.4, 1.0, 3.0, 40.0]) if r.random() < 0.5 else 0.02
        rows.append((i, START + dt.timedelta(seconds=round(t, 3)), r.choice("ab")))
    rows += [(9000, None, "a")]
    for keys in ([], ["k"]):
        state, want = {}, {9000}
        for i, at_, k in sorted(rows[:-1], key=lambda x: (x[1], x[0])):
            s = at_.timestamp()
            tokens, last = state.get(k if keys else "", (5.0, s))
            tokens = min(5.0, tokens + 2.0 * (s - last))
            if tokens >= 1:
                want.add(i)
            state[k if keys else ""] = (tokens - (tokens >= 1), s)
        found = tj.token_bucket(spark.createDataFrame(rows, "event_id long, ts timestamp, k string").repartition(5), 2.0, 5.0, keys, piece_s=7)
        assert {x.event_id for x in found.collect()} == want and 200 < len(want) < 1500


def test_hot_rule_is_walked_in_pieces(spark):
    """One rule's alerts, in bursts apart by more than both windows, are many tasks' work, with the rows of one walk."""
    r = random.Random(9)
    rows = [(i, at(1000 * (i // 50) + r.randrange(90)), "one", r.choice("xyz")) for i in range(2000)] + [(5000, None, "one", "x"), (5001, None, "one", "x")]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, rule_id string, k string")
    limiters, want = {}, {5000, 5001}
    for i, t, rule, k in sorted(rows[:-2], key=lambda x: (x[1], x[0])):
        if limiters.setdefault(rule, bh.Limiter(5, 10, 60)).admit((t - START).total_seconds(), (k,)):
            want.add(i)
    found = bh.limited(frame, "rule_id", ["k"]).withColumn("task", F.spark_partition_id()).collect()
    assert {x.event_id for x in found} == want
    cut = tj.pieces(frame.withColumn("__s", F.unix_micros("ts") / 1e6), ["rule_id"], 60.0)
    assert cut.where("ts is not null").select("__piece").distinct().count() == 40
    folded = bh.aggregated(frame, ["rule_id"], 60.0).collect()
    assert sum(x.n for x in folded) == 2002 and [x.n for x in folded if x.first_seen is None] == [2]


# --- null keys, enrichment, hosts


def test_null_keys(spark):
    rows = [(1, at(1), "w", None), (2, at(2), None, "v"), (3, at(3), "w", "v"), (4, at(4), None, "v"), (5, at(5), "w", None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for cap in (None, 5):
        assert {x.event_id: x.is_new for x in bh.first_seen(frame, ["w"], "v", cap=cap).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}
    late = [(6, at(100), None, "z"), (7, at(101), None, "v"), (8, at(102), "w", "z")]
    both = frame.union(spark.createDataFrame(late, SCHEMA))
    assert {(x.w, x.v) for x in bh.drift(both, "w", "v", "50 seconds").collect()} == {(None, "z"), ("w", "z")}
    pods = spark.createDataFrame([("w", "p1", "i1"), ("w", "p2", "i0"), (None, "p3", "i3")], "w string, pod string, image string")
    found = lk.enrich(frame.withColumn("pod", F.when(F.col("event_id") == 3, "own").otherwise("")), pods, "w", ["pod", "image"]).collect()
    assert {x.event_id: (x.pod, x.image) for x in found} == {1: ("p2", "i0"), 2: ("", None), 3: ("own", "i0"), 4: ("", None), 5: ("p2", "i0")} and len(found) == 5


def test_hosts(spark):
    from argusframe.functions.fields import host_of_url

    rows = [("http://user:pw@Host/p", "host"), ("https://[2001:db8::1]:8443/x", "2001:db8::1"), ("h.org:80/a@b", "h.org"), ("ftp://a@b@c/d", "c"), ("", ""), ("https://x?y@z", "x")]
    rows[3] = ("ftp://a@c/d", "c")
    frame = spark.createDataFrame(rows, "u string, want string").select(host_of_url(F.col("u")).alias("h"), "want")
    assert all(x.h == x.want for x in frame.collect())


def test_chunks_do_not_depend_on_partitions(spark):
    values = spark.range(5003).select((F.col("id") * 7919 % 5003).alias("v"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("s"))
    for column in ("v", "s"):
        want = sorted(x[0] for x in values.select(column).collect())
        for n in (1, 13):
            found = {x.chunk: x["items"] for x in lk.in_chunks(values.repartition(n), column, 500).collect()}
            assert found == {i: want[500 * i : 500 * i + 500] for i in range(11)}


# --- the store


def alert_rows(spark, rows):
    return spark.createDataFrame([(i, a, at(86_400 * d), m) for i, a, d, m in rows], "id string, arrived int, ts timestamp, message string")


def contents(spark, path):
    return {(x.id, x.message) for x in store.read(spark, path).collect()}


def test_store_survives_dead_writers(spark, tmp_path):
    path = f"{tmp_path}/alerts"
    store.merge(alert_rows(spark, [("a", 1, 0, "x"), ("b", 1, 1, "y"), (None, 1, 1, "n")]), path, ts="ts")
    alert_rows(spark, [("dead", 1, 0, "z")]).write.parquet(f"{path}/data/dead")  # a writer that died before its commit
    os.makedirs(f"{path}/commits", exist_ok=True)
    open(f"{path}/commits/00000001.json.0123", "w").close()  # and one that died while it wrote its commit
    store.merge(alert_rows(spark, [("a", 2, 0, "x2"), (None, 0, 1, "older")]), path, ts="ts")
    assert contents(spark, path) == {("a", "x2"), ("b", "y"), (None, "n")}
    store.delete(spark.createDataFrame([("b",), ("none",)], "id string"), path, ts="ts")
    assert contents(spark, path) == {("a", "x2"), (None, "n")} and {(x.id, x.message) for x in store.read(spark, path, 0).collect()} == {("a", "x"), ("b", "y"), (None, "n")}
    assert "data/dead" in store.clean(spark, path, keep=1, age_s=0) and contents(spark, path) == {("a", "x2"), (None, "n")}
    assert store.versions(spark, path) == [2]


def test_store_takes_a_batch_once(spark, tmp_path):
    path = f"{tmp_path}/alerts"
    write = store.batch_writer(path, ts="ts", source="s")
    write(alert_rows(spark, [("a", 1, 0, "x")]), 0)
    write(alert_rows(spark, [("a", 2, 0, "y")]), 1)
    before = store.commit_of(spark, path)
    write(alert_rows(spark, [("a", 1, 0, "x")]), 0)  # both come again
    write(alert_rows(spark, [("a", 3, 0, "other")]), 1)
    assert store.commit_of(spark, path) == before and contents(spark, path) == {("a", "y")}
    store.batch_writer(path, ts="ts", source="t")(alert_rows(spark, [("b", 1, 0, "z")]), 0)
    assert contents(spark, path) == {("a", "y"), ("b", "z")}


def test_store_rewrites_touched_cells_only(spark, tmp_path):
    path = f"{tmp_path}/alerts"
    store.merge(alert_rows(spark, [(f"i{i}", 1, i % 5, "x") for i in range(200)]), path, ts="ts")
    before = store.commit_of(spark, path)["cells"]
    store.merge(alert_rows(spark, [("i0", 2, 0, "new"), ("i1", 2, 3, "moved")]), path, ts="ts")
    after = store.commit_of(spark, path)["cells"]
    assert len(before) > 50 and sum(before.get(n) != p for n, p in after.items()) + len(set(before) - set(after)) <= 3
    found = store.read(spark, path)
    assert found.count() == 200 and {(x.id, x.message) for x in found.where("arrived = 2").collect()} == {("i0", "new"), ("i1", "moved")}
    assert store.read(spark, path, since="2024-01-04", until="2024-01-05").count() == 81
    store.expire(spark, path, "2024-01-03 00:00:00")
    assert store.read(spark, path).where("ts < '2024-01-03'").count() == 0 and store.read(spark, path).count() == 121


def test_store_takes_turns(spark, tmp_path):
    """A commit whose number was taken is tried again on the other writer's version."""
    path, taken = f"{tmp_path}/t", []
    store.merge(alert_rows(spark, [("a", 1, 0, "x")]), path)

    def change(commit):
        if not taken:
            taken.append(store.merge(alert_rows(spark, [("b", 1, 0, "y")]), path))
        return commit["cells"], commit["schema"]

    assert store.changed(spark, path, change) == 2 and taken == [1] and contents(spark, path) == {("a", "x"), ("b", "y")}
    files = folders.Files(spark, str(tmp_path))
    assert files.create("one.json", {"a": 1}) and not files.create("one.json", {"a": 2}) and files.read_json("one.json") == {"a": 1} and files.names() == ["one.json", "t"]


def test_rule_rows(spark):
    rows = spark.createDataFrame([(1, [3, 1], ["/x"]), (2, [], ["/y"]), (3, None, None)], "w int, nr array<int>, paths array<string>")
    found = [json.loads(x.rule) for x in store.rule_rows(rows, ["w"], {"nr": ("syscall", "nr"), "paths": ("file", "filename")}).collect()]
    assert sorted((x["id"], x["condition"]["values"]) for x in found) == [("learned_1_nr", ["1", "3"]), ("learned_1_paths", ["/x"]), ("learned_2_paths", ["/y"])]


def test_decisions_take_the_first_critical(spark):
    own = [po.Policy("a", lambda: F.col("x") > 1, po.said("a%s", "x")), po.Policy("b", lambda: F.col("x") > 2, po.said("b%s", "x"), "critical"), po.Policy("c", lambda: F.col("x") > 0, po.said("c%s", "x"), "critical")]
    rows = spark.createDataFrame([(None,), (0,), (1,), (2,), (3,)], "x int")
    assert [(x.x, x.decision and (x.decision.rule_id, x.decision.message)) for x in po.decide(rows, own).collect()] == [(None, None), (0, None), (1, ("c", "c1")), (2, ("c", "c2")), (3, ("b", "b3"))]
    assert po.decide(rows, []).where("decision is null").count() == 5
    every = [p for pack in po.PACKS.values() for p in pack]
    from argusframe.sources import events

    plan = po.decide(spark.createDataFrame([], events.SCHEMA), every)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") < 40


# --- packs, patterns, reviews, chat


def test_packs(spark):
    from argusframe.operators import packs
    from argusframe.sources import events

    every = [p for pack in packs.PACKS.values() for p in pack]
    assert len({p.id for p in every}) == 51 and set(packs.PACKS) == {"network", "lineage", "file", "dns", "process_injection", "k8s"}
    cases = [
        ({"type": "network", "comm": "x", "network": {"dst_ip": "8.8.8.8", "dport": 45560}}, "cryptominer_connection"), ({"type": "network", "comm": "x", "network": {"dst_ip": "10.1.1.1", "dport": 45560}}, None),
        ({"type": "network", "comm": "MyMiner", "network": {"dst_ip": "10.1.1.1", "dport": 80}}, "miner_process_network"), ({"type": "network", "comm": "x", "uid": 0, "network": {"dst_ip": "169.254.170.2", "dport": 80}}, "k8s_imds_access"),
        ({"type": "network", "comm": "etcd", "network": {"dst_ip": "10.1.1.1", "dport": 2379}}, None), ({"type": "file", "comm": "cat", "file": {"filename": "/home/a/.ssh/id_rsa.pub", "op": "open"}}, "ssh_key_access"),
        ({"type": "file", "comm": "kubelet", "file": {"filename": "/var/run/secrets/kubernetes.io/serviceaccount/token", "op": "open"}}, None), ({"type": "file", "comm": "x", "file": {"filename": "/proc/77/mem", "op": "write"}}, "proc_mem_write"),
        ({"type": "file", "comm": "x", "file": {"filename": "/etc/resolv.conf", "op": "write"}}, "resolv_conf_modify"), ({"type": "file", "comm": "x", "file": {"filename": "/bin/su", "op": "open", "mode": 0o4755}}, "setuid_binary"),
        ({"type": "dns", "comm": "x", "dns": {"qname": "abcdefghijkl9mno.net", "qtype": 1, "rcode": 0, "direction": 0}}, "dga_domain"), ({"type": "dns", "comm": "x", "dns": {"qname": "abcdefcdnijkl9mno.net", "qtype": 1, "rcode": 0, "direction": 0}}, None),
        ({"type": "dns", "comm": "unbound", "dns": {"qname": "a.example.org", "qtype": 16, "rcode": 0, "direction": 0}}, None), ({"type": "dns", "comm": "python3", "dns": {"qname": "a.example.org", "qtype": 1, "rcode": 3, "direction": 1}}, "nxdomain_response"),
        ({"type": "syscall", "comm": "gdb", "syscall": {"nr": 101}}, None), ({"type": "syscall", "comm": "x", "syscall": {"nr": 101}}, "ptrace_injection"), ({"type": "syscall", "comm": None, "syscall": {"nr": 322}}, "fexecve_fileless_exec"),
    ]
    rows = events.build(spark, [spec for spec, _ in cases])
    found = {x.event_id: x.decision and x.decision.rule_id for x in packs.decide(rows, every).collect()}
    assert found == {i: want for i, (_, want) in enumerate(cases)}
    parents = rows.withColumns({"parent_comm": F.lit("postgres"), "comm": F.lit("bash")})
    assert {x.decision.rule_id for x in packs.decide(parents, packs.LINEAGE).collect()} == {"shell_from_database"}
    assert packs.decide(rows, []).where("decision is null").count() == len(cases)
    assert len(packs.decide(rows, every)._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_pattern_files():
    from argusframe.operators import lineage as ln

    text = "patterns:\n - {name: a, parent_comms: [cron, crond], child_comms: [sh], severity: info}\n - {name: b, parent_comms: [x], child_comms: [y], condition: {field: uid, op: not_in, values: [0]}}\n"
    assert ln.load_patterns(text) == [ln.Pattern("a", ("cron", "crond"), ("sh",), "info"), ln.Pattern("b", ("x",), ("y",), "warning", ("uid", "not_in", (0,)))]
    with pytest.raises(ValueError, match="c: no parents or children; a: twice"):
        ln.load_patterns(text + " - {name: a, parent_comms: [q], child_comms: [r]}\n - {name: c, parent_comms: [q]}\n")


def test_reviews_and_chat(spark):
    from argusframe.sinks import lines

    ask = lambda ns, **spec: json.dumps({"request": {"namespace": ns, "object": {"spec": spec}}})
    rows = [
        (1, ask("shop", hostNetwork=True, hostIPC=True, containers=[{"name": "a", "image": "x:latest", "securityContext": {"privileged": True, "runAsUser": 0, "capabilities": {"add": ["SYS_ADMIN", "CHOWN", "SETUID"]}}}])), (2, ask("kube-system", hostNetwork=True, containers=[{"name": "a", "image": "x:1"}])),
        (3, ask("shop", ephemeralContainers=[{"name": "e", "image": "x:1", "securityContext": {"allowPrivilegeEscalation": True}}], volumes=[{"name": "v", "hostPath": {"path": "/etc"}}, {"name": "w", "hostPath": {"path": "/proc/x"}}, {"name": "u"}])), (4, "no json"), (5, None),
    ]
    found = {x.id: (x.deny, x.warn) for x in po.review(spark.createDataFrame(rows, "id int, value string")).collect()}
    assert found[1] == (["hostNetwork outside the system's namespaces", "hostIPC outside the system's namespaces"], ["container a is privileged", "container a asks for capability SYS_ADMIN", "container a asks for capability SETUID", "container a runs as root", "container a has no fixed image"])
    assert found[2] == ([], []) and found[3] == (["container e may escalate"], ["volume v mounts host path /etc"]) and found[4] == found[5] == ([], [])
    alerts = spark.createDataFrame([("critical", "r", "c", 7, "m" * 5000)], "severity string, rule_id string, comm string, pid long, message string")
    texts = alerts.select(*[lines.chat_json(alerts, k, "42").alias(k) for k in ("slack", "discord", "telegram")]).first()
    assert json.loads(texts.slack)["text"].startswith("[CRITICAL] r: c (pid 7) - mmm") and len(json.loads(texts.discord)["content"]) == 2000 and json.loads(texts.telegram)["chat_id"] == "42" and len(json.loads(texts.telegram)["text"]) == 4096


def test_baselines_merge_in_any_order(spark):
    from argusframe.operators import baselines as bl

    r = random.Random(3)
    rows = [(i, at(r.randrange(900)), r.choice(["w", None]), r.choice("abc")) for i in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA)
    half = [bl.sights(frame.where(F.col("event_id") % 3 == i), ["w"], "v") for i in range(3)]
    key = lambda x: tuple(map(str, x))
    merge = lambda a, b: bl.merged_sights(a, b, ["w"], "v")
    whole = sorted(bl.sights(frame, ["w"], "v").collect(), key=key)
    assert sorted(merge(merge(half[0], half[1]), half[2]).collect(), key=key) == whole == sorted(merge(half[2], merge(half[1], half[0])).collect(), key=key)
    path = folders.scratch(spark, "baseline")
    for i in (2, 0, 0, 1):  # a batch that comes again counts once
        bl.fold_into(half[i], path, ["w"], "v", f"s{i}", 0)
    assert sorted(store.read(spark, path).select(*half[0].columns).collect(), key=key) == whole
    new = spark.createDataFrame([(900, at(1), "w", "a"), (901, at(2), None, "z"), (902, at(3), None, "z")], SCHEMA)
    assert {x.event_id: x.is_new for x in bl.new_against(new, store.read(spark, path), ["w"], "v").collect()} == {900: False, 901: True, 902: False}


def test_rules_on_a_stream_of_logs(spark, tmp_path):
    """stream_since and stream_alerts tell what a batch over the same logs tells; random sampling draws for each rule on its own."""
    from argusframe.sources import logs
    from argusframe.streaming import alerts as sa

    schema = "event_id bigint, event_type string, ts timestamp, pid bigint, comm string"
    r = random.Random(2)
    rows = [(i, r.choice(["file", "dns"]), at(i), i % 7, r.choice(["bash", "sh", "curl", "xmrig", None])) for i in range(300)]
    frame = spark.createDataFrame(rows, schema)
    for i in range(2):
        frame.where(F.col("event_id") % 2 == i).coalesce(1).write.mode("append").json(f"{tmp_path}/log")
    rules = [Rule("shell", "file", C("comm", "in", ("bash", "sh"))), Rule("x", "dns", C("comm", "prefix", ("xm",))), Rule("late", "file", C("pid", "gt", (4,))), Rule("both", "dns", Group("and", (C("comm", "suffix", ("l", "g")), C("pid", "lte", (3,)))))]
    columns = {"comm": F.col("comm"), "pid": F.col("pid")}
    out = sa.stream_alerts(logs.stream_since(spark, f"{tmp_path}/log", schema=schema, files=1), rules, columns)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    key = lambda x: (x.event_id, x.rule_id)
    want = sorted(map(key, ru.evaluate(frame, rules, columns).collect()))
    assert sorted(map(key, spark.read.parquet(f"{tmp_path}/out").collect())) == want and {x[1] for x in want} == {"shell", "x", "late", "both"}
    some = [Rule(n, "file", C("pid", "gte", (0,)), rate=0.5, sampling="random") for n in ("one", "two")]
    many = spark.range(4000).select(F.col("id").alias("event_id"), F.lit("file").alias("event_type"), F.lit(START).alias("ts"), F.col("id").alias("pid"), F.lit("x").alias("comm"))
    drawn = {n: set() for n in ("one", "two")}
    for x in ru.evaluate(many, some, columns).collect():
        drawn[x.rule_id].add(x.event_id)
    assert all(1800 < len(v) < 2200 for v in drawn.values()) and 800 < len(drawn["one"] & drawn["two"]) < 1200


def test_generated_names(spark):
    from argusframe.functions import dns

    words = spark.createDataFrame([(w,) for w in ("the quick brown fox jumps over the lazy dog and runs into the woods " * 3).split()], "word string")
    model = dns.bigram_model(words)
    rows = spark.createDataFrame([("woods.org",), ("xq7zk2vw9p4jh8tb3mn6.org",), ("",)], "q string").select("q", dns.is_generated(F.col("q"), model).alias("g")).collect()
    assert [bool(x.g) for x in rows] == [False, True, False]
