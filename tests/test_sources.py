"""Rule files, the event frame and its cases, logs, wire formats, stores, policies, plugins and streams, on hand-written inputs."""

import datetime as dt
import hashlib
import ipaddress
import json
import random
import struct

import numpy as np
import pandas as pd
import pytest

from argusframe.functions import fields as fn
from argusframe.operators import alerts as al
from argusframe.operators import baselines as bl
from argusframe.operators import behaviour as bh
from argusframe.operators import policy as po
from argusframe.operators.rules import Condition, Group, overlay, problems, Rule
from argusframe.sinks import store
from argusframe.sources import cases, events, logs, rule_files, wire
from argusframe.streaming import alerts as st
from pyspark.sql import functions as F

RULES = """
rules:
  - {id: ptrace_of_init, name: Trace of init, event_type: syscall, severity: critical, tags: ["mitre:T1611"], condition_group: {operator: and, conditions: [{field: syscall.nr, op: equals, values: [101]}, {field: arg1, op: equals, values: ["1"]}]}}
  - {id: mining_port, name: Mining port, event_type: network, severity: critical, condition: {field: network.dport, op: in, values: [3333, 4444]}, exceptions: [{name: pool, condition: {field: proc.comm, op: prefix, values: [pool-]}}]}
  - {id: generated_name, name: Generated name, event_type: dns, condition: {field: qname_is_dga, op: equals, values: ["true"]}}
  - {id: preload_written, name: Preload, event_type: file, severity: critical, condition_group: {operator: and, conditions: [{field: file.path, op: equals, values: [/etc/ld.so.preload]}], subgroups: [{operator: or, conditions: [{field: op, op: equals, values: [write]}, {field: flags, op: gt, values: [0]}]}]}}
  - {id: shadow_opened, name: Shadow, event_type: file, condition_group: {operator: and, conditions: [{field: directory, op: equals, values: [/etc]}, {field: filename, op: suffix, values: [shadow]}, {field: uid, op: neq, values: ["0"]}]}}
  - {id: admin_gained, name: Admin, event_type: privesc, severity: critical, condition: {field: caps, op: caps_gained, values: [CAP_SYS_ADMIN]}}
  - {id: module_from_memory, name: Module, event_type: kmod, condition: {field: from_tmpfs, op: equals, values: [true]}}
  - {id: silent, name: Dropped, event_type: file, action: drop, condition: {field: filename, op: prefix, values: [/]}}
"""


@pytest.fixture(scope="module")
def rules(spark):
    return rule_files.load_text(RULES)


def test_scenarios_and_cases(spark, rules):
    own = [{"name": s["id"], "event": s["event"], "expect": "alert", "rule_id": s["rule_ids"][0]} for s in cases.scenarios()]
    own += [
        {"name": "root reads shadow", "event": {"type": "file", "uid": 0, "file": {"filename": "/etc/shadow"}}, "expect": "no_alert"},
        {"name": "excepted", "event": {"type": "network", "comm": "pool-7", "network": {"dport": 3333}}, "expect": "no_alert"},
        {"name": "severity", "event": {"type": "network", "comm": "x", "network": {"dport": 4444}}, "expect": "alert", "expect_severity": "critical"},
        {"name": "wrong severity", "event": {"type": "network", "comm": "x", "network": {"dport": 4444}}, "expect": "alert", "expect_severity": "warning"},
        {"name": "no block", "event": {"type": "syscall"}, "expect": "no_alert"},
    ]
    found = {v["name"]: v for v in cases.run_cases(spark, rules, own)}
    assert [n for n, v in found.items() if not v["passed"]] == ["wrong severity"]
    assert found["no block"]["error"] and "silent" not in sum((v["matched"] for v in found.values()), [])
    text, xml = cases.tap(list(found.values())), cases.junit(list(found.values()))
    assert text.startswith(f"1..{len(own)}\n") and text.count("not ok") == 1 and 'failures="1"' in xml


def test_rule_files(spark, rules, tmp_path):
    assert len(rules) == 8 and rules[1].when == Condition("dport", "in", ("3333", "4444")) and isinstance(rules[3].when, Group) and rules[0].tags == ("mitre:T1611",)
    bad = [
        {"id": "a", "name": "a", "event_type": "file", "condition": {"field": "dport", "op": "in", "values": []}}, {"id": "a", "name": "", "event_type": "none"}, {"id": "b", "name": "b", "event_type": "file", "action": "explode", "class": "x", "condition_group": {"conditions": []}},
        {"id": "c", "name": "c", "event_type": "network", "sampling": {"rate": 2, "mode": "odd"}, "condition": {"field": "daddr", "op": "in_cidr", "values": ["10.0.0.0/99"]}}, {"id": "d", "name": "d", "event_type": "file", "condition": {"field": "filename", "op": "regex", "values": ["("]}},
        {"id": "e", "name": "e", "event_type": "network", "condition": {"field": "dport", "op": "in_cidr", "values": ["10.0.0.0/8"]}},
    ]
    with pytest.raises(rule_files.RuleErrors) as error:
        rule_files.load_text(json.dumps({"rules": bad}))
    for part in ("unknown field dport", "duplicate id", "unknown event type", "name is required", "unknown action", "unknown class", "empty group", "sample rate", "sampling mode", "no network", "no pattern", "holds no addresses"):
        assert part in str(error.value), part
    (tmp_path / "a.yaml").write_text(RULES)
    (tmp_path / "note.txt").write_text("no rules")
    listed = rule_files.checksums_of(f"{hashlib.sha256(RULES.encode()).hexdigest()}  a.yaml\n")
    assert len(rule_files.load_files(str(tmp_path), listed)) == 8
    with pytest.raises(rule_files.RuleErrors):
        rule_files.load_files(str(tmp_path), {"a.yaml": "0" * 64})
    tuned, unknown = overlay(rules, rule_files.load_overlay("overlays: [{rule_id: mining_port, exceptions: [{name: x, condition: {field: uid, op: eq, values: ['7']}}]}, {rule_id: zz}]"))
    assert unknown == ["zz"] and len(tuned[1].exceptions) == 2
    assert not problems([Rule("x", "network", Condition("daddr", "in_cidr", ("::1/128",)))], events.known_fields())


def test_logs(spark, tmp_path):
    rows = logs.synthetic(spark, 300)
    assert rows.dtypes == spark.createDataFrame([], events.SCHEMA).dtypes and sorted(logs.synthetic(spark, 300).select("event_id", "ts").collect()) == sorted(rows.select("event_id", "ts").collect())
    logs.append_log(rows, f"{tmp_path}/log")
    with open(f"{tmp_path}/log/day=2024-01-01/broken.json", "w") as f:
        f.write('not json\n{"event_id": "x", "ts": 3}\n')
    cut = "2024-01-01 12:00:00"
    assert logs.read_since(spark, f"{tmp_path}/log", cut).count() == rows.where(F.col("ts") > F.lit(cut).cast("timestamp")).count()
    assert logs.read_since(spark, f"{tmp_path}/log").count() == 300
    assert spark.createDataFrame([([104, 105, 0, 9],), ([97],)], "x array<int>").select(logs.char_array(F.col("x")).alias("t")).collect() == [("hi",), ("a",)]
    misp = json.dumps({"response": {"Attribute": [{"type": "ip-dst", "value": "1.2.3.4"}, {"type": "domain", "value": "Bad.Example"}, {"type": "md5", "value": "x"}]}})
    assert {tuple(r) for r in logs.indicator_frames(spark.createDataFrame([(misp,)], "value string"), "misp").collect()} == {("ip", "1.2.3.4"), ("dns", "bad.example")}


def hello(extensions: bytes) -> bytes:
    body = struct.pack(">H", 0x0303) + bytes(32) + b"\x00" + struct.pack(">H6H", 12, 0x0A0A, 0x1301, 0x1302, 0xC02B, 0xC02F, 0x00FF) + b"\x01\x00" + struct.pack(">H", len(extensions)) + extensions
    return b"\x16\x03\x01" + struct.pack(">H", len(body) + 4) + b"\x01" + len(body).to_bytes(3, "big") + body


def test_wire(spark):
    name = b"\x03www\x07example\x03org\x00"
    answer = struct.pack(">HHHHHH", 1, 0x8003, 1, 2, 0, 0) + name + struct.pack(">HH", 28, 1) + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes([9, 8, 7, 6]) + b"\xc0\x10" + struct.pack(">HHIH", 5, 1, 60, 2) + b"\xc0\x0c"
    loop = struct.pack(">HHHHHH", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c\x00\x01\x00\x01"
    rows = spark.createDataFrame([(0, answer), (1, loop), (2, b"\x00"), (3, None), (4, answer[:20])], "i int, b binary").select("i", wire.parse_dns(F.col("b")).alias("m")).orderBy("i").collect()
    assert tuple(rows[0].m) == ("www.example.org", 28, 3, 1, ["9.8.7.6"]) and [r.m.qname for r in rows[1:]] == [None] * 4
    sni = b"\x00\x0e\x00\x00\x0b" + b"a.example.z"
    extensions = struct.pack(">HH", 0, 16) + sni + struct.pack(">HHHHH", 10, 6, 4, 0x001D, 0x0017) + struct.pack(">HHBB", 11, 2, 1, 0) + struct.pack(">HHHH", 13, 4, 2, 0x0403) + struct.pack(">HHH", 16, 5, 3) + b"\x02h2" + struct.pack(">HHB2H", 43, 5, 4, 0x0A0A, 0x0304)
    rows = spark.createDataFrame([(0, hello(extensions)), (1, hello(extensions)[:40]), (2, b"GET /"), (3, None)], "i int, b binary").select("i", wire.parse_hello(F.col("b")).alias("m")).orderBy("i").collect()
    m = rows[0].m
    assert (m.version, m.ciphers, m.extensions, m.curves, m.formats, m.sni, m.alpn, m.signatures) == (0x0304, [0x1301, 0x1302, 0xC02B, 0xC02F, 0xFF], [0, 10, 11, 13, 16, 43], [29, 23], [0], "a.example.z", ["h2"], [0x0403])
    assert [r.m.version for r in rows[1:]] == [None] * 3


def test_ipv6_text(spark):
    r = random.Random(4)
    numbers = [0, 1, 1 << 112, 0x20010DB8 << 96, (0x20010DB8 << 96) | 1, (1 << 128) - 1] + [sum((r.choice([0, 0, r.randrange(65536)])) << (16 * i) for i in range(8)) for _ in range(300)]
    rows = spark.createDataFrame([(f"{n:032x}",) for n in numbers], "h string").select(fn.ipv6_text(F.col("h")).alias("t")).collect()
    assert [x.t for x in rows] == [str(ipaddress.IPv6Address(n)) for n in numbers]


def test_store_and_exports(spark, tmp_path):
    path = f"{tmp_path}/alerts"
    frame = lambda rows: spark.createDataFrame(rows, "id string, arrived int, message string")
    store.merge(frame([("a", 1, "x"), ("b", 1, "y")]), path)
    write = store.batch_writer(path)
    for _ in range(2):  # a batch that comes again
        write(frame([("a", 2, "z"), ("c", 2, "w")]), 7)
    assert {(r.id, r.message) for r in store.read(spark, path).collect()} == {("a", "z"), ("b", "y"), ("c", "w")}
    assert store.read(spark, f"{tmp_path}/none") is None
    gone = spark.createDataFrame([("b",), ("nothing",), (None,)], "id string")
    store.delete(gone, path)
    store.delete(gone, f"{tmp_path}/none")
    assert {(r.id, r.message) for r in store.read(spark, path).collect()} == {("a", "z"), ("c", "w")} and store.read(spark, path).columns == ["id", "arrived", "message"]
    profile = spark.createDataFrame([([3, 1], ["/bin/x"], [])], "syscalls array<int>, paths array<string>, ports array<int>")
    assert [r.id for r in rule_files.load_text(store.export_rules(profile))] == ["learned_syscalls", "learned_paths"]
    assert json.loads(store.export_seccomp(profile, {1: "write"}))["syscalls"][0]["names"] == ["write", "3"]


def test_request_parameters():
    now = dt.datetime(2024, 1, 2)
    f, limit, offset = al.parsed({"since": "1h30m", "until": "soon", "pid": "7", "severity": "Critical, odd", "rule_id": "a,b", "limit": "5", "offset": "x", "namespace": "n"}, now)
    assert (f.since, f.until, f.pids, f.severities, f.rules, limit, offset) == ("2024-01-01T22:30:00", None, [7], ["critical"], ["a", "b"], 5, 0)
    assert al.scoped(f, ["*"]) == f and al.scoped(f, ["n", "m"]).namespaces == ["n"] and al.scoped(f, ["m"]).namespaces == ["\0none"]


def test_sequence_distance(spark):
    r = random.Random(6)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), r.choice("xy"), r.choice([1, 2, 3, 600] if i < 250 else [40, 41])) for i in range(400)]
    found = {x.event_id: (x.distance, x.is_anomaly) for x in bl.sequence_distance(spark.createDataFrame(rows, "event_id long, ts timestamp, pid string, nr int"), ["pid"], "nr", window=16).collect()}
    seen = set()
    for pid in "xy":
        codes, base = [], None
        for i, _, p, nr in rows:
            if p != pid:
                continue
            codes.append(nr)
            want = (0.0, False)
            if len(codes) >= 16:
                now = np.bincount([c for c in codes[-16:] if c < 512], minlength=512) / 16
                if base is None:
                    base = now
                else:
                    norm = np.linalg.norm(now) * np.linalg.norm(base)
                    apart = 1 - now @ base / norm if norm else 1.0
                    want = (apart, apart > 0.3)
                    if apart <= 0.3:
                        base = base * 0.9 + now * 0.1
            assert abs(found[i][0] - want[0]) < 1e-5 and found[i][1] == want[1]
            seen.add(want[1])
    assert seen == {True, False}


def test_admission(spark):
    pod = lambda **spec: json.dumps({"spec": spec})
    rows = [(1, pod(containers=[{"name": "a", "image": "x:1", "securityContext": {"privileged": True, "runAsNonRoot": True, "allowPrivilegeEscalation": False}}], hostPID=True)), (2, pod(containers=[{"name": "b", "image": "x:latest"}], volumes=[{"name": "v", "hostPath": {"path": "/"}}])), (3, "no json"), (4, None)]
    found = {r.id: (r.deny, r.warn) for r in po.admission(spark.createDataFrame(rows, "id int, value string")).collect()}
    assert found[1] == (["container is privileged: a", "pod shares the host's processes"], [])
    assert found[2] == ([], ["container may escalate: b", "container may run as root: b", "container has no fixed image: b", "pod mounts a host path: /"]) and found[3] == found[4] == ([], [])


def test_policies_and_plugins(spark):
    own = events.build(spark, [{"type": "network", "comm": "bash", "uid": 5, "network": {"dst_ip": "8.8.8.8", "dport": 9001}}, {"type": "file", "comm": "x", "file": {"filename": "/home/a/.ssh/id_rsa"}}, {"type": "dns", "comm": "x", "dns": {"qname": "a.nanopool.org", "qtype": 16, "rcode": 0, "direction": 0}}, {"type": "syscall", "comm": "x", "syscall": {"nr": 101, "args": [16]}}])
    every = [p for pack in po.PACKS.values() for p in pack]
    found = {r.event_id: r.decision.rule_id for r in po.decide(own, every).collect()}
    assert found == {0: "tor_port", 1: "ssh_key_opened", 2: "mining_pool_query", 3: "ptrace_attach"}
    plugins = po.Plugins()
    plugins.register("broken", lambda pdf: 1 / 0)
    plugins.register("frames", lambda pdf: pd.DataFrame({"matched": pdf["comm"] == "x", "severity": "info", "message": pdf["comm"]}))
    plugins.handler("rows")(lambda e: ("critical", "b") if e["comm"] == "bash" else None)
    assert sorted((r.event_id, r.rule_id, r.severity) for r in plugins.evaluate(own.select("event_id", "comm")).collect()) == [(0, "rows", "critical"), (1, "frames", "info"), (2, "frames", "info"), (3, "frames", "info")]


def test_streams(spark, tmp_path):
    r = random.Random(8)
    rows = sorted((r.randrange(0, 400), r.choice("ab\n\t"), r.choice("xy"), r.choice(["warning", "critical"])) for _ in range(200))
    frame = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), k, rule, v) for i, (s, k, rule, v) in enumerate(rows)], "event_id long, ts timestamp, k string, rule_id string, severity string")
    end = spark.createDataFrame([(9999, dt.datetime(2024, 1, 2), "end", "end", "info")], frame.schema)
    frame.union(end).repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "10 seconds")
    for name, out in (("sessions", st.stream_incidents(source, ["k"], "5 seconds")), ("admitted", st.stream_limited(source, "rule_id", ["k", "severity"]))):
        out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    key = lambda x: tuple(map(str, x))
    want = bh.incidents(frame, ["k"], "5 seconds").select("k", "first_seen", "last_seen", "n", "severity", "n_rules").collect()
    assert sorted(map(key, spark.table("sessions").where("k <> 'end'").select("k", "first_seen", "last_seen", "n", "severity", "n_rules").collect())) == sorted(map(key, want))
    want = sorted(x.event_id for x in bh.limited(frame, "rule_id", ["k", "severity"]).collect())
    assert sorted(x.event_id for x in spark.table("admitted").where("k <> 'end'").collect()) == want


def test_cef_event_escapes(spark):
    from argusframe.sinks import lines

    rows = spark.sql(r"""SELECT timestamp'2024-03-05 06:07:08' AS ts, 'r|1=\\' AS rule_id, CAST(null AS string) AS rule_name, 'critical' AS severity, 7 AS pid, 'c=\n' AS comm, 'a=b|c\\\r' AS message, 'f' AS fingerprint""")
    assert rows.select(lines.cef_event(rows).alias("x")).first().x == (
        r"CEF:0|argusframe|argusframe|1.0|r\|1=\\|r\|1=\\|10|rt=Mar 05 2024 06:07:08 suser=c\=  spid=7 cs1Label=rule_id cs1=r|1\=\\ cs5Label=fingerprint cs5=f msg=a\=b|c\\ "
    )
