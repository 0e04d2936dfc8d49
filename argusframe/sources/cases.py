"""Rule test cases: events from short descriptions, their verdicts, and reports of them."""

from __future__ import annotations

import datetime as dt
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession

from ..operators.rules import Rule, evaluate, mask_of
from . import events

EPOCH = dt.datetime(2024, 1, 1)


def block_of(kind: str, x: dict) -> dict:
    """A kind's struct with the defaults of what a description leaves out."""
    if kind == "network":
        return {"saddr": x.get("src_ip"), "daddr": x.get("dst_ip"), "sport": x.get("sport", 0), "dport": x.get("dport", 0), "proto": x.get("proto", 6), "family": x.get("family") or "ipv4"}
    if kind == "file":
        return {"filename": x.get("filename", ""), "flags": x.get("flags", 0), "mode": x.get("mode", 0), "op": x.get("op") or "open", "fd_path": x.get("fd_name") or x.get("filename", ""), "fd_path_truncated": False}
    if kind == "privesc":
        old, new = x.get("old_caps", 0), x.get("new_caps", 0)
        return {"old_caps": old | mask_of(tuple(x.get("caps_lost", ()))), "new_caps": new | mask_of(tuple(x.get("caps_gained", ())))}
    if kind == "syscall":
        return {"nr": x["nr"], "ret": x.get("ret", 0), "args": [int(a) for a in x.get("args", [])][:6] + [0] * max(0, 6 - len(x.get("args", [])))}
    if kind in ("tls", "http_plaintext"):
        direction = {"read": 0, "write": 1}.get(x.get("direction", "write"), 1)
        return {"data": x.get("data", ""), "data_len": x.get("data_len", len(x.get("data", "").encode())), "direction": direction} | {k: x[k] for k in ("ja3", "ja4", "ja3s") if k in x}
    return dict(x)


def event_row(i: int, spec: dict) -> dict:
    kind = spec["type"]
    from decimal import Decimal

    block = block_of(kind, spec.get(kind, {}))
    if kind == "syscall":
        block["args"] = [Decimal(a) for a in block["args"]]
    if kind in ("gpu", "cgroup_esc"):
        block = {k: Decimal(v) if k in ("size", "dev_ptr", "host_ptr", "init_cgroup_id", "new_cgroup_id") else v for k, v in block.items()}
    pid = spec.get("pid") or 1
    row = {"event_id": i, "event_type": kind, "ts": spec.get("ts", EPOCH + dt.timedelta(seconds=i)), "pid": pid, "tgid": spec.get("tgid") or pid, "uid": spec.get("uid", 0), "comm": spec.get("comm", "")}
    return row | {k: spec[k] for k in ("ppid", "parent_comm", "proc_args", "namespace", "pod_name") if k in spec} | {events.STRUCTS.get(kind, kind): block}


def run_cases(spark: SparkSession, rules: list[Rule], cases: list[dict], model: dict | None = None) -> list[dict]:
    """A verdict for each case (name, event, expect: alert or no_alert; expect_rule_id or rule_id and expect_severity, optional): one job for
    all cases. Dropped events give no alert. A case whose event can't be built passes only if it expects none."""
    built, out = [], []
    for i, c in enumerate(cases):
        try:
            built.append(event_row(i, c["event"]))
        except (KeyError, ValueError, TypeError) as error:
            out.append({"name": c["name"], "expected": c["expect"], "got": "no_alert", "matched": [], "passed": c["expect"] == "no_alert", "error": str(error)})
    found: dict[int, list[tuple[str, str]]] = {}
    frame: DataFrame = spark.createDataFrame(built, events.SCHEMA)
    for r in evaluate(frame, rules, events.fields(model)).select("event_id", "rule_id", "severity").collect():  # a few for each case
        found.setdefault(r.event_id, []).append((r.rule_id, r.severity))
    for row in built:
        c, hits = cases[row["event_id"]], found.get(row["event_id"], [])
        got, wanted = "alert" if hits else "no_alert", c.get("expect_rule_id") or c.get("rule_id")
        passed = got == c["expect"] and (got != "alert" or ((not wanted or wanted in [h[0] for h in hits]) and (not c.get("expect_severity") or c["expect_severity"] in [h[1] for h in hits])))
        out.append({"name": c["name"], "expected": c["expect"], "got": got, "matched": [h[0] for h in hits], "passed": passed, "error": ""})
    return out


def tap(verdicts: list[dict]) -> str:
    lines = [f"{'ok' if v['passed'] else 'not ok'} {i} - {v['name']}" + ("" if v["passed"] else f" # expected {v['expected']}, got {v['got']}") for i, v in enumerate(verdicts, 1)]
    return "\n".join([f"1..{len(verdicts)}", *lines]) + "\n"


def junit(verdicts: list[dict], suite: str = "rules") -> str:
    failed = sum(not v["passed"] for v in verdicts)
    body = [f"<testcase name={quoteattr(v['name'])}>" + ("" if v["passed"] else f"<failure message={quoteattr('expected ' + v['expected'] + ', got ' + v['got'])}/>") + "</testcase>" for v in verdicts]
    return f'<testsuite name={quoteattr(suite)} tests="{len(verdicts)}" failures="{failed}">' + "".join(body) + "</testsuite>"


def scenarios() -> list[dict]:
    """Own attacks for dry runs, each with the rules that should see it; their events use other fields and values than the rules' plainest ones."""
    at = lambda i, rules, **spec: {"id": i, "rule_ids": rules, "event": {"pid": 99_990, "uid": 0} | spec}
    return [
        at("group-passwords-read", ["shadow_opened"], type="file", comm="backup-job", uid=4021, file={"filename": "/etc/gshadow", "op": "open"}),
        at("loader-list-appended", ["preload_written"], type="file", comm="installer", uid=12, file={"filename": "/etc/ld.so.preload", "op": "open", "flags": 1025}),
        at("second-stratum-port", ["mining_port"], type="network", comm="render-node", uid=700, network={"src_ip": "10.9.0.4", "dst_ip": "198.51.100.77", "dport": 4444}),
        at("service-gains-admin", ["admin_gained"], type="privesc", comm="log-shipper", uid=33, privesc={"caps_gained": ["CAP_SYS_ADMIN", "CAP_NET_RAW"]}),
        at("driver-from-memory", ["module_from_memory"], type="kmod", comm="modprobe", kmod={"mod_name": "usbhid2", "from_tmpfs": True}),
        at("first-process-traced", ["ptrace_of_init"], type="syscall", comm="profiler", uid=1000, syscall={"nr": 101, "args": [16902, 1]}),
    ]
