"""The event frame: one row an event, one struct column a kind, and the fields that rules see of each kind, as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dns, fields as fn, names

SCHEMA = """event_id bigint, event_type string, ts timestamp, pid bigint, tgid bigint, ppid bigint, uid bigint, comm string, parent_comm string, proc_args string, proc_args_truncated boolean,
syscall struct<nr:bigint,ret:bigint,args:array<decimal(20,0)>>,
network struct<saddr:string,daddr:string,sport:int,dport:int,proto:int,family:string>,
file struct<filename:string,flags:int,mode:bigint,op:string,fd_path:string,fd_path_truncated:boolean>,
tls struct<direction:int,data_len:bigint,data:string,ja3:string,ja4:string,ja3s:string>,
http struct<direction:int,data_len:bigint,data:string>,
dns struct<qname:string,qtype:int,rcode:int,direction:int,response_ips:array<string>>,
privesc struct<old_caps:bigint,new_caps:bigint>,
net_close struct<saddr:string,daddr:string,sport:int,dport:int,family:string,duration_ns:bigint>,
kmod struct<mod_name:string,from_tmpfs:boolean>,
cgroup_esc struct<init_cgroup_id:decimal(20,0),new_cgroup_id:decimal(20,0)>,
gpu struct<op:string,dev_ptr:decimal(20,0),host_ptr:decimal(20,0),size:decimal(20,0)>,
io_uring struct<op:string,flags:bigint,fd:int,to_submit:bigint>,
bpf_program struct<cmd:bigint,prog_type:bigint,ret:int>,
cloud struct<provider:string,service:string,action:string,principal:string,resource:string,source_ip:string,user_agent:string,error_code:string,region:string,event_id:string>,
namespace string, pod_name string, container_id string, labels map<string,string>"""
#: The struct column of each kind whose name differs.
STRUCTS = {"http_plaintext": "http", "cloud_audit": "cloud"}
#: Longer names that rule files may use.
ALIASES = {
    "file.path": "filename", "proc.comm": "comm", "dns.qname": "qname",
    **{f"file.{x}": x for x in ("op", "flags", "mode", "directory", "extension")},
    **{f"network.{x}": x for x in ("dport", "sport", "daddr", "saddr", "proto", "family")},
    **{f"syscall.{x}": x for x in ("nr", "ret", "arg0", "arg1", "arg2", "arg3", "arg4", "arg5")},
}
#: Kinds whose fields rules may name although no event resolves them; tests of those fields are false.
NAMED_ONLY = {"dns": {"comm"}, "tls": {"comm"}, "cgroup_esc": {"new_cgroup_id", "old_cgroup_id", "cgroup_path", "comm", "uid"}, "lsm_audit": {"hook", "comm", "uid", "decision"}, "sequence": {"pattern", "comm", "uid"}}


def flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "true").otherwise("false")


def pointer(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.conv(c.cast("string"), 10, 16)))


def fields(model: Mapping[str, float] | None = None) -> dict[str, dict[str, Column]]:
    """The fields of each kind. model: of ``dns.bigram_model``; without it names score 0. Missing values are empty texts, as in ``rules``."""
    c, none = F.col, F.lit("")
    text = lambda x: F.coalesce(x.cast("string"), none)
    who = {"comm": text(c("comm")), "uid": text(c("uid"))}
    args = {"proc.args": text(c("proc_args")), "proc.args_truncated": flag(c("proc_args_truncated"))}
    qname, path = c("dns.qname"), c("file.filename")
    score = dns.bigram_score(qname, dict(model)) if model else F.lit(0.0)
    four = lambda x: F.format_string("%.4f", x)
    out = {
        "network": {x: c(f"network.{x}") for x in ("dport", "sport", "daddr", "saddr", "proto", "family")} | args | who,
        "file": {"filename": path, "fd.name": c("file.fd_path"), "fd.name_truncated": flag(c("file.fd_path_truncated")), "flags": c("file.flags"), "mode": c("file.mode"), "op": c("file.op"), "directory": fn.directory(path), "extension": fn.extension(path)} | args | who,
        "syscall": {"nr": c("syscall.nr"), "ret": c("syscall.ret"), "fd.name": c("file.fd_path")} | {f"arg{i}": F.get(c("syscall.args"), F.lit(i)) for i in range(6)} | args | who,
        "dns": {
            "qname": qname, "qtype": names.dns_type(c("dns.qtype")), "rcode": names.dns_code(c("dns.rcode")), "direction": c("dns.direction"), "qname_length": F.octet_length(qname), "qname_entropy": four(fn.entropy(fn.base_domain(qname))),
            "qname_dga_score": four(score), "qname_digit_ratio": four(fn.digit_ratio(qname)), "qname_subdomain_count": fn.subdomain_count(qname), "qname_is_dga": flag(fn.is_generated(qname) | (score >= dns.GENERATED)),
        },
        "tls": {"tls_data": c("tls.data"), "data": c("tls.data"), "direction": c("tls.direction"), "data_len": c("tls.data_len"), "ja3": c("tls.ja3"), "ja4": c("tls.ja4"), "ja3s": c("tls.ja3s")},
        "http_plaintext": {"http_data": c("http.data"), "data": c("http.data"), "direction": c("http.direction"), "data_len": c("http.data_len"), "comm": who["comm"]},
        "privesc": {"caps": F.concat(F.lit("0x"), F.lower(F.hex(F.coalesce(c("privesc.new_caps"), F.lit(0))))), "old_caps": c("privesc.old_caps"), "new_caps": c("privesc.new_caps")} | who,
        "net_close": {x: c(f"net_close.{x}") for x in ("dport", "sport", "daddr", "saddr", "family")} | {"duration_sec": F.floor(c("net_close.duration_ns") / 1_000_000_000), "duration_ms": F.floor(c("net_close.duration_ns") / 1_000_000)},
        "gpu": {"gpu_op": c("gpu.op"), "gpu_size": c("gpu.size"), "gpu_dev_ptr": pointer(c("gpu.dev_ptr")), "gpu_host_ptr": pointer(c("gpu.host_ptr"))} | who,
        "cloud_audit": {f"cloud.{x}": c(f"cloud.{x}") for x in ("provider", "service", "action", "principal", "resource", "source_ip", "user_agent", "error_code", "region", "event_id")},
        "kmod": {"name": c("kmod.mod_name"), "filename": c("kmod.mod_name"), "from_tmpfs": flag(c("kmod.from_tmpfs")), "parent_comm": text(c("parent_comm")), "fingerprint": none} | who,
        "io_uring": {x: c(f"io_uring.{x}") for x in ("op", "flags", "fd", "to_submit")} | who,
        "bpf_program": {"cmd": names.bpf_command(c("bpf_program.cmd")), "cmd_nr": c("bpf_program.cmd"), "prog_type": names.bpf_type(c("bpf_program.prog_type")), "prog_type_nr": c("bpf_program.prog_type"), "ret": c("bpf_program.ret")} | who,
        "cgroup_esc": {}, "lsm_audit": {}, "sequence": {},
    }
    for kind, own in out.items():
        block = STRUCTS.get(kind, kind)
        if kind not in ("cgroup_esc", "lsm_audit", "sequence"):
            empty = c(block).isNull()  # an event without its block has only empty fields
            out[kind] = {n: F.when(empty, none).otherwise(text(x)) if n not in ("old_caps", "new_caps") else x for n, x in own.items()}
    return out


def known_fields() -> dict[str, set[str]]:
    """The names that rules may use, by kind, longer ones included."""
    out = {kind: set(own) - {"old_caps", "new_caps"} | NAMED_ONLY.get(kind, set()) for kind, own in fields().items()}
    out["syscall"] |= {"comm"}
    return {kind: own | {a for a, x in ALIASES.items() if x in own} for kind, own in out.items()}


def build(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """Events from short descriptions: type, pid, uid, comm and one block named like the kind; see ``cases`` for the blocks' defaults."""
    from .cases import event_row

    return spark.createDataFrame([event_row(i, s) for i, s in enumerate(specs)], SCHEMA)
