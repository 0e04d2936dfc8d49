"""Names of numeric codes in events; a code without a name keeps its number."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The codes as kernels and protocols number them.
FILE_OPS = {0: "open", 1: "read", 2: "write"}
GPU_OPS = {0: "alloc", 1: "free", 2: "memcpy_htod", 3: "memcpy_dtoh", 4: "memcpy_dtod", 5: "kernel_launch"}
BPF_COMMANDS = {0: "MAP_CREATE", 1: "MAP_LOOKUP_ELEM", 2: "MAP_UPDATE_ELEM", 3: "MAP_DELETE_ELEM", 4: "MAP_GET_NEXT_KEY", 5: "PROG_LOAD", 6: "OBJ_PIN", 7: "OBJ_GET", 8: "PROG_ATTACH", 9: "PROG_DETACH"}
BPF_TYPES = {0: "SOCKET_FILTER", 3: "SCHED_CLS", 4: "SCHED_ACT", 5: "TRACEPOINT", 6: "XDP", 8: "CGROUP_SKB", 11: "SK_MSG", 15: "KPROBE", 17: "CGROUP_SOCK_ADDR", 26: "LSM", 28: "STRUCT_OPS", 31: "SK_LOOKUP"}
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 255: "ANY"}
DNS_CODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}


def named(code: Column, names: Mapping[int, str], prefix: str = "") -> Column:
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(k).cast("long"), F.lit(v))])
    return F.coalesce(F.try_element_at(known, code.cast("long")), F.concat(F.lit(prefix), code.cast("string")))


def file_op(code: Column) -> Column:
    return named(code, FILE_OPS)


def gpu_op(code: Column) -> Column:
    return named(code, GPU_OPS)


def io_uring_op(code: Column) -> Column:
    return F.when(code == 0, "setup").otherwise("enter")


def bpf_command(code: Column) -> Column:
    return named(code, BPF_COMMANDS, "BPF_CMD_")


def bpf_type(code: Column) -> Column:
    return named(code, BPF_TYPES, "UNKNOWN_")


def dns_type(code: Column) -> Column:
    return named(code, DNS_TYPES, "TYPE")


def dns_code(code: Column) -> Column:
    return named(code, DNS_CODES, "RCODE")


def family(code: Column) -> Column:
    return F.when(code == 10, "ipv6").otherwise("ipv4")
