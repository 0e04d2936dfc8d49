"""Policies beside rules: named predicates that judge an event or alert together, admission checks of pods, audit queries, plugins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dns
from ..functions.fields import ipv4_number
from . import lineage
from .rules import any_of

DECISION = "struct<rule_id:string,severity:string,message:string,action:string,technique:string>"
#: Ports and process names of the packs.
MINING_PORTS, TOR_PORTS = (3333, 4444, 5555, 7777, 8888, 9999, 14444, 45700), (9001, 9030)
DATABASES = ("mysqld", "postgres", "mongod", "redis-server")
WEB_SERVERS = ("nginx", "apache2", "httpd", "node", "gunicorn", "uwsgi")


@dataclass(frozen=True)
class Policy:
    """when: a column over the event frame; message: a column."""

    id: str
    when: Callable[[], Column]
    message: Callable[[], Column]
    severity: str = "warning"
    action: str = "alert"
    technique: str = ""


def is_private(ip: Column) -> Column:
    n = ipv4_number(ip)
    return F.coalesce(n.between(10 << 24, (11 << 24) - 1) | n.between(2886729728, 2887778303) | n.between(3232235520, 3232301055) | n.between(127 << 24, (128 << 24) - 1), F.lit(False))


#: Whether network.daddr is private; ``decide`` makes it once for all policies.
PRIVATE = "__private"


def said(text: str, *names: str) -> Callable[[], Column]:
    return lambda: F.format_string(text, *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])


def shell(c: str = "comm") -> Column:
    return F.col(c).isin(list(lineage.SHELLS))


NETWORK = [
    Policy("mining_connection", lambda: F.col("network.dport").isin(list(MINING_PORTS)) & ~F.col(PRIVATE), said("%s connects to a mining port (pid=%s)", "comm", "pid"), "critical", "block", "T1496"),
    Policy("miner_with_network", lambda: F.col("network").isNotNull() & dns.is_miner(F.col("comm")), said("miner %s uses the network (pid=%s)", "comm", "pid"), "critical", "block", "T1496"),
    Policy("privileged_port_nonroot", lambda: (F.col("network.dport") < 1024) & (F.col("uid") != 0) & ~F.col(PRIVATE), said("%s of user %s connects to a privileged port", "comm", "uid"), technique="T1048"),
    Policy("shell_goes_out", lambda: (F.col("network.proto") == 6) & shell() & ~F.col(PRIVATE), said("shell %s connects to %s", "comm", "network.daddr"), technique="T1071"),
    Policy("tor_port", lambda: F.col("network.dport").isin(list(TOR_PORTS)), said("%s connects to a Tor port (pid=%s)", "comm", "pid"), "critical", technique="T1090"),
]
LINEAGE = [
    Policy("shell_of_web_server", lambda: F.col("parent_comm").isin(list(WEB_SERVERS)) & shell() & F.col("file").isNull(), said("%s spawned by %s", "comm", "parent_comm"), "critical", technique="T1059"),
    Policy("shell_of_database", lambda: F.col("parent_comm").isin(list(DATABASES)) & shell(), said("%s spawned by %s", "comm", "parent_comm"), "critical", technique="T1190"),
]
FILE = [
    Policy("sudoers_written", lambda: F.col("file.filename").contains("/etc/sudoers") & (F.col("file.op") == "write"), said("%s writes %s", "comm", "file.filename"), "critical", technique="T1548"),
    Policy("ssh_key_opened", lambda: F.col("file.filename").contains(".ssh/") & F.col("file.filename").contains("id_"), said("%s opens %s", "comm", "file.filename"), technique="T1552"),
    Policy("host_reached_by_proc", lambda: F.col("file.filename").rlike(r"^/proc/1/(root|ns|cwd)"), said("%s reaches the host by %s", "comm", "file.filename"), "critical", "block", "T1611"),
]
DNS = [
    Policy("txt_query", lambda: F.col("dns.qtype") == 16, said("TXT query for %s", "dns.qname"), technique="T1071.004"),
    Policy("long_query", lambda: F.octet_length("dns.qname") > 50, said("long query %s", "dns.qname"), technique="T1048"),
    Policy("mining_pool_query", lambda: dns.is_mining_name(F.col("dns.qname")), said("query for a mining pool %s", "dns.qname"), "critical", technique="T1496"),
    Policy("dynamic_name_query", lambda: dns.is_dynamic_name(F.col("dns.qname")), said("query for a dynamic name %s", "dns.qname"), technique="T1568"),
]
INJECTION = [
    Policy("ptrace_attach", lambda: (F.col("syscall.nr") == 101) & F.get("syscall.args", F.lit(0)).isin(4, 5, 16), said("%s traces another process (pid=%s)", "comm", "pid"), "critical", technique="T1055.008"),
    Policy("remote_memory_written", lambda: F.col("syscall.nr") == 311, said("%s writes another process's memory (pid=%s)", "comm", "pid"), "critical", technique="T1055"),
]
CLUSTER = [
    Policy("service_token_read", lambda: F.col("file.filename").startswith("/var/run/secrets/kubernetes.io/serviceaccount/") & shell(), said("shell %s reads a service token", "comm"), technique="T1528"),
    Policy("kubelet_api", lambda: F.col("network.dport").isin(10250, 10255) & (F.col("uid") != 0), said("%s calls the kubelet", "comm"), technique="T1613"),
]
PACKS = {"network": NETWORK, "lineage": LINEAGE, "file": FILE, "dns": DNS, "process_injection": INJECTION, "k8s": CLUSTER}


def decide(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """Adds decision: the first critical one, else the first; null if no policy fits. Where it isn't null it stands in for the rule's id,
    severity and message. Each predicate is asked once, critical ones first, until one holds; only the chosen one's message is made."""
    if not policies:
        return rows.withColumn("decision", F.lit(None).cast(DECISION))
    chosen = F.lit(None).cast("int")
    order = sorted(range(len(policies)), key=lambda i: policies[i].severity != "critical")
    for i in reversed(order):
        chosen = F.when(policies[i].when(), i).otherwise(chosen)
    said = F.lit(None).cast("string")
    for i in reversed(order):
        said = F.when(F.col("__chosen") == i, policies[i].message()).otherwise(said)
    of = lambda name: F.get(F.lit([getattr(p, name) for p in policies]), F.col("__chosen"))
    made = F.struct(of("id").alias("rule_id"), of("severity").alias("severity"), said.alias("message"), of("action").alias("action"), of("technique").alias("technique"))
    if "network" in rows.columns:
        rows = rows.withColumn(PRIVATE, is_private(F.col("network.daddr")))
    # out of an array, so that a filter on what follows isn't pushed below it and asks all again
    return rows.withColumn("__chosen", F.explode_outer(F.array(chosen))).withColumn("decision", F.when(F.col("__chosen").isNotNull(), made)).drop("__chosen", PRIVATE)


def overridden(alerts: DataFrame) -> DataFrame:
    """Alerts with what their decision says in place of their own; action and technique are added."""
    d = F.col("decision")
    own = {n: F.coalesce(d[n], F.col(n)) if n in alerts.columns else d[n] for n in ("rule_id", "severity", "message", "action", "technique")}
    return alerts.withColumns(own).drop("decision")


POD = "metadata struct<name:string,namespace:string>, spec struct<hostNetwork:boolean,hostPID:boolean,hostIPC:boolean,containers:array<struct<name:string,image:string,securityContext:struct<privileged:boolean,runAsUser:bigint,runAsNonRoot:boolean,allowPrivilegeEscalation:boolean>>>,volumes:array<struct<name:string,hostPath:struct<path:string>>>>"


def admission(pods: DataFrame, column: str = "value", id_col: str = "id") -> DataFrame:
    """(id, deny, warn): the messages about a pod (JSON); any in deny refuses it."""
    spec = F.from_json(column, POD)["spec"]
    boxes = F.coalesce(spec["containers"], F.array().cast("array<struct<name:string,image:string,securityContext:struct<privileged:boolean,runAsUser:bigint,runAsNonRoot:boolean,allowPrivilegeEscalation:boolean>>>"))
    each = lambda test, text: F.transform(F.filter(boxes, test), lambda c: F.concat(F.lit(f"container {text}: "), c["name"]))
    yes = lambda c: F.coalesce(c, F.lit(False))
    shared = [F.when(yes(spec[n]), F.lit(f"pod shares the host's {what}")) for n, what in (("hostNetwork", "network"), ("hostPID", "processes"), ("hostIPC", "memory"))]
    volumes = F.coalesce(spec["volumes"], F.array().cast("array<struct<name:string,hostPath:struct<path:string>>>"))
    mounts = F.transform(F.filter(volumes, lambda v: yes(v["hostPath"]["path"].isNotNull())), lambda v: F.concat(F.lit("pod mounts a host path: "), v["hostPath"]["path"]))
    deny = F.concat(each(lambda c: yes(c["securityContext"]["privileged"]), "is privileged"), F.filter(F.array(*shared), lambda x: x.isNotNull()))
    warn = F.concat(each(lambda c: F.coalesce(c["securityContext"]["allowPrivilegeEscalation"], F.lit(True)), "may escalate"), each(lambda c: ~yes(c["securityContext"]["runAsNonRoot"]) & (F.coalesce(c["securityContext"]["runAsUser"], F.lit(0)) == 0), "may run as root"), each(lambda c: c["image"].endswith(":latest") | ~F.contains(c["image"], F.lit(":")), "has no fixed image"), mounts)
    return pods.select(F.col(id_col), deny.alias("deny"), warn.alias("warn"))


#: Fixed values of the admission pack: capabilities, namespaces and host paths.
DANGEROUS = ("SYS_ADMIN", "NET_ADMIN", "SYS_PTRACE", "SYS_MODULE", "SYS_RAWIO", "DAC_READ_SEARCH", "SETUID", "SETGID")
SYSTEM_NAMESPACES, SAFE_PATHS = ("kube-system", "kube-public", "kube-node-lease"), ("/sys/kernel/btf", "/sys/fs/bpf", "/proc")
BOX = "array<struct<name:string,image:string,securityContext:struct<privileged:boolean,runAsUser:bigint,allowPrivilegeEscalation:boolean,capabilities:struct<add:array<string>>>>>"
REVIEW = f"request struct<namespace:string,object:struct<spec:struct<hostNetwork:boolean,hostPID:boolean,hostIPC:boolean,containers:{BOX},initContainers:{BOX},ephemeralContainers:{BOX},volumes:array<struct<name:string,hostPath:struct<path:string>>>>>>"


def review(requests: DataFrame, column: str = "value", id_col: str = "id") -> DataFrame:
    """(id, deny, warn) of admission reviews (JSON): messages about a pod, any in deny refuses it. All kinds of containers count; pods of the
    system's namespaces may share the host's namespaces. A text that is no review has no messages."""
    request = F.from_json(column, REVIEW)["request"]
    spec, namespace = request["object"]["spec"], request["namespace"]
    none = F.array().cast(BOX)
    boxes = F.concat(*[F.coalesce(spec[n], none) for n in ("containers", "initContainers", "ephemeralContainers")])
    yes = lambda c: F.coalesce(c, F.lit(False))
    named = lambda test, text: F.transform(F.filter(boxes, test), lambda c: F.concat(F.lit("container "), c["name"], F.lit(f" {text}")))
    outside = ~yes(namespace.isin(*SYSTEM_NAMESPACES))
    shared = F.array_compact(F.array(*[F.when(yes(spec[n]) & outside, f"{n} outside the system's namespaces") for n in ("hostNetwork", "hostPID", "hostIPC")]))
    added = lambda c: F.filter(F.coalesce(c["securityContext"]["capabilities"]["add"], F.array().cast("array<string>")), lambda x: x.isin(*DANGEROUS))
    capable = F.flatten(F.transform(boxes, lambda c: F.transform(added(c), lambda x: F.concat(F.lit("container "), c["name"], F.lit(" asks for capability "), x))))
    volumes = F.filter(F.coalesce(spec["volumes"], F.array().cast("array<struct<name:string,hostPath:struct<path:string>>>")), lambda v: v["hostPath"].isNotNull())
    safe = lambda path: any_of([F.coalesce(F.startswith(path, F.lit(p)), F.lit(False)) for p in SAFE_PATHS])
    mounts = F.transform(F.filter(volumes, lambda v: ~safe(v["hostPath"]["path"])), lambda v: F.concat(F.lit("volume "), v["name"], F.lit(" mounts host path "), F.coalesce(v["hostPath"]["path"], F.lit(""))))
    deny = F.concat(shared, named(lambda c: yes(c["securityContext"]["allowPrivilegeEscalation"]), "may escalate"))
    warn = F.concat(named(lambda c: yes(c["securityContext"]["privileged"]), "is privileged"), capable, named(lambda c: yes(c["securityContext"]["runAsUser"] == 0), "runs as root"), named(lambda c: yes(F.endswith(c["image"], F.lit(":latest"))), "has no fixed image"), mounts)
    empty = F.array().cast("array<string>")
    return requests.select(F.col(id_col), F.coalesce(deny, empty).alias("deny"), F.coalesce(warn, empty).alias("warn"))


def audit_query(entries: DataFrame, since: str | None = None, action: str = "", pid: int = 0) -> DataFrame:
    """Audit entries (ts, action, pid, rule_id, success) from ``since`` on; empty filters let all pass."""
    rows = entries.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else entries
    rows = rows.where(F.col("action") == action) if action else rows
    return rows.where(F.col("pid") == pid) if pid else rows


def audit_stats(entries: DataFrame) -> DataFrame:
    """(dimension, key, n, succeeded, failed, first_ts, last_ts): in all, by action and by rule, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), k.alias("key")) for d, k in (("all", F.lit("")), ("action", F.col("action").cast("string")), ("rule_id", F.col("rule_id").cast("string")))])).alias("p")
    return entries.select("ts", "success", pairs).groupBy("p.dimension", "p.key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("success")).alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def escalations(alerts: DataFrame, prefixes: list[str], safe: list[str], per_minute: int, key: str = "pid", dry_until: str | None = None, tie: str = "event_id") -> DataFrame:
    """Adds would_enforce: the rule's id begins with one of the prefixes, the process isn't on the safe list, the minute's budget isn't used up, and
    the dry run is over. A column only: nothing is done to a host."""
    from pyspark.sql import Window

    wanted = any_of([F.col("rule_id").startswith(p) for p in prefixes]) & ~F.col("comm").isin(safe)
    wanted = wanted & (F.col("ts") >= F.lit(dry_until).cast("timestamp")) if dry_until else wanted
    rows = alerts.withColumn("__want", F.coalesce(wanted, F.lit(False)))
    dealt = F.when(F.col("__want"), 0).otherwise(F.pmod(F.xxhash64(tie), F.lit(256)))  # only wanted rows are ranked; the others are no one task's work
    w = Window.partitionBy(F.date_trunc("minute", "ts"), "__want", dealt).orderBy("ts", tie)
    return rows.withColumn("would_enforce", F.col("__want") & (F.row_number().over(w) <= per_minute)).drop("__want")


class Plugins:
    """Python matchers registered by name: each takes a pandas frame of events and returns one of matched, severity and message, row for row;
    they run in Arrow batches. A matcher that raises matches nothing in that batch, as a broken plugin must not stop the others."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}

    def register(self, name: str, match: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
        self.known[name] = match

    def handler(self, name: str):
        """Registers a function from one event (a dict) to None or (severity, message)."""

        def keep(f: Callable[[dict], tuple[str, str] | None]):
            def match(pdf: pd.DataFrame) -> pd.DataFrame:
                said = [f(x) for x in pdf.to_dict("records")]
                return pd.DataFrame({"matched": [x is not None for x in said], "severity": [x[0] if x else None for x in said], "message": [x[1] if x else None for x in said]}, index=pdf.index)

            self.known[name] = match
            return f

        return keep

    def evaluate(self, events: DataFrame) -> DataFrame:
        """A row for each event and plugin that matches: the event's columns, rule_id, severity and message."""
        known, names = dict(self.known), events.columns
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", rule_id string, severity string, message string"

        def run(batches):
            for pdf in batches:
                for name, match in known.items():
                    try:
                        out = match(pdf)
                    except Exception:  # noqa: BLE001  whatever a plugin raises
                        continue
                    hit = out["matched"].astype(bool).to_numpy()
                    if hit.any():
                        yield pdf[hit].assign(rule_id=name, severity=out["severity"].to_numpy()[hit], message=out["message"].to_numpy()[hit])[[*names, "rule_id", "severity", "message"]]

        return events.mapInPandas(run, schema)
