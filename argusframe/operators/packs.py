"""Policy packs as rules: conditions over the event frame, of which the first critical one that holds (else the first) decides for an event.

A pack is data for the rule engine, so a user's own pack is a list of rules or a rule file; an event type's policies are one CASE over columns that
are made once. What an event doesn't have makes a test false, and its negation too, as in ``rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as ru
from .rules import Condition, Group, Rule

# Ids, severities, actions, techniques, ports, names and paths of the packs.
SHELLS = ("bash", "sh", "zsh", "dash", "fish", "python", "python3", "perl", "ruby")
WEB_SERVERS = ("nginx", "apache", "apache2", "httpd", "lighttpd", "caddy")
DATABASES = ("mysql", "postgres", "mongodb", "redis-server")
PACKAGE_MANAGERS = ("apt", "apt-get", "yum", "dnf", "pip", "pip3", "npm")
MINERS, MINER_PARTS = ("xmrig", "minerd", "cgminer", "bfgminer", "stratum"), ("miner", "xmr")
MINING_PORTS = ("3333", "3334", "45700", "45560", "14444")
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8")
LOOKUP_TOOLS = ("dig", "nslookup", "host", "resolvectl")
RESOLVERS = (*LOOKUP_TOOLS, "systemd-resolve", "unbound", "dnsmasq")
PLAIN_WORDS = ("www", "mail", "ftp", "smtp", "pop", "imap", "ns", "dns", "api", "cdn", "app", "blog", "shop", "news")
ODD_TLDS = (".tk", ".ml", ".ga", ".cf", ".gq", ".top", ".xyz", ".click", ".link")
DEBUGGERS = ("gdb", "strace", "ltrace", "perf", "rr", "valgrind", "ptrace")
CLUSTER_PROCESSES = ("kube-proxy", "kubelet", "coredns", "calico-node", "cilium-agent", "fluentd", "prometheus")
CLUSTER_INFRA = ("kube-apiserver", "etcd", "kubelet", "kube-controller", "kube-scheduler")
RUNTIME_SOCKETS = ("/run/containerd/containerd.sock", "/var/run/containerd/containerd.sock", "/run/crio/crio.sock", "/var/run/crio/crio.sock", "/var/run/docker.sock", "/run/docker.sock")
METADATA_ADDRESSES = ("169.254.169.254", "169.254.170.2")


def has(field: str, op: str, *values: str) -> Condition:
    return Condition(field, op, values)


def every(*parts: Condition | Group) -> Group:
    return Group("and", tuple(p for p in parts if isinstance(p, Condition)), tuple(p for p in parts if isinstance(p, Group)))


def some(*parts: Condition | Group) -> Group:
    return Group("or", tuple(p for p in parts if isinstance(p, Condition)), tuple(p for p in parts if isinstance(p, Group)))


def policy(id: str, kind: str, severity: str, action: str, technique: str, when: Condition | Group, unless: Condition | Group | None = None) -> Rule:
    return Rule(id, kind, when, severity, action, id.replace("_", " "), (unless,) if unless else (), tags=(f"mitre:{technique}",))


SHELL, MINER = has("comm", "in", *SHELLS), some(has("comm", "in", *MINERS), has("comm_lower", "contains", *MINER_PARTS))
WRITES, OPENS, OUTSIDE = has("op", "equals", "write"), has("op", "equals", "open"), has("daddr", "not_in_cidr", *PRIVATE)
NETWORK = [
    policy("cryptominer_connection", "network", "critical", "block", "T1496", every(has("dport", "in", *MINING_PORTS), OUTSIDE)),
    policy("xmrig_default_port", "network", "critical", "block", "T1496", has("dport", "equals", "45700")),
    policy("miner_process_network", "network", "critical", "block", "T1496", MINER),
    policy("privileged_port_nonroot", "network", "warning", "alert", "T1048", every(has("dport", "lt", "1024"), has("uid", "not_equals", "0"), OUTSIDE)),
    policy("ssh_nonstandard_port", "network", "warning", "alert", "T1021", every(has("dport", "gte", "2222"), has("dport", "lte", "2229"))),
    policy("rapid_connections", "network", "warning", "alert", "T1071", every(has("proto", "equals", "6"), SHELL, OUTSIDE)),
    policy("dns_over_https", "network", "warning", "alert", "T1071.004", every(has("dport", "equals", "443"), has("comm", "in", *LOOKUP_TOOLS))),
    policy("tor_connection", "network", "critical", "alert", "T1090", has("dport", "equals", "9001")),
    policy("tor_connection_dir", "network", "critical", "alert", "T1090", has("dport", "equals", "9030")),
]
FILE = [
    policy("shadow_access", "file", "critical", "alert", "T1003", has("filename", "contains", "/etc/shadow")),
    policy("passwd_write", "file", "critical", "alert", "T1136", every(has("filename", "contains", "/etc/passwd"), WRITES)),
    policy("sudoers_access", "file", "critical", "alert", "T1548", every(has("filename", "contains", "/etc/sudoers"), WRITES)),
    policy("authorized_keys_modify", "file", "critical", "alert", "T1098", every(has("filename", "contains", "authorized_keys"), WRITES)),
    policy("ssh_key_read", "file", "warning", "alert", "T1552", every(has("filename", "contains", ".ssh/"), has("filename", "contains", "id_")), has("filename", "contains", ".pub")),
    policy("k8s_token_access", "file", "warning", "alert", "T1552", has("filename", "contains", "/var/run/secrets/kubernetes.io/serviceaccount"), some(has("comm", "in", "kubelet", "kube-proxy", "kubectl"), has("comm", "prefix", "kube-"))),
    policy("docker_socket_access", "file", "critical", "alert", "T1610", has("filename", "contains", "/var/run/docker.sock"), has("comm", "in", "dockerd", "docker", "containerd")),
    policy("containerd_socket_access", "file", "critical", "alert", "T1610", every(has("filename", "contains", "/run/containerd"), OPENS), has("comm", "in", "containerd", "containerd-shim", "ctr")),
    policy("crio_socket_access", "file", "critical", "alert", "T1610", has("filename", "contains", "/var/run/crio"), some(has("comm", "equals", "crio"), has("comm", "prefix", "crio-"))),
    policy("proc_enumeration", "file", "warning", "alert", "T1082", every(has("filename", "prefix", "/proc/"), has("filename", "contains", "/exe"), SHELL)),
    policy("kernel_module_access", "file", "critical", "alert", "T1547.006", every(has("filename", "prefix", "/lib/modules/"), has("filename", "contains", ".ko"), OPENS)),
    policy("hosts_file_modify", "file", "warning", "alert", "T1565", every(has("filename", "equals", "/etc/hosts"), WRITES)),
    policy("resolv_conf_modify", "file", "warning", "alert", "T1565", every(has("filename", "equals", "/etc/resolv.conf"), WRITES)),
    policy("setuid_binary", "file", "warning", "alert", "T1548", has("setuid", "equals", "true")),
]
QUERY, TOOL = has("direction", "equals", "0"), has("comm", "in", *RESOLVERS)
DNS = [
    policy("dga_domain", "dns", "critical", "alert", "T1568.002", every(QUERY, has("label_length", "gt", "12"), has("label", "regex", "[0-9]")), has("label_lower", "contains", *PLAIN_WORDS)),
    policy("suspicious_tld", "dns", "warning", "alert", "T1071.004", every(QUERY, has("qname_lower", "suffix", *ODD_TLDS))),
    policy("dns_txt_query", "dns", "warning", "alert", "T1071.004", every(QUERY, has("qtype", "equals", "16")), TOOL),
    policy("mining_pool_dns", "dns", "critical", "block", "T1496", every(QUERY, has("mining_name", "equals", "true"))),
    policy("tor_dns_query", "dns", "critical", "alert", "T1090", every(QUERY, has("qname_lower", "contains", "tor"), has("qname_lower", "contains", "exit"))),
    policy("long_dns_query", "dns", "warning", "alert", "T1071.004", every(QUERY, has("qname_length", "gt", "50")), TOOL),
    policy("dynamic_dns_query", "dns", "warning", "alert", "T1568.001", every(QUERY, has("dynamic_name", "equals", "true"))),
    policy("nxdomain_response", "dns", "warning", "alert", "T1568.002", every(has("direction", "equals", "1"), has("rcode", "equals", "3"), SHELL)),
    policy("miner_dns_query", "dns", "critical", "alert", "T1496", every(QUERY, MINER)),
]
INJECTION = [
    policy("ptrace_injection", "syscall", "warning", "alert", "T1055.008", has("nr", "equals", "101"), some(has("comm", "in", *DEBUGGERS), has("comm", "prefix", "java"))),
    policy("memfd_fileless_staging", "syscall", "critical", "alert", "T1055.002", has("nr", "equals", "319")),
    policy("fexecve_fileless_exec", "syscall", "critical", "alert", "T1055.002", has("nr", "equals", "322")),
    policy("proc_mem_write", "file", "critical", "alert", "T1055.009", has("filename", "regex", "/proc/[0-9]+/mem")),
    policy("ld_preload_hijack", "file", "critical", "alert", "T1574.006", has("filename", "equals", "/etc/ld.so.preload")),
    policy("devshm_so_staging", "file", "critical", "alert", "T1055", every(has("filename", "prefix", "/dev/shm/"), has("filename", "suffix", ".so"))),
]
CLUSTER = [
    policy("k8s_sa_token_theft", "file", "critical", "alert", "T1528", has("filename", "prefix", "/var/run/secrets/kubernetes.io/serviceaccount"), has("comm", "in", *CLUSTER_PROCESSES)),
    policy("k8s_etcd_direct_access", "network", "critical", "alert", "T1552.001", has("dport", "in", "2379", "2380"), has("comm", "in", *CLUSTER_INFRA)),
    policy("k8s_control_plane_access", "file", "critical", "alert", "T1611", has("filename", "prefix", "/etc/kubernetes/"), has("comm", "in", *CLUSTER_INFRA)),
    policy("k8s_imds_access", "network", "critical", "alert", "T1613", has("daddr", "in", *METADATA_ADDRESSES)),
    policy("k8s_runtime_socket_access", "file", "critical", "alert", "T1552.007", has("filename", "in", *RUNTIME_SOCKETS)),
]
ESCAPE_PATHS = some(has("filename", "prefix", "/proc/1/root", "/proc/self/root"), every(has("filename", "prefix", "/proc/self/cwd"), has("filename", "contains", "../")))
#: Event types whose events may tell of a parent.
WITH_PARENTS = ("syscall", "network", "dns", "file")


def spawned(id: str, severity: str, technique: str, parents: tuple[str, ...], kinds: tuple[str, ...] = WITH_PARENTS) -> list[Rule]:
    """A policy on a shell and its parent, for each event type."""
    return [policy(id, kind, severity, "alert", technique, every(has("parent_comm", "in", *parents), SHELL)) for kind in kinds]


LINEAGE = [
    *spawned("reverse_shell_webserver", "critical", "T1059", WEB_SERVERS, ("syscall", "network", "dns")),
    *spawned("shell_from_database", "critical", "T1190", DATABASES),
    policy("container_escape_proc", "file", "critical", "block", "T1611", ESCAPE_PATHS),
    policy("sudoers_modification", "file", "critical", "alert", "T1548", every(has("filename", "contains", "/etc/sudoers"), WRITES)),
    policy("ssh_key_access", "file", "warning", "alert", "T1552", every(has("filename", "contains", ".ssh/"), has("filename", "contains", "id_"))),
    *spawned("init_spawns_shell", "warning", "T1037", ("init",)),
    *spawned("cron_spawns_shell", "warning", "T1053", ("cron",)),
    *spawned("package_manager_shell", "warning", "T1071", PACKAGE_MANAGERS),
]
PACKS = {"lineage": LINEAGE, "network": NETWORK, "file": FILE, "dns": DNS, "process_injection": INJECTION, "k8s": CLUSTER}


def fields() -> dict[str, dict[str, Column]]:
    """What the packs' conditions name, by event type, of the event frame."""
    from ..functions import dns

    c = F.col
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("string")
    who = {"comm": c("comm"), "comm_lower": F.lower("comm"), "parent_comm": c("parent_comm"), "uid": c("uid")}
    qname = c("dns.qname")
    label = F.when(F.contains(qname, F.lit(".")), F.substring_index(qname, ".", 1))
    return {
        "network": who | {x: c(f"network.{x}") for x in ("dport", "daddr", "proto")},
        "file": who | {x: c(f"file.{x}") for x in ("filename", "op")} | {"setuid": flag(c("file.mode").bitwiseAND(F.lit(2048)) != 0)},
        "syscall": who | {"nr": c("syscall.nr")},
        "dns": who | {x: c(f"dns.{x}") for x in ("direction", "qtype", "rcode")} | {
            "qname_lower": F.lower(qname), "qname_length": F.char_length(qname), "label": label, "label_lower": F.lower(label), "label_length": F.char_length(label),
            "mining_name": flag(dns.is_mining_name(qname)), "dynamic_name": flag(dns.is_dynamic_name(qname)),
        },
    }


def decide(rows: DataFrame, policies: list[Rule], columns: dict[str, dict[str, Column]] | None = None, type_col: str = "event_type") -> DataFrame:
    """Adds decision (rule_id, severity, message, action, technique), null where no policy holds. Each policy of the event's type is asked once, critical
    ones first, until one holds."""
    columns = fields() if columns is None else columns
    order = sorted(range(len(policies)), key=lambda i: policies[i].severity != "critical")
    arms, made = [], {}
    for n, kind in enumerate(dict.fromkeys(p.event_type for p in policies)):
        at = ru.Resolved(columns.get(kind, {}), f"__p{n}_")
        tests = " ".join(f"WHEN {ru.rule_text(policies[i], at)} THEN {i}" for i in order if policies[i].event_type == kind)
        arms.append(f"WHEN {ru.quoted(kind)} THEN CASE {tests} END")
        made |= at.columns()
    if not arms:
        return rows.withColumn("decision", F.lit(None).cast("struct<rule_id:string,severity:string,message:string,action:string,technique:string>"))
    # out of an array, so that a filter on what follows isn't pushed below it and asks all again
    found = rows.withColumns(made).withColumn("__chosen", F.explode_outer(F.array(F.expr(f"CASE `{type_col}` {' '.join(arms)} END"))))
    of = lambda values: F.get(F.lit(values), F.col("__chosen"))
    technique = [next((t.removeprefix("mitre:") for t in p.tags if t.startswith("mitre:")), "") for p in policies]
    message = F.concat(of([p.name or p.id for p in policies]), F.lit(": "), F.coalesce(F.col("comm").cast("string"), F.lit("")), F.lit(" (pid="), F.coalesce(F.col("pid").cast("string"), F.lit("")), F.lit(")"))
    said = F.struct(of([p.id for p in policies]).alias("rule_id"), of([p.severity for p in policies]).alias("severity"), message.alias("message"), of([p.action for p in policies]).alias("action"), of(technique).alias("technique"))
    return found.withColumn("decision", F.when(F.col("__chosen").isNotNull(), said)).select(*rows.columns, "decision")
