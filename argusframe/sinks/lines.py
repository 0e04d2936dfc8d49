"""Alerts as lines of other systems' formats. Alerts have ts, rule_id, rule_name, severity, pid, comm, message, and may have pod_name,
namespace, container_id, fingerprint, trace_id, event_type, labels; what a table lacks counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that other systems give severities, kinds and facilities.
PRIORITIES = {"critical": "Critical"}
KINDS = {"syscall": "syscall", "network": "connect", "file": "open", "tls": "tls", "dns": "dns"}
SYSLOG = {"critical": 2, "warning": 4}
FACILITY = 4


def value(alerts: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in alerts.columns else F.lit("")


def mapped(c: Column, names: dict, other) -> Column:
    out = F.lit(other)
    for k, v in names.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def stamp(c: Column) -> Column:
    """UTC, with as many digits of the second as it needs."""
    text = F.date_format(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"0+\z", ""), r"\.\z", ""), F.lit("Z"))


def some(name: str, c: Column) -> Column:
    """A JSON member, or null if it is empty."""
    return F.when(c != "", c).alias(name)


def falco_json(alerts: DataFrame, source: str = "argusframe") -> Column:
    """{time, rule, priority, output, source, output_fields} in JSON; empty optional fields are left out."""
    v = lambda n: value(alerts, n)
    said = F.when(v("message") != "", v("message")).otherwise(v("rule_name"))
    pod = F.when(v("pod_name") != "", F.concat(F.lit(" pod="), v("pod_name"), F.lit(" ns="), v("namespace"))).otherwise("")
    output = F.concat(said, F.lit(" (proc="), v("comm"), F.lit(" pid="), v("pid"), pod, F.lit(")"))
    details = F.struct(
        v("comm").alias("proc.name"), v("pid").alias("proc.pid"), mapped(v("event_type"), KINDS, "unknown").alias("evt.type"), v("fingerprint").alias("fingerprint"), some("k8s.pod.name", v("pod_name")),
        F.when(v("pod_name") != "", v("namespace")).alias("k8s.ns.name"), some("container.id", v("container_id")), some("rule.id", v("rule_id")),
    )
    return F.to_json(F.struct(stamp(F.col("ts")).alias("time"), v("rule_name").alias("rule"), mapped(v("severity"), PRIORITIES, "Warning").alias("priority"), output.alias("output"), F.lit(source).alias("source"), details.alias("output_fields")))


def plain(c: Column) -> Column:
    """Control characters become blanks."""
    return F.regexp_replace(c, r"[\x00-\x1f\x7f]", " ")


def quoted(c: Column) -> Column:
    """A parameter value: backslash, quote and bracket escaped, line ends written out, other control characters gone."""
    c = F.regexp_replace(c, r'([\\"\]])', r"\\$1")
    c = F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.regexp_replace(c, r"[\x00-\x1f]", "")


def rfc5424(alerts: DataFrame, host: str = "-", app: str = "argusframe", number: int = 50000) -> Column:
    v = lambda n: value(alerts, n)
    dash = lambda c: F.when(c == "", "-").otherwise(c)
    params = {"rule": v("rule_id"), "severity": v("severity"), "pid": v("pid"), "comm": plain(v("comm")), "pod": dash(v("pod_name")), "namespace": dash(v("namespace")), "fingerprint": v("fingerprint")}
    data = F.concat(F.lit(f"[{app}@{number}"), *[x for k, c in params.items() for x in (F.lit(f' {k}="'), quoted(c), F.lit('"'))], F.lit("]"))
    level = mapped(v("severity"), SYSLOG, 6) + FACILITY * 8
    return F.concat(F.lit("<"), level.cast("string"), F.lit(">1 "), stamp(F.col("ts")), F.lit(f" {host} {app} - - "), data, F.lit(" "), plain(v("message")))


def written_out(c: Column, marks: str) -> Column:
    """Backslashes and the given marks escaped, line ends written out."""
    c = F.regexp_replace(c, rf"([\\{marks}])", r"\\$1")
    return F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def cef_event(alerts: DataFrame, vendor: str = "argusframe", product: str = "argusframe") -> Column:
    """CEF as syslog receivers take it: labelled custom strings, severity 10 if critical or else 4; a rule without a name goes by its id."""
    v, head = lambda n: value(alerts, n), lambda c: written_out(c, "|")
    name = plain(v("rule_name"))
    at = F.date_format(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()), "MMM dd yyyy HH:mm:ss")
    custom = lambda i, label, c: F.concat(F.lit(f" cs{i}Label={label} cs{i}="), written_out(c, "="))
    given = lambda test, *parts: F.when(test != "", F.concat(*parts)).otherwise("")
    extension = F.concat(
        F.lit("rt="), at, F.lit(" suser="), written_out(plain(v("comm")), "="), F.lit(" spid="), v("pid"), custom(1, "rule_id", v("rule_id")),
        given(v("pod_name"), custom(2, "pod", v("pod_name")), custom(3, "namespace", v("namespace"))), given(v("trace_id"), custom(4, "trace_id", v("trace_id"))),
        given(v("fingerprint"), custom(5, "fingerprint", v("fingerprint"))), F.lit(" msg="), written_out(plain(v("message")), "="),
    )
    level = mapped(v("severity"), {"critical": "10"}, "4")
    return F.concat_ws("|", F.lit("CEF:0"), F.lit(vendor), F.lit(product), F.lit("1.0"), head(v("rule_id")), head(F.when(name != "", name).otherwise(v("rule_id"))), level, extension)


def alertmanager_json(alerts: DataFrame, name: str = "ArgusframeAlert", url: str = "") -> Column:
    """{labels, annotations, generatorURL}; pod labels only with a pod or namespace."""
    v = lambda n: value(alerts, n)
    placed = (v("pod_name") != "") | (v("namespace") != "")
    labels = F.struct(F.lit(name).alias("alertname"), v("rule_id").alias("rule_id"), v("severity").alias("severity"), some("pod", v("pod_name")), some("namespace", v("namespace")), F.when(placed & (v("container_id") != ""), v("container_id")).alias("container_id"))
    text = F.when(v("trace_id") != "", F.concat(v("message"), F.lit(" [trace_id: "), v("trace_id"), F.lit("]"))).otherwise(v("message"))
    return F.to_json(F.struct(labels.alias("labels"), F.struct(v("rule_name").alias("summary"), text.alias("description")).alias("annotations"), F.lit(url).alias("generatorURL")))


def log_record_json(alerts: DataFrame, service: str = "argusframe") -> Column:
    """One OTLP log record in JSON: time, severity, body and attributes."""
    v = lambda n: value(alerts, n)
    attribute = lambda k, c: F.struct(F.lit(k).alias("key"), F.struct(c.alias("stringValue")).alias("value"))
    pairs = F.filter(F.array(*[attribute(k, v(n)) for k, n in (("rule.id", "rule_id"), ("process.pid", "pid"), ("process.name", "comm"), ("k8s.pod.name", "pod_name"), ("k8s.namespace.name", "namespace"))]), lambda a: a["value"]["stringValue"] != "")
    nanos = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    return F.to_json(F.struct(nanos.alias("timeUnixNano"), mapped(v("severity"), {"critical": 21, "warning": 13}, 9).alias("severityNumber"), F.upper(v("severity")).alias("severityText"), F.struct(v("message").alias("stringValue")).alias("body"), F.concat(pairs, F.array(attribute("service.name", F.lit(service)))).alias("attributes")))


def chat_text(alerts: DataFrame) -> Column:
    """One alert as a line for people: severity, rule, process and message, with the pod if there is one."""
    v = lambda n: value(alerts, n)
    where = F.when(v("pod_name") != "", F.concat(F.lit(" in "), F.concat_ws("/", F.nullif(v("namespace"), F.lit("")), v("pod_name")))).otherwise("")
    return F.concat(F.lit("["), F.upper(v("severity")), F.lit("] "), v("rule_id"), F.lit(": "), v("comm"), F.lit(" (pid "), v("pid"), F.lit(")"), where, F.when(v("message") != "", F.concat(F.lit(" - "), v("message"))).otherwise(""))


def chat_json(alerts: DataFrame, kind: str, chat_id: str = "") -> Column:
    """The body that a chat service's webhook takes: slack ({text}), discord ({content}, at most 2000 characters) or telegram ({chat_id, text}, at
    most 4096); longer texts end in an ellipsis."""
    short = lambda n: F.when(F.char_length(chat_text(alerts)) > n, F.concat(F.left(chat_text(alerts), F.lit(n - 1)), F.lit("\u2026"))).otherwise(chat_text(alerts))
    bodies = {"slack": F.struct(chat_text(alerts).alias("text")), "discord": F.struct(short(2000).alias("content")), "telegram": F.struct(F.lit(chat_id).alias("chat_id"), short(4096).alias("text"))}
    return F.to_json(bodies[kind])


def webhook_json(alerts: DataFrame, least: str = "warning") -> DataFrame:
    """(body) of the alerts of at least a severity, as a webhook or a Kafka topic takes them: all columns that aren't null."""
    rank = mapped(F.col("severity"), {"critical": 2, "warning": 1}, 0)
    return alerts.where(rank >= {"critical": 2, "warning": 1}.get(least, 0)).select(F.to_json(F.struct("*")).alias("body"))
