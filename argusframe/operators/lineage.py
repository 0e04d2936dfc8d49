"""Parent and child process patterns; the first pattern that fits an event names it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import ALIASES, any_of
from .timejoin import last_before

SHELLS = ("sh", "bash", "dash", "zsh", "fish")


@dataclass(frozen=True)
class Pattern:
    name: str
    parents: tuple
    children: tuple
    severity: str = "warning"
    condition: tuple | None = None  # (field, op, values)


#: The built-in patterns.
PATTERNS = [
    Pattern("web_shell_spawn", ("nginx", "apache2", "httpd", "node", "nodejs", "python", "python3", "gunicorn", "uwsgi"), SHELLS, "critical"),
    Pattern("shell_network_tool", SHELLS, ("curl", "wget", "nc", "netcat", "ncat", "python", "python3", "ruby", "perl"), "critical"),
    Pattern("shell_recon_tool", SHELLS, ("nmap", "masscan", "zmap", "dig", "nslookup")),
]


def load_patterns(text: str) -> list[Pattern]:
    """Patterns of a file (YAML or JSON: patterns of name, parent_comms, child_comms, severity, condition of field, op and values)."""
    from ..sources.rule_files import parsed

    out = []
    for x in parsed(text).get("patterns") or []:
        c = x.get("condition") or None
        out.append(Pattern(str(x["name"]), tuple(map(str, x.get("parent_comms") or ())), tuple(map(str, x.get("child_comms") or ())), str(x.get("severity") or "warning"), (str(c["field"]), str(c["op"]), tuple(c.get("values") or ())) if c else None))
    names = [p.name for p in out]
    if wrong := [f"{p.name}: no parents or children" for p in out if not p.parents or not p.children] + [f"{n}: twice" for n in sorted({n for n in names if names.count(n) > 1})]:
        raise ValueError("; ".join(wrong))
    return out


def is_one_of(comm: Column, names: tuple) -> Column:
    """A name itself, or it with a hyphen or digit and anything after it."""
    return any_of([comm.rlike(f"(?s)^\\Q{n}\\E([-0-9].*)?\\z") for n in names])


def holds(condition: tuple | None) -> Column:
    """A condition on comm, parent_comm, uid, pid or ppid: in, not_in, eq, neq; anything else is false."""
    if condition is None:
        return F.lit(True)
    field, op, values = condition
    op, values = ALIASES.get(op.lower(), op.lower()), [str(v) for v in values]
    if field not in ("comm", "parent_comm", "uid", "pid", "ppid"):
        return F.lit(False)
    value = F.coalesce(F.col(field).cast("string"), F.lit(""))
    tests = {"in": value.isin(values) if values else F.lit(False), "not_in": ~value.isin(values) if values else F.lit(True), "equals": value == values[0] if values else F.lit(False), "not_equals": value != values[0] if values else F.lit(True)}
    return tests.get(op, F.lit(False))


def match(events: DataFrame, patterns: list[Pattern] = PATTERNS) -> DataFrame:
    """Events (comm, parent_comm) that fit a pattern, with pattern and severity of the first that they fit."""
    hit = F.lit(None).cast("struct<pattern:string,severity:string>")
    for p in reversed(patterns):
        fits = is_one_of(F.col("parent_comm"), p.parents) & is_one_of(F.col("comm"), p.children) & holds(p.condition)
        hit = F.when(F.coalesce(fits, F.lit(False)), F.struct(F.lit(p.name).alias("pattern"), F.lit(p.severity).alias("severity"))).otherwise(hit)
    return events.withColumn("__hit", hit).where("__hit is not null").select(*events.columns, "__hit.*")


def with_parent(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """Fills a missing parent_comm with the last comm that the parent's pid showed before: an as-of join, one exchange."""
    found = last_before(events, events.where("comm is not null"), "ppid", "pid", {"__last": tie, "__parent": "comm"}, tie=tie)
    return found.withColumn("parent_comm", F.coalesce("parent_comm", "__parent")).select(*events.columns)
