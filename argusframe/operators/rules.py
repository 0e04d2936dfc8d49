"""Declarative detection rules compiled into one Spark expression per event type.

Logic is two-valued: a missing field makes every leaf false, and an empty value satisfies only equals, not_equals and not_in.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import bound, cidr_bounds, host_of_url, ipv4_number, ipv6_hex, mapped_ipv4

#: Linux capability names in bit order from 0 (fixed values).
CAPABILITIES = """chown dac_override dac_read_search fowner fsetid kill setgid setuid setpcap linux_immutable net_bind_service net_broadcast
net_admin net_raw ipc_lock ipc_owner sys_module sys_rawio sys_chroot sys_ptrace sys_pacct sys_admin sys_boot sys_nice sys_resource sys_time
sys_tty_config mknod lease audit_write audit_control setfcap mac_override mac_admin syslog wake_alarm block_suspend audit_read perfmon bpf checkpoint_restore""".split()
ALIASES = {"eq": "equals", "neq": "not_equals"}
EMPTY_OK = {"equals", "not_equals", "not_in"}
MAX_PATTERN = 1024
CIDR_FIELDS = {"daddr", "saddr", "cloud.source_ip"}


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    values: tuple = ()


@dataclass(frozen=True)
class Group:
    operator: str = "and"
    conditions: tuple = ()
    groups: tuple = ()


@dataclass(frozen=True)
class Rule:
    id: str
    event_type: str
    when: Condition | Group
    severity: str = "warning"
    action: str = "alert"
    name: str = ""
    exceptions: tuple = field(default=())
    description: str = ""
    tags: tuple = ()
    klass: str = ""
    rate: float = 1.0
    sampling: str = "hash_pid"


def any_of(columns: list[Column], empty: bool = False) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(empty)


def mask_of(names: tuple) -> int:
    known = {n: i for i, n in enumerate(CAPABILITIES)}
    return sum({1 << known[x] for n in names if (x := str(n).lower().removeprefix("cap_")) in known})


def is_network(v: str) -> bool:
    try:
        return bool(cidr_bounds(v))
    except ValueError:
        return False


def quoted(v: str) -> str:
    """A SQL string literal."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Resolved:
    """The columns that rules of one kind test, each made once and named; rules refer to them in SQL text, since a rule set of hundreds is
    sent to the planner much faster as one text than as column objects."""

    def __init__(self, fields: Mapping[str, Column], prefix: str):
        self.fields, self.prefix, self.made = fields, prefix, {}

    def name(self, key: str, column: Callable[[], Column]) -> str:
        if key not in self.made:
            self.made[key] = (f"{self.prefix}{len(self.made)}", column())
        return self.made[key][0]

    def text(self, f: str) -> str:
        return self.name(f"text {f}", lambda: self.fields[f].cast("string"))

    def number(self, f: str) -> str:
        return self.name(f"number {f}", lambda: self.fields[f].try_cast("double"))

    def long(self, f: str) -> str:
        return self.name(f"long {f}", lambda: self.fields[f].cast("long"))

    def ipv4(self, f: str) -> str:
        ip = self.fields[f].cast("string")
        mapped = lambda: F.when(F.contains(ip, F.lit(":")), bound(ipv6_hex(ip), mapped_ipv4))
        return self.name(f"ipv4 {f}", lambda: F.coalesce(ipv4_number(ip), mapped()))

    def ipv6(self, f: str) -> str:
        ip = self.fields[f].cast("string")
        own = lambda digits: F.when(mapped_ipv4(digits).isNull(), digits)
        return self.name(f"ipv6 {f}", lambda: F.when(F.contains(ip, F.lit(":")), bound(ipv6_hex(ip), own)))

    def columns(self) -> dict[str, Column]:
        return dict(self.made.values())


def any_text(tests: list[str]) -> str:
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def compared(sign: str) -> Callable[[str, tuple], str]:
    def test(x: str, values: tuple) -> str:
        try:
            return f"{x} {sign} double('{float(values[0])!r}')"
        except (ValueError, IndexError):
            return "false"

    return test


#: Of a value's column and a condition's values: the SQL test.
TEXT_TESTS: dict[str, Callable[[str, tuple], str]] = {
    "in": lambda x, v: f"{x} IN ({', '.join(map(quoted, v))})" if v else "false",
    "not_in": lambda x, v: f"{x} NOT IN ({', '.join(map(quoted, v))})" if v else f"{x} IS NOT NULL",
    "equals": lambda x, v: f"{x} = {quoted(v[0])}" if v else "false",
    "not_equals": lambda x, v: f"{x} <> {quoted(v[0])}" if v else f"{x} IS NOT NULL",
    "prefix": lambda x, v: any_text([f"startswith({x}, {quoted(p)})" for p in v]),
    "not_prefix": lambda x, v: f"NOT {any_text([f'startswith({x}, {quoted(p)})' for p in v])}",
    "suffix": lambda x, v: any_text([f"endswith({x}, {quoted(p)})" for p in v]),
    "not_suffix": lambda x, v: f"NOT {any_text([f'endswith({x}, {quoted(p)})' for p in v])}",
    "contains": lambda x, v: any_text([f"contains({x}, {quoted(p)})" for p in v]),
    "regex": lambda x, v: any_text([f"{x} RLIKE {quoted(p)}" for p in v]),
}
NUMBER_TESTS = {n: compared(sign) for n, sign in (("gt", ">"), ("lt", "<"), ("gte", ">="), ("lte", "<="))}
OPERATORS = {*TEXT_TESTS, *NUMBER_TESTS, "in_cidr", "not_in_cidr"}


def in_networks(four: str, six: str, values: tuple) -> str:
    """IPv4 networks hold IPv4 addresses, IPv6 networks IPv6 addresses; IPv4 written as IPv6 (::ffff:1.2.3.4) counts as IPv4 in both. False for
    what isn't an address. What isn't a network holds nothing."""
    tests = []
    for low, high in [cidr_bounds(v) for v in values if is_network(v) and ":" not in v]:
        tests.append(f"coalesce({four} BETWEEN {low} AND {high}, false)")
    for low, high in [cidr_bounds(v) for v in values if is_network(v) and ":" in v]:
        mapped = low >> 32 == 0xFFFF
        tests.append(f"coalesce({four} BETWEEN {low & 0xFFFFFFFF} AND {high & 0xFFFFFFFF}, false)" if mapped else f"coalesce({six} BETWEEN '{low:032x}' AND '{high:032x}', false)")
    return any_text(tests)


def condition_text(c: Condition, at: Resolved) -> str:
    op, values = ALIASES.get(c.op.lower(), c.op.lower()), tuple(map(str, c.values))
    if op in ("caps_gained", "caps_dropped"):
        if "old_caps" not in at.fields or "new_caps" not in at.fields:
            return "false"
        old, new = at.long("old_caps"), at.long("new_caps")
        bits = f"{new} & ~{old}" if op == "caps_gained" else f"{old} & ~{new}"
        return f"coalesce(({bits} & {mask_of(c.values)}L) <> 0, false)"
    if c.field not in at.fields or op not in OPERATORS:
        return "false"
    x = at.text(c.field)
    if op in ("in_cidr", "not_in_cidr"):
        four, six = at.ipv4(c.field), at.ipv6(c.field)
        inside = in_networks(four, six, values)
        hit = inside if op == "in_cidr" else f"({four} IS NOT NULL OR {six} IS NOT NULL) AND NOT {inside}"
    else:
        hit = NUMBER_TESTS[op](at.number(c.field), values) if op in NUMBER_TESTS else TEXT_TESTS[op](x, values)
    return f"coalesce({hit}, false)" if op in EMPTY_OK else f"coalesce({hit} AND {x} <> '', false)"


def group_text(g: Condition | Group, at: Resolved) -> str:
    if isinstance(g, Condition):
        return condition_text(g, at)
    parts = [group_text(x, at) for x in (*g.conditions, *g.groups)]
    return "(" + (" OR " if g.operator.lower() == "or" else " AND ").join(parts) + ")" if parts else "true"


def rule_text(rule: Rule, at: Resolved) -> str:
    return " AND ".join([group_text(rule.when, at), *[f"NOT {group_text(x, at)}" for x in rule.exceptions]])


def wrong_pattern(pattern: str) -> str:
    """What keeps a pattern from use, empty if nothing; compiled by the engine that will run it, if one is up."""
    if len(pattern.encode()) > MAX_PATTERN:
        return f"pattern over {MAX_PATTERN} bytes"
    if spark := SparkSession.getActiveSession():
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception:  # noqa: BLE001  whatever the engine raises
            return f"no pattern: {pattern}"
    return ""


def fnv1(data: list[Column]) -> Column:
    """FNV-1 in 32 bits of bytes (columns of 0 to 255)."""
    out = F.lit(2166136261).cast("long")
    for byte in data:
        out = (out * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(byte.cast("long"))
    return out


def sampled(rule: Rule, pid: Column, ts: Column, seed: int = 7) -> Column:
    """Whether the rule looks at an event: all of a process within about a second alike (hash_pid), or each by chance of its own (random)."""
    if rule.rate >= 1:
        return F.lit(True)
    if rule.sampling == "random":
        return F.rand(seed + zlib.crc32(rule.id.encode())) < rule.rate
    pid, tick = pid.cast("long"), F.shiftright(F.unix_micros(ts.cast("timestamp")) * 1000, 30)
    data = [F.shiftright(x, 8 * i).bitwiseAND(F.lit(255)) for x, n in ((pid, 4), (tick, 8)) for i in range(n)]
    return fnv1(data) % 1000 < rule.rate * 1000


def one_in(events: DataFrame, n: int, keys: list[str], tie: str = "event_id") -> DataFrame:
    """The first of every ``n`` events of a key, in order of time."""
    w = Window.partitionBy(*keys).orderBy("ts", tie)
    return events.withColumn("__r", F.row_number().over(w)).where(F.col("__r") % n == 1 % n).drop("__r")


def problems(rules: list[Rule], fields: Mapping[str, set[str]]) -> list[str]:
    """All that is wrong with a rule set; fields: the known ones by event type."""
    out, seen = [], set()
    for r in rules:
        if r.id in seen:
            out.append(f"{r.id}: duplicate id")
        seen.add(r.id)
        if r.event_type not in fields:
            out.append(f"{r.id}: unknown event type {r.event_type}")
            continue
        stack = [r.when, *r.exceptions]
        while stack:
            c = stack.pop()
            if isinstance(c, Group):
                if not c.conditions and not c.groups:
                    out.append(f"{r.id}: empty group")
                stack += [*c.conditions, *c.groups]
                continue
            op = ALIASES.get(c.op.lower(), c.op.lower())
            if op not in OPERATORS and op not in ("caps_gained", "caps_dropped"):
                out.append(f"{r.id}: unknown operator {c.op}")
            elif op not in ("caps_gained", "caps_dropped") and c.field not in fields[r.event_type]:
                out.append(f"{r.id}: unknown field {c.field}")
            if op == "regex":
                out += [f"{r.id}: {what}" for v in c.values if (what := wrong_pattern(str(v)))]
            if op in ("in_cidr", "not_in_cidr"):
                out += [f"{r.id}: {v} is no network" for v in c.values if not is_network(str(v))]
                if c.field not in CIDR_FIELDS and c.field in fields[r.event_type]:
                    out.append(f"{r.id}: {c.field} holds no addresses")
    return out


def overlay(rules: list[Rule], tuning: Mapping[str, list]) -> tuple[list[Rule], list[str]]:
    """Rules with more exceptions by id; the ids that no rule has."""
    known = {r.id for r in rules}
    return [replace(r, exceptions=(*r.exceptions, *tuning.get(r.id, ()))) for r in rules], sorted(set(tuning) - known)


def evaluate(events: DataFrame, rules: list[Rule], fields: Mapping[str, Column] | Mapping[str, Mapping[str, Column]], type_col: str = "event_type", pid: str = "pid") -> DataFrame:
    """One row per event and matching rule, in rule order: the event's columns, rule_id, severity, action. One pass; the only joins look
    values up in small tables (``rule_index``). fields: columns by name, or by event type and name."""
    from . import rule_index as ri

    listed = [r for r in rules if r.action != "drop"]
    if not listed:
        return events.where("false").select("*", *[F.lit("").alias(c) for c in ("rule_id", "severity", "action")])
    nested = bool(fields) and isinstance(next(iter(fields.values())), Mapping)
    kinds = list(dict.fromkeys(r.event_type for r in listed))
    shared = None if nested else Resolved(fields, "__r_")  # one set of columns for all kinds
    at = {kind: shared or Resolved(fields.get(kind, {}), f"__r{i}_") for i, kind in enumerate(kinds)}
    index = ri.Index(listed, lambda kind, field: field in at[kind].fields)

    def test(i: int) -> str:
        r = listed[i]
        own = at[r.event_type]
        chosen = "" if r.rate >= 1 else f" AND {own.name(f'sampled {r.sampling} {r.rate} {r.id * (r.sampling == "random")}', lambda: sampled(r, F.col(pid), F.col('ts')))}"
        return rule_text(r, own) + chosen

    keyless = {kind: [f"IF({test(i)}, {i}, NULL)" for i in index.keyless if listed[i].event_type == kind] for kind in kinds}
    tests = {i: test(i) for i in range(len(listed)) if i not in index.untested and i not in set(index.keyless)}
    for field, _, _ in index.slots:
        for kind in kinds:
            if field in at[kind].fields:
                at[kind].text(field)
    rows = events.where(F.col(type_col).isin(kinds)).withColumns({n: c for own in at.values() for n, c in own.columns().items()})
    rows, hits = ri.look_up(rows, index, type_col, lambda kind, field: at[kind].text(field))
    arms = " ".join(f"WHEN {quoted(kind)} THEN array_compact(array({', '.join(own)}))" for kind, own in keyless.items() if own)
    none = F.array().cast("array<int>")
    found = [F.coalesce(F.expr(f"CASE `{type_col}` {arms} END"), none)] if arms else []
    if hits:
        found.append(F.array_distinct(F.concat(*[F.coalesce(h, none) for h in hits])))
    # columns that are used twice stay projections of their own: the tests of keyless rules are compiled there, while those of the few rules that were
    # hit are interpreted in the filter over them, as code for all of them would be too long for one method
    rows = rows.withColumn("__hits", F.array_sort(F.concat(*found)))
    if tests:
        kept = F.expr(f"filter(__hits, h -> NOT get(array({', '.join(str(i in tests).lower() for i in range(len(listed)))}), h) OR {ri.by_number(tests, 'h')})")
        rows = rows.withColumn("__hits", F.when(F.size("__hits") > 0, kept))
    # outer: a plain explode makes the planner infer a filter that would test every rule twice
    rows = rows.withColumn("__hit", F.explode_outer("__hits")).where("__hit is not null")
    said = [F.expr(f"element_at(array({', '.join(quoted(getattr(r, x)) for r in listed)}), __hit + 1)").alias(y) for x, y in (("id", "rule_id"), ("severity", "severity"), ("action", "action"))]
    return rows.select(*events.columns, *said)


def canary_rules(paths: list[str]) -> list[Rule]:
    return [Rule(f"canary_{i}", "file", Condition("filename", "equals", (p,)), "critical") for i, p in enumerate(paths)]


def indicator_rules(indicators: DataFrame, source: str, most: int = 500, listed: int = 100_000) -> list[Rule]:
    """Rules for a threat feed (type: ip, cidr, domain or url; value), ``most`` distinct values a rule in their order, numbered from 1 by type.
    Rules are driver-side objects: a feed of more than ``listed`` values is refused, as lookups.match_indicators joins it at any size."""
    kind = F.when(F.col("type").isin("domain", "url"), "domain").when(F.col("type").isin("ip", "cidr"), F.col("type"))
    value = F.when(kind == "domain", host_of_url(F.col("value"))).otherwise(F.col("value"))
    rows = indicators.select(kind.alias("kind"), value.alias("value")).where("kind is not null and value <> ''").distinct().limit(listed + 1).collect()
    if len(rows) > listed:
        raise ValueError(f"a feed of more than {listed} values makes no rules")
    made = {
        "ip": ("network", lambda v: Condition("daddr", "in", v)),
        "cidr": ("network", lambda v: Group("or", tuple(Condition("daddr", "in_cidr", (x,)) for x in v))),
        "domain": ("dns", lambda v: Condition("qname", "suffix", v)),
    }
    out = []
    for name, (event_type, when) in made.items():
        values = sorted(r.value for r in rows if r.kind == name)
        for i, at in enumerate(range(0, len(values), most), 1):
            out.append(Rule(f"feed_{source}_{name}_{i:03d}", event_type, when(tuple(values[at : at + most])), "critical", name=f"{source} {name} list, part {i}", tags=("feed", source)))
    return out
